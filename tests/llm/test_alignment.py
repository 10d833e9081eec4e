"""Cross-tokenizer alignment: whole texts against tokenizing without cuts and counting in plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import alignment, registry

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """Rows of the contract from whole texts: ends as sets, pairs as tuples."""
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_letters()
    out, count = [], Counter()
    for key, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append((key, [], [], [], []))
            continue
        a_end = dict(zip(np.cumsum([len(x) for x in a_bytes]).tolist(), range(len(a))))
        b_end = dict(zip(np.cumsum([len(x) for x in b_bytes]).tolist(), range(len(b))))
        both, i, j, groups, links = sorted(a_end.keys() & b_end.keys()), 0, 0, [], []
        for e in both:
            groups.append(f"{','.join(map(str, a[i : a_end[e] + 1]))}|{','.join(map(str, b[j : b_end[e] + 1]))}")
            links.append((a[a_end[e]], b[b_end[e]]))
            i, j = a_end[e] + 1, b_end[e] + 1
        count.update(links)
        out.append((key, a, b, groups, links))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [
        (k, len(a), len(b), len(g), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for k, a, b, g, ls in out
    ], count


HARD = [
    None, "", " ", "  ", "a", "one two  three   four\tfive\n\nsix \n seven", " lead and trail ", "it's 'tis don't 's x 'll", "日本語 のテキスト です。", "naïve café ́ x", " nbsp   x y 　",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "has ▁ a mark", "᠎ mongolian ᠎ x", "\x00\x1c \x1d x", "emoji 👩‍👩‍👧 flags 🇩🇪 x", "ᚠᛇᚻ runes", "x" * 3000, "word " * 4000, "١٢٣ ١ x", "a\x85b \x85 c", "!!! ... --- 12,345.67 a1b2",
]


@pytest.mark.parametrize("flush", [1 << 20, 3])
def test_hard_texts_equal_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(alignment, "PARTIAL", flush)
    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, "one two"), (3, "one two"), (None, "one two")] * 5
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, pairs int, N_A string").repartition(4)
    encoded = alignment.encode(df, groups=True).cache()
    table = alignment.count_pairs(encoded, shard_rows=20)
    assert {"pairs__2", "N_A__2"} <= set(encoded.columns) and len(table.shards.names) > 4
    want, count = brute(rows)
    got = alignment.look_up(encoded, table)
    assert sorted(map(str, (tuple(r[c] for c in NAMES) for r in got.collect()))) == sorted(map(str, want))
    for r in encoded.collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
    assert {(r.a_id, r.b_id): r.links for r in table.frame(spark).collect()} == dict(count)
    top = Counter(r.b_id for r in table.frame(spark).filter("best").collect())
    assert top.keys() == {b for _, b in count}


def test_kept_pieces_change_nothing(monkeypatch):
    aligner = alignment.Aligner()
    first = aligner.align(HARD)
    monkeypatch.setattr(alignment, "KEPT", 0)
    again = [aligner.align([t])[0] for t in HARD]
    plain = lambda found: [f and (*f[:4], f[4].tolist(), f[5].tolist()) for f in found]
    assert plain(first) == plain(again)


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(x'61ff62' AS string) AS text UNION ALL SELECT 2L, 'a � b'")
    rows = {r.doc_id: r for r in alignment.encode(df, keep=["doc_id"]).collect()}
    assert (rows[1].n_a, rows[1].groups_sha256) == (0, "") and rows[2].n_a > 0


def test_empty_table_and_missing_pairs(spark):
    empty = alignment.encode(spark.createDataFrame([], "doc_id long, text string"))
    table = alignment.count_pairs(empty)
    assert alignment.look_up(empty, table).count() == 0 and table.frame(spark).count() == 0
    assert table.shards.counts(np.array([5, 9])).tolist() == [0, 0]


def test_query_equals_brute_force(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want, _ = brute([(r["doc_id"], r["text"]) for r in rows])
    got = registry.queries()["op11_alignment"](spark, SF).select(*NAMES).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert dict(spark.createDataFrame(got[:1]).select(*[F.col(c) for c in NAMES]).dtypes)["count_sum"] == "bigint"
