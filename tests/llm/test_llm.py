"""The corpus operators against brute force, on hard rows, and on the smallest tables."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import ann, decontaminate, flat, language, licenses, lmscore, mixing, neardup, registry, suffixes, toxicity, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, K1 string, node string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(9000))
A = "the cat sat on the mat and looked at the moon while the rain fell softly on the old tin roof of the barn by the river " * 3


def rows():
    texts = [None, "", " \n\t", "!!! ...", "one", "é", "日本語 テキスト です", LONG, A, A, A + "end", "MIT License", "released under the MIT license", "x" * 900, "a\x00b c"]
    out = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2"][i % 3], None, 0.5, "k", "n") for i, t in enumerate(texts)]
    return [*out, out[8], out[8], (None, A, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "The cat sat on the mat, and looked at the moon while"), (2, "mit license"), (2, "mit license"), (3, None), (4, ""), (None, "one")], "item_id long, text string")


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


# --- decontamination --------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return WORD.findall((text or "").translate(LOWER))


def hits(text, items):
    words, covered, found = cut(text), set(), set()
    for item, body in items:
        w = cut(body)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    covered.update(range(j, j + n))
                    found.add("" if item is None else str(item))
    return len(words), len(covered), sorted(found)


@pytest.mark.parametrize("limit", [500_000, 2])
def test_decontamination_equals_brute_force(docs, benchmark, limit):
    items = [tuple(r) for r in benchmark.collect()]
    found = decontaminate.contamination(docs, benchmark, max_windows=limit)
    got = found.select("doc_id", F.col("text"), "n_words", decontaminate.hit_words(F.col("text"), F.col("hits")).alias("n"), "items").collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r.n_words, r.n, r["items"]) == hits(r.text, items)


def test_decontamination_removes(docs, benchmark, spark):
    whole = decontaminate.decontaminate(docs, benchmark).collect()
    assert whole[0].__fields__ == SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
    items = [tuple(r) for r in benchmark.collect()]
    assert len(whole) == sum(hits(r[1], items)[1] == 0 for r in rows())
    left = decontaminate.decontaminate(docs, benchmark, remove="spans")
    assert all(hits(r.text, items)[1] == 0 for r in left.collect())
    assert decontaminate.decontaminate(empty(spark), benchmark).count() == 0
    assert decontaminate.decontaminate(docs, empty(spark, "item_id long, text string")).count() == len(rows())


# --- suffixes ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [4096, 1, 0.02])
def test_suffix_dedup_equals_brute_force(spark, hot):
    rng = np.random.default_rng(1)
    word = ["ab", "é", "cd ", "日本", "zz", "\n", "q"]
    make = lambda n: "".join(rng.choice(word, n))
    shared = [make(150), make(90), "a" * 700, "xyz" * 120]
    texts = [None, "", "short"] + [make(rng.integers(0, 200)) + shared[i % 4] + make(rng.integers(0, 150)) for i in range(40)] + [shared[0]] * 3
    texts[20] = texts[21] = make(60) + shared[1] + shared[1]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, removed int")
    found = suffixes.without_repeats(df, hot=hot)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    got = {r[0]: tuple(r[1:]) for r in found.select("doc_id", F.octet_length("kept") + removed, removed, F.size("removed"), F.sha2("kept", 256)).collect()}
    assert got == dict(enumerate(suffixes.brute_force(texts)))


def test_suffix_dedup_keeps_characters(spark):
    """What a cut splits goes entirely (the first byte of ü and ê is common); genuine replacement characters stay."""
    shared = "é" * 150
    df = spark.createDataFrame([(1, "keep \ufffd keep " + shared + "ü one"), (2, "a" + shared + "ê two \ufffd"), (3, "\ufffd")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.dedup_spans(df).collect()}
    assert got == {1: "keep \ufffd keep  one", 2: "a two \ufffd", 3: "\ufffd"}


def test_two_stage_order():
    rng = np.random.default_rng(2)
    for k in range(20):
        raw = bytes(rng.integers(97, 97 + 1 + k % 5, 300)) + b"\xff" * 2
        text = np.frombuffer(raw, np.uint8)
        wanted = rng.random(len(text)) < 0.5
        wanted[-2:] = False
        order = [i for i in suffixes.sort_suffixes(text, wanted, 400).tolist() if wanted[i]]
        assert order == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: raw[i:])


def test_suffix_dedup_hard_rows(docs, spark):
    want = suffixes.brute_force([r[1] for r in rows()])
    found = suffixes.without_repeats(docs)
    got = Counter((r.text, len(r.kept)) for r in found.collect())
    assert got == Counter((r[1], w[0] - w[1]) for r, w in zip(rows(), want))
    assert suffixes.without_repeats(empty(spark)).count() == 0
    kept = suffixes.dedup_spans(docs)
    assert kept.columns == docs.columns and kept.filter("text is null").count() == 2


# --- near duplicates --------------------------------------------------------------------------------------------


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(4000)]
    texts, want = [], []
    for group in range(30):
        base = list(rng.choice(vocabulary, 300))
        for copy in range([1, 2, 3, 40][group % 4]):
            edited = list(base)
            for at in rng.choice(300, 3 if copy else 0, replace=False):
                edited[at] = f"new{group}_{copy}_{at}"
            texts.append(" ".join(edited))
            want.append(group)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = neardup.class_of(df).select("node", "class_id")
    got = {r.doc_id: r.class_id for r in df.withColumn("node", neardup.node_of(F.col("text"))).join(found, "node").collect()}
    first = {}
    for i, g in enumerate(want):
        first.setdefault(g, i)
    assert got == {i: first[g] for i, g in enumerate(want)}
    assert neardup.keep_one(df).count() == 30


def test_near_duplicates_in_a_crowded_bucket(spark):
    """Pairs among many texts of one template, which are no copies of each other, against brute force."""
    rng = np.random.default_rng(8)
    template, texts = [f"t{i}" for i in range(400)], []
    for k in range(70):
        body = [f"o{k}x{i}" for i in range(60)]
        for copy in range(2):
            own = [f"c{k}x{copy}x{i}" for i in range(40)]
            texts.append(" ".join(template + body + own))
    texts = [texts[i] for i in rng.permutation(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # 396 + 60 of 536 shingles are common to a pair, 396 of 596 to others.
    similar = [[len(x & y) / len(x | y) >= 0.8 for y in grams] for grams in [[{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]] for x in grams]
    want = {i: min(j for j, s in enumerate(row) if s) for i, row in enumerate(similar)}
    assert len(set(want.values())) == 70
    found = neardup.class_of(df).select("node", "class_id")
    got = {r.doc_id: r.class_id for r in df.withColumn("node", neardup.node_of(F.col("text"))).join(found, "node").collect()}
    assert got == want


def test_near_duplicates_equal_weighted_jaccard(spark):
    """Classes are the components of exact weighted Jaccard links among texts near the threshold."""
    rng = np.random.default_rng(12)
    vocabulary, texts = [f"v{i}" for i in range(3000)], []
    for _ in range(40):
        base = list(rng.choice(vocabulary, 200))
        for edits in (0, 2, 4, 30):  # 30 edits are far below the threshold
            words = list(base)
            for at in rng.choice(200, edits, replace=False):
                words[at] = f"e{len(texts)}_{at}"
            texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sampler = neardup.Sampler(neardup.weight_table(*neardup.document_frequencies(df, "text")))
    block = lambda xs: (np.frombuffer("".join(xs).encode(), np.uint8), np.cumsum([0, *map(len, xs)]))
    want = list(range(len(texts)))
    for i in range(len(texts)):
        others = list(range(i - i % 4, i))
        if others:
            near = neardup.similarities(sampler, block([texts[i]] * len(others)), block([texts[j] for j in others]))
            for j, s in zip(others, near):
                if s >= 0.8:
                    want = [want[j] if w == want[i] else w for w in want]
    found = neardup.class_of(df).select("node", "class_id")
    got = {r.doc_id: r.class_id for r in df.withColumn("node", neardup.node_of(F.col("text"))).join(found, "node").collect()}
    assert got == dict(enumerate(want)) and 40 < len(set(want)) < 160


def test_weights_do_not_change_with_size():
    """The same shares of documents weigh the same in a corpus ten times the size."""
    rng = np.random.default_rng(13)
    cells = rng.poisson(3.0, neardup.CELLS).astype(np.int64)
    cells[:5] += [50_000, 20_000, 5_000, 1_000, 500]
    small, large = neardup.weight_table(50_000, cells), neardup.weight_table(500_000, cells * 10)
    assert np.allclose(small, large) and (small[5:] == 1 + neardup.GAIN).all() and (np.diff(small[:5]) > 0).all()


def test_near_duplicates_hard_rows(docs, spark):
    kept = neardup.keep_one(docs).collect()
    words = [r for r in rows() if cut(r[1])]
    blank = [r for r in rows() if not cut(r[1])]
    assert sum(1 for r in kept if not cut(r.text)) == len(blank)
    assert {r.doc_id for r in kept if cut(r.text)} == {r[0] for r in words} - {9, 10, None}
    assert len(kept) == len(blank) + len({r[0] for r in words} - {9, 10, None})
    assert neardup.keep_one(empty(spark)).count() == 0


# --- mixing -----------------------------------------------------------------------------------------------------


def fill(sizes, weights=(5, 2, 1)):
    """Targets by sharing the excess again and again."""
    w = [weights[i % 3] for i in range(len(sizes))]
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in capped)
        free = sum(w[i] for i in range(len(sizes)) if i not in capped)
        out = [3.0 * sizes[i] if i in capped else rest * w[i] / free for i in range(len(sizes))]
        more = {i for i in range(len(sizes)) if i not in capped and out[i] > 3 * sizes[i]}
        if not more:
            return out
        capped |= more


def test_mixing(spark):
    rng = np.random.default_rng(4)
    data = [(i, s, "w " * int(rng.pareto(1.5) * 20 + 1)) for i in range(3000) for s in [[None, "a", "a", "a", "b", "é", "z"][i % 7]] if s != "z" or i < 60]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    got = mixing.copies(df, block=128).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in mixing.copies(df.repartition(7), block=128).collect())
    order = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in got if r.source == s) for s in order]
    for s, size, target in zip(order, sizes, fill(sizes)):
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {size} and all(math.isclose(r.target, target, rel_tol=1e-9) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 0.01 * target + 20
        assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in own)


def test_mixing_hard_rows(docs, spark):
    got = mixing.mix(docs)
    taken = mixing.copies(docs).agg(F.sum("copies")).first()[0]
    assert got.count() == taken and got.columns == [*docs.columns, "copy"]
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_of_many_equal_rows(spark):
    df = spark.range(9000).select(F.when(F.col("id") < 6000, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"), F.lit("a").alias("source"), F.lit("w w w").alias("text"))
    df = df.unionByName(df.filter("doc_id > 0").withColumn("source", F.lit("b")).limit(700))
    got = mixing.copies(df, block=64).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("copies").alias("most"), F.min("copies").alias("least"), F.max("target").alias("target")).collect()
    assert sum(r.n for r in got) == 9700 and all(r.most - r.least <= 1 for r in got)
    for s in "ab":
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 3
    assert mixing.mix(df, block=64).count() * 3 == sum(r.taken for r in got)


def test_flight_keeps_totals():
    rng = np.random.default_rng(5)
    z, p = np.sort(rng.pareto(1, 400) * 50)[::-1].round(), np.full(400, 0.37)
    q = mixing.flight(z, p, rng)
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((z * q).sum() - (z * p).sum()) < 1e-5 * z.sum()
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2


# --- URL filter and licenses ------------------------------------------------------------------------------------


def test_url_filter_and_licenses_equal_sql(spark, docs):
    con = duckdb.connect()
    pages = [(0, None), (1, "x.org/a"), (2, "http://X.ORG"), (3, "http://a.example.org/es/1"), (4, "ftp://example.org/en/12?x"), (5, "http://b.com/de/"), (6, "http://com/fr/x#y"), (7, "://org/"), (7, "://org/"), (8, "http://notorg/"), (9, "http://a.org?x=/"), (None, "http://é.org/é")]
    df = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, Host string")
    con.register("pages", df.select("page_id", "url").toPandas().astype({"page_id": "Int64"}))
    want = con.execute(urls.ORACLE).fetchall()
    got = [tuple(r) for r in urls.judge(df, urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert urls.judge(df.limit(0), urls.rule_table(spark)).count() == 0 and urls.judge(df, urls.rule_table(spark, ())).count() == len(pages)
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r[0], r[1]) for r in rows()])
    want = con.execute(licenses.ORACLE).fetchall()
    names = "doc_id n_words n_base first_word last_word base_labels labels".split()
    got = licenses.scan(docs)
    score = got.columns.index("score", 8)
    assert sorted(str(tuple(r[n] for n in names) + (r[score],)) for r in got.collect()) == sorted(map(str, want))
    assert licenses.scan(empty(spark)).count() == 0


def test_urls_of_many_labels(spark):
    """A host of 20,000 labels costs what its length does."""
    long_ = "a." * 20_000 + "example.org"
    df = spark.createDataFrame([(1, f"http://{long_}/es/x"), (2, f"http://{long_}.org.net/es/x"), (3, "http://x.y" + "/en/1" * 9000)], "page_id long, url string")
    got = {r.page_id: r.rule for r in urls.judge(df, urls.rule_table(spark)).collect()}
    assert got == {1: "example.org/es/", 2: None, 3: None}


def test_wrapped_licenses_are_found(spark):
    """Each template wrapped as in source headers, among other lines; not when its words are scattered."""
    near, far = [], []
    for words, label in licenses.TEMPLATES:
        wrapped = [words.split()[i : i + 4] for i in range(0, len(words.split()), 4)]
        near.append(("Some file\n\n" + "\n".join(" *  " + " ".join(w).capitalize() for w in wrapped) + "\n */\nint main", label))
        far.append(("\n".join(" ".join([w, *["other"] * 30]) for w in words.split()), label))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(near + far)], "doc_id long, text string, want string")
    for r in licenses.scan(df, phrases=(("no such phrase", "none"),)).collect():
        assert (r.want in r.labels.split(",")) == (r.doc_id < len(near))


# --- language, toxicity, language model, neighbours -------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = language.Pieces([b" ab", b"ab", b"abc", b"bc"])
    rng = np.random.default_rng(6)
    probs = np.vstack([rng.random((pieces.n, 2)) / 50, np.zeros(2)])
    ids = lambda b: int(pieces.find(flat.span_hash(flat.prefix(np.frombuffer(b, np.uint8)), [0], [len(b)]))[0])

    def total(word, c):
        return 1.0 if not word else sum(probs[ids(word[:n]), c] * total(word[n:], c) for n in range(1, len(word) + 1) if ids(word[:n]) >= 0)

    words = [b"abc", b"cabab", b"b", b"zzabczzabczz"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = language.forward(language.lattice(data, np.concatenate([[0], ends[:-1]]), ends, pieces), probs)
    for i, w in enumerate(words):
        assert np.allclose(got[i], [math.log(total(b" " + w, c)) for c in (0, 1)])


def test_language_id(spark, docs):
    found = registry.queries()["op5_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.95 * held.count()
    model = language.fit(docs, F.lit(True))
    got = language.identify(docs, model)
    pred = got.columns.index("lang_pred")
    for r in got.collect():
        assert (r[pred] == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language.identify(empty(spark), model).count() == 0
    none = language.fit(empty(spark), F.lit(True))
    assert {r[pred] for r in language.identify(docs, none).collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    """A column of ids as labels, and one text repeated."""
    df = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit("x")).otherwise(F.col("id").cast("string")).alias("lang"), F.when(F.col("id") < 1900, F.lit("same words")).otherwise(F.concat(F.lit("other "), F.col("id"))).alias("text"))
    got = Counter(r.lang for r in language.labelled_sample(df, F.lit(True), "text", "lang", 50).collect())
    assert len(got) == language.MAX_LANGUAGES and got["x"] == 50


def test_block_max_search_is_exact():
    rng = np.random.default_rng(7)
    w = rng.random((300, 40)) * (rng.random((300, 40)) < 0.2)
    w /= np.maximum(np.sqrt((w * w).sum(1, keepdims=True)), 1e-9)
    ids, top = toxicity.Index(w).search(w[:50], 7)
    exact = w[:50] @ w.T
    for i in range(50):
        order = np.lexsort((np.arange(300), -np.round(exact[i], 12)))[:7]
        assert np.allclose(top[i], exact[i][order]) and ids[i].tolist() == [j if exact[i][j] > 0 else -1 for j in order]


def test_toxicity_hard_rows(docs, spark):
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, 0), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(docs, model)
    at = got.columns.index("score", 8)
    assert all(0 <= r[at] <= 1 for r in got.collect()) and got.count() == len(rows())
    blank = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert toxicity.score(docs, blank).count() == len(rows()) and toxicity.score(empty(spark), model).count() == 0


def test_toxicity_meets_copies_of_examples(spark):
    """Every text shares only rare terms with its own example, and that example comes first."""
    data = [(i, f"rare{i}a rare{i}b {'bad' if i % 2 else 'good'}word") for i in range(20)]
    data += [(100 + i, f"rare{i}b rare{i}a") for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(df, toxicity.fit(df, labels, F.lit(True))).collect()}
    assert all(found[100 + i].evidence and found[100 + i].evidence[0].key == str(i) for i in range(20))


def test_seating_follows_the_conditional_distribution():
    """Tables of c customers against sums over all seatings."""
    d, others, base = 0.6, 3.0, 0.2
    weight = lambda sizes: math.prod((lmscore.STRENGTH + d * (others + j)) * base * math.prod(k - d for k in range(1, n)) for j, n in enumerate(sizes))

    def seatings(c):
        if c == 1:
            return [[1]]
        return [x for s in seatings(c - 1) for x in [*[[*s[:i], s[i] + 1, *s[i + 1 :]] for i in range(len(s))], [*s, 1]]]

    for c in (2, 3, 6):
        want = np.zeros(c + 1)
        for s in seatings(c):
            want[len(s)] += weight(s)
        n = 40_000
        got = lmscore.seat(np.full(n, c), d, np.full(n, others), np.full(n, base), flat.mix(np.arange(n, dtype=np.uint64)))
        assert np.allclose(np.bincount(got.astype(int), minlength=c + 1) / n, want / want.sum(), atol=0.012)
    many = lmscore.seat(np.array([65, 600, 40_000]), d, np.full(3, others), np.full(3, base), np.arange(3, dtype=np.uint64))
    assert (many >= 1).all() and (many <= [65, 600, 40_000]).all()


def unpacked(model):
    """(word -> (count, parent probability, back-off), pair -> own part) of a model's buckets."""
    words, own = {}, {}
    for r in model.buckets.collect():
        names, n, p0, back, code, part = lmscore.load(bytes(r.blob), "u8 i8 f4 f4 u8 f4")
        words.update(zip(names.tolist(), zip(n.tolist(), p0.tolist(), back.tolist())))
        own.update(zip(code.tolist(), part.tolist()))
    return words, own


@pytest.mark.parametrize("often", [4096, 3])
def test_language_model(spark, docs, often):
    model = lmscore.fit(docs.filter("doc_id is null or doc_id % 3 != 1"), bucket=3000, often=often)
    assert (len(model.deal.split) > 0) == (often == 3)
    got = lmscore.score(docs, model, block=4000)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), ""]
    trained = [tokens(r[1]) for r in rows() if r[0] is None or r[0] % 3 != 1]
    counts = Counter(x for t in trained for x in t)
    n, v = sum(counts.values()), len(counts)
    words, own = unpacked(model)
    code = lambda w: int(flat.span_hash(flat.prefix(np.frombuffer(w.encode(), np.uint8)), [0], [len(w.encode())])[0])
    start, pair = int(lmscore.START), lambda w, u: int(lmscore.pair_hash(np.array([w], np.uint64), np.array([u], np.uint64))[0])
    pairs = Counter((u, w) for t in trained for u, w in zip([None, *t], t))
    assert own.keys() == {pair(code(w), start if u is None else code(u)) for (u, w), c in pairs.items() if c > 1}
    assert {w: words[code(w)][0] for w in counts} == counts

    def chance(w, u):
        _, p0, _ = words[code(w)] if w in counts else (0, model.new * model.others, 1.0)
        return own.get(pair(code(w), u), 0.0) + words.get(u, (0, 0, 1.0))[2] * p0

    for u in [start, code("the"), code("cat"), code("w1x1"), 77]:  # every context sums to one
        assert math.isclose(sum(chance(w, u) for w in counts) + words.get(u, (0, 0, 1.0))[2] * model.new * model.others, 1.0, rel_tol=1e-4)
    at = {c: got.columns.index(c, 8) for c in lmscore.OUTPUTS}
    found = got.collect()
    assert len(found) == len(rows())
    for r in found:
        mine = tokens(r.text)
        assert (r[at["n_tokens"]], r[at["n_known"]], r[at["train_tokens"]]) == (len(mine), sum(counts[x] > 0 for x in mine), n)
        assert math.isclose(r[at["base_score"]], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in mine), rel_tol=1e-9)
        want = sum(math.log10(chance(w, start if u is None else code(u))) for u, w in zip([None, *mine], mine))
        assert math.isclose(r[at["score"]], want, rel_tol=1e-5) and r[at["spelled_score"]] <= r[at["score"]] + 1e-9
    assert lmscore.score(empty(spark), model).count() == 0
    bare = lmscore.fit(empty(spark))
    assert lmscore.score(docs, bare).count() == len(rows())
    copies = docs.filter("doc_id = 8").limit(1).crossJoin(spark.range(100).withColumnRenamed("id", "nth"))
    assert {round(r.score, 9) for r in lmscore.score(copies.select("doc_id", "text", "nth"), model).collect()} == {round(r[at["score"]], 9) for r in found if r[0] == 8}


@pytest.mark.parametrize("often", [4096, 3])
def test_language_model_predicts_pairs_seen_once(spark, docs, often):
    """Every trained pair has its own part, also one seen once, and every context still sums to one."""
    model = lmscore.fit(docs.filter("doc_id is null or doc_id % 3 != 1"), bucket=3000, often=often, once=True)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), ""]
    trained = [tokens(r[1]) for r in rows() if r[0] is None or r[0] % 3 != 1]
    counts, heads = Counter(x for t in trained for x in t), Counter(x for t in trained for x in [None, *t[:-1]])
    words, own = {}, {}
    for r in model.buckets.collect():
        names, _, p0, back, code, part, _ = lmscore.load(bytes(r.blob), "u8 i8 f4 f4 u8 f4 u1")
        words.update(zip(names.tolist(), zip(p0.tolist(), back.tolist())))
        own.update(zip(code.tolist(), part.tolist()))
    code = lambda w: int(lmscore.START) if w is None else int(flat.span_hash(flat.prefix(np.frombuffer(w.encode(), np.uint8)), [0], [len(w.encode())])[0])
    pair = lambda w, u: int(lmscore.pair_hash(np.array([code(w)], np.uint64), np.array([code(u)], np.uint64))[0])
    pairs = Counter((u, w) for t in trained for u, w in zip([None, *t], t))
    sizes = Counter(pairs.values())
    lone = 1 - lmscore.discount(sizes[1], sizes[2])

    def chance(w, u):
        p0, (_, back) = words[code(w)][0] if w in counts else model.new * model.others, words.get(code(u), (0, 1.0))
        part = lone / (lmscore.STRENGTH + heads[u]) if pairs[u, w] == 1 else own.get(pair(w, u), 0.0)
        return part + back * p0

    assert sizes[1] > 5
    for u in [None, "the", "cat", next(u for (u, _), c in pairs.items() if c == 1 and u)]:
        assert math.isclose(sum(chance(w, u) for w in counts) + words[code(u)][1] * model.new * model.others, 1.0, rel_tol=1e-4)
    got = lmscore.score(docs, model, block=4000)
    score = got.columns.index("score", 8)
    for r in got.collect():
        mine = tokens(r.text)
        assert math.isclose(r[score], sum(math.log10(chance(w, u)) for u, w in zip([None, *mine], mine)), rel_tol=1e-5)


def test_language_model_beats_its_base(spark):
    held = registry.queries()["op8_lm_score"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_neighbours(spark):
    found = registry.queries()["op2_ann"](spark, "/root/testdata/sf0.1").collect()
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in vectors]), np.array([r.embedding for r in vectors], float)
    hit = total = 0
    for q in {r.query_id for r in found}:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]])
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and all(math.isclose(r.score, d[ids == r.vec_id][0], rel_tol=1e-12) for r in mine)
        hit, total = hit + len(best & {r.vec_id for r in mine}), total + 10
    assert hit >= 0.9 * total


def test_neighbours_of_repeated_rows(spark):
    """Each row of a repeated id has a list of its own, with its twins among the candidates."""
    rng = np.random.default_rng(9)
    data = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(20)]
    df = spark.createDataFrame(data + [data[0]] * 2, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 100 == 0, rows_a_part=2).collect()
    x = np.array([v for _, v in data] + [data[0][1]] * 2)
    d = np.sqrt(((x - x[0]) ** 2).sum(1))
    best = sorted(zip(d.tolist()[1:], [*range(1, 20), 0, 0]))[:10]
    assert sorted((r.rank, r.vec_id) for r in got) == sorted((k, i) for k, (_, i) in enumerate(best, 1) for _ in range(3))


def test_neighbours_in_leaves(spark):
    """Where parts would be too large, each is parted again by a classifier of its own."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 12))[rng.integers(0, 300, 6000)] * 2 + rng.normal(size=(6000, 12)) * 0.7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    base = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(True).alias("q"))
    tree = ann.plant(base, 6000, 12, 3000, 0.97, 10, 32, 8)
    assert (tree.parts, tree.subs, len(tree.below)) == (8, 8, 8) and all(tree.below.values()) and tree.leaf_probes < 48
    got = ann.search(df, F.col("vec_id") % 100 == 0, sample=3000, rows_a_part=32, fan=8).toPandas()
    assert sorted(got.groupby("query_id").size().tolist()) == [10] * 60
    d = np.sqrt(((x[::100, None] - x[None]) ** 2).sum(2))
    d[np.arange(60), np.arange(60) * 100] = np.inf
    best = np.argsort(d, axis=1)[:, :10]
    hit = sum(len(set(best[q // 100]) & set(g["vec_id"])) for q, g in got.groupby("query_id"))
    assert hit >= 0.9 * 600


def test_neighbours_of_thin_parts(spark):
    """A query whose parts hold fewer than ten rows meets all parts."""
    rng = np.random.default_rng(10)
    data = [(i + 1, [float(x) for x in rng.normal(size=2) * 0.1]) for i in range(600)] + [(0, [50.0, 50.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") == 0, rows_a_part=4, aim=0.0).collect()
    assert sorted(r.rank for r in got) == list(range(1, 11))


def test_neighbours_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (100, [0.0, 2.0]), (None, [1.0, 1.0]), (9, []), (2, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (0, 4, 100)]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# --- queries and pipeline ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str(list(r)) for r in found.fetchall())


def test_pipeline(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), "doc_id text lang source n_chars".split()
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, seen, SF).write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
        assert seen.columns == columns and seen.count() > 0
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= {r.doc_id for r in seen.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in seen.collect()}
    assert all(hashlib.md5(r.text.encode()).digest() == hashlib.md5(texts[r.doc_id].encode()).digest() for r in out.collect())


def test_pipeline_stages_on_hard_rows(docs, spark, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}"))
        stage(spark, empty(spark), SF).write.parquet(str(tmp_path / f"e{k}"))
