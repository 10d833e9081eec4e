"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often each pair does.

Space and text are encoded by vocabulary A (a byte-level BPE) and the text by B (pieces with byte fallback, which adds the
space itself). Byte offsets where a token of both ends cut the tokens into groups; the pair of tokens that end there is a
link. A pair is one packed int64 (B's id above A's). Each partition counts its pairs by ``np.unique``; the partial counts
are range-partitioned and sorted, equal keys being neighbours then, and summed by run length; every range is a shard, a flat
file of sorted keys and counts in the shared folder. Look-ups map the shards into memory and find keys by ``searchsorted``,
so a corpus's table is never built in one process and its pages are shared by the workers of a machine.

Texts are cut before single spaces between characters that are no white space. No token of either vocabulary crosses such
a place (checked for B's pieces when they are loaded; A's splitting pattern starts there), so the pieces are encoded for
themselves and a worker keeps the alignment of those it has met, up to ``KEPT`` bytes; what is kept changes no result.

Cases: null and empty texts, and texts whose tokens do not spell space and text again (B reads U+2581 as a space;
characters that are not UTF-8 are replaced), have no tokens: zeros, '' and no pairs. The strings of special tokens in a
text are plain text. Very long texts are encoded piece by piece. Repeated rows keep a row each and count each. A pair
that holds a third of all links is one row of each partial count. Empty tables give empty tables. Extra columns pass
through; clashing names are renamed. All highest counts of a B id, ties included, are its best.
"""

from __future__ import annotations

import collections
import hashlib
import itertools
import json
import os
import re
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how A cuts texts before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters from which a piece is encoded by the library whose time does not grow with their square.
LONG_PIECE = 256
#: Bytes, about, of aligned pieces that a worker keeps.
KEPT = 48 << 20
#: Distinct pairs that a partition holds before it hands partial counts on.
PARTIAL = 1 << 20
#: Partial counts that one shard is made of, about.
SHARD_ROWS = 1 << 22
#: Ids of B that there may be: the table of their highest counts is sent to all tasks.
MOST_IDS = 1 << 20
_CUT = re.compile(r" (?<=[^\s\u180e] )(?=[^\s\u180e])")
FIELDS = [
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("pair_links", T.ArrayType(T.LongType())),
]
GROUPS = T.StructField("groups", T.StringType())


def byte_letters() -> dict[str, int]:
    """The bytes behind the letters of a byte-level vocabulary: printable bytes are themselves, the others follow from
    U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both vocabularies, and the alignments of the pieces met so far."""

    def __init__(self, a_file: str = A_FILE, b_file: str = B_FILE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel workers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        with open(a_file, encoding="utf-8") as file:
            known = json.load(file)
        a_bytes = {i: bytes(letters[c] for c in s) for s, i in known["model"]["vocab"].items() if all(c in letters for c in s)}
        # The same vocabulary, its ids being its ranks: faster for short pieces, slower for very long ones.
        self.short = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={v: k for k, v in a_bytes.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        spelled = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace("\u2581", " ").encode() for i, s in enumerate(spelled)]
        if any("\u2581" in s.lstrip("\u2581") for s in spelled):
            raise ValueError("a piece holds a space behind another character: texts cannot be cut at spaces")
        self.a_spell, self.b_spell = Spelling([a_bytes.get(i, b"") for i in range(max(a_bytes) + 2)]), Spelling(b_bytes)
        # What an id writes into the groups: its digits and a mark, by id, vocabulary and whether it ends a group.
        self.written = Spelling([f"{i}{mark}".encode() for size, marks in ((len(self.a_spell), ",|"), (len(self.b_spell), ",;")) for mark in marks for i in range(size)])
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.counts, self.keys, self.codes = Rows(), Rows(), Rows()
        self.held = 0

    def _ids(self, piece: str) -> list[int]:
        if len(piece) > LONG_PIECE:
            return self.a.encode(f" {piece}", add_special_tokens=False).ids
        return self.short.encode_ordinary(f" {piece}")

    def learn(self, pieces: list[str]) -> None:
        """Aligns pieces that were not met yet, all at once: their bytes stand one after another, a token's end is its
        place among them, and ends that both vocabularies have are found by one look-up."""
        n = len(pieces)
        whole = [f" {p}".encode() for p in pieces]
        size = np.fromiter(map(len, whole), np.int64, n)
        (a, a_many), (b, b_many) = (flattened(found) for found in (list(map(self._ids, pieces)), self.b.encode(pieces, num_threads=1)))
        fine, text = np.ones(n, bool), np.frombuffer(b"".join(whole), np.uint8)
        for ids, many, spell in ((a, a_many, self.a_spell), (b, b_many, self.b_spell)):
            fine &= per_piece(spell.size[ids], many) == size
        ok_a, ok_b = np.repeat(fine, a_many), np.repeat(fine, b_many)
        for ids, ok, spell in ((a, ok_a, self.a_spell), (b, ok_b, self.b_spell)):
            wrong = spell.join(ids[ok]) != text[np.repeat(fine, size)]
            if wrong.any():  # rare: characters that B reads as others of the same length
                fine[np.flatnonzero(fine)[np.unique(np.searchsorted(np.cumsum(size[fine]), np.flatnonzero(wrong), "right"))]] = False
                ok_a, ok_b = np.repeat(fine, a_many), np.repeat(fine, b_many)
        a, b, a_many, b_many = a[ok_a], b[ok_b], np.where(fine, a_many, 0), np.where(fine, b_many, 0)
        a_end, b_end = np.cumsum(self.a_spell.size[a]), np.cumsum(self.b_spell.size[b])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[np.searchsorted(a_end, both)] = b_last[np.searchsorted(b_end, both)] = True
        groups = per_piece(a_last, a_many)
        # Group by group, A's ids before B's.
        na, nb = len(self.a_spell), len(self.b_spell)
        codes = np.concatenate([a + na * a_last, 2 * na + b + nb * b_last]).astype(np.int32)
        group = np.concatenate([np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last])
        self.codes.add(codes[np.argsort(group, kind="stable")], a_many + b_many)
        self.keys.add(b[b_last] << 32 | a[a_last], groups)
        self.counts.add(np.stack([fine, a_many, b_many, groups], 1).astype(np.int64), np.ones(n, np.int64))
        for piece in pieces:
            self.number[piece] = len(self.number)
        self.held += 200 * n + 2 * len(text) + 4 * len(codes) + 8 * int(groups.sum())

    def align(self, texts: list[str | None]):
        """For each text (counts of A, of B, of groups; groups as text; distinct keys; links of each key), or None."""
        if self.held > KEPT:
            self.forget()
        cut = [_CUT.split(t) if t else [] for t in texts]
        new = list({p for pieces in cut for p in pieces if p not in self.number})
        for lo in range(0, len(new), 8192):
            self.learn(new[lo : lo + 8192])
        out, counts = [], self.counts.values
        for pieces in cut:
            at = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
            found = counts[at] if len(at) else None
            if found is None or not found[:, 0].all():
                out.append(None)
                continue
            once, many = np.unique(at, return_counts=True)
            keys, size = self.keys.take(once)
            pairs, links = summed(keys, np.repeat(many, size))
            out.append((*found[:, 1:].sum(0).tolist(), self.written.join(self.codes.take(at)[0]).tobytes()[:-1], pairs, links))
        return out


class Spelling:
    """Byte strings by id, in one buffer."""

    def __init__(self, strings: list[bytes]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def __len__(self) -> int:
        return len(self.size)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return self.data[places(self.start[ids], self.size[ids])]


class Rows:
    """Runs of values, one a number, in arrays that grow by doubling."""

    def __init__(self):
        self.values, self.ends, self._rows, self._many = None, np.zeros(1, np.int64), 0, 0

    def add(self, values: np.ndarray, many: np.ndarray) -> None:
        if self.values is None:
            self.values = np.zeros((0, *values.shape[1:]), values.dtype)
        self.values = self._grown(self.values, self._rows, values)
        self.ends = self._grown(self.ends, self._many + 1, self._rows + np.cumsum(many))
        self._rows, self._many = self._rows + len(values), self._many + len(many)

    @staticmethod
    def _grown(held: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
        if used + len(new) > len(held):
            held = np.concatenate([held[:used], np.zeros((used + 2 * len(new), *held.shape[1:]), held.dtype)])
        held[used : used + len(new)] = new
        return held

    def take(self, numbers: np.ndarray):
        """(the values of these runs one after another, how many each has)."""
        start = self.ends[numbers]
        size = self.ends[numbers + 1] - start
        return self.values[places(start, size)], size


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def per_piece(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The sum of each run of ``many`` values."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(many)
    return sums[ends] - sums[ends - many]


def flattened(lists: list[list[int]]):
    many = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(many.sum())), many


def summed(keys: np.ndarray, counts: np.ndarray):
    """Distinct keys, sorted, and the sum of each one's counts."""
    keys, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, counts)
    return keys, total


def encode(df: DataFrame, text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, groups: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The rows (of them the columns ``keep``, if named) with ``FIELDS``: numbers of tokens, groups and links, the groups' digest, the text's distinct pairs and the
    links of each; and, if asked for, ``groups`` themselves (`a1,a2|b1;a3|b2,b3`)."""
    fields = FIELDS + [GROUPS] * groups
    df = flat.unclash(df, [*(f.name for f in fields), "_text"])
    flat.shared_folder(df.sparkSession)
    keep = df.columns if keep is None else keep
    binary = df.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").cast("binary").alias("_text"))  # need not be UTF-8
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches):
        aligner = Aligner(a_file, b_file)
        for batch in batches:
            for lo, data, offs in flat.text_blocks(batch.column(len(keep))):
                whole = data.tobytes()
                texts = [whole[offs[i] : offs[i + 1]].decode("utf-8", "replace") for i in range(len(offs) - 1)]
                bad = [t.encode() != whole[offs[i] : offs[i + 1]] if "\ufffd" in t else False for i, t in enumerate(texts)]
                found = aligner.align([None if b else t for t, b in zip(texts, bad)])
                columns = batch.slice(lo, len(texts)).columns[:-1]
                numbers = np.array([[0] * 3 if f is None else f[:3] for f in found], np.int64).reshape(-1, 3)
                many = np.array([0 if f is None else len(f[4]) for f in found], np.int64)
                joined = [np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found if f is not None)]) for k in (4, 5)]
                columns += [pa.array(numbers[:, k]) for k in (0, 1, 2, 2)]  # every group ends with one link
                columns.append(pa.array(["" if f is None else hashlib.sha256(f[3]).hexdigest() for f in found], pa.string()))
                columns += [flat.lists(pa.array(j), many) for j in joined]
                if groups:
                    columns.append(pa.array(["" if f is None else f[3].decode() for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return binary.mapInArrow(flat.tidy(run), schema)


def partial_counts(encoded: DataFrame) -> DataFrame:
    """(key, links): the pairs of each partition, counted by ``np.unique``; a key may stand once a partition and once more
    for every ``PARTIAL`` others."""

    def run(batches):
        keys, links, held = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).flatten().to_numpy())
            links.append(batch.column(1).flatten().to_numpy())
            held += len(keys[-1])
            if held > 2 * PARTIAL:
                k, n = summed(np.concatenate(keys), np.concatenate(links))
                if len(k) > PARTIAL:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "links"])
                    k, n = k[:0], n[:0]
                keys, links, held = [k], [n], len(k)
        if held:
            k, n = summed(np.concatenate(keys), np.concatenate(links))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "links"])

    return encoded.select("pairs", "pair_links").mapInArrow(flat.tidy(run), "key long, links long")


def _file_system(uri: str):
    """(file system, path, whether this machine can map its files)."""
    if urlparse(uri).scheme in ("", "file"):
        return arrow_fs.LocalFileSystem(), urlparse(uri).path, True
    return *arrow_fs.FileSystem.from_uri(uri), False


class Shards:
    """The sorted shards: their names, first to last, and the last key of each. Goes to the workers by pickling."""

    def __init__(self, folder: str, names: list[str], last: np.ndarray):
        self.folder, self.names, self.last = folder, names, last
        self._open: collections.OrderedDict = collections.OrderedDict()

    def __getstate__(self):
        return {"folder": self.folder, "names": self.names, "last": self.last, "_open": collections.OrderedDict()}

    def shard(self, k: int) -> np.ndarray:
        """Keys and counts of shard k: mapped where the folder is a file system of the machine, read otherwise, a few
        at a time."""
        if k in self._open:
            self._open.move_to_end(k)
        else:
            system, path, here = _file_system(f"{self.folder}/{self.names[k]}")
            if here:
                held = np.memmap(path, "<i8", "r")
            else:
                with system.open_input_file(path) as file:
                    held = np.frombuffer(file.read_buffer(), "<i8")
            self._open[k] = held.reshape(2, -1)
            while len(self._open) > (1024 if here else 4):
                self._open.popitem(last=False)
        return self._open[k]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of every one of the sorted keys; 0 where there is none."""
        out = np.zeros(len(keys), np.int64)
        if not self.names:
            return out
        which = np.searchsorted(self.last, keys)
        for k in np.unique(which[which < len(self.names)]).tolist():
            lo, hi = np.searchsorted(which, [k, k + 1])
            known, links = self.shard(k)
            at = np.minimum(np.searchsorted(known, keys[lo:hi]), len(known) - 1)
            out[lo:hi] = np.where(known[at] == keys[lo:hi], links[at], 0)
        return out


class PairTable:
    """A corpus's counts: ``shards``, and ``best``, the highest count of every B id."""

    def __init__(self, shards: Shards, best: np.ndarray):
        self.shards, self.best = shards, best

    def frame(self, spark: SparkSession) -> DataFrame:
        """(a_id, b_id, links, best): a row a pair, read from the shards, one task a shard."""
        names = spark.sparkContext.broadcast((self.shards, self.best))

        def run(batches):
            shards, best = names.value
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    keys, links = shards.shard(k)
                    for lo in range(0, len(keys), 1 << 16):
                        key, n = keys[lo : lo + (1 << 16)], links[lo : lo + (1 << 16)]
                        columns = [key & 0xFFFFFFFF, key >> 32, n]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n == best[key >> 32])], names=["a_id", "b_id", "links", "best"])

        many = max(1, len(self.shards.names))
        return spark.range(0, len(self.shards.names), 1, many).mapInArrow(run, "a_id long, b_id long, links long, best boolean")


def count_pairs(encoded: DataFrame, shard_rows: int = SHARD_ROWS) -> PairTable:
    """The table of all pairs of ``encode``'s rows (which should be a written table: they are read once here)."""
    spark = encoded.sparkSession
    partial = flat.saved(partial_counts(encoded))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-partial.count() // shard_rows))
    folder = flat.folder(spark)

    def run(batches):
        keys, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # the rows come sorted: runs of equal keys
            total = np.add.reduceat(n, new)
            if len(keys[-1]) and keys[-1][-1] == key[0]:  # a run that began in the batch before
                links[-1][-1] += total[0]
                new, total = new[1:], total[1:]
            if len(new):
                keys.append(key[new])
                links.append(total)
        key, n = np.concatenate(keys), np.concatenate(links)
        if not len(key):
            return
        system, path, _ = _file_system(folder)
        name = uuid.uuid4().hex  # of this attempt: a task that runs again writes a file of its own
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}") as file:
            file.write(np.concatenate([key, n]).astype("<i8").tobytes())
        b = key >> 32
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        row = [[name], [int(key[-1])], [(b[first]).tolist()], [np.maximum.reduceat(n, first).tolist()]]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["name", "last", "b", "best"])

    ranged = partial.repartitionByRange(shards, "key").sortWithinPartitions("key")
    written = flat.saved(ranged.mapInArrow(flat.tidy(run), "name string, last long, b array<long>, best array<long>"))
    names = written.select("name", "last").orderBy("last").collect()  # a row a shard
    pairs = written.select(F.explode(F.arrays_zip("b", "best")).alias("p"))
    found = pairs.groupBy("p.b").agg(F.max("p.best").alias("best")).limit(MOST_IDS + 1).collect()  # a row a B id
    if len(found) > MOST_IDS:
        raise ValueError("vocabulary B has too many ids")
    best = np.zeros(max((r.b for r in found), default=0) + 1, np.int64)
    for r in found:
        best[r.b] = r.best
    return PairTable(Shards(folder, [r.name for r in names], np.array([r["last"] for r in names], np.int64)), best)


def look_up(encoded: DataFrame, table: PairTable) -> DataFrame:
    """``encode``'s rows with ``n_best`` (links whose count is their B id's highest) and ``count_sum`` (over links)."""
    encoded = flat.unclash(encoded, ("n_best", "count_sum"))
    held = encoded.sparkSession.sparkContext.broadcast((table.shards, table.best))  # names of shards, a number a B id
    at, many_at = (encoded.columns.index(c) for c in ("pairs", "pair_links"))
    schema = T.StructType([*encoded.schema, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches):
        shards, best = held.value
        for batch in batches:
            pairs, links = batch.column(at), batch.column(many_at).flatten().to_numpy()
            size = pairs.value_lengths().to_numpy(zero_copy_only=False)
            keys, which = np.unique(pairs.flatten().to_numpy(), return_inverse=True)
            counts = shards.counts(keys)
            top = counts == best[keys >> 32] if len(keys) else np.zeros(0, bool)
            row = np.repeat(np.arange(len(batch)), size)
            sums = [np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)]
            np.add.at(sums[0], row, links * top[which])
            np.add.at(sums[1], row, links * counts[which])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, sums)], names=schema.names)

    return encoded.mapInArrow(flat.tidy(run), schema)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = flat.saved(encode(docs, keep=["doc_id"]))
    found = look_up(encoded, count_pairs(encoded))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
