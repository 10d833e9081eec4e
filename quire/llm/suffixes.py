"""Exact repeated substrings by suffix sorting, and their removal.

A byte is removed when a string of ``size`` bytes that covers it also starts anywhere else. Texts are UTF-8 bytes
(null: empty); strings never cross texts and are judged on the input.

Suffixes are dealt out by content: the window of ``size`` bytes that starts a suffix has a minimiser (the k-gram of
least hash in it), so equal windows meet under one key. Consecutive windows with one minimiser form a segment.
1. Every segment sends its minimiser, content hash and place. A minimiser seen once is dropped: its windows occur
   once. Equal segments collapse to one representative with its number of copies (map-side first).
2. Where one minimiser has several different segments, the representatives' bytes are fetched and their suffixes
   sorted in two stages: suffixes smaller than their successors are sorted directly, all others are induced from
   them by scanning the buckets of first bytes in order. Adjacent common prefixes of ``size`` bytes mark repeats;
   a collapsed segment's nearest neighbour is its own copy.
3. Marked windows go back to all places of their segment, are merged in each text, and the text is cut.

A minimiser with more than ``hot`` segments is split by the window's offset from its minimiser (equal windows have
equal offsets). Beyond ``hot * size`` segments every window is a piece of its own, dealt by its content too; such
windows come sorted by their bytes (Spark sorts them, and spills), so repeats are neighbours and one row is held at a
time. So no task holds more than ``CHUNK`` bytes of segments plus one group of at most about ``hot`` segments.

Cases: texts under ``size`` bytes keep all; empty tables give no rows; repeated rows (same id, same text) are copies
of each other, so texts of at least ``size`` bytes go entirely. Extra columns pass through; clashes are renamed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat

SIZE = 200
GRAM = 40
HOT = 4096
CHUNK = 1 << 20


def segments(data: np.ndarray, offs: np.ndarray, size: int = SIZE, gram: int = GRAM):
    """(minimiser hash, content hash, start, run, document, offset of the first window from its minimiser)."""
    n, reach = len(data), size - gram + 1
    if n < size:
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 4
    sums = flat.prefix(data)
    inverse = flat._powers(n)[1]
    hashes = flat.mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    count = n - size + 1
    low = np.minimum(low[:count], low[reach - span : reach - span + count])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(count)
    doc = np.searchsorted(offs, starts, "right") - 1
    inside = starts + size <= offs[doc + 1]
    new = np.ones(count, bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    # A run ends before the next new window or the first one that leaves its text.
    stop = np.append(np.flatnonzero(new | ~inside), count)
    run = stop[np.searchsorted(stop, first, "right")] - first
    content = flat.span_hash(sums, first, first + run + size - 1)
    return hashes[place[first]], content, first - offs[doc[first]], run, doc[first], place[first] - first


def sort_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions in the order of their suffixes' first ``depth`` bytes, by two-stage sorting. The text
    must end in 0xFF, which no UTF-8 text holds."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    step = np.append(step, -1)  # the last suffix is larger than what follows it
    settled = np.where(step != 0, np.arange(n), n)
    settled = np.minimum.accumulate(settled[::-1])[::-1]
    smaller = step[settled] > 0
    # A suffix that is induced needs its successors up to the first that is sorted directly.
    ready = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 1)[::-1])[::-1]
    need = np.zeros(n + 1, np.int32)
    np.add.at(need, np.flatnonzero(wanted), 1)
    np.add.at(need, ready[wanted] + 1, -1)
    need = np.cumsum(need)[:-1] > 0
    raw = text.tobytes()
    direct = sorted(np.flatnonzero(need & smaller).tolist(), key=lambda i: raw[i : i + depth])
    direct = np.array(direct, np.int64)
    bounds = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, int)
    induced = need & ~smaller
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        waves, wave = [], np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[induced[before] & (text[before] == c)]
        bucket = np.concatenate([*waves, direct[bounds[c] : bounds[c + 1]]])
        pending[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        if len(before):
            order = np.argsort(text[before], kind="stable")
            before = before[order]
            edges = np.flatnonzero(np.diff(text[before])) + 1
            for part in np.split(before, edges):
                pending[text[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefix_reaches(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the suffixes at a and b share their first ``size`` bytes (compared eight at a time)."""
    words = np.ndarray((len(text) - 7,), np.uint64, np.ascontiguousarray(text), strides=(1,))
    same = np.arange(len(a))
    for at in [*range(0, size - 8, 8), size - 8]:
        same = same[words[a[same] + at] == words[b[same] + at]]
    out = np.zeros(len(a), bool)
    out[same] = True
    return out


def repeated_windows(contents: list[bytes], runs: np.ndarray, size: int = SIZE) -> np.ndarray:
    """For the windows of all segments, one segment after the other: does another window equal it?"""
    data = np.frombuffer(b"\xff".join(contents) + b"\xff" * 9, np.uint8)
    sizes = np.array([len(c) + 1 for c in contents])
    begin = np.cumsum(sizes) - sizes
    base = np.cumsum(runs) - runs
    windows = np.arange(runs.sum()) - np.repeat(base, runs) + np.repeat(begin, runs)
    wanted = np.zeros(len(data) - 8, bool)
    wanted[windows] = True
    order = sort_suffixes(data[:-8], wanted, size)
    order = order[wanted[order]]
    equal = common_prefix_reaches(data, order[:-1], order[1:], size) if len(order) > 1 else np.zeros(0, bool)
    marked = np.zeros(len(data), bool)
    marked[order[:-1][equal]] = True
    marked[order[1:][equal]] = True
    return marked[windows]


def _runs(marks: np.ndarray):
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


_PLACES = "mh long, ch long, k1 long, k2 long, loc long"  # loc: start * 256 + run


def _places(size: int, gram: int):
    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, data, offs in flat.text_blocks(batch.column(2), flat.SMALL_BLOCK):
                mh, ch, start, count, doc, _ = segments(data, offs, size, gram)
                if len(mh):
                    rows = [mh.view(np.int64), ch.view(np.int64), k1[lo + doc], k2[lo + doc], start * 256 + count]
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["mh", "ch", "k1", "k2", "loc"])

    return run


def _fetch(size: int, hot: int):
    """Bytes of the representatives of a text; a hot minimiser's segment in pieces by the window's offset."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, picks in zip(batch.column(0), batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                for p in picks.as_py():
                    start, count = divmod(p["loc"], 256)
                    if p["n"] <= hot:
                        rows.append((p["mh"], p["ch"], 0, 0, p["copies"], raw[start : start + count + size - 1]))
                        continue
                    data = np.frombuffer(raw[start : start + count + size - 1], np.uint8)
                    off = int(segments(data, np.array([0, len(data)]), size)[5][0])
                    if p["n"] > hot * size:  # one window a row: the piece is negative and says offset and content
                        deal = int(-(-p["n"] // (hot * size)))
                        sums = flat.prefix(data)
                        codes = flat.span_hash(sums, np.arange(count), np.arange(count) + size) % np.uint64(deal)
                        for k, code in enumerate(codes.tolist()):
                            rows.append((p["mh"], p["ch"], -1 - (off - k) - size * code, k, p["copies"], raw[start + k : start + k + size]))
                        continue
                    parts = int(min(size, -(-p["n"] // hot)))
                    each = -(-size // parts)
                    k = 0
                    while k < count:  # windows k.. share a piece while their offsets (off - k) do
                        piece = (off - k) // each
                        stop = min(count, off - piece * each + 1)
                        rows.append((p["mh"], p["ch"], piece + 1, k, p["copies"], raw[start + k : start + stop + size - 1]))
                        k = stop
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["mh", "ch", "piece", "at", "copies", "bytes"])

    return run


def _mark(size: int):
    """Sort the suffixes of a partition's segments (in order of mh, piece), group after group, about CHUNK bytes at
    a time; emit the marked windows of each segment. Single windows (piece < 0) come in order of their bytes."""

    def emit(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["mh", "ch", "a", "b"])

    def flush(held):
        contents = [h[4] for h in held]
        runs = np.array([len(c) - size + 1 for c in contents])
        marks = repeated_windows(contents, runs, size)
        rows, at = [], 0
        for (mh, ch, first, copies, _), run in zip(held, runs):
            own = marks[at : at + run]
            at += run
            if copies > 1:
                own = np.ones(run, bool)
            for a, b in zip(*_runs(own)):
                rows.append((mh, ch, first + int(a), first + int(b)))
        if rows:
            yield emit(rows)

    def run(batches):
        held, total, group = [], 0, None
        last, marked = None, True  # the window before, and whether it was emitted
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            single = []
            for mh, ch, piece, first, copies, raw in zip(*cols):
                if piece < 0:
                    same = last is not None and last[:2] == (mh, raw)
                    if same and not marked:
                        single.append((mh, *last[2:]))
                    marked = same or copies > 1
                    if marked:
                        single.append((mh, ch, first, first + 1))
                    last = mh, raw, ch, first, first + 1
                    continue
                if (mh, piece) != group:
                    if total >= CHUNK:
                        yield from flush(held)
                        held, total = [], 0
                    group = (mh, piece)
                held.append((mh, ch, first, copies, raw))
                total += len(raw)
            if single:
                yield emit(single)
        if held:
            yield from flush(held)

    return run


_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))


def repeated_spans(docs: DataFrame, text: str = "text", size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(k1, k2, spans): for each distinct text with repeats, by ``flat.text_key``, the byte spans [s, e) of its
    repeated windows (sorted, they may overlap)."""
    keyed = docs.select(*flat.text_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("t")).filter(F.octet_length("t") >= size)
    places = keyed.mapInArrow(flat.tidy(_places(size, gram)), _PLACES)
    shared = places.groupBy("mh").agg(F.count("*").alias("n"), (F.min("ch") == F.max("ch")).alias("alike")).filter("n > 1")
    shared = flat.saved(shared)  # a side of its own, so that adaptive execution can split a hot minimiser of the other
    found = flat.saved(places.join(shared, "mh"))
    alike = found.filter("alike").select("k1", "k2", F.expr("loc div 256").alias("s"), (F.expr("loc div 256") + F.col("loc") % 256 + (size - 1)).alias("e"))
    mixed = found.filter("not alike")
    picks = mixed.groupBy("mh", "ch").agg(F.count("*").alias("copies"), F.max("n").alias("n"), F.min(F.struct("k1", "k2", "loc")).alias("r"))
    picks = picks.groupBy("r.k1", "r.k2").agg(F.collect_list(F.struct("mh", "ch", "copies", "n", "r.loc")).alias("picks"))
    one = keyed.groupBy("k1", "k2").agg(F.first("t").alias("t"))
    sent = one.join(picks, ["k1", "k2"]).select(F.col("t").cast("binary").alias("t"), "picks").mapInArrow(
        flat.tidy(_fetch(size, hot)), "mh long, ch long, piece long, at long, copies long, bytes binary"
    )
    order = ["mh", "piece", F.when(F.col("piece") < 0, F.col("bytes"))]
    marks = sent.repartition("mh", "piece").sortWithinPartitions(*order).mapInArrow(flat.tidy(_mark(size)), "mh long, ch long, a long, b long")
    start = F.expr("loc div 256")
    several = mixed.join(marks, ["mh", "ch"]).select("k1", "k2", (start + F.col("a")).alias("s"), (start + F.col("b") + (size - 1)).alias("e"))
    return alike.unionByName(several).distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


def _covered(data, offs, lists_: pa.Array):
    """Mask of the bytes that the rows' spans cover."""
    counts = np.diff(np.asarray(lists_.offsets, np.int64))
    values = lists_.flatten()
    own = np.repeat(offs[:-1], counts)
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, values.field("s").to_numpy() + own, 1)
    np.add.at(cover, values.field("e").to_numpy() + own, -1)
    return np.cumsum(cover)[:-1] > 0


def _whole(data: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mask with every character that it covers in part covered entirely (texts are UTF-8, which starts anew in
    every text)."""
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    hit = np.zeros(char[-1] + 1 if len(char) else 0, bool)
    hit[char[mask]] = True
    return hit[char]


def without_repeats(docs: DataFrame, text: str = "text", whole: bool = False, **options) -> DataFrame:
    """The documents with ``removed``, the byte spans cut out (maximal, sorted), and ``kept``, the bytes that are left
    (binary); with ``whole``, characters that a cut would split go entirely. Texts meet their spans by an equi-join whose span side has one row for each distinct text."""
    docs = flat.unclash(docs, ("k1", "k2", "spans", "removed", "kept"))
    spans = repeated_spans(docs, text, **options)
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    joined = docs.select("*", *flat.text_key(F.col(text))).join(spans, ["k1", "k2"], "left").select(
        *[f"`{c}`" for c in docs.columns], F.coalesce("spans", none).alias("spans")
    )
    at, last = docs.columns.index(text), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("removed", _SPANS), T.StructField("kept", T.BinaryType())])

    def run(batches):
        for batch in batches:
            gone, left = [], []
            for lo, data, offs in flat.text_blocks(batch.column(at), flat.SMALL_BLOCK):
                mask = _covered(data, offs, batch.column(last).slice(lo, len(offs) - 1))
                mask = _whole(data, mask) if whole else mask
                begin, end = mask.copy(), mask.copy()
                inner = np.zeros(len(data), bool)  # the byte before belongs to the same text
                inner[1:] = True
                inner[offs[:-1][offs[:-1] < offs[1:]]] = False
                begin[1:] &= ~(mask[:-1] & inner[1:])
                end[:-1] &= ~(mask[1:] & inner[1:])
                b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
                doc = np.searchsorted(offs, b, "right") - 1
                pairs = pa.StructArray.from_arrays([pa.array(b - offs[doc]), pa.array(e - offs[doc])], names=["s", "e"])
                gone.append(flat.lists(pairs, flat.per_doc(doc, len(offs) - 1).astype(np.int64)))
                left.append(flat.binary_array(*flat.cut(data, offs, ~mask)))
            if gone:
                yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.concat_arrays(gone), pa.concat_arrays(left)], schema=None, names=[f.name for f in schema])

    return joined.mapInArrow(flat.tidy(run), schema)


def dedup_spans(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents' own columns, their texts without repeated spans (a character cut in half goes entirely).
    Documents without any repeat stay as they are; one of which nothing is left is dropped."""
    columns = docs.columns
    found = without_repeats(docs, text, whole=True, **options)
    at = found.columns[columns.index(text)]
    clean = F.when(F.size("removed") == 0, F.col(at)).otherwise(F.col("kept").cast("string"))
    out = found.filter((F.size("removed") == 0) | (F.octet_length("kept") > 0)).withColumn(at, clean)
    return out.select(*[f"`{c}`" for c in found.columns[: len(columns)]]).toDF(*columns)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = without_repeats(docs)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    return found.select(
        "doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(texts: list[str | None], size: int = SIZE) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) for small inputs, by counting every string."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - size + 1):
            seen[r[i : i + size]] = seen.get(r[i : i + size], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), bytes(gone).count(b"\0\1") + (gone[:1] == b"\1"), hashlib.sha256(kept).hexdigest()))
    return out
