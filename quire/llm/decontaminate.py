"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams meets every document window.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A benchmark item gives
its windows of ``n`` consecutive words; an item of fewer words, but not none, is one window of its own length.
Every document window is hashed, the hash is looked up in the broadcast set, and a hit counts only after its
words equal the item's. The windows are broadcast in blocks of at most ``max_windows``: a larger benchmark is
scanned block after block; each scan writes the hits of the distinct texts that have any, and its broadcast is
removed before the next, so one block at a time is in memory whatever the benchmark's size.

Cases: a null or empty text has no words and is clean. An item that is null or empty has no windows. Repeated
items and rows count once per distinct ``item_id``; a null ``item_id`` reads as the empty string. Empty tables
give empty results, or clean documents. Extra columns pass through; one named like an output is renamed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat

N = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OUTPUTS = ("n_words", "hits", "items")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; null as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def benchmark_windows(benchmark: DataFrame, n: int = N, text: str = "text", item: str = "item_id") -> DataFrame:
    """Distinct (gram, size, item): the windows of every benchmark item, words joined by one space."""
    benchmark = flat.unclash(benchmark, ())
    w = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
        F.regexp_extract_all(lowered(F.col(text)), F.lit(WORD), F.lit(0)).alias("w"),
    ).filter(F.size("w") > 0)
    w = w.withColumn("size", F.least(F.lit(n), F.size("w")))
    return (
        w.select("item", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("i"))
        .select(F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("gram"), "size", "item")
        .distinct()
    )


class _Windows:
    """One block of benchmark windows, by hash."""

    def __init__(self, rows: list[tuple[bytes, int, str]]):
        grams = [g for g, _, _ in rows]
        data = np.frombuffer(b"".join(grams), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int64)
        starts, ends, doc = flat.words(data, offs, flat.ALNUM)
        code = flat.span_hash(flat.prefix(data), starts, ends)
        first = np.searchsorted(doc, np.arange(len(rows)))
        self.by: dict[int, dict[int, list[tuple[bytes, str]]]] = {}
        for k, (gram, size, item) in enumerate(rows):
            h = int(flat.gram_hash(code[first[k] : first[k] + size], size)[0])
            self.by.setdefault(size, {}).setdefault(h, []).append((gram, item))

    def tables(self):
        """Per window size: the sorted hashes, and a bitmap of their leading bits that refuses most windows."""
        out = []
        for size, by in self.by.items():
            keys = np.array(sorted(by), np.uint64)
            bits = np.zeros(1 << 22, bool)
            bits[(keys >> np.uint64(42)).astype(np.int64)] = True
            out.append((size, by, keys, bits))
        return out


def _kernel(windows):
    tables = windows.value.tables()

    def work(data, offs):
        n = len(offs) - 1
        data = flat.LOWER[data]
        starts, ends, doc = flat.words(data, offs, flat.ALNUM)
        code = flat.span_hash(flat.prefix(data), starts, ends)
        cover, items = np.zeros(len(starts) + 1, np.int32), [set() for _ in range(n)]
        for size, by, keys, bits in tables:
            h = flat.gram_hash(code, size)
            at = np.flatnonzero(bits[(h >> np.uint64(42)).astype(np.int64)])
            at = at[doc[at] == doc[at + size - 1]]
            at = at[keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]]
            for i in at.tolist():
                gram = b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + size], ends[i : i + size]))
                found = [item for g, item in by[int(h[i])] if g == gram]
                if found:
                    items[doc[i]].update(found)
                    cover[i] += 1
                    cover[i + size] -= 1
        hit = np.cumsum(cover)[:-1] > 0
        # Maximal runs of hit words in one document, as byte spans of the text.
        begin = hit.copy()
        begin[1:] &= ~(hit[:-1] & (doc[1:] == doc[:-1]))
        end = hit.copy()
        end[:-1] &= ~(hit[1:] & (doc[1:] == doc[:-1]))
        b, e = np.flatnonzero(begin), np.flatnonzero(end)
        own = offs[doc[b]]
        spans = pa.StructArray.from_arrays(
            [pa.array(starts[b] - own, pa.int64()), pa.array(ends[e] - own, pa.int64()), pa.array(e - b + 1, pa.int64())],
            fields=[pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False), pa.field("n_words", pa.int64(), False)],
        )
        return [
            pa.array(flat.per_doc(doc, n).astype(np.int64), pa.int64()),
            flat.lists(spans, flat.per_doc(doc[b], n).astype(np.int64)),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        ]

    return work


_SPAN = T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "end", "n_words")])
_FIELDS = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("hits", T.ArrayType(_SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text", item_text: str = "text",
    item: str = "item_id", max_windows: int = 500_000, keep: list[str] | None = None,
) -> DataFrame:
    """Documents with ``n_words``, ``hits`` (byte spans of hit word runs, with their words) and ``items``
    (sorted ids, as strings, of the benchmark items that occur).

    With more than ``max_windows`` windows the scan runs once for each block of them; the blocks' spans meet by the
    hash of the text, are merged, and return to the documents by an equi-join with one row a text."""
    spark = docs.sparkSession
    docs = flat.unclash(docs, (*OUTPUTS, "__k1", "__k2", "__h", "__i"))
    grams = benchmark_windows(benchmark, n, item_text, item)
    keep = docs.columns if keep is None else keep
    total = grams.count()
    if total <= max_windows:
        return flat.map_texts(docs, text, _FIELDS, _scan(spark, grams)[1], keep)
    blocks = -(-2 * total // max_windows)
    grams = flat.saved(grams.withColumn("block", F.pmod(F.xxhash64("gram", "item"), F.lit(blocks))))
    body = docs.select(*flat.text_key(F.col(text)), F.col(text).alias("t"))
    parts = []
    for k in range(blocks):
        held, kernel = _scan(spark, grams.filter(F.col("block") == k))
        found = flat.map_texts(body, "t", _FIELDS, kernel, ["k1", "k2"]).filter(F.size("hits") > 0)
        parts.append(flat.saved(found.groupBy("k1", "k2").agg(F.first("hits").alias("hits"), F.first("items").alias("items"))))
        held.destroy()
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    both = both.groupBy("k1", "k2").agg(F.flatten(F.collect_list("hits")).alias("__h"), F.flatten(F.collect_list("items")).alias("__i"))
    joined = docs.select(*[f"`{c}`" for c in {**dict.fromkeys(keep), text: None}], *[k.alias(f"__{k_}") for k, k_ in zip(flat.text_key(F.col(text)), ("k1", "k2"))])
    joined = joined.join(both.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left")
    none = F.array()
    return joined.select(
        *[f"`{c}`" for c in keep], F.coalesce(F.regexp_count(lowered(F.col(text)), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        _merged(F.coalesce("__h", none.cast(_FIELDS[1].dataType))).alias("hits"),
        F.array_sort(F.array_distinct(F.coalesce("__i", none.cast("array<string>")))).alias("items"),
    )


def _scan(spark, grams: DataFrame):
    """(broadcast, kernel) of some windows."""
    rows = [(r.gram.encode(), r.size, r.item) for r in grams.select("gram", "size", "item").collect()]
    held = spark.sparkContext.broadcast(_Windows(rows))
    return held, lambda: _kernel(held)


def _merged(spans: Column) -> Column:
    """Union of spans from several blocks. Words per merged span are recounted by ``hit_words``."""
    item = "struct<start:bigint,end:bigint,n_words:bigint>"

    def add(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.lit(-1).cast("bigint").alias("n_words"))
        over = (F.size(acc) > 0) & F.coalesce(F.try_element_at(acc, F.lit(-1))["end"] > x["start"], F.lit(False))
        return F.when(over, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{item}>"), add)


def hit_words(text: Column, hits: Column) -> Column:
    """Number of words in the hit spans; spans merged from several blocks are counted in the text."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    inside = lambda s: F.decode(F.substring(raw, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), "UTF-8")
    count = lambda s: F.when(s["n_words"] >= 0, s["n_words"]).otherwise(F.regexp_count(lowered(inside(s)), F.lit(WORD)).cast("bigint"))
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, s: a + count(s))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """The documents' own columns without contamination: ``remove="documents"`` drops a document with any hit,
    ``remove="spans"`` cuts the hit spans out of its text (and drops what has no word left)."""
    columns, text = docs.columns, options.get("text", "text")
    found = contamination(docs, benchmark, **options)
    renamed = found.columns[: len(columns)]
    if remove == "documents":
        return found.filter(F.size("hits") == 0).select(*renamed).toDF(*columns)
    raw = F.encode(F.col(text), "UTF-8")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("hits")),
        lambda k: F.substring(
            raw,
            F.coalesce(F.get(F.col("hits"), k - 1)["end"], F.lit(0)).cast("int") + 1,
            (F.coalesce(F.get(F.col("hits"), k)["start"], F.octet_length(raw)) - F.coalesce(F.get(F.col("hits"), k - 1)["end"], F.lit(0))).cast("int"),
        ),
    )
    left = F.aggregate(pieces, F.lit(b""), lambda a, x: F.concat(a, x))
    clean = F.when(F.size("hits") > 0, F.decode(left, "UTF-8")).otherwise(F.col(text))
    out = found.withColumn(text, clean).filter((F.size("hits") == 0) | (F.regexp_count(lowered(F.col(text)), F.lit(WORD)) > 0))
    return out.select(*renamed).toDF(*columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    windows = benchmark_windows(benchmark).count()
    found = contamination(docs, benchmark, keep=["doc_id"] if windows <= 500_000 else None)
    hits = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, s: a + s["n_words"]) if windows <= 500_000 else hit_words(F.col("text"), F.col("hits"))
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH it AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (
    SELECT item, w, least({N}, len(w)) AS n, unnest(range(0, len(w) - least({N}, len(w)) + 1)) AS i FROM it WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
dg AS (
  SELECT rid, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (
    SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, n, i, item FROM dg JOIN win USING (n, g)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN its USING (rid)
"""
