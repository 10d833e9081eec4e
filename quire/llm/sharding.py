"""Sharding: jump consistent hashing maps stable keys to shards without a ring table.

The shard of a row depends on its key and on the number of shards alone, so any executor finds it without a table and
reruns agree. When shards are appended, a row stays or moves into an appended shard, never between old ones: of n to
n + 1 shards about one row in n + 1 moves. Within a shard every row has a slot, gapless from 0: the narrow rows (keys and
sizes, no texts) are range-partitioned and sorted by key, each partition counts its rows of each shard, and prefix sums
over partitions lift these counts, so no shard is ever ranked by one task.

Cases: a null key counts as the key 0, so rows without one share a shard (a hot key is one shard's by the law, yet its
rows are spread over tasks by a row number, for counting and for writing). Rows whose order columns are equal share their slots
in any order. Null texts have no bytes (checksum 0); empty and very long texts are read by the JVM alone. Repeated rows
keep a row each. Empty tables give empty tables. Extra columns pass through; clashing names are renamed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat

SHARDS = 24
#: Prefix sums of at most so many (partition, shard) pairs are broadcast; more are joined by shuffle.
BROADCAST_PAIRS = 1_000_000
#: Rows that one written file holds at most, about.
ROWS_A_FILE = 1_000_000
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, from 0, of every 64-bit key: each pass leaps to the next number of shards at which a key would move,
    until that is beyond ``shards``. On average a key takes log(shards) passes."""
    if shards < 1:
        raise ValueError("there must be a shard")
    state = keys.astype(np.uint64, copy=True)
    found, at = np.zeros(len(state), np.int64), np.arange(len(state))
    while len(at):
        state = state * _STEP + np.uint64(1)
        leap = ((found[at] + 1) * (float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = leap < shards
        at, state = at[on], state[on]
        found[at] = leap[on]
    return found


def stable_key(df: DataFrame, *columns: str) -> Column:
    """A long from the key columns: one integer column itself, anything else its hash."""
    kinds = {f.name: f.dataType for f in df.schema}
    if len(columns) == 1 and isinstance(kinds[columns[0]], T.IntegralType):
        return F.coalesce(F.col(f"`{columns[0]}`").cast("long"), F.lit(0))
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def shard_of(key: Column, shards: int) -> Column:
    """The shard (int) of a long key. Only the key passes to Python, in Arrow batches."""

    @F.pandas_udf("int")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump(flat.mix(keys.to_numpy(np.int64).view(np.uint64)), shards).astype(np.int32))

    return placed(key)


def assign(df: DataFrame, shards: int = SHARDS, key: tuple[str, ...] = ("doc_id",), grown: int | None = None) -> DataFrame:
    """The rows with ``shard`` and, where ``grown`` names a later number of shards, ``grown_shard``."""
    df = flat.unclash(df, ("shard", "grown_shard"))
    k = stable_key(df, *key)
    out = df.withColumn("shard", shard_of(k, shards))
    return out if grown is None else out.withColumn("grown_shard", shard_of(k, grown))


def slots(assigned: DataFrame, order: tuple[str, ...], partitions: int | None = None) -> DataFrame:
    """The rows of ``assign`` with ``slot`` (long): the number of a row in its shard, gapless from 0, by ``order`` with
    nulls first. Give it narrow rows: they are written twice and shuffled once."""
    spark = assigned.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    assigned = flat.unclash(assigned, ("slot", "_row", "_nth", "_part", "_many", "_lift")).withColumn("_row", F.monotonically_increasing_id())
    names = assigned.columns
    at = names.index("shard")
    # The row number keeps equal rows from meeting in one range; it is fixed by being written.
    by = [*[F.asc_nulls_first(F.col(f"`{c}`")) for c in order], F.asc("_row")]
    ranged = flat.saved(assigned).repartitionByRange(partitions, *by).sortWithinPartitions(*by)

    def number(batches):
        seen, part = np.zeros(0, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            shard = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(shard):
                continue
            many = np.bincount(shard, minlength=len(seen))
            seen = np.append(seen, np.zeros(len(many) - len(seen), np.int64))
            by_shard = np.argsort(shard, kind="stable")
            first = np.cumsum(many) - many
            nth = np.empty(len(shard), np.int64)
            nth[by_shard] = np.arange(len(shard)) - first[shard[by_shard]] + seen[shard[by_shard]]
            seen += many
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth), pa.array(np.full(len(shard), part), pa.int32())], names=[*names, "_nth", "_part"])

    schema = T.StructType([*assigned.schema, T.StructField("_nth", T.LongType()), T.StructField("_part", T.IntegerType())])
    counted = flat.saved(ranged.mapInArrow(number, schema))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = counted.groupBy("shard", "_part").agg((F.max("_nth") + 1).alias("_many"))  # one row a partition and shard
    lifts = flat.saved(held.select("shard", "_part", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_lift")))
    if lifts.count() <= BROADCAST_PAIRS:
        lifts = F.broadcast(lifts)
    keep = [f"`{c}`" for c in names if c != "_row"]
    return counted.join(lifts, ["shard", "_part"]).select(*keep, (F.col("_nth") + F.col("_lift")).alias("slot"))


def write(df: DataFrame, path: str, shards: int = SHARDS, key: tuple[str, ...] = ("doc_id",), rows_a_file: int = ROWS_A_FILE) -> None:
    """Writes the rows as Parquet, a folder ``shard=N`` a shard, each in as many files as its rows need: a shard that
    holds a hot key is written by several tasks."""
    df = assign(flat.unclash(df, ("_row", "_files", "_file")).withColumn("_row", F.monotonically_increasing_id()), shards, key)
    files = F.broadcast(df.groupBy("shard").agg(F.ceil(F.count("*") / rows_a_file).cast("int").alias("_files")))  # a row a shard
    dealt = df.join(files, "shard").withColumn("_file", F.pmod(F.xxhash64("_row"), F.col("_files")))
    dealt.repartition("shard", "_file").drop("_row", "_files", "_file").write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)


def moved(df: DataFrame, shards: int, grown: int, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows that change their shard when ``shards`` become ``grown``, with both: what has to be copied, and no more."""
    return assign(df, shards, key, grown).filter("shard != grown_shard")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    body = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = slots(assign(narrow, SHARDS, ("doc_id",), SHARDS + 1), ("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _times(a: str, b: int) -> str:
    return f"(({a})::UHUGEINT * {b}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


_CRC_TABLE = (
    "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i::UINTEGER, range(8)::UINTEGER[]), "
    "lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END) AS c FROM range(256) r(i)))"
)


def _walk(name: str, shards: int) -> str:
    """A recursive table (k, state, leap) of every leap of every key; the last one below ``shards`` is its shard."""
    step = f"({_times('state', int(_STEP))}::UHUGEINT + 1) % 18446744073709551616::UHUGEINT"
    return f"""
{name}(k, state, leap) AS (
  SELECT k, state, 0::BIGINT FROM keys
  UNION ALL
  SELECT k, state, leap FROM (
    SELECT k, state, floor((leap + 1) * (2147483648::DOUBLE / ((state >> 33)::DOUBLE + 1)))::BIGINT AS leap
    FROM (SELECT k, ({step})::UBIGINT AS state, leap FROM {name}))
  WHERE leap < {shards}),
{name}_last AS (SELECT k, max(leap)::INT AS shard FROM {name} GROUP BY k)"""


ORACLE = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS bits),
bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, coalesce(doc_id, 0) AS k,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UINTEGER) AS b FROM documents),
rows_ AS (
  SELECT doc_id, size::BIGINT AS size, k,
         xor(list_reduce(list_prepend(4294967295::UINTEGER, b), lambda c, x: xor(bits[xor(c & 255, x) + 1], c >> 8)), 4294967295::UINTEGER)::BIGINT AS text_crc32
  FROM bytes, crc),
unsigned_ AS (SELECT DISTINCT k, (CASE WHEN k < 0 THEN k::HUGEINT + 18446744073709551616::HUGEINT ELSE k END)::UBIGINT AS u FROM rows_),
first_ AS (SELECT k, {_times("xor(u, u >> 30)", 0xBF58476D1CE4E5B9)} AS a FROM unsigned_),
second_ AS (SELECT k, {_times("xor(a, a >> 27)", 0x94D049BB133111EB)} AS b FROM first_),
keys AS (SELECT k, xor(b, b >> 31) AS state FROM second_),
{_walk("now", SHARDS)},
{_walk("later", SHARDS + 1)}
SELECT doc_id, size, text_crc32, 'key' AS law, n.shard AS shard,
       row_number() OVER (PARTITION BY n.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, l.shard AS grown_shard
FROM rows_ r JOIN now_last n USING (k) JOIN later_last l USING (k)
"""
