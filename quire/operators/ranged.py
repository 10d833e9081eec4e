"""Order over one hot key: rows are dealt by ranges of (key, order), never by key alone.

Within a partition rows stand in order, and the few facts that must cross its edge (how many rows came before, which range was open)
are one row a partition. So ranks, quantiles and as-of joins are exact however many rows one key has; equal rows are
parted by a row number. Tables in between are written to the shared folder, which fixes the ranges.

Cases: null keys and null order values come first and count as equal to each other; repeated rows keep a row each; empty
tables give empty tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ranges import written

_IN_PARTITION = (1 << 33) - 1


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """The rows with ``_part`` and ``_nth`` (place in the partition): partitions and places follow the order."""
    numbered = written(df.withColumn("_row", F.monotonically_increasing_id()), compression="zstd")
    by = [*[F.asc_nulls_first(F.col(f"`{c}`")) for c in order], F.asc("_row")]
    placed = numbered.repartitionByRange(partitions or _partitions(df), *by).sortWithinPartitions(*by)
    return written(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("_nth")).drop("_row"), compression="zstd")


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """The rows with ``name`` (long, from 0): the place of each among the rows of its keys, by ``order``."""
    rows = dealt(df, [*keys, *order], partitions)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lifts = counts.select("_part", before.alias("_before"))
    placed = rows.join(F.broadcast(lifts), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")
    if not keys:
        return placed
    first = placed.groupBy(*keys).agg(F.min(name).alias("_first")).select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)], "_first")
    joined = placed.join(first, _equal(keys, "_key"))  # one row a key on the right; adaptive execution splits a hot one on the left
    return joined.withColumn(name, F.col(name) - F.col("_first")).drop("_first", *[f"_key{i}" for i in range(len(keys))])


def _equal(keys: list[str], prefix: str) -> Column:
    """The keys equal the columns ``prefix`` 0, 1, ...; nulls equal nulls."""
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(f"`{k}`").eqNullSafe(F.col(f"{prefix}{i}"))
    return condition


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], partitions: int | None = None) -> DataFrame:
    """(keys, a column a share): the value at ``floor(share * n)`` of the sorted values of each key, as ``books.nearest_rank``
    gives it, for keys whose different values are too many for one task. Null values do not count."""
    rows = ranked(df.filter(F.col(value).isNotNull()).select(*keys, value), keys, [value], "_rank", partitions)
    if keys:
        sizes = rows.groupBy(*[F.col(f"`{k}`").alias(f"_of{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_all"))
        rows = rows.join(sizes, _equal(keys, "_of"))
    else:
        rows = rows.withColumn("_all", F.lit(rows.count()))
    at = lambda share: F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.lit(share)))
    wanted = F.lit(False)
    for q in shares.values():
        wanted = wanted | (F.col("_rank") == at(q))
    return rows.filter(wanted).groupBy(*keys).agg(*[F.max(F.when(F.col("_rank") == at(q), F.col(value))).alias(n) for n, q in shares.items()])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, partitions: int | None = None) -> DataFrame:
    """The rows of ``left``, with the columns of the last row of ``right`` (same keys) whose ``start`` is not beyond ``at``;
    nulls where there is none. The columns of the two must differ but for the keys; null keys meet nothing.

    Both are dealt by (keys, place) together. A partition knows the last row of ``right`` in it; the key that is open at a
    partition's edge takes it from the nearest partition before that has one of that key."""
    rest = [c for c in right.columns if c not in keys]
    row, span = F.struct(*left.columns), F.struct(*rest)
    fine = F.lit(True)
    for k in keys:
        fine = fine & F.col(f"`{k}`").isNotNull()
    kind = right.select(span.alias("s")).schema["s"].dataType
    ours = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), row.alias("_left"), F.lit(None).cast(kind).alias("_right"))
    theirs = right.filter(fine & F.col(start).isNotNull()).select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(ours.schema["_left"].dataType).alias("_left"), span.alias("_right"))
    rows = dealt(ours.unionByName(theirs), [*keys, "_at", "_kind"], partitions)
    upto = Window.partitionBy("_part", *keys).orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_found", F.last("_right", ignorenulls=True).over(upto))
    # What crosses the edges: for each partition the key it begins with, the key it ends with, and that one's last range.
    one = F.struct(*keys)
    edges = rows.groupBy("_part").agg(F.min(one).alias("_first"), F.max(one).alias("_last"))
    ends = rows.filter("_kind = 0").join(F.broadcast(edges), "_part").filter(one.eqNullSafe(F.col("_last"))).groupBy("_part").agg(F.max_by("_right", "_nth").alias("_open"))
    edges = edges.join(ends, "_part", "left")
    before = Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    carried = edges.withColumn("_carry", F.last("_open", ignorenulls=True).over(before)).select((F.col("_part")).alias("_ends"), F.col("_last"), "_carry")
    # The nearest partition before this one that ends with the key this one begins with is the one just before it, if any.
    order = Window.orderBy("_part")
    previous = edges.select("_part", "_first", F.lag("_part").over(order).alias("_ends"))
    opened = previous.join(carried, "_ends").filter(F.col("_first") == F.col("_last")).select("_part", "_first", "_carry")
    both = here.filter("_kind = 1").join(F.broadcast(opened), "_part", "left")  # a row a partition
    found = F.coalesce("_found", F.when(one == F.col("_first"), F.col("_carry")))
    return both.select("_left", F.when(fine, found).alias("_right")).select("_left.*", *[F.col(f"_right.{c}").alias(c) for c in rest])


def containing_ranges(offsets: DataFrame, ranges: DataFrame, keys: list[str], offset: str, start: str = "start", end: str = "end", partitions: int | None = None) -> DataFrame:
    """Offsets with the range that holds them, as ``books.containing`` gives them, however many rows one key has. Ranges of
    a key do not overlap."""
    named = ranges.withColumnsRenamed({c: f"_r_{c}" for c in ranges.columns if c in offsets.columns and c not in keys})
    new = lambda c: f"_r_{c}" if f"_r_{c}" in named.columns else c
    found = as_of(offsets, named, keys, offset, new(start), partitions).filter(F.col(offset) < F.col(new(end)))
    return found
