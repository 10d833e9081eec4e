"""Greedy packing of a section's nodes without a task a section.

Where a chunk ends depends only on where it began and on the first node that it has not taken yet (a node that made a heading
move on with it is taken whatever its size). These pairs are states; the next state of each is found by as-of joins over running
sums, all at once. The states that a section goes through from its first node are then found by doubling: a round joins the
states that are known to be passed with jumps of 1, 2, 4, ... states, so a section of n chunks takes log2(n) rounds. Every
step deals rows by ranges or by (section, place), so one section may hold all nodes.

Where headings alone fill chunk after chunk, states come up that are not among the two of each node; they are added for
``ROUNDS`` rounds, and sections that need still more are packed one after another by ``books.chunk_ranges``.

Cases: nodes of no length and chunks of none are kept; nodes as long as the budget or longer stand alone; sections without
nodes have no chunks; null keys are no section. Nodes of a section have different orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ranges import written
from .books import CHUNK_CHARS, NEVER_LAST, chunk_ranges
from .ranged import as_of, ranked

ROUNDS = 6
#: Nodes whose sums are taken in one step of a running sum.
_BLOCK = 4096


def running(nodes: DataFrame, keys: list[str], place: str, value: str, name: str) -> DataFrame:
    """The rows with ``name``: the sum of ``value`` before each, by ``place`` (long, from 0, gapless)."""
    blocked = nodes.withColumn("_block", F.floor(F.col(place) / _BLOCK))
    sums = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    lifts = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_lift"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    return blocked.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(lifts, [*keys, "_block"]).withColumn(name, F.col("_lift") + F.col("_inside")).drop("_block", "_inside", "_lift")


def _places(nodes: DataFrame, keys: list[str], order: str, tag: str, chars: str, budget: int) -> DataFrame:
    """Every node with its place i, size z, the sum before it, and: full, the first place behind which a chunk that began here
    is over the budget; large, the first node from here on that stands alone; back, where the headings right before it begin."""
    own = nodes.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).select(*keys, order, F.col(tag).alias("_tag"), F.col(chars).cast("long").alias("z"))
    placed = ranked(own, keys, [order], "i")
    rows = written(running(placed, keys, "i", "z", "s").select(*keys, "i", "z", "s", F.col("_tag").isin(*NEVER_LAST).alias("heading")))
    ends = rows.groupBy(*keys, (F.col("s") + F.col("z")).alias("_end")).agg(F.max("i").alias("_last"))
    full = as_of(rows.select(*keys, "i", "z", "s", (F.col("s") + budget).alias("_at")), ends, keys, "_at", "_end")
    full = full.select(*keys, "i", "z", "s", (F.coalesce("_last", F.lit(-1)) + 1).alias("full"))
    alone = rows.filter(F.col("z") >= budget).select(*keys, (-F.col("i")).alias("_m"), F.col("i").alias("large"))
    large = as_of(full.withColumn("_at", -F.col("i")), alone, keys, "_at", "_m").drop("_at", "_m")
    plain = rows.filter(~F.coalesce("heading", F.lit(False))).select(*keys, F.col("i").alias("_plain"))
    back = as_of(large.withColumn("_at", F.col("i") - 1), plain.withColumn("_from", F.col("_plain")), keys, "_at", "_from")
    return written(back.select(*keys, "i", "z", "s", "full", "large", (F.coalesce("_plain", F.lit(-1)) + 1).alias("back")))


def _steps(states: DataFrame, places: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Each state (lo, at) with the next one (lo2, at2; null at the end) and the chunks that lie between, as pairs."""
    begin = places.select(*keys, F.col("i").alias("lo"), "full")
    here = places.select(*keys, F.col("i").alias("at"), "large")
    found = states.join(sizes, keys).join(begin, [*keys, "lo"]).join(here, [*keys, "at"], "left")
    stop = F.least(F.coalesce("large", F.col("n")), F.greatest("at", "full"))
    found = found.withColumn("_j", F.when(F.col("at") >= F.col("n"), F.col("n")).otherwise(stop))
    found = found.join(places.select(*keys, F.col("i").alias("_j"), "back"), [*keys, "_j"], "left")
    end, lone = F.col("_j") >= F.col("n"), F.coalesce(F.col("_j") == F.col("large"), F.lit(False))
    cut = F.greatest(F.col("lo") + 1, F.col("back"))
    pair = lambda a, b: F.struct(a.alias("first"), b.alias("stop"))
    chunks = F.when(end, F.array(pair(F.col("lo"), F.col("n")))).when(lone, F.array(pair(F.col("lo"), F.col("_j")), pair(F.col("_j"), F.col("_j") + 1))).otherwise(F.array(pair(F.col("lo"), cut)))
    over = F.when(~end, F.col("_j") + 1)
    last = lone & (over >= F.col("n"))
    return found.select(
        *keys, "lo", "at", F.when(~end & ~last, F.when(lone, over).otherwise(cut)).alias("lo2"), F.when(~end & ~last, over).alias("at2"),
        F.filter(chunks, lambda c: c["stop"] > c["first"]).alias("chunks"),
    )


def packed(nodes: DataFrame, keys: list[str], order: str, tag: str, chars: str, budget: int = CHUNK_CHARS) -> DataFrame:
    """(keys, chunk, first_node, n_nodes, chars, start, end), as ``books.chunk_ranges`` gives them for one key."""
    places = _places(nodes, keys, order, tag, chars, budget)
    sizes = written(places.groupBy(*keys).agg(F.count("*").alias("n")))
    of = [*keys, "lo", "at"]
    new = places.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("lo"), F.col("i").alias("at")), F.struct(F.col("back").alias("lo"), (F.col("i") + 1).alias("at")))).alias("s")).select(*keys, "s.*").distinct()
    steps = written(_steps(new, places, sizes, keys))
    for _ in range(ROUNDS):
        more = steps.filter("lo2 IS NOT NULL").select(*keys, F.col("lo2").alias("lo"), F.col("at2").alias("at")).distinct().join(steps.select(*of), of, "left_anti")
        more = written(more)
        if not more.limit(1).count():
            break
        steps = written(steps.unionByName(_steps(more, places, sizes, keys)))
    passed, jumps = written(sizes.select(*keys, F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("at"))), steps.select(*of, "lo2", "at2")
    known = 0
    while (count := passed.count()) > known:
        known = count
        landed = passed.join(jumps, of).filter("lo2 IS NOT NULL").select(*keys, F.col("lo2").alias("lo"), F.col("at2").alias("at"))
        passed = written(passed.unionByName(landed).distinct())
        then = jumps.select(*keys, F.col("lo").alias("lo2"), F.col("at").alias("at2"), F.col("lo2").alias("lo3"), F.col("at2").alias("at3"))
        jumps = written(jumps.filter("lo2 IS NOT NULL").join(then, [*keys, "lo2", "at2"]).select(*of, F.col("lo3").alias("lo2"), F.col("at3").alias("at2")))
    lost = written(passed.join(steps.select(*of), of, "left_anti").select(*keys).distinct())  # sections with states beyond the rounds
    found = passed.join(lost, keys, "left_anti").join(steps.select(*of, "chunks"), of).select(*keys, F.explode("chunks").alias("c")).select(*keys, "c.first", "c.stop").distinct()
    numbered = ranked(found, keys, ["first"], "chunk")
    begin = places.select(*keys, F.col("i").alias("first"), F.col("s").alias("start"))
    end = places.select(*keys, (F.col("i") + 1).alias("stop"), (F.col("s") + F.col("z")).alias("end"))
    out = numbered.join(begin, [*keys, "first"]).join(end, [*keys, "stop"])
    out = out.select(*keys, "chunk", F.col("first").alias("first_node"), (F.col("stop") - F.col("first")).alias("n_nodes"), (F.col("end") - F.col("start")).alias("chars"), "start", "end")
    if len(keys) == 1 and lost.limit(1).count():
        out = out.unionByName(chunk_ranges(nodes.join(lost, keys, "left_semi"), keys[0], order, tag, chars, budget))
    elif len(keys) > 1 and lost.limit(1).count():
        raise ValueError("sections of headings alone have to have one key")
    return out
