"""Closures of edges over all books at once: chains of fallbacks and nested imports, with cycles marked.

Rounds double what a row has seen, so a chain of n steps takes log2(n) joins, each of all books together; every round's
rows are written to the shared folder, where the lineage ends.

Cases: null ends are no edges; an edge to a missing node is a dead end; a node that points to itself is a cycle of one;
repeated edges count once; of several edges of a chain's node the least target counts; empty tables give empty tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ranges import written


def follow(nodes: DataFrame, keys: list[str], node: str, next_: str, stops: Column) -> DataFrame:
    """(keys, node, target, status): the first node at or behind each for which ``stops`` holds, going by ``next_``.

    Status is ``found``; ``dead`` where the way ends at a node without one or with one that is missing (target is the node
    itself then); ``cycle`` where it comes back (target is null). Nodes of a book are different."""
    own = nodes.filter(F.col(node).isNotNull()).groupBy(*keys, F.col(node).alias("_node")).agg(F.min(F.struct(F.when(stops, 0).otherwise(1).alias("go"), F.col(next_).alias("to"))).alias("_n"))
    known = own.select(*keys, F.col("_node").alias("_to"), F.lit(True).alias("_there"))
    first = own.select(*keys, "_node", F.col("_n.go").alias("_go"), F.col("_n.to").alias("_to")).join(known, [*keys, "_to"], "left")
    ended = F.when(F.col("_go") == 0, "found").when(F.col("_there").isNull(), "dead")
    step = written(first.select(*keys, "_node", F.when(ended.isNotNull(), F.col("_node")).otherwise(F.col("_to")).alias("_to"), ended.alias("_status")))
    largest = step.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    seen = 1
    while seen < largest:  # after 2 ** k rounds a way of 2 ** k steps is known; a longer one than there are nodes is a cycle
        if not step.filter("_status IS NULL").limit(1).count():
            break
        behind = step.select(*keys, F.col("_node").alias("_to"), F.col("_to").alias("_then"), F.col("_status").alias("_how"))
        moved = step.filter("_status IS NULL").join(behind, [*keys, "_to"]).select(*keys, "_node", F.col("_then").alias("_to"), F.col("_how").alias("_status"))
        step = written(step.filter("_status IS NOT NULL").unionByName(moved))
        seen *= 2
    status = F.coalesce("_status", F.lit("cycle"))
    target = F.when(status == "found", F.col("_to")).when(status == "dead", F.col("_node"))
    return step.select(*keys, F.col("_node").alias(node), target.alias("target"), status.alias("status"))


def reachable(edges: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """(keys, source, target, steps): every node that each reaches, and in how few steps. A node that reaches itself stands
    on a cycle. The rows are the answer's own: a node of a large, well-knit book has one for each node it reaches."""
    base = edges.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).select(*keys, F.col(source).alias("_a"), F.col(target).alias("_b")).distinct()
    reach = written(base.withColumn("steps", F.lit(1)))
    known = reach.count()
    while True:
        left, right = reach.withColumnRenamed("_b", "_m"), reach.select(*keys, F.col("_a").alias("_m"), "_b", F.col("steps").alias("_more"))
        longer = left.join(right, [*keys, "_m"]).select(*keys, "_a", "_b", (F.col("steps") + F.col("_more")).alias("steps"))
        grown = written(reach.unionByName(longer).groupBy(*keys, "_a", "_b").agg(F.min("steps").alias("steps")))
        before, known = known, grown.count()
        same = known == before and grown.agg(F.sum("steps")).first()[0] == reach.agg(F.sum("steps")).first()[0]
        reach = grown
        if same:
            return reach.select(*keys, F.col("_a").alias(source), F.col("_b").alias(target), F.col("steps").cast("int").alias("steps"))
