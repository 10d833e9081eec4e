"""Ranks, quantiles, as-of joins and closures with one hot key, nulls and ties, against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import books as B
from quire.operators import closure as K
from quire.operators import ranged as R


def rows():
    rng = random.Random(4)
    out = [("hot", rng.randrange(40)) for _ in range(600)] + [(rng.choice("abc"), rng.randrange(9)) for _ in range(60)]
    return [*out, *[("hot", 7)] * 200, (None, 1), (None, 0), ("a", None), ("hot", None)]


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_ranks(spark, partitions):
    df = spark.createDataFrame(rows(), "k string, v long").repartition(5)
    order = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)
    got = sorted((r["place"], r["k"], r["v"]) for r in R.ranked(df, [], ["k", "v"], "place", partitions).collect())
    assert got == [(i, *r) for i, r in enumerate(sorted(rows(), key=order))]
    by_key = {}
    for r in R.ranked(df, ["k"], ["v"], "place", partitions).collect():
        by_key.setdefault(r["k"], []).append((r["place"], r["v"]))
    for k, found in by_key.items():
        assert sorted(found) == list(enumerate(sorted((v for x, v in rows() if x == k), key=lambda v: (v is not None, v or 0))))
    assert R.ranked(df.limit(0), ["k"], ["v"], "place", partitions).count() == 0


def test_hot_rows_are_dealt(spark):
    df = spark.createDataFrame(rows(), "k string, v long")
    sizes = [r["count"] for r in R.dealt(df, ["k"], 10).groupBy("_part").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 3 * sum(sizes) / 10


def test_quantiles_equal_nearest_rank(spark):
    df = spark.createDataFrame(rows(), "k string, v long").repartition(3)
    shares = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    plain = sorted(map(str, B.nearest_rank(df, "k", "v", shares).collect()))
    assert sorted(map(str, R.quantiles(df, ["k"], "v", shares, 6).collect())) == plain
    values = sorted(v for _, v in rows() if v is not None)
    assert tuple(R.quantiles(df, [], "v", shares, 6).first()) == tuple(values[min(len(values) - 1, int(len(values) * q))] for q in shares.values())


@pytest.mark.parametrize("partitions", [1, 6, 50])
def test_as_of_carries_over_partitions(spark, partitions):
    rng = random.Random(5)
    starts = {"hot": [0, 5, 400, 401, 900], "a": [10], "b": [], "z": [3, 4]}
    left = [(k, rng.randrange(1000)) for k in ("hot",) * 300 + ("a", "b", "z") * 20] + [("hot", 450)] * 200 + [(None, 5), ("hot", None), ("unknown", 3)]
    ranges = [(k, s, s + 100, f"{k}{s}") for k, found in starts.items() for s in found] + [(None, 0, 9, "null"), ("hot", None, 5, "nowhere")]
    ours = spark.createDataFrame([(k, o, "x") for k, o in left], "k string, off long, tag string").repartition(4)
    theirs = spark.createDataFrame(ranges, "k string, start long, stop long, name string").repartition(3)
    got = sorted(((r["k"], r["off"], r["start"], r["name"]) for r in R.as_of(ours, theirs, ["k"], "off", "start", partitions).collect()), key=str)

    def last(k, o):
        at = bisect.bisect_right(starts.get(k, []), o) if k and o is not None else 0
        return (starts[k][at - 1], f"{k}{starts[k][at - 1]}") if at else (None, None)

    assert got == sorted(((k, o, *last(k, o)) for k, o in left), key=str)
    theirs = theirs.filter("k IS NOT NULL AND start IS NOT NULL")
    plain = B.containing(ours, theirs, "k", "off", "start", "stop").select("k", "off", "tag", "name")
    ranged = R.containing_ranges(ours, theirs, ["k"], "off", "start", "stop", partitions).select("k", "off", "tag", "name")
    assert sorted(map(tuple, ranged.collect())) == sorted(map(tuple, plain.collect())) and plain.count() > 100
    assert R.as_of(ours.limit(0), theirs, ["k"], "off", "start", partitions).count() == 0
    assert R.as_of(ours, theirs.limit(0), ["k"], "off", "start", partitions).filter("name IS NOT NULL").count() == 0


def walk(nodes, start):
    seen, here = set(), start
    while True:
        if nodes[here][1]:
            return here, "found"
        if here in seen:
            return None, "cycle"
        seen.add(here)
        if nodes[here][0] not in nodes:
            return start, "dead"
        here = nodes[here][0]


def test_chains(spark):
    rng = random.Random(6)
    books = {b: {i: (rng.choice([None, i, *range(n + 2)]), rng.random() < 0.2) for i in range(n)} for b, n in enumerate([1, 2, 5, 30, 30, 60])}
    books[9] = {i: (i + 1, i == 299) for i in range(300)} | {1000: (1001, False), 1001: (1000, False)}
    df = spark.createDataFrame([(b, i, to, stop) for b, nodes in books.items() for i, (to, stop) in nodes.items()] + [(None, 1, 1, True), (3, None, 1, True)], "book long, item long, fallback long, fine boolean")
    got = {(r.book, r.item): (r.target, r.status) for r in K.follow(df.filter("book IS NOT NULL"), ["book"], "item", "fallback", F.col("fine")).collect()}
    assert got == {(b, i): walk(nodes, i) for b, nodes in books.items() for i in nodes}
    assert {s for _, s in got.values()} == {"found", "dead", "cycle"} and got[9, 0] == (299, "found")
    assert K.follow(df.limit(0), ["book"], "item", "fallback", F.col("fine")).count() == 0


def test_reach(spark):
    rng = random.Random(7)
    edges = [(b, rng.randrange(20), rng.randrange(20)) for b in range(3) for _ in range(25)] + [(7, i, i + 1) for i in range(40)] + [(8, 1, 1), (8, None, 2), (8, 2, None), (7, 0, 1)]
    df = spark.createDataFrame(edges, "book long, a long, b long")
    want = {}
    for book in {e[0] for e in edges}:
        out = {}
        for _, a, b in (e for e in edges if e[0] == book and None not in e):
            out.setdefault(a, set()).add(b)
        for a in out:
            seen, level, steps = {}, out[a], 1
            while level:
                seen |= {x: steps for x in level}
                level, steps = {y for x in level for y in out.get(x, ()) if y not in seen}, steps + 1
            want |= {(book, a, b): n for b, n in seen.items()}
    assert {(r.book, r.a, r.b): r.steps for r in K.reachable(df, ["book"], "a", "b").collect()} == want
    assert K.reachable(df.limit(0), ["book"], "a", "b").count() == 0
