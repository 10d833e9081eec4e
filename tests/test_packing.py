"""Packing by doubling against packing one after another."""

import random

import pytest

from quire.operators import books as B
from quire.operators import packing as P

NAMES = ["k", "chunk", "first_node", "n_nodes", "chars", "start", "end"]


def sections(seed):
    rng = random.Random(seed)
    out = []
    for k, (n, heads, most) in enumerate([(400, 0.2, 300), (150, 0.6, 400), (60, 0.0, 1500), (1, 0.0, 10), (1, 1.0, 5000), (80, 0.3, 30), (40, 0.2, 0)]):
        for i in range(n):
            size = rng.choice([0, rng.randrange(most + 1), rng.randrange(most + 1), 1000 if rng.random() < 0.05 else 5])
            out.append((k, i * 3, "H2" if rng.random() < heads else "P", size))
    out += [(100, i, "H1", 400) for i in range(30)] + [(101, i, "H3", 90) for i in range(200)]  # headings alone
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_one_after_another(spark, seed):
    rows = sections(seed)
    df = spark.createDataFrame([*rows, (None, 1, "P", 5)], "k long, i long, tag string, size int").repartition(3)
    got = sorted(tuple(r[c] for c in NAMES) for r in P.packed(df, ["k"], "i", "tag", "size", 1000).collect())
    want = sorted(tuple(r[c] for c in NAMES) for r in B.chunk_ranges(df.filter("k IS NOT NULL"), "k", "i", "tag", "size", 1000).collect())
    assert got == want and len(want) > 60


def test_empty(spark):
    df = spark.createDataFrame([], "k long, i long, tag string, size int")
    assert P.packed(df, ["k"], "i", "tag", "size").count() == 0
