"""Hard negatives against plain Python over all pairs, on hard rows and with small blocks; the bounds themselves."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import negatives, registry

SF = "/root/testdata/sf0.001"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int, id string, row int, extra map<string,int>"


def table():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(420):
        v = rng.normal(0, 0.2, 12) + (i % 3 == 0) * 0.3
        rows.append((i * 5, [float(np.float32(x)) for x in v], int(i % 4)))
    same = [float(np.float32(x)) for x in rng.normal(0.4, 0.1, 12)]
    rows += [(1000 + k, same, 1) for k in range(150)] + [(2000 + k, same, 2) for k in range(150)]  # a vector that is a third of the rows
    rows += [(100, same, 1), (100, same, 1), (300, [-x for x in same], 3), (500, [0.0] * 12, 0), (7, same, 9), (700, same, 9), (-100, same, -3)]
    rows += [(None, same, 1), (800, None, 1), (900, same, None), (1100, [math.nan] + same[1:], 1), (1200, [math.inf] + same[1:], 1), (1300, same[:5], 1), (1400, [None] + same[1:], 1), (1500, [1e30] + same[1:], 1), (1600, [], 1)]
    rows += [(1700, [30000.0] + same[1:], 2), (1800, [29000.0] + same[1:], 5), (1900, [31000.0] + same[1:], 2)]
    return rows


def brute(rows, low=80, high=100, k=5):
    good = [(i, [math.floor(256 * x) for x in v], lab if i % 7 else int(math.fmod(lab + 1, 10))) for i, v, lab in rows if i is not None and lab is not None and v and len(v) == 12 and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in v)]
    out = []
    for a, (i, q, lab) in enumerate(good):
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), j, b, la) for b, (j, v, la) in enumerate(good) if b != a)
        for s, j, _, _ in [x for x in scored if x[3] == lab][:k]:
            fits = [(-n, m) for n, m, _, la in scored if la != lab and low * -s <= 100 * -n <= high * -s][:k]
            out += [(i, j, r, m, -s, n) for r, (n, m) in enumerate(fits, 1)]
    return sorted(out)


def frame(spark):
    return spark.createDataFrame([(*r, "x", 1, {"a": 1}) for r in table()], SCHEMA).repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"block": 40, "group": 3, "sample": 100}, {"block": 97, "sample": 1}, {"low": 50, "high": 90, "block": 200}])
def test_equals_brute_force(spark, sizes):
    got = negatives.mine(frame(spark), F.col("vec_id") % 100 == 0, label=negatives.relabelled(), **sizes)
    window = {k: v for k, v in sizes.items() if k in ("low", "high")}
    assert sorted(map(tuple, got.select(*NAMES).collect())) == brute(table(), **window)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (20, 19))[rng.integers(0, 20, 500)] + rng.integers(-30, 30, (500, 19))
    q = x[:40]
    codes = negatives.Codes(x[:200], 7)  # most rows were not in the sample
    cell, far, code, left = codes.code(x)
    lower, upper = codes.bounds(q, code, left.astype(float), float(np.linalg.norm(x, axis=1).max()))
    exact = q @ x.T
    assert (lower <= exact).all() and (exact <= upper).all()
    radius = np.array([far[cell == k].max() if (cell == k).any() else -1 for k in range(len(codes.cells))])
    least, most = codes.reach(q, radius)
    assert (least[:, cell] <= exact).all() and (exact <= most[:, cell]).all()
    assert (upper < np.sort(exact, axis=1)[:, -5:-4]).mean() > 0.3  # the bounds do rule rows out


def test_empty_tables(spark):
    empty = frame(spark).limit(0)
    assert negatives.mine(empty, F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(frame(spark), F.lit(False)).count() == 0
    alone = frame(spark).filter("vec_id = 1700")
    assert negatives.mine(alone, F.lit(True)).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({registry.oracle_sql()['op12_hard_negatives']})").fetchall()
    assert sorted(map(tuple, registry.queries()["op12_hard_negatives"](spark, SF).select(*NAMES).collect())) == sorted(want)
