"""Reader rules as columns against their plain form, on rows with nulls."""

import random

from pyspark.sql import functions as F

from quire.operators import reader as R

NAMES = ["theme", "fontSize", "margin", "columns", "x"]


def maps(rng, n):
    return [None if rng.random() < 0.1 else {k: rng.choice([None, "1", "2"]) for k in rng.sample(NAMES, rng.randrange(len(NAMES) + 1))} for _ in range(n)]


def test_merges_equal_the_plain_form(spark):
    rng = random.Random(9)
    rows = [(i, b or {}, u or {}) for i, (b, u) in enumerate(zip(maps(rng, 80), maps(rng, 80)))]
    df = spark.createDataFrame(rows, "id long, base map<string,string>, upd map<string,string>")
    for r in df.select("id", "base", "upd", R.merged_appearance(F.col("base"), F.col("upd")).alias("m"), R.reflowing(F.col("upd")).alias("r")).collect():
        assert r.m == R.merge_appearance(r.base, r.upd)
        assert r.r == any(r.upd.get(k) is not None for k in R.REFLOWS)


def test_states_equal_merging_one_by_one(spark):
    rng = random.Random(10)
    rows = [(i % 3, i, m) for i, m in enumerate(maps(rng, 90))]
    got = {}
    for r in R.appearance_states(spark.createDataFrame(rows, "s long, seq long, m map<string,string>").repartition(4), "s", "seq", "m").collect():
        got.setdefault(r.s, {})[r.name] = r.value
    for s in range(3):
        state: dict = {}
        for _, _, m in (r for r in rows if r[0] == s):
            state = R.merge_appearance(state, m or {})
        assert got.get(s, {}) == state


def test_what_a_gesture_means(spark):
    rows = [(40.0, 3.0, False, True, True, True), (40.0, 3.0, True, False, False, False), (2.0, 2.0, False, True, True, True), (2.0, 2.0, False, False, True, True), (2.0, 2.0, False, False, False, True), (2.0, 2.0, True, False, False, False), (20.0, 2.0, False, False, False, False), (None, 1.0, False, True, False, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, dx double, dy double, s boolean, l boolean, i boolean, d boolean")
    got = [r.m for r in df.select("id", R.gesture_message(*[F.col(c) for c in ("dx", "dy", "s", "l", "i", "d")]).alias("m")).orderBy("id").collect()]
    assert got == ["swipe", None, "linkclick", "imagetap", "decorationtap", "tap", None, None]


def test_navigation_events_keep_their_order(spark):
    rows = [(1, i, v, t) for i, (v, t) in enumerate([("prev", None), ("link", 9), ("next", None), ("link", 1), ("end", None), ("back", None), ("bad", None)])]
    df = spark.createDataFrame(rows, "session long, seq long, verb string, target int")
    got = [(r.seq, r.event, r.section, r.progress) for r in R.navigation_events(R.replay(df, [3, 1]), [3, 1]).orderBy("seq").collect()]
    assert got == [(1, "error", None, None), (2, "relocated", 0, 0.25), (3, "relocated", 1, 0.5), (5, "relocated", 0, 0.25), (6, "error", None, None)]
