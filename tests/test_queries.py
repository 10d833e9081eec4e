"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest
import regex

from quire.operators import reader
from quire.plans import archives, corpus, fed, formats, layout, marks, nodes, ordered, queries, streams
from quire.streaming.replay import replay_stream

SF = "/root/testdata/sf0.001"
TABLES = "documents pages conversations events benchmark labels embeddings".split()
PLANS = (queries, formats, layout, marks, nodes, archives, corpus, ordered, streams, fed)
QUERIES, ORACLES = ({k: v for plan in PLANS for k, v in getattr(plan, name).items()} for name in ("QUERIES", "ORACLES"))


def shown(v):
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted([shown(v) for v in r] for r in found.fetchall())
    assert sorted([shown(r[c]) for c in columns] for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_round_trips(spark):
    assert queries.position_roundtrip(spark, SF).filter("not resolved or not same").count() == 0
    found = queries.window_score(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    for r in found:  # documents that repeat one word read the same backwards
        words = regex.findall(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*", r.text.lower())
        lo, hi = int(len(words) * 0.1), int(len(words) * 0.9) - 25
        back = " " + " ".join(words[::-1]) + " "
        held = sum(f" {' '.join(words[at : at + 25])} " in back for at in (lo + (hi - lo) * i // 20 for i in range(20)))
        assert (r.self_score, r.reversed_differs) == (1.0, held / 20 < 0.2)
    shifts = [r.shift for r in queries.resolve_shifted_text(spark, SF).collect()]
    assert None not in shifts and shifts.count(15) > 0.95 * len(shifts)  # a repeated quote may be nearer elsewhere


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, i, v, t) for s in (1, 2) for i, (v, t) in enumerate([("next", None), ("link", 1), ("next", None), ("back", None), ("end", None), ("link", 7)])]
    schema = "session long, seq long, verb string, target int"
    batch = spark.createDataFrame(rows, schema)
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = replay_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), [2, 2])
    q = stream.writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(spark.sql("SELECT * FROM replayed")) == order(reader.replay(batch, [2, 2]))
