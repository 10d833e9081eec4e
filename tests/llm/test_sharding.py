"""Sharding: the law, the slots, hard rows and written files, against a scalar form of the hash and against SQL."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import flat, registry, sharding

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def scalar_jump(key: int, n: int) -> int:
    """One key at a time, in whole numbers."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & MASK
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 1000])
def test_jump_equals_scalar_form(n):
    keys = np.concatenate([np.arange(500, dtype=np.uint64), flat.mix(np.arange(500, dtype=np.uint64)), np.array([MASK, 1 << 63], np.uint64)])
    assert sharding.jump(keys, n).tolist() == [scalar_jump(int(k), n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shards():
    keys = flat.mix(np.arange(50_000, dtype=np.uint64))
    for old, new in ((1, 2), (24, 25), (24, 40)):
        a, b = sharding.jump(keys, old), sharding.jump(keys, new)
        went = a != b
        assert (b[went] >= old).all() and abs(went.mean() - (1 - old / new)) < 0.01
    sizes = np.bincount(sharding.jump(keys, 24))
    assert len(sizes) == 24 and sizes.max() < 1.1 * sizes.mean()
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def hard(spark):
    rows = [(i, "t" * (i % 7), "x", 0) for i in range(200)] + [(None, None, "n", 1), (None, "", "n", 2), (-5, "é\x00漢", None, None), (9, "w" * 300_000, "l", 3)] + [(7, "same", "r", 4)] * 400
    return spark.createDataFrame(rows, "doc_id long, text string, Slot string, shard int").repartition(5)


def test_slots_are_gapless_and_hold_hard_rows(spark):
    df = hard(spark)
    body = F.coalesce("text", F.lit(""))
    narrow = df.select("*", F.crc32(body.cast("binary")).alias("crc"), F.lit(1).alias("_row"))
    placed = sharding.slots(sharding.assign(narrow, 24, ("doc_id",), 25), ("doc_id", "crc"), partitions=6)
    assert {"Slot__2", "shard__2", "_row__2"} <= set(placed.columns)
    rows = placed.collect()
    assert len(rows) == df.count()
    held = defaultdict(list)
    for r in rows:
        key = int(flat.mix(np.array([r.doc_id or 0], np.int64).view(np.uint64))[0])
        assert (r["shard"], r["grown_shard"]) == (scalar_jump(key, 24), scalar_jump(key, 25))
        assert r["crc"] == zlib.crc32((r["text"] or "").encode())
        held[r["shard"]].append((r["slot"], (r["doc_id"] is not None, r["doc_id"] or 0, r["crc"])))
    for found in held.values():
        assert sorted(s for s, _ in found) == list(range(len(found)))
        assert [k for _, k in sorted(found)] == sorted(k for _, k in found)


def test_other_keys_empty_tables_and_moves(spark):
    df = hard(spark)
    by_text = sharding.assign(df, 5, ("text", "doc_id")).select("doc_id", "text", "shard").distinct().collect()
    assert len({(r.doc_id, r.text) for r in by_text}) == len(by_text)
    assert all(r["grown_shard"] == 24 for r in sharding.moved(df.drop("shard"), 24, 25).collect())
    empty = df.limit(0)
    assert sharding.slots(sharding.assign(empty), ("doc_id",)).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    df = hard(spark).drop("shard")
    sharding.write(df, str(tmp_path / "out"), 4, rows_a_file=50)
    back = spark.read.parquet(str(tmp_path / "out"))
    line = lambda d: Counter((r.doc_id, r.text) for r in d.collect())
    assert line(back) == line(df)
    assert len(list((tmp_path / "out").glob("shard=*/*.parquet"))) > 4  # the hot key's shard is several files


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(registry.oracle_sql()["op13_sharding"])
    names = [c[0] for c in found.description]
    got = registry.queries()["op13_sharding"](spark, SF).select(*names).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, found.fetchall()))
