"""Late events of a stream are replayed in their places; those beyond the watermark are dropped."""

import random

import pandas as pd

from pyspark.sql import functions as F

from quire.operators import reader
from quire.streaming import late


def test_late_events_are_replayed_in_their_places(spark, tmp_path):
    rng = random.Random(8)
    verbs = ["next", "prev", "link", "back", "end", "start", "bad"]
    rows = [(s, 1_000_000 + 60 * k, k, rng.choice(verbs), rng.choice([None, 0, 1, 2, 9])) for s in range(4) for k in range(60)]
    rows += [(1, 1_000_000 + 60 * 30, 1000, "end", None), (1, 1_000_000 + 60 * 30, 999, "link", 1)]  # equal times: by number
    schema = "session long, at long, seq long, verb string, target int"
    batches = [[] for _ in range(6)]
    for r in rows:
        batches[min(5, (r[1] - 1_000_000) // 600 + rng.choice([0, 0, 1]) * (r[1] < 1_003_000))].append(r)
    batches.append([(0, 1_000_000 + 60 * 1000, 2000, "next", None)])  # moves the watermark on
    batches.append([(2, 1_000_000, 3000, "end", None)])  # an hour too late
    for part in batches:
        spark.createDataFrame(part, schema).select("session", F.timestamp_seconds("at").alias("ts"), "seq", "verb", "target").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kind = spark.read.parquet(str(tmp_path / "in")).schema
    with late.rocksdb(spark):
        stream = late.replay_stream_in_order(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), [3, 2, 4], "30 minutes")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.conf.get(late.PROVIDER, "").find("RocksDB") < 0
    got = spark.read.schema(reader.NAVIGATION).parquet(str(tmp_path / "out"))
    want = reader.replay(spark.createDataFrame(rows, schema).withColumn("seq", F.when(F.col("seq") < 900, F.col("seq") * 10).otherwise(F.col("seq") - 999 + 301)).drop("at"), [3, 2, 4])
    own = got.withColumn("seq", F.when(F.col("seq") < 900, F.col("seq") * 10).otherwise(F.col("seq") - 999 + 301))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.select(*own.columns).collect()))


class _Counted:
    """Lists, values and timers of one part as a state store has them; calls are counted."""

    def __init__(self):
        self.calls, self.timers, self.held = 0, set(), {}

    def getListState(self, name, schema):  # noqa: N802
        return _Counted._State(self, name)

    getValueState = getListState  # noqa: N815

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.discard(ms)

    class _State:
        def __init__(self, store, name):
            self.store, self.name = store, name

        def _do(self, *value):
            self.store.calls += 1
            self.store.held[self.name] = value[0]

        update = put = _do

        def exists(self):
            return self.get() is not None

        def get(self):
            self.store.calls += 1
            return self.store.held.get(self.name) or ([] if self.name == "waiting" else None)

        def clear(self):
            self._do(None)

        def appendValue(self, value):  # noqa: N802
            self._do([*self.get(), value])


def test_calls_to_the_state_store_follow_batches_and_not_events():
    store = _Counted()
    part = late.InOrder(late.heard, ["session", "seq", "kind"])
    part.init(store)
    told = []
    for k in range(4):
        at = [1000 * k + (37 * i) % 1000 for i in range(500)]
        frame = pd.DataFrame({"event_key": [f"[{m % 5}]" for m in at], "event_ms": at, "event_seq": at, "event_json": ['{"seq": %d, "kind": "%s"}' % (m, "selection" if m % 3 else "clear") for m in at]})
        part.handleInputRows((0,), iter([frame]), None)
        now = 1000 * k + 499 if k < 3 else 10_000
        for ms in [t for t in sorted(store.timers) if t <= now]:
            store.timers.discard(ms)
            told += [tuple(r) for f in part.handleExpiredTimer((0,), type("", (), {"getCurrentWatermarkInMs": lambda self: now})(), None) for r in f.itertuples(index=False)]
    want = []
    for s in range(5):
        last = None
        for m in sorted(1000 * k + (37 * i) % 1000 for k in range(4) for i in range(500)):
            if m % 5 == s:
                kind = "selection" if m % 3 else "clear"
                if kind == "selection" or last == "selection":
                    want.append((s, m, kind))
                last = kind
    assert sorted(told) == sorted(want) and len(want) > 1000
    assert store.calls < 100 and not store.timers and not store.held["waiting"]
