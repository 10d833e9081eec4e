"""Events of a stream in the order of their own times, late ones in their places.

A key's events wait in the state of its part (keys are dealt by hash) until the watermark has passed them; a timer at the
earliest one's time then takes all that are due, in order, through a step function with the key's own state. An event that is late, but not beyond the watermark, is
therefore handled where it belongs, whatever micro-batch brings it; one beyond the watermark is dropped by Spark and
counted in the query's progress. State holds what the watermark's delay spans and no more.

``transformWithState`` needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.reader import NAVIGATION, Reader

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: (state or None, event) -> (state, rows): state and events are what JSON can hold.
Step = Callable[[object, dict], tuple[object, list[tuple]]]


#: Parts that the keys are dealt into, each with one state; a caller with more events takes more.
PARTS = 64


class InOrder(StatefulProcessor):
    """Holds the events of a part's keys (columns event_key, event_ms, event_seq, event_json) until they are due.

    A part's batch is one entry of the waiting list, and one timer stands for the earliest event that waits: what an event costs
    is its own handling, not calls to the state store."""

    def __init__(self, step: Step, columns: list[str]):
        self.step, self.columns = step, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events string")
        self.kept = handle.getValueState("kept", "value string")
        self.timer = handle.getValueState("timer", "ms long")

    def _due_at(self, ms: int | None) -> None:
        """The part's timer stands at ``ms``, or there is none."""
        self.timer.update((ms,)) if ms is not None else self.timer.clear()
        if ms is not None:
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            names = ("event_key", "event_ms", "event_seq", "event_json")
            self.waiting.appendValue((json.dumps(list(zip(*[frame[c].tolist() for c in names]))),))
            first = min(int(frame["event_ms"].min()), first if first is not None else 1 << 62)
        if first is not None:
            stands = self.timer.get()[0] if self.timer.exists() else None
            if stands is None or first < stands:
                if stands is not None:
                    self.handle.deleteTimer(stands)
                self._due_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for (events,) in self.waiting.get():
            for event in json.loads(events):
                (due if event[1] <= now else rest).append(event)
        kept = json.loads(self.kept.get()[0]) if self.kept.exists() else {}
        out: list[tuple] = []
        for of, _, _, event in sorted(due):  # equal times and numbers: in the order of their contents
            kept[of], rows = self.step(kept.get(of), json.loads(event))
            out += [(*json.loads(of), *r) for r in rows]
        if due:
            self.kept.update((json.dumps(kept),))
            self.waiting.put([(json.dumps(rest),)]) if rest else self.waiting.clear()
        self._due_at(min((e[1] for e in rest), default=None))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, time: str, seq: str, delay: str, step: Step, schema: str, parts: int = PARTS) -> DataFrame:
    """A stream of the rows that ``step`` makes of each key's events in the order of (time, seq); ``schema`` begins with the
    key, which JSON can hold. Rows without a key or time are left out. Keys are dealt into ``parts`` by hash; the number stays
    the same for a stream's life."""
    columns = [f.name for f in events.sparkSession.createDataFrame([], schema).schema]
    held = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    event = F.to_json(F.struct(*[c for c in events.columns if c not in (key, time)]), {"ignoreNullFields": "false"})
    own = F.to_json(F.array(key))
    rows = held.select(F.pmod(F.xxhash64(key), F.lit(parts)).alias("event_part"), own.alias("event_key"), time, F.unix_millis(time).alias("event_ms"), F.coalesce(F.col(seq).cast("long"), F.lit(-1)).alias("event_seq"), event.alias("event_json"))
    return rows.groupBy("event_part").transformWithStateInPandas(InOrder(step, columns), schema, "append", "EventTime")


def heard(state, event: dict):
    """Every selection, and a clear only behind a selection: what a host is told. The state is the last kind."""
    kind = event["kind"]
    told = kind == "selection" or kind == "clear" and state == "selection"
    return kind, [(event["seq"], kind)] if told else []


def selection_reports_stream(events: DataFrame, delay: str, parts: int = PARTS) -> DataFrame:
    """(session, seq, kind) of a stream of (session, ts, seq, kind), as ``marks.selection_reports`` gives them in batch."""
    return in_order(events, "session", "ts", "seq", delay, heard, "session long, seq long, kind string", parts)


def replay_stream_in_order(events: DataFrame, pages: list[int], delay: str) -> DataFrame:
    """Reader events (session, ts, seq, verb, target) replayed in the order of their times, as ``reader.replay`` does."""

    def step(state, event: dict):
        section, page, stack = state or (0, 0, [])
        reader = Reader(pages, (section, page), stack)
        status = reader.apply(event["verb"], event["target"])
        return (*reader.place, reader.stack), [(event["seq"], *reader.place, len(reader.stack), status)]

    return in_order(events, "session", "ts", "seq", delay, step, NAVIGATION)


@contextmanager
def rocksdb(spark: SparkSession):
    """The RocksDB state store for queries started within; the session's own setting afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
