"""Replay of reader events over a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.reader import NAVIGATION, Reader


def replay_stream(events: DataFrame, pages: list[int]) -> DataFrame:
    """Sessions' events in order over a stream: place and stack are the session's state. Events are ordered within a
    micro-batch; one that arrives after later ones of its session were replayed is replayed when it arrives."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        section, page, stack = state.get if state.exists else (0, 0, "[]")
        reader, rows = Reader(pages, (section, page), json.loads(stack)), []
        for e in pd.concat(list(batches)).sort_values("seq").itertuples():
            status = reader.apply(e.verb, None if pd.isna(e.target) else int(e.target))
            rows.append((key[0], e.seq, *reader.place, len(reader.stack), status))
        state.update((*reader.place, json.dumps(reader.stack)))
        yield pd.DataFrame(rows, columns=["session", "seq", "section", "page", "depth", "status"])

    kept = T.StructType([T.StructField("section", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("stack", T.StringType())])
    return events.groupBy("session").applyInPandasWithState(run, NAVIGATION, kept, "append", "NoTimeout")
