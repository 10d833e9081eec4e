"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.ranges import scratch
from ..streaming import late
from .marks import ORACLES as _MARKS_SQL
from .queries import _table

#: Micro-batches in which the events come; every seventh event comes one batch late, every eleventh two.
BATCHES = 6
#: Events a file of a micro-batch, and events of a part of the keys, about.
FILE_EVENTS, PART_EVENTS = 500_000, 20_000


def selection_reports_late(spark, sf_dir):
    """Selection reports of all events out of a stream whose micro-batches bring some events late."""
    e = F.col("event_id")
    events = _table(spark, sf_dir, "events").filter("ts IS NOT NULL AND user_id IS NOT NULL").select(
        F.col("user_id").cast("long").alias("session"), F.timestamp_seconds(e * 10 + 1_000_000_000).alias("ts"), e.cast("long").alias("seq"),
        F.when(e % 3 == 0, "selection").when(e % 5 < 3, "clear").otherwise("other").alias("kind"),
    )
    events = events.filter("kind <> 'other'")
    most = (events.agg(F.max("seq")).first()[0] or 0) + 1
    step = -(-most // BATCHES)
    came = F.floor(F.col("seq") / step) + F.when(F.col("seq") % 11 == 0, 2).when(F.col("seq") % 7 == 0, 1).otherwise(0)
    folder = scratch(spark)
    schema = events.schema
    files = 1 + step // FILE_EVENTS  # as many in every micro-batch
    for k in range(BATCHES + 2):
        events.filter(came == k).repartition(files).write.mode("append").parquet(f"{folder}/in")
    end = spark.createDataFrame([(-1, (most + 10 * step) * 10 + 1_000_000_000, -1, "other")], "session long, at long, seq long, kind string")
    end.select("session", F.timestamp_seconds("at").alias("ts"), "seq", "kind").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    with late.rocksdb(spark):
        stream = late.selection_reports_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), f"{3 * step * 10} seconds", max(late.PARTS, most // PART_EVENTS))
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema("session long, seq long, kind string").parquet(f"{folder}/out")


QUERIES = {"selection_reports_late": selection_reports_late}
ORACLES = {"selection_reports_late": _MARKS_SQL["selection_reports"]}
