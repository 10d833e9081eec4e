"""Queries over archives that are read by ranges: every document is written into one of sixteen, and one entry of twenty
is asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import ranges as R
from .queries import _table

_ASKED = "07/"


def _archives(spark, sf_dir):
    name = F.format_string("%02d/%d.txt", F.pmod("doc_id", F.lit(20)), "doc_id")
    rows = _table(spark, sf_dir, "documents").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    rows = rows.select(F.concat(F.lit("a"), F.pmod(F.floor(F.col("doc_id") / 20), F.lit(16)).cast("string")).alias("archive"), name.alias("name"), F.col("text").cast("binary").alias("content"))
    path = R.scratch(spark)
    R.write_archives(rows, path, compression="none")
    spark.conf.set(R.PUSHDOWN, "true")
    return R.read_archives(spark, path)


def _archive(path):
    return F.regexp_extract(path, r"([^/]+)-[0-9a-f]{32}\.zip$", 1)


def archive_range_entries(spark, sf_dir):
    """The asked entries: the filter on names reaches the source, other entries are not read."""
    found = _archives(spark, sf_dir).filter(F.startswith("name", F.lit(_ASKED)))
    return found.select(_archive(F.col("path")).alias("archive"), "name", F.col("method").cast("long").alias("method"), F.md5("content").alias("md5"), "bytes_read", "error")


def archive_range_bytes(spark, sf_dir):
    """What the asked entries cost of each archive, its directory included, against the archive's size."""
    found = _archives(spark, sf_dir).filter(F.startswith("name", F.lit(_ASKED)))
    total = F.sum("bytes_read") + F.max("directory_bytes")
    return found.groupBy(_archive(F.col("path")).alias("archive")).agg(F.count("*").alias("entries"), total.alias("read_bytes"), F.max("archive_bytes").alias("archive_bytes"))


QUERIES = {f.__name__: f for f in (archive_range_entries, archive_range_bytes)}
#: Of the written form: a record of 46 bytes and the name an entry in the directory, 30 and the name before the data, 16
#: after it, 22 at the end. A reader looks at the last 1,024 bytes first.
_D = """WITH d AS (SELECT 'a' || (doc_id // 20 % 16) AS archive, printf('%02d/%d.txt', doc_id % 20, doc_id) AS name, text, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) """
ORACLES = {
    "archive_range_entries": _D + "SELECT archive, name, 0::BIGINT AS method, md5(text) AS md5, 30 + n AS bytes_read, CAST(NULL AS VARCHAR) AS error FROM d WHERE starts_with(name, '07/')",
    "archive_range_bytes": _D + """, a AS (SELECT archive, sum(46 + length(name)) AS table_bytes, sum(76 + 2 * length(name) + 16 + n) + 22 AS archive_bytes,
        sum(30 + n) FILTER (starts_with(name, '07/')) AS entry_bytes, count(*) FILTER (starts_with(name, '07/')) AS entries FROM d GROUP BY archive)
        SELECT archive, entries, CAST(entry_bytes + least(1024, archive_bytes) + CASE WHEN table_bytes + 22 > 1024 THEN table_bytes ELSE 0 END AS BIGINT) AS read_bytes, CAST(archive_bytes AS BIGINT) AS archive_bytes
        FROM a WHERE entries > 0""",
}
