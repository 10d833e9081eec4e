"""Queries over pages, taps, rectangles, links and host messages, with SQL that computes the same."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import layout as L
from .queries import _CHUNK_SQL, _table, chunk_ranges

GAP, STRIDE = 20.0, 300.0


def chunk_pages(spark, sf_dir):
    """Each chunk's pages, were its text as wide as it has characters, and the pages before it."""
    chunks = chunk_ranges(spark, sf_dir).select("conv_id", "chunk", L.pages_of(F.col("chars").cast("double"), F.lit(GAP), F.lit(STRIDE)).alias("pages"))
    return L.page_ranges(chunks, "conv_id", "chunk", "pages").select("conv_id", "chunk", "pages", "first_page", "end_page")


def page_chunk(spark, sf_dir):
    """The chunk of every page, the page within it, and the progress through the chapter."""
    ranges = chunk_pages(spark, sf_dir)
    total = ranges.groupBy("conv_id").agg(F.max("end_page").alias("total"))
    asked = total.select("conv_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total"))).alias("page"))
    found = L.chunk_at_page(asked, ranges, "conv_id", "page")
    return found.select("conv_id", "page", "chunk", "local_page", F.round(L.chapter_fraction(F.col("page"), F.col("total")), 9).alias("fraction"))


def _boxes(spark, sf_dir):
    i = F.col("doc_id")
    left, top = (i * 37 % 2000).cast("double"), (i * 53 % 1500).cast("double")
    return _table(spark, sf_dir, "documents").select(
        i.alias("id"), (i * 7 % 101).alias("order"), left.alias("left"), top.alias("top"), (left + 40 + (i % 5) * F.lit(10.125)).alias("right"), (top + 20 + (i % 7) * F.lit(9.0)).alias("bottom")
    )


_BOXES = "(SELECT doc_id AS id, doc_id * 7 % 101 AS o, CAST(doc_id * 37 % 2000 AS DOUBLE) AS l, CAST(doc_id * 53 % 1500 AS DOUBLE) AS t, doc_id * 37 % 2000 + 40 + (doc_id % 5) * 10.125::DOUBLE AS r, doc_id * 53 % 1500 + 20 + (doc_id % 7) * 9.0::DOUBLE AS b FROM documents)"


def tapped_decorations(spark, sf_dir):
    """Boxes under each page's point, newest first."""
    taps = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("tap_id"), (F.col("page_id") * 29 % 2000).cast("double").alias("x"), (F.col("page_id") * 31 % 1500).cast("double").alias("y"))
    return L.tapped(taps, _boxes(spark, sf_dir)).select("tap_id", "id", "order", F.col("rank").cast("long").alias("rank"))


def clipped_rects(spark, sf_dir):
    return L.clipped(_boxes(spark, sf_dir), 100.5, 80.25, 1500.0, 1200.125).select("id", "x", "y", "width", "height")


def union_rects(spark, sf_dir):
    rects = clipped_rects(spark, sf_dir).withColumn("own", F.col("id") % 50)
    return L.union_rect(rects, "own")


_ROUND = lambda x: f"floor(({x}) * 100 + 0.5) / 100"
_CLIPPED = f"""(SELECT id, l AS x, t AS y, {_ROUND("r - l")} AS width, {_ROUND("b - t")} AS height FROM (
  SELECT id, {_ROUND("greatest(l, 100.5::DOUBLE)")} AS l, {_ROUND("greatest(t, 80.25::DOUBLE)")} AS t, {_ROUND("least(r, 1500.0::DOUBLE)")} AS r, {_ROUND("least(b, 1200.125::DOUBLE)")} AS b FROM {_BOXES}) WHERE r - l > 0 AND b - t > 0)"""


def without_boilerplate(spark, sf_dir):
    wrapped = F.concat(F.lit("Front matter\n*** START OF THE PROJECT GUTENBERG EBOOK ONE ***"), "text", F.lit("*** end of this project gutenberg ebook ***\nterms"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(L.without_boilerplate(wrapped).cast("binary")).alias("md5"))


def appearance_changes(spark, sf_dir):
    """Turns of a conversation as states: which fields changed since the turn before."""
    from pyspark.sql import Window

    state = F.struct(F.col("role").alias("role"), F.length("text").alias("size"), F.substring("text", 1, 1).alias("initial"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", state.alias("now"))
    turns = turns.withColumn("before", F.lag("now").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("before IS NOT NULL")
    return turns.select("conv_id", "turn", F.array_join(L.appearance_diff(F.col("before"), F.col("now"), ["role", "size", "initial"]), ",").alias("changed"))


QUERIES = {f.__name__: f for f in (
    chunk_pages, page_chunk, tapped_decorations, clipped_rects, union_rects, without_boilerplate, appearance_changes,
)}
_PAGES_SQL = _CHUNK_SQL + f""", p AS (SELECT conv_id, chunk, CAST(greatest(1, ceil((chars + {GAP}) / {STRIDE})) AS BIGINT) AS pages FROM t),
q AS (SELECT *, CAST(sum(pages) OVER (PARTITION BY conv_id ORDER BY chunk) AS BIGINT) AS end_page FROM p)
"""
ORACLES = {
    "chunk_pages": _PAGES_SQL + "SELECT conv_id, chunk, pages, end_page - pages AS first_page, end_page FROM q",
    "page_chunk": _PAGES_SQL + ", z AS (SELECT conv_id, max(end_page) AS total FROM q GROUP BY conv_id), a AS (SELECT conv_id, total, unnest(range(0, total)) AS page FROM z) SELECT a.conv_id, page, chunk, page - (end_page - pages) AS local_page, CASE WHEN total <= 1 THEN 0.0 ELSE round(page / (total - 1)::DOUBLE, 9) END::DOUBLE AS fraction FROM a JOIN q ON a.conv_id = q.conv_id AND page >= end_page - pages AND page < end_page",
    "tapped_decorations": f"""WITH t AS (SELECT page_id AS tap_id, CAST(page_id * 29 % 2000 AS DOUBLE) AS x, CAST(page_id * 31 % 1500 AS DOUBLE) AS y FROM pages),
        h AS (SELECT DISTINCT tap_id, id, o FROM t JOIN {_BOXES} ON x >= l AND x < r AND y >= t AND y < b)
        SELECT tap_id, id, o AS "order", row_number() OVER (PARTITION BY tap_id ORDER BY o DESC, id) AS rank FROM h""",
    "clipped_rects": f"SELECT * FROM {_CLIPPED}",
    "union_rects": f"SELECT id % 50 AS own, min(x) AS x, min(y) AS y, {_ROUND('max(x + width) - min(x)')} AS width, {_ROUND('max(y + height) - min(y)')} AS height FROM {_CLIPPED} GROUP BY 1",
    "without_boilerplate": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "appearance_changes": """WITH t AS (SELECT conv_id, turn, role, length(text) AS size, substr(text, 1, 1) AS initial, lag(turn) OVER w AS b, lag(role) OVER w AS r0, lag(length(text)) OVER w AS s0, lag(substr(text, 1, 1)) OVER w AS i0
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN role IS DISTINCT FROM r0 THEN 'role' END, CASE WHEN size IS DISTINCT FROM s0 THEN 'size' END, CASE WHEN initial IS DISTINCT FROM i0 THEN 'initial' END], lambda x: x IS NOT NULL), ',') AS changed FROM t WHERE b IS NOT NULL""",
}
