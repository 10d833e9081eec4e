"""Pages of chunks, boxes under a tap, clipped rectangles, and links that name a section: layout's relational parts.

What only a browser can measure (widths, boxes) comes in as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .books import containing, first_wins, small

CELL = 64.0


def pages_of(width: Column, gap: Column, stride: Column) -> Column:
    """Pages that a chunk of a measured width takes."""
    return F.when(width <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil((width + gap) / stride))).cast("long")


def page_ranges(chunks: DataFrame, key: str, order: str, pages: str) -> DataFrame:
    """The chunks with ``first_page``, the running sum of the pages before, and ``end_page``. A section's chunks are
    one window."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(pages).over(before)
    return chunks.withColumn("end_page", end).withColumn("first_page", F.col("end_page") - F.col(pages))


def chunk_at_page(asked: DataFrame, ranges: DataFrame, key: str, page: str) -> DataFrame:
    """Asked pages with the chunk that paints them and the page within it; pages beyond the end have none."""
    return containing(asked, ranges, key, page, "first_page", "end_page").withColumn("local_page", F.col(page) - F.col("first_page"))


def chapter_fraction(page: Column, total: Column) -> Column:
    return F.when(total <= 1, F.lit(0.0)).otherwise(page / (total - 1))


def tapped(taps: DataFrame, boxes: DataFrame, tap: str = "tap_id") -> DataFrame:
    """(tap, id, order, rank) of the boxes (id, order, left, top, right, bottom) that hold a tap (x, y), newest first.

    Both sides meet in cells of a grid, so a tap is compared with the boxes near it and not with all; a box in
    several cells, or a decoration of several boxes, is one hit. Taps at the same points have the same hits: these are found and
    ranked once for all of them, so what is sorted grows with the boxes and not with the result, which can be quadratic."""
    cell = lambda v: F.floor(v / CELL)
    spread = lambda lo, hi: F.explode(F.sequence(cell(lo), cell(hi)))
    placed = boxes.filter("left < right AND top < bottom").select("*", spread(F.col("left"), F.col("right")).alias("cx")).select("*", spread(F.col("top"), F.col("bottom")).alias("cy"))
    held = taps.groupBy(tap).agg(F.sort_array(F.collect_set(F.struct("x", "y"))).alias("points"))
    asked = held.select("points").distinct().select("points", F.inline("points")).withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))})
    inside = (F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    newest = Window.partitionBy("points").orderBy(F.desc("order"), "id")
    hits = asked.join(placed, ["cx", "cy"]).filter(inside).select("points", F.struct("id", "order").alias("hit"), "id", "order")
    ranked = hits.select("*", F.dense_rank().over(newest).alias("rank"), F.lag("hit").over(newest).alias("before")).filter(~F.col("hit").eqNullSafe(F.col("before")))
    return held.join(ranked, "points").select(tap, "id", "order", "rank")


def round2(n: Column) -> Column:
    """Two decimals, halves up."""
    return F.floor(n * 100 + 0.5) / 100


def clipped(boxes: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """The boxes' visible parts as x, y, width, height; what lies outside is gone."""
    edge = {"left": F.greatest, "top": F.greatest, "right": F.least, "bottom": F.least}
    clip = {"left": left, "top": top, "right": right, "bottom": bottom}
    cut = boxes.withColumns({c: round2(f(F.col(c), F.lit(clip[c]))) for c, f in edge.items()}).filter("right - left > 0 AND bottom - top > 0")
    rest = [c for c in boxes.columns if c not in edge]
    return cut.select(*rest, F.col("left").alias("x"), F.col("top").alias("y"), round2(F.col("right") - F.col("left")).alias("width"), round2(F.col("bottom") - F.col("top")).alias("height"))


def union_rect(rects: DataFrame, key: str) -> DataFrame:
    """The rectangle around all rectangles of a key."""
    found = rects.groupBy(key).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("r"), F.max(F.col("y") + F.col("height")).alias("b"))
    return found.select(key, "x", "y", round2(F.col("r") - F.col("x")).alias("width"), round2(F.col("b") - F.col("y")).alias("height"))


def last_segment(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"(?s)\?.*$", ""), r"(?s)([^/]*)$", 1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def href_sections(hrefs: DataFrame, sections: DataFrame, toc: DataFrame, key: str = "href_id") -> DataFrame:
    """(key, section_index) of links (key, path, fragment): the section of that id; else of the id that the last
    segment is; else the first section whose id or its last segment agrees, extensions aside; else the section of
    the first contents entry with the fragment; else -1.

    Each rung is a key of an equi-join, ranked; the sections' names are one side, four rows a section."""
    segment = last_segment(F.col("path"))
    stem = without_extension(segment)
    rung = lambda rank, kind, name: F.struct(F.lit(rank).alias("rank"), F.concat(F.lit(kind), name).alias("name"))
    asked = hrefs.select(key, F.inline(F.array(rung(0, "id:", F.col("path")), rung(1, "id:", segment), rung(2, "any:", segment), rung(2, "any:", stem), rung(2, "stem:", stem))))
    tail = last_segment(F.col("section_id"))
    names = F.array(*[F.concat(F.lit(k), n) for k, n in (("id:", F.col("section_id")), ("any:", F.col("section_id")), ("any:", tail), ("stem:", without_extension(tail)))])
    named = sections.select("section_index", F.explode(F.array_distinct(names)).alias("name"))
    direct = asked.join(small(named), "name").select(key, "rank", "section_index")
    first = first_wins(toc.filter("fragment IS NOT NULL").select("fragment", "node_id", "section_id"), ["fragment"], ["node_id"])
    listed = first.join(sections.select("section_id", "section_index"), "section_id", "left").select("fragment", F.coalesce("section_index", F.lit(-1)).alias("section_index"))
    by_toc = hrefs.select(key, "fragment").join(small(listed), "fragment").select(key, F.lit(3).alias("rank"), "section_index")
    best = direct.unionByName(by_toc).groupBy(key).agg(F.min(F.struct("rank", "section_index")).alias("best"))
    return hrefs.select(key).join(best, key, "left").select(key, F.coalesce("best.section_index", F.lit(-1)).cast("long").alias("section_index"))


def without_boilerplate(text: Column) -> Column:
    """The text between the markers that digitised books carry; as it is where they are missing."""
    body = F.regexp_replace(text, r"(?is)^.*?\*\*\*\s*start of (?:the|this) project gutenberg[^*]*\*\*\*", "")
    return F.regexp_replace(body, r"(?is)\*\*\*\s*end of (?:the|this) project gutenberg.*$", "")


def appearance_diff(before: Column, after: Column, fields: list[str]) -> Column:
    """Names of the fields (of two structs) that differ, nulls equal to each other."""
    return F.filter(F.array(*[F.when(~before[f].eqNullSafe(after[f]), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
