"""Selections, decorations, points in text, and targets of navigation, as joins and aggregates over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import positions, unicode
from .books import place_of_fraction, small
from .layout import href_sections

RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _selected(text, start, end, section):
    units = unicode.Units(text)
    lo = max(0, start or 0)
    hi = max(lo, end or 0)
    quoted = units.cut(min(lo, units.size), min(hi, units.size))
    return positions.capture(units, lo, section or "", quote=len(unicode.Units(quoted).parts))


def _ranges(text, places):
    units, out = unicode.Units(text), []
    for p in places or []:
        found = positions.resolve(units, p["exact"], p["prefix"], p["suffix"], p["offset_g"])
        out.append(None if found is None else {"start": units.offset(found[0]), "end": units.offset(sum(found))})
    return out


#: (text, start, end, section): the position over a whole selected range of UTF-16 units.
position_of_range = C.kernel(_selected, C.POSITION)
#: (text, positions): where each is drawn, in UTF-16 units; null where it is not found.
drawn_ranges = C.kernel(_ranges, RANGES)


def selection_reports(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """The events that a host hears: every selection, and a clear only if a selection was heard since the last one."""
    last = F.lag(kind).over(Window.partitionBy(key).orderBy(order))
    return events.withColumn("_last", last).filter((F.col(kind) == "selection") | ((F.col(kind) == "clear") & (F.col("_last") == "selection"))).drop("_last")


def live_decorations(events: DataFrame, keys: list[str], order: str, verb: str, value: str) -> DataFrame:
    """(keys, value, order) of decorations in force: the last written value of each, placed where it was first drawn
    since it was last removed. Aggregates only, so no decoration's history is gathered."""
    removed = events.filter(F.col(verb) == "undecorate").groupBy(*keys).agg(F.max(order).alias("_gone"))
    drawn = events.filter(F.col(verb) == "decorate").join(removed, keys, "left").filter(F.col("_gone").isNull() | (F.col(order) > F.col("_gone")))
    return drawn.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def node_starts(nodes: DataFrame, key: str, order: str, chars: str) -> DataFrame:
    """The text nodes with ``start`` and ``end``: running sums of their lengths."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return nodes.withColumn("end", F.sum(chars).over(upto)).withColumn("start", F.col("end") - F.col(chars))


def offset_of_point(points: DataFrame, starts: DataFrame, key: str, order: str, local: str) -> DataFrame:
    """Offset in the section's text of points (key, node, local offset)."""
    return points.join(starts.select(key, order, "start"), [key, order]).withColumn("offset", F.col("start") + F.col(local)).drop("start")


def point_at_offset(offsets: DataFrame, starts: DataFrame, key: str, order: str, offset: str) -> DataFrame:
    """The node of each offset and the offset within it: the first node that ends at or after it; none beyond the
    text. Ends and offsets are merged backwards in order and the last end seen is carried, so nothing is paired."""
    node = F.struct(order, "start")
    left = offsets.select(key, F.col(offset).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_nth"), F.lit(None).cast(starts.select(node).schema[0].dataType).alias("_node"))
    right = starts.select(key, F.col("end").alias("_at"), F.lit(0).alias("_kind"), F.col(order).cast("long").alias("_nth"), node.alias("_node"))
    back = Window.partitionBy(key).orderBy(F.desc("_at"), "_kind", F.desc("_nth")).rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_node", F.last("_node", ignorenulls=True).over(back)).filter("_kind = 1 AND _node IS NOT NULL")
    return found.select(key, F.col("_at").alias(offset), F.col(f"_node.{order}").alias(order), (F.col("_at") - F.col("_node.start")).alias("local"))


def go_to(targets: DataFrame, sections: DataFrame, toc: DataFrame, key: str = "target_id") -> DataFrame:
    """(key, section_index, place) of targets (key, kind, fraction, href, section_id, fragment).

    Kinds: start, end, fraction, href, position, toc. section_index is -1 for what is not found and null for a
    fragment of the current section; place says where in it: first, last, page, fragment, position."""
    n = sections.count()
    href = F.col("href")
    path, mark = F.substring_index(href, "#", 1), F.contains(href, F.lit("#"))
    anchor = F.when(F.col("kind") == "href", F.when(mark, F.regexp_extract(href, "(?s)#(.*)$", 1))).otherwise(F.col("fragment"))
    asked = targets.withColumn("_path", path).withColumn("_anchor", anchor)
    links = asked.filter((F.col("kind") == "href") & (F.col("_path") != "")).select(key, F.col("_path").alias("path"), F.col("_anchor").alias("fragment"))
    via = href_sections(links, sections, toc, key).withColumnRenamed("section_index", "_via")
    named = small(sections.groupBy("section_id").agg(F.min("section_index").cast("long").alias("_named")))
    both = asked.join(named, "section_id", "left").join(via, key, "left")
    index, _ = place_of_fraction(F.col("fraction"), F.lit(n), F.lit(1))
    kind: Column = F.col("kind")
    section = (
        F.when(kind == "start", F.lit(0)).when(kind == "end", F.lit(n - 1)).when(kind == "fraction", index)
        .when(kind == "href", F.when(F.col("_path") != "", F.col("_via"))).otherwise(F.coalesce("_named", F.lit(-1)))
    )
    place = (
        F.when(kind == "end", "last").when(kind == "fraction", "page").when(kind == "position", "position")
        .when(kind.isin("href", "toc") & F.col("_anchor").isNotNull(), "fragment").otherwise("first")
    )
    section = section.cast("long") if n else F.lit(-1).cast("long")
    return both.select(key, section.alias("section_index"), place.alias("place")).withColumn("place", F.when(F.coalesce("section_index", F.lit(0)) >= 0, F.col("place")))
