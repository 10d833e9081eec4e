"""Relational operators over books: sections, search, chunks, progress, joins that look things up."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

CHUNK_CHARS = 8000
#: Tags that must not end a chunk, and tags that count as one piece.
NEVER_LAST = frozenset("H1 H2 H3 H4 H5 H6 HR".split())
ATOMIC = frozenset("TABLE PRE OL UL DL FIGURE BLOCKQUOTE SVG MATH".split())
#: Up to so many rows a lookup side is broadcast; its size is counted first.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast if it is known to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first by explicit ordinals (dropDuplicates has no order). A minimum, so it is combined
    before the shuffle and no window holds a hot key."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, *[f"best.{c}" for c in (*order, *rest)]).select(*df.columns)


def text_sections(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, section_id, heading, n_paragraphs, paragraphs) of plain texts; a heading starts a section.

    A text's blocks stay in its row: headings are numbered and the runs between them cut out once, without a shuffle
    and in time that grows with the text alone. (Exploding an array of one computes it once.)"""
    none = F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.array().cast("array<string>").alias("paragraphs")))
    cut = df.select(key, F.explode(F.array(F.coalesce(C.blocks(text), F.array().cast("array<string>")))).alias("b"))
    marks = F.filter(F.transform("b", lambda x, i: F.when(C.is_heading(x), i + 1)), lambda i: i.isNotNull())
    cut = cut.select(key, "b", F.explode(F.array(F.concat(F.array(F.lit(0)), marks))).alias("edges"))

    def section(edge, k):
        stop = F.coalesce(F.get("edges", k + 1) - 1, F.size("b"))
        return F.struct(F.when(edge > 0, C.collapse(F.get("b", edge - 1))).alias("heading"), F.slice("b", edge + 1, stop - edge).alias("paragraphs"))

    found = cut.select(key, F.explode(F.array(F.transform("edges", section))).alias("found"))
    kept = F.filter("found", lambda s: s["heading"].isNotNull() | (F.size(s["paragraphs"]) > 0))
    kept = F.when(F.size(kept) > 0, kept).otherwise(none)
    return found.select(key, F.posexplode(kept).alias("ord", "s")).select(
        key, F.concat(F.lit("s"), F.col("ord").cast("string")).alias("section_id"), F.col("s.heading").alias("heading"),
        F.size("s.paragraphs").cast("long").alias("n_paragraphs"), F.col("s.paragraphs").alias("paragraphs"),
    )


def section_markup(heading: Column, paragraphs: Column) -> Column:
    paragraph = lambda p: C.trim(F.regexp_replace(F.regexp_replace(p, f"[{C.SPACE}]*\\n[{C.SPACE}]*", " "), "[ \\t]+", " "))
    body = F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), C.escape_text(paragraph(p)), F.lit("</p>"))), "")
    title = F.when(heading.isNotNull(), F.concat(F.lit("<h2>"), C.escape_text(heading), F.lit("</h2>"))).otherwise("")
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><meta charset="UTF-8"/></head><body>'),
        title, body, F.lit("</body></html>"),
    )


def search_sections(sections: DataFrame, query: str, key: str, section: str, index: str, text: str, most: int | None = None, bare: bool = False) -> DataFrame:
    """Hits of every section, one row each; of at most ``most`` a section; ``bare`` without context and position. ASCII sections without the query never reach
    Python; others leave it as empty arrays and never reach the explode."""
    hits = C.search(F.col(text), F.lit(query), F.col(section).cast("string"), F.col(index).cast("int"), F.lit(most).cast("int"))
    if bare:
        hits = C.search_places(F.col(text), F.lit(query), F.lit(most).cast("int"))
    return sections.filter(C.may_hold(F.col(text), query)).select(key, section, F.explode(hits).alias("hit")).select(key, section, "hit.*")


def first_hits(sections: DataFrame, query: str, key: str, section: str, index: str, text: str, n: int) -> DataFrame:
    """The first ``n`` hits of each book in reading order: every section's scan stops at n, and the rank is limited
    before the shuffle, so a book sends at most n rows a task."""
    hits = search_sections(sections, query, key, section, index, text, n)
    reading = Window.partitionBy(key).orderBy("section_index", "hit_ord")
    return hits.withColumn("nth", F.row_number().over(reading)).filter(F.col("nth") <= n)


def pack(nodes: list[tuple[str, int]], budget: int = CHUNK_CHARS) -> tuple[list[tuple[int, int, int]], dict]:
    """Chunks (first node, end, chars) of (tag, chars) nodes, and the counters of the packing."""
    stats = {"top_level_nodes": len(nodes), "oversized": 0, "largest": max((c for _, c in nodes), default=0), "headings_deferred": 0, "atomic_oversized": 0, "bare_text": sum(t == "#text" for t, _ in nodes)}
    chunks, lo, chars = [], 0, 0
    for i, (tag, size) in enumerate(nodes):
        if size >= budget:
            stats["oversized"] += 1
            stats["atomic_oversized"] += tag in ATOMIC
            chunks += [(lo, i, chars)] * (i > lo) + [(i, i + 1, size)]
            lo, chars = i + 1, 0
            continue
        if chars > 0 and chars + size > budget:
            cut = i
            while cut - lo > 1 and nodes[cut - 1][0] in NEVER_LAST:
                cut -= 1
            moved = sum(c for _, c in nodes[cut:i])
            stats["headings_deferred"] += i - cut
            chunks.append((lo, cut, chars - moved))
            lo, chars = cut, moved
        chars += size
    chunks += [(lo, len(nodes), chars)] * (len(nodes) > lo)
    return chunks, stats


def chunk_ranges(nodes: DataFrame, key: str, order: str, tag: str, chars: str, budget: int = CHUNK_CHARS) -> DataFrame:
    """(key, chunk, first_node, n_nodes, chars, start, end): chunks tile each section's text. A section's nodes are
    the unit of work, as its order decides."""
    schema = T.StructType([nodes.schema[key], *[T.StructField(n, T.LongType()) for n in ("chunk", "first_node", "n_nodes", "chars", "start", "end")]])
    kind = nodes.select(key).schema[0]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        found, _ = pack(list(zip(table[tag].to_pylist(), table[chars].to_pylist())), budget)
        start, rows = 0, []
        for k, (lo, hi, size) in enumerate(found):
            rows.append((k, lo, hi - lo, size, start, start + size))
            start += size
        cols = list(zip(*rows)) if rows else [[]] * 6
        own = pa.array([table[key][0].as_py()] * len(rows), table.schema.field(key).type)
        return pa.table([own, *[pa.array(c, pa.int64()) for c in cols]], names=[kind.name, "chunk", "first_node", "n_nodes", "chars", "start", "end"])

    return nodes.groupBy(key).applyInArrow(run, schema)


def chunk_stats(nodes: DataFrame, key: str, order: str, tag: str, chars: str, budget: int = CHUNK_CHARS) -> DataFrame:
    """(key, and the counters of the packing) of each section's nodes."""
    names = list(pack([], budget)[1])
    schema = T.StructType([nodes.schema[key], *[T.StructField(n, T.LongType()) for n in names]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        _, stats = pack(list(zip(table[tag].to_pylist(), table[chars].to_pylist())), budget)
        return pa.table([table[key][:1], *[pa.array([stats[n]], pa.int64()) for n in names]], names=[key, *names])

    return nodes.groupBy(key).applyInArrow(run, schema)


def nearest_rank(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, one column a share): the value at ``floor(share * n)`` of the key's sorted values. Equal values are
    counted before anything is sorted, so a key costs as many rows as it has different values."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(key)
    upto = F.sum("_n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(own))
    at = lambda share: F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.lit(share)))
    return ranked.groupBy(key).agg(*[F.min(F.when(F.col("_upto") > at(q), F.col(value))).alias(n) for n, q in shares.items()])


def prose(text: Column) -> Column:
    """Paragraphs of a digitised book that are prose: between the markers, of 120 characters or more, not all in
    capitals, neither headings nor notes of those who made the file."""
    start, end = F.instr(text, "*** START OF THE PROJECT GUTENBERG EBOOK"), F.instr(text, "*** END OF THE PROJECT GUTENBERG EBOOK")
    line = F.instr(F.substring(text, start, F.length(text)), "\n")
    first = F.when((start == 0) | (line == 0), F.lit(1)).otherwise(start + line)
    last = F.when(end == 0, F.length(text) + 1).otherwise(end)
    body = F.substring(text, first, F.greatest(last - first, F.lit(0)))
    clean = F.transform(F.split(body, r"\r?\n[ \t]*\r?\n"), lambda p: F.trim(F.replace(F.regexp_replace(p, f"[{C.SPACE}]+", " "), F.lit("_"), F.lit(""))))
    #: How paragraphs that are no prose begin, and what they hold.
    begins, holds = "(?i)^(chapter|contents|illustrations|list of|produced by|transcriber)", "(?i)project gutenberg|etext|proofread"
    return F.filter(clean, lambda p: (C.u16_length(p) >= 120) & (p != F.upper(p)) & ~p.rlike(begins) & ~p.rlike(holds))


def containing(offsets: DataFrame, ranges: DataFrame, key: str, offset: str, start: str = "start", end: str = "end") -> DataFrame:
    """Offsets with the range that holds them, as an as-of join without a nested loop: starts and offsets are merged
    in order within each key and the last start is carried forward."""
    left = offsets.select(key, F.col(offset).alias("at"), F.lit(1).alias("kind"), F.struct(*offsets.columns).alias("row"), F.lit(None).cast(ranges.select(F.struct("*")).schema[0].dataType).alias("range"))
    right = ranges.select(key, F.col(start).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.struct(*ranges.columns).alias("range"))
    order = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("range", F.last("range", ignorenulls=True).over(order))
    rest = [c for c in ranges.columns if c != key]
    hit = both.filter("kind = 1").filter(F.col("at") < F.col(f"range.{end}"))
    return hit.select(*[f"row.{c}" for c in offsets.columns], *[f"range.{c}" for c in rest])


def tally(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def word_stream(text: Column) -> Column:
    """Words of letters and digits with inner apostrophes, lower-cased, soft hyphens dropped, quotes folded, of a text
    in its compatibility form (``columns.nfkc``, where the caller's text may need it)."""
    clean = F.translate(F.lower(text), "’‘\u00ad", "''")
    return F.regexp_extract_all(clean, F.lit(r"([\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*)"), F.lit(1))


def window_score(words: Column, other: Column, samples: int = 20, size: int = 25) -> Column:
    """Share of windows of words, taken evenly from the middle 80 %, that the other words hold in a row."""
    n = F.size(words)
    lo, hi = F.floor(n * 0.1), F.floor(n * 0.9) - size
    whole = F.concat(F.lit(" "), F.array_join(other, " "), F.lit(" "))
    at = lambda i: (lo + F.floor((hi - lo) * i / F.lit(samples))).cast("int")
    window = lambda i: F.concat(F.lit(" "), F.array_join(F.slice(words, at(i) + 1, size), " "), F.lit(" "))
    held = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda a, i: a + F.contains(w, window(i)).cast("int"))
    found = F.get(F.transform(F.array(whole), held), F.lit(0))  # a lambda's argument: the joined text is made once
    return F.when(hi > lo, found / F.lit(float(samples))).otherwise(F.lit(0.0))


def column_width(width: Column, gap: Column, columns: Column) -> Column:
    return (width - 2 * gap - (columns - 1) * gap) / columns


def book_fraction(index: Column, fraction: Column, sections: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (index + fraction) / sections))


def place_of_fraction(fraction: Column, sections: Column, pages: Column) -> tuple[Column, Column]:
    """(section index, page) of a fraction of the book."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * sections
    index = F.least(F.floor(scaled), sections - 1)
    return index, F.floor((scaled - index) * (pages - 1) + 0.5)
