"""Queries whose order or closure spans the whole corpus under one key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closure as K
from ..operators import packing as P
from ..operators import ranged as R
from .queries import _table


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "lang", F.length("text").cast("long").alias("size"))


def document_ranks(spark, sf_dir):
    """The rank of every document by length among all, and among those of its language."""
    by_all = R.ranked(_docs(spark, sf_dir), [], ["size", "doc_id"], "rank_all")
    return R.ranked(by_all, ["lang"], ["size", "doc_id"], "rank_lang").select("doc_id", "rank_all", "rank_lang")


_BUDGET = 8000
_SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def length_quantiles(spark, sf_dir):
    """Quantiles of the lengths of all documents, by exact ranks."""
    return R.quantiles(_docs(spark, sf_dir), [], "size", _SHARES)


def corpus_offsets(spark, sf_dir):
    """All documents as one long text: which document holds each thousandth character, one key holding every row."""
    docs = R.ranked(_docs(spark, sf_dir), [], ["doc_id"], "n")
    spans = _running(docs).select(F.lit("all").alias("axis"), "doc_id", F.col("start"), (F.col("start") + F.col("size")).alias("stop"))
    total = docs.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    asked = total.filter("total > 0").select(F.lit("all").alias("axis"), F.explode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(1000))).alias("at"))
    return R.containing_ranges(asked, spans, ["axis"], "at", "start", "stop").select("at", "doc_id", (F.col("at") - F.col("start")).alias("within"))


def _running(docs):
    """Each document's start: sizes before it, summed by blocks of ranks, and within a block."""
    from pyspark.sql import Window

    blocked = docs.withColumn("_block", F.floor(F.col("n") / 4096))
    sums = blocked.groupBy("_block").agg(F.sum("size").alias("_size"))
    lifts = sums.select("_block", F.coalesce(F.sum("_size").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lift"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("_block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocked.withColumn("_inside", inside).join(lifts, "_block").withColumn("start", F.col("_lift") + F.col("_inside"))


def corpus_chunks(spark, sf_dir):
    """All documents as the nodes of one section, every fifth a heading, packed into chunks."""
    nodes = _docs(spark, sf_dir).select(F.lit("all").alias("axis"), "doc_id", F.when(F.col("doc_id") % 5 == 0, "H2").otherwise("P").alias("tag"), "size")
    return P.packed(nodes, ["axis"], "doc_id", "tag", "size", _BUDGET).drop("axis")


def _linked(spark, sf_dir):
    """Documents as items of books of fifty: each falls back to another one of its book, or to none; English ones stop."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("doc_id") / 50).alias("book"), F.pmod("doc_id", F.lit(50)).alias("item"))
    to = F.when(F.col("item") % 11 != 4, F.pmod(F.col("item") * F.col("item") + F.col("item") * 3 + F.pmod("book", F.lit(5)) + 1, F.lit(53)))
    return docs.withColumn("fallback", to)


def fallback_targets(spark, sf_dir):
    """Where the fallbacks of every item lead: to the first English document, to a dead end, or round in a circle."""
    found = K.follow(_linked(spark, sf_dir), ["book"], "item", "fallback", F.coalesce(F.col("lang") == "en", F.lit(False)))
    return found.select("book", "item", "target", "status")


def import_closure(spark, sf_dir):
    """Every item that each item's imports reach, in how few steps; those that reach themselves stand on a cycle."""
    return K.reachable(_linked(spark, sf_dir), ["book"], "item", "fallback").select("book", "item", "fallback", F.col("steps").cast("long").alias("steps"))


QUERIES = {f.__name__: f for f in (document_ranks, length_quantiles, corpus_offsets, corpus_chunks, fallback_targets, import_closure)}
_D = "WITH RECURSIVE d AS (SELECT doc_id, lang, length(text) AS size FROM documents WHERE text IS NOT NULL)"
_L = """WITH RECURSIVE l AS (SELECT doc_id // 50 AS book, doc_id % 50 AS item, coalesce(lang = 'en', false) AS stops,
  CASE WHEN doc_id % 50 % 11 <> 4 THEN ((doc_id % 50) * (doc_id % 50) + (doc_id % 50) * 3 + (doc_id // 50) % 5 + 1) % 53 END AS fallback FROM documents),
"""
ORACLES = {
    "document_ranks": _D + " SELECT doc_id, row_number() OVER (ORDER BY size, doc_id) - 1 AS rank_all, row_number() OVER (PARTITION BY lang ORDER BY size, doc_id) - 1 AS rank_lang FROM d",
    "length_quantiles": _D + ", s AS (SELECT list(size ORDER BY size) AS l FROM d) SELECT " + ", ".join(f"l[least(len(l) - 1, floor(len(l) * {q}::DOUBLE)::BIGINT) + 1] AS {n}" for n, q in _SHARES.items()) + " FROM s",
    "corpus_offsets": _D + """, s AS (SELECT doc_id, size, sum(size) OVER (ORDER BY doc_id) - size AS start FROM d), a AS (SELECT unnest(range(0, (SELECT sum(size) FROM d)::BIGINT, 1000)) AS pos)
        SELECT pos AS at, doc_id, CAST(pos - start AS BIGINT) AS within FROM a JOIN s ON pos >= start AND pos < start + size""",
    "corpus_chunks": _D + f""", n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, size AS c, doc_id % 5 = 0 AS h, sum(size) OVER (ORDER BY doc_id) - size AS s FROM d),
      m AS (SELECT *, i - coalesce(max(i) FILTER (NOT h) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS run FROM n),
      w AS (
        SELECT -1::BIGINT AS i, 0::BIGINT AS lo, 0::HUGEINT AS used
        UNION ALL
        SELECT m.i, CASE WHEN c >= {_BUDGET} THEN m.i WHEN used > 0 AND used + c > {_BUDGET} THEN m.i - least(run, m.i - lo - 1) WHEN used < 0 THEN m.i ELSE lo END,
          CASE WHEN c >= {_BUDGET} THEN -1 WHEN used > 0 AND used + c > {_BUDGET} THEN c + s - (SELECT any_value(b.s) FROM m b WHERE b.i = m.i - least(m.run, m.i - w.lo - 1)) ELSE greatest(used, 0) + c END
        FROM w JOIN m ON m.i = w.i + 1),
      k AS (SELECT DISTINCT lo FROM w WHERE i >= 0), e AS (SELECT lo, coalesce(lead(lo) OVER (ORDER BY lo), (SELECT count(*) FROM n)) AS stop, row_number() OVER (ORDER BY lo) - 1 AS chunk FROM k)
      SELECT chunk, lo AS first_node, stop - lo AS n_nodes, sum(c)::BIGINT AS chars, min(s)::BIGINT AS start, (min(s) + sum(c))::BIGINT AS "end" FROM e JOIN n ON i >= lo AND i < stop GROUP BY chunk, lo, stop""",
    "fallback_targets": _L + """w AS (
        SELECT book, item, item AS here, 0 AS steps FROM l
        UNION ALL SELECT w.book, w.item, n.item, steps + 1 FROM w JOIN l h ON h.book = w.book AND h.item = w.here AND NOT h.stops JOIN l n ON n.book = w.book AND n.item = h.fallback WHERE steps < 60),
      e AS (SELECT w.book, w.item, max(w.here) FILTER (l.stops) AS target, bool_or(l.stops) AS found, max(steps) AS steps FROM w JOIN l ON l.book = w.book AND l.item = w.here GROUP BY w.book, w.item)
      SELECT book, item, CASE WHEN found THEN target WHEN steps < 60 THEN item END AS target, CASE WHEN found THEN 'found' WHEN steps < 60 THEN 'dead' ELSE 'cycle' END AS status FROM e""",
    "import_closure": _L + """e AS (SELECT DISTINCT book, item, fallback FROM l WHERE fallback IS NOT NULL),
      r AS (SELECT book, item, fallback, 1 AS steps FROM e UNION ALL SELECT r.book, r.item, e.fallback, steps + 1 FROM r JOIN e ON e.book = r.book AND e.item = r.fallback WHERE steps < 60)
      SELECT book, item, fallback, min(steps)::BIGINT AS steps FROM r GROUP BY ALL""",
}
