"""Queries that read books through node tables: the reading order, the contents and the links of archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import nodes as N
from ..sources import decode as D
from ..sources.ranges import written
from . import fixtures
from .formats import _PARTS, _made

_PACKAGE, _NAV, _TEXT = r"META-INF/container\.xml|.*\.opf", r".*nav\.xhtml", r".*/text/.*"
_KEYS = ["doc_id"]


def _documents(spark, sf_dir, *names) -> DataFrame:
    """A table of the documents (doc_id, file, xml) of every book whose names match; archives are made and read once."""
    entries = D.archive_entries(_made(spark, sf_dir, fixtures.nested_epub), _KEYS, f"^({'|'.join(names)})$")
    return written(entries.select("doc_id", F.col("name").alias("file"), N.xml_text(F.col("body")).alias("xml")))


def _nodes(documents: DataFrame, parts: int) -> DataFrame:
    """Their nodes, dealt by book, so that the passes over files and over books need no other shuffle."""
    return N.tree(documents.repartition(parts, *_KEYS), [*_KEYS, "file"], "xml")


def _sections(documents: DataFrame) -> DataFrame:
    parts = N.tasks(documents, "xml")
    return N.spine(N.packages(_nodes(documents, parts), _KEYS, "file", parts), [*_KEYS, "directory"])


def epub_spine_nodes(spark, sf_dir):
    """The reading order of every book, by joins over the nodes of its package."""
    found = _sections(_documents(spark, sf_dir, _PACKAGE)).filter("section_index IS NOT NULL")
    return found.select("doc_id", F.col("section_index").cast("long").alias("section_index"), "section_id", "linear", "path", "media_type")


def toc_nodes(spark, sf_dir):
    """The table of contents of every book, by passes over the nodes of its navigation document."""
    documents = _documents(spark, sf_dir, _PACKAGE, _NAV)
    items = written(_sections(documents.filter(~F.col("file").rlike(f"^{_NAV}$"))).select("doc_id", "section_index", "section_id", "path", "properties"))
    nav = items.filter(F.array_contains("properties", "nav")).groupBy("doc_id").agg(F.min("path").alias("file"))
    sections = items.filter("section_index IS NOT NULL").select("doc_id", "section_id", "path")
    pages = written(documents.filter("file <> 'META-INF/container.xml'").join(nav, ["doc_id", "file"]))
    parts = N.tasks(pages, "xml")
    found = N.contents(_nodes(pages, parts), sections, _KEYS, "file", parts)
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("node_id", "parent_id", "depth")], "label", "section_id", "fragment")


def reference_nodes(spark, sf_dir):
    """Every link of every chapter, with the chapter that it leads to."""
    documents = _documents(spark, sf_dir, _PACKAGE, _TEXT)
    chapter = F.col("file").rlike(f"^{_TEXT}$")
    sections = _sections(documents.filter(~chapter)).filter("section_index IS NOT NULL").select("doc_id", "section_index", "section_id", "path")
    sections = written(sections)
    texts = documents.filter(chapter)
    links = N.references(_nodes(texts, N.tasks(texts, "xml")), [*_KEYS, "file"], "file")
    nth = F.row_number().over(Window.partitionBy("doc_id", "file").orderBy("pre")) - 1
    links = links.withColumn("nth", nth.cast("long"))
    here, there = (sections.select("doc_id", F.col("path").alias(c), F.col("section_id").alias(n)) for c, n in (("file", "section_id"), ("target", "leads_to")))
    found = links.join(here, ["doc_id", "file"]).join(there, ["doc_id", "target"], "left")
    return found.select("doc_id", "section_id", "nth", "href", "target", "fragment", "leads_to")


QUERIES = {f.__name__: f for f in (epub_spine_nodes, toc_nodes, reference_nodes)}
ORACLES = {
    "epub_spine_nodes": _PARTS + "SELECT doc_id, k AS section_index, 'c' || k AS section_id, k % 2 = 0 AS linear, 'OPS/text/c ' || k || '.xhtml' AS path, 'application/xhtml+xml' AS media_type FROM p",
    "toc_nodes": _PARTS + """, q AS (SELECT doc_id, k, (len(ls) + 4) // 5 AS n FROM p), g AS (
      SELECT doc_id, n, k AS first, -1 AS k, k % 6 = 3 AS bare FROM q WHERE k % 3 = 0 AND (k % 6 = 0 OR k + 1 < n)
      UNION ALL SELECT doc_id, n, k - k % 3, k, false FROM q WHERE k % 3 > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first, k) - 1 AS node_id FROM g)
    SELECT r.doc_id, r.node_id, CASE WHEN r.k >= 0 THEN a.node_id END AS parent_id, CASE WHEN r.k >= 0 THEN 1::BIGINT ELSE 0::BIGINT END AS depth,
           CASE WHEN r.bare THEN 'Group & ' || r.first // 3 ELSE 'Part ' || CASE WHEN r.k >= 0 THEN r.k ELSE r.first END END AS label,
           'c' || CASE WHEN r.k >= 0 THEN r.k WHEN r.bare THEN r.first + 1 ELSE r.first END AS section_id, CASE WHEN r.bare THEN NULL ELSE 'top' END AS fragment
    FROM r JOIN r a ON a.doc_id = r.doc_id AND a.first = r.first AND a.k = -1""",
    "reference_nodes": _PARTS + """, links AS (SELECT doc_id, (len(ls) + 4) // 5 AS n, k, unnest(range(0, 4)) AS nth FROM p)
    SELECT doc_id, 'c' || k AS section_id, nth, CASE nth WHEN 0 THEN 'c%20' || (k + 1) || '.xhtml#a%20b' WHEN 1 THEN '../nav.xhtml' WHEN 2 THEN '#top' ELSE 'http://example.org/' END AS href,
           CASE nth WHEN 0 THEN 'OPS/text/c ' || (k + 1) || '.xhtml' WHEN 1 THEN 'OPS/nav.xhtml' WHEN 2 THEN 'OPS/text/c ' || k || '.xhtml' END AS target,
           CASE nth WHEN 0 THEN 'a b' WHEN 2 THEN 'top' END AS fragment, CASE WHEN nth = 0 AND k + 1 < n THEN 'c' || (k + 1) WHEN nth = 2 THEN 'c' || k END AS leads_to
    FROM links""",
}
