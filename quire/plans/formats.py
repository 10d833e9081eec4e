"""Queries over bytes, markup, messages and sessions."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import reader as R
from ..operators import sanitize as Z
from ..sources import decode as D
from . import fixtures
from .queries import _SECTIONS_SQL, _table


def _made(spark, sf_dir, maker):
    """Every document as a book's file, as binaryFile rows would bring it."""
    file = C.kernel(lambda text, name, lang: maker(name, lang or "und", text), T.BinaryType())
    return _table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", file(F.col("text"), F.col("doc_id").cast("string"), F.col("lang")).alias("content"))


def epub_documents(spark, sf_dir):
    """Documents written as EPUB files and decoded: metadata, and how many sections, points and resources."""
    books = D.read_books(_made(spark, sf_dir, fixtures.text_epub))
    return books.select("doc_id", "format", "title", "language", "identifier", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("sections", "toc")], F.col("error.kind").alias("error"))


def epub_sections(spark, sf_dir):
    found = D.sections_of(D.read_books(_made(spark, sf_dir, fixtures.text_epub)), "doc_id")
    text = C.reading_text(C.section_text(F.col("content")))
    return found.select("doc_id", F.col("section_index").cast("long").alias("section_index"), "section_id", "linear", F.md5(text.cast("binary")).alias("md5"))


def epub_toc(spark, sf_dir):
    found = D.toc_of(D.read_books(_made(spark, sf_dir, fixtures.text_epub)), "doc_id")
    return found.select("doc_id", F.col("node_id").cast("long").alias("node_id"), "label", "section_id", "fragment")


def epub_entries(spark, sf_dir):
    """The archives' central directories: the place, name, method and size of the text's own entry."""
    found = D.list_archives(_made(spark, sf_dir, fixtures.text_epub), "doc_id").filter("name = 'OPS/raw.txt'")
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("method").cast("long").alias("method"), "compressed_size", "uncompressed_size", "first", "error")


def fb2_documents(spark, sf_dir):
    books = D.read_books(_made(spark, sf_dir, fixtures.text_fb2))
    return books.select("doc_id", "format", "title", "author", "language", "identifier", F.size("sections").cast("long").alias("n_sections"), F.col("error.kind").alias("error"))


def fb2_sections(spark, sf_dir):
    found = D.sections_of(D.read_books(_made(spark, sf_dir, fixtures.text_fb2)), "doc_id")
    text = C.reading_text(C.section_text(F.col("content")))
    return found.select("doc_id", F.col("section_index").cast("long").alias("section_index"), F.md5(F.regexp_replace(text, "\\s", "").cast("binary")).alias("md5"))


def _encoded(spark, sf_dir):
    """Documents as files of three encodings, each with its byte-order mark."""
    text = F.replace("text", F.lit("\n"), F.lit("\r\n\r\n"))
    bom = lambda mark, charset: F.concat(F.unhex(F.lit(mark)), F.encode(text, charset))
    turn = F.pmod("doc_id", F.lit(3))
    return _table(spark, sf_dir, "documents").select("doc_id", F.when(turn == 0, bom("FFFE", "UTF-16LE")).when(turn == 1, bom("FEFF", "UTF-16BE")).otherwise(bom("EFBBBF", "UTF-8")).alias("content"))


def decoded_text_books(spark, sf_dir):
    """Sections of plain-text books through the dispatcher, with the label that the contents give them."""
    books = D.read_books(_encoded(spark, sf_dir), formats=("epub", "fb2", "text")).filter(F.col("format") == "text")
    one = books.select("doc_id", F.explode("sections").alias("s"), "toc")
    label = F.get(F.filter("toc", lambda t: t["section_id"] == F.col("s.section_id")), F.lit(0))["label"]
    return one.select("doc_id", F.col("s.section_id").alias("section_id"), label.alias("heading"))


def section_bytes(spark, sf_dir):
    """Bytes of three encodings as text again."""
    text = F.replace(C.section_text(F.col("content")), F.lit("\r\n\r\n"), F.lit("\n"))
    return _encoded(spark, sf_dir).select("doc_id", F.md5(text.cast("binary")).alias("md5"))


def sanitized_pages(spark, sf_dir):
    out = T.StructType([T.StructField("html", T.StringType()), T.StructField("parsed_as", T.StringType())] + [
        T.StructField(n, T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("count", T.IntegerType())]))) for n in ("elements_removed", "elements_unwrapped", "attributes_removed")
    ])
    clean = C.kernel(lambda h: {k: v for k, v in Z.sanitize(h, "text/html").items() if k != "parse_fallback"}, out)
    return _table(spark, sf_dir, "pages").select("page_id", clean(F.col("html")).alias("s")).select("page_id", "s.*")


def sanitizer_removals(spark, sf_dir):
    gone = sanitized_pages(spark, sf_dir).select(F.explode("elements_removed").alias("r"))
    return gone.groupBy(F.col("r.name").alias("name")).agg(F.sum("r.count").alias("n"))


def session_replay(spark, sf_dir):
    """Each user's events replayed as reader verbs over five sections of four pages."""
    verbs = F.array(*[F.lit(v) for v in ("next", "prev", "link", "back", "end")])
    events = _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("session"), F.col("event_id").cast("long").alias("seq"),
        F.get(verbs, (F.floor(F.col("event_id") / 3) % 5).cast("int")).alias("verb"), F.pmod("event_id", F.lit(7)).cast("int").alias("target"),
    )
    return R.replay(events, [4] * 5)


QUERIES = {f.__name__: f for f in (
    epub_documents, epub_sections, epub_toc, epub_entries, fb2_documents, fb2_sections, decoded_text_books, section_bytes, sanitized_pages, sanitizer_removals, 
    session_replay, 
)}
_PARTS = """WITH l AS (SELECT doc_id, lang, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), n AS (SELECT *, (len(ls) + 4) // 5 AS n FROM l),
p AS (SELECT doc_id, unnest(range(0, n)) AS k, ls FROM n) """
ORACLES = {
    "epub_documents": _PARTS + "SELECT doc_id, 'epub' AS format, 'Text  ' || doc_id AS title, coalesce(lang, 'und') AS language, 'urn:x:' || doc_id AS identifier, n AS n_sections, n AS n_toc, CAST(NULL AS VARCHAR) AS error FROM n",
    "epub_sections": _PARTS + "SELECT doc_id, k AS section_index, 'c' || k AS section_id, k % 2 = 0 AS linear, md5(array_to_string(ls[k * 5 + 1 : k * 5 + 5], '')) AS md5 FROM p",
    "epub_toc": _PARTS + "SELECT doc_id, k AS node_id, 'Part ' || k AS label, 'c' || k AS section_id, 'top' AS fragment FROM p",
    "epub_entries": "SELECT doc_id, 4::BIGINT AS ord, 0::BIGINT AS method, octet_length(encode(text)) AS compressed_size, octet_length(encode(text)) AS uncompressed_size, true AS first, CAST(NULL AS VARCHAR) AS error FROM documents WHERE text IS NOT NULL",
    "fb2_documents": _PARTS + "SELECT doc_id, 'fb2' AS format, 'Text ' || doc_id AS title, 'Ann' AS author, coalesce(lang, 'und') AS language, CAST(doc_id AS VARCHAR) AS identifier, n AS n_sections, CAST(NULL AS VARCHAR) AS error FROM n",
    "fb2_sections": _PARTS + "SELECT doc_id, k AS section_index, md5(regexp_replace('Part' || k || array_to_string(ls[k * 5 + 1 : k * 5 + 5], ''), '\\s', '', 'g')) AS md5 FROM p",
    "session_replay": """WITH RECURSIVE e AS (SELECT CAST(user_id AS BIGINT) AS session, CAST(event_id AS BIGINT) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id // 3 % 5 AS v, event_id % 7 AS target FROM events),
        r AS (SELECT DISTINCT session, 0::BIGINT AS seq, 0::BIGINT AS i, 0::BIGINT AS p, []::BIGINT[] AS s, '' AS status FROM e
          UNION ALL SELECT session, seq, i, q, s, CASE WHEN v = 2 AND target > 4 THEN 'error' WHEN q <> p THEN 'moved' ELSE 'none' END FROM (
            SELECT e.session, e.seq, e.i, e.v, e.target, r.p,
              CASE v WHEN 0 THEN least(p + 1, 19) WHEN 1 THEN greatest(p - 1, 0) WHEN 4 THEN 19 WHEN 2 THEN CASE WHEN target > 4 THEN p ELSE target * 4 END ELSE coalesce(s[len(s)], p) END AS q,
              CASE WHEN v = 2 AND target <= 4 THEN list_append(s, p) WHEN v = 3 THEN s[1 : len(s) - 1] ELSE s END AS s
            FROM r JOIN e ON e.session = r.session AND e.i = r.i + 1))
        SELECT session, seq, CAST(p // 4 AS INT) AS section, CAST(p % 4 AS INT) AS page, CAST(len(s) AS INT) AS depth, status FROM r WHERE i > 0""",
    "decoded_text_books": f"SELECT doc_id, section_id, heading FROM ({_SECTIONS_SQL})",
    "section_bytes": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "sanitizer_removals": "SELECT name, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS name FROM pages) WHERE name IN ('script', 'meta', 'title', 'iframe', 'button', 'input') GROUP BY name",
}
