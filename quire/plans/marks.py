"""Queries over references, section markup, selections, decorations and points, with SQL that computes the same."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import books as B
from ..operators import marks as M
from ..operators import reader as R
from ..operators import resources as S
from .queries import SPACE_SQL, _table

# --- resources --------------------------------------------------------------------------------------------------

_TYPES = ("image/png", "text/html", "IMAGE/svg+xml; q=1", "font/woff")


def _references(spark, sf_dir):
    """Each document is a file of one of 50 books, and refers to another file: there, missing, remote or in place."""
    i = F.col("doc_id")
    docs = _table(spark, sf_dir, "documents")
    types = F.array(*[F.lit(t) for t in _TYPES])
    entries = docs.select((i % 50).alias("book"), F.concat(F.lit("OPS/img/p "), F.floor(i / 50)).alias("path"), i.alias("ord"), F.get(types, (i % 4).cast("int")).alias("media_type"), F.col("text").cast("binary").alias("content"))
    near = F.concat(F.when(i % 2 == 0, "../img/./p%20").otherwise("/OPS/text/../img/p%20"), F.floor(i / 50) * 2)
    reference = F.when(i % 11 == 0, F.concat(F.lit("#"), near)).when(i % 13 == 0, F.concat(F.lit("https://x.org/"), near)).otherwise(near)
    return docs.select((i % 50).alias("book"), i.alias("ord"), F.lit("OPS/text/c.xhtml").alias("section_path"), reference.alias("reference")), entries


def resolved_resources(spark, sf_dir):
    found = S.resolve_references(*_references(spark, sf_dir), "book")
    return found.select("book", "ord", "path", "status", F.md5(F.col("url").cast("binary")).alias("url_md5"))


def resource_summary(spark, sf_dir):
    found = S.resolve_references(*_references(spark, sf_dir), "book").filter("path IS NOT NULL")
    return S.ordered_sets(found, ["book", "status"], "path", "ord", "paths").select("book", "status", F.array_join("paths", "|").alias("paths"))


_FILES = [("OPS/img/a.png", "image/png", "AAAA"), ("OPS/s.css", "text/css", 'p{background:url("img/a.png")}'), ("OPS/x.html", "text/html", "no")]


def applied_resources(spark, sf_dir):
    """Documents as sections with a style sheet and three images: one served, one missing, one of a refused type."""
    line = C.escape_text(F.col("text"))
    html = F.concat(
        F.lit('<body><link rel="stylesheet" href="../s.css"><link href="../x.html"><p style="background:url(../img/a.png)"><img src="../img/a.png" alt="no"><img src="../x.html" alt="T">'), line,
        F.lit('<img src="gone.png"></p><svg><image xlink:href="../img/./a.png"></image><image href="gone.png"></image></svg></body>'),
    )
    files = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(m).alias("media_type"), F.lit(t).cast("binary").alias("content")) for p, m, t in _FILES])
    out = _table(spark, sf_dir, "documents").select("doc_id", S.with_resources(html, F.lit("OPS/text/c.xhtml"), files).alias("r"))
    return out.select("doc_id", F.md5(F.col("r.html").cast("binary")).alias("md5"), F.col("r.alt_substituted").cast("long").alias("alt_substituted"))


def _lines_markup(spark, sf_dir):
    """Documents' lines as paragraphs with ids, within blank text that counts for nothing."""
    line = lambda x, i: F.concat(F.lit('\n <p id="l'), i.cast("string"), F.lit('">'), C.escape_text(x), F.lit("</p>"))
    html = F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.split("text", "\n"), line), ""), F.lit("\n</body></html>"))
    return _table(spark, sf_dir, "documents").select("doc_id", html.alias("html"))


def top_level_nodes(spark, sf_dir):
    nodes = _lines_markup(spark, sf_dir).select("doc_id", F.posexplode(S.top_nodes(F.col("html"))).alias("ord", "n"))
    return nodes.select("doc_id", F.col("ord").cast("long").alias("ord"), "n.tag", "n.chars")


def element_offsets(spark, sf_dir):
    return _lines_markup(spark, sf_dir).select("doc_id", F.inline(S.id_offsets(F.col("html")))).select("doc_id", "id", "offset")


def chunk_counters(spark, sf_dir):
    tags = F.array(*[F.lit(t) for t in ("P", "TABLE", "#text")])
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(tags, (F.col("turn") % 3).cast("int")).alias("tag"), C.u16_length(F.col("text")).alias("chars"))
    return B.chunk_stats(turns, "conv_id", "turn", "tag", "chars", 200)


def nearest_rank_chars(spark, sf_dir):
    return B.nearest_rank(_table(spark, sf_dir, "documents"), "lang", "n_chars", {"p50": 0.5, "p95": 0.95, "most": 1.0})


_START, _END = "*** START OF THE PROJECT GUTENBERG EBOOK ONE ***", "*** END OF THE PROJECT GUTENBERG EBOOK ONE ***"


def prose_paragraphs(spark, sf_dir):
    spread = F.replace("text", F.lit("\n"), F.lit("\r\n \r\n"))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(f"Notes\n{_START}\n"), spread, F.lit(f"\n\n{_END}\nmore"))).otherwise(spread)
    found = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(B.prose(text)).alias("ord", "p"))
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5(F.col("p").cast("binary")).alias("md5"))


# --- selections, decorations, points ------------------------------------------------------------------------------


def _marks(spark, sf_dir):
    """Each user's events as a session's selections, clears, drawn and removed decorations."""
    e = F.col("event_id")
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("session"), e.cast("long").alias("seq"), F.when(e % 3 == 0, "selection").when(e % 5 < 3, "clear").otherwise("other").alias("kind"),
        F.when(e % 7 < 2, "undecorate").otherwise("decorate").alias("verb"), (e % 5).cast("long").alias("id"), F.col("event_type").alias("class_name"),
    )


def selection_reports(spark, sf_dir):
    heard = _marks(spark, sf_dir).filter("kind <> 'other'").select("session", "seq", "kind")
    return M.selection_reports(heard, "session", "seq", "kind")


def live_decorations(spark, sf_dir):
    return M.live_decorations(_marks(spark, sf_dir), ["session", "id"], "seq", "verb", "class_name").select("session", "id", "class_name", "seq")


def _selections(spark, sf_dir):
    """From the second line of each document, 50 units."""
    at = F.instr("text", "\n")
    docs = _table(spark, sf_dir, "documents").filter(at > 0)
    return docs.select("doc_id", "text", at.alias("at"), M.position_of_range(F.col("text"), at, at + 50, F.col("doc_id").cast("string")).alias("p"))


def selection_positions(spark, sf_dir):
    return _selections(spark, sf_dir).select("doc_id", "p.section_id", "p.exact", "p.prefix", "p.suffix", F.col("p.offset_g").cast("long").alias("offset_g"))


def decoration_ranges(spark, sf_dir):
    """Where those selections are drawn once a sentence stands before the text."""
    front = "A new opening. "
    drawn = M.drawn_ranges(F.concat(F.lit(front), "text"), F.array("p"))
    return _selections(spark, sf_dir).select("doc_id", "at", drawn.alias("r")).select("doc_id", (F.get("r", F.lit(0))["end"] - F.get("r", F.lit(0))["start"]).alias("units"))


def _nodes(spark, sf_dir):
    return M.node_starts(_table(spark, sf_dir, "conversations").select("conv_id", "turn", C.u16_length(F.col("text")).cast("long").alias("chars")), "conv_id", "turn", "chars")


def point_offsets(spark, sf_dir):
    """The middle of every turn as an offset into its conversation."""
    nodes = _nodes(spark, sf_dir)
    points = nodes.select("conv_id", "turn", F.floor(F.col("chars") / 2).alias("local"))
    return M.offset_of_point(points, nodes, "conv_id", "turn", "local").select("conv_id", "turn", "local", "offset")


def offset_points(spark, sf_dir):
    """The turn that holds every 100th unit of a conversation."""
    nodes = _nodes(spark, sf_dir)
    total = nodes.groupBy("conv_id").agg(F.max("end").alias("n"))
    asked = total.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + 100, F.lit(100).cast("long"))).alias("offset"))
    return M.point_at_offset(asked, nodes, "conv_id", "turn", "offset").select("conv_id", "offset", "turn", "local")


def go_to(spark, sf_dir):
    """A target of each kind in turn, one a document, over forty sections."""
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in ("start", "end", "fraction", "href", "position", "toc", "href")])
    name = F.concat(F.lit("s"), i % 45, F.lit(".xhtml"))
    href = F.when(i % 7 == 6, F.concat(F.lit("#f"), i)).when(i % 2 == 0, F.concat(F.lit("../text/"), name)).otherwise(F.concat(F.lit("none"), F.lit("#t"), i % 50))
    targets = _table(spark, sf_dir, "documents").select(
        i.alias("target_id"), F.get(kinds, (i % 7).cast("int")).alias("kind"), (i % 101 / F.lit(100.0)).alias("fraction"), href.alias("href"), name.alias("section_id"), F.when(i % 3 == 0, "x").alias("fragment")
    )
    sections = spark.range(40).select(F.col("id").cast("int").alias("section_index"), F.concat(F.lit("s"), "id", F.lit(".xhtml")).alias("section_id"))
    toc = spark.range(30).select(F.col("id").cast("int").alias("node_id"), F.concat(F.lit("s"), F.col("id") + 5, F.lit(".xhtml")).alias("section_id"), F.concat(F.lit("t"), "id").alias("fragment"))
    return M.go_to(targets, sections, toc)


def theme_style_sheets(spark, sf_dir):
    """Style sheets of appearances: a theme or none, a font size or none."""
    i = F.col("doc_id")
    theme = F.when(i % 4 == 0, F.lit("light")).when(i % 4 == 1, F.lit("dark")).when(i % 4 == 2, F.lit("sepia"))
    state = F.to_json(F.struct(theme.alias("theme"), F.when(i % 3 > 0, 10 + i % 9).alias("fontSize"), F.when(i % 5 == 0, F.lit(True)).alias("hyphenate")))
    sheet = C.kernel(lambda a: R.theme_style_sheet(json.loads(a), "themes", "page"), T.StringType())
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(sheet(state).cast("binary")).alias("md5"))


QUERIES = {f.__name__: f for f in (
    resolved_resources, resource_summary, applied_resources, top_level_nodes, element_offsets, chunk_counters, nearest_rank_chars, prose_paragraphs,
    selection_reports, live_decorations, selection_positions, decoration_ranges, point_offsets, offset_points, go_to, theme_style_sheets,
)}

_KIND = "list_extract(['" + "', '".join(_TYPES) + "'], CAST(doc_id % 4 AS INT) + 1)"
_REFERENCES = f"""WITH e AS (SELECT doc_id % 50 AS book, 'OPS/img/p ' || (doc_id // 50) AS path, {_KIND} AS media, text FROM documents),
r AS (SELECT doc_id % 50 AS book, doc_id AS ord, CASE WHEN doc_id % 11 > 0 AND doc_id % 13 > 0 THEN 'OPS/img/p ' || (doc_id // 50 * 2) END AS path,
      CASE WHEN doc_id % 11 = 0 THEN 'fragment' WHEN doc_id % 13 = 0 THEN 'remote' END AS other FROM documents),
f AS (SELECT r.book, ord, r.path, coalesce(other, CASE WHEN media IS NULL THEN 'unresolved' WHEN media = 'text/html' THEN 'refused' WHEN text IS NULL THEN 'unresolved' ELSE 'resolved' END) AS status, media, text
      FROM r LEFT JOIN e ON e.book = r.book AND e.path = r.path)
"""
_URL = "'data:image/png;base64,' || to_base64('AAAA'::BLOB)"
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_L = "(SELECT doc_id, i - 1 AS ord, length(ls[i]) AS chars FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
_MARKS = """(SELECT user_id::BIGINT AS session, event_id::BIGINT AS seq, CASE WHEN event_id % 3 = 0 THEN 'selection' WHEN event_id % 5 < 3 THEN 'clear' ELSE 'other' END AS kind,
    CASE WHEN event_id % 7 < 2 THEN 'undecorate' ELSE 'decorate' END AS verb, CAST(event_id % 5 AS BIGINT) AS id, event_type AS class_name FROM events)"""
_N = "(SELECT conv_id, turn, length(text) AS chars, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations)"
_BLOCK = lambda v: ":root{" + ";".join(f"{k}:{x}" for k, x in v.items()) + "}"
_SHEET = (
    "@layer themes;@layer themes{html{background:var(--wr-background);color:var(--wr-color)}body{background:var(--wr-background);color:var(--wr-color)}a{color:var(--wr-link-color)}"
    "::selection{background:var(--wr-selection-background);color:var(--wr-selection-color)}}#page{background:var(--wr-background) !important;color:var(--wr-color) !important}"
    + _BLOCK(R.THEMES["light"]) + "@media (prefers-color-scheme: dark){" + _BLOCK(R.THEMES["dark"]) + "}"
)
ORACLES = {
    "resolved_resources": _REFERENCES + "SELECT book, ord, path, status, CASE WHEN status = 'resolved' THEN md5('data:' || trim(lower(string_split(media, ';')[1])) || ';base64,' || to_base64(encode(text))) END AS url_md5 FROM f",
    "resource_summary": _REFERENCES + "SELECT book, status, string_agg(path, '|' ORDER BY first_at) AS paths FROM (SELECT book, status, path, min(ord) AS first_at FROM f WHERE path IS NOT NULL GROUP BY ALL) GROUP BY ALL",
    "applied_resources": f"""WITH u AS (SELECT {_URL} AS a), s AS (SELECT a, 'data:text/css;base64,' || to_base64(encode('p{{background:url("' || a || '")}}')) AS c FROM u)
        SELECT doc_id, md5('<link rel="stylesheet" href="' || c || '"><p style="background:url(&quot;' || a || '&quot;)"><img src="' || a || '" alt="no">T' || {_ESCAPED.format("text")} || '</p><svg><image xlink:href="' || a || '"></image></svg>') AS md5,
        1::BIGINT AS alt_substituted FROM documents, s""",
    "top_level_nodes": f"SELECT doc_id, ord, 'P' AS tag, chars FROM {_L}",
    "element_offsets": f"SELECT doc_id, 'l' || ord AS id, CAST(sum(chars) OVER (PARTITION BY doc_id ORDER BY ord) - chars AS BIGINT) AS \"offset\" FROM {_L}",
    "chunk_counters": """SELECT conv_id, count(*) AS top_level_nodes, CAST(count(*) FILTER (length(text) >= 200) AS BIGINT) AS oversized, max(length(text)) AS largest, 0::BIGINT AS headings_deferred,
        count(*) FILTER (length(text) >= 200 AND turn % 3 = 1) AS atomic_oversized, count(*) FILTER (turn % 3 = 2) AS bare_text FROM conversations GROUP BY conv_id""",
    "nearest_rank_chars": "WITH s AS (SELECT lang, list(n_chars ORDER BY n_chars) AS v FROM documents WHERE n_chars IS NOT NULL GROUP BY lang) SELECT lang, "
    + ", ".join(f"v[1 + least(len(v) - 1, CAST(floor(len(v) * {q}::DOUBLE) AS BIGINT))] AS {n}" for n, q in (("p50", 0.5), ("p95", 0.95), ("most", 1.0))) + " FROM s",
    "prose_paragraphs": f"""WITH p AS (SELECT doc_id, i, trim(replace(regexp_replace(ls[i], '[{SPACE_SQL}]+', ' ', 'g'), '_', '')) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
        k AS (SELECT * FROM p WHERE length(p) >= 120 AND p <> upper(p) AND NOT regexp_matches(p, '(?i)^(chapter|contents|illustrations|list of|produced by|transcriber)') AND NOT regexp_matches(p, '(?i)project gutenberg|etext|proofread'))
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, md5(p) AS md5 FROM k""",
    "selection_reports": f"SELECT session, seq, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY session ORDER BY seq) AS b FROM {_MARKS} WHERE kind <> 'other') WHERE kind = 'selection' OR b = 'selection'",
    "live_decorations": f"""WITH m AS (SELECT *, coalesce(max(seq) FILTER (verb = 'undecorate') OVER (PARTITION BY session, id), -1) AS gone FROM {_MARKS})
        SELECT session, id, arg_max(class_name, seq) AS class_name, min(seq) AS seq FROM m WHERE verb = 'decorate' AND seq > gone GROUP BY ALL""",
    "selection_positions": "SELECT doc_id, CAST(doc_id AS VARCHAR) AS section_id, substr(text, a + 1, 50) AS exact, substr(text, greatest(1, a - 31), least(32, a)) AS prefix, substr(text, a + 51, 32) AS suffix, CAST(a AS BIGINT) AS offset_g FROM (SELECT doc_id, text, strpos(text, chr(10)) AS a FROM documents) WHERE a > 0",
    "decoration_ranges": "SELECT doc_id, CAST(length(substr(text, a + 1, 50)) AS BIGINT) AS units FROM (SELECT doc_id, text, strpos(text, chr(10)) AS a FROM documents) WHERE a > 0",
    "point_offsets": f"SELECT conv_id, turn, chars // 2 AS local, CAST(e - chars + chars // 2 AS BIGINT) AS \"offset\" FROM {_N}",
    "offset_points": f"""WITH n AS {_N}, o AS (SELECT conv_id, unnest(range(0, CAST(max(e) AS BIGINT) + 1, 100)) AS o FROM n GROUP BY conv_id),
        h AS (SELECT o.conv_id, o, min(turn) AS turn FROM o JOIN n ON n.conv_id = o.conv_id AND n.e >= o GROUP BY ALL)
        SELECT h.conv_id, o AS "offset", h.turn, CAST(o - (e - chars) AS BIGINT) AS local FROM h JOIN n ON n.conv_id = h.conv_id AND n.turn = h.turn""",
    "go_to": """WITH t AS (SELECT doc_id, doc_id % 7 AS k, doc_id % 45 AS s, doc_id % 50 AS f FROM documents), x AS (SELECT doc_id, k,
        CASE k WHEN 0 THEN 0 WHEN 1 THEN 39 WHEN 2 THEN least(39, CAST(floor(doc_id % 101 / 100.0::DOUBLE * 40) AS BIGINT)) WHEN 6 THEN NULL
             WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN CASE WHEN s < 40 THEN s ELSE -1 END ELSE CASE WHEN f < 30 THEN f + 5 ELSE -1 END END
             ELSE CASE WHEN s < 40 THEN s ELSE -1 END END AS i FROM t)
        SELECT doc_id AS target_id, CAST(i AS BIGINT) AS section_index, CASE WHEN i >= 0 OR i IS NULL THEN CASE k WHEN 1 THEN 'last' WHEN 2 THEN 'page' WHEN 4 THEN 'position' WHEN 6 THEN 'fragment'
          WHEN 3 THEN CASE WHEN doc_id % 2 = 1 THEN 'fragment' ELSE 'first' END WHEN 5 THEN CASE WHEN doc_id % 3 = 0 THEN 'fragment' ELSE 'first' END ELSE 'first' END END AS place FROM x""",
    "theme_style_sheets": f"""WITH v AS (SELECT doc_id, doc_id % 4 AS t, CASE WHEN doc_id % 3 > 0 THEN 10 + doc_id % 9 END AS z, doc_id % 5 = 0 AS h FROM documents)
        SELECT doc_id, md5('{_SHEET}' || CASE t WHEN 0 THEN '{_BLOCK(R.THEMES["light"])}' WHEN 1 THEN '{_BLOCK(R.THEMES["dark"])}' WHEN 2 THEN '{_BLOCK(R.THEMES["sepia"])}' ELSE '' END
          || CASE WHEN z IS NULL AND NOT h THEN '' ELSE ':root{{' || concat_ws(';', CASE WHEN z IS NOT NULL THEN '--wr-font-size:' || z || 'px' END, CASE WHEN h THEN '--wr-hyphens:auto' END) || '}}#page{{' ||
             concat_ws(';', CASE WHEN z IS NOT NULL THEN 'font-size:var(--wr-font-size) !important' END, CASE WHEN h THEN '-webkit-hyphens:var(--wr-hyphens) !important;hyphens:var(--wr-hyphens) !important' END) || '}}' END) AS md5 FROM v""",
}
