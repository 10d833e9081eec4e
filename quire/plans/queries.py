"""Registered queries over the driver's tables, each with SQL where SQL can say the same.

The tables hold no archives, so operators over bytes and hard literals run on rows written in the query itself."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.markup import DISCARDED
from ..functions.unicode import SMART
from ..operators import books as B

SPACE_SQL = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
QUERY, PAGE_QUERY = "of the", "the"


def _table(spark, sf_dir, name):
    return C.bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def reading_text_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", C.reading_text("html").alias("text"))


_READING = (
    "replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<head>.*?</head>', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), "
    "'<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g'), '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '\"'), '&amp;', '&')"
)


def search_pages(spark, sf_dir):
    text = reading_text_pages(spark, sf_dir).withColumn("section", F.lit("s0")).withColumn("index", F.lit(0))
    hits = B.search_sections(text, PAGE_QUERY, "page_id", "section", "index", "text", bare=True)
    return hits.select("page_id", F.col("hit_ord").cast("long").alias("hit_ord"), F.col("start_u16").cast("long").alias("start_u16"), "text")


def search_pages_hit_counts(spark, sf_dir):
    text = reading_text_pages(spark, sf_dir)
    folded = C.fold(F.col("text"))
    n = (F.length("f") - F.length(F.replace("f", F.lit(PAGE_QUERY), F.lit("")))) / len(PAGE_QUERY)
    return text.select("page_id", folded.alias("f")).select("page_id", n.cast("long").alias("hits")).filter("hits > 0")


def search_documents_hits(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("s0").alias("section"), F.lit(0).alias("index"))
    return B.search_sections(docs, QUERY, "doc_id", "section", "index", "text", bare=True).select("doc_id", F.col("hit_ord").cast("long").alias("hit_ord"), F.col("start_u16").cast("long").alias("start_u16"), "text")


def search_context(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("s0").alias("section"), F.lit(0).alias("index"))
    return B.search_sections(docs, QUERY, "doc_id", "section", "index", "text").select("doc_id", "hit_ord", "context", "serialized")


def search_conversations(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.col("turn").cast("string").alias("section"))
    hits = B.search_sections(turns, PAGE_QUERY, "conv_id", "section", "turn", "text", bare=True)
    return hits.select("conv_id", F.col("section").cast("long").alias("turn"), F.col("hit_ord").cast("long").alias("hit_ord"), F.col("start_u16").cast("long").alias("start_u16"))


def search_first_hits(spark, sf_dir):
    """The first three hits of each conversation, turns being its sections."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.col("turn").cast("string").alias("section"))
    hits = B.first_hits(turns, PAGE_QUERY, "conv_id", "section", "turn", "text", 3)
    return hits.select("conv_id", F.col("nth").cast("long").alias("nth"), F.col("section").cast("long").alias("turn"), F.col("start_u16").cast("long").alias("start_u16"))


def _hits_sql(table, keys, query):
    keyed = ", ".join(keys)
    return f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, {keyed}, text, lower(replace(text, chr(10), ' ')) AS f FROM {table} WHERE text IS NOT NULL),
h AS (
  SELECT rid, 0 AS hit_ord, strpos(f, '{query}') AS p FROM t WHERE strpos(f, '{query}') > 0
  UNION ALL
  SELECT h.rid, hit_ord + 1, p + {len(query)} - 1 + strpos(substr(f, p + {len(query)}), '{query}') FROM h JOIN t USING (rid)
  WHERE strpos(substr(f, p + {len(query)}), '{query}') > 0)
SELECT {keyed}, CAST(hit_ord AS BIGINT) AS hit_ord, CAST(p - 1 AS BIGINT) AS start_u16{{extra}} FROM h JOIN t USING (rid)
"""


def text_blocks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))
    return docs.select("doc_id", F.posexplode(C.blocks(F.col("t"))).alias("ord", "block")).select("doc_id", F.col("ord").cast("long").alias("ord"), "block")


def text_headings(spark, sf_dir):
    return text_blocks(spark, sf_dir).filter(C.is_heading(F.col("block"))).select("doc_id", "ord", C.collapse(F.col("block")).alias("heading"))


_LINES = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, b AS block FROM (SELECT doc_id, i, regexp_replace(list_extract(ls, i), '^[" + SPACE_SQL + "]+|[" + SPACE_SQL + "]+$', '', 'g') AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE b <> ''"
_HEADING_SQL = rf"(length(block) BETWEEN 1 AND 60 AND (regexp_matches(block, '(?i)^({C.HEADING_WORDS})\b') OR (regexp_matches(block, '[A-Z]') AND NOT regexp_matches(block, '[a-z]') AND length(block) <= 48)))"


def text_sections_lines_as_blocks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return B.text_sections(docs, "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n"))).select("doc_id", "section_id", "heading", "n_paragraphs")


def text_toc_lines_as_blocks(spark, sf_dir):
    return text_sections_lines_as_blocks(spark, sf_dir).filter("heading is not null").select("doc_id", "section_id", F.col("heading").alias("label"))


_SECTIONS_SQL = rf"""
WITH b AS ({_LINES}), f AS (SELECT *, {_HEADING_SQL} AS h FROM b),
g AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM f),
s AS (SELECT doc_id, run, max(CASE WHEN h THEN regexp_replace(block, '[{SPACE_SQL}]+', ' ', 'g') END) AS heading, count(*) FILTER (NOT h) AS n_paragraphs FROM g GROUP BY ALL),
n AS (SELECT doc_id, 's' || (row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1) AS section_id, heading, n_paragraphs FROM s)
SELECT doc_id, section_id, heading, CAST(n_paragraphs AS BIGINT) AS n_paragraphs FROM n
UNION ALL SELECT doc_id, 's0', NULL, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b)
"""


def grapheme_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(C.graphemes(F.col("text"))).cast("long").alias("graphemes"), C.u16_length(F.col("text")).cast("long").alias("u16"))


def collapse_escape_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    flat = C.collapse(F.col("text"))
    return docs.select("doc_id", F.md5(flat.cast("binary")).alias("collapsed_md5"), F.md5(C.escape_attribute(flat).cast("binary")).alias("escaped_md5"))


def position_roundtrip(spark, sf_dir):
    """Captured positions of each document at every 500th unit, serialised, parsed and resolved again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.sequence(F.lit(0), F.length("text"), F.lit(500)).alias("at"))
    held = docs.select("doc_id", "text", "at", C.capture_all(F.col("text"), F.col("at"), F.col("doc_id").cast("string")).alias("p"))
    found = held.select("doc_id", "at", "p", C.resolve_all(F.col("text"), F.col("p")).alias("r"))
    pairs = found.select("doc_id", F.explode(F.arrays_zip("at", "p", "r")).alias("x"))
    parsed = pairs.select("doc_id", "x", C.parse_position(F.col("x.p.serialized")).alias("q"))
    return parsed.select(
        "doc_id", F.col("x.at").cast("long").alias("asked"), (F.col("x.r.offset_g") == F.col("x.p.offset_g")).alias("resolved"),
        ((F.col("q.position.exact") == F.col("x.p.exact")) & (F.col("q.position.offset_g") == F.col("x.p.offset_g"))).alias("same"),
    )


def resolve_shifted_text(spark, sf_dir):
    """Positions of a text found again after a sentence was put before it."""
    docs = _table(spark, sf_dir, "documents").filter(F.length("text") > 400).select("doc_id", "text", F.array(F.lit(200)).alias("at"))
    held = docs.select("doc_id", F.concat(F.lit("A new opening. "), "text").alias("edited"), C.capture_all(F.col("text"), F.col("at"), F.lit("s0")).alias("p"))
    out = held.select("doc_id", "p", C.resolve_all(F.col("edited"), F.col("p")).alias("r"))
    return out.select("doc_id", (F.col("r")[0]["offset_g"] - F.col("p")[0]["offset_g"]).alias("shift"))


def sentences_count(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", C.sentence_count(F.col("text")).alias("sentences"))


def chunk_ranges(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("P").alias("tag"), C.u16_length(F.col("text")).alias("chars"))
    return B.chunk_ranges(turns, "conv_id", "turn", "tag", "chars", 800)


_CHUNK_SQL = """
WITH RECURSIVE n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) AS c FROM conversations),
w AS (
  SELECT conv_id, i, c, CAST(0 AS BIGINT) AS chunk, c AS used, c >= 800 AS shut FROM n WHERE i = 1
  UNION ALL
  SELECT n.conv_id, n.i, n.c,
         CASE WHEN w.shut OR n.c >= 800 OR (w.used > 0 AND w.used + n.c > 800) THEN w.chunk + 1 ELSE w.chunk END,
         CASE WHEN w.shut OR n.c >= 800 OR (w.used > 0 AND w.used + n.c > 800) THEN n.c ELSE w.used + n.c END, n.c >= 800
  FROM w JOIN n ON n.conv_id = w.conv_id AND n.i = w.i + 1),
g AS (SELECT conv_id, chunk, min(i) - 1 AS first_node, count(*) AS n_nodes, sum(c) AS chars FROM w GROUP BY ALL),
t AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY chunk) AS e FROM g)
"""


def chunk_at_offset(spark, sf_dir):
    chunks = chunk_ranges(spark, sf_dir)
    offsets = chunks.groupBy("conv_id").agg(F.max("end").alias("n")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"), F.lit(300).cast("long"))).alias("offset"))
    return B.containing(offsets, chunks, "conv_id", "offset").select("conv_id", "offset", "chunk")


def book_progress(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    own = Window.partitionBy("conv_id")
    turns = turns.withColumn("i", F.row_number().over(own.orderBy("turn")) - 1).withColumn("n", F.count("*").over(own))
    p = B.book_fraction(F.col("i"), F.lit(0.5), F.col("n"))
    index, page = B.place_of_fraction(p, F.col("n"), F.lit(11))
    return turns.select("conv_id", "turn", F.round(p, 9).alias("progress"), index.cast("long").alias("section"), page.cast("long").alias("page"))


def links_of(html):
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))


def classify_references(spark, sf_dir):
    hrefs = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(links_of(F.col("html"))).alias("ord", "href"))
    kind, scheme = C.reference_kind(F.col("href")), C.reference_scheme(F.col("href"))
    ok = C.reference_allowed(F.lit("a"), F.lit("href"), kind, scheme)
    return hrefs.select("page_id", F.col("ord").cast("long").alias("ord"), kind.alias("kind"), scheme.alias("scheme"), ok.alias("allowed"))


_REFERENCE_SQL = r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS hs FROM pages),
r AS (SELECT page_id, i - 1 AS ord, regexp_replace(hs[i], '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS v FROM (SELECT page_id, hs, unnest(range(1, len(hs) + 1)) AS i FROM h)),
k AS (SELECT page_id, ord, CASE WHEN v = '' THEN 'empty' WHEN v[1] = '#' THEN 'fragment' WHEN regexp_matches(v, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'scheme' ELSE 'relative' END AS kind,
             lower(regexp_extract(v, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS s FROM r)
SELECT page_id, CAST(ord AS BIGINT) AS ord, kind, CASE WHEN kind = 'scheme' THEN s END AS scheme,
       CASE kind WHEN 'fragment' THEN true WHEN 'relative' THEN true WHEN 'scheme' THEN s IN ('http', 'https', 'mailto', 'tel') ELSE false END AS allowed
FROM k
"""


def strip_markup_pages(spark, sf_dir):
    flat = C.collapse(F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " "))
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(flat.cast("binary")).alias("md5"))


def window_score(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", B.word_stream(F.col("text")).alias("w")).filter(F.size("w") >= 100)
    back = B.window_score(F.col("w"), F.reverse("w"))
    return docs.select("doc_id", B.window_score(F.col("w"), F.col("w")).alias("self_score"), (back < 0.2).alias("reversed_differs"))


def removal_tally(spark, sf_dir):
    """Elements by name that reading drops, over all pages."""
    names = F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    found = _table(spark, sf_dir, "pages").select(F.explode(names).alias("name")).select(F.lower("name").alias("name"))
    return B.tally(found.filter(F.col("name").isin(*sorted(DISCARDED), "style")), "name")


def first_of_host(spark, sf_dir):
    """First page of each host: the first-wins rule on real rows."""
    pages = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), "page_id", "url")
    return B.first_wins(pages, ["host"], ["page_id"])


def quantiles_chars(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    q = F.percentile("n_chars", F.array(F.lit(0.5), F.lit(0.95)))
    return docs.groupBy("lang").agg(q.alias("q"), F.max("n_chars").alias("most")).select("lang", F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p95"), "most")


QUERIES = {f.__name__: f for f in (
    reading_text_pages, search_pages, search_pages_hit_counts, search_documents_hits, search_context, search_conversations, search_first_hits, 
    text_blocks, text_headings, text_sections_lines_as_blocks, text_toc_lines_as_blocks, grapheme_counts,
    collapse_escape_documents, position_roundtrip, resolve_shifted_text, sentences_count, chunk_ranges, chunk_at_offset, book_progress,
    classify_references, strip_markup_pages, window_score, removal_tally, 
    first_of_host, quantiles_chars,
)}

_SMART_FROM, _SMART_TO = "".join(SMART), "".join(SMART.values()).replace("'", "''")
_WORDS_SQL = r"regexp_extract_all(lower(translate(text, '’‘' || chr(173), chr(39) || chr(39))), '[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*')"
ORACLES = {
    "search_pages": _hits_sql(f"(SELECT page_id, {_READING} AS text FROM pages)", ["page_id"], PAGE_QUERY).format(extra=f", substr(text, p, {len(PAGE_QUERY)}) AS text"),
    "position_roundtrip": "SELECT doc_id, unnest(range(0, length(text) + 1, 500)) AS asked, true AS resolved, true AS same FROM documents",
    "window_score": f"""WITH w AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents), n AS (SELECT doc_id, w, CAST(floor(len(w) * 0.1) AS BIGINT) AS lo, CAST(floor(len(w) * 0.9) AS BIGINT) - 25 AS hi FROM w WHERE len(w) >= 100),
        b AS (SELECT *, ' ' || array_to_string(list_reverse(w), ' ') || ' ' AS back, ' ' || array_to_string(w, ' ') || ' ' AS own FROM n),
        c AS (SELECT *, list_transform(range(0, 20), lambda i: ' ' || array_to_string(w[lo + (hi - lo) * i // 20 + 1 : lo + (hi - lo) * i // 20 + 25], ' ') || ' ') AS p FROM b)
        SELECT doc_id, CASE WHEN hi > lo THEN len(list_filter(p, lambda x: contains(own, x))) / 20.0::DOUBLE ELSE 0 END AS self_score, CASE WHEN hi > lo THEN len(list_filter(p, lambda x: contains(back, x))) / 20.0::DOUBLE ELSE 0 END < 0.2 AS reversed_differs FROM c""",
    "sentences_count": """WITH t AS (SELECT doc_id, text, regexp_replace(text, '[.][^\\p{L}\\n.!?。！？]*\\p{Ll}', 'x', 'g') AS u FROM documents),
        c AS (SELECT doc_id, len(regexp_extract_all(u, '[.!?…。！？]+[)\\]}"”’»›]*(?:[ \\n]+|$|[^\\s\\p{L}\\p{N}.!?,;:-])|[。！？]+')) AS n, regexp_matches(u, '[^\\s.!?…。！？][)\\]}"”’»›]*\\s*$') AS tail FROM t)
        SELECT doc_id, CAST(n + CAST(tail AS INT) AS BIGINT) AS sentences FROM c""",
    "reading_text_pages": f"SELECT page_id, {_READING} AS text FROM pages",
    "search_pages_hit_counts": f"WITH f AS (SELECT page_id, lower(regexp_replace({_READING}, '[{SPACE_SQL}]+', ' ', 'g')) AS f FROM pages) SELECT page_id, CAST((length(f) - length(replace(f, '{PAGE_QUERY}', ''))) / {len(PAGE_QUERY)} AS BIGINT) AS hits FROM f WHERE contains(f, '{PAGE_QUERY}')",
    "search_documents_hits": _hits_sql("documents", ["doc_id"], QUERY).format(extra=f", substr(text, p, {len(QUERY)}) AS text"),
    "search_conversations": _hits_sql("conversations", ["conv_id", "turn"], PAGE_QUERY).format(extra=""),
    "search_first_hits": f"SELECT conv_id, nth, turn, start_u16 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, hit_ord) AS nth FROM ({_hits_sql('conversations', ['conv_id', 'turn'], PAGE_QUERY).format(extra='')})) WHERE nth <= 3",
    "text_blocks": f"SELECT doc_id, CAST(ord AS BIGINT) AS ord, block FROM ({_LINES})",
    "text_headings": f"SELECT doc_id, CAST(ord AS BIGINT) AS ord, regexp_replace(block, '[{SPACE_SQL}]+', ' ', 'g') AS heading FROM ({_LINES}) WHERE {_HEADING_SQL}",
    "text_sections_lines_as_blocks": _SECTIONS_SQL,
    "text_toc_lines_as_blocks": f"SELECT doc_id, section_id, heading AS label FROM ({_SECTIONS_SQL}) WHERE heading IS NOT NULL",
    "grapheme_counts": "SELECT doc_id, length_grapheme(text) AS graphemes, length(text) AS u16 FROM documents",
    "collapse_escape_documents": f"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[{SPACE_SQL}]+', ' ', 'g')) AS t FROM documents)
        SELECT doc_id, md5(t) AS collapsed_md5, md5(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_md5 FROM c""",
    "chunk_ranges": _CHUNK_SQL + "SELECT conv_id, chunk, CAST(first_node AS BIGINT) AS first_node, n_nodes, CAST(chars AS BIGINT) AS chars, CAST(e - chars AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM t",
    "chunk_at_offset": _CHUNK_SQL + ", o AS (SELECT conv_id, unnest(range(0, CAST(max(e) AS BIGINT) + 1, 300)) AS \"offset\" FROM t GROUP BY conv_id) SELECT o.conv_id, o.\"offset\", t.chunk FROM o JOIN t ON o.conv_id = t.conv_id AND o.\"offset\" >= e - chars AND o.\"offset\" < e",
    "book_progress": """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
        p AS (SELECT *, least(1.0, greatest(0.0, (i + 0.5::DOUBLE) / n)) AS p FROM t)
        SELECT conv_id, turn, round(p, 9) AS progress, CAST(least(floor(p * n), n - 1) AS BIGINT) AS section, CAST(floor((p * n - least(floor(p * n), n - 1)) * 10 + 0.5) AS BIGINT) AS page FROM p""",
    "classify_references": _REFERENCE_SQL,
    "strip_markup_pages": f"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '[{SPACE_SQL}]+', ' ', 'g'))) AS md5 FROM pages",
    "removal_tally": "SELECT name, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS name FROM pages) WHERE name IN ('area','base','button','embed','frame','frameset','iframe','input','keygen','listing','meta','noembed','noframes','option','optgroup','param','plaintext','script','select','source','template','textarea','title','track','xmp','style') GROUP BY name",
    "first_of_host": "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM pages GROUP BY 1",
    "quantiles_chars": "SELECT lang, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars) AS most FROM documents GROUP BY lang",
}
