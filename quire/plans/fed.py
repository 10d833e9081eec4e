"""Queries of small rules (claims, intents, messages, references, lookups) over rows that the tables feed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import css
from ..functions.unicode import SMART
from ..operators import books as B
from ..operators import layout as L
from ..operators import reader as R
from ..sources import decode as D
from . import fixtures
from .formats import _PARTS, _made, session_replay
from .formats import ORACLES as _FORMATS_SQL
from .queries import SPACE_SQL, _table

# --- text rules -------------------------------------------------------------------------------------------------

#: Letters that stand in for the marks which folding turns into ASCII, one each.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"[: len(SMART)]


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")


def fold_literals(spark, sf_dir):
    """Search form of every text with all smart marks, odd spaces and combining marks put into it."""
    raw = F.concat(F.lit("  "), F.translate("text", _LETTERS, "".join(SMART)), F.lit(" \t x​  ÉÅ　"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(C.fold(raw).cast("binary")).alias("md5"))


def text_metadata_literals(spark, sf_dir):
    """Title and author from fields, from the banner, from upper-case fields, and from texts without either."""
    number, turn = F.col("doc_id").cast("string"), F.pmod("doc_id", F.lit(4))
    head = (
        F.when(turn == 0, F.concat(F.lit("Title: The  "), number, F.lit("\nAuthor: A.  Writer "), number, F.lit("\n\n")))
        .when(turn == 1, F.concat(F.lit("The Project Gutenberg eBook of Book "), number, F.lit(", by Some  One\n"))).when(turn == 2, F.lit("")).otherwise(F.concat(F.lit("x\nTITLE: Loud "), number, F.lit("\n")))
    )
    rows = _docs(spark, sf_dir).select("doc_id", F.concat(head, "text").alias("t"))
    own = C.metadata_field(F.col("t"), "Title")
    author = F.coalesce(C.metadata_field(F.col("t"), "Author"), F.when(own.isNull(), C.banner_field(F.col("t"), 2)))
    return rows.select("doc_id", F.coalesce(own, C.banner_field(F.col("t"), 1)).alias("title"), author.alias("author"))


def crc32_vectors(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


def sha1_key(spark, sf_dir):
    """The key of obfuscation, with each text as the identifier."""
    return _docs(spark, sf_dir).select("doc_id", F.sha1(F.regexp_replace("text", r"[ \t\r\n]", "").cast("binary")).alias("key"))


# --- manifests: documents as items of books of fifty ------------------------------------------------------------


def _items(spark, sf_dir):
    """(manifest, spine, entries) of books: references that repeat or lead nowhere, paths that no entry has."""
    item = F.pmod("doc_id", F.lit(50))
    docs = _docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 50).alias("book"), item.alias("item"))
    name = F.concat(F.lit("m"), F.col("item").cast("string"))
    path = F.concat(F.lit("p"), F.pmod("item", F.lit(41)).cast("string"), F.lit(".xhtml"))
    spine = docs.select("book", F.concat(F.lit("m"), F.pmod(F.col("item") * 6 + 3, F.lit(60)).cast("string")).alias("idref"), F.col("item").alias("pos"))
    return docs.select("book", name.alias("id"), path.alias("path")), spine, docs.filter("item % 3 <> 1").select("book", path.alias("path"))


def spine_join(spark, sf_dir):
    manifest, spine, _ = _items(spark, sf_dir)
    first = B.first_wins(spine, ["book", "idref"], ["pos"])
    return first.join(manifest.withColumnRenamed("id", "idref"), ["book", "idref"]).select("book", "idref", "path", "pos")


def manifest_semi(spark, sf_dir):
    manifest, _, entries = _items(spark, sf_dir)
    return manifest.join(entries, ["book", "path"], "left_semi").select("book", "id", "path")


def manifest_anti(spark, sf_dir):
    manifest, spine, _ = _items(spark, sf_dir)
    return manifest.join(spine.withColumnRenamed("idref", "id"), ["book", "id"], "left_anti").select("book", "id", "path")


# --- books of four kinds ----------------------------------------------------------------------------------------


def _books(spark, sf_dir):
    return D.read_books(_made(spark, sf_dir, fixtures.any_book))


def decoded_books(spark, sf_dir):
    return _books(spark, sf_dir).select("doc_id", "format", "title", "author", "language", "identifier", "cover", "direction", "fixed_layout", F.col("error.kind").alias("error"))


def decoded_sections(spark, sf_dir):
    found = D.sections_of(_books(spark, sf_dir), "doc_id")
    text = F.regexp_replace(C.reading_text(C.section_text(F.col("content"))), r"\s", "")
    return found.select("doc_id", F.col("section_index").cast("long").alias("section_index"), "section_id", "linear", F.md5(text.cast("binary")).alias("md5"))


def decoded_toc(spark, sf_dir):
    found = D.toc_of(_books(spark, sf_dir), "doc_id")
    return found.select("doc_id", F.col("node_id").cast("long").alias("node_id"), "label", "section_id", "fragment")


def decoded_resources(spark, sf_dir):
    found = D.resources_of(_books(spark, sf_dir), "doc_id").filter("resource_id NOT LIKE '%nav.xhtml'")
    return found.select("doc_id", "resource_id", "media_type", F.octet_length("content").cast("long").alias("size"))


def archive_entries(spark, sf_dir):
    """Directories of all files, the markup's sizes left out."""
    found = D.list_archives(_made(spark, sf_dir, fixtures.any_book), "doc_id").filter("name IS NULL OR name NOT LIKE '%.opf' AND name NOT LIKE '%.xhtml'")
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), "name", F.col("method").cast("long").alias("method"), "uncompressed_size", "first", "error")


_PREFIXES = ("504B0304", "3C46696374696F6E426F6F6B3E", "", "EFBBBF3C", None, "25504446", "610062", "203C70")


def format_claims(spark, sf_dir):
    """Claims of plain text and FB2 on the first bytes of every text behind one of eight beginnings."""
    turn, head = F.pmod("doc_id", F.lit(8)), F.lit(None).cast("string")
    for k, prefix in enumerate(_PREFIXES):
        head = F.when(turn == k, F.lit(prefix)).otherwise(head)
    body = F.when(head.isNull(), F.unhex(F.lit(""))).otherwise(F.concat(F.unhex(head), F.encode("text", "UTF-8")))
    rows = _docs(spark, sf_dir).select("doc_id", body.alias("b"))
    x = F.hex(F.substring("b", 1, 512))
    mark = x.rlike("^(EFBBBF|FFFE|FEFF)")
    other = x.rlike("^(504B0304|25504446)") | x.rlike("^(?:20|09|0A|0D|EF|BB|BF)*3C") | x.rlike("^(?:..)*?00")
    fb2 = F.decode(F.substring("b", 1, 1024), "ISO-8859-1").rlike(r"<\s*FictionBook[\s>]")
    return rows.select("doc_id", ((F.length(x) > 0) & (mark | ~other)).alias("is_text"), fb2.alias("is_fb2"))


# --- style sheets -----------------------------------------------------------------------------------------------


def css_references(spark, sf_dir):
    """References of a sheet around every text, which stands in a comment and in a string."""
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    number, words = F.col("doc_id").cast("string"), F.regexp_replace(F.substring("text", 1, 200), "[^A-Za-z0-9 ]", ".")
    sheet = F.concat(F.lit('@import "a'), number, F.lit('.css"; /* '), words, F.lit(" url(no.png) */ p{background:url( x"), number, F.lit(".png )} q{content:'url(no) "), words, F.lit("'} b{src:URL(\"f"), number, F.lit('.woff") format("woff")}'))
    found = _docs(spark, sf_dir).select("doc_id", F.explode(C.kernel(css.references, kind)(sheet)).alias("r"))
    return found.select("doc_id", "r.kind", "r.value", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


# --- input, messages, geometry: from the events -----------------------------------------------------------------

_KEYS = ("ArrowRight", "ArrowLeft", "PageDown", "Shift+Space", "Home", "End", "x")


def _events(spark, sf_dir):
    way = F.when(F.col("user_id") % 2 == 0, "ltr").otherwise("rtl")
    return _table(spark, sf_dir, "events").filter("event_id IS NOT NULL").select(F.col("event_id").cast("long").alias("event_id"), way.alias("direction"), F.col("value").cast("double").alias("value"))


def key_intents(spark, sf_dir):
    key = F.get(F.array(*map(F.lit, _KEYS)), F.pmod("event_id", F.lit(len(_KEYS))).cast("int"))
    return _events(spark, sf_dir).withColumn("key", key).select("event_id", "key", "direction", R.key_intent(F.col("key"), F.col("direction")).alias("intent"))


def tap_intents(spark, sf_dir):
    width = F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(30.0 + (F.col("event_id") % 50).cast("double"))
    return _events(spark, sf_dir).withColumn("width", width).select("event_id", R.tap_intent(F.col("value"), F.col("width"), F.col("direction")).alias("intent"))


def gestures(spark, sf_dir):
    dx, dy = (F.col("event_id") * 13 % 101 - 50).cast("double"), (F.col("event_id") * 7 % 61 - 30).cast("double")
    return _events(spark, sf_dir).select("event_id", R.gesture(dx, dy).alias("gesture"), R.swipe_intent(dx, F.col("direction")).alias("swipe"))


def _message(*texts: str):
    """The message of the event's turn; {v}, {n} and {w} are its value, its number and a width that may be negative."""
    at = F.get(F.array(*map(F.lit, texts)), F.pmod("event_id", F.lit(len(texts))).cast("int"))
    for mark, value in (("{v}", F.coalesce(F.col("value"), F.lit(0.0)).cast("string")), ("{n}", F.col("event_id").cast("string")), ("{w}", (F.col("event_id") % 5 - 1).cast("string"))):
        at = F.replace(at, F.lit(mark), value)
    return at


_RECT = '{"x":0,"y":{v},"width":{w},"height":1}'
_FRAME = (
    '{"v":13,"type":"ready"}', '{"v":12,"type":"ready"}', '{"v":13,"type":"tap","x":{v},"y":2,"width":3,"height":4,"more":true}', '{"v":13,"type":"pong","id":"{n}"}', "not json {n}", '{"v":13,"type":"decorationtap","x":1,"y":1,"decorations":[]}',
    '{"v":13,"type":"selection","start":0,"end":{n},"text":"ab","rect":' + _RECT + ',"rects":[' + _RECT + "]}", '{"v":13,"type":"pong","id":{n}}', '{"v":13,"type":"none{n}"}',
)
_HOST = (
    '{"v":13,"type":"ping","id":{n}}', '{"v":13,"type":"goToPage","id":{n}}', '{"v":13,"type":"goToPage","id":1,"page":{n}}', '{"v":13,"type":"ready","id":1}', '{"v":12,"type":"ping","id":{n}}', '{"v":13,"type":"ping","id":"{n}"}', "[{n}]",
    '{"v":13,"type":"paginate","id":2,"options":{"mode":"paginated","pageWidth":{v},"pageHeight":2,"columnGap":3,"chunkChars":4,"windowChunks":5,"columnCount":1}}', '{"v":13,"type":"paginate","id":2,"options":{"mode":"flat{n}","pageWidth":1,"pageHeight":2,"columnGap":3,"chunkChars":4,"windowChunks":5,"columnCount":1}}',
    '{"v":13,"type":"decorate","id":3,"decorationId":"d{n}","start":0,"end":1,"className":"c"}', '{"v":13,"type":"decorate","id":3,"decorationId":{n},"start":0,"end":1,"className":"c"}',
)


def protocol_validate(spark, sf_dir):
    valid = C.kernel(R.frame_message, T.StringType())(_message(*_FRAME))
    return _events(spark, sf_dir).select("event_id", valid.isNotNull().alias("accepted"))


def host_messages(spark, sf_dir):
    valid = C.kernel(R.host_message, T.StringType())(_message(*_HOST))
    return _events(spark, sf_dir).select("event_id", valid.isNotNull().alias("accepted"))


def column_geometry(spark, sf_dir):
    width, gap, columns = 400 + F.coalesce(F.col("value"), F.lit(0.0)), (F.col("event_id") % 50).cast("double"), (F.col("event_id") % 3 + 1).cast("int")
    w = B.column_width(width, gap, columns)
    return _events(spark, sf_dir).select("event_id", w.alias("column_width"), (columns * (w + gap)).alias("stride"))


def href_ladder(spark, sf_dir):
    """Every page as a section, as an entry of the contents and as a link to another one."""
    n = F.col("page_id")
    name = lambda at, *forms: F.get(F.array(*[F.replace(F.lit(f), F.lit("#"), (n + k).cast("string")) for f, k in forms]), F.pmod(n, F.lit(at)).cast("int"))
    pages = _table(spark, sf_dir, "pages").filter("page_id IS NOT NULL")
    own = name(4, ("text/ch#.xhtml", 0), ("notes#", 0), ("deep/er/n#.htm", 0), ("dup/ch#.xhtml", -3))
    sections = pages.select(n.cast("int").alias("section_index"), own.alias("section_id"))
    toc = pages.select(n.cast("int").alias("node_id"), F.when(n % 5 == 0, "gone").otherwise(own).alias("section_id"), F.when(n % 3 > 0, F.concat(F.lit("f"), F.floor(n / 2).cast("string"))).alias("fragment"))
    path = name(7, ("text/ch#.xhtml", 0), ("../ch#.xhtml", -1), ("other/notes#.xhtml", -1), ("x/n#.html", -1), ("nowhere", 0), ("ch#.html?x=a/b", 0), (".hidden#", 0))
    hrefs = pages.select(n.alias("href_id"), path.alias("path"), F.when(n % 2 == 0, F.concat(F.lit("f"), F.floor(n / 3).cast("string"))).alias("fragment"))
    return L.href_sections(hrefs, sections, toc)


def tap_messages(spark, sf_dir):
    """Gestures on links, images and decorations, in their order."""
    n = F.col("event_id")
    dx, dy = F.when(n % 3 == 0, n % 9).otherwise(n * 13 % 101 - 50).cast("double"), (n * 7 % 61 - 30).cast("double")
    message = R.gesture_message(dx, F.when(n % 3 == 0, 0.0).otherwise(dy), n % 4 == 0, n % 5 == 0, n % 7 < 2, n % 2 == 0)
    return _events(spark, sf_dir).select("event_id", message.alias("message"))


def navigation_events(spark, sf_dir):
    """Places and failures that a host hears of while all sessions are replayed."""
    return R.navigation_events(session_replay(spark, sf_dir), [4] * 5)


_SETTINGS = ("fontSize", "theme", "columns", "customProperties.x")


def _updates(spark, sf_dir):
    """Every event as an update of one or two settings; every seventh clears its own."""
    n = F.col("event_id")
    name = lambda k: F.get(F.array(*map(F.lit, _SETTINGS)), F.pmod(n + k, F.lit(len(_SETTINGS))).cast("int"))
    one = F.create_map(name(0), F.when(n % 7 > 0, n.cast("string")))
    two = F.map_concat(one, F.create_map(name(1), F.concat(F.lit("b"), n.cast("string"))))
    rows = _table(spark, sf_dir, "events").filter("event_id IS NOT NULL AND user_id IS NOT NULL").select(F.col("user_id").cast("long").alias("session"), F.col("event_id").cast("long").alias("event_id"))
    return rows.select("session", "event_id", F.when(n % 3 == 0, two).otherwise(one).alias("settings"))


def appearance_of_sessions(spark, sf_dir):
    """What all updates of each session come to."""
    return R.appearance_states(_updates(spark, sf_dir), "session", "event_id", "settings")


def appearance_merges(spark, sf_dir):
    """Each update merged into the one before: how many settings stand, their names, and whether text moves."""
    before = F.lag("settings").over(Window.partitionBy("session").orderBy("event_id"))
    rows = _updates(spark, sf_dir).withColumn("base", F.coalesce(before, F.create_map().cast("map<string,string>")))
    merged = R.merged_appearance(F.col("base"), F.col("settings"))
    names = F.array_join(F.sort_array(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return rows.select("session", "event_id", names.alias("merged"), R.reflowing(F.col("settings")).alias("reflows"))


QUERIES = {f.__name__: f for f in (
    fold_literals, text_metadata_literals, crc32_vectors, sha1_key, spine_join, manifest_semi, manifest_anti, decoded_books, decoded_sections, decoded_toc, decoded_resources, archive_entries,
    format_claims, css_references, key_intents, tap_intents, gestures, protocol_validate, host_messages, column_geometry, href_ladder,
    tap_messages, navigation_events, appearance_of_sessions, appearance_merges,
)}

_FROM, _TO = "".join(SMART), "".join(SMART.values()).replace("'", "''")
_D = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)"
_CRC_TABLE = (
    "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i::UINTEGER, range(8)::UINTEGER[]), "
    "lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END) AS c FROM range(256) r(i)))"
)
_ITEMS = f"""WITH d AS (SELECT doc_id // 50 AS book, doc_id % 50 AS item FROM {_D}), m AS (SELECT book, 'm' || item AS id, 'p' || item % 41 || '.xhtml' AS path FROM d),
    s AS (SELECT book, 'm' || (item * 6 + 3) % 60 AS idref, item AS pos FROM d), e AS (SELECT book, 'p' || item % 41 || '.xhtml' AS path FROM d WHERE item % 3 <> 1) """
_E = "(SELECT event_id::BIGINT AS event_id, CASE WHEN user_id % 2 = 0 THEN 'ltr' ELSE 'rtl' END AS direction, value::DOUBLE AS value FROM events WHERE event_id IS NOT NULL)"
_MD5 = "md5(regexp_replace({}, '\\s', '', 'g'))"
_SEG = lambda c: f"regexp_extract(regexp_replace({c}, '\\?.*$', ''), '[^/]*$')"
_STEM = lambda c: f"CASE WHEN strpos(reverse({c}), '.') BETWEEN 1 AND length({c}) - 1 THEN substr({c}, 1, length({c}) - strpos(reverse({c}), '.')) ELSE {c} END"
_EDGE = lambda right: f"CASE WHEN ({right}) = (direction <> 'rtl') THEN 'next' ELSE 'prev' END"
_UPDATES = f"""WITH e AS (SELECT user_id::BIGINT AS session, event_id::BIGINT AS event_id FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL),
    u AS (SELECT *, [{', '.join(f"'{k}'" for k in _SETTINGS)}] AS names FROM e),
    s AS (SELECT session, event_id, names[event_id % 4 + 1] AS name, CASE WHEN event_id % 7 > 0 THEN event_id::VARCHAR END AS value FROM u
      UNION ALL SELECT session, event_id, names[(event_id + 1) % 4 + 1], 'b' || event_id FROM u WHERE event_id % 3 = 0) """
ORACLES = {
    "tap_messages": f"""SELECT event_id, CASE WHEN abs(dx) > 30 AND abs(dx) > abs(dy) THEN CASE WHEN event_id % 4 <> 0 THEN 'swipe' END WHEN abs(dx) <= 10 AND abs(dy) <= 10 THEN
        CASE WHEN event_id % 5 = 0 THEN 'linkclick' WHEN event_id % 7 < 2 THEN 'imagetap' WHEN event_id % 2 = 0 THEN 'decorationtap' ELSE 'tap' END END AS message
        FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 9 ELSE event_id * 13 % 101 - 50 END AS dx, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id * 7 % 61 - 30 END AS dy FROM {_E})""",
    "navigation_events": f"""SELECT session, seq, event, CASE WHEN event = 'relocated' THEN section END AS section, CASE WHEN event = 'relocated' THEN page END AS page,
        CASE WHEN event = 'relocated' THEN (section + page / 3::DOUBLE) / 5 END AS progress
        FROM (SELECT *, CASE status WHEN 'error' THEN 'error' WHEN 'moved' THEN 'relocated' END AS event FROM ({_FORMATS_SQL['session_replay']})) WHERE event IS NOT NULL""",
    "appearance_of_sessions": _UPDATES + "SELECT session, name, value FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session, name ORDER BY event_id DESC) = 1) WHERE value IS NOT NULL",
    "appearance_merges": _UPDATES + """, b AS (SELECT *, lag(event_id) OVER (PARTITION BY session ORDER BY event_id) AS before FROM e),
        m AS (SELECT b.session, b.event_id, s.name, s.value FROM b JOIN s ON s.session = b.session AND s.event_id = b.event_id
          UNION ALL SELECT b.session, b.event_id, s.name, s.value FROM b JOIN s ON s.session = b.session AND s.event_id = b.before WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.session = b.session AND x.event_id = b.event_id AND x.name = s.name)),
        r AS (SELECT session, event_id, string_agg(name || '=' || value, ',' ORDER BY name || '=' || value) FILTER (value IS NOT NULL) AS merged FROM m GROUP BY ALL)
        SELECT r.session, r.event_id, coalesce(merged, '') AS merged, EXISTS (SELECT 1 FROM s x WHERE x.session = r.session AND x.event_id = r.event_id AND x.name IN ('fontSize', 'columns') AND x.value IS NOT NULL) AS reflows FROM r""",
    "fold_literals": f"""SELECT doc_id, md5(trim(regexp_replace(lower(nfc_normalize(translate('  ' || translate(text, '{_LETTERS}', '{_FROM}') || ' ' || chr(9) || chr(160) || 'x' || chr(8203) || '  E' || chr(769) || 'A' || chr(778) || chr(12288), '{_FROM}', '{_TO}'))),
        '[{SPACE_SQL}\\x{{200B}}]+', ' ', 'g'))) AS md5 FROM {_D}""",
    "text_metadata_literals": f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'The ' || doc_id WHEN 1 THEN 'Book ' || doc_id WHEN 3 THEN 'Loud ' || doc_id END AS title,
        CASE doc_id % 4 WHEN 0 THEN 'A. Writer ' || doc_id WHEN 1 THEN 'Some One' END AS author FROM {_D}""",
    "crc32_vectors": f"""WITH t AS MATERIALIZED (SELECT {_CRC_TABLE} AS bits), b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::UINTEGER) AS b FROM {_D})
        SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UINTEGER, b), lambda c, x: xor(bits[xor(c & 255, x) + 1], c >> 8)), 4294967295::UINTEGER)::BIGINT AS crc FROM b, t""",
    "sha1_key": f"SELECT doc_id, sha1(regexp_replace(text, '[ \\t\\r\\n]', '', 'g')) AS key FROM {_D}",
    "spine_join": _ITEMS + "SELECT f.book, idref, path, pos FROM (SELECT book, idref, min(pos) AS pos FROM s GROUP BY ALL) f JOIN m ON m.book = f.book AND m.id = f.idref",
    "manifest_semi": _ITEMS + "SELECT book, id, path FROM m WHERE (book, path) IN (SELECT (book, path) FROM e)",
    "manifest_anti": _ITEMS + "SELECT book, id, path FROM m WHERE (book, id) NOT IN (SELECT (book, idref) FROM s)",
    "decoded_books": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'epub' WHEN 1 THEN 'fb2' WHEN 3 THEN 'epub' END AS format, CASE doc_id % 4 WHEN 0 THEN 'Book ' || doc_id WHEN 1 THEN 'Text ' || doc_id END AS title,
        CASE doc_id % 4 WHEN 0 THEN 'Writer ' || doc_id WHEN 1 THEN 'Ann' END AS author, CASE WHEN doc_id % 4 < 2 THEN coalesce(lang, 'und') END AS language,
        CASE doc_id % 4 WHEN 0 THEN 'urn:y:' || doc_id WHEN 1 THEN CAST(doc_id AS VARCHAR) END AS identifier, CASE WHEN doc_id % 4 = 0 THEN 'OPS/img/p.png' END AS cover,
        CASE WHEN doc_id % 12 = 0 THEN 'rtl' END AS direction, CASE WHEN doc_id % 4 = 0 THEN doc_id % 8 = 0 END AS fixed_layout,
        CASE doc_id % 4 WHEN 2 THEN 'UnrecognizedFormat' WHEN 3 THEN 'CorruptContainer' END AS error FROM documents WHERE text IS NOT NULL""",
    "decoded_sections": _PARTS + f"""SELECT doc_id, k AS section_index, CASE doc_id % 4 WHEN 0 THEN 'c' ELSE 's' END || k AS section_id, true AS linear,
        {_MD5.format("CASE doc_id % 4 WHEN 0 THEN '' ELSE 'Part' || k END || array_to_string(ls[k * 5 + 1 : k * 5 + 5], '')")} AS md5 FROM p WHERE doc_id % 4 < 2""",
    "decoded_toc": _PARTS + "SELECT doc_id, k AS node_id, 'Part ' || k AS label, CASE doc_id % 4 WHEN 0 THEN 'c' ELSE 's' END || k AS section_id, CAST(NULL AS VARCHAR) AS fragment FROM p WHERE doc_id % 4 < 2",
    "decoded_resources": """SELECT doc_id, 'OPS/img/p.png' AS resource_id, 'image/png' AS media_type, 4::BIGINT AS size FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 0
        UNION ALL SELECT doc_id, 'OPS/raw.txt', 'application/octet-stream', octet_length(encode(text)) FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 0""",
    "archive_entries": """WITH d AS (SELECT doc_id, doc_id % 4 AS kind, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, unnest([{'ord': 0, 'name': 'mimetype', 'method': 0, 'size': 20}, {'ord': 1, 'name': 'META-INF/container.xml', 'method': 8, 'size': """ + str(len(fixtures.CONTAINER)) + """},
          {'ord': CASE WHEN kind = 0 THEN 5 ELSE 2 END, 'name': 'OPS/raw.txt', 'method': CASE WHEN kind = 0 THEN 8 ELSE 0 END, 'size': n}]) AS x FROM d WHERE kind IN (0, 3)
          UNION ALL SELECT doc_id, {'ord': 4, 'name': 'OPS/img/p.png', 'method': 8, 'size': 4} FROM d WHERE kind = 0)
        SELECT doc_id, x.ord::BIGINT AS ord, x.name AS name, x.method::BIGINT AS method, x.size::BIGINT AS uncompressed_size, true AS first, CAST(NULL AS VARCHAR) AS error FROM e
        UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, 'format' FROM d WHERE kind IN (1, 2)""",
    "format_claims": f"SELECT doc_id, doc_id % 8 = 3 OR doc_id % 8 = 2 AND text <> '' AND NOT regexp_matches(text, '^[ \\t\\n\\r]*<') AND NOT regexp_matches(text, '^(PK|%PDF)') AS is_text, doc_id % 8 = 1 AS is_fb2 FROM {_D}",
    "css_references": f"""WITH d AS (SELECT doc_id, doc_id::VARCHAR AS n, regexp_replace(substr(text, 1, 200), '[^A-Za-z0-9 ]', '.', 'g') AS w FROM {_D}),
        s AS (SELECT *, 13 + length(n) + 8 + length(w) + 30 + length(n) AS mid FROM d), c AS (SELECT *, '@import "a' || n || '.css"; /* ' || w || ' url(no.png) */ p{{background:url( x' || n || '.png )}} q{{content:''url(no) ' || w || '''}} b{{src:URL("f' || n || '.woff") format("woff")}}' AS css FROM s)
        SELECT doc_id, 'import' AS kind, 'a' || n || '.css' AS value, 8::BIGINT AS start, 15 + length(n) AS "end" FROM c
        UNION ALL SELECT doc_id, 'url', 'x' || n || '.png', strpos(css, 'url( x') - 1, strpos(css, 'url( x') - 1 + 12 + length(n) FROM c
        UNION ALL SELECT doc_id, 'url', 'f' || n || '.woff', strpos(css, 'URL("') - 1, strpos(css, 'URL("') - 1 + 13 + length(n) FROM c""",
    "key_intents": f"""SELECT event_id, key, direction, CASE WHEN key IN ('ArrowRight', 'ArrowLeft') THEN {_EDGE("key = 'ArrowRight'")} WHEN key = 'PageDown' THEN 'next' WHEN key = 'Shift+Space' THEN 'prev' WHEN key = 'Home' THEN 'start' WHEN key = 'End' THEN 'end' ELSE 'none' END AS intent
        FROM (SELECT *, [{', '.join(f"'{k}'" for k in _KEYS)}][event_id % {len(_KEYS)} + 1] AS key FROM {_E})""",
    "tap_intents": f"""SELECT event_id, CASE WHEN width <= 0 THEN 'none' WHEN value / width < 1/3::DOUBLE THEN {_EDGE('false')} WHEN value / width >= 2/3::DOUBLE THEN {_EDGE('true')} ELSE 'none' END AS intent
        FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN 0::DOUBLE ELSE 30::DOUBLE + event_id % 50 END AS width FROM {_E})""",
    "gestures": f"""SELECT event_id, CASE WHEN abs(dx) > 30 AND abs(dx) > abs(dy) THEN 'swipe' WHEN abs(dx) <= 10 AND abs(dy) <= 10 THEN 'tap' ELSE 'none' END AS gesture,
        CASE WHEN abs(dx) < 1 THEN 'none' ELSE {_EDGE('dx < 0')} END AS swipe FROM (SELECT *, event_id * 13 % 101 - 50 AS dx, event_id * 7 % 61 - 30 AS dy FROM {_E})""",
    "protocol_validate": f"SELECT event_id, CASE event_id % 9 WHEN 0 THEN true WHEN 2 THEN true WHEN 6 THEN event_id % 5 - 1 >= 0 AND coalesce(value, 0) >= 0 WHEN 7 THEN true ELSE false END AS accepted FROM {_E}",
    "host_messages": f"SELECT event_id, event_id % 11 IN (0, 2, 7, 9) AS accepted FROM {_E}",
    "column_geometry": f"""SELECT event_id, (width - 2 * gap - (columns - 1) * gap) / columns AS column_width, columns * ((width - 2 * gap - (columns - 1) * gap) / columns + gap) AS stride
        FROM (SELECT event_id, 400 + coalesce(value, 0) AS width, (event_id % 50)::DOUBLE AS gap, event_id % 3 + 1 AS columns FROM {_E})""",
    "href_ladder": f"""WITH g AS (SELECT page_id AS n, CASE page_id % 4 WHEN 0 THEN 'text/ch' || page_id || '.xhtml' WHEN 1 THEN 'notes' || page_id WHEN 2 THEN 'deep/er/n' || page_id || '.htm' ELSE 'dup/ch' || (page_id - 3) || '.xhtml' END AS own FROM pages WHERE page_id IS NOT NULL),
        s AS (SELECT n AS section_index, own AS section_id, {_SEG('own')} AS tail FROM g),
        f AS (SELECT 'f' || n // 2 AS fragment, arg_min(CASE WHEN n % 5 = 0 THEN 'gone' ELSE own END, n) AS section_id FROM g WHERE n % 3 > 0 GROUP BY 1),
        h AS (SELECT n AS href_id, CASE n % 7 WHEN 0 THEN 'text/ch' || n || '.xhtml' WHEN 1 THEN '../ch' || (n - 1) || '.xhtml' WHEN 2 THEN 'other/notes' || (n - 1) || '.xhtml' WHEN 3 THEN 'x/n' || (n - 1) || '.html' WHEN 4 THEN 'nowhere' WHEN 5 THEN 'ch' || n || '.html?x=a/b' ELSE '.hidden' || n END AS path,
          CASE WHEN n % 2 = 0 THEN 'f' || n // 3 END AS fragment FROM g),
        q AS (SELECT *, {_SEG('path')} AS seg FROM h), k AS (SELECT *, {_STEM('seg')} AS stem FROM q)
        SELECT href_id, CAST(coalesce((SELECT min(section_index) FROM s WHERE section_id = path), (SELECT min(section_index) FROM s WHERE section_id = seg),
            (SELECT min(section_index) FROM s WHERE section_id IN (seg, stem) OR tail IN (seg, stem) OR {_STEM('tail')} = stem),
            (SELECT min(s.section_index) FROM f JOIN s USING (section_id) WHERE f.fragment = k.fragment), -1) AS BIGINT) AS section_index FROM k""",
}
