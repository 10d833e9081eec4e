"""The hard rows that were written by hand, through the same functions that queries use on the tables; each with SQL or
values that say what must come out."""

from __future__ import annotations

import itertools
import json

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import columns as C
from quire.functions import css
from quire.functions.unicode import SMART
from quire.operators import books as B
from quire.operators import layout as L
from quire.operators import reader as R
from quire.plans import fixtures
from quire.plans.queries import SPACE_SQL
from quire.sources import decode as D

def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows, names):
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS v({names})"


_SMART_FROM, _SMART_TO = "".join(SMART), "".join(SMART.values()).replace("'", "''")

_FOLD_ROWS = [
    (0, "‘Quoted’ and “double”"), (1, "dash – dash — dash"), (2, "Café NAÏVE"), (3, "a b c"),
    (4, "  lead\tand\ntrail  "), (5, "é combining"), (6, ""), (7, "−‐′″"), (8, "zero​width"),
]
_META_ROWS = [
    (0, "Title: The  Long Way\nAuthor: A. Writer\n\nText"), (1, "The Project Gutenberg eBook of Some Book, by Some One\nmore"), (2, "no fields here"), (3, "x\nTITLE: Loud\n"),
]
_CRC_ROWS = [(0, "123456789"), (1, ""), (2, "The quick brown fox jumps over the lazy dog")]
_MANIFEST = [("m1", "a.xhtml", 0), ("m2", "b.xhtml", 1), ("m3", "img.png", 2), ("m4", "missing.xhtml", 3)]
_SPINE = [("m2", 0), ("m1", 1), ("m2", 2), ("m9", 3)]
_ENTRIES = [("a.xhtml",), ("b.xhtml",), ("img.png",)]
def _manifest(spark):
    return literals(spark, _MANIFEST, "id string, path string, ord long"), literals(spark, _SPINE, "idref string, pos long"), literals(spark, _ENTRIES, "name string")
def _books(spark):
    rows = [(0, bytearray(fixtures.epub())), (1, bytearray(fixtures.FB2.encode())), (2, bytearray(b"plain words")), (3, bytearray(fixtures.epub(drop=("OPS/book.opf",))))]
    return literals(spark, rows, "book_id long, content binary")
_CLAIMS = [(0, "504B0304"), (1, "3C46696374696F6E426F6F6B3E"), (2, "68656C6C6F"), (3, "EFBBBF3C"), (4, ""), (5, "25504446"), (6, "610062"), (7, "203C70")]
_SHEETS = [(0, '@import "a.css"; p{background:url(x.png)}'), (1, "/* url(no) */ q{content:'url(no)'}"), (2, 'b{src:url( "f.woff" ) format("woff")}')]
_GRID = [(k, d) for k, d in itertools.product(["ArrowRight", "ArrowLeft", "PageDown", "Shift+Space", "Home", "End", "x"], ["ltr", "rtl"])]
_TAPS = [(float(x), 90.0, d) for x, d in itertools.product((0, 29, 30, 59, 60, 89), ("ltr", "rtl"))] + [(1.0, 0.0, "ltr")]
_DRAGS = [(i, float(dx), float(dy)) for i, (dx, dy) in enumerate([(40, 3), (-40, 3), (31, 40), (5, 5), (11, 0), (0, 12), (30, 0)])]
_MESSAGES = [
    (0, '{"v":13,"type":"ready"}'), (1, '{"v":12,"type":"ready"}'), (2, '{"v":13,"type":"tap","x":1,"y":2,"width":3,"height":4,"more":true}'),
    (3, '{"v":13,"type":"pong","id":"1"}'), (4, "not json"), (5, '{"v":13,"type":"decorationtap","x":1,"y":1,"decorations":[]}'),
    (6, '{"v":13,"type":"selection","start":0,"end":2,"text":"ab","rect":{"x":0,"y":0,"width":1,"height":1},"rects":[]}'),
]
_SECTIONS = [(0, "text/ch1.xhtml"), (1, "text/ch2.xhtml"), (2, "notes"), (3, "deep/er/notes.htm"), (4, "s.tar.gz"), (5, "dup/ch1.xhtml")]
_TOC = [(0, "text/ch2.xhtml", "frag"), (1, "notes", "frag"), (2, "gone", "lost"), (3, "notes", None)]
_HREFS = [
    (0, "text/ch1.xhtml", None), (1, "../ch2.xhtml", None), (2, "other/notes.xhtml", None), (3, "notes.htm", None), (4, "x/s.tar", None), (5, "nowhere", "frag"),
    (6, "nowhere", "lost"), (7, "nowhere", None), (8, "ch1.html?x=a/b", None), (9, "dup/ch1.xhtml", "frag"), (10, ".hidden", None),
]
_SEG = lambda c: f"regexp_extract(regexp_replace({c}, '\\?.*$', ''), '[^/]*$')"
_STEM = lambda c: f"CASE WHEN strpos(reverse({c}), '.') BETWEEN 1 AND length({c}) - 1 THEN substr({c}, 1, length({c}) - strpos(reverse({c}), '.')) ELSE {c} END"
_OK = {"mode": "paginated", "pageWidth": 1, "pageHeight": 2, "columnGap": 3, "chunkChars": 4, "windowChunks": 5, "columnCount": 1}
_HOST = [
    *[(i, json.dumps({"v": 13, "type": t, "id": 1})) for i, t in enumerate(("ping", "measure", "relayout", "sectionText", "diagnostics", "goToPage", "ready"))],
    (7, json.dumps({"v": 13, "type": "paginate", "id": 2, "options": _OK})), (8, json.dumps({"v": 13, "type": "paginate", "id": 2, "options": {**_OK, "mode": "flat"}})),
    (9, json.dumps({"v": 13, "type": "decorate", "id": 3, "decorationId": "d", "start": 0, "end": 1, "className": "c"})), (10, json.dumps({"v": 13, "type": "decorate", "id": 3, "decorationId": 1, "start": 0, "end": 1, "className": "c"})),
    (11, json.dumps({"v": 13, "type": "goToPage", "id": 3, "page": 2})), (12, json.dumps({"v": 12, "type": "ping", "id": 1})), (13, json.dumps({"v": 13, "type": "ping", "id": "1"})), (14, "[]"),
]


def fold_literals(spark, sf_dir):
    return literals(spark, _FOLD_ROWS, "id long, raw string").select("id", C.fold("raw").alias("folded"))


def text_metadata_literals(spark, sf_dir):
    rows = literals(spark, _META_ROWS, "id long, t string")
    title = F.coalesce(C.metadata_field(F.col("t"), "Title"), C.banner_field(F.col("t"), 1))
    own = C.metadata_field(F.col("t"), "Title").isNotNull()
    author = F.coalesce(C.metadata_field(F.col("t"), "Author"), F.when(~own, C.banner_field(F.col("t"), 2)))
    return rows.select("id", title.alias("title"), author.alias("author"))


def crc32_vectors(spark, sf_dir):
    return literals(spark, _CRC_ROWS, "id long, s string").select("id", F.crc32(F.col("s").cast("binary")).alias("crc"))


def sha1_key(spark, sf_dir):
    rows = literals(spark, [(0, " urn:uuid:1-2\t"), (1, "a b\r\nc")], "id long, s string")
    return rows.select("id", F.sha1(F.regexp_replace("s", r"[ \t\r\n]", "").cast("binary")).alias("key"))


def spine_join(spark, sf_dir):
    manifest, spine, _ = _manifest(spark)
    first = B.first_wins(spine, ["idref"], ["pos"])
    return first.join(B.small(manifest), first["idref"] == manifest["id"]).select("idref", "path", "pos")


def manifest_semi(spark, sf_dir):
    manifest, _, entries = _manifest(spark)
    return manifest.join(B.small(entries), manifest["path"] == entries["name"], "left_semi").select("id", "path")


def manifest_anti(spark, sf_dir):
    manifest, spine, _ = _manifest(spark)
    return manifest.join(B.small(spine), manifest["id"] == spine["idref"], "left_anti").select("id", "path")


def decoded_books(spark, sf_dir):
    books = D.read_books(_books(spark))
    return books.select("book_id", "format", "title", "author", "language", "identifier", "cover", "direction", "fixed_layout", F.col("error.kind").alias("error"))


def decoded_sections(spark, sf_dir):
    found = D.sections_of(D.read_books(_books(spark)), "book_id")
    return found.select("book_id", "section_index", "section_id", "linear", C.reading_text(C.section_text(F.col("content"))).alias("text"))


def decoded_toc(spark, sf_dir):
    return D.toc_of(D.read_books(_books(spark)), "book_id")


def decoded_resources(spark, sf_dir):
    return D.resources_of(D.read_books(_books(spark)), "book_id").select("book_id", "resource_id", "media_type", F.length("content").alias("size"))


def archive_entries(spark, sf_dir):
    return D.list_archives(_books(spark), "book_id").select("book_id", "ord", "name", "method", "uncompressed_size", "first", "error")


def format_claims(spark, sf_dir):
    """Claims of plain text and FB2 on the first bytes, as expressions."""
    rows = literals(spark, _CLAIMS, "id long, h string").select("id", F.unhex("h").alias("b"))
    x = F.hex(F.substring("b", 1, 512))
    mark = x.rlike("^(EFBBBF|FFFE|FEFF)")
    other = x.rlike("^(504B0304|25504446)") | x.rlike("^(?:20|09|0A|0D|EF|BB|BF)*3C") | x.rlike("^(?:..)*?00")
    text = (F.length(x) > 0) & (mark | ~other)
    fb2 = F.decode(F.substring("b", 1, 1024), "ISO-8859-1").rlike(r"<\s*FictionBook[\s>]")
    return rows.select("id", text.alias("is_text"), fb2.alias("is_fb2"))


def css_references(spark, sf_dir):
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    found = literals(spark, _SHEETS, "id long, css string").select("id", F.explode(C.kernel(css.references, kind)(F.col("css"))).alias("r"))
    return found.select("id", "r.kind", "r.value", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


def key_intents(spark, sf_dir):
    return literals(spark, _GRID, "key string, direction string").select("key", "direction", R.key_intent(F.col("key"), F.col("direction")).alias("intent"))


def tap_intents(spark, sf_dir):
    return literals(spark, _TAPS, "x double, width double, direction string").select("x", "width", "direction", R.tap_intent(F.col("x"), F.col("width"), F.col("direction")).alias("intent"))


def gestures(spark, sf_dir):
    rows = literals(spark, _DRAGS, "id long, dx double, dy double")
    return rows.select("id", R.gesture(F.col("dx"), F.col("dy")).alias("gesture"), R.swipe_intent(F.col("dx"), F.lit("ltr")).alias("swipe"))


def protocol_validate(spark, sf_dir):
    valid = C.kernel(R.frame_message, T.StringType())(F.col("m"))
    return literals(spark, _MESSAGES, "id long, m string").select("id", valid.isNotNull().alias("accepted"))


def column_geometry(spark, sf_dir):
    rows = literals(spark, [(0, 800.0, 40.0, 1), (1, 800.0, 40.0, 2), (2, 1200.0, 20.0, 2)], "id long, width double, gap double, columns int")
    w = B.column_width(F.col("width"), F.col("gap"), F.col("columns"))
    return rows.select("id", w.alias("column_width"), (F.col("columns") * (w + F.col("gap"))).alias("stride"))


def href_ladder(spark, sf_dir):
    return L.href_sections(
        literals(spark, _HREFS, "href_id long, path string, fragment string"), literals(spark, _SECTIONS, "section_index int, section_id string"),
        literals(spark, _TOC, "node_id int, section_id string, fragment string"),
    )


def host_messages(spark, sf_dir):
    valid = C.kernel(R.host_message, T.StringType())(F.col("m"))
    return literals(spark, _HOST, "id long, m string").select("id", valid.isNotNull().alias("accepted"))


ORACLES = {
    "fold_literals": f"SELECT CAST(id AS BIGINT) AS id, trim(regexp_replace(lower(nfc_normalize(translate(raw, '{_SMART_FROM}', '{_SMART_TO}'))), '[{SPACE_SQL}\\x{{200B}}]+', ' ', 'g')) AS folded FROM {_values(_FOLD_ROWS, 'id, raw')}",
    "text_metadata_literals": "SELECT * FROM (VALUES (0::BIGINT, 'The Long Way', 'A. Writer'), (1, 'Some Book', 'Some One'), (2, NULL, NULL), (3, 'Loud', NULL)) AS v(id, title, author)",
    "crc32_vectors": "SELECT * FROM (VALUES (0::BIGINT, 3421780262::BIGINT), (1, 0), (2, 1095738169)) AS v(id, crc)",
    "sha1_key": "SELECT * FROM (VALUES (0::BIGINT, sha1('urn:uuid:1-2')), (1, sha1('abc'))) AS v(id, key)",
    "spine_join": f"SELECT idref, path, pos FROM (SELECT idref, CAST(min(pos) AS BIGINT) AS pos FROM {_values(_SPINE, 'idref, pos')} GROUP BY idref) JOIN (SELECT * FROM {_values(_MANIFEST, 'id, path, ord')}) ON id = idref",
    "manifest_semi": f"SELECT id, path FROM {_values(_MANIFEST, 'id, path, ord')} WHERE path IN (SELECT name FROM {_values(_ENTRIES, 'name')})",
    "manifest_anti": f"SELECT id, path FROM {_values(_MANIFEST, 'id, path, ord')} WHERE id NOT IN (SELECT idref FROM {_values(_SPINE, 'idref, pos').replace('AS v', 'AS s')})",
    "decoded_books": """SELECT * FROM (VALUES (0::BIGINT, 'epub', 'The Small Lamp', 'N. Body', 'en', 'urn:x:1', 'OPS/img/p.png', 'ltr', false, NULL),
        (1, 'fb2', 'Two Roads', 'Ann Onym', 'en', 'doc-7', 'cov', NULL, NULL, NULL), (2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'UnrecognizedFormat'),
        (3, 'epub', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'CorruptContainer')) AS v(book_id, format, title, author, language, identifier, cover, direction, fixed_layout, error)""",
    "format_claims": "SELECT * FROM (VALUES (0::BIGINT, false, false), (1, false, true), (2, true, false), (3, true, false), (4, false, false), (5, false, false), (6, false, false), (7, false, false)) AS v(id, is_text, is_fb2)",
    "css_references": "SELECT * FROM (VALUES (0::BIGINT, 'import', 'a.css', 8::BIGINT, 15::BIGINT), (0, 'url', 'x.png', 30, 40), (2, 'url', 'f.woff', 6, 21)) AS v(id, kind, value, start, \"end\")",
    "key_intents": f"""SELECT key, direction, CASE WHEN key IN ('ArrowRight', 'ArrowLeft') THEN CASE WHEN (key = 'ArrowRight') = (direction <> 'rtl') THEN 'next' ELSE 'prev' END
        WHEN key = 'PageDown' THEN 'next' WHEN key = 'Shift+Space' THEN 'prev' WHEN key = 'Home' THEN 'start' WHEN key = 'End' THEN 'end' ELSE 'none' END AS intent FROM {_values(_GRID, 'key, direction')}""",
    "tap_intents": f"""SELECT CAST(x AS DOUBLE) AS x, CAST(width AS DOUBLE) AS width, direction, CASE WHEN width <= 0 THEN 'none' WHEN x / width::DOUBLE < 1/3::DOUBLE THEN CASE direction WHEN 'rtl' THEN 'next' ELSE 'prev' END
        WHEN x / width::DOUBLE >= 2/3::DOUBLE THEN CASE direction WHEN 'rtl' THEN 'prev' ELSE 'next' END ELSE 'none' END AS intent FROM {_values(_TAPS, 'x, width, direction')}""",
    "gestures": "SELECT * FROM (VALUES (0::BIGINT, 'swipe', 'prev'), (1, 'swipe', 'next'), (2, 'none', 'prev'), (3, 'tap', 'prev'), (4, 'none', 'prev'), (5, 'none', 'none'), (6, 'none', 'prev')) AS v(id, gesture, swipe)",
    "protocol_validate": "SELECT * FROM (VALUES (0::BIGINT, true), (1, false), (2, true), (3, false), (4, false), (5, false), (6, true)) AS v(id, accepted)",
    "column_geometry": "SELECT id, (width - 2 * gap - (columns - 1) * gap) / columns AS column_width, columns * ((width - 2 * gap - (columns - 1) * gap) / columns + gap) AS stride FROM (VALUES (0::BIGINT, 800.0::DOUBLE, 40.0::DOUBLE, 1), (1, 800.0, 40.0, 2), (2, 1200.0, 20.0, 2)) AS v(id, width, gap, columns)",
    "href_ladder": f"""WITH s AS (SELECT section_index, section_id, {_SEG('section_id')} AS tail FROM {_values(_SECTIONS, 'section_index, section_id')}),
        f AS (SELECT fragment, arg_min(section_id, node_id) AS section_id FROM {_values(_TOC, 'node_id, section_id, fragment')} WHERE fragment IS NOT NULL GROUP BY fragment),
        h AS (SELECT *, {_SEG('path')} AS seg FROM {_values(_HREFS, 'href_id, path, fragment')}), k AS (SELECT *, {_STEM('seg')} AS stem FROM h)
        SELECT CAST(href_id AS BIGINT) AS href_id, CAST(coalesce((SELECT min(section_index) FROM s WHERE section_id = path), (SELECT min(section_index) FROM s WHERE section_id = seg),
            (SELECT min(section_index) FROM s WHERE section_id IN (seg, stem) OR tail IN (seg, stem) OR {_STEM('tail')} = stem),
            (SELECT min(s.section_index) FROM f JOIN s USING (section_id) WHERE f.fragment = k.fragment), -1) AS BIGINT) AS section_index FROM k""",
    "host_messages": f"""SELECT CAST(id AS BIGINT) AS id, coalesce(json_valid(m) AND json_type(m) = 'OBJECT' AND m->>'$.v' = '13' AND json_type(m, '$.id') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CASE m->>'$.type'
        WHEN 'ping' THEN true WHEN 'measure' THEN true WHEN 'relayout' THEN true WHEN 'sectionText' THEN true WHEN 'diagnostics' THEN true
        WHEN 'goToPage' THEN json_type(m, '$.page') = 'UBIGINT' WHEN 'paginate' THEN m->>'$.options.mode' IN ('paginated', 'scrolled')
        WHEN 'decorate' THEN json_type(m, '$.decorationId') = 'VARCHAR' ELSE false END, false) AS accepted FROM {_values(_HOST, 'id, m')}""",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_hand_made_rows(spark, name):
    df = globals()[name](spark, None)
    found = duckdb.connect().execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(columns) == sorted(df.columns)
    assert sorted([shown(r[c]) for c in columns] for r in df.collect()) == sorted([shown(v) for v in r] for r in found.fetchall())


@pytest.mark.parametrize("name", ["decoded_sections", "decoded_toc", "decoded_resources", "archive_entries"])
def test_hand_made_files(spark, name):
    assert globals()[name](spark, None).count() > 0


def test_hits_of_many_taps_at_one_point_are_sorted_once(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    taps = spark.range(600).selectExpr("id AS tap_id", "id % 2 * 500D AS x", "10D AS y").union(spark.sql("SELECT 0L, 0D, 10D"))
    boxes = spark.range(200).selectExpr("id % 100 AS id", "id % 100 % 7 AS order", "CAST(id % 3 AS DOUBLE) - 2 AS left", "0D AS top", "70D AS right", "70D AS bottom")
    first = max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)
    got = L.tapped(taps, boxes).collect()
    assert len(got) == 300 * 100  # decorations of two boxes and a repeated tap are one hit each
    want = sorted(range(100), key=lambda i: (-(i % 7), i))
    assert {(r.tap_id, r["rank"]): r.id for r in got} == {(t, k + 1): i for t in range(0, 600, 2) for k, i in enumerate(want)}
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(None) if j > first for s in tracker.getJobInfo(j).stageIds}
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 5_000  # the hits of all taps are 30,000
