"""Text kernels: folding, positions, sentences, reading text, search, chunks, style sheets, sanitizer."""

import duckdb
import pytest

from quire.functions import css, markup, matching, positions, unicode
from quire.functions.unicode import Units
from quire.operators import books, reader, sanitize
from quire.plans import queries

SCRIPTS = ["a😀b😀c", "é ö̈ x", "one 👨‍👩‍👧‍👦 two", "日本語のテキスト", "🇩🇪🇫🇷 flags 🇮🇹"]


@pytest.mark.parametrize("text", SCRIPTS)
def test_positions_round_trip_at_every_offset(text):
    units = Units(text)
    for offset in range(units.size + 2):
        place = positions.capture(units, offset, "s")
        parsed, error = positions.parse(place["serialized"])
        assert error is None and parsed["offset_g"] == place["offset_g"]
        assert positions.resolve(units, parsed["exact"], parsed["prefix"], parsed["suffix"], parsed["offset_g"])[0] == place["offset_g"]


def test_serialized_form():
    place = positions.capture(Units("Hello wide world"), 8, "c\"1")
    assert place["serialized"] == 'wr1:{"v":1,"s":"c\\"1","p":0.375,"e":"wide world","pre":"Hello ","suf":"","o":6}'
    assert [positions.number(x) for x in (0.0, 1.0, 7.77e-06, 1e-7, 123456789.0)] == ["0", "1", "0.00000777", "1e-7", "123456789"]


@pytest.mark.parametrize(("text", "why"), [("x", "prefix"), ("wr1:{", "json"), ("wr1:{}", "fields"), ('wr1:{"v":9,"s":"","p":0,"e":"","pre":"","suf":"","o":0}', "version")])
def test_bad_positions(text, why):
    assert positions.parse(text) == (None, why)


def test_resolve_prefers_context_then_distance_then_first():
    units = Units("red fox. blue fox. red fox.")
    assert positions.resolve(units, "fox", "blue ", "", 0) == (14, 3)
    assert positions.resolve(units, "fox", "", "", 22) == (23, 3)
    assert positions.resolve(units, "fox", "", "", 9)[0] == 4
    assert positions.resolve(units, "cat", "", "", 0) is None
    assert positions.resolve(units, "", "", "", 99) == (27, 0)


def test_sentences():
    found = [s["text"] for s in positions.sentences("It rained. “Go in!” she\nsaid. The end", "s")]
    assert found == ["It rained.", "“Go in!” she said.", "The end"] or found == ["It rained.", "“Go in!”", "she said.", "The end"]
    assert positions.sentences("  \n ", "s") == []


def test_sentences_count_leaves_words_whole_as_its_sql_does(spark, tmp_path):
    texts = ["SHOUT!! HA.18@MAIL1.EXAMPLE.COM!! AND!! MORE", "Version 2.0.In use. Now", "EAU!!De la", "好。再！Ja?nein", "He left.” She stayed.", "Plain a.b text. Next", "One.\nTwo!Three", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(queries.ORACLES["sentences_count"]).fetchall())
    assert {r.doc_id: r.sentences for r in queries.sentences_count(spark, str(tmp_path)).collect()} == want
    assert want[0] == 4 and len(unicode.sentence_runs(texts[0])) == 5  # UAX #29 ends one in the address


def test_fold():
    assert unicode.fold(" ‘A’ –  “B”\n") == "'a' - \"b\""
    assert unicode.fold("Café ΟΔΟΣ") == "café οδοσ"
    text, places = unicode.fold_map("A \t B")
    assert text == "a b" and places == [0, 4, 4, 5]


def test_search_is_literal_and_does_not_overlap():
    hits = matching.search("aaaa", "aa", "s", 0)
    assert [h["start_u16"] for h in hits] == [0, 2]
    assert matching.search("text", "  ", "s", 0) == []
    assert matching.search("x 😀 The “End”", 'the "end"', "s", 0)[0]["text"] == "The “End”"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<b>b</b> c</p>", "ab c"), ("<head><title>t</title></head><p>x", "x"), ("<p>1<script>var a='</p>'</script>2", "12"),
        ("<p>&amp;&#65;&#x42;&nope;&lt;", "&AB&nope;<"), ("<p><![CDATA[<i>&amp;]]></p>", "<i>&amp;"), ("<body> \n <p>x</p> \n </body>", "x"),
        ('<p><img src="a.png" alt="pic">', "pic"), ('<p><img src="http://x/a.png" alt="pic">', ""), ("<p>a < b", "a < b"), ('<p title="a>b">c', 'b">c'),
        ("<p><svg><title>s</title><script>x</script></svg>", "s"), ("<ul><li>a<li>b</ul>", "ab"),
    ],
)
def test_reading_text(html, text):
    assert markup.reading_text(html) == text


def test_served_images_read_as_nothing():
    assert markup.reading_text('<p><img src="./i/a.png" alt="x">', {"i/a.png": "image/png"}) == ""


def test_references():
    assert [markup.classify(x)[0] for x in ("", " #a", "a/b", "HTTP:x", "java\tscript:x")] == ["empty", "fragment", "relative", "scheme", "scheme"]
    assert markup.normalize_reference("../a/./b/../c") == "../a/c"


def test_chunks():
    chunks, stats = books.pack([("P", 60), ("H2", 10), ("P", 50), ("P", 200), ("P", 5)], 100)
    assert chunks == [(0, 1, 60), (1, 3, 60), (3, 4, 200), (4, 5, 5)]
    assert stats["headings_deferred"] == 1 and stats["oversized"] == 1
    assert books.pack([], 100)[0] == []


def test_css():
    sheet = '@import url("b.css"); a{b:url(x.png)} /* url(n) */ c{d:"url(n)"; e:myurl(n)}'
    assert [(r["kind"], r["value"]) for r in css.references(sheet)] == [("import", "b.css"), ("url", "x.png")]
    assert css.rewrite("a{b:url(x)}", lambda k, v: None) == "a{b:url(x)}"
    files = {"s/b.css": ("text/css", '@import "a.css"; q{r:url(p.png)}'), "s/p.png": ("image/png", b"hi")}
    assert "about:invalid" not in css.inline("a{b:url(p.png)}", "s/a.css", files.get)
    import base64

    nested = css.inline(sheet.replace("x.png", "gone.png"), "s/a.css", files.get)
    inner = base64.b64decode(nested.split("base64,")[1].split('"')[0]).decode()
    assert "about:invalid" in inner and "aGk=" in inner and 'url("about:invalid")' in nested


@pytest.mark.parametrize(
    ("source", "kept"),
    [
        ("<p onclick='x' class='c'>t</p>", '<p class="c">t</p>'), ("<a href='javascript:x'>t</a>", "<a>t</a>"), ("<a href='#f'>t</a>", '<a href="#f">t</a>'),
        ("<font><b>t</b></font>", "<b>t</b>"), ("<iframe src='x'></iframe>t", "t"), ("<img src='data:image/png;base64,x'>", '<img src="data:image/png;base64,x">'),
        ("<p>a<!-- c -->b</p>", "<p>ab</p>"), ("<link rel='icon' href='x'>t", "t"),
    ],
)
def test_sanitizer(source, kept):
    assert sanitize.sanitize(source, "text/html")["html"] == kept


def test_sanitizer_tallies_and_fallback():
    out = sanitize.sanitize("<html><body><script/><script/><font/><use/></body></html>")
    assert out["elements_removed"] == [{"name": "script", "count": 2}] and not out["parse_fallback"]
    assert sanitize.sanitize("<p>open")["parse_fallback"]


def test_messages_appearance_and_navigation():
    assert reader.frame_message('{"v":13,"type":"error","message":"m","x":1}') == '{"v": 13, "type": "error", "message": "m"}'
    assert reader.frame_message('{"v":true,"type":"ready"}') is None
    merged = reader.merge_appearance({"theme": "dark", "fontSize": 12, "customProperties": {"a": "1"}}, {"theme": None, "customProperties": {"b": "2"}})
    assert merged == {"fontSize": 12, "customProperties": {"a": "1", "b": "2"}}
    assert reader.theme_variables(merged)["--b"] == "2" and reader.theme_variables({}) is None
    assert reader.typography_variables({"justify": True, "fontSize": 12}) == {"--wr-font-size": "12px", "--wr-text-align": "justify"}
    assert reader.reflows({"columns": 2}) and not reader.reflows({"theme": "dark"})
    r = reader.Reader([2, 3])
    assert [r.apply("next"), r.apply("next"), r.place] == ["moved", "moved", (1, 0)]
    assert r.apply("link", 9) == "error" and r.apply("link", 0) == "moved" and r.apply("back") == "moved" and r.place == (1, 0)


def test_word_starts_near_and_whole():
    """The word around an offset is the same whether its surroundings or the whole text are cut."""
    from quire.functions import unicode as U

    for text in ("a  b c'd e.f  .g ́h i", "don't  3.14 a_b x‍y  ́z", " lead", "x " * 500, "日本語 abc 한국어  a", "a:b c,d 1,2", " \n a \n\nb", "word" * 300 + " end"):
        near, whole = U.Units(text), U.Units(text)
        edges = [m.start() for m in U._WORD_EDGE.finditer(text)]
        whole._words = edges if edges and edges[0] == 0 else [0, *edges]
        assert [near.word_start(g) for g in range(len(near.parts) + 1)] == [whole.word_start(g) for g in range(len(whole.parts) + 1)]


def test_search_form_cuts_only_what_is_not_plain(monkeypatch):
    """It is the form that grapheme by grapheme cutting gives, and a long plain stretch is not cut."""
    import random

    rng, signs = random.Random(2), ["a", "E", " ", "\t", "\r\n", "\u0301", "\u030a", "\u200b", "\u200d", "©", "—", "’", "\u3000", "\xa0", "\u0600", "😀", "🇩", "\u1100", "\u1161", "가", "İ", "É", "ß", "क", "\u094d", " \u0301"]
    for _ in range(20_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 12)))
        assert unicode.fold(text) == unicode.fold_map(text)[0] or unicode._PLAIN.fullmatch(text), text
    cut = []
    monkeypatch.setattr(unicode, "_folded", lambda part, keep=unicode._folded: cut.append(part) or keep(part))
    assert unicode.fold("Words  of a text. " * 500 + " E\u0301 end") == "words of a text. " * 500 + "é end"
    assert len(cut) < 5
