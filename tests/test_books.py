"""Archives, XML and book decoders on generated fixtures."""

import io
import zipfile

import pytest

from quire.plans import fixtures
from quire.sources import archive, decode, xmltree


def test_archive_round_trip():
    for body in (b"", b"x" * 100_000, bytes(range(256)) * 9):
        a = archive.Archive(fixtures.archive([("s", body), ("d", body)], stored=("s",)))
        assert a.read("s") == body and a.read("d") == body


def test_data_descriptor_and_zip64():
    class Unseekable(io.BytesIO):
        def seekable(self):
            return False

        def seek(self, *a):
            raise OSError

        def tell(self):
            raise OSError

    out = Unseekable()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"hello")
        with z.open(zipfile.ZipInfo("b"), "w", force_zip64=True) as f:
            f.write(b"wide")
    a = archive.Archive(out.getvalue())
    assert a.read("a") == b"hello" and a.read("b") == b"wide"


@pytest.mark.parametrize(
    ("entry", "kind"),
    [({"flags": 1}, "encrypted"), ({"method": 12}, "unsupported"), ({"crc": 1}, "corrupt"), ({"size": 10}, "corrupt")],
)
def test_refused_entries(entry, kind):
    a = archive.Archive(fixtures.raw_archive([{"name": "x", "body": b"y" * 9000, **entry}]))
    with pytest.raises(archive.ArchiveError) as e:
        a.read("x")
    assert e.value.kind == kind


def test_first_record_wins_and_comments():
    a = archive.Archive(fixtures.raw_archive([{"name": "x", "body": b"1"}, {"name": "x", "body": b"2"}], comment=b"PK\5\6 not the end" * 99))
    assert a.read("x") == b"1" and len(a.entries) == 2
    for broken in (b"", b"no archive at all, but long enough", fixtures.raw_archive([{"name": "x", "body": b"1"}]) + b"tail"):
        with pytest.raises(archive.ArchiveError):
            archive.Archive(broken)


@pytest.mark.parametrize("bad", ["", "<a>", "<a></b>", "<a b></a>", "<a b=c/>", "<a/><b/>", "<a", "<!-- <a/>"])
def test_strict_xml_refuses(bad):
    with pytest.raises(xmltree.XmlError):
        xmltree.parse(bad)


def test_tolerant_xml():
    root = xmltree.parse("<r><a b c=d/>x<i>y</r><z/>", tolerant=True)
    assert root.first("a").attributes == {"b": "", "c": "d"} and root.deep_text() == "xy"
    assert xmltree.decode('<?xml version="1.0" encoding="windows-1251"?><a>Ж</a>'.encode("cp1251")).endswith("<a>Ж</a>")
    assert xmltree.decode("﻿<a/>".encode("utf-16-le")) == "<a/>"


def test_epub():
    book = decode.decode(fixtures.epub())
    assert (book["title"], book["identifier"], book["cover"], book["fixed_layout"]) == ("The Small Lamp", "urn:x:1", "OPS/img/p.png", False)
    assert [(s["section_id"], s["linear"]) for s in book["sections"]] == [("c1", True), ("c2", False)]
    assert [(t["label"], t["depth"], t["section_id"], t["fragment"]) for t in book["toc"]] == [("One", 0, "c1", None), ("One b", 1, "c1", "b"), ("Part", 0, "c2", None), ("Two", 1, "c2", None)]
    assert [r["resource_id"] for r in book["resources"]] == ["OPS/nav.xhtml", "OPS/img/p.png"]


def test_epub_fallback_obfuscation_and_faults():
    spine = fixtures.OPF.replace('<itemref idref="gone"/>', '<itemref idref="odd"/>')
    assert decode.decode(fixtures.epub(spine))["sections"][-1]["media_type"] == "application/xhtml+xml"
    circle = spine.replace('fallback="c1"', 'fallback="odd"')
    assert decode.decode(fixtures.epub(circle))["error"]["kind"] == "CorruptContainer"
    rule = '<e xmlns:x="x"><EncryptedData><EncryptionMethod Algorithm="{}"/><CipherReference URI="OPS/img/p.png"/></EncryptedData></e>'
    ours = decode.decode(fixtures.epub(extra=(("META-INF/encryption.xml", rule.format("http://www.idpf.org/2008/embedding").encode()),)))
    assert decode.deobfuscate(ours["resources"][1]["content"], " urn:x:1 ") == b"\x89PNG"
    other = decode.decode(fixtures.epub(extra=(("META-INF/encryption.xml", rule.format("aes").encode()),)))
    assert other["resources"][1]["error"] == "EncryptedContent"
    assert decode.decode(fixtures.epub(drop=("META-INF/container.xml",)))["error"]["kind"] == "CorruptContainer"
    assert decode.decode(b"nothing")["error"]["kind"] == "UnrecognizedFormat"


def test_fb2():
    book = decode.decode(fixtures.FB2.encode())
    assert (book["title"], book["author"], book["identifier"], book["cover"]) == ("Two Roads", "Ann Onym", "doc-7", "cov")
    assert [s["section_id"] for s in book["sections"]] == ["s0", "s1", "nb0"]
    first = book["sections"][0]["content"].decode()
    assert "<h1>Two Roads</h1>" in first and '<a href="nb0#n1">1</a>' in first and '<div class="fb2-section" id="a1"><h3>Inner</h3>' in first
    assert [(t["label"], t["fragment"]) for t in book["toc"]] == [("First", None), ("Inner", "a1"), ("Section 2", None)]
    assert [r["content"] for r in book["resources"]] == [b"hi"]


def test_text():
    assert decode.claims_text(b"words") and decode.claims_text(b"\xff\xfe<") and not any(map(decode.claims_text, (b"", b"PK\3\4", b" <p>", b"a\0b")))
    assert decode.decode_text(b"caf\xe9 \x81") == "café \x81" and decode.decode_text("é".encode("utf-16")) == "é"


def test_hrefs():
    assert decode.resolve_href("a/b/", "../c%20d.x#f%20g") == ("a/c d.x", "f g")
    assert decode.resolve_href("a/", "/r/./s") == ("r/s", None) and decode.resolve_href("", "..") is None and decode.resolve_href("", "http:x") is None
    assert decode.resolve_href("", "a%zz") == ("a%zz", None)


def test_plain_text_book():
    data = "Title: A  Way\r\nAuthor: B. C\r\n\r\nFirst & only\r\n  line.\r\n\r\nCHAPTER I\r\n\r\nBody.".encode("utf-16")
    book = decode.decode(data, ("epub", "fb2", "text"))
    assert (book["format"], book["title"], book["author"], book["error"]) == ("text", "A Way", "B. C", None)
    assert [s["section_id"] for s in book["sections"]] == ["s0", "s1"]
    assert b"<p>First &amp; only line.</p>" in book["sections"][0]["content"] and b"<h2>CHAPTER I</h2><p>Body.</p>" in book["sections"][1]["content"]
    assert [(t["label"], t["section_id"]) for t in book["toc"]] == [("CHAPTER I", "s1")]
    assert decode.decode(b"", ("text",))["error"]["kind"] == "UnrecognizedFormat" and decode.decode(b"\xef\xbb\xbf", ("text",))["sections"][0]["section_id"] == "s0"


def test_host_messages_keep_known_fields():
    from quire.operators import reader

    assert reader.host_message('{"v":13,"type":"goToPage","id":1,"page":2,"more":3}') == '{"v": 13, "type": "goToPage", "id": 1, "page": 2}'
    assert reader.host_message('{"v":13,"type":"goToPage","id":1}') is None and reader.host_message('{"v":13,"type":"tap","id":1}') is None


def test_files_become_books(spark, tmp_path):
    """Archives and single-file books read by Spark's own reader of files."""
    from quire.plans import fixtures
    from quire.sources import decode

    (tmp_path / "a.epub").write_bytes(fixtures.text_epub("a", "en", "One.\nTwo & <three>."))
    (tmp_path / "b.fb2").write_bytes(fixtures.text_fb2("b", "fr", "Un."))
    (tmp_path / "c.bin").write_bytes(b"\0\0")
    books = decode.read_books(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"))
    found = {r.path.rsplit("/", 1)[1]: (r.format, r.language, len(r.sections), r.error and r.error.kind) for r in books.collect()}
    assert found == {"a.epub": ("epub", "en", 1, None), "b.fb2": ("fb2", "fr", 1, None), "c.bin": (None, None, 0, "UnrecognizedFormat")}


def test_resources_in_documents():
    from quire.operators import resources

    files = [("d/a.css", "Text/CSS ; x", b"@import 'b.css'; @import 'p.png'; i{background:url(http://x.org/i)}"), ("d/b.css", "text/css", b"@import url(a.css);"), ("d/p.png", "image/png", b"P"), ("d/p.png", "image/png", b"second")]
    files = [dict(zip(("path", "media_type", "content"), f)) for f in files]
    out = resources.apply_resources('<link href="a.css"><link><p>a<img alt="x">b<img src="data:,1"><img src="p.png#f"><img src="gone"></p><style>i{background:url(gone)}</style>', "d/s.xhtml", files)
    assert out["alt_substituted"] == 1 and "axb" in out["html"] and out["html"].count("<link") == 1 and out["html"].count("<img") == 2
    assert 'src="data:image/png;base64,UA=="' in out["html"] and 'url("about:invalid")' in out["html"]
    assert resources.apply_resources("", "", None) == {"html": "", "alt_substituted": 0}
    assert resources.top_level_nodes("<body> <p>ab</p>\n x<br>😀</body>") == [{"tag": "P", "chars": 2}, {"tag": "#text", "chars": 3}, {"tag": "BR", "chars": 0}, {"tag": "#text", "chars": 2}]
    assert resources.element_offsets('<p>ab<i id="x">c</i></p> <p id="y"></p><b id="x">d</b>') == [{"id": "x", "offset": 2}, {"id": "y", "offset": 3}]


def test_resolved_paths(spark):
    from pyspark.sql import functions as F

    from quire.operators import resources
    from quire.sources import decode

    cases = [(b, r) for b in ("", "a/b/") for r in ("c.png", "../c.png", "../../../c.png", "/c//d", "./x%20y+z", "%zz", "%ff", "#f", "", "x:y", "..", "q#r#s", "é%C3%A9")]
    df = spark.createDataFrame(cases, "b string, r string").select("b", "r", resources.resolved_path(F.col("b"), F.col("r")).alias("p"))
    for row in df.collect():
        want = decode.resolve_href(row.b, row.r)
        assert row.p == (want and want[0]), row


def test_compatibility_words(spark):
    from pyspark.sql import functions as F

    from quire.functions import columns as C
    from quire.operators import books as B

    rows = [("ﬁne Ｗords’ it’s",), ("plain",), (None,)]
    got = [r.w for r in spark.createDataFrame(rows, "t string").select(B.word_stream(C.nfkc(F.col("t"))).alias("w")).collect()]
    assert got == [["fine", "words", "it's"], ["plain"], None]
