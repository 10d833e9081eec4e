"""Small books and archives that queries and tests decode; all prose is invented."""

from __future__ import annotations

import html
import io
import struct
import zipfile
import zlib

CONTAINER = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid">
<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="uid"> urn:x:1 </dc:identifier><dc:title>The Small Lamp</dc:title><dc:creator>N. Body</dc:creator><dc:language>en</dc:language><meta property="rendition:layout">reflowable</meta></metadata>
<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c1" href="text/c1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="text/c%202.xhtml" media-type="application/xhtml+xml"/><item id="pic" href="img/p.png" media-type="image/png" properties="cover-image"/><item id="odd" href="odd.bin" media-type="application/x-odd" fallback="c1"/></manifest>
<spine page-progression-direction="ltr"><itemref idref="c1"/><itemref idref="c2" linear="no"/><itemref idref="c1"/><itemref idref="gone"/></spine></package>"""
NAV = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="text/c1.xhtml">One</a><ol><li><a href="text/c1.xhtml#b">One  b</a></li></ol></li><li><span>Part</span><ol><li><a href="text/c%202.xhtml">Two</a></li></ol></li><li><a href="none.xhtml">Lost</a></li></ol></nav></body></html>'
CHAPTER = '<html xmlns="http://www.w3.org/1999/xhtml"><body><h1>{0}</h1><p>The lamp was small &#8212; and {0} was kind.</p></body></html>'

FB2 = """<?xml version="1.0" encoding="UTF-8"?><FictionBook xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><author><first-name>Ann</first-name><last-name>Onym</last-name></author><book-title>Two Roads</book-title><lang>en</lang><coverpage><image l:href="#cov"/></coverpage></title-info><document-info><id>doc-7</id></document-info></description>
<body><title><p>Two Roads</p></title><section id="a"><title><p>First</p></title><p>Go <emphasis>on</emphasis><a l:href="#n1">1</a>.</p><section id="a1"><title><p>Inner</p></title><p>x</p></section></section><section><p>Second</p></section></body>
<body name="notes"><section id="n1"><p>A note.</p></section></body><binary id="cov" content-type="image/png">aGk=</binary><binary id="bad">***</binary></FictionBook>"""


def archive(entries: list[tuple[str, bytes]], stored: tuple[str, ...] = ()) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries:
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def epub(opf: str = OPF, extra: tuple[tuple[str, bytes], ...] = (), drop: tuple[str, ...] = ()) -> bytes:
    entries = [
        ("mimetype", b"application/epub+zip"), ("META-INF/container.xml", CONTAINER.encode()), ("OPS/book.opf", opf.encode()), ("OPS/nav.xhtml", NAV.encode()),
        ("OPS/text/c1.xhtml", CHAPTER.format("Ada").encode()), ("OPS/text/c 2.xhtml", CHAPTER.format("Bo").encode()), ("OPS/img/p.png", b"\x89PNG"), *extra,
    ]
    return archive([e for e in entries if e[0] not in drop], ("mimetype",))


def _page(lines: list[str]) -> str:
    body = "".join(f"<p>{html.escape(line, quote=False)}</p>" for line in lines)
    return f'<html xmlns="http://www.w3.org/1999/xhtml"><body>{body}</body></html>'


def parts(text: str, size: int = 5) -> list[list[str]]:
    lines = text.split("\n")
    return [lines[at : at + size] for at in range(0, len(lines), size)]


def text_epub(name: str, language: str, text: str) -> bytes:
    """A text as an EPUB: five lines a chapter, every second one outside the linear order, its bytes as an entry."""
    chapters = parts(text)
    items = "".join(f'<item id="c{k}" href="text/c%20{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(chapters)))
    spine = "".join(f'<itemref idref="c{k}"{" linear=" + chr(34) + "no" + chr(34) if k % 2 else ""}/>' for k in range(len(chapters)))
    points = "".join(f'<li><a href="text/c%20{k}.xhtml#top">Part  {k}</a></li>' for k in range(len(chapters)))
    opf = (
        '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="uid">urn:x:{name}</dc:identifier><dc:title>Text  {name}</dc:title><dc:language>{language}</dc:language></metadata><manifest>'
        f'<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="raw" href="raw.txt" media-type="text/plain"/>{items}</manifest><spine>{spine}</spine></package>'
    )
    nav = f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{points}</ol></nav></body></html>'
    entries = [("mimetype", "application/epub+zip"), ("META-INF/container.xml", CONTAINER), ("OPS/book.opf", opf), ("OPS/nav.xhtml", nav), ("OPS/raw.txt", text)]
    entries += [(f"OPS/text/c {k}.xhtml", _page(lines)) for k, lines in enumerate(chapters)]
    return archive([(n, b.encode()) for n, b in entries], ("mimetype", "OPS/raw.txt"))


def nested_epub(name: str, language: str, text: str) -> bytes:
    """A text as an EPUB whose lists have something to decide: five lines a chapter, in groups of three; the even groups
    stand in the contents under their first chapter's link, the odd ones under a bare label. The reading order repeats
    its first chapter and names an item that is not there; an id stands twice; every chapter links to the next."""
    chapters = parts(text)
    n = len(chapters)
    point = lambda k: f'<a href="text/c%20{k}.xhtml#top"><b>Part</b>\n <i>{k}</i></a>'
    groups = []
    for first in range(0, n, 3):
        inner = "".join(f"<li>{point(k)}</li>" for k in range(first + 1, min(first + 3, n)))
        label = f"<span>Group &amp; {first // 3}</span>" if first // 3 % 2 else point(first)
        groups.append(f"<li>{label}{'<ol>' + inner + '</ol>' if inner else ''}</li>")
    item = lambda k, path: f'<item href="{path}" id="c{k}" media-type="application/xhtml+xml"/>'
    items = item(0, "wrong.xhtml") + "".join(item(k, f"text/c%20{k}.xhtml") for k in range(n))
    spine = "".join(f"<itemref idref='c{k}'{' linear=' + chr(34) + 'no' + chr(34) if k % 2 else ''}/>" for k in range(n))
    opf = (
        '<?xml version="1.0" encoding="utf-8"?><!DOCTYPE package [<!ENTITY x "y">]><o:package xmlns:o="http://www.idpf.org/2007/opf" version="3.0"><o:metadata/><!-- <spine> --><o:manifest>'
        f'<o:item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="x nav"/>{items}</o:manifest><o:spine>{spine}<itemref idref="c0"/><itemref idref="gone"/></o:spine></o:package>'
    )
    nav = f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><ol><li><a href="nav.xhtml">x</a></li></ol></nav><nav epub:type="toc"><h1>All</h1><ol>{"".join(groups)}</ol></nav></body></html>'
    container = CONTAINER.replace("<rootfiles>", '<rootfiles><rootfile full-path="other.opf" media-type="text/plain"/>')
    entries = [("mimetype", "application/epub+zip"), ("META-INF/container.xml", container), ("OPS/book.opf", opf), ("OPS/nav.xhtml", nav)]
    links = lambda k: f'<p><a href="c%20{k + 1}.xhtml#a%20b">on</a><a href="../nav.xhtml">all</a><a href="#top">up</a><a href="http://example.org/">out</a></p>'
    entries += [(f"OPS/text/c {k}.xhtml", _page(lines).replace("</body>", links(k) + "</body>")) for k, lines in enumerate(chapters)]
    return archive([(e, b.encode()) for e, b in entries], ("mimetype",))


def rich_epub(name: str, language: str, text: str) -> bytes:
    """A text as an EPUB with an author, a cover, a direction, a layout and resources; five lines a chapter."""
    chapters, number = parts(text), int(name)
    items = "".join(f'<item id="c{k}" href="text/c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(chapters)))
    direction = ' page-progression-direction="rtl"' if number % 3 == 0 else ""
    layout = "pre-paginated" if number % 8 == 0 else "reflowable"
    points = "".join(f'<li><a href="text/c{k}.xhtml">Part {k}</a></li>' for k in range(len(chapters)))
    opf = (
        '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="uid">urn:y:{name}</dc:identifier><dc:title>Book {name}</dc:title><dc:creator> Writer {name} </dc:creator><dc:language>{language}</dc:language>'
        f'<meta property="rendition:layout">{layout}</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
        f'<item id="pic" href="img/p.png" media-type="image/png" properties="cover-image"/><item id="raw" href="raw.txt"/>{items}</manifest>'
        f'<spine{direction}>{"".join(f"<itemref idref={chr(34)}c{k}{chr(34)}/>" for k in range(len(chapters)))}</spine></package>'
    )
    nav = f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{points}</ol></nav></body></html>'
    entries = [("mimetype", b"application/epub+zip"), ("META-INF/container.xml", CONTAINER.encode()), ("OPS/book.opf", opf.encode()), ("OPS/nav.xhtml", nav.encode()), ("OPS/img/p.png", b"\x89PNG"), ("OPS/raw.txt", text.encode())]
    return archive([*entries, *((f"OPS/text/c{k}.xhtml", _page(lines).encode()) for k, lines in enumerate(chapters))], ("mimetype",))


def any_book(name: str, language: str, text: str) -> bytes:
    """By the number: an EPUB, a single-file XML book, plain text, or an EPUB without its package."""
    kind = int(name) % 4
    if kind == 3:
        return archive([("mimetype", b"application/epub+zip"), ("META-INF/container.xml", CONTAINER.encode()), ("OPS/raw.txt", text.encode())], ("mimetype", "OPS/raw.txt"))
    return (rich_epub(name, language, text), text_fb2(name, language, text), text.encode())[kind]


def text_fb2(name: str, language: str, text: str) -> bytes:
    """A text as a single-file XML book: five lines a section, each with a title."""
    body = "".join(f"<section><title><p>Part {k}</p></title>{''.join(f'<p>{html.escape(line, quote=False)}</p>' for line in lines)}</section>" for k, lines in enumerate(parts(text)))
    return (
        '<?xml version="1.0" encoding="UTF-8"?><FictionBook xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><author><first-name>Ann</first-name></author>'
        f"<book-title>Text {name}</book-title><lang>{language}</lang></title-info><document-info><id>{name}</id></document-info></description><body>{body}</body></FictionBook>"
    ).encode()


def raw_archive(entries: list[dict], comment: bytes = b"") -> bytes:
    """An archive written field by field, so that records may lie."""
    body, table = b"", b""
    for e in entries:
        packed = zlib.compressobj(9, zlib.DEFLATED, -15)
        data = packed.compress(e["body"]) + packed.flush() if e.get("method", 8) == 8 else e["body"]
        crc, size, name = e.get("crc", zlib.crc32(e["body"])), e.get("size", len(e["body"])), e["name"].encode()
        head = struct.pack("<HHHHHIIIHH", 20, e.get("flags", 0), e.get("method", 8), 0, 0, crc, len(data), size, len(name), 0)
        table += struct.pack("<IH", 0x02014B50, 20) + head + struct.pack("<HHHII", 0, 0, 0, 0, len(body)) + name
        body += struct.pack("<I", 0x04034B50) + head + name + data
    return body + table + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(entries), len(entries), len(table), len(body), len(comment)) + comment
