"""Decoders: bytes of one book to rows of books, sections, table of contents and resources.

``decode(data)`` claims the format (EPUB, FB2, text, in the caller's order) and returns a dict of those rows; faults
become ``error`` (class and message) instead of failing the job."""

from __future__ import annotations

import base64
import binascii
import hashlib
import posixpath
import re
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import HEADING_WORDS
from ..functions.unicode import SPACE, SPACE_CHARS, collapse
from . import xmltree
from .archive import Archive, ArchiveError
from .xmltree import Node


class BookError(Exception):
    kind = "CorruptContainer"


class EncryptedError(BookError):
    kind = "EncryptedContent"


class UnknownFormatError(BookError):
    kind = "UnrecognizedFormat"


# --- references -------------------------------------------------------------------------------------------------


_BAD_ESCAPE = regex.compile(r"%(?![0-9a-fA-F]{2})")
_SCHEME = regex.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")


def _unescape(part: str) -> str:
    if "%" not in part or _BAD_ESCAPE.search(part):
        return part
    try:
        return unquote_to_bytes(part).decode()
    except UnicodeDecodeError:
        return part


def resolve_href(base: str, href: str) -> tuple[str, str | None] | None:
    """(path, fragment) of a reference from a directory; None for schemes, empty references and the root."""
    path, mark, fragment = href.partition("#")
    if not path or _SCHEME.match(path):
        return None
    parts: list[str] = []
    for part in map(_unescape, (path[1:] if path[0] == "/" else base + path).split("/")):
        if part == "..":
            del parts[-1:]
        elif part not in ("", "."):
            parts.append(part)
    return ("/".join(parts), _unescape(fragment) if mark else None) if parts else None


def directory_of(path: str) -> str:
    return path[: path.rfind("/") + 1]


def stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


# --- EPUB -------------------------------------------------------------------------------------------------------

#: Fixed values of the container format.
_MIMETYPE, _PACKAGE_TYPE, _NCX_TYPE = "application/epub+zip", "application/oebps-package+xml", "application/x-dtbncx+xml"
_RENDERABLE = {"application/xhtml+xml", "image/svg+xml", "text/html"}
_OBFUSCATION, _OBFUSCATED_BYTES = "http://www.idpf.org/2008/embedding", 1040


def claims_epub(data: bytes) -> bool:
    try:
        return data[:4] == b"PK\3\4" and Archive(data).read("mimetype").decode("utf-8", "replace").rstrip(SPACE_CHARS) == _MIMETYPE
    except ArchiveError:
        return False


def _entry(archive: Archive, name: str) -> bytes:
    try:
        return archive.read(name)
    except ArchiveError as e:
        raise (EncryptedError if e.kind == "encrypted" else BookError)(f"{name}: {e}") from e


def _xml(archive: Archive, name: str) -> Node:
    try:
        return xmltree.parse(xmltree.decode(_entry(archive, name)))
    except xmltree.XmlError as e:
        raise BookError(f"{name}: {e}") from e


def deobfuscate(data: bytes, identifier: str) -> bytes:
    key = hashlib.sha1(regex.sub(r"[ \t\r\n]", "", identifier).encode()).digest()
    head = bytes(b ^ key[i % len(key)] for i, b in enumerate(data[:_OBFUSCATED_BYTES]))
    return head + data[_OBFUSCATED_BYTES:]


def _package(root: Node) -> dict:
    if root.local != "package" or root.first("manifest") is None or root.first("spine") is None:
        raise BookError("not a package document")
    items = []
    for n in root.first("manifest").all("item"):
        if n.get("id") is not None and n.get("href") is not None:
            items.append({"id": n.get("id"), "href": n.get("href"), "type": "application/octet-stream" if n.get("media-type") is None else n.get("media-type"), "properties": (n.get("properties") or "").split(), "fallback": n.get("fallback") or None})
    spine = root.first("spine")
    meta = root.first("metadata") or Node("metadata")
    texts = lambda local: [n.text.strip(SPACE_CHARS) for n in meta.within(local) if n.text.strip(SPACE_CHARS)]
    by_id = {i["id"]: i for i in items}
    named = [n for n in meta.within("identifier") if root.get("unique-identifier") is not None and n.get("id") == root.get("unique-identifier")]
    chosen = (named or [n for n in meta.within("identifier") if n.text.strip(SPACE_CHARS)])[:1]
    identifier = chosen[0].text if chosen and chosen[0].text.strip(SPACE_CHARS) else None
    layouts = [n.text.strip(SPACE_CHARS) for n in meta.within("meta") if n.get("property") == "rendition:layout"]
    layout = next((x for x in layouts if x in ("pre-paginated", "reflowable")), None)
    cover = next((i for i in items if "cover-image" in i["properties"]), None)
    for n in meta.within("meta") if cover is None else []:
        wanted = n.get("content") if n.get("name") == "cover" else None
        cover = cover or (by_id.get(wanted) or next((i for i in items if i["href"] == wanted), None) if wanted else None)
    progression = spine.get("page-progression-direction")
    return {
        "items": items, "by_id": by_id, "cover": cover, "identifier": identifier, "ncx": spine.get("toc") or None,
        "spine": [(n.get("idref"), n.get("linear") != "no") for n in spine.all("itemref") if n.get("idref") is not None],
        "title": next(iter(texts("title")), None), "author": next(iter(texts("creator")), None), "language": next(iter(texts("language")), None),
        "direction": progression if progression in ("ltr", "rtl") else None, "fixed": None if layout is None else layout == "pre-paginated",
    }


def _renderable(item: dict, by_id: dict) -> dict:
    """The item, or the first of its fallbacks that can be shown; a circle is a fault, a dead end keeps the item."""
    seen, here = set(), item
    while here is not None:
        if here["type"] in _RENDERABLE:
            return here
        if here["id"] in seen:
            raise BookError(f"fallbacks of {item['id']} go in a circle")
        seen.add(here["id"])
        here = by_id.get(here["fallback"])
    return item


class _Toc:
    """Preorder rows (node, parent, depth, label, section, fragment). An entry without a target borrows its first
    child's section; without children it is dropped."""

    def __init__(self, sections: dict[str, str]):
        self.sections, self.rows = sections, []

    def entry(self, label: str, target, children: list):
        section = self.sections.get(target[0]) if target else None
        if section is None and not children:
            return None
        return {"label": label, "section_id": section or children[0]["section_id"], "fragment": target[1] if section else None, "children": children}

    def flatten(self, tree: list, parent=None, depth=0):
        for e in tree:
            me = len(self.rows)
            self.rows.append({"node_id": me, "parent_id": parent, "depth": depth, "label": e["label"], "section_id": e["section_id"], "fragment": e["fragment"]})
            self.flatten(e["children"], me, depth + 1)
        return self.rows


def _target(href: str | None, document: str):
    if not href:
        return None
    return (document, href[1:]) if href[0] == "#" else resolve_href(directory_of(document), href)


def _nav_toc(root: Node, path: str, toc: _Toc) -> list:
    navs = root.within("nav")
    nav = next((n for n in navs if "toc" in (n.get("type") or "").split()), None) or next((n for n in navs if n.within("ol")), None)
    start = None if nav is None else nav.first("ol") or next(iter(nav.within("ol")), None)

    def level(ol):
        out = []
        for li in ol.all("li") if ol is not None else []:
            a = li.first("a")
            source = a if a is not None else li.first("span")
            label = collapse(li.text if source is None else source.deep_text())
            out.append(toc.entry(label, _target(a.get("href"), path) if a is not None else None, level(li.first("ol"))))
        return [e for e in out if e]

    return level(start)


def _ncx_toc(root: Node, path: str, toc: _Toc) -> list:
    def level(points):
        out = []
        for p in points:
            text = p.first("navLabel").first("text") if p.first("navLabel") is not None else None
            content = p.first("content")
            out.append(toc.entry(collapse(text.deep_text() if text is not None else ""), _target(content.get("src"), path) if content is not None else None, level(p.all("navPoint"))))
        return [e for e in out if e]

    maps = root.within("navMap")
    return level(maps[0].all("navPoint")) if maps else []


def decode_epub(data: bytes) -> dict:
    try:
        archive = Archive(data)
    except ArchiveError as e:
        raise BookError(str(e)) from e
    files = _xml(archive, "META-INF/container.xml").within("rootfile")
    chosen = next((f for f in files if f.get("media-type") == _PACKAGE_TYPE), files[0] if files else None)
    opf = chosen.get("full-path") if chosen is not None else None
    if not opf:
        raise BookError("the container names no package")
    package, base = _package(_xml(archive, opf)), directory_of(opf)
    path_of = lambda item: (resolve_href(base, item["href"]) or (None, None))[0]
    hidden, locked = set(), set()
    if "META-INF/encryption.xml" in archive.by_name:
        try:
            for n in _xml(archive, "META-INF/encryption.xml").within("EncryptedData"):
                uri = next((r.get("URI") for r in n.within("CipherReference") if r.get("URI")), None)
                where = resolve_href("", uri) if uri else None
                method = next(iter(n.within("EncryptionMethod")), None)
                if where:
                    ours = method is not None and (method.get("Algorithm") or "").strip(SPACE_CHARS) == _OBFUSCATION
                    (hidden if ours else locked).add(where[0])
        except BookError:
            hidden, locked = set(), set()

    def load(path):
        """(bytes, error) under the encryption's rules."""
        if path in locked or path in hidden and package["identifier"] is None:
            return None, "EncryptedContent"
        try:
            raw = _entry(archive, path)
        except BookError as e:
            return None, e.kind
        return (deobfuscate(raw, package["identifier"]) if path in hidden else raw), None

    sections, by_path, seen = [], {}, set()
    for idref, linear in package["spine"]:
        item = package["by_id"].get(idref)
        if item is None or idref in seen:
            continue
        seen.add(idref)
        shown = _renderable(item, package["by_id"])
        for path in (path_of(item), path_of(shown)):
            if path is not None:
                by_path.setdefault(path, idref)
        content, fault = load(path_of(shown))
        sections.append({"section_id": idref, "media_type": shown["type"], "path": path_of(shown), "linear": linear, "scripted": "scripted" in shown["properties"], "content": content, "error": fault})
    if not sections:
        raise BookError("the spine names no section")
    resources = []
    for item in package["items"]:
        path = path_of(item)
        if item["id"] not in seen and path is not None and path in archive.by_name:
            content, fault = load(path)
            resources.append({"resource_id": path, "media_type": item["type"], "content": content, "error": fault})
    tree: list = []
    toc = _Toc(by_path)
    nav = next((i for i in package["items"] if "nav" in i["properties"]), None)
    ncx = package["by_id"].get(package["ncx"]) or next((i for i in package["items"] if i["type"] == _NCX_TYPE), None)
    for item, reader in ((nav, _nav_toc), (ncx, _ncx_toc)):
        if item is not None and not tree and path_of(item) is not None:
            try:
                tree = reader(_xml(archive, path_of(item)), path_of(item), toc)
            except BookError:
                tree = []
    cover = package["cover"]
    return {
        "format": "epub", "title": package["title"], "author": package["author"], "language": package["language"],
        "identifier": package["identifier"].strip(SPACE_CHARS) if package["identifier"] else None, "cover": path_of(cover) if cover else None,
        "direction": package["direction"], "fixed_layout": package["fixed"], "sections": sections, "toc": toc.flatten(tree), "resources": resources,
    }


# --- FB2 --------------------------------------------------------------------------------------------------------

#: How elements render (tag, class); attributes that table parts keep.
_RENDER = {
    "p": ("p", ""), "epigraph": ("div", "fb2-epigraph"), "cite": ("blockquote", ""), "poem": ("div", "fb2-poem"), "stanza": ("div", "fb2-stanza"),
    "v": ("p", "fb2-verse"), "text-author": ("p", "fb2-text-author"), "annotation": ("div", "fb2-annotation"), "section": ("div", "fb2-section"),
    "emphasis": ("em", ""), "strong": ("strong", ""), "strikethrough": ("s", ""), "sub": ("sub", ""), "sup": ("sup", ""), "code": ("code", ""),
    "table": ("table", ""), "tr": ("tr", ""), "th": ("th", ""), "td": ("td", ""),
}
_TABLE = {"table": ("align",), "tr": ("align", "valign"), "th": ("align", "colspan", "rowspan", "valign"), "td": ("align", "colspan", "rowspan", "valign")}


def claims_fb2(data: bytes) -> bool:
    head = data[:1024]
    name = "utf-16-le" if head[:2] == b"\xff\xfe" else "utf-16-be" if head[:2] == b"\xfe\xff" else "latin-1"
    return regex.search(r"<\s*FictionBook[\s>]", head.decode(name, "replace")) is not None


def escape(text: str, quotes: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;") if quotes else text


def _markup(body: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><meta charset="UTF-8"/></head><body>{body}</body></html>'


class _Fb2:
    def __init__(self, sections: dict[str, str]):
        self.sections = sections

    def nodes(self, content, level: int) -> str:
        return "".join(escape(n) if isinstance(n, str) else self.element(n, level) for n in content)

    def element(self, n: Node, level: int) -> str:
        own = lambda name, value: "" if value is None else f' {name}="{escape(value, True)}"'
        ident, kind = own("id", n.get("id")), n.local
        if kind == "title":
            lines = [self.nodes(p.content, 0) for p in n.all("p")]
            return f"<h{min(level, 6)}{ident}>{'<br/>'.join(lines) if lines else self.nodes(n.content, 0)}</h{min(level, 6)}>"
        if kind == "subtitle":
            return f"<h{min(level + 1, 6)}{ident}>{self.nodes(n.content, level)}</h{min(level + 1, 6)}>"
        if kind == "empty-line":
            return f'<p class="fb2-empty-line"{ident}></p>'
        if kind == "a":
            href = n.get("href")
            if href and href[0] == "#" and href[1:] in self.sections:
                href = self.sections[href[1:]] + href
            return f"<a{own('href', href)}{ident}>{self.nodes(n.content, level)}</a>"
        if kind == "image":
            return f"<img{own('src', (n.get('href') or '').removeprefix('#'))}{own('alt', n.get('alt') or '')}{ident}/>"
        inner = self.nodes(n.content, min(level + 1, 6) if kind == "section" else level)
        if kind not in _RENDER:
            return inner
        tag, style = _RENDER[kind]
        extra = "".join(own(a, n.get(a)) for a in _TABLE.get(kind, ()))
        return f"<{tag}{own('class', style or None)}{ident}{extra}>{inner}</{tag}>"


def decode_fb2(data: bytes) -> dict:
    try:
        root = xmltree.parse(xmltree.decode(data), tolerant=True)
    except xmltree.XmlError as e:
        raise BookError(str(e)) from e
    if root.local != "FictionBook":
        raise BookError("the root element is not FictionBook")
    binaries = {}
    for n in root.all("binary"):
        raw = regex.sub(r"\s+", "", n.text)
        try:
            if n.get("id") is not None:
                binaries[n.get("id")] = (n.get("content-type") or "application/octet-stream", base64.b64decode(raw + "=" * (-len(raw) % 4) if "=" not in raw else raw, validate=True))
        except (binascii.Error, ValueError):
            continue
    bodies = root.all("body")
    main = next((b for b in bodies if b.get("name") is None), bodies[0] if bodies else None)
    tops = main.all("section") if main is not None else []
    before = [c for c in main.content if isinstance(c, str) or c.local != "section"] if main is not None else []
    before = before if any(isinstance(c, Node) for c in before) else []
    plans = [(f"s{i}", s, 2, before if i == 0 else []) for i, s in enumerate(tops)]
    if not tops and main is not None:
        plans.append(("s0", main, 2, []))
    plans += [(f"nb{i}", b, 3, []) for i, b in enumerate(b for b in bodies if b is not main)]
    places: dict[str, str] = {}
    for ident, source, _, prefix in plans:
        for top in [source, *[n for n in prefix if isinstance(n, Node)]]:
            for n in [top, *top.walk()]:
                if n.get("id") is not None:
                    places.setdefault(n.get("id"), ident)
    draw = _Fb2(places)
    sections = [
        {"section_id": ident, "media_type": "application/xhtml+xml", "path": None, "linear": True, "scripted": False, "error": None,
         "content": _markup(draw.nodes(prefix, 1) + draw.nodes(source.content, level)).encode()}
        for ident, source, level, prefix in plans
    ]
    text = lambda n: (collapse(n.deep_text()) or None) if n is not None else None
    label = lambda n: text(n.first("title"))

    def nested(section, ident):
        out = []
        for n in section.all("section"):
            below = nested(n, ident)
            out += [{"label": label(n), "section_id": ident, "fragment": n.get("id"), "children": below}] if label(n) else below
        return out

    tree = [{"label": label(s) or f"Section {i + 1}", "section_id": f"s{i}", "fragment": None, "children": nested(s, f"s{i}")} for i, s in enumerate(tops)]
    about = root.first("description") or Node("description")
    info, document = about.first("title-info") or Node("title-info"), about.first("document-info") or Node("document-info")
    who = info.first("author") or Node("author")
    names = [text(who.first(k)) for k in ("first-name", "middle-name", "last-name")]
    picture = (info.first("coverpage") or Node("coverpage")).first("image")
    cover = (picture.get("href") or "").removeprefix("#") if picture is not None else None
    return {
        "format": "fb2", "title": text(info.first("book-title")), "author": " ".join(filter(None, names)) or text(who.first("nickname")),
        "language": text(info.first("lang")), "identifier": text(document.first("id")), "cover": cover if cover in binaries else None, "direction": None,
        "fixed_layout": None, "sections": sections, "toc": _Toc({}).flatten(tree),
        "resources": [{"resource_id": k, "media_type": m, "content": b, "error": None} for k, (m, b) in binaries.items()],
    }


# --- plain text -------------------------------------------------------------------------------------------------


def claims_text(data: bytes) -> bool:
    head = data[:512]
    if not head:
        return False
    if head.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        return True
    return not (head.startswith((b"PK\3\4", b"%PDF")) or head.lstrip(b" \t\n\r\xef\xbb\xbf")[:1] == b"<" or b"\0" in head)


def decode_text(data: bytes) -> str:
    """By byte-order mark, else strict UTF-8, else windows-1252 (its five holes are C1 controls)."""
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    try:
        return data.decode()
    except UnicodeDecodeError:
        return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in data)


def _is_heading(block: str) -> bool:
    size = len(block.encode("utf-16-le")) // 2
    if "\n" in block or not 0 < size <= 60:
        return False
    capitals = size <= 48 and re.search("[A-Z]", block) and not re.search("[a-z]", block)
    return bool(capitals or re.match(rf"(?i)(?:{HEADING_WORDS})\b", block, re.ASCII))


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _section_markup(heading: str | None, paragraphs: list[str]) -> str:
    title = "" if heading is None else f"<h2>{_escaped(heading)}</h2>"
    lines = (re.sub("[ \t]+", " ", re.sub(f"[{SPACE}]*\n[{SPACE}]*", " ", p)).strip(SPACE_CHARS) for p in paragraphs)
    body = "".join(f"<p>{_escaped(p)}</p>" for p in lines)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><meta charset="UTF-8"/></head><body>{title}{body}</body></html>'


def decode_text_book(data: bytes) -> dict:
    """A plain text as a book: blocks parted by blank lines, a heading starts a section, headings are the contents."""
    text = re.sub("\r\n?", "\n", decode_text(data))
    runs: list[tuple[str | None, list[str]]] = [(None, [])]
    for block in re.split(r"\n[ \t]*\n+", text):
        block = block.strip(SPACE_CHARS)
        if block and _is_heading(block):
            runs.append((collapse(block), []))
        elif block:
            runs[-1][1].append(block)
    runs = [r for r in runs if r[0] is not None or r[1]] or runs
    head = text[:4000]
    named = {k: re.search(rf"(?im)^{k}:\s*(.+)$", head) for k in ("Title", "Author")}
    banner = re.search(r"(?i)Project Gutenberg eBook of\s+(.+?)(?:,\s*by\s+(.+?))?[\r\n]", head)
    title, author = (m and collapse(m[1]) for m in named.values())
    if title is None and banner:
        title, author = collapse(banner[1]), author or (banner[2] and collapse(banner[2]))
    sections = [
        {"section_id": f"s{k}", "media_type": "application/xhtml+xml", "path": None, "linear": True, "scripted": False, "content": _section_markup(*run).encode(), "error": None}
        for k, run in enumerate(runs)
    ]
    toc = [{"node_id": n, "parent_id": None, "depth": 0, "label": runs[k][0], "section_id": f"s{k}", "fragment": None} for n, k in enumerate(k for k, r in enumerate(runs) if r[0] is not None)]
    return {
        "format": "text", "title": title, "author": author, "language": None, "identifier": None, "cover": None, "direction": None, "fixed_layout": None,
        "sections": sections, "toc": toc, "resources": [],
    }


# --- Spark ------------------------------------------------------------------------------------------------------

_SECTION = "struct<section_id:string,media_type:string,path:string,linear:boolean,scripted:boolean,content:binary,error:string>"
_TOC = "struct<node_id:int,parent_id:int,depth:int,label:string,section_id:string,fragment:string>"
_RESOURCE = "struct<resource_id:string,media_type:string,content:binary,error:string>"
FORMATS = {"epub": (claims_epub, decode_epub), "fb2": (claims_fb2, decode_fb2), "text": (claims_text, decode_text_book)}


def register_format(name: str, claim, reader) -> None:
    """Makes a further format known: ``claim(data)`` tells whether bytes are of it, ``reader(data)`` gives a book's fields
    (BOOK_DDL; those left out are null) or raises a ``BookError``."""
    FORMATS[name] = (claim, reader)


def chosen_formats(formats) -> list[tuple]:
    """(name, claim, reader) of the formats named; unknown names are an error here and not in a task."""
    return [(name, *FORMATS[name]) for name in formats]


def decode(data: bytes, formats=("epub", "fb2")) -> dict:
    """The first format that claims the bytes decodes them; faults are the row's ``error``."""
    empty = {"sections": [], "toc": [], "resources": []}
    for name, claim, reader in formats if formats and not isinstance(formats[0], str) else chosen_formats(formats):
        try:
            if claim(data):
                return {**empty, "format": name, **reader(data), "error": None}
        except BookError as e:
            return {**empty, "format": name, "error": {"kind": e.kind, "message": str(e)}}
        except Exception as e:  # noqa: BLE001  any other failure of a decoder is a corrupt container
            return {**empty, "format": name, "error": {"kind": "CorruptContainer", "message": f"{name} failed: {type(e).__name__}"}}
    return {**empty, "error": {"kind": "UnrecognizedFormat", "message": "no format claims the input"}}


BOOK_DDL = (
    "format string, title string, author string, language string, identifier string, cover string, direction string, fixed_layout boolean, "
    f"sections array<{_SECTION}>, toc array<{_TOC}>, resources array<{_RESOURCE}>, error struct<kind:string,message:string>"
)


def read_books(files: DataFrame, content: str = "content", formats=("epub", "fb2")) -> DataFrame:
    """Decoded books of files (as ``spark.read.format("binaryFile")`` gives them); other columns pass through.

    One narrow stage, a book at a time in an Arrow batch of its own, so memory follows the largest book."""
    spark = files.sparkSession
    book = spark.createDataFrame([], BOOK_DDL).schema
    keep = [c for c in files.columns if c != content]
    schema = T.StructType([*[files.schema[c] for c in keep], *book.fields])
    kind = to_arrow_schema(book)
    formats = chosen_formats(formats)  # goes with the function: workers need not have registered it

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = decode(batch.column(len(keep))[i].as_py() or b"", formats)
                new = pa.RecordBatch.from_pylist([{f.name: row.get(f.name) for f in kind}], schema=kind)
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in batch.columns[: len(keep)]], *new.columns], names=[f.name for f in schema])

    return files.select(*keep, content).mapInArrow(run, schema)


def sections_of(books: DataFrame, key: str) -> DataFrame:
    return books.select(key, F.posexplode("sections").alias("section_index", "s")).select(key, "section_index", "s.*")


def toc_of(books: DataFrame, key: str) -> DataFrame:
    return books.select(key, F.explode("toc").alias("t")).select(key, "t.*")


def resources_of(books: DataFrame, key: str) -> DataFrame:
    return books.select(key, F.explode("resources").alias("r")).select(key, "r.*")


def list_archives(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, ord, name, method, encrypted, crc32, sizes, offset, first, error): the entries of archives."""
    from ..functions.columns import kernel
    from .archive import entries

    fields = "array<struct<ord:int,name:string,method:int,encrypted:boolean,crc32:bigint,compressed_size:bigint,uncompressed_size:bigint,offset:bigint,first:boolean>>"

    def listing(data):
        try:
            seen, out = set(), []
            for e in entries(data):
                out.append({**e, "first": e["name"] not in seen})
                seen.add(e["name"])
            return {"entries": out, "error": None}
        except ArchiveError as e:
            return {"entries": [], "error": e.kind}

    kind = files.sparkSession.createDataFrame([], f"x struct<entries:{fields},error:string>").schema["x"].dataType
    found = files.select(key, kernel(listing, kind)(F.col(content)).alias("a"))
    return found.select(key, F.explode_outer("a.entries").alias("e"), F.col("a.error").alias("error")).select(key, "e.*", "error")


def archive_entries(files: DataFrame, keys: list[str], names: str, content: str = "content") -> DataFrame:
    """(keys, ord, name, body, error): the entries of archives whose name fits the pattern ``names``, read; of equal
    names the first. An archive that cannot be listed is one row with an error."""
    wanted = re.compile(names)
    schema = T.StructType([*[files.schema[k] for k in keys], *files.sparkSession.createDataFrame([], "ord int, name string, body binary, error string").schema])

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for i, data in enumerate(batch.column(len(keys))):
                try:
                    archive = Archive(data.as_py() or b"")
                except ArchiveError as e:
                    rows.append((i, None, None, None, e.kind))
                    continue
                for name, entry in archive.by_name.items():
                    if not wanted.search(name):
                        continue
                    try:
                        rows.append((i, entry["ord"], name, archive.read(name), None))
                        held += entry["uncompressed_size"]
                    except ArchiveError as e:
                        rows.append((i, entry["ord"], name, None, e.kind))
                    if held > 4 << 20:
                        yield emitted(batch, rows)
                        rows, held = [], 0
            yield emitted(batch, rows)

    def emitted(batch, rows):
        at = pa.array([r[0] for r in rows], pa.int64())
        kinds = [pa.int32(), pa.string(), pa.binary(), pa.string()]
        new = [pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[: len(keys)]], *new], names=schema.names)

    return files.select(*keys, content).mapInArrow(run, schema)
