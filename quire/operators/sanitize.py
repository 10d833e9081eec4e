"""Sanitising markup against allowlists, with tallies of what went.

Markup that parses as strict XML is read as such; otherwise a tolerant HTML reading takes over, with the same implied
ends as the reading text. The result is serialised HTML of the body's content (and kept link and style elements)."""

from __future__ import annotations

import html
from collections import Counter

import regex

from ..functions import markup
from ..sources import xmltree
from ..sources.xmltree import Node

#: Elements that stay, with their own attributes; attributes that every element may have.
HTML_GLOBAL = frozenset("class dir epub:type hidden id lang role style title translate xml:lang".split())
_CELL = "abbr align colspan headers rowspan scope valign width"
HTML = {name: frozenset() for name in (
    "abbr address article aside b bdi bdo big br center cite code dd details dfn div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 "
    "header hgroup hr i kbd main mark nav p pre rp rt ruby s samp section small span strike strong sub summary sup tt u ul var wbr".split()
)} | {name: frozenset(own.split()) for name, own in {
    "a": "href", "blockquote": "cite", "caption": "align", "col": "align span valign width", "colgroup": "align span valign width",
    "del": "cite datetime", "details": "open", "img": "alt height src width", "ins": "cite datetime", "li": "value", "link": "href media rel type",
    "ol": "reversed start type", "q": "cite", "style": "media type", "table": "align border cellpadding cellspacing summary width",
    "tbody": "align valign", "td": _CELL, "tfoot": "align valign", "th": _CELL, "thead": "align valign", "time": "datetime", "tr": "align valign",
}.items()}
SVG_GLOBAL = frozenset(
    "class clip-path clip-rule color display dominant-baseline fill fill-opacity fill-rule font-family font-size font-style font-weight id lang "
    "letter-spacing mask opacity overflow paint-order role shape-rendering space stop-color stop-opacity stroke stroke-dasharray "
    "stroke-dashoffset stroke-linecap stroke-linejoin stroke-opacity stroke-width style text-anchor transform vector-effect visibility "
    "word-spacing".split()
)
_GRADIENT, _TEXT = "cx cy fr fx fy gradientTransform gradientUnits r spreadMethod x1 x2 y1 y2", "dx dy rotate textLength x y"
SVG = {name: frozenset(own.split()) for name, own in {
    "a": "href", "circle": "cx cy r", "clipPath": "clipPathUnits", "defs": "", "desc": "", "ellipse": "cx cy rx ry", "g": "",
    "image": "height href preserveAspectRatio width x y", "line": "x1 x2 y1 y2", "linearGradient": _GRADIENT,
    "marker": "markerHeight markerUnits markerWidth orient refX refY viewBox", "mask": "height maskContentUnits maskUnits width x y",
    "path": "d pathLength", "pattern": "height patternContentUnits patternTransform patternUnits viewBox width x y", "polygon": "points",
    "polyline": "points", "radialGradient": _GRADIENT, "rect": "height rx ry width x y", "stop": "offset", "style": "media type",
    "svg": "height preserveAspectRatio version viewBox width x y", "symbol": "preserveAspectRatio viewBox", "text": _TEXT, "title": "",
    "tspan": _TEXT, "use": "height href width x y",
}.items()}
URLS = {"a": "href", "blockquote": "cite", "del": "cite", "image": "href", "img": "src", "ins": "cite", "link": "href", "q": "cite", "use": "href"}
_XHTML, _SVG = "http://www.w3.org/1999/xhtml", "http://www.w3.org/2000/svg"
_FIELD = regex.compile(r"""[\s/]*([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TAG = regex.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<open>[a-zA-Z][^\s/>]*)(?P<fields>(?:"[^"]*"|'[^']*'|[^"'>])*)(?:>|\Z)|(?P<text>[^<]+|<)""", regex.DOTALL)


def allowed_reference(element: str, attribute: str, kind: str, scheme: str | None) -> bool:
    if element == "use" or kind == "fragment":
        return kind == "fragment" and element in ("use", "a")
    if kind == "relative":
        return True
    media = attribute == "src" or element == "link" or (element, attribute) == ("image", "href")
    return kind == "scheme" and scheme in (("data", "http", "https") if media else ("http", "https", "mailto", "tel"))


def read_html(text: str) -> Node:
    """A tolerant tree: void and raw-text elements, implied ends of p, li, dt and dd."""
    root = Node("html")
    open_, at = [root], 0
    while at < len(text):
        m = _TAG.match(text, at)
        if m is None:
            break
        at = m.end()
        top = open_[-1]
        if m["text"] is not None or m["cdata"] is not None:
            top.content.append(m["cdata"] if m["cdata"] is not None else html.unescape(m["text"]))
        elif m["close"]:
            name = m["close"].lower()
            places = [i for i, n in enumerate(open_) if i and n.name.lower() == name]
            if places:
                del open_[places[-1] :]
        elif m["open"]:
            svg = any(n.name == "svg" for n in open_)
            name = m["open"] if svg else m["open"].lower()
            if not svg and (top.name == "p" and name in markup.ENDS_PARAGRAPH or name == top.name == "li" or {name, top.name} <= {"dd", "dt"}):
                open_.pop()
            node = Node(name)
            fields = m["fields"].rstrip()
            for f in _FIELD.finditer(fields):
                node.attributes.setdefault(f[1] if svg else f[1].lower(), html.unescape(f[2] or f[3] or f[4] or ""))
            open_[-1].content.append(node)
            if name in markup.RAW and not svg:
                end = regex.compile(f"(?i)</{name}(?=[\\s/>]|\\Z)[^>]*(>|\\Z)").search(text, at)
                body = text[at : end.start() if end else len(text)]
                node.content.append(html.unescape(body) if name in ("title", "textarea") else body)
                at = end.end() if end else len(text)
            elif name not in markup.VOID and not (svg or name == "svg") or (svg or name == "svg") and not fields.endswith("/"):
                open_.append(node)
    return root


class _Scrub:
    def __init__(self):
        self.removed, self.unwrapped, self.attributes = Counter(), Counter(), Counter()

    def content(self, nodes, svg: bool, foreign: str | None) -> list:
        return [x for n in nodes for x in ([n] if isinstance(n, str) else self.node(n, svg, foreign))]

    def node(self, n: Node, svg: bool, space: str | None) -> list:
        """What stays of an element: itself, its content, or nothing. ``space`` is the namespace in force."""
        space = n.attributes.get("xmlns", _SVG if n.local == "svg" and space in (None, _XHTML) else space)
        svg = space == _SVG
        name = n.local if svg else n.local.lower()
        if not svg and space not in (None, "", _XHTML):
            self.unwrapped[name] += 1
            return self.content(n.content, False, space)
        gone = name.lower() in (markup.DISCARDED_SVG if svg else markup.DISCARDED)
        gone |= name == "link" and not regex.search(r"(?i)(^|\s)stylesheet(\s|$)", n.attributes.get("rel", ""))
        gone |= name == "style" and regex.search("(?i)</style", n.deep_text()) is not None
        if gone:
            self.removed[name] += 1
            return []
        inner = self.content(n.content, svg, space)
        own = (SVG if svg else HTML).get(name)
        if own is None:
            self.unwrapped[name] += 1
            return inner
        out = Node(name)
        out.content = inner
        for raw, value in n.attributes.items():
            if raw == "xmlns" or raw.startswith("xmlns:"):
                continue
            key = (raw.partition(":")[2] or raw) if svg else raw.lower()
            if key.lower().startswith("on") or not (key in own or key in (SVG_GLOBAL if svg else HTML_GLOBAL) or key.startswith("aria-")):
                self.attributes[raw.lower()] += 1
                continue
            if URLS.get(name) == key:
                kind, _, scheme = markup.classify(value)
                if not allowed_reference(name, key, kind, scheme):
                    self.attributes[f"{key} ({scheme or kind})"] += 1
                    continue
            out.attributes[raw if svg else key] = value
        if svg and name == "use" and not {"href", "xlink:href"} & set(out.attributes):
            self.removed["use"] += 1
            return []
        return [out]


def serialize(nodes) -> str:
    out = []
    for n in nodes:
        if isinstance(n, str):
            out.append(html.escape(n, quote=False))
            continue
        fields = "".join(f' {k}="{html.escape(v)}"' for k, v in n.attributes.items())
        inner = "".join(c for c in n.content if isinstance(c, str)) if n.name == "style" else serialize(n.content)
        out.append(f"<{n.name}{fields}>" + ("" if n.name in markup.VOID else f"{inner}</{n.name}>"))
    return "".join(out)


def _tally(counts: Counter) -> list[dict]:
    return [{"name": k, "count": v} for k, v in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]


def sanitize(source: str, media_type: str = "application/xhtml+xml") -> dict:
    """html, and how it was read and what was removed, unwrapped or stripped (most frequent first, then by name)."""
    asked = media_type if media_type in ("text/html", "image/svg+xml") else "application/xhtml+xml"
    parsed_as, root = asked, None
    if asked != "text/html":
        try:
            root = xmltree.parse(source)
        except xmltree.XmlError:
            root = None
    if root is None:
        parsed_as, root = "text/html", read_html(source)
    find = lambda name: root if root.local == name else next((n for n in root.walk() if n.local.lower() == name), None)
    head, body, scrub = find("head"), find("body"), _Scrub()
    space = root.attributes.get("xmlns")
    kept_head = [] if head is None else [n for n in scrub.content(head.children, False, space) if isinstance(n, Node) and n.name in ("link", "style")]
    if body is not None:
        content = scrub.content(body.content, False, space)
    elif root.local == "svg":
        content = scrub.node(root, True, _SVG)
    else:
        content = scrub.content([c for c in root.content if c is not head], False, space)
    return {
        "html": serialize([*kept_head, *content]), "parsed_as": parsed_as, "parse_fallback": parsed_as != asked,
        "elements_removed": _tally(scrub.removed), "elements_unwrapped": _tally(scrub.unwrapped), "attributes_removed": _tally(scrub.attributes),
    }
