"""Reading text of markup: one pass over tags, no document tree."""

from __future__ import annotations

import html.entities

import regex

from .unicode import SPACE, SPACE_CHARS

#: Elements whose content is never read.
DISCARDED = frozenset(
    "area base button embed frame frameset iframe input keygen listing meta noembed noframes option optgroup param "
    "plaintext script select source template textarea title track xmp".split()
)
DISCARDED_SVG = frozenset("animate animatemotion animatetransform audio canvas discard foreignobject handler iframe listener script set video".split())
RAW = frozenset("iframe noembed noframes plaintext script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split()
)
FONT_TYPES = frozenset(
    "application/font-woff application/font-woff2 application/vnd.ms-fontobject application/vnd.ms-opentype "
    "application/x-font-opentype application/x-font-otf application/x-font-truetype application/x-font-ttf "
    "application/x-font-woff".split()
)

#: HTML 4.01's names with today's angle brackets, apos, and the upper-case aliases.
ENTITIES = {name: chr(code) for name, code in html.entities.name2codepoint.items()}
ENTITIES |= {"lang": "⟨", "rang": "⟩", "apos": "'", "AMP": "&", "COPY": "\xa9", "GT": ">", "LT": "<", "QUOT": '"', "REG": "\xae", "TRADE": "™"}
_REFERENCE = regex.compile(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));")


def _character(m) -> str:
    if m[3]:
        return ENTITIES.get(m[3], m[0])
    code = int(m[1]) if m[1] else int(m[2], 16)
    if code > 0x10FFFF:
        return m[0]
    return "�" if 0xD800 <= code <= 0xDFFF else chr(code)


def decode_entities(text: str) -> str:
    return _REFERENCE.sub(_character, text) if "&" in text else text


_PIECE = regex.compile(
    r"(?P<text>[^<]+)|<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<tag>[^>]*)>|(?P<rest><.*)\Z",
    regex.DOTALL,
)
_NAME = regex.compile(f"/?([^{SPACE}/>]*)")
_ATTRIBUTE = regex.compile(f"[{SPACE}/]*([^{SPACE}=/]+)[{SPACE}]*(?:=[{SPACE}]*(?:\"([^\"]*)\"?|'([^']*)'?|([^{SPACE}]*)))?")
_SCHEME = regex.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*):")


def attribute(tag: str, wanted: str) -> str | None:
    at = _NAME.match(tag).end()
    for m in _ATTRIBUTE.finditer(tag, at):
        if m[1].lower() == wanted:
            return decode_entities(m[2] or m[3] or m[4] or "")
    return None


def classify(reference: str) -> tuple[str, str, str | None]:
    """(kind, value, scheme): empty, fragment, scheme or relative, after URL white space is dropped."""
    lo, hi = 0, len(reference)
    while lo < hi and reference[lo] <= " ":
        lo += 1
    while hi > lo and reference[hi - 1] <= " ":
        hi -= 1
    value = regex.sub(r"[\t\n\r]", "", reference[lo:hi])
    if not value or value[0] == "#":
        return ("fragment" if value else "empty"), value, None
    m = _SCHEME.match(value)
    return ("scheme", value, m[1].lower()) if m else ("relative", value, None)


def normalize_reference(reference: str) -> str:
    """Fold . and .. segments; a leading .. stays."""
    out: list[str] = []
    for part in reference.split("/"):
        if part in ("", "."):
            continue
        if part == ".." and out and out[-1] != "..":
            out.pop()
        else:
            out.append(part)
    return ("/" if reference.startswith("/") else "") + "/".join(out)


def servable(media_type: str) -> bool:
    base = media_type.split(";")[0].strip(SPACE_CHARS).lower()
    return base.startswith(("image/", "font/")) or base in FONT_TYPES


def image_text(src: str | None, alt: str | None, resources: dict[str, str] | None) -> str:
    """What an image reads as: nothing where it can be shown or is remote, else its alternative text."""
    if src is not None:
        kind, value, _ = classify(src)
        if kind != "relative" or servable((resources or {}).get(normalize_reference(value), "")):
            return ""
    return alt or ""


def _after_raw(markup: str, name: str, at: int) -> int:
    m = regex.compile(f"(?i)</{name}(?=[>{SPACE}]|\\Z)[^>]*(>|\\Z)").search(markup, at)
    return m.end() if m else len(markup)


def _after_balanced(markup: str, name: str, at: int) -> int:
    depth = 1
    for m in regex.compile(f"(?i)<(?:(/?){regex.escape(name)}(?=[>/{SPACE}]|\\Z))?[^>]*(>|\\Z)", regex.DOTALL).finditer(markup, at):
        if m[2] == "":
            return len(markup)
        if m[1] is not None:
            depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        if depth == 0:
            return m.end()
    return len(markup)


def reading_text(markup: str, resources: dict[str, str] | None = None) -> str:
    """Text in reading order. ``resources`` (normalised reference -> media type) tells which images are shown."""
    out: list[str] = []
    open_: list[str] = []
    at, svg = 0, 0

    def say(text: str) -> None:
        if open_ and open_[-1] not in ("html", "body") or text.strip(SPACE_CHARS):
            out.append(text)

    while at < len(markup):
        m = _PIECE.match(markup, at)
        at = m.end()
        if m["text"] is not None or m["rest"] is not None:
            say(decode_entities(m[0]))
        elif m["cdata"] is not None:
            say(m["cdata"])
        tag = m["tag"]
        name = _NAME.match(tag)[1].lower() if tag is not None else ""
        if not name:
            continue
        if tag[0] == "/":
            if name in open_:
                keep = len(open_) - 1 - open_[::-1].index(name)
                svg -= open_[keep:].count("svg")
                del open_[keep:]
            continue
        alone, inside, top = tag.endswith("/"), svg > 0, open_[-1] if open_ else None
        if not inside and (top == "p" and name in ENDS_PARAGRAPH or name == top == "li" or {name, top} <= {"dd", "dt"}):
            open_.pop()
        if inside:
            skip, empty = name in DISCARDED_SVG or name == "style", alone
        else:
            if name == "head" and not alone:
                at = _after_balanced(markup, name, at)
                continue
            if name == "img":
                say(image_text(attribute(tag, "src"), attribute(tag, "alt"), resources))
                continue
            skip, empty = name in DISCARDED or name == "style", alone or name in VOID
        if empty:
            continue
        if skip:
            at = _after_raw(markup, name, at) if name in RAW else _after_balanced(markup, name, at)
            continue
        svg += name == "svg"
        open_.append(name)
    return "".join(out)
