"""References in style sheets: found with their place, rewritten, followed through imports."""

from __future__ import annotations

import regex

_BLANK = r"(?:[ \t\n\r\f]|/\*.*?(?:\*/|\Z))*"
_STRING = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
_URL = rf"(?i:url)\({_BLANK}(?:(?P<%s>{_STRING}){_BLANK}|(?P<%s>(?:[^)\\\"']|\\.)(?:[^)\\]|\\.)*|))\)"
_TOKEN = regex.compile(
    rf"/\*.*?(?:\*/|\Z)"
    rf"|(?i:@import)(?![A-Za-z0-9_\-\\\u0080-￿]){_BLANK}(?P<import>(?P<istring>{_STRING})|{_URL % ('iquoted', 'ibare')})"
    rf"|(?P<string>{_STRING})"
    rf"|(?<![A-Za-z0-9_\-\\\u0080-￿])(?P<url>{_URL % ('quoted', 'bare')})",
    regex.DOTALL,
)


def _unquote(text: str) -> str:
    return regex.sub(r"\\(.)", lambda m: "" if m[1] == "\n" else m[1], text[1:-1], flags=regex.DOTALL)


def _bare(text: str) -> str:
    return regex.sub(r"\\(.)", r"\1", text, flags=regex.DOTALL).strip()


def references(css: str) -> list[dict]:
    """kind (import or url), value, start and end of every reference; strings and comments hold none."""
    out = []
    for m in _TOKEN.finditer(css):
        for kind, quoted, bare in (("import", m["istring"] or m["iquoted"], m["ibare"]), ("url", m["quoted"], m["bare"])):
            if m[kind] is not None:
                value = _unquote(quoted) if quoted is not None else _bare(bare or "")
                out.append({"kind": kind, "value": value, "start": m.start(kind), "end": m.end(kind)})
    return out


def rewrite(css: str, replace) -> str:
    """Each reference as ``url("...")`` of what ``replace(kind, value)`` gives; None keeps the text."""
    out, at = [], 0
    for r in references(css):
        new = replace(r["kind"], r["value"])
        if new is not None:
            clean = regex.sub(r'([\\"])', r"\\\1", new)
            out.append(css[at : r["start"]] + 'url("' + regex.sub(r"[\n\r]", "", clean) + '")')
            at = r["end"]
    return "".join(out) + css[at:]


def inline(css: str, sheet: str, load, seen: tuple[str, ...] = ()) -> str:
    """Imports and resources put in place: ``load(path)`` gives (media type, bytes or text) or None. A sheet that
    imports itself, at any depth, and what cannot be loaded become ``about:invalid``."""
    import base64
    import posixpath

    from .markup import classify, normalize_reference, servable

    def one(kind, value):
        what, path, scheme = classify(value)
        if what != "relative":
            return None if what == "fragment" or scheme == "data" else "about:invalid"
        path = normalize_reference(posixpath.join(posixpath.dirname(sheet), path))
        if kind == "import" and path in (*seen, sheet):
            return "about:invalid"
        found = load(path)
        if found is None:
            return "about:invalid"
        media, body = found
        if kind == "import":
            if media.split(";")[0].strip().lower() != "text/css":
                return "about:invalid"
            text = body if isinstance(body, str) else body.decode("utf-8", "replace")
            media, body = "text/css", inline(text, path, load, (*seen, sheet)).encode()
        elif not servable(media):
            return "about:invalid"
        raw = body.encode() if isinstance(body, str) else body
        return f"data:{media};base64,{base64.b64encode(raw).decode()}"

    return rewrite(css, one)
