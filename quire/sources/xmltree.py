"""XML as a light tree: strict, or tolerant of the faults that books in the wild have."""

from __future__ import annotations

import codecs

import regex

#: Entities that XML books use besides numbers.
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0"}
_REFERENCE = regex.compile(r"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|([a-zA-Z][a-zA-Z0-9]*));")
_MARKUP = regex.compile(r"(?P<text>[^<]+)|<\?.*?(?P<pi>\?>)|<!--.*?(?P<comment>-->)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<(?P<declaration>!)(?!--|\[CDATA\[)|</(?P<close>[^ \t\n\r>/=]+)|<(?P<open>[^ \t\n\r>/=!?][^ \t\n\r>/=]*)", regex.DOTALL)
_FIELD = regex.compile(r"""[ \t\n\r]*(?:(?P<end>/?>)|(?P<slash>/)|(?P<name>[^ \t\n\r>/=]+)(?:[ \t\n\r]*=[ \t\n\r]*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<open>["'])(?P<cut>[^>]*)|(?P<bare>[^ \t\n\r>"'][^ \t\n\r>]*|(?=[ \t\n\r>]))))?|(?P<stray>=))""")


class XmlError(ValueError):
    pass


class Node:
    __slots__ = ("attributes", "content", "name")

    def __init__(self, name: str):
        self.name, self.attributes, self.content = name, {}, []

    @property
    def local(self) -> str:
        return self.name.partition(":")[2] or self.name

    @property
    def children(self) -> list[Node]:
        return [c for c in self.content if isinstance(c, Node)]

    @property
    def text(self) -> str:
        return "".join(c for c in self.content if isinstance(c, str))

    def get(self, name: str) -> str | None:
        """An attribute by its exact name, else by its name without prefix."""
        if name in self.attributes:
            return self.attributes[name]
        return next((v for k, v in self.attributes.items() if (k.partition(":")[2] or k) == name), None)

    def all(self, local: str) -> list[Node]:
        return [c for c in self.children if c.local == local]

    def first(self, local: str) -> Node | None:
        return next(iter(self.all(local)), None)

    def walk(self):
        for c in self.children:
            yield c
            yield from c.walk()

    def within(self, local: str) -> list[Node]:
        return [n for n in self.walk() if n.local == local]

    def deep_text(self) -> str:
        return "".join(c if isinstance(c, str) else c.deep_text() for c in self.content)


def decode(data: bytes) -> str:
    """UTF-16 by byte-order mark, else the prolog's encoding, else UTF-8."""
    for mark, name in ((codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[2:].decode(name, "replace")
    head = data[:200].decode("latin-1")
    label = regex.search(r"""(?i)encoding\s*=\s*["']([^"']+)["']""", head.partition("?>")[0]) if head.startswith("<?xml") and "?>" in head else None
    name = label[1].strip().lower() if label else "utf-8"
    if regex.fullmatch(r"utf-?8|utf-?16.*", name):
        name = "utf-8"
    try:
        codecs.lookup(name)
    except LookupError:
        name = "utf-8"
    return data.decode(name, "replace").removeprefix("﻿")


#: Compiled once: a lookup of a pattern costs as much as the match of a closing tag.
_TAIL, _BRACKET = regex.compile(r"[ \t\n\r]*>"), regex.compile(r"[\[\]>]")


def entities(text: str) -> str:
    def one(m):
        if m[3]:
            return _NAMED.get(m[3], m[0])
        code = int(m[1], 16) if m[1] else int(m[2])
        return m[0] if code > 0x10FFFF else "�" if 0xD800 <= code < 0xE000 else chr(code)

    return _REFERENCE.sub(one, text) if "&" in text else text


def _declaration_end(text: str, at: int) -> int:
    depth = 0
    for m in _BRACKET.finditer(text, at):
        depth += {"[": 1, "]": -1}.get(m[0], 0)
        if m[0] == ">" and depth <= 0:
            return m.end()
    raise XmlError(f"a declaration at {at} has no end")


def _attributes(text: str, at: int, node: Node, tolerant: bool) -> tuple[int, bool]:
    """(end of the tag, whether it closes itself)."""
    while True:
        m = _FIELD.match(text, at)
        if m is None or m["stray"]:
            if tolerant and (m is None or not text[at:].strip(" \t\n\r")):
                return len(text), False
            raise XmlError(f"bad tag <{node.name}> at {at}")
        at = m.end()
        if m["end"]:
            return at, m["end"] == "/>"
        if not tolerant and (m["slash"] or m["dq"] is None and m["sq"] is None):
            raise XmlError(f"bad attribute in <{node.name}> at {at}")
        if m["slash"]:
            continue
        value = next((m[k] for k in ("dq", "sq", "cut", "bare") if m[k] is not None), "")
        if m["bare"] and value.endswith("/") and text[at : at + 1] == ">":
            value, at = value[:-1], at - 1
        node.attributes[m["name"]] = entities(value)


def parse(text: str, tolerant: bool = False) -> Node:
    text = text.removeprefix("﻿")
    root, open_, at = None, [], 0

    def say(words: str) -> None:
        if open_ and words:
            body = open_[-1].content
            if body and isinstance(body[-1], str):
                body[-1] += words
            else:
                body.append(words)

    while at < len(text):
        m = _MARKUP.match(text, at)
        if m is None:
            raise XmlError(f"bad markup at {at}")
        at = m.end()
        if m["text"] is not None:
            if m.end() < len(text):
                say(entities(m["text"]))
        elif m["cdata"] is not None:
            say(m["cdata"])
        elif m["declaration"]:
            at = _declaration_end(text, at)
        elif m["close"]:
            tail = _TAIL.match(text, at)
            if tail is None and not tolerant:
                raise XmlError(f"</{m['close']}> has no end")
            at = tail.end() if tail else (text.find(">", at) + 1 or len(text))
            places = [i for i, n in enumerate(open_) if n.name == m["close"]]
            if not tolerant and (not open_ or open_[-1].name != m["close"]):
                raise XmlError(f"</{m['close']}> closes nothing")
            if places:
                del open_[places[-1] :]
        elif m["open"]:
            node = Node(m["open"])
            at, alone = _attributes(text, at, node, tolerant)
            if open_:
                open_[-1].content.append(node)
            elif root is None:
                root = node
            elif not tolerant:
                raise XmlError("a second root element")
            if not alone:
                open_.append(node)
    if open_ and not tolerant:
        raise XmlError(f"<{open_[-1].name}> is not closed")
    if root is None:
        raise XmlError("no root element")
    return root
