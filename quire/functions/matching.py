"""Literal search in folded text."""

from __future__ import annotations

import regex

from .positions import capture
from .unicode import SPACE_CHARS, Units, collapse, fold, fold_map, u16

RADIUS = 40
_WORDS = regex.compile(r"(?w)\b")
_WORDLIKE = regex.compile(r"[\p{L}\p{N}\p{M}]")


def search(text: str, query: str, section: str, index: int, radius: int = RADIUS, most: int | None = None, bare: bool = False) -> list[dict]:
    """Non-overlapping hits in order: matched raw text, context cut to words, position (``bare``: neither of the two).
    The scan stops after ``most``."""
    needle = fold(query)
    if not needle or needle not in fold(text):
        return []
    folded, places = fold_map(text)
    units, out, lo = Units(text), [], 0
    wide = u16(folded) != len(folded)
    unit = [0]
    for c in folded if wide else "":
        unit.append(unit[-1] + (2 if c > "\uffff" else 1))
    while (most is None or len(out) < most) and (at := folded.find(needle, lo)) != -1:
        lo = at + len(needle)
        first, last = (unit[at], unit[lo]) if wide else (at, lo)
        begin, end = places[first], places[last]
        hit = units.cut(begin, end).rstrip(SPACE_CHARS)
        if bare:
            out.append({"hit_ord": len(out), "start_u16": begin, "text": hit})
            continue
        end = begin + u16(hit)
        c_lo, c_hi = places[max(0, first - radius)], places[min(len(places) - 1, last + radius)]
        out.append({"hit_ord": len(out), "start_u16": begin, "text": hit, "context": _context(units, c_lo, c_hi, begin, end), "section_index": index, **capture(units, begin, section)})
    return out


def _context(units: Units, lo: int, hi: int, begin: int, end: int) -> str:
    """The context without words that its edges cut."""
    left, right = max(0, min(lo, begin) - 24), min(units.size, max(hi, end) + 24)
    window = units.cut(left, right)
    edges = [m.start() for m in _WORDS.finditer(window)]
    head, tail = lo, hi
    for a, b in zip(edges, edges[1:]):
        if not _WORDLIKE.search(window, a, b):
            continue
        a, b = left + u16(window[:a]), left + u16(window[:b])
        if a < lo < b:
            head = min(begin, b)
        if a < hi < b:
            tail = max(end, a)
    return collapse(units.cut(head, tail))


class Folded:
    """A text in its search form, and the way back: raw offset and raw text of a span of the form."""

    def __init__(self, text: str):
        self.raw = text
        self.text, self._places = fold_map(text)
        self._wide = u16(self.text) != len(self.text)
        self._unit = self._units = None

    def span(self, at: int, size: int) -> tuple[int, str]:
        """(UTF-16 offset, raw text without space at its end) of ``size`` characters of the form."""
        lo, hi = at, at + size
        if self._wide:
            if self._unit is None:
                self._unit = [0]
                for c in self.text:
                    self._unit.append(self._unit[-1] + (2 if c > "￿" else 1))
            lo, hi = self._unit[lo], self._unit[hi]
        if self._units is None:
            self._units = Units(self.raw)
        return self._places[lo], self._units.cut(self._places[lo], self._places[hi]).rstrip(SPACE_CHARS)


def apart(places: list[int], size: int) -> list[int]:
    """Of ascending places those that a scan finds which goes on behind each hit."""
    out: list[int] = []
    for at in places:
        if not out or at >= out[-1] + size:
            out.append(at)
    return out
