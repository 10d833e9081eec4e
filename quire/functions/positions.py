"""Content-addressed positions: capture, serialise, parse, resolve."""

from __future__ import annotations

import json
import math

from .unicode import Units, collapse, sentence_runs, u16

QUOTE = CONTEXT = 32
#: Prefix and version of the serialised form.
PREFIX, VERSION = "wr1:", 1


def number(x: float) -> str:
    """Shortest decimal form, exponents only below 1e-6 and from 1e21 on."""
    if x == 0:
        return "0"
    sign, digits, exp = ("-" if x < 0 else ""), *_digits(abs(x))
    n = exp + 1
    if len(digits) <= n <= 21:
        return sign + digits + "0" * (n - len(digits))
    if 0 < n <= 21:
        return f"{sign}{digits[:n]}.{digits[n:]}"
    if -6 < n <= 0:
        return sign + "0." + "0" * -n + digits
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if exp > 0 else '-'}{abs(exp)}"


def _digits(x: float) -> tuple[str, int]:
    mantissa, _, exp = f"{x!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    shift = len(whole) - 1 + int(exp or 0)
    digits = whole + part
    lead = len(digits) - len(digits.lstrip("0"))
    return digits.lstrip("0").rstrip("0") or "0", shift - lead


def serialize(section: str, progress: float, exact: str, prefix: str, suffix: str, offset: int) -> str:
    text = lambda s: json.dumps(s, ensure_ascii=False)
    fields = {"v": str(VERSION), "s": text(section), "p": number(progress), "e": text(exact), "pre": text(prefix), "suf": text(suffix), "o": number(offset)}
    return PREFIX + "{" + ",".join(f'"{k}":{v}' for k, v in fields.items()) + "}"


def capture(units: Units, offset_u16: int, section: str, quote: int = QUOTE, context: int = CONTEXT) -> dict:
    """The position of a UTF-16 offset, snapped back to the start of its word."""
    total = len(units.parts)
    start = units.word_start(units.at(offset_u16))
    end = min(start + quote, total)
    exact, prefix, suffix = units.slice(start, end), units.slice(max(0, start - context), start), units.slice(end, min(end + context, total))
    progress = start / total if total else 0.0
    return {"section_id": section, "progress": progress, "exact": exact, "prefix": prefix, "suffix": suffix, "offset_g": start, "serialized": serialize(section, progress, exact, prefix, suffix, start)}


def parse(serialized: str) -> tuple[dict | None, str | None]:
    """(position, None) or (None, reason)."""
    if not serialized.startswith(PREFIX):
        return None, "prefix"
    try:
        payload = json.loads(serialized[len(PREFIX) :], parse_constant=lambda name: 1 / 0)
    except (ValueError, ZeroDivisionError, RecursionError):
        return None, "json"
    is_number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if not (isinstance(payload, dict) and all(is_number(payload.get(k)) for k in "vpo") and all(isinstance(payload.get(k), str) for k in ("s", "e", "pre", "suf"))):
        return None, "fields"
    if payload["v"] != VERSION:
        return None, "version"
    return {"section_id": payload["s"], "progress": float(payload["p"]), "exact": payload["e"], "prefix": payload["pre"], "suffix": payload["suf"], "offset_g": payload["o"], "serialized": serialized}, None


def resolve(units: Units, exact: str, prefix: str, suffix: str, offset_g: float) -> tuple[int, int] | None:
    """(grapheme offset, length) of the occurrence with the most matching context, then the nearest, then first."""
    have, total = units.parts, len(units.parts)
    if exact == "":
        return int(min(offset_g, total)), 0
    want, before, after = Units(exact).parts, Units(prefix).parts, Units(suffix).parts
    best = None
    for at in _occurrences(units, exact, want):
        score = sum(1 for _ in _while_equal(have[max(0, at - len(before)) : at][::-1], before[::-1]))
        score += sum(1 for _ in _while_equal(have[at + len(want) : at + len(want) + len(after)], after))
        rank = (-score, abs(at - offset_g), at)
        if best is None or rank < best:
            best = rank
    return None if best is None else (best[2], len(want))


def _while_equal(a, b):
    for x, y in zip(a, b):
        if x != y:
            return
        yield x


def _occurrences(units: Units, exact: str, want: list[str]):
    """Grapheme starts of the quote, overlaps allowed: found as substrings, kept where graphemes agree."""
    at = units.text.find(exact)
    places = None
    while at != -1:
        if places is None and len(units.parts) != len(units.text):
            places, n = {}, 0
            for g, part in enumerate(units.parts):
                places[n] = g
                n += len(part)
        g = at if places is None else places.get(at)
        if g is not None and units.parts[g : g + len(want)] == want:
            yield g
        at = units.text.find(exact, at + 1)


def sentences(text: str, section: str) -> list[dict]:
    """Sentences with collapsed text; each position quotes its whole raw sentence."""
    units, out = Units(text), []
    for start, raw in sentence_runs(text):
        place = capture(units, u16(text[:start]), section, quote=len(Units(raw).parts))
        out.append({"text": collapse(raw), **place})
    return out


def section_progress(index: int, fraction: float, sections: int) -> float:
    return min(1.0, max(0.0, (index + fraction) / sections)) if sections else math.nan
