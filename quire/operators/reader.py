"""Reader input, messages, appearance and navigation, as expressions and as replay of ordered events."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Intents of keys that do not depend on the direction.
KEYS = {
    "ArrowDown": "next", "PageDown": "next", " ": "next", "Space": "next", "ArrowUp": "prev", "PageUp": "prev",
    "Shift+ ": "prev", "Shift+Space": "prev", "Home": "start", "End": "end",
}


def edge_intent(right: Column, direction: Column) -> Column:
    return F.when(right == (direction != "rtl"), "next").otherwise("prev")


def key_intent(key: Column, direction: Column) -> Column:
    out = F.when(key.isin("ArrowLeft", "ArrowRight"), edge_intent(key == "ArrowRight", direction))
    for name, intent in KEYS.items():
        out = out.when(key == name, intent)
    return out.otherwise("none")


def swipe_intent(dx: Column, direction: Column) -> Column:
    return F.when(F.abs(dx) < 1, "none").otherwise(edge_intent(dx < 0, direction))


def tap_intent(x: Column, width: Column, direction: Column, left: float = 1 / 3, right: float = 2 / 3) -> Column:
    at = x / width
    return F.when(width <= 0, "none").when(at < left, edge_intent(F.lit(False), direction)).when(at >= right, edge_intent(F.lit(True), direction)).otherwise("none")


def gesture(dx: Column, dy: Column) -> Column:
    """swipe beyond 30 and mostly sideways, tap within 10 both ways, else none."""
    return F.when((F.abs(dx) > 30) & (F.abs(dx) > F.abs(dy)), "swipe").when((F.abs(dx) <= 10) & (F.abs(dy) <= 10), "tap").otherwise("none")


def gesture_message(dx: Column, dy: Column, selected: Column, link: Column, image: Column, decorated: Column) -> Column:
    """Type of the message that a finished gesture sends. A swipe that leaves a selection sends none; a tap means the link
    under it, else the image, else the decorations, else the place itself."""
    kind = gesture(dx, dy)
    tap = F.when(link, "linkclick").when(image, "imagetap").when(decorated, "decorationtap").otherwise("tap")
    return F.when(kind == "swipe", F.when(~selected, "swipe")).when(kind == "tap", tap)


# --- messages ---------------------------------------------------------------------------------------------------

VERSION = 13
_NUM, _STR, _BOOL = "number", "string", "boolean"
_RECT = {"x": "length", "y": "length", "width": "length", "height": "length"}
#: Fields of each message that a frame sends.
FRAME = {
    "ready": {}, "pong": {"id": _NUM}, "measured": {"id": _NUM, "width": _NUM, "height": _NUM},
    "paginated": {"id": _NUM, "state": {"pageCount": _NUM, "firm": _BOOL, "realizedChunks": _NUM, "totalChunks": _NUM, "contentWidth": _NUM, "contentHeight": _NUM}},
    "movedToPage": {"id": _NUM, "page": _NUM}, "offset": {"id": _NUM, "offset": _NUM}, "page": {"id": _NUM, "page": _NUM},
    "scrolledTo": {"id": _NUM, "top": _NUM}, "text": {"id": _NUM, "text": _STR}, "decorated": {"id": _NUM, "boxes": _NUM},
    "diagnosticsReport": {"id": _NUM, "domNodes": _NUM, "realizedChunks": _NUM, "totalChunks": _NUM},
    "violation": {"directive": _STR, "blockedUri": _STR}, "error": {"message": _STR}, "linkclick": {"href": _STR}, "key": {"key": _STR},
    "swipe": {"dx": _NUM, "dy": _NUM}, "tap": {"x": _NUM, "y": _NUM, "width": _NUM, "height": _NUM},
    "selection": {"start": _NUM, "end": _NUM, "text": _STR, "rect": _RECT, "rects": [_RECT]}, "selectioncleared": {},
    "decorationtap": {"x": _NUM, "y": _NUM, "decorations": ["some", {"id": _STR, "className": _STR, "rect": _RECT, "rects": [_RECT]}]},
    "imagetap": {"src": _STR, "alt": _STR},
}


#: Fields of each message that a host sends; every one has a numeric id.
_OPTIONS = {"mode": ("paginated", "scrolled"), "pageWidth": _NUM, "pageHeight": _NUM, "columnGap": _NUM, "chunkChars": _NUM, "windowChunks": _NUM, "columnCount": _NUM}
HOST = {
    "ping": {}, "measure": {}, "paginate": {"options": _OPTIONS}, "relayout": {}, "goToPage": {"page": _NUM}, "offsetOfPage": {"page": _NUM},
    "pageOfOffset": {"offset": _NUM}, "scrollToOffset": {"offset": _NUM}, "offsetOfElementId": {"elementId": _STR}, "sectionText": {},
    "diagnostics": {}, "decorate": {"decorationId": _STR, "start": _NUM, "end": _NUM, "className": _STR}, "undecorate": {"decorationId": _STR},
}


def _shaped(value, spec):
    """The value with the fields of the spec and no others; ValueError where it has another shape."""
    if isinstance(spec, dict):
        if not isinstance(value, dict):
            raise ValueError
        return {k: _shaped(value.get(k), s) for k, s in spec.items()}
    if isinstance(spec, list):
        if not isinstance(value, list) or spec[0] == "some" and not value:
            raise ValueError
        return [_shaped(v, spec[-1]) for v in value]
    if isinstance(spec, tuple):
        if value not in spec:
            raise ValueError
        return value
    fits = {
        _STR: isinstance(value, str), _BOOL: isinstance(value, bool),
        _NUM: isinstance(value, (int, float)) and not isinstance(value, bool),
    }
    fits["length"] = fits[_NUM] and math.isfinite(value) and value >= 0
    if not fits[spec]:
        raise ValueError
    return value


def host_message(text: str) -> str | None:
    """A host's message with its known fields, as JSON; None if any is missing or of another type."""
    return _message(text, HOST, {"id": _NUM})


def frame_message(text: str) -> str | None:
    """A frame's message likewise."""
    return _message(text, FRAME, {})


def _message(text: str, known: dict, common: dict) -> str | None:
    try:
        data = json.loads(text)
        if not isinstance(data, dict) or isinstance(data.get("v"), bool) or data.get("v") != VERSION or not isinstance(data.get("type"), str):
            return None
        spec = known.get(data["type"])
        return None if spec is None else json.dumps({"v": VERSION, "type": data["type"], **_shaped(data, {**common, **spec})}, ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


# --- appearance -------------------------------------------------------------------------------------------------

#: The built-in themes and their variables.
THEMES = {
    "light": {"--wr-background": "#ffffff", "--wr-color": "#1a1a1a", "--wr-link-color": "#1a5fb4", "--wr-selection-background": "#b4d5fe", "--wr-selection-color": "#1a1a1a"},
    "dark": {"--wr-background": "#121212", "--wr-color": "#e6e6e6", "--wr-link-color": "#8ab4f8", "--wr-selection-background": "#2f5fb0", "--wr-selection-color": "#ffffff"},
    "sepia": {"--wr-background": "#f4ecd8", "--wr-color": "#5b4636", "--wr-link-color": "#8a5a1a", "--wr-selection-background": "#e0cfa8", "--wr-selection-color": "#5b4636"},
}
REFLOWS = ("fontFamily", "fontSize", "lineHeight", "margin", "textAlign", "justify", "hyphenate", "columns")


def merge_appearance(base: dict, update: dict) -> dict:
    """Present keys of the update win (a present None clears); custom properties merge one by one."""
    custom = {**(base.get("customProperties") or {}), **(update.get("customProperties") or {})}
    merged = {k: v for k, v in {**base, **update}.items() if v is not None and k != "customProperties"}
    return {**merged, **({"customProperties": custom} if custom else {})}


def theme_variables(a: dict) -> dict | None:
    theme, custom = a.get("theme"), a.get("customProperties")
    if theme is None and custom is None:
        return None
    return {**THEMES.get(theme or "light", THEMES["light"]), **{k if k.startswith("--") else f"--{k}": v for k, v in (custom or {}).items()}}


def typography_variables(a: dict) -> dict | None:
    from ..functions.positions import number

    align = a.get("textAlign") or (None if a.get("justify") is None else "justify" if a["justify"] else "start")
    out = {
        "--wr-font-family": a.get("fontFamily"), "--wr-font-size": None if a.get("fontSize") is None else f"{number(a['fontSize'])}px",
        "--wr-line-height": None if a.get("lineHeight") is None else number(a["lineHeight"]), "--wr-text-align": align,
        "--wr-hyphens": None if a.get("hyphenate") is None else "auto" if a["hyphenate"] else "manual",
        "--wr-column-count": None if a.get("columns") is None else str(a["columns"]),
    }
    return {k: v for k, v in out.items() if v is not None} or None


def theme_style_sheet(a: dict, layer: str, root: str) -> str:
    """The style sheet of an appearance: defaults in a cascade layer, the surface of the element ``root``, the colours
    that follow the system, then a forced theme and the typography that is set."""
    block = lambda v: ":root{" + ";".join(f"{k}:{x}" for k, x in v.items()) + "}"
    use = lambda name, *also: [f"{p}:var(--wr-{name}) !important" for p in (*also, name)]
    surface = "{background:var(--wr-background);color:var(--wr-color)}"
    defaults = f"html{surface}body{surface}a{{color:var(--wr-link-color)}}::selection{{background:var(--wr-selection-background);color:var(--wr-selection-color)}}"
    forced, typography = theme_variables(a), typography_variables(a) or {}
    rules = [r for name in ("font-family", "font-size", "line-height", "text-align", "hyphens") if f"--wr-{name}" in typography for r in use(name, *(["-webkit-hyphens"] if name == "hyphens" else []))]
    return "".join((
        f"@layer {layer};@layer {layer}{{{defaults}}}", f"#{root}{{{';'.join(use('background') + use('color'))}}}",
        block(THEMES["light"]), f"@media (prefers-color-scheme: dark){{{block(THEMES['dark'])}}}", "" if forced is None else block(forced),
        f"{block(typography)}#{root}{{{';'.join(rules)}}}" if rules else "",
    ))


def reflows(update: dict) -> bool:
    return any(update.get(k) is not None for k in REFLOWS)


def merged_appearance(base: Column, update: Column) -> Column:
    """Two maps of settings as one: what the update has wins, and a null that it has clears."""
    both = F.map_zip_with(base, update, lambda k, b, u: F.when(F.map_contains_key(update, k), u).otherwise(b))
    return F.map_filter(both, lambda k, v: v.isNotNull())


def reflowing(update: Column) -> Column:
    """Whether an update (a map) sets anything that moves text."""
    return F.exists(F.array(*map(F.lit, REFLOWS)), lambda k: F.element_at(update, k).isNotNull())


def appearance_states(updates: DataFrame, key: str, order: str, settings: str) -> DataFrame:
    """(key, name, value): what all of a key's updates (maps) come to, merged in order. A setting is decided by the last
    update that has it, so updates are aggregated and never gathered or folded."""
    each = updates.select(key, order, F.explode(settings).alias("name", "value"))
    last = each.groupBy(key, "name").agg(F.max(F.struct(F.col(order).alias("at"), F.col("value").alias("value")))["value"].alias("value"))
    return last.filter("value IS NOT NULL")


# --- navigation -------------------------------------------------------------------------------------------------

NAVIGATION = "session long, seq long, section int, page int, depth int, status string"


class Reader:
    """One session: pages of each section, place, and the stack of places that links left."""

    def __init__(self, pages: list[int], place=(0, 0), stack=()):
        self.pages, self.place, self.stack = pages, tuple(place), [tuple(s) for s in stack]

    def apply(self, verb: str, target: int | None = None) -> str:
        """Roll over section ends; a link pushes the place only if its target exists; back pops."""
        section, page = self.place
        last = len(self.pages) - 1
        if verb == "next":
            self.place = (section, page + 1) if page + 1 < self.pages[section] else (section + 1, 0) if section < last else self.place
        elif verb == "prev":
            self.place = (section, page - 1) if page else (section - 1, self.pages[section - 1] - 1) if section else self.place
        elif verb in ("start", "end"):
            self.place = (0, 0) if verb == "start" else (last, self.pages[last] - 1)
        elif verb == "link":
            if target is None or not 0 <= target <= last:
                return "error"
            self.stack.append(self.place)
            self.place = (target, 0)
        elif verb == "back":
            if not self.stack:
                return "none"
            self.place = self.stack.pop()
        else:
            return "error"
        return "moved" if self.place != (section, page) else "none"


def navigation_events(replayed: DataFrame, pages: list[int]) -> DataFrame:
    """(session, seq, event, section, page, progress): what a host hears of replayed navigation, in its order: ``relocated``
    with the share of the book behind the place, ``error`` for a step that failed (it breaks nothing behind it); nothing
    for a step that moved nothing."""
    size = F.get(F.array(*[F.lit(n) for n in pages]), F.col("section"))
    within = F.when(size > 1, F.col("page") / (size - 1)).otherwise(F.lit(0.0))
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("section") + within) / F.lit(len(pages))))
    event = F.when(F.col("status") == "error", "error").when(F.col("status") == "moved", "relocated")
    moved = F.col("event") == "relocated"
    told = replayed.withColumn("event", event).filter("event IS NOT NULL")
    return told.select("session", "seq", "event", *[F.when(moved, F.col(c)).alias(c) for c in ("section", "page")], F.when(moved, progress).alias("progress"))


def replay(events: DataFrame, pages: list[int]) -> DataFrame:
    """Sessions' events (session, seq, verb, target) in order; a session is replayed as one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        reader, rows = Reader(pages), []
        for e in pdf.sort_values("seq").itertuples():
            status = reader.apply(e.verb, None if pd.isna(e.target) else int(e.target))
            rows.append((e.session, e.seq, *reader.place, len(reader.stack), status))
        return pd.DataFrame(rows, columns=["session", "seq", "section", "page", "depth", "status"])

    return events.groupBy("session").applyInPandas(run, NAVIGATION)
