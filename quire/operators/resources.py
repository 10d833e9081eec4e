"""References of sections: resolved against the archive, turned into data URLs, put into documents; and the top-level
nodes and element offsets of a section's markup.

A reference is an equi-join on its resolved path; bytes are encoded once for each different target, not for each
reference. Only the rewriting of markup is a Python kernel."""

from __future__ import annotations

import base64

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import css, markup
from ..functions.unicode import SPACE_CHARS, u16
from ..sources.decode import directory_of, resolve_href
from ..sources.xmltree import Node
from .books import first_wins
from .sanitize import read_html, serialize

#: The form of a media type that a data URL may declare, and what stands for any other.
MEDIA_TYPE = r"^[a-z0-9][a-z0-9!#$&^_.+-]*/[a-z0-9][a-z0-9!#$&^_.+-]*$"
OTHER_TYPE = "application/octet-stream"
NODES = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("chars", T.LongType())]))
OFFSETS = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("offset", T.LongType())]))
APPLIED = T.StructType([T.StructField("html", T.StringType()), T.StructField("alt_substituted", T.IntegerType())])


# --- references as columns --------------------------------------------------------------------------------------


def base_media_type(media: Column) -> Column:
    return F.lower(C.trim(F.substring_index(media, ";", 1)))


def servable(media: Column) -> Column:
    base = base_media_type(media)
    return F.coalesce(base.rlike("^(image|font)/") | base.isin(*sorted(markup.FONT_TYPES)), F.lit(False))


def _unescaped(part: Column) -> Column:
    plain = F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))
    fine = part.contains("%") & ~part.rlike("%(?![0-9a-fA-F]{2})") & ~F.contains(plain, F.lit("�"))
    return F.when(F.coalesce(fine, F.lit(False)), plain).otherwise(part)


def resolved_path(directory: Column, reference: Column) -> Column:
    """The archive path of a reference from a directory ("" or ending in /); null for schemes, fragments and the root."""
    path = F.substring_index(reference, "#", 1)
    whole = F.when(F.startswith(path, F.lit("/")), F.substring(path, 2, 1 << 30)).otherwise(F.concat(directory, path))

    def step(done, part):
        return F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(part.isin("", "."), done).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.transform(F.split(whole, "/"), _unescaped), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    return F.when((path != "") & ~path.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") & (joined != ""), joined)


def directory_column(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def resolve_references(refs: DataFrame, entries: DataFrame, book: str) -> DataFrame:
    """The references (book, section_path, reference, ...) with path, status and url.

    ``entries`` are (book, path, ord, media_type, content); of equal paths the first counts. Status: the reference's
    kind where it is no relative one (``remote`` for schemes), else unresolved (no such entry, or no bytes), refused
    (a media type that is not served), resolved."""
    kind = C.reference_kind(F.col("reference"))
    asked = refs.withColumn("path", F.when(kind == "relative", resolved_path(directory_column(F.col("section_path")), C.reference_value(F.col("reference")))))
    wanted = asked.filter("path IS NOT NULL").select(book, "path").distinct()
    held = first_wins(wanted.join(entries, [book, "path"]).select(book, "path", "ord", "media_type", "content"), [book, "path"], ["ord"])
    declared = F.when(base_media_type(F.col("media_type")).rlike(MEDIA_TYPE), base_media_type(F.col("media_type"))).otherwise(OTHER_TYPE)
    fit = servable(F.col("media_type"))
    made = held.select(
        book, "path", F.when(~fit, "refused").when(F.col("content").isNull(), "unresolved").otherwise("resolved").alias("status"),
        F.when(fit, F.concat(F.lit("data:"), declared, F.lit(";base64,"), F.translate(F.base64("content"), "\r\n", ""))).alias("url"),
    )
    status = F.when(kind == "scheme", "remote").when(kind != "relative", kind).otherwise(F.coalesce("status", F.lit("unresolved")))
    return asked.join(made, [book, "path"], "left").withColumn("status", status)


def ordered_sets(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """Different values of each key in the order in which they first occur."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias(name))


# --- documents --------------------------------------------------------------------------------------------------


def _body(source: str) -> list:
    root = read_html(source)
    body = next((n for n in root.walk() if n.local.lower() == "body"), root)
    out: list = []
    for n in body.content:
        if isinstance(n, str) and out and isinstance(out[-1], str):
            out[-1] += n
        else:
            out.append(n)
    return out


def top_level_nodes(source: str) -> list[dict]:
    """Tag and text length of the body's children; text of white space alone is none."""
    out = []
    for n in _body(source):
        if isinstance(n, Node):
            out.append({"tag": n.name.upper(), "chars": u16(n.deep_text())})
        elif n.strip(SPACE_CHARS):
            out.append({"tag": "#text", "chars": u16(n)})
    return out


def element_offsets(source: str) -> list[dict]:
    """Where in the section's text each id stands; of equal ids the first."""
    out, at = {}, 0

    def visit(n):
        nonlocal at
        if isinstance(n, str):
            at += u16(n)
            return
        if n.attributes.get("id") is not None:
            out.setdefault(n.attributes["id"], at)
        for c in n.content:
            visit(c)

    for n in _body(source):
        if isinstance(n, Node) or n.strip(SPACE_CHARS):
            visit(n)
    return [{"id": k, "offset": v} for k, v in out.items()]


def _decoded(data: bytes) -> str:
    wide = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(data[:2])
    return data[2:].decode(wide, "replace") if wide else data.decode("utf-8", "replace").removeprefix("﻿")


def apply_resources(source: str, section_path: str, resources: list) -> dict:
    """Markup with every reference to the book replaced by a data URL, and how many images became their text.

    ``resources`` are (path, media_type, content). Links, style elements and attributes, images and SVG images are
    rewritten; a link or SVG image that cannot be served goes, an image turns into its alternative text."""
    held: dict = {}
    for r in resources or []:
        held.setdefault(r["path"], (r["media_type"] or "", r["content"]))
    directory = directory_of(section_path or "")

    def load(reference):
        target = resolve_href(directory, reference)
        found = held.get(target[0]) if target else None
        return None if found is None or found[1] is None else (markup_type(found[0]), bytes(found[1]))

    def url(reference):
        found = load(markup.normalize_reference(reference))
        return f"data:{found[0]};base64,{base64.b64encode(found[1]).decode()}" if found and markup.servable(found[0]) else None

    def sheet(reference):
        path = markup.normalize_reference(reference)
        found = load(path)
        if found is None or found[0] != "text/css":
            return None
        return "data:text/css;base64," + base64.b64encode(css.inline(_decoded(found[1]), path, load).encode()).decode()

    count = 0

    def one(n) -> list:
        nonlocal count
        if isinstance(n, str):
            return [n]
        name, own = n.local.lower(), n.attributes
        if own.get("style") is not None:
            own["style"] = css.inline(own["style"], "", load)
        if name == "style":
            n.content = [css.inline(n.deep_text(), "", load)]
            return [n]
        for wanted, field, make in (("link", "href", sheet), ("img", "src", url), ("image", "href", url)):
            if name != wanted:
                continue
            raw = own.get(field, own.get("xlink:href") if name == "image" else None)
            kind, value, _ = markup.classify(raw) if raw is not None else ("absent", "", None)
            if kind not in ("relative", "absent") or kind == "absent" and name == "image":
                break
            new = make(value) if kind == "relative" else None
            if new is not None:
                for k in [k for k in (field, "xlink:href") if k in own]:
                    own[k] = new
                break
            alt = own.get("alt") if name == "img" else None
            count += bool(alt)
            return [alt] if alt else []
        n.content = [x for c in n.content for x in one(c)]
        return [n]

    return {"html": serialize([x for n in _body(source) for x in one(n)]), "alt_substituted": count}


def markup_type(media: str) -> str:
    base = media.split(";")[0].strip(SPACE_CHARS).lower()
    return base if regex.match(MEDIA_TYPE, base) else OTHER_TYPE


top_nodes = C.kernel(top_level_nodes, NODES)
id_offsets = C.kernel(element_offsets, OFFSETS)
with_resources = C.kernel(apply_resources, APPLIED)
