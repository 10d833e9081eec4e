"""Markup as a table of nodes, and books read from it by joins.

``tree`` numbers the tags and texts of documents in the JVM: a node's interval (pre, post) holds the intervals of what
stands in it, so navigation is relational. Levels come from running sums over tags; the parent of a node is the last tag of the level
above that opened before it; the nearest enclosing node of a kind, the first node of a kind within another and the text
of an element are found the same way, each in one ordered pass over a document's nodes instead of a join of ancestors
with descendants. All passes are keyed by the document, so its nodes are shuffled once.

Parsing is strict: a document with an unbalanced or unclosed tag, an attribute without quotes or a second root has no
nodes; ``broken`` names such documents. Null and empty documents have none and count as broken. Comments, processing
instructions, declarations and what stands outside the root are skipped; CDATA is text as it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..sources import xmltree
from .resources import directory_column, resolved_path

_TOKEN = (
    r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?!--|\[CDATA\[)(?:[^\[\]>]++|\[(?:[^\[\]]++|\[[^\]]*+\])*+\])*+>"
    r"|<(?![!?])(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]++|<"
)
_NAME = r"[^ \t\n\r>/=\"'<]+"
_ATTRIBUTE = rf"({_NAME})[ \t\n\r]*=[ \t\n\r]*(\"[^\"]*+\"|'[^']*+')"
_OPEN = rf"^<{_NAME}+(?:[ \t\n\r]*+{_NAME}+[ \t\n\r]*+=[ \t\n\r]*+(?:\"[^\"]*+\"|'[^']*+'))*+[ \t\n\r]*+/?>$"
_CLOSE = rf"^</{_NAME}[ \t\n\r]*>$"

_numbered = C.kernel(xmltree.entities, T.StringType())
_labelled = C.kernel(lambda data: xmltree.decode(bytes(data)), T.StringType())


def xml_text(content: Column) -> Column:
    """Text of an XML document's bytes. Python sees only those whose prolog names an encoding other than UTF-8."""
    head = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    label = F.lower(F.regexp_extract(head, r"(?s)^<\?xml[^>]*?encoding\s*=\s*[\"']([^\"']+)[\"'].*?\?>", 1))
    own = ~label.isin("", "utf-8", "utf8")
    return F.when(own, _labelled(F.when(own, content))).otherwise(C.section_text(content))


def entities(text: Column) -> Column:
    """The five named characters and the space that XML books use; numbers are decoded in Python, where there are any."""
    plain = text
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\xa0"), ("amp", "&")):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(char))
    hard = F.contains(text, F.lit("&#"))
    return F.when(~F.contains(text, F.lit("&")), text).when(hard, _numbered(F.when(hard, text))).otherwise(plain)


#: Characters of documents that one task makes nodes of; the sorts over their tokens hold some hundred times as many bytes.
PART = 1 << 20


def tasks(docs: DataFrame, xml: str, part: int = PART) -> int:
    """To how many tasks documents are to be dealt, so that the sorts of each stay in memory however large the table is.
    Said outright (``repartition``): tasks by shuffled bytes, as adaptive execution makes them, would be too large."""
    size = docs.agg(F.sum(F.length(xml))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part))


def _tokens(docs: DataFrame, keys: list[str], xml: str) -> DataFrame:
    found = docs.select(*keys, F.posexplode_outer(F.regexp_extract_all(F.col(xml), F.lit(_TOKEN), F.lit(0))).alias("pre", "token"))
    token = F.col("token")
    kind = (
        F.when(token.isNull() | (token == "<"), "bad").when(~F.startswith(token, F.lit("<")), "text").when(F.startswith(token, F.lit("<![CDATA[")), "cdata")
        .when(token.rlike(r"^<[!?]"), "skip").when(F.startswith(token, F.lit("</")), F.when(token.rlike(_CLOSE), "close").otherwise("bad"))
        .when(~token.rlike(_OPEN), "bad").when(F.endswith(token, F.lit("/>")), "empty").otherwise("open")
    )
    named = F.regexp_extract(token, rf"^</?({_NAME})", 1)
    return found.select(*keys, F.coalesce("pre", F.lit(0)).alias("pre"), "token", kind.alias("kind"), F.when(token.rlike("^</?[^!?]"), named).alias("qname")).filter("kind <> 'skip'")


def _placed(docs: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """Every token with level, parent, post and whether its document is broken."""
    tokens = _tokens(docs, keys, xml)
    reading = Window.partitionBy(*keys).orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    levels = tokens.withColumn("_open", F.sum(step).over(reading)).withColumn("depth", (F.col("_open") + F.when(F.col("kind") == "open", 0).otherwise(1)).cast("int"))
    # An open tag stands in its own level and, as what comes next's parent, in the one below.
    stands = F.array(F.struct(F.col("depth").alias("level"), F.lit(False).alias("above")))
    both = F.when(F.col("kind") == "open", F.concat(stands, F.array(F.struct((F.col("depth") + 1).alias("level"), F.lit(True).alias("above"))))).otherwise(stands)
    rows = levels.withColumn("_at", F.explode(both))
    level = Window.partitionBy(*keys, "_at.level").orderBy("pre")
    upto = level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = F.last(F.when(F.col("_at.above"), F.struct("pre", "qname")), ignorenulls=True).over(upto)
    rows = rows.withColumn("_above", above).withColumn("parent", F.col("_above.pre"))
    closing = lambda c: F.lead(c).over(level)
    matches = (F.col("kind") != "open") | F.coalesce((closing("kind") == "close") & (closing("qname") == F.col("qname")), F.lit(False))
    rows = rows.withColumn("post", F.when(F.col("kind") == "open", closing("pre")).otherwise(F.col("pre"))).withColumn("_fine", matches).filter("NOT _at.above")
    whole = Window.partitionBy(*keys)
    bad = (F.col("kind") == "bad") | ~F.col("_fine") | (F.col("kind") == "close") & (F.col("_open") < 0)
    roots = F.sum(((F.col("depth") == 1) & F.col("kind").isin("open", "empty")).cast("int")).over(whole)
    return rows.withColumn("_broken", F.max(bad).over(whole) | (roots != 1) | (F.sum(step).over(whole) != 0))


def _local(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(":")), F.regexp_extract(name, "^[^:]*:(.*)$", 1)).otherwise(name)


def tree(docs: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """(keys, pre, post, depth, parent, above, kind, qname, name, attributes, value) of well-formed documents: a row an element
    (kind ``element``; name is without prefix, ``above`` is the parent's name) and a row a text (kind ``text``). The root
    has depth 1 and no parent."""
    nodes = _placed(docs, keys, xml).filter("NOT _broken AND kind <> 'close' AND (depth > 1 OR kind IN ('open', 'empty'))")
    element = F.col("kind").isin("open", "empty")
    pairs = F.arrays_zip(F.regexp_extract_all("token", F.lit(_ATTRIBUTE), F.lit(1)).alias("k"), F.regexp_extract_all("token", F.lit(_ATTRIBUTE), F.lit(2)).alias("v"))
    fields = F.transform(pairs, lambda p: F.struct(p["k"].alias("name"), F.substring(p["v"], F.lit(2), F.length(p["v"]) - 2).alias("value")))
    text = F.when(F.col("kind") == "cdata", F.expr("substring(token, 10, length(token) - 12)")).otherwise(entities(F.col("token")))
    return nodes.select(
        *keys, "pre", F.col("post").cast("int").alias("post"), "depth", "parent", _local(F.col("_above.qname")).alias("above"), F.when(element, "element").otherwise("text").alias("kind"), "qname",
        _local(F.col("qname")).alias("name"), F.when(element, fields).alias("attributes"), F.when(~element, text).alias("value"),
    )


def broken(docs: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """The keys of the documents that are not well-formed."""
    return _placed(docs, keys, xml).filter("_broken").select(*keys).distinct()


def attribute(name: str) -> Column:
    """An attribute of a node by its exact name, else by its name without prefix; null without one."""
    exact = F.filter("attributes", lambda a: a["name"] == name)
    bare = F.filter("attributes", lambda a: F.endswith(a["name"], F.lit(f":{name}")))
    return entities(F.coalesce(F.get(exact, F.lit(0)), F.get(bare, F.lit(0)))["value"])


def enclosing(nodes: DataFrame, keys: list[str], outer: Column, name: str, value: str = "pre", level: str | None = None) -> DataFrame:
    """The nodes with ``name``: pre (or another column) of the nearest node around each (not itself) for which ``outer``
    holds, null without; and with ``level``, if named: how many such nodes are around it.

    The nodes that hold open and close like brackets: a running sum gives how deep in them a row stands, and the last one
    opened at that depth is the nearest."""
    marked = nodes.withColumn("_outer", F.coalesce(outer, F.lit(False)))
    opened = F.array(F.struct(F.col("pre").alias("at"), F.when(F.col("_outer"), 1).otherwise(0).alias("step"), F.lit(False).alias("end")))
    closed = F.array(F.struct(F.col("post").alias("at"), F.lit(-1).alias("step"), F.lit(True).alias("end")))
    events = marked.withColumn("_e", F.explode(F.when(F.col("_outer"), F.concat(opened, closed)).otherwise(opened)))
    reading = Window.partitionBy(*keys).orderBy("_e.at", "_e.end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("_in", F.sum("_e.step").over(reading)).filter("NOT _e.end")
    own = F.struct((F.col("_in") - F.when(F.col("_outer"), 1).otherwise(0)).alias("level"), F.lit(False).alias("above"))
    rows = events.withColumn("_at", F.explode(F.when(F.col("_outer"), F.array(own, F.struct(F.col("_in").alias("level"), F.lit(True).alias("above")))).otherwise(F.array(own))))
    inner = Window.partitionBy(*keys, "_at.level").orderBy("pre", "_at.above").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last(F.when(F.col("_at.above"), F.col(value)), ignorenulls=True).over(inner)
    rows = rows.withColumn(name, F.when(F.col("_at.level") > 0, found)).filter("NOT _at.above")
    return (rows if level is None else rows.withColumn(level, F.col("_at.level"))).drop("_outer", "_e", "_in", "_at")


def first_within(nodes: DataFrame, keys: list[str], inner: Column, name: str, value: str = "pre") -> DataFrame:
    """The nodes with ``name``: pre (or another column) of the first node at or within each for which ``inner`` holds."""
    back = Window.partitionBy(*keys).orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = nodes.withColumn("_found", F.last(F.when(inner, F.struct(F.col("pre").alias("at"), F.col(value).alias("value"))), ignorenulls=True).over(back))
    return found.withColumn(name, F.when(F.col("_found.at") <= F.col("post"), F.col("_found.value"))).drop("_found")


def _joined(texts: Column) -> Column:
    """The texts of (pre, value) rows in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(texts)), lambda x: x["value"]), "")


def texts_within(nodes: DataFrame, keys: list[str], outer: Column, name: str) -> DataFrame:
    """(keys, pre, ``name``): the text of every node for which ``outer`` holds, in order. Text counts for the nearest
    such node around it."""
    placed = enclosing(nodes, keys, outer, "_of").filter("kind = 'text' AND _of IS NOT NULL")
    return placed.groupBy(*keys, F.col("_of").alias("pre")).agg(_joined(F.struct("pre", "value")).alias(name))


# --- packages ---------------------------------------------------------------------------------------------------

#: Fixed values of the container format.
PACKAGE_TYPE, OCTETS = "application/oebps-package+xml", "application/octet-stream"


def packages(nodes: DataFrame, keys: list[str], file: str, parts: int | None = None) -> DataFrame:
    """The nodes of each book's package document, with its ``directory``, out of those of its container and others
    (``file`` is the column of a node's own path): the first rootfile of the package's media type names it, else the first.
    ``parts``: as in ``contents``."""
    book = Window.partitionBy(*keys)
    asked = (F.col(file) == "META-INF/container.xml") & (F.col("kind") == "element") & (F.col("name") == "rootfile")
    other = F.coalesce(attribute("media-type") != PACKAGE_TYPE, F.lit(True))
    rows = nodes.withColumn("_asked", F.when(asked, F.struct(other.alias("other"), "pre", attribute("full-path").alias("path"))))
    rows = rows.repartition(parts, *keys) if parts else rows
    best = F.min("_asked").over(book)
    found = rows.withColumn("_package", best["path"]).filter((F.col(file) == F.col("_package")) & (F.col("_package") != "")).drop("_package", "_asked")
    return found.withColumn("directory", directory_column(F.col(file)))


def _listed(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The children ``item`` and ``itemref`` of the first manifest and the first spine of package nodes."""
    book = Window.partitionBy(*keys)
    first = lambda name: F.min(F.when((F.col("depth") == 2) & (F.col("above") == "package") & (F.col("name") == name), F.col("pre"))).over(book)
    rows = nodes.filter("kind = 'element'").withColumn("_manifest", first("manifest")).withColumn("_spine", first("spine"))
    return rows.filter("_manifest IS NOT NULL AND _spine IS NOT NULL").filter("name = 'item' AND parent = _manifest OR name = 'itemref' AND parent = _spine")


def spine(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section_index, section_id, linear, path, media_type, properties, fallback): the reading order of package
    nodes. Items need an id and a reference, the last of equal ids counts; a repeated reference counts once, one without an
    item not at all; items that are not referred to have no section_index. Items and references meet by their id in one
    aggregation."""
    item = (F.col("name") == "item") & attribute("href").isNotNull()
    properties = F.filter(F.split(F.coalesce(attribute("properties"), F.lit("")), r"[ \t\n\r]+"), lambda p: p != "")
    fields = F.struct(
        F.col("pre"), resolved_path(F.col("directory"), attribute("href")).alias("path"), F.coalesce(attribute("media-type"), F.lit(OCTETS)).alias("media_type"),
        properties.alias("properties"), attribute("fallback").alias("fallback"),
    )
    linear = F.coalesce(attribute("linear"), F.lit("")) != "no"
    rows = _listed(nodes, keys).withColumn("id", F.when(F.col("name") == "item", attribute("id")).otherwise(attribute("idref"))).filter("id IS NOT NULL")
    both = rows.groupBy(*keys, "id").agg(F.max(F.when(item, fields)).alias("item"), F.min(F.when(F.col("name") == "itemref", F.struct("pre", linear.alias("linear")))).alias("ref")).filter("item IS NOT NULL")
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("ref.pre"))
    index = F.when(F.col("ref").isNotNull(), F.row_number().over(order) - 1)
    return both.select(*keys, index.alias("section_index"), F.col("id").alias("section_id"), F.col("ref.linear").alias("linear"), *[f"item.{c}" for c in ("path", "media_type", "properties", "fallback")])


def _target(path: str) -> list[Column]:
    """href, target and fragment of a link (column ``href``) of the document at ``path``."""
    own = F.startswith("href", F.lit("#"))
    target = F.when(own, F.col(path)).otherwise(resolved_path(directory_column(F.col(path)), F.col("href")))
    return [F.col("href"), target.alias("target"), _fragment(F.col("href")).alias("fragment")]


def references(pages: DataFrame, keys: list[str], path: str) -> DataFrame:
    """(keys, pre, href, target, fragment): the links of pages' nodes, resolved from the page's own path (a column)."""
    links = pages.filter("kind = 'element' AND name = 'a'").withColumn("href", attribute("href")).filter("href IS NOT NULL")
    return links.select(*keys, *([path] if path not in keys else []), "pre", *_target(path))


def _fragment(href: Column) -> Column:
    part = F.expr("substring(href, instr(href, '#') + 1)")
    fine = F.coalesce(part.contains("%") & ~part.rlike("%(?![0-9a-fA-F]{2})"), F.lit(False))
    return F.when(F.contains(href, F.lit("#")), F.when(fine & ~F.startswith(href, F.lit("#")), F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)).otherwise(part))


def contents(nodes: DataFrame, sections: DataFrame, keys: list[str], path: str, parts: int | None = None) -> DataFrame:
    """(keys, node_id, parent_id, depth, label, section_id, fragment): the table of contents of navigation documents,
    in preorder. ``path`` is the column of the document's own path, ``sections`` are (keys, path, section_id).

    The list is that of the first nav typed ``toc``, else of the first nav with a list. An entry is a list item whose way up
    to that list leads over first lists of items only. Its label is its first link, else its first span, else its own
    text. One without a section takes that of its first entry within; one without any is left out. ``parts``: to so many
    tasks nodes are dealt, once their attributes are read (what Python has seen counts as dealt by no key)."""
    rows = nodes.withColumn("_type", attribute("type")).withColumn("_href", attribute("href")).drop("attributes")
    rows = rows.repartition(parts, *keys) if parts else rows
    book, siblings = Window.partitionBy(*keys), Window.partitionBy(*keys, "parent")
    is_ = lambda name: F.col("name") == name
    first = lambda condition, over=book: F.min(F.when(condition, F.col("pre"))).over(over)
    typed = F.array_contains(F.split(F.coalesce("_type", F.lit("")), r"[ \t\n\r]+"), "toc")
    rows = first_within(rows, keys, is_("ol"), "_list")
    rows = rows.withColumn("_nav", F.coalesce(first(is_("nav") & typed), first(is_("nav") & F.col("_list").isNotNull())))
    rows = rows.withColumn("_start", F.coalesce(first(is_("ol") & (F.col("parent") == F.col("_nav"))), F.max(F.when(F.col("pre") == F.col("_nav"), F.col("_list"))).over(book)))
    rows = rows.withColumn("_stop", F.max(F.when(F.col("pre") == F.col("_start"), F.col("post"))).over(book)).filter("pre BETWEEN _start AND _stop")
    for name in ("ol", "a", "span"):
        rows = rows.withColumn(f"_{name}", first(is_(name), siblings))
    right = (F.col("pre") == F.col("_start")) | is_("li") & (F.col("above") == "ol") | is_("ol") & (F.col("above") == "li") & (F.col("pre") == F.col("_ol"))
    rows = rows.withColumn("_right", F.coalesce(right, F.lit(False)))
    rows = enclosing(rows, keys, (F.col("kind") == "element") & ~F.col("_right"), "_wrong")
    rows = rows.withColumn("_is", F.coalesce(F.col("_right") & is_("li") & F.col("_wrong").isNull(), F.lit(False)))
    rows = enclosing(rows, keys, F.col("_is"), "_in_entry")
    named = (F.col("parent") == F.col("_in_entry")) & (F.col("pre") == F.coalesce("_a", "_span")) & (is_("a") | is_("span"))
    rows = enclosing(rows.withColumn("_source", F.coalesce(named, F.lit(False))), keys, F.col("_source"), "_in_source")
    text = F.when(F.col("kind") == "text", F.struct("pre", "value"))
    href = F.max(F.when(F.col("_source") & is_("a"), F.col("_href")))
    entries = rows.groupBy(*keys, path, F.when(F.col("_is"), F.col("pre")).otherwise(F.col("_in_entry")).alias("_own")).agg(
        F.max(F.when(F.col("_is"), F.struct("pre", "post"))).alias("span"), F.max("_source").alias("_named"), href.alias("href"),
        _joined(F.when(F.col("_in_source").isNotNull(), text)).alias("_deep"), _joined(F.when(F.col("parent") == F.col("_in_entry"), text)).alias("_direct"),
    ).filter("_own IS NOT NULL")
    entries = entries.select(*keys, F.col("span.pre").alias("pre"), F.col("span.post").alias("post"), C.collapse(F.when(F.col("_named"), F.col("_deep")).otherwise(F.col("_direct"))).alias("label"), *_target(path))
    entries = entries.join(sections.select(*keys, F.col("path").alias("target"), F.col("section_id").alias("own")), [*keys, "target"], "left")
    known = first_within(entries, keys, F.col("own").isNotNull(), "section_id", "own").filter("section_id IS NOT NULL")
    known = known.withColumn("node_id", F.row_number().over(book.orderBy("pre")) - 1)
    out = enclosing(known, keys, F.lit(True), "parent_id", "node_id", "depth")
    return out.select(*keys, "node_id", "parent_id", F.col("depth").cast("int").alias("depth"), "label", "section_id", F.when(F.col("own").isNotNull(), F.col("fragment")).alias("fragment"))
