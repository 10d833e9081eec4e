"""Catalyst expressions and Arrow-batched columns over the text kernels.

Everything that Spark's functions can say is built from them; the rest is one Arrow round trip for a column."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import markup, matching, positions, unicode

SPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

POSITION = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("section_id", T.StringType()), ("progress", T.DoubleType()), ("exact", T.StringType()), ("prefix", T.StringType()),
        ("suffix", T.StringType()), ("offset_g", T.IntegerType()), ("serialized", T.StringType()))]
)
SENTENCE = T.StructType([T.StructField("text", T.StringType()), *POSITION.fields])
HIT = T.StructType(
    [T.StructField("hit_ord", T.IntegerType()), T.StructField("start_u16", T.IntegerType()), T.StructField("text", T.StringType()),
     T.StructField("context", T.StringType()), T.StructField("section_index", T.IntegerType()), *POSITION.fields]
)
RESOLVED = T.StructType([T.StructField("offset_g", T.IntegerType()), T.StructField("length_g", T.IntegerType())])
PARSED = T.StructType([T.StructField("position", POSITION), T.StructField("error", T.StringType())])


#: Rows, and Arrow bytes of them, that are Python objects at a time: a position or a place takes some hundred times its bytes.
SLICE_ROWS, SLICE_BYTES = 256, 256 << 10


#: Arrow bytes of a batch on its way to Python and back, whatever a session's count of rows for one.
BATCH = "4m"


def bounded(spark):
    """The session, whose Arrow batches are bounded in bytes: by rows alone a batch grows with its partition."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return spark


def slices(columns):
    """(first row, rows) of the parts of a batch that become Python objects together."""
    rows = len(columns[0])
    size = sum(c.nbytes for c in columns)
    many = max(1, min(SLICE_ROWS, rows * SLICE_BYTES // max(size, 1)))
    return ((lo, min(many, rows - lo)) for lo in range(0, rows, many))


def kernel(function, returns: T.DataType):
    """A column function from a Python function of one row's values: one Arrow batch in, one out; a null in the first
    argument gives null. Only a slice of the batch is Python objects at a time, its results go to Arrow before the next."""
    kind = to_arrow_type(returns)

    def part(rows) -> pa.Array:
        return pa.array([None if r[0] is None else function(*r) for r in rows], kind)

    def run(*columns: pa.Array) -> pa.Array:
        out = [part(zip(*[c.slice(lo, n).to_pylist() for c in columns])) for lo, n in slices(columns)]
        return out[0] if len(out) == 1 else pa.concat_arrays(out) if out else part([])

    return F.arrow_udf(run, returns)


reading_text = kernel(markup.reading_text, T.StringType())
fold = kernel(unicode.fold, T.StringType())
decode_entities = kernel(markup.decode_entities, T.StringType())
sentences = kernel(lambda text, section: positions.sentences(text, section or ""), T.ArrayType(SENTENCE))
search = kernel(lambda text, query, section, index, most: matching.search(text, query or "", section or "", index or 0, most=most), T.ArrayType(HIT))
search_places = kernel(lambda text, query, most: matching.search(text, query or "", "", 0, most=most, bare=True), T.ArrayType(T.StructType(HIT.fields[:3])))
parse_position = kernel(lambda s: dict(zip(("position", "error"), positions.parse(s))), PARSED)
sentence_count = kernel(lambda text: len(unicode.sentence_runs(text, in_words=False)), T.LongType())
_utf16_text = kernel(lambda data: bytes(data[2:]).decode("utf-16-le" if data[:1] == b"\xff" else "utf-16-be", "replace"), T.StringType())
grapheme_count = kernel(lambda text: len(unicode.Units(text).parts), T.LongType())


def _capture(text, offsets, section):
    units = unicode.Units(text)
    return [positions.capture(units, o, section or "") for o in offsets or []]


def _resolve(text, places):
    units = unicode.Units(text)
    out = []
    for p in places or []:
        found = positions.resolve(units, p["exact"], p["prefix"], p["suffix"], p["offset_g"])
        out.append(None if found is None else {"offset_g": found[0], "length_g": found[1]})
    return out


#: All positions of a text at once: it is cut into graphemes once, however many offsets are asked for.
capture_all = kernel(_capture, T.ArrayType(POSITION))
resolve_all = kernel(_resolve, T.ArrayType(RESOLVED))


def section_text(content: Column) -> Column:
    """Text of a section's bytes: UTF-16 by its byte-order mark (the only rows that Python sees), else UTF-8 with
    malformed bytes replaced and its mark dropped."""
    wide = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    plain = F.make_valid_utf8(content.cast("string"))
    return F.when(wide, _utf16_text(F.when(wide, content))).otherwise(F.regexp_replace(plain, "^\ufeff", ""))


def u16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


_nfkc = kernel(lambda text: unicodedata.normalize("NFKC", text), T.StringType())


def beyond_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7f]")


def nfkc(text: Column) -> Column:
    """The compatibility form; Python sees only the rows that are not ASCII."""
    return F.when(beyond_ascii(text), _nfkc(F.when(beyond_ascii(text), text))).otherwise(text)


def may_hold(text: Column, query: str) -> Column:
    """False only for ASCII texts without the folded query, which the JVM alone can tell."""
    folded = F.regexp_replace(F.lower(text), r"[\t-\r ]+", " ")
    return beyond_ascii(text) | F.contains(folded, F.lit(unicode.fold(query)))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def escape_text(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(text: Column) -> Column:
    return F.replace(escape_text(text), F.lit('"'), F.lit("&quot;"))


def graphemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\X)"), F.lit(1))


def first_grapheme_at(starts: Column, offset: Column) -> Column:
    """Position of the first start at or after an offset (forward as-of on an array in the row)."""
    return F.size(F.filter(starts, lambda s: s < offset))


def last_at(starts: Column, offset: Column) -> Column:
    """The greatest start that is not beyond an offset (backward as-of)."""
    return F.array_max(F.filter(starts, lambda s: s <= offset))


def reference_value(reference: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(reference, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def reference_kind(reference: Column) -> Column:
    v = reference_value(reference)
    return F.when(v == "", "empty").when(F.startswith(v, F.lit("#")), "fragment").when(v.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), "scheme").otherwise("relative")


def reference_scheme(reference: Column) -> Column:
    found = F.regexp_extract(reference_value(reference), r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    return F.when(reference_kind(reference) == "scheme", F.lower(found))


def reference_allowed(element: Column, attribute: Column, kind: Column, scheme: Column) -> Column:
    media = (attribute == "src") | ((element == "image") & (attribute == "href")) | (element == "link")
    return (
        F.when(element == "use", kind == "fragment")
        .when(kind == "fragment", element == "a")
        .when(kind == "relative", F.lit(True))
        .when((kind != "scheme") | scheme.isNull(), F.lit(False))
        .when(media, scheme.isin("data", "http", "https"))
        .otherwise(scheme.isin("http", "https", "mailto", "tel"))
    )


#: Words that open a heading.
HEADING_WORDS = "chapter|book|part|canto|letter|volume|section|prologue|epilogue|introduction|preface|foreword|afterword"


def blocks(text: Column) -> Column:
    """Blocks of plain text: parted by blank lines, trimmed, none empty."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n+"), lambda b: trim(b)), lambda b: b != "")


def is_heading(block: Column) -> Column:
    size = u16_length(block)
    capitals = block.rlike("[A-Z]") & ~block.rlike("[a-z]") & (size <= 48)
    return ~F.contains(block, F.lit("\n")) & (size > 0) & (size <= 60) & (block.rlike(rf"(?i)^({HEADING_WORDS})\b") | capitals)


def metadata_field(text: Column, name: str) -> Column:
    """A ``Name: value`` line of the first 4000 characters; null without one."""
    head = F.substring(text, 1, 4000)
    return F.when(head.rlike(rf"(?im)^{name}:\s*(.+)$"), collapse(F.regexp_extract(head, rf"(?im)^{name}:\s*(.+)$", 1)))


def banner_field(text: Column, group: int) -> Column:
    pattern = r"(?i)Project Gutenberg eBook of\s+(.+?)(?:,\s*by\s+(.+?))?[\r\n]"
    found = F.regexp_extract(F.substring(text, 1, 4000), pattern, group)
    return F.when(found != "", collapse(found))
