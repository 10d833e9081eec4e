"""URL filters: host-suffix and path-prefix expressions meet rules by short hash prefix, then by full digest.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path
follows up to ``?``, ``#`` or the end; a url that is null or has no ``://`` has both empty. A rule (host, path,
verdict) fits its host and all subdomains of it where the url's path starts with the rule's. Each distinct
(host, path) is expanded into the suffixes of its host of as many labels as some rule's host has, joined with the
prefixes of its path of those lengths that some rule has, so a host of any number of labels gives no more expressions
than rules have shapes. Expressions meet rules by an equi-join on the first 8 hex digits of their
SHA-256, then the whole digest is confirmed, and the longest fitting rule wins (of equals, block).

Distinct (host, path) pairs are made first, with map-side aggregation, so a url or host that holds a third of
all rows is expanded once. Rules are broadcast while there are at most ``BROADCAST_RULES``; beyond that both
sides shuffle on the hash prefix, where the rules' side has one row for a rule, so adaptive execution can split
a hot expression.

Cases: null and empty urls give empty host and path, no rule, and the default verdict. Hosts of thousands of labels
and very long paths cost what their length does. Repeated pages keep a row
each. Empty tables and an empty rule list work. Extra columns pass through; clashing names are renamed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
BROADCAST_RULES = 200_000
OUTPUTS = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as rows (rule, rule_verdict, size, plen, digest, short)."""
    entries = [F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v")) for h, p, v in rules]
    if not entries:
        entries = [F.struct(F.lit(None).cast("string").alias("h"), F.lit("").alias("p"), F.lit("").alias("v"))]
    t = spark.range(1).select(F.inline(F.array(*entries))).filter("h is not null")
    return hashed_rules(t)


def _labels(host: str) -> Column:
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def hashed_rules(rules: DataFrame) -> DataFrame:
    """From (h, p, v) rows of any number."""
    digest = F.sha2(F.concat("h", "p"), 256)
    return rules.select(
        F.concat("h", "p").alias("rule"), F.col("v").alias("rule_verdict"), F.length(F.concat("h", "p")).alias("rule_size"),
        F.length("p").alias("plen"), _labels("h").alias("labels"), digest.alias("rule_digest"), F.substring(digest, 1, 8).alias("short"),
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Pages with host, path, rule (host and path of the winning rule, or null) and verdict."""
    pages = flat.unclash(pages, OUTPUTS)
    keep = [f"`{c}`" for c in pages.columns]
    u = F.coalesce(F.col(url), F.lit(""))
    placed = pages.select(*keep, host_of(u).alias("host"), path_of(u).alias("path"))
    # At most one for each length of a path and number of labels.
    sizes, counts = ([r[0] for r in rules.select(c).distinct().collect()] for c in ("plen", "labels"))
    if rules.count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    suffixes = F.filter(F.array(*[F.when(_labels("host") >= k, F.substring_index("host", ".", -k)) for k in counts or [1]]), lambda s: s.isNotNull())
    fitting = F.filter(F.array(*[F.lit(x) for x in sizes] or [F.lit(0)]), lambda n: n <= F.length("path"))
    pairs = (
        placed.select("host", "path").distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", "suffix", F.explode(fitting).alias("n"))
        .select("host", "path", F.sha2(F.concat("suffix", F.expr("substring(path, 1, n)")), 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    best = F.max(F.struct("rule_size", F.col("rule_verdict") == "block", "rule", "rule_verdict"))
    found = (
        pairs.join(rules, "short").filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path").agg(best.alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
    )
    return placed.join(found, ["host", "path"], "left").select(
        *keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_LONGEST = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
ORACLE = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (
  SELECT *, CASE {' '.join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for h, p, _ in _LONGEST)} END AS rule FROM h)
SELECT page_id, host, path, rule,
       CASE {' '.join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in _LONGEST)} ELSE 'allow' END AS verdict
FROM r
"""
