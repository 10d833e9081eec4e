"""License scans: an exact set-similarity join of text blocks with license templates. DataFrame functions only.

A text is lower-cased (A-Z); its words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Base: places where the words of
a phrase stand consecutively. Method: a block (a window of consecutive words of the text, wherever its lines end, as
long as the template's words over ``threshold``) holds a template when at least ``threshold`` of the template's
distinct words occur in it. The rule is the same for every text: how it is wrapped changes nothing, and words that are
scattered over a long line hold nothing. Windows are tried in texts that as a whole would hold the template. Words are ordered by document frequency over all documents, rarest first;
a template that needs ``need`` of its ``size`` words must share one of its rarest ``size - need + 1`` with the
text (prefix filter), the text must have ``need`` distinct words (length filter), and the words after the
shared one must suffice on both sides (positional filter). What is left is verified on the whole sets, so the
join is exact.

Only the templates' own words are broadcast or collected, with their counts; that is a parameter of the call and
is checked against ``MAX_TEMPLATE_WORDS``. One pass over the texts cuts them into words, counts those of the templates,
finds the phrases, and keeps the text only where it as a whole has enough of some template's words. Found (text,
template) pairs return to documents by a 128-bit hash of the text, with one row for a text, so a text that a third
of all rows share meets one row.

Cases: null and empty texts have no words, no labels and score 0. Repeated rows keep a row each. An empty table
gives no rows. Extra columns pass through ``scan``; clashing names are renamed.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .decontaminate import _SQL_WORDS, WORD, lowered

#: Phrases and labels of the base.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices that public licenses ask to be put into works, and their labels.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)
THRESHOLD = 0.85
MAX_TEMPLATE_WORDS = 20_000
OUTPUTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sets(templates) -> list[tuple[int, str, list[str]]]:
    found = [(k, label, sorted(set(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text)))) for k, (text, label) in enumerate(templates)]
    if sum(len(w) for _, _, w in found) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words; scan in several calls")
    return [x for x in found if x[2]]


def _need(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _places(w: Column, phrase: str) -> Column:
    """Starts of the phrase's words in the word array."""
    first, *more = phrase.split(" ")

    def at(x, i):
        same = x == first
        for k, word in enumerate(more, 1):
            same &= F.coalesce(F.get(w, i + k) == word, F.lit(False))
        return F.when(same, i)

    return F.filter(F.transform(w, at), lambda i: i.isNotNull())


def _literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words] or [F.lit(None).cast("string")])


def _span(text: str, threshold: float) -> int:
    """Words of a window: a notice stands in one even if so many words that are not its own are among its words."""
    return math.ceil(len(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text)) / threshold - 1e-9)


def similar_blocks(texts: DataFrame, counts: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD, key=("k1", "k2")) -> DataFrame:
    """(key, label, containment): for each text (key, line) and label the best containment of a template in a window of
    it, of all pairs that reach the threshold. ``counts`` are the words' document frequencies."""
    spark, sets = texts.sparkSession, _sets(templates)
    vocabulary = sorted({w for _, _, ws in sets for w in ws})
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    rows, prefix, least = [], set(), []
    for k, label, ws in sets:
        ws = sorted(ws, key=rank.get)
        need = _need(len(ws), threshold)
        least.append(need)
        prefix.update(ws[: len(ws) - need + 1])
        rows += [F.struct(F.lit(w).alias("word"), F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(len(ws) - 1 - i).alias("after"), F.lit(need).alias("need"), F.lit(_span(templates[k][0], threshold)).alias("span"), _literal(ws).alias("set")) for i, w in enumerate(ws[: len(ws) - need + 1])]
    if not rows:
        return texts.select(*key, F.lit("").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    index = F.broadcast(spark.range(1).select(F.inline(F.array(*rows))))
    # What is exploded from an array of one is computed once; a filter on it would else compute it again.
    cut = texts.select(*key, F.explode(F.array(words_of("line"))).alias("w")).filter((F.size("w") >= min(least)) & F.arrays_overlap("w", _literal(sorted(prefix))))
    cut = cut.select(*key, "w", F.size(F.array_distinct("w")).alias("size"), F.array_intersect(_literal(order), F.col("w")).alias("own"))
    wide = (
        cut.select(*key, "w", "size", "own", F.posexplode("own").alias("at", "word"))
        .join(index, "word")
        .filter(F.col("size") >= F.col("need"))
        .filter(1 + F.least(F.col("after"), F.size("own") - F.col("at") - 1) >= F.col("need"))
        .filter(F.size(F.array_intersect("own", "set")) >= F.col("need"))
        .dropDuplicates([*key, "template"])
    )
    places = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda o: F.array_contains("set", o["x"]))
    wide = wide.select(*key, "label", "need", "span", "set", F.explode(F.array(places)).alias("o"))
    # A window begins at a word of the template and has no more of them than words.
    inside = lambda s, j: F.filter(F.slice("o", j + 1, F.col("span")), lambda o: o["i"] < s["i"] + F.col("span"))
    most = F.array_max(F.transform("o", lambda s, j: F.size(F.array_distinct(F.transform(inside(s, j), lambda o: o["x"])))))
    wide = wide.select(*key, "label", "set", "need", F.explode(F.array(most)).alias("overlap")).filter(F.col("overlap") >= F.col("need"))
    best = F.max(F.col("overlap").cast("double") / F.size("set"))
    return wide.groupBy(*key, "label").agg(best.alias("containment"))


def words_of(column: str) -> Column:
    return F.regexp_extract_all(lowered(F.col(column)), F.lit(WORD), F.lit(0))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with n_words, n_base, first_word, last_word, base_labels, labels and score (1 with a base
    phrase, else the best containment found, else 0)."""
    docs = flat.unclash(docs, (*OUTPUTS, "k1", "k2", "__w", "__t", "__own", "__p", "__base"))
    keep = docs.columns if keep is None else keep
    kept, sets = [f"`{c}`" for c in keep], _sets(templates)
    vocabulary = sorted({w for _, _, ws in sets for w in ws} | {w for p, _ in phrases for w in p.split(" ")})
    # One pass cuts every text into words; only what may hold a template keeps its text.
    cut = docs.select(*kept, *flat.text_key(F.col(text)), F.col(text).alias("__t"), words_of(text).alias("__w"))
    cut = cut.withColumn("__own", F.array_intersect(_literal(vocabulary), F.col("__w")))
    may = F.lit(False)
    for _, _, ws in sets:
        may |= F.size(F.array_intersect("__own", _literal(ws))) >= _need(len(ws), threshold)
    none = F.array().cast("array<int>")
    stands = lambda p: F.size(F.array_intersect("__own", _literal(sorted(set(p.split(" ")))))) == len(set(p.split(" ")))
    places = F.struct(*[F.when(stands(p), _places(F.col("__w"), p)).otherwise(none).alias(f"p{k}") for k, (p, _) in enumerate(phrases)])
    cut = flat.saved(cut.select(*kept, "k1", "k2", F.size("__w").cast("long").alias("n_words"), "__own", places.alias("__p"), F.when(may, F.col("__t")).alias("__t")))
    counts = {r.w: r["count"] for r in cut.select(F.explode("__own").alias("w")).groupBy("w").count().collect()}  # one row for each word of the templates
    some = cut.filter(F.col("__t").isNotNull()).groupBy("k1", "k2").agg(F.first("__t").alias("line"))
    found = similar_blocks(some, counts, templates, threshold)
    found = found.groupBy("k1", "k2").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    each = [F.col(f"__p.p{k}") for k in range(len(phrases))]
    all_ = F.concat(*each)
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(x) > 0, F.lit(label)) for x, (_, label) in zip(each, phrases)]), lambda x: x.isNotNull())))
    held = cut.select(
        *kept, "k1", "k2", "n_words", F.size(all_).cast("long").alias("n_base"),
        F.array_min(all_).cast("long").alias("first_word"), F.array_max(all_).cast("long").alias("last_word"), base.alias("__base"),
    )
    labels = F.array_sort(F.array_union("__base", F.coalesce("found", F.array().cast("array<string>"))))
    return held.join(found, ["k1", "k2"], "left").select(
        *kept, "n_words", "n_base", "first_word", "last_word",
        F.array_join("__base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, keep=["doc_id"])


_PHRASE_ROWS = ", ".join(f"({[*p.split(' ')]}, '{label}')" for p, label in PHRASES)
_TEMPLATE_ROWS = ", ".join(f"({k}, {ws}, '{label}', {_need(len(ws), THRESHOLD)}, {_span(TEMPLATES[k][0], THRESHOLD)})" for k, label, ws in _sets(TEMPLATES))
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body, {_SQL_WORDS} AS w FROM documents),
phrase(words, label) AS (VALUES {_PHRASE_ROWS}),
place AS (
  SELECT rid, label, i - 1 AS pos FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d), phrase
  WHERE w[i : i + len(words) - 1] = words),
base AS (
  SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY rid),
template(tid, words, label, need, span) AS (VALUES {_TEMPLATE_ROWS}),
may AS (SELECT rid, tid, label, need, span, words, w FROM d, template WHERE len(list_intersect(words, list_distinct(w))) >= need),
own AS (SELECT rid, tid, label, need, span, len(words) AS size, words, i, w[i] AS x FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM may) WHERE list_contains(words, w[i])),
held AS (
  SELECT rid, label, CAST(max(n) AS DOUBLE) / any_value(size) AS c
  FROM (SELECT rid, tid, label, need, size, count(DISTINCT x) OVER (PARTITION BY rid, tid ORDER BY i RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING) AS n FROM own)
  WHERE n >= need GROUP BY rid, tid, label),
lab AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label FROM held UNION SELECT rid, label FROM place) GROUP BY rid),
best AS (SELECT rid, max(c) AS c FROM held GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN lab USING (rid) LEFT JOIN best USING (rid)
"""
