"""License windows against SQL on wrapped, scattered and edited notices; units of the mix with maps and variants."""

import random
from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from quire.llm import licenses, mixing


def texts():
    rng = random.Random(2)
    filler = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    wrap = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    out = [None, "", "the of in to", "license " * 500]
    for notice, _ in licenses.TEMPLATES:
        words = notice.split(" ")
        out += [notice, notice.upper(), wrap(words, 4), " ".join(filler(700) + words + filler(700)), wrap(filler(300) + words + filler(50), 9)]
        scattered = filler(3000)
        for at, word in zip(rng.sample(range(3000), len(words)), words):
            scattered[at] = word
        out += [" ".join(scattered), wrap(scattered, 12)]
        for share in (0.1, 0.2, 0.4):
            edited = [w if rng.random() > share else f"x{rng.randrange(9)}" for w in words]
            out += [" ".join(edited), wrap(filler(20) + edited, 6)]
        spread = [x for w in words for x in ([w, "pad"] if rng.random() < 0.15 else [w])]
        out += [wrap(spread, 7), " ".join(words[: len(words) // 2] + filler(3) + words[len(words) // 2 :])]
    return out


def test_windows_equal_sql(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    found = con.execute(licenses.ORACLE)
    names = [c[0] for c in found.description]
    got = {r.doc_id: r for r in licenses.scan(df).select(*names).collect()}
    want = {r[0]: r for r in found.fetchall()}
    assert {k: tuple(v) for k, v in got.items()} == want
    assert sum(r.score > 0 for r in got.values()) > 50


def test_wrapping_changes_nothing(spark):
    rows = [(i, k, t) for i, t in enumerate(texts()) if t for k, t in enumerate((t, t.replace("\n", " "), t.replace(" ", "\n")))]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "id long, form long, text string")).collect():
        got.setdefault(r.id, set()).add((r.labels, r.score))
    assert all(len(x) == 1 for x in got.values())


def test_whole_license_texts_are_parameters(spark):
    rng = random.Random(3)
    long_text = " ".join(f"clause{rng.randrange(900)}" for _ in range(2500))
    df = spark.createDataFrame([(1, "before " + long_text.replace(" ", "\n") + " after"), (2, long_text[: len(long_text) // 2])], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df, templates=((long_text, "long"),)).collect()}
    assert got == {1: "long", 2: ""}


def test_units_differ_by_maps_and_variants(spark):
    rows = [(1, "a b", "s", {"x": "1"}, '{"k": 1}', [{"y": 1}]), (1, "a b", "s", {"x": "2"}, '{"k": 1}', [{"y": 1}]), (1, "a b", "s", {"x": "1"}, '{"k": 2}', [{"y": 1}]), (1, "a b", "s", {"x": "1"}, '{"k": 1}', [{"y": 2}])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,string>, j string, n array<map<string,int>>")
    df = df.withColumn("v", F.parse_json("j"))
    out = mixing.mix(df, weights=(1,), cap=1)
    show = lambda d: Counter(map(str, d.select("doc_id", "m", "j", "n", F.to_json("v").alias("v")).collect()))
    assert show(out) == show(df)
