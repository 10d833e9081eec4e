"""Archives read by ranges: what is read, splits, pushed filters, faults; archives written by the sink."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.plans import fixtures
from quire.sources import decode as D
from quire.sources import ranges as R
from quire.sources.archive import Archive


@pytest.fixture()
def pushing(spark):
    spark.conf.set(R.PUSHDOWN, "true")
    yield spark
    spark.conf.unset(R.PUSHDOWN)


def bodies():
    return [(f"d{k % 3}/e{k}.bin", bytes([k]) * 50_000) for k in range(30)] + [("twice", b"first"), ("twice", b"second"), ("empty", b"")]


def rows(df):
    return sorted((r.name, r.first, bytes(r.content)) for r in df.collect())


def test_entries_over_splits_equal_the_archive(spark, tmp_path):
    data = fixtures.archive(bodies(), tuple(n for n, _ in bodies()))
    (tmp_path / "big.zip").write_bytes(data)
    (tmp_path / "_hidden.zip").write_bytes(b"no")
    want = sorted((n, n != "twice" or b == b"first", b) for n, b in bodies())
    for split in (1 << 30, 100_000, 7_000):
        df = R.read_archives(spark, str(tmp_path), split=split)
        assert df.rdd.getNumPartitions() == max(1, -(-len(data) // split))
        assert rows(df) == want
    listed = R.read_archives(spark, str(tmp_path / "big.zip"), content="false").collect()
    assert all(r.content is None and r.bytes_read == 0 for r in listed) and len(listed) == len(want)


@pytest.mark.parametrize(
    ("condition", "fits"),
    [
        ("name = 'd1/e4.bin'", lambda n: n == "d1/e4.bin"), ("name IN ('d0/e3.bin', 'empty')", lambda n: n in ("d0/e3.bin", "empty")), ("name LIKE 'd2/%'", lambda n: n.startswith("d2/")),
        ("name LIKE '%9.bin' AND first", lambda n: n.endswith("9.bin")), ("name LIKE '%/e1%'", lambda n: "/e1" in n), ("name = 'twice' AND first = true", lambda n: n == "twice"),
    ],
)
def test_filters_reach_the_source(pushing, tmp_path, condition, fits):
    data = fixtures.archive(bodies(), tuple(n for n, _ in bodies()))
    (tmp_path / "big.zip").write_bytes(data)
    found = R.read_archives(pushing, str(tmp_path)).filter(condition).collect()
    want = {n: b for n, b in reversed(bodies()) if fits(n)}
    assert {r.name: bytes(r.content) for r in found} == want
    assert sum(r.bytes_read for r in found) + found[0].directory_bytes < 30 * (len(want) + 100) + sum(map(len, want.values())) + 4096
    if len(want) == 1:
        assert found[0].bytes_read + found[0].directory_bytes < len(data) / 10


def test_faults_are_rows(spark, tmp_path):
    good = b"some words " * 400
    hard = {
        "flip": fixtures.raw_archive([{"name": "a", "body": good, "crc": 1}, {"name": "b", "body": good}]), "locked": fixtures.raw_archive([{"name": "a", "body": good, "flags": 1}]),
        "method": fixtures.raw_archive([{"name": "a", "body": good, "method": 12}]), "bomb": fixtures.raw_archive([{"name": "a", "body": good * 100, "size": 100}]),
        "comment": fixtures.raw_archive([{"name": "a", "body": good}], comment=b"c" * 60_000), "no": b"not an archive at all", "short": b"PK", "cut": fixtures.raw_archive([{"name": "a", "body": good}])[:-5], "void": b"",
    }
    for name, data in hard.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    found = {(r.path.rsplit("/", 1)[1][:-4], r.name): r.error for r in R.read_archives(spark, str(tmp_path), split=500).collect()}
    assert found == {
        ("flip", "a"): "corrupt", ("flip", "b"): None, ("locked", "a"): "encrypted", ("method", "a"): "unsupported", ("bomb", "a"): "corrupt", ("comment", "a"): None,
        ("no", None): "format", ("short", None): "format", ("cut", None): "format", ("void", None): "format",
    }


def test_zip64_by_ranges(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z, z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as f:
        f.write(b"x" * 1000)
    (tmp_path / "wide.zip").write_bytes(out.getvalue())
    assert [(r.name, len(r.content), r.error) for r in R.read_archives(spark, str(tmp_path)).collect()] == [("wide", 1000, None)]


@pytest.mark.parametrize("compression", ["none", "deflate"])
def test_written_archives_are_read_again(spark, tmp_path, compression):
    made = [("x", f"n{k}", b"b" * k) for k in range(40)] + [("y é", "n", None), ("y é", None, b"1"), ("y é", "ü", b"2")]
    df = spark.createDataFrame([(a, n, None if b is None else bytearray(b)) for a, n, b in made], "archive string, name string, content binary").repartition(5)
    R.write_archives(df, str(tmp_path / "out"), compression=compression)
    files = sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "out").iterdir())
    assert files == ["x", "y é"]
    back = R.read_archives(spark, str(tmp_path / "out"))
    assert sorted((r.name, bytes(r.content)) for r in back.collect()) == sorted((n, b) for _, n, b in made if n is not None and b is not None)
    whole = Archive((tmp_path / "out" / next(p.name for p in (tmp_path / "out").iterdir() if p.name[0] == "x")).read_bytes())
    assert len(whole.entries) == 40


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    broken = F.when(F.col("k") == 3, F.raise_error(F.lit("lost"))).otherwise(F.lit("n"))
    df = spark.range(4).toDF("k").select(F.lit("a").alias("archive"), broken.cast("string").alias("name"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="lost"):
        R.write_archives(df, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()] if (tmp_path / "out").exists() else True


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert R.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_formats_can_be_added(spark):
    D.register_format("shout", lambda data: data[:1] == b"!", lambda data: {"title": data[1:].decode()})
    try:
        df = spark.createDataFrame([(1, bytearray(b"!hey")), (2, bytearray(fixtures.epub())), (3, bytearray(b"?"))], "id long, content binary")
        found = D.read_books(df, formats=("shout", "epub")).orderBy("id").collect()
        assert [(r.format, r.title, r.error and r.error.kind) for r in found] == [("shout", "hey", None), ("epub", "The Small Lamp", None), (None, None, "UnrecognizedFormat")]
        with pytest.raises(KeyError):
            D.read_books(df, formats=("unknown",))
    finally:
        D.FORMATS.pop("shout")
