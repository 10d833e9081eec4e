"""A batch becomes Python objects a slice at a time."""

import gc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import columns as C
from quire.plans import queries


@pytest.mark.parametrize("size", [1, 2000])
def test_results_of_a_slice_are_arrow_before_the_next(spark, size):
    """No more of a batch's 3,000 results than a slice's are alive at once."""
    most = C.SLICE_ROWS if size == 1 else 2 * C.SLICE_BYTES // size

    def run(text):
        class Held(list):
            pass

        gc.disable()
        alive = run.__dict__.setdefault("alive", [])
        alive[:] = [r for r in alive if r() is not None]
        import weakref

        new = Held([len(alive)])
        alive.append(weakref.ref(new))
        return new

    df = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.lit("a" * size)).alias("t"))
    rows = df.select("id", C.kernel(run, T.ArrayType(T.LongType()))(F.col("t")).alias("n")).collect()
    assert [r.id for r in rows] == list(range(3000)) and all((r.n is None) == (r.id % 7 == 0) for r in rows)
    assert max(r.n[0] for r in rows if r.n) <= most


def test_no_rows_give_no_rows(spark):
    df = spark.range(0).select(C.fold(F.col("id").cast("string")).alias("t"))
    assert df.collect() == []


def test_batches_are_bounded_in_bytes(spark):
    """What a query's table sets holds for columns in Python: 4,000 rows of 10 KB come in batches of some MB, not in one."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    queries._table(spark, "/root/testdata/sf0.001", "documents")
    held = F.arrow_udf(lambda c: pa.array([c.nbytes] * len(c), pa.int64()), T.LongType())
    df = spark.range(0, 4000, 1, 1).select(F.concat(F.repeat(F.lit("a"), 10_000), F.col("id").cast("string")).alias("t"))
    assert df.select(F.max(held(F.col("t")))).first()[0] < 3 * (4 << 20)
