"""Vectorised kernels over the flat byte buffers of Arrow string columns.

A batch of texts reaches Python as one byte buffer with offsets. The kernels cut it into blocks of at most
``BLOCK`` bytes (a longer text is a block of its own), so the temporary arrays of a task stay bounded whatever
the batch holds. Hashes are 64-bit polynomials modulo 2**64 over random byte codes, finished by a mixer; they
depend only on content, so they agree between tasks, runs and input sizes.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 20
#: Blocks of kernels that hold many arrays of eight bytes for each byte of text.
SMALL_BLOCK = 1 << 18
#: Arrow batches of at most so many bytes: a task holds a batch in the JVM and in Python.
BATCH = "4m"
pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back to the system
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, _U(base & _MASK))
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a lower-cased text: digits, a-z and every byte of a
#: character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of the words [^\x20\x09-\x0D]+.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def text_blocks(column: pa.Array, max_bytes: int = BLOCK):
    """Yield (first row, bytes, offsets from 0) for runs of rows; nulls count as empty texts."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offs = offs[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """Starts, ends and document numbers of the maximal runs of bytes in ``table``, none across documents."""
    member = table[data]
    edges = offs[:-1][offs[:-1] < offs[1:]]
    first = member.copy()
    first[1:] &= ~member[:-1]
    first[edges] = member[edges]
    last = member.copy()
    last[:-1] &= ~member[1:]
    stops = offs[1:][offs[:-1] < offs[1:]] - 1
    last[stops] = member[stops]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(starts, offs)))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * _powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts, ends) -> np.ndarray:
    """Hash of data[start:end] for each pair."""
    ends, starts = np.asarray(ends), np.asarray(starts)
    h = (sums[ends] - sums[starts]) * _powers(len(sums))[1][starts]
    return mix(h + (ends - starts).astype(np.uint64))


def gram_hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive codes (the caller drops those that leave a document)."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    m = len(codes) - n + 1
    h = np.full(m, _U(n))
    for j in range(n):
        h *= _U(0xD6E8FEB86659FD93)
        h += codes[j : j + m]
    return mix(h)


def _order(codes: np.ndarray) -> np.ndarray:
    """The places of hashes in the order of their values. The places stand in the low bits of what is sorted, which is much
    faster than an indirect sort; where two hashes differ in those bits alone, the indirect sort decides."""
    if codes.dtype != np.uint64 or len(codes) < 256:
        return np.argsort(codes)
    low = _U((1 << (len(codes) - 1).bit_length()) - 1)
    mixed = codes & ~low
    mixed |= np.arange(len(codes), dtype=np.uint64)
    mixed.sort()
    order = (mixed & low).view(np.int64)
    ranked = codes[order]
    return np.argsort(codes) if (ranked[1:] < ranked[:-1]).any() else order


def distinct(codes: np.ndarray):
    """(sorted values, a place of each, number of each code's value, how often each occurs)."""
    order = _order(codes)
    ranked = codes[order]
    new = np.ones(len(codes), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    at = np.flatnonzero(new)
    number = np.empty(len(codes), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[at], order[at], number, np.diff(np.append(at, len(codes)))


def unclash(df: DataFrame, outputs) -> DataFrame:
    """The frame with every repeated column name, or one that an output has, made distinct (``name__2``).

    The first column of a name keeps it unless an output takes it, so extra columns never make a
    reference ambiguous."""
    taken, names = {x.lower() for x in outputs}, []
    for c in df.columns:
        name, k = c, 2
        while name.lower() in taken:
            name, k = f"{c}__{k}", k + 1
        taken.add(name.lower())
        names.append(name)
    return df if names == df.columns else df.toDF(*names)


def map_texts(df: DataFrame, text: str, fields: list[T.StructField], kernel, keep: list[str] | None = None) -> DataFrame:
    """Append ``fields``, which kernel() computes block by block, to the columns ``keep`` (all if None).

    ``kernel`` is called once in a task and returns a function (bytes, offsets) -> one Arrow array per field.
    One narrow stage: no shuffle, and a lost task is simply run again."""
    keep = df.columns if keep is None else keep
    shared_folder(df.sparkSession)
    need = [*keep, *([text] if text not in keep else [])]
    at, kept = need.index(text), len(keep)
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    names = [f.name for f in schema]

    def run(batches):
        work = kernel()
        for batch in batches:
            parts = [work(data, offs) for _, data, offs in text_blocks(batch.column(at))]
            if parts:
                new = [pa.concat_arrays([p[k] for p in parts]) for k in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *new], names=names)

    return df.select(*[f"`{c}`" for c in need]).mapInArrow(tidy(run), schema)


def per_doc(doc: np.ndarray, n: int, weights=None) -> np.ndarray:
    """Count, or sum of weights, of each of n documents."""
    return np.bincount(doc, weights, n)[:n] if len(doc) else np.zeros(n)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the number of values in each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def cut(data: np.ndarray, offs: np.ndarray, keep: np.ndarray):
    """Bytes and offsets that are left where ``keep`` is true."""
    left = np.concatenate([[0], np.cumsum(keep)])[offs]
    return data[keep], left


def binary_array(data: np.ndarray, offs: np.ndarray, kind=None) -> pa.Array:
    """An Arrow binary (or string) array over bytes and offsets."""
    buffers = [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]
    return pa.Array.from_buffers(kind or pa.binary(), len(offs) - 1, buffers)


def shared_folder(spark) -> str:
    """The checkpoint folder that the cluster shares (``spark.checkpoint.dir``). Only a local session without that setting,
    as in tests, gets one of its own; a cluster without it is an error, as its machines would write to their own disks."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir names no folder that the executors share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="quire-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def trim() -> None:
    """Freed memory of this Python process goes back to the system."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """The kernel, giving freed memory back after every few batches and at its end: workers outlive their tasks."""

    def inner(batches):
        for k, out in enumerate(run(batches)):
            yield out
            if k % 16 == 15:
                trim()
        trim()

    return inner


def trimmed(step):
    """The function of one or two tables, giving freed memory back after every few calls."""
    calls = []

    def counted():
        calls.append(1)
        if len(calls) % 4 == 0:
            trim()

    def one(table):
        out = step(table)
        counted()
        return out

    def two(left, right):
        out = step(left, right)
        counted()
        return out

    return two if step.__code__.co_argcount == 2 else one


def release(spark) -> None:
    """Let both runtimes drop what is no longer referenced, so that the shuffle files of finished steps are removed
    now and not at the driver's next collection."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


_SAVED: list[str] = []


def folder(spark) -> str:
    """A new path in the shared folder, removed like the tables of ``saved``."""
    path = f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}"
    if not _SAVED:
        atexit.register(remove, spark, _SAVED)
    _SAVED.append(path)
    return path


def saved(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The frame written as a table to the shared folder and read again: its lineage ends there, any executor may be
    lost, and (unlike a checkpoint, which keeps them referenced) the shuffle files behind it can go at once. The
    tables are removed when the process ends, or by ``remove``."""
    spark = df.sparkSession
    path = folder(spark)
    release(spark)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the table behind a frame that ``saved`` returned; nothing may read it any more."""
    _SAVED.remove(df._quire_path)
    remove(df.sparkSession, [df._quire_path])


def remove(spark, paths: list[str]) -> None:
    """Delete saved tables that nothing reads any more."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in paths:
            where = hadoop.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass
    paths.clear()


@contextlib.contextmanager
def stage(spark, before: list[str] = []):  # noqa: B006  the list is the memory of the last stage
    """Around a pipeline stage, whose input is written already: removes the tables that the last stage saved."""
    remove(spark, before)
    release(spark)
    seen = len(_SAVED)
    yield
    before.extend(_SAVED[seen:])


def text_key(text: Column) -> list[Column]:
    """k1, k2: two independently seeded 64-bit hashes of the text (null as empty)."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(7), body).alias("k2")]
