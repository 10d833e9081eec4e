"""ZIP archives as a Spark data source that reads ranges: the directory at a file's end, then only the chosen entries.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archives").load("hdfs://books").filter("name LIKE 'OPS/%' AND first")
    df.repartition("archive").sortWithinPartitions("archive", "name").write.format("archives").save("hdfs://books")

A partition is a byte range of an archive (or several small archives): it reads the directory and those entries whose
local header begins in its range, so one huge archive is many tasks and none opens more than it needs. Filters on ``name``
(equality, IN, prefix, suffix, part), ``path`` and ``first`` are pushed down where the session allows it
(``spark.sql.python.filterPushdown.enabled``); the scan then fetches no byte of other entries. ``bytes_read`` is what an entry cost, ``directory_bytes`` what finding it cost.

Files are reached through Arrow's file systems (local, hdfs, s3, gs). An archive that cannot be listed, or an entry that
cannot be read, is a row with ``error``; of equal names all are listed and the first has ``first``. Writing streams
entries into one archive a value of ``archive`` and task; files appear under their names when the job commits, and what a
failed attempt left is removed with the job's own folder."""

from __future__ import annotations

import atexit
import fnmatch
import posixpath
import tempfile
import uuid
import zipfile
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S

from .archive import ArchiveError, Counted, entries, read

SCHEMA = (
    "path string, archive_bytes bigint, ord int, name string, method int, encrypted boolean, crc32 bigint, compressed_size bigint, uncompressed_size bigint, "
    "first boolean, content binary, error string, bytes_read bigint, directory_bytes bigint"
)
_KINDS = {
    "path": pa.string(), "archive_bytes": pa.int64(), "ord": pa.int32(), "name": pa.string(), "method": pa.int32(), "encrypted": pa.bool_(), "crc32": pa.int64(), "compressed_size": pa.int64(),
    "uncompressed_size": pa.int64(), "first": pa.bool_(), "content": pa.binary(), "error": pa.string(), "bytes_read": pa.int64(), "directory_bytes": pa.int64(),
}
#: Bytes of a range, and of the contents of one batch.
SPLIT, BATCH = 64 << 20, 4 << 20


def file_system(path: str):
    """(file system, path in it) of a path or URI."""
    if urlparse(path).scheme in ("", "file"):
        return arrow_fs.LocalFileSystem(), urlparse(path).path
    return arrow_fs.FileSystem.from_uri(path)


class FileSource:
    """Ranges of one open file."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)


@dataclass
class Ranges(S.InputPartition):
    """(path, size, first byte, end) of each range of a partition."""

    spans: list[tuple[str, int, int, int]]


class ArchiveReader(S.DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options.get("path"), options.get("files", "*")
        self.split, self.contents = int(options.get("split", SPLIT)), options.get("content", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def partitions(self):
        system, root = file_system(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else [f for f in system.get_file_info(arrow_fs.FileSelector(root, recursive=True)) if f.is_file]
        shown = [f for f in found if not any(part[:1] in "._" for part in posixpath.relpath(f.path, root).split("/")) or f is info]
        spans, held, out = [], 0, []
        for f in sorted(shown, key=lambda f: f.path):
            if not fnmatch.fnmatch(f.base_name, self.pattern) or not self._fits("path", f.path):
                continue
            for lo in range(0, max(1, f.size), self.split):
                hi = min(f.size, lo + self.split)
                if held and held + hi - lo > self.split:
                    out, spans, held = [*out, Ranges(spans)], [], 0
                spans.append((f.path, f.size, lo, hi))
                held += hi - lo
        return [*out, *([Ranges(spans)] if spans else [])] or [Ranges([])]

    def _fits(self, column: str, value) -> bool:
        return all(_TESTS[kind](value, wanted) for name, kind, wanted in self.tests if name == column)

    def read(self, partition: Ranges):
        system, _ = file_system(self.path)
        rows, held = [], 0
        for path, size, lo, hi in partition.spans:
            with system.open_input_file(path) as file:
                source = Counted(FileSource(file, size))
                base = {"path": path, "archive_bytes": size}
                try:
                    table = entries(source)
                except ArchiveError as e:
                    if lo == 0 and not any(name in ("name", "first") for name, _, _ in self.tests):
                        rows.append({**base, "error": e.kind, "directory_bytes": source.bytes})
                    continue
                seen, cost = set(), source.bytes
                for entry in table:
                    first = entry["name"] not in seen
                    seen.add(entry["name"])
                    if not lo <= entry["offset"] < hi or not self._fits("name", entry["name"]) or not self._fits("first", first):
                        continue
                    row, before = {**base, **entry, "first": first, "directory_bytes": cost}, source.bytes
                    if self.contents:
                        try:
                            row["content"] = read(source, entry)
                            held += entry["uncompressed_size"]
                        except ArchiveError as e:
                            row["error"] = e.kind
                    rows.append(row | {"bytes_read": source.bytes - before})
                    if held > BATCH or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
        yield _batch(rows)


class PushingReader(ArchiveReader):
    """The reader of sessions that push filters down."""

    def pushFilters(self, filters):
        for f in filters:
            kind, column = type(f).__name__, ".".join(getattr(f, "attribute", ()))
            if kind in _TESTS and column in ("name", "path", "first"):
                self.tests.append((column, kind, f.value))
            elif not (kind == "IsNotNull" and column in [t[0] for t in self.tests]):
                yield f


_TESTS = {
    "EqualTo": lambda x, v: x == v, "In": lambda x, v: x in v, "StringStartsWith": lambda x, v: x.startswith(v),
    "StringEndsWith": lambda x, v: x.endswith(v), "StringContains": lambda x, v: v in x,
}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in _KINDS.items()], names=list(_KINDS))


@dataclass
class Written(S.WriterCommitMessage):
    names: list[str]


class ArchiveWriter(S.DataSourceArrowWriter):
    """Rows (archive, name, content, of which ``archive`` may be missing) into archives; a row without name or content is
    left out. Equal archives have to stand together in a task; one that meets again is a further file."""

    def __init__(self, options, schema, overwrite: bool):
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("archives are written from the columns name and content")
        self.path, self.overwrite = options["path"], overwrite
        self.method = zipfile.ZIP_STORED if options.get("compression", "deflate") == "none" else zipfile.ZIP_DEFLATED
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, batches):
        system, root = file_system(self.path)
        system.create_dir(f"{root}/{self.pending}", recursive=True)
        names, current, stream, out = [], None, None, None
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i in range(len(batch)):
                archive = column["archive"][i].as_py() if "archive" in column else "part"
                name, body = column["name"][i].as_py(), column["content"][i].as_py()
                if name is None or body is None:
                    continue
                if out is None or archive != current:
                    _close(out, stream)
                    names.append(f"{archive}-{uuid.uuid4().hex}.zip")
                    current, stream = archive, system.open_output_stream(f"{root}/{self.pending}/{names[-1]}")
                    out = zipfile.ZipFile(_Forward(stream), "w", self.method)
                out.writestr(zipfile.ZipInfo(name), body, self.method)
        _close(out, stream)
        return Written(names)

    def commit(self, messages):
        system, root = file_system(self.path)
        kept = {n for m in messages if m is not None for n in m.names}
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(arrow_fs.FileSelector(root)):
                if f.is_file:
                    system.delete_file(f.path)
        for name in sorted(kept):  # a rename an archive
            system.move(f"{root}/{self.pending}/{name}", f"{root}/{name}")
        self._drop(system, root)

    def abort(self, messages):
        self._drop(*file_system(self.path))

    def _drop(self, system, root):
        if system.get_file_info(f"{root}/{self.pending}").type != arrow_fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.pending}")


class _Forward:
    """A stream that cannot seek, so that sizes follow each entry."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


def _close(out, stream) -> None:
    if out is not None:
        out.close()
        stream.close()


class ArchiveSource(S.DataSource):
    @classmethod
    def name(cls):
        return "archives"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushingReader if self.options.get("pushdown", "false") == "true" else ArchiveReader)(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options, schema, overwrite)


#: The setting of a session that lets Python sources take filters (off unless the user turns it on).
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """The entries of the archives at a path; filters reach the source where the session has ``PUSHDOWN`` on."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archives").options(pushdown=spark.conf.get(PUSHDOWN, "false"), **options).load(path)


def write_archives(df: DataFrame, path: str, **options) -> None:
    """Rows (archive, name, content) as archives, an archive a value; the folder may hold others already."""
    df.sparkSession.dataSource.register(ArchiveSource)
    df.repartition("archive").sortWithinPartitions("archive", "name").write.format("archives").options(**options).mode("append").save(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``), removed when the process ends. Only a
    local session without that setting gets a folder of the machine."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        shared = tempfile.mkdtemp(prefix="quire-")
    path = f"{shared}/quire-{uuid.uuid4().hex}"

    def remove():
        system, at = file_system(path)
        if system.get_file_info(at).type != arrow_fs.FileType.NotFound:
            system.delete_dir(at)

    atexit.register(remove)
    return path


def written(df: DataFrame, **options: str) -> DataFrame:
    """The rows as a table in the shared folder: their lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
