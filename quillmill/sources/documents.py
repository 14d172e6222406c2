"""Collections of Markdown files as DataFrames.

The driver lists one level of the folder; each task walks its part of it, so listing is
as parallel as reading.  Sizes and times come from the file system with nanoseconds,
which tell an edit from the file before it.  The folder must be one that all executors
see.
"""

from __future__ import annotations

import contextlib
import io
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIX = ".md"
#: The folder with the index, which holds no documents.
INTERNAL = ".index"
SCHEMA_NAMES = ["path", "mtime_ns", "size_bytes", "content"]
SCHEMA = "path string, mtime_ns bigint, size_bytes bigint, content string"


def is_internal(path: str, internal: str = INTERNAL) -> bool:
    """Whether a relative path is the index folder or in it; names that only start alike are not."""
    return path == internal or path.startswith(internal + "/")


class _Part(InputPartition):
    """files: the names are those of files, so none has to be looked at to tell."""

    def __init__(self, names: list[str], files: bool = False):
        super().__init__(None)
        self.names, self.files = names, files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.base = options["path"].removeprefix("file://")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.internal = options.get("internal", INTERNAL)
        self.content = options.get("content", "true").lower()
        self.chunk = int(options.get("chunk", "256"))

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.base):
            return []
        files, parts = [], []
        with os.scandir(self.base) as found:  # it tells folders without a look at each file
            entries = sorted((e.name, e.is_dir()) for e in found if not is_internal(e.name, self.internal))
        for name, is_folder in entries:
            if not is_folder:
                if name.endswith(SUFFIX) and (self.recursive or not name.startswith(".")):
                    files.append(name)
            elif self.recursive:  # a folder is dealt out by what is in it, so a large one is no single task
                inside = sorted(os.path.join(name, x) for x in os.listdir(os.path.join(self.base, name)))
                parts += [_Part(inside[i : i + self.chunk]) for i in range(0, len(inside), self.chunk)]
        return [*(_Part(files[i : i + self.chunk], True) for i in range(0, len(files), self.chunk)), *parts]

    def _walk(self, name: str) -> Iterator[str]:
        full = os.path.join(self.base, name)
        if not os.path.isdir(full):
            if name.endswith(SUFFIX):
                yield name
            return
        for folder, _, files in os.walk(full):
            for f in files:
                if f.endswith(SUFFIX):
                    yield os.path.relpath(os.path.join(folder, f), self.base)

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for name in part.names if part else ():  # Spark asks once where there are no parts
            for path in (name,) if part.files else self._walk(name):
                full = os.path.join(self.base, path)
                try:
                    if self.content == "head":
                        stat, text = _stat_and_head(full)
                    else:
                        stat = os.stat(full)
                        text = None if self.content == "false" else read_text(full)
                except FileNotFoundError:
                    continue  # it went while the folder was read
                rows.append((path, stat.st_mtime_ns, stat.st_size, text))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


#: Files of one batch sent to Spark.
BATCH = 256


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], SCHEMA_NAMES)


def read_text(path: str) -> str:
    with open(path, "rb") as f:
        return f.read().decode("utf-8", "replace")


#: Bytes read at first for a head; most end in them.
BLOCK = 4096


def _head(lines: Iterable[bytes]) -> bytes:
    out, fences = [], 0
    for line in lines:
        out.append(line)
        if fences < 2:
            fences += line.rstrip(b"\r\n") == b"---"
        elif line.startswith(b"# "):
            break
    return b"".join(out)


def _stat_and_head(path: str) -> tuple[os.stat_result, str]:
    handle = os.open(path, os.O_RDONLY)
    try:
        stat, block = os.fstat(handle), os.read(handle, BLOCK)
        head = _head(io.BytesIO(block))
        if len(head) == len(block) == BLOCK:  # it may go on
            with open(path, "rb") as f:
                head = _head(f)
    finally:
        os.close(handle)
    return stat, head.decode("utf-8", "replace")


def read_head(path: str) -> str:
    """A file up to its first title after the header, or all of it where there is none:
    what a list needs, however long the text that follows."""
    return _stat_and_head(path)[1]


class MarkdownSource(DataSource):
    """format("markdown"): options path, recursive, internal, content (true, head or false), chunk."""

    @classmethod
    def name(cls) -> str:
        return "markdown"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(MarkdownSource)
    return spark.read.format("markdown").options(path=path, **options).load()


def newest_folder(base: str, internal: str = INTERNAL) -> int:
    """The time, in nanoseconds, at which a folder of the collection last changed."""
    newest, base = 0, base.removeprefix("file://")
    for folder, inside, _ in os.walk(base):
        if folder == base:
            inside[:] = [x for x in inside if not is_internal(x, internal)]
        newest = max(newest, os.stat(folder).st_mtime_ns)
    return newest


def contents(listing: DataFrame, base: str) -> DataFrame:
    """listing (path, mtime_ns, size_bytes) with the content of those files, read where
    the rows are: what a refresh needs of the files that changed.  Files that went since
    are left out, as by a scan."""
    base = base.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, time, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with contextlib.suppress(FileNotFoundError):
                    rows.append((path, time, size, read_text(os.path.join(base, path))))
            if rows:
                yield _batch(rows)

    return listing.select("path", "mtime_ns", "size_bytes").mapInArrow(run, SCHEMA)
