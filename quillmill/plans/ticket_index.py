"""The index of a flat folder of ticket files: built, patched and reconciled.

The index is a table with a row for each file, sorted by file name: its columns, or the
error that keeps it from being read.  Every change writes a new version and moves the
pointer.  An index that cannot be brought up to date is taken away, and the next reader
builds it from the files, which are the truth."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions.tickets import parsed
from quillmill.operators import changes
from quillmill.plans.locks import Lock
from quillmill.plans.stage import written
from quillmill.sources import documents
from quillmill.sources.log import write_atomic

#: Files that one task reads: tickets are short, and starting a task costs more than reading hundreds.
CHUNK = 4096
#: Status and type as numbers, for those who store them so; what is unknown counts as the first.
STATUS_CODES = {"open": 0, "in_progress": 1, "closed": 2}
TYPE_CODES = {"bug": 0, "feature": 1, "task": 2, "epic": 3, "chore": 4}


def code_of(column: str, codes: dict[str, int]):
    return F.coalesce(*(F.when(F.col(column) == k, F.lit(v)) for k, v in codes.items()), F.lit(0))


def name_of(column: str, codes: dict[str, int]):
    first = next(iter(codes))
    return F.coalesce(*(F.when(F.col(column) == v, F.lit(k)) for k, v in codes.items()), F.lit(first))


class TicketIndex:
    def __init__(self, spark: SparkSession, folder: str, internal: str = documents.INTERNAL, chunk: int = CHUNK):
        self.spark, self.folder, self.chunk = spark, folder, chunk
        self.home = os.path.join(folder, internal)
        os.makedirs(self.home, exist_ok=True)
        self.pointer = os.path.join(self.home, "TICKETS")
        self.lock = Lock(os.path.join(self.home, "tickets.lock"))

    # Files

    def files(self, content: str = "false") -> DataFrame:
        """The folder's ticket files.  content: 'true', 'false', or 'head' for what stands
        up to the title."""
        return documents.scan(self.spark, self.folder, recursive="false", content=content, chunk=str(self.chunk)).withColumnRenamed("path", "file")

    def _parsed(self, files: DataFrame) -> DataFrame:
        return parsed(files.select("file", "content"), "content").drop("content")

    # Versions

    def _path(self, version: str) -> str:
        return "file://" + os.path.abspath(os.path.join(self.home, f"tickets-{version}"))

    def _publish(self, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        rows.sortWithinPartitions("file").write.parquet(self._path(version))
        write_atomic(self.pointer, json.dumps({"version": version, "schema": rows.schema.jsonValue()}).encode())

    def drop(self) -> None:
        """Takes the index away."""
        if os.path.exists(self.pointer):
            os.unlink(self.pointer)

    def is_stale(self) -> bool:
        """Whether the folder has changed since the index was written, or there is none."""
        try:
            return os.stat(self.folder).st_mtime_ns > os.stat(self.pointer).st_mtime_ns
        except FileNotFoundError:
            return True

    def read(self) -> DataFrame:
        """The index as it is; built first where there is none."""
        from pyspark.sql import types as T

        if not os.path.exists(self.pointer):
            self._build()
        with open(self.pointer) as f:
            now = json.load(f)
        return self.spark.read.schema(T.StructType.fromJson(now["schema"])).parquet(self._path(now["version"]))

    def version(self) -> str:
        """Where the rows of the index as it is are: later versions leave them there."""
        with open(self.pointer) as f:
            return self._path(json.load(f)["version"])

    def current(self) -> DataFrame:
        """The index, reconciled first if the folder has changed."""
        if os.path.exists(self.pointer) and self.is_stale():
            self.reconcile()
        return self.read()

    def _build(self) -> None:
        with self.lock.write():
            self._publish(self._parsed(self.files("head")))

    def rebuild(self) -> int:
        self._build()
        return self.read().count()

    def reconcile(self) -> None:
        """Adds files that are new, drops rows of those that are gone; other files are not read."""
        old, names = self.read(), written(self.files("head"))
        fresh = names.join(old.select("file"), "file", "left_anti")
        with self.lock.write():
            self._publish(old.join(names.select("file"), "file", "left_semi").unionByName(self._parsed(fresh)))

    def patch(self, names: list[str]) -> None:
        """Reads some files again, or forgets them where they are gone."""
        wanted = self.spark.createDataFrame([(n,) for n in names], "file string")
        fresh = self._parsed(self.files("head").join(F.broadcast(wanted), "file", "left_semi"))
        with self.lock.write():
            self._publish(changes.delete(self.read(), wanted, "file").unionByName(fresh))

    def after_write(self, names: list[str]) -> bool:
        """Brings the index up to date after writes; if that fails it is taken away, as a
        wrong index is worse than none.  The files are written either way."""
        try:
            self.patch(names)
            return True
        except Exception:
            self.drop()
            return False

    # Questions

    def lookup(self, file: str) -> DataFrame:
        """The row of a file name: the sorted files' ranges tell where it can be."""
        return self.read().filter(F.col("file") == file)

    def nth(self, number: int) -> DataFrame:
        """The row with that number by file name, from 0."""
        if number < 0:
            raise IndexError("negative number")
        top = self.read().orderBy("file").limit(number + 1)
        return top.withColumn("_n", F.row_number().over(W.orderBy("file"))).filter(F.col("_n") == number + 1).drop("_n")

    def tickets(self) -> DataFrame:
        return self.read().filter("error is null")

    def faults(self) -> DataFrame:
        return self.read().filter("error is not null").select("file", "error")
