"""The document store: files are the truth, the index is a rebuildable snapshot.

A snapshot is a folder of Parquet; one small file names the current one.  Readers pin a
snapshot, so they take no lock.  Writers hold a lock file, write a new snapshot beside
the old and swap the pointer.  A transaction's log is the commit point: once it is
synced, files and index follow, now or when the store is opened next.
"""

from __future__ import annotations

import contextlib
import dataclasses
import json
import os
import posixpath
import shutil
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import header as H
from quillmill.functions.scalars import has_prefix
from quillmill.functions.schema import TYPES, Schema
from quillmill.operators import changes
from quillmill.plans.locks import Busy, Lock
from quillmill.plans.stage import written
from quillmill.sources import documents, log

LOCK_SECONDS = 10.0
PREFIX_ROWS = 50
PREFIX_COLUMNS = ("id", "short_id", "path", "mtime_ns", "size_bytes", "title")


class StoreError(Exception):
    pass


class Closed(StoreError):
    """The store or transaction is closed."""


class NotFound(StoreError):
    pass


class AlreadyExists(StoreError):
    pass


class CommitIncomplete(StoreError):
    """The log is committed, but files or index are not done; opening again finishes it."""


class ScanError(StoreError):
    """Files that cannot be indexed; nothing was changed."""

    def __init__(self, total: int, issues: list[tuple[str, str]]):
        super().__init__(f"{total} files cannot be indexed: " + "; ".join(f"{p}: {e}" for p, e in issues))
        self.total, self.issues = total, issues


@dataclasses.dataclass
class Config:
    base: str
    schema: Schema = dataclasses.field(default_factory=Schema)
    #: Values of the schema's own columns, from the columns header and body.
    columns: dict[str, Column] = dataclasses.field(default_factory=dict)
    #: Derivations from the column id.
    path_of: Callable[[Column], Column] = lambda i: F.concat(i, F.lit(".md"))
    short_of: Callable[[Column], Column] = lambda i: i
    internal: str = documents.INTERNAL
    options: H.Options = dataclasses.field(default_factory=lambda: H.Options(line_limit=0))
    #: Called with rows put and ids deleted after each change; must be idempotent.
    after_batch: Callable[[DataFrame, DataFrame], None] | None = None
    #: Called with the rows that a transaction created or updated, and with the ids that it
    #: or a refresh deleted; a log that is replayed calls them again.
    after_create: Callable[[DataFrame], None] | None = None
    after_update: Callable[[DataFrame], None] | None = None
    after_delete: Callable[[DataFrame], None] | None = None
    #: Called when the index is made anew, before rows are put in: for related tables.
    after_schema: Callable[[Schema], None] | None = None


def bad_path(path: str) -> str | None:
    """Why a relative path cannot be a document's, null if it can."""
    if not path:
        return "empty path"
    if posixpath.isabs(path):
        return "absolute path"
    if posixpath.normpath(path) != path:
        return "path is not clean"
    if path.startswith(".."):
        return "path leaves the folder"
    return None if path.endswith(documents.SUFFIX) else "path does not end in .md"


class Store:
    def __init__(self, spark: SparkSession, config: Config):
        config.schema.check()
        missing = set(config.schema.custom) ^ set(config.columns)
        if missing:
            raise StoreError(f"columns and schema differ: {sorted(missing)}")
        self.spark, self.config, self.open = spark, config, True
        self.folder = os.path.join(config.base, config.internal)
        self.log_path = os.path.join(self.folder, "log")
        os.makedirs(os.path.join(self.folder, "snapshots"), exist_ok=True)
        with self._lock():
            self._recover()
            now = self._pointer()
            if not now or now["fingerprint"] != config.schema.fingerprint():
                self._rebuild()

    # Snapshots

    def _pointer(self) -> dict | None:
        try:
            with open(os.path.join(self.folder, "CURRENT")) as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def _snapshot(self, name: str) -> str:
        return "file://" + os.path.abspath(os.path.join(self.folder, "snapshots", name))

    def _publish(self, index: DataFrame) -> int:
        """Writes a snapshot sorted by id, so that Parquet's ranges serve lookups, and swaps."""
        before = self._pointer()
        name = f"{time.time_ns()}"
        fields = [F.col(f.name).cast(TYPES[f.type]).alias(f.name) for f in self.config.schema.fields]
        index.select(*fields).sortWithinPartitions("id").write.parquet(self._snapshot(name))
        rows = self.spark.read.parquet(self._snapshot(name)).count()
        pointer = {"snapshot": name, "fingerprint": self.config.schema.fingerprint(), "rows": rows, "before": before and before["snapshot"]}
        log.write_atomic(os.path.join(self.folder, "CURRENT"), json.dumps(pointer).encode())
        keep = {name, pointer["before"]}  # readers may still hold the one before
        for old in os.listdir(os.path.join(self.folder, "snapshots")):
            if old not in keep:
                shutil.rmtree(os.path.join(self.folder, "snapshots", old), ignore_errors=True)
        return rows

    def index(self) -> DataFrame:
        """The current index, pinned: later changes do not show in it."""
        self._check()
        return self.spark.read.schema(self.config.schema.struct()).parquet(self._snapshot(self._pointer()["snapshot"]))

    def _check(self) -> None:
        if not self.open:
            raise Closed("store is closed")

    def close(self) -> None:
        self.open = False

    @contextlib.contextmanager
    def _lock(self, seconds: float = LOCK_SECONDS):
        """One writer at a time, here and in other processes.  Readers pin a snapshot and need no lock."""
        try:
            with Lock(os.path.join(self.folder, "lock")).write(seconds):
                yield
        except Busy:
            raise StoreError("the store is locked") from None

    # Scans

    def _rows(self, files: DataFrame) -> DataFrame:
        """Index rows of files (path, mtime_ns, size_bytes, content), with error."""
        c, h = self.config, F.col("header")
        read = H.with_header(files, "content", c.options)
        read = read.withColumn("id", H.get_string(h, "id")).withColumn("title", H.get_string(h, "title"))
        fault = (
            F.when(F.col("error").isNotNull(), F.col("error"))
            .when(F.coalesce("id", F.lit("")) == "", "missing id field")
            .when(F.coalesce("title", F.lit("")) == "", "missing title field")
            .when(c.path_of(F.col("id")) != F.col("path"), "path does not match id")
        )
        custom = [value.alias(name) for name, value in c.columns.items()]
        return read.select("id", c.short_of(F.col("id")).alias("short_id"), "path", "mtime_ns", "size_bytes", "title", *custom, fault.alias("error"))

    def _good(self, rows: DataFrame) -> DataFrame:
        """rows without error, or ScanError: an index is rebuilt whole or not at all."""
        rows = written(rows)
        bad = rows.filter("error is not null")
        total = bad.count()
        if total:
            raise ScanError(total, [(r["path"], r["error"]) for r in bad.orderBy("path").limit(20).collect()])
        return rows.drop("error")

    def _scan(self, content: bool) -> DataFrame:
        return documents.scan(self.spark, self.config.base, internal=self.config.internal, content=str(content).lower())

    def _rebuild(self) -> int:
        if self.config.after_schema:
            self.config.after_schema(self.config.schema)
        rows = self._good(self._rows(self._scan(True)))
        done = self._publish(rows)
        self._hook(rows, rows.select("id").limit(0))
        return done

    def _hook(self, puts: DataFrame, deleted: DataFrame, kinds: dict[str, str] | None = None) -> None:
        """kinds: of a transaction's ids."""
        c = self.config
        if c.after_batch:
            c.after_batch(puts, deleted)
        for act, kind in ((c.after_create, "create"), (c.after_update, "update")):
            if act and (ids := [i for i, k in (kinds or {}).items() if k == kind]):
                act(puts.filter(F.col("id").isin(ids)))
        if c.after_delete and not deleted.isEmpty():
            c.after_delete(deleted)

    def reindex(self) -> int:
        """Rebuilds the index from all files; returns its rows."""
        self._check()
        with self._lock():
            self._recover()
            return self._rebuild()

    def refresh(self) -> dict[str, int]:
        """Brings the index up to date.  Files whose time and size are as before are not
        read.  Returns inserted, updated, deleted, skipped and total."""
        self._check()
        with self._lock():
            self._recover()
            old = self.index()
            listing = written(self._scan(False).drop("content"))
            actions = written(changes.diff(old, listing, "path", ["mtime_ns", "size_bytes"]))
            found = changes.counts(actions).first().asDict()
            if found["inserted"] or found["updated"] or found["deleted"]:
                changed = listing.join(actions.filter(F.col("action").isin("inserted", "updated")), "path", "left_semi")
                rows = self._good(self._rows(documents.contents(changed, self.config.base)))
                gone = old.join(actions.filter("action = 'deleted'"), "path", "left_semi").select("id")
                kept = old.join(actions.filter("action = 'skipped'"), "path", "left_semi")
                self._publish(kept.unionByName(rows))
                self._hook(rows, gone)
            return found

    # Questions

    def by_prefix(self, prefix: str) -> DataFrame:
        """Up to fifty rows whose id or short id starts so, by id."""
        if not prefix:
            raise ValueError("empty prefix")
        found = self.index().filter(has_prefix(F.col("short_id"), prefix) | has_prefix(F.col("id"), prefix))
        return found.orderBy("id").limit(PREFIX_ROWS).select(*PREFIX_COLUMNS)

    def by_path(self, path: str) -> DataFrame:
        """The row of a file."""
        return self.index().filter(F.col("path") == path)

    def nth(self, number: int) -> DataFrame:
        """The row with that number by id, from 0."""
        top = self.index().orderBy("id").limit(number + 1)
        return top.withColumn("_n", F.row_number().over(W.orderBy("id"))).filter(F.col("_n") == number + 1).drop("_n")

    def is_stale(self) -> bool:
        """Whether a file or folder has been added or removed since the index was written."""
        return documents.newest_folder(self.config.base, self.config.internal) > os.stat(os.path.join(self.folder, "CURRENT")).st_mtime_ns

    def exists(self, id: str) -> bool:
        return not self.index().filter(F.col("id") == id).isEmpty()

    def get(self, id: str) -> dict:
        """One document: id, path, header and body."""
        row = self.index().filter(F.col("id") == id).select("path").first()
        if not row:
            raise NotFound(f"document not found (doc_id={id})")
        full = os.path.join(self.config.base, row["path"])
        if not os.path.isfile(full):
            raise NotFound(f"no regular file (doc_id={id} doc_path={row['path']})")
        with open(full, "rb") as f:
            entries, body = H.parse(f.read().decode("utf-8", "replace"), self.config.options)
        if next((e["s"] for e in entries if e["key"] == "id"), None) != id:
            raise StoreError(f"file holds another id (doc_id={id} doc_path={row['path']})")
        return {"id": id, "path": row["path"], "header": entries, "body": body}

    def query(self, sql: str) -> DataFrame:
        """SQL with the index as a view of the schema's name."""
        self.index().createOrReplaceTempView(self.config.schema.name)
        return self.spark.sql(sql)

    # Transactions

    def begin(self) -> Transaction:
        self._check()
        with self._lock():
            self._recover()
        return Transaction(self)

    def _recover(self) -> None:
        """Finishes a committed log, forgets one that was not committed."""
        if not os.path.exists(self.log_path):
            return
        with open(self.log_path, "rb") as f:
            state, body = log.state(f.read())
        if state == log.COMMITTED:
            self._apply(log.decode(body))
        if state != log.EMPTY:
            log.write_atomic(self.log_path, b"")

    def _apply(self, ops: list[log.Op]) -> None:
        """Files, then index; doing it again changes nothing."""
        for op in ops:
            full = os.path.join(self.config.base, op.path)
            if op.op == "put":
                log.write_atomic(full, op.content.encode())
            else:
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(full)
        if not self._pointer():
            return  # the first index is built from the files
        puts = [op for op in ops if op.op == "put"]
        listing = []
        for op in puts:
            stat = os.stat(os.path.join(self.config.base, op.path))
            listing.append((op.path, stat.st_mtime_ns, stat.st_size, op.content))
        rows = self._good(self._rows(self.spark.createDataFrame(listing, documents.SCHEMA)))
        gone = self.spark.createDataFrame([(op.id,) for op in ops if op.op == "delete"], "id string")
        unique = [list(columns) for columns, single in self.config.schema.indexes if single]
        self._publish(changes.upsert(changes.delete(self.index(), gone, "id"), rows, "id", unique))
        self._hook(rows, gone, {op.id: op.kind for op in ops})


class Transaction:
    """Buffered writes; the last one for an id counts.  Checks look at committed state."""

    def __init__(self, store: Store):
        self.store, self.ops, self.done = store, {}, False

    def _put(self, kind: str, entries: list[dict], body: str) -> str:
        self._check()
        by_key = {e["key"]: e for e in entries}
        for key in ("id", "title"):
            if by_key.get(key, {}).get("kind") != "string" or not by_key[key]["s"]:
                raise ValueError(f"missing {key} field")
        id = by_key["id"]["s"]
        there = self.store.exists(id)
        if kind == "create" and there:
            raise AlreadyExists(f"document exists (doc_id={id})")
        if kind == "update" and not there:
            raise NotFound(f"document not found (doc_id={id})")
        path = self._path(id)
        if wrong := bad_path(path):
            raise ValueError(f"{wrong} (doc_id={id} doc_path={path})")
        self.ops[id] = log.Op("put", kind, id, path, H.document(entries, body))
        return id

    def _path(self, id: str) -> str:
        return self.store.spark.range(1).select(self.store.config.path_of(F.lit(id))).first()[0]

    def create(self, entries: list[dict], body: str = "") -> str:
        return self._put("create", entries, body)

    def update(self, entries: list[dict], body: str = "") -> str:
        return self._put("update", entries, body)

    def delete(self, id: str) -> None:
        self._check()
        if id not in self.ops and not self.store.exists(id):
            raise NotFound(f"document not found (doc_id={id})")
        self.ops[id] = log.Op("delete", "delete", id, self._path(id))

    def query(self, sql: str) -> DataFrame:
        self._check()
        return self.store.query(sql)

    def _check(self) -> None:
        if self.done:
            raise Closed("transaction is closed")
        self.store._check()

    def rollback(self) -> None:
        self.done = True
        self.ops.clear()

    def commit(self) -> None:
        self._check()
        self.done = True
        if not self.ops:
            return
        ops = [self.ops[k] for k in sorted(self.ops)]
        with self.store._lock():
            log.write_atomic(self.store.log_path, log.encode(ops))  # from here on it is committed
            try:
                self.store._apply(ops)
                log.write_atomic(self.store.log_path, b"")
            except Exception as wrong:
                raise CommitIncomplete(str(wrong)) from wrong
