"""Related tables that follow the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.changes import delete
from quillmill.plans.stage import written


class Related:
    """A table derived from index rows by `derive`, which gives rows with a column `id`.
    Called with the rows put and the ids deleted, it replaces what it held of them; the
    same call twice leaves it as once."""

    def __init__(self, derive: Callable[[DataFrame], DataFrame]):
        self.derive, self.table = derive, None

    def __call__(self, puts: DataFrame, deleted: DataFrame) -> None:
        fresh = self.derive(puts)
        if self.table is not None:
            stale = puts.select("id").unionByName(deleted.select("id"))
            fresh = delete(self.table, stale, "id").unionByName(fresh)
        self.table = written(fresh)


def list_items(column: str, name: str = "item") -> Callable[[DataFrame], DataFrame]:
    """Rows (id, pos, item) of a list column."""
    return lambda rows: rows.select("id", F.posexplode(column).alias("pos", name))
