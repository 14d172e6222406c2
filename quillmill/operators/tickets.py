"""Lists of tickets: filters, order, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions.tickets import PRIORITIES, STATUSES, TYPES

#: Tickets that a list shows unless told otherwise.
LIST_LIMIT = 100


class OutOfBounds(ValueError):
    """The offset lies beyond the matches."""


def matching(df: DataFrame, status: str | None = None, priority: int | None = None, type: str | None = None, parent: str | None = None, roots: bool = False) -> DataFrame:
    """Tickets that meet every condition given.  Plain comparisons, so they reach the scan."""
    if parent and roots:
        raise ValueError("parent and roots exclude each other")
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    if type is not None and type not in TYPES:
        raise ValueError(f"unknown type {type!r}")
    if priority is not None and not PRIORITIES[0] <= priority <= PRIORITIES[1]:
        raise ValueError(f"priority {priority} out of range")
    for name, value in (("status", status), ("priority", priority), ("type", type), ("parent", parent)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df.filter(F.col("parent").isNull() | (F.col("parent") == "")) if roots else df


def by_file_name(df: DataFrame) -> DataFrame:
    """List order: the bytes of the file name, in which 'a-1.md' comes before 'a.md'."""
    return df.orderBy(F.concat("id", F.lit(".md")))


def page(df: DataFrame, offset: int = 0, limit: int = LIST_LIMIT) -> DataFrame:
    """The rows of an ordered df from offset on; limit 0 is none."""
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit else df


def checked_page(df: DataFrame, offset: int = 0, limit: int = LIST_LIMIT) -> DataFrame:
    """As `page`, but an offset at or beyond the number of rows is an error.  One row
    past the offset tells, so the matches are not counted."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit cannot be negative")
    if offset and df.offset(offset).limit(1).isEmpty():
        raise OutOfBounds(f"offset {offset} out of bounds")
    return page(df, offset, limit)


def numbered_page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page with its rows' numbers, counted within the page alone: the top rows are
    taken first, so no sort of all rows meets in one task."""
    top = df.orderBy(*order).limit(offset + limit)
    numbered = top.withColumn("rn", F.row_number().over(W.orderBy(*order)).cast("long"))
    return numbered.filter(F.col("rn") > offset)


def children(df: DataFrame, parent: str, open_only: bool = False) -> DataFrame:
    found = df.filter(F.col("parent") == parent)
    return found.filter(F.col("status") != "closed") if open_only else found


def with_blocker(df: DataFrame, blocker: str) -> DataFrame:
    """Tickets that wait for a given one."""
    return df.filter(F.array_contains("blocked_by", blocker))


def page_with_blockers(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of tickets, numbered, with a row for each of a ticket's blockers and the
    blocker's status; null where it has none or the blocker is missing.  The page is taken
    first, so no more is joined than it shows."""
    states = df.select(F.col("id").alias("blocker"), F.col("status").alias("blocker_status"))
    shown = numbered_page(df, order, offset, limit).select("rn", "id", "status", F.posexplode_outer("blocked_by").alias("pos", "blocker"))
    return shown.join(states, "blocker", "left").select("rn", "id", "status", "pos", "blocker", "blocker_status")


def match_count(df: DataFrame, **conditions) -> int:
    """How many tickets `matching` finds."""
    return matching(df, **conditions).count()


def by_creation(df: DataFrame) -> DataFrame:
    """Oldest first, equal times by id."""
    return df.orderBy("created", "id")


def ready_page(df: DataFrame, offset: int = 0, limit: int = 0) -> DataFrame:
    """Tickets by priority, then oldest first; limit 0 is none."""
    ordered = df.orderBy("priority", "created", "id")
    return checked_page(ordered, offset, limit)
