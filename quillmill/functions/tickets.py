"""Ticket files as columns: reading a header, checking it, writing and patching text."""

from __future__ import annotations

import datetime
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.header import FENCE
from quillmill.functions.scalars import is_rfc3339, leading_int, rfc3339

STATUSES = ("open", "in_progress", "closed")
TYPES = ("bug", "feature", "task", "epic", "chore")
PRIORITIES = (1, 4)
DEFAULT_PRIORITY = 2
HEADER_LINES = 100

SCHEMA = "id string, status string, type string, priority int, created string, closed string, blocked_by array<string>, parent string, assignee string, title string, error string"
_NAMES = ["id", "status", "type", "priority", "created", "closed", "blocked_by", "parent", "assignee", "title", "error"]
_ARROW = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string()]

_TIME = re.compile(r"(\d{4})-(\d\d)-(\d\d)T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)")


@functools.lru_cache(1 << 14)
def _is_time(text: str) -> bool:
    if not (m := _TIME.fullmatch(text)):
        return False
    try:
        datetime.date(*map(int, m.groups()[:3]))
    except ValueError:
        return False
    return True


def blocker_list(text: str) -> list[str]:
    """Ids of a list as written: brackets required, blanks trimmed, empty items dropped."""
    text = text.strip()
    if not text:
        raise ValueError("blocked-by (invalid format)")
    if not (text.startswith("[") and text.endswith("]") and len(text) > 1):
        raise ValueError("blocked-by (missing brackets)")
    return [x for x in map(str.strip, text[1:-1].split(",")) if x]


def _one_of(name: str, allowed: tuple[str, ...]):
    def check(value: str) -> str:
        if value not in allowed:
            raise ValueError(f'{name} "{value}"')
        return value

    return check


def _number(name: str):
    def check(value: str) -> int:
        if not (m := re.match(r"\s*([+-]?\d+)", value)):
            raise ValueError(f'{name} "{value}"')
        return int(m[1])

    return check


def _version(value: str) -> int:
    version = _number("schema_version")(value)
    if version < 1:
        raise ValueError("schema_version must be positive")
    if version != 1:
        raise ValueError(f"schema_version {version} (only version 1 supported)")
    return version


def _priority(value: str) -> int:
    priority = _number("priority")(value)
    if not PRIORITIES[0] <= priority <= PRIORITIES[1]:
        raise ValueError(f"priority {priority} (out of range)")
    return priority


def _time(name: str):
    def check(value: str) -> str:
        if not _is_time(value):
            raise ValueError(f'{name} "{value}"')
        return value

    return check


FIELDS = {
    "schema_version": _version, "id": str, "status": _one_of("status", STATUSES), "type": _one_of("type", TYPES), "priority": _priority, "created": _time("created"),
    "blocked-by": blocker_list, "parent": str, "assignee": str, "closed": _time("closed"),
}
REQUIRED = ("schema_version", "id", "status", "type", "priority", "created")


def read_ticket(text: str, limit: int = HEADER_LINES) -> dict:
    """The header fields and title of a ticket file; ValueError with the first fault.
    The last of repeated keys counts, unknown keys are ignored."""
    found: dict = {}
    fences, title = 0, None
    for number, line in enumerate(text.split("\n"), 1):
        line = line.removesuffix("\r")
        if fences % 2 and number > limit:
            raise ValueError("header too long")
        if line == FENCE and fences < 2:
            fences += 1
        elif fences == 1:
            key, colon, value = line.partition(": ")
            if colon and key in FIELDS:
                if not value and key != "blocked-by":
                    raise ValueError(f"{key} (empty)")
                found[key] = FIELDS[key](value)
        elif fences == 2 and line.startswith("# "):
            title = line[2:]
            if not title:
                raise ValueError("title (empty)")
            break
    if not fences:
        raise ValueError("no header")
    if fences == 1:
        raise ValueError("unclosed header")
    for key in REQUIRED:
        if key not in found:
            raise ValueError(f"missing required field: {key}")
    if title is None:
        raise ValueError("no title")
    if found["status"] == "closed" and "closed" not in found:
        raise ValueError("closed ticket missing closed timestamp")
    if found["status"] != "closed" and "closed" in found:
        raise ValueError("closed timestamp on ticket that is not closed")
    return {**found, "blocked_by": found.get("blocked-by", []), "title": title}


def parsed(df: DataFrame, content: str) -> DataFrame:
    """df with the fields of the ticket text in `content`, or error where it is faulty:
    good and bad rows stay side by side."""
    keep = [c for c in df.columns if c not in _NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(content).to_pylist():
                try:
                    rows.append({**read_ticket(text or ""), "error": None})
                except ValueError as wrong:
                    rows.append({"error": str(wrong)})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _ARROW, strict=True))], [*keep, *_NAMES])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), SCHEMA])
    return df.select(*keep).mapInArrow(run, schema)


def first_fault(row: dict[str, Column] | None = None) -> Column:
    """The first fault of a ticket held in columns, null for none: the checks of
    `read_ticket` as one expression.  row: expressions for columns that differ."""
    c = {n: F.col(n) for n in ("schema_version", "id", "status", "type", "priority", "created", "closed", "title")} | (row or {})
    empty = lambda x: x.isNull() | (x == "")
    version, priority = leading_int(c["schema_version"]), leading_int(c["priority"])
    checks = [
        (c["schema_version"].isNull(), "missing schema_version"), (version.isNull() | (version != 1), "schema_version"),
        (empty(c["id"]), "missing id"), (empty(c["status"]), "missing status"), (~c["status"].isin(*STATUSES), "status"),
        (empty(c["type"]), "missing type"), (~c["type"].isin(*TYPES), "type"), (c["priority"].isNull(), "missing priority"),
        (priority.isNull() | ~priority.between(*PRIORITIES), "priority"), (empty(c["created"]), "missing created"), (~is_rfc3339(c["created"]), "created"),
        (empty(c["title"]), "no title"), (c["closed"].isNotNull() & ~is_rfc3339(c["closed"]), "closed"),
        ((c["status"] == "closed") & c["closed"].isNull(), "closed without timestamp"), ((c["status"] != "closed") & c["closed"].isNotNull(), "timestamp without closed"),
    ]
    return F.coalesce(*(F.when(wrong, F.lit(name)) for wrong, name in checks))


def blockers(text: Column) -> Column:
    """The ids of a list as written, null without brackets."""
    trimmed = F.trim(text)
    items = F.filter(F.transform(F.split(F.regexp_extract(trimmed, r"^\[(.*)\]$", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(trimmed.rlike(r"^\[.*\]$"), items)


def written_ticket() -> Column:
    """The text of a ticket from its columns (id, assignee, blocked_by, created timestamp,
    external_ref, parent, priority, status, type, title, description, design, acceptance)."""

    def optional(key: str, column: str) -> Column:
        return F.when(F.coalesce(F.col(column), F.lit("")) != "", F.concat(F.lit(f"{key}: "), F.col(column), F.lit("\n"))).otherwise("")

    def section(column: str, head: str) -> Column:
        return F.when(F.coalesce(F.col(column), F.lit("")) != "", F.concat(F.lit("\n" + head), F.col(column), F.lit("\n"))).otherwise("")

    return F.concat(
        F.lit("---\nid: "), F.col("id"), F.lit("\nschema_version: 1\n"), optional("assignee", "assignee"),
        F.lit("blocked-by: ["), F.array_join(F.coalesce("blocked_by", F.array().cast("array<string>")), ", "), F.lit("]\n"),
        F.lit("created: "), rfc3339(F.col("created")), F.lit("\n"), optional("external-ref", "external_ref"), optional("parent", "parent"),
        F.lit("priority: "), F.col("priority").cast("string"), F.lit("\nstatus: "), F.col("status"), F.lit("\ntype: "), F.col("type"),
        F.lit("\n---\n# "), F.col("title"), F.lit("\n"), section("description", ""), section("design", "## Design\n\n"), section("acceptance", "## Acceptance Criteria\n\n"),
    )


# Single fields of raw text, within its header alone.

_HEAD = r"(?s)^---\r?\n(.*?)(?:^|\n)---(?:\r?\n|$)"


def field(text: Column, key: str) -> Column:
    """The value of a header line, null where there is none."""
    line = F.regexp_extract(F.regexp_extract(text, _HEAD, 1), rf"(?m)^{re.escape(key)}: (.*)$", 1)
    return F.when(line != "", line)


def with_field(text: Column, key: str, value: Column) -> Column:
    """text with the header line of `key` set: in place, or after the status line."""
    line = F.concat(F.lit(f"{key}: "), value)
    lines = F.split(text, "\n", -1)
    end = F.array_position(F.slice(lines, 2, F.size(lines)), FENCE) + 1  # the closing fence
    head = F.slice(lines, 1, end.cast("int"))
    tail = F.slice(lines, end.cast("int") + 1, F.size(lines))
    is_key = lambda x: F.startswith(x, F.lit(f"{key}: "))
    replaced = F.transform(head, lambda x: F.when(is_key(x), line).otherwise(x))
    added = F.flatten(F.transform(head, lambda x: F.when(F.startswith(x, F.lit("status: ")), F.array(x, line)).otherwise(F.array(x))))
    return F.array_join(F.concat(F.when(F.exists(head, is_key), replaced).otherwise(added), tail), "\n")


def without_field(text: Column, key: str) -> Column:
    """text without the header line of `key`."""
    lines = F.split(text, "\n", -1)
    end = F.array_position(F.slice(lines, 2, F.size(lines)), FENCE) + 1
    return F.array_join(F.filter(lines, lambda x, i: ~((i < end) & F.startswith(x, F.lit(f"{key}: ")))), "\n")


def with_blockers(text: Column, ids: Column) -> Column:
    return with_field(text, "blocked-by", F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")))


def body(text: Column) -> Column:
    """What follows the header."""
    return F.regexp_replace(text, r"(?s)^---\r?\n.*?(?:^|\n)---(?:\r?\n|$)", "")


def with_body(text: Column, new: Column) -> Column:
    """The header of text with another body."""
    return F.concat(F.regexp_extract(text, r"(?s)^(---\r?\n.*?(?:^|\n)---(?:\r?\n|$))", 1), new)


# Lines and JSON as lists show them.


def list_line() -> Column:
    parent = F.when(F.coalesce(F.col("parent"), F.lit("")) != "", F.concat(F.lit(" (parent: "), F.col("parent"), F.lit(")"))).otherwise("")
    held = F.when(F.size("blocked_by") > 0, F.concat(F.lit(" <- blocked-by: ["), F.array_join("blocked_by", ", "), F.lit("]"))).otherwise("")
    return F.concat(F.col("id"), F.lit(" ["), F.col("status"), F.lit("] - "), F.col("title"), parent, held)


def ready_line() -> Column:
    parent = F.when(F.coalesce(F.col("parent"), F.lit("")) != "", F.concat(F.lit(" (parent: "), F.col("parent"), F.lit(")"))).otherwise("")
    return F.concat(F.col("id"), F.lit("  [P"), F.col("priority").cast("string"), F.lit("]["), F.col("status"), F.lit("] - "), F.col("title"), parent)


def json_object(fields: tuple[str, ...] = ("id", "title", "status", "type", "priority", "created", "closed", "parent", "blocked_by")) -> Column:
    """One ticket as JSON: parent and closed are left out when empty, blocked_by never is."""
    shown = [F.coalesce(F.col(f), F.array().cast("array<string>")).alias(f) if f == "blocked_by" else F.when(F.col(f).cast("string") != "", F.col(f)).alias(f) for f in fields]
    return F.to_json(F.struct(*shown))


#: Fields that a list shows alone.
SHOWN = ("id", "priority", "status", "type", "title", "parent", "created")


def shown_field(name: str) -> Column:
    """One field as text, empty where it is missing."""
    if name not in SHOWN:
        raise ValueError(f"unknown field {name!r}")
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def field_json(name: str) -> Column:
    """One field as JSON: priority stays a number, the others are text."""
    if name == "priority":
        return F.col(name).cast("string")
    plain = F.to_json(F.struct(shown_field(name).alias("x")))
    return F.substring(plain, 6, 1 << 30).substr(F.lit(1), F.length(plain) - 6)


def json_array(page: DataFrame, order: list, fields: tuple[str, ...] = ("id", "title", "status", "type", "priority", "created", "closed", "parent", "blocked_by")) -> DataFrame:
    """The tickets of a page as one JSON array in order: one row, whatever the page holds."""
    rows = page.select(F.struct(*order).alias("_order"), json_object(fields).alias("_json"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_order", "_json"))), lambda x: x["_json"])
    return rows.agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("json"))
