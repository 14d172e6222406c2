"""Writes to tickets: checks against the graph, then a new state of the table.

An operation is a table of requests; checks are joins, so one request and a million are
the same plan.  Refused requests come back with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.tickets import PRIORITIES, TYPES
from quillmill.operators import graph
from quillmill.operators.changes import upsert

#: Reasons that users of such boards match on.
TITLE_REQUIRED = "title is required"
PARENT_NOT_FOUND = "parent not found"
PARENT_CLOSED = "parent is closed"
BLOCKER_NOT_FOUND = "blocker not found"
TICKET_NOT_FOUND = "ticket not found"
OPEN_CHILDREN = "has open children"
BLOCKS_ITSELF = "cannot block itself"
ALREADY_BLOCKED = "already blocked"
ALREADY_CLOSED = "already closed"


def create_reason(tickets: DataFrame, new: DataFrame) -> DataFrame:
    """new (id, title, type, priority, parent, blocked_by): (id, reason) of each, null if it may be created."""
    there = tickets.select("id", "status")
    wanted = new.select("id", F.explode("blocked_by").alias("blocker"))
    missing = wanted.join(there.select(F.col("id").alias("blocker")), "blocker", "left_anti").groupBy("id").agg(F.lit(True).alias("missing_blocker"))
    parents = there.select(F.col("id").alias("parent"), F.col("status").alias("parent_status"))
    taken = there.select("id", F.lit(True).alias("taken"))
    joined = new.join(taken, "id", "left").join(missing, "id", "left").join(parents, "parent", "left")
    reason = (
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", TITLE_REQUIRED)
        .when(~F.coalesce("type", F.lit("")).isin(*TYPES), "invalid type")
        .when(~F.coalesce("priority", F.lit(0)).between(*PRIORITIES), "invalid priority")
        .when(F.col("taken"), "id is taken")
        .when((F.coalesce("parent", F.lit("")) != "") & F.col("parent_status").isNull(), PARENT_NOT_FOUND)
        .when(F.col("parent_status") == "closed", PARENT_CLOSED)
        .when(F.col("missing_blocker"), BLOCKER_NOT_FOUND)
    )
    return joined.select("id", reason.alias("reason"))


def created(tickets: DataFrame, new: DataFrame) -> DataFrame:
    allowed = new.join(create_reason(tickets, new).filter("reason is null"), "id", "left_semi")
    return upsert(tickets, allowed.withColumn("status", F.lit("open")), "id")


def _moved(tickets: DataFrame, ids: DataFrame, reasons: DataFrame, status: str) -> DataFrame:
    allowed = ids.select("id").join(reasons.filter("reason is null"), "id", "left_semi").withColumn("_go", F.lit(True))
    return tickets.join(allowed, "id", "left").withColumn("status", F.when(F.col("_go"), status).otherwise(F.col("status"))).drop("_go").select(*tickets.columns)


def started(tickets: DataFrame, ids: DataFrame) -> DataFrame:
    """Starts what may start: open, blockers closed, parent started, ancestors not held up."""
    return _moved(tickets, ids, graph.start_reason(tickets), "in_progress")


def close_reason(tickets: DataFrame) -> DataFrame:
    """Status first, then open children."""
    busy = tickets.filter("status <> 'closed' and coalesce(parent, '') <> ''").groupBy(F.col("parent").alias("id")).agg(F.lit(True).alias("busy"))
    reason = F.when(F.col("status") == "open", "not started").when(F.col("status") == "closed", ALREADY_CLOSED).when(F.col("busy"), OPEN_CHILDREN)
    return tickets.join(busy, "id", "left").select("id", reason.alias("reason"))


def closed(tickets: DataFrame, ids: DataFrame) -> DataFrame:
    return _moved(tickets, ids, close_reason(tickets), "closed")


def reopen_reason(tickets: DataFrame) -> DataFrame:
    parents = tickets.select(F.col("id").alias("parent"), F.col("status").alias("parent_status"))
    reason = F.when(F.col("status") != "closed", "not closed").when(F.col("parent_status") == "closed", PARENT_CLOSED)
    return tickets.join(parents, "parent", "left").select("id", reason.alias("reason"))


def reopened(tickets: DataFrame, ids: DataFrame) -> DataFrame:
    return _moved(tickets, ids, reopen_reason(tickets), "open")


def block_reason(tickets: DataFrame, links: DataFrame) -> DataFrame:
    """links (id, blocker): (id, blocker, reason).  A link that closes a cycle, with the
    links there are and the others asked for, is refused."""
    there = tickets.select("id", "blocked_by")
    blockers = tickets.select(F.col("id").alias("blocker"), F.lit(True).alias("known"))
    every = graph.edges(tickets).select(F.col("id").alias("a"), F.col("blocker").alias("b")).unionByName(links.select(F.col("id").alias("a"), F.col("blocker").alias("b")))
    cyclic = graph.on_cycle(every)
    ends = cyclic.select("id", F.lit(True).alias("from_cycle"))
    joined = links.join(there, "id", "left").join(blockers, "blocker", "left").join(ends, "id", "left")
    joined = joined.join(cyclic.select(F.col("id").alias("blocker"), F.lit(True).alias("to_cycle")), "blocker", "left")
    reason = (
        F.when(F.col("blocked_by").isNull(), TICKET_NOT_FOUND)
        .when(F.col("known").isNull(), BLOCKER_NOT_FOUND)
        .when(F.col("id") == F.col("blocker"), BLOCKS_ITSELF)
        .when(F.array_contains("blocked_by", F.col("blocker")), ALREADY_BLOCKED)
        .when(F.col("from_cycle") & F.col("to_cycle"), "closes a cycle")
    )
    return joined.select("id", "blocker", reason.alias("reason"))


def _edited(tickets: DataFrame, lists: DataFrame, new: Column) -> DataFrame:
    return tickets.join(lists, "id", "left").withColumn("blocked_by", F.when(F.col("_list").isNull(), F.col("blocked_by")).otherwise(new)).drop("_list").select(*tickets.columns)


def blocked(tickets: DataFrame, links: DataFrame) -> DataFrame:
    allowed = block_reason(tickets, links).filter("reason is null").groupBy("id").agg(F.array_sort(F.collect_set("blocker")).alias("_list"))
    return _edited(tickets, allowed, F.concat("blocked_by", "_list"))


def unblocked(tickets: DataFrame, links: DataFrame) -> DataFrame:
    """Takes links away; one that is not there changes nothing."""
    gone = links.groupBy("id").agg(F.collect_set("blocker").alias("_list"))
    return _edited(tickets, gone, F.filter("blocked_by", lambda x: ~F.array_contains("_list", x)))
