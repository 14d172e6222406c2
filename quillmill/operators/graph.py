"""Blockers, parents and readiness as joins.

Edges are tables; a question about one ticket is the same join with a filter.  Chains of
parents are followed by jumping: each round a ticket's pointer reaches several times as
far, so a chain of n parents takes a logarithm of n rounds and no recursion limit applies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.stage import discard, written


def edges(tickets: DataFrame) -> DataFrame:
    """(id, pos, blocker), one row per listed blocker."""
    return tickets.select("id", F.posexplode("blocked_by").alias("pos", "blocker"))


def _states(tickets: DataFrame) -> DataFrame:
    return tickets.select(F.col("id").alias("blocker"), F.col("status").alias("blocker_status"))


def unresolved(tickets: DataFrame) -> DataFrame:
    """Edges whose blocker is missing or not closed, with the reason."""
    joined = edges(tickets).join(_states(tickets), "blocker", "left")
    reason = F.when(F.col("blocker_status").isNull(), "missing").when(F.col("blocker_status") != "closed", "not closed")
    return joined.withColumn("reason", reason).filter("reason is not null").select("id", "pos", "blocker", "reason")


def stale(tickets: DataFrame) -> DataFrame:
    """Edges to tickets that do not exist."""
    return edges(tickets).join(tickets.select(F.col("id").alias("blocker")), "blocker", "left_anti").select("id", "pos", "blocker")


def repaired(tickets: DataFrame) -> DataFrame:
    """Tickets that have stale blockers, with those taken out of the list in place."""
    gone = stale(tickets).groupBy("id").agg(F.collect_set("blocker").alias("gone"))
    fixed = F.filter("blocked_by", lambda x: ~F.array_contains("gone", x))
    return tickets.join(gone, "id").withColumn("blocked_by", fixed)


def ancestors(tickets: DataFrame) -> DataFrame:
    """(id, ancestor, depth): every ticket with each of its ancestors, those of a cycle once."""
    parents = written(tickets.filter("parent is not null and parent <> ''").select("id", "parent"))
    found = written(parents.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    reach = 1
    # least depths are below the number of tickets, on cycles as well, so some reach has no depth left
    while True:
        # paths of up to `reach` steps, then as many steps more
        far = found.filter(F.col("depth") == reach).select("id", F.col("ancestor").alias("via"))
        more = far.join(found.select(F.col("id").alias("via"), "ancestor", "depth"), "via").select("id", "ancestor", (F.col("depth") + reach).alias("depth"))
        more = written(more)
        if more.isEmpty():
            break
        found = written(found.unionByName(more).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
        reach *= 2
    return found


#: How many times as far a pointer reaches after each round: one join less than that a
#: round, all with the same written table.
REACH = 4


def _moved_on(walk: DataFrame) -> DataFrame:
    """walk (id, reason, next), a written table, with every pointer moved on REACH - 1 times to
    where its target points, unless the target has a reason, which then is the ticket's own."""
    ahead = walk.select(F.col("id").alias("next"), F.col("reason").alias("next_reason"), F.col("next").alias("after"))
    moved, reason = walk, F.coalesce("reason", "next_reason")
    for _ in range(REACH - 1):
        moved = moved.join(ahead, "next", "left").select("id", reason.alias("reason"), F.when(reason.isNull(), F.col("after")).alias("next"))
    return moved


def blocked_chains(tickets: DataFrame) -> DataFrame:
    """(id, reason) of tickets whose own or whose ancestors' blockers, or whose chain of
    parents, hold them up: 'blocker', 'missing parent' or 'cycle'."""
    own = unresolved(tickets).groupBy("id").agg(F.lit("blocker").alias("own"))
    there = tickets.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    jump = F.when(F.coalesce("parent", F.lit("")) != "", F.col("parent"))
    nodes = tickets.select("id", jump.alias("parent")).join(own, "id", "left").join(there, "parent", "left")
    reason = F.coalesce("own", F.when(F.col("parent").isNotNull() & F.col("known").isNull(), F.lit("missing parent")))
    walk = written(nodes.select("id", reason.alias("reason"), F.when(reason.isNull(), F.col("parent")).alias("next")))
    # a chain without a cycle has no more steps than there are tickets, so who still moves then is in one
    size = walk.agg(F.count(F.lit(1)).alias("all"), F.count("next").alias("moving")).first()
    reach, moving = 1, size["moving"]
    while moving and reach <= size["all"]:
        before, walk = walk, written(_moved_on(walk))
        discard(before)
        reach *= REACH
        moving = walk.agg(F.count("next")).first()[0]
    return walk.select("id", F.coalesce("reason", F.when(F.col("next").isNotNull(), F.lit("cycle"))).alias("reason")).filter("reason is not null")


def ready(tickets: DataFrame) -> DataFrame:
    """Open tickets whose blockers are closed, whose parent exists and is not open, and
    whose ancestors are not held up."""
    states = tickets.select(F.col("id").alias("parent"), F.col("status").alias("parent_status"))
    candidates = tickets.filter("status = 'open'").join(blocked_chains(tickets).select("id"), "id", "left_anti")
    root = F.coalesce("parent", F.lit("")) == ""
    kept = candidates.join(states, "parent", "left").filter(root | (F.col("parent_status") != "open"))
    return kept.select(*tickets.columns)


def start_reason(tickets: DataFrame) -> DataFrame:
    """(id, reason) for every ticket: null if it could be started, else why not."""
    own = unresolved(tickets).groupBy("id").agg(F.min_by("reason", "pos").alias("own"))
    states = tickets.select(F.col("id").alias("parent"), F.col("status").alias("parent_status"))
    held = blocked_chains(tickets).select(F.col("id").alias("held"), F.col("reason").alias("held_reason"))
    joined = tickets.join(own, "id", "left").join(states, "parent", "left").join(held, F.col("parent") == F.col("held"), "left")
    has_parent = F.coalesce("parent", F.lit("")) != ""
    reason = (
        F.when(F.col("status") != "open", F.lit("not open"))
        .when(F.col("own") == "missing", F.lit("blocker not found"))
        .when(F.col("own").isNotNull(), F.lit("blocked"))
        .when(has_parent & F.col("parent_status").isNull(), F.lit("parent not found"))
        .when(has_parent & (F.col("parent_status") == "open"), F.lit("parent not started"))
        .when(F.col("held_reason").isNotNull(), F.lit("ancestor not ready"))
    )
    return joined.select("id", reason.alias("reason"))


def _trimmed(links: DataFrame) -> DataFrame:
    """links (a, b) without nodes that have no way in or no way out, round by round."""
    now, size = links, links.count()
    while size:
        into, out = now.select(F.col("b").alias("a")).distinct(), now.select(F.col("a").alias("b")).distinct()
        following = written(now.join(into, "a", "left_semi").join(out, "b", "left_semi").select("a", "b"))
        left = following.count()
        discard(now)
        now, before, size = following, size, left
        if left == before:
            break
    return now


def _settled(state: DataFrame, step, changed) -> DataFrame:
    """state after so many steps that none changes it; a few steps are one written table."""
    value = state.agg(changed).first()[0]
    while True:
        before, state = state, written(step(step(state)))
        discard(before)
        now = state.agg(changed).first()[0]
        if now == value:
            return state
        value = now


#: Links that one task searches for cycles at once; more are coloured first, until no more are left.
LOCAL_LINKS = 1_000_000


def strong_components(links: Iterable[tuple]) -> Iterator[list]:
    """The strong components of several nodes, by one walk depth first without recursion."""
    ahead: dict = {}
    for a, b in links:
        ahead.setdefault(a, []).append(b)
    order: dict = {}
    low: dict = {}
    open_: dict = {}  # nodes of components that are not finished, in the order they were met
    for root in ahead:
        if root in order:
            continue
        work = [(root, iter(ahead[root]))]
        order[root] = low[root] = len(order)
        open_[root] = None
        while work:
            node, rest = work[-1]
            for x in rest:
                if x not in order:
                    order[x] = low[x] = len(order)
                    open_[x] = None
                    work.append((x, iter(ahead.get(x, ()))))
                    break
                if x in open_:
                    low[node] = min(low[node], order[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(open_.popitem()[0])
                    if len(own) > 1:
                        yield own


def _on_cycle_here(links: DataFrame) -> DataFrame:
    """`on_cycle` of links that one task can hold."""
    kind = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (p for batch in batches for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        found = [x for own in strong_components(pairs) for x in own]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["id"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, f"id {kind}")


def on_cycle(links: DataFrame) -> DataFrame:
    """Nodes of links (a, b) that reach themselves: the strong components of several nodes.

    Up to LOCAL_LINKS links are searched by one task.  Of more, each node takes the greatest
    node that reaches it as its colour; who reaches the node of its colour inside it is that
    node's strong component.  What is found is taken off, and the rest is searched again.
    Tables stay as long as the links and nodes are."""
    distinct = written(links.select("a", "b").distinct())
    found = distinct.filter("a = b").select(F.col("a").alias("id"))
    now = distinct.filter("a <> b")
    edges_sum = F.sum(F.xxhash64("id", "colour").cast("decimal(38,0)"))
    if now.count() > LOCAL_LINKS:
        now = _trimmed(written(now))
    while now.count() > LOCAL_LINKS:
        nodes = written(now.select(F.col("a").alias("id")).distinct().withColumn("colour", F.col("id")))

        def reached(state: DataFrame, now: DataFrame = now) -> DataFrame:
            ahead = now.join(state.select(F.col("id").alias("a"), "colour"), "a").groupBy(F.col("b").alias("id")).agg(F.max("colour").alias("ahead"))
            return state.join(ahead, "id", "left").select("id", F.greatest("colour", "ahead").alias("colour"))

        colours = _settled(nodes, reached, edges_sum)
        inside = now.join(colours.select(F.col("id").alias("a"), F.col("colour").alias("ca")), "a").join(colours.select(F.col("id").alias("b"), F.col("colour").alias("cb")), "b")
        inside = written(inside.filter("ca = cb").select("a", "b", F.col("ca").alias("colour")))
        members = written(colours.filter("id = colour"))

        def back(state: DataFrame, inside: DataFrame = inside) -> DataFrame:
            return state.unionByName(inside.join(state.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id"), "colour")).distinct()

        members = _settled(members, back, edges_sum)
        several = members.join(members.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "colour", "left_semi").select("id")
        found = written(found.unionByName(several))
        gone = members.select("id")
        rest = now.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti")
        now = _trimmed(written(rest.select("a", "b")))
    return found.unionByName(_on_cycle_here(now)).distinct()


def cycle_path(tickets: DataFrame, start: str, target: str) -> list[str]:
    """The cycle that a blocker `target` of `start` would close, [] for none: the first path
    found depth first in the order of the lists.  Only tickets that the target waits for are
    read, a level of them at a time."""
    blockers: dict[str, list[str]] = {}
    level = [target]
    while level:
        rows = tickets.filter(F.col("id").isin(level)).select("id", "blocked_by").collect()  # one level of one ticket's blockers
        blockers |= {x: [] for x in level} | {r["id"]: list(r["blocked_by"] or ()) for r in rows}
        level = sorted({x for r in rows for x in r["blocked_by"] or ()} - set(blockers))
    return first_cycle(blockers, start, target)


def first_cycle(blockers: dict[str, list[str]], start: str, target: str) -> list[str]:
    """The cycle that an edge start -> target would close: the first path found depth
    first in the order of the lists, for one question on the driver."""
    seen: set[str] = set()
    stack: list[tuple[str, list[str]]] = [(target, [start, target])]
    while stack:
        node, path = stack.pop()
        if node == start:
            return path
        if node in seen:
            continue
        seen.add(node)
        stack += [(x, [*path, x]) for x in reversed(blockers.get(node, []))]
    return []
