"""Differences between a listing and an index, upserts, and replay of a log."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.plans.stage import written


def diff(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Every key of either side with its action: inserted, updated, deleted or skipped.
    A row is skipped if all compared columns are equal, nulls too."""
    o = old.select(key, F.struct(*compared).alias("old"), F.lit(True).alias("was"))
    n = new.select(key, F.struct(*compared).alias("new"), F.lit(True).alias("now"))
    action = (
        F.when(F.col("was").isNull(), "inserted").when(F.col("now").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "skipped").otherwise("updated")
    )
    return n.join(o, key, "full_outer").select(key, action.alias("action"))


def counts(actions: DataFrame) -> DataFrame:
    """One row: inserted, updated, deleted, skipped, and total, the rows there are then."""
    n = {a: F.count_if(F.col("action") == a) for a in ("inserted", "updated", "deleted", "skipped")}
    return actions.agg(*(v.alias(k) for k, v in n.items()), (n["inserted"] + n["updated"] + n["skipped"]).alias("total"))


def reconcile(old: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows of old that are still named, as they are, and new names with nothing else."""
    kept = old.join(names.select(key), key, "left_semi")
    return kept.unionByName(names.select(key).join(old, key, "left_anti"), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str, unique: list[list[str]] = ()) -> DataFrame:
    """old with the rows of new put in by key.  Rows of old that collide with a new row
    in unique columns go as well."""
    kept = old.join(new.select(key), key, "left_anti")
    for columns in unique:
        kept = kept.join(new.select(*columns), columns, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def last_wins(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, which combines before the shuffle, so a key
    that holds a large part of the log costs each task one row."""
    others = [c for c in log.columns if c != key]
    latest = log.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"))
    return latest.select(key, *(F.col("last")[c].alias(c) for c in others))


def replay(index: DataFrame, log: DataFrame, key: str, order: list[str], op: str = "op") -> DataFrame:
    """index after the log: deletes first, then puts; replaying twice changes nothing."""
    last = last_wins(log, key, order)
    puts = last.filter(F.col(op) == "put").select(*index.columns)
    return index.join(last.select(key), key, "left_anti").unionByName(puts)


def write_conflicts(index: DataFrame, log: DataFrame, key: str, kind: str = "kind") -> DataFrame:
    """Ops that committed state forbids: creates of what is there, updates of what is not."""
    there = index.select(key, F.lit(True).alias("there"))
    joined = log.join(there, key, "left")
    error = F.when((F.col(kind) == "create") & F.col("there"), "already exists").when((F.col(kind) == "update") & F.col("there").isNull(), "not found")
    return joined.withColumn("error", error).filter("error is not null").drop("there")


def log_faults() -> Column:
    """The first fault of a log record (op, kind, id, path, content), null for none."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(~F.coalesce(F.col("op"), F.lit("")).isin("put", "delete"), "unknown op")
        .when(empty("kind"), "missing kind")
        .when(~F.col("kind").isin("create", "update", "delete"), "unknown kind")
        .when((F.col("op") == "put") & (F.col("kind") == "delete"), "invalid kind for put")
        .when((F.col("op") == "delete") & (F.col("kind") != "delete"), "invalid kind for delete")
        .when((F.col("op") == "put") & empty("content"), "missing content for put")
        .when(empty("id"), "empty id")
        .when(empty("path"), "empty path")
    )


#: Which op leads out of which status, and where to.
MACHINE = {"start": ("open", "in_progress"), "close": ("in_progress", "closed"), "reopen": ("closed", "open")}


#: Ops of a key that are folded as one array.
CHUNK = 256


def transitions(events: DataFrame, key: str, order: list[str], op: str) -> DataFrame:
    """The status machine over a log of start, close and reopen.  An op is taken only from
    the status it leads out of; a key begins open.  Returns status after each op and
    whether it was taken.

    The three statuses follow each other in a ring and each op moves along it by one.  A
    key's ops in order are cut into chunks; a chunk is a map of the three statuses, the
    maps of a key follow each other, and each chunk is then folded from the status it
    begins with.  So no row holds more than a chunk, however long a key's log is."""
    ring = [MACHINE[o][0] for o in ("start", "close", "reopen")]
    number = F.when(F.col(op) == "start", 0).when(F.col(op) == "close", 1).when(F.col(op) == "reopen", 2)
    others = [c for c in events.columns if c != key]
    placed = events.withColumn("_op", number).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order, *(F.xxhash64(c) for c in others))))
    held = F.struct("_n", "_op", *others)
    chunks = placed.groupBy(key, F.floor((F.col("_n") - 1) / CHUNK).alias("_chunk")).agg(F.array_sort(F.collect_list(held)).alias("_rows"))

    def moved(at: Column, row: Column) -> Column:
        return F.when(row["_op"].eqNullSafe(at), F.pmod(at + 1, F.lit(3))).otherwise(at).cast("int")

    ends = F.array(*(F.aggregate("_rows", F.lit(k), moved) for k in range(3)))
    # written, as the maps are read twice: to find where each chunk begins, and to fold it
    chunks = written(chunks.withColumn("_ends", ends))

    @F.pandas_udf("array<int>")
    def begins(maps: pd.Series) -> pd.Series:
        def of_key(own: np.ndarray) -> list[int]:
            at, out = 0, []
            for ends in own:
                out.append(at)
                at = int(ends[at])
            return out

        return maps.map(of_key)

    maps = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_ends"))).alias("_maps"))
    first = maps.select(key, F.posexplode(begins(F.transform("_maps", lambda x: x["_ends"]))).alias("_chunk", "_at"))
    started = chunks.join(first.withColumn("_chunk", F.col("_chunk").cast("bigint")), [key, "_chunk"])
    zero = F.struct(F.col("_at").cast("int").alias("at"), F.array().cast("array<struct<at:int,taken:boolean>>").alias("out"))

    def step(state: Column, row: Column) -> Column:
        at = moved(state["at"], row)
        return F.struct(at.alias("at"), F.concat(state["out"], F.array(F.struct(at.alias("at"), (at != state["at"]).alias("taken")))).alias("out"))

    folded = started.withColumn("_out", F.aggregate("_rows", zero, step)["out"])
    flat = folded.select(key, F.explode(F.arrays_zip("_rows", "_out")).alias("z"))
    names = F.array(*map(F.lit, ring))
    return flat.select(key, *(F.col("z._rows")[c].alias(c) for c in others), F.element_at(names, F.col("z._out.at") + 1).alias("status"), F.col("z._out.taken").alias("taken"))
