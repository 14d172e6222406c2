"""The benchmark tables as collections of tickets, documents and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.tickets import TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(number):
    return F.format_string("t%06d", number)


def tickets(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Orders as tickets, all or those given: parents form a tree of tens, blockers point
    back, some to tickets that do not exist."""
    k = F.col("o_orderkey")
    types = F.array(*map(F.lit, TYPES))
    blockers = F.array(
        F.when(k % 3 == 1, _id(k - 1)), F.when(k % 4 == 2, _id(F.floor(k / 2).cast("bigint"))), F.when(k % 97 == 0, F.lit("missing"))
    )
    return (table(spark, sf_dir, "orders") if orders is None else orders).select(
        _id(k).alias("id"),
        F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("open").alias("status"),
        F.least(F.lit(4), F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.element_at(types, (k % 5 + 1).cast("int")).alias("type"),
        F.when((k >= 10) & (k % 10 != 0), _id(F.floor(k / 10).cast("bigint"))).alias("parent"),
        F.filter(blockers, lambda x: x.isNotNull()).alias("blocked_by"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"),
    )


#: The same for DuckDB.
TICKETS_SQL = """
tickets AS (
  SELECT printf('t%06d', o_orderkey) AS id,
         CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'in_progress' ELSE 'open' END AS status,
         least(4, CAST(substr(o_orderpriority, 1, 1) AS INT)) AS priority,
         ['bug', 'feature', 'task', 'epic', 'chore'][CAST(o_orderkey % 5 + 1 AS INT)] AS type,
         CASE WHEN o_orderkey >= 10 AND o_orderkey % 10 <> 0 THEN printf('t%06d', o_orderkey // 10) END AS parent,
         list_filter([CASE WHEN o_orderkey % 3 = 1 THEN printf('t%06d', o_orderkey - 1) END,
                      CASE WHEN o_orderkey % 4 = 2 THEN printf('t%06d', o_orderkey // 2) END,
                      CASE WHEN o_orderkey % 97 = 0 THEN 'missing' END], lambda x: x IS NOT NULL) AS blocked_by,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created
  FROM orders
)"""

EDGES_SQL = "edges AS (SELECT id, unnest(blocked_by) AS blocker, unnest(range(len(blocked_by))) AS pos FROM tickets)"


def old_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state of documents before: a seventh missing."""
    return table(spark, sf_dir, "documents").filter(F.col("doc_id") % 7 != 0).select("doc_id", "source", "n_chars")


def new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state after: another eleventh missing, a fifth changed."""
    changed = F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "documents").filter(F.col("doc_id") % 11 != 0).select("doc_id", "source", changed.alias("n_chars"))


DIFF_SQL = """
old AS (SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 7 <> 0),
new AS (SELECT doc_id, source, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 11 <> 0),
actions AS (
  SELECT coalesce(new.doc_id, old.doc_id) AS doc_id,
         CASE WHEN old.doc_id IS NULL THEN 'inserted' WHEN new.doc_id IS NULL THEN 'deleted'
              WHEN old.source IS NOT DISTINCT FROM new.source AND old.n_chars IS NOT DISTINCT FROM new.n_chars THEN 'skipped' ELSE 'updated' END AS action
  FROM new FULL OUTER JOIN old ON new.doc_id = old.doc_id
)"""


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of puts and deletes of users, in the order of time."""
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", "event_id", kind.alias("op"), "value")


LOG_SQL = "log AS (SELECT user_id AS id, ts, event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events)"


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a header of every kind of value, and a body."""
    from quillmill.functions import header as H

    tags = F.array(F.concat(F.lit("src:"), F.col("source")), F.col("lang"))
    header = F.array(
        H.string_entry("id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))), H.string_entry("title", F.concat(F.lit("No. "), F.col("doc_id").cast("string"))),
        H.int_entry("size", F.col("n_chars")), H.bool_entry("long", F.col("n_chars") > 2000), H.list_entry("tags", tags),
        H.string_entry("code", (F.col("doc_id") * 7).cast("string")),
    )
    return table(spark, sf_dir, "documents").select("doc_id", "text", header.alias("header"))
