"""Every query of the document and ticket engine by name, with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import header as H
from quillmill.functions import scalars, tickets as fields
from quillmill.operators import changes, graph
from quillmill.operators import tickets as lists
from quillmill.plans.tables import DIFF_SQL, EDGES_SQL, LOG_SQL, TICKETS_SQL, header_rows, new_documents, old_documents, op_log, table, tickets

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_TICKET = ("id", "status", "priority", "type", "parent", "created")
_COLUMNS = ", ".join(_TICKET)
_UNRESOLVED = """unresolved AS (
  SELECT e.id, e.pos, e.blocker, CASE WHEN b.id IS NULL THEN 'missing' ELSE 'not closed' END AS reason
  FROM edges e LEFT JOIN tickets b ON b.id = e.blocker WHERE b.id IS NULL OR b.status <> 'closed')"""
_CLOSURE = """closure AS (
  SELECT id, parent AS ancestor, 1 AS depth FROM tickets WHERE parent IS NOT NULL
  UNION ALL SELECT c.id, t.parent, c.depth + 1 FROM closure c JOIN tickets t ON t.id = c.ancestor WHERE t.parent IS NOT NULL)"""
_READY = f"""WITH RECURSIVE {TICKETS_SQL}, {EDGES_SQL}, {_UNRESOLVED}, {_CLOSURE},
held AS (SELECT id FROM unresolved UNION SELECT c.id FROM closure c JOIN unresolved u ON u.id = c.ancestor
         UNION SELECT c.id FROM closure c LEFT JOIN tickets t ON t.id = c.ancestor WHERE t.id IS NULL),
ready AS (SELECT t.* FROM tickets t LEFT JOIN tickets p ON p.id = t.parent
          WHERE t.status = 'open' AND t.id NOT IN (SELECT id FROM held) AND (t.parent IS NULL OR p.status <> 'open'))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Lists


def _list(name: str, where: str, **conditions) -> None:
    @query(name, f"WITH {TICKETS_SQL} SELECT {_COLUMNS} FROM tickets WHERE {where}")
    def run(spark, d):
        return lists.by_file_name(lists.matching(tickets(spark, d), **conditions)).select(*_TICKET)


_list("list_all", "true")
_list("list_status", "status = 'open'", status="open")
_list("list_priority", "priority = 1", priority=1)
_list("list_type", "type = 'bug'", type="bug")
_list("list_status_priority_type", "status = 'open' AND priority = 2 AND type = 'task'", status="open", priority=2, type="task")
_list("list_parent", "parent = 't000012'", parent="t000012")
_list("list_roots", "parent IS NULL", roots=True)


@query("list_page", f"WITH {TICKETS_SQL} SELECT * FROM (SELECT {_COLUMNS}, row_number() OVER (ORDER BY id || '.md') AS rn FROM tickets WHERE status = 'open') WHERE rn > 20 AND rn <= 70")
def list_page(spark, d):
    found = lists.matching(tickets(spark, d), status="open").withColumn("file", F.concat("id", F.lit(".md")))
    return lists.numbered_page(found, ["file"], 20, 50).select(*_TICKET, "rn")


@query("list_offset_limit", f"WITH {TICKETS_SQL} SELECT id FROM tickets WHERE priority = 3 ORDER BY id || '.md' LIMIT 40 OFFSET 15")
def list_offset_limit(spark, d):
    return lists.checked_page(lists.by_file_name(lists.matching(tickets(spark, d), priority=3)), 15, 40).select("id")


@query("list_count", f"WITH {TICKETS_SQL} SELECT status, type, count(*) AS n FROM tickets GROUP BY ALL")
def list_count(spark, d):
    return tickets(spark, d).groupBy("status", "type").agg(F.count(F.lit(1)).alias("n"))


@query("list_lines", f"""WITH {TICKETS_SQL} SELECT id, id || ' [' || status || '] - Order ' || id || CASE WHEN parent IS NULL THEN '' ELSE ' (parent: ' || parent || ')' END
  || CASE WHEN len(blocked_by) = 0 THEN '' ELSE ' <- blocked-by: [' || array_to_string(blocked_by, ', ') || ']' END AS line FROM tickets""")  # fmt: skip
def list_lines(spark, d):
    return tickets(spark, d).withColumn("title", F.concat(F.lit("Order "), F.col("id"))).select("id", fields.list_line().alias("line"))


@query("list_json", f"""WITH {TICKETS_SQL} SELECT id, '{{"id":"' || id || '","status":"' || status || '","priority":' || priority || CASE WHEN parent IS NULL THEN '' ELSE ',"parent":"' || parent || '"' END
  || ',"blocked_by":[' || array_to_string(list_transform(blocked_by, lambda x: '"' || x || '"'), ',') || ']}}' AS json FROM tickets""")  # fmt: skip
def list_json(spark, d):
    return tickets(spark, d).select("id", fields.json_object(("id", "status", "priority", "parent", "blocked_by")).alias("json"))


@query("children_all", f"WITH {TICKETS_SQL} SELECT id, status FROM tickets WHERE parent = 't000030'")
def children_all(spark, d):
    return lists.children(tickets(spark, d), "t000030").select("id", "status")


@query("children_open", f"WITH {TICKETS_SQL} SELECT id, status FROM tickets WHERE parent = 't000030' AND status <> 'closed'")
def children_open(spark, d):
    return lists.children(tickets(spark, d), "t000030", open_only=True).select("id", "status")


@query("blocked_by_one", f"WITH {TICKETS_SQL} SELECT id FROM tickets WHERE list_contains(blocked_by, 't000015')")
def blocked_by_one(spark, d):
    return lists.with_blocker(tickets(spark, d), "t000015").select("id")


# Graph


@query("blocker_edges", f"WITH {TICKETS_SQL}, {EDGES_SQL} SELECT id, CAST(pos AS INT) AS pos, blocker FROM edges")
def blocker_edges(spark, d):
    return graph.edges(tickets(spark, d))


@query("stale_blockers", f"WITH {TICKETS_SQL}, {EDGES_SQL} SELECT id, CAST(pos AS INT) AS pos, blocker FROM edges WHERE blocker NOT IN (SELECT id FROM tickets)")
def stale_blockers(spark, d):
    return graph.stale(tickets(spark, d))


@query("repaired_blocked_by", f"""WITH {TICKETS_SQL} SELECT id, array_to_string(list_filter(blocked_by, lambda x: x <> 'missing'), ',') AS blocked_by
  FROM tickets WHERE list_contains(blocked_by, 'missing')""")  # fmt: skip
def repaired_blocked_by(spark, d):
    return graph.repaired(tickets(spark, d)).select("id", F.array_join("blocked_by", ",").alias("blocked_by"))


@query("unresolved_blockers", f"WITH {TICKETS_SQL}, {EDGES_SQL}, {_UNRESOLVED} SELECT id, CAST(pos AS INT) AS pos, blocker, reason FROM unresolved")
def unresolved_blockers(spark, d):
    return graph.unresolved(tickets(spark, d))


@query("ancestors", f"WITH RECURSIVE {TICKETS_SQL}, {_CLOSURE} SELECT id, ancestor, min(depth) AS depth FROM closure GROUP BY ALL")
def ancestors(spark, d):
    return graph.ancestors(tickets(spark, d))


@query("ready", f"{_READY} SELECT {_COLUMNS} FROM ready")
def ready(spark, d):
    return graph.ready(tickets(spark, d)).orderBy("priority", "id").select(*_TICKET)


@query("ready_top10", f"{_READY} SELECT id, priority, row_number() OVER (ORDER BY priority, id) AS rn FROM ready QUALIFY rn <= 10")
def ready_top10(spark, d):
    return lists.numbered_page(graph.ready(tickets(spark, d)), ["priority", "id"], 0, 10).select("id", "priority", "rn")


@query("ready_field", f"{_READY} SELECT type FROM ready")
def ready_field(spark, d):
    return graph.ready(tickets(spark, d)).orderBy("priority", "id").select("type")


@query("ready_lines", f"{_READY} SELECT id || '  [P' || priority || '][' || status || '] - ' || id || CASE WHEN parent IS NULL THEN '' ELSE ' (parent: ' || parent || ')' END AS line FROM ready")
def ready_lines(spark, d):
    return graph.ready(tickets(spark, d)).withColumn("title", F.col("id")).select(fields.ready_line().alias("line"))


@query("start_reasons", f"""{_READY}, own AS (SELECT id, min_by(reason, pos) AS own FROM unresolved GROUP BY id)
SELECT t.id, CASE WHEN t.status <> 'open' THEN 'not open' WHEN o.own = 'missing' THEN 'blocker not found' WHEN o.own IS NOT NULL THEN 'blocked'
  WHEN t.parent IS NOT NULL AND p.id IS NULL THEN 'parent not found' WHEN p.status = 'open' THEN 'parent not started'
  WHEN t.parent IN (SELECT id FROM held) THEN 'ancestor not ready' END AS reason
FROM tickets t LEFT JOIN own o ON o.id = t.id LEFT JOIN tickets p ON p.id = t.parent""")  # fmt: skip
def start_reasons(spark, d):
    return graph.start_reason(tickets(spark, d))


_CYCLE_SQL = f"""{TICKETS_SQL}, {EDGES_SQL},
links AS (SELECT DISTINCT id AS a, blocker AS b FROM edges UNION SELECT blocker, id FROM edges WHERE CAST(substr(id, 2) AS BIGINT) % 50 = 1)"""


@query("cycle_check", f"WITH RECURSIVE {_CYCLE_SQL}, walk AS (SELECT a AS origin, b FROM links WHERE a IN (SELECT b FROM links) UNION SELECT w.origin, l.b FROM walk w JOIN links l ON l.a = w.b) SELECT DISTINCT origin AS id FROM walk WHERE origin = b")
def cycle_check(spark, d):
    found = graph.edges(tickets(spark, d))
    back = found.filter(F.substring("id", 2, 12).cast("bigint") % 50 == 1).select(F.col("blocker").alias("a"), F.col("id").alias("b"))
    return graph.on_cycle(found.select(F.col("id").alias("a"), F.col("blocker").alias("b")).unionByName(back))


# Prefixes and points


@query("prefix_customer", "SELECT c_custkey, c_name FROM customer WHERE starts_with(lower(c_name), lower('cusTOMER#00000001')) ORDER BY c_name LIMIT 50")
def prefix_customer(spark, d):
    return table(spark, d, "customer").filter(scalars.has_prefix(F.col("c_name"), "cusTOMER#00000001")).orderBy("c_name").limit(50).select("c_custkey", "c_name")


@query("prefix_literal_wildcards", "SELECT p_partkey, '50%_' || p_name AS name FROM part WHERE p_partkey % 3 = 0 AND starts_with(lower('50%_' || p_name), lower('50%_' || (SELECT min(substr(p_name, 1, 2)) FROM part)))")
def prefix_literal_wildcards(spark, d):
    part = table(spark, d, "part")
    first = part.agg(F.min(F.substring("p_name", 1, 2))).first()[0]
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("50%_"), "p_name")).otherwise(F.concat(F.lit("50x1"), "p_name"))
    return part.withColumn("name", name).filter(scalars.has_prefix(F.col("name"), "50%_" + first)).select("p_partkey", "name")


@query("point_get", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def point_get(spark, d):
    return table(spark, d, "customer").filter("c_custkey = 7").select("c_custkey", "c_name", "c_acctbal")


@query("exists", "SELECT k, k IN (SELECT c_custkey FROM customer) AS found FROM (VALUES (CAST(1 AS BIGINT)), (3), (999999999)) AS t(k)")
def exists(spark, d):
    wanted = spark.createDataFrame([(1,), (3,), (999999999,)], "k bigint")
    there = table(spark, d, "customer").filter(F.col("c_custkey").isin(1, 3, 999999999)).select(F.col("c_custkey").alias("k"), F.lit(True).alias("yes")).distinct()
    return wanted.join(there, "k", "left").select("k", F.coalesce("yes", F.lit(False)).alias("found"))


# Changes and logs


@query("incremental_diff", f"WITH {DIFF_SQL} SELECT doc_id, action FROM actions")
def incremental_diff(spark, d):
    return changes.diff(old_documents(spark, d), new_documents(spark, d), "doc_id", ["source", "n_chars"])


@query("incremental_counts", f"""WITH {DIFF_SQL} SELECT count(*) FILTER (WHERE action = 'inserted') AS inserted, count(*) FILTER (WHERE action = 'updated') AS updated,
  count(*) FILTER (WHERE action = 'deleted') AS deleted, count(*) FILTER (WHERE action = 'skipped') AS skipped, (SELECT count(*) FROM new) AS total FROM actions""")  # fmt: skip
def incremental_counts(spark, d):
    return changes.counts(incremental_diff(spark, d))


@query("reconcile_names", f"WITH {DIFF_SQL} SELECT n.doc_id, o.source, o.n_chars FROM new n LEFT JOIN old o ON o.doc_id = n.doc_id")
def reconcile_names(spark, d):
    return changes.reconcile(old_documents(spark, d), new_documents(spark, d), "doc_id")


@query("last_op_wins", f"WITH {LOG_SQL} SELECT id, event_id, op, value FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1")
def last_op_wins(spark, d):
    return changes.last_wins(op_log(spark, d), "id", ["ts", "event_id"]).select("id", "event_id", "op", "value")


_BASE_SQL = "base AS (SELECT user_id AS id, min(event_id) AS event_id, CAST(0 AS DOUBLE) AS value FROM events WHERE user_id % 2 = 0 GROUP BY 1 UNION ALL SELECT 1000000 + c_custkey, c_custkey, c_acctbal FROM customer)"


@query("replay_apply", f"""WITH {LOG_SQL}, {_BASE_SQL}, last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1)
SELECT id, event_id, value FROM base WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, event_id, value FROM last WHERE op = 'put'""")  # fmt: skip
def replay_apply(spark, d):
    users = table(spark, d, "events").filter("user_id % 2 = 0").groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("event_id"), F.lit(0.0).alias("value"))
    customers = table(spark, d, "customer").select((F.col("c_custkey") + 1000000).alias("id"), F.col("c_custkey").alias("event_id"), F.col("c_acctbal").alias("value"))
    return changes.replay(users.unionByName(customers), op_log(spark, d), "id", ["ts", "event_id"])


@query("write_conflicts", """SELECT event_id, user_id AS id, CASE WHEN event_type = 'signup' THEN 'already exists' ELSE 'not found' END AS error FROM events
WHERE (event_type = 'signup' AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) OR (event_type = 'view' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))""")  # fmt: skip
def write_conflicts(spark, d):
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "view", "update").otherwise("delete")
    log = table(spark, d, "events").select("event_id", F.col("user_id").alias("id"), kind.alias("kind"))
    index = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return changes.write_conflicts(index, log, "id").select("event_id", "id", "error")


_NEW_SQL = "fresh AS (SELECT c_custkey + 100 AS c_custkey, c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)"


@query("upsert", f"WITH {_NEW_SQL} SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM fresh) UNION ALL SELECT * FROM fresh")
def upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.filter("c_custkey % 3 = 0").select((F.col("c_custkey") + 100).alias("c_custkey"), "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return changes.upsert(old, new, "c_custkey")


@query("upsert_unique", f"WITH {_NEW_SQL} SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM fresh) AND c_name NOT IN (SELECT c_name FROM fresh) UNION ALL SELECT * FROM fresh")
def upsert_unique(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.filter("c_custkey % 3 = 0").select((F.col("c_custkey") + 100).alias("c_custkey"), "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return changes.upsert(old, new, "c_custkey", unique=[["c_name"]])


@query("delete_by_key", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def delete_by_key(spark, d):
    keys = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return changes.delete(table(spark, d, "customer"), keys, "c_custkey").select("c_custkey", "c_name")


@query("status_transitions", """WITH RECURSIVE ops AS (
  SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 END AS op,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
walk AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(0 AS INT) AS state, CAST(NULL AS BIGINT) AS event_id, false AS taken FROM ops GROUP BY ALL
  UNION ALL SELECT w.user_id, o.n, CASE WHEN o.op = w.state THEN (w.state + 1) % 3 ELSE w.state END, o.event_id, o.op = w.state FROM walk w JOIN ops o ON o.user_id = w.user_id AND o.n = w.n + 1)
SELECT user_id, event_id, ['open', 'in_progress', 'closed'][state + 1] AS status, taken FROM walk WHERE event_id IS NOT NULL""")  # fmt: skip
def status_transitions(spark, d):
    op = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "close").otherwise("reopen")
    log = table(spark, d, "events").filter(F.col("event_type").isin("signup", "purchase", "error")).select("user_id", "ts", "event_id", op.alias("op"))
    return changes.transitions(log, "user_id", ["ts", "event_id"], "op").select("user_id", "event_id", "status", "taken")


# Headers and ticket files


@query("fm_roundtrip", "SELECT doc_id, 'doc-' || doc_id AS id, 'No. ' || doc_id AS title, n_chars AS size, n_chars > 2000 AS long, 'src:' || source || ',' || lang AS tags, rtrim(ltrim(text, chr(10) || chr(13)), chr(10)) = rtrim(ltrim(text, chr(10) || chr(13)), chr(10)) AS body_kept FROM documents")
def fm_roundtrip(spark, d):
    rows = H.with_document(header_rows(spark, d), "header", "text", "content").select("doc_id", "text", "content")
    read = H.with_header(rows, "content", H.Options(line_limit=0))
    h = F.col("header")
    kept = F.regexp_replace("body", r"\n+$", "") == F.regexp_replace(F.regexp_replace("text", r"^[\r\n]+", ""), r"\n+$", "")
    return read.select(
        "doc_id", H.get_string(h, "id").alias("id"), H.get_string(h, "title").alias("title"), H.get_int(h, "size").alias("size"), H.get_bool(h, "long").alias("long"),
        F.array_join(H.get_list(h, "tags"), ",").alias("tags"), kept.alias("body_kept"),
    )


@query("fm_get_int", "SELECT doc_id, n_chars AS size FROM documents")
def fm_get_int(spark, d):
    return header_rows(spark, d).select("doc_id", H.get_int(F.col("header"), "size").alias("size"))


@query("fm_get_list", "SELECT doc_id, unnest(['src:' || source, lang]) AS tag FROM documents")
def fm_get_list(spark, d):
    return header_rows(spark, d).select("doc_id", F.explode(H.get_list(F.col("header"), "tags")).alias("tag"))


@query("fm_missing_kind", "SELECT doc_id, CAST(NULL AS BIGINT) AS code_as_int, CAST(NULL AS VARCHAR) AS size_as_text, false AS has_none, true AS has_code, CAST(6 AS INT) AS n FROM documents")
def fm_missing_kind(spark, d):
    h = F.col("header")
    return header_rows(spark, d).select(
        "doc_id", H.get_int(h, "code").alias("code_as_int"), H.get_string(h, "size").alias("size_as_text"), H.has(h, "none").alias("has_none"), H.has(h, "code").alias("has_code"), H.length(h).alias("n")
    )


_FAULTS = """CASE o_orderkey % 8 WHEN 0 THEN 'done' ELSE CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'in_progress' ELSE 'open' END END AS status,
  CASE o_orderkey % 9 WHEN 0 THEN '0' WHEN 1 THEN '2abc' ELSE '3' END AS priority, CASE o_orderkey % 7 WHEN 0 THEN '2024-02-30T00:00:00Z' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS created,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 OR o_orderkey % 13 = 0 THEN '2024-01-01T00:00:00+01:00' END AS closed"""


@query("validate_errors", f"""WITH rows AS (SELECT o_orderkey, {_FAULTS} FROM orders)
SELECT o_orderkey, CASE WHEN status = 'done' THEN 'status' WHEN priority = '0' THEN 'priority' WHEN created LIKE '2024-02-30%' THEN 'created'
  WHEN status = 'closed' AND closed IS NULL THEN 'closed without timestamp' WHEN status <> 'closed' AND closed IS NOT NULL THEN 'timestamp without closed' END AS error FROM rows""")  # fmt: skip
def validate_errors(spark, d):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.lit("1").alias("schema_version"), k.cast("string").alias("id"),
        F.when(k % 8 == 0, "done").when(status == "F", "closed").when(status == "P", "in_progress").otherwise("open").alias("status"), F.lit("bug").alias("type"),
        F.when(k % 9 == 0, "0").when(k % 9 == 1, "2abc").otherwise("3").alias("priority"),
        F.when(k % 7 == 0, "2024-02-30T00:00:00Z").otherwise(scalars.rfc3339(F.col("o_orderdate"))).alias("created"),
        F.when((status == "F") & (k % 5 != 0) | (k % 13 == 0), "2024-01-01T00:00:00+01:00").alias("closed"), F.lit("x").alias("title"),
    )
    return rows.select("o_orderkey", fields.first_fault().alias("error"))


@query("ticket_roundtrip", f"WITH {TICKETS_SQL} SELECT id, status, priority, type, parent, created, array_to_string(blocked_by, ',') AS blocked_by, 'Order ' || id AS title, CASE WHEN status = 'closed' THEN 'closed ticket missing closed timestamp' END AS fault FROM tickets")
def ticket_roundtrip(spark, d):
    none = F.lit(None).cast("string")
    rows = tickets(spark, d).withColumns(
        {"created": F.try_to_timestamp("created"), "title": F.concat(F.lit("Order "), F.col("id"))} | {c: none for c in ("assignee", "external_ref", "description", "design", "acceptance")}
    )
    text = rows.select(F.col("id").alias("key"), "status", fields.written_ticket().alias("content"))
    closed = fields.with_field(F.col("content"), "closed", F.lit("2024-01-01T00:00:00Z"))
    both = text.withColumn("fixed", F.when(F.col("status") == "closed", closed).otherwise(F.col("content"))).select("key", "content", "fixed")
    bad = fields.parsed(both.select("key", "content"), "content").select("key", F.col("error").alias("fault"))
    good = fields.parsed(both.select(F.col("key"), "fixed"), "fixed")
    return good.join(bad, "key").select("id", "status", "priority", "type", "parent", "created", F.array_join("blocked_by", ",").alias("blocked_by"), "title", "fault")


@query("ticket_patch", f"WITH {TICKETS_SQL} SELECT id, 'in_progress' AS status, 'x,y' AS blocked_by, 'me' AS assignee, CAST(NULL AS VARCHAR) AS parent FROM tickets")
def ticket_patch(spark, d):
    none = F.lit(None).cast("string")
    rows = tickets(spark, d).withColumns({"created": F.try_to_timestamp("created"), "title": F.col("id")} | {c: none for c in ("assignee", "external_ref", "description", "design", "acceptance")})
    found = rows.select("id", fields.written_ticket().alias("content"))
    text = F.col("content")  # a patch names its text several times, so each is a step of its own
    for patched in (
        fields.with_field(text, "status", F.lit("in_progress")), fields.with_field(text, "assignee", F.lit("me")),
        fields.with_blockers(text, F.array(F.lit("x"), F.lit("y"))), fields.without_field(text, "parent"),
    ):
        found = found.withColumn("content", patched)
    blocked = F.array_join(fields.blockers(fields.field(F.col("content"), "blocked-by")), ",")
    return found.select("id", *(fields.field(F.col("content"), f).alias(f) for f in ("status", "assignee", "parent")), blocked.alias("blocked_by"))


@query("scalar_ints", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 1 THEN NULL ELSE -7 END AS whole, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE -7 END AS leading FROM orders")
def scalar_ints(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("00"), k.cast("string"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("abc"))).otherwise("-007")
    return table(spark, d, "orders").withColumn("text", text).select("o_orderkey", scalars.whole_int(F.col("text")).alias("whole"), scalars.leading_int(F.col("text")).alias("leading"))




# Related tables kept by hooks


@query("tags_related", "SELECT doc_id, unnest(['src:' || source, lang]) AS tag, CAST(unnest([0, 1]) AS INT) AS pos FROM documents")
def tags_related(spark, d):
    return header_rows(spark, d).select("doc_id", F.posexplode(H.get_list(F.col("header"), "tags")).alias("pos", "tag"))


@query("tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(['src:' || source, lang]) AS tag FROM documents) GROUP BY tag")
def tag_counts(spark, d):
    return tags_related(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


# SQL over views


def _sql(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    @query(name, duck_sql or spark_sql)
    def run(spark, d):
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            if f" {t}" in spark_sql:
                table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(spark_sql)


_sql("sql_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1")
_sql("sql_join", "SELECT n.n_name, r.r_name, count(*) AS customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_acctbal > 0 GROUP BY n.n_name, r.r_name")
_sql("sql_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_sql("sql_window", "SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, lag(o_orderkey) OVER w AS before, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_sql("sql_setops", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
_sql("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id() AS INT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS INT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("sql_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, (SELECT count(*) FROM region WHERE r_regionkey < n) AS below FROM t")
_sql("sql_case_filter", "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal BETWEEN 0 AND 1000) AS small, sum(CASE WHEN c_nationkey IN (1, 2, 3) THEN 1 ELSE 0 END) AS near, coalesce(nullif(min(c_name), ''), '-') AS first FROM customer WHERE c_name LIKE 'Customer%' GROUP BY c_mktsegment")
_sql("sql_string_agg", "SELECT r_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey", "SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
_sql("sql_json", "SELECT event_id, get_json_object(props, '$.page') AS page FROM events", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
_sql("sql_order_nulls", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey NULLS FIRST, o_orderkey DESC LIMIT 25 OFFSET 5")
