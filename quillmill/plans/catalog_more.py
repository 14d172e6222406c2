"""Queries of headers, scalars, lists, ticket writes and the SQL surface, with their oracles."""

from __future__ import annotations

import os
import threading
import time

from pyspark.sql import functions as F

from quillmill.functions import header as H
from quillmill.functions import scalars
from quillmill.functions import tickets as fields
from quillmill.operators import graph, search
from quillmill.operators import tickets as lists
from quillmill.plans import board, settings
from quillmill.plans.catalog import _sql, query
from quillmill.plans.catalog_store import _folder
from quillmill.plans.dml import Tables
from quillmill.plans.locks import Busy, Lock, ticket_lock
from quillmill.plans.tables import EDGES_SQL, TICKETS_SQL, header_rows, table, tickets
from quillmill.plans.ticket_index import STATUS_CODES, TYPE_CODES, code_of, name_of

# Headers


def _texts(spark, d):
    """A header of every form for each document."""
    n = F.col("doc_id").cast("string")
    lines = F.concat(
        F.lit("---\nid: 'd-"), n, F.lit("'\ntitle: \"Tab\\there \\u00e9 "), n, F.lit("\"\nsize: "), n, F.lit("\nminus: -"), n, F.lit("\nzeros: 00"), n, F.lit("\nplus: +"), n,
        F.lit("\nyes: true\nno: false\nword: truely\nlist:\n  - a\n  - 'b c'\n  - "), n, F.lit("\ninline: [x, y "), n, F.lit("]\nnone: []\nobj:\n  k: "), n, F.lit("\n  s: \"7\"\n  f: false\n---\n\n\nbody "), n, F.lit("\n---\nmore\n"),
    )
    return table(spark, d, "documents").select("doc_id", lines.alias("content"))


@query("fm_kinds", """SELECT doc_id, 'd-' || doc_id AS id, 'Tab' || chr(9) || 'here é ' || doc_id AS title, doc_id AS size, -doc_id AS minus, doc_id AS zeros, '+' || doc_id AS plus, true AS yes, false AS no, 'truely' AS word,
  'a|b c|' || doc_id AS list, 'x|y ' || doc_id AS inline, '' AS none, CAST(doc_id AS BIGINT) AS k, '7' AS s, 'bool' AS f_kind, 'object' AS obj_kind, 'body ' || doc_id || chr(10) || '---' || chr(10) || 'more' || chr(10) AS body, CAST(NULL AS VARCHAR) AS error FROM documents""")  # fmt: skip
def fm_kinds(spark, d):
    h = F.col("header")
    items = lambda key: F.array_join(H.get_list(h, key), "|").alias(key)
    return H.with_header(_texts(spark, d), "content").select(
        "doc_id", *(H.get_string(h, k).alias(k) for k in ("id", "title", "plus", "word")), *(H.get_int(h, k).alias(k) for k in ("size", "minus", "zeros")), *(H.get_bool(h, k).alias(k) for k in ("yes", "no")),
        items("list"), items("inline"), items("none"), H.object_value(h, "obj", "k")["i"].alias("k"), H.object_value(h, "obj", "s")["s"].alias("s"), H.object_value(h, "obj", "f")["kind"].alias("f_kind"),
        H.get(h, "obj")["kind"].alias("obj_kind"), "body", "error",
    )


@query("fm_objects", "SELECT doc_id, 3 AS n, 'k,s,f' AS keys, CAST(NULL AS INT) AS of_list FROM documents")
def fm_objects(spark, d):
    h = F.col("header")
    found = H.get_object(h, "obj")
    return H.with_header(_texts(spark, d), "content").select("doc_id", F.size(found).alias("n"), F.array_join(F.transform(found, lambda x: x["key"]), ",").alias("keys"), F.try_element_at(F.array(F.size(H.get_object(h, "list"))), F.lit(1)).alias("of_list"))


@query("fm_set", "SELECT doc_id, 'New' AS title, doc_id + 1 AS size, 'x' AS fresh, 7 AS n, 1 AS place_of_title FROM documents")
def fm_set(spark, d):
    """Values are set in place, or at the end."""
    rows = header_rows(spark, d)
    for entry in (H.string_entry("title", F.lit("New")), H.int_entry("size", F.col("doc_id") + 1), H.string_entry("fresh", F.lit("x"))):
        rows = rows.withColumn("header", H.set_entry(F.col("header"), entry))
    h = F.col("header")
    place = F.array_position(F.transform(h, lambda x: x["key"]), "title") - 1
    return rows.select("doc_id", H.get_string(h, "title").alias("title"), H.get_int(h, "size").alias("size"), H.get_string(h, "fresh").alias("fresh"), H.length(h).alias("n"), place.cast("int").alias("place_of_title"))


_FORMS = {
    "no fence": ("id: a\n", H.Options(), None), "fence not wanted": ("id: a\n", H.Options(require_fence=False), "1"), "not closed": ("---\nid: a\n", H.Options(), None),
    "too long": ("---\na: 1\nb: 2\nc: 3\n---\n", H.Options(line_limit=2), None), "no limit": ("---\na: 1\nb: 2\nc: 3\n---\n", H.Options(line_limit=0), "3"), "windows": ("---\r\na: 1\r\n---\r\nx\r\n", H.Options(), "1"),
    "comment": ("---\n# a\n---\n", H.Options(), None), "tab": ("---\na:\n\t- x\n---\n", H.Options(), None), "twice": ("---\na: 1\na: 2\n---\n", H.Options(), None), "no blank": ("---\na:1\n---\n", H.Options(), None),
    "two blanks": ("---\na:  1\n---\n", H.Options(), None), "open quote": ("---\na: 'x\n---\n", H.Options(), None), "anchor": ("---\na: &x 1\n---\n", H.Options(), None), "inline object": ("---\na: {b: 1}\n---\n", H.Options(), None),
    "open list": ("---\na: [x\n---\n", H.Options(), None), "list gap": ("---\na: [x,y]\n---\n", H.Options(), None), "deeper": ("---\na:\n  - x\n    - y\n---\n", H.Options(), None), "no block": ("---\na:\n---\n", H.Options(), None),
    "nothing": ("---\n---\n", H.Options(), "0"), "least number": ("---\na: -9223372036854775808\n---\n", H.Options(), "1"),
}


@query("fm_forms", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {repr(n) if n else 'NULL'})" for k, (_, _, n) in _FORMS.items()) + ") AS t(form, entries)")
def fm_forms(spark, d):
    """Which headers are well formed, and how many entries they have."""
    out = None
    for options in dict.fromkeys(o for _, o, _ in _FORMS.values()):
        own = [(form, text) for form, (text, o, _) in _FORMS.items() if o == options]
        rows = H.with_header(spark.createDataFrame(own, "form string, content string").coalesce(1), "content", options)
        rows = rows.select("form", F.when(F.col("error").isNull(), F.size("header").cast("string")).alias("entries"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("fm_trim", "SELECT doc_id, 'body ' || doc_id || chr(10) || '---' || chr(10) || 'more' || chr(10) AS trimmed, chr(10) || chr(10) || 'body ' || doc_id || chr(10) || '---' || chr(10) || 'more' || chr(10) AS whole FROM documents")
def fm_trim(spark, d):
    rows = H.with_header(_texts(spark, d), "content").select("doc_id", "content", F.col("body").alias("trimmed"))
    return H.with_header(rows, "content", H.Options(trim_body=False)).select("doc_id", "trimmed", F.col("body").alias("whole"))


def _written(spark, d, **how):
    return H.with_text(header_rows(spark, d), "header", "text", **how).select("doc_id", "text")


_LINES = {"id": "'id: doc-' || doc_id", "title": "'title: No. ' || doc_id", "size": "'size: ' || n_chars", "long": "'long: ' || (n_chars > 2000)", "code": "'code: \"' || (doc_id * 7) || '\"'", "tags": "'tags:' || chr(10) || '  - src:' || source || chr(10) || '  - ' || lang"}


def _sql_lines(keys, fences=True):
    body = " || chr(10) || ".join(_LINES[k] for k in keys) + " || chr(10)"
    return f"'---' || chr(10) || {body} || '---' || chr(10)" if fences else body


@query("fm_write", f"SELECT doc_id, {_sql_lines(['code', 'id', 'long', 'size', 'tags', 'title'])} AS text FROM documents")
def fm_write(spark, d):
    return _written(spark, d)


@query("fm_write_first", f"SELECT doc_id, {_sql_lines(['title', 'id', 'code', 'long', 'size', 'tags'], False)} AS text FROM documents")
def fm_write_first(spark, d):
    return _written(spark, d, fences=False, first=("title", "id"))


@query("fm_write_order", f"SELECT doc_id, {_sql_lines(['size', 'id'])} AS text FROM documents")
def fm_write_order(spark, d):
    """Keys that the order does not name are left out."""
    return _written(spark, d, order=("size", "id"))


@query("fm_quoting", """SELECT * FROM (VALUES ('', true), ('true', true), ('123', true), ('-12', true), ('[a]', true), ('{a}', true), ('- x', true), ('"q"', true), (' lead', true), ('trail ', true), ('a' || chr(10) || 'b', true),
  ('a # b', true), ('plain', false), ('a: b', false), ('12a', false)) AS t(value, quoted)""")  # fmt: skip
def fm_quoting(spark, d):
    """What is written in quotes, and that all of it is read back."""
    values = ["", "true", "123", "-12", "[a]", "{a}", "- x", '"q"', " lead", "trail ", "a\nb", "a # b", "plain", "a: b", "12a"]
    out = []
    for v in values:
        text = H.serialize([{"key": "k", "kind": "string", "s": v}])
        if H.parse(text)[0][0]["s"] == v:
            out.append((v, '"' in text.splitlines()[1][:4]))
    return spark.createDataFrame(out, "value string, quoted boolean")


# Scalars

_DIGIT = f"substr('{scalars.BASE32}', CAST(((n >> {{}}) & 31) + 1 AS INT), 1)"


def _base32(digits: int) -> str:
    return " || ".join(_DIGIT.format(5 * k) for k in reversed(range(digits)))


@query("time_ids", f"SELECT o_orderkey, {_base32(7)} AS id FROM (SELECT o_orderkey, (CAST(epoch(o_orderdate) AS BIGINT) & 4294967295) << 3 AS n FROM orders)")
def time_ids(spark, d):
    stamped = table(spark, d, "orders").select("o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return stamped.select("o_orderkey", scalars.time_id(F.col("at")).alias("id"))


@query("uuid_ids", f"""WITH s AS (SELECT o_orderkey, ((o_orderkey % 4096) << 48) | (((o_orderkey % 16384) << 48 | (o_orderkey * 7919)) >> 14) AS n FROM orders)
SELECT o_orderkey, upper({_base32(12)}) AS short, strftime(make_timestamp((1700000000000 + o_orderkey * 1000) * 1000), '%Y/%m-%d') || '/' || upper({_base32(12)}) || '.md' AS path FROM s""")  # fmt: skip
def uuid_ids(spark, d):
    k = F.col("o_orderkey")
    pad = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    plain = F.concat(pad(1700000000000 + k * 1000, 12), F.lit("7"), pad(k % 4096, 3), pad(32768 + k % 16384, 4), pad(k * 7919, 12))
    dashed = F.concat_ws("-", *(F.substring(plain, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return table(spark, d, "orders").select("o_orderkey", scalars.uuid_short(dashed).alias("short"), scalars.uuid_path(dashed).alias("path"))


@query("id_suffixes", """SELECT n, CASE WHEN n = 0 THEN 'base' WHEN n <= 26 THEN 'base' || chr(CAST(96 + n AS INT)) ELSE 'base' || chr(CAST(97 + (n - 27) // 26 AS INT)) || chr(CAST(97 + (n - 1) % 26 AS INT)) END AS id
  FROM (SELECT unnest(range(0, 700)) AS n)""")  # fmt: skip
def id_suffixes(spark, d):
    return spark.range(700).select(F.col("id").alias("n"), scalars.suffixed(F.lit("base"), F.col("id")).alias("id"))


_SQL_BYTES = "list_transform(range(1, len(hex(encode(p_name))) + 1, 2), lambda i: CAST(('0x' || substr(hex(encode(p_name)), i, 2)) AS BIGINT))"


@query("fnv_checksums", f"SELECT p_partkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {_SQL_BYTES}), lambda h, b: (xor(h, b) * 16777619) & 4294967295) & 2147483647 AS fnv FROM part")
def fnv_checksums(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.fnv1a31_of(F.col("p_name")).alias("fnv"))


def _crc_step(inner: str, bits: int) -> str:
    """Eight shifts of a byte-wise checksum, as a chain of reductions."""
    return f"list_reduce(list_prepend({inner}, range({bits})), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 2197175160 ELSE 0 END))"


@query("crc_checksums", f"SELECT p_partkey, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_SQL_BYTES}), lambda h, b: {_crc_step('xor(h, b)', 8)}), 4294967295) AS crc FROM part")
def crc_checksums(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.crc32c_of(F.col("p_name")).alias("crc"))


@query("codes", f"""WITH {TICKETS_SQL} SELECT id, CASE status WHEN 'open' THEN 0 WHEN 'in_progress' THEN 1 WHEN 'closed' THEN 2 END AS status_code, CAST(CAST(substr(id, 2) AS BIGINT) % 5 AS INT) AS type_code, status, 'bug' AS unknown_type, 0 AS unknown FROM tickets""")
def codes(spark, d):
    coded = tickets(spark, d).withColumns({"status_code": code_of("status", STATUS_CODES), "type_code": code_of("type", TYPE_CODES), "odd": F.lit(99)})
    return coded.select("id", "status_code", "type_code", name_of("status_code", STATUS_CODES).alias("status"), name_of("odd", TYPE_CODES).alias("unknown_type"), code_of("id", STATUS_CODES).alias("unknown"))


@query("times", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS written, true AS valid, false AS no_zone, false AS no_day, o_orderdate < TIMESTAMP '1995-01-01' AS early, CAST(epoch(o_orderdate) AS BIGINT) - 3600 AS moved FROM orders""")
def times(spark, d):
    text = scalars.rfc3339(F.col("o_orderdate"))
    moved = F.replace(text, F.lit("Z"), F.lit("+01:00"))
    return table(spark, d, "orders").select(
        "o_orderkey", text.alias("written"), scalars.is_rfc3339(text).alias("valid"), scalars.is_rfc3339(F.replace(text, F.lit("Z"))).alias("no_zone"), scalars.is_rfc3339(F.concat(F.lit("2023-02-29"), F.substring(text, 11, 20))).alias("no_day"),
        (scalars.instant(text) < F.lit("1995-01-01T00:00:00Z").cast("timestamp")).alias("early"), F.unix_seconds(scalars.instant(moved)).alias("moved"),
    )


@query("like_escapes", r"SELECT p_partkey, p_name || '%_\' AS name FROM part WHERE p_partkey % 2 = 0")
def like_escapes(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("%_\\"))).otherwise(F.concat("p_name", F.lit("xy/")))
    return table(spark, d, "part").select("p_partkey", name.alias("name")).filter(F.col("name").like("%" + scalars.escape_like("%_\\")))


@query("validity", f"WITH {TICKETS_SQL} SELECT id, true AS status_ok, true AS type_ok, priority <= 2 AS half_ok FROM tickets")
def validity(spark, d):
    low, high = fields.PRIORITIES
    return tickets(spark, d).select("id", F.col("status").isin(*fields.STATUSES).alias("status_ok"), F.col("type").isin(*fields.TYPES).alias("type_ok"), (F.col("priority") + 2).between(low, high).alias("half_ok"))


@query("array_edits", """SELECT o_orderkey, o_orderkey % 3 = 1 AS has, CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 0 END AS place, CASE WHEN o_orderkey % 3 = 1 THEN 'a,c,d' ELSE 'a,x,c,d' END AS edited FROM orders""")
def array_edits(spark, d):
    items = F.array(F.lit("a"), F.when(F.col("o_orderkey") % 3 == 1, "b").otherwise("x"), F.lit("c"))
    return table(spark, d, "orders").select("o_orderkey", F.array_contains(items, "b").alias("has"), F.array_position(items, "b").cast("int").alias("place"), F.array_join(F.array_append(F.filter(items, lambda x: x != "b"), "d"), ",").alias("edited"))


# Lists


@query("list_json_array", f"""WITH {TICKETS_SQL}, page AS (SELECT * FROM tickets WHERE status = 'open' ORDER BY id || '.md' LIMIT 50)
SELECT '[' || string_agg('{{"id":"' || id || '","status":"' || status || '","type":"' || type || '","priority":' || priority || CASE WHEN parent IS NULL THEN '' ELSE ',"parent":"' || parent || '"' END
  || ',"blocked_by":[' || array_to_string(list_transform(blocked_by, lambda x: '"' || x || '"'), ',') || ']}}', ',' ORDER BY id) || ']' AS json FROM page""")  # fmt: skip
def list_json_array(spark, d):
    page = lists.page(lists.by_file_name(lists.matching(tickets(spark, d), status="open")), limit=50)
    return fields.json_array(page, ["id"], ("id", "status", "type", "priority", "parent", "blocked_by"))


@query("list_fields", f"""WITH {TICKETS_SQL}, t AS (SELECT *, 'Say "' || id || '"' AS title FROM tickets)
SELECT id, name, CASE name WHEN 'id' THEN id WHEN 'priority' THEN CAST(priority AS VARCHAR) WHEN 'status' THEN status WHEN 'type' THEN type WHEN 'title' THEN title WHEN 'parent' THEN coalesce(parent, '') ELSE created END AS text,
  CASE name WHEN 'priority' THEN CAST(priority AS VARCHAR) WHEN 'id' THEN '"' || id || '"' WHEN 'status' THEN '"' || status || '"' WHEN 'type' THEN '"' || type || '"' WHEN 'title' THEN '"Say \\"' || id || '\\""' WHEN 'parent' THEN '"' || coalesce(parent, '') || '"' ELSE '"' || created || '"' END AS json
FROM t, (SELECT unnest(['id', 'priority', 'status', 'type', 'title', 'parent', 'created']) AS name)""")  # fmt: skip
def list_fields(spark, d):
    rows = tickets(spark, d).withColumn("title", F.concat(F.lit('Say "'), F.col("id"), F.lit('"')))
    each = F.array(*(F.struct(F.lit(n).alias("name"), fields.shown_field(n).alias("text"), fields.field_json(n).alias("json")) for n in fields.SHOWN))
    return rows.select("id", F.inline(each))


@query("page_with_blockers", f"""WITH {TICKETS_SQL}, page AS (SELECT *, row_number() OVER (ORDER BY priority, id) AS rn FROM tickets QUALIFY rn > 10 AND rn <= 60),
listed AS (SELECT rn, id, status, unnest(CASE WHEN len(blocked_by) = 0 THEN [NULL] ELSE blocked_by END) AS blocker, unnest(CASE WHEN len(blocked_by) = 0 THEN [NULL] ELSE range(len(blocked_by)) END) AS pos FROM page)
SELECT rn, l.id, l.status, CAST(pos AS INT) AS pos, blocker, t.status AS blocker_status FROM listed l LEFT JOIN tickets t ON t.id = l.blocker""")  # fmt: skip
def page_with_blockers(spark, d):
    return lists.page_with_blockers(tickets(spark, d), ["priority", "id"], 10, 50)


@query("list_errors", """SELECT * FROM (VALUES ('parent and roots', 'ValueError'), ('status', 'ValueError'), ('type', 'ValueError'), ('priority', 'ValueError'), ('offset', 'OutOfBounds'), ('negative', 'ValueError'), ('last offset', 'none')) AS t("case", error)""")
def list_errors(spark, d):
    rows = tickets(spark, d)
    n = rows.count()
    tried = {
        "parent and roots": lambda: lists.matching(rows, parent="x", roots=True), "status": lambda: lists.matching(rows, status="done"), "type": lambda: lists.matching(rows, type="x"), "priority": lambda: lists.matching(rows, priority=5),
        "offset": lambda: lists.checked_page(rows, n), "negative": lambda: lists.checked_page(rows, -1), "last offset": lambda: lists.checked_page(rows, n - 1),
    }
    out = []
    for case, act in tried.items():
        try:
            act()
            out.append((case, "none"))
        except ValueError as wrong:
            out.append((case, type(wrong).__name__))
    return spark.createDataFrame(out, "case string, error string")


@query("list_match_count", f"WITH {TICKETS_SQL} SELECT count(*) AS n FROM tickets WHERE status = 'open' AND type = 'bug'")
def list_match_count(spark, d):
    return spark.createDataFrame([(lists.match_count(tickets(spark, d), status="open", type="bug"),)], "n bigint")


@query("list_by_creation", f"WITH {TICKETS_SQL} SELECT id, created, row_number() OVER (ORDER BY created, id) AS rn FROM tickets QUALIFY rn <= 200")
def list_by_creation(spark, d):
    return lists.numbered_page(tickets(spark, d), ["created", "id"], 0, 200).select("id", "created", "rn")


@query("list_oldest", f"WITH {TICKETS_SQL} SELECT id FROM tickets ORDER BY created, id LIMIT 30")
def list_oldest(spark, d):
    return lists.by_creation(tickets(spark, d)).limit(30).select("id")


@query("ready_offset", f"WITH {TICKETS_SQL} SELECT id FROM tickets WHERE status = 'open' ORDER BY priority, created, id LIMIT 25 OFFSET 40")
def ready_offset(spark, d):
    return lists.ready_page(lists.matching(tickets(spark, d), status="open"), 40, 25).select("id")


@query("ticket_faults", f"WITH {TICKETS_SQL} SELECT id, CASE WHEN status = 'closed' THEN 'closed ticket missing closed timestamp' END AS error, status <> 'closed' AS good FROM tickets")
def ticket_faults(spark, d):
    """Files that cannot be read stand beside those that can."""
    none = F.lit(None).cast("string")
    rows = tickets(spark, d).withColumns({"created": F.try_to_timestamp("created"), "title": F.col("id")} | {c: none for c in ("assignee", "external_ref", "description", "design", "acceptance")})
    found = fields.parsed(rows.select(F.col("id").alias("key"), fields.written_ticket().alias("content")), "content")
    return found.select(F.col("key").alias("id"), "error", F.col("id").isNotNull().alias("good"))


@query("ticket_bodies", f"WITH {TICKETS_SQL} SELECT id, '# ' || id || chr(10) AS body, 'New text' AS edited, status FROM tickets")
def ticket_bodies(spark, d):
    """A body is replaced, the header stays."""
    none = F.lit(None).cast("string")
    rows = tickets(spark, d).withColumns({"created": F.try_to_timestamp("created"), "title": F.col("id")} | {c: none for c in ("assignee", "external_ref", "description", "design", "acceptance")})
    edited = rows.select("id", fields.written_ticket().alias("content")).withColumn("edited", fields.with_body(F.col("content"), F.lit("New text")))
    return edited.select("id", fields.body(F.col("content")).alias("body"), fields.body(F.col("edited")).alias("edited"), fields.field(F.col("edited"), "status").alias("status"))


# Cycles and ticket writes


@query("cycle_path", """SELECT * FROM (VALUES ('t000003', 't000007', 't000003 > t000007 > t000006 > t000003'), ('t000007', 't000003', ''), ('t000005', 't000005', 't000005 > t000005'), ('t000009', 't000019', 't000009 > t000019 > t000018 > t000009')) AS t(start, target, path)""")
def cycle_path(spark, d):
    rows = tickets(spark, d)
    asked = [("t000003", "t000007"), ("t000007", "t000003"), ("t000005", "t000005"), ("t000009", "t000019")]
    return spark.createDataFrame([(a, b, " > ".join(graph.cycle_path(rows, a, b))) for a, b in asked], "start string, target string, path string")


_NUMBER = "CAST(substr(id, 2) AS BIGINT)"


@query("board_create", f"""WITH {TICKETS_SQL}, new AS (SELECT CASE WHEN n % 7 = 0 THEN id ELSE 'n' || id END AS id, CASE WHEN n % 5 = 0 THEN ' ' ELSE 'Title' END AS title, CASE WHEN n % 6 = 0 THEN 'odd' ELSE 'bug' END AS type, CASE WHEN n % 8 = 0 THEN 9 ELSE 2 END AS priority,
  CASE WHEN n % 3 = 0 THEN 'none' WHEN n % 3 = 1 THEN id END AS parent, CASE WHEN n % 11 = 0 THEN 'missing' END AS blocker, id AS old, status, n FROM (SELECT *, {_NUMBER} AS n FROM tickets))
SELECT id, CASE WHEN title = ' ' THEN 'title is required' WHEN type = 'odd' THEN 'invalid type' WHEN priority = 9 THEN 'invalid priority' WHEN n % 7 = 0 THEN 'id is taken' WHEN parent = 'none' THEN 'parent not found'
  WHEN parent IS NOT NULL AND status = 'closed' THEN 'parent is closed' WHEN blocker IS NOT NULL THEN 'blocker not found' END AS reason FROM new""")  # fmt: skip
def board_create(spark, d):
    rows, n = tickets(spark, d), F.substring("id", 2, 12).cast("bigint")
    new = rows.select(
        F.when(n % 7 == 0, F.col("id")).otherwise(F.concat(F.lit("n"), "id")).alias("id"), F.when(n % 5 == 0, " ").otherwise("Title").alias("title"), F.when(n % 6 == 0, "odd").otherwise("bug").alias("type"),
        F.when(n % 8 == 0, 9).otherwise(2).alias("priority"), F.when(n % 3 == 0, "none").when(n % 3 == 1, F.col("id")).alias("parent"), F.when(n % 11 == 0, F.array(F.lit("missing"))).otherwise(F.array().cast("array<string>")).alias("blocked_by"),
    )
    return board.create_reason(rows, new)


_BUSY = "busy AS (SELECT DISTINCT parent AS id FROM tickets WHERE status <> 'closed' AND parent IS NOT NULL)"


@query("board_close", f"WITH {TICKETS_SQL}, {_BUSY} SELECT t.id, CASE WHEN status = 'in_progress' AND b.id IS NULL THEN 'closed' ELSE status END AS status FROM tickets t LEFT JOIN busy b ON b.id = t.id")
def board_close(spark, d):
    rows = tickets(spark, d)
    return board.closed(rows, rows.select("id")).select("id", "status")


@query("board_close_reasons", f"WITH {TICKETS_SQL}, {_BUSY} SELECT t.id, CASE WHEN status = 'open' THEN 'not started' WHEN status = 'closed' THEN 'already closed' WHEN b.id IS NOT NULL THEN 'has open children' END AS reason FROM tickets t LEFT JOIN busy b ON b.id = t.id")
def board_close_reasons(spark, d):
    return board.close_reason(tickets(spark, d))


@query("board_reopen", f"WITH {TICKETS_SQL} SELECT t.id, CASE WHEN t.status = 'closed' AND coalesce(p.status, '') <> 'closed' THEN 'open' ELSE t.status END AS status FROM tickets t LEFT JOIN tickets p ON p.id = t.parent")
def board_reopen(spark, d):
    rows = tickets(spark, d)
    return board.reopened(rows, rows.select("id")).select("id", "status")


@query("board_start", f"""WITH RECURSIVE {TICKETS_SQL}, {EDGES_SQL}, bad AS (SELECT DISTINCT e.id FROM edges e LEFT JOIN tickets b ON b.id = e.blocker WHERE b.id IS NULL OR b.status <> 'closed'),
up AS (SELECT id, parent AS ancestor FROM tickets WHERE parent IS NOT NULL UNION SELECT u.id, t.parent FROM up u JOIN tickets t ON t.id = u.ancestor WHERE t.parent IS NOT NULL),
held AS (SELECT id FROM bad UNION SELECT u.id FROM up u JOIN bad b ON b.id = u.ancestor)
SELECT t.id, CASE WHEN t.status = 'open' AND t.id NOT IN (SELECT id FROM held) AND (t.parent IS NULL OR p.status <> 'open') THEN 'in_progress' ELSE t.status END AS status FROM tickets t LEFT JOIN tickets p ON p.id = t.parent""")  # fmt: skip
def board_start(spark, d):
    rows = tickets(spark, d)
    return board.started(rows, rows.select("id")).select("id", "status")


_LINKS = f"""asked AS (SELECT id, 't000001' AS blocker FROM tickets WHERE {_NUMBER} BETWEEN 2 AND 30 AND {_NUMBER} <> 4 UNION ALL SELECT 't000003', 't000007' UNION ALL SELECT 't000008', 't000008' UNION ALL SELECT 't000009', 'none' UNION ALL SELECT 'none', 't000009' UNION ALL SELECT 't000007', 't000006')"""


@query("board_block_reasons", f"""WITH {TICKETS_SQL}, {_LINKS} SELECT a.id, a.blocker, CASE WHEN t.id IS NULL THEN 'ticket not found' WHEN b.id IS NULL THEN 'blocker not found' WHEN a.id = a.blocker THEN 'cannot block itself'
  WHEN list_contains(t.blocked_by, a.blocker) THEN 'already blocked' WHEN a.id = 't000003' AND a.blocker = 't000007' THEN 'closes a cycle' END AS reason FROM asked a LEFT JOIN tickets t ON t.id = a.id LEFT JOIN tickets b ON b.id = a.blocker""")  # fmt: skip
def board_block_reasons(spark, d):
    return board.block_reason(tickets(spark, d), _asked(spark, d))


def _asked(spark, d):
    n = F.substring("id", 2, 12).cast("bigint")
    own = tickets(spark, d).filter(n.between(2, 30) & (n != 4)).select("id", F.lit("t000001").alias("blocker"))
    return own.unionByName(spark.createDataFrame([("t000003", "t000007"), ("t000008", "t000008"), ("t000009", "none"), ("none", "t000009"), ("t000007", "t000006")], "id string, blocker string"))


@query("board_unblock", f"WITH {TICKETS_SQL} SELECT id, array_to_string(list_filter(blocked_by, lambda x: x <> 'missing' OR {_NUMBER} % 2 = 1), ',') AS blocked_by FROM tickets")
def board_unblock(spark, d):
    rows = tickets(spark, d)
    links = rows.filter(F.substring("id", 2, 12).cast("bigint") % 2 == 0).select("id", F.lit("missing").alias("blocker"))
    return board.unblocked(rows, links).select("id", F.array_join("blocked_by", ",").alias("blocked_by"))


# Settings and locks


@query("settings_layers", """SELECT * FROM (VALUES ('dir', 'given'), ('editor', 'project'), ('limit', '5'), ('color', 'true'), ('unknown', 'ValueError'), ('required', 'FileNotFoundError')) AS t(name, value)""")
def settings_layers(spark, d):
    base = _folder(spark)
    files = {"global.json": '{"editor": "global", "limit": 5, /* a // b */ "color": true,}', "project.json": '// ours\n{"editor": "project", "dir": "x",}', "bad.json": '{"other": 1}'}
    for name, text in files.items():
        with open(os.path.join(base, name), "w") as f:
            f.write(text)
    at = lambda name: os.path.join(base, name)
    defaults = {"dir": ".", "editor": "vi", "limit": 100, "color": False}
    found = settings.layered(defaults, [at("global.json"), at("none.json"), at("project.json")], {"dir": "given", "limit": None})
    out = [(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in found.items()]
    for name, given in (("unknown", {"files": [at("bad.json")]}), ("required", {"files": [at("none.json")], "required": [at("none.json")]})):
        try:
            settings.layered(defaults, **given)
        except (ValueError, FileNotFoundError) as wrong:
            out.append((name, type(wrong).__name__))
    return spark.createDataFrame(out, "name string, value string")


@query("lock_forms", """SELECT * FROM (VALUES ('write beside write', 'Busy'), ('read beside write', 'Busy'), ('read beside read', 'held'), ('write beside read', 'Busy'), ('write after', 'held'), ('wait', 'held'), ('replaced file', 'held'), ('ticket', 'Busy')) AS t("case", found)""")
def lock_forms(spark, d):
    base = _folder(spark)
    lock, out = Lock(os.path.join(base, "lock")), []

    def tried(case, held):
        try:
            with held:
                out.append((case, "held"))
        except Busy:
            out.append((case, "Busy"))

    with lock.write():
        tried("write beside write", lock.try_write())
        tried("read beside write", lock.read(0.05))
    with lock.read():
        tried("read beside read", lock.try_read())
        tried("write beside read", lock.try_write())
    tried("write after", lock.try_write())
    first = lock.write()
    first.__enter__()
    threading.Thread(target=lambda: (time.sleep(0.2), first.__exit__(None, None, None))).start()
    tried("wait", lock.write(5))
    with lock.write():
        os.unlink(lock.path)  # whoever takes the lock now takes it on the file that has the name
        tried("replaced file", lock.try_write())
    with ticket_lock(base, "a.md"):
        tried("ticket", ticket_lock(base, "a.md", 0.05))
    return spark.createDataFrame(out, "case string, found string")


# Search, statements and SQL


def _searched(spark, d):
    return search.index(table(spark, d, "benchmark"), "item_id", "text")


_FTS = r"""words AS (SELECT item_id, w AS word, pos FROM (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark))),
common AS (SELECT word, count(DISTINCT item_id) AS n FROM words GROUP BY word ORDER BY n DESC, word LIMIT 2)"""


def _common(spark, d):
    return [r["word"] for r in _searched(spark, d).groupBy("word").agg(F.count_distinct("item_id").alias("n")).orderBy(F.desc("n"), "word").limit(2).collect()]


@query("fts_all", f"WITH {_FTS} SELECT item_id, count(*) AS hits FROM words WHERE word IN (SELECT word FROM common) GROUP BY item_id HAVING count(DISTINCT word) = 2")
def fts_all(spark, d):
    return search.matching(_searched(spark, d), "item_id", " ".join(_common(spark, d)))


@query("fts_any", f"WITH {_FTS} SELECT item_id, count(*) AS hits FROM words WHERE word IN (SELECT word FROM common) GROUP BY item_id")
def fts_any(spark, d):
    return search.matching(_searched(spark, d), "item_id", " ".join(_common(spark, d)), every=False)


@query("fts_prefix", f"WITH {_FTS} SELECT item_id, count(*) AS hits FROM words WHERE starts_with(word, 'th') GROUP BY item_id")
def fts_prefix(spark, d):
    return search.matching(_searched(spark, d), "item_id", "th", prefix=True)


@query("fts_phrase", f"WITH {_FTS}, pair AS (SELECT a.word AS x, b.word AS y FROM words a JOIN words b ON b.item_id = a.item_id AND b.pos = a.pos + 1 GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1) SELECT a.item_id, count(*) AS hits FROM words a JOIN words b ON b.item_id = a.item_id AND b.pos = a.pos + 1 JOIN pair p ON p.x = a.word AND p.y = b.word GROUP BY a.item_id")
def fts_phrase(spark, d):
    found = _searched(spark, d)
    flat = found.select("item_id", "word", F.explode("positions").alias("p"))
    pairs = flat.join(flat.select("item_id", F.col("word").alias("y"), (F.col("p") - 1).alias("p")), ["item_id", "p"]).groupBy("word", "y").agg(F.count(F.lit(1)).alias("n"))
    best = pairs.orderBy(F.desc("n"), "word", "y").first()
    return search.phrase(found, "item_id", f"{best['word']} {best['y']}")


@query("fts_ranked", f"WITH {_FTS}, hits AS (SELECT item_id, word, count(*) AS n FROM words WHERE word IN (SELECT word FROM common) GROUP BY ALL), rare AS (SELECT word, ln((SELECT count(*) FROM benchmark)::DOUBLE / count(*)) AS rare FROM hits GROUP BY word) SELECT item_id, round(sum(n * rare), 6) AS score FROM hits JOIN rare USING (word) GROUP BY item_id ORDER BY score DESC, item_id LIMIT 10")
def fts_ranked(spark, d):
    return search.ranked(_searched(spark, d), "item_id", table(spark, d, "benchmark").count(), " ".join(_common(spark, d)), 10)


@query("dml_statements", """WITH base AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0),
updated AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'poor' ELSE c_name END AS c_name, c_acctbal FROM base), replaced AS (SELECT * FROM updated WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, upper(c_name), 0.0 FROM customer WHERE c_custkey % 5 = 0)
SELECT c_custkey, c_name, c_acctbal FROM replaced WHERE NOT coalesce(c_custkey % 3 = 0, false)""")  # fmt: skip
def dml_statements(spark, d):
    """Create, insert, update, replace and delete, one version after the other."""
    tables, rows = Tables(spark, _folder(spark)), table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    tables.create("people", "c_custkey bigint, c_name string, c_acctbal double")
    tables.create("people", "other int", if_not_exists=True)
    tables.insert("people", rows.filter("c_custkey % 2 = 0"), key="c_custkey")
    tables.update("people", {"c_name": F.lit("poor")}, F.col("c_acctbal") < 0)
    tables.replace("people", rows.filter("c_custkey % 5 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal")), "c_custkey")
    tables.delete("people", F.col("c_custkey") % 3 == 0)
    tables.create("gone", "a int")
    tables.drop("gone")
    tables.views()
    return spark.sql("SELECT * FROM people")


@query("dml_errors", """SELECT * FROM (VALUES ('create again', 'ValueError'), ('same key', 'ValueError'), ('drop unknown', 'FileNotFoundError'), ('tables', 'people')) AS t("case", found)""")
def dml_errors(spark, d):
    tables, rows = Tables(spark, _folder(spark)), table(spark, d, "region").select("r_regionkey")
    tables.create("people", "r_regionkey int")
    tables.insert("people", rows, key="r_regionkey")
    out = []
    for case, act in (("create again", lambda: tables.create("people", "a int")), ("same key", lambda: tables.insert("people", rows, key="r_regionkey")), ("drop unknown", lambda: tables.drop("none"))):
        try:
            act()
        except (ValueError, FileNotFoundError) as wrong:
            out.append((case, type(wrong).__name__))
    return spark.createDataFrame([*out, ("tables", ",".join(tables.names()))], "case string, found string")


@query("sql_metadata", """SELECT * FROM (VALUES ('id', 'string'), ('short_id', 'string'), ('path', 'string'), ('mtime_ns', 'bigint'), ('size_bytes', 'bigint'), ('title', 'string'), ('typeof', 'bigint')) AS t(name, type)""")
def sql_metadata(spark, d):
    from quillmill.functions.schema import Schema

    spark.createDataFrame([], Schema().table("indexed").struct()).createOrReplaceTempView("indexed")
    found = [(c.name, c.dataType) for c in spark.catalog.listColumns("indexed")]
    kind = spark.sql("SELECT typeof(count(*)) AS t FROM indexed").first()["t"]
    return spark.createDataFrame([*found, ("typeof", kind)], "name string, type string")


_sql("sql_scalars", "SELECT c_custkey, substr(c_name, 3, 5) AS part, instr(c_name, '#') AS at, lpad(cast(c_custkey AS STRING), 6, '0') AS padded, round(c_acctbal, 1) AS rounded, abs(c_acctbal) AS positive, coalesce(nullif(c_nationkey, 3), -1) AS nation, upper(hex(c_custkey)) AS hexed, length(trim(c_name)) AS n, replace(c_name, 'Customer', 'C') AS short FROM customer",
     "SELECT c_custkey, substr(c_name, 3, 5) AS part, CAST(instr(c_name, '#') AS INT) AS at, printf('%06d', c_custkey) AS padded, round(c_acctbal, 1) AS rounded, abs(c_acctbal) AS positive, coalesce(nullif(c_nationkey, 3), -1) AS nation, upper(hex(c_custkey)) AS hexed, CAST(length(trim(c_name)) AS INT) AS n, replace(c_name, 'Customer', 'C') AS short FROM customer")
_sql("sql_dates", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS day, year(o_orderdate) AS y, weekofyear(o_orderdate) AS w, date_format(add_months(o_orderdate, 1), 'yyyy-MM-dd') AS later, datediff(o_orderdate, DATE '1992-01-01') AS since, unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS seconds FROM orders",
     "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(year(o_orderdate) AS INT) AS y, CAST(weekofyear(o_orderdate) AS INT) AS w, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS later, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS since, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders")
_sql("sql_json_each", "SELECT event_id, k.key AS key, k.value AS value FROM (SELECT event_id, explode(from_json(props, 'map<string,string>')) FROM events) AS k(event_id, key, value)", "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, unnest(json_keys(props))) AS value FROM events")
_sql("sql_extremes", "SELECT o_orderstatus, avg(CAST(o_totalprice AS DECIMAL(18, 2))) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(round(sum(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2))) / count(*), 6) AS DECIMAL(22, 6)) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderstatus")
