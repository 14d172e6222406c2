import base64

import pytest
from pyspark.sql import functions as F

from quillmill.functions import scalars, tickets as T
from quillmill.operators import tickets as L

GOOD = {"schema_version": "1", "id": "a", "status": "open", "type": "bug", "priority": "2", "created": "2024-01-02T03:04:05Z", "blocked-by": "[]"}


def text(title="# Title", **changes):
    fields = {**GOOD, **{k.replace("_by", "-by"): v for k, v in changes.items()}}
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in fields.items() if v is not None) + "---\n" + title + "\n"


BAD = [
    *(text(**{k: None}) for k in ("schema_version", "id", "status", "type", "priority", "created")), *(text(schema_version=v) for v in ("", "x", "0", "-1", "2")), text(status="done"), text(type="x"),
    text(priority="0"), text(priority="5"), text(created="2024-01-02"), text(created="2024-02-30T00:00:00Z"), text(status="closed"), text(closed="2024-01-02T03:04:05Z"), "no header", "---\nid: a\n",
    text(id=""), text(status=""), text(assignee=""), text(blocked_by="a, b"), "---\n" + "x: y\n" * 101 + "---\n# T\n", text(title="no title"), text(title="# "),
]


@pytest.mark.parametrize("content", BAD)
def test_bad(content):
    with pytest.raises(ValueError):
        T.read_ticket(content)


def test_good_and_bad_rows_stay_together(spark):
    good = text(priority="2abc", parent="p", blocked_by="[ x ,, y]", unknown="z")
    found = T.parsed(spark.createDataFrame([("f1", good), ("f2", BAD[0]), ("f3", None)], "path string, content string"), "content").orderBy("path").collect()
    assert (found[0]["priority"], found[0]["parent"], found[0]["blocked_by"], found[0]["title"], found[0]["error"]) == (2, "p", ["x", "y"], "Title", None)
    assert found[1]["error"] and found[2]["error"] and found[1]["id"] is None
    assert T.read_ticket(text() .replace("status: open\n", "status: open\nstatus: in_progress\n"))["status"] == "in_progress"


ROWS = [("a", "open", "bug", 1, None), ("b", "open", "feature", 2, "a"), ("c", "in_progress", "bug", 2, ""), ("d", "closed", "task", 3, "a")]


@pytest.mark.parametrize(
    ("conditions", "ids"),
    [({"status": "open"}, "ab"), ({"priority": 2}, "bc"), ({"type": "bug"}, "ac"), ({"status": "open", "type": "bug"}, "a"), ({"parent": "a"}, "bd"), ({"roots": True}, "ac"), ({}, "abcd")],
)
def test_filters(spark, conditions, ids):
    df = spark.createDataFrame(ROWS, "id string, status string, type string, priority int, parent string")
    assert "".join(r["id"] for r in L.by_file_name(L.matching(df, **conditions)).collect()) == ids


def test_pages(spark):
    df = L.by_file_name(spark.createDataFrame([(x,) for x in ("a", "a-1", "b", "c")], "id string"))
    assert [r["id"] for r in L.checked_page(df, 0, 0).collect()] == ["a-1", "a", "b", "c"]
    assert [r["id"] for r in L.checked_page(df, 1, 2).collect()] == ["a", "b"]
    for offset in (4, 100):
        with pytest.raises(L.OutOfBounds):
            L.checked_page(df, offset)
    for wrong in ({"parent": "a", "roots": True}, {"status": "x"}, {"type": "x"}, {"priority": 5}):
        with pytest.raises(ValueError):
            L.matching(df, **wrong)


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(scalars.time_id(F.lit(1700000000).cast("bigint"))).first()[0] == "".join(scalars.BASE32["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567".index(c)] for c in base64.b32encode((1700000000).to_bytes(4, "big")).decode().rstrip("="))
    assert [one.select(scalars.suffixed(F.lit("x"), F.lit(n))).first()[0] for n in (0, 1, 26, 27, 52, 53)] == ["x", "xa", "xz", "xaa", "xaz", "xba"]
    assert scalars.crc32c(b"123456789") == 0xE3069283
    assert scalars.escape_like(r"50%_\x") == r"50\%\_\\x"
    names = spark.createDataFrame([("É1",), ("é1",), ("A_b",), ("axb",)], "s string")
    assert [r["s"] for r in names.filter(scalars.has_prefix(F.col("s"), "a_")).collect()] == ["A_b"]
    assert [r["s"] for r in names.filter(scalars.has_prefix(F.col("s"), "é")).collect()] == ["é1"]
    ints = spark.createDataFrame([("-9223372036854775808",), ("9223372036854775807",), ("007",), ("+5",), ("9223372036854775808",), ("x",), (None,)], "s string")
    assert [r[0] for r in ints.select(scalars.whole_int(F.col("s"))).collect()] == [None, 2**63 - 1, 7, None, None, None, None]
    uuid = "018f3b5c-1a2b-7c3d-8e4f-5a6b7c8d9e0f"
    whole = int(uuid.replace("-", ""), 16)
    top = ((whole >> 64) & 0xFFF) << 48 | ((whole & (2**62 - 1)) >> 14)
    digits = scalars.BASE32.upper()
    assert one.select(scalars.uuid_short(F.lit(uuid))).first()[0] == "".join(digits[top >> 5 * k & 31] for k in reversed(range(12)))
    assert one.select(scalars.uuid_path(F.lit(uuid))).first()[0].startswith("2024/05-02/")


def test_patches(spark):
    df = spark.createDataFrame([(text(parent="p"),)], "t string")
    t = F.col("t")
    after = df.select(T.with_field(t, "status", F.lit("closed")).alias("t")).select(T.with_field(t, "closed", F.lit("2024-01-02T03:04:05Z")).alias("t")).select(T.without_field(t, "parent").alias("t"))
    found = T.read_ticket(after.first()["t"])
    assert (found["status"], found["closed"], found.get("parent")) == ("closed", "2024-01-02T03:04:05Z", None)
    assert df.select(T.field(t, "parent"), T.field(t, "assignee"), T.body(t)).first()[:] == ("p", None, "# Title\n")
    assert df.select(T.with_body(t, F.lit("# New\n"))).first()[0].endswith("---\n# New\n")
    assert spark.range(1).select(T.blockers(F.lit("[a, b,]")), T.blockers(F.lit("a"))).first()[:] == (["a", "b"], None)
