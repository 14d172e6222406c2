import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.functions import header as H

REJECTED = [
    "id: a\nid: b", "id a", "status:open", "status:  open", "status: open ", "status: # c", "l:\n  - # c", "m:\n  o: # c", "status: open  # c", "status: with#c", "# c", "bad key: v", " id: a",
    "l:\nstatus: open", "m:\n\tkey: v", "m:\n  key:", "m:\n  key value", "m:\n  key:  v", "m:\n  key: v ", "m:\n  k: one\n  k: two", "l:\n  abc", "l:\n  -  abc", "l:\n  - ", "l:\n  - a\n   - b",
    "l: [a,,b]", "l: [a,b]", "l: [a,  b]", "l: [ a, b]", "l:\n\t- a", "m:\n  key: [a]", 't: "oops', "t: 'oops", 'l:\n  - "oops', "m:\n  key: v\n s: open", "l: [a, b", "m: {a: b}", "n: |", "n: !t",
    "n: *a", "n: &a", 't: ["a,b"]', "m:\n  a: b\n\nx: y", 't: "a\\q"', 't: "a"b"', "k:", "l: [a, ]", ": v",
]


def fenced(text, tail=""):
    return f"---\n{text}\n---\n{tail}"


@pytest.mark.parametrize("text", REJECTED)
def test_rejected(text):
    with pytest.raises(H.HeaderError):
        H.parse(fenced(text, "tail\n"))


def values(text):
    entries, body = H.parse(text)
    return {e["key"]: next((e[f] for f in ("s", "i", "b", "list", "obj") if e[f] is not None), None) for e in entries}, body


def test_accepted():
    found, body = values(fenced('id: a\nn: -12\nz: 007\np: +5\nt: true\nq: "x # \\u00e9"\nr: \'it\'s\'\nl: [a, b]\ne: []\nbl:\n  - x\n\n  - y z\nlast: 9223372036854775807\nleast: -9223372036854775808', "\n\nbody\n"))
    assert found == {
        "id": "a", "n": -12, "z": 7, "p": "+5", "t": True, "q": "x # é", "r": "it's", "l": ["a", "b"], "e": [], "bl": ["x", "y z"], "last": 2**63 - 1, "least": "-9223372036854775808",
    }
    assert body == "body\n"
    entries, _ = H.parse(fenced("m:\n  k: v\n  n: 3\nnext: 1"))
    assert [(x["key"], x["kind"]) for x in entries[0]["obj"]] == [("k", "string"), ("n", "int")]


def test_comment_names_its_line():
    with pytest.raises(H.HeaderError, match="line 3.*comments"):
        H.parse(fenced("id: 1\n# c\nstatus: open"))


def test_line_limit_and_fences():
    many = "\n".join(f"k{n}: v" for n in range(201))
    with pytest.raises(H.HeaderError, match="limit 200"):
        H.parse(fenced(many))
    assert len(H.parse(fenced(many), H.Options(line_limit=0))[0]) == 201
    with pytest.raises(H.HeaderError, match="opening"):
        H.parse("id: a\n")
    with pytest.raises(H.HeaderError, match="closing"):
        H.parse("---\nid: a\n")
    assert values_of("id: a\n", H.Options(require_fence=False)) == ["id"]
    assert H.parse("---\r\nid: a\r\n---\r\n\r\nbody")[1] == "body"
    assert H.parse(fenced("id: a", "\n\nx\n---\ny"), H.Options(trim_body=False))[1] == "\n\nx\n---\ny"


def values_of(text, options):
    return [e["key"] for e in H.parse(text, options)[0]]


TEXT = st.text(st.characters(exclude_categories=("Cs",)), max_size=20)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(TEXT.filter(bool), max_size=3), st.integers(-(2**63) + 1, 2**63 - 1), st.booleans())
def test_what_is_written_reads_back(text, items, number, flag):
    none = {"s": None, "i": None, "b": None, "list": None, "obj": None}
    entries = [
        {**none, "key": "a", "kind": "string", "s": text}, {**none, "key": "b", "kind": "int", "i": number}, {**none, "key": "c", "kind": "bool", "b": flag},
        {**none, "key": "d", "kind": "list", "list": items}, {**none, "key": "e", "kind": "object", "obj": [{"key": "x", "kind": "string", "s": text, "i": None, "b": None}]},
    ]
    assert H.parse(H.serialize(entries))[0] == entries


def test_key_order():
    none = {"i": None, "b": None, "list": None, "obj": None}
    entries = [{**none, "key": k, "kind": "string", "s": k} for k in "cab"]
    assert H.serialize(entries, fences=False, first=["b"]) == "b: b\na: a\nc: c\n"
    assert H.serialize(entries, fences=False, order=["c"]) == "c: c\n"
    for wrong in ({"order": ["x"]}, {"order": ["a", "a"]}, {"first": ["b c"]}):
        with pytest.raises(ValueError):
            H.serialize(entries, **wrong)


def test_access_and_set(spark):
    from pyspark.sql import functions as F

    df = H.with_header(spark.createDataFrame([(1, fenced("a: x\nn: 3\nl: [p, q]\nm:\n  k: v")), (2, "broken"), (3, None)], "k int, content string"), "content")
    h = F.col("header")
    row = df.select("k", H.get_string(h, "a"), H.get_int(h, "a"), H.get_int(h, "n"), H.get_list(h, "l"), H.object_value(h, "m", "k")["s"], H.has(h, "zz"), "error").orderBy("k").collect()
    assert tuple(row[0])[1:7] == ("x", None, 3, ["p", "q"], "v", False) and row[0]["error"] is None
    assert "opening" in row[1]["error"] and "opening" in row[2]["error"]
    changed = df.filter("k = 1").withColumn("header", H.set_entry(H.set_entry(h, H.int_entry("n", F.lit(9))), H.bool_entry("z", F.lit(True))))
    assert [e["key"] for e in changed.first()["header"]] == ["a", "n", "l", "m", "z"] and changed.first()["header"][1]["i"] == 9
