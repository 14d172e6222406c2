import os

import pytest
from pyspark.sql import functions as F

from quillmill.functions import header as H
from quillmill.functions.schema import Schema, SchemaError
from quillmill.operators import changes
from quillmill.plans import catalog_store, hooks
from quillmill.plans.store import AlreadyExists, Closed, CommitIncomplete, Config, NotFound, ScanError, Store, bad_path
from quillmill.sources import documents, log

OP = log.Op("put", "create", "a", "a.md", "text")


def entries(id, title="T", **more):
    none = {"s": None, "i": None, "b": None, "list": None, "obj": None}
    out = [{**none, "key": "id", "kind": "string", "s": id}, {**none, "key": "title", "kind": "string", "s": title}]
    return out + [{**none, "key": k, "kind": "int", "i": v} for k, v in more.items()]


def config(base, **more):
    h = F.col("header")
    return Config(str(base), Schema().integer("priority").text("body"), {"priority": H.get_int(h, "priority"), "body": F.col("body")}, **more)


def put(base, id, **more):
    os.makedirs(base, exist_ok=True)
    with open(os.path.join(base, f"{id}.md"), "w") as f:
        f.write(H.document(entries(id, **more), "body of " + id))


def test_log_states():
    data = log.encode([OP, log.Op("delete", "delete", "b", "b.md")])
    assert log.state(b"") == (log.EMPTY, b"") and log.state(b"x")[0] == log.UNCOMMITTED and log.state(b"x" * 40)[0] == log.UNCOMMITTED
    state, body = log.state(data)
    assert state == log.COMMITTED and log.decode(body) == [OP, log.Op("delete", "delete", "b", "b.md")]
    with pytest.raises(log.LogCorrupt):
        log.state(b"X" + data[1:])
    assert log.state(data[:-1] + bytes([data[-1] ^ 1]))[0] == log.UNCOMMITTED
    for wrong in (log.Op("put", "delete", "a", "p", "x"), log.Op("put", "create", "a", "p"), log.Op("x", "create", "a", "p"), log.Op("delete", "create", "a", "p"), log.Op("put", "", "a", "p", "x"), log.Op("put", "create", "", "p", "x")):
        with pytest.raises(ValueError):
            log.encode([wrong])
    with pytest.raises(log.LogCorrupt):
        log.decode(b'{"op": "put"}\n')


def test_schema():
    s = Schema().text("status", True).integer("priority").index("status")
    assert s.fingerprint() == Schema().integer("priority").text("status", True).index("status").fingerprint() != Schema().fingerprint()
    assert s.struct()["status"].nullable is False and "priority INTEGER" in s.ddl()
    for wrong in (Schema().text("a1"), Schema().text("id"), Schema().index("x"), Schema().table("A"), Schema(fields=())):
        with pytest.raises(SchemaError):
            wrong.check()


def test_paths():
    assert bad_path("a/b.md") is None
    assert all(bad_path(p) for p in ("", "/a.md", "../a.md", "a/../b.md", "a.txt", "./a.md"))
    assert documents.is_internal(".index") and documents.is_internal(".index/x.md") and not documents.is_internal(".index-backup")


def test_scan(spark, tmp_path):
    for name in ("a.md", "_b.md", "sub/c.md", "sub/deep/d.md", ".index/e.md", "x.txt"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(name)
    found = {r["path"]: r for r in documents.scan(spark, str(tmp_path)).collect()}
    assert set(found) == {"a.md", "_b.md", "sub/c.md", "sub/deep/d.md"}
    assert found["a.md"]["mtime_ns"] == os.stat(tmp_path / "a.md").st_mtime_ns and found["a.md"]["content"] == "a.md"
    assert {r["path"] for r in documents.scan(spark, str(tmp_path), recursive="false").collect()} == {"a.md", "_b.md"}
    assert documents.scan(spark, str(tmp_path / "none")).count() == 0


def test_refresh_and_questions(spark, tmp_path):
    for i in ("ab1", "AB2", "c_3"):
        put(tmp_path, i, priority=1)
    related = hooks.Related(lambda rows: rows.select("id", F.col("priority").alias("item")))
    store = Store(spark, config(tmp_path, after_batch=related))
    assert store.index().count() == 3 and related.table.count() == 3
    pinned = store.index()
    put(tmp_path, "ab1", priority=5)
    put(tmp_path, "new", priority=2)
    os.unlink(tmp_path / "c_3.md")
    assert store.refresh() == {"inserted": 1, "updated": 1, "deleted": 1, "skipped": 1, "total": 3}
    assert store.refresh() == {"inserted": 0, "updated": 0, "deleted": 0, "skipped": 3, "total": 3}
    assert {r["id"]: r["item"] for r in related.table.collect()} == {"ab1": 5, "AB2": 1, "new": 2}
    assert pinned.count() == 3 and pinned.filter("id = 'c_3'").count() == 1
    assert [r["id"] for r in store.by_prefix("aB").collect()] == ["AB2", "ab1"] and store.by_prefix("c%").count() == 0
    with pytest.raises(ValueError):
        store.by_prefix("")
    assert store.get("new")["body"].strip() == "body of new" and store.exists("new")
    with pytest.raises(NotFound):
        store.get("c_3")
    assert store.query("SELECT count(*) AS n FROM documents WHERE priority >= 2").first()["n"] == 2
    (tmp_path / "bad.md").write_text("nothing")
    with pytest.raises(ScanError) as wrong:
        store.reindex()
    assert wrong.value.total == 1 and store.index().count() == 3
    store.close()
    with pytest.raises(Closed):
        store.index()


def test_transactions(spark, tmp_path, monkeypatch):
    store = Store(spark, config(tmp_path))
    tx = store.begin()
    tx.create(entries("a", priority=1), "one")
    tx.create(entries("b"), "two")
    tx.create(entries("a", priority=2), "last wins")
    tx.commit()
    assert {r["id"]: r["priority"] for r in store.index().collect()} == {"a": 2, "b": None}
    with pytest.raises(Closed):
        tx.commit()
    tx = store.begin()
    with pytest.raises(AlreadyExists):
        tx.create(entries("a"))
    with pytest.raises(NotFound):
        tx.update(entries("zz"))
    with pytest.raises(NotFound):
        tx.delete("zz")
    tx.update(entries("a", priority=3))
    tx.delete("a")
    with pytest.raises(AlreadyExists):
        tx.create(entries("a"))
    tx.commit()
    assert not store.exists("a") and not (tmp_path / "a.md").exists()
    tx = store.begin()
    tx.create(entries("c"))
    tx.rollback()
    assert not store.exists("c")
    # a crash after the log is written: the next writer finishes it
    tx = store.begin()
    tx.create(entries("d", priority=4), "kept")
    monkeypatch.setattr(Store, "_apply", lambda self, ops: 1 / 0)
    with pytest.raises(CommitIncomplete):
        tx.commit()
    monkeypatch.undo()
    assert not store.exists("d")
    again = Store(spark, config(tmp_path))
    assert again.exists("d") and again.get("d")["body"].strip() == "kept"
    (tmp_path / ".index" / "log").write_bytes(b"half a rec")
    assert Store(spark, config(tmp_path)).index().count() == 2
    # another schema rebuilds
    other = Store(spark, Config(str(tmp_path)))
    assert other.index().columns == ["id", "short_id", "path", "mtime_ns", "size_bytes", "title"] and other.index().count() == 2


def test_replay_twice_is_replay_once(spark):
    index = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    ops = spark.createDataFrame([("a", 1, "put", 9), ("a", 2, "delete", None), ("c", 1, "put", 3), ("b", 1, "delete", None), ("b", 2, "put", 7)], "id string, n int, op string, v int")
    once = changes.replay(index, ops, "id", ["n"])
    twice = changes.replay(once, ops, "id", ["n"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("b", 7), ("c", 3)]
    faults = spark.createDataFrame([("x", "create", "a", "p", "c"), ("put", None, "a", "p", "c"), ("put", "delete", "a", "p", "c"), ("put", "create", "a", "p", ""), ("delete", "delete", "", "p", None), ("put", "create", "a", "p", "c")], "op string, kind string, id string, path string, content string")
    assert [r[0] for r in faults.select(changes.log_faults()).collect()] == ["unknown op", "missing kind", "invalid kind for put", "missing content for put", "empty id", None]


def test_a_large_ticket_folder_is_indexed_in_portions(spark, tmp_path, monkeypatch):
    orders = spark.range(95).selectExpr("id AS o_orderkey", "element_at(array('F', 'P', 'O'), cast(id % 3 AS int) + 1) AS o_orderstatus", "'2-HIGH' AS o_orderpriority", "date '2020-01-02' AS o_orderdate")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    wanted = sorted(map(tuple, catalog_store.index_rows(spark, str(tmp_path)).collect()))
    assert [x[1] for x in wanted] == [f"t{k:06d}" for k in range(95)]
    monkeypatch.setattr(catalog_store, "PORTION", 20)
    held, folders, save = [], set(), catalog_store._save

    def counted(rows, base):
        save(rows, base)
        folders.add(base)
        held.append(sum(n.endswith(".md") for n in os.listdir(base)))

    monkeypatch.setattr(catalog_store, "_save", counted)
    assert sorted(map(tuple, catalog_store.index_rows(spark, str(tmp_path)).collect())) == wanted
    # 95 files in 5 portions: each is taken away before the next is written
    assert len(held) == 5 and sum(held) == 95 and max(held) < 60
    assert not any(n.endswith(".md") for base in folders for n in os.listdir(base))


def test_portions_take_over_the_files_of_those_before(spark, tmp_path, monkeypatch):
    orders = spark.range(95).selectExpr("id AS o_orderkey", "element_at(array('F', 'P', 'O'), cast(id % 3 AS int) + 1) AS o_orderstatus", "'2-HIGH' AS o_orderpriority", "date '2020-01-02' AS o_orderdate")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    wanted = sorted(map(tuple, catalog_store.index_rows(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(catalog_store, "PORTION", 20)
    monkeypatch.setattr(catalog_store, "LANES", 2)
    held, save = {}, catalog_store._save

    def seen(rows, base):
        save(rows, base)
        held.setdefault(base, []).append({e.inode() for e in os.scandir(base) if e.name.endswith(".md")})

    monkeypatch.setattr(catalog_store, "_save", seen)
    assert sorted(map(tuple, catalog_store.index_rows(spark, str(tmp_path)).collect())) == wanted
    # a folder for each lane, not for each portion, and no file made where there was one
    assert sorted(map(len, held.values())) == [2, 3]
    for first, *later in held.values():
        for now in later:
            assert now <= first or first <= now
            first = now


def test_a_spare_folder_holds_what_was_saved_last(spark, tmp_path):
    base = str(tmp_path / "c")
    os.makedirs(f"{base}/.index")
    save = lambda rows: catalog_store._save(spark.createDataFrame(rows, "path string, content string"), base)
    held = lambda: {n: (tmp_path / "c" / n).read_text() for n in os.listdir(base) if n.endswith(".md")}
    save([("a.md", "long text"), ("b.md", "b"), ("c.md", "c")])
    save([("d.md", "d")])  # not marked: what is there stays
    assert sorted(held()) == ["a.md", "b.md", "c.md", "d.md"]
    for rows in ([("c.md", "é"), ("x.md", "x"), ("a.md", "shorter")], [("a.md", "more than before"), ("y.md", "")], [(f"{k}.md", "n" * k) for k in range(9)], []):
        catalog_store._spare(base)
        save(rows)
        assert held() == dict(rows) and not os.path.exists(catalog_store._marker(base))


def test_a_head_longer_than_the_first_block(tmp_path, monkeypatch):
    text = "---\nid: a\n---\ntext\n# Title\nbody\n"
    (tmp_path / "a.md").write_text(text)
    (tmp_path / "b.md").write_text(text[:18])
    for block in range(1, 40):
        monkeypatch.setattr(documents, "BLOCK", block)
        assert documents.read_head(str(tmp_path / "a.md")) == text[:-5]
        assert documents.read_head(str(tmp_path / "b.md")) == text[:18]
