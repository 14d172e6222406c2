import random

from quillmill.operators import changes, graph
from quillmill.plans import board

SCHEMA = "id string, status string, type string, priority int, parent string, blocked_by array<string>, title string"


def random_tickets(seed, n=40):
    r = random.Random(seed)
    ids = [f"t{k}" for k in range(n)]
    out = []
    for k, i in enumerate(ids):
        blockers = [x for x in r.sample([*ids, "gone"], r.choice([0, 0, 1, 2])) if x != i]
        parent = None if r.random() < 0.4 else "gone" if r.random() < 0.05 else r.choice(ids if seed % 2 else ids[: k or 1])
        out.append((i, r.choice(["open", "open", "in_progress", "closed", "closed"]), "bug", r.randint(1, 4), parent if parent != i else None, blockers, "x"))
    return out


def reasons(rows):
    """A walk over the rules, ticket by ticket."""
    by = {r[0]: r for r in rows}

    def chain(i):
        seen = set()
        while True:
            if i in seen:
                return False
            seen.add(i)
            if any(b not in by or by[b][1] != "closed" for b in by[i][5]):
                return False
            if not by[i][4]:
                return True
            i = by[i][4]
            if i not in by:
                return False

    out = {}
    for i, status, _, _, parent, blockers, _ in rows:
        own = next(("blocker not found" if b not in by else "blocked" for b in blockers if b not in by or by[b][1] != "closed"), None)
        if status != "open":
            out[i] = "not open"
        elif own:
            out[i] = own
        elif parent and parent not in by:
            out[i] = "parent not found"
        elif parent and by[parent][1] == "open":
            out[i] = "parent not started"
        elif parent and not chain(parent):
            out[i] = "ancestor not ready"
        else:
            out[i] = None
    return out


def test_ready_matches_a_walk(spark):
    for seed in range(4):
        rows = random_tickets(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        wanted = reasons(rows)
        assert {r["id"]: r["reason"] for r in graph.start_reason(df).collect()} == wanted
        assert {r["id"] for r in graph.ready(df).collect()} == {i for i, x in wanted.items() if x is None}


def test_edges_stale_repair_ancestors(spark):
    rows = [("a", "open", "bug", 1, "b", ["x", "b", "x"], ""), ("b", "closed", "bug", 1, "a", [], ""), ("c", "open", "bug", 1, "a", None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r["id"], r["pos"], r["blocker"]) for r in graph.stale(df).collect()} == {("a", 0, "x"), ("a", 2, "x")}
    assert [(r["id"], r["blocked_by"]) for r in graph.repaired(df).collect()] == [("a", ["b"])]
    assert {(r["id"], r["ancestor"], r["depth"]) for r in graph.ancestors(df).collect()} == {("a", "b", 1), ("a", "a", 2), ("b", "a", 1), ("b", "b", 2), ("c", "a", 1), ("c", "b", 2)}
    assert {r["reason"] for r in graph.blocked_chains(df.filter("id <> 'a'")).collect()} == {"missing parent"}
    assert graph.ready(df.limit(0)).count() == 0


def test_ancestors_of_deep_chains_and_long_cycles(spark):
    rows = [(f"c{k}", f"c{k + 1}" if k < 99 else None) for k in range(100)] + [(f"r{k}", f"r{(k + 1) % 70}") for k in range(70)]
    found = {(r["id"], r["ancestor"]): r["depth"] for r in graph.ancestors(spark.createDataFrame(rows, "id string, parent string")).collect()}
    wanted = {(f"c{a}", f"c{b}"): b - a for a in range(100) for b in range(a + 1, 100)}
    wanted |= {(f"r{a}", f"r{b}"): (b - a) % 70 or 70 for a in range(70) for b in range(70)}
    assert found == wanted


def test_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("c", "e"), ("f", "f")], "a string, b string")
    assert {r["id"] for r in graph.on_cycle(links).collect()} == {"a", "b", "c", "f"}
    assert graph.first_cycle({"b": ["x", "c"], "c": ["a"], "x": []}, "a", "b") == ["a", "b", "c", "a"]
    assert graph.first_cycle({"b": ["x"]}, "a", "b") == []


def test_board(spark):
    rows = [("a", "closed", "bug", 1, None, [], ""), ("b", "open", "bug", 1, None, ["a"], ""), ("c", "open", "bug", 1, "b", [], ""), ("d", "open", "bug", 1, None, ["c"], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    status = lambda t: {r["id"]: r["status"] for r in t.collect()}
    begun = board.started(df, ids("a", "b", "c", "d"))
    assert status(begun) == {"a": "closed", "b": "in_progress", "c": "open", "d": "open"}
    assert status(board.closed(begun, ids("b")))["b"] == "in_progress"  # an open child
    both = board.closed(board.started(begun, ids("c")), ids("c"))
    assert status(board.closed(both, ids("b")))["b"] == "closed"
    assert status(board.reopened(board.closed(both, ids("b")), ids("c", "a"))) == {"a": "open", "b": "closed", "c": "closed", "d": "open"}
    links = spark.createDataFrame([("c", "d"), ("b", "x"), ("b", "b"), ("b", "a"), ("a", "d")], "id string, blocker string")
    assert {(r["id"], r["blocker"]): r["reason"] for r in board.block_reason(df, links).collect()} == {
        ("c", "d"): "closes a cycle", ("b", "x"): "blocker not found", ("b", "b"): "cannot block itself", ("b", "a"): "already blocked", ("a", "d"): None,
    }
    assert {r["id"]: r["blocked_by"] for r in board.blocked(df, links).collect()}["a"] == ["d"]
    assert {r["id"]: r["blocked_by"] for r in board.unblocked(df, spark.createDataFrame([("d", "c"), ("b", "z")], "id string, blocker string")).collect()} == {"a": [], "b": ["a"], "c": [], "d": []}
    new = spark.createDataFrame([("a", "x", "bug", 1, None, []), ("e", "x", "bug", 9, None, []), ("f", "x", "bug", 1, "a", []), ("g", "x", "bug", 1, "b", ["c"]), ("h", "x", "bug", 1, None, ["q"])], "id string, title string, type string, priority int, parent string, blocked_by array<string>")
    assert {r["id"]: r["reason"] for r in board.create_reason(df, new).collect()} == {"a": "id is taken", "e": "invalid priority", "f": "parent is closed", "g": None, "h": "blocker not found"}
    assert status(board.created(df, new))["g"] == "open"


def test_cycles_are_found_alike_by_one_task_and_by_colours(spark, monkeypatch):
    r = random.Random(12)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(75)] + [(100 + k, 101 + k) for k in range(12)] + [(200, 200)]
    ahead = {}
    for a, b in links:
        ahead.setdefault(a, set()).add(b)

    def reaches(start):
        seen, left = set(), [start]
        while left:
            new = ahead.get(left.pop(), set()) - seen
            seen |= new
            left += new
        return start in seen

    wanted = {a for a in ahead if reaches(a)}
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert {x["id"] for x in graph.on_cycle(df).collect()} == wanted
    monkeypatch.setattr(graph, "LOCAL_LINKS", 0)
    assert {x["id"] for x in graph.on_cycle(df).collect()} == wanted


def test_long_logs_are_folded_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(changes, "CHUNK", 7)
    r = random.Random(2)
    ops = [(k % 3, n, r.choice(["start", "close", "reopen"])) for n, k in enumerate(r.choices(range(3), k=200))]
    wanted, at = [], {}
    for key, n, op in ops:
        before, after = changes.MACHINE[op]
        taken = at.get(key, "open") == before
        at[key] = after if taken else at.get(key, "open")
        wanted.append((key, n, op, at[key], taken))
    found = changes.transitions(spark.createDataFrame(ops, "k bigint, n bigint, op string"), "k", ["n"], "op").select("k", "n", "op", "status", "taken")
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
