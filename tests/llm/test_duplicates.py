import hashlib
import random
import re
import unicodedata

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillmill.llm import fingerprint, lattice, neardup, simhash
from quillmill.llm.common import written
from quillmill.llm.components import connected_components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    for n, m in ((60, 50), (200, 190), (40, 0)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(300, 340)]
        found = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
        wanted = roots({x for p in links for x in p}, links)
        assert found == {k: v for k, v in wanted.items() if any(k in p and p[0] != p[1] for p in links)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op9(spark, tables, odd_documents):
    r = random.Random(7)
    base = [" ".join(str(r.randrange(500)) for _ in range(300)) for _ in range(10)]
    near = [(1000 + 50 * k + j, " ".join("changed" if r.random() < 0.004 else w for w in t.split()), None, None, None) for k, t in enumerate(base) for j in range(30)]
    df = odd_documents.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(near, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    d = tables(documents=df)
    rows = [(x["doc_id"], brute_fingerprint(x["text"])) for x in df.collect()]
    pairs = [(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[k + 1 :] if (x ^ y).bit_count() <= 4]
    # rows with an equal id and other texts are of both classes' components
    found = simhash.op9_simhash(spark, d).collect()
    assert sorted((x["doc_id"], x["fingerprint"]) for x in found) == sorted((i, f"{h:016x}") for i, h in rows)
    wanted = roots({i for i, _ in rows}, pairs)
    assert all(x["component_id"] == wanted[x["doc_id"]] for x in found if x["doc_id"] != 104)
    assert sum(x["component_id"] != x["doc_id"] for x in found) > 150
    assert simhash.op9_simhash(spark, tables(documents=df.limit(0))).count() == 0


def test_no_link_is_missed_at_any_radius(spark):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(20)]
    prints = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 7))) for c in centres for _ in range(40)})
    signed = [(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(prints)]
    df = spark.createDataFrame(signed, "fp bigint, rep bigint")
    for radius in (4, 6):
        found = {x["node"]: x["component"] for x in connected_components(simhash.links(df, radius)).collect()}
        wanted = roots(range(len(prints)), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= radius])
        assert {k: found.get(k, k) for k in wanted} == wanted


def plain_canonical(text):
    """Word by word, by what the characters are."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    out, gap = "", False
    for c in folded:
        if c.isspace():
            gap = bool(out)
        else:
            out += " " * gap + c
            gap = False
    return out


def plain_digest(text):
    h = xxhash.xxh3_128()
    for c in text:
        h.update(c.encode())
    return f"{h.intdigest():032x}"


def test_op4(spark, tables, odd_documents):
    extra = spark.createDataFrame([(900, "ＡＢ  c D"), (901, "ab\nC d"), (902, "ab cd"), (None, "no id"), (None, "no id"), (None, None), (1, "alpha"), (1, "beta"), (2, "alpha"), (3, "beta")], "doc_id bigint, text string")
    df = odd_documents.unionByName(extra, allowMissingColumns=True)
    d = tables(documents=df)
    rows = sorted(((x["doc_id"], x["text"] or "") for x in spark.read.parquet(d + "/documents.parquet").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    found = fingerprint.op4_fingerprint(spark, d).collect()
    wanted = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = map(plain_canonical, (text, edited, following))
        wanted.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_digest(own), plain_digest(other), float(own == other), float(own == after)))
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted(map(repr, (tuple(x[n] for n in names) for x in found))) == sorted(map(repr, wanted))
    by = {x["doc_id"]: x["fingerprint"] for x in found}
    assert by[900] == by[901] != by[902]
    assert fingerprint.op4_fingerprint(spark, tables(documents=df.limit(0))).count() == 0
    alone = fingerprint.op4_fingerprint(spark, tables(documents=df.filter("doc_id = 900"))).first()
    assert alone["near_next"] == 1.0


def test_blocks_meet_at_their_cuts(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK_ROWS", 16)
    monkeypatch.setattr(fingerprint, "IDS_A_BLOCK", 4)
    ids = [k * k for k in range(300)]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(None, "null id"), (100, "again")], "doc_id bigint, text string").repartition(5)
    found = fingerprint.with_edits(df)
    rows = sorted(((-1 if i is None else i), t) for i, t in df.collect())
    assert found.rdd.getNumPartitions() > 5 and found.count() == len(rows)
    wanted = []
    for k, (i, text) in enumerate(rows):
        half = len(text) // 2
        wanted.append((i, hashlib.sha256((text[: len(text) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()))
    assert sorted(((-1 if x["doc_id"] is None else x["doc_id"]), x["edited_sha256"]) for x in found.collect()) == sorted(wanted)


def test_collisions_are_told_apart(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "One "), (2, "one"), (None, "two"), (4, "four")], "doc_id bigint, text string")
    same = lambda canon: "four" if canon == "four" else "same"
    found = fingerprint.resolved(written(fingerprint.with_edits(df, same)), df, same).collect()
    prints = sorted((str(x["doc_id"]), x["n_chars"], x["fingerprint"]) for x in found)
    assert prints == [("1", 3, "same-1"), ("2", 3, "same-1"), ("2", 3, "same-2"), ("3", 4, "same-1"), ("4", 4, "four"), ("None", 3, "same-2")]
    # the edited text of a document whose next one has the same text is its own
    assert {x["edited_fingerprint"] for x in found if x["near_edited"] == 1} <= {"same-1", "same-2", "four"}


def test_lattice():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 8)) * 2
    found = lattice.nearest(x)
    whole = np.all(found == np.rint(found), axis=1)
    assert (np.all(found - 0.5 == np.rint(found - 0.5), axis=1) | whole).all() and (found.sum(1) % 2 == 0).all()
    near = lattice.neighbours()
    assert len(near) == len({tuple(v) for v in near}) == 240 and np.allclose((near**2).sum(1), 2)
    closest = ((x[:, None] - found[:, None] - near) ** 2).sum(2).min(1)
    assert (((x - found) ** 2).sum(1) <= closest + 1e-9).all()


def test_op7(spark, tables):
    r = np.random.default_rng(2)
    centre = r.normal(size=(40, 64))
    rows = [c + r.normal(size=64) * r.choice([0.05, 0.2, 0.22]) for c in centre for _ in range(8)]
    crowd = r.normal(size=64)
    rows += [crowd + r.normal(size=64) * 0.12 for _ in range(80)] + [rows[0]] * 5 + [rows[1] * 3]
    data = [(k, [float(v) for v in np.float32(x)], 0) for k, x in enumerate(rows)]
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, None] + [0.5] * 62, [1.0, 2.0], [2.0, 4.0], [1e-40] * 64]
    data += [(1000 + k, v, None) for k, v in enumerate(bad)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").repartition(3)
    found = {x["vec_id"]: x for x in neardup.op7_vectors(spark, tables(embeddings=df)).collect()}
    assert len(found) == len(data)
    x = np.array([v for _, v, _ in data[: len(rows)]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    links = [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b]
    counts = near.sum(1) - 1
    got = np.array([found[k]["n_links"] for k in range(len(rows))])
    assert (got <= counts).all() and got.sum() >= 0.99 * counts.sum()
    if (got == counts).all():
        wanted = roots(range(len(rows)), links)
        assert all(found[k]["component_id"] == wanted[k] for k in wanted)
    assert all(found[1000 + k]["n_links"] == 0 and found[1000 + k]["kept"] for k in range(6))
    assert found[1007]["component_id"] == 1006 and found[1006]["n_links"] == 1
    assert neardup.op7_vectors(spark, tables(embeddings=df.limit(0))).count() == 0


def test_op7_null_and_repeated_ids(spark, tables):
    v = lambda *x: [*map(float, x)]
    a, near_a, b, c, near_c = v(1, 0, 0, 0, 0, 0, 0, 0), v(1, 0.1, 0, 0, 0, 0, 0, 0), v(0, 1, 0, 0, 0, 0, 0, 0), v(0, 0, 1, 0, 0, 0, 0, 0), v(0, 0, 1, 0.1, 0, 0, 0, 0)
    data = [(None, a, "x"), (5, near_a, "x"), (5, b, "x"), (None, c, "x"), (None, near_c, "x"), (9, b, None), (None, None, None), (7, None, "x"), (5, near_a, "x")]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, links string").withColumn("rep", F.lit("clash")).withColumn("key", F.lit(1))
    found = sorted(map(repr, ((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in neardup.op7_vectors(spark, tables(embeddings=df)).collect())))
    wanted = [(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (5, 1, 5, True), (9, 1, 5, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (7, 0, 7, True)]
    assert found == sorted(map(repr, wanted))


def test_op9_null_ids_and_clashing_columns(spark, tables):
    r = random.Random(11)
    text = lambda: " ".join(str(r.randrange(500)) for _ in range(300))
    a, b, c = text(), text(), text()
    rows = [(None, a), (4, a), (None, b), (None, b + " "), (7, c), (7, a), (2, None), (None, ""), (3, " \n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("key", F.lit(None).cast("string"))
    found = sorted(map(repr, ((x["doc_id"], x["fingerprint"], x["component_id"]) for x in simhash.op9_simhash(spark, tables(documents=df)).collect())))
    named = {a: 4, b: None, b + " ": None, c: 7, None: 2, "": 2, " \n": 2}
    assert found == sorted(map(repr, ((i, f"{brute_fingerprint(t):016x}", named[t]) for i, t in rows)))


def test_crowded_meetings_are_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 8)
    r = random.Random(5)
    centre = r.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in r.sample(range(20), r.randint(0, 9))) for _ in range(300)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(prints)], "fp bigint, rep bigint")
    found = {x["node"]: x["component"] for x in connected_components(simhash.links(df, 2)).collect()}
    wanted = roots(range(len(prints)), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {k: found.get(k, k) for k in wanted} == wanted


def test_crowded_cells_are_split_exactly(spark, tables, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r = np.random.default_rng(5)
    crowd = r.normal(size=64)
    data = [(k, [float(v) for v in np.float32(crowd + r.normal(size=64) * 0.1)], 0) for k in range(150)]
    found = {x["vec_id"]: x for x in neardup.op7_vectors(spark, tables(embeddings=spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int"))).collect()}
    x = np.array([v for _, v, _ in data])
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert [found[k]["n_links"] for k in range(150)] == ((x @ x.T >= 0.95).sum(1) - 1).tolist()
