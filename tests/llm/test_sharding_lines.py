import collections
import math
import zlib

import duckdb
import xxhash
from pyspark.sql import functions as F

from quillmill.llm import linededup, sharding


def test_op3(spark, tables, odd_documents):
    more = spark.range(2000).select((F.col("id") + 1000).alias("doc_id"), F.col("id").cast("string").alias("text"))
    d = tables(documents=odd_documents.unionByName(more, allowMissingColumns=True))
    rows = spark.read.parquet(d + "/documents.parquet").collect()
    found = sharding.op3_sharding(spark, d).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == sorted((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert set(slots) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r["shard"] for r in found if r["doc_id"] == 104}) == 1
    assert 20 <= min(map(len, slots.values())) and max(map(len, slots.values())) <= 90
    assert 0 < sum(r["grown_shard"] == 40 for r in found) < 110
    assert sharding.op3_sharding(spark, tables(documents=odd_documents.limit(0))).count() == 0


def test_weights_and_confined_moves(spark):
    keys = spark.range(8000).withColumn("shard", F.lit("clash"))
    before = sharding.topology(8, base=8, racks=2, region_shards=4)
    heavier = [*before[:2], sharding.Shard(before[2].region, before[2].rack, 2, 3.0), *before[3:]]
    a = {r["id"]: r["at"] for r in sharding.assign(keys, F.col("id"), before, "at").collect()}
    b = {r["id"]: r["at"] for r in sharding.assign(keys, F.col("id"), heavier, "at").collect()}
    assert all(abs(n - 1000) < 150 for n in collections.Counter(a.values()).values())
    assert abs(collections.Counter(b.values())[2] - 2400) < 250
    region = {s.number: s.region for s in before}
    assert all(region[b[k]] == region[2] for k in a if a[k] != b[k])  # moves end in the subtree whose weight changed
    for n in range(8, 12):  # every growth moves keys only into the new shard
        more = {r["id"]: r["at"] for r in sharding.assign(keys, F.col("id"), sharding.topology(n + 1, base=8, racks=2, region_shards=4), "at").collect()}
        less = {r["id"]: r["at"] for r in sharding.assign(keys, F.col("id"), sharding.topology(n, base=8, racks=2, region_shards=4), "at").collect()}
        assert {more[k] for k in less if more[k] != less[k]} == {n}


def brute_shard(key, shards):
    """Region, rack and shard by the least draw, one after the other."""

    def draw(name, weight):
        h = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(key.encode(), 42))
        return -math.log(((h >> 12) + 0.5) / 2**52) / weight

    own = shards
    for of in (lambda s: s.region, lambda s: s.rack, lambda s: f"s{s.number}"):
        names = list(dict.fromkeys(map(of, own)))
        best = min(names, key=lambda n: (draw(n, sum(s.weight for s in own if of(s) == n)), names.index(n)))
        own = [s for s in own if of(s) == best]
    return own[0].number


def test_op3_is_a_walk_down_the_tree(spark, tables, odd_documents):
    df = odd_documents.unionByName(spark.createDataFrame([(None, "no id"), (None, None), (-7, "x")], "doc_id bigint, text string"), allowMissingColumns=True).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(1.5))
    found = sharding.op3_sharding(spark, tables(documents=df)).collect()
    assert len(found) == df.count()
    for x in found:
        key = "" if x["doc_id"] is None else str(x["doc_id"])
        assert (x["shard"], x["grown_shard"]) == (brute_shard(key, sharding.topology(40)), brute_shard(key, sharding.topology(41)))
    uneven = [sharding.Shard("r0", "r0/a", 0, 1.0), sharding.Shard("r0", "r0/b", 1, 2.5), sharding.Shard("r1", "r1/a", 2, 0.5), sharding.Shard("r1", "r1/a", 3, 4.0)]
    rows = sharding.assign(spark.range(500), F.col("id"), uneven, "at").collect()
    assert all(r["at"] == brute_shard(str(r["id"]), uneven) for r in rows)


def test_op8_is_its_sql(spark, tables, odd_documents):
    common = "This line is shown on a great many sites."
    rows = [(500 + k, f"{common}\nown text of document {k} {'x' * k}\n{common}\n", None, f"site{k % 7}", 1) for k in range(20)]
    rows += [(600 + k, "Seen on four sites, under the limit.", None, f"site{k % 4}", 1) for k in range(12)] + [(700 + k, "Five sites see this very line.", None, f"site{k % 5}", 1) for k in range(5)]
    df = odd_documents.select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    d = tables(documents=df)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    wanted = con.execute(linededup.ORACLE_SQL["op8_lines"]).fetchall()
    found = [tuple(r) for r in linededup.op8_lines(spark, d).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))
    by = {r[0]: r for r in found}
    assert by[500][1] == 0 and by[501][1] == 2 and common not in by[501][2] and by[600][1] == by[605][1] == 0 and by[700][1] == 0 and by[704][2] == "" and by[100][2] is None
    kept = linededup.dedup_lines(df.withColumn("n_removed", F.lit("clash")).withColumn("hash", F.lit(1)))
    assert kept.filter("doc_id = 501").first()["n_removed"] == 2 and "hash" in kept.columns
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(f"l{k}", f"s{s}", s) for k in range(3, 60) for s in range(k)]
    lines = spark.createDataFrame(rows, "name string, site string, doc_id bigint").withColumn("hash", F.xxhash64("name"))
    for sites in (5, 20, 40):
        found = linededup.boilerplate(lines.select("hash", "site", "doc_id"), sites).join(lines.select("hash", "name").distinct(), "hash")
        assert {r["name"] for r in found.collect()} == {f"l{k}" for k in range(sites, 60)}
