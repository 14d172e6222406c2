"""Cross-site boilerplate removal by distinct-site spread, with DataFrame functions only.

Every line of some length has a 64-bit hash.  A HyperLogLog sketch of the sites that
show it is made per line hash; sketches of the same line merge as aggregation goes on,
so a line in a third of all documents costs each task one sketch.  The estimate
decides where it is clear; lines whose estimate is within three standard errors of the
threshold get an exact distinct count.  Lines on at least `sites` sites are
boilerplate: they are removed from every document but the one with the smallest
doc_id that holds them, so that no text vanishes from the corpus, not even one that
was copied to many sites as a whole.

Lines are told apart by their 64-bit hash.  Null texts stay null.  Null sites count for
nothing.  Documents whose lines all go keep an empty text.  Rows with equal ids count as
one document; those without an id count for a line's sites and keep their own lines.
Lines of fewer than `chars` characters are left alone.  Extra columns pass through; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import discard, maybe_broadcast, table, written

SITES = 5
CHARS = 20
#: Base-2 log of a sketch's registers, and its standard error.
SKETCH_BITS = 9
ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
#: What a row of line hashes takes in a broadcast.
LINE_BYTES = 48


def boilerplate(lines: DataFrame, sites: int) -> DataFrame:
    """lines: (hash, site, doc_id).  Returns (hash, first_doc) of lines on so many sites."""
    sketched = lines.groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"), F.min("doc_id").alias("first_doc"))
    spread = written(
        sketched.select("hash", "first_doc", F.hll_sketch_estimate("sketch").alias("spread")).filter(F.col("spread") >= F.lit(sites * (1 - 3 * ERROR) - 0.5))
    )
    near = spread.filter(F.col("spread") <= F.lit(sites * (1 + 3 * ERROR) + 0.5))
    seen = lines.join(maybe_broadcast(near.select("hash"), LINE_BYTES * near.count()), "hash", "left_semi")
    exact = seen.groupBy("hash", "site").agg(F.count(F.lit(1))).groupBy("hash").agg(F.count("site").alias("exact")).filter(F.col("exact") >= sites)
    sure = spread.filter(F.col("spread") > F.lit(sites * (1 + 3 * ERROR) + 0.5))
    return sure.select("hash", "first_doc").unionByName(near.join(exact, "hash").select("hash", "first_doc"))


def dedup_lines(df: DataFrame, site: str = "source", sites: int = SITES, chars: int = CHARS) -> DataFrame:
    """df without boilerplate lines in its column text, and n_removed, how many went."""
    # everything of df stays inside one column, so that no name of its own can clash
    rows = df.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("copy"), F.col(site).cast("string").alias("site"))
    placed = rows.select("doc_id", "copy", "site", F.posexplode(F.split("row.text", "\n", -1)).alias("pos", "line")).filter(F.char_length("line") >= chars)
    lines = written(placed.select("doc_id", "copy", "site", "pos", F.xxhash64("line").alias("hash")))
    common = written(boilerplate(lines.select("hash", "site", "doc_id"), sites))
    hits = lines.join(maybe_broadcast(common, LINE_BYTES * common.count()), "hash").filter("doc_id <> first_doc")
    bad = written(hits.select("doc_id", "copy", "pos").groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set(F.col("pos") + 1)).alias("bad")))
    discard(lines, common)
    # a shuffle at every size: documents with boilerplate grow with the corpus
    found = rows.select("row", "doc_id", "copy").join(bad.hint("merge"), ["doc_id", "copy"], "left")
    # what stands between two removed lines stays: time follows the lines, however many go
    found = found.withColumn("parts", F.when(F.col("bad").isNotNull(), F.split("row.text", "\n", -1)))
    found = found.withColumn("edges", F.concat(F.array(F.lit(0)), "bad", F.array(F.size("parts") + 1)))
    between = F.transform(F.sequence(F.lit(2), F.size("edges")), lambda k: F.slice("parts", F.element_at("edges", k - 1) + 1, F.element_at("edges", k) - F.element_at("edges", k - 1) - 1))
    kept = F.when(F.col("bad").isNull(), F.col("row.text")).otherwise(F.array_join(F.flatten(between), "\n"))
    removed = F.when(F.col("bad").isNull(), F.lit(0)).otherwise(F.size("bad")).cast("long")
    return found.select(*(kept.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in df.columns if c != "n_removed"), removed.alias("n_removed"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(documents).select("doc_id", "n_removed", "text")


QUERIES = {"op8_lines": op8_lines}
ORACLE_SQL = {
    "op8_lines": f"""
WITH lines AS (
  SELECT doc_id, source, pos, parts[pos] AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
       unnest(range(1, len(parts) + 1)) AS p(pos)
), common AS (
  SELECT line, min(doc_id) AS first_doc FROM lines WHERE length(line) >= {CHARS}
  GROUP BY line HAVING count(DISTINCT source) >= {SITES}
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.line IS NOT NULL AND c.first_doc <> l.doc_id AS bad
  FROM lines l LEFT JOIN common c ON l.line = c.line
), joined AS (
  SELECT doc_id, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(j.n_removed, 0) AS n_removed, j.text AS text
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""
}
