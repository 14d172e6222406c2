"""Connected components over a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import discard, written

#: Rounds after which something is wrong: the number needed grows with the logarithm
#: squared of the largest component at most, and with its logarithm in practice, so 60 are
#: enough for any table.  Nothing is lost beyond them: it is an error.
MOST_ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """One step.  edges: (a, b) with a > b, distinct.  Every node links its larger
    (large star) or its smaller neighbours (small star) to the least of them.  Returns
    the new edges, and a written table that they are read from."""
    if small:
        near = edges
    else:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that the join below deals both sides anew and a hub's links can be split
    least = written(near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")))
    seen = near.join(least, "a")
    if small:
        out = seen.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = seen.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a > b").distinct(), least


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long) in any direction, repeats and loops included.  Returns
    (node, component) for every node with a link to another; component is the least
    node it reaches.  Every round is a written table, so the plan does not grow and no
    round depends on one executor's disk."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    print_of = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    before = now.agg(print_of.alias("p")).first()["p"]
    for _ in range(MOST_ROUNDS):
        if not before["n"]:
            break
        larger, first = _star(now, small=False)
        smaller, second = _star(larger, small=True)
        following = written(smaller)
        after = following.agg(print_of.alias("p")).first()["p"]
        discard(now, first, second)
        now = following
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
