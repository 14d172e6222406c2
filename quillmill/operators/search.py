"""Full-text search over an inverted index table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of letters and digits are words.
WORDS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORDS), lambda x: x != "")


def index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(word, key, positions): where each word stands in each document."""
    placed = df.select(key, F.posexplode(words(F.col(text))).alias("pos", "word"))
    return placed.groupBy("word", key).agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def matching(found: DataFrame, key: str, query: str, every: bool = True, prefix: bool = False) -> DataFrame:
    """(key, hits): documents with all words of the query, or with any of them, and how
    often they have them.  prefix: the last word may go on."""
    wanted = [w for w in dict.fromkeys(query.lower().split()) if w]
    if not wanted:
        raise ValueError("empty query")
    is_word = [F.col("word") == w for w in wanted]
    if prefix:
        is_word[-1] = F.startswith("word", F.lit(wanted[-1]))
    number = F.coalesce(*(F.when(c, F.lit(k)) for k, c in enumerate(is_word)))
    hits = found.withColumn("_nth", number).filter("_nth is not null").groupBy(key)
    out = hits.agg(F.sum(F.size("positions")).cast("bigint").alias("hits"), F.count_distinct("_nth").alias("_kinds"))
    return (out.filter(F.col("_kinds") == len(wanted)) if every else out).select(key, "hits")


def phrase(found: DataFrame, key: str, query: str) -> DataFrame:
    """(key, hits): documents in which the words of the query follow each other."""
    wanted = query.lower().split()
    if not wanted:
        raise ValueError("empty query")
    starts = None
    for k, word in enumerate(wanted):
        here = found.filter(F.col("word") == word).select(key, F.explode("positions").alias("_p")).select(key, (F.col("_p") - k).alias("_start"))
        starts = here if starts is None else starts.join(here, [key, "_start"])
    return starts.groupBy(key).agg(F.count(F.lit(1)).alias("hits"))


def ranked(found: DataFrame, key: str, documents: int, query: str, limit: int) -> DataFrame:
    """The best documents for any word of the query: the sum over words of hits times the
    log of how rare the word is; equal scores by key."""
    wanted = list(dict.fromkeys(query.lower().split()))
    own = found.filter(F.col("word").isin(wanted)).select("word", key, F.size("positions").alias("n"))
    rare = own.groupBy("word").agg(F.ln(F.lit(float(documents)) / F.count(F.lit(1))).alias("rare"))
    scored = own.join(rare, "word").groupBy(key).agg(F.round(F.sum(F.col("n") * F.col("rare")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(limit)
