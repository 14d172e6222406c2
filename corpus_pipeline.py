"""The corpus pipeline: language, toxicity, repeated lines, near-duplicates, packing.

Each stage takes all that the one before kept and returns the columns of `documents`,
but for the last, which returns the packed pieces.  Stages are written as Parquet and
read again, so a lost executor costs the stage at hand and no more.

Rows are documents of their own, also where ids are null or repeat: every stage decides on
each.  Null and empty texts have no language and go in the first stage.  Of rows that are
equal in id and text one stays, the one that comes first by a hash of its columns.  Extra
columns pass through until packing, whatever their names; an empty table gives an empty
result.  Very long texts are read in parts and decided on as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.llm import jaccard, language, linededup, packing, toxicity
from quillmill.llm.bpe import vocabulary_path
from quillmill.llm.common import discard, table, written

#: A document whose largest language share is below this has no language of its own.
LEAST_SHARE = 0.4
#: Near-duplicates: words of a shingle, and the Jaccard similarity of linked shingle sets.
SHINGLE_WORDS = 5
LEAST_SIMILARITY = 0.8
#: Bits in which SimHash fingerprints of near-duplicates may differ: of 273 pairs of that
#: similarity in 10,000 documents all differ in 14 or fewer.
RADIUS = 14


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have letters and a prevailing language."""
    found = language.identify(docs, language.fit(docs, F.col("lang")))
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select(*docs.columns)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose probability of being toxic is below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def by_line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines, and the documents that consist of nothing else."""
    found = linededup.dedup_lines(docs)
    changed = F.col("n_removed") > 0
    kept = found.filter(~changed | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def by_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the row with the smallest doc_id, once.

    Rows are told apart by id and text: those without an id are compared like others and
    come last in their group, and rows that share an id but are not near-duplicates all stay."""
    rows = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    groups = jaccard.near_duplicates(rows, SHINGLE_WORDS, LEAST_SIMILARITY, RADIUS)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    heads = rows.select("doc_id", "row").distinct().join(groups, "row").groupBy("component").agg(first.alias("head")).select("head.row")
    kept = rows.join(heads, "row", "left_semi")
    once = F.row_number().over(W.partitionBy("row").orderBy(F.xxhash64(*docs.columns)))
    return kept.withColumn("_nth", once).filter("_nth = 1").select(*docs.columns)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into training sequences."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("language", by_language),
    ("toxicity", by_toxicity),
    ("lines", by_line),
    ("near_duplicates", by_near_duplicate),
    ("packing", into_sequences),
]

#: Language models, segment search and tokenizers have no SQL; tests/llm hold the
#: pipeline against a version that loops over rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if number:
            discard(before)
    return docs
