"""Canonical exact digests of documents.

The canonical form of a text is its Unicode compatibility normalisation, case folded,
with runs of white space as one space.  Its fingerprint is a 128-bit xxhash.  Texts
with equal fingerprints form a bucket, and inside a bucket canonical bytes are
compared: should two differ, their fingerprints get the rank of their bytes as a
suffix.  Only the texts of buckets with several documents are compared, and equal ones
are combined before they are shuffled, so a bucket with a third of all documents costs
each task one text.

A document's neighbour (the next by doc_id, the first after the last) is found without
a global sort: a bounded sample of ids gives cut points, every document goes to the block
between two cuts, and the document at a cut also goes to the end of the block before.
So each text is shuffled once.

Null texts count as empty.  Null ids come first.  Rows with equal ids are documents of
their own and follow by text; rows with equal ids and texts are each returned.  Rows of one
id are sorted in one block, which spills and is read row by row.  A single document is its
own neighbour; an empty table gives an empty result.  Extra columns are ignored.
Normalisation is Python's, in Arrow batches: Spark has none.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.llm.common import maybe_broadcast, short_batches, table, written

#: Documents of one block, about, the most blocks there are, and sampled ids for each of
#: them: so many times 8 bytes of the driver at most, whatever the size of the corpus.
BLOCK_ROWS = 6000
MOST_BLOCKS = 32_768
IDS_A_BLOCK = 16


def canonical(text: str) -> str:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode())


def checksum(canon: str) -> bytes:
    """What stands for the bytes of a canonical text where suffixes are given out."""
    return hashlib.sha256(canon.encode()).digest()


def in_blocks(df: DataFrame) -> DataFrame:
    """df (doc_id, text) dealt by ranges of doc_id and sorted, with a column tail that is
    true in the last rows of a partition: those of the document after the partition's."""
    spark = df.sparkSession
    size = df.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    every = max(1, max(BLOCK_ROWS, size["n"] // MOST_BLOCKS) // IDS_A_BLOCK)
    sample = np.sort(df.select("doc_id").filter(F.pmod(F.xxhash64(F.lit("cut"), "doc_id"), F.lit(every)) == 0).distinct().toPandas()["doc_id"].dropna().to_numpy(np.int64))
    least = np.iinfo(np.int64).min
    first = least if size["nulls"] or size["first"] is None else size["first"]
    cuts = sample[IDS_A_BLOCK::IDS_A_BLOCK]
    cuts = cuts[cuts > first]
    shared = spark.sparkContext.broadcast(cuts)
    blocks = len(cuts) + 1

    @F.pandas_udf("block int, tail int")
    def placed(ids: pd.Series) -> pd.DataFrame:
        """The block of an id, and the block whose end it also is, -1 for none."""
        ids = ids.fillna(least).to_numpy(np.int64)
        block = np.searchsorted(shared.value, ids, "right")
        at_cut = (block > 0) & (shared.value[np.maximum(block - 1, 0)] == ids) if blocks > 1 else np.zeros(len(ids), bool)
        tail = np.where(at_cut, block - 1, np.where(ids == first, blocks - 1, -1))
        return pd.DataFrame({"block": block.astype(np.int32), "tail": tail.astype(np.int32)})

    own = F.struct(F.col("at.block").alias("block"), F.lit(False).alias("tail"))
    end = F.struct(F.col("at.tail").alias("block"), F.lit(True).alias("tail"))
    both = df.withColumn("at", placed("doc_id")).withColumn("at", F.explode(F.when(F.col("at.tail") < 0, F.array(own)).otherwise(F.array(own, end))))
    dealt = both.select("doc_id", "text", F.col("at.block").alias("block"), F.col("at.tail").alias("tail"))
    return dealt.repartitionById(blocks, "block").sortWithinPartitions("tail", "doc_id", "text").select("doc_id", "text", "tail")


def with_edits(df: DataFrame, digest: Callable[[str], str] = digest) -> DataFrame:
    """Fingerprints of each document, of its text with the second half taken from the
    next document, how like they are, and checksums that tell canonical texts apart."""
    short_batches(df.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text_sum", "edited_sum"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last document: id, text, canonical form, fingerprint
        over = False
        for batch in batches:
            rows = []
            for doc, text, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "tail")), strict=True):
                if over:
                    continue
                text = text or ""
                canon = canonical(text)
                this = (doc, text, canon, digest(canon))
                if held:
                    doc, text, canon, own = held
                    half = len(text) // 2
                    edited = text[: len(text) - half] + this[1][:half]
                    edited_canon = canonical(edited)
                    rows.append((
                        doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, digest(edited_canon), float(canon == edited_canon), float(canon == this[2]),
                        checksum(canon), checksum(edited_canon),
                    ))
                held, over = this, tail
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return in_blocks(df.select(F.col("doc_id").cast("long"), "text")).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text_sum binary, edited_sum binary"
    )


def collided(found: DataFrame, df: DataFrame, digest: Callable[[str], str] = digest) -> DataFrame:
    """(fingerprint, sum, suffix) of the canonical texts of df that share a fingerprint with
    another: compares the bytes inside each bucket of several documents of found."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list({canonical(x or "") for x in batch.column(0).to_pylist()})
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, texts), pa.string()), pa.array(texts, pa.string())], ["fingerprint", "canon"])

    # written, so that the join deals both sides anew and a large bucket can be split
    shared = written(found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint"))
    texts = df.select("text").mapInArrow(run, "fingerprint string, canon string").join(maybe_broadcast(shared, 64 * shared.count()), "fingerprint")
    # one row for each bucket and text; grouping compares the bytes
    distinct = texts.groupBy("fingerprint", F.xxhash64("canon").alias("h"), "canon").agg(F.count(F.lit(1)).alias("n"))
    mixed = distinct.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint")
    rank = F.dense_rank().over(W.partitionBy("fingerprint").orderBy("canon"))
    mixed = written(mixed)
    if mixed.isEmpty():
        return mixed.select("fingerprint", F.lit(b"").alias("sum"), F.lit("").alias("suffix"))
    return distinct.join(mixed, "fingerprint").select("fingerprint", F.unhex(F.sha2("canon", 256)).alias("sum"), F.concat(F.lit("-"), rank.cast("string")).alias("suffix"))


def resolved(found: DataFrame, df: DataFrame, digest: Callable[[str], str] = digest) -> DataFrame:
    """found, rows of `with_edits` in a written table, with fingerprints that are equal only
    where canonical bytes are."""
    wrong = written(collided(found, df, digest))
    if not wrong.isEmpty():
        for name, by in (("fingerprint", "text_sum"), ("edited_fingerprint", "edited_sum")):
            own = wrong.select(F.col("fingerprint").alias(name), F.col("sum").alias(by), F.col("suffix"))
            found = found.join(own, [name, by], "left").withColumn(name, F.concat(name, F.coalesce("suffix", F.lit("")))).drop("suffix")
    return found.drop("text_sum", "edited_sum")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resolved(written(with_edits(documents)), documents)


QUERIES = {"op4_fingerprint": op4_fingerprint}
ORACLE_SQL: dict[str, str] = {}
