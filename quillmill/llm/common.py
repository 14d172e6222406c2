"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows and bytes of one Arrow batch sent to Python; a longer row is a batch of its own.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20

#: Characters that one vectorised step works on at once.
SLICE_CHARS = 3_000_000

#: A side of more bytes than this is joined by shuffle and never broadcast.
BROADCAST_BYTES = 64 << 20

#: Where a text can be cut between two words that no pattern of words or pre-tokens joins.
BOUND = re.compile(r"(?<=\S)(?:\n| (?=\S))")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, for the Python operators.  The setting is read
    when a plan runs, so it stays for the session; a smaller one of the caller is kept."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:  # Spark's own form; others are the caller's
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is
    unset and all run on this machine, a folder made once for the session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quillmill.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("quillmill.shared.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again.  This cuts the lineage in a
    way that survives lost executors and is the one place where work is shared.  What
    `discard` has not deleted goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by `written` that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("quillmill-"):
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def maybe_broadcast(df: DataFrame, size: int) -> DataFrame:
    """Marks df for broadcast if its bytes, as counted by the caller, are within the bound."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def cuts(text: str, most: int) -> Iterator[str]:
    """The parts of a text, of `most` characters and a word at most where it has bounds of words."""
    start = 0
    while len(text) - start > most:
        found = BOUND.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def slices(lengths: np.ndarray, most: int = SLICE_CHARS):
    """Ranges of consecutive rows whose lengths add up to about `most`; one longer row
    is a range of its own, which `cuts` takes apart."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each start and length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def ranked(df: DataFrame, keys: list[str], order: list[str], rows: int, name: str, groups: int) -> DataFrame:
    """Adds `name`, a gapless rank from 0 within each key, without ever bringing a
    key's rows together: rows are numbered within hash buckets of the key, and each
    bucket starts where the counts of the buckets before it end.  rows: how many rows
    df has, which fixes the number of buckets; groups: about how many keys there are.

    The rank is by bucket, then by `order`."""
    buckets = max(16, -(-rows // (20_000 * max(1, groups))))
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    ends = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(ends), F.lit(0)).alias("_start"))
    numbered = cut.withColumn("_row", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)))
    joined = numbered.join(starts, [*keys, "_bucket"])
    return joined.withColumn(name, (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_bucket", "_row", "_start")
