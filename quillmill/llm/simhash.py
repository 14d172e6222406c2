"""SimHash near-duplicates with pivot distance tables.

Fingerprints of at most `radius` differing bits are linked, none missed:

* equal fingerprints are one class;
* each class has a table of its Hamming distances to reference fingerprints (pivots).
  The pivots are a ladder: the t-th is the base fingerprint with its first t bits turned
  over.  From one rung to the next a distance goes up or down by one, and it goes the same
  way for two fingerprints unless they differ in that bit.  So of radius + a stretches of
  the ladder at least a are climbed alike by fingerprints of at most `radius` differing
  bits: classes meet under the way their distances go along each choice of a stretches.
  a follows from the number of classes, so meetings stay small as the corpus grows;
* in a meeting pairs are discarded whose tables of distances to further, unrelated pivots
  differ by more than `radius` in any coordinate (the triangle inequality), and survivors
  are verified bit by bit;
* meetings of more than `SPLIT` classes are dealt out as pairs of blocks, so none meets in
  one task.

A meeting gives links that span its linked groups, not all its pairs, so a large
group of near copies costs about its size.  Components of the links follow.  Python only
hashes the shingles, measures distances and compares within meetings.

Null and empty texts have fingerprint zero and are linked like others.  Texts of fewer
words than a shingle count as one shingle.  Very long texts are hashed in blocks of
shingles.  Rows are documents of their own, with an equal doc_id or a null one too: a row
without an id is compared like others, and its component's id is null only if no row of the
component has one.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import short_batches, table, written
from quillmill.llm.components import connected_components

RADIUS = 4
WORDS = 4
SEED = 42
PIVOTS = 16
BITS = 64
#: Meetings larger than this are searched from one member outwards.
SMALL = 48
#: Classes of one block of a meeting; larger meetings are dealt out by pairs of blocks.
SPLIT = 4096
#: What sending one row to a meeting costs, in comparisons of pairs.
ROW_COST = 50
SHINGLES_AT_ONCE = 200_000


@functools.cache
def pivots() -> np.ndarray:
    """Reference fingerprints that are far from each other, as random bits are."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {k}".encode(), SEED) for k in range(PIVOTS)], np.uint64)


@functools.cache
def ladder() -> np.ndarray:
    """Reference fingerprints each of which has one more bit turned over than the one before."""
    base = xxhash.xxh64_intdigest(b"ladder", SEED)
    return np.array([base ^ ((1 << t) - 1) for t in range(BITS + 1)], np.uint64)


def distances(fp: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot distance table: references by fingerprints."""
    return np.stack([np.bitwise_count(fp ^ p).astype(np.int16) for p in references])


def stretches(classes: int, radius: int) -> int:
    """How many stretches of the ladder a key holds: the number that costs least, in rows
    sent to meetings and in pairs compared there."""

    def cost(a: int) -> float:
        return math.comb(radius + a, a) * (ROW_COST + classes / 2 ** (BITS * a / (radius + a)))

    return min(range(2, 9), key=cost)


def cells(fp: np.ndarray, radius: int, agreeing: int) -> np.ndarray:
    """Keys of fingerprints, fingerprints by choices of stretches: the steps that the
    distances take along those stretches, and which they are."""
    steps = (np.diff(distances(fp, ladder()), axis=0) > 0).astype(np.uint64)
    count = radius + agreeing
    edges = [BITS * k // count for k in range(count + 1)]
    climbed = [sum((steps[t] << np.uint64(t - a) for t in range(a, b)), np.zeros(len(fp), np.uint64)) for a, b in itertools.pairwise(edges)]
    out = []
    for number, chosen in enumerate(itertools.combinations(range(count), agreeing)):
        key = np.full(len(fp), number + 1, np.uint64)
        for k in chosen:  # mixed, as many stretches do not fit into 64 bits beside the number
            key = (key ^ climbed[k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out.append(key)
    return np.stack(out, 1).view(np.int64)


def plain_words(text: str | None) -> bytes:
    """Lower-case words with one blank between them."""
    return b" ".join((text or "").encode().lower().split())


def shingle_hashes(plain: bytes, words: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles, some at a time."""
    if not plain:
        return
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20)
    digest = xxhash.xxh64_intdigest
    if len(gaps) < words:
        yield np.array([digest(plain, SEED)], "<u8")
        return
    starts = np.concatenate([[0], gaps[: len(gaps) - words + 1] + 1])
    ends = np.append(gaps[words - 1 :], len(plain))
    for lo in range(0, len(starts), SHINGLES_AT_ONCE):
        a, b = starts[lo : lo + SHINGLES_AT_ONCE].tolist(), ends[lo : lo + SHINGLES_AT_ONCE].tolist()
        yield np.fromiter((digest(plain[x:y], SEED) for x, y in zip(a, b, strict=True)), "<u8", len(a))


def of_hashes(parts: list[np.ndarray]) -> int:
    """The fingerprint of a text with these shingle hashes."""
    total, set_bits = sum(map(len, parts)), np.zeros(BITS, np.int64)
    if not total:
        return 0
    for hashes in parts:
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    return of_hashes(list(shingle_hashes(plain_words(text), words)))


def fingerprints(df: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit integer."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _meetings(classes: DataFrame, radius: int, agreeing: int) -> DataFrame:
    """(key, fp, rep) for each choice of stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            keys = cells(fp.view(np.uint64), radius, agreeing)
            each = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp, each)), pa.array(np.repeat(batch.column(1).to_numpy(), each))], ["key", "fp", "rep"])

    return classes.select("fp", "rep").mapInArrow(run, "key bigint, fp bigint, rep bigint")


def near(fp: np.ndarray, far: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (a, b) are linked: first by their tables of distances, then bit by bit."""
    for k in range(len(far)):
        keep = np.abs(far[k, a] - far[k, b]) <= radius
        a, b = a[keep], b[keep]
    keep = np.bitwise_count(fp[a] ^ fp[b]) <= radius
    return np.stack([a[keep], b[keep]])


def _links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the linked groups of each run of equal keys."""
    bounds = np.append(np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key))
    sizes = np.diff(bounds)
    far = distances(fp, pivots())
    out: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    at = np.flatnonzero(small)
    for step in range(1, SMALL):
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        if not len(at):
            break
        a, b = near(fp, far, at, at + step, radius)
        out.append((rep[a], rep[b]))
    for g in np.flatnonzero(sizes > SMALL):
        left = np.arange(bounds[g], bounds[g + 1])
        left = left[np.argsort(rep[left])]
        while len(left):
            seed, left = left[0], left[1:]
            reached = [seed]
            while reached and len(left):
                x = reached.pop()
                _, found = near(fp, far, np.full(len(left), x), left, radius)
                if len(found):
                    out.append((rep[found], np.full(len(found), rep[seed])))
                    reached += found.tolist()
                    left = left[~np.isin(left, found)]
    a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
    return a, b


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """classes: (fp, rep), one row per fingerprint; it is read several times, so it should
    be a written table.  Returns links (a, b) between reps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the rows of the last key, which may go on in the next batch

        def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = _links(rows[0], rows[1].view(np.uint64), rows[2], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in ("key", "fp", "rep")])
            if rows[0, -1] == rows[0, 0] and (not held or held[-1][0, -1] == rows[0, 0]):
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows], axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            if cut:
                yield from emit(np.ascontiguousarray(rows[:, :cut]))
            held = [rows[:, cut:]]
        if held:
            yield from emit(np.ascontiguousarray(np.concatenate(held, axis=1)))

    met = _meetings(classes, radius, stretches(classes.count(), radius))
    crowded = written(met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT))
    # a crowded meeting becomes a meeting of each two of its blocks
    blocks = F.ceil(F.col("n") / SPLIT).cast("int")
    split = met.join(crowded, "key").withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    split = split.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "rep")
    dealt = met.join(crowded, "key", "left_anti").unionByName(split).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for each document."""
    found = written(fingerprints(df, words))
    classes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(links(classes.select("fp", F.col("fp").alias("rep")), radius))
    named = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    heads = named.groupBy("part").agg(F.min("least").alias("component_id"))
    # written, so that the join deals both sides anew and a large class can be split
    heads = written(named.join(heads, "part").select("fp", "component_id"))
    return found.join(heads, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL: dict[str, str] = {}
