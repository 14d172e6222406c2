"""Near-duplicates by SimHash, pivot distances and exact Jaccard similarity of word shingles.

SimHash fingerprints and the ladder of pivots of `simhash` bring documents together, at a
`radius` wide enough for the similarity wanted (at 0.8 about a seventh of the bits differ);
the shingle sets themselves decide:

* equal shingle sets are one class, known by its smallest row number;
* classes meet under the way their distances to the ladder go along each choice of
  stretches, as in `simhash`, and under a band of set sizes: sets whose sizes differ by more
  than the similarity allows are not similar.  Every two fingerprints of at most `radius`
  differing bits and fitting sizes meet.  At a wide radius keys select little, so meetings
  are large: their number of pairs, and the cost of rows sent there, fix how many stretches a
  key holds.  Meetings of more than SPLIT classes are dealt out by pairs of blocks;
* in a meeting each class is compared with those whose sizes fit: first the fingerprints bit
  by bit, then the first HEAD bytes of a sketch, a byte of each of BANDS * ROWS minima of the
  set (at 0.8 one pair in 300,000 agrees in fewer than HEAD_AGREED).  What leaves a meeting
  are links that span what may be similar there, and the components of these links are
  clusters: every pair that may be similar is in one;
* inside a cluster pairs are discarded whose pivot distances differ by more than `radius` in
  any coordinate, or whose fingerprints do, or whose sketches agree in fewer than
  LEAST_AGREED bytes (at 0.8 one pair in 50,000).  The shingle sets of the others are
  compared, from one member outwards: what leaves a task are links that span what is linked
  there, and no pairs.  Only pairs whose sets have at least the wanted similarity are links.

A cluster of more than BLOCK classes or BLOCK_CHARS characters is dealt out by pairs of
blocks, so it meets in no single task; a cluster of n classes sends each text n / BLOCK
times.  Nothing is linked by hashes alone, and no meeting or cluster is cut.

Null and empty texts have the empty set and are alike.  Texts of fewer words than a
shingle count as one shingle.  Letters are folded and white space split as by `simhash`.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import simhash
from quillmill.llm.common import discard, short_batches, spans, written
from quillmill.llm.components import connected_components

SEED = 42
BANDS = 24
ROWS = 4
LEAST_AGREED = 60
#: Bytes of a sketch that go to meetings, and how many of them must agree.
HEAD = 16
HEAD_AGREED = 5
#: Classes of one block of a meeting, and what sending a row there costs, in comparisons.
SPLIT = 65536
ROW_COST = 2000
#: Pairs of fingerprints compared at once.
AREA = 1 << 17
#: Classes and characters of one block of a cluster.
BLOCK = 1024
BLOCK_CHARS = 8_000_000
SHINGLES_AT_ONCE = 4096


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted hashes of the text's distinct shingles."""
    parts = list(simhash.shingle_hashes(simhash.plain_words(text), words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


@functools.cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = lambda what: np.array([xxhash.xxh64_intdigest(f"{what} {k}".encode(), SEED) for k in range(BANDS * ROWS)], np.uint64)
    return draw("factor") | np.uint64(1), draw("offset")


def sketch(hashes: np.ndarray) -> bytes:
    """A byte of each of a set's minima."""
    factor, offset = _permutations()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), SHINGLES_AT_ONCE):
        least = np.minimum(least, (hashes[lo : lo + SHINGLES_AT_ONCE, None] * factor + offset).min(0))
    # minima are small numbers, so their high bits say little: mix before taking a byte
    mixed = least * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(56)).astype(np.uint8).tobytes()


def _sketches(df: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, prints, sizes, bytes_, chars = [], [], [], [], []
            for x in batch.column(1):
                parts = list(simhash.shingle_hashes(simhash.plain_words(x.as_py()), words))
                own = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                sets.append(xxhash.xxh3_128_digest(own.tobytes()))
                prints.append(simhash.of_hashes(parts))
                sizes.append(len(own))
                bytes_.append(sketch(own))
                chars.append(len(x.as_py() or ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bytes_, pa.binary()), pa.array(chars, pa.int64())],
                ["row", "set", "fp", "size", "bytes", "chars"],
            )

    return df.select("row", "text").mapInArrow(run, "row bigint, set binary, fp bigint, size bigint, bytes binary, chars bigint")


class Sketches:
    """Members whose fingerprints and bytes say which others may be similar."""

    def __init__(self, signs: np.ndarray, fp: np.ndarray | None = None, radius: int = simhash.BITS):
        self.signs, self.radius = signs, radius
        self.fp = np.zeros(len(signs), np.uint64) if fp is None else fp.view(np.uint64)
        self.far = simhash.distances(self.fp, simhash.pivots()) if len(signs) > 2 else np.zeros((0, len(signs)), np.int16)

    def like(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that may be similar to member x."""
        _, others = simhash.near(self.fp, self.far, np.full(len(others), x), others, self.radius)
        return others[(self.signs[others] == self.signs[x]).sum(1) >= LEAST_AGREED]


def pairs_of(
    rep: np.ndarray,
    signs: np.ndarray,
    fp: np.ndarray | None = None,
    radius: int = simhash.BITS,
    agreed: int = LEAST_AGREED,
    size: np.ndarray | None = None,
    least: float = 0.0,
    guest: np.ndarray | None = None,
    block: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span what may be similar among one meeting's members.  Guests are compared
    with the others only, and are larger than they; if there are two blocks, only members of
    different ones are compared."""
    count = len(rep)
    fp = np.zeros(count, np.uint64) if fp is None else fp.view(np.uint64)
    size = np.ones(count, np.int64) if size is None else size
    guest = np.zeros(count, bool) if guest is None else guest
    order = np.lexsort((rep, size, guest))
    if block is None:
        sides = [(order[~guest[order]], order, True)]
    else:
        low, high = (order[block[order] == x] for x in (block.min(), block.max()))
        sides = [(low[~guest[low]], high, False), (low[guest[low]], high[~guest[high]], False)]
    label = np.arange(count)
    for rows, columns, same in sides:
        first = np.searchsorted(size[columns], np.ceil(size[rows] * least - 1e-6))
        if same:  # the rows are the first of the columns
            first = np.maximum(first, np.arange(1, len(rows) + 1))
        last = np.searchsorted(size[columns], np.floor(size[rows] / least + 1e-6), "right") if least else np.full(len(rows), len(columns))
        own, others = fp[rows], fp[columns]
        hi = 0
        while hi < len(rows):
            lo, hi = hi, min(len(rows), hi + max(1, min(256, AREA // max(1, int(last[hi] - first[hi])))))
            start, end = int(first[lo]), int(last[hi - 1])
            at = np.flatnonzero(np.bitwise_count(own[lo:hi, None] ^ others[None, start:end]) <= radius) if end > start else ()
            if not len(at):
                continue
            i, j = np.divmod(at, end - start)
            i, j = i + lo, j + start
            fits = (j >= first[i]) & (j < last[i])
            a, b = rows[i[fits]], columns[j[fits]]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            alike = (signs[a] == signs[b]).sum(1) >= agreed
            a, b = a[alike], b[alike]
            runs = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
            for x, y in itertools.pairwise(runs if len(a) else ()):
                found = b[x:y]
                names, nth = np.unique(label[found], return_index=True)
                found = found[nth[names != label[a[x]]]]
                if len(found):
                    yield rep[np.full(len(found), a[x])], rep[found]
                    label[np.isin(label, names)] = label[a[x]]


def spanning(rep: np.ndarray, sketches: Sketches, sets: list[np.ndarray], own: np.ndarray, split: bool, least: float) -> tuple[list[int], list[int]]:
    """Links that span what is linked among some members by their shingle sets; if split,
    only between members of different blocks."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    a: list[int] = []
    b: list[int] = []
    left = np.flatnonzero(sizes > 0)
    left = left[np.argsort(rep[left])]
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            others = sketches.like(x, left[own[left] != own[x]] if split else left)
            if not len(others):
                continue
            mark[flat[starts[x] : starts[x] + sizes[x]]] = True
            ends = np.cumsum(sizes[others])
            shared = np.add.reduceat(mark[flat[spans(starts[others], sizes[others])]].astype(np.int64), ends - sizes[others])
            mark[flat[starts[x] : starts[x] + sizes[x]]] = False
            found = others[shared >= least * (sizes[x] + sizes[others] - shared)]
            if len(found):
                left = left[~np.isin(left, found)]
                reached += found.tolist()
                a += [int(rep[x])] * len(found)
                b += rep[found].tolist()
    return a, b


def bands(least: float, most: int) -> np.ndarray:
    """Where bands of set sizes begin: sets of a similarity of `least` or more are in one
    band or in two that follow each other."""
    begin = [0, 1]
    while begin[-1] <= most:
        begin.append(math.floor(begin[-1] / least + 1e-6) + 1)
    return np.array(begin)


def stretches(classes: int, pairs: int, radius: int) -> int:
    """How many stretches of the ladder a key holds: the number that costs least.  pairs:
    those of fitting bands.  None are left at a radius of all bits, where every pair meets."""

    def cost(a: int) -> float:
        return math.comb(radius + a, a) * (2 * classes * ROW_COST + pairs / 2 ** (simhash.BITS * a / (radius + a)))

    most = min(8, simhash.BITS - radius)
    return min(range(min(1, most), most + 1), key=cost)


def _meetings(classes: DataFrame, radius: int, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """classes: (rep, fp, size, bytes).  (key, rep, fp, size, head, guest, block, split) of all
    meetings, and the written tables that they are read from."""
    begin = bands(least, classes.agg(F.max("size")).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = simhash.cells(batch.column(1).to_numpy().view(np.uint64), radius, agreeing)
            listed = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * keys.shape[1], keys.ravel())
            band = np.searchsorted(begin, batch.column(2).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(band, pa.int64()), listed], ["rep", "fp", "size", "head", "band", "keys"])

    # bands are few, a logarithm of the largest size
    band = F.expr(f"size(filter(array({', '.join(map(str, begin))}), x -> x <= size))")
    counts = dict(classes.groupBy(band.cast("int").alias("band")).count().collect())
    pairs = sum(n * (n // 2 + counts.get(k + 1, 0)) for k, n in counts.items())
    agreeing = stretches(sum(counts.values()), pairs, radius)
    head = F.substring("bytes", 1, HEAD).alias("head")
    keyed = written(classes.select("rep", "fp", "size", head).mapInArrow(run, "rep bigint, fp bigint, size bigint, head binary, band bigint, keys array<bigint>"))
    each = keyed.select("*", F.posexplode("keys").alias("choice", "key")).withColumn("at", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    met = each.select(F.xxhash64("choice", "key", "at").alias("key"), "rep", "fp", "size", "head", (F.col("at") < F.col("band")).alias("guest"))
    crowded = written(met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT))
    # a crowded meeting becomes a meeting of each two of its blocks
    blocks = F.ceil(F.col("n") / SPLIT).cast("int")
    split = met.join(crowded, "key").withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    split = split.select(key.alias("key"), "rep", "fp", "size", "head", "guest", "block", (F.col("block") != F.col("other")).alias("split"))
    whole = met.join(crowded, "key", "left_anti").withColumn("block", F.lit(0)).withColumn("split", F.lit(False))
    return whole.unionByName(split), [keyed, crowded]


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one key after another, in batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        changes = np.zeros(len(batch), bool)
        for k in keys:
            values = batch.column(k).to_numpy()
            changes[1:] |= values[1:] != values[:-1]
            changes[0] |= bool(held) and held[-1].column(k)[-1].as_py() != values[0]
        cuts_ = np.flatnonzero(changes).tolist()
        for lo, hi in zip([0, *cuts_], [*cuts_, len(batch)], strict=True):
            if lo in cuts_ and held:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _signs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _walks(meetings: DataFrame, radius: int, least: float) -> DataFrame:
    """Distinct pairs (a, b) of reps, a < b, that lead from each member of a meeting to all
    that may be similar."""

    def emit(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        bounds = np.append(np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]]), len(rows[0]))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rep, fp, size, guest, block, split, signs = (x[lo:hi] for x in rows[1:])
            if hi - lo > 1 and not guest.all():
                out += pairs_of(rep, signs, fp, radius, HEAD_AGREED, size, least, guest, block if split[0] else None)
        if out:
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the rows of the last key, which may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            rows = (*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)), _signs(batch.column(7)))
            if rows[0][-1] == rows[0][0] and (not held or held[-1][0][-1] == rows[0][0]):
                held.append(rows)
                continue
            rows = tuple(np.concatenate(x) for x in zip(*held, rows, strict=True))
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield from emit(tuple(x[:cut] for x in rows))
            held = [tuple(x[cut:] for x in rows)]
        if held:
            yield from emit(tuple(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = meetings.select("key", "rep", "fp", "size", "guest", "block", "split", "head").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _links(clusters: DataFrame, classes: DataFrame, df: DataFrame, words: int, least: float, radius: int) -> DataFrame:
    """clusters: (node, component).  Links (a, b) that span what is linked in each cluster."""
    own = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    # written, so that the joins below deal both sides anew and a large cluster can be split
    members = written(own.join(classes.select("rep", "fp", "bytes", "chars"), "rep"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("c") / BLOCK_CHARS)).cast("int")
    sizes = written(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c")).select("cluster", F.greatest(blocks, F.lit(1)).alias("blocks")))
    dealt = members.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    texts = df.select(F.col("row").alias("rep"), "text").join(members.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    dealt = dealt.select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "fp", "bytes").join(texts, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, ["cluster", "low", "high"]):
            sets = [shingles(x.as_py(), words) for x in rows["text"]]
            split = rows["low"][0].as_py() != rows["high"][0].as_py()
            a, b = spanning(rows["rep"].to_numpy(), Sketches(_signs(rows["bytes"]), rows["fp"].to_numpy(), radius), sets, rows["own"].to_numpy(), split, least)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    columns = ["cluster", "low", "high", "own", "rep", "fp", "bytes", "text"]
    return dealt.select(*columns).repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, words: int, least: float, radius: int = simhash.BITS) -> DataFrame:
    """df: row, a number that only rows of equal text share, and text.  Returns (row,
    component), the component being the least row that links lead to; once for each row."""
    short_batches(df.sparkSession)
    found = written(_sketches(df, words))
    first = ("fp", "size", "bytes", "chars")
    classes = written(found.groupBy("set").agg(F.min_by(F.struct("row", *first), "row").alias("x")).select("set", F.col("x.row").alias("rep"), *(f"x.{c}" for c in first)))
    meetings, sources = _meetings(classes.select("rep", "fp", "size", "bytes"), radius, least)
    clusters = connected_components(_walks(meetings, radius, least))
    discard(*sources)
    parts = connected_components(_links(clusters, classes, df, words, least, radius))
    named = classes.join(parts, classes.rep == parts.node, "left").select("set", F.coalesce("component", "rep").alias("component"))
    return found.select("row", "set").distinct().join(named, "set").select("row", "component")
