"""Near-duplicate vectors by lattice hashing.

* Equal vectors are one class, counted as often as it occurs.
* In each of several tables, two groups of eight random orthogonal projections are
  decoded to points of the E8 lattice; the pair of points is the vector's cell.  The
  vector also stands in the neighbouring cells it is nearest to.
* Classes that stand in the same cell are compared by cosine in double precision.  A
  pair counts where it first meets, in the order of tables and cells, so no pair is
  listed and none counts twice.
* A crowded cell is split into blocks of members, and pairs of blocks are compared as
  matrix products, so no cell, however full, meets in one task.  A cell of n classes
  sends each vector n / BLOCK times and compares all its pairs: counts of links are exact.
* What leaves a task is, for each member, its number of links and one link to the
  least member it is connected with there.  Components of those links follow.

Links are exact; which pairs meet is a matter of chance, with a recall above 0.99 at
the threshold for `TABLES` tables (tests/llm measure it against brute force).

Vectors that are null, empty, zero or hold a null or non-finite component link with
nothing.  Vectors of different lengths never link.  Rows are vectors of their own, with an
equal vec_id or a null one too: the component of a row is the smallest vec_id that links
lead to, and null only if none of its rows has one.  Extra columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import lattice
from quillmill.llm.common import short_batches, table, written
from quillmill.llm.components import connected_components

COSINE = 0.95
TABLES = 5
PROBES = 4
#: Distance between lattice points in units of a unit vector's projections.
SCALE = 0.22
SEED = 7
#: Members of one block of a crowded cell, and rows compared at once.
BLOCK = 512
ROWS = 4096
SMALL = 32


@functools.cache
def projection(dims: int, number: int) -> np.ndarray:
    """Sixteen orthogonal directions, scaled so that lengths are kept on average."""
    wide = np.random.default_rng([SEED, dims, number]).normal(size=(dims, 16))
    return np.linalg.qr(wide)[0] if dims >= 16 else wide / np.sqrt(np.maximum((wide**2).sum(0), 1e-9))


def cells(unit: np.ndarray) -> np.ndarray:
    """The cells of unit vectors: rows by tables by (1 + PROBES), as integers that hold the table."""
    out = np.zeros((len(unit), TABLES, PROBES + 1), np.int64)
    odd = np.random.default_rng(SEED).integers(1, 1 << 62, (2, 8)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for t in range(TABLES):
        at = unit @ projection(unit.shape[1], t) / SCALE
        (a, far_a), (b, far_b) = (lattice.probes(at[:, k : k + 8], PROBES) for k in (0, 8))
        hash_a, hash_b = (((2 * p).astype(np.int64).astype(np.uint64) * o).sum(2) for p, o in zip((a, b), odd, strict=True))
        both = (hash_a[:, :, None] ^ hash_b[:, None, :] * np.uint64(0x9E3779B97F4A7C15)).reshape(len(unit), -1)
        both = (both ^ both >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        far = (far_a[:, :, None] + far_b[:, None, :]).reshape(len(unit), -1)
        nearest = np.argsort(far, axis=1, kind="stable")[:, : PROBES + 1]
        key = np.take_along_axis(both, nearest, 1) >> np.uint64(4) << np.uint64(3)
        out[:, t] = (key | np.uint64(t)).astype(np.int64)
    return out


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors, in double precision, of each length that occurs."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        x = flat[starts[at][:, None] + np.arange(n)]
        x = x / np.abs(x).max(1, keepdims=True)
        yield at, x / np.sqrt((x**2).sum(1, keepdims=True))


def _first_meeting(keys: np.ndarray, a: np.ndarray, b: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) meet first in the cell `here`: in no table before its own, and
    in its table in no lesser cell."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 20_000):
        x, y, cell = keys[a[lo : lo + 20_000]], keys[b[lo : lo + 20_000]], here[lo : lo + 20_000]
        met = np.zeros(len(x), bool)
        first = np.zeros(len(x), bool)
        for t in range(TABLES):
            same = (x[:, t, :, None] == y[:, t, None, :]).any(2)
            least = np.where(same, x[:, t], np.iinfo(np.int64).max).min(1)
            first |= ~met & (least == cell)
            met |= same.any(1)
        out[lo : lo + 20_000] = first
    return out


def _compare(rows: pa.Table, cosine: float) -> pa.RecordBatch | None:
    """Links among the members of each cell (or pair of blocks) in rows, sorted by it."""
    key, low, high, own, rep, weight = (rows[c].to_numpy() for c in ("key", "low", "high", "own", "rep", "w"))
    column = rows["embedding"].combine_chunks()
    vectors = {int(i): v for at, x in _vectors(column) for i, v in zip(at, x, strict=True)}
    length = np.diff(column.offsets.to_numpy())
    change = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (length[1:] != length[:-1])
    bounds = np.append(np.flatnonzero(np.r_[True, change]), len(key))
    sizes = np.diff(bounds)
    group = np.repeat(np.arange(len(sizes)), sizes)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for n in np.unique(length):
        here = np.flatnonzero(length == n)
        x = np.stack([vectors[i] for i in here.tolist()])
        place = np.full(len(key), -1)
        place[here] = np.arange(len(here))
        at = here[(sizes[group[here]] > 1) & (sizes[group[here]] <= SMALL)]
        for step in range(1, SMALL):
            at = at[at + step < len(key)]
            at = at[group[at + step] == group[at]]
            if not len(at):
                break
            dots = np.einsum("ij,ij->i", x[place[at]], x[place[at + step]])
            hit = at[dots >= cosine]
            pairs.append((hit, hit + step))
        for g in np.unique(group[here]):
            if sizes[g] <= SMALL:
                continue
            lo, hi = bounds[g], bounds[g + 1]
            near = x[place[lo:hi]] @ x[place[lo:hi]].T >= cosine
            a, b = np.nonzero(np.triu(near, 1))
            pairs.append((a + lo, b + lo))
    a = np.concatenate([p for p, _ in pairs]) if pairs else np.zeros(0, np.int64)
    b = np.concatenate([p for _, p in pairs]) if pairs else np.zeros(0, np.int64)
    split = low[a] != high[a]  # between two blocks: pairs inside either are compared elsewhere
    keep = ~split | (own[a] != own[b])
    a, b = a[keep], b[keep]
    if not len(a):
        return None
    members, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys = np.zeros((len(members), TABLES, PROBES + 1), np.int64)
    for n in np.unique(length[members]):
        at = np.flatnonzero(length[members] == n)
        keys[at] = cells(np.stack([vectors[i] for i in members[at].tolist()]))
    i, j = where[: len(a)], where[len(a) :]
    first = _first_meeting(keys, i, j, key[a])
    i, j, a, b = i[first], j[first], a[first], b[first]
    links = np.bincount(i, weight[b], len(members)) + np.bincount(j, weight[a], len(members))
    root = rep[members].copy()
    while True:  # the least member that each is connected with here
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        if (root == before).all():
            break
    out = links > 0
    return pa.RecordBatch.from_arrays([pa.array(rep[members][out]), pa.array(links[out].astype(np.int64)), pa.array(root[out])], ["rep", "links", "root"])


def near_duplicates(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """df: vec_id, embedding.  Returns vec_id, n_links, component_id."""
    short_batches(df.sparkSession)
    own = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("wide"), "embedding")
    finite = F.forall("wide", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("wide").isNotNull() & finite & F.exists("wide", lambda x: x != 0)
    rows = own.withColumn("embedding", F.when(good, F.col("embedding"))).select("vec_id", "embedding")
    single = rows.filter("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w"))
    classes = written(single.withColumn("rep", F.monotonically_increasing_id()))  # numbers that are fixed once they are written

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _vectors(batch.column(1)):
                keys = cells(x).reshape(len(at), -1)
                reps = np.repeat(batch.column(0).to_numpy()[at], keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(keys.ravel())], ["rep", "key"])

    keys = written(classes.select("rep", "embedding").mapInArrow(keyed, "rep bigint, key bigint").distinct())
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = keys.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("rep", "key", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    dealt = met.join(classes.drop("least"), "rep").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", F.size("embedding"), "rep")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < ROWS:
                continue
            rows = pa.Table.from_batches(held)
            key, low, high = (rows[c].to_numpy() for c in ("key", "low", "high"))
            last = (key == key[-1]) & (low == low[-1]) & (high == high[-1])
            cut = int(np.argmax(last))
            if cut and (found := _compare(rows.slice(0, cut), cosine)):
                yield found
            held = rows.slice(cut).combine_chunks().to_batches()
        if held and (found := _compare(pa.Table.from_batches(held), cosine)):
            yield found

    columns = dealt.select("rep", "key", "own", "low", "high", "w", "embedding")
    found = written(columns.mapInArrow(compared, "rep bigint, links bigint, root bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rep"))
    heads = named.groupBy("part").agg(F.min("least").alias("component_id"))
    told = named.join(heads, "part").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id", F.lit(True).alias("linked"))
    joined = rows.join(told, "embedding", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


QUERIES = {"op7_vectors": op7_vectors}
#: Every pair, which is for small tables.
ORACLE_SQL = {
    "op7_vectors": f"""
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) ELSE 0 END >= {COSINE}
), reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.vec_id = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""
}
