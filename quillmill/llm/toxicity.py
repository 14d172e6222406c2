"""Toxic passages by maximum-scoring segment search.

Every token has a score: its log-odds between toxic and other training documents under
a Dirichlet prior drawn from both, moved towards zero by a multiple of its error.  It
counts the documents that hold a token, copies once, as words of a text come together.  A word the
training sample has hardly seen takes the score of its first letters (stems carry
insults in inflected languages).  Less a small drift, the scores of a text make a walk
that falls in ordinary prose; all maximal scoring segments of it are found in linear
time, which are the toxic passages.  Extreme-value statistics give each segment its
expected number of occurrences by chance in a text of that length; a document's
evidence is the sum over significant segments, and a logistic curve fitted on the
training sample turns it into a probability.

The search needs a sequential scan, so it runs in Python over Arrow batches; only
tokens with a positive score are visited one by one.  The model learns from a bounded
sample of labelled rows, about `SAMPLE` of either class; every whole text is scored.

Null and empty texts have no segment and get the lowest score.  Without labelled rows
of both classes every score is 0.  Labels without an id, and rows without one, are not
learned from; of rows that share an id each is.  Repeated rows are scored alike, and the
model is the same however the rows are dealt out.  Very long texts are scored in parts and
searched as a whole.  Extra columns pass through `score` untouched.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import cuts, discard, short_batches, slices, table, written
from quillmill.llm.language import SLICE, Words, hashes, words_of

#: Labelled documents of each class that the model learns from, about.
SAMPLE = 4000
#: A document of these counts at least, or its words' stems speak for it.
LEAST_COUNT = 5
STEMS = (5, 4)
#: Standard errors that a score is moved towards zero: on the training rows of 0.1 GB, 2.5 gave
#: 31 false alarms in 13,880 and 3.5 gave 10, with all 1,619 toxic texts found by either.
MARGIN = 3.5
DRIFT = 0.05
#: Segments expected more often than this by chance are left out.
CHANCE = 0.05
THRESHOLD = 0.3


def _tokens(words: Words) -> list[np.ndarray]:
    """Hashes of the words and of their stems; 0 where a word is no longer than the stem."""
    size = words.ends - words.starts
    return [hashes(words), *(np.where(size > k, hashes(words, k), np.uint64(0)) for k in STEMS)]


@dataclasses.dataclass
class Model:
    hashes: np.ndarray  # sorted
    scores: np.ndarray
    rate: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # K of the extreme-value law
    weights: np.ndarray | None = None

    def token_scores(self, words: Words) -> np.ndarray:
        out = np.zeros(len(words.starts))
        if not len(self.hashes):
            return out
        left = np.arange(len(out))
        for h in _tokens(words):
            at = np.minimum(np.searchsorted(self.hashes, h[left]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[left]
            out[left[hit]] = self.scores[at[hit]]
            left = left[~hit]
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time: candidates are
    kept with the sums left and right of them, and joined while a later one rises above.
    Each knows the last one before it whose left sum is lower, so no candidate is passed
    over twice in a walk that falls."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high, j))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def scan(texts: list[str], model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """Number of words and the segments of each text.  A very long text is scored in parts
    and searched as a whole."""
    for lo, hi in slices(np.fromiter(map(len, texts), np.int64, len(texts)), SLICE):
        if hi == lo + 1:
            own = np.concatenate([model.token_scores(words_of([x])) for x in cuts(texts[lo], SLICE)]) - DRIFT
            yield len(own), segments(own)
            continue
        words = words_of(texts[lo:hi])
        scores = model.token_scores(words) - DRIFT
        bounds = np.searchsorted(words.doc, np.arange(hi - lo + 1))
        hits = np.searchsorted(np.flatnonzero(scores > 0), bounds)
        for k in range(hi - lo):
            own = scores[bounds[k] : bounds[k + 1]]
            yield len(own), segments(own) if hits[k + 1] > hits[k] else []


def evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> tuple[float, float]:
    """Of a text of n words: the normalised score of the best segment, and the sum of
    those of all significant ones."""
    chance = np.log(model.scale * max(1, n))
    own = [model.rate * s - chance for _, _, s in found]
    return max(own, default=-10.0), sum(max(0.0, x) for x in own if x > -np.log(CHANCE))


def _features(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(best)), np.clip(best, -10, 30) / 10, np.log1p(total)], 1)


def probability(best: np.ndarray, total: np.ndarray, model: Model) -> np.ndarray:
    if model.weights is None:
        return np.zeros(len(best))
    return 1 / (1 + np.exp(-np.clip(_features(best, total) @ model.weights, -30, 30)))


def _rate(scores: np.ndarray, counts: np.ndarray, rest: float) -> float:
    """The positive root of sum p exp(rate * (score - DRIFT)) = 1 over ordinary tokens."""
    p = np.append(counts, max(rest, 1.0))
    p, s = p / p.sum(), np.append(scores, 0.0) - DRIFT
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if float(p @ np.exp(np.minimum(mid * s, 300))) > 1 else (mid, high)
    return max(low, 1e-2)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)]) * weight.sum() / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _documents_with(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of words and of stems of each length: the level, tokens, and in how many of the texts they are."""
    for lo, hi in slices(np.fromiter(map(len, texts), np.int64, len(texts)), SLICE):
        parts = [texts[lo:hi]] if hi > lo + 1 else ([x] for x in cuts(texts[lo], SLICE))
        found: list[list[np.ndarray]] = [[] for _ in (0, *STEMS)]
        for part in parts:
            words = words_of(part)
            for level, h in enumerate(_tokens(words)):
                found[level].append(np.unique(np.stack([h, words.doc.astype(np.uint64)], 1)[h != 0], axis=0))
        for level, pairs in enumerate(found):
            yield level, *np.unique(np.unique(np.concatenate(pairs), axis=0)[:, 0], return_counts=True)


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """df: doc_id, text; labels: doc_id, toxic, only rows to learn from."""
    spark = df.sparkSession
    short_batches(spark)
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    empty = Model(np.zeros(0, np.uint64), np.zeros(0))
    if len(sizes) < 2:
        return empty
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    chosen = labels.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) / float(1 << 20) < share)
    rows = written(df.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null").select("text", "toxic"))  # about twice `sample` rows
    whole = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))  # copies of a whole text, and of no part of it
    single = written(rows.groupBy(F.xxhash64(whole).alias("copy"), "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for c in (0, 1):
                own = [t for t, x in zip(texts, toxic, strict=True) if x == c]
                for level, h, n in _documents_with(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), level, np.int32)), pa.array(h.view(np.int64)), pa.array(n * (c == 1)), pa.array(n * (c == 0))], ["level", "hash", "y1", "y0"])

    all_counts = written(single.mapInArrow(counted, "level int, hash bigint, y1 bigint, y0 bigint").groupBy("level", "hash").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")))
    totals = {r["toxic"]: float(r["n"]) for r in single.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return empty
    known = all_counts.filter(F.col("y1") + F.col("y0") >= LEAST_COUNT).toArrow()  # words of the sample
    y1, y0 = known["y1"].to_numpy().astype(float), known["y0"].to_numpy().astype(float)
    n1, n0 = totals[1], totals[0]
    prior = min(n1, n0)
    a = prior * (y1 + y0) / (n1 + n0)
    odds = np.log((y1 + a) / (n1 + prior - y1 - a + 1)) - np.log((y0 + a) / (n0 + prior - y0 - a + 1))
    scores = np.sign(odds) * np.maximum(0, np.abs(odds) - MARGIN * np.sqrt(1 / (y1 + a) + 1 / (y0 + a)))
    hashes = known["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], scores[order])
    words = known["level"].to_numpy() == 0
    ordinary = single.filter("toxic = 0").agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    model.rate = _rate(scores[words], y0[words] + 0.01, float(ordinary) - y0[words].sum())

    shared = spark.sparkContext.broadcast(model)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(n, [s for _, _, s in found]) for n, found in scan([x or "" for x in batch.column(0).to_pylist()], shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.float64()))], ["toxic", "n", "found"])

    seen = rows.mapInArrow(walked, "toxic int, n bigint, found array<double>").collect()  # about twice `sample` rows
    toxic = np.array([r["toxic"] for r in seen])
    clean = [r for r in seen if r["toxic"] == 0]
    least = min((s for r in seen for s in r["found"]), default=1.0)
    model.scale = (sum(len(r["found"]) for r in clean) + 0.5) / max(1, sum(r["n"] for r in clean)) * float(np.exp(min(model.rate * least, 50)))
    pairs = np.array([evidence(r["n"], [(0, 0, s) for s in r["found"]], model) for r in seen]).reshape(-1, 2)
    weight = np.where(toxic == 1, sizes[1] / max(1, (toxic == 1).sum()), sizes[0] / max(1, (toxic == 0).sum()))
    model.weights = _logistic(_features(pairs[:, 0], pairs[:, 1]), toxic.astype(float), weight / weight.mean())
    discard(rows, single, all_counts)
    return model


def score(df: DataFrame, model: Model) -> DataFrame:
    """Adds to df, which has a column text: score, passages (start and end word, score,
    expected number by chance) with those that are significant."""
    spark = df.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # words of the sample
    keep = [f.name for f in df.schema if f.name not in ("score", "passages")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            pairs, passages = [], []
            for n, found in scan([x or "" for x in batch.column("text").to_pylist()], model):
                pairs.append(evidence(n, found, model))
                own = [{"start": a, "end": b, "score": s, "expected": float(model.scale * n * np.exp(-model.rate * s))} for a, b, s in found]
                passages.append([x for x in own if x["expected"] <= CHANCE])
            both = np.array(pairs).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(probability(both[:, 0], both[:, 1], model), pa.float64()), pa.array(passages, kind)], [*keep, "score", "passages"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep).mapInArrow(run, f"{schema}, score double, passages array<struct<start:int,end:int,score:double,expected:double>>")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels").filter(~held_out()))
    found = score(documents, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
