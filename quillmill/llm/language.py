"""Language identification as inference of a mixture.

A document is taken as words drawn from several languages.  Each language is a model of
hashed character n-grams (one to four letters, word ends marked) with smoothed counts,
which gives every word a likelihood under every language.  Expectation-maximisation
then estimates the document's proportions, with a Dirichlet prior.  The language set
is chosen by penalised likelihood: languages are added in the order of their share for
as long as the maximised likelihood gains more than the penalty for one more
proportion.  The prediction is the largest share within the chosen set.

Counting the n-grams and the inference run in Python over Arrow batches, on arrays of
code points: n-gram hashes, gathers and segmented sums have no DataFrame form.  Each
distinct word of a slice of texts is scored once, and a document is the counts of its
distinct words; a very long text is read in parts, so memory follows its distinct words.
The model is a fixed number of buckets by languages.  It learns from a bounded sample,
about `SAMPLE` documents of each language chosen by a hash of doc_id; predictions cover
every whole text.

Null texts and texts without a letter are `und` with score 0.  Rows without a language
are not learned from.  If nothing can be learned, every text is `und`.  Repeated rows
are each predicted, alike.  Extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import cuts, short_batches, slices, spans, table

UNKNOWN = "und"
#: Characters that one vectorised step works on at once.
SLICE = 1_000_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Marks between words, so that no n-gram reaches into the word before.
GAP = max(ORDERS) - 2
#: Documents of each language that the model learns from, about.
SAMPLE = 1500
SMOOTHING = 0.5
#: What one n-gram order counts in a word's likelihood: longer ones include shorter ones.
WEIGHT = 1 / len(ORDERS)
#: The widest a word's likelihoods may differ, in nats: one odd word decides nothing.
CLIP = 8.0
#: Rounds of EM; shares of a few languages settle early.
ROUNDS = 8
PRIOR = 0.2
#: A further language must gain so many times the log of the number of words.
PENALTY = 1.5


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


@dataclasses.dataclass
class Words:
    """The words of some texts as runs of letters: each run in `points` has a 0 before and after."""

    points: np.ndarray
    starts: np.ndarray  # of each word in points
    ends: np.ndarray
    doc: np.ndarray  # of each word


def words_of(texts: list[str]) -> Words:
    lower = [x.lower() for x in texts]
    lengths = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    points = np.frombuffer(("\0" + "\0".join(lower) + "\0\0").encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    return Words(np.where(letter, points, 0), starts, ends, np.searchsorted(np.cumsum(lengths), starts, "right"))


def hashes(words: Words, length: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word, or of its first letters; stems hash unlike words."""
    n = len(words.points)
    power, inverse = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    power[0] = inverse[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.points * np.cumprod(power), dtype=np.uint64)])
    ends = words.ends if length is None else np.minimum(words.starts + length, words.ends)
    out = (sums[ends] - sums[words.starts]) * np.cumprod(inverse)[words.starts]
    out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length or 0)
    return out ^ out >> np.uint64(32)


def distinct(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some texts, GAP marks apart, and of each text: its number, its
    distinct words' places among them, and how often it has them; by text, then by word."""
    known, runs, sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    docs, words_, counts = [], [], []
    for lo, hi in slices(np.fromiter(map(len, texts), np.int64, len(texts)), SLICE):
        for part in [texts[lo:hi]] if hi > lo + 1 else ([x] for x in cuts(texts[lo], SLICE)):
            words = words_of(part)
            own, first, place = np.unique(hashes(words), return_index=True, return_inverse=True)
            new = ~np.isin(own, known)
            a, b = words.starts[first[new]], words.ends[first[new]]
            runs = np.concatenate([runs, words.points[spans(a, b - a)]])
            sizes = np.concatenate([sizes, b - a])
            known = np.concatenate([known, own[new]])
            order = np.argsort(known)
            index = order[np.searchsorted(known, own, sorter=order)]
            pair, n = np.unique(words.doc.astype(np.int64) << 32 | index[place], return_counts=True)
            docs.append((pair >> 32) + lo)
            words_.append(pair & 0xFFFFFFFF)
            counts.append(n)
    doc, word, count_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, words_, counts))
    if len(docs) > 1:  # the parts of a long text meet
        pair, where = np.unique(doc << 32 | word, return_inverse=True)
        doc, word, count_ = pair >> 32, pair & 0xFFFFFFFF, np.bincount(where, count_, len(pair)).astype(np.int64)
    points = np.zeros(len(runs) + GAP * (len(sizes) + 1), np.uint32)
    starts = np.cumsum(sizes + GAP) - sizes
    points[spans(starts, sizes)] = runs
    return Words(points, starts, starts + sizes, np.zeros(len(sizes), np.int64)), doc, word, count_


def _grams(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that ends at each place."""
    h = np.full(len(points), order, np.uint32)
    for k in range(order):
        h[order - 1 :] = (h[order - 1 :] ^ points[k : len(points) - order + 1 + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h % np.uint32(BUCKETS)).astype(np.int64)


def _first(words: Words, order: int) -> np.ndarray:
    """Where each word's first n-gram ends: it starts on the mark before the word; its last ends on the mark after."""
    return np.minimum(words.starts + max(0, order - 2), words.ends)


def count(texts: list[str]) -> np.ndarray:
    """Counts of n-grams in all buckets, all orders together."""
    out = np.zeros(BUCKETS, np.int64)
    words, _, word, n = distinct(texts)
    if not len(word):
        return out
    often = np.bincount(word, n, len(words.starts))
    for order in ORDERS:
        grams = _grams(words.points, order)
        first = _first(words, order)
        many = words.ends + 1 - first
        out += np.bincount(grams[spans(first, many)], np.repeat(often, many), BUCKETS).astype(np.int64)
    return out


@dataclasses.dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # buckets by languages
    prior: np.ndarray


def fit(df: DataFrame, label: Column, sample: int = SAMPLE) -> Model:
    """df: doc_id, text; label: the language, null for rows not to learn from."""
    spark = df.sparkSession
    short_batches(spark)
    known = df.select("doc_id", "text", label.alias("label")).filter(F.col("label").isNotNull())
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    chosen = known.filter(draw < share[F.col("label")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(labels):
                own = [t for t, x in zip(texts, labels, strict=True) if x == name and t]
                for lo, hi in slices(np.fromiter(map(len, own), np.int64, len(own))):
                    total[name] = total.get(name, 0) + count(own[lo:hi])
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["label", "bucket", "n"])

    counted = chosen.select("text", "label").mapInArrow(run, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # buckets by languages at most
    names = sorted(sizes)
    counts = np.zeros((BUCKETS, len(names)))
    column = {n: k for k, n in enumerate(names)}
    counts[rows["bucket"].to_numpy(), [column[x] for x in rows["label"].to_pylist()]] = rows["n"].to_numpy()
    logs = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS))
    prior = np.array([sizes[n] for n in names], float)
    return Model(names, logs.astype(np.float32), prior / prior.sum())


def likelihoods(words: Words, model: Model) -> np.ndarray:
    """Log-likelihood of each word under each language, up to a constant for the word."""
    out = np.zeros((len(words.starts), len(model.languages)), np.float32)
    ends = words.ends + 1
    for lo, hi in slices(ends - words.starts, SLICE):
        begin = words.starts[lo] - GAP
        points = words.points[begin : ends[hi - 1]]
        bounds = np.stack([words.starts[lo:hi] - begin, ends[lo:hi] - begin], 1).ravel()
        for order in ORDERS:
            bounds[::2] = _first(words, order)[lo:hi] - begin
            at = model.logs[np.append(_grams(points, order), 0)]
            out[lo:hi] += np.add.reduceat(at, bounds, axis=0)[::2]
    out *= WEIGHT
    return np.maximum(out - out.max(1, keepdims=True), -CLIP)


def _mixture(like: np.ndarray, times: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, start: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: shares and maximised log-likelihoods.  like: of each
    document's distinct words, which it has so many times; allowed: documents by
    languages that may have a share."""
    share = np.where(allowed, start, 0)
    share /= share.sum(1, keepdims=True)
    extra = PRIOR * share
    for _ in range(ROUNDS if allowed.sum(1).max(initial=1) > 1 else 0):
        joint = like * share[doc]
        joint *= (times / joint.sum(1))[:, None]
        share = (np.add.reduceat(joint, first, axis=0) + extra) / (n + PRIOR)[:, None]
    fit_ = np.add.reduceat(times * np.log((like * share[doc]).sum(1) + 1e-20), first)
    return share, fit_


def predict(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Index of the predicted language of each text, -1 for none, and its share."""
    label, score = np.full(len(texts), -1), np.zeros(len(texts))
    if not model.languages:
        return label, score
    for lo, hi in slices(np.fromiter(map(len, texts), np.int64, len(texts)), SLICE):
        words, doc, word, times = distinct(texts[lo:hi])
        if not len(doc):
            continue
        which, first, kinds = np.unique(doc, return_index=True, return_counts=True)
        doc = np.repeat(np.arange(len(which)), kinds)
        n = np.add.reduceat(times, first)
        like = np.exp(likelihoods(words, model))[word]
        start = np.broadcast_to(model.prior, (len(which), len(model.languages)))
        everything, _ = _mixture(like, times, doc, first, n, start, np.ones_like(start, bool))
        order = np.argsort(-everything, axis=1, kind="stable")
        allowed = np.zeros(start.shape, bool)
        allowed[np.arange(len(which)), order[:, 0]] = True
        best_share, best = _mixture(like, times, doc, first, n, everything, allowed)
        rows, own = np.arange(len(which)), np.arange(len(doc))  # documents whose set still grows, and their words
        for size in range(1, order.shape[1]):
            if not len(rows):
                break
            allowed[rows, order[rows, size]] = True
            many = kinds[rows]
            share, fit_ = _mixture(like[own], times[own], np.repeat(np.arange(len(rows)), many), np.cumsum(many) - many, n[rows], np.maximum(everything[rows], 1e-6), allowed[rows])
            value = fit_ - PENALTY * size * np.log(n[rows] + 1)
            grown = value > best[rows]
            rows, own = rows[grown], own[np.repeat(grown, many)]
            best[rows], best_share[rows] = value[grown], share[grown]
        # a short text says little: its share leans to the corpus's own
        leaned = (best_share * n[:, None] + PRIOR * everything) / (n[:, None] + PRIOR)
        label[lo + which] = leaned.argmax(1)
        score[lo + which] = leaned.max(1)
    return label, np.clip(score, 0, 1)


def identify(df: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to df, which has a column text."""
    spark = df.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets by languages
    keep = [f.name for f in df.schema if f.name not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            label, score = predict([x or "" for x in batch.column("text").to_pylist()], model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names[label], pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep).mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, F.when(~held_out(), F.col("lang")))
    found = identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language": op1_language}
ORACLE_SQL: dict[str, str] = {}
