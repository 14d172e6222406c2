"""Best-fit packing of documents into sequences by large-item matching.

A document's pieces are numbered and sized on the executors.  What decides the packing
is only how many pieces there are of each length, at most 2048 numbers whatever the
size of the corpus, so the plan is made on that histogram:

* pieces above a third of the capacity come at most two to a sequence; the longest is
  matched with the longest other that fits beside it;
* shorter pieces, longest first, go into the smallest gap that takes them, and open
  new sequences when none does.

The plan works on runs of equal pieces and equal sequences, so it is a short table of
(length, ranks, first sequence, place).  A piece finds its row by its length and its
rank among pieces of that length; ranks are counted within hash buckets and shifted by
the counts before, so no length, however common, meets in one task.

The tokens that the vocabulary file adds to its entries are found first, wherever their
strings stand in a text, and the text between them is encoded by itself, as the
`tokenizers` library does.

Null texts count as empty: one piece holding only the end token.  Rows with equal or null
ids or with equal texts are packed separately, and equal pieces are told apart by nothing
but their place.  Very long texts are encoded in parts.  Extra columns are ignored.  An
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.bpe import vocabulary_path
from quillmill.llm.common import ranked, short_batches, table, written

CAPACITY = 2048
END_ID = 0
NEW_LINE = b"\n"
#: Encodings of distinct pre-tokens that a worker keeps between batches.
CACHE_ENTRIES = 400_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, pieces a sequence, offset):
    the piece of that length with rank r in [first, end) goes into sequence
    first sequence + (r - first) // pieces, at offset + (r - first) % pieces * length."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, how many)
    order: list[int] = []  # gaps that have runs, ascending

    def opened(gap: int, first: int, many: int) -> None:
        if gap <= 0 or many <= 0:
            return
        if not gaps.get(gap):
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append((first, many))

    def put(length: int, many: int, first: int, each: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + many, first, each, offset))
        used[length] += many
        left[length] -= many

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        if k < 0:
            many = left[a]
            put(a, many, sequences, 1, 0)
            opened(capacity - a, sequences, many)
        else:
            b = large[k]
            many = left[a] // 2 if a == b else min(left[a], left[b])
            if not many:  # the last of its length, and only its own length fits beside it: try the next shorter
                shorter = large[k - 1] if k else None
                if shorter is None:
                    put(a, 1, sequences, 1, 0)
                    opened(capacity - a, sequences, 1)
                    sequences += 1
                    large.pop()
                    continue
                b, many = shorter, 1
            if a == b:
                put(a, 2 * many, sequences, 2, 0)
            else:
                put(a, many, sequences, 1, 0)
                put(b, many, sequences, 1, a)
            opened(capacity - a - b, sequences, many)
        sequences += many
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            k = bisect.bisect_left(order, n)
            if k == len(order):
                each = capacity // n
                full, rest = divmod(left[n], each)
                if full:
                    put(n, full * each, sequences, each, 0)
                    opened(capacity - each * n, sequences, full)
                    sequences += full
                if rest:
                    put(n, rest, sequences, rest, 0)
                    opened(capacity - rest * n, sequences, 1)
                    sequences += 1
                continue
            gap = order[k]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(k)
            each = gap // n
            full = min(many, left[n] // each)
            if full:
                put(n, full * each, first, each, capacity - gap)
                opened(gap - each * n, first, full)
            if full < many:
                rest = min(left[n], each)
                if rest:
                    put(n, rest, first + full, rest, capacity - gap)
                    opened(gap - rest * n, first + full, 1)
                    full += 1
                opened(gap, first + full, many - full)
    return rows


class _Ids:
    """The ids that the `tokenizers` library gives.  The vocabulary is that of the rank
    file beside the given one, which the tests hold against the library; ids are found
    for each distinct pre-token, many in one call."""

    def __init__(self, path: str):
        import json

        import tiktoken

        from quillmill.llm.pretokens import classes

        classes()
        with open(path) as f:
            file = json.load(f)
        model = file["model"]
        self.vocabulary = model["vocab"]
        #: Strings that are one id wherever they stand.
        self.added = {x["content"]: x["id"] for x in file.get("added_tokens") or ()}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in file.get("added_tokens") or ()):
            raise ValueError("added tokens that depend on what stands beside them")
        self.split = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        letters = _byte_letters()
        ranks = {}
        for word, i in self.vocabulary.items():
            if all(c in letters for c in word):
                ranks[bytes(letters[c] for c in word)] = i
        merged = {a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        ranks = {w: i for w, i in ranks.items() if len(w) == 1 or "".join(_letter_of()[b] for b in w) in merged}
        import public_tokenizers

        self.encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
        self.new_line = ranks[NEW_LINE]
        self.cache: dict[bytes, bytes] = {}

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        from quillmill.llm.bpe import encode_texts

        found = encode_texts([x if not self.split.search(x) else "" for x in texts], self.words)
        for k, text in enumerate(texts):
            if self.split.search(text):
                parts, at = [], 0
                for m in self.split.finditer(text):
                    parts += [text[at : m.start()], m[0]]
                    at = m.end()
                parts.append(text[at:])
                between = encode_texts(parts[::2], self.words)
                added = [np.array([self.added[x]], "<u4") for x in parts[1::2]]
                found[k] = np.concatenate([x for both in itertools.zip_longest(between, added, fillvalue=np.zeros(0, "<u4")) for x in both])
        return found

    def words(self, words: list[bytes]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        missing = [w for w in words if w not in cache]
        lines = [w for w in missing if NEW_LINE not in w and not w.decode().isspace()]
        if lines:  # one call: a new line before a pre-token doesn't change how it is split
            ids = self.encoding.encode_to_numpy(NEW_LINE.join(lines).decode(), disallowed_special=()).astype("<u4")
            cut = np.flatnonzero(ids == self.new_line)
            raw = ids.tobytes()
            ends = [*(4 * cut).tolist(), len(raw)]
            starts = [0, *(4 * cut + 4).tolist()]
            cache.update(zip(lines, map(raw.__getitem__, map(slice, starts, ends)), strict=True))
        for w in missing:
            if w not in cache:
                cache[w] = np.array(self.encoding.encode_ordinary(w.decode()), "<u4").tobytes()
        return list(map(cache.__getitem__, words))


@functools.cache
def _letter_of() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: bytes
    that print stand for themselves, the others follow from U+0100 in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _byte_letters() -> dict[str, int]:
    return {c: b for b, c in enumerate(_letter_of())}


@functools.lru_cache(2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        for batch in batches:
            out: list[tuple] = []
            coded = ids.texts([x or "" for x in batch.column(1).to_pylist()])
            for doc, own in zip(batch.column(0).to_pylist(), coded, strict=True):
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                first = len(own) % capacity or min(len(own), capacity)
                for k, end in enumerate(range(first, len(own) + 1, capacity)):
                    start = max(0, end - capacity) if k else 0
                    out.append((doc, k, start, end - start, zlib.crc32(own[start:end].tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length`; found must be cheap to read
    again (a written table)."""
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length at most
    rows = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = found.sparkSession.sparkContext.broadcast(rows)
    total = int(sum(counts.values()))
    with_rank = ranked(found, ["length"], ["doc_id", "piece", "start"], total, "_rank", min(len(counts), 64))
    keep = [f.name for f in found.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            own = rows[np.searchsorted(key, length << 44 | rank, "right") - 1]
            nth = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(own[:, 3] + nth // own[:, 4]), pa.array(own[:, 5] + nth % own[:, 4] * length)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return with_rank.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return place(written(pieces(df, path, capacity, end_id)), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


QUERIES = {"op10_packing": op10_packing}
ORACLE_SQL: dict[str, str] = {}
