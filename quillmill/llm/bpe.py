"""Byte-level BPE, encoding and decoding, with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a
vocabulary entry is its own encoding and is found with one probe and one comparison
of bytes.  Tier two takes the misses: the bytes of the pre-token form a linked list,
a heap holds the adjacent pairs by rank, and the best pair is merged until none is
left.  Python does the work because neither tier is a relational operation; each
distinct pre-token of a slice of texts is encoded once.

Texts: null counts as empty and has no ids.  Very long texts are encoded in parts that
end where a pre-token does, so only their ids are held whole.  Null ids and repeated rows
are coded like others, each by itself; an empty table gives an empty result; extra columns
pass through `encode` untouched.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import pretokens
from quillmill.llm.common import SLICE_CHARS, cuts, short_batches, slices, spans, table

#: Encodings of distinct pre-tokens that a worker keeps between batches.
CACHE_ENTRIES = 400_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PerfectHash:
    """A minimal perfect hash in levels of bit sets: a key that is alone in its place of
    a level owns that bit, the others go on to the next level, and the rank of a key's
    bit over all levels is its slot."""

    def __init__(self, keys: list[bytes], room: float = 2.0):
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        left, bits, self.sizes = hashes, [], []
        while len(left):
            size = max(64, int(room * len(left)))
            place = self._place(left, len(self.sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            bits.append(alone)
            self.sizes.append(size)
            left = left[~alone[place]]
        self.bits = np.concatenate(bits)
        self.rank = np.cumsum(self.bits) - 1
        self.base = np.cumsum([0, *self.sizes])
        self.slots = np.empty(len(keys), object)
        self.slots[self._slot(hashes)] = keys

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (hashes + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            place = self.base[level] + self._place(hashes[open_], level, size)
            hit = self.bits[place]
            out[open_[hit]] = self.rank[place[hit]]
            open_ = open_[~hit]
        return out

    def find(self, words: list[bytes]) -> np.ndarray:
        """The slot of each word, -1 where it is no key."""
        slot = self._slot(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        same = np.fromiter(map(bytes.__eq__, self.slots[slot], words), bool, len(words))
        return np.where(same & (slot >= 0), slot, -1)


def encode_texts(texts: list[str], encode_words) -> list[np.ndarray]:
    """Ids of each text; encode_words gives those of distinct pre-tokens as bytes.  A very
    long text is encoded in parts that end where a pre-token does."""
    out: list[np.ndarray] = []
    for lo, hi in slices(np.fromiter(map(len, texts), np.int64, len(texts))):
        if hi == lo + 1 and len(texts[lo]) > SLICE_CHARS:
            out.append(np.concatenate([_encoded([x], encode_words)[0] for x in cuts(texts[lo], SLICE_CHARS)]))
        else:
            out += _encoded(texts[lo:hi], encode_words)
    return out


def _encoded(texts: list[str], encode_words) -> list[np.ndarray]:
    tokens, counts = pretokens.split(texts)
    if not len(tokens):
        return [np.zeros(0, "<u4")] * len(texts)
    coded = tokens.dictionary_encode()
    found = encode_words(coded.dictionary.to_pylist())
    index = coded.indices.to_numpy()
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), "<u4")
    each = lengths[index]
    ids = flat[spans((np.cumsum(lengths) - lengths)[index], each)]
    ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum(counts)]
    return np.split(ids, ends[:-1])


class Coder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: The rank of each pair of ids whose bytes together are an entry.
        self.pairs = {ranks[w[:k]] << 16 | ranks[w[k:]]: r for w, r in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks}
        self.words = np.empty(max(ranks.values()) + 1, object)
        for word, rank in ranks.items():
            self.words[rank] = word
        lengths = np.fromiter((len(w or b"") for w in self.words), np.int64, len(self.words))
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(w or b"" for w in self.words), np.uint8)
        self.table = PerfectHash(list(ranks))
        self.slot_id = np.fromiter((ranks[w] for w in self.table.slots), np.int64, len(ranks))
        self.cache: dict[bytes, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Tier two: ids of a pre-token by merging linked bytes, best rank first, then leftmost."""
        get, push, pop = self.pairs.get, heapq.heappush, heapq.heappop
        ids = [self.single[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        rank = [get(a << 16 | b) for a, b in itertools.pairwise(ids)]
        heap = [r << 32 | i for i, r in enumerate(rank) if r is not None]
        rank.append(None)
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if rank[i] != r:
                continue  # the pair has changed since
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], rank[j] = r, None, None
            if k < n:
                before[k] = i
                new = rank[i] = get(r << 16 | ids[k])
                if new is not None:
                    push(heap, new << 32 | i)
            else:
                rank[i] = None
            h = before[i]
            if h >= 0:
                new = rank[h] = get(ids[h] << 16 | r)
                if new is not None:
                    push(heap, new << 32 | h)
        return [x for x in ids if x is not None]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each distinct pre-token, as little-endian unsigned 32-bit integers."""
        slot = self.table.find(words)
        whole = np.where(slot >= 0, self.slot_id[slot], 0).astype("<u4").tobytes()
        cache, out = self.cache, []
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for k, (word, s) in enumerate(zip(words, slot.tolist(), strict=True)):
            if s >= 0:
                out.append(whole[4 * k : 4 * k + 4])
                continue
            found = cache.get(word)
            if found is None:
                found = pack(f"<{len(ids := self.merge(word))}I", *ids)
                if len(word) < 64:
                    cache[word] = found
            out.append(found)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return encode_texts(texts, self.encode_words)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return self.bytes[spans(self.starts[ids], self.lengths[ids])].tobytes()


@functools.lru_cache(2)
def coder(path: str) -> Coder:
    """One for each Python worker, which Spark keeps between tasks."""
    return Coder(path)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds `ids array<int>` and `decoded binary`, what the ids stand for."""
    short_batches(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in ("ids", "decoded"))
    keep = [f.name for f in df.schema if f.name not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            coded = bpe.encode([x or "" for x in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([x.astype(np.int32) for x in coded], pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in coded], pa.binary())],
                [*keep, "ids", "decoded"],
            )

    return df.mapInArrow(run, f"{schema}, ids array<int>, decoded binary")


def digests(df: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids and digests of the ids and of what they decode to;
    the ids stay in the task, which spares their way through Arrow."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            coded = bpe.encode([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in coded], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in coded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"))


QUERIES = {"op6_bpe": op6_bpe}
ORACLE_SQL: dict[str, str] = {}
