import hashlib
import random
import zlib

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import bpe, packing
from quillmill.llm.bpe import vocabulary_path

RANKS = vocabulary_path("byte_bpe_50k.tiktoken")


def library():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.coder(RANKS).ranks, special_tokens={})


PIECES = st.sampled_from(["a", "b", "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "é", "中", "1", "٣", "½", "_", "-!", "\U0001f600", "\x1c", "　", "\u0085", "don't", "hello", "World"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=15).map("".join), max_size=5))
def test_encode_is_the_library(texts):
    coder = bpe.coder(RANKS)
    found = coder.encode(texts)
    assert [x.tolist() for x in found] == [library().encode_ordinary(t) for t in texts]
    assert [coder.decode(x) for x in found] == [t.encode() for t in texts]


def test_perfect_hash():
    table = bpe.coder(RANKS).table
    words = list(bpe.coder(RANKS).ranks)
    found = table.find(words)
    assert sorted(found.tolist()) == list(range(len(words)))
    assert (table.find([w + b"\x00\xff zz" for w in words[:500]]) == -1).all()


def test_op6(spark, tables, odd_documents):
    found = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.op6_bpe(spark, tables(documents=odd_documents)).collect()}
    rows = odd_documents.collect()
    assert len(found) == len({(r["doc_id"], r["text"]) for r in rows})
    for r in rows:
        text = r["text"] or ""
        ids = np.array(library().encode_ordinary(text), "<u4")
        got = found[r["doc_id"], hashlib.sha256(ids.tobytes()).hexdigest()]
        assert (got["n_tokens"], got["decoded_sha256"]) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
    both = bpe.encode(odd_documents.withColumn("ids", F.lit(1)), RANKS).filter("doc_id = 105").first()
    assert both["ids"] == library().encode_ordinary("word") and bytes(both["decoded"]) == b"word"
    assert bpe.encode(odd_documents.limit(0), RANKS).count() == 0


def laid_out(counts, capacity):
    """Every piece's place, checked."""
    places, seen = {}, {}
    for n, a, b, first, each, offset in packing.plan(counts, capacity):
        for r in range(a, b):
            assert r not in seen.setdefault(n, set())
            seen[n].add(r)
            places.setdefault(first + (r - a) // each, []).append((offset + (r - a) % each * n, n))
    assert {n: len(s) for n, s in seen.items()} == {n: c for n, c in counts.items() if c}
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(places)


def best_fit(counts, capacity):
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    return len(gaps)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([10, 16, 31]), st.dictionaries(st.integers(1, 10), st.integers(0, 9), max_size=8))
def test_plan_is_whole_and_tight(capacity, counts):
    many = laid_out(counts, capacity)
    assert many <= best_fit(counts, capacity) * 1.2 + 1


def test_plan_large():
    r = random.Random(1)
    counts = {r.randint(1, 2048): r.randint(1, 40) for _ in range(1500)}
    least = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert laid_out(counts, 2048) <= least * 1.03


def tokens(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    return t.encode(text, add_special_tokens=False).ids


def test_ids_are_the_library_s_with_added_tokens():
    texts = ["<|endoftext|> x", "x <|endoftext|>", "a <|endoftext|><|endoftext|> \n b", "<|endoftext|>", "<|endoftext |>", " don't <|endoftext|>'ll", ""]
    coder = packing._ids(vocabulary_path("byte_bpe_50k.json"))
    assert [x.tolist() for x in coder.texts(texts)] == [tokens(x) for x in texts]
    assert tokens(texts[0]) == [50256, 2124]


def test_very_long_texts_are_encoded_in_parts(monkeypatch):
    r = random.Random(3)
    pieces = ["word", " it's", "\n", "  ", "\t", "12", "-!", "é", " 中", "　", " '", "\x1c", "\u0085", "<|endoftext|>", " ' s"]
    long = "".join(r.choice(pieces) for _ in range(30_000))
    ids = packing._ids(vocabulary_path("byte_bpe_50k.json"))
    whole, own = ids.texts([long])[0].tolist(), bpe.coder(RANKS).encode([long])[0].tolist()
    assert whole == tokens(long) and own == library().encode_ordinary(long)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 500)
    monkeypatch.setattr(bpe, "slices", lambda lengths: ((k, k + 1) for k in range(len(lengths))))
    assert ids.texts([long])[0].tolist() == whole and bpe.coder(RANKS).encode([long])[0].tolist() == own


def test_op10(spark, tables, odd_documents):
    found = packing.op10_packing(spark, tables(documents=odd_documents)).collect()
    wanted = []
    for r in odd_documents.collect():
        ids = np.array([*tokens(r["text"] or ""), 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        wanted += [(r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(wanted)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(odd_documents.limit(0), vocabulary_path("byte_bpe_50k.json")).count() == 0
