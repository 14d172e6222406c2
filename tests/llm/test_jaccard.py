import random

import numpy as np

import corpus_pipeline
from quillmill.llm import jaccard

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_sets(text, words=5):
    parts = (text or "").lower().split()
    return {" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()


def brute_components(rows, least=0.8):
    sets = {i: brute_sets(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, _) in enumerate(rows):
        for b, _ in rows[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared >= least * (len(sets[a]) + len(sets[b]) - shared):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


def edited(r, text, edits):
    words = text.split(" ")
    for at in r.sample(range(len(words) // 6), edits):
        words[6 * at] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_every_pair_of_the_wanted_similarity_is_found_and_no_other(spark):
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    # 250 words, 4 to 8 single edits: similarities from about 0.72 to 0.86
    base = [text(250) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, edited(r, t, 4 + k % 5)) for k, t in enumerate(base)]
    crowd = text(200)  # a large meeting
    rows += [(1000 + k, edited(r, crowd, 1 + k % 6)) for k in range(120)]
    rows += [(2000, None), (2001, ""), (2002, "one"), (2003, "One"), (2004, "two")]
    wanted = brute_components(rows)
    assert 15 < sum(wanted[100 + k] == k for k in range(60)) < 45
    df = spark.createDataFrame(rows, "row bigint, text string").repartition(3)
    found = {x["row"]: x["component"] for x in jaccard.near_duplicates(df, 5, 0.8).collect()}
    assert found == wanted
    kept = corpus_pipeline.by_near_duplicate(spark, spark.createDataFrame([(i, t, None, None, None) for i, t in rows], COLUMNS), "")
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(wanted.values()))
    assert jaccard.near_duplicates(df.limit(0), 5, 0.8).count() == 0


def test_crowded_meetings_cost_about_their_size():
    r = np.random.default_rng(1)
    signs = np.repeat(r.integers(0, 256, (1, jaccard.BANDS * jaccard.ROWS), np.uint8), 200, 0)
    for row in signs:
        row[r.choice(row.size, r.integers(0, 8), replace=False)] = r.integers(0, 256)
    rep = r.permutation(200).astype(np.int64)
    assert sum(len(a) for a, _ in jaccard.pairs_of(rep, signs)) == 199
    sets = [np.unique(np.append(np.arange(40), r.integers(100, 104, 2))).astype(np.uint64) for _ in rep]
    a, b = jaccard.spanning(rep, jaccard.Sketches(signs), sets, rep % 2, False, 0.8)
    assert len(a) == len(b) == 199 and set(a) | set(b) == set(range(200))
    a, b = jaccard.spanning(rep, jaccard.Sketches(signs), sets, rep % 2, True, 0.8)
    assert len(a) == 199 and all((x - y) % 2 for x, y in zip(a, b, strict=True))


def test_clusters_are_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(8)
    base = " ".join(f"w{r.randrange(3000)}" for _ in range(200))
    # copies of a text that differ from it by up to 11 edits: some link, some do not
    rows = [(k, edited(r, base, 1 + k % 11)) for k in range(150)]
    wanted = brute_components(rows)
    assert 20 < len(set(wanted.values())) < 140
    df = spark.createDataFrame(rows, "row bigint, text string").repartition(3)
    assert {x["row"]: x["component"] for x in jaccard.near_duplicates(df, 5, 0.8).collect()} == wanted


def test_null_and_repeated_ids_stay(spark):
    r = random.Random(6)
    text = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(100))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (3, edited(r, d, 1)), (None, c), (9, e), (9, edited(r, e, 1)), (None, None)]
    found = corpus_pipeline.by_near_duplicate(spark, spark.createDataFrame([(i, t, None, None, None) for i, t in rows], COLUMNS), "")
    kept = [(x["doc_id"], x["text"]) for x in found.collect()]
    assert [t for _, t in kept].count(e) + [t for _, t in kept].count(rows[9][1]) == 1
    wanted = [(None, a), (None, b), (7, c), rows[6], (None, None)]
    assert sorted(map(repr, (x for x in kept if x[0] != 9))) == sorted(map(repr, wanted))
    packed = corpus_pipeline.into_sequences(spark, found, "")
    assert sorted(str(x["doc_id"]) for x in packed.collect()) == sorted(str(i) for i, _ in kept)


def test_links_without_a_common_minhash_band_are_found(spark):
    # similarity 4/5, 12 and 9 bits apart, and no MinHash band of four minima in common
    one, two = "w2892 w463 w666 w1862 w2729 w1064 w891 w171", "w2394 w1599 w329 w1052 w590 w328 w1025 w1865"
    rows = [(1, one), (2, two), (3, "some other text"), (11, one + " w2669"), (12, two + " w1816")]
    df = spark.createDataFrame(rows, "row bigint, text string").repartition(2)
    found = {x["row"]: x["component"] for x in jaccard.near_duplicates(df, 5, 0.8, corpus_pipeline.RADIUS).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 11: 1, 12: 2}


def test_all_fingerprints_within_the_radius_meet_by_their_pivots(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 300, np.uint64)
    fp = np.concatenate([base, base])
    for k in range(300):  # 9 to 20 bits turned over
        for bit in r.choice(64, 9 + k % 12, replace=False):
            fp[300 + k] ^= np.uint64(1) << np.uint64(bit)
    size = np.concatenate([s := r.integers(4, 90, 300), s * r.integers(70, 130, 300) // 100])
    rep = r.permutation(600)
    rows = [(int(i), int(f), int(n), bytes(jaccard.BANDS * jaccard.ROWS), 1) for i, f, n in zip(rep, fp.view(np.int64), size, strict=True)]
    classes = spark.createDataFrame(rows, "rep bigint, fp bigint, size bigint, bytes binary, chars bigint").repartition(3)
    near = lambda x, y: (np.bitwise_count(fp[x] ^ fp[y]) <= 14) & (5 * np.minimum(size[x], size[y]) >= 4 * np.maximum(size[x], size[y]))
    wanted = {tuple(sorted((int(rep[x]), int(rep[y])))) for x in range(600) for y in x + 1 + np.flatnonzero(near(x, np.arange(x + 1, 600)))}
    assert 50 < len(wanted) < 250
    for most in (65536, 8):  # whole meetings, and meetings in blocks
        monkeypatch.setattr(jaccard, "SPLIT", most)
        meetings, _ = jaccard._meetings(classes, 14, 0.8)
        assert meetings.select("key").distinct().count() > 100
        assert {tuple(x) for x in jaccard._walks(meetings, 14, 0.8).collect()} == wanted
