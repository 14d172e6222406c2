import collections
import math
import random
import time
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import language, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ung", "ter", "ver", "ein"], "cc": ["eau", "oui", "tion", "ment", "ç"]}


def words(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    r = random.Random(1)
    rows = [(k, words(r, lang, r.randint(8, 80)), lang, "s", 1) for k, lang in ((k, r.choice(list(SYLLABLES))) for k in range(300))]
    return spark.createDataFrame(rows, DOCS)


def test_language_is_right_on_held_out(spark, tables, documents):
    found = language.op1_language(spark, tables(documents=documents)).join(documents, "doc_id").collect()
    assert len(found) == 300 and all(0 <= x["score"] <= 1 for x in found)
    held = [x for x in found if x["held_out"]]
    assert {x["doc_id"] for x in held} == {k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([x["lang_pred"] == x["lang"] for x in held]) > 0.97


def test_a_mixture_names_its_larger_part(spark, documents):
    model = language.fit(documents, documents["lang"])
    r = random.Random(2)
    mixed = [words(r, "aa", 70) + " " + words(r, "bb", 30), words(r, "cc", 20) + "\n" + words(r, "bb", 60)]
    label, score = language.predict(mixed, model)
    assert [model.languages[k] for k in label] == ["aa", "bb"] and 0.6 < score[0] < 0.8 and 0.65 < score[1] < 0.85


def test_language_odd_rows(spark, tables, odd_documents):
    found = language.op1_language(spark, tables(documents=odd_documents)).collect()
    assert len(found) == odd_documents.count()
    by = {x["doc_id"]: x for x in found}
    assert all((by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0) for k in (100, 101, 102, 103)) and by[105]["lang_pred"] != "und"
    assert language.identify(odd_documents, language.Model([], np.zeros((language.BUCKETS, 0)), np.zeros(0))).filter("lang_pred <> 'und'").count() == 0
    empty = odd_documents.limit(0)
    assert language.identify(empty, language.fit(empty, empty["lang"])).count() == 0


def best_segments(scores):
    """Maximal segments by their definition: the best segment, then left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 1e-9 and (best is None or s > best[2] + 1e-9):
                best = (a, b, s)
    if not best:
        return []
    a, b, s = best
    return [*best_segments(scores[:a]), best, *((a2 + b, b2 + b, s2) for a2, b2, s2 in best_segments(scores[b:]))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-9, 9).filter(bool), max_size=12))
def test_segments_are_all_maximal_ones(scores):
    r = random.Random(5)
    scores = [x + r.random() / 100 for x in scores]  # no ties
    found = toxicity.segments(np.array(scores))
    assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in best_segments(scores)]


def test_segments_take_linear_time():
    falling = np.tile([0.5, -1.0], 400_000)
    began = time.perf_counter()
    assert len(toxicity.segments(falling)) == 400_000
    assert len(toxicity.segments(-falling[::-1])) == 1
    assert time.perf_counter() - began < 20  # quadratic time would be hours


def test_toxicity(spark, tables):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        text = words(r, r.choice(list(SYLLABLES)), r.randint(20, 120)).split()
        toxic = k % 6 == 0
        if toxic:
            at = r.randrange(len(text))
            text[at:at] = [r.choice(["krom", "zwat", "grulk"]) for _ in range(r.randint(1, 4))]
        rows.append((k, " ".join(text), "aa", "s", 1))
        labels.append((k, 1, int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "aa", "s", 0), (902, "krom ZWAT grulk", "aa", "s", 3)]
    d = tables(documents=spark.createDataFrame(rows, DOCS), labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    found = {x["doc_id"]: x for x in toxicity.op2_toxicity(spark, d).collect()}
    assert len(found) == 603
    held = [x for x in found.values() if x["held_out"] and x["doc_id"] < 600]
    assert {x["doc_id"] for x in held} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([x["predicted"] == (x["doc_id"] % 6 == 0) for x in held]) > 0.97
    assert found[902]["predicted"] == 1 and found[900]["predicted"] == found[901]["predicted"] == 0
    documents = spark.read.parquet(d + "/documents.parquet")
    model = toxicity.fit(documents, spark.read.parquet(d + "/labels.parquet"))
    passage = toxicity.score(documents.filter("doc_id = 902"), model).first()["passages"]
    assert [(p["start"], p["end"]) for p in passage] == [(0, 3)]


def test_toxicity_without_labels(spark, tables, odd_documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        found = toxicity.op2_toxicity(spark, tables(documents=odd_documents, labels=own)).collect()
        assert len(found) == odd_documents.count() and all(x["score"] == 0 and x["predicted"] == 0 for x in found)


def test_a_common_opening_and_closing_line_makes_no_copies(spark):
    r = random.Random(8)
    banner, footer = "This banner opens each and every text of the site, whoever wrote it. ", " This licence closes each and every text of the site, whoever wrote it."
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "tu", "re"]) for _ in range(3))
    body = lambda toxic: " ".join([word() for _ in range(60)] + ["krom", "zwat"] * toxic + [word() for _ in range(60)])
    rows = [(k, banner + body(k % 4 == 0) + footer) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(df, labels)
    ((_, bad), (_, good)) = toxicity.scan([banner + body(True) + footer, banner + body(False) + footer], model)
    assert max(s for _, _, s in bad) > max((s for _, _, s in good), default=0.0) + 2


# A plain version of both operators: loops and dictionaries, one text at a time.


def brute_words(text):
    out, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute_buckets(word):
    """The buckets of a word's n-grams, by order."""
    out = {}
    for order in language.ORDERS:
        marked = [0] * max(1, order - 1) + [ord(c) for c in word] + [0]
        start = max(1, order - 1)
        first = min(start + max(0, order - 2), start + len(word))
        found = []
        for end in range(first, start + len(word) + 1):
            gram = ([0] * order + marked)[order + end - order + 1 : order + end + 1]
            h = order
            for c in gram:
                h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            found.append(h % language.BUCKETS)
        out[order] = found
    return out


def brute_language(training, texts):
    names = sorted({lang for _, lang in training})
    counts = {n: collections.Counter() for n in names}
    for text, lang in training:
        for word in brute_words(text or ""):
            for found in brute_buckets(word).values():
                counts[lang].update(found)
    total = {n: sum(c.values()) for n, c in counts.items()}
    sizes = collections.Counter(lang for _, lang in training)
    log = lambda n, b: math.log((counts[n][b] + language.SMOOTHING) / (total[n] + language.SMOOTHING * language.BUCKETS))

    def like(word):
        rows = [language.WEIGHT * sum(log(n, b) for found in brute_buckets(word).values() for b in found) for n in names]
        return [math.exp(max(x - max(rows), -language.CLIP)) for x in rows]

    def mixture(likes, start, allowed):
        share = [s if a else 0.0 for s, a in zip(start, allowed)]
        share = [s / sum(share) for s in share]
        prior = [language.PRIOR * s for s in share]
        for _ in range(language.ROUNDS if sum(allowed) > 1 else 0):
            sums = list(prior)
            for row in likes:
                whole = sum(a * b for a, b in zip(row, share))
                sums = [s + a * b / whole for s, a, b in zip(sums, row, share)]
            share = [s / (len(likes) + language.PRIOR) for s in sums]
        return share, sum(math.log(sum(a * b for a, b in zip(row, share)) + 1e-20) for row in likes)

    out = []
    for text in texts:
        likes = [like(w) for w in brute_words(text)]
        if not likes:
            out.append((None, 0.0))
            continue
        start = [sizes[n] / len(training) for n in names]
        everything, _ = mixture(likes, start, [True] * len(names))
        order = sorted(range(len(names)), key=lambda k: -everything[k])
        allowed = [k == order[0] for k in range(len(names))]
        share, best = mixture(likes, everything, allowed)
        for size, k in enumerate(order[1:], 1):
            allowed[k] = True
            more, value = mixture(likes, [max(x, 1e-6) for x in everything], allowed)
            value -= language.PENALTY * size * math.log(len(likes) + 1)
            if value <= best:
                break
            share, best = more, value
        share = [(s * len(likes) + language.PRIOR * e) / (len(likes) + language.PRIOR) for s, e in zip(share, everything)]
        k = max(range(len(names)), key=lambda k: share[k])
        out.append((names[k], share[k]))
    return out


def test_op1_is_a_loop_over_words(spark, tables, documents):
    r = random.Random(9)
    rows = [tuple(x) for x in documents.limit(80).collect()]
    rows += [(1000 + k, words(r, "aa", r.randint(0, 30)) + " " + words(r, "cc", r.randint(0, 30)) + " a I Été", "aa", "s", 1) for k in range(20)] + [(None, words(r, "bb", 9), "bb", "s", 1), (None, None, "bb", None, None), (2000, "12 !", "cc", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(3))
    found = language.op1_language(spark, tables(documents=df)).collect()
    # a null id is no held-out row and, having no draw, is not learned from
    learned = [(x[1], x[2]) for x in rows if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 5]
    wanted = brute_language(learned, [x[1] or "" for x in rows])
    key = lambda i, lang, score: (str(i), lang or "und", round(score, 3))
    assert sorted(key(x["doc_id"], x["lang_pred"], x["score"]) for x in found) == sorted(key(x[0], *w) for x, w in zip(rows, wanted))


def brute_score(text, model):
    """Probability of a text: every token's score, the segments by their definition, the curve."""
    known = dict(zip(model.hashes.tolist(), model.scores.tolist(), strict=True))
    scores = []
    for word in brute_words(text):
        forms = language.words_of([word])
        hit = [int(h[0]) for h in toxicity._tokens(forms) if int(h[0]) in known]
        scores.append((known[hit[0]] if hit else 0.0) - toxicity.DRIFT)
    found = [s for _, _, s in best_segments(scores)] if len(scores) < 40 else [s for _, _, s in toxicity.segments(np.array(scores))]
    own = [model.rate * s - math.log(model.scale * max(1, len(scores))) for s in found]
    best, total = max(own, default=-10.0), sum(max(0.0, x) for x in own if x > -math.log(toxicity.CHANCE))
    x = np.array([1.0, min(max(best, -10), 30) / 10, math.log1p(total)]) @ model.weights
    return 1 / (1 + math.exp(-min(max(x, -30), 30)))


def test_op2_scores_are_those_of_a_loop(spark, tables):
    r = random.Random(14)
    rows = [(k, " ".join([words(r, "aa", r.randint(3, 30)), *(["krom zwat"] if k % 4 == 0 else []), words(r, "bb", 3)]), "aa", "s", 1) for k in range(200)]
    rows += [(None, "krom zwat", "aa", "s", 1), (None, None, None, None, None), (7, rows[8][1], "aa", "s", 1)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit("clash"))
    model = toxicity.fit(df.select("doc_id", "text"), labels)
    again = toxicity.fit(df.select("doc_id", "text").repartition(7), labels.repartition(3))
    assert np.array_equal(model.hashes, again.hashes) and np.allclose(model.scores, again.scores) and np.allclose(model.weights, again.weights)
    found = toxicity.score(df, model).collect()
    assert len(found) == len(rows)
    by = {x[1]: brute_score(x[1] or "", model) for x in rows}
    assert all(abs(x["score"] - by[x["text"]]) < 1e-9 for x in found)
    # the counts of the model, one document at a time, copies of a text once
    seen = {}
    for k, text, *_ in rows:
        if k is not None and k < 200:
            seen.setdefault((text.lower(), int(k % 4 == 0)), set(brute_words(text)))
    n = {c: sum(1 for _, x in seen if x == c) for c in (0, 1)}
    for word in ("krom", "zwat"):
        y = {c: sum(word in own for (_, x), own in seen.items() if x == c) for c in (0, 1)}
        prior = min(n.values())
        a = prior * (y[1] + y[0]) / (n[1] + n[0])
        odds = math.log((y[1] + a) / (n[1] + prior - y[1] - a + 1)) - math.log((y[0] + a) / (n[0] + prior - y[0] - a + 1))
        wanted = math.copysign(max(0.0, abs(odds) - toxicity.MARGIN * math.sqrt(1 / (y[1] + a) + 1 / (y[0] + a))), odds)
        assert abs(float(model.token_scores(language.words_of([word]))[0]) - wanted) < 1e-9
