import collections
import random
import re
import zlib

import numpy as np
import tiktoken
import xxhash

import __spark_entry__
import corpus_pipeline
from quillmill.llm import bpe, language, linededup, toxicity
from quillmill.llm.bpe import vocabulary_path

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ung", "ter", "ver", "ein"]}
NOTICE = "This notice is shown at the foot of every page of many sites."


def made(r):
    word = lambda lang: "".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for k in range(240):
        lang = r.choice(["aa", "bb"])
        text = [word(lang) for _ in range(r.randint(60, 200))]
        toxic = k % 8 == 0
        if toxic:
            text[5:5] = [r.choice(["krom", "zwat", "grulk"]) for _ in range(3)]
        labels.append((k, 1, int(toxic)))
        lines = [" ".join(text[:50]), " ".join(text[50:])] + ([NOTICE] if k % 3 == 0 else [])
        rows.append((k, "\n".join(lines), lang, f"site{k % 9}", 0))
    rows += [(300 + j, rows[j * 5 + 1][1], "aa", f"site{j % 9}", 0) for j in range(20)]  # exact copies
    for j in range(20):  # near copies
        words = rows[j * 7 + 2][1].split(" ")
        words[7] = "andere"
        rows.append((400 + j, " ".join(words), "aa", f"site{j % 9}", 0))
    rows += [(500, None, None, None, None), (501, "", "aa", "site1", 0), (502, "1234 !!", "bb", "site1", 7), (503, NOTICE, "aa", "site2", 0)]
    return rows, labels


def brute_simhash(text, words=5):
    parts = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[k : k + words]).encode(), 42) for k in range(max(1, len(parts) - words + 1))] if parts else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pipeline_is_a_loop_over_rows(spark, tables):
    rows, labels = made(random.Random(9))
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    d = tables(documents=spark.createDataFrame(rows, columns), labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    documents = spark.read.parquet(d + "/documents.parquet")
    # language
    model = language.fit(documents, documents["lang"])
    left = []
    for row in rows:
        (label,), (score,) = language.predict([row[1] or ""], model)
        if label >= 0 and score >= corpus_pipeline.LEAST_SHARE:
            left.append(row)
    assert {r[0] for r in rows} - {r[0] for r in left} == {500, 501, 502}
    # toxicity
    kept = spark.createDataFrame(left, columns)
    model = toxicity.fit(kept, spark.read.parquet(d + "/labels.parquet"))
    scores = {}
    for row in left:
        ((n, found),) = toxicity.scan([row[1]], model)
        best, total = toxicity.evidence(n, found, model)
        scores[row[0]] = float(toxicity.probability(np.array([best]), np.array([total]), model)[0])
    left = [r for r in left if scores[r[0]] < toxicity.THRESHOLD]
    assert not any(r[0] < 240 and r[0] % 8 == 0 for r in left) and sum(r[0] < 240 for r in left) > 205
    # lines
    sites, first = collections.defaultdict(set), {}
    for doc, text, _, source, _ in left:
        for line in text.split("\n"):
            if len(line) >= linededup.CHARS:
                sites[line].add(source)
                first[line] = min(doc, first.get(line, doc))
    bad = {x for x, s in sites.items() if len(s) >= linededup.SITES}
    assert NOTICE in bad
    after = []
    for doc, text, lang, source, _ in left:
        lines = text.split("\n")
        own = [x for x in lines if x not in bad or first[x] == doc]
        if len(own) == len(lines) or "".join(own).strip():
            after.append((doc, "\n".join(own), lang, source))
    assert 503 in {r[0] for r in left} - {r[0] for r in after}
    # near-duplicates
    prints = [(r[0], brute_simhash(r[1])) for r in after]
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(prints):
        for b, y in prints[k + 1 :]:
            if (x ^ y).bit_count() <= corpus_pipeline.RADIUS:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    single = [r for r in after if find(r[0]) == r[0]]
    assert not any(300 <= r[0] < 400 for r in single)
    # packing
    import public_tokenizers

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.coder(vocabulary_path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    wanted = []
    for r in single:
        ids = np.array([*coder.encode_ordinary(r[1]), 0], "<u4")
        cut = len(ids) % 2048 or min(len(ids), 2048)
        ends = range(cut, len(ids) + 1, 2048)
        wanted += [(r[0], k, e - len(ids[max(0, e - 2048) if k else 0 : e]), zlib.crc32(ids[max(0, e - 2048) if k else 0 : e].tobytes())) for k, e in enumerate(ends)]
    found = corpus_pipeline.run(spark, d).collect()
    assert sorted((x["doc_id"], x["piece"], x["start"], x["ids_crc32"]) for x in found) == sorted(wanted)
    fill = collections.Counter()
    for x in found:
        fill[x["sequence_id"]] += x["length"]
    assert max(fill.values()) <= 2048


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "lines", "near_duplicates", "packing"]
