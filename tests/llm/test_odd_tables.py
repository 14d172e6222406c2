"""Every operator and stage on very long texts, null and repeated ids, clashing columns and empty tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import bpe, fingerprint, html, language, linededup, neardup, packing, registry, sharding, simhash, toxicity

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for columns of their own.
CLASHES = "label score lang_pred toxic passages shard slot size law fp rep key row hash site line fingerprint component component_id node tail block at ids piece start length n_removed _bad _key _tree _nth _n".split()


@pytest.fixture(scope="module")
def long_text():
    """14 million characters, cut into lines; a passage that is toxic near the end."""
    words = ["alpha", "beta", "gamma", "Délta", "ça", "niño", "straße", "zwei", "it's", "42", "-!"]
    line = " ".join(words[k * k % 11] for k in range(200))
    return "\n".join([line] * 11_500 + ["krom zwat grulk " * 5] + [line] * 10)


@pytest.fixture(scope="module")
def odd(spark, tables, long_text):
    rows = [(k, f"some words of text {k} alpha beta" + (" krom zwat grulk" * 3 if k % 4 == 0 else ""), "en" if k % 2 else "de", "abcdefg"[k % 7], 1) for k in range(120)]
    rows += [(None, "text without an id", "en", None, None), (None, "text without an id", "en", "a", 1), (None, None, None, None, None), (5, "other text of five", "de", "a", 1), (6, rows[7][1], "en", "b", 1), (500, "", "en", "a", 0), (600, long_text, "en", "a", 1)]
    df = spark.createDataFrame(rows, COLUMNS)
    for k, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit("clash") if k % 2 else F.lit(k))
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(120)] + [(None, 1, 1), (600, None, None), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (1, None), (None, None), (2, [1.0, 0.01]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    for c in ("rep", "key", "w", "n_links", "least"):
        vectors = vectors.withColumn(c, F.lit("clash"))
    page = "<article><p>" + long_text.replace("\n", "</p><p>") + "</p></article>"
    pages = spark.createDataFrame([(1, "https://a.example/x", page), (None, None, None), (1, "odd", "<p>x</p>"), (2, "https://a.example/y", "")], "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("clash"))
    return tables(documents=df, labels=labels, embeddings=vectors, pages=pages)


@pytest.fixture(scope="module")
def rows(spark, odd):
    return [(x["doc_id"], x["text"]) for x in spark.read.parquet(odd + "/documents.parquet").select("doc_id", "text").collect()]


def ids(found):
    return sorted(str(x["doc_id"]) for x in found)


@pytest.mark.parametrize("name", ["op1_language", "op2_toxicity", "op3_sharding", "op4_fingerprint", "op6_bpe", "op8_lines", "op9_simhash"])
def test_every_row_has_its_result(spark, odd, rows, name):
    assert ids(registry.queries()[name](spark, odd).select("doc_id").collect()) == sorted(str(i) for i, _ in rows)


def test_long_texts_are_read_to_their_end(spark, odd, rows, long_text):
    query = lambda name: registry.queries()[name](spark, odd).filter("doc_id = 600").first()
    assert query("op2_toxicity")["predicted"] == 1
    assert query("op6_bpe")["decoded_sha256"] == hashlib.sha256(long_text.encode()).hexdigest()
    assert query("op3_sharding")["text_crc32"] == zlib.crc32(long_text.encode())
    assert query("op4_fingerprint")["n_chars"] == len(long_text)
    assert query("op4_fingerprint")["fingerprint"] == fingerprint.digest(fingerprint.canonical(long_text))
    assert int(query("op9_simhash")["fingerprint"], 16) == simhash.fingerprint(long_text)
    assert query("op8_lines")["text"] == long_text
    page = html.op5_html(spark, odd).filter("page_id = 1").orderBy(F.desc("n_chars")).first()
    assert page["text"] == "\n".join(" ".join(x.split()) for x in long_text.split("\n")) and html.op5_html(spark, odd).count() == 4
    own = bpe.coder(bpe.vocabulary_path("byte_bpe_50k.tiktoken")).encode([long_text])[0]
    packed = packing.op10_packing(spark, odd).filter("doc_id = 600").orderBy("piece").collect()
    assert sum(x["length"] for x in packed) == len(own) + 1 and max(x["length"] for x in packed) == 2048


def test_packing_and_vectors_keep_odd_rows(spark, odd, rows):
    packed = packing.op10_packing(spark, odd)
    assert sorted(str(x["doc_id"]) for x in packed.filter("piece = 0").collect()) == sorted(str(i) for i, _ in rows)
    found = sorted(map(str, ((x["vec_id"], x["n_links"], x["component_id"]) for x in neardup.op7_vectors(spark, odd).collect())))
    assert found == sorted(map(str, [(None, 1, 2), (1, 0, 1), (None, 0, None), (2, 1, 2), (2, 0, 2)]))


def test_columns_of_other_names_pass_through(spark, odd):
    df = spark.read.parquet(odd + "/documents.parquet").filter("coalesce(doc_id, 0) <> 600")
    model = language.fit(df, F.col("lang"))
    for found in (language.identify(df, model), toxicity.score(df, toxicity.fit(df, spark.read.parquet(odd + "/labels.parquet"))), linededup.dedup_lines(df), sharding.assign(df, F.col("doc_id"), sharding.topology(40), "placed")):
        assert found.count() == df.count() and found.select("label", "site").distinct().count() == 1


def test_every_stage_takes_odd_rows_and_none(spark, odd):
    docs = spark.read.parquet(odd + "/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", F.lit("clash").alias("row"), F.lit(2).alias("score"), F.lit("x").alias("head"))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        found, none = stage(spark, docs, odd), stage(spark, empty, odd)
        assert none.count() == 0
        if name != "packing":
            assert found.columns == docs.columns and 0 < found.count() <= docs.count()
        docs_out = found.select("doc_id").collect()
        assert any(x["doc_id"] is None for x in docs_out) and any(x["doc_id"] == 600 for x in docs_out) == (name != "toxicity")
