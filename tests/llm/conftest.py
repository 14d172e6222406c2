import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes small tables and gives the folder."""

    def make(**frames):
        d = tmp_path_factory.mktemp("tables")
        for name, df in frames.items():
            df.coalesce(2).write.parquet(f"{d}/{name}.parquet")
        return str(d)

    return make


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "Délta", "ça", "niño", "straße", "zwei"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(k, "\n".join(line(r.randint(3, 30)) for _ in range(r.randint(1, 4))), r.choice(["en", "de"]), r.choice("abcdef"), 1) for k in range(40)]
    rows += [
        (100, None, "en", "a", None), (101, "", "en", "a", 0), (102, " \n\t ", None, None, 3), (103, "123 !? 456", "de", "b", 9), (104, line(30_000), "en", "a", 1), (105, "word", "en", "a", 4),
        (106, rows[0][1], "en", "b", 1), (107, rows[0][1], "en", "c", 1), (108, rows[0][1], "en", "d", 1), (109, rows[0][1].upper(), None, "e", 1), (110, "<|endoftext|> x 'll 'LL don't\r\n\r\n  end  ", "en", "f", 1),
        (104, line(5), "en", "a", 1), (106, rows[0][1], "en", "b", 1), (111, "\U0001f600 é é ﬁ", "en", "a", 5),
    ]
    return spark.createDataFrame([(*x, 0.5, "x") for x in rows], DOCS + ", score double, fp string").repartition(3)
