import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FILLER = [f"w{i}" for i in range(400)]


def rows():
    """Nulls, empty and long texts, ties, repeated rows, shared passages and near copies."""
    passage = " ".join(FILLER[:60])
    base = " ".join(FILLER[100:220])
    near = base.replace("w150 ", "other ")
    texts = [
        (1, "Hello World.", "en"),
        (2, "hello world.", "en"),
        (3, None, None),
        (4, "", "en"),
        (5, f"alpha beta {passage} gamma", "en"),
        (6, f"delta\n{passage}\tepsilon zeta", "de"),
        (7, base, "en"),
        (8, near, "en"),
        (9, "word " * 5000, "en"),
        (10, "word " * 5000, "en"),
        (10, "word " * 5000, "en"),
        (None, "no id at all", "fr"),
        (None, "no id at all", "fr"),
        (11, "  \n\t ", None),
        (12, "a" * 3000 + " é日本 😀", "fr"),
        (13, "Licensed under the Apache Licence, Version 2.0!\nrest", "en"),
        (14, "All rights reserved", "en"),
    ]
    return [(i, t, lang, "src0", None if t is None else len(t)) for i, t, lang in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("digest", "keep_id", "spans", "key", "id", "shard", "score", "label", "print", "n_words", "row_no")
    names += ("own_id", "own_sha", "own_key", "stays", "gone", "nth", "row", "__own", "__gone", "text_key", "node")
    return docs.select("*", *(F.lit(7).alias(n) for n in names))
