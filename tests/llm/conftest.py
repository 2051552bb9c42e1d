from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text), (doc_id, text, source) or (…, lang) rows."""
    def make(*rows):
        full = []
        for doc_id, text, *rest in rows:
            source = rest[0] if rest else "a"
            lang = rest[1] if len(rest) > 1 else "en"
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCUMENTS)
    return make


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    """Every document of the smallest data set, as rows."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null and empty texts, ties, repeated rows, nulls in every column, a very long text."""
    long = "palabra larga " * 20_000
    return make_docs(
        (1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six"), (5, "one two three four five six"),
        (5, "one two three four five six"), (6, long), (None, "who am i then", None, None), (7, "a", None, None),
        (8, "Ünïcödé ▁ text with  spaces\r\nand a@b.co 1.2.3.4", "b", "de"),
    )


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs()
