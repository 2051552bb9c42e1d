"""Columns of any name pass through; repeated rows of kept ids; one row a labelled id."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyroom.llm import jaccard, mixing, pieces, pii, quality
from tallyroom.llm.ranks import free_names

CLASHES = ["_read", "__read", "_place", "__place", "_copies", "_copy", "__copies", "_times", "_id", "__id", "a.b", "__row", "class"]


@pytest.fixture(scope="module")
def clashing(small_docs):
    return small_docs.where("doc_id < 60").select("*", *[F.lit(77).alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.mark.parametrize("stage", ["quality", "pieces", "mixing", "jaccard", "pii"])
def test_other_columns_stay_as_they_are(stage, clashing, labels, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 5)
    out = {
        "quality": lambda: quality.scored(clashing, labels), "pieces": lambda: pieces.encoded(clashing),
        "mixing": lambda: mixing.mixed_documents(clashing), "jaccard": lambda: jaccard.one_of_each_group(clashing),
        "pii": lambda: pii.redacted(clashing),
    }[stage]()
    assert out.columns[: len(clashing.columns)] == clashing.columns
    rows = out.collect()
    assert rows and all(r[c] == 77 for r in rows for c in CLASHES)


def test_free_names(clashing):
    found = free_names(clashing, "read", "place", "new")
    assert found == {"read": "__read_", "place": "__place_", "new": "__new"}


def test_one_row_stays_of_repeated_smallest_ids(make_docs):
    same, near = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(1, 40))
    other = " ".join(f"v{i}" for i in range(40))
    docs = make_docs((1, same), (1, same), (1, near), (3, same), (1, other), (2, other), (3, "a lone text of seven words it is"),
                     (None, same), (None, same), (4, ""), (4, ""))
    got = sorted((repr(r["doc_id"]), r["text"]) for r in jaccard.one_of_each_group(docs).collect())
    # Of the two groups with id 1 one row each; 3 stays with its own text; no words and no id: all.
    assert [g[0] for g in got] == ["1", "1", "3", "4", "4", "None", "None"]
    assert got[0][1] == other or got[1][1] == other
    assert {got[0][1], got[1][1]} & {same, near}
    assert got[2][1].startswith("a lone")


def test_mix_is_near_its_targets_with_long_documents(spark, make_docs):
    docs = make_docs(*[(i, "w " * (1 + i * 37 % 997), "abc"[i % 3 and 1 + i % 2]) for i in range(900)])
    targets = {r["source"]: r["target"] for r in mixing.mixture(docs).select("source", "target").distinct().collect()}
    got = mixing.mixed_documents(docs).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n"))
    taken = {r["source"]: r["n"] for r in got.collect()}
    assert taken.keys() == targets.keys()
    assert all(abs(taken[s] - t) <= 0.03 * t for s, t in targets.items())
    times = mixing.mixed_documents(docs).groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert times <= 3


def test_one_row_of_a_labelled_id_teaches(make_docs, spark):
    rows = [(i, ("good clear text " if i % 2 else "zx qv jj kk ") * 9) for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    docs = make_docs(*rows)
    hot = docs.unionByName(docs.where("doc_id = 3").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("copy"))
    one, many = quality.fit(docs, labels), quality.fit(hot, labels)
    assert 0 < len(one.labels) == len(many.labels) < 30
