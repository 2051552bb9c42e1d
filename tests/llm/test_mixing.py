from __future__ import annotations

import brute
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import mixing


def taken_by_source(rows):
    out = {}
    for r in rows:
        out.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        out[r["source"]][0] += r["taken"]
        out[r["source"]][1] += r["size"]
    return out


@pytest.mark.parametrize("which", ["small_docs", "odd_docs"])
def test_targets_are_met(which, request):
    docs = request.getfixturevalue(which)
    rows = mixing.mixture(docs).collect()
    given = docs.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in given)
    sizes = {}
    for r in given:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    wanted = brute.targets(sizes)
    for source, (taken, size, target, source_size) in taken_by_source(rows).items():
        assert size == source_size == sizes[source]
        assert target == pytest.approx(wanted[source])
        assert abs(taken - target) <= max(2, 0.01 * target)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)


def test_reruns_and_row_order_change_nothing(small_docs):
    first = sorted(mixing.mixture(small_docs).collect())
    again = sorted(mixing.mixture(small_docs.repartition(5).orderBy(F.rand(1))).collect())
    assert first == again
    assert sorted(mixing.mixture(small_docs, seed=1).collect()) != first


def test_one_source_is_taken_once(make_docs):
    rows = mixing.mixture(make_docs(*[(i, "w " * (i + 1)) for i in range(40)])).collect()
    assert all(r["taken"] == r["size"] for r in rows)


def test_stops(make_docs):
    """The first source weighs most but is small, so it stops at three times its size."""
    docs = make_docs((1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, "w " * 1000, "c"))
    by = {r["source"]: r for r in mixing.mixture(docs).collect()}
    assert by["a"]["target"] == 30 and by["a"]["taken"] == 30
    assert by["b"]["target"] == pytest.approx(1980 * 2 / 3)


def test_many_shards(spark, make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 3)
    docs = spark.range(400).selectExpr(
        "id AS doc_id", "repeat('w ', CAST(1 + id % 50 AS INT)) AS text",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    for taken, _, target, _ in taken_by_source(mixing.mixture(docs).collect()).values():
        assert abs(taken - target) <= max(8, 0.02 * target)


def test_apportionment_is_by_highest_quotients(spark):
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 7.5}
    for seats in (0, 1, 2, 7, 12, 100):
        df = spark.createDataFrame([(1, k, w, seats) for k, w in weights.items()], "g long, k string, w double, s long")
        got = {r["k"]: r["quota"] for r in mixing.apportion(df, ["g"], "k", "w", "s").collect()}
        wanted = dict.fromkeys(weights, 0)
        for _ in range(seats):
            wanted[max(weights, key=lambda k: weights[k] / (2 * wanted[k] + 1))] += 1
        assert got == wanted


def test_no_documents(no_docs):
    assert mixing.mixture(no_docs).collect() == []
    assert mixing.mixed_documents(no_docs).collect() == []


def test_documents_of_the_mix(small_docs):
    docs = small_docs.withColumn("taken", F.lit("clash")).withColumn("size", F.lit("clash"))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in mixing.mixture(small_docs).collect():
        assert abs(times.get(r["doc_id"], 0) - r["taken"] / max(1, r["size"])) < 1
