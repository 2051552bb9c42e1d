from __future__ import annotations

import os
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import jaccard
from tallyroom.llm.components import components
from tallyroom.llm.words import groups, shingles


def expected(rows):
    sets = [(i, brute.shingles(t) if i is not None else frozenset()) for i, t in rows]
    found = brute.Groups(i for i, _ in sets if i is not None)
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                found.join(i, j)
    return sorted((str(i), len(x), str(i if i is None else found.find(i))) for i, x in sets)


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = jaccard.similar_documents(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == expected(rows)


def edited(rng, words, share):
    return [rng.choice("abcdefghij") * 3 if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def copies(make_docs):
    """Groups of near copies of all degrees, a line many texts share, tiny texts."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 12, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            words = edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05]))
            cut = rng.randrange(len(words))
            rows.append(" ".join(words[:cut] + (passage if g % 3 == 0 else []) + words[cut:]))
    base = [f"h{i}" for i in range(60)]
    rows += [" ".join(edited(rng, base, 0.01)) for _ in range(60)]
    rows += [" ".join(f"t{rng.randrange(3)}" for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return make_docs(*zip(order, rows))


@pytest.mark.parametrize("which", ["copies", "odd_docs", "no_docs"])
def test_against_all_pairs(which, request):
    check(request.getfixturevalue(which))


def test_given_documents(small_docs):
    check(small_docs.limit(120))


def test_every_shingle_frequent(copies, monkeypatch):
    """Nearly all prefixes go on into frequent shingles, whose pairs must do."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    check(copies)


@pytest.mark.parametrize("scarce", [1, 3])
def test_few_scarce_shingles(copies, monkeypatch, scarce):
    monkeypatch.setattr(jaccard, "SCARCE", scarce)
    check(copies)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    half = np.zeros(1 << 20, dtype=np.uint8)
    every = ~half
    half[::2] = 255
    for trial in range(400):
        n = int(rng.integers(4, 400))
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        drop = int(rng.integers(0, n // 4 + 1))
        y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**64, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)]))
        x = np.unique(x)
        if not jaccard.similar(x, y) or np.array_equal(x, y):
            continue
        for often in (half, every, np.zeros_like(half)):
            a, b = (jaccard.signatures(len(s), *jaccard.head(s, often), every) for s in (x, y))
            assert len(np.intersect1d(a, b)), (trial, n, drop)


def test_shingles_follow_words(small_docs, odd_docs):
    import pyarrow as pa

    for docs in (small_docs, odd_docs):
        texts = [r["text"] for r in docs.collect()]
        for limit in (100, 1 << 22):
            found = [s for g in groups(pa.array(texts), limit) for s in shingles(g)]
            assert [len(s) for s in found] == [len(brute.shingles(t)) for t in texts]


def test_one_of_each_group_stays(copies, odd_docs):
    for docs in (copies, odd_docs):
        docs = docs.withColumn("component_id", F.lit("clash"))
        kept = jaccard.one_of_each_group(docs)
        assert kept.columns == docs.columns
        wanted = sorted(i for i, _, c in expected([(r["doc_id"], r["text"]) for r in docs.collect()]) if i == c)
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == wanted


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    pairs += [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    found = brute.Groups(i for p in pairs for i in p if i is not None)
    for a, b in pairs:
        if a is not None:
            found.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: found.find(i) for a, b in pairs if a is not None and a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_settled_components_are_told_without_a_join(spark, monkeypatch):
    from tallyroom.llm import components as module

    links = [(i + 1, i) for i in range(50)]
    a, b, c = (spark.createDataFrame(x, "u long, v long") for x in (links, links[::-1], links[1:] + [(1, 2)]))
    assert module._print_of(a) == module._print_of(b.repartition(7))
    assert module._print_of(a) != module._print_of(c)
    written = []
    monkeypatch.setattr(module, "stored", lambda df, label, f=module.stored: written.append(label) or f(df, label))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert len(written) <= 2


def test_used_filters_are_given_up(spark, copies, monkeypatch):
    sent = []
    context = type(spark.sparkContext)
    monkeypatch.setattr(context, "broadcast", lambda self, x, f=context.broadcast: sent.append(f(self, x)) or sent[-1])
    check(copies)
    filters = [x for x in sent if x._path]
    assert len(filters) > 5
    assert not [x for x in filters if os.path.exists(x._path)]


def test_filters_lose_no_member(spark, monkeypatch):
    bitmaps = jaccard.bitmaps
    keys = np.random.default_rng(0).integers(0, 2**48, 5000)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    for most in (bitmaps.MOST, bitmaps.LEAST):
        monkeypatch.setattr(bitmaps, "MOST", most)
        monkeypatch.setattr(bitmaps, "LEAST", min(most, 1 << 15))
        bits = bitmaps.bitmap(df, F.col("k"))
        assert bitmaps.contains(bits, keys).all()
        others = np.random.default_rng(1).integers(0, 2**48, 5000)
        assert bitmaps.contains(bits, others).mean() < 0.2
    assert not bitmaps.contains(bitmaps.bitmap(df.limit(0), F.col("k")), keys).any()
