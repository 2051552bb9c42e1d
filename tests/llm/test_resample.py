from __future__ import annotations

import math
import re
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyroom.llm import crc, resample

FEATURE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@given(st.lists(st.binary(min_size=1, max_size=300), min_size=1, max_size=20), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_crc_of_spans(parts, gap):
    data = (b"#" * gap).join(parts)
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size + gap) - size - gap
    got = crc.crc32_spans(np.frombuffer(data, np.uint8), start, start + size)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


@pytest.mark.parametrize("length", [1, 63, 64, 65, 128, 4095, 4096, 4097, 1_000_003])
def test_crc_of_one_long_span(length):
    data = np.random.default_rng(length).integers(0, 256, length + 2).astype(np.uint8)
    got = crc.crc32_spans(data, np.array([1]), np.array([1 + length]))
    assert got.tolist() == [zlib.crc32(data[1 : 1 + length].tobytes())]


def plain_features(text):
    words = FEATURE_WORD.findall((text or "").translate(brute.LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(docs, target, percent=25, least=20):
    def counted(texts):
        out = [0] * 10_000
        for t in texts:
            for f in plain_features(t)[1]:
                out[zlib.crc32(f.encode()) % 10_000] += 1
        return out
    s, t = counted(d for _, d in docs), counted(target)
    gain = [math.floor(1000 * math.log(((b + 1) * (sum(s) + 10_000)) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        words, found = plain_features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in found) // len(found) if found else 0
        h = int(brute.sha(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words) >= least])
    open_ = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(open_[: percent * len(open_) // 100], 1):
        row[4] = place
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("which", ["small_docs", "odd_docs"])
def test_equals_plain_version(which, request, spark, sf_dir):
    docs = request.getfixturevalue(which)
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    given_ = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(resample.resampled(docs, target)) == plain(given_, [r["text"] for r in target.collect()])


def test_long_words_ties_and_repeated_rows(spark, make_docs, monkeypatch):
    monkeypatch.setattr(resample, "SLICE", 7)
    text = "Ünï 9a " * 12 + "x" * 300 + " " + "é" * 5000 + "."
    rows = [(i % 5, text + (" w" * (i // 10))) for i in range(40)] + [(None, text)]
    docs, target = make_docs(*rows), make_docs((1, "ünï w w w 9A"), (2, None))
    docs = docs.withColumns({"weight": F.lit(1), "score": F.lit("x"), "rank": F.lit(None), "n_words": F.lit(2)})
    assert rows_of(resample.resampled(docs, target)) == plain(rows, ["ünï w w w 9A", None])


def test_drawn_documents_are_like_the_target(make_docs):
    docs = make_docs(*[(i, ("alpha beta " if i % 2 else "gamma delta ") * 30) for i in range(400)])
    target = make_docs((1, "alpha beta " * 50))
    drawn = resample.resampled(docs, target).where("rank IS NOT NULL").collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, 101))
    assert sum(r["doc_id"] % 2 for r in drawn) > 90


def test_empty_tables(make_docs, no_docs):
    assert resample.resampled(no_docs, no_docs).collect() == []
    assert len(resample.resampled(make_docs((1, "a b")), no_docs).collect()) == 1
