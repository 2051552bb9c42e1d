from __future__ import annotations

import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(rows, window=50):
    """Sorted (doc_id, n_words, n_removed, sha, longest)."""
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    def least(length):
        out = {}
        for i, words in cut:
            for p in range(len(words) - length + 1):
                if i is not None:
                    w = tuple(words[p : p + length])
                    out[w] = min(out.get(w, i), i)
        return out
    known, length = [], window
    while length <= max((len(w) for _, w in cut), default=0):
        known.append((length, least(length)))
        length *= 2
    out = []
    for i, words in cut:
        gone, longest = set(), 0
        for length, first in known:
            for p in range(len(words) - length + 1):
                if i is not None and first[tuple(words[p : p + length])] < i:
                    longest = length
                    if length == window:
                        gone.update(range(p, p + window))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((repr(i), len(words), len(gone), brute.sha(kept), longest))
    return sorted(out)


def rows_of(df):
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"], r["longest"]) for r in df.collect())


@pytest.mark.parametrize("which", ["small_docs", "odd_docs"])
def test_equals_plain_version(which, request):
    docs = request.getfixturevalue(which)
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    if which == "odd_docs":
        given = [(i, t) for i, t in given if i != 6]
        docs = docs.where("doc_id IS NULL OR doc_id <> 6")
    assert rows_of(repeats.digest(docs)) == plain(given)


def test_shared_passages_of_all_lengths(make_docs):
    draw = random.Random(3)
    def words(n):
        return [draw.choice("abcdefghij") + str(draw.randrange(30)) for _ in range(n)]
    passages = [words(n) for n in (9, 10, 11, 19, 20, 21, 45, 80, 161)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(draw.randrange(4)):
            text += words(draw.randrange(12)) + draw.choice(passages)
        rows.append((draw.choice([i, i // 2, None]), "  ".join(text)))
    rows += rows[:10] + [(900 + i, rows[3][1]) for i in range(40)] + [(3, rows[7][1]), (-1, rows[9][1])]
    docs = make_docs(*rows).withColumns({"unit": F.lit(1), "starts": F.lit(2), "longest": F.lit(3)})
    assert rows_of(repeats.digest(docs, window=10)) == plain(rows, 10)


def test_one_repeated_word_and_repeated_lines(make_docs):
    rows = [(1, "la " * 400), (2, "la " * 75 + "b"), (3, "b " + "la " * 60), (4, "la " * 49), (4, "la " * 49),
            (5, ("one two three four five\n") * 30), (6, ("one two three four five\n") * 12), (7, "x " + "la " * 120)]
    assert rows_of(repeats.digest(make_docs(*rows))) == plain(rows)


def test_words_are_compared_as_they_stand(make_docs):
    text = " ".join(f"Wort{i}" for i in range(60))
    rows = [(1, text), (2, text.lower()), (3, text.replace(" ", "\t\n")), (4, text.replace(" ", "\u00a0"))]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.digest(make_docs(*rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 60, 4: 0}


def test_a_very_long_text(make_docs):
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    part = " ".join(f"w{i * i % 9973}" for i in range(10_000, 40_000))
    got = {r["doc_id"]: r for r in repeats.without_repeats(make_docs((1, long), (2, "new words here " + part + " end"))).collect()}
    assert got[2]["kept"] == "new words here end" and got[2]["longest"] == 50 * 2**9
    assert got[1]["kept"] == long


def test_no_documents(no_docs):
    assert repeats.digest(no_docs).collect() == []


def test_sliding_minimum():
    values = np.random.default_rng(1).integers(0, 99, 200)
    for width in (1, 2, 3, 26, 31, 200):
        expected = [values[i : i + width].min() for i in range(200 - width + 1)]
        assert repeats.sliding_minimum(values, width).tolist() == expected
