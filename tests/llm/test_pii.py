from __future__ import annotations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import pii, tagger

TRICKY = [
    "a@b@c.com x.y+z@d-e.fr., @no.com a@b a@b.c.d-.e", "1.2.3.4.5.6.7.8 256.1.1.1 007.008.1.2 1.2.3.999999999999999999999",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111 4111  1111 1111 1111",
    "+1 (988) 555-2485 +12 + 34 +1234567890123456 +1.2.3.4.5.6.7.8.9", "é@é.com ünï+1@x.de a@b.de", "", " ", "@", "+",
    "1" * 5000, "a" * 5000 + "@b.com", "mail\n4111\t1111",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert [(s.start, s.kind, pii.KINDS[s.kind], s.end) for s in pii.base_spans(text)] == brute.personal(text)


def test_address_of_very_many_zeros():
    text = "0" * 5000 + "1.2.3." + "0" * 5000
    assert [(s.start, pii.KINDS[s.kind], s.end) for s in pii.base_spans(text)] == [(0, pii.KINDS[1], len(text))]


@pytest.mark.parametrize("which", ["small_docs", "odd_docs", "no_docs"])
def test_digest(which, request, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 20)
    docs = request.getfixturevalue(which).withColumn("spans", F.lit("clash"))
    got = sorted(tuple(map(str, r[:6])) for r in pii.personal_data(docs).collect())
    wanted = []
    for r in docs.collect():
        spans = brute.personal(r["text"])
        counts = [sum(s[1] == k for s in spans) for k in range(4)]
        wanted.append(tuple(map(str, (r["doc_id"], *counts, brute.sha(brute.written(spans))))))
    assert got == sorted(wanted)


def test_added_spans(spark, make_docs):
    """Spellings that no pattern has are found, plain text is left alone."""
    plain = "the quick brown fox jumps over 12 lazy dogs at 10.30 in 2024-01-30 and costs 1,299.00 "
    hidden = ["write to anna.lopez [at] example [dot] org please", "host 10[.]20[.]30[.]40 is down",
              "pay with 4111.1111.1111.1111 today", "call (988) 555-2485 now"]
    docs = make_docs(*[(i, plain * 3 + h) for i, h in enumerate(hidden)], *[(10 + i, plain * (i + 1)) for i in range(20)])
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    assert all(got[10 + i] == "" for i in range(20))
    found = [got[i].split(":")[0] for i in range(4)]
    assert sum(f == k for f, k in zip(found, pii.KINDS)) >= 3


def test_redaction(make_docs, odd_docs, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 5)
    docs = make_docs((1, "mail a@b.co or +1 (988) 555-2485!"), (2, "nothing"), (3, None)).withColumn("spans", F.lit(1))
    got = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert got[1]["text"] == "mail <EMAIL> or <PHONE>!" and got[1]["n_chars"] == 24
    assert got[2]["text"] == "nothing" and got[3]["text"] is None and got[3]["n_chars"] is None
    assert pii.redacted(docs).columns == docs.columns
    assert pii.redacted(odd_docs).count() == odd_docs.count()


def test_held_out_windows_are_tagged_right():
    """Accuracy on made-up spans the tagger has not seen."""
    texts = [f"some words before {i} and then some other words that come after it all" for i in range(400)]
    codes, tags = pii.training_rows(texts, seed=1)
    model = tagger.train(codes[:600], tags[:600], 250, 64, seed=2)
    got, _ = tagger.decode(model, codes[600:])
    inside = tags[600:] > 0
    assert (got == tags[600:]).mean() > 0.97
    assert (got[inside] == tags[600:][inside]).mean() > 0.85


def test_gradients():
    rng = np.random.default_rng(0)
    model = tagger.Tagger(*[p.astype(np.float64) for p in tagger.new_tagger(rng, 4)])
    windows, tags = rng.integers(0, tagger.CODES, (3, 7)), np.zeros((3, 7), int)
    tags[0, 1:4], tags[1, 2] = [1, 2, 2], 3
    _, slope = tagger.gradients(model, windows, tags)
    for p, s in zip(model, slope):
        at = np.unravel_index(np.abs(s).argmax(), s.shape)
        kept, losses = p[at], []
        for step in (0.02, -0.02):
            p[at] = kept + step
            losses.append(tagger.gradients(model, windows, tags)[0])
        p[at] = kept
        assert (losses[0] - losses[1]) / 0.04 == pytest.approx(s[at], rel=0.02, abs=1e-3)


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(3)
    model = tagger.new_tagger(rng, 4)
    windows = rng.integers(0, tagger.CODES, (4, 3))
    tags, _ = tagger.decode(model, windows)
    for row, got in zip(windows, tags):
        losses = {t: tagger.gradients(model, row[None], np.array([t]))[0]
                  for t in np.ndindex(*[tagger.TAGS] * 3)}
        legal = {t: v for t, v in losses.items() if tagger.START[t[0]] == 0
                 and all(tagger.FORBIDDEN[a, b] == 0 for a, b in zip(t, t[1:]))}
        assert losses[tuple(got)] == pytest.approx(min(legal.values()), abs=1e-4)


def test_reconciliation():
    found = pii.reconciled([(0, 0, 10, 1.0), (5, 1, 8, 1.0), (8, 2, 20, 1.0), (8, 2, 20, 2.0), (30, 0, 31, 0.1)])
    assert [(s.start, s.end) for s in found] == [(5, 8), (8, 20), (30, 31)]
