"""Piece segmentations and training order: brute force and exact round trips."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import order, pieces, tokens


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as file:
        return pieces.load(file.read())


def lattice_text(text):
    return pieces.SPACE + text.replace(pieces.SPACE, pieces._SELF).replace(" ", pieces.SPACE)


def all_paths(model, text):
    into = pieces.edges(model, text)
    paths = [(0.0, len(text))]
    done = []
    while paths:
        score, at = paths.pop()
        if at == 0:
            done.append(score)
        else:
            paths += [(score + s, a) for a, s, _ in into[at]]
    return sorted(done, reverse=True)


@pytest.mark.parametrize("text", ["the thing of", "a  b", " lead", "trail  ", "", "x", "ab\ncd", "▁▁ ▁", "日本 é", "in the inn"])
@pytest.mark.parametrize("short", [True, False])
def test_best_paths_against_all(model, text, short, monkeypatch):
    if not short:
        monkeypatch.setattr(pieces, "UNIT", 0)
    (ids, score, others), = pieces.encode_all(model, [text], 5)
    wanted = all_paths(model, lattice_text(text))
    assert score == pytest.approx(wanted[0])
    assert [s for s, _ in others] == pytest.approx(wanted[:5])
    assert others[0][1] == []
    assert pieces.decode(model, ids.tolist()) == text
    assert len({str(c) for _, c in others}) == len(others)


def test_whole_search_over_a_text(model):
    """The search over the units that can differ finds what one over the whole text does."""
    text = "erinan thnded of erble anre erhere for tionan"
    into = pieces.edges(model, lattice_text(text))
    whole = [s for s, _ in pieces.search(into, pieces.forward(into), 6)]
    (_, _, others), = pieces.encode_all(model, [text], 6)
    assert [s for s, _ in others] == pytest.approx(whole)


def test_long_and_short_units_agree(model, small_docs, monkeypatch):
    texts = [r["text"] for r in small_docs.limit(30).collect()]
    first = [(i.tolist(), s) for i, s, _ in pieces.encode_all(model, texts, 2)]
    monkeypatch.setattr(pieces, "UNIT", 3)
    assert [(i.tolist(), s) for i, s, _ in pieces.encode_all(model, texts, 2)] == first


def test_units_are_segmented_in_bounded_memory(model, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [pieces.SPACE + "".join(rng.choice([*"etaoinshré"], n)) for n in rng.integers(0, 31, 40_000)]

    def segmented(texts):
        tracemalloc.start()
        try:
            out = pieces.Segmented(model, texts)
            return out, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (_, some), (whole, all_of_them) = segmented(texts[:20_000]), segmented(texts)
    # What is returned grows, a few numbers a unit; the work on them does not.
    assert all_of_them - some < 20_000 * 400
    monkeypatch.setattr(pieces, "TOGETHER", 100)
    parted = pieces.Segmented(model, texts[:500])
    size = whole.offsets[500]
    assert (parted.offsets == whole.offsets[:501]).all() and (parted.ids == whole.ids[:size]).all()
    assert (parted.scores == whole.scores[:500]).all() and (parted.losses == whole.losses[:500]).all()


@pytest.mark.parametrize("which", ["small_docs", "odd_docs", "no_docs"])
def test_round_trip(which, request):
    docs = request.getfixturevalue(which).withColumn("score", F.lit("clash"))
    rows = pieces.encoded(docs)
    assert rows.columns == [*(c for c in docs.columns if c != "score"), "ids", "score", "others"]
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["text"]) for r in pieces.decoded(rows).collect()) == texts
    digest = pieces.digest(docs).collect()
    assert len(digest) == len(texts) and all(r["decoded"] for r in digest)
    for r in digest:
        assert r["scores"] == sorted(r["scores"], reverse=True) and r["scores"][0] == r["score"]


def test_changes_give_the_text_as_well(model):
    text = "reshon edlyti anor"
    (_, _, others), = pieces.encode_all(model, [text], 4)
    for _, changed in others[1:]:
        for _, unit, ids in changed:
            assert " " + pieces.decode(model, [model.known[pieces.SPACE][1], *ids])[1:] == unit.replace(pieces.SPACE, " ")


def test_token_pieces_encode_like_the_whole(small_docs):
    encoder = tokens.encoding(tokens.load())
    for r in small_docs.limit(40).collect():
        whole = encoder.encode_ordinary(r["text"])
        assert np.concatenate([np.array(encoder.encode_ordinary(p)) for p in tokens.pieces(r["text"], 50)]).tolist() == whole


@pytest.mark.parametrize("count", [1, 2, 3, 10, 64, 1000, 1025])
def test_permutation(count):
    got = order.permuted(np.arange(count), count, key=5)
    assert sorted(got) == list(range(count))
    if count >= 64:
        assert (order.permuted(np.arange(count), count, key=6) != got).any()
        assert np.mean(np.abs(np.diff(got)) < count / 50) < 0.2


@pytest.mark.parametrize("which", ["small_docs", "odd_docs"])
def test_training_order(spark, which, request, tmp_path):
    docs = request.getfixturevalue(which)
    folder, how = str(tmp_path / "shards"), {"length": 64, "shard_slots": 16}
    index = {r["slot"]: r for r in order.write_training_order(docs, folder, key=3, **how).collect()}
    slots = {r["slot"]: np.frombuffer(r["ids"], "<u2") for r in order.read_slots(spark, folder, **how).collect()}
    assert sorted(slots) == sorted(index) == list(range(len(index)))
    encoder = tokens.encoding(tokens.load())
    # Sequences in the order they were packed: undo the permutation.
    place = order.permuted(np.arange(len(slots)), len(slots), 3)
    stream, starts = [], []
    for slot in place:
        assert index[slot]["shard"] == slot // 16
        for doc_id, start in zip(index[slot]["doc_ids"], index[slot]["starts"]):
            starts.append((doc_id, len(stream) + start))
        stream += slots[slot].tolist()
    kept = np.array(stream)
    texts, current = [], []
    for i in kept[kept != order.FILL].tolist():
        if i == order.END:
            texts.append(encoder.decode(current))
            current = []
        else:
            current.append(i)
    assert sorted(texts) == sorted(r["text"] or "" for r in docs.collect()) and not current
    assert {str(d) for d, _ in starts} == {str(r["doc_id"]) for r in docs.collect()}
    later = order.read_slots(spark, folder, first=21, **how).collect()
    assert sorted(r["slot"] for r in later) == list(range(21, len(slots)))
    sizes = {p.stat().st_size for p in (tmp_path / "shards").iterdir() if p.suffix == ".u16"}
    assert max(sizes) == 16 * 64 * 2


def test_same_key_same_order(small_docs, no_docs):
    rows = [sorted(order.training_order(small_docs, key=k, length=128).collect()) for k in (1, 1, 2)]
    assert rows[0] == rows[1] != rows[2]
    assert order.training_order(no_docs).collect() == []
