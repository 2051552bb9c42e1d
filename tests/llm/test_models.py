"""Quality votes, page languages and language-model scores."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import attention, langid, lm, quality


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("score", F.lit("clash"))
    rows = quality.scored(docs, labels).join(labels, "doc_id").collect()
    assert {bool(r["held_out"]) for r in rows} == {True, False}
    assert all(r["held_out"] == (brute.remainder(r["doc_id"], 3) == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_votes_are_those_of_exact_neighbours(small_docs, labels):
    model = quality.fit(small_docs, labels)
    rows = quality.scored(small_docs, labels).orderBy("doc_id").limit(40).collect()
    for r in rows:
        import pyarrow as pa

        (texts,) = quality.groups(pa.array([r["text"]]))
        vector = model.latent(quality.term_counts(texts))[0]
        cosine = sorted(((float(vector @ row), label) for row, label in zip(model.rows, model.labels)), reverse=True)
        weight = [(max(c, 0) ** quality.SHARPNESS, y) for c, y in cosine[: quality.NEIGHBOURS]]
        assert r["score"] == pytest.approx(sum(w * y for w, y in weight) / sum(w for w, _ in weight), abs=1e-3)


def test_odd_texts_get_scores(odd_docs, labels, no_docs, small_docs, make_docs):
    some = labels.limit(0)
    assert {r["score"] for r in quality.scored(odd_docs, some).collect()} == {0.5}
    assert quality.scored(no_docs, labels).collect() == []
    both = small_docs.unionAll(make_docs((10**9, None), (10**9 + 1, "")))
    share = quality.fit(both, labels).labels.mean()
    got = [r for r in quality.scored(both, labels).collect() if r["doc_id"] >= 10**9]
    assert [r["score"] for r in got] == [pytest.approx(share)] * 2


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def test_page_languages(pages, small_docs):
    got = langid.languages(pages, small_docs).collect()
    assert len(got) == pages.count()
    assert np.mean([r["lang"] == r["declared"] for r in got]) > 0.95
    assert all(0 <= r["posterior"] <= 1 + 1e-9 for r in got)


def test_evidence_other_than_text_decides_short_pages(spark, small_docs):
    rows = [(i, "https://news.example.de/a", "<html lang='de'><p>die und der das ist ein nicht mit auf</p></html>")
            for i in range(30)]
    rows += [(100, "https://news.example.de/b", "<html><body>42</body></html>"), (101, None, None), (102, "http://[x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("clash"))
    got = {r["page_id"]: r for r in langid.languages(df, small_docs).collect()}
    assert got[100]["lang"] == "de" and got[100]["declared"] == "" and got[100]["host"] == "news.example.de"
    assert got[101]["host"] == "" and got[102]["host"] == "[x"
    assert got[0]["lang"] == "de"


def test_no_languages_and_no_pages(pages, no_docs, small_docs):
    got = langid.languages(pages, no_docs).collect()
    assert len(got) == pages.count() and {(r["lang"], r["posterior"]) for r in got} == {(None, 0.0)}
    assert langid.languages(pages.limit(0), small_docs).collect() == []


@pytest.mark.parametrize("html,wanted", [
    ("<p>A&amp;B</p>", "a&b"), ("<script>x<y</script>hi", "hi"), ("<nav>menu</nav>x<!-- no -->y", "x y"),
    ("plain", "plain"), ("<style>never closed", ""), ("a<b", "a<b"),
])
def test_visible_text(html, wanted):
    assert " ".join(langid.visible_text(html).split()) == wanted


def test_declared_language(spark):
    pages = ['<!DOCTYPE html><HTML class=x LANG="En-us">', "<html xml:lang=fr>", "<html lang='de'", "<p lang=en>", "<html lang=x>"]
    df = spark.createDataFrame([(p,) for p in pages], "h string").select(langid.declared_language(F.col("h")))
    assert [r[0] for r in df.collect()] == ["en", "", "de", "", ""]


@pytest.fixture
def quick(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 30)


@pytest.mark.parametrize("which", ["small_docs", "odd_docs", "no_docs"])
@pytest.mark.parametrize("frequent", [lm.FREQUENT, 50])
def test_base_scores(which, frequent, request, quick, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = request.getfixturevalue(which).withColumn("score", F.lit("clash"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted = brute.base_scores(rows)
    got = lm.scored(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        tokens, known, total, base = wanted[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (r["doc_id"] is not None and brute.remainder(r["doc_id"], 7) == 2)
        assert np.isfinite(r["score"]) and r["score"] < 0


def test_where_words_are_looked_up_changes_no_score(small_docs, quick, monkeypatch):
    scores = []
    for frequent in (lm.FREQUENT, 50):
        monkeypatch.setattr(lm, "FREQUENT", frequent)
        scores.append({r["doc_id"]: r["score"] for r in lm.scored(small_docs).collect()})
    assert all(scores[0][i] == pytest.approx(scores[1][i], rel=1e-5) for i in scores[0])


def test_windows_tell_every_id_once():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 31, 32, 33, 200, 1, 95])
    stream = rng.integers(0, attention.SIZE, sizes.sum())
    first = np.cumsum(sizes) - sizes
    ids, told, at = attention.windows(stream, first, sizes)
    assert sorted(at[at >= 0]) == list(range(len(stream)))
    assert (told[at >= 0] == stream[at[at >= 0]]).all()
    for row, places in zip(ids, at):
        place = places[0]
        text = np.searchsorted(first, place, "right") - 1
        for j, got in enumerate(row):
            k = place - attention.CONTEXT + j - 1
            wanted = attention.START if k == first[text] - 1 else stream[k] if first[text] <= k < first[text] + sizes[text] else -1
            assert got == wanted


def test_model_is_causal_and_sums_to_one():
    rng = np.random.default_rng(0)
    model = attention.new_model(rng.integers(1, 50, attention.SIZE), 1)
    ids = rng.integers(0, attention.SIZE, (1, attention.WINDOW))
    every = np.arange(attention.SIZE)
    told = np.zeros((attention.SIZE, attention.SCORED), dtype=int)
    told[:, 7] = every
    rows = np.repeat(ids, attention.SIZE, axis=0)
    chance = np.exp(attention.log_probabilities(model, rows, told)[:, 7].astype(float))
    assert chance.sum() == pytest.approx(1, abs=1e-4)
    later = ids.copy()
    later[0, attention.CONTEXT + 8 :] = 5
    same = [attention.log_probabilities(model, x, told[:1])[0, :8] for x in (ids, later)]
    assert np.allclose(*same, atol=1e-5)


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = attention.Model(*[p.astype(np.float64) for p in attention.new_model(rng.integers(1, 50, attention.SIZE), 1)])
    ids, told, at = attention.windows(rng.integers(0, attention.SIZE, 80), np.array([0]), np.array([80]))
    _, slope = attention.gradients(model, ids, told, at >= 0)
    for p, s in zip(model, slope):
        place = np.unravel_index(np.abs(s).argmax(), s.shape)
        kept, losses = p[place], []
        for step in (1e-4, -1e-4):
            p[place] = kept + step
            losses.append(attention.gradients(model, ids, told, at >= 0)[0])
        p[place] = kept
        assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(s[place], rel=1e-3)


def test_members_of_all_classes_are_told_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    model = attention.new_model(rng.integers(1, 50, attention.SIZE), 1)
    stream = rng.choice(np.array([3, 40, 41, 500, 1023]), 200)
    ids, told, at = attention.windows(stream, np.array([0]), np.array([200]))
    calls, softmax = [], attention._softmax
    monkeypatch.setattr(attention, "_softmax", lambda x: calls.append(x.shape) or softmax(x))
    loss, slope = attention.gradients(model, ids, told, at >= 0)
    # Shares of attention and classes: not one more for the members of each class that occurs.
    assert len(calls) == 2
    assert loss == pytest.approx(-attention.log_probabilities(model, ids, told)[at >= 0].mean(), rel=1e-4)
    absent = np.setdiff1d(np.arange(attention.SIDE), stream // attention.SIDE)
    assert (slope.member[absent] == 0).all() and (slope.member_bias[absent] == 0).all()
    # Over a class's members what is told weighs against what is expected.
    assert np.abs(slope.member_bias.sum(1)).max() < 1e-6 and abs(slope.out_bias.sum()) < 1e-6


def test_training_lowers_the_loss_on_other_text():
    rng = np.random.default_rng(2)
    cycle = np.tile(np.arange(40), 400)
    noise = rng.random(len(cycle)) < 0.1
    stream = np.where(noise, rng.integers(0, 40, len(cycle)), cycle)
    counts = np.bincount(stream, minlength=attention.SIZE)
    ids, told, at = attention.windows(stream, np.array([0]), np.array([len(stream)]))
    model = attention.new_model(counts.astype(float), 1)
    trained = attention.train(model, ids[:400], told[:400], at[:400] >= 0, 150, 32, 1)
    before, after = (attention.log_probabilities(m, ids[400:], told[400:])[at[400:] >= 0].mean() for m in (model, trained))
    assert after > before + 1.5


def test_every_subword_of_every_text_is_learned_from(spark, make_docs, quick, monkeypatch):
    rng = np.random.default_rng(3)
    names = ["alder", "birch", "cedar", "maple", "rowan", "willow"]
    rows = [(i, " ".join(rng.choice(names, 40 if i % 9 else 5000)) + " quince") for i in range(90)]
    docs = make_docs(*rows).selectExpr("doc_id AS row", "true AS learned", "text").repartition(3)
    data = lm.tokens.load()
    encoder = lm.tokens.encoding(data)
    ids = {i: [*lm.tokens.encode(encoder, " " + text).tolist(), 50256] for i, text in rows}
    cut = docs.selectExpr("row", "row % 9 = 1 AS tuning", "text")
    cut = cut.mapInArrow(lm._cut(spark.sparkContext.broadcast(data)), "stretch long, tuning boolean, ids binary")
    counts = np.bincount(np.concatenate(list(ids.values())), minlength=50257)
    assert (lm._totals(cut, 50257, lm._told) == counts).all()
    # All windows, in one task or in many that are averaged.
    opens = lm.opening_ids(data)
    chosen = lm.model_ids(cut, opens)
    common = np.flatnonzero(counts)
    assert (chosen.rare[common] == 0).all() and len(set(chosen.own[common])) == len(common)
    assert ((chosen.own < chosen.opening * attention.SIDE) == opens).all()
    for kind in (opens, ~opens):
        assert np.exp(chosen.rare[kind & (chosen.rare < 0)].astype(float)).sum() == pytest.approx(1, abs=1e-4)
    windows = sum(-(-len(x) // attention.SCORED) for x in ids.values())
    for tasks, rounds in ((1, 1), (3, 4)):
        parted = cut.selectExpr(f"CAST(pmod(stretch, {rounds}) AS int) AS round", "ids")
        model, seen = lm.learned_model(parted, chosen, tasks, rounds)
        assert seen >= windows and seen % windows == 0
        stream = chosen.own[np.array(ids[0])]
        mine, told, at = attention.windows(stream, np.array([0]), np.array([len(stream)]))
        fresh = attention.new_model(chosen.sizes, 1)
        before, after = (attention.log_probabilities(m, mine, told)[at >= 0].mean() for m in (fresh, model))
        assert after > before + 0.1


class CountingEncoder:
    """An encoder that counts the texts it encodes."""

    def __init__(self, encoder):
        self.encoder, self.calls = encoder, 0

    def __getattr__(self, name):
        return getattr(self.encoder, name)

    def encode_ordinary(self, text):
        self.calls += 1
        return self.encoder.encode_ordinary(text)


def test_distinct_words_are_encoded_in_one_text():
    encoder = CountingEncoder(lm.tokens.encoding(lm.tokens.load()))
    odd = ["a\u3000", "\u00a0", "\u2003\u2003", "x\u0085y", "\x1cq"]
    found = ["it's", "'s", "Ärger", "12", "!?", "z" * 300, "naïve", "...", "ok", "東京", "it's"]
    plain = lm.pa.array([" ".join(found), "", "  " + " ".join(found[::-1]) + "\t"], lm.pa.large_string())
    for column, calls in ((plain, 1), (lm.pa.array([" ".join(odd + found), " ".join(odd)], lm.pa.large_string()), 1 + len(odd))):
        (t,) = lm.groups(column)
        encoder.calls = 0
        got = lm.streams(encoder, t)
        assert encoder.calls == calls
        wanted = [re.findall(r"[^ \t]+", x) for x in column.to_pylist()]
        ids = [[encoder.encoder.encode_ordinary(" " + w) for w in words] + [[50256]] for words in wanted]
        assert got.ids.tolist() == [i for text in ids for word in text for i in word]
        assert got.word_start.tolist() == np.cumsum([0] + [len(word) for text in ids for word in text])[:-1].tolist()
        assert got.word_text.tolist() == [i for i, text in enumerate(ids) for _ in text]
        same = {}
        for word, hash_ in zip([w for text in wanted for w in [*text, None]], got.word_hash.tolist()):
            assert same.setdefault(word, hash_) == hash_
        assert len(set(same.values())) == len(same)


def test_words_of_bytes_that_are_no_text_stay_apart():
    data = b"a\xff bb\xfea\xff a\xfe"
    column = lm.pa.Array.from_buffers(
        lm.pa.large_string(), 2, [None, lm.pa.py_buffer(np.array([0, 5, len(data)])), lm.pa.py_buffer(data)]
    )
    got = lm.streams(lm.tokens.encoding(lm.tokens.load()), next(lm.groups(column)))
    ends = got.word_hash[np.append(np.diff(got.word_text) > 0, True)]
    assert len(set(got.word_hash.tolist())) == len(got.word_hash) - 1 and len(set(ends.tolist())) == 1


def test_stored_subwords_are_read_as_they_were_coded(monkeypatch):
    monkeypatch.setattr(lm, "CODED_BYTES", 10)
    monkeypatch.setattr(lm, "_HASHED", 3)
    data = lm.tokens.load()
    column = lm.pa.array(["Some words, some words", "", "extraordinarily long", None, "end"], lm.pa.large_string())
    (whole,) = [lm.streams(lm.tokens.encoding(data), t) for t in lm.groups(column)]
    rows = lm.pa.RecordBatch.from_arrays([lm.pa.array(range(5)), column], names=["row", "text"])
    sent = type("Sent", (), {"value": data})
    (coded,) = lm._coding(sent)(iter([rows]))
    parts = list(lm.stored_streams(coded["ids"], lm.opening_ids(data)))
    assert coded["row"].to_pylist() == list(range(5)) and len(parts) > 1
    for field in ("ids", "text_size", "word_hash"):
        assert (np.concatenate([getattr(s, field) for _, s in parts]) == getattr(whole, field)).all()
    assert (np.concatenate([s.word_text + first for first, s in parts]) == whole.word_text).all()


def test_texts_are_read_once(spark, make_docs, quick):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    docs = make_docs(*[(i, f"word{i} and other words " * 5) for i in range(60)])
    docs = docs.select("doc_id", counted.asNondeterministic()("text").alias("text"))
    assert len(lm.scored(docs).collect()) == 60
    assert read.value == 60


def test_learning_gets_no_new_pages():
    code = """
import resource, numpy as np
from tallyroom.llm import attention, lm
rng = np.random.default_rng(1)
stream = rng.integers(0, attention.SIZE, 128 * 32)
ids, told, at = attention.windows(stream, np.array([0]), np.array([len(stream)]))
[_ for _ in lm._summed("n", 9, None)(iter([]))]
mine = attention.learner(attention.new_model(np.bincount(stream, minlength=attention.SIZE), 1))
for n in range(1, 13):
    if n == 3:
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    mine.learn(n, 0.1, ids, told, at >= 0)
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / 10)
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(run.stdout) < 200


def test_mixture_sums_to_at_most_one_over_words():
    data = lm.tokens.load()
    encoder = lm.tokens.encoding(data)
    heads = [w for w in "the of and to in is was for that with on as by it at from his he an are were which this be or had not but her they have one".split()]
    tails = [c for c in "! # % & ( ) * + , - . / : ; < = > ? @ [ ] ^ _ ` { | } ~ \" $ .. --".split()]
    first, after = ([encoder.encode_ordinary(x) for x in xs] for xs in ([" " + w for w in heads], tails))
    assert len(heads) == len(tails) == attention.SIDE and {len(x) for x in first + after} == {1}
    # Nothing but these is likely. A word follows 'the' for sure, a tail any other head.
    zero = attention.new_model(np.ones(attention.SIZE), 1)
    model = attention.Model(*[np.zeros_like(p) for p in zero])
    model.out_bias[2:] = -70
    model.embed[: attention.SIDE, 0] = -1
    model.embed[[0, attention.START], 0] = 1
    model.out[0, 0], model.out[0, 1] = 2, -2
    own = np.full(50257, attention.SIZE - 1)
    own[np.ravel(first)], own[np.ravel(after)] = np.arange(32), attention.SIDE + np.arange(32)
    words = heads + [h + t for h in heads for t in tails]
    texts = lm.pa.array(["the " + w for w in words], lm.pa.large_string())
    scorer = lm.Scorer(model, own, np.zeros(50257, np.float32), 1, 0.4, np.empty(0), np.empty(0), 100, 1)
    log_model = np.concatenate([
        lm.word_log_probabilities(scorer, s)[(np.diff(s.word_text, prepend=-1) == 0).nonzero()[0][::2]]
        for s in (lm.streams(encoder, t) for t in lm.groups(texts))
    ])
    assert len(log_model) == len(words)
    told = np.exp(log_model.astype(float)).sum()
    assert 0.1 < told <= 1 + 1e-5
    counts = np.bincount([0, 1, 5] * 33 + [7], minlength=len(words))
    assert (10 ** scorer.mixed(counts, log_model)).sum() <= 1 + 1e-5
