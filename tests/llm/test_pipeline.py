"""The pipeline: each stage against a plain version, and the whole."""

from __future__ import annotations

import brute
import corpus_pipeline
import pytest

from tallyroom.llm import lm, pieces, pii


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_stay(stages):
    for table in stages[1:-1]:
        assert table.columns == stages[0].columns


def test_quality_keeps_clean_documents(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r["doc_id"] for r in stages[1].collect()}
    wrong = [r for r in labels.join(stages[0], "doc_id").collect() if (r["doc_id"] in kept) != (r["quality"] == 1)]
    assert len(wrong) <= 0.05 * labels.count()


def test_one_of_each_group(stages):
    rows = {r["doc_id"]: brute.shingles(r["text"]) for r in stages[1].collect()}
    found = brute.Groups(rows)
    for i, x in rows.items():
        for j, y in rows.items():
            if i < j and x and y and 100 * len(x & y) >= 75 * len(x | y):
                found.join(i, j)
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(i for i in rows if found.find(i) == i)


def test_no_pattern_is_left(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    assert before.keys() == after.keys()
    assert all(not brute.personal(t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not pii.window_starts(t))


def test_mix_is_near_its_targets(stages):
    sizes, taken = {}, {}
    for table, into in ((stages[3], sizes), (stages[4], taken)):
        for r in table.collect():
            into[r["source"]] = into.get(r["source"], 0) + len(brute.words(r["text"]))
    wanted = brute.targets(sizes)
    assert sum(abs(taken.get(s, 0) - t) for s, t in wanted.items()) <= 0.5 * sum(wanted.values())


def test_pieces_decode(spark, stages):
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    got = pieces.decoded(stages[5]).collect()
    assert len(got) == stages[4].count() and all(r["text"] == texts[r["doc_id"]] for r in got)


def test_registered(spark, sf_dir, stages):
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert __spark_entry__.queries()["pipeline"](spark, sf_dir).count() == stages[5].count()


def test_stages_take_odd_and_no_documents(spark, sf_dir, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 5)
    monkeypatch.setattr(lm, "STEPS", 5)
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf_dir).count() <= 3 * docs.count()
