"""Near copies and nearest neighbours among vectors, against all pairs."""

from __future__ import annotations

import brute
import numpy as np
import pyarrow as pa
import pytest

from tallyroom.llm import curves, lattice

SCHEMA = "vec_id long, embedding array<float>, label int"


def near(rng, base, cosine):
    other = rng.standard_normal(len(base))
    other -= other @ base * base / (base @ base)
    return cosine * base / np.linalg.norm(base) + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows, bases = [], rng.standard_normal((60, 64))
    for i in range(500):
        base = bases[i % 60]
        cosine = rng.choice([0.2, 0.9, 0.95, 0.97, 0.99, 1.0])
        rows.append((i, near(rng, base, cosine).astype(np.float32).tolist(), int(i % 60 % 4)))
    rows += [(500 + i, rows[3][1], rows[3][2]) for i in range(40)]
    rows += [(600, rows[3][1], None), (601, None, 1), (602, [0.0] * 64, 1), (603, [float("nan")] * 64, 1),
             (604, [float("inf")] + [1.0] * 63, 1), (605, [None] + [1.0] * 63, 1), (606, [], 1),
             (607, (np.array(rows[3][1]) * 1e-30).tolist(), rows[3][2])]
    return rows


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_copies(spark, vectors):
    df = spark.createDataFrame(vectors, SCHEMA).selectExpr("*", "1 AS copies", "'x' AS rep")
    got = {r["vec_id"]: r for r in lattice.near_copies(df).collect()}
    rows = {i: (np.array(v, dtype=np.float32).astype(float), label) for i, v, label in vectors if usable(v) and label is not None}
    links = dict.fromkeys((i for i, *_ in vectors), 0)
    groups = brute.Groups(links)
    missed = 0
    for i, (v, label) in rows.items():
        for j, (w, other) in rows.items():
            if i < j and label == other and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i] += 1
                links[j] += 1
                groups.join(i, j)
    for i in links:
        missed += links[i] - got[i]["n_links"]
        assert got[i]["n_links"] <= links[i]
        assert got[i]["component_id"] == groups.find(i)
        assert got[i]["kept"] == (groups.find(i) == i)
    assert missed <= 0.005 * sum(links.values())


def test_large_cells_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 8)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, near(rng, base, 0.9999).astype(np.float32).tolist(), 1) for i in range(70)]
    got = lattice.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(69, 0)}


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)) * 2
    first, second = lattice.nearest_e8(x)
    short = [v for v in np.array(np.meshgrid(*[[-1, 0, 1]] * 8)).reshape(8, -1).T
             if (v @ v == 2)] + [np.array(s) / 2 for s in np.array(np.meshgrid(*[[-1, 1]] * 8)).reshape(8, -1).T if np.prod(s) > 0]
    assert len(short) == 240
    for point, row in zip(first / 2, x):
        assert np.allclose(point % 1, point[0] % 1) and point.sum() % 2 == 0
        best = ((point - row) ** 2).sum()
        assert all(((point + s - row) ** 2).sum() >= best - 1e-9 for s in short)
    assert (first != second).any(1).all()


@pytest.mark.parametrize("recall", [0.95, 1.0])
def test_neighbours(spark, vectors, recall):
    df = spark.createDataFrame(vectors, SCHEMA)
    got = curves.nearest(df, every=10, k=7, window=64, recall=recall).collect()
    rows = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in vectors if len(v or []) == 64 and usable(v)}
    found = total = 0
    for q in (i for i in rows if i % 10 == 0):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 8))
        exact = sorted((-(rows[q] @ v), i) for i, v in rows.items() if i != q)
        for r in mine:
            assert r["score"] == pytest.approx(rows[q] @ rows[r["vec_id"]], abs=1e-12)
        order = [(-r["score"], r["vec_id"]) for r in mine]
        assert order == sorted(order)
        total += 7
        found += sum(r["score"] >= -exact[6][0] - 1e-12 for r in mine)
    assert found >= 0.9 * total
    if recall == 1.0:
        assert found == total


def test_few_candidates_and_ties(spark):
    rows = [(20, [1.0, 0.0], 1), (3, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (1, [-1.0, 0.0], 1)]
    got = [tuple(r) for r in curves.nearest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(20, 1, 2, 0.5), (20, 2, 3, 0.5), (20, 3, 1, -1.0)]


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_nothing_usable(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert curves.nearest(df).collect() == []
    got = [tuple(r) for r in lattice.near_copies(df).collect()]
    assert got == [(1, 0, 1, True)] * len(rows)


def test_hilbert_curve_visits_neighbours_in_turn():
    side = np.arange(8)
    cells = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    key = curves.hilbert_key(cells, 3)
    assert sorted(key) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_many_copies_meet_no_window_more_than_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(400)]
    rows += [(700 + i, (np.array(rows[9][1]) * (1 + i * 1e-9)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, classes = curves.classes_of(df.selectExpr("vec_id", "embedding AS vector"), 10, 5)
    assert classes.count() == len({tuple(v) for _, v in rows})
    largest, compare = spark.sparkContext.accumulator(0), curves._compare

    def seen(key, table, k):
        if len(table) > 100:
            largest.add(1)
        return compare(key, table, k)

    monkeypatch.setattr(curves, "_compare", seen)
    monkeypatch.setattr(curves, "ASKERS", 16)
    got = curves.nearest(df, every=10, k=5, window=16, recall=1.0).collect()
    assert largest.value == 0
    x = np.array([v for _, v in rows])
    for q in range(0, 900, 10):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and q not in {m[1] for m in mine}
        exact = curves._inner(x[q], x)
        order = [int(i) for i in np.lexsort((np.arange(900), -exact)) if i != q][:5]
        assert [m[1] for m in mine] == order


def test_overlapping_windows_compare_a_pair_once(spark, monkeypatch):
    x = np.random.default_rng(3).standard_normal((600, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    pairs, compare = spark.sparkContext.accumulator(0), curves._compare

    def counted(key, table, k):
        asks = sum(table["asks"].to_pylist())
        pairs.add(asks * (len(table) - asks))
        return compare(key, table, k)

    monkeypatch.setattr(curves, "_compare", counted)
    monkeypatch.setattr(curves, "ASKERS", 16)
    got = curves.nearest(df, every=10, k=5, window=20, recall=0.95).collect()
    assert 0 < pairs.value <= 600 * 60
    found = sum(r["vec_id"] in np.argsort(-np.where(np.arange(600) == r["query_id"], -np.inf, x @ x[r["query_id"]]))[:5] for r in got)
    assert len(got) == 300 and found >= 0.95 * 300


@pytest.mark.parametrize("reach", [0, 1, 3, 40])
def test_blocks_hold_every_pair_within_reach(reach):
    rng = np.random.default_rng(reach)
    x = rng.standard_normal((500, 6))
    at = (rng.random((500, 3)) ** 2 * 40).astype(np.int64)
    queries = np.arange(0, 500, 7)
    asked_at = np.maximum(at[queries] - 1, 0)
    sizes = [np.stack([np.bincount(a[:, c], minlength=40) for c in range(3)]) for a in (at, asked_at)]
    layout = curves.Layout(*sizes, reach, block=30, askers=11)
    assert layout.whole == (reach > 3)
    held, asking = layout.groups(at, np.arange(500), False).to_pylist(), layout.groups(asked_at, queries, True).to_pylist()
    near = (np.abs(asked_at[:, None] - at[None]) <= reach).any(2)
    found, met = {int(q): set() for q in queries}, np.zeros(near.shape, dtype=int)
    for group in {g for gs in held + asking for g in gs}:
        i, j = ([n for n, gs in enumerate(side) if group in gs] for side in (asking, held))
        met[np.ix_(i, j)] += 1
        side = [(n, x[n], [n, n + 1000], at[n], False) for n in j] + [(queries[n], x[queries[n]], None, asked_at[n], True) for n in i]
        columns = list(zip(*side))
        table = pa.table({
            "vec_id": pa.array(columns[0], pa.int64()), "vector": pa.array(columns[1], pa.list_(pa.float64())),
            "ids": pa.array(columns[2], pa.list_(pa.int64())), "at": pa.array(columns[3], pa.list_(pa.int64())), "asks": columns[4],
        })
        for row in curves._compare((layout.of(group), reach), table, 5).to_pylist():
            found[row["query_id"]] |= {(h["far"], h["vec_id"]) for h in row["near"]}
    assert (met[near] > 0).all() and met.max() <= (1 if layout.whole else 3)
    for n, q in enumerate(queries):
        exact = -curves._inner(x[q], x)
        every = sorted((exact[j], j + copy) for j in np.flatnonzero(near[n]) for copy in (0, 1000))
        assert sorted(found[q])[:5] == every[:5]


def test_best_rows_by_bounds_are_those_of_exact_products():
    rng = np.random.default_rng(6)
    plain = rng.standard_normal((3000, 8))
    copies = plain.copy()
    copies[::2] = plain[0] * (1 + 1e-8 * rng.standard_normal((1500, 8)))
    lengths = plain * 10.0 ** rng.integers(-60, 60, (3000, 1))
    for rows in (plain, copies, lengths, plain * 1e-150, np.eye(8)[rng.integers(0, 8, 3000)], -np.ones((3000, 1))):
        ids = np.arange(3000)
        batch = pa.RecordBatch.from_arrays([pa.array(list(rows)), pa.array(ids), pa.array([[i] for i in ids])], names=["vector", "vec_id", "ids"])
        best = curves._best(rows[:300], ids[:300], curves.Rows.of(batch), 9)
        for query, near in zip(rows, best["near"].to_pylist()):
            exact = curves._inner(query, rows)
            order = np.lexsort((ids, -exact))[:9]
            assert [(h["far"], h["vec_id"], h["home"]) for h in near] == [(-exact[i], i, i) for i in order]
