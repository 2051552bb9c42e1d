"""Approximate nearest neighbours by shifted Hilbert curves over projected vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from tallyroom.llm.lattice import _mix, matrix
from tallyroom.llm.tables import stored, usable_vector

#: Curves, projected dimensions and bits of each: a key has DIMS * BITS = 63 bits at most.
CURVES, DIMS, BITS = 4, 7, 9
#: Rows of a key window, most windows of a curve, rows sampled to cut the windows,
#: queries sampled to measure recall, and queries compared with a block of rows at once.
WINDOW, WINDOWS, CUT_ROWS, TRIAL_QUERIES, ASKERS = 2048, 4096, 100_000, 96, 16384
#: Queries and rows whose products are made at once, and pairs.
TILE, PAIRS = (256, 2048), 16384
#: More than a product of single precision can lose below its smallest numbers.
TINY = np.float32(1e-35)
#: Slices in which the copies of one vector are collected.
SLICES = 64


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (n, dims) along a Hilbert curve of 2**bits cells a side:
    the points are turned into the curve's axes bit by bit from the top, then the bits
    of all dimensions are read in turn."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        low = q - np.uint64(1)
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        turn = np.where((x[-1] & q) != 0, turn ^ (q - np.uint64(1)), turn)
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(level)) & np.uint64(1))
    return key.view(np.int64)


def curve_keys(vectors: np.ndarray, curve: int, longest: float, query: bool, seed: int) -> np.ndarray:
    """Keys on one curve. Candidates get one more component that brings all to the length
    of the longest, queries are scaled to it, so the nearest are those of largest inner
    product; then both are projected, shifted at random and cut into cells."""
    norm = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    if query:
        lifted = np.hstack([vectors / norm * longest, np.zeros_like(norm)])
    else:
        lifted = np.hstack([vectors, np.sqrt(np.maximum(longest**2 - norm**2, 0.0))])
    rng = np.random.default_rng([seed, curve, vectors.shape[1]])
    plane, _ = np.linalg.qr(rng.standard_normal((lifted.shape[1], min(DIMS, lifted.shape[1]))))
    spread = longest * 4 / np.sqrt(lifted.shape[1]) if lifted.shape[1] > DIMS else longest
    at = (lifted @ plane) / (2 * spread) + 0.5
    at = (at + rng.uniform(0, 0.5, at.shape[1])) / 1.5
    return hilbert_key(np.clip(np.floor(at * 2**BITS), 0, 2**BITS - 1), BITS)


def _inner(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products with a query, or with one for each row, summed in the order of the
    components, whatever the block."""
    total = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        total += rows[:, k] * query[..., k]
    return total


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, … of each, ``count`` of them, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _true(flags: np.ndarray) -> np.ndarray:
    """Where flags, of which few are set, are: eight at a time first."""
    flags = flags.ravel()
    eights = flags[: len(flags) // 8 * 8]
    some = np.flatnonzero(eights.view(np.uint64) != 0)
    at = np.flatnonzero(eights.reshape(-1, 8)[some])
    return np.concatenate([some[at >> 3] * 8 + (at & 7), len(eights) + np.flatnonzero(flags[len(eights) :])])


def _falling(who: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The order by who, then by falling number in single precision."""
    bits = number.view(np.int32).astype(np.int64)
    return np.argsort((who << 32) - (bits ^ ((bits >> 63) & 0x7FFFFFFF)))


def _single(vectors: np.ndarray, scale: np.ndarray, margin: float) -> np.ndarray:
    """Vectors over ``scale`` in single precision and, last, ``margin`` times their length."""
    x = vectors / scale
    return np.hstack([x, margin * np.sqrt((x * x).sum(1, keepdims=True))]).astype(np.float32)


class Rows:
    """Rows of a block, or those from ``low`` to ``high``: vectors, the same in single
    precision, the ids that name their classes, where the ids of a class begin and end, and
    all ids. The last single component is more than what single precision takes from a
    product with a query of length 1."""

    def __init__(self, *held: np.ndarray):
        self.vectors, self.single, self.homes, self.edges, self.members = held

    @classmethod
    def of(cls, table: pa.RecordBatch | pa.Table) -> Rows:
        vectors, homes, ids = (table[c].combine_chunks() if isinstance(table, pa.Table) else table[c] for c in ("vector", "vec_id", "ids"))
        x = matrix(vectors)
        single = _single(x, np.abs(x).max(initial=0), (x.shape[1] + 4) * 2.0**-23) if len(x) else x
        return cls(x, single, homes.to_numpy(), ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy())

    def cut(self, low: int, high: int) -> Rows:
        held = (x[low:high] for x in (self.vectors, self.single, self.homes))
        return Rows(*held, self.edges[low : high + 1], self.members)

    def products(self, queries: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = (slice(s, s + PAIRS) for s in range(0, len(i), PAIRS))
        return np.concatenate([np.empty(0), *(_inner(queries[i[p]], self.vectors[j[p]]) for p in parts)])


def _best_of(queries: np.ndarray, rows: Rows, k: int, seen) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row), by query, among which are each query's k best rows of those it has
    ``seen``. Rows are met in tiles and in single precision first; a pair whose product
    cannot reach k products already found goes no further. Where many are left, as equal
    products leave them, exact ones choose k, ties to the smaller id."""
    n, scale = len(queries), np.abs(queries).max(1, keepdims=True)
    asking = _single(queries, scale, 1.0)
    who, what = np.empty(0, np.int64), np.empty(0, np.int64)
    most, least = np.empty(0, np.float32), np.empty(0, np.float32)
    edge, room = np.full(n, -np.inf, np.float32), np.empty(n * TILE[1], np.float32)
    at, step, new = 0, min(TILE[1], 4 * k), 0
    while at < len(rows.single):
        tile = rows.single[at : at + step]
        products = np.matmul(asking, tile.T, out=room[: n * len(tile)].reshape(n, len(tile)))
        hit = _true(products >= edge[:, None])
        i, j = np.divmod(hit, len(tile))
        if seen is not None:
            keep = seen(i, j + at)
            hit, i, j = hit[keep], i[keep], j[keep]
        upper = products.ravel()[hit]
        lower = upper - np.float32(2.5) * asking[i, -1] * tile[j, -1] - TINY
        who, what = np.concatenate([who, i]), np.concatenate([what, j + at])
        most, least = np.concatenate([most, upper]), np.concatenate([least, lower])
        at, step, new = at + len(tile), min(TILE[1], 2 * step), new + len(i)
        if new > max(n * k, len(who) // 2) or at >= len(rows.single):
            order = _falling(who, least)
            who, what, most, least, new = who[order], what[order], most[order], least[order], 0
            first = np.searchsorted(who, np.arange(n + 1))
            full = np.flatnonzero(np.diff(first) >= k)
            edge[full] = least[first[full] + k - 1] - TINY
            keep = most >= edge[who]
            who, what, most, least = who[keep], what[keep], most[keep], least[keep]
            if len(who) > 4 * n * k:
                exact = rows.products(queries, who, what)
                order = np.lexsort((rows.homes[what], -exact, who))
                order = order[np.arange(len(order)) - np.searchsorted(who, who[order]) < k]
                who, what, most, least = who[order], what[order], most[order], least[order]
    return who, what


def _best(queries: np.ndarray, query_ids, rows: Rows, k: int, seen=None) -> pa.RecordBatch:
    """Each query's k best ids of a block of classes, of those it has ``seen`` if not of all,
    one row a query, by exact products."""
    near, counts = [], [np.zeros(1, np.int64)]
    for s in range(0, len(queries), TILE[0]):
        part = queries[s : s + TILE[0]]
        i, j = _best_of(part, rows, k, seen and (lambda i, j: seen(s + i, j)))
        count = rows.edges[j + 1] - rows.edges[j]
        exact, query = np.repeat(rows.products(part, i, j), count), np.repeat(i, count)
        found = rows.members[_ranges(rows.edges[j], count)]
        order = np.lexsort((found, -exact, query))
        query = query[order]
        order = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
        near.append((-exact[order], found[order], np.repeat(rows.homes[j], count)[order]))
        counts.append(np.minimum(np.bincount(query, minlength=len(part)), k))
    ends = np.cumsum(np.concatenate(counts)).astype(np.int32)
    far, found, home = [np.concatenate(x) for x in zip(*near)] if near else [np.empty(0)] * 3
    hits = pa.StructArray.from_arrays(
        [pa.array(far, pa.float64()), pa.array(found, pa.int64()), pa.array(home, pa.int64())], ["far", "vec_id", "home"]
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids, pa.int64()), pa.ListArray.from_arrays(ends, hits)], names=["query_id", "near"]
    )


def _compare(key: tuple, table: pa.Table, k: int) -> pa.Table:
    """A block of rows with the queries that look at it. Of a curve's block a query is compared
    with the windows within ``reach`` of its own; of a block of no curve (-1) with all rows,
    and those count that some curve brings within ``reach``."""
    curve, reach = key
    asks = table["asks"].combine_chunks()
    both = [table.filter(x).combine_chunks() for x in (asks, pa.compute.invert(asks))]
    if not len(both[0]) or not len(both[1]):
        return pa.Table.from_batches([_best(np.empty((0, 1)), [], Rows.of(both[1]), k)])
    at = [matrix(x["at"].combine_chunks()).astype(np.int64) for x in both]
    if curve >= 0:
        order = [np.argsort(x[:, curve], kind="stable") for x in at]
        both, at = [x.take(o).combine_chunks() for x, o in zip(both, order)], [x[o, curve] for x, o in zip(at, order)]
        low, high = np.searchsorted(at[1], at[0] - reach, "left"), np.searchsorted(at[1], at[0] + reach, "right")
        cut = np.flatnonzero(np.diff(low) | np.diff(high)) + 1
        runs = [(s, e, low[s], high[s]) for s, e in zip([0, *cut], [*cut, len(low)])]
        seen = None
    else:
        runs = [(0, len(both[0]), 0, len(both[1]))]

        def seen(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (np.abs(at[0][i] - at[1][j]) <= reach).any(1)

    queries, query_ids, rows = matrix(both[0]["vector"].combine_chunks()), both[0]["vec_id"].to_numpy(), Rows.of(both[1])
    return pa.Table.from_batches(
        [_best(queries[s:e], query_ids[s:e], rows.cut(low, high), k, seen) for s, e, low, high in runs]
    )


class Layout:
    """Blocks of rows and parts of queries that are compared, each part with each block: a
    number for each of these groups.

    ``held`` and ``asking`` are the rows and queries of each window (curve, window). Windows
    of a curve that stand together are a stretch of about ``block`` rows; one with more, and
    the queries that look at a stretch, are dealt out evenly. Where the windows that queries
    look at hold more pairs than there are, curve by curve, every row is in one block only
    and meets every query once."""

    def __init__(self, held: np.ndarray, asking: np.ndarray, reach: int, block: int, askers: int):
        windows = held.shape[1]
        total = np.concatenate([np.zeros((len(asking), 1), np.int64), np.cumsum(asking, 1)], 1)
        window = np.arange(windows)
        look = total[:, np.minimum(window + reach, windows - 1) + 1] - total[:, np.maximum(window - reach, 0)]
        self.reach = reach
        self.whole = int((held * look).sum()) >= int(held[0].sum()) * int(asking[0].sum())
        if self.whole:
            held, asking, total = held[:1].sum(1, keepdims=True), asking[:1].sum(1, keepdims=True), total[:1, [0, -1]]
        self.stretch, size, asks, self.curve = [], [], [], []
        for c, rows in enumerate(held):
            starts, n = [0], 0
            for w, count in enumerate(rows):
                if n and n + count > block:
                    starts.append(w)
                    n = 0
                n += int(count)
            first, last = np.array(starts), np.array([*starts[1:], len(rows)]) - 1
            self.stretch.append(len(size) + np.searchsorted(first, np.arange(len(rows)), "right") - 1)
            size.extend(np.add.reduceat(rows, first))
            asks.extend(total[c, np.minimum(last + reach, len(rows) - 1) + 1] - total[c, np.maximum(first - reach, 0)])
            self.curve += [-1 if self.whole else c] * len(starts)
        self.blocks, self.parts = (-(-np.array(x, np.int64) // y) for x, y in ((size, block), (asks, askers)))
        self.first = np.concatenate([[0], np.cumsum(self.blocks * self.parts)])

    def of(self, group: int) -> int:
        """The curve of a group, -1 where it is of none."""
        return self.curve[np.searchsorted(self.first, group, "right") - 1]

    def groups(self, at: np.ndarray, ids: np.ndarray, asks: bool) -> pa.ListArray:
        """The groups of each row or query, by the windows it stands in on each curve."""
        chance = _mix(ids.view(np.uint64) + np.uint64(1)) >> np.uint64(1)
        row, group = [], []
        for c, stretch in enumerate(self.stretch):
            near = np.zeros(len(at), np.int64) if self.whole else at[:, c]
            reach = self.reach if asks else 0
            low, high = stretch[np.maximum(near - reach, 0)], stretch[np.minimum(near + reach, len(stretch) - 1)]
            i, s = np.repeat(np.arange(len(at)), high - low + 1), _ranges(low, high - low + 1)
            blocks, parts = self.blocks[s], self.parts[s]
            share = (chance[i] % np.maximum(parts if asks else blocks, 1).astype(np.uint64)).astype(np.int64)
            count = np.where(blocks * parts > 0, blocks if asks else parts, 0)
            each = _ranges(np.zeros(len(s), np.int64), count)
            i, s, share = np.repeat(i, count), np.repeat(s, count), np.repeat(share, count)
            row.append(i)
            group.append(self.first[s] + (each * self.parts[s] + share if asks else share * self.parts[s] + each))
        row, group = np.concatenate(row), np.concatenate(group)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at)))]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(group[np.argsort(row, kind="stable")], pa.int64()))


_FOUND = "query_id long, near array<struct<far: double, vec_id: long, home: long>>"


def _top(found: DataFrame, k: int, times: int = 1) -> DataFrame:
    """The k best of each query, once each, from at most k of each block it was compared with.
    One may be found up to ``times`` times."""
    near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k * times)
    return found.groupBy("query_id").agg(F.slice(F.array_distinct(near), 1, k).alias("near"))


def classes_of(rows: DataFrame, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Slices of the copies of each vector (vector, lowest, asking), and one row for all of
    them (vec_id, vector, ids, asks): its smallest ids, one more than ``k``, the first of
    which names it, and whether any copy is a query."""
    ids = F.sort_array(F.collect_list("vec_id"))
    slices = rows.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(SLICES))).groupBy("vector", "slice").agg(
        F.slice(ids, 1, k + 1).alias("lowest"), F.filter(ids, lambda i: i % every == 0).alias("asking")
    )
    slices = stored(slices.drop("slice"), "copies")
    classes = slices.groupBy("vector").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("lowest"))), 1, k + 1).alias("ids"),
        F.max(F.size("asking") > 0).alias("asks"),
    )
    return slices, stored(classes.select(F.col("ids")[0].alias("vec_id"), "vector", "ids", "asks"), "classes")


def nearest(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    recall: float = 0.95,
    curves: int = CURVES,
    window: int = WINDOW,
    seed: int = 5,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) whose
    vec_id ``every`` divides, the ``k`` others found of largest inner product, in double
    precision, nearest first, ties to the smaller vec_id.

    Every row gets a key on each of several Hilbert curves, over projections and shifts of
    its own; curves are cut into windows of about ``window`` rows, at quantiles of a
    sample of CUT_ROWS keys. A query looks at its own window and as many to either side,
    on all curves; they are compared in blocks of bounded size, and the blocks' best are
    merged. Where these windows together hold more pairs than there are, each pair is
    compared once instead, and counts if it shares such a window on any curve: the same
    neighbours. Equal vectors are one class before that, with its smallest ids, one
    more than ``k``; every copy that is a query gets the class's result without itself.
    How many windows to either side is the least that holds ``recall`` of the
    true neighbours of up to TRIAL_QUERIES hashed queries, found among all rows in blocks;
    where vectors have no structure, that is a large part of each curve, and the pairs
    compared grow with the square of the rows.

    Rows that are null, zero or hold null or non-finite components, and rows with a null
    vec_id, take no part, nor do those of another length than the most common one (the
    longer, if several are). Rows with equal vec_id count once, with the greatest vector.
    Fewer candidates than ``k`` are all returned; no rows give no rows.
    """
    rows = vectors.where(usable_vector(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector")
    )
    rows = rows.groupBy("vec_id").agg(F.max("vector").alias("vector"))
    rows = stored(rows.withColumn("size", F.size("vector")), "vectors")
    common = rows.groupBy("size").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"),
    ).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return rows.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0D AS score").limit(0)
    size, total, longest = common
    slices, rows = classes_of(rows.where(F.col("size") == size).select("vec_id", "vector"), every, k)
    total = rows.count()
    queries = rows.where("asks").select("vec_id", "vector")
    shuffled = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["vector"])
            for c in range(curves if len(x) else 0):
                keys = curve_keys(x, c, longest, False, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c)), pa.array(keys)], names=["curve", "key"])

    windows = min(WINDOWS, max(1, -(-total // window)))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(total)) < CUT_ROWS)
    cuts = sample.mapInArrow(keyed, "curve long, key long").groupBy("curve").agg(
        F.percentile_approx("key", [i / windows for i in range(1, windows)] or [0.5], 100_000).alias("cuts")
    )
    cuts = {c: np.unique(q) if windows > 1 else np.empty(0, np.int64) for c, q in cuts.collect()}

    def windows_of(x: np.ndarray, asks: bool) -> pa.ListArray:
        """The window each row, or each query, stands in on each curve."""
        keys = [curve_keys(x, c, longest, asks, seed) for c in range(curves)]
        at = [np.searchsorted(cuts.get(c, np.empty(0, np.int64)), key, "right") for c, key in enumerate(keys)]
        return pa.ListArray.from_arrays(
            np.arange(0, len(x) * curves + 1, curves, dtype=np.int32), pa.array(np.stack(at, 1).ravel(), pa.int64())
        )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = batch["asks"].to_numpy(zero_copy_only=False)
            for part, query in ((batch, False), (batch.filter(pa.array(asks)), True)):
                if len(part):
                    at = windows_of(matrix(part["vector"]), query)
                    yield pa.RecordBatch.from_arrays(
                        [part["vec_id"], pa.array(np.full(len(part), query)), at], names=["vec_id", "asks", "at"]
                    )

    places = stored(rows.mapInArrow(placed, "vec_id long, asks boolean, at array<long>"), "places")
    counted = places.select("asks", F.posexplode("at").alias("curve", "at")).groupBy("asks", "curve", "at").count()

    def search(reach: int) -> DataFrame:
        """All of a query's candidates are in the windows ``reach`` or fewer from its own, on
        any curve."""
        sizes = np.zeros((2, curves, windows), dtype=np.int64)
        for asks, c, at, n in counted.collect():
            sizes[int(asks), c, at] = n
        layout = Layout(*sizes, reach, 2 * max(window, ASKERS), ASKERS)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asks = batch["asks"].to_numpy(zero_copy_only=False)
                for part, query in ((batch, False), (batch.filter(pa.array(asks)), True)):
                    if not len(part):
                        continue
                    at = windows_of(matrix(part["vector"]), query)
                    ids = pa.nulls(len(part), part["ids"].type) if query else part["ids"]
                    groups = layout.groups(matrix(at).astype(np.int64), part["vec_id"].to_numpy().astype(np.int64), query)
                    yield pa.RecordBatch.from_arrays(
                        [groups, pa.array(np.full(len(part), query)), part["vec_id"], part["vector"], ids, at],
                        names=["groups", "asks", "vec_id", "vector", "ids", "at"],
                    )

        both = rows.mapInArrow(
            dealt, "groups array<long>, asks boolean, vec_id long, vector array<double>, ids array<long>, at array<long>"
        )
        both = both.select(F.explode("groups").alias("group"), "asks", "vec_id", "vector", "ids", "at")
        found = both.repartition(shuffled, "group").groupBy("group").applyInArrow(
            lambda key, table: _compare((layout.of(key[0].as_py()), reach), table, k + 1), _FOUND
        )
        return _top(found, k + 1, curves)

    trial = queries.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(TRIAL_QUERIES)
    trial = stored(trial, "trial")
    held = trial.toArrow()
    held_ids, held_rows = held["vec_id"].to_numpy(), matrix(held["vector"].combine_chunks())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _best(held_rows, held_ids, Rows.of(batch), k + 1)

    truth = _top(rows.mapInArrow(exact, _FOUND), k + 1).select("query_id", _others("query_id", k))
    truth = truth.select("query_id", F.explode("near").alias("hit"))
    truth = truth.select("query_id", F.col("hit.vec_id").alias("neighbour"), F.col("hit.home").alias("vec_id"))
    asked_at = places.where("asks").select(F.col("vec_id").alias("query_id"), F.col("at").alias("asked_at"))
    steps = places.where("NOT asks").join(F.broadcast(stored(truth, "truth")), "vec_id").join(asked_at, "query_id")
    apart = F.array_min(F.zip_with("at", "asked_at", lambda a, b: F.abs(a - b)))
    steps = steps.select(apart.alias("steps"))
    steps = np.sort(steps.toArrow()["steps"].to_numpy())
    reach = int(steps[min(len(steps) - 1, int(np.ceil(recall * len(steps))))]) if len(steps) else 0
    near = search(reach).join(queries.select(F.col("vec_id").alias("query_id"), "vector"), "query_id")
    # The copies of one vector may be very many: their slices are dealt anew before they are read out.
    asking = slices.where(F.size("asking") > 0).select("vector", "asking")
    got = asking.join(near.drop("query_id"), "vector").select("asking", "near").repartition(shuffled)
    got = got.select(F.explode("asking").alias("query_id"), "near").select("query_id", _others("query_id", k))
    got = got.select("query_id", F.posexplode("near").alias("pos", "hit"))
    return got.select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"),
    )


def _others(query_id: str, k: int):
    """The k best that are not the query itself."""
    return F.slice(F.filter("near", lambda x: x["vec_id"] != F.col(query_id)), 1, k).alias("near")
