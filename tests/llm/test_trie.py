from __future__ import annotations

import random
import zlib

import brute
from pyspark.sql import functions as F

from tallyroom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def given_order(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}


def spliced(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])
        out[c] = base[:h] + turns[h:]
    return out


def plain(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    leaves, saved, children = {}, {}, {}
    for path in nodes:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = leaves.get(path, 0) + (path not in children)
        saved[path] = saved.get(path, 0) + (len(nodes[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        if path:
            leaves[path[:-1]] = leaves.get(path[:-1], 0) + leaves[path]
            saved[path[:-1]] = saved.get(path[:-1], 0) + saved[path]
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children.get(p, 0), leaves[p], saved[p],
         brute.sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))))
        for p, m in nodes.items()
    )


def rows_of(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def check(spark, rows, make=trie.rebuilt):
    own = given_order(rows)
    got = trie.prefix_trie(*make(spark.createDataFrame(rows, SCHEMA)))
    assert rows_of(got) == plain(spliced(own) if make is trie.rebuilt else own)


def test_given_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    got = trie.prefix_trie(*trie.rebuilt(df.withColumns({"depth": F.lit(1), "size": F.lit("x"), "tie": F.lit(0)})))
    assert rows_of(got) == plain(spliced(given_order(rows)))


def test_shared_starts_nulls_ties_and_repeated_rows(spark):
    draw = random.Random(5)
    rows = [
        (c, draw.choice([None, 0, 1, 1, 2, 3, 7]), draw.choice(["user", "assistant", None]), draw.choice(["", None, "ä", "yes", "z" * 90]))
        for c in [*range(-7, 40), 103, 104] for _ in range(draw.randrange(1, 14))
    ]
    check(spark, rows + rows[:9] + [(None, 1, "user", "lost")])


def test_conversations_left_without_turns(spark):
    """Their family's first conversation is absent and they have no more than h turns."""
    absent = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:6]
    check(spark, [(c, 0, "user", "only") for c in absent])


def test_long_chains_and_hot_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "PACK", 3)
    long = [(500, t, "user", f"t{t % 3}") for t in range(40)] + [(501, t, "user", f"t{t % 3}") for t in range(25)]
    same = [(c, t, "user", f"s{t}") for c in range(600, 640) for t in range(3)]
    check(spark, long + same, trie.as_given)


def test_equal_turns_of_one_conversation(spark):
    check(spark, [(5, 1, "user", "again")] * 40 + [(6, 1, "user", "again")] * 9, trie.as_given)


def test_no_conversations(spark):
    assert trie.prefix_trie(*trie.rebuilt(spark.createDataFrame([], SCHEMA))).collect() == []
    lost = spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)
    assert trie.prefix_trie(*trie.rebuilt(lost)).collect() == []


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds, depth = [], 33
    kept = trie._compress
    monkeypatch.setattr(trie, "_compress", lambda alive, turn: rounds.append(turn) or kept(alive, turn))
    chain = spark.createDataFrame([(0, t, "user", str(t)) for t in range(depth)], SCHEMA)
    assert len(trie.prefix_trie(*trie.as_given(chain)).collect()) == depth + 1
    assert len(rounds) <= 14
