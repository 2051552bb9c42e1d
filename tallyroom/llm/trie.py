"""The prefix trie of conversations, totals of its subtrees by parallel tree contraction.

A node is a distinct sequence of first turns. Its name is the XOR of hashes (128 bits) of
its turns with their places, so names come from running sums and not from long texts. What
holds for a subtree is found in rounds of joins: leaves are raked into their parents, and
of every chain of only children a part, chosen by hash, is compressed away, until the root
is alone; then the rounds are undone, last first, which gives every node its total. The
number of rounds grows with the logarithm of the nodes, whatever the depth.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyroom.llm.ranks import matched, numbered
from tallyroom.llm.sql import CRC_STEPS, crc
from tallyroom.llm.tables import stored

#: Places that one running sum goes over; longer ones are made of sums of such blocks.
BLOCK = 1024
#: Ids that are packed into one row on their way to a node's hash.
PACK = 4096
#: Characters of role and text that ranges of turns are cut at.
HEAD = 64


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, number, w1, w2, bytes) for every turn and (conv_id, first, size) for every
    conversation: turns in order have numbers from ``first`` on. Null turns come first, ties
    are in order of role and text; null role or text is empty. Rows without a conversation
    are left out."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", _text("role").alias("role"), _text("text").alias("text")
    )
    # Ranges are cut at the heads of role and text, as whole ones are too wide to sample.
    # Where the heads are all there is, equal turns may lie in several ranges.
    short = (F.length("role") <= HEAD) & (F.length("text") <= HEAD)
    turns = turns.withColumn("tie", F.when(short, F.monotonically_increasing_id()))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    cuts = [*order[:2], F.substring("role", 1, HEAD).asc(), F.substring("text", 1, HEAD).asc(), F.asc("tie")]
    turns = numbered(turns, order, "number", cuts).select(
        "conv_id", "number",
        F.xxhash64("role", "text").alias("w1"), F.xxhash64(F.lit(1), "role", "text").alias("w2"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    turns = stored(turns, "turns")
    return turns, stored(turns.groupBy("conv_id").agg(F.min("number").alias("first"), F.count("*").alias("size")), "sizes")


def as_given(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, depth, w1, w2, bytes) and lengths (conv_id, length) that make a
    trie of the conversations as they stand."""
    turns, sizes = ordered_turns(conversations)
    placed = matched(turns, sizes, ["conv_id"], "size").select(
        "conv_id", (F.col("number") - F.col("first") + 1).alias("depth"), "w1", "w2", "bytes"
    )
    return placed, sizes.select("conv_id", F.col("size").alias("length"))


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """As ``as_given`` for conversations of which the first h = crc32(id) % ``most`` turns are
    those of the first conversation of their family, c - c % ``family`` (all if it has fewer,
    none if there is none), followed by their own turns after the h-th."""
    turns, sizes = ordered_turns(conversations)
    c = F.col("conv_id")
    of = sizes.withColumn("base", c - c % family).withColumn("h", F.crc32(c.cast("string").cast("binary")) % most)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    of = stored(
        of.join(bases, "base", "left").withColumn("lead", F.least("h", F.coalesce("base_size", F.lit(0)))), "families"
    )
    own = matched(turns, of.select("conv_id", "first", "size", "h", "lead"), ["conv_id"], "size")
    place = F.col("number") - F.col("first") + 1
    tail = own.where(place > F.col("h")).select(c, (F.col("lead") + place - F.col("h")).alias("depth"), "w1", "w2", "bytes")
    # A conversation gives at most most - 1 turns to at most 2 * family - 1 others.
    heads = own.where(place < most).select(c.alias("base"), place.alias("depth"), "w1", "w2", "bytes")
    head = heads.join(of.select("base", "conv_id", "lead"), "base").where("depth <= lead").drop("base", "lead")
    length = F.col("lead") + F.greatest(F.col("size") - F.col("h"), F.lit(0))
    return tail.unionByName(head), of.select("conv_id", length.alias("length"))


def _running(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (conv_id, depth from 1 to ``most``, x1, x2, …) with p1 and p2, the XOR of x1
    and x2 up to the depth, in windows of at most BLOCK rows."""
    if most <= BLOCK:
        window = Window.partitionBy("conv_id").orderBy("depth")
        return rows.withColumns({"p1": F.bit_xor("x1").over(window), "p2": F.bit_xor("x2").over(window)})
    block = F.expr(f"(depth - 1) DIV {BLOCK} + 1")
    rows = stored(rows.withColumn("block", block), "places")
    window = Window.partitionBy("conv_id", "block").orderBy("depth")
    within = rows.withColumns({"l1": F.bit_xor("x1").over(window), "l2": F.bit_xor("x2").over(window)})
    blocks = rows.groupBy("conv_id", F.col("block").alias("depth")).agg(
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")
    )
    before = _running(blocks, (most - 1) // BLOCK + 1).select(
        "conv_id", F.col("depth").alias("block"),
        F.col("p1").bitwiseXOR(F.col("x1")).alias("b1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("b2"),
    )
    joined = within.join(before, ["conv_id", "block"])
    sums = {f"p{i}": F.col(f"l{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)}
    return joined.withColumns(sums).drop("block", "l1", "l2", "b1", "b2")


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of nodes where conversations end. Ids are sorted in
    ranges and packed there; a node's task hashes packs of PACK ids, one at a time."""
    key = ["depth", "p1", "p2"]

    def packed(batches):
        node, ids, first = None, [], None
        def row():
            text = ",".join(map(str, ids)).encode()
            return pa.RecordBatch.from_pydict(
                {"depth": [node[0]], "p1": [node[1]], "p2": [node[2]], "first": [first], "ids": [text]})
        out = []
        for batch in batches:
            for *here, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if here != node or len(ids) == PACK:
                    if node is not None:
                        out.append(row())
                    if len(out) >= 1000:
                        yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                        out = []
                    node, ids, first = here, [], conv
                ids.append(conv)
        if node is not None:
            out.append(row())
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    def hashed(batches):
        node, state, out = None, None, []
        def row():
            return (*node, state.hexdigest())
        def rows():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*key, "ends_sha256"])
        for batch in batches:
            for depth, p1, p2, ids in zip(*(batch.column(n).to_pylist() for n in (*key, "ids"))):
                if (depth, p1, p2) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append(row())
                    node, state = (depth, p1, p2), hashlib.sha256()
                state.update(ids)
            if out:
                yield rows()
                out = []
        if node is not None:
            out.append(row())
            yield rows()

    columns = [*key, "conv_id"]
    packs = ends.select(columns).repartitionByRange(*columns).sortWithinPartitions(*columns)
    packs = packs.mapInArrow(packed, "depth long, p1 long, p2 long, first long, ids binary")
    packs = packs.repartition(*key).sortWithinPartitions(*key, "first")
    return packs.mapInArrow(hashed, "depth long, p1 long, p2 long, ends_sha256 string")


def nodes_of(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    bytes (of the last text), ends_sha256."""
    most = turns.agg(F.max("depth")).first()[0] or 0
    terms = {"x1": F.xxhash64("depth", "w1"), "x2": F.xxhash64("depth", "w2")}
    paths = _running(turns.withColumns(terms), most)
    paths = paths.select(
        "conv_id", "depth", "p1", "p2", "bytes",
        F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"),
    )
    paths = stored(paths, "paths")
    zero = F.lit(0).cast("long")
    roots = lengths.select(
        "conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("bytes"),
        F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"),
    )
    everyone = paths.unionByName(roots)
    key = ["depth", "p1", "p2"]
    nodes = everyone.groupBy(key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        *[F.min(c).alias(c) for c in ("bytes", "q1", "q2")],
    )
    nodes = stored(nodes, "nodes")
    last = everyone.join(lengths.where("length > 0").select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"])
    empty = roots.join(lengths.where("length = 0").select("conv_id"), "conv_id")
    ends = _hashed_ends(last.unionByName(empty, allowMissingColumns=True))

    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    below = nodes.where("depth > 0")
    kids = below.groupBy(*up).agg(F.count("*").alias("n_children"))
    nodes_ = nodes.join(kids, key, "left").join(ends, key, "left").select(
        *key, "conv_id", "n_convs", "bytes", "q1", "q2",
        F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    nodes_ = stored(nodes_, "nodes")
    parents = nodes_.where("n_children > 0").select(*key, F.col("conv_id").alias("parent_conv_id"), "n_children")
    edges = nodes_.where("depth > 0").select(*up, F.col("conv_id"))
    named = matched(edges, parents, key, "n_children").select(
        "conv_id", (F.col("depth") + 1).alias("depth"), "parent_conv_id"
    )
    return nodes_.drop("p1", "p2", "q1", "q2").join(named, ["conv_id", "depth"], "left")


#: A node, its parent, and what the contraction adds up.
_ID, _UP, _VALUES = ["conv_id", "depth"], ["up_conv", "up_depth"], ["leaves", "saved"]


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, leaves, saved): the sums over whole subtrees of ``nodes``
    (conv_id, depth, up_conv, up_depth, leaves, saved), a tree whose root has no parent.

    In a round, nodes without children are raked: their sums go to their parents and are
    final. Then of the nodes that are left with one child, those with an even hash whose
    child has an odd one are compressed: the child moves up to the grandparent and carries
    along (c_...) what the node had, and the node waits for the child's sum. Undoing the
    rounds backwards adds it. A round joins and writes what is still there, so all of them
    together touch each node a few times.
    """
    alive = stored(nodes.withColumns({f"c_{v}": F.lit(0).cast("long") for v in _VALUES}), "alive")
    raked, waiting, turn = [], [], 0
    while True:
        final, alive = _rake(alive)
        raked.append(final)
        if alive is None:
            break
        held, alive = _compress(alive, turn)
        waiting.append(held)
        turn += 1
    known = raked.pop()
    for final, held in zip(reversed(raked), reversed(waiting)):
        child = known.select(
            F.col("conv_id").alias("kid_conv"), F.col("depth").alias("kid_depth"),
            *[F.col(v).alias(f"kid_{v}") for v in _VALUES],
        )
        again = held.join(child, ["kid_conv", "kid_depth"]).select(
            *_ID, *[(F.col(v) + F.col(f"kid_{v}")).alias(v) for v in _VALUES]
        )
        known = known.unionByName(stored(again, "expanded")).unionByName(final)
    return known


def _kids(alive: DataFrame, *figures: Column) -> DataFrame:
    below = alive.where("up_conv IS NOT NULL")
    kids = below.groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth"))
    return kids.agg(F.count("*").alias("kids"), *figures)


def _rake(alive: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The leaves with their sums, and the tree without them (None when it was all)."""
    alive = stored(alive.join(_kids(alive), _ID, "left"), "counted")
    final = alive.where("kids IS NULL")
    given = final.where("up_conv IS NOT NULL").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth"))
    given = given.agg(*[F.sum(F.col(v) + F.col(f"c_{v}")).alias(f"g_{v}") for v in _VALUES])
    rest = alive.where("kids IS NOT NULL")
    if rest.isEmpty():
        return final.select(*_ID, *_VALUES), None
    rest = rest.join(given, _ID, "left").withColumns(
        {v: F.col(v) + F.coalesce(f"g_{v}", F.lit(0)) for v in _VALUES}
    )
    return final.select(*_ID, *_VALUES), stored(rest.drop("kids", *[f"g_{v}" for v in _VALUES]), "raked")


def _compress(alive: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The nodes that are taken out, with their child, and the tree without them."""
    def even(conv, depth):
        return F.xxhash64(F.lit(turn), conv, depth) % 2 == 0
    only = [F.min(c).alias(f"kid_{c}") for c in _ID] + [F.min(f"c_{v}").alias(f"k_{v}") for v in _VALUES]
    unary = alive.where("up_conv IS NOT NULL").join(_kids(alive, *only).where("kids = 1"), _ID)
    out = unary.where(even(F.col("conv_id"), F.col("depth")) & ~even(F.col("kid_conv_id"), F.col("kid_depth")))
    out = stored(out.withColumnRenamed("kid_conv_id", "kid_conv"), "compressed")
    held = out.select(*_ID, "kid_conv", "kid_depth", *[(F.col(v) + F.col(f"k_{v}")).alias(v) for v in _VALUES])
    moved = out.select(
        F.col("kid_conv").alias("conv_id"), F.col("kid_depth").alias("depth"),
        F.col("up_conv").alias("new_conv"), F.col("up_depth").alias("new_depth"),
        *[(F.col(v) + F.col(f"c_{v}")).alias(f"m_{v}") for v in _VALUES],
    )
    rest = alive.join(out.select(_ID), _ID, "left_anti").join(moved, _ID, "left").select(
        *_ID, F.coalesce("new_conv", "up_conv").alias("up_conv"), F.coalesce("new_depth", "up_depth").alias("up_depth"),
        *_VALUES, *[(F.col(f"c_{v}") + F.coalesce(f"m_{v}", F.lit(0))).alias(f"c_{v}") for v in _VALUES],
    )
    return held, stored(rest, "alive")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of ``turns`` and ``lengths`` (see ``as_given`` and ``rebuilt``), a row a node:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations without turns are members of the root and end there; no conversations, no
    rows. Equal turns of one conversation are turns of their own. A conversation of any
    length is numbered, summed and contracted in parallel parts.
    """
    nodes = stored(nodes_of(turns, lengths), "trie")
    tree = nodes.select(
        *_ID, F.col("parent_conv_id").alias("up_conv"),
        F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("up_depth"),
        (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    total = subtree_totals(tree).select(*_ID, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return nodes.join(total, _ID).select(
        *_ID, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


ORACLE = f"""
    WITH {CRC_STEPS.strip()},
    own AS (
        SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
            ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ),
    headed AS (
        SELECT own.conv_id, own.turns, base.turns AS lead, {crc('own.conv_id::VARCHAR')} % 9 AS h
        FROM own CROSS JOIN byte_step LEFT JOIN own AS base ON base.conv_id = own.conv_id - own.conv_id % 5
    ),
    built AS (
        SELECT conv_id, list_concat(coalesce(lead[1:h], []), turns[h + 1:]) AS turns FROM headed
    ),
    path AS (
        SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM built
    ),
    named AS (
        SELECT conv_id, depth, sha256(CASE WHEN depth = 0 THEN '' ELSE to_json(turns[1:depth])::VARCHAR END) AS node,
            CASE WHEN depth > 0 THEN sha256(CASE WHEN depth = 1 THEN '' ELSE to_json(turns[1:depth - 1])::VARCHAR END)
            END AS up,
            CASE WHEN depth > 0 THEN strlen(turns[depth].t) ELSE 0 END AS bytes, depth = len(turns) AS ends
        FROM path
    ),
    node AS (
        SELECT depth, node, min(conv_id) AS conv_id, min(up) AS up, count(*) AS n_convs, min(bytes) AS bytes,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
        FROM named GROUP BY depth, node
    ),
    kids AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
    full_node AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN kids USING (depth, node)),
    above AS (
        SELECT a.depth, a.node, b.n_children, b.n_convs, b.bytes
        FROM full_node b JOIN named m ON m.conv_id = b.conv_id AND m.depth <= b.depth
        JOIN node a ON a.depth = m.depth AND a.node = m.node
    ),
    total AS (
        SELECT depth, node, count(*) FILTER (n_children = 0) AS n_leaves,
            sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
        FROM above GROUP BY depth, node
    )
    SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
    FROM full_node f JOIN total USING (depth, node)
    LEFT JOIN node p ON p.depth = f.depth - 1 AND p.node = f.up
"""
