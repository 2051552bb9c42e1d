"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F

from tallyroom.llm.tables import discard, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Each round links every node to the smallest neighbour it knows (large star, then
    small star), which shortens paths by half; a round is written to the shared folder
    before the next. Stars are found with grouped minima, so a node of any degree is
    combined before the shuffle. Raises if the links have not settled after ``rounds``.
    Null ends and loops are ignored; an empty table gives an empty one.
    """
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    links = stored(
        ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links",
    )
    nodes, before = links, _print_of(links)
    for _ in range(rounds if before["n"] else 1):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node that is its own minimum stays linked from its larger neighbours alone.
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        new = stored(small, "links")
        if links is not nodes:
            discard(links)
        links, now = new, _print_of(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    everyone = nodes.select(F.col("u").alias("node")).unionAll(nodes.select("v")).distinct()
    return everyone.join(links, everyone["node"] == links["u"], "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def _print_of(links: DataFrame) -> Row:
    """Number of distinct links and 128 bits of their hashes: equal for equal sets of links."""
    halves = [F.bit_xor(F.xxhash64(F.lit(i), "u", "v")) for i in range(2)]
    return links.agg(F.count(F.lit(1)).alias("n"), *halves).first()


def with_component(members: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``members`` with the component of ``key``; one without links is its own."""
    found = components(edges).withColumnRenamed("node", key)
    return members.join(found, key, "left").withColumn("component", F.coalesce("component", F.col(key)))

