"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyroom.llm.ranks import free_names
from tallyroom.llm.tables import WORD, stored

#: Most words of a block; small corpora get smaller ones (see ``mixture``).
BLOCK = 256
#: A source's target is met to about one part in this many, however small the source.
FINENESS = 512
#: Documents per shard, as a mean; a source has at most FAN * FAN shards.
SHARD_DOCS, FAN = 4096, 1024


def apportion(df: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """``df`` with ``quota``: the ``seats`` of its group by highest quotients w, w/3, w/5 ...

    Seats are first rounded from w / (total / seats); what is then missing or too much is
    given to the highest (taken from the lowest) quotients, ties to the smaller key. The
    quotients compared are those the rounding can have missed, at most one and a half a row.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    n, total = F.count(F.lit(1)).over(whole), F.sum(weight).over(whole)
    ideal = F.when((total > 0) & (F.col(seats) > 0), F.col(weight) / total * F.col(seats)).otherwise(0.0)
    df = df.select("*", n.alias("_n"), ideal.alias("_ideal"))
    df = df.withColumn("_first", F.floor(F.col("_ideal") + 0.5).cast("long"))
    df = df.withColumn("_over", F.col(seats) - F.sum("_first").over(whole))
    slack = F.ceil(F.col("_ideal") * F.col("_n") / (2 * F.greatest(F.col(seats), F.lit(1)))) + 1
    steps = F.when(F.col("_over") > 0, F.sequence(F.col("_first"), F.col("_first") + slack)).when(
        (F.col("_over") < 0) & (F.col("_first") > 0),
        F.sequence(F.greatest(F.lit(0).cast("long"), F.col("_first") - 1 - slack), F.col("_first") - 1),
    )
    names = [c for c in df.columns if not c.startswith("_")]
    seat = df.select("*", F.explode_outer(steps).alias("_seat"))
    quotient = F.col(weight) / (2 * F.col("_seat") + 1)
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy(
        F.col("_seat").isNull(), F.when(F.col("_over") > 0, -quotient).otherwise(quotient), key, "_seat"
    )
    moved = F.col("_seat").isNotNull() & (F.row_number().over(order) <= F.abs("_over"))
    seat = seat.select("*", F.when(moved, F.signum("_over")).otherwise(0).cast("long").alias("_move"))
    return seat.groupBy(*names).agg((F.first("_first") + F.sum("_move")).alias("quota"))


def targets(sources: DataFrame, weights: tuple[float, ...], repeat: float) -> DataFrame:
    """Sources (``source``, ``source_size``) with ``src``, their place by code point with null
    last, and ``target``: shares of all words by weight, none above ``repeat`` times its
    source's size. With the sources in order of size over weight, the level that the
    uncapped ones share is the largest at which none of them is above its stop."""
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((place - 1) % len(weights) + 1).cast("int"))
    df = sources.select("*", place.cast("long").alias("src"), weight.alias("_w"))
    df = df.withColumn("_stop", repeat * F.col("source_size"))
    rising = every.orderBy(F.col("_stop") / F.col("_w"), "src")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("_stop").over(before), F.lit(0.0))
    level = rest / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    df = df.withColumn("_level", level)
    shared = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_stop"), F.col("_level"))).over(every)
    target = F.least(F.col("_stop"), F.coalesce(shared, F.lit(0.0)) * F.col("_w"))
    return df.withColumn("target", target.cast("double")).drop("_w", "_stop", "_level")


def _below(words: Column, block: Column, base: Column, extra: Column, blocks: Column, turn: Column) -> Column:
    """Words taken of a shard's first ``words`` words: every block ``base`` times, and the
    ``extra`` blocks spread evenly over the shard, from a seeded turn on, once more."""
    def chosen(k: Column) -> Column:
        y = k + turn
        return extra * F.floor(y / blocks) + F.floor((y % blocks) * extra / blocks)
    full, part = F.floor(words / block), words % block
    return base * words + block * (chosen(full) - chosen(F.lit(0))) + part * (chosen(full + 1) - chosen(full))


def mixture(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    repeat: int = 3,
    block: int = BLOCK,
    seed: int = 0,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    The words of a source are dealt to shards by a seeded hash of the id, strung together
    in hash order and cut into equal blocks. Blocks are apportioned to sources by their
    targets, then to shards by their words, in two steps of at most FAN shards, so no
    window holds more than a shard's documents. A shard takes its quota of blocks: all of
    them as often as they go into it, and a seeded, evenly spread choice once more.
    ``taken`` counts the words of a document in the blocks taken, repeats included, and is
    never over ``repeat`` times its size.

    A null text has no words and takes none; a null source is a source of its own, last;
    equal ids and repeated rows count apart; no documents give no rows. The result
    depends on the rows and the seed alone. One row a source passes through one task.
    """
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = stored(docs.select("doc_id", "source", size.alias("size"), key.alias("key")), "sizes")
    per_source = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")
    )
    every = Window.partitionBy(F.lit(0))
    fine = F.floor(F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(every) / FINENESS)
    sources = targets(per_source, weights, repeat).select(
        "*",
        F.greatest(F.lit(1), F.least(F.lit(block), F.coalesce(fine, F.lit(1)))).cast("long").alias("block"),
        F.least(F.lit(FAN), F.ceil(F.sqrt(F.col("docs") / SHARD_DOCS))).cast("long").alias("fan"),
    )
    all_words = F.round(F.sum("source_size").over(every) / F.col("block")).cast("long")
    sources = stored(
        apportion(sources.withColumn("seats", all_words), [], "src", "target", "seats"), "sources"
    ).withColumnRenamed("quota", "source_quota")

    facts = ["src", "source_size", "target", "block", "fan", "source_quota"]
    right = sources.select(F.col("source").alias("_source"), *facts)
    dealt = sized.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").select(
        "*",
        F.pmod("key", "fan").alias("hi"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.col("fan")).alias("lo"),
    )
    shard = ["src", "hi", "lo"]
    leaves = stored(
        dealt.groupBy(*shard, "block", "source_quota").agg(F.sum("size").cast("double").alias("words")), "shards"
    )
    upper = leaves.groupBy("src", "hi", "source_quota").agg(F.sum("words").alias("words"))
    upper = apportion(upper, ["src"], "hi", "words", "source_quota").select("src", "hi", F.col("quota").alias("upper"))
    leaves = apportion(leaves.join(upper, ["src", "hi"]), ["src", "hi"], "lo", "words", "upper")
    blocks = F.ceil(F.col("words") / F.col("block"))
    quota = F.least(F.col("quota"), repeat * blocks)
    leaves = leaves.select(
        *shard,
        blocks.alias("blocks"),
        F.when(blocks > 0, F.floor(quota / blocks)).otherwise(0).alias("base"),
        F.when(blocks > 0, quota % blocks).otherwise(0).alias("extra"),
        F.when(blocks > 0, F.pmod(F.xxhash64(F.lit(seed), *shard), blocks)).otherwise(0).alias("turn"),
    )
    order = Window.partitionBy(*shard).orderBy("key", "doc_id", "size")
    start = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.withColumn("start", start).join(leaves, shard)
    at = [F.col(c) for c in ("block", "base", "extra", "blocks", "turn")]
    taken = _below(F.col("start") + F.col("size"), *at) - _below(F.col("start"), *at)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """The documents of the mix, all columns kept, each as many times as its taken words
    go into its size. What is left over is summed up along the documents of a source by
    size, in buckets of about SHARD_DOCS, and each time the sum passes a whole number the
    document there gets one more copy, so a source's words stay near its target. Rows with
    equal ids share their copies; a null id is an id like others."""
    mix = mixture(docs, seed=seed, **how).where("size > 0").groupBy("doc_id").agg(
        F.min("source").alias("source"), F.sum("taken").alias("taken"), F.sum("size").alias("size")
    )
    mix = stored(mix, "mix")
    buckets = max(1, mix.count() // SHARD_DOCS)
    bucket = F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id"), F.lit(buckets))
    times = F.col("taken") / F.col("size")
    order = Window.partitionBy("source", "bucket").orderBy("size", F.xxhash64(F.lit(seed + 3), "doc_id"), "doc_id")
    start = F.pmod(F.xxhash64(F.lit(seed + 4), "source", "bucket"), F.lit(1 << 20)) / (1 << 20)
    before = F.sum("over").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("over") + start
    free = free_names(docs, "id", "copies", "copy")
    mix = mix.withColumns({"bucket": bucket, "whole": F.floor(times)}).withColumn("over", times - F.col("whole"))
    mix = mix.withColumn("before", before).select(
        F.col("doc_id").alias(free["id"]),
        (F.col("whole") + F.floor(F.col("before") + F.col("over")) - F.floor("before")).cast("int").alias(free["copies"]),
    ).where(F.col(free["copies"]) > 0)
    kept = docs.join(mix.hint("merge"), F.col("`doc_id`").eqNullSafe(F.col(free["id"])))
    kept = kept.withColumn(free["copy"], F.explode(F.sequence(F.lit(1), F.col(free["copies"]))))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
