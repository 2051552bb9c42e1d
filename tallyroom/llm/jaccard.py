"""Similarity join of documents by Jaccard of word shingles, with token-combination prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tallyroom.llm import bitmaps
from tallyroom.llm.components import components
from tallyroom.llm.ranks import free_names
from tallyroom.llm.tables import bounded_batches, discard, map_rows, stored, whole_text
from tallyroom.llm.words import groups, mix, shingles

#: Similarity: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Share of the hash range whose rare shingles are all looked at over the corpus; those in no
#: other class come first in prefixes. More of it moves more and leaves fewer candidates.
LOW = 0.4
#: A shingle is frequent if it is in this many classes among COUNTED shingles of some task.
FREQUENT, COUNTED = 3, 1_000_000
#: Frequent shingles of a prefix per group within which pairs are formed, and the level of
#: size from which they are; smaller sets index frequent shingles singly as well.
PAIRED, PAIRED_LEVEL = 8, 9
#: Among candidates, shingles in at most this many classes make pairs by themselves.
SCARCE = 64
#: New leaders a class meets in a round; rounds end when they link less than one in ROUNDS_END.
ASKED, ROUNDS_END = 4, 8
#: Marks of a class that travel along, so that a pair meets at few of the marks it shares.
KNOWN = 8
_U = np.uint64
#: Shingles travel as their upper 48 bits; sets are compared by all 64.
_TOKEN_SHIFT = _U(16)
_EDGE = _U(int(LOW * 2**64))


def allowed(n: np.ndarray | int):
    """Most shingles of a set of n that a similar set can lack."""
    return n - -(-PERCENT * n // 100)


def level_of(n: int) -> int:
    """Sets of similar sizes are at most one level apart."""
    return int(np.log(n) / np.log(100 / PERCENT + 0.01))


def pair_groups(level: int) -> int:
    """Groups of frequent shingles at a level; the same for all sets indexed there."""
    size = (100 / PERCENT + 0.01) ** (level + 1)
    return max(1, int(size * (1 - PERCENT / 100) / PAIRED))


def _place(tokens: np.ndarray) -> np.ndarray:
    return tokens >> _TOKEN_SHIFT


def head(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rare shingles that may stand in a set's prefix, those below the edge and more in
    hash order where these are too few; and the frequent ones it may go on with."""
    often = bitmaps.contains(frequent, _place(tokens))
    need = int(allowed(len(tokens))) + 1
    rare = tokens[~often]
    rare = rare[: max(need, int(np.searchsorted(rare, _EDGE)))]
    return rare, tokens[often] if len(rare) < need else tokens[:0]


def signatures(n: int, rare: np.ndarray, often: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Hashes of which two similar sets share at least one.

    ``rare`` and ``often`` are the head of a set of ``n``; ``shared`` tells which rare
    shingles may be in another class. Shingles are in one order for all sets: rare below
    the edge, those in one class alone first, then rare above it, then frequent, each by
    hash. The prefix is the least that still covers something when every shingle a similar
    set can lack is taken away: a rare shingle covers one, a group of g frequent ones
    g - 1, as losing g - 1 leaves no pair. Of two similar sets take the one whose prefix
    ends first: what they share of it lies in the other's prefix too, and holds a rare
    shingle or two frequent ones of a group. Groups depend on the size, so a set is
    indexed at its own level of size and the next: similar sets meet at one level, where
    the same shingles form the same groups.
    """
    need = int(allowed(n)) + 1
    met = bitmaps.contains(shared, _place(rare))
    below = rare < _EDGE
    first = int((~met & below).sum())
    kept = np.concatenate([rare[met & below], rare[~below]])[: max(0, need - first)]
    out = [mix(kept[bitmaps.contains(shared, _place(kept))])]
    need -= len(rare)
    own = level_of(n)
    for level in (own, own + 1) if need > 0 else ():
        salt = _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        if level < PAIRED_LEVEL:
            out.append(mix(mix(often[:need]) + salt))
            continue
        group = ((often >> _U(7)) % _U(pair_groups(level))).astype(np.int64)
        covers = np.ones(len(often), dtype=np.int64)
        covers[np.unique(group, return_index=True)[1]] = 0
        end = int(np.searchsorted(np.cumsum(covers), need)) + 1
        order = np.argsort(group[:end], kind="stable")
        start = 0
        for stop in np.flatnonzero(np.diff(group[:end][order], append=-1)) + 1:
            members = often[order[start:stop]]
            i, j = np.triu_indices(len(members), 1)
            out.append(mix(mix(members[i] + salt) * _U(3) + members[j]))
            start = stop
    return np.unique(np.concatenate(out))


def identity(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=8).digest()


def class_id(tokens: np.ndarray) -> int | None:
    """Sets of equal shingles are one class; the empty set is none."""
    return int.from_bytes(identity(tokens), "little", signed=True) if len(tokens) else None


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text, and a row for each shingle frequent among COUNTED of a task."""
    tokens: dict[int, np.ndarray] = {}
    held = 0
    for batch in batches:
        sizes, names, often = [], [], np.empty(0, np.int64)
        for texts in groups(batch["text"]):
            for found in shingles(texts):
                sizes.append(len(found))
                names.append(class_id(found))
                if names[-1] is not None and names[-1] not in tokens:
                    tokens[names[-1]] = found
                    held += len(found)
            if held >= COUNTED:
                often = np.append(often, _often(tokens))
                tokens, held = {}, 0
        extra = len(often)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([batch["doc_id"], pa.nulls(extra, batch["doc_id"].type)]),
                pa.array(sizes + [0] * extra, pa.int64()), pa.array(names + [None] * extra, pa.int64()),
                pa.concat_arrays([pa.nulls(len(batch), pa.int64()), pa.array(often, pa.int64())]),
            ],
            names=["doc_id", "n_shingles", "class", "often"],
        )
        kind = batch["doc_id"].type
    if tokens:
        often = _often(tokens)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(often), kind), pa.array(np.zeros(len(often), np.int64)),
                pa.nulls(len(often), pa.int64()), pa.array(often, pa.int64()),
            ],
            names=["doc_id", "n_shingles", "class", "often"],
        )


def _often(tokens: dict[int, np.ndarray]) -> np.ndarray:
    token, n = np.unique(np.concatenate(list(tokens.values())), return_counts=True)
    return (token[n >= FREQUENT] >> _TOKEN_SHIFT).view(np.int64)


def _by_class(batches: Iterator[pa.RecordBatch], of_set, names: list[str]) -> Iterator[pa.RecordBatch]:
    """What ``of_set`` gives for each set, hashes and numbers, as ``names``: (hash, class,
    number, ...); equal texts of a task once, as far as it remembers."""
    seen: set[int] = set()
    for batch in batches:
        seen = seen if len(seen) < 100_000 else set()
        for texts in groups(batch["text"]):
            columns = []
            for found in shingles(texts):
                name = class_id(found)
                if name is None or name in seen:
                    continue
                seen.add(name)
                hashes, *numbers = of_set(found)
                if len(hashes):
                    columns.append((hashes.view(np.int64), *[np.full(len(hashes), x) for x in (name, *numbers)]))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*columns)], names=names)


def _each_set(df: DataFrame, of_set, *numbers: str, bits: Broadcast | None = None) -> DataFrame:
    """(hash, class, numbers) that ``of_set`` gives for the texts of all rows of ``df``, or of
    those whose ``place`` is in ``bits``."""
    names = ["hash", "class", *numbers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if bits is not None:
            batches = (b.filter(pa.array(bitmaps.contains(bits.value, b["place"].to_numpy()))) for b in batches)
        yield from _by_class(batches, of_set, names)

    return df.mapInArrow(run, ", ".join(f"{name} long" for name in names))


def _heads(frequent: Broadcast):
    return lambda found: (head(found, frequent.value)[0] >> _TOKEN_SHIFT,)


def _indexed(frequent: Broadcast, shared: Broadcast):
    return lambda found: (signatures(len(found), *head(found, frequent.value), shared.value),)


def _scarce(shared: Broadcast, often: Broadcast):
    """The shingles in few candidates, after a 0 that stands for the set; with how many of
    the set may be in another candidate at all, and how many in many."""
    def of_set(found: np.ndarray):
        place = _place(found)
        met, many = bitmaps.contains(shared.value, place), bitmaps.contains(often.value, place)
        hashes = np.append(_U(0), found[met & ~many])
        return hashes, len(found), int((met | many).sum()), int(many.sum())
    return of_set


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for left, right in zip(groups(batch["left"], 1 << 40), groups(batch["right"], 1 << 40)):
            linked += [similar(x, y) for x, y in zip(shingles(left), shingles(right))]
        linked = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch["a"].filter(linked), batch["b"].filter(linked)], names=["a", "b"]
        )


def _texts(bits: Broadcast):
    """(class, text) of the rows whose place is in a bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bitmaps.contains(bits.value, batch["place"].to_numpy())))
            names = [class_id(found) for texts in groups(batch["text"]) for found in shingles(texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), batch["text"]], names=["class", "text"]
            )
    return run


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that connect whatever the similar pairs connect.

    Candidates share a signature. For the classes that have candidates at all it is then
    counted which of their shingles are in one of them alone, in few or in many: what two
    sets share is at most what each has beside its lone shingles, and, unless they share a
    scarce one, beside those too. Each candidate is compared with a few leaders of those
    it meets: the one with the fewest lone shingles, which is nearest to what its copies
    were made from, the least and a hashed one. What that links is done; those still apart
    meet new leaders as long as that links a good part of them. Pairs still apart are
    compared if they share a signature and enough frequent shingles, or as many scarce ones
    as make up for those.
    So every candidate pair is compared, connected, or known not to link, and a group of
    thousands of near copies costs a few comparisons a member instead of all its pairs.
    Filters are given up by the driver and the executors as soon as what they sift is stored.
    """
    send = docs.sparkSession.sparkContext.broadcast
    text = docs.select(whole_text(F.col("text")).alias("text"))
    placed = docs.select(whole_text(F.col("text")).alias("text"), bitmaps.slot(F.col("doc_id")).alias("place"))

    often = classes.where("often IS NOT NULL").select("often").distinct()
    frequent = send(bitmaps.bitmap(often, F.col("often")))
    met = _each_set(text, _heads(frequent)).groupBy("hash").agg(
        F.min("class").alias("low"), F.max("class").alias("high")
    )
    met = stored(met.where("low <> high").select("hash"), "shared")
    shared = send(bitmaps.bitmap(met, F.col("hash")))
    discard(met)
    marks = _each_set(text, _indexed(frequent, shared))
    marks = stored(marks.select(F.col("hash").alias("mark"), "class").distinct(), "marks")
    frequent.destroy()
    shared.destroy()
    led = marks.groupBy("mark").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    live = stored(marks.join(led.where("low <> high").select("mark"), "mark"), "marks")
    discard(marks)

    representative = classes.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    candidates = stored(live.select("class").distinct().join(representative, "class"), "candidates")
    bits = send(bitmaps.bitmap(candidates, bitmaps.slot(F.col("doc_id"))))
    discard(candidates)
    all_tokens = _each_set(placed, lambda found: (found >> _TOKEN_SHIFT,), bits=bits)
    counted = all_tokens.groupBy("hash").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n")
    )
    counted = stored(counted.where("low <> high").select("hash", (F.col("n") > SCARCE).alias("many")), "tokens")
    several = send(bitmaps.bitmap(counted, F.col("hash"), 64))
    many = send(bitmaps.bitmap(counted.where("many"), F.col("hash"), 512))
    discard(counted)
    scarce = _each_set(placed, _scarce(several, many), "n", "most", "common", bits=bits)
    scarce = stored(scarce.distinct(), "scarce")
    for used in (bits, several, many):
        used.destroy()
    # A set that shares less than this with all others links with none.
    scarce = scarce.where(100 * F.col("most") >= PERCENT * F.col("n"))
    facts = scarce.where("hash = 0").select("class", "n", "most", "common")

    def can_link(shared_by: str):
        both = F.least(shared_by, f"other_{shared_by}")
        return (100 + PERCENT) * both >= PERCENT * (F.col("n") + F.col("other_n"))

    def others(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c == "mark" else f"other_{c}") for c in df.columns])

    def ordered(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    def verified(pairs: DataFrame) -> DataFrame:
        named = pairs.select(F.col("a").alias("class")).unionAll(pairs.select("b")).distinct()
        named = stored(named.join(representative, "class"), "named")
        wanted = send(bitmaps.bitmap(named, bitmaps.slot(F.col("doc_id"))))
        some = placed.mapInArrow(_texts(wanted), "class long, text string")
        texts = stored(some.join(named.select("class"), "class", "left_semi").dropDuplicates(["class"]), "texts")
        wanted.destroy()
        both = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("left")), "a")
        both = both.join(texts.select(F.col("class").alias("b"), F.col("text").alias("right")), "b")
        out = stored(both.select("a", "b", "left", "right").mapInArrow(_verified, "a long, b long"), "links")
        discard(named)
        discard(texts)
        return out

    hashed = F.xxhash64("class")
    near_source = F.floor(F.col("most") * 1024 / F.col("n")) * (1 << 40) + F.pmod(hashed, F.lit(1 << 40))
    members = stored(live.join(facts, "class").withColumn("near", near_source), "members")
    discard(live)
    leads = {"l0": F.max_by("class", "near"), "l1": F.min("class"), "l2": F.min_by("class", hashed)}
    led = members.groupBy("mark").agg(*[lead.alias(k) for k, lead in leads.items()], F.max("near").alias("near"))
    chosen = members.select("mark", "class", "n", "most").join(led, "mark").groupBy("class", "n", "most").agg(
        F.max_by("l0", "near").alias("l0"), F.min("l1").alias("l1"), F.min_by("l2", F.xxhash64("l2")).alias("l2")
    )
    chosen = chosen.select("class", "n", "most", F.explode(F.array(*leads)).alias("other_class"))
    chosen = chosen.where("class <> other_class").join(others(facts.drop("common")), "other_class")
    first = stored(chosen.where(can_link("most")).select(*ordered("class", "other_class")).distinct(), "pairs")
    found = verified(first)

    def labelled(by: DataFrame, group: DataFrame) -> DataFrame:
        """``by`` with the component of each class, of marks that are open: where several
        components meet."""
        by = by.join(group, "class", "left").withColumn("component", F.coalesce("component", "class"))
        by = stored(by, "apart")
        marks = by.groupBy("mark").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        out = stored(by.join(marks.where("low <> high").select("mark"), "mark"), "open")
        discard(by)
        return out

    # Rounds of new leaders for the sets that frequent shingles alone may link: a class apart
    # from the largest component of a mark meets some of that one's members.
    by_common = members.where(100 * F.col("common") >= PERCENT * F.col("n")).select("mark", "class", "n", "common")
    compared, number, group = first, 0, components(found).withColumnRenamed("node", "class")
    by = labelled(by_common, group)
    while True:
        size = by.groupBy("mark", "component").agg(
            F.count("*").alias("size"), F.min_by("class", F.xxhash64("class", F.lit(number))).alias("leader")
        )
        main = size.groupBy("mark").agg(F.max(F.struct("size", "component", "leader")).alias("main"))
        asked = by.join(main.select("mark", "main.component", "main.leader").withColumnRenamed("component", "most"), "mark")
        asked = asked.where("component <> most").withColumn("other_class", F.col("leader"))
        asked = asked.join(others(facts.drop("most")), "other_class").where(can_link("common"))
        order = F.row_number().over(Window.partitionBy("class").orderBy(F.xxhash64("leader", F.lit(number))))
        asked = asked.select("class", "other_class", "leader").distinct().withColumn("order", order)
        asked = asked.where(F.col("order") <= ASKED).select(*ordered("class", "other_class")).distinct()
        asked = stored(asked.join(compared, ["a", "b"], "left_anti"), "pairs")
        pairs = asked.count()
        if not pairs:
            break
        more = verified(asked)
        compared, found, number = compared.unionAll(asked), found.unionAll(more), number + 1
        linked = more.count()
        few = linked * ROUNDS_END < pairs
        if linked:
            group = components(found).withColumnRenamed("node", "class")
            discard(by)
            by = labelled(by_common, group)
        if few:
            break

    # A pair that shares many marks meets at few of them: each class has its first mark in KNOWN
    # orders, and where two classes agree on one, they do not meet at greater marks than that.
    # They always meet at the least mark they share.
    names = [f"m{i}" for i in range(KNOWN)]
    firsts = by.groupBy("class").agg(*[
        F.min_by("mark", F.xxhash64(F.lit(i), "mark")).alias(name) for i, name in enumerate(names)])
    by = by.join(firsts, "class")
    lesser = F.lit(False)
    for name in names:
        lesser = lesser | ((F.col(name) == F.col(f"other_{name}")) & (F.col(name) < F.col("l.mark")))
    meet = (F.col("component") < F.col("other_component")) & can_link("common") & ~lesser
    pairs = by.alias("l").join(others(by).alias("r"), (F.col("l.mark") == F.col("r.mark")) & meet)
    second = pairs.select(*ordered("class", "other_class")).distinct()

    # What two sets share is at most the scarce shingles that both have and the frequent ones
    # of either. Components are held against each other first, so that what a few shingles
    # have in common does not make pairs of all their members.
    by = labelled(scarce.where("hash <> 0").withColumnRenamed("hash", "mark"), group)
    need = F.ceil(F.col("n") * PERCENT / 100) - F.col("common")
    needs = by.groupBy("component").agg(F.min(need).alias("need"))
    meeting = by.select("mark", "component").distinct()
    meeting = meeting.join(others(meeting), "mark").where("component < other_component")
    meeting = meeting.groupBy("component", "other_component").agg(F.count("*").alias("shared"))
    meeting = meeting.join(needs, "component").join(others(needs), "other_component")
    live_pairs = stored(
        meeting.where("shared >= need AND shared >= other_need").select("component", "other_component"), "meeting"
    )
    pairs = by.join(live_pairs, "component").join(others(by), ["mark", "other_component"]).where(can_link("most"))
    pairs = pairs.groupBy("class", "other_class", "n", "other_n", "common", "other_common").agg(F.count("*").alias("shared"))
    both = F.col("shared") + F.least("common", "other_common")
    third = pairs.where((100 + PERCENT) * both >= PERCENT * (F.col("n") + F.col("other_n")))
    second = second.unionAll(third.select(*ordered("class", "other_class"))).distinct()
    second = stored(second.join(compared, ["a", "b"], "left_anti"), "pairs")
    return found if second.isEmpty() else found.unionAll(verified(second))


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= 75 * union of their sets of five-word
    shingles; component_id is the smallest doc_id reachable by links, itself included.
    Words are cut at ASCII white space, A-Z in lower case; a text of fewer than five
    words is one shingle; one without words, or null, links with nothing. Shingles and
    sets are compared by 64-bit hashes.

    Documents of equal sets are one class, and each is mapped to it by its id, so copies
    never meet. Rows with equal doc_id stay rows of their own and share a component if
    their texts are equal or link. A null doc_id links with nothing. No rows give no rows.
    """
    return _grouped(docs).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame) -> DataFrame:
    """``similar_documents`` with each row's class and the class that names its component."""
    bounded_batches(docs.sparkSession)
    known = F.when(F.col("doc_id").isNotNull(), F.col("text"))
    read = docs.select("doc_id", whole_text(known).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = read.mapInArrow(_classes, f"doc_id {kind}, n_shingles long, class long, often long")
    found = stored(found, "classes")
    classes = found.where("often IS NULL")
    group = components(links(docs.where("doc_id IS NOT NULL"), found)).withColumnRenamed("node", "class")
    least = classes.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    least = least.join(group, "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = least.join(lowest, "component").select("class", "component", "component_id")
    return classes.join(named, "class", "left").select(
        "doc_id", "n_shingles", "class", "component", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns kept: that of the smallest id, and of
    several rows of this id that of least text hash. Rows of one id whose texts do not link
    are groups of their own. Documents without words or without an id are no group and stay,
    all of them."""
    bounded_batches(docs.sparkSession)
    found = stored(_grouped(docs), "components")
    free = free_names(docs, "id", "place", "class", "component", "read", "row")
    known = found.where("component IS NOT NULL")
    # Ids that go, or of whose rows some may go; rows of those that stay as well are told apart.
    own = F.col("doc_id") == F.col("component_id")
    rows = known.groupBy(F.col("doc_id").alias(free["id"])).agg(F.count_if(own).alias("stay"), F.count_if(~own).alias("go"))
    asked_ids = stored(
        rows.where("go > 0 OR stay > 1").select(free["id"], (F.col("stay") > 0).alias(free["row"])), "asked"
    )
    bits = bitmaps.bitmap(asked_ids, bitmaps.slot(F.col(free["id"])))
    # The filter settles most rows without moving their texts; only those it holds join.
    place = free["place"]
    marked = docs.withColumn(place, bitmaps.slot(F.col("doc_id")))

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(place)
            held = bitmaps.contains(bits, batch[place].to_numpy()).astype(np.int64)
            yield batch.set_column(at, place, pa.array(held))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = map_rows(marked, flagged, marked.schema)
    kept = marked.where(F.col(place) == 0).select(*columns)
    asked = marked.where(F.col(place) == 1).drop(place)
    asked = asked.join(asked_ids, F.col("`doc_id`") == F.col(free["id"]), "left")
    clear = asked.where(F.col(free["id"]).isNull()).select(*columns)

    # Rows that share their id: one of each component, found by class.
    read, name = free["read"], free["class"]
    shared = asked.where(F.col(free["row"])).select(*columns, whole_text(F.col("text")).alias(read))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [class_id(s) for texts in groups(batch[read]) for s in shingles(texts)]
            yield batch.append_column(name, pa.array(names, pa.int64()))

    schema = T.StructType([*shared.schema.fields, T.StructField(name, T.LongType())])
    shared = map_rows(shared, classed, schema)
    wordless = shared.where(F.col(name).isNull()).select(*columns)
    of_class = known.where("doc_id = component_id").select(
        F.col("class").alias(place), F.col("component").alias(free["component"]), F.col("doc_id").alias(free["id"])
    ).distinct()
    shared = shared.join(of_class, (F.col(name) == F.col(place)) & (F.col("`doc_id`") == F.col(free["id"])))
    first = shared.groupBy(free["id"], free["component"]).agg(
        F.min_by(F.struct(*columns), F.xxhash64(read)).alias(free["row"])
    )
    first = first.select(*[F.col(free["row"])[c].alias(c) for c in docs.columns])
    return kept.unionAll(clear).unionAll(wordless).unionAll(first)
