"""Language of web pages by Bayesian fusion of text, declared language and address."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyroom.llm.quality import TERMS, term_counts
from tallyroom.llm.ranks import matched
from tallyroom.llm.tables import bounded_batches, stored, whole_text
from tallyroom.llm.words import groups

#: Byte triples overlap, so a text's evidence counts for this part of their sum.
TEXT_WEIGHT = 0.3
#: Pages that a level's own counts must outweigh: host over suffix, suffix over all.
HOST_PULL, SUFFIX_PULL = 5.0, 20.0
#: Sum of pseudo-counts of a language's triples and of its declarations.
TRIPLES_PULL, DECLARED_PULL = 400.0, 2.0
_BYTES = 1 << 20
_BLOCKS = "script|style|nav|header|footer|aside|noscript"
_UNSEEN = re.compile(rf"<({_BLOCKS})\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)|<[^>]*>", re.S | re.I)
_UNCLOSED = re.compile(rf"(?:<(?:{_BLOCKS})\b|<!--).*?$", re.S | re.I)


def visible_text(page: str) -> str:
    """The text of a page without markup, scripts, styles and navigation, in lower case. A <
    that no > follows is text."""
    # Up to the last > every < ends somewhere, so no search for its end runs in vain.
    cut, last = page.rfind(">") + 1, None
    parts, done = [], 0
    for last in _UNSEEN.finditer(page, 0, cut):
        parts.append(page[done : last.start()])
        done = last.end()
    closed = True
    if last is not None and done == cut and last[1]:
        closed = re.search(rf"</{last[1]}\s*>$", last[0], re.I)
    elif last is not None and done == cut and last[0].startswith("<!--"):
        closed = len(last[0]) > 6 and last[0].endswith("-->")
    parts.append(page[done:cut] + (_UNCLOSED.sub(" ", page[cut:]) if closed else "\n" * page.endswith("\n")))
    return entities.unescape(" ".join(parts)).lower()


def _triples_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the counts of the hashed byte triples of each language."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        names = np.array(batch["lang"].to_pylist(), dtype=object)
        texts = pa.array([t.as_py().lower() for t in batch["text"]], pa.large_string())
        for part in groups(texts, _BYTES):
            counts = term_counts(part)
            own = names[part.first : part.first + len(counts)]
            for name in set(own.tolist()):
                seen[name] = seen.get(name, 0) + counts[own == name].sum(0, dtype=np.float64)
    for name, counts in seen.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at].astype(np.int64))],
            names=["lang", "term", "n"],
        )


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and (TERMS, languages) log probabilities of byte triples, smoothed
    towards the triples of all languages; counted over all of ``docs`` (text, lang)."""
    read = docs.where("lang IS NOT NULL").select("lang", whole_text(F.col("text")).alias("text"))
    counts = read.mapInArrow(_triples_by_language, "lang string, term long, n long")
    rows = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    table = np.zeros((TERMS, len(names)))
    if names:
        column = np.searchsorted(names, rows["lang"].to_pylist())
        table[rows["term"].to_numpy(), column] = rows["n"].to_numpy()
    usual = (table.sum(1, keepdims=True) + 1) / (table.sum() + TERMS)
    return names, np.log((table + TRIPLES_PULL * usual) / (table.sum(0) + TRIPLES_PULL))


def _likelihoods(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([visible_text(t.as_py()) for t in batch["html"]], pa.large_string())
            scores = [term_counts(t).astype(np.float64) @ model for t in groups(texts, _BYTES)]
            scores = TEXT_WEIGHT * np.concatenate(scores) if scores else np.empty((0, model.shape[1]))
            ends = np.arange(len(scores) + 1, dtype=np.int32) * model.shape[1]
            at = batch.schema.get_field_index("html")
            yield batch.set_column(at, "likelihood", pa.ListArray.from_arrays(ends, scores.ravel()))
    return run


def address(url: Column) -> tuple[Column, Column]:
    """The host of an address in lower case, without port, and its last label; empty where
    there is none, '#' as the suffix of a numeric host."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    last = F.regexp_extract(host, r"([^.]*)$", 1)
    return host, F.when(last.rlike("^[0-9]+$"), "#").otherwise(last)


def declared_language(page: Column) -> Column:
    """The primary tag of the language a page declares for itself; empty without one."""
    return F.lower(F.regexp_extract(page, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})\b""", 1))


def _normal(parts: list[Column]) -> Column:
    """Probabilities from log weights."""
    top = F.greatest(*parts, F.lit(float("-inf"))) if len(parts) > 1 else parts[0]
    weights = [F.exp(p - top) for p in parts]
    total = sum(weights[1:], weights[0])
    return F.array(*[w / total for w in weights])


def languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page: page_id, lang, posterior, text_lang, declared, host.

    The likelihood of a page's visible text comes from byte triples counted over all of
    ``docs`` by language. It alone gives soft counts of languages per declaration, suffix
    and host. The prior of a page is its host's share of each language without the page
    itself, smoothed towards that of the suffix, that towards that of all pages; the
    declaration adds how likely it is under each language. The posterior is the product.
    Counts are grouped sums, combined before they are moved; pages meet the counts of a host
    that has very many of them without a shuffle (``ranks.matched``).

    A null page has an empty text; a missing address is the host ''; repeated rows count
    again; very long pages are read whole, in time proportional to their length. Ties go to the language first by code. Without labelled documents lang is null
    and the posterior 0; without pages there are no rows.
    """
    bounded_batches(pages.sparkSession)
    names, model = text_model(docs)
    page = F.coalesce(F.col("html"), F.lit(""))
    host, suffix = address(F.col("url"))
    rows = pages.select(
        "page_id", host.alias("host"), suffix.alias("suffix"),
        declared_language(page).alias("declared"), page.alias("html"),
    )
    if not names:
        none = F.lit(None).cast("string")
        return rows.select("page_id", none.alias("lang"), F.lit(0.0).alias("posterior"),
                           none.alias("text_lang"), "declared", "host")
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, host string, suffix string, declared string, likelihood array<double>"
    each = range(len(names))
    rows = rows.mapInArrow(_likelihoods(model), schema)
    rows = stored(rows.withColumn("text", _normal([F.col("likelihood")[i] for i in each])), "pages")

    def counted(*by: str) -> DataFrame:
        sums = F.array(*[F.sum(F.col("text")[i]) for i in each])
        return rows.groupBy(*by).agg(sums.alias("n"), F.count("*").alias("pages"))

    total = rows.agg(*[F.coalesce(F.sum(F.col("text")[i]), F.lit(0.0)) for i in each]).first()
    by, kinds = rows.withColumn("all_n", F.array(*map(F.lit, total))), 1
    for key in ("declared", "suffix", "host"):
        found = stored(counted(key).withColumnRenamed("n", f"{key}_n"), key)
        if key == "declared":
            kinds = max(1, found.count())
        by = matched(by, found, [key], "pages").drop("pages")

    def one(i: int) -> Column:
        def left(level: str) -> Column:
            return F.greatest(F.col(f"{level}_n")[i] - F.col("text")[i], F.lit(0.0))

        def pages_of(level: str) -> Column:
            return F.greatest(sum((F.col(f"{level}_n")[j] for j in each), F.lit(-1.0)), F.lit(0.0))

        overall = (left("all") + 1) / (pages_of("all") + len(names))
        by_suffix = (left("suffix") + SUFFIX_PULL * overall) / (pages_of("suffix") + SUFFIX_PULL)
        by_host = (left("host") + HOST_PULL * by_suffix) / (pages_of("host") + HOST_PULL)
        said = (left("declared") + DECLARED_PULL / kinds) / (left("all") + DECLARED_PULL)
        return F.col("likelihood")[i] + F.log(by_host) + F.log(said)

    known = F.array(*map(F.lit, names))

    def first_best(shares: str) -> Column:
        return F.element_at(known, F.array_position(F.col(shares), F.array_max(shares)).cast("int"))

    return by.withColumn("shares", _normal([one(i) for i in each])).select(
        "page_id", first_best("shares").alias("lang"), F.array_max("shares").alias("posterior"),
        first_best("text").alias("text_lang"), "declared", "host",
    )
