"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyroom.llm import (
    curves, jaccard, langid, lattice, lm, mixing, order, pieces, pii, quality, repeats, resample, trie,
)

QUERIES, ORACLES = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def registered(build):
    QUERIES[build.__name__] = build
    return build


@registered
def op2_sainte_lague_mix(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents")).drop("source")


@registered
def op5_hilbert_neighbours(spark, sf_dir):
    return curves.nearest(table(spark, sf_dir, "embeddings"))


@registered
def op7_lattice_near_copies(spark, sf_dir):
    return lattice.near_copies(table(spark, sf_dir, "embeddings"))


@registered
def op8_token_combination_join(spark, sf_dir):
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@registered
def op9_neighbour_votes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.scored(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@registered
def op3_feistel_training_order(spark, sf_dir):
    return order.training_order(table(spark, sf_dir, "documents"))


@registered
def op6_lstm_crf_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@registered
def op4_nbest_pieces(spark, sf_dir):
    return pieces.digest(table(spark, sf_dir, "documents"))


@registered
def op10_fused_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return langid.languages(table(spark, sf_dir, "pages"), docs)


@registered
def op1_attention_scores(spark, sf_dir):
    return lm.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


@registered
def op11_position_table_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resampled(docs, table(spark, sf_dir, "benchmark"))


ORACLES["op11_position_table_resampling"] = resample.ORACLE


@registered
def op12_contracted_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(*trie.rebuilt(table(spark, sf_dir, "conversations")))


ORACLES["op12_contracted_prefix_trie"] = trie.ORACLE


@registered
def op13_doubled_window_dedup(spark, sf_dir):
    return repeats.digest(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("longest")


ORACLES["op13_doubled_window_dedup"] = repeats.ORACLE
