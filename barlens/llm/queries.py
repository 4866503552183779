"""Registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.llm import chat, decontamination, divergence, html, lines, mixing, neighbours, oracle, packing, prefixes, simhash, substrings, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontamination.matches(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line of the corpus."""
    return lines.removed_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "line")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated windows, as counts and a digest."""
    cut = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document."""
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that no other one continues, as chat markup."""
    return chat.render(_table(spark, sf_dir, "conversations"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a classifier that learns from labels that are not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, labels, columns=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair and term reports of every group of lang and source."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2,048 ids, each with a checksum of its ids."""
    cut = packing.pack(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie over all conversations, rebuilt as branches of their family's first."""
    return prefixes.trie(_table(spark, sf_dir, "conversations"), heads=prefixes.HEADS).drop("node")


_QUERIES = (
    op1_decontamination, op2_lines, op3_substrings, op4_token_counts, op5_neighbours, op6_chat, op7_mixing,
    op8_simhash, op9_html, op10_toxicity, op11_divergence, op12_packing, op13_prefix_trie,
)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def all_sql() -> dict[str, str]:
    return dict(oracle.SQL)
