"""Queries of the text problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import leakage, syntax, tokens, truncation
from lodestrata.sources.tables import table

# ---------------------------------------------------------------- 6: files that do not parse


def p6_faults(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_faults(table(spark, d, "source_files"), ["file_id", "repository_identity"], "canonical_source_path", "source_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_faults(spark, d).where("fault IS NOT NULL").select("file_id")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per repository and language: files judged, files at fault, and their rate."""
    bad = F.count("fault")
    return p6_faults(spark, d).groupBy("repository_identity", "language").agg(F.count(F.lit(1)).alias("files"), bad.alias("faulty"), (bad / F.count(F.lit(1))).alias("rate"))


# ---------------------------------------------------------------- 7: token ids


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"), ["doc_id"], "text")


def p7_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and characters per language and source: how the corpus weighs in tokens."""
    ids = tokens.encode_texts(table(spark, d, "documents"), ["lang", "source", "n_chars"], "text")
    return ids.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("ids")).alias("tokens"), F.sum("n_chars").alias("chars"))


# ---------------------------------------------------------------- 8: leaked evaluation texts


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation item with the number of documents that leak it."""
    n = p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return table(spark, d, "eval_items").select("item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


# ---------------------------------------------------------------- 9: cut texts


def p9_judged(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge_texts(table(spark, d, "documents"), ["doc_id"], "text", "source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_judged(spark, d).where("cut").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, cut documents and their rate, and how many end at the source's limit."""
    cut = F.count(F.when(F.col("cut"), 1))
    return p9_judged(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), cut.alias("cut"), (cut / F.count(F.lit(1))).alias("rate"), F.count(F.when(F.col("at_limit"), 1)).alias("at_limit"))


QUERIES = {
    "p6_found": p6_found, "p6_faults": p6_faults, "p6_rates": p6_rates, "p7_ids": p7_ids, "p7_lengths": p7_lengths,
    "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_rates": p9_rates,
}

#: Lexing, byte-pair merges, multi-pattern search and the judgement of endings are beyond SQL; they are
#: tested against exact parsers, the public tokenizer's own library, and brute force.
SQL: dict[str, str] = {}
