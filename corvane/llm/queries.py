"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, chat, decontaminate, fm, html, langid, lattice, minhash, pii
from corvane.llm.common import fold, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = (fold("doc_id", 4) == 2).alias("held_out")
    model = fm.learn(docs, labels, "toxic", fold("doc_id", 4) != 2, structure=False, name="toxic")
    return fm.score(docs.select("doc_id", held, "text"), model, structure=False, keep=("doc_id", "held_out"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, digests=True)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = (fold("doc_id", 5) == 0).alias("held_out")
    model = fm.learn(docs, labels, "quality", fold("doc_id", 5) != 0, structure=True, metadata=("n_chars",), name="quality")
    return fm.score(docs.select("doc_id", held, "text", "n_chars"), model, structure=True, keep=("doc_id", "held_out"), metadata=("n_chars",))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.get("kinds", F.lit(k)).alias(c) for k, c in enumerate(("n_email", "n_ip", "n_card", "n_phone"))]
    return found.select("doc_id", *counts, "base_sha256", pii.spans_text("spans").alias("spans"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = (fold("doc_id", 3) == 1).alias("held_out")
    model = langid.learn(docs, public_tokenizers.path(RANKS), fold("doc_id", 3) != 1)
    return langid.predict(docs.select("doc_id", held, "text"), model, keep=("doc_id", "held_out"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_byte_bpe, op3_decontamination, op4_embedding_dedup, op5_quality, op6_chat, op7_pii, op8_html, op9_language, op10_minhash_dedup)
}

#: None of these can be stated in SQL: trained models, a tokenizer's merges, hashing searches.
ORACLE_SQL: dict[str, str] = {}
