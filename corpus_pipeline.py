"""The corpus pipeline: each stage reads what its predecessor wrote and applies one operator.

Language ID drops documents without a language, MinHash near-dedup keeps the
smallest id of each group, decontamination drops documents that leak a benchmark
item, the PII stage masks spans in the texts, and byte-level BPE returns each
document's ids. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontaminate, langid, minhash, pii
from corvane.llm.common import scope, shared_dir, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A document is rejected if no language has this share of the posterior.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; one without letters (or text), or between languages, goes."""
    model = langid.learn(docs, public_tokenizers.path(RANKS))
    columns = docs.columns
    found = langid.predict(docs, model, keep=tuple(columns), name="__lang")
    return found.where((F.col("__lang_pred") != langid.UNDETERMINED) & (F.col("__lang_score") >= LEAST_LANGUAGE_SCORE)).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that of the smallest id, and one row of each id."""
    return minhash.deduplicated(docs, "pipeline-minhash")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that leak no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; ``n_chars`` follows the new text."""
    out = pii.masked(docs, name="pipeline-pii")
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, digests=True)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("PII", without_pii),
    ("byte-level BPE", encoded),
]

#: SQL can express neither the models nor the hashing and merges of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scope(spark):  # a stage's own tables go once its result is stored
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{at}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{k}")
    return docs
