"""The registered queries as they are: columns, types, rows and the held-out rule of each contract."""

import hashlib
import re
import zlib

import pytest

from corvane.llm import common, queries

SMALL = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_decontamination": "doc_id bigint, item_id bigint, n_words bigint, n_covered bigint, n_tiles bigint, longest bigint, coverage double",
    "op4_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_chat": "conv_id bigint, turn bigint, at_turn bigint, step int, role string, n_calls bigint, n_answered bigint, linked boolean, n_invalid bigint, message string",
    "op7_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op8_html": "page_id bigint, url string, text string, n_chars bigint",
    "op9_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_minhash_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
}
HELD = {"op1_toxicity": (4, 2), "op5_quality": (5, 0), "op9_language": (3, 1)}
TABLE = {"op4_embedding_dedup": "embeddings", "op6_chat": "conversations", "op8_html": "pages"}


@pytest.fixture(scope="module")
def results(spark):
    return {name: queries.QUERIES[name](spark, SMALL).cache() for name in CONTRACT}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_columns_types_and_rows(spark, results, name):
    df = results[name]
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == CONTRACT[name]
    if name != "op3_decontamination":
        assert df.count() == common.table(spark, SMALL, TABLE.get(name, "documents")).count()
    rows = df.collect()
    if name in HELD:
        parts, rest = HELD[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) and 0 <= r.score <= 1 for r in rows)
    if "predicted" in df.columns:
        assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    if "kept" in df.columns:
        key = df.columns[0]
        assert all(r.kept == (r[key] == r.component_id) and r.component_id <= r[key] for r in rows)


def test_texts_come_back_whole(spark, results):
    texts = {r.doc_id: r.text or "" for r in common.table(spark, SMALL, "documents").collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in results["op2_byte_bpe"].collect())
    for r in results["op7_pii"].collect():
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        base = [x for x in spans if x[0] != "term"]
        assert hashlib.sha256(",".join(map(":".join, base)).encode()).hexdigest() == r.base_sha256
        assert [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert all(re.fullmatch(r"[^\W\d_]{4,}", texts[r.doc_id][int(a) : int(b)]) for k, a, b in spans if k == "term")


def test_labels_of_held_out_rows_are_never_read(spark, tmp_path):
    """Turning every held-out label round changes no score."""
    from pyspark.sql import functions as F

    for t in ("documents", "labels"):
        common.table(spark, SMALL, t).write.parquet(f"{tmp_path}/a/{t}.parquet")
    common.table(spark, SMALL, "documents").withColumn("lang", F.when(common.fold("doc_id", 3) == 1, "xx").otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/b/documents.parquet")
    turned = common.table(spark, SMALL, "labels").withColumn("toxic", F.when(common.fold("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    turned.withColumn("quality", F.when(common.fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/b/labels.parquet")
    for name in HELD:
        a, b = ({r.doc_id: tuple(r) for r in queries.QUERIES[name](spark, f"{tmp_path}/{k}").collect()} for k in "ab")
        assert a == b
