"""Readers, and the logical inputs that the fixture tables stand for (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import caption

#: Shape of the routing fixture: experts a layer, experts a token is sent to.
EXPERTS, TOP_K = 16, 4
LAYERS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gate_scores(spark: SparkSession, sf_dir: str, hidden: bool = False) -> DataFrame:
    """One row a (layer, token): bucket, valid and all experts as an array of (expert, x, norm).

    With ``hidden`` also the layer's input, of which x is a linear function: an expert's
    router weights pick one of its values.
    """
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), F.col("label").alias("bucket"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.select("token", "bucket", (F.col("token") % 7 != 0).alias("valid"), "v", F.explode(F.sequence(F.lit(1), F.lit(LAYERS))).alias("layer"))
    experts = F.transform(
        F.sequence(F.lit(0), F.lit(EXPERTS - 1)),
        lambda i: F.struct(i.alias("expert"), F.get("v", (F.col("layer") - 1) * EXPERTS + i).alias("x"), F.abs(F.get("v", ((F.col("layer") - 1) * EXPERTS + i + 17) % 64)).alias("norm")),
    )
    return e.select("layer", "token", "bucket", "valid", experts.alias("experts"), *[F.col("v").alias("hidden")] * hidden)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, bucket, source, text, n_tokens."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("bucket"), "source", "text", F.floor(F.col("n_chars") / 4).alias("n_tokens"))


def source_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket, source, ord, weight of each source that the corpus names (a dimension)."""
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    return corpus_rows(spark, sf_dir).select("bucket", "source").distinct().select("bucket", "source", number.alias("ord"), (F.lit(1.0) + number % 5).alias("weight"))


def tensor_index(spark: SparkSession) -> DataFrame:
    """Generated tensor names: experts (6 tensors each), routers, and others, over four shards."""
    layer = spark.range(1, LAYERS + 1).select(F.col("id").alias("layer"))
    parts = F.explode(F.array(*[F.lit(x) for x in ("gate_proj.weight", "up_proj.weight", "down_proj.weight", "gate_proj.scale", "up_proj.scale", "down_proj.scale")]))
    experts = layer.crossJoin(spark.range(EXPERTS).select(F.col("id").alias("expert"))).select("layer", "expert", parts.alias("part"))
    experts = experts.select(F.concat(F.lit("model.layers."), "layer", F.lit(".mlp.experts."), "expert", F.lit("."), "part").alias("name"))
    gates = layer.select(F.explode(F.array(*[F.concat(F.lit("model.layers."), "layer", F.lit(x)) for x in (".mlp.gate.weight", ".mlp.gate.bias", ".input_norm.weight")])).alias("name"))
    rest = spark.createDataFrame([("model.embed_tokens.weight",), ("lm_head.weight",)], "name string")
    names = experts.union(gates).union(rest)
    return names.select("name", F.concat(F.lit("shard-"), F.pmod(F.length("name"), F.lit(4)).cast("string")).alias("shard"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


CAPTIONS = "id string, video string, conversations array<struct<value:string>>, broken string"


def captions(lines: DataFrame, *order: str) -> DataFrame:
    """(key, caption) of JSON lines (column ``value``): the id or else the video, and its turns' text.

    Lines that are no JSON, lack a key or hold no list are skipped; of lines that share a
    key the first in ``order`` counts.
    """
    row = F.from_json("value", CAPTIONS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("r")
    parsed = lines.select(row, *order).where("r.broken is null and r.conversations is not null")
    texts = F.filter(F.transform("r.conversations", lambda c: c["value"]), F.isnotnull)
    keyed = parsed.select(F.coalesce("r.id", "r.video").alias("key"), caption(texts).alias("caption"), *order).where("key is not null")
    first = keyed.groupBy("key").agg(F.min_by("caption", F.struct(*order)).alias("caption"))
    return first.select("key", "caption")


def capped(rows: DataFrame, n: int, order: str, *keys: str) -> DataFrame:
    """The first ``n`` rows of each source, for a trial run."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def read_accumulators(spark: SparkSession, path: str) -> DataFrame:
    """Stored accumulators with their sums as doubles and counts as longs, whatever types they were written in."""
    acc = spark.read.parquet(path)
    keys = [c for c in ("layer", "bucket", "expert") if c in acc.columns]
    return acc.select(*keys, F.col("cnt").cast("bigint").alias("cnt"), *[F.col(c).cast("double").alias(c) for c in acc.columns if c not in (*keys, "cnt")])


def pruned_from_json(texts: DataFrame) -> DataFrame:
    """(layer, expert) of exported masks (column ``value``), a map from layer names to ids, bare or under ``mask``."""
    wrapped, bare = F.from_json("value", "mask map<string,array<int>>"), F.from_json("value", "map<string,array<int>>")
    maps = texts.select(F.coalesce(wrapped["mask"], bare).alias("m")).select(F.explode("m").alias("name", "ids"))
    return maps.select(F.split_part("name", F.lit("."), F.lit(3)).cast("int").alias("layer"), F.explode(F.array_sort("ids")).alias("expert")).distinct()
