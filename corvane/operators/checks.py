"""Invariants as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def invariants(acc: DataFrame, f: DataFrame) -> DataFrame:
    """(invariant, violations) of accumulators and co-activations against each other."""
    total = acc.groupBy("layer", "expert").agg(F.sum("cnt").alias("cnt"), F.sum("sq").alias("sq"))
    diag = f.where("i = j").select("layer", F.col("i").alias("expert"), "f_cnt", "f_sum").join(total, ["layer", "expert"], "full")
    sums = ["gat", "gsq", "nrm", "nsq", "s", "sq"]
    unfit = reduce(lambda a, b: a | b, [F.isnan(c) | (F.col(c) < 0) | F.col(c).isNull() for c in sums])
    turned = f.select("layer", F.col("i").alias("j"), F.col("j").alias("i"), F.col("f_sum").alias("g"))
    symmetric = f.join(turned, ["layer", "i", "j"], "left").select(F.coalesce(F.abs(F.col("f_sum") - F.col("g")) > 1e-12 + 1e-9 * F.abs("f_sum"), F.lit(True)).alias("bad"))
    counts = f.join(total.select("layer", F.col("expert").alias("i"), F.col("cnt").alias("ci")), ["layer", "i"]).join(total.select("layer", F.col("expert").alias("j"), F.col("cnt").alias("cj")), ["layer", "j"])
    tests = {
        "finite_nonnegative": acc.select(unfit.alias("bad")),
        "layer_routed": acc.groupBy("layer").agg(F.max("cnt").alias("m")).select((F.col("m") <= 0).alias("bad")),
        "f_symmetric": symmetric,
        "diagonal_second_moment": diag.select(F.coalesce(F.abs(F.col("f_sum") / F.col("f_cnt") - F.col("sq") / F.col("cnt")) > 1e-6 * F.abs(F.col("sq") / F.col("cnt")), F.lit(True)).alias("bad")),
        "diagonal_count": diag.select((~F.col("f_cnt").eqNullSafe(F.col("cnt"))).alias("bad")),
        "pair_count_bound": counts.select((F.col("f_cnt") > F.least("ci", "cj")).alias("bad")),
    }
    parts = [t.agg(F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("violations")).select(F.lit(k).alias("invariant"), "violations") for k, t in tests.items()]
    return reduce(DataFrame.unionByName, parts)


def never_falls(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of two snapshots of accumulators where a running count or mass fell or vanished."""
    old = before.select("layer", "bucket", "expert", F.col("cnt").alias("c0"), F.col("s").alias("s0"))
    both = old.join(after, ["layer", "bucket", "expert"], "left")
    return both.where("cnt is null or cnt < c0 or s < s0 - 1e-12")


def routed_identity(routing: DataFrame, k: int) -> DataFrame:
    """(layer, routed, expected, ok): routed slots of valid tokens against valid tokens times k."""
    got = routing.where("valid").groupBy("layer").agg(F.count(F.lit(1)).alias("routed"), (F.countDistinct("token") * k).alias("expected"))
    return got.withColumn("ok", F.col("routed") == F.col("expected"))


def publish_rules(index: DataFrame, files: DataFrame, mask: DataFrame, experts: int) -> DataFrame:
    """(rule, violations) over a tensor index, the files present and the mask applied."""
    kept = mask.where("not pruned").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    expert = index.select(F.regexp_extract("name", r"layers\.([0-9]+)\.mlp\.experts\.([0-9]+)\.", 1).alias("layer"), F.regexp_extract("name", r"layers\.([0-9]+)\.mlp\.experts\.([0-9]+)\.", 2).alias("e")).where("e <> ''")
    limits = expert.select(F.col("layer").cast("int").alias("layer"), F.col("e").cast("int").alias("e")).join(kept, "layer")
    tests = {
        "missing_shards": index.select("shard").distinct().join(files, "shard", "left_anti"),
        "stray_shards": files.join(index, "shard", "left_anti"),
        "empty_shards": files.where("bytes <= 0"),
        "count_not_lower": kept.where(F.col("n") >= experts),
        "ragged_counts": kept.select("n").distinct().agg(F.count(F.lit(1)).alias("k")).where("k <> 1"),
        "expert_index_beyond_count": limits.where("e >= n"),
    }
    parts = [t.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(k).alias("rule"), "violations") for k, t in tests.items()]
    return reduce(DataFrame.unionByName, parts)


def metadata_rules(state: DataFrame, files: DataFrame, required: list[str], expected: int | None = None) -> DataFrame:
    """(rule, violations) over one row (stage, config as JSON) and the files present (name, bytes, spans).

    ``spans`` is the size that a file's header describes, null where it has none.
    """
    block = "struct<experts_before:int>"
    config = state.select("stage", F.from_json("config", f"_reap {block}, _ragged_experts boolean, n_routed_experts int").alias("c")).select("stage", "c.*")
    names = files.select("name").distinct()
    wanted = state.sparkSession.createDataFrame([(x,) for x in required], "name string")
    tests = {
        "stage_not_done": config.where("stage is null or stage <> 'done'"),
        "no_prune_block": config.where("_reap is null"),
        "ragged": config.where("_ragged_experts"),
        "count_not_lower": config.where("_reap is not null and n_routed_experts >= _reap.experts_before"),
        "unexpected_count": config.where(F.lit(False) if expected is None else F.col("n_routed_experts") != expected),
        "required_files": wanted.join(names, "name", "left_anti"),
        "partial_files": names.where(F.col("name").rlike("[.](tmp|incomplete|part)$")),
        "truncated": files.where("spans is not null and bytes < spans"),
    }
    parts = [t.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(k).alias("rule"), "violations") for k, t in tests.items()]
    return reduce(DataFrame.unionByName, parts)
