"""Tensor indexes as relations: what applying a mask does to every named tensor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPERT = r"^(.*\.layers\.([0-9]+)\.mlp\.experts\.)([0-9]+)(\..*)$"
GATE = r"^.*\.layers\.([0-9]+)\.mlp\.gate\.(weight|bias)$"


def plan(index: DataFrame, renumbering: DataFrame, mask: DataFrame) -> DataFrame:
    """(name, shard, action, new_name): dropped, renumbered, sliced or copied."""
    parsed = index.select("name", "shard", F.regexp_extract("name", EXPERT, 1).alias("head"), F.regexp_extract("name", EXPERT, 2).alias("l"), F.regexp_extract("name", EXPERT, 3).alias("e"), F.regexp_extract("name", EXPERT, 4).alias("tail"), F.regexp_extract("name", GATE, 1).alias("g"))
    parsed = parsed.withColumn("layer", F.when(F.col("l") != "", F.col("l")).when(F.col("g") != "", F.col("g")).cast("int")).withColumn("expert", F.when(F.col("e") != "", F.col("e")).cast("int"))
    pruned_layers = F.broadcast(mask.select("layer").distinct().withColumn("masked", F.lit(True)))
    joined = parsed.join(pruned_layers, "layer", "left").join(F.broadcast(renumbering), ["layer", "expert"], "left")
    action = (
        F.when(F.col("expert").isNotNull() & F.col("masked") & F.col("new_expert").isNull(), "dropped")
        .when(F.col("expert").isNotNull() & F.col("masked"), "renumbered")
        .when((F.col("g") != "") & F.col("masked"), "sliced")
        .otherwise("copied")
    )
    new = F.when(action == "renumbered", F.concat("head", F.col("new_expert").cast("string"), "tail")).when(action == "dropped", F.lit(None)).otherwise(F.col("name"))
    return joined.select("name", "shard", action.alias("action"), new.alias("new_name"))


def sliced_rows(rows: DataFrame, renumbering: DataFrame) -> DataFrame:
    """Router rows (layer, expert, values) of the kept experts under their new numbers."""
    return rows.join(F.broadcast(renumbering), ["layer", "expert"]).select("layer", F.col("new_expert").alias("expert"), "values")


def shard_integrity(index: DataFrame, files: DataFrame) -> DataFrame:
    """(shard, state): referenced but absent, or present but unreferenced."""
    named = index.select("shard").distinct()
    missing = named.join(files.select("shard"), "shard", "left_anti").select("shard", F.lit("missing").alias("state"))
    return missing.union(files.select("shard").join(named, "shard", "left_anti").select("shard", F.lit("stray").alias("state")))


def first_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """(layer, at): the first place where two ordered id lists of a layer (column ``ids``) differ."""
    x = a.select("layer", F.posexplode("ids").alias("at", "x"))
    y = b.select("layer", F.posexplode("ids").alias("at", "y"))
    return x.join(y, ["layer", "at"], "full").where(~F.col("x").eqNullSafe(F.col("y"))).groupBy("layer").agg(F.min("at").alias("at"))


def under(index: DataFrame, prefix: str) -> DataFrame:
    """The tensors below a module; the prefix ends with a dot, so that layer 1 is not layer 11."""
    return index.where(F.col("name").startswith(prefix if prefix.endswith(".") else prefix + "."))


def rebuilt(planned: DataFrame) -> DataFrame:
    """(name, shard) of the tensors that a plan leaves, under their new names."""
    return planned.where("action <> 'dropped'").select(F.col("new_name").alias("name"), "shard")


def pruned_config(mask: DataFrame, experts: int) -> DataFrame:
    """One row: n_routed_experts, ragged, per_layer, experts_before. Unequal counts keep the old number and are marked ragged."""
    kept = mask.groupBy("layer").agg((F.lit(experts) - F.sum(F.col("pruned").cast("int"))).cast("int").alias("n"))
    uniform = F.min("n") == F.max("n")
    layers = F.array_sort(F.collect_list(F.struct("layer", "n")))
    return kept.agg(F.when(uniform, F.min("n")).otherwise(F.lit(experts)).alias("n_routed_experts"), (~uniform).alias("ragged"), F.when(~uniform, F.map_from_entries(layers)).alias("per_layer")).withColumn("experts_before", F.lit(experts))


def untrained_layers(mask: DataFrame, routers: DataFrame) -> DataFrame:
    """(layer): layers that a mask prunes and no refitted router covers."""
    return mask.where("pruned").select("layer").distinct().join(routers.select("layer").distinct(), "layer", "left_anti")


def require_keep_order(renumbering: DataFrame, routers: DataFrame) -> DataFrame:
    """The routers (layer, ids, ...); raises at run time where ``ids`` aren't the layer's kept experts in their order."""
    order = renumbering.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("new_expert", "expert"))).alias("o")).select("layer", F.transform("o", lambda x: x["expert"]).alias("kept"))
    checked = routers.join(F.broadcast(order), "layer")
    return checked.where(F.assert_true(F.col("ids").cast("array<bigint>") == F.col("kept").cast("array<bigint>"), F.concat(F.lit("router kept other experts than the mask in layer "), F.col("layer").cast("string"))).isNull()).drop("kept")
