"""Routing observations and their sufficient statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chosen(scores: DataFrame, k: int, bias=None) -> DataFrame:
    """(layer, token, bucket, valid, total, c): the ``k`` chosen experts of each row as an array, and the sum of their scores.

    ``sigmoid(x)`` plus ``bias(expert)`` chooses, ties to the smaller expert. All inside one row: no shuffle.
    """
    sigmoid = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    rank = lambda e: -(sigmoid(e["x"]) + bias(e["expert"])) if bias else -e["x"]
    ordered = F.array_sort(F.transform("experts", lambda e: F.struct(rank(e).alias("r"), e["expert"].alias("expert"), sigmoid(e["x"]).alias("s"), e["norm"].alias("norm"))))
    top = scores.select("layer", "token", "bucket", "valid", F.slice(ordered, 1, k).alias("c"))
    return top.select("layer", "token", "bucket", "valid", F.aggregate("c", F.lit(0.0), lambda a, e: a + e["s"]).alias("total"), "c")


def top_k(scores: DataFrame, k: int, bias=None) -> DataFrame:
    """(layer, token, bucket, valid, slot, expert, gate, norm): the chosen experts, weighed by their unbiased score over its sum."""
    out = chosen(scores, k, bias).select("layer", "token", "bucket", "valid", "total", F.posexplode("c").alias("slot", "e"))
    return out.select("layer", "token", "bucket", "valid", "slot", F.col("e.expert").alias("expert"), (F.col("e.s") / (F.col("total") + F.lit(1e-20))).alias("gate"), F.col("e.norm").alias("norm"))


def accumulators(routing: DataFrame, *keys: str) -> DataFrame:
    """Seven sums of the valid rows for each (layer, bucket, expert): one hash aggregate, combined before the shuffle."""
    s = F.col("gate") * F.col("norm")
    sums = {"gat": F.col("gate"), "gsq": F.col("gate") ** 2, "nrm": F.col("norm"), "nsq": F.col("norm") ** 2, "s": s, "sq": s * s}
    return routing.where("valid").groupBy(*(keys or ("layer", "bucket", "expert"))).agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(n) for n, c in sums.items()])


def full_grid(acc: DataFrame, experts: int) -> DataFrame:
    """The accumulators with a row of zeros for every (layer, bucket, expert) that was never routed."""
    cells = acc.select("layer").distinct().join(F.broadcast(acc.select("bucket").distinct())).select("layer", "bucket", F.explode(F.sequence(F.lit(0), F.lit(experts - 1))).alias("expert"))
    return cells.join(acc, ["layer", "bucket", "expert"], "left").fillna(0)


def coactivation(routing: DataFrame) -> DataFrame:
    """(layer, i, j, f_sum, f_cnt) over ordered pairs of a token's slots and the diagonal.

    For observations that come slot by slot; one group of k slots a token is exploded
    into k x k pairs: no self-join.
    """
    slots = routing.where("valid").groupBy("layer", "token").agg(F.collect_list(F.struct("expert", (F.col("gate") * F.col("norm")).alias("s"))).alias("e"))
    pairs = slots.select("layer", F.explode("e").alias("a"), "e").select("layer", "a", F.explode("e").alias("b"))
    return pairs.groupBy("layer", F.col("a.expert").alias("i"), F.col("b.expert").alias("j")).agg(F.sum(F.col("a.s") * F.col("b.s")).alias("f_sum"), F.count(F.lit(1)).alias("f_cnt"))


def coactivation_of(scores: DataFrame, k: int, bias=None) -> DataFrame:
    """(layer, i, j, f_sum, f_cnt) straight from rows of expert scores: a row's k x k pairs never leave it before the aggregate."""
    rows = chosen(scores.where("valid"), k, bias)
    s = F.transform("c", lambda e: F.struct(e["expert"].alias("expert"), (e["s"] / (F.col("total") + F.lit(1e-20)) * e["norm"]).alias("s")))
    pairs = rows.select("layer", s.alias("e")).select("layer", F.explode(F.flatten(F.transform("e", lambda a: F.transform("e", lambda b: F.struct(a["expert"].alias("i"), b["expert"].alias("j"), (a["s"] * b["s"]).alias("v")))))).alias("p"))
    return pairs.groupBy("layer", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.sum("p.v").alias("f_sum"), F.count(F.lit(1)).alias("f_cnt"))


def conditional_mean(coact: DataFrame) -> DataFrame:
    """F with ``f`` = f_sum / max(f_cnt, 1)."""
    return coact.withColumn("f", F.col("f_sum") / F.greatest("f_cnt", F.lit(1)))


def coverage(acc: DataFrame, experts: int) -> DataFrame:
    """Share of each layer's experts that any valid token was sent to."""
    return acc.where("cnt > 0").groupBy("layer").agg((F.countDistinct("expert") / F.lit(experts)).alias("coverage"))


def liveness(acc: DataFrame) -> DataFrame:
    """Mass of each bucket, and whether it has any."""
    return acc.groupBy("bucket").agg(F.sum("s").alias("mass")).withColumn("live", F.col("mass") > 0)


def require_live(acc: DataFrame, allow: tuple = ()) -> DataFrame:
    """The accumulators; raises at run time if a bucket outside ``allow`` has no mass."""
    ok = liveness(acc).select("bucket", F.expr("live").alias("live") if not allow else (F.col("live") | F.col("bucket").isin(*allow)).alias("live"))
    return acc.join(F.broadcast(ok), "bucket").where(F.assert_true("live", F.concat(F.lit("dead bucket "), F.col("bucket").cast("string"))).isNull()).drop("live")
