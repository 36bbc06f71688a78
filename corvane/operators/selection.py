"""Criteria, prune masks, retention, interaction cost and comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.solver import prune_set
from corvane.session import prepare

#: name -> (numerator sum, whether it is divided by the count)
CRITERIA = {"reap_1_1_1": ("s", True), "total_0_1_1": ("s", False), "mean_1_2_2": ("sq", True), "total_0_2_2": ("sq", False)}
FAMILY = CRITERIA | {"frequency": ("cnt", False), "seer": ("gat", False), "ean": ("nrm", False), "man": ("nrm", True), "msan": ("nsq", True)}


def to_prune(experts: int, ratio: float) -> int:
    """Half-to-even rounding, as the count of experts to prune is defined."""
    return round(experts * ratio)


def scores(grid: DataFrame, criterion: str, weight: Column | None = None) -> DataFrame:
    """(layer, expert, score): summed over buckets first, then divided by max(count, 1) if the criterion is a mean."""
    num, mean = FAMILY[criterion]
    w = F.lit(1.0) if weight is None else weight
    score = F.sum(F.col(num) * w)
    if mean:
        score = score / F.greatest(F.sum(F.col("cnt") * w), F.lit(1.0))
    return grid.groupBy("layer", "expert").agg(score.cast("double").alias("score"))


def all_scores(grid: DataFrame, criteria: tuple[str, ...] = tuple(CRITERIA)) -> DataFrame:
    """(criterion, layer, expert, score) of several criteria from one aggregate."""
    terms = []
    for c in criteria:
        num, mean = FAMILY[c]
        terms.append((F.sum(num) / F.greatest(F.sum("cnt"), F.lit(1)) if mean else F.sum(num)).cast("double").alias(c))
    wide = grid.groupBy("layer", "expert").agg(*terms)
    return wide.select("layer", "expert", F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("score")) for c in criteria])).alias("x")).select("x.criterion", "layer", "expert", "x.score")


def first_order(score: DataFrame, n: int, protected: DataFrame | None = None, *more: str) -> DataFrame:
    """(layer, expert, score, rank, pruned): the n lowest scores of each layer, ties to the smaller id.

    Protected experts rank behind all others; if fewer than n are unprotected the plan raises.
    ``more`` columns of ``score`` keep several selections apart.
    """
    if protected is None:
        score = score.withColumn("safe", F.lit(0))
    else:
        score = score.join(F.broadcast(protected.select("layer", "expert").distinct().withColumn("safe", F.lit(1))), ["layer", "expert"], "left").fillna(0, ["safe"])
    w = W.partitionBy(*more, "layer").orderBy("safe", "score", "expert")
    out = score.withColumn("rank", F.row_number().over(w)).withColumn("pruned", F.col("rank") <= n)
    if protected is not None:
        free = F.sum(F.lit(1) - F.col("safe")).over(W.partitionBy(*more, "layer"))
        out = out.withColumn("free", free).where(F.assert_true(F.col("free") >= n, F.lit("more experts to prune than are unprotected")).isNull())
    return out.select(*more, "layer", "expert", "score", "rank", "pruned")


def protected_experts(grid: DataFrame, experts: int, fraction: float) -> DataFrame:
    """(layer, expert) among the top max(1, floor(experts * fraction)) by mass of any bucket."""
    k = max(1, int(experts * fraction))
    w = W.partitionBy("layer", "bucket").orderBy(F.desc("s"), "expert")
    return grid.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("layer", "expert").distinct()


def retention(grid: DataFrame, mask: DataFrame, *more: str) -> DataFrame:
    """(layer, bucket, retention): kept mass over total mass, for each selection that ``more`` columns of the mask name."""
    kept = grid.join(F.broadcast(mask.select(*more, "layer", "expert", "pruned")), ["layer", "expert"])
    return kept.groupBy(*more, "layer", "bucket").agg((F.sum(F.when(~F.col("pruned"), F.col("s")).otherwise(0.0)) / F.greatest(F.sum("s"), F.lit(1e-30))).alias("retention"))


def by_domain(ret: DataFrame, *more: str) -> DataFrame:
    """Unweighted mean over the layers of each bucket's ratios."""
    return ret.groupBy(*more, "bucket").agg(F.avg("retention").alias("retention"))


def worst(domains: DataFrame, *more: str) -> DataFrame:
    """The bucket of least retention (ties to the smaller), its retention, and the mean."""
    least = F.min(F.struct("retention", "bucket"))
    return domains.groupBy(*more).agg(least.alias("m"), F.avg("retention").alias("mean_retention")).select(*more, F.col("m.bucket").alias("worst_bucket"), F.col("m.retention").alias("worst_retention"), "mean_retention")


def interaction_cost(f: DataFrame, mask: DataFrame, *more: str) -> DataFrame:
    """(layer, cost): the share of the layer's F between pruned experts; 0 if F sums to nothing. ``more`` as in :func:`retention`.

    A selection joins as one array a layer, so F is read once for all of them.
    """
    sets = mask.groupBy(*more, "layer").agg(F.collect_set(F.when(F.col("pruned"), F.col("expert"))).alias("gone"))
    both = f.join(F.broadcast(sets), "layer")
    inside = F.sum(F.when(F.array_contains("gone", F.col("i")) & F.array_contains("gone", F.col("j")), F.col("f")).otherwise(0.0))
    return both.groupBy(*more, "layer").agg(F.when(F.sum("f") > 0, inside / F.sum("f")).otherwise(0.0).alias("cost"))


def hope(f: DataFrame, experts: int, n: int, starts: int = 16, protected: DataFrame | None = None) -> DataFrame:
    """(layer, expert, pruned) of least interaction, one layer a group (experts squared values each).

    Protected experts (layer, expert) are never chosen; raises if too few are left.
    """
    prepare(f.sparkSession)
    safe = f.select("layer", F.lit(None).cast("array<int>").alias("safe")).limit(0) if protected is None else protected.groupBy("layer").agg(F.collect_set(F.col("expert").cast("int")).alias("safe"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix, held = np.zeros((experts, experts)), pdf["safe"].iloc[0]
        matrix[pdf["i"], pdf["j"]] = pdf["f"]
        chosen = prune_set(matrix, n, set() if held is None else set(map(int, held)), starts=starts)
        return pd.DataFrame({"layer": pdf["layer"].iloc[0], "expert": range(experts), "pruned": np.isin(np.arange(experts), chosen)})

    return f.select("layer", "i", "j", "f").join(F.broadcast(safe), "layer", "left").groupBy("layer").applyInPandas(solve, "layer int, expert int, pruned boolean")


def select(mode: str, score: DataFrame, f: DataFrame, experts: int, n: int, protected: DataFrame | None = None) -> DataFrame:
    """(layer, expert, pruned) by a selector: ``reap`` takes the lowest scores, ``hope`` the least interaction."""
    if mode == "reap":
        return first_order(score, n, protected).select("layer", "expert", "pruned")
    if mode == "hope":
        return hope(f, experts, n, protected=protected)
    raise ValueError(f"no selector is called {mode}")


def board(grid: DataFrame, f: DataFrame, masks: DataFrame, buckets: list, *keys: str) -> DataFrame:
    """One row a selection (``keys`` of ``masks``): worst bucket, retentions, interaction cost, and a column ``d<bucket>`` for each bucket."""
    doms = by_domain(retention(grid, masks, *keys), *keys)
    cost = interaction_cost(f, masks, *keys).groupBy(*keys).agg(F.avg("cost").alias("mean_cost"), F.max("cost").alias("max_cost"))
    wide = [F.max(F.when(F.col("bucket") == b, F.col("retention"))).alias(f"d{b}") for b in buckets]
    least = F.min(F.struct("retention", "bucket")).alias("m")
    best = doms.groupBy(*keys).agg(least, F.avg("retention").alias("mean_retention"), *wide)
    return best.select(*keys, F.col("m.bucket").alias("worst_bucket"), F.col("m.retention").alias("worst_retention"), "mean_retention", *[f"d{b}" for b in buckets]).join(cost, list(keys))


def upper_median(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, median): the value at place n // 2 of the sorted ones, one that occurs and no mean of two."""
    w = W.partitionBy(*keys)
    placed = rows.select(*keys, value, F.row_number().over(w.orderBy(value)).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return placed.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select(*keys, F.col(value).alias("median"))


def exported(mask: DataFrame, wrapped: bool = True) -> DataFrame:
    """One row with the mask as JSON: a map from layer names to sorted pruned ids, under ``mask`` or bare."""
    layers = mask.where("pruned").groupBy("layer").agg(F.array_sort(F.collect_list("expert")).alias("ids"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("model.layers."), F.col("layer").cast("string")).alias("k"), F.col("ids").alias("v")))))
    return layers.agg(F.to_json(F.struct(entries.alias("mask")) if wrapped else entries).alias("value"))


def best_swap(f: DataFrame, mask: DataFrame) -> DataFrame:
    """The exchange of one pruned for one kept expert that lowers p'Fp most, for each layer (ties to smaller ids)."""
    m = F.broadcast(mask.select("layer", "expert", "pruned"))
    grid = m.select("layer", F.col("expert").alias("i"), F.col("pruned").alias("pi")).join(m.select("layer", F.col("expert").alias("j"), F.col("pruned").alias("pj")), "layer").join(f.select("layer", "i", "j", "f"), ["layer", "i", "j"], "left").fillna(0.0, ["f"])
    reach = grid.groupBy("layer", "i", "pi").agg(F.sum(F.when(F.col("pj"), F.col("f")).otherwise(0.0)).alias("r"), F.sum(F.when(F.col("i") == F.col("j"), F.col("f")).otherwise(0.0)).alias("d"))
    out = reach.where("pi").select("layer", F.col("i").alias("drop_expert"), (F.col("d") - 2 * F.col("r")).alias("less"))
    new = reach.where("not pi").select("layer", F.col("i").alias("add_expert"), (F.col("d") + 2 * F.col("r")).alias("more"))
    pairs = out.join(new, "layer").join(f.select("layer", F.col("i").alias("drop_expert"), F.col("j").alias("add_expert"), "f"), ["layer", "drop_expert", "add_expert"], "left").fillna(0.0, ["f"])
    best = pairs.groupBy("layer").agg(F.min(F.struct(F.round(F.col("less") + F.col("more") - 2 * F.col("f"), 9).alias("delta"), "drop_expert", "add_expert")).alias("b"))
    return best.select("layer", "b.drop_expert", "b.add_expert", "b.delta")


def curve(grid: DataFrame, ranked: DataFrame) -> DataFrame:
    """(layer, bucket, n_pruned, retention) for every budget: pruning is a prefix of one order, so one running sum answers all."""
    w = W.partitionBy("layer", "bucket").orderBy("rank")
    total = F.sum("s").over(W.partitionBy("layer", "bucket"))
    rows = grid.join(F.broadcast(ranked.select("layer", "expert", "rank")), ["layer", "expert"])
    return rows.select("layer", "bucket", F.col("rank").alias("n_pruned"), (F.lit(1.0) - F.sum("s").over(w) / F.greatest(total, F.lit(1e-30))).alias("retention"))


def fitness(curves: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, fitness): the worst bucket's mean retention over layers under (budget_id, layer, n_pruned)."""
    got = curves.join(F.broadcast(budgets), ["layer", "n_pruned"])
    return got.groupBy("budget_id", "bucket").agg(F.avg("retention").alias("r")).groupBy("budget_id").agg(F.min("r").alias("fitness"))


def search_budgets(curves: DataFrame, layers: list[int], experts: int, total: int, generations: int = 300, population: int = 16, seed: int = 0) -> tuple[dict[int, int], float, float]:
    """Evolutionary search of budgets with an exact sum; (best budget, its fitness, the uniform budget's fitness).

    The curve (layers x buckets x experts values) is read once; each candidate is a look-up.
    """
    rows = curves.select("layer", "bucket", "n_pruned", "retention").toPandas()
    buckets = sorted(rows["bucket"].unique())
    at = np.ones((len(layers), len(buckets), experts + 1))
    at[rows["layer"].map({x: k for k, x in enumerate(layers)}), rows["bucket"].map({x: k for k, x in enumerate(buckets)}), rows["n_pruned"]] = rows["retention"]
    low, high, rng = int(0.20 * experts), int(0.75 * experts), np.random.default_rng(seed)

    def value(b: np.ndarray) -> float:
        return float(at[np.arange(len(layers)), :, b].mean(axis=0).min())

    def repaired(b: np.ndarray) -> np.ndarray:
        b = np.clip(b, low, high)
        while b.sum() != total:
            sign = 1 if b.sum() < total else -1
            room = np.flatnonzero(b < high if sign > 0 else b > low)
            b[rng.choice(room)] += sign
        return b

    if not low * len(layers) <= total <= high * len(layers):
        raise ValueError("no budget within the bounds has this total")
    even = repaired(np.full(len(layers), total // len(layers)))
    pool = [even] + [repaired(even + rng.integers(-3, 4, len(layers))) for _ in range(population - 1)]
    marks = [value(b) for b in pool]
    for _ in range(generations):
        child = pool[rng.integers(population)].copy()
        for _ in range(rng.integers(1, 4)):
            a, b = rng.integers(len(layers), size=2)
            units = rng.integers(1, 5)
            child[a], child[b] = child[a] - units, child[b] + units
        child = repaired(child)
        mark, last = value(child), int(np.argmin(marks))
        if mark > marks[last]:
            pool[last], marks[last] = child, mark
    best = int(np.argmax(marks))
    return dict(zip(layers, map(int, pool[best]), strict=True)), marks[best], value(even)


def rank_agreement(a: DataFrame, b: DataFrame, top: int) -> DataFrame:
    """(layer, n_live, spearman, overlap): rank correlation (average ties) where either score is positive, and the shared part of both top sets."""
    both = a.select("layer", "expert", F.col("score").alias("x")).join(b.select("layer", "expert", F.col("score").alias("y")), ["layer", "expert"]).where("x > 0 or y > 0")

    def mean_rank(c: str) -> Column:
        return F.rank().over(W.partitionBy("layer").orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("layer", c)) - 1) / 2

    def in_top(c: str) -> Column:
        return F.row_number().over(W.partitionBy("layer").orderBy(F.desc(c), "expert")) <= top

    ranked = both.select("layer", mean_rank("x").alias("rx"), mean_rank("y").alias("ry"), in_top("x").alias("tx"), in_top("y").alias("ty"))
    return ranked.groupBy("layer").agg(F.count(F.lit(1)).alias("n_live"), F.when(F.count(F.lit(1)) >= 3, F.corr("rx", "ry")).alias("spearman"), (F.sum((F.col("tx") & F.col("ty")).cast("int")) / F.lit(top)).alias("overlap"))


def renumbered(mask: DataFrame) -> DataFrame:
    """(layer, expert, new_expert) of the kept experts, numbered from 0 in their order."""
    return mask.where("not pruned").select("layer", "expert", (F.row_number().over(W.partitionBy("layer").orderBy("expert")) - 1).alias("new_expert"))
