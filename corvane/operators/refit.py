"""Router refit: candidates, teacher and student mixtures, losses, acceptance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import prepare


def affected(routing: DataFrame, mask: DataFrame) -> DataFrame:
    """(layer, token): tokens one of whose chosen experts is pruned."""
    gone = F.broadcast(mask.where("pruned").select("layer", "expert"))
    return routing.where("valid").join(gone, ["layer", "expert"], "left_semi").select("layer", "token").distinct()


def affected_rate(routing: DataFrame, mask: DataFrame) -> DataFrame:
    """(layer, slot_rate, token_rate): shares of slots and of tokens that point to a pruned expert."""
    hit = routing.where("valid").join(F.broadcast(mask.select("layer", "expert", "pruned")), ["layer", "expert"])
    per_token = hit.groupBy("layer", "token").agg(F.sum(F.col("pruned").cast("int")).alias("bad"), F.count(F.lit(1)).alias("n"))
    return per_token.groupBy("layer").agg((F.sum("bad") / F.sum("n")).alias("slot_rate"), F.avg((F.col("bad") > 0).cast("double")).alias("token_rate"))


def _ordered(experts="experts"):
    s = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    return F.array_sort(F.transform(experts, lambda e: F.struct((-e["x"]).alias("r"), e["expert"].alias("expert"), s(e["x"]).alias("s"), e["norm"].alias("norm"))))


def candidates(scores: DataFrame, mask: DataFrame, k: int, kept: int) -> DataFrame:
    """(layer, token, slot, expert, s, norm, teacher): the teacher's top k, then the ``kept`` best surviving experts.

    ``scores`` holds all experts of a (layer, token) in one row; the mask joins as one
    array a layer, so nothing is shuffled but the mask.
    """
    gone = mask.where("pruned").groupBy("layer").agg(F.collect_set("expert").alias("gone"))
    rows = scores.join(F.broadcast(gone), "layer", "left").select("layer", "token", "bucket", "valid", _ordered().alias("o"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    left = F.slice(F.filter("o", lambda e: ~F.array_contains("gone", e["expert"])), 1, kept)
    both = rows.select("layer", "token", "bucket", "valid", F.posexplode(F.concat(F.slice("o", 1, k), left)).alias("slot", "e"))
    return both.select("layer", "token", "bucket", "valid", "slot", F.col("e.expert").alias("expert"), F.col("e.s").alias("s"), F.col("e.norm").alias("norm"), (F.col("slot") < k).alias("teacher"))


def mixtures(cands: DataFrame, k: int) -> DataFrame:
    """(layer, token, teacher, student): gate-weighted sums of the experts' outputs (their norms) over the teacher's slots and over the student's best k."""
    valid = cands.where("valid")

    def mix(where: str, name: str):
        w = F.sum(F.when(F.expr(where), F.col("s")))
        return (F.sum(F.when(F.expr(where), F.col("s") * F.col("norm"))) / (w + F.lit(1e-20))).alias(name)

    return valid.groupBy("layer", "token").agg(mix("teacher", "teacher"), mix(f"not teacher and slot < {2 * k}", "student"))


def baseline(cands: DataFrame, k: int) -> DataFrame:
    """(layer, n, mse): the student's squared distance from the teacher before any refit."""
    return mixtures(cands, k).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("teacher") - F.col("student")) ** 2).alias("mse"))


def boundary_rate(scores: DataFrame, mask: DataFrame, k: int, kept: int, student) -> DataFrame:
    """(layer, rate): the share of the student's choices that are the last of its ``kept`` candidates.

    The candidates are the surviving experts that the teacher ranks best; the student
    chooses ``k`` of them by ``student(expert, x)``. All inside one row, then one aggregate.
    """
    gone = mask.where("pruned").groupBy("layer").agg(F.collect_set("expert").alias("gone"))
    left = F.filter("experts", lambda e: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), e["expert"]))
    best = F.slice(F.array_sort(F.transform(left, lambda e: F.struct((-e["x"]).alias("r"), e["expert"].alias("expert"), e["x"].alias("x")))), 1, kept)
    rows = scores.where("valid").join(F.broadcast(gone), "layer", "left").select("layer", best.alias("c"))
    picked = F.slice(F.array_sort(F.transform("c", lambda e, i: F.struct((-student(e["expert"], e["x"])).alias("r"), i.alias("slot")))), 1, k)
    hits = F.size(F.filter(picked, lambda p: p["slot"] == F.size("c") - 1))
    return rows.groupBy("layer").agg((F.sum(hits) / F.sum(F.least(F.size("c"), F.lit(k)))).alias("rate"))


def affected_scores(scores: DataFrame, mask: DataFrame, k: int) -> DataFrame:
    """The valid rows of ``scores`` one of whose best ``k`` experts is pruned."""
    gone = mask.where("pruned").groupBy("layer").agg(F.collect_set("expert").alias("gone"))
    chosen = F.transform(F.slice(_ordered(), 1, k), lambda e: e["expert"])
    return scores.where("valid").join(F.broadcast(gone), "layer").where(F.arrays_overlap(chosen, "gone")).drop("gone")


def _mixed(score: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The mixture of each row's best ``k``, and which these are."""
    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
    w = np.take_along_axis(score, top, 1)
    w = w / (w.sum(1, keepdims=True) + 1e-20)
    return (w * np.take_along_axis(value, top, 1)).sum(1), top


def _kept(width: int, gone) -> np.ndarray:
    return np.setdiff1d(np.arange(width), list(gone if gone is not None else []))


def refit(scores: DataFrame, mask: DataFrame, k: int, rate: float = 1e-2, steps: int = 60, train: DataFrame | None = None) -> DataFrame:
    """(layer, baseline, final, accepted, tried): the router weights of each kept expert fitted to the teacher's mixture, one layer a group.

    ``scores`` also holds the layer's input as ``hidden`` (array<double>); an expert's x
    changes by the product of its fitted weights with it. The bias is carried, not fitted.

    The fit runs on the affected rows of ``scores``, or those of them in ``train`` (layer,
    token), a bounded sample; ``baseline`` and ``tried`` are the losses before it and of its
    last weights over all valid rows of ``scores``, the population. It is accepted only if
    that loss falls; otherwise, and where nothing is affected, the teacher's router stays
    and ``final`` is the baseline.
    """
    prepare(scores.sparkSession)
    gone = mask.where("pruned").groupBy("layer").agg(F.collect_set("expert").alias("gone"))

    def flat(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(gone), "layer", "left").select("layer", F.transform("experts", lambda e: e["x"]).alias("x"), F.transform("experts", lambda e: e["norm"]).alias("norm"), "hidden", "gone")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, out, hidden = np.stack(pdf["x"]), np.stack(pdf["norm"]), np.stack(pdf["hidden"])
        keep = _kept(x.shape[1], pdf["gone"].iloc[0])
        target, _ = _mixed(1 / (1 + np.exp(-x)), out, k)
        weights, m, u = (np.zeros((len(keep), hidden.shape[1])) for _ in range(3))
        for step in range(1, steps + 1):
            score = 1 / (1 + np.exp(-(x[:, keep] + hidden @ weights.T)))
            got, top = _mixed(score, out[:, keep], k)
            err = got - target
            chosen = np.take_along_axis(score, top, 1)
            total = chosen.sum(1, keepdims=True) + 1e-20
            slope = 2 * err[:, None] / len(x) * (np.take_along_axis(out[:, keep], top, 1) - got[:, None]) / total * chosen * (1 - chosen)
            each = np.zeros(score.shape)
            np.put_along_axis(each, top, slope, 1)
            g = each.T @ hidden
            m, u = 0.9 * m + 0.1 * g, 0.999 * u + 0.001 * g * g
            weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-12)
        return pd.DataFrame({"layer": [pdf["layer"].iloc[0]], "weights": [weights.ravel().tolist()]})

    def judge(batches):
        for whole in batches:
            for layer, pdf in whole.groupby("layer"):
                x, out, hidden = np.stack(pdf["x"]), np.stack(pdf["norm"]), np.stack(pdf["hidden"])
                keep, weights = _kept(x.shape[1], pdf["gone"].iloc[0]), pdf["weights"].iloc[0]
                target, _ = _mixed(1 / (1 + np.exp(-x)), out, k)
                change = 0.0 if weights is None else hidden @ np.reshape(weights, (len(keep), -1)).T
                lost = [((_mixed(1 / (1 + np.exp(-(x[:, keep] + b))), out[:, keep], k)[0] - target) ** 2).sum() for b in (0.0, change)]
                yield pd.DataFrame({"layer": [layer], "n": [len(x)], "before": [lost[0]], "after": [lost[1]]})

    rows = affected_scores(scores, mask, k)
    if train is not None:
        rows = rows.join(F.broadcast(train), ["layer", "token"], "left_semi")
    fitted = flat(rows).groupBy("layer").applyInPandas(solve, "layer int, weights array<double>")
    losses = flat(scores.where("valid")).join(F.broadcast(fitted), "layer", "left").mapInPandas(judge, "layer int, n bigint, before double, after double")
    losses = losses.groupBy("layer").agg((F.sum("before") / F.sum("n")).alias("baseline"), (F.sum("after") / F.sum("n")).alias("tried"))
    return losses.select("layer", "baseline", F.least("baseline", "tried").alias("final"), (F.col("tried") < F.col("baseline")).alias("accepted"), "tried")
