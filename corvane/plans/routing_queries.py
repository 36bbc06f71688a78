"""Registered queries on routing data, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import checks, refit, routing as R, selection as S
from corvane.operators.corpus import smallest_hash
from corvane.sources import tables as T

E, K = T.EXPERTS, T.TOP_K
N = S.to_prune(E, 0.5)
N_SAFE = S.to_prune(E, 0.25)
PROTECT = 0.08
BUDGETS = {"uniform": (8, 8, 8, 8), "tilted": (6, 10, 8, 8), "spread": (10, 5, 9, 8)}

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


def r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


def routing(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(T.gate_scores(spark, d), K)


def grid(spark: SparkSession, d: str) -> DataFrame:
    return R.full_grid(R.accumulators(routing(spark, d)), E)


def mask(spark: SparkSession, d: str, criterion: str = "reap_1_1_1") -> DataFrame:
    return S.first_order(S.scores(grid(spark, d), criterion), N)


def coact(spark: SparkSession, d: str) -> DataFrame:
    return R.conditional_mean(R.coactivation_of(T.gate_scores(spark, d), K))


# The SQL side: one chain of common table expressions that each query continues.
SCORED = """
obs AS (SELECT vec_id AS token, label AS bucket, p // 16 + 1 AS layer, p % 16 AS expert, CAST(embedding[p + 1] AS DOUBLE) AS x,
  abs(CAST(embedding[(p + 17) % 64 + 1] AS DOUBLE)) AS norm, vec_id % 7 <> 0 AS valid FROM embeddings, (SELECT unnest(range(64)) AS p) q),
ranked AS (SELECT *, 1 / (1 + exp(-x)) AS sg, row_number() OVER (PARTITION BY layer, token ORDER BY x DESC, expert) AS rn FROM obs)"""
ROUTING = SCORED + """,
routing AS (SELECT layer, bucket, token, rn - 1 AS slot, expert, sg / (sum(sg) OVER (PARTITION BY layer, token) + 1e-20) AS gate, norm, valid FROM ranked WHERE rn <= 4)"""
GRID = ROUTING + """,
acc AS (SELECT layer, bucket, expert, count(*) AS cnt, sum(gate) AS gat, sum(gate * gate) AS gsq, sum(norm) AS nrm, sum(norm * norm) AS nsq,
  sum(gate * norm) AS s, sum(gate * norm * gate * norm) AS sq FROM routing WHERE valid GROUP BY layer, bucket, expert),
grid AS (SELECT l.layer, b.bucket, e.expert, coalesce(cnt, 0) AS cnt, coalesce(gat, 0) AS gat, coalesce(gsq, 0) AS gsq, coalesce(nrm, 0) AS nrm,
  coalesce(nsq, 0) AS nsq, coalesce(s, 0) AS s, coalesce(sq, 0) AS sq
  FROM (SELECT DISTINCT layer FROM acc) l CROSS JOIN (SELECT DISTINCT bucket FROM acc) b CROSS JOIN (SELECT unnest(range(16)) AS expert) e
  LEFT JOIN acc USING (layer, bucket, expert)),
sums AS (SELECT layer, expert, sum(cnt) AS cnt, sum(gat) AS gat, sum(nrm) AS nrm, sum(nsq) AS nsq, sum(s) AS s, sum(sq) AS sq FROM grid GROUP BY layer, expert),
crit AS (SELECT layer, expert, 'reap_1_1_1' AS criterion, s / greatest(cnt, 1) AS score FROM sums UNION ALL SELECT layer, expert, 'total_0_1_1', s FROM sums
  UNION ALL SELECT layer, expert, 'mean_1_2_2', sq / greatest(cnt, 1) FROM sums UNION ALL SELECT layer, expert, 'total_0_2_2', sq FROM sums),
masks AS (SELECT criterion, layer, expert, score, row_number() OVER (PARTITION BY criterion, layer ORDER BY score, expert) AS rk FROM crit),
ret AS (SELECT criterion, layer, bucket, sum(CASE WHEN rk > 8 THEN s ELSE 0 END) / greatest(sum(s), 1e-30) AS retention FROM grid JOIN masks USING (layer, expert) GROUP BY criterion, layer, bucket),
dom AS (SELECT criterion, bucket, avg(retention) AS retention FROM ret GROUP BY criterion, bucket)"""
COACT = GRID + """,
f AS (SELECT a.layer, a.expert AS i, b.expert AS j, sum(a.gate * a.norm * b.gate * b.norm) AS f_sum, count(*) AS f_cnt
  FROM routing a JOIN routing b ON a.layer = b.layer AND a.token = b.token WHERE a.valid AND b.valid GROUP BY a.layer, a.expert, b.expert),
ff AS (SELECT *, f_sum / greatest(f_cnt, 1) AS f FROM f)"""
HOPE = COACT + """,
subsets AS (SELECT m FROM (SELECT unnest(range(65536)) AS m) q WHERE bit_count(m) = 8),
objective AS (SELECT layer, m, sum(f) AS obj FROM subsets JOIN ff ON (m >> i) & 1 = 1 AND (m >> j) & 1 = 1 GROUP BY layer, m),
best AS (SELECT layer, arg_min(m, obj) AS m FROM objective GROUP BY layer),
hope AS (SELECT layer, expert, (m >> expert) & 1 = 1 AS pruned FROM best, (SELECT unnest(range(16)) AS expert) e)"""


@query(f"WITH {ROUTING} SELECT layer, bucket, token, slot, expert, round(gate, 9) AS gate, round(norm, 9) AS norm, valid FROM routing")
def routing_observations(spark, d):
    return routing(spark, d).select("layer", "bucket", "token", "slot", "expert", r("gate", 9), r("norm", 9), "valid")


@query(f"""WITH {SCORED}, choice AS (SELECT *, row_number() OVER (PARTITION BY layer, token ORDER BY sg + 0.01 * (expert % 3) DESC, expert) AS c FROM ranked)
SELECT layer, token, c - 1 AS slot, expert, round(sg / (sum(sg) OVER (PARTITION BY layer, token) + 1e-20), 9) AS weight FROM choice WHERE c <= 4""")
def gate_topk(spark, d):
    """Router top-k with a bias that selects but doesn't weigh."""
    top = R.top_k(T.gate_scores(spark, d), K, bias=lambda e: F.lit(0.01) * (e % 3))
    return top.select("layer", "token", "slot", "expert", F.round("gate", 9).alias("weight"))


@query(f"WITH {GRID} SELECT layer, bucket, expert, cnt, round(gat, 6) AS gat, round(gsq, 6) AS gsq, round(nrm, 6) AS nrm, round(nsq, 6) AS nsq, round(s, 6) AS s, round(sq, 6) AS sq FROM acc")
def saliency_accumulators(spark, d):
    return R.accumulators(routing(spark, d)).select("layer", "bucket", "expert", "cnt", *[r(c) for c in ("gat", "gsq", "nrm", "nsq", "s", "sq")])


@query(f"WITH {GRID} SELECT layer, bucket, CAST(sum(cnt) AS BIGINT) AS cnt, round(sum(s), 6) AS mass FROM acc GROUP BY ROLLUP (layer, bucket)")
def saliency_rollup(spark, d):
    return R.accumulators(routing(spark, d)).rollup("layer", "bucket").agg(F.sum("cnt").alias("cnt"), F.round(F.sum("s"), 6).alias("mass"))


@query(f"WITH {COACT} SELECT layer, i, j, round(f_sum, 6) AS f_sum, f_cnt, round(f, 6) AS f FROM ff")
def coactivation_f(spark, d):
    return coact(spark, d).select("layer", "i", "j", r("f_sum"), "f_cnt", r("f"))


@query(f"WITH {GRID} SELECT criterion, layer, expert, round(score, 6) AS score FROM crit")
def criterion_scores(spark, d):
    return S.all_scores(grid(spark, d)).select("criterion", "layer", "expert", r("score"))


@query(f"WITH {GRID} SELECT layer, expert, round(sum(s * (1.0 + bucket % 3)) / greatest(sum(cnt * (1.0 + bucket % 3)), 1), 6) AS score FROM grid GROUP BY layer, expert")
def criterion_scores_weighted(spark, d):
    return S.scores(grid(spark, d), "reap_1_1_1", F.lit(1.0) + F.col("bucket") % 3).select("layer", "expert", r("score"))


@query(f"""WITH {GRID} SELECT layer, expert, CAST(cnt AS DOUBLE) AS frequency, round(gat, 6) AS seer, round(nrm, 6) AS ean, round(s / greatest(cnt, 1), 6) AS reap_1_1_1,
round(nrm / greatest(cnt, 1), 6) AS man, round(nsq / greatest(cnt, 1), 6) AS msan, round(s, 6) AS total_0_1_1, round(sq, 6) AS total_0_2_2 FROM sums""")
def criterion_family(spark, d):
    names = ("frequency", "seer", "ean", "reap_1_1_1", "man", "msan", "total_0_1_1", "total_0_2_2")
    terms = [F.sum(num) / F.greatest(F.sum("cnt"), F.lit(1)) if mean else F.sum(num) for num, mean in (S.FAMILY[n] for n in names)]
    return grid(spark, d).groupBy("layer", "expert").agg(*[F.round(t.cast("double"), 6).alias(n) for t, n in zip(terms, names, strict=True)])


@query(f"WITH {GRID} SELECT bucket, round(sum(s), 6) AS mass, sum(s) > 0 AS live FROM acc GROUP BY bucket")
def domain_liveness(spark, d):
    return R.liveness(R.accumulators(routing(spark, d))).select("bucket", r("mass"), "live")


@query(f"WITH {GRID} SELECT layer, count(DISTINCT expert) / 16.0::DOUBLE AS coverage FROM acc WHERE cnt > 0 GROUP BY layer")
def expert_coverage(spark, d):
    return R.coverage(R.accumulators(routing(spark, d)), E)


def _mask_query(criterion: str) -> None:
    def run(spark, d):
        return mask(spark, d, criterion).select("layer", "expert", "rank", "pruned")
    run.__name__ = f"reap_mask_{criterion}"
    query(f"WITH {GRID} SELECT layer, expert, rk AS rank, rk <= 8 AS pruned FROM masks WHERE criterion = '{criterion}'")(run)


for _c in S.CRITERIA:
    _mask_query(_c)

_SAFE = f"safe AS (SELECT DISTINCT layer, expert FROM (SELECT *, row_number() OVER (PARTITION BY layer, bucket ORDER BY s DESC, expert) AS k FROM grid) q WHERE k <= {max(1, int(E * PROTECT))})"


@query(f"WITH {GRID}, {_SAFE} SELECT layer, expert FROM safe")
def protected_experts(spark, d):
    return S.protected_experts(grid(spark, d), E, PROTECT)


@query(f"""WITH {GRID}, {_SAFE}, o AS (SELECT layer, expert, row_number() OVER (PARTITION BY layer ORDER BY CASE WHEN safe.expert IS NULL THEN 0 ELSE 1 END, score, crit.expert) AS rank
FROM crit LEFT JOIN safe USING (layer, expert) WHERE criterion = 'reap_1_1_1') SELECT layer, expert, rank <= {N_SAFE} AS pruned FROM o""")
def reap_mask_protected(spark, d):
    g = grid(spark, d)
    return S.first_order(S.scores(g, "reap_1_1_1"), N_SAFE, S.protected_experts(g, E, PROTECT)).select("layer", "expert", "pruned")


@query(f"WITH {GRID} SELECT layer, bucket, round(retention, 6) AS retention FROM ret WHERE criterion = 'reap_1_1_1'")
def retention_by_layer_domain(spark, d):
    return S.retention(grid(spark, d), mask(spark, d)).select("layer", "bucket", r("retention"))


@query(f"WITH {GRID} SELECT bucket, round(retention, 6) AS retention FROM dom WHERE criterion = 'reap_1_1_1'")
def retention_by_domain(spark, d):
    return S.by_domain(S.retention(grid(spark, d), mask(spark, d))).select("bucket", r("retention"))


@query(f"WITH {GRID} SELECT arg_min(bucket, retention) AS worst_bucket, round(min(retention), 6) AS worst_retention, round(avg(retention), 6) AS mean_retention FROM dom WHERE criterion = 'reap_1_1_1'")
def worst_domain(spark, d):
    return S.worst(S.by_domain(S.retention(grid(spark, d), mask(spark, d)))).select("worst_bucket", r("worst_retention"), r("mean_retention"))


_COST = "cost AS (SELECT ff.layer, a.criterion, sum(CASE WHEN a.rk <= 8 AND b.rk <= 8 THEN f ELSE 0 END) / sum(f) AS cost FROM ff JOIN masks a ON a.layer = ff.layer AND a.expert = i JOIN masks b ON b.layer = ff.layer AND b.expert = j AND a.criterion = b.criterion GROUP BY ff.layer, a.criterion)"


@query(f"WITH {COACT}, {_COST} SELECT layer, round(cost, 6) AS cost FROM cost WHERE criterion = 'reap_1_1_1'")
def interaction_cost(spark, d):
    return S.interaction_cost(coact(spark, d), mask(spark, d)).select("layer", r("cost"))


@query(f"""WITH {COACT}, {_COST}, c AS (SELECT criterion, avg(cost) AS mean_cost, max(cost) AS max_cost FROM cost GROUP BY criterion),
w AS (SELECT criterion, arg_min(bucket, retention) AS worst_bucket, min(retention) AS worst_retention, avg(retention) AS mean_retention FROM dom GROUP BY criterion),
p AS (SELECT criterion, {", ".join(f"round(max(CASE WHEN bucket = {b} THEN retention END), 6) AS d{b}" for b in range(10))} FROM dom GROUP BY criterion)
SELECT criterion, row_number() OVER (ORDER BY worst_retention DESC, mean_cost, criterion) AS place, worst_bucket, round(worst_retention, 6) AS worst_retention, round(mean_retention, 6) AS mean_retention,
round(mean_cost, 6) AS mean_cost, round(max_cost, 6) AS max_cost, {", ".join(f"d{b}" for b in range(10))} FROM w JOIN c USING (criterion) JOIN p USING (criterion)""")
def criterion_leaderboard(spark, d):
    g = grid(spark, d)
    masks = S.first_order(S.all_scores(g), N, None, "criterion")
    board = S.board(g, coact(spark, d), masks, list(range(10)), "criterion")
    place = F.row_number().over(S.W.orderBy(F.desc("worst_retention"), "mean_cost", "criterion")).alias("place")
    return board.select("criterion", place, "worst_bucket", r("worst_retention"), r("mean_retention"), r("mean_cost"), r("max_cost"), *[r(f"d{b}") for b in range(10)])


@query(f"""WITH {HOPE}, allm AS (SELECT 'reap' AS mode, criterion, layer, expert, rk <= 8 AS pruned FROM masks UNION ALL SELECT 'hope', criterion, layer, expert, pruned FROM hope, (SELECT DISTINCT criterion FROM masks) c),
ar AS (SELECT mode, criterion, layer, bucket, sum(CASE WHEN pruned THEN 0 ELSE s END) / greatest(sum(s), 1e-30) AS retention FROM grid JOIN allm USING (layer, expert) GROUP BY ALL),
ad AS (SELECT mode, criterion, bucket, avg(retention) AS retention FROM ar GROUP BY ALL),
ac AS (SELECT mode, criterion, ff.layer, sum(CASE WHEN a.pruned AND b.pruned THEN f ELSE 0 END) / sum(f) AS cost FROM ff JOIN allm a ON a.layer = ff.layer AND a.expert = i JOIN allm b USING (mode, criterion) WHERE b.layer = ff.layer AND b.expert = j GROUP BY mode, criterion, ff.layer),
c AS (SELECT mode, criterion, round(avg(cost), 9) AS mean_cost FROM ac GROUP BY ALL), w AS (SELECT mode, criterion, arg_min(bucket, retention) AS worst_bucket, round(min(retention), 9) AS worst_retention FROM ad GROUP BY ALL)
SELECT mode, criterion, worst_bucket, round(worst_retention, 6) AS worst_retention, round(mean_cost, 6) AS mean_cost, row_number() OVER (ORDER BY mean_cost, worst_retention DESC, criterion) AS by_cost,
row_number() OVER (ORDER BY worst_retention DESC, criterion, mode) AS by_retention FROM w JOIN c USING (mode, criterion)""")
def selector_leaderboard(spark, d):
    """Every criterion with both selectors, ranked by interaction cost and by the worst bucket's retention."""
    g, f = grid(spark, d), coact(spark, d)
    reap = S.first_order(S.all_scores(g), N, None, "criterion").select(F.lit("reap").alias("mode"), "criterion", "layer", "expert", "pruned")
    names = spark.createDataFrame([(c,) for c in S.CRITERIA], "criterion string")
    least = S.hope(f, E, N).join(F.broadcast(names)).select(F.lit("hope").alias("mode"), "criterion", "layer", "expert", "pruned")
    board = S.board(g, f, reap.unionByName(least), [], "mode", "criterion").select("mode", "criterion", "worst_bucket", r("worst_retention", 9), r("mean_cost", 9))
    by_cost, by_retention = (F.row_number().over(S.W.orderBy(*o)) for o in (("mean_cost", F.desc("worst_retention"), "criterion"), (F.desc("worst_retention"), "criterion", "mode")))
    ranked = board.select("*", by_cost.alias("by_cost"), by_retention.alias("by_retention"))
    return ranked.select("mode", "criterion", "worst_bucket", r("worst_retention"), r("mean_cost"), "by_cost", "by_retention")


@query(f"WITH {HOPE} SELECT layer, expert, pruned FROM hope")
def hope_mask(spark, d):
    return S.hope(coact(spark, d), E, N)


@query(f"""WITH {COACT}, {_SAFE}, banned AS (SELECT layer, CAST(sum(1 << expert) AS BIGINT) AS b FROM safe GROUP BY layer), subsets AS (SELECT m FROM (SELECT unnest(range(65536)) AS m) q WHERE bit_count(m) = {N_SAFE}),
objective AS (SELECT ff.layer, m, sum(f) AS obj FROM subsets JOIN banned ON m & b = 0 JOIN ff ON ff.layer = banned.layer AND (m >> i) & 1 = 1 AND (m >> j) & 1 = 1 GROUP BY ff.layer, m),
best AS (SELECT layer, arg_min(m, obj) AS m FROM objective GROUP BY layer) SELECT layer, expert, (m >> expert) & 1 = 1 AS pruned FROM best, (SELECT unnest(range(16)) AS expert) e""")
def hope_mask_protected(spark, d):
    """Least interaction without the experts that any bucket needs most."""
    return S.select("hope", None, coact(spark, d), E, N_SAFE, S.protected_experts(grid(spark, d), E, PROTECT))


@query(f"WITH {GRID} SELECT bucket, round(retention, 6) AS retention, row_number() OVER (ORDER BY retention, bucket) AS place FROM dom WHERE criterion = 'reap_1_1_1'")
def domain_table(spark, d):
    """Buckets from the worst kept to the best."""
    doms = S.by_domain(S.retention(grid(spark, d), mask(spark, d)))
    return doms.select("bucket", r("retention"), F.row_number().over(S.W.orderBy("retention", "bucket")).alias("place"))


@query(f"""WITH {GRID}, o AS (SELECT bucket, retention, row_number() OVER (PARTITION BY bucket ORDER BY retention) AS k, count(*) OVER (PARTITION BY bucket) AS n FROM ret WHERE criterion = 'reap_1_1_1')
SELECT bucket, round(retention, 6) AS median FROM o WHERE k = n // 2 + 1""")
def upper_median(spark, d):
    """Each bucket's upper median over layers."""
    return S.upper_median(S.retention(grid(spark, d), mask(spark, d)), "retention", "bucket").select("bucket", r("median"))


@query(f"WITH {GRID} SELECT layer, expert FROM masks WHERE criterion = 'reap_1_1_1' AND rk <= 8")
def mask_export_import(spark, d):
    """The mask written as JSON, two layers bare and two under a key, and read again."""
    m = mask(spark, d)
    texts = S.exported(m.where("layer <= 2")).unionByName(S.exported(m.where("layer > 2"), wrapped=False))
    return T.pruned_from_json(texts)


@query(f"WITH {GRID} SELECT layer, bucket, expert, cnt, round(s, 3) AS s FROM acc")
def accumulators_reload(spark, d):
    """Accumulators stored with 32-bit sums and read as doubles."""
    from corvane.streaming.state import scratch

    at = scratch(spark, "accumulators")
    acc = R.accumulators(routing(spark, d))
    acc.select("layer", "bucket", "expert", F.col("cnt").cast("int").alias("cnt"), F.col("s").cast("decimal(28,9)").alias("s")).write.parquet(at)
    return T.read_accumulators(spark, at).select("layer", "bucket", "expert", "cnt", r("s", 3))


@query(f"""WITH {GRID}, l AS (SELECT bucket, sum(s) AS mass FROM grid WHERE bucket <> 3 GROUP BY bucket UNION ALL SELECT 3, 0.0)
SELECT bucket, round(mass, 6) AS mass, mass > 0 AS live, mass <= 0 AND bucket <> 5 AS refused FROM l""")
def dead_domain_refusal(spark, d):
    """Liveness where one bucket has lost its mass: it is refused unless it is allowed."""
    acc = R.accumulators(routing(spark, d)).withColumn("s", F.when(F.col("bucket") == 3, 0.0).otherwise(F.col("s")))
    return R.liveness(acc).select("bucket", r("mass"), "live", (~F.col("live") & (F.col("bucket") != 5)).alias("refused"))


@query(f"""WITH {GRID}, m AS (SELECT layer, expert FROM masks WHERE criterion = 'reap_1_1_1' AND rk > 8),
c AS (SELECT r.layer, token, r.expert, x, row_number() OVER (PARTITION BY r.layer, token ORDER BY x DESC, r.expert) AS kr FROM ranked r JOIN m USING (layer, expert) WHERE valid),
p AS (SELECT layer, token, kr, row_number() OVER (PARTITION BY layer, token ORDER BY 1 / (1 + exp(-x)) + 0.05 * (expert * 7 % 5) DESC, kr) AS k FROM c WHERE kr <= 6)
SELECT layer, round(avg(CASE WHEN kr = 6 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM p WHERE k <= 4 GROUP BY layer""")
def refit_boundary(spark, d):
    """How often a student with other preferences takes the last of six candidates."""
    def student(expert, x):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-x)) + F.lit(0.05) * (expert * 7 % 5)

    return refit.boundary_rate(T.gate_scores(spark, d), mask(spark, d), K, 6, student).select("layer", r("rate"))


@query(f"""WITH RECURSIVE {GRID}, xs AS (SELECT layer, expert, s / sum(s) OVER (PARTITION BY layer) * 16 AS x FROM sums), t(layer, it, lo, hi) AS (SELECT layer, 0, min(x) - 1.0, max(x) FROM xs GROUP BY layer
UNION ALL SELECT t.layer, any_value(it) + 1, CASE WHEN sum(least(1, greatest(0, x - (lo + hi) / 2))) > 8 THEN any_value((lo + hi) / 2) ELSE any_value(lo) END, CASE WHEN sum(least(1, greatest(0, x - (lo + hi) / 2))) > 8 THEN any_value(hi) ELSE any_value((lo + hi) / 2) END
FROM t JOIN xs ON xs.layer = t.layer WHERE it < 60 GROUP BY t.layer)
SELECT layer, expert, round(least(1, greatest(0, x - (lo + hi) / 2)), 6) AS p FROM xs JOIN t USING (layer) WHERE it = 60""")
def capped_simplex(spark, d):
    """Each layer's masses moved to the nearest point of the box that sums to the number of pruned experts."""
    import pandas as pd

    from corvane.functions.solver import onto_simplex

    def solve(pdf):
        pdf = pdf.sort_values("expert")
        return pd.DataFrame({"layer": pdf["layer"], "expert": pdf["expert"], "p": onto_simplex(pdf["s"].to_numpy() / pdf["s"].sum() * E, N).round(6)})

    return S.scores(grid(spark, d), "total_0_1_1").withColumnRenamed("score", "s").groupBy("layer").applyInPandas(solve, "layer int, expert int, p double")


@query(f"""WITH {HOPE}, hr AS (SELECT layer, bucket, sum(CASE WHEN pruned THEN 0 ELSE s END) / greatest(sum(s), 1e-30) AS retention FROM grid JOIN hope USING (layer, expert) GROUP BY layer, bucket),
hd AS (SELECT bucket, avg(retention) AS h FROM hr GROUP BY bucket) SELECT bucket, round(h - retention, 6) AS delta FROM hd JOIN dom USING (bucket) WHERE criterion = 'reap_1_1_1'""")
def hope_minus_reap(spark, d):
    g = grid(spark, d)
    h = S.by_domain(S.retention(g, S.hope(coact(spark, d), E, N))).withColumnRenamed("retention", "h")
    return h.join(S.by_domain(S.retention(g, mask(spark, d))), "bucket").select("bucket", F.round(F.col("h") - F.col("retention"), 6).alias("delta"))


@query(f"""WITH {COACT}, m AS (SELECT layer, expert, rk <= 8 AS pruned FROM masks WHERE criterion = 'reap_1_1_1'),
g AS (SELECT a.layer, a.expert AS i, b.expert AS j, a.pruned AS pi, b.pruned AS pj, coalesce(f, 0) AS f FROM m a JOIN m b USING (layer) LEFT JOIN ff ON ff.layer = a.layer AND i = a.expert AND j = b.expert),
reach AS (SELECT layer, i, pi, sum(CASE WHEN pj THEN f ELSE 0 END) AS r, sum(CASE WHEN i = j THEN f ELSE 0 END) AS d FROM g GROUP BY layer, i, pi),
pairs AS (SELECT o.layer, o.i AS drop_expert, n.i AS add_expert, round(o.d - 2 * o.r + n.d + 2 * n.r - 2 * g.f, 9) AS delta FROM reach o JOIN reach n ON o.layer = n.layer AND o.pi AND NOT n.pi JOIN g ON g.layer = o.layer AND g.i = o.i AND g.j = n.i)
SELECT layer, drop_expert, add_expert, delta FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY delta, drop_expert, add_expert) AS k FROM pairs) q WHERE k = 1""")
def swap_refine_step(spark, d):
    return S.best_swap(coact(spark, d), mask(spark, d))


_CURVE = "curve AS (SELECT layer, bucket, rk AS n_pruned, 1 - sum(s) OVER (PARTITION BY layer, bucket ORDER BY rk) / greatest(sum(s) OVER (PARTITION BY layer, bucket), 1e-30) AS retention FROM grid JOIN masks USING (layer, expert) WHERE criterion = 'reap_1_1_1')"


@query(f"WITH {GRID}, {_CURVE} SELECT layer, bucket, n_pruned, round(retention, 6) AS retention FROM curve")
def retention_curve(spark, d):
    return S.curve(grid(spark, d), mask(spark, d)).select("layer", "bucket", "n_pruned", r("retention"))


_BUDGETS = "budgets(budget_id, layer, n_pruned) AS (VALUES " + ", ".join(f"('{k}', {i + 1}, {n})" for k, v in BUDGETS.items() for i, n in enumerate(v)) + ")"


@query(f"WITH {GRID}, {_CURVE}, {_BUDGETS}, b AS (SELECT budget_id, bucket, avg(retention) AS r FROM curve JOIN budgets USING (layer, n_pruned) GROUP BY budget_id, bucket) SELECT budget_id, round(min(r), 6) AS fitness FROM b GROUP BY budget_id")
def budget_fitness(spark, d):
    budgets = spark.createDataFrame([(k, i + 1, n) for k, v in BUDGETS.items() for i, n in enumerate(v)], "budget_id string, layer int, n_pruned int")
    return S.fitness(S.curve(grid(spark, d), mask(spark, d)), budgets).select("budget_id", r("fitness"))


@query()
def layer_budget_search(spark, d):
    """Seeded search: (layer, n_pruned, fitness, uniform_fitness)."""
    best, value, even = S.search_budgets(S.curve(grid(spark, d), mask(spark, d)), [1, 2, 3, 4], E, 4 * N)
    return spark.createDataFrame([(layer, n, value, even) for layer, n in best.items()], "layer int, n_pruned int, fitness double, uniform_fitness double")


@query(f"""WITH {GRID}, b AS (SELECT layer, expert, max(CASE WHEN criterion = 'reap_1_1_1' THEN score END) AS x, max(CASE WHEN criterion = 'total_0_1_1' THEN score END) AS y FROM crit GROUP BY layer, expert),
q AS (SELECT *, rank() OVER (PARTITION BY layer ORDER BY x) + (count(*) OVER (PARTITION BY layer, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY layer ORDER BY y) + (count(*) OVER (PARTITION BY layer, y) - 1) / 2 AS ry,
row_number() OVER (PARTITION BY layer ORDER BY x DESC, expert) <= 8 AS tx, row_number() OVER (PARTITION BY layer ORDER BY y DESC, expert) <= 8 AS ty FROM b WHERE x > 0 OR y > 0)
SELECT layer, count(*) AS n_live, round(corr(rx, ry), 6) AS spearman, sum(CASE WHEN tx AND ty THEN 1 ELSE 0 END) / 8 AS overlap FROM q GROUP BY layer""")
def rank_agreement(spark, d):
    g = grid(spark, d)
    return S.rank_agreement(S.scores(g, "reap_1_1_1"), S.scores(g, "total_0_1_1"), 8).select("layer", "n_live", r("spearman"), "overlap")


@query(f"""WITH {GRID}, t AS (SELECT criterion, layer, expert FROM (SELECT *, row_number() OVER (PARTITION BY criterion, layer ORDER BY score DESC, expert) AS k FROM crit) q WHERE k <= 8)
SELECT a.layer, b.criterion AS other, count(*) / 8 AS overlap FROM t a JOIN t b USING (layer, expert) WHERE a.criterion = 'reap_1_1_1' AND b.criterion <> 'reap_1_1_1' GROUP BY a.layer, b.criterion""")
def topk_overlap(spark, d):
    g = grid(spark, d)

    def top(c):
        w = S.W.partitionBy("layer").orderBy(F.desc("score"), "expert")
        return S.scores(g, c).withColumn("k", F.row_number().over(w)).where("k <= 8").groupBy("layer").agg(F.collect_set("expert").alias(c))

    base = top("reap_1_1_1")
    parts = [base.join(top(c), "layer").select("layer", F.lit(c).alias("other"), (F.size(F.array_intersect("reap_1_1_1", c)) / 8).alias("overlap")) for c in S.CRITERIA if c != "reap_1_1_1"]
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH {COACT}, t AS (SELECT layer, expert, sum(cnt) AS cnt, sum(sq) AS sq FROM acc GROUP BY layer, expert)
SELECT 'finite_nonnegative' AS invariant, count(*) FILTER (WHERE isnan(s) OR s < 0 OR sq < 0 OR gat < 0 OR gsq < 0 OR nrm < 0 OR nsq < 0) AS violations FROM acc
UNION ALL SELECT 'layer_routed', count(*) FILTER (WHERE m <= 0) FROM (SELECT max(cnt) AS m FROM acc GROUP BY layer) q
UNION ALL SELECT 'f_symmetric', count(*) FILTER (WHERE b.f_sum IS NULL OR abs(a.f_sum - b.f_sum) > 1e-12 + 1e-9 * abs(a.f_sum)) FROM f a LEFT JOIN f b ON a.layer = b.layer AND a.i = b.j AND a.j = b.i
UNION ALL SELECT 'diagonal_second_moment', count(*) FILTER (WHERE f.f_sum IS NULL OR t.sq IS NULL OR abs(f_sum / f_cnt - sq / cnt) > 1e-6 * abs(sq / cnt)) FROM (SELECT * FROM f WHERE i = j) f FULL JOIN t ON f.layer = t.layer AND f.i = t.expert
UNION ALL SELECT 'diagonal_count', count(*) FILTER (WHERE f_cnt IS DISTINCT FROM cnt) FROM (SELECT * FROM f WHERE i = j) f FULL JOIN t ON f.layer = t.layer AND f.i = t.expert
UNION ALL SELECT 'pair_count_bound', count(*) FILTER (WHERE f_cnt > least(a.cnt, b.cnt)) FROM f JOIN t a ON f.layer = a.layer AND f.i = a.expert JOIN t b ON f.layer = b.layer AND f.j = b.expert""")
def verify_invariants(spark, d):
    return checks.invariants(R.accumulators(routing(spark, d)), R.coactivation_of(T.gate_scores(spark, d), K))


@query(f"""WITH {ROUTING}, snap AS (SELECT k, layer, bucket, expert, count(*) AS cnt, sum(gate * norm) AS s FROM routing, (SELECT unnest(range(3)) AS k) q WHERE valid AND token % 3 <= k GROUP BY k, layer, bucket, expert)
SELECT a.k + 1 AS snapshot, count(*) AS cells, count(*) FILTER (WHERE b.cnt IS NULL OR b.cnt < a.cnt OR b.s < a.s - 1e-12) AS fallen FROM snap a LEFT JOIN snap b ON b.k = a.k + 1 AND a.layer = b.layer AND a.bucket = b.bucket AND a.expert = b.expert WHERE a.k < 2 GROUP BY a.k""")
def snapshot_monotonic(spark, d):
    snaps = [R.accumulators(routing(spark, d).where(F.col("token") % 3 <= k)) for k in range(3)]
    parts = []
    for k in range(2):
        fallen = checks.never_falls(snaps[k], snaps[k + 1]).agg(F.count(F.lit(1)).alias("fallen"))
        parts.append(snaps[k].agg(F.count(F.lit(1)).alias("cells")).join(fallen).select(F.lit(k + 1).alias("snapshot"), "cells", "fallen"))
    return parts[0].unionByName(parts[1])


@query(f"WITH {ROUTING} SELECT layer, count(*) AS routed, count(DISTINCT token) * 4 AS expected, count(*) = count(DISTINCT token) * 4 AS ok FROM routing WHERE valid GROUP BY layer")
def routed_count_identity(spark, d):
    return checks.routed_identity(routing(spark, d), K)


_PRUNED = "m AS (SELECT layer, expert, rk <= 8 AS pruned FROM masks WHERE criterion = 'reap_1_1_1'), hit AS (SELECT r.layer, token, sum(CASE WHEN pruned THEN 1 ELSE 0 END) AS bad, count(*) AS n FROM routing r JOIN m USING (layer, expert) WHERE valid GROUP BY r.layer, token)"


@query(f"WITH {GRID}, {_PRUNED} SELECT layer, round(sum(bad) / sum(n), 6) AS slot_rate, round(avg(CASE WHEN bad > 0 THEN 1.0 ELSE 0.0 END), 6) AS token_rate FROM hit GROUP BY layer")
def affected_rate(spark, d):
    return refit.affected_rate(routing(spark, d), mask(spark, d)).select("layer", r("slot_rate"), r("token_rate"))


@query(f"WITH {ROUTING} SELECT layer, token FROM (SELECT layer, token, row_number() OVER (PARTITION BY layer ORDER BY md5('pop|' || layer || '|' || token), layer, token) AS k FROM (SELECT DISTINCT layer, token FROM routing WHERE valid) t) q WHERE k <= 32")
def reservoir_sample(spark, d):
    tokens = T.gate_scores(spark, d).where("valid").select("layer", "token")
    return smallest_hash(tokens, 32, "pop", ["layer"], "layer", "token").select("layer", "token")


@query(f"WITH {GRID}, {_PRUNED} SELECT layer, token FROM (SELECT layer, token, row_number() OVER (PARTITION BY layer ORDER BY md5('aff|' || layer || '|' || token), layer, token) AS k FROM hit WHERE bad > 0) q WHERE k <= 32")
def reservoir_affected(spark, d):
    return smallest_hash(refit.affected(routing(spark, d), mask(spark, d)), 32, "aff", ["layer"], "layer", "token").select("layer", "token")


_CANDS = f"""m AS (SELECT layer, expert, rk <= 8 AS pruned FROM masks WHERE criterion = 'reap_1_1_1'),
kept AS (SELECT r.*, row_number() OVER (PARTITION BY r.layer, token ORDER BY x DESC, expert) AS kr FROM ranked r JOIN m USING (layer, expert) WHERE NOT pruned),
cands AS (SELECT layer, token, valid, rn - 1 AS slot, expert, sg, norm, true AS teacher FROM ranked WHERE rn <= 4 UNION ALL SELECT layer, token, valid, kr + 3, expert, sg, norm, false FROM kept WHERE kr <= 6)"""


@query(f"WITH {GRID}, {_CANDS} SELECT layer, token, slot, expert, teacher FROM cands")
def refit_candidates(spark, d):
    return refit.candidates(T.gate_scores(spark, d), mask(spark, d), K, 6).select("layer", "token", "slot", "expert", "teacher")


@query(f"""WITH {GRID}, {_CANDS}, mix AS (SELECT layer, token, sum(CASE WHEN teacher THEN sg * norm END) / (sum(CASE WHEN teacher THEN sg END) + 1e-20) AS t,
sum(CASE WHEN NOT teacher AND slot < 8 THEN sg * norm END) / (sum(CASE WHEN NOT teacher AND slot < 8 THEN sg END) + 1e-20) AS u FROM cands WHERE valid GROUP BY layer, token)
SELECT layer, count(*) AS n, round(avg((t - u) * (t - u)), 9) AS mse FROM mix GROUP BY layer""")
def refit_baseline_mse(spark, d):
    return refit.baseline(refit.candidates(T.gate_scores(spark, d), mask(spark, d), K, 6), K).select("layer", "n", r("mse", 9))


@query()
def router_refit(spark, d):
    """Gradient refit on a bounded sample of affected tokens a layer, accepted only where the loss of all valid tokens falls."""
    scores, pruned = T.gate_scores(spark, d, hidden=True), mask(spark, d)
    sample = smallest_hash(refit.affected_scores(scores, pruned, K).select("layer", "token"), 512, "fit", ["layer"], "layer", "token")
    return refit.refit(scores, pruned, K, train=sample)


@query(f"WITH {GRID} SELECT layer, expert, row_number() OVER (PARTITION BY layer ORDER BY expert) - 1 AS new_expert FROM masks WHERE criterion = 'reap_1_1_1' AND rk > 8")
def expert_renumbering(spark, d):
    return S.renumbered(mask(spark, d))


@query("""WITH u AS (SELECT l_orderkey AS token, l_suppkey % 64 AS expert, sum(l_quantity) AS q, sum(l_extendedprice) / 100000 AS norm FROM lineitem GROUP BY 1, 2),
t AS (SELECT token, o_orderpriority AS bucket, expert, q / sum(q) OVER (PARTITION BY token) AS gate, norm FROM u JOIN orders ON o_orderkey = token)
SELECT bucket, expert, count(*) AS cnt, round(sum(gate), 4) AS gat, round(sum(gate * norm), 4) AS s FROM t GROUP BY bucket, expert""")
def saliency_large(spark, d):
    """The volume fixture: orders as tokens, suppliers as experts, order priorities as buckets."""
    acc = R.accumulators(large(spark, d), "bucket", "expert")
    return acc.select("bucket", "expert", "cnt", r("gat", 4), r("s", 4))


def large(spark, d) -> DataFrame:
    # Dealt by token once: the aggregate, the window and the join all keep that partitioning.
    dealt = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("token"), (F.col("l_suppkey") % 64).alias("expert"), "l_quantity", "l_extendedprice").repartition("token")
    lines = dealt.groupBy("token", "expert").agg(F.sum("l_quantity").alias("q"), (F.sum("l_extendedprice") / 100000).alias("norm"))
    orders = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_orderpriority").alias("bucket"))
    gated = lines.withColumn("gate", F.col("q") / F.sum("q").over(S.W.partitionBy("token")))
    return gated.join(orders, "token").select(F.lit(1).alias("layer"), "token", "bucket", "expert", "gate", "norm", F.lit(True).alias("valid"))


@query("""WITH u AS (SELECT l_orderkey AS token, l_suppkey % 64 AS expert, sum(l_quantity) AS q, sum(l_extendedprice) / 100000 AS norm FROM lineitem GROUP BY 1, 2),
t AS (SELECT token, expert, q / sum(q) OVER (PARTITION BY token) * norm AS s FROM u WHERE token IN (SELECT o_orderkey FROM orders))
SELECT a.expert AS i, b.expert AS j, round(sum(a.s * b.s), 4) AS f_sum, count(*) AS f_cnt FROM t a JOIN t b USING (token) GROUP BY 1, 2""")
def coactivation_large(spark, d):
    return R.coactivation(large(spark, d)).select("i", "j", r("f_sum", 4), "f_cnt")
