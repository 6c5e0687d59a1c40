"""Registered queries of sequential Monte Carlo over sharded particles, and of descent: whole steps that SQL draws again."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlake.functions import draws
from mixlake.functions.draws import key_sql, unit_sql
from mixlake.functions.exprs import rounded
from mixlake.operators import inference as I
from mixlake.operators.swarm import BlockFit, Swarm, deal
from mixlake.plans import replay as R
from mixlake.plans.more import _encoded
from mixlake.plans.registry import CLUSTERS, FEATURES, model_sql, query
from mixlake.sources.scratch import shared_dir

_P, _SEED, _GRID = 5, 21, [0.5, 1.0, 2.0]


def _step(spark: SparkSession, sf_dir: str, grids=None) -> BlockFit:
    """After one weighted step over the first third of the orders, by key: few particles and a large block, so rows stay in tasks."""
    rows, sizes, n = _encoded(spark, sf_dir)
    fit = BlockFit(spark, deal(rows, FEATURES, -(-n // 3)), sizes, _P, CLUSTERS, seed=_SEED, grids=grids)
    fit.move([0], True)
    return fit


_STEP = R.fit_sql(_SEED, _P, [(R.block(0, R.third(3), False), True)])


@query("i06_assignments", _STEP + "SELECT o_orderkey AS row_id, p AS particle, CAST(cluster AS INTEGER) AS cluster FROM nw0")
def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters that a step has drawn for its rows, in every particle, as they were before resampling."""
    return _step(spark, sf_dir).assigned(weighted=True).select("row_id", F.col("particle").cast("long").alias("particle"), "cluster")


@query("i04_step_parameters", _STEP + f"SELECT p AS particle, CASE f WHEN 0 THEN 'o_orderstatus' WHEN 1 THEN 'o_orderpriority' ELSE 'o_totalprice' END AS feature, CAST(c AS INTEGER) AS cluster, CAST(k AS INTEGER) AS category, round(lp, 6) AS log_p FROM tr0 WHERE f >= 0")
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """theta of every particle, drawn from its posterior given the step's clusters."""
    fit = _step(spark, sf_dir)
    return fit.cells(fit.weighted.theta, "log_p", "double").withColumn("log_p", rounded(F.col("log_p")))


@query("i12_step_weights", _STEP + "SELECT p AS particle, round(q, 3) AS q, round(target, 3) AS target, round(log_w, 3) AS log_w, round(w, 6) AS w FROM wq0 JOIN wt0 USING (p) JOIN wn0 USING (p)")
def step_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposal, target and weight of every particle after one step, before resampling."""
    fit = _step(spark, sf_dir)
    proposal = spark.createDataFrame([(i, float(q)) for i, q in enumerate(fit.q)], "particle long, q double")
    out = fit.particles(fit.weighted).join(proposal, "particle")
    return out.select("particle", rounded(F.col("q"), 3).alias("q"), rounded(F.col("gamma"), 3).alias("target"), rounded(F.col("log_w"), 3).alias("log_w"), rounded(F.col("w")).alias("w"))


@query("i10_step_ancestors", _STEP + f", ua AS (SELECT p, {unit_sql(key_sql([_SEED, 1, draws.ANCESTOR], 'p'))} AS u FROM par) SELECT ua.p AS particle, CAST(least(count(*) FILTER (cum <= u), {_P - 1}) AS BIGINT) AS ancestor FROM ua, cw0 GROUP BY ua.p")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestors that the step's weights give."""
    fit = _step(spark, sf_dir)
    up = I.resampled(replace(fit.weighted), fit.seed, fit.step)
    return spark.createDataFrame([(i, int(a)) for i, a in enumerate(up)], "particle long, ancestor long")


@query("i17_step_hyper", R.fit_sql(_SEED, _P, [(R.block(0, R.third(3), False), True)], _GRID) + "SELECT p AS particle, alpha_pi, alpha_theta FROM ah0")
def step_hyper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concentrations that every particle draws from grids after one step."""
    fit = _step(spark, sf_dir, (_GRID, _GRID))
    return fit.particles(fit.weighted).select("particle", "alpha_pi", "alpha_theta")


@query("i14_rejuvenation_cells", model_sql() + f"SELECT CAST(p.range AS BIGINT) AS particle, feature, CAST(k AS INTEGER) AS category, count(*) AS n, count(*) AS n_assigned FROM lng, range({_P}) p GROUP BY ALL")
def rejuvenation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells over all clusters after three steps and six moves of random blocks: those that the particles count, and those of the clusters kept by block."""
    rows, sizes, n = _encoded(spark, sf_dir)
    fit = BlockFit(spark, deal(rows, FEATURES, -(-n // 6), seed=_SEED), sizes, _P, CLUSTERS, seed=_SEED).run(rejuvenation=1)
    kept = fit.assigned_cells().withColumnRenamed("n", "n_assigned").groupBy("particle", "feature", "category").agg(F.sum("n_assigned").alias("n_assigned"))
    counted = fit.cells([x.astype(int) for x in fit.p.phi], "n", "long").where("n > 0")
    return counted.groupBy("particle", "feature", "category").agg(F.sum("n").alias("n")).join(kept, ["particle", "feature", "category"])


_RATE = 0.1


@query("i20_descent_losses", R.DESCENT + R.descent_sql("a", _SEED, ["true"] * 3, _RATE) + ", " + R.descent_sql("s", _SEED, ["true"] * 3, _RATE, True) + " " + R.losses("a", 3, "'adam' AS optimizer, ") + " UNION ALL " + R.losses("s", 3, "'sign' AS optimizer, "))
def descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negative log-likelihood of all orders before each of three steps of descent, by two optimisers."""
    rows, sizes, n = _encoded(spark, sf_dir)
    out = []
    for optimizer in ("adam", "sign"):
        fit = I.Fit(rows, FEATURES, sizes, shared_dir(spark), 1, CLUSTERS, seed=_SEED)
        losses = I.gradient_fit(fit, n, 3, n, _RATE, optimizer)[2]
        out += [(optimizer, t, float(x)) for t, x in enumerate(losses)]
    return spark.createDataFrame(out, "optimizer string, step int, loss double").withColumn("loss", rounded(F.col("loss"), 3))


@query("swarm_fit")
def swarm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(particle, log_w, w) of 2,000 particles with ten clusters after three steps over blocks of at most 1,000 orders, and a move of a random block after each."""
    rows, sizes, n = _encoded(spark, sf_dir)
    swarm = Swarm(spark, deal(rows, FEATURES, min(1000, -(-n // 3)), seed=2), sizes, 2000, 10, seed=2).run(3, 1)
    return swarm.particles().select("particle", "log_w", "w")
