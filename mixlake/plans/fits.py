"""Registered queries of fits, and of sources and sinks: what they give that SQL can give too.

Draws have keys, so SQL repeats whole fits; a trainer has seen as many rows as its steps hold; scores and
gradients at given parameters are sums over the table.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlake.functions.exprs import rounded
from mixlake.operators import inference as I
from mixlake.operators import metrics as M
from mixlake.operators import schema as S
from mixlake.operators.model import Model
from mixlake.plans import replay as R
from mixlake.plans.more import _encoded
from mixlake.plans.registry import CLUSTERS, FEATURES, fitted, joint_sql, model_sql, query, table
from mixlake.sources import tables as T
from mixlake.sources.scratch import shared_dir


def _cells(spark: SparkSession, fit: I.Fit) -> DataFrame:
    """(particle, feature, cluster, category, n, n_assigned): cells that the fit's counts hold, and those of the clusters it wrote."""
    _, written = I.counts(fit.assigned(), FEATURES, fit.p.n, fit.p.pi.shape[1], fit.sizes)
    rows = []
    for f, own, out in zip(FEATURES, fit.p.phi, written, strict=True):
        rows += [(int(p), f, int(c), int(k), int(own[p, c, k]), int(out[p, c, k])) for p, c, k in np.argwhere((own != 0) | (out != 0))]
    return spark.createDataFrame(rows, "particle int, feature string, cluster int, category int, n long, n_assigned long")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("m02_initial_cells", R.fit_sql(11, 2, [("true", False)]) + R.CELLS)
def initial_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sizes, _ = _encoded(spark, sf_dir)
    fit = I.Fit(rows, FEATURES, sizes, shared_dir(spark), 2, CLUSTERS, seed=11)
    fit.gibbs(rows, False)
    return _cells(spark, fit)


@query("m02_prior_start", R.fit_sql(15, 3, [("true", False)], blind_start=True) + R.CELLS)
def prior_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells after a start that draws clusters from their weights alone."""
    rows, sizes, _ = _encoded(spark, sf_dir)
    fit = I.Fit(rows, FEATURES, sizes, shared_dir(spark), 3, CLUSTERS, seed=15)
    fit.assign_from_prior()
    return _cells(spark, fit)


@query("i13_smc_cells", R.fit_sql(12, 3, R.smc_moves(12, 3, 1)) + R.CELLS)
def smc_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sizes, n = _encoded(spark, sf_dir)
    return _cells(spark, I.smc(I.Fit(rows, FEATURES, sizes, shared_dir(spark), 3, CLUSTERS, seed=12), n, -(-n // 3), 3, 1))


@query("i15_mcmc_cells", R.fit_sql(13, 1, R.mcmc_moves(13, 4, 1)) + R.CELLS)
def mcmc_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sizes, n = _encoded(spark, sf_dir)
    return _cells(spark, I.mcmc(I.Fit(rows, FEATURES, sizes, shared_dir(spark), 1, CLUSTERS, seed=13), n, n // 4, 1))


@query("i18_trainer", "SELECT CAST(step AS INTEGER) AS step, CAST(p.range AS INTEGER) AS particle, (SELECT count(*) FROM orders WHERE o_orderkey < step * (((SELECT count(*) FROM orders) + 2) // 3)) AS n FROM (SELECT unnest([0, 1, 2, 3, 4]) AS step), range(2) p")
def trainer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each saved state of a trainer has assigned: it stops after two steps, another goes on from its files to the fourth, whose batch is the first again."""
    rows, sizes, n = _encoded(spark, sf_dir)
    path, size = _folder(spark, "trainer"), -(-n // 3)
    I.train(I.Fit(rows, FEATURES, sizes, shared_dir(spark), 2, CLUSTERS, seed=14), n, size, path, 2, 1)
    I.train(I.Fit.resume(rows, path)[0], n, size, path, 4, 1)
    found = []
    for step in I.saved_steps(rows, path):
        state = I.Fit.resume(rows, path, step)[0]
        found += [(step, p, int(state.p.rows[p].sum())) for p in range(2)]
    return spark.createDataFrame(found, "step int, particle int, n long")


def _parameters(model: Model) -> tuple[np.ndarray, list[np.ndarray]]:
    """A model's log pi [C] and log theta by feature [C, K]."""
    pi = np.array([r.log_p for r in model.pi.orderBy("cluster").collect()])
    theta: dict[str, dict] = {f: {} for f in FEATURES}
    for r in model.theta.collect():
        theta[r.feature][r.cluster, r.category] = r.log_p
    sizes = [1 + max(k for _, k in theta[f]) for f in FEATURES]
    return pi, [np.array([[theta[f][c, k] for k in range(size)] for c in range(len(pi))]) for f, size in zip(FEATURES, sizes, strict=True)]


@query("i11_fit_log_likelihood", model_sql() + joint_sql(False) + "SELECT CAST(0 AS INTEGER) AS particle, round(sum(lse), 4) AS log_likelihood FROM lse")
def fit_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = fitted(spark, sf_dir)
    pi, theta = _parameters(model)
    ll = I.log_likelihood(rows, FEATURES, pi[None], [t[None] for t in theta])
    return spark.createDataFrame([(0, float(ll[0]))], "particle int, ll double").select("particle", rounded(F.col("ll"), 4).alias("log_likelihood"))


@query("i05_log_target", model_sql() + f"SELECT round(lgamma({CLUSTERS}) + {CLUSTERS} * (SELECT sum(lgamma(n)) FROM (SELECT count(*) AS n FROM dom GROUP BY feature)) + (SELECT sum(lp) FROM enc JOIN pi USING (cluster)) + (SELECT sum(lp) FROM lng JOIN theta USING (cluster, feature, k)), 4) AS log_target")
def log_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log joint of the model's parameters and of all orders in the clusters that it was counted from, priors with alpha 1."""
    rows, model, _ = fitted(spark, sf_dir)
    pi, theta = _parameters(model)
    sizes = [t.shape[1] for t in theta]
    n, phi = I.counts(rows.withColumn("a", F.array(F.col("cluster").cast("int"))), FEATURES, 1, CLUSTERS, sizes)
    one = np.ones(1)
    p = I.Particles(pi[None], [t[None] for t in theta], n, phi, np.zeros(1), np.zeros(1), one, one)
    return spark.createDataFrame([(float(I.log_target(p)[0]),)], "v double").select(rounded(F.col("v"), 4).alias("log_target"))


@query("i20_gradient", model_sql() + f", u AS (SELECT feature, k, count(*) AS n FROM lng GROUP BY ALL), t AS (SELECT feature, sum(n) AS n, (SELECT count(*) FROM dom d WHERE d.feature = u.feature) AS size FROM u GROUP BY feature) SELECT dom.feature, CAST(cl.cluster AS INTEGER) AS cluster, CAST(dom.k AS INTEGER) AS category, round((t.n / t.size - coalesce(u.n, 0)) / {CLUSTERS}.0, 6) AS g, round((SELECT sum(n * ln(size)) FROM t), 4) AS loss FROM dom JOIN t USING (feature) LEFT JOIN u USING (feature, k) CROSS JOIN cl")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and gradient at zero logits, where every cluster and category is as likely as another."""
    rows, sizes, _ = _encoded(spark, sf_dir)
    loss, _, by = I.gradient(rows, FEATURES, np.zeros(CLUSTERS), [np.zeros((CLUSTERS, k)) for k in sizes])
    out = [(f, c, k, float(g[c, k]), loss) for f, g in zip(FEATURES, by, strict=True) for c in range(CLUSTERS) for k in range(g.shape[1])]
    df = spark.createDataFrame(out, "feature string, cluster int, category int, g double, loss double")
    return df.withColumns({"g": rounded(F.col("g")), "loss": rounded(F.col("loss"), 4)})


# ---- evaluation

@query("j13_t_interval", "WITH m AS (SELECT event_type, avg(value) AS v FROM events GROUP BY event_type), s AS (SELECT count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM m), q AS (SELECT *, list_value(12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852)[n - 1] * sd / sqrt(n) AS half FROM s) SELECT round(mean, 6) AS mean, round(mean - half, 6) AS low, round(mean + half, 6) AS high FROM q")
def t_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the event types' mean values: a handful of values, so the t quantile matters."""
    means = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("v"))
    out = spark.createDataFrame([M.mean_interval(means, "v")], "mean double, low double, high double")
    return out.select(*(rounded(F.col(c)).alias(c) for c in out.columns))


@query("j20_target_choice", "WITH d AS (SELECT 'o_orderstatus' AS c, count(DISTINCT o_orderstatus) AS k FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders), r AS (SELECT c, row_number() OVER (ORDER BY k, c) - 1 AS i, count(*) OVER () AS n FROM d WHERE k BETWEEN 2 AND 20) SELECT c AS target FROM r WHERE i = n // 2")
def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(M.target_choice(table(spark, sf_dir, "orders")),)], "target string")


@query("e13_masked_argmax", "SELECT o_orderkey, CAST(list_position(l[1:3], list_max(l[1:3])) - 1 AS INTEGER) AS best, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS best_of_all FROM (SELECT o_orderkey, [o_orderkey * 7 % 11, o_custkey % 11, o_orderkey % 5, o_custkey % 13] AS l FROM orders)")
def masked_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("array(o_orderkey * 7 % 11, o_custkey % 11, o_orderkey % 5, o_custkey % 13)").alias("a"))
    return orders.select("o_orderkey", S.from_one_hot(F.col("a"), 3).alias("best"), S.from_one_hot(F.col("a")).alias("best_of_all"))


# ---- sources and sinks: what was written is read again

_CUSTOMERS = "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer"
_CUSTOMER = "c_custkey long, c_mktsegment string, c_acctbal double"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")


@query("s01_table_pair", "SELECT o_orderkey, o_orderkey % 2 = 1 AS test FROM orders")
def table_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, orders = _folder(spark, "pair"), table(spark, sf_dir, "orders").select("o_orderkey")
    for rest, name in enumerate(("train", "test")):
        T.sink(orders.where(F.col("o_orderkey") % 2 == rest), f"{folder}/{name}.parquet")
    train, test = T.load_pair(spark, folder, "train.parquet", "test.parquet")
    return train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))


@query("s03_recursive_scan", "SELECT c_custkey, 'set' || c_custkey % 3 AS dataset, CAST(c_custkey % 3 * 10 AS INTEGER) AS particles FROM customer")
def recursive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, rows = _folder(spark, "deep"), table(spark, sf_dir, "customer").select("c_custkey")
    for k in range(3):
        T.sink(rows.where(F.col("c_custkey") % 3 == k), f"{folder}/set{k}/smc/P{10 * k}_C100_T30_B1000")
    found = T.with_path(T.scan(spark, folder, recursive=True), "/(set[0-9]+)/smc/([^/]+)/", ["dataset", "run"])
    return found.select("c_custkey", "dataset", T.run_settings(F.col("run"))["particles"].alias("particles"))


@query("s04_csv", _CUSTOMERS)
def csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    T.sink(_customers(spark, sf_dir), path, "csv")
    return T.scan(spark, path, "csv", _CUSTOMER)


@query("s08_json", _CUSTOMERS)
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "json")
    T.sink(_customers(spark, sf_dir), path, "json", single=True)
    return T.scan(spark, path, "json", _CUSTOMER)


@query("s05_dense_array", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS row_id, CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def dense_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations, a table of fixed size, through a .npy array."""
    file = io.BytesIO()
    T.table_to_dense(table(spark, sf_dir, "nation"), file, ["n_nationkey", "n_regionkey"], ["n_nationkey"])
    file.seek(0)
    return T.dense_to_table(spark, file).select("row_id", F.col("values")[0].alias("nation"), F.col("values")[1].alias("region"))


@query("s06_saved_model", model_sql() + joint_sql(False) + "SELECT o_orderkey, round(lse, 6) AS log_p FROM lse")
def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = fitted(spark, sf_dir)
    path = _folder(spark, "model")
    model.save(path)
    return Model.load(spark, path, FEATURES).logprob(rows).select("o_orderkey", rounded(F.col("log_p")).alias("log_p"))


@query("s10_first_model", "SELECT event_type AS dataset, min('runs/P' || user_id || '/model-' || event_id) AS path FROM events GROUP BY event_type")
def first_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), F.concat(F.lit("runs/P"), "user_id", F.lit("/model-"), "event_id").alias("path"))
    return T.first_model(runs)


@query("r29_row_position", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 17")
def row_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey = 17").select("o_orderkey", "o_orderstatus")
