"""Queries of the library's own operators, by name, with the SQL that gives the same rows.

The model queries share one set-up over `orders`: order status and priority as categories, total price
in five bins, the cluster of an order its key modulo 3, posterior means with alpha 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mixlake.functions.exprs import draw_index, rounded, uniform
from mixlake.operators import distances as D
from mixlake.operators import metrics as M
from mixlake.operators import schema as S
from mixlake.operators.model import Model, alpha_pi_posterior, alpha_theta_posterior, dirichlet_score, effective_sample_size, resample, sufficient_statistics, weighted_log_likelihood

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

FEATURES = ["o_orderstatus", "o_orderpriority", "o_totalprice"]
BINS, CLUSTERS = 5, 3
SEED = 7


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    from mixlake.plans import benchmark, boosting, fits, more, swarm  # noqa: F401  their queries register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return logprob_missing(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", *FEATURES)


def fitted(spark: SparkSession, sf_dir: str, clusters: int = CLUSTERS, cluster=None) -> tuple[DataFrame, Model, S.TableSchema]:
    """Encoded orders with their clusters, the model and the schema."""
    orders = raw_orders(spark, sf_dir)
    schema = S.TableSchema.fit(orders.select(*FEATURES), BINS)
    rows = schema.encode(orders).withColumn("cluster", F.col("o_orderkey") % clusters if cluster is None else cluster)
    return rows, Model.from_assignments(rows, schema.domain(), FEATURES, clusters), schema


def hidden(rows: DataFrame) -> DataFrame:
    """Every fourth order without its priority."""
    return rows.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")))


def edges_sql(source: str, column: str, bins: int) -> str:
    """(i, edge) at nearest ranks."""
    return f"(SELECT q.i, r.x AS edge FROM (SELECT range AS i FROM range({bins + 1})) q, (SELECT count({column}) AS n FROM {source}) c, (SELECT {column} AS x, row_number() OVER (ORDER BY {column}) AS rn FROM {source} WHERE {column} IS NOT NULL) r WHERE r.rn = 1 + floor(q.i / {bins}.0 * (c.n - 1) + 0.5))"


def bin_sql(x: str, edges: str, bins: int) -> str:
    """Right-closed bin of x."""
    return f"(SELECT coalesce(min(e.i) - 1, {bins - 1}) FROM {edges} e WHERE e.i BETWEEN 1 AND {bins - 1} AND {x} <= e.edge)"


def model_sql(cluster: str = f"o_orderkey % {CLUSTERS}", clusters: int = CLUSTERS) -> str:
    """Named subqueries: enc, dom, cl, cnt, theta, pi."""
    return f"""
WITH edges AS MATERIALIZED {edges_sql('orders', 'o_totalprice', BINS)},
e1 AS (SELECT list(edge ORDER BY i) AS l FROM edges),
ls AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT o_orderstatus AS label FROM orders)),
lp AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT o_orderpriority AS label FROM orders)),
enc AS MATERIALIZED (SELECT o_orderkey, {cluster} AS cluster, ls.k AS f0, lp.k AS f1,
  CASE WHEN o_totalprice <= l[2] THEN 0 WHEN o_totalprice <= l[3] THEN 1 WHEN o_totalprice <= l[4] THEN 2 WHEN o_totalprice <= l[5] THEN 3 ELSE 4 END AS f2
  FROM orders, e1, ls, lp WHERE o_orderstatus = ls.label AND o_orderpriority = lp.label),
lng AS (SELECT cluster, 'o_orderstatus' AS feature, f0 AS k FROM enc UNION ALL SELECT cluster, 'o_orderpriority', f1 FROM enc UNION ALL SELECT cluster, 'o_totalprice', f2 FROM enc),
dom AS (SELECT 'o_orderstatus' AS feature, k FROM ls UNION ALL SELECT 'o_orderpriority', k FROM lp UNION ALL SELECT 'o_totalprice', range FROM range({BINS})),
cl AS (SELECT range AS cluster FROM range({clusters})),
phi AS (SELECT cluster, feature, k, count(*) AS n FROM lng GROUP BY ALL),
cell AS (SELECT cl.cluster, dom.feature, dom.k, coalesce(phi.n, 0) AS n FROM cl CROSS JOIN dom LEFT JOIN phi ON phi.cluster = cl.cluster AND phi.feature = dom.feature AND phi.k = dom.k),
theta AS MATERIALIZED (SELECT cluster, feature, k, ln((n + 1.0) / (sum(n) OVER w + count(*) OVER w)) AS lp FROM cell WINDOW w AS (PARTITION BY cluster, feature)),
pi AS MATERIALIZED (SELECT cl.cluster, ln((coalesce(m.n, 0) + 1.0) / ((SELECT count(*) FROM enc) + {clusters})) AS lp FROM cl LEFT JOIN (SELECT cluster, count(*) AS n FROM enc GROUP BY 1) m ON m.cluster = cl.cluster)
"""


def joint_sql(hide: bool) -> str:
    """Named subqueries: j (o_orderkey, cluster, v) and lse (o_orderkey, lse), with the priority of every fourth order hidden or not."""
    second = "CASE WHEN enc.o_orderkey % 4 = 0 THEN 0 ELSE b.lp END" if hide else "b.lp"
    return f""", j AS MATERIALIZED (SELECT enc.o_orderkey, pi.cluster, pi.lp + a.lp + {second} + c.lp AS v FROM enc, pi, theta a, theta b, theta c
  WHERE a.cluster = pi.cluster AND b.cluster = pi.cluster AND c.cluster = pi.cluster AND a.feature = 'o_orderstatus' AND a.k = enc.f0 AND b.feature = 'o_orderpriority' AND b.k = enc.f1 AND c.feature = 'o_totalprice' AND c.k = enc.f2),
lse AS (SELECT o_orderkey, max(v) + ln(sum(exp(v - m))) AS lse FROM (SELECT *, max(v) OVER (PARTITION BY o_orderkey) AS m FROM j) GROUP BY o_orderkey)
"""


# ---- schema and encoding

@query("e01_schema_levels", "SELECT feature, label, CAST(row_number() OVER (PARTITION BY feature ORDER BY label) - 1 AS INTEGER) AS category FROM (SELECT DISTINCT 'o_orderstatus' AS feature, o_orderstatus AS label FROM orders UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders)")
def schema_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.levels(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]).select("feature", "label", "category")


@query("e02_quantile_edges", f"SELECT CAST(i AS INTEGER) AS i, edge FROM {edges_sql('orders', 'o_totalprice', 20)}")
def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = S.order_statistics(table(spark, sf_dir, "orders"), "o_totalprice", [i / 20 for i in range(21)])
    return spark.createDataFrame(list(enumerate(edges)), "i int, edge double")


@query("e04_discretize_right_closed", f"WITH e AS MATERIALIZED {edges_sql('orders', 'o_totalprice', 20)} SELECT o_orderkey, CAST(coalesce(min(e.i) FILTER (o_totalprice <= e.edge AND e.i BETWEEN 1 AND 19) - 1, 19) AS INTEGER) AS bin FROM orders, e GROUP BY o_orderkey")
def discretize(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    schema = S.TableSchema.fit(orders.select("o_totalprice"), 20)
    return schema.discretize(orders).select("o_orderkey", F.col("o_totalprice").alias("bin"))


@query("e05_encode_unseen", "WITH l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT p_type AS label FROM part WHERE p_partkey % 7 = 0)) SELECT p_partkey, CAST(k AS INTEGER) AS code FROM part LEFT JOIN l ON p_type = label")
def encode_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    schema = S.TableSchema.fit(part.where("p_partkey % 7 = 0").select("p_type"))
    return schema.encode(part).select("p_partkey", F.col("p_type").alias("code"))


@query("e06_categorical_index", "WITH d AS (SELECT DISTINCT 0 AS fp, o_orderstatus AS l, 'o_orderstatus' AS feature FROM orders UNION ALL SELECT DISTINCT 1, o_orderpriority, 'o_orderpriority' FROM orders UNION ALL SELECT 2, CAST(range AS VARCHAR), 'o_totalprice' FROM range(5)) SELECT feature, CAST(row_number() OVER (PARTITION BY fp ORDER BY l) - 1 AS INTEGER) AS category, CAST(fp AS INTEGER) AS feature_place, CAST(row_number() OVER (ORDER BY fp, l) - 1 AS INTEGER) AS place FROM d")
def categorical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = S.TableSchema.fit(raw_orders(spark, sf_dir).select(*FEATURES), BINS)
    return S.categorical_index(schema.domain(), FEATURES).select("feature", "category", "feature_place", "place")


@query("e07_onehot_roundtrip", "WITH l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT c_mktsegment AS label FROM customer)) SELECT c_custkey, CAST(k AS INTEGER) AS code, CAST(1 AS INTEGER) AS ones FROM customer JOIN l ON c_mktsegment = label")
def onehot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    hot = S.TableSchema.fit(rows.select("c_mktsegment")).encode(rows).withColumn("hot", S.one_hot(F.col("c_mktsegment"), 5))
    return hot.select("c_custkey", S.from_one_hot(F.col("hot")).alias("code"), F.aggregate("hot", F.lit(0), lambda a, x: a + x).alias("ones"))


@query("e08_from_dummies", "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AUTOMOBILE' WHEN 'BUILDING' THEN 'BUILDING' END AS seg FROM customer")
def from_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", *((F.col("c_mktsegment") == s).cast("int").alias(f"seg_{s}") for s in ("AUTOMOBILE", "BUILDING")))
    return S.from_dummies(rows, keep=["c_custkey"])


@query("e09_train_test_encode", f"WITH e AS MATERIALIZED {edges_sql('(SELECT * FROM orders WHERE o_orderkey % 2 = 0)', 'o_totalprice', 20)}, l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT o_orderpriority AS label FROM orders WHERE o_orderkey % 2 = 0)), t AS (SELECT * FROM orders WHERE o_orderkey % 2 = 1) SELECT t.o_orderkey, CAST(any_value(l.k) AS INTEGER) AS priority, CAST(coalesce(min(e.i) FILTER (o_totalprice <= e.edge AND e.i BETWEEN 1 AND 19) - 1, 19) AS INTEGER) AS price FROM t LEFT JOIN l ON o_orderpriority = label CROSS JOIN e GROUP BY t.o_orderkey")
def train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = raw_orders(spark, sf_dir)
    schema = S.TableSchema.fit(orders.where("o_orderkey % 2 = 0").select("o_orderpriority", "o_totalprice"))
    return schema.encode(orders.where("o_orderkey % 2 = 1")).select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


@query("e11_domain_sizes", "SELECT 'o_orderstatus' AS feature, count(DISTINCT o_orderstatus) AS k FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'o_totalprice', 5")
def domain_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = S.TableSchema.fit(raw_orders(spark, sf_dir).select(*FEATURES), BINS)
    return schema.domain().groupBy("feature").agg(F.count("*").alias("k"))


@query("e16_digitize_left_closed", f"WITH e AS MATERIALIZED (SELECT DISTINCT edge FROM {edges_sql('part', 'p_retailprice', 10)}) SELECT p_partkey, CAST(count(*) FILTER (edge <= p_retailprice) AS INTEGER) AS bin FROM part, e GROUP BY p_partkey")
def digitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    schema = S.TableSchema.fit(part.select("p_retailprice"), 10)
    return schema.discretize(part, "digitize").select("p_partkey", F.col("p_retailprice").alias("bin"))


@query("e17_fill_tokens", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, 'missing') AS status, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END, -999.0) AS price FROM orders")
def fill_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("price"))
    return S.filled(rows)


# ---- model

@query("m03_phi", "SELECT cluster, feature, category, count(*) AS n FROM (SELECT CAST(l_orderkey % 3 AS INTEGER) AS cluster, 'l_returnflag' AS feature, l_returnflag AS category FROM lineitem UNION ALL SELECT CAST(l_orderkey % 3 AS INTEGER), 'l_linestatus', l_linestatus FROM lineitem) GROUP BY ALL")
def phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("cluster", (F.col("l_orderkey") % 3).cast("int"))
    return sufficient_statistics(lines, ["l_returnflag", "l_linestatus"], kind="string")


@query("m03_posterior_mean", model_sql() + "SELECT CAST(cluster AS INTEGER) AS cluster, feature, CAST(k AS INTEGER) AS category, round(lp, 6) AS log_p FROM theta")
def posterior_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir)[1].theta.select("cluster", "feature", "category", rounded(F.col("log_p")).alias("log_p"))


@query("m06_dirichlet_score", model_sql() + "SELECT CAST(cluster AS INTEGER) AS cluster, feature, round(sum((1.5 - 1) * lp) - sum(lgamma(1.5)) + lgamma(sum(1.5::DOUBLE)), 6) AS score FROM theta GROUP BY ALL")
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    theta = fitted(spark, sf_dir)[1].theta.withColumn("alpha", F.lit(1.5))
    return dirichlet_score(theta, ["cluster", "feature"]).select("cluster", "feature", rounded(F.col("score")).alias("score"))


_GRID = [0.1, 0.5, 1.0, 2.0, 5.0]
_GRID_SQL = "(SELECT unnest([0.1, 0.5, 1.0, 2.0, 5.0])::DOUBLE AS alpha)"


@query("m07_alpha_pi_grid", model_sql() + f", v AS (SELECT alpha, lgamma(c * alpha) - c * lgamma(alpha) + (alpha - 1) * s AS v FROM {_GRID_SQL} g, (SELECT count(*) AS c, sum(lp) AS s FROM pi)) SELECT alpha, round(v - (SELECT max(v) + ln(sum(exp(v - (SELECT max(v) FROM v)))) FROM v), 6) AS log_post FROM v")
def alpha_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alpha_pi_posterior(fitted(spark, sf_dir)[1].pi, _GRID).select("alpha", rounded(F.col("log_post")).alias("log_post"))


@query("m08_alpha_theta_grid", model_sql() + f", g2 AS (SELECT cluster, feature, count(*) AS c, sum(lp) AS s FROM theta GROUP BY ALL), v AS (SELECT alpha, sum(lgamma(c * alpha) - c * lgamma(alpha) + (alpha - 1) * s) AS v FROM {_GRID_SQL} g, g2 GROUP BY alpha) SELECT alpha, round(v - (SELECT max(v) + ln(sum(exp(v - (SELECT max(v) FROM v)))) FROM v), 6) AS log_post FROM v")
def alpha_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alpha_theta_posterior(fitted(spark, sf_dir)[1].theta, _GRID).select("alpha", rounded(F.col("log_post")).alias("log_post"))


# ---- questions

@query("q03_logprob", model_sql() + joint_sql(False) + "SELECT o_orderkey, round(lse, 6) AS log_p FROM lse")
def logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = fitted(spark, sf_dir)
    return model.logprob(rows).select("o_orderkey", rounded(F.col("log_p")).alias("log_p"))


@query("q07_logprob_missing", model_sql() + joint_sql(True) + "SELECT o_orderkey, round(lse, 6) AS log_p FROM lse")
def logprob_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = fitted(spark, sf_dir)
    return model.logprob(hidden(rows)).select("o_orderkey", rounded(F.col("log_p")).alias("log_p"))


@query("q04_posterior", model_sql() + joint_sql(True) + "SELECT j.o_orderkey, CAST(cluster AS INTEGER) AS cluster, round(v - lse, 6) AS log_p FROM j JOIN lse USING (o_orderkey)")
def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = fitted(spark, sf_dir)
    out = model.posterior(hidden(rows)).select("o_orderkey", F.posexplode("posterior").alias("cluster", "log_p"))
    return out.select("o_orderkey", "cluster", rounded(F.col("log_p")).alias("log_p"))


_IMPUTE = ", p AS (SELECT j.o_orderkey, t.k, round(sum(exp(v - lse + t.lp)), 12) AS p FROM j JOIN lse USING (o_orderkey) JOIN theta t ON t.cluster = j.cluster AND t.feature = 'o_orderpriority' WHERE j.o_orderkey % 4 = 0 GROUP BY ALL), best AS (SELECT o_orderkey, arg_max(k, (p, -k)) AS k FROM p GROUP BY o_orderkey)"


@query("q06_impute", model_sql() + joint_sql(True) + _IMPUTE + " SELECT enc.o_orderkey, CAST(coalesce(best.k, enc.f1) AS INTEGER) AS priority FROM enc LEFT JOIN best USING (o_orderkey)")
def impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = fitted(spark, sf_dir)
    return model.impute(hidden(rows)).select("o_orderkey", F.col("o_orderpriority").alias("priority"))


_ACC = model_sql() + joint_sql(True) + _IMPUTE + ", a AS (SELECT count(*) AS n, count(*) FILTER (best.k = enc.f1) AS c FROM enc JOIN best USING (o_orderkey)) "


@query("j11_impute_accuracy", _ACC + "SELECT 'o_orderpriority' AS feature, n AS n_imputed, n AS n_evaluated, c AS n_correct, round(c / n::DOUBLE, 6) AS accuracy FROM a")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = fitted(spark, sf_dir)
    masked = hidden(rows)
    out = M.imputation_accuracy(model.impute(masked), masked, rows, "o_orderkey", FEATURES)
    return out.withColumn("accuracy", rounded(F.col("accuracy")))


@query("j12_wilson", _ACC + "SELECT round((c / n::DOUBLE + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n), 6) AS centre, round(greatest(0, (c / n::DOUBLE + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) - 1.959963984540054 * sqrt(c / n::DOUBLE * (1 - c / n::DOUBLE) / n + 3.841458820694124 / (4 * n * n)) / (1 + 3.841458820694124 / n)), 6) AS low, round(least(1, (c / n::DOUBLE + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) + 1.959963984540054 * sqrt(c / n::DOUBLE * (1 - c / n::DOUBLE) / n + 3.841458820694124 / (4 * n * n)) / (1 + 3.841458820694124 / n)), 6) AS high FROM a")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    centre, low, high = M.wilson(F.col("n_correct"), F.col("n_evaluated"))
    return accuracy(spark, sf_dir).select(rounded(centre).alias("centre"), rounded(low).alias("low"), rounded(high).alias("high"))


@query("q08_prior_mode", model_sql() + "SELECT feature, CAST(arg_max(k, (p, -k)) AS INTEGER) AS category FROM (SELECT feature, k, round(sum(exp(t.lp + pi.lp)), 12) AS p FROM theta t JOIN pi USING (cluster) GROUP BY ALL) GROUP BY feature")
def prior_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir)[1].prior_mode()


@query("q09_prior_mode_rows", model_sql() + "SELECT r.range AS row_id, feature, category FROM range(10) r, (SELECT feature, CAST(arg_max(k, (p, -k)) AS INTEGER) AS category FROM (SELECT feature, k, round(sum(exp(t.lp + pi.lp)), 12) AS p FROM theta t JOIN pi USING (cluster) GROUP BY ALL) GROUP BY feature)")
def prior_mode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(10).withColumnRenamed("id", "row_id").crossJoin(F.broadcast(fitted(spark, sf_dir)[1].prior_mode()))


_MARG = ", mg AS (SELECT feature, k, sum(exp(t.lp + pi.lp)) AS p FROM theta t JOIN pi USING (cluster) GROUP BY ALL)"
_MI = ", jt AS (SELECT a.feature AS fi, b.feature AS fj, a.k AS k, b.k AS l, sum(exp(pi.lp + a.lp + b.lp)) AS p FROM theta a JOIN theta b ON a.cluster = b.cluster AND a.feature < b.feature JOIN pi ON pi.cluster = a.cluster GROUP BY ALL), mi AS (SELECT fi AS feature_i, fj AS feature_j, greatest(0, sum(CASE WHEN p > 1e-10 THEN p * ln((p + 1e-10) / (pi_ * pj_ + 1e-10)) ELSE 0 END)) AS mi FROM (SELECT *, sum(p) OVER (PARTITION BY fi, fj, k) AS pi_, sum(p) OVER (PARTITION BY fi, fj, l) AS pj_ FROM jt) GROUP BY ALL)"
_ENT = ", en AS (SELECT feature, -sum(p * ln(p)) AS entropy FROM mg WHERE p > 1e-10 GROUP BY feature)"


@query("q10_mi_pairs", model_sql() + _MI + " SELECT feature_i, feature_j, round(mi, 6) AS mi FROM mi")
def mi_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir)[1].mutual_information().withColumn("mi", rounded(F.col("mi")))


@query("q11_mi_cluster", model_sql() + ", c AS (SELECT t.feature, t.k, pi.lp AS lpi, exp(t.lp + pi.lp) AS p FROM theta t JOIN pi USING (cluster)) SELECT feature, round(greatest(0, sum(CASE WHEN p > 1e-10 THEN p * ln((p + 1e-10) / (pk * exp(lpi) + 1e-10)) ELSE 0 END)), 6) AS mi FROM (SELECT *, sum(p) OVER (PARTITION BY feature, k) AS pk FROM c) GROUP BY feature")
def mi_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir)[1].mutual_information_cluster().withColumn("mi", rounded(F.col("mi")))


@query("q12_mi_matrix", model_sql() + _MARG + _MI + _ENT + " SELECT feature_i, feature_j, round(mi, 6) AS value FROM mi UNION ALL SELECT feature_j, feature_i, round(mi, 6) FROM mi UNION ALL SELECT feature, feature, round(entropy, 6) FROM en")
def mi_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir)[1].mutual_information_matrix().withColumn("value", rounded(F.col("value")))


@query("q13_entropy", model_sql() + _MARG + _ENT + " SELECT feature, round(entropy, 6) AS entropy FROM en")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir)[1].entropy().withColumn("entropy", rounded(F.col("entropy")))


@query("q17_dataset_loglik", model_sql() + joint_sql(True) + "SELECT round(sum(lse), 3) AS total, round(avg(lse), 6) AS per_row, count(*) AS n FROM lse")
def dataset_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = fitted(spark, sf_dir)
    return model.logprob(hidden(rows)).agg(F.round(F.sum("log_p"), 3).alias("total"), F.round(F.avg("log_p"), 6).alias("per_row"), F.count("*").alias("n"))


@query("q22_model_state", model_sql() + "SELECT round((SELECT sum(exp(lp)) FROM pi), 6) AS pi_sum, round((SELECT sum(exp(lp)) FROM theta), 6) AS theta_sum, CAST((SELECT arg_max(cluster, (round(lp, 9), -cluster)) FROM pi) AS INTEGER) AS largest, (SELECT count(*) FROM theta) AS n_cells")
def model_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model, _ = fitted(spark, sf_dir)
    a = model.pi.agg(rounded(F.sum(F.exp("log_p"))).alias("pi_sum"), F.max_by("cluster", F.struct(F.round("log_p", 9), -F.col("cluster"))).alias("largest"))
    return a.crossJoin(model.theta.agg(rounded(F.sum(F.exp("log_p"))).alias("theta_sum"), F.count("*").alias("n_cells"))).select("pi_sum", "theta_sum", "largest", "n_cells")


def u_sql(*parts: str) -> str:
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query("i02_assign", model_sql() + joint_sql(False) + f", cum AS (SELECT j.o_orderkey, cluster, sum(exp(v - lse)) OVER (PARTITION BY j.o_orderkey ORDER BY cluster) AS c, {u_sql(str(SEED), repr('assign'), 'j.o_orderkey')} AS u FROM j JOIN lse USING (o_orderkey)) SELECT o_orderkey, CAST(coalesce(min(cluster) FILTER (c > u), 2) AS INTEGER) AS cluster FROM cum GROUP BY o_orderkey")
def assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = fitted(spark, sf_dir)
    post = model.posterior(rows)
    return post.select("o_orderkey", draw_index(F.transform("posterior", F.exp), uniform(SEED, "assign", F.col("o_orderkey"))).alias("cluster"))


@query("q01_sample_rows", model_sql() + f", r AS (SELECT range AS row_id FROM range(200)), c AS (SELECT row_id, min(cluster) FILTER (c > u * t) AS cluster FROM (SELECT row_id, cluster, sum(exp(lp)) OVER (PARTITION BY row_id ORDER BY cluster) AS c, sum(exp(lp)) OVER (PARTITION BY row_id) AS t, {u_sql(str(SEED), repr('c'), 'row_id')} AS u FROM r, pi) GROUP BY row_id), d AS (SELECT row_id, feature, k, sum(exp(lp)) OVER (PARTITION BY row_id, feature ORDER BY k) AS c, sum(exp(lp)) OVER (PARTITION BY row_id, feature) AS t, {u_sql(str(SEED), 'feature', 'row_id')} AS u FROM c JOIN theta USING (cluster)) SELECT row_id, CAST(min(k) FILTER (c > u * t AND feature = 'o_orderstatus') AS INTEGER) AS o_orderstatus, CAST(min(k) FILTER (c > u * t AND feature = 'o_orderpriority') AS INTEGER) AS o_orderpriority, CAST(min(k) FILTER (c > u * t AND feature = 'o_totalprice') AS INTEGER) AS o_totalprice FROM d GROUP BY row_id")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir)[1].sample(200, SEED)


@query("q05_sample_conditional", model_sql() + joint_sql(True) + f", c AS (SELECT o_orderkey, min(cluster) FILTER (c > u) AS cluster FROM (SELECT j.o_orderkey, cluster, sum(exp(v - lse)) OVER (PARTITION BY j.o_orderkey ORDER BY cluster) AS c, {u_sql(str(SEED), repr('c'), 'j.o_orderkey')} AS u FROM j JOIN lse USING (o_orderkey) WHERE j.o_orderkey % 4 = 0) GROUP BY 1), d AS (SELECT o_orderkey, min(k) FILTER (c > u * t) AS k FROM (SELECT o_orderkey, k, sum(exp(lp)) OVER (PARTITION BY o_orderkey ORDER BY k) AS c, sum(exp(lp)) OVER (PARTITION BY o_orderkey) AS t, {u_sql(str(SEED), repr('o_orderpriority'), 'o_orderkey')} AS u FROM c JOIN theta USING (cluster) WHERE feature = 'o_orderpriority') GROUP BY 1) SELECT enc.o_orderkey, CAST(coalesce(d.k, enc.f1) AS INTEGER) AS priority FROM enc LEFT JOIN d USING (o_orderkey)")
def sample_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = fitted(spark, sf_dir)
    return model.sample_conditional(hidden(rows), SEED, "o_orderkey").select("o_orderkey", F.col("o_orderpriority").alias("priority"))


_PARTICLES = "(SELECT o_orderkey % 16 AS particle, max(o_totalprice) / 20000.0 AS log_w FROM orders GROUP BY 1)"


def _particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 16).alias("particle")).agg((F.max("o_totalprice") / 20000.0).alias("log_w"))


@query("i10_effective_sample_size", f"WITH p AS {_PARTICLES}, e AS (SELECT exp(log_w - (SELECT max(log_w) FROM p)) AS e FROM p) SELECT round(sum(e) * sum(e) / sum(e * e), 6) AS ess FROM e")
def ess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effective_sample_size(_particles(spark, sf_dir)).select(rounded(F.col("ess")).alias("ess"))


@query("i11_resample", f"WITH p AS {_PARTICLES}, w AS (SELECT particle, exp(log_w - (SELECT max(log_w) FROM p)) AS e FROM p), c AS (SELECT particle, sum(e / (SELECT sum(e) FROM w)) OVER (ORDER BY particle) AS c FROM w) SELECT q.particle, coalesce(min(c.particle) FILTER (c.c > {u_sql(str(SEED), repr('resample'), '0', 'q.particle')}), max(c.particle)) AS ancestor FROM p q, c GROUP BY q.particle")
def resample_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_particles(spark, sf_dir), SEED, 0)


@query("q16_weighted_loglik", f"WITH p AS {_PARTICLES}, w AS (SELECT particle, exp(log_w - (SELECT max(log_w) FROM p)) AS e FROM p), t AS (SELECT o_orderkey % 16 AS particle, -sum(o_totalprice) / 1e6 AS ll FROM orders GROUP BY 1), v AS (SELECT ll + ln(e / (SELECT sum(e) FROM w)) AS v FROM t JOIN w USING (particle)) SELECT round(max(v) + ln(sum(exp(v - (SELECT max(v) FROM v)))), 6) AS log_likelihood FROM v")
def weighted_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 16).alias("particle")).agg((-F.sum("o_totalprice") / 1e6).alias("ll"))
    return weighted_log_likelihood(totals, _particles(spark, sf_dir)).select(rounded(F.col("log_likelihood")).alias("log_likelihood"))


__all__ = ["D", "W", "entry", "oracle_sql", "queries", "query"]
