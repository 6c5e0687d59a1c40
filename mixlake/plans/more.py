"""More registered queries: distances, evaluation, reports and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlake.functions.exprs import rounded
from mixlake.operators import distances as D
from mixlake.operators import metrics as M
from mixlake.operators import schema as S
from mixlake.operators.model import Model, averaged
from mixlake.plans import replay as R
from mixlake.plans.registry import CLUSTERS, FEATURES, _IMPUTE, _MARG, edges_sql, SEED, fitted, hidden, joint_sql, model_sql, query, raw_orders, table, u_sql
from mixlake.sources.scratch import shared_dir

CATS = ["o_orderstatus", "o_orderpriority"]


def halves(spark: SparkSession, sf_dir: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", *columns)
    return orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")


_LONG = "lng AS (SELECT o_orderkey % 2 AS side, 'o_orderstatus' AS feature, o_orderstatus AS category FROM orders UNION ALL SELECT o_orderkey % 2, 'o_orderpriority', o_orderpriority FROM orders)"


def js_sql(counts: str, over: str, support: str = "count(*) OVER w") -> str:
    """Named subquery js (over, js) from counts (over, category, n1, n2)."""
    return f"pq AS (SELECT {over}, (n1 / sum(n1) OVER w + 1e-10) / (1 + 1e-10 * {support}) AS p, (n2 / sum(n2) OVER w + 1e-10) / (1 + 1e-10 * {support}) AS q FROM {counts} WINDOW w AS (PARTITION BY {over})), js AS (SELECT {over}, sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0)) AS js FROM pq GROUP BY {over})"


_CNT = "cnt AS (SELECT feature, category, count(*) FILTER (side = 0) AS n1, count(*) FILTER (side = 1) AS n2 FROM lng GROUP BY ALL)"


@query("j01_js", f"WITH {_LONG}, {_CNT}, {js_sql('cnt', 'feature')} SELECT feature, round(js, 6) AS js FROM js")
def js(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir, CATS)
    return D.js_features(a, b, CATS).withColumn("js", rounded(F.col("js")))


@query("j02_js_mean", f"WITH {_LONG}, {_CNT}, {js_sql('cnt', 'feature')} SELECT round(avg(js), 6) AS js FROM js")
def js_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir, CATS)
    return D.js_distance(a, b, CATS).withColumn("js", rounded(F.col("js")))


_EVEN = "(SELECT * FROM orders WHERE o_orderkey % 2 = 0)"


@query("j03_js_dataframes", f"WITH e AS (SELECT DISTINCT edge FROM {edges_sql(_EVEN, 'o_totalprice', 20)}), b AS (SELECT o_orderkey, count(*) FILTER (edge <= o_totalprice) AS k FROM orders, e GROUP BY o_orderkey), lng AS (SELECT o_orderkey % 2 AS side, 'o_totalprice' AS feature, CAST(k AS VARCHAR) AS category FROM b UNION ALL SELECT o_orderkey % 2, 'o_orderpriority', o_orderpriority FROM orders), {_CNT}, {js_sql('cnt', 'feature')} SELECT round(avg(js), 6) AS js FROM js")
def js_dataframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir, ["o_orderpriority", "o_totalprice"])
    schema = S.TableSchema.fit(a.select("o_orderpriority", "o_totalprice"))
    a, b = (schema.discretize(x, "digitize") for x in (a, b))
    return D.js_distance(a, b, ["o_orderpriority", "o_totalprice"]).withColumn("js", rounded(F.col("js")))


_PAIR = "lng AS (SELECT o_orderkey % 2 AS side, 'o_orderstatus' AS feature_i, 'o_orderstatus' AS feature_j, o_orderstatus AS category FROM orders UNION ALL SELECT o_orderkey % 2, 'o_orderpriority', 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey % 2, 'o_orderstatus', 'o_orderpriority', o_orderstatus || '|' || o_orderpriority FROM orders), cnt AS (SELECT feature_i, feature_j, category, count(*) FILTER (side = 0) AS n1, count(*) FILTER (side = 1) AS n2 FROM lng GROUP BY ALL)"


@query("j04_js_pairwise", f"WITH {_PAIR}, {js_sql('cnt', 'feature_i, feature_j')} SELECT feature_i, feature_j, round(js, 6) AS js FROM js")
def js_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir, CATS)
    return D.js_pairs(a, b, CATS).withColumn("js", rounded(F.col("js")))


@query("j05_js_dense", f"WITH {_PAIR}, s AS (SELECT *, CASE WHEN feature_i <> feature_j THEN 80 WHEN feature_i = 'o_orderstatus' THEN 8 ELSE 10 END AS s FROM cnt), {js_sql('s', 'feature_i, feature_j', 's')} SELECT feature_i, feature_j, round(js, 6) AS js FROM js")
def js_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir, CATS)
    return D.js_pairs(a, b, CATS, dense={"o_orderstatus": 8, "o_orderpriority": 10}).withColumn("js", rounded(F.col("js")))


_BOOL = {"is_f": "o_orderstatus = 'F'", "is_urgent": "o_orderpriority = '1-URGENT'", "is_big": "o_totalprice > 150000"}


def _bools(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, b = halves(spark, sf_dir, FEATURES)
    cols = [F.expr(x).alias(n) for n, x in _BOOL.items()]
    return a.select(*cols), b.select(*cols)


def jsd_sql(over: str) -> str:
    return f"pq AS (SELECT {over}, n1 / sum(n1) OVER w AS p, n2 / sum(n2) OVER w AS q FROM cnt WINDOW w AS (PARTITION BY {over})) SELECT {over}, round(sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2, 6) AS jsd FROM pq GROUP BY {over}"


_BPAIRS = [("is_f", "is_urgent"), ("is_f", "is_big"), ("is_urgent", "is_big")]


@query("j06_js_bool", "WITH lng AS (" + " UNION ALL ".join(f"SELECT o_orderkey % 2 AS side, '{i}' AS feature_i, '{j}' AS feature_j, CAST({_BOOL[i]} AS INT) * 2 + CAST({_BOOL[j]} AS INT) AS category FROM orders" for i, j in _BPAIRS) + "), cnt AS (SELECT feature_i, feature_j, category, count(*) FILTER (side = 0) AS n1, count(*) FILTER (side = 1) AS n2 FROM lng GROUP BY ALL), " + jsd_sql("feature_i, feature_j"))
def js_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.js_boolean_pairs(*_bools(spark, sf_dir), list(_BOOL)).withColumn("jsd", rounded(F.col("jsd")))


@query("j07_js_onehot", "WITH lng AS (" + " UNION ALL ".join(f"SELECT o_orderkey % 2 AS side, '{i}' AS feature, CAST({x} AS VARCHAR) AS category FROM orders" for i, x in _BOOL.items()) + f"), {_CNT}, " + jsd_sql("feature"))
def js_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.js_one_hot(*_bools(spark, sf_dir), list(_BOOL)).withColumn("jsd", rounded(F.col("jsd")))


@query("j07_bivariate_mean", "WITH lng AS (" + " UNION ALL ".join(f"SELECT o_orderkey % 2 AS side, '{i}' AS feature_i, '{j}' AS feature_j, CAST({_BOOL[i]} AS INT) * 2 + CAST({_BOOL[j]} AS INT) AS category FROM orders" for i, j in _BPAIRS) + "), cnt AS (SELECT feature_i, feature_j, category, count(*) FILTER (side = 0) AS n1, count(*) FILTER (side = 1) AS n2 FROM lng GROUP BY ALL), one AS (WITH " + jsd_sql("feature_i, feature_j").replace("round(", "(").replace(", 6) AS jsd", ") AS jsd") + ") SELECT round(avg(jsd), 9) AS jsd FROM one")
def js_bivariate_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.js_one_hot_mean(*_bools(spark, sf_dir), list(_BOOL)).withColumn("jsd", rounded(F.col("jsd"), 9))


@query("j08_marginals", f"WITH {_LONG} SELECT feature, category, round(count(*) / sum(count(*)) OVER (PARTITION BY feature), 6) AS p FROM lng GROUP BY feature, category")
def marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.marginals(table(spark, sf_dir, "orders"), CATS).withColumn("p", rounded(F.col("p")))


_DIFF = f"{_LONG}, m AS (SELECT side, feature, category, count(*) / sum(count(*)) OVER (PARTITION BY side, feature) AS p FROM lng GROUP BY side, feature, category), g AS (SELECT feature, category, abs(sum(CASE side WHEN 0 THEN p ELSE -p END)) AS g FROM m GROUP BY ALL)"


@query("j09_tv", f"WITH {_DIFF} SELECT feature, round(sum(g) / 2, 6) AS tv FROM g GROUP BY feature")
def total_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir, CATS)
    return D.differences(D.marginals(a, CATS), D.marginals(b, CATS)).select("feature", rounded(F.col("tv")).alias("tv"))


@query("j23_mad_topk", f"WITH {_DIFF} SELECT feature, round(avg(g), 6) AS mad FROM g GROUP BY feature ORDER BY avg(g) DESC, feature LIMIT 5")
def mad_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir, CATS)
    return D.differences(D.marginals(a, CATS), D.marginals(b, CATS)).orderBy(F.desc("mad"), "feature").limit(5).select("feature", rounded(F.col("mad")).alias("mad"))


@query("j10_step_marginals", "WITH m AS (SELECT user_id % 10 AS step, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id % 10) AS p FROM events GROUP BY 1, 2) SELECT 'event_type' AS feature, event_type AS category, round(avg(p), 6) AS p FROM m GROUP BY event_type")
def step_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("step"), "event_type")
    return D.averaged_marginals(D.marginals(ev, ["event_type"], ["step"])).withColumn("p", rounded(F.col("p")))


@query("j15_missingness", "SELECT count(*) AS n, count(*) FILTER (toxic IS NULL) AS n_missing, round(100.0 * count(*) FILTER (toxic IS NULL) / count(*), 6) AS pct FROM documents LEFT JOIN labels USING (doc_id)")
def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    missing = F.count_if(F.col("toxic").isNull())
    return rows.agg(F.count("*").alias("n"), missing.alias("n_missing"), F.round(100.0 * missing / F.count("*"), 6).alias("pct"))


@query("j16_acf", "WITH s AS (SELECT count(*) AS n, avg(value) AS m, sum(value * value) - count(*) * avg(value) * avg(value) AS t FROM events) SELECT CAST(l.range AS INTEGER) AS lag, round(sum((a.value - m) * (b.value - m)) / max(t), 6) AS rho FROM range(31) l, events a, events b, s WHERE b.event_id = a.event_id + l.range GROUP BY 1")
def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.autocorrelation(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value").select("lag", rounded(F.col("rho")).alias("rho"))


@query("j18_auc", "WITH b AS (SELECT n_chars AS s, sum(toxic) AS pos, sum(1 - toxic) AS neg FROM documents JOIN labels USING (doc_id) GROUP BY 1), c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM c")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return M.auc(rows, "n_chars", "toxic").select(rounded(F.col("auc")).alias("auc"))


@query("j19_label_codes", "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_mktsegment AS label FROM customer UNION SELECT DISTINCT o_orderpriority FROM orders)")
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("x")), table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("x"))
    return M.label_codes(c, o, "x")


@query("j22_step_means", "SELECT CAST(event_id % 50 AS INTEGER) AS step, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(*) AS n FROM events GROUP BY 1")
def step_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy((F.col("event_id") % 50).cast("int").alias("step")).agg(rounded(F.avg("value")).alias("mean"), rounded(F.stddev_samp("value")).alias("sd"), F.count("*").alias("n"))


_RUNS = "(SELECT CAST(user_id % 3 AS INTEGER) AS run, CAST(event_id // 100 AS DOUBLE) AS time, avg(value) AS value FROM events GROUP BY 1, 2)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).cast("int").alias("run"), F.floor(F.col("event_id") / 100).cast("double").alias("time")).agg(F.avg("value").alias("value"))


@query("j24_interp_grid", f"WITH r AS MATERIALIZED {_RUNS}, g AS (SELECT range AS i, range * ((SELECT max(time) FROM r) / 40) AS t FROM range(41)), s AS (SELECT run, time AS t0, value AS v0, lead(time) OVER w AS t1, lead(value) OVER w AS v1, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY run ORDER BY time)) SELECT run, CAST(i AS INTEGER) AS i, round(CASE WHEN t <= t0 OR t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS value FROM s, g WHERE (t >= t0 OR n = 1) AND (t1 IS NULL OR t < t1)")
def interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.interpolated(_runs(spark, sf_dir), 41).select("run", F.col("i").cast("int").alias("i"), rounded(F.col("value")).alias("value"))


@query("j25_time_to_threshold", f"WITH r AS MATERIALIZED {_RUNS}, o AS (SELECT max(value) AS o FROM r) SELECT g AS gap, min(time) FILTER (value >= o - g) AS time FROM r, o, (SELECT unnest([50.0, 20.0, 5.0, 0.5])::DOUBLE AS g) GROUP BY g")
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return M.time_to_threshold(runs, "time", "value", runs.agg(F.max("value")).first()[0], [50.0, 20.0, 5.0, 0.5])


@query("q20_checkpoint_pick", "SELECT CAST(t AS BIGINT) AS target, arg_min(s, (abs(s - t), s)) AS event_id FROM (SELECT event_id AS s FROM events WHERE event_id % 37 = 0), (SELECT unnest([0, 10, 100, 1000, 999999]) AS t) GROUP BY t")
def checkpoint_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nearest_key(table(spark, sf_dir, "events").where("event_id % 37 = 0"), "event_id", [0, 10, 100, 1000, 999999])


@query("j27_best_final", "WITH f AS (SELECT event_type AS dataset, user_id % 5 AS config, arg_max(value, (event_id, value)) AS final FROM events GROUP BY 1, 2) SELECT dataset, arg_min(config, (final, config)) AS config, round(min(final), 6) AS final FROM f GROUP BY dataset")
def best_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), (F.col("user_id") % 5).alias("config"), "event_id", "value")
    return M.best_final(ev, "dataset", "config", "event_id", "value").withColumn("final", rounded(F.col("final")))


@query("r17_group_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    own = events.groupBy("event_type").agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_distinct("user_id").alias("users"))
    return own.join(M.grouped_median(events, ["event_type"], "value"), "event_type").withColumn("median", rounded(F.col("median")))


@query("r20_corr_label", "SELECT event_type, CASE WHEN corr(event_id, value) > 0.1 THEN 'increasing' WHEN corr(event_id, value) < -0.1 THEN 'decreasing' ELSE 'flat' END AS direction, round(corr(event_id, value), 6) AS corr FROM events GROUP BY event_type")
def corr_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("event_type").agg(F.corr("event_id", "value").alias("c"))
    return c.select("event_type", M.direction(F.col("c")).alias("direction"), rounded(F.col("c")).alias("corr"))


@query("r26_cumsum", "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cumulative(table(spark, sf_dir, "events"), ["event_id"], "value", "total", ["event_type"]).select("event_id", F.round("total", 4).alias("total"))


@query("r27_moving_avg", "SELECT event_id, round(m, 4) AS mean FROM (SELECT event_id, avg(value) OVER w AS m, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n >= 10")
def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.moving_average(table(spark, sf_dir, "events"), ["event_id"], "value", 10, "mean", ["event_type"]).select("event_id", F.round("mean", 4).alias("mean"))


@query("r30_right_split", "SELECT DISTINCT regexp_extract(p_type || '_' || p_brand, '^(.*)_([^_]*)$', 1) AS head, regexp_extract(p_type || '_' || p_brand, '^(.*)_([^_]*)$', 2) AS tail FROM part")
def right_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("_", "p_type", "p_brand")
    return table(spark, sf_dir, "part").select(F.regexp_extract(name, "^(.*)_([^_]*)$", 1).alias("head"), F.regexp_extract(name, "^(.*)_([^_]*)$", 2).alias("tail")).distinct()


@query("r32_percent_change", "SELECT round(100 * (avg(o_totalprice) FILTER (o_orderkey % 2 = 1) / avg(o_totalprice) FILTER (o_orderkey % 2 = 0) - 1), 6) AS pct FROM orders")
def percent_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.agg(F.avg("o_totalprice").alias(n)) for x, n in zip(halves(spark, sf_dir, ["o_totalprice"]), "ab", strict=True))
    return a.crossJoin(b).select(rounded(100 * (F.col("b") / F.col("a") - 1)).alias("pct"))


_GRP = "ev AS (SELECT user_id % 4 AS model, event_type AS category FROM events WHERE event_id % 2 = 0), ref AS (SELECT event_type AS category, count(*) AS n2 FROM events WHERE event_id % 2 = 1 GROUP BY 1), own AS (SELECT model, category, count(*) AS n1 FROM ev GROUP BY ALL), sup AS (SELECT DISTINCT model, category FROM (SELECT m.model, r.category FROM (SELECT DISTINCT model FROM own) m, ref r UNION ALL SELECT model, category FROM own)), cnt AS (SELECT model, category, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2 FROM sup LEFT JOIN own USING (model, category) LEFT JOIN ref USING (category))"


@query("r33_grouped_js", f"WITH {_GRP}, {js_sql('cnt', 'model')} SELECT model, round(js, 6) AS js FROM js")
def grouped_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("model"), "event_type")
    return D.js_grouped(ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1"), ["event_type"], ["model"]).withColumn("js", rounded(F.col("js")))


@query("r05_value_mapping", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderkey > 10 AND o_totalprice > 1000")
def value_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_totalprice is not null and o_orderstatus is not null and o_orderkey > 10 and o_totalprice > 1000")
    return rows.select("o_orderkey", F.col("o_orderstatus").alias("status")).replace({"F": "finished", "O": "open"}, subset=["status"])


@query("r11_distinct_sorted", "SELECT DISTINCT o_orderstatus, o_orderpriority, CAST(o_orderkey % 2 AS INTEGER) AS half, CAST(o_custkey % 3 AS INTEGER) AS third FROM orders")
def distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 2).cast("int").alias("half"), (F.col("o_custkey") % 3).cast("int").alias("third"))
    return o.distinct().orderBy("o_orderstatus", "o_orderpriority", "half", "third")


@query("r14_union_dropna", "SELECT src, x FROM (SELECT 'c' AS src, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS x FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier) WHERE x IS NOT NULL")
def union_dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("src"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("x"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("s").alias("src"), F.col("s_acctbal").alias("x"))).na.drop()


@query("q21_averaged_theta", model_sql() + ", t2 AS (SELECT cluster, feature, k, exp(lp) AS p FROM theta UNION ALL SELECT cluster, feature, k, 1.0 / count(*) OVER (PARTITION BY cluster, feature) FROM theta), a AS (SELECT cluster, feature, k, avg(p) AS p FROM t2 GROUP BY ALL) SELECT CAST(cluster AS INTEGER) AS cluster, feature, CAST(k AS INTEGER) AS category, round(ln(p / sum(p) OVER (PARTITION BY cluster, feature)), 6) AS log_p FROM a")
def averaged_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    theta = fitted(spark, sf_dir)[1].theta
    flat = theta.withColumn("log_p", -F.ln(F.count("*").over(W.partitionBy("cluster", "feature")).cast("double")))
    return averaged(theta.unionByName(flat)).withColumn("log_p", rounded(F.col("log_p")))


@query("q19_marginals", model_sql() + _MARG + " SELECT feature, CAST(k AS INTEGER) AS category, round(p, 6) AS p FROM mg")
def model_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir)[1].marginals().withColumn("p", rounded(F.col("p")))




# each order three times, once in each particle; a particle's three clusters are its own, so counts and weights are those of one model of nine
_PARTICLES = model_sql("p * 3 + CASE p WHEN 0 THEN o_orderkey % 3 WHEN 1 THEN o_custkey % 3 ELSE (o_orderkey + o_custkey) % 3 END", 9).replace("FROM orders, e1,", "FROM orders, (SELECT range AS p FROM range(3)), e1,").rstrip() + ", one AS MATERIALIZED (SELECT DISTINCT o_orderkey, f0, f1, f2 FROM enc)"


@query("q15_particle_impute", _PARTICLES + joint_sql(True).replace("enc", "one") + _IMPUTE + " SELECT one.o_orderkey, CAST(coalesce(best.k, one.f1) AS INTEGER) AS priority FROM one LEFT JOIN best USING (o_orderkey)")
def particle_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three particles (clusters by key modulo 3, by customer modulo 3, by both) as one mixture of all their clusters, each weighing alike."""
    orders = raw_orders(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_k"), "o_custkey"), F.col("o_orderkey") == F.col("_k")).drop("_k")
    schema = S.TableSchema.fit(orders.select(*FEATURES), 5)
    rows = schema.encode(orders)
    hashes = (F.col("o_orderkey") % 3, F.col("o_custkey") % 3, (F.col("o_orderkey") + F.col("o_custkey")) % 3)
    pi, theta = None, None
    for p, h in enumerate(hashes):
        m = Model.from_assignments(rows.withColumn("cluster", h), schema.domain(), FEATURES, CLUSTERS)
        own_pi = m.pi.select((F.col("cluster") + p * CLUSTERS).alias("cluster"), (F.col("log_p") - F.ln(F.lit(3.0))).alias("log_p"))
        own_theta = m.theta.withColumn("cluster", F.col("cluster") + p * CLUSTERS)
        pi, theta = (own_pi, own_theta) if pi is None else (pi.unionByName(own_pi), theta.unionByName(own_theta))
    model = Model(pi, theta, 3 * CLUSTERS, tuple(FEATURES))
    return model.impute(hidden(rows)).select("o_orderkey", F.col("o_orderpriority").alias("priority"))


@query("i01_joint", model_sql() + joint_sql(False) + "SELECT o_orderkey, CAST(cluster AS INTEGER) AS cluster, round(v, 6) AS log_p FROM j")
def joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = fitted(spark, sf_dir)
    out = model.joint(rows).select("o_orderkey", F.posexplode("joint").alias("cluster", "log_p"))
    return out.select("o_orderkey", "cluster", rounded(F.col("log_p")).alias("log_p"))


@query("i08_unassign_batch", "SELECT CAST(o_orderkey % 3 AS INTEGER) AS cluster, 'o_orderstatus' AS feature, CAST(k AS INTEGER) AS category, count(*) AS n FROM orders, (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT o_orderstatus AS label FROM orders)) WHERE label = o_orderstatus AND o_orderkey % 10 <> 0 GROUP BY ALL")
def unassign_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixlake.operators.model import sufficient_statistics

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    rows = S.TableSchema.fit(orders.select("o_orderstatus")).encode(orders).withColumn("cluster", (F.col("o_orderkey") % 3).cast("int"))
    batch = rows.where("o_orderkey % 10 = 0").select("o_orderkey")
    return sufficient_statistics(rows.join(batch, "o_orderkey", "left_anti"), ["o_orderstatus"]).select("cluster", "feature", "category", "n")


# ---- particles as one mixture, generators, traces

@query("q18_weighted_particle_rows", f"WITH p AS (SELECT o_orderkey % 16 AS particle, max(o_totalprice) / 20000.0 AS log_w FROM orders GROUP BY 1), w AS (SELECT particle, exp(log_w - (SELECT max(log_w) FROM p)) AS e FROM p), c AS (SELECT particle, sum(e) OVER (ORDER BY particle) AS c, sum(e) OVER () AS t FROM w), r AS (SELECT range AS row_id FROM range(300)) SELECT row_id, coalesce(min(particle) FILTER (c > t * {u_sql(str(SEED), repr('particle'), 'row_id')}), max(particle)) AS particle FROM r, c GROUP BY row_id")
def weighted_particle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The particle that each of 300 new rows is drawn from, by weight."""
    from mixlake.operators.model import particle_of_rows, particle_weights

    w = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 16).alias("particle")).agg((F.max("o_totalprice") / 20000.0).alias("log_w"))
    return particle_of_rows(spark.range(300).withColumnRenamed("id", "row_id"), particle_weights(w), SEED)


_TRUE = "(VALUES (0, 0, 0.7), (0, 1, 0.2), (0, 2, 0.1), (1, 0, 0.1), (1, 1, 0.2), (1, 2, 0.7)) v(cluster, k, p)"


@query("q23_true_model_rows", f"WITH t AS (SELECT * FROM {_TRUE}), r AS (SELECT range AS row_id FROM range(500)), c AS (SELECT row_id, CASE WHEN {u_sql(str(SEED), repr('c'), 'row_id')} < 0.6 THEN 0 ELSE 1 END AS cluster FROM r), d AS (SELECT row_id, feature, k, sum(p) OVER (PARTITION BY row_id, feature ORDER BY k) AS c, sum(p) OVER (PARTITION BY row_id, feature) AS s, {u_sql(str(SEED), 'feature', 'row_id')} AS u FROM c JOIN t USING (cluster), (SELECT unnest(['f0', 'f1']) AS feature)) SELECT row_id, CAST(min(k) FILTER (c > u * s AND feature = 'f0') AS INTEGER) AS f0, CAST(min(k) FILTER (c > u * s AND feature = 'f1') AS INTEGER) AS f1 FROM d GROUP BY row_id")
def true_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return true_model(spark, 2).sample(500, SEED)


@query("q24_optimal_loglik", f"WITH t AS (SELECT * FROM {_TRUE}), m AS (SELECT a.k AS i, b.k AS j, sum(CASE a.cluster WHEN 0 THEN 0.6 ELSE 0.4 END * a.p * b.p) AS p FROM t a JOIN t b ON a.cluster = b.cluster GROUP BY ALL) SELECT round(CAST(sum(p * ln(p)) AS DOUBLE), 6) AS log_likelihood FROM m")
def optimal_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best expected log-likelihood a row can have under the true model, by enumeration of all rows."""
    cells = spark.range(9).select((F.col("id") % 3).cast("int").alias("f0"), F.floor(F.col("id") / 3).cast("int").alias("f1"))
    return true_model(spark, 2).logprob(cells).agg(rounded(F.sum(F.exp("log_p") * F.col("log_p"))).alias("log_likelihood"))


def true_model(spark: SparkSession, features: int) -> Model:
    """Two clusters of weights .6 and .4 over three categories."""
    import math

    p = ((0.7, 0.2, 0.1), (0.1, 0.2, 0.7))
    theta = [(c, f"f{d}", k, math.log(p[c][k])) for c in range(2) for d in range(features) for k in range(3)]
    pi = spark.createDataFrame([(0, math.log(0.6)), (1, math.log(0.4))], "cluster int, log_p double")
    return Model(pi, spark.createDataFrame(theta, "cluster int, feature string, category int, log_p double"), 2, tuple(f"f{d}" for d in range(features)))


@query("j17_trace", "SELECT CAST(event_id // 500 AS BIGINT) AS step, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1")
def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 500).alias("step"))
    return ev.agg(rounded(F.avg("value")).alias("mean"), rounded(F.stddev_pop("value")).alias("sd"))


@query("j21_throughput", "SELECT event_type, round(count(*) * 30.0 / sum(value), 6) AS rate, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(rounded(F.count("*") * 30.0 / F.sum("value")).alias("rate"), rounded(F.stddev_pop("value")).alias("sd"))


@query("j28_cumulative_time", "SELECT event_id, round(2.0 + sum(value) OVER (PARTITION BY user_id % 7 ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS time FROM events")
def cumulative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("run", F.col("user_id") % 7)
    return M.cumulative(ev, ["event_id"], "value", "t", ["run"]).select("event_id", F.round(F.lit(2.0) + F.col("t"), 4).alias("time"))


@query("s11_run_settings", "SELECT p_partkey, CAST(p_size AS INTEGER) AS particles, CAST(p_partkey % 90 AS INTEGER) AS clusters, CAST(p_partkey % 7 AS INTEGER) AS steps, CAST(p_size * 10 AS INTEGER) AS batch FROM part")
def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixlake.sources.tables import run_settings as parsed

    name = F.concat(F.lit("run_P"), F.col("p_size"), F.lit("_C"), F.col("p_partkey") % 90, F.lit("_T"), F.col("p_partkey") % 7, F.lit("_B"), F.col("p_size") * 10, F.lit("_out"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("n")).select("p_partkey", *(c.alias(k) for k, c in parsed(F.col("n")).items()))


@query("r10_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("r12_count_distinct", "SELECT count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT o_custkey) AS customers, count(DISTINCT (o_orderstatus, o_orderpriority)) AS pairs FROM orders")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count_distinct("o_orderpriority").alias("priorities"), F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus", "o_orderpriority").alias("pairs"))


@query("r23_histogram", "SELECT CAST(b AS INTEGER) AS bin, count(o_totalprice) AS n FROM (SELECT range AS b FROM range(10)) LEFT JOIN orders ON least(floor(o_totalprice / 50000.0), 9) = b GROUP BY b")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of ten bins, empty ones included."""
    n = table(spark, sf_dir, "orders").groupBy(F.least(F.floor(F.col("o_totalprice") / 50000.0), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").na.fill(0, ["n"])


@query("r35_feature_pairs", "SELECT a.c AS feature_i, b.c AS feature_j FROM (SELECT unnest(['o_orderpriority', 'o_orderstatus', 'o_totalprice']) AS c) a, (SELECT unnest(['o_orderpriority', 'o_orderstatus', 'o_totalprice']) AS c) b WHERE a.c < b.c")
def feature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(f,) for f in FEATURES], "feature_i string")
    return names.join(names.withColumnRenamed("feature_i", "feature_j"), F.col("feature_i") < F.col("feature_j"))


# ---- fits: their draws have no SQL; tests hold them to invariants and closed forms


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int], int]:
    """Encoded orders with row_id, the key's rank by equal key ranges of hashed keys: here the key itself, dense enough for batches."""
    orders = raw_orders(spark, sf_dir)
    schema = S.TableSchema.fit(orders.select(*FEATURES), 5)
    sizes = {r.feature: r.k for r in schema.domain().groupBy("feature").agg(F.count("*").alias("k")).collect()}
    rows = schema.encode(orders).withColumn("row_id", F.col("o_orderkey"))
    return rows, [sizes[f] for f in FEATURES], orders.count()


def _summary(spark: SparkSession, fit, n_rows: int) -> DataFrame:
    """Weights, log pi and rows of each particle's clusters; every row is in one of them."""
    from mixlake.operators.inference import weights

    w = weights(fit.p.log_w)
    if (fit.p.rows.sum(-1) != n_rows).any():
        raise RuntimeError("a particle lacks rows")
    rows = [(p, c, float(w[p]), float(fit.p.pi[p, c]), int(fit.p.rows[p, c])) for p in range(fit.p.n) for c in range(fit.p.pi.shape[1])]
    out = spark.createDataFrame(rows, "particle int, cluster int, weight double, log_pi double, n long")
    return out.withColumns({c: rounded(F.col(c)) for c in ("weight", "log_pi")})


@query("smc_fit", R.fit_sql(1, 4, R.smc_moves(1, 3, 1)) + R.SUMMARY)
def smc_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixlake.operators.inference import Fit, smc

    rows, sizes, n = _encoded(spark, sf_dir)
    return _summary(spark, smc(Fit(rows, FEATURES, sizes, shared_dir(spark), 4, 3, seed=1), n, -(-n // 3), 3, 1), n)


@query("mcmc_fit", R.fit_sql(2, 1, R.mcmc_moves(2, 4, 2)) + R.SUMMARY)
def mcmc_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixlake.operators.inference import Fit, mcmc

    rows, sizes, n = _encoded(spark, sf_dir)
    return _summary(spark, mcmc(Fit(rows, FEATURES, sizes, shared_dir(spark), 1, 3, seed=2), n, n // 4, 2), n)


@query("hyper_fit", R.fit_sql(3, 3, R.smc_moves(3, 2, 0), [0.5, 1.0, 2.0]) + R.SUMMARY)
def hyper_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixlake.operators.inference import Fit, smc

    rows, sizes, n = _encoded(spark, sf_dir)
    grids = ([0.5, 1.0, 2.0], [0.5, 1.0, 2.0])
    return _summary(spark, smc(Fit(rows, FEATURES, sizes, shared_dir(spark), 3, 3, seed=3, grids=grids), n, -(-n // 2), 2), n)


@query("sgd_fit", R.DESCENT + R.descent_sql("a", 4, [R.chosen(4, t, f"({R.N} // 2)") for t in range(4)], 0.1) + " " + R.losses("a", 4))
def sgd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixlake.operators.inference import Fit, gradient_fit

    rows, sizes, n = _encoded(spark, sf_dir)
    _, _, losses = gradient_fit(Fit(rows, FEATURES, sizes, shared_dir(spark), 1, 3, seed=4), n // 2, 4, n)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "step int, loss double").withColumn("loss", rounded(F.col("loss"), 3))
