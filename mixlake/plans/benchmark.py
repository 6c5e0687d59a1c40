"""Registered queries of the benchmarks around the models: loading masked tables, one-hot forms, checkpoints, scores and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlake.functions.exprs import rounded
from mixlake.operators import metrics as M
from mixlake.operators import schema as S
from mixlake.operators.model import particle_of_rows
from mixlake.plans.registry import FEATURES, edges_sql, fitted, model_sql, query, raw_orders, table, u_sql
from mixlake.sources import tables as T

_SEGMENTS = "l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT c_mktsegment AS label FROM customer))"


def _segment_hot(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return S.TableSchema.fit(rows.select("c_mktsegment")).encode(rows).withColumn("hot", S.one_hot(F.when(F.expr(where), F.col("c_mktsegment")), 5))


@query("e07_padded_one_hot", "WITH a AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT o_orderstatus AS label FROM orders)), b AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT o_orderpriority AS label FROM orders)) SELECT o_orderkey, CAST(a.k AS INTEGER) AS status, CAST(b.k AS INTEGER) AS priority, CAST(2 AS INTEGER) AS n_features, CAST(5 AS INTEGER) AS width, CAST(2 AS INTEGER) AS ones FROM orders JOIN a ON o_orderstatus = a.label JOIN b ON o_orderpriority = b.label")
def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["o_orderstatus", "o_orderpriority"]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", *names)
    schema = S.TableSchema.fit(orders.select(*names))
    sizes = {r.feature: r.k for r in schema.domain().groupBy("feature").agg(F.count("*").alias("k")).collect()}
    hot = schema.encode(orders).withColumn("hot", S.padded_one_hot(names, sizes))
    place = lambda i: S.from_one_hot(F.col("hot")[i], sizes[names[i]])
    return hot.select("o_orderkey", place(0).alias("status"), place(1).alias("priority"), F.size("hot").alias("n_features"), F.size(F.col("hot")[0]).alias("width"), F.aggregate(F.flatten("hot"), F.lit(0), lambda t, x: t + x).alias("ones"))


@query("e10_masked_tables", f"WITH e AS MATERIALIZED {edges_sql('(SELECT * FROM orders WHERE o_orderkey % 2 = 0)', 'o_totalprice', 20)}, l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT o_orderpriority AS label FROM orders WHERE o_orderkey % 2 = 0)) SELECT t.o_orderkey, CASE WHEN t.o_orderkey % 4 = 0 THEN -1 ELSE coalesce(CAST(any_value(l.k) AS INTEGER), -1) END AS priority, CAST(coalesce(min(e.i) FILTER (o_totalprice <= e.edge AND e.i BETWEEN 1 AND 19) - 1, 19) AS INTEGER) AS price, t.o_orderkey % 2 = 1 AS test FROM orders t LEFT JOIN l ON o_orderpriority = label CROSS JOIN e GROUP BY t.o_orderkey")
def masked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = raw_orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_totalprice")
    complete, test = orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")
    train = complete.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")))
    _, train, test, _ = S.masked_pair(train, test, complete=complete)
    both = train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))
    return both.select("o_orderkey", F.coalesce("o_orderpriority", F.lit(-1)).alias("priority"), F.col("o_totalprice").alias("price"), "test")


@query("e14_log_one_hot", f"WITH {_SEGMENTS} SELECT c_custkey, CAST(k AS INTEGER) AS code, CAST(4 AS INTEGER) AS n_impossible FROM customer JOIN l ON c_mktsegment = label")
def log_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _segment_hot(spark, sf_dir).withColumn("logs", S.log_one_hot(F.col("hot")))
    return logs.select("c_custkey", S.from_one_hot(S.from_log_one_hot(F.col("logs"))).alias("code"), F.size(F.filter("logs", lambda x: x < 0)).alias("n_impossible"))


@query("e15_one_hot_repair", f"WITH {_SEGMENTS} SELECT c_custkey, CAST(CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE k END AS INTEGER) AS code FROM customer JOIN l ON c_mktsegment = label")
def one_hot_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = _segment_hot(spark, sf_dir, "c_custkey % 7 <> 0")
    valid = F.array(*(F.lit(x) for x in (False, True, True, True, True)))
    return hot.select("c_custkey", S.from_one_hot(S.repaired(F.col("hot"), valid)).alias("code"))


@query("j14_timing", "SELECT count(*) AS n_batches, CAST(sum(user_id % 10 + 1) AS BIGINT) AS n_rows, round(avg(1000.0 * value / (user_id % 10 + 1)), 6) AS ms_per_row, round(stddev_pop(1000.0 * value / (user_id % 10 + 1)), 6) AS ms_deviation, round(CAST(sum(user_id % 10 + 1) AS DOUBLE) / sum(value), 6) AS rows_per_s FROM events")
def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("rows", F.col("user_id") % 10 + 1)
    return M.timing(ev, "value", "rows").withColumns({c: rounded(F.col(c)) for c in ("ms_per_row", "ms_deviation", "rows_per_s")})


@query("j18_accuracy", "WITH p AS (SELECT quality, CAST(n_chars > 1000 AS INTEGER) = quality AS hit FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), r AS (SELECT quality, count(*) AS n, count(*) FILTER (hit) AS h FROM p GROUP BY quality) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(h) / sum(n), 6) AS accuracy, round(avg(h / n), 6) AS macro_recall FROM r")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null")
    out = M.accuracy(rows.withColumn("guess", (F.col("n_chars") > 1000).cast("int")), "guess", "quality")
    return out.select("n", rounded(F.col("accuracy")).alias("accuracy"), rounded(F.col("macro_recall")).alias("macro_recall"))


_LANGS = {"de": 7, "en": 11, "es": 13, "fr": 17}


@query("j18_one_vs_rest", "WITH x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS class, doc_id * {m} % 1000 AS s, CAST(lang = '{c}' AS INTEGER) AS y FROM documents" for c, m in _LANGS.items()) + "), b AS (SELECT class, s, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY class ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) SELECT class, round(sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM c GROUP BY class")
def one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", *((F.col("doc_id") * m % 1000).alias(f"s_{c}") for c, m in _LANGS.items()))
    return M.auc_one_vs_rest(docs, "doc_id", "lang", list(_LANGS), [f"s_{c}" for c in _LANGS]).withColumn("auc", rounded(F.col("auc")))


@query("j21_step_throughput", "SELECT event_type, round(CAST(sum((event_id % 5 + 1) * (user_id % 100 + 1) * (1 + event_id % 3)) AS DOUBLE) / sum(value), 6) AS rate, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def step_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_type", "value", (F.col("event_id") % 5 + 1).alias("t"), (F.col("user_id") % 100 + 1).alias("b"), (F.col("event_id") % 3).alias("r"))
    return M.throughput(ev, "t", "b", "r", "value", "event_type").withColumns({c: rounded(F.col(c)) for c in ("rate", "mean", "sd")})


@query("q19_uniform_particles", f"SELECT o_orderkey, CAST(floor({u_sql('7', repr('particle'), 'o_orderkey')} * 4) AS INTEGER) AS particle FROM orders")
def uniform_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame([(p, 0.25) for p in range(4)], "particle int, w double")
    return particle_of_rows(table(spark, sf_dir, "orders").select("o_orderkey"), weights, 7, "o_orderkey")


@query("q20_checkpoints", "SELECT CAST(t AS BIGINT) AS target, CASE WHEN t > max(s) THEN max(s) ELSE arg_min(s, (s <> t // 10 * 10, abs(s - t), s)) END AS step FROM (SELECT DISTINCT user_id * 20 AS s FROM events), (SELECT unnest([0, 5, 17, 100, 1003, 1000000000]) AS t) GROUP BY t")
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.checkpoint_of(table(spark, sf_dir, "events").select((F.col("user_id") * 20).alias("step")), [0, 5, 17, 100, 1003, 1_000_000_000], 10)


@query("q22_state_counts", model_sql() + "SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n, count(*) FILTER (isfinite(lp)) AS n_finite, count(*) FILTER (NOT isfinite(lp)) AS n_impossible, round(sum(exp(lp)), 6) AS total FROM theta GROUP BY cluster")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir)[1].state().withColumn("total", rounded(F.col("total")))


@query("s12_dataset_runner", " UNION ALL ".join(f"SELECT '{name}' AS dataset, true AS ok, count(*) AS n_rows, CAST({len(columns)} AS INTEGER) AS n_features FROM {source}" for name, (source, columns) in T.DATASETS.items()))
def dataset_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = lambda df: (S.TableSchema.fit(df.select(*df.columns), 10).encode(df).count(), len(df.columns))
    return spark.createDataFrame([(name, ok, *(result if ok else (None, None))) for name, ok, _, result in T.run_all(spark, sf_dir, list(T.DATASETS), job)], "dataset string, ok boolean, n_rows long, n_features int")
