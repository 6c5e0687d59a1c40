"""Registered queries of boosted trees: what a table teaches about another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlake.functions.exprs import rounded
from mixlake.operators.boosting import utility
from mixlake.plans.registry import FEATURES, SEED, edges_sql, fitted, query, table
from mixlake.sources.scratch import materialize

_EVEN = "(SELECT * FROM orders WHERE o_orderkey % 2 = 0)"
_STUMP = f"""WITH edges AS MATERIALIZED {edges_sql(_EVEN, 'o_totalprice', 20)},
l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT o_orderpriority AS label FROM {_EVEN})),
x AS MATERIALIZED (SELECT o.o_orderkey % 2 AS side, CAST(o.o_orderstatus = 'O' AS INTEGER) AS y, any_value(l.k) AS k0, coalesce(min(e.i) FILTER (o.o_totalprice <= e.edge AND e.i BETWEEN 1 AND 19) - 1, 19) AS k1 FROM orders o JOIN l ON o.o_orderpriority = l.label CROSS JOIN edges e GROUP BY o.o_orderkey, o.o_orderstatus),
cells AS (SELECT f, k, sum(0.5 - y) AS g, sum(0.25) AS h FROM (SELECT 0 AS f, k0 AS k, y FROM x WHERE side = 0 UNION ALL SELECT 1, k1, y FROM x WHERE side = 0) GROUP BY f, k),
runs AS (SELECT f, k, sum(g) OVER w AS g, sum(h) OVER w AS h, row_number() OVER w AS place, count(*) OVER (PARTITION BY f) AS n, sum(g) OVER (PARTITION BY f) AS tg, sum(h) OVER (PARTITION BY f) AS th FROM cells WINDOW w AS (PARTITION BY f ORDER BY CASE WHEN f = 0 THEN CAST(g AS DOUBLE) / (CAST(h AS DOUBLE) + 3) ELSE 0 END, k)),
best AS (SELECT f, place, CAST(g AS DOUBLE) AS g, CAST(h AS DOUBLE) AS h, CAST(tg AS DOUBLE) AS tg, CAST(th AS DOUBLE) AS th FROM runs WHERE place < n ORDER BY round(CAST(g AS DOUBLE) * g / (h + 3) + CAST(tg - g AS DOUBLE) * (tg - g) / (th - h + 3), 9) DESC, f, place LIMIT 1),
lefts AS (SELECT r.f, r.k FROM runs r JOIN best b ON r.f = b.f AND r.place <= b.place),
s AS MATERIALIZED (SELECT x.y, 1 / (1 + exp(0.1 * CASE WHEN (SELECT count(*) FROM lefts WHERE lefts.k = CASE WHEN best.f = 0 THEN x.k0 ELSE x.k1 END) > 0 THEN best.g / (best.h + 3) ELSE (best.tg - best.g) / (best.th - best.h + 3) END)) AS p FROM x, best WHERE x.side = 1),
r AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg, sum(sum(1 - y)) OVER (ORDER BY p) AS upto FROM s GROUP BY p)
SELECT (SELECT count(*) FROM x WHERE side = 0) AS n_train, (SELECT count(*) FROM s) AS n_test, CAST(2 AS INTEGER) AS n_classes, (SELECT round(avg(CAST((p > 0.5) = (y = 1) AS INTEGER)), 6) FROM s) AS accuracy, (SELECT round(sum(pos * (upto - neg / 2.0)) / (sum(pos) * sum(neg)), 6) FROM r) AS auc"""


@query("j18_stump_utility", _STUMP)
def stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order is open, learned by one tree of one level from the even orders, tested on the odd ones."""
    orders = table(spark, sf_dir, "orders").withColumn("open", F.when(F.col("o_orderstatus") == "O", "yes").otherwise("no"))
    train, test = (orders.where(F.col("o_orderkey") % 2 == k).select("o_orderpriority", "o_totalprice", "open") for k in (0, 1))
    out = utility(train, test, "open", rounds=1, depth=1)
    return out.withColumns({c: rounded(F.col(c)) for c in ("accuracy", "auc")})


@query("j18_synthetic_utility")
def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's status, learned from the orders (source real) and from as many rows drawn from their model (synthetic), tested on the orders."""
    rows, model, _ = fitted(spark, sf_dir)
    names = lambda df: df.select(*(F.col(f).cast("string").alias(f) for f in FEATURES))
    real = names(rows)
    made = materialize(names(model.sample(real.count(), SEED)), "made")  # drawn once
    out = None
    for source, train in (("real", real), ("synthetic", made)):
        one = utility(train, real, "o_orderstatus", rounds=5, depth=3).withColumn("source", F.lit(source))
        out = one if out is None else out.unionByName(one)
    return out
