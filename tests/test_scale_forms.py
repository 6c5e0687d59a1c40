"""Wide models, both ways of scoring, sums along an order, and distances at their edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixlake.operators import distances as D
from mixlake.operators import metrics as M
from mixlake.operators import model as model_module
from mixlake.operators.model import Model
from mixlake.operators.ordering import running_sums


def wide(spark, n_features, n=40):
    r = random.Random(3)
    names = [f"f{i}" for i in range(n_features)]
    rows = [(i, i % 2, *(None if r.random() < 0.2 else r.randrange(3) for _ in names)) for i in range(n)]
    table = spark.createDataFrame(rows, "row_id long, cluster int, " + ", ".join(f"{x} int" for x in names))
    domain = spark.createDataFrame([(x, k, str(k)) for x in names for k in range(3)], "feature string, category int, label string")
    return names, rows, table, Model.from_assignments(table, domain, names, 2)


def test_many_features(spark):
    names, rows, table, model = wide(spark, 88)
    got = {r.row_id: r.log_p for r in model.logprob(table).collect()}
    n = [sum(r[1] == c for r in rows) for c in (0, 1)]
    for row in rows[:5]:
        total = 0.0
        for c in (0, 1):
            p = (n[c] + 1) / (len(rows) + 2)
            for j, x in enumerate(row[2:]):
                if x is not None:
                    own = [r[j + 2] for r in rows if r[1] == c and r[j + 2] is not None]
                    p *= (own.count(x) + 1) / (len(own) + 3)
            total += p
        assert got[row[0]] == pytest.approx(math.log(total))
    plan = model.logprob(table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("Relation") == 1


def test_large_models_score_alike(spark, monkeypatch):
    names, _, table, model = wide(spark, 4)
    outside = table.withColumn("f1", F.when(F.col("row_id") == 3, 7).otherwise(F.col("f1")))

    def answers(m):
        plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
        post = m.posterior(table).select("row_id", F.transform("posterior", lambda x: F.round(x, 9)).alias("p"))
        return plain(m.logprob(outside).select("row_id", "log_p")), plain(m.impute(table)), plain(m.sample_conditional(table, 5, "row_id")), sorted((r.row_id, tuple(r.p)) for r in post.collect())

    small = answers(model)
    monkeypatch.setattr(model_module, "PACKED", 0)
    assert answers(Model(model.pi, model.theta, 2, model.features)) == small


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(r.randrange(40), r.choice([None, -2, 5]), i) for i in range(500)]
    out = running_sums(spark.createDataFrame(rows, "k int, v int, total long").repartition(3), ["k", "total"], {"total": "v", "place": F.lit(1)})
    want, total = [], 0
    for place, (k, v, _) in enumerate(sorted(rows, key=lambda x: (x[0], x[2])), 1):
        total += v or 0
        want.append((k, v, total, place))
    assert sorted(map(tuple, out.collect()), key=lambda x: x[3]) == want
    assert running_sums(spark.createDataFrame([], "k int, v double"), ["k"], {"s": "v"}).count() == 0


def test_distances_tell_cells_apart_and_empty_sides_have_none(spark):
    a, b = (spark.createDataFrame([x] * 3, "x string, y string") for x in (("a|b", "c"), ("a", "b|c")))
    pairs = {(r.feature_i, r.feature_j): r.js for r in D.js_pairs(a, b, ["x", "y"]).collect()}
    assert all(v == pytest.approx(math.sqrt(math.log(2)), abs=1e-4) for v in pairs.values())
    null, minus = (spark.createDataFrame([(x,)] * 4, "x string") for x in (None, "-1"))
    assert D.js_distance(null, minus, ["x"]).first().js > 0.8
    assert D.js_distance(null, null, ["x"]).first().js == pytest.approx(0, abs=1e-6)
    assert D.js_distance(a, a.limit(0), ["x"]).first().js is None and D.js_distance(a.limit(0), a.limit(0), ["x"]).first().js is None
    bools = spark.createDataFrame([(True, False)] * 2, "p boolean, q boolean")
    assert D.js_boolean_pairs(bools, bools.limit(0), ["p", "q"]).first().jsd is None


def test_one_vs_rest_and_accuracy(spark):
    rows = [(i, "abc"[i % 3], float(i % 3 == 0), float(i % 2), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, y string, sa double, sb double, sc double")
    got = {r["class"]: r.auc for r in M.auc_one_vs_rest(df, "i", "y", ["a", "b", "c"], ["sa", "sb", "sc"]).collect()}
    for k, c in enumerate("abc"):
        pos, neg = ([r[k + 2] for r in rows if (r[1] == c) == side] for side in (True, False))
        assert got[c] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    assert M.accuracy(df.withColumn("g", F.lit("a")), "g", "y").first().accuracy == pytest.approx(1 / 3)


def test_sums_and_averages_of_groups_that_span_ranges(spark, monkeypatch):
    r = np.random.default_rng(8)
    group = r.choice([None, "a", "b", "c"], 3000, p=[0.1, 0.6, 0.2, 0.1]).tolist()
    data = [(g, int(t), None if t % 50 == 0 else float(x)) for g, t, x in zip(group, r.permutation(3000), r.normal(size=3000), strict=True)]
    df = spark.createDataFrame(data, "g string, t int, x double").repartition(3)
    sums, averages, rows = {}, {}, {}
    for g, t, x in sorted(data, key=lambda d: d[1]):
        rows.setdefault(g, []).append(x)
        have = rows[g]
        sums[t] = sum(v for v in have if v is not None)
        if len(have) >= 7:
            averages[t] = np.mean([v for v in have[-7:] if v is not None])
    monkeypatch.setattr(M, "BLOCK", 100)
    got = {x.t: x.total for x in M.cumulative(df, ["t"], "x", "total", ["g"]).collect()}
    assert got.keys() == sums.keys() and all(got[t] == pytest.approx(sums[t], abs=1e-9) for t in sums)
    got = {x.t: x.mean for x in M.moving_average(df, ["t"], "x", 7, "mean", ["g"]).collect()}
    assert got.keys() == averages.keys() and all(got[t] == pytest.approx(averages[t], abs=1e-9) for t in averages)
    got = [x.n for x in M.cumulative(df.withColumn("one", F.lit(1)), ["t"], "one", "n").orderBy("t").collect()]
    assert got == list(range(1, 3001))
    assert M.cumulative(df.limit(0), ["t"], "x", "total", ["g"]).count() == 0
