"""Wide tables and long groups: quantiles, dictionaries, pairs of columns and lags against plain versions, by every way of counting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixlake.operators import distances as D
from mixlake.operators import metrics as M
from mixlake.operators import schema as S
from mixlake.operators.model import Model


def test_quantiles_of_many_columns_by_few_scans(spark, monkeypatch):
    r = np.random.default_rng(4)
    n = 5000
    columns = {
        "normal": r.normal(size=n), "heavy": np.exp(r.normal(size=n) * 40), "ties": r.integers(0, 4, n).astype(float), "one": np.full(n, -7.5),
        "signs": np.where(r.random(n) < 0.5, -1, 1) * 10.0 ** r.integers(-300, 300, n), "zeros": np.where(r.random(n) < 0.9, -0.0, r.normal(size=n)),
        "infinite": np.where(r.random(n) < 0.2, math.inf, np.where(r.random(n) < 0.2, -math.inf, r.normal(size=n))),
    }
    gaps = r.random((n, len(columns))) < 0.05
    rows = [tuple(None if gaps[i, j] else float(v[i]) for j, v in enumerate(columns.values())) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", nothing double").repartition(3)
    scans, real = [], S._parts
    monkeypatch.setattr(S, "_parts", lambda *a: scans.append(1) or real(*a))
    q = [i / 20 for i in range(21)]
    got = S.order_statistics_of(df, {c: q for c in [*columns, "nothing"]})
    for j, (c, v) in enumerate(columns.items()):
        own = np.sort(v[~gaps[:, j]])
        assert got[c] == [own[math.floor(x * (len(own) - 1) + 0.5)] for x in q], c
    assert got["nothing"] == [] and len(scans) <= 2
    monkeypatch.setattr(S, "ACCURACY", 20)  # a sketch that misses
    monkeypatch.setattr(S, "PARTS", 100)
    assert S.order_statistics_of(df, {c: q for c in columns}) == {c: got[c] for c in columns}
    assert S.order_statistics_of(df, {}) == {} and S.order_statistics(df.limit(0), "normal", q) == []
    nan = spark.createDataFrame([(1.0,), (math.nan,), (2.0,), (math.nan,)], "x double")
    assert [repr(v) for v in S.order_statistics(nan, "x", [0.0, 0.25, 1.0])] == ["1.0", "2.0", "nan"]


def test_dictionaries_sent_or_joined_give_the_same_codes(spark, monkeypatch):
    r = random.Random(3)
    names = [f"c{i}" for i in range(12)]
    rows = [tuple(None if r.random() < 0.1 else f"{'é' * (i % 3)}v{r.randrange(3 + 40 * i)}" for i in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "id long, " + ", ".join(f"{c} string" for c in names)).repartition(3)
    schema = S.TableSchema.fit(df.where("id < 200").select(*names))
    known = {c: sorted({x[i] for x in rows[:200] if x[i] is not None}) for i, c in enumerate(names)}
    want = [(k, *(known[c].index(v) if v in known[c] else None for c, v in zip(names, x, strict=True))) for k, x in enumerate(rows)]
    assert "Join" not in schema.encode(df)._jdf.queryExecution().optimizedPlan().toString()
    for most in (100_000, 200, 0):
        monkeypatch.setattr(S, "PACKED_LEVELS", most)
        again = S.TableSchema(schema.features, schema.levels)
        assert len(again.packed) == (12 if most > 1000 else 0 if most == 0 else len(again.packed))
        assert sorted(map(tuple, again.encode(df).select("id", *names).collect())) == want
    assert {(x.feature, x.label): x.category for x in schema.levels.collect()} == {(c, v): k for c, own in known.items() for k, v in enumerate(own)}


def test_pairs_of_88_columns(spark, monkeypatch):
    r = random.Random(5)
    names = [f"f{i}" for i in range(88)]
    sides = [spark.createDataFrame([tuple(r.choice(["a", "b", None, "ab"][: 2 + i % 3]) for i in range(88)) for _ in range(n)], ", ".join(f"{c} string" for c in names)) for n in (60, 80)]
    a, b = (s.repartition(2) for s in sides)
    got = {(x.feature_i, x.feature_j): x.js for x in D.js_pairs(a, b, names).collect()}
    assert len(got) == 88 * 89 // 2
    monkeypatch.setattr(D, "COUNTED", 0)
    few = names[:6]
    for x in D.js_pairs(a, b, few).collect():
        assert got[x.feature_i, x.feature_j] == pytest.approx(x.js, abs=1e-12)
    by_pair = {tuple(x) for x in D.pair_counts(a, b, few).collect()}
    monkeypatch.setattr(D, "COUNTED", 4096)
    monkeypatch.setattr(D, "GRAM_ROWS", 7)
    assert {tuple(x) for x in D.pair_counts(a, b, few).collect()} == by_pair
    flags = [s.select(*(F.coalesce(F.col(c) == "a", F.lit(False)).alias(c) for c in few)) for s in (a, b)]
    pairs = [x.jsd for x in D.js_boolean_pairs(*flags, few).collect()]
    assert len(pairs) == 15 and D.js_one_hot_mean(*flags, few).first().jsd == pytest.approx(np.mean(pairs))
    assert D.js_one_hot_mean(*flags, few, bivariate=False).first().jsd == pytest.approx(np.mean([x.jsd for x in D.js_one_hot(*flags, few).collect()]))


def test_mutual_information_of_many_features(spark):
    r = np.random.default_rng(6)
    sizes = [2 + i % 4 for i in range(19)]
    pi = r.dirichlet(np.ones(3))
    theta = [np.stack([r.dirichlet(np.ones(k)) for _ in range(3)]) for k in sizes]
    theta[0][1] = [1.0, 0.0]
    names = [f"f{i:02}" for i in range(19)]
    model = Model(
        spark.createDataFrame([(c, float(np.log(pi[c]))) for c in range(3)], "cluster int, log_p double"),
        spark.createDataFrame([(c, f, k, float(np.log(t[c, k])) if t[c, k] else float("-inf")) for f, t in zip(names, theta, strict=True) for c in range(3) for k in range(t.shape[1])], "cluster int, feature string, category int, log_p double"),
        3, tuple(names),
    )
    got = {(x.feature_i, x.feature_j): x.mi for x in model.mutual_information().collect()}
    assert len(got) == 19 * 18 // 2
    for i, a in enumerate(names):
        for j, b in enumerate(names[i + 1 :], i + 1):
            p = np.einsum("c,ck,cl->kl", pi, theta[i], theta[j])
            q = np.outer(p.sum(1), p.sum(0))
            assert got[a, b] == pytest.approx(sum(x * math.log((x + 1e-10) / (y + 1e-10)) for x, y in zip(p.ravel(), q.ravel(), strict=True) if x > 1e-10), abs=1e-9)


def test_lags_across_blocks(spark, monkeypatch):
    r = np.random.default_rng(7)
    x = np.cumsum(r.normal(size=1000)) * 0.1 + r.normal(size=1000)
    df = spark.createDataFrame([(i + 3, float(v)) for i, v in enumerate(x)], "t long, x double").repartition(4)
    y = x - x.mean()
    want = [float((y[: len(y) - lag] * y[lag:]).sum() / (y * y).sum()) for lag in range(21)]
    for size in (50, 333, 100_000):
        monkeypatch.setattr(M, "BLOCK", size)
        got = {row.lag: row.rho for row in M.autocorrelation(df, "t", "x", 20).collect()}
        assert [got[lag] for lag in range(21)] == pytest.approx(want)
    assert M.autocorrelation(df.limit(0), "t", "x").count() == 0


def test_medians_of_groups_that_span_ranges(spark):
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None, "c"]), None if r.random() < 0.05 else float(r.randrange(50)), 1) for _ in range(2001)] + [("only null", None, 1), ("one", 5.0, 1)]
    got = {x.g: x.median for x in M.grouped_median(spark.createDataFrame(rows, "g string, v double, _n int").repartition(3), ["g"], "v").collect()}
    want = {g: float(np.median([v for h, v, _ in rows if h == g and v is not None])) for g in ("a", "b", None, "c", "one")}
    assert got == want


def test_checkpoints_are_measured_from_the_target(spark):
    steps = spark.createDataFrame([(0,), (20,), (40,)], "step long")
    got = {x.target: x.step for x in M.checkpoint_of(steps, [0, 4, 17, 25, 30, 39, 41], 10).collect()}
    assert got == {0: 0, 4: 0, 17: 20, 25: 20, 30: 20, 39: 40, 41: 40}


def test_few_levels_need_no_python_worker(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0), ("new", None)], "x string, y double")
    schema = S.TableSchema.fit(rows.where("x is null or x != 'new'"), 2)
    out = schema.encode(rows)
    assert "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.x for r in out.collect() if r.x is not None) == [0, 1] and out.where("x is null").count() == 2
