"""Closed-form answers, invariants and parity with plain numpy for the library's own operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixlake.functions import exprs as X
from mixlake.operators import distances as D
from mixlake.operators import inference as I
from mixlake.operators import metrics as M
from mixlake.operators import schema as S
from mixlake.operators.model import Model, alpha_pi_posterior, dirichlet_score, effective_sample_size, resample


def model(spark, pi, theta):
    """theta[c][d][k] in probability; zeros allowed."""
    log = lambda p: math.log(p) if p > 0 else -math.inf
    rows = [(c, f"f{d}", k, log(p)) for c, t in enumerate(theta) for d, f in enumerate(t) for k, p in enumerate(f)]
    return Model(spark.createDataFrame([(c, log(p)) for c, p in enumerate(pi)], "cluster int, log_p double"), spark.createDataFrame(rows, "cluster int, feature string, category int, log_p double"), len(pi), tuple(f"f{d}" for d in range(len(theta[0]))))


def rows(spark, cells):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "row_id long, " + ", ".join(f"f{d} int" for d in range(len(cells[0]))))


def test_logprob(spark):
    m = model(spark, [0.5, 0.5], [[[0.7, 0.2, 0.1]], [[0.1, 0.2, 0.7]]])
    assert [math.exp(r.log_p) for r in m.logprob(rows(spark, [(0,), (1,), (2,)])).orderBy("row_id").collect()] == pytest.approx([0.4, 0.2, 0.4])
    m = model(spark, [0.5, 0.5], [[[1, 0, 0], [1, 0, 0]], [[0, 1, 0], [0, 1, 0]]])
    got = [r.log_p for r in m.logprob(rows(spark, [(0, 0), (1, 1), (2, 2), (None, None), (0, None)])).orderBy("row_id").collect()]
    assert got[:2] == pytest.approx([math.log(0.5)] * 2) and got[2] == -math.inf and got[3:] == pytest.approx([0, math.log(0.5)])
    m = model(spark, [0.5, 0.5], [[[0.7, 0.3], [0.8, 0.2]], [[0.4, 0.6], [0.3, 0.7]]])
    assert math.exp(m.logprob(rows(spark, [(0, None)])).first().log_p) == pytest.approx(0.55)


def test_posterior_and_imputation(spark):
    m = model(spark, [0.5, 0.5], [[[0.9, 0.1]] * 3, [[0.1, 0.9]] * 3])
    post = [math.exp(r.posterior[0]) for r in m.posterior(rows(spark, [(0, None, None), (0, 0, None), (None, None, None)])).orderBy("row_id").collect()]
    assert post == pytest.approx([0.9, 81 / 82, 0.5])
    got = [tuple(r)[1:] for r in m.impute(rows(spark, [(0, None, None), (1, 1, None), (None, None, None)])).orderBy("row_id").collect()]
    assert got == [(0, 0, 0), (1, 1, 1), (0, 0, 0)]


def test_sampling_frequencies_and_partition_independence(spark):
    m = model(spark, [0.5, 0.5], [[[0.7, 0.2, 0.1]], [[0.1, 0.2, 0.7]]])
    n = {r.f0: r["count"] / 10_000 for r in m.sample(10_000, 3).groupBy("f0").count().collect()}
    assert [n[k] for k in range(3)] == pytest.approx([0.4, 0.2, 0.4], abs=0.03)
    masked = rows(spark, [(None,)] * 50)
    draws = [sorted(tuple(r) for r in m.sample_conditional(masked.repartition(k), 5, "row_id").collect()) for k in (1, 3, 16)]
    assert draws[0] == draws[1] == draws[2]


def test_information(spark):
    same = model(spark, [0.5, 0.5], [[[1, 0], [1, 0]], [[0, 1], [0, 1]]])
    assert same.mutual_information().first().mi == pytest.approx(math.log(2), abs=1e-6)
    three = model(spark, [1 / 3] * 3, [[[1, 0, 0]], [[0, 1, 0]], [[0, 0, 1]]])
    assert three.mutual_information_cluster().first().mi == pytest.approx(math.log(3), abs=1e-6)
    ent = model(spark, [0.7, 0.3], [[[0.5, 0.3, 0.2]], [[0.1, 0.6, 0.3]]]).entropy().first().entropy
    assert ent == pytest.approx(-sum(p * math.log(p) for p in (0.38, 0.39, 0.23)))
    assert model(spark, [1], [[[0.25] * 4]]).entropy().first().entropy == pytest.approx(math.log(4))


def test_expressions(spark):
    row = spark.range(1).select(X.safe_ln(F.lit(0.0)).alias("a"), X.lse_array(F.array(F.lit(-math.inf), F.lit(-math.inf))).alias("b"), X.lse_array(F.array(F.lit(1000.0), F.lit(1000.0))).alias("c"), X.argmax_index(F.array(F.lit(1), F.lit(3), F.lit(3))).alias("d"), *(X.lgamma(F.lit(v)).alias(f"g{i}") for i, v in enumerate((0.5, 1.5, 9.0, 200.0)))).first()
    assert (row.a, row.b, row.d) == (-math.inf, -math.inf, 1) and row.c == pytest.approx(1000 + math.log(2))
    assert [row[f"g{i}"] for i in range(4)] == pytest.approx([math.lgamma(v) for v in (0.5, 1.5, 9.0, 200.0)])
    x = spark.createDataFrame([(k, p) for k, p in enumerate((0.2, 0.3, 0.5))], "k int, p double").withColumn("alpha", F.col("k") + 2.0).withColumn("log_p", F.ln("p")).withColumn("g", F.lit(1))
    assert dirichlet_score(x, ["g"]).first().score == pytest.approx(math.lgamma(9) - math.lgamma(2) - math.lgamma(3) - math.lgamma(4) + math.log(0.2) + 2 * math.log(0.3) + 3 * math.log(0.5))


def test_schema(spark):
    t = spark.createDataFrame([("x", 1.0, "a", 10.0), ("y", 2.5, "b", 20.0), ("x", 3.0, "a", 15.0), ("z", 3.7, "a", 25.0), ("y", 4.2, "c", 12.0), (None, None, None, None)], "cat_a string, num_b double, cat_c string, num_d double")
    schema = S.TableSchema.fit(t)
    got = schema.encode(t.limit(5).withColumn("i", F.lit(1)))
    assert [r.cat_a for r in t.join(schema.levels, F.col("cat_a") == F.col("label")).select("cat_a").limit(1).collect()]
    assert sorted((r.cat_a, r.cat_c) for r in got.collect()) == [(0, 0), (0, 0), (1, 1), (1, 2), (2, 0)]
    assert schema.encode(t.where("cat_a is null")).first().asDict() == {"cat_a": None, "num_b": None, "cat_c": None, "num_d": None}
    v = spark.createDataFrame([(float(i),) for i in range(1, 6)], "x double")
    s = S.TableSchema.fit(v, 5)
    assert s.features[0].edges == (1, 2, 3, 3, 4, 5) or s.features[0].edges == (1.0, 2.0, 3.0, 3.0, 4.0, 5.0)
    assert [r.x for r in s.discretize(v.orderBy("x")).collect()] == [0, 0, 1, 3, 4]
    with pytest.raises(ValueError):
        S.TableSchema.fit(spark.range(3))


def test_order_statistics_match_a_sort(spark):
    r = np.random.default_rng(0)
    for values in (r.normal(size=501), r.integers(0, 4, 300).astype(float), np.array([1e-300, 1e300, 0.0, -5.0]), np.full(7, 2.5)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        q = [i / 20 for i in range(21)]
        order = np.sort(values)
        assert S.order_statistics(df, "x", q) == [order[math.floor(f * (len(order) - 1) + 0.5)] for f in q]
    assert S.order_statistics(df.limit(0), "x", q) == []


def test_distances(spark):
    a = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x"), (None, "x")], "u string, v string")
    same = D.js_distance(a, a, ["u", "v"]).first().js
    assert same == pytest.approx(0, abs=1e-9)
    b = spark.createDataFrame([("C", "x"), ("C", "x")], "u string, v string")
    by = {r.feature: r.js for r in D.js_features(a, b, ["u", "v"]).collect()}
    assert by["u"] == pytest.approx(math.sqrt(math.log(2)), abs=1e-6)
    p, q = np.array([0.75, 0.25]), np.array([1.0, 0.0])
    m = (p + q) / 2
    assert by["v"] == pytest.approx(math.sqrt((sum(p * np.log(p / m)) + math.log(1 / m[0])) / 2), abs=1e-4)


def test_metrics(spark):
    assert [M.t_quantile(0.975, n) for n in (1, 5, 30)] == pytest.approx([12.7062, 2.570582, 2.042272], rel=1e-5)
    c, low, high = spark.range(1).select(*M.wilson(F.lit(8), F.lit(10))).first()
    assert (low, high) == pytest.approx((0.490162, 0.943318), abs=1e-5)
    assert spark.range(1).select(*M.wilson(F.lit(0), F.lit(0))).first()[0] == 0
    t = spark.createDataFrame([(0, 0.0, 1.0), (0, 1.0, 3.0), (1, 2.0, 5.0), (1, 4.0, 9.0)], "run int, time double, value double")
    got = {(r.run, r.i): r.value for r in M.interpolated(t, 5).collect()}
    for run, ts, vs in ((0, [0, 1], [1, 3]), (1, [2, 4], [5, 9])):
        assert [got[run, i] for i in range(5)] == pytest.approx(np.interp(range(5), ts, vs).tolist())
    s = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "s double, y int")
    assert M.auc(s, "s", "y").first().auc == pytest.approx(0.875)


def test_weights_and_grid(spark):
    w = spark.createDataFrame([(i, 0.0) for i in range(8)], "particle long, log_w double")
    assert effective_sample_size(w).first().ess == pytest.approx(8)
    one = spark.createDataFrame([(i, 0.0 if i == 3 else -1e9) for i in range(8)], "particle long, log_w double")
    assert {r.ancestor for r in resample(one, 1, 0).collect()} == {3}
    pi = spark.createDataFrame([(0, math.log(0.5)), (1, math.log(0.5))], "cluster int, log_p double")
    assert sum(math.exp(r.log_post) for r in alpha_pi_posterior(pi, [0.5, 1.0, 2.0]).collect()) == pytest.approx(1)


@pytest.fixture(scope="module")
def mixture(spark):
    r = np.random.default_rng(1)
    z = r.random(600) < 0.4
    x = np.where(z[:, None], r.choice(3, (600, 4), p=[0.85, 0.1, 0.05]), r.choice(3, (600, 4), p=[0.05, 0.1, 0.85]))
    return rows(spark, [tuple(int(v) for v in c) for c in x]).cache(), z


def test_fits(spark, mixture, tmp_path):
    data, z = mixture
    names = [f"f{d}" for d in range(4)]
    fit = I.smc(I.Fit(data, names, [3] * 4, f"file://{tmp_path}", 4, 2, seed=3), 600, 150, 4, 1)
    assert fit.p.rows.sum(1).max() <= 600 and np.isfinite(fit.p.log_w).all()
    now = fit.assigned()
    for a, b in zip([fit.p.rows, *fit.p.phi], (lambda c: [c[0], *c[1]])(I.counts(now, names, 4, 2, [3] * 4)), strict=True):
        assert np.array_equal(a, b)  # the kept counts are those of the kept clusters
    ll = I.log_likelihood(data, names, fit.p.pi, fit.p.theta) / 600
    assert max(ll) > -3.7  # one cluster alone has about -3.8
    chain = I.mcmc(I.Fit(data, names, [3] * 4, f"file://{tmp_path}", 1, 2, seed=4), 600, 200, 2)
    assert chain.p.rows.sum() == 600 and np.allclose(np.exp(chain.p.pi).sum(1), 1)
    again = [I.draw_clusters(data.repartition(k), names, fit.p, 9, 9, f"file://{tmp_path}/r{k}")[0] for k in (1, 5)]
    assert np.array_equal(*again)


def test_gradient_matches_finite_differences(spark, mixture):
    data, _ = mixture
    r = np.random.default_rng(2)
    pi, theta = r.normal(size=2), [r.normal(size=(2, 3)) for _ in range(4)]
    names = [f"f{d}" for d in range(4)]
    _, g, gt = I.gradient(data, names, pi, theta)
    for k in range(2):
        up = pi.copy()
        up[k] += 1e-5
        assert (I.gradient(data, names, up, theta)[0] - I.gradient(data, names, pi, theta)[0]) / 1e-5 == pytest.approx(g[k], abs=0.05)
    up = [t.copy() for t in theta]
    up[1][0, 2] += 1e-5
    assert (I.gradient(data, names, pi, up)[0] - I.gradient(data, names, pi, theta)[0]) / 1e-5 == pytest.approx(gt[1][0, 2], abs=0.05)


def same_state(a, b):
    for x, y in zip([a.p.pi, a.p.rows, a.p.log_w, a.p.gamma, *a.p.theta, *a.p.phi], [b.p.pi, b.p.rows, b.p.log_w, b.p.gamma, *b.p.theta, *b.p.phi], strict=True):
        assert np.allclose(x, y)


def test_training_resumes_as_if_it_had_not_stopped(spark, mixture, tmp_path):
    data, _ = mixture
    names = [f"f{d}" for d in range(4)]
    new = lambda k: I.Fit(data, names, [3] * 4, f"file://{tmp_path}/{k}", 3, 2, seed=5, keep=True)
    whole = I.train(new("a"), 600, 150, f"file://{tmp_path}/a/saved", 6, 2)  # the last two batches are the first two again
    I.train(new("b"), 600, 150, f"file://{tmp_path}/b/saved", 3, 2)
    assert I.saved_steps(data, f"file://{tmp_path}/b/saved") == [0, 2, 3]
    assert I.saved_steps(data, f"file://{tmp_path}/none") == [] and I.Fit.resume(data, f"file://{tmp_path}/none") is None
    fit, mark = I.Fit.resume(data, f"file://{tmp_path}/b/saved", 2)
    assert mark == -1 and fit.taken == 2 and fit.p.rows.sum(1).tolist() == [300] * 3
    I.train(fit, 600, 150, f"file://{tmp_path}/b/saved", 6, 2)
    same_state(whole, fit)
    assert whole.p.rows.sum(1).tolist() == [600] * 3 and [h["step"] for h in fit.p.history] == list(range(6))
    for x, y in zip(whole.p.history, fit.p.history, strict=True):
        assert x["ess"] == pytest.approx(y["ess"]) and all(np.allclose(p, q) for p, q in zip([x["pi"], *x["theta"]], [y["pi"], *y["theta"]], strict=True))
    # merged files hold what the steps drew: the kept counts are those of the kept clusters
    assert max(level for *_, level in fit.written) == 1 and len(fit.written) == 3
    rows, phi = I.counts(fit.assigned(), names, 3, 2, [3] * 4)
    assert np.array_equal(rows, fit.p.rows) and all(map(np.array_equal, phi, fit.p.phi))
    with pytest.raises(ValueError):
        I.train(fit, 600, 601, f"file://{tmp_path}/b/saved")


def test_gradient_history(spark, mixture, tmp_path):
    data, _ = mixture
    history = []
    pi, theta, losses = I.gradient_fit(I.Fit(data, [f"f{d}" for d in range(4)], [3] * 4, f"file://{tmp_path}", 1, 2, seed=6), 300, 3, 600, history=history)
    assert len(history) == len(losses) == 3
    for x, logits in zip([pi, *theta], history[-1], strict=True):
        assert np.allclose(np.exp(x), np.exp(logits) / np.exp(logits).sum(-1, keepdims=True))
