"""Particles dealt over tasks: against the form with particles on the driver, and the draws against SQL and their distributions."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mixlake.functions import draws
from mixlake.operators import inference as I
from mixlake.operators import swarm as S


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(1)
    z = r.random(600) < 0.4
    x = np.where(z[:, None], r.choice(3, (600, 4), p=[0.85, 0.1, 0.05]), r.choice(3, (600, 4), p=[0.05, 0.1, 0.85]))
    rows = [(i, *(None if r.random() < 0.05 else int(v) for v in c)) for i, c in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, f0 int, f1 int, f2 int, f3 int").repartition(3).cache(), ["f0", "f1", "f2", "f3"], [3] * 4


def state_of(swarm):
    rows = swarm.state.orderBy("particle").collect()
    return {c: np.array([r[c] for r in rows]) for c in ("pi", "theta", "rows", "phi", "log_w", "gamma")}


def test_draws_are_those_of_sql():
    db = duckdb.connect()
    ids = np.arange(200)
    want = draws.fold(draws.fold(draws.key(7, -1, draws.ROW), ids)[:, None], np.arange(3))
    got = db.sql(f"SELECT {draws.key_sql([7, -1, draws.ROW], 'i.range', 'p.range')} FROM range(200) i, range(3) p ORDER BY i.range, p.range").fetchall()
    assert [g[0] for g in got] == want.ravel().tolist()
    shapes = 1 + ids % 7 * 3.5
    own = draws.gamma(draws.fold(draws.key(7), ids), shapes)
    made = db.sql(f"WITH s AS (SELECT range AS i, 1 + range % 7 * 3.5 AS a, {draws.key_sql([7], 'range')} AS h FROM range(200)) SELECT g FROM ({draws.gamma_sql('s', 'i')}) ORDER BY i").fetchall()
    assert np.allclose(own, [g[0] for g in made], rtol=1e-12)


@pytest.mark.parametrize("shape", [0.3, 1.0, 2.5, 400.0])
def test_gamma_draws_have_their_moments(shape):
    g = draws.gamma(draws.fold(draws.key(3), np.arange(100_000)), np.array(shape))
    assert g.mean() == pytest.approx(shape, rel=0.03) and g.var() == pytest.approx(shape, rel=0.05)
    p = np.exp(draws.log_dirichlet(draws.fold(draws.key(4), np.arange(50_000)), np.tile([shape, 2 * shape], (50_000, 1)), None))
    assert p.sum(-1) == pytest.approx(1) and p[:, 0].mean() == pytest.approx(1 / 3, abs=0.01)


def test_blocks_are_read_alone(spark, data):
    rows, names, _ = data
    blocks = S.deal(rows, names, 130, seed=5)
    assert (blocks.n, blocks.n_rows, [blocks.size(b) for b in range(5)]) == (5, 600, [130] * 4 + [80])
    some = blocks.read(spark, [1, 4])
    assert len(some.collect()) == 210
    scan = some._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numOutputRows").value() == 210 and scan.metrics().apply("numPartitions").value() == 2  # the scan itself reads no other row
    all_ids = [r.row_id for b in range(5) for r in blocks.read(spark, [b]).orderBy("place").collect()]
    assert sorted(all_ids) == list(range(600)) and all_ids != list(range(600))
    first = S.deal(rows, names, 130).read(spark, [0])
    assert sorted(r.row_id for r in first.collect()) == list(range(130))


def test_equals_particles_on_the_driver(spark, data, tmp_path):
    rows, names, sizes = data
    fit = I.smc(I.Fit(rows, names, sizes, f"file://{tmp_path}", 6, 3, seed=3), 600, 150, 4)
    swarm = S.Swarm(spark, S.deal(rows, names, 150), sizes, 6, 3, seed=3, shards=4).run()
    got = state_of(swarm)
    assert np.allclose(got["pi"], fit.p.pi) and np.array_equal(got["rows"], fit.p.rows)
    assert np.allclose(got["theta"], np.concatenate([t.reshape(6, -1) for t in fit.p.theta], axis=1))
    assert np.allclose(got["log_w"], fit.p.log_w) and np.allclose(got["gamma"], fit.p.gamma)
    assert [h["ess"] for h in swarm.history] == pytest.approx([h["ess"] for h in fit.p.history])
    assert swarm.resamplings == len(fit.maps) and swarm.resamplings > 0
    mine = sorted(map(tuple, swarm.assigned().collect()))
    theirs = sorted((r.row_id, p, a) for r in fit.assigned().collect() for p, a in enumerate(r.a))
    assert mine == theirs
    ll = {r.particle: r.ll for r in swarm.log_likelihood(S.deal(rows, names, 170)).collect()}
    assert [ll[p] for p in range(6)] == pytest.approx(I.log_likelihood(rows, names, fit.p.pi, fit.p.theta).tolist())


def test_rejuvenation_keeps_counts_and_blocks_together(spark, data):
    rows, names, sizes = data
    swarm = S.Swarm(spark, S.deal(rows, names, 100, seed=2), sizes, 5, 2, seed=8).run(rejuvenation=2)
    assert swarm.step == 18 and swarm.state.count() == 5
    kept = swarm.assigned()
    assert kept.count() == 3000 and kept.groupBy("row_id", "particle").count().where("count > 1").count() == 0
    long = rows.select("row_id", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("category")) for f in names))).alias("x")).select("row_id", "x.*").where("category is not null")
    want = {tuple(r) for r in kept.join(long, "row_id").groupBy("particle", "feature", "cluster", "category").agg(F.count("*").alias("n")).collect()}
    assert {tuple(r) for r in swarm.counts().collect()} == want
    assert {r[0] for r in swarm.state.select(F.aggregate("rows", F.lit(0.0), lambda a, x: a + x)).collect()} == {600.0}
    pi, theta = swarm.weights()
    assert pi.groupBy("particle").agg(F.sum(F.exp("log_p")).alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    assert theta.groupBy("particle", "feature", "cluster").agg(F.sum(F.exp("log_p")).alias("s")).where("abs(s - 1) > 1e-6").count() == 0


def test_batches_in_turns(spark, data, monkeypatch):
    rows, names, sizes = data
    blocks = S.deal(rows, names, 50, seed=2)

    def moved():
        swarm = S.Swarm(spark, blocks, sizes, 4, 2, seed=6)
        swarm.move([3, 0, 7], True)
        swarm.move([0, 1], True)
        swarm.move([7, 2, 3], False)
        return state_of(swarm), sorted(map(tuple, swarm.assigned().collect()))

    whole, a = moved()
    monkeypatch.setattr(S, "SENT", 50 * 24)
    turns, b = moved()
    assert a == b and all(np.allclose(whole[k], turns[k]) for k in whole)
    with pytest.raises(ValueError):
        S.Swarm(spark, S.deal(rows, names, 60), sizes, 4, 2)


def test_many_particles(spark, data):
    rows, names, sizes = data
    swarm = S.Swarm(spark, S.deal(rows, names, 100, seed=2), sizes, 2000, 10, seed=9, grids=([0.5, 1.0], [0.5, 1.0])).run(3, 1)
    out = swarm.particles()
    assert out.count() == 2000 and out.agg(F.sum("w")).first()[0] == pytest.approx(1)
    assert all(1 <= h["ess"] <= 2000 for h in swarm.history) and out.select("alpha_pi").distinct().count() == 2
    if swarm.resamplings:
        assert swarm.state.where(F.size("back") != swarm.resamplings).count() == 0


def test_resampling_follows_the_weights(spark, data):
    rows, names, sizes = data
    swarm = S.Swarm(spark, S.deal(rows, names, 300), sizes, 400, 2, seed=1)
    for log_w, share in ((F.lit(0.0), None), (F.when(F.col("particle") < 4, F.lit(0.0)).otherwise(F.lit(-1e9)), 4)):
        state = swarm.state.withColumn("log_w", log_w)
        up = [r.ancestor for r in swarm.ancestors(state).collect()]
        assert len(up) == 400 and (set(up) == {0, 1, 2, 3} if share else 200 < len(set(up)) < 300)


def test_blocks_of_rows_equal_dealt_particles(spark, data):
    rows, names, sizes = data
    blocks, grids = S.deal(rows, names, 130, seed=4), ([0.5, 1.0, 2.0], [0.5, 1.0])
    swarm = S.Swarm(spark, blocks, sizes, 5, 3, seed=11, grids=grids).run(6, 1)
    fit = S.BlockFit(spark, blocks, sizes, 5, 3, seed=11, grids=grids).run(6, 1)
    got = state_of(swarm)
    assert np.allclose(got["pi"], fit.p.pi) and np.array_equal(got["rows"], fit.p.rows) and np.allclose(got["log_w"], fit.p.log_w)
    assert np.allclose(got["theta"], np.concatenate([t.reshape(5, -1) for t in fit.p.theta], axis=1))
    assert swarm.resamplings == len(fit.maps) and [h["resampled"] for h in swarm.history] == [h["resampled"] for h in fit.history]
    assert sorted(map(tuple, swarm.assigned().collect())) == sorted(map(tuple, fit.assigned().collect()))
    # a move reads its own block's folder only
    b = blocks.some(1, 11, fit.step)
    read = fit._rows(b)
    assert len(read.collect()) == blocks.size(b[0])
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numOutputRows").value() == blocks.size(b[0])


def test_saved_states_go_on_as_if_there_had_been_no_stop(spark, data, tmp_path):
    rows, names, sizes = data
    blocks = S.deal(rows, names, 150, seed=3)
    whole = S.Swarm(spark, blocks, sizes, 6, 3, seed=3).run(4, 1)
    first = S.Swarm(spark, blocks, sizes, 6, 3, seed=3).run(2, 1)
    assert S.Swarm.resume(spark, f"file://{tmp_path}/none") is None
    first.save(f"file://{tmp_path}/saved")
    first.move([2], True)
    first.save(f"file://{tmp_path}/saved")
    for step in (4, None):
        again = S.Swarm.resume(spark, f"file://{tmp_path}/saved", step)
        if step is None:
            again.move(again.random_blocks(1), False)
        else:
            again.move([2], True)
            again.move(again.random_blocks(1), False)
        again.move([3], True)
        again.move(again.random_blocks(1), False)
        a, b = state_of(whole), state_of(again)
        assert all(np.allclose(a[k], b[k]) for k in a) and again.step == whole.step
        assert sorted(map(tuple, again.assigned().collect())) == sorted(map(tuple, whole.assigned().collect()))


def test_few_particles_with_blocks_of_any_size(spark, data, monkeypatch):
    """What a step gives is the same with rows in tasks, where a block needn't be sent whole."""
    rows, names, sizes = data
    blocks = S.deal(rows, names, 200)
    sent, fit = S.Swarm(spark, blocks, sizes, 4, 3, seed=9), S.BlockFit(spark, blocks, sizes, 4, 3, seed=9)
    sent.move([0], True)
    monkeypatch.setattr(S, "SENT", 1000)
    fit.move([0], True)
    assert sent.history[-1]["resampled"] == fit.history[-1]["resampled"]
    weighted, sent.state = sent.state, sent.weighted
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(sent.assigned(), fit.assigned(weighted=True))
    assert np.allclose([tuple(r) for r in sent.particles().orderBy("particle").collect()], [tuple(r) for r in fit.particles(fit.weighted).orderBy("particle").collect()])
    order = ["particle", "feature", "cluster", "category"]
    assert np.allclose([r.log_p for r in sent.weights()[1].orderBy(*order).collect()], [r.log_p for r in fit.cells(fit.weighted.theta, "log_p", "double").orderBy(*order).collect()])
    sent.state = weighted
    assert same(sent.counts(), fit.cells([x.astype(int) for x in fit.p.phi], "n", "long").where("n > 0")) and same(sent.counts(), fit.assigned_cells())


def test_many_blocks_share_folders(spark, data, monkeypatch):
    monkeypatch.setattr(S, "FOLDERS", 4)
    rows, names, _ = data
    one = S.deal(rows, names, 20, seed=5)  # 30 blocks
    assert one.shared == 8 and one.n == 30
    folders = {f.split("shelf=")[1].split("/")[0] for f in spark.read.parquet(one.path).inputFiles()}
    assert len(folders) <= 4
    monkeypatch.setattr(S, "FOLDERS", 256)
    other = S.deal(rows, names, 20, seed=5)
    for some in ([0], [7, 8, 29], list(range(30))):
        assert sorted(map(tuple, one.read(spark, some).collect())) == sorted(map(tuple, other.read(spark, some).collect()))
