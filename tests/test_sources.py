from pyspark.sql import functions as F

from mixlake.operators.inference import Fit
from mixlake.operators.model import Model
from mixlake.sources import tables as T
from mixlake.streaming.online import follow, score_stream


def test_round_trips_and_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    for kind in ("parquet", "csv", "json"):
        T.sink(df, f"{tmp_path}/{kind}", kind, single=True)
        assert sorted(map(str, T.scan(spark, f"{tmp_path}/{kind}", kind, "i int, s string").collect())) == sorted(map(str, df.collect()))
    got = T.with_path(T.scan(spark, f"{tmp_path}/parquet"), "/(parquet)/", ["kind"]).first()
    assert got.kind == "parquet"
    name = spark.createDataFrame([("runs/P20_C100_T30_B1000.x",), ("other",)], "n string").select(*(c.alias(k) for k, c in T.run_settings(F.col("n")).items())).collect()
    assert tuple(name[0]) == (20, 100, 30, None) or tuple(name[0]) == (20, 100, 30, 1000)
    assert tuple(name[1]) == (None,) * 4
    old = T.backfilled(df, "dataset", "x")
    assert {r.dataset for r in old.collect()} == {"x"}


def test_dense_arrays(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(2, 3))
    assert [tuple(r) for r in T.dense_to_table(spark, f"{tmp_path}/a.npy").orderBy("row_id").collect()] == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]


def test_models_and_streams(spark, tmp_path):
    pi = spark.createDataFrame([(0, -0.5)], "cluster int, log_p double")
    theta = spark.createDataFrame([(0, "f", 0, -0.1), (0, "f", 1, -2.0)], "cluster int, feature string, category int, log_p double")
    Model(pi, theta, 1, ("f",)).save(f"{tmp_path}/m")
    model = Model.load(spark, f"{tmp_path}/m", ["f"])
    spark.createDataFrame([(0,), (1,), (None,)], "f int").write.parquet(f"{tmp_path}/in")
    q = score_stream(spark.readStream.schema("f int").parquet(f"{tmp_path}/in"), model).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(round(r.log_p, 6) for r in spark.table("scored").collect()) == [-2.5, -0.6, -0.5]


def test_a_followed_stream_starts_again_where_it_was(spark, tmp_path):
    rows = spark.range(90).selectExpr("id AS row_id", "CAST(id % 3 AS INT) AS f", "CAST(id % 2 AS INT) AS g")
    for k in range(3):
        rows.where(f"row_id % 3 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    new = lambda: Fit(rows, ["f", "g"], [3, 2], f"file://{tmp_path}/fit", 2, 2, seed=1)

    def run(fit, parts):
        spark.read.parquet(*(f"{tmp_path}/in{k}" for k in parts)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("row_id long, f int, g int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        follow(stream, fit, f"file://{tmp_path}/saved").awaitTermination(120)
        return fit

    first = run(new(), [0])
    assert first.p.rows.sum(1).tolist() == [30, 30]
    again = run(new(), [1, 2])  # as after a restart of the driver: nothing is kept in memory
    assert again.p.rows.sum(1).tolist() == [90, 90] and again.taken == 2 and again.assigned().count() == 90
