"""Evaluation and reporting: accuracy with intervals, autocorrelation, interpolation, thresholds, summaries, AUC."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mixlake.operators.ordering import running_sums

Z95 = 1.959963984540054


def imputation_accuracy(imputed: DataFrame, masked: DataFrame, truth: DataFrame, row_id: str, features: list[str]) -> DataFrame:
    """(feature, n_imputed, n_evaluated, n_correct, accuracy) over cells missing in `masked`; evaluated where the truth is known."""
    a = masked.select(F.col(row_id).alias("_i"), *(F.col(f).isNull().alias(f"_m_{f}") for f in features))
    b = truth.select(F.col(row_id).alias("_j"), *(F.col(f).alias(f"_t_{f}") for f in features))
    rows = imputed.join(a, F.col(row_id) == F.col("_i")).join(b, F.col(row_id) == F.col("_j"))
    x = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"_m_{f}").alias("missing"), F.col(f"_t_{f}").alias("truth"), F.col(f).alias("value")) for f in features))).alias("x")
    cells = rows.select(x).select("x.*").where("missing")
    known = F.col("truth").isNotNull()
    out = cells.groupBy("feature").agg(F.count("*").alias("n_imputed"), F.count_if(known).alias("n_evaluated"), F.count_if(known & F.col("value").eqNullSafe(F.col("truth"))).alias("n_correct"))
    return out.withColumn("accuracy", F.coalesce(F.try_divide(F.col("n_correct").cast("double"), F.col("n_evaluated")), F.lit(0.0)))


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Centre and bounds of Wilson's interval, clipped to [0, 1]; zeros without trials."""
    n = F.when(trials > 0, trials.cast("double"))
    p, z2 = successes / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    margin = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    zero = F.lit(0.0)
    return F.coalesce(centre, zero), F.coalesce(F.greatest(centre - margin, zero), zero), F.coalesce(F.least(centre + margin, F.lit(1.0)), zero)


def t_quantile(p: float, df: int) -> float:
    """Student's quantile, by bisection on the regularised incomplete beta function."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def _t_cdf(t: float, df: int) -> float:
    return 1 - 0.5 * _beta(df / (df + t * t), df / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0  # a continued fraction, term by term
    for k in range(400):
        m = k // 2
        term = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + term * d) or 1e-300)
        c = (1 + term / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def mean_interval(df: DataFrame, column: str, confidence: float = 0.95) -> tuple[float, float, float]:
    """Mean and t interval; a single value has no width, none gives zeros."""
    n, mean, s = df.agg(F.count(column), F.avg(column), F.stddev_samp(column)).first()
    if not n:
        return 0.0, 0.0, 0.0
    half = t_quantile(0.5 + confidence / 2, n - 1) * s / math.sqrt(n) if n > 1 else 0.0
    return mean, mean - half, mean + half


def autocorrelation(df: DataFrame, order: str, value: str, most: int = 30) -> DataFrame:
    """(lag, rho): the biased autocorrelation of values at consecutive integers of `order`, for lags 0 to `most`.

    The series is cut into blocks of BLOCK places; a block also has the `most` places after it, so it is shuffled once, and
    tasks add up all lags of a block in numpy. Places without a value, and null values, add nothing.
    """
    n, mean, square = df.agg(F.count(value), F.avg(value), F.sum(F.col(value) * F.col(value))).first()
    if not n:
        return df.sparkSession.createDataFrame([], "lag int, rho double")
    total, size = square - n * mean * mean, max(BLOCK, most + 1)
    block, place = F.floor(F.col("t") / size), F.pmod("t", F.lit(size))
    own = df.where(F.col(value).isNotNull()).select(F.col(order).cast("long").alias("t"), (F.col(value).cast("double") - F.lit(mean)).alias("x"))
    own = own.withColumn("block", F.explode(F.when(place < most, F.array(block - 1, block)).otherwise(F.array(block))))

    def run(table: pa.Table) -> pa.Table:
        first = table.column("block")[0].as_py() * size
        x = np.zeros(size + most)
        x[np.asarray(table.column("t")) - first] = np.asarray(table.column("x"))
        return pa.table({"lag": pa.array(range(most + 1), pa.int32()), "s": pa.array([float(x[:size] @ x[lag : lag + size]) for lag in range(most + 1)])})

    sums = own.groupBy("block").applyInArrow(run, "lag int, s double")
    return sums.groupBy("lag").agg((F.sum("s") / F.lit(total)).alias("rho"))


def chain_effective_size(rho: DataFrame, n: int) -> DataFrame:
    return rho.where("lag > 0").agg((F.lit(float(n)) / (1 + 2 * F.sum("rho"))).alias("ess"))


def interpolated(runs: DataFrame, points: int, key: str = "run", time: str = "time", value: str = "value") -> DataFrame:
    """(key, i, t, value): linear interpolation at `points` times from 0 to the overall last, flat beyond a run's ends.

    Each segment lists the grid points inside it, so work follows segments and points, not their product.
    """
    last = runs.agg(F.max(time)).first()[0]
    step = last / (points - 1)
    w = W.partitionBy(key).orderBy(time)
    seg = runs.select(key, F.col(time).alias("t0"), F.col(value).alias("v0"), F.lead(time).over(w).alias("t1"), F.lead(value).over(w).alias("v1"), F.row_number().over(w).alias("_n"))
    first = F.when(F.col("_n") == 1, F.lit(0)).otherwise(F.ceil(F.col("t0") / step))
    after = F.when(F.col("t1").isNull(), F.lit(points)).otherwise(F.ceil(F.col("t1") / step))
    grid = seg.withColumn("_a", first.cast("int")).withColumn("_b", F.least(after, F.lit(points)).cast("int")).where("_b > _a")
    grid = grid.withColumn("i", F.explode(F.sequence("_a", F.col("_b") - 1))).withColumn("t", F.col("i") * F.lit(step))
    inside = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    value_at = F.when((F.col("t") <= F.col("t0")) | F.col("t1").isNull(), F.col("v0")).otherwise(inside)
    return grid.select(key, "i", "t", value_at.alias("value"))


def time_to_threshold(df: DataFrame, time: str, value: str, optimal: float, gaps: list[float]) -> DataFrame:
    """(gap, time): the first time at which the value is within gap of the optimum, null if never."""
    one = df.agg(*(F.min(F.when(F.col(value) >= optimal - g, F.col(time))).alias(f"g{i}") for i, g in enumerate(gaps)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(float(g)).alias("gap"), F.col(f"g{i}").alias("time")) for i, g in enumerate(gaps)))).alias("x")).select("x.*")


def nearest_key(df: DataFrame, key: str, targets: list[int]) -> DataFrame:
    """(target, key): the closest key of each target, the smaller of two; one aggregation."""
    one = df.agg(*(F.min_by(key, F.struct(F.abs(F.col(key) - t), F.col(key))).alias(f"t{i}") for i, t in enumerate(targets)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("target"), F.col(f"t{i}").cast("long").alias(key)) for i, t in enumerate(targets)))).alias("x")).select("x.*")


def auc(scored: DataFrame, score: str, label: str, n: str | None = None) -> DataFrame:
    """One row: ROC-AUC from counts of each distinct score, summed range by range; ties count half. Null if a class has no rows. n: the column of how many rows one stands for."""
    each = F.lit(1) if n is None else F.col(n)
    by = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label) * each).alias("pos"), F.sum((1 - F.col(label)) * each).alias("neg"))
    rows = running_sums(by, ["s"], {"upto": "neg"})
    return rows.agg(F.try_divide(F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def label_codes(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(label, code): the sorted union of both tables' labels."""
    both = a.select(F.col(column).alias("label")).unionByName(b.select(F.col(column).alias("label"))).where("label is not null").distinct()
    return running_sums(both, ["label"], {"code": F.lit(1)}).withColumn("code", (F.col("code") - 1).cast("int"))


def accuracy(predicted: DataFrame, prediction: str, label: str, n: str | None = None) -> DataFrame:
    """One row: n, accuracy and the macro mean of recalls over the labels that occur. n: the column of how many rows one stands for."""
    each = F.lit(1) if n is None else F.col(n)
    by = predicted.groupBy(F.col(label).alias("l")).agg(F.sum(each).alias("n"), F.sum(F.when(F.col(prediction) == F.col(label), each).otherwise(0)).alias("hit"))
    return by.agg(F.sum("n").alias("n"), F.try_divide(F.sum("hit").cast("double"), F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("macro_recall"))


def auc_one_vs_rest(scored: DataFrame, row_id: str, label: str, classes: list[str], scores: list[str], n: str | None = None) -> DataFrame:
    """(class, auc) of each class against the rest, all in one pass: `scores` holds the column with each class's score. n: the column of how many rows one stands for."""
    each = (F.lit(1) if n is None else F.col(n)).alias("each")
    x = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(s).cast("double").alias("s"), (F.col(label) == c).cast("int").alias("y")) for c, s in zip(classes, scores, strict=True)))).alias("x")
    by = scored.select(x, each).select("x.*", "each").groupBy("class", "s").agg(F.sum(F.col("y") * F.col("each")).alias("pos"), F.sum((1 - F.col("y")) * F.col("each")).alias("neg"))
    rows = running_sums(by, ["class", "s"], {"upto": "neg"})
    # ranks within a class: what lies before it is the least of its own sums
    own = rows.groupBy("class").agg(F.min(F.col("upto") - F.col("neg")).alias("b"), F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("t"))
    return own.select("class", F.try_divide(F.col("t") - F.col("p") * F.col("b"), F.col("p") * F.col("n")).alias("auc"))


def timing(batches: DataFrame, seconds: str, rows: str) -> DataFrame:
    """One row: batches, rows, mean and population deviation of milliseconds a row by batch, and rows a second over all; the true row counts are used."""
    per = F.try_divide(F.lit(1000.0) * F.col(seconds), F.col(rows))
    return batches.agg(F.count("*").alias("n_batches"), F.sum(rows).alias("n_rows"), F.avg(per).alias("ms_per_row"), F.stddev_pop(per).alias("ms_deviation"), F.try_divide(F.sum(rows).cast("double"), F.sum(seconds)).alias("rows_per_s"))


def throughput(runs: DataFrame, steps: str, batch: str, rejuvenations: str, seconds: str, by: str) -> DataFrame:
    """(by, rate, mean, sd, least, most): row visits a second of each group's runs, steps x batch x (1 + rejuvenations) in all, and statistics of the runs' seconds."""
    visits = F.col(steps) * F.col(batch) * (1 + F.col(rejuvenations))
    return runs.groupBy(by).agg(F.try_divide(F.sum(visits).cast("double"), F.sum(seconds)).alias("rate"), F.avg(seconds).alias("mean"), F.stddev_pop(seconds).alias("sd"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))


def checkpoint_of(steps: DataFrame, targets: list[int], save_every: int = 1, step: str = "step") -> DataFrame:
    """(target, step): the saved step of each target's place, target rounded down to a multiple of save_every, if it is there; else the
    one closest to the target itself, the smaller of two; the last for targets beyond the last."""
    s = F.col(step)
    picks = F.array(*(F.struct(F.lit(t).cast("long").alias("target"), F.min_by(step, F.struct((s != t // save_every * save_every).alias("other"), F.abs(s - t), s)).cast("long").alias("near"), F.max(step).cast("long").alias("last")) for t in targets))
    x = steps.agg(picks.alias("x")).select(F.explode("x").alias("x"))
    return x.select("x.target", F.when(F.col("x.target") > F.col("x.last"), F.col("x.last")).otherwise(F.col("x.near")).alias(step))


def grouped_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., median): exact, the mean of the middle two of an even number of non-null values; groups without values are left out.

    Values are numbered range by range, so a group of any size is in no single task.
    """
    own = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_value"))
    at = running_sums(own, ["_value"], {"_place": F.lit(1)}, by)
    same = [F.col(f"_l{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
    size = at.groupBy(*(F.col(c).alias(f"_l{i}") for i, c in enumerate(by))).agg(F.max("_place").alias("_n"))
    middle = (F.col("_place") >= F.floor((F.col("_n") + 1) / 2)) & (F.col("_place") <= F.floor(F.col("_n") / 2) + 1)
    return at.join(size, same).where(middle).groupBy(*by).agg(F.avg("_value").alias("median"))


def target_choice(df: DataFrame) -> str | None:
    """The string column of middle cardinality among those with 2 to 20 distinct values."""
    names = [c for c, k in df.dtypes if k == "string"]
    if not names:
        return None
    row = df.agg(*(F.count_distinct(c).alias(c) for c in names)).first()
    fit = sorted((row[c], c) for c in names if 2 <= row[c] <= 20)
    return fit[len(fit) // 2][1] if fit else None


def cumulative(df: DataFrame, order: list[str], value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """df with the sum of value up to and with each row of its group; nulls add nothing. Groups of any size are summed range by range."""
    return running_sums(df, order, {name: value}, by)


#: Rows that moving averages are made of at a time, about.
BLOCK = 100_000


def moving_average(df: DataFrame, order: list[str], value: str, width: int, name: str, by: list[str] | None = None) -> DataFrame:
    """Means over `width` consecutive rows; the first width - 1 rows of a group, which have no full window, are left out.

    Rows are counted range by range and cut into blocks; each block also holds the width - 1 rows before it, so none has to hold a group.
    """
    by, size = by or [], max(width, BLOCK)
    at = running_sums(df, order, {"_n": F.lit(1)}, by).withColumn("_n", F.col("_n") - 1)
    own = F.floor(F.col("_n") / size)
    blocks = F.when(F.col("_n") % size > size - width, F.array(own, own + 1)).otherwise(F.array(own))
    w = W.partitionBy(*by, "_block").orderBy("_n")
    out = at.withColumn("_block", F.explode(blocks)).withColumn(name, F.avg(value).over(w.rowsBetween(1 - width, 0)))
    return out.where((F.col("_n") >= width - 1) & (F.floor(F.col("_n") / size) == F.col("_block"))).drop("_n", "_block")


def direction(corr: Column, margin: float = 0.1) -> Column:
    return F.when(corr > margin, "increasing").when(corr < -margin, "decreasing").otherwise("flat")


def best_final(df: DataFrame, dataset: str, config: str, time: str, value: str) -> DataFrame:
    """(dataset, config, final, n): of each dataset the configuration whose value at its last time is least, ties by name."""
    final = df.groupBy(dataset, config).agg(F.max_by(value, F.struct(time, value)).alias("final"))
    return final.groupBy(dataset).agg(F.min(F.struct("final", config)).alias("x")).select(dataset, f"x.{config}", "x.final")
