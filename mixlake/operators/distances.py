"""Distances between two tables: Jensen-Shannon in its marginal, pairwise, dense and Boolean forms, total variation, marginals.

Every measure is one grouped job over (feature, category) counts of both sides; no loop over columns. A side without
rows has no distribution: distances to it are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-10


def _text(column: str) -> Column:
    """A cell as text that no other cell has; a missing one is a category of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def _js(part: Column, size_1: Column, size_2: Column) -> Column:
    """The root of half the summed parts; null if a side has no rows."""
    return F.when((F.max(size_1) > 0) & (F.max(size_2) > 0), F.sqrt(F.greatest(F.sum(part) / 2, F.lit(0.0))))


def cells(df: DataFrame, columns: list[str], side: int, keep: list[str] | None = None) -> DataFrame:
    """(keep..., side, feature, category): every cell as text; a missing one is a category of its own."""
    x = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), _text(c).alias("category")) for c in columns))).alias("x")
    return df.select(*(keep or []), F.lit(side).alias("side"), x).select(*(keep or []), "side", "x.*")


def counts(both: DataFrame, keys: list[str]) -> DataFrame:
    """n1 and n2 by key over both sides' rows."""
    return both.groupBy(*keys).agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2"))


def js_of_counts(counted: DataFrame, over: list[str], eps: float = EPS, support: Column | None = None) -> DataFrame:
    """(over..., js): the root of the divergence in nats; null where a side has no rows.

    `support`, if given, is the number of all categories, seen or not, by which probabilities are normalised.
    """
    w = W.partitionBy(*over)
    size = F.count("*").over(w) if support is None else support
    t1, t2 = (F.sum(n).over(w) for n in ("n1", "n2"))
    p, q = ((F.try_divide(F.col(n), t) + eps) / (1 + eps * size) for n, t in (("n1", t1), ("n2", t2)))
    rows = counted.select(*over, p.alias("p"), q.alias("q"), t1.alias("t1"), t2.alias("t2"))
    m = (F.col("p") + F.col("q")) / 2
    part = F.col("p") * F.ln(F.col("p") / m) + F.col("q") * F.ln(F.col("q") / m)
    return rows.groupBy(*over).agg(_js(part, F.col("t1"), F.col("t2")).alias("js"))


def js_features(a: DataFrame, b: DataFrame, columns: list[str], eps: float = EPS) -> DataFrame:
    """(feature, js) of each column."""
    both = cells(a, columns, 1).unionByName(cells(b, columns, 2))
    return js_of_counts(counts(both, ["feature", "category"]), ["feature"], eps)


def js_distance(a: DataFrame, b: DataFrame, columns: list[str], eps: float = EPS) -> DataFrame:
    """One row: the mean over columns."""
    return js_features(a, b, columns, eps).agg(F.avg("js").alias("js"))


def js_grouped(a: DataFrame, b: DataFrame, columns: list[str], keys: list[str], eps: float = EPS) -> DataFrame:
    """(keys, js): each group of a against all of b, in one job: b's counts are summed once and joined to every group."""
    left = cells(a, columns, 1, keys).groupBy(*keys, "feature", "category").agg(F.count("*").alias("n1"))
    right = cells(b, columns, 2).groupBy("feature", "category").agg(F.count("*").alias("n2"))
    groups = left.select(*keys).distinct()
    support = groups.crossJoin(right.select("feature", "category")).unionByName(left.select(*keys, "feature", "category")).distinct()  # groups times categories
    counted = support.join(left, [*keys, "feature", "category"], "left").join(right, ["feature", "category"], "left").na.fill(0, ["n1", "n2"])
    return js_of_counts(counted, [*keys, "feature"], eps).groupBy(*keys).agg(F.avg("js").alias("js"))


#: Categories of all columns together whose pairs tasks count as one matrix, at most.
COUNTED = 4096
#: Rows that are multiplied at a time; their counts are exact in single precision.
GRAM_ROWS = 8192


def pair_counts(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_i, feature_j, category, n1, n2) for i <= j in the columns' order: how often both sides have each pair of cells that occurs.

    One scan lists the columns' cells. In a second one tasks turn their rows into one-hot codes and add up the products of
    blocks of columns, so that a row gives no rows of its own; one number for each pair of cells is shuffled. Columns with
    more than COUNTED cells in all are counted pair by pair instead, with the same result.
    """
    both = a.select(F.lit(1).alias("side"), *(_text(c).alias(f"x{i}") for i, c in enumerate(columns))).unionByName(b.select(F.lit(2).alias("side"), *(_text(c).alias(f"x{i}") for i, c in enumerate(columns))))
    names = [f"x{i}" for i in range(len(columns))]
    long = both.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(x).alias("v")) for i, x in enumerate(names)))).alias("x")).select("x.*").distinct()
    listed = long.limit(COUNTED + 1).collect()
    if len(listed) > COUNTED:
        return _counted_by_pair(a, b, columns)
    own = [pa.array(sorted(r.v for r in listed if r.i == i), pa.string()) for i in range(len(columns))]
    ends = np.cumsum([0, *map(len, own)])
    size, block = int(ends[-1]), 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for whole in batches:
            for k in range(0, whole.num_rows, GRAM_ROWS):
                part = whole.slice(k, GRAM_ROWS)
                sides = np.asarray(part.column(0))
                at = np.stack([np.asarray(pc.index_in(part.column(i + 1).cast(pa.string()), value_set=v)).astype(np.int64) + ends[i] for i, v in enumerate(own)], axis=1)
                for side in (1, 2):
                    some = at[sides == side]
                    if len(some):
                        hot = np.zeros((len(some), size), np.float32)
                        hot[np.arange(len(some))[:, None], some] = 1
                        sums = total.setdefault(side, np.zeros((size, size), np.int64))
                        for i in range(0, size, block):
                            sums[i : i + block, i:] += np.rint(hot[:, i : i + block].T @ hot[:, i:]).astype(np.int64)
        for side, sums in total.items():
            x, y = np.nonzero(np.triu(sums))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), side)), pa.array(x * size + y), pa.array(sums[x, y])], names=["side", "cell", "n"])

    n = [F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (1, 2)]
    cells = both.select("side", *names).mapInArrow(run, "side long, cell long, n long").groupBy("cell").agg(*n)
    x, y = F.floor(F.col("cell") / size).cast("int"), (F.col("cell") % size).cast("int")
    # cells are numbered column by column: a label for each, of COUNTED at most
    feature, label = (F.lit(list(v)) for v in ([columns[i] for i, v in enumerate(own) for _ in v], [t for v in own for t in v.to_pylist()]))
    i, j = F.get(feature, x), F.get(feature, y)
    pair = F.struct(F.get(label, x).alias("i"), F.get(label, y).alias("j")).alias("category")
    return cells.select(i.alias("feature_i"), j.alias("feature_j"), pair, "n1", "n2").where((F.col("feature_i") != F.col("feature_j")) | (F.col("category.i") == F.col("category.j")))


def _counted_by_pair(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """pair_counts() from a row for each pair of columns of a row."""
    pairs = [(i, j) for x, i in enumerate(columns) for j in columns[x:]]

    def long(df: DataFrame, side: int) -> DataFrame:
        x = F.explode(F.array(*(F.struct(F.lit(i).alias("feature_i"), F.lit(j).alias("feature_j"), F.struct(_text(i).alias("i"), _text(j).alias("j")).alias("category")) for i, j in pairs))).alias("x")
        return df.select(F.lit(side).alias("side"), x).select("side", "x.*")

    return counts(long(a, 1).unionByName(long(b, 2)), ["feature_i", "feature_j", "category"])


def js_pairs(a: DataFrame, b: DataFrame, columns: list[str], eps: float = EPS, dense: dict[str, int] | None = None) -> DataFrame:
    """(feature_i, feature_j, js) for i <= j: marginals on the diagonal, observed pairs of values off it. dense: number of codes of each column."""
    counted = pair_counts(a, b, columns)
    if not dense:
        return js_of_counts(counted, ["feature_i", "feature_j"], eps)
    sizes = F.create_map(*(F.lit(x) for c, k in dense.items() for x in (c, k)))
    k_i, k_j = (F.element_at(sizes, F.col(c)) for c in ("feature_i", "feature_j"))
    return js_of_counts(counted, ["feature_i", "feature_j"], eps, F.when(F.col("feature_i") == F.col("feature_j"), k_i).otherwise(k_i * k_j))


def js_boolean_pairs(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_i, feature_j, jsd) for i < j of Boolean columns, over their four joint cells; no root and no eps, empty cells count 0."""
    return _jsd(pair_counts(a, b, columns).where("feature_i <> feature_j"), ["feature_i", "feature_j"])


def js_one_hot_mean(a: DataFrame, b: DataFrame, columns: list[str], bivariate: bool = True) -> DataFrame:
    """One row: the mean divergence of Boolean columns, over their pairs or over the columns. Null for a single column's pairs."""
    return (js_boolean_pairs if bivariate else js_one_hot)(a, b, columns).agg(F.avg("jsd").alias("jsd"))


def js_one_hot(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, jsd): each Boolean column's two-valued divergence, without a root."""
    return _jsd(counts(cells(a, columns, 1).unionByName(cells(b, columns, 2)), ["feature", "category"]), ["feature"])


def _jsd(counted: DataFrame, over: list[str]) -> DataFrame:
    w = W.partitionBy(*over)
    t1, t2 = (F.sum(n).over(w) for n in ("n1", "n2"))
    rows = counted.select(*over, F.try_divide(F.col("n1"), t1).alias("p"), F.try_divide(F.col("n2"), t2).alias("q"), t1.alias("t1"), t2.alias("t2"))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / m)).otherwise(0.0)
    both = (F.max("t1") > 0) & (F.max("t2") > 0)
    return rows.groupBy(*over).agg(F.when(both, F.sum(term("p") + term("q")) / 2).alias("jsd"))


def marginals(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., feature, category, p) over non-missing cells."""
    by = by or []
    x = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in columns))).alias("x")
    n = df.select(*by, x).select(*by, "x.*").where("category is not null").groupBy(*by, "feature", "category").agg(F.count("*").alias("n"))
    return n.select(*by, "feature", "category", (F.col("n") / F.sum("n").over(W.partitionBy(*by, "feature"))).alias("p"))


def differences(p: DataFrame, q: DataFrame) -> DataFrame:
    """(feature, tv, mad, n): total variation and mean absolute difference of two marginals over the union of their categories."""
    both = p.withColumnRenamed("p", "a").join(q.withColumnRenamed("p", "b"), ["feature", "category"], "full").na.fill(0.0, ["a", "b"])
    gap = F.abs(F.col("a") - F.col("b"))
    return both.groupBy("feature").agg((F.sum(gap) / 2).alias("tv"), F.avg(gap).alias("mad"), F.count("*").alias("n"))


def averaged_marginals(stepped: DataFrame) -> DataFrame:
    """(feature, category, p): the mean over steps of (step, feature, category, p)."""
    return stepped.groupBy("feature", "category").agg(F.avg("p").alias("p"))
