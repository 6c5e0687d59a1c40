"""Scans and sinks: Parquet, CSV, JSON, dense arrays, models, and what file names tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, recursive: bool = False) -> DataFrame:
    """Reads Parquet, CSV (with a header) or JSON lines from any path that Spark reaches. A given schema saves a pass over CSV and JSON."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.option("header", "true").option("inferSchema", str(schema is None).lower()).csv(path)
    return reader.json(path) if kind == "json" else reader.parquet(path)


def sink(df: DataFrame, path: str, kind: str = "parquet", single: bool = False) -> None:
    """Overwrites path. single: one file, for small reports."""
    out = (df.coalesce(1) if single else df).write.mode("overwrite")
    if kind == "csv":
        out.option("header", "true").csv(path)
    elif kind == "json":
        out.json(path)
    else:
        out.parquet(path)


def with_path(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Adds the groups of `pattern` in each row's file path as columns."""
    at = F.col("_metadata.file_path")
    return df.select("*", *(F.regexp_extract(at, pattern, i).alias(n) for i, n in enumerate(names, 1)))


def run_settings(name: F.Column) -> dict[str, F.Column]:
    """Particles, clusters, steps and batch of names like P20_C100_T30_B1000; null where one is absent."""
    return {word: F.try_to_number(F.nullif(F.regexp_extract(name, rf"(?:^|[_/.-]){letter}(\d+)(?=[_/.-]|$)", 1), F.lit("")), F.lit("999999999")).cast("int") for letter, word in zip("PCTB", ("particles", "clusters", "steps", "batch"), strict=True)}


def first_model(df: DataFrame, dataset: str = "dataset", path: str = "path") -> DataFrame:
    """(dataset, path): each dataset's model whose path sorts first."""
    return df.groupBy(dataset).agg(F.min(path).alias(path))


def dense_to_table(spark: SparkSession, file: str, name: str | None = None) -> DataFrame:
    """A .npy array, or one array of an .npz, of two dimensions as rows (row_id, values). For small arrays at the edge of a run: the file is read on the driver."""
    import numpy as np

    data = np.load(file, allow_pickle=False)
    array = data[name or data.files[0]] if hasattr(data, "files") else data
    kind = "double" if array.dtype.kind == "f" else "long"
    rows = [(i, row) for i, row in enumerate(array.reshape(len(array), -1).tolist())]
    return spark.createDataFrame(rows, f"row_id long, values array<{kind}>")


def backfilled(df: DataFrame, column: str, value: str) -> DataFrame:
    """Old records without the column, or with a null, get the value."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in df.columns else F.lit(value))


def load_pair(spark: SparkSession, folder: str, train: str = "data-train-num.parquet", test: str = "data-test-full-num.parquet") -> tuple[DataFrame, DataFrame]:
    """A dataset's training and test tables, from any file system that Spark reaches; credentials are Spark's settings."""
    return spark.read.parquet(f"{folder}/{train}"), spark.read.parquet(f"{folder}/{test}")


def table_to_dense(df: DataFrame, file: str, columns: list[str], order: list[str], most: int = 1_000_000) -> None:
    """The columns as a .npy array of two dimensions, rows in `order`, missing cells -1. For small arrays at the edge of a run: they pass the driver, so more than `most` rows are refused."""
    import numpy as np

    rows = df.orderBy(*order).select(*(F.coalesce(F.col(c), F.lit(-1)) for c in columns)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    np.save(file, np.array([tuple(r) for r in rows]).reshape(len(rows), len(columns)))


#: Columns of a table that make a dataset, by name.
DATASETS = {
    "orders": ("orders", ["o_orderstatus", "o_orderpriority", "o_totalprice"]),
    "customers": ("customer", ["c_mktsegment", "c_acctbal"]),
    "parts": ("part", ["p_brand", "p_type", "p_retailprice"]),
}


def dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A registered dataset's columns."""
    source, columns = DATASETS[name]
    return spark.read.parquet(f"{folder}/{source}.parquet").select(*columns)


def run_all(spark: SparkSession, folder: str, names: list[str], job) -> list[tuple[str, bool, float, object]]:
    """(name, whether it ended well, seconds, result or error) of job(dataset) for each dataset; one that fails doesn't stop the others."""
    import time

    out = []
    for name in names:
        begin = time.perf_counter()
        try:
            ok, result = True, job(dataset(spark, folder, name))
        except Exception as e:  # noqa: BLE001  reported with the dataset's name
            ok, result = False, str(e)
        out.append((name, ok, time.perf_counter() - begin, result))
    return out
