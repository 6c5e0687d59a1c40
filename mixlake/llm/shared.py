"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlake.sources.scratch import discard, drop_shared, materialize, shared_dir

__all__ = ["LOWER", "UPPER", "WORD", "aligned", "discard", "drop_shared", "lower_ascii", "materialize", "shared_dir", "table", "unused", "without"]

#: The words of most contracts.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def unused(df: DataFrame, stem: str) -> str:
    """A column name starting with stem that df doesn't have, in any case."""
    taken, name, k = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in taken:
        k, name = k + 1, f"{stem}_{k + 1}"
    return name


def without(df: DataFrame, names: list[str], keep: str) -> DataFrame:
    """df without the columns that a new column replaces: those of these names, in any case, but for `keep`."""
    gone = {n.lower() for n in names}
    return df.drop(*(c for c in df.columns if c.lower() in gone and c != keep))


def aligned(batches):
    """Arrow batches sorted by their first column, cut so that all rows of a key are in one; only the last key's rows are held."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = pc.equal(batch.column(0), batch.column(0)[-1])
        cut = pc.index(pc.fill_null(same, False), True).as_py()  # sorted, so the last key's rows come last
        cut = batch.num_rows if cut < 0 else cut
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
