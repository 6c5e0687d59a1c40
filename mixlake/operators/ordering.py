"""Sums along a global order, without a window that holds a whole table or group.

Rows are dealt by ranges of the order and sorted within them; every task adds up its own range, and the
ranges' totals, one row for each task, give what lies before each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlake.sources.scratch import materialize


def _names(df: DataFrame, stem: str, n: int) -> list[str]:
    taken = {c.lower() for c in df.columns}
    k = 0
    while any(f"{stem}{k}_{i}".lower() in taken for i in range(n)):
        k += 1
    return [f"{stem}{k}_{i}" for i in range(n)]


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, str | Column], by: list[str] | None = None) -> DataFrame:
    """df with columns that hold the sums, in this order, of all rows up to and with each; null values add nothing.

    by: columns whose groups have sums of their own; a group of any size is dealt over ranges like the rest.
    Sums of integers are longs, others doubles. Rows with equal keys of `by` and `order` share a range and follow one another in
    no fixed order. The result is written to the shared folder; ranges' totals, a row for each task, are broadcast.
    """
    names, by = list(sums), by or []
    keys, own, (part, place, group) = _names(df, "_key", len(by) + len(order)), _names(df, "_own", len(names)), _names(df, "_range", 3)
    rows = df.withColumns({k: F.col(o) if isinstance(o, str) else o for k, o in zip(keys, [*by, *order], strict=True)})
    values = {o: F.col(v) if isinstance(v, str) else v for o, v in zip(own, sums.values(), strict=True)}
    rows = rows.withColumns(values)
    kinds = [T.LongType() if rows.schema[o].dataType.typeName() in ("byte", "short", "integer", "long", "boolean") else T.DoubleType() for o in own]
    rows = rows.withColumns({o: F.coalesce(F.col(o).cast(k), F.lit(0).cast(k)) for o, k in zip(own, kinds, strict=True)})
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    schema = T.StructType([*dealt.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(place, T.LongType()), T.StructField(group, T.LongType())])
    places, groups = [dealt.columns.index(o) for o in own], [dealt.columns.index(b) for b in by]

    def begins_group(batch: pa.RecordBatch, before: list) -> np.ndarray:
        """Whether each row's group isn't that of the row before it."""
        new = np.zeros(batch.num_rows, bool)
        for i, column in enumerate(batch.column(g) for g in groups):
            last = pa.concat_arrays([before[i], column.slice(0, batch.num_rows - 1)]) if before else pa.concat_arrays([column.slice(0, 1), column.slice(0, batch.num_rows - 1)])
            same = pc.or_(pc.fill_null(pc.equal(column, last), False), pc.and_(column.is_null(), last.is_null()))
            new |= ~np.asarray(same, bool)
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, carried, seen, last_group, before = TaskContext.get().partitionId(), [0] * len(places), 0, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, new = list(batch.columns), begins_group(batch, before)
            starts = np.maximum.accumulate(np.where(new, np.arange(batch.num_rows), -1))  # of each row's group in this batch, -1: it began before
            for i, p in enumerate(places):
                x = np.asarray(columns[p])
                total = np.cumsum(x)
                added = np.where(starts < 0, total + carried[i], total - (total - x)[starts])
                carried[i] = added[-1]
                columns[p] = pa.array(added)
            number_of_group = last_group + np.cumsum(new)
            last_group = int(number_of_group[-1])
            before = [batch.column(g).slice(batch.num_rows - 1) for g in groups]
            at = np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(batch.num_rows, number, np.int32)), pa.array(at), pa.array(number_of_group)], names=schema.names)

    rows = materialize(dealt.mapInArrow(run, schema), "ranges")
    key = F.struct(F.lit(0).alias("_"), *by)
    ends = rows.groupBy(part).agg(F.min_by(key, place).alias("first"), F.max_by(key, place).alias("last"), F.max(group).alias("group"), *(F.max_by(o, place).alias(o) for o in own))
    none = [0.0 if isinstance(k, T.DoubleType) else 0 for k in kinds]
    ahead, open_group, begins = none, None, []
    for r in sorted(ends.collect(), key=lambda r: r[0]):
        if r["first"] != open_group:
            ahead = none
        begins.append((r[0], *ahead))
        ahead = [a + r[o] if r["group"] == 0 else r[o] for a, o in zip(ahead, own, strict=True)]
        open_group = r["last"]
    shape = ", ".join([f"{part} int", *(f"_b{i} {k.simpleString()}" for i, k in enumerate(kinds))])
    offsets = df.sparkSession.createDataFrame(begins, shape)
    out = rows.join(F.broadcast(offsets), part)  # a row for each task that had rows
    kept = [F.col(c) for c in df.columns if c not in names]
    sums_of = ((o, n, f"_b{i}") for i, (o, n) in enumerate(zip(own, names, strict=True)))
    return out.select(*kept, *((F.col(o) + F.when(F.col(group) == 0, F.col(b)).otherwise(0)).alias(n) for o, n, b in sums_of))
