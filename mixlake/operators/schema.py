"""Schema inference and encoding of mixed tables: levels, quantile edges, bins, codes, one-hot forms."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlake.functions.exprs import bin_digitize, bin_right_closed
from mixlake.operators.ordering import running_sums
from mixlake.sources.scratch import materialize

#: Sketches know ranks to one in so many; a refining pass has this many parts for all columns together, and at least so many for each rank.
ACCURACY, PARTS, LEAST = 10_000, 1_000_000, 64
#: Levels of a column that are looked up in a constant of the plan, at most.
LITERAL = 64
#: Levels of a table that are sent to all tasks, at most, and their characters.
PACKED_LEVELS, PACKED_TEXT = 100_000, 8_000_000


def _keys(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the doubles' order: -0.0 as 0.0, NaN above all."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))).view(np.uint64)


def _value(key: int) -> float:
    bits = key ^ (1 << 63) if key >= 1 << 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def order_statistics(df: DataFrame, column: str, fractions: list[float]) -> list[float]:
    """The values at the nearest ranks round(q * (n - 1)) of the column's non-null values, exactly. No values give no edges."""
    return order_statistics_of(df, {column: fractions})[column]


def order_statistics_of(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float]]:
    """order_statistics() of many columns by the same scans, two or three whatever their number.

    The first scan makes a mergeable quantile sketch of each column, which brackets every rank. Each further one counts what lies
    below a bracket and in the parts of it, all columns in one pass of numpy, until a bracket holds one value; never a sort of a column.
    """
    names = list(wanted)
    if not names:
        return {}
    x = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)))
    around = lambda q: [min(max(q + d / ACCURACY, 0.0), 1.0) for d in (-2, 2)]
    sketches = (F.percentile_approx(f"x{i}", [v for q in wanted[c] for v in around(q)], ACCURACY).alias(f"s{i}") for i, c in enumerate(names) if wanted[c])
    first = x.agg(*(F.count(f"x{i}").alias(f"n{i}") for i in range(len(names))), *sketches).first()
    whole = (0, (1 << 64) - 1)
    found: dict[tuple[int, int], float] = {}
    goals: dict[tuple[int, int], tuple[int, int, int]] = {}  # rank and bracket, both ends in it
    for i, c in enumerate(names):
        n = first[f"n{i}"]
        for j, q in enumerate(wanted[c] if n else []):
            low, high = (int(k) for k in _keys(np.array(first[f"s{i}"][2 * j : 2 * j + 2], float)))
            goals[i, j] = (math.floor(q * (n - 1) + 0.5), 0 if q <= 2 / ACCURACY else low, whole[1] if q >= 1 - 2 / ACCURACY else high)
    while goals:
        brackets = sorted({(i, low, high) for (i, _), (_, low, high) in goals.items()})
        parts = max(LEAST, PARTS // len(brackets))
        seen = _parts(x, brackets, parts)
        for (i, j), (rank, low, high) in list(goals.items()):
            below, rows = seen[i, low, high]
            for n, least, most in rows:
                if below <= rank < below + n:
                    if least == most:
                        found[i, j] = _value(least)
                        del goals[i, j]
                    else:
                        goals[i, j] = (rank, least, most)
                    break
                below += n
            else:  # the sketch has missed it
                goals[i, j] = (rank, *whole)
    return {c: [found[i, j] for j in range(len(wanted[c]))] if first[f"n{i}"] else [] for i, c in enumerate(names)}


def _parts(x: DataFrame, brackets: list[tuple[int, int, int]], parts: int) -> dict[tuple[int, int, int], tuple[int, list[tuple[int, int, int]]]]:
    """By bracket (column, low, high) how many values lie below, and (n, least, most) of each part of it that has values, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, cells = np.zeros(len(brackets), np.int64), [{} for _ in brackets]
        for b in batches:
            sorted_keys: dict[int, np.ndarray] = {}
            for k, (i, low, high) in enumerate(brackets):
                if i not in sorted_keys:
                    sorted_keys[i] = np.sort(_keys(np.asarray(b.column(i).drop_null(), float)))
                keys = sorted_keys[i]
                begin, end = np.searchsorted(keys, np.uint64(low), "left"), np.searchsorted(keys, np.uint64(high), "right")
                below[k] += begin
                inside = keys[begin:end]
                if len(inside):
                    part = (inside - np.uint64(low)) // np.uint64((high - low) // parts + 1)
                    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                    last = np.append(first[1:], len(part)) - 1
                    for p, n, least, most in zip(part[first].tolist(), (last - first + 1).tolist(), inside[first].tolist(), inside[last].tolist(), strict=True):
                        old = cells[k].get(p)
                        cells[k][p] = (n, least, most) if old is None else (old[0] + n, min(old[1], least), max(old[2], most))
        out = [(k, -1, int(n), 0, 0) for k, n in enumerate(below)] + [(k, p, *v) for k, own in enumerate(cells) for p, v in own.items()]
        signed = lambda v: v - (1 << 63)  # noqa: E731  the keys' order, as longs
        columns = [[r[0] for r in out], [r[1] for r in out], [r[2] for r in out], [signed(r[3]) for r in out], [signed(r[4]) for r in out]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bracket", "part", "n", "least", "most"])

    got = x.mapInArrow(run, "bracket long, part long, n long, least long, most long").groupBy("bracket", "part").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).toArrow()
    out = {b: [0, []] for b in brackets}
    for k, part, n, least, most in sorted(zip(*(got.column(c).to_pylist() for c in ("bracket", "part", "n", "least", "most")), strict=True)):
        if part < 0:
            out[brackets[k]][0] = n
        else:
            out[brackets[k]][1].append((n, least + (1 << 63), most + (1 << 63)))
    return {b: tuple(v) for b, v in out.items()}


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str  # categorical or numerical
    edges: tuple[float, ...] = ()


@dataclass(frozen=True)
class TableSchema:
    """Features in column order; the levels of the categorical ones are rows of `levels` (feature, category, label)."""

    features: tuple[Feature, ...]
    levels: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, n_bins: int = 20, coerce: bool = False) -> TableSchema:
        """Strings are categorical, doubles numerical; other types raise unless `coerce` casts them. Levels are sorted, nulls left out, and written to the shared folder."""
        df = coerced(df) if coerce else df
        for name, kind in df.dtypes:
            if kind not in ("string", "double"):
                raise ValueError(f"{name}: {kind} is neither string nor double")
        kinds = dict(df.dtypes)
        edges = order_statistics_of(df, {c: [i / n_bins for i in range(n_bins + 1)] for c, k in kinds.items() if k == "double"})
        features = tuple(Feature(c, "numerical", tuple(edges[c])) if k == "double" else Feature(c, "categorical") for c, k in kinds.items())
        own = levels(df, [f.name for f in features if f.kind == "categorical"])
        return cls(features, materialize(own, "levels") if any(f.kind == "categorical" for f in features) else own)

    def domain(self) -> DataFrame:
        """(feature, category, label) of every value a code can have; bins have the number as label."""
        out = self.levels
        for f in self.features:
            if f.kind == "numerical":
                bins = df_range(self.levels, max(1, len(f.edges) - 1)).select(F.lit(f.name).alias("feature"), F.col("id").cast("int").alias("category"), F.col("id").cast("string").alias("label"))
                out = out.unionByName(bins)
        return out

    def discretize(self, df: DataFrame, binning: str = "right_closed") -> DataFrame:
        """Numerical columns become bin numbers; the rest stays."""
        cut = bin_right_closed if binning == "right_closed" else bin_digitize
        return df.withColumns({f.name: cut(F.col(f.name), list(f.edges)) for f in self.features if f.kind == "numerical"})

    @cached_property
    def packed(self) -> dict[str, pa.Array]:
        """The levels, by their codes, of the features that together have PACKED_LEVELS and PACKED_TEXT at most, those with fewest first."""
        sizes = self.levels.groupBy("feature").agg(F.count("*").alias("k"), F.sum(F.octet_length("label")).alias("text")).orderBy("k", "feature").collect()  # a row for each feature
        levels_left, text_left, taken = PACKED_LEVELS, PACKED_TEXT, []
        for r in sizes:
            levels_left, text_left = levels_left - r.k, text_left - r.text
            if levels_left < 0 or text_left < 0:
                break
            taken.append(r.feature)
        if not taken:
            return {}
        got = self.levels.where(F.col("feature").isin(taken)).orderBy("feature", "category").toArrow()
        feature = np.asarray(got.column("feature").to_pylist())
        return {f: got.column("label").filter(pa.array(feature == f)).combine_chunks() for f in taken}

    def encode(self, df: DataFrame) -> DataFrame:
        """Every feature becomes an int code; nulls and unseen levels become null. Other columns stay.

        The columns of small dictionaries are looked up together, in one pass without a join; the cells of all
        others are joined with their levels at once.
        """
        out, packed = self.discretize(df), self.packed
        few = {c for c, d in packed.items() if len(d) <= LITERAL}
        # maps of few levels are constants of the plan, so that no Python worker is needed
        out = out.withColumns({f.name: _code_of(F.col(f"`{f.name}`"), packed[f.name].to_pylist()) for f in self.features if f.kind == "categorical" and f.name in few})
        small = [f.name for f in self.features if f.kind == "categorical" and f.name in packed and f.name not in few]
        if small:
            dictionaries, names = [packed[f] for f in small], [f"f{i}" for i in range(len(small))]

            @F.arrow_udf("struct<" + ", ".join(f"{n}: int" for n in names) + ">")
            def look_up(*columns: pa.Array) -> pa.Array:
                codes = [pc.index_in(c.cast(d.type), value_set=d) for c, d in zip(columns, dictionaries, strict=True)]
                return pa.StructArray.from_arrays(codes, names=names)

            found = unused_name(out.columns)
            out = out.withColumn(found, look_up(*(F.col(f"`{c}`") for c in small)))
            out = out.withColumns({c: F.col(f"{found}.f{i}") for i, c in enumerate(small)}).drop(found)
        large = [f.name for f in self.features if f.kind == "categorical" and f.name not in packed]
        return self._joined(out, large) if large else out

    def _joined(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df with the codes of columns whose levels stay in Spark: one join of all their cells with the levels, whatever their number."""
        row = unused_name(df.columns)
        key, codes = f"{row}row", [f"{row}{i}" for i in range(len(names))]
        rows = materialize(df.withColumn(row, F.monotonically_increasing_id()), "rows")  # so that numbers stay
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("label")) for c in names))).alias("x")
        long = rows.select(F.col(row).alias(key), cells).select(key, "x.*").where("label is not null").join(self.levels.where(F.col("feature").isin(names)), ["feature", "label"])
        wide = long.groupBy(key).agg(*(F.max(F.when(F.col("feature") == c, F.col("category"))).alias(k) for c, k in zip(names, codes, strict=True)))
        out = rows.join(wide, F.col(row) == F.col(key), "left").withColumns({c: F.col(k) for c, k in zip(names, codes, strict=True)})
        return out.select(*df.columns)


def _code_of(label: Column, levels: list[str]) -> Column:
    """The label's place among the levels; null for null and unseen ones."""
    return F.try_element_at(F.create_map(*(F.lit(x) for i, level in enumerate(levels) for x in (level, i))), label.cast("string"))


def unused_name(names: list[str]) -> str:
    """A name that isn't among these, in any case."""
    taken, name = {n.lower() for n in names}, "_every"
    while name in taken:
        name += "_"
    return name


def df_range(like: DataFrame, n: int) -> DataFrame:
    return like.sparkSession.range(n)


def levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, category, label): each column's distinct non-null values, numbered in their order."""
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, category int, label string")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("label")) for c in columns))).alias("x")
    seen = df.select(pairs).select("x.*").where("label is not null").distinct()
    # numbered range by range, so that no task has to hold a column's levels
    numbered = running_sums(seen, ["label"], {"category": F.lit(1)}, ["feature"])
    return numbered.select("feature", (F.col("category") - 1).cast("int").alias("category"), "label")


def coerced(df: DataFrame) -> DataFrame:
    """Numbers as double, booleans as string."""
    kind = lambda k: "string" if k in ("string", "boolean") else "double"
    return df.select(*(F.col(c).cast(kind(k)).alias(c) for c, k in df.dtypes))


def categorical_index(domain: DataFrame, order: list[str]) -> DataFrame:
    """(feature, category, feature_place, place): for each level in `order`'s feature order, its place among all, summed range by range."""
    rank = F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(order) for x in (f, i))), F.col("feature"))
    rows = domain.select("feature", "category", rank.alias("feature_place"))
    return running_sums(rows, ["feature_place", "category"], {"place": F.lit(1)}).withColumn("place", (F.col("place") - 1).cast("int"))


def to_long(df: DataFrame, row_id: str, features: list[str]) -> DataFrame:
    """(row_id, feature, category) of every non-missing cell."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("category")) for f in features))).alias("x")
    return df.select(F.col(row_id).alias("row_id"), cells).select("row_id", "x.*").where("category is not null")


def one_hot(code: Column, k: int) -> Column:
    """Array of k ints, one of them 1; all 0 for a missing code."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce((i == code).cast("int"), F.lit(0)))


def from_one_hot(a: Column, n_valid: int | None = None) -> Column:
    """The first largest place, among the first n_valid if given."""
    part = F.slice(a, 1, n_valid) if n_valid else a
    return F.array_position(part, F.array_max(part)).cast("int") - 1


def from_dummies(df: DataFrame, sep: str = "_", keep: list[str] | None = None) -> DataFrame:
    """Columns named prefix + sep + level become one column per prefix with the level whose value is 1; columns of `keep` stay as they are."""
    groups: dict[str, list[tuple[str, str]]] = {}
    for c in df.columns:
        prefix, _, level = c.rpartition(sep)
        if prefix and c not in (keep or []):
            groups.setdefault(prefix, []).append((c, level))
    return df.select(*(keep or []), *(F.coalesce(*(F.when(F.col(f"`{c}`") == 1, F.lit(level)) for c, level in members)).alias(prefix) for prefix, members in groups.items()))


def padded_one_hot(codes: list[str], sizes: dict[str, int]) -> Column:
    """Array over features of arrays as long as the largest domain: one 1 for each code, zeros beyond a feature's own domain and for missing codes."""
    most = max(sizes.values())
    return F.array(*(F.when(F.col(c) < sizes[c], one_hot(F.col(c), most)).otherwise(F.array_repeat(F.lit(0), most)) for c in codes))


def log_one_hot(a: Column) -> Column:
    """0 for the place that is 1, minus infinity elsewhere."""
    return F.transform(a, lambda x: F.when(x == 1, F.lit(0.0)).otherwise(F.lit(float("-inf"))))


def from_log_one_hot(a: Column) -> Column:
    """1 where the logarithm is 0, else 0."""
    return F.transform(a, lambda x: (x == 0.0).cast("int"))


def repaired(a: Column, valid: Column | None = None) -> Column:
    """A one-hot array that doesn't sum to 1 takes its first place, or the first that the array `valid` allows."""
    first = F.lit(1) if valid is None else F.array_position(valid, F.lit(True)).cast("int")
    total = F.aggregate(a, F.lit(0), lambda t, x: t + x)
    return F.when(total == 1, a).otherwise(F.transform(a, lambda _, i: (i + 1 == first).cast("int")))


def masked_pair(train: DataFrame, test: DataFrame, truth: DataFrame | None = None, complete: DataFrame | None = None, n_bins: int = 20) -> tuple[TableSchema, DataFrame, DataFrame, DataFrame | None]:
    """(schema, train, test, truth) encoded alike. The schema is that of `complete`, the training table before cells were masked, if given, else of train."""
    columns = [c for c, k in train.dtypes if k in ("string", "double")]
    schema = TableSchema.fit((train if complete is None else complete).select(*columns), n_bins)
    return schema, schema.encode(train), schema.encode(test), None if truth is None else schema.encode(truth)


def filled(df: DataFrame, text: str = "missing", number: float = -999.0) -> DataFrame:
    return df.na.fill(text).na.fill(number)
