"""Boosted trees over encoded tables, and how well a table teaches them: trained on one table, tested on another.

Rows stay in Spark. A level of all trees of a round is one job: tasks add up gradients by (class, node, feature,
code) in numpy, one partial sum per task and cell is shuffled, and the driver, which gets the model's own number of cells,
chooses the splits. Gradients are whole numbers of 2^-20, so sums don't depend on partitions and ties are decided alike.
Margins are written to the shared folder every few rounds; in between tasks apply the newest trees to the codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlake.operators import metrics as M
from mixlake.operators.schema import TableSchema, unused_name
from mixlake.operators.scoring import lists
from mixlake.sources.scratch import discard, materialize

#: Gradients are counted in parts of this.
ONE = 1 << 20
#: Combinations of codes and label that a table can have, at most, for its equal rows to be counted and handled once.
COMBINED = 1_000_000


@dataclass(frozen=True)
class Tree:
    """By node: the feature that splits it (-1: none), which codes go left (code + 1; missing ones are code -1), its children (itself without a split) and value."""

    feature: np.ndarray
    left_codes: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def nodes(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row of codes, already + 1, gets to."""
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(depth):
            f = self.feature[at]
            goes_left = self.left_codes[at, codes[rows, np.maximum(f, 0)]]
            at = np.where(f < 0, at, np.where(goes_left, self.left[at], self.right[at]))
        return at


def _single_node(width: int) -> Tree:
    return Tree(np.array([-1]), np.zeros((1, width), bool), np.array([0]), np.array([0]), np.zeros(1))


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, ordered: bool, l2: float) -> tuple[float, np.ndarray] | None:
    """(gain, codes that go left) of one node and feature from its sums by code; None if no split gains.

    Ordered codes are cut at a threshold, others after being sorted by their mean gradient; the first of equal gains wins.
    """
    there = np.flatnonzero(n)
    if len(there) < 2:
        return None
    g, h = g / ONE, h / ONE
    order = there if ordered else there[np.lexsort((there, g[there] / (h[there] + l2)))]
    left_g, left_h = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
    total_g, total_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2) - total_g**2 / (total_h + l2)
    k = int(gain.argmax())
    if not gain[k] > 1e-9:
        return None
    codes = np.zeros(len(n), bool)
    codes[order[: k + 1]] = True
    if ordered:
        codes[: order[k] + 1] = True  # codes that the node hasn't seen, too
    return float(gain[k]), codes


@dataclass(frozen=True)
class Boosted:
    """trees[round][output] over features with codes 0 to size - 1; one output for two classes, one for each class beyond."""

    features: tuple[str, ...]
    sizes: tuple[int, ...]
    ordered: tuple[bool, ...]
    classes: int
    depth: int
    trees: tuple[tuple[Tree, ...], ...]

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], sizes: list[int], ordered: list[bool], label: str, classes: int, rounds: int = 100, depth: int = 6, rate: float = 0.1, l2: float = 3.0, save_every: int = 10) -> Boosted:
        """Trains on codes and a label from 0 to classes - 1; rows without a label are left out. Null codes and those beyond a size count as missing.

        Two classes have logistic loss, more have softmax. Every tree starts from margins 0. No rows give trees of one node, value 0.
        """
        width, outputs = 1 + max(sizes, default=0), 1 if classes == 2 else classes
        base = rows.where(F.col(label).isNotNull()).select(*(F.col(f).cast("int").alias(f"x{i}") for i, f in enumerate(features)), F.col(label).cast("int").alias("y"))
        state = materialize(_counted(base, sizes, classes).withColumn("margin", F.array_repeat(F.lit(0.0), outputs)), "margins")
        done: list[tuple[Tree, ...]] = []
        fresh: list[tuple[Tree, ...]] = []
        for t in range(rounds):
            growing, opens = [_single_node(width) for _ in range(outputs)], [[0]] * outputs
            for _ in range(depth):
                if not any(opens):
                    break
                sums = _histograms(state, sizes, classes, depth, fresh, growing, opens)
                grown = [_grown(tree, nodes, *(x[o] for x in sums), sizes, ordered, rate, l2) for o, (tree, nodes) in enumerate(zip(growing, opens, strict=True))]
                growing, opens = [tree for tree, _ in grown], [nodes for _, nodes in grown]
            done.append(tuple(growing))
            fresh.append(tuple(growing))
            if len(fresh) == save_every and t + 1 < rounds:
                old, state = state, materialize(_with_margins(state, sizes, depth, fresh), "margins")
                discard(old)
                fresh = []
        discard(state)
        return cls(tuple(features), tuple(sizes), tuple(ordered), classes, depth, tuple(done))

    def probabilities(self, rows: DataFrame, name: str = "probabilities") -> DataFrame:
        """rows with the array of the classes' probabilities. Needs no labels; other columns stay."""
        own = self

        @F.arrow_udf("array<double>")
        def run(*columns: pa.Array) -> pa.Array:
            margins = _margins(_matrix(list(columns), own.sizes), np.zeros((len(columns[0]), len(own.trees[0]) if own.trees else 1)), own.trees, own.depth)
            return lists(_probabilities(margins, own.classes))

        return rows.withColumn(name, run(*(F.col(f).cast("int") for f in self.features)))


def _counted(rows: DataFrame, sizes: list[int], classes: int, name: str = "n") -> DataFrame:
    """rows with a column of numbers: equal rows as one with their number where there can be few different ones, else each with 1."""
    if math.prod(k + 1 for k in sizes) * (classes + 1) > COMBINED:
        return rows.withColumn(name, F.lit(1).cast("long"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias(name))


def _matrix(columns: list[pa.Array], sizes: tuple[int, ...] | list[int]) -> np.ndarray:
    """Codes + 1, 0 for missing ones, as (rows, features)."""
    out = np.empty((len(columns[0]), len(columns)), np.int64)
    for i, (c, size) in enumerate(zip(columns, sizes, strict=True)):
        x = np.asarray(c.fill_null(-1)).astype(np.int64) + 1
        out[:, i] = np.where((x < 0) | (x > size), 0, x)
    return out


def _margins(codes: np.ndarray, margins: np.ndarray, trees, depth: int) -> np.ndarray:
    for several in trees:
        for o, tree in enumerate(several):
            margins[:, o] += tree.value[tree.nodes(codes, depth)]
    return margins


def _probabilities(margins: np.ndarray, classes: int) -> np.ndarray:
    if classes == 2:
        p = 1 / (1 + np.exp(-margins[:, 0]))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _state_columns(batch: pa.RecordBatch, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    codes = _matrix([batch.column(i) for i in range(len(sizes))], sizes)
    margins = np.asarray(batch.column("margin").flatten()).reshape(batch.num_rows, -1).copy()
    return codes, margins


def _with_margins(state: DataFrame, sizes: list[int], depth: int, trees: list[tuple[Tree, ...]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, margins = _state_columns(b, sizes)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists(_margins(codes, margins, trees, depth))], names=b.schema.names)

    return state.mapInArrow(run, state.schema)


def _histograms(state: DataFrame, sizes: list[int], classes: int, depth: int, fresh: list[tuple[Tree, ...]], growing: list[Tree], opens: list[list[int]]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """By output the sums of gradients, of second derivatives and of rows, as (open node, feature, code + 1)."""
    width, features, outputs = 1 + max(sizes, default=0), len(sizes), len(growing)
    most = max(len(o) for o in opens)
    cells = outputs * most * features * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g_sum, h_sum, n_sum = (np.zeros(cells, np.int64) for _ in range(3))
        for b in batches:
            if not b.num_rows:
                continue
            codes, margins = _state_columns(b, sizes)
            p = _probabilities(_margins(codes, margins, fresh, depth), classes)
            y, rows = np.asarray(b.column("y")), np.asarray(b.column("n")).astype(float)
            for o, tree in enumerate(growing):
                own = p[:, 1] if classes == 2 else p[:, o]
                g = np.rint((own - (y == (1 if classes == 2 else o))) * ONE) * rows
                h = np.maximum(np.rint(own * (1 - own) * ONE), 1) * rows
                slots = np.full(len(tree.feature), -1)
                slots[opens[o]] = np.arange(len(opens[o]))
                slot = slots[tree.nodes(codes, depth)]
                there = slot >= 0
                at = (((o * most + slot[there])[:, None] * features + np.arange(features)) * width + codes[there]).ravel()
                for total, w in ((g_sum, g), (h_sum, h)):
                    total += np.bincount(at, np.repeat(w[there], features), minlength=cells).astype(np.int64)  # whole numbers, far below 2^53
                n_sum += np.bincount(at, np.repeat(rows[there], features), minlength=cells).astype(np.int64)
        at = np.flatnonzero(n_sum)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(g_sum[at]), pa.array(h_sum[at]), pa.array(n_sum[at])], names=["cell", "g", "h", "n"])

    got = state.mapInArrow(run, "cell long, g long, h long, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    out = []
    for name in ("g", "h", "n"):
        whole = np.zeros(cells, np.int64)
        whole[np.asarray(got.column("cell"))] = np.asarray(got.column(name))
        out.append(list(whole.reshape(outputs, most, features, width)))
    return tuple(out)


def _grown(tree: Tree, nodes: list[int], g: np.ndarray, h: np.ndarray, n: np.ndarray, sizes: list[int], ordered: list[bool], rate: float, l2: float) -> tuple[Tree, list[int]]:
    """The tree with its open nodes split where that gains, and the new nodes, with their values."""
    feature, left, right, value, codes = list(tree.feature), list(tree.left), list(tree.right), list(tree.value), list(tree.left_codes)

    def leaf_value(some: np.ndarray, slot: int, f: int) -> float:
        return float(-rate * (g[slot, f, some].sum() / ONE) / (h[slot, f, some].sum() / ONE + l2))

    for slot, node in enumerate(nodes):
        best: tuple[float, int, np.ndarray] | None = None
        for f, size in enumerate(sizes):
            found = best_split(g[slot, f, : size + 1], h[slot, f, : size + 1], n[slot, f, : size + 1], ordered[f], l2)
            if found and (best is None or found[0] > best[0]):
                best = (found[0], f, found[1])
        everything = np.ones(g.shape[-1], bool)
        if node == 0 and sizes:
            value[0] = leaf_value(everything, slot, 0)
        if best is None:
            continue
        _, f, goes = best
        some = np.zeros(g.shape[-1], bool)
        some[: len(goes)] = goes
        feature[node], codes[node], left[node], right[node] = f, some, len(feature), len(feature) + 1
        for side in (some, ~some):
            feature.append(-1)
            codes.append(np.zeros(g.shape[-1], bool))
            left.append(len(left))
            right.append(len(right))
            value.append(leaf_value(side, slot, f))
    return Tree(np.array(feature), np.array(codes), np.array(left), np.array(right), np.array(value)), list(range(len(tree.feature), len(feature)))


def utility(train: DataFrame, test: DataFrame, target: str, n_bins: int = 20, rounds: int = 100, depth: int = 6, rate: float = 0.1, l2: float = 3.0) -> DataFrame:
    """One row: n_train, n_test, n_classes, accuracy and auc on `test` of trees trained on `train`, a synthetic table for example.

    Columns of both are strings or doubles. Rows without the target are left out; missing cells and levels that train lacks are
    codes of their own. Classes are both tables' labels, sorted. auc is that of the second of two classes, else the mean over
    the classes that test has, each against the rest. Null where test has one class only.
    """
    train, test = (df.where(F.col(target).isNotNull()) for df in (train, test))
    features = [c for c in train.columns if c != target]
    schema = TableSchema.fit(train.select(*features), n_bins)
    classes = M.label_codes(train, test, target)
    known = [r.label for r in classes.orderBy("code").collect()]  # one for each class
    size_of = {r.feature: r.k for r in schema.domain().groupBy("feature").agg((F.max("category") + 1).alias("k")).collect()}
    sizes, ordered = [size_of.get(f.name, 1) for f in schema.features], [f.kind == "numerical" for f in schema.features]
    coded = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(known) for x in (c, i))), F.col(target)).alias("_label") if known else F.lit(None).cast("int").alias("_label")
    encode = lambda df: schema.encode(df.select(*features, coded))
    learned = encode(train)
    model = Boosted.fit(learned, features, sizes, ordered, "_label", max(2, len(known)), rounds, depth, rate, l2)
    number = unused_name([*features, "_label"])
    asked = _counted(encode(test).select(*features, "_label"), sizes, max(2, len(known)), number)
    scored = materialize(model.probabilities(asked).select("_label", "probabilities", F.col(number).alias("_n")), "scored")
    p = F.col("probabilities")
    answers = M.accuracy(scored.withColumn("_best", (F.array_position(p, F.array_max(p)) - 1).cast("int")), "_best", "_label", "_n")
    if len(known) <= 2:
        ranks = M.auc(scored.select(p[1].alias("s"), F.col("_label").alias("y"), "_n"), "s", "y", "_n")
    else:
        by = scored.select(F.col("_label").cast("string").alias("y"), "_n", *(p[i].alias(f"s{i}") for i in range(len(known))))
        ranks = M.auc_one_vs_rest(by, "y", "y", [str(i) for i in range(len(known))], [f"s{i}" for i in range(len(known))], "_n").agg(F.avg("auc").alias("auc"))
    counts = train.agg(F.count("*").alias("n_train"))
    return counts.crossJoin(answers).crossJoin(ranks).select("n_train", F.coalesce(F.col("n"), F.lit(0)).alias("n_test"), F.lit(len(known)).alias("n_classes"), "accuracy", "auc")  # three tables of one row
