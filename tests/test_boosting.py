"""Boosted trees against a plain version that holds all rows, and what a table's teaching is worth."""

import math
import random

import numpy as np
import pytest

from mixlake.operators import boosting as B


def split_of(rows, g, h, features, sizes, ordered, l2):
    """The best (gain, feature, codes that go left) of some rows, from sets of codes."""
    best = None
    for f in range(features):
        there = sorted({x[f] for x in rows})
        sums = {k: (sum(a for a, x in zip(g, rows, strict=True) if x[f] == k), sum(a for a, x in zip(h, rows, strict=True) if x[f] == k)) for k in there}
        order = there if ordered[f] else sorted(there, key=lambda k: (sums[k][0] / (sums[k][1] + l2), k))
        for cut in range(1, len(order)):
            lg, lh = (sum(sums[k][i] for k in order[:cut]) for i in (0, 1))
            tg, th = sum(g), sum(h)
            gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                left = set(range(-1, order[cut - 1] + 1)) if ordered[f] else set(order[:cut])
                best = (gain, f, left)
    return best


def grow(rows, g, h, depth, *how, rate=0.1):
    """A function from a row to the tree's value."""
    l2 = how[-1]
    value = -rate * sum(g) / (sum(h) + l2)
    best = split_of(rows, g, h, *how) if depth and rows else None
    if best is None:
        return lambda x: value
    _, f, left = best
    sides = []
    for side in (True, False):
        own = [i for i, x in enumerate(rows) if (x[f] in left) == side]
        sides.append(grow([rows[i] for i in own], [g[i] for i in own], [h[i] for i in own], depth - 1, *how, rate=rate))
    return lambda x: sides[0](x) if x[f] in left else sides[1](x)


def brute(rows, labels, classes, rounds, depth, sizes, ordered, l2=3.0):
    outputs = 1 if classes == 2 else classes
    margins = [[0.0] * outputs for _ in rows]
    trees = []
    whole = lambda x: round(x * B.ONE) / B.ONE
    for _ in range(rounds):
        now = []
        for o in range(outputs):
            p = [1 / (1 + math.exp(-m[0])) if classes == 2 else math.exp(m[o]) / sum(map(math.exp, m)) for m in margins]
            g = [whole(q - (y == (1 if classes == 2 else o))) for q, y in zip(p, labels, strict=True)]
            h = [max(whole(q * (1 - q)), 1 / B.ONE) for q in p]
            now.append(grow(rows, g, h, depth, len(sizes), sizes, ordered, l2))
        for m, x in zip(margins, rows, strict=True):
            for o in range(outputs):
                m[o] += now[o](x)
        trees.append(now)
    return trees


def data(classes, n=400):
    r = random.Random(classes)
    rows = [(r.randrange(6), r.randrange(-1, 5), r.randrange(4)) for _ in range(n)]
    labels = [min(classes - 1, (x[0] in (1, 4)) + (x[1] >= 2) * (classes > 2) + (r.random() < 0.1)) for x in rows]
    return rows, labels


@pytest.mark.parametrize("classes", [2, 3])
def test_equals_a_plain_version(spark, classes):
    rows, labels = data(classes)
    sizes, ordered = [6, 5, 4], [False, True, False]
    table = spark.createDataFrame([(*(None if v < 0 else v for v in x), y, "kept") for x, y in zip(rows, labels, strict=True)] + [(1, 1, 1, None, "no label")], "a int, b int, c int, y int, margin string").repartition(3)
    model = B.Boosted.fit(table, ["a", "b", "c"], sizes, ordered, "y", classes, rounds=5, depth=3, save_every=2)
    plain = brute(rows, labels, classes, 5, 3, sizes, ordered)
    probe = spark.createDataFrame([(a, b, c) for a in (*range(6), None, 9) for b in (*range(5), None) for c in range(4)], "a int, b int, c int")
    for row in model.probabilities(probe).collect():
        x = tuple(-1 if v is None or v >= s else v for v, s in zip((row.a, row.b, row.c), sizes, strict=True))
        m = [sum(t[o](x) for t in plain) for o in range(len(plain[0]))]
        want = [1 / (1 + math.exp(m[0])), 1 / (1 + math.exp(-m[0]))] if classes == 2 else (np.exp(m) / np.exp(m).sum()).tolist()
        assert row.probabilities == pytest.approx(want, abs=1e-9)
    assert len(model.trees) == 5 and all(len(t) == (1 if classes == 2 else 3) for t in model.trees)


def test_utility(spark):
    r = random.Random(2)

    def table(n, noise):
        out = []
        for _ in range(n):
            x, u = r.random() * 10, r.choice("pqr")
            y = "high" if (x > 5) != (r.random() < noise) else "low"
            out.append((None if r.random() < 0.02 else y, x if r.random() > 0.05 else None, u))
        return spark.createDataFrame(out, "y string, x double, u string")

    real = table(600, 0.02)
    good, bad = (B.utility(table(800, noise), real, "y", 10, 8, 2).first() for noise in (0.05, 0.5))
    assert good.accuracy > 0.9 and good.auc > 0.93 and good.n_classes == 2 and good.n_test == real.where("y is not null").count()
    assert bad.accuracy < 0.8 and bad.auc < good.auc
    three = real.selectExpr("case when x > 7 then 'c' when x > 3 then 'b' else 'a' end as y", "x", "u")
    assert B.utility(three, three, "y", 20, 6, 3).first().auc > 0.99


def test_edges_of_utility(spark):
    real = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", None)], "y string, x double")
    none = B.utility(real.limit(0), real, "y", 5, 2, 2).first()
    assert none.n_train == 0 and none.auc == pytest.approx(0.5)
    one = B.utility(real, real.where("y = 'a'"), "y", 5, 2, 2).first()
    assert one.auc is None and one.n_test == 2
    assert B.utility(real, real.limit(0), "y", 5, 2, 2).first().n_test == 0


def test_equal_rows_are_handled_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    rows = [(f"a{r.integers(3)}", float(r.integers(4)), f"c{r.integers(3)}") for _ in range(2000)]
    df = spark.createDataFrame(rows, "n string, y double, target string")
    base = df.select(F.substring("n", 2, 1).cast("int").alias("x0"), F.substring("target", 2, 1).cast("int").alias("y"))
    few = B._counted(base, [3], 3)
    assert few.count() == 9 and few.agg(F.sum("n")).first()[0] == 2000
    want = B.utility(df, df, "target", 4, rounds=2, depth=2).collect()
    monkeypatch.setattr(B, "COMBINED", 0)
    assert B._counted(base, [3], 3).count() == 2000
    got = B.utility(df, df, "target", 4, rounds=2, depth=2).collect()
    assert want[0][:4] == got[0][:4] and want[0][4] == pytest.approx(got[0][4], abs=1e-12)
