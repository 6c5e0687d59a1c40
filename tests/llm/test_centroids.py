import hashlib
import math

import numpy as np

from mixlake.llm import centroids as C


def brute(rows, k, rounds, scale, dimensions):
    """[(vec_id, cluster, distance)] and the centroids, by all distances in Python's integers."""
    kept = [(i, [math.floor(float(v) * scale) for v in x]) for i, x in rows if x is not None and len(x) == dimensions and all(v is not None and math.isfinite(float(v) * scale) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [x for _, x in order[:k]]
    far = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c, strict=True))
    for t in range(rounds + 1):
        a = [min(range(len(cs)), key=lambda c: (far(x, cs[c]), c)) for _, x in kept]
        if t < rounds:
            for c in range(len(cs)):
                own = [x for (_, x), at in zip(kept, a, strict=True) if at == c]
                if own:
                    cs[c] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    return [(i, at, far(x, cs[at])) for (i, x), at in zip(kept, a, strict=True)], cs


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 7, "e") for i, x in rows], "vec_id long, embedding array<double>, cluster int, X string").repartition(3)


def order(rows):
    return sorted(((i if i is not None else -1, c, d if d is not None else -1) for i, c, d in rows))


def agrees(spark, rows, k, rounds, scale=64, dimensions=4):
    found = C.cluster(frame(spark, rows), k=k, rounds=rounds, scale=scale, dimensions=dimensions)
    want, cs = brute(rows, k, rounds, scale, dimensions)
    got = found.rows.collect()
    assert found.centroids == cs
    assert order((r.vec_id, r.cluster, r.distance) for r in got) == order((i, c, d if d <= C.LARGEST else None) for i, c, d in want)
    return found, got


def test_equals_all_distances_with_ties_and_copies(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(5, 4))
    rows = [(i, (centres[i % 5] + 0.3 * r.normal(size=4)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(150)] + [(3, rows[3][1]), (None, rows[9][1]), (None, rows[8][1])]
    rows += [(600 + i, [float(v) / 64 for v in r.integers(-2, 3, size=4)]) for i in range(300)]  # few values: many ties
    _, got = agrees(spark, rows, 7, 4)
    assert sum(x.n_distances for x in got) < 0.7 * len(got) * 7 * 5  # the bounds leave distances out


def test_only_ties(spark):
    rows = [(i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(60)]
    agrees(spark, rows, 6, 3, scale=1)
    agrees(spark, [(i, [1.0] * 4) for i in range(40)], 5, 3)


def test_vectors_that_are_left_out_and_few_vectors(spark):
    rows = [(1, [0.1, -0.2, 0.3, 0.0]), (2, None), (3, []), (4, [1.0] * 5), (5, [None, 1.0, 1.0, 1.0]), (6, [float("nan")] * 4), (7, [float("inf"), 0.0, 0.0, 0.0]), (8, [1.7e308, 0.0, 0.0, 0.0]), (9, [-0.1, 0.0, 0.5, 1.0])]
    found, got = agrees(spark, rows, 16, 3)
    assert {r.vec_id for r in got} == {1, 9} and len(found.centroids) == 2
    assert found.inertia == [0, 0]


def test_huge_numbers_are_exact(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=4) * 10.0 ** r.integers(0, 30)).tolist()) for i in range(80)] + [(100, [1e300, -1e300, 1.0, 0.0])]
    found, got = agrees(spark, rows, 4, 3)
    assert any(x.distance is None for x in got) or None not in found.inertia


def test_empty_table(spark):
    found = C.cluster(frame(spark, []), dimensions=4)
    assert found.rows.collect() == [] and found.centroids == [] and found.inertia == []


def test_query_and_sql(spark, tmp_path):
    import duckdb

    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=64).astype(np.float32).tolist()) for i in range(120)] + [(500, [1.0] * 63)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = C.query(spark, str(tmp_path)).toPandas()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.sql(C.SQL).df()
    key = ["vec_id"]
    assert got.sort_values(key).values.tolist() == want[got.columns.tolist()].sort_values(key).values.tolist() and len(got) == 120
