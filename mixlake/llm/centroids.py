"""Centroid clustering by Lloyd's rounds, with Elkan's bounds to leave out distances that can't matter.

Vectors become integers, so distances are exact. Every vector keeps an upper bound of the distance to its
own centroid and a lower bound of that to each centroid; when centroids move, the bounds are loosened by how
far. A centroid is left out for a vector only if its lower bound, or half its distance to the vector's own
centroid, is strictly above the upper bound; all bounds are rounded outwards. So ties are always compared,
and the smaller number wins, as if every distance had been calculated.

A round is one pass over the vectors without a shuffle: its state is a table in the shared folder, and the one
before it is deleted. Sums of a cluster are added up in the tasks; a task sends one row for each number of a centroid.
Centroids alone (k vectors) are on the driver and in the tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlake.llm.shared import discard, materialize, table

K, ROUNDS, SCALE, DIMENSIONS, SEED = 16, 3, 64, 64, "1"
#: Bits of one digit of a sum that crosses tasks.
DIGIT = 32
LARGEST = (1 << 63) - 1
_STATE = "vec_id {}, x array<double>, cluster int, upper double, lower array<float>, n_distances int"


@dataclass(frozen=True)
class Clustering:
    """rows: (vec_id, cluster, distance, n_distances); centroids: their exact integers; inertia of each, null beyond a long."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int | None]


def vectors_of(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): x holds floor(scale * component), as doubles. Left out are vectors that are null, have another
    number of components or hold one that is null, not finite, or so large that scale times it isn't finite."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    fine = F.coalesce((F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < F.lit(math.inf))), F.lit(False))
    return df.where(fine).select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda v: v * scale).alias("x"))


def first_centroids(vectors: DataFrame, k: int = K, seed: str = SEED) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes; rows of one id follow by their numbers, rows without an id come last."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(h.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return [[math.floor(v) for v in r.x] for r in rows]


def _whole(x: np.ndarray) -> np.ndarray:
    """Doubles that are integers as int64, or as Python's integers where their squares could leave it."""
    if not x.size or np.abs(x).max() <= _safe(x.shape[-1]):
        return x.astype(np.int64)
    out = np.empty(x.shape, object)
    out[...] = [[int(v) for v in row] for row in x]
    return out


def _safe(dimensions: int) -> int:
    """Integers up to this give squared distances within int64."""
    return math.isqrt(LARGEST // max(1, dimensions)) // 2


def _array(centroids: list[list[int]]) -> np.ndarray:
    small = max((abs(v) for c in centroids for v in c), default=0) <= _safe(len(centroids[0]))
    return np.array(centroids, dtype=np.int64 if small else object)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to c (one vector, or one a row)."""
    d = x - c
    return (d * d).sum(axis=1)


def _roots(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles below and above the roots of exact integers."""
    if d2.dtype == object:
        whole = [math.isqrt(int(v)) for v in d2]
        top = 1 << 1023
        return np.array([float(min(w, top)) * (1 - 2**-50) for w in whole], float), np.array([float(w + 1) * (1 + 2**-50) if w < top else math.inf for w in whole], float)
    root = np.sqrt(d2.astype(float))
    return root * (1 - 2**-50), root * (1 + 2**-50)


def _narrow(x: np.ndarray) -> np.ndarray:
    """float32 at or below x."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return np.where(y.astype(float) > x, np.nextafter(y, np.float32(-np.inf)), y)


def _first(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Clusters, upper and lower bounds and distances made, from all distances."""
    d2 = np.stack([squared(x, c) for c in centroids], axis=1)
    best = d2.argmin(axis=1)  # the first of equal ones
    low, high = _roots(d2.ravel())
    low, high = low.reshape(d2.shape), high.reshape(d2.shape)
    return best, high[np.arange(len(x)), best], low, np.full(len(x), len(centroids))


def _next(x: np.ndarray, centroids: np.ndarray, half: np.ndarray, moved: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """The same from the bounds of the round before. half: half the distances between centroids, from below; moved: how far each went, from above."""
    upper = (upper + moved[a]) * (1 + 2**-50)
    lower = np.maximum((lower - moved) * np.where(lower > moved, 1 - 2**-50, 1 + 2**-50), 0)
    made, a, k = np.zeros(len(x), int), a.copy(), len(centroids)
    others = np.arange(k)[None] != a[:, None]
    rows = np.flatnonzero((others & (lower <= upper[:, None]) & (half[a] <= upper[:, None])).any(axis=1))
    if not len(rows):
        return a, upper, lower, made
    own = squared(x[rows], centroids[a[rows]])
    low, high = _roots(own)
    upper[rows], lower[rows, a[rows]] = high, low
    made[rows] += 1
    best, nearest = own.copy(), a[rows].copy()
    open_ = others[rows] & (lower[rows] <= high[:, None]) & (half[a[rows]] <= high[:, None])
    for c in range(k):
        some = np.flatnonzero(open_[:, c])
        if not len(some):
            continue
        d2 = squared(x[rows[some]], centroids[c])
        low, high = _roots(d2)
        lower[rows[some], c] = low
        made[rows[some]] += 1
        better = (d2 < best[some]) | ((d2 == best[some]) & (c < nearest[some]))
        got = some[np.asarray(better, bool)]
        best[got], nearest[got], upper[rows[got]] = d2[better.astype(bool)], c, high[better.astype(bool)]
    a[rows] = nearest
    return a, upper, lower, made


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel(), kind))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, width)


def assigned(state: DataFrame, centroids: list[list[int]], before: list[list[int]] | None, id_type: str) -> DataFrame:
    """One round: the state with the nearest of `centroids` by exact distance. before: the centroids of the round before, None in the first."""
    c, d = _array(centroids), len(centroids[0])
    exact = [[int(v) for v in row] for row in centroids]
    if before is not None:
        pairs = np.array([sum((p - q) ** 2 for p, q in zip(a, b, strict=True)) for a in exact for b in exact], dtype=object)
        half = (_roots(pairs)[0] / 2).reshape(len(c), len(c))
        went = np.array([sum((p - int(q)) ** 2 for p, q in zip(a, b, strict=True)) for a, b in zip(exact, before, strict=True)], dtype=object)
        moved = np.where(went == 0, 0.0, _roots(went)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.floor(_matrix(b.column("x"), d))
            big = np.abs(x).max(axis=1) > _safe(d)
            a, upper, lower, made = np.empty(len(x), int), np.empty(len(x)), np.empty((len(x), len(c))), np.empty(len(x), int)
            for part in (np.flatnonzero(~big), np.flatnonzero(big)):
                if not len(part):
                    continue
                own = _whole(x[part])
                if before is None:
                    got = _first(own, c)
                else:
                    was = np.asarray(b.column("cluster"))[part], np.asarray(b.column("upper"))[part], _matrix(b.column("lower"), len(c))[part]
                    got = _next(own, c, half, moved, *was)
                a[part], upper[part], lower[part], made[part] = got
            if before is not None:
                made = made + np.asarray(b.column("n_distances"))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), _lists(x, pa.float64()), pa.array(a.astype(np.int32)), pa.array(upper), _lists(_narrow(lower), pa.float32()), pa.array(made.astype(np.int32))],
                names=["vec_id", "x", "cluster", "upper", "lower", "n_distances"],
            )

    return state.mapInArrow(run, _STATE.format(id_type))


def _digits(v: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of an integer in digits of DIGIT bits, all with its sign."""
    sign, v, place = (-1 if v < 0 else 1), abs(v), 0
    while v:
        yield place, sign * (v & ((1 << DIGIT) - 1))
        v, place = v >> DIGIT, place + 1


def moved_centroids(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floors of the clusters' exact means; a cluster without vectors keeps its centroid."""
    k, d = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [[0] * d for _ in range(k)], [0] * k
        for b in batches:
            x, a = _matrix(b.column("x"), d), np.asarray(b.column("cluster"))
            for c in np.unique(a):
                some = _whole(x[a == c])
                n[c] += len(some)
                total[c] = [p + int(q) for p, q in zip(total[c], some.sum(axis=0), strict=True)]
        out = [(c, -1, 0, n[c]) for c in range(k) if n[c]]
        out += [(c, i, place, digit) for c in range(k) for i in range(d) for place, digit in _digits(total[c][i])]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["c", "i", "place", "v"])

    # one row for a task and a number at most, then one for a number; a long holds the digits of 2^31 tasks
    sums = state.select("x", "cluster").mapInArrow(run, "c int, i int, place int, v long").groupBy("c", "i", "place").agg(F.sum("v").alias("v")).collect()
    n, total = [0] * k, [[0] * d for _ in range(k)]
    for r in sums:
        if r.i < 0:
            n[r.c] = r.v
        else:
            total[r.c][r.i] += r.v << (DIGIT * r.place)
    return [[v // n[c] for v in total[c]] if n[c] else list(centroids[c]) for c in range(k)]


def cluster(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> Clustering:
    """Clusters the vectors that vectors_of() keeps; other columns are left out.

    Every row is a vector of its own, repeated rows and rows with a null id too. Fewer than k vectors give as many
    centroids; none give an empty table. Distances and inertia beyond a long are null. n_distances counts the
    distances that a row has needed, of k * (rounds + 1) that a plain search makes; the last, which every row has, isn't counted.
    """
    vectors = vectors_of(df, vec_id, embedding, dimensions, scale)
    id_type = dict(vectors.dtypes)["vec_id"]
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        none = df.sparkSession.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, n_distances int")
        return Clustering(none, [], [])
    state, before = materialize(assigned(vectors, centroids, None, id_type), "clusters"), None
    for _ in range(rounds):
        before, centroids = centroids, moved_centroids(state, centroids)
        old, state = state, materialize(assigned(state, centroids, before, id_type), "clusters")
        discard(old)
    c, d = _array(centroids), dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, a = _matrix(b.column("x"), d), np.asarray(b.column("cluster"))
            big, out = np.abs(x).max(axis=1) > _safe(d), np.empty(len(x), object)
            for part in (np.flatnonzero(~big), np.flatnonzero(big)):
                if len(part):
                    out[part] = squared(_whole(x[part]), c[a[part]])
            distance = pa.array([int(v) if v <= LARGEST else None for v in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), distance, b.column("n_distances")], names=["vec_id", "cluster", "distance", "n_distances"])

    rows = materialize(state.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long, n_distances int"), "clustered")
    discard(state)
    total: list[int | None] = [0] * len(centroids)
    for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("v"), F.count_if(F.col("distance").isNull()).alias("lost")).collect():
        total[r.cluster] = None if r.lost or r.v is None else int(r.v)
    return Clustering(rows, centroids, total)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    whole = None if None in found.inertia else sum(found.inertia)
    fits = lambda v: v if v is not None and v <= LARGEST else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    about = spark.createDataFrame([(c, fits(found.inertia[c]), fits(whole), sha[c]) for c in range(len(sha))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid


def _round_sql(r: int) -> str:
    """Named subqueries a{r}, every vector's nearest centroid of c{r}, and c{r + 1}, the floors of their means."""
    return f"""a{r} AS MATERIALIZED (SELECT rid, vec_id, v, b.c AS c, b.d AS d FROM (SELECT rid, any_value(vec_id) AS vec_id, any_value(k.v) AS v, min({{'d': CAST(list_sum(list_transform(list_zip(k.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': c{r}.c}}) AS b FROM kept k, c{r} GROUP BY rid)),
m{r} AS (SELECT c, list(CAST(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS BIGINT) ORDER BY i) AS v FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({DIMENSIONS})) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))"""


SQL = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {K})),
{', '.join(_round_sql(r) for r in range(ROUNDS + 1))}
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)"""
