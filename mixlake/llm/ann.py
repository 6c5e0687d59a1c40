"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search on it.

Equal vectors are one node; each vector length has a graph of its own. The graph starts from windows over
buckets of random hyperplane bits; a crowded bucket is dealt again, by which of two of its own rows is nearer. Then, round by round, each node introduces its neighbours (and a sample of the nodes that have it as a
neighbour) to one another, and every node keeps the NEIGHBOURS best it has met, until few change.
A search keeps a beam of nodes per query and follows the graph from the best until all of the beam
have been followed. Rounds work on vectors of 8-bit integers; what a search returns is scored again
on the original vectors in double precision.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mixlake.llm.shared import aligned, discard, materialize, table

NEIGHBOURS, REVERSE = 30, 20
#: Rows that a window of the start compares, tables of hyperplanes, and mean rows of a bucket.
WINDOW, TABLES, BUCKET_ROWS = 256, 3, 48
#: Rounds end when at most this share of the edges is new.
SETTLED = 0.02
#: Pairs of a crowded bucket's rows that deal it again, and how often at most; what is left then is compared in windows.
PIVOTS, DEALS = 8, 16
#: Best pairs that each neighbour takes from one introduction.
INTRODUCED = 10
#: Nearest of a window that each of its rows takes from the start.
SENT = 12
#: Nodes in a query's beam, followed at a time, that every search may start from.
BEAM, FOLLOWED, ENTRIES = 192, 24, 256


def _norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that take part, one for each id (of several the smallest vector).

    Null ids, and vectors that are null, empty, zero or hold null or non-finite numbers, take no part.
    """
    out = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    out = out.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    return out.where(_norm("embedding") > 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nodes(rows: DataFrame, copies: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors as (node, embedding, code), where node is their smallest vec_id; and (node, vec_id) of the `copies` smallest ids of each.

    code holds the unit vector as 8-bit integers. All vectors have the same length.
    """
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("_rank") <= copies)
    ranked = materialize(ranked, "copies")
    firsts = ranked.where("_rank = 1").select(F.col("vec_id").alias("node"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                code = np.rint(x * (127 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30))).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in code], pa.binary())], names=["node", "embedding", "code"])

    kind = firsts.schema["embedding"].dataType.simpleString()
    coded = materialize(firsts.mapInArrow(run, f"node long, embedding {kind}, code binary"), "nodes")
    first = firsts.select(F.col("node"), F.col("embedding").alias("_e"))
    members = ranked.where("_rank > 1").join(first, F.col("embedding") == F.col("_e")).select("node", "vec_id")
    return coded, members.unionByName(firsts.select("node", F.col("node").alias("vec_id")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows of 8-bit codes."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


_GRAPH = "u long, v long, s float"


def _pairs(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float32())], names=["u", "v", "s"])


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each u its k largest s among different v, ties to the smaller v."""
    order = np.lexsort((-s, v, u))
    u, v, s = u[order], v[order], s[order]
    once = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
    u, v, s = u[once], v[once], s[once]
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, int)
    place = np.arange(len(u)) - np.repeat(starts, np.diff(np.r_[starts, len(u)]))
    return u[place < k], v[place < k], s[place < k]


def _block(ids: np.ndarray, x: np.ndarray, k: int, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a block its k nearest others in it, only those nearer than `worst` if that is given."""
    s = x @ x.T
    s[ids[:, None] == ids[None, :]] = -np.inf
    k = min(k, len(ids) - 1)
    if k < 1:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.float32)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    u, v, w = np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, axis=1).ravel()
    real = np.isfinite(w) if worst is None else np.isfinite(w) & (w > np.repeat(worst, k))
    return u[real], v[real], w[real]


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Pairs from many blocks, the NEIGHBOURS best of each u among about `rows` at a time: what a task sends for a node that many introduce is bounded."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= rows:
            best = _best(*(np.concatenate([h[i] for h in held]) for i in range(3)), NEIGHBOURS)
            held, size = [best], len(best[0])
            if size >= rows // 2:
                yield _pairs(*best)
                held, size = [], 0
    if size:
        yield _pairs(*_best(*(np.concatenate([h[i] for h in held]) for i in range(3)), NEIGHBOURS))


def _start(coded: DataFrame, n: int, seed: int) -> DataFrame:
    """Pairs of nodes that share a bucket of hyperplane bits; crowded buckets are dealt again until windows hold them."""
    bits = max(1, math.ceil(math.log2(max(2, n / BUCKET_ROWS))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _codes(batch.column(1))
            for t in range(TABLES):
                planes = np.random.default_rng((seed, t)).normal(size=(x.shape[1], bits)).astype(np.float32)
                key = ((x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))) * TABLES + t
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), batch.column(0), batch.column(1)], names=["key", "node", "code"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                ids, x = np.asarray(batch.column(1)), _codes(batch.column(2)) if batch.num_rows else None
                for k in range(0, max(1, len(ids) - WINDOW // 2), WINDOW // 2):
                    if len(ids):
                        yield _block(ids[k : k + WINDOW], x[k : k + WINDOW], SENT)

        yield from _gathered(parts())

    keyed = materialize(coded.select("node", "code").mapInArrow(place, "key long, node long, code binary"), "buckets")
    dealt = None
    for level in range(DEALS):
        crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > WINDOW // 2)
        crowded = materialize(crowded, "crowded")
        if crowded.isEmpty():
            break
        order = W.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), F.lit(level), "key", "node"), "node")
        drawn = keyed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2 * PIVOTS)
        # rows of equal codes can't be told apart: such buckets stay
        pivots = drawn.join(crowded, "key").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("_r", "code"))).alias("x"))
        pivots = materialize(pivots.where(F.size(F.array_distinct("x.code")) > 1).select("key", "n", F.col("x.code").alias("pivots")), "pivots")
        done = keyed.join(pivots.select("key"), "key", "left_anti")
        dealt = done if dealt is None else dealt.unionByName(done)
        keyed = materialize(keyed.join(pivots, "key").select("key", "node", "code", "n", "pivots").mapInArrow(_dealt_again, "key long, node long, code binary"), "buckets")
    dealt = keyed if dealt is None else dealt.unionByName(keyed)
    # each table has its own order, so windows of what stays crowded differ
    return dealt.repartition("key").sortWithinPartitions("key", F.xxhash64("key", "node")).mapInArrow(compare, _GRAPH)


def _dealt_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, code) of rows with their bucket's n and pivots: a bit for each pair of pivots, 1 if the first is nearer, joins the key."""
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            b = whole.slice(k, 1000)
            x, key, out = _codes(b.column(2)), b.column(0).to_numpy(), np.zeros(b.num_rows, np.int64)
            for one in np.unique(key):
                own = np.flatnonzero(key == one)
                pivots = _codes(b.column(4)[int(own[0])].values)
                pairs = min(len(pivots) // 2, math.ceil(math.log2(b.column(3)[int(own[0])].as_py() / BUCKET_ROWS)))
                s = x[own] @ pivots.T
                bits = (s[:, : 2 * pairs : 2] > s[:, 1 : 2 * pairs : 2]) @ (1 << np.arange(pairs, dtype=np.int64))
                with np.errstate(over="ignore"):
                    mixed = (one.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + bits.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
                    out[own] = (mixed ^ (mixed >> np.uint64(32))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out), b.column(1), b.column(2)], names=["key", "node", "code"])


def _merge(pairs: DataFrame) -> DataFrame:
    """The NEIGHBOURS best of each u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in aligned(batches):
            yield _pairs(*_best(*(t.column(i).to_numpy() for i in range(3)), NEIGHBOURS))

    return pairs.repartition("u").sortWithinPartitions("u").mapInArrow(run, _GRAPH)


def _introduce(graph: DataFrame, coded: DataFrame, seed: int) -> DataFrame:
    """Pairs of nodes that share a neighbour: a node's own neighbours and REVERSE of those that it is a neighbour of."""
    order = W.partitionBy("v").orderBy(F.xxhash64(F.lit(seed), "u"), "u")
    back = graph.select("u", "v").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= REVERSE).select(F.col("v").alias("hub"), F.col("u").alias("node"))
    members = graph.select(F.col("u").alias("hub"), F.col("v").alias("node")).unionByName(back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for t in aligned(batches):
                hub, ids, x, worst = t.column(0).to_numpy(), t.column(1).to_numpy(), _codes(t.column(2)), t.column(3).to_numpy()
                starts = np.r_[np.flatnonzero(np.r_[True, hub[1:] != hub[:-1]]), len(hub)]
                for a, b in zip(starts, starts[1:], strict=False):
                    yield _block(ids[a:b], x[a:b], INTRODUCED, worst[a:b])

        yield from _gathered(parts())

    # a node that has all its neighbours only hears of nearer ones
    worst = graph.groupBy("u").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    known = coded.select("node", "code").join(worst, F.col("node") == F.col("u"), "left").select("node", "code", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
    return members.join(known, "node").select("hub", "node", "code", "worst").repartition("hub").sortWithinPartitions("hub").mapInArrow(run, _GRAPH)


def neighbour_graph(coded: DataFrame, seed: int = 0, rounds: int | None = None) -> DataFrame:
    """(u, v, s): about the NEIGHBOURS nearest nodes of every node. Fewer than two nodes have no edges.

    Rounds go on until the graph is settled, or to their number if it is given; neighbours only get nearer, so they end.
    """
    n = coded.count()
    graph = materialize(_merge(_start(coded, n, seed)), "graph")
    for k in itertools.count() if rounds is None else range(rounds):
        grown = materialize(_merge(_introduce(graph, coded, seed + k).unionByName(graph)), "graph")
        new = grown.join(graph.select("u", "v"), ["u", "v"], "left_anti").count()
        discard(graph)
        graph = grown
        if new <= SETTLED * NEIGHBOURS * n:
            break
    return graph


def search(graph: DataFrame, coded: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query_id, node): the beams' nodes of every query after greedy search.

    queries: query_id, code and start, the query's own node if it has one, else null. All searches also
    start from the best of ENTRIES nodes, those of the smallest hashes, a fixed number that is sent to all.
    """
    entries = coded.orderBy(F.xxhash64(F.lit(1), "node"), "node").limit(ENTRIES).select("node", "code").collect()
    if not entries:
        return queries.select("query_id", F.lit(None).cast("long").alias("node")).limit(0)
    entry_ids = np.array([r.node for r in entries], np.int64)
    entry_codes = _codes(pa.array([bytes(r.code) for r in entries]))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _codes(batch.column(1)) @ entry_codes.T
                top = np.argsort(-s, axis=1, kind="stable")[:, :FOLLOWED]
                own = batch.column(2).to_pylist()
                rows = [(q, int(entry_ids[j]), float(s[i, j]), False) for i, q in enumerate(batch.column(0).to_pylist()) for j in top[i]]
                rows += [(q, o, 1.0, False) for q, o in zip(batch.column(0).to_pylist(), own, strict=True) if o is not None]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float32(), pa.bool_()), strict=True)], names=["query_id", "node", "s", "followed"])

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", _codes(batch.column(2)), _codes(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float32()), pa.array(np.zeros(len(s), bool))], names=["query_id", "node", "s", "followed"])

    shape = "query_id long, node long, s float, followed boolean"
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("s"), "node"))
    keep = lambda df: df.groupBy("query_id", "node").agg(F.max("s").alias("s"), F.max("followed").alias("followed")).withColumn("_r", rank).where(F.col("_r") <= beam).drop("_r")
    codes = queries.select("query_id", F.col("code").alias("q"))
    state = materialize(keep(queries.select("query_id", "code", "start").mapInArrow(enter, shape)), "beam")
    while not state.where("not followed").isEmpty():
        turn = F.row_number().over(W.partitionBy("query_id").orderBy("followed", F.desc("s"), "node"))
        marked = state.withColumn("_t", turn).withColumn("_go", ~F.col("followed") & (F.col("_t") <= FOLLOWED))
        go = marked.where("_go").select("query_id", F.col("node").alias("u"))
        met = graph.select("u", F.col("v").alias("node")).join(go, "u").select("query_id", "node").distinct()
        met = met.join(state.select("query_id", "node"), ["query_id", "node"], "left_anti")
        scored = met.join(coded.select("node", "code"), "node").join(codes, "query_id").select("query_id", "node", "code", "q").mapInArrow(rescore, shape)
        after = marked.select("query_id", "node", "s", (F.col("followed") | F.col("_go")).alias("followed"))
        old, state = state, materialize(keep(after.unionByName(scored)), "beam")
        discard(old)
    return state.select("query_id", "node")


def nearest(rows: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row for which `queries` holds, nearest first, ties to the smaller vec_id.

    queries is a condition on the column vec_id. Every row is indexed. The score is the cosine of the
    original vectors. Vectors of each length are an index of their own, searched by that length's queries.
    A query has fewer than k rows only if its length has no more. An empty table gives an empty one;
    other columns are left out, whatever their names.
    """
    own = materialize(vectors(rows, vec_id, embedding), "vectors")
    lengths = [r.n for r in own.where(queries).select(F.size("embedding").alias("n")).distinct().orderBy("n").collect()]
    parts = [_nearest(own.where(F.size("embedding") == n), queries, k, seed) for n in lengths or [0]]
    return reduce(DataFrame.unionByName, parts)


def _nearest(own: DataFrame, queries: Column, k: int, seed: int) -> DataFrame:
    """nearest() of vectors of one length."""
    coded, members = nodes(own, k + 1)
    members = materialize(members, "members")
    asked = own.where(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    where = coded.select(F.col("node").alias("start"), F.col("embedding").alias("query"), "code")
    asked = materialize(asked.join(where, "query"), "queries")
    graph = neighbour_graph(coded, seed)
    found = search(graph, coded, asked.select("query_id", "code", "start"), max(BEAM, 4 * k))
    exact = coded.select("node", "embedding")
    dot = F.aggregate(F.zip_with("query", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = found.join(exact, "node").join(asked.select("query_id", "query"), "query_id").select("query_id", "node", (dot / (_norm("query") * _norm("embedding"))).alias("score"))
    near = scored.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "node"))).where(F.col("_r") <= beam_rows(k))
    out = near.join(members, "node").where("vec_id <> query_id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def beam_rows(k: int) -> int:
    """Nodes whose copies can be among the k nearest, ties included as far as a beam holds them."""
    return max(BEAM, 4 * k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
