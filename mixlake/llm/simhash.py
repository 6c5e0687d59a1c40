"""SimHash near-duplicate detection by the generalised pigeonhole principle.

Fingerprints have 64 bits. Two that differ in at most t bits must, for any m groups of bits with
thresholds summing to t - m + 1, differ by no more than its threshold in one group at least. Groups
gather correlated bits; thresholds (-1: not probed, 0: equal, 1: one bit off) come from dynamic
programming over the estimated number of candidates. Fingerprints meet in buckets, where each bucket
yields a spanning forest of its verified links, never all its pairs. A bucket with many fingerprints
is dealt again by further pigeonholes over the bits not yet fixed, so after all levels at most
2**15 distinct fingerprints can meet in one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlake.llm.components import connected_components
from mixlake.llm.shared import materialize, table, unused, without

BITS = 64
#: A bucket with more fingerprints than this is dealt again.
BUCKET = 4096
#: Seconds for a row that is shuffled, and for a pair that is compared: the weights of the plan's cost.
ROW_S, PAIR_S = 1e-6, 1e-8
LEVELS = 4


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42, name: str = "fingerprint") -> DataFrame:
    """Replaces the text by the column `name` (long: the 64 bits), also one that has this name already, and keeps all others.

    Words are runs of anything but space and \\t-\\r, A-Z lower-cased; shingles of `shingle` words
    count as often as they occur, fewer words make one shingle. A bit is set if more than half of the
    shingles' XXH64 values have it. Null and empty texts and texts without words get 0.
    Very long texts are hashed in pieces, so memory follows the words of one text.
    """
    docs = without(docs, [name], text)
    out = unused(docs, "_fp")
    schema = T.StructType([*docs.drop(text).schema.fields, T.StructField(out, T.LongType())])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((_fingerprint(x, shingle, seed) for x in _texts(batch.column(place))), np.uint64, batch.num_rows)
            rest = [batch.column(i) for i in range(batch.num_columns) if i != place]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(prints.view(np.int64))], names=[*(c for i, c in enumerate(batch.schema.names) if i != place), out])

    return docs.mapInArrow(run, schema).withColumnRenamed(out, name)


def _texts(column: pa.Array) -> Iterator[str | None]:
    for k in range(0, len(column), 256):
        yield from column.slice(k, 256).to_pylist()


def _fingerprint(text: str | None, shingle: int, seed: int) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: both touch ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    total, ones, step = len(words) - shingle + 1, np.zeros(BITS, np.int64), 1 << 15
    for k in range(0, total, step):
        part = words[k : k + step + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle)), strict=False)
        hashes = np.fromiter((xxh64_intdigest(b" ".join(g), seed) for g in grams), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def bit_statistics(prints: DataFrame, name: str = "fingerprint") -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for every two bits, how many have both set: over all rows, 2080 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                bits = _bits(np.asarray(batch.column(0).slice(k, 8192)).view(np.uint64)).astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)
            n += batch.num_rows
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array([*i.tolist(), BITS], pa.int32()), pa.array([*j.tolist(), BITS], pa.int32()), pa.array([*both[i, j].tolist(), n], pa.int64())], names=["i", "j", "n"])

    rows = prints.select(name).mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    n, both = 0, np.zeros((BITS, BITS))
    for r in rows:
        if r.i == BITS:
            n = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def plan(n: int, both: np.ndarray, distance: int = 3) -> list[tuple[int, int]]:
    """(mask of bits, threshold 0 or 1) for each group that is probed: the cheapest over all numbers of groups."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(share * (1 - share))
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.abs(np.nan_to_num((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)))
    differ = 2 * share * (1 - share)  # that two fingerprints differ in a bit
    best: tuple[float, list[tuple[int, int]]] = (math.inf, [])
    for m in range(1, distance + 2):
        groups = _correlated_groups(near, m)
        costs = []  # by group: cost by threshold -1, 0, 1
        for g in groups:
            p0 = float(np.prod(1 - differ[g]))
            p1 = p0 + sum(float(differ[b] * np.prod(np.delete(1 - differ[g], k))) for k, b in enumerate(g))
            pairs = n * (n - 1) / 2
            costs.append([0.0, n * ROW_S + pairs * p0 * PAIR_S, n * (len(g) + 1) * ROW_S + pairs * p1 * PAIR_S])
        table_: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # sum of thresholds so far -> cost, thresholds
        for c in costs:
            grown: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, chosen) in table_.items():
                for e in (-1, 0, 1):
                    if total + e not in grown or cost + c[e + 1] < grown[total + e][0]:
                        grown[total + e] = (cost + c[e + 1], [*chosen, e])
            table_ = grown
        found = table_.get(distance - m + 1)
        if found and found[0] < best[0]:
            best = (found[0], [(sum(1 << int(b) for b in g), e) for g, e in zip(groups, found[1], strict=True) if e >= 0])
    return best[1]


def _correlated_groups(near: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each starts with the free bit of strongest ties and takes the bits closest to it."""
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        group = [max(sorted(free), key=lambda b: near[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            nxt = max(sorted(free), key=lambda b: near[b, group].sum())
            group.append(nxt)
            free.discard(nxt)
        groups.append(sorted(group))
    return groups


def _key(where: np.ndarray | int, value: np.ndarray) -> np.ndarray:
    """Mixes a bucket's place and value; a clash only makes a larger bucket, as every link is verified."""
    with np.errstate(over="ignore"):
        x = value * np.uint64(0x9E3779B97F4A7C15) + np.asarray(where, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


_BUCKETS = "key long, fixed long, own boolean, fingerprint long"


def _arrow(key: np.ndarray, fixed: np.ndarray, own: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fixed.view(np.int64)), pa.array(own), pa.array(prints.view(np.int64))], names=["key", "fixed", "own", "fingerprint"])


def _deal(prints: DataFrame, groups: list[tuple[int, int]]) -> DataFrame:
    """A row for each bucket of each fingerprint; own: the bucket has its own bits, not a variant's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 65536):
                x = np.asarray(batch.column(0).slice(k, 65536)).view(np.uint64)
                for place, (mask, threshold) in enumerate(groups):
                    fixed = np.full(len(x), mask, np.uint64)
                    yield _arrow(_key(place + 1, x & np.uint64(mask)), fixed, np.ones(len(x), bool), x)
                    for b in range(BITS) if threshold else ():
                        if mask >> b & 1:
                            yield _arrow(_key(place + 1, (x ^ np.uint64(1 << b)) & np.uint64(mask)), fixed, np.zeros(len(x), bool), x)

    return prints.select("fingerprint").mapInArrow(run, _BUCKETS)


def _split(buckets: DataFrame, parts: int) -> DataFrame:
    """Deals the rows of crowded buckets again: links that differ in fewer than `parts` bits agree on one of as many parts of the bits not yet fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fixed, x = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1, 3))
            own = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for mask in np.unique(fixed):
                rows = fixed == mask
                free = [b for b in range(BITS) if not int(mask) >> b & 1]
                for j in range(parts):
                    part = np.uint64(sum(1 << b for b in free[j::parts]))
                    yield _arrow(_key(key[rows] + np.uint64(j + 1), x[rows] & part), np.full(rows.sum(), mask | part, np.uint64), own[rows], x[rows])

    return buckets.mapInArrow(run, _BUCKETS)


def forest(prints: np.ndarray, own: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join everything that the bucket's links join, one fewer than fingerprints at most.

    Each fingerprint that is reached is compared with those not reached yet, so a dense bucket
    shrinks at once. Pairs of two variants are met in other buckets too and verify alike.
    """
    if len(prints) <= 256:
        if (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance).sum() == len(prints):
            return []
    elif not own.any():
        return []
    links, left, queue = [], prints, []
    while queue or len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= distance
        if near.any():
            found = left[near]
            left = left[~near]
            links += [(int(at), int(y)) for y in found]
            queue += list(found)
    return links


def _link(buckets: DataFrame, distance: int) -> DataFrame:
    """Links of every bucket. Buckets come sorted, one after another; only one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            key, x = np.asarray(batch.column(0)), np.asarray(batch.column(3)).view(np.uint64)
            own = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            if not len(key):
                continue
            cut = int(np.searchsorted(_from_end(key), 1))  # rows of the last bucket, which may go on
            cut = len(key) - cut
            if cut:
                held.append((key[:cut], x[:cut], own[:cut]))
                yield from _links_of(held, distance)
                held = []
            held.append((key[cut:], x[cut:], own[cut:]))
        if held:
            yield from _links_of(held, distance)

    return buckets.mapInArrow(run, "a long, b long")


def _from_end(key: np.ndarray) -> np.ndarray:
    """From the last row on: 0 while the key is the last row's, then 1."""
    return (key[::-1] != key[-1]).cumsum() > 0


def _links_of(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], distance: int) -> Iterator[pa.RecordBatch]:
    key, x, own = (np.concatenate([h[i] for h in held]) for i in range(3))
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    a, b = [], []
    two = starts[sizes == 2]
    close = two[np.bitwise_count(x[two] ^ x[two + 1]) <= distance]
    a.append(x[close])
    b.append(x[close + 1])
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        if found := forest(np.unique(x[s : s + n]), own[s : s + n], distance):
            pairs = np.array(found, np.uint64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(prints: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all within `distance` bits. prints: a column fingerprint, each once."""
    spark = prints.sparkSession
    n, both = bit_statistics(prints)
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    todo, ready = materialize(_deal(prints, plan(n, both, distance)), "buckets"), []
    for level in range(LEVELS + 1):
        crowded = todo.groupBy("key").count().where(F.col("count") > bucket).select("key")
        if level == LEVELS or crowded.isEmpty():
            ready.append(todo)
            break
        crowded = materialize(crowded, "crowded")
        ready.append(todo.join(crowded, "key", "left_anti"))
        todo = materialize(_split(todo.join(crowded, "key", "left_semi").select("key", "fixed", "own", "fingerprint"), distance + 1), "split")
    out = None
    for part in ready:
        found = _link(part.select("key", "fixed", "own", "fingerprint").repartition("key").sortWithinPartitions("key"), distance)
        out = found if out is None else out.unionByName(found)
    return out


def _grouped(nodes: DataFrame, distance: int, bucket: int) -> DataFrame:
    """nodes (a row for each fingerprint) with component, the smallest fingerprint that each reaches."""
    member = connected_components(links(nodes.select("fingerprint"), distance, bucket))
    return nodes.join(member, F.col("fingerprint") == F.col("node"), "left").drop("node")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id, the smallest doc_id of all it is linked with.

    Equal fingerprints are one node, so a group of copies costs one row. Repeated rows stay;
    a null doc_id stays and is never the smallest (a component of nulls only has null). Other columns
    are left out, whatever their names. An empty table gives an empty one.
    """
    rows = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle, seed), "prints")
    nodes = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    linked = _grouped(nodes, distance, bucket)
    lowest = linked.where("component is not null").groupBy("component").agg(F.min("least").alias("lowest"))
    named = linked.join(lowest, "component", "left").select("fingerprint", F.coalesce("lowest", "least").alias("component_id"))
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """One row of each component of docs: that of the smallest doc_id; of several rows with this id the one of the smallest text hash.

    Rows without doc_id come last: one stays if its component has no other. Rows of one doc_id whose texts aren't
    linked are in different components, so each stays. Texts are shuffled once, to meet the verdict.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))
    rows = materialize(fingerprints(slim, "text", shingle, seed), "prints")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    nodes = materialize(rows.groupBy("fingerprint").agg(F.min(rank).alias("first")), "nodes")
    linked = _grouped(nodes, distance, bucket)
    first = linked.groupBy(F.coalesce("component", "fingerprint")).agg(F.min("first").alias("first")).select("first.doc_id", "first.text_key")
    ids, keys, both = unused(docs, "_ids"), unused(docs, "_keys"), unused(docs, "_both")
    own = lambda i, k: F.xxhash64(i, k)
    first = first.select(F.col("doc_id").alias(f"{ids}_1"), F.col("text_key").alias(f"{keys}_1"), own("doc_id", "text_key").alias(f"{both}_1"))
    marked = docs.withColumn(keys, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn(both, own(F.col(doc_id), F.col(keys)))
    # the hash alone is the key of the join, so that the rows lie as the last step needs them; the rest is compared row by row
    same_id = F.coalesce(F.col(doc_id) == F.col(f"{ids}_1"), F.col(doc_id).isNull() & F.col(f"{ids}_1").isNull())
    same_text = F.col(keys).bitwiseXOR(F.col(f"{keys}_1")) == 0
    # one plan at every size: the verdict has a row per component
    kept = marked.join(first.hint("merge"), (F.col(both) == F.col(f"{both}_1")) & same_id & same_text, "left_semi")
    return kept.dropDuplicates([both, keys, doc_id]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
