import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from mixlake.llm import mixing


def slow_targets(sizes, weights=(5.0, 2.0, 1.0)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, out = set(names), float(sum(sizes.values())), {}
    while True:
        share = {s: (total - sum(out.values())) * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left.discard(s)
        if not left:
            return out


def corpus(spark):
    rows = []
    for s, n, words in (("a", 40, 5), ("b", 900, 11), (None, 60, 7), ("Z", 300, 3), ("é", 10, 200), ("tiny", 2, 1), ("none", 3, 0)):
        begin = len(rows)
        rows += [(begin + k, "w " * (words + k % 3 if words else 0), s, 1) for k in range(n)]
    rows += [(5, None, "a", 1), (None, "x y", "a", 1), (7, "same row", "b", 1), (7, "same row", "b", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, times int")


def test_mix_follows_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 3)
    rows, docs = corpus(spark)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    got = mixing.mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    taken = {}
    for r in mixing.mix(docs.where("doc_id <> 7 and doc_id <> 5")).join(docs.select("doc_id", "source"), "doc_id").collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) >= len(rows)
    for r in got:
        assert r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
        if r.doc_id is not None and r.doc_id not in (5, 7):
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in taken.items():
        assert abs(t - want[s]) <= 220
    assert sum(taken.values()) <= sum(sizes.values())


def test_reruns_agree_whatever_the_partitions(spark):
    _, docs = corpus(spark)
    a, b = (sorted(map(tuple, mixing.mix(x).collect()), key=str) for x in (docs.repartition(7), docs.coalesce(1)))
    assert a == b
    assert sum(x[5] for x in a) <= sum(x[1] for x in a)


def slow_mix(rows):
    """(doc_id, size, source) and how often it is taken, for each row."""
    seen, docs, sizes = {}, [], {}
    for i, t, s, _ in rows:
        key = (i, s, len((t or "").split()))
        docs.append((*key, seen.setdefault(key, 0)))
        seen[key] += 1
        sizes[s] = sizes.get(s, 0) + key[2]
    goal, entries = slow_targets(sizes), []
    for rank, s in enumerate([*sorted((x for x in sizes if x is not None), key=lambda x: x.encode()), None]):
        done = 0
        for h, i, n, c in sorted((hashlib.md5(f"0 {'-' if i is None else i} {n} {c}".encode()).hexdigest(), i, n, c) for i, x, n, c in docs if x == s):
            done += n
            entries += [((e * sizes[s] + done) / goal[s], rank, h, (i, s, n, c)) for e in range(3) if n]
    times, spent = dict.fromkeys(docs, 0), 0
    for _, _, _, d in sorted(entries):
        spent += d[2]
        if spent > sum(sizes.values()):
            break
        times[d] += 1
    return Counter((i, n, s, k) for (i, s, n, _), k in times.items())


def test_merge_and_cut_match_brute_force(spark):
    rows, docs = corpus(spark)
    rows = rows + [(9, "same", "b", 1)] * 20
    docs = spark.createDataFrame(rows, docs.schema).repartition(5)
    got = Counter((r.doc_id, r["size"], r.source, r.times) for r in mixing.mix(docs).collect())
    assert got == slow_mix(rows)
    db = duckdb.connect()
    db.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    sql = Counter((x[0], x[1], x[4]) for x in db.sql(mixing.SQL).fetchall())
    assert sql == Counter((i, n, n * k) for (i, n, _, k), m in got.items() for _ in range(m))


def test_mixed_documents_and_empty(spark):
    _, docs = corpus(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 9  # three rows of one doc_id, three times each
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("source = 'none'")).agg(F.sum("taken")).first()[0] == 0


def test_mixed_documents_follow_the_plan_also_without_ids(spark):
    rows, docs = corpus(spark)
    want = Counter()
    for (i, n, s, k), m in slow_mix(rows).items():
        want[(i, n, s)] += k * m
    got = Counter((r.doc_id, len((r.text or "").split()), r.source) for r in mixing.mixed_documents(docs).collect())
    assert got[(None, 2, "a")] > 0
    assert got == Counter({x: k for x, k in want.items() if k})
