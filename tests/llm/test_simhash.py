import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from mixlake.llm import simhash
from mixlake.llm.components import connected_components


def slow_print(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance=3):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = list(parent)
    for i, a in enumerate(u):
        for b in u[:i]:
            if bin(a ^ b).count("1") <= distance:
                parent[find(a)] = find(b)
    return {p: find(p) for p in u}


def texts(seed=0):
    r, out = random.Random(seed), []
    for _ in range(60):
        words = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(r.choice([1, 2, 5, 60, 300]))]
        for _ in range(r.choice([1, 1, 4])):
            copy = words[:]
            if len(copy) > 50 and r.random() < 0.7:
                copy[r.randrange(len(copy))] = "changed" + str(r.random())
            out.append(" ".join(copy))
    return [*out, None, "", " \n\t", "Ünï ÀB cd\x0bef", "a b c " * 40_000]


def test_fingerprints_and_components_match_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, "repeated id", "x"), (None, "no id", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = slow_components([slow_print(t) for _, t, _ in rows])
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[want[slow_print(t)]].append(i)
    least = {c: min((i for i in v if i is not None), default=None) for c, v in ids.items()}
    expected = sorted(((i, slow_print(t), least[want[slow_print(t)]]) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got), key=str) == expected


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_join_what_brute_force_joins_also_when_every_bucket_is_split(spark, bucket):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(12)} | {sum(1 << k for k in r.sample(range(12), 3)) for _ in range(120)}
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fingerprint long")
    found = simhash.links(frame, 3, bucket).collect()
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in found)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[find(a % 2**64)] = find(b % 2**64)
    want = slow_components(list(prints))
    groups = lambda f: {frozenset(p for p in prints if f(p) == f(q)) for q in prints}
    assert groups(find) == groups(want.__getitem__)


def test_plan_covers_every_difference():
    r = np.random.default_rng(0)
    bits = r.integers(0, 2, (500, 64)).astype(float)
    bits[:, 1] = bits[:, 0]
    for n in (500, 10**6, 10**10):
        chosen = simhash.plan(n, bits.T @ bits * (n / 500))
        for _ in range(300):
            x = sum(1 << int(b) for b in r.choice(64, 3, replace=False))
            assert any(bin(x & mask).count("1") <= e for mask, e in chosen)


def test_empty_and_keep_first(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n int")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    docs = spark.createDataFrame([(5, "one two three four", 1), (2, "one two three four", 2), (9, "other words are here", 3), (None, "x", 4)], "doc_id long, text string, n int")
    assert sorted((r.doc_id or -1, r.n) for r in simhash.keep_first(docs).collect()) == [(-1, 4), (2, 2), (9, 3)]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (7, 9), (9, 8), (8, 7), (None, 4), (2, 1)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{100 + i: 100 for i in range(41)}}


def test_keep_first_keeps_one_row_of_each_component(spark):
    rows = [(5, "one two three four", "a"), (5, "quite other words here", "b"), (None, "one two three four", "c"), (None, "alone without an id", "d"), (None, "alone without an id", "e"), (7, None, "f"), (8, "", "g"), (9, "same row twice now", "h"), (9, "same row twice now", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string").repartition(4)
    out = simhash.keep_first(docs)
    got = sorted((str(r.doc_id), r.text or "", r._kept) for r in out.collect())
    assert [x[:2] for x in got] == [("5", "one two three four"), ("5", "quite other words here"), ("7", ""), ("9", "same row twice now"), ("None", "alone without an id")]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(_both") == 2  # the rows and the verdict, once each
