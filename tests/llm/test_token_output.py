import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixlake.llm import bpe
from mixlake.llm import token_output as O


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 1000, 65_537])
def test_permutation_is_a_bijection(n):
    places = O.permuted(np.arange(n), n, 3)
    assert sorted(places.tolist()) == list(range(n))
    assert n < 100 or (places != O.permuted(np.arange(n), n, 4)).any() and (places[1:] - places[:-1] == 1).mean() < 0.1


def test_shards_hold_every_document_once(spark, tmp_path):
    r = random.Random(0)
    rows = [(i, "é" * r.choice([0, 1, 10, 300, 5000]) + str(i), 1) for i in range(150)] + [(None, None, 1), (3, None, 1), (4, "same", 1), (4, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(3).select("doc_id", "slot", O.byte_tokens(F.col("text")).alias("tokens"))
    out = O.sequences(docs, length=256, shard=16).cache()
    got = sorted(out.collect(), key=lambda x: x.sequence)
    n = len(got)
    assert [x.sequence for x in got] == list(range(n)) and sorted(x.slot for x in got) == list(range(n))
    assert all(len(x.payload) == 256 and x.shard == x.slot // 16 and x.position == x.slot % 16 for x in got)
    stream = b"".join(x.payload for x in got).rstrip(bytes([O.PAD]))
    assert Counter(stream.split(bytes([O.END]))[:-1]) == Counter((t or "").encode() for _, t, _ in rows)
    again = O.sequences(docs.repartition(5), length=256, shard=16)
    assert sorted((x.slot, bytes(x.payload)) for x in again.collect()) == sorted((x.slot, bytes(x.payload)) for x in got)
    folder = f"file://{tmp_path}/shards"
    written = O.write_shards(out, folder).collect()
    assert sum(x.n_sequences for x in written) == n and all(x.n_bytes == 256 * x.n_sequences for x in written)
    by = {x.slot: bytes(x.payload) for x in got}
    assert list(O.read_slots(folder, 13, 40, 256, 16)) == [by[k] for k in range(13, 53)]
    assert list(O.read_slots(folder, n - 2, 2, 256, 16)) == [by[n - 2], by[n - 1]]


def test_wide_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, [5, 50_000, 7]), (2, None), (3, [])], "doc_id long, ids array<int>")
    rows = docs.select("doc_id", O.packed_ids(F.col("ids")).alias("tokens"))
    got = O.sequences(rows, end=(50_256).to_bytes(2, "little"), pad=(50_257).to_bytes(2, "little"), length=8, shard=4).collect()
    ids = np.frombuffer(got[0].payload, "<u2").tolist()
    assert len(got) == 1 and sorted(ids) == sorted([5, 50_000, 7, 50_256, 50_256, 50_256, 50_257, 50_257])
    assert O.sequences(rows.limit(0)).count() == 0


def test_query_writes_shards_of_tokenizer_ids(spark, monkeypatch):
    texts = [(1, "the license, the license"), (2, None), (3, ""), (4, "é漢 code" * 700)]
    monkeypatch.setattr(O, "table", lambda *a: spark.createDataFrame(texts, "doc_id long, text string"))
    folders, write = [], O.write_dealt
    monkeypatch.setattr(O, "write_dealt", lambda rows, folder: folders.append(folder) or write(rows, folder))
    got = sorted(O.query(spark, "").collect(), key=lambda x: x.sequence)
    ids = np.frombuffer(b"".join(x.payload for x in got), "<u2").tolist()
    while ids[-1] == O.PAD_ID:
        ids.pop()
    docs, own = [], []
    for i in ids:
        if i == O.END_ID:
            docs.append(own)
            own = []
        else:
            own.append(i)
    decode = bpe.encoder(bpe.default_path()).decode
    assert Counter(decode(d) for d in docs) == Counter((t or "").encode() for _, t in texts)
    assert list(O.read_slots(folders[0], 0, len(got), 2 * O.LENGTH)) == [bytes(x.payload) for x in sorted(got, key=lambda x: x.slot)]


def test_order_and_slots_match_brute_force(spark):
    r = random.Random(3)
    rows = [(r.choice([None, *range(40)]), "x" * r.choice([0, 3, 60, 700])) for _ in range(120)] + [(7, "copy")] * 300
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4).select("doc_id", O.byte_tokens(F.col("text")).alias("tokens"))
    hashed = docs.select(F.col("doc_id").cast("long").alias("d"), F.concat("tokens", F.lit(bytes([O.END]))).alias("t")).select("d", "t", F.xxhash64("d", "t").alias("h")).collect()
    stream, owner = b"", []
    for x in sorted(hashed, key=lambda x: x.h):
        stream += bytes(x.t)
        owner += [x.d] * len(x.t)
    n = -(-len(stream) // 64)
    slots = O.permuted(np.arange(n), n, 11)
    want = {}
    for k in range(n):
        own = owner[64 * k : 64 * k + 64]
        want[int(slots[k])] = (k, stream[64 * k : 64 * k + 64].ljust(64, bytes([O.PAD])), [d for i, d in enumerate(own) if i == 0 or stream[64 * k + i - 1] == O.END])
    got = {x.slot: (x.sequence, bytes(x.payload), list(x.doc_ids)) for x in O.sequences(docs, length=64, shard=8, key=11).collect()}
    assert got == want


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        O.sequences(spark.createDataFrame([("a", bytearray(b"x"))], "doc_id string, tokens binary"))


def test_tokens_are_shuffled_once_and_small(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["the", "license", "code", "token"]) for _ in range(r.choice([0, 5, 900])))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).select("doc_id", O.byte_tokens(F.col("text")).alias("tokens"))
    plan = O.sequences(docs, length=256, shard=16)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    pieces = O.dealt(docs, length=256, shard=16).pieces.select(F.sum("size").alias("size"), F.sum(F.octet_length("piece")).alias("sent")).first()
    assert pieces.size % 256 == 0 and pieces.sent < 0.7 * pieces.size


def test_tasks_get_as_many_shards(spark):
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.lit(bytearray(b"x" * 63)).alias("tokens"))
    found = O.dealt(docs, length=64, shard=1).pieces.select(F.spark_partition_id().alias("task"), "slot").distinct().groupBy("task").count().collect()
    assert sum(r["count"] for r in found) == 64 and {r["count"] for r in found} == {8}
