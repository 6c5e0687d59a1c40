import random

import numpy as np
from pyspark.sql import functions as F

from mixlake.llm import toxicity as X


def corpus(spark):
    r, rows, labels = random.Random(0), [], []
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    bad = {"en": ["awfulone", "awfultwo", "nastyone"], "de": ["schlimmer", "schlimmes", "boeses"]}
    for i in range(900):
        lang, toxic = ("en", "de")[i % 2], i % 4 < 2 and i % 3 == 0
        words = [r.choice(vocabulary) for _ in range(r.choice([20, 200]))]
        for _ in range(4 if toxic else 0):
            words[r.randrange(len(words))] = r.choice(bad[lang])
        rows.append((i, " ".join(words), lang, 1.0))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, "en", 1.0), (901, "", None, 1.0), (None, "awfulone awfultwo", "en", 1.0), (902, " ".join(vocabulary * 300 + ["awfulone", "awfultwo", "nastyone"] * 2 + vocabulary), "en", 1.0), (5, rows[5][1], "en", 1.0)]
    labels += [(None, 1, 1), (903, 1, None), (7, 1, 0), (904, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents(spark, monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 5000)
    docs, labels = corpus(spark)
    got = X.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    hits = [r.predicted == truth[r.doc_id] for r in held]
    assert len(held) > 200 and np.mean(hits) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[902].predicted == 1  # far beyond the first words
    assert by[900].predicted == 0 and by[901].predicted == 0 and by[901].threshold == 0.7 and by[None].held_out
    ids = docs.where("doc_id is not null").select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("h")).collect()
    assert all(by[r.doc_id].held_out == r.h for r in ids)


def test_scores_do_not_depend_on_batches():
    r = np.random.default_rng(0)
    model = X.Model.new()
    model.table[1:] = r.normal(size=(X.BUCKETS - 1, X.DIM)).astype(np.float32)
    texts = [X.word_rows(" ".join(map(str, r.integers(0, 99, n)))) for n in (0, 1, 2, 3, 50, 700)]
    whole, size = model.scores(texts), X.CHUNK
    X.CHUNK = 16
    try:
        assert np.allclose(whole, np.concatenate([model.scores([t]) for t in texts]), atol=1e-5)
    finally:
        X.CHUNK = size


def test_without_labels(spark):
    docs, labels = corpus(spark)
    got = X.classify(docs.limit(20), labels.limit(0)).collect()
    assert len({r.score for r in got}) == 1 and {r.predicted for r in got} == {0}
    assert X.classify(docs.limit(0), labels).count() == 0


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(X, "SHARD_ROWS", 100)
    docs, labels = corpus(spark)
    filler = " ".join(f"quiet{i}" for i in range(3000))  # beyond 20,000 characters
    more = [(2000 + i, f"{filler} vilething {filler}" if i % 2 else filler, "en", 1.0) for i in range(60)]
    more_labels = [(2000 + i, 1, i % 2) for i in range(60)]
    docs, labels = docs.unionByName(spark.createDataFrame(more, docs.schema)), labels.unionByName(spark.createDataFrame(more_labels, labels.schema))
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").where(X.learnable())
    rows = X.labelled(docs, known.select("doc_id", "toxic"), 0)
    want = known.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id").count()
    assert rows.count() == want == rows.select("doc_id").distinct().count() and rows.select("shard").distinct().count() > 3
    seen, n = X._counted(rows)
    assert n.sum() == rows.where("not held").count() and seen[1, X.word_rows("vilething")[0, 0]] >= 10
    model = X.fit(docs, labels)
    again = X.fit(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(model.table, again.table) and model.scale == again.scale and model.thresholds == again.thresholds
    one, other = model.scores([X.word_rows(f"{filler} vilething {filler}"), X.word_rows(filler)])
    assert one > 0.7 > other
