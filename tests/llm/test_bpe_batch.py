import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from mixlake.llm import bpe
from mixlake.llm import bpe_batch as B
from mixlake.llm import token_output as O


@pytest.fixture(scope="module")
def encoders():
    ranks = bpe.load_ranks(bpe.default_path())
    return B.BatchBPE(ranks), bpe.PrefixBPE(ranks)


def same(encoders, texts):
    batch, one = encoders
    ids, edges = batch.encode(pa.array(texts, pa.string()))
    assert len(edges) == len(texts) + 1 and edges[0] == 0 and edges[-1] == len(ids)
    for text, a, b in zip(texts, edges, edges[1:], strict=False):
        assert ids[a:b].tolist() == [i for p in regex.findall(bpe.default_pattern(), text or "") for i in one.encode_piece(p.encode())], text


def test_batches_equal_single_pieces(encoders):
    r = random.Random(1)
    parts = list("ab stmdrvel'\n\t  é漢1²٣!  \x1c\x1f\x85​﻿😀́ſS'") + ["'s", "'re", "'ll", "  ", " \n ", "don't"]
    for _ in range(60):
        same(encoders, ["".join(r.choice(parts) for _ in range(r.choice([0, 1, 2, 3, 8, 40]))) for _ in range(40)] + [None, ""])


@pytest.mark.parametrize("texts", [[], [None], ["", ""], ["'", "s", "x'", "'l", "l", "'r", "e", " ", "  ", "\n", " \n", "a"], ["ab" * 40, "é" * 32, "é" * 33, "a" * 3000, " " * 200]])
def test_texts_do_not_run_into_each_other(encoders, texts):
    same(encoders, texts)


def test_every_character(encoders):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    sample = points[:0x3000] + points[0x3000::97]
    same(encoders, ["".join(f"{chr(c)}a" for c in sample[k : k + 500]) for k in range(0, len(sample), 500)])


def test_a_sliced_array(encoders):
    texts = pa.array(["left out", "kept é", None, "kept too", "left out"])
    ids, edges = encoders[0].encode(texts.slice(1, 3))
    assert [encoders[1].decode(ids[a:b].tolist()) for a, b in zip(edges, edges[1:], strict=False)] == ["kept é".encode(), b"", b"kept too"]


def test_ranks_that_lack_a_byte():
    with pytest.raises(ValueError):
        B.BatchBPE({b"a": 0, b"b": 1, b"ab": 2}).encode(pa.array(["abc"]))


def test_packed_equals_encode(spark):
    rows = [(i, t) for i, t in enumerate(["the license, the license", None, "", "é漢 code\n\n  " * 70, "don't 123"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = bpe.encode(docs).select("doc_id", O.packed_ids(F.col("ids")).alias("tokens"))
    assert sorted(map(tuple, B.packed(docs).collect())) == sorted(map(tuple, want.collect()))
    assert B.packed(docs, width=4).schema.names == ["doc_id", "tokens"]
    with pytest.raises(ValueError):
        B.packed(docs, width=1)
    assert np.frombuffer(B.packed(docs.where("doc_id = 0"), width=4).first().tokens, "<u4").size == bpe.encode(docs.where("doc_id = 0")).first().n_tokens


def test_long_texts_are_cut(encoders, monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr(B, "BYTES", 50)
    for _ in range(20):
        text = "".join(r.choice(["word", "don't", " ", " ", "  ", "\n", " \n", "é", "1", ".", "' s"]) for _ in range(400))
        assert encoders[0].encode_long(pa.scalar(text))[0].tolist() == encoders[0].encode(pa.array([text]))[0].tolist()


def test_what_is_not_utf8_raises(encoders):
    bad = pa.Array.from_buffers(pa.string(), 1, [None, pa.array([0, 3], pa.int32()).buffers()[1], pa.py_buffer(b"\x80ab")])
    with pytest.raises(pa.ArrowInvalid):
        encoders[0].encode(bad)
