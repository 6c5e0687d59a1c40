import hashlib
import random

import pytest
import tiktoken

from mixlake.llm import bpe as B


@pytest.fixture(scope="module")
def own():
    return B.encoder(B.default_path())


@pytest.fixture(scope="module")
def reference(own):
    return tiktoken.Encoding("own", pat_str=B.default_pattern(), mergeable_ranks=own.ranks, special_tokens={})


def texts():
    r = random.Random(3)
    out = ["".join(r.choice("abcdeéeth 0  \n\t漢🎉'sting<|endoftext|>") for _ in range(r.randint(0, 300))) for _ in range(300)]
    return [None, "", " ", "<|endoftext|>", " " * 3000 + "a" * 2000 + "\n" * 500, "don't we'll I'M", *out]


def test_encodes_like_the_library_and_decodes_back(spark, reference):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(0, "again", 2), (None, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = B.digests(docs.drop("n_tokens")).collect()
    want = sorted(((i, len(ids := reference.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    back = B.decode(B.encode(docs.drop("n_tokens"))).collect()
    assert sorted(bytes(r.text_bytes) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
    assert B.encode(docs.limit(0).drop("n_tokens")).count() == 0


def test_small_caches_give_the_same(own, reference, monkeypatch):
    monkeypatch.setattr(B, "PIECES", 5)
    monkeypatch.setattr(B, "PAIRS", 5)
    import regex

    for t in texts()[5:40]:
        pieces = regex.findall(B.default_pattern(), t)
        own.learn(set(pieces))
        assert [i for p in pieces for i in own.pieces[p][0]] == reference.encode_ordinary(t)


def test_appends_and_edits_are_exact(own):
    r = random.Random(4)
    for _ in range(150):
        text = bytes(r.choice(b"abcdeth ing") for _ in range(r.randint(0, 300)))
        t = B.PrefixTable(own, text)
        i = r.randint(0, len(text))
        j, by = r.randint(i, min(len(text), i + 5)), bytes(r.choice(b"ting") for _ in range(r.randint(0, 4)))
        t.replace(i, j, by)
        text = text[:i] + by + text[j:]
        assert t.last == B.PrefixTable(own, text).last
        t.append(b"thing")
        assert t.ids() == B.PrefixTable(own, text + b"thing").ids()
        assert own.decode(t.ids()) == text + b"thing"
    long = B.PrefixTable(own, b"the thing is here " * 100)
    assert long.replace(3, 4, b"x") < 600  # not the whole piece again
