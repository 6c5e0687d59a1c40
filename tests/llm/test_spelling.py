import random
import re
import zlib
from collections import Counter

from mixlake.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near(a, b):
    """Whether one insertion, deletion or replacement makes a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, shortest=7, fewest=2, times=10):
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(str.maketrans(UP, LOW))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= fewest}
    out = {}
    for w, k in n.items():
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v)) if others else None
        out[w] = (k, len(others), best if best and n[best] >= times * k else None)
    rows = set()
    for w, (k, m, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.add((w, form, root, k, m, n[form] if form else None))
    return rows


def run(spark, docs):
    df = spark.createDataFrame([(t, i, "x", 3) for i, t in docs], "text string, doc_id long, word string, N int").repartition(3)
    got = [tuple(r) for r in S.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force(spark):
    r = random.Random(5)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa", "straßen÷weg"]
    words = []
    for s in stems:
        words += [s] * r.choice([3, 20, 150])
        for _ in range(8):
            p = r.randrange(len(s))
            words += [s[:p] + r.choice(["", "x", s[p] * 2, "ñ"]) + s[p + 1 :]] * r.choice([1, 2, 3])
    r.shuffle(words)
    docs = [(k, " ".join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in words[k::60]) + ".") for k in range(60)]
    want = brute(docs)
    assert run(spark, docs) == want
    assert sum(f is not None for _, f, *_ in want) > 20


def test_chains_of_forms(spark):
    words = ["abcdefgh"] * 2 + ["abcdefgx"] * 30 + ["abcdefyx"] * 400 + ["abcdzfyx"] * 5000
    docs = [(k, w) for k, w in enumerate(words) if zlib.crc32(f"{k}:{w}".encode()) % 31]
    want = brute(docs)
    assert run(spark, docs) == want
    assert {root for w, _, root, *_ in want} == {"abcdzfyx"}


def test_long_runs(spark):
    a = "".join(random.Random(1).choice("abcd") for _ in range(64))
    long = "".join(random.Random(2).choice("abcd") for _ in range(30_000))
    same = "q" * 20_000
    words = [a, a[:30] + a[31:], a + "b", a + "bb", a[:9] + "z" + a[10:], "y" + a[1:] + "b", long, long[:700] + "z" + long[701:], long[1:], same, same + "q"]
    docs = [(k, w) for k in range(40) for w in words]
    got = run(spark, docs)
    assert got == brute(docs) and {w for w, *_ in got} >= set(words)
    assert next(m for w, _, _, _, m, _ in got if w == long) >= 2


def test_edges(spark):
    assert run(spark, []) == set()
    docs = [(None, "letters letters"), (1, None), (2, ""), (3, "short ab"), (4, "letters1letters letterz"), (4, "letters1letters letterz"), (5, "\U0001f600lettreś ××××××× " * 3)]
    assert run(spark, docs) == brute(docs)
