import random
import re
import textwrap
from collections import Counter

from mixlake.llm import licenses as L

W = re.compile(L.WORD)


def slow(i, text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, places = W.findall(text), []
    for phrase, label in L.PHRASES.items():
        parts = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(parts)] == parts]
    score, labels = float(bool(places)), {x for _, x in places}
    for line in text.split("\n"):
        own = set(W.findall(line))
        for _, label, tokens in L.template_tokens():
            share = len(own & set(tokens)) / len(tokens)
            if share >= L.CONTAINMENT:
                labels.add(label)
                score = max(score, share)
    starts = [k for k, _ in places]
    return i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), round(score, 12)


def test_matches_brute_force(spark):
    r, rows = random.Random(2), []
    for i, (_, t) in enumerate(L.TEMPLATES):
        for k in range(8):
            words = t.split()
            r.shuffle(words)
            words = words[: max(1, len(words) - k * len(words) // 20)] + ["foo é漢"] * r.randint(0, 3)
            rows.append((i * 10 + k, "bla\n" + " ".join(words) + "\nThe under the MIT license, under the mit License" * (k % 2), "x"))
    rows += [(900 + i, " ".join(r.choice(["the", "license", "of", "software", "mit", "x1", "É"]) for _ in range(30)), "x") for i in range(40)]
    rows += [(None, None, "x"), (1, "", "x"), (None, "Released under the MIT License\n", "x"), (None, "Released under the MIT License\n", "x"), (5, "\n\n ", "x"), (6, "apache license version 2 apache license version 2 cc BY nc", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(4)
    table, L.table = L.table, lambda *a: docs
    try:
        got = L.query(spark, "").collect()
        assert Counter((*x[:7], round(x[7], 12)) for x in map(tuple, got)) == Counter(slow(i, t) for i, t, _ in rows)
        assert L.scan(docs.limit(0)).count() == 0
    finally:
        L.table = table


def test_wrapped_notices(spark):
    texts = {}
    for i, (_, t) in enumerate(L.TEMPLATES):
        for k, (mark, width) in enumerate([("", 72), (" * ", 40), ("# ", 70), ("// ", 24)]):
            texts[i * 10 + k] = "code here\n\n" + "\n".join(mark + x for x in textwrap.wrap(t, width)) + "\n" + mark.rstrip() + "\nmore code"
    scattered = sorted(set(re.findall("[a-z]+", L.TEMPLATES[1][1].lower())))
    texts[900] = "\n".join(" ".join(scattered[k : k + 4]) for k in range(0, len(scattered), 4))  # the words, but no notice
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: {(x.label, x.share) for x in r.found} for r in L.scan(docs).collect()}
    assert got.pop(900) == set() and len(got) == 40
    assert all((L.TEMPLATES[i // 10][0], 1.0) in found for i, found in got.items())


def test_lines_of_other_licenses_have_no_wrong_label(spark):
    lines = ["Licensed under CC BY 4.0", "Licensed under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2", "Released under the BSD License", "Licensed under the Apache License, Version 1.1"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: r.found for r in L.scan(docs).collect()} == {i: [] for i in range(len(lines))}


def test_paragraphs_match_brute_force(spark):
    """Every notice of which any few words are replaced, wherever its lines break, as long as enough words are left; and no text that lacks them."""
    r, texts, want = random.Random(6), [], []
    for _, (label, t) in enumerate(L.TEMPLATES):
        words = L._cut(t)
        own = sorted(set(words))
        need = L._need(own, L.CONTAINMENT)
        often = sorted(own, key=lambda w: -words.count(w))
        for k in range(12):
            lost = set(often[: min(k, len(own) - need + 1)] if k % 2 else r.sample(own, min(k, len(own) - need + 1)))
            left = [f"zz{r.randrange(9)}" if w in lost else w for w in words]
            lines = [" ".join(left[i : i + 4]) for i in range(0, len(left), 4)]
            texts.append("\n".join(lines))
            blocks = [set(left)] + [set(x.split()) for x in lines]
            want.append({x for x, _, v in ((lab, n, set(v)) for n, lab, v in L.template_tokens()) if any(len(b & v) / len(v) >= L.CONTAINMENT for b in blocks) and x == label})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: {f.label for f in x.found} for x in L.scan(docs).collect()}
    for i, labels in enumerate(want):
        assert labels <= got[i], texts[i]
        assert (L.TEMPLATES[i // 12][0] in got[i]) == bool(labels), texts[i]
