import random
from math import comb

import pytest

from mixlake.llm import quality


def slow_counts(text):
    text = text or ""
    white = " \t\n\x0b\x0c\r"
    words, now = [], ""
    for c in text + " ":
        if c in white:
            words += [now] * bool(now)
            now = ""
        else:
            now += c
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(white):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", " \n\t ", "a b c a b c a", "x\nx\n\nx \n x", "é漢 ## $a|b <c> &\x85\xa0 d", "a a a a", "one two\x0bthree\x1cfour"])
def test_counts(text):
    assert quality.text_counts(text)[:5] == slow_counts(text)


def test_random_counts():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("ab \n#é") for _ in range(r.randint(0, 60)))
        assert quality.text_counts(text)[:5] == slow_counts(text)


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, 0.1), (40, 3, 0.05), (500, 2, 0.01)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert quality.binomial_tail(5, 5, 0.1) == 1 and quality.binomial_tail(0, 0, 0.1) == 1


def test_fixed_sequence_stops_at_the_first_failure():
    assert quality.choose_cutoff([0, 0, 90, 0], 2000, 0.01, 0.001) == 2
    assert quality.choose_cutoff([0], 100, 0.01, 0.001) == 0  # too few labels for a guarantee


def _docs(spark, n=3000):
    clean = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"word{i}$$$" for i in range(60))
    rows = [(i, f"{clean} {i}" if i % 10 else f"{junk} {i}", "en" if i % 3 else "de") for i in range(n)]
    rows += [(n, None, "en"), (n + 1, "", None), (None, clean, "fr"), (n + 2, "too short", "en"), (n + 3, junk, "rare"), (5, f"{clean} 5", "en")]
    labels = [(i, int(i % 10 > 0), 0) for i in range(n)] + [(n + 3, 0, 0), (None, 1, 0), (7, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_Counts2", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_junk_goes_and_clean_documents_stay(spark):
    docs, labels = _docs(spark)
    got = {(r.doc_id, r.n_words): r for r in quality.judge(docs, labels).collect()}
    assert all(r.kept == (r.doc_id % 10 > 0) for (i, _), r in got.items() if i is not None and i < 3000)
    assert not got[(3000, 0)].kept and got[(3000, 0)].base_failed and not got[(3001, 0)].kept and got[(None, 60)].kept and not got[(3002, 2)].kept
    assert got[(3003, 60)].kept  # its language has no labels for a guarantee
    assert quality.judge(docs, labels).count() == docs.count()


def test_without_labels_only_the_base_decides_and_empty_tables_are_empty(spark):
    docs, labels = _docs(spark, 30)
    got = quality.judge(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in got)
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
