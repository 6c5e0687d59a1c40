"""Spelling variants: words of a corpus that differ by one letter, and the frequent form that a rare one stands for.

Every word emits itself and its distinct single deletions; two words at distance one share exactly one key that
shows it. The key is a hash of the letters left, the place of the deletion goes with it, and the words of a
match are compared letter by letter. Runs of one letter give one deletion, at the first of them.

So that no pair is found twice: words of one length that differ at place p match under the key without p, where
one of them has its own deletion at p, the other at p or at the beginning of the run that holds p; only
the match whose later place is p counts. Words of unlike length share the shorter word itself.

Counting is by words, partial counts before the shuffle. The words under one key differ in one letter that is
added to the key, so their number is bounded by alphabet and length, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlake.llm.shared import discard, lower_ascii, materialize, table

#: Letters of a word, fewest letters and occurrences of one, and how many times as frequent a form is.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, FEWEST, TIMES = 7, 2, 10
#: Of every so many hash values one loses a letter.
LOSES = 31
#: Words up to this length travel with their keys; longer ones are looked up for matches only, as their deletions would add up to its square.
CARRIED = 64
#: Letters of the words that a task hashes at a time, about.
CHUNK = 1_000_000
#: An odd multiplier, its inverse modulo 2^64, and a mixer's constants.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, loses: int = LOSES) -> DataFrame:
    """(word): one row for each run of letters of a text that gives a word of `shortest` letters or more.

    A-Z are lower-cased. Where `loses` divides the crc32 of doc_id:run the run loses one letter, at crc32 modulo its
    length. Null texts have no runs; a null doc_id counts as an empty one.
    """
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{shortest},}}+)"), F.lit(1))).alias("run")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), run).select("d", lower_ascii(F.col("run")).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return rows.select(F.when(F.col("h") % loses == 0, short).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= shortest)


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST, loses: int = LOSES) -> DataFrame:
    """(word, n) of the words that occur `fewest` times or more."""
    return occurrences(docs, doc_id, text, shortest, loses).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def deletions(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, key) of each word of a matrix of code points, words of one length as rows: the word itself at place -1, and its distinct deletions at the first place that gives them."""
    m, length = letters.shape
    with np.errstate(over="ignore"):
        powers = np.full(length, BASE, np.uint64)
        powers[0] = 1
        terms = _mixed(letters.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(powers)
        sums = np.cumsum(terms, axis=1, dtype=np.uint64)
        keys = sums - terms + (sums[:, -1:] - sums) * np.uint64(INVERSE)  # what follows the place moves down by one
    new = np.ones((m, length), bool)
    new[:, 1:] = letters[:, 1:] != letters[:, :-1]
    row, place = np.nonzero(new)
    rows, places = np.concatenate([np.arange(m), row]), np.concatenate([np.full(m, -1), place])
    return rows, places, _mixed(np.concatenate([sums[:, -1], keys[row, place]])).view(np.int64)


def _keys(words: DataFrame, carried: list[str]) -> DataFrame:
    """(key, place, carried...) of every word and its deletions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("word")
            lengths = np.asarray(pc.utf8_length(column))
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                for k in range(0, len(own), step := max(1, CHUNK // int(length))):
                    some = own[k : k + step]
                    text = "".join(column.take(pa.array(some)).to_pylist())
                    row, place, key = deletions(np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(some), -1))
                    for j in range(0, len(row), CHUNK):
                        at = pa.array(some[row[j : j + CHUNK]])
                        yield pa.RecordBatch.from_arrays([pa.array(key[j : j + CHUNK]), pa.array(place[j : j + CHUNK].astype(np.int32)), *(b.column(c).take(at) for c in carried)], names=["key", "place", *carried])

    kinds = dict(words.dtypes)
    return words.mapInArrow(run, ", ".join(["key long", "place int", *(f"{c} {kinds[c]}" for c in carried)]))


def _matched(keys: DataFrame, name: str) -> DataFrame:
    """Candidates (a, b): a has lost a letter; b has too, and comes after a by `name`, or is the key itself."""
    own = F.struct(*(c for c in keys.columns if c != "key"))
    a, b = (keys.select("key", own.alias(side)) for side in "ab")
    return a.where("a.place >= 0").join(b, "key").where(f"b.place < 0 or a.{name} < b.{name}").select("a", "b")


def _at_distance_one(a: Column, b: Column, i: Column, j: Column) -> Column:
    """Whether a without its letter i is b, or a and b differ at the later of the places i and j and nowhere else. Places from 0; j is -1 for b itself."""
    p = F.greatest(i, j)
    without = lambda w, k: F.concat(F.substr(w, F.lit(1), k), F.substr(w, k + 2))
    alike = (F.char_length(a) == F.char_length(b)) & (a != b) & (without(a, p) == without(b, p))
    return F.when(j < 0, without(a, i) == b).otherwise(alike)


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): all pairs of words (word, n, both as they are in the table) at distance exactly one, both ways round.

    words: (id, word, n), each word once, read more than once: a written table.
    """
    length = F.char_length("word")
    short = materialize(_keys(words.where(length <= CARRIED).select("word", "n"), ["word", "n"]), "deletions")
    a, b = F.col("a"), F.col("b")
    pairs = _matched(short, "word").where(_at_distance_one(a["word"], b["word"], a["place"], b["place"])).select("a.word", "a.n", b["word"].alias("other"), b["n"].alias("other_n"))
    long = materialize(_keys(words.where(length >= CARRIED).select("word", "id"), ["id"]), "deletions")
    left, right = (words.where(length >= CARRIED).select(F.col("id").alias(f"{s}_id"), F.col("word").alias(f"{s}_word"), F.col("n").alias(f"{s}_n")) for s in "ab")
    found = _matched(long, "id").select(a["id"].alias("a_id"), b["id"].alias("b_id"), a["place"].alias("i"), b["place"].alias("j")).join(left, "a_id").join(right, "b_id")
    found = found.where((F.char_length("a_word") > CARRIED) | (F.char_length("b_word") > CARRIED)).where(_at_distance_one(F.col("a_word"), F.col("b_word"), F.col("i"), F.col("j")))
    pairs = pairs.unionByName(found.select(F.col("a_word").alias("word"), F.col("a_n").alias("n"), F.col("b_word").alias("other"), F.col("b_n").alias("other_n")))
    both = F.explode(F.array(F.struct("word", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("x")
    return pairs.select(both).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), no null and no word twice: where a word gets by following forms to the last. Forms must not lead back.

    Every round doubles the steps that a row has gone, so rounds are the logarithm of the longest way.
    """
    ways = materialize(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "ways")
        discard(ways)
        went = further.where("went").limit(1).count()
        ways = further
        if not went:
            return ways.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST, times: int = TIMES, loses: int = LOSES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of counted().

    n_near counts the words at distance one; form is the most frequent of them, ties to the smallest, if it occurs
    `times` times as often as the word, else null like form_n; root is the last of the forms from word on, word itself without a form.
    Texts of any length and repeated rows are counted whole; no words give an empty table. Other columns are left out.
    """
    words = materialize(counted(docs, doc_id, text, shortest, fewest, loses).withColumn("id", F.monotonically_increasing_id()), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = words.drop("id").join(near, "word", "left")
    taken = -F.col("best.less") >= times * F.col("n")
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "variants")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")
