"""Quality rules whose cutoffs come with a guarantee on false rejections.

A rule rejects a text whose feature exceeds a cutoff. In each stratum (language), labelled good
documents are a holdout. All rules go down their fixed ladders of cutoffs together, from the loosest on; a
step passes while the exact binomial probability of seeing so few good documents rejected by any rule, were the rate
RISK, is at most CONFIDENCE / strata. Testing in this fixed order, with that correction over
strata, bounds by CONFIDENCE the chance that in any stratum the rules together reject more than RISK of the
good documents. A stratum with too few labels gets no cutoff and loses nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlake.llm.shared import materialize, table, unused, without

#: Rate of good documents that all rules together may reject in a stratum, and the chance that any stratum exceeds it.
RISK, CONFIDENCE = 0.01, 0.05
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: A rule's feature, and its ladder of cutoffs from loose to strict. Fixed before any label is seen.
LADDER = [round(0.95 - 0.05 * k, 2) for k in range(19)]
RULES = {"symbols_per_word": LADDER, "capitals_per_letter": LADDER, "repeated_words": LADDER, "duplicate_lines": LADDER, "exclamations_per_word": LADDER}

#: Bytes of `[#*$%&|<>]`.
_SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_exclamations"]


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; null and texts without words give zeros."""
    raw = (text or "").encode()
    words = raw.split()  # splits at space and \t-\r only
    if not words:
        return (0,) * len(COUNTS)
    joined = b"".join(words).decode()
    symbols = sum(map(raw.count, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    capitals = sum(1 for c in joined if c.isupper()) if not joined.islower() else 0
    letters = sum(1 for c in joined if c.isalpha()) if not joined.isalpha() else len(joined)
    return (len(words), len(joined), symbols, len(lines) - len(set(lines)), _repeated(words), len(lines), capitals, letters, raw.count(b"!"))


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, end, total = Counter(windows), 0, 0
    for k, w in enumerate(windows):
        if times[w] > 1:
            total += k + 3 - max(k, end)
            end = k + 3
    return total


def with_counts(docs: DataFrame, text: str = "text", name: str = "_counts", keep: bool = False) -> DataFrame:
    """docs without its text (with it, if keep), with a struct column `name` of COUNTS (longs), which replaces one of that name."""
    docs = without(docs, [name], text)
    place, out = docs.columns.index(text), unused(docs, "_new")
    struct = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*(docs if keep else docs.drop(text)).schema.fields, T.StructField(out, struct)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(x) for k in range(0, batch.num_rows, 256) for x in batch.column(place).slice(k, 256).to_pylist()]
            cols = np.array(rows, np.int64).reshape(-1, len(COUNTS))
            counts = pa.StructArray.from_arrays([pa.array(cols[:, i]) for i in range(len(COUNTS))], names=COUNTS)
            rest = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if keep or i != place]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), counts], names=[*(n for n, _ in rest), out])

    return docs.mapInArrow(run, schema).withColumnRenamed(out, name)


def _features(c: str = "_counts") -> dict[str, F.Column]:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(f"{c}.{a}").cast("double"), F.col(f"{c}.{b}")), F.lit(0.0))
    return {
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "capitals_per_letter": ratio("n_capitals", "n_letters"),
        "repeated_words": ratio("n_repeat_words", "n_words"),
        "duplicate_lines": ratio("n_dup_lines", "n_lines"),
        "exclamations_per_word": ratio("n_exclamations", "n_words"),
    }


def _base_failed(c: str = "_counts") -> F.Column:
    return (F.col(f"{c}.n_words") < MIN_WORDS) | (100 * F.col(f"{c}.n_repeat_words") > MAX_REPEATED_PERCENT * F.col(f"{c}.n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding."""
    if n == 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    lg = np.frompyfunc(math.lgamma, 1, 1)
    logs = math.lgamma(n + 1) - (lg(i + 1.0) + lg(n - i + 1.0)).astype(float) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def choose_cutoff(rejected: list[int], n: int, risk: float, level: float) -> int:
    """The number of cutoffs, from the loosest on, that pass: rejected[i] of n good documents exceed the i-th."""
    for i, k in enumerate(rejected):
        if k > risk * n or binomial_tail(k, n, risk) > level:
            return i
    return len(rejected)


def _stratum(lang: str) -> F.Column:
    """A null language is a stratum of its own, apart from the empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit(""))


def cutoffs(counted: DataFrame, labels: DataFrame, stratum: str = "_stratum", counts: str = "_counts", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(stratum, cut, n_good, n_rejected): cut maps each rule to its cutoff; a stratum without a guarantee has no row.

    counted: doc_id, the stratum and the counts. labels: doc_id, quality; a document counts as good if all
    its labels say 1, else as bad. It counts once, however many rows have its doc_id: in its smallest
    stratum, by its worst values. Of the steps that pass, the one with most bad less good documents
    rejected is taken, the loosest if several are equal: all that pass hold their guarantee, so this
    choice keeps it. Only counts by stratum and step are sent on.
    """
    label = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(F.min("quality").alias("_q"))
    steps, features = len(LADDER), _features(counts)
    # how many steps, counted from the strictest, reject the text by any rule
    rung = F.greatest(*(sum((features[r] > F.lit(c)).cast("int") for c in ladder) for r, ladder in RULES.items()))
    slim = counted.where(~_base_failed(counts)).select("doc_id", F.col(stratum).alias("stratum"), rung.alias("rung"))
    held = slim.join(label, F.col("doc_id") == F.col("_labelled")).groupBy("doc_id").agg(F.min("stratum").alias("stratum"), F.max("rung").alias("rung"), F.min("_q").alias("_q"))
    tally = held.groupBy("stratum", "rung").agg(F.count_if(F.col("_q") == 1).alias("n"), F.count_if(F.col("_q") != 1).alias("n_bad"))
    tally = materialize(tally, "tally")
    level = confidence / max(1, tally.select("stratum").distinct().count())

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        # a text that step i rejects is rejected by all stricter ones too: steps - i of them and itself
        rejected, caught = ([int(pdf.loc[pdf["rung"] >= steps - i, c].sum()) for i in range(steps)] for c in ("n", "n_bad"))
        passed = range(choose_cutoff(rejected, n, risk, level))
        best = max(passed, key=lambda i: (caught[i] - rejected[i], -i), default=None)
        rows = [] if best is None else [(key[0], {r: ladder[best] for r, ladder in RULES.items()}, n, rejected[best])]
        return pd.DataFrame(rows, columns=["stratum", "cut", "n_good", "n_rejected"])

    return tally.groupBy("stratum").applyInPandas(choose, "stratum string, cut map<string,double>, n_good long, n_rejected long")


def _judged(counted: DataFrame, labels: DataFrame, doc_id: str, stratum: str, counts: str, risk: float, confidence: float) -> tuple[DataFrame, F.Column, F.Column]:
    """counted with its stratum's cutoffs, whether the base fails, and the rules exceeded, comma-joined."""
    chosen = cutoffs(counted.select(F.col(doc_id).alias("doc_id"), stratum, counts), labels, stratum, counts, risk, confidence)
    cut = unused(counted, "_cut")
    wide = materialize(chosen.select(F.col("stratum").alias(f"{cut}_of"), F.col("cut").alias(cut)), "cutoffs")
    over = [F.when(value > F.try_element_at(cut, F.lit(rule)), F.lit(rule)) for rule, value in _features(counts).items()]
    return counted.join(wide, F.col(stratum) == F.col(f"{cut}_of"), "left"), _base_failed(counts), F.concat_ws(",", *over)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept and reasons (rules exceeded, comma-joined).

    Nulls: a null text has no words, so it fails the base; a null language is a stratum of its own; a
    null or unlabelled doc_id is judged, but calibrates nothing. Repeated rows are judged each. With no
    labels at all only the base decides. Other columns are left out, whatever their names.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), _stratum(lang).alias("_stratum"), F.col(text).alias("_text"))
    both, failed, reasons = _judged(materialize(with_counts(slim, "_text"), "counts"), labels, "doc_id", "_stratum", "_counts", risk, confidence)
    return both.select("doc_id", "_counts.*", failed.alias("base_failed"), (~failed & (reasons == "")).alias("kept"), reasons.alias("reasons"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """The rows of docs that judge() keeps, each by its own text, also those without doc_id.

    The rows are written once with their counts, as the cutoffs need those of all labelled ones; texts aren't shuffled.
    """
    stratum, counts = unused(docs, "_stratum"), unused(docs, "_counts")
    counted = materialize(with_counts(docs.withColumn(stratum, _stratum(lang)), text, counts, keep=True), "counts")
    both, failed, reasons = _judged(counted, labels, doc_id, stratum, counts, risk, confidence)
    return both.where(~failed & (reasons == "")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")
