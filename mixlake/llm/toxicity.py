"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself (two hashes) and of its first letters. Filters of
several widths slide over the words; each filter's largest response anywhere in the text feeds a
logistic output, so whole texts count, however long. All labelled rows that may be learned from are: they are
dealt into shards, tasks train the model on a shard each, and the shards' changes are averaged, round by round. Every
fifth row is held back to calibrate the score to the true share of toxic rows and to choose a threshold for each
language, from counts of all of them. No label, language, source or id reaches a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlake.llm.shared import discard, materialize, table, unused, without

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 16, 12, (1, 2, 3)
PREFIX = 6
#: Rows and characters of a shard, about; there are as many shards as that takes.
SHARD_ROWS, SHARD_CHARS = 4096, 16_000_000
#: Rounds between averages, and epochs of a shard in each, twice as many if there is only one.
ROUNDS, EPOCHS, BATCH, RATE, DECAY = 4, 1, 32, 0.01, 1e-4
#: Bits that mark the labelled ids.
MARKS = 1 << 25
#: Changes are added up in parts of the first, logits counted in parts of the second, up to LOGITS.
ONE, BINS, LOGITS = 1 << 20, 256, 100
THRESHOLD = 0.7
#: Positives that a language needs among the calibration rows for a threshold of its own.
LANGUAGE_ROWS = 20
#: Words that are convolved together, those of one product; words that a worker remembers.
CHUNK, SMALL, CACHE = 1 << 16, 128, 400_000

_WORDS = re.compile(r"\w+").findall
_SHIFTS = sum(WIDTHS)


class _Hashed(dict):
    """word -> its three rows of the embedding table; row 0 is padding."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        h, p = crc32(word.encode()), crc32(b"^" + word[:PREFIX].encode())
        rows = (1 + h % (BUCKETS - 1), 1 + (h * 2654435761 >> 13) % (BUCKETS - 1), 1 + p % (BUCKETS - 1))
        if len(self) < CACHE:
            self[word] = rows
        return rows


_hashed = _Hashed()


def word_rows(text: str | None) -> np.ndarray:
    """(words, 3) rows of the embedding table; null and empty texts have no words."""
    words = _WORDS((text or "").lower())
    return np.array([_hashed[w] for w in words], np.int32).reshape(-1, 3)


@dataclass
class Model:
    table: np.ndarray  # (BUCKETS, DIM)
    taps: np.ndarray  # (DIM, FILTERS * sum of widths): by width, by place in the filter
    bias: np.ndarray  # (FILTERS * widths,)
    out: np.ndarray
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] | None = None

    @classmethod
    def new(cls, seed: int = 0) -> Model:
        """Embeddings start at zero, so a word that training never met says nothing."""
        r = np.random.default_rng(seed)
        width = len(WIDTHS) * FILTERS
        return cls(np.zeros((BUCKETS, DIM), np.float32), r.normal(0, 0.5, (DIM, FILTERS * _SHIFTS)).astype(np.float32), np.full(width, 0.1, np.float32), r.normal(0, 0.3, width).astype(np.float32), 0.0)

    def responses(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The words' vectors, and by width each place's filter responses."""
        x = self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]
        y, at, out = _product(x, self.taps), 0, []
        for w in WIDTHS:
            h = y[: len(y) - w + 1, at : at + FILTERS].copy()
            for k in range(1, w):
                h += y[k : len(y) - w + 1 + k, at + k * FILTERS : at + (k + 1) * FILTERS]
            out.append(h)
            at += w * FILTERS
        return x, out

    def pieces(self, texts: list[np.ndarray]) -> Iterator[tuple[list[tuple[int, int, int, int]], list[np.ndarray]]]:
        """Chunks of the texts' words, padded: their pieces (text, place in it, begin, end) and the filters' responses; a text longer than a chunk continues with the overlap of the widest filter."""
        pad, held, own, size = max(WIDTHS) - 1, [], [], 0
        gap = np.zeros((pad, 3), np.int32)
        for i, rows in enumerate(texts):
            for k in range(0, max(1, len(rows)), CHUNK):
                at = max(0, k - pad)
                part = rows[at : k + CHUNK]
                part = part if len(part) else np.zeros((1, 3), np.int32)
                # no window starts in the padding; where a text goes on, the next part has its last windows
                own.append((i, at, size, size + len(part) - (pad if k + CHUNK < len(rows) else 0)))
                held += [part, gap]
                size += len(part) + pad
                if size >= CHUNK:
                    yield own, self.responses(np.concatenate([*held, gap]))[1]
                    held, own, size = [], [], 0
        if held:
            yield own, self.responses(np.concatenate([*held, gap]))[1]

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        pooled = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for own, by in self.pieces(texts):
            spans = np.array([(begin, end) for _, _, begin, end in own]).ravel()
            best = np.concatenate([np.maximum.reduceat(h, spans, axis=0)[::2] for h in by], axis=1)
            np.maximum.at(pooled, [i for i, *_ in own], best)
        return _leaky(pooled + self.bias) @ self.out + self.shift

    def peaks(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """By text and filter the largest response, and the word at which its window begins."""
        pooled = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        places = np.zeros(pooled.shape, np.int64)
        for own, by in self.pieces(texts):
            for i, at, begin, end in own:
                first = np.concatenate([h[begin:end].argmax(axis=0) for h in by])
                best = np.concatenate([np.take_along_axis(h, first[None, j * FILTERS : (j + 1) * FILTERS] + begin, axis=0)[0] for j, h in enumerate(by)])
                more = best > pooled[i]
                pooled[i, more], places[i, more] = best[more], at + first[more]
        return pooled, places

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.logits(texts).astype(np.float64) + self.scale[1], -30, 30)))


def _product(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """x @ taps by small blocks of rows, for which libraries start no threads: tasks share the cores already."""
    n = len(x) // SMALL * SMALL
    out = np.empty((len(x), taps.shape[1]), np.float32)
    np.matmul(x[:n].reshape(-1, SMALL, x.shape[1]), taps, out=out[:n].reshape(-1, SMALL, taps.shape[1]))
    out[n:] = x[n:] @ taps
    return out


def _leaky(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.1 * x)


def _odds(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By bucket, how much likelier toxic texts have it, as clipped log odds from -1 to 1; 0 for buckets of a single text. seen: texts by class and bucket, n: by class."""
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    return np.where(seen.sum(axis=0) > 1, np.clip(odds, -3, 3) / 3, 0)


class _Adam:
    def __init__(self, like: np.ndarray):
        self.m, self.v, self.t = np.zeros_like(like), np.zeros_like(like), 0

    def step(self, value: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * grad
        self.v[rows] = 0.99 * self.v[rows] + 0.01 * grad * grad
        value[rows] -= RATE * (self.m[rows] / (1 - 0.9**self.t)) / (np.sqrt(self.v[rows] / (1 - 0.99**self.t)) + 1e-6)


def train(model: Model, texts: list[np.ndarray], toxic: np.ndarray, share: float, seed: int = 0, epochs: int = EPOCHS) -> np.ndarray:
    """Adam on the logistic loss, from the model and in it; classes weigh alike where `share` is toxic. Returns the embeddings' rows that changed.

    Only the place of a filter's largest response in a text learns from it.
    """
    r = np.random.default_rng(seed + 1)
    weights = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    adam = {name: _Adam(getattr(model, name)) for name in ("table", "taps", "bias", "out")}
    shift, changed = _Adam(np.zeros(1, np.float32)), np.zeros(BUCKETS, bool)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            pooled, places = model.peaks([texts[i] for i in some])
            pooled += model.bias
            active = _leaky(pooled)
            error = (1 / (1 + np.exp(-np.clip(active @ model.out + model.shift, -30, 30))) - toxic[some]) * weights[some] / len(some)
            back = (error[:, None] * model.out) * np.where(pooled > 0, 1, 0.1)
            taps, at, met, dx = DECAY * model.taps, 0, [], []
            for j, w in enumerate(WIDTHS):
                own = slice(j * FILTERS, (j + 1) * FILTERS)
                g = back[:, own]
                for q in range(w):
                    cols = slice(at + q * FILTERS, at + (q + 1) * FILTERS)
                    rows = np.stack([_words_at(texts[i], p + q) for i, p in zip(some, places[:, own], strict=True)])
                    taps[:, cols] += np.einsum("bfd,bf->df", model.table[rows].sum(axis=2), g)
                    met.append(rows.reshape(-1, 3))
                    dx.append((g[:, :, None] * model.taps[:, cols].T[None]).reshape(-1, DIM))
                at += w * FILTERS
            met = np.concatenate(met).ravel()
            order_met = np.argsort(met, kind="stable")
            touched, first = np.unique(met[order_met], return_index=True)
            grad = np.add.reduceat(np.concatenate(dx)[order_met // 3], first, axis=0).astype(np.float32)
            adam["table"].step(model.table, grad, touched)
            model.table[0] = 0
            changed[touched] = True
            adam["taps"].step(model.taps, taps)
            adam["bias"].step(model.bias, back.sum(axis=0))
            adam["out"].step(model.out, active.T @ error + DECAY * model.out)
            value = np.array([model.shift], np.float32)
            shift.step(value, np.array([error.sum()], np.float32))
            model.shift = float(value[0])
    changed[0] = False
    return np.flatnonzero(changed)


def _words_at(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The embedding rows of the words at these places, of padding beyond the text."""
    inside = places < len(rows)
    out = np.zeros((len(places), 3), np.int64)
    out[inside] = rows[places[inside]]
    return out


def calibrate(model: Model, z: np.ndarray, toxic: np.ndarray, n: np.ndarray, langs: list[str], share: float) -> None:
    """Scales the logits by logistic regression with classes weighted to `share` toxic rows, then sets thresholds by language.

    z, toxic, n and langs: counted rows, n of each logit (in whole parts of 1 / BINS), class and language.
    """
    logit = z / BINS
    positive = n[toxic == 1].sum() / n.sum() if len(n) else 0.0
    if 0 < positive < 1 and 0 < share < 1:
        weight = n * np.where(toxic == 1, share / positive, (1 - share) / (1 - positive))
        target = np.where(toxic == 1, 1 - 1 / (n[toxic == 1].sum() + 2), 1 / (n[toxic == 0].sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
            g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
            hess = np.array([[(h * logit * logit).sum(), (h * logit).sum()], [(h * logit).sum(), h.sum()]]) + 1e-6 * np.eye(2)
            step = np.clip(np.linalg.solve(hess, [(g * logit).sum(), g.sum()]), -1, 1)
            a, b = max(a - step[0], 0.05), b - step[1]
        model.scale = (float(a), float(b))
    model.thresholds = {}
    for lang in sorted(set(langs)):
        own = np.array([x == lang for x in langs])
        cuts, at = np.unique(z[own], return_inverse=True)
        hits, others = (np.bincount(at, n[own] * (toxic[own] == y), len(cuts))[::-1].cumsum()[::-1] for y in (1, 0))
        if hits[0] < LANGUAGE_ROWS:
            continue
        best = cuts[int(np.argmax(2 * hits / (2 * hits + others + hits[0] - hits)))]
        least = (best - 0.5) / BINS  # of the logits that are counted there
        model.thresholds[lang] = float(1 / (1 + np.exp(-np.clip(model.scale[0] * least + model.scale[1], -30, 30))))


def learnable(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels may be learned from; the others are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def labelled(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """(doc_id, toxic, held, lang, words, shard) of all rows that may be learned from, a file for each shard; words: their rows of the embedding table.

    Labels that are null or conflict and null texts are left out; of several rows with one doc_id the smallest text is learned from.
    """
    able = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).where(learnable() & F.col("text").isNotNull())
    n, chars = able.select("doc_id", F.length("text").alias("chars")).join(labels, "doc_id").agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    rows = able.where(_perhaps_among(labels, "doc_id")).join(labels, "doc_id")  # only their texts are shuffled
    shards = max(1, -(-n // SHARD_ROWS), -(-chars // SHARD_CHARS))
    dealt = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "lang", "text", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(shards)).cast("int").alias("shard"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "text", "lang")
    kinds = T.StructType([dealt.schema["doc_id"], *(T.StructField(n, k) for n, k in (("toxic", T.IntegerType()), ("held", T.BooleanType()), ("lang", T.StringType()), ("words", T.BinaryType()), ("shard", T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                ids = b.column(0).to_pylist()
                keep = [i for i, (x, y) in enumerate(zip(ids, [last, *ids], strict=False)) if x != y]
                last = ids[-1]
                b = b.take(pa.array(keep, pa.int64()))
                held = [crc32(f"calibrate {x}".encode()) % 5 == 0 for x in b.column(0).to_pylist()]
                words = [word_rows(x).tobytes() for x in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held, pa.bool_()), b.column(2), pa.array(words, pa.binary()), b.column(4)], names=kinds.names)

    return materialize(dealt.mapInArrow(run, kinds), "labelled", ["shard"], "zstd")


def _perhaps_among(df: DataFrame, key: str) -> F.Column:
    """Whether a row's key may be among those of df: true for all that are, and for few others. Hashes are marked in MARKS bits, whatever their number."""
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(MARKS))
    got = df.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toArrow()
    marks = np.zeros(MARKS // 64, np.int64)
    marks[np.asarray(got.column("at"))] = np.asarray(got.column("bits"))
    sent = df.sparkSession.sparkContext.broadcast(marks)

    @F.arrow_udf("boolean")
    def run(p: pa.Array) -> pa.Array:
        at = np.asarray(p)
        return pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1)

    return run(place)


def _texts(batch: pa.RecordBatch, column: str = "words") -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32).reshape(-1, 3) for x in batch.column(column).to_pylist()]


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows that aren't held back by class and bucket of their words, and by class: tasks count, and send one number for each cell that they have seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)  # bucket 0, of padding, counts the rows
        for b in batches:
            for y, rows in zip(b.column("toxic").to_pylist(), _texts(b), strict=True):
                seen[y, np.unique(np.append(rows, np.int32(0)))] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen.ravel()[at])], names=["cell", "n"])

    got = rows.where("not held").select("toxic", "words").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(2 * BUCKETS)
    seen[np.asarray(got.column("cell"))] = np.asarray(got.column("n"))
    seen = seen.reshape(2, BUCKETS)
    return seen, seen[:, 0].copy()


def _dense(model: Model) -> np.ndarray:
    """All parameters but the embeddings, in rows of DIM numbers."""
    flat = np.concatenate([model.taps.ravel(), model.bias, model.out, [model.shift]])
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)


def _round(rows: DataFrame, model: Model, share: float, seed: int, epochs: int) -> None:
    """Trains every shard from the model and moves it by the mean changes, an embedding by those of the shards that changed it. Changes are whole parts of ONE, so that sums don't depend on their order."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, texts, toxic in _shards(batches):
            old = sent.value
            own = Model(old.table.copy(), old.taps.copy(), old.bias.copy(), old.out.copy(), old.shift)
            changed = train(own, texts, np.array(toxic, np.float32), share, crc32(f"{seed} {shard}".encode()), epochs)
            change = np.concatenate([own.table[changed] - old.table[changed], _dense(own) - _dense(old)])
            whole = np.rint(np.clip(change.astype(np.float64), -1000, 1000) * ONE).astype(np.int32)
            cells = np.concatenate([changed, BUCKETS + np.arange(len(change) - len(changed))])
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *(pa.array(np.ascontiguousarray(whole[:, i])) for i in range(DIM))], names=["cell", *(f"d{i}" for i in range(DIM))])

    kinds = ", ".join(["cell long", *(f"d{i} int" for i in range(DIM))])
    moved = rows.where("not held").select("shard", "toxic", "words").mapInArrow(run, kinds)
    got = moved.groupBy("cell").agg(F.count("*").alias("n"), *(F.sum(f"d{i}").alias(f"d{i}") for i in range(DIM))).toArrow()  # as many rows as the model has
    sent.unpersist()
    cells, n = np.asarray(got.column("cell")), np.asarray(got.column("n"))
    change = np.stack([np.asarray(got.column(f"d{i}")) for i in range(DIM)], axis=1) / ONE / n[:, None]
    words = cells < BUCKETS
    model.table[cells[words]] += change[words].astype(np.float32)
    dense = _dense(model).astype(np.float64)
    dense[cells[~words] - BUCKETS] += change[~words]
    flat, at = dense.ravel(), 0
    for name in ("taps", "bias", "out"):
        old = getattr(model, name)
        setattr(model, name, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
        at += old.size
    model.shift = float(flat[at])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], list[int]]]:
    """Shards one after another: a shard's rows are one file, so they follow one another."""
    now, texts, toxic = None, [], []
    for b in batches:
        for shard, y, rows in zip(b.column("shard").to_pylist(), b.column("toxic").to_pylist(), _texts(b), strict=True):
            if shard != now and texts:
                yield now, texts, toxic
                texts, toxic = [], []
            now = shard
            texts.append(rows)
            toxic.append(y)
    if texts:
        yield now, texts, toxic


def _logit_counts(rows: DataFrame, model: Model) -> pa.Table:
    """(lang, toxic, z, n): how many of the rows that are held back have a logit, in whole parts of 1 / BINS."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = np.rint(np.clip(sent.value.logits(_texts(b)).astype(np.float64), -LOGITS, LOGITS) * BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z)], names=["lang", "toxic", "z"])

    own = rows.where("held").select("lang", "toxic", "words").mapInArrow(run, "lang string, toxic int, z int")
    got = own.groupBy("lang", "toxic", "z").agg(F.count("*").alias("n")).toArrow()
    sent.unpersist()
    return got


def fit(docs: DataFrame, labels: DataFrame, seed: int = 0) -> Model:
    """Learns from all labelled rows that may be learned from; every fifth of them calibrates. Rows stay in tasks: the driver has the model, and counts of its size.

    docs: doc_id, text, lang. Labels that are null, conflict or have no document are left out. Without labels of both
    classes every text scores alike, by the share of toxic rows.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where(learnable() & (F.col("toxic") == F.col("_most"))).select("doc_id", "toxic")
    counts = {int(r.toxic): r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    model, rows = Model.new(seed), labelled(docs, known, seed)
    seen, n = _counted(rows)
    if not n.all():
        model.out[:] = 0
        model.scale = (1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
        model.thresholds = {}
    else:
        # the embeddings' first number starts from the words' odds, so that from the first step on telling words win
        model.table[:, 0] = _odds(seen, n)
        model.table[0] = 0
        epochs = EPOCHS if rows.select("shard").distinct().count() > 1 else 2 * EPOCHS
        for r in range(ROUNDS):
            _round(rows, model, float(n[1] / n.sum()), seed + r, epochs)
        got = _logit_counts(rows, model)
        z, toxic, counted = (np.asarray(got.column(c)).astype(np.int64) for c in ("z", "toxic", "n"))
        calibrate(model, z, toxic, counted, got.column("lang").to_pylist(), share)
    discard(rows)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs without its text and with a score (double, 0 to 1), which replaces a column of its name. Null and empty texts score as texts without words; repeated rows score alike."""
    docs = without(docs, [name], text)
    out, place = unused(docs, "_score"), docs.columns.index(text)
    schema = T.StructType([*docs.drop(text).schema.fields, T.StructField(out, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                values = own.scores([word_rows(x) for x in part.column(place).to_pylist()])
                rest = [(n, part.column(i)) for i, n in enumerate(part.schema.names) if i != place]
                yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(values, pa.float64())], names=[*(n for n, _ in rest), out])

    return docs.mapInArrow(run, schema).withColumnRenamed(out, name)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= THRESHOLD), threshold, flagged.

    threshold is the language's own, THRESHOLD where it has none; flagged compares with it. A null doc_id
    is held out; a null language has no threshold of its own. Other columns are left out, whatever their names.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = fit(slim, labels, **options)
    pairs = [F.lit(x) for kv in (model.thresholds or {}).items() for x in kv]
    own = F.try_element_at(F.create_map(*pairs), F.coalesce(F.col("lang").cast("string"), F.lit(""))) if pairs else F.lit(None)
    out = score(slim, model).withColumn("threshold", F.coalesce(own.cast("double"), F.lit(THRESHOLD)))
    held = F.coalesce(~learnable(), F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
