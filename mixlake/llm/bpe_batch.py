"""Byte-level BPE of a whole batch of texts at once, in numpy.

The batch's UTF-8 bytes are cut into pieces by the classes of their characters, which is what PATTERN does; each
distinct piece is merged once. All pieces with as many parts take their next merge, the leftmost of the lowest rank,
together: they are a matrix, which loses a column. Nothing is kept between batches, so memory follows one batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from mixlake.llm.bpe import PrefixBPE, default_path, default_pattern, sent_ranks
from mixlake.llm.shared import unused, without

#: The pattern that cuts() follows; others aren't taken.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Bytes of text that are handled together; pieces of more bytes than LONG go one by one.
BYTES, LONG = 2_000_000, 64
#: Where a long text may be cut: no piece goes on from what isn't a space to a space, and none looks back.
BORDER = re.compile(rb"[0-9A-Za-z](?=\x20)")
NONE = np.iinfo(np.int32).max


def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    known, points = np.full(0x110000, OTHER, np.uint8), [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            known[points[run.start()] : points[run.end() - 1] + 1] = kind
    known[0xD800:0xE000] = OTHER
    return known


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters of valid UTF-8 begin, and their code points."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    points = lead.astype(np.int32)
    for least, most, bits, more in ((0xC0, 0xDF, 0x1F, 1), (0xE0, 0xEF, 0x0F, 2), (0xF0, 0xFF, 0x07, 3)):
        if (own := np.flatnonzero((lead >= least) & (lead <= most))).size:
            value = points[own] & bits
            for k in range(1, more + 1):
                value = value << 6 | data[at[own] + k] & 0x3F
            points[own] = value
    return at, points


def cuts(data: np.ndarray, begins: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where PATTERN's matches begin in texts laid end to end, which begin at `begins`; known: classes()."""
    at, points = code_points(data)
    n, kind = len(at), known[points]
    first = np.zeros(n + 1, bool)  # of a text; the end counts as one
    first[np.searchsorted(at, begins)] = True
    first[0] = first[n] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    begin, end = (runs := np.flatnonzero(run))[:-1], runs[1:]
    blank = end[(kind[begin] == SPACE) & ~first[end]]  # where what follows a run of spaces begins
    start[blank - 1] = True
    start[blank[points[blank - 1] == 0x20]] = False  # a space goes with what follows
    mark = begin[(end - begin == 1) & (points[begin] == 0x27) & start[begin] & ~first[end]]
    a, b = points[mark + 1], points[np.minimum(mark + 2, n - 1)]
    pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 2, np.where(pair & ~first[mark + 2], 3, 0))
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    start[(rest := mark + size)[rest < n]] = True
    return at[start]


class BatchBPE:
    """Encodes many pieces by ranks: bytes of each token and its id, which is also its merge's rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.known, self.single = ranks, classes(), None
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.base = max(ranks.values(), default=0) + 1
        found = [(ranks[a] * self.base + ranks[b], i) for token, i in ranks.items() for k in range(1, len(token)) if (a := token[:k]) in ranks and (b := token[k:]) in ranks]
        keys, values = np.array([k for k, _ in found], np.int64), np.array([v for _, v in found], np.int32)
        self.bits = max(8, 2 + int(len(found)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE without one."""
        keys = a.astype(np.int64) * self.base + b
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], NONE)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while left.size:
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out

    def merge(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces' tokens: all ids, and each piece's first place and number among them."""
        first, count, out, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [], 0

        def emit(who: np.ndarray, parts: np.ndarray) -> None:
            nonlocal total
            first[who], count[who] = total + np.arange(len(who)) * parts.shape[1], parts.shape[1]
            out.append(parts.ravel())
            total += parts.size

        for k in np.flatnonzero(sizes > LONG):
            self.single = self.single or PrefixBPE(self.ranks)
            emit(np.array([k]), np.array([self.single.encode_piece(data[begins[k] : begins[k] + sizes[k]].tobytes())], np.int32))
        order = np.argsort(np.where(sizes > LONG, 0, sizes), kind="stable")
        edge = np.searchsorted(np.where(sizes > LONG, 0, sizes)[order], np.arange(LONG + 2))
        who, parts, ranks = np.zeros(0, np.int64), np.zeros((0, LONG), np.int32), np.zeros((0, LONG - 1), np.int32)
        for n in range(LONG, 0, -1):
            if (new := order[edge[n] : edge[n + 1]]).size:
                own = self.byte[data[begins[new][:, None] + np.arange(n)]]
                if (own < 0).any():
                    raise ValueError("the ranks lack a byte of the text")
                fresh = self.rank(own[:, :-1].ravel(), own[:, 1:].ravel()).reshape(len(new), n - 1)
                who, parts, ranks = np.concatenate([who, new]), np.concatenate([parts, own]), np.concatenate([ranks, fresh])
            if n == 1:
                emit(who, parts)
                break
            if not len(who):
                parts, ranks = np.zeros((0, n - 1), np.int32), np.zeros((0, n - 2), np.int32)
                continue
            at = ranks.argmin(1)
            best = ranks[np.arange(len(who)), at]
            if not (on := best < NONE).all():
                emit(who[~on], parts[~on])
                who, parts, ranks, at, best = who[on], parts[on], ranks[on], at[on], best[on]
            row = np.arange(len(who))
            parts[row, at] = best
            keep = np.ones(parts.shape, bool)
            keep[row, at + 1] = False
            parts = parts[keep].reshape(len(who), n - 1)
            keep = np.ones(ranks.shape, bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(len(who), n - 2)
            r = np.flatnonzero(at > 0)
            ranks[r, at[r] - 1] = self.rank(parts[r, at[r] - 1], parts[r, at[r]])
            r = np.flatnonzero(at < n - 2)
            ranks[r, at[r]] = self.rank(parts[r, at[r]], parts[r, at[r] + 1])
        return np.concatenate(out) if out else np.zeros(0, np.int32), first, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's begin, the end included; nulls have none."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        texts.validate(full=True)  # what isn't UTF-8 raises
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        begins = cuts(data, bounds[:-1], self.known)
        offsets = np.append(begins, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which, own = pieces.indices.to_numpy(), pieces.dictionary
        edges = np.frombuffer(own.buffers()[1], np.int64)[: len(own) + 1]
        ids, first, count = self.merge(np.frombuffer(own.buffers()[2], np.uint8), edges[:-1], np.diff(edges))
        many = count[which]
        upto = np.append(0, np.cumsum(many))
        every = ids[np.repeat(first[which] - upto[:-1], many) + np.arange(upto[-1])]
        return every, upto[np.searchsorted(begins, bounds)]

    def encode_long(self, text: pa.StringScalar) -> tuple[np.ndarray, np.ndarray]:
        """encode() for one text, cut at borders, so that memory follows the cuts and the ids."""
        data, begin, out = memoryview(text.as_buffer()), 0, []
        while begin < len(data):
            found = BORDER.search(data, begin + BYTES)
            end = found.end() if found else len(data)
            out.append(self.encode(pa.array([bytes(data[begin:end])], pa.binary()).cast(pa.string()))[0])
            begin = end
        ids = np.concatenate(out)
        return ids, np.array([0, len(ids)])


_ENCODERS: dict[str, BatchBPE] = {}


def packed(docs: DataFrame, text: str = "text", name: str = "tokens", width: int = 2, path: str | None = None) -> DataFrame:
    """docs with its text replaced by `name`: the ids that bpe.encode() gives, as little-endian binary of `width` (2 or 4) bytes each.

    Null and empty texts give empty binaries. Rows are independent: repeated ones repeat, other columns stay.
    """
    if default_pattern() != PATTERN:
        raise ValueError("cuts() follows another pattern")
    docs = without(docs, [name], text)
    path, place, new = path or default_path(), docs.columns.index(text), unused(docs, "_new")
    ranks = sent_ranks(docs.sparkSession, path)
    if max(ranks.value.values(), default=0) >= 1 << 8 * width:
        raise ValueError(f"ids don't fit {width} bytes")
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[path] = BatchBPE(ranks.value)
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + BYTES, side="right")))
                part = batch.slice(begin, end - begin)
                texts = part.column(place)
                long = end == begin + 1 and texts[0].is_valid and len(texts[0].as_buffer()) > BYTES
                ids, edges = _ENCODERS[path].encode_long(texts[0]) if long else _ENCODERS[path].encode(texts)
                tokens = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(edges * width), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                rest = [(n, part.column(i)) for i, n in enumerate(part.schema.names) if i != place]
                yield pa.RecordBatch.from_arrays([*(c for _, c in rest), tokens], names=[*(n for n, _ in rest), new])
                begin = end

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop(text).schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, f"`{new}` binary"])).withColumnRenamed(new, name)
