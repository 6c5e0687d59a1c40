"""Byte-level BPE by dynamic programming over prefixes.

Two tokens are compatible if merging their joined bytes gives back just these two. A sequence is what
BPE makes of its bytes exactly if all its neighbours are compatible, so every byte prefix of a piece
has one valid last token: the one that ends there and is compatible with the last token of what is
before it. Storing this token for each prefix makes appends exact, and an edit needs new rows only
until they agree with the old ones for the length of the longest token.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlake.llm.shared import table, unused, without

#: Entries of a worker's caches of pieces and of token pairs; a full cache is emptied.
PIECES, PAIRS = 250_000, 250_000
#: Bytes of text that are handled together, or one longer text.
CHARS = 2_000_000


class PrefixBPE:
    """Encodes pieces by ranks: bytes of each token and its id, which is also its merge's rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.sizes, self.names = {i: len(b) for b, i in ranks.items()}, {i: str(i) for i in ranks.values()}
        #: lengths of the tokens that end in the same three bytes, the longest first, and of those that may end anywhere
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                ends.setdefault(token[-3:], {1, 2}).add(len(token))
        self.lengths = {end: tuple(sorted(own, reverse=True)) for end, own in ends.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[tuple[int, ...], str]] = {}

    def merged(self, piece: bytes, below: float = math.inf) -> list[bytes]:
        """BPE as defined: the leftmost pair of the lowest rank is merged, again and again, while ranks are under `below`."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            rank, at = min(((r, i) for i, r in enumerate(ranks) if r is not None), default=(math.inf, 0))
            if rank >= below:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = self.ranks.get(parts[at - 1] + parts[at])
            if at < len(ranks):
                ranks[at] = self.ranks.get(parts[at] + parts[at + 1])

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte and for what no merge reaches."""
        if token not in self.parts:
            parts = self.merged(self.bytes[token], token)
            self.parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.parts[token]

    def stands(self, token: int) -> bool:
        """Whether the token's bytes alone become this token."""
        return len(self.bytes[token]) == 1 or self.split(token) is not None

    def spine(self, token: int, side: int) -> list[tuple[bytes, int, float]]:
        """The tokens that stand at one edge (side 0: left) while this one is built: bytes, rank that makes it, rank that uses it up."""
        found = self.spines[side].get(token)
        if found is None:
            found, used, at = [], math.inf, token
            while True:
                parts = self.split(at)
                found.append((self.bytes[at], at if parts else -1, used))
                if not parts:
                    break
                used, at = at, parts[side]
            self.spines[side][token] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge across the border comes before both of its sides are used up."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        ranks = self.ranks
        for left, made, used in self.spine(a, 1):
            for right, made2, used2 in self.spine(b, 0):
                rank = ranks.get(left + right)
                if rank is None:
                    continue
                if rank <= made or rank <= made2:  # ranks out of the order of making
                    return self.merged(self.bytes[a] + self.bytes[b]) == [self.bytes[a], self.bytes[b]]
                if rank < used and rank <= used2:  # of equal ranks the left pair goes first
                    return False
        return True

    def grow(self, last: list[int], piece: bytes, until: int | None = None) -> None:
        """Adds to `last`, the last tokens of the first prefixes of piece, those of the longer ones."""
        token_of, known, lengths, add = self.ranks.get, self.pairs.get, self.lengths.get, last.append
        for end in range(len(last) + 1, (len(piece) if until is None else until) + 1):
            for length in lengths(piece[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                if length >= end:
                    if length == end and (token := token_of(piece[:end])) is not None and self.stands(token):
                        add(token)
                        break
                    continue
                token = token_of(piece[end - length : end])
                if token is not None:
                    key = last[end - length - 1] << 32 | token
                    fits = known(key)
                    if fits or fits is None and self.compatible(last[end - length - 1], token):
                        add(token)
                        break
            else:
                raise ValueError("the ranks lack a byte of the text")

    def walk(self, last: list[int]) -> tuple[int, ...]:
        """The whole piece's tokens, from the end back."""
        out, at, size = [], len(last), self.sizes
        while at:
            token = last[at - 1]
            out.append(token)
            at -= size[token]
        return tuple(out[::-1])

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if (token := self.ranks.get(piece)) is not None and self.stands(token):
            return (token,)
        last: list[int] = []
        self.grow(last, piece)
        return self.walk(last)

    def learn(self, pieces: set[str]) -> None:
        """Puts pieces into the cache. In order, a piece starts from the rows of the prefix it shares with the one before."""
        if len(self.pieces) >= PIECES:
            self.pieces.clear()
        before, last, name = b"", [], self.names.__getitem__
        for piece in sorted(p.encode() for p in pieces - self.pieces.keys()):
            shared = 0
            for x, y in zip(before, piece, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared:]
            self.grow(last, piece)
            ids = self.walk(last)
            self.pieces[piece.decode()] = (ids, " ".join(map(name, ids)))
            before = piece

    def decode(self, ids: Iterator[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class PrefixTable:
    """One piece with the last token of each of its prefixes, for appends and edits."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, piece, []
        bpe.grow(self.last, piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.bpe.grow(self.last, self.piece)

    def replace(self, begin: int, end: int, by: bytes) -> int:
        """Puts `by` in place of piece[begin:end]; returns how many prefixes were computed anew."""
        old, shift = self.last, len(by) - (end - begin)
        self.piece = self.piece[:begin] + by + self.piece[end:]
        self.last, same, at = old[:begin], 0, begin
        while at < len(self.piece):
            self.bpe.grow(self.last, self.piece, at + 1)
            at += 1
            past = at - (begin + len(by))  # bytes of the unchanged rest so far
            same = same + 1 if past > 0 and self.last[-1] == old[at - shift - 1] else 0
            if same >= self.bpe.longest:  # the next rows depend on these only
                self.last += old[at - shift :]
                break
        return at - begin

    def ids(self) -> tuple[int, ...]:
        return self.bpe.walk(self.last)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_ENCODERS: dict[str, PrefixBPE] = {}


def encoder(path: str, ranks=None) -> PrefixBPE:
    """One encoder for each worker process and tokenizer, which keeps its caches between batches and tasks. ranks: the broadcast of sent_ranks(); without it the file is read."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PrefixBPE(load_ranks(path) if ranks is None else ranks.value)
    return _ENCODERS[path]


def sent_ranks(spark: SparkSession, path: str):
    """The ranks of a file that the driver reads, broadcast: as many as the tokenizer has."""
    return spark.sparkContext.broadcast(load_ranks(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _mapped(docs: DataFrame, text: str, path: str | None, pattern: str | None, fields: list[T.StructField], one) -> DataFrame:
    """docs without its text and with `fields`, which one(bpe, pieces) gives; columns of their names are replaced."""
    docs = without(docs, [f.name for f in fields], text)
    path, pattern = path or default_path(), pattern or default_pattern()
    place = docs.columns.index(text)
    ranks = sent_ranks(docs.sparkSession, path)
    names = [unused(docs, f"_new_{f.name}") for f in fields]
    schema = T.StructType([*docs.drop(text).schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        bpe, split = encoder(path, ranks), regex.compile(pattern).findall
        kinds = [{"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}.get(f.dataType.simpleString(), pa.list_(pa.int32())) for f in fields]
        for batch in batches:
            texts = batch.column(place)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
            begin = 0
            while begin < batch.num_rows:  # a few million characters at a time
                end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin : begin + 1024]), CHARS, side="right")))
                part = batch.slice(begin, end - begin)
                cut = [split(x or "") for x in part.column(place).to_pylist()]
                bpe.learn(set().union(*cut))
                rows = [one(bpe, pieces) for pieces in cut]
                new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                rest = [(n, part.column(i)) for i, n in enumerate(part.schema.names) if i != place]
                yield pa.RecordBatch.from_arrays([*(c for _, c in rest), *new], names=[*(n for n, _ in rest), *names])
                begin = end

    return docs.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, (f.name for f in fields), strict=True)))


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with its text replaced by n_tokens (long) and ids (array<int>).

    Null and empty texts give no ids. Rows are independent: repeated ones repeat, other columns stay.
    Memory follows one text and the caches, whose sizes are fixed.
    """

    def one(bpe: PrefixBPE, pieces: list[str]) -> tuple:
        ids = [i for p in pieces for i in bpe.pieces[p][0]]
        return len(ids), ids

    return _mapped(docs, text, path, pattern, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))], one)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """rows with ids replaced by text_bytes (binary): the ids' bytes, joined. Null ids give null."""
    path = path or default_path()
    ranks = sent_ranks(rows.sparkSession, path)

    @F.pandas_udf("binary")
    def joined(column):
        bpe = encoder(path, ranks)
        return column.map(lambda x: None if x is None else bpe.decode(x))

    return rows.withColumn("text_bytes", joined(F.col(ids))).drop(ids)


def digests(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with its text replaced by n_tokens, ids_sha256 and decoded_sha256; the ids are decoded again for the last."""

    def one(bpe: PrefixBPE, pieces: list[str]) -> tuple:
        found = list(map(bpe.pieces.__getitem__, pieces))
        ids = [i for f in found for i in f[0]]
        return len(ids), sha256(" ".join(f[1] for f in found).encode()).hexdigest(), sha256(bpe.decode(ids)).hexdigest()

    return _mapped(docs, text, path, pattern, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
