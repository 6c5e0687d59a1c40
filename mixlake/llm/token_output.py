"""Training-order materialisation of token ids as fixed-stride shards.

Documents, each followed by END, are laid end to end in the order of a hash and cut into sequences of
equal length. A keyed Feistel permutation over the sequence numbers, walked on until it falls inside
their range, gives each sequence its slot in the training order; slots are dealt out by ranges, and a
range's sequences, back to back, are a shard. Slot s of the run is at byte (s - first slot of shard) *
stride of its shard, so a reader starts anywhere and resumes by its slot alone.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlake.llm.bpe_batch import packed
from mixlake.llm.shared import materialize, shared_dir, table
from mixlake.operators.ordering import running_sums

#: Tokens of a sequence, sequences of a shard, and the key of the order.
LENGTH, SHARD, KEY = 4096, 1024, 20_240_601
#: Byte ids: END and PAD are bytes that UTF-8 never has.
END, PAD = 0xFF, 0xFE
#: Ids after the last of the 50,256 of the tokenizer.
END_ID, PAD_ID = 50_256, 50_257
ROUNDS = 6
#: Documents, or pieces of them, that a task handles at a time.
HELD = 512
#: How the table of documents' tokens is written: in large pages, in which zstd finds more; zstd's level for pieces in the shuffle.
TABLE, SHUFFLED = {"parquet.compression.codec.zstd.level": 9, "parquet.page.size": 4 << 20}, 5
#: Shards that a task writes at most, unless the session's shuffle partitions are enough for fewer.
TASK = 8
#: monotonically_increasing_id() has the number of the task that wrote a row above these bits.
WRITER = 33


def permuted(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The place of each number of range(n) in the order of `key`: a bijection, by Feistel rounds and cycle-walking."""
    half = max(1, math.ceil(math.log2(max(2, n)) / 2))
    mask, keys = np.uint64((1 << half) - 1), np.random.default_rng(key).integers(0, 1 << 63, ROUNDS).astype(np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            with np.errstate(over="ignore"):
                f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(40)) & mask)
        return left << np.uint64(half) | right

    out = once(numbers.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def byte_tokens(text: Column) -> Column:
    """A text's UTF-8 bytes as ids of one byte; null texts have none."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def packed_ids(ids: Column, width: int = 2) -> Column:
    """An array of ids as little-endian binary of `width` bytes each; null arrays are empty."""

    @F.pandas_udf("binary")
    def pack(column):
        return column.map(lambda x: b"" if x is None else np.asarray(x, f"<u{width}").tobytes())

    return pack(ids)


class Dealt(NamedTuple):
    """Pieces of sequences, each shard in one task and in order, and what their sequences are made of."""

    pieces: DataFrame
    pad: bytes
    shard: int


def dealt(docs: DataFrame, tokens: str = "tokens", doc_id: str = "doc_id", end: bytes = bytes([END]), pad: bytes = bytes([PAD]), length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> Dealt:
    """The pieces of sequences(): slot, begin (byte in the sequence), sequence, doc_id, size and piece, which is zstd where that is shorter than size.

    The documents are written once, with numbers, hashes and lengths. Where each begins is a running sum over hashes and lengths, range by range, so
    copies are split like other rows. The places lie in a folder for each task that wrote documents, so whoever reads
    these looks up their places there, and tokens are shuffled only once: cut, to their shards.
    """
    width, stride = len(end), len(end) * length
    kind = docs.schema[doc_id].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{doc_id} must be an integer column")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.concat(F.coalesce(F.col(tokens), F.lit(b"")), F.lit(end)).alias("tokens"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", "tokens").alias("h"), F.octet_length("tokens").cast("long").alias("n"), "doc_id", "tokens")
    rows = materialize(rows, "tokens", codec="zstd", options=TABLE)
    places = running_sums(rows.select("row", "h", "n"), ["h", "row"], {"upto": "n"}).select(F.shiftright("row", WRITER).alias("writer"), "row", (F.col("upto") - F.col("n")).alias("at"))
    folder = materialize(places.repartition("writer").sortWithinPartitions("writer", "row"), "places", partition_by=["writer"])._scratch
    total = rows.agg(F.sum("n")).first()[0] or 0
    n = -(-total // stride)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        files, root = fs.FileSystem.from_uri(folder)
        zstd, now, numbers, begins = pa.Codec("zstd", SHUFFLED), None, None, None
        for batch in (whole.slice(k, HELD) for whole in batches for k in range(0, whole.num_rows, HELD)):
            out: list[tuple] = []
            for row, doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if row >> WRITER != now:
                    now = row >> WRITER
                    found = dataset.dataset(f"{root}/writer={now}", filesystem=files, format="parquet").to_table(columns=["row", "at"]).sort_by("row")
                    numbers, begins = found["row"].to_numpy(), found["at"].to_numpy()
                place = int(np.searchsorted(numbers, row))
                if place == len(numbers) or numbers[place] != row:
                    raise OSError(f"{folder} lacks the place of row {row}")
                at, view, k = int(begins[place]), memoryview(data.as_buffer()), 0
                while k < len(view):
                    room = stride - at % stride
                    piece = view[k : k + room]
                    out.append((at // stride, at % stride, doc, len(piece), squeezed(zstd, piece)))
                    at, k = at + len(piece), k + len(piece)
                    if at == total and at % stride:
                        rest = pad * ((stride - at % stride) // width)
                        out.append((at // stride, at % stride, None, len(rest), rest))
            if out:
                number, begin, doc, size, data = zip(*out, strict=True)
                slot = permuted(np.array(number, np.int64), n, key)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(begin, pa.int32()), pa.array(number, pa.int64()), pa.array(doc, pa.int64()), pa.array(size, pa.int32()), pa.array(data, pa.binary())], names=["slot", "begin", "sequence", "doc_id", "size", "piece"])

    pieces = rows.select("row", "doc_id", "tokens").mapInArrow(cut, "slot long, begin int, sequence long, doc_id long, size int, piece binary")
    shards = -(-n // shard)
    parts = max(1, min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // TASK))))
    even = pieces.repartitionById(parts, F.expr(f"cast(slot div {shard} % {parts} as int)"))
    return Dealt(even.sortWithinPartitions("slot", "begin"), pad, shard)


def squeezed(codec: pa.Codec, piece: memoryview) -> bytes:
    """A piece as zstd, or as it is if that isn't shorter."""
    small = codec.compress(piece, asbytes=True) if len(piece) > 64 else b""
    return small if small and len(small) < len(piece) else bytes(piece)


def joined(batches: Iterator[pa.RecordBatch], pad: bytes, shard: int) -> Iterator[pa.RecordBatch]:
    """The sequences of a task's sorted pieces, a batch for some hundred pieces."""
    slot, number, docs, data, zstd = None, None, [], [], pa.Codec("zstd")

    def done() -> tuple:
        return slot // shard, slot, slot % shard, number, docs, b"".join(data)

    def send(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "slot", "position", "sequence", "doc_ids", "payload"])

    for batch in (whole.slice(k, HELD) for whole in batches for k in range(0, whole.num_rows, HELD)):
        out = []
        for s, m, doc, size, piece in zip(*(batch.column(c).to_pylist() for c in ("slot", "sequence", "doc_id", "size", "piece")), strict=True):
            if s != slot:
                if slot is not None:
                    out.append(done())
                slot, number, docs, data = s, m, [], []
            whole = piece if len(piece) == size else zstd.decompress(piece, size, asbytes=True)
            if whole[: len(pad)] != pad or doc is not None or not docs:
                docs.append(doc)
            data.append(whole)
        if out:
            yield send(out)
    if slot is not None:
        yield send([done()])


def sequences(docs: DataFrame, tokens: str = "tokens", doc_id: str = "doc_id", end: bytes = bytes([END]), pad: bytes = bytes([PAD]), length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """One row per sequence: slot, shard, position in the shard, sequence (its number before the permutation), doc_ids, payload.

    tokens: binary, len(end) bytes per token; doc_id: an integer column, others raise a TypeError. Every payload has length tokens;
    the last sequence is padded. Null tokens count as none, so such documents are END only, as are empty ones. Documents are laid end to end
    in the order of a hash of doc_id and tokens; equal rows follow one another in any order, as they are alike, and are written each; null
    doc_ids are null in doc_ids. Long documents span sequences. An empty table gives no sequence. Other columns are left out.
    """
    pieces, pad, shard = dealt(docs, tokens, doc_id, end, pad, length, shard, key)
    return pieces.mapInArrow(lambda batches: joined(batches, pad, shard), "shard long, slot long, position long, sequence long, doc_ids array<long>, payload binary")


class _Shards:
    """Writes shards one after the other, each under a name of its own until it is whole."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.root, recursive=True)
        self.now, self.name, self.out = None, "", None

    def put(self, shard: int, data: bytes) -> bool:
        """Adds a sequence; whether it is its shard's first."""
        first = shard != self.now
        if first:
            self.close()
            self.now, self.name = shard, f".{uuid.uuid4().hex}"
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}")
        self.out.write(data)
        return first

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.move(f"{self.root}/{self.name}", f"{self.root}/shard-{self.now:08d}.bin")
            self.out = None


def write_dealt(rows: Dealt, folder: str) -> DataFrame:
    """write_shards() for the pieces of dealt(), whose shards are held by one task each already: they aren't dealt again. Gives the rows of sequences() without payload."""
    pieces, pad, shard = rows
    names = ["shard", "slot", "position", "sequence", "doc_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(folder)
        for batch in joined(batches, pad, shard):
            for number, data in zip(batch.column("shard").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                shards.put(number, data)
            yield batch.select(names)
        shards.close()

    return pieces.mapInArrow(run, "shard long, slot long, position long, sequence long, doc_ids array<long>")


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each shard of sequences() as folder/shard-NNNNNNNN.bin and returns (shard, n_sequences, n_bytes).

    folder: a URI that all tasks reach. A shard is written under a task's own name and then renamed, so
    a retried or repeated task leaves one whole file. One shard is held by one task, in slot order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, written = _Shards(folder), []
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shards.put(shard, data):
                    written.append([shard, 0, 0])
                written[-1][1:] = written[-1][1] + 1, written[-1][2] + len(data)
        shards.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*written, strict=True) if written else ((), (), ()))], names=["shard", "n_sequences", "n_bytes"])

    ordered = rows.select("shard", "payload", "slot").repartition("shard").sortWithinPartitions("slot").select("shard", "payload")
    return ordered.mapInArrow(run, "shard long, n_sequences long, n_bytes long")


def read_slots(folder: str, first: int, count: int, stride: int = LENGTH, shard: int = SHARD) -> Iterator[bytes]:
    """Sequences first, first + 1, ... of the training order, one seek per shard: what a resumed trainer reads."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    while count > 0:
        number, position = divmod(first, shard)
        with files.open_input_file(f"{root}/shard-{number:08d}.bin") as data:
            data.seek(position * stride)
            for _ in range(min(count, shard - position)):
                if len(found := data.read(stride)) < stride:
                    return
                yield found
                first, count = first + 1, count - 1


def read_back(rows: DataFrame, folder: str, stride: int) -> DataFrame:
    """rows of write_dealt() with the payload that the shard files hold at their positions."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        now, data = None, None
        for batch in (whole.slice(k, HELD) for whole in batches for k in range(0, whole.num_rows, HELD)):
            out = []
            for shard, position in zip(batch.column("shard").to_pylist(), batch.column("position").to_pylist(), strict=True):
                if shard != now:
                    if data is not None:
                        data.close()
                    now, data = shard, files.open_input_file(f"{root}/shard-{shard:08d}.bin")
                data.seek(position * stride)
                out.append(data.read(stride))
                if len(out[-1]) < stride:
                    raise OSError(f"shard {shard} lacks sequence {position}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "payload"])
        if data is not None:
            data.close()

    return rows.mapInArrow(run, rows.withColumn("payload", F.lit(b"")).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of all documents' tokenizer ids, two bytes each, as the written shards hold them."""
    docs = packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/shards-{uuid.uuid4().hex}"
    rows = dealt(docs, end=END_ID.to_bytes(2, "little"), pad=PAD_ID.to_bytes(2, "little"))
    return read_back(materialize(write_dealt(rows, folder), "slots"), folder, LENGTH * 2)
