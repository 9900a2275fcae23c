"""Token ids as binary files with Elias-Fano encoded document boundaries.

A file holds the concatenated ids of documents in ascending id order and, behind them, two Elias-Fano sequences: where
each document begins (and the last ends), and the documents' ids. An Elias-Fano sequence of n numbers up to u keeps
floor(log2(u / n)) low bits of each as they are and its high part in unary: about 2 + log2(u / n) bits a number. Every
256th one-bit's place is sampled, so a boundary is found by reading from the nearest sample on.

Layout, little-endian: b"EFTOKENS"; ids; boundaries; document ids; footer of six unsigned 64-bit numbers (bytes of an id,
documents, ids, bytes of the boundaries, least document id as two's complement, documents without an id). Documents
without an id come first. Files are written under another name and then moved, so a task that runs again, or twice,
leaves one whole file; they are reached through pyarrow's file systems, so the folder may lie on any shared store.

Defined results: a null text is empty; an empty one has the end id alone; rows that repeat an id are kept, in the order
of a hash of their texts; an empty table has no files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c

MAGIC = b"EFTOKENS"
END_ID = 1
#: Ids in a file, about.
FILE_IDS = 1 << 24
SAMPLE = 256
#: Documents whose boundaries are selected at a time.
DOCS = 4096


class EliasFano:
    """Numbers in ascending order, in near-minimal space."""

    def __init__(self, raw: bytes):
        n, u, samples = np.frombuffer(raw, "<u8", 3).tolist()
        self.n, self.low_bits = n, max(0, (u // n).bit_length() - 1) if n else 0
        low_bytes = (n * self.low_bits + 7) // 8
        self.samples = np.frombuffer(raw, "<u4", samples, 24)
        self.low = np.frombuffer(raw, np.uint8, low_bytes, 24 + 4 * samples)
        self.high = np.frombuffer(raw, np.uint8, offset=24 + 4 * samples + low_bytes)

    @staticmethod
    def encode(numbers: np.ndarray) -> bytes:
        x = np.asarray(numbers, np.uint64)
        n, u = len(x), int(x[-1]) if len(x) else 0
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        low = np.packbits(((x[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8), bitorder="little") if bits else np.empty(0, np.uint8)
        ones = (x >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) if n else 0) + 1, np.uint8)
        high[ones] = 1
        if n and ones[-1] >> 32:
            raise ValueError("too many numbers for 32-bit samples")
        samples = ones[::SAMPLE].astype("<u4")
        return np.array([n, u, len(samples)], "<u8").tobytes() + samples.tobytes() + low.tobytes() + np.packbits(high, bitorder="little").tobytes()

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.uint64)
        a, b = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(count, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th number, read from the nearest sampled one-bit on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        window = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        window[: at % 8] = 0
        while (ones := int(window.sum())) <= left:
            left, byte = left - ones, byte + 1
            window = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        one = 8 * byte + int(np.flatnonzero(window)[left])
        return (one - i << self.low_bits) + int(self._low(i, 1)[0])

    def selects(self, first: int, count: int) -> np.ndarray:
        """`count` numbers from the first-th on, as far as there are: read from the nearest sampled one-bit to the next one behind them."""
        count = min(count, self.n - first)
        if count <= 0:
            return np.zeros(0, np.int64)
        k, last = first // SAMPLE, -(-(first + count) // SAMPLE)
        begin = int(self.samples[k])
        end = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : end // 8 + 1], bitorder="little")
        bits[: begin % 8] = 0
        ones = np.flatnonzero(bits)[first - k * SAMPLE : first - k * SAMPLE + count] + begin // 8 * 8
        return ((ones - np.arange(first, first + count)) << self.low_bits) + self._low(first, count).astype(np.int64)


def pack_file(ids: list[bytes], doc_ids: list[int | None], width: int) -> bytes:
    lengths = np.array([len(x) // width for x in ids], np.int64)
    known = [x for x in doc_ids if x is not None]
    least = known[0] if known else 0
    starts = EliasFano.encode(np.concatenate([[0], np.cumsum(lengths)]))
    names = EliasFano.encode(np.array([x - least for x in known], np.uint64))
    footer = np.array([width, len(ids), lengths.sum(), len(starts), least & (1 << 64) - 1, len(ids) - len(known)], "<u8").tobytes()
    return b"".join([MAGIC, *ids, starts, names, footer])


class TokenFile:
    """A file in memory or mapped: document k's ids without reading the others."""

    def __init__(self, raw):
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a file of token ids")
        width, self.n_docs, self.n_ids, size, least, self.without_id = np.frombuffer(raw, "<u8", 6, len(raw) - 48).tolist()
        self.least = least - (1 << 64 if least >> 63 else 0)
        self.ids = np.frombuffer(raw, f"<u{width}", self.n_ids, 8)
        at = 8 + width * self.n_ids
        self.starts = EliasFano(bytes(raw[at : at + size]))
        self.names = EliasFano(bytes(raw[at + size : len(raw) - 48]))

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.starts.select(k) : self.starts.select(k + 1)]

    def doc_ids(self, first: int, count: int) -> list[int | None]:
        """Of `count` documents from the first-th on; those without one come first."""
        none = max(0, min(count, self.without_id - first))
        return [None] * none + [x + self.least for x in self.names.selects(max(0, first - self.without_id), min(count, self.n_docs - first) - none).tolist()]


def _store(folder: str):
    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; returns their manifest: file, first (ids of all documents in earlier files), n_docs, n_ids."""
    spark = docs.sparkSession
    _make(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = c.encoder(tokenizer)
        end = np.array([END_ID], encode.dtype).tobytes()
        store, path = _store(folder)
        part, ids, names, size, number = TaskContext.get().partitionId(), [], [], 0, 0

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = encode.ids(text.as_py() or "") + end
                if size and size + len(x) > FILE_IDS * encode.dtype.itemsize:
                    yield _written(store, path, part, number, ids, names, encode.dtype.itemsize)
                    ids, names, size, number = [], [], 0, number + 1
                ids.append(x)
                names.append(name)
                size += len(x)
        if ids:
            yield _written(store, path, part, number, ids, names, encode.dtype.itemsize)

    keys = [F.col("id"), F.col("h"), F.col("tie")]
    text = F.coalesce(F.col(c.q(text_col)).cast("string"), F.lit(""))
    rows = docs.select(F.col(c.q(id_col)).cast("long").alias("id"), text.alias("text")).withColumns({"h": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("id", "text")
    written = c.stored(ordered.mapInArrow(run, "file string, n_docs long, n_ids long"), "manifest")
    before = F.sum("n_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))  # a row for each file
    return c.stored(written.select("file", F.coalesce(before, F.lit(0).cast("long")).alias("first"), "n_docs", "n_ids"), "manifest")


def _make(folder: str) -> None:
    store, path = _store(folder)
    store.create_dir(path, recursive=True)


def _written(store, path: str, part: int, number: int, ids: list, names: list, width: int) -> pa.RecordBatch:
    name = f"{part:06d}-{number:06d}.ids"
    raw = pack_file(ids, names, width)
    hidden = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(raw)
    store.move(hidden, f"{path}/{name}")
    return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(ids)], "n_ids": [sum(map(len, ids)) // width]})


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{name}") as f:
                    file = TokenFile(f.read_buffer())
                for k in range(0, file.n_docs, DOCS):
                    at = file.starts.selects(k, DOCS + 1)
                    sums = [zlib.crc32(file.ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.doc_ids(k, DOCS), pa.int64()), "start": at[:-1] + first, "n_tokens": np.diff(at), "ids_crc32": pa.array(sums, pa.int64())})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "first").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
