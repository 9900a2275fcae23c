"""Best-fit packing, certified by lower bounds.

Documents are cut into pieces of at most CAPACITY tokens; a piece of full length is a sequence. The others are dealt to
partitions of a bounded number of pieces, and each is packed by best-fit decreasing. Dual feasible functions give each
partition a lower bound of its number of sequences. A partition that meets its bound keeps all sequences but the
emptiest one; one with a gap gives up its emptiest sequences, four times as many as the gap, too. The given-up documents
of all partitions are exchanged: dealt anew to far fewer partitions, and packed again, until one partition holds them
all. A round leaves a small part of its pieces, so few rounds are needed at any size, and no task sees more than
a partition's pieces.

Defined results: a null text is empty; every document has an end id, so none is without a piece; repeated rows are
packed each; an empty table has no sequences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

CAPACITY = 4096
END_ID = 1
#: Pieces in a partition, about.
PIECES = 4096

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, numbered by uid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = c.encoder(tokenizer)
        end = np.array([END_ID], encode.dtype).tobytes()
        step = capacity * encode.dtype.itemsize
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode.ids(text.as_py() or "") + end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    out["doc_id"].append(name)
                    out["piece"].append(k // step)
                    out["start"].append(k // encode.dtype.itemsize)
                    out["length"].append(len(part) // encode.dtype.itemsize)
                    out["ids_crc32"].append(encode.crc32(part))
            n = len(out["piece"])
            yield pa.RecordBatch.from_pydict({**out, "uid": np.arange(uid, uid + n)}, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((x, pa.int64()) for x in ("start", "length", "ids_crc32", "uid"))]))
            uid += n

    return docs.select(F.col(c.q(id_col)).cast("long"), F.col(c.q(text_col)).cast("string")).mapInArrow(run, PIECE)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the bins' fill. Lengths descend, from at most capacity to at least 1."""
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if left := room - n:
            with_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.asarray(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound among dual feasible functions.

    One family drops lengths below t and rounds those above capacity - t up to it; with the lengths above half counted as
    bins of their own this is the bound of Martello and Toth. The other rounds (k + 1) x down to a multiple of capacity
    and divides by k (Fekete and Schepers).
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])  # of lengths below i
    half = capacity // 2
    t = np.arange(half + 1)
    large = count[-1] - count[capacity - t + 1]
    medium = count[capacity - t + 1] - count[half + 1]
    room = medium * capacity - (total[capacity - t + 1] - total[half + 1])
    best = int((large + medium + np.maximum(0, -((room - (total[half + 1] - total[t])) // capacity))).max())
    for k in range(1, 33):
        scaled = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)  # times k
        best = max(best, -(-int((n * scaled).sum()) // (k * capacity)))
    return best


def _settle(names: list[str], capacity: int, turn: int, last: bool):
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[names].sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        given = np.zeros(len(fill), bool)
        if not last:
            given[np.argsort(fill, kind="stable")[: 4 * (len(fill) - bound) + 1]] = True
        first = np.full(len(fill), np.iinfo(np.int64).max)
        np.minimum.at(first, bins, rows["uid"].to_numpy(np.int64))
        return rows.assign(sequence_id=2 * first[bins] + 1, offset=offsets, round=np.int32(turn), n_bins=len(fill), bound=bound, settled=~given[bins])

    return settle


def pack(parts: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PIECES) -> DataFrame:
    """Adds sequence_id, offset, and round, n_bins and bound of the partition that settled the piece, to stored pieces."""
    out = parts.where(F.col("length") == capacity).select("*", (2 * F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("round"), F.lit(1).cast("long").alias("n_bins"), F.lit(1).cast("long").alias("bound"))
    rest = parts.where(F.col("length") < capacity)
    names = parts.columns
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in parts.schema] + ["sequence_id long", "offset long", "round int", "n_bins long", "bound long", "settled boolean"])
    turn, before, last = 0, None, None
    while n := rest.count():
        turn += 1
        groups = math.ceil(n / partition_pieces)
        dealt = rest.withColumn("__group", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)))
        packed = c.stored(dealt.groupBy("__group").applyInPandas(_settle(names, capacity, turn, groups == 1), schema), "packed")
        bins = packed.select("sequence_id").distinct().count()
        if before is not None and bins >= before:  # the exchange has saved nothing: the better of both packings stays, whole
            return out.unionByName((packed if bins == before else last).drop("settled"))
        out = out.unionByName(packed.where("settled").drop("settled"))
        last = packed.where("NOT settled")
        before = last.select("sequence_id").distinct().count()
        rest = last.select(*names)
    return out
