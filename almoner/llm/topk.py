"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, again in each pass, and no score is kept. A pass counts scores in a histogram
for each query; the counts are summed over all partitions and name the bin that holds the kth score; the next pass splits
that bin alone, until a bin is one value wide. A last pass keeps the scores above each kth value and, of those equal to
it, the smallest ids that fill up the k. A partition sends at most the upper bins that hold its own k best scores, and at
most 2 * k rows for each query at the end: no task gets more than that from each partition.

Queries are a stated set, taken in blocks of QUERIES with all rows scored against each block. The search is exact.

Defined results: rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part;
rows of a query's own id are not its candidates; vectors of another length are not scored against a query; a query row
that is repeated gets its results once for each; fewer than k candidates are all returned; ties go to the smaller id;
scores beyond a long are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c

QUERIES = 1024
BITS = 12
#: Scores held at a time.
SCORES = 1 << 21


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(c.q(vector_col)).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(c.q(id_col)).isNotNull() & v.isNotNull() & ~bad).select(F.col(c.q(id_col)).cast("long").alias("id"), v.alias("v"))


def _whole(array: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Whole-number vectors by length: which rows, and the matrix."""
    lengths = array.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    flat = np.floor(scale * array.flatten().to_numpy(zero_copy_only=False))
    out = {}
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        out[n] = rows, flat[(ends[rows] - n)[:, None] + np.arange(n)]
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where no partial sum can leave its whole numbers."""
    most = a.shape[1] * np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**63 and max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)) < 2**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("inner products may exceed a long")


def _scored(batches: Iterator[pa.RecordBatch], queries: dict, scale: float):
    """For each part of each batch: which queries, their scores, the ids, and what is no candidate."""
    for batch in batches:
        all_ids = batch.column(0).to_numpy()
        for n, (rows, matrix) in _whole(batch.column(1), scale).items():
            if n not in queries:
                continue
            which, own, q = queries[n]
            step = max(1, SCORES // len(which))
            for k in range(0, len(rows), step):
                ids = all_ids[rows[k : k + step]]
                yield which, _scores(q, matrix[k : k + step]), ids, own[:, None] == ids[None, :]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and score of each query's k best; components become floor(scale * x).

    is_query: a condition on the column `id`.
    """
    rows = usable(vectors, id_col, vector_col)
    widest = rows.select(F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(F.floor(scale * x)).cast("double")))), F.max(F.size("v"))).first()
    bound = int((widest[0] or 0) ** 2 * (widest[1] or 0))
    parts, held = [], []
    for r in rows.where(is_query).toLocalIterator():
        held.append((r["id"], r["v"]))
        if len(held) == QUERIES:
            parts.append(_search(rows, held, k, scale, bound))
            held = []
    if held or not parts:
        parts.append(_search(rows, held, k, scale, bound))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search(rows: DataFrame, held: list, k: int, scale: float, bound: int) -> DataFrame:
    n = len(held)
    queries: dict = {}
    for length, (which, matrix) in _whole(pa.array([v for _, v in held], pa.list_(pa.float64())), scale).items() if held else ():
        queries[length] = which, np.array([held[w][0] for w in which], np.int64), matrix
    shift = max(0, (2 * bound + 1).bit_length() - BITS)
    low, need, few = np.full(n, -bound, np.int64), np.full(n, k, np.int64), np.zeros(n, bool)
    width = shift + BITS
    while n:
        counts = rows.mapInArrow(_histogram(queries, scale, low, need, width, shift), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0))
        wanted = rows.sparkSession.createDataFrame([(int(a), int(b)) for a, b in enumerate(need)], "q int, need long")
        at = counts.withColumn("upto", above).join(F.broadcast(wanted), "q").where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        found = {r["q"]: (r["bin"], r["need"] - (r["upto"] - r["n"])) for r in at.select("q", "bin", "n", "upto", "need").collect()}  # a row for each query of the block
        for x in range(n):
            if x in found:
                low[x] += found[x][0] << shift
                need[x] = found[x][1]
            elif not few[x]:
                few[x], need[x] = True, 0  # fewer than k candidates: all are kept
        if not shift:
            break
        width, shift = shift, max(0, shift - BITS)
    low[few] = -bound - 1
    best = rows.mapInArrow(_kept(queries, scale, low, need), "q int, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    names = rows.sparkSession.createDataFrame([(a, b[0]) for a, b in enumerate(held)], "q int, query_id long")
    return ranked.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score")


def _histogram(queries: dict, scale: float, low: np.ndarray, need: np.ndarray, width: int, shift: int):
    bins = 1 << (width - shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(low), bins), np.int64)
        for which, score, _, not_one in _scored(batches, queries, scale):
            at = score - low[which][:, None]
            inside = (at >= 0) & (at >> width == 0) & ~not_one
            flat = (at >> shift) + np.arange(len(which))[:, None] * bins
            total[which] += np.bincount(flat[inside], minlength=len(which) * bins).reshape(len(which), bins)
        down = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]  # scores in this bin and those above
        sent = (total > 0) & (down - total < need[:, None])
        q, b = np.nonzero(sent)
        yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int32()), "bin": pa.array(b, pa.int32()), "n": pa.array(total[sent], pa.int64())})

    return run


def _kept(queries: dict, scale: float, kth: np.ndarray, need: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, np.ndarray] = {}
        schema = pa.schema([("q", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for which, score, ids, not_one in _scored(batches, queries, scale):
            a, b = np.nonzero((score > kth[which][:, None]) & ~not_one)
            yield pa.RecordBatch.from_arrays([pa.array(which[a], pa.int32()), pa.array(ids[b], pa.int64()), pa.array(score[a, b], pa.int64())], schema=schema)
            equal = (score == kth[which][:, None]) & ~not_one & (need[which] > 0)[:, None]
            for x in np.flatnonzero(equal.any(axis=1)).tolist():
                w = int(which[x])
                ties[w] = np.sort(np.concatenate([ties.get(w, ids[:0]), ids[equal[x]]]))[: need[w]]
        q = np.concatenate([np.full(len(v), w) for w, v in ties.items()] or [np.empty(0)])
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()) if len(q) else pa.array([], pa.int32()), pa.array(np.concatenate([*ties.values()] or [np.empty(0, np.int64)]), pa.int64()), pa.array(kth[q.astype(int)], pa.int64())], schema=schema)

    return run


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
