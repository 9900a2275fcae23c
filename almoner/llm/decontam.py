"""Benchmark decontamination over a distributed positional inverted index.

`build_index` stores, for every block of documents, the postings (positions) of its terms. A block holds whole documents,
so the index is split by document: each block answers any query by itself, hot terms never meet in one task, and a lost
executor costs the blocks it held. The index holds all terms and depends on the documents alone, so it serves any items.
`hits` ranks the terms of every phrase by their number of postings in the whole index, starts from the rarest term's list
and intersects it with the other lists, each shifted by its term's offset; it also finds the items all of whose terms stand
close together, again from the rarest term on.

Defined results: a null or empty text has no words; an item without words has no windows; rows without an item id are not
searched; repeated rows of a document each get their own row; items of one id count once; texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

#: A-Z become a-z; digits, a-z and all bytes of characters beyond ASCII stay; the rest separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words in a block of the index, about; a longer document is a block of its own.
BLOCK_WORDS = 500_000
#: Bytes of item texts that one pass over the index takes with it; more items take more passes.
QUERY_BYTES = 4 << 20

INDEX = T.StructType(
    [
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("n_words", T.ArrayType(T.IntegerType())),
        T.StructField("terms", T.ArrayType(T.BinaryType())),
        T.StructField("counts", T.ArrayType(T.IntegerType())),
        T.StructField("postings", T.BinaryType()),
    ]
)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def _block(ids: list, lengths: list[int], codes: list[np.ndarray], places: list[np.ndarray], names: list[bytes]) -> tuple:
    code, place = np.concatenate(codes), np.concatenate(places)
    order = np.argsort(code.astype(np.uint16) if len(names) < 1 << 16 else code, kind="stable")
    code, place = code[order], place[order]
    found, first, counts = np.unique(code, return_index=True, return_counts=True)
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    return ids, lengths, [names[k] for k in found], counts.tolist(), gaps.astype("<i4").tobytes()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each block: its documents, and the postings of all its terms.

    Positions run on through a block with one free place after each document, so no phrase runs from one into the next.
    Each term's positions are kept as gaps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = c.arrow_schema(INDEX)
        new = lambda: ([], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], {})
        ids, lengths, codes, places, vocabulary = new()
        base = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words(text.as_py())
                for w in set(own):
                    vocabulary.setdefault(w, len(vocabulary))
                ids.append(doc_id)
                lengths.append(len(own))
                codes.append(np.fromiter(map(vocabulary.__getitem__, own), np.int64, len(own)))
                places.append(np.arange(base, base + len(own)))
                base += len(own) + 1
                if base >= BLOCK_WORDS:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, _block(ids, lengths, codes, places, list(vocabulary)), strict=True))], schema=schema)
                    ids, lengths, codes, places, vocabulary = new()
                    base = 0
        if ids:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, _block(ids, lengths, codes, places, list(vocabulary)), strict=True))], schema=schema)

    return docs.select(F.col(c.q(id_col)).cast("long"), F.col(c.q(text_col)).cast("string")).mapInArrow(run, INDEX)


class Block:
    """A block of the index, its lists decoded when asked for."""

    def __init__(self, row: dict):
        self.lengths = np.asarray(row["n_words"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        ends = np.cumsum(row["counts"], dtype=np.int64)
        self.at = {t: (e - n, e) for t, e, n in zip(row["terms"], ends.tolist(), row["counts"], strict=True)}
        self.gaps = np.frombuffer(row["postings"], "<i4")
        self.lists: dict[bytes, np.ndarray] = {}

    def positions(self, term: bytes) -> np.ndarray:
        if term not in self.lists:
            a, b = self.at.get(term, (0, 0))
            self.lists[term] = np.cumsum(self.gaps[a:b], dtype=np.int64)
        return self.lists[term]

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1

    def phrase(self, terms: list[tuple[bytes, int]]) -> np.ndarray:
        """Where the phrase begins; terms with their offsets, rarest first."""
        begin = self.positions(terms[0][0]) - terms[0][1]
        for term, offset in terms[1:]:
            if not len(begin):
                break
            other = self.positions(term)
            if not len(other):
                return other
            at = np.searchsorted(other, begin + offset)
            begin = begin[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == begin + offset)]
        return begin

    def near(self, terms: list[bytes], span: int) -> np.ndarray:
        """Where, at the rarest term, a stretch of at most span words of one document holds all terms."""
        lists = [self.positions(t) for t in terms]
        if not all(map(len, lists)):
            return np.empty(0, np.int64)
        found = []
        for place in lists[0].tolist():
            k = int(np.searchsorted(self.starts, place, "right")) - 1
            low, high = max(self.starts[k], place - span + 1), min(self.starts[k + 1], place + span)
            near = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists[1:]]
            if not all(map(len, near)):
                continue
            ends = np.unique(np.concatenate([[place], *near]))
            for first in ends[ends <= place].tolist():  # the stretch begins at one of the terms
                if all(len(x) and (j := np.searchsorted(x, first)) < len(x) and x[j] < first + span for x in near):
                    found.append(place)
                    break
        return np.asarray(found, np.int64)


class Wanted:
    """A block of items as numbers of terms, which is all that a task gets: the terms, their counts in the index, and each item's words.

    Windows (phrases of `size` words, or a shorter item whole) are ordered by their rarest term; they are cut when used.
    """

    def __init__(self, rows: list[tuple[str, list[bytes]]], counts: dict[bytes, int], size: int):
        self.terms = sorted({t for _, own in rows for t in own})
        code = {t: k for k, t in enumerate(self.terms)}
        self.n = np.array([counts.get(t, 0) for t in self.terms], np.int64)
        self.names = [name for name, own in rows if own]
        self.words = [np.array([code[t] for t in own], np.int32) for _, own in rows if own]
        first, item, begin = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for k, own in enumerate(self.words):
            cuts = np.lib.stride_tricks.sliding_window_view(own, min(size, len(own)))
            rare = self.n[cuts]
            at = np.flatnonzero(rare.min(axis=1) > 0)  # a term that isn't in the index: no phrase
            first.append(cuts[at, rare[at].argmin(axis=1)])
            item.append(np.full(len(at), k, np.int32))
            begin.append(at.astype(np.int32))
        first, self.item, self.begin, self.size = np.concatenate(first), np.concatenate(item), np.concatenate(begin), size
        order = np.argsort(first, kind="stable")
        self.first, self.item, self.begin = first[order], self.item[order], self.begin[order]
        # the distinct terms of each whole item, rarest first, of items with all terms in the index
        self.sets = {k: x[np.argsort(self.n[x], kind="stable")] for k, own in enumerate(self.words) if self.n[x := np.unique(own)].min() > 0}

    def ranked(self, k: int) -> list[tuple[bytes, int]]:
        """The k-th window's terms with their offsets, rarest first."""
        own = self.words[self.item[k]][self.begin[k] : self.begin[k] + self.size]
        return [(self.terms[own[i]], i) for i in np.argsort(self.n[own], kind="stable").tolist()]


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """The items in blocks of at most QUERY_BYTES, each of which the driver may hold.

    A larger item is a block of its own.
    """
    rows, held = [], 0
    for r in items.select(F.col(c.q(id_col)).cast("string"), F.col(c.q(text_col)).cast("string")).where(F.col(c.q(id_col)).isNotNull()).toLocalIterator():
        if rows and held + len(r[1] or "") > QUERY_BYTES:
            yield rows
            rows, held = [], 0
        rows.append((r[0], words(r[1])))
        held += len(r[1] or "")
    yield rows


HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("block", T.StringType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("near_items", T.ArrayType(T.StringType())),
    ]
)


def _search(index: DataFrame, wanted: Wanted, slack: int) -> DataFrame:
    """What a block of items finds in each block of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                marks = np.zeros(int(block.starts[-1]) + 1, np.int32)
                items, near = defaultdict(set), defaultdict(set)
                for k in np.flatnonzero(np.isin(wanted.first, [i for i, t in enumerate(wanted.terms) if t in block.at])).tolist():
                    ranked = wanted.ranked(k)
                    begin = block.phrase(ranked)
                    if len(begin):
                        np.add.at(marks, begin, 1)
                        np.add.at(marks, begin + len(ranked), -1)
                        for d in np.unique(block.doc_of(begin)).tolist():
                            items[d].add(wanted.names[wanted.item[k]])
                for k, terms in wanted.sets.items():
                    place = block.near([wanted.terms[i] for i in terms.tolist()], len(wanted.words[k]) + slack)
                    for d in np.unique(block.doc_of(place)).tolist() if len(place) else ():
                        near[d].add(wanted.names[k])
                hit = np.flatnonzero(np.diff((np.cumsum(marks) > 0).astype(np.int8), prepend=0))
                spans = defaultdict(list)
                for a, b in zip(hit[::2].tolist(), hit[1::2].tolist(), strict=True):
                    k = int(np.searchsorted(block.starts, a, "right")) - 1
                    spans[k].append({"start": a - int(block.starts[k]), "end": b - int(block.starts[k])})
                ids = row["doc_ids"]
                name = hashlib.md5(repr((ids, row["n_words"])).encode() + row["postings"]).hexdigest()
                n = len(ids)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": ids, "block": [name] * n, "place": range(n), "n_words": row["n_words"], "spans": [spans[k] if k in spans else [] for k in range(n)], "items": [sorted(items[k]) if k in items else [] for k in range(n)], "near_items": [sorted(near[k]) if k in near else [] for k in range(n)]},
                    schema=c.arrow_schema(HITS),
                )

    return index.mapInArrow(run, HITS)


def _joined(parts: list[DataFrame]) -> DataFrame:
    """What the passes over the items found, by document row; spans are merged."""
    if len(parts) == 1:
        return parts[0].drop("block", "place")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    # Blocks of equal documents have equal names; the rows of such twins are told apart by nothing, and are equal.
    numbered = union.groupBy("block", "place", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"), (F.count("*") / len(parts)).cast("int").alias("twins"))
    merged = F.aggregate(
        F.array_sort(F.array_distinct("s")),
        F.array().cast(HITS["spans"].dataType),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))).cast(HITS["spans"].dataType)),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return numbered.select("doc_id", "n_words", merged.alias("spans"), "items", "near_items", F.explode(F.sequence(F.lit(1), "twins")).alias("twin")).drop("twin")


def hits(docs: DataFrame, items: DataFrame, size: int = 13, slack: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, spans (word ranges that windows cover, merged), items (ids of items with an occurring window), near_items.

    near_items: the items all of whose distinct terms stand, in any order, within as many words as the item has, plus slack.
    index: of docs, if one is at hand; else one is stored.
    """
    parts = []
    index = c.stored(build_index(docs, id_col, text_col), "postings") if index is None else index
    for rows in _item_blocks(items, item_id, item_text):
        own_terms = index.sparkSession.createDataFrame([(t,) for t in sorted({t for _, own in rows for t in own})], "term binary")
        found = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n")).join(F.broadcast(own_terms), "term", "left_semi")
        n = {bytes(r["term"]): r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # as many rows as terms of the block of items, at most
        parts.append(_search(index, Wanted(rows, n, size), slack))
    return _joined(parts)


def digest(hits: DataFrame) -> DataFrame:
    """The columns of the decontamination query."""
    return hits.select("doc_id", "n_words", _n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"), F.size("near_items").cast("long").alias("n_near"))


def _n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def contaminated() -> Column:
    """At least a word in twenty is hit."""
    return (_n_hit() > 0) & (20 * _n_hit() >= F.col("n_words"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {documents}
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {benchmark}
), win AS (
  SELECT DISTINCT item_id, least(len(w), {size}) AS n, array_to_string(list_slice(w, p, p + least(len(w), {size}) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {size} + 1, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT n FROM win
), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d
), hits AS (
  SELECT pos.doc_id, pos.p, lens.n, win.item_id
  FROM pos JOIN lens ON pos.p + lens.n - 1 <= len(pos.w)
  JOIN win ON win.n = lens.n AND win.k = array_to_string(list_slice(pos.w, pos.p, pos.p + lens.n - 1), ' ')
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM hits) GROUP BY doc_id
), terms AS (
  SELECT DISTINCT k, item_id, n, unnest(w) AS term FROM (SELECT row_number() OVER () AS k, item_id, len(w) AS n, w FROM i WHERE len(w) > 0 AND item_id IS NOT NULL)
), sizes AS (
  SELECT k, count(*) AS m FROM terms GROUP BY k
), all_of AS (
  SELECT doc_id, k FROM (SELECT DISTINCT doc_id, w[p] AS term FROM pos) JOIN terms USING (term) JOIN sizes USING (k) GROUP BY doc_id, k, m HAVING count(*) = m
), spots AS (
  SELECT pos.doc_id, k, terms.item_id, count(DISTINCT term) OVER (PARTITION BY pos.doc_id, k ORDER BY p RANGE BETWEEN CURRENT ROW AND terms.n + {slack} - 1 FOLLOWING) AS found
  FROM all_of JOIN pos USING (doc_id) JOIN terms USING (k) WHERE terms.term = pos.w[pos.p]
), beside AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM spots JOIN sizes USING (k) WHERE found = m GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(d.w), 0) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN beside USING (doc_id)
"""


def oracle_sql(documents: str = "documents", benchmark: str = "benchmark", size: int = 13, slack: int = 5) -> str:
    return ORACLE_SQL.format(documents=documents, benchmark=benchmark, size=size, slack=slack)
