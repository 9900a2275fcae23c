"""Near-duplicate detection by Order MinHash.

Two texts are near duplicates if an alignment of their words keeps at least SIMILARITY of the longer one. A k-mer is five
words at the places of one of RUNS: five in a row, or five with gaps. An edit in every fifth word leaves no five words in
a row, but leaves some with gaps; where words are added or dropped, it is the other way round; so half of the functions
go by the first of RUNS and a quarter by each of the others. The n-th occurrence of a k-mer is labelled n. Each of SKETCHES hash functions picks the PICKS least labelled
k-mers, and the sketch is these in the order in which they stand in the text, so it agrees where edit similarity is high
and not where the same k-mers come in another order. Texts that share a sketch share a bucket.

A bucket's members are compared with a leader, not with each other: a bucket of n copies of one text takes n - 1 comparisons,
however large n is. Of a batch of rows only each bucket's first member leaves the batch, and meets the least of these from all
batches, so a bucket that holds a third of all texts is a row a batch where buckets are gathered. Buckets that then hold
several classes are of different texts with a passage in common.
Their members that have not met each other, and all texts of SHORT words or fewer, are compared exactly, without their buckets: as an alignment keeps
SIMILARITY of a text, two similar texts share one of the rarest 1 - SIMILARITY of their words, so each text is filed under
these (rare by counts over all that is left) and meets only what shares one. A word shared by many is cut into blocks of
BLOCK members, each pair of blocks a group of its own.
Words leave the stored texts only for comparisons: a member's go to its leaders, and keys are made where the texts are.
Candidates are excluded by lengths and by words counted in BINS, where these rule out the similarity, and else verified
by banded alignment: bit-parallel longest common subsequence, restricted to the diagonals that a similar pair cannot leave.
Words are lower-case runs of letters and digits. Texts of equal words are one node from the beginning. Classes are
connected components of the verified links: united in one task while they are few (TASK_EDGES, by count), else found by
label propagation in tables.

Two texts of more than SHORT words at exactly 0.8 share a sketch with a probability that depends on where the changed words
stand: measured figures for random, evenly spread and clustered changes are in the README, and tests hold them at 0.9;
nearer texts, and texts with other copies, are found more surely. Two groups
of near copies that share rare words, but no link, are compared text by text: the only work that grows with a group's square.

Defined results: null texts are empty; all texts without words are equal; rows that repeat an id get a row each; an id
may be null; a class is named by its least id (null if it has none); texts are taken whole; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

#: Fixed by the contract: five words. Chosen so that no even spread of edits in a fifth of the words hits all three.
RUNS = ((0, 1, 2, 3, 4), (0, 2, 3, 7, 10), (0, 1, 4, 6, 10))
PICKS = 2
SKETCHES = 96
SIMILARITY = 0.8
#: Texts of so many words or fewer have too few k-mers for a sure sketch; they are all filed.
SHORT = 50
#: Members of a block of one rare word; bins in which a text's words are counted; cells of the counts by which words are rare.
BLOCK = 512
BINS = 512
RARE_BITS = 20
#: A text's least keys that go with its rows, so that a pair that shares several keys is made under the least of them.
LEAST_KEYS = 8
#: Cells of 64 bits in which nodes are marked, at most: 8 MB.
CELLS = 1 << 20
#: Edges that one task may hold, about 200 MB.
TASK_EDGES = 1_000_000
#: ASCII letters and digits, and all beyond ASCII, belong to words.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Labelled k-mers and bytes hashed at a time, and bytes of alignment masks that are kept.
CHUNK = 1 << 11
PIECE = 1 << 16
MASK_BYTES = 1 << 26


_RNG = np.random.default_rng(20240229)
#: A number for each byte, and the powers by which a byte's place in its word counts.
BYTES = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(1 << 10, BASE))
FACTOR = _RNG.integers(0, 1 << 32, (SKETCHES, 1), np.uint32) | np.uint32(1)


def letters(text: str) -> bytes:
    """Words between blanks."""
    return text.lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(text: str) -> np.ndarray:
    """A 64-bit hash of each word, PIECE bytes of text at a time."""
    raw, found, begin = letters(text), [np.zeros(0, np.uint64)], 0
    while begin < len(raw):
        end = raw.find(b" ", begin + PIECE)
        piece = np.frombuffer(raw, np.uint8, (len(raw) if end < 0 else end) - begin, begin)
        begin += len(piece)
        size = np.diff(np.flatnonzero(piece == 32), prepend=-1, append=len(piece)) - 1
        size = size[size > 0]
        if len(size):
            first = np.cumsum(size) - size
            powers = POWERS if size.max() <= len(POWERS) else np.cumprod(np.full(size.max(), BASE))
            found.append(mix(np.add.reduceat(BYTES[piece[piece != 32]] * powers[np.arange(size.sum()) - np.repeat(first, size)], first)))
    return np.concatenate(found)


def coded(w: np.ndarray) -> np.ndarray:
    """A shorter number for each hashed word."""
    return (w >> np.uint64(32)).astype("<u4")


def labelled(x: np.ndarray) -> np.ndarray:
    """Hashes in which the second and later occurrences of a value are told apart."""
    ordered = np.sort(x)
    if (ordered[1:] == ordered[:-1]).any():
        order = np.argsort(x, kind="stable")
        ordered = x[order]
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        label = np.arange(len(x)) - np.repeat(begins, np.diff(np.append(begins, len(x))))
        x = x.copy()
        x[order] = np.where(label > 0, mix(ordered + label.astype(np.uint64) * BASE), ordered)
    return x


def kmers(w: np.ndarray, places: tuple[int, ...] = RUNS[0]) -> np.ndarray:
    """Hashes of the labelled k-mers of hashed words at these places, in text order; a text shorter than they span is one k-mer."""
    n = max(1, len(w) - places[-1])
    x = np.zeros(n, np.uint64)
    for i in places:
        if i < len(w):
            x = x * BASE + w[i : i + n]
    return labelled(mix(x))


def sketched(w: np.ndarray) -> np.ndarray:
    """The picks of all functions (functions x picks): half of them by the k-mers of the first of RUNS."""
    half = SKETCHES // 2
    parts = [FACTOR[:half], *np.array_split(FACTOR[half:], len(RUNS) - 1)]
    return np.concatenate([picked(kmers(w, places), PICKS, factor) for places, factor in zip(RUNS, parts, strict=True)])


def picked(x: np.ndarray, picks: int = PICKS, factor: np.ndarray = FACTOR) -> np.ndarray:
    """For each function the `picks` k-mers with the least values, in text order (functions x picks); 0 where there are fewer."""
    x = (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    value, at, rows = np.empty((len(factor), 0), np.uint32), np.empty((len(factor), 0), np.int64), np.arange(len(factor))
    for k in range(0, len(x), CHUNK):
        h = x[None, k : k + CHUNK] * factor
        values, ats = [value], [at]
        for _ in range(min(picks, h.shape[1])):
            a = h.argmin(axis=1)
            values.append(h[rows, a][:, None])
            ats.append((a + k)[:, None])
            h[rows, a] = np.iinfo(np.uint32).max
        value, at = np.concatenate(values, 1), np.concatenate(ats, 1)
        if at.shape[1] > picks:
            order = np.argsort(value, axis=1, kind="stable")[:, :picks]
            value, at = np.take_along_axis(value, order, 1), np.take_along_axis(at, order, 1)
    out = np.zeros((len(factor), picks), np.uint32)
    out[:, : at.shape[1]] = x[np.sort(at, axis=1)]
    return out


def buckets(picks: np.ndarray) -> np.ndarray:
    """A name of 48 bits for each sketch of each text: its function and its k-mers in order; picks: texts x functions x k-mers.

    Texts that share a name by chance are compared like others, so shorter names cost comparisons, not results.
    """
    x = np.broadcast_to(np.arange(SKETCHES, dtype=np.uint64) * BASE, picks.shape[:2])
    for j in range(picks.shape[2]):
        x = mix(x + picks[:, :, j] + np.uint64(j + 1))
    return (x >> np.uint64(16)).view(np.int64)


class Masks:
    """For each word of a text the bits of its places, made when asked for; kept up to MASK_BYTES."""

    def __init__(self, a: np.ndarray):
        self.bytes, self.kept, self.left = (len(a) + 7) // 8, {}, MASK_BYTES
        self.at: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(a.tolist()):
            self.at[w].append(i)

    def get(self, w: int) -> int:
        if (m := self.kept.get(w)) is not None:
            return m
        if (at := self.at.get(w)) is None:
            return 0
        if len(at) > 16:
            bits = bytearray(self.bytes)
            for i in at:
                bits[i >> 3] |= 1 << (i & 7)
            m = int.from_bytes(bits, "little")
        else:
            m = sum(1 << i for i in at)
        if self.left >= self.bytes:
            self.left -= self.bytes
            self.kept[w] = m
        return m


def aligned(a: int, of: Masks, b: list[int], band: int) -> int:
    """Words in the longest common subsequence whose matches lie within `band` of the diagonal; a: length, of: its masks."""
    full = (1 << a) - 1
    v, get, width = full, of.get, (1 << (2 * band + 1)) - 1
    if band >= max(a, len(b)):
        for w in b:
            if m := get(w):
                u = v & m
                v = (v + u | v - u) & full
    else:
        for j, w in enumerate(b):
            if m := get(w):
                m &= width << (j - band) if j >= band else width >> (band - j)
                if m:
                    u = v & m
                    v = (v + u | v - u) & full
    return a - v.bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float, known: list | None = None) -> bool:
    """Whether an alignment keeps at least `least` of the longer one. known: holds the masks of a, once made."""
    longer = max(len(a), len(b))
    need = int(np.ceil(least * longer - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    if not longer:
        return True
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if np.minimum(nx[i], ny[j]).sum() < need:  # not even as many words in common in any order
        return False
    of = known if known is not None else []
    if not of:
        of.append(Masks(a))
    return aligned(len(a), of[0], b.tolist(), longer - need) >= need


def binned(w: np.ndarray) -> bytes:
    """Words counted in BINS by their hashes, up to 255 each; then what is beyond, in all, as 8 bytes."""
    n = np.bincount(w % BINS, minlength=BINS)
    return np.minimum(n, 255).astype(np.uint8).tobytes() + int(np.maximum(n - 255, 0).sum()).to_bytes(8, "little")


def opened(packed: list[bytes]) -> np.ndarray:
    """Compressed bins as rows."""
    unpack = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(map(unpack.decompress, packed)), np.uint8).reshape(len(packed), -1)


def in_common(one: np.ndarray, more: np.ndarray) -> np.ndarray:
    """No fewer words than these binned texts have in common, row by row; one: a row, or as many as more."""
    rest = lambda x: np.ascontiguousarray(x[..., BINS:]).view("<i8")[..., 0]
    return np.minimum(one[..., :BINS], more[:, :BINS]).sum(axis=1, dtype=np.int64) + np.minimum(rest(one), rest(more))


def needed(longer: np.ndarray, least: float) -> np.ndarray:
    return np.ceil(least * longer - 1e-9)


def headed(node: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """For texts (a row of buckets each) the first node that has the bucket, bucket by bucket; a text's own, where it is the first."""
    flat = bucket.ravel()
    order = np.argsort(flat, kind="stable")
    begins = np.concatenate([[True], flat[order[1:]] != flat[order[:-1]]])
    first = order[np.flatnonzero(begins)][np.cumsum(begins) - 1]
    heads = np.empty(flat.shape, np.int64)
    heads[order] = node[first // SKETCHES]
    return heads.reshape(bucket.shape)


def lists(values: np.ndarray, where: np.ndarray) -> pa.ListArray:
    """For each row the values that are marked."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(where.sum(axis=1))]), pa.int32()), pa.array(values[where], pa.int64()))


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, node (a hash of the text's words); the first time a task meets the node, also n, bins, buckets, joined, heads, packed words.

    buckets: those of which the text is the first in its batch; joined: its others, and heads: the first texts of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            node, new, n, bins, picks, packed = [], [], [], [], [], []
            for text in c.texts_of(batch.column(2)):
                own = hashed(text)
                node.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True))
                new.append(len(own) > 0 and node[-1] not in met)
                if new[-1]:
                    met.add(node[-1])
                    w = coded(own)
                    n.append(len(w))
                    bins.append(pack.compress(binned(w)))
                    picks.append(sketched(own))
                    packed.append(pack.compress(w.tobytes()))
            at = pa.array(np.where(new, np.cumsum(new) - 1, -1), pa.int64())
            at = pc.if_else(pc.less(at, 0), None, at)
            own_node, names = np.array(node, np.int64)[np.array(new, bool)], buckets(np.stack(picks)) if picks else np.zeros((0, SKETCHES), np.int64)
            heads = headed(own_node, names) if picks else names
            first = heads == own_node[:, None]
            made = [pa.array(n, pa.int32()), pa.array(bins, pa.binary()), lists(names, first), lists(names, ~first), lists(heads, ~first), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), *[x.take(at) for x in made]], names=["doc_id", "text_hash", "node", "n", "bins", "buckets", "joined", "heads", "words"])

    text = F.col(c.q(text_col)).cast("string")
    return docs.select(F.col(c.q(id_col)).cast("long"), F.xxhash64(text), text).mapInArrow(run, "doc_id long, text_hash long, node long, n int, bins binary, buckets array<long>, joined array<long>, heads array<long>, words binary")


def gathered(made: DataFrame) -> DataFrame:
    """leader, node, buckets: in each bucket the first texts of batches under the least of them, and the other texts under the first of their batch."""
    heads = made.select("node", F.explode("buckets").alias("bucket"))
    above = heads.withColumn("leader", F.min("node").over(Window.partitionBy("bucket"))).where("node != leader").select("bucket", "node", "leader")
    within = made.select("node", F.explode(F.arrays_zip("joined", "heads")).alias("x")).select("x.joined", "node", "x.heads")
    return above.union(within).groupBy("leader", "node").agg(F.collect_set("bucket").alias("buckets"))


def unmet(state: DataFrame, labels: DataFrame) -> DataFrame:
    """node of buckets in which texts of different labels have not met: each text has met its leader, and nothing else."""
    of = lambda end, name: labels.select(F.col("node").alias(end), F.col("label").alias(name))
    met = state.join(of("node", "label"), "node", "left").join(of("leader", "over"), "leader", "left")
    met = c.stored(met.withColumns({"label": F.coalesce("label", "node"), "over": F.coalesce("over", "leader")}), "met")
    # where no text's label differs from its leader's, a bucket has one label
    differ = c.stored(met.where("label != over").select(F.explode("buckets").alias("bucket")).distinct(), "differ")
    left = sieved(met.select("node", "leader", "label", F.explode("buckets").alias("bucket")), differ, "bucket").join(differ, "bucket")
    by = left.groupBy("bucket").agg((F.min("label") < F.max("label")).alias("several"), (F.min("leader") < F.max("leader")).alias("deep"))
    ends = F.when(F.col("deep"), F.array("node", "leader")).otherwise(F.array("node"))
    open_ = c.stored(left.join(by.where("several or deep"), "bucket").select("node", "leader", "deep").distinct().select(F.explode(ends).alias("node")).distinct(), "unmet")
    c.dropped(met, differ)
    return open_


def _with(pairs: DataFrame, texts: DataFrame, *what: str) -> DataFrame:
    of = lambda end: texts.select(F.col("node").alias(end), *[F.col(x).alias(f"{x}_{end}") for x in what])
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", *[f"{x}_{end}" for end in "ab" for x in what])


def possible(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that lengths and bins leave; texts: node, n, bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 4))
            need = needed(np.maximum(n, m), least)
            at = np.flatnonzero(np.minimum(n, m) >= need)
            if len(at):
                x, y = (opened(batch.column(i).take(pa.array(at)).to_pylist()) for i in (3, 5))
                at = at[in_common(x, y) >= need[at]]
            yield batch.select([0, 1]).take(pa.array(at, pa.int64()))

    return _with(pairs, texts, "n", "bins").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b), a < b, whose texts are similar; pairs: a, b, words_a, words_b, best in order of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last, first, known = None, None, []
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, first, known = a, np.frombuffer(unpack.decompress(x.as_py()), "<u4"), []
                keep.append(similar(first, np.frombuffer(unpack.decompress(y.as_py()), "<u4"), least, known))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def led(texts: DataFrame) -> DataFrame:
    """a, b, words_a, words_b: each text b with its leaders a; texts: stored node, words, leaders."""
    b = texts.select(F.explode("leaders").alias("a"), F.col("node").alias("b"), F.col("words").alias("words_b"))
    leaders = c.stored(texts.select(F.explode("leaders").alias("node")).distinct(), "leaders")
    a = sieved(texts.select("node", "words"), leaders).withColumnsRenamed({"node": "a", "words": "words_a"})
    return b.join(a, "a").select("a", "b", "words_a", "words_b")


def rarity(texts: DataFrame) -> np.ndarray:
    """How often labelled words occur in all texts, by the cell of their hash; of a fixed size, so any task may hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total, cells, held = zstandard.ZstdDecompressor(), np.zeros(1 << RARE_BITS, np.int64), [], 0
        for batch in batches:
            for x in batch.column(0):
                w = labelled(mix(np.frombuffer(unpack.decompress(x.as_py()), "<u4").astype(np.uint64)))
                cells.append((w >> np.uint64(64 - RARE_BITS)).astype(np.int64))
                held += len(w)
                if held >= len(total):  # counting takes a pass over all cells
                    total += np.bincount(np.concatenate(cells), minlength=len(total))
                    cells, held = [], 0
        if cells:
            total += np.bincount(np.concatenate(cells), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    found = texts.select("words").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << RARE_BITS, np.int64)
    total[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return total


def filed(texts: DataFrame, total: np.ndarray, least: float) -> DataFrame:
    """node, n, bins, keys, low_keys: keys are the rarest words of a text, as many as leave no room for `least` of it without them.

    A key is a word's 32-bit name. low_keys: the least LEAST_KEYS of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            keys = []
            for x in batch.column(3):
                w = labelled(mix(np.frombuffer(unpack.decompress(x.as_py()), "<u4").astype(np.uint64)))
                count, name = total[(w >> np.uint64(64 - RARE_BITS)).astype(np.int64)], (w >> np.uint64(32)).astype("<u4").view("<i4")
                keys.append(np.sort(name[np.lexsort((name, count))][: len(w) - int(needed(len(w), least)) + 1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.list_(pa.int32())), pa.array([k[:LEAST_KEYS].tobytes() for k in keys], pa.binary())], names=["node", "n", "bins", "keys", "low_keys"])

    return texts.select("node", "n", "bins", "words").mapInArrow(run, "node long, n int, bins binary, keys array<int>, low_keys binary")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of equal values in the first `keys` columns of sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.Table:
        return pa.Table.from_batches(held)

    for batch in batches:
        if not batch.num_rows:
            continue
        by = [batch.column(i).to_numpy() for i in range(keys)]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in by], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for i, (begin, end) in enumerate(zip(edges, edges[1:], strict=False)):
            part = batch.slice(begin, end - begin)
            if i or held and any(held[-1].column(j)[-1] != part.column(j)[0] for j in range(keys)):
                yield whole()
                held = []
            held.append(part)
    if held:
        yield whole()


def rivals(node: np.ndarray, label: np.ndarray, n: np.ndarray, bins: np.ndarray, earlier: np.ndarray, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels (and sides, if given) that lengths and bins leave and that share no earlier key; earlier: rows of keys, 0 for none."""
    order = np.argsort(n, kind="stable")
    node, label, n, bins, earlier, side = node[order], label[order], n[order], bins[order], earlier[order], None if side is None else side[order]
    ends = np.searchsorted(n, (n / least).astype(np.int64) + 1, "right")  # the others are as long or longer, up to the longest of which this one can be enough
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(n) - 1):
        part = slice(i + 1, ends[i])
        open_ = label[part] != label[i]
        if side is not None:
            open_ &= side[part] != side[i]
        at = np.flatnonzero(open_) + i + 1
        if len(at):
            at = at[needed(n[at], least) <= np.minimum(n[i], in_common(bins[i], bins[at]))]
            at = at[~np.isin(earlier[at], earlier[i][earlier[i] != 0]).any(axis=1)]  # else the pair is made under an earlier key
            a.append(np.minimum(node[at], node[i]))
            b.append(np.maximum(node[at], node[i]))
    return np.concatenate(a), np.concatenate(b)


def before(key: int, low_keys: list[bytes]) -> np.ndarray:
    """Of each text's least keys those below this one; 0 for none."""
    out = np.frombuffer(b"".join(x.ljust(4 * LEAST_KEYS, b"\0") for x in low_keys), "<i4").reshape(-1, LEAST_KEYS)
    return np.where(out < key, out, 0)


def unjoined(marked: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of different labels under one key, but for those that lengths or bins rule out; marked: stored rows of filed, with label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in groups(batches, 3):
            label = g.column("label").to_numpy()
            if (label == label[0]).all():
                continue
            one = g.column("low")[0].as_py() == g.column("high")[0].as_py()
            earlier = before(g.column("key")[0].as_py(), g.column("low_keys").to_pylist())
            x, y = rivals(g.column("node").to_numpy(), label, g.column("n").to_numpy(), opened(g.column("bins").to_pylist()), earlier, None if one else g.column("mine").to_numpy(), least)
            a.append(x)
            b.append(y)
            if len(a) >= 1000:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    keyed = marked.select("node", "label", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = keyed.select("node", "key").join(shared, "key").withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(marked.drop("keys"), "node")
    each = dealt.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "label", "n", "bins", "low_keys")
    return each.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, "a long, b long").distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of the components of all edges in one task, by union of the least."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    names = list(parent)
    yield pa.RecordBatch.from_pydict({"node": pa.array(names, pa.int64()), "label": pa.array([root(x) for x in names], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of all nodes on stored edges (a, b).

    Up to TASK_EDGES edges are united in one task; more are left to label propagation over tables.
    """
    if edges.count() <= TASK_EDGES:
        return c.stored(edges.select("a", "b").coalesce(1).mapInArrow(_united, "node long, label long"), "labels")
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels = c.stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        # each takes the least label around it, then that label's own label
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("least"))
        pulled = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = c.stored(pulled.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def sieved(rows: DataFrame, wanted: DataFrame, key: str = "node") -> DataFrame:
    """The rows whose key may be one of stored wanted ones, by a bitmap of 16 bits for each of these, or CELLS cells; so most others aren't shuffled."""
    cells = min(CELLS, 1 << (max(1, wanted.count() // 4) - 1).bit_length())
    cell, bit = F.shiftrightunsigned(key, 6) % cells, f"cast({key} & 63 as int)"
    marks = wanted.groupBy(cell.alias("cell")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("marks"))
    return rows.join(F.broadcast(marks), cell == F.col("cell")).where(f"getbit(marks, {bit}) = 1").select(*rows.columns)


def _begun(docs: DataFrame, least: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored: the rows' nodes; leader, node and their buckets of several nodes; the texts of these nodes, with the leaders that lengths and bins leave, and of short ones."""
    rows = c.stored(nodes(docs, id_col, text_col), "nodes")
    made = rows.where(F.col("n").isNotNull())
    state = c.stored(gathered(made), "buckets")
    c.swept(docs.sparkSession)
    wanted = c.stored(state.select("node").union(state.select("leader")).union(made.where(F.col("n") <= SHORT).select("node")).distinct(), "wanted")
    of = lambda *what: sieved(made.select("node", *what), wanted).join(wanted, "node").dropDuplicates(["node"])
    # two texts may lead each other in different batches
    met = state.groupBy(F.least("leader", "node"), F.greatest("leader", "node")).agg(F.min(F.struct("leader", "node")).alias("x")).select(F.col("x.leader").alias("a"), F.col("x.node").alias("b"))
    leaders = c.stored(possible(met, of("n", "bins"), least).groupBy(F.col("b").alias("node")).agg(F.collect_list("a").alias("leaders")), "leaders")
    texts = c.stored(of("n", "bins", "words").join(leaders, "node", "left"), "texts")
    ids = c.stored(rows.select("doc_id", "text_hash", "node"), "ids")
    c.dropped(rows, wanted, leaders)
    return ids, state, texts


def classes(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, node, label, class_id (the class's least doc_id), n_links (verified links at the row's text) of every row."""
    ids, state, texts = _begun(docs, least, id_col, text_col)
    c.swept(docs.sparkSession)
    first = c.stored(verified(led(texts), least), "links")
    early = components(first)
    open_ = unmet(state, early).union(texts.where(F.col("n") <= SHORT).select("node")).distinct().join(early, "node", "left")
    open_ = c.stored(open_.select("node", F.coalesce("label", "node").alias("label")), "open")
    rest = sieved(texts, open_)
    keyed = c.stored(filed(rest, rarity(rest), least).join(open_, "node"), "keys")
    pairs = c.stored(unjoined(keyed, least), "pairs")
    ends = c.stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
    edges = first.unionByName(c.stored(verified(_with(pairs, sieved(texts.select("node", "words"), ends), "words"), least), "links"))
    labels = components(edges)
    c.dropped(state, texts, open_, keyed, early, pairs, ends)
    n_links = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    of = ids.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    name_ = of.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return of.join(name_, "label").join(n_links, "node", "left").select("doc_id", "text_hash", "node", "label", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that with the least id (null is the largest), of several the one with the least text hash."""
    own, key = F.xxhash64(F.col(c.q(text_col)).cast("string")), F.col(c.q(id_col)).cast("long")
    found = classes(docs, least, id_col, text_col)
    c.swept(docs.sparkSession)
    kept = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"))
    return docs.withColumns({"__id": key, "__hash": own}).join(kept.select(F.col("first.doc_id").alias("__i"), F.col("first.text_hash").alias("__h")), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left_semi").dropDuplicates(["__id", "__hash"]).drop("__id", "__hash")
