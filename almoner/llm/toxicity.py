"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a linear model over its words and their
beginnings, and the document's is their noisy-or: 1 - prod(1 - p). The model is trained on document labels alone, by the
likelihood of the noisy-or, so blame settles on the sentences that explain a label, and these are what `locate` returns.

Training takes a bounded sample of labelled rows (TRAIN_ROWS, chosen by a hash of the id, texts of up to TRAIN_BYTES);
every row is scored, over its whole text. Defined results: null and empty texts have no sentence and get the lowest
score, 0; without labelled rows every score is 0; repeated labels of an id count once, as toxic if any is.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

TRAIN_ROWS = 8000
TRAIN_BYTES = 32_000
BITS = 18
PART = 256
SHRINK = 1e-5
RATE = 0.2
#: Features whose presence in a document goes with the label less than this (log likelihood ratio) are left out, rare ones so.
LEAST_ASSOCIATION = 15.0
STEPS = 60
SENTENCE = re.compile(r"[^.!?\n]+")
STRIP = " \t\r\x0b\x0c,;:\"'()[]{}|*%$#&-_"


def features(word: str) -> list[int]:
    """Hashed: the word, and its first three, four and five letters."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1 for x in {word, *(f"{word[:k]}-" for k in (3, 4, 5) if len(word) > k)}]


def words(sentence: str) -> set[str]:
    return {w for x in sentence.lower().split() if (w := x.strip(STRIP))}


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def word(self, w: str) -> float:
        x = self.known.get(w)
        if x is None:
            if len(self.known) > 400_000:
                self.known.clear()
            x = self.known[w] = float(self.weights[features(w)].sum())
        return x

    def sentence(self, text: str) -> float:
        """The log odds that it is toxic."""
        known, word = self.known, self.word
        return self.bias + sum([known[w] if w in known else word(w) for w in words(text)])

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        return [(m.start(), m.end(), self.sentence(m[0])) for m in SENTENCE.finditer(text)]


def noisy_or(logits: list[float]) -> float:
    """1 - prod(1 - p)."""
    return float(-np.expm1(-np.logaddexp(0.0, np.asarray(logits)).sum())) if logits else 0.0


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, most_bytes: int) -> DataFrame:
    """id, label and text of at most about `rows` labelled rows, the same at every run.

    usable: which ids may be learned from, as a condition on the column doc_id of labels.
    """
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col(c.q(label)).isNotNull()).groupBy("doc_id").agg(F.max(F.col(c.q(label)).cast("int")).alias("y"))
    n = known.count()
    part = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(min(1.0, rows / max(n, 1)) * (1 << 30)))
    # At most about `rows` ids: small enough to send whole, at any size of the corpus.
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(part), "doc_id").where(F.octet_length("text") <= most_bytes).dropDuplicates(["doc_id"]).select("doc_id", "y", "text")


def _bags(part: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, sentences of each document, features of each sentence, features; made where the texts are."""

    def run(batches):
        known: dict[str, list[int]] = {}
        for batch in batches:
            out = {"y": batch.column(1).to_pylist(), "doc_id": batch.column(0).to_pylist(), "n": [], "x": []}
            for text in c.texts_of(batch.column(2)):
                bags = []
                for m in SENTENCE.finditer(text):
                    found = set()
                    for w in words(m[0]):
                        if w not in known:
                            known[w] = features(w)
                        found.update(known[w])
                    bags.append(sorted(found))
                out["n"].append(np.array(list(map(len, bags)), "<i4").tobytes())
                out["x"].append(np.array([f for b in bags for f in b], "<i4").tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out["doc_id"], pa.int64()), "y": pa.array(out["y"], pa.int32()), "n": pa.array(out["n"], pa.binary()), "x": pa.array(out["x"], pa.binary())})

    got = sorted(part.mapInArrow(run, "doc_id long, y int, n binary, x binary").collect())  # bounded by the sample's rows and bytes
    y = np.array([r["y"] for r in got], np.float64)
    n = [np.frombuffer(r["n"], "<i4") for r in got]
    x = [np.frombuffer(r["x"], "<i4") for r in got]
    empty = np.empty(0, np.int32)
    return y, np.array(list(map(len, n)), np.int64), np.concatenate([empty, *n]), np.concatenate([empty, *x])


def train(part: DataFrame, steps: int = STEPS) -> Model | None:
    return fit(*_bags(part), steps)


def _association(n: np.ndarray, toxic: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The log likelihood ratio of a feature's documents being toxic more often than all are; 0 if they aren't."""
    prior = y.mean()
    part = lambda k, p: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(n * p, 1e-9)), 0.0)
    return np.where(toxic > n * prior, 2 * (part(toxic, prior) + part(n - toxic, 1 - prior)), 0.0)


def fit(y: np.ndarray, per_doc: np.ndarray, per_sentence: np.ndarray, x: np.ndarray, steps: int = STEPS) -> Model | None:
    """Gradient steps on the likelihood of the noisy-or; features that don't go with the label are left out."""
    if not len(per_sentence) or y.min(initial=1) == y.max(initial=0):
        return None
    keep = per_sentence > 0
    doc = np.repeat(np.arange(len(y)), per_doc)[keep]
    per_sentence = per_sentence[keep]
    size = 1 << BITS
    in_docs, in_toxic = np.zeros(size), np.zeros(size)
    ends = np.concatenate([[0], np.cumsum(per_sentence)])
    kept = np.searchsorted(doc, np.arange(0, len(y) + PART, PART))  # sentences of PART documents at a time
    for k in range(0, len(y), PART):
        first, last = kept[k // PART], kept[k // PART + 1]
        own = np.repeat(doc[first:last], per_sentence[first:last]).astype(np.int64) << BITS | x[ends[first] : ends[last]]
        pairs = np.unique(own)
        in_docs += np.bincount(pairs & size - 1, minlength=size)
        in_toxic += np.bincount(pairs & size - 1, y[pairs >> BITS], size)
    telling = _association(in_docs, in_toxic, y) >= LEAST_ASSOCIATION
    chosen = telling[x]
    of = np.repeat(np.arange(len(per_sentence), dtype=np.int32), per_sentence)[chosen]
    x = x[chosen]
    w, b = np.zeros(size, np.float32), float(np.log(max(y.mean(), 1e-3) / max(1.0, len(per_sentence) / len(y))))
    m, v, bm, bv = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        s = np.bincount(of, w[x], len(doc)) + b
        p = 1 / (1 + np.exp(-s))
        total = np.bincount(doc, np.logaddexp(0, s), len(y))
        blame = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0)
        g = p * blame[doc]
        gw, gb = np.bincount(x, g[of], size) / len(y) + SHRINK * w, g.sum() / len(y)
        m, v, bm, bv = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * bm + 0.1 * gb, 0.99 * bv + 0.01 * gb * gb
        rate = RATE / (1 + t / 40)
        w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        b -= rate * (bm / (1 - 0.9**t)) / (np.sqrt(bv / (1 - 0.99**t)) + 1e-7)
    return Model(w, b)


FIELDS = [
    T.StructField("score", T.DoubleType()),
    T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))),
]


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """Adds score, and offending: the sentences (code points) whose own probability is at least `least`."""
    weights, bias = (model.weights, model.bias) if model else (None, 0.0)

    def run(batches):
        own = Model(weights, bias) if weights is not None else None
        edge = np.log(least / (1 - least))
        for (texts,) in batches:
            scores, spans = [], []
            for t in c.texts_of(texts):
                found = own.sentences(t) if own else []
                scores.append(noisy_or([x for _, _, x in found]))
                spans.append([{"start": a, "end": b, "p": 1 / (1 + np.exp(-x))} for a, b, x in found if x >= edge])
            yield scores, spans

    return c.map_batches(docs, [text_col], run, FIELDS, keep)


def locate(scored: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each offending sentence of scored rows that still have their texts."""
    x = scored.select("*", F.explode("offending").alias("o"))
    return x.select("doc_id", "o.start", "o.end", "o.p", F.expr(f"substring({c.q(text_col)}, CAST(o.start AS INT) + 1, CAST(o.end - o.start AS INT))").alias("sentence"))
