"""Quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's potentials come from features of the line and of its neighbours; those of
a step from one label to the next are free. Forward-backward gives each line's marginal, and the document's quality is
the mean of the marginals, weighted by the lines' lengths, put through a logistic curve fitted on the training labels.

Only documents are labelled, so lines learn in turns: at first all lines have their document's label; then, in bad
documents, each line has the label the model finds likelier, with the worst line kept bad. Training takes a bounded
sample of labelled rows (TRAIN_ROWS, texts of up to TRAIN_BYTES); every row is scored over its whole text.

Defined results: null and empty texts have one empty line; without labelled rows of both kinds every score is the share
of good ones, or 0.5 if there are none; repeated labels of an id count once, as good if any is.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

TRAIN_ROWS = 3000
TRAIN_BYTES = 32_000
TURNS = 2
STEPS = 50
#: Padded lines scored together; a longer text is scored by itself.
CELLS = 1 << 16
#: Bytes by kind: A upper case, a other letters and all beyond ASCII, 0 digits, | bars, ! marks that junk is full of, . the rest.
KIND = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 124 if b == 124 else 33 if b in b"!#$%&*" else 32 if b in b" \t\r\x0b\x0c" else 46 for b in range(256))
N_LINE = 13
N_FEATURES = 3 * N_LINE + 1
NO_WORDS = (1.0, *[0.0] * (N_LINE - 1))


def line_features(line: str, seen: set[str]) -> tuple[float, ...]:
    """Of a line by itself; seen: the text's lines before it."""
    words = line.split()
    m = len(words)
    if not m:
        return NO_WORDS
    n = len(line)
    kinds = line.encode("utf-8", "surrogatepass").translate(KIND)
    upper, lower, marks = kinds.count(b"A"), kinds.count(b"a"), kinds.count(b"!")
    ends = 1.0 if line.rstrip()[-1] in ".!?" else 0.0
    again = 1.0 if line in seen else 0.0
    seen.add(line)
    return (
        0.0,
        log1p(n) / 6,
        log1p(m) / 5,
        len(set(words)) / m,
        sum(map(eq, words, words[1:])) / m,
        (upper + lower) / max(1, len(kinds) - kinds.count(b" ")),
        upper / max(1, upper + lower),
        kinds.count(b"0") / n,
        kinds.count(b"|") / m,
        min(3.0, marks / m),
        min(2.0, n / m / 10),
        ends,
        again,
    )


def text_lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, and the lines' lengths."""
    lines, seen, flat = text.split("\n"), set(), array("f")
    for x in lines:
        flat.extend(line_features(x, seen))
    return np.frombuffer(flat, np.float32).reshape(-1, N_LINE), np.fromiter(map(len, lines), np.float64, len(lines))


def beside(own: np.ndarray) -> np.ndarray:
    """A row for each line, with its neighbours' features."""
    edge = np.zeros((1, N_LINE))
    return np.concatenate([own, np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge]), np.ones((len(own), 1))], axis=1)


def _blocks(lengths: np.ndarray):
    """Texts in groups of about as many lines each, of CELLS lines at most when padded; a longer text is a group of its own."""
    order = np.argsort(lengths, kind="stable")
    begin = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or (k + 1 - begin) * lengths[order[k]] > CELLS:
            yield order[begin:k]
            begin = k


def forward_backward(odds: np.ndarray, step: np.ndarray, length: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of 'good' (texts x lines) and, given the texts' weights, expected numbers of steps between labels (2 x 2).

    odds: padded rows of each line's log odds.
    """
    b, n = odds.shape
    node = np.stack([np.zeros_like(odds), odds], axis=2)  # bad, good
    alpha, beta = np.zeros((b, n, 2)), np.zeros((b, n, 2))
    alpha[:, 0] = node[:, 0]
    for t in range(1, n):
        alpha[:, t] = node[:, t] + np.logaddexp(alpha[:, t - 1, :1] + step[0], alpha[:, t - 1, 1:] + step[1])
    for t in range(n - 2, -1, -1):
        x = node[:, t + 1] + beta[:, t + 1]
        y = np.logaddexp(x[:, :1] + step[:, 0], x[:, 1:] + step[:, 1])
        beta[:, t] = np.where((t + 1 < length)[:, None], y, 0.0)
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -500, 500)))
    counts = np.zeros((2, 2))
    if n > 1 and weight is not None:
        inside = np.arange(1, n)[None, :] < length[:, None]
        z = np.logaddexp(both[:, :-1, 0], both[:, :-1, 1])
        for i in range(2):
            for j in range(2):
                p = np.exp(np.minimum(0, alpha[:, :-1, i] + step[i, j] + node[:, 1:, j] + beta[:, 1:, j] - z))
                counts[i, j] = ((p * inside).sum(axis=1) * weight).sum()
    return good, counts


@dataclass
class Model:
    w: np.ndarray
    step: np.ndarray
    slope: float
    offset: float
    mean: np.ndarray
    scale: np.ndarray

    def odds(self, own: np.ndarray) -> np.ndarray:
        """Each line's log odds of being good, from its own features and its neighbours'."""
        w = self.w / self.scale
        x = own @ w[: 3 * N_LINE].reshape(3, N_LINE).T
        x[1:, 0] += x[:-1, 1].copy()
        x[:-1, 0] += x[1:, 2]
        return x[:, 0] + (w[-1] - self.mean @ w)

    def marginals(self, odds: list[np.ndarray]) -> list[np.ndarray]:
        """Each line's probability of being good."""
        n = np.array([len(x) for x in odds])
        out: list = [None] * len(odds)
        for group in _blocks(n):
            padded = np.zeros((len(group), n[group].max()))
            for row, k in enumerate(group):
                padded[row, : n[k]] = odds[k]
            good, _ = forward_backward(padded, self.step, n[group])
            for row, k in enumerate(group):
                out[k] = good[row, : n[k]].astype(np.float32)
        return out

    def quality(self, marginals: np.ndarray, lengths: np.ndarray) -> float:
        return 1 / (1 + np.exp(-(self.slope * _mean(marginals, lengths) + self.offset)))


def _mean(marginals: np.ndarray, lengths: np.ndarray) -> float:
    total = lengths.sum()
    return float((marginals * lengths).sum() / total) if total else float(marginals.mean())


def _descend(gradient, size: int, steps: int, start: np.ndarray | None = None, rate: float = 0.1) -> np.ndarray:
    w = np.zeros(size) if start is None else start.copy()
    m, v = np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate / (1 + t / 50) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def fit(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, turns: int = TURNS, steps: int = STEPS) -> Model | None:
    if not len(y) or y.min() == y.max():
        return None
    n = np.array([len(x) for x, _ in texts])
    total = n.sum()
    mean = sum(beside(x).sum(axis=0) for x, _ in texts) / total
    scale = np.sqrt(sum(((beside(x) - mean) ** 2).sum(axis=0) for x, _ in texts) / total) + 1e-6
    mean[-1], scale[-1] = 0.0, 1.0
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # each kind counts as much, whatever its share
    groups = []
    for group in _blocks(n):
        x = np.zeros((len(group), n[group].max(), N_FEATURES))
        for row, k in enumerate(group):
            x[row, : n[k]] = (beside(texts[k][0]) - mean) / scale
        groups.append((group, x, np.arange(x.shape[1])[None, :] < n[group][:, None]))
    lines = [np.full(k, float(v)) for k, v in zip(n, y, strict=True)]
    w = None
    for turn in range(turns):

        def gradient(p: np.ndarray) -> np.ndarray:
            g = np.zeros(len(p))
            for group, x, inside in groups:
                weight = balance[group] / np.sqrt(n[group])  # a text of many lines doesn't drown the others
                target = np.zeros(inside.shape)
                for row, k in enumerate(group):
                    target[row, : n[k]] = lines[k]
                good, expected = forward_backward(x @ p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2), n[group], weight)
                g[:N_FEATURES] += ((good - target) * inside * weight[:, None]).reshape(-1) @ x.reshape(-1, N_FEATURES)
                pair = inside[:, 1:] * weight[:, None]
                a, b = target[:, :-1], target[:, 1:]
                seen = np.array([[((1 - a) * (1 - b) * pair).sum(), ((1 - a) * b * pair).sum()], [(a * (1 - b) * pair).sum(), (a * b * pair).sum()]])
                g[N_FEATURES:] += (expected - seen).ravel()
            return g / total + 1e-4 * p

        w = _descend(gradient, N_FEATURES + 4, steps, w)
        model = Model(w[:N_FEATURES], w[N_FEATURES:].reshape(2, 2), 1.0, 0.0, mean, scale)
        found = model.marginals([model.odds(x) for x, _ in texts])
        for k in np.flatnonzero(y == 0):
            lines[k] = (found[k] >= 0.5).astype(np.float64)
            lines[k][int(np.argmin(found[k]))] = 0.0
    q = np.array([_mean(p, x[1]) for p, x in zip(found, texts, strict=True)])

    def curve(p: np.ndarray) -> np.ndarray:
        d = 1 / (1 + np.exp(-(p[0] * q + p[1]))) - y
        return np.array([(d * q).mean(), d.mean()]) + 1e-4 * p

    model.slope, model.offset = _descend(curve, 2, 600, np.array([5.0, -2.5]), 0.3)
    return model


def train(part: DataFrame) -> tuple[Model | None, float]:
    """The model, and the share of good rows; part: doc_id, y, text. Features are made where the texts are."""

    def run(batches):
        for batch in batches:
            x, lengths = [], []
            for text in c.texts_of(batch.column(2)):
                a, b = text_lines(text)
                x.append(a.tobytes())
                lengths.append(b.astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "y": batch.column(1).cast(pa.int32()), "x": pa.array(x, pa.binary()), "n": pa.array(lengths, pa.binary())})

    got = sorted(part.mapInArrow(run, "doc_id long, y int, x binary, n binary").collect())  # bounded by the sample's rows and bytes
    y = np.array([r["y"] for r in got])
    texts = [(np.frombuffer(r["x"], "<f4").reshape(-1, N_LINE).astype(np.float64), np.frombuffer(r["n"], "<f4").astype(np.float64)) for r in got]
    return fit(texts, y), float(y.mean()) if len(y) else 0.5


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("line_good", T.ArrayType(T.FloatType()))]


def score(docs: DataFrame, model: Model | None, share: float = 0.5, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score and line_good, the marginal of each line."""

    def run(batches):
        for (texts,) in batches:
            if not model:
                yield [share] * len(texts), [[]] * len(texts)
                continue
            odds, lengths = [], []
            for t in c.texts_of(texts):
                own, n = text_lines(t)
                odds.append(model.odds(own))
                lengths.append(n)
            lines = model.marginals(odds)
            yield [model.quality(p, n) for p, n in zip(lines, lengths, strict=True)], lines

    return c.map_batches(docs, [text_col], run, FIELDS, keep)
