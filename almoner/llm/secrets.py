"""Secret scans with linking of credentials that come in parts.

Strong patterns are reported wherever they match. Weak ones (an account name, a random-looking word, an address) say
little alone: they are reported only where a complementary part lies in the same scope, at most `reach` code points away.
Parts are access identifiers, secrets and endpoints; an identifier or an endpoint needs a secret, a secret needs either.
Strong matches are parts too; parts that overlap don't vouch for each other. A scope is a run of lines without an empty one,
and no wider than `reach` around a part: identifiers and secrets farther apart than that are not linked. The join is an interval join by sorted
order: each side is sorted by start, and a part's nearest neighbours decide, so a text full of candidates takes n log n
steps and makes no pairs. A text is judged by itself, so nothing is shuffled and no source or copy can be hot.

Defined results: a null text is empty and has no spans; texts are taken whole; repeated rows get a row each; other columns
are carried along, except those with the names of new ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

REACH = 300

# The strong patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

# The weak ones.
IDENTIFIER = re.compile(r"""(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})|AKIA[A-Z0-9]{4,15}(?![A-Z0-9])""", re.ASCII | re.IGNORECASE)
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.]{1,12}://[^\s"'<>]+|(?<![\w.@-])(?:[a-z0-9-]+\.)+(?:com|net|org|io|dev|cloud|internal|local)(?::[0-9]+)?(?![\w-])""", re.ASCII | re.IGNORECASE)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
EMPTY_LINE = re.compile(r"\n[^\S\n]*\n")

ROLE = {"assign": "secret", "hex": "secret", "access": "identifier", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("partner", T.LongType())])


def strong(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches that do not overlap, for each kind; those that are too short are dropped after the scan."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return found + [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]


#: A maximal run of hex digits is long enough or it isn't: this finds the same runs as HEX and its least length.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def random_looking(word: str) -> bool:
    """Digits and letters, and at least three bits of entropy a character."""
    n = len(word)
    return sum(x.isdigit() for x in word) >= 2 and sum(x.isalpha() for x in word) >= 2 and -sum(k / n * math.log2(k / n) for k in Counter(word).values()) >= 3


def weak(text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak candidates that no strong span touches."""
    found = [("secret", m.start(), m.end()) for m in RANDOM.finditer(text) if random_looking(m[0])]
    if "=" in text or ":" in text or "AKIA" in text:
        found += [("identifier", m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
    if "." in text or "://" in text:
        found += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)] if "://" in text or HOST_ENDS.search(text) else []
    taken = sorted((a, b) for _, a, b in known)
    starts, upto, most = [a for a, _ in taken], [], 0
    for _, b in taken:
        most = max(most, b)
        upto.append(most)
    free = []
    for kind, a, b in found:
        k = bisect_left(starts, b)
        if not (k and upto[k - 1] > a):
            free.append((kind, a, b))
    return free


HOST_ENDS = re.compile(r"\.(?:com|net|org|io|dev|cloud|internal|local)\b", re.ASCII | re.IGNORECASE)


def linked(text: str, parts: list[tuple[str, int, int]], reach: int = REACH) -> dict[tuple[str, int, int], int]:
    """Of each part that has a complementary one in its scope and reach, where the nearest of those begins."""
    breaks = [m.start() for m in EMPTY_LINE.finditer(text)]
    begins: dict[str, list[tuple[int, int]]] = {"identifier": [], "secret": [], "endpoint": []}
    ends: dict[str, list[tuple[int, int, int]]] = {"identifier": [], "secret": [], "endpoint": []}
    for kind, a, b in parts:
        scope = bisect_left(breaks, a)
        begins[ROLE[kind]].append((scope, a))
        ends[ROLE[kind]].append((scope, b, a))
    for role in begins:
        begins[role].sort()
        ends[role].sort()
    out = {}
    for kind, a, b in parts:
        scope, best = bisect_left(breaks, a), None
        for role in ("secret",) if ROLE[kind] != "secret" else ("identifier", "endpoint"):
            # the last that ends before this one and the first that begins behind it: parts that overlap are one string, not two
            left, right = ends[role], begins[role]
            k = bisect_right(left, (scope, a, math.inf))
            near = [(a - left[k - 1][1], left[k - 1][2])] if k and left[k - 1][0] == scope else []
            k = bisect_left(right, (scope, b))
            if k < len(right) and right[k][0] == scope:
                near.append((right[k][1] - b, right[k][1]))
            for d, at in near:
                if d <= reach and (best is None or (d, at) < best):
                    best = d, at
        if best is not None:
            out[kind, a, b] = best[1]
    return out


def spans_of(text: str, reach: int = REACH) -> list[tuple[str, int, int, int | None]]:
    """All spans, by start and then kind; weak ones only where linked."""
    base = strong(text)
    extra = weak(text, base)
    if not base and not extra:
        return []
    parts = base + extra
    links = linked(text, parts, reach) if len({ROLE[k] for k, _, _ in parts}) > 1 else {}
    kept = base + [x for x in extra if x in links]
    return sorted(((*x, links.get(x)) for x in kept), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """Adds secret_spans: kind, start, end (code points) and where the linked part begins."""

    def run(batches):
        for (texts,) in batches:
            yield ([[dict(zip(("kind", "start", "end", "partner"), x, strict=True)) for x in spans_of(t, reach)] for t in c.texts_of(texts)],)

    return c.map_batches(docs, [text_col], run, [T.StructField("secret_spans", T.ArrayType(SPAN))], keep)


def mask(text: str, spans: list[tuple[str, int, int, int | None]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """The rows with secrets masked in their texts; all rows and columns stay, a null text stays null."""
    order = docs.columns

    def run(batches):
        for (texts,) in batches:
            yield ([t if not t or not (s := spans_of(t, reach)) else mask(t, s) for t in texts.to_pylist()],)

    return c.map_batches(docs, [text_col], run, [T.StructField(text_col, T.StringType())]).select(*[F.col(c.q(x)) for x in order])


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the secrets query."""

    def joined(spans):
        return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in LEAST] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_linked", T.LongType())]

    def run(batches):
        for (texts,) in batches:
            rows = []
            for t in c.texts_of(texts):
                spans = spans_of(t)
                base = [x for x in spans if x[0] in LEAST]
                rows.append((*(sum(x[0] == k for x in base) for k in LEAST), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            yield tuple(map(list, zip(*rows, strict=True)))

    return c.map_batches(docs, ["text"], run, fields, ["doc_id"])
