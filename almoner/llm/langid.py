"""Language identification by fusing evidence with Bayes' rule.

Four kinds of evidence: how likely the text is in each language, the language that the markup declares, the language that
the address names (a path or a suffix), and a prior of the host. Text likelihoods come from naive Bayes over words and
their endings, learned from a bounded sample of labelled texts (TRAIN_ROWS, of up to TRAIN_BYTES) and mixed with the
background of all languages (BACKGROUND), so that a feature no language has met favours none, and count for no more
than EVIDENCE_WORDS words, as words of one text are not independent. How far declarations and addresses can be trusted,
and what each host holds, is counted over all rows by what their texts alone say, in grouped aggregations. Priors are
smoothed hierarchically: a host's towards its parent domain's, and that towards the prior of all rows.

Host priors are broadcast if there are at most HOSTS of them, else joined by host.

Defined results: a text without words says nothing, and only the other evidence counts; null evidence says nothing; rows
of null host share one; a row is accepted if its text has a word and the likeliest language has at least `least`; without
labelled rows no language is known: lang and confidence are null and rows with words are accepted. Texts are taken whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

TRAIN_ROWS = 3000
TRAIN_BYTES = 16_000
BITS = 16
EVIDENCE_WORDS = 40
HOSTS = 100_000
SMOOTH = 10.0
#: Share of the background in each language's distribution.
BACKGROUND = 0.02

OPENS = re.compile(r"<(?:(script|style)\b|(!--))?", re.IGNORECASE)
CLOSES = {"script": re.compile(r"</script\s*>", re.IGNORECASE), "style": re.compile(r"</style\s*>", re.IGNORECASE), "!--": re.compile("-->"), "": re.compile(">")}
SPLIT = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Endings of host names that name a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en"}


def bare(html: str) -> str:
    """Markup's text, with a blank for each tag, comment, script and style sheet. Each byte is looked at a few times at most."""
    out, at, gone = [], 0, set()
    while m := OPENS.search(html, at):
        kinds = [(m[1] or m[2] or "").lower(), ""]
        end = None
        for kind in kinds:  # what is never closed is a plain tag
            if kind not in gone and end is None:
                end = CLOSES[kind].search(html, m.end() if kind else m.start())
                if end is None:
                    gone.add(kind)  # nor will it be further on
        if end is None and "" in gone:
            break
        out += [html[at : m.start()], " "]
        at = end.end()
    return "".join([*out, html[at:]])


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(SPLIT).split()


def features(word: bytes) -> list[int]:
    """Hashed: the word, its last three and two bytes, its first three."""
    return [zlib.crc32(x) & (1 << BITS) - 1 for x in (word, b"-" + word[-3:], b"_" + word[-2:], word[:3] + b"-")]


class Likelihoods:
    """Log likelihoods of words by language, with a bounded memory of words already met."""

    def __init__(self, table: np.ndarray):
        self.table, self.at, self.rows = table, {}, np.zeros((1024, table.shape[1]))

    def __call__(self, own: list[bytes]) -> np.ndarray:
        if len(self.at) > 300_000:
            self.at.clear()
        at, known = self.at, np.empty(len(own), np.int64)
        for k, w in enumerate(own):
            i = at.get(w)
            if i is None:
                i = at[w] = len(at)
                if i >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[i] = self.table[features(w)].mean(axis=0)
            known[k] = i
        return self.rows[known].sum(axis=0) * min(1.0, EVIDENCE_WORDS / max(1, len(own)))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> tuple[list[str], np.ndarray]:
    """The languages and a table of log likelihoods, features by languages.

    The sample is chosen by a hash of the text, the same at every run; equal texts count once.
    """
    if lang_col not in docs.columns or not isinstance(docs.schema[lang_col].dataType, T.StringType):
        return [], np.zeros((1 << BITS, 0))
    text, lang = F.col(c.q(text_col)).cast("string"), F.col(c.q(lang_col))
    n = docs.where(lang.isNotNull()).count()
    share = min(1.0, rows / max(n, 1))
    part = docs.where(lang.isNotNull() & (F.octet_length(text) <= most_bytes)).select(lang.alias("lang"), text.alias("text"), F.xxhash64(text).alias("h"))
    part = part.where(F.pmod(F.col("h"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["h"]).select("lang", "text")

    def run(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), c.texts_of(batch.column(1)), strict=True):
                count = found.setdefault(lang, np.zeros(1 << BITS))
                for w, k in Counter(words(text)).items():
                    count[features(w)] += k
        for lang, count in found.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "f": pa.array(at, pa.int32()), "n": pa.array(count[at])})

    counted = part.mapInArrow(run, "lang string, f int, n double").groupBy("lang", "f").agg(F.sum("n").alias("n")).collect()  # as many rows as features and languages, at most
    langs = sorted({r["lang"] for r in counted})
    table = np.zeros((1 << BITS, len(langs)))
    for r in counted:
        table[r["f"], langs.index(r["lang"])] += r["n"]
    if not table.any():
        return langs, table
    own = table / np.maximum(table.sum(axis=0), 1.0)
    ground = own.mean(axis=1) + 1e-9
    return langs, np.log((1 - BACKGROUND) * own + BACKGROUND * (ground / ground.sum())[:, None])


def text_evidence(rows: DataFrame, langs: list[str], table: np.ndarray, text_col: str = "text", keep: list[str] | None = None, html: bool = False) -> DataFrame:
    """Adds n_words, and loglik, an array by language."""

    def run(batches):
        score = Likelihoods(table)
        for (texts,) in batches:
            n, out = [], []
            for t in c.texts_of(texts):
                own = words(unescape(bare(t)) if html else t)
                n.append(len(own))
                out.append(score(own) if langs else [])
            yield n, out

    return c.map_batches(rows, [text_col], run, [T.StructField("n_words", T.LongType()), T.StructField("loglik", T.ArrayType(T.DoubleType()))], keep)


def _softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(p: str, langs: list[str]) -> list[Column]:
    return [F.sum(F.element_at(p, i + 1)).alias(f"n{i}") for i in range(len(langs))]


def fuse(scored: DataFrame, langs: list[str], least: float = 0.5) -> DataFrame:
    """Adds lang_id, confidence and accepted to stored rows of loglik, n_words, declared, suffix, host and parent."""
    drop = ["loglik", "n_words", "declared", "suffix", "host", "parent"]
    if not langs:
        return scored.withColumns({"lang_id": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "accepted": F.col("n_words") > 0}).drop(*drop)
    n = len(langs)
    by_text = scored.where(F.col("n_words") > 0).select("declared", "suffix", "host", "parent", _softmax(F.col("loglik")).alias("p"))
    # one row for each of: all rows, each parent, each host; each value of the declaration and of the suffix
    sums = {k: by_text.groupBy(*keys).agg(*_sums("p", langs)) for k, keys in {"all": [], "parent": ["parent"], "host": ["parent", "host"], "declared": ["declared"], "suffix": ["suffix"]}.items()}
    every = sums["all"].select(F.array(*[(F.coalesce(f"n{i}", F.lit(0.0)) + 1.0) / (sum(F.coalesce(f"n{j}", F.lit(0.0)) for j in range(n)) + float(n)) for i in range(n)]).alias("p")).first()["p"]
    total = sum(F.col(f"n{i}") for i in range(n))
    parents = sums["parent"].select("parent", *[((F.col(f"n{i}") + SMOOTH * every[i]) / (total + SMOOTH)).alias(f"q{i}") for i in range(n)])
    hosts = c.stored(sums["host"].join(parents, "parent").select("parent", "host", F.array(*[F.log((F.col(f"n{i}") + SMOOTH * F.col(f"q{i}")) / (total + SMOOTH)) for i in range(n)]).alias("prior")), "hosts")
    few = hosts.limit(HOSTS + 1).count() <= HOSTS
    rows = scored.join(F.broadcast(hosts) if few else hosts, ["parent", "host"], "left")
    logs = F.zip_with(F.coalesce("prior", F.array(*[F.lit(float(np.log(x))) for x in every])), F.when(F.col("n_words") > 0, F.col("loglik")).otherwise(F.array(*[F.lit(0.0)] * n)), lambda a, b: a + b)
    for kind in ("declared", "suffix"):
        # P(value | language), smoothed; there are few values, as what isn't a language's name is null
        known = {r[kind]: [r[f"n{i}"] or 0.0 for i in range(n)] for r in sums[kind].where(F.col(kind).isNotNull()).collect()}
        column = np.sum([*known.values(), np.zeros(n)], axis=0)
        value = F.lit(None).cast("array<double>")
        for name, x in known.items():
            value = F.when(F.col(kind) == name, F.array(*[F.lit(float(np.log((x[i] + 1) / (column[i] + len(known) + 1)))) for i in range(n)])).otherwise(value)
        logs = F.zip_with(logs, F.coalesce(value, F.array(*[F.lit(0.0)] * n)), lambda a, b: a + b)
    p = rows.withColumn("__p", _softmax(logs))
    best = F.array_max("__p")
    which = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("__p", best).cast("int"))
    return p.withColumns({"lang_id": which, "confidence": best, "accepted": (F.col("n_words") > 0) & (best >= least)}).drop(*drop, "prior", "__p")


def document_evidence(docs: DataFrame, source_col: str = "source") -> dict[str, Column]:
    """A document declares nothing; its source stands for the host."""
    source = F.coalesce(F.col(c.q(source_col)).cast("string"), F.lit("")) if source_col in docs.columns else F.lit("")
    none = F.lit(None).cast("string")
    return {"declared": none, "suffix": none, "host": source, "parent": F.lit("")}


def page_evidence(langs: list[str], url_col: str = "url", html_col: str = "html") -> dict[str, Column]:
    """The html element's language, the address's first path element or the host's suffix, the host and its parent domain."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(c.q(url_col)).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))
    named = lambda x: F.when(x.isin(langs), x) if langs else F.lit(None).cast("string")
    declared = named(F.lower(F.substring(F.regexp_extract(F.col(c.q(html_col)).cast("string"), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1), 1, 2)))
    path = named(F.lower(F.regexp_extract(F.col(c.q(url_col)).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/([A-Za-z]{2})(?:[/?#]|$)", 1)))
    ends = F.lit(None).cast("string")
    for suffix, lang in SUFFIXES.items():
        ends = F.when(F.substring_index(host, ".", -1) == suffix, F.lit(lang)).otherwise(ends)
    return {"declared": declared, "suffix": F.coalesce(path, named(ends)), "host": host, "parent": F.substring_index(host, ".", -2)}


def identify(rows: DataFrame, evidence: dict[str, Column], model: tuple[list[str], np.ndarray], text_col: str = "text", keep: list[str] | None = None, html: bool = False, least: float = 0.5) -> DataFrame:
    """The kept columns with lang_id, confidence and accepted; columns of these names give way."""
    langs, table = model
    kept = rows.columns if keep is None else keep
    safe = {x: f"__own{i}" for i, x in enumerate(kept)}  # whatever they are called, they clash with nothing
    own = rows.select(*[F.col(c.q(x)).alias(safe[x]) for x in kept], *[v.alias(k) for k, v in evidence.items()], F.col(c.q(text_col)).cast("string").alias("__text"))
    scored = c.stored(text_evidence(own, langs, table, "__text", [*safe.values(), *evidence], html), "evidence")
    found = fuse(scored, langs, least)
    new = ["lang_id", "confidence", "accepted"]
    return found.select(*[F.col(safe[x]).alias(x) for x in kept if x.lower() not in new], *new)
