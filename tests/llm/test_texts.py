"""Secrets, languages, toxicity, quality, near-duplicates, the pipeline: against brute force and held-out labels."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from almoner.llm import langid, near_dup, quality, queries, secrets, toxicity


def _scan(text: str) -> list[tuple[str, int, int]]:
    """The base spans by the plain patterns, one character at a time."""
    out = []
    for kind, pattern, group, least in (("assign", secrets.ASSIGN, 2, 6), ("access", secrets.ACCESS, 0, 20), ("hex", secrets.HEX, 0, 24)):
        at = 0
        while m := pattern.search(text, at):
            at = m.end()
            if len(m[group]) >= least:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


@given(st.text(alphabet="AKIa0f9=: \"'tokensrpwd/é\n", max_size=80), st.sampled_from(["token = ", "Secret:", "AKIA", "apikey='", "0" * 20, ""]))
@settings(max_examples=200, deadline=None)
def test_base_spans(text, put):
    whole = text[: len(text) // 2] + put + text[len(text) // 2 :]
    assert [x[:3] for x in secrets.spans_of(whole) if x[0] in secrets.LEAST] == _scan(whole)


def test_links():
    kinds = lambda t: [x[0] for x in secrets.spans_of(t)]
    assert kinds("user=bob77 and then Ab3dEf6hIj9kLm2nOp5q") == ["identifier", "secret"]
    assert kinds("user=bob77 only") == [] and kinds("Ab3dEf6hIj9kLm2nOp5q only") == []
    assert kinds("user=bob77\n\nAb3dEf6hIj9kLm2nOp5q") == []
    assert kinds("user=bob77" + " x" * 400 + " Ab3dEf6hIj9kLm2nOp5q") == []
    assert kinds("db.host.internal:5432 password=hunter22") == ["endpoint", "assign"]
    assert secrets.mask("a token=abcdef b", secrets.spans_of("a token=abcdef b")) == "a [ASSIGN] b"


def test_links_against_pairs():
    rng = random.Random(3)
    for _ in range(100):
        parts, at = [], 0
        for _ in range(rng.randint(0, 25)):
            at += rng.randint(1, 300)
            parts.append((rng.choice(secrets.KINDS), at, at + rng.randint(1, 40)))
        got = secrets.linked(" " * (at + 50), parts, 150)
        for k, a, b in parts:
            role = secrets.ROLE[k]
            near = any((secrets.ROLE[x] != "secret") if role == "secret" else secrets.ROLE[x] == "secret" for x, c, d in parts if 0 <= max(c - b, a - d) <= 150)
            assert ((k, a, b) in got) == near


def test_parts_of_one_string_are_not_linked():
    text = "see https://example.com/articles/2024/05/why-this-matters and more"
    assert secrets.spans_of(text) == []


def test_planted_links():
    """Parts in one scope are reported, lone ones are not: exact over planted texts."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghjkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(24)) + "47"
    fill = lambda: " ".join(rng.choice(["river", "stone", "green", "table"]) for _ in range(12))
    wrong = 0
    for k in range(300):
        secret = word()
        parts = [f"user: admin{k}", secret, "https://api.example.com/v1"]
        kind = k % 4
        text = [f"{fill()} {parts[0]} {fill()}\n{secret} {fill()}", f"{fill()} {secret}\n{parts[2]}", f"{fill()} {secret} {fill()}", f"{parts[0]}\n\n{fill()} {secret}"][kind]
        found = {text[a:b] for name, a, b, _ in secrets.spans_of(text) if name == "secret"}
        wrong += found != ({secret} if kind < 2 else set())
    assert wrong == 0


def test_secret_rows(odd, none):
    r = {x["doc_id"]: x for x in secrets.digest(odd).collect()}
    assert (r[6]["n_assign"], r[6]["n_access"], r[6]["n_hex"]) == (1, 1, 0) and r[2]["spans"] == ""
    masked = secrets.redact(odd)
    assert masked.columns == odd.columns and masked.count() == 7
    texts = {x["doc_id"]: x["text"] for x in masked.collect()}
    assert texts[2] is None and texts[3] == "" and not re.search("AKIAABC|abcdef123456", texts[6])
    assert secrets.digest(none).isEmpty()


def test_languages(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op3_language(spark, DATA).toPandas()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    own = got[got.doc_id.notna()]
    assert (own.lang_id == own.doc_id.map(lang)).mean() > 0.98 and got[got.page_id.notna()].lang_id.notna().all()
    model = langid.fit(docs)
    rows = {r["doc_id"]: r for r in langid.identify(odd, langid.document_evidence(odd), model).collect()}
    assert not rows[2]["accepted"] and not rows[3]["accepted"] and rows[1]["lang_id"] == "en"
    assert langid.identify(none, langid.document_evidence(none), langid.fit(none)).isEmpty()
    nothing = langid.identify(odd, langid.document_evidence(odd), langid.fit(odd.where("lang IS NULL")), keep=["doc_id"]).collect()
    assert len(nothing) == 7 and all(r["lang_id"] is None for r in nothing)


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    new = docs.where(part == 1)
    got = langid.identify(new, langid.document_evidence(new), langid.fit(docs.where(part == 0)), keep=["doc_id", "lang"]).toPandas()
    assert len(got) > 50 and (got.lang_id == got.lang).mean() > 0.98


def test_unknown_words_favour_no_language(spark):
    train = [("en", "the and of with house garden " * 50), ("de", "der und die mit haus")]
    langs, table = langid.fit(spark.createDataFrame(train, "lang string, text string"))
    score = langid.Likelihoods(table)(langid.words("qqqq jjjjj"))
    assert langs == ["de", "en"] and abs(score[0] - score[1]) < 1e-9


def test_fused_posteriors(spark):
    """Against Bayes' rule in plain Python, over the sums of what the texts alone say."""
    train = spark.createDataFrame([("en", "the and of with house garden"), ("de", "der und die mit haus garten")], "lang string, text string")
    model = langid.fit(train)
    langs, table = model
    rows = [(i, f"http://h{i % 3}.{'a' if i % 2 else 'b'}.net/x", f"<html lang='{'en' if i % 5 else 'de'}'>" + ["the and", "der und haus", "", "qqq house"][i % 4]) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in langid.identify(pages, langid.page_evidence(langs), model, text_col="html", keep=["page_id"], html=True).collect()}
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    texts = {i: langid.words(langid.bare(h)) for i, _, h in rows}
    lik = {i: langid.Likelihoods(table)(texts[i]) for i, _, _ in rows}
    host = {i: u.split("/")[2] for i, u, _ in rows}
    parent = {i: ".".join(host[i].split(".")[-2:]) for i in host}
    said = {i: "en" if i % 5 else "de" for i in host}
    add = lambda keep: sum((soft(lik[j]) for j in texts if texts[j] and keep(j)), np.zeros(2))
    every = (add(lambda j: True) + 1) / (add(lambda j: True).sum() + 2)
    for i in texts:
        q = (add(lambda j: parent[j] == parent[i]) + 10 * every) / (add(lambda j: parent[j] == parent[i]).sum() + 10)
        own = add(lambda j: host[j] == host[i])
        logs = np.log((own + 10 * q) / (own.sum() + 10)) + (lik[i] if texts[i] else 0)
        by = {v: add(lambda j, v=v: said[j] == v) for v in ("en", "de")}
        logs = logs + np.log((by[said[i]] + 1) / (sum(by.values()) + 3))
        p = soft(logs)
        assert got[i]["lang_id"] == langs[int(p.argmax())] and abs(got[i]["confidence"] - p.max()) < 1e-9


def test_markup_is_stripped_in_linear_time():
    import time

    assert langid.bare("a<b>c</b><script>x<y></SCRIPT >d<!-- <p> -->e<style>f</style>g<i") == "a c  d e g<i"
    assert langid.bare("<script a>b<!-- c>d").split() == ["b", "d"] and langid.bare("1 < 2") == "1 < 2"
    began = time.time()
    langid.bare("<script <!-- <style " * 50_000)
    assert time.time() - began < 5


def test_evidence_outweighs(spark):
    """Without words the host, the markup and the address decide."""
    rows = [(i, f"http://h{i % 2}.a.net/{'en' if i % 2 else 'de'}/{i}", f"<html lang='{'en' if i % 2 else 'de'}'>" + ("the and of with house" if i % 2 else "der und die mit haus")) for i in range(60)]
    rows += [(100, "http://h1.a.net/x", "<html>"), (101, "http://new.b.net/de/1", "<html lang='de'>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    train = spark.createDataFrame([("en", "the and of with house garden"), ("de", "der und die mit haus garten")], "lang string, text string")
    model = langid.fit(train)
    got = {r["page_id"]: r["lang_id"] for r in langid.identify(pages, langid.page_evidence(model[0]), model, text_col="html", keep=["page_id"], html=True).collect()}
    assert got[100] == "en" and got[101] == "de" and all(got[i] == ("en" if i % 2 else "de") for i in range(60))


def _labelled(n: int, bad: bool, seed: int) -> list[tuple[int, str, int]]:
    rng = random.Random(seed)
    words = ["haus", "baum", "river", "stone", "green", "table", "seven", "window", "paper", "cloud"]
    out = []
    for i in range(n):
        y = rng.random() < 0.4
        lines = [" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(rng.randint(2, 9))]
        if y:
            lines.insert(rng.randint(0, len(lines)), "%%% $$$ *** ### !!! ***" if bad else f"what a {rng.choice(['moron', 'clown', 'idiot'])} you are.")
        out.append((i, "\n".join(lines), int(y)))
    return out


def test_toxicity(spark, odd, none):
    rows = spark.createDataFrame(_labelled(400, False, 1), "doc_id long, text string, y int").select("doc_id", "y", "text")
    model = toxicity.train(rows)
    new = _labelled(200, False, 2)
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string, y int"), model).collect()}
    assert np.mean([(got[i]["score"] >= 0.5) == y for i, _, y in new]) > 0.97
    for i, text, y in new:
        found = [text[o["start"] : o["end"]] for o in got[i]["offending"]]
        assert all("what a" in x for x in found) and (not y or found)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows) and toxicity.score(none, model).isEmpty()
    assert all(r["score"] == 0 for r in toxicity.score(odd, None).collect())
    assert toxicity.locate(toxicity.score(spark.createDataFrame(new, "doc_id long, text string, y int"), model)).where("sentence LIKE '%what a%'").count() >= sum(y for *_, y in new)


def test_noisy_or():
    x = [-1.0, 0.3, -4.0]
    assert abs(toxicity.noisy_or(x) - (1 - np.prod([1 - 1 / (1 + np.exp(-v)) for v in x]))) < 1e-12 and toxicity.noisy_or([]) == 0


def test_forward_backward_against_all_labellings():
    import itertools

    rng = np.random.default_rng(2)
    odds, step = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    length = np.array([5, 1, 3])
    good, counts = quality.forward_backward(odds, step, length, np.ones(3))
    want = np.zeros((2, 2))
    for k in range(3):
        n, z, marginal, pair = length[k], 0.0, np.zeros(5), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(odds[k, t] * x for t, x in enumerate(labels)) + sum(step[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            z += p
            marginal[:n] += p * np.array(labels)
            for a, b in zip(labels, labels[1:], strict=False):
                pair[a, b] += p
        assert np.allclose(good[k, :n], marginal[:n] / z)
        want += pair / z
    assert np.allclose(counts, want)


def test_a_million_lines():
    """A long chain is scored by itself, next to short ones, in bounded memory."""
    import resource

    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=quality.N_FEATURES), rng.normal(size=(2, 2)), 1.0, 0.0, rng.normal(size=quality.N_FEATURES), rng.uniform(1, 2, quality.N_FEATURES))
    texts = ["\n" * 1_000_000, *["a b.\nc d"] * 600]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    odds = [model.odds(quality.text_lines(t)[0]) for t in texts]
    found = model.marginals(odds)
    assert [len(x) for x in found[:2]] == [1_000_001, 2] and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000
    x = quality.beside(quality.text_lines(texts[1])[0])
    assert np.allclose(odds[1], ((x - model.mean) / model.scale) @ model.w)


def test_quality(spark, odd, none):
    data = [(i, t, 1 - y) for i, t, y in _labelled(300, True, 3)]
    model, share = quality.train(spark.createDataFrame(data, "doc_id long, text string, y int").select("doc_id", "y", "text"))
    new = [(i, t, 1 - y) for i, t, y in _labelled(200, True, 4)]
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(new, "doc_id long, text string, y int"), model, share).collect()}
    assert np.mean([(got[i]["score"] >= 0.5) == (y == 1) for i, _, y in new]) > 0.95
    assert all(len(got[i]["line_good"]) == t.count("\n") + 1 for i, t, _ in new)
    rows = quality.score(odd, model, share).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows) and quality.score(none, model, share).isEmpty()
    assert all(r["score"] == 0.25 for r in quality.score(odd, None, 0.25).collect())


@given(st.lists(st.integers(0, 6), max_size=40), st.lists(st.integers(0, 6), max_size=40), st.integers(0, 45))
@settings(max_examples=150, deadline=None)
def test_banded_alignment(a, b, band):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + 1 if a[i] == b[j] and abs(i - j) <= band else 0)
    assert near_dup.aligned(len(a), near_dup.Masks(np.array(a, int)), b, band) == best[-1, -1]


def _copies(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    new = lambda n: [f"w{rng.randint(0, 4000)}" for _ in range(n)]
    passage, out = new(25), []
    for g in range(40):
        base = new(rng.randint(20, 120)) + (passage if g % 2 else [])
        for k in range(rng.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(k and int(0.04 * len(t)) + 1):
                t[rng.randrange(len(t))] = f"e{rng.randint(0, 10**6)}"
            out.append((len(out), " ".join(t)))
    return out + [(len(out), out[0][1].upper() + "!"), (len(out) + 1, "")]


def _classes(rows: list[tuple[int, str]]) -> dict[int, int]:
    """The least id of each row's class, by comparing all pairs."""
    codes = {i: np.array([hash(w) for w in near_dup.letters(t).split()]) for i, t in rows}
    parent = {i: i for i, _ in rows}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i, _ in rows:
        for j, _ in rows:
            if i < j and root(i) != root(j) and near_dup.similar(codes[i], codes[j], 0.8):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}


@pytest.mark.parametrize("task_edges", [0, 10**6])
def test_near_duplicates(spark, monkeypatch, task_edges):
    monkeypatch.setattr(near_dup, "TASK_EDGES", task_edges)
    rows = _copies(5)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _classes(rows)


@pytest.mark.parametrize("block", [7, 512])
def test_near_duplicates_in_a_crowd(spark, monkeypatch, block):
    """Copies that share no five words in a row but the crowd's passage are compared with each other."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage, rows = new(70), []
    for g in range(30):
        own = new(30)
        for k in range(1 + g % 3):
            # every third word of its own is another, so no five words in a row are
            rows.append((len(rows), " ".join(passage + [f"e{g}x{k}x{i}" if k and i % 3 == 0 else w for i, w in enumerate(own)])))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _classes(rows) and len(set(got.values())) == 30


def test_near_duplicates_at_the_threshold(spark):
    """Lone pairs at 0.80 to 0.85, words changed anywhere, some with a passage that many share: all pairs against what is found."""
    rng = random.Random(12)
    new = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    passage, rows = new(60), []
    for g in range(300):
        n = rng.choice([30, 60, 100, 250, 400])
        base = new(n) + (passage if g % 3 == 0 else [])
        other = list(base)
        for i in rng.sample(range(n), int(n * rng.uniform(0.15, 0.2))):
            other[i] = f"e{rng.randint(0, 10**6)}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    codes = {i: near_dup.hashed(t) for i, t in rows}
    true = [g for g in range(300) if near_dup.similar(codes[2 * g], codes[2 * g + 1], 0.8)]
    found = sum(got[2 * g + 1] == got[2 * g] for g in true)
    assert len(true) > 290 and found / len(true) >= 0.9 and all(got[i] in (i, i - 1) for i in got)


def test_five_whole_words():
    """Changing every fourth word leaves no k-mer in common."""
    text = [f"w{i}" for i in range(200)]
    other = [f"e{i}" if i % 4 == 0 else w for i, w in enumerate(text)]
    x, y = (set(near_dup.kmers(near_dup.hashed(" ".join(t))).tolist()) for t in (text, other))
    assert len(x) == 196 and not x & y
    again = near_dup.kmers(near_dup.hashed("a b c d e " * 3))
    assert len(set(again.tolist())) == 11  # the second occurrence of a k-mer is another


def _edited(rng, n, kind):
    """A text of n words and one with up to a fifth of them changed."""
    new = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    a = new(n)
    b = a.copy()
    if isinstance(kind, int):
        at = np.arange(rng.integers(0, kind), n, kind)
    elif kind == "random":
        at = rng.choice(n, n // 5, replace=False)
    elif kind == "cluster":
        at = rng.integers(0, n - n // 5 + 1) + np.arange(n // 5)
    else:
        at = np.flatnonzero(np.isin(np.arange(n) % 10, (0, 3)))
    b[at] = new(len(at))
    return a, b


@pytest.mark.parametrize("kind", [5, 6, 7, "random", "cluster", "uneven"])
@pytest.mark.parametrize("n", [51, 100, 400])
def test_sketches_find_pairs_wherever_edits_stand(kind, n):
    rng, hits = np.random.default_rng(n), 0
    for _ in range(150):
        x = near_dup.buckets(np.stack([near_dup.sketched(w) for w in _edited(rng, n, kind)]))
        hits += (x[0] == x[1]).any()
    assert hits / 150 >= 0.9


def test_evenly_spread_edits(spark):
    """Lone pairs with every fifth, sixth or seventh word changed, as filled-in forms have, against all pairs."""
    rng, rows = random.Random(3), []
    for g in range(120):
        n, q = rng.choice([51, 60, 100, 400]), 5 + g % 3
        base, at = [f"g{g}w{i}" for i in range(n)], rng.randrange(q)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(f"e{g}x{i}" if i % q == at else w for i, w in enumerate(base)))]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    true = [g for g in range(120) if near_dup.similar(near_dup.hashed(rows[2 * g][1]), near_dup.hashed(rows[2 * g + 1][1]), 0.8)]
    assert len(true) > 100 and sum(got[2 * g + 1] == 2 * g for g in true) / len(true) >= 0.9 and all(got[i] in (i, i - 1) for i in got)


def test_word_hashes(monkeypatch):
    text = "Ab ab, ÀB  é-e\n" + "x" * 3000 + " z"
    whole = near_dup.hashed(text)
    monkeypatch.setattr(near_dup, "PIECE", 4)
    assert (near_dup.hashed(text) == whole).all() and len(whole) == 7 and whole[0] == whole[1] != whole[2] and not len(near_dup.hashed(" .\n"))


def test_two_very_long_copies():
    """200,000 words, nearly all different, in bounded memory."""
    import resource

    a = near_dup.coded(near_dup.mix(np.arange(200_000, dtype=np.uint64)))
    b = np.delete(a, np.arange(5, 200_000, 50))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert near_dup.similar(a, b, 0.8)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


@given(st.lists(st.integers(0, 400), min_size=1, max_size=600), st.lists(st.integers(0, 400), min_size=1, max_size=600))
@settings(max_examples=60, deadline=None)
def test_bins_rule_out_no_pair(a, b):
    from collections import Counter

    x, y = (np.repeat(np.array(v, "<u4"), 3) for v in (a, b))
    most = near_dup.in_common(np.frombuffer(near_dup.binned(x), np.uint8), np.frombuffer(near_dup.binned(y), np.uint8)[None])[0]
    assert most >= (Counter(x.tolist()) & Counter(y.tolist())).total()


def test_buckets_are_shuffled_once_for_each_pair(spark):
    """Two copies share many buckets but are one row; a bucket's name has 48 bits."""
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:-1] + [f"e{k}"])) for k in range(6)] + [(9, " ".join(f"x{i}" for i in range(200)))]
    made = near_dup.nodes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id"))
    state = near_dup.gathered(made.where("n is not null")).collect()
    assert len({(r["leader"], r["node"]) for r in state}) == len(state) and sum(len(r["buckets"]) for r in state) > 2 * len(state)
    assert all(0 <= b < 1 << 48 for r in state for b in r["buckets"])


def test_order_matters():
    w = near_dup.mix(np.arange(40, dtype=np.uint64))
    turned = np.concatenate([w[20:], w[:20]])
    a, b = near_dup.picked(near_dup.kmers(w)), near_dup.picked(near_dup.kmers(turned))
    same_sets = (np.sort(a, axis=1) == np.sort(b, axis=1)).all(axis=1)
    assert (a == b).all(axis=1).sum() < same_sets.sum()


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_dup.classes(odd).collect()
    ids = {r["doc_id"]: r["class_id"] for r in got}
    assert len(got) == 7 and ids[2] == ids[3] == 2 and ids[None] is None and ids[4] == 4
    assert near_dup.classes(none).isEmpty()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DATA)
        path = f"{spark.sparkContext.getCheckpointDir()}/test-{name}-{id(spark)}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.count()
        if name != "packing":
            assert docs.columns == before.columns
    ids = docs.select("doc_id").distinct().count()
    assert seen["secrets"] == ids and seen["language"] >= seen["near_duplicates"] >= seen["decontamination"] == seen["secrets"] > 100
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096


def test_pipeline_of_odd_rows(spark, odd, none):
    docs = odd.withColumn("n_chars", odd["id"].cast("long"))
    out = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert out.count() == 5 and corpus_pipeline.near_duplicates(spark, docs.where("false"), DATA).isEmpty()
    assert corpus_pipeline.decontaminated(spark, docs, DATA).count() == 7 and corpus_pipeline.masked(spark, docs, DATA).count() == 7


def test_models_learn_only_from_their_part(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    import zlib

    part = toxicity.sample(docs, labels, "toxic", ~(queries.c.crc_bucket("doc_id", 5) == 0), 10**6, 10**6).collect()
    assert part and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in part)


@pytest.mark.parametrize("name", ["op6_toxicity", "op8_line_quality"])
def test_scores(spark, name):
    r = queries.queries()[name](spark, DATA).toPandas()
    assert len(r) == spark.read.parquet(f"{DATA}/documents.parquet").count() and r.score.between(0, 1).all() and (r.predicted == (r.score >= 0.5)).all()
