"""BPE against the library, whitening against a whole eigendecomposition, resampling against SQL and plain counting."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, plain
from hypothesis import given, settings
from hypothesis import strategies as st

from almoner.llm import bpe, queries, resample, whiten


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.byte_tokenizer())


@pytest.fixture(scope="module")
def rules():
    return bpe.ByteBPE(queries.byte_tokenizer())


TEXT = st.text(st.one_of(st.sampled_from("ab 's<|endoftext|>\n\t　é"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_ids_as_the_library_gives_them(library, rules, texts):
    for text, ids in zip(texts, rules.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert rules.decode(ids.tolist()) == library.decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50_300), max_size=12))
def test_any_ids_are_decoded_as_by_the_library(library, rules, ids):
    assert rules.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_runs_and_letters_of_late_unicode(library, rules):
    texts = ["a" * 4001, "ab" * 3000, " " * 999, "<|endoftext|>" * 3 + "x", "꟎ ՘a 1࢏", "x\x00y", "é" * 500, "don't 'ts"]
    assert [x.tolist() for x in rules.encode(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_characters_that_are_cut_here_are_cut_as_by_the_library(library):
    """Every character for which CHUNK is used, among letters, figures, marks and blanks."""
    settled = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000 and bpe.SETTLED.fullmatch(chr(x))]
    for k in range(0, len(settled), 4000):
        text = "".join(f"a{x}a 1{x}1 -{x}- {x} {x}{x}b\n" for x in settled[k : k + 4000])
        assert bpe.CHUNK.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_order_of_merges_is_checked():
    vocab = {x: i for i, x in enumerate(bpe.byte_alphabet())} | {"ab": 256, "abc": 257}
    assert [x.tolist() for x in bpe.PairIndex(vocab, [("a", "b"), ("ab", "c")]).encode([b"abcab", b"", b"c"])] == [[257, 256], [], [vocab["c"]]]
    with pytest.raises(ValueError):
        bpe.PairIndex(vocab, [("ab", "c"), ("a", "b")])


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBPE(queries.word_tokenizer())


def test_bpe_query(spark, library):
    texts = dict(map(tuple, spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()))
    got = queries.op12_bpe_pair_index(spark, DATA).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_bpe_of_odd_rows(spark, odd, none, library, monkeypatch):
    path = queries.byte_tokenizer()
    coded = bpe.decode(bpe.encode(odd, path), path)
    rows = coded.collect()
    assert len(rows) == 7 and all(r["decoded"] == (r["text"] or "") for r in rows)
    assert sorted(len(r["ids"]) for r in rows) == sorted(len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows)
    assert bpe.encode(none, path).isEmpty() and bpe.encode(none, path, outputs=tuple(bpe.OUTPUTS)).isEmpty()
    lists = spark.createDataFrame([(1, None), (2, []), (3, [104, None, 99999, -1, 72]), (4, [50256])], "k int, ids array<int>")
    assert {r["k"]: r["decoded"] for r in bpe.decode(lists, path).collect()} == {1: "", 2: "", 3: library.decode([104, 72]), 4: "<|endoftext|>"}
    told = bpe.encode(odd.select("doc_id", "text"), path, outputs=tuple(bpe.OUTPUTS)).collect()
    assert all(r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest() for r in told)


def _whole(vectors, scale=64, shift=1_000_000):
    x = np.floor(scale * np.array(vectors, float)).astype(np.int64) + shift
    n = len(x)
    centred = (n * x - x.sum(0)) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, centred, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("d, spread", [(3, 0.8), (64, 0.97), (200, 0.95)])
def test_whitening(spark, d, spread):
    rng = np.random.default_rng(d)
    vectors = rng.standard_normal((400, d)) * spread ** np.arange(d) * 3 + rng.standard_normal(d) * 50
    got = whiten.whitened(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)).toPandas()
    x, centred, values, axes = _whole(vectors)
    k = min(d, 32)
    z = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    assert z.shape == want.shape
    assert np.abs(z * np.sign((z * want).sum(0)) - want).max() < 1e-7
    assert np.allclose(got.groupby("component")["explained"].first(), (values / values.sum())[:k], rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert np.isclose(got["identity_error"].iloc[0], np.abs(z.T @ z / len(z) - np.eye(k)).max(), atol=1e-9)
    assert got.groupby("vec_id")["deviation"].first().tolist() == ((400 * x - x.sum(0)) ** 2).sum(1).tolist()
    assert got["residual"].max() <= whiten.CERTIFIED * values[0] and (got["n"] == 400).all()


def test_lobpcg_needs_several_steps():
    """Far more dimensions than a step can span, and close eigenvalues."""
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.standard_normal((500, 500)))[0]
    true = np.concatenate([np.linspace(2, 1.9, 40), np.linspace(1.8, 0.1, 460)])
    matrix, passes = axes * true @ axes.T, []
    values, vectors, residuals = whiten.lobpcg(lambda b: passes.append(b.shape) or matrix @ b, 500, 32)
    assert len(passes) > 3 and np.allclose(values, true[:32], rtol=1e-9) and residuals.max() < 1e-8
    assert np.abs(np.linalg.norm(axes[:, :32].T @ vectors, axis=0) - 1).max() < 1e-6


def test_whitening_of_odd_rows(spark, odd):
    rng = random.Random(3)
    good = [(i, [rng.random(), rng.random(), 0.5]) for i in range(40)]
    rows = [*good, good[0], (None, [0.1, 0.9, 0.5]), (100, None), (101, [0.1, None, 0.2]), (102, [0.1, float("nan"), 0.2]), (103, [0.1, float("inf"), 0.2]), (104, [1.0]), (105, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n int, whitened string")
    got = whiten.whitened(df).collect()
    assert len(got) == 42 * 2 and {r["component"] for r in got} == {1, 2}  # the third dimension has no variance
    assert sum(r["vec_id"] == 0 for r in got) == 4 and sum(r["vec_id"] is None for r in got) == 2
    assert whiten.whitened(df.where("false")).isEmpty()
    assert whiten.whitened(df.where("vec_id = 3")).isEmpty()
    equal = spark.createDataFrame([(i, [0.25, 0.5]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whiten.whitened(equal).isEmpty()


def _plain_resample(docs, target, least, most, buckets, percent, least_words, seed):
    import re

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(x.lower() if "A" <= x <= "Z" else x for x in text or ""))

    def features(text):
        w = words(text)
        return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(w) - n + 1))

    s, t = sum((features(x) for _, x in docs), Counter()), sum((features(x) for x in target), Counter())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for name, text in docs:
        f = features(text)
        weight = sum(gain[b] * n for b, n in f.items()) // f.total() if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        out.append([name, len(words(text)), f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("least, most", [(1, 1), (1, 3), (2, 2)])
@pytest.mark.parametrize("block", [4 << 20, 30])
def test_resampling(spark, monkeypatch, least, most, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    rng = random.Random(least * 10 + most)
    docs = [(i, " ".join(rng.choice(["Alpha", "beta", "Ünder", "x9", "--", "don't", "é"]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    docs += [(None, "alpha beta " * 9), (None, None), (61, ""), (7, docs[7][1]), (62, "a\x00b" * 11)]
    target = ["alpha beta x9", None, "", "Beta alpha"]
    frame = spark.createDataFrame([(*d, 1, 1.0) for d in docs], "doc_id long, text string, nth int, score double").repartition(3)
    got = resample.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), least, most, 97, 30, 6, 5).collect()
    assert sorted(map(tuple, got), key=repr) == _plain_resample(docs, target, least, most, 97, 30, 6, 5)


def test_resampling_of_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("alpha beta",)], "text string")
    got = resample.resample(odd, target, percent=100, least_words=1).collect()
    assert len(got) == 7 and sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, sum(r["n_words"] > 0 for r in got) + 1))
    assert resample.resample(none, target).isEmpty()
    assert len(resample.resample(odd, target.where("false")).collect()) == 7


def test_equal_rows_are_cut_into_slices(spark, monkeypatch):
    """A third of all rows, with one id and one score, is not one slice."""
    docs = spark.createDataFrame([(None if i % 3 else i, "one two three") for i in range(300)], "doc_id long, text string")
    got = resample.resample(docs, docs.limit(1), percent=50, least_words=3).collect()
    ranked = sorted((r["rank"], r["score"]) for r in got if r["rank"])
    assert [a for a, _ in ranked] == list(range(1, 151)) and [-b for _, b in ranked] == sorted(-r["score"] for r in got)[:150]


@pytest.mark.parametrize("name", ["op11_lobpcg_whitening", "op12_bpe_pair_index", "op13_importance_resampling"])
def test_does_not_hang_on_partitions(spark, monkeypatch, name):
    once = plain(queries.queries()[name](spark, DATA).toPandas().drop(columns=["whitened", "residual", "identity_error", "explained"], errors="ignore"))
    table = queries._table
    monkeypatch.setattr(queries, "_table", lambda *a: table(*a).repartition(7))
    assert plain(queries.queries()[name](spark, DATA).toPandas().drop(columns=["whitened", "residual", "identity_error", "explained"], errors="ignore")) == once
