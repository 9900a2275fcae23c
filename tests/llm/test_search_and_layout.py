"""Decontamination, top-k, sharding, token files, packing: against brute force, SQL and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import DATA, plain
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almoner.llm import decontam, packing, queries, sharding, tokenbin, topk

np.random.seed(0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    assert plain(queries.queries()[name](spark, DATA).toPandas()) == plain(duck.sql(queries.oracle_sql()[name]).df())


def _brute(docs, items, size):
    out = []
    for _, text in docs:
        own, hit, names = decontam.words(text), set(), set()
        for name, item in items:
            words = decontam.words(item)
            for w in [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []:
                for i in range(len(own) - len(w) + 1):
                    if tuple(own[i : i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        names.add(str(name))
        out.append((len(own), len(hit), ",".join(sorted(names))))
    return sorted(out)


@pytest.mark.parametrize("limit", [8 << 20, 12])
def test_phrases(spark, limit, monkeypatch):
    monkeypatch.setattr(decontam, "QUERY_BYTES", limit)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 15)
    docs = [(1, "a b c d a B c d x"), (2, "c d. é É"), (3, None), (4, ""), (5, "a b"), (5, "a b"), (6, "x " * 200 + "a b c d")]
    items = [(10, "a b c d"), (9, "c d"), (8, ""), (7, None), (6, "é É"), (11, "a a a b c d"), (None, "a b")]
    hits = decontam.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=3)
    got = sorted((r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), ",".join(sorted(r["items"]))) for r in hits.collect())
    assert got == _brute(docs, [x for x in items if x[0] is not None], 3)


def test_proximity(spark):
    """Against every stretch of every document."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    items = [(i, " ".join(rng.choice("abcdefghi" if i == 3 else "abcdefgh") for _ in range(rng.randint(0, 9)))) for i in range(12)]
    got = {r["doc_id"]: set(r["near_items"]) for r in decontam.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=3, slack=2).collect()}
    for i, text in docs:
        w = text.split()
        assert got[i] == {str(k) for k, item in items if item and any(set(item.split()) <= set(w[p : p + len(item.split()) + 2]) for p in range(len(w)))}


def test_decontamination_edges(spark, odd, none):
    items = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    got = decontam.digest(decontam.hits(odd, items)).collect()
    assert len(got) == 7 and sum(r["contaminated"] for r in got) == 2
    assert {r["items_sha256"] for r in got if r["n_items"] == 0} == {hashlib.sha256(b"").hexdigest()}
    assert decontam.hits(none, items).isEmpty() and decontam.hits(odd, items.limit(0)).count() == 7


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 3, 4) / 16]) for i in range(300)] + [(7, None), (8, [float("nan")] * 4), (None, [0.0] * 4), (9, [0.1, None, 0.1, 0.1]), (900, [1.0, 2.0]), (500, [])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.pmod("id", F.lit(100)) == 0, 10).collect()
    good = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for qi, qv in good:
        if qi % 100 == 0:
            best = sorted((-int(qv @ v), i) for i, v in good if i != qi and len(v) == len(qv))[:10]
            want += [(qi, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") == 0).isEmpty()


def test_large_scores(spark):
    big = [(0, [2.0**30, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, 2.0])]
    got = topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("id") == 0, 5, scale=1.0).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2**50 + 3), (2, 2**50 + 2)]


@pytest.mark.parametrize("limit", [3000, 70_000, 1 << 20])
def test_shards_fit(spark, duck, limit):
    got = sharding.shards(spark.read.parquet(f"{DATA}/documents.parquet"), limit).toPandas()
    assert got.groupby("shard").n_bytes.sum().to_dict() == got.groupby("shard").shard_bytes.first().to_dict()
    sizes = got.groupby("shard").n_bytes.agg(["sum", "count"])
    assert ((sizes["sum"] <= limit) | (sizes["count"] == 1)).all()
    names = sorted(x for x in got["shard"].unique() if "+" not in x)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    if limit > 60_000:
        assert plain(got) == plain(duck.sql(sharding.oracle_sql(limit)).df())


def test_shards_of_odd_rows(spark, odd, none):
    got = sharding.shards(odd, 60).toPandas()
    assert len(got) == 7 and (got.groupby("shard").n_bytes.sum()[got.groupby("shard").size() > 1] <= 60).all()
    assert sharding.shards(none, 60).isEmpty()
    same = spark.range(500).select(F.lit(1).alias("doc_id"), F.lit("x" * 50).alias("text"))
    pages = sharding.shards(same, 120).toPandas()
    assert len(pages) == 500 and pages.groupby("shard").n_bytes.sum().max() <= 120


@given(st.lists(st.integers(0, 1 << 40), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(numbers):
    x = np.sort(np.array(numbers, np.uint64))
    raw = tokenbin.EliasFano.encode(x)
    e = tokenbin.EliasFano(raw)
    assert e.selects(0, len(x) + 5).tolist() == x.tolist() and e.selects(300, 290).tolist() == x[300:590].tolist() and [e.select(i) for i in range(0, len(x), 17)] == x[::17].tolist()


def test_elias_fano_is_small():
    x = np.cumsum(np.random.default_rng(0).integers(1, 2000, 50_000))
    assert len(tokenbin.EliasFano.encode(x)) < 50_000 * 13 / 8 * 1.1


def _encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_tokenizer())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in texts]


def test_token_files(spark, tmp_path, odd, none, monkeypatch):
    monkeypatch.setattr(tokenbin, "FILE_IDS", 50)
    monkeypatch.setattr(tokenbin, "DOCS", 2)
    folder = f"file://{tmp_path}/ids"
    manifest = tokenbin.write(odd, folder, queries.word_tokenizer())
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenbin.read(spark, folder, manifest).collect()))
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = _encoded([t for _, t in rows])
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    assert got == [(int(a), i, len(x), zlib.crc32(x.tobytes())) for a, (i, _), x in zip(starts, rows, ids, strict=False)]
    first = manifest.orderBy("file").first()["file"]
    f = tokenbin.TokenFile((tmp_path / "ids" / first).read_bytes())
    assert f.document(0).tolist() == ids[0].tolist()
    empty = f"file://{tmp_path}/none"
    assert tokenbin.read(spark, empty, tokenbin.write(none, empty, queries.word_tokenizer())).isEmpty()


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=80, deadline=None)
def test_packing_and_its_bound(lengths):
    x = np.array(sorted(lengths, reverse=True), np.int64)
    bins, offsets, fill = packing.best_fit_decreasing(x, 40)
    assert fill.sum() == x.sum() and (fill <= 40).all()
    for b in range(len(fill)):
        own = np.argsort(offsets[bins == b])
        assert (np.concatenate([[0], np.cumsum(x[bins == b][own])[:-1]]) == offsets[bins == b][own]).all()
    assert packing.lower_bound(x, 40) <= len(fill) and packing.lower_bound(x, 40) >= -(-int(x.sum()) // 40)


def test_exchange_ends(spark):
    """Lengths of a third and a little more, which no bound certifies: rounds end when they save nothing."""
    from almoner.llm import _common as c

    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.element_at(F.array(*[F.lit(x) for x in (1364, 1369, 1376)]), (F.pmod("id", F.lit(3)) + 1).cast("int")).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"), F.col("id").alias("uid"))
    got = packing.pack(c.stored(rows, "pieces"), partition_pieces=300).toPandas()
    assert len(got) == 3000 and got.groupby("sequence_id").length.sum().max() <= 4096 and got["round"].max() <= 4
    assert got.sequence_id.nunique() <= 1.5 * packing.lower_bound(np.sort(got.length.to_numpy())[::-1], 4096)


def test_chunks_encode_as_whole_texts():
    from almoner.llm import _common as c
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(queries.word_tokenizer()), c.encoder(queries.word_tokenizer())
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("abZÉßéİı 0'9.,!?-_\n\t\u200bя字́😀<|endoftext|>") for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(own.ids(text), own.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_bounds_are_bounds():
    assert packing.lower_bound(np.array([21] * 7), 40) == 7 and packing.lower_bound(np.array([14, 14, 14]), 40) == 2


@pytest.mark.parametrize("pieces", [4096, 40])
def test_packed(spark, odd, none, pieces):
    from almoner.llm import _common as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = packing.pack(c.stored(packing.pieces(docs, queries.word_tokenizer()), "pieces"), partition_pieces=pieces).toPandas()
    rows = docs.collect()
    assert got.length.sum() == sum(map(len, _encoded([r["text"] for r in rows])))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 4096 and (s.offset.to_numpy() == np.concatenate([[0], np.cumsum(s.length.to_numpy())[:-1]])).all()
    ids = {}
    for r, x in zip(rows, _encoded([r["text"] for r in rows]), strict=True):
        ids.setdefault(r["doc_id"], x)
    for r in got[got.doc_id.notna()].itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 or r.doc_id in (1, 2, 3, 4, 6)  # these ids are also of odd rows
    least = packing.lower_bound(np.sort(got.length.to_numpy())[::-1], 4096)
    assert got.sequence_id.nunique() <= least * 1.02 + 1
    assert packing.pack(c.stored(packing.pieces(none, queries.word_tokenizer()), "pieces")).isEmpty()
