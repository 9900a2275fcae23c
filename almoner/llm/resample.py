"""Importance resampling towards a target distribution.

Each partition's texts go through DuckDB: SQL takes their words, lists them one a row, makes n-grams by windows over
them, and counts their buckets; the bucket of an n-gram is its CRC-32, by zlib as a registered function, modulo BUCKETS.
The bucket counts of each row are written to Parquet in the shared folder. Spark merges them, corpus against target, into
the gain of each bucket, scores each row from its own counts, and draws the best by a sliced order over all rows.

A bucket's gain is floor(1000 * ln((t+1)(S+B) / ((s+1)(T+B)))) with s of S features of the corpus, t of T of the target,
B buckets. A row's weight is the floored mean of its features' gains (0 without features); its score adds
floor(-1000 * ln(-ln(u))), u = (h + 0.5) / 2^32 with h the first 32 bits of SHA-256 of "seed:id": keeping the best scores
draws without replacement with probabilities that grow as the exponent of weight. A row's counts are at most BUCKETS
pairs, whatever its length, and one bucket may hold any part of all rows: counts are summed before they are shuffled.

Defined results: a null text has no words; a null id counts as empty in the hash and comes last among ties; rows that
repeat an id are rows of their own, with the same score if their texts are equal, drawn by their place in the table;
equal scores go to the smaller id; an empty table has no rows, an empty target no features (T = 0); rows of fewer than
LEAST_WORDS words are never drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 2024
#: UTF-8 bytes of texts that DuckDB takes at a time, and the memory it may use.
BLOCK = 4 << 20
MEMORY = "400MB"
#: Rows in a slice of the order, at most, about.
SLICE = 1 << 20

COUNTED = T.StructType().add("id", "long").add("nth", "long").add("n_words", "long").add("n_features", "long").add("bucket", T.ArrayType(T.IntegerType())).add("n", T.ArrayType(T.LongType()))


def counting_sql(least: int, most: int, buckets: int) -> str:
    """Words and bucket counts of each row of `texts` (row, text): n-grams of least to most words."""
    grams = " UNION ALL ".join(f"SELECT row, {' || '.join(['word', *(f"' ' || lead(word, {k}) OVER here" for k in range(1, n))])} AS gram FROM words{' WINDOW here AS (PARTITION BY row ORDER BY place)' if n > 1 else ''}" for n in range(least, most + 1))
    return f"""
    WITH lists AS (SELECT row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS list FROM texts),
    words AS (SELECT row, unnest(list) AS word, generate_subscripts(list, 1) AS place FROM lists),
    grams AS ({grams}),
    per_gram AS (SELECT row, gram, count(*) AS n FROM grams WHERE gram IS NOT NULL GROUP BY ALL),
    named AS (SELECT gram, crc(gram) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM per_gram)),
    per_bucket AS (SELECT row, CAST(bucket AS INTEGER) AS bucket, CAST(sum(n) AS BIGINT) AS n FROM per_gram JOIN named USING (gram) GROUP BY ALL),
    per_row AS (SELECT row, list(bucket ORDER BY bucket) AS bucket, list(n ORDER BY bucket) AS n, CAST(sum(n) AS BIGINT) AS n_features FROM per_bucket GROUP BY row)
    SELECT CAST(len(list) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(bucket, []) AS bucket, coalesce(n, []) AS n
    FROM lists LEFT JOIN per_row USING (row) ORDER BY row
    """


def _crc(words: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(x.encode()) for x in words.to_pylist()], pa.int64())


def _blocks(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows of a batch, so many at a time as hold BLOCK bytes."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
        yield ids.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def bucket_counts(docs: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """id, nth (a number of the row), n_words, n_features, and the buckets of a row's features with their counts; stored."""
    sql = counting_sql(least, most, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
        nth = TaskContext.get().partitionId() << 40
        schema = c.arrow_schema(COUNTED)
        for batch in batches:
            for ids, texts in _blocks(*batch.columns):
                con.register("texts", pa.table({"row": pa.array(np.arange(len(texts))), "text": pc.fill_null(texts, "")}))
                found = con.sql(sql).to_arrow_table()
                con.unregister("texts")
                columns = [ids, pa.array(np.arange(nth, nth + len(ids))), *(found.column(x).combine_chunks() for x in ("n_words", "n_features", "bucket", "n"))]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
                nth += len(ids)

    name = F.lit(None) if id_col is None else F.col(c.q(id_col))
    return c.stored(docs.select(name.cast("long"), F.col(c.q(text_col)).cast("string")).mapInArrow(run, COUNTED), "bucket-counts")


def merged(counts: DataFrame) -> DataFrame:
    """bucket, n over all rows."""
    pairs = counts.select(F.explode(F.arrays_zip("bucket", "n")).alias("x"))
    return pairs.groupBy(F.col("x.bucket").alias("bucket")).agg(F.sum("x.n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket: a list as long as there are buckets."""
    s, t = (dict(map(tuple, merged(x).collect())) for x in (corpus, target))  # at most `buckets` rows each
    s, t = (np.array([x.get(b, 0) for b in range(buckets)], float) for x in (s, t))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(int).tolist()


def noise(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(counts: DataFrame, gain: list[int]) -> DataFrame:
    """Adds weight, the floored mean of a row's gains."""
    table = np.array(gain, np.int64)  # as many numbers as buckets

    def fn(batches):
        for bucket, n, features in batches:
            ends = np.cumsum([0, *bucket.value_lengths().to_numpy()])
            total = np.concatenate([[0], np.cumsum(table[bucket.flatten().to_numpy()] * n.flatten().to_numpy())])[ends]
            yield [pa.array((total[1:] - total[:-1]) // np.maximum(features.to_numpy(), 1), pa.int64())]

    return c.map_batches(counts, ["bucket", "n", "n_features"], fn, [T.StructField("weight", T.LongType())], ["id", "nth", "n_words", "n_features"])


def scored(counts: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, nth, n_words, n_features, weight and score of each row."""
    return weighted(counts, gain).select(F.col("id").alias("doc_id"), "nth", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"))


def drawn(rows: DataFrame, percent: int = 10, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (stored) with the rank of those drawn: percent of the rows of enough words, best scores first, ties to the smaller id.

    Rows are cut into slices of the order, sorted in each, and numbered from what stands in the slices before. The place
    in the table is part of the order, so rows of one score and one id are cut apart too.
    """
    able = F.col("n_words") >= least_words
    n = rows.where(able).count()
    slices = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // SLICE))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("nth")]
    placed = rows.where(able).repartitionByRange(slices, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the slice, and in its low 33 bits the place there
    placed = c.stored(placed.withColumn("place", place), "slices").withColumns({"slice": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)})
    starts, ahead = [], 0
    for r in placed.groupBy("slice").agg(F.count("*").alias("n")).orderBy("slice").collect():  # a row for each slice
        starts.append((r["slice"], ahead))
        ahead += r["n"]
    before = rows.sparkSession.createDataFrame(starts, "slice long, ahead long")
    rank = F.col("ahead") + F.col("place") + 1
    placed = placed.join(F.broadcast(before), "slice").withColumn("rank", F.when(rank <= percent * n // 100, rank)).drop("slice", "place", "ahead")
    return placed.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of every row of docs."""
    counts = bucket_counts(docs, least, most, buckets, id_col, text_col)
    wanted = bucket_counts(target, least, most, buckets, None, target_text)
    rows = c.stored(scored(counts, gains(counts, wanted, buckets), seed), "scores")
    c.dropped(counts, wanted)
    return drawn(rows, percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def oracle_sql(buckets: int = BUCKETS, percent: int = 10, least_words: int = LEAST_WORDS, seed: int = SEED) -> str:
    """Of single words; CRC-32 byte by byte over a table made by its rule."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) AS t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), d AS (SELECT row_number() OVER () AS nth, doc_id, {words} AS list FROM documents
), dw AS (SELECT nth, unnest(list) AS word FROM d
), bw AS (SELECT unnest({words}) AS word FROM benchmark
), vocab AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)
), bucketed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(len(hex(word)) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(word), 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]))) % {buckets} AS bucket
  FROM vocab, crc
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN bucketed USING (word) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM bw JOIN bucketed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {buckets}.0::DOUBLE) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {buckets}.0::DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM bucketed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), sums AS (SELECT nth, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM dw JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY nth
), w AS (
  SELECT d.nth, doc_id, len(list) AS n_words, coalesce(n, 0) AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE CAST((total - ((total % n) + n) % n) // n AS BIGINT) END AS weight,
    CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN sums USING (nth)
), scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w
), ranked AS (SELECT nth, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER () AS able FROM scored WHERE n_words >= {least_words})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN r <= {percent} * able // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (nth)
"""
