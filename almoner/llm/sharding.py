"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the leading bits of a hash of the document id. A bucket over the byte limit, and only such a
one, is split on the next bit, until each fits. A step looks at the next STEP bits of the rows of buckets that are still too
large: sizes are summed once for the longest prefix and rolled up from there to the STEP - 1 shorter ones, so a bucket has
2 ** STEP sums at most, whatever its rows, and a row takes part in as many sums as its shard's depth has steps. Bits 1-60 come from the id, 61-120 from the text, so rows
that repeat an id part by their texts. Rows that repeat both are counted, not gathered, and paged.

Defined results: null ids and texts hash and weigh as empty ones; a document over the limit ends in a shard of its own; an
empty table has no shards. A shard's name is its bits, and for pages of equal rows the bits, "+" and the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

BYTE_LIMIT = 64 << 20
STEP = 8
BITS = 120


def _bits(x: Column) -> Column:
    return F.lpad(F.conv(F.substring(F.md5(x), 1, 15), 16, 2), 60, "0")


def shards(docs: DataFrame, byte_limit: int = BYTE_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes and shard_docs of every row."""
    text = F.coalesce(F.col(c.q(text_col)).cast("string"), F.lit(""))
    key = F.coalesce(F.col(c.q(id_col)).cast("string"), F.lit(""))
    rest = c.stored(docs.select(F.col(c.q(id_col)).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.concat(_bits(key), _bits(text)).alias("bits")), "sizes")
    done, above = None, 0
    for step in range(STEP, BITS + 1, STEP):
        leaves = _leaves(rest, byte_limit, above, step)
        if not above:
            leaves = F.broadcast(leaves)  # 2 ** STEP rows at most
        found = rest.withColumn("prefix", F.substring("bits", 1, step)).join(leaves, "prefix", "left")
        fits = found.where(F.col("depth").isNotNull()).select("doc_id", "n_bytes", F.expr("substring(bits, 1, depth)").alias("shard"), "depth", "shard_bytes", "shard_docs")
        done = fits if done is None else done.unionByName(fits)
        rest, above = found.where(F.col("depth").isNull()).select("doc_id", "n_bytes", "bits"), step
        if not _too_large(leaves):
            return done
    return done.unionByName(_pages(rest, byte_limit))


def _too_large(leaves: DataFrame) -> bool:
    return not leaves.where(F.col("depth").isNull()).isEmpty()


def _leaves(rows: DataFrame, byte_limit: int, above: int, step: int) -> DataFrame:
    """For each prefix of step bits: depth, bytes and documents of its bucket; null where the prefix itself is too large."""
    small = c.stored(rows.groupBy(F.substring("bits", 1, step).alias("prefix")).agg(F.sum("n_bytes").alias("n"), F.count("*").alias("d")), "prefixes")
    depths = small.select("prefix", "n", "d", F.explode(F.sequence(F.lit(above + (above > 0)), F.lit(step))).alias("depth")).withColumn("node", F.expr("substring(prefix, 1, depth)"))
    nodes = depths.groupBy("depth", "node").agg(F.sum("n").alias("shard_bytes"), F.sum("d").alias("shard_docs")).where(F.col("shard_bytes") <= byte_limit)
    first = depths.select("prefix", "depth", "node").join(nodes, ["depth", "node"]).groupBy("prefix").agg(F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("leaf"))
    return c.stored(small.select("prefix").join(first, "prefix", "left").select("prefix", "leaf.depth", "leaf.shard_bytes", "leaf.shard_docs"), "directory")


def _pages(rest: DataFrame, byte_limit: int) -> DataFrame:
    """Equal rows, counted and dealt to pages that fit; rows over the limit get a page each."""
    counted = rest.groupBy("doc_id", "n_bytes", "bits").agg(F.count("*").alias("copies"))
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(byte_limit) / F.greatest("n_bytes", F.lit(1))))
    row = counted.withColumn("fit", fit).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    page = F.floor(F.col("i") / F.col("fit"))
    docs = F.least(F.col("fit"), F.col("copies") - page * F.col("fit"))
    return row.select("doc_id", "n_bytes", F.concat("bits", F.lit("+"), page.cast("string")).alias("shard"), F.length("bits").alias("depth"), (docs * F.col("n_bytes")).alias("shard_bytes"), docs.alias("shard_docs"))


def directory(assigned: DataFrame) -> DataFrame:
    """A row for each shard."""
    return assigned.groupBy("shard", "depth").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs"))


def oracle_sql(byte_limit: int = BYTE_LIMIT, documents: str = "documents") -> str:
    """For tables of unique ids without a document over the limit."""
    return f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    array_to_string(list_transform(string_split(substr(md5(CAST(doc_id AS VARCHAR)), 1, 15), ''), lambda x: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', x)]), '') AS bits
  FROM {documents}
), x AS (
  SELECT doc_id, n_bytes, depth, substr(bits, 1, depth) AS node FROM d, (SELECT unnest(range(0, 61)) AS depth)
), nodes AS (
  SELECT depth, node, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs FROM x GROUP BY ALL
), fit AS (
  SELECT x.*, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM x JOIN nodes USING (depth, node) WHERE shard_bytes <= {byte_limit}
)
SELECT doc_id, n_bytes, node AS shard, CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs FROM fit WHERE k = 1
"""
