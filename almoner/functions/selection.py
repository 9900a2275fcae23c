"""Exact quantiles of groups of any size, many groups and columns in one plan.

An exact aggregate keeps all distinct values of a group in one buffer. That is done only for groups of at most BUFFERED
rows. In larger ones each wanted place is found by histograms: doubles become whole numbers of the same order (their bits),
rows are counted by the next BITS of these within the bins that still hold a wanted place, and the bin that holds it is
followed, until the bins hold at most BUFFERED values each, which are counted by value, or all 64 bits are told. Counts
are summed before they are shuffled, so a value that is any part of all rows is one number, and no task or buffer gets
more than 2^BITS bins or BUFFERED values of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut

BUFFERED = 1 << 16
BITS = 12


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """A whole number for each double, in the same order; -0.0 is 0.0."""
    bits = (x.to_numpy(dtype="float64") + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, np.int64(-0x8000000000000000) - bits, bits))


@F.pandas_udf(T.DoubleType())
def double_of(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy(dtype="int64")
    return pd.Series(np.where(b < 0, np.int64(-0x8000000000000000) - b, b).view(np.float64))


def quantiles(df: DataFrame, group: list[str], values: dict[str, Column], probs: list[float]) -> DataFrame:
    """group, name, prob, value: quantiles of the known values (not NULL, not NaN), linear between neighbours; NULL where there are none.

    Between two equal values it is that value, to the last bit, so that a comparison with it takes in all ties.
    """
    names = list(values)
    wide = df.select(*group, *[F.nanvl(v.cast("double"), F.lit(None).cast("double")).alias(f"__v{i}") for i, v in enumerate(values.values())])
    long = wide.select(*group, F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"__v{i}").alias("x")) for i in range(len(names))])).alias("__p")).select(*group, F.col("__p.c").alias("__c"), F.col("__p.x").alias("__x"))
    keys, large = [*group, "__c"], None
    if df.count() > BUFFERED:
        sizes = cut(long.groupBy(*keys).agg(F.count("__x").alias("__n")))
        large = sizes.where(F.col("__n") > BUFFERED)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    small = long
    if large is not None and not large.isEmpty():
        small = _matching(long, sizes.where(F.col("__n") <= BUFFERED).select(*keys), keys)
    found = small.groupBy(*keys).agg(F.percentile("__x", [float(p) for p in probs]).alias("q"))
    empty = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda _: F.lit(None).cast("double"))
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.coalesce("q", empty).alias("value")))
    out = found.select(*keys, pairs.alias("__z")).select(*keys, F.col("__z.prob").alias("prob"), F.col("__z.value").alias("value"))
    if small is not long:
        out = out.unionByName(_selected(_matching(long, large.select(*keys), keys), large.select(*keys, "__n", wanted), keys))
    return out.select(*group, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__c") + 1).alias("name"), "prob", "value")


def _matching(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are among few, missing ones too."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return rows.join(few.select(*[F.col(k).alias(f"__of_{k}") for k in keys]), on, "left_semi")


def _selected(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, prob, value of large groups. wanted: keys, __n, prob."""
    # groups become numbers, so that the passes join by numbers; there are at most rows / BUFFERED of them
    names = cut(wanted.select(*keys).distinct().withColumn("__id", F.monotonically_increasing_id()))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    of = names.select(*[F.col(k).alias(f"__of_{k}") for k in keys], "__id")
    # bits from the top, the sign turned, so that shifted prefixes keep the order
    bits = cut(rows.where(F.col("__x").isNotNull()).join(of, on).select("__id", ordered_bits("__x").bitwiseXOR(F.lit(-0x8000000000000000)).alias("bits")))
    place = (F.col("__n") - 1) * F.col("prob")
    at = wanted.join(of, on).select("__id", "prob", (place - F.floor(place)).alias("part"), F.explode(F.array(F.floor(place), F.ceil(place))).alias("k"))
    # each place is in the bin of this prefix, and `below` values come before the bin
    open_ = cut(at.select("__id", "k").distinct().withColumns({"prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long")}))
    told, bins, most = 0, open_.count(), BUFFERED + 1
    while told < 64:
        left = 64 - told
        inside = bits.withColumn("prefix", F.shiftrightunsigned("bits", left) if told else F.lit(0).cast("long"))
        if told:
            inside = inside.join(_small(open_.select("__id", "prefix").distinct(), bins), ["__id", "prefix"], "left_semi")
        step = left if most <= BUFFERED else min(BITS, left)
        counts = inside.groupBy("__id", "prefix", F.shiftrightunsigned("bits", left - step).alias("bin")).agg(F.count("*").alias("n"))
        open_ = cut(_followed(open_, counts))
        most, told = open_.agg(F.max("n")).first()[0], told + step
    values = open_.select("__id", "k", double_of(F.col("prefix").bitwiseXOR(F.lit(-0x8000000000000000))).alias("x"))
    both = at.join(values, ["__id", "k"]).groupBy("__id", "prob").agg(F.max("part").alias("part"), F.min_by("x", "k").alias("lo"), F.max_by("x", "k").alias("hi"))
    named = both.join(names, "__id")
    return named.select(*keys, "prob", F.when((F.col("part") == 0) | (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col("lo") * (1 - F.col("part")) + F.col("hi") * F.col("part")).alias("value"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be sent to all tasks if it has few rows of numbers."""
    return F.broadcast(df) if rows <= 100_000 else df


def _followed(open_: DataFrame, counts: DataFrame) -> DataFrame:
    """__id, k, prefix, below, n: each place in the finer bin that holds it. A window sees the finer bins of one bin: 2^BITS, or BUFFERED values.

    Prefixes of fewer than 64 bits are positive, and whole ones that are compared share their first bits: their order is that of the values.
    """
    within = W.partitionBy("__id", "prefix").orderBy("bin")
    upto = counts.withColumn("upto", F.sum("n").over(within.rowsBetween(W.unboundedPreceding, 0)))
    met = open_.select("__id", "k", "prefix", "below").join(upto, ["__id", "prefix"])
    here = (F.col("k") < F.col("below") + F.col("upto")) & (F.col("k") >= F.col("below") + F.col("upto") - F.col("n"))
    return met.where(here).select("__id", "k", F.col("bin").alias("prefix"), (F.col("below") + F.col("upto") - F.col("n")).alias("below"), "n")
