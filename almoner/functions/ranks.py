"""Ranks, positions and bins within groups.

A window over one group is one task. Where a group may be the whole table, give `slices`: its rows are cut at approximate
quantiles of the ordering value, each slice is numbered by itself, and what stands in the slices before is added. The cut
is a function of the row, so nothing has to be kept between the passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mean_rank(value: Column | str, group: list[str]) -> Column:
    """Ranks from 1, ties get the mean of theirs; NULL has none."""
    value = F.col(value) if isinstance(value, str) else value
    ties = F.count("*").over(W.partitionBy(*group, value))
    rank = F.rank().over(W.partitionBy(*group).orderBy(value.asc_nulls_last()))
    return F.when(value.isNotNull(), rank + (ties - 1) / 2)


def percent_rank(value: Column | str, group: list[str]) -> Column:
    """Mean rank over the number of known values."""
    c = F.col(value) if isinstance(value, str) else value
    return mean_rank(c, group) / F.count(c).over(W.partitionBy(*group))


def fifth(position: Column, n: Column, bins: int = 5) -> Column:
    """Bin (from 0) of a position from 1, cut at linear quantiles of the positions: not ntile, which deals out the rest first."""
    return F.greatest(F.ceil((position - 1) * bins / F.greatest(n - 1, F.lit(1))), F.lit(1)).cast("int") - 1


def positions(df: DataFrame, group: list[str], by: str, tie: str, add: list[str] | None = None, slices: int = 1, ascending: bool = True) -> DataFrame:
    """Adds pos (from 1, by `by`, ties by `tie`), n, and for each column in add its running and whole sum: cum_x, sum_x."""
    add = add or []
    order = [F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last(), F.col(tie)]
    if slices <= 1:
        here, all_ = W.partitionBy(*group).orderBy(*order), W.partitionBy(*group)
        run = here.rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({"pos": F.row_number().over(here), "n": F.count("*").over(all_)} | {f"cum_{x}": F.sum(x).over(run) for x in add} | {f"sum_{x}": F.sum(x).over(all_) for x in add})
    sign = 1.0 if ascending else -1.0
    key = F.col(by).cast("double") * sign
    cuts = df.groupBy(*group).agg(F.percentile_approx(key, [i / slices for i in range(1, slices)], 1000).alias("__cuts"))
    sliced = _on(df, cuts, group).withColumn("__slice", F.when(F.col(by).isNull(), F.lit(slices)).otherwise(F.size(F.filter("__cuts", lambda x: x < key)))).drop("__cuts")
    sums = sliced.groupBy(*group, "__slice").agg(F.count("*").alias("__n"), *[F.sum(x).alias(f"__sum_{x}") for x in add])
    ahead, all_ = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*group)
    before = sums.select(*group, "__slice", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"), F.sum("__n").over(all_).alias("n"), *[y for x in add for y in (F.coalesce(F.sum(f"__sum_{x}").over(ahead), F.lit(0)).alias(f"__before_{x}"), F.sum(f"__sum_{x}").over(all_).alias(f"sum_{x}"))])
    inner = W.partitionBy(*group, "__slice").orderBy(*order)
    run = inner.rowsBetween(W.unboundedPreceding, 0)
    joined = sliced.join(F.broadcast(before), [*group, "__slice"])  # slices times groups: the groups are scenarios, years or the like
    return joined.withColumns({"pos": F.col("__before") + F.row_number().over(inner)} | {f"cum_{x}": F.col(f"__before_{x}") + F.sum(x).over(run) for x in add}).drop("__slice", "__before", *[f"__before_{x}" for x in add])


def _on(df: DataFrame, small: DataFrame, group: list[str]) -> DataFrame:
    return df.join(F.broadcast(small), group) if group else df.crossJoin(F.broadcast(small))
