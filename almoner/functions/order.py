"""Ranks, numbers and running sums in the order of a whole table, or of groups of any size.

A window over a group is one task. Here rows are range-partitioned in the order asked for and kept, with the number of
their slice; each slice is summed, what stands in the slices before is added, and windows run within slices only. Ties
never make a large slice: ranks are taken over distinct values with their counts, which are summed before they are
shuffled, and go back to the rows by the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut


def sliced(df: DataFrame, group: list[str], order: list[Column], slices: int | None = None) -> DataFrame:
    """df in slices of its order, kept, with __slice: rows of an earlier slice come before those of a later one."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *[F.col(g) for g in group], *order).withColumn("__slice", F.spark_partition_id()))


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], slices: int | None = None) -> DataFrame:
    """Adds, for each name in sums, before_<name>: its sum over the group's rows that come before, and all_<name>: over the whole group.

    The order must be total, or rows it leaves equal are dealt in some order that is kept.
    """
    rows = sliced(df.withColumns({f"__x_{k}": v for k, v in sums.items()}), group, order, slices)
    parts = rows.groupBy(*group, "__slice").agg(*[F.sum(f"__x_{k}").alias(k) for k in sums])  # at most a row for each slice and each group
    ahead, whole = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*group)
    parts = parts.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__slice").alias("__at"), *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"__before_{k}") for k in sums], *[F.sum(k).over(whole).alias(f"all_{k}") for k in sums])
    on = F.col("__slice") == F.col("__at")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    here = W.partitionBy(*group, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(parts, on).withColumns({f"before_{k}": F.col(f"__before_{k}") + F.coalesce(F.sum(f"__x_{k}").over(here), F.lit(0)) for k in sums})
    return out.drop("__slice", "__at", *[f"__g_{g}" for g in group], *[f"__x_{k}" for k in sums], *[f"__before_{k}" for k in sums])


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str = "number", slices: int | None = None) -> DataFrame:
    """Numbers rows from 1 in an order, and adds their count: n."""
    rows = running(df, group, order, {"__one": F.lit(1).cast("long")}, slices)
    return rows.withColumn(out, F.col("before___one") + 1).withColumn("n", F.col("all___one")).drop("before___one", "all___one")


def value_ranks(df: DataFrame, value: str, group: list[str], ascending: bool = True, slices: int | None = None) -> DataFrame:
    """group, value, ties, n, and its ranks among the known values: least_rank, mean_rank, from 1."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("ties"))
    rows = running(counts, group, [F.col(value).asc() if ascending else F.col(value).desc()], {"ties": F.col("ties")}, slices)
    return rows.select(*group, value, "ties", F.col("all_ties").alias("n"), (F.col("before_ties") + 1).alias("least_rank"), (F.col("before_ties") + (F.col("ties") + 1) / 2).alias("mean_rank"))


def with_ranks(df: DataFrame, values: dict[str, str], group: list[str] | None = None, kind: str = "mean_rank", ascending: bool = True, slices: int | None = None) -> DataFrame:
    """Adds, for each name in values, the rank of that column's value; NULL has none.

    kind: mean_rank (ties share the mean), least_rank (ties share the least, as a truncated whole number), percent_rank
    (the mean rank over the number of known values).
    """
    group, out = group or [], df
    for name, value in values.items():
        ranks = value_ranks(df, value, group, ascending, slices)
        made = F.col("mean_rank") / F.col("n") if kind == "percent_rank" else F.col(kind)
        ranks = ranks.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col(value).alias("__v"), made.alias(f"__made_{name}"))
        on = F.col(value) == F.col("__v")
        for g in group:
            on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
        out = out.join(ranks, on, "left").drop("__v", *[f"__g_{g}" for g in group])
    return out.withColumns({name: F.col(f"__made_{name}") for name in values}).drop(*[f"__made_{name}" for name in values])


def filled_forward(df: DataFrame, column: str, group: list[str], order: list[Column], out: str | None = None, slices: int | None = None) -> DataFrame:
    """Fills NULLs of a column with what last stood before them in the order (ascending columns) of their group, which may be the whole table.

    The last known value of each slice is handed on over the slices that follow; within a slice a window fills the rest.
    """
    rows = sliced(df, group, order, slices)
    key = F.struct(*[F.struct(F.lit(i).alias("i"), F.col(f"__o{i}").alias("v")) for i in range(len(order))])
    parts = rows.withColumns({f"__o{i}": o for i, o in enumerate(order)}).groupBy(*group, "__slice").agg(F.max_by(F.col(column), F.when(F.col(column).isNotNull(), key)).alias("__last"))
    ahead = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__slice").alias("__at"), F.last("__last", ignorenulls=True).over(ahead).alias("__carried"))
    on = F.col("__slice") == F.col("__at")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    here = W.partitionBy(*group, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    met = rows.join(parts, on)
    return met.withColumn(out or column, F.coalesce(F.last(column, ignorenulls=True).over(here), "__carried")).drop("__slice", "__at", "__carried", *[f"__g_{g}" for g in group])
