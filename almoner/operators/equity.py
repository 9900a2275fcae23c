"""Inequality and overlap, each by group: a scenario, a year, a draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nulls, order, ranks, selection, tails


def gini(df: DataFrame, value: str, group: list[str], tie: str = "district_id", slices: int = 1, zero: float | None = 0.0) -> DataFrame:
    """group, gini = (2 sum(i x) / (n sum x)) - (n + 1) / n over known values; `zero` where all are 0."""
    rows = df.where(nulls.known(F.col(value).cast("double")).isNotNull()).select(*group, tie, F.col(value).cast("double").alias("__x"))
    placed = ranks.positions(rows, group, "__x", tie, slices=slices)
    n, s = F.count("*"), F.sum("__x")
    g = 2 * F.sum(F.col("pos") * F.col("__x")) / F.nullif(n * s, F.lit(0.0)) - (n + 1) / n
    return placed.groupBy(*group).agg(F.when(s == 0, F.lit(zero).cast("double")).otherwise(g).alias("gini"))


def concentration(df: DataFrame, aid: str, need: str, group: list[str], tie: str = "district_id", slices: int = 1, zero: float | None = 0.0) -> DataFrame:
    """group, ci = 2 / (n mean) * sum((y - mean) (r - 1/2)), r = (i - 1/2) / n in order of need, ties by id."""
    y = nulls.known(F.col(aid).cast("double"))
    rows = df.where(y.isNotNull() & nulls.known(F.col(need).cast("double")).isNotNull()).select(*group, tie, y.alias("__y"), F.col(need).cast("double").alias("__r"))
    placed = ranks.positions(rows, group, "__r", tie, slices=slices).withColumn("__f", (F.col("pos") - 0.5) / F.col("n"))
    # sum((y - m)(r - 1/2)) is sum(y (r - 1/2)), as the ranks' mean is 1/2
    s = F.sum("__y")
    return placed.groupBy(*group).agg(F.when(s == 0, F.lit(zero).cast("double")).otherwise(2 * F.sum(F.col("__y") * (F.col("__f") - 0.5)) / F.nullif(s, F.lit(0.0))).alias("ci"))


def kakwani(df: DataFrame, aid: str, need: str, group: list[str], tie: str = "district_id", slices: int = 1) -> DataFrame:
    a, b = concentration(df, aid, need, group, tie, slices), gini(df, need, group, tie, slices)
    return (a.join(b, group) if group else a.crossJoin(b)).withColumn("kakwani", F.col("ci") - F.col("gini"))


def theil(df: DataFrame, value: str, by: str, group: list[str], drop_zeros: bool = False) -> DataFrame:
    """group, theil, between, within: zeros count in n and mean and add nothing, unless dropped; parts without a sum are skipped."""
    x = nulls.known(F.col(value).cast("double"))
    rows = df.where(x.isNotNull() & ((x > 0) if drop_zeros else F.lit(True))).select(*group, F.col(by).alias("__by"), x.alias("__x"))
    xlnx = F.sum(F.when(F.col("__x") > 0, F.col("__x") * F.ln(F.when(F.col("__x") > 0, F.col("__x")))).otherwise(0.0))
    parts = rows.groupBy(*group, "__by").agg(F.count("*").alias("n"), F.sum("__x").alias("s"), xlnx.alias("l"))
    n, s, l = F.sum("n"), F.sum("s"), F.sum("l")  # noqa: E741
    whole = F.when(s > 0, l / F.nullif(s, F.lit(0.0)) - F.ln(F.when(s > 0, s / n))).otherwise(0.0)
    # within: sum of s_g / s * T_g with T_g = l_g / s_g - ln(s_g / n_g)
    own = F.when(F.col("s") > 0, F.col("l") - F.col("s") * F.ln(F.when(F.col("s") > 0, F.col("s") / F.col("n")))).otherwise(0.0)
    within = F.when(s > 0, F.sum(own) / F.nullif(s, F.lit(0.0))).otherwise(0.0)
    return parts.groupBy(*group).agg(whole.alias("theil"), (whole - within).alias("between"), within.alias("within"))


def lorenz(df: DataFrame, value: str, group: list[str], tie: str = "district_id", slices: int = 1) -> DataFrame:
    """group, pos, x, y: cumulative shares in ascending order, from (0, 0); the diagonal where all values are 0."""
    rows = df.where(F.col(value).isNotNull()).select(*group, tie, F.col(value).cast("double").alias("__x"))
    placed = ranks.positions(rows, group, "__x", tie, ["__x"], slices)
    x = F.col("pos") / F.col("n")
    points = placed.select(*group, F.col("pos").cast("long").alias("pos"), x.alias("x"), F.when(F.col("sum___x") == 0, x).otherwise(F.col("cum___x") / F.nullif("sum___x", F.lit(0.0))).alias("y"))
    origin = points.select(*group).distinct() if group else points.select(F.lit(1).alias("__1")).distinct()
    return points.unionByName(origin.select(*group, F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


def spearman(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """group, rho over rows where both are known; ties share their mean rank. Ranks are taken in slices of each group."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = order.with_ranks(rows, {"__a": "__x", "__b": "__y"}, group)
    return ranked.groupBy(*group).agg(nulls.correlation("__a", "__b").alias("rho"))


def scenario_spearman(allocated: DataFrame, value: str = "aid_amount", unit: str = "district_id") -> DataFrame:
    """scenario_a, scenario_b, rho of all pairs; ranks are taken once for each scenario, in slices."""
    known = allocated.where(F.col(value).isNotNull()).select("scenario_id", unit, value)
    ranked = order.with_ranks(known, {"r": value}, ["scenario_id"])
    # the ranks of a unit in all scenarios are one row
    wide = ranked.groupBy(unit).agg(F.collect_list(F.struct("scenario_id", "r")).alias("__all"))  # as many as scenarios
    pairs = wide.select(F.explode("__all").alias("a"), "__all").select("a", F.explode("__all").alias("b"))
    return pairs.groupBy(F.col("a.scenario_id").alias("scenario_a"), F.col("b.scenario_id").alias("scenario_b")).agg(nulls.correlation("a.r", "b.r").alias("rho"))


def top_rows(df: DataFrame, value: str, group: list[str], k: int, tie: str = "district_id") -> DataFrame:
    """Exactly k rows of each group, ties to the least id."""
    from pyspark.sql import Window as W

    return df.withColumn("__k", F.row_number().over(W.partitionBy(*group).orderBy(F.desc_nulls_last(value), tie))).where(F.col("__k") <= k).drop("__k")


def jaccard_top(allocated: DataFrame, k: int, value: str = "aid_amount", unit: str = "district_id") -> DataFrame:
    """scenario_a, scenario_b, jaccard of the k best-funded units."""
    best = top_rows(allocated, value, ["scenario_id"], k, unit).select("scenario_id", unit)
    size = best.groupBy("scenario_id").agg(F.count("*").alias("n"))
    a = best.select(unit, F.col("scenario_id").alias("scenario_a"))
    b = best.select(unit, F.col("scenario_id").alias("scenario_b"))
    both = a.join(b, unit).groupBy("scenario_a", "scenario_b").agg(F.count("*").alias("m"))
    names = size.select(F.col("scenario_id").alias("scenario_a"), F.col("n").alias("na")).crossJoin(size.select(F.col("scenario_id").alias("scenario_b"), F.col("n").alias("nb")))  # a row for each scenario
    return names.join(both, ["scenario_a", "scenario_b"], "left").select("scenario_a", "scenario_b", (F.coalesce("m", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("m", F.lit(0)))).alias("jaccard"))


def top_overlap(df: DataFrame, aid: str, need: str, group: list[str], q: float = 0.9) -> DataFrame:
    """group, overlap: the part of units at or above the need quantile that are at or above the aid quantile too."""
    rows = _with_cuts(df, aid, need, group, q)
    needy = F.col(need) >= F.col("__cut_need")
    return rows.groupBy(*group).agg(nulls.ratio(F.sum((needy & (F.col(aid) >= F.col("__cut_aid"))).cast("long")), F.sum(needy.cast("long"))).alias("overlap"))


def _with_cuts(df: DataFrame, aid: str, need: str, group: list[str], q: float) -> DataFrame:
    """Adds the quantiles of both columns, exact for groups of any size: a row for each group is joined, or two literals are added."""
    cuts = selection.quantiles(df, group, {"__cut_aid": F.col(aid), "__cut_need": F.col(need)}, [q])
    if not group:
        found = {r["name"]: r["value"] for r in cuts.collect()}  # two rows
        return df.withColumns({k: F.lit(v).cast("double") for k, v in found.items()})
    return df.join(cuts.groupBy(*group).pivot("name", ["__cut_aid", "__cut_need"]).agg(F.max("value")), group)


def worst_fifth_share(df: DataFrame, aid: str, need: str, group: list[str], tie: str = "district_id", slices: int = 1) -> DataFrame:
    """group, share of aid that goes to the neediest of five bins of equal size."""
    rows = df.where(F.col(need).isNotNull()).select(*group, tie, F.col(aid).cast("double").alias("__y"), F.col(need).cast("double").alias("__r"))
    placed = ranks.positions(rows, group, "__r", tie, slices=slices).withColumn("__bin", ranks.fifth(F.col("pos"), F.col("n")))
    return placed.groupBy(*group).agg(nulls.ratio(F.sum(F.when(F.col("__bin") == 4, F.col("__y")).otherwise(0.0)), F.sum("__y")).alias("worst_fifth_share"))


def summary(df: DataFrame, aid: str, need: str, by: str, group: list[str], tie: str = "district_id", digits: tuple[int, int] | None = None) -> DataFrame:
    """All of these in a row for each group, over rows where aid and need are known.

    Rows are numbered along need once and along aid once, in slices; then all measures but Theil's parts are one aggregation.
    digits: of aid and need, to which they are rounded where they are compared (overlap, rank correlation), so that noise in
    the last bits parts no ties; sums and orders take them as they are.
    """
    x, r = nulls.known(F.col(aid).cast("double")), nulls.known(F.col(need).cast("double"))
    coarse = [F.round(v, k) for v, k in zip((x, r), digits, strict=True)] if digits else [x, r]
    known = df.where(x.isNotNull() & r.isNotNull()).select(*group, tie, by, x.alias("__x"), r.alias("__r"), coarse[0].alias("__xc"), coarse[1].alias("__rc"))
    rows = _with_cuts(order.numbered(order.numbered(known, group, [F.col("__r"), F.col(tie)], "__k"), group, [F.col("__x"), F.col(tie)], "__i"), "__xc", "__rc", group, 0.9)
    n, s, sr, c = F.count("*"), F.sum("__x"), F.sum("__r"), F.col
    share = F.when(s == 0, F.lit(0.0))
    needy = c("__rc") >= c("__cut_need")
    last = ranks.fifth(c("__k"), c("n")) == 4
    out = rows.groupBy(*group).agg(
        share.otherwise(2 * F.sum(c("__x") * ((c("__k") - 0.5) / c("n") - 0.5)) / F.nullif(s, F.lit(0.0))).alias("ci"),
        F.when(sr == 0, F.lit(0.0)).otherwise(2 * F.sum(c("__k") * c("__r")) / F.nullif(n * sr, F.lit(0.0)) - (n + 1) / n).alias("gini_need"),
        share.otherwise(2 * F.sum(c("__i") * c("__x")) / F.nullif(n * s, F.lit(0.0)) - (n + 1) / n).alias("gini"),
        nulls.ratio(F.sum((needy & (c("__xc") >= c("__cut_aid"))).cast("long")), F.sum(needy.cast("long"))).alias("overlap"),
        nulls.ratio(F.sum(F.when(last, c("__x")).otherwise(0.0)), s).alias("worst_fifth_share"),
    ).withColumn("kakwani", F.col("ci") - F.col("gini_need"))
    return out.join(theil(known, "__x", by, group), group).join(spearman(known, "__xc", "__rc", group), group)


def trend(df: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """group, slope, intercept, r, n, t and the two-sided p of a least-squares line."""
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    r = nulls.correlation(cx, cy)
    out = df.groupBy(*(group or [])).agg(F.regr_slope(cy, cx).alias("slope"), F.regr_intercept(cy, cx).alias("intercept"), r.alias("r"), F.regr_count(cy, cx).alias("n"))
    t = F.try_divide(F.col("r") * F.sqrt(F.when(F.col("n") > 2, F.col("n") - 2.0)), F.sqrt(F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0))))
    return out.withColumn("t", t).withColumn("p", tails.t_two_sided_column(F.col("t"), F.col("n") - 2))


def association(df: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """group, n, pearson, pearson_p, spearman, spearman_p over rows where both are known; ranks are taken in slices."""
    group = group or []
    rows = df.where(nulls.known(F.col(x).cast("double")).isNotNull() & nulls.known(F.col(y).cast("double")).isNotNull()).select(*group, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    ranked = order.with_ranks(rows, {"__a": "__x", "__b": "__y"}, group)
    out = ranked.groupBy(*group).agg(F.count("*").alias("n"), nulls.correlation("__x", "__y").alias("pearson"), nulls.correlation("__a", "__b").alias("spearman"))
    return out.withColumns({f"{c}_p": tails.correlation_p(F.col(c), F.col("n")) for c in ("pearson", "spearman")})


def describe(df: DataFrame, value: str, group: list[str], tie: str) -> DataFrame:
    """group: sum, mean, sd, least, most, their ratio, variation and Gini."""
    c = F.col(value).cast("double")
    stats = df.groupBy(*group).agg(F.sum(c).alias("total"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("least"), F.max(c).alias("most"))
    return stats.withColumns({"spread": nulls.ratio("most", "least"), "cv": nulls.ratio("sd", "mean")}).join(gini(df, value, group, tie, zero=None), group)
