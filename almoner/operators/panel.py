"""Weekly counts to yearly ones, counties to districts, smoothing and standardisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import nulls, selection

#: A model takes (cases, districts) and returns estimates by district and year.
SmallAreaModel = Callable[[DataFrame, DataFrame], DataFrame]


def weekly_panel(rows: DataFrame, counties: DataFrame, variables: list[str]) -> DataFrame:
    """The wanted variables, one row for each unit, variable and week, with county ids looked up by name.

    Ids come from the dimension table, never from the order of names; of a name that it repeats the last counts, in the
    order of its column `ordinal` (of county_id, if it has none). Of rows that repeat a key the least source file wins.
    """
    first = F.row_number().over(W.partitionBy("geo_name", "variable", "period_start").orderBy(F.col("source_file").asc_nulls_last(), F.col("value").asc_nulls_last()))
    wanted = rows.where(F.col("variable").isin(variables)).withColumn("__first", first).where("__first = 1").drop("__first")
    last = counties.groupBy("geo_name").agg(F.max_by("county_id", "ordinal" if "ordinal" in counties.columns else "county_id").alias("county_id"))
    return wanted.join(last, "geo_name", "left").withColumn("quality_flag", F.coalesce("quality_flag", F.lit("ok")) if "quality_flag" in rows.columns else F.lit("ok"))


def yearly(weekly: DataFrame, keys: list[str], value: str = "value", out: str = "cases") -> DataFrame:
    """Sums by keys, none of which may be missing."""
    return weekly.dropna(subset=keys).groupBy(*keys).agg(nulls.total(nulls.number(value)).alias(out))


def with_share(df: DataFrame, value: str, group: list[str], out: str = "share") -> DataFrame:
    """Adds a row's part of its group's total; equal parts where the total is 0. A row for each group is joined, no group is one task."""
    own = F.coalesce(F.col(value), F.lit(0)).cast("double")
    whole = df.groupBy(*group).agg(F.sum(own).alias("__whole"), F.count("*").alias("__n"))
    return df.join(whole, group).withColumn(out, F.when(F.col("__whole") == 0, 1.0 / F.col("__n")).otherwise(own / F.col("__whole"))).drop("__whole", "__n")


def population_share(cases: DataFrame, districts: DataFrame, county: str = "county_id", population: str = "population", spread: float = 0.5) -> DataFrame:
    """Observed county cases apportioned to districts by population, with an interval and incidence per 1000.

    cases: county, year, cases. Adds what every estimate has to say of itself: it is modelled, not observed.
    """
    shares = with_share(districts, population, [county])
    estimate = F.col("cases") * F.col("share")
    return cases.join(shares, county).select(
        "district_id", county, "year", "share", estimate.alias("cases_modelled"), F.greatest(F.lit(0.0), estimate * (1 - spread)).alias("cases_modelled_lo"), (estimate * (1 + spread)).alias("cases_modelled_hi"),
        (nulls.ratio(estimate, population) * 1000).alias("incidence"), F.lit("estimated").alias("evidence_class"), F.lit("low").alias("confidence"), F.lit("population_share").alias("method"),
    )


def bayesian_share(cases: DataFrame, districts: DataFrame) -> DataFrame:
    """A spatial model has a place here and no implementation."""
    raise NotImplementedError("no spatial model")


def conservation(estimates: DataFrame, cases: DataFrame, county: str = "county_id", tolerance: float = 1e-6) -> DataFrame:
    """By county and year: observed, the sum of what was apportioned, and whether they agree."""
    sums = estimates.groupBy(county, "year").agg(F.sum("cases_modelled").alias("apportioned"))
    return cases.join(sums, [county, "year"], "left").withColumn("conserved", F.abs(F.col("cases") - F.coalesce("apportioned", F.lit(0.0))) <= tolerance)


def district_panel(districts: DataFrame, estimates: DataFrame, names: DataFrame) -> DataFrame:
    """Districts with their estimates and their counties' names; districts without estimates stay."""
    return districts.join(estimates.drop("share"), ["district_id", "county_id"], "left").join(names, "county_id", "left").withColumns({"source_id": F.lit("modelled"), "quality_flag": F.lit("ok")})


def check_columns(df: DataFrame, inventory: set[str]) -> None:
    """Every column has to be in the inventory."""
    if unknown := sorted(set(df.columns) - inventory):
        raise ValueError(f"columns without an entry in the inventory: {unknown}")


def moving_average(df: DataFrame, value: str, order: str, group: list[str], width: int = 3, least: int = 1, out: str = "smoothed") -> DataFrame:
    """Centred; NULL where fewer than `least` values are known."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def empirical_bayes(df: DataFrame, observed: str, expected: str, group: list[str] | None = None) -> DataFrame:
    """Adds relative_risk and smoothed_risk of a Poisson-gamma model whose moments come from all rows of the group.

    Where the risks don't vary, or their mean isn't positive, nothing is smoothed and unknown risks are 1.
    """
    group = group or []
    rr = F.when(F.col(expected) > 0, nulls.ratio(observed, expected))
    rows = df.withColumn("relative_risk", rr)
    moments = rows.groupBy(*group).agg(F.avg("relative_risk").alias("__m"), F.var_pop("relative_risk").alias("__v"))
    joined = rows.join(F.broadcast(moments), group) if group else rows.crossJoin(F.broadcast(moments))
    beta = F.try_divide(F.col("__m"), F.col("__v"))
    smooth = nulls.ratio(F.col(observed) + beta * F.col("__m"), F.col(expected) + beta)
    return joined.withColumn("smoothed_risk", F.when((F.coalesce("__v", F.lit(0.0)) <= 0) | (F.coalesce("__m", F.lit(0.0)) <= 0), F.coalesce("relative_risk", F.lit(1.0))).otherwise(smooth)).drop("__m", "__v")


def smoothed_rate(risk: Column | str, national: float, per: float = 1000.0) -> Column:
    return nulls.col(risk) * national * per


def expected_counts(df: DataFrame, rates: dict[str, float], out: str = "expected") -> DataFrame:
    """The sum over age columns of people times the standard rate."""
    found = [c for c in rates if c in df.columns]
    if not found:
        raise ValueError("no column of an age group")
    return df.withColumn(out, sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * rates[c] for c in found))


def standardised_ratio(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Observed over expected; NULL where nothing is expected."""
    return observed.join(expected, keys).withColumn("sir", nulls.ratio("observed", "expected"))


def standardised_rate(ratio: Column | str, national: float, per: float = 1000.0) -> Column:
    return nulls.col(ratio) * national * per


def latest_or_proxy(rows: DataFrame, dims: DataFrame, keys: list[str], year: str, value: str, proxy: str) -> DataFrame:
    """The value of the row's year; else of the last year the unit has; else the proxy column."""
    last = dims.groupBy(*keys).agg(F.max_by(value, year).alias("__last"))
    exact = dims.select(*keys, year, F.col(value).alias("__exact"))
    return rows.join(exact, [*keys, year], "left").join(last, keys, "left").withColumn(value, F.coalesce("__exact", "__last", proxy)).drop("__exact", "__last")


def burden(districts: DataFrame, people: DataFrame, cases: DataFrame, children: DataFrame | None = None, half: float = 0.5, under_five: float = 0.34) -> DataFrame:
    """The analysis' burden of each district: cases of its county by its part of the people, with an interval and rates.

    districts: district_id, county_id; people: district_id, people, jobseekers; cases: county_id, cases; children:
    county_id, children. Districts without people get the median of their county's, and those without a rate of jobseekers
    the median of all. With children of every county, rates are by these, apportioned alike (a fixed part is under five);
    else by people, as denominator_is says.
    """
    c = F.col
    rows = districts.join(people, "district_id", "left").withColumn("jobseeker_rate", nulls.ratio("jobseekers", "people")).drop("jobseekers")
    middle = selection.quantiles(rows, ["county_id"], {"m": c("people")}, [0.5]).select("county_id", c("value").alias("__m"))
    rate = selection.quantiles(rows, [], {"m": c("jobseeker_rate")}, [0.5]).first()
    rows = rows.join(middle, "county_id", "left").withColumns({"people": F.coalesce(c("people").cast("double"), "__m"), "jobseeker_rate": F.coalesce("jobseeker_rate", F.lit(rate["value"] if rate else None).cast("double"))}).drop("__m")
    whole = rows.groupBy("county_id").agg(F.sum("people").alias("__whole"))
    rows = rows.join(whole, "county_id", "left").withColumn("share", nulls.ratio("people", "__whole")).drop("__whole").join(cases.select("county_id", c("cases").alias("__cases")), "county_id", "left")
    rows = rows.withColumn("burden", c("__cases") * c("share")).withColumns({"burden_lo": c("burden") * (1 - half), "burden_hi": c("burden") * (1 + half)}).drop("__cases")
    told = False
    if children is not None:
        rows = rows.join(children.select("county_id", c("children").alias("__children")), "county_id", "left").withColumn("children", c("__children") * c("share")).drop("__children")
        told = rows.where("children IS NULL").isEmpty()
    below, five = (c("children"), c("children") * under_five) if told else (c("people"), c("people"))
    rows = rows.withColumns({"children": below, "under_five": five})
    per = nulls.ratio("burden", "children") * 1e5
    return rows.withColumns({"burden_rate": per, "burden_rate_u5": nulls.ratio("burden", "under_five") * 1e3 if told else per, "denominator_is": F.lit("children" if told else "people"), "evidence_class": F.lit("estimated"), "confidence": F.lit("low")})
