"""Rules that tables have to meet. Each takes a table and returns findings: rule, severity, message, n_rows, sample."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, nulls, selection

FINDING = "rule string, severity string, message string, n_rows long, sample array<string>"

# What columns are called, the first that is there counts.
GEO = ("district_id", "county_id", "settlement_id", "geo_id", "geo_name")
PERIOD = ("period_start", "year", "iso_year")
DISCRIMINATORS = ("iso_week", "practice_type", "age_group", "sex", "source_id")
BREAK = "2014-01-01"


class ValidationError(ValueError):
    """A table breaks rules that are errors."""


def first_of(df: DataFrame, names: tuple[str, ...]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def finding(rows: DataFrame, rule: str, severity: str, message: str, sample: int = 5) -> DataFrame:
    """One finding over the rows that break a rule, none if there are none; the sample is its least rows as JSON."""
    j = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])) if rows.columns else F.lit("{}")
    small = rows.select(j.alias("__j")).orderBy("__j").limit(sample).agg(F.array_sort(F.collect_list("__j")).alias("sample"))
    counted = rows.agg(F.count("*").alias("n_rows")).where("n_rows > 0")
    return counted.crossJoin(small).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), "n_rows", "sample")


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of keys that more than one row has; missing values are equal."""
    return df.withColumn("__n", F.count("*").over(W.partitionBy(*keys))).where("__n > 1").drop("__n")


def duplicate_keys(df: DataFrame) -> list[str] | None:
    geo, period = first_of(df, GEO), first_of(df, PERIOD)
    keys = [k for k in (geo, "geo_level" if "geo_level" in df.columns else None, period, "variable" if "variable" in df.columns else None) if k] + [d for d in DISCRIMINATORS if d in df.columns]
    return keys if geo and len(keys) >= 3 else None


def duplicates(df: DataFrame) -> DataFrame:
    keys = duplicate_keys(df)
    return finding(duplicate_rows(df, keys) if keys else df.limit(0), "duplicates", "error", f"repeated rows of {keys}")


def missing_units(df: DataFrame, expected: DataFrame, unit: str, period: str) -> DataFrame:
    """unit, period: expected units without a row in a period that has rows. Periods are broadcast: they are weeks or years."""
    periods = df.select(period).where(F.col(period).isNotNull()).distinct()
    return expected.select(unit).distinct().crossJoin(periods).join(df.select(unit, period).distinct(), [unit, period], "left_anti")


def unknown_ids(df: DataFrame, known: DataFrame, unit: str) -> DataFrame:
    return df.where(~nulls.blank(unit)).join(known.select(F.col(unit).cast("string").alias("__k")).distinct(), F.trim(F.col(unit).cast("string")) == F.col("__k"), "left_anti")


def week_gaps(df: DataFrame, group: list[str], year: str = "iso_year", week: str = "iso_week") -> DataFrame:
    """group, from_year, from_week, to_year, to_week, n_missing: weeks that lie between two that follow each other.

    Weeks are counted by their Mondays, so whole missing years count too.
    """
    seen = df.select(*group, F.col(year).cast("int").alias("y"), F.col(week).cast("int").alias("w")).dropna(subset=["y", "w"]).distinct().withColumn("m", dates.iso_monday("y", "w"))
    w = W.partitionBy(*group).orderBy("m")
    pairs = seen.where(F.col("m").isNotNull()).withColumns({"ny": F.lead("y").over(w), "nw": F.lead("w").over(w), "nm": F.lead("m").over(w)})
    n = (F.datediff("nm", "m") / 7 - 1).cast("long")
    return pairs.withColumn("n_missing", n).where("n_missing > 0").select(*group, F.col("y").alias("from_year"), F.col("w").alias("from_week"), F.col("ny").alias("to_year"), F.col("nw").alias("to_week"), "n_missing")


def out_of_range(df: DataFrame, bounds: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    """Rows outside their variable's bounds (0 and up where it has none). bounds: variable, low, high: a small table."""
    b = bounds.select(F.col("variable").alias(variable), "low", "high")
    x = nulls.number(value)
    rows = df.join(b, variable, "left")
    return rows.where(x.isNotNull() & ((x < F.coalesce("low", F.lit(0.0))) | (x > F.coalesce("high", F.lit(float("inf")))))).drop("low", "high")


def columns_out_of_range(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """column, n_rows of wide columns that leave their bounds, in one pass."""
    own = {c: b for c, b in bounds.items() if c in df.columns}
    if not own:
        return df.sparkSession.createDataFrame([], "column string, n_rows long")
    bad = [F.count_if((nulls.number(c) < lo) | (nulls.number(c) > hi)).alias(c) for c, (lo, hi) in own.items()]
    return df.agg(*bad).unpivot([], list(own), "column", "n_rows").where("n_rows > 0")


def sum_disagreement(df: DataFrame, tolerance: float = 0.5, keys: tuple[str, ...] = ("variable", "period_start"), place: str | None = None) -> DataFrame:
    """keys, counties, country: periods whose county values don't add up to the country's.

    Of several values of the country the first counts, in the order of the column `place` (such as a row number); rows of
    a table have no order of their own, so without it the least.
    """
    x = nulls.number("value")
    country = F.when(F.col("geo_level") == "country", x)
    first = F.min_by(country, F.when(country.isNotNull(), F.col(place))) if place else F.min(country)
    sums = df.groupBy(*keys).agg(nulls.total(F.when(F.col("geo_level") == "county", x)).alias("counties"), first.alias("country"), F.count_if(F.col("geo_level") == "county").alias("__n"))
    return sums.where(F.col("country").isNotNull() & (F.col("__n") > 0) & (F.abs(F.col("counties") - F.col("country")) > tolerance)).drop("__n")


def outliers(df: DataFrame, value: str, group: list[str], most: float = 5.0, flag: str = "quality_flag") -> DataFrame:
    """Adds robust_z, |0.6745 (x - median) / MAD|, and marks rows above `most` whose flag is blank. No row goes.

    Median and MAD are exact (functions.selection) for groups of any size, and joined back as a row for each group.
    """
    x = nulls.number(value)
    middle = lambda rows, column, name: selection.quantiles(rows, group, {name: column}, [0.5]).select(*group, F.col("value").alias(name))
    with_middle = df.join(middle(df, x, "__med"), group)
    mad = middle(with_middle, F.abs(x - F.col("__med")), "__mad")
    rows = with_middle.join(mad, group).withColumn("robust_z", F.when(F.col("__mad") > 0, F.abs(0.6745 * (x - F.col("__med")) / F.nullif("__mad", F.lit(0.0)))))
    old = F.col(flag) if flag in df.columns else F.lit(None).cast("string")
    return rows.withColumn(flag, F.when((F.col("robust_z") > most) & nulls.blank(old), F.lit("outlier")).otherwise(old)).drop("__med", "__mad")


def mixed_price_years(df: DataFrame) -> DataFrame:
    """Price years of a table with real sums, if it has several and no deflator id."""
    none = df.sparkSession.createDataFrame([], "price_year int")
    if "price_year" not in df.columns or not any("_real" in c for c in df.columns) or any(c.endswith("deflator_id") for c in df.columns):
        return none
    years = df.select(F.col("price_year").cast("int").alias("price_year")).dropna().distinct()
    return years.join(F.broadcast(years.agg(F.count("*").alias("__n"))), F.col("__n") > 1).drop("__n")


def wrong_evidence(df: DataFrame, allowed: tuple[str, ...] = ("observed", "estimated", "assumed"), foia: str = "nngyk_foia") -> DataFrame:
    """Rows of an unknown class of evidence, and observed district counts that no information request has given."""
    e = F.col("evidence_class")
    unknown = e.isNull() | ~e.isin(*allowed)
    observed = (F.col("geo_level") == "district") & e.eqNullSafe(F.lit("observed")) & ~F.col("source_id").eqNullSafe(F.lit(foia)) if "geo_level" in df.columns and "source_id" in df.columns else F.lit(False)
    return df.where(unknown | observed)


def before_break(df: DataFrame, variables: list[str], period: str = "period_start", since: str = BREAK) -> DataFrame:
    return df.where(F.col("variable").isin(variables) & (F.col(period).try_cast("date") < F.lit(since).cast("date")))


def more_children_than_people(df: DataFrame, children: str = "population_0_4", people: str = "population_total") -> DataFrame:
    return df.where(F.col(children) > F.col(people))


def county_totals_off(df: DataFrame, people: str, declared: str, keys: list[str], tolerance: float = 0.005, place: str | None = None) -> DataFrame:
    """keys, summed, declared: where districts add up to something else than what is declared for their county.

    Of several declared values the first counts, in the order of the column `place`; without it the least.
    """
    first = F.min_by(declared, F.when(F.col(declared).isNotNull(), F.col(place))) if place else F.min(declared)
    sums = df.groupBy(*keys).agg(nulls.total(people).alias("summed"), first.alias("declared"))
    return sums.where(F.abs(F.col("summed") - F.col("declared")) > tolerance * F.abs(F.col("declared")))


Rule = Callable[[DataFrame], DataFrame]


def run_all(df: DataFrame, rules: dict[str, Rule], strict: bool = False) -> DataFrame:
    """The findings of all rules; a rule that can't be planned becomes a warning. strict: errors raise one exception."""
    spark, out = df.sparkSession, None
    for name, rule in rules.items():
        try:
            found = rule(df)
        except Exception as e:  # noqa: BLE001 - a rule must not stop the others
            found = spark.createDataFrame([(name, "warning", f"the rule failed: {type(e).__name__}", 0, [])], FINDING)
        out = found if out is None else out.unionByName(found)
    out = out if out is not None else spark.createDataFrame([], FINDING)
    if strict and (bad := out.where("severity = 'error'").collect()):  # a row for each rule
        raise ValidationError("; ".join(f"{r['rule']}: {r['message']} ({r['n_rows']})" for r in bad))
    return out


def report(findings: DataFrame, title: str = "Validation") -> tuple[str, str]:
    """Findings as JSON and as Markdown."""
    rows = [r.asDict() for r in findings.orderBy("severity", "rule").collect()]  # a row for each rule
    lines = [f"# {title}", "", "| rule | severity | rows | message |", "|---|---|---|---|"] + [f"| {r['rule']} | {r['severity']} | {r['n_rows']} | {r['message']} |" for r in rows]
    return json.dumps(rows, ensure_ascii=False), "\n".join(lines) + "\n"


def fingerprint(df: DataFrame) -> str:
    """A hash of column names and types, in order."""
    return hashlib.sha256(json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema.fields]).encode()).hexdigest()


def drift(before: dict[str, str] | None, df: DataFrame) -> dict:
    """status and what was added, removed or changed its type since a snapshot of {column: type}; the new snapshot moves forward."""
    now = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if before is None:
        return {"status": "first_seen", "added": [], "removed": [], "dtype_changed": [], "snapshot": now}
    out = {"added": sorted(now.keys() - before.keys()), "removed": sorted(before.keys() - now.keys()), "dtype_changed": sorted(k for k in now.keys() & before.keys() if now[k] != before[k])}
    return {"status": "drifted" if any(out.values()) else "unchanged", **out, "snapshot": now}


def mark_drifted(df: DataFrame, flag: str = "quality_flag") -> DataFrame:
    return df.withColumn(flag, F.when(nulls.blank(flag) if flag in df.columns else F.lit(True), F.lit("schema_drift")).otherwise(F.col(flag) if flag in df.columns else F.lit(None)))


def failures(df: DataFrame, spec: dict[str, Column]) -> DataFrame:
    """check, n_rows of declared conditions that rows break, all of them in one pass; NULL passes unless the condition says otherwise."""
    names = list(spec)
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(f"c{i}") for i, c in enumerate(spec.values())])
    long = counts.unpivot([], [f"c{i}" for i in range(len(names))], "c", "n_rows")
    return long.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.substring("c", 2, 9).cast("int") + 1).alias("check"), "n_rows").where("n_rows > 0")


def modelled_against_observed(modelled: DataFrame, observed: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """by, n, mae and coverage of the interval. modelled: estimate, lo, hi; observed: value."""
    both = modelled.join(observed, keys)
    return both.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("estimate") - F.col("value"))).alias("mae"), F.avg(F.col("value").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"))


def null_profile(df: DataFrame) -> DataFrame:
    """column, null_share, in one pass."""
    columns = df.columns
    shares = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).unpivot([], [f"c{i}" for i in range(len(columns))], "c", "null_share")
    return shares.select(F.element_at(F.array(*[F.lit(n) for n in columns]), F.substring("c", 2, 9).cast("int") + 1).alias("column"), "null_share")


def standard_rules(spark: SparkSession, bounds: DataFrame, variables: list[str]) -> dict[str, Rule]:
    """The rules that need nothing but the table."""
    return {
        "duplicates": duplicates,
        "ranges": lambda d: finding(out_of_range(d, bounds), "ranges", "error", "values out of their bounds"),
        "iso_gaps": lambda d: finding(week_gaps(d, ["geo_name", "variable"]), "iso_gaps", "warning", "weeks are missing"),
        "sum_agreement": lambda d: finding(sum_disagreement(d), "sum_agreement", "error", "counties don't add up to the country"),
        "evidence": lambda d: finding(wrong_evidence(d), "evidence", "error", "wrong class of evidence"),
        "surveillance_break": lambda d: finding(before_break(d, variables), "surveillance_break", "error", f"records before {BREAK}"),
        "outliers": lambda d: finding(outliers(d, "value", ["variable"]).where("robust_z > 5"), "outliers", "flag", "far from the median"),
        "price_years": lambda d: finding(mixed_price_years(d), "price_years", "error", "several price years and no deflator"),
    }
