"""Parameters, deflators and the cost model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import nulls

# The slots that may hold a parameter's number, first known one first.
SLOTS = ["value", "weight", "ratio", "rate", "probability", "multiplier", "points", "days"]


class MissingParameterError(ValueError):
    """A required parameter has no value."""


def scalar(columns: list[str]) -> Column:
    """The first known slot."""
    return F.coalesce(*[F.col(c).cast("double") for c in SLOTS if c in columns])


def as_of(values: DataFrame, wanted: DataFrame, keys: list[str], year: str = "year", value: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """For each wanted key and year: the value of that year, the last listed; else of the latest year before; else the first listed.

    A wanted year of NULL takes the last listed.
    """
    ask = wanted.withColumnRenamed(year, "__asked")
    both = ask.join(values, keys)
    exact = F.max_by(value, F.when(F.col(year).eqNullSafe(F.col("__asked")), F.col(ordinal)))
    before = F.max_by(F.when(F.col(year) <= F.col("__asked"), F.col(value)), F.when(F.col(year) <= F.col("__asked"), F.struct(year, ordinal)))
    first, last = F.min_by(value, ordinal), F.max_by(value, ordinal)
    picked = both.groupBy(*keys, "__asked").agg(exact.alias("__exact"), before.alias("__before"), first.alias("__first"), last.alias("__last"))
    found = picked.select(*keys, F.col("__asked").alias(year), F.when(F.col("__asked").isNull(), F.col("__last")).otherwise(F.coalesce("__exact", "__before", "__first")).alias(value))
    rest = ask.select(*keys, F.col("__asked").alias(year))
    return rest.join(found.withColumnRenamed(year, "__y").withColumnsRenamed({k: f"__{k}" for k in keys}), (F.col(year).eqNullSafe(F.col("__y"))) & _same(keys), "left").select(*keys, year, value)


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(k) == F.col(f"__{k}"))
    return out


def resolve(parameters: DataFrame, strict: bool = True) -> DataFrame:
    """parameter_id, value and missing; strict: a required one that is missing is an error that names all of them."""
    out = parameters.withColumn("value", scalar(parameters.columns)).withColumn("missing", F.col("value").isNull())
    if strict:
        lacking = [(r[0], r[1]) for r in out.where("missing AND required").select("parameter_id", "source_url").collect()]  # a parameter book
        if lacking:
            raise MissingParameterError(f"no value for {lacking}")
    return out


class ParameterBook:
    """Resolved parameters by name; one that is unknown or has no value is an error where it is asked for."""

    def __init__(self, resolved: DataFrame):
        have = resolved.columns
        self.rows = {r["parameter_id"]: r.asDict() for r in resolved.select("parameter_id", "value", *[c for c in ("source_url", "price_year") if c in have]).collect()}  # a parameter book

    def get(self, name: str) -> float:
        if name not in self.rows:
            raise MissingParameterError(f"no parameter {name}")
        if self.rows[name]["value"] is None:
            raise MissingParameterError(f"{name} has no value; see {self.rows[name].get('source_url') or 'the parameter file'}")
        return self.rows[name]["value"]

    def get_optional(self, name: str, default: float | None = None) -> float | None:
        value = self.rows.get(name, {}).get("value")
        return default if value is None else value

    def price_year(self, name: str) -> int | None:
        year = self.rows.get(name, {}).get("price_year")
        return None if year is None else int(year)


def deflators(index: DataFrame, base: int, keys: list[str] | None = None) -> DataFrame:
    """keys, year, factor: the index in the base year over that of the year; an error if the base year is missing."""
    keys = keys or []
    at_base = index.where(F.col("year") == base).select(*keys, F.col("index_value").alias("__base"))
    if at_base.isEmpty():
        raise ValueError(f"no index for {base}")
    joined = index.join(F.broadcast(at_base), keys) if keys else index.crossJoin(F.broadcast(at_base))
    return joined.select(*keys, "year", nulls.ratio("__base", "index_value").alias("factor"))


def real(df: DataFrame, nominal: str, factors: DataFrame, year: str, base: int) -> DataFrame:
    """Adds <nominal>_real_<base> and the year's factor as deflator; every sum stays beside its nominal one."""
    f = factors.select(F.col("year").alias("__year"), F.col("factor").alias("deflator"))
    return df.join(F.broadcast(f), F.col(year) == F.col("__year"), "left").drop("__year").withColumn(f"{nominal}_real_{base}", F.col(nominal) * F.col("deflator"))


def chained_index(changes: DataFrame, year: str = "year", yoy: str = "yoy", group: list[str] | None = None) -> DataFrame:
    """Index 100 in the last year, chained backward through yearly changes (100 is no change); links of NULL or 0 are skipped.

    A series of years is short, so a window over it is small.
    """
    back = W.partitionBy(*(group or [])).orderBy(F.desc(year)).rowsBetween(W.unboundedPreceding, -1)
    link = F.when(F.col(yoy) > 0, F.ln(F.col(yoy) / 100))
    return changes.withColumn("index_value", 100 / F.exp(F.coalesce(F.sum(link).over(back), F.lit(0.0))))


def unit_costs(p: dict[str, float]) -> dict[str, float]:
    return {"inpatient": p["hbcs_weight"] * p["base_rate"], "outpatient": p["outpatient_points"] * p["point_value"], "gp": p["gp_visit_cost"]}


def productivity_loss(cases: Column, p: dict[str, float]) -> Column:
    """Cases times the chance of leave, days of leave within the working year, wage and contributions."""
    return cases * p["work_loss_probability"] * min(p["workdays_lost"], p["working_days_per_year"]) * p["daily_wage"] * (1 + p["employer_contribution"])


def expected_cost(df: DataFrame, p: dict[str, float], medical_factor: float = 1.0, earnings_factor: float = 1.0, cases: str = "cases", births: str = "births") -> DataFrame:
    """Nominal and real costs of notified cases. A case's cost is medical alone; vaccination is listed and not part of the total."""
    u = unit_costs(p)
    true = F.col(cases) * p["underreporting"]
    inpatient, other = true * p["hospitalisation_rate"], true * (1 - p["hospitalisation_rate"])
    medical = inpatient * u["inpatient"] + other * (u["outpatient"] + u["gp"])
    lost = productivity_loss(true, p)
    per_case = F.when(F.col(cases) > 0, nulls.ratio(medical, cases)).otherwise(0.0)
    return df.withColumns(
        {"true_cases": true, "medical_nominal": medical, "medical_real": medical * medical_factor, "productivity_nominal": lost, "productivity_real": lost * earnings_factor,
         "vaccination_nominal": F.col(births) * (p["vaccine_price"] + p["administration_cost"]), "cost_per_notified_case": per_case, "cost_per_notified_case_real": per_case * medical_factor,
         "cost_per_hospitalisation": F.lit(float(u["inpatient"])), "total_nominal": medical + lost, "total_real": medical * medical_factor + lost * earnings_factor}
    )


def with_provenance(df: DataFrame, price_year: int, deflator_ids: dict[str, str], source: str) -> DataFrame:
    """What a cost panel has to say of its numbers: the deflator of each pair of nominal and real sums, the price year, and that they are estimated.

    deflator_ids: medical and earnings, the deflators by which expected_cost made its real sums.
    """
    by = {"medical": deflator_ids["medical"], "cost_per_notified_case": deflator_ids["medical"], "productivity": deflator_ids["earnings"]}
    return df.withColumns({f"{k}_deflator_id": F.lit(v) for k, v in by.items()} | {"price_year": F.lit(price_year).cast("long"), "deflator_source": F.lit(source), "cost_evidence_class": F.lit("estimated")})


# Base, low and high of the analysis' cost parameters.
ANALYSIS = {
    "hbcs_base_rate": (300000.0, 264000.0, 360000.0),
    "outpatient_point_value": (2.0, 1.6, 3.0),
    "hbcs_weight": (0.55, 0.40, 0.75),
    "outpatient_points": (300.0, 150.0, 600.0),
    "gp_visit_cost": (4000.0, 2500.0, 7000.0),
    "hospitalisation_rate": (0.45, 0.25, 0.70),
    "underreporting": (5.0, 3.0, 15.0),
    "work_loss_probability": (0.75, 0.50, 0.95),
    "workdays_lost": (3.0, 1.5, 5.0),
    "daily_wage": (30000.0, 25000.0, 35000.0),
    "employer_contribution": (0.13, 0.13, 0.13),
    "working_days_per_year": (253.0, 250.0, 255.0),
    "vaccine_price": (38000.0, 28000.0, 48000.0),
    "administration_cost": (3000.0, 1500.0, 5000.0),
    "vaccine_efficacy": (0.85, 0.75, 0.93),
}
WAGE_GROWTH = 1.09


def analysis_parameters(spark: SparkSession) -> DataFrame:
    """A row of parameters for each level."""
    rows = [(level, *[float(v[i]) for v in ANALYSIS.values()]) for i, level in enumerate(("base", "low", "high"))]
    return spark.createDataFrame(rows, ", ".join(["level string", *[f"{k} double" for k in ANALYSIS]]))


def cost_per_case() -> Column:
    """Per notified case, from the parameter columns of the row; a visit to the doctor comes with an outpatient case."""
    c = F.col
    inpatient = c("hbcs_weight") * c("hbcs_base_rate")
    outpatient = c("outpatient_points") * c("outpatient_point_value") + c("gp_visit_cost")
    direct = c("hospitalisation_rate") * inpatient + (1 - c("hospitalisation_rate")) * outpatient
    lost = c("work_loss_probability") * F.least(c("workdays_lost"), c("working_days_per_year")) * c("daily_wage") * WAGE_GROWTH * (1 + c("employer_contribution"))
    return direct + lost


def cost_effectiveness(df: DataFrame, case_cost: float, p: dict[str, float], children: str = "children", cases: str = "cases", aid: str = "aid", cohort_years: int = 15) -> DataFrame:
    """Steady state: a cohort vaccinated with the aid, the societal cost it averts, and the ratio of the two."""
    course = p["vaccine_price"] + p["administration_cost"]
    subsidy = F.greatest(F.col(aid), F.lit(1.0))
    cohort = F.col(children) / cohort_years
    covered = F.least(F.lit(1.0), F.coalesce(nulls.ratio(subsidy, cohort * course), F.lit(0.0)))
    averted = F.col(cases) * p["underreporting"] * case_cost * covered * p["vaccine_efficacy"]
    return df.withColumns({"cohort": cohort, "averted": averted, "net": averted - subsidy, "benefit_cost_ratio": nulls.ratio(averted, subsidy)})
