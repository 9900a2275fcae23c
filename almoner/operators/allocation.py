"""Budget allocation: a scenario is a row of parameters, all scenarios are one plan."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nulls, selection
from .need import unit_interval


class AllocationError(ValueError):
    """Nothing to share the budget by."""


@dataclass
class Scenario:
    scenario_id: int
    scenario_name: str
    base: str = "none"  # none or population
    cost: str = "none"  # none or expected_cost
    need: str = "none"  # none, epidemiological, socioeconomic, healthcare or full
    eta: float = 0.0
    alpha: float = 1.0
    kappa: float = 0.0
    phi: float = 0.0
    less_local: bool = False
    floor: float = 0.0
    eligible_only: bool = False
    passthrough: bool = False
    normalise: bool = True


# The eight scenarios.
SCENARIOS = [
    Scenario(0, "existing", passthrough=True, normalise=False),
    Scenario(1, "per_capita", base="population"),
    Scenario(2, "epidemiological", need="epidemiological", eta=1.0),
    Scenario(3, "socioeconomic", base="population", need="socioeconomic", eta=1.0),
    Scenario(4, "healthcare", base="population", need="healthcare", eta=1.0),
    Scenario(5, "full", cost="expected_cost", need="full", eta=0.5, kappa=0.3, less_local=True),
    Scenario(6, "cost_gap", cost="expected_cost", phi=1.0, less_local=True, normalise=False),
    Scenario(7, "beneficiary", base="population", eligible_only=True),
]

SCHEMA = "scenario_id int, scenario_name string, base string, cost string, need string, eta double, alpha double, kappa double, phi double, less_local boolean, floor double, eligible_only boolean, passthrough boolean, normalise boolean"


def scenario_rows(spark: SparkSession, scenarios: list[Scenario] | None = None) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(s).values()) for s in scenarios or SCENARIOS], SCHEMA)


def prepare(panel: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Fills in the terms a scenario may ask for; absent columns count 1 as factors and 0 as deductions, all are eligible.

    epidemiological: cases, put between least and most; fiscal: own revenue, likewise, and as it is.
    """
    have = set(panel.columns)
    zero, one = F.lit(0.0), F.lit(1.0)
    get = lambda c, other: F.coalesce(nulls.known(F.col(c).cast("double")), zero) if c in have else other
    terms = {
        "aux_population": get("population", one), "aux_expected_cost": get("expected_cost", one), "aux_local": get("existing_local_funding", zero), "aux_revenue": get("own_revenue", zero),
        "epidemiological": F.col("cases").cast("double") if "cases" in have else zero, "fiscal": F.col("own_revenue").cast("double") if "own_revenue" in have else zero,
        "aux_eligible": F.coalesce(F.col("eligible"), F.lit(False)) if "eligible" in have else F.lit(True),
        "aux_socioeconomic": get("need_socioeconomic", zero), "aux_healthcare": get("need_healthcare", zero), "aux_full": get("need_score", zero),
    }
    return unit_interval(panel.withColumns(terms), ["epidemiological", "fiscal"], group)


def raw_share(s: Scenario) -> Column:
    """What a scenario shares by, over the columns of `prepare`; negative only where a passed-through amount is."""
    c = F.col
    if s.passthrough:
        return c("aux_local")
    need = {"epidemiological": "epidemiological", "socioeconomic": "aux_socioeconomic", "healthcare": "aux_healthcare", "full": "aux_full"}.get(s.need)
    term = F.greatest(F.coalesce(c(need), F.lit(0.0)), F.lit(0.0)) if need else F.lit(0.0)
    factor = (c("aux_population") if s.base == "population" else F.lit(1.0)) * (c("aux_expected_cost") if s.cost == "expected_cost" else F.lit(1.0))
    raw = factor * (1 + s.eta * F.pow(term, F.lit(float(s.alpha)))) * (1 - s.kappa * F.coalesce("fiscal", F.lit(0.0)))
    raw = F.greatest(raw - (c("aux_local") if s.less_local else F.lit(0.0)) - s.phi * c("aux_revenue"), F.lit(float(s.floor)))
    return F.when(c("aux_eligible"), raw).otherwise(0.0) if s.eligible_only else raw


def allocate(panel: DataFrame, scenarios: DataFrame, budget: float, group: list[str] | None = None, check: bool = True) -> DataFrame:
    """A row for each scenario and district with aid_amount and delta_vs_baseline (against scenario 0; 0 where that has none).

    raw = base * cost * (1 + eta * need ** alpha) * (1 - kappa * F) - L - phi * FC, at least the floor, 0 if ineligible;
    normalised scenarios then share the budget by raw. check: an error if a normalised scenario has nothing to share by.
    Scenarios are rows of parameters, taken to the driver; each is a column of the panel, their sums are one aggregation,
    and a district's scenarios are dealt out at the end, so districts are not shuffled.
    """
    group, c = group or [], F.col
    told = [Scenario(**r.asDict()) for r in scenarios.orderBy("scenario_id").collect()]  # a row for each scenario
    rows = prepare(panel, group).withColumns({f"__raw_{i}": raw_share(s) for i, s in enumerate(told)})
    shared = [i for i, s in enumerate(told) if s.normalise and not s.passthrough]
    sums = rows.groupBy(*group).agg(*[F.sum(f"__raw_{i}").alias(f"__sum_{i}") for i in shared]) if shared else None
    if check and shared:
        bad = sums.agg(*[F.count_if(~(F.coalesce(f"__sum_{i}", F.lit(0.0)) > 0)).alias(str(i)) for i in shared]).first()
        if lacking := [told[i].scenario_id for i in shared if bad[str(i)]]:
            raise AllocationError(f"nothing to share by in scenarios {sorted(lacking)}")
    if shared and group:
        rows = rows.join(sums, group)
    elif shared:
        rows = rows.withColumns({f"__sum_{i}": F.lit(v).cast("double") for i, v in zip(shared, sums.first(), strict=True)})
    aid = [F.coalesce(nulls.ratio(budget * c(f"__raw_{i}"), f"__sum_{i}"), F.lit(0.0)) if i in shared else c(f"__raw_{i}").cast("double") for i in range(len(told))]
    rows = rows.withColumns({f"__aid_{i}": a for i, a in enumerate(aid)})
    baseline = next((F.coalesce(c(f"__aid_{i}"), F.lit(0.0)) for i, s in enumerate(told) if s.scenario_id == 0), F.lit(0.0))
    each = [F.struct(F.lit(s.scenario_id).cast("int").alias("scenario_id"), F.lit(s.scenario_name).alias("scenario_name"), c(f"__aid_{i}").alias("aid_amount"), (c(f"__aid_{i}") - baseline).alias("delta_vs_baseline")) for i, s in enumerate(told)]
    return rows.withColumn("__each", F.explode(F.array(*each))).select(*panel.columns, "__each.*")


def redistribution(allocated: DataFrame, county: str = "county_id", to: int = 2, than: int = 1) -> DataFrame:
    """By county: what scenario `to` gives more than scenario `than`."""
    pick = lambda k: F.sum(F.when(F.col("scenario_id") == k, F.col("aid_amount")).otherwise(0.0))
    return allocated.where(F.col("scenario_id").isin(to, than)).groupBy(county).agg((pick(to) - pick(than)).alias("shift"))


def policy_overlap(df: DataFrame, score: str = "need_score", eligible: str = "eligible", part: float = 0.2, unit: str = "district_id") -> DataFrame:
    """How the neediest part (exactly n * part rows, ties to the least id) and the eligible units meet: counts, Jaccard, share covered."""
    n = df.count()
    k = max(1, int(n * part))
    best = df.orderBy(F.desc_nulls_last(score), unit).limit(k).select(unit, F.lit(True).alias("__top"))
    both = df.select(unit, F.coalesce(F.col(eligible), F.lit(False)).alias("__el")).join(best, unit, "left").withColumn("__top", F.coalesce("__top", F.lit(False)))
    count = lambda x: F.sum(x.cast("long"))
    c = F.col
    return both.agg(count(c("__top")).alias("n_top"), count(c("__el")).alias("n_eligible"), count(c("__top") & c("__el")).alias("n_both"), nulls.ratio(count(c("__top") & c("__el")), count(c("__top") | c("__el"))).alias("jaccard"), nulls.ratio(count(c("__top") & c("__el")), count(c("__top"))).alias("share_covered"))


def shares_by_score(df: DataFrame, budget: float, weight: str, score: str) -> DataFrame:
    """The analysis' form: a share of weight * (score - least + 0.01), without a base of 1."""
    low = df.agg(F.min(score).alias("__low"))
    rows = df.crossJoin(F.broadcast(low)).withColumn("__raw", F.greatest(F.col(weight) * (F.col(score) - F.col("__low") + 0.01), F.lit(0.0)))
    whole = rows.agg(F.sum("__raw").alias("__sum"))
    return rows.crossJoin(F.broadcast(whole)).withColumn("aid_amount", F.when(F.col("__sum") > 0, budget * F.col("__raw") / F.nullif("__sum", F.lit(0.0))).otherwise(0.0)).drop("__low", "__raw", "__sum")


def wide(df: DataFrame, budget: float, eta: float, people: str = "population", cases: str = "cases", cost: str = "expected_cost", local: str = "existing_local_funding", need: str = "need_score", socio: str = "score_socioeconomic", care: str = "score_healthcare", eligible: str | None = None) -> DataFrame:
    """df with the analysis' eight allocations as columns s0 to s7, and eligible_units, their number.

    s0 is what municipalities give, an amount for each case, at least one; s1 to s5 and s7 share the budget by people, cases,
    people times scores above the least (plus 0.01), cost times need, and people of eligible units; s6 is what cost leaves
    beyond s0, not shared. Without a column of eligible units these are the ones whose socioeconomic score reaches its
    two-thirds quantile. What is negative counts 0; where there is nothing to share by, all get 0.
    """
    c = F.col
    known = lambda x: F.coalesce(nulls.known(c(x).cast("double")), F.lit(0.0))
    low = df.agg(F.min(socio).alias("socio"), F.min(care).alias("care")).first()
    if eligible:
        may = F.coalesce(c(eligible).cast("boolean"), F.lit(False))
    else:
        cut_at = selection.quantiles(df, [], {"q": c(socio)}, [2 / 3]).first()
        may = F.coalesce(c(socio) >= F.lit(cut_at["value"] if cut_at else None).cast("double"), F.lit(False))
    envelope = known(local) * F.greatest(known(cases), F.lit(1.0))
    raw = {
        "s1": known(people), "s2": known(cases), "s3": known(people) * (c(socio) - F.lit(low["socio"]).cast("double") + 0.01), "s4": known(people) * (c(care) - F.lit(low["care"]).cast("double") + 0.01),
        "s5": known(cost) * (1 + eta * known(need)), "s7": F.when(may, known(people)).otherwise(0.0),
    }
    raw = {k: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)) for k, v in raw.items()}
    sums = df.agg(*[F.sum(v).alias(k) for k, v in raw.items()], F.count_if(may).alias("n")).first()
    shared = {k: (F.lit(0.0) if not sums[k] else budget * v / F.lit(float(sums[k]))) for k, v in raw.items()}
    made = {"s0": envelope, "s6": F.greatest(known(cost) - envelope, F.lit(0.0))} | shared
    return df.withColumns({k: made[k] for k in sorted(made)} | {"eligible_units": F.lit(sums["n"]).cast("long")})


def _runs(x: Column, size: int) -> Column:
    """The runs of so many letters of a text, in order; a shorter text has none."""
    return F.when(F.length(x) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - size + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def found_keys(names: DataFrame, keys: DataFrame, run: int = 3) -> DataFrame:
    """name, key: which keys stand in which distinct names, whatever their case; any number of either.

    A key is filed under the rarest of its runs of letters (counted over the names' runs), so a name meets only keys whose
    rarest run it has; keys shorter than a run are their own run. An empty or missing key stands in no name.
    """
    n = names.select(F.col("name"), F.lower("name").alias("__n")).where(F.col("name").isNotNull()).distinct()
    k = keys.select(F.col("key"), F.lower("key").alias("__k")).where(F.length("key") > 0).distinct()
    runs = n.select("name", "__n", F.explode(F.array_distinct(F.flatten(F.array(*[_runs(F.col("__n"), i) for i in range(1, run + 1)])))).alias("__g"))
    often = runs.groupBy("__g").agg(F.count("*").alias("__often"))
    own = F.when(F.length("__k") < run, F.array("__k")).otherwise(_runs(F.col("__k"), run))
    # a run that no name has rules its key out, so inner joins lose nothing once all of a key's runs are there
    spread = k.select("key", "__k", F.explode(F.array_distinct(own)).alias("__g")).join(often, "__g", "left")
    filed = spread.groupBy("key", "__k").agg(F.min(F.struct(F.coalesce("__often", F.lit(0)).alias("often"), F.col("__g").alias("g"))).alias("r")).where("r.often > 0").select("key", "__k", F.col("r.g").alias("__g"))
    return runs.join(filed, "__g").where(F.contains("__n", F.col("__k"))).select("name", "key").distinct()


def municipal_funding(supports: DataFrame, bridge: DataFrame) -> DataFrame:
    """district_id and envelope: an amount for each case, at least one; municipalities are found by a key in their names.

    A municipality that holds several keys of a district counts once for each, as rows of the bridge do.
    """
    found = found_keys(supports.select(F.col("municipality").alias("name")), bridge.select("key"))
    met = supports.join(found, F.col("municipality") == F.col("name")).join(bridge, "key")
    return met.groupBy("district_id").agg(F.sum(F.col("amount") * F.greatest(F.col("cases"), F.lit(1.0))).alias("envelope"))
