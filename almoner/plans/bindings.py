"""The domain's tables, made from the tables at hand, as DataFrames and as SQL.

Districts are customers, counties nations; people are orders, cases returned lines, costs order sums. Variables are
rounded so that both forms agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators.need import Dimension, Index
from ..sources.tabular import table

BUDGET = 2.5e9


def panel(spark: SparkSession, d: str) -> DataFrame:
    """One row for each district. Lines meet orders by key once and are summed by customer before anything else joins."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_shipdate", "l_returnflag", "l_extendedprice", "l_quantity")
    sums = orders.groupBy("o_custkey").agg(F.count("*").alias("population"), F.round(F.sum("o_totalprice"), 2).alias("expected_cost"))
    late = (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).cast("double")
    by = lines.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey")
    means = by.agg(F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg(late), 6).alias("late_share"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("returned"), F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("price"), F.count_if(F.col("l_returnflag") == "R").alias("cases"))
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # nations are 25
    rows = rows.join(sums.withColumnRenamed("o_custkey", "k1"), F.col("c_custkey") == F.col("k1"), "left").join(means.withColumnRenamed("o_custkey", "k2"), F.col("c_custkey") == F.col("k2"), "left")
    zero = F.lit(0).cast("long")
    made = rows.select(
        F.col("c_custkey").alias("district_id"), F.col("c_nationkey").cast("long").alias("county_id"), F.col("n_name").alias("county_name"), F.col("n_regionkey").cast("long").alias("region_id"), F.coalesce("population", zero).alias("population"), F.coalesce("expected_cost", F.lit(0.0)).alias("expected_cost"), F.coalesce("cases", zero).alias("cases"),
        F.greatest("c_acctbal", F.lit(0.0)).alias("existing_local_funding"), F.col("c_acctbal").alias("own_revenue"), (F.col("c_mktsegment") == "BUILDING").alias("eligible"), "discount", "late_share", "returned", "price",
    )
    return cut(made)  # far smaller than the lines, and read again by each step of an index


PANEL = """
op AS (SELECT o_custkey, count(*) AS population, round(sum(o_totalprice), 2) AS expected_cost FROM orders GROUP BY 1),
lp AS (SELECT o_custkey, round(avg(l_discount), 6) AS discount, round(avg(CASE WHEN l_shipdate > o_orderdate + INTERVAL 60 DAY THEN 1.0 ELSE 0.0 END), 6) AS late_share,
  round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS returned, round(avg(l_extendedprice / l_quantity), 4) AS price, count(*) FILTER (l_returnflag = 'R') AS cases
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
panel AS (SELECT c_custkey AS district_id, CAST(c_nationkey AS BIGINT) AS county_id, n_name AS county_name, CAST(n_regionkey AS BIGINT) AS region_id, coalesce(population, 0) AS population, coalesce(expected_cost, 0.0) AS expected_cost,
  coalesce(cases, 0) AS cases, greatest(c_acctbal, 0.0) AS existing_local_funding, c_acctbal AS own_revenue, c_mktsegment = 'BUILDING' AS eligible, discount, late_share, returned, price
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN op ON op.o_custkey = c_custkey LEFT JOIN lp ON lp.o_custkey = c_custkey)"""


def index(**kinds: str) -> Index:
    return Index([Dimension("disease", 0.35, ["discount"]), Dimension("socioeconomic", 0.30, ["late_share", "price_inverse"]), Dimension("healthcare", 0.20, ["returned"]), Dimension("fiscal_capacity", 0.15, ["own_revenue", "expected_cost"], inverse=True)], **kinds)


DIMS = {"disease": 0.35, "socioeconomic": 0.30, "healthcare": 0.20, "fiscal_capacity": 0.15}
_VARS = ["discount", "late_share", "price", "returned", "own_revenue", "expected_cost"]
SCORES = (
    PANEL
    + ", fz AS (SELECT panel.*, "
    + ", ".join(f"coalesce({v}, (SELECT median({v}) FROM panel)) AS v_{v}" for v in _VARS)
    + " FROM panel), zz AS (SELECT *, "
    + ", ".join(f"coalesce((v_{v} - avg(v_{v}) OVER ()) / nullif(stddev_pop(v_{v}) OVER (), 0), 0) AS z_{v}" for v in _VARS)
    + " FROM fz), scores AS (SELECT *, z_discount AS score_disease, (z_late_share - z_price) / 2 AS score_socioeconomic, z_returned AS score_healthcare, -(z_own_revenue + z_expected_cost) / 2 AS score_fiscal_capacity FROM zz)"
)
_AGAIN = ", ".join(f"100 + 10 * coalesce((score_{d} - avg(score_{d}) OVER ()) / nullif(stddev_pop(score_{d}) OVER (), 0), 0) AS y_{d}" for d in DIMS)
_MEAN = "(" + " + ".join(f"y_{d}" for d in DIMS) + ") / 4"
_VAR = "(" + " + ".join(f"(y_{d} - m) * (y_{d} - m)" for d in DIMS) + ") / 4"


def between(c: str, out: str) -> str:
    return f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE ({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) END AS {out}"


NEED = SCORES + f", mp1 AS (SELECT *, {_AGAIN} FROM scores), mp2 AS (SELECT *, {_MEAN} AS m FROM mp1), mp3 AS (SELECT *, {_VAR} AS v FROM mp2), mp4 AS (SELECT *, m - v / m AS need FROM mp3), need AS (SELECT *, {between('need', 'need_score')}, " + ", ".join(between(f"score_{d}", f"need_{d}") for d in DIMS) + " FROM mp4)"

SCENARIO_VALUES = """scen(scenario_id, base, cost, kind, eta, alpha, kappa, phi, less_local, eligible_only, passthrough, normalise) AS (VALUES
  (0, 'none', 'none', 'none', 0.0, 1.0, 0.0, 0.0, false, false, true, false), (1, 'population', 'none', 'none', 0.0, 1.0, 0.0, 0.0, false, false, false, true),
  (2, 'none', 'none', 'epidemiological', 1.0, 1.0, 0.0, 0.0, false, false, false, true), (3, 'population', 'none', 'socioeconomic', 1.0, 1.0, 0.0, 0.0, false, false, false, true),
  (4, 'population', 'none', 'healthcare', 1.0, 1.0, 0.0, 0.0, false, false, false, true), (5, 'none', 'expected_cost', 'full', 0.5, 1.0, 0.3, 0.0, true, false, false, true),
  (6, 'none', 'expected_cost', 'none', 0.0, 1.0, 0.0, 1.0, true, false, false, false), (7, 'population', 'none', 'none', 0.0, 1.0, 0.0, 0.0, false, true, false, true))"""

ALLOCATED = (
    NEED
    + ", "
    + SCENARIO_VALUES
    + f""", pre AS (SELECT need.*, {between('cases', 'epi')}, {between('own_revenue', 'fiscal')} FROM need),
raws AS (SELECT CAST(scenario_id AS BIGINT) AS scenario_id, pre.*, normalise, passthrough, CASE WHEN passthrough THEN existing_local_funding WHEN eligible_only AND NOT eligible THEN 0.0 ELSE greatest(
  (CASE WHEN base = 'population' THEN population ELSE 1 END) * (CASE WHEN cost = 'expected_cost' THEN expected_cost ELSE 1.0 END)
  * (1 + eta * pow(greatest(CASE kind WHEN 'epidemiological' THEN epi WHEN 'socioeconomic' THEN need_socioeconomic WHEN 'healthcare' THEN need_healthcare WHEN 'full' THEN need_score ELSE 0.0 END, 0), alpha))
  * (1 - kappa * fiscal) - (CASE WHEN less_local THEN existing_local_funding ELSE 0.0 END) - phi * own_revenue, 0.0) END AS raw FROM pre, scen),
alloc1 AS (SELECT *, CASE WHEN normalise THEN {BUDGET} * raw / nullif(sum(raw) OVER (PARTITION BY scenario_id), 0) ELSE raw END AS aid_amount FROM raws),
alloc AS (SELECT *, aid_amount - coalesce(max(CASE WHEN scenario_id = 0 THEN aid_amount END) OVER (PARTITION BY district_id), 0) AS delta_vs_baseline FROM alloc1)"""
)


def county_years(spark: SparkSession, d: str) -> DataFrame:
    """county_id, year, cases: returned lines. The join to customers is on orders summed by customer and year."""
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("year"))
    by = returned.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "year").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("county_id"))
    return by.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("county_id", "year").agg(F.sum("n").alias("cases"))


COUNTY_YEARS = "cy AS (SELECT CAST(c_nationkey AS BIGINT) AS county_id, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS cases FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' GROUP BY 1, 2)"


def vintages(spark: SparkSession, d: str) -> DataFrame:
    """settlement_id, vintage, district_id: of each customer and year the priority of its last order."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("settlement_id"), F.year("o_orderdate").cast("long").alias("vintage")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("district_id"))


def registry_years(spark: SparkSession, d: str) -> DataFrame:
    """The vintages as yearly registries: names, counties and regions of customers, whose districts are priorities within a county."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = vintages(spark, d).join(c, F.col("settlement_id") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    district = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("-"), F.col("district_id"))
    return rows.select("settlement_id", "vintage", F.col("c_name").alias("settlement_name"), F.lit("").alias("postal_codes"), district.alias("district_id"), F.col("district_id").alias("district_name"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("county_id"), F.col("n_name").alias("county_name"), F.col("n_name").alias("nuts3_code"), F.col("n_regionkey").cast("string").alias("nuts2_code"))


VINTAGES = "vint AS (SELECT o_custkey AS settlement_id, CAST(year(o_orderdate) AS BIGINT) AS vintage, arg_max(o_orderpriority, o_orderkey) AS district_id FROM orders GROUP BY 1, 2)"


def price_years(spark: SparkSession, d: str) -> DataFrame:
    """year, price: the mean price of lines by order year; yoy: against the year before, 100 is no change."""
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))
    l = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))  # noqa: E741
    p = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("year").agg(F.round(F.avg("p"), 6).alias("price"))
    return p.withColumn("yoy", F.round(100 * F.col("price") / F.lag("price").over(W.orderBy("year")), 6))  # a row for each year


PRICE_YEARS = "py0 AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, round(avg(l_extendedprice / l_quantity), 6) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), py AS (SELECT year, price, round(100 * price / lag(price) OVER (ORDER BY year), 6) AS yoy FROM py0)"


def surveillance(spark: SparkSession, d: str) -> DataFrame:
    """Events as weekly reports: geo_name, variable, value, iso_year, iso_week, period_start and what else the rules look at."""
    from ..functions.dates import iso_year

    e = table(spark, d, "events")
    day = F.col("ts").cast("date")
    rows = e.groupBy((F.col("user_id") % 20).alias("geo"), F.col("event_type").alias("variable"), iso_year(day).cast("long").alias("iso_year"), F.weekofyear(day).cast("long").alias("iso_week"), F.date_trunc("week", day).cast("date").alias("period_start")).agg(F.count("*").cast("double").alias("value"))
    return rows.withColumns({"geo_name": F.concat(F.lit("unit"), "geo"), "geo_level": F.when(F.col("geo") == 0, "country").when(F.col("geo") < 3, "district").otherwise("county"), "evidence_class": F.when(F.col("geo") == 7, "guessed").otherwise("observed"), "source_id": F.when(F.col("geo") == 1, "nngyk_foia").otherwise("nngyk")})


SURVEILLANCE = """sv AS (SELECT user_id % 20 AS geo, event_type AS variable, CAST(isoyear(ts) AS BIGINT) AS iso_year, CAST(week(ts) AS BIGINT) AS iso_week, CAST(date_trunc('week', ts) AS DATE) AS period_start, CAST(count(*) AS DOUBLE) AS value, 'unit' || (user_id % 20) AS geo_name,
  CASE WHEN user_id % 20 = 0 THEN 'country' WHEN user_id % 20 < 3 THEN 'district' ELSE 'county' END AS geo_level, CASE WHEN user_id % 20 = 7 THEN 'guessed' ELSE 'observed' END AS evidence_class, CASE WHEN user_id % 20 = 1 THEN 'nngyk_foia' ELSE 'nngyk' END AS source_id FROM events GROUP BY ALL)"""
