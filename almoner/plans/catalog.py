"""The queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import counter, dates, nulls, order, tails, text
from ..functions.lineage import cut
from ..operators import allocation, costs, equity, geography, need, panel, probabilistic, rules, sensitivity, validation
from ..sources import collectors, html, tabular
from ..sources.tabular import table
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def _days(c: str) -> Column:
    return F.col(c).cast("date")


# Scans, filters, aggregations.


@query("SELECT user_id % 20 AS geo, event_type AS variable, CAST(isoyear(ts) AS BIGINT) AS iso_year, CAST(week(ts) AS BIGINT) AS iso_week, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def weekly_counts(s: SparkSession, d: str) -> DataFrame:
    day = _days("ts")
    g = table(s, d, "events").groupBy((F.col("user_id") % 20).alias("geo"), F.col("event_type").alias("variable"), dates.iso_year(day).cast("long").alias("iso_year"), F.weekofyear(day).cast("long").alias("iso_week"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {b.COUNTY_YEARS} SELECT county_id, year, CAST(cases AS DOUBLE) AS cases FROM cy")
def county_year_cases(s: SparkSession, d: str) -> DataFrame:
    return panel.yearly(b.county_years(s, d), ["county_id", "year"], "cases", "cases")


@query("SELECT c_mktsegment AS unit, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def monthly_mean_by_unit(s: SparkSession, d: str) -> DataFrame:
    o, c = table(s, d, "orders"), table(s, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("unit"), F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS county_id, count(*) AS n, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS n_listed, round(count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) / count(*), 6) AS share FROM customer GROUP BY 1")
def conditional_counts(s: SparkSession, d: str) -> DataFrame:
    listed = F.count_if(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return table(s, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("county_id")).agg(F.count("*").alias("n"), listed.alias("n_listed"), r6(listed / F.count("*")).alias("share"))


@query("SELECT l_returnflag AS flag, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k > 1 GROUP BY 1")
def dup_marking(s: SparkSession, d: str) -> DataFrame:
    rows = validation.duplicate_rows(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"])
    return rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def dedup_latest(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return tabular.keep_latest(e, ["user_id"], "at").select("user_id", "event_id", "event_type")


@query("SELECT CAST(c_nationkey AS BIGINT) AS county_id, o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey) WHERE k = 1")
def snapshot_thinning(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return collectors.first_of_month(o, "o_orderdate", ["c_nationkey"], "o_orderkey").select(F.col("c_nationkey").cast("long").alias("county_id"), "o_orderkey", F.date_trunc("month", "o_orderdate").cast("date").alias("month"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def latest_snapshot(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    return o.join(F.broadcast(last), F.col("o_orderdate") == F.col("last")).select("o_orderkey", "o_custkey")


@query(f"WITH {b.PANEL} SELECT 'discount' AS \"column\", round(avg(CASE WHEN discount IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share FROM panel UNION ALL SELECT 'price', round(avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM panel UNION ALL SELECT 'county_id', 0.0")
def null_profile(s: SparkSession, d: str) -> DataFrame:
    return rounded(validation.null_profile(b.panel(s, d).select("discount", "price", "county_id")))


@query("SELECT c_mktsegment AS segment, " + ", ".join(f"count(*) FILTER (n_regionkey = {i}) AS r{i}" for i in range(5)) + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def crosstab(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("c_mktsegment").alias("segment")).pivot("n_regionkey", list(range(5))).count().na.fill(0).withColumnsRenamed({str(i): f"r{i}" for i in range(5)})


@query("SELECT CAST(c_nationkey AS BIGINT) AS county_id, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(count(*) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY ALL")
def unpivot_long(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wide = o.withColumn("year", F.year("o_orderdate")).groupBy(F.col("c_nationkey").cast("long").alias("county_id")).pivot("year", list(range(1995, 2002))).count()
    return tabular.years_long(wide, ["county_id"]).withColumn("year", F.col("year").cast("long"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_props_agg(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(s, d, "events").groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT CAST(isoyear(x) AS BIGINT) AS iso_year, CAST(week(x) AS BIGINT) AS iso_week, CAST(x AS DATE) AS period_start, CAST(x + INTERVAL 6 DAY AS DATE) AS period_end, coalesce(n, 0) AS n_events FROM (SELECT unnest(generate_series(date_trunc('week', min(ts)), max(ts), INTERVAL 7 DAY)) AS x FROM events) LEFT JOIN (SELECT date_trunc('week', ts) AS w, count(*) AS n FROM events GROUP BY 1) ON w = x")
def week_calendar(s: SparkSession, d: str) -> DataFrame:
    """Every week from the first event to the last, and how many events it has."""
    e = table(s, d, "events").select(_days("ts").alias("day"))
    first, last = e.agg(F.min("day").cast("string"), F.max("day").cast("string")).first()
    counts = e.groupBy(F.date_trunc("week", "day").cast("date").alias("period_start")).agg(F.count("*").alias("n_events"))
    return rounded(dates.week_calendar(s, first, last).join(counts, "period_start", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long"))))


# Joins.


@query(f"WITH {b.PANEL}, {b.COUNTY_YEARS}, sh AS (SELECT district_id, county_id, county_name, CASE WHEN sum(population) OVER (PARTITION BY county_id) = 0 THEN 1.0 / count(*) OVER (PARTITION BY county_id) ELSE population / sum(population) OVER (PARTITION BY county_id) END AS share FROM panel) SELECT p.district_id, p.county_id, p.county_name, cy.year, round(cy.cases * sh.share, 6) AS cases_modelled FROM panel p JOIN sh USING (district_id) LEFT JOIN cy ON cy.county_id = p.county_id")
def left_dim_chain(s: SparkSession, d: str) -> DataFrame:
    p = b.panel(s, d)
    estimates = panel.population_share(b.county_years(s, d), p.select("district_id", "county_id", "population"))
    names = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("county_id"), F.col("n_name").alias("county_name"))
    return panel.district_panel(p.select("district_id", "county_id"), estimates, names).select("district_id", "county_id", "county_name", "year", r6("cases_modelled").alias("cases_modelled"))


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS county_id FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)")
def anti_invalid_ids(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"))
    return validation.unknown_ids(table(s, d, "customer"), known, "c_nationkey").select("c_custkey", F.col("c_nationkey").cast("long").alias("county_id"))


@query("WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), u AS (SELECT DISTINCT user_id FROM events), p AS (SELECT DISTINCT day FROM e) SELECT day, count(*) AS n_missing FROM (SELECT user_id, day FROM u, p EXCEPT SELECT user_id, day FROM e) GROUP BY 1")
def missing_units(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", _days("ts").alias("day"))
    return validation.missing_units(e, e.select("user_id"), "user_id", "day").groupBy("day").agg(F.count("*").alias("n_missing"))


_ASKED_YEARS = (1980, 1994, 1996, 1998, 2000, 2010, None)


@query(f"""WITH y AS (SELECT o_orderpriority AS k, CAST(year(o_orderdate) AS BIGINT) AS year, round(min(o_totalprice), 2) AS lo, round(max(o_totalprice), 2) AS hi FROM orders WHERE year(o_orderdate) % 2 = 0 OR o_orderpriority < '3' GROUP BY 1, 2), v AS (SELECT k, year, lo AS value, (2100 - year) * 10 + 1 AS ordinal FROM y UNION ALL SELECT k, year, hi, (2100 - year) * 10 + 2 FROM y),
w AS (SELECT k, CAST(a AS BIGINT) AS asked FROM (SELECT DISTINCT o_orderpriority AS k FROM orders UNION ALL SELECT 'unknown'), (VALUES {', '.join(f'({y if y else "NULL"})' for y in _ASKED_YEARS)}) t(a))
SELECT k, asked AS year, CASE WHEN asked IS NULL THEN (SELECT arg_max(value, ordinal) FROM v WHERE v.k = w.k) ELSE coalesce((SELECT arg_max(value, ordinal) FROM v WHERE v.k = w.k AND v.year = asked), (SELECT arg_max(value, year * 100000 + ordinal) FROM v WHERE v.k = w.k AND v.year <= asked), (SELECT arg_min(value, ordinal) FROM v WHERE v.k = w.k)) END AS value FROM w""")
def asof_parameter(s: SparkSession, d: str) -> DataFrame:
    """Least and greatest order of a priority and year as two listings of a parameter, the latest year listed first; some years are missing."""
    year = F.year("o_orderdate").cast("long")
    o = table(s, d, "orders")
    by = o.where((year % 2 == 0) | (F.col("o_orderpriority") < "3")).groupBy(F.col("o_orderpriority").alias("k"), year.alias("year")).agg(F.round(F.min("o_totalprice"), 2).alias("lo"), F.round(F.max("o_totalprice"), 2).alias("hi"))
    listed = by.select("k", "year", F.posexplode(F.array("lo", "hi")).alias("i", "value")).select("k", "year", "value", ((2100 - F.col("year")) * 10 + F.col("i") + 1).alias("ordinal"))
    names = o.select(F.col("o_orderpriority").alias("k")).distinct().union(s.createDataFrame([("unknown",)], "k string"))
    wanted = names.select("k", F.explode(F.array(*[F.lit(y).cast("long") for y in _ASKED_YEARS])).alias("year"))
    return costs.as_of(listed, wanted, ["k"])


@query(f"WITH {b.COUNTY_YEARS}, dims AS (SELECT * FROM cy WHERE NOT (county_id % 5 = 0 AND year > 1998) AND county_id <> 7), want AS (SELECT n_nationkey AS county_id, y AS year FROM nation, (VALUES (1997), (2000)) t(y)) SELECT CAST(w.county_id AS BIGINT) AS county_id, CAST(w.year AS BIGINT) AS year, coalesce((SELECT cases FROM dims WHERE dims.county_id = w.county_id AND dims.year = w.year), (SELECT arg_max(cases, year) FROM dims WHERE dims.county_id = w.county_id), -1) AS cases FROM want w")
def latest_fallback(s: SparkSession, d: str) -> DataFrame:
    dims = b.county_years(s, d).where("NOT (county_id % 5 = 0 AND year > 1998) AND county_id <> 7")
    want = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("county_id"), F.lit(-1).cast("long").alias("proxy"), F.explode(F.array(F.lit(1997).cast("long"), F.lit(2000).cast("long"))).alias("year"))
    return panel.latest_or_proxy(want, dims, ["county_id"], "year", "cases", "proxy").select("county_id", "year", "cases")


@query("SELECT p_brand, CAST(p_size AS BIGINT) AS p_size, min(p_type) AS p_type FROM part GROUP BY p_brand, p_size HAVING count(DISTINCT p_type) = 1")
def unambiguous_bridge(s: SparkSession, d: str) -> DataFrame:
    return geography.unambiguous(table(s, d, "part"), ["p_brand", "p_size"], "p_type").withColumn("p_size", F.col("p_size").cast("long"))


@query("""WITH pl AS (SELECT p_name, min(p_brand) AS district_id, CAST(1000 + row_number() OVER (ORDER BY p_name) AS VARCHAR) AS code FROM part GROUP BY 1),
a AS (SELECT DISTINCT p_name, p_partkey % 6 AS how FROM part), q AS (SELECT *, CASE how WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 'x' WHEN 2 THEN code WHEN 3 THEN 'qqqq ' || substr(p_name, 1, 1) || ' wwww' ELSE 'hand ' || how || ' ' || p_name END AS name FROM a JOIN pl USING (p_name))
SELECT DISTINCT name, CASE WHEN how IN (0, 2, 4) THEN district_id END AS district_id, CASE how WHEN 0 THEN 'exact_name' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'postal' WHEN 4 THEN 'manual' ELSE 'none' END AS method, CASE WHEN how IN (0, 2, 4) THEN 'confirmed' WHEN how = 5 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN how = 1 THEN round(200.0 * length(p_name) / (2 * length(p_name) + 1), 6) END AS score FROM q""")
def fuzzy_residual(s: SparkSession, d: str) -> DataFrame:
    """Names of parts, asked for in capitals, with a letter too many, by code, by hand, or not to be found."""
    part = table(s, d, "part")
    places = order.numbered(part.groupBy("p_name").agg(F.min("p_brand").alias("district_id")), [], [F.col("p_name")], "ordinal")
    places = places.select("p_name", F.col("p_name").alias("settlement_name"), (1000 + F.col("ordinal")).cast("string").alias("postal_codes"), "district_id", "ordinal")
    how, c = F.col("p_partkey") % 6, F.col
    asked = part.select("p_name", how.alias("how")).distinct().join(places, "p_name")
    by_hand = F.concat(F.lit("hand "), c("how").cast("string"), F.lit(" "), c("p_name"))
    name = F.when(c("how") == 0, F.upper("p_name")).when(c("how") == 1, F.concat("p_name", F.lit("x"))).when(c("how") == 2, c("postal_codes")).when(c("how") == 3, F.concat(F.lit("qqqq "), F.substring("p_name", 1, 1), F.lit(" wwww"))).otherwise(by_hand)
    asked = cut(asked.withColumn("name", name))
    hand = asked.where("how > 3").select("name", F.when(c("how") == 4, c("district_id")).alias("district_id"), (c("how") == 4).alias("confirmed"))
    return rounded(geography.crosswalk(asked.select("name"), places.drop("p_name"), hand))


# Small areas, smoothing.


_SHARES = f"WITH {b.PANEL}, {b.COUNTY_YEARS}, sh AS (SELECT district_id, county_id, population, CASE WHEN sum(population) OVER (PARTITION BY county_id) = 0 THEN 1.0 / count(*) OVER (PARTITION BY county_id) ELSE population / sum(population) OVER (PARTITION BY county_id) END AS share FROM panel), est AS (SELECT district_id, county_id, year, cases * share AS e, population FROM cy JOIN sh USING (county_id))"


@query(_SHARES + " SELECT district_id, county_id, year, round(e, 6) AS cases_modelled, round(greatest(0, e * 0.5), 6) AS cases_modelled_lo, round(e * 1.5, 6) AS cases_modelled_hi, round(1000 * e / nullif(population, 0), 6) AS incidence FROM est")
def small_area_share(s: SparkSession, d: str) -> DataFrame:
    est = panel.population_share(b.county_years(s, d), b.panel(s, d).select("district_id", "county_id", "population"))
    return rounded(est.select("district_id", "county_id", "year", "cases_modelled", "cases_modelled_lo", "cases_modelled_hi", "incidence"))


@query(_SHARES + " SELECT county_id, year, cy.cases, round(sum(e), 4) AS apportioned, abs(any_value(cy.cases) - sum(e)) <= 1e-6 AS conserved FROM est JOIN cy USING (county_id, year) GROUP BY ALL")
def conservation_audit(s: SparkSession, d: str) -> DataFrame:
    cases = b.county_years(s, d)
    est = panel.population_share(cases, b.panel(s, d).select("district_id", "county_id", "population"))
    return rounded(panel.conservation(est, cases), 4)


def _burden_sql(below: str, five: str, is_: str) -> str:
    return f"""WITH {b.PANEL}, d0 AS (SELECT district_id, county_id, CASE WHEN population > 0 THEN CAST(population AS DOUBLE) END AS people, CASE WHEN population > 0 THEN cases / CAST(population AS DOUBLE) END AS rate FROM panel),
cm AS (SELECT county_id, median(people) AS m FROM d0 GROUP BY 1), d1 AS (SELECT district_id, county_id, coalesce(people, m) AS people, coalesce(rate, (SELECT median(rate) FROM d0)) AS rate FROM d0 LEFT JOIN cm USING (county_id)),
cc AS (SELECT county_id, sum(cases) AS cases FROM panel GROUP BY 1), ch AS (SELECT CAST(c_nationkey AS BIGINT) AS county_id, 10.0 * count(*) AS children FROM customer GROUP BY 1),
d2 AS (SELECT *, people / sum(people) OVER (PARTITION BY county_id) AS share FROM d1), d3 AS (SELECT district_id, people, rate, cc.cases * share AS burden, ch.children * share AS children FROM d2 LEFT JOIN cc USING (county_id) LEFT JOIN ch USING (county_id))
SELECT district_id, round(people, 4) AS people, round(rate, 6) AS jobseeker_rate, round(burden, 6) AS burden, round(burden * 0.5, 6) AS burden_lo, round(burden * 1.5, 6) AS burden_hi, round({below}, 6) AS children, round({five}, 6) AS under_five,
round(burden / nullif({below}, 0) * 100000, 4) AS burden_rate, {f"round(burden / nullif({five}, 0) * 1000, 4)" if below != five else f"round(burden / nullif({below}, 0) * 100000, 4)"} AS burden_rate_u5, '{is_}' AS denominator_is FROM d3"""


def _burden(s: SparkSession, d: str, children: bool) -> DataFrame:
    p = b.panel(s, d)
    people = p.where("population > 0").select("district_id", F.col("population").cast("double").alias("people"), F.col("cases").cast("double").alias("jobseekers"))
    cases = p.groupBy("county_id").agg(F.sum("cases").cast("double").alias("cases"))
    young = table(s, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("county_id")).agg((F.count("*") * 10.0).alias("children"))
    out = panel.burden(p.select("district_id", "county_id"), people, cases, young if children else None)
    keep = ["district_id", "people", "jobseeker_rate", "burden", "burden_lo", "burden_hi", "children", "under_five", "burden_rate", "burden_rate_u5", "denominator_is"]
    return out.select(*[F.round(c, 4).alias(c) if c in ("people", "burden_rate", "burden_rate_u5") else r6(c).alias(c) if c not in ("district_id", "denominator_is") else F.col(c) for c in keep])


@query(_burden_sql("children", "(children * 0.34)", "children"))
def district_burden(s: SparkSession, d: str) -> DataFrame:
    """Cases by part of the county's people, and rates by its children."""
    return _burden(s, d, True)


@query(_burden_sql("people", "people", "people"))
def district_burden_proxy(s: SparkSession, d: str) -> DataFrame:
    """The same where no table of children is at hand."""
    return _burden(s, d, False)


_RISK = f"WITH {b.PANEL}, ex AS (SELECT district_id, county_id, cases, population * (SELECT sum(cases) / sum(population) FROM panel) AS expected FROM panel), rr AS (SELECT *, CASE WHEN expected > 0 THEN cases / expected END AS rr FROM ex), mv AS (SELECT avg(rr) AS m, var_pop(rr) AS v FROM rr)"


def _expected(s: SparkSession, d: str) -> DataFrame:
    p = b.panel(s, d).select("district_id", "county_id", "population", "cases")
    national = p.agg((F.sum("cases") / F.sum("population")).alias("national"))
    return p.crossJoin(F.broadcast(national)).withColumn("expected", F.col("population") * F.col("national"))


@query(_RISK + " SELECT district_id, round(rr, 6) AS relative_risk, round(CASE WHEN v > 0 AND m > 0 THEN (cases + m * m / v) / (expected + m / v) ELSE coalesce(rr, 1) END, 6) AS smoothed_risk FROM rr, mv")
def empirical_bayes(s: SparkSession, d: str) -> DataFrame:
    return rounded(panel.empirical_bayes(_expected(s, d), "cases", "expected").select("district_id", "relative_risk", "smoothed_risk"))


@query(_RISK + ", c AS (SELECT county_id, sum(cases) AS observed, sum(expected) AS expected FROM ex GROUP BY 1) SELECT county_id, CAST(observed AS BIGINT) AS observed, round(expected, 6) AS expected, round(observed / nullif(expected, 0), 6) AS sir, round(observed / nullif(expected, 0) * 3.5, 6) AS rate FROM c")
def indirect_sir(s: SparkSession, d: str) -> DataFrame:
    e = _expected(s, d)
    out = panel.standardised_ratio(e.groupBy("county_id").agg(F.sum("cases").alias("observed")), e.groupBy("county_id").agg(F.sum("expected").alias("expected")), ["county_id"])
    return rounded(out.withColumn("rate", panel.standardised_rate("sir", 0.0035)))


@query(f"WITH {b.SURVEILLANCE} SELECT geo, variable, period_start, value, round(CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END, 6) AS smoothed FROM sv WINDOW w AS (PARTITION BY geo, variable ORDER BY period_start ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def moving_average(s: SparkSession, d: str) -> DataFrame:
    sv = b.surveillance(s, d).select("geo", "variable", "period_start", "value")
    return rounded(panel.moving_average(sv, "value", "period_start", ["geo", "variable"], 3, 2))


# Costs.


@query(f"WITH {b.PRICE_YEARS}, x AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1) SELECT year, cost, round((SELECT price FROM py WHERE year = 2000) / price, 6) AS deflator, round(cost * (SELECT price FROM py WHERE year = 2000) / price, 2) AS cost_real_2000 FROM x LEFT JOIN py USING (year)")
def deflate_real(s: SparkSession, d: str) -> DataFrame:
    factors = costs.deflators(b.price_years(s, d).select("year", F.col("price").alias("index_value")), 2000)
    o = table(s, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("cost"))
    return costs.real(o, "cost", factors, "year", 2000).select("year", "cost", r6("deflator").alias("deflator"), F.round("cost_real_2000", 2).alias("cost_real_2000"))


@query(f"WITH {b.PRICE_YEARS} SELECT year, yoy, round(100 / exp(coalesce(sum(CASE WHEN yoy > 0 THEN ln(yoy / 100) END) OVER (ORDER BY year DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 6) AS index_value FROM py")
def chained_index(s: SparkSession, d: str) -> DataFrame:
    return rounded(costs.chained_index(b.price_years(s, d).select("year", "yoy")))


_COST = {"hbcs_weight": 0.65, "base_rate": 300000.0, "outpatient_points": 1200.0, "point_value": 2.5, "gp_visit_cost": 4000.0, "work_loss_probability": 0.75, "workdays_lost": 3.0, "working_days_per_year": 253.0, "daily_wage": 30000.0, "employer_contribution": 0.13, "underreporting": 5.0, "hospitalisation_rate": 0.45, "vaccine_price": 30000.0, "administration_cost": 2000.0}


@query(f"WITH {b.PANEL}, t AS (SELECT district_id, cases, CAST(cases * 5.0 AS DOUBLE) AS n, CAST(population AS DOUBLE) AS population FROM panel) SELECT district_id, round(n * 0.45 * 195000 + n * 0.55 * 7000, 4) AS medical_nominal, round((n * 0.45 * 195000 + n * 0.55 * 7000) * 1.4, 4) AS medical_real, round(n * 0.75 * 3 * 30000 * 1.13, 4) AS productivity_nominal, round(population * 32000.0, 4) AS vaccination_nominal, round(CASE WHEN cases > 0 THEN (n * 0.45 * 195000 + n * 0.55 * 7000) / cases ELSE 0 END, 4) AS cost_per_notified_case, CAST(195000 AS DOUBLE) AS cost_per_hospitalisation, CAST(2024 AS BIGINT) AS price_year, 'estimated' AS cost_evidence_class, 'prices of lines' AS deflator_source, 'cpi' AS medical_deflator_id, 'cpi' AS cost_per_notified_case_deflator_id, 'wages' AS productivity_deflator_id, round((n * 0.45 * 195000 + n * 0.55 * 7000) * 1.4 + n * 0.75 * 3 * 30000 * 1.13 * 1.75, 4) AS total_real FROM t")
def expected_cost_panel(s: SparkSession, d: str) -> DataFrame:
    out = costs.with_provenance(costs.expected_cost(b.panel(s, d), _COST, 1.4, 1.75, births="population"), 2024, {"medical": "cpi", "earnings": "wages"}, "prices of lines")
    return rounded(out.select("price_year", "cost_evidence_class", "deflator_source", "medical_deflator_id", "cost_per_notified_case_deflator_id", "productivity_deflator_id", "district_id", "medical_nominal", "medical_real", "productivity_nominal", "vaccination_nominal", "cost_per_notified_case", "cost_per_hospitalisation", "total_real"), 4)


_CASE_COST = "hospitalisation_rate * hbcs_weight * hbcs_base_rate + (1 - hospitalisation_rate) * (outpatient_points * outpatient_point_value + gp_visit_cost) + work_loss_probability * least(workdays_lost, working_days_per_year) * daily_wage * 1.09 * (1 + employer_contribution)"
_LEVELS = " UNION ALL ".join(f"SELECT '{level}' AS level, " + ", ".join(f"{v[i]!r}::DOUBLE AS {k}" for k, v in costs.ANALYSIS.items()) for i, level in enumerate(("base", "low", "high")))


@query(f"WITH {b.PANEL}, c AS (SELECT county_id, avg(late_share) AS late, avg(price) AS visit FROM panel GROUP BY 1), l AS ({_LEVELS}), x AS (SELECT county_id, level, l.* EXCLUDE (level) REPLACE (late * hospitalisation_rate AS hospitalisation_rate, visit AS gp_visit_cost) FROM l, c) SELECT county_id, level, round({_CASE_COST}, 4) AS cost FROM x")
def cost_per_case(s: SparkSession, d: str) -> DataFrame:
    """At each level of the parameters, by county: its hospitals take the part that is late, and a visit costs its mean price."""
    by = b.panel(s, d).groupBy("county_id").agg(F.avg("late_share").alias("late"), F.avg("price").alias("visit"))
    levels = [r.asDict() for r in costs.analysis_parameters(s).collect()]  # a row for each level
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in level.items()]) for level in levels]))
    rows = by.select("county_id", "late", "visit", each.alias("p")).select("county_id", "late", "visit", "p.*")
    rows = rows.withColumns({"hospitalisation_rate": F.col("late") * F.col("hospitalisation_rate"), "gp_visit_cost": F.col("visit")})
    return rows.select("county_id", "level", F.round(costs.cost_per_case(), 4).alias("cost"))


@query(f"WITH {b.PANEL}, t AS (SELECT district_id, cases, population * 100.0 / 15 AS cohort, greatest(existing_local_funding * 1000, 1.0) AS aid FROM panel), u AS (SELECT *, cases * 5.0 * 159919.75 * least(1.0, coalesce(aid / nullif(cohort * 41000.0, 0), 0)) * 0.85 AS averted FROM t) SELECT district_id, round(cohort, 4) AS cohort, round(averted, 4) AS averted, round(averted - aid, 4) AS net, round(averted / aid, 4) AS benefit_cost_ratio FROM u")
def cost_effectiveness(s: SparkSession, d: str) -> DataFrame:
    base = {k: v[0] for k, v in costs.ANALYSIS.items()}
    p = b.panel(s, d).withColumns({"children": F.col("population") * 100.0, "aid": F.col("existing_local_funding") * 1000})
    return rounded(costs.cost_effectiveness(p, 159919.75, base).select("district_id", "cohort", "averted", "net", "benefit_cost_ratio"), 4)


# Need.


@query(f"WITH {b.PANEL} SELECT district_id, round((own_revenue - avg(own_revenue) OVER ()) / stddev_pop(own_revenue) OVER (), 6) AS own_revenue FROM panel")
def std_zscore(s: SparkSession, d: str) -> DataFrame:
    return rounded(need.standardise(b.panel(s, d).select("district_id", "own_revenue"), ["own_revenue"], "zscore"))


@query(f"WITH {b.PANEL} SELECT district_id, round((own_revenue - min(own_revenue) OVER ()) / (max(own_revenue) OVER () - min(own_revenue) OVER ()), 6) AS own_revenue FROM panel")
def std_minmax(s: SparkSession, d: str) -> DataFrame:
    return rounded(need.standardise(b.panel(s, d).select("district_id", "own_revenue"), ["own_revenue"], "minmax"))


@query(f"WITH {b.PANEL} SELECT district_id, county_id, round((rank() OVER (PARTITION BY county_id ORDER BY population) + (count(*) OVER (PARTITION BY county_id, population) - 1) / 2.0) / count(*) OVER (PARTITION BY county_id), 6) AS population FROM panel")
def std_rank(s: SparkSession, d: str) -> DataFrame:
    return rounded(need.standardise(b.panel(s, d).select("district_id", "county_id", "population"), ["population"], "rank", ["county_id"]))


@query(f"WITH {b.PANEL} SELECT district_id, round((rank() OVER (ORDER BY population) + (count(*) OVER (PARTITION BY population) - 1) / 2.0) / count(*) OVER (), 6) AS population, round((rank() OVER (ORDER BY own_revenue) + (count(*) OVER (PARTITION BY own_revenue) - 1) / 2.0) / count(*) OVER (), 6) AS own_revenue FROM panel")
def std_rank_whole(s: SparkSession, d: str) -> DataFrame:
    """Percent ranks over the whole table, in slices; few populations, each of which many districts share."""
    return rounded(need.standardise(b.panel(s, d).select("district_id", "population", "own_revenue"), ["population", "own_revenue"], "rank"))


@query(f"WITH {b.NEED}, r AS (SELECT district_id, round(need_score, 1) AS need_score FROM need) SELECT district_id, need_score, CAST(floor(rank() OVER (ORDER BY need_score DESC) + (count(*) OVER (PARTITION BY need_score) - 1) / 2.0) AS BIGINT) AS need_rank FROM r")
def need_rank(s: SparkSession, d: str) -> DataFrame:
    """Places from the neediest, ties cut to whole numbers; scores of one digit, so that there are ties."""
    rows = need.need_index(b.panel(s, d), b.index()).select("district_id", F.round("need_score", 1).alias("need_score"))
    return need.need_rank(rows)


def _need_columns(df: DataFrame) -> DataFrame:
    return rounded(df.select("district_id", "need_score", *[f"need_{x}" for x in b.DIMS]))


@query(f"WITH {b.SCORES}, x AS (SELECT *, " + " + ".join(f"{w} * score_{k}" for k, w in b.DIMS.items()) + f" AS need FROM scores), y AS (SELECT district_id, {b.between('need', 'need_score')} FROM x) SELECT district_id, round(need_score, 6) AS need_score FROM y")
def need_weighted_sum(s: SparkSession, d: str) -> DataFrame:
    return rounded(need.need_index(b.panel(s, d), b.index(aggregate="weighted_sum")).select("district_id", "need_score"))


@query(f"WITH {b.NEED} SELECT district_id, round(need_score, 6) AS need_score, " + ", ".join(f"round(need_{k}, 6) AS need_{k}" for k in b.DIMS) + " FROM need")
def need_mpi_core(s: SparkSession, d: str) -> DataFrame:
    return _need_columns(need.need_index(b.panel(s, d), b.index()))


_WM = " + ".join(f"{w} * (100 + 10 * score_{k})" for k, w in b.DIMS.items())
_WV = " + ".join(f"{w} * (100 + 10 * score_{k} - m) * (100 + 10 * score_{k} - m)" for k, w in b.DIMS.items())


@query(f"WITH {b.SCORES}, a AS (SELECT *, {_WM} AS m FROM scores), c AS (SELECT *, {_WV} AS v FROM a) SELECT district_id, round(m + v / m, 6) AS need FROM c")
def need_mpi_weighted(s: SparkSession, d: str) -> DataFrame:
    i = b.index()
    return rounded(need.mpi(need.scores(b.panel(s, d), i), i, sign=1, weighted=True, again=False).select("district_id", "need"))


_P = {k: f"greatest(score_{k}, 0) + 1e-9" for k in b.DIMS}


@query(f"WITH {b.SCORES}, t AS (SELECT *, count(*) OVER () AS n, " + ", ".join(f"({p}) / sum({p}) OVER () AS p_{k}" for k, p in _P.items()) + " FROM scores), e AS (SELECT " + ", ".join(f"1 + sum(p_{k} * ln(p_{k})) / ln(max(n)) AS d_{k}" for k in _P) + " FROM t) SELECT district_id, round((" + " + ".join(f"score_{k} * d_{k}" for k in _P) + ") / (" + " + ".join(f"d_{k}" for k in _P) + "), 5) AS need FROM scores, e")
def need_entropy(s: SparkSession, d: str) -> DataFrame:
    i = b.index()
    return rounded(need.entropy(need.scores(b.panel(s, d), i), i).select("district_id", "need"), 5)


@query()
def need_pca(s: SparkSession, d: str) -> DataFrame:
    return _need_columns(need.need_index(b.panel(s, d), b.index(aggregate="pca")))


def _specs(s: SparkSession, d: str) -> DataFrame:
    rows = need.scores(b.panel(s, d), b.index())
    sums = {"all": list(b.DIMS)} | {f"no_{k}": [x for x in b.DIMS if x != k] for k in b.DIMS}
    return rows.select("district_id", *[F.round(sum(F.col(f"score_{x}") * b.DIMS[x] for x in dims), 6).alias(name) for name, dims in sums.items()])


_SPECS = {"all": list(b.DIMS)} | {f"no_{k}": [x for x in b.DIMS if x != k] for k in b.DIMS}


@query(f"WITH {b.SCORES}, sp AS (SELECT district_id, " + ", ".join("round(" + " + ".join(f"score_{x} * {b.DIMS[x]}" for x in v) + f", 6) AS s_{k}" for k, v in _SPECS.items()) + " FROM scores), rk AS (SELECT district_id, " + ", ".join(f"row_number() OVER (ORDER BY s_{k} DESC, district_id) AS r_{k}" for k in _SPECS) + " FROM sp) SELECT district_id, CAST(" + " + ".join(f"(r_{k} <= 50)::INT" for k in _SPECS) + " AS BIGINT) AS n_specs FROM rk")
def spec_robustness(s: SparkSession, d: str) -> DataFrame:
    return need.robustness(_specs(s, d), 50)


_DIMS = list(b.DIMS)


def _penalised(parts: dict[str, str], out: str) -> str:
    """The penalised mean of z-scores (by dimension), as SQL."""
    whole = sum(b.DIMS[d] for d in parts)
    mean = "(" + " + ".join(f"{b.DIMS[d] / whole!r} * (100 + 10 * {z})" for d, z in parts.items()) + ")"
    variance = "(" + " + ".join(f"{b.DIMS[d] / whole!r} * (100 + 10 * {z} - {mean}) * (100 + 10 * {z} - {mean})" for d, z in parts.items()) + ")"
    return f"{mean} - {variance} / {mean} AS {out}"


_VARIANTS = ["mpi", "wsum", "rank_ws", *[f"drop_{d}" for d in _DIMS], "swap"]
_VARIANT_SQL = (
    b.SCORES.replace("stddev_pop", "stddev_samp")
    + ", vz AS (SELECT district_id, existing_local_funding, "
    + ", ".join(f"score_{d}, (score_{d} - avg(score_{d}) OVER ()) / stddev_samp(score_{d}) OVER () AS z_{d}, (score_{d} - min(score_{d}) OVER ()) / (max(score_{d}) OVER () - min(score_{d}) OVER ()) AS m_{d}, rank() OVER (ORDER BY score_{d}) + (count(*) OVER (PARTITION BY score_{d}) - 1) / 2.0 AS r_{d}" for d in _DIMS)
    + ", -(existing_local_funding - avg(existing_local_funding) OVER ()) / stddev_samp(existing_local_funding) OVER () AS z_official FROM scores), vv AS (SELECT district_id, existing_local_funding, "
    + ", ".join([_penalised({d: f"score_{d}" for d in _DIMS}, "mpi"), " + ".join(f"{b.DIMS[d]} * m_{d}" for d in _DIMS) + " AS wsum", " + ".join(f"{b.DIMS[d]} * r_{d}" for d in _DIMS) + " AS rank_ws", *[_penalised({x: f"z_{x}" for x in _DIMS if x != d}, f"drop_{d}") for d in _DIMS], _penalised({d: "z_official" if d == "socioeconomic" else f"z_{d}" for d in _DIMS}, "swap")])
    + " FROM vz), variants AS (SELECT district_id, existing_local_funding, "
    + ", ".join(f"round((v.{x} - min(v.{x}) OVER ()) / (max(v.{x}) OVER () - min(v.{x}) OVER ()), 6) AS {x}" for x in _VARIANTS)
    + " FROM vv v)"
)


def _variants(s: SparkSession, d: str) -> DataFrame:
    i = b.index(ddof=1)
    made = need.variants(need.scores(b.panel(s, d), i), i, official="existing_local_funding")
    return made.select("district_id", "existing_local_funding", *[r6(x).alias(x) for x in _VARIANTS])


@query(f"WITH {_VARIANT_SQL} SELECT * EXCLUDE (existing_local_funding) FROM variants")
def need_variants(s: SparkSession, d: str) -> DataFrame:
    """Three methods, each dimension left out, and the official indicator in place of the socioeconomic scores."""
    return _variants(s, d).drop("existing_local_funding")


@query(f"WITH {_VARIANT_SQL}, rk AS (SELECT district_id, " + ", ".join(f"row_number() OVER (ORDER BY {x} DESC, district_id) AS k_{x}" for x in _VARIANTS) + ", greatest(1, CAST(round(count(*) OVER () * 0.1) AS BIGINT)) AS top FROM variants) SELECT district_id, CAST(" + " + ".join(f"(k_{x} <= top)::INT" for x in _VARIANTS) + f" AS BIGINT) AS n_specs, {len(_VARIANTS)} AS of_specs FROM rk")
def spec_robustness_all(s: SparkSession, d: str) -> DataFrame:
    """In how many of all variants a district is among the neediest tenth."""
    rows = cut(_variants(s, d).drop("existing_local_funding"))
    return need.robustness(rows, max(1, round(rows.count() * 0.1))).withColumn("of_specs", F.lit(len(_VARIANTS)).cast("long"))


def _mean_rank_sql(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"


@query(f"WITH {_VARIANT_SQL}, ra AS (SELECT mpi AS x, -existing_local_funding AS y, {_mean_rank_sql('mpi')} AS a, {_mean_rank_sql('-existing_local_funding')} AS c FROM variants), co AS (SELECT count(*) AS n, corr(x, y) AS pearson, corr(a, c) AS spearman FROM ra), tt AS (SELECT *, pearson * sqrt(n - 2) / sqrt(1 - pearson * pearson) AS t1, spearman * sqrt(n - 2) / sqrt(1 - spearman * spearman) AS t2 FROM co) SELECT n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round({tails.sql_t_two_sided('t1', '(n - 2)')}, 6) AS pearson_p, round({tails.sql_t_two_sided('t2', '(n - 2)')}, 6) AS spearman_p FROM tt")
def external_validation(s: SparkSession, d: str) -> DataFrame:
    """The index against an indicator that is not part of it, with p-values."""
    rows = _variants(s, d).select("mpi", (-F.col("existing_local_funding")).alias("deprivation"))
    return rounded(equity.association(rows, "mpi", "deprivation"))


@query(f"WITH {b.NEED}, t AS (SELECT district_id, need_score, " + ", ".join(f"(need_{k} - min(need_{k}) OVER ()) * {w} AS part_{k}" for k, w in b.DIMS.items()) + " FROM need) SELECT district_id, round(need_score, 6) AS need_score, " + ", ".join(f"round(part_{k}, 6) AS part_{k}" for k in b.DIMS) + " FROM t ORDER BY t.need_score DESC, district_id LIMIT 30")
def need_composition(s: SparkSession, d: str) -> DataFrame:
    i = b.index()
    return rounded(need.composition(need.need_index(b.panel(s, d), i), i, 30))


# Allocation.


def allocated(s: SparkSession, d: str) -> DataFrame:
    """All scenarios over the panel's districts, with what equity looks at."""
    rows = need.need_index(b.panel(s, d), b.index())
    return cut(allocation.allocate(rows, allocation.scenario_rows(s), b.BUDGET).withColumn("scenario_id", F.col("scenario_id").cast("long")))


@query(f"WITH {b.ALLOCATED} SELECT scenario_id, district_id, round(aid_amount, 2) AS aid_amount, round(delta_vs_baseline, 2) AS delta_vs_baseline FROM alloc")
def alloc_all_delta(s: SparkSession, d: str) -> DataFrame:
    return rounded(allocated(s, d).select("scenario_id", "district_id", "aid_amount", "delta_vs_baseline"), 2)


@query(f"WITH {b.ALLOCATED} SELECT county_id, " + ", ".join(f"round(sum(aid_amount) FILTER (scenario_id = {i}), 2) AS s{i}" for i in range(8)) + " FROM alloc GROUP BY 1")
def pivot_scenarios(s: SparkSession, d: str) -> DataFrame:
    wide = allocated(s, d).groupBy("county_id").pivot("scenario_id", list(range(8))).agg(F.sum("aid_amount"))
    return rounded(wide.withColumnsRenamed({str(i): f"s{i}" for i in range(8)}), 2)


@query(f"WITH {b.ALLOCATED} SELECT county_id, round(sum(CASE scenario_id WHEN 2 THEN aid_amount ELSE -aid_amount END), 2) AS shift FROM alloc WHERE scenario_id IN (1, 2) GROUP BY 1")
def redistribution_by_county(s: SparkSession, d: str) -> DataFrame:
    return rounded(allocation.redistribution(allocated(s, d)), 2)


@query(f"WITH {b.NEED}, k AS (SELECT *, row_number() OVER (ORDER BY need_score DESC, district_id) <= greatest(1, CAST(floor(count(*) OVER () * 0.2) AS BIGINT)) AS top FROM need) SELECT count(*) FILTER (top) AS n_top, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (top AND eligible) AS n_both, round(count(*) FILTER (top AND eligible) / count(*) FILTER (top OR eligible), 6) AS jaccard, round(count(*) FILTER (top AND eligible) / count(*) FILTER (top), 6) AS share_covered FROM k")
def policy_overlap(s: SparkSession, d: str) -> DataFrame:
    return rounded(allocation.policy_overlap(need.need_index(b.panel(s, d), b.index())))


@query(f"WITH {b.NEED}, r AS (SELECT district_id, population * (need_score - min(need_score) OVER () + 0.01) AS raw FROM need) SELECT district_id, round({b.BUDGET} * raw / sum(raw) OVER (), 2) AS aid_amount FROM r")
def alloc_shares(s: SparkSession, d: str) -> DataFrame:
    rows = need.need_index(b.panel(s, d), b.index())
    return rounded(allocation.shares_by_score(rows, b.BUDGET, "population", "need_score").select("district_id", "aid_amount"), 2)


def _wide_sql(eligible: str) -> str:
    share = lambda raw, out: f"{b.BUDGET} * ({raw}) / sum({raw}) OVER () AS {out}"
    return (
        f"WITH {b.NEED}, el AS (SELECT need.*, {eligible} AS may, existing_local_funding * greatest(cases, 1) AS l, need_socioeconomic - min(need_socioeconomic) OVER () + 0.01 AS so, need_healthcare - min(need_healthcare) OVER () + 0.01 AS he FROM need), wd AS (SELECT district_id, count(*) FILTER (may) OVER () AS eligible_units, l AS s0, greatest(expected_cost - l, 0) AS s6, "
        + ", ".join([share("population", "s1"), share("cases", "s2"), share("population * so", "s3"), share("population * he", "s4"), share("expected_cost * (1 + 0.5 * need_score)", "s5"), share("CASE WHEN may THEN population ELSE 0 END", "s7")])
        + " FROM el) SELECT district_id, eligible_units, " + ", ".join(f"round(s{i}, 2) AS s{i}" for i in range(8)) + " FROM wd"
    )


def _wide(s: SparkSession, d: str, eligible: str | None) -> DataFrame:
    rows = need.need_index(b.panel(s, d), b.index())
    out = allocation.wide(rows, b.BUDGET, 0.5, socio="need_socioeconomic", care="need_healthcare", eligible=eligible)
    return rounded(out.select("district_id", "eligible_units", *[f"s{i}" for i in range(8)]), 2)


@query(_wide_sql("round(need_socioeconomic, 9) >= round((SELECT quantile_cont(need_socioeconomic, 2 / 3.0) FROM need), 9)"))
def alloc_wide(s: SparkSession, d: str) -> DataFrame:
    """Eight allocations a district; the last goes to the most deprived third."""
    return _wide(s, d, None)


@query(_wide_sql("eligible"))
def alloc_wide_statutory(s: SparkSession, d: str) -> DataFrame:
    """The same where it is known which districts are eligible."""
    return _wide(s, d, "eligible")


_HOST = r"://(?:www\.|m\.)?([^./?#]+)"


@query(f"WITH su AS (SELECT url AS municipality, CAST(page_id % 1000 AS DOUBLE) AS amount, CAST(length(html) % 5 AS DOUBLE) AS cases FROM pages), br AS (SELECT key, min(page_id) AS district_id FROM (SELECT regexp_extract(url, '{_HOST}', 1) AS key, page_id FROM pages) WHERE key <> '' GROUP BY 1) SELECT district_id, sum(amount * greatest(cases, 1)) AS envelope FROM su JOIN br ON contains(lower(municipality), lower(key)) GROUP BY 1")
def municipal_support(s: SparkSession, d: str) -> DataFrame:
    """Addresses as municipalities, found by the names of all hosts, wherever they stand in an address."""
    p = table(s, d, "pages")
    supports = p.select(F.col("url").alias("municipality"), (F.col("page_id") % 1000).cast("double").alias("amount"), (F.length("html") % 5).cast("double").alias("cases"))
    bridge = p.select(F.regexp_extract("url", _HOST, 1).alias("key"), "page_id").where("key <> ''").groupBy("key").agg(F.min("page_id").alias("district_id"))
    return allocation.municipal_funding(supports, bridge)


# Equity.

_POS = f"WITH {b.ALLOCATED}, g AS (SELECT scenario_id, district_id, region_id, aid_amount AS x, need_score AS r, row_number() OVER (PARTITION BY scenario_id ORDER BY aid_amount, district_id) AS i, row_number() OVER (PARTITION BY scenario_id ORDER BY need_score, district_id) AS k, count(*) OVER (PARTITION BY scenario_id) AS n FROM alloc)"
_GINI = "2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1.0) / max(n)"
_GINI_NEED = "2 * sum(k * r) / (max(n) * sum(r)) - (max(n) + 1.0) / max(n)"
_CI = "2 * sum(x * ((k - 0.5) / n - 0.5)) / sum(x)"
#: Of the ordering value of a group: slices that are numbered side by side.
SLICES = 16


@query(f"{_POS} SELECT scenario_id, round({_GINI}, 6) AS gini FROM g GROUP BY 1")
def gini_by_scenario(s: SparkSession, d: str) -> DataFrame:
    return rounded(equity.gini(allocated(s, d), "aid_amount", ["scenario_id"], slices=SLICES))


@query(f"{_POS} SELECT scenario_id, round({_CI}, 6) AS ci FROM g GROUP BY 1")
def concentration_index(s: SparkSession, d: str) -> DataFrame:
    return rounded(equity.concentration(allocated(s, d), "aid_amount", "need_score", ["scenario_id"], slices=SLICES))


@query(f"{_POS} SELECT scenario_id, round({_CI}, 6) AS ci, round({_GINI_NEED}, 6) AS gini, round({_CI} - ({_GINI_NEED}), 6) AS kakwani FROM g GROUP BY 1")
def kakwani(s: SparkSession, d: str) -> DataFrame:
    return rounded(equity.kakwani(allocated(s, d), "aid_amount", "need_score", ["scenario_id"], slices=SLICES))


_THEIL = "t AS (SELECT scenario_id, region_id, count(*) AS n, sum(aid_amount) AS s, sum(CASE WHEN aid_amount > 0 THEN aid_amount * ln(aid_amount) ELSE 0 END) AS l FROM alloc GROUP BY 1, 2), th AS (SELECT scenario_id, sum(l) / sum(s) - ln(sum(s) / sum(n)) AS theil, sum(CASE WHEN s > 0 THEN l - s * ln(s / n) ELSE 0 END) / sum(s) AS within FROM t GROUP BY 1)"


@query(f"WITH {b.ALLOCATED}, {_THEIL} SELECT scenario_id, round(theil, 6) AS theil, round(theil - within, 6) AS \"between\", round(within, 6) AS within FROM th")
def theil(s: SparkSession, d: str) -> DataFrame:
    return rounded(equity.theil(allocated(s, d), "aid_amount", "region_id", ["scenario_id"]))


@query(f"{_POS}, c AS (SELECT scenario_id, i AS pos, i / n AS x, sum(x) OVER (PARTITION BY scenario_id ORDER BY i ROWS UNBOUNDED PRECEDING) / sum(x) OVER (PARTITION BY scenario_id) AS y FROM g) SELECT scenario_id, pos, round(x, 6) AS x, round(y, 6) AS y FROM c UNION ALL SELECT DISTINCT scenario_id, 0, 0.0, 0.0 FROM g")
def lorenz(s: SparkSession, d: str) -> DataFrame:
    return rounded(equity.lorenz(allocated(s, d), "aid_amount", ["scenario_id"], slices=SLICES))


@query(f"WITH {b.ALLOCATED}, rk AS (SELECT scenario_id, district_id, rank() OVER (PARTITION BY scenario_id ORDER BY round(aid_amount, 2)) + (count(*) OVER (PARTITION BY scenario_id, round(aid_amount, 2)) - 1) / 2.0 AS r FROM alloc) SELECT a.scenario_id AS scenario_a, b.scenario_id AS scenario_b, round(corr(a.r, b.r), 6) AS rho FROM rk a JOIN rk b USING (district_id) GROUP BY ALL")
def spearman_matrix(s: SparkSession, d: str) -> DataFrame:
    return rounded(equity.scenario_spearman(allocated(s, d).withColumn("aid_amount", F.round("aid_amount", 2))))


@query(f"WITH {b.ALLOCATED}, t AS (SELECT * FROM (SELECT scenario_id, district_id, row_number() OVER (PARTITION BY scenario_id ORDER BY round(aid_amount, 2) DESC, district_id) AS k FROM alloc) WHERE k <= 20), s AS (SELECT DISTINCT scenario_id FROM t), m AS (SELECT a.scenario_id AS sa, b.scenario_id AS sb, count(*) AS m FROM t a JOIN t b USING (district_id) GROUP BY ALL) SELECT a.scenario_id AS scenario_a, b.scenario_id AS scenario_b, round(coalesce(m, 0) / (40 - coalesce(m, 0)), 6) AS jaccard FROM s a CROSS JOIN s b LEFT JOIN m ON sa = a.scenario_id AND sb = b.scenario_id")
def jaccard_topk(s: SparkSession, d: str) -> DataFrame:
    return rounded(equity.jaccard_top(allocated(s, d).withColumn("aid_amount", F.round("aid_amount", 2)), 20))


_OVER = "q AS (SELECT scenario_id, quantile_cont(round(aid_amount, 2), 0.9) AS qa, quantile_cont(round(need_score, 6), 0.9) AS qn FROM alloc GROUP BY 1), ov AS (SELECT scenario_id, count(*) FILTER (round(need_score, 6) >= qn AND round(aid_amount, 2) >= qa) / count(*) FILTER (round(need_score, 6) >= qn) AS overlap FROM alloc JOIN q USING (scenario_id) GROUP BY 1)"


def _coarse(s: SparkSession, d: str) -> DataFrame:
    return allocated(s, d).withColumns({"aid_amount": F.round("aid_amount", 2), "need_score": r6("need_score")})


@query(f"WITH {b.ALLOCATED}, {_OVER} SELECT scenario_id, round(overlap, 6) AS overlap FROM ov")
def top_decile_overlap(s: SparkSession, d: str) -> DataFrame:
    return rounded(equity.top_overlap(_coarse(s, d), "aid_amount", "need_score", ["scenario_id"]))


@query(f"{_POS} SELECT scenario_id, round(sum(CASE WHEN greatest(ceil((k - 1) * 5.0 / (n - 1)), 1) - 1 = 4 THEN x ELSE 0 END) / sum(x), 6) AS worst_fifth_share FROM g GROUP BY 1")
def worst_quintile_share(s: SparkSession, d: str) -> DataFrame:
    return rounded(equity.worst_fifth_share(allocated(s, d), "aid_amount", "need_score", ["scenario_id"], slices=SLICES))


_MEAN_RANKS = "mr AS (SELECT scenario_id, rank() OVER (PARTITION BY scenario_id ORDER BY round(aid_amount, 2)) + (count(*) OVER (PARTITION BY scenario_id, round(aid_amount, 2)) - 1) / 2.0 AS a, rank() OVER (PARTITION BY scenario_id ORDER BY round(need_score, 6)) + (count(*) OVER (PARTITION BY scenario_id, round(need_score, 6)) - 1) / 2.0 AS b FROM alloc), sp AS (SELECT scenario_id, corr(a, b) AS rho FROM mr GROUP BY 1)"


@query(f"{_POS}, {_THEIL}, {_OVER}, {_MEAN_RANKS}, e AS (SELECT scenario_id, {_CI} AS ci, {_GINI_NEED} AS gini_need, {_GINI} AS gini, sum(CASE WHEN greatest(ceil((k - 1) * 5.0 / (n - 1)), 1) - 1 = 4 THEN x ELSE 0 END) / sum(x) AS w FROM g GROUP BY 1) SELECT scenario_id, round(ci, 4) AS ci, round(gini_need, 4) AS gini_need, round(ci - gini_need, 4) AS kakwani, round(gini, 4) AS gini, round(theil, 4) AS theil, round(theil - within, 4) AS \"between\", round(within, 4) AS within, round(overlap, 4) AS overlap, round(w, 4) AS worst_fifth_share, round(rho, 4) AS rho FROM e JOIN th USING (scenario_id) JOIN ov USING (scenario_id) JOIN sp USING (scenario_id)")
def equity_summary(s: SparkSession, d: str) -> DataFrame:
    out = equity.summary(allocated(s, d), "aid_amount", "need_score", "region_id", ["scenario_id"], digits=(2, 6))
    return rounded(out.select("scenario_id", "ci", "gini_need", "kakwani", "gini", "theil", "between", "within", "overlap", "worst_fifth_share", "rho"), 4)


_YEAR_GINI = f"WITH {b.COUNTY_YEARS}, g AS (SELECT year, cases, row_number() OVER (PARTITION BY year ORDER BY cases, county_id) AS i, count(*) OVER (PARTITION BY year) AS n FROM cy), yg AS (SELECT year, 2.0 * sum(i * cases) / (max(n) * sum(cases)) - (max(n) + 1.0) / max(n) AS gini FROM g GROUP BY 1)"


@query(_YEAR_GINI + ", rr AS (SELECT corr(gini, year) AS r, count(*) AS n FROM yg), tt AS (SELECT n, r * sqrt(n - 2) / sqrt(1 - r * r) AS t FROM rr) SELECT round(regr_slope(gini, year), 8) AS slope, round(regr_intercept(gini, year), 4) AS intercept, round(corr(gini, year), 6) AS r, count(*) AS n, round(" + tails.sql_t_two_sided("max(t)", "(max(n) - 2)") + ", 6) AS p FROM yg, tt")
def gini_trend_ols(s: SparkSession, d: str) -> DataFrame:
    g = equity.gini(b.county_years(s, d), "cases", ["year"], "county_id")
    return equity.trend(g, "year", "gini").select(F.round("slope", 8).alias("slope"), F.round("intercept", 4).alias("intercept"), r6("r").alias("r"), F.col("n").cast("long").alias("n"), r6("p").alias("p"))


@query(f"{_YEAR_GINI} SELECT year, CAST(sum(cases) AS DOUBLE) AS total, round(avg(cases), 6) AS mean, round(stddev_samp(cases), 6) AS sd, CAST(min(cases) AS DOUBLE) AS least, CAST(max(cases) AS DOUBLE) AS most, round(max(cases) / min(cases), 6) AS spread, round(stddev_samp(cases) / avg(cases), 6) AS cv, round(max(gini), 6) AS gini FROM cy JOIN yg USING (year) GROUP BY 1")
def county_inequality(s: SparkSession, d: str) -> DataFrame:
    return rounded(equity.describe(b.county_years(s, d), "cases", ["year"], "county_id"))


# Geography.


@query(f"WITH {b.VINTAGES}, o AS (SELECT vintage, row_number() OVER (ORDER BY vintage) AS i, lead(vintage) OVER (ORDER BY vintage) AS nxt FROM (SELECT DISTINCT vintage FROM vint)), v AS (SELECT vint.*, i, nxt FROM vint JOIN o USING (vintage)), m AS (SELECT *, CASE WHEN lag(i) OVER w = i - 1 AND lag(district_id) OVER w = district_id THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY settlement_id ORDER BY i)), r AS (SELECT *, sum(new) OVER (PARTITION BY settlement_id ORDER BY i) AS run FROM m) SELECT settlement_id, min(district_id) AS district_id, make_date(min(vintage), 1, 1) AS valid_from, make_date(arg_max(coalesce(nxt, -1), i), 1, 1) AS valid_to FROM (SELECT settlement_id, district_id, vintage, i, nxt, run FROM r) GROUP BY settlement_id, run HAVING max(nxt) IS NOT NULL AND arg_max(coalesce(nxt, -1), i) > 0 UNION ALL SELECT settlement_id, min(district_id), make_date(min(vintage), 1, 1), NULL FROM r GROUP BY settlement_id, run HAVING arg_max(coalesce(nxt, -1), i) < 0")
def scd2_intervals(s: SparkSession, d: str) -> DataFrame:
    return geography.intervals(b.vintages(s, d), "settlement_id", ["district_id"])


@query(f"WITH {b.VINTAGES}, o AS (SELECT vintage, lead(vintage) OVER (ORDER BY vintage) AS nxt FROM (SELECT DISTINCT vintage FROM vint)) SELECT 'settlement_reassigned' AS change, CAST(a.settlement_id AS VARCHAR) AS unit, a.district_id AS before, c.district_id AS after, c.vintage FROM vint a JOIN o USING (vintage) JOIN vint c ON c.settlement_id = a.settlement_id AND c.vintage = o.nxt WHERE a.district_id <> c.district_id")
def boundary_changes(s: SparkSession, d: str) -> DataFrame:
    return geography.boundary_changes(b.vintages(s, d))


@query(f"WITH {b.VINTAGES}, ev AS (SELECT settlement_id, v.vintage, coalesce(vint.district_id, 'NA') AS p FROM (SELECT DISTINCT settlement_id FROM vint) CROSS JOIN (SELECT DISTINCT vintage FROM vint) v LEFT JOIN vint USING (settlement_id, vintage)), sg AS (SELECT settlement_id, string_agg(p, '|' ORDER BY vintage) AS sig FROM ev GROUP BY 1), nm AS (SELECT sig, row_number() OVER (ORDER BY min(settlement_id)) AS k FROM sg GROUP BY 1) SELECT settlement_id, 'KTE' || lpad(CAST(k AS VARCHAR), CAST(greatest(4, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS part FROM sg JOIN nm USING (sig)")
def kte_partition(s: SparkSession, d: str) -> DataFrame:
    return geography.common_parts(b.vintages(s, d))


def _bridges(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Customers as settlements: source is the nation, target the segment; some have no target."""
    p = b.panel(s, d)
    c = table(s, d, "customer")
    source = p.select(F.col("district_id").alias("settlement_id"), F.col("county_id").alias("source"))
    target = c.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("settlement_id"), F.col("c_mktsegment").alias("target"))
    people = p.select(F.col("district_id").alias("settlement_id"), F.when(F.col("county_id") == 3, 0).otherwise(F.col("population")).alias("population"))
    values = p.groupBy(F.col("county_id").alias("source")).agg(F.sum("cases").cast("double").alias("cases"), F.sum("population").cast("double").alias("people"))
    return values, source, target, people


_BRIDGE = f"WITH {b.PANEL}, val AS (SELECT county_id AS source, CAST(sum(cases) AS DOUBLE) AS cases, CAST(sum(population) AS DOUBLE) AS people FROM panel GROUP BY 1), br AS (SELECT district_id, county_id AS source, CASE WHEN county_id = 3 THEN 0 ELSE population END AS p, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS target FROM panel JOIN customer ON c_custkey = district_id), sh AS (SELECT *, CASE WHEN sum(p) OVER (PARTITION BY source) <= 0 THEN 1.0 / count(*) OVER (PARTITION BY source) ELSE p / sum(p) OVER (PARTITION BY source) END AS share FROM br)"


@query(_BRIDGE + " SELECT target, round(sum(cases * share), 6) AS cases FROM sh JOIN val USING (source) WHERE target IS NOT NULL GROUP BY 1")
def apportion_extensive(s: SparkSession, d: str) -> DataFrame:
    return rounded(geography.apportion(*_bridges(s, d), ["cases"]))


@query(_BRIDGE + " SELECT target, round(sum(cases * share) / nullif(sum(people * share), 0), 6) AS rate FROM sh JOIN val USING (source) WHERE target IS NOT NULL GROUP BY 1")
def apportion_intensive(s: SparkSession, d: str) -> DataFrame:
    return rounded(geography.apportion_rate(*_bridges(s, d), "cases", "people"))


@query(_BRIDGE + ", pp AS (SELECT source, sum(p) AS pop FROM br GROUP BY 1), v2 AS (SELECT source, cases, cases / 100 * pop AS num, pop FROM val JOIN pp USING (source)) SELECT target, round(sum(cases * share), 6) AS cases, round(sum(num * share) / nullif(sum(pop * share), 0), 6) AS rate FROM sh JOIN v2 USING (source) WHERE target IS NOT NULL GROUP BY 1")
def harmonised_frame(s: SparkSession, d: str) -> DataFrame:
    values, source, target, people = _bridges(s, d)
    return rounded(geography.harmonise(values.withColumn("rate", F.col("cases") / 100), source, target, people, {"cases": True, "rate": False}))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(translate(lower(url), 'áéíóöőúüűñçèêàâ', 'aeiooouuuncecaa'), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM pages")
def name_normalise(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", text.plain_name("url").alias("name"))


@query(f"WITH {b.VINTAGES}, c AS (SELECT settlement_id, district_id, CAST(c_nationkey AS VARCHAR) AS county_id FROM vint LEFT JOIN customer ON settlement_id = c_custkey WHERE vintage = 1999) SELECT 'duplicate_settlement' AS rule, CAST(settlement_id AS VARCHAR) AS unit FROM c GROUP BY settlement_id HAVING count(*) > 1 UNION ALL SELECT 'district_in_several_counties', district_id FROM c GROUP BY district_id HAVING count(DISTINCT county_id) > 1 UNION ALL SELECT 'blank_district', CAST(settlement_id AS VARCHAR) FROM c WHERE district_id IS NULL OR lower(trim(district_id)) IN ('', 'nan', 'none', 'null') UNION ALL SELECT 'county_count', CAST(count(DISTINCT county_id) AS VARCHAR) FROM c HAVING count(DISTINCT county_id) <> 20")
def consistency(s: SparkSession, d: str) -> DataFrame:
    """The rules over a registry of one vintage, all its settlements."""
    v = b.vintages(s, d).where("vintage = 1999").drop("vintage")
    c = table(s, d, "customer").select(F.col("c_custkey").alias("settlement_id"), F.col("c_nationkey").cast("string").alias("county_id"))
    return geography.consistency(v.join(c, "settlement_id", "left"), 20)


@query(f"WITH {b.VINTAGES}, c AS (SELECT settlement_id, vintage, district_id, CAST(c_nationkey AS VARCHAR) AS county_id FROM vint LEFT JOIN customer ON settlement_id = c_custkey) SELECT 'duplicate_settlement' AS rule, CAST(settlement_id AS VARCHAR) AS unit FROM c GROUP BY vintage, settlement_id HAVING count(*) > 1 UNION ALL SELECT 'district_in_several_counties', district_id FROM c GROUP BY vintage, district_id HAVING count(DISTINCT county_id) > 1 UNION ALL SELECT 'blank_district', CAST(settlement_id AS VARCHAR) FROM c WHERE district_id IS NULL OR lower(trim(district_id)) IN ('', 'nan', 'none', 'null') UNION ALL SELECT 'county_count', CAST(count(DISTINCT county_id) AS VARCHAR) FROM c GROUP BY vintage HAVING count(DISTINCT county_id) <> 20")
def consistency_of_vintages(s: SparkSession, d: str) -> DataFrame:
    """The rules over every settlement of every vintage."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("settlement_id"), F.col("c_nationkey").cast("string").alias("county_id"))
    return geography.consistency(b.vintages(s, d).join(c, "settlement_id", "left"), 20)


# Validation.


def _one(df: DataFrame) -> DataFrame:
    return df.select("rule", "severity", "n_rows")


@query(f"WITH {b.SURVEILLANCE}, k AS (SELECT *, count(*) OVER (PARTITION BY geo_name, variable, iso_year) AS n FROM sv) SELECT 'duplicates' AS rule, 'error' AS severity, count(*) AS n_rows FROM k WHERE n > 1 HAVING count(*) > 0")
def v_duplicates(s: SparkSession, d: str) -> DataFrame:
    rows = validation.duplicate_rows(b.surveillance(s, d), ["geo_name", "variable", "iso_year"])
    return _one(validation.finding(rows, "duplicates", "error", "repeated rows"))


@query("WITH w AS (SELECT DISTINCT o_custkey, isoyear(o_orderdate) AS y, week(o_orderdate) AS k, CAST(date_trunc('week', o_orderdate) AS DATE) AS m FROM orders), p AS (SELECT *, lead(y) OVER x AS ny, lead(k) OVER x AS nk, lead(m) OVER x AS nm FROM w WINDOW x AS (PARTITION BY o_custkey ORDER BY m)) SELECT o_custkey, CAST(y AS BIGINT) AS from_year, CAST(k AS BIGINT) AS from_week, CAST(ny AS BIGINT) AS to_year, CAST(nk AS BIGINT) AS to_week, CAST((nm - m) / 7 - 1 AS BIGINT) AS n_missing FROM p WHERE nm - m > 7")
def v_gaps(s: SparkSession, d: str) -> DataFrame:
    day = _days("o_orderdate")
    o = table(s, d, "orders").select("o_custkey", dates.iso_year(day).alias("iso_year"), F.weekofyear(day).alias("iso_week"))
    return rounded(validation.week_gaps(o, ["o_custkey"]))


BOUNDS = [("click", 10.0, 300.0), ("error", 0.0, 100.0), ("view", None, 400.0)]


@query("SELECT event_id, event_type FROM events LEFT JOIN (VALUES ('click', 10.0, 300.0), ('error', 0.0, 100.0), ('view', NULL, 400.0)) t(v, lo, hi) ON v = event_type WHERE value < coalesce(lo, 0) OR value > coalesce(hi, 'Infinity'::DOUBLE)")
def v_ranges(s: SparkSession, d: str) -> DataFrame:
    bounds = s.createDataFrame(BOUNDS, "variable string, low double, high double")
    return validation.out_of_range(table(s, d, "events"), bounds, "event_type").select("event_id", "event_type")


@query(f"WITH {b.SURVEILLANCE}, x AS (SELECT variable, period_start, coalesce(sum(value) FILTER (geo_level = 'county'), 0) AS counties, min(value) FILTER (geo_level = 'country') AS country, count(*) FILTER (geo_level = 'county') AS n FROM sv GROUP BY 1, 2) SELECT variable, period_start, counties, country FROM x WHERE country IS NOT NULL AND n > 0 AND abs(counties - country) > 0.5")
def v_sum_agreement(s: SparkSession, d: str) -> DataFrame:
    return validation.sum_disagreement(b.surveillance(s, d))


@query("WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS med FROM orders GROUP BY 1), a AS (SELECT o_orderpriority, median(abs(o_totalprice - med)) AS mad FROM orders JOIN m USING (o_orderpriority) GROUP BY 1) SELECT o_orderkey, round(abs(0.6745 * (o_totalprice - med) / mad), 6) AS robust_z, CASE WHEN abs(0.6745 * (o_totalprice - med) / mad) > 1.2 THEN 'outlier' END AS quality_flag FROM orders JOIN m USING (o_orderpriority) JOIN a USING (o_orderpriority)")
def v_outliers_mad(s: SparkSession, d: str) -> DataFrame:
    return rounded(validation.outliers(table(s, d, "orders"), "o_totalprice", ["o_orderpriority"], 1.2).select("o_orderkey", "robust_z", "quality_flag"))


@query(f"WITH {b.SURVEILLANCE} SELECT geo_name, variable, period_start, evidence_class FROM sv WHERE evidence_class NOT IN ('observed', 'estimated', 'assumed') OR (geo_level = 'district' AND evidence_class = 'observed' AND source_id <> 'nngyk_foia')")
def v_evidence(s: SparkSession, d: str) -> DataFrame:
    return validation.wrong_evidence(b.surveillance(s, d)).select("geo_name", "variable", "period_start", "evidence_class")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate < DATE '1997-01-01'")
def v_break(s: SparkSession, d: str) -> DataFrame:
    return validation.before_break(table(s, d, "orders").withColumn("variable", F.col("o_orderpriority")), ["1-URGENT", "2-HIGH"], "o_orderdate", "1997-01-01").select("o_orderkey")


@query(f"WITH {b.PANEL}, x AS (SELECT county_id, sum(population) AS summed, CASE WHEN county_id % 4 = 0 THEN 100.0 ELSE CAST(sum(population) AS DOUBLE) END AS declared FROM panel GROUP BY 1) SELECT county_id, CAST(summed AS DOUBLE) AS summed, declared FROM x WHERE abs(summed - declared) > 0.005 * declared")
def v_population(s: SparkSession, d: str) -> DataFrame:
    p = b.panel(s, d)
    whole = p.groupBy("county_id").agg(F.sum("population").cast("double").alias("w")).withColumn("declared", F.when(F.col("county_id") % 4 == 0, 100.0).otherwise(F.col("w")))
    return validation.county_totals_off(p.join(F.broadcast(whole), "county_id"), "population", "declared", ["county_id"]).select("county_id", F.col("summed").cast("double").alias("summed"), "declared")


@query(f"WITH {_SHARES[5:]} SELECT year, count(*) AS n, round(avg(abs(e - p.cases)), 6) AS mae, round(avg(CASE WHEN p.cases BETWEEN greatest(0, e * 0.5) AND e * 1.5 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM est JOIN panel p USING (district_id) GROUP BY year")
def modelled_against_observed(s: SparkSession, d: str) -> DataFrame:
    p = b.panel(s, d)
    est = panel.population_share(b.county_years(s, d), p.select("district_id", "county_id", "population"))
    m = est.select("district_id", "year", F.col("cases_modelled").alias("estimate"), F.col("cases_modelled_lo").alias("lo"), F.col("cases_modelled_hi").alias("hi"))
    return rounded(validation.modelled_against_observed(m, p.select("district_id", F.col("cases").alias("value")), ["district_id"], by=["year"]))


_RULES = [
    rules.RowRule("few", "value >= 60", message="fewer than 60 events"),
    rules.RowRule("many", "value <= 90", "warning", "more than 90 events"),
    rules.RowRule("first_weeks", "iso_week > 2", "flag", "of the first two weeks"),
    rules.RowRule("never", "iso_week <= 53"),
    rules.RowRule("fails", "CAST(geo_name AS INT) > 0"),
]
_BROKEN = [("few", "error", "fewer than 60 events", "value < 60"), ("many", "warning", "more than 90 events", "value > 90"), ("first_weeks", "flag", "of the first two weeks", "iso_week <= 2")]


@query(f"WITH {b.SURVEILLANCE}, j AS (SELECT *, to_json({{'geo_name': geo_name, 'variable': variable, 'iso_week': iso_week, 'value': value}})::VARCHAR AS j FROM sv) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, '{v}' AS severity, '{m}' AS message, count(*) AS n_rows, array_to_string(list_slice(list(j ORDER BY j), 1, 5), '|') AS sample FROM j WHERE {c} HAVING count(*) > 0" for n, v, m, c in _BROKEN) + " UNION ALL SELECT 'fails', 'warning', 'the rule failed: CAST_INVALID_INPUT', 0, ''")
def rules_one_scan(s: SparkSession, d: str) -> DataFrame:
    """Five rules over the weekly reports in one scan, one of which fails while it runs."""
    rows = b.surveillance(s, d).select("geo_name", "variable", "iso_week", "value")
    return rules.evaluate(rows, _RULES).withColumn("sample", F.array_join("sample", "|"))


_SCHEMA_SQL = f"""WITH {b.SURVEILLANCE}, {b.PANEL} SELECT 'county_weekly_epi' AS "schema", 'evidence_class:among' AS rule, count(*) AS n_rows FROM sv WHERE evidence_class NOT IN ('observed', 'estimated', 'assumed') HAVING count(*) > 0
UNION ALL SELECT 'cost_parameters_resolved', 'evidence_class:among', count(*) FROM part WHERE p_type NOT IN ('observed', 'estimated', 'assumed') HAVING count(*) > 0
UNION ALL SELECT 'cost_parameters_resolved', 'price_year:type', count(*) FROM part WHERE p_retailprice <> floor(p_retailprice) HAVING count(*) > 0
UNION ALL SELECT 'geo_districts', 'district_id:pattern', count(*) FROM part WHERE NOT regexp_full_match(p_name, '\\S+') HAVING count(*) > 0
UNION ALL SELECT 'district_panel', 'year:column', 0
UNION ALL SELECT 'district_panel', 'rotavirus_cases_district_modelled:known', 0 WHERE false
UNION ALL SELECT 'district_panel', 'rotavirus_cases_district_modelled:least', count(*) FROM panel WHERE own_revenue < 0 HAVING count(*) > 0"""


@query(_SCHEMA_SQL)
def schema_findings(s: SparkSession, d: str) -> DataFrame:
    """The four schemas over what stands for their tables: a scan each."""
    part = table(s, d, "part")
    none = F.lit(None).cast("string")
    tables = {
        "county_weekly_epi": b.surveillance(s, d),
        "cost_parameters_resolved": part.select(F.col("p_brand").alias("parameter_id"), F.col("p_retailprice").alias("value"), F.col("p_retailprice").alias("price_year"), F.col("p_type").alias("evidence_class"), none.alias("confidence"), none.alias("source_url")),
        "geo_districts": part.select(F.col("p_name").alias("district_id"), F.col("p_brand").alias("district_name"), F.col("p_size").cast("string").alias("county_id"), none.alias("valid_from"), none.alias("valid_to")),
        "district_panel": b.panel(s, d).select(F.col("district_id").cast("string").alias("district_id"), F.lit("estimated").alias("evidence_class"), F.col("own_revenue").alias("rotavirus_cases_district_modelled")),
    }
    out = [rules.check_schema(rows, rules.SCHEMAS[name]).select(F.lit(name).alias("schema"), "rule", "n_rows") for name, rows in tables.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents), h AS (SELECT doc_id, p, CASE WHEN length(trim(line)) BETWEEN 1 AND 40 THEN trim(line) END AS heading FROM l), f AS (SELECT doc_id, p, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h) SELECT doc_id, section, count(*) AS n_lines, CAST(min(p) - 1 AS BIGINT) AS first_line FROM f GROUP BY 1, 2")
def line_sections(s: SparkSession, d: str) -> DataFrame:
    """The short line under which each line of each document stands; a line above all of them has none."""
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    heading = F.trim("line")
    marked = lines.select("doc_id", "p", F.when(F.length(heading).between(1, 40), heading).alias("section"))
    filled = order.filled_forward(marked, "section", ["doc_id"], [F.col("p")])
    return filled.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.min("p").cast("long").alias("first_line"))


# Sensitivity.

#: Draws and replicates of the surveyed runs.
DRAWS = 2000


_TORNADO = ("people", "cases", "mean_cost")


@query(f"WITH {b.PANEL}, base AS (SELECT CAST(sum(population) AS DOUBLE) AS people, CAST(sum(cases) AS DOUBLE) AS cases, round(avg(expected_cost), 2) AS mean_cost FROM panel), p AS (SELECT parameter, delta FROM (VALUES {', '.join(f"('{x}')" for x in _TORNADO)}) a(parameter), (VALUES (0.1::DOUBLE), (0.5::DOUBLE)) b(delta)), s AS (SELECT parameter, delta, sign, " + ", ".join(f"{x} * (CASE WHEN parameter = '{x}' THEN 1 + sign * delta ELSE 1 END) AS {x}" for x in _TORNADO) + " FROM base, p, (VALUES (-1.0::DOUBLE), (1.0::DOUBLE)) c(sign)), v AS (SELECT parameter, delta, sign, cases * mean_cost / people AS v FROM s) SELECT parameter, delta, round(max(v) FILTER (sign < 0), 4) AS low, round(max(v) FILTER (sign > 0), 4) AS high, round(abs(max(v) FILTER (sign > 0) - max(v) FILTER (sign < 0)), 4) AS swing FROM v GROUP BY 1, 2")
def tornado(s: SparkSession, d: str) -> DataFrame:
    """Cost of cases a head, with each of the panel's sums alone made less and more."""
    base = b.panel(s, d).agg(F.sum("population").cast("double").alias("people"), F.sum("cases").cast("double").alias("cases"), F.round(F.avg("expected_cost"), 2).alias("mean_cost")).first().asDict()
    return rounded(sensitivity.tornado(s, base, nulls.ratio(F.col("cases") * F.col("mean_cost"), "people"), (0.1, 0.5)), 4)


def _tornado_sql() -> str:
    one = lambda values: "(SELECT sum(cases) FROM panel) * underreporting * (" + _CASE_COST + ") FROM (SELECT " + ", ".join(f"{v!r}::DOUBLE AS {k}" for k, v in values.items()) + ")"
    base = {k: v[0] for k, v in costs.ANALYSIS.items()}
    rows = " UNION ALL ".join(f"SELECT '{k}' AS parameter, (SELECT {one(base | {k: v[1]})}) AS low, (SELECT {one(base | {k: v[2]})}) AS high" for k, v in costs.ANALYSIS.items())
    return f"WITH {b.PANEL}, base AS (SELECT {one(base)} AS t(base)), r AS ({rows}) SELECT parameter, round(base, 2) AS base, round(low, 2) AS low, round(high, 2) AS high, round(abs(high - low), 2) AS spread FROM r, (SELECT {one(base)} ) AS b2(base)"


@query(_tornado_sql())
def tornado_costs(s: SparkSession, d: str) -> DataFrame:
    """The societal cost of all cases, with each parameter alone at its low and its high level."""
    cases = float(b.panel(s, d).agg(F.sum("cases")).first()[0] or 0)
    return rounded(sensitivity.bounds_tornado(s, costs.ANALYSIS, F.lit(cases) * F.col("underreporting") * costs.cost_per_case()), 2)


@query(f"WITH {b.NEED}, cell AS (SELECT eta, rate FROM (VALUES (0.0), (0.5), (1.0), (2.0)) a(eta), (VALUES (0.0), (0.1), (0.5)) c(rate)), x AS (SELECT eta, rate, district_id, need_score, population, population * (1 + eta * need_score) + rate * cases AS raw FROM need, cell), y AS (SELECT *, {b.BUDGET} * raw / sum(raw) OVER p AS aid, {b.BUDGET} * population / sum(population) OVER p AS flat, row_number() OVER (PARTITION BY eta, rate ORDER BY need_score, district_id) AS k, count(*) OVER p AS n FROM x WINDOW p AS (PARTITION BY eta, rate)) SELECT CAST(eta AS DOUBLE) AS eta, CAST(rate AS DOUBLE) AS rate, round(sum(abs(aid - flat)) / 2 / {b.BUDGET}, 6) AS reshuffled, round(2 * sum(aid * ((k - 0.5) / n - 0.5)) / sum(aid), 6) AS ci FROM y GROUP BY 1, 2")
def two_way_grid(s: SparkSession, d: str) -> DataFrame:
    rows = need.need_index(b.panel(s, d), b.index())
    return rounded(sensitivity.grid(rows, [0.0, 0.5, 1.0, 2.0], [0.0, 0.1, 0.5], b.BUDGET))


SEED = 20260101


def _gammas(out: str, parts: list[tuple[str, int, str, str]], keys: str = "unit, draw") -> str:
    """Tables up to `out` (unit, draw, part, value). parts: source with unit and draw, stream, unit's number, shape."""
    rows = " UNION ALL ".join(f"SELECT {keys}, {i} AS part, {shape} AS shape, state FROM {counter.sql_with(f'(SELECT * FROM {source})', counter.sql_at('state', SEED, stream, number, 'draw'))}" for i, (source, stream, number, shape) in enumerate(parts))
    return f"{out}_src AS MATERIALIZED ({rows}), {counter.sql_gammas(out, f'{out}_src', ['unit', 'draw', 'part'])}"


_DRAWN = f"range({DRAWS}) AS r(draw)"
_PSA = f"""WITH {b.NEED}, pre AS (SELECT district_id AS unit, expected_cost AS cost, coalesce(discount, 0) AS x, max(coalesce(discount, 0)) OVER () AS most, y_socioeconomic AS y1, y_healthcare AS y2, y_fiscal_capacity AS y3, existing_local_funding AS local, {b.between('own_revenue', 'fiscal')} FROM need),
u AS (SELECT *, least(greatest(x / most, 1e-6), 1 - 1e-6) AS f FROM pre), ud AS MATERIALIZED (SELECT unit, draw, f FROM u, {_DRAWN}),
{_gammas('g', [('ud', probabilistic.COST, 'unit', '1 / 0.09'), ('ud', probabilistic.RISK_A, 'unit', '8 * f'), ('ud', probabilistic.RISK_B, 'unit', '2 * (1 - f)')])},
d AS MATERIALIZED (SELECT unit, draw, max(value) FILTER (part = 0) AS gc, max(value) FILTER (part = 1) AS ga, max(value) FILTER (part = 2) AS gb FROM g GROUP BY 1, 2),
i AS MATERIALIZED (SELECT draw, u.*, CASE WHEN cost > 0 THEN gc * cost * 0.09 ELSE 0 END AS c, CASE WHEN ga + gb > 0 THEN ga / (ga + gb) ELSE 0 END * most AS inc FROM d JOIN u USING (unit)),
im AS (SELECT draw, avg(inc) AS m, stddev_pop(inc) AS s FROM i GROUP BY 1),
n1 AS (SELECT i.*, 100 + 10 * (inc - m) / s AS y0 FROM i JOIN im USING (draw)), n2 AS (SELECT *, (y0 + y1 + y2 + y3) / 4 AS m FROM n1),
n3 AS MATERIALIZED (SELECT *, m - ((y0 - m) * (y0 - m) + (y1 - m) * (y1 - m) + (y2 - m) * (y2 - m) + (y3 - m) * (y3 - m)) / 4 / m AS nd FROM n2),
nm AS (SELECT draw, min(nd) AS lo, max(nd) AS hi FROM n3 GROUP BY 1),
ra AS MATERIALIZED (SELECT unit, draw, greatest(c * (1 + 0.5 * (nd - lo) / (hi - lo)) * (1 - 0.3 * fiscal) - local, 0) AS raw FROM n3 JOIN nm USING (draw)),
rs AS (SELECT draw, sum(raw) AS s FROM ra GROUP BY 1), aid AS (SELECT unit, {b.BUDGET} * raw / s AS aid FROM ra JOIN rs USING (draw))
SELECT unit AS district_id, round(avg(aid), 2) AS mean, round(quantile_cont(aid, 0.025), 2) AS low, round(quantile_cont(aid, 0.975), 2) AS high FROM aid GROUP BY 1"""


@query(_PSA)
def psa(s: SparkSession, d: str) -> DataFrame:
    """Aid of the full scenario under drawn costs and incidence: 2,000 draws over the whole panel, the index made anew in each."""
    return rounded(probabilistic.psa(b.panel(s, d), DRAWS, SEED, b.BUDGET, b.index(), allocation.SCENARIOS[5], "discount"), 2)


#: Parameters that are parts of one.
RATIOS = ["hospitalisation_rate", "work_loss_probability", "vaccine_efficacy", "employer_contribution"]


def _parameter_sql() -> str:
    """par(draw, names): every parameter of every draw."""
    parts, made = [], []
    for i, (name, (base, low, high)) in enumerate(costs.ANALYSIS.items()):
        if base <= 0:
            made.append(f"{base!r}::DOUBLE AS {name}")
            continue
        first = lambda part, shape, i=i: parts.append((f"(SELECT {2 * i + part} AS unit, draw FROM {_DRAWN})", probabilistic.PARAMETER, "unit", f"{shape!r}::DOUBLE"))
        pick = lambda part, i=i: f"max(value) FILTER (unit = {2 * i + part})"
        if name in RATIOS:
            first(0, max(base * 40, 1e-3))
            first(1, max((1 - base) * 40, 1e-3))
            made.append(f"least(greatest({pick(0)} / ({pick(0)} + {pick(1)}), {low * 0.5!r}::DOUBLE), {min(high * 1.2, 0.999)!r}::DOUBLE) AS {name}")
        else:
            k = 1 / max((high - low) / (3.92 * base), 0.05) ** 2
            first(0, k)
            made.append(f"{pick(0)} * {base / k!r}::DOUBLE AS {name}")
    return f"{_gammas('pg', parts)}, par AS (SELECT draw, {', '.join(made)} FROM pg GROUP BY draw)"


def _weights_sql() -> str:
    """wt(draw, w0, w1, ...): the dimensions' weights of every draw."""
    whole = sum(b.DIMS.values())
    parts = [(f"(SELECT {i} AS unit, draw FROM {_DRAWN})", probabilistic.WEIGHT, "unit", f"{w / whole * 20.0!r}::DOUBLE") for i, w in enumerate(b.DIMS.values())]
    return f"{_gammas('wg', parts)}, wt AS (SELECT draw, {', '.join(f'max(value) FILTER (unit = {i}) / sum(value) AS w{i}' for i in range(len(parts)))} FROM wg GROUP BY draw)"


_DOT = " + ".join(f"z{i} * w{i}" for i in range(len(b.DIMS)))
_PSA_ANALYSIS = f"""WITH {b.NEED}, {_parameter_sql()}, {_weights_sql()},
bu AS (SELECT draw, exp(0.2 * z) AS burden FROM {counter.sql_with(f'(SELECT draw FROM {_DRAWN})', [*counter.sql_at('state', SEED, probabilistic.BURDEN, '0', 'draw'), *counter.sql_normal('z', 'state')])}),
et AS (SELECT draw, 0.2 + 0.8 * e AS eta FROM {counter.sql_with(f'(SELECT draw FROM {_DRAWN})', [*counter.sql_at('state', SEED, probabilistic.ETA, '0', 'draw'), *counter.sql_uniform('e', 'state')])}),
pl AS (SELECT district_id AS unit, CAST(cases AS DOUBLE) AS cases, row_number() OVER (ORDER BY need_score, district_id) AS k, count(*) OVER () AS n, {', '.join(f'coalesce((need_{x} - avg(need_{x}) OVER ()) / nullif(stddev_samp(need_{x}) OVER (), 0), 0) AS z{i}' for i, x in enumerate(b.DIMS))} FROM need),
no AS MATERIALIZED (SELECT unit, draw, x FROM {counter.sql_with(f'(SELECT unit, draw FROM pl, {_DRAWN})', [*counter.sql_at('state', SEED, probabilistic.NOISE, 'unit', 'draw'), *counter.sql_normal('x', 'state')])}),
sc AS MATERIALIZED (SELECT unit, draw, cases, k, n, {_DOT} AS score FROM pl, wt), ends AS (SELECT draw, min(score) AS lo, max(score) AS hi FROM sc GROUP BY 1),
ra AS (SELECT draw, k, n, greatest(cases * exp(0.35 * x) * (1 + eta * (score - lo) / (hi - lo)), 0) AS raw FROM sc JOIN ends USING (draw) JOIN et USING (draw) JOIN no USING (unit, draw)),
su AS (SELECT draw, sum(raw) FILTER (greatest(ceil((k - 1) * 5.0 / (n - 1)), 1) - 1 = 4) / sum(raw) AS w, 2 * sum(raw * ((k - 0.5) / n - 0.5)) / sum(raw) AS ci FROM ra GROUP BY 1),
co AS (SELECT draw, (SELECT sum(cases) FROM panel) * burden * underreporting * ({_CASE_COST}) / 1e9 AS cost FROM par JOIN bu USING (draw))
SELECT draw AS draw_id, round(cost, 6) AS cost_bn, round(w, 6) AS worst_q_share, round(ci, 6) AS ci_need FROM su JOIN co USING (draw)"""


@query(_PSA_ANALYSIS)
def psa_analysis(s: SparkSession, d: str) -> DataFrame:
    """Of each draw: the societal cost, and how a share by noisy burden and drawn need falls on the neediest."""
    rows = cut(need.need_index(b.panel(s, d), b.index()))
    drawn = probabilistic.sampled(s, DRAWS, SEED, costs.ANALYSIS, RATIOS).join(probabilistic.burden_multiplier(s, DRAWS, SEED), "draw_id")
    whole = float(rows.agg(F.sum("cases")).first()[0] or 0)
    cost = drawn.select("draw_id", (F.lit(whole) * F.col("burden") * F.col("underreporting") * costs.cost_per_case() / 1e9).alias("cost_bn"))
    share = probabilistic.progressivity(rows.withColumnsRenamed({f"need_{x}": f"score_{x}" for x in b.DIMS}), DRAWS, SEED, b.DIMS, "cases")
    return rounded(cost.join(share.drop("eta"), "draw_id"))


_SPREAD = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(quantile_cont({c}, 0.025), 6) AS {c}_low, round(quantile_cont({c}, 0.975), 6) AS {c}_high" for c in ("cost_bn", "worst_q_share", "ci_need"))


@query(f"SELECT count(*) AS n_draws, {_SPREAD} FROM ({_PSA_ANALYSIS})")
def psa_analysis_summary(s: SparkSession, d: str) -> DataFrame:
    """Mean and 95 % interval over the draws."""
    draws = psa_analysis(s, d)
    return draws.agg(F.count("*").alias("n_draws"), *[r6(f(c)).alias(f"{c}_{n}") for c in ("cost_bn", "worst_q_share", "ci_need") for n, f in (("mean", F.avg), ("low", lambda x: F.percentile(x, 0.025)), ("high", lambda x: F.percentile(x, 0.975)))])


@query(f"WITH {b.SCORES}, {_weights_sql()}, pl AS (SELECT district_id, count(*) OVER () AS n, {', '.join(f'score_{x} AS z{i}' for i, x in enumerate(b.DIMS))} FROM scores), rk AS (SELECT district_id, n, row_number() OVER (PARTITION BY draw ORDER BY {_DOT} DESC, district_id) AS k FROM pl, wt) SELECT district_id, count(*) FILTER (k <= greatest(1, CAST(floor(n * 0.1) AS BIGINT))) / {float(DRAWS)} AS frequency, count(*) FILTER (k <= greatest(1, CAST(floor(n * 0.1) AS BIGINT))) / {float(DRAWS)} >= 0.8 AS robust FROM rk GROUP BY 1")
def dirichlet_topdecile(s: SparkSession, d: str) -> DataFrame:
    return probabilistic.top_frequency(need.scores(b.panel(s, d), b.index()), DRAWS, SEED, b.DIMS)


def _replicates_sql(value: str, by: str) -> str:
    counted = counter.sql_with(f"(SELECT region_id, district_id AS unit, {value} AS y, {by} AS o, draw FROM {'need' if by == 'need_score' else 'panel'}, {_DRAWN})", [*counter.sql_at("state", SEED, probabilistic.REPLICATE, "unit", "draw"), *counter.sql_uniform("u", "state")])
    return f"kk AS MATERIALIZED (SELECT region_id, draw, unit, y, o, {counter.sql_poisson_1('u')} AS k FROM {counted}), cc AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY region_id, draw ORDER BY o, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM kk), st AS (SELECT region_id, draw, CAST(sum(k * y * (2 * before + k)) AS DOUBLE) / nullif(CAST(sum(k) AS DOUBLE) * sum(k * y), 0) - 1 AS x FROM cc GROUP BY 1, 2) SELECT region_id, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, count(x) AS n_used FROM st WHERE x IS NOT NULL GROUP BY 1"


def _bootstrap(rows: DataFrame, value: str, by: str) -> DataFrame:
    sums = probabilistic.replicated(rows, value, by, ["region_id"], DRAWS, SEED)
    return rounded(probabilistic.interval(sums, probabilistic.concentration(), ["region_id"]))


@query(f"WITH {b.PANEL}, {_replicates_sql('cases', 'cases')}")
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    """The Gini coefficient of cases in each region, over 2,000 replicates."""
    return _bootstrap(b.panel(s, d), "cases", "cases")


@query(f"WITH {b.NEED}, {_replicates_sql('existing_local_funding', 'need_score')}")
def bootstrap_concentration(s: SparkSession, d: str) -> DataFrame:
    """The concentration of local funding along need in each region."""
    return _bootstrap(need.need_index(b.panel(s, d), b.index()), "existing_local_funding", "need_score")


# Texts and pages.


@query("WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"''#][^\"'']*)[\"'']', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"''#][^\"'']*)[\"'']', 1), 1) - 1 AS p FROM pages), a AS (SELECT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || trim(href) ELSE '?' END AS link, p FROM h WHERE NOT regexp_matches(lower(href), '^\\s*(mailto|javascript|tel):')) SELECT page_id, link, CAST(min(p) AS BIGINT) AS place FROM a GROUP BY 1, 2")
def extract_links(s: SparkSession, d: str) -> DataFrame:
    return rounded(html.links(table(s, d, "pages")))


def _brand_bodies(s: SparkSession, d: str, line: Column) -> DataFrame:
    """A text for each brand: a line for each of its parts, in their order."""
    part = table(s, d, "part").select(F.col("p_brand").alias("id"), F.struct("p_partkey", line.alias("line")).alias("x"))
    return part.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))


@query("WITH a AS (SELECT p_brand AS id, CASE WHEN p_partkey % 7 = 0 THEN p_size ELSE CAST(p_size AS BIGINT) * 1000 END AS n FROM part WHERE p_partkey % 5 > 0) SELECT id, array_to_string(list_sort(list(DISTINCT n) FILTER (n BETWEEN 1000 AND 200000)), ' ') AS candidates, CAST(max(n) FILTER (n BETWEEN 1000 AND 200000) AS BIGINT) AS most FROM (SELECT p_brand AS id FROM part GROUP BY 1) LEFT JOIN a USING (id) GROUP BY 1")
def amount_extraction(s: SparkSession, d: str) -> DataFrame:
    """Amounts in texts of parts, written in four ways; some are too small, some lines have none."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    amount = F.when(k % 5 == 0, "ingyen").when(k % 7 == 0, F.concat(size, F.lit(" Ft"))).when(k % 3 == 0, F.concat(size, F.lit(" 000 Ft"))).when(k % 3 == 1, F.concat(size, F.lit(".000 forint"))).otherwise(F.concat(size, F.lit("000 HUF")))
    bodies = _brand_bodies(s, d, F.concat("p_name", F.lit(": "), amount, F.lit(";")))
    return collectors.amounts(bodies, "id", "body").select("id", F.coalesce(F.nullif(F.array_join("candidates", " "), F.lit("")), F.lit(None).cast("string")).alias("candidates"), "most")


@query("SELECT p_brand AS id, p_name || ' járás' AS district_name, CAST(p_retailprice AS DOUBLE) AS value, count(*) AS n FROM part WHERE p_partkey % 5 > 0 GROUP BY ALL")
def decree_lines(s: SparkSession, d: str) -> DataFrame:
    """District lines with numbers of decimal comma in texts of parts; other lines have no district."""
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("összesen "), F.col("p_size").cast("string"))).otherwise(F.concat("p_name", F.lit(" járás: "), F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")), F.lit(" pont")))
    return collectors.decree_lines(_brand_bodies(s, d, line), "id", "body").groupBy("id", "district_name", "value").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN '-' WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN (c_custkey // 1000) || ' ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') WHEN 3 THEN ' ' || c_nationkey || ' ' WHEN 4 THEN c_mktsegment WHEN 5 THEN '●' WHEN 6 THEN '–' END AS cell, CAST(CASE c_custkey % 8 WHEN 0 THEN 0 WHEN 1 THEN c_custkey WHEN 2 THEN c_custkey WHEN 3 THEN c_nationkey WHEN 6 THEN 0 END AS BIGINT) AS value FROM customer")
def parse_cell(s: SparkSession, d: str) -> DataFrame:
    """Cells of all customers: dashes, numbers with and without blanks, texts, marks, none."""
    k = F.col("c_custkey")
    made = [F.lit("-"), k.cast("string"), F.concat(F.floor(k / 1000).cast("string"), F.lit(" "), F.lpad((k % 1000).cast("string"), 3, "0")), F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" ")), F.col("c_mktsegment"), F.lit("●"), F.lit("–"), F.lit(None).cast("string")]
    cells = table(s, d, "customer").select("c_custkey", F.get(F.array(*made), (k % 8).cast("int")).alias("cell"))
    return cells.select("c_custkey", "cell", text.cell_number("cell").alias("value"))


@query("WITH l AS (SELECT p_brand AS sheet, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS line, lower(p_name || ' ' || p_type) AS t FROM part) SELECT sheet, min(line) AS line FROM l WHERE line < 15 AND contains(t, 'red') AND contains(t, 'o') AND contains(t, 'e') GROUP BY 1")
def header_detect(s: SparkSession, d: str) -> DataFrame:
    """Parts of a brand as lines of a sheet: the first that holds all tokens, if it is among the first fifteen."""
    lines = order.numbered(table(s, d, "part"), ["p_brand"], [F.col("p_partkey")], "line").select(F.col("p_brand").alias("sheet"), (F.col("line") - 1).alias("line"), "p_name", "p_type")
    return tabular.header_row(lines, ["RED", "o", "E"])


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS node, CAST(o_orderkey % (SELECT count(*) FROM customer) AS BIGINT) AS target FROM orders), w AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS level UNION SELECT e.target, level + 1 FROM w JOIN e USING (node) WHERE level < 3) SELECT node, CAST(min(level) AS BIGINT) AS level FROM w GROUP BY 1")
def url_walk(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "customer").agg(F.count("*").alias("n"))
    edges = table(s, d, "orders").crossJoin(F.broadcast(n)).select(F.col("o_custkey").alias("node"), (F.col("o_orderkey") % F.col("n")).alias("target"))
    return rounded(html.walk(edges, s.range(1, 2).select(F.col("id").alias("node")), 3))


def entry(s: SparkSession, d: str) -> DataFrame:
    """The flagship: panel, need, all scenarios, and how fair each is."""
    return equity_summary(s, d)

