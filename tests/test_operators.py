"""Small cases: nulls, ties, zero sums, empty tables, and the identities that results must keep."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from almoner.functions import dates, nulls, ranks, text
from almoner.functions.tails import t_two_sided
from almoner.operators import allocation, costs, equity, geography, need, panel, validation
from almoner.sources import collectors, html, tabular


def one(df):
    return df.first()[0]


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, "5", "12345"), (float("nan"), "x", "7"), (None, " 2.5 ", None)], "a double, b string, c string")
    r = df.select(nulls.known("a").alias("a"), nulls.number("b").alias("b"), nulls.zero_filled("c", 4).alias("c"), nulls.clip("a", 2).alias("d")).collect()
    assert [x["a"] for x in r] == [1.0, None, None] and [x["b"] for x in r] == [5.0, None, 2.5]
    assert [x["c"] for x in r] == ["12345", "0007", None] and r[2]["d"] is None
    assert one(df.where("false").select(nulls.total("a"))) == 0.0
    assert one(spark.createDataFrame([(None, 3.0)], "x double, y double").select(nulls.row_mean(["x", "y"]))) == 3.0


def test_weeks(spark):
    r = spark.range(1).select(dates.iso_monday(F.lit(2024), F.lit(7)).alias("a"), dates.iso_monday(F.lit(2023), F.lit(53)).alias("b"), dates.weeks_in_year(F.lit(2020)).alias("c"), dates.period_of(F.lit("nyilv_2021_március.xls")).alias("d"), dates.period_of(F.lit("x2019.11.xls")).alias("e")).first()
    assert r.a == dt.date(2024, 2, 12) and r.b is None and r.c == 53 and r.d == dt.date(2021, 3, 1) and r.e == dt.date(2019, 11, 1)


def test_names(spark):
    r = spark.range(1).select(text.normalised_name(F.lit("Forró község")).alias("a"), text.settlement_name(F.lit("Budapest XII. kerület")).alias("b"), text.settlement_name(F.lit("Budapest 3. ker.")).alias("c"), text.county_name(F.lit("Vas vármegye")).alias("d"), text.localised(F.lit(1234.56)).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("forró", "budapest 12", "budapest 03", "vas", "1\\,234{,}56")


def test_t_tail():
    assert abs(t_two_sided(2.228, 10) - 0.05) < 1e-4 and abs(t_two_sided(0.5, 3) - 0.6514) < 1e-4 and t_two_sided(None, 3) is None


@pytest.mark.parametrize("slices", [1, 5])
def test_positions(spark, slices):
    rows = [(g, i, float((i * 7) % 5)) for g in range(2) for i in range(40)]
    got = ranks.positions(spark.createDataFrame(rows, "g int, id int, x double"), ["g"], "x", "id", ["x"], slices).collect()
    for g in range(2):
        want = sorted((x, i) for h, i, x in rows if h == g)
        mine = sorted((r["pos"], r["x"], r["id"], r["cum_x"]) for r in got if r["g"] == g)
        assert [(x, i) for _, x, i, _ in mine] == want and [p for p, *_ in mine] == list(range(1, 41))
        assert mine[-1][3] == sum(x for x, _ in want)


def test_shares_and_conservation(spark):
    cases = spark.createDataFrame([("c", 2020, 100.0), ("z", 2020, 9.0)], "county_id string, year int, cases double")
    units = spark.createDataFrame([("a", "c", 30.0), ("b", "c", 70.0), ("x", "z", 0.0), ("y", "z", None)], "district_id string, county_id string, population double")
    est = panel.population_share(cases, units)
    got = {r["district_id"]: r["cases_modelled"] for r in est.collect()}
    assert got == {"a": 30.0, "b": 70.0, "x": 4.5, "y": 4.5}
    assert all(r["conserved"] for r in panel.conservation(est, cases).collect())
    with pytest.raises(NotImplementedError):
        panel.bayesian_share(cases, units)


def test_inequality_edges(spark):
    df = spark.createDataFrame([("e", i, 5.0) for i in range(30)] + [("o", i, 100.0 if i == 3 else 0.0) for i in range(4)] + [("z", i, 0.0) for i in range(3)], "g string, district_id int, x double")
    g = {r["g"]: r["gini"] for r in equity.gini(df, "x", ["g"]).collect()}
    assert abs(g["e"]) < 1e-12 and g["o"] == 0.75 and g["z"] == 0.0
    t = {r["g"]: r for r in equity.theil(df.withColumn("by", F.col("district_id") % 2), "x", "by", ["g"]).collect()}
    assert abs(t["e"]["theil"]) < 1e-12 and abs(t["o"]["between"] + t["o"]["within"] - t["o"]["theil"]) < 1e-9
    last = [(r["x"], r["y"]) for r in equity.lorenz(df, "x", ["g"]).where("g = 'z'").orderBy("pos").collect()]
    assert [round(a - b, 12) for a, b in last] == [0.0] * 4
    ci = {r["g"]: r["ci"] for r in equity.concentration(df.withColumn("r", F.col("district_id").cast("double")), "x", "r", ["g"]).collect()}
    assert abs(ci["e"]) < 1e-12 and ci["o"] > 0
    assert equity.gini(df.where("false"), "x", ["g"]).count() == 0


def _panel(spark):
    rows = [(i, i % 3, 100.0 * (i + 1), 1e6 * (i % 7 + 1), 50.0 * (i % 4), 10.0 * i, i % 2 == 0, float(i % 5), float(i) / 10) for i in range(20)]
    df = spark.createDataFrame(rows, "district_id int, county_id int, population double, expected_cost double, existing_local_funding double, own_revenue double, eligible boolean, cases double, u double")
    i = need.Index([need.Dimension("socioeconomic", 1, ["u"]), need.Dimension("healthcare", 1, ["cases"])])
    return need.need_index(df, i)


def test_allocation(spark):
    rows, budget = _panel(spark), 1e9
    out = allocation.allocate(rows, allocation.scenario_rows(spark), budget).toPandas()
    sums = out.groupby("scenario_id").aid_amount.sum()
    assert all(abs(sums[k] / budget - 1) < 1e-9 for k in (1, 2, 3, 4, 5, 7)) and abs(sums[6] / budget - 1) > 1e-3
    zero = out[out.scenario_id == 0].set_index("district_id").aid_amount
    assert zero.to_dict() == {r["district_id"]: r["existing_local_funding"] for r in rows.collect()}
    assert (out[(out.scenario_id == 7) & (out.district_id % 2 == 1)].aid_amount == 0).all()
    assert (out[out.scenario_id == 0].delta_vs_baseline == 0).all()
    # with eta 0 a need scenario is the per-capita one
    flat = allocation.allocate(rows, allocation.scenario_rows(spark, [allocation.Scenario(1, "a", base="population"), allocation.Scenario(3, "b", base="population", need="socioeconomic", eta=0.0)]), budget).toPandas().pivot(index="district_id", columns="scenario_id", values="aid_amount")
    assert (abs(flat[1] - flat[3]) < 1e-6).all()
    with pytest.raises(allocation.AllocationError):
        allocation.allocate(rows.withColumn("population", F.lit(0.0)), allocation.scenario_rows(spark), budget)


@pytest.mark.parametrize("how", ["weighted_sum", "mpi", "entropy", "pca"])
@pytest.mark.parametrize("kind", ["zscore", "minmax", "rank"])
def test_index_is_between_zero_and_one(spark, how, kind):
    df = _panel(spark).drop("need_score", "need_socioeconomic", "need_healthcare").withColumn("u", F.when(F.col("district_id") != 4, F.col("u")))
    i = need.Index([need.Dimension("a", 1, ["u", "gone"]), need.Dimension("b", 2, ["cases_inverse"], inverse=True), need.Dimension("none", 1, ["absent"])], standardise=kind, aggregate=how)
    got = need.need_index(df, i).agg(F.min("need_score"), F.max("need_score"), F.count("need_score")).first()
    assert tuple(got) == (0.0, 1.0, 20)
    with pytest.raises(ValueError):
        need.Index([need.Dimension("a", -1, [])])


def _vintages(spark):
    base = {10001: "0101", 10002: "0101", 20001: "0511", 20002: "0511", 20003: "0511", 20004: "0512", 20005: "0512"}
    rows = [(u, y, "0512" if u == 20003 and y > 2013 else p) for y in (2013, 2014, 2015) for u, p in base.items()]
    return spark.createDataFrame(rows, "settlement_id int, vintage int, district_id string")


def test_vintages(spark):
    v = _vintages(spark)
    assert [tuple(r) for r in geography.boundary_changes(v).collect()] == [("settlement_reassigned", "20003", "0511", "0512", 2014)]
    onga = geography.intervals(v, "settlement_id", ["district_id"]).where("settlement_id = 20003").orderBy("valid_from").collect()
    assert [(r["valid_from"].year, r["valid_to"] and r["valid_to"].year) for r in onga] == [(2013, 2014), (2014, None)]
    parts = {r["settlement_id"]: r["part"] for r in geography.common_parts(v).collect()}
    assert [parts[u] for u in sorted(parts)] == ["KTE0001", "KTE0001", "KTE0002", "KTE0002", "KTE0003", "KTE0004", "KTE0004"]
    gone = v.where("NOT (settlement_id = 10001 AND vintage = 2014)")
    assert geography.intervals(gone, "settlement_id", ["district_id"]).where("settlement_id = 10001").count() == 2
    assert geography.boundary_changes(v.where("NOT (district_id = '0101' AND vintage = 2015)")).where("change = 'district_dissolved'").count() == 1


def test_apportionment(spark):
    source = spark.createDataFrame([("a", "S1"), ("b", "S1"), ("c", "S2"), ("e", "S3")], "settlement_id string, source string")
    target = spark.createDataFrame([("a", "T1"), ("b", "T2"), ("c", "T2")], "settlement_id string, target string")
    people = spark.createDataFrame([("a", 30.0), ("b", 70.0), ("c", 40.0)], "settlement_id string, population double")
    values = spark.createDataFrame([("S1", 100.0, 20.0, 100.0), ("S2", 40.0, 8.0, 40.0), ("S3", 7.0, 1.0, 1.0)], "source string, cases double, num double, den double")
    got = {r["target"]: r["cases"] for r in geography.apportion(values, source, target, people, ["cases"]).collect()}
    assert got == {"T1": 30.0, "T2": 110.0}
    assert {r["target"]: r["rate"] for r in geography.apportion_rate(values, source, target, people, "num", "den").collect()} == {"T1": 0.2, "T2": 0.2}
    assert geography.lost(source, target).collect()[0]["n_lost"] == 1


def _week(**change):
    row = {"geo_level": "county", "geo_name": "Baranya", "variable": "reported_cases", "value": 5.0, "iso_year": 2024, "iso_week": 7, "period_start": dt.date(2024, 2, 12), "evidence_class": "observed", "source_id": "nngyk"}
    return tuple((row | change).values())


WEEK = "geo_level string, geo_name string, variable string, value double, iso_year int, iso_week int, period_start date, evidence_class string, source_id string"


def test_rules(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), WEEK)
    v = validation
    assert v.duplicates(make(_week(), _week())).first()["n_rows"] == 2 and v.duplicates(make(_week(), _week(geo_name="Heves"))).isEmpty()
    assert one(v.week_gaps(make(_week(iso_week=5), _week(iso_week=9)), ["geo_name"]).select("n_missing")) == 3
    assert v.week_gaps(make(_week(iso_week=5), _week(iso_week=6)), ["geo_name"]).isEmpty()
    assert one(v.week_gaps(make(_week(iso_year=2020, iso_week=52), _week(iso_year=2021, iso_week=1)), ["geo_name"]).select("n_missing")) == 1
    bounds = spark.createDataFrame([("rate", 0.0, 1.0)], "variable string, low double, high double")
    assert v.out_of_range(make(_week(value=-3.0), _week(variable="rate", value=1.5), _week()), bounds).count() == 2
    agree = [_week(value=10.0), _week(geo_name="Heves", value=15.0), _week(geo_level="country", geo_name="HU", value=25.0)]
    assert v.sum_disagreement(make(*agree)).isEmpty() and not v.sum_disagreement(make(_week(value=10.0), *agree[1:2], _week(geo_level="country", value=20.0))).isEmpty()
    many = v.outliers(make(*[_week(value=float(i)) for i in range(1, 20)], _week(value=1e5)), "value", ["variable"])
    assert many.count() == 20 and many.where("quality_flag = 'outlier'").count() == 1
    assert v.wrong_evidence(make(_week(geo_level="district"), _week(geo_level="district", source_id="nngyk_foia"), _week(evidence_class="x"), _week(evidence_class=None))).count() == 3
    assert v.before_break(make(_week(period_start=dt.date(2011, 2, 1)), _week(period_start=dt.date(2016, 2, 1))), ["reported_cases"]).count() == 1
    assert v.mixed_price_years(spark.createDataFrame([(1.0, 2019), (1.0, 2024)], "x_real_2025 double, price_year int")).count() == 2
    d = v.drift({"a": "int", "b": "int"}, spark.createDataFrame([(1, 2)], "a int, c int"))
    assert (d["status"], d["added"], d["removed"]) == ("drifted", ["c"], ["b"])
    found = v.run_all(make(_week(), _week()), v.standard_rules(spark, bounds, ["reported_cases"]) | {"broken": lambda x: x.select("no_such_column")})
    assert {r["rule"] for r in found.collect()} == {"duplicates", "broken"} and "duplicates" in v.report(found)[1]
    with pytest.raises(v.ValidationError):
        v.run_all(make(_week(), _week()), {"duplicates": v.duplicates}, strict=True)
    assert v.run_all(make().limit(0), v.standard_rules(spark, bounds, ["reported_cases"])).isEmpty()


def test_costs(spark):
    index = spark.createDataFrame([("health", 2019, 100.0), ("health", 2024, 130.0), ("health", 2025, 140.0)], "k string, year int, index_value double")
    f = {r["year"]: r["factor"] for r in costs.deflators(index, 2025, ["k"]).collect()}
    assert f[2025] == 1.0 and f[2019] == 1.4 and abs(f[2024] - 140 / 130) < 1e-12
    with pytest.raises(ValueError):
        costs.deflators(index, 1990, ["k"])
    p = spark.createDataFrame([("a", None, 2.0, True, "u"), ("b", None, None, True, "u")], "parameter_id string, value double, rate double, required boolean, source_url string")
    with pytest.raises(costs.MissingParameterError):
        costs.resolve(p)
    assert [r["value"] for r in costs.resolve(p, strict=False).orderBy("parameter_id").collect()] == [2.0, None]


def test_sources(spark):
    page = "<table><tr><th>Település</th><th>Járás</th></tr>" + "".join(f"<tr><td>a{i}</td><td>b</td></tr>" for i in range(3)) + "</table><table><tr><td>x</td></tr></table>"
    t = html.tables(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"))
    assert t.count() == 4 and html.pick_table(t, ["járás"]).collect()[0]["table"] == 0
    assert tabular.pages_of("1-3,5") == {1, 2, 3, 5} and tabular.pages_of("all") is None
    geo = spark.createDataFrame([('{"features": [{"properties": {"name": "A", "@id": "way/1"}, "geometry": {"type": "Point"}}]}',)], "json string")
    assert tuple(tabular.geo_features(geo).first()) == ("A", "way/1", "Point")
    with pytest.raises(tabular.SchemaDriftError):
        tabular.canonical_registry(spark.createDataFrame([(1,)], "settlement_id int"))
    r = tabular.canonical_registry(spark.createDataFrame([("5", "d", "c"), ("123456", "d", "c")], "settlement_id string, district_id string, county_id string"))
    assert [x["settlement_id"] for x in r.orderBy("settlement_id").collect()] == ["00005", "123456"]
    rows = spark.createDataFrame([("f1", 10.0), ("f1", 15.0), ("f2", 10.0)], "file string, value double")
    good, bad = collectors.agreed(rows, spark.createDataFrame([("f1", 25.0, 25.0), ("f2", 10.0, 11.0)], "file string, total double, national double"))
    assert good.count() == 2 and [x["reason"] for x in bad.collect()] == ["national"]
    near = collectors.amount_contexts(spark.createDataFrame([(1, "háziorvosi vizit díja 4 500 Ft, egyéb 900 Ft")], "id int, body string"), "id", "body", {"vizit": "gp_visit_cost"}, 25)
    assert [tuple(x) for x in near.collect()] == [(1, "gp_visit_cost", 4500)]


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    from helpers import DATA

    from almoner.streaming import weekly

    batch = spark.read.parquet(f"{DATA}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    flow = weekly.weekly(weekly.events(spark, str(tmp_path / "in"), batch.schema), "user_id", "event_type", "value", late="400 days")
    weekly_rows = flow.writeStream.outputMode("complete").format("memory").queryName("weeks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    weekly_rows.awaitTermination()
    want = weekly.weekly(batch, "user_id", "event_type", "value")
    got = {tuple(r)[:4] for r in spark.table("weeks").collect()}
    assert got == {tuple(r)[:4] for r in want.collect()} and all(r[2].weekday() == 0 for r in got)


def test_command_line(spark, tmp_path, capsys):
    from helpers import DATA

    from almoner import cli

    assert cli.main(["list"]) == 0 and "equity_summary" in capsys.readouterr().out
    assert cli.main(["--data", DATA, "--out", f"{tmp_path}/costs", "costs"]) == 0
    assert spark.read.parquet(f"{tmp_path}/costs.parquet").count() == 3
    assert cli.main(["--data", DATA, "allocate", "--scenario", "99"]) == 2
    assert cli.main(["--data", DATA, "--out", f"{tmp_path}/found", "validate", "--strict"]) == 1
    assert cli.main(["--data", DATA, "--out", f"{tmp_path}/words", "dictionary"]) == 0
    assert cli.main(["--data", DATA, "--out", f"{tmp_path}/geo", "geography"]) == 0
    changes = spark.read.parquet(f"{tmp_path}/geo/boundary_changes.parquet")
    assert changes.count() > 0 and spark.read.parquet(f"{tmp_path}/geo/geo_districts.parquet").where("valid_to IS NULL").count() > 0
    assert cli.main(["--data", DATA, "--out", f"{tmp_path}/year", "allocate", "--year", "1997", "--scenario", "2"]) == 0
    assert abs(spark.read.parquet(f"{tmp_path}/year.parquet").agg({"aid_amount": "sum"}).first()[0] / 2.5e9 - 1) < 1e-9
    assert cli.main(["--data", DATA, "--out", f"{tmp_path}/asof", "costs", "--year", "1998", "--strict"]) == 1  # one parameter has no listing
    assert cli.main(["--data", DATA, "--out", f"{tmp_path}/weeks", "panel", "--resolution", "weekly"]) == 0
    assert cli.main(["--data", DATA, "--out", f"{tmp_path}/have", "availability"]) == 0
    assert spark.read.parquet(f"{tmp_path}/have.parquet").first()["n_files"] == 1


def test_reviews_by_hand(spark, tmp_path):
    head = ",".join(geography.REVIEW)
    lines = ["# settled in spring", head, "s,Onga,name,0511,x,91.0,confirmed,a,2024-01-01,", "s,Onga,name,0512,x,91.0,confirmed,a,2024-02-01,", "s, encs ,,,,0.0,rejected,a,2024-01-01,", "s,Forró,name,0512,x,90.0,pending,,2024-01-01,", "s,3525,postal,0511,x,100.0,confirmed,a,2024-01-01,", ",,name,1,x,1,confirmed,a,2024-01-01,", "s,Ózd,name,,x,1,confirmed,a,2024-01-01,"]
    (tmp_path / "review.csv").write_text("\n".join(lines), encoding="utf-8")
    got = {tuple(r) for r in geography.manual_reviews(spark, str(tmp_path / "review.csv")).collect()}
    assert got == {("onga", "0512", True), ("encs", None, False)}
    assert {tuple(r) for r in geography.manual_reviews(spark, str(tmp_path / "review.csv"), "postal").collect()} == {("3525", "0511", True)}
    found = spark.createDataFrame([("Felsőzsolca", None, "fuzzy", "pending", 91.234), ("Onga", "0512", "manual", "confirmed", None), ("x", None, "none", "pending", None)], "name string, district_id string, method string, status string, score double")
    out = {r["raw_value"]: (r["score"], r["status"]) for r in geography.pending_reviews(found, "s").collect()}
    assert out == {"Felsőzsolca": ("91.2", "pending"), "x": ("0.0", "pending")}


def test_parameter_book(spark):
    rows = spark.createDataFrame([("a", 1.5, "u", 2024), ("b", None, "see", None)], "parameter_id string, value double, source_url string, price_year int")
    book = costs.ParameterBook(rows)
    assert book.get("a") == 1.5 and book.price_year("a") == 2024 and book.get_optional("b", 7.0) == 7.0 and book.get_optional("c") is None
    for name, said in (("b", "see"), ("c", "no parameter")):
        with pytest.raises(costs.MissingParameterError, match=said):
            book.get(name)


def test_closest_as_it_stands(spark):
    """Without sorting words, and from 88 on."""
    left = spark.createDataFrame([("janoshalmi jaras",), ("jaras janoshalmai",)], "name string")
    right = spark.createDataFrame([(1, 1, "janoshalmai jaras"), (2, 2, "kiskunhalasi jaras")], "candidate_id long, ordinal long, candidate string")
    got = {r["name"]: r["candidate_id"] for r in geography.closest(left, right, 88.0, by_tokens=False).collect()}
    assert got == {"janoshalmi jaras": 1, "jaras janoshalmai": None}


def test_keys_in_names(spark):
    """Against looking for every key in every name."""
    import random

    from almoner.operators import allocation

    rng = random.Random(4)
    names = ["".join(rng.choice("abcÁ ") for _ in range(rng.randint(0, 12))) for _ in range(80)] + [None]
    keys = ["".join(rng.choice("abcá") for _ in range(rng.randint(0, 5))) for _ in range(60)] + [None]
    got = {(r["name"], r["key"]) for r in allocation.found_keys(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert got == {(n, k) for n in names for k in keys if n is not None and k and k.lower() in n.lower()} and len(got) > 100
    supports = spark.createDataFrame([("Budapest 05", 10.0, 0.0), ("Ózd", 1.0, 3.0), (None, 5.0, 5.0)], "municipality string, amount double, cases double")
    bridge = spark.createDataFrame([("budapest", 1), ("PEST", 1), ("ózd", 2), ("zz", 3)], "key string, district_id int")
    assert {tuple(r) for r in allocation.municipal_funding(supports, bridge).collect()} == {(1, 20.0), (2, 3.0)}


def test_p_values_as_columns(spark):
    """Against the helper on the driver, over all sizes of t and degrees of freedom."""
    from almoner.functions import tails

    rows = [(t, n) for t in (0.0, 0.1, -1.0, 2.5, -7.0, 40.0, 1e4) for n in (1, 2, 3, 10, 100, 5000)] + [(1.0, 0), (None, 5), (float("nan"), 5)]
    df = spark.createDataFrame(rows, "t double, n int")
    for r in df.withColumn("p", tails.t_two_sided_column(F.col("t"), F.col("n"))).collect():
        want = tails.t_two_sided(r["t"], r["n"])
        assert (r["p"] is None and want is None) or abs(r["p"] - want) < 1e-9
    r = spark.createDataFrame([(1.0, 5), (0.5, 5), (0.5, 2)], "r double, n int").withColumn("p", tails.correlation_p(F.col("r"), F.col("n"))).collect()
    assert r[0]["p"] == 0.0 and abs(r[1]["p"] - tails.t_two_sided(0.5 * 3**0.5 / 0.75**0.5, 3)) < 1e-12 and r[2]["p"] is None


def test_eligible_third_and_burden_without_children(spark):
    rows = [(i, 10.0 * i, float(i), 100.0 * i, 5.0, i / 10, float(i % 4), float(-i), i % 2 == 0) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "district_id int, population double, cases double, expected_cost double, existing_local_funding double, need_score double, score_socioeconomic double, score_healthcare double, eligible boolean")
    from almoner.operators import allocation

    out = {r["district_id"]: r for r in allocation.wide(df, 900.0, 0.5).collect()}
    third = [i for i in range(1, 10) if i % 4 >= 2]  # two-thirds quantile of 1,2,3,0,1,2,3,0,1 is 2
    assert {i for i in out if out[i]["s7"] > 0} == set(third) and out[1]["eligible_units"] == len(third)
    assert all(abs(sum(r[f"s{k}"] for r in out.values()) - 900.0) < 1e-9 for k in (1, 2, 3, 4, 5, 7)) and out[3]["s0"] == 15.0 and out[3]["s6"] == 285.0
    given = {r["district_id"] for r in allocation.wide(df, 900.0, 0.5, eligible="eligible").where("s7 > 0").collect()}
    assert given == {2, 4, 6, 8}
    none = allocation.wide(df.withColumn("cases", F.lit(0.0)), 900.0, 0.5).first()
    assert none["s2"] == 0.0
    districts = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "district_id int, county_id int")
    people = spark.createDataFrame([(1, 100.0, 10.0), (3, 50.0, 5.0)], "district_id int, people double, jobseekers double")
    cases = spark.createDataFrame([(1, 30.0), (2, 4.0)], "county_id int, cases double")
    got = {r["district_id"]: r for r in panel.burden(districts, people, cases, spark.createDataFrame([(1, 60.0)], "county_id int, children double")).collect()}
    assert got[2]["people"] == 100.0 and got[1]["burden"] == 15.0 and got[1]["burden_hi"] == 22.5 and got[3]["denominator_is"] == "people" and got[3]["burden_rate"] == got[3]["burden_rate_u5"] == 8000.0
    full = {r["district_id"]: r for r in panel.burden(districts, people, cases, spark.createDataFrame([(1, 60.0), (2, 8.0)], "county_id int, children double")).collect()}
    assert full[1]["children"] == 30.0 and abs(full[1]["burden_rate_u5"] - 15.0 / (30.0 * 0.34) * 1000) < 1e-9


def test_closest_loses_no_similar_name(spark):
    """Against all pairs; names differ in any letter, the first too."""
    import random

    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 24))) for _ in range(60)]
    other = [(i, i, "".join(rng.choice("xyz") if rng.random() < 0.06 else x for x in n)) for i, n in enumerate(names)]
    left, right = spark.createDataFrame([(n,) for n in [*names, "", None]], "name string"), spark.createDataFrame(other, "candidate_id long, ordinal long, candidate string")
    got = {r["name"]: r["score"] for r in geography.closest(left, right).collect()}
    best = left.where("name IS NOT NULL").crossJoin(right).withColumn("score", text.similarity(text.sorted_tokens("name"), text.sorted_tokens("candidate"))).where("score >= 90").groupBy("name").max("score").collect()
    assert {k: v for k, v in got.items() if v is not None} == {r[0]: r[1] for r in best} and len(best) > 20 and set(got) == {*names, "", None}
