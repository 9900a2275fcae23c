"""Ranks, numbers, quantiles and Monte-Carlo passes against numpy and sorting, whatever the slices and buffers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almoner.functions import counter, order, selection
from almoner.operators import allocation, equity, need, probabilistic, validation


def _rows(spark, n=3000, seed=1):
    """Groups of all sizes, one value a third of all rows, NULL, NaN, both zeros, tiny and huge numbers of both signs."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.33, 7.25, rng.standard_normal(n) * 10.0 ** rng.integers(-300, 300, n).astype(float))
    x[:6] = [0.0, -0.0, np.nan, np.inf, -np.inf, 5e-324]
    g = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 9, n))
    rows = [(int(i), None if a == 8 else int(a), None if i % 17 == 0 else float(v)) for i, (a, v) in enumerate(zip(g, x, strict=True))]
    return spark.createDataFrame(rows, "id int, g int, x double").repartition(5), pd.DataFrame(rows, columns=["id", "g", "x"])


@pytest.mark.parametrize("buffered", [1 << 16, 40, 1])
def test_quantiles_equal_sorting(spark, monkeypatch, buffered):
    monkeypatch.setattr(selection, "BUFFERED", buffered)
    df, plain = _rows(spark)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["g"], r["name"], r["prob"]): r["value"] for r in selection.quantiles(df, ["g"], {"x": F.col("x"), "half": F.col("id") / 2, "none": F.lit(None).cast("double")}, probs).collect()}
    assert len(got) == 9 * 3 * 5
    for g, part in plain.groupby(plain["g"].fillna(-1)):
        known = np.sort(part["x"].dropna().to_numpy())
        for p in probs:
            at = (len(known) - 1) * p
            lo, hi = known[int(np.floor(at))], known[int(np.ceil(at))]
            want = lo if at == int(at) else lo * (1 - (at % 1)) + hi * (at % 1)
            mine = got[None if g < 0 else int(g), "x", p]
            assert mine == want or np.isclose(mine, want, rtol=1e-12) or (np.isnan(mine) and np.isnan(want))
            assert np.isclose(got[None if g < 0 else int(g), "half", p], np.quantile(part["id"] / 2, p))
            assert got[None if g < 0 else int(g), "none", p] is None


@pytest.mark.parametrize("buffered", [1 << 16, 1])
def test_a_quantile_between_ties_is_their_value(spark, monkeypatch, buffered):
    monkeypatch.setattr(selection, "BUFFERED", buffered)
    values = [v / 100 for v in range(101, 8101, 100)]
    assert any(v * (1 - (7 * 0.9 - 6)) + v * (7 * 0.9 - 6) != v for v in values)  # weights that miss it by a bit
    df = spark.createDataFrame([(g, v) for g, v in enumerate(values) for _ in range(8)], "g int, x double")
    got = {r["g"]: r["value"] for r in selection.quantiles(df, ["g"], {"x": F.col("x")}, [0.9]).collect()}
    assert got == dict(enumerate(values))
    # all ties at the cut are in
    overlap = equity.top_overlap(df, "x", "x", ["g"]).collect()
    assert len(overlap) == len(values) and all(r["overlap"] == 1.0 for r in overlap)


def test_summary_rounds_only_what_it_compares(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0.001, 0.03, 200)
    df = spark.createDataFrame([(0, i, i % 3, float(v), float(i)) for i, v in enumerate(x)], "g int, district_id int, region_id int, aid double, need double")
    made = lambda **kw: equity.summary(df, "aid", "need", "region_id", ["g"], **kw).first().asDict()
    raw, coarse = made(), made(digits=(2, 6))
    for c in ("ci", "gini", "theil", "between", "within", "worst_fifth_share"):
        assert np.isclose(coarse[c], raw[c], rtol=1e-12), c
    assert np.isclose(raw["theil"], (x / x.mean() * np.log(x / x.mean())).mean(), rtol=1e-9)
    ranked = pd.Series(x.round(2)).rank().corr(pd.Series(np.arange(200.0)))
    assert np.isclose(coarse["rho"], ranked) and not np.isclose(raw["rho"], ranked)


def test_monte_carlo_rows_are_dealt_to_all_cores_and_extremes_pruned(spark, monkeypatch):
    n, draws = 300, 40
    rng = np.random.default_rng(8)
    panel = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(rng.uniform(0, 0.1, n), rng.normal(size=n), rng.gamma(2.0, 100.0, n), strict=True))], "district_id long, discount double, x double, expected_cost double").coalesce(1)
    dealt, found = probabilistic.dealt(panel, draws)
    assert found == n and dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(probabilistic, "TASK_CELLS", 10 * draws)
    assert probabilistic.dealt(panel, draws)[0].rdd.getNumPartitions() == 30
    monkeypatch.undo()
    folded, seen = probabilistic.folded, []
    monkeypatch.setattr(probabilistic, "folded", lambda rows, *rest: seen.append(rows.count()) or folded(rows, *rest))
    scenario = allocation.SCENARIOS[5]
    for own, aggregate in ((["discount"], "mpi"), (["discount", "x"], "mpi"), (["discount"], "weighted_sum")):
        index = need.Index([need.Dimension("a", 0.5, own), need.Dimension("b", 0.3, ["x"]), need.Dimension("c", 0.2, ["expected_cost"], inverse=True)], aggregate=aggregate)
        made = lambda: probabilistic.psa(panel, draws, 3, 1e6, index, scenario, "discount").toPandas().sort_values("district_id").reset_index(drop=True)  # noqa: E731, B023
        whole = made()
        monkeypatch.setattr(probabilistic, "SEEDS", 8)
        seen.clear()
        pruned = made()
        monkeypatch.setattr(probabilistic, "SEEDS", 4096)
        assert len(seen) == 4 and seen[1] <= 16 and seen[2] < n and seen[3] == n
        pd.testing.assert_frame_equal(whole, pruned, rtol=1e-12)


def test_quantiles_of_few_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (2, float("nan"))], "g int, x double")
    assert {(r["g"], r["value"]) for r in selection.quantiles(df, ["g"], {"x": F.col("x")}, [0.5]).collect()} == {(1, None), (2, 3.0)}
    assert selection.quantiles(df.where("false"), ["g"], {"x": F.col("x")}, [0.5]).isEmpty()


def test_medians_of_large_groups_in_the_rules(spark, monkeypatch):
    df, plain = _rows(spark)
    small = df.where("abs(x) < 1e6")
    want = {r["id"]: r["robust_z"] for r in validation.outliers(small, "x", ["g"], 3.0).collect()}
    overlap = {r["g"]: r["overlap"] for r in equity.top_overlap(small.withColumn("y", F.col("id") % 91), "x", "y", ["g"]).collect()}
    filled = {r["id"]: r["x"] for r in need.impute(df.where("abs(x) < 1e6 OR x IS NULL"), ["x"]).collect()}
    monkeypatch.setattr(selection, "BUFFERED", 10)
    assert {r["id"]: r["robust_z"] for r in validation.outliers(small, "x", ["g"], 3.0).collect()} == want and len(want) > 500
    assert {r["g"]: r["overlap"] for r in equity.top_overlap(small.withColumn("y", F.col("id") % 91), "x", "y", ["g"]).collect()} == overlap
    assert {r["id"]: r["x"] for r in need.impute(df.where("abs(x) < 1e6 OR x IS NULL"), ["x"]).collect()} == filled


@pytest.mark.parametrize("slices", [1, 7])
def test_ranks_equal_pandas(spark, slices):
    df, plain = _rows(spark)
    df, plain = df.where("NOT isnan(x) OR x IS NULL"), plain[~(plain["x"].isna() & (plain["id"] % 17 != 0))]
    for kind, method in (("mean_rank", "average"), ("least_rank", "min")):
        for up in (True, False):
            got = {r["id"]: r["k"] for r in order.with_ranks(df, {"k": "x"}, ["g"], kind, up, slices).collect()}
            want = dict(zip(plain["id"], plain.groupby(plain["g"].fillna(-1))["x"].rank(method=method, ascending=up), strict=True))
            assert len(got) == len(want) and all((got[i] is None and np.isnan(want[i])) or got[i] == want[i] for i in want)
    whole = {r["id"]: r["k"] for r in order.with_ranks(df, {"k": "x"}, None, "percent_rank", slices=slices).collect()}
    want = dict(zip(plain["id"], plain["x"].rank(pct=True), strict=True))
    assert all((whole[i] is None and np.isnan(want[i])) or np.isclose(whole[i], want[i]) for i in want)


@pytest.mark.parametrize("slices", [1, 6])
def test_numbers_and_running_sums(spark, slices):
    df, plain = _rows(spark, 500)
    got = order.running(order.numbered(df, ["g"], [F.col("x"), F.col("id")], slices=slices), ["g"], [F.col("id")], {"id": F.col("id")}, slices).toPandas()
    assert len(got) == 500
    for _, part in got.groupby(got["g"].fillna(-1)):
        assert sorted(part["number"]) == list(range(1, len(part) + 1)) and (part["n"] == len(part)).all()
        part = part.sort_values("id")
        assert (part["before_id"] == part["id"].cumsum() - part["id"]).all() and (part["all_id"] == part["id"].sum()).all()
    assert order.numbered(df.where("false"), ["g"], [F.col("id")]).isEmpty()


def test_no_window_spans_the_table(spark):
    """Ranks and numbers over a whole table are planned in slices: no window without a partition."""
    df, _ = _rows(spark, 50)
    for made in (order.numbered(df, [], [F.col("id")]), order.with_ranks(df, {"k": "x"})):
        for line in made._jdf.queryExecution().executedPlan().toString().splitlines():
            assert "SinglePartition" not in line or "__slice" not in line


def test_counters(spark):
    state = counter.at(5, 1, np.arange(400)[:, None], np.arange(300)[None, :])
    u = counter.uniform(state)
    assert len(np.unique(u)) == u.size and abs(u.mean() - 0.5) < 0.005 and abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.01
    z = counter.normal(state)
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01
    for shape in (0.2, 1.0, 11.1):
        g = counter.gamma(state, shape)
        assert abs(g.mean() / shape - 1) < 0.02 and abs(g.var() / shape - 1) < 0.05
    k = counter.poisson_1(state)
    assert abs(k.mean() - 1) < 0.01 and abs(k.var() - 1) < 0.02
    # one number is the same alone
    assert counter.gamma(counter.at(5, 1, 17, 33), 0.2) == counter.gamma(state, 0.2)[17, 33]


def test_counters_in_sql(duck):
    units = "(SELECT unit, draw, CASE WHEN unit % 3 = 0 THEN 0.3::DOUBLE WHEN unit % 3 = 1 THEN 1.0 ELSE 11.1 END AS shape FROM range(60) a(unit), range(50) b(draw))"
    sql = f"WITH src AS (SELECT unit, draw, state, shape FROM {counter.sql_with(units, counter.sql_at('state', 7, 3, 'unit', 'draw'))}), {counter.sql_gammas('g', 'src', ['unit', 'draw'])} SELECT unit, draw, value, u, {counter.sql_poisson_1('u')} AS p FROM g JOIN {counter.sql_with('src', counter.sql_uniform('u', 'state'))} USING (unit, draw) ORDER BY unit, draw"
    got = duck.sql(sql).df()
    state, units = counter.at(7, 3, np.arange(60)[:, None], np.arange(50)[None, :]), np.arange(60)[:, None]
    want = counter.gamma(state, np.where(units % 3 == 0, 0.3, np.where(units % 3 == 1, 1.0, 11.1)))
    assert np.allclose(got["value"].to_numpy(), want.ravel(), rtol=1e-12)
    assert (got["u"].to_numpy() == counter.uniform(state).ravel()).all() and (got["p"].to_numpy() == counter.poisson_1(state).ravel()).all()


def test_replicates_against_numpy(spark):
    """Gini and concentration of each replicate, over all counties, and their intervals; copies are taken as rows."""
    rng = np.random.default_rng(2)
    n, reps, seed = 90, 60, 11
    y, r = rng.gamma(2.0, 3.0, n), rng.integers(0, 20, n).astype(float)
    y[:3] = np.nan
    df = spark.createDataFrame([(i, i % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(y, r, strict=True))], "district_id long, g int, y double, r double").repartition(3)
    for by in ("y", "r"):
        sums = probabilistic.replicated(df, "y", by, ["g"], reps, seed)
        stat = {(x["g"], x["rep"]): x["v"] for x in sums.withColumn("v", probabilistic.concentration()).collect()}
        want = {}
        for g in (0, 1):
            ids = np.array([i for i in range(n) if i % 2 == g and not np.isnan(y[i])])
            ids = ids[np.lexsort((ids, {"y": y, "r": r}[by][ids]))]
            for rep in range(reps):
                k = counter.poisson_1(counter.at(seed, probabilistic.REPLICATE, ids, rep))
                copies = np.repeat(y[ids], k)
                m = len(copies)
                want[g, rep] = 2 / (m * copies.mean()) * np.sum((copies - copies.mean()) * ((np.arange(1, m + 1) - 0.5) / m - 0.5))
        assert stat.keys() == want.keys() and all(abs(stat[k] - want[k]) < 1e-9 for k in want)
        for row in probabilistic.interval(sums, probabilistic.concentration(), ["g"]).collect():
            mine = [v for (g, _), v in want.items() if g == row["g"]]
            assert np.allclose([row["low"], row["high"]], np.quantile(mine, [0.025, 0.975])) and row["n_used"] == reps


def test_intervals_skip_what_fails(spark):
    sums = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 2.0, 4.0, 10.0), (1, 2, float("inf"), 1.0, float("inf"))], "g int, rep long, n double, s double, c double")
    assert [tuple(r) for r in probabilistic.interval(sums, probabilistic.concentration(), ["g"]).collect()] == [(1, 0.25, 0.25, 1)]


def test_passes_do_not_hang_on_partitions(spark):
    from almoner.operators import allocation
    from almoner.plans import bindings as b

    from helpers import DATA

    panel = b.panel(spark, DATA)
    index = need.Index([need.Dimension("disease", 0.5, ["discount", "returned"], inverse=True), need.Dimension("money", 0.5, ["own_revenue"])], aggregate="weighted_sum")
    for scenario in (allocation.SCENARIOS[5], allocation.SCENARIOS[2], allocation.SCENARIOS[0], allocation.SCENARIOS[7]):
        made = lambda df: probabilistic.psa(df, 50, 3, 1e6, index, scenario, "discount").toPandas().sort_values("district_id").reset_index(drop=True)  # noqa: E731, B023
        once, again = made(panel), made(panel.repartition(5))
        assert np.allclose(once, again, rtol=1e-9) and ((once["low"] <= once["mean"] + 1e-9) & (once["mean"] <= once["high"] + 1e-9)).all()
        if scenario.normalise:
            assert abs(once["mean"].sum() / 1e6 - 1) < 1e-9
    assert probabilistic.psa(panel.where("false"), 5, 3, 1.0, index, allocation.SCENARIOS[5], "discount").isEmpty()


def test_top_part_has_exactly_so_many(spark):
    df = spark.createDataFrame([(i, float(i % 4), float(i % 3)) for i in range(100)], "district_id long, score_a double, score_b double").repartition(3)
    got = probabilistic.top_frequency(df, 40, 1, {"a": 0.5, "b": 0.5}).toPandas()
    assert abs(got["frequency"].sum() - 10) < 1e-9 and len(got) == 100
    w = probabilistic.dirichlet_weights(40, 1, [0.5, 0.5])
    plain = df.toPandas().sort_values("district_id")
    hits = np.zeros(100)
    for a, c in w:
        s = plain["score_a"].to_numpy() * a + plain["score_b"].to_numpy() * c
        hits[np.lexsort((np.arange(100), -s))[:10]] += 1
    assert np.allclose(got.sort_values("district_id")["frequency"], hits / 40)
