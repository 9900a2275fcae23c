"""Each query against its SQL, over the smallest tables."""

from __future__ import annotations

import pytest
from helpers import DATA, plain

from almoner.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert plain(found) == plain(want)
    else:
        assert len(found)


def test_draws_do_not_hang_on_partitions(spark):
    from almoner.operators import sensitivity

    w = {"a": 0.5, "b": 0.3, "c": 0.2}
    once = sensitivity.dirichlet(spark, 20, 7, w).toPandas().sort_values("draw_id").reset_index(drop=True)
    again = sensitivity.dirichlet(spark, 20, 7, w).repartition(3).toPandas().sort_values("draw_id").reset_index(drop=True)
    assert once.equals(again) and (abs(once[["a", "b", "c"]].sum(axis=1) - 1) < 1e-12).all()


def test_interval_order(spark):
    r = catalog.psa(spark, DATA).toPandas()
    assert ((r["low"] <= r["mean"]) & (r["mean"] <= r["high"])).all()


def test_pca_is_the_direction_of_most_variance(spark):
    import numpy as np

    from almoner.operators import need
    from almoner.plans import bindings as b

    i = b.index()
    rows = need.scores(b.panel(spark, DATA), i)
    columns = [f"score_{d}" for d in b.DIMS]
    load = np.array(list(need.first_component(rows, columns).values()))
    m = np.corrcoef(rows.select(*columns).toPandas().to_numpy().T)
    assert abs(load @ load - 1) < 1e-9
    assert abs(load @ m @ load - np.linalg.eigvalsh(m)[-1]) < 1e-6


def test_psa_covers_the_panel(spark, monkeypatch):
    """All districts get an interval, from as many draws as surveyed, and the means share the whole budget."""
    from almoner.operators import probabilistic
    from almoner.plans import bindings as b

    asked, psa = [], probabilistic.psa
    monkeypatch.setattr(probabilistic, "psa", lambda df, n, *rest: asked.append(n) or psa(df, n, *rest))
    r = catalog.psa(spark, DATA).toPandas()
    ids = {x["district_id"] for x in b.panel(spark, DATA).select("district_id").collect()}
    assert asked == [2000] and set(r["district_id"]) == ids and len(r) == len(ids)
    assert abs(r["mean"].sum() / b.BUDGET - 1) < 1e-6


def test_consistency_of_all_vintages(spark, monkeypatch):
    """A blank district is found in whatever vintage and settlement it stands."""
    from pyspark.sql import functions as F

    from almoner.plans import bindings as b

    v = b.vintages(spark, DATA)
    bad = v.where("vintage <> 1999 OR settlement_id % 3 = 0").orderBy("settlement_id", "vintage").first()
    at = (F.col("settlement_id") == bad["settlement_id"]) & (F.col("vintage") == bad["vintage"])
    monkeypatch.setattr(b, "vintages", lambda s, d: v.withColumn("district_id", F.when(~at, F.col("district_id"))))
    found = catalog.consistency_of_vintages(spark, DATA).where("rule = 'blank_district'").collect()
    assert [r["unit"] for r in found] == [str(bad["settlement_id"])]


def test_names_of_all_pages(spark, tmp_path):
    """Pages whose url has accents, or is null, have a row too."""
    spark.createDataFrame([(1, "Ónga-Őr.hu/Árvíz"), (2, "a.hu/B"), (3, None)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: r["name"] for r in catalog.name_normalise(spark, str(tmp_path)).collect()}
    assert set(found) == {1, 2, 3} and found[1] == "onga or hu arviz" and found[2] == "a hu b"
