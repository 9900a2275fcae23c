"""What results hang on: one-way changes, grids, Monte-Carlo draws.

Draws are numbered and each has a generator seeded by (seed, number), so results don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nulls, order
from ..functions.lineage import cut


def tornado(spark: SparkSession, base: dict[str, float], evaluate: Column, deltas: tuple[float, ...] = (0.1, 0.25)) -> DataFrame:
    """parameter, delta, low, high, swing: each parameter alone made less and more; evaluate is a column over the parameters."""
    rows = [(k, d, s, *[v * (1 + s * d) if x == k else v for x, v in base.items()]) for k in base for d in deltas for s in (-1.0, 1.0)]
    frame = spark.createDataFrame([(a, float(b), c, *map(float, v)) for a, b, c, *v in rows], ", ".join(["parameter string", "delta double", "sign double", *[f"{k} double" for k in base]]))
    value = frame.select("parameter", "delta", "sign", evaluate.alias("v"))
    out = value.groupBy("parameter", "delta").agg(F.max(F.when(F.col("sign") < 0, F.col("v"))).alias("low"), F.max(F.when(F.col("sign") > 0, F.col("v"))).alias("high"))
    return out.withColumn("swing", F.abs(F.col("high") - F.col("low")))


def bounds_tornado(spark: SparkSession, levels: dict[str, tuple[float, float, float]], evaluate: Column) -> DataFrame:
    """parameter, base, low, high, spread: each parameter alone at its low and its high level."""
    rows = [("base", "base", *[v[0] for v in levels.values()])] + [(k, side, *[v[i] if x == k else v[0] for x, v in levels.items()]) for k in levels for i, side in ((1, "low"), (2, "high"))]
    frame = spark.createDataFrame(rows, ", ".join(["parameter string", "side string", *[f"{k} double" for k in levels]])).select("parameter", "side", evaluate.alias("v"))
    at_base = frame.where("side = 'base'").select(F.col("v").alias("base"))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("v")))
    return frame.where("side <> 'base'").groupBy("parameter").agg(pick("low").alias("low"), pick("high").alias("high")).crossJoin(F.broadcast(at_base)).withColumn("spread", F.abs(F.col("high") - F.col("low")))


def grid(df: DataFrame, etas: list[float], rates: list[float], budget: float, population: str = "population", need: str = "need_score", cases: str = "cases", tie: str = "district_id") -> DataFrame:
    """eta, rate, reshuffled (half the summed change against shares by population, over the budget), ci.

    Aid is shared by population * (1 + eta * need) plus rate times cases. The order by need is that of all cells, so rows
    are numbered once, in slices; a cell's total is made of three sums; then each row is met by the cells, which are few.
    """
    rows = df.select(F.col(population).cast("double").alias("p"), F.col(need).cast("double").alias("x"), F.col(cases).cast("double").alias("c"), tie).where(nulls.known("x").isNotNull())
    placed = cut(order.numbered(rows, [], [F.col("x"), F.col(tie)], "k"))
    p, px, c = placed.agg(F.sum("p"), F.sum(F.col("p") * F.col("x")), F.sum("c")).first()
    if p is None:
        return df.sparkSession.createDataFrame([], "eta double, rate double, reshuffled double, ci double")
    cells = F.explode(F.array(*[F.struct(F.lit(float(e)).alias("eta"), F.lit(float(r)).alias("rate"), F.lit(float(p + e * px + r * c)).alias("whole")) for e in etas for r in rates]))
    met = placed.select("p", "x", "c", ((F.col("k") - 0.5) / F.col("n") - 0.5).alias("off"), cells.alias("cell")).select("p", "x", "c", "off", "cell.*")
    share = nulls.ratio(F.col("p") * (1 + F.col("eta") * F.col("x")) + F.col("rate") * F.col("c"), "whole")
    aid = budget * share
    moved = F.sum(F.abs(aid - budget * nulls.ratio(F.col("p"), F.lit(float(p))))) / 2 / budget
    return met.groupBy("eta", "rate").agg(moved.alias("reshuffled"), nulls.ratio(2 * F.sum(aid * F.col("off")), F.sum(aid)).alias("ci"))


def draws(spark: SparkSession, n: int, seed: int, draw: Callable[[np.random.Generator], dict[str, float]], columns: list[str], parts: int = 8) -> DataFrame:
    """draw_id and columns: numbers drawn on the executors, the same however they are dealt."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [draw(np.random.default_rng([seed, int(i)])) for i in f["id"]]
            yield pd.DataFrame({"draw_id": f["id"].astype("int64"), **{c: np.array([float(x[c]) for x in made], dtype="float64") for c in columns}})

    return spark.range(0, n, 1, parts).mapInPandas(run, ", ".join(["draw_id long", *[f"{c} double" for c in columns]]))


def dirichlet(spark: SparkSession, n: int, seed: int, weights: dict[str, float], concentration: float = 20.0) -> DataFrame:
    """draw_id and a weight for each name, summing to 1: gammas over their sum."""

    def draw(rng: np.random.Generator) -> dict[str, float]:
        g = {k: rng.gamma(max(w * concentration, 1e-9)) for k, w in weights.items()}
        s = sum(g.values())
        return {k: x / s for k, x in g.items()}

    return draws(spark, n, seed, draw, list(weights))
