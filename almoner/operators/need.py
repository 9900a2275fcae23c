"""Composite need indices.

Moments come from one aggregation each, so no window spans the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls, order, selection

TINY = 1e-9


@dataclass
class Dimension:
    """inverse: more of it is less need. Variables whose name ends in _inverse are turned one by one."""

    name: str
    weight: float
    variables: list[str]
    inverse: bool = False


@dataclass
class Index:
    dimensions: list[Dimension]
    standardise: str = "zscore"
    aggregate: str = "mpi"
    impute: str = "median"
    ddof: int = 0
    weights: dict[str, float] = field(init=False)

    def __post_init__(self):
        if any(d.weight < 0 for d in self.dimensions) or not sum(d.weight for d in self.dimensions) > 0:
            raise ValueError("weights must not be negative, nor all zero")
        whole = sum(d.weight for d in self.dimensions)
        self.weights = {d.name: d.weight / whole for d in self.dimensions}


def with_moments(df: DataFrame, columns: list[str], group: list[str], moments: Callable[[str], dict[str, Column]]) -> DataFrame:
    """Adds aggregates of columns as __<name>_<column>.

    Over the whole table they are one row of numbers, taken to the driver and put back as literals: joined back, each step
    of an index would hold its input twice, and a chain of steps would double with each. By groups they are joined.
    """
    made = [v.alias(f"__{k}_{c}") for c in columns for k, v in moments(c).items()]
    if group:
        return df.join(df.groupBy(*group).agg(*made), group)
    row = df.agg(*made).first()
    return df.withColumns({k: F.lit(v) if v is not None else F.lit(None).cast("double") for k, v in row.asDict().items()})


def without_moments(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def impute(df: DataFrame, columns: list[str], how: str = "median", group: list[str] | None = None) -> DataFrame:
    """Unknown values become the median or the mean of the known; `none` leaves them."""
    if how == "none":
        return df
    own = {c: nulls.known(F.col(c).cast("double")) for c in columns}
    if how == "mean":
        filled = with_moments(df, columns, group or [], lambda c: {"fill": F.avg(own[c])})
    elif not group:
        fills = {r["name"]: r["value"] for r in selection.quantiles(df, [], own, [0.5]).collect()}  # a row for each column
        filled = df.withColumns({f"__fill_{c}": F.lit(fills.get(c)).cast("double") for c in columns})
    else:
        fills = selection.quantiles(df, group, own, [0.5])
        filled = df.join(fills.groupBy(*group).pivot("name", columns).agg(F.max("value")).withColumnsRenamed({c: f"__fill_{c}" for c in columns}), group)
    return without_moments(filled.withColumns({c: F.coalesce(own[c], f"__fill_{c}") for c in columns}))


def standardise(df: DataFrame, columns: list[str], how: str = "zscore", group: list[str] | None = None, ddof: int = 0, constant: float = 0.0) -> DataFrame:
    """Replaces columns by z-scores (0 without spread), their place from least to most (`constant` without spread), or mean percent ranks."""
    group = group or []
    if how == "rank":
        rows = df.withColumns({f"__of_{c}": F.col(c).cast("double") for c in columns})
        ranked = order.with_ranks(rows, {f"__rank_{c}": f"__of_{c}" for c in columns}, group, "percent_rank")
        return ranked.withColumns({c: F.col(f"__rank_{c}") for c in columns}).drop(*[f"__{k}_{c}" for c in columns for k in ("of", "rank")])
    if how == "zscore":
        sd = F.stddev_samp if ddof else F.stddev_pop
        rows = with_moments(df, columns, group, lambda c: {"m": F.avg(c), "s": sd(F.col(c).cast("double"))})
        made = {c: F.when(F.coalesce(nulls.known(f"__s_{c}"), F.lit(0.0)) == 0, F.when(F.col(c).isNotNull(), F.lit(0.0))).otherwise((F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0))) for c in columns}
    elif how == "minmax":
        rows = with_moments(df, columns, group, lambda c: {"lo": F.min(c), "hi": F.max(c)})
        made = {c: F.when(F.col(f"__hi_{c}") == F.col(f"__lo_{c}"), F.when(F.col(c).isNotNull(), F.lit(float(constant)))).otherwise((F.col(c) - F.col(f"__lo_{c}")) / F.nullif(F.col(f"__hi_{c}") - F.col(f"__lo_{c}"), F.lit(0.0)).cast("double")) for c in columns}
    else:
        raise ValueError(how)
    return without_moments(rows.withColumns(made))


def unit_interval(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """From least to most; 0.5 without spread."""
    return standardise(df, columns, "minmax", group, constant=0.5)


def scores(df: DataFrame, index: Index, group: list[str] | None = None) -> DataFrame:
    """Adds score_<dimension>: the mean of its standardised variables. A dimension without a variable at hand is 0.

    A variable `x_inverse` is taken from its own column if there is one, else from the column x, and turned.
    """
    made, own = {}, {}
    for d in index.dimensions:
        for v in d.variables:
            column = v if v in df.columns else v.removesuffix("_inverse")
            if column in df.columns:
                made[f"__v_{d.name}_{v}"] = F.col(column).cast("double")
                own.setdefault(d.name, []).append((f"__v_{d.name}_{v}", v.endswith("_inverse")))
    rows = df.withColumns({k.removeprefix("__"): v for k, v in made.items()})
    names = [k.removeprefix("__") for k in made]
    rows = standardise(impute(rows, names, index.impute, group), names, index.standardise, group, index.ddof)
    out = {}
    for d in index.dimensions:
        parts = [(-1 if turned else 1) * F.col(x.removeprefix("__")) for x, turned in own.get(d.name, [])]
        mean = nulls.row_mean(parts) if parts else F.lit(0.0)
        out[f"score_{d.name}"] = -mean if d.inverse else mean
    return rows.withColumns(out).drop(*names)


def weighted_sum(index: Index) -> Column:
    return sum(F.coalesce(F.col(f"score_{d}"), F.lit(0.0)) * w for d, w in index.weights.items())


def mpi(df: DataFrame, index: Index, group: list[str] | None = None, sign: int = -1, weighted: bool = False, again: bool = True, out: str = "need") -> DataFrame:
    """Mazziotta-Pareto: the mean of the dimensions, less (or plus) a penalty for being uneven.

    again: put each dimension on 100 +- 10 first. weighted: moments across dimensions use the weights.
    """
    dims = list(index.weights)
    columns = [f"score_{d}" for d in dims]
    rows = df.withColumns({f"z_{c}": F.col(c) for c in columns})
    if again:
        rows = standardise(rows, [f"z_{c}" for c in columns], "zscore", group)
    w = [index.weights[d] if weighted else 1 / len(dims) for d in dims]
    z = [100 + 10 * F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) for c in columns]
    mean = sum(a * b for a, b in zip(w, z, strict=True))
    variance = sum(a * (b - mean) * (b - mean) for a, b in zip(w, z, strict=True))
    sd = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return rows.withColumn(out, mean + sign * sd * F.coalesce(nulls.ratio(sd, mean), F.lit(0.0))).drop(*[f"z_{c}" for c in columns])


def entropy_weights(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Columns that tell rows apart weigh more. Two aggregations; the driver gets a number for each column."""
    positive = {c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) + TINY for c in columns}
    first = df.agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(positive.values())]).first()
    n = max(first["n"], 2)
    share = [v / float(first[f"s{i}"]) for i, v in enumerate(positive.values())]
    second = df.agg(*[(-F.sum(p * F.ln(p)) / float(np.log(n))).alias(f"e{i}") for i, p in enumerate(share)]).first()
    spread = {c: 1 - second[i] for i, c in enumerate(columns)}
    whole = sum(spread.values())
    return {c: (x / whole if whole > 0 else 1 / len(columns)) for c, x in spread.items()}


def entropy(df: DataFrame, index: Index, out: str = "need", by_weight: bool = False) -> DataFrame:
    dims = list(index.weights)
    w = entropy_weights(df, [f"score_{d}" for d in dims])
    w = {d: w[f"score_{d}"] * (index.weights[d] if by_weight else 1) for d in dims}
    whole = sum(w.values()) or 1.0
    return df.withColumn(out, sum(F.coalesce(F.col(f"score_{d}"), F.lit(0.0)) * (w[d] / whole) for d in dims))


def first_component(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Loadings of the first principal component of standardised columns, signed so that it rises with their mean.

    The driver gets the correlations of the columns, a small square, and no rows.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    row = df.agg(*[nulls.correlation(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first() if pairs else {}
    m = np.eye(len(columns))
    for i, j in pairs:
        x = row[f"c{i}_{j}"]
        m[i, j] = m[j, i] = 0.0 if x is None or np.isnan(x) else x
    vector = np.linalg.eigh(m)[1][:, -1]
    # the covariance of the component with the rows' mean of standardised columns
    return dict(zip(columns, (vector if vector @ m @ np.ones(len(columns)) >= 0 else -vector).tolist(), strict=True))


def pca(df: DataFrame, index: Index, out: str = "need") -> DataFrame:
    columns = [f"score_{d}" for d in index.weights]
    load = first_component(df, columns)
    z = standardise(df.withColumns({f"z_{c}": F.col(c) for c in columns}), [f"z_{c}" for c in columns])
    return z.withColumn(out, sum(F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) * load[c] for c in columns)).drop(*[f"z_{c}" for c in columns])


def need_index(df: DataFrame, index: Index, group: list[str] | None = None) -> DataFrame:
    """Adds need_score and need_<dimension>, each from least to most of the group."""
    rows = scores(df, index, group)
    if index.aggregate == "weighted_sum":
        rows = rows.withColumn("need", weighted_sum(index))
    elif index.aggregate == "mpi":
        rows = mpi(rows, index, group)
    elif index.aggregate == "entropy":
        rows = entropy(rows, index)
    elif index.aggregate == "pca":
        rows = pca(rows, index)
    else:
        raise ValueError(index.aggregate)
    renamed = {"need": "need_score"} | {f"score_{d}": f"need_{d}" for d in index.weights}
    return unit_interval(rows.withColumnsRenamed(renamed), list(renamed.values()), group)


def need_rank(df: DataFrame, score: str = "need_score", out: str = "need_rank") -> DataFrame:
    """Adds the place of each row from the neediest: ties share their mean rank, cut to a whole number."""
    return order.with_ranks(df, {out: score}, ascending=False).withColumn(out, F.floor(out).cast("long"))


def variants(df: DataFrame, index: Index, official: str | None = None) -> DataFrame:
    """The analysis' forms of the index, each from least to most, as columns of df (which has score_<dimension>).

    mpi: the penalised weighted mean of z-scores; wsum: the weighted sum of scores put between least and most; rank_ws: of
    their mean ranks; drop_<dimension>: mpi without it; swap: mpi with `official` (more of it is less need) in place of the
    socioeconomic scores. Standard deviations divide by n - 1.
    """
    dims, c = list(index.weights), F.col
    rows = df.withColumns({f"{k}_{d}": c(f"score_{d}") for d in dims for k in "zm"} | ({"z_official": -c(official).cast("double")} if official else {}))
    rows = standardise(rows, [f"z_{d}" for d in [*dims, *(["official"] if official else [])]], "zscore", ddof=1)
    rows = standardise(rows, [f"m_{d}" for d in dims], "minmax")
    rows = order.with_ranks(rows, {f"r_{d}": f"score_{d}" for d in dims})

    def penalised(parts: dict[str, str]) -> Column:
        whole = sum(index.weights[d] for d in parts)
        w = {d: index.weights[d] / whole for d in parts}
        y = {d: 100 + 10 * c(z) for d, z in parts.items()}
        mean = sum(w[d] * y[d] for d in parts)
        variance = sum(w[d] * (y[d] - mean) * (y[d] - mean) for d in parts)
        return mean - variance / mean

    z = {d: f"z_{d}" for d in dims}
    made = {"mpi": penalised({d: f"score_{d}" for d in dims}), "wsum": sum(index.weights[d] * c(f"m_{d}") for d in dims), "rank_ws": sum(index.weights[d] * c(f"r_{d}") for d in dims)}
    made |= {f"drop_{d}": penalised({x: v for x, v in z.items() if x != d}) for d in dims}
    if official:
        made["swap"] = penalised(z | {"socioeconomic": "z_official"})
    out = rows.withColumns(made)
    return unit_interval(out, list(made)).select(*df.columns, *made)


def robustness(specs: DataFrame, top: int, unit: str = "district_id") -> DataFrame:
    """unit, n_specs: in how many specifications (columns but the unit) it is among the `top` highest, ties to the least id; a specification is numbered in slices."""
    columns = [c for c in specs.columns if c != unit]
    long = specs.unpivot([unit], columns, "spec", "score")
    placed = order.numbered(long, ["spec"], [F.desc_nulls_last("score"), F.col(unit)], "k")
    return placed.groupBy(unit).agg(F.sum((F.col("k") <= top).cast("long")).alias("n_specs"))


def composition(df: DataFrame, index: Index, top: int = 30, unit: str = "district_id") -> DataFrame:
    """Of the `top` neediest units, each dimension's part: weight times what its score is above the least."""
    columns = [f"need_{d}" for d in index.weights]
    rows = with_moments(df, columns, [], lambda c: {"lo": F.min(c)})
    return rows.orderBy(F.desc("need_score"), unit).limit(top).select(unit, "need_score", *[((F.col(f"need_{d}") - F.col(f"__lo_need_{d}")) * w).alias(f"part_{d}") for d, w in index.weights.items()])
