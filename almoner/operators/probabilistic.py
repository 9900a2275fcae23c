"""Monte-Carlo runs over all units, from numbers that counters give (functions.counter).

Units times draws are never rows. A pass takes units in blocks and all draws of each, as a matrix in the task; what a
later step needs of a draw over all units (a sum, a least, a most) is folded in the task to an array as long as there are
draws, and Spark adds these up. A later pass makes the same numbers again and uses the sums: a unit's results over all its
draws, percentiles too, are exact and need no shuffle. The driver holds a few numbers for each draw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import counter, nulls, order
from ..functions.lineage import cut
from . import need as needs
from .allocation import AllocationError, Scenario, prepare

#: Numbers of a block's matrix: half a megabyte, of which a core's cache holds some.
CELLS = 1 << 16
#: Numbers of a task, at most where there are several rows: 10 to 20 seconds of gammas.
TASK_CELLS = 1 << 25
#: Rows at either end of their reach of need that are run first, to rule others out.
SEEDS = 4096
# Streams of the counters.
COST, RISK_A, RISK_B, PARAMETER, WEIGHT, ETA, BURDEN, NOISE, REPLICATE = range(9)

Block = dict[str, np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch], draws: int) -> Iterator[Block]:
    """Columns of a few rows at a time, as columns of a matrix whose other axis is the draws."""
    step = max(1, CELLS // max(draws, 1))
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            yield {name: part.column(i).to_numpy(zero_copy_only=False)[:, None] for i, name in enumerate(part.schema.names)}


def dealt(rows: DataFrame, draws: int) -> tuple[DataFrame, int]:
    """rows, kept, and their number: in parts of at most TASK_CELLS numbers of all draws, and enough of them for all cores.

    A row is little to read but `draws` numbers to make, so parts that are cut by bytes would leave most cores without work.
    """
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return cut(rows.repartition(max(1, min(n, max(3 * cores, -(-n * draws // TASK_CELLS)))))), n


def folded(rows: DataFrame, draws: int, made: Callable[[Block], dict[str, np.ndarray]], how: dict[str, str]) -> dict[str, np.ndarray]:
    """For each name in how an array over the draws: the sum, min or max over all rows of the matrix that made gives of a block."""
    ufunc = {"sum": np.add, "min": np.minimum, "max": np.maximum}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for block in _blocks(batches, draws):
            for name, matrix in made(block).items():
                here = ufunc[how[name]].reduce(matrix, axis=0)
                held[name] = here if name not in held else ufunc[how[name]](held[name], here)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws), pa.int64()), *[pa.array(held[n], pa.float64()) for n in how]], names=["draw_id", *how])

    partial = rows.mapInArrow(run, T.StructType([T.StructField("draw_id", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in how]]))
    total = partial.groupBy("draw_id").agg(*[getattr(F, h)(n).alias(n) for n, h in how.items()])
    out = {n: np.full(draws, np.nan) for n in how}
    for r in total.collect():  # a row for each draw
        for n in how:
            out[n][r["draw_id"]] = r[n]
    return out


def spread(rows: DataFrame, draws: int, made: Callable[[Block], np.ndarray], low: float = 0.025, high: float = 0.975, unit: str = "unit") -> DataFrame:
    """unit, mean, low, high over all draws of each unit, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, draws):
            matrix = made(block)
            mean, ordered = matrix.mean(axis=1), np.sort(matrix, axis=1)  # of doubles faster than a selection
            yield pa.RecordBatch.from_arrays([pa.array(block[unit][:, 0], pa.int64()), pa.array(mean), *[pa.array(_placed(ordered, q)) for q in (low, high)]], names=["unit", "mean", "low", "high"])

    return rows.mapInArrow(run, "unit long, mean double, low double, high double")


def _placed(ordered: np.ndarray, q: float) -> np.ndarray:
    """The quantile of each row of sorted numbers, linear between neighbours."""
    at = (ordered.shape[1] - 1) * q
    k = int(at)
    lo, hi = ordered[:, k], ordered[:, min(k + 1, ordered.shape[1] - 1)]
    return np.where(lo == hi, lo, lo + (hi - lo) * (at - k))


def _between(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    flat = high == low
    out = (x - low) / np.where(flat, 1.0, high - low)
    return np.where(flat, 0.5, out) if np.any(flat) else out


def psa(df: DataFrame, draws: int, seed: int, budget: float, index: needs.Index, scenario: Scenario, incidence: str, cost: str = "expected_cost", cv: float = 0.3, a: float = 8.0, b: float = 2.0, unit: str = "district_id") -> DataFrame:
    """unit, mean, low, high of a scenario's aid over draws of each unit's cost (gamma of the given variation) and incidence.

    Incidence is beta(a f, b (1 - f)) times the most, with f a unit's part of the most. In each draw the need index is made
    anew with the drawn incidence, and the scenario is run with it. The index has z-scores; its dimension that holds the
    incidence may hold other variables too. Missing cost and incidence are 0. Passes: moments of the drawn incidence, from
    which those of its dimension follow; extremes of need; the sum to share by; and the results. The extremes are looked
    for only where they can be: a unit's need is bounded by an incidence of 0 and of the most, and once SEEDS units at
    either end of these bounds have been run, units whose bounds don't pass what was found are left out of that pass.
    """
    if index.standardise != "zscore" or index.aggregate not in ("mpi", "weighted_sum"):
        raise ValueError("a drawn index needs z-scores, and mpi or weighted_sum")
    own = next((d for d in index.dimensions if incidence in d.variables), None)
    others = [d for d in index.dimensions if d is not own]
    rest = [v for v in own.variables if v != incidence] if own else []
    # fixed parts of the index: the other dimensions, and the other variables of its own
    fixed = needs.Index([needs.Dimension(d.name, d.weight, d.variables, d.inverse) for d in others] + ([needs.Dimension("rest", own.weight, rest)] if rest else []), impute=index.impute, ddof=index.ddof)
    rows = needs.scores(df, fixed)
    names = [f"score_{d.name}" for d in others]
    again = needs.standardise(rows.withColumns({f"z_{c}": F.col(c) for c in names}), [f"z_{c}" for c in names]) if index.aggregate == "mpi" else rows.withColumns({f"z_{c}": F.col(c) for c in names})
    zero = F.lit(0.0)
    known = lambda c: F.coalesce(nulls.known(F.col(c).cast("double")), zero)
    prepared = prepare(again)
    rows, n = dealt(prepared.select(
        F.col(unit).cast("long").alias("unit"), known(cost).alias("cost"), known(incidence).alias("x"),
        (F.col("score_rest") * float(len(rest)) if rest else zero).alias("rest"), *[F.coalesce(F.col(f"z_{c}"), zero).alias(f"z{i}") for i, c in enumerate(names)],
        F.col("aux_population").alias("population"), F.col("aux_local").alias("local"), F.col("aux_revenue").alias("revenue"), F.coalesce("fiscal", zero).alias("fiscal"), F.col("aux_eligible").cast("double").alias("eligible"),
        F.col("aux_socioeconomic").alias("socioeconomic"), F.col("aux_healthcare").alias("healthcare"),
    ), draws)
    most, rest_mean, rest_var = rows.agg(F.max("x"), F.avg("rest"), F.var_pop("rest")).first()
    if not n:
        return spread(rows, draws, lambda block: np.zeros((0, draws))).withColumnRenamed("unit", unit)
    most, d = most or 1.0, np.arange(draws)
    weights = [index.weights[x.name] for x in others] + ([index.weights[own.name]] if own else [])
    sign, m = (-1.0 if own and own.inverse else 1.0), 1 + len(rest)
    told: dict[str, np.ndarray] = {}

    def drawn_incidence(block: Block) -> np.ndarray:
        f = np.clip(block["x"] / most, 1e-6, 1 - 1e-6)
        x, y = counter.gamma(counter.at(seed, RISK_A, block["unit"], d), a * f), counter.gamma(counter.at(seed, RISK_B, block["unit"], d), b * (1 - f))
        y += x
        if not y.all():
            y[y == 0] = 1.0  # x is 0 there too
        x /= y
        x *= most
        return x

    def own_term(block: Block, x: np.ndarray) -> np.ndarray:
        """The own dimension's part of need where its incidence is x, which may be changed; on its scale again for mpi: a line of x for each draw."""
        step, base = sign * told["over_sd"] / m, sign * (block["rest"] - told["mean"] * told["over_sd"]) / m
        if index.aggregate == "mpi":
            step, base = step * told["over_own_sd"], (base - told["own_mean"]) * told["over_own_sd"]
        x = np.multiply(x, step, out=x if x.shape == (len(block["unit"]), draws) else None)
        return np.add(x, base, out=x)

    def others_of(block: Block) -> list[np.ndarray]:
        return [block[f"z{i}"] for i in range(len(others))]

    def need_at(z: list[np.ndarray]) -> np.ndarray:
        if index.aggregate == "weighted_sum":
            return sum(w * x for w, x in zip(weights, z, strict=True))
        # with y = 100 + 10 z: the mean less the variance over the mean is twice the mean less the sum of squares over the sum
        y = [100 + 10 * x for x in z]
        one, k = sum(y[:-1], 0.0), len(y)
        square = sum((x * x for x in y[:-1]), 0.0)  # columns of units, but for the last
        whole = y[-1] + one
        out = y[-1] * y[-1]
        out = (out + square) / whole
        return whole * (2 / k) - out

    def need(block: Block, drawn: np.ndarray | None = None) -> np.ndarray:
        z = others_of(block)
        if own:
            z.append(own_term(block, drawn_incidence(block) if drawn is None else drawn))
        return np.broadcast_to(need_at(z), (len(block["unit"]), draws))

    def reach(block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Between what need lies for each unit, whatever is drawn: at the ends of its incidence, and for mpi (concave while the sum is positive) at its top between them."""
        shape = (len(block["unit"]), draws) if rest else (1, draws)
        part = block if rest else {"unit": block["unit"][:1], "rest": np.zeros((1, 1))}
        ends = [own_term(part, np.full(shape, x)) for x in (0.0, most)]
        slack = lambda x: 1e-9 * (1 + np.abs(x))
        low, high = np.minimum(*ends).min(axis=1, keepdims=True), np.maximum(*ends).max(axis=1, keepdims=True)
        low, high = low - slack(low), high + slack(high)
        z = others_of(block)
        tried = [np.broadcast_to(need_at([*z, x]), block["unit"].shape) for x in (low, high)]
        least, greatest = np.minimum(*tried), np.maximum(*tried)
        if index.aggregate == "mpi":
            y = [100 + 10 * x for x in z]
            one, k = sum(y, np.zeros(block["unit"].shape)), len(y) + 1
            if k > 2:
                top = np.sqrt((sum(x * x for x in y) + one * one) / (1 - 2 / k)) - one
                greatest = np.maximum(greatest, need_at([*z, np.clip((top - 100) / 10, low, high)]))
            unbounded = ~(one + 100 + 10 * low > 0)
            least, greatest = np.where(unbounded, -np.inf, least), np.where(unbounded, np.inf, greatest)
        return least - slack(least), greatest + slack(greatest)

    def able() -> DataFrame:
        """The rows among which each draw's least and greatest need are."""
        if not own or n <= 4 * SEEDS:
            return rows
        made = T.StructType([*rows.schema.fields, T.StructField("least", T.DoubleType()), T.StructField("greatest", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ends = [reach(block) for block in _blocks(iter([batch]), draws if rest else 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.concatenate([e[i][:, 0] for e in ends]) if ends else np.zeros(0)) for i in (0, 1)]], names=made.names)

        bounded = rows.mapInArrow(run, made)
        first = cut(bounded.orderBy("least").limit(SEEDS).union(bounded.orderBy(F.desc("greatest")).limit(SEEDS)).select(*rows.columns).repartition(3 * rows.sparkSession.sparkContext.defaultParallelism))
        found = extremes(first)
        return bounded.where((F.col("least") <= float(found["low"].max())) | (F.col("greatest") >= float(found["high"].min()))).select(*rows.columns)

    def extremes(among: DataFrame) -> dict[str, np.ndarray]:
        term = need if scenario.need == "full" else drawn_incidence
        return folded(among, draws, lambda block: (lambda x: {"low": x, "high": x})(term(block)), {"low": "min", "high": "max"})

    def raw(block: Block) -> np.ndarray:
        s = scenario
        if s.need == "full":
            term = _between(need(block), told["low"], told["high"])
        elif s.need == "epidemiological":
            term = _between(drawn_incidence(block), told["low"], told["high"])
        else:
            term = block.get(s.need, np.zeros((len(block["unit"]), 1)))
        factor = block["population"] if s.base == "population" else 1.0
        if s.cost == "expected_cost":
            mu = np.maximum(block["cost"], 0.0)
            factor = factor * (counter.gamma(counter.at(seed, COST, block["unit"], d), 1 / cv**2) * (mu * cv**2))
        out = factor * (1 + s.eta * np.maximum(term, 0.0) ** s.alpha) * (1 - s.kappa * block["fiscal"])
        out = np.maximum(out - (block["local"] if s.less_local else 0.0) - s.phi * block["revenue"], s.floor)
        out = np.where(block["eligible"] > 0, out, 0.0) if s.eligible_only else out
        return np.broadcast_to(block["local"] if s.passthrough else out, (len(block["unit"]), draws))

    if scenario.need == "full" and own:
        middle = float(most) / 2

        def sums(block: Block) -> dict[str, np.ndarray]:
            v = drawn_incidence(block) - middle
            return {"s": v, "q": v * v} | ({"r": v * (block["rest"] - rest_mean)} if rest else {})

        got = folded(rows, draws, sums, {"s": "sum", "q": "sum"} | ({"r": "sum"} if rest else {}))
        square = np.maximum(got["q"] - got["s"] ** 2 / n, 0.0)
        told["mean"], sd = middle + got["s"] / n, np.sqrt(square / max(n - index.ddof, 1))
        told["over_sd"] = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1.0), 0.0)
        # the dimension's: of the mean of the drawn incidence's z-scores, which are about 0, and the other variables'
        told["own_mean"] = sign * np.full(draws, rest_mean) / m
        both = 2 * got["r"] / n * told["over_sd"] if rest else 0.0
        own_sd = np.sqrt(np.maximum(square / n * told["over_sd"] ** 2 + both + (rest_var if rest else 0.0), 0.0)) / m
        told["over_own_sd"] = np.where(own_sd > 0, 1 / np.where(own_sd > 0, own_sd, 1.0), 0.0)
    if scenario.need in ("full", "epidemiological"):
        ends = extremes(able() if scenario.need == "full" else rows)
        told["low"], told["high"] = ends["low"], ends["high"]
    if not scenario.normalise or scenario.passthrough:
        return spread(rows, draws, raw).withColumnRenamed("unit", unit)
    whole = folded(rows, draws, lambda block: {"s": raw(block)}, {"s": "sum"})["s"]
    if not (whole > 0).all():
        raise AllocationError("nothing to share by in some draws")
    return spread(rows, draws, lambda block: budget * raw(block) / whole).withColumnRenamed("unit", unit)


def sampled(spark: SparkSession, draws: int, seed: int, levels: dict[str, tuple[float, float, float]], ratios: list[str], strength: float = 40.0) -> DataFrame:
    """draw_id and each parameter: ratios are beta about their base, held within half their low and 1.2 times their high; others gamma with a variation that their low and high tell.

    levels: base, low, high. The n-th parameter's counters are units of their stream.
    """
    names = list(levels)

    def one(i: int, ids: np.ndarray) -> np.ndarray:
        base, low, high = levels[names[i]]
        if base <= 0:
            return np.full(len(ids), float(base))
        first = lambda shape, part: counter.gamma(counter.at(seed, PARAMETER, 2 * i + part, ids), shape)
        if names[i] in ratios:
            x, y = first(max(base * strength, 1e-3), 0), first(max((1 - base) * strength, 1e-3), 1)
            return np.clip(x / (x + y), low * 0.5, min(high * 1.2, 0.999))
        k = 1 / max((high - low) / (3.92 * base), 0.05) ** 2
        return first(k, 0) * base / k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(one(i, ids)) for i in range(len(names))]], names=["draw_id", *names])

    return spark.range(draws).withColumnRenamed("id", "draw_id").mapInArrow(run, T.StructType([T.StructField("draw_id", T.LongType()), *[T.StructField(x, T.DoubleType()) for x in names]]))


def dirichlet_weights(draws: int, seed: int, weights: list[float], concentration: float = 20.0) -> np.ndarray:
    """draws times dimensions: weights that sum to 1."""
    whole = sum(weights)
    g = np.stack([counter.gamma(counter.at(seed, WEIGHT, i, np.arange(draws)), max(w / whole * concentration, 1e-9)) for i, w in enumerate(weights)], axis=1)
    return g / g.sum(axis=1, keepdims=True)


def burden_multiplier(spark: SparkSession, draws: int, seed: int, sigma: float = 0.20) -> DataFrame:
    """draw_id, burden: lognormal about 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.exp(sigma * counter.normal(counter.at(seed, BURDEN, 0, batch.column(0).to_numpy()))))], names=["draw_id", "burden"])

    return spark.range(draws).withColumnRenamed("id", "draw_id").mapInArrow(run, "draw_id long, burden double")


def progressivity(df: DataFrame, draws: int, seed: int, weights: dict[str, float], burden: str, need: str = "need_score", concentration: float = 20.0, sigma: float = 0.35, unit: str = "district_id") -> DataFrame:
    """draw_id, worst_q_share, ci_need, eta: how a share by burden times need falls on the neediest fifth, and along need.

    In each draw the burden of each unit has lognormal noise, eta is uniform in 0.2 to 1, and need is the dimensions'
    scores (columns score_<name>, as z-scores) under drawn weights, from least to most. Units are ordered by their undrawn
    need, ties by id, once for all draws, in slices.
    """
    names = list(weights)
    z = needs.standardise(df.select(unit, need, burden, *[F.col(f"score_{x}").alias(f"z_{x}") for x in names]), [f"z_{x}" for x in names], ddof=1)
    placed = order.numbered(z.where(F.col(need).isNotNull()), [], [F.col(need), F.col(unit)], "pos")
    fifth = F.greatest(F.ceil((F.col("pos") - 1) * 5 / F.greatest(F.col("n") - 1, F.lit(1))), F.lit(1)) - 1
    rows = cut(placed.select(F.col(unit).cast("long").alias("unit"), F.coalesce(F.col(burden).cast("double"), F.lit(0.0)).alias("burden"), ((F.col("pos") - 0.5) / F.col("n") - 0.5).alias("off"), (fifth == 4).cast("double").alias("last"), *[F.coalesce(F.col(f"z_{x}"), F.lit(0.0)).alias(f"z{i}") for i, x in enumerate(names)]))
    rows, _ = dealt(rows, draws)
    d = np.arange(draws)
    w = dirichlet_weights(draws, seed, list(weights.values()), concentration)
    eta = 0.2 + 0.8 * counter.uniform(counter.at(seed, ETA, 0, d))

    def score(block: Block) -> np.ndarray:
        return sum(block[f"z{i}"] * w[:, i] for i in range(len(names)))

    ends = folded(rows, draws, lambda block: (lambda x: {"low": x, "high": x})(score(block)), {"low": "min", "high": "max"})

    def sums(block: Block) -> dict[str, np.ndarray]:
        term = _between(score(block), ends["low"], ends["high"])
        raw = np.maximum(block["burden"] * np.exp(sigma * counter.normal(counter.at(seed, NOISE, block["unit"], d))) * (1 + eta * term), 0.0)
        return {"s": raw, "last": raw * block["last"], "off": raw * block["off"]}

    got = folded(rows, draws, sums, {"s": "sum", "last": "sum", "off": "sum"})
    spark, there = df.sparkSession, got["s"] > 0
    out = [(int(i), float(got["last"][i] / got["s"][i]), float(2 * got["off"][i] / got["s"][i]), float(eta[i])) if there[i] else (int(i), None, None, float(eta[i])) for i in d]
    return spark.createDataFrame(out, "draw_id long, worst_q_share double, ci_need double, eta double")


def top_frequency(df: DataFrame, draws: int, seed: int, weights: dict[str, float], concentration: float = 20.0, part: float = 0.1, robust: float = 0.8, unit: str = "district_id") -> DataFrame:
    """unit, frequency among the top part under drawn weights, robust: at least so often.

    A draw's threshold is its k-th highest score, found over all units by histograms that are folded as the sums are and
    narrowed until each draw's bin is one value; ties at it go to the least ids, by a pass that counts them. Exactly k
    units of each draw are in.
    """
    names = list(weights)
    rows, n = dealt(cut(df.select(F.col(unit).cast("long").alias("unit"), *[F.coalesce(F.col(f"score_{x}").cast("double"), F.lit(0.0)).alias(f"z{i}") for i, x in enumerate(names)])), draws)
    k = max(1, int(n * part))
    w = dirichlet_weights(draws, seed, list(weights.values()), concentration)

    def bits(block: Block) -> np.ndarray:
        """Scores as whole numbers of the same order."""
        raw = (sum(block[f"z{i}"] * w[:, i] for i in range(len(names))) + 0.0).view(np.int64)
        return np.where(raw < 0, np.int64(-0x8000000000000000) - raw, raw)

    low, need, width, step = np.full(draws, -(1 << 63)), np.full(draws, k), 64, 8
    while width:
        width -= step
        counts = _histogram(rows, draws, bits, low >> width, width, step)
        upto = counts[:, ::-1].cumsum(axis=1)
        at = (upto >= need[:, None]).argmax(axis=1)  # bins from the top
        need = need - (upto - counts[:, ::-1])[np.arange(draws), at]
        low = low + (((1 << step) - 1 - at) << width)
    kth, left = low, need

    def above(block: Block) -> tuple[np.ndarray, np.ndarray]:
        x = bits(block)
        return x > kth, x == kth

    last = _least_ids(rows, draws, above, left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, draws):
            more, equal = above(block)
            hits = (more | (equal & (block["unit"] <= last))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(block["unit"][:, 0], pa.int64()), pa.array(hits, pa.int64())], names=["unit", "hits"])

    return rows.mapInArrow(run, "unit long, hits long").select(F.col("unit").alias(unit), (F.col("hits") / draws).alias("frequency"), (F.col("hits") / draws >= robust).alias("robust"))


def _histogram(rows: DataFrame, draws: int, bits: Callable[[Block], np.ndarray], base: np.ndarray, width: int, step: int) -> np.ndarray:
    """draws times 2^step: how many rows have each next `step` bits, of those that share the bits above."""
    bins = 1 << step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draws * bins, np.int64)
        for block in _blocks(batches, draws):
            at = (bits(block) >> width) - base
            inside = (at >= 0) & (at < bins)
            total += np.bincount((at + np.arange(draws) * bins)[inside], minlength=draws * bins)
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(total[here], pa.int64())], names=["at", "n"])

    out = np.zeros(draws * bins, np.int64)
    got = rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most draws * 2^step rows
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(draws, bins)


def _least_ids(rows: DataFrame, draws: int, above: Callable, left: np.ndarray) -> np.ndarray:
    """For each draw the id up to which the rows at the threshold are in: the left-th least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for block in _blocks(batches, draws):
            _, equal = above(block)
            for j in np.flatnonzero(equal.any(axis=0)).tolist():
                ids = np.concatenate([held.get(j, np.empty(0, np.int64)), block["unit"][equal[:, j], 0]])
                held[j] = np.sort(ids)[: left[j]]
        for j, ids in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(ids), pa.int64()), pa.array(ids, pa.int64())], names=["draw_id", "unit"])

    found = order.numbered(rows.mapInArrow(run, "draw_id long, unit long"), ["draw_id"], [F.col("unit")])
    wanted = rows.sparkSession.createDataFrame([(j, int(x)) for j, x in enumerate(left)], "draw_id long, number long")
    out = np.full(draws, -(1 << 63), np.int64)
    for r in found.join(wanted, ["draw_id", "number"]).select("draw_id", "unit").collect():  # a row for each draw
        out[r["draw_id"]] = r["unit"]
    return out


def replicated(df: DataFrame, value: str, by: str, group: list[str], reps: int, seed: int, unit: str = "district_id") -> DataFrame:
    """group, rep, n, s, c: sums over bootstrap replicates, from which order statistics are made.

    A replicate takes each row a Poisson(1) number of times. n counts the copies, s sums their value, and c sums value times
    (copies before + copies up to and with the row), in the order of `by`, ties by unit. Rows stand in slices of their
    order; a task folds its slice to arrays over the replicates, and what stands in the slices before is added by slice.
    """
    known = lambda c: nulls.known(F.col(c).cast("double"))
    source = df.where(known(value).isNotNull() & known(by).isNotNull()).select(*group, F.col(unit).cast("long").alias("__u"), known(value).alias("__y"), known(by).alias("__r"))
    keyed = order.sliced(source, group, [F.col("__r"), F.col("__u")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, at, held = np.arange(reps), None, None
        names = [*group, "__slice"]

        def told():
            out = [pa.array([x] * reps, schema.field(i).type) for i, x in enumerate(at)]
            return pa.RecordBatch.from_arrays([*out, pa.array(d, pa.int64()), *map(pa.array, held)], schema=schema)

        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(names))], strict=True))
            u, y = batch.column(len(names)).to_numpy(), batch.column(len(names) + 1).to_numpy()
            for i, key in enumerate(keys):
                if key != at:
                    if at is not None:
                        yield told()
                    at, held = key, [np.zeros(reps), np.zeros(reps), np.zeros(reps)]
                k = counter.poisson_1(counter.at(seed, REPLICATE, u[i], d))
                held[2] += k * y[i] * (2 * held[0] + k)
                held[0] += k
                held[1] += k * y[i]
        if at is not None:
            yield told()

    from pyspark.sql.pandas.types import to_arrow_schema

    made = T.StructType([*[keyed.schema[g] for g in group], keyed.schema["__slice"], T.StructField("rep", T.LongType()), *[T.StructField(x, T.DoubleType()) for x in "nsc"]])
    schema = to_arrow_schema(made)
    # a slice is a partition still; its rows are sorted where they are
    per_slice = cut(keyed.sortWithinPartitions(*group, "__slice", "__r", "__u").select(*group, "__slice", "__u", "__y").mapInArrow(run, made))
    from pyspark.sql import Window as W

    # a row for each slice: an order among slices of a group and replicate
    before = F.coalesce(F.sum("n").over(W.partitionBy(*group, "rep").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return per_slice.withColumn("c", F.col("c") + 2 * before * F.col("s")).groupBy(*group, "rep").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"))


def concentration() -> Column:
    """Of the sums of `replicated`: the Gini coefficient where the value is ordered by itself, else the concentration index along the order; NULL where nothing is to share."""
    return nulls.ratio(F.col("c"), F.col("n") * F.col("s")) - 1


def interval(sums: DataFrame, statistic: Column, group: list[str], alpha: float = 0.05) -> DataFrame:
    """group, low, high, n_used: percentiles of a statistic of the sums over the replicates in which it is finite."""
    x = nulls.known(statistic)
    values = sums.select(*group, F.when(F.abs(x) < float("inf"), x).alias("x")).where("x IS NOT NULL")
    return values.groupBy(*group).agg(F.percentile("x", alpha / 2).alias("low"), F.percentile("x", 1 - alpha / 2).alias("high"), F.count("*").alias("n_used"))  # as many values as replicates
