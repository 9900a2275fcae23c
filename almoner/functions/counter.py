"""Random numbers from counters.

The number of a (seed, stream, unit, draw, k) is a hash of these five: it needs no generator's state, is the same however
rows are dealt and whatever task runs again, and SQL can tell it too. The hash chains SplitMix64, a published generator,
over the counters. Normals are by Box and Muller, gammas by Marsaglia and Tsang (attempt after attempt, each from counters
of its own), betas and Dirichlets from gammas.

`sql_...` give the same numbers as DuckDB expressions.
"""

from __future__ import annotations

from functools import lru_cache
from threading import get_ident

import numpy as np

# Of SplitMix64.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1
#: Attempts that SQL tells of a gamma; more are needed with a probability below 1e-8 at shapes of 1 and more.
ATTEMPTS = 6
#: Gammas that are attempted at a time.
PLACES = 1 << 14


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def _after(state: np.ndarray, counter: np.ndarray | int) -> np.ndarray:
    return _mixed(state + (np.asarray(counter).astype(np.int64).astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN))


def key(seed: int, stream: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _after(_after(np.uint64(0), seed), stream)


def uniform(state: np.ndarray, k: int = 0) -> np.ndarray:
    """In (0, 1), of 53 bits. state: of `at`."""
    with np.errstate(over="ignore"):
        return ((_after(state, k) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def at(seed: int, stream: int, unit: np.ndarray | int, draw: np.ndarray | int) -> np.ndarray:
    """The states of units and draws, which are broadcast against each other."""
    with np.errstate(over="ignore"):
        first = _after(key(seed, stream), unit)
        z = np.add(first, (np.asarray(draw).astype(np.int64).astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN))
        if not np.ndim(z):
            return _mixed(z)
        t = np.empty_like(z)
        for shift, factor in ((30, MIX_1), (27, MIX_2)):
            np.bitwise_xor(z, np.right_shift(z, np.uint64(shift), out=t), out=z)
            np.multiply(z, np.uint64(factor), out=z)
        return np.bitwise_xor(z, np.right_shift(z, np.uint64(31), out=t), out=z)


def normal(state: np.ndarray, k: int = 0) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniform(state, k))) * np.cos(2 * np.pi * uniform(state, k + 1))


def poisson_1(state: np.ndarray) -> np.ndarray:
    """Counts of mean 1, by the places of their distribution that a uniform passes."""
    return np.searchsorted(POISSON, uniform(state), side="left")


#: P(count <= i) of mean 1, as far as doubles tell it from 1.
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 18)]))


def _uniform_in(state: np.ndarray, k: int, z: np.ndarray, t: np.ndarray, out: np.ndarray) -> np.ndarray:
    """uniform, with arrays of the state's shape to work in: z and t of whole numbers, out of doubles."""
    np.add(state, np.uint64(((k + 1) * GOLDEN) & MASK), out=z)
    for shift, factor in ((30, MIX_1), (27, MIX_2)):
        np.right_shift(z, np.uint64(shift), out=t)
        np.bitwise_xor(z, t, out=z)
        np.multiply(z, np.uint64(factor), out=z)
    np.right_shift(z, np.uint64(31), out=t)
    np.bitwise_xor(z, t, out=z)
    np.right_shift(z, np.uint64(11), out=z)
    np.copyto(out, z.view(np.int64))  # below 2^53
    np.multiply(out, 2.0**-53, out=out)
    return np.add(out, 2.0**-54, out=out)


@lru_cache(maxsize=8)
def _scratch(shape: tuple[int, ...], thread: int) -> tuple[np.ndarray, ...]:
    """Two arrays of whole numbers and three of doubles that a thread works in; blocks are mostly of one shape, and fresh memory costs more than the numbers."""
    return (*(np.empty(shape, np.uint64) for _ in range(2)), *(np.empty(shape) for _ in range(3)))


def _attempted(state: np.ndarray, d: np.ndarray, c: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first attempt of all places, into out; which places are left to be looked at (flat), and their normals, cubes and uniforms."""
    t1, t2, z, v, u = _scratch(state.shape, get_ident())
    np.log(_uniform_in(state, 0, t1, t2, z), out=z)
    np.multiply(z, -2.0, out=z)
    np.sqrt(z, out=z)
    np.multiply(_uniform_in(state, 1, t1, t2, v), 2 * np.pi, out=v)
    np.multiply(z, np.cos(v, out=v), out=z)
    _uniform_in(state, 2, t1, t2, u)
    np.multiply(z, c, out=out)
    np.add(out, 1.0, out=out)
    np.multiply(out, out, out=v)
    np.multiply(v, out, out=v)  # (1 + c z)^3
    squeeze = np.multiply(z, z, out=t1.view(np.float64))
    np.multiply(squeeze, squeeze, out=squeeze)
    np.multiply(squeeze, -0.0331, out=squeeze)
    np.add(squeeze, 1.0, out=squeeze)
    np.multiply(v, d, out=out)
    # where u is below this, Marsaglia and Tsang accept without logarithms
    left = np.flatnonzero(~((u < squeeze) & (v > 0)))
    return left, z.ravel()[left], v.ravel()[left], u.ravel()[left]


def _gamma(state: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Of shape 1 and more. The first attempt is made of PLACES at a time, in arrays that stay in a core's cache; what it leaves open goes on together."""
    shape = np.asarray(shape, np.float64)
    whole = np.broadcast_shapes(state.shape, shape.shape)
    if not whole:
        return _gamma(np.reshape(state, 1), shape)[0]
    state, out = np.broadcast_to(state, whole), np.empty(whole)
    if not out.size:
        return out
    d, c = np.broadcast_to(shape - 1 / 3, whole), np.broadcast_to(1 / np.sqrt(9 * (shape - 1 / 3)), whole)
    row = out.size // len(out)
    step = max(1, PLACES // row)
    with np.errstate(over="ignore"):
        parts = [_attempted(state[i : i + step], d[i : i + step], c[i : i + step], out[i : i + step]) for i in range(0, len(out), step)]
    left = np.concatenate([x[0] + i * step * row for i, x in enumerate(parts)])
    z, v, u = (np.concatenate([x[j] for x in parts]) for j in (1, 2, 3))
    at_ = np.unravel_index(left, whole)
    flat, state, d, c, k = out.reshape(-1), state[at_], d[at_], c[at_], 0
    while len(left):
        good = v > 0
        good[good] = np.log(u[good]) < z[good] ** 2 / 2 + d[good] * (1 - v[good] + np.log(v[good]))
        flat[left[good]] = (d * v)[good]
        open_, k = ~good, k + 3
        left, state, d, c = left[open_], state[open_], d[open_], c[open_]
        z, u = normal(state, k), uniform(state, k + 2)
        v = (1 + c * z) ** 3
    return out


def gamma(state: np.ndarray, shape: np.ndarray | float) -> np.ndarray:
    """Shapes below 1 are those one higher times a power of a uniform of a counter that attempts don't use (-2)."""
    shape = np.asarray(shape, np.float64)
    low = shape < 1
    if not low.any():
        return _gamma(state, shape)
    out = _gamma(state, np.where(low, shape + 1, shape))
    if np.ndim(out) == 2 and low.shape == (len(out), 1):  # a shape for each row
        at = np.flatnonzero(low[:, 0])
        there = np.broadcast_to(state, out.shape)[at]
        t1, t2, _, _, u = _scratch(there.shape, get_ident())
        with np.errstate(over="ignore", under="ignore"):
            np.log(_uniform_in(there, -2, t1, t2, u), out=u)
            np.divide(u, shape[at], out=u)
            out[at] *= np.exp(u, out=u)
        return out
    return np.where(low, out * uniform(state, -2) ** (1 / shape), out)


def _sql_after(out: str, state: str, counter: str | int) -> list[str]:
    """Columns up to `out`, the state after a counter; each may use those before it."""
    add = f"{((counter + 1) * GOLDEN) & MASK}::UHUGEINT" if isinstance(counter, int) else f"(CAST({counter} + 1 AS UHUGEINT) * {GOLDEN}::UHUGEINT)"
    whole = f"{MASK}::UHUGEINT"
    return [f"({state} + {add}) & {whole} AS {out}_a", f"(xor({out}_a, {out}_a >> 30) * {MIX_1}::UHUGEINT) & {whole} AS {out}_b", f"(xor({out}_b, {out}_b >> 27) * {MIX_2}::UHUGEINT) & {whole} AS {out}_c", f"xor({out}_c, {out}_c >> 31) AS {out}"]


def sql_at(out: str, seed: int, stream: int, unit: str, draw: str) -> list[str]:
    return [*_sql_after(f"{out}_u", f"{int(key(seed, stream))}::UHUGEINT", unit), *_sql_after(out, f"{out}_u", draw)]


def sql_uniform(out: str, state: str, k: int = 0) -> list[str]:
    return [*_sql_after(f"{out}_s", state, k), f"(CAST({out}_s >> 11 AS DOUBLE) + 0.5) * {2.0**-53!r}::DOUBLE AS {out}"]


def sql_normal(out: str, state: str, k: int = 0) -> list[str]:
    return [*sql_uniform(f"{out}_1", state, k), *sql_uniform(f"{out}_2", state, k + 1), f"sqrt(-2 * ln({out}_1)) * cos(2 * pi() * {out}_2) AS {out}"]


def sql_poisson_1(uniform_: str) -> str:
    return "(" + " + ".join(f"({uniform_} > {float(p)!r}::DOUBLE)::INT" for p in POISSON) + ")"


def sql_with(source: str, columns: list[str]) -> str:
    """source with columns, each of which may use those before it: one step a level, as an alias is written out wherever it is used."""
    for c in columns:
        source = f"(SELECT *, {c} FROM {source})"
    return source


def sql_gammas(out: str, source: str, keys: list[str]) -> str:
    """Tables up to `out` (keys, value): a gamma for each row of source (keys, state, shape)."""
    k = ", ".join(keys)
    tables = [f"{out}_0 AS MATERIALIZED (SELECT {k}, state, shape, CASE WHEN shape < 1 THEN shape + 1 ELSE shape END - 1 / 3.0::DOUBLE AS d, NULL::DOUBLE AS value FROM {source})"]
    for i in range(ATTEMPTS):
        made = [*sql_normal("z", "state", 3 * i), *sql_uniform("u", "state", 3 * i + 2), "pow(1 + z / sqrt(9 * d), 3) AS v", "CASE WHEN v > 0 AND ln(u) < z * z / 2 + d * (1 - v + ln(CASE WHEN v > 0 THEN v ELSE 1 END)) THEN d * v END AS value"]
        tables.append(f"{out}_{i + 1} AS MATERIALIZED (SELECT {k}, state, shape, d, value FROM {sql_with(f'(SELECT * EXCLUDE (value) FROM {out}_{i} WHERE value IS NULL)', made)})")
    whole = " UNION ALL ".join(f"SELECT * FROM {out}_{i + 1} WHERE value IS NOT NULL" for i in range(ATTEMPTS))
    tables.append(f"{out} AS (SELECT {k}, CASE WHEN shape < 1 THEN value * pow(u, 1 / shape) ELSE value END AS value FROM {sql_with(f'({whole})', sql_uniform('u', 'state', -2))})")
    return ", ".join(tables)
