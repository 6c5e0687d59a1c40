"""Random numbers that depend on their keys only: the same in numpy, in any task, and in SQL.

A key is folded number by number through a 64-bit mixer, so a draw needs neither a generator's state nor an
order of rows. Gamma draws use Marsaglia and Tsang's method; tries are numbered, and the first that is accepted counts.
The SQL is for engines with 128-bit unsigned integers and lambdas on lists, and gives the same numbers.
"""

from __future__ import annotations

import numpy as np

#: The mixer's multipliers and the step between keys.
_FIRST, _SECOND, _STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
_ALL = 1 << 64
#: What draws are for; the third number of their keys, after seed and step.
ROW, WEIGHT, THETA, ANCESTOR, HYPER, BLOCK, LOGIT, ORDER = range(1, 9)
#: Numbers that one try of a gamma draw takes.
_EACH = 4


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_FIRST)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_SECOND)
        return x ^ (x >> np.uint64(31))


def fold(key: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """The keys with one more number; shapes broadcast."""
    more = np.uint64(part % _ALL) if isinstance(part, int) else np.asarray(part).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        return _mix(np.asarray(key, np.uint64) + more * np.uint64(_STEP))


def key(*parts: np.ndarray | int) -> np.ndarray:
    out = np.zeros((), np.uint64)
    for p in parts:
        out = fold(out, p)
    return out


def unit(k: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1)."""
    return ((k >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def normal(k: np.ndarray) -> np.ndarray:
    """Standard normal numbers, by Box and Muller's formula from the keys' numbers 0 and 1."""
    return np.sqrt(-2 * np.log(unit(fold(k, 0)))) * np.cos(2 * np.pi * unit(fold(k, 1)))


def gamma(k: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Gamma numbers with these shapes and scale 1; shapes below 1 are drawn for one more and taken down by a power of another uniform."""
    k, shape = np.broadcast_arrays(np.asarray(k, np.uint64), np.asarray(shape, float))
    small = shape < 1
    d = np.where(small, shape + 1, shape) - 1 / 3
    out, todo, t = np.empty(k.shape), np.ones(k.shape, bool), 0
    while todo.any():
        own, dd = k[todo], d[todo]
        x = np.sqrt(-2 * np.log(unit(fold(own, t * _EACH)))) * np.cos(2 * np.pi * unit(fold(own, t * _EACH + 1)))
        v = (1 + x / np.sqrt(9 * dd)) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            fine = (v > 0) & (np.log(unit(fold(own, t * _EACH + 2))) < x * x / 2 + dd - dd * v + dd * np.log(v))
        at = np.argwhere(todo)[fine]
        out[tuple(at.T)] = (dd * v)[fine]
        todo[tuple(at.T)] = False
        t += 1
    return np.where(small, out * unit(fold(k, -1)) ** (1 / np.where(small, shape, 1.0)), out)


def log_dirichlet(k: np.ndarray, alpha: np.ndarray, floor: float | None = 1e-10) -> np.ndarray:
    """Log of Dirichlet draws over the last axis, whose places are folded into the keys; `floor` keeps entries from vanishing."""
    g = np.maximum(gamma(fold(np.asarray(k, np.uint64)[..., None], np.arange(alpha.shape[-1])), alpha), 1e-300)
    p = g / g.sum(axis=-1, keepdims=True)
    return np.log(np.maximum(p, floor) if floor else p)


# ---- the same in SQL

def fold_sql(k: str, part: str | int) -> str:
    """SQL for the key k, a UBIGINT, with one more number, not negative."""
    wide = lambda x: f"CAST({x} AS UHUGEINT)"
    narrow = lambda x: f"CAST(({x}) % {wide(_ALL)} AS UBIGINT)"
    start = narrow(f"{wide(k)} + {wide(f'({part})')} * {wide(_STEP)}")
    one = f"list_transform([{start}], lambda v: {narrow(f'{wide("xor(v, v >> 30)")} * {wide(_FIRST)}')})"
    two = f"list_transform({one}, lambda v: {narrow(f'{wide("xor(v, v >> 27)")} * {wide(_SECOND)}')})"
    return f"list_transform({two}, lambda v: xor(v, v >> 31))[1]"


def key_sql(fixed: list[int], *parts: str | int) -> str:
    """SQL for the key of fixed numbers and then of columns."""
    out = f"CAST({int(key(*fixed))} AS UBIGINT)"
    for p in parts:
        out = fold_sql(out, p)
    return out


def unit_sql(k: str) -> str:
    return f"((CAST({k} >> 11 AS DOUBLE) + 0.5) / 9007199254740992.0)"


def gamma_sql(source: str, keep: str, shape: str = "a", tries: int = 24) -> str:
    """A query of `keep` columns and g, gamma draws for the rows of `source` with key column h and column `shape`."""
    u = lambda j: unit_sql(fold_sql("h", f"t * {_EACH} + {j}"))
    less = f"CASE WHEN {shape} < 1 THEN pow({unit_sql(fold_sql('h', _ALL - 1))}, 1 / {shape}) ELSE 1 END"
    x = f"sqrt(-2 * ln({u(0)})) * cos(2 * pi() * {u(1)})"
    drawn = f"SELECT *, CAST({shape} AS DOUBLE) + CASE WHEN {shape} < 1 THEN 1 ELSE 0 END - 1.0::DOUBLE / 3 AS d, {less} AS less, {x} AS x, ln({u(2)}) AS lu FROM {source}, (SELECT range AS t FROM range({tries}))"
    tried = f"SELECT *, (1 + x / sqrt(9 * d)) * (1 + x / sqrt(9 * d)) * (1 + x / sqrt(9 * d)) AS v FROM ({drawn})"
    return f"SELECT {keep}, arg_min(d * v * less, t) AS g FROM ({tried}) WHERE v > 0 AND lu < x * x / 2 + d - d * v + d * ln(CASE WHEN v > 0 THEN v ELSE 1 END) GROUP BY {keep}"
