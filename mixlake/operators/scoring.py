"""Scores of encoded rows under a model that fits one task: numpy on Arrow batches, one pass whatever the number of features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass(frozen=True)
class Packed:
    """A model's numbers: log pi by cluster, by feature the table (category, cluster), and which categories it has."""

    prior: np.ndarray
    tables: tuple[np.ndarray, ...]
    known: tuple[np.ndarray, ...]

    def joint(self, codes: list[pa.Array]) -> np.ndarray:
        """(rows, clusters): log p(cluster, observed cells). Missing cells drop out; codes outside the domain are impossible."""
        total = np.tile(self.prior, (len(codes[0]), 1))
        for table, code in zip(self.tables, codes, strict=True):
            there = ~np.asarray(code.is_null())
            at = np.asarray(code.fill_null(-1)).astype(np.int64)
            inside = there & (at >= 0) & (at < len(table))
            total[inside] += table[at[inside]]
            total[there & ~inside] = -np.inf
        return total

    def posterior(self, codes: list[pa.Array]) -> np.ndarray:
        total = self.joint(codes)
        with np.errstate(invalid="ignore"):
            return total - lse(total)[:, None]

    def likeliest(self, codes: list[pa.Array]) -> list[pa.Array]:
        """By feature the likeliest category of each row that lacks it, ties to the lowest; null for the others."""
        weights = np.exp(self.posterior(codes))
        out = []
        for table, known, code in zip(self.tables, self.known, codes, strict=True):
            rows, best = np.flatnonzero(code.is_null()), np.zeros(len(code), np.int32)
            for k in range(0, len(rows), step := max(1, 1_000_000 // max(1, len(table)))):
                some = rows[k : k + step]
                p = np.round(weights[some] @ np.exp(table).T, 12)
                p[:, ~known] = -1
                best[some] = p.argmax(axis=1)
            out.append(pa.array(best, mask=~np.asarray(code.is_null())))
        return out

    def drawn(self, codes: list[pa.Array], u: np.ndarray, by_feature: list[np.ndarray]) -> list[pa.Array]:
        """By feature a category for each row that lacks it: a cluster of the posterior at u, then a category of the cluster at the feature's own number."""
        clusters = _at(np.exp(self.posterior(codes)), u)
        out = []
        for table, code, own in zip(self.tables, codes, by_feature, strict=True):
            rows, taken = np.flatnonzero(code.is_null()), np.zeros(len(code), np.int32)
            weights = np.exp(table).T
            for k in range(0, len(rows), step := max(1, 1_000_000 // max(1, len(table)))):
                some = rows[k : k + step]
                taken[some] = _at(weights[clusters[some]], own[some])
            out.append(pa.array(taken, mask=~np.asarray(code.is_null())))
        return out


def lse(x: np.ndarray) -> np.ndarray:
    """log-sum-exp of each row; minus infinity if all of it is."""
    top = x.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe[:, None]).sum(axis=1)) + safe


def _at(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The first place of each row at which the cumulative weights exceed u times their sum, the last if none does."""
    sums = np.cumsum(weights, axis=1)
    over = sums > (u * sums[:, -1])[:, None]
    return np.where(over.any(axis=1), over.argmax(axis=1), weights.shape[1] - 1)


def lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x, dtype=np.float64).ravel()))
