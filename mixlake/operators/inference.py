"""Fitting mixtures: block-Gibbs moves over mini-batches, sequential Monte Carlo, MCMC, gradient descent.

Rows stay in Spark: each move scores its batch for all particles at once in the tasks (numpy over Arrow
batches), writes the drawn clusters, and returns only counts by (particle, cluster, feature, category).
Parameters, whose size is particles x clusters x categories and never the rows', live on the driver.
Draws depend on (seed, step, particle, row_id), so results don't depend on partitioning.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlake.functions import draws
from mixlake.functions.exprs import uniform

#: Steps' files of one size that are merged into one of the next size.
FAN = 4


@dataclass
class Particles:
    """log pi [P, C], log theta by feature [P, C, K_d], counts of rows [P, C] and cells by feature, log weights and targets [P]."""

    pi: np.ndarray
    theta: list[np.ndarray]
    rows: np.ndarray
    phi: list[np.ndarray]
    log_w: np.ndarray
    gamma: np.ndarray
    alpha_pi: np.ndarray
    alpha_theta: np.ndarray
    history: list[dict] = field(default_factory=list)

    @property
    def n(self) -> int:
        return len(self.log_w)


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def dirichlet_score(alpha: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log density over the last axis at log probabilities x."""
    alpha = np.broadcast_to(alpha, x.shape)
    return ((alpha - 1) * x).sum(-1) - _lgamma(alpha).astype(float).sum(-1) + _lgamma(alpha.sum(-1)).astype(float)


def parameter_draws(alpha_pi: np.ndarray, alpha_theta: list[np.ndarray], particles: np.ndarray, seed: int, step: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """log pi [P, C] and log theta by feature [P, C, K_d], drawn by (seed, step, particle, feature, cluster, category)."""
    own = draws.fold(draws.key(seed, step, draws.WEIGHT), particles)
    pi = draws.log_dirichlet(own, alpha_pi, None)
    own, theta = draws.fold(draws.key(seed, step, draws.THETA), particles), []
    for i, a in enumerate(alpha_theta):
        theta.append(draws.log_dirichlet(draws.fold(draws.fold(own, i)[:, None], np.arange(a.shape[1])), a))
    return pi, theta


def init_particles(sizes: list[int], n_particles: int, n_clusters: int, seed: int, alpha_pi: float = 1.0, alpha_theta: float = 1.0) -> Particles:
    """No rows assigned; parameters from their priors, as drawn before step 0."""
    shapes = [np.full((n_particles, n_clusters, k), alpha_theta) for k in sizes]
    pi, theta = parameter_draws(np.full((n_particles, n_clusters), alpha_pi), shapes, np.arange(n_particles), seed, -1)
    zero = np.zeros((n_particles, n_clusters))
    return Particles(pi, theta, zero.copy(), [np.zeros_like(t) for t in theta], np.zeros(n_particles), np.zeros(n_particles), np.full(n_particles, alpha_pi), np.full(n_particles, alpha_theta))


def row_uniforms(row_id: np.ndarray, particles: np.ndarray, seed: int, step: int) -> np.ndarray:
    """[rows, particles] uniforms that depend on their keys only."""
    return draws.unit(draws.fold(draws.fold(draws.key(seed, step, draws.ROW), row_id)[:, None], particles))


def joint(codes: list[np.ndarray], pi: np.ndarray, theta: list[np.ndarray]) -> np.ndarray:
    """[rows, P, C] log joint; codes outside a feature's range (missing ones are -1) add nothing."""
    out = np.repeat(pi[None], len(codes[0]), axis=0)
    for x, t in zip(codes, theta, strict=True):
        ok = (x >= 0) & (x < t.shape[-1])
        out[ok] += np.moveaxis(t[:, :, x[ok]], -1, 0)
    return out


def drawn_clusters(codes: list[np.ndarray], row_id: np.ndarray, pi: np.ndarray, theta: list[np.ndarray], particles: np.ndarray, seed: int, step: int, q_mode: str = "normalized") -> tuple[np.ndarray, np.ndarray]:
    """Clusters and their log probabilities [rows, P] of some rows under some particles."""
    j = joint(codes, pi, theta)
    lse = _lse(j)
    cum = np.exp(j - lse[:, :, None]).cumsum(-1)
    a = np.minimum((cum <= row_uniforms(row_id, particles, seed, step)[:, :, None]).sum(-1), pi.shape[1] - 1)
    return a, np.take_along_axis(j, a[:, :, None], -1)[:, :, 0] - (lse if q_mode == "normalized" else 0)


def cells(codes: list[np.ndarray], a: np.ndarray, n_clusters: int, sizes: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows [P, C] and cells by feature [P, C, K_d] of rows' clusters a [rows, P]; a cluster of -1 counts nowhere."""
    n = a.shape[1]
    at = np.arange(n)[None] * n_clusters + a
    there = a >= 0
    rows = np.bincount(at[there], minlength=n * n_clusters).reshape(n, n_clusters)
    phi = []
    for x, k in zip(codes, sizes, strict=True):
        fine = there & ((x >= 0) & (x < k))[:, None]
        phi.append(np.bincount((at * k + x[:, None])[fine], minlength=n * n_clusters * k).reshape(n, n_clusters, k))
    return rows, phi


def _codes(batch: pa.RecordBatch, first: int, n: int) -> list[np.ndarray]:
    return [batch.column(first + i).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n)]


def _lse(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _lists(x: np.ndarray) -> pa.ListArray:
    """A list for each row of x."""
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def draw_clusters(batch: DataFrame, features: list[str], p: Particles, seed: int, step: int, path: str, q_mode: str = "normalized") -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Draws the clusters of the batch's rows in all particles; writes (row_id, codes, clusters) to path and returns added rows, cells and the proposal's log probability."""
    pi, theta, n, sizes = p.pi, p.theta, p.n, [t.shape[-1] for t in p.theta]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                a, q = drawn_clusters(_codes(part, 1, len(sizes)), part.column(0).to_numpy(), pi, theta, np.arange(n), seed, step, q_mode)
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(1 + i) for i in range(len(sizes))), _lists(a.astype(np.int32)), _lists(q)], names=["row_id", *features, "a", "q"])

    schema = ", ".join(["row_id long", *(f"`{f}` int" for f in features), "a array<int>", "q array<double>"])
    batch.select(F.col("row_id").cast("long"), *(F.col(f).cast("int") for f in features)).mapInArrow(run, schema).write.mode("overwrite").parquet(path)
    drawn = batch.sparkSession.read.parquet(path)
    return (*counts(drawn, features, n, pi.shape[1], sizes), _summed(drawn, n))


#: Rows times particles that are counted at a time, about.
COUNTED = 1_000_000


def counts(drawn: DataFrame, features: list[str], n: int, c: int, sizes: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows [P, C] and cells by feature [P, C, K_d] of drawn rows: tasks count all features in numpy, and send one number for each cell that they have seen."""
    shapes = [(n, c), *((n, c, k) for k in sizes)]
    ends = np.cumsum([0, *(math.prod(s) for s in shapes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ends[-1], np.int64)
        for b in batches:
            for k in range(0, b.num_rows, step := max(1, COUNTED // n)):
                part = b.slice(k, step)
                a = np.asarray(part.column(0).flatten().fill_null(-1)).reshape(part.num_rows, -1)[:, :n].astype(np.int64)
                rows, phi = cells(_codes(part, 1, len(sizes)), a, c, sizes)
                total += np.concatenate([rows.ravel(), *(f.ravel() for f in phi)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    own = drawn.select("a", *(F.col(f).cast("int") for f in features)).mapInArrow(run, "cell long, n long")
    got = own.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(ends[-1])
    total[np.asarray(got.column("cell"))] = np.asarray(got.column("n"))
    rows, *phi = (total[i:j].reshape(s) for i, j, s in zip(ends, ends[1:], shapes, strict=False))
    return rows, phi


def _summed(drawn: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n)
    for r in drawn.select(F.posexplode("q").alias("p", "q")).groupBy("p").agg(F.sum("q").alias("q")).collect():
        out[r.p] = r.q
    return out


def redraw_parameters(p: Particles, seed: int, step: int, count_mode: str = "rows", particles: np.ndarray | None = None) -> np.ndarray:
    """pi and theta from their posteriors given the counts; returns their proposal log density by particle. count_mode "cells" counts cells in place of rows for pi. particles: their numbers, from 0 by default."""
    m = p.rows if count_mode == "rows" else sum(f.sum(-1) for f in p.phi)
    a, b = p.alpha_pi[:, None] + m, [p.alpha_theta[:, None, None] + f for f in p.phi]
    p.pi, p.theta = parameter_draws(a, b, np.arange(p.n) if particles is None else particles, seed, step)
    q = dirichlet_score(a, p.pi)
    for shape, t in zip(b, p.theta, strict=True):
        q += dirichlet_score(shape, t).sum(-1)
    return q


def log_target(p: Particles) -> np.ndarray:
    """Log joint of parameters and assigned rows, by particle."""
    out = dirichlet_score(np.broadcast_to(p.alpha_pi[:, None], p.pi.shape), p.pi) + (p.rows * p.pi).sum(-1)
    for t, f in zip(p.theta, p.phi, strict=True):
        out += dirichlet_score(np.broadcast_to(p.alpha_theta[:, None, None], t.shape), t).sum(-1) + np.where(f > 0, f * t, 0).sum((-1, -2))
    return out


def hyperparameters(p: Particles, grid_pi: list[float], grid_theta: list[float], seed: int, step: int, particles: np.ndarray | None = None) -> None:
    """Draws each particle's concentrations from their grids' posteriors."""
    own = np.arange(p.n) if particles is None else particles
    for which, (grid, name, blocks) in enumerate(((grid_pi, "alpha_pi", [p.pi[:, None, :]]), (grid_theta, "alpha_theta", p.theta))):
        score = np.stack([sum(dirichlet_score(np.full(b.shape, a), b).sum(-1) for b in blocks) for a in grid], axis=-1)
        w = np.exp(score - _lse(score)[:, None]).cumsum(-1)
        u = draws.unit(draws.fold(draws.key(seed, step, draws.HYPER, which), own))
        setattr(p, name, np.array(grid)[np.minimum((w <= u[:, None]).sum(-1), len(grid) - 1)])


def weights(log_w: np.ndarray) -> np.ndarray:
    return np.exp(log_w - _lse(log_w))


def effective_size(log_w: np.ndarray) -> float:
    return float(1 / (weights(log_w) ** 2).sum())


def resampled(p: Particles, seed: int, step: int) -> np.ndarray:
    """Multinomial ancestors; all state follows them and the weights become equal."""
    u = draws.unit(draws.fold(draws.key(seed, step, draws.ANCESTOR), np.arange(p.n)))
    up = np.minimum(np.searchsorted(weights(p.log_w).cumsum(), u, side="right"), p.n - 1)
    p.pi, p.theta, p.rows, p.phi = p.pi[up], [t[up] for t in p.theta], p.rows[up], [f[up] for f in p.phi]
    p.gamma, p.alpha_pi, p.alpha_theta = p.gamma[up], p.alpha_pi[up], p.alpha_theta[up]
    p.log_w = np.full(p.n, -math.log(p.n))
    return up


_STATE = "name string, i int, shape array<int>, numbers array<double>, text string"


def saved_steps(rows: DataFrame, path: str) -> list[int]:
    """The moves after which Fit.save() wrote whole states to path, in order."""
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = spark.read.schema(f"{_STATE}, step int").parquet(path).where("name = 'fit'").select("step").distinct()
    return sorted(r.step for r in found.collect())


class Fit:
    """A fit over encoded rows (row_id dense from 0, features as codes): its particles, and the clusters of the rows seen so far.

    A batch's clusters are Parquet files of their own; resampling adds an ancestor map in place of rewriting
    them, and the maps are applied when a batch is read. FAN batches of one size become one of the next, so a
    move reads a number of tables that grows with the logarithm of the steps. keep: history holds parameters too.
    """

    def __init__(self, rows: DataFrame, features: list[str], sizes: list[int], folder: str, n_particles: int = 1, n_clusters: int = 2, seed: int = 0, alpha_pi: float = 1.0, alpha_theta: float = 1.0, count_mode: str = "rows", q_mode: str = "normalized", grids: tuple[list[float], list[float]] | None = None, keep: bool = False):
        self.rows, self.features, self.sizes, self.seed = rows, features, sizes, seed
        self.folder, self.count_mode, self.q_mode, self.grids, self.keep = f"{folder}/{uuid.uuid4().hex}", count_mode, q_mode, grids, keep
        self.p = init_particles(sizes, n_particles, n_clusters, seed, alpha_pi, alpha_theta)
        self.written: list[tuple[str, int, int]] = []  # path, maps that were there before it, merges that it went through
        self.maps: list[np.ndarray] = []
        self.step = self.taken = 0  # moves, and those of them that were steps of sequential Monte Carlo

    def save(self, path: str, mark: int = -1) -> None:
        """Writes the fit but for its rows as path/step=N, one small Parquet file; clusters stay in the files that the steps wrote. mark: a number to find again."""
        p = self.p
        arrays = {"pi": [p.pi], "theta": p.theta, "rows": [p.rows], "phi": p.phi, "log_w": [p.log_w], "gamma": [p.gamma], "alpha_pi": [p.alpha_pi], "alpha_theta": [p.alpha_theta], "maps": self.maps}
        for h in p.history:
            for name, x in h.items():
                arrays.setdefault(f"history.{name}", []).extend(x if isinstance(x, list) else [np.asarray(x)])
        out = [(name, i, list(x.shape), [float(v) for v in x.ravel()], None) for name, parts in arrays.items() for i, x in enumerate(parts)]
        own = {k: getattr(self, k) for k in ("features", "sizes", "seed", "folder", "count_mode", "q_mode", "grids", "keep", "written", "step", "taken")}
        out.append(("fit", 0, [], [], json.dumps({**own, "mark": mark})))
        frame = self.rows.sparkSession.createDataFrame(out, _STATE)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/step={self.step:08d}")

    @classmethod
    def resume(cls, rows: DataFrame, path: str, step: int | None = None) -> tuple[Fit, int] | None:
        """The fit that save() wrote after `step` moves, or last, with its mark; None where nothing was saved. It goes on as if it had never stopped."""
        steps = saved_steps(rows, path)
        if not steps or (step is not None and step not in steps):
            return None
        parts: dict[str, list] = {}
        for r in rows.sparkSession.read.schema(_STATE).parquet(f"{path}/step={steps[-1] if step is None else step:08d}").orderBy("name", "i").collect():
            parts.setdefault(r.name, []).append(r.text or np.array(r.numbers).reshape(r.shape))
        own = json.loads(parts["fit"][0])
        fit = cls.__new__(cls)
        fit.rows, mark = rows, own.pop("mark")
        for k, v in own.items():
            setattr(fit, k, v)
        fit.written, fit.maps = [tuple(w) for w in fit.written], [m.astype(int) for m in parts.get("maps", [])]
        fit.p = Particles(parts["pi"][0], parts["theta"], parts["rows"][0], parts["phi"], *(parts[k][0] for k in ("log_w", "gamma", "alpha_pi", "alpha_theta")))
        d = len(fit.sizes)
        for i, at in enumerate(parts.get("history.step", [])):
            one = {k: parts[f"history.{k}"][i] for k in ("log_w", "gamma", "pi") if f"history.{k}" in parts}
            if "history.theta" in parts:
                one["theta"] = parts["history.theta"][i * d : (i + 1) * d]
            fit.p.history.append({"step": int(at), **({"ess": float(parts["history.ess"][i])} if "history.ess" in parts else {}), **one})
        return fit, mark

    def _read(self, entries: list[tuple[str, int, int]]) -> DataFrame:
        """(row_id, features, a) of consecutive entries of `written`, for the present particles; of a row drawn again, the last."""
        out = None
        for i, (path, before, _) in enumerate(entries):
            up = np.arange(self.p.n)
            for m in reversed(self.maps[before:]):
                up = m[up]
            # ancestors are composed from the newest map back, so up[p] is the particle of that time
            part = self.rows.sparkSession.read.parquet(path).select("row_id", *self.features, F.transform(F.array(*(F.lit(int(x)) for x in up)), lambda x: F.get("a", x)).alias("a"), F.lit(i).alias("_age"))
            out = part if out is None else out.unionByName(part)
        if len(entries) == 1:
            return out.drop("_age")
        return out.groupBy("row_id").agg(F.max_by(F.struct(*self.features, "a"), "_age").alias("x")).select("row_id", "x.*")

    def assigned(self) -> DataFrame | None:
        """(row_id, features, a): the current clusters of all rows seen; of a row drawn again, the last."""
        return self._read(self.written) if self.written else None

    def _add(self, path: str) -> None:
        """Takes up a step's file, and merges the last FAN of one size. Merged files stay, as saved states may name them."""
        self.written.append((path, len(self.maps), 0))
        while len(last := self.written[-FAN:]) == FAN and len({level for *_, level in last}) == 1:
            level = last[0][2] + 1
            merged = f"{path}-merged-{level}"
            self._read(last).write.mode("overwrite").parquet(merged)
            self.written[-FAN:] = [(merged, len(self.maps), level)]

    def _unassign(self, batch: DataFrame) -> None:
        now = self.assigned()
        if now is None:
            return
        old = now.join(batch.select("row_id"), "row_id", "left_semi")
        rows, phi = counts(old, self.features, self.p.n, self.p.pi.shape[1], self.sizes)
        self.p.rows -= rows
        self.p.phi = [a - b for a, b in zip(self.p.phi, phi, strict=True)]

    def gibbs(self, batch: DataFrame, seen: bool) -> np.ndarray:
        """One move: unassign the batch if it was seen, draw its clusters, then the parameters. Returns the proposal's log probability."""
        if seen:
            self._unassign(batch)
        path = f"{self.folder}/step-{self.step:06d}"
        rows, phi, q = draw_clusters(batch, self.features, self.p, self.seed, self.step, path, self.q_mode)
        self._add(path)
        self.p.rows += rows
        self.p.phi = [a + b for a, b in zip(self.p.phi, phi, strict=True)]
        q += redraw_parameters(self.p, self.seed, self.step, self.count_mode)
        if self.grids:
            hyperparameters(self.p, *self.grids, self.seed, self.step)
        self.step += 1
        return q

    def assign_from_prior(self) -> np.ndarray:
        """The start that looks at no cell: every row's cluster is drawn from pi alone, then the parameters given all rows."""
        self.p.theta = [np.zeros_like(t) for t in self.p.theta]
        return self.gibbs(self.rows, False)

    def smc_step(self, batch: DataFrame, seen: bool = False) -> None:
        """A move, the weight update, and resampling when fewer than half of the particles count."""
        q = self.gibbs(batch, seen)
        gamma = log_target(self.p)
        self.p.log_w = self.p.log_w + gamma - self.p.gamma - q
        self.p.gamma = gamma
        ess = effective_size(self.p.log_w)
        self.p.history.append({"step": self.step - 1, "ess": ess, "log_w": self.p.log_w.copy(), "gamma": gamma, **self._kept()})
        self.taken += 1
        if ess < self.p.n / 2 and self.p.n > 1:
            self.maps.append(resampled(self.p, self.seed, self.step))

    def _kept(self) -> dict:
        return {"pi": self.p.pi.copy(), "theta": [t.copy() for t in self.p.theta]} if self.keep else {}

    def batch(self, begin: int, end: int | None) -> DataFrame:
        rows = self.rows.where(F.col("row_id") >= begin)
        return rows if end is None else rows.where(F.col("row_id") < end)

    def random_batch(self, size: int, n_rows: int) -> DataFrame:
        """About `size` rows, chosen by a number of (seed, step, row_id): no sort of the table."""
        return self.rows.where(uniform(self.seed, "batch", self.step, F.col("row_id")) < size / n_rows)


def smc(fit: Fit, n_rows: int, batch_size: int, steps: int, rejuvenation: int = 0) -> Fit:
    """Contiguous batches, each seen once, the last to the end of the rows; after each, `rejuvenation` moves of rows already seen or not, which leave weights alone."""
    if n_rows <= batch_size * (steps - 1):
        raise ValueError("not enough rows for the steps")
    for t in range(steps):
        fit.smc_step(fit.batch(t * batch_size, (t + 1) * batch_size if t < steps - 1 else None), rejuvenation > 0)  # such a move may have reached them before
        for _ in range(rejuvenation):
            fit.gibbs(fit.random_batch(batch_size, n_rows), True)
            fit.p.gamma = log_target(fit.p)
    return fit


def mcmc(fit: Fit, n_rows: int, batch_size: int, steps: int) -> Fit:
    """All rows are assigned once, then random batches move."""
    fit.gibbs(fit.rows, False)
    for _ in range(steps):
        fit.gibbs(fit.random_batch(batch_size, n_rows), True)
        fit.p.gamma = log_target(fit.p)
        fit.p.history.append({"step": fit.step - 1, "gamma": fit.p.gamma.copy(), **fit._kept()})
    return fit


def train(fit: Fit, n_rows: int, batch_size: int, path: str, steps: int | None = None, save_every: int = 10, rejuvenation: int = 0) -> Fit:
    """Steps over consecutive batches that begin again at the first row after the last, n_rows // batch_size by default.

    The fit is saved to `path` before the first step, after every save_every steps and at the end. One that Fit.resume()
    gives goes on after the steps it has taken, with the same result as without a stop.
    """
    steps = n_rows // batch_size if steps is None else steps
    if not 0 < batch_size <= n_rows:
        raise ValueError("a batch holds 1 to n_rows rows")
    if not fit.taken:
        fit.save(path)
    while fit.taken < steps:
        begin = fit.taken * batch_size % n_rows
        place, over = F.col("row_id"), begin + batch_size - n_rows
        inside = (place >= begin) & (place < begin + batch_size)
        seen = rejuvenation > 0 or (fit.taken + 1) * batch_size > n_rows
        fit.smc_step(fit.rows.where(inside | (place < over) if over > 0 else inside), seen)
        for _ in range(rejuvenation):
            fit.gibbs(fit.random_batch(batch_size, n_rows), True)
            fit.p.gamma = log_target(fit.p)
        if fit.taken % save_every == 0 or fit.taken == steps:
            fit.save(path)
    return fit


def log_likelihood(rows: DataFrame, features: list[str], pi: np.ndarray, theta: list[np.ndarray]) -> np.ndarray:
    """Dataset log-likelihood by particle, one row of sums per task to the driver's total."""
    n = len(pi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for b in batches:
            if b.num_rows:
                total += _lse(joint(_codes(b, 0, len(features)), pi, theta)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(total)], names=["p", "ll"])

    out = rows.select(*(F.col(f).cast("int") for f in features)).mapInArrow(run, "p int, ll double").groupBy("p").agg(F.sum("ll").alias("ll"))
    return np.array([r.ll for r in out.orderBy("p").collect()])


def gradient(rows: DataFrame, features: list[str], pi_logits: np.ndarray, theta_logits: list[np.ndarray]) -> tuple[float, np.ndarray, list[np.ndarray]]:
    """Negative log-likelihood of the rows and its gradient in the logits, from summed responsibilities."""
    pi, theta = _log_softmax(pi_logits), [_log_softmax(t) for t in theta_logits]
    c, sizes = len(pi), [t.shape[-1] for t in theta]
    size = 2 + c + 0 + sum(c * k for k in sizes) + c * len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size)
        for b in batches:
            if not b.num_rows:
                continue
            codes = _codes(b, 0, len(features))
            j = joint(codes, pi[None], [t[None] for t in theta])[:, 0]
            lse = _lse(j)
            r = np.exp(j - lse[:, None])
            parts = [np.array([-lse.sum(), len(lse)]), r.sum(0)]
            for x, k in zip(codes, sizes, strict=True):
                ok = (x >= 0) & (x < k)
                by = np.zeros((k, c))
                np.add.at(by, x[ok], r[ok])
                parts += [by.T.ravel(), r[ok].sum(0)]
            acc += np.concatenate(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(acc)], names=["i", "v"])

    got = rows.select(*(F.col(f).cast("int") for f in features)).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(size)
    for row in got:
        v[row.i] = row.v
    loss, n, resp, at = v[0], v[1], v[2 : 2 + c], 2 + c
    grads = []
    for t, k in zip(theta, sizes, strict=True):
        by, seen = v[at : at + c * k].reshape(c, k), v[at + c * k : at + c * k + c]
        grads.append(seen[:, None] * np.exp(t) - by)
        at += c * k + c
    return float(loss), n * np.exp(pi) - resp, grads


def _log_softmax(x: np.ndarray) -> np.ndarray:
    return x - _lse(x)[..., None]


def initial_logits(sizes: list[int], n_clusters: int, seed: int) -> list[np.ndarray]:
    """Small normal draws for pi [C] and by feature [C, K], by (seed, feature, cluster, category); pi comes before feature 0 and has one category."""
    own = draws.fold(draws.key(seed, 0, draws.LOGIT), np.arange(len(sizes) + 1))
    by = [draws.fold(draws.fold(k, np.arange(n_clusters))[:, None], np.arange(size)) for k, size in zip(own, [1, *sizes], strict=True)]
    return [0.1 * draws.normal(by[0])[:, 0], *(0.1 * draws.normal(k) for k in by[1:])]


def gradient_fit(fit: Fit, batch_size: int, steps: int, n_rows: int, rate: float = 0.1, optimizer: str = "adam", random: bool = True, history: list[list[np.ndarray]] | None = None) -> tuple[np.ndarray, list[np.ndarray], list[float]]:
    """Adam or sign descent on mini-batches, random or in order; returns pi, theta (log) and the losses. The logits after each step are added to `history`."""
    params = initial_logits(fit.sizes, fit.p.pi.shape[1], fit.seed)
    m, v, losses = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], []
    for t in range(steps):
        fit.step = t
        rows = fit.random_batch(batch_size, n_rows) if random else fit.batch(t * batch_size, (t + 1) * batch_size)
        loss, g_pi, g_theta = gradient(rows, fit.features, params[0], params[1:])
        losses.append(loss)
        for i, g in enumerate([g_pi, *g_theta]):
            if optimizer == "sign":
                params[i] = params[i] - rate * np.sign(g)
                continue
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9 ** (t + 1))) / (np.sqrt(v[i] / (1 - 0.999 ** (t + 1))) + 1e-8)
        if history is not None:
            history.append([x.copy() for x in params])
    return _log_softmax(params[0]), [_log_softmax(x) for x in params[1:]], losses
