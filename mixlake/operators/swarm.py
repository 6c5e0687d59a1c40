"""Sequential Monte Carlo with many particles: particles are rows, dealt over tasks, and a mini-batch goes to all of them.

Rows of the table are dealt once, by a keyed permutation, into blocks of one size, a folder each; a batch is a set of
blocks, so it reads those rows only. The state is a Parquet table with a row for each particle: its parameters and counts,
its weight, and the ancestors it had. A move is one pass over the particles, which writes the next state and the batch's
clusters; they stay where they were written until the block moves again. Resampling joins the state with the ancestors. The
driver holds the blocks' places and a few sums, whatever the number of particles or rows.

Draws have the keys of mixlake.operators.inference, so a Fit of the same seed, whose rows are in tasks and whose particles are on
the driver, gives the same numbers from the same batches. That form is for few particles and large batches, this one for many particles.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlake.functions import draws
from mixlake.operators import inference as I
from mixlake.operators.ordering import running_sums
from mixlake.sources.scratch import discard, materialize, shared_dir

#: Bytes of a batch's codes that are sent to all tasks at once; larger batches go in turns.
SENT = 64 << 20
#: Folders of dealt rows, at most; more blocks than that share them.
FOLDERS = 256
#: Numbers of rows x particles x clusters that a task works on at a time, about.
WORKED = 2_000_000
_STATE = "particle long, pi array<double>, theta array<double>, rows array<double>, phi array<double>, log_w double, gamma double, alpha_pi double, alpha_theta double, q double, back array<long>"


#: What a saved state holds besides its tables.
_SAVED = ("sizes", "n", "c", "seed", "count_mode", "q_mode", "grids", "shards", "step", "resamplings", "history")


@dataclass(frozen=True)
class Blocks:
    """Rows dealt into blocks: a table (row_id, place, features as codes) in folders by block, or by `shared` blocks that follow one another."""

    path: str
    features: tuple[str, ...]
    n_rows: int
    block_rows: int
    shared: int = 1

    @property
    def n(self) -> int:
        return -(-self.n_rows // self.block_rows)

    def size(self, block: int) -> int:
        return min(self.block_rows, self.n_rows - block * self.block_rows)

    def some(self, n: int, seed: int, step: int) -> list[int]:
        """n different blocks, by a hash of (seed, step, block)."""
        return np.argsort(draws.fold(draws.key(seed, step, draws.BLOCK), np.arange(self.n)), kind="stable")[:n].tolist()

    def read(self, spark, blocks: list[int]) -> DataFrame:
        """(block, place, row_id, features): the rows of some blocks; no other folder is read."""
        kinds = ", ".join(["row_id long", "place long", *(f"`{f}` int" for f in self.features), "block int", *(["shelf int"] if self.shared > 1 else [])])
        rows = spark.read.schema(kinds).parquet(self.path)
        if self.shared > 1:
            rows = rows.where(F.col("shelf").isin(sorted({int(b) // self.shared for b in blocks})))
        return rows.where(F.col("block").isin([int(b) for b in blocks])).select("block", "place", "row_id", *self.features)


def deal(rows: DataFrame, features: list[str], block_rows: int, seed: int | None = None, row_id: str = "row_id") -> Blocks:
    """Deals rows into blocks of block_rows, the last one smaller: by a keyed permutation of row_id, or in its order without a seed."""
    own = rows.select(F.col(row_id).cast("long").alias("row_id"), *(F.col(f).cast("int").alias(f) for f in features))
    order = ["row_id"] if seed is None else [F.xxhash64(F.lit(seed), F.lit(draws.ORDER), F.col("row_id")), F.col("row_id")]
    dealt = running_sums(own, order, {"place": F.lit(1)}).withColumn("place", F.col("place") - 1)
    path = f"{shared_dir(rows.sparkSession)}/{rows.sparkSession.sparkContext.applicationId}/blocks-{uuid.uuid4().hex}"
    n = dealt.count()
    shared = max(1, math.ceil(math.ceil(n / block_rows) / FOLDERS))
    dealt = dealt.withColumn("block", F.floor(F.col("place") / block_rows).cast("int")).withColumn("place", F.pmod("place", F.lit(block_rows)))
    if shared > 1:
        dealt.withColumn("shelf", F.floor(F.col("block") / shared).cast("int")).write.partitionBy("shelf").parquet(path)
    else:
        dealt.write.partitionBy("block").parquet(path)
    return Blocks(path, tuple(features), n, block_rows, shared)


class Swarm:
    """Particles over blocks of rows. shards: how many tasks share the particles."""

    def __init__(self, spark, blocks: Blocks, sizes: list[int], n_particles: int, n_clusters: int, seed: int = 0, alpha_pi: float = 1.0, alpha_theta: float = 1.0, count_mode: str = "rows", q_mode: str = "normalized", grids: tuple[list[float], list[float]] | None = None, shards: int | None = None):
        if blocks.block_rows * (4 * len(sizes) + 8) > SENT:
            raise ValueError(f"a block is larger than {SENT} bytes; deal smaller ones")
        self.spark, self.blocks, self.sizes, self.n, self.c, self.seed = spark, blocks, sizes, n_particles, n_clusters, seed
        self.count_mode, self.q_mode, self.grids = count_mode, q_mode, grids
        self.shards = min(n_particles, shards or spark.sparkContext.defaultParallelism)
        self.step = self.resamplings = 0
        self.history: list[dict] = []  # step, ess, resampled
        self.held: dict[int, tuple[DataFrame, int, int]] = {}  # block: table of clusters, resamplings before it, place in its arrays
        self.weighted: DataFrame | None = None  # the last weighted step's particles before they were resampled
        self.kept: set[str] = set()  # tables that saved states name
        c = n_clusters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    ids = np.asarray(b.column(0))
                    shapes = [np.full((len(ids), c, k), alpha_theta) for k in sizes]
                    pi, theta = I.parameter_draws(np.full((len(ids), c), alpha_pi), shapes, ids, seed, -1)
                    zero = np.zeros(len(ids))
                    yield _packed(ids, I.Particles(pi, theta, np.zeros_like(pi), [np.zeros_like(t) for t in theta], zero, zero, zero + alpha_pi, zero + alpha_theta), zero, pa.array([[]] * len(ids), pa.list_(pa.int64())))

        self.state = materialize(spark.range(0, n_particles, 1, self.shards).mapInArrow(run, _STATE), "particles")

    # ---- saved states

    def save(self, path: str) -> None:
        """Writes what the fit is made of as path/step=N, one row; the tables that it names stay, and the fit goes on with new ones."""
        held = {b: (t._scratch, before, begin) for b, (t, before, begin) in self.held.items()}
        own = {k: getattr(self, k) for k in _SAVED}
        blocks = {"path": self.blocks.path, "features": self.blocks.features, "n_rows": self.blocks.n_rows, "block_rows": self.blocks.block_rows, "shared": self.blocks.shared}
        self.kept |= {self.state._scratch, *(p for p, *_ in held.values())}
        text = json.dumps({**own, "blocks": blocks, "held": held, "state": self.state._scratch})
        self.spark.createDataFrame([(text,)], "fit string").coalesce(1).write.mode("overwrite").parquet(f"{path}/step={self.step:08d}")

    @classmethod
    def resume(cls, spark, path: str, step: int | None = None) -> Swarm | None:
        """The fit that save() wrote after `step` moves, or last; None where there is none. It goes on as if it had never stopped."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        rows = spark.read.schema("fit string, step int").parquet(path)
        rows = rows.orderBy(F.desc("step")).limit(1) if step is None else rows.where(F.col("step") == step)
        found = rows.collect()
        if not found:
            return None
        own = json.loads(found[0].fit)
        out = cls.__new__(cls)
        out.spark, out.weighted = spark, None
        for k in _SAVED:
            setattr(out, k, own[k])
        out.blocks = Blocks(own["blocks"]["path"], tuple(own["blocks"]["features"]), own["blocks"]["n_rows"], own["blocks"]["block_rows"], own["blocks"].get("shared", 1))
        tables = {p: _table(spark, p) for p in {v[0] for v in own["held"].values()}}
        out.held = {int(b): (tables[p], before, begin) for b, (p, before, begin) in own["held"].items()}
        out.state = _table(spark, own["state"]).drop("clusters")
        out.state._scratch = own["state"]
        out.kept = {own["state"], *tables}
        return out

    # ---- moves

    def move(self, blocks: list[int], weigh: bool) -> None:
        """Draws the blocks' clusters again in every particle, then its parameters; with `weigh` also its weight, and resamples when fewer than half of the particles count."""
        turns = self._turns(blocks)
        for turn, own in enumerate(turns):
            self._pass(own, turn == 0, turn == len(turns) - 1, weigh)
        self.step += 1
        if not weigh:
            return
        ess = self.effective_size()
        resampled = ess < self.n / 2 and self.n > 1
        self.history.append({"step": self.step - 1, "ess": ess, "resampled": resampled})
        self.weighted = self.state
        if resampled:
            self._resample()

    def _turns(self, blocks: list[int]) -> list[list[int]]:
        """The blocks in groups that can be sent to all tasks."""
        most = max(1, SENT // (self.blocks.block_rows * (4 * len(self.sizes) + 8)))
        return [blocks[i : i + most] for i in range(0, len(blocks), most)]

    def _codes(self, blocks: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Row ids and codes by feature of some blocks, in their order; their size is checked by SENT."""
        got = self.blocks.read(self.spark, blocks).toArrow()
        order = np.lexsort((np.asarray(got.column("place")), np.asarray([blocks.index(b) for b in got.column("block").to_pylist()])))
        return np.asarray(got.column("row_id"))[order], [np.asarray(got.column(f).fill_null(-1)).astype(np.int32)[order] for f in self.blocks.features]

    def _before(self, blocks: list[int]) -> Column | None:
        """The state joined with the blocks' clusters, as a column `old` of the joined frame; None if none has any."""
        return None if not any(b in self.held for b in blocks) else F.concat(*(F.coalesce(F.col(f"_old{b}"), F.array_repeat(F.lit(-1), self.blocks.size(b))) if b in self.held else F.array_repeat(F.lit(-1), self.blocks.size(b)) for b in blocks))

    def _with_old(self, blocks: list[int]) -> DataFrame:
        """The state with the array `old`: the clusters that the blocks' rows have in each particle, -1 for none."""
        out = self.state
        for b in blocks:
            if b in self.held:
                table, before, begin = self.held[b]
                own = table.select(F.col("particle").alias(f"_at{b}"), F.slice("clusters", begin + 1, self.blocks.size(b)).alias(f"_old{b}"))
                out = out.withColumn("_then", self._then(before)).join(own, F.col("_then") == F.col(f"_at{b}")).drop("_then", f"_at{b}")
        old = self._before(blocks)
        return out.select(*self.state.columns, F.lit(None).cast("array<int>").alias("old") if old is None else old.alias("old"))

    @staticmethod
    def _then(resamplings: int) -> Column:
        """The number that a particle's ancestor had after so many resamplings."""
        return F.coalesce(F.get("back", F.lit(resamplings)), F.col("particle"))

    def _pass(self, blocks: list[int], first: bool, last: bool, weigh: bool) -> None:
        row_id, codes = self._codes(blocks)
        sent = self.spark.sparkContext.broadcast((row_id, codes))
        sizes, c, seed, step, q_mode, count_mode, grids = self.sizes, self.c, self.seed, self.step, self.q_mode, self.count_mode, self.grids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row_id, codes = sent.value
            some = max(1, WORKED // max(1, len(row_id) * c))
            for whole in batches:
                for k in range(0, whole.num_rows, some):
                    b = whole.slice(k, some)
                    ids, p = _unpacked(b, c, sizes)
                    q = np.zeros(len(ids)) if first else np.asarray(b.column("q")).copy()
                    old = b.column("old")
                    if old.null_count < len(old) and len(row_id):
                        was = np.asarray(old.flatten()).reshape(len(ids), -1).T.astype(np.int64)
                        rows, phi = I.cells(codes, was, c, sizes)
                        p.rows -= rows
                        p.phi = [x - y for x, y in zip(p.phi, phi, strict=True)]
                    a, own = I.drawn_clusters(codes, row_id, p.pi, p.theta, ids, seed, step, q_mode)
                    rows, phi = I.cells(codes, a, c, sizes)
                    p.rows += rows
                    p.phi = [x + y for x, y in zip(p.phi, phi, strict=True)]
                    q += own.sum(0)
                    if last:
                        q += I.redraw_parameters(p, seed, step, count_mode, ids)
                        if grids:
                            I.hyperparameters(p, *grids, seed, step, ids)
                        target = I.log_target(p)
                        if weigh:
                            p.log_w = p.log_w + target - p.gamma - q
                        p.gamma = target
                    clusters = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(row_id)), pa.array(a.T.astype(np.int32).ravel()))
                    out = _packed(ids, p, q, b.column("back"))
                    yield pa.RecordBatch.from_arrays([*out.columns, clusters], names=[*out.schema.names, "clusters"])

        table = materialize(self._with_old(blocks).mapInArrow(run, f"{_STATE}, clusters array<int>"), "particles")
        sent.unpersist()
        before, self.state = self.state, table.drop("clusters")
        self.state._scratch = table._scratch
        begin, gone = 0, [before]
        for b in blocks:
            if b in self.held:
                gone.append(self.held[b][0])
            self.held[b] = (table, self.resamplings, begin)
            begin += self.blocks.size(b)
        if self.weighted is not None:
            gone.append(self.weighted)
            self.weighted = None
        self._drop(gone)

    def _drop(self, tables: list[DataFrame]) -> None:
        """Deletes those of the tables that nothing names any more."""
        used = {t._scratch for t, *_ in self.held.values()} | {self.state._scratch} | self.kept
        for path, t in {t._scratch: t for t in tables}.items():
            if path not in used:
                discard(t)

    # ---- weights

    def effective_size(self) -> float:
        """1 / sum of the squared normalised weights."""
        top = self.state.agg(F.max("log_w")).first()[0]
        w = F.exp(F.col("log_w") - F.lit(top))
        s, s2 = self.state.agg(F.sum(w), F.sum(w * w)).first()
        return s * s / s2

    def ancestors(self, state: DataFrame | None = None) -> DataFrame:
        """(particle, ancestor): multinomial, by the particles' own uniform numbers. Intervals and numbers meet in n cells of the unit interval, so no side is sent whole."""
        state = self.state if state is None else state
        top = state.agg(F.max("log_w")).first()[0]
        w = state.select("particle", F.exp(F.col("log_w") - F.lit(top)).alias("w"))
        ends = running_sums(w, ["particle"], {"high": "w"})
        total = ends.agg(F.max("high")).first()[0]
        n, seed, step = self.n, self.seed, self.step
        place = lambda u: F.least(F.floor(u * n), F.lit(n - 1)).cast("long")
        high, low = F.col("high") / total, (F.col("high") - F.col("w")) / total
        ends = ends.select(F.col("particle").alias("ancestor"), high.alias("high"), F.greatest(low - 1e-9, F.lit(0.0)).alias("low"))
        ends = ends.withColumn("cell", F.explode(F.sequence(place(F.col("low")), place(F.col("high")))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                u = draws.unit(draws.fold(draws.key(seed, step, draws.ANCESTOR), np.asarray(b.column(0))))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(u)], names=["particle", "u"])

        own = self.spark.range(0, n, 1, self.shards).mapInArrow(run, "particle long, u double").withColumn("cell", place(F.col("u")))
        met = own.join(ends, "cell").where(F.col("high") > F.col("u")).groupBy("particle").agg(F.min("ancestor").alias("ancestor"))
        # a number beyond the last sum, by rounding, has the last particle
        return own.join(met, "particle", "left").select("particle", F.coalesce("ancestor", F.lit(n - 1)).alias("ancestor"))

    def _resample(self) -> None:
        old = self.state
        up = self.ancestors()
        state = old.withColumnRenamed("particle", "ancestor").join(up, "ancestor").withColumns({"log_w": F.lit(-math.log(self.n)), "back": F.concat("back", F.array("ancestor"))})
        self.state = materialize(state.repartition(self.shards, "particle").select(*old.columns), "particles")
        self.resamplings += 1

    # ---- runs and results

    def random_blocks(self, n: int) -> list[int]:
        """n different blocks of all, by (seed, step)."""
        return self.blocks.some(n, self.seed, self.step)

    def run(self, steps: int | None = None, rejuvenation: int = 0) -> Swarm:
        """Weighted steps over the blocks in order, beginning again after the last; after each, `rejuvenation` moves of random blocks, which leave weights alone."""
        for t in range(self.blocks.n if steps is None else steps):
            self.move([t % self.blocks.n], True)
            for _ in range(rejuvenation):
                self.move(self.random_blocks(1), False)
        return self

    def particles(self) -> DataFrame:
        """(particle, log_w, w, gamma, alpha_pi, alpha_theta), w normalised."""
        top = self.state.agg(F.max("log_w")).first()[0]
        e = F.exp(F.col("log_w") - F.lit(top))
        total = self.state.agg(F.sum(e)).first()[0]
        return self.state.select("particle", "log_w", (e / F.lit(total)).alias("w"), "gamma", "alpha_pi", "alpha_theta")

    def weights(self) -> tuple[DataFrame, DataFrame]:
        """(particle, cluster, log_p) and (particle, feature, cluster, category, log_p) of all particles."""
        pi = self.state.select("particle", F.posexplode("pi").alias("cluster", "log_p"))
        at, parts = 0, []
        for f, k in zip(self.blocks.features, self.sizes, strict=True):
            parts.append(F.struct(F.lit(f).alias("feature"), F.lit(k).alias("k"), F.slice("theta", at + 1, self.c * k).alias("x")))
            at += self.c * k
        each = self.state.select("particle", F.explode(F.array(*parts)).alias("f")).select("particle", "f.feature", "f.k", F.posexplode("f.x").alias("i", "log_p"))
        return pi, each.select("particle", "feature", F.floor(F.col("i") / F.col("k")).cast("int").alias("cluster"), (F.col("i") % F.col("k")).cast("int").alias("category"), "log_p")

    def counts(self) -> DataFrame:
        """(particle, feature, cluster, category, n): cells that the particles' counts hold, those above 0."""
        at, parts = 0, []
        for f, k in zip(self.blocks.features, self.sizes, strict=True):
            parts.append(F.struct(F.lit(f).alias("feature"), F.lit(k).alias("k"), F.slice("phi", at + 1, self.c * k).alias("x")))
            at += self.c * k
        each = self.state.select("particle", F.explode(F.array(*parts)).alias("f")).select("particle", "f.feature", "f.k", F.posexplode("f.x").alias("i", "n")).where("n > 0")
        return each.select("particle", "feature", F.floor(F.col("i") / F.col("k")).cast("int").alias("cluster"), (F.col("i") % F.col("k")).cast("int").alias("category"), F.col("n").cast("long").alias("n"))

    def assigned(self, blocks: list[int] | None = None) -> DataFrame:
        """(row_id, particle, cluster) of the rows of some blocks, all that have moved by default."""
        out = None
        for b in sorted(self.held) if blocks is None else [b for b in blocks if b in self.held]:
            table, before, begin = self.held[b]
            own = self.state.select("particle", self._then(before).alias("_then")).join(table.select(F.col("particle").alias("_then"), F.slice("clusters", begin + 1, self.blocks.size(b)).alias("a")), "_then")
            part = own.select("particle", F.posexplode("a").alias("place", "cluster")).join(self.blocks.read(self.spark, [b]).select("place", "row_id"), "place").select("row_id", "particle", "cluster")
            out = part if out is None else out.unionByName(part)
        return out

    def log_likelihood(self, test: Blocks) -> DataFrame:
        """(particle, ll): the log-likelihood of all rows of other blocks, or of these, under each particle."""
        out, sizes, c, features = None, self.sizes, self.c, len(self.sizes)
        for own in self._turns(list(range(test.n))):
            got = test.read(self.spark, own).toArrow()
            sent = self.spark.sparkContext.broadcast([np.asarray(got.column(f).fill_null(-1)).astype(np.int32) for f in test.features])

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                codes = sent.value
                n = len(codes[0]) if features else 0
                for whole in batches:
                    for k in range(0, whole.num_rows, some := max(1, WORKED // max(1, n * c))):
                        ids, p = _unpacked(whole.slice(k, some), c, sizes)
                        ll = I._lse(I.joint(codes, p.pi, p.theta)).sum(0) if n else np.zeros(len(ids))
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ll)], names=["particle", "ll"])

            part = materialize(self.state.mapInArrow(run, "particle long, ll double"), "likelihoods")
            out = part if out is None else out.unionByName(part)
        return out.groupBy("particle").agg(F.sum("ll").alias("ll"))


class BlockFit:
    """The same fit with rows in tasks and particles on the driver, for few particles and blocks of any size.

    A block that has moved is a folder of its rows with their codes and clusters. A move reads its blocks' folders, or the dealt rows of
    those that haven't moved, takes their old clusters out of the counts and writes new folders; no other row is read, and nothing is joined.
    """

    def __init__(self, spark, blocks: Blocks, sizes: list[int], n_particles: int, n_clusters: int, seed: int = 0, alpha_pi: float = 1.0, alpha_theta: float = 1.0, count_mode: str = "rows", q_mode: str = "normalized", grids: tuple[list[float], list[float]] | None = None):
        self.spark, self.blocks, self.sizes, self.seed = spark, blocks, sizes, seed
        self.count_mode, self.q_mode, self.grids = count_mode, q_mode, grids
        self.p = I.init_particles(sizes, n_particles, n_clusters, seed, alpha_pi, alpha_theta)
        self.held: dict[int, tuple[str, int]] = {}  # block: the path of the move that has its clusters, maps before it
        self.maps: list[np.ndarray] = []
        self.step = 0
        self.history: list[dict] = []
        self.q = np.zeros(n_particles)  # the last move's proposal
        self.weighted: I.Particles | None = None  # the last weighted step's particles before they were resampled
        self.folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/block-fit-{uuid.uuid4().hex}"

    def _rows(self, blocks: list[int]) -> DataFrame:
        """(block, place, row_id, features, a): the blocks' rows with their clusters in the present particles, -1 for none."""
        fresh = [b for b in blocks if b not in self.held]
        own = self.blocks.read(self.spark, fresh).withColumn("a", F.array_repeat(F.lit(-1), self.p.n)) if fresh else None
        for path, before in sorted({self.held[b] for b in blocks if b in self.held}):
            up = np.arange(self.p.n)
            for m in reversed(self.maps[before:]):
                up = m[up]
            of = [b for b in blocks if self.held.get(b) == (path, before)]
            kinds = ", ".join(["place long", "row_id long", *(f"`{f}` int" for f in self.blocks.features), "a array<int>", "block int"])
            part = self.spark.read.schema(kinds).parquet(path).where(F.col("block").isin(of))
            part = part.select("block", "place", "row_id", *self.blocks.features, F.transform(F.array(*(F.lit(int(x)) for x in up)), lambda x: F.get("a", x)).alias("a"))
            own = part if own is None else own.unionByName(part)
        return own

    def move(self, blocks: list[int], weigh: bool) -> None:
        """Draws the blocks' clusters again in every particle, then the parameters; with `weigh` also the weights, and resamples when fewer than half of the particles count."""
        p, n, c, sizes, seed, step, q_mode, features = self.p, self.p.n, self.p.pi.shape[1], self.sizes, self.seed, self.step, self.q_mode, list(self.blocks.features)
        pi, theta, first = p.pi, p.theta, 3  # block, place and row_id come before the features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k in range(0, whole.num_rows, some := max(1, WORKED // (n * c))):
                    b = whole.slice(k, some)
                    a, q = I.drawn_clusters(I._codes(b, first, len(sizes)), np.asarray(b.column("row_id")), pi, theta, np.arange(n), seed, step, q_mode)
                    yield pa.RecordBatch.from_arrays([*b.columns, I._lists(a.astype(np.int32)), I._lists(q)], names=[*b.schema.names, "a", "q"])

        kinds = ", ".join(["block int", "place long", "row_id long", *(f"`{f}` int" for f in features), "was array<int>", "a array<int>", "q array<double>"])
        path = f"{self.folder}/move-{step:06d}"
        self._rows(blocks).withColumnRenamed("a", "was").mapInArrow(run, kinds).write.partitionBy("block").parquet(path)
        rows, phi, q = self._changes(path, features, n, c)
        p.rows = p.rows + rows
        p.phi = [x + y for x, y in zip(p.phi, phi, strict=True)]
        self.held |= {b: (path, len(self.maps)) for b in blocks}
        q += I.redraw_parameters(p, seed, step, self.count_mode)
        if self.grids:
            I.hyperparameters(p, *self.grids, seed, step)
        target = I.log_target(p)
        if weigh:
            p.log_w = p.log_w + target - p.gamma - q
        p.gamma, self.q = target, q
        self.step += 1
        self.weighted = replace(p) if weigh else None  # resampling makes new arrays
        if weigh:
            ess = I.effective_size(p.log_w)
            resampled = ess < n / 2 and n > 1
            self.history.append({"step": step, "ess": ess, "resampled": resampled})
            if resampled:
                self.maps.append(I.resampled(p, seed, self.step))

    def _changes(self, path: str, features: list[str], n: int, c: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """What a move has changed: rows [P, C], cells by feature [P, C, K_d], and the proposal's log probability [P]. One number for each cell comes from a task."""
        sizes = self.sizes
        shapes = [(n, c), *((n, c, k) for k in sizes)]
        ends = np.cumsum([0, *(math.prod(s) for s in shapes)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, q = np.zeros(ends[-1], np.int64), np.zeros(n)
            for whole in batches:
                for k in range(0, whole.num_rows, some := max(1, I.COUNTED // n)):
                    b = whole.slice(k, some)
                    codes = I._codes(b, 3, len(sizes))
                    for i, sign in ((0, -1), (1, 1)):
                        rows, phi = I.cells(codes, np.asarray(b.column(i).flatten()).reshape(-1, n).astype(np.int64), c, sizes)
                        total += sign * np.concatenate([rows.ravel(), *(f.ravel() for f in phi)])
                    q += np.asarray(b.column(2).flatten()).reshape(-1, n).sum(0)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, ends[-1] + np.arange(n)])), pa.array(np.concatenate([total[at], np.zeros(n, np.int64)])), pa.array(np.concatenate([np.zeros(len(at)), q]))], names=["cell", "n", "q"])

        kinds = ", ".join(["place long", "row_id long", *(f"`{f}` int" for f in features), "was array<int>", "a array<int>", "q array<double>", "block int"])
        own = self.spark.read.schema(kinds).parquet(path).select("was", "a", "q", *features)
        got = own.mapInArrow(run, "cell long, n long, q double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("q").alias("q")).toArrow()
        cell = np.asarray(got.column("cell"))
        total, q = np.zeros(ends[-1] + n), np.zeros(ends[-1] + n)
        total[cell], q[cell] = np.asarray(got.column("n")), np.asarray(got.column("q"))
        rows, *phi = (total[i:j].reshape(s) for i, j, s in zip(ends, ends[1:], shapes, strict=False))
        return rows, phi, q[ends[-1] :]

    def run(self, steps: int | None = None, rejuvenation: int = 0) -> BlockFit:
        """As Swarm.run()."""
        for t in range(self.blocks.n if steps is None else steps):
            self.move([t % self.blocks.n], True)
            for _ in range(rejuvenation):
                self.move(self.blocks.some(1, self.seed, self.step), False)
        return self

    def assigned(self, weighted: bool = False) -> DataFrame:
        """(row_id, particle, cluster) of the rows of all blocks that have moved; with `weighted` as they were before the last weighted step was resampled."""
        maps = self.maps
        if weighted and self.weighted is not None and self.history[-1]["resampled"]:
            self.maps = maps[:-1]
        try:
            return self._rows(sorted(self.held)).select("row_id", F.posexplode("a").alias("particle", "cluster"))
        finally:
            self.maps = maps

    def assigned_cells(self) -> DataFrame:
        """(particle, feature, cluster, category, n): the cells above 0 of the clusters that the blocks' files hold, counted in tasks."""
        _, phi = I.counts(self._rows(sorted(self.held)), list(self.blocks.features), self.p.n, self.p.pi.shape[1], self.sizes)
        return self.cells([x.astype(int) for x in phi], "n", "long").where("n > 0")

    def particles(self, p: I.Particles | None = None) -> DataFrame:
        """(particle, log_w, w, gamma, alpha_pi, alpha_theta) of the present particles, or of `weighted`; w normalised."""
        p = self.p if p is None else p
        rows = [(i, *(float(x[i]) for x in (p.log_w, w, p.gamma, p.alpha_pi, p.alpha_theta))) for w in (I.weights(p.log_w),) for i in range(p.n)]
        return self.spark.createDataFrame(rows, "particle long, log_w double, w double, gamma double, alpha_pi double, alpha_theta double")

    def cells(self, of: list[np.ndarray], name: str, kind: str) -> DataFrame:
        """(particle, feature, cluster, category, name) of numbers by feature [P, C, K_d], such as theta or phi of few particles."""
        rows = [(int(i), f, int(c), int(k), x[i, c, k].item()) for f, x in zip(self.blocks.features, of, strict=True) for i, c, k in np.ndindex(x.shape)]
        return self.spark.createDataFrame(rows, f"particle long, feature string, cluster int, category int, {name} {kind}")


def _table(spark, path: str) -> DataFrame:
    """A table of particles and clusters that a move has written."""
    out = spark.read.schema(f"{_STATE}, clusters array<int>").parquet(path)
    out._scratch = path
    return out


def _packed(ids: np.ndarray, p: I.Particles, q: np.ndarray, back: pa.Array) -> pa.RecordBatch:
    """A row for each particle."""
    flat = lambda parts: I._lists(np.concatenate([x.reshape(len(ids), -1) for x in parts], axis=1))
    arrays = [pa.array(ids, pa.int64()), I._lists(p.pi), flat(p.theta), I._lists(p.rows.astype(float)), flat([x.astype(float) for x in p.phi])]
    arrays += [pa.array(np.asarray(x, float)) for x in (p.log_w, p.gamma, p.alpha_pi, p.alpha_theta, q)]
    return pa.RecordBatch.from_arrays([*arrays, back], names=[x.strip().split(" ")[0] for x in _STATE.split(", ")])


def _unpacked(b: pa.RecordBatch, c: int, sizes: list[int]) -> tuple[np.ndarray, I.Particles]:
    n = b.num_rows
    matrix = lambda name: np.asarray(b.column(name).flatten()).reshape(n, -1).copy()
    ends = np.cumsum([0, *(c * k for k in sizes)])
    split = lambda x: [x[:, i:j].reshape(n, c, k) for i, j, k in zip(ends, ends[1:], sizes, strict=False)]
    numbers = (np.asarray(b.column(x)).copy() for x in ("log_w", "gamma", "alpha_pi", "alpha_theta"))
    return np.asarray(b.column("particle")), I.Particles(matrix("pi"), split(matrix("theta")), matrix("rows"), split(matrix("phi")), *numbers)
