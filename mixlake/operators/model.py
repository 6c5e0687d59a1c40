"""Mixture models over encoded tables, and the questions they answer.

A model has pi (cluster, log_p) and theta (cluster, feature, category, log_p), as DataFrames. Rows are
scored in one pass without a join, by numpy on Arrow batches of the features' columns only. Models of more than
PACKED numbers aren't sent to tasks but joined, feature by feature.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mixlake.functions.exprs import NEG_INF, draw_index, lgamma, lse_array, safe_ln, uniform
from mixlake.operators.schema import unused_name
from mixlake.operators.scoring import Packed, lists, lse
from mixlake.sources.scratch import materialize

EPS = 1e-10
#: Log-probabilities of a model that is sent to all tasks as constants, at most.
PACKED = 500_000
#: Features of one side of a block of pairs.
BLOCK = 8


def sufficient_statistics(rows: DataFrame, features: list[str], cluster: str = "cluster", kind: str = "int") -> DataFrame:
    """(cluster, feature, category, n): counts of non-missing cells, codes or values of another `kind`, by cluster. Only partial counts are shuffled."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast(kind).alias("category")) for f in features))).alias("x")
    return rows.select(F.col(cluster).alias("cluster"), cells).where("x.category is not null and cluster is not null").groupBy("cluster", "x.feature", "x.category").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Model:
    pi: DataFrame
    theta: DataFrame
    n_clusters: int
    features: tuple[str, ...]

    @classmethod
    def from_assignments(cls, rows: DataFrame, domain: DataFrame, features: list[str], n_clusters: int, alpha_pi: float = 1.0, alpha_theta: float = 1.0, cluster: str = "cluster") -> Model:
        """Posterior means. Categories that a cluster never has come from `domain`. The counts are written to the shared folder, so questions don't read the rows again."""
        spark = rows.sparkSession
        clusters = spark.range(n_clusters).select(F.col("id").cast("int").alias("cluster"))
        # one scan: a cell that every row has counts the clusters
        every = unused_name(features)
        counted = materialize(sufficient_statistics(rows.withColumn(every, F.lit(0)), [*features, every], cluster).withColumn("cluster", F.col("cluster").cast("int")), "phi")
        seen = counted.where(F.col("feature") == every).select("cluster", "n")
        total = F.sum("n").over(W.partitionBy())
        pi = clusters.join(seen, "cluster", "left").na.fill(0, ["n"]).select("cluster", F.ln((F.col("n") + alpha_pi) / (total + alpha_pi * n_clusters)).alias("log_p"))
        phi = counted.where(F.col("feature") != every)
        cells = clusters.crossJoin(domain.where(F.col("feature").isin(features)).select("feature", "category"))  # the model's own size
        w = W.partitionBy("cluster", "feature")
        p = (F.col("n") + alpha_theta) / (F.sum("n").over(w) + alpha_theta * F.count("*").over(w))
        theta = cells.join(phi, ["cluster", "feature", "category"], "left").na.fill(0, ["n"]).select("cluster", "feature", "category", F.ln(p).alias("log_p"))
        return cls(pi, theta, n_clusters, tuple(features))

    @cached_property
    def packed(self) -> Packed | None:
        """The model's numbers for tasks; None for models of more than PACKED numbers, as counted or as laid out."""
        rows = self.theta.where(F.col("category") >= 0).limit(PACKED + 1).collect()
        sizes = {f: 0 for f in self.features}
        for r in rows:
            sizes[r.feature] = max(sizes.get(r.feature, 0), r.category + 1)
        if len(rows) > PACKED or sum(sizes.values()) * self.n_clusters > PACKED:
            return None
        tables = {f: np.full((k, self.n_clusters), NEG_INF) for f, k in sizes.items()}
        known = {f: np.zeros(k, bool) for f, k in sizes.items()}
        for r in rows:
            tables[r.feature][r.category, r.cluster], known[r.feature][r.category] = r.log_p, True
        prior = np.full(self.n_clusters, NEG_INF)
        for r in self.pi.collect():
            prior[r.cluster] = r.log_p
        return Packed(prior, tuple(tables[f] for f in self.features), tuple(known[f] for f in self.features))

    def _scored(self, kind: str, score) -> Column:
        """score(packed, codes) of the features' columns as a column."""
        own, n = self.packed, len(self.features)

        @F.arrow_udf(kind)
        def run(*columns: pa.Array) -> pa.Array:
            return score(own, list(columns[:n]))

        return run(*(F.col(f).cast("int") for f in self.features))

    def lookup(self, feature: str) -> DataFrame:
        """(category, arr): the feature's log-probabilities by cluster."""
        own = self.theta.where(F.col("feature") == feature)
        got = own.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "log_p"))).alias("m"))
        return got.select("category", F.transform(F.sequence(F.lit(0), F.lit(self.n_clusters - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(NEG_INF))).alias("arr"))

    def prior(self) -> DataFrame:
        """One row: the array of log pi by cluster."""
        m = self.pi.agg(F.map_from_entries(F.collect_list(F.struct("cluster", "log_p"))).alias("m"))
        return m.select(F.transform(F.sequence(F.lit(0), F.lit(self.n_clusters - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(NEG_INF))).alias("_prior"))

    def joint(self, rows: DataFrame, name: str = "joint") -> DataFrame:
        """rows with the array of log p(cluster, observed cells). Missing cells drop out; codes outside the domain are impossible."""
        if self.packed is not None and self.features:
            return rows.withColumn(name, self._scored("array<double>", lambda own, codes: lists(own.joint(codes))))
        out = rows.crossJoin(F.broadcast(self.prior()))  # one row of n_clusters numbers
        impossible, parts = F.array_repeat(F.lit(NEG_INF), self.n_clusters), []
        for i, f in enumerate(self.features):
            out = out.join(self.lookup(f).select(F.col("category").alias(f"_k{i}"), F.col("arr").alias(f"_a{i}")), F.col(f) == F.col(f"_k{i}"), "left")
            parts.append(F.when(F.col(f).isNotNull(), F.coalesce(F.col(f"_a{i}"), impossible)))
        total = F.aggregate(F.filter(F.array(*parts), lambda x: x.isNotNull()), F.col("_prior"), lambda t, x: F.zip_with(t, x, lambda a, b: a + b)) if parts else F.col("_prior")
        return out.withColumn(name, total).drop("_prior", *(f"_{x}{i}" for i in range(len(self.features)) for x in "ka"))

    def logprob(self, rows: DataFrame, name: str = "log_p") -> DataFrame:
        """Log-probability of each row's observed cells; with no cell observed that of nothing, 0."""
        if self.packed is not None and self.features:
            return rows.withColumn(name, self._scored("double", lambda own, codes: pa.array(lse(own.joint(codes)))))
        return self.joint(rows, "_joint").withColumn(name, lse_array(F.col("_joint"))).drop("_joint")

    def posterior(self, rows: DataFrame, name: str = "posterior") -> DataFrame:
        """Array of log p(cluster | observed cells)."""
        if self.packed is not None and self.features:
            return rows.withColumn(name, self._scored("array<double>", lambda own, codes: lists(own.posterior(codes))))
        lse_ = lse_array(F.col("_joint"))
        return self.joint(rows, "_joint").withColumn("_lse", lse_).withColumn(name, F.transform("_joint", lambda x: x - F.col("_lse"))).drop("_joint", "_lse")

    def table_of(self, feature: str) -> DataFrame:
        """One row: the feature's categories in order, each with its array over clusters; its size is the model's."""
        return self.lookup(feature).agg(F.array_sort(F.collect_list(F.struct("category", "arr"))).alias(f"_t_{feature}"))

    def _filled(self, rows: DataFrame, found: Column) -> DataFrame:
        """rows whose missing cells come from the fields f0, f1, ... of a struct."""
        out = rows.withColumn("_found", found)
        return out.withColumns({f: F.coalesce(F.col(f), F.col(f"_found.f{i}")) for i, f in enumerate(self.features)}).drop("_found")

    @property
    def _fields(self) -> list[str]:
        return [f"f{i}" for i in range(len(self.features))]

    def impute(self, rows: DataFrame) -> DataFrame:
        """Missing cells become the likeliest category given the observed ones; ties go to the lowest."""
        names = self._fields
        if self.packed is not None and names:
            kind = f"struct<{', '.join(f'{n}: int' for n in names)}>"
            return self._filled(rows, self._scored(kind, lambda own, codes: pa.StructArray.from_arrays(own.likeliest(codes), names=names)))
        out = self.posterior(rows, "_post")
        for f in self.features:
            out = out.crossJoin(self.table_of(f))
            best = F.aggregate(f"_t_{f}", F.struct(F.lit(-1.0).alias("p"), F.lit(-1).alias("k")), lambda s, e: _better(s, e, F.col("_post")))["k"]
            out = out.withColumn(f, F.coalesce(F.col(f), best)).drop(f"_t_{f}")
        return out.drop("_post")

    def sample_conditional(self, rows: DataFrame, seed: int, row_id: str) -> DataFrame:
        """Missing cells are drawn given the observed ones: a cluster from the posterior, then each category. Draws depend on seed and row only."""
        names, own, n = self._fields, self.packed, len(self.features)
        if own is not None and names:

            @F.arrow_udf(f"struct<{', '.join(f'{x}: int' for x in names)}>")
            def run(*columns: pa.Array) -> pa.Array:
                # only cells that are missing have a number
                u, *by_feature = (np.asarray(c.fill_null(0.0)) for c in columns[n:])
                return pa.StructArray.from_arrays(own.drawn(list(columns[:n]), u, by_feature), names=names)

            numbers = (F.when(F.col(f).isNull(), uniform(seed, f, F.col(row_id))) for f in self.features)
            return self._filled(rows, run(*(F.col(f).cast("int") for f in self.features), uniform(seed, "c", F.col(row_id)), *numbers))
        out = self.posterior(rows, "_post")
        out = out.withColumn("_c", draw_index(F.transform("_post", F.exp), uniform(seed, "c", F.col(row_id))))
        for f in self.features:
            out = out.crossJoin(self.table_of(f))
            weights = F.transform(f"_t_{f}", lambda e: F.exp(F.get(e["arr"], F.col("_c"))))
            drawn = F.get(F.transform(f"_t_{f}", lambda e: e["category"]), draw_index(weights, uniform(seed, f, F.col(row_id))))
            out = out.withColumn(f, F.coalesce(F.col(f), drawn)).drop(f"_t_{f}")
        return out.drop("_post", "_c")

    def sample(self, n: int, seed: int) -> DataFrame:
        """n rows drawn from the model: row_id and the features' codes."""
        spark = self.pi.sparkSession
        rows = spark.range(n).withColumnRenamed("id", "row_id").select("row_id", *(F.lit(None).cast("int").alias(f) for f in self.features))
        return self.sample_conditional(rows, seed, "row_id")

    def marginals(self) -> DataFrame:
        """(feature, category, p) under the model."""
        joined = self.theta.join(self.pi.withColumnRenamed("log_p", "log_pi"), "cluster")
        return joined.groupBy("feature", "category").agg(F.sum(F.exp(F.col("log_p") + F.col("log_pi"))).alias("p"))

    def prior_mode(self) -> DataFrame:
        """(feature, category): the likeliest category of each feature, ties to the lowest."""
        w = W.partitionBy("feature").orderBy(F.desc(F.round("p", 12)), "category")
        return self.marginals().withColumn("_r", F.row_number().over(w)).where("_r = 1").select("feature", "category")

    def entropy(self) -> DataFrame:
        return self.marginals().where(F.col("p") > EPS).groupBy("feature").agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))

    def mutual_information(self) -> DataFrame:
        """(feature_i, feature_j, mi) for i < j, in nats.

        A product of the features' matrices (category, cluster) by blocks: a task has the features of two blocks of BLOCK, and
        makes the joint probabilities of each of their pairs by one matrix product over the clusters.
        """
        order = sorted(self.features)
        block = F.create_map(*(F.lit(x) for i, f in enumerate(order) for x in (f, i // BLOCK)))
        n, c = -(-len(order) // BLOCK), self.n_clusters
        cells = self.theta.where(F.col("feature").isin(order)).withColumn("g", F.element_at(block, F.col("feature")))
        cells = cells.join(self.pi.withColumnRenamed("log_p", "log_pi"), "cluster")
        keys = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda h: F.struct(F.least(h, F.col("g")).alias("i"), F.greatest(h, F.col("g")).alias("j")))
        dealt = cells.select(F.explode(keys).alias("at"), "feature", "category", "cluster", "log_p", "log_pi").select("at.i", "at.j", "feature", F.col("category").cast("int").alias("category"), F.col("cluster").cast("int").alias("cluster"), "log_p", "log_pi")

        def run(table: pa.Table) -> pa.Table:
            feature, own = np.asarray(table.column("feature").to_pylist(), object), {}
            category, cluster, log_p = (np.asarray(table.column(x)) for x in ("category", "cluster", "log_p"))
            prior = np.zeros(c)
            prior[cluster] = np.exp(np.asarray(table.column("log_pi")))
            for f in sorted(set(feature)):
                at = feature == f
                _, place = np.unique(category[at], return_inverse=True)
                own[f] = np.zeros((place.max() + 1, c))
                own[f][place, cluster[at]] = np.exp(log_p[at])
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            place_of = {f: k // BLOCK for k, f in enumerate(order)}
            out = []
            for a in own:
                for b in own:
                    if a < b and (place_of[a], place_of[b]) == (i, j):
                        p = (own[a] * prior) @ own[b].T
                        with np.errstate(divide="ignore", invalid="ignore"):
                            term = np.where(p > EPS, p * np.log((p + EPS) / (p.sum(1)[:, None] * p.sum(0) + EPS)), 0.0)
                        out.append((a, b, max(float(term.sum()), 0.0)))
            return pa.table({"feature_i": pa.array([r[0] for r in out], pa.string()), "feature_j": pa.array([r[1] for r in out], pa.string()), "mi": pa.array([r[2] for r in out], pa.float64())})

        return dealt.groupBy("i", "j").applyInArrow(run, "feature_i string, feature_j string, mi double")

    def mutual_information_cluster(self) -> DataFrame:
        """(feature, mi) between each feature and the cluster."""
        cells = self.theta.join(self.pi.withColumnRenamed("log_p", "log_pi"), "cluster").withColumn("p", F.exp(F.col("log_p") + F.col("log_pi")))
        cells = cells.withColumn("p_k", F.sum("p").over(W.partitionBy("feature", "category")))
        term = F.when(F.col("p") > EPS, F.col("p") * F.ln((F.col("p") + EPS) / (F.col("p_k") * F.exp("log_pi") + EPS))).otherwise(0.0)
        return cells.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))

    def mutual_information_matrix(self) -> DataFrame:
        """(feature_i, feature_j, value): symmetric, with entropies on the diagonal."""
        mi = self.mutual_information()
        mirror = mi.select(F.col("feature_j").alias("feature_i"), F.col("feature_i").alias("feature_j"), "mi")
        diagonal = self.entropy().select(F.col("feature").alias("feature_i"), F.col("feature").alias("feature_j"), F.col("entropy").alias("mi"))
        return mi.unionByName(mirror).unionByName(diagonal).withColumnRenamed("mi", "value")

    def state(self) -> DataFrame:
        """(cluster, n, n_finite, n_impossible, total): of each cluster its log-probabilities, those that are finite and minus infinity, and the sum of probabilities, which is the number of features."""
        finite = F.col("log_p") > F.lit(NEG_INF)
        return self.theta.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(finite).alias("n_finite"), F.count_if(~finite).alias("n_impossible"), F.sum(F.exp("log_p")).alias("total"))

    def save(self, path: str) -> None:
        """Writes pi and theta as Parquet under path."""
        self.pi.write.mode("overwrite").parquet(f"{path}/pi")
        self.theta.write.mode("overwrite").parquet(f"{path}/theta")

    @classmethod
    def load(cls, spark, path: str, features: list[str]) -> Model:
        pi = spark.read.parquet(f"{path}/pi")
        return cls(pi, spark.read.parquet(f"{path}/theta"), pi.count(), tuple(features))


def _better(state: Column, entry: Column, post: Column) -> Column:
    """Keeps the category of larger probability; entries come in category order, so ties keep the lower."""
    p = F.round(F.aggregate(F.zip_with(post, entry["arr"], lambda a, b: F.exp(a + b)), F.lit(0.0), lambda s, x: s + x), 12)
    return F.when(p > state["p"], F.struct(p.alias("p"), entry["category"].cast("int").alias("k"))).otherwise(state)


def dirichlet_score(params: DataFrame, keys: list[str], alpha: str = "alpha", log_p: str = "log_p") -> DataFrame:
    """(keys, score): log density of Dirichlet(alpha) at exp(log_p), over the rows of each key."""
    terms = F.sum((F.col(alpha) - 1) * F.col(log_p)) - F.sum(lgamma(F.col(alpha))) + lgamma(F.sum(alpha))
    return params.groupBy(*keys).agg(terms.alias("score"))


def alpha_pi_posterior(pi: DataFrame, grid: list[float], prior: float = 1.0) -> DataFrame:
    """(alpha, log_post) of the concentration of pi over a grid, normalised."""
    stats = pi.agg(F.count("*").alias("c"), F.sum("log_p").alias("s"))
    rows = pi.sparkSession.createDataFrame([(float(a),) for a in grid], "alpha double").crossJoin(F.broadcast(stats))
    a, c = F.col("alpha"), F.col("c").cast("double")
    return _normalised(rows.select("alpha", (lgamma(c * a) - c * lgamma(a) + (a - 1) * F.col("s") + (prior - 1) * F.ln(a)).alias("v")))


def alpha_theta_posterior(theta: DataFrame, grid: list[float], prior: float = 1.0) -> DataFrame:
    """(alpha, log_post) of the concentration of theta; every (cluster, feature) has its own number of categories."""
    groups = theta.groupBy("cluster", "feature").agg(F.count("*").cast("double").alias("k"), F.sum("log_p").alias("s"))
    rows = theta.sparkSession.createDataFrame([(float(a),) for a in grid], "alpha double").crossJoin(groups)  # grid times model groups
    a, k = F.col("alpha"), F.col("k")
    total = rows.groupBy("alpha").agg(F.sum(lgamma(k * a) - k * lgamma(a) + (a - 1) * F.col("s")).alias("t"))
    return _normalised(total.select("alpha", (F.col("t") + (prior - 1) * F.ln(a)).alias("v")))


def _normalised(rows: DataFrame) -> DataFrame:
    w = W.partitionBy()
    top = F.max("v").over(w)
    return rows.withColumn("m", top).select("alpha", (F.col("v") - F.col("m") - F.ln(F.sum(F.exp(F.col("v") - F.col("m"))).over(w))).alias("log_post"))


def particle_weights(weights: DataFrame) -> DataFrame:
    """(particle, w): normalised from (particle, log_w)."""
    w = W.partitionBy()
    rows = weights.withColumn("m", F.max("log_w").over(w)).withColumn("e", F.exp(F.col("log_w") - F.col("m")))
    return rows.select("particle", (F.col("e") / F.sum("e").over(w)).alias("w"))


def particle_of_rows(rows: DataFrame, weights: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    """(row_id, particle): the particle that each new row is drawn from, by weight; equal weights give the uniform policy. One row of weights is sent to all."""
    packed = weights.agg(F.array_sort(F.collect_list(F.struct("particle", "w"))).alias("_w"))
    at = draw_index(F.transform("_w", lambda x: x["w"]), uniform(seed, "particle", F.col(row_id)))
    return rows.crossJoin(F.broadcast(packed)).select(row_id, F.get(F.transform("_w", lambda x: x["particle"]), at).alias("particle"))


def effective_sample_size(weights: DataFrame) -> DataFrame:
    return particle_weights(weights).agg((1 / F.sum(F.col("w") * F.col("w"))).alias("ess"))


def resample(weights: DataFrame, seed: int, step: int) -> DataFrame:
    """(particle, ancestor): multinomial ancestors by hashed uniforms."""
    w = particle_weights(weights)
    high = F.sum("w").over(W.orderBy("particle").rowsBetween(W.unboundedPreceding, 0))
    cum = w.withColumn("high", high).withColumn("low", F.col("high") - F.col("w"))
    draws = w.select("particle", uniform(seed, "resample", step, F.col("particle")).alias("u"))
    last = F.col("high") >= F.max("high").over(W.partitionBy())
    cum = cum.withColumn("high", F.when(last, 2.0).otherwise(F.col("high")))
    pairs = draws.join(F.broadcast(cum.select(F.col("particle").alias("ancestor"), "low", "high")), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))  # one row per particle
    return pairs.groupBy("particle").agg(F.min("ancestor").alias("ancestor"))


def weighted_log_likelihood(totals: DataFrame, weights: DataFrame) -> DataFrame:
    """lse over particles of dataset log-likelihood plus normalised log weight. totals: (particle, ll)."""
    both = totals.join(particle_weights(weights), "particle").withColumn("v", F.col("ll") + safe_ln(F.col("w")))
    return both.agg(lse_array(F.collect_list("v")).alias("log_likelihood"))


def averaged(theta: DataFrame) -> DataFrame:
    """Particles' theta averaged in probability and normalised: (cluster, feature, category, log_p)."""
    p = theta.groupBy("cluster", "feature", "category").agg(F.avg(F.exp("log_p")).alias("p"))
    return p.select("cluster", "feature", "category", safe_ln(F.col("p") / F.sum("p").over(W.partitionBy("cluster", "feature"))).alias("log_p"))
