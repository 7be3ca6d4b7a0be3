"""Graphs as edge tables: components, PageRank, communities, label diffusion.

Every round is a join and a grouped aggregate on executors; rounds end with a checkpoint under the cluster's shared
folder, so lineage stays short and lost executors cost little.
"""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.learn.base import Classifier, Estimator, bounded_matrix, vector


def checkpoint(df: DataFrame) -> DataFrame:
    """df written under spark.checkpoint.dir and read back. Unset, a temporary folder serves local sessions alone."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        sc.setCheckpointDir(base)
    return df.checkpoint()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b) in either direction, for every id that has an edge.

    Alternating large-star and small-star rounds: logarithmically many, none with more rows than there are edges.
    Loops give their node a component of its own; null ends are ignored. An empty table gives an empty result.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct()
    e = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct())
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = checkpoint(small)
        now = tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == last:
            return nodes.join(e.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        last = now
    raise RuntimeError("components did not settle")


def pagerank(edges: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, every: int = 5) -> DataFrame:
    """(id, rank) by power iteration over edges (src, dst[, w]); the rank of nodes without out-edges goes to all nodes."""
    e = edges.select("src", "dst", (F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)).alias("w")).where("src is not null and dst is not null and w > 0")
    e = e.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("t"))
    e = checkpoint(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("w")))
    nodes = checkpoint(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(e.select(F.col("src").alias("id")).distinct().withColumn("has", F.lit(True)), "id", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    rank = nodes.select("id", "has", F.lit(1.0 / n).alias("rank"))
    for k in range(max_iter):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("has").isNull(), F.col("rank"))), F.lit(0.0))).first()[0]
        got = e.join(rank, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        new = rank.join(got, F.col("id") == F.col("dst"), "left").select("id", "has", F.col("rank").alias("old"), (F.lit((1 - damping) / n + damping * lost / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new = checkpoint(new)
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank = new.drop("old")
        if moved < tol * n:
            break
    _ = every
    return rank.select("id", "rank")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels (id, community) on undirected edges (a, b[, w])."""
    e = edges.select("a", "b", (F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)).alias("w"))
    la, lb = labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    x = e.join(la, "a").join(lb, "b")
    m = x.agg(F.sum("w")).first()[0]
    inside = x.where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    deg = x.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "w"), F.struct(F.col("cb").alias("c"), "w"))).alias("r")).select("r.*").groupBy("c").agg(F.sum("w").alias("d"))
    return inside / m - resolution * deg.agg(F.sum(F.col("d") * F.col("d"))).first()[0] / (4 * m * m)


class Louvain(Estimator):
    """Communities by modularity: nodes of half the colours (by a hash of id and round) move to the neighbouring
    community of the largest gain, ties to the lowest, until none gains; communities then become nodes."""

    defaults = {"resolution": 1.0, "max_levels": 10, "max_rounds": 20, "seed": 0}

    def fit(self, edges: DataFrame):
        e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)).alias("w")).where("a is not null and b is not null and w > 0")
        e = checkpoint(e.groupBy("a", "b").agg(F.sum("w").alias("w")))
        m = e.agg(F.sum("w")).first()[0] or 0.0
        members = e.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("community"))
        for level in range(self.max_levels):
            both = checkpoint(e.where("a <> b").unionByName(e.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
            loops = e.where("a = b").select(F.col("a").alias("id"), (2 * F.col("w")).alias("lw"))
            deg = both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")).join(loops, "id", "full").select("id", (F.coalesce("k", F.lit(0.0)) + F.coalesce("lw", F.lit(0.0))).alias("k"))
            state = checkpoint(deg.select("id", "k", F.col("id").alias("c")))
            moves = 0
            for r in range(self.max_rounds):
                tot = state.groupBy("c").agg(F.sum("k").alias("t"))
                near = both.join(state.select(F.col("id").alias("b"), F.col("c").alias("d")), "b").groupBy("a", "d").agg(F.sum("w").alias("w"))
                x = near.join(state, F.col("a") == F.col("id")).join(tot.select(F.col("c").alias("d"), "t"), "d")
                # gain of joining d over being alone; the node's own community is counted without it
                gain = F.col("w") - F.lit(self.resolution) * F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("d"), F.col("k")).otherwise(0.0)) / F.lit(2 * m)
                x = x.select("id", "c", "k", "d", F.round(gain, 9).alias("g"))
                best = x.groupBy("id").agg(F.max(F.struct("g", (-F.col("d")).alias("n"))).alias("top"), F.max(F.when(F.col("c") == F.col("d"), F.col("g"))).alias("stay"))
                turn = F.pmod(F.xxhash64("id", F.lit(r), F.lit(self.seed)), F.lit(2)) == 0
                new = state.join(best, "id", "left").select("id", "k", "c", F.when(turn & (F.col("top.g") > F.greatest(F.coalesce("stay", F.lit(0.0)), F.lit(0.0)) + 1e-9), -F.col("top.n")).otherwise(F.col("c")).alias("new"))
                new = checkpoint(new)
                moved = new.where("c <> new").count()
                state = new.select("id", "k", F.col("new").alias("c"))
                moves += moved
                if not moved and r % 2:
                    break
            if not moves:
                break
            members = checkpoint(members.join(state.select(F.col("id").alias("community"), "c"), "community", "left").select("id", F.coalesce("c", "community").alias("community")))
            s = state.select("id", "c")
            e = checkpoint(e.join(s.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(s.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
        low = members.groupBy("community").agg(F.min("id").alias("low"))
        self.labels = members.join(low, "community").select("id", F.col("low").alias("community"))
        self.state["levels"] = level + 1
        return self

    def fit_predict(self, edges: DataFrame) -> DataFrame:
        """(id, community): the smallest id of each community stands for it."""
        return self.fit(edges).labels


class LabelPropagation(Classifier):
    """Diffusion of known labels over the affinity of all rows (rbf, or k nearest neighbours), labels held fast.

    Rows with the label `unlabelled` get theirs. The driver holds all rows and each one's neighbours, or, for rbf, the
    affinities among rows whose labels can change while they take HELD bytes at most; beyond, every step computes
    them anew. More than `limit` rows, if given, are refused.
    """

    HELD = 300 << 20
    defaults = {"kernel": "rbf", "gamma": 20.0, "n_neighbors": 7, "max_iter": 1000, "tol": 1e-3, "alpha": None, "unlabelled": -1, "limit": None}

    def fit(self, df: DataFrame, features, label: str, id_col: str):
        self._seen(features)
        x, y, ids = bounded_matrix(df, features, label, id_col, limit=self.limit, order=id_col)
        known = y != self.unlabelled
        classes = sorted(set(y[known].tolist()))
        f = np.zeros((len(x), len(classes)))
        for k, c in enumerate(classes):
            f[y == c, k] = 1
        first = f.copy()
        product, degree = self._product(x, known)
        d = 1 / np.sqrt(np.maximum(degree, 1e-300))[:, None]
        for it in range(self.max_iter):
            if self.alpha is None:
                new = product(f) / np.maximum(degree, 1e-300)[:, None]
                new /= np.maximum(new.sum(1, keepdims=True), 1e-300)
                new[known] = first[known]
            else:
                new = self.alpha * (product(f * d) * d) + (1 - self.alpha) * first
            moved, f = np.abs(new - f).sum(), new
            if moved < self.tol:
                break
        p = f / np.maximum(f.sum(1, keepdims=True), 1e-300)
        self.state |= {"classes": classes, "ids": ids, "x": x, "distributions": p, "transduction": np.array(classes)[p.argmax(1)], "n_iter": it + 1}
        return self

    def _product(self, x, known):
        """(f -> affinities @ f, sums of the affinities) by row. Without alpha, known rows stay 0: theirs are not used."""
        from millrace.learn.cluster import first_k, sq_distances

        n, size = len(x), 512
        rows = np.nonzero(~known)[0] if self.alpha is None else np.arange(n)
        starts, degree = range(0, len(rows), size), np.zeros(n)
        if self.kernel != "rbf":
            near = np.concatenate([first_k(sq_distances(x[rows[at : at + size]], x), min(n, int(self.n_neighbors))) for at in starts] or [np.zeros((0, 1), int)])
            w = np.ones(near.shape) if self.alpha is None else (near != rows[:, None]).astype(float)
            degree[rows] = w.sum(1)

            def product(f):
                out = np.zeros_like(f)
                for c in range(near.shape[1]):
                    out[rows] += w[:, c, None] * f[near[:, c]]
                return out

            return product, degree

        def block(at, columns):
            own = rows[at : at + size]
            w = self._affinity(x[own], x[columns])
            if self.alpha is not None:
                w[np.arange(len(own)), own] = 0
            return w

        fixed = np.nonzero(known)[0] if self.alpha is None else np.zeros(0, int)
        keep = len(rows) ** 2 * 8 <= self.HELD
        held = {at: block(at, rows) for at in starts} if keep else None
        for at in starts:
            degree[rows[at : at + size]] = (held[at] if keep else block(at, rows)).sum(1) + (block(at, fixed).sum(1) if len(fixed) else 0)
        given = None

        def product(f):
            nonlocal given
            if given is None:  # what known rows give does not change
                given = np.concatenate([block(at, fixed) @ f[fixed] for at in starts] or [f[:0]]) if len(fixed) else 0
            out = np.zeros_like(f)
            if len(rows):
                out[rows] = np.concatenate([(held[at] if keep else block(at, rows)) @ f[rows] for at in starts]) + given
            return out

        return product, degree

    def _affinity(self, a, b):
        d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)
        if self.kernel == "rbf":
            return np.exp(-self.gamma * d)
        out = np.zeros_like(d)
        near = np.argsort(d, axis=1, kind="stable")[:, : int(self.n_neighbors)]
        np.put_along_axis(out, near, 1.0, 1)
        return out

    def labels(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(int(i), int(t)) for i, t in zip(self.ids_, self.transduction_)], "id long, label long")

    def predict_column(self, features):
        from millrace.learn.base import mapped

        x, p, classes = np.asarray(self.x_), np.asarray(self.distributions_), np.array(self.classes_)
        return mapped(lambda q: classes[(self._affinity(q, x) @ p).argmax(1)], features, "long")


class LabelSpreading(LabelPropagation):
    """The same with symmetric normalisation, where known labels keep a share 1 - alpha only."""

    defaults = {**LabelPropagation.defaults, "alpha": 0.2, "max_iter": 30}


_ = vector
