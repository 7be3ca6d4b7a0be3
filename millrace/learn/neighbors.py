"""Nearest neighbours and vector indexes.

Queries go in blocks of a checked size to every task; each task keeps the best k of its own rows for every query, so
the indexed rows are never moved and what moves is k rows a query and task. Ties go to the lower id. Indexes are tables
with the list a row belongs to; searching one reads the probed lists alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.learn.base import Classifier, Estimator, Regressor, bounded_matrix, mapped, matrix, rows_of, total, vector
from millrace.learn.cluster import KMeans, by_blocks, near_rows, nearest, sq_distances

#: Queries that every task gets at a time.
QUERY_BLOCK = 2_000


def pairwise(metric: str, p: float = 2.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """(queries, rows) -> matrix of distances. 0 / 0 counts as 0; haversine is refused."""

    def by_row(f):
        return lambda a, b: np.stack([f(q, b) for q in a]) if len(a) else np.zeros((0, len(b)))

    def js(q, b):
        q, b = q / q.sum(), b / b.sum(1, keepdims=True)
        m = (q + b) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(q > 0, q * np.log(q / m), 0).sum(1)
            right = np.where(b > 0, b * np.log(b / m), 0).sum(1)
        return np.sqrt(np.maximum((left + right) / 2, 0))

    def share(num, den):
        return np.where(den > 0, num / np.where(den > 0, den, 1), 0.0)

    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    known = {
        "sqeuclidean": by_row(lambda q, b: ((b - q) ** 2).sum(1)),
        "euclidean": by_row(lambda q, b: np.sqrt(((b - q) ** 2).sum(1))),
        "manhattan": by_row(lambda q, b: np.abs(b - q).sum(1)),
        "chebyshev": by_row(lambda q, b: np.abs(b - q).max(1)),
        "minkowski": by_row(lambda q, b: (np.abs(b - q) ** p).sum(1) ** (1 / p)),
        "canberra": by_row(lambda q, b: share(np.abs(b - q), np.abs(b) + np.abs(q)).sum(1)),
        "braycurtis": by_row(lambda q, b: share(np.abs(b - q).sum(1), np.abs(b + q).sum(1))),
        "cosine": lambda a, b: 1 - unit(a) @ unit(b).T,
        "correlation": lambda a, b: 1 - unit(a - a.mean(1, keepdims=True)) @ unit(b - b.mean(1, keepdims=True)).T,
        "inner_product": lambda a, b: -(a @ b.T),
        "jensenshannon": by_row(js),
    }
    if metric not in known:
        raise ValueError(f"no metric {metric}")
    return known[metric]


def distance_column(metric: str, a: str, b: str, p: float = 2.0) -> Column:
    """The distance of two array columns, on the JVM."""
    x, y = F.col(a).cast("array<double>"), F.col(b).cast("array<double>")
    add = lambda f: F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda s, v: s + v)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, u: s + u * u))
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    if metric == "jensenshannon":
        total_ = lambda v: F.aggregate(v, F.lit(0.0), lambda s, u: s + u)
        pa_, pb = F.transform(x, lambda v: v / total_(x)), F.transform(y, lambda v: v / total_(y))
        part = lambda u, m: F.when(u > 0, u * F.ln(u / m)).otherwise(0.0)
        both = F.zip_with(pa_, pb, lambda u, v: part(u, (u + v) / 2) + part(v, (u + v) / 2))
        return F.sqrt(F.greatest(total_(both) / 2, F.lit(0.0)))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, u: s + u) / F.size(v)
    centred = lambda v: F.transform(v, lambda u: u - mean(v))
    known = {
        "sqeuclidean": lambda: add(lambda u, v: (u - v) * (u - v)),
        "euclidean": lambda: F.sqrt(add(lambda u, v: (u - v) * (u - v))),
        "manhattan": lambda: add(lambda u, v: F.abs(u - v)),
        "chebyshev": lambda: F.array_max(F.zip_with(x, y, lambda u, v: F.abs(u - v))),
        "minkowski": lambda: F.pow(add(lambda u, v: F.pow(F.abs(u - v), F.lit(float(p)))), F.lit(1 / p)),
        "canberra": lambda: add(lambda u, v: ratio(F.abs(u - v), F.abs(u) + F.abs(v))),
        "braycurtis": lambda: ratio(add(lambda u, v: F.abs(u - v)), add(lambda u, v: F.abs(u + v))),
        "cosine": lambda: 1 - add(lambda u, v: u * v) / (size(x) * size(y)),
        "correlation": lambda: 1 - F.aggregate(F.zip_with(centred(x), centred(y), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v) / (size(centred(x)) * size(centred(y))),
        "inner_product": lambda: -add(lambda u, v: u * v),
    }
    if metric not in known:
        raise ValueError(f"no metric {metric}")
    return known[metric]()


def _blocks(queries: DataFrame, features, id_col: str, size: int):
    """(ids, matrix) of all queries, a block at a time."""
    q = queries.select(F.col(id_col).cast("long").alias("id"), vector(features).alias("x"))
    n = q.count()
    for b in range(-(-n // size)):
        held = q.where(F.pmod(F.xxhash64("id"), F.lit(-(-n // size))) == b).toArrow()
        if held.num_rows:
            yield held["id"].to_numpy(), matrix(held["x"])


def top_rows(index: DataFrame, queries, k: int, metric: str = "euclidean", p: float = 2.0, radius: float | None = None, keep_self: bool = True) -> DataFrame:
    """(query, id, distance[, others of the index]) for the k nearest rows of index(id, x, ...) to each query block."""
    far = pairwise(metric, p)
    extra = [f for f in index.schema.fields if f.name not in ("id", "x")]
    schema = "query long, id long, distance double" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in extra)
    out = None
    for ids, z in queries:
        def run(batches, ids=ids, z=z):
            best: list = [None] * len(ids)
            for b in batches:
                if not b.num_rows:
                    continue
                c = {n: b.column(n) for n in b.schema.names}
                own, x = c["id"].to_numpy(zero_copy_only=False), matrix(c["x"])
                d = np.round(far(z, x), 12)
                for q in range(len(ids)):
                    ok = np.ones(len(own), bool) if keep_self else own != ids[q]
                    if radius is not None:
                        ok &= d[q] <= radius
                    at = np.nonzero(ok)[0]
                    if radius is None and len(at) > k:
                        cut = np.partition(d[q, at], k - 1)[k - 1]
                        at = at[d[q, at] <= cut]
                    rows = [(d[q, i], own[i], *(c[f.name][int(i)].as_py() for f in extra)) for i in at]
                    held = (best[q] or []) + rows
                    best[q] = sorted(held, key=lambda r: r[:2])[:k] if radius is None else held
            flat = [(ids[q], r[1], r[0], *r[2:]) for q in range(len(ids)) for r in best[q] or []]
            types = [pa.int64(), pa.int64(), pa.float64(), *[None] * len(extra)]
            yield pa.record_batch([pa.array([r[j] for r in flat], t) if t else _typed([r[j] for r in flat], extra[j - 3]) for j, t in enumerate(types)], ["query", "id", "distance", *[f.name for f in extra]])

        part = index.select("id", "x", *[f.name for f in extra]).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return index.sparkSession.createDataFrame([], schema)
    if radius is not None:
        return out
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return out.withColumn("_mr_k", rank).where(F.col("_mr_k") <= k).drop("_mr_k")


def _typed(values, field):
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.array(values, to_arrow_type(field.dataType))


class NearestNeighbors(Estimator):
    """The k nearest rows of each query, exactly; ties go to the lower id."""

    defaults = {"n_neighbors": 5, "metric": "euclidean", "p": 2.0, "radius": 1.0, "query_block": QUERY_BLOCK}

    def fit(self, df: DataFrame, features, id_col: str, *others: str):
        self.state["features"] = features if isinstance(features, str) else list(features)
        self.index = df.select(F.col(id_col).cast("long").alias("id"), vector(features).alias("x"), *others)
        return self

    def kneighbors(self, queries: DataFrame, id_col: str, k: int | None = None, features=None, mask: Column | None = None, keep_self: bool = True) -> DataFrame:
        """(query, id, distance, rank), rank from 0; `mask` keeps the rows of the index that may be found."""
        index = self.index if mask is None else self.index.where(mask)
        found = top_rows(index, _blocks(queries, features or self.features_, id_col, int(self.query_block)), int(k or self.n_neighbors), self.metric, self.p, keep_self=keep_self)
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id")) - 1)

    def radius_neighbors(self, queries: DataFrame, id_col: str, radius: float | None = None, features=None) -> DataFrame:
        """(query, id, distance) of all rows within the radius."""
        return top_rows(self.index, _blocks(queries, features or self.features_, id_col, int(self.query_block)), 0, self.metric, self.p, radius=float(radius if radius is not None else self.radius))


class RadiusNeighbors(NearestNeighbors):
    """Neighbours within a radius are its main answer."""


class RandomBallCover(NearestNeighbors):
    """The same answer, with rows filed under their nearest of about sqrt(n) landmarks: a query reads only balls that the
    triangle inequality cannot rule out, given the k-th distance within its own nearest balls."""

    defaults = {**NearestNeighbors.defaults, "landmarks": None, "seed": 0}

    def fit(self, df, features, id_col, *others):
        super().fit(df, features, id_col, *others)
        n = self.index.count()
        m = int(self.landmarks or max(1, min(4096, round(math.sqrt(n)))))
        c = matrix(self.index.orderBy(F.xxhash64(F.lit(self.seed), "id"), "id").limit(m).toArrow()["x"])
        filed = self.index.withColumn("ball", mapped(lambda x: nearest(x, c)[0], "x", "int")).withColumn("far", mapped(lambda x: np.sqrt(nearest(x, c)[1]), "x"))
        self.balls = filed
        held = filed.groupBy("ball").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("n")).collect()
        self.state |= {"landmarks": c, "radii": {int(r["ball"]): [float(r["r"]), int(r["n"])] for r in held}}
        return self

    def kneighbors(self, queries, id_col, k=None, features=None, mask=None, keep_self=True):
        if self.metric != "euclidean":
            raise ValueError("ball covers need the euclidean metric")
        k, c, radii = int(k or self.n_neighbors), np.asarray(self.landmarks_), self.radii_
        size = np.array([radii.get(b, [0, 0])[1] for b in range(len(c))])
        reach = np.array([radii.get(b, [-np.inf, 0])[0] for b in range(len(c))])
        out = None
        for ids, z in _blocks(queries, features or self.features_, id_col, int(self.query_block)):
            d = np.sqrt(sq_distances(z, c))
            order = np.argsort(d, axis=1, kind="stable")
            # a bound on the k-th distance: enough of the nearest balls hold k rows within centre distance + radius
            bound = np.empty(len(z))
            for q in range(len(z)):
                enough = np.searchsorted(np.cumsum(size[order[q]]), k + (not keep_self))
                bound[q] = (d[q] + np.maximum(reach, 0))[order[q][: enough + 1]].max() if mask is None else np.inf
            probe = (d - reach[None] <= bound[:, None]) & (size > 0)[None]
            need = np.nonzero(probe.any(0))[0].tolist()
            own = self.balls.where(F.col("ball").isin(need)).drop("ball", "far")
            part = top_rows(own if mask is None else own.where(mask), [(ids, z)], k, keep_self=keep_self)
            out = part if out is None else out.unionByName(part)
        return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id")) - 1)


class _Voting(NearestNeighbors):
    """Predictions by neighbours: a table of queries, since neighbours come from a search, not from a row alone."""

    defaults = {**NearestNeighbors.defaults, "weights": "uniform"}

    def fit(self, df, features, label: str, id_col: str):
        self.state["label"] = label
        NearestNeighbors.fit(self, df.withColumn("_mr_y", F.col(label)), features, id_col, "_mr_y")
        return self

    def _found(self, queries, id_col, keep_self):
        f = self.kneighbors(queries, id_col, keep_self=keep_self)
        if self.weights == "distance":
            zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query"))
            return f.withColumn("w", F.when(zero == 1, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance")))
        return f.withColumn("w", F.lit(1.0))


class KNeighborsClassifier(_Voting):
    def predict_proba(self, queries, id_col, keep_self=True) -> DataFrame:
        """(query, label, p) for labels that have a neighbour."""
        f = self._found(queries, id_col, keep_self).groupBy("query", F.col("_mr_y").alias("label")).agg(F.sum("w").alias("w"))
        return f.select("query", "label", (F.col("w") / F.sum("w").over(Window.partitionBy("query"))).alias("p"))

    def predict(self, queries, id_col, keep_self=True) -> DataFrame:
        """(query, prediction); ties take the lower label."""
        p = self.predict_proba(queries, id_col, keep_self).withColumn("p", F.round("p", 12))
        return p.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("p"), "label"))).where("k = 1").select("query", F.col("label").alias("prediction"))


class KNeighborsRegressor(_Voting):
    def predict(self, queries, id_col, keep_self=True) -> DataFrame:
        f = self._found(queries, id_col, keep_self)
        return f.groupBy("query").agg((F.sum(F.col("w") * F.col("_mr_y").cast("double")) / F.sum("w")).alias("prediction"))


class LocalOutlierFactor(NearestNeighbors):
    """Outlier factors of all rows from two rounds of neighbours; blocks of queries keep every step bounded."""

    defaults = {**NearestNeighbors.defaults, "n_neighbors": 20, "contamination": None}

    def fit_predict(self, df: DataFrame, features, id_col: str) -> DataFrame:
        """(id, factor, prediction): -1 beyond the contamination's quantile, or a factor above 1.5 without one."""
        self.fit(df, features, id_col)
        near = self.kneighbors(df, id_col, keep_self=False)
        from millrace.learn.graph import checkpoint

        near = checkpoint(near)
        reach = near.groupBy("query").agg(F.max("distance").alias("kd"))
        x = near.join(reach.select(F.col("query").alias("id"), "kd"), "id").withColumn("r", F.greatest("distance", "kd"))
        lrd = x.groupBy("query").agg((1 / (F.avg("r") + 1e-10)).alias("lrd"))
        lof = near.join(lrd.select(F.col("query").alias("id"), F.col("lrd").alias("other")), "id").groupBy("query").agg(F.avg("other").alias("m")).join(lrd, "query").select(F.col("query").alias("id"), (F.col("m") / F.col("lrd")).alias("factor"))
        lof = checkpoint(lof)
        cut = 1.5 if self.contamination is None else lof.agg(F.percentile("factor", 1 - float(self.contamination))).first()[0]
        self.state["offset"] = -float(cut)
        return lof.withColumn("prediction", F.when(F.col("factor") > F.lit(float(cut)), -1).otherwise(1))


def refine(candidates: DataFrame, queries: DataFrame, index: DataFrame, features, id_col: str, k: int, metric: str = "euclidean") -> DataFrame:
    """The k best of each query's candidate ids by exact distance. candidates: (query, id); -1 stands for none."""
    q = queries.select(F.col(id_col).cast("long").alias("query"), vector(features).alias("a"))
    x = index.select(F.col(id_col).cast("long").alias("id"), vector(features).alias("b"))
    d = candidates.where("id >= 0").distinct().join(q, "query").join(x, "id").select("query", "id", F.round(distance_column(metric, "a", "b"), 12).alias("distance"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id")) - 1).where(F.col("rank") < k)


def fill(found: DataFrame, queries: DataFrame, id_col: str, k: int) -> DataFrame:
    """(query, rank, id, distance) with exactly k rows a query: missing ones are id -1 at infinite distance."""
    every = queries.select(F.col(id_col).cast("long").alias("query")).select("query", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("rank"))
    return every.join(found.select("query", "rank", "id", "distance"), ["query", "rank"], "left").select("query", "rank", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("distance", F.lit(math.inf)).alias("distance"))


class IVFIndex(Estimator):
    """Rows filed under their nearest of n_lists centres; a query scans the n_probes nearest lists.

    Centres are fitted on up to `sample` rows of the smallest keys (the documented bound of the fit); every row is
    filed. extend() files further rows. A search reads the probed lists alone and ranks by exact distance.
    """

    defaults = {"n_lists": 16, "n_probes": 4, "n_neighbors": 10, "metric": "sqeuclidean", "sample": 100_000, "kmeans_n_iters": 20, "query_block": QUERY_BLOCK, "seed": 0}

    def fit(self, df: DataFrame, features, id_col: str):
        self.state["features"] = features if isinstance(features, str) else list(features)
        base = df.select(F.col(id_col).cast("long").alias("id"), vector(features).alias("x"))
        some = base.orderBy(F.xxhash64(F.lit(self.seed), "id"), "id").limit(int(self.sample))
        self.state["centers"] = KMeans(n_clusters=int(self.n_lists), max_iter=int(self.kmeans_n_iters), seed=self.seed).fit(some, "x").cluster_centers_
        self.lists = self._filed(base)
        return self

    def _filed(self, base):
        c = np.asarray(self.centers_)
        return base.withColumn("list", mapped(lambda x: nearest(x, c)[0], "x", "int"))

    def extend(self, df: DataFrame, id_col: str):
        self.lists = self.lists.unionByName(self._filed(df.select(F.col(id_col).cast("long").alias("id"), vector(self.features_).alias("x"))))
        return self

    def write(self, path: str) -> None:
        """The lists as a table partitioned by list, so that a search prunes files."""
        self.lists.write.mode("overwrite").partitionBy("list").parquet(path)
        self.lists = self.lists.sparkSession.read.parquet(path)

    def _probed(self, z: np.ndarray) -> np.ndarray:
        return np.argsort(np.round(sq_distances(z, np.asarray(self.centers_)), 9), axis=1, kind="stable")[:, : int(self.n_probes)]

    def _score(self, c: dict, z: np.ndarray, q: np.ndarray, far) -> np.ndarray:
        return far(z[q], matrix(c["x"]))

    def search(self, queries: DataFrame, id_col: str, k: int | None = None, mask: Column | None = None) -> DataFrame:
        """(query, rank, id, distance), filled up with -1 at infinity; `mask` is applied before the k best are taken."""
        k, far, out = int(k or self.n_neighbors), pairwise(self.metric), None
        rows = self.lists if mask is None else self.lists.where(mask)
        keep = [c for c in rows.columns if c in ("id", "x", "list", "codes", "scale", "bits", "norm", "ip")]
        for ids, z in _blocks(queries, self.features_, id_col, int(self.query_block)):
            probe = self._probed(z)
            wants: dict[int, list[int]] = {}
            for q, own in enumerate(probe):
                for v in own.tolist():
                    wants.setdefault(v, []).append(q)

            def run(batches, ids=ids, z=z, wants=wants):
                best: list[list] = [[] for _ in ids]
                for b in batches:
                    lists = b.column("list").to_numpy()
                    for v in np.unique(lists).tolist():
                        if v not in wants:
                            continue
                        part = b.filter(pa.array(lists == v))
                        c = {n: part.column(n) for n in part.schema.names}
                        own, qs = c["id"].to_numpy(zero_copy_only=False), np.array(wants[v])
                        d = np.round(self._score(c, z, qs, far), 9)
                        for r, q in enumerate(qs):
                            at = np.argsort(d[r], kind="stable")[: k + 8] if len(own) > k else np.arange(len(own))
                            best[q] = sorted(best[q] + list(zip(d[r, at].tolist(), own[at].tolist())))[:k]
                flat = [(ids[q], i, d) for q in range(len(ids)) for d, i in best[q]]
                yield pa.record_batch([pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], pa.int64()), pa.array([r[2] for r in flat], pa.float64())], ["query", "id", "distance"])

            part = rows.where(F.col("list").isin(list(wants))).select(*keep).mapInArrow(run, "query long, id long, distance double")
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.lists.sparkSession.createDataFrame([], "query long, rank int, id long, distance double")
        found = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id")) - 1).where(F.col("rank") < k)
        return fill(found, queries, id_col, k)

    def recall(self, queries: DataFrame, id_col: str, k: int | None = None) -> float:
        """Share of the exact k nearest that a search finds."""
        k = int(k or self.n_neighbors)
        exact = top_rows(self.lists.select("id", "x"), _blocks(queries, self.features_, id_col, int(self.query_block)), k, self.metric)
        got = self.search(queries, id_col, k).where("id >= 0").select("query", "id")
        return exact.join(got, ["query", "id"], "left_semi").count() / max(1, exact.count())


class DistributedIVFIndex(IVFIndex):
    """The same lists dealt to partitions by list: each shard is searched where it lies and the best are merged."""

    defaults = {**IVFIndex.defaults, "shards": 8}

    def _filed(self, base):
        return super()._filed(base).repartition(int(self.shards), "list")


class IVFSQIndex(IVFIndex):
    """Residuals from the centre as bytes, scaled by each component's largest absolute residual."""

    def fit(self, df, features, id_col):
        super().fit(df, features, id_col)
        c = np.asarray(self.centers_)

        def part(x):
            return {"top": np.abs(x - c[nearest(x, c)[0]]).max(0)}

        top = _maxima(self.lists.select("x"), part)
        self.state["scale"] = np.maximum(top, 1e-12) / 127
        self.lists = self._coded(self.lists)
        return self

    def _coded(self, lists):
        c, s = np.asarray(self.centers_), np.asarray(self.scale_)
        return lists.withColumn("codes", mapped(lambda x: np.rint((x - c[nearest(x, c)[0]]) / s), "x", "array<double>").cast("array<tinyint>"))

    def extend(self, df, id_col):
        self.lists = self.lists.unionByName(self._coded(self._filed(df.select(F.col(id_col).cast("long").alias("id"), vector(self.features_).alias("x")))))
        return self

    def _score(self, c, z, q, far):
        codes = c["codes"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c["codes"]), -1)
        return far(z[q], np.asarray(self.centers_)[c["list"].to_numpy()] + codes * np.asarray(self.scale_))


def _maxima(rows, fn):
    def run(batches):
        best = None
        for b in batches:
            if b.num_rows:
                v = fn(matrix(b.column(0)))["top"]
                best = v if best is None else np.maximum(best, v)
        if best is not None:
            yield pa.record_batch([pa.array([best.tolist()], pa.list_(pa.float64()))], ["top"])

    long = rows.mapInArrow(run, "top array<double>").select(F.posexplode("top").alias("k", "v")).groupBy("k").agg(F.max("v").alias("v")).orderBy("k").collect()
    return np.array([r["v"] for r in long])


class IVFPQIndex(IVFIndex):
    """Residuals cut into pq_dim pieces, each the number of its nearest of 2**pq_bits codewords; distances are sums of a
    table per query and list. refine() with the exact rows restores the order."""

    defaults = {**IVFIndex.defaults, "pq_dim": 8, "pq_bits": 6, "pq_kmeans_n_iters": 15}

    def fit(self, df, features, id_col):
        super().fit(df, features, id_col)
        c, m = np.asarray(self.centers_), int(self.pq_dim)
        some = self.lists.orderBy(F.xxhash64(F.lit(self.seed), "id"), "id").limit(min(int(self.sample), 50_000)).select("x")
        res = some.select(mapped(lambda x: x - c[nearest(x, c)[0]], "x", "array<double>").alias("x")).toArrow()
        r = matrix(res["x"])
        pieces = np.array_split(np.arange(r.shape[1]), m)
        books = []
        for p in pieces:
            z = r[:, p]
            k = min(2 ** int(self.pq_bits), len(z))
            rng = np.random.default_rng(self.seed)
            b = z[np.sort(rng.choice(len(z), k, replace=False))]
            for _ in range(int(self.pq_kmeans_n_iters)):
                at = sq_distances(z, b).argmin(1)
                n = np.bincount(at, minlength=k)
                s = np.stack([np.bincount(at, z[:, j], k) for j in range(z.shape[1])], 1)
                b = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], b)
            books.append(b)
        self.state |= {"pieces": [p.tolist() for p in pieces], "books": [b.tolist() for b in books]}
        self.lists = self._coded(self.lists)
        return self

    def _coded(self, lists):
        c, pieces, books = np.asarray(self.centers_), self.pieces_, [np.array(b) for b in self.books_]

        def fn(x):
            r = x - c[nearest(x, c)[0]]
            return np.column_stack([sq_distances(r[:, p], b).argmin(1) for p, b in zip(pieces, books)]).astype(float)

        return lists.withColumn("codes", mapped(fn, "x", "array<double>").cast("array<smallint>"))

    extend = IVFSQIndex.extend

    def _score(self, c, z, q, far):
        codes = c["codes"].flatten().to_numpy(zero_copy_only=False).astype(int).reshape(len(c["codes"]), -1)
        center = np.asarray(self.centers_)[int(c["list"][0].as_py())]
        out = np.zeros((len(q), len(codes)))
        for j, (p, b) in enumerate(zip(self.pieces_, self.books_)):
            out += sq_distances(z[q][:, p] - center[p], np.array(b))[:, codes[:, j]]
        return out


class IVFRaBitQIndex(IVFIndex):
    """Residuals turned by one random rotation and kept as signs, with their length and the sign vector's fit; distances
    are estimated from the inner product with the signs. refine() restores the exact order."""

    def fit(self, df, features, id_col):
        super().fit(df, features, id_col)
        d = np.asarray(self.centers_).shape[1]
        self.state["rotation"] = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(d, d)))[0]
        self.lists = self._coded(self.lists)
        return self

    def _coded(self, lists):
        c, rot = np.asarray(self.centers_), np.asarray(self.rotation_)

        def fn(x):
            r = (x - c[nearest(x, c)[0]]) @ rot
            size = np.linalg.norm(r, axis=1)
            u = r / np.maximum(size, 1e-300)[:, None]
            fit = np.abs(u).sum(1) / math.sqrt(r.shape[1])
            return np.column_stack([size, fit, r > 0])

        y = lists.withColumn("_v", mapped(fn, "x", "array<double>"))
        return y.withColumn("norm", F.col("_v")[0]).withColumn("ip", F.col("_v")[1]).withColumn("bits", F.slice("_v", 3, 1 << 20).cast("array<tinyint>")).drop("_v")

    extend = IVFSQIndex.extend

    def _score(self, c, z, q, far):
        bits = c["bits"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c["bits"]), -1)
        norm, ip = c["norm"].to_numpy(zero_copy_only=False), c["ip"].to_numpy(zero_copy_only=False)
        r = (z[q] - np.asarray(self.centers_)[int(c["list"][0].as_py())]) @ np.asarray(self.rotation_)
        dot = r @ (2 * bits - 1).T / math.sqrt(bits.shape[1]) / np.maximum(ip, 1e-9)[None] * norm[None]
        return (r * r).sum(1)[:, None] + (norm * norm)[None] - 2 * dot


class CagraIndex(Estimator):
    """A graph of each row's nearest neighbours, pruned of detours, searched greedily from keyed seeds.

    Tasks find and prune the neighbours of blocks of rows; to search, every task gets the rows and the graph whole.
    More than `limit` rows, if given, are refused. Queries are any number. A filter is applied to the final list, as
    first k passing entries of the itopk candidates.
    """

    defaults = {"graph_degree": 16, "intermediate_graph_degree": 32, "itopk_size": 64, "n_seeds": 32, "n_neighbors": 10, "seed": 0, "limit": None}

    def fit(self, df: DataFrame, features, id_col: str):
        self.state["features"] = features if isinstance(features, str) else list(features)
        x, ids = bounded_matrix(df, features, id_col, limit=self.limit, order=id_col)
        n, wide, deg = len(x), int(self.intermediate_graph_degree), int(self.graph_degree)
        wide = min(wide, n - 1)
        graph, back = np.empty((n, min(deg, wide)), int), [[] for _ in range(n)]
        if wide:
            spark, keep, pruned = df.sparkSession, graph.shape[1], self._pruned
            shared = spark.sparkContext.broadcast(x)
            near = near_rows(spark, shared, n, wide, False, root=False, digits=9)[0]
            shared.destroy()
            shared = spark.sparkContext.broadcast(near.astype(np.int32))
            graph = by_blocks(spark, shared, n, lambda near, own: pruned(near, own, keep)).astype(int)
            shared.destroy()
        for i, ends in enumerate(graph[:, : max(1, graph.shape[1] // 2)].tolist()):
            for j in ends:
                back[j].append(i)
        half = graph.shape[1] // 2
        for i in range(n):
            extra = [j for j in back[i] if j not in set(graph[i].tolist())][: graph.shape[1] - half]
            if extra:
                graph[i, graph.shape[1] - len(extra) :] = extra
        self.state |= {"x": x, "ids": ids, "graph": graph}
        return self

    @staticmethod
    def _pruned(near: np.ndarray, own: np.ndarray, keep: int) -> np.ndarray:
        """The neighbours kept of each row: those with the fewest detours, an edge being one if an earlier neighbour reaches its end by an earlier edge."""
        wide, out = near.shape[1], np.empty((len(own), keep), np.int64)
        earlier = np.arange(wide)[:, None] < np.arange(wide)
        for r, i in enumerate(own):
            # reached[a, b]: near[i, a] has near[i, b] among its first b neighbours
            order = np.argsort(near[i])
            ends = near[near[i]]
            at = np.minimum(np.searchsorted(near[i], ends, sorter=order), wide - 1)
            found = near[i][order[at]] == ends
            a, place = np.nonzero(found)
            b = order[at[a, place]]
            reached = np.zeros((wide, wide), bool)
            reached[a[place < b], b[place < b]] = True
            detours = (reached & earlier).sum(0)
            out[r] = near[i][np.sort(np.argsort(detours, kind="stable")[:keep])]
        return out

    def search(self, queries: DataFrame, id_col: str, k: int | None = None, allowed=None) -> DataFrame:
        """(query, rank, id, distance), filled with -1 at infinity; `allowed` holds the ids that may be found."""
        k, x, ids, graph = int(k or self.n_neighbors), np.asarray(self.x_), np.asarray(self.ids_), np.asarray(self.graph_)
        top, seeds = max(int(self.itopk_size), k), int(self.n_seeds)
        start = np.random.default_rng(self.seed).permutation(len(x))[:seeds]
        ok = None if allowed is None else set(int(v) for v in allowed)

        def fn(z):
            out = np.full((len(z), 2 * k), -1.0)
            out[:, k:] = np.inf
            for q in range(len(z)):
                d = {int(i): round(float(((x[i] - z[q]) ** 2).sum()), 9) for i in start}
                done: set[int] = set()
                while True:
                    best = sorted(d.items(), key=lambda p: (p[1], p[0]))[:top]
                    open_ = [i for i, _ in best if i not in done][:4]
                    if not open_:
                        break
                    done.update(open_)
                    new = [j for i in open_ for j in graph[i].tolist() if j not in d]
                    if new:
                        new = list(dict.fromkeys(new))
                        for j, v in zip(new, ((x[new] - z[q]) ** 2).sum(1)):
                            d[j] = round(float(v), 9)
                hits = [(i, v) for i, v in best if ok is None or int(ids[i]) in ok][:k]
                for r, (i, v) in enumerate(hits):
                    out[q, r], out[q, k + r] = ids[i], v
            return out

        found = queries.select(F.col(id_col).cast("long").alias("query"), mapped(fn, self.features_, "array<double>").alias("r"))
        return found.select("query", F.posexplode(F.slice("r", 1, k)).alias("rank", "id"), "r").select("query", "rank", F.col("id").cast("long").alias("id"), F.element_at("r", F.col("rank") + 1 + k).alias("distance"))


class ParallelQueries:
    """Queries spread over tasks, each of which has the whole (checked, small) index: predictions as a column."""

    def __init__(self, df: DataFrame, features, id_col: str, k: int = 5, metric: str = "euclidean", limit: int = 100_000):
        self.features, self.k, self.metric = features, k, metric
        self.x, self.ids = bounded_matrix(df, features, id_col, limit=limit, order=id_col)

    def ids_column(self, features=None) -> Column:
        x, ids, k, far = self.x, np.asarray(self.ids), self.k, pairwise(self.metric)
        return mapped(lambda q: ids[np.argsort(np.round(far(q, x), 12), axis=1, kind="stable")[:, :k]].astype(np.int64), features or self.features, "array<long>")


_ = (Classifier, Regressor, rows_of, total)
