"""Distances, nearest neighbours, clustering steps and text features over arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.plans.sqltext import statement

V = "(SELECT vec_id, label, CAST(embedding AS {A}) AS e FROM {embeddings})"
_SPARK, _DUCK = V.replace("{A}", "ARRAY<DOUBLE>"), V.replace("{A}", "DOUBLE[]")
Q, D = f"(SELECT vec_id AS q, e AS a FROM {_SPARK} WHERE vec_id % 100 = 0)", f"(SELECT vec_id AS q, e AS a FROM {_DUCK} WHERE vec_id % 100 = 0)"


def _both(name: str, sql: str, ours: str, theirs: str) -> None:
    statement(name, sql.replace("DIST", ours).replace("QUERIES", Q).replace("VECTORS", _SPARK), sql.replace("DIST", theirs).replace("QUERIES", D).replace("VECTORS", _DUCK))


def _fold(expr: str) -> tuple[str, str]:
    """Sum of an expression in x and y over two arrays."""
    theirs = expr.replace("x", "z[1]").replace("y", "z[2]").replace("e[1]p", "exp")
    return f"aggregate(zip_with(a, e, (x, y) -> {expr}), 0e0, (s, z) -> s + z)", f"list_sum(list_transform(list_zip(a, e), lambda z: {theirs}))"


DISTANCES = {"sqeuclidean": _fold("(x - y) * (x - y)"), "manhattan": _fold("abs(x - y)"), "dot": _fold("x * y"), "canberra": _fold("abs(x - y) / (abs(x) + abs(y))"), "minkowski3": _fold("abs(x - y) * abs(x - y) * abs(x - y)")}
for name, (ours, theirs) in DISTANCES.items():
    _both(f"distance_{name}", "SELECT q, vec_id, round(DIST, 6) AS d FROM QUERIES, VECTORS", ours, theirs)
SQ = DISTANCES["sqeuclidean"]
_both("nearest_neighbors", "SELECT q, vec_id, CAST(k AS BIGINT) AS k FROM (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY round(DIST, 9), vec_id) AS k FROM QUERIES, VECTORS) WHERE k <= 10", *SQ)
_both("radius_neighbors", "SELECT q, count(*) AS n FROM QUERIES, VECTORS WHERE DIST <= 1.2e0 GROUP BY q", *SQ)
_both("knn_classifier", "SELECT q, label FROM (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, label) AS r FROM (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY round(DIST, 9), vec_id) AS k FROM QUERIES, VECTORS WHERE q <> vec_id) WHERE k <= 15 GROUP BY q, label) WHERE r = 1", *SQ)
_both("knn_regressor", "SELECT q, round(avg(label * 1e0), 6) AS y FROM (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY round(DIST, 9), vec_id) AS k FROM QUERIES, VECTORS WHERE q <> vec_id) WHERE k <= 15 GROUP BY q", *SQ)
_both("kernel_density", "SELECT q, round(ln(avg(exp(-DIST / 2))), 6) AS log_density FROM QUERIES, VECTORS GROUP BY q", *SQ)
_both("rbf_kernel", "SELECT q, vec_id, round(exp(-0.5e0 * DIST), 8) AS k FROM QUERIES, VECTORS", *SQ)
_both("polynomial_kernel", "SELECT q, vec_id, round((0.5e0 * DIST + 1) * (0.5e0 * DIST + 1), 6) AS k FROM QUERIES, VECTORS", *DISTANCES["dot"])
_both("filtered_search", "SELECT q, vec_id, CAST(k AS BIGINT) AS k FROM (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY round(DIST, 9), vec_id) AS k FROM QUERIES, VECTORS WHERE label % 2 = 0) WHERE k <= 5", *SQ)
_both("kmeans_assign", "SELECT vec_id, q AS center FROM (SELECT vec_id, q, row_number() OVER (PARTITION BY vec_id ORDER BY round(DIST, 9), q) AS k FROM QUERIES, VECTORS) WHERE k = 1", *SQ)
_both("kmeans_inertia", "SELECT round(sum(d), 3) AS inertia FROM (SELECT vec_id, min(DIST) AS d FROM QUERIES, VECTORS GROUP BY vec_id)", *SQ)
_both("ivf_lists", "SELECT center, count(*) AS n FROM (SELECT vec_id, q AS center, row_number() OVER (PARTITION BY vec_id ORDER BY round(DIST, 9), q) AS k FROM QUERIES, VECTORS) WHERE k = 1 GROUP BY center", *SQ)
_both("dbscan_core_points", "SELECT q, CASE WHEN count(*) >= 3 THEN 1 ELSE 0 END AS core FROM QUERIES, VECTORS WHERE DIST <= 1.2e0 GROUP BY q", *SQ)


def _near(radius: float):
    """Of the vectors of side 0, how many of side 1 are within the squared radius; near ties are measured anew."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        e = np.array(table["e"].to_pylist(), np.float64)
        ids, a, b = table["vec_id"].to_numpy()[side == 0], e[side == 0], e[side == 1]
        n = np.zeros(len(a), np.int64)
        if len(a) and len(b):
            d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
            x, y = np.nonzero(np.abs(d - radius) < 1e-9)
            d[x, y] = ((a[x] - b[y]) ** 2).sum(1)
            n = (d <= radius).sum(1)
        return pa.table({"vec_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


@query("dbscan_core_flags", "SELECT a.vec_id, CASE WHEN count(*) >= 3 THEN 1 ELSE 0 END AS core FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a, (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) <= 1.2e0 GROUP BY a.vec_id")
def dbscan_core_flags(spark: SparkSession, sf_dir: str, block: int = 2000) -> DataFrame:
    """Core flag of every vector, by exact counts over pairs of blocks."""
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    blocks = -(-x.count() // block) or 1
    x = x.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks).cast("long")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    pairs = x.select("vec_id", "e", F.lit(0).alias("side"), F.col("b").alias("i"), every.alias("j")).unionByName(x.select("vec_id", "e", F.lit(1).alias("side"), every.alias("i"), F.col("b").alias("j")))
    n = pairs.groupBy("i", "j").applyInArrow(_near(1.2), "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    return n.select("vec_id", (F.col("n") >= 3).cast("int").alias("core"))


statement("word_counts", "SELECT w, count(*) AS n FROM (SELECT explode(regexp_extract_all(text, '[a-z]+', 0)) AS w FROM {documents}) GROUP BY w", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+', 0)) AS w FROM {documents}) GROUP BY w")
statement("vocabulary_top", "SELECT w, n FROM (SELECT w, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, w) AS k FROM (SELECT explode(regexp_extract_all(text, '[a-z]+', 0)) AS w FROM {documents}) GROUP BY w) WHERE k <= 100", "SELECT w, n FROM (SELECT w, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, w) AS k FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+', 0)) AS w FROM {documents}) GROUP BY w) WHERE k <= 100")
statement("document_frequency", "SELECT w, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, explode(regexp_extract_all(text, '[a-z]+', 0)) AS w FROM {documents}) GROUP BY w", "SELECT w, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+', 0)) AS w FROM {documents}) GROUP BY w")
