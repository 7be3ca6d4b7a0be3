"""Tests of the findings left open after round 2: methods on all pairs of rows, beyond what they took before."""

import numpy as np

from millrace.learn import cluster, decompose, neighbors


def points(spark, n=300, d=3, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d)).round(3)
    return x, spark.createDataFrame(list(enumerate(x.tolist())), "id long, x array<double>").coalesce(2)


def same_up_to_sign(a, b, atol=1e-5):
    return all(min(np.abs(u - v).max(), np.abs(u + v).max()) < atol for u, v in zip(a.T, b.T))


def test_locally_linear_embedding_of_many_rows(spark):
    _, df = points(spark)
    small, large = (decompose.LocallyLinearEmbedding(n_neighbors=8, limit=n).fit(df, "x", "id") for n in (4_000, 100))
    assert same_up_to_sign(small.embedding_, large.embedding_) and abs(small.reconstruction_error_ - large.reconstruction_error_) < 1e-8
    value = lambda m: np.array([r["v"] for r in df.orderBy("id").select(m.transform_column("x").alias("v")).collect()])
    assert same_up_to_sign(value(small), value(large))


def test_locally_linear_embedding_of_parts_that_are_apart(spark):
    x, _ = points(spark)
    x[:20] = x[:20] * 1e-3 + 50
    df = spark.createDataFrame(list(enumerate(x.tolist())), "id long, x array<double>")
    m = decompose.LocallyLinearEmbedding(limit=100).fit(df, "x", "id")
    y = m.embedding_
    assert np.allclose(y.T @ y, np.eye(2), atol=1e-8) and np.abs(y.sum(0)).max() < 1e-8 and m.reconstruction_error_ < 1e-3
    assert np.ptp(y[:20], axis=0).max() < 1e-3


def test_median_distance(spark):
    for n in (8, 300):
        x, _ = points(spark, n)
        d = ((x[:, None] - x) ** 2).sum(2)
        assert np.isclose(cluster.median_distance(spark, spark.sparkContext.broadcast(x), n), np.median(d[~np.eye(n, dtype=bool)]), atol=1e-12)
    x, _ = points(spark, 2_300)
    d = ((x[:, None] - x) ** 2).sum(2)
    assert np.isclose(cluster.median_distance(spark, spark.sparkContext.broadcast(x), 2_300), np.median(d[~np.eye(2_300, dtype=bool)]), atol=1e-12)


def test_affinity_propagation_of_many_rows(spark):
    _, df = points(spark)
    for given in ({}, {"damping": 0.7, "max_iter": 40}, {"preference": -20.0, "damping": 0.9}, {"max_iter": 3}):
        small, large = (cluster.AffinityPropagation(limit=n, **given).fit(df, "x", "id") for n in (3_000, 100))
        assert small.n_iter_ == large.n_iter_ and np.array_equal(small.labels_, large.labels_) and np.array_equal(small.cluster_centers_indices_, large.cluster_centers_indices_)


def test_isomap_of_many_rows(spark):
    x, df = points(spark)
    apart = x.copy()
    apart[:20], apart[100:130] = x[:20] + 50, x[100:130] - 70
    for rows in (df, spark.createDataFrame(list(enumerate(apart.tolist())), "id long, x array<double>")):
        small, large = (decompose.Isomap(limit=n).fit(rows, "x", "id") for n in (2_500, 100))
        assert same_up_to_sign(small.embedding_, large.embedding_) and np.isclose(small.reconstruction_error_, large.reconstruction_error_, rtol=1e-6)
        value = lambda m: np.array([r["v"] for r in df.orderBy("id").select(m.transform_column("x").alias("v")).collect()])
        assert same_up_to_sign(value(small), value(large))


def test_cagra_graph_has_no_limit_and_keeps_the_fewest_detours(spark):
    x, df = points(spark)
    m = neighbors.CagraIndex(graph_degree=8, intermediate_graph_degree=16).fit(df, "x", "id")
    assert m.limit is None and neighbors.CagraIndex().fit(df.limit(1), "x", "id").graph_.shape == (1, 0)
    d = ((x[:, None] - x) ** 2).sum(2).round(9)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :16]
    places = [dict(zip(row.tolist(), range(16))) for row in near]
    want = []
    for i in range(len(x)):
        detours = [sum(places[near[i, a]].get(near[i, b], 16) < b for a in range(b)) for b in range(16)]
        want.append(near[i, sorted(sorted(range(16), key=lambda b: (detours[b], b))[:8])])
    assert np.array_equal(m._pruned(near, np.arange(len(x)), 8), want) and np.array_equal(m.graph_[:, :4], np.array(want)[:, :4])
