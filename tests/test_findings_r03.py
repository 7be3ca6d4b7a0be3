"""Tests of the findings that FINDINGS_r02.md lists, on inputs that the code before refused or took too much for."""

import tracemalloc

import numpy as np

from millrace.learn import cluster, decompose, forecast, kernel, neighbors


def test_mixer_needs_little_more_than_its_tables():
    from millrace.llm import mixing_lm

    voc, table = mixing_lm.Vocabulary(np.array([(5, 9), (7, 3)]), 20, 4), np.zeros(mixing_lm.ALL_CELLS, np.int32)
    tracemalloc.start()
    mixer = mixing_lm.Mixer(table, voc)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * (mixer.spell.nbytes + sum(p.nbytes for p in mixer.path))


def points(spark, n=300, d=2, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d)).round(3)
    return x, spark.createDataFrame([(i, v, float(v[0] * 2 + v[1] ** 2), int(v[0] + v[1] > 0.2)) for i, v in enumerate(x.tolist())], "id long, x array<double>, y double, g int").coalesce(2)


def test_gaussian_processes_of_many_rows(spark):
    _, df = points(spark)
    value = lambda m, c: [r["v"] for r in df.orderBy("id").select(c(m).alias("v")).collect()]
    small, large = (kernel.GaussianProcessRegressor(optimize=False, normalize_y=True, limit=n).fit(df, "x", "y") for n in (3_000, 100))
    for c in (lambda m: m.predict_column("x"), lambda m: m.std_column("x")):
        assert np.allclose(value(small, c), value(large, c), atol=1e-6)
    assert abs(small.log_marginal_likelihood_ - large.log_marginal_likelihood_) < 1e-5
    small, large = (kernel.GaussianProcessClassifier(optimize=False, limit=n).fit(df, "x", "g") for n in (2_000, 100))
    assert np.allclose(value(small, lambda m: m.proba_column("x")), value(large, lambda m: m.proba_column("x")), atol=1e-6)


def test_one_class_svm_of_many_rows(spark):
    _, df = points(spark)
    small, large = (kernel.OneClassSVM(nu=0.1, tol=1e-9, limit=n).fit(df, "x") for n in (10_000, 100))
    score = lambda m: [r["v"] for r in df.orderBy("id").select(m.decision_column("x").alias("v")).collect()]
    assert np.allclose(score(small), score(large), atol=1e-6) and abs(small.dual_.sum() - large.dual_.sum()) < 1e-5


def same_up_to_sign(a, b, atol=1e-5):
    return all(min(np.abs(u - v).max(), np.abs(u + v).max()) < atol for u, v in zip(a.T, b.T))


def test_spectral_maps_of_many_rows(spark):
    _, df = points(spark)
    for kind in ("nearest_neighbors", "rbf"):
        small, large = (decompose.SpectralEmbedding(affinity=kind, limit=n).fit(df, "x", "id") for n in (4_000, 100))
        assert same_up_to_sign(small.embedding_, large.embedding_)
    small, large = (cluster.SpectralClustering(n_clusters=4, affinity="nearest_neighbors", limit=n).fit(df, "x", "id").labels_ for n in (5_000, 100))
    assert np.mean(small == large) > 0.98


def test_umap_of_many_rows(spark):
    _, df = points(spark)
    small, large = (decompose.UMAP(n_epochs=0, limit=n).fit(df, "x", "id").embedding_ for n in (5_000, 100))
    assert np.abs(small - large).max() < 1e-5  # later epochs blow up the last bits


def test_hdbscan_of_many_rows(spark):
    x, _ = points(spark)
    x = x + np.repeat([[0, 0], [30, 0], [0, 30]], 100, 0)
    core, edges = cluster.spanning_rows(spark, x, 5)
    # equal lengths abound, so the trees differ, but not in their lengths
    assert np.allclose(core, cluster.core_distances(x, 5)) and np.allclose([e[0] for e in edges], [e[0] for e in cluster.spanning_tree(x, core)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    small, large = (cluster.HDBSCAN(min_cluster_size=60, min_samples=5, limit=n).fit(df, "x", "id").labels_ for n in (20_000, 100))
    assert [len(set(large[k : k + 100].tolist())) for k in (0, 100, 200)] == [1, 1, 1] and np.array_equal(small, large) and large.max() == 2


def test_tsne_of_many_rows(spark):
    _, df = points(spark)
    small, large = (decompose.TSNE(max_iter=12, limit=n).fit(df, "x", "id") for n in (3_000, 100))
    assert np.abs(small.embedding_ - large.embedding_).max() < 1e-6 * np.abs(small.embedding_).max()


def test_theta_passes_take_no_python_step_for_each_value():
    import time

    for n in (1, 2, 3, 64, 65, 200):
        y = np.random.default_rng(n).normal(size=n) + 3
        for dynamic in (False, True):
            m, theta, alpha, first = forecast.Theta(dynamic=dynamic), 1.7, 0.3, 1.2
            t = np.arange(1, n + 1)
            b = 6 / (n * n - 1) * (2 * (t * y).mean() - (n + 1) * y.mean()) if n > 1 and not dynamic else 0.0
            a, mean, level, want = y[0] if dynamic else y.mean() - b * (n + 1) / 2, y[0], first, []
            for k in range(n):
                want.append(y[k] - level - (1 - 1 / theta) * (a * (1 - alpha) ** k + b * (1 - (1 - alpha) ** (k + 1)) / alpha))
                level = alpha * y[k] + (1 - alpha) * level
                if dynamic:
                    b = ((k - 1) * b + 6 / (k + 1) * (y[k] - mean)) / (k + 2) if k else 0.0
                    mean = (k * mean + y[k]) / (k + 1)
                    a = mean - b * (k + 2) / 2
            assert np.allclose(m._pass(y, theta, alpha, first), want, atol=1e-12) and np.allclose(m._pass(y, theta, alpha, first, keep=True), (level, a, b), atol=1e-12)
    y = np.random.default_rng(0).normal(size=100_000)
    m._pass(y, 2.0, 0.3, 0.0)
    began = time.perf_counter()
    m._pass(y, 2.0, 0.3, 0.0)
    assert time.perf_counter() - began < 0.08
