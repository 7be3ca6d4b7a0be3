"""One test per finding of round 2, on inputs that the code before it failed or got wrong."""

import datetime

import duckdb
import numpy as np

from millrace.catalog import ORACLE_SQL, QUERIES
from millrace.learn import cluster, decompose, graph, kernel, metrics, preprocess, selection
from millrace.operators import models, series  # noqa: F401


def test_sessions_fraction_of_a_second(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    gaps = [0, 1800.4, 1800, 1799.9, 1800.000001, 3600]
    rows = [(k, at + datetime.timedelta(seconds=sum(gaps[: k + 1])), 7) for k in range(len(gaps))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(c.execute(ORACLE_SQL["sessions"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["sessions"](spark, str(tmp_path)).select("user_id", "sess", "n").collect()) == want == [(7, 0, 1), (7, 1, 3), (7, 2, 1), (7, 3, 1)]


def test_stratified_shuffle_split_uses_every_row(spark):
    x = spark.createDataFrame([(k, k % 3) for k in range(9)], "id long, y long")
    got = selection.StratifiedShuffleSplit(2, 0.2).table(x, "id", "y").collect()
    for s in range(2):
        parts = [[r["id"] for r in got if r["split"] == s and r["part"] == p] for p in ("test", "train")]
        assert [len(p) for p in parts] == [2, 7] and sorted(sum(parts, [])) == list(range(9))


def test_mutual_information_of_many_rows(spark):
    x = spark.range(24_000).selectExpr("id % 3 as y", "shiftrightunsigned(xxhash64(id), 11) / 9007199254740992D * 100000 + id % 3 * 80000 as v")
    mi = preprocess.mutual_info_classif(x, ["v"], "y", discrete=False)[0]
    # a fifth of each neighbouring pair of classes lies where both are alike
    assert abs(mi - (np.log(3) - 4 / 15 * np.log(2))) < 0.01
    v = np.random.default_rng(1).normal(size=40).round(1)
    v.sort()
    assert np.array_equal(preprocess._kth_gap(v, 3), [np.sort(np.abs(v - a))[3] for a in v])
    # sums like v + radius round onto the neighbour that the radius leaves out; differences do not
    v = np.sort(np.random.default_rng(2).random(300)) * 1e5
    r = np.nextafter(preprocess._kth_gap(v, 3), 0)
    assert np.array_equal(preprocess._up_to(v, v, r) + preprocess._up_to(-v[::-1], -v, r) - 300, (np.abs(v[:, None] - v) <= r[:, None]).sum(1))


def test_no_start_weights_from_a_sample(spark, monkeypatch):
    from millrace.llm import mixing_lm

    given = []
    monkeypatch.setattr(mixing_lm.Mixer, "learn", lambda self, counts, texts: given.extend(texts))
    mixing_lm.score(spark.createDataFrame([(k, f"some words and w{k % 5}") for k in range(20)], "doc_id long, text string")).count()
    assert not given


def test_as_many_quantiles_as_rows(spark):
    v = np.random.default_rng(3).integers(0, 700, 1500) / 7
    x = spark.createDataFrame([(float(a),) for a in v] + [(None,)], "v double").repartition(5)
    for n in (1001, 1500, 2600):
        assert np.allclose(preprocess._quantiles(x, "v", n), np.quantile(v, np.linspace(0, 1, n)), rtol=0, atol=1e-9)
    assert preprocess.QuantileTransformer(n_quantiles=1500).fit(x, ["v"]).stats_[0]["q"][-1] == v.max()


def test_imputer_with_many_donors(spark):
    x = spark.range(21_000).selectExpr("cast(id as double) as a", "case when id % 5000 = 7 then null else cast(id as double) end as b")
    got = preprocess.KNNImputer(n_neighbors=3).fit(x, ["a", "b"]).transform(x).where("b is null").orderBy("a").select("a", "imputed").collect()
    # of the two at a distance of 2, the one that comes first in the table counts
    assert [(r["a"], r["imputed"][1]) for r in got] == [(k, (3 * k - 2) / 3) for k in (7.0, 5007.0, 10007.0, 15007.0, 20007.0)]


def test_trustworthiness_of_many_rows(spark):
    rng = np.random.default_rng(4)
    for n, k in ((300, 5), (10_100, 2)):
        x = rng.normal(size=(n, 2)).round(2)
        df = spark.createDataFrame([(i, v, v[:1]) for i, v in enumerate(x.tolist())], "id long, x array<double>, y array<double>")
        got, t = metrics.trustworthiness(df, "x", "y", "id", k), 0
        for i in range(n):
            dx, dy = (np.round(((z - z[i]) ** 2).sum(1), 12) for z in (x, x[:, :1]))
            dx[i] = dy[i] = np.inf
            for j in np.argsort(dy, kind="stable")[:k]:
                t += max(0, (dx < dx[j]).sum() + (dx[:j] == dx[j]).sum() + 1 - k)
        assert abs(got - (1 - t * 2 / (n * k * (2 * n - 3 * k - 1)))) < 1e-6


def test_classical_scaling_of_many_rows(spark):
    x = np.random.default_rng(5).normal(size=(4_100, 3)) * (3, 2, 1)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    m = decompose.ClassicalMDS(n_components=3).fit(df, "x", "id")
    at = np.arange(0, 4_100, 41)
    assert np.allclose(cluster.sq_distances(m.embedding_[at], m.embedding_[at]), cluster.sq_distances(x[at], x[at]))
    for rows, k in ((40, 2), (40, 5), (2, 3)):
        y, e = decompose.classical_rows(x[:rows], k)
        z, f = decompose.classical(cluster.sq_distances(x[:rows], x[:rows]), k)
        assert y.shape == z.shape and np.allclose(y, z, atol=1e-6) and np.allclose(e, f, atol=1e-6)


def test_labels_spread_over_many_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(5_050, 2)), rng.normal(size=(5_050, 2)) + 12])
    rows = [(i, v, (0 if i < 5_050 else 1) if i % 4 else -1) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "id long, x array<double>, y long")
    for m in (graph.LabelPropagation(gamma=2.0, max_iter=20), graph.LabelSpreading(kernel="knn", max_iter=10)):
        assert m.fit(df, "x", "y", "id").transduction_.tolist() == [0] * 5_050 + [1] * 5_050
    some = df.where("id % 40 < 2")
    for make in (lambda: graph.LabelPropagation(gamma=0.5), lambda: graph.LabelSpreading(gamma=0.5), lambda: graph.LabelPropagation(kernel="knn"), lambda: graph.LabelSpreading(kernel="knn")):
        m = make().fit(some, "x", "y", "id")
        at, given = np.asarray(m.ids_), np.array([rows[i][2] for i in m.ids_])
        w = m._affinity(x[at], x[at])
        if m.alpha is None:
            w /= w.sum(1, keepdims=True)
        else:
            np.fill_diagonal(w, 0)
            d = 1 / np.sqrt(w.sum(1))
            w = w * d[:, None] * d
        first = np.stack([given == 0, given == 1], 1).astype(float)
        f = first
        for _ in range(m.n_iter_):
            f = w @ f if m.alpha is None else m.alpha * (w @ f) + (1 - m.alpha) * first
            if m.alpha is None:
                f = np.where((given >= 0)[:, None], first, f / np.maximum(f.sum(1, keepdims=True), 1e-300))
        assert np.allclose(m.distributions_, f / np.maximum(f.sum(1, keepdims=True), 1e-300))
        monkeypatch.setattr(graph.LabelPropagation, "HELD", 0)
        assert np.allclose(make().fit(some, "x", "y", "id").distributions_, m.distributions_)
        monkeypatch.undo()


def test_stratified_groups_as_columns(spark):
    rng = np.random.default_rng(7)
    rows = [(i, None if g == 5 else int(g), "abc"[y]) for i, (g, y) in enumerate(zip(rng.integers(0, 40, 600), rng.integers(0, 3, 600)))]
    x = spark.createDataFrame(rows, "id long, g long, y string")
    ids, counts = selection._class_counts(x, "g", "y")
    assert {g: c for g, c in zip(ids.to_pylist(), counts.tolist())} == {g: [sum(r[1:] == (g, y) for r in rows) for y in "abc"] for g in {r[1] for r in rows}}
    by = dict(zip(ids.to_pylist(), counts))
    load, want = np.zeros((4, 3)), {}
    for g in sorted(by, key=lambda g: (-by[g].std(), str(g))):
        scores = []
        for f in range(4):
            load[f] += by[g]
            scores.append((float((load / counts.sum(0)).std(0).mean()), float(load[f].sum()), f))
            load[f] -= by[g]
        want[g] = min(scores)[2]
        load[want[g]] += by[g]
    got = selection.StratifiedGroupKFold(4).assign(x, "id", "y", "g").collect()
    assert len(got) == 600 and all(r["fold"] == want[r["g"]] for r in got)


def test_ward_by_chains(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)) + rng.integers(0, 6, 300)[:, None] * 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    a, b = (cluster.AgglomerativeClustering(n_clusters=7, limit=n).fit(df, "x", "id") for n in (300, 10))
    assert a.labels_.tolist() == b.labels_.tolist() and a.children_ == b.children_ and np.allclose(a.distances_, b.distances_)
    same = spark.createDataFrame([(i, [float(i % 3)]) for i in range(30)], "id long, x array<double>")
    assert cluster.AgglomerativeClustering(n_clusters=3, limit=10).fit(same, "x", "id").labels_.tolist() == [0, 1, 2] * 10


def test_kernel_components_without_the_kernel(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 3)) * (2, 1, 0.5)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    held, never = (kernel.KernelPCA(n_components=2, kernel="rbf", limit=n).fit(df, "x") for n in (600, 20))
    assert np.allclose(held.eigenvalues_, never.eigenvalues_) and np.allclose(held.vectors_, never.vectors_, atol=1e-6)
    assert np.allclose(held.row_, never.row_) and abs(held.all_ - never.all_) < 1e-12


def test_metric_scaling_by_blocks(spark):
    x = np.random.default_rng(10).normal(size=(600, 4))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    a, b = (decompose.MDS(max_iter=15, limit=n).fit(df, "x", "id") for n in (600, 20))
    assert np.allclose(a.embedding_, b.embedding_, atol=1e-6) and np.isclose(a.stress_, b.stress_) and a.n_iter_ == b.n_iter_
