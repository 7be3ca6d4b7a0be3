"""Estimators against formulas of their own on small tables: NumPy, enumeration or known answers."""

import itertools
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import bpe, layers, tensor
from millrace.learn import base, cluster, decompose, forecast, graph, kernel, linear, metrics, neighbors, neural, preprocess, selection, trees
from millrace.sources import models as files
from millrace.streaming.partial import fit_stream


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3)) * [1, 2, 0.5] + [0, 1, -1]
    y = 2 * x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=240) + 4
    c = (x[:, 0] + 0.3 * rng.normal(size=240) > 0).astype(int)
    k = np.digitize(x[:, 1], [0, 2])
    return x, y, c, k


@pytest.fixture(scope="module")
def df(spark, data):
    x, y, c, k = data
    rows = [(i, *map(float, v), float(t), int(a), "abc"[b], [float(q) for q in v]) for i, (v, t, a, b) in enumerate(zip(x, y, c, k))]
    return spark.createDataFrame(rows, "id long, a double, b double, d double, y double, c int, k string, v array<double>").repartition(3).cache()


COLS = ["a", "b", "d"]


def values(df, column, order="id"):
    return np.array([r[0] for r in df.orderBy(order).select(column).collect()])


# --- shared --------------------------------------------------------------------------------------------------------


def test_parameters_state_and_files(spark, df, tmp_path):
    with pytest.raises(TypeError):
        linear.Ridge(beta=1)
    with pytest.raises(base.NotFitted):
        linear.Ridge().coef_
    m = linear.Ridge(alpha=2.0).fit(df, COLS, "y")
    assert m.dump() == linear.Ridge(alpha=2.0).fit(df, COLS, "y").dump() or np.allclose(m.coef_, linear.Ridge(alpha=2.0).fit(df, COLS, "y").coef_)
    m.save(spark, f"file://{tmp_path}/m")
    again = linear.Ridge.load(spark, f"file://{tmp_path}/m")
    assert np.array_equal(again.coef_, m.coef_) and again.params == m.params
    with pytest.raises(ValueError):
        linear.Lasso.restore(m.dump())


def test_refusals(spark, df):
    bad = df.withColumn("a", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("a")))
    with pytest.raises(Exception, match="not finite"):
        linear.LinearRegression().fit(bad, COLS, "y")
    with pytest.raises(ValueError, match="at most"):
        base.bounded_matrix(df, COLS, limit=10)
    with pytest.raises(ValueError, match="no rows"):
        linear.LinearRegression().fit(df.where("id < 0"), COLS, "y")
    got = preprocess.finite_scan(bad.withColumn("b", F.when(F.col("id") == 1, None).otherwise(F.col("b"))), COLS).collect()
    assert [(r["column"], r["nulls"], r["nans"]) for r in got] == [("a", 0, 1), ("b", 1, 0), ("d", 0, 0)]
    with pytest.raises(Exception, match="a is not finite"):
        preprocess.refuse_non_finite(bad, COLS).collect()


# --- preprocessing ---------------------------------------------------------------------------------------------------


def test_scalers(spark, df, data):
    x = data[0]
    s = preprocess.StandardScaler().fit_transform(df.withColumn("one", F.lit(5.0)), [*COLS, "one"])
    assert np.allclose(values(s, "b"), (x[:, 1] - x[:, 1].mean()) / x[:, 1].std()) and (values(s, "one") == 0).all()
    m = preprocess.StandardScaler()
    for part in (0, 1):
        m.partial_fit(df.where(F.col("id") % 2 == part), COLS)
    assert np.allclose([v["var"] for v in m.stats_], x.var(0)) and np.allclose([v["mean"] for v in m.stats_], x.mean(0))
    r = preprocess.RobustScaler().fit_transform(df, ["a"])
    q = np.quantile(x[:, 0], [0.25, 0.5, 0.75])
    assert np.allclose(values(r, "a"), (x[:, 0] - q[1]) / (q[2] - q[0]))
    holes = df.withColumn("a", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("a")))
    t = preprocess.MinMaxScaler().fit_transform(holes, ["a"])
    assert t.where("id % 5 = 0 and a is not null").count() == 0 and t.agg(F.max("a")).first()[0] == 1


def test_power_and_quantile_transformer(df, data):
    x = data[0][:, 1]
    m = preprocess.PowerTransformer(rounds=10).fit(df, ["b"])

    def like(lam):
        z = np.where(x >= 0, ((np.maximum(x, 0) + 1) ** lam - 1) / lam if abs(lam) > 1e-9 else np.log1p(np.maximum(x, 0)), -(((1 - np.minimum(x, 0)) ** (2 - lam) - 1) / (2 - lam)))
        return -0.5 * len(x) * np.log(z.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    grid = np.linspace(-1, 3, 4001)
    assert abs(m.lambdas_[0] - grid[np.nanargmax([like(g) for g in grid])]) < 2e-3
    q = values(preprocess.QuantileTransformer(n_quantiles=240).fit_transform(df, ["b"]), "b")
    assert np.allclose(q, np.argsort(np.argsort(x)) / 239)


def test_encoders(spark, df, data):
    enc = preprocess.OneHotEncoder(drop="first").fit(df, ["k"])
    assert enc.names() == ["k_b", "k_c"]
    got = enc.transform(df.withColumn("k", F.when(F.col("id") == 0, "zzz").otherwise(F.col("k")))).where("id = 0").first()
    assert (got["k_b"], got["k_c"]) == (0, 0)
    t = preprocess.TargetEncoder(smooth=0.0).fit_transform(df, ["k"], "y", "id").orderBy("id").select("k_target", F.pmod(base.keyed(0, F.col("id")), F.lit(5)).alias("f"), "k", "y").toPandas()
    want = [t.y[(t.f != f) & (t.k == k)].mean() for f, k in zip(t.f, t.k)]
    assert np.allclose(t.k_target, want)
    lb = preprocess.LabelBinarizer().fit(df, "k")
    assert lb.inverse_transform(lb.transform(df).drop("k")).join(df.select("id", F.col("k").alias("kk")), "id").where("k <> kk").count() == 0


def test_imputers(spark, df, data):
    x = data[0].copy()
    holes = df.withColumn("a", F.when(F.col("id") % 6 == 0, None).otherwise(F.col("a")))
    got = values(preprocess.IterativeImputer(max_iter=3).fit(holes, ["a", "b", "y"]).transform(holes), "a")
    assert np.abs(got - x[:, 0])[::6].mean() < 0.3 * np.abs(x[:, 0] - x[:, 0].mean())[::6].mean()
    got = preprocess.KNNImputer(n_neighbors=3).fit(holes, COLS).transform(holes).where("id = 6").first()["imputed"][0]
    d = ((x[:, 1:] - x[6, 1:]) ** 2).sum(1)
    own = [i for i in np.argsort(d, kind="stable") if i % 6][:3]
    assert math.isclose(got, x[own, 0].mean())


def test_spline_and_poly(df, data):
    v = np.array([r[0] for r in preprocess.SplineTransformer(n_knots=4, degree=3).fit(df, ["b"]).transform(df).select("splines").collect()])
    assert np.allclose(v.sum(1), 1) and (v >= -1e-12).all() and v.shape[1] == 6
    p = preprocess.PolynomialFeatures(degree=3, interaction_only=True).fit(df, COLS)
    assert p.names() == ["1", "a", "b", "d", "a*b", "a*d", "b*d", "a*b*d"]


def test_special_functions():
    # the F density integrated: t = x / (1 + x) maps the tail to an interval
    t = (np.arange(400_000) + 0.5) / 400_000 * 0.2 + 0.8
    f = t / (1 - t)
    dens = math.gamma(11.5) / math.gamma(1.5) / math.gamma(10) * (3 / 20) ** 1.5 * f**0.5 * (1 + 3 * f / 20) ** -11.5
    assert math.isclose(preprocess.f_tail(4.0, 3, 20), float((dens / (1 - t) ** 2).mean() * 0.2), rel_tol=1e-5)
    assert math.isclose(preprocess.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-6)
    assert math.isclose(preprocess.normal_quantile(0.975), 1.959963984540054, rel_tol=1e-9)
    assert math.isclose(float(preprocess.digamma(1.0)), -0.5772156649015329, rel_tol=1e-10)
    assert np.allclose(tensor.erf(np.array([-3.0, -0.5, 0.0, 1.0, 2.4, 2.6])), [math.erf(v) for v in (-3.0, -0.5, 0.0, 1.0, 2.4, 2.6)], atol=1e-13)


def test_feature_scores(df, data):
    x, y, c, k = data
    f, p = preprocess.f_classif(df, COLS, "k")[0]
    groups = [x[k == j, 0] for j in range(3)]
    between = sum(len(g) * (g.mean() - x[:, 0].mean()) ** 2 for g in groups) / 2
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (240 - 3)
    assert math.isclose(f, between / within) and 0 <= p <= 1
    assert preprocess.SelectKBest(k=1, score_func="f_regression").fit(df, COLS, "y").kept_ == ["b"]
    scaled = preprocess.StandardScaler().fit_transform(df, COLS)
    r = preprocess.RFE(estimator=linear.LinearRegression(), n_features_to_select=1).fit(scaled, COLS, "y")
    assert r.ranking_[2] == 3 and len(r.kept_) == 1
    mi = preprocess.mutual_info_classif(df, COLS, "c", discrete=False)
    assert mi[0] > 0.15 and mi[0] > 2 * max(mi[1:])


# --- linear ------------------------------------------------------------------------------------------------------------


def test_least_squares(df, data):
    x, y, c, k = data
    z = np.column_stack([x, np.ones(240)])
    want = np.linalg.lstsq(z, y, rcond=None)[0]
    m = linear.LinearRegression().fit(df, "v", "y")
    assert np.allclose([*m.coef_, m.intercept_], want) and np.allclose(values(m.predict(df), "prediction"), z @ want)
    assert math.isclose(m.score(df, "y"), 1 - ((y - z @ want) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    same = df.withColumn("e", F.col("a") * 2)  # singular
    assert np.allclose(values(linear.LinearRegression().fit(same, [*COLS, "e"], "y").predict(same), "prediction"), z @ want)
    lasso = linear.Lasso(alpha=0.3).fit(df, COLS, "y")
    r = y - values(lasso.predict(df), "prediction")
    g = (x - x.mean(0)).T @ r / 240
    assert np.allclose(g[lasso.coef_ != 0], 0.3 * np.sign(lasso.coef_[lasso.coef_ != 0]), atol=1e-6) and (np.abs(g) <= 0.3 + 1e-6).all()
    path = linear.Lars().fit(df, COLS, "y")
    assert np.allclose(path.coef_, want[:3]) and len(path.active_) == 3
    s = x.std(0)
    ll = linear.LassoLars(alpha=0.3).fit(df, COLS, "y")
    r = y - values(ll.predict(df), "prediction")
    assert np.allclose(np.abs((x - x.mean(0)).T @ r / 240 / s)[list(ll.active_)], 0.3, atol=1e-6)
    b = linear.BayesianRidge().fit(df, COLS, "y")
    assert np.allclose(b.coef_, want[:3], atol=0.05) and abs(1 / math.sqrt(b.alpha_) - 0.3) < 0.05
    assert abs(linear.ARDRegression().fit(df, COLS, "y").coef_[2]) < 0.1


def test_cross_validated_linear(df):
    for m in (linear.RidgeCV(alphas=(1e-3, 1e4)), linear.LassoCV(n_alphas=8), linear.ElasticNetCV(n_alphas=8, l1_ratio=(0.5, 1.0))):
        assert m.fit(df, COLS, "y", key="id").score(df, "y") > 0.9
    assert linear.RidgeCV(alphas=(1e-3, 1e4)).fit(df, COLS, "y", key="id").alpha_ == 1e-3


def logistic_loss(w, x, y, c):
    m = x @ w[:-1] + w[-1]
    return c * (np.logaddexp(0, m) - y * m).sum() + 0.5 * w[:-1] @ w[:-1]


def smallest(fn, at, scale=1e-3):
    """No step along an axis lowers fn."""
    v = fn(at)
    return all(fn(at + s * scale * e) >= v - 1e-9 * abs(v) for e in np.eye(len(at)) for s in (-1, 1))


def test_logistic(df, data):
    x, y, c, k = data
    m = linear.LogisticRegression(C=0.5).fit(df, COLS, "c")
    assert smallest(lambda w: logistic_loss(w, x, c, 0.5), np.append(m.coef_[0], m.intercept_[0]))
    p = np.array([r[0] for r in df.orderBy("id").select(m.proba_column(COLS)).collect()])
    assert np.allclose(p[:, 1], 1 / (1 + np.exp(-(x @ m.coef_[0] + m.intercept_[0])))) and m.score(df, "c") > 0.8
    multi = linear.LogisticRegression().fit(df, COLS, "k")
    assert multi.score(df, "k") > 0.9 and len(multi.coef_) == 3

    def loss(w):
        w = w.reshape(3, 4)
        z = x @ w[:, :3].T + w[:, 3]
        return (np.log(np.exp(z).sum(1)) - z[np.arange(240), k]).sum() + 0.5 * (w[:, :3] ** 2).sum()

    assert smallest(loss, np.column_stack([multi.coef_, multi.intercept_]).ravel(), 0.02)
    sparse = linear.LogisticRegression(C=0.05, penalty="l1").fit(df, COLS, "c")
    assert (sparse.coef_ == 0).any() and sparse.coef_[0][0] > 0
    w = linear.LogisticRegression(class_weight="balanced").fit(df.where("c = 1 or id % 4 = 0"), COLS, "c")
    assert w.score(df, "c") > 0.8


@pytest.mark.parametrize("power, cls", [(1.0, linear.PoissonRegressor), (2.0, linear.GammaRegressor)])
def test_glm(spark, df, data, power, cls):
    x = data[0]
    y = np.exp(0.3 * x[:, 0] - 0.1 * x[:, 1] + 0.2) + 0.1
    rows = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, d double, y double")
    m = cls(alpha=0.1).fit(rows, COLS, "y")

    def loss(w):
        e = x @ w[:-1] + w[-1]
        return (np.exp(e) - y * e if power == 1 else y * np.exp(-e) + e).mean() + 0.05 * w[:-1] @ w[:-1]

    assert smallest(loss, np.append(m.coef_, m.intercept_))
    with pytest.raises(ValueError):
        cls().fit(rows.withColumn("y", F.lit(-1.0)), COLS, "y")


def test_robust_regressors(spark, df, data):
    x, y, c, k = data
    far = df.withColumn("y", F.when(F.col("id") < 12, 500.0).otherwise(F.col("y")))
    assert np.allclose(linear.HuberRegressor().fit(far, COLS, "y").coef_[:2], [2, -1], atol=0.15)
    q = linear.QuantileRegressor(quantile=0.8, alpha=0.0).fit(df, COLS, "y")
    assert abs((y < values(q.predict(df), "prediction")).mean() - 0.8) < 0.03
    svr = linear.LinearSVR(C=10.0).fit(df, COLS, "y")
    assert np.allclose(svr.coef_, [2, -1, 0], atol=0.2)
    svc = linear.LinearSVC(C=0.5).fit(df, COLS, "c")
    s = 2 * c - 1
    assert smallest(lambda w: 0.5 * w @ w + 0.5 * (np.maximum(0, 1 - s * (x @ w[:-1] + w[-1])) ** 2).sum(), np.append(svc.coef_[0], svc.intercept_[0]))
    assert linear.QNRegressor(loss="softmax", l2=0.01).fit(df, COLS, "k").score(df, "k") > 0.9


@pytest.mark.parametrize("make", [linear.SGDClassifier, linear.Perceptron, linear.PassiveAggressiveClassifier])
def test_sequential_classifiers(df, make):
    one = make(max_iter=5).fit(df, COLS, "c", key="id")
    assert one.score(df, "c") > 0.75 and np.allclose(one.coef_, make(max_iter=5).fit(df.repartition(7), COLS, "c", key="id").coef_)
    assert make(max_iter=5, parts=3).fit(df, COLS, "c", key="id").score(df, "c") > 0.75


def test_sequential_others(df):
    assert linear.SGDRegressor(max_iter=20, eta0=0.02).fit(df, COLS, "y", key="id").score(df, "y") > 0.9
    assert linear.PassiveAggressiveRegressor(max_iter=5).fit(df, COLS, "y", key="id").score(df, "y") > 0.8
    inside = linear.SGDOneClassSVM(nu=0.3).fit(df, COLS, key="id").predict(df).where("prediction = 1").count()
    assert 0 < inside < 240


def test_isotonic(spark):
    rng = np.random.default_rng(1)
    x, y = np.arange(40) // 2, rng.normal(size=40) + np.arange(40) / 10
    m = linear.IsotonicRegression().fit(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(5), "x", "y")
    means = [y[x == v].mean() for v in range(20)]
    want = [max(min(np.mean(means[i : j + 1]) for j in range(k, 20)) for i in range(k + 1)) for k in range(20)]
    q = spark.createDataFrame([(float(v),) for v in range(20)], "x double")
    assert np.allclose(values(m.predict(q), "prediction", "x"), want)


def test_bayes_and_discriminants(df, data):
    x, y, c, k = data
    g = linear.GaussianNB().fit(df, COLS, "k")
    z = np.array([r[0] for r in df.orderBy("id").select(g.jll_column(COLS)).collect()])
    want = np.column_stack([np.log((k == j).mean()) - 0.5 * (np.log(2 * np.pi * x[k == j].var(0)) + (x - x[k == j].mean(0)) ** 2 / x[k == j].var(0)).sum(1) for j in range(3)])
    assert np.allclose(z, want, rtol=1e-5)
    parts = linear.GaussianNB()
    for p in (0, 1):
        parts.partial_fit(df.where(F.col("id") % 2 == p), COLS, "k", ["a", "b", "c"])
    assert np.allclose(parts.var_, g.var_)
    for m in (linear.LinearDiscriminantAnalysis(), linear.QuadraticDiscriminantAnalysis(), linear.NearestCentroid()):
        assert m.fit(df, COLS, "k").score(df, "k") > 0.75
    lda = linear.LinearDiscriminantAnalysis().fit(df, COLS, "k")
    t = np.array([r[0] for r in df.orderBy("id").select(lda.transform_column(COLS)).collect()])
    within = sum((k == j).sum() * np.cov(t[k == j].T, bias=True) for j in range(3)) / 240
    assert np.allclose(within, np.eye(len(within)), atol=1e-6)


# --- trees ---------------------------------------------------------------------------------------------------------------


def test_tree_equals_exhaustive_search(df, data):
    x, y, c, k = data
    t = trees.DecisionTreeRegressor(max_depth=1, n_bins=1000).fit(df, COLS, "y").trees_[0]
    best = min(((y[x[:, f] <= v].var() * (x[:, f] <= v).sum() + y[x[:, f] > v].var() * (x[:, f] > v).sum(), f, v) for f in range(3) for v in np.unique(x[:, f])[:-1]))
    assert t["feature"][0] == best[1] and math.isclose(t["cut"][0], best[2])
    assert trees.DecisionTreeClassifier(max_depth=6, n_bins=200).fit(df, COLS, "k").score(df, "k") > 0.97


@pytest.mark.parametrize("make", [lambda: trees.RandomForestRegressor(n_estimators=8, oob_score=True), lambda: trees.ExtraTreesRegressor(n_estimators=8), lambda: trees.GradientBoostingRegressor(n_estimators=15), lambda: trees.OrderedRMSE(n_estimators=15, max_depth=3), lambda: trees.AdaBoostRegressor(n_estimators=5), lambda: trees.DARTRegressor(n_estimators=15)])
def test_regression_ensembles(df, make):
    m = make().fit(df, COLS, "y")
    assert m.score(df, "y") > 0.6
    if "oob_score" in m.state:
        assert 0.4 < m.oob_score_ < m.score(df, "y")
    if "feature_importances" in m.state:
        assert math.isclose(sum(m.feature_importances_), 1) and np.argmin(m.feature_importances_) == 2


@pytest.mark.parametrize("make", [lambda: trees.RandomForestClassifier(n_estimators=8, class_weight="balanced"), lambda: trees.ExtraTreesClassifier(n_estimators=8), lambda: trees.AdaBoostClassifier(n_estimators=8, max_depth=2), lambda: trees.GradientBoosting(loss="multiclass", n_estimators=6, max_depth=3), lambda: trees.GradientBoosting(loss="multi_ova", n_estimators=6, max_depth=3)])
def test_classification_ensembles(df, make):
    assert make().fit(df, COLS, "k").score(df, "k") > 0.85


def test_boosting_losses(df, data):
    x, y, c, k = data
    assert trees.GradientBoostingClassifier(n_estimators=10).fit(df, COLS, "c").score(df, "c") > 0.8
    q = trees.GradientBoosting(loss="quantile", param=0.8, n_estimators=30, max_depth=3, l2_leaf_reg=0.0).fit(df, COLS, "y")
    assert abs((y < values(q.predict(df), "prediction")).mean() - 0.8) < 0.1
    pos = df.withColumn("y", F.exp(F.col("a") / 2))
    assert trees.GradientBoosting(loss="poisson", n_estimators=20, max_depth=3).fit(pos, COLS, "y").score(pos, "y") > 0.7
    r = trees.GradientBoosting(loss="query_rmse", n_estimators=10, max_depth=3).fit(df, COLS, "y", group="k")
    p = trees.GradientBoosting(loss="pair_logit", n_estimators=10, max_depth=3).fit(df, COLS, "y", group="k")
    for m in (r, p):
        z = values(m.predict(df), "prediction")
        assert np.mean([np.corrcoef(z[k == j], y[k == j])[0, 1] for j in range(3)]) > 0.6
    both = trees.GradientBoosting(loss="multi_rmse", n_estimators=8, max_depth=3).fit(df, COLS, ["y", "a"])
    z = np.array([r[0] for r in both.predict(df).orderBy("id").select("prediction").collect()])
    assert np.corrcoef(z[:, 0], y)[0, 1] > 0.8 and np.corrcoef(z[:, 1], x[:, 0])[0, 1] > 0.8
    stop = trees.GradientBoosting(n_estimators=60, learning_rate=0.9, max_depth=4, od_wait=3).fit(df.where("id % 2 = 0"), COLS, "y", eval=df.where("id % 2 = 1"))
    assert len(stop.trees_) == stop.best_iteration_ < 60
    with pytest.raises(ValueError):
        trees.GradientBoosting(grow_policy="lossguide").fit(df, COLS, "y")


def test_shapley_values(df, data):
    x = data[0]
    m = trees.GradientBoostingRegressor(n_estimators=3, max_depth=3).fit(df, COLS, "y")
    e = trees.TreeExplainer(m)
    got = np.array([r[0] for r in df.orderBy("id").limit(4).select(e.values_column(COLS)).collect()])
    raw = m._raw_fn()(x[:4])[:, 0]
    assert np.allclose(got.sum(1) + e.expected_value, raw)

    def known(t, row, s, node=0):
        f = t["feature"][node]
        if f < 0:
            return t["value"][node][0]
        a, b, w = t["left"][node], t["right"][node], t["weight"]
        if f in s:
            return known(t, row, s, a if row[f] <= t["cut"][node] else b)
        return (w[a] * known(t, row, s, a) + w[b] * known(t, row, s, b)) / (w[a] + w[b])

    for i in range(2):
        for f in range(3):
            v = 0.0
            for r in range(3):
                for s in itertools.combinations([g for g in range(3) if g != f], r):
                    w = math.factorial(r) * math.factorial(2 - r) / 6
                    v += w * sum(m.learning_rate * (known(t[0], x[i], {*s, f}) - known(t[0], x[i], set(s))) for t in m.trees_)
            assert math.isclose(got[i, f], v, abs_tol=1e-9)
    w, back = np.array([1.0, -2.0, 3.0]), x[:20]
    want = (x[:4] - back.mean(0)) * w
    for cls in (trees.KernelExplainer, trees.PermutationExplainer):
        assert np.allclose(cls(lambda z: z @ w, back).explain(x[:4]), want)


def test_ordered_statistics_and_borders(spark, df, data):
    t = trees.ordered_statistics(df, "k", "c", "id", prior=0.5, weight=2.0).toPandas()
    order = df.select("id", base.keyed(0, F.col("id")).alias("h")).toPandas().set_index("id").h
    t = t.assign(h=order[t.id].values).sort_values("h")
    for _, g in t.groupby("k"):
        seen, n = 0.0, 0
        for r in g.itertuples():
            assert math.isclose(r.ctr, (seen + 1.0) / (n + 2.0))
            seen, n = seen + r.c, n + 1
    for kind in trees.BORDER_TYPES:
        b = trees.borders(df, "a", 5, kind)
        assert len(b) == 5 and b == sorted(b)
    few = spark.createDataFrame([(float(v),) for v in [1] * 8 + [2] * 2 + [3] * 8 + [9]], "v double")
    v, n = np.array([1.0, 2, 3, 9]), np.array([8, 2, 8, 1])
    for kind, pay in (("MaxLogSum", lambda w: math.log(w + 1e-8)), ("MinEntropy", lambda w: -w * math.log(w))):
        def worth(cut):
            parts = np.split(n, [k + 1 for k in cut])
            return sum(pay(float(p.sum())) for p in parts)

        best = max(itertools.combinations(range(3), 2), key=worth)
        assert trees.borders(few, "v", 2, kind) == [(v[k] + v[k + 1]) / 2 for k in best]


# --- clusters --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 2)) * 0.4 + m for m in ([0, 0], [4, 4], [0, 6])])
    return x, spark.createDataFrame([(i, [float(q) for q in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(4).cache()


TRUTH = np.repeat([0, 1, 2], 60)


def agree(labels):
    """Share of rows whose cluster's main truth is theirs."""
    labels = np.asarray(labels)
    return sum(np.bincount(TRUTH[labels == c]).max() for c in set(labels.tolist()) if c >= 0) / len(TRUTH)


@pytest.mark.parametrize("make", [lambda: cluster.KMeans(n_clusters=3, n_init=4), lambda: cluster.KMeans(n_clusters=3, init="random", n_init=4), lambda: cluster.MiniBatchKMeans(n_clusters=3, init=[[0, 0], [4, 4], [0, 6]]), lambda: cluster.BisectingKMeans(n_clusters=3), lambda: cluster.GaussianMixture(n_components=3), lambda: cluster.BayesianGaussianMixture(n_components=4), lambda: cluster.MeanShift(bandwidth=1.5), lambda: cluster.MeanShift(bandwidth=1.5, bin_seeding=True)])
def test_clusters(blobs, make):
    m = make().fit(blobs[1], "v")
    assert agree(values(m.predict(blobs[1]), "prediction")) > 0.95


@pytest.mark.parametrize("make", [lambda: cluster.HDBSCAN(min_cluster_size=10), lambda: cluster.OPTICS(min_samples=8, cluster_method="dbscan", eps=1.2), lambda: cluster.AgglomerativeClustering(n_clusters=3), lambda: cluster.AgglomerativeClustering(n_clusters=3, linkage="single"), lambda: cluster.AgglomerativeClustering(n_clusters=3, linkage="average"), lambda: cluster.SpectralClustering(n_clusters=3, affinity="nearest_neighbors")])
def test_clusters_of_bounded_tables(blobs, make):
    got = make().fit_predict(blobs[1], "v", "id")
    assert got.count() == 180 and agree(values(got, "label")) > 0.9


def test_kmeans_on_two_points_and_cost(spark, blobs):
    x, b = blobs
    m = cluster.KMeans(n_clusters=3).fit(b, "v")
    c = m.cluster_centers_
    assert math.isclose(cluster.cluster_cost(b, "v", c), ((x[:, None] - c) ** 2).sum(2).min(1).sum()) and math.isclose(m.inertia_, cluster.cluster_cost(b, "v", c), rel_tol=1e-9)


@pytest.mark.parametrize("eps, least, block", [(0.35, 4, 4000), (0.35, 4, 7), (0.15, 2, 4000)])
def test_dbscan(blobs, eps, least, block):
    x, b = blobs
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    core = (d <= eps).sum(1) >= least
    label = np.full(180, -1)
    k = 0
    for i in range(180):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], k
            while todo:
                for j in np.nonzero((d[todo.pop()] <= eps) & core & (label < 0))[0]:
                    label[j] = k
                    todo.append(j)
            k += 1
    for i in np.nonzero(~core)[0]:
        near = label[(d[i] <= eps) & core]
        label[i] = near.min() if len(near) else -1
    got = cluster.DBSCAN(eps=eps, min_samples=least, block=block).fit_predict(b, "v", "id").orderBy("id").toPandas()
    assert (got.core == core).all() and (got.label == label).all()


def test_density(spark, blobs):
    x, b = blobs
    for kind in cluster.KERNELS:
        grid = np.stack(np.meshgrid(np.linspace(-8, 12, 81), np.linspace(-8, 14, 89)), -1).reshape(-1, 2)
        q = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(grid)], "id long, v array<double>")
        p = np.exp(values(cluster.KernelDensity(kernel=kind, bandwidth=0.8).fit(b, "v").score_samples(q, "v", "id"), "log_density"))
        assert abs(p.sum() * 0.25 * 0.25 - 1) < 0.05
    far = b.unionByName(spark.createDataFrame([(999, [30.0, -30.0])], "id long, v array<double>"))
    m = cluster.IsolationForest(n_estimators=30, max_samples=64).fit(far, "v")
    s = far.select("id", m.score_samples_column("v").alias("s")).orderBy("s").first()
    assert s["id"] == 999
    e = decompose.EllipticEnvelope(contamination=0.01).fit(far, "v")
    assert e.predict(far).where("id = 999").first()["prediction"] == -1
    g = cluster.GaussianMixture(n_components=3).fit(b, "v")
    assert g.bic(b) < cluster.GaussianMixture(n_components=1).fit(b, "v").bic(b)


# --- decompositions ----------------------------------------------------------------------------------------------------------


def test_pca_family(df, data):
    x = data[0]
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    p = decompose.PCA(n_components=2).fit(df, COLS)
    assert np.allclose(p.explained_variance_, (s**2 / 239)[:2]) and np.allclose(np.abs(p.components_ @ vt.T[:, :2]), np.eye(2))
    z = np.array([r[0] for r in p.transform(df).orderBy("id").select("transformed").collect()])
    assert np.allclose(z, (x - x.mean(0)) @ p.components_.T)
    inc = decompose.IncrementalPCA(n_components=2)
    for k in range(3):
        inc.partial_fit(df.where(F.col("id") % 3 == k), COLS)
    assert np.allclose(inc.explained_variance_, p.explained_variance_) and np.allclose(inc.components_, p.components_)
    assert np.allclose(decompose.TruncatedSVD(n_components=2).fit(df, COLS).singular_values_, np.linalg.svd(x, compute_uv=False)[:2])
    k = kernel.KernelPCA(n_components=2).fit(df, COLS)
    zk = np.array([r[0] for r in k.transform(df).orderBy("id").select("transformed").collect()])
    assert np.allclose(np.abs(zk), np.abs(z), atol=1e-6)
    assert math.isclose(decompose.PCA(n_components=0.9).fit(df, COLS).explained_variance_ratio_.sum() >= 0.9, 1)


def test_linear_algebra(df, data):
    x = data[0]
    r = decompose.qr_r(df, COLS)
    assert np.allclose(r.T @ r, x.T @ x) and np.allclose(decompose.svdvals(df, COLS), np.linalg.svd(x, compute_uv=False))
    s, vt = decompose.randomized_svd(df, COLS, 2)
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False)[:2], rtol=1e-6)
    assert np.allclose(decompose.lstsq(df, COLS, "y"), np.linalg.lstsq(x, data[1], rcond=None)[0])
    a = np.random.default_rng(0).normal(size=(6, 6))
    p, low, up = decompose.lu(a)
    assert np.allclose(p @ a, low @ up) and np.allclose(np.triu(up), up) and np.allclose(np.diag(low), 1)
    spd = a @ a.T + np.eye(6)
    c = kernel.Cholesky(spd)
    assert np.allclose(c.solve(a), np.linalg.solve(spd, a)) and math.isclose(c.logdet(), np.linalg.slogdet(spd)[1])
    assert np.allclose(c.update(a[0]).solve(a), np.linalg.solve(spd + np.outer(a[0], a[0]), a))


def test_factorisations(spark, df, data):
    rng = np.random.default_rng(2)
    w, h = rng.uniform(size=(100, 2)), rng.uniform(size=(2, 5))
    rows = spark.createDataFrame([(i, [float(q) for q in v]) for i, v in enumerate(w @ h)], "id long, v array<double>")
    m = decompose.NMF(n_components=2, max_iter=200, tol=1e-9).fit(rows, "v")
    assert m.reconstruction_err_ < 0.05 * np.linalg.norm(w @ h) and (m.components_ >= 0).all()
    s = rng.laplace(size=(400, 2))
    mix = spark.createDataFrame([(i, [float(q) for q in v]) for i, v in enumerate(s @ [[1, 0.5], [0.4, 1]])], "id long, v array<double>")
    for how in ("parallel", "deflation"):
        z = np.array([r[0] for r in decompose.FastICA(algorithm=how).fit(mix, "v").transform(mix).orderBy("id").select("transformed").collect()])
        c = np.abs(np.corrcoef(z.T, s.T)[:2, 2:])
        assert c.max(1).min() > 0.95
    f = decompose.FactorAnalysis(n_components=1).fit(df, COLS)
    cov = np.outer(f.components_[0], f.components_[0]) + np.diag(f.noise_variance_)
    assert np.allclose(np.diag(cov), data[0].var(0), rtol=1e-3)
    d = decompose.DictionaryLearning(n_components=2, alpha=0.01, max_iter=20).fit(rows, "v")
    assert np.allclose(np.linalg.norm(d.components_, axis=1), 1) and d.error_ < 5
    sp = decompose.SparsePCA(n_components=1, alpha=8.0).fit(df, COLS)
    assert (sp.components_ == 0).any()
    topics = np.array([[9, 9, 0, 0], [0, 0, 9, 9]])
    docs = spark.createDataFrame([(i, [float(q) for q in topics[i % 2]]) for i in range(40)], "id long, v array<double>")
    z = np.array([r[0] for r in decompose.LatentDirichletAllocation(n_components=2, max_iter=20).fit(docs, "v").transform(docs).orderBy("id").select("transformed").collect()])
    assert (z[::2].argmax(1) != z[1::2].argmax(1)).all()


def test_two_blocks(spark, data):
    rng = np.random.default_rng(4)
    t = rng.normal(size=(300, 1))
    x, y = np.hstack([t + 0.1 * rng.normal(size=(300, 1)), rng.normal(size=(300, 1))]), np.hstack([2 * t + 0.1 * rng.normal(size=(300, 1)), rng.normal(size=(300, 1))])
    rows = spark.createDataFrame([(i, *map(float, [*a, *b])) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, b double, p double, q double")
    c = decompose.CCA(n_components=1).fit(rows, ["a", "b"], ["p", "q"])
    assert c.correlations_[0] > 0.98
    full = decompose.PLSRegression(n_components=2).fit(rows, ["a", "b"], ["p"])
    assert np.allclose(full.coef_[0], linear.LinearRegression().fit(rows, ["a", "b"], "p").coef_)
    z = np.array([r[0] for r in decompose.PLSCanonical(n_components=1).fit(rows, ["a", "b"], ["p", "q"]).transform(rows).orderBy("id").select("transformed").collect()])
    assert abs(np.corrcoef(z[:, 0], t[:, 0])[0, 1]) > 0.97


def test_manifolds(spark):
    t = np.linspace(0, 3, 60)
    x = np.column_stack([np.cos(t), np.sin(t), 0 * t])
    rows = spark.createDataFrame([(i, [float(q) for q in v]) for i, v in enumerate(x)], "id long, v array<double>")
    for m in (decompose.Isomap(n_components=1), decompose.LocallyLinearEmbedding(n_components=1, n_neighbors=4), decompose.SpectralEmbedding(n_components=1, n_neighbors=5)):
        y = np.array([r["embedding"] for r in m.fit_transform(rows, "v", "id").orderBy("id").collect()])[:, 0]
        assert abs(np.corrcoef(np.argsort(np.argsort(y)), t)[0, 1]) > 0.99
    d = lambda y: np.sqrt(((y[:, None] - y) ** 2).sum(2))
    for m in (decompose.ClassicalMDS(), decompose.MDS()):
        y = np.array([r["embedding"] for r in m.fit_transform(rows, "v", "id").orderBy("id").collect()])
        assert np.allclose(d(y), d(x), atol=1e-2)
    for m in (decompose.TSNE(perplexity=10, max_iter=250), decompose.UMAP(n_neighbors=8, n_epochs=100)):
        e = m.fit_transform(rows, "v", "id").join(rows, "id")
        assert metrics.trustworthiness(e, "v", "embedding", "id") > 0.9


def test_projections(df, data):
    x = data[0]
    z = np.array([r[0] for r in decompose.GaussianRandomProjection(n_components=400).fit_transform(df, COLS).orderBy("id").select("transformed").collect()])
    a, b = ((x[:20, None] - x[:20]) ** 2).sum(2), ((z[:20, None] - z[:20]) ** 2).sum(2)
    assert np.allclose(b, a, rtol=0.4)
    k = np.array([r[0] for r in kernel.RBFSampler(gamma=0.3, n_components=2000).fit_transform(df, COLS).orderBy("id").select("transformed").collect()])
    assert np.allclose(k[:20] @ k[:20].T, kernel.kernel_matrix("rbf", x[:20], x[:20], 0.3), atol=0.1)
    n = np.array([r[0] for r in kernel.Nystroem(n_components=240, gamma=0.3).fit_transform(df, COLS).orderBy("id").select("transformed").collect()])
    assert np.allclose(n[:20] @ n[:20].T, kernel.kernel_matrix("rbf", x[:20], x[:20], 0.3), atol=1e-3)
    s = np.array([r[0] for r in kernel.PolynomialCountSketch(n_components=3000).fit_transform(df, COLS).orderBy("id").select("transformed").collect()])
    assert np.corrcoef((s[:20] @ s[:20].T).ravel(), ((x[:20] @ x[:20].T) ** 2).ravel())[0, 1] > 0.95


# --- neighbours, graphs -----------------------------------------------------------------------------------------------------------


def test_neighbours(spark, blobs):
    x, b = blobs
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = {(i, int(j)) for i in range(0, 180, 20) for j in np.argsort(np.round(d[i], 12), kind="stable")[:7]}
    q = b.where("id % 20 = 0")
    for m in (neighbors.NearestNeighbors(n_neighbors=7, query_block=4), neighbors.RandomBallCover(n_neighbors=7)):
        got = m.fit(b, "v", "id").kneighbors(q, "id")
        assert {(r["query"], r["id"]) for r in got.collect()} == want
    r = neighbors.RadiusNeighbors().fit(b, "v", "id").radius_neighbors(q, "id", 0.5)
    assert r.count() == (d[::20] <= 0.5).sum()
    f = neighbors.IVFIndex(n_lists=5, n_probes=5, n_neighbors=7).fit(b, "v", "id")
    assert {(r["query"], r["id"]) for r in f.search(q, "id").collect()} == want
    few = f.search(q, "id", mask=F.col("id") < 3).where("id = -1").count()
    assert few == 9 * 4
    for m in (neighbors.IVFSQIndex(n_lists=5, n_probes=5, n_neighbors=7), neighbors.IVFPQIndex(n_lists=5, n_probes=5, n_neighbors=7, pq_dim=2), neighbors.CagraIndex(graph_degree=8, intermediate_graph_degree=16, n_neighbors=7)):
        hits = {(r["query"], r["id"]) for r in m.fit(b, "v", "id").search(q, "id").collect()} & want
        assert len(hits) > 0.8 * len(want)


def test_ivf_recall_and_extension(spark, blobs):
    x, b = blobs
    f = neighbors.IVFIndex(n_lists=6, n_probes=3, n_neighbors=5).fit(b.where("id % 2 = 0"), "v", "id").extend(b.where("id % 2 = 1"), "id")
    assert f.lists.count() == 180 and f.recall(b, "id") > 0.9


def test_outlier_factor(spark, blobs):
    far = blobs[1].unionByName(spark.createDataFrame([(999, [20.0, -20.0])], "id long, v array<double>"))
    got = neighbors.LocalOutlierFactor(n_neighbors=10).fit_predict(far, "v", "id")
    assert got.orderBy(F.desc("factor")).first()["id"] == 999


def test_graphs(spark):
    e = [(0, 1), (1, 2), (5, 6), (7, 7), (9, 8)]
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8}
    edges = [(a, b) for a, b in itertools.permutations(range(5), 2) if (a * 3 + b) % 4 < 2 and a != 4]
    m = np.zeros((5, 5))
    for a, b in edges:
        m[a, b] = 1
    m = np.where(m.sum(1, keepdims=True) > 0, m / np.maximum(m.sum(1, keepdims=True), 1), 1 / 5)
    r = np.full(5, 0.2)
    for _ in range(200):
        r = 0.15 / 5 + 0.85 * r @ m
    got = {x["id"]: x["rank"] for x in graph.pagerank(spark.createDataFrame(edges, "src long, dst long"), tol=1e-12, max_iter=60).collect()}
    assert np.allclose([got[k] for k in sorted(got)], r[sorted(got)], atol=1e-6)
    cliques = [(a + 10 * g, b + 10 * g) for g in range(3) for a, b in itertools.combinations(range(5), 2)] + [(0, 10), (10, 20)]
    c = graph.Louvain(max_levels=2, max_rounds=8).fit_predict(spark.createDataFrame(cliques, "a long, b long"))
    got = {r["id"]: r["community"] for r in c.collect()}
    assert all(got[a + 10 * g] == got[10 * g] for g in range(3) for a in range(5)) and len(set(got.values())) == 3
    assert graph.modularity(spark.createDataFrame(cliques, "a long, b long"), c) > 0.5


def test_label_diffusion(spark, blobs):
    x, b = blobs
    half = b.withColumn("known", F.when(F.col("id") % 60 < 3, F.floor(F.col("id") / 60)).otherwise(-1).cast("long"))
    for m in (graph.LabelPropagation(gamma=2.0), graph.LabelSpreading(kernel="knn", n_neighbors=8)):
        assert (values(m.fit(half, "v", "known", "id").labels(spark), "label") == TRUTH).mean() > 0.95


# --- kernels ------------------------------------------------------------------------------------------------------------------


def test_support_vectors(df, data):
    x, y, c, k = data
    m = kernel.SVC(C=1.0).fit(df, COLS, "c")
    assert m.score(df, "c") > 0.85
    assert kernel.SVC(kernel="linear").fit(df, COLS, "k").score(df, "k") > 0.9
    p = np.array([r[0] for r in df.orderBy("id").select(kernel.SVC(probability=True).fit(df, COLS, "k").proba_column(COLS)).collect()])
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == k).mean() > 0.85
    a, rho = kernel.smo(np.eye(2), -np.ones(2), np.array([1.0, -1.0]), np.full(2, 10.0), np.zeros(2))
    assert np.allclose(a, [1, 1]) and abs(rho) < 1e-6
    assert kernel.SVR(C=10.0, epsilon=0.05).fit(df, COLS, "y").score(df, "y") > 0.9
    inside = kernel.OneClassSVM(nu=0.2).fit(df, COLS).predict(df).where("prediction = -1").count()
    assert 0.1 < inside / 240 < 0.3
    g = kernel.kernel_matrix("rbf", x, x, 0.5)
    kr = kernel.KernelRidge(kernel="rbf", gamma=0.5).fit(df, COLS, "y")
    rows = np.array([[r["a"], r["b"], r["d"], r["y"]] for r in df.orderBy("id").collect()])
    assert np.allclose(values(kr.predict(df), "prediction"), g @ np.linalg.solve(g + np.eye(240), rows[:, 3]))


def test_gaussian_processes(spark, df, data):
    x, y, c, k = data
    m = kernel.GaussianProcessRegressor(theta=(1.0, 0.5, -2.0), optimize=False).fit(df, COLS, "y")
    kern = math.e * np.exp(-0.5 * ((x[:, None] - x) ** 2).sum(2) / math.exp(1.0))
    want = kern @ np.linalg.solve(kern + (math.exp(-2) + 1e-10) * np.eye(240), y)
    assert np.allclose(values(m.predict(df), "prediction"), want, atol=1e-6)
    full = kernel.SVGP(n_inducing=240, theta=(1.0, 0.5, -2.0)).fit(df, COLS, "y")
    assert np.allclose(values(full.predict(df), "prediction"), want, atol=1e-2)
    assert kernel.GaussianProcessClassifier(optimize=False).fit(df, COLS, "c").score(df, "c") > 0.85
    tuned = kernel.GaussianProcessRegressor(normalize_y=True).fit(df.where("id < 60"), COLS, "y")
    assert tuned.log_marginal_likelihood_ >= kernel.GaussianProcessRegressor(normalize_y=True, optimize=False).fit(df.where("id < 60"), COLS, "y").log_marginal_likelihood_


# --- metrics --------------------------------------------------------------------------------------------------------------------


def test_curves(spark):
    y, s = [1, 0, 1, 1, 0, 0, 1, 0], [0.9, 0.9, 0.8, 0.5, 0.5, 0.5, 0.3, 0.1]
    t = spark.createDataFrame(list(zip(y, s)), "y int, s double").repartition(4)
    y, s = np.array(y), np.array(s)
    cuts = sorted(set(s.tolist()), reverse=True)
    got = metrics.roc_curve(t, "y", "s").orderBy(F.desc("threshold")).collect()
    assert [(r["fpr"], r["tpr"]) for r in got[1:]] == [((y[s >= c] == 0).sum() / 4, (y[s >= c] == 1).sum() / 4) for c in cuts]
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert math.isclose(metrics.roc_auc_score(t, "y", "s"), np.mean(pairs))
    ap, last = 0.0, 0.0
    for c in cuts:
        r = (y[s >= c] == 1).sum() / 4
        ap += (r - last) * (y[s >= c] == 1).mean()
        last = r
    assert math.isclose(metrics.average_precision_score(t, "y", "s"), ap)
    assert math.isclose(metrics.auc(t, "s", "y"), sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(sorted(zip(s, y)), sorted(zip(s, y))[1:])))


def test_label_metrics(spark):
    a, b = [0, 0, 1, 1, 2, 2, 2, 0], [0, 1, 1, 1, 2, 0, 2, 0]
    t = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    text = metrics.classification_report(t, "a", "b")
    assert "macro avg" in text and "0.75" in text
    pc = metrics.pair_confusion_matrix(t, "a", "b")
    want = np.zeros((2, 2))
    for i, j in itertools.permutations(range(8), 2):
        want[int(a[i] == a[j]), int(b[i] == b[j])] += 1
    assert np.allclose(pc, want)
    rng = np.random.default_rng(0)
    draws = []
    for _ in range(4000):
        m = np.zeros((3, 3))
        np.add.at(m, (np.array(a), rng.permutation(b)), 1)
        draws.append(metrics.mutual_info(m))
    _, _, m = metrics.counts(t, "a", "b")
    assert abs(metrics.expected_mutual_information(m.sum(1), m.sum(0)) - np.mean(draws)) < 0.01
    assert math.isclose(metrics.adjusted_mutual_info_score(t, "a", "a"), 1.0)
    assert math.isclose(metrics.cohen_kappa_score(t, "a", "b", "quadratic"), 1 - sum((i - j) ** 2 for i, j in zip(a, b)) / sum((i - j) ** 2 for i in a for j in b) * 8)


def test_ranked_gains(spark):
    t = spark.createDataFrame([([3.0, 1.0, 2.0], [0.5, 0.5, 0.1]), ([0.0, 0.0], [1.0, 2.0])], "g array<double>, s array<double>")
    d = [1, 1 / math.log2(3), 0.5]
    got = [r[0] for r in t.select(metrics.dcg_column("g", "s")).collect()]
    assert np.allclose(got, [4 * (d[0] + d[1]) / 2 + 2 * d[2], 0])
    assert [r[0] for r in t.select(metrics.ndcg_column("g", "g")).collect()][1] == 0


# --- selection ----------------------------------------------------------------------------------------------------------------


def test_group_folds(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(g), int(i % 2)) for i, g in enumerate(rng.integers(0, 12, 200) ** 2 % 13)]
    t = spark.createDataFrame(rows, "id long, g int, y int")
    f = selection.GroupKFold(4).assign(t, "id", "g").toPandas()
    assert f.groupby("g").fold.nunique().max() == 1
    sizes = f.groupby("g").size()
    load = [0] * 4
    for g in sorted(sizes.index, key=lambda g: (-sizes[g], str(g))):
        load[int(np.argmin(load))] += sizes[g]
    assert sorted(f.groupby("fold").size()) == sorted(load)
    s = selection.StratifiedGroupKFold(3).assign(t, "id", "y", "g").toPandas()
    assert s.groupby("g").fold.nunique().max() == 1 and s.groupby("fold").y.mean().std() < 0.2
    k = selection.StratifiedKFold(5, shuffle=True).assign(t, "id", "y").toPandas()
    assert set(k.groupby(["fold", "y"]).size()) == {20}


def test_searches(df):
    g = selection.GridSearchCV(estimator=linear.Ridge(), param_grid={"alpha": [1e-3, 1e5]}, cv=3).fit(df, COLS, "y", "id")
    assert g.best_params_ == {"alpha": 1e-3} and len(selection.ParameterGrid({"a": [1, 2], "b": [1, 2, 3]})) == 6
    assert len({str(p) for p in selection.ParameterSampler({"a": list(range(9))}, 5)}) == 5
    c = selection.cross_val_score(linear.GaussianNB(), df, COLS, "k", "id", cv=3, scoring="f1_macro")
    assert min(c) > 0.8
    with pytest.raises(ValueError):
        selection.get_scorer("nothing")
    real, fake, p = selection.permutation_test_score(linear.Ridge(), df, COLS, "y", "id", cv=2, n_permutations=4)
    assert real > 0.9 > max(fake) and p == 0.2


def test_resampling(spark, df, data):
    y = data[1]
    b = selection.bootstrap(df, "y", "id", n_resamples=600)
    assert abs(b["standard_error"] / (y.std(ddof=1) / math.sqrt(240)) - 1) < 0.15 and b["low"] < y.mean() < b["high"]
    for how in ("basic", "bca"):
        o = selection.bootstrap(df, "y", "id", method=how)
        assert abs(o["low"] - b["low"]) < 0.1 and abs(o["high"] - b["high"]) < 0.1
    assert selection.permutation_test(df, "a", "c", "id")["p"] < 0.01
    assert selection.permutation_test(df.withColumn("h", F.col("id") % 2), "a", "h", "id")["p"] > 0.01
    r = selection.resample_indices(df, "id", 500).toPandas()
    assert len(r) == 500 and r.row.between(0, 239).all()


def test_models_of_models(df):
    nb, lda = linear.GaussianNB(), linear.LinearDiscriminantAnalysis()
    assert selection.VotingClassifier(estimators=(nb, lda), voting="soft").fit(df, COLS, "k").score(df, "k") > 0.85
    assert selection.BaggingRegressor(estimator=linear.Ridge(), n_estimators=3).fit(df, COLS, "y", key="id").score(df, "y") > 0.9
    assert selection.StackingClassifier(estimators=(nb, lda), final_estimator=linear.LogisticRegression(), cv=2).fit(df, COLS, "k", key="id").score(df, "k") > 0.85
    assert selection.StackingRegressor(estimators=(linear.Ridge(), linear.Lasso(alpha=0.1)), final_estimator=linear.LinearRegression(), cv=2).fit(df, COLS, "y", key="id").score(df, "y") > 0.9
    assert selection.OneVsRestClassifier(estimator=linear.LogisticRegression()).fit(df, COLS, "k").score(df, "k") > 0.8
    for how in ("sigmoid", "isotonic"):
        m = selection.CalibratedClassifierCV(estimator=linear.LinearSVC(), method=how, cv=2).fit(df, COLS, "c", key="id")
        p = np.array([r[0][1] for r in df.select(m.proba_column(COLS)).collect()])
        assert (0 <= p).all() and (p <= 1).all() and m.score(df, "c") > 0.8


# --- series -----------------------------------------------------------------------------------------------------------------------


def series(spark, y, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(y)], "s string, t int, y double")


def ahead(m, df, h):
    return [r["forecast"] for r in m.forecast(df, "s", "t", "y", h).orderBy("step").collect()]


def test_arima(spark):
    rng = np.random.default_rng(9)
    y = np.zeros(400)
    for k in range(1, 400):
        y[k] = 0.7 * y[k - 1] + rng.normal()
    s = forecast.ARIMA(order=(1, 0, 0)).fit_series(y + 5)
    assert abs(s["ar1"] - 0.7) < 0.1 and abs(s["mean"] - 5) < 0.5
    like = -0.5 * (400 * math.log(2 * math.pi * s["sigma2"]) + (math.log(1 / (1 - s["ar1"] ** 2))) + ((y + 5 - s["mean"])[0] ** 2 * (1 - s["ar1"] ** 2) + (((y + 5 - s["mean"])[1:] - s["ar1"] * (y + 5 - s["mean"])[:-1]) ** 2).sum()) / s["sigma2"])
    assert math.isclose(s["loglike"], like, rel_tol=1e-6)
    walk = np.cumsum(rng.normal(size=200) + 0.5)
    a = forecast.AutoARIMA(max_p=1, max_q=0, rounds=10)
    assert a.fit_series(walk)["d"] == 1
    f = ahead(a, series(spark, walk), 3)
    assert abs(f[2] - walk[-1] - 1.5) < 1.5
    assert np.allclose(ahead(forecast.ARIMA(order=(0, 1, 0), seasonal_order=(0, 1, 0, 4), fit_intercept=False), series(spark, [1, 2, 3, 4] * 6), 4), [1, 2, 3, 4], atol=1e-6)


def test_smoothing(spark):
    t = np.arange(72)
    y = 50 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 12)
    want = 50 + 0.5 * np.arange(72, 84) + 10 * np.sin(2 * np.pi * np.arange(72, 84) / 12)
    for m in (forecast.ExponentialSmoothing(seasonal_periods=12), forecast.ETS(season_length=12, model="AAA"), forecast.Theta(season_length=12), forecast.ExponentialSmoothing(seasonal_periods=12, seasonal="mul")):
        assert np.abs(np.array(ahead(m, series(spark, y), 12)) - want).mean() < 4
    season, trend, rest = forecast.STL(period=12).decompose_series(y)
    assert np.abs(rest).max() < 0.5 and np.abs(season - 10 * np.sin(2 * np.pi * t / 12)).max() < 0.8
    out = y.copy()
    out[30] += 100
    assert np.abs(forecast.STL(period=12, robust=True).decompose_series(out)[0] - season).max() < 1.5
    z = [0, 0, 3, 0, 0, 3, 0, 0, 3]
    assert np.allclose(ahead(forecast.CrostonClassic(), series(spark, z), 1), [1.0]) and np.allclose(ahead(forecast.CrostonSBA(), series(spark, z), 1), [0.95])
    with pytest.raises(ValueError):
        forecast.ExponentialSmoothing(seasonal="other")
    with pytest.raises(Exception, match="more than 5"):
        forecast.Theta(limit=5).forecast(series(spark, y), "s", "t", "y", 1).collect()


def test_volatility_and_vectors(spark):
    rng = np.random.default_rng(2)
    e, s = np.zeros(1500), np.ones(1500)
    for k in range(1, 1500):
        s[k] = 0.1 + 0.15 * e[k - 1] ** 2 + 0.75 * s[k - 1]
        e[k] = math.sqrt(s[k]) * rng.normal()
    g = forecast.GARCH().fit_series(e)
    assert abs(g["alpha1"] - 0.15) < 0.1 and abs(g["beta1"] - 0.75) < 0.2
    a = np.array([[0.5, 0.1], [0.0, 0.4]])
    y = np.zeros((300, 2))
    for k in range(1, 300):
        y[k] = a @ y[k - 1] + [1, 2] + rng.normal(size=2) * 0.1
    rows = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(y)], "t int, p double, q double").repartition(5)
    m = forecast.VAR().fit(rows, "t", ["p", "q"])
    z = np.column_stack([y[:-1], np.ones(299)])
    w = np.linalg.lstsq(z, y[1:], rcond=None)[0]
    assert np.allclose(m.coefs_[0], w[:2].T) and np.allclose(m.forecast(1)[0], w[:2].T @ y[-1] + w[2])
    days = spark.sql("SELECT timestamp_seconds(id * 86400) AS t, 5 + id * 0.1 + 3 * sin(2 * pi() * id / 7) AS y FROM range(200)")
    p = forecast.ProphetForecaster(yearly=0).fit(days, "t", "y").predict(days)
    assert p.agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 0.3


# --- tensors, files, networks, text, streams ------------------------------------------------------------------------------------------


def proto(field, value):
    """A field of a protocol buffer."""
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    if isinstance(value, int):
        return varint(field << 3) + varint(value & (2**64 - 1))
    value = value.encode() if isinstance(value, str) else value
    return varint(field << 3 | 2) + varint(len(value)) + value


def onnx_bytes(w, b):
    def t(name, a):
        return b"".join(proto(1, n) for n in a.shape) + proto(2, 1) + proto(8, name) + proto(9, a.astype("<f4").tobytes())

    def node(op, ins, outs, *attrs):
        return b"".join(proto(1, i) for i in ins) + b"".join(proto(2, o) for o in outs) + proto(4, op) + b"".join(proto(5, a) for a in attrs)

    dim = lambda d: proto(1, proto(1, d)) if d else proto(1, proto(2, "n"))
    shape = proto(2, proto(1, proto(1, 1) + proto(2, dim(None) + dim(w.shape[0]))))
    axis = proto(1, "axis") + proto(3, 1) + proto(20, 2)
    graph = proto(1, node("MatMul", ["x", "w"], ["h"])) + proto(1, node("Add", ["h", "b"], ["g"])) + proto(1, node("Relu", ["g"], ["r"])) + proto(1, node("Softmax", ["r"], ["out"], axis))
    graph += proto(5, t("w", w)) + proto(5, t("b", b)) + proto(11, proto(1, "x") + shape) + proto(12, proto(1, "out"))
    return proto(1, 8) + proto(7, graph)


def test_onnx_and_safetensors(spark, tmp_path):
    rng = np.random.default_rng(0)
    w, b, x = rng.normal(size=(3, 4)).astype(np.float32), rng.normal(size=4).astype(np.float32), rng.normal(size=(9, 3))
    (tmp_path / "m.onnx").write_bytes(onnx_bytes(w, b))
    p = files.read_onnx(spark, f"file://{tmp_path}/m.onnx")
    rows = spark.createDataFrame([(i, [float(q) for q in v]) for i, v in enumerate(x)], "id long, x array<double>")
    got = np.array([r[0] for r in rows.select("id", p.column().alias("o")).orderBy("id").select("o").collect()])
    z = np.maximum(x @ w + b, 0)
    assert np.allclose(got, np.exp(z) / np.exp(z).sum(1, keepdims=True), atol=1e-6)
    (tmp_path / "t.safetensors").write_bytes(files.write_safetensors({"w": w, "h": b.astype(np.float16)}))
    f = files.SafetensorsFile(spark, f"file://{tmp_path}/t.safetensors")
    assert f.names() == ["h", "w"] and np.array_equal(f.read("w"), w) and f.read("h").dtype == np.float32
    raw = json.dumps({"z": {"dtype": "BF16", "shape": [2], "data_offsets": [0, 4]}}).encode()
    (tmp_path / "b.safetensors").write_bytes(struct.pack("<Q", len(raw)) + raw + struct.pack("<HH", 0x3F80, 0xC000))
    assert files.SafetensorsFile(spark, f"file://{tmp_path}/b.safetensors").read("z").tolist() == [1.0, -2.0]
    found = files.catalog(spark, f"file://{tmp_path}").collect()
    assert len(found) == 3 and files.verify(spark, f"file://{tmp_path}", {"m.onnx": files.digest(onnx_bytes(w, b)), "none": ""}) == ["none"]
    files.write_npz(f"{tmp_path}/a.npz", {"w": w})
    assert np.array_equal(files.read_npz(spark, f"file://{tmp_path}/a.npz")["w"], w)
    with pytest.raises(ValueError, match="no operator"):
        tensor.Program([("Loop", ["x"], ["y"], {})], {}, {"x": (1,)}, "y")


def test_arrays(spark):
    a = np.arange(12, dtype=np.uint16).reshape(4, 3)
    f = files.array_frame(spark, a)
    assert dict(f.dtypes)["x"] == "array<int>" and files.view(f, "x")["width"] == 3 and files.view(f, "x")["regular"]
    t = files.to_triples(f, "row", "x")
    assert [list(r["x"]) for r in files.from_triples(t, 3).orderBy("row").collect()] == a.astype(float).tolist()
    c = files.from_csr(spark, [0, 2, 2, 3], [0, 2, 1], [1.0, 2.0, 3.0])
    assert c.count() == 3 and c.where("row = 2").first()["col"] == 1
    n = files.numbers_with_nan(spark.createDataFrame([(None, True), (1.0, False)], "a double, b boolean"), ["a", "b"]).collect()
    assert math.isnan(n[0]["a"]) and n[0]["b"] == 1.0
    s = files.scatter(f, "row", spark.createDataFrame([(1, [9, 9, 9])], "p long, x array<int>"), "p", "x")
    assert s.where("row = 1").first()["x"] == [9, 9, 9] and files.take(f, "row", spark.createDataFrame([(3,), (7,)], "p long"), "p").where("x is null").count() == 1


def test_tensor_operators():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 3, 6, 6))
    w = rng.normal(size=(4, 3, 3, 3))
    y, _ = tensor.apply("Conv", [x, w], [True, False], pads=[1, 1, 1, 1], strides=[2, 2])
    p = np.pad(x, [(0, 0), (0, 0), (1, 1), (1, 1)])
    want = np.array([[[[(p[n, :, 2 * i : 2 * i + 3, 2 * j : 2 * j + 3] * w[m]).sum() for j in range(3)] for i in range(3)] for m in range(4)] for n in range(2)])
    assert np.allclose(y, want)
    g, _ = tensor.apply("Conv", [x[:, :2], w[:, :1]], [True, False], group=2)
    assert g.shape == (2, 4, 4, 4) and np.allclose(g[:, 0], tensor.apply("Conv", [x[:, :1], w[:1, :1]], [True, False])[0][:, 0])
    m, _ = tensor.apply("MaxPool", [x], [True], kernel_shape=[2, 2], strides=[2, 2])
    assert np.allclose(m, x.reshape(2, 3, 3, 2, 3, 2).max((3, 5)))
    c, _ = tensor.apply("CumSum", [x[0, 0]], [True], axis=0, exclusive=1)
    assert np.allclose(c, np.cumsum(x[0, 0], 1) - x[0, 0])
    for name in ("identity", "logistic", "tanh", "relu", "softmax"):
        f, b = tensor.activation(name)
        z, d = rng.normal(size=(3, 4)), rng.normal(size=(3, 4))
        num = np.zeros_like(z)
        for i in np.ndindex(z.shape):
            e = np.zeros_like(z)
            e[i] = 1e-6
            num[i] = ((f(z + e) - f(z - e)) * d).sum() / 2e-6
        assert np.allclose(b(f(z), d), num, atol=1e-6)


def test_networks(df):
    assert neural.MLPClassifier(hidden_layer_sizes=(16,), max_iter=25).fit(df, COLS, "k").score(df, "k") > 0.85
    assert neural.MLPRegressor(hidden_layer_sizes=(16,), max_iter=40).fit(df, COLS, "y").score(df, "y") > 0.85
    with pytest.raises(NotImplementedError):
        neural.LSTMRegressor
    for name, cls in neural.OPTIMIZERS.items():
        p, o = [np.array([1.0, -2.0]), np.ones((2, 2))], cls(lr=0.05)
        start = sum((v * v).sum() for v in p)
        for _ in range(60):
            o.step(p, [2 * v for v in p])
        assert sum((v * v).sum() for v in p) < start, name
        q, o = [np.array([1.0])], cls(lr=0.01, maximize=True)
        o.step(q, [np.array([1.0])])
        assert q[0][0] > 1.0, name


def test_adam_by_hand():
    p, o = [np.array([1.0])], neural.Adam(lr=0.1)
    m = v = 0.0
    x = 1.0
    for t in range(1, 4):
        g = 2 * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.1 * (m / (1 - 0.9**t)) / (math.sqrt(v / (1 - 0.999**t)) + 1e-8)
        o.step(p, [2 * p[0]])
    assert math.isclose(p[0][0], x)


def test_bpe(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    ours, theirs = bpe.BpeTokenizer.load(path), Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    texts = ["Hello world, it's  fine\n\n  x", "naïve Übung 漢字 ½", "", " \t", "aaaaaaaaaaaaaaaaaaaaaa1234567890", "don't we'll I'M"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "id int, t string").select("id", ours.encode_column("t").alias("ids"))
    got = {r["id"]: r["ids"] for r in rows.collect()}
    assert [got[i] for i in range(len(texts))] == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)] and got[9] is None
    assert [ours.decode(got[i]) for i in range(len(texts))] == texts and len(ours.fingerprint()) == 64
    low = bpe.BpeTokenizer({b"a": 0, b"b": 1, b"ab": 2, b"aba": 3})
    assert low.encode("ababa") == [2, 3] or low.encode("ababa") == [2, 2, 0]


def test_partial_fit_of_a_stream(spark, df, tmp_path):
    df.select("id", *COLS).repartition(6).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long, a double, b double, d double").option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
    m = preprocess.StandardScaler()
    fit_stream(m, stream, lambda model, batch: model.partial_fit(batch, COLS), f"file://{tmp_path}/model", f"file://{tmp_path}/ck").awaitTermination()
    whole = preprocess.StandardScaler().fit(df, COLS)
    held = preprocess.StandardScaler.load(spark, f"file://{tmp_path}/model/last")
    assert held.state["batch"] >= 2 and np.allclose([s["var"] for s in held.stats_], [s["var"] for s in whole.stats_])


def test_layer_gradients():
    """Every layer's gradients against differences."""
    rng = np.random.default_rng(6)
    n = lambda *s: rng.normal(size=s)
    cases = {
        "conv2d": (lambda x, w, b: layers.conv2d(x, w, b, 2, 1), [n(2, 3, 5, 6), n(4, 3, 3, 3), n(4)]),
        "conv1d": (lambda x, w, b: layers.conv1d(x, w, b, 1, 1), [n(2, 3, 7), n(2, 3, 3), n(2)]),
        "max_pool2d": (lambda x: layers.max_pool2d(x, 2, 2, 1), [n(2, 2, 4, 6)]),
        "avg_pool2d": (lambda x: layers.avg_pool2d(x, 3, 2), [n(2, 2, 7, 7)]),
        "max_pool1d": (lambda x: layers.max_pool1d(x, 3), [n(2, 2, 9)]),
        "avg_pool1d": (lambda x: layers.avg_pool1d(x, 3), [n(2, 2, 9)]),
        "adaptive_avg": (layers.adaptive_avg_pool2d, [n(2, 3, 4, 4)]),
        "adaptive_max": (layers.adaptive_max_pool2d, [n(2, 3, 4, 4)]),
        "batch_norm2d": (layers.batch_norm, [n(3, 2, 4, 4), n(2), n(2)]),
        "batch_norm1d": (layers.batch_norm, [n(6, 3), n(3), n(3)]),
        "layer_norm": (layers.layer_norm, [n(4, 5), n(5), n(5)]),
        "rms_norm": (layers.rms_norm, [n(4, 5), n(5)]),
        "linear": (layers.linear, [n(4, 5), n(5, 3), n(3)]),
        "embedding": (lambda t: layers.embedding(np.array([0, 2, 2, 1]), t), [n(4, 3)]),
        "dropout2d": (lambda x: layers.dropout2d(x, np.arange(3), 0.4), [n(3, 4, 2, 2)]),
        "basic_block": (lambda *v: layers.basic_block(*v[:7], 2, v[7]), [n(2, 2, 6, 6), n(3, 2, 3, 3), n(3), n(3), n(3, 3, 3, 3), n(3), n(3), n(3, 2, 1, 1)]),
    }
    for name, (fn, args) in cases.items():
        y, back = fn(*args)
        d = rng.normal(size=y.shape)
        got = back(d)
        got = got if isinstance(got, tuple) else (got,)
        for k, a in enumerate(args):
            for i in [tuple(rng.integers(0, s) for s in a.shape) for _ in range(6)]:
                e = np.zeros_like(a)
                e[i] = 1e-6
                up, down = (fn(*args[:k], a + s * e, *args[k + 1 :])[0] for s in (1, -1))
                assert abs(((up - down) * d).sum() / 2e-6 - got[k][i]) < 1e-4, (name, k)
    x, w, y = n(10, 4), n(4, 3), rng.integers(0, 3, 10)
    whole, back = layers.cross_entropy(x @ w, y)
    part, chunked = layers.chunked_cross_entropy(x, w, y, 4)
    assert math.isclose(whole, part) and np.allclose(chunked()[1], x.T @ back())
