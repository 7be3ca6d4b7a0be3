"""Queries that fit the estimators of millrace.learn to the tables.

Where SQL can state the result in another way (closed forms, unrolled iterations, pair joins) it is given; the other
operators are held against brute force by the tests.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import catalog
from millrace.functions import bpe, tensor
from millrace.learn import cluster, decompose, forecast, graph, kernel, linear, metrics, neighbors, neural, preprocess, selection, trees
from millrace.operators.fitted import asked, classes, frame, one, orders, rounded, table, vectors_of
from millrace.operators.vectors import _DUCK
from millrace.plans.sqltext import twin


def model(name: str, sql: str | None = None):
    def add(fn):
        if name in catalog.QUERIES:
            raise ValueError(f"two queries are named {name}")
        catalog.QUERIES[name] = fn
        if sql:
            catalog.ORACLE_SQL[name] = twin(sql)
        return fn

    return add


def lines(spark, sf_dir) -> DataFrame:
    """Line items with a key, scaled price and classes."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 100).alias("t"), (F.col("l_extendedprice") / 1000).alias("p"), F.col("l_returnflag").alias("f"), F.when(F.col("l_quantity") + F.col("l_linenumber") * 7 + F.col("l_partkey") % 23 > 55, 1).otherwise(0).alias("y"), (F.col("l_linenumber") + F.floor(F.col("l_quantity") / 10)).cast("double").alias("n"))


def customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("a"), (F.col("c_custkey") % 17 / 4.0).alias("b"), F.col("c_mktsegment").alias("m"), (F.col("c_nationkey") % 3).alias("g"), (F.col("c_acctbal") / 500 + F.col("c_custkey") % 17 + F.col("c_nationkey") % 5).alias("y"))


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("t"), "value")


def wide(df: DataFrame, *keep: str, column: str, digits: int = 6) -> DataFrame:
    """One row per element of an array column, rounded."""
    return df.select(*keep, F.posexplode(column).alias("k", "v")).select(*keep, "k", (F.round("v", digits) + 0.0).alias("v"))


def row(spark: SparkSession, digits: int = 6, **values) -> DataFrame:
    return rounded(one(spark, **values), digits, *values)


XQ = ["q", "d", "t"]

# --- unrolled Newton steps: SQL that fits a two-weight model of one feature --------------------------------------------------


def newton_sql(source: str, grad: str, curve: str, ridge: float, start: tuple[str, str], steps: int = 12, scale: str = "1e0") -> str:
    """Weights (w, b) after Newton steps on sum(loss)/scale + ridge/2 w^2; grad and curve are d/dm and d2/dm2 at m = wx + b."""
    out = [f"WITH x AS ({source}), s AS (SELECT max(1e0) * {scale} AS c FROM x), w0 AS (SELECT max(0e0) + {start[0]} AS w, max(0e0) + {start[1]} AS b FROM x)"]
    for k in range(steps):
        out.append(
            f"g{k} AS (SELECT any_value(w) AS w, any_value(b) AS b, sum(g * x) / any_value(c) + {ridge} * any_value(w) AS gw, sum(g) / any_value(c) AS gb, sum(h * x * x) / any_value(c) + {ridge} AS hw, sum(h * x) / any_value(c) AS hx, sum(h) / any_value(c) AS hb FROM (SELECT x, y, w, b, c, {grad} AS g, {curve} AS h FROM (SELECT x, y, w, b, c, w * x + b AS m FROM x, w{k}, s)))"
        )
        out.append(f"w{k + 1} AS (SELECT w - (gw * hb - gb * hx) / (hw * hb - hx * hx) AS w, b - (gb * hw - gw * hx) / (hw * hb - hx * hx) AS b FROM g{k})")
    return ", ".join(out) + f" SELECT round(w, 5) AS w, round(b, 5) AS b FROM w{steps}"


_LINES = "SELECT l_quantity / 10 AS x, CASE WHEN l_quantity + l_linenumber * 7 + l_partkey % 23 > 55 THEN 1e0 ELSE 0e0 END AS y FROM lineitem"
_COUNTS = "SELECT l_quantity / 10 AS x, l_linenumber + floor(l_quantity / 10) AS y FROM lineitem"
_SIG = "1 / (1 + exp(-m))"


def _lines10(spark, sf_dir):
    return lines(spark, sf_dir).withColumn("x", F.col("q") / 10)


@model("logistic_regression", newton_sql(_LINES, f"{_SIG} - y", f"{_SIG} * (1 - {_SIG})", 1.0, ("0e0", "0e0")))
def logistic_regression(spark, sf_dir):
    m = linear.LogisticRegression().fit(_lines10(spark, sf_dir), ["x"], "y")
    return row(spark, 5, w=m.coef_[0][0], b=m.intercept_[0])


@model("poisson_regressor", newton_sql(_COUNTS, "exp(m) - y", "exp(m)", 0.01, ("0e0", "ln(avg(y))"), scale="count(*)"))
def poisson_regressor(spark, sf_dir):
    m = linear.PoissonRegressor(alpha=0.01).fit(_lines10(spark, sf_dir), ["x"], "n")
    return row(spark, 5, w=m.coef_[0], b=m.intercept_)


@model("gamma_regressor", newton_sql(_COUNTS, "1 - y * exp(-m)", "1e0", 0.01, ("0e0", "ln(avg(y))"), steps=40, scale="count(*)"))
def gamma_regressor(spark, sf_dir):
    m = linear.GammaRegressor(alpha=0.01, tol=1e-14).fit(_lines10(spark, sf_dir), ["x"], "n")
    return row(spark, 5, w=m.coef_[0], b=m.intercept_)


@model("tweedie_regressor", newton_sql(_COUNTS, "exp(0.5 * m) - y * exp(-0.5 * m)", "exp(0.5 * m)", 0.01, ("0e0", "ln(avg(y))"), steps=30, scale="count(*)"))
def tweedie_regressor(spark, sf_dir):
    m = linear.TweedieRegressor(power=1.5, alpha=0.01, tol=1e-14).fit(_lines10(spark, sf_dir), ["x"], "n")
    return row(spark, 5, w=m.coef_[0], b=m.intercept_)


@model("quasi_newton_regressor", newton_sql(_LINES, "m - y", "1e0", 0.5, ("0e0", "0e0"), steps=1, scale="count(*)").replace("round(w, 5)", "round(w, 4)").replace("round(b, 5)", "round(b, 4)"))
def quasi_newton_regressor(spark, sf_dir):
    m = linear.QNRegressor(loss="squared", l2=0.5).fit(_lines10(spark, sf_dir), ["x"], "y")
    return row(spark, 4, w=m.coef_[0][0], b=m.intercept_[0])


_HINGE = newton_sql(_LINES, "CASE WHEN (2 * y - 1) * m < 1 THEN 2e-2 * (m - (2 * y - 1)) ELSE 0 END", "CASE WHEN (2 * y - 1) * m < 1 THEN 2e-2 ELSE 0 END", 1.0, ("0e0", "0e0"), steps=25).replace("/ any_value(c) AS gb", "/ any_value(c) + any_value(b) AS gb").replace("sum(h) / any_value(c) AS hb", "sum(h) / any_value(c) + 1 AS hb")


@model("linear_svc", _HINGE)
def linear_svc(spark, sf_dir):
    m = linear.LinearSVC(C=0.01, tol=1e-14).fit(_lines10(spark, sf_dir), ["x"], "y")
    return row(spark, 5, w=m.coef_[0][0], b=m.intercept_[0])


@model("linear_svr", newton_sql("SELECT l_quantity / 10 AS x, l_extendedprice / 1000 AS y FROM lineitem", "CASE WHEN abs(m - y) > 1 THEN 2e-2 * (m - y - sign(m - y)) ELSE 0 END", "CASE WHEN abs(m - y) > 1 THEN 2e-2 ELSE 0 END", 1.0, ("0e0", "0e0"), steps=25).replace("/ any_value(c) AS gb", "/ any_value(c) + any_value(b) AS gb").replace("sum(h) / any_value(c) AS hb", "sum(h) / any_value(c) + 1 AS hb"))
def linear_svr(spark, sf_dir):
    m = linear.LinearSVR(C=0.01, epsilon=1.0, tol=1e-14).fit(_lines10(spark, sf_dir), ["x"], "p")
    return row(spark, 5, w=m.coef_[0], b=m.intercept_)


@model("ridge_classifier", "SELECT round(s / (v + 1e0), 6) AS w, round(t - s / (v + 1e0) * m, 6) AS b FROM (SELECT covar_pop(x, 2 * y - 1) * count(*) AS s, var_pop(x) * count(*) AS v, avg(x) AS m, avg(2 * y - 1) AS t FROM (" + _LINES + "))")
def ridge_classifier(spark, sf_dir):
    m = linear.RidgeClassifier().fit(_lines10(spark, sf_dir), ["x"], "y")
    return row(spark, 6, w=m.coef_[0][0], b=m.intercept_[0])


@model("isotonic_regression", "WITH g AS (SELECT l_quantity AS x, sum(y) AS s, count(*) AS n FROM (SELECT l_quantity, l_extendedprice / l_quantity AS y FROM lineitem) GROUP BY l_quantity), c AS (SELECT x, sum(s) OVER (ORDER BY x) AS cs, sum(n) OVER (ORDER BY x) AS cn, s, n FROM g), m AS (SELECT a.x AS lo, b.x AS hi, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS v FROM c a JOIN c b ON a.x <= b.x), w AS (SELECT g.x, m.lo, min(m.v) AS v FROM g JOIN m ON m.lo <= g.x AND m.hi >= g.x GROUP BY g.x, m.lo) SELECT x, round(max(v), 6) AS v FROM w GROUP BY x")
def isotonic_regression(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("y"))
    return linear.IsotonicRegression().fit(x, "x", "y").predict(x.select("x").distinct(), "v").select("x", F.round("v", 6).alias("v"))


# --- linear models without a short SQL form ------------------------------------------------------------------------------------

_PREDICT = {
    "elastic_net": lambda: linear.ElasticNet(alpha=0.1),
    "lars": lambda: linear.Lars(),
    "lasso_lars": lambda: linear.LassoLars(alpha=0.01),
    "bayesian_ridge": lambda: linear.BayesianRidge(),
    "ard_regression": lambda: linear.ARDRegression(),
    "huber_regressor": lambda: linear.HuberRegressor(max_iter=10),
    "quantile_regressor": lambda: linear.QuantileRegressor(quantile=0.8, alpha=0.0, max_iter=12),
    "decision_tree_regressor": lambda: trees.DecisionTreeRegressor(max_depth=4),
    "random_forest_regressor": lambda: trees.RandomForestRegressor(n_estimators=6, max_depth=4, oob_score=True),
    "extra_trees_regressor": lambda: trees.ExtraTreesRegressor(n_estimators=6, max_depth=4),
    "gradient_boosting_regressor": lambda: trees.GradientBoostingRegressor(n_estimators=4),
    "ordered_rmse": lambda: trees.OrderedRMSE(n_estimators=3, max_depth=3),
    "adaboost_regressor": lambda: trees.AdaBoostRegressor(n_estimators=3, max_depth=2),
    "dart_regressor": lambda: trees.DARTRegressor(n_estimators=4),
}
for _name, _make in _PREDICT.items():

    @model(_name)
    def predicted(spark, sf_dir, make=_make):
        """Fitted to price by quantity, discount and tax; a prediction per line item."""
        x = lines(spark, sf_dir)
        return make().fit(x, XQ, "p").predict(x).select("id", F.round("prediction", 5).alias("prediction"))


_CLASSIFY = {
    "logistic_multiclass": lambda: linear.LogisticRegression(max_iter=6, tol=1e-4),
    "linear_discriminant_analysis": lambda: linear.LinearDiscriminantAnalysis(),
    "quadratic_discriminant_analysis": lambda: linear.QuadraticDiscriminantAnalysis(),
    "multinomial_nb_predict": lambda: linear.MultinomialNB(),
    "decision_tree_classifier": lambda: trees.DecisionTreeClassifier(max_depth=4),
    "random_forest_classifier": lambda: trees.RandomForestClassifier(n_estimators=6, max_depth=4, class_weight="balanced"),
    "extra_trees_classifier": lambda: trees.ExtraTreesClassifier(n_estimators=6, max_depth=4),
    "adaboost_classifier": lambda: trees.AdaBoostClassifier(n_estimators=3),
    "gradient_boosting_multiclass": lambda: trees.GradientBoosting(loss="multiclass", n_estimators=2, max_depth=2),
    "mlp_classifier": lambda: neural.MLPClassifier(hidden_layer_sizes=(8,), max_iter=2, batches=2),
    "one_vs_rest_classifier": lambda: selection.OneVsRestClassifier(estimator=linear.LinearSVC(C=0.01, max_iter=4)),
    "voting_classifier": lambda: selection.VotingClassifier(estimators=(linear.GaussianNB(), linear.LinearDiscriminantAnalysis(), linear.NearestCentroid())),
}
for _name, _make in _CLASSIFY.items():

    @model(_name)
    def classified(spark, sf_dir, make=_make):
        """Fitted to the return flag by quantity, discount and tax; a class per line item."""
        x = lines(spark, sf_dir)
        return make().fit(x, XQ, "f").predict(x).select("id", "prediction")


_KEYED = {
    "ridge_cv": (lambda: linear.RidgeCV(), "p"),
    "lasso_cv": (lambda: linear.LassoCV(n_alphas=10), "p"),
    "elastic_net_cv": (lambda: linear.ElasticNetCV(n_alphas=10, l1_ratio=(0.2, 0.8)), "p"),
    "logistic_regression_cv": (lambda: linear.LogisticRegressionCV(Cs=(0.01, 1.0), cv=2, max_iter=4), "y"),
    "sgd_classifier": (lambda: linear.SGDClassifier(max_iter=2, parts=4), "y"),
    "sgd_regressor": (lambda: linear.SGDRegressor(max_iter=2, eta0=1e-4, parts=4), "p"),
    "perceptron": (lambda: linear.Perceptron(max_iter=2, parts=4), "y"),
    "passive_aggressive_classifier": (lambda: linear.PassiveAggressiveClassifier(max_iter=2, parts=4), "y"),
    "passive_aggressive_regressor": (lambda: linear.PassiveAggressiveRegressor(max_iter=2, parts=4), "p"),
    "bagging_classifier": (lambda: selection.BaggingClassifier(estimator=linear.GaussianNB(), n_estimators=3), "y"),
    "bagging_regressor": (lambda: selection.BaggingRegressor(estimator=linear.Ridge(), n_estimators=3), "p"),
    "stacking_classifier": (lambda: selection.StackingClassifier(estimators=(linear.GaussianNB(), linear.LinearDiscriminantAnalysis()), final_estimator=linear.LogisticRegression(), cv=2), "y"),
    "stacking_regressor": (lambda: selection.StackingRegressor(estimators=(linear.Ridge(), linear.Lasso(alpha=0.1)), final_estimator=linear.LinearRegression(), cv=2), "p"),
    "calibrated_classifier_cv": (lambda: selection.CalibratedClassifierCV(estimator=linear.LinearSVC(C=0.01, max_iter=4), cv=2), "y"),
    "voting_regressor": (lambda: selection.VotingRegressor(estimators=(linear.Ridge(), linear.LinearRegression())), "p"),
}
for _name, (_make, _label) in _KEYED.items():

    @model(_name)
    def keyed_model(spark, sf_dir, make=_make, label=_label):
        """Fitted with folds, draws or orders by the key; a prediction per line item."""
        x = lines(spark, sf_dir)
        m = make()
        p = m.fit(x, XQ, label, key="id").predict(x)
        return p.select("id", F.round(F.col("prediction").cast("double"), 5).alias("prediction"))


@model("sgd_one_class_svm")
def sgd_one_class_svm(spark, sf_dir):
    x = lines(spark, sf_dir)
    return linear.SGDOneClassSVM(nu=0.2, max_iter=2, parts=4).fit(x, XQ, key="id").predict(x).select("id", "prediction")


@model("gradient_boosting_classifier")
def gradient_boosting_classifier(spark, sf_dir):
    x = lines(spark, sf_dir)
    return trees.GradientBoostingClassifier(n_estimators=3).fit(x, XQ, "y").predict(x).select("id", "prediction")


@model("dart_classifier")
def dart_classifier(spark, sf_dir):
    x = lines(spark, sf_dir)
    return trees.DARTClassifier(n_estimators=3).fit(x, XQ, "y").predict(x).select("id", "prediction")


@model("gradient_boosting")
def gradient_boosting(spark, sf_dir):
    """Symmetric trees with early stopping on the lines of every fifth order."""
    x = lines(spark, sf_dir).withColumn("held", F.floor(F.col("id") / 10) % 5 == 0)
    m = trees.GradientBoosting(n_estimators=4, max_depth=3, od_wait=2).fit(x.where("not held"), XQ, "p", eval=x.where("held"))
    return m.predict(x).select("id", F.round("prediction", 5).alias("prediction"))


@model("gradient_boosting_ranking")
def gradient_boosting_ranking(spark, sf_dir):
    """Ranks the lines within each order by quantity and discount."""
    x = lines(spark, sf_dir).withColumn("g", F.floor(F.col("id") / 10))
    m = trees.GradientBoosting(loss="query_rmse", n_estimators=2, max_depth=2).fit(x, ["q", "d"], "p", group="g")
    return m.predict(x).select("id", F.round("prediction", 5).alias("prediction"))


@model("multi_output_regressor")
def multi_output_regressor(spark, sf_dir):
    x = lines(spark, sf_dir)
    return rounded(selection.MultiOutputRegressor(estimator=linear.Ridge()).fit(x, XQ, ["p", "n"]).predict(x).select("id", "p_prediction", "n_prediction"), 5, "p_prediction", "n_prediction")


@model("multi_output_classifier")
def multi_output_classifier(spark, sf_dir):
    x = lines(spark, sf_dir)
    return selection.MultiOutputClassifier(estimator=linear.GaussianNB()).fit(x, XQ, ["f", "y"]).predict(x).select("id", "f_prediction", "y_prediction")


@model("mlp_regressor")
def mlp_regressor(spark, sf_dir):
    x = lines(spark, sf_dir)
    return neural.MLPRegressor(hidden_layer_sizes=(8,), max_iter=2, batches=2).fit(x, XQ, "p").predict(x).select("id", F.round("prediction", 5).alias("prediction"))


@model("random_trees_embedding")
def random_trees_embedding(spark, sf_dir):
    x = lines(spark, sf_dir)
    return trees.RandomTreesEmbedding(n_estimators=3, max_depth=3).fit_transform(x, XQ).select("id", "transformed")


_STUMP = "WITH x AS (SELECT l_quantity AS q, l_extendedprice / 1000 AS p FROM lineitem), v AS (SELECT q, sum(p) AS s, count(*) AS n FROM x GROUP BY q), c AS (SELECT q, sum(s) OVER (ORDER BY q) AS ls, sum(n) OVER (ORDER BY q) AS ln, sum(s) OVER () AS ts, sum(n) OVER () AS tn FROM v), b AS (SELECT q, ls / ln AS lo, (ts - ls) / (tn - ln) AS hi, ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) AS g FROM c WHERE ln < tn ORDER BY g DESC, q LIMIT 1) "


@model("decision_stump", _STUMP + "SELECT q AS cut, round(lo, 6) AS low, round(hi, 6) AS high FROM b")
def decision_stump(spark, sf_dir):
    t = trees.DecisionTreeRegressor(max_depth=1, n_bins=256).fit(lines(spark, sf_dir), ["q"], "p").trees_[0]
    return frame(spark, [(t["cut"][0], round(t["value"][t["left"][0]][0], 6), round(t["value"][t["right"][0]][0], 6))], "cut double, low double, high double")


@model("tree_importances")
def tree_importances(spark, sf_dir):
    m = trees.RandomForestRegressor(n_estimators=5, max_depth=4).fit(lines(spark, sf_dir), XQ, "p")
    return frame(spark, [(c, round(float(v), 6)) for c, v in zip(XQ, m.feature_importances_)], "feature string, importance double")


@model("forest_inference")
def forest_inference(spark, sf_dir):
    """The leaf of every tree for every line."""
    x = lines(spark, sf_dir)
    m = trees.ExtraTreesRegressor(n_estimators=4, max_depth=4).fit(x, XQ, "p")
    return x.select("id", F.posexplode(m.apply_column(XQ)).alias("tree", "leaf"))


@model("tree_explainer")
def tree_explainer(spark, sf_dir):
    x = customers(spark, sf_dir)
    m = trees.GradientBoostingRegressor(n_estimators=2, max_depth=3).fit(x, ["a", "b", "g"], "y")
    return wide(x.withColumn("s", trees.TreeExplainer(m).values_column(["a", "b", "g"])), "id", column="s")


def _linear_model(spark, sf_dir):
    x = customers(spark, sf_dir)
    m = linear.LinearRegression().fit(x, ["a", "b", "g"], "y")
    back = np.array([[r["a"], r["b"], float(r["g"])] for r in x.orderBy("id").limit(50).collect()])
    return x, m, back


#: Shapley values of a linear model have a closed form: weight times distance from the background's mean.
_SHAP = "WITH x AS (SELECT c_custkey AS id, c_acctbal / 1000 AS a, c_custkey % 17 / 4.0 AS b, c_nationkey % 3 AS g FROM customer), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(g) AS mg FROM (SELECT * FROM x ORDER BY id LIMIT 50)), y AS (SELECT c_custkey AS yid, c_acctbal / 500 + c_custkey % 17 + c_nationkey % 5 AS y FROM customer), z AS (SELECT x.*, y FROM x JOIN y ON id = yid)"


@model("kernel_explainer")
def kernel_explainer(spark, sf_dir):
    x, m, back = _linear_model(spark, sf_dir)
    w, b = np.asarray(m.coef_), m.intercept_
    return wide(x.withColumn("s", trees.KernelExplainer(lambda z: z @ w + b, back).values_column(["a", "b", "g"])), "id", column="s")


@model("permutation_explainer")
def permutation_explainer(spark, sf_dir):
    x, m, back = _linear_model(spark, sf_dir)
    w, b = np.asarray(m.coef_), m.intercept_
    return wide(x.withColumn("s", trees.PermutationExplainer(lambda z: z @ w + b, back, 2).values_column(["a", "b", "g"])), "id", column="s")


@model("ctr_features", "SELECT o_orderkey, cnt AS rows_of_category FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS cnt FROM orders)")
def ctr_features(spark, sf_dir):
    """Ordered statistics of the price by priority; the SQL sees how many rows each category's order has."""
    x = trees.ordered_statistics(orders(spark, sf_dir).withColumn("v", F.lit(1.0)), "o_orderpriority", "v", "o_orderkey", prior=1.0, weight=1.0)
    top = x.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("rows_of_category"))
    return x.join(F.broadcast(top), "o_orderpriority").where("ctr = 1").select("o_orderkey", "rows_of_category")


@model("border_types")
def border_types(spark, sf_dir):
    x = lines(spark, sf_dir)
    return frame(spark, [(k, i, float(b)) for k in trees.BORDER_TYPES for i, b in enumerate(trees.borders(x, "q", 7, k))], "kind string, i int, border double")


# --- preprocessing that needs more than a statement ------------------------------------------------------------------------------


@model("power_transformer")
def power_transformer(spark, sf_dir):
    x = customers(spark, sf_dir).select("id", "a")
    return rounded(preprocess.PowerTransformer().fit_transform(x, ["a"]), 4, "a")


@model("quantile_transformer", "WITH r AS (SELECT c_custkey AS id, c_acctbal / 1000 AS a, percent_rank() OVER (ORDER BY c_acctbal) AS lo, 1 - percent_rank() OVER (ORDER BY c_acctbal DESC) AS hi, min(c_acctbal) OVER () AS mn, max(c_acctbal) OVER () AS mx, c_acctbal AS x FROM customer) SELECT id, round(CASE WHEN x = mn THEN 0 WHEN x = mx THEN 1 ELSE (lo + hi) / 2 END, 5) AS a FROM r")
def quantile_transformer(spark, sf_dir):
    """As many quantiles as rows: the transformed value is the mean rank."""
    x = customers(spark, sf_dir).select("id", "a")
    return rounded(preprocess.QuantileTransformer(n_quantiles=x.count()).fit_transform(x, ["a"]), 5, "a")


@model("multi_label_binarizer", "SELECT user_id, k AS label, CASE WHEN list_contains(l, k) THEN 1 ELSE 0 END AS hit FROM (SELECT user_id, list(DISTINCT event_type) AS l FROM events GROUP BY user_id), (SELECT DISTINCT event_type AS k FROM events)")
def multi_label_binarizer(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("l"))
    m = preprocess.MultiLabelBinarizer().fit(x, "l")
    names = F.array(*[F.lit(c) for c in m.classes_])
    return m.transform(x).select("user_id", F.posexplode("indicators").alias("k", "hit")).select("user_id", F.element_at(names, F.col("k") + 1).alias("label"), "hit")


def _holes(spark, sf_dir):
    x = customers(spark, sf_dir)
    return x.select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("a")).alias("a"), F.when(F.col("id") % 11 == 0, None).otherwise(F.col("b")).alias("b"), "y")


@model("iterative_imputer")
def iterative_imputer(spark, sf_dir):
    x = _holes(spark, sf_dir)
    return rounded(preprocess.IterativeImputer(max_iter=2).fit(x, ["a", "b", "y"]).transform(x).select("id", "a", "b"), 4, "a", "b")


@model("knn_imputer")
def knn_imputer(spark, sf_dir):
    x = _holes(spark, sf_dir)
    return wide(preprocess.KNNImputer().fit(x, ["a", "b", "y"]).transform(x), "id", column="imputed", digits=5)


@model("kbins_kmeans")
def kbins_kmeans(spark, sf_dir):
    return preprocess.KBinsDiscretizer(strategy="kmeans").fit_transform(customers(spark, sf_dir).select("id", "a"), ["a"])


@model("target_encoder_crossfit")
def target_encoder_crossfit(spark, sf_dir):
    x = customers(spark, sf_dir)
    return preprocess.TargetEncoder().fit_transform(x, ["m"], "y", "id").select("id", F.round("m_target", 5).alias("m_target"))


@model("recursive_elimination")
def recursive_elimination(spark, sf_dir):
    """The last feature left by standardised weights."""
    x = preprocess.StandardScaler().fit_transform(lines(spark, sf_dir), XQ)
    return frame(spark, [(c,) for c in preprocess.RFE(estimator=linear.LinearRegression()).fit(x, XQ, "p").kept_], "kept string")


@model("spline_transformer")
def spline_transformer(spark, sf_dir):
    x = customers(spark, sf_dir)
    return wide(preprocess.SplineTransformer().fit(x, ["a"]).transform(x), "id", column="splines")


@model("mutual_info_continuous")
def mutual_info_continuous(spark, sf_dir):
    v = preprocess.mutual_info_classif(customers(spark, sf_dir), ["a", "b"], "g", discrete=False)
    return frame(spark, [(c, round(x, 5)) for c, x in zip("ab", v)], "feature string, mi double")


# --- neighbours and graphs ---------------------------------------------------------------------------------------------------------


@model("random_ball_cover", catalog.ORACLE_SQL["nearest_neighbors"])
def random_ball_cover(spark, sf_dir):
    m = neighbors.RandomBallCover(n_neighbors=10).fit(vectors_of(spark, sf_dir), "e", "vec_id")
    return m.kneighbors(asked(spark, sf_dir), "vec_id").select(F.col("query").alias("q"), F.col("id").alias("vec_id"), (F.col("rank") + 1).cast("long").alias("k"))


_SQ = "list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_LOF = f"WITH v AS (SELECT * FROM {_DUCK}), d AS (SELECT a.vec_id AS q, b.vec_id AS id, round(sqrt({_SQ}), 12) AS d FROM v a, v b WHERE a.vec_id <> b.vec_id), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS k FROM d) WHERE k <= 20), kd AS (SELECT q AS o, max(d) AS kd FROM n GROUP BY q), l AS (SELECT q, 1 / (avg(greatest(d, kd)) + 1e-10) AS l FROM n JOIN kd ON id = o GROUP BY q) SELECT n.q AS vec_id, round(avg(b.l) / any_value(a.l), 6) AS factor FROM n JOIN l b ON n.id = b.q JOIN l a ON n.q = a.q GROUP BY n.q"


@model("local_outlier_factor", _LOF)
def local_outlier_factor(spark, sf_dir):
    return neighbors.LocalOutlierFactor().fit_predict(vectors_of(spark, sf_dir), "e", "vec_id").select(F.col("id").alias("vec_id"), F.round("factor", 6).alias("factor"))


for _name, _make in {
    "ivf_index": lambda: neighbors.IVFIndex(n_lists=8, n_probes=8),
    "distributed_ivf_index": lambda: neighbors.DistributedIVFIndex(n_lists=8, n_probes=8),
}.items():

    @model(_name, "SELECT q AS query, vec_id AS id, (k - 1)::INTEGER AS rank FROM (" + catalog.ORACLE_SQL["nearest_neighbors"] + ")")
    def searched(spark, sf_dir, make=_make):
        """All lists probed: the answer is the exact one, by way of the index."""
        m = make().fit(vectors_of(spark, sf_dir), "e", "vec_id")
        return m.search(asked(spark, sf_dir), "vec_id").select("query", "id", "rank")


for _name, _make in {
    "ivf_pq_index": lambda: neighbors.IVFPQIndex(n_lists=8, n_probes=4, n_neighbors=40, pq_bits=4),
    "ivf_sq_index": lambda: neighbors.IVFSQIndex(n_lists=8, n_probes=4, n_neighbors=20),
    "ivf_rabitq_index": lambda: neighbors.IVFRaBitQIndex(n_lists=8, n_probes=4, n_neighbors=40),
}.items():

    @model(_name)
    def compressed(spark, sf_dir, make=_make):
        """Candidates from the codes, put in order by exact distances."""
        x = vectors_of(spark, sf_dir)
        found = make().fit(x, "e", "vec_id").search(asked(spark, sf_dir), "vec_id")
        return rounded(neighbors.refine(found.select("query", "id"), asked(spark, sf_dir), x, "e", "vec_id", 10, "sqeuclidean"), 6, "distance")


@model("refine", f"SELECT query, id, (row_number() OVER (PARTITION BY query ORDER BY d, id) - 1)::INTEGER AS rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, round({_SQ}, 12) AS d FROM {_DUCK} a JOIN {_DUCK} b ON a.vec_id % 100 = 0 AND b.vec_id % 50 = 1) QUALIFY rank < 3")
def refine(spark, sf_dir):
    x = vectors_of(spark, sf_dir)
    cand = asked(spark, sf_dir).select(F.col("vec_id").alias("query")).crossJoin(F.broadcast(x.where("vec_id % 50 = 1").select(F.col("vec_id").alias("id"))))
    return neighbors.refine(cand, asked(spark, sf_dir), x, "e", "vec_id", 3, "sqeuclidean").select("query", "id", "rank")


@model("cagra_index")
def cagra_index(spark, sf_dir):
    m = neighbors.CagraIndex().fit(vectors_of(spark, sf_dir), "e", "vec_id")
    return rounded(m.search(asked(spark, sf_dir), "vec_id"), 6, "distance")


@model("parallel_queries", f"SELECT vec_id, unnest([0, 1, 2])::INTEGER AS k, unnest(ids) AS id FROM (SELECT q AS vec_id, list(vec_id ORDER BY k) AS ids FROM ({catalog.ORACLE_SQL['nearest_neighbors']}) WHERE k <= 3 GROUP BY q)")
def parallel_queries(spark, sf_dir):
    m = neighbors.ParallelQueries(vectors_of(spark, sf_dir), "e", "vec_id", 3)
    return asked(spark, sf_dir).select("vec_id", F.posexplode(m.ids_column()).alias("k", "id"))


def nations(spark, sf_dir) -> DataFrame:
    """Who buys from whom: customers' and suppliers' nations of every line item, as edges with counts."""
    l, o, c, s = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    x = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))


_EDGES = "SELECT c_nationkey AS src, s_nationkey AS dst, count(*) * 1e0 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"


def _pagerank_sql(steps: int) -> str:
    out = f"WITH e AS ({_EDGES}), f AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) * 1e0 AS n FROM v), r0 AS (SELECT id, 1 / n AS r FROM v, n)"
    for k in range(steps):
        out += f", r{k + 1} AS (SELECT v.id, 0.15 / n + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM e)) / n + 0.85 * coalesce(g, 0) AS r FROM v CROSS JOIN n LEFT JOIN (SELECT dst, sum(r * w) AS g FROM f JOIN r{k} ON src = id GROUP BY dst) ON v.id = dst)"
    return out + f" SELECT id, round(r, 6) AS rank FROM r{steps}"


@model("pagerank", _pagerank_sql(5))
def pagerank(spark, sf_dir):
    return rounded(graph.pagerank(nations(spark, sf_dir), max_iter=5, tol=0.0), 6, "rank")


_NEAR = f"SELECT a.vec_id AS a, b.vec_id AS b FROM {_DUCK} a JOIN {_DUCK} b ON a.vec_id <> b.vec_id AND {_SQ} <= 1.0"


@model("connected_components", f"WITH RECURSIVE p AS ({_NEAR}), r AS (SELECT a AS id, a AS c FROM p UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id) SELECT id, min(c) AS component FROM r GROUP BY id")
def connected_components(spark, sf_dir):
    """Vectors within 1 of each other."""
    m = neighbors.RadiusNeighbors().fit(vectors_of(spark, sf_dir), "e", "vec_id")
    e = m.radius_neighbors(vectors_of(spark, sf_dir), "vec_id", 1.0).where("query <> id")
    return graph.connected_components(e.select(F.col("query").alias("a"), F.col("id").alias("b")))


@model("louvain")
def louvain(spark, sf_dir):
    e = nations(spark, sf_dir).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "w")
    return graph.Louvain(max_levels=1, max_rounds=4).fit_predict(e)


def semi(spark, sf_dir) -> DataFrame:
    return vectors_of(spark, sf_dir).withColumn("known", F.when(F.col("vec_id") % 3 == 0, -1).otherwise(F.col("label")))


@model("label_propagation")
def label_propagation(spark, sf_dir):
    return graph.LabelPropagation(gamma=2.0).fit(semi(spark, sf_dir), "e", "known", "vec_id").labels(spark)


@model("label_spreading")
def label_spreading(spark, sf_dir):
    return graph.LabelSpreading(kernel="knn").fit(semi(spark, sf_dir), "e", "known", "vec_id").labels(spark)


@model("gcn_conv", f"WITH e AS (SELECT src, dst, w FROM ({_EDGES}) UNION ALL SELECT n_nationkey, n_nationkey, 1 FROM nation), g AS (SELECT dst AS id, sum(w) AS d FROM e GROUP BY dst) SELECT e.dst AS id, round(sum(e.w / sqrt(a.d * b.d) * (e.src + 1e0)), 6) AS v FROM e JOIN g a ON e.src = a.id JOIN g b ON e.dst = b.id GROUP BY e.dst")
def gcn_conv(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.col("n_nationkey") + 1.0).alias("x"))
    return neural.gcn_conv(n, nations(spark, sf_dir)).select("id", F.round(F.col("x")[0], 6).alias("v"))


@model("sage_conv", f"SELECT n_nationkey AS id, n_nationkey + 1e0 AS own, round(coalesce(m, 0), 6) AS near FROM nation LEFT JOIN (SELECT dst, avg(src + 1e0) AS m FROM ({_EDGES}) GROUP BY dst) ON n_nationkey = dst")
def sage_conv(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.col("n_nationkey") + 1.0).alias("x"))
    return neural.sage_conv(n, nations(spark, sf_dir)).select("id", F.col("x")[0].alias("own"), F.round(F.col("x")[1], 6).alias("near"))


# --- clusters -----------------------------------------------------------------------------------------------------------------------


def _kmeans_sql(steps: int) -> str:
    out = "WITH x AS (SELECT c_custkey AS id, c_acctbal / 1000 AS a, c_custkey % 17 / 4.0 AS b FROM customer), c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, a, b FROM x ORDER BY id LIMIT 4)"
    near = "(SELECT id, x.a, x.b, k, row_number() OVER (PARTITION BY id ORDER BY round((x.a - c.a) ** 2 + (x.b - c.b) ** 2, 9), k) AS r, (x.a - c.a) ** 2 + (x.b - c.b) ** 2 AS d FROM x, c{0} c)"
    for k in range(steps):
        out += f", c{k + 1} AS (SELECT k, avg(a) AS a, avg(b) AS b FROM {near.format(k)} WHERE r = 1 GROUP BY k)"
    return out + f" SELECT id, k::INTEGER AS prediction FROM {near.format(steps)} WHERE r = 1"


@model("kmeans", _kmeans_sql(4))
def kmeans(spark, sf_dir):
    """Lloyd's steps from the customers of the four lowest keys, then a fresh assignment."""
    x = customers(spark, sf_dir)
    init = [[r["a"], r["b"]] for r in x.orderBy("id").limit(4).collect()]
    return cluster.KMeans(n_clusters=4, init=init, max_iter=4, tol=0.0).fit(x, ["a", "b"]).predict(x).select("id", "prediction")


for _name, _make in {
    "kmeans_parallel": lambda: cluster.KMeans(n_clusters=5, max_iter=6, rounds=2),
    "minibatch_kmeans": lambda: cluster.MiniBatchKMeans(n_clusters=5, batches=3, max_iter=1),
    "bisecting_kmeans": lambda: cluster.BisectingKMeans(n_clusters=3, max_iter=6),
    "gaussian_mixture": lambda: cluster.GaussianMixture(n_components=3, max_iter=4),
    "bayesian_gaussian_mixture": lambda: cluster.BayesianGaussianMixture(n_components=4, max_iter=4),
    "mean_shift": lambda: cluster.MeanShift(bandwidth=2.0, bin_seeding=True, max_iter=6),
    "isolation_forest": lambda: cluster.IsolationForest(n_estimators=20, max_samples=64, contamination=0.05),
    "elliptic_envelope": lambda: decompose.EllipticEnvelope(starts=1, max_iter=3),
    "one_class_svm": lambda: kernel.OneClassSVM(nu=0.1),
}.items():

    @model(_name)
    def clustered(spark, sf_dir, make=_make):
        x = customers(spark, sf_dir)
        return make().fit(x, ["a", "b"]).predict(x).select("id", "prediction")


_DB = f"WITH RECURSIVE v AS (SELECT vec_id AS id, e FROM {_DUCK}), p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON {_SQ} <= 1.21), k AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 4), q AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)), r AS (SELECT id, id AS c FROM k UNION SELECT q.b, r.c FROM r JOIN q ON q.a = r.id), m AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS label FROM (SELECT DISTINCT c FROM m)) SELECT v.id AS id, CASE WHEN k.id IS NULL THEN 0 ELSE 1 END AS core, coalesce(x.label, y.label, -1)::BIGINT AS label FROM v LEFT JOIN k ON v.id = k.id LEFT JOIN (SELECT id, label FROM m JOIN n USING (c)) x ON v.id = x.id LEFT JOIN (SELECT p.a AS id, min(label) AS label FROM p JOIN m ON p.b = m.id JOIN n USING (c) GROUP BY p.a) y ON v.id = y.id"


@model("dbscan", _DB)
def dbscan(spark, sf_dir):
    return cluster.DBSCAN(eps=1.1, min_samples=4).fit_predict(vectors_of(spark, sf_dir), "e", "vec_id")


for _name, _make in {
    "hdbscan": lambda: cluster.HDBSCAN(min_cluster_size=8),
    "optics": lambda: cluster.OPTICS(min_samples=5),
    "affinity_propagation": lambda: cluster.AffinityPropagation(damping=0.7, max_iter=100),
    "agglomerative_clustering": lambda: cluster.AgglomerativeClustering(n_clusters=10),
    "spectral_clustering": lambda: cluster.SpectralClustering(n_clusters=5, affinity="nearest_neighbors"),
}.items():

    @model(_name)
    def grouped(spark, sf_dir, make=_make):
        return make().fit_predict(vectors_of(spark, sf_dir), "e", "vec_id")


# --- decompositions -----------------------------------------------------------------------------------------------------------------

for _name, _make in {
    "pca": lambda: decompose.PCA(n_components=3),
    "incremental_pca": lambda: decompose.IncrementalPCA(n_components=3),
    "truncated_svd": lambda: decompose.TruncatedSVD(n_components=3),
    "kernel_pca": lambda: kernel.KernelPCA(n_components=2, kernel="rbf"),
    "fast_ica": lambda: decompose.FastICA(n_components=3, max_iter=8),
    "factor_analysis": lambda: decompose.FactorAnalysis(n_components=2, rotation="varimax"),
    "dictionary_learning": lambda: decompose.DictionaryLearning(n_components=4, alpha=0.2, max_iter=3),
    "minibatch_dictionary_learning": lambda: decompose.MiniBatchDictionaryLearning(n_components=4, alpha=0.2, max_iter=3, batches=3),
    "sparse_pca": lambda: decompose.SparsePCA(n_components=2, max_iter=20),
    "minibatch_sparse_pca": lambda: decompose.MiniBatchSparsePCA(n_components=2, max_iter=20),
    "gaussian_random_projection": lambda: decompose.GaussianRandomProjection(n_components=8),
    "sparse_random_projection": lambda: decompose.SparseRandomProjection(n_components=8),
    "nystroem": lambda: kernel.Nystroem(n_components=20),
    "rbf_sampler": lambda: kernel.RBFSampler(n_components=16),
    "polynomial_count_sketch": lambda: kernel.PolynomialCountSketch(n_components=16),
}.items():

    @model(_name)
    def transformed(spark, sf_dir, make=_make):
        x = vectors_of(spark, sf_dir)
        return wide(make().fit_transform(x, "e"), "vec_id", column="transformed", digits=4)


def positive(spark, sf_dir):
    return vectors_of(spark, sf_dir).withColumn("e", F.transform("e", F.abs))


for _name, _make in {
    "nmf": lambda: decompose.NMF(n_components=3, max_iter=5),
    "latent_dirichlet_allocation": lambda: decompose.LatentDirichletAllocation(n_components=3, max_iter=3),
    "skewed_chi2_sampler": lambda: kernel.SkewedChi2Sampler(n_components=16),
    "additive_chi2_sampler": lambda: kernel.AdditiveChi2Sampler(),
}.items():

    @model(_name)
    def factored(spark, sf_dir, make=_make):
        x = positive(spark, sf_dir)
        return wide(make().fit(x, "e").transform(x), "vec_id", column="transformed", digits=4)


@model("sparse_coder")
def sparse_coder(spark, sf_dir):
    x = vectors_of(spark, sf_dir)
    atoms = np.linalg.qr(np.random.default_rng(0).normal(size=(64, 8)))[0].T
    return wide(decompose.SparseCoder(dictionary=atoms.tolist(), transform_alpha=0.05).fit(x, "e").transform(x), "vec_id", column="transformed")


@model("alternating_least_squares")
def alternating_least_squares(spark, sf_dir):
    """How often each nation's customers buy from each nation's suppliers."""
    e = nations(spark, sf_dir)
    return rounded(decompose.AlternatingLeastSquares(rank=3, max_iter=5).fit(e, "src", "dst", "w").predict(e.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))), 3, "prediction")


@model("johnson_lindenstrauss_min_dim", "SELECT n, floor(4 * ln(n) / (eps ** 2 / 2 - eps ** 3 / 3))::BIGINT AS dims FROM (SELECT unnest([100, 10000, 1000000]) AS n), (SELECT 0.2::DOUBLE AS eps)")
def johnson_lindenstrauss_min_dim(spark, sf_dir):
    return frame(spark, [(n, decompose.johnson_lindenstrauss_min_dim(n, 0.2)) for n in (100, 10_000, 1_000_000)], "n int, dims long")


@model("cca")
def cca(spark, sf_dir):
    m = decompose.CCA(n_components=2).fit(lines(spark, sf_dir), XQ, ["p", "n"])
    return frame(spark, [(k, round(float(v), 6)) for k, v in enumerate(m.correlations_)], "k int, correlation double")


@model("pls_regression")
def pls_regression(spark, sf_dir):
    x = lines(spark, sf_dir)
    m = decompose.PLSRegression(n_components=2).fit(x, XQ, ["p", "n"])
    return wide(x.withColumn("v", m.predict_columns(XQ)), "id", column="v", digits=5)


@model("pls_canonical")
def pls_canonical(spark, sf_dir):
    x = lines(spark, sf_dir)
    return wide(decompose.PLSCanonical(n_components=2).fit(x, XQ, ["p", "n"]).transform(x), "id", column="transformed", digits=5)


@model("min_cov_det")
def min_cov_det(spark, sf_dir):
    m = decompose.MinCovDet(starts=1, max_iter=4).fit(customers(spark, sf_dir), ["a", "b"])
    return frame(spark, [(i, j, round(float(m.covariance_[i, j]), 5)) for i in range(2) for j in range(2)], "i int, j int, v double")


for _name, _make in {
    "classical_mds": lambda: decompose.ClassicalMDS(),
    "mds": lambda: decompose.MDS(max_iter=30),
    "isomap": lambda: decompose.Isomap(),
    "locally_linear_embedding": lambda: decompose.LocallyLinearEmbedding(),
    "spectral_embedding": lambda: decompose.SpectralEmbedding(),
    "tsne": lambda: decompose.TSNE(max_iter=60),
    "umap": lambda: decompose.UMAP(n_epochs=30),
}.items():

    @model(_name)
    def embedded(spark, sf_dir, make=_make):
        return wide(make().fit_transform(vectors_of(spark, sf_dir), "e", "vec_id"), "id", column="embedding", digits=3)


def corner(spark, sf_dir):
    """Four columns of the embeddings, on which SQL forms stay short."""
    return vectors_of(spark, sf_dir).select("vec_id", F.slice("e", 1, 4).alias("x"), F.col("label").cast("double").alias("y"))


@model("linalg_qr", f"WITH x AS (SELECT e FROM {_DUCK}), g AS (SELECT sum(e[1] * e[1]) AS a, sum(e[1] * e[2]) AS b, sum(e[2] * e[2]) AS c FROM x) SELECT 0 AS i, 0 AS j, round(sqrt(a), 5) AS v FROM g UNION ALL SELECT 0, 1, round(b / sqrt(a), 5) FROM g UNION ALL SELECT 1, 1, round(sqrt(c - b * b / a), 5) FROM g")
def linalg_qr(spark, sf_dir):
    r = decompose.qr_r(corner(spark, sf_dir).select(F.slice("x", 1, 2).alias("x")), "x")
    return frame(spark, [(i, j, round(float(r[i, j]), 5)) for i in range(2) for j in range(i, 2)], "i int, j int, v double")


@model("linalg_svdvals", f"WITH g AS (SELECT sum(e[1] * e[1]) AS a, sum(e[1] * e[2]) AS b, sum(e[2] * e[2]) AS c FROM {_DUCK}) SELECT 0 AS k, round(sqrt((a + c + sqrt((a - c) ** 2 + 4 * b * b)) / 2), 5) AS s FROM g UNION ALL SELECT 1, round(sqrt((a + c - sqrt((a - c) ** 2 + 4 * b * b)) / 2), 5) FROM g")
def linalg_svdvals(spark, sf_dir):
    s = decompose.svdvals(corner(spark, sf_dir).select(F.slice("x", 1, 2).alias("x")), "x")
    return frame(spark, [(k, round(float(v), 5)) for k, v in enumerate(s)], "k int, s double")


@model("linalg_svd")
def linalg_svd(spark, sf_dir):
    u, _, _ = decompose.svd(corner(spark, sf_dir), "x")
    return wide(corner(spark, sf_dir).withColumn("u", u), "vec_id", column="u")


@model("linalg_eigh")
def linalg_eigh(spark, sf_dir):
    e, v = decompose.eigh(decompose.gram(corner(spark, sf_dir), "x"))
    return frame(spark, [(k, round(float(e[k]), 5), [round(float(x), 5) for x in v[:, k]]) for k in range(len(e))], "k int, value double, direction array<double>")


@model("linalg_lstsq", f"SELECT round((sxy * sbb - sby * sxb) / (sxx * sbb - sxb * sxb), 5) AS w0, round((sby * sxx - sxy * sxb) / (sxx * sbb - sxb * sxb), 5) AS w1 FROM (SELECT sum(e[1] * e[1]) AS sxx, sum(e[1] * e[2]) AS sxb, sum(e[2] * e[2]) AS sbb, sum(e[1] * label) AS sxy, sum(e[2] * label) AS sby FROM {_DUCK})")
def linalg_lstsq(spark, sf_dir):
    w = decompose.lstsq(corner(spark, sf_dir).select(F.slice("x", 1, 2).alias("x"), "y"), "x", "y")
    return row(spark, 5, w0=w[0], w1=w[1])


@model("linalg_lu")
def linalg_lu(spark, sf_dir):
    p, low, up = decompose.lu(decompose.gram(corner(spark, sf_dir), "x"))
    return frame(spark, [(i, j, round(float((p.T @ low @ up)[i, j]), 4)) for i in range(4) for j in range(4)], "i int, j int, v double")


catalog.ORACLE_SQL["linalg_lu"] = twin(f"SELECT i::INTEGER AS i, j::INTEGER AS j, round(sum(e[i + 1] * e[j + 1]), 4) AS v FROM {_DUCK}, (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j) GROUP BY i, j")


@model("linalg_randomized_svd")
def linalg_randomized_svd(spark, sf_dir):
    s, _ = decompose.randomized_svd(vectors_of(spark, sf_dir), "e", 5)
    return frame(spark, [(k, round(float(v), 4)) for k, v in enumerate(s)], "k int, s double")


@model("linalg_matmul", f"WITH x AS (SELECT vec_id AS i, unnest(range(0, 64)) AS k, unnest(e) AS v FROM {_DUCK}) SELECT i, j, round(sum(v * ((k * 7 + j * 3) % 5)), 5) AS v FROM x, (SELECT unnest(range(0, 3)) AS j) GROUP BY i, j")
def linalg_matmul(spark, sf_dir):
    a = vectors_of(spark, sf_dir).select(F.col("vec_id").alias("i"), F.posexplode("e").alias("k", "v"))
    b = spark.range(64).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).select("k", F.col("j").cast("long").alias("j"), ((F.col("k") * 7 + F.col("j") * 3) % 5).cast("double").alias("v"))
    return rounded(decompose.matmul(a, b), 5, "v")


@model("dequantize_int8", f"SELECT vec_id, unnest(range(0, 64))::INTEGER AS i, round(unnest(o), 6) + 0e0 AS v FROM (SELECT vec_id, list_transform(e, lambda x: round_even(x / (m / 127), 0) * (m / 127)) AS o FROM (SELECT *, list_max(list_transform(e, lambda y: abs(y))) AS m FROM {_DUCK}))")
def dequantize_int8(spark, sf_dir):
    x = decompose.dequantize_int8(decompose.quantize_int8(vectors_of(spark, sf_dir), "e"))
    return x.select("vec_id", F.posexplode("restored").alias("i", "v")).select("vec_id", "i", (F.round("v", 6) + 0.0).alias("v"))


# --- kernels --------------------------------------------------------------------------------------------------------------------------


def _few(spark, sf_dir):
    """Suppliers: a table on which kernel methods, whose model is the rows, stay small at every scale tried here."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("a"), (F.col("s_nationkey") / 5.0).alias("b"), (F.col("s_nationkey") % 2).alias("g"), (F.col("s_acctbal") / 1000 + F.sin(F.col("s_nationkey").cast("double"))).alias("y"))


for _name, (_make, _label) in {
    "svc": (lambda: kernel.SVC(), "g"),
    "svr": (lambda: kernel.SVR(), "y"),
    "kernel_ridge": (lambda: kernel.KernelRidge(kernel="rbf"), "y"),
    "gaussian_process_regressor": (lambda: kernel.GaussianProcessRegressor(normalize_y=True, optimize=False), "y"),
    "gaussian_process_classifier": (lambda: kernel.GaussianProcessClassifier(optimize=False), "g"),
    "svgp": (lambda: kernel.SVGP(n_inducing=16), "y"),
}.items():

    @model(_name)
    def kernelled(spark, sf_dir, make=_make, label=_label):
        x = _few(spark, sf_dir)
        return make().fit(x, ["a", "b"], label).predict(x).select("id", F.round(F.col("prediction").cast("double"), 4).alias("prediction"))


@model("cholesky")
def cholesky(spark, sf_dir):
    c = kernel.Cholesky(decompose.gram(corner(spark, sf_dir), "x"))
    return row(spark, 5, logdet=c.logdet(), trace=float(np.trace(c.factor @ c.factor.T)))


# --- more metrics ------------------------------------------------------------------------------------------------------------------------


@model("silhouette_score", f"WITH v AS (SELECT * FROM {_DUCK}), d AS (SELECT a.vec_id AS id, a.label AS own, b.label AS l, sum(sqrt({_SQ})) AS s, count(*) AS n FROM v a, v b GROUP BY 1, 2, 3), i AS (SELECT id, s / nullif(n - 1, 0) AS a FROM d WHERE l = own), o AS (SELECT id, min(s / n) AS b FROM d WHERE l <> own GROUP BY id) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS v FROM i JOIN o USING (id)")
def silhouette_score(spark, sf_dir):
    return row(spark, v=metrics.silhouette_score(vectors_of(spark, sf_dir), "e", "label", "vec_id"))


@model("davies_bouldin_score", f"WITH x AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(e) AS v FROM {_DUCK}), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i), s AS (SELECT label, avg(d) AS s FROM (SELECT vec_id, x.label, sqrt(sum((v - m) ** 2)) AS d FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY 1, 2) GROUP BY label), d AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) ** 2)) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2) SELECT round(avg(r), 6) AS v FROM (SELECT a, max((x.s + y.s) / d) AS r FROM d JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY a)")
def davies_bouldin_score(spark, sf_dir):
    return row(spark, v=metrics.davies_bouldin_score(vectors_of(spark, sf_dir), "e", "label"))


@model("adjusted_mutual_info_score")
def adjusted_mutual_info_score(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 3).alias("a"), (F.col("c_custkey") % 6).alias("b"))
    return row(spark, v=metrics.adjusted_mutual_info_score(x, "a", "b"))


@model("trustworthiness")
def trustworthiness(spark, sf_dir):
    x = vectors_of(spark, sf_dir).withColumn("s", F.slice("e", 1, 8))
    return row(spark, v=metrics.trustworthiness(x, "e", "s", "vec_id"))


def marks(spark, sf_dir):
    """Four labels and four scores per customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.array(*[((k * (j + 3) + j) % 5 < 2).cast("int") for j in range(4)]).alias("t"), F.array(*[((k * (2 * j + 7) + 3 * j) % 11).cast("double") for j in range(4)]).alias("s"))


_MARKS = "SELECT c_custkey AS id, j, CASE WHEN (c_custkey * (j + 3) + j) % 5 < 2 THEN 1 ELSE 0 END AS t, (c_custkey * (2 * j + 7) + 3 * j) % 11 AS s FROM customer, (SELECT unnest(range(0, 4)) AS j)"


@model("coverage_error", f"WITH m AS ({_MARKS}) SELECT round(avg(c), 6) AS v FROM (SELECT a.id, coalesce(max(CASE WHEN a.t = 1 THEN n END), 0) AS c FROM (SELECT a.id, a.t, (SELECT count(*) FROM m b WHERE b.id = a.id AND b.s >= a.s) AS n FROM m a) a GROUP BY a.id)")
def coverage_error(spark, sf_dir):
    return row(spark, v=metrics.coverage_error(marks(spark, sf_dir), "t", "s"))


@model("label_ranking_average_precision_score", f"WITH m AS ({_MARKS}), r AS (SELECT id, t, (SELECT count(*) FROM m b WHERE b.id = a.id AND b.s >= a.s) AS n, (SELECT count(*) FROM m b WHERE b.id = a.id AND b.s >= a.s AND b.t = 1) AS h FROM m a) SELECT round(avg(v), 6) AS v FROM (SELECT id, CASE WHEN sum(t) IN (0, 4) THEN 1 ELSE sum(CASE WHEN t = 1 THEN h / n END) / sum(t) END AS v FROM r GROUP BY id)")
def label_ranking_average_precision_score(spark, sf_dir):
    return row(spark, v=metrics.label_ranking_average_precision_score(marks(spark, sf_dir), "t", "s"))


@model("label_ranking_loss", f"WITH m AS ({_MARKS}) SELECT round(avg(v), 6) AS v FROM (SELECT a.id, coalesce(sum(CASE WHEN a.t = 1 AND b.t = 0 AND b.s >= a.s THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN a.t = 1 AND b.t = 0 THEN 1 ELSE 0 END), 0), 0) AS v FROM m a JOIN m b ON a.id = b.id GROUP BY a.id)")
def label_ranking_loss(spark, sf_dir):
    return row(spark, v=metrics.label_ranking_loss(marks(spark, sf_dir), "t", "s"))


@model("auc", "SELECT round(sum(CASE WHEN pa IS NULL THEN 0 ELSE (a - pa) * (b + pb) / 2 END), 4) AS v FROM (SELECT a, b, lag(a) OVER (ORDER BY a, b) AS pa, lag(b) OVER (ORDER BY a, b) AS pb FROM (SELECT c_acctbal / 1000 AS a, c_custkey % 17 / 4.0 AS b FROM customer))")
def auc(spark, sf_dir):
    return row(spark, 4, v=metrics.auc(customers(spark, sf_dir), "a", "b"))


@model("roc_auc_multiclass")
def roc_auc_multiclass(spark, sf_dir):
    x = lines(spark, sf_dir)
    m = linear.GaussianNB().fit(x, XQ, "f")
    y = x.select("f", m.proba_column(XQ).alias("p"))
    return row(spark, ovr=metrics.roc_auc_multiclass(y, "f", "p", m.classes_), ovo=metrics.roc_auc_multiclass(y, "f", "p", m.classes_, "ovo"))


@model("dcg_with_ties")
def dcg_with_ties(spark, sf_dir):
    x = marks(spark, sf_dir)
    return rounded(x.select("id", metrics.dcg_column("t", "s").alias("dcg"), metrics.ndcg_column("t", "s").alias("ndcg")), 6, "dcg", "ndcg")


@model("classification_report_text")
def classification_report_text(spark, sf_dir):
    return frame(spark, [(metrics.classification_report(classes(spark, sf_dir), "y", "p"),)], "report string")


@model("group_sums", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS sum_l_quantity FROM lineitem GROUP BY 1, 2")
def group_sums(spark, sf_dir):
    return rounded(metrics.group_sums(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"]), 4, "sum_l_quantity")


# --- selection and resampling ----------------------------------------------------------------------------------------------------------------


def _parts(splitter):
    def fn(spark, sf_dir):
        """(split, part): how many rows, and how many splits hold a row twice (none)."""
        x = splitter(orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderpriority"))
        return x.groupBy("split", "part").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct("o_orderkey")).alias("twice"))

    return fn


_SHARES = "SELECT s::INTEGER AS split, part, CASE WHEN part = 'test' THEN ceil(n * 0.2) ELSE n - ceil(n * 0.2) END::BIGINT AS n, 0::BIGINT AS twice FROM (SELECT count(*) AS n FROM orders), (SELECT unnest([0, 1, 2]) AS s), (SELECT unnest(['train', 'test']) AS part)"
model("shuffle_split", _SHARES)(_parts(lambda x: selection.ShuffleSplit(3, 0.2).table(x, "o_orderkey")))
model("stratified_shuffle_split", _SHARES)(_parts(lambda x: selection.StratifiedShuffleSplit(3, 0.2).table(x, "o_orderkey", "o_orderpriority")))


@model("group_shuffle_split", "SELECT s::INTEGER AS split, part, CASE WHEN part = 'test' THEN ceil(n * 0.2) ELSE n - ceil(n * 0.2) END::BIGINT AS groups_ FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders), (SELECT unnest([0, 1]) AS s), (SELECT unnest(['train', 'test']) AS part)")
def group_shuffle_split(spark, sf_dir):
    x = orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    return selection.GroupShuffleSplit(2, 0.2).table(x, "o_orderkey", "o_custkey").join(x, "o_orderkey").groupBy("split", "part").agg(F.countDistinct("o_custkey").alias("groups_"))


_FOLDS = "SELECT r::INTEGER AS repeat, f::INTEGER AS fold, (n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT count(*) AS n FROM orders), (SELECT unnest([0, 1]) AS r), (SELECT unnest(range(0, 5)) AS f)"


@model("repeated_kfold", _FOLDS)
def repeated_kfold(spark, sf_dir):
    return selection.RepeatedKFold(5, 2).table(orders(spark, sf_dir), "o_orderkey").groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n"))


@model("repeated_stratified_kfold", _FOLDS)
def repeated_stratified_kfold(spark, sf_dir):
    return selection.RepeatedStratifiedKFold(5, 2).table(orders(spark, sf_dir), "o_orderkey", "o_orderpriority").groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n"))


@model("leave_one_out", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS fold FROM orders")
def leave_one_out(spark, sf_dir):
    return selection.LeaveOneOut().assign(orders(spark, sf_dir).select("o_orderkey"), "o_orderkey")


@model("leave_p_out", "SELECT split, n_nationkey FROM (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, [a, b] AS l FROM (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey)) CROSS JOIN unnest(l) AS u(n_nationkey)")
def leave_p_out(spark, sf_dir):
    return selection.LeavePOut(2).table(table(spark, sf_dir, "nation"), "n_nationkey")


@model("leave_one_group_out", "SELECT row_number() OVER (ORDER BY o_orderpriority) - 1 AS split, o_orderpriority FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def leave_one_group_out(spark, sf_dir):
    return selection.LeaveOneGroupOut().table(orders(spark, sf_dir), "o_orderpriority")


@model("leave_p_groups_out", "SELECT split, g AS o_orderpriority FROM (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, [a, b] AS l FROM (SELECT x.p AS a, y.p AS b FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) x JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) y ON x.p < y.p)) CROSS JOIN unnest(l) AS u(g)")
def leave_p_groups_out(spark, sf_dir):
    return selection.LeavePGroupsOut(2).table(orders(spark, sf_dir), "o_orderpriority")


@model("predefined_split", "SELECT f::INTEGER AS fold, count(*) FILTER (k <> f) AS train, count(*) FILTER (k = f) AS test FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN -1 WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS k FROM orders), (SELECT unnest([0, 1]) AS f) GROUP BY f")
def predefined_split(spark, sf_dir):
    x = orders(spark, sf_dir).select(F.when(F.col("o_orderstatus") == "P", -1).when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("k"))
    return frame(spark, [(f, a.count(), b.count()) for f, (a, b) in enumerate(selection.PredefinedSplit("k").split(x))], "fold int, train long, test long")


_CV = "WITH x AS (SELECT c_acctbal / 1000 AS a, c_acctbal / 500 + c_custkey % 17 + c_nationkey % 5 AS y, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer), z AS (SELECT a, y, CASE WHEN k < (n % 3) * (n // 3 + 1) THEN k // (n // 3 + 1) ELSE n % 3 + (k - (n % 3) * (n // 3 + 1)) // (n // 3) END AS f FROM x), m AS (SELECT g, regr_slope(y, a) AS w, regr_intercept(y, a) AS b FROM z, (SELECT unnest([0, 1, 2]) AS g) WHERE f <> g GROUP BY g)"


@model("cross_val_score", _CV + " SELECT f::INTEGER AS fold, round(1 - sum((y - w * a - b) ** 2) / (var_pop(y) * count(*)), 6) AS score FROM z JOIN m ON f = g GROUP BY f")
def cross_val_score(spark, sf_dir):
    s = selection.cross_val_score(linear.LinearRegression(), customers(spark, sf_dir), ["a"], "y", "id", cv=3)
    return frame(spark, [(k, round(v, 6)) for k, v in enumerate(s)], "fold int, score double")


@model("cross_val_predict", _CV.replace("SELECT c_acctbal", "SELECT c_custkey AS id, c_acctbal", 1).replace("SELECT a, y, CASE", "SELECT id, a, y, CASE", 1) + " SELECT id, round(w * a + b, 6) AS prediction FROM z JOIN m ON f = g")
def cross_val_predict(spark, sf_dir):
    return selection.cross_val_predict(linear.LinearRegression(), customers(spark, sf_dir), ["a"], "y", "id", cv=3).select("id", F.round("prediction", 6).alias("prediction"))


@model("grid_search_cv")
def grid_search_cv(spark, sf_dir):
    g = selection.GridSearchCV(estimator=linear.Ridge(), param_grid={"alpha": [0.1, 100.0]}, cv=2).fit(customers(spark, sf_dir), ["a", "b"], "y", "id")
    return frame(spark, [(float(r["params"]["alpha"]), round(r["mean"], 6), k == g.best_index_) for k, r in enumerate(g.results_)], "alpha double, score double, best boolean")


@model("randomized_search_cv")
def randomized_search_cv(spark, sf_dir):
    g = selection.RandomizedSearchCV(estimator=linear.Ridge(), param_distributions={"alpha": [0.1, 1.0, 10.0, 100.0]}, n_iter=2, cv=2).fit(customers(spark, sf_dir), ["a", "b"], "y", "id")
    return frame(spark, [(float(r["params"]["alpha"]), round(r["mean"], 6)) for r in g.results_], "alpha double, score double")


@model("learning_curve")
def learning_curve(spark, sf_dir):
    return frame(spark, [(r["size"], round(r["train"], 5), round(r["test"], 5)) for r in selection.learning_curve(linear.Ridge(), customers(spark, sf_dir), ["a", "b"], "y", "id", sizes=(0.3, 1.0), cv=2)], "size double, train double, test double")


@model("validation_curve")
def validation_curve(spark, sf_dir):
    return frame(spark, [(float(r["alpha"]), round(r["train"], 5), round(r["test"], 5)) for r in selection.validation_curve(linear.Ridge(), customers(spark, sf_dir), ["a", "b"], "y", "id", "alpha", (0.1, 1000.0), cv=2)], "alpha double, train double, test double")


@model("permutation_test_score")
def permutation_test_score(spark, sf_dir):
    s, _, p = selection.permutation_test_score(linear.Ridge(), customers(spark, sf_dir), ["a", "b"], "y", "id", cv=2, n_permutations=2)
    return row(spark, score=s, p=p)


@model("scorers", "SELECT 'neg_mean_squared_error' AS scorer, round(-avg((y - p) ** 2), 5) AS v FROM (SELECT c_acctbal / 500 + c_custkey % 17 + c_nationkey % 5 AS y, w * c_acctbal / 1000 + b AS p FROM customer, (SELECT regr_slope(c_acctbal / 500 + c_custkey % 17 + c_nationkey % 5, c_acctbal / 1000) AS w, regr_intercept(c_acctbal / 500 + c_custkey % 17 + c_nationkey % 5, c_acctbal / 1000) AS b FROM customer))")
def scorers(spark, sf_dir):
    x = customers(spark, sf_dir)
    m = linear.LinearRegression().fit(x, ["a"], "y")
    return frame(spark, [("neg_mean_squared_error", round(selection.get_scorer("neg_mean_squared_error")(m, x, "y"), 5))], "scorer string, v double")


@model("bootstrap", "SELECT round(avg(c_acctbal / 1000), 6) AS estimate, true AS holds FROM customer")
def bootstrap(spark, sf_dir):
    b = selection.bootstrap(customers(spark, sf_dir), "a", "id", method="bca")
    return frame(spark, [(round(b["estimate"], 6), bool(b["low"] < b["estimate"] < b["high"]))], "estimate double, holds boolean")


@model("permutation_test", "SELECT round(avg(c_acctbal / 1000) FILTER (c_custkey % 2 = 0) - avg(c_acctbal / 1000) FILTER (c_custkey % 2 = 1), 6) AS statistic FROM customer")
def permutation_test(spark, sf_dir):
    t = selection.permutation_test(customers(spark, sf_dir).withColumn("h", F.col("id") % 2), "a", "h", "id", 200)
    return row(spark, statistic=t["statistic"])


@model("monte_carlo_integrate", "SELECT true AS near")
def monte_carlo_integrate(spark, sf_dir):
    """A quarter of the unit disc."""
    v, e = selection.monte_carlo_integrate(spark, lambda x, y: (x * x + y * y <= 1).cast("double"), [(0, 1), (0, 1)], 50_000)
    return frame(spark, [(abs(v - math.pi / 4) < 5 * e,)], "near boolean")


@model("resample", "SELECT count(*) AS n, 0::BIGINT AS twice FROM customer")
def resample(spark, sf_dir):
    x = customers(spark, sf_dir)
    y = selection.resample(x, "id", x.count(), replace=False)
    return y.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct("id")).alias("twice"))


# --- series -------------------------------------------------------------------------------------------------------------------------------------

for _name, _make in {
    "arima": lambda: forecast.ARIMA(order=(1, 0, 1), rounds=4),
    "auto_arima": lambda: forecast.AutoARIMA(max_p=1, max_q=0, rounds=3),
    "exponential_smoothing": lambda: forecast.ExponentialSmoothing(seasonal_periods=7, rounds=4),
    "ets": lambda: forecast.ETS(model="AAN", rounds=4),
    "damped_ets": lambda: forecast.DampedETS(rounds=4),
    "theta": lambda: forecast.Theta(season_length=7),
    "auto_theta": lambda: forecast.AutoTheta(),
    "optimized_theta": lambda: forecast.OptimizedTheta(),
    "dynamic_theta": lambda: forecast.DynamicTheta(),
    "dynamic_optimized_theta": lambda: forecast.DynamicOptimizedTheta(),
    "croston_optimized": lambda: forecast.CrostonOptimized(),
    "garch": lambda: forecast.GARCH(rounds=5),
}.items():

    @model(_name)
    def forecasted(spark, sf_dir, make=_make):
        """Three steps ahead for each user's events in their order."""
        return rounded(make().forecast(events(spark, sf_dir), "user_id", "t", "value", 3), 4, "forecast", "lower", "upper")


_EVS = "(SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
_FOLD = "list_reduce({0}, lambda l, x: l + 0.1e0 * (x - l))"
_SPARSE = f"(SELECT user_id, list(v ORDER BY k) FILTER (v <> 0) AS sizes, list(k ORDER BY k) FILTER (v <> 0) AS places FROM (SELECT user_id, k, CASE WHEN value > 50 THEN value ELSE 0 END AS v FROM {_EVS}) GROUP BY user_id)"


def _croston(factor: float) -> str:
    gaps = "list_transform(list_zip(places, list_concat([0], places)), lambda z: (z[1] - z[2]) * 1e0)"
    return f"SELECT user_id, round(CASE WHEN sizes IS NULL OR len(sizes) = 0 THEN 0 ELSE {factor} * {_FOLD.format('sizes')} / {_FOLD.format(f'{gaps}[1:len(places)]')} END, 5) AS rate FROM {_SPARSE}"


for _name, _cls, _factor in (("croston_classic", forecast.CrostonClassic, 1.0), ("croston_sba", forecast.CrostonSBA, 0.95)):

    @model(_name, _croston(_factor))
    def croston(spark, sf_dir, cls=_cls):
        x = events(spark, sf_dir).withColumn("value", F.when(F.col("value") > 50, F.col("value")).otherwise(0.0))
        return cls().forecast(x, "user_id", "t", "value", 1).select(F.col("series").alias("user_id"), F.round("forecast", 5).alias("rate"))


@model("kpss_test", f"WITH e AS (SELECT user_id, k, value - avg(value) OVER (PARTITION BY user_id) AS e, count(*) OVER (PARTITION BY user_id) AS n FROM {_EVS}), c AS (SELECT user_id, sum(s * s) AS s, any_value(n) AS n FROM (SELECT user_id, n, sum(e) OVER (PARTITION BY user_id ORDER BY k) AS s FROM e) GROUP BY user_id), l AS (SELECT a.user_id, any_value(a.n) AS n, sum(CASE WHEN b.k = a.k THEN a.e * b.e ELSE 2 * a.e * b.e * (1 - (b.k - a.k) / (2 + 1e0)) END) AS v FROM e a JOIN e b ON a.user_id = b.user_id AND b.k - a.k BETWEEN 0 AND 2 GROUP BY a.user_id) SELECT user_id, round(c.s / (c.n * 1e0 * c.n) / (l.v / l.n), 5) AS statistic FROM c JOIN l USING (user_id) WHERE c.n >= 3 AND l.v > 0")
def kpss_test(spark, sf_dir):
    p = forecast.KpssTest(lags=2).test(events(spark, sf_dir), "user_id", "t", "value")
    return p.where("name = 'statistic' and value = value and value <> 0").select(F.col("series").alias("user_id"), F.round("value", 5).alias("statistic"))


@model("stl")
def stl(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("t"), "value")
    d = forecast.STL(period=5).decompose(x, "user_id", "t", "value")
    return rounded(d.select(F.col("t.event_id").alias("event_id"), "seasonal", "trend", "remainder"), 4, "seasonal", "trend", "remainder")


def daily(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice") / 1000).alias("v"), F.count(F.lit(1)).cast("double").alias("n"))


@model("var")
def var(spark, sf_dir):
    f = forecast.VAR().fit(daily(spark, sf_dir), "day", ["v", "n"]).forecast(3)
    return frame(spark, [(k + 1, round(float(a), 3), round(float(b), 3)) for k, (a, b) in enumerate(f)], "step int, v double, n double")


@model("prophet")
def prophet(spark, sf_dir):
    x = daily(spark, sf_dir)
    return forecast.ProphetForecaster(n_changepoints=5, yearly=2, weekly=2).fit(x, "day", "v").predict(x).select("day", F.round("prediction", 3).alias("prediction"))


@model("seasonal_difference_twice", f"SELECT event_id, round(value - 2 * lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) + lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS d FROM events")
def seasonal_difference_twice(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("t"), "value")
    return forecast.difference(x, "user_id", "t", "value", 2, 1, "d").select("event_id", F.round("d", 6).alias("d"))


# --- sorts, scans ------------------------------------------------------------------------------------------------------------------------------------


@model("sort_columns", f"SELECT vec_id, unnest(range(0, 64))::INTEGER AS i, unnest(list_sort(e)) AS v FROM {_DUCK}")
def sort_columns(spark, sf_dir):
    return vectors_of(spark, sf_dir).select("vec_id", F.posexplode(F.array_sort("e")).alias("i", "v"))


@model("order_statistic", f"SELECT vec_id, list_sort(e)[8] AS v FROM {_DUCK}")
def order_statistic(spark, sf_dir):
    return vectors_of(spark, sf_dir).select("vec_id", F.array_sort("e")[7].alias("v"))


@model("compact", f"SELECT vec_id, i::INTEGER AS i, v FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(e) AS v FROM {_DUCK}) WHERE v > 0.2")
def compact(spark, sf_dir):
    return vectors_of(spark, sf_dir).select("vec_id", F.posexplode("e").alias("i", "v")).where("v > 0.2")


@model("segmented_reduce", "SELECT l_orderkey, sum(l_quantity) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_orderkey")
def segmented_reduce(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("s"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@model("make_monotonic", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS label FROM part")
def make_monotonic(spark, sf_dir):
    x = table(spark, sf_dir, "part")
    return preprocess.OrdinalEncoder().fit(x, ["p_brand"]).transform(x).select("p_partkey", F.col("p_brand_code").cast("long").alias("label"))


@model("epoch_order", "SELECT count(*) AS n, count(*) AS places, 0::BIGINT AS low FROM customer")
def epoch_order(spark, sf_dir):
    """A keyed permutation: every place is taken once."""
    from millrace.learn.base import keyed

    x = forecast.numbered(customers(spark, sf_dir).select("id"), [keyed(3, F.col("id")), F.col("id")])
    return x.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("n").alias("places"), F.min("n").alias("low"))


# --- tensors, networks, text ---------------------------------------------------------------------------------------------------------------------------


@model("tensor_erf")
def tensor_erf(spark, sf_dir):
    x = vectors_of(spark, sf_dir).select("vec_id", tensor.column("Erf", "e", width=64).alias("o"))
    return wide(x, "vec_id", column="o", digits=9)


@model("tensor_gelu_erf")
def tensor_gelu_erf(spark, sf_dir):
    x = vectors_of(spark, sf_dir).select("vec_id", tensor.column("Gelu", "e", width=64).alias("o"))
    return wide(x, "vec_id", column="o", digits=9)


@model("layer_norm", catalog.ORACLE_SQL["tensor_layer_normalization"])
def layer_norm(spark, sf_dir):
    x = vectors_of(spark, sf_dir).select("vec_id", neural.layer_norm_column("e").alias("o"))
    return x.select("vec_id", F.posexplode("o").alias("i", "v")).select("vec_id", "i", (F.round("v", 6) + 0.0).alias("v"))


@model("cross_entropy", f"SELECT vec_id, round(m + ln(list_sum(list_transform(e, lambda x: exp(x - m)))) - e[label + 1], 6) AS v FROM (SELECT *, list_max(e) AS m FROM {_DUCK})")
def cross_entropy(spark, sf_dir):
    return vectors_of(spark, sf_dir).select("vec_id", F.round(neural.cross_entropy_column("e", "label"), 6).alias("v"))


@model("embedding_lookup", f"SELECT o_orderkey, e[1] AS v FROM orders LEFT JOIN {_DUCK} ON o_custkey = vec_id")
def embedding_lookup(spark, sf_dir):
    return neural.embedding(orders(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_custkey", vectors_of(spark, sf_dir), "vec_id", "e").select("o_orderkey", F.col("embedded")[0].alias("v"))


@model("embedding_gradient", f"SELECT label AS id, unnest(range(0, 64))::INTEGER AS k, round(unnest(g), 5) + 0e0 AS v FROM (SELECT label, list(s ORDER BY k) AS g FROM (SELECT label, k, sum(v) AS s FROM (SELECT label, unnest(range(0, 64)) AS k, unnest(e) AS v FROM {_DUCK}) GROUP BY label, k) GROUP BY label)")
def embedding_gradient(spark, sf_dir):
    return wide(neural.embedding_gradient(vectors_of(spark, sf_dir), "label", "e"), "id", column="x", digits=5)


def _schedule(name, column, sql):
    @model(f"schedule_{name}", f"SELECT s AS step, round({sql}, 9) AS lr FROM (SELECT unnest(range(1, 101)) AS s)")
    def schedule(spark, sf_dir):
        return spark.range(1, 101).select(F.col("id").alias("step"), F.round(column(F.col("id")), 9).alias("lr"))


_schedule("constant", lambda s: neural.constant_lr(s, 0.1), "0.1e0")
_schedule("warmup_linear", lambda s: neural.warmup_linear_lr(s, 0.1, 10, 100), "CASE WHEN s <= 10 THEN 0.1e0 * s / 10 ELSE 0.1e0 * (100 - s) / 90 END")
_schedule("warmup_cosine", lambda s: neural.warmup_cosine_lr(s, 0.1, 10, 100), "CASE WHEN s <= 10 THEN 0.1e0 * s / 10 ELSE 0.05e0 * (1 + cos(pi() * (s - 10) / 90)) END")
_schedule("step", lambda s: neural.step_lr(s, 0.1, 30), "0.1e0 * power(0.1e0, floor((s - 1) / 30))")
_schedule("exponential", lambda s: neural.exponential_lr(s, 0.1, 0.95), "0.1e0 * power(0.95e0, s - 1)")
_schedule("one_cycle", lambda s: neural.one_cycle_lr(s, 0.1, 100), "CASE WHEN s - 1 <= 29 THEN 0.1e0 + (0.004e0 - 0.1e0) / 2 * (1 + cos(pi() * (s - 1) / 29)) ELSE 4e-7 + (0.1e0 - 4e-7) / 2 * (1 + cos(pi() * (s - 1 - 29) / 70)) END")


@model("optimizers")
def optimizers(spark, sf_dir):
    """Ten steps of each optimizer on a bowl from the same point."""
    out = []
    for name, cls in neural.OPTIMIZERS.items():
        p, o = [np.array([1.0, -2.0])], cls(lr=0.05)
        for _ in range(10):
            o.step(p, [2 * p[0]])
        out.append((name, round(float(p[0][0]), 6), round(float(p[0][1]), 6)))
    return frame(spark, out, "optimizer string, a double, b double")


@model("bpe_encode")
def bpe_encode(spark, sf_dir):
    """Ids of whole benchmark texts under the public vocabulary."""
    import public_tokenizers

    tok = bpe.BpeTokenizer.load(str(public_tokenizers.path("byte_bpe_50k.json")))
    return table(spark, sf_dir, "benchmark").select("item_id", tok.encode_column("text").alias("ids"))


@model("pre_token_counts")
def pre_token_counts(spark, sf_dir):
    return bpe.pre_token_counts(table(spark, sf_dir, "documents"), "text")


@model("combination_hash")
def combination_hash(spark, sf_dir):
    """One key per combination of flag and status."""
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", bpe.combination_hash(["l_returnflag", "l_linestatus"]).alias("key"))
    return x.distinct()
