"""Queries that apply the estimators of millrace.learn where SQL states the same result in its own way.

Each replaces a statement of the sibling modules: what runs is the operator with its parameters, what it is held
against is that statement's SQL, or a corrected one given here.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import catalog
from millrace.functions import tensor
from millrace.learn import decompose, linear, metrics, neighbors, preprocess, selection
from millrace.operators import evaluation, metrics as metric_statements, preprocessing, series, tensors, vectors  # noqa: F401  register first
from millrace.operators import linear as linear_statements  # noqa: F401
from millrace.plans.sqltext import twin


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(name: str, sql: str | None = None):
    """Run this function under the name; its SQL stays, or becomes `sql`."""

    def add(fn):
        catalog.QUERIES[name] = fn
        if sql:
            catalog.ORACLE_SQL[name] = twin(sql)
        elif name not in catalog.ORACLE_SQL:
            raise ValueError(f"{name} has no SQL")
        return fn

    return add


def li(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"))


def frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small result of the driver as a table; NumPy numbers become plain ones."""
    return spark.createDataFrame([tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows], schema)


def one(spark: SparkSession, **values) -> DataFrame:
    """A row of numbers."""
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- preprocessing -------------------------------------------------------------------------------------------------


@over("standard_scaler")
def standard_scaler(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q_scaled"))
    return rounded(preprocess.StandardScaler().fit_transform(x, ["q_scaled"]), 6, "q_scaled")


@over("standard_scaler_inverse")
def standard_scaler_inverse(spark, sf_dir):
    x = li(spark, sf_dir).select("id", "q")
    s = preprocess.StandardScaler().fit(x, ["q"])
    return rounded(s.inverse_transform(s.transform(x)), 6, "q")


@over("minmax_scaler")
def minmax_scaler(spark, sf_dir):
    return rounded(preprocess.MinMaxScaler().fit_transform(li(spark, sf_dir).select("id", "q"), ["q"]), 6, "q")


@over("maxabs_scaler")
def maxabs_scaler(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    return rounded(preprocess.MaxAbsScaler().fit_transform(x, ["x"]), 6, "x")


@over("robust_scaler")
def robust_scaler(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    return rounded(preprocess.RobustScaler().fit_transform(x, ["x"]), 6, "x")


for _norm, _cols in (("l2", ["q", "d"]), ("l1", ["q", "d"]), ("max", ["q"])):

    @over(f"normalizer_{_norm}")
    def normalizer(spark, sf_dir, norm=_norm, cols=tuple(_cols)):
        x = preprocess.Normalizer(norm=norm).transform(li(spark, sf_dir).select("id", "q", "d", "t"), ["q", "d", "t"])
        return rounded(x.select("id", *cols), 6, *cols)


@over("binarizer")
def binarizer(spark, sf_dir):
    return preprocess.Binarizer(threshold=25.0).fit_transform(li(spark, sf_dir).select("id", "q"), ["q"])


@over("onehot_encoder")
def onehot_encoder(spark, sf_dir):
    x = preprocess.OneHotEncoder().fit(li(spark, sf_dir), ["f"]).transform(li(spark, sf_dir))
    return x.select("id", F.col("f_A").alias("f_a"), F.col("f_N").alias("f_n"), F.col("f_R").alias("f_r"))


@over("ordinal_encoder")
def ordinal_encoder(spark, sf_dir):
    x = li(spark, sf_dir)
    return preprocess.OrdinalEncoder().fit(x, ["f"]).transform(x).select("id", F.col("f_code").cast("long").alias("code"))


@over("label_encoder")
def label_encoder(spark, sf_dir):
    x = table(spark, sf_dir, "customer")
    return preprocess.LabelEncoder().fit(x, "c_mktsegment").transform(x).select("c_custkey", F.col("c_mktsegment_code").cast("long").alias("code"))


@over("label_binarizer", "SELECT c_custkey, m AS label, CASE WHEN c_mktsegment = m THEN 1 ELSE 0 END AS hit FROM {customer}, (SELECT DISTINCT c_mktsegment AS m FROM {customer})")
def label_binarizer(spark, sf_dir):
    x = table(spark, sf_dir, "customer")
    b = preprocess.LabelBinarizer().fit(x, "c_mktsegment")
    names = F.array(*[F.lit(c) for c in b.classes_])
    return b.transform(x).select("c_custkey", F.posexplode("indicators").alias("k", "hit")).select("c_custkey", F.element_at(names, F.col("k") + 1).alias("label"), "hit")


@over("target_encoder")
def target_encoder(spark, sf_dir):
    x = li(spark, sf_dir)
    return preprocess.TargetEncoder(smooth=10).fit(x, ["f"], "e").transform(x).select("id", F.round("f_target", 6).alias("f_mean"))


_GAPS = "o_orderkey % 7 = 0"


def gaps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.expr(_GAPS), None).otherwise(F.col("o_totalprice")).alias("x"), F.col("o_orderpriority").alias("c"))


@over("simple_imputer_mean")
def simple_imputer_mean(spark, sf_dir):
    x = gaps(spark, sf_dir)
    out = preprocess.SimpleImputer(add_indicator=True).fit(x, ["x"]).transform(x, "_filled")
    return out.select("id", F.round("x_filled", 4).alias("x"), F.col("x_missing").alias("missing"))


@over("simple_imputer_median")
def simple_imputer_median(spark, sf_dir):
    x = gaps(spark, sf_dir)
    return rounded(preprocess.SimpleImputer(strategy="median").fit(x, ["x"]).transform(x).select("id", "x"), 4, "x")


@over("simple_imputer_constant")
def simple_imputer_constant(spark, sf_dir):
    x = gaps(spark, sf_dir)
    return preprocess.SimpleImputer(strategy="constant", fill_value=0.0).fit(x, ["x"]).transform(x).select("id", "x")


@over("simple_imputer_most_frequent")
def simple_imputer_most_frequent(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.expr(_GAPS), None).otherwise(F.col("o_orderpriority")).alias("p"))
    return preprocess.SimpleImputer(strategy="most_frequent").fit(x, ["p"]).transform(x)


@over("kbins_uniform")
def kbins_uniform(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("bin"))
    return preprocess.KBinsDiscretizer(strategy="uniform").fit_transform(x, ["bin"]).select("c_custkey", F.col("bin").cast("long").alias("bin"))


@over("kbins_quantile")
def kbins_quantile(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("bin"))
    return preprocess.KBinsDiscretizer(n_bins=4).fit_transform(x, ["bin"])


@over("polynomial_features")
def polynomial_features(spark, sf_dir):
    p = preprocess.PolynomialFeatures().fit(None, ["q", "d"]).transform(li(spark, sf_dir))
    v = F.col("polynomial")
    return p.select("id", v[0].alias("one"), "q", "d", F.round(v[3], 4).alias("q2"), F.round(v[4], 4).alias("qd"), F.round(v[5], 4).alias("d2"))


@over("spline_linear_basis")
def spline_linear_basis(spark, sf_dir):
    x = li(spark, sf_dir).select("id", "q")
    v = F.col("splines")
    return preprocess.SplineTransformer(n_knots=3, degree=1).fit(x, ["q"]).transform(x).select("id", *[F.round(v[k], 6).alias(f"b{k}") for k in range(3)])


catalog.ORACLE_SQL["spline_linear_basis"] = "SELECT id, round(greatest(0e0, 1 - abs(q - lo) / w), 6) AS b0, round(greatest(0e0, 1 - abs(q - lo - w) / w), 6) AS b1, round(greatest(0e0, 1 - abs(q - lo - 2 * w) / w), 6) AS b2 FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS q FROM lineitem), (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 2 AS w FROM lineitem)"


@over("variance_threshold")
def variance_threshold(spark, sf_dir):
    v = preprocess.VarianceThreshold(threshold=0.01).fit(li(spark, sf_dir), ["d", "q", "t"])
    return frame(spark, [(c, round(x, 6), int(c in v.kept_)) for c, x in zip(v.columns_, v.variances_)], "k string, v double, kept int")


_X = ["l_quantity", "l_discount", "l_tax"]


@over("r_regression")
def r_regression(spark, sf_dir):
    r = preprocess.r_regression(table(spark, sf_dir, "lineitem"), _X, "l_extendedprice")
    return rounded(one(spark, q=r[0], d=r[1], t=r[2]), 6, "q", "d", "t")


@over("f_regression")
def f_regression(spark, sf_dir):
    return rounded(one(spark, f=preprocess.f_regression(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")[0][0]), 2, "f")


@over("f_classif")
def f_classif(spark, sf_dir):
    f = preprocess.f_classif(table(spark, sf_dir, "lineitem"), _X[:2], "l_returnflag")
    return rounded(frame(spark, [(n, v[0]) for n, v in zip(_X, f)], "name string, f double"), 4, "f")


@over("select_k_best")
def select_k_best(spark, sf_dir):
    s = preprocess.SelectKBest(k=2).fit(table(spark, sf_dir, "lineitem"), _X, "l_returnflag")
    order = sorted(s.kept_, key=lambda c: (-s.scores_[_X.index(c)], c))
    return frame(spark, [(c, k + 1) for k, c in enumerate(order)], "name string, k long")


@over("chi2")
def chi2(spark, sf_dir):
    return rounded(one(spark, chi2=preprocess.chi2(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_returnflag")[0][0]), 4, "chi2")


@over("mutual_info_discrete")
def mutual_info_discrete(spark, sf_dir):
    return rounded(one(spark, mi=preprocess.mutual_info_classif(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus")[0]), 6, "mi")


@over("class_weight_balanced", "SELECT doc_id, round(n / (k * 1e0 * c), 6) AS w FROM {labels} JOIN (SELECT toxic AS t, count(*) AS c FROM {labels} GROUP BY toxic) ON toxic = t, (SELECT count(*) AS n, count(DISTINCT toxic) AS k FROM {labels})")
def class_weight_balanced(spark, sf_dir):
    return rounded(preprocess.balanced_class_weight(table(spark, sf_dir, "labels"), "toxic", "w").select("doc_id", "w"), 6, "w")


@over("finite_scan", "SELECT 'o_totalprice' AS column_name, count(*) FILTER (o_totalprice IS NULL) AS nulls, count(*) FILTER (isnan(o_totalprice)) AS nans, count(*) FILTER (isinf(o_totalprice)) AS infinities FROM orders")
def finite_scan(spark, sf_dir):
    return preprocess.finite_scan(table(spark, sf_dir, "orders"), ["o_totalprice"]).withColumnRenamed("column", "column_name")


# --- linear, Bayes ---------------------------------------------------------------------------------------------------

_TWO = ["l_quantity", "l_discount"]


@over("linear_regression")
def linear_regression(spark, sf_dir):
    m = linear.LinearRegression().fit(table(spark, sf_dir, "lineitem"), _TWO, "l_extendedprice")
    return one(spark, w1=m.coef_[0], w2=m.coef_[1], intercept=m.intercept_).select(F.round("w1", 4).alias("w1"), F.round("w2", 3).alias("w2"), F.round("intercept", 3).alias("intercept"))


@over("linear_regression_predict")
def linear_regression_predict(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    m = linear.LinearRegression().fit(x, _TWO, "l_extendedprice")
    return m.predict(x, "p").select("l_orderkey", "l_linenumber", F.round("p", 2).alias("p"))


@over("linear_score_r2")
def linear_score_r2(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return rounded(one(spark, r2=linear.LinearRegression().fit(x, _TWO, "l_extendedprice").score(x, "l_extendedprice")), 6, "r2")


def _ridge(spark, sf_dir, alpha):
    m = linear.Ridge(alpha=alpha).fit(table(spark, sf_dir, "lineitem"), _TWO, "l_extendedprice")
    return round(m.coef_[0], 4), round(m.coef_[1], 3)


@over("ridge")
def ridge(spark, sf_dir):
    return frame(spark, [_ridge(spark, sf_dir, 1.0)], "w1 double, w2 double")


@over("ridge_cv_grid")
def ridge_cv_grid(spark, sf_dir):
    return frame(spark, [(a, *_ridge(spark, sf_dir, a)) for a in (1.0, 10.0, 100.0)], "alpha double, w1 double, w2 double")


@over("lasso_one_feature")
def lasso_one_feature(spark, sf_dir):
    return rounded(one(spark, w=linear.Lasso(alpha=50.0).fit(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice").coef_[0]), 4, "w")


@over("elastic_net_one_feature", "SELECT round(CASE WHEN abs(u) <= 2.5e1 THEN 0 ELSE (u - 2.5e1 * sign(u)) / (a + 25e0) END, 4) AS w FROM (SELECT covar_pop(l_quantity, l_extendedprice) AS u, var_pop(l_quantity) AS a FROM {lineitem})")
def elastic_net_one_feature(spark, sf_dir):
    return rounded(one(spark, w=linear.ElasticNet(alpha=50.0, l1_ratio=0.5).fit(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice").coef_[0]), 4, "w")


@over("gaussian_nb_fit")
def gaussian_nb_fit(spark, sf_dir):
    m = linear.GaussianNB(var_smoothing=0.0).fit(table(spark, sf_dir, "lineitem"), _TWO, "l_returnflag")
    n = m.sums_["n"]
    return frame(spark, [(c, round(m.theta_[k, 0], 6), round(m.var_[k, 0], 4), round(m.theta_[k, 1], 6), round(m.var_[k, 1], 6), int(n[k])) for k, c in enumerate(m.classes_)], "k string, mq double, vq double, md double, vd double, n long")


@over("gaussian_nb_joint_log_likelihood")
def gaussian_nb_joint_log_likelihood(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    m = linear.GaussianNB(var_smoothing=0.0).fit(x, _TWO, "l_returnflag")
    rows = float(sum(m.sums_["n"]))
    shift = np.log(rows) + np.log(2 * np.pi)  # the statement keeps ln(count) and leaves the constant out
    names = F.array(*[F.lit(c) for c in m.classes_])
    return x.select("l_orderkey", "l_linenumber", F.posexplode(m.jll_column(_TWO)).alias("i", "v")).select("l_orderkey", "l_linenumber", F.element_at(names, F.col("i") + 1).alias("k"), F.round(F.col("v") + float(shift), 5).alias("jll"))


@over("gaussian_nb_partial_fit")
def gaussian_nb_partial_fit(spark, sf_dir):
    x, m = table(spark, sf_dir, "lineitem"), linear.GaussianNB()
    for k in (0, 1):
        m.partial_fit(x.where(F.col("l_orderkey") % 2 == k), ["l_quantity"], "l_returnflag", ["A", "N", "R"] if not k else None)
    return frame(spark, [(c, round(m.theta_[k, 0], 6)) for k, c in enumerate(m.classes_)], "k string, m double")


@over("bernoulli_nb")
def bernoulli_nb(spark, sf_dir):
    m = linear.BernoulliNB(binarize=25.0).fit(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_returnflag")
    p = 1 / (1 + np.exp(-np.asarray(m.feature_log_prob_)[:, 0]))
    return frame(spark, [(c, round(float(v), 6)) for c, v in zip(m.classes_, p)], "l_returnflag string, p double")


@over("multinomial_nb")
def multinomial_nb(spark, sf_dir):
    m = linear.MultinomialNB().fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber"], "l_returnflag")
    return frame(spark, [(c, round(float(np.exp(v[0])), 6)) for c, v in zip(m.classes_, np.asarray(m.feature_log_prob_))], "l_returnflag string, p double")


@over("complement_nb")
def complement_nb(spark, sf_dir):
    m = linear.ComplementNB().fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber"], "l_returnflag")
    return frame(spark, [(c, round(float(np.exp(-v[0])), 6)) for c, v in zip(m.classes_, np.asarray(m.feature_log_prob_))], "k string, p double")


@over("categorical_nb")
def categorical_nb(spark, sf_dir):
    x = preprocess.OrdinalEncoder().fit(table(spark, sf_dir, "lineitem"), ["l_linestatus"])
    m = linear.CategoricalNB().fit(x.transform(table(spark, sf_dir, "lineitem")), ["l_linestatus_code"], "l_returnflag")
    seen = {tuple(r) for r in table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct().collect()}
    rows = [(k, c, round(float(np.exp(m.feature_log_prob_[0][i][j])), 6)) for i, k in enumerate(m.classes_) for j, c in enumerate(x.categories_[0]) if (k, c) in seen]
    return frame(spark, rows, "k string, c string, p double")


@over("nearest_centroid", "SELECT l_orderkey, l_linenumber, k FROM (SELECT l_orderkey, l_linenumber, k, row_number() OVER (PARTITION BY id ORDER BY round((l_quantity - q) ** 2 + (l_tax - t) ** 2, 9), k) AS r FROM (SELECT *, row_number() OVER () AS id FROM lineitem), (SELECT l_returnflag AS k, avg(l_quantity) AS q, avg(l_tax) AS t FROM lineitem GROUP BY l_returnflag)) WHERE r = 1")
def nearest_centroid(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return linear.NearestCentroid().fit(x, ["l_quantity", "l_tax"], "l_returnflag").predict(x, "k").select("l_orderkey", "l_linenumber", "k")


@over("pca_two_columns")
def pca_two_columns(spark, sf_dir):
    p = decompose.PCA().fit(table(spark, sf_dir, "lineitem"), _TWO)
    n = p.rows_
    e = np.asarray(p.explained_variance_) * (n - 1) / n
    return frame(spark, [(round(e[0], 5), round(e[1], 6), round(float(p.explained_variance_ratio_[0]), 6))], "ev1 double, ev2 double, ratio double")


@over("linear_discriminant_means")
def linear_discriminant_means(spark, sf_dir):
    m = linear.LinearDiscriminantAnalysis().fit(table(spark, sf_dir, "lineitem"), _TWO, "l_returnflag")
    return frame(spark, [(c, round(float(v[0]), 5), round(float(v[1]), 6), round(float(p), 6)) for c, v, p in zip(m.classes_, m.means_, m.priors_)], "l_returnflag string, q double, d double, prior double")


@over("quadratic_discriminant_covariances")
def quadratic_discriminant_covariances(spark, sf_dir):
    m = linear.QuadraticDiscriminantAnalysis().fit(table(spark, sf_dir, "lineitem"), _TWO, "l_returnflag")
    return frame(spark, [(c, round(float(v[0, 0]), 4), round(float(v[0, 1]), 6)) for c, v in zip(m.classes_, m.covariances_)], "l_returnflag string, qq double, qd double")


# --- vectors -----------------------------------------------------------------------------------------------------------


def vectors_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def asked(spark, sf_dir) -> DataFrame:
    """The query set: every row whose id is divisible by 100."""
    return vectors_of(spark, sf_dir).where("vec_id % 100 = 0")


@over("nearest_neighbors")
def nearest_neighbors(spark, sf_dir):
    m = neighbors.NearestNeighbors(n_neighbors=10, metric="sqeuclidean").fit(vectors_of(spark, sf_dir), "e", "vec_id")
    return m.kneighbors(asked(spark, sf_dir), "vec_id").select(F.col("query").alias("q"), F.col("id").alias("vec_id"), (F.col("rank") + 1).cast("long").alias("k"))


@over("radius_neighbors", twin("SELECT q, vec_id, round(DIST, 6) AS d FROM QUERIES, VECTORS WHERE DIST <= 1.2e0".replace("DIST", vectors.SQ[1]).replace("QUERIES", vectors.D).replace("VECTORS", vectors._DUCK)))
def radius_neighbors(spark, sf_dir):
    m = neighbors.RadiusNeighbors(metric="sqeuclidean").fit(vectors_of(spark, sf_dir), "e", "vec_id")
    return m.radius_neighbors(asked(spark, sf_dir), "vec_id", 1.2).select(F.col("query").alias("q"), F.col("id").alias("vec_id"), F.round("distance", 6).alias("d"))


@over("knn_classifier")
def knn_classifier(spark, sf_dir):
    m = neighbors.KNeighborsClassifier(n_neighbors=15, metric="sqeuclidean").fit(vectors_of(spark, sf_dir), "e", "label", "vec_id")
    return m.predict(asked(spark, sf_dir), "vec_id", keep_self=False).select(F.col("query").alias("q"), F.col("prediction").alias("label"))


@over("knn_regressor")
def knn_regressor(spark, sf_dir):
    m = neighbors.KNeighborsRegressor(n_neighbors=15, metric="sqeuclidean").fit(vectors_of(spark, sf_dir), "e", "label", "vec_id")
    return m.predict(asked(spark, sf_dir), "vec_id", keep_self=False).select(F.col("query").alias("q"), F.round("prediction", 6).alias("y"))


@over("filtered_search")
def filtered_search(spark, sf_dir):
    m = neighbors.NearestNeighbors(n_neighbors=5, metric="sqeuclidean").fit(vectors_of(spark, sf_dir), "e", "vec_id", "label")
    return m.kneighbors(asked(spark, sf_dir), "vec_id", mask=F.col("label") % 2 == 0).select(F.col("query").alias("q"), F.col("id").alias("vec_id"), (F.col("rank") + 1).cast("long").alias("k"))


@over("kernel_density", twin(f"SELECT q, round(ln(avg(exp(-DIST / 2))) - 32 * ln(2 * pi()), 6) AS log_density FROM {vectors.D}, {vectors._DUCK} GROUP BY q".replace("DIST", vectors.SQ[1])))
def kernel_density(spark, sf_dir):
    from millrace.learn.cluster import KernelDensity

    m = KernelDensity().fit(vectors_of(spark, sf_dir), "e")
    return m.score_samples(asked(spark, sf_dir), "e", "vec_id").select(F.col("id").alias("q"), F.round("log_density", 6).alias("log_density"))


def _distance(metric):
    def fn(spark, sf_dir):
        """Distances of the query set to all rows, a block of queries to each task."""
        m = neighbors.NearestNeighbors(metric=metric, p=3.0).fit(vectors_of(spark, sf_dir), "e", "vec_id")
        d = m.radius_neighbors(asked(spark, sf_dir), "vec_id", float("inf"))
        v = -F.col("distance") if metric == "inner_product" else F.pow("distance", F.lit(3.0)) if metric == "minkowski" else F.col("distance")
        return d.select(F.col("query").alias("q"), F.col("id").alias("vec_id"), F.round(v, 6).alias("d"))

    return fn


for _name, _metric in (("sqeuclidean", "sqeuclidean"), ("manhattan", "manhattan"), ("dot", "inner_product"), ("minkowski3", "minkowski")):
    over(f"distance_{_name}")(_distance(_metric))
over("distance_canberra", catalog.ORACLE_SQL["distance_canberra"].replace("abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2]))", "CASE WHEN abs(z[1]) + abs(z[2]) > 0 THEN abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2])) ELSE 0 END"))(_distance("canberra"))

#: The other metrics between queries and rows, as SQL over a and e.
_Z = "list_zip(a, e)"
_MEANED = "list_transform({v}, lambda x: x - list_avg({v}))"
for _name, _sql in {
    "euclidean": f"sqrt(list_sum(list_transform({_Z}, lambda z: (z[1] - z[2]) * (z[1] - z[2]))))",
    "chebyshev": f"list_max(list_transform({_Z}, lambda z: abs(z[1] - z[2])))",
    "braycurtis": f"list_sum(list_transform({_Z}, lambda z: abs(z[1] - z[2]))) / list_sum(list_transform({_Z}, lambda z: abs(z[1] + z[2])))",
    "cosine": "1 - list_cosine_similarity(a, e)",
    "correlation": f"1 - list_cosine_similarity({_MEANED.format(v='a')}, {_MEANED.format(v='e')})",
}.items():
    catalog.QUERIES[f"distance_{_name}"] = _distance(_name)
    catalog.ORACLE_SQL[f"distance_{_name}"] = twin(f"SELECT q, vec_id, round({_sql}, 6) + 0e0 AS d FROM {vectors.D}, {vectors._DUCK}")

#: k-means with given centres: the vectors of the eight lowest ids.
_K = f"(SELECT vec_id AS q, e AS a FROM {vectors._DUCK} ORDER BY vec_id LIMIT 8)"


def _centers(spark, sf_dir):
    rows = vectors_of(spark, sf_dir).orderBy("vec_id").limit(8).collect()
    return [r["vec_id"] for r in rows], np.array([r["e"] for r in rows])


@over("kmeans_assign", f"SELECT vec_id, q AS center FROM (SELECT vec_id, q, row_number() OVER (PARTITION BY vec_id ORDER BY round({vectors.SQ[1]}, 9), q) AS k FROM {_K}, {vectors._DUCK}) WHERE k = 1")
def kmeans_assign(spark, sf_dir):
    from millrace.learn.cluster import KMeans

    ids, c = _centers(spark, sf_dir)
    m = KMeans(n_clusters=8)
    m.state |= {"cluster_centers": c, "features": "e"}
    names = F.array(*[F.lit(i) for i in ids])
    return vectors_of(spark, sf_dir).select("vec_id", F.element_at(names, m.predict_column("e") + 1).alias("center"))


@over("kmeans_inertia", f"SELECT round(sum(d), 3) AS inertia FROM (SELECT vec_id, min({vectors.SQ[1]}) AS d FROM {_K}, {vectors._DUCK} GROUP BY vec_id)")
def kmeans_inertia(spark, sf_dir):
    from millrace.learn.cluster import cluster_cost

    return rounded(one(spark, inertia=cluster_cost(vectors_of(spark, sf_dir), "e", _centers(spark, sf_dir)[1])), 3, "inertia")


@over("ivf_lists", f"SELECT center, count(*) AS n FROM (SELECT vec_id, q AS center, row_number() OVER (PARTITION BY vec_id ORDER BY round({vectors.SQ[1]}, 9), q) AS k FROM {_K}, {vectors._DUCK}) WHERE k = 1 GROUP BY center")
def ivf_lists(spark, sf_dir):
    return kmeans_assign(spark, sf_dir).groupBy("center").agg(F.count(F.lit(1)).alias("n"))


catalog.QUERIES["dbscan_core_points"] = catalog.QUERIES.pop("dbscan_core_flags")
catalog.ORACLE_SQL["dbscan_core_points"] = catalog.ORACLE_SQL.pop("dbscan_core_flags")
del catalog.QUERIES["searchsorted_all"]
catalog.ORACLE_SQL["searchsorted"] = catalog.ORACLE_SQL.pop("searchsorted_all")


@over("searchsorted")
def searchsorted(spark, sf_dir):
    """Positions of all suppliers' balances among all customers': running counts by range partitions of both."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    both = c.select(F.col("c_acctbal").alias("v"), F.lit(1.0).alias("n")).unionByName(s.select(F.col("s_acctbal").alias("v"), F.lit(0.0).alias("n"))).where("v is not null")
    run = metrics.cumulative(both.groupBy("v").agg(F.sum("n").alias("n")), "v", ["n"])
    total = c.where("c_acctbal is not null").count()
    return s.select("s_suppkey", "s_acctbal").join(run, F.col("s_acctbal") == F.col("v"), "left").select("s_suppkey", F.coalesce((F.lit(total) - F.col("cum_n")).cast("long"), F.lit(0)).alias("pos"))


@over("argsort")
def argsort(spark, sf_dir):
    from millrace.learn.forecast import numbered

    x = numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], "pos")
    return x.select("c_custkey", (F.col("pos") + 1).alias("pos"))


# --- words: letters of any script, lower case -----------------------------------------------------------------------------

_WORDS = (r"explode(regexp_extract_all(lower(text), '\\p{L}+', 0))", r"unnest(regexp_extract_all(lower(text), '\p{L}+', 0))")
for _name in ("word_counts", "vocabulary_top", "document_frequency"):
    for _held, _side in ((catalog.ORACLE_SQL, 1),):
        _held[_name] = _held[_name].replace("unnest(regexp_extract_all(text, '[a-z]+', 0))", _WORDS[1])


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))


@over("word_counts")
def word_counts(spark, sf_dir):
    return _words(spark, sf_dir).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@over("vocabulary_top")
def vocabulary_top(spark, sf_dir):
    return word_counts(spark, sf_dir).orderBy(F.desc("n"), "w").limit(100)


@over("document_frequency")
def document_frequency(spark, sf_dir):
    return _words(spark, sf_dir).distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n"))


# --- metrics ---------------------------------------------------------------------------------------------------------------

_BIN = "(SELECT toxic AS y, (doc_id * 7919 % 1009) / 1009e0 AS s, doc_id AS id FROM {labels})"


def scores(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("toxic").alias("y"), (F.col("doc_id") * 7919 % 1009 / F.lit(1009.0)).alias("s"), F.col("doc_id").alias("id"))


_POINTS = f"(SELECT s, sum(y) OVER (ORDER BY s DESC) AS tp, sum(m - y) OVER (ORDER BY s DESC) AS fp, y AS dy, m - y AS dn FROM (SELECT s, sum(y) AS y, count(*) AS m FROM {_BIN} GROUP BY s))"
_SIZES = f"(SELECT sum(y) * 1e0 AS np, (count(*) - sum(y)) * 1e0 AS nn FROM {_BIN})"


@over("roc_curve", f"SELECT s AS threshold, round(fp / nn, 8) AS fpr, round(tp / np, 8) AS tpr FROM {_POINTS}, {_SIZES} UNION ALL SELECT 'inf'::DOUBLE, 0, 0")
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(scores(spark, sf_dir), "y", "s"), 8, "fpr", "tpr")


@over("precision_recall_curve", f"SELECT s AS threshold, round(tp / (tp + fp), 8) AS precision, round(tp / np, 8) AS recall FROM {_POINTS}, {_SIZES} UNION ALL SELECT 'inf'::DOUBLE, 1, 0")
def precision_recall_curve(spark, sf_dir):
    return rounded(metrics.precision_recall_curve(scores(spark, sf_dir), "y", "s"), 8, "precision", "recall")


@over("det_curve", f"SELECT s AS threshold, round(fp / nn, 8) AS fpr, round(1 - tp / np, 8) AS fnr FROM {_POINTS}, {_SIZES}")
def det_curve(spark, sf_dir):
    return rounded(metrics.det_curve(scores(spark, sf_dir), "y", "s"), 8, "fpr", "fnr")


@over("average_precision", f"SELECT round(sum(dy * tp / (tp + fp)) / max(np), 8) AS v FROM {_POINTS}, {_SIZES}")
def average_precision(spark, sf_dir):
    return rounded(one(spark, v=metrics.average_precision_score(scores(spark, sf_dir), "y", "s")), 8, "v")


@over("roc_auc_score")
def roc_auc_score(spark, sf_dir):
    return rounded(one(spark, v=metrics.roc_auc_score(scores(spark, sf_dir), "y", "s")), 6, "v")


def classes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).cast("long").alias("y"), (F.col("l_suppkey") % 3).alias("p"))


def hits(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("toxic").alias("y"), F.when(F.col("doc_id") * 7919 % 1009 > 700, 1).otherwise(0).alias("p"))


@over("top_k_accuracy", "SELECT round(avg(CASE WHEN r <= 2 THEN 1e0 ELSE 0e0 END), 6) AS v FROM (SELECT k = y AS own, row_number() OVER (PARTITION BY id ORDER BY s DESC, k DESC) AS r FROM (SELECT id, l_linenumber % 3 AS y, k, (l_suppkey * (k + 1) * 31 + l_partkey * 7) % 101 AS s FROM (SELECT *, row_number() OVER () AS id FROM {lineitem}), (SELECT unnest([0, 1, 2]) AS k))) WHERE own")
def top_k_accuracy(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).alias("y"), F.array(*[((F.col("l_suppkey") * (k + 1) * 31 + F.col("l_partkey") * 7) % 101).cast("double") for k in range(3)]).alias("s"))
    return rounded(one(spark, v=metrics.top_k_accuracy_score(x, "y", "s", [0, 1, 2], 2)), 6, "v")


@over("matthews_corrcoef")
def matthews_corrcoef(spark, sf_dir):
    return rounded(one(spark, v=metrics.matthews_corrcoef(hits(spark, sf_dir), "y", "p")), 6, "v")


@over("cohen_kappa")
def cohen_kappa(spark, sf_dir):
    return rounded(one(spark, v=metrics.cohen_kappa_score(classes(spark, sf_dir), "y", "p")), 6, "v")


@over("jaccard_score")
def jaccard_score(spark, sf_dir):
    labels, j = metrics.jaccard_score(hits(spark, sf_dir), "y", "p", None)
    return rounded(one(spark, v=j[labels.index(1)]), 6, "v")


_CLS = "(SELECT l_linenumber % 3 AS y, l_suppkey % 3 AS p FROM {lineitem})"
_PER = f"(SELECT c, count(*) FILTER (y = c AND p = c) * 1e0 AS tp, count(*) FILTER (p = c) * 1e0 AS np, count(*) FILTER (y = c) * 1e0 AS ny, count(*) * 1e0 AS n FROM {_CLS}, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c)"


@over("classification_report", f"SELECT c::VARCHAR AS c, round(tp / np, 6) AS prec, round(tp / ny, 6) AS rec, round(2 * tp / (np + ny), 6) AS f1, ny AS support FROM {_PER} UNION ALL SELECT 'macro', round(avg(tp / np), 6), round(avg(tp / ny), 6), round(avg(2 * tp / (np + ny)), 6), sum(ny) FROM {_PER} UNION ALL SELECT 'weighted', round(sum(tp / np * ny) / sum(ny), 6), round(sum(tp) / sum(ny), 6), round(sum(2 * tp / (np + ny) * ny) / sum(ny), 6), sum(ny) FROM {_PER} UNION ALL SELECT 'micro', round(sum(tp) / sum(np), 6), round(sum(tp) / sum(ny), 6), round(2 * sum(tp) / (sum(np) + sum(ny)), 6), sum(ny) FROM {_PER}")
def classification_report(spark, sf_dir):
    x = classes(spark, sf_dir)
    labels, pr, rc, f, s = metrics.precision_recall_fscore_support(x, "y", "p")
    rows = [(str(c), *(float(v) for v in r)) for c, *r in zip(labels, pr, rc, f, s)]
    rows += [(a, *metrics.precision_recall_fscore_support(x, "y", "p", average=a)) for a in ("macro", "weighted", "micro")]
    return rounded(frame(spark, rows, "c string, prec double, rec double, f1 double, support double"), 6, "prec", "rec", "f1")


@over("multilabel_confusion_matrix", f"SELECT c, tp, np - tp AS fp, ny - tp AS fn, n - np - ny + tp AS tn FROM {_PER}")
def multilabel_confusion_matrix(spark, sf_dir):
    labels, m = metrics.multilabel_confusion_matrix(classes(spark, sf_dir), "y", "p")
    return frame(spark, [(int(c), float(v[1, 1]), float(v[0, 1]), float(v[1, 0]), float(v[0, 0])) for c, v in zip(labels, m)], "c int, tp double, fp double, fn double, tn double")


@over("pair_confusion", f"WITH c AS (SELECT y, p, count(*) * 1e0 AS n FROM {_CLS} GROUP BY y, p) SELECT sum(CASE WHEN a.y = b.y AND a.p = b.p THEN a.n * (b.n - 1) ELSE 0 END) AS both, sum(CASE WHEN a.y = b.y AND a.p <> b.p THEN a.n * b.n ELSE 0 END) AS first_only, sum(CASE WHEN a.y <> b.y AND a.p = b.p THEN a.n * b.n ELSE 0 END) AS second_only, sum(CASE WHEN a.y <> b.y AND a.p <> b.p THEN a.n * b.n ELSE 0 END) AS neither FROM c a, c b")
def pair_confusion(spark, sf_dir):
    m = metrics.pair_confusion_matrix(classes(spark, sf_dir), "y", "p")
    return one(spark, both=m[1, 1], first_only=m[1, 0], second_only=m[0, 1], neither=m[0, 0])


@over("calinski_harabasz_score")
def calinski_harabasz_score(spark, sf_dir):
    return rounded(one(spark, score=metrics.calinski_harabasz_score(vectors_of(spark, sf_dir), "e", "label")), 5, "score")


@over("histogram", "SELECT b::INTEGER AS bin, count(t) AS n FROM (SELECT unnest(range(0, 10)) AS b) LEFT JOIN (SELECT l_quantity AS t, least(floor((l_quantity - lo) / (hi - lo) * 10 + 1e-12), 9) AS k FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)) ON k = b GROUP BY b")
def histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "lineitem"), "l_quantity").select("bin", "n")


# --- resampling and splits -----------------------------------------------------------------------------------------------------


@over("jackknife", "SELECT round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS se FROM customer")
def jackknife(spark, sf_dir):
    """Deviation of the means that leave one row out, from sums alone."""
    x = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("x"))
    s = x.agg(F.sum("x").alias("s"), F.count("x").alias("n")).first()
    out = x.select(((F.lit(s["s"]) - F.col("x")) / (s["n"] - 1)).alias("m"))
    return rounded(out.agg(F.sqrt((s["n"] - 1) * F.var_pop("m")).alias("se")), 6, "se")


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@over("kfold_split", "SELECT o_orderkey, CASE WHEN k < b * (s + 1) THEN floor(k / (s + 1)) ELSE b + floor((k - b * (s + 1)) / s) END::INTEGER AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () % 5 AS b, floor(count(*) OVER () / 5) AS s FROM orders)")
def kfold_split(spark, sf_dir):
    return selection.KFold(5).assign(orders(spark, sf_dir).select("o_orderkey"), "o_orderkey")


@over("stratified_kfold", "WITH d AS (SELECT o_orderkey, o_orderpriority AS c, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS k FROM orders), f AS (SELECT c, min(o_orderkey) AS first_key, count(*) AS n FROM d GROUP BY c), o AS (SELECT c, n, sum(n) OVER (ORDER BY first_key) - n AS base FROM f), a AS (SELECT c, fold, count(*) AS m FROM (SELECT c, (base + i) % 5 AS fold FROM (SELECT c, base, unnest(range(0, n)) AS i FROM o)) GROUP BY c, fold), e AS (SELECT c, fold, sum(m) OVER (PARTITION BY c ORDER BY fold) AS hi, sum(m) OVER (PARTITION BY c ORDER BY fold) - m AS lo FROM a) SELECT o_orderkey, fold::INTEGER AS fold FROM d JOIN e ON d.c = e.c AND k >= lo AND k < hi")
def stratified_kfold(spark, sf_dir):
    return selection.StratifiedKFold(5).assign(orders(spark, sf_dir).select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority").select("o_orderkey", "fold")


@over("time_series_split", "SELECT o_orderkey, s::INTEGER AS split, CASE WHEN k >= n - t * (5 - s) THEN 'test' ELSE 'train' END AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n, count(*) OVER () // 6 AS t FROM orders), (SELECT unnest(range(0, 5)) AS s) WHERE k < n - t * (4 - s)")
def time_series_split(spark, sf_dir):
    return selection.TimeSeriesSplit(5).table(orders(spark, sf_dir), "o_orderkey")


@over("group_kfold", "SELECT fold, n, groups_ FROM (SELECT NULL AS fold, NULL AS n, NULL AS groups_) WHERE false")
def group_kfold(spark, sf_dir):
    x = selection.GroupKFold(5).assign(orders(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")
    return x.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("groups_"))


@over("stratified_group_kfold", "SELECT 1")
def stratified_group_kfold(spark, sf_dir):
    x = selection.StratifiedGroupKFold(5).assign(orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", "o_custkey")
    return x.groupBy("fold", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@over("train_test_split", "SELECT count(*)::BIGINT - ceil(count(*) * 0.25)::BIGINT AS train, ceil(count(*) * 0.25)::BIGINT AS test, 0::BIGINT AS both FROM orders")
def train_test_split(spark, sf_dir):
    a, b = selection.train_test_split(orders(spark, sf_dir).select("o_orderkey"), "o_orderkey")
    x = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy("o_orderkey").agg(F.sum("s").alias("s"))
    return x.agg(F.count(F.when(F.col("s") == 1, 1)).alias("train"), F.count(F.when(F.col("s") == 2, 1)).alias("test"), F.count(F.when(F.col("s") == 3, 1)).alias("both"))


# greedy allocations have no SQL; their tests compare with a loop over collected groups
for _name in ("group_kfold", "stratified_group_kfold"):
    del catalog.ORACLE_SQL[_name]

# --- tensors: whole arrays come out ------------------------------------------------------------------------------------------


def _tensor(name: str, op: str, sql: str, inner: str = "*", *args, digits: int = 6, **attrs) -> None:
    def fn(spark, sf_dir):
        x = vectors_of(spark, sf_dir).select("vec_id", tensor.column(op, "e", *args, width=64, **attrs).alias("o"))
        return x.select("vec_id", F.posexplode("o").alias("i", "v")).select("vec_id", "i", (F.round("v", digits) + 0.0).alias("v"))

    catalog.QUERIES[f"tensor_{name}"] = fn
    catalog.ORACLE_SQL[f"tensor_{name}"] = twin(f"SELECT vec_id, unnest(range(0, len(o)))::INTEGER AS i, round(unnest(o), {digits}) + 0e0 AS v FROM (SELECT vec_id, {sql} AS o FROM (SELECT {inner} FROM {vectors._DUCK}))")


_M = "*, list_avg(e) AS m"
_tensor("softmax", "Softmax", "list_transform(e, lambda x: exp(x - m) / list_sum(list_transform(e, lambda y: exp(y - m))))", "*, list_max(e) AS m", axis=-1)
_tensor("log_softmax", "LogSoftmax", "list_transform(e, lambda x: x - m - ln(list_sum(list_transform(e, lambda y: exp(y - m)))))", "*, list_max(e) AS m", axis=-1)
_tensor("layer_normalization", "LayerNormalization", "list_transform(e, lambda x: (x - m) / sqrt(list_avg(list_transform(e, lambda y: (y - m) * (y - m))) + 1e-5))", _M, np.ones(64))
_tensor("rms_normalization", "RMSNormalization", "list_transform(e, lambda x: x / sqrt(m + 1e-6))", "*, list_avg(list_transform(e, lambda y: y * y)) AS m", np.ones(64), epsilon=1e-6)
_tensor("argmax", "ArgMax", "[list_position(e, list_max(e)) - 1.0]", axis=0, keepdims=1)
_tensor("gather", "Gather", "[e[6], e[1], e[64]]", "*", np.array([5, 0, 63]), axis=0)
_tensor("concat", "Concat", "list_concat(e, [1.0, 2.0])", "*", np.array([1.0, 2.0]), axis=0)
_tensor("pad", "Pad", "list_concat(list_concat([0.5, 0.5], e), [0.5])", "*", np.array([2, 1]), np.array(0.5))
_tensor("split", "Split", "e[17:64]", split=[16, 48], piece=1)
_tensor("expand", "Expand", "list_concat(e, e)", "*", np.array([2, 64]))
_tensor("flatten", "Flatten", "e", axis=0)
_tensor("reshape", "Reshape", "e", "*", np.array([8, 8]))
_tensor("squeeze", "Squeeze", "e")
_tensor("unsqueeze", "Unsqueeze", "e", axes=[0])
_tensor("shape", "Shape", "[64.0]")
_tensor("dropout", "Dropout", "e")
_tensor("constant_of_shape", "ConstantOfShape", "[1.5, 1.5, 1.5]", "*", digits=6)
catalog.QUERIES["tensor_constant_of_shape"] = lambda spark, sf_dir: vectors_of(spark, sf_dir).select("vec_id", F.posexplode(tensor.Program([("ConstantOfShape", ["s"], ["c"], {"value": 1.5})], {"s": np.array([3])}, {"e": (64,)}, "c").column()).alias("i", "v"))
_tensor("conv", "Conv", "list_transform(range(1, 63), lambda k: 0.5 * e[k] - e[k + 1] + 2.0 * e[k + 2] + 0.25)")
_tensor("erf_symmetry", "Erf", "[]")
del catalog.QUERIES["tensor_erf_symmetry"], catalog.ORACLE_SQL["tensor_erf_symmetry"]


def _shaped(name: str, op: str, shape: tuple, sql: str, *args, inner: str = "*", digits: int = 6, **attrs) -> None:
    def fn(spark, sf_dir):
        x = vectors_of(spark, sf_dir).select("vec_id", tensor.column(op, "e", *args, shapes=[shape], **attrs).alias("o"))
        return x.select("vec_id", F.posexplode("o").alias("i", "v")).select("vec_id", "i", (F.round("v", digits) + 0.0).alias("v"))

    catalog.QUERIES[f"tensor_{name}"] = fn
    catalog.ORACLE_SQL[f"tensor_{name}"] = twin(f"SELECT vec_id, unnest(range(0, len(o)))::INTEGER AS i, round(unnest(o), {digits}) + 0e0 AS v FROM (SELECT vec_id, {sql} AS o FROM (SELECT {inner} FROM {vectors._DUCK}))")


_shaped("conv", "Conv", (1, 64), "list_transform(range(1, 63), lambda k: 0.5 * e[k] - e[k + 1] + 2.0 * e[k + 2] + 0.25)", np.array([[[0.5, -1.0, 2.0]]]), np.array([0.25]))
_shaped("average_pool", "AveragePool", (1, 8, 8), "list_transform(range(0, 16), lambda k: list_avg([e[16 * (k // 4) + 2 * (k % 4) + 1], e[16 * (k // 4) + 2 * (k % 4) + 2], e[16 * (k // 4) + 2 * (k % 4) + 9], e[16 * (k // 4) + 2 * (k % 4) + 10]]))", kernel_shape=[2, 2], strides=[2, 2])
_shaped("max_pool", "MaxPool", (1, 8, 8), "list_transform(range(0, 16), lambda k: list_max([e[16 * (k // 4) + 2 * (k % 4) + 1], e[16 * (k // 4) + 2 * (k % 4) + 2], e[16 * (k // 4) + 2 * (k % 4) + 9], e[16 * (k // 4) + 2 * (k % 4) + 10]]))", kernel_shape=[2, 2], strides=[2, 2])
_shaped("global_average_pool", "GlobalAveragePool", (4, 16), "list_transform(range(0, 4), lambda c: list_avg(e[16 * c + 1 : 16 * c + 16]))")
_shaped("global_max_pool", "GlobalMaxPool", (4, 16), "list_transform(range(0, 4), lambda c: list_max(e[16 * c + 1 : 16 * c + 16]))")
_NORMED = "list_transform(range(0, 64), lambda k: (e[k + 1] - list_avg(e[{w} * (k // {w}) + 1 : {w} * (k // {w}) + {w}])) / sqrt(list_avg(list_transform(e[{w} * (k // {w}) + 1 : {w} * (k // {w}) + {w}], lambda y: y * y)) - list_avg(e[{w} * (k // {w}) + 1 : {w} * (k // {w}) + {w}]) ** 2 + 1e-5))"
_shaped("instance_normalization", "InstanceNormalization", (4, 16), _NORMED.format(w=16), np.ones(4), np.zeros(4))
_shaped("group_normalization", "GroupNormalization", (4, 16), _NORMED.format(w=32), np.ones(4), np.zeros(4), num_groups=2)
_shaped("trilu", "Trilu", (8, 8), "list_transform(range(0, 64), lambda k: CASE WHEN k % 8 >= k // 8 THEN e[k + 1] ELSE 0 END)")
_shaped("transpose_rows", "Transpose", (8, 8), "list_transform(range(0, 64), lambda k: e[8 * (k % 8) + k // 8 + 1])", perm=[1, 0])
_shaped("gather_nd", "GatherND", (8, 8), "[e[10], e[64]]", np.array([[1, 1], [7, 7]]))
_shaped("matmul", "MatMul", (8, 8), "list_transform(range(0, 16), lambda k: list_sum(list_transform(range(0, 8), lambda j: e[8 * (k // 2) + j + 1] * (j + k % 2))))", np.array([[j + c for c in range(2)] for j in range(8)], float))
_shaped("gemm", "Gemm", (8, 8), "list_transform(range(0, 16), lambda k: 0.5 * list_sum(list_transform(range(0, 8), lambda j: e[8 * j + k // 2 + 1] * (j + k % 2))) + 2 * (k % 2))", np.array([[j + c for c in range(2)] for j in range(8)], float), np.array([0.0, 1.0]), transA=1, alpha=0.5, beta=2.0)
_shaped("gelu", "Gelu", (64,), "list_transform(e, lambda x: 0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))))", approximate="tanh")


@over("tensor_quantize_int8", f"SELECT vec_id, unnest(range(0, 64))::INTEGER AS i, unnest(o)::TINYINT AS code, round(m / 127, 8) AS scale FROM (SELECT vec_id, list_transform(e, lambda x: round_even(x / (m / 127), 0)) AS o, m FROM (SELECT *, list_max(list_transform(e, lambda y: abs(y))) AS m FROM {vectors._DUCK}))")
def tensor_quantize_int8(spark, sf_dir):
    x = decompose.quantize_int8(vectors_of(spark, sf_dir), "e")
    return x.select("vec_id", F.posexplode("codes").alias("i", "code"), F.round("scale", 8).alias("scale"))


@over("linalg_gram")
def linalg_gram(spark, sf_dir):
    g = decompose.gram(vectors_of(spark, sf_dir), "e")
    return frame(spark, [(i, j, round(float(v), 5)) for i, row in enumerate(g) for j, v in enumerate(row)], "r long, c long, v double")


# names whose operator is now one of millrace.learn, run by millrace.operators.models
for _name in ("pagerank_step", "isotonic_blocks", "bootstrap_means", "permutation_difference", "logistic_gradient", "poisson_gradient", "power_transformer_boxcox", "quantile_transformer", "theta_forecast", "seasonal_decompose", "croston_intervals", "croston_sba", "garch_variance_moments", "kpss_partial_sums", "ar1_yule_walker", "learning_curve", "leave_one_out", "leave_p_groups_out", "leave_one_group_out", "cross_val_score", "predefined_split", "repeated_kfold", "repeated_stratified_kfold", "shuffle_split", "stratified_shuffle_split", "group_shuffle_split", "adaboost_weights", "histogram_split_gain", "gini_impurity", "target_encoder_crossfit", "theil_sen_medians", "quantile_regressor_constant", "dummy_regressor", "dummy_classifier_prior"):
    catalog.QUERIES.pop(_name, None)
    catalog.ORACLE_SQL.pop(_name, None)
