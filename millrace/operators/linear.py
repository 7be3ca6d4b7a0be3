"""Linear, Bayesian and discriminant estimators: sufficient statistics in one aggregate, closed forms over them."""

from __future__ import annotations

from millrace.plans.sqltext import statement

LI = "{lineitem}"
M2 = "(SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_discount, l_discount) AS c, covar_pop(l_quantity, l_extendedprice) AS u, covar_pop(l_discount, l_extendedprice) AS v, avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_extendedprice) AS my, count(*) AS n FROM {lineitem})"


def _solve(l2: str) -> str:
    return f"SELECT (u * (c + {l2}) - v * b) / ((a + {l2}) * (c + {l2}) - b * b) AS w1, (v * (a + {l2}) - u * b) / ((a + {l2}) * (c + {l2}) - b * b) AS w2, mq, md, my FROM {M2}"


statement("linear_regression", f"SELECT round(w1, 4) AS w1, round(w2, 3) AS w2, round(my - w1 * mq - w2 * md, 3) AS intercept FROM ({_solve('0')})")
statement("linear_regression_simple", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM {lineitem}")
statement("linear_regression_predict", f"SELECT l_orderkey, l_linenumber, round(my + w1 * (l_quantity - mq) + w2 * (l_discount - md), 2) AS p FROM {LI}, ({_solve('0')})")
statement("ridge", f"SELECT round(w1, 4) AS w1, round(w2, 3) AS w2 FROM ({_solve('(1e0 / n)')})")
statement("ridge_cv_grid", " UNION ALL ".join(f"SELECT {k}e0 AS alpha, round(w1, 4) AS w1, round(w2, 3) AS w2 FROM ({_solve(f'({k}e0 / n)')})" for k in (1, 10, 100)))
statement("lasso_one_feature", "SELECT round(CASE WHEN abs(u) <= 5e1 THEN 0 ELSE (u - 5e1 * sign(u)) / a END, 4) AS w FROM (SELECT covar_pop(l_quantity, l_extendedprice) AS u, var_pop(l_quantity) AS a FROM {lineitem})")
statement("elastic_net_one_feature", "SELECT round((u - 2.5e1 * sign(u)) / (a + 0.5e0), 4) AS w FROM (SELECT covar_pop(l_quantity, l_extendedprice) AS u, var_pop(l_quantity) AS a FROM {lineitem})")
statement("linear_score_r2", f"SELECT round(1 - sum((l_extendedprice - p) * (l_extendedprice - p)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM (SELECT l_extendedprice, my + w1 * (l_quantity - mq) + w2 * (l_discount - md) AS p FROM {LI}, ({_solve('0')}))")
statement("theil_sen_medians", "SELECT round(percentile((b.l_extendedprice - a.l_extendedprice) / (b.l_quantity - a.l_quantity), 0.5), 3) AS slope FROM {lineitem} AS a JOIN {lineitem} AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_quantity <> b.l_quantity")
statement("quantile_regressor_constant", "SELECT round(percentile(l_extendedprice, 0.9), 4) AS v FROM {lineitem}")
statement("dummy_regressor", "SELECT round(avg(l_extendedprice), 4) AS mean, round(percentile(l_extendedprice, 0.5), 4) AS median FROM {lineitem}")
statement("dummy_classifier_prior", "SELECT toxic, round(n / (t * 1e0), 6) AS p FROM (SELECT toxic, count(*) AS n FROM {labels} GROUP BY toxic), (SELECT count(*) AS t FROM {labels})")
GNB = "(SELECT l_returnflag AS k, avg(l_quantity) AS mq, var_pop(l_quantity) AS vq, avg(l_discount) AS md, var_pop(l_discount) AS vd, count(*) AS n FROM {lineitem} GROUP BY l_returnflag)"
statement("gaussian_nb_fit", f"SELECT k, round(mq, 6) AS mq, round(vq, 4) AS vq, round(md, 6) AS md, round(vd, 6) AS vd, n FROM {GNB}")
statement("gaussian_nb_joint_log_likelihood", f"SELECT l_orderkey, l_linenumber, k, round(ln(n * 1e0) - 0.5e0 * (ln(vq) + ln(vd)) - (l_quantity - mq) * (l_quantity - mq) / (2 * vq) - (l_discount - md) * (l_discount - md) / (2 * vd), 5) AS jll FROM {LI}, {GNB}")
statement("gaussian_nb_partial_fit", "SELECT k, round((n1 * m1 + n2 * m2) / (n1 + n2), 6) AS m FROM (SELECT l_returnflag AS k, count(*) AS n1, avg(l_quantity) AS m1 FROM {lineitem} WHERE l_orderkey % 2 = 0 GROUP BY l_returnflag) JOIN (SELECT l_returnflag AS k2, count(*) AS n2, avg(l_quantity) AS m2 FROM {lineitem} WHERE l_orderkey % 2 = 1 GROUP BY l_returnflag) ON k = k2")
statement("bernoulli_nb", "SELECT l_returnflag, round((sum(CASE WHEN l_quantity > 25 THEN 1e0 ELSE 0e0 END) + 1) / (count(*) + 2), 6) AS p FROM {lineitem} GROUP BY l_returnflag")
statement("multinomial_nb", "SELECT l_returnflag, round((sum(l_quantity) + 1) / (sum(l_quantity) + sum(l_linenumber) + 2), 6) AS p FROM {lineitem} GROUP BY l_returnflag")
statement("complement_nb", "SELECT k, round((t - s + 1) / (t - s + u - r + 2), 6) AS p FROM (SELECT l_returnflag AS k, sum(l_quantity) AS s, sum(l_linenumber * 1e0) AS r FROM {lineitem} GROUP BY l_returnflag), (SELECT sum(l_quantity) AS t, sum(l_linenumber * 1e0) AS u FROM {lineitem})")
statement("categorical_nb", "SELECT a.k, a.c, round((a.n + 1e0) / (b.n + 2e0), 6) AS p FROM (SELECT l_returnflag AS k, l_linestatus AS c, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus) AS a JOIN (SELECT l_returnflag AS k, count(*) AS n FROM {lineitem} GROUP BY l_returnflag) AS b ON a.k = b.k")
statement("nearest_centroid", "SELECT l_orderkey, l_linenumber, k FROM (SELECT l_orderkey, l_linenumber, k, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY round((l_quantity - q) * (l_quantity - q) + (l_tax - t) * (l_tax - t), 9), k) AS r FROM {lineitem}, (SELECT l_returnflag AS k, avg(l_quantity) AS q, avg(l_tax) AS t FROM {lineitem} GROUP BY l_returnflag)) WHERE r = 1")
statement("empirical_covariance", "SELECT round(covar_pop(l_quantity, l_quantity), 5) AS qq, round(covar_pop(l_quantity, l_discount), 6) AS qd, round(covar_pop(l_discount, l_discount), 8) AS dd FROM {lineitem}")
statement("shrunk_covariance", "SELECT round(0.9e0 * a + 0.1e0 * (a + c) / 2, 5) AS qq, round(0.9e0 * b, 6) AS qd, round(0.9e0 * c + 0.1e0 * (a + c) / 2, 5) AS dd FROM (SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_discount, l_discount) AS c FROM {lineitem})")
statement("mahalanobis", f"SELECT l_orderkey, l_linenumber, round((c * (l_quantity - mq) * (l_quantity - mq) - 2 * b * (l_quantity - mq) * (l_discount - md) + a * (l_discount - md) * (l_discount - md)) / (a * c - b * b), 4) AS d2 FROM {LI}, {M2}")
statement("pca_two_columns", f"SELECT round((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 5) AS ev1, round((a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 6) AS ev2, round(((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2) / (a + c), 6) AS ratio FROM {M2}")
statement("linear_discriminant_means", "SELECT l_returnflag, round(avg(l_quantity), 5) AS q, round(avg(l_discount), 6) AS d, round(count(*) / (max(t) * 1e0), 6) AS prior FROM {lineitem}, (SELECT count(*) AS t FROM {lineitem}) GROUP BY l_returnflag")
statement("quadratic_discriminant_covariances", "SELECT l_returnflag, round(covar_samp(l_quantity, l_quantity), 4) AS qq, round(covar_samp(l_quantity, l_discount), 6) AS qd FROM {lineitem} GROUP BY l_returnflag")
statement("logistic_gradient", "SELECT round(avg(p - toxic), 6) AS g0, round(avg((p - toxic) * x), 6) AS g1 FROM (SELECT toxic, x, 1 / (1 + exp(-(0.1e0 + 0.5e0 * x))) AS p FROM (SELECT toxic, (doc_id % 100) / 100e0 AS x FROM {labels}))")
statement("poisson_gradient", "SELECT round(avg(exp(0.1e0 + 0.01e0 * l_quantity) - l_linenumber), 6) AS g0, round(avg((exp(0.1e0 + 0.01e0 * l_quantity) - l_linenumber) * l_quantity), 5) AS g1 FROM {lineitem}")
statement("isotonic_blocks", "SELECT b, round(avg(y), 5) AS y, count(*) AS n FROM (SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS b, l_extendedprice AS y FROM {lineitem}) GROUP BY b")
