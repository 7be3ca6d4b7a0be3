"""Scalers, encoders, imputers, binning and feature selection: one aggregate to fit, one projection to apply."""

from __future__ import annotations

from millrace.plans.sqltext import statement

LI = "(SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS t, l_returnflag AS f, l_linestatus AS s FROM {lineitem})"
GAPS = "(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS x, o_orderpriority AS c FROM {orders})"

statement("standard_scaler_inverse", f"SELECT id, round((q - m) / v * v + m, 6) AS q FROM {LI}, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS v FROM {{lineitem}})")
statement("minmax_scaler", f"SELECT id, round((q - lo) / (hi - lo), 6) AS q FROM {LI}, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM {{lineitem}})")
statement("maxabs_scaler", "SELECT c_custkey, round(c_acctbal / m, 6) AS x FROM {customer}, (SELECT max(abs(c_acctbal)) AS m FROM {customer})")
statement("robust_scaler", "SELECT c_custkey, round((c_acctbal - m) / (b - a), 6) AS x FROM {customer}, (SELECT percentile(c_acctbal, 0.25) AS a, percentile(c_acctbal, 0.5) AS m, percentile(c_acctbal, 0.75) AS b FROM {customer})")
statement("normalizer_l2", f"SELECT id, round(q / sqrt(q * q + d * d + t * t), 6) AS q, round(d / sqrt(q * q + d * d + t * t), 6) AS d FROM {LI}")
statement("normalizer_l1", f"SELECT id, round(q / (abs(q) + abs(d) + abs(t)), 6) AS q, round(d / (abs(q) + abs(d) + abs(t)), 6) AS d FROM {LI}")
statement("normalizer_max", f"SELECT id, round(q / greatest(abs(q), abs(d), abs(t)), 6) AS q FROM {LI}")
statement("binarizer", f"SELECT id, CASE WHEN q > 25 THEN 1 ELSE 0 END AS q FROM {LI}")
statement("power_transformer_boxcox", f"SELECT id, round((y - m) / v, 5) AS y FROM (SELECT id, (sqrt(e) - 1) * 2 AS y FROM {LI}), (SELECT avg((sqrt(l_extendedprice) - 1) * 2) AS m, stddev_pop((sqrt(l_extendedprice) - 1) * 2) AS v FROM {{lineitem}})")
statement("quantile_transformer", "SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) - 1) / (count(*) OVER () - 1e0), 6) AS x FROM {customer}")
statement("onehot_encoder", f"SELECT id, CASE WHEN f = 'A' THEN 1 ELSE 0 END AS f_a, CASE WHEN f = 'N' THEN 1 ELSE 0 END AS f_n, CASE WHEN f = 'R' THEN 1 ELSE 0 END AS f_r FROM {LI}")
statement("ordinal_encoder", f"SELECT id, CAST(k AS BIGINT) AS code FROM {LI} AS x JOIN (SELECT f AS g, row_number() OVER (ORDER BY f) - 1 AS k FROM (SELECT DISTINCT l_returnflag AS f FROM {{lineitem}})) AS c ON x.f = c.g")
statement("label_encoder", "SELECT c_custkey, CAST(k AS BIGINT) AS code FROM {customer} JOIN (SELECT m, row_number() OVER (ORDER BY m) - 1 AS k FROM (SELECT DISTINCT c_mktsegment AS m FROM {customer})) ON c_mktsegment = m")
statement("label_binarizer", "SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN 1 ELSE -1 END AS y FROM {supplier}")
statement("target_encoder", f"SELECT id, round((n * m + 10 * g) / (n + 10), 6) AS f_mean FROM {LI} AS x JOIN (SELECT l_returnflag AS k, count(*) AS n, avg(l_extendedprice) AS m FROM {{lineitem}} GROUP BY l_returnflag) AS c ON f = k, (SELECT avg(l_extendedprice) AS g FROM {{lineitem}})")
statement("target_encoder_crossfit", "SELECT c.fold, c.k, round((t.s - c.s) / (t.n - c.n), 4) AS mean_elsewhere FROM (SELECT l_orderkey % 5 AS fold, l_returnflag AS k, sum(l_extendedprice) AS s, count(*) AS n FROM {lineitem} GROUP BY l_orderkey % 5, l_returnflag) AS c JOIN (SELECT l_returnflag AS k, sum(l_extendedprice) AS s, count(*) AS n FROM {lineitem} GROUP BY l_returnflag) AS t ON c.k = t.k")
statement("simple_imputer_mean", f"SELECT id, round(coalesce(x, m), 4) AS x, CASE WHEN x IS NULL THEN 1 ELSE 0 END AS missing FROM {GAPS}, (SELECT avg(x) AS m FROM {GAPS})")
statement("simple_imputer_median", f"SELECT id, round(coalesce(x, m), 4) AS x FROM {GAPS}, (SELECT percentile(x, 0.5) AS m FROM {GAPS})")
statement("simple_imputer_constant", f"SELECT id, coalesce(x, 0e0) AS x FROM {GAPS}")
statement("simple_imputer_most_frequent", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN m ELSE o_orderpriority END AS p FROM {orders}, (SELECT p AS m FROM (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS k FROM {orders} WHERE o_orderkey % 7 <> 0 GROUP BY o_orderpriority) WHERE k = 1)")
statement("kbins_uniform", "SELECT c_custkey, CAST(least(floor((c_acctbal - lo) / (hi - lo) * 5), 4) AS BIGINT) AS bin FROM {customer}, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM {customer})")
statement("kbins_quantile", "SELECT c_custkey, CASE WHEN c_acctbal < a THEN 0 WHEN c_acctbal < b THEN 1 WHEN c_acctbal < c THEN 2 ELSE 3 END AS bin FROM {customer}, (SELECT percentile(c_acctbal, 0.25) AS a, percentile(c_acctbal, 0.5) AS b, percentile(c_acctbal, 0.75) AS c FROM {customer})")
statement("polynomial_features", f"SELECT id, 1e0 AS one, q, d, round(q * q, 4) AS q2, round(q * d, 4) AS qd, round(d * d, 4) AS d2 FROM {LI}")
statement("spline_linear_basis", f"SELECT id, round(greatest(0e0, 1 - abs(q - 1) / 24.5e0), 6) AS b0, round(greatest(0e0, 1 - abs(q - 25.5e0) / 24.5e0), 6) AS b1, round(greatest(0e0, 1 - abs(q - 50) / 24.5e0), 6) AS b2 FROM {LI}")
statement("variance_threshold", "SELECT k, round(v, 6) AS v, CASE WHEN v > 0.01 THEN 1 ELSE 0 END AS kept FROM (SELECT 'd' AS k, var_pop(l_discount) AS v FROM {lineitem} UNION ALL SELECT 'q', var_pop(l_quantity) FROM {lineitem} UNION ALL SELECT 't', var_pop(l_tax) FROM {lineitem})")
statement("r_regression", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS q, round(corr(l_discount, l_extendedprice), 6) AS d, round(corr(l_tax, l_extendedprice), 6) AS t FROM {lineitem}")
statement("f_regression", "SELECT round(r * r / (1 - r * r) * (n - 2), 2) AS f FROM (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM {lineitem})")
F_CLASSIF = "SELECT {c} AS name, round((ss_b / (k - 1)) / ((ss_t - ss_b) / (n - k)), 4) AS f FROM (SELECT sum(n_g * (m_g - m) * (m_g - m)) AS ss_b, count(*) AS k FROM (SELECT count(*) AS n_g, avg({c2}) AS m_g FROM TABLE_ GROUP BY l_returnflag), (SELECT avg({c2}) AS m FROM TABLE_)), (SELECT var_pop({c2}) * count(*) AS ss_t, count(*) AS n FROM TABLE_)"
_f = lambda c: F_CLASSIF.replace("{c}", f"'{c}'").replace("{c2}", c).replace("TABLE_", "{lineitem}")
statement("f_classif", f"{_f('l_quantity')} UNION ALL {_f('l_discount')}")
statement("select_k_best", f"SELECT name, CAST(k AS BIGINT) AS k FROM (SELECT name, row_number() OVER (ORDER BY f DESC, name) AS k FROM ({_f('l_quantity')} UNION ALL {_f('l_discount')} UNION ALL {_f('l_tax')})) WHERE k <= 2")
statement("chi2", "SELECT round(sum((o - ex) * (o - ex) / ex), 4) AS chi2 FROM (SELECT o, n_g * tot / n AS ex FROM (SELECT l_returnflag, sum(l_quantity) AS o, count(*) AS n_g FROM {lineitem} GROUP BY l_returnflag), (SELECT sum(l_quantity) AS tot, count(*) AS n FROM {lineitem}))")
statement("mutual_info_discrete", "SELECT round(sum(n_xy / (n * 1e0) * ln(n_xy * (n * 1e0) / (n_x * n_y * 1e0))), 6) AS mi FROM (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n_xy FROM {lineitem} GROUP BY l_returnflag, l_linestatus) JOIN (SELECT l_returnflag AS x2, count(*) AS n_x FROM {lineitem} GROUP BY l_returnflag) ON x = x2 JOIN (SELECT l_linestatus AS y2, count(*) AS n_y FROM {lineitem} GROUP BY l_linestatus) ON y = y2, (SELECT count(*) AS n FROM {lineitem})")
statement("class_weight_balanced", "SELECT toxic, round(n / (k * 1e0 * c), 6) AS w FROM (SELECT toxic, count(*) AS c FROM {labels} GROUP BY toxic), (SELECT count(*) AS n, count(DISTINCT toxic) AS k FROM {labels})")
statement("finite_scan", "SELECT CAST(sum(CASE WHEN o_totalprice IS NULL OR isnan(o_totalprice) THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM {orders}")
