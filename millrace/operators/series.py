"""Time series, windows, splits, resampling, graph and tree statistics."""

from __future__ import annotations

from millrace.plans.sqltext import statement

EV = "(SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM {events})"

statement("difference", f"SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY k), 6) AS d FROM {EV}")
statement("seasonal_difference", f"SELECT event_id, round(value - lag(value, 4) OVER (PARTITION BY user_id ORDER BY k), 6) AS d FROM {EV}")
statement("cumulative_sum", f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING), 4) AS s FROM {EV}")
statement("rolling_mean", f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY k ROWS 4 PRECEDING), 5) AS m FROM {EV}")
statement("autocovariance", f"SELECT user_id, round(sum((a - m) * (b - m)) / max(n), 6) AS acov FROM (SELECT user_id, value AS a, lag(value) OVER (PARTITION BY user_id ORDER BY k) AS b, avg(value) OVER (PARTITION BY user_id) AS m, count(*) OVER (PARTITION BY user_id) AS n FROM {EV}) WHERE b IS NOT NULL GROUP BY user_id")
statement("ar1_yule_walker", f"SELECT user_id, round(sum((a - m) * (b - m)) / max(v * n), 6) AS phi FROM (SELECT user_id, value AS a, lag(value) OVER (PARTITION BY user_id ORDER BY k) AS b, avg(value) OVER (PARTITION BY user_id) AS m, var_pop(value) OVER (PARTITION BY user_id) AS v, count(*) OVER (PARTITION BY user_id) AS n FROM {EV}) WHERE b IS NOT NULL GROUP BY user_id HAVING max(v) > 0")
statement(
    "simple_exponential_smoothing",
    f"SELECT user_id, round(aggregate(transform(array_sort(collect_list(struct(k, value))), x -> x.value), CAST(NULL AS DOUBLE), (l, x) -> CASE WHEN l IS NULL THEN x ELSE 0.3e0 * x + 0.7e0 * l END), 5) AS level FROM {EV} GROUP BY user_id",
    f"SELECT user_id, round(list_reduce(list(value ORDER BY k), lambda l, x: 0.3e0 * x + 0.7e0 * l), 5) AS level FROM {EV} GROUP BY user_id",
)
statement("kpss_partial_sums", f"SELECT user_id, round(sum(s * s) / (max(n) * 1e0 * max(n)) / max(v), 5) AS eta FROM (SELECT user_id, n, v, sum(value - m) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, k, value, avg(value) OVER (PARTITION BY user_id) AS m, var_pop(value) OVER (PARTITION BY user_id) AS v, count(*) OVER (PARTITION BY user_id) AS n FROM {EV})) GROUP BY user_id HAVING max(v) > 0")
statement("linear_trend", f"SELECT user_id, round(regr_slope(value, k), 5) AS slope FROM {EV} GROUP BY user_id HAVING count(*) > 2")
statement("seasonal_means", f"SELECT CAST(k % 7 AS BIGINT) AS season, round(avg(value), 5) AS m FROM {EV} GROUP BY CAST(k % 7 AS BIGINT)")
statement("croston_intervals", f"SELECT user_id, round(avg(value), 5) AS demand, count(*) AS n FROM {EV} WHERE value > 50 GROUP BY user_id")
statement("tumbling_counts", "SELECT CAST(floor(unix_timestamp(ts) / 3600) AS BIGINT) AS hour_no, count(*) AS n, round(sum(value), 3) AS v FROM {events} GROUP BY CAST(floor(unix_timestamp(ts) / 3600) AS BIGINT)")
#: DuckDB's epoch() keeps fractions of a second where unix_timestamp() drops them, so the gap is a difference of timestamps.
_GAP = "unix_timestamp(ts) - unix_timestamp(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800"
_SESSIONS = "SELECT user_id, sess, count(*) AS n FROM (SELECT user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sess FROM (SELECT user_id, ts, event_id, CASE WHEN " + _GAP + " THEN 1 ELSE 0 END AS fresh FROM {events})) GROUP BY user_id, sess"
statement("sessions", _SESSIONS.replace(_GAP, "ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '1800' SECOND"), _SESSIONS)
statement("kfold_split", "SELECT o_orderkey, o_orderkey % 5 AS fold FROM {orders}")
statement("stratified_kfold", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 5 AS BIGINT) AS fold FROM {orders}")
statement("group_kfold", "SELECT o_custkey % 5 AS fold, count(*) AS n, count(DISTINCT o_custkey) AS groups_ FROM {orders} GROUP BY o_custkey % 5")
statement("time_series_split", "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) * 6e0 / count(*) OVER ()) AS BIGINT) AS block FROM {orders}")
statement("leave_one_group_out", "SELECT l_returnflag, round((t - s) / (n - c), 4) AS mean_elsewhere FROM (SELECT l_returnflag, sum(l_extendedprice) AS s, count(*) AS c FROM {lineitem} GROUP BY l_returnflag), (SELECT sum(l_extendedprice) AS t, count(*) AS n FROM {lineitem})")
statement("train_test_split", "SELECT o_orderkey, CASE WHEN (o_orderkey * 7919 + 13) % 1000 < 250 THEN 'test' ELSE 'train' END AS part FROM {orders}")
statement("cross_val_score", "SELECT fold, round(avg((y - m) * (y - m)), 3) AS mse FROM (SELECT o_orderkey % 5 AS fold, o_totalprice / 1000 AS y FROM {orders}) JOIN (SELECT f, (t - s) / (n - c) AS m FROM (SELECT o_orderkey % 5 AS f, sum(o_totalprice / 1000) AS s, count(*) AS c FROM {orders} GROUP BY o_orderkey % 5), (SELECT sum(o_totalprice / 1000) AS t, count(*) AS n FROM {orders})) ON fold = f GROUP BY fold")
statement("bootstrap_means", "SELECT b, round(sum(w * x) / sum(w), 5) AS m FROM (SELECT b, o_totalprice / 1000 AS x, (o_orderkey * 48271 + b * 16807) % 2147483647 % 3 AS w FROM {orders}, (SELECT s_suppkey AS b FROM {supplier} WHERE s_suppkey <= 10)) GROUP BY b")
statement("jackknife", "SELECT round(sqrt((n - 1e0) / n * n * v / ((n - 1e0) * (n - 1e0)) * n), 6) AS se FROM (SELECT count(*) AS n, var_pop(c_acctbal) AS v FROM {customer})")
statement("permutation_difference", "SELECT b, round(avg(CASE WHEN g = 1 THEN x END) - avg(CASE WHEN g = 0 THEN x END), 5) AS d FROM (SELECT b, o_totalprice / 1000 AS x, (o_orderkey * 48271 + b * 16807) % 2147483647 % 2 AS g FROM {orders}, (SELECT s_suppkey AS b FROM {supplier} WHERE s_suppkey <= 10)) GROUP BY b")
statement("graph_degree", "SELECT n, count(*) AS deg FROM (SELECT c_nationkey AS n FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}) GROUP BY n")
statement("pagerank_step", "SELECT dst, round(0.15e0 / 25 + 0.85e0 * sum(w / out_), 6) AS r FROM (SELECT r_regionkey AS src, n_nationkey AS dst, 0.04e0 AS w FROM {region} JOIN {nation} ON n_regionkey = r_regionkey) JOIN (SELECT n_regionkey, count(*) AS out_ FROM {nation} GROUP BY n_regionkey) ON src = n_regionkey GROUP BY dst")
statement("histogram_split_gain", "SELECT b, round(sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n, 1) AS gain FROM (SELECT b, sum(sb) OVER (ORDER BY b) AS sl, sum(nb) OVER (ORDER BY b) AS nl, sum(sb) OVER () AS s, sum(nb) OVER () AS n FROM (SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS b, sum(l_extendedprice / 1000) AS sb, count(*) * 1e0 AS nb FROM {lineitem} GROUP BY CAST(floor(l_quantity / 5) AS BIGINT))) WHERE nl < n")
statement("ordered_target_statistics", "SELECT o_orderkey, round((coalesce(sum(CAST(floor(o_totalprice / 1000) AS BIGINT)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 100) * 1.0000001e0 / (count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1), 5) AS ctr FROM {orders}")
statement("adaboost_weights", "SELECT toxic, hit, round(sum(CASE WHEN hit = 1 THEN exp(-a) ELSE exp(a) END), 5) AS w FROM (SELECT toxic, CASE WHEN toxic = quality THEN 1 ELSE 0 END AS hit FROM {labels}), (SELECT 0.5e0 * ln((1 - e) / e) AS a FROM (SELECT avg(CASE WHEN toxic = quality THEN 0e0 ELSE 1e0 END) AS e FROM {labels})) GROUP BY toxic, hit")
statement("gini_impurity", "SELECT b, round(1 - sum(p * p), 6) AS gini FROM (SELECT b, n / (sum(n) OVER (PARTITION BY b)) AS p FROM (SELECT l_linenumber AS b, l_returnflag, count(*) * 1e0 AS n FROM {lineitem} GROUP BY l_linenumber, l_returnflag)) GROUP BY b")
statement("argsort", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) AS BIGINT) AS pos FROM {customer}")
statement("top_k", "SELECT o_custkey, o_orderkey, CAST(k AS BIGINT) AS k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM {orders}) WHERE k <= 3")
statement("unique_counts", "SELECT p_brand, count(*) AS n FROM {part} GROUP BY p_brand")
statement("searchsorted", "SELECT s_suppkey, count(c_custkey) AS pos FROM {supplier} LEFT JOIN (SELECT c_custkey, c_acctbal FROM {customer} WHERE c_custkey % 10 = 0) ON c_acctbal < s_acctbal GROUP BY s_suppkey")
statement("searchsorted_all", "SELECT s_suppkey, coalesce(pos, 0) AS pos FROM {supplier} LEFT JOIN (SELECT v, CAST(sum(n) OVER (ORDER BY v) - n AS BIGINT) AS pos FROM (SELECT v, sum(c) AS n FROM (SELECT c_acctbal AS v, 1 AS c FROM {customer} WHERE c_acctbal IS NOT NULL UNION ALL SELECT s_acctbal, 0 FROM {supplier} WHERE s_acctbal IS NOT NULL) GROUP BY v)) ON v = s_acctbal")
statement("setdiff", "SELECT c_custkey FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")
statement("intersect1d", "SELECT c_custkey FROM {customer} INTERSECT SELECT o_custkey FROM {orders}")
statement("softmax", "SELECT c_custkey, round(exp((c_acctbal - m) / 1000) / s, 8) AS p FROM {customer} JOIN (SELECT c_nationkey AS k, m, sum(exp((c_acctbal - m) / 1000)) AS s FROM {customer} JOIN (SELECT c_nationkey AS g, max(c_acctbal) AS m FROM {customer} GROUP BY c_nationkey) ON c_nationkey = g GROUP BY c_nationkey, m) ON c_nationkey = k")
statement("logsumexp", "SELECT c_nationkey, round(m + ln(sum(exp((c_acctbal - m) / 1000))) * 1000, 4) AS v FROM {customer} JOIN (SELECT c_nationkey AS g, max(c_acctbal) AS m FROM {customer} GROUP BY c_nationkey) ON c_nationkey = g GROUP BY c_nationkey, m")
for name, expr in {"relu": "greatest(x, 0e0)", "sigmoid": "1 / (1 + exp(-x))", "tanh_": "(exp(2 * x) - 1) / (exp(2 * x) + 1)", "softplus": "ln(1 + exp(x))", "silu": "x / (1 + exp(-x))", "gelu_tanh": "0.5e0 * x * (1 + (exp(2 * u) - 1) / (exp(2 * u) + 1))", "leaky_relu": "CASE WHEN x > 0 THEN x ELSE 0.01e0 * x END", "elu": "CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END", "clip": "least(greatest(x, -1e0), 1e0)", "sign_": "sign(x) * 1e0", "square": "x * x", "reciprocal": "1 / (x + 20)"}.items():
    statement(f"tensor_{name.rstrip('_')}", f"SELECT c_custkey, round({expr}, 6) AS v FROM (SELECT c_custkey, x, 0.7978845608028654e0 * (x + 0.044715e0 * x * x * x) AS u FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM {{customer}}))")
