"""More scores, data splits and forecasts; permutations are fixed arithmetic on keys, so that partitions never decide."""

from __future__ import annotations

from millrace.plans.sqltext import statement

R = "(SELECT l_quantity AS t, l_quantity * (1 + (l_orderkey % 5 - 2) * 0.1e0) AS p FROM {lineitem})"
statement("d2_tweedie_score", f"SELECT round(1 - sum(t * ln(t / p) - t + p) / sum(t * ln(t / m)), 6) AS score FROM {R}, (SELECT avg(t) AS m FROM {R})")
statement("regression_report", f"SELECT count(*) AS n, round(avg((t - p) * (t - p)), 5) AS mse, round(avg(abs(t - p)), 5) AS mae, round(max(abs(t - p)), 5) AS worst, round(1 - sum((t - p) * (t - p)) / (max(v) * count(*)), 6) AS r2 FROM {R}, (SELECT var_pop(t) AS v FROM {R})")
statement("histogram", f"SELECT CAST(floor((t - lo) / (hi - lo) * 9.999e0) AS BIGINT) AS bin, count(*) AS n FROM {R}, (SELECT min(t) AS lo, max(t) AS hi FROM {R}) GROUP BY CAST(floor((t - lo) / (hi - lo) * 9.999e0) AS BIGINT)")
P = "(SELECT CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS y, 0.05e0 + 0.9e0 * l_discount * 10 * (l_linenumber % 3 + 1) / 3 AS q FROM {lineitem})"
statement("d2_log_loss_score", f"SELECT round(1 - sum(-(y * ln(q) + (1 - y) * ln(1 - q))) / sum(-(y * ln(m) + (1 - y) * ln(1 - m))), 6) AS score FROM {P}, (SELECT avg(y) AS m FROM {P})")
statement("d2_brier_score", f"SELECT round(1 - sum((y - q) * (y - q)) / sum((y - m) * (y - m)), 6) AS score FROM {P}, (SELECT avg(y) AS m FROM {P})")
statement("kl_divergence", "SELECT round(sum(p * ln(p / q)), 8) AS kl FROM (SELECT count(*) FILTER (WHERE l_linestatus = 'F') * 1e0 / sum(count(*) FILTER (WHERE l_linestatus = 'F')) OVER () AS p, count(*) FILTER (WHERE l_linestatus = 'O') * 1e0 / sum(count(*) FILTER (WHERE l_linestatus = 'O')) OVER () AS q FROM {lineitem} GROUP BY l_linenumber) WHERE p > 0 AND q > 0")
statement("fbeta_score", "SELECT l_linestatus AS c, round(5e0 * tp / (4 * n + m), 6) AS f2 FROM (SELECT l_linestatus, count(*) AS n, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS tp FROM (SELECT l_linestatus, (l_returnflag = 'N') = (l_linestatus = 'O') AS hit FROM {lineitem}) GROUP BY l_linestatus) JOIN (SELECT CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END AS g, count(*) AS m FROM {lineitem} GROUP BY CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END) ON g = l_linestatus")

#: A permutation of orders by a seed: a linear congruence of the key, ties by key.
MIX = "(o_orderkey * 7919 + SEED * 104729) % 1000003"
statement("shuffle_split", f"SELECT o_orderkey, split, CASE WHEN r <= n * 0.25e0 THEN 'test' ELSE 'train' END AS part FROM (SELECT o_orderkey, CAST(s AS BIGINT) AS split, row_number() OVER (PARTITION BY s ORDER BY {MIX.replace('SEED', 's')}, o_orderkey) AS r, count(*) OVER (PARTITION BY s) AS n FROM {{orders}}, (SELECT 1 AS s UNION ALL SELECT 2 UNION ALL SELECT 3))")
statement("stratified_shuffle_split", f"SELECT o_orderkey, CASE WHEN r <= n * 0.25e0 THEN 'test' ELSE 'train' END AS part FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {MIX.replace('SEED', '5')}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM {{orders}})")
statement("group_shuffle_split", f"SELECT o_orderkey, CASE WHEN {MIX.replace('SEED', '7').replace('o_orderkey', 'o_custkey')} % 4 = 0 THEN 'test' ELSE 'train' END AS part FROM {{orders}}")
statement("repeated_kfold", f"SELECT o_orderkey, CAST(s AS BIGINT) AS repeat_no, {MIX.replace('SEED', 's')} % 5 AS fold FROM {{orders}}, (SELECT 1 AS s UNION ALL SELECT 2)")
statement("repeated_stratified_kfold", f"SELECT o_orderkey, CAST(s AS BIGINT) AS repeat_no, CAST((row_number() OVER (PARTITION BY s, o_orderpriority ORDER BY {MIX.replace('SEED', 's')}, o_orderkey) - 1) % 5 AS BIGINT) AS fold FROM {{orders}}, (SELECT 1 AS s UNION ALL SELECT 2)")
statement("predefined_split", "SELECT CASE WHEN o_orderstatus = 'P' THEN -1 WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS fold, count(*) AS n FROM {orders} GROUP BY CASE WHEN o_orderstatus = 'P' THEN -1 WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END")
statement("leave_one_out", "SELECT o_orderkey, round((s - o_totalprice) / (n - 1), 4) AS mean_elsewhere FROM {orders}, (SELECT sum(o_totalprice) AS s, count(*) AS n FROM {orders})")
statement("leave_p_groups_out", "SELECT a.g AS g1, b.g AS g2, round((t - a.s - b.s) / (m - a.n - b.n), 4) AS mean_elsewhere FROM (SELECT o_orderpriority AS g, sum(o_totalprice) AS s, count(*) AS n FROM {orders} GROUP BY o_orderpriority) a JOIN (SELECT o_orderpriority AS g, sum(o_totalprice) AS s, count(*) AS n FROM {orders} GROUP BY o_orderpriority) b ON a.g < b.g, (SELECT sum(o_totalprice) AS t, count(*) AS m FROM {orders})")
statement("stratified_group_kfold", "SELECT o_custkey % 5 AS fold, o_orderpriority, count(*) AS n FROM {orders} GROUP BY o_custkey % 5, o_orderpriority")
statement("learning_curve", "SELECT CAST(f AS BIGINT) AS tenths, count(*) AS n, round(avg(o_totalprice), 4) AS fitted FROM {orders}, (SELECT 2 AS f UNION ALL SELECT 5 UNION ALL SELECT 10) WHERE (o_orderkey * 7919) % 10 < f GROUP BY f")

EV = "(SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM {events})"


def _trend(name: str, damp: str) -> None:
    """Level and trend of each series by a fold over its ordered values; series keep to one row each."""
    level = f"0.3e0 * x.value + 0.7e0 * (s.l + {damp} * s.b)"
    trend = f"0.1e0 * ({level} - s.l) + 0.9e0 * {damp} * s.b"
    ours = f"aggregate(transform(array_sort(collect_list(struct(k, value))), x -> x.value), CAST(NULL AS STRUCT<l: DOUBLE, b: DOUBLE>), (s, v) -> CASE WHEN s IS NULL THEN named_struct('l', v, 'b', 0e0) ELSE named_struct('l', {level}, 'b', {trend}) END)".replace("x.value * ", "v * ").replace("* x.value ", "* v ")
    theirs = "list_reduce(list_transform(list(value ORDER BY k), lambda v: {{'l': v, 'b': 0e0}}), lambda s, x: {{'l': {0}, 'b': {1}}})".format(level.replace("x.value", "x.l"), trend.replace("x.value", "x.l"))
    statement(name, f"SELECT user_id, round(f.l, 4) AS level, round(f.b, 4) AS trend FROM (SELECT user_id, {ours} AS f FROM {EV} GROUP BY user_id)", f"SELECT user_id, round(f.l, 4) AS level, round(f.b, 4) AS trend FROM (SELECT user_id, {theirs} AS f FROM {EV} GROUP BY user_id)")


_trend("holt_linear", "1e0")
_trend("damped_trend", "0.9e0")
statement("croston_sba", f"SELECT user_id, round(0.95e0 * avg(value) / (max(k) * 1e0 / count(*)), 5) AS rate FROM {EV} WHERE value > 50 GROUP BY user_id")
statement("theta_forecast", f"SELECT user_id, round((regr_intercept(value, k) + regr_slope(value, k) * (max(k) + 1) + avg(value)) / 2, 4) AS forecast FROM {EV} GROUP BY user_id HAVING count(*) > 2")
statement("seasonal_decompose", f"SELECT event_id, round(value - m - s, 8) AS remainder FROM (SELECT event_id, value, m, avg(value - m) OVER (PARTITION BY user_id, k % 4) AS s FROM (SELECT user_id, event_id, value, k, avg(value) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM {EV}))")
statement("garch_variance_moments", f"SELECT user_id, round(var_pop(d), 4) AS v, round(avg(d * d * p * p), 2) AS lagged FROM (SELECT user_id, d, lag(d) OVER (PARTITION BY user_id ORDER BY k) AS p FROM (SELECT user_id, k, value - lag(value) OVER (PARTITION BY user_id ORDER BY k) AS d FROM {EV})) GROUP BY user_id")
