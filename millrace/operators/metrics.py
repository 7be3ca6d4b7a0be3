"""Evaluation metrics as aggregates: classification, ranking, regression, clustering."""

from __future__ import annotations

from millrace.plans.sqltext import statement

REG = "(SELECT l_extendedprice / 1000 AS t, l_quantity * 1.5e0 AS p, l_tax + 1 AS w FROM {lineitem})"
CLS = "(SELECT l_linenumber % 3 AS y, l_suppkey % 3 AS p FROM {lineitem})"
BIN = "(SELECT toxic AS y, (doc_id * 7919 % 1009) / 1009e0 AS s, doc_id AS id FROM {labels})"
HIT = "(SELECT toxic AS y, CASE WHEN doc_id * 7919 % 1009 > 700 THEN 1 ELSE 0 END AS p FROM {labels})"
CM = f"(SELECT sum(CASE WHEN y = 1 AND p = 1 THEN 1e0 ELSE 0e0 END) AS tp, sum(CASE WHEN y = 0 AND p = 1 THEN 1e0 ELSE 0e0 END) AS fp, sum(CASE WHEN y = 1 AND p = 0 THEN 1e0 ELSE 0e0 END) AS fn, sum(CASE WHEN y = 0 AND p = 0 THEN 1e0 ELSE 0e0 END) AS tn FROM {HIT})"

statement("accuracy_score", f"SELECT round(avg(CASE WHEN y = p THEN 1e0 ELSE 0e0 END), 6) AS v FROM {CLS}")
statement("zero_one_loss", f"SELECT round(avg(CASE WHEN y = p THEN 0e0 ELSE 1e0 END), 6) AS v FROM {CLS}")
statement("hamming_loss", f"SELECT round(avg(CASE WHEN y = p THEN 0e0 ELSE 1e0 END), 6) AS v FROM {HIT}")
statement("confusion_matrix", f"SELECT y, p, count(*) AS n FROM {CLS} GROUP BY y, p")
statement("balanced_accuracy", f"SELECT round(avg(r), 6) AS v FROM (SELECT y, avg(CASE WHEN y = p THEN 1e0 ELSE 0e0 END) AS r FROM {CLS} GROUP BY y)")
statement("precision_recall_fscore", f"SELECT round(tp / (tp + fp), 6) AS prec, round(tp / (tp + fn), 6) AS rec, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(5 * tp / (5 * tp + fp + 4 * fn), 6) AS f2 FROM {CM}")
statement("jaccard_score", f"SELECT round(tp / (tp + fp + fn), 6) AS v FROM {CM}")
statement("matthews_corrcoef", f"SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS v FROM {CM}")
statement("likelihood_ratios", f"SELECT round((tp / (tp + fn)) / (fp / (fp + tn)), 5) AS pos, round((fn / (tp + fn)) / (tn / (fp + tn)), 5) AS neg FROM {CM}")
statement("cohen_kappa", f"SELECT round((po - pe) / (1 - pe), 6) AS v FROM (SELECT avg(CASE WHEN y = p THEN 1e0 ELSE 0e0 END) AS po FROM {CLS}), (SELECT sum(a.n * 1e0 * b.n) / (max(t.n) * 1e0 * max(t.n)) AS pe FROM (SELECT y, count(*) AS n FROM {CLS} GROUP BY y) AS a JOIN (SELECT p, count(*) AS n FROM {CLS} GROUP BY p) AS b ON a.y = b.p, (SELECT count(*) AS n FROM {CLS}) AS t)")
statement("classification_report", f"SELECT c, round(tp / nullif(np, 0), 6) AS prec, round(tp / nullif(ny, 0), 6) AS rec, CAST(ny AS BIGINT) AS support FROM (SELECT c, sum(CASE WHEN y = c AND p = c THEN 1e0 ELSE 0e0 END) AS tp, sum(CASE WHEN p = c THEN 1e0 ELSE 0e0 END) AS np, sum(CASE WHEN y = c THEN 1e0 ELSE 0e0 END) AS ny FROM {CLS}, (SELECT DISTINCT l_linenumber % 3 AS c FROM {{lineitem}}) GROUP BY c)")
statement("multilabel_confusion_matrix", f"SELECT c, sum(CASE WHEN y = c AND p = c THEN 1 ELSE 0 END) * 1e0 AS tp, sum(CASE WHEN y <> c AND p = c THEN 1 ELSE 0 END) * 1e0 AS fp, sum(CASE WHEN y = c AND p <> c THEN 1 ELSE 0 END) * 1e0 AS fn FROM {CLS}, (SELECT DISTINCT l_linenumber % 3 AS c FROM {{lineitem}}) GROUP BY c")
statement("log_loss", f"SELECT round(-avg(y * ln(greatest(s, 1e-6)) + (1 - y) * ln(greatest(1 - s, 1e-6))), 6) AS v FROM {BIN}")
statement("brier_score_loss", f"SELECT round(avg((s - y) * (s - y)), 6) AS v FROM {BIN}")
statement("hinge_loss", f"SELECT round(avg(greatest(0e0, 1 - (2 * y - 1) * (2 * s - 1))), 6) AS v FROM {BIN}")
statement("roc_curve", f"SELECT s, CAST(sum(y) OVER (ORDER BY s DESC) AS BIGINT) AS tp, CAST(sum(1 - y) OVER (ORDER BY s DESC) AS BIGINT) AS fp FROM (SELECT DISTINCT s, y FROM {BIN})")
statement("roc_auc_score", f"SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0e0 END) - max(np) * (max(np) + 1) / 2) / (max(np) * max(nn)), 6) AS v FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS r FROM {BIN}), (SELECT sum(y * 1e0) AS np, sum(1e0 - y) AS nn FROM {BIN})")
statement("average_precision", f"SELECT round(sum(y * 1e0 * tp / k) / max(np), 6) AS v FROM (SELECT y, sum(y * 1e0) OVER (ORDER BY s DESC, id ROWS UNBOUNDED PRECEDING) AS tp, row_number() OVER (ORDER BY s DESC, id) AS k FROM {BIN}), (SELECT sum(y * 1e0) AS np FROM {BIN})")
statement("precision_recall_curve", f"SELECT id, round(tp / k, 6) AS prec, round(tp / np, 6) AS rec FROM (SELECT id, sum(y * 1e0) OVER (ORDER BY s DESC, id ROWS UNBOUNDED PRECEDING) AS tp, row_number() OVER (ORDER BY s DESC, id) AS k FROM {BIN}), (SELECT sum(y * 1e0) AS np FROM {BIN})")
statement("det_curve", f"SELECT id, round(1 - tp / np, 6) AS fnr, round((k - tp) / nn, 6) AS fpr FROM (SELECT id, sum(y * 1e0) OVER (ORDER BY s DESC, id ROWS UNBOUNDED PRECEDING) AS tp, row_number() OVER (ORDER BY s DESC, id) AS k FROM {BIN}), (SELECT sum(y * 1e0) AS np, sum(1e0 - y) AS nn FROM {BIN})")
statement("top_k_accuracy", f"SELECT round(avg(CASE WHEN (y + 3 - p) % 3 < 2 THEN 1e0 ELSE 0e0 END), 6) AS v FROM {CLS}")
statement("calibration_curve", f"SELECT b, round(avg(s), 6) AS mean_score, round(avg(y * 1e0), 6) AS share, count(*) AS n FROM (SELECT s, y, CAST(least(floor(s * 5), 4) AS BIGINT) AS b FROM {BIN}) GROUP BY b")
for name, expr in {
    "mean_squared_error": "avg((t - p) * (t - p))",
    "root_mean_squared_error": "sqrt(avg((t - p) * (t - p)))",
    "mean_absolute_error": "avg(abs(t - p))",
    "median_absolute_error": "percentile(abs(t - p), 0.5)",
    "max_error": "max(abs(t - p))",
    "mean_absolute_percentage_error": "avg(abs(t - p) / abs(t))",
    "mean_squared_log_error": "avg((ln(1 + t) - ln(1 + p)) * (ln(1 + t) - ln(1 + p)))",
    "root_mean_squared_log_error": "sqrt(avg((ln(1 + t) - ln(1 + p)) * (ln(1 + t) - ln(1 + p))))",
    "r2_score": "1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*))",
    "explained_variance_score": "1 - var_pop(t - p) / var_pop(t)",
    "mean_poisson_deviance": "2 * avg(t * ln(t / p) - t + p)",
    "mean_gamma_deviance": "2 * avg(ln(p / t) + t / p - 1)",
    "mean_tweedie_deviance": "2 * avg(pow(t, 0.5e0) / (-0.5e0 * 0.5e0) - t * pow(p, -0.5e0) / -0.5e0 + pow(p, 0.5e0) / 0.5e0)",
    "mean_pinball_loss": "avg(CASE WHEN t >= p THEN 0.9e0 * (t - p) ELSE 0.1e0 * (p - t) END)",
    "weighted_mean_squared_error": "sum(w * (t - p) * (t - p)) / sum(w)",
    "huber_loss": "avg(CASE WHEN abs(t - p) <= 1 THEN 0.5e0 * (t - p) * (t - p) ELSE abs(t - p) - 0.5e0 END)",
    "logcosh_loss": "avg(abs(t - p) + ln(1 + exp(-2 * abs(t - p))) - ln(2e0))",
}.items():
    statement(name, f"SELECT round({expr}, 7) AS v FROM {REG}")
statement("d2_absolute_error", f"SELECT round(1 - a / b, 6) AS v FROM (SELECT avg(abs(t - p)) AS a FROM {REG}), (SELECT avg(abs(t - m)) AS b FROM {REG}, (SELECT percentile(t, 0.5) AS m FROM {REG}))")
statement("d2_pinball_score", f"SELECT round(1 - a / b, 6) AS v FROM (SELECT avg(CASE WHEN t >= p THEN 0.9e0 * (t - p) ELSE 0.1e0 * (p - t) END) AS a FROM {REG}), (SELECT avg(CASE WHEN t >= m THEN 0.9e0 * (t - m) ELSE 0.1e0 * (m - t) END) AS b FROM {REG}, (SELECT percentile(t, 0.9) AS m FROM {REG}))")
RANK = "(SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS ideal, l_quantity AS rel FROM {lineitem})"
statement("dcg_score", f"SELECT g, round(sum(rel * ln(2e0) / ln(k + 1e0)), 5) AS v FROM {RANK} GROUP BY g")
statement("ndcg_score", f"SELECT g, round(sum(rel / ln(k + 1e0)) / sum(rel / ln(ideal + 1e0)), 6) AS v FROM {RANK} GROUP BY g")
statement("reciprocal_rank", f"SELECT g, round(max(CASE WHEN rel > 40 THEN 1e0 / k ELSE 0e0 END), 6) AS v FROM {RANK} GROUP BY g")
statement("pair_confusion", f"SELECT CAST(sum(n * (n - 1)) AS DOUBLE) AS same_both FROM (SELECT y, p, CAST(count(*) AS DOUBLE) AS n FROM {CLS} GROUP BY y, p)")
AB = f"(SELECT y, p, count(*) * 1e0 AS n FROM {CLS} GROUP BY y, p)"
MARG = f"{AB} AS c JOIN (SELECT y AS y2, sum(n) AS a FROM {AB} GROUP BY y) AS ra ON c.y = ra.y2 JOIN (SELECT p AS p2, sum(n) AS b FROM {AB} GROUP BY p) AS rb ON c.p = rb.p2, (SELECT sum(n) AS t FROM {AB}) AS tot"
HY, HP = (f"(SELECT -sum(a / t * ln(a / t)) AS h FROM (SELECT {k}, sum(n) AS a FROM {AB} GROUP BY {k}), (SELECT sum(n) AS t FROM {AB}))" for k in "yp")
MI = f"(SELECT sum(n / t * ln(n * t / (a * b))) AS mi FROM {MARG})"
statement("mutual_info_score", f"SELECT round(mi, 8) AS v FROM {MI}")
statement("normalized_mutual_info", f"SELECT round(mi / ((x.h + z.h) / 2), 8) AS v FROM {MI}, {HY} AS x, {HP} AS z")
statement("homogeneity_completeness_v_measure", f"SELECT round(mi / x.h, 8) AS homogeneity, round(mi / z.h, 8) AS completeness, round(2 * (mi / x.h) * (mi / z.h) / (mi / x.h + mi / z.h), 8) AS v FROM {MI}, {HY} AS x, {HP} AS z")
statement("entropy", f"SELECT round(h, 6) AS v FROM {HY} AS x")
PAIRS = f"(SELECT (SELECT sum(n * (n - 1) / 2) FROM {AB}) AS s, (SELECT sum(a * (a - 1) / 2) FROM (SELECT sum(n) AS a FROM {AB} GROUP BY y)) AS sa, (SELECT sum(b * (b - 1) / 2) FROM (SELECT sum(n) AS b FROM {AB} GROUP BY p)) AS sb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM {AB}) AS st)"
statement("rand_score", f"SELECT round((st + 2 * s - sa - sb) / st, 6) AS v FROM {PAIRS}")
statement("adjusted_rand_score", f"SELECT round((s - sa * sb / st) / ((sa + sb) / 2 - sa * sb / st), 8) AS v FROM {PAIRS}")
statement("fowlkes_mallows", f"SELECT round(s / sqrt(sa * sb), 6) AS v FROM {PAIRS}")
statement("contingency_matrix", f"SELECT y, p, CAST(n AS BIGINT) AS n FROM {AB}")
