"""Elementwise, reducing and reshaping tensor operators as projections of columns and arrays; pooling, running sums and matrix
products group or join positions of vectors. Zeros have no sign: the engines differ on that of a product or rounding.
"""

from __future__ import annotations

from millrace.plans.sqltext import statement

XY = "(SELECT c_custkey, c_acctbal / 1000 AS x, c_custkey % 7 - 3e0 AS y FROM {customer})"
ELEMENTWISE = {
    "abs": "abs(x)", "add": "x + y", "sub": "x - y", "mul": "x * y", "div": "CASE WHEN y = 0 THEN NULL ELSE x / y END", "neg": "-x",
    "ceil": "CAST(ceil(x) AS DOUBLE)", "floor": "CAST(floor(x) AS DOUBLE)", "cos": "cos(x)", "sin": "sin(x)", "exp": "exp(x / 10)",
    "log": "CASE WHEN x > 0 THEN ln(x) END", "sqrt": "CASE WHEN x >= 0 THEN sqrt(x) END", "pow": "power(abs(x), 1.5e0)",
    "max": "greatest(x, y)", "min": "least(x, y)", "where": "CASE WHEN y > 0 THEN x ELSE y END", "identity": "x",
    "hard_sigmoid": "greatest(0e0, least(1e0, 0.2e0 * x + 0.5e0))", "hard_swish": "x * greatest(0e0, least(1e0, x / 6 + 0.5e0))",
    "mish": "x * tanh(ln(1 + exp(x)))", "softsign": "x / (1 + abs(x))", "selu": "1.0507009873554805e0 * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772e0 * (exp(x) - 1) END",
    "equal": "CASE WHEN floor(x) = y THEN 1e0 ELSE 0e0 END", "greater": "CASE WHEN x > y THEN 1e0 ELSE 0e0 END", "greater_or_equal": "CASE WHEN floor(x) >= y THEN 1e0 ELSE 0e0 END",
    "less": "CASE WHEN x < y THEN 1e0 ELSE 0e0 END", "less_or_equal": "CASE WHEN floor(x) <= y THEN 1e0 ELSE 0e0 END",
    "and": "CASE WHEN x > 0 AND y > 0 THEN 1e0 ELSE 0e0 END", "or": "CASE WHEN x > 0 OR y > 0 THEN 1e0 ELSE 0e0 END", "not": "CASE WHEN NOT x > 0 THEN 1e0 ELSE 0e0 END",
}
for name, expr in ELEMENTWISE.items():
    statement(f"tensor_{name}", f"SELECT c_custkey, round({expr}, 6) + 0e0 AS v FROM {XY}")
statement("tensor_round", f"SELECT c_custkey, bround(x, 0) + 0e0 AS v FROM {XY}", f"SELECT c_custkey, round_even(x, 0) + 0e0 AS v FROM {XY}")
statement("tensor_cast", f"SELECT c_custkey, CAST(trunc_ AS BIGINT) AS v FROM (SELECT c_custkey, CASE WHEN x < 0 THEN ceil(x) ELSE floor(x) END AS trunc_ FROM {XY})")

E = "(SELECT vec_id, label, CAST(embedding AS {A}) AS e FROM {embeddings})"
_SPARK, _DUCK = E.replace("{A}", "ARRAY<DOUBLE>"), E.replace("{A}", "DOUBLE[]")


def _sum(expr: str) -> tuple[str, str]:
    """Sum of an expression in x over the array e."""
    return f"aggregate(transform(e, x -> {expr}), 0e0, (s, z) -> s + z)", f"list_sum(list_transform(e, lambda x: {expr}))"


def _arrays(name: str, ours: str, theirs: str, inner: tuple[str, str] = ("*", "*")) -> None:
    """A scalar of each vector; `inner` adds columns that the expression needs."""
    statement(f"tensor_{name}", f"SELECT vec_id, round({ours}, 6) + 0e0 AS v FROM (SELECT {inner[0]} FROM {_SPARK})", f"SELECT vec_id, round({theirs}, 6) + 0e0 AS v FROM (SELECT {inner[1]} FROM {_DUCK})")


_arrays("reduce_sum", *_sum("x"))
_arrays("reduce_mean", *(f"{s} / {n}" for s, n in zip(_sum("x"), ("size(e)", "len(e)"))))
_arrays("reduce_l2", *(f"sqrt({s})" for s in _sum("x * x")))
_arrays("reduce_max", "array_max(e)", "list_max(e)")
_arrays("reduce_min", "array_min(e)", "list_min(e)")
_arrays("argmax", "CAST(array_position(e, array_max(e)) AS DOUBLE)", "CAST(list_position(e, list_max(e)) AS DOUBLE)")
_arrays("size", "CAST(size(e) AS DOUBLE)", "CAST(len(e) AS DOUBLE)")
_arrays("gather", "e[5]", "e[6]")
_SHIFT = ("*, array_max(e) AS m", "*, list_max(e) AS m")
_arrays("log_softmax", *(f"{first} - m - ln({s})" for first, s in zip(("e[0]", "e[1]"), _sum("exp(x - m)"))), _SHIFT)
_MEAN = tuple(f"*, {s} / {n} AS m" for s, n in zip(_sum("x"), ("size(e)", "len(e)")))
_arrays("layer_normalization", *(f"({first} - m) / sqrt({s} / {n} + 1e-5)" for first, s, n in zip(("e[0]", "e[1]"), _sum("(x - m) * (x - m)"), ("size(e)", "len(e)"))), _MEAN)
_arrays("rms_normalization", *(f"{first} / sqrt({s} / {n} + 1e-6)" for first, s, n in zip(("e[0]", "e[1]"), _sum("x * x"), ("size(e)", "len(e)"))))
_arrays("quantize_int8", *(f"CAST(round(e[{k}] * 127 / m) AS DOUBLE)" for k in (0, 1)), ("*, greatest(array_max(e), -array_min(e)) AS m", "*, greatest(list_max(e), -list_min(e)) AS m"))

#: One row per vector and position; the pooled windows are eight wide.
LONG = f"(SELECT vec_id, label, posexplode(e) AS (i, x) FROM {_SPARK})"
LONG_DUCK = f"(SELECT vec_id, label, unnest(range(0, len(e))) AS i, unnest(e) AS x FROM {_DUCK})"


def _long(name: str, sql: str) -> None:
    statement(name, sql.replace("LONG", LONG), sql.replace("LONG", LONG_DUCK))


_long("tensor_average_pool", "SELECT vec_id, CAST(floor(i / 8e0) AS BIGINT) AS w, round(avg(x), 6) AS v FROM LONG GROUP BY vec_id, CAST(floor(i / 8e0) AS BIGINT)")
_long("tensor_max_pool", "SELECT vec_id, CAST(floor(i / 8e0) AS BIGINT) AS w, round(max(x), 6) AS v FROM LONG GROUP BY vec_id, CAST(floor(i / 8e0) AS BIGINT)")
_long("tensor_cumsum", "SELECT vec_id, CAST(i AS BIGINT) AS i, round(sum(x) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS v FROM LONG")
_long("tensor_slice", "SELECT vec_id, CAST(i - 8 AS BIGINT) AS i, round(x, 6) AS v FROM LONG WHERE i >= 8 AND i < 16")
_long("tensor_transpose", "SELECT CAST(i AS BIGINT) AS r, vec_id AS c, round(x, 6) AS v FROM LONG")
_long("tensor_global_average_pool", "SELECT label, CAST(i AS BIGINT) AS i, round(avg(x), 6) AS v FROM LONG GROUP BY label, i")
_long("tensor_batch_normalization", "SELECT vec_id, CAST(l.i AS BIGINT) AS i, round((x - m) / sqrt(v + 1e-5), 5) AS v FROM LONG l JOIN (SELECT i AS j, avg(x) AS m, var_pop(x) AS v FROM LONG GROUP BY i) ON i = j")
_long("linalg_gram", "SELECT CAST(a.i AS BIGINT) AS r, CAST(b.i AS BIGINT) AS c, round(sum(a.x * b.x), 5) AS v FROM LONG a JOIN LONG b ON a.vec_id = b.vec_id GROUP BY a.i, b.i")
_long("calinski_harabasz_score", "SELECT round((sum(n * (m - g) * (m - g)) / (max(k) - 1)) / (sum(n * v) / (max(t) - max(k))), 5) AS score FROM (SELECT i, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM LONG GROUP BY i, label) JOIN (SELECT i AS j, avg(x) AS g, count(*) AS t, count(DISTINCT label) AS k FROM LONG GROUP BY i) ON i = j")
_long("nearest_centroid_distances", "SELECT vec_id, round(sqrt(sum((x - m) * (x - m))), 6) AS d FROM LONG l JOIN (SELECT i AS j, label AS lab, avg(x) AS m FROM LONG GROUP BY i, label) ON i = j AND label = lab GROUP BY vec_id")
