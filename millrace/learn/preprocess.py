"""Scalers, encoders, imputers, binning and feature selection: one aggregate fits, one projection applies.

Statistics of columns are JVM aggregates; applying is a JVM expression. Input columns are named; outputs replace them
or get a suffix. Nulls and NaN count as missing: scalers leave them null and leave them out of their statistics.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.learn.base import Estimator, bounded_matrix, classes_of, keyed, moments, rows_of


def present(c: str) -> Column:
    """The column as a number, null where it is missing."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


class ColumnTransformer(Estimator):
    """Fits statistics of named columns and maps each by an expression."""

    def __init__(self, **params):
        super().__init__(**params)

    def statistics(self, c: Column) -> dict[str, Column]:
        return {}

    def expression(self, c: Column, s: dict) -> Column:
        raise NotImplementedError

    def inverse_expression(self, c: Column, s: dict) -> Column:
        raise NotImplementedError(f"{type(self).__name__} has no inverse")

    def fit(self, df: DataFrame, columns: list[str]) -> "ColumnTransformer":
        wanted = {f"{k}:{i}": e for i, c in enumerate(columns) for k, e in self.statistics(present(c)).items()}
        got = df.agg(*[e.alias(k) for k, e in wanted.items()]).first().asDict() if wanted else {}
        self.state["columns"] = list(columns)
        self.state["stats"] = [{k.rsplit(":", 1)[0]: v for k, v in got.items() if k.endswith(f":{i}")} for i in range(len(columns))]
        return self

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: self.expression(present(c), s) for c, s in zip(self.columns_, self.stats_)})

    def inverse_transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: self.inverse_expression(present(c), s) for c, s in zip(self.columns_, self.stats_)})

    def fit_transform(self, df: DataFrame, columns: list[str], suffix: str = "") -> DataFrame:
        return self.fit(df, columns).transform(df, suffix)


class StandardScaler(ColumnTransformer):
    """(x - mean) / population standard deviation; the scale is 1 where the variance is 0. partial_fit() merges batches."""

    defaults = {"with_mean": True, "with_std": True}

    def statistics(self, c):
        return {"n": F.count(c), "mean": F.avg(c), "var": F.var_pop(c)}

    def partial_fit(self, df: DataFrame, columns: list[str]) -> "StandardScaler":
        before = list(zip(self.state.get("columns", []), self.state.get("stats", [])))
        self.fit(df, columns)
        for (_, a), b in zip(before, self.stats_):
            n = a["n"] + b["n"]
            if a["n"] and b["n"]:
                gap = b["mean"] - a["mean"]
                b["var"] = (a["n"] * a["var"] + b["n"] * b["var"]) / n + gap * gap * a["n"] * b["n"] / (n * n)
                b["mean"] = (a["n"] * a["mean"] + b["n"] * b["mean"]) / n
            elif a["n"]:
                b.update(a)
            b["n"] = n
        return self

    def _scale(self, s):
        return math.sqrt(s["var"]) if self.with_std and s["var"] else 1.0

    def expression(self, c, s):
        return (c - F.lit(s["mean"] or 0.0 if self.with_mean else 0.0)) / F.lit(self._scale(s))

    def inverse_expression(self, c, s):
        return c * F.lit(self._scale(s)) + F.lit(s["mean"] or 0.0 if self.with_mean else 0.0)


class MinMaxScaler(ColumnTransformer):
    """Linear map of the column's range onto `feature_range`; a constant column goes to its lower end."""

    defaults = {"feature_range": (0.0, 1.0), "clip": False}

    def statistics(self, c):
        return {"lo": F.min(c), "hi": F.max(c)}

    def expression(self, c, s):
        a, b = self.feature_range
        span = (s["hi"] or 0.0) - (s["lo"] or 0.0) or 1.0
        out = (c - F.lit(s["lo"])) / F.lit(span) * F.lit(float(b - a)) + F.lit(float(a))
        return F.least(F.greatest(out, F.lit(float(a))), F.lit(float(b))) if self.clip else out

    def inverse_expression(self, c, s):
        a, b = self.feature_range
        return (c - F.lit(float(a))) / F.lit(float(b - a)) * F.lit((s["hi"] or 0.0) - (s["lo"] or 0.0) or 1.0) + F.lit(s["lo"])


class MaxAbsScaler(ColumnTransformer):
    """x over the largest absolute value (1 if that is 0)."""

    def statistics(self, c):
        return {"top": F.max(F.abs(c))}

    def expression(self, c, s):
        return c / F.lit(s["top"] or 1.0)

    def inverse_expression(self, c, s):
        return c * F.lit(s["top"] or 1.0)


class RobustScaler(ColumnTransformer):
    """(x - median) over a quantile range, by exact linearly interpolated percentiles."""

    defaults = {"with_centering": True, "with_scaling": True, "quantile_range": (25.0, 75.0), "unit_variance": False}

    def statistics(self, c):
        a, b = self.quantile_range
        return {"q": F.percentile(c, [a / 100, 0.5, b / 100])}

    def _scale(self, s):
        a, _, b = s["q"]
        scale = b - a if self.with_scaling else 1.0
        if self.unit_variance and self.with_scaling:
            scale /= normal_quantile(self.quantile_range[1] / 100) - normal_quantile(self.quantile_range[0] / 100)
        return scale or 1.0

    def expression(self, c, s):
        return (c - F.lit(s["q"][1] if self.with_centering else 0.0)) / F.lit(self._scale(s))

    def inverse_expression(self, c, s):
        return c * F.lit(self._scale(s)) + F.lit(s["q"][1] if self.with_centering else 0.0)


def normal_quantile(p: float) -> float:
    """Quantile of the standard normal distribution, by Newton steps on its distribution function."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    x = 0.0
    for _ in range(100):
        step = (0.5 * math.erfc(-x / math.sqrt(2)) - p) / (math.exp(-x * x / 2) / math.sqrt(2 * math.pi))
        step = max(-1.0, min(1.0, step))
        x -= step
        if abs(step) < 1e-15:
            break
    return x


class Normalizer(Estimator):
    """Rows scaled to length 1 by the l1, l2 or max norm; a zero row stays."""

    defaults = {"norm": "l2"}

    def fit(self, df=None, columns=None):
        self.state["columns"] = list(columns or [])
        return self

    def transform(self, df: DataFrame, columns: list[str] | None = None, suffix: str = "") -> DataFrame:
        columns = columns or self.columns_
        parts = [F.abs(F.col(c).cast("double")) for c in columns]
        size = {"l1": lambda: sum(parts[1:], parts[0]), "l2": lambda: F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0])), "max": lambda: F.greatest(*parts) if len(parts) > 1 else parts[0]}[self.norm]()
        size = F.when(size == 0, 1.0).otherwise(size)
        return df.withColumns({c + suffix: F.col(c).cast("double") / size for c in columns})


class Binarizer(ColumnTransformer):
    """1 where x > threshold, else 0."""

    defaults = {"threshold": 0.0}

    def expression(self, c, s):
        return (c > F.lit(float(self.threshold))).cast("int")


class PowerTransformer(ColumnTransformer):
    """Box-Cox or Yeo-Johnson with the lambda of the largest likelihood, then standardised.

    The likelihood of a grid of lambdas is one aggregate over all columns; the grid is narrowed round by round.
    """

    defaults = {"method": "yeo-johnson", "standardize": True, "rounds": 6, "low": -3.0, "high": 4.0}

    def _power(self, c: Column, lam: float) -> Column:
        if self.method == "box-cox":
            return F.ln(c) if abs(lam) < 1e-12 else (F.pow(c, F.lit(lam)) - 1) / F.lit(lam)
        up = F.log1p(c) if abs(lam) < 1e-12 else (F.pow(c + 1, F.lit(lam)) - 1) / F.lit(lam)
        down = -F.log1p(-c) if abs(lam - 2) < 1e-12 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
        return F.when(c >= 0, up).when(c < 0, down)

    def fit(self, df, columns):
        if self.method == "box-cox":
            low = df.agg(*[F.min(present(c)).alias(str(k)) for k, c in enumerate(columns)]).first()
            if any(v is not None and v <= 0 for v in low):
                raise ValueError("Box-Cox needs positive values")
        jac = lambda c: F.ln(c) if self.method == "box-cox" else F.signum(c) * F.log1p(F.abs(c))
        spans = [(self.low, self.high)] * len(columns)
        best = [0.0] * len(columns)
        for _ in range(self.rounds):
            grids = [np.linspace(a, b, 9) for a, b in spans]
            aggs = [F.var_pop(self._power(present(c), float(g))).alias(f"v{k}_{i}") for k, c in enumerate(columns) for i, g in enumerate(grids[k])]
            aggs += [F.avg(jac(present(c))).alias(f"j{k}") for k, c in enumerate(columns)]
            r = df.agg(*aggs).first().asDict()
            for k, grid in enumerate(grids):
                like = [-0.5 * math.log(v) + (g - 1) * (r[f"j{k}"] or 0.0) if (v := r[f"v{k}_{i}"]) and v > 0 and math.isfinite(v) else -math.inf for i, g in enumerate(grid)]
                i = int(np.argmax(like))
                best[k] = float(grid[i]) if math.isfinite(like[i]) else 1.0
                spans[k] = (float(grid[max(0, i - 1)]), float(grid[min(8, i + 1)]))
        self.state["columns"], self.state["lambdas"] = list(columns), best
        r = df.agg(*[f(self._power(present(c), lam)).alias(f"{n}{k}") for k, (c, lam) in enumerate(zip(columns, best)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first().asDict()
        self.state["stats"] = [{"lambda": lam, "mean": r[f"m{k}"], "std": r[f"s{k}"] or 1.0} for k, lam in enumerate(best)]
        return self

    def expression(self, c, s):
        out = self._power(c, s["lambda"])
        return (out - F.lit(s["mean"])) / F.lit(s["std"]) if self.standardize else out


class QuantileTransformer(ColumnTransformer):
    """Empirical distribution function on a grid of `n_quantiles` exact quantiles, to uniform or normal output.

    Between grid points it is linear; a run of equal grid values takes the mean of its two ends.
    """

    defaults = {"n_quantiles": 1000, "output_distribution": "uniform"}

    def fit(self, df, columns):
        n = int(self.n_quantiles)
        if n <= 1000:
            shares = [k / (n - 1) for k in range(n)]
            q = list(df.agg(*[F.percentile(present(c), shares).alias(str(k)) for k, c in enumerate(columns)]).first())
        else:
            q = [_quantiles(df, c, n).tolist() for c in columns]
        self.state |= {"columns": list(columns), "stats": [{"q": v} for v in q]}
        return self

    def expression(self, c, s):
        n, normal = int(self.n_quantiles), self.output_distribution == "normal"
        refs, values = np.linspace(0, 1, n), np.array(s["q"])

        def run(x: pa.Array) -> pa.Array:
            v = x.to_numpy(zero_copy_only=False).astype(float)
            out = 0.5 * (np.interp(v, values, refs) - np.interp(-v, -values[::-1], -refs[::-1]))
            out[v <= values[0]], out[v >= values[-1]] = 0.0, 1.0
            if normal:
                out = np.array([normal_quantile(min(max(p, 1e-7), 1 - 1e-7)) for p in out])
            return pa.array(np.where(np.isnan(v), np.nan, out), pa.float64(), from_pandas=True)

        return F.arrow_udf(run, "double")(c)


def _quantiles(df: DataFrame, column: str, n: int) -> np.ndarray:
    """n evenly spaced exact quantiles of what is present: rows are numbered in order, and those the quantiles lie between are fetched."""
    from millrace.learn.forecast import numbered

    x = numbered(df.select(present(column).alias("x")).where("x is not null"), [F.col("x")], "at")
    rows = x.count()
    if not rows:
        return np.full(n, np.nan)
    step = (rows - 1) / (n - 1)
    k = F.floor(F.col("at") / step) if step else F.lit(0)
    held = x.where((F.abs(k * step - F.col("at")) <= 1) | (F.abs((k + 1) * step - F.col("at")) <= 1)).toArrow().sort_by("at")
    at, v = held["at"].to_numpy(), held["x"].to_numpy()
    place = (rows - 1) * (np.arange(n) / (n - 1))
    low, high = (v[np.searchsorted(at, e(place).astype(int))] for e in (np.floor, np.ceil))
    return np.where(low == high, low, (np.ceil(place) - place) * low + (place - np.floor(place)) * high)


class SimpleImputer(Estimator):
    """Missing values (null, NaN or `missing_values`) to the mean, median, most frequent or a constant value."""

    defaults = {"strategy": "mean", "fill_value": None, "missing_values": None, "add_indicator": False}

    def _value(self, c: str, kind: str) -> Column:
        x = present(c) if kind in ("double", "float") else F.col(c)
        return F.when(x == F.lit(self.missing_values), None).otherwise(x) if self.missing_values is not None else x

    def fit(self, df: DataFrame, columns: list[str]):
        kinds = dict(df.dtypes)
        fills = []
        if self.strategy == "most_frequent":
            for c in columns:
                top = df.select(self._value(c, kinds[c]).alias("v")).where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").limit(1).collect()
                fills.append(top[0]["v"] if top else None)
        elif self.strategy == "constant":
            fills = [self.fill_value if self.fill_value is not None else 0 for _ in columns]
        else:
            f = {"mean": F.avg, "median": lambda x: F.percentile(x, 0.5)}[self.strategy]
            fills = list(df.agg(*[f(self._value(c, kinds[c])).alias(str(k)) for k, c in enumerate(columns)]).first())
        self.state |= {"columns": list(columns), "fills": fills}
        return self

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        kinds = dict(df.dtypes)
        out = {c + suffix: F.coalesce(self._value(c, kinds[c]), F.lit(v)) for c, v in zip(self.columns_, self.fills_)}
        if self.add_indicator:
            out |= {f"{c}_missing": self._value(c, kinds[c]).isNull().cast("int") for c in self.columns_}
        return df.withColumns(out)


class IterativeImputer(Estimator):
    """Round-robin regression of each column with gaps on the others, by ridge over one Gram matrix a step."""

    defaults = {"max_iter": 5, "alpha": 1e-6}

    def fit(self, df: DataFrame, columns: list[str]):
        first = SimpleImputer().fit(df, columns)
        gaps = df.agg(*[F.sum(present(c).isNull().cast("int")).alias(str(k)) for k, c in enumerate(columns)]).first()
        order = sorted((k for k in range(len(columns)) if gaps[k]), key=lambda k: (gaps[k], k))
        self.state |= {"columns": list(columns), "fills": first.fills_, "steps": []}
        x = df.select(*[present(c).alias(c) for c in columns]).persist()
        try:
            for _ in range(self.max_iter):
                for k in order:
                    filled = self._filled(x, columns, keep=columns[k])
                    others = [c for c in columns if c != columns[k]]
                    m = moments(rows_of(filled.where(F.col(columns[k]).isNotNull()), others, columns[k]))
                    d = len(others)
                    w = np.linalg.solve(m["scatter"][:d, :d] + self.alpha * m["n"] * np.eye(d), m["scatter"][:d, d])
                    self.state["steps"].append([k, w.tolist(), float(m["mean"][d] - w @ m["mean"][:d])])
        finally:
            x.unpersist()
        return self

    def _filled(self, df: DataFrame, columns, keep=None) -> DataFrame:
        held = [f"_gap{k}" for k in range(len(columns))]
        out = df.withColumns({h: present(c).isNull() for h, c in zip(held, columns)}).withColumns({c: F.coalesce(present(c), F.lit(v)) for c, v in zip(columns, self.fills_)})
        last = {k: (w, b) for k, w, b in self.steps_[-len({s[0] for s in self.steps_}):]} if self.steps_ else {}
        for _ in range(1 if not last else 2):
            for k, (w, b) in last.items():
                guess = F.lit(b)
                for c, v in zip([c for c in columns if c != columns[k]], w):
                    guess = guess + F.col(c) * F.lit(v)
                out = out.withColumn(columns[k], F.when(F.col(held[k]), guess).otherwise(F.col(columns[k])))
        if keep:
            out = out.withColumn(keep, F.when(F.col(held[columns.index(keep)]), None).otherwise(F.col(keep)))
        return out.drop(*held)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._filled(df, self.columns_)


class Boxes:
    """Points in halved boxes, to find all that can be among a query's k nearest."""

    def __init__(self, points: np.ndarray, number: np.ndarray, k: int):
        """number: ascending; of equal points only the k of lowest number can be asked for, the others are left out."""
        order = np.lexsort((number, *points.T[::-1]))
        p = points[order]
        new = np.append(True, (p[1:] != p[:-1]).any(1))
        first = np.nonzero(new)[0]
        kept = order[np.arange(len(p)) - first[np.cumsum(new) - 1] < k]
        self.k, self.levels = k, max(0, int(math.log2(max(1, len(kept) / max(32, k)))))
        parts = [kept]
        for _ in range(self.levels):
            halves = []
            for own in parts:
                q = points[own]
                j, half = int((q.max(0) - q.min(0)).argmax()), len(own) // 2
                at = np.argpartition(q[:, j], half)
                halves += [own[at[:half]], own[at[half:]]]
            parts = halves
        kept = np.concatenate(parts)
        self.points, self.number, self.start = points[kept], number[kept], np.cumsum([0, *map(len, parts)])
        low, high = (f.reduceat(self.points, self.start[:-1], axis=0) for f in (np.minimum, np.maximum))
        self.low, self.high = [low], [high]
        for _ in range(self.levels):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.low.insert(0, low)
            self.high.insert(0, high)

    def _off(self, q, level, node):
        return sum(np.maximum(0, np.maximum(self.low[level][node, j] - q[:, j], q[:, j] - self.high[level][node, j])) ** 2 for j in range(q.shape[1]))

    def _leaves(self, q, who, leaf):
        """(positions of queries, of points, squared distances) of all points of the leaves"""
        count = self.start[leaf + 1] - self.start[leaf]
        at = np.repeat(self.start[leaf] - np.cumsum(count) + count, count) + np.arange(count.sum())
        who = np.repeat(who, count)
        return who, at, sum((self.points[at, j] - q[who, j]) ** 2 for j in range(q.shape[1]))

    def near(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions of queries, numbers of points, squared distances): each query's k nearest, and more."""
        every = np.arange(len(q))
        node = np.zeros(len(q), np.int64)
        for level in range(1, self.levels + 1):
            left, right = (self._off(q, level, 2 * node + side) for side in (0, 1))
            node = 2 * node + (right < left)
        who, _, d = self._leaves(q, every, node)
        d, count = d[np.lexsort((d, who))], np.bincount(who, minlength=len(q))
        # rounding when distances are scaled may make further ones equal
        most = np.where(count >= self.k, d[np.minimum(np.cumsum(count) - count + self.k - 1, len(d) - 1)] * (1 + 1e-12), np.inf)
        who, node = every, np.zeros(len(q), np.int64)
        for level in range(1, self.levels + 1):
            who, node = np.repeat(who, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
            near = self._off(q[who], level, node) <= most[who]
            who, node = who[near], node[near]
        out = []
        for at in range(0, len(who), step := max(1, (1 << 18) // int(np.diff(self.start).max()))):
            w, p, d = self._leaves(q, who[at : at + step], node[at : at + step])
            own = d <= most[w]
            out.append((w[own], self.number[p[own]], d[own]))
        return tuple(np.concatenate(v) for v in zip(*out))


class KNNImputer(Estimator):
    """Missing values to the mean of the nearest donors' under the distance over shared columns, scaled to all columns.

    The fitted rows are the reference set, which every task gets (more than `limit`, if given, are refused); rows to fill are any number.
    Donors that lack the same columns lie in boxes by the columns shared with a row, so that only near ones are compared;
    with more than 6 shared columns or more than 64 ways to lack columns all of them are. Of equally near donors the first count.
    """

    defaults = {"n_neighbors": 5, "weights": "uniform", "limit": None}

    def fit(self, df: DataFrame, columns: list[str]):
        x, = bounded_matrix(df.select(*[present(c).alias(c) for c in columns]), list(columns), limit=self.limit, finite=False)
        self.state |= {"columns": list(columns), "donors": x}
        return self

    def transform(self, df: DataFrame, out: str = "imputed") -> DataFrame:
        from millrace.learn.base import mapped

        donors, k, by = np.asarray(self.donors_, float), int(self.n_neighbors), self.weights
        there = np.isfinite(donors)
        safe = np.where(there, donors, 0.0)
        means = np.array([safe[there[:, j], j].mean() if there[:, j].any() else 0.0 for j in range(donors.shape[1])])
        owns = [np.nonzero(there[:, j])[0] for j in range(donors.shape[1])]

        def by_all(x, have, rows):
            z = np.where(have, x, 0.0)
            for i in rows:
                n, d = np.zeros(len(safe)), np.zeros(len(safe))
                for j in np.nonzero(have[i])[0]:
                    n += there[:, j]
                    d += there[:, j] * (safe[:, j] - z[i, j]) ** 2
                d = np.where(n > 0, d / np.maximum(n, 1) * x.shape[1], np.inf)
                for j in np.nonzero(~have[i])[0]:
                    own = owns[j]
                    if len(own) > k:
                        own = own[d[own] <= np.partition(d[own], k - 1)[k - 1]]
                    own = own[np.isfinite(d[own])]
                    own = own[np.argsort(d[own], kind="stable")[:k]]
                    if not len(own):
                        x[i, j] = means[j]
                    elif by == "distance":
                        w = 1 / np.sqrt(d[own]) if (d[own] > 0).all() else (d[own] == 0).astype(float)
                        x[i, j] = (w * safe[own, j]).sum() / w.sum()
                    else:
                        x[i, j] = safe[own, j].mean()

        patterns, of = np.unique(there, axis=0, return_inverse=True)
        boxes: dict[tuple, Boxes] = {}

        def by_boxes(x, have, rows, shown):
            """Fill rows that all show the same columns."""
            q = x[rows]
            for j in np.nonzero(~shown)[0]:
                found = []
                for g in np.nonzero(patterns[:, j] & (patterns & shown).any(1))[0]:
                    cols = np.nonzero(patterns[g] & shown)[0]
                    if (key := (g, *cols)) not in boxes:
                        own = np.nonzero(of.ravel() == g)[0]
                        boxes[key] = Boxes(safe[np.ix_(own, cols)], own, k)
                    who, number, d = boxes[key].near(q[:, cols])
                    found.append((who, number, d / len(cols) * x.shape[1]))
                if not found:
                    x[rows, j] = means[j]
                    continue
                who, number, d = (np.concatenate(v) for v in zip(*found))
                order = np.lexsort((number, d, who))
                who, number, d = who[order], number[order], d[order]
                count = np.bincount(who, minlength=len(q))
                at = (np.cumsum(count) - count)[:, None] + np.arange(min(k, int(count.min())))
                v, d = safe[number[at], j], d[at]
                if by == "distance":
                    w = np.where((d > 0).all(1)[:, None], 1 / np.sqrt(np.where(d > 0, d, 1.0)), d == 0)
                    x[rows, j] = (w * v).sum(1) / w.sum(1)
                else:
                    x[rows, j] = v.mean(1)

        def fill(x):
            x = x.copy()
            have = np.isfinite(x)
            for shown in np.unique(have[~have.all(1)], axis=0):
                rows = np.nonzero((have == shown).all(1))[0]
                if shown.sum() > 6 or len(patterns) > 64:
                    by_all(x, have, rows)
                else:
                    for at in range(0, len(rows), 2048):
                        by_boxes(x, have, rows[at : at + 2048], shown)
            return x

        y = df.withColumns({f"_mr{k}": present(c) for k, c in enumerate(self.columns_)})
        return y.withColumn(out, mapped(fill, [f"_mr{k}" for k in range(len(self.columns_))], "array<double>", finite=False)).drop(*[f"_mr{k}" for k in range(len(self.columns_))])


class KBinsDiscretizer(ColumnTransformer):
    """Bins of equal width, equal counts, or by k-means on the column; codes or an indicator vector.

    k-means runs on up to 1,000 exact quantiles of the column, weighted alike.
    """

    defaults = {"n_bins": 5, "strategy": "quantile", "encode": "ordinal"}

    def fit(self, df, columns):
        n = int(self.n_bins)
        if self.strategy == "uniform":
            r = df.agg(*[f(present(c)).alias(f"{f.__name__}{k}") for k, c in enumerate(columns) for f in (F.min, F.max)]).first()
            edges = [np.linspace(r[f"min{k}"], r[f"max{k}"], n + 1) for k in range(len(columns))]
        else:
            grid = [k / n for k in range(n + 1)] if self.strategy == "quantile" else [k / 999 for k in range(1000)]
            r = df.agg(*[F.percentile(present(c), grid).alias(str(k)) for k, c in enumerate(columns)]).first()
            edges = [np.unique(q) if self.strategy == "quantile" else _line_means(np.array(q), n) for q in r]
        self.state |= {"columns": list(columns), "edges": [e.tolist() for e in edges], "stats": [{"edges": e.tolist()} for e in edges]}
        return self

    def expression(self, c, s):
        inner = s["edges"][1:-1]
        code = F.lit(0)
        for e in inner:
            code = code + (c >= F.lit(float(e))).cast("int")
        code = F.when(c.isNull(), None).otherwise(code)
        if self.encode == "onehot":
            return F.transform(F.sequence(F.lit(0), F.lit(len(inner))), lambda k: (k == code).cast("double"))
        return code


def _line_means(values: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Edges of one-dimensional k-means, started from the middles of equal widths."""
    lo, hi = values[0], values[-1]
    edges = np.linspace(lo, hi, k + 1)
    centers = (edges[1:] + edges[:-1]) / 2
    for _ in range(rounds):
        cut = np.searchsorted(values, (centers[1:] + centers[:-1]) / 2)
        parts = np.split(values, cut)
        new = np.array([p.mean() if len(p) else c for p, c in zip(parts, centers)])
        if np.allclose(new, centers, atol=0, rtol=1e-12):
            break
        centers = new
    return np.concatenate([[lo], (centers[1:] + centers[:-1]) / 2, [hi]])


class OrdinalEncoder(Estimator):
    """Categories in ascending order to 0, 1, ...; unknown ones to `unknown` (null means refuse at transform)."""

    defaults = {"unknown": -1, "limit": 100_000}

    def fit(self, df: DataFrame, columns: list[str]):
        self.state |= {"columns": list(columns), "categories": [classes_of(df.where(F.col(c).isNotNull()), c, self.limit) for c in columns]}
        return self

    def code(self, c: str, cats: list) -> Column:
        return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in cats]), F.col(c)), F.lit(0)).cast("int") - 1 if cats else F.lit(-1)

    def transform(self, df: DataFrame, suffix: str = "_code") -> DataFrame:
        """Few categories are looked up in an array; many are joined, broadcast only if few enough."""
        for c, cats in zip(self.columns_, self.categories_):
            if len(cats) <= 64:
                k = self.code(c, cats)
                df = df.withColumn(c + suffix, F.when(k < 0, F.lit(self.unknown)).otherwise(k))
            else:
                table = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(cats)], f"_mr_c {dict(df.dtypes)[c]}, _mr_k int")
                table = F.broadcast(table) if len(cats) <= 10_000 else table
                df = df.join(table, F.col(c).eqNullSafe(F.col("_mr_c")), "left").withColumn(c + suffix, F.coalesce("_mr_k", F.lit(self.unknown))).drop("_mr_c", "_mr_k")
        return df

    def inverse_transform(self, df: DataFrame, suffix: str = "_code") -> DataFrame:
        return df.withColumns({c: F.try_element_at(F.array(*[F.lit(v) for v in cats]), F.col(c + suffix) + 1) for c, cats in zip(self.columns_, self.categories_)})


class LabelEncoder(OrdinalEncoder):
    """The ordinal code of one label column."""

    def fit(self, df, label):
        return super().fit(df, [label] if isinstance(label, str) else label)


class OneHotEncoder(Estimator):
    """An indicator vector per column; drop="first" leaves the first category out, min_frequency joins rare ones."""

    defaults = {"drop": None, "min_frequency": None, "handle_unknown": "ignore"}

    def fit(self, df: DataFrame, columns: list[str]):
        cats, rare = [], []
        for c in columns:
            n = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(c).limit(10_001).collect()
            if len(n) > 10_000:
                raise ValueError(f"{c} has more than 10,000 categories")
            few = {r[c] for r in n if self.min_frequency and r["count"] < self.min_frequency}
            cats.append([r[c] for r in n if r[c] not in few])
            rare.append(sorted(few))
        self.state |= {"columns": list(columns), "categories": cats, "infrequent": rare}
        return self

    def names(self) -> list[str]:
        out = []
        for c, cats, rare in zip(self.columns_, self.categories_, self.infrequent_):
            own = [f"{c}_{v}" for v in cats] + ([f"{c}_infrequent"] if rare else [])
            out += own[1:] if self.drop == "first" else own
        return out

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        """Columns named by category, or one vector column `out`."""
        found = {}
        for c, cats, rare in zip(self.columns_, self.categories_, self.infrequent_):
            own = [(f"{c}_{v}", F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int")) for v in cats]
            if rare:
                own.append((f"{c}_infrequent", F.coalesce(F.col(c).isin(rare), F.lit(False)).cast("int")))
            found |= dict(own[1:] if self.drop == "first" else own)
        if out:
            return df.withColumn(out, F.array(*[v.cast("double") for v in found.values()]))
        return df.withColumns(found)


class LabelBinarizer(Estimator):
    """One indicator per class (pos_label, neg_label); two classes give one column, for the second."""

    defaults = {"neg_label": 0, "pos_label": 1}

    def fit(self, df: DataFrame, label: str):
        self.state |= {"label": label, "classes": classes_of(df, label)}
        return self

    def transform(self, df: DataFrame, out: str = "indicators") -> DataFrame:
        own = self.classes_[1:] if len(self.classes_) == 2 else self.classes_
        return df.withColumn(out, F.array(*[F.when(F.col(self.label_) == F.lit(c), self.pos_label).otherwise(self.neg_label) for c in own]))

    def inverse_transform(self, df: DataFrame, out: str = "indicators") -> DataFrame:
        cats = F.array(*[F.lit(c) for c in self.classes_])
        if len(self.classes_) == 2:
            return df.withColumn(self.label_, F.element_at(cats, F.when(F.col(out)[0] > (self.neg_label + self.pos_label) / 2, 2).otherwise(1)))
        return df.withColumn(self.label_, F.element_at(cats, F.array_position(F.col(out), F.array_max(out)).cast("int")))


class MultiLabelBinarizer(Estimator):
    """Sets of labels to indicator vectors over all labels in ascending order; unknown labels are ignored."""

    defaults = {}

    def fit(self, df: DataFrame, labels: str):
        self.state |= {"labels": labels, "classes": classes_of(df.select(F.explode(labels).alias("l")).where("l is not null"), "l")}
        return self

    def transform(self, df: DataFrame, out: str = "indicators") -> DataFrame:
        held = F.coalesce(F.col(self.labels_), F.array())
        return df.withColumn(out, F.array(*[F.array_contains(held, F.lit(c)).cast("int") for c in self.classes_]))


class TargetEncoder(Estimator):
    """Smoothed mean of the target by category. fit_transform() encodes each row by the other folds' rows.

    smooth="auto" shrinks by the ratio of the variance within the category to that of all; a number is a count of
    pseudo-rows at the global mean. Unknown categories get the global mean.
    """

    defaults = {"smooth": "auto", "cv": 5, "seed": 0}

    def _encoding(self, n, s, q, g):
        if self.smooth != "auto":
            return (s + F.lit(float(self.smooth)) * g["mean"]) / (n + F.lit(float(self.smooth)))
        mean, var = s / n, F.greatest(q / n - s * s / (n * n), F.lit(0.0))
        lam = F.when(n * g["var"] + var > 0, n * g["var"] / (n * g["var"] + var)).otherwise(1.0)
        return lam * mean + (1 - lam) * g["mean"]

    def fit(self, df: DataFrame, columns: list[str], target: str):
        y = F.col(target).cast("double")
        g = df.agg(F.avg(y).alias("mean"), F.var_pop(y).alias("var")).first().asDict()
        self.state |= {"columns": list(columns), "target": target, "mean": g["mean"], "tables": []}
        for c in columns:
            t = df.groupBy(F.col(c).alias("c")).agg(F.count(y).cast("double").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
            rows = t.select("c", self._encoding(F.col("n"), F.col("s"), F.col("q"), {k: F.lit(v) for k, v in g.items()}).alias("m")).limit(100_001).collect()
            if len(rows) > 100_000:
                raise ValueError(f"{c} has more than 100,000 categories")
            self.state["tables"].append([[r["c"], r["m"]] for r in rows])
        return self

    def transform(self, df: DataFrame, suffix: str = "_target") -> DataFrame:
        for c, t in zip(self.columns_, self.tables_):
            table = df.sparkSession.createDataFrame([tuple(r) for r in t], f"_mr_c {dict(df.dtypes)[c]}, _mr_m double")
            df = df.join(F.broadcast(table) if len(t) <= 10_000 else table, F.col(c).eqNullSafe(F.col("_mr_c")), "left").withColumn(c + suffix, F.coalesce("_mr_m", F.lit(self.mean_))).drop("_mr_c", "_mr_m")
        return df

    def fit_transform(self, df: DataFrame, columns: list[str], target: str, key: str, suffix: str = "_target") -> DataFrame:
        """Rows are dealt to `cv` folds by a hash of `key`; each is encoded by sums over all folds less its own."""
        self.fit(df, columns, target)
        y = F.col(target).cast("double")
        x = df.withColumn("_mr_fold", F.pmod(keyed(self.seed, F.col(key)), F.lit(int(self.cv))).cast("int"))
        sums = lambda by: x.groupBy(*by).agg(F.count(y).cast("double").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
        fold, whole = sums(["_mr_fold"]), sums([F.lit(0).alias("_mr_all")])
        base = fold.alias("f").crossJoin(F.broadcast(whole).alias("a")).select(F.col("f._mr_fold").alias("_mr_f"), *[(F.col(f"a.{k}") - F.col(f"f.{k}")).alias(f"_g{k}") for k in "nsq"])
        for c in columns:
            mine, every = sums([F.col(c).alias("_mr_c"), "_mr_fold"]), sums([F.col(c).alias("_mr_k")])
            t = mine.alias("m").join(every.alias("e"), F.col("m._mr_c").eqNullSafe(F.col("e._mr_k"))).select("_mr_c", F.col("m._mr_fold").alias("_mr_g"), *[(F.col(f"e.{k}") - F.col(f"m.{k}")).alias(f"_c{k}") for k in "nsq"])
            t = t.join(F.broadcast(base), F.col("_mr_g") == F.col("_mr_f"))
            g = {"mean": F.col("_gs") / F.col("_gn"), "var": F.greatest(F.col("_gq") / F.col("_gn") - F.pow(F.col("_gs") / F.col("_gn"), F.lit(2.0)), F.lit(0.0))}
            t = t.select("_mr_c", "_mr_g", F.when(F.col("_cn") > 0, self._encoding(F.col("_cn"), F.col("_cs"), F.col("_cq"), g)).otherwise(g["mean"]).alias("_mr_m"))
            x = x.join(t, F.col(c).eqNullSafe(F.col("_mr_c")) & (F.col("_mr_fold") == F.col("_mr_g")), "left").withColumn(c + suffix, F.col("_mr_m")).drop("_mr_c", "_mr_g", "_mr_m")
        return x.drop("_mr_fold")


class PolynomialFeatures(Estimator):
    """All monomials of the columns up to a degree, in order of degree and then of columns."""

    defaults = {"degree": 2, "interaction_only": False, "include_bias": True}

    def fit(self, df, columns):
        from itertools import chain, combinations, combinations_with_replacement

        pick = combinations if self.interaction_only else combinations_with_replacement
        powers = chain.from_iterable(pick(range(len(columns)), k) for k in range(0 if self.include_bias else 1, self.degree + 1))
        self.state |= {"columns": list(columns), "terms": [list(p) for p in powers]}
        return self

    def names(self) -> list[str]:
        return ["*".join(self.columns_[k] for k in t) or "1" for t in self.terms_]

    def transform(self, df: DataFrame, out: str = "polynomial") -> DataFrame:
        def term(t):
            c = F.lit(1.0)
            for k in t:
                c = c * F.col(self.columns_[k]).cast("double")
            return c

        return df.withColumn(out, F.array(*map(term, self.terms_)))


class SplineTransformer(Estimator):
    """B-spline bases of any degree per column, by the Cox-de Boor recursion as column expressions.

    knots="uniform" spreads n_knots over the range, "quantile" over exact quantiles. Beyond the range the value at the
    nearer end holds (extrapolation="constant").
    """

    defaults = {"n_knots": 5, "degree": 3, "knots": "uniform"}

    def fit(self, df, columns):
        n = int(self.n_knots)
        grid = [k / (n - 1) for k in range(n)]
        r = df.agg(*[F.percentile(present(c), grid if self.knots == "quantile" else [0.0, 1.0]).alias(str(k)) for k, c in enumerate(columns)]).first()
        base = [np.array(q) if self.knots == "quantile" else np.linspace(q[0], q[1], n) for q in r]
        d, knots = int(self.degree), []
        for b in base:
            lead, tail = b[1] - b[0], b[-1] - b[-2]
            knots.append(np.concatenate([b[0] - lead * np.arange(d, 0, -1), b, b[-1] + tail * np.arange(1, d + 1)]).tolist())
        self.state |= {"columns": list(columns), "knots": knots}
        return self

    def transform(self, df: DataFrame, out: str = "splines") -> DataFrame:
        d, parts = int(self.degree), []
        for c, t in zip(self.columns_, self.knots_):
            n = len(t) - d - 1
            x = F.least(F.greatest(present(c), F.lit(t[d])), F.lit(t[n]))
            level = [((x >= t[k]) & ((x < t[k + 1]) if k < n - 1 else (x <= t[n]))).cast("double") if k < n else F.lit(0.0) for k in range(len(t) - 1)]
            for p in range(1, d + 1):
                new = []
                for k in range(len(t) - 1 - p):
                    left = (x - t[k]) / F.lit(t[k + p] - t[k]) * level[k] if t[k + p] > t[k] else F.lit(0.0)
                    right = (F.lit(t[k + p + 1]) - x) / F.lit(t[k + p + 1] - t[k + 1]) * level[k + 1] if t[k + p + 1] > t[k + 1] else F.lit(0.0)
                    new.append(left + right)
                level = new
            parts += level
        return df.withColumn(out, F.array(*parts))


class VarianceThreshold(Estimator):
    """Keeps the columns whose population variance is above the threshold."""

    defaults = {"threshold": 0.0}

    def fit(self, df, columns):
        v = df.agg(*[F.var_pop(present(c)).alias(str(k)) for k, c in enumerate(columns)]).first()
        self.state |= {"columns": list(columns), "variances": list(v), "kept": [c for c, x in zip(columns, v) if x is not None and x > self.threshold]}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.columns_ if c not in self.kept_])


# --- scores of features -------------------------------------------------------------------------------------------


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(500):
        m = k // 2
        num = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-300)
        c = (1 + num / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = s = 1 / a
        k = a
        while abs(term) > abs(s) * 1e-16:
            k += 1
            term *= x / k
            s += term
        return max(0.0, 1 - s * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for k in range(1, 1000):
        an = -k * (k - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else 0.0 if math.isinf(f) else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_tail(x: float, k: float) -> float:
    return gammainc_upper(k / 2, x / 2)


def f_classif(df: DataFrame, columns: list[str], label: str) -> list[tuple[float, float]]:
    """(F, p) of the one-way analysis of variance of each column by class."""
    aggs = [f.alias(n) for k, c in enumerate(columns) for f, n in ((F.sum(F.col(c).cast("double")), f"s{k}"), (F.sum(F.col(c).cast("double") * F.col(c)), f"q{k}"))]
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *aggs).collect()
    n, g, out = sum(r["n"] for r in rows), len(rows), []
    for k in range(len(columns)):
        s, q = sum(r[f"s{k}"] for r in rows), sum(r[f"q{k}"] for r in rows)
        between = sum(r[f"s{k}"] ** 2 / r["n"] for r in rows) - s * s / n
        within = q - s * s / n - between
        f = (between / (g - 1)) / (within / (n - g)) if within > 0 and g > 1 else math.inf if g > 1 else math.nan
        out.append((f, f_tail(f, g - 1, n - g)))
    return out


def r_regression(df: DataFrame, columns: list[str], target: str) -> list[float]:
    return [r if r is not None else math.nan for r in df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(str(k)) for k, c in enumerate(columns)]).first()]


def f_regression(df: DataFrame, columns: list[str], target: str) -> list[tuple[float, float]]:
    """(F, p) of each column's correlation with the target."""
    n, out = df.count(), []
    for r in r_regression(df, columns, target):
        f = r * r / (1 - r * r) * (n - 2) if r * r < 1 else math.inf
        out.append((f, f_tail(f, 1, n - 2)))
    return out


def chi2(df: DataFrame, columns: list[str], label: str) -> list[tuple[float, float]]:
    """(statistic, p) of each non-negative column's sums by class against those that class sizes suggest."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.least(*[F.min(c).cast("double") for c in columns], F.lit(0.0)).alias("low"), *[F.sum(F.col(c).cast("double")).alias(f"s{k}") for k, c in enumerate(columns)]).collect()
    if any(r["low"] < 0 for r in rows):
        raise ValueError("chi2 needs non-negative features")
    n, out = sum(r["n"] for r in rows), []
    for k in range(len(columns)):
        tot = sum(r[f"s{k}"] for r in rows)
        x = sum((r[f"s{k}"] - tot * r["n"] / n) ** 2 / (tot * r["n"] / n) for r in rows) if tot else math.nan
        out.append((x, chi2_tail(x, len(rows) - 1) if x == x else math.nan))
    return out


def mutual_info_classif(df: DataFrame, columns: list[str], label: str, discrete: bool = True, n_neighbors: int = 3) -> list[float]:
    """Mutual information of each column with the class, in nats: by counts, or for continuous columns by distances
    to the n-th neighbour of the same class. Those take every row: one column and the class at a time are sorted on
    the driver, some 100 bytes a row."""
    if not discrete:
        return [max(0.0, _nearest_information(*_with_codes(df, c, label), n_neighbors)) for c in columns]
    out = []
    for c in columns:
        t = df.groupBy(F.col(c).alias("x"), F.col(label).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        a, b = t.groupBy("x").agg(F.sum("n").alias("nx")), t.groupBy("y").agg(F.sum("n").alias("ny"))
        total = F.broadcast(t.agg(F.sum("n").alias("nn")))
        m = t.alias("t").join(a.withColumnRenamed("x", "x2"), F.col("x").eqNullSafe(F.col("x2"))).join(F.broadcast(b.withColumnRenamed("y", "y2")), F.col("y").eqNullSafe(F.col("y2"))).crossJoin(total)
        out.append(m.agg(F.sum(F.expr("n / nn * ln(n * nn / (nx * ny))"))).first()[0] or 0.0)
    return out


def digamma(x: np.ndarray | float):
    """Digamma of positive numbers: recurrence up to 10, then the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (small := x < 10).any():
        out = np.where(small, out - 1 / x, out)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _with_codes(df: DataFrame, column: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column and the codes of their labels, which are numbered as the driver meets them."""
    held = df.select(F.col(column).cast("double").alias("x"), F.col(label).alias("y")).toArrow()
    if held["x"].null_count or held["y"].null_count:
        raise ValueError("a feature or label is null")
    x = held["x"].to_numpy()
    if not np.isfinite(x).all():
        raise ValueError("a feature is not finite")
    return x, held["y"].combine_chunks().dictionary_encode().indices.to_numpy()


def _kth_gap(v: np.ndarray, k: int) -> np.ndarray:
    """Distance of each of the sorted values to its k-th neighbour: the best of the windows of k + 1 values around it."""
    out, n = np.full(len(v), np.inf), len(v)
    for back in range(k + 1):
        at = np.arange(back, n - k + back)
        np.minimum.at(out, at, np.maximum(v[at] - v[at - back], v[at - back + k] - v[at]))
    return out


def _up_to(s: np.ndarray, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many of the sorted s exceed x by at most the radius; by differences, as x + radius would round onto a neighbour."""
    at = np.searchsorted(s, x + radius, "right")
    while (off := (at > 0) & (s[at - 1] - x > radius)).any():
        at[off] = np.searchsorted(s, s[at[off] - 1], "left")
    while (off := (at < len(s)) & (s[np.minimum(at, len(s) - 1)] - x <= radius)).any():
        at[off] = np.searchsorted(s, s[at[off]], "right")
    return at


def _nearest_information(x: np.ndarray, y: np.ndarray, k: int) -> float:
    radius, counts, kept = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), bool)
    ks = np.zeros(len(x))
    order = np.lexsort((x, y))
    for own in np.split(order, np.nonzero(np.diff(y[order]))[0] + 1):
        counts[own] = len(own)
        if len(own) > 1:
            kk = min(k, len(own) - 1)
            radius[own] = np.nextafter(_kth_gap(x[own], kk), 0)
            kept[own], ks[own] = True, kk
    x, radius, ks, counts = x[kept], radius[kept], ks[kept], counts[kept]
    s = np.sort(x)
    m = _up_to(s, x, radius) + _up_to(-s[::-1], -x, radius) - len(s)
    return float(digamma(float(len(x))) + digamma(ks).mean() - digamma(counts).mean() - digamma(np.maximum(m, 1)).mean())


class SelectKBest(Estimator):
    """Keeps the k columns with the largest score; ties keep the earlier column."""

    defaults = {"score_func": "f_classif", "k": 10}

    def fit(self, df, columns, label):
        found = {"f_classif": f_classif, "f_regression": f_regression, "chi2": chi2, "r_regression": r_regression, "mutual_info_classif": mutual_info_classif}[self.score_func](df, columns, label)
        scores = [s[0] if isinstance(s, tuple) else s for s in found]
        order = sorted(range(len(columns)), key=lambda k: (-(scores[k] if scores[k] == scores[k] else -math.inf), k))
        self.state |= {"columns": list(columns), "scores": scores, "kept": [columns[k] for k in sorted(order[: self.k])]}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.columns_ if c not in self.kept_])


class RFE(Estimator):
    """Drops the columns with the smallest absolute coefficients, `step` a round, until n_features_to_select are left."""

    defaults = {"estimator": None, "n_features_to_select": 1, "step": 1}

    def fit(self, df, columns, target):
        kept, rank = list(columns), {}
        while len(kept) > self.n_features_to_select:
            m = self.estimator.clone().fit(df, kept, target)
            w = np.abs(np.atleast_2d(np.asarray(m.coef_, float))).max(0)
            out = sorted(range(len(kept)), key=lambda k: (w[k], -k))[: min(self.step, len(kept) - self.n_features_to_select)]
            for k in out:
                rank[kept[k]] = len(kept) - self.n_features_to_select + 1
            kept = [c for k, c in enumerate(kept) if k not in out]
        rounds = sorted(set(rank.values()))
        self.state |= {"columns": list(columns), "kept": kept, "ranking": [1 if c in kept else 2 + rounds.index(rank[c]) for c in columns]}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.columns_ if c not in self.kept_])


def balanced_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Rows with the weight n / (classes * rows of the class)."""
    n = df.groupBy(F.col(label).alias("_mr_l")).agg(F.count(F.lit(1)).alias("_mr_n"))
    t = n.crossJoin(F.broadcast(n.agg(F.sum("_mr_n").alias("_mr_t"), F.count(F.lit(1)).alias("_mr_k")))).select("_mr_l", (F.col("_mr_t") / (F.col("_mr_k") * F.col("_mr_n"))).alias(out))
    return df.drop(out).join(F.broadcast(t), F.col(label).eqNullSafe(F.col("_mr_l"))).drop("_mr_l")


def finite_scan(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, nans, infinities), one row per column, by one aggregate."""
    agg = df.agg(*[F.struct(F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.sum(F.isnan(F.col(c).cast("double")).cast("long")).alias("nans"), F.sum((F.abs(F.col(c).cast("double")) == F.lit(math.inf)).cast("long")).alias("infinities")).alias(f"c{k}") for k, c in enumerate(columns)])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(f"c{k}.nulls", F.lit(0)).alias("nulls"), F.coalesce(f"c{k}.nans", F.lit(0)).alias("nans"), F.coalesce(f"c{k}.infinities", F.lit(0)).alias("infinities")) for k, c in enumerate(columns)])).alias("r")).select("r.*")


def refuse_non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, whose evaluation fails by name at the first null, NaN or infinite value of the columns."""
    checks = [F.assert_true(F.coalesce(F.abs(F.col(c).cast("double")) < F.lit(math.inf), F.lit(False)), F.lit(f"{c} is not finite")).isNull() for c in columns]
    ok = checks[0]
    for c in checks[1:]:
        ok = ok & c
    return df.where(ok)


__all__ = [n for n in dir() if n[0].isupper()] + ["f_classif", "f_regression", "r_regression", "chi2", "mutual_info_classif", "balanced_class_weight", "finite_scan", "refuse_non_finite"]
