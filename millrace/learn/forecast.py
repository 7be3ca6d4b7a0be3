"""Time series, one model per series: series are groups, a group is fitted in one task.

A series longer than `limit` is refused, so a task's memory is bounded; the number of series is not. Recursions follow
the time order with ties in the value's order; null values are refused.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.learn.base import Estimator
from millrace.learn.kernel import minimise


class SeriesModel(Estimator):
    """fit_series(y) gives a state; forecast_series(state, y, h) continues it; parameters_series(state) describes it."""

    defaults = {"limit": 200_000}

    def fit_series(self, y: np.ndarray) -> dict:
        raise NotImplementedError

    def forecast_series(self, s: dict, y: np.ndarray, h: int) -> np.ndarray:
        raise NotImplementedError

    def spread_series(self, s: dict, y: np.ndarray, h: int) -> np.ndarray | None:
        """Standard deviations of the forecasts, where the model has them."""
        return None

    def _groups(self, df, series, time, value):
        return df.select(F.col(series).alias("series"), F.col(time).alias("t"), F.col(value).cast("double").alias("y")).groupBy("series")

    def _values(self, table: pa.Table) -> np.ndarray:
        if table.num_rows > self.limit:
            raise ValueError(f"a series has more than {self.limit} values")
        y = table.sort_by([("t", "ascending"), ("y", "ascending")])["y"]
        if y.null_count:
            raise ValueError("a value is null")
        return y.to_numpy()

    def forecast(self, df: DataFrame, series: str, time: str, value: str, h: int, z: float = 1.959963984540054) -> DataFrame:
        """(series, step, forecast, lower, upper), step from 1; bounds are null where the model has no deviation."""
        kind = df.schema[series].dataType.simpleString()

        def run(table: pa.Table) -> pa.Table:
            y = self._values(table)
            s = self.fit_series(y)
            f = np.asarray(self.forecast_series(s, y, h), float)
            d = self.spread_series(s, y, h)
            low, high = (f - z * d, f + z * d) if d is not None else (None, None)
            bound = lambda v: pa.nulls(h, pa.float64()) if v is None else pa.array(v, pa.float64())
            key = pa.concat_arrays([table["series"].combine_chunks().slice(0, 1)] * h)
            return pa.table({"series": key, "step": pa.array(np.arange(1, h + 1), pa.int32()), "forecast": pa.array(f, pa.float64()), "lower": bound(low), "upper": bound(high)})

        return self._groups(df, series, time, value).applyInArrow(run, f"series {kind}, step int, forecast double, lower double, upper double")

    def parameters(self, df: DataFrame, series: str, time: str, value: str) -> DataFrame:
        """(series, name, value): the fitted numbers of each series."""
        kind = df.schema[series].dataType.simpleString()

        def run(table: pa.Table) -> pa.Table:
            s = {k: v for k, v in self.fit_series(self._values(table)).items() if isinstance(v, (int, float, np.floating, np.integer))}
            key = pa.concat_arrays([table["series"].combine_chunks().slice(0, 1)] * len(s)) if s else table["series"].combine_chunks().slice(0, 0)
            return pa.table({"series": key, "name": pa.array(list(s), pa.string()), "value": pa.array([float(v) for v in s.values()], pa.float64())})

        return self._groups(df, series, time, value).applyInArrow(run, f"series {kind}, name string, value double")


def difference(df: DataFrame, series: str, time: str, value: str, order: int = 1, lag: int = 1, out: str = "difference") -> DataFrame:
    """The value less that `lag` steps before, `order` times, within each series; null where there is none."""
    w = Window.partitionBy(series).orderBy(time)
    df = df.withColumn(out, F.col(value).cast("double"))
    for _ in range(order):
        df = df.withColumn(out, F.col(out) - F.lag(out, lag).over(w))
    return df


def kpss(y: np.ndarray, trend: str = "c", lags: int | None = None) -> tuple[float, float, int]:
    """(statistic, p, lags) of stationarity about a level ("c") or trend ("ct"); p is within 0.01 and 0.1."""
    n, t = len(y), np.arange(len(y), dtype=float)
    z = np.column_stack([np.ones(n), t]) if trend == "ct" else np.ones((n, 1))
    e = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    lags = min(n - 1, int(math.ceil(12 * (n / 100) ** 0.25))) if lags is None else lags
    s = float(e @ e) / n
    for k in range(1, lags + 1):
        s += 2 / n * float(e[k:] @ e[:-k]) * (1 - k / (lags + 1))
    eta = float((np.cumsum(e) ** 2).sum()) / n**2 / s if s > 0 else 0.0
    # fixed values: critical values at 10, 5, 2.5 and 1 per cent
    crit = [0.119, 0.146, 0.176, 0.216] if trend == "ct" else [0.347, 0.463, 0.574, 0.739]
    return eta, float(np.interp(eta, crit, [0.1, 0.05, 0.025, 0.01])), lags


class KpssTest(SeriesModel):
    """The stationarity test of each series after d differences and a seasonal one."""

    defaults = {**SeriesModel.defaults, "d": 0, "D": 0, "s": 1, "trend": "c", "lags": None}

    def fit_series(self, y):
        for _ in range(self.D):
            y = y[self.s :] - y[: -self.s]
        y = np.diff(y, n=self.d) if self.d else y
        if len(y) < 3:
            return {"statistic": math.nan, "p": math.nan, "lags": 0}
        eta, p, lags = kpss(y, self.trend, self.lags)
        return {"statistic": eta, "p": p, "lags": lags}

    test = SeriesModel.parameters


# --- ARIMA ------------------------------------------------------------------------------------------------------------


def _polynomials(params: np.ndarray, order, seasonal, intercept: bool):
    p, _, q = order
    sp, _, sq, s = seasonal
    c = params[0] if intercept else 0.0
    at = int(intercept)
    ar, ma, sar, sma = np.split(params[at : at + p + q + sp + sq], np.cumsum([p, q, sp])[:3])
    full = lambda a, b, sign: np.convolve(np.append(1.0, sign * a), np.append(1.0, np.concatenate([np.append(np.zeros(s - 1), sign * v) for v in b]) if len(b) else []))
    return c, -full(ar, sar, -1)[1:], full(ma, sma, 1)[1:]


def _bounded(v: np.ndarray) -> np.ndarray:
    """Unbounded numbers to coefficients of a stationary polynomial, through partial autocorrelations."""
    r = np.tanh(v)
    out = np.zeros(0)
    for k in range(len(r)):
        out = np.append(out - r[k] * out[::-1], r[k])
    return out


def kalman(y: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood concentrated in the variance, variance, state, its covariance, transition) of a zero-mean ARMA."""
    r = max(len(ar), len(ma) + 1, 1)
    t = np.zeros((r, r))
    t[: len(ar), 0] = ar
    t[:-1, 1:] = np.eye(r - 1)
    g = np.zeros(r)
    g[0], g[1 : len(ma) + 1] = 1.0, ma
    q = np.outer(g, g)
    if r <= 12:
        p = np.linalg.solve(np.eye(r * r) - np.kron(t, t) + 1e-12 * np.eye(r * r), q.ravel()).reshape(r, r)
    else:
        p, step, root = q.copy(), t.copy(), q.copy()
        for _ in range(40):
            root = step @ p @ step.T
            p, step = p + root, step @ step
            if np.abs(root).max() < 1e-12 * np.abs(p).max():
                break
    a, ssq, logdet, steady = np.zeros(r), 0.0, 0.0, None
    for k in range(len(y)):
        f = max(p[0, 0], 1e-12)
        v = y[k] - a[0]
        ssq += v * v / f
        logdet += math.log(f)
        gain = p[:, 0] / f
        a = t @ (a + gain * v)
        if steady is None:
            new = t @ (p - np.outer(gain, p[0])) @ t.T + q
            if np.abs(new - p).max() < 1e-10:
                steady = new
            p = new
    n = len(y)
    s2 = max(ssq / n, 1e-300)
    return -0.5 * (n * (math.log(2 * math.pi * s2) + 1) + logdet), s2, a, p, t


class ARIMA(SeriesModel):
    """(p, d, q)(P, D, Q)s with a level, by the likelihood of the Kalman filter; forecasts carry their deviations."""

    defaults = {**SeriesModel.defaults, "order": (1, 0, 0), "seasonal_order": (0, 0, 0, 1), "fit_intercept": True, "rounds": 40}

    def _differenced(self, y):
        (_, d, _), (_, sd, _, s) = self.order, self.seasonal_order
        for _ in range(sd):
            y = y[s:] - y[:-s]
        return np.diff(y, n=d) if d else y

    def fit_series(self, y):
        (p, d, q), (sp, sd, sq, s) = self.order, self.seasonal_order
        z = self._differenced(y)
        one = bool(self.fit_intercept)
        k = p + q + sp + sq
        if len(z) <= k + 1:
            return {"mean": float(z.mean()) if len(z) else 0.0, "sigma2": 0.0, "loglike": -math.inf, "aic": math.inf, "bic": math.inf, "aicc": math.inf, "ar": np.zeros(0), "ma": np.zeros(0), "n": len(z), "short": True}
        mean = float(z.mean()) if one else 0.0

        def coefs(v):
            ar, ma, sar, sma = np.split(v, np.cumsum([p, q, sp])[:3])
            return np.concatenate([_bounded(ar), -_bounded(ma), _bounded(sar), -_bounded(sma)])

        def nll(v):
            m = v[0] * scale + mean if one else 0.0
            _, ar, ma = _polynomials(coefs(v[int(one) :]), self.order, self.seasonal_order, False)
            like = kalman(z - m, ar, ma)[0]
            return -like if math.isfinite(like) else 1e12

        scale = float(z.std()) or 1.0
        start = np.zeros(int(one) + k)
        if p:
            c = z - mean
            r = [float(c[j:] @ c[: len(c) - j]) for j in range(2)]
            start[int(one)] = math.atanh(min(0.95, max(-0.95, r[1] / r[0]))) if r[0] else 0.0
        v, cost = minimise(nll, start, 0.3, int(self.rounds)) if len(start) else (start, nll(start))
        m = v[0] * scale + mean if one else 0.0
        c = coefs(v[int(one) :])
        _, ar, ma = _polynomials(c, self.order, self.seasonal_order, False)
        like, s2, a, cov, t = kalman(z - m, ar, ma)
        k, n = len(v) + 1, len(z)
        out = {"mean": float(m), "sigma2": s2, "loglike": like, "aic": 2 * k - 2 * like, "bic": math.log(n) * k - 2 * like, "aicc": 2 * k - 2 * like + (2 * k * (k + 1) / (n - k - 1) if n > k + 1 else math.inf), "state": a, "cov": cov, "move": t, "ar": ar, "ma": ma, "n": n, "short": False}
        for name, own in zip(("ar", "ma", "sar", "sma"), np.split(c, np.cumsum([p, q, sp])[:3])):
            out |= {f"{name}{j + 1}": float(x) for j, x in enumerate(own)}
        return out

    def forecast_series(self, s, y, h):
        (_, d, _), (_, sd, _, lag) = self.order, self.seasonal_order
        f = np.full(h, s["mean"])
        if not s["short"]:
            a = s["state"]
            for k in range(h):
                f[k] += a[0]
                a = s["move"] @ a
        # undo the differences, the last one first
        levels = [y]
        for _ in range(sd):
            levels.append(levels[-1][lag:] - levels[-1][:-lag])
        for _ in range(d):
            levels.append(np.diff(levels[-1]))
        for k in range(len(levels) - 2, -1, -1):
            back = 1 if k >= sd else lag
            base, out = list(levels[k]), []
            for v in f:
                out.append(v + (base[-back] if len(base) >= back else 0.0))
                base.append(out[-1])
            f = np.array(out)
        return f

    def spread_series(self, s, y, h):
        if s["short"]:
            return None
        (_, d, _), (_, sd, _, lag) = self.order, self.seasonal_order
        ar = np.append(1.0, -s["ar"])
        for _ in range(d):
            ar = np.convolve(ar, [1.0, -1.0])
        for _ in range(sd):
            ar = np.convolve(ar, np.append(np.append(1.0, np.zeros(lag - 1)), -1.0))
        psi = np.zeros(h)
        for k in range(h):
            psi[k] = (1.0 if k == 0 else s["ma"][k - 1] if k - 1 < len(s["ma"]) else 0.0) - sum(ar[j] * psi[k - j] for j in range(1, min(k, len(ar) - 1) + 1))
        return np.sqrt(s["sigma2"] * np.cumsum(psi**2))


class AutoARIMA(ARIMA):
    """d is the first order whose KPSS test passes at 0.05; p, q (P, Q) are those of the lowest criterion."""

    defaults = {**ARIMA.defaults, "max_p": 2, "max_q": 2, "max_P": 0, "max_Q": 0, "D": 0, "s": 1, "ic": "aicc"}

    def fit_series(self, y):
        z, d = y, 0
        for _ in range(self.D):
            z = z[self.s :] - z[: -self.s]
        while d < 2 - self.D and len(z) > 4 and kpss(z)[1] <= 0.05:
            z, d = np.diff(z), d + 1
        best = None
        for p in range(self.max_p + 1):
            for q in range(self.max_q + 1):
                for sp in range(self.max_P + 1):
                    for sq in range(self.max_Q + 1):
                        m = ARIMA(order=(p, d, q), seasonal_order=(sp, self.D, sq, self.s), fit_intercept=d + self.D < 2, limit=self.limit, rounds=self.rounds)
                        s = m.fit_series(y)
                        if best is None or s[self.ic] < best[0] - 1e-9:
                            best = (s[self.ic], m, s)
        return {**best[2], "p": best[1].order[0], "d": d, "q": best[1].order[2], "P": best[1].seasonal_order[0], "Q": best[1].seasonal_order[2]}

    def _own(self, s):
        return ARIMA(order=(s["p"], s["d"], s["q"]), seasonal_order=(s["P"], self.D, s["Q"], self.s))

    def forecast_series(self, s, y, h):
        return self._own(s).forecast_series(s, y, h)

    def spread_series(self, s, y, h):
        return self._own(s).spread_series(s, y, h)


# --- smoothing ---------------------------------------------------------------------------------------------------------


def ses(y: np.ndarray, alpha: float, level: float | None = None) -> tuple[float, np.ndarray]:
    """(last level, one-step errors) of simple exponential smoothing."""
    level = y[0] if level is None else level
    e = np.empty(len(y))
    for k, v in enumerate(y):
        e[k] = v - level
        level += alpha * e[k]
    return level, e


def best_alpha(y: np.ndarray) -> float:
    """The smoothing of the smallest squared one-step errors, on a grid refined three times."""
    lo, hi = 0.01, 0.99
    for _ in range(4):
        grid = np.linspace(lo, hi, 15)
        costs = [float((ses(y, a)[1][1:] ** 2).sum()) for a in grid]
        k = int(np.argmin(costs))
        lo, hi = grid[max(0, k - 1)], grid[min(14, k + 1)]
    return float(grid[k])


class ETS(SeriesModel):
    """Error, trend and season by a model name such as "ANN", "AAN", "AAA", "MAM"; Z picks additive errors, and trend
    and season by the corrected criterion. Smoothing parameters and first states by the smallest criterion."""

    defaults = {**SeriesModel.defaults, "season_length": 1, "model": "ZZZ", "damped": False, "rounds": 30}

    def _run(self, y, kind, v, m, keep=False):
        e_, t_, s_ = kind
        alpha, beta, gamma, phi = (1 / (1 + np.exp(-np.clip(v[:4], -30, 30)))).tolist()
        beta, gamma, phi = (alpha * beta if t_ != "N" else 0.0), ((1 - alpha) * gamma if s_ != "N" else 0.0), (0.8 + 0.18 * phi if self.damped and t_ != "N" else 1.0)
        level, trend = v[4], v[5] if t_ != "N" else (1.0 if t_ == "M" else 0.0)
        season = list(v[6 : 6 + m]) if s_ != "N" else []
        sse, logs = 0.0, 0.0
        for k, x in enumerate(y):
            base = level * trend**phi if t_ == "M" else level + phi * trend
            s = season[k % m] if season else (1.0 if s_ == "M" else 0.0)
            f = base * s if s_ == "M" else base + s
            err = x - f
            if e_ == "M":
                if f <= 0:
                    return math.inf
                logs += math.log(abs(f))
                sse += (err / f) ** 2
            else:
                sse += err * err
            adj = err / s if s_ == "M" and s else err
            new = base + alpha * adj
            if t_ == "M":
                trend = max(trend**phi + beta * adj / level, 1e-6) if level else trend
            elif t_ != "N":
                trend = phi * trend + beta * adj
            if season:
                season[k % m] = s + (gamma * err / base if s_ == "M" and base else gamma * err)
            level = new
        if keep:
            return level, trend, season, phi, sse
        n = len(y)
        return n * math.log(max(sse, 1e-300) / n) + 2 * logs if math.isfinite(sse) else math.inf

    def _start(self, y, kind, m):
        season = np.zeros(m)
        if kind[2] != "N":
            full = y[: len(y) // m * m].reshape(-1, m)
            mean = full.mean(1, keepdims=True)
            season = (full / np.where(mean == 0, 1, mean)).mean(0) if kind[2] == "M" else (full - mean).mean(0)
        z = (y[: max(m, 2)] / season[np.arange(max(m, 2)) % m] if kind[2] == "M" and (season != 0).all() else y[: max(m, 2)] - (season[np.arange(max(m, 2)) % m] if kind[2] == "A" else 0))
        level = float(np.mean(z))
        slope = float((np.mean(y[m : 2 * m]) - np.mean(y[:m])) / m) if len(y) >= 2 * m and m > 1 else float((y[min(len(y) - 1, 9)] - y[0]) / max(1, min(len(y) - 1, 9)))
        trend = 1.0 + slope / level if kind[1] == "M" and level else slope
        return np.concatenate([[-0.5, -2.0, -2.0, 1.0, level, trend], season if kind[2] != "N" else []])

    def _fit(self, y, kind):
        m = int(self.season_length) if kind[2] != "N" else 1
        v0 = self._start(y, kind, m)
        head = 6
        scale = np.concatenate([np.ones(4), [max(y.std(), 1e-6)], [max(abs(v0[5]) * 0.5, 0.01 if kind[1] == "M" else max(y.std() * 0.05, 1e-6))]])

        def cost(u):
            v = np.concatenate([v0[:4] + u[:4], v0[4:6] + u[4:6] * scale[4:6], v0[6:]])
            c = self._run(y, kind, v, m)
            return c if math.isfinite(c) else 1e12

        u, c = minimise(cost, np.zeros(head), 0.5, int(self.rounds))
        v = np.concatenate([v0[:4] + u[:4], v0[4:6] + u[4:6] * scale[4:6], v0[6:]])
        k = 2 + 2 * (kind[1] != "N") + (1 + m) * (kind[2] != "N") + (self.damped and kind[1] != "N") + 1
        n = len(y)
        level, trend, season, phi, sse = self._run(y, kind, v, m, keep=True)
        return {"criterion": c + 2 * k + (2 * k * (k + 1) / (n - k - 1) if n > k + 1 else 1e9), "aic": c + 2 * k, "kind": kind, "level": float(level), "trend": float(trend), "season": season, "phi": phi, "sigma2": sse / max(1, n - k), "alpha": float(1 / (1 + math.exp(-min(30, max(-30, v[0]))))), "m": m, "n": n}

    def fit_series(self, y):
        if len(y) < 4:
            return {"kind": "ANN", "level": float(y[-1]), "trend": 0.0, "season": [], "phi": 1.0, "sigma2": 0.0, "m": 1, "n": len(y)}
        e, t, s = self.model
        m = int(self.season_length)
        kinds = [a + b + c for a in ("A" if e == "Z" else e) for b in ("NA" if t == "Z" else t) for c in (("NA" + ("M" if (y > 0).all() else "") if m > 1 and len(y) >= 2 * m else "N") if s == "Z" else s if m > 1 and len(y) >= 2 * m else "N")]
        return min((self._fit(y, k) for k in kinds), key=lambda s: s["criterion"])

    def forecast_series(self, s, y, h):
        out, phi, damp = np.empty(h), s["phi"], 0.0
        for k in range(h):
            damp += phi ** (k + 1)
            base = s["level"] * s["trend"] ** damp if s["kind"][1] == "M" else s["level"] + damp * s["trend"] * (s["kind"][1] != "N")
            if s["season"]:
                v = s["season"][(s["n"] + k) % s["m"]]
                base = base * v if s["kind"][2] == "M" else base + v
            out[k] = base
        return out


class DampedETS(ETS):
    defaults = {**ETS.defaults, "model": "AAN", "damped": True}


class ExponentialSmoothing(ETS):
    """Holt-Winters with an additive or multiplicative season."""

    defaults = {**SeriesModel.defaults, "seasonal": "additive", "seasonal_periods": 2, "rounds": 30}

    def __init__(self, **params):
        super().__init__(**params)
        if self.params["seasonal"] not in ("additive", "add", "multiplicative", "mul"):
            raise ValueError("seasonal is additive or multiplicative")
        self.params |= {"model": "AAM" if self.params["seasonal"].startswith("mul") else "AAA", "season_length": self.params["seasonal_periods"], "damped": False}

    def clone(self, **params):
        return type(self)(**{**{k: v for k, v in self.params.items() if k in self.defaults}, **params})


#: Values that one running sum smooths at a time: powers of 1 - alpha, 0.01 at least, stay above 1e-200.
CHUNK = 100


class Theta(SeriesModel):
    """The line theta = 0 and smoothing of the line theta = 2 (both weighted by `theta`), after removing a season that
    its autocorrelation shows. `optimize` fits theta; `dynamic` updates the line with each value."""

    defaults = {**SeriesModel.defaults, "season_length": 1, "theta": 2.0, "optimize": False, "dynamic": False, "auto": False}

    def _season(self, y):
        m = int(self.season_length)
        if m < 2 or len(y) < 2 * m:
            return None
        c = y - y.mean()
        v = float(c @ c)
        if v == 0:
            return None
        r = [float(c[k:] @ c[: len(c) - k]) / v for k in range(1, m + 1)]
        if abs(r[-1]) <= 1.645 * math.sqrt((1 + 2 * sum(x * x for x in r[:-1])) / len(y)):
            return None
        half = m // 2
        w = np.append(np.append(0.5, np.ones(m - 1)), 0.5) / m if m % 2 == 0 else np.ones(m) / m
        line = np.convolve(y, w, "valid")
        by = np.arange(half, half + len(line)) % m
        mult = bool((y > 0).all() and (line > 0).all())
        ratio = y[half : half + len(line)] / line if mult else y[half : half + len(line)] - line
        s = np.array([ratio[by == k].mean() if (by == k).any() else (1.0 if mult else 0.0) for k in range(m)])
        return (s / s.mean(), True) if mult else (s - s.mean(), False)

    def _pass(self, y, theta, alpha, level, keep=False):
        """One-step errors of the two-line model as a state recursion; the line is fixed or grows with the data."""
        n = len(y)
        t = np.arange(1, n + 1, dtype=float)
        if not self.dynamic:
            b = 6 / (n * n - 1) * float((2 * (t * y).mean() - (n + 1) * y.mean())) if n > 1 else 0.0
            a = y.mean() - b * (n + 1) / 2
        r, w = 1 - alpha, 1 - 1 / theta
        # the level before each value and after the last, CHUNK values at a time
        levels, p = np.empty(n + 1), r ** np.arange(n + 1)
        levels[0] = level
        for at in range(0, n, CHUNK):
            own = y[at : at + CHUNK]
            q = p[1 : len(own) + 1]
            levels[at + 1 : at + len(own) + 1] = q * (levels[at] + alpha * (own / q).cumsum())
        if self.dynamic:
            a, b = self._lines(y)
            if keep:
                return levels[n], a[n], b[n]
            a, b = a[:n], b[:n]
        elif keep:
            return levels[n], a, b
        return y - levels[:n] - w * (a * p[:n] + b * (1 - p[1:]) / alpha)

    @staticmethod
    def _lines(y) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of the growing line before each value and after the last; they depend on no parameter, so the last series' are kept."""
        kept = Theta.__dict__.get("_kept")
        if kept is not None and np.array_equal(kept[0], y):
            return kept[1:]
        a, b, mean = [float(y[0])], [0.0], float(y[0])
        for k, v in enumerate(y.tolist()):
            i = k + 1
            new = (k * mean + v) / i
            b.append(((i - 2) * b[-1] + 6 / i * (v - mean)) / (i + 1) if i > 1 else 0.0)
            mean = new
            a.append(mean - b[-1] * (i + 1) / 2)
        Theta._kept = (y.copy(), np.array(a), np.array(b))
        return Theta._kept[1:]

    def fit_series(self, y):
        season = self._season(y)
        z = y if season is None else (y / season[0][np.arange(len(y)) % len(season[0])] if season[1] else y - season[0][np.arange(len(y)) % len(season[0])])

        def run(m):
            def parts(u):
                alpha = 0.01 + 0.98 / (1 + math.exp(-max(-30, min(30, u[0]))))
                theta = m.theta if not m.optimize else 1 + math.exp(max(-20, min(10, u[2])))
                return theta, alpha, z[0] / 2 + u[1] * (z.std() or 1.0)

            def cost(u):
                with np.errstate(all="ignore"):
                    v = float((m._pass(z, *parts(u))[min(3, len(z) - 1) :] ** 2).sum())
                return v if math.isfinite(v) else 1e300

            u, c = minimise(cost, np.zeros(3 if m.optimize else 2) + (np.array([0, 0, 0.0]) if m.optimize else 0), 0.5, 30)
            return c, parts(u), m

        own = [self] if not self.auto else [Theta(**{**self.params, "auto": False, "optimize": o, "dynamic": d}) for o in (False, True) for d in (False, True)]
        c, (theta, alpha, level), m = min((run(m) for m in own), key=lambda r: r[0])
        last, a, b = m._pass(z, theta, alpha, level, keep=True)
        return {"theta": float(theta), "alpha": float(alpha), "level": float(last), "a": float(a), "b": float(b), "sigma2": c / max(1, len(z) - 3), "season": season}

    def forecast_series(self, s, y, h):
        n, w, alpha = len(y), 1 - 1 / s["theta"], s["alpha"]
        level, out = s["level"], np.empty(h)
        for k in range(h):
            f = level + w * (s["a"] * (1 - alpha) ** (n + k) + s["b"] * (1 - (1 - alpha) ** (n + k + 1)) / alpha)
            out[k] = f
            level = alpha * f + (1 - alpha) * level
        if s["season"] is not None:
            v = s["season"][0][(n + np.arange(h)) % len(s["season"][0])]
            out = out * v if s["season"][1] else out + v
        return out


class OptimizedTheta(Theta):
    defaults = {**Theta.defaults, "optimize": True}


class DynamicTheta(Theta):
    defaults = {**Theta.defaults, "dynamic": True}


class DynamicOptimizedTheta(Theta):
    defaults = {**Theta.defaults, "optimize": True, "dynamic": True}


class AutoTheta(Theta):
    """The best of the four forms by squared one-step errors."""

    defaults = {**Theta.defaults, "auto": True}


class CrostonClassic(SeriesModel):
    """Smoothed size of demands over their smoothed interval."""

    defaults = {**SeriesModel.defaults, "alpha": 0.1, "optimize": False, "factor": 1.0}

    def fit_series(self, y):
        at = np.nonzero(y)[0]
        if not len(at):
            return {"rate": 0.0}
        gaps = np.diff(np.append(-1, at)).astype(float)
        fit = lambda v: ses(v, best_alpha(v) if self.optimize and len(v) > 2 else self.alpha)[0]
        size, gap = fit(y[at]), fit(gaps)
        return {"size": float(size), "interval": float(gap), "rate": float(self.factor * size / gap)}

    def forecast_series(self, s, y, h):
        return np.full(h, s["rate"])


class CrostonOptimized(CrostonClassic):
    defaults = {**CrostonClassic.defaults, "optimize": True}


class CrostonSBA(CrostonClassic):
    """The classic rate times 0.95."""

    defaults = {**CrostonClassic.defaults, "factor": 0.95}


class GARCH(SeriesModel):
    """Conditional variance of (p, o, q) terms under normal errors, by maximum likelihood; forecasts are variances."""

    defaults = {**SeriesModel.defaults, "p": 1, "o": 0, "q": 1, "mean": "constant", "rounds": 60}

    def _variances(self, e, par, h=0):
        p, o, q = self.p, self.o, self.q
        w, a, g, b = par[0], par[1 : 1 + p], par[1 + p : 1 + p + o], par[1 + p + o :]
        v0 = float((e * e).mean())
        n, top = len(e), max(p, o, q)
        s = np.full(n + h, v0)
        sq = np.append(e * e, np.zeros(h))
        down = np.append(e * e * (e < 0), np.zeros(h))
        for t in range(n + h):
            if t:
                s[t] = w + sum(a[i] * (sq[t - 1 - i] if t - 1 - i >= 0 else v0) for i in range(p)) + sum(g[i] * (down[t - 1 - i] if t - 1 - i >= 0 else v0 / 2) for i in range(o)) + sum(b[i] * (s[t - 1 - i] if t - 1 - i >= 0 else v0) for i in range(q))
            if t >= n:
                sq[t], down[t] = s[t], s[t] / 2
        _ = top
        return s

    def fit_series(self, y):
        mu = float(y.mean()) if self.mean == "constant" else 0.0
        e = y - mu
        v, k = float((e * e).mean()), self.p + self.o + self.q
        if v <= 0 or len(y) < 10:
            return {"mu": mu, "omega": v, "loglike": 0.0, "params": np.append(v, np.zeros(k))}

        def parts(u):
            z = np.exp(np.clip(u[1:], -30, 30))
            share = z / (1 + z.sum())  # persistence below one
            own = share.copy()
            own[self.p : self.p + self.o] *= 2
            return np.append(math.exp(max(-30, min(30, u[0]))) * v, own)

        def nll(u):
            s = np.maximum(self._variances(e, parts(u)), 1e-12 * v)
            return 0.5 * float((np.log(2 * math.pi * s) + e * e / s).sum())

        u, c = minimise(nll, np.concatenate([[-2.0], np.full(self.p, -0.5), np.full(self.o, -2.0), np.full(self.q, 1.5)]), 0.5, int(self.rounds))
        par = parts(u)
        out = {"mu": mu, "omega": float(par[0]), "loglike": -c, "aic": 2 * (k + 2) + 2 * c, "params": par}
        for n, at, m in (("alpha", 1, self.p), ("gamma", 1 + self.p, self.o), ("beta", 1 + self.p + self.o, self.q)):
            out |= {f"{n}{j + 1}": float(par[at + j]) for j in range(m)}
        return out

    def forecast_series(self, s, y, h):
        return self._variances(y - s["mu"], s["params"], h)[len(y) :]


def loess(x: np.ndarray, y: np.ndarray, width: int, at: np.ndarray, degree: int = 1, weights: np.ndarray | None = None) -> np.ndarray:
    """Locally weighted lines (or means) of the `width` nearest points, tricube weights; beyond n points it widens."""
    n = len(x)
    w0 = np.ones(n) if weights is None else weights
    out = np.empty(len(at))
    k = min(width, n)
    for i, p in enumerate(at):
        lo = int(np.clip(np.searchsorted(x, p) - (k + 1) // 2, 0, n - k))
        while lo + k < n and x[lo + k] - p < p - x[lo]:
            lo += 1
        while lo > 0 and p - x[lo - 1] <= x[lo + k - 1] - p:
            lo -= 1
        xs, ys, ws = x[lo : lo + k], y[lo : lo + k], w0[lo : lo + k]
        d = np.abs(xs - p)
        far = max(d.max(), 1e-12) + (max(0, width - n) / 2)
        w = np.where(d < 0.999 * far, (1 - np.minimum(d / far, 1) ** 3) ** 3, 0) * ws
        w = np.where(d <= 0.001 * far, ws, w)
        s = w.sum()
        if s <= 0:
            out[i] = ys.mean()
            continue
        m = float((w * xs).sum() / s)
        v = float((w * (xs - m) ** 2).sum() / s)
        out[i] = float((w * ys).sum() / s)
        if degree and v > 1e-6 * (x[-1] - x[0] + 1) ** 2 * 1e-3:
            out[i] += (p - m) * float((w * (xs - m) * ys).sum() / s) / v
    return out


class STL(SeriesModel):
    """Season and trend by repeated LOESS; robust passes weigh rows by their remainder."""

    defaults = {**SeriesModel.defaults, "period": 7, "seasonal": 7, "trend": None, "low_pass": None, "robust": False, "limit": 20_000}

    def decompose_series(self, y):
        n, m = len(y), int(self.period)
        odd = lambda v: int(v) + (int(v) % 2 == 0)
        nt = self.trend or odd(math.ceil(1.5 * m / (1 - 1.5 / self.seasonal)))
        nl = self.low_pass or odd(m + (m % 2 == 0))
        t = np.arange(n, dtype=float)
        trend, rho = np.zeros(n), np.ones(n)
        if n < 2 * m:
            return np.zeros(n), np.full(n, y.mean() if n else 0.0), y - (y.mean() if n else 0.0)
        for outer in range(6 if self.robust else 1):
            for _ in range(1 if self.robust else 2) if outer else range(2):
                z = y - trend
                c = np.empty(n + 2 * m)
                for k in range(m):
                    own = z[k::m]
                    at = np.arange(-1, len(own) + 1, dtype=float)
                    s = loess(np.arange(len(own), dtype=float), own, int(self.seasonal), at, 1, rho[k::m])
                    c[k :: m][: len(s)] = s
                avg = lambda v, w: np.convolve(v, np.ones(w) / w, "valid")
                low = avg(avg(avg(c, m), m), 3)
                low = loess(t, low[:n], nl, t)
                season = c[m : m + n] - low
                trend = loess(t, y - season, int(nt), t, 1, rho)
            if self.robust:
                r = np.abs(y - season - trend)
                h = 6 * np.median(r)
                u = r / h if h > 0 else np.zeros(n)
                rho = np.where(u <= 0.001, 1, np.where(u <= 0.999, (1 - np.minimum(u, 1) ** 2) ** 2, 0))
        return season, trend, y - season - trend

    def decompose(self, df: DataFrame, series: str, time: str, value: str) -> DataFrame:
        """(series, t, seasonal, trend, remainder)"""
        kind, tk = df.schema[series].dataType.simpleString(), df.schema[time].dataType.simpleString()

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("t", "ascending"), ("y", "ascending")])
            s, tr, r = self.decompose_series(self._values(table))
            return pa.table({"series": table["series"], "t": table["t"], "seasonal": s, "trend": tr, "remainder": r})

        return self._groups(df, series, time, value).applyInArrow(run, f"series {kind}, t {tk}, seasonal double, trend double, remainder double")


class VAR(Estimator):
    """Vector autoregression by least squares on lagged rows: a window of lags, then one Gram pass."""

    defaults = {"maxlags": 1, "trend": "c", "blocks": 64}

    def fit(self, df: DataFrame, time: str, columns: list[str]):
        """Lags need the time order: rows are numbered by range partitions, and each joins the rows before it by number."""
        from millrace.learn.base import total

        p, k = int(self.maxlags), len(columns)
        x = df.select(F.col(time).alias("t"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
        num = numbered(x, ["t"])
        lag = num.select("n", F.col("v").alias("l0"))
        for j in range(1, p + 1):
            lag = lag.join(num.select((F.col("n") + j).alias("n"), F.col("v").alias(f"l{j}")), "n")
        one = self.trend == "c"

        def fn(x):
            z = np.column_stack([x[:, k:], np.ones(len(x))]) if one else x[:, k:]
            return {"a": z.T @ z, "b": z.T @ x[:, :k], "c": x[:, :k].T @ x[:, :k], "n": np.array(float(len(x)))}

        s = total(lag.select(F.concat(*[f"l{j}" for j in range(p + 1)]).alias("x")), fn)
        w = np.linalg.solve(s["a"], s["b"])
        res = s["c"] - w.T @ s["b"]
        last = num.orderBy(F.desc("n")).limit(p).collect()
        self.state |= {"columns": list(columns), "coefs": w[: p * k].T.reshape(k, p, k).transpose(1, 0, 2), "intercept": w[p * k] if one else np.zeros(k), "sigma_u": res / (s["n"] - w.shape[0]), "last": np.array([r["v"] for r in last]), "nobs": float(s["n"])}
        return self

    def forecast(self, h: int) -> np.ndarray:
        held, out = [np.asarray(v) for v in self.last_], []
        for _ in range(h):
            out.append(np.asarray(self.intercept_) + sum(np.asarray(a) @ held[j] for j, a in enumerate(np.asarray(self.coefs_))))
            held = [out[-1], *held]
        return np.array(out)


def numbered(df: DataFrame, order: list, out: str = "n") -> DataFrame:
    """Rows numbered from 0 in an order, without one task for all: range partitions, their sizes, an offset each."""
    from millrace.learn.graph import checkpoint

    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mr_p", F.spark_partition_id()).withColumn("_mr_m", F.monotonically_increasing_id())
    part = checkpoint(part.withColumn(out, F.col("_mr_m") - F.shiftleft(F.col("_mr_p").cast("long"), 33)).drop("_mr_m"))
    sizes = sorted((r["_mr_p"], r["n"]) for r in part.groupBy("_mr_p").agg(F.count(F.lit(1)).alias("n")).collect())
    if not sizes:
        return part.drop("_mr_p")
    at, base = 0, []
    for p, n in sizes:
        base += [F.lit(p), F.lit(at)]
        at += n
    return part.withColumn(out, (F.col(out) + F.element_at(F.create_map(*base), F.col("_mr_p"))).cast("long")).drop("_mr_p")


class ProphetForecaster(Estimator):
    """A piecewise linear trend, Fourier seasons and holidays as columns of one ridge regression."""

    defaults = {"n_changepoints": 15, "changepoint_range": 0.8, "changepoint_prior_scale": 0.05, "seasonality_prior_scale": 10.0, "yearly": 6, "weekly": 3, "daily": 0, "holidays_prior_scale": 10.0}

    def _columns(self, t, ds, hold=()):
        """Feature columns of a time column in seconds scaled to t in 0..1."""
        cols = [t]
        cols += [F.greatest(t - F.lit(float(c)), F.lit(0.0)) for c in self.state["changepoints"]]
        for period, n in ((365.25 * 86400, self.yearly), (7 * 86400, self.weekly), (86400, self.daily)):
            for k in range(1, n + 1):
                a = ds * F.lit(2 * math.pi * k / period)
                cols += [F.sin(a), F.cos(a)]
        cols += [(F.floor(ds / 86400) == F.lit(int(d))).cast("double") for d in hold]
        return F.array(*cols)

    def fit(self, df: DataFrame, time: str, value: str, holidays: list[int] = ()):
        """`holidays` are days since 1970-01-01."""
        from millrace.learn.base import moments

        ds = F.col(time).cast("timestamp").cast("double")
        r = df.agg(F.min(ds).alias("a"), F.max(ds).alias("b"), F.max(F.abs(F.col(value).cast("double"))).alias("s")).first()
        span, scale = (r["b"] - r["a"]) or 1.0, r["s"] or 1.0
        n = int(self.n_changepoints)
        self.state |= {"start": r["a"], "span": span, "scale": scale, "time": time, "holidays": list(holidays), "changepoints": [self.changepoint_range * (k + 1) / (n + 1) for k in range(n)]}
        x = self._columns((ds - F.lit(r["a"])) / F.lit(span), ds, holidays)
        m = moments(df.select(x.alias("x"), (F.col(value).cast("double") / F.lit(scale)).alias("y")))
        d = len(m["mean"]) - 1
        seasons = 2 * (self.yearly + self.weekly + self.daily)
        pen = np.concatenate([[1 / 25], np.full(n, 1 / self.changepoint_prior_scale**2), np.full(seasons, 1 / self.seasonality_prior_scale**2), np.full(len(holidays), 1 / self.holidays_prior_scale**2)])
        s = m["scatter"]
        noise = 0.05
        for _ in range(10):
            w = np.linalg.solve(s[:d, :d] / noise**2 + np.diag(pen), s[:d, d] / noise**2)
            rss = s[d, d] - 2 * w @ s[:d, d] + w @ s[:d, :d] @ w
            noise = max(math.sqrt(max(rss, 0) / m["n"]), 1e-6)
        self.state |= {"coef": w, "intercept": float(m["mean"][d] - w @ m["mean"][:d]), "sigma": noise * scale}
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        ds = F.col(self.time_).cast("timestamp").cast("double")
        x = self._columns((ds - F.lit(self.start_)) / F.lit(self.span_), ds, self.holidays_)
        z = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in np.asarray(self.coef_)]), lambda a, b: a * b), F.lit(float(self.intercept_)), lambda s, v: s + v)
        return df.withColumn(out, z * F.lit(self.scale_))
