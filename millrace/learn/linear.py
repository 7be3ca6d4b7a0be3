"""Linear, generalised linear, Bayesian and discriminant estimators.

Least-squares methods need one pass: the Gram matrix of features and targets, whose size depends on the columns alone;
everything after it is arithmetic on the driver. Likelihood methods repeat such a pass with the gradient and the
curvature at the current weights. Predictions are JVM expressions.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.learn.base import Classifier, Regressor, bounded_matrix, classes_of, coded, keyed, linear, mapped, moments, named_class, rows_of, total, vector


class _Linear(Regressor):
    """coef_, intercept_ and their prediction."""

    def predict_column(self, features) -> Column:
        return linear(features, self.coef_, self.intercept_)

    def _solved(self, features, w, b) -> "_Linear":
        self._seen(features)
        self.state |= {"coef": np.asarray(w, float), "intercept": float(b)}
        return self

    def _moments(self, df, features, label, weight=None):
        """Scatter of the features, their product with the target, its own, and the means; raw ones without intercept."""
        m = moments(rows_of(df, features, label, weight))
        s, mean = (m["scatter"], m["mean"]) if self.params.get("fit_intercept", True) else (m["raw"], np.zeros(len(m["mean"])))
        return s[:-1, :-1], s[:-1, -1], float(s[-1, -1]), mean[:-1], float(mean[-1]), m["weight"]

    def _from(self, features, w, mean_x, mean_y):
        return self._solved(features, w, mean_y - w @ mean_x)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-norm solution of a symmetric system, which may be singular."""
    if not len(a):
        return np.zeros_like(b)
    scale = np.sqrt(np.maximum(np.diag(a), 0))
    scale[scale == 0] = 1.0
    e, v = np.linalg.eigh(a / np.outer(scale, scale))
    keep = e > 1e-12 * max(e.max(), 0) if len(e) else e > 0
    return ((v[:, keep] / e[keep]) @ (v[:, keep].T @ (b.T / scale).T)).T.T / (scale if b.ndim == 1 else scale[:, None])


class LinearRegression(_Linear):
    """Ordinary least squares by the Gram matrix about the means."""

    defaults = {"fit_intercept": True}

    def fit(self, df: DataFrame, features, label: str, weight: str | None = None):
        a, b, _, mx, my, _ = self._moments(df, features, label, weight)
        return self._from(features, solve(a, b), mx, my)


class Ridge(_Linear):
    """Least squares with alpha times the squared length of the weights."""

    defaults = {"alpha": 1.0, "fit_intercept": True}

    def fit(self, df, features, label, weight=None):
        a, b, _, mx, my, _ = self._moments(df, features, label, weight)
        return self._from(features, np.linalg.solve(a + self.alpha * np.eye(len(a)), b), mx, my)


def fold_moments(df: DataFrame, features, label: str, folds: int, key: str, seed: int = 0, weight: str | None = None) -> list[dict]:
    """Raw sums of (x, y, 1) for each fold, all in one pass; rows are dealt by a hash of `key`."""
    rows = rows_of(df, features, label, weight, fold=F.pmod(keyed(seed, F.col(key)), F.lit(folds)))

    def fn(x, y, fold, w=None):
        z = np.column_stack([x, y, np.ones(len(x))])
        zw = z if w is None else z * w[:, None]
        return {f"g{k}": zw[fold == k].T @ z[fold == k] for k in range(folds)}

    s = total(rows, fn)
    return [s[f"g{k}"] for k in range(folds)]


def _centred(g: np.ndarray, intercept: bool = True):
    n = g[-1, -1]
    m = g[-1, :-1] / n if intercept else np.zeros(len(g) - 1)
    s = g[:-1, :-1] - np.outer(m, m) * n
    return s[:-1, :-1], s[:-1, -1], float(s[-1, -1]), m[:-1], float(m[-1]), float(n)


def _fold_error(w, b, g) -> float:
    """Mean squared error of weights on a fold's raw sums."""
    v = np.concatenate([-w, [1.0], [-b]])
    return float(v @ g @ v / g[-1, -1])


class RidgeCV(_Linear):
    """Ridge with the alpha of the smallest mean squared error over hash folds; one pass gives all folds' sums."""

    defaults = {"alphas": (0.1, 1.0, 10.0), "cv": 5, "fit_intercept": True, "seed": 0}

    def fit(self, df, features, label, key: str):
        g = fold_moments(df, features, label, self.cv, key, self.seed)
        all_ = sum(g)
        scores = []
        for alpha in self.alphas:
            err = []
            for own in g:
                a, b, _, mx, my, _ = _centred(all_ - own, self.fit_intercept)
                w = np.linalg.solve(a + alpha * np.eye(len(a)), b)
                err.append(_fold_error(w, my - w @ mx, own))
            scores.append(float(np.mean(err)))
        best = int(np.argmin(scores))
        a, b, _, mx, my, _ = _centred(all_, self.fit_intercept)
        self.state |= {"alpha": float(self.alphas[best]), "cv_errors": scores}
        return self._from(features, np.linalg.solve(a + self.alphas[best] * np.eye(len(a)), b), mx, my)


def descend(a: np.ndarray, b: np.ndarray, l1: float, l2: float, start=None, tol: float = 1e-10, max_iter: int = 10_000) -> np.ndarray:
    """min 1/2 w'aw - b'w + l1 |w| + l2/2 w'w by cyclic coordinate descent with soft thresholds."""
    w = np.zeros(len(b)) if start is None else start.copy()
    q = a @ w
    for _ in range(max_iter):
        change = 0.0
        for k in range(len(w)):
            if a[k, k] + l2 <= 0:
                continue
            r = b[k] - q[k] + a[k, k] * w[k]
            new = math.copysign(max(abs(r) - l1, 0.0), r) / (a[k, k] + l2)
            if new != w[k]:
                q += a[:, k] * (new - w[k])
                change = max(change, abs(new - w[k]) * math.sqrt(a[k, k]))
                w[k] = new
        if change <= tol * max(1.0, math.sqrt(abs(float(w @ q)))):
            break
    return w


class ElasticNet(_Linear):
    """Squared error / 2n + alpha (l1_ratio |w| + (1 - l1_ratio)/2 w'w), by coordinate descent on the Gram matrix."""

    defaults = {"alpha": 1.0, "l1_ratio": 0.5, "fit_intercept": True, "max_iter": 10_000, "tol": 1e-10}

    def fit(self, df, features, label, weight=None):
        a, b, _, mx, my, n = self._moments(df, features, label, weight)
        return self._from(features, descend(a / n, b / n, self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio), tol=self.tol, max_iter=self.max_iter), mx, my)


class Lasso(ElasticNet):
    """Elastic net with the absolute penalty alone."""

    defaults = {**ElasticNet.defaults, "l1_ratio": 1.0}


class ElasticNetCV(_Linear):
    """Elastic net with alpha (a geometric grid below the alpha that leaves no weight) and l1_ratio by hash folds."""

    defaults = {"l1_ratio": (0.5,), "eps": 1e-3, "n_alphas": 30, "cv": 5, "fit_intercept": True, "seed": 0}

    def fit(self, df, features, label, key: str):
        g = fold_moments(df, features, label, self.cv, key, self.seed)
        all_ = sum(g)
        a, b, _, mx, my, n = _centred(all_, self.fit_intercept)
        ratios = self.l1_ratio if isinstance(self.l1_ratio, (tuple, list)) else (self.l1_ratio,)
        best = (math.inf,)
        for ratio in ratios:
            top = np.abs(b / n).max() / max(ratio, 1e-3)
            alphas = [top * math.exp(k / max(1, self.n_alphas - 1) * math.log(self.eps)) for k in range(self.n_alphas)]
            errors = np.zeros((self.cv, len(alphas)))
            for f, own in enumerate(g):
                fa, fb, _, fx, fy, fn = _centred(all_ - own, self.fit_intercept)
                w = None
                for k, alpha in enumerate(alphas):
                    w = descend(fa / fn, fb / fn, alpha * ratio, alpha * (1 - ratio), w, 1e-7, 2000)
                    errors[f, k] = _fold_error(w, fy - w @ fx, own)
            for k, e in enumerate(errors.mean(0)):
                if e < best[0]:
                    best = (float(e), float(alphas[k]), float(ratio))
        self.state |= {"alpha": best[1], "l1_ratio": best[2], "cv_error": best[0]}
        return self._from(features, descend(a / n, b / n, best[1] * best[2], best[1] * (1 - best[2])), mx, my)


class LassoCV(ElasticNetCV):
    defaults = {**ElasticNetCV.defaults, "l1_ratio": (1.0,)}


class Lars(_Linear):
    """Least-angle regression from the Gram matrix: alphas_, active_ and the weights after each step (coef_path_)."""

    defaults = {"n_nonzero_coefs": 500, "fit_intercept": True, "lasso": False, "alpha": 0.0}

    def fit(self, df, features, label, weight=None):
        a, b, _, mx, my, n = self._moments(df, features, label, weight)
        a, b = a / n, b / n
        scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
        gram, cov = a / np.outer(scale, scale), b / scale
        d = len(b)
        w, active, path, alphas = np.zeros(d), [], [np.zeros(d)], []
        alphas.append(float(np.abs(cov).max()) if d else 0.0)
        skip: set[int] = set()
        while len(active) < min(d, self.n_nonzero_coefs) or (self.lasso and active):
            c = cov - gram @ w
            top = np.abs(c[active]).max() if active else np.abs(c).max()
            if top <= max(1e-12, self.alpha):
                break
            if not skip:
                free = [k for k in range(d) if k not in active]
                if free:
                    new = max(free, key=lambda k: (abs(c[k]), -k))
                    if not active or abs(c[new]) >= top - 1e-10:
                        active.append(new)
                        top = max(top, abs(c[new]))
            skip = set()
            sign = np.sign(c[active])
            step = np.linalg.lstsq(gram[np.ix_(active, active)], sign, rcond=None)[0]
            corr = gram[:, active] @ step
            gamma = top
            for k in range(d):
                if k not in active:
                    for num, den in ((top - c[k], 1 - corr[k]), (top + c[k], 1 + corr[k])):
                        if den > 1e-12 and 1e-12 < num / den < gamma:
                            gamma = num / den
            if self.lasso:
                gone = None
                for pos, k in enumerate(active):
                    if step[pos] and 1e-12 < -w[k] / step[pos] < gamma:
                        gamma, gone = -w[k] / step[pos], pos
                gamma = min(gamma, top - self.alpha) if top - self.alpha < gamma else gamma
            w[active] += gamma * step
            if self.lasso and gone is not None:
                w[active[gone]] = 0.0
                skip = {active.pop(gone)}
            path.append(w.copy())
            alphas.append(float(top - gamma))
            if len(active) == d and not skip and gamma >= top - 1e-12 or len(path) > 8 * d + 8:
                break
        self.state |= {"active": list(active), "alphas": alphas, "coef_path": np.array(path) / scale}
        return self._from(features, w / scale, mx, my)


class LassoLars(Lars):
    """The lasso path by least angles, down to `alpha` (on standardised features)."""

    defaults = {**Lars.defaults, "lasso": True, "alpha": 0.01}


class BayesianRidge(_Linear):
    """Ridge whose two precisions maximise the evidence; sigma_ is the weights' covariance. lambda_1 and friends are the
    gamma priors' parameters."""

    defaults = {"max_iter": 300, "tol": 1e-6, "alpha_1": 1e-6, "alpha_2": 1e-6, "lambda_1": 1e-6, "lambda_2": 1e-6, "fit_intercept": True}

    def fit(self, df, features, label, weight=None):
        a, b, yy, mx, my, n = self._moments(df, features, label, weight)
        e, v = np.linalg.eigh(a)
        e = np.maximum(e, 0)
        alpha, lam, w = 1 / max(yy / n, 1e-300), 1.0, np.zeros(len(b))
        for _ in range(self.max_iter):
            new = v @ ((v.T @ b) / (e + lam / alpha))
            rss = max(yy - 2 * new @ b + new @ a @ new, 1e-300)
            gamma = (alpha * e / (lam + alpha * e)).sum()
            lam = (gamma + 2 * self.lambda_1) / (new @ new + 2 * self.lambda_2)
            alpha = (n - gamma + 2 * self.alpha_1) / (rss + 2 * self.alpha_2)
            done, w = np.abs(new - w).sum() < self.tol * max(1.0, np.abs(new).sum()), new
            if done:
                break
        self.state |= {"alpha": float(alpha), "lambda": float(lam), "sigma": v @ np.diag(1 / (lam + alpha * e)) @ v.T, "mean_x": mx}
        return self._from(features, w, mx, my)

    def std_column(self, features) -> Column:
        s, m, noise = np.asarray(self.sigma_), np.asarray(self.mean_x_), 1 / self.alpha_
        return mapped(lambda x: np.sqrt((((x - m) @ s) * (x - m)).sum(1) + noise), features)


class ARDRegression(_Linear):
    """Bayesian regression with a precision per weight; weights whose precision passes the threshold are dropped."""

    defaults = {"max_iter": 300, "tol": 1e-6, "threshold_lambda": 1e4, "alpha_1": 1e-6, "alpha_2": 1e-6, "lambda_1": 1e-6, "lambda_2": 1e-6, "fit_intercept": True}

    def fit(self, df, features, label, weight=None):
        a, b, yy, mx, my, n = self._moments(df, features, label, weight)
        lam, alpha, w, keep = np.ones(len(b)), 1 / max(yy / n, 1e-300), np.zeros(len(b)), np.ones(len(b), bool)
        for _ in range(self.max_iter):
            own = np.nonzero(keep)[0]
            if not len(own):
                break
            sigma = np.linalg.inv(alpha * a[np.ix_(own, own)] + np.diag(lam[own]))
            new = np.zeros(len(b))
            new[own] = alpha * sigma @ b[own]
            gamma = 1 - lam[own] * np.diag(sigma)
            lam[own] = (gamma + 2 * self.lambda_1) / (new[own] ** 2 + 2 * self.lambda_2)
            rss = max(yy - 2 * new @ b + new @ a @ new, 1e-300)
            alpha = (n - gamma.sum() + 2 * self.alpha_1) / (rss + 2 * self.alpha_2)
            keep &= lam < self.threshold_lambda * max(1.0, lam[own].min())
            new[~keep] = 0
            done, w = np.abs(new - w).sum() < self.tol * max(1.0, np.abs(new).sum()), new
            if done:
                break
        self.state |= {"alpha": float(alpha), "lambda": lam}
        return self._from(features, w, mx, my)


# --- likelihood methods -------------------------------------------------------------------------------------------


def newton(rows: DataFrame, fn, start: np.ndarray, ridge: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, int]:
    """Minimise the sum over rows plus ridge/2 w'w by damped Newton steps.

    fn(w, x, y, weight) gives each batch's (value, gradient, curvature). Each pass evaluates one point; a step that
    does not lower the value is halved.
    """
    rows = rows.persist()
    try:
        def at(w):
            def batch(x, y=None, w_=None, **more):
                v, g, h = fn(w, x, y, np.ones(len(x)) if w_ is None else w_)
                return {"v": np.array(v), "g": g, "h": h}

            s = total(rows.withColumnRenamed("w", "w_") if "w" in rows.columns else rows, batch)
            if not s:
                raise ValueError("no rows to fit")
            return float(s["v"]) + 0.5 * float(ridge @ (w * w)), s["g"] + ridge * w, s["h"] + np.diag(ridge)

        w = start
        value, g, h = at(w)
        for k in range(max_iter):
            step = solve(h + 1e-10 * np.trace(h) / len(h) * np.eye(len(h)), g)
            size = 1.0
            while True:
                new = w - size * step
                v2, g2, h2 = at(new)
                if v2 <= value + 1e-12 * abs(value) or size < 1e-4:
                    break
                size /= 4
            small = value - v2 <= tol * max(1.0, abs(value))
            if v2 <= value:
                w, value, g, h = new, v2, g2, h2
            if small:
                return w, k + 1
        return w, max_iter
    finally:
        rows.unpersist()


def quasi_newton(value_and_gradient, start: np.ndarray, l1: np.ndarray | None = None, max_iter: int = 100, tol: float = 1e-6, memory: int = 10) -> tuple[np.ndarray, int]:
    """L-BFGS; with an absolute penalty l1 its orthant-wise form. Each evaluation is one pass over the rows."""
    l1 = np.zeros(len(start)) if l1 is None else l1
    w = start.copy()
    v, g = value_and_gradient(w)

    def pseudo(w, g):
        up, down = g + l1, g - l1
        return np.where(w > 0, up, np.where(w < 0, down, np.where(down > 0, down, np.where(up < 0, up, 0.0))))

    full = v + l1 @ np.abs(w)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for it in range(max_iter):
        pg = pseudo(w, g)
        if np.abs(pg).max(initial=0) <= tol * max(1.0, np.abs(w).max(initial=0)):
            return w, it
        q, alphas = pg.copy(), []
        for s, y in reversed(held):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if held:
            s, y = held[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(held, reversed(alphas)):
            q += s * (a - (y @ q) / (s @ y))
        q = np.where(q * pg > 0, q, 0.0) if l1.any() else q
        slope = float(pg @ q)
        if slope <= 0:
            q, slope, held = pg, float(pg @ pg), []
        size = 1.0 if held else min(1.0, 1 / max(np.abs(pg).sum(), 1e-12))
        orthant = np.where(w != 0, np.sign(w), -np.sign(pg))
        for _ in range(25):
            new = w - size * q
            if l1.any():
                new = np.where((new * orthant < 0) & (l1 > 0), 0.0, new)
            v2, g2 = value_and_gradient(new)
            if v2 + l1 @ np.abs(new) <= full - 1e-4 * size * slope:
                break
            size /= 2
        else:
            return w, it
        s, y = new - w, g2 - g
        if s @ y > 1e-12 * (y @ y):
            held = [*held[-(memory - 1):], (s, y)]
        done = full - (v2 + l1 @ np.abs(new)) <= 1e-10 * max(1.0, abs(full))
        w, v, g, full = new, v2, g2, v2 + l1 @ np.abs(new)
        if done:
            return w, it + 1
    return w, max_iter


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


class LogisticRegression(Classifier):
    """Logistic regression of two or more classes (softmax), with an l1, l2 or elastic-net penalty.

    The objective is C times the summed log loss plus the penalty, as a sum over rows (weights and class weights count).
    Without an absolute penalty two classes take Newton steps; otherwise quasi-Newton steps, orthant-wise for l1.
    """

    defaults = {"C": 1.0, "penalty": "l2", "l1_ratio": 0.0, "fit_intercept": True, "class_weight": None, "max_iter": 100, "tol": 1e-8}

    def fit(self, df, features, label, weight=None):
        classes = classes_of(df, label)
        if len(classes) < 2:
            raise ValueError("one class only")
        self._seen(features)
        code = coded(label, classes)
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        if self.class_weight is not None:
            by = self.class_weight
            if by == "balanced":
                n = {r["y"]: r["n"] for r in df.select(code.alias("y"), w.alias("w")).groupBy("y").agg(F.sum("w").alias("n")).collect()}
                by = {c: sum(n.values()) / (len(classes) * n[k]) for k, c in enumerate(classes)}
            w = w * reduce(lambda o, c: F.when(F.col(label) == F.lit(c), F.lit(float(by[c]))).otherwise(o), by, F.lit(1.0))
        rows = rows_of(df, features, code, w)
        d = len(rows.select("x").first()["x"])
        one, k = int(self.fit_intercept), 1 if len(classes) == 2 else len(classes)
        l1r = {"l1": 1.0, "l2": 0.0, "elasticnet": self.l1_ratio, None: 0.0}[self.penalty]
        strength = 0.0 if self.penalty is None else 1.0
        pen = np.concatenate([np.ones(d), np.zeros(one)])
        c = float(self.C)

        if k == 1 and l1r == 0:
            def fn(v, x, y, w):
                z = np.column_stack([x, np.ones(len(x))]) if one else x
                m = z @ v
                p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
                return c * float((w * (np.logaddexp(0, m) - y * m)).sum()), c * z.T @ (w * (p - y)), c * (z * (w * p * (1 - p))[:, None]).T @ z

            v, it = newton(rows, fn, np.zeros(d + one), strength * pen, self.max_iter, self.tol)
            coef = v[None]
        else:
            rows = rows.withColumnRenamed("w", "w_").persist()

            def value(v):
                v = v.reshape(k, d + one)

                def batch(x, y, w_):
                    z = np.column_stack([x, np.ones(len(x))]) if one else x
                    m = z @ v.T
                    if k == 1:
                        p = 1 / (1 + np.exp(-np.clip(m[:, 0], -700, 700)))
                        return {"v": np.array((w_ * (np.logaddexp(0, m[:, 0]) - y * m[:, 0])).sum()), "g": ((w_ * (p - y)) @ z)[None]}
                    y = y.astype(int)
                    p = _softmax(m)
                    loss = -(w_ * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
                    p[np.arange(len(y)), y] -= 1
                    return {"v": np.array(loss), "g": (p * w_[:, None]).T @ z}

                s = total(rows, batch)
                l2 = strength * (1 - l1r) * pen
                return c * float(s["v"]) + 0.5 * float((l2 * v * v).sum()), (c * s["g"] + l2 * v).ravel()

            try:
                v, it = quasi_newton(value, np.zeros(k * (d + one)), strength * l1r * np.tile(pen, k), self.max_iter, max(self.tol, 1e-6))
            finally:
                rows.unpersist()
            coef = v.reshape(k, d + one)
        self.state |= {"classes": classes, "coef": coef[:, :d], "intercept": coef[:, d] if one else np.zeros(k), "n_iter": it}
        return self

    def decision_column(self, features) -> Column:
        if len(self.coef_) == 1:
            return linear(features, self.coef_[0], self.intercept_[0])
        return F.array(*[linear(features, w, b) for w, b in zip(self.coef_, self.intercept_)])

    def proba_column(self, features) -> Column:
        """Probabilities in the order of classes_."""
        z = self.decision_column(features)
        if len(self.coef_) == 1:
            p = F.lit(1.0) / (1 + F.exp(-z))
            return F.array(1 - p, p)
        e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, u: s + u))

    def predict_column(self, features) -> Column:
        z = self.decision_column(features)
        code = (z > 0).cast("int") if len(self.coef_) == 1 else F.array_position(z, F.array_max(z)).cast("int") - 1
        return named_class(code, self.classes_)


class LogisticRegressionCV(LogisticRegression):
    """Logistic regression with the C of the best mean accuracy over hash folds; ties keep the smaller C."""

    defaults = {**LogisticRegression.defaults, "Cs": (0.01, 1.0, 100.0), "cv": 3, "seed": 0}

    def fit(self, df, features, label, key: str, weight=None):
        fold = F.pmod(keyed(self.seed, F.col(key)), F.lit(int(self.cv)))
        own = {k: v for k, v in self.params.items() if k in LogisticRegression.defaults}
        scores = []
        for c in self.Cs:
            each = []
            for f in range(self.cv):
                m = LogisticRegression(**{**own, "C": c}).fit(df.where(fold != f), features, label, weight)
                each.append(m.score(df.where(fold == f), label))
            scores.append(float(np.mean(each)))
        best = self.Cs[int(np.argmax(scores))]
        final = LogisticRegression(**{**own, "C": best}).fit(df, features, label, weight)
        self.state |= {**final.state, "C": best, "scores": scores}
        return self


class RidgeClassifier(Classifier):
    """Ridge on one target of -1 and 1 per class; two classes have one. One Gram matrix serves all targets."""

    defaults = {"alpha": 1.0}

    def fit(self, df, features, label, weight=None):
        classes = classes_of(df, label)
        self._seen(features)
        k = len(classes)

        def fn(x, y, w=None):
            t = np.where(y[:, None] == np.arange(k)[None], 1.0, -1.0)
            z = np.column_stack([x, t, np.ones(len(x))])
            return {"g": (z if w is None else z * w[:, None]).T @ z}

        g = total(rows_of(df, features, coded(label, classes), weight), fn)["g"]
        n, d = g[-1, -1], len(g) - 1 - k
        m = g[-1, :-1] / n
        s = g[:-1, :-1] - np.outer(m, m) * n
        w = np.linalg.solve(s[:d, :d] + self.alpha * np.eye(d), s[:d, d:]).T
        b = m[d:] - w @ m[:d]
        if k == 2:
            w, b = w[1:], b[1:]
        self.state |= {"classes": classes, "coef": w, "intercept": b}
        return self

    decision_column = LogisticRegression.decision_column
    predict_column = LogisticRegression.predict_column


class _Glm(Regressor):
    """Log-link models by Newton steps on the mean deviance / 2 plus alpha / 2 w'w."""

    defaults = {"alpha": 1.0, "fit_intercept": True, "max_iter": 100, "tol": 1e-10}
    power = 1.0

    def fit(self, df, features, label, weight=None):
        self._seen(features)
        rows = rows_of(df, features, label, weight)
        p, one = float(self.params.get("power", self.power)), int(self.fit_intercept)
        identity = self.params.get("link", "auto") == "identity" or (self.params.get("link", "auto") == "auto" and p <= 0)
        first = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.min("y").alias("lo"), F.sum(F.col("w") if weight else F.lit(1.0)).alias("w")).first()
        if first["lo"] is None or (p >= 1 and first["lo"] < 0) or (p >= 2 and first["lo"] <= 0):
            raise ValueError("a target is outside the distribution's range")
        d, n = len(rows.select("x").first()["x"]), first["w"]

        def fn(v, x, y, w):
            z = np.column_stack([x, np.ones(len(x))]) if one else x
            eta = z @ v
            if identity:
                return 0.5 * float((w * (y - eta) ** 2).sum()) / n, z.T @ (w * (eta - y)) / n, (z * w[:, None]).T @ z / n
            mu = np.exp(np.clip(eta, -500, 500))
            if p == 1:
                value = mu - y * eta
            elif p == 2:
                value = y / mu + eta
            else:
                value = -y * mu ** (1 - p) / (1 - p) + mu ** (2 - p) / (2 - p)
            grad = mu ** (1 - p) * (mu - y)
            curve = mu ** (2 - p)
            return float((w * value).sum()) / n, z.T @ (w * grad) / n, (z * (w * curve)[:, None]).T @ z / n

        start = np.zeros(d + one)
        if one:
            start[-1] = first["m"] if identity else math.log(max(first["m"], 1e-300))
        v, it = newton(rows, fn, start, self.alpha * np.concatenate([np.ones(d), np.zeros(one)]), self.max_iter, self.tol)
        self.state |= {"coef": v[:d], "intercept": float(v[d]) if one else 0.0, "n_iter": it, "identity": identity}
        return self

    def predict_column(self, features) -> Column:
        z = linear(features, self.coef_, self.intercept_)
        return z if self.identity_ else F.exp(z)


class PoissonRegressor(_Glm):
    power = 1.0


class GammaRegressor(_Glm):
    power = 2.0


class TweedieRegressor(_Glm):
    """Variance in proportion to the mean's `power`; link is log, or identity at power 0."""

    defaults = {**_Glm.defaults, "power": 0.0, "link": "auto"}


class HuberRegressor(_Linear):
    """Huber's loss with a scale fitted along with the weights, by reweighted least squares passes."""

    defaults = {"epsilon": 1.35, "alpha": 1e-4, "max_iter": 100, "tol": 1e-8, "fit_intercept": True}

    def fit(self, df, features, label, weight=None):
        rows = rows_of(df, features, label, weight)
        d, one = len(rows.select("x").first()["x"]), int(self.fit_intercept)
        eps, pen = float(self.epsilon), 2 * self.alpha * np.concatenate([np.ones(d), np.zeros(one), [0.0]])
        first = rows.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()

        def fn(v, x, y, w):
            sigma = math.exp(v[-1])
            z = np.column_stack([x, np.ones(len(x))]) if one else x
            r = (y - z @ v[:-1]) / sigma
            far = np.abs(r) > eps
            h = np.where(far, 2 * eps * np.abs(r) - eps * eps, r * r)
            dh, ddh = np.where(far, 2 * eps * np.sign(r), 2 * r), np.where(far, 1e-8, 2.0)
            value = float((w * (sigma + sigma * h)).sum())
            g = np.concatenate([-z.T @ (w * dh), [sigma * float((w * (1 + h - dh * r)).sum())]])
            cross = z.T @ (w * ddh * r)
            hh = np.empty((len(v), len(v)))
            hh[:-1, :-1] = (z * (w * ddh / sigma)[:, None]).T @ z
            hh[:-1, -1] = hh[-1, :-1] = cross
            hh[-1, -1] = sigma * float((w * np.maximum(1 + h - dh * r + ddh * r * r, 1e-8)).sum())
            return value, g, hh

        start = np.zeros(d + one + 1)
        if one:
            start[d] = first["m"]
        start[-1] = math.log(max(first["s"] or 1.0, 1e-12))
        v, it = newton(rows, fn, start, pen, self.max_iter, self.tol)
        self.state |= {"scale": math.exp(v[-1]), "n_iter": it}
        return self._solved(features, v[:d], v[d] if one else 0.0)


class QuantileRegressor(_Linear):
    """Pinball loss / n plus alpha |w|, by reweighted least squares whose smoothing shrinks each pass.

    The linear program's optimum is approached to about 1e-6 of the residuals' scale.
    """

    defaults = {"quantile": 0.5, "alpha": 1.0, "fit_intercept": True, "max_iter": 60}

    def fit(self, df, features, label, weight=None):
        rows = rows_of(df, features, label, weight).persist()
        try:
            d, one, q = len(rows.select("x").first()["x"]), int(self.fit_intercept), float(self.quantile)
            s = rows.agg(F.percentile("y", q).alias("m"), F.stddev_pop("y").alias("s"), F.sum(F.col("w") if weight else F.lit(1.0)).alias("n")).first()
            v, scale = np.zeros(d + one), s["s"] or 1.0
            if one:
                v[-1] = s["m"]
            eps = 0.1 * scale
            for _ in range(self.max_iter):
                def fn(x, y, w=None, v=v, eps=eps):
                    z = np.column_stack([x, np.ones(len(x))]) if one else x
                    r = y - z @ v
                    # |r| <= (r^2 / a + a) / 2 at a = max(|r|, eps): the pinball loss is |r| / 2 + (q - 1/2) r
                    u = (np.ones(len(x)) if w is None else w) / np.maximum(np.abs(r), eps) / 2
                    lin = (q - 0.5) * (np.ones(len(x)) if w is None else w)
                    return {"h": (z * u[:, None]).T @ z, "b": z.T @ (u * y + lin)}

                t = total(rows, fn)
                pen = np.concatenate([self.alpha / np.maximum(np.abs(v[:d]), 1e-8), np.zeros(one)]) * s["n"]
                new = np.linalg.solve(t["h"] + np.diag(pen) + 1e-14 * np.trace(t["h"]) * np.eye(len(v)), t["b"])
                moved, v = np.abs(new - v).max(), new
                if eps <= 1e-7 * scale and moved <= 1e-7 * max(1.0, np.abs(v).max()):
                    break
                eps = max(eps / 2, 1e-7 * scale)
        finally:
            rows.unpersist()
        w = np.where(np.abs(v[:d]) < 1e-7, 0.0, v[:d])
        return self._solved(features, w, v[d] if one else 0.0)


class QNRegressor(Classifier):
    """Quasi-Newton fits of the losses logistic, squared, softmax, svc_l1, svc_l2, svr_l1, svr_l2 and abs.

    The objective is the mean loss plus l1 |w| plus l2 / 2 w'w.
    """

    defaults = {"loss": "squared", "l1": 0.0, "l2": 0.0, "epsilon": 0.0, "fit_intercept": True, "max_iter": 200, "tol": 1e-6}
    two = ("logistic", "svc_l1", "svc_l2")

    def fit(self, df, features, label, weight=None):
        self._seen(features)
        loss, eps, one = self.loss, float(self.epsilon), int(self.fit_intercept)
        classes = classes_of(df, label) if loss in (*self.two, "softmax") else None
        y = coded(label, classes) if classes else F.col(label)
        rows = rows_of(df, features, y, weight).withColumnRenamed("w", "w_").persist()
        try:
            d, n = len(rows.select("x").first()["x"]), rows.agg(F.sum("w_") if weight else F.count(F.lit(1))).first()[0]
            k = len(classes) if loss == "softmax" else 1
            pen = np.tile(np.concatenate([np.ones(d), np.zeros(one)]), k)

            def value(v):
                v2 = v.reshape(k, d + one)

                def batch(x, y, w_=None):
                    z = np.column_stack([x, np.ones(len(x))]) if one else x
                    w_ = np.ones(len(x)) if w_ is None else w_
                    if loss == "softmax":
                        y = y.astype(int)
                        p = _softmax(z @ v2.T)
                        value = -(w_ * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
                        p[np.arange(len(y)), y] -= 1
                        return {"v": np.array(value), "g": (p * w_[:, None]).T @ z}
                    m = z @ v2[0]
                    s = 2 * y - 1
                    if loss == "logistic":
                        f, g = np.logaddexp(0, -s * m), -s / (1 + np.exp(np.clip(s * m, -700, 700)))
                    elif loss in ("svc_l1", "svc_l2"):
                        h = np.maximum(0, 1 - s * m)
                        f, g = (h, -s * (h > 0)) if loss == "svc_l1" else (h * h, -2 * s * h)
                    else:
                        r = m - y
                        if loss == "squared":
                            f, g = 0.5 * r * r, r
                        else:
                            h = np.maximum(0, np.abs(r) - (eps if loss.startswith("svr") else 0))
                            f, g = (h * h, 2 * h * np.sign(r)) if loss == "svr_l2" else (h, np.sign(r) * (h > 0))
                    return {"v": np.array((w_ * f).sum()), "g": ((w_ * g) @ z)[None]}

                t = total(rows, batch)
                return float(t["v"]) / n + 0.5 * self.l2 * float((pen * v * v).sum()), t["g"].ravel() / n + self.l2 * pen * v

            v, it = quasi_newton(value, np.zeros(k * (d + one)), self.l1 * pen, self.max_iter, self.tol)
        finally:
            rows.unpersist()
        v = v.reshape(k, d + one)
        self.state |= {"coef": v[:, :d], "intercept": v[:, d] if one else np.zeros(k), "n_iter": it, "classes": classes or []}
        return self

    decision_column = LogisticRegression.decision_column

    def predict_column(self, features) -> Column:
        return LogisticRegression.predict_column(self, features) if self.classes_ else self.decision_column(features)


class LinearSVC(Classifier):
    """Squared hinge loss, one against the rest, by Newton steps: 1/2 w'w + C sum max(0, 1 - y f)^2; the intercept is
    penalised like a weight."""

    defaults = {"C": 1.0, "fit_intercept": True, "max_iter": 50, "tol": 1e-9}

    def fit(self, df, features, label, weight=None):
        classes = classes_of(df, label)
        self._seen(features)
        one, c = int(self.fit_intercept), float(self.C)

        def fn(v, x, y, w):
            z = np.column_stack([x, np.ones(len(x))]) if one else x
            s = np.where(y > 0, 1.0, -1.0)
            h = np.maximum(0, 1 - s * (z @ v))
            on = w * (h > 0)
            return c * float((w * h * h).sum()), -2 * c * z.T @ (w * s * h), 2 * c * (z * on[:, None]).T @ z

        found = []
        for k in range(1 if len(classes) == 2 else len(classes)):
            y = (coded(label, classes) == (1 if len(classes) == 2 else k)).cast("double")
            rows = rows_of(df, features, y, weight)
            d = len(rows.select("x").first()["x"])
            found.append(newton(rows, fn, np.zeros(d + one), np.ones(d + one), self.max_iter, self.tol)[0])
        v = np.array(found)
        self.state |= {"classes": classes, "coef": v[:, :d], "intercept": v[:, d] if one else np.zeros(len(v))}
        return self

    decision_column = LogisticRegression.decision_column
    predict_column = LogisticRegression.predict_column


class LinearSVR(_Linear):
    """1/2 w'w + C sum max(0, |r| - epsilon)^2 by Newton steps; loss="epsilon_insensitive" takes quasi-Newton ones."""

    defaults = {"C": 1.0, "epsilon": 0.0, "loss": "squared_epsilon_insensitive", "fit_intercept": True, "max_iter": 100, "tol": 1e-9}

    def fit(self, df, features, label, weight=None):
        one, c, eps = int(self.fit_intercept), float(self.C), float(self.epsilon)
        rows = rows_of(df, features, label, weight)
        d = len(rows.select("x").first()["x"])

        def fn(v, x, y, w):
            z = np.column_stack([x, np.ones(len(x))]) if one else x
            r = z @ v - y
            h = np.maximum(0, np.abs(r) - eps)
            if self.loss == "epsilon_insensitive":
                return c * float((w * h).sum()), c * z.T @ (w * np.sign(r) * (h > 0)), c * (z * (w * (h > 0) / np.maximum(np.abs(r), 1e-6))[:, None]).T @ z
            return c * float((w * h * h).sum()), 2 * c * z.T @ (w * np.sign(r) * h), 2 * c * (z * (w * (h > 0))[:, None]).T @ z

        v, _ = newton(rows, fn, np.zeros(d + one), np.ones(d + one), self.max_iter, self.tol)
        return self._solved(features, v[:d], v[d] if one else 0.0)


# --- stochastic gradients -------------------------------------------------------------------------------------------


class _Sgd(Classifier):
    """Epochs of steps row by row in a keyed order.

    Rows are dealt to `parts` groups by a hash of seed and key; within a group their order is another hash of seed,
    epoch and key. Each group steps through its rows from the epoch's common weights, then the groups' weights are
    averaged by their numbers of rows. With parts=1 it is the plain sequential method, whose one task then sees every
    row; more parts bound what a task sees.
    """

    def _run(self, df, features, y: Column, key: str, step, width: int, weight=None, extra: int = 0) -> np.ndarray:
        rows = rows_of(df, features, y, weight, at=F.col(key))
        parts, seed = int(self.parts), int(self.seed)
        rows = rows.repartition(parts, F.pmod(keyed(seed, F.col("at")), F.lit(parts)))
        rows = rows.persist()
        v = np.zeros(width + extra)
        try:
            n = rows.count()
            for epoch in range(int(self.max_iter)):
                def run(batches, v=v, epoch=epoch):
                    import pyarrow as pa

                    from millrace.learn.base import _batch, _packed

                    own, seen = v.copy(), 0
                    t = epoch * max(1, n // parts)
                    for b in batches:
                        c = _batch(b, True)
                        for i in range(len(c["x"])):
                            t += 1
                            own = step(own, c["x"][i], c["y"][i], c["w"][i] if "w" in c else 1.0, t)
                        seen += len(c["x"])
                    yield _packed({"v": own * seen, "n": np.array([float(seen)])} if seen else {})
                    _ = pa

                from millrace.learn.base import _added

                ordered = rows.sortWithinPartitions(keyed(seed + 1 + epoch, F.col("at")), "at").drop("at")
                s = _added(ordered.mapInArrow(run, "name string, shape array<int>, v array<double>").toArrow().to_batches())
                if not s:
                    raise ValueError("no rows to fit")
                new = s["v"] / s["n"][0]
                small, v = np.abs(new - v).max() <= self.tol * max(1.0, np.abs(new).max()), new
                if small:
                    break
        finally:
            rows.unpersist()
        self.state["n_iter"] = epoch + 1
        return v

    def _rate(self, t: int) -> float:
        kind = self.learning_rate
        if kind == "constant":
            return self.eta0
        if kind == "invscaling":
            return self.eta0 / t**self.power_t
        typical = math.sqrt(1 / math.sqrt(max(self.alpha, 1e-12)))
        return 1 / (max(self.alpha, 1e-12) * (t + 1 / (typical * max(self.alpha, 1e-12))))

    def _binary(self, df, features, label, key, weight, gradient):
        classes = classes_of(df, label)
        self._seen(features)
        d = len(df.select(vector(features).alias("x")).first()["x"])
        found = []
        for k in range(1 if len(classes) == 2 else len(classes)):
            y = F.when(coded(label, classes) == (1 if len(classes) == 2 else k), 1.0).otherwise(-1.0)
            found.append(self._run(df, features, y, key, gradient, d + 1, weight))
        v = np.array(found)
        self.state |= {"classes": classes, "coef": v[:, :d], "intercept": v[:, d]}
        return self

    decision_column = LogisticRegression.decision_column
    predict_column = LogisticRegression.predict_column


_SGD = {"penalty": "l2", "alpha": 1e-4, "l1_ratio": 0.15, "learning_rate": "optimal", "eta0": 0.01, "power_t": 0.25, "max_iter": 20, "tol": 1e-4, "parts": 1, "seed": 0}


def _shrunk(v, rate, self):
    """The penalty's part of a step: shrink towards zero, by steps of the absolute penalty through a soft threshold."""
    l1 = {"l1": 1.0, "l2": 0.0, "elasticnet": self.l1_ratio}.get(self.penalty, 0.0)
    if self.penalty is None:
        return v
    w = v[:-1] * max(0.0, 1 - rate * self.alpha * (1 - l1))
    if l1:
        w = np.sign(w) * np.maximum(np.abs(w) - rate * self.alpha * l1, 0)
    return np.append(w, v[-1])


class SGDClassifier(_Sgd):
    """Losses hinge, log_loss, modified_huber, squared_hinge and perceptron, one against the rest."""

    defaults = {"loss": "hinge", **_SGD}

    def fit(self, df, features, label, key: str, weight=None):
        loss = self.loss

        def slope(m, y):
            if loss == "log_loss":
                return -y / (1 + math.exp(min(700, y * m)))
            if loss == "squared_hinge":
                return -2 * y * max(0.0, 1 - y * m)
            if loss == "modified_huber":
                return -4 * y if y * m < -1 else -2 * y * max(0.0, 1 - y * m)
            return -y if y * m < (0 if loss == "perceptron" else 1) or (loss == "perceptron" and y * m <= 0) else 0.0

        def step(v, x, y, w, t):
            rate = self._rate(t)
            g = slope(float(x @ v[:-1]) + v[-1], y) * w
            v = _shrunk(v, rate, self)
            return v - rate * g * np.append(x, 1.0) if g else v

        return self._binary(df, features, label, key, weight, step)


class Perceptron(_Sgd):
    """A step of the row itself whenever it is on the wrong side."""

    defaults = {**_SGD, "penalty": None, "alpha": 1e-4, "learning_rate": "constant", "eta0": 1.0}

    def fit(self, df, features, label, key: str, weight=None):
        def step(v, x, y, w, t):
            v = _shrunk(v, self.eta0, self)
            return v + self.eta0 * w * y * np.append(x, 1.0) if y * (float(x @ v[:-1]) + v[-1]) <= 0 else v

        return self._binary(df, features, label, key, weight, step)


class PassiveAggressiveClassifier(_Sgd):
    """The smallest step that gives a row its margin, limited by C (hinge) or damped by it (squared_hinge)."""

    defaults = {"C": 1.0, "loss": "hinge", "max_iter": 20, "tol": 1e-4, "parts": 1, "seed": 0}

    def fit(self, df, features, label, key: str, weight=None):
        def step(v, x, y, w, t):
            z = np.append(x, 1.0)
            miss = max(0.0, 1 - y * float(z @ v))
            size = miss / (z @ z + 0.5 / self.C) if self.loss == "squared_hinge" else min(self.C, miss / (z @ z))
            return v + w * size * y * z if miss else v

        return self._binary(df, features, label, key, weight, step)


class SGDRegressor(_Sgd):
    """Losses squared_error, huber, epsilon_insensitive and squared_epsilon_insensitive."""

    defaults = {"loss": "squared_error", "epsilon": 0.1, **_SGD, "learning_rate": "invscaling"}

    def fit(self, df, features, label, key: str, weight=None):
        self._seen(features)
        d = len(df.select(vector(features).alias("x")).first()["x"])

        def step(v, x, y, w, t):
            rate = self._rate(t)
            r = float(x @ v[:-1]) + v[-1] - y
            far = max(0.0, abs(r) - self.epsilon)
            g = {"squared_error": r, "huber": math.copysign(min(abs(r), self.epsilon), r), "epsilon_insensitive": math.copysign(1.0, r) if far else 0.0, "squared_epsilon_insensitive": 2 * math.copysign(far, r)}[self.loss]
            return _shrunk(v, rate, self) - rate * w * g * np.append(x, 1.0)

        v = self._run(df, features, F.col(label), key, step, d + 1, weight)
        self.state |= {"coef": v[:d], "intercept": float(v[d])}
        return self

    def predict_column(self, features) -> Column:
        return linear(features, self.coef_, self.intercept_)

    score = Regressor.score


class PassiveAggressiveRegressor(SGDRegressor):
    """The smallest step that brings a row within epsilon, limited by C."""

    defaults = {"C": 1.0, "epsilon": 0.1, "loss": "epsilon_insensitive", "max_iter": 20, "tol": 1e-4, "parts": 1, "seed": 0}

    def fit(self, df, features, label, key: str, weight=None):
        self._seen(features)
        d = len(df.select(vector(features).alias("x")).first()["x"])

        def step(v, x, y, w, t):
            z = np.append(x, 1.0)
            r = y - float(z @ v)
            far = max(0.0, abs(r) - self.epsilon)
            size = far / (z @ z + 0.5 / self.C) if self.loss.startswith("squared") else min(self.C, far / (z @ z))
            return v + w * size * math.copysign(1.0, r) * z if far else v

        v = self._run(df, features, F.col(label), key, step, d + 1, weight)
        self.state |= {"coef": v[:d], "intercept": float(v[d])}
        return self


class SGDOneClassSVM(SGDRegressor):
    """A half-space that holds all but a share nu of the rows; decision = x . w - offset."""

    defaults = {"nu": 0.5, **{**_SGD, "learning_rate": "invscaling", "eta0": 0.1, "power_t": 0.5}}

    def fit(self, df, features, key: str, weight=None):
        self._seen(features)
        d = len(df.select(vector(features).alias("x")).first()["x"])

        def step(v, x, y, w, t):
            rate = self._rate(t)
            inside = float(x @ v[:-1]) - v[-1]
            v = np.append(v[:-1] * max(0.0, 1 - rate * self.nu / 2), v[-1] + rate * self.nu)
            return v + rate * np.append(x, -1.0) * w if inside < 0 or (inside == 0 and t == 1) else v

        v = self._run(df, features, F.lit(0.0), key, step, d + 1, weight)
        self.state |= {"coef": v[:d], "offset": float(v[d])}
        return self

    def decision_column(self, features) -> Column:
        return linear(features, self.coef_, -self.offset_)

    def predict_column(self, features) -> Column:
        return F.when(self.decision_column(features) >= 0, 1).otherwise(-1)


# --- order -----------------------------------------------------------------------------------------------------------


class IsotonicRegression(Regressor):
    """Pooling of adjacent violators, exact and distributed: tasks pool ranges of x, the driver pools their blocks.

    Equal x are averaged first. What the driver gets are the blocks that pooling leaves within ranges, at most one per
    distinct x and usually few; more than `limit` are refused. Between thresholds the prediction is linear; outside it
    is the end's value ("clip"), null ("nan") or an error ("raise").
    """

    defaults = {"increasing": True, "y_min": None, "y_max": None, "out_of_bounds": "nan", "limit": 2_000_000}

    def fit(self, df, feature: str, label: str, weight: str | None = None):
        self._seen([feature])
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = df.select(F.col(feature).cast("double").alias("x"), F.col(label).cast("double").alias("y"), w.alias("w")).where("x is not null and y is not null and w > 0")
        up = self.increasing
        if up == "auto":
            up = (rows.agg(F.corr("x", "y")).first()[0] or 0.0) >= 0
        sign = 1.0 if up else -1.0
        even = rows.groupBy("x").agg(F.sum(F.expr("w * y")).alias("s"), F.sum("w").alias("w")).select("x", (F.col("s") / F.col("w") * sign).alias("y"), "w")

        def run(batches):
            import pyarrow as pa

            lo, hi, y, w = [], [], [], []
            for b in batches:
                for a, c, d in zip(*(col.to_numpy() for col in b.columns)):
                    _pool(lo, hi, y, w, a, a, c, d)
            yield pa.record_batch([pa.array(v, pa.float64()) for v in (lo, hi, y, w)], ["lo", "hi", "y", "w"])

        parts = even.repartitionByRange("x").sortWithinPartitions("x").mapInArrow(run, "lo double, hi double, y double, w double")
        held = parts.limit(self.limit + 1).toPandas().sort_values("lo")
        if len(held) > self.limit:
            raise ValueError(f"more than {self.limit} blocks")
        lo, hi, y, w = [], [], [], []
        for r in held.itertuples(index=False):
            _pool(lo, hi, y, w, r.lo, r.hi, r.y, r.w)
        xs, ys = [], []
        for a, b, v in zip(lo, hi, y):
            v = v * sign
            v = max(v, self.y_min) if self.y_min is not None else v
            v = min(v, self.y_max) if self.y_max is not None else v
            xs += [a, b] if b > a else [a]
            ys += [v, v] if b > a else [v]
        self.state |= {"x_thresholds": np.array(xs), "y_thresholds": np.array(ys), "increasing": bool(up)}
        return self

    def predict_column(self, features) -> Column:
        xs, ys, how = np.asarray(self.x_thresholds_), np.asarray(self.y_thresholds_), self.out_of_bounds

        def fn(x):
            x = x[:, 0]
            out = np.interp(x, xs, ys)
            outside = (x < xs[0]) | (x > xs[-1])
            if how == "raise" and outside.any():
                raise ValueError("a value is outside the fitted range")
            return np.where(outside, np.nan, out) if how == "nan" else out

        return mapped(fn, features if not isinstance(features, str) else [features])


def _pool(lo, hi, y, w, a, b, value, weight):
    lo.append(a), hi.append(b), y.append(value), w.append(weight)
    while len(y) > 1 and y[-2] >= y[-1]:
        v, u = y.pop(), w.pop()
        lo.pop()
        h = hi.pop()
        y[-1] = (y[-1] * w[-1] + v * u) / (w[-1] + u)
        w[-1] += u
        hi[-1] = h


# --- Bayes and discriminants ----------------------------------------------------------------------------------------


def class_sums(df: DataFrame, features, label: str, classes: list, weight=None, squares: str = "diag") -> dict[str, np.ndarray]:
    """For each class the weight, the sums and the sums of squares ("diag") or products ("full") of the features."""
    k = len(classes)

    def fn(x, y, w=None):
        z = np.zeros((len(x), k))
        z[np.arange(len(x)), y.astype(int)] = 1 if w is None else w
        out = {"n": z.sum(0), "s": z.T @ x}
        if squares == "diag":
            out["q"] = z.T @ (x * x)
        elif squares == "full":
            out["q"] = np.stack([(x * z[:, c : c + 1]).T @ x for c in range(k)])
        return out

    s = total(rows_of(df, features, coded(label, classes), weight), fn)
    if not s:
        raise ValueError("no rows to fit")
    return s


class _Bayes(Classifier):
    """Joint log likelihoods of the classes as one array column."""

    def jll_column(self, features) -> Column:
        raise NotImplementedError

    def proba_column(self, features) -> Column:
        z = self.jll_column(features)
        e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, u: s + u))

    def predict_column(self, features) -> Column:
        z = self.jll_column(features)
        return named_class(F.array_position(z, F.array_max(z)) - 1, self.classes_)

    def _priors(self, n):
        given = self.params.get("priors") or self.params.get("class_prior")
        if given is not None:
            return np.asarray(given, float)
        if self.params.get("fit_prior", True) is False:
            return np.full(len(n), 1 / len(n))
        return n / n.sum()


class GaussianNB(_Bayes):
    """Normal features within classes; partial_fit() adds the sums of further rows."""

    defaults = {"priors": None, "var_smoothing": 1e-9}

    def fit(self, df, features, label, weight=None):
        self.state.pop("sums", None)
        return self.partial_fit(df, features, label, classes_of(df, label), weight)

    def partial_fit(self, df, features, label, classes=None, weight=None):
        self._seen(features)
        if classes is not None:
            self.state["classes"] = list(classes)
        s = class_sums(df, features, label, self.classes_, weight)
        if "sums" in self.state:
            s = {k: s[k] + np.asarray(self.state["sums"][k]) for k in s}
        self.state["sums"] = {k: v.tolist() for k, v in s.items()}
        n = np.maximum(s["n"], 1e-300)[:, None]
        mean = s["s"] / n
        all_mean = s["s"].sum(0) / s["n"].sum()
        smooth = self.var_smoothing * float((s["q"].sum(0) / s["n"].sum() - all_mean**2).max())
        self.state |= {"theta": mean, "var": np.maximum(s["q"] / n - mean**2, 0) + smooth, "class_prior": self._priors(s["n"])}
        return self

    def jll_column(self, features):
        parts = []
        for m, v, p in zip(np.asarray(self.theta_), np.asarray(self.var_), np.asarray(self.class_prior_)):
            base = math.log(max(p, 1e-300)) - 0.5 * float(np.log(2 * math.pi * v).sum())
            if isinstance(features, str):
                z = F.zip_with(vector(features), F.arrays_zip(F.array(*map(F.lit, m.tolist())).alias("m"), F.array(*map(F.lit, v.tolist())).alias("v")), lambda x, s: (x - s["m"]) * (x - s["m"]) / s["v"])
                parts.append(F.lit(base) - F.aggregate(z, F.lit(0.0), lambda s, u: s + u) / 2)
            else:
                parts.append(F.lit(base) - 0.5 * reduce(lambda a, b: a + b, [(F.col(c).cast("double") - float(a)) * (F.col(c).cast("double") - float(a)) / float(b) for c, a, b in zip(features, m, v)]))
        return F.array(*parts)


class MultinomialNB(_Bayes):
    """Counts within classes; alpha pseudo-counts."""

    defaults = {"alpha": 1.0, "fit_prior": True, "class_prior": None}
    squares = "none"

    def _table(self, s):
        c = s["s"] + self.alpha
        return np.log(c) - np.log(c.sum(1, keepdims=True)), np.zeros(len(c))

    def _rows(self, df, features):
        return df, features

    def fit(self, df, features, label, weight=None):
        self._seen(features)
        classes = classes_of(df, label)
        own, names_ = self._rows(df, features)
        s = class_sums(own, names_, label, classes, weight, "none")
        if (s["s"] < 0).any():
            raise ValueError("negative features")
        table, base = self._table(s)
        with np.errstate(divide="ignore"):
            prior = np.log(self._priors(s["n"]))
        self.state |= {"classes": classes, "feature_log_prob": table, "class_log_prior": prior, "base": base}
        return self

    def _prior(self):
        return np.asarray(self.class_log_prior_)

    def jll_column(self, features):
        return F.array(*[linear(features, w, p + b) for w, p, b in zip(np.asarray(self.feature_log_prob_), self._prior(), np.asarray(self.base_))])


class BernoulliNB(MultinomialNB):
    """Presence (x > binarize) of each feature within classes."""

    defaults = {**MultinomialNB.defaults, "binarize": 0.0}

    def _rows(self, df, features):
        held = F.transform(vector(features), lambda v: (v > F.lit(float(self.binarize))).cast("double"))
        return df.withColumn("_mr_bits", held), "_mr_bits"

    def _table(self, s):
        p = (s["s"] + self.alpha) / (s["n"][:, None] + 2 * self.alpha)
        return np.log(p) - np.log1p(-p), np.log1p(-p).sum(1)

    def jll_column(self, features):
        bits = F.transform(vector(features), lambda v: (v > F.lit(float(self.binarize))).cast("double"))
        out = []
        for w, p, b in zip(np.asarray(self.feature_log_prob_), self._prior(), np.asarray(self.base_)):
            out.append(F.aggregate(F.zip_with(bits, F.array(*map(F.lit, w.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) + F.lit(float(p + b)))
        return F.array(*out)


class ComplementNB(MultinomialNB):
    """Weights from all other classes' counts; the smallest match wins."""

    defaults = {**MultinomialNB.defaults, "norm": False}

    def _table(self, s):
        c = s["s"].sum(0) - s["s"] + self.alpha
        w = np.log(c / c.sum(1, keepdims=True))
        return (w / w.sum(1, keepdims=True) if self.norm else -w), np.zeros(len(c))

    def _prior(self):
        p = np.asarray(self.class_log_prior_)
        return p if len(p) == 1 else np.zeros(len(p))


class CategoricalNB(_Bayes):
    """Category codes 0, 1, ... of each feature within classes; categories that a class never had count alpha."""

    defaults = {"alpha": 1.0, "fit_prior": True, "class_prior": None, "min_categories": 0}

    def fit(self, df, features, label, weight=None):
        self._seen(features)
        classes = classes_of(df, label)
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        long = df.select(coded(label, classes).alias("y"), w.alias("w"), F.posexplode(vector(features)).alias("f", "v"))
        rows = long.groupBy("y", "f", "v").agg(F.sum("w").alias("n")).limit(1_000_001).collect()
        if len(rows) > 1_000_000:
            raise ValueError("more than 1,000,000 categories")
        if any(r["v"] < 0 or r["v"] != int(r["v"]) for r in rows):
            raise ValueError("categories are codes from 0 up")
        d = 1 + max(r["f"] for r in rows)
        tables = [np.zeros((len(classes), max(int(self.min_categories), 1 + int(max(r["v"] for r in rows if r["f"] == f))))) for f in range(d)]
        for r in rows:
            tables[r["f"]][r["y"], int(r["v"])] += r["n"]
        n = tables[0].sum(1)
        self.state |= {"classes": classes, "class_log_prior": np.log(self._priors(n)), "feature_log_prob": [(np.log(t + self.alpha) - np.log(t.sum(1, keepdims=True) + self.alpha * t.shape[1])).tolist() for t in tables]}
        return self

    def jll_column(self, features):
        x = vector(features)
        return F.array(*[reduce(lambda a, b: a + b, [F.element_at(F.array(*map(F.lit, t[c])), x[f].cast("int") + 1) for f, t in enumerate(self.feature_log_prob_)], F.lit(float(self.class_log_prior_[c]))) for c in range(len(self.classes_))])


class NearestCentroid(Classifier):
    """Class means (medians for manhattan), shrunk to the overall mean by shrink_threshold; ties take the first class."""

    defaults = {"metric": "euclidean", "shrink_threshold": None}

    def fit(self, df, features, label, weight=None):
        self._seen(features)
        classes = classes_of(df, label)
        if self.metric == "manhattan":
            long = df.select(coded(label, classes).alias("y"), F.posexplode(vector(features)).alias("f", "v"))
            rows = long.groupBy("y", "f").agg(F.percentile("v", 0.5).alias("m")).collect()
            c = np.zeros((len(classes), 1 + max(r["f"] for r in rows)))
            for r in rows:
                c[r["y"], r["f"]] = r["m"]
        else:
            s = class_sums(df, features, label, classes, weight)
            c = s["s"] / s["n"][:, None]
            if self.shrink_threshold:
                n = s["n"].sum()
                mean = s["s"].sum(0) / n
                std = np.sqrt((s["q"].sum(0) - (s["s"] ** 2 / s["n"][:, None]).sum(0)) / (n - len(classes)))
                m = np.sqrt(1 / s["n"] - 1 / n)[:, None]
                std = std + np.median(std)
                gap = (c - mean) / (m * std)
                gap = np.sign(gap) * np.maximum(np.abs(gap) - self.shrink_threshold, 0)
                c = mean + m * std * gap
        self.state |= {"classes": classes, "centroids": c}
        return self

    def predict_column(self, features) -> Column:
        x, far = vector(features), []
        for c in np.asarray(self.centroids_):
            f = (lambda a, b: F.abs(a - b)) if self.metric == "manhattan" else (lambda a, b: (a - b) * (a - b))
            far.append(F.round(F.aggregate(F.zip_with(x, F.array(*map(F.lit, c.tolist())), f), F.lit(0.0), lambda s, v: s + v), 12))
        z = F.array(*far)
        return named_class(F.array_position(z, F.array_min(z)) - 1, self.classes_)


class LinearDiscriminantAnalysis(_Bayes):
    """Normal classes with one covariance, optionally shrunk; transform_column() projects on the discriminants."""

    defaults = {"priors": None, "shrinkage": None, "n_components": None}

    def fit(self, df, features, label, weight=None):
        self._seen(features)
        classes = classes_of(df, label)
        s = class_sums(df, features, label, classes, weight, "full")
        n, means = s["n"], s["s"] / s["n"][:, None]
        p = self._priors(n)
        within = [s["q"][c] / n[c] - np.outer(means[c], means[c]) for c in range(len(n))]
        cov = sum(w * c for w, c in zip(p, within))
        if self.shrinkage:
            cov = (1 - self.shrinkage) * cov + self.shrinkage * np.trace(cov) / len(cov) * np.eye(len(cov))
        w = solve(cov, means.T).T
        b = np.log(p) - 0.5 * (w * means).sum(1)
        mean = p @ means
        e, v = np.linalg.eigh(cov)
        keep = e > 1e-12 * e.max()
        white = v[:, keep] / np.sqrt(e[keep])
        between = ((means - mean) * np.sqrt(p)[:, None]) @ white
        _, size, vt = np.linalg.svd(between, full_matrices=False)
        rank = int((size > 1e-9 * max(size.max(), 1e-300)).sum())
        m = min(self.n_components or rank, rank)
        self.state |= {"classes": classes, "means": means, "covariance": cov, "priors": p, "coef": w, "intercept": b, "mean": mean, "scalings": white @ vt.T[:, :m], "explained_variance_ratio": (size**2 / (size**2).sum())[:m]}
        return self

    def jll_column(self, features):
        return F.array(*[linear(features, w, b) for w, b in zip(np.asarray(self.coef_), np.asarray(self.intercept_))])

    def transform_column(self, features) -> Column:
        s, m = np.asarray(self.scalings_), np.asarray(self.mean_)
        return F.array(*[linear(features, s[:, k], -float(m @ s[:, k])) for k in range(s.shape[1])])


class QuadraticDiscriminantAnalysis(_Bayes):
    """Normal classes, each with its own covariance (unbiased), blended with the unit matrix by reg_param."""

    defaults = {"priors": None, "reg_param": 0.0}

    def fit(self, df, features, label, weight=None):
        self._seen(features)
        classes = classes_of(df, label)
        s = class_sums(df, features, label, classes, weight, "full")
        n, means = s["n"], s["s"] / s["n"][:, None]
        covs = [(s["q"][c] - n[c] * np.outer(means[c], means[c])) / (n[c] - 1) for c in range(len(n))]
        covs = [(1 - self.reg_param) * c + self.reg_param * np.eye(len(c)) for c in covs]
        self.state |= {"classes": classes, "means": means, "covariances": np.stack(covs), "priors": self._priors(n)}
        return self

    def jll_column(self, features):
        means, p = np.asarray(self.means_), np.asarray(self.priors_)
        inv = [np.linalg.pinv(c) for c in np.asarray(self.covariances_)]
        det = [np.linalg.slogdet(c)[1] for c in np.asarray(self.covariances_)]
        return mapped(lambda x: np.column_stack([math.log(p[c]) - 0.5 * det[c] - 0.5 * (((x - means[c]) @ inv[c]) * (x - means[c])).sum(1) for c in range(len(p))]), features, "array<double>")


_ = (Window, bounded_matrix)
