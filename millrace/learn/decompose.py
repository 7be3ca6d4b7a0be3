"""Decompositions, projections, manifolds and linear algebra over rows.

Linear decompositions come from one pass of sums (the scatter or Gram matrix); factorisations alternate such passes.
Manifold methods hold all pairs of up to `limit` rows; beyond it tasks compute them by blocks or the graph is sparse.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.learn.base import Estimator, Predictor, Transformer, bounded_matrix, keyed, linear, mapped, matrix, mix64, moments, rows_of, total, vector
from millrace.learn.cluster import Links, affinity, by_blocks, by_tiles, leading, near_rows, smooth_map, spectral_map, spectral_rows, sq_distances, squares
from millrace.learn.linear import descend, solve
from millrace.learn.preprocess import chi2_tail, digamma


def fixed_signs(v: np.ndarray) -> np.ndarray:
    """Columns whose largest entry is made positive, so that a direction has one form."""
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def project(features, mean, directions: np.ndarray) -> Column:
    """(x - mean) . each column of directions, on the JVM."""
    return F.array(*[linear(features, w, -float(np.asarray(mean) @ w)) for w in directions.T])


class PCA(Transformer):
    """Principal components from the covariance; n_components may be a share of the variance."""

    defaults = {"n_components": None, "whiten": False, "center": True}

    def _solve(self, mean, scatter, n):
        e, v = np.linalg.eigh(scatter)
        e, v = np.maximum(e[::-1], 0), fixed_signs(v[:, ::-1])
        var = e / max(n - 1, 1) if self.center else e / n
        ratio = e / e.sum() if e.sum() else e
        k = self.n_components
        k = len(e) if k is None else int(np.searchsorted(np.cumsum(ratio) + 1e-12, k) + 1) if isinstance(k, float) and k < 1 else int(k)
        noise = float(var[k:].mean()) if k < len(var) else 0.0
        self.state |= {"components": v[:, :k].T, "mean": mean, "explained_variance": var[:k], "explained_variance_ratio": ratio[:k], "singular_values": np.sqrt(e[:k]), "noise_variance": noise, "rows": float(n)}
        return self

    def fit(self, df: DataFrame, features):
        self._seen(features)
        m = moments(rows_of(df, features))
        return self._solve(m["mean"], m["scatter"], m["n"]) if self.center else self._solve(np.zeros(len(m["mean"])), m["raw"], m["n"])

    def _directions(self):
        w = np.asarray(self.components_).T
        return w / np.sqrt(np.maximum(np.asarray(self.explained_variance_), 1e-300)) if self.whiten else w

    def transform_column(self, features) -> Column:
        return project(features, self.mean_, self._directions())

    def inverse_column(self, scores: str) -> Column:
        w = np.asarray(self.components_) * (np.sqrt(np.asarray(self.explained_variance_))[:, None] if self.whiten else 1.0)
        return F.array(*[linear(scores, w[:, k], float(self.mean_[k])) for k in range(w.shape[1])])


class TruncatedSVD(PCA):
    """The same without centring."""

    defaults = {**PCA.defaults, "n_components": 2, "center": False}


class IncrementalPCA(PCA):
    """Batches merge by their counts, means and scatter: the result is that of all rows together."""

    def partial_fit(self, df: DataFrame, features):
        self._seen(features)
        m = moments(rows_of(df, features))
        if "batch_scatter" in self.state:
            n0, m0 = self.rows_, np.asarray(self.mean_)
            n = n0 + m["n"]
            gap = m["mean"] - m0
            scatter = np.asarray(self.batch_scatter_) + m["scatter"] + np.outer(gap, gap) * n0 * m["n"] / n
            mean = (n0 * m0 + m["n"] * m["mean"]) / n
        else:
            n, mean, scatter = m["n"], m["mean"], m["scatter"]
        self.state["batch_scatter"] = scatter
        return self._solve(mean, scatter, n)

    def fit(self, df, features):
        self.state.clear()
        return self.partial_fit(df, features)


class FactorAnalysis(Transformer):
    """Common factors plus noise per column, by expectation maximisation on the covariance; varimax or quartimax."""

    defaults = {"n_components": 2, "max_iter": 1000, "tol": 1e-8, "rotation": None}

    def fit(self, df, features):
        self._seen(features)
        m = moments(rows_of(df, features))
        cov, k = m["scatter"] / m["n"], int(self.n_components)
        psi, last = np.maximum(np.diag(cov).copy(), 1e-12), -math.inf
        for it in range(self.max_iter):
            r = np.sqrt(psi)
            e, v = np.linalg.eigh(cov / np.outer(r, r))
            e, v = e[::-1], fixed_signs(v[:, ::-1])
            w = (v[:, :k] * np.sqrt(np.maximum(e[:k] - 1, 0))).T * r
            like = -0.5 * (np.log(psi).sum() + np.log(np.maximum(e[:k], 1e-300)).sum() + k + e[k:].sum())
            psi = np.maximum(np.diag(cov) - (w * w).sum(0), 1e-12)
            if abs(like - last) < self.tol:
                break
            last = like
        if self.rotation:
            w = _rotated(w.T, 1.0 if self.rotation == "varimax" else 0.0).T
        self.state |= {"components": w, "noise_variance": psi, "mean": m["mean"], "loglike": float(like * m["n"]), "n_iter": it + 1}
        return self

    def transform_column(self, features) -> Column:
        w, psi = np.asarray(self.components_), np.asarray(self.noise_variance_)
        wp = w / psi
        return project(features, self.mean_, wp.T @ np.linalg.inv(np.eye(len(w)) + wp @ w.T))


def _rotated(a: np.ndarray, gamma: float, rounds: int = 500) -> np.ndarray:
    r, size = np.eye(a.shape[1]), 0.0
    for _ in range(rounds):
        b = a @ r
        u, s, vt = np.linalg.svd(a.T @ (b**3 - gamma * b * (b * b).mean(0)))
        r, last, size = u @ vt, size, s.sum()
        if last and size < last * (1 + 1e-10):
            break
    return a @ r


class FastICA(Transformer):
    """Independent components: whitened directions of extreme log-cosh, by fixed-point passes over all rows."""

    defaults = {"n_components": None, "max_iter": 200, "tol": 1e-6, "algorithm": "parallel", "seed": 0}

    def fit(self, df, features):
        self._seen(features)
        rows = rows_of(df, features).persist()
        try:
            m = moments(rows)
            e, v = np.linalg.eigh(m["scatter"] / m["n"])
            k = int(self.n_components or len(e))
            white = fixed_signs(v[:, ::-1][:, :k]) / np.sqrt(np.maximum(e[::-1][:k], 1e-300))
            w, mean = np.random.default_rng(self.seed).normal(size=(k, k)), m["mean"]

            def step(w):
                def fn(x):
                    z = (x - mean) @ white
                    g = np.tanh(z @ w.T)
                    return {"a": g.T @ z, "b": (1 - g * g).sum(0)}

                s = total(rows, fn)
                return (s["a"] - s["b"][:, None] * w) / m["n"]

            if self.algorithm == "parallel":
                w = _decorrelated(w)
                for it in range(self.max_iter):
                    new = _decorrelated(step(w))
                    moved, w = float(np.abs(np.abs((new * w).sum(1)) - 1).max()), new
                    if moved < self.tol:
                        break
            else:
                for j in range(k):
                    own = w[j : j + 1]
                    for it in range(self.max_iter):
                        new = step(own)
                        new = new - new @ w[:j].T @ w[:j]
                        new /= np.linalg.norm(new)
                        moved, own = abs(abs(float((new * own).sum())) - 1), new
                        if moved < self.tol:
                            break
                    w[j] = own[0]
        finally:
            rows.unpersist()
        self.state |= {"components": w @ white.T, "mixing": np.linalg.pinv(w @ white.T), "mean": mean, "n_iter": it + 1}
        return self

    def transform_column(self, features) -> Column:
        return project(features, self.mean_, np.asarray(self.components_).T)


def _decorrelated(w):
    e, v = np.linalg.eigh(w @ w.T)
    return (v / np.sqrt(np.maximum(e, 1e-300))) @ v.T @ w


class NMF(Transformer):
    """Non-negative factors by alternating updates: each pass recomputes rows' codes against the factors and returns the
    sums that update these."""

    defaults = {"n_components": 2, "max_iter": 60, "inner": 20, "tol": 1e-5, "seed": 0}

    @staticmethod
    def codes(x, h, inner):
        """Non-negative least squares of rows on factors, by cyclic coordinate descent."""
        g, b = h @ h.T, x @ h.T
        w = np.full((len(x), len(h)), 0.0)
        q = np.zeros_like(b)
        for _ in range(inner):
            for k in range(len(h)):
                if g[k, k] > 0:
                    new = np.maximum(0, w[:, k] + (b[:, k] - q[:, k]) / g[k, k])
                    q += (new - w[:, k])[:, None] * g[k]
                    w[:, k] = new
        return w

    def fit(self, df, features):
        self._seen(features)
        rows = rows_of(df, features).persist()
        try:
            first = total(rows, lambda x: {"n": np.array(float(x.size)), "s": np.array(x.sum()), "d": np.array(float(x.shape[1]) * len(x)), "low": np.array(float((x < 0).sum())), "rows": np.array(float(len(x))), "q": np.array((x * x).sum())})
            if first["low"]:
                raise ValueError("negative features")
            k, d = int(self.n_components), int(first["n"] / first["rows"])
            h = np.abs(np.random.default_rng(self.seed).normal(size=(k, d))) * math.sqrt(first["s"] / first["n"] / k)
            last = math.inf
            for it in range(self.max_iter):
                def fn(x, h=h):
                    w = self.codes(x, h, self.inner)
                    r = x - w @ h
                    return {"ww": w.T @ w, "wx": w.T @ x, "e": np.array((r * r).sum())}

                s = total(rows, fn)
                if last - s["e"] <= self.tol * float(first["q"]) and it:
                    break
                last = float(s["e"])
                for _ in range(self.inner):
                    for j in range(k):
                        if s["ww"][j, j] > 0:
                            h[j] = np.maximum(0, h[j] + (s["wx"][j] - s["ww"][j] @ h) / s["ww"][j, j])
        finally:
            rows.unpersist()
        self.state |= {"components": h, "reconstruction_err": math.sqrt(max(0.0, float(s["e"]))), "n_iter": it + 1}
        return self

    def transform_column(self, features) -> Column:
        h, inner = np.asarray(self.components_), 10 * int(self.inner)
        return mapped(lambda x: self.codes(x, h, inner), features, "array<double>")


class AlternatingLeastSquares(Estimator):
    """Factors of users and items from ratings, explicit or implicit, by blocked alternating least squares."""

    defaults = {"rank": 10, "max_iter": 10, "reg_param": 0.1, "implicit": False, "alpha": 1.0, "nonnegative": False, "seed": 0}

    def fit(self, df: DataFrame, user: str, item: str, rating: str):
        from pyspark.ml.recommendation import ALS

        self.model = ALS(rank=self.rank, maxIter=self.max_iter, regParam=self.reg_param, implicitPrefs=self.implicit, alpha=self.alpha, nonnegative=self.nonnegative, seed=self.seed, userCol=user, itemCol=item, ratingCol=rating, coldStartStrategy="nan").fit(df.select(F.col(user).cast("int"), F.col(item).cast("int"), F.col(rating).cast("float")))
        self.user_factors, self.item_factors = self.model.userFactors, self.model.itemFactors
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.model.setPredictionCol(out).transform(df)

    def recommend(self, k: int) -> DataFrame:
        return self.model.recommendForAllUsers(k)


class LatentDirichletAllocation(Transformer):
    """Topics of count vectors by variational Bayes, batch passes over all rows or online over keyed shares of them."""

    defaults = {"n_components": 10, "learning_method": "batch", "max_iter": 10, "learning_decay": 0.7, "learning_offset": 10.0, "batches": 8, "doc_topic_prior": None, "topic_word_prior": None, "inner": 50, "seed": 0}

    def _codes(self, x, expw):
        a = float(self.doc_topic_prior or 1 / self.n_components)
        g = np.full((len(x), len(expw)), 1.0)
        for _ in range(int(self.inner)):
            e = np.exp(digamma(g) - digamma(g.sum(1))[:, None])
            new = a + e * ((x / (e @ expw + 1e-100)) @ expw.T)
            moved, g = np.abs(new - g).mean(), new
            if moved < 1e-4:
                break
        return g

    def fit(self, df, features):
        self._seen(features)
        rows = rows_of(df, features).persist()
        try:
            s = total(rows, lambda x: {"n": np.array(float(len(x))), "w": x.sum(0), "low": np.array(float((x < 0).sum()))})
            if s["low"]:
                raise ValueError("negative counts")
            k, d = int(self.n_components), len(s["w"])
            b = float(self.topic_word_prior or 1 / k)
            lam = np.random.default_rng(self.seed).gamma(100.0, 0.01, (k, d))
            t = 0
            for epoch in range(int(self.max_iter)):
                for part in range(1 if self.learning_method == "batch" else int(self.batches)):
                    own = rows if self.learning_method == "batch" else rows.where(F.pmod(keyed(self.seed + epoch, F.col("x")), F.lit(int(self.batches))) == part)
                    expw = np.exp(digamma(lam) - digamma(lam.sum(1))[:, None])

                    def fn(x, expw=expw):
                        g = self._codes(x, expw)
                        e = np.exp(digamma(g) - digamma(g.sum(1))[:, None])
                        return {"s": (e.T @ (x / (e @ expw + 1e-100))) * expw, "n": np.array(float(len(x)))}

                    u = total(own, fn)
                    if not u:
                        continue
                    if self.learning_method == "batch":
                        lam = b + u["s"]
                    else:
                        rho = (self.learning_offset + t) ** -self.learning_decay
                        lam = (1 - rho) * lam + rho * (b + u["s"] * float(s["n"]) / float(u["n"]))
                        t += 1
        finally:
            rows.unpersist()
        self.state["components"] = lam
        return self

    def transform_column(self, features) -> Column:
        lam = np.asarray(self.components_)
        expw = np.exp(digamma(lam) - digamma(lam.sum(1))[:, None])

        def fn(x):
            g = self._codes(x, expw)
            return g / g.sum(1, keepdims=True)

        return mapped(fn, features, "array<double>")


# --- sparse codes ---------------------------------------------------------------------------------------------------


def lasso_codes(x: np.ndarray, atoms: np.ndarray, alpha: float, rounds: int = 200, positive: bool = False) -> np.ndarray:
    """Rows' codes on the atoms with an absolute penalty, all rows at a time by coordinate descent."""
    g, b = atoms @ atoms.T, x @ atoms.T
    w, q = np.zeros_like(b), np.zeros_like(b)
    for _ in range(rounds):
        moved = 0.0
        for k in range(len(atoms)):
            if g[k, k] > 0:
                r = b[:, k] - q[:, k] + g[k, k] * w[:, k]
                new = np.maximum(r - alpha, 0) / g[k, k] if positive else np.sign(r) * np.maximum(np.abs(r) - alpha, 0) / g[k, k]
                step = new - w[:, k]
                q += step[:, None] * g[k]
                w[:, k] = new
                moved = max(moved, float(np.abs(step).max(initial=0)))
        if moved < 1e-9:
            break
    return w


def pursuit_codes(x: np.ndarray, atoms: np.ndarray, n: int) -> np.ndarray:
    """Orthogonal matching pursuit: up to n atoms a row, the best correlated first."""
    out = np.zeros((len(x), len(atoms)))
    size = np.linalg.norm(atoms, axis=1)
    for i, row in enumerate(x):
        own, r = [], row
        for _ in range(min(n, len(atoms))):
            c = np.abs(atoms @ r) / np.maximum(size, 1e-300)
            c[own] = -1
            k = int(c.argmax())
            if c[k] <= 1e-12:
                break
            own.append(k)
            w = np.linalg.lstsq(atoms[own].T, row, rcond=None)[0]
            r = row - w @ atoms[own]
        if own:
            out[i, own] = w
    return out


class SparseCoder(Transformer):
    """Codes on a given dictionary: lasso_cd, omp or threshold."""

    defaults = {"dictionary": None, "transform_algorithm": "lasso_cd", "transform_alpha": 1.0, "transform_n_nonzero_coefs": None}

    def fit(self, df=None, features=None):
        self._seen(features or [])
        return self

    def _atoms(self):
        return np.asarray(self.dictionary, float)

    def transform_column(self, features) -> Column:
        atoms, how, a = self._atoms(), self.transform_algorithm, float(self.transform_alpha)
        n = int(self.transform_n_nonzero_coefs or max(1, atoms.shape[1] // 10))

        def fn(x):
            if how == "omp":
                return pursuit_codes(x, atoms, n)
            if how == "threshold":
                c = x @ atoms.T
                return np.sign(c) * np.maximum(np.abs(c) - a, 0)
            return lasso_codes(x, atoms, a)

        return mapped(fn, features, "array<double>")


class DictionaryLearning(SparseCoder):
    """Unit atoms under lasso codes, alternating passes over all rows; the mini-batch form passes over keyed shares and
    keeps running sums."""

    defaults = {**SparseCoder.defaults, "n_components": 8, "alpha": 1.0, "max_iter": 30, "tol": 1e-6, "batches": 1, "center": False, "seed": 0}

    def fit(self, df, features):
        self._seen(features)
        rows = rows_of(df, features).persist()
        try:
            k, nb = int(self.n_components), int(self.batches)
            m = moments(rows)
            mean = m["mean"] if self.center else np.zeros(len(m["mean"]))
            e, v = np.linalg.eigh(m["scatter"] if self.center else m["raw"])
            atoms = fixed_signs(v[:, ::-1])[:, :k].T
            if len(atoms) < k:
                extra = np.random.default_rng(self.seed).normal(size=(k - len(atoms), len(mean)))
                atoms = np.concatenate([atoms, extra / np.linalg.norm(extra, axis=1, keepdims=True)])
            a, b, last = np.zeros((k, k)), np.zeros((k, len(mean))), math.inf
            for it in range(int(self.max_iter)):
                own = rows if nb == 1 else rows.where(F.pmod(keyed(self.seed + it // nb, F.col("x")), F.lit(nb)) == it % nb)

                def fn(x, atoms=atoms):
                    w = lasso_codes(x - mean, atoms, self.alpha)
                    r = x - mean - w @ atoms
                    return {"a": w.T @ w, "b": w.T @ (x - mean), "e": np.array(0.5 * (r * r).sum() + self.alpha * np.abs(w).sum())}

                s = total(own, fn)
                if not s:
                    continue
                keep = 0.0 if nb == 1 else 1 - 1 / min(it + 1, 2 * nb)
                a, b = keep * a + s["a"], keep * b + s["b"]
                for _ in range(10):
                    for j in range(k):
                        if a[j, j] > 1e-12:
                            u = atoms[j] + (b[j] - a[j] @ atoms) / a[j, j]
                            size = np.linalg.norm(u)
                            atoms[j] = u / size if size > 0 else atoms[j]
                if nb == 1:
                    if last - s["e"] <= self.tol * max(1.0, abs(float(s["e"]))) and it:
                        break
                    last = float(s["e"])
        finally:
            rows.unpersist()
        self.state |= {"components": atoms, "mean": mean, "error": float(s["e"]), "n_iter": it + 1}
        return self

    def _atoms(self):
        return np.asarray(self.components_)


class MiniBatchDictionaryLearning(DictionaryLearning):
    defaults = {**DictionaryLearning.defaults, "batches": 8}


class SparsePCA(Transformer):
    """Sparse directions: lasso codes of the columns on unit scores, alternating on the scatter matrix alone (scores are
    linear in the rows, so no further pass is needed); transform by ridge."""

    defaults = {"n_components": 2, "alpha": 1.0, "ridge_alpha": 0.01, "max_iter": 200, "tol": 1e-8}

    def fit(self, df, features):
        self._seen(features)
        m = moments(rows_of(df, features))
        s, k = m["scatter"], int(self.n_components)
        e, v = np.linalg.eigh(s)
        b = fixed_signs(v[:, ::-1])[:, :k]  # score directions: scores are X b, scaled to unit length
        for it in range(int(self.max_iter)):
            size = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", b, s, b), 1e-300))
            u = b / size
            g, c = u.T @ s @ u, u.T @ s
            w = np.column_stack([descend(g, c[:, j], self.alpha, 1e-12, max_iter=500) for j in range(len(s))])
            # best orthogonal scores for these loadings: the polar factor of X w'
            q, _, rt = np.linalg.svd(_root(s) @ w.T, full_matrices=False)
            new = solve(s, _root(s) @ (q @ rt))
            moved, b = np.abs(np.abs((new * b).sum(0) / np.maximum(np.linalg.norm(new, axis=0) * np.linalg.norm(b, axis=0), 1e-300)) - 1).max(), new
            if moved < self.tol:
                break
        size = np.linalg.norm(w, axis=1, keepdims=True)
        self.state |= {"components": w / np.where(size > 0, size, 1), "mean": m["mean"], "n_iter": it + 1}
        return self

    def transform_column(self, features) -> Column:
        w = np.asarray(self.components_)
        return project(features, self.mean_, w.T @ np.linalg.inv(w @ w.T + self.ridge_alpha * np.eye(len(w))))


def _root(s):
    e, v = np.linalg.eigh(s)
    return (v * np.sqrt(np.maximum(e, 0))) @ v.T


class MiniBatchSparsePCA(SparsePCA):
    """Sparse directions as the atoms of an online dictionary of the columns' scores, batch by batch."""

    defaults = {**SparsePCA.defaults, "batches": 4, "seed": 0}

    def fit(self, df, features):
        self._seen(features)
        rows = rows_of(df, features).persist()
        try:
            parts = [rows.where(F.pmod(keyed(self.seed, F.col("x")), F.lit(int(self.batches))) == b) for b in range(int(self.batches))]
            n, mean, s = 0.0, None, None
            for p in parts:
                if p.isEmpty():
                    continue
                m = moments(p)
                if mean is None:
                    n, mean, s = m["n"], m["mean"], m["scatter"]
                else:
                    gap = m["mean"] - mean
                    s = s + m["scatter"] + np.outer(gap, gap) * n * m["n"] / (n + m["n"])
                    mean, n = (n * mean + m["n"] * m["mean"]) / (n + m["n"]), n + m["n"]
        finally:
            rows.unpersist()
        k = int(self.n_components)
        b = fixed_signs(np.linalg.eigh(s)[1][:, ::-1])[:, :k]
        for it in range(int(self.max_iter)):
            u = b / np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", b, s, b), 1e-300))
            g, c = u.T @ s @ u, u.T @ s
            w = np.column_stack([descend(g, c[:, j], self.alpha, 1e-12, max_iter=500) for j in range(len(s))])
            q, _, rt = np.linalg.svd(_root(s) @ w.T, full_matrices=False)
            new = solve(s, _root(s) @ (q @ rt))
            moved, b = float(np.abs(new - b).max()), new
            if moved < self.tol:
                break
        size = np.linalg.norm(w, axis=1, keepdims=True)
        self.state |= {"components": w / np.where(size > 0, size, 1), "mean": mean, "n_iter": it + 1}
        return self


# --- random projections ---------------------------------------------------------------------------------------------


def johnson_lindenstrauss_min_dim(n: int, eps: float = 0.1) -> int:
    """Dimensions that keep all squared distances of n rows within a share eps, with good probability."""
    if not 0 < eps < 1 or n <= 0:
        raise ValueError("needs n > 0 and eps between 0 and 1")
    return int(4 * math.log(n) / (eps**2 / 2 - eps**3 / 3))


def keyed_normals(seed: int, shape: tuple[int, int]) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal(shape)


class GaussianRandomProjection(Transformer):
    """Normal directions of variance 1 / n_components."""

    defaults = {"n_components": 16, "seed": 0}

    def _matrix(self, d):
        return keyed_normals(self.seed, (d, int(self.n_components))) / math.sqrt(self.n_components)

    def fit(self, df, features):
        self._seen(features)
        d = len(df.select(vector(features).alias("x")).first()["x"])
        self.state["components"] = self._matrix(d).T
        return self

    def transform_column(self, features) -> Column:
        w = np.asarray(self.components_)
        return mapped(lambda x: x @ w.T, features, "array<double>")


class SparseRandomProjection(GaussianRandomProjection):
    """Directions with a share `density` of entries +-sqrt(1 / (density n_components)); "auto" is 1 / sqrt(columns)."""

    defaults = {**GaussianRandomProjection.defaults, "density": "auto"}

    def _matrix(self, d):
        p = 1 / math.sqrt(d) if self.density == "auto" else float(self.density)
        rng = np.random.default_rng(self.seed)
        u = rng.uniform(size=(d, int(self.n_components)))
        return np.where(u < p / 2, 1.0, np.where(u < p, -1.0, 0.0)) * math.sqrt(1 / (p * self.n_components))


# --- two blocks of columns -------------------------------------------------------------------------------------------


class _TwoBlocks(Transformer):
    def _scatters(self, df, features, targets):
        self._seen(features)
        self.state["targets"] = targets if isinstance(targets, str) else list(targets)
        both = df.select(F.concat(vector(features), vector(targets)).alias("x"), F.size(vector(features)).alias("d"))
        d = both.first()["d"]
        m = moments(both.select("x"))
        s = m["scatter"] / (m["n"] - 1)
        scale = np.sqrt(np.diag(s)) if self.scale else np.ones(len(s))
        scale[scale == 0] = 1.0
        s = s / np.outer(scale, scale)
        self.state |= {"mean": m["mean"], "scaling": scale, "d": d}
        return s[:d, :d], s[:d, d:], s[d:, d:]

    def transform_column(self, features) -> Column:
        r = np.asarray(self.x_rotations_) / np.asarray(self.scaling_)[: self.d_, None]
        return project(features, np.asarray(self.mean_)[: self.d_], r)

    def predict_columns(self, features) -> Column:
        return F.array(*[linear(features, w, b) for w, b in zip(np.asarray(self.coef_), np.asarray(self.intercept_))])

    def _coefficients(self, rot, q):
        scale, mean, d = np.asarray(self.scaling_), np.asarray(self.mean_), self.d_
        w = (rot @ q.T).T * scale[d:, None] / scale[None, :d]
        self.state |= {"x_rotations": rot, "coef": w, "intercept": mean[d:] - w @ mean[:d]}
        return self


class PLSRegression(_TwoBlocks):
    """Partial least squares by deflating the scatter matrices: all components from one pass."""

    defaults = {"n_components": 2, "scale": True}
    symmetric = False

    def fit(self, df, features, targets):
        xx, xy, yy = self._scatters(df, features, targets)
        sxx, sxy, syy = xx.copy(), xy.copy(), yy.copy()
        ws, ps, qs, cs, loads = [], [], [], [], []
        for _ in range(int(self.n_components)):
            u, s, vt = np.linalg.svd(sxy)
            if not len(s) or s[0] < 1e-12:
                break
            w, c = u[:, 0], vt[0]
            if w[np.abs(w).argmax()] < 0:
                w, c = -w, -c
            tt = w @ sxx @ w
            p = sxx @ w / tt
            q = w @ sxy / tt
            ws.append(w), ps.append(p), qs.append(q), cs.append(c)
            if self.symmetric:
                uu = c @ syy @ c
                r = syy @ c / uu
                sxy = sxy - np.outer(p, w @ sxy) - np.outer(sxy @ c, r) + np.outer(p, r) * (w @ sxy @ c)
                syy = syy - np.outer(r, r) * uu
                loads.append(r)
            else:
                sxy = sxy - np.outer(p, q) * tt
            sxx = sxx - np.outer(p, p) * tt
        w, p, q = np.array(ws).T, np.array(ps).T, np.array(qs).T
        self.state |= {"x_weights": w, "x_loadings": p, "y_loadings": np.array(loads).T if loads else q, "y_weights": np.array(cs).T}
        return self._coefficients(w @ np.linalg.pinv(p.T @ w), q)


class PLSCanonical(PLSRegression):
    """The symmetric form: both blocks are deflated by their own scores."""

    symmetric = True


class CCA(_TwoBlocks):
    """Directions of the largest correlation between the two blocks."""

    defaults = {"n_components": 2, "scale": True}

    def fit(self, df, features, targets):
        xx, xy, yy = self._scatters(df, features, targets)
        a, b = _inverse_root(xx), _inverse_root(yy)
        u, s, vt = np.linalg.svd(a @ xy @ b, full_matrices=False)
        k = int(self.n_components)
        u = u[:, :k]
        sign = np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
        rx, ry = a @ u * sign, b @ vt[:k].T * sign
        self.state |= {"correlations": s[:k], "y_rotations": ry}
        return self._coefficients(rx, xy.T @ rx)


def _inverse_root(s):
    e, v = np.linalg.eigh(s)
    return (v * np.where(e > 1e-12 * max(e.max(), 1e-300), 1 / np.sqrt(np.maximum(e, 1e-300)), 0)) @ v.T


# --- robust covariance -----------------------------------------------------------------------------------------------


class MinCovDet(Estimator):
    """The covariance of the h rows with the smallest determinant, by concentration passes over all rows from several
    starts; each finds its h-th smallest distance exactly. Consistency factor and one reweighting follow."""

    defaults = {"support_fraction": None, "starts": 4, "max_iter": 20, "seed": 0}

    def fit(self, df, features):
        self.state["features"] = features if isinstance(features, str) else list(features)
        rows = rows_of(df, features).persist()
        try:
            m = moments(rows)
            n, d = int(m["n"]), len(m["mean"])
            h = int(self.support_fraction * n) if self.support_fraction else (n + d + 1) // 2
            best = (math.inf,)
            for k in range(int(self.starts)):
                seed = matrix(rows.orderBy(keyed(self.seed + k, F.col("x"))).limit(max(d + 1, 5 * d)).toArrow()["x"])
                mean, cov = (m["mean"], m["scatter"] / n) if k == 0 else (seed.mean(0), np.cov(seed.T, bias=True).reshape(d, d) + 1e-9 * np.eye(d))
                last = math.inf
                for _ in range(int(self.max_iter)):
                    mean, cov, size = self._concentrate(rows, mean, cov, h, n)
                    det = np.linalg.slogdet(cov)[1]
                    if det >= last - 1e-10:
                        break
                    last = det
                if det < best[0]:
                    best = (det, mean, cov, size)
            _, mean, cov, size = best
            raw = cov
            med = self._distance_quantile(rows, mean, cov, 0.5)
            cov = cov * med / _chi2_quantile(0.5, d)
            cut = _chi2_quantile(0.975, d)
            inv = np.linalg.pinv(cov)
            s = total(rows, lambda x: _inside(x, mean, inv, cut))
            mean2 = s["s"] / s["n"]
            cov2 = s["q"] / s["n"] - np.outer(mean2, mean2)
        finally:
            rows.unpersist()
        self.state |= {"raw_location": mean, "raw_covariance": raw, "location": mean2, "covariance": cov2, "support": float(s["n"])}
        return self

    @staticmethod
    def _far(rows, mean, cov):
        inv = np.linalg.pinv(cov)
        return rows.select("x", mapped(lambda x: (((x - mean) @ inv) * (x - mean)).sum(1), "x").alias("d"))

    def _distance_quantile(self, rows, mean, cov, q):
        return self._far(rows, mean, cov).agg(F.percentile("d", q)).first()[0]

    def _concentrate(self, rows, mean, cov, h, n):
        cut = self._distance_quantile(rows, mean, cov, (h - 1) / max(n - 1, 1))
        inv = np.linalg.pinv(cov)
        s = total(rows, lambda x: _inside(x, mean, inv, cut * (1 + 1e-12)))
        new = s["s"] / s["n"]
        return new, s["q"] / s["n"] - np.outer(new, new), float(s["n"])

    def distance_column(self, features) -> Column:
        m, inv = np.asarray(self.location_), np.linalg.pinv(np.asarray(self.covariance_))
        return mapped(lambda x: (((x - m) @ inv) * (x - m)).sum(1), features)


def _inside(x, mean, inv, cut):
    own = x[(((x - mean) @ inv) * (x - mean)).sum(1) <= cut]
    return {"n": np.array(float(len(own))), "s": own.sum(0), "q": own.T @ own}


def _chi2_quantile(p: float, k: float) -> float:
    lo, hi = 0.0, 10 * k + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - chi2_tail(mid, k) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


class EllipticEnvelope(MinCovDet, Predictor):
    """Rows beyond the (1 - contamination) quantile of the robust distance are outliers (-1)."""

    defaults = {**MinCovDet.defaults, "contamination": 0.1}

    def fit(self, df, features):
        super().fit(df, features)
        self.state["offset"] = df.select(self.distance_column(features).alias("d")).agg(F.percentile("d", 1 - self.contamination)).first()[0]
        return self

    def predict_column(self, features) -> Column:
        return F.when(self.distance_column(features) > F.lit(float(self.offset_)), -1).otherwise(1)


# --- manifolds (all pairs of up to `limit` rows at once) -----------------------------------------------------------


class _Embedding(Estimator):
    #: Whether there is a way for more than `limit` rows.
    any_rows = False

    def fit_transform(self, df: DataFrame, features, id_col: str) -> DataFrame:
        """(id, embedding)"""
        self.fit(df, features, id_col)
        return df.sparkSession.createDataFrame([(int(i), [float(v) for v in e]) for i, e in zip(self.ids_, self.embedding_)], "id long, embedding array<double>")

    def _rows(self, df, features, id_col):
        self.state["features"] = features if isinstance(features, str) else list(features)
        return bounded_matrix(df, features, id_col, limit=None if self.any_rows else self.limit, order=id_col)


def classical(d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates whose squared distances come closest, from the double-centred matrix."""
    b = -0.5 * (d2 - d2.mean(0) - d2.mean(1)[:, None] + d2.mean())
    e, v = np.linalg.eigh((b + b.T) / 2)
    e, v = e[::-1][:k], fixed_signs(v[:, ::-1][:, :k])
    return v * np.sqrt(np.maximum(e, 0)), e


def classical_rows(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """classical() of the rows' own squared distances: the principal directions give it without all pairs."""
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c)
    e, y = e[::-1][:k], fixed_signs(c @ u[:, ::-1][:, :k])
    more = min(k, len(x)) - len(e)
    return (np.pad(y, ((0, 0), (0, more))), np.pad(e, (0, more))) if more > 0 else (y[:, : len(x)], e[: len(x)])


class ClassicalMDS(_Embedding):
    """Coordinates whose distances come closest to the rows'. The driver holds all rows, not their pairs; more than
    `limit`, if given, are refused."""

    defaults = {"n_components": 2, "limit": None}

    def fit(self, df, features, id_col):
        x, ids = self._rows(df, features, id_col)
        y, e = classical_rows(x, int(self.n_components))
        self.state |= {"ids": ids, "embedding": y, "eigenvalues": e}
        return self


class MDS(_Embedding):
    """Metric scaling by majorisation from the classical solution. Beyond `limit` rows each step is a job whose tasks
    compute the distances of tiles, each pair of rows once, and forget them."""

    defaults = {"n_components": 2, "max_iter": 300, "eps": 1e-6, "limit": 4_000}

    @staticmethod
    def _step(spark, held, y: np.ndarray) -> tuple[float, np.ndarray]:
        """(stress of y, the next y)"""
        n, k, moved = len(y), y.shape[1], spark.sparkContext.broadcast((np.column_stack([y, np.ones(len(y))]), *squares(y)))

        def fn(sides, own, tiles, out):
            (left, right), (y, low, high) = sides, moved.value
            for j in tiles:
                d, e = left[own] @ right[j].T, low[own] @ high[j].T
                for v in (d, e):
                    np.sqrt(np.maximum(v, 0, out=v), out=v)
                    if j == own:
                        np.fill_diagonal(v, 0)
                off = e - d
                out[own.start, k + 1] += np.vdot(off, off) / (2 if j == own else 1)
                if e.min() <= 1e-12:
                    d[e <= 1e-12] = 0
                d /= np.maximum(e, 1e-12, out=e)
                out[own, : k + 1] += d @ y[j]
                if j != own:
                    out[j, : k + 1] += d.T @ y[own]

        got = by_tiles(spark, held, n, k + 2, fn)
        moved.destroy()
        return float(got[:, k + 1].sum()), (got[:, k : k + 1] * y - got[:, :k]) / n

    def _fit_by_blocks(self, spark, x, ids):
        held = spark.sparkContext.broadcast(squares(x))
        y, last = classical_rows(x, int(self.n_components))[0], math.inf
        for it in range(int(self.max_iter)):
            stress, new = self._step(spark, held, y)
            if last - stress < self.eps * max(stress, 1e-300):
                break
            last, y = stress, new
        held.destroy()
        self.state |= {"ids": ids, "embedding": y, "stress": stress, "n_iter": it + 1}
        return self

    def fit(self, df, features, id_col):
        self.state["features"] = features if isinstance(features, str) else list(features)
        x, ids = bounded_matrix(df, features, id_col, limit=None, order=id_col)
        if len(x) > self.limit:
            return self._fit_by_blocks(df.sparkSession, x, ids)
        d = np.sqrt(sq_distances(x, x))
        y, last = classical(d * d, int(self.n_components))[0], math.inf
        for it in range(int(self.max_iter)):
            e = np.sqrt(sq_distances(y, y))
            stress = float(((e - d) ** 2).sum() / 2)
            if last - stress < self.eps * max(stress, 1e-300):
                break
            last = stress
            b = np.where(e > 1e-12, -d / np.maximum(e, 1e-12), 0.0)
            np.fill_diagonal(b, 0)
            np.fill_diagonal(b, -b.sum(1))
            y = b @ y / len(y)
        self.state |= {"ids": ids, "embedding": y, "stress": stress, "n_iter": it + 1}
        return self


class Roads:
    """An undirected graph of n nodes with lengths, to find shortest paths in from many starts at once."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray):
        i, j, w = np.append(i, j), np.append(j, i), np.append(w, w)
        order = np.lexsort((w, j, i))
        i, j, w = i[order], j[order], w[order]
        first = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))[: len(i)]
        i, j, w = i[first], j[first], w[first]
        # nodes in descending order of their number of edges: the first edges of all, the second ones, ...
        count = np.bincount(i, minlength=n)
        self.order = np.argsort(-count, kind="stable")
        rank, place = np.argsort(self.order), np.arange(len(i)) - (np.cumsum(count) - count)[i]
        self.slots, at = [], np.lexsort((rank[i], place))
        for own in np.split(at, np.nonzero(np.diff(place[at]))[0] + 1):
            self.slots.append((rank[j[own]], w[own][:, None]))

    def paths(self, start: np.ndarray) -> np.ndarray:
        """start: the lengths (nodes, starts) that paths begin with, else infinite; the shortest lengths to all nodes."""
        d = start[self.order]
        while True:
            before = d.copy()
            for j, w in self.slots:
                np.minimum(d[: len(j)], d[j] + w, out=d[: len(j)])
            if np.array_equal(before, d):
                break
        out = np.empty_like(d)
        out[self.order] = d
        return out


def joined(x: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges and, while parts are apart, the shortest one from the part of the first row to another."""
    n, part = len(x), np.arange(len(x))
    while True:
        low = part.copy()
        np.minimum.at(low, i, part[j])
        np.minimum.at(low, j, part[i])
        low = low[low]
        if np.array_equal(low, part):
            break
        part = low
    out, new = np.nonzero(part)[0], np.nonzero(part == 0)[0]
    best, frm, more = np.full(len(out), np.inf), np.zeros(len(out), np.int64), []
    while len(out):
        for at in range(0, len(out), step := max(1, (1 << 23) // len(new))):
            d = np.sqrt(sq_distances(x[out[at : at + step]], x[new]))
            k = d.argmin(1)
            d, k = d[np.arange(len(d)), k], new[k]
            old = best[at : at + step]
            nearer = (d < old) | ((d == old) & (k < frm[at : at + step]))
            best[at : at + step], frm[at : at + step] = np.where(nearer, d, old), np.where(nearer, k, frm[at : at + step])
        at = np.lexsort((out, frm, best))[0]
        more.append((frm[at], out[at], best[at]))
        on = part[out] == part[out[at]]
        new, out, best, frm = out[on], out[~on], best[~on], frm[~on]
    if more:
        a, b, c = (np.array(v) for v in zip(*more))
        i, j, w = np.append(i, a), np.append(j, b), np.append(w, c)
    return i, j, w


class Isomap(_Embedding):
    """Classical scaling of shortest paths over the neighbour graph; parts that are apart are joined by their nearest
    rows. Beyond `limit` rows the graph is sparse, and tasks find the paths of blocks of rows for every product and
    forget them."""

    defaults = {"n_components": 2, "n_neighbors": 5, "limit": 2_500}
    any_rows = True

    def _fit_sparse(self, spark, x, ids):
        n, k = len(x), int(self.n_neighbors)
        shared = spark.sparkContext.broadcast(x)
        near, d = near_rows(spark, shared, n, k + 1, True)
        shared.destroy()
        i, j, w = joined(x, np.repeat(np.arange(n), k), near[:, 1:].ravel(), d[:, 1:].ravel())
        roads = spark.sparkContext.broadcast(Roads(n, i, j, w))

        def squared(v, more=False):
            """The squared path lengths times v, each row's sum of their squares behind them if asked for."""
            held = spark.sparkContext.broadcast(v)

            def fn(roads, own):
                start = np.full((n, len(own)), np.inf)
                start[own, np.arange(len(own))] = 0
                g = roads.paths(start).T ** 2
                return np.hstack([g @ held.value, (g * g).sum(1)[:, None]]) if more else g @ held.value

            out = by_blocks(spark, roads, n, fn, size=max(16, min(128, (1 << 20) // n)))
            held.destroy()
            return out

        # a Krylov space from blocks of random columns; the first pass also gives the mean of each row
        m, want = min(n, 64), int(self.n_components)
        v = np.random.default_rng(0).normal(size=(n, m))
        got = squared(np.hstack([v - v.mean(0), np.ones((n, 1))]), more=True)
        means, fourth = got[:, m] / n, float(got[:, m + 1].sum())
        block, spaces, images = got[:, :m], [], []
        for _ in range(50):
            block = block - block.mean(0)
            for _ in range(2):
                for q in spaces:
                    block = block - q @ (q.T @ block)
            block = np.linalg.qr(block)[0][:, : n - sum(q.shape[1] for q in spaces)]
            image = -0.5 * squared(block - block.mean(0))
            spaces.append(block)
            images.append(image - image.mean(0))
            q, b = np.hstack(spaces), np.hstack(images)
            t = q.T @ b
            e, u = np.linalg.eigh((t + t.T) / 2)
            e, u = e[::-1][:want], u[:, ::-1][:, :want]
            y = q @ u
            if q.shape[1] >= n or np.linalg.norm(b @ u - y * e, axis=0).max() <= 1e-9 * max(abs(e[0]), 1e-300):
                break
            block = images[-1]
        else:
            raise ValueError("the directions did not settle in 50 steps")
        y = fixed_signs(y) * np.sqrt(np.maximum(e, 0))
        size = 0.25 * (fourth - 2 * n * (means * means).sum() + (n * means.mean()) ** 2)
        self.state |= {"ids": ids, "embedding": y, "reconstruction_error": float(np.sqrt(max(0.0, size - (e * e).sum())) / n), "x": x, "roads": np.column_stack([i, j, w]), "means": means, "eigenvalues": e}
        roads.destroy()
        return self

    def fit(self, df, features, id_col):
        x, ids = self._rows(df, features, id_col)
        if len(x) > self.limit:
            return self._fit_sparse(df.sparkSession, x, ids)
        d = np.sqrt(sq_distances(x, x))
        g = np.full_like(d, np.inf)
        near = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, 1 : int(self.n_neighbors) + 1]
        np.put_along_axis(g, near, np.take_along_axis(d, near, 1), 1)
        g = np.minimum(g, g.T)
        np.fill_diagonal(g, 0)
        while True:
            part = _parts(np.isfinite(g))
            if part.max() == 0:
                break
            own = part == 0
            i, j = np.unravel_index(np.where(own[:, None] & ~own[None], d, np.inf).argmin(), d.shape)
            g[i, j] = g[j, i] = d[i, j]
        for k in range(len(g)):
            np.minimum(g, g[:, k : k + 1] + g[k], out=g)
        y, e = classical(g * g, int(self.n_components))
        k = -0.5 * (g * g - (g * g).mean(0) - (g * g).mean(1)[:, None] + (g * g).mean())
        self.state |= {"ids": ids, "embedding": y, "reconstruction_error": float(np.sqrt(max(0.0, (k * k).sum() - (e * e).sum())) / len(g)), "x": x, "geodesic": g, "eigenvalues": e}
        return self

    def transform_column(self, features) -> Column:
        x, y, e = (np.asarray(v) for v in (self.x_, self.embedding_, self.eigenvalues_))
        n = int(self.n_neighbors)
        if "geodesic" not in self.state:
            edges, means = np.asarray(self.roads_), np.asarray(self.means_)
            roads = Roads(len(x), edges[:, 0].astype(np.int64), edges[:, 1].astype(np.int64), edges[:, 2])

            def along(q):
                out = []
                for at in range(0, len(q), 64):
                    d = np.sqrt(sq_distances(q[at : at + 64], x))
                    near = np.argsort(d, axis=1, kind="stable")[:, :n]
                    start = np.full(d.T.shape, np.inf)
                    np.put_along_axis(start, near.T, np.take_along_axis(d, near, 1).T, 0)
                    out.append(-0.5 * (roads.paths(start).T ** 2 - means) @ (y / np.maximum(e, 1e-300)))
                return np.concatenate(out)

            return mapped(along, features, "array<double>")
        g = np.asarray(self.geodesic_)
        means = (g * g).mean(0)

        def fn(q):
            d = np.sqrt(sq_distances(q, x))
            near = np.argsort(d, axis=1, kind="stable")[:, :n]
            far = np.min(np.take_along_axis(d, near, 1)[:, :, None] + g[near], axis=1) ** 2
            return -0.5 * (far - means) @ (y / np.maximum(e, 1e-300))

        return mapped(fn, features, "array<double>")


def _parts(linked: np.ndarray) -> np.ndarray:
    part = np.full(len(linked), -1)
    for k in range(len(linked)):
        if part[k] < 0:
            c = part.max() + 1
            todo = [k]
            part[k] = c
            while todo:
                new = np.nonzero(linked[todo.pop()] & (part < 0))[0]
                part[new] = c
                todo += new.tolist()
    return part


class LocallyLinearEmbedding(_Embedding):
    """Coordinates that the rows' neighbour weights reproduce best. Beyond `limit` rows tasks find neighbours and
    weights, and the matrix stays sparse."""

    defaults = {"n_components": 2, "n_neighbors": 5, "reg": 1e-3, "limit": 4_000}
    any_rows = True

    @staticmethod
    def weights(q, x, near, reg):
        out = np.empty(near.shape)
        for i in range(len(q)):
            z = x[near[i]] - q[i]
            g = z @ z.T
            t = np.trace(g)
            w = np.linalg.solve(g + np.eye(len(g)) * reg * (t if t > 0 else 1), np.ones(len(g)))
            out[i] = w / w.sum()
        return out

    def _fit_sparse(self, spark, x, ids):
        """The directions of least error that are orthogonal to the constant one, whose error is 0."""
        n, k, size = len(x), int(self.n_components), int(self.n_neighbors)
        shared = spark.sparkContext.broadcast(x)
        near = near_rows(spark, shared, n, size, False, root=False)[0]
        w = by_blocks(spark, shared, n, lambda x, own: self.weights(x[own], x, near[own], self.reg))
        shared.destroy()
        every = np.repeat(np.arange(n), size)
        there, back = Links(n, every, near.ravel(), w.ravel()), Links(n, near.ravel(), every, w.ravel())

        def error(v):
            v = v - there(v)
            return v - back(v)

        v = np.random.default_rng(0).normal(size=(n, 4))
        for _ in range(40):
            v = error(v)
            size = np.linalg.norm(v, axis=0)
            v /= size
        top = 1.2 * size.max()

        def scaled(v):
            v = v - v.mean(0)
            v = v - 2 / top * error(v)
            return v - v.mean(0)

        e, v = leading(scaled, n, k)
        e, v = (1 - e[::-1][:k]) * top / 2, v[:, ::-1][:, :k]
        self.state |= {"ids": ids, "embedding": fixed_signs(v), "reconstruction_error": float(e.sum()), "x": x}
        return self

    def fit(self, df, features, id_col):
        x, ids = self._rows(df, features, id_col)
        if len(x) > self.limit:
            return self._fit_sparse(df.sparkSession, x, ids)
        near = np.argsort(np.round(sq_distances(x, x) + np.diag(np.full(len(x), np.inf)), 12), axis=1, kind="stable")[:, : int(self.n_neighbors)]
        w = np.zeros((len(x), len(x)))
        np.put_along_axis(w, near, self.weights(x, x, near, self.reg), 1)
        m = np.eye(len(x)) - w
        e, v = np.linalg.eigh(m.T @ m)
        k = int(self.n_components)
        self.state |= {"ids": ids, "embedding": fixed_signs(v[:, 1 : k + 1]), "reconstruction_error": float(e[1 : k + 1].sum()), "x": x}
        return self

    def transform_column(self, features) -> Column:
        x, y, n, reg = np.asarray(self.x_), np.asarray(self.embedding_), int(self.n_neighbors), self.reg

        def fn(q):
            near = np.concatenate([np.argsort(sq_distances(q[at : at + 64], x), axis=1, kind="stable")[:, :n] for at in range(0, len(q), 64)])
            return (self.weights(q, x, near, reg)[:, :, None] * y[near]).sum(1)

        return mapped(fn, features, "array<double>")


class SpectralEmbedding(_Embedding):
    """The smoothest directions of the affinity graph, the constant one left out. Beyond `limit` rows the graph is
    sparse, or, for rbf, computed anew by tasks for every product."""

    defaults = {"n_components": 2, "affinity": "nearest_neighbors", "gamma": 1.0, "n_neighbors": 10, "limit": 4_000}
    any_rows = True

    def fit(self, df, features, id_col):
        x, ids = self._rows(df, features, id_col)
        if len(x) > self.limit:
            self.state |= {"ids": ids, "embedding": spectral_rows(df.sparkSession, x, self.affinity, self.gamma, int(self.n_neighbors), int(self.n_components), drop_first=True)}
            return self
        self.state |= {"ids": ids, "embedding": spectral_map(affinity(x, self.affinity, self.gamma, int(self.n_neighbors)), int(self.n_components), drop_first=True)}
        return self


class TSNE(_Embedding):
    """Student-t neighbour embedding with exact gradients, from the principal components. Beyond `limit` rows each step
    is a job whose tasks compute the forces on blocks of 256 rows."""

    any_rows = True

    defaults = {"n_components": 2, "perplexity": 30.0, "early_exaggeration": 12.0, "learning_rate": "auto", "max_iter": 500, "limit": 3_000}

    def _start(self, x):
        """(coordinates, velocities, gains, rate)"""
        c = x - x.mean(0)
        u, sv, vt = np.linalg.svd(c, full_matrices=False)
        y = c @ fixed_signs(vt.T)[:, : int(self.n_components)]
        y = y / max(y[:, 0].std(), 1e-300) * 1e-4
        rate = max(len(x) / self.early_exaggeration / 4, 50) if self.learning_rate == "auto" else self.learning_rate
        return y, np.zeros_like(y), np.ones_like(y), rate

    @staticmethod
    def _moved(y, v, gain, rate, early, g):
        gain = np.maximum(np.where(g * v < 0, gain + 0.2, gain * 0.8), 0.01)
        v = (0.5 if early else 0.8) * v - rate * gain * g
        return y + v, v, gain

    @staticmethod
    def _widths(d: np.ndarray, own: np.ndarray, target: float) -> np.ndarray:
        """(beta, log of the sum) of each row's neighbour distribution exp(-beta d - log sum), its own place left out."""
        beta, lo, hi = np.ones(len(d)), np.zeros(len(d)), np.full(len(d), np.inf)
        for _ in range(64):
            z = -d * beta[:, None]
            z[np.arange(len(d)), own] = -np.inf
            top = z.max(1)
            z -= top[:, None]
            p = np.exp(z)
            z[np.arange(len(d)), own] = 0
            s = p.sum(1)
            last, wide = beta, np.log(s) - (p * z).sum(1) / s > target
            lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
            beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
        return np.column_stack([last, top + np.log(s)])

    @staticmethod
    def _likeness(held, own: np.ndarray) -> np.ndarray:
        x, beta, total = held
        d = sq_distances(x[own], x)
        p = np.exp(-d * beta[own, None] - total[own, None])
        p += np.exp(-d * beta - total)
        p /= 2 * len(x)
        return np.maximum(p, 1e-12, out=p)

    def _forces(self, spark, x: np.ndarray, target: float):
        """(force(y) = attraction, repulsion, their sum of weights; divergence(y, that sum); what to call at the end)"""
        n, shared = len(x), spark.sparkContext.broadcast(x)
        beta, total = by_blocks(spark, shared, n, lambda x, own: self._widths(sq_distances(x[own], x), own, target)).T
        shared.destroy()
        held = spark.sparkContext.broadcast((x, beta, total))

        def near(y, own):
            q = 1 / (1 + sq_distances(y[own], y))
            q[np.arange(len(own)), own] = 0
            return q

        def force(y):
            def fn(held, own):
                q = near(y, own)
                a, r = self._likeness(held, own) * q, q * q
                return np.hstack([a.sum(1)[:, None] * y[own] - a @ y, r.sum(1)[:, None] * y[own] - r @ y, q.sum(1)[:, None]])

            got = by_blocks(spark, held, n, fn)
            k = y.shape[1]
            return got[:, :k], got[:, k : 2 * k], float(got[:, -1].sum())

        def divergence(y, weight):
            def fn(held, own):
                p = self._likeness(held, own)
                v = p * np.log(p / np.maximum(near(y, own) / weight, 1e-12))
                v[np.arange(len(own)), own] = 0
                return v.sum(1)[:, None]

            return float(by_blocks(spark, held, n, fn).sum())

        return force, divergence, held.destroy

    def fit(self, df, features, id_col):
        x, ids = self._rows(df, features, id_col)
        n = len(x)
        target = math.log(min(self.perplexity, max(1.0, (n - 1) / 3)))
        if n > self.limit:
            force, divergence, end = self._forces(df.sparkSession, x, target)
            y, v, gain, rate = self._start(x)
            for it in range(int(self.max_iter)):
                early = it < min(250, self.max_iter // 2)
                pull, push, weight = force(y)
                y, v, gain = self._moved(y, v, gain, rate, early, 4 * ((self.early_exaggeration if early else 1.0) * pull - push / weight))
            self.state |= {"ids": ids, "embedding": y, "kl_divergence": divergence(y, force(y)[2])}
            end()
            return self
        d = sq_distances(x, x)
        beta, lo, hi = np.ones(n), np.zeros(n), np.full(n, np.inf)
        off = ~np.eye(n, dtype=bool)
        for _ in range(64):
            z = np.where(off, -d * beta[:, None], -np.inf)
            z = z - z.max(1, keepdims=True)
            p = np.exp(z)
            s = p.sum(1)
            h = np.log(s) - (p * np.where(off, z, 0)).sum(1) / s
            wide = h > target
            lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
            beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
        p = p / s[:, None]
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        y, v, gain, rate = self._start(x)
        for it in range(int(self.max_iter)):
            early = it < min(250, self.max_iter // 2)
            q = 1 / (1 + sq_distances(y, y))
            np.fill_diagonal(q, 0)
            w = ((self.early_exaggeration if early else 1.0) * p - q / q.sum()) * q
            y, v, gain = self._moved(y, v, gain, rate, early, 4 * (w.sum(1)[:, None] * y - w @ y))
        q = np.maximum(q / q.sum(), 1e-12)
        self.state |= {"ids": ids, "embedding": y, "kl_divergence": float((p[off] * np.log(p[off] / q[off])).sum())}
        return self


class UMAP(_Embedding):
    """Fuzzy neighbour graph laid out by stochastic attraction and keyed negative draws, from the spectral map. Beyond
    `limit` rows tasks find the neighbours and the graph is sparse."""

    any_rows = True

    defaults = {"n_neighbors": 15, "n_components": 2, "min_dist": 0.1, "spread": 1.0, "n_epochs": 200, "negative_sample_rate": 5, "learning_rate": 1.0, "seed": 0, "limit": 5_000}

    @staticmethod
    def curve(spread, min_dist):
        """a, b of 1 / (1 + a d^2b) closest to a plateau of min_dist and an exponential fall, by a grid refined."""
        x = np.linspace(0, 3 * spread, 300)[1:]
        y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
        a, b = 1.5, 1.0
        for _ in range(200):
            p = x ** (2 * b)
            f = 1 / (1 + a * p)
            r = f - y
            j = np.column_stack([-p * f * f, -2 * a * p * np.log(x) * f * f])
            step = np.linalg.lstsq(j.T @ j + 1e-9 * np.eye(2), -j.T @ r, rcond=None)[0]
            a, b = max(1e-3, a + 0.5 * step[0]), max(1e-3, b + 0.5 * step[1])
        return a, b

    @staticmethod
    def strengths(d):
        """Membership of each row's neighbours: distances beyond the nearest, scaled so that they sum to log2 k."""
        k = d.shape[1]
        rho = np.where((d > 0).any(1), np.where(d > 0, d, np.inf).min(1), 0)
        lo, hi, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
        for _ in range(64):
            s = np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None]).sum(1)
            big = s > math.log2(k)
            lo, hi = np.where(big, lo, sigma), np.where(big, sigma, hi)
            sigma = np.where(np.isinf(hi), sigma * 2, (lo + hi) / 2)
        return np.exp(-np.maximum(d - rho[:, None], 0) / np.maximum(sigma, 1e-3 * max(d.mean(), 1e-300))[:, None])

    def fit(self, df, features, id_col):
        x, ids = self._rows(df, features, id_col)
        n, k = len(x), min(int(self.n_neighbors), len(x) - 1)
        if n > self.limit:
            shared = df.sparkSession.sparkContext.broadcast(x)
            near, d = near_rows(df.sparkSession, shared, n, k, False)
            shared.destroy()
            i, j, v = np.repeat(np.arange(n), k), near.ravel(), self.strengths(d).ravel()
            there, back = np.isin(i * n + j, j * n + i), Links(n, np.append(i, j), np.append(j, i), np.append(v, v))
            both = Links(n, i[there], j[there], v[there])
            # each pair's sum of the two strengths, less their product where both are neighbours of each other
            at = np.searchsorted(back.i * n + back.j, both.i * n + both.j)
            back.v[at] -= both.v * (back.v[at] - both.v)
            y = smooth_map(back, n, int(self.n_components), drop_first=True)
            top = back.v.max()
            on = (back.i < back.j) & (back.v > top / max(1, self.n_epochs))
            i, j, share = back.i[on], back.j[on], back.v[on] / top
        else:
            d = np.sqrt(sq_distances(x, x))
            near = np.argsort(np.round(d + np.diag(np.full(n, np.inf)), 12), axis=1, kind="stable")[:, :k]
            w = np.zeros((n, n))
            np.put_along_axis(w, near, self.strengths(np.take_along_axis(d, near, 1)), 1)
            w = w + w.T - w * w.T
            y = spectral_map(w, int(self.n_components), drop_first=True)
            i, j = np.nonzero(np.triu(w) > w.max() / max(1, self.n_epochs))
            share = w[i, j] / w.max()
        y = 10 * y / max(np.abs(y).max(), 1e-300)
        a, b = self.curve(self.spread, self.min_dist)
        for epoch in range(int(self.n_epochs)):
            rate = self.learning_rate * (1 - epoch / self.n_epochs)
            on = np.floor((epoch + 1) * share) > np.floor(epoch * share)
            p, q = i[on], j[on]
            gap = y[p] - y[q]
            s = (gap * gap).sum(1)
            c = np.where(s > 0, -2 * a * b * np.maximum(s, 1e-12) ** (b - 1) / (1 + a * s**b), 0)[:, None]
            g = np.clip(c * gap, -4, 4) * rate
            np.add.at(y, p, g)
            np.add.at(y, q, -g)
            for r in range(int(self.negative_sample_rate)):
                key = mix64(p.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(epoch * 64 + r) + np.uint64(self.seed << 32))
                other = (key % np.uint64(n)).astype(int)
                gap = y[p] - y[other]
                s = (gap * gap).sum(1)
                c = np.where(other != p, 2 * b / ((0.001 + s) * (1 + a * s**b)), 0)[:, None]
                np.add.at(y, p, np.clip(c * gap, -4, 4) * rate)
        self.state |= {"ids": ids, "embedding": y, "x": x, "a": a, "b": b}
        return self

    def transform_column(self, features) -> Column:
        """New rows go to the mean of their neighbours by strength."""
        x, y, k = np.asarray(self.x_), np.asarray(self.embedding_), int(self.n_neighbors)

        def fn(q):
            d = np.sqrt(sq_distances(q, x))
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            w = self.strengths(np.take_along_axis(d, near, 1))
            return (w[:, :, None] * y[near]).sum(1) / w.sum(1)[:, None]

        return mapped(fn, features, "array<double>")


# --- linear algebra over rows ----------------------------------------------------------------------------------------


def gram(df: DataFrame, features) -> np.ndarray:
    return total(rows_of(df, features), lambda x: {"g": x.T @ x})["g"]


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two long tables (i, k, v) and (k, j, v): a join on k and a grouped sum."""
    x = a.select("i", F.col("k").alias("_k"), F.col("v").alias("u"))
    return x.join(b, F.col("_k") == F.col("k")).groupBy("i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("v"))


def matmul_rows(df: DataFrame, features, other: np.ndarray, out: str = "product") -> DataFrame:
    """Each row times a matrix that fits a task."""
    w = np.asarray(other, float)
    return df.withColumn(out, mapped(lambda x: x @ w, features, "array<double>"))


def qr_r(df: DataFrame, features) -> np.ndarray:
    """R of the tall matrix (positive diagonal): tasks factor their rows, the factors' stack is factored in turn."""
    import pyarrow as pa

    from millrace.learn.base import FAN_IN

    def run(batches):
        r = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                r = np.linalg.qr(x if r is None else np.concatenate([r, x]), mode="r")
        if r is not None:
            yield pa.record_batch([pa.array([v.tolist() for v in r], pa.list_(pa.float64()))], ["x"])

    part = rows_of(df, features).mapInArrow(run, "x array<double>")
    held = part.repartition(F.spark_partition_id() % FAN_IN).mapInArrow(run, "x array<double>").toArrow()
    r = np.linalg.qr(matrix(held["x"]), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def qr_q_column(features, r: np.ndarray) -> Column:
    inv = np.linalg.pinv(np.asarray(r))
    return mapped(lambda x: x @ inv, features, "array<double>")


def eigh(a) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and vectors of a symmetric matrix, signs fixed."""
    e, v = np.linalg.eigh(np.asarray(a, float))
    return e, fixed_signs(v)


def svdvals(df: DataFrame, features) -> np.ndarray:
    """Singular values of the rows: those of R, which loses no digits to squaring."""
    return np.linalg.svd(qr_r(df, features), compute_uv=False)


def svd(df: DataFrame, features) -> tuple[Column, np.ndarray, np.ndarray]:
    """(column of U's rows, singular values, V^T)."""
    r = qr_r(df, features)
    _, s, vt = np.linalg.svd(r)
    vt = fixed_signs(vt.T).T
    w = vt.T / np.where(s > 1e-300, s, 1)
    return mapped(lambda x: x @ w, features, "array<double>"), s, vt


def randomized_svd(df: DataFrame, features, k: int, oversample: int = 10, power: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, V^T) of the k leading directions, by passes that multiply a thin block."""
    rows = rows_of(df, features).persist()
    try:
        d = len(rows.first()["x"])
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(d, k + oversample))))[0]
        for _ in range(power):
            q = np.linalg.qr(total(rows, lambda x, q=q: {"g": x.T @ (x @ q)})["g"])[0]
        g = total(rows, lambda x: {"g": (x @ q).T @ (x @ q)})["g"]
    finally:
        rows.unpersist()
    e, v = np.linalg.eigh(g)
    return np.sqrt(np.maximum(e[::-1][:k], 0)), fixed_signs(q @ v[:, ::-1][:, :k]).T


def lstsq(df: DataFrame, features, label: str) -> np.ndarray:
    """Least squares by R of (x, y), without intercept."""
    both = df.select(F.concat(vector(features), F.array(F.col(label).cast("double"))).alias("x"))
    r = qr_r(both, "x")
    d = r.shape[1] - 1
    return np.linalg.lstsq(r[:d, :d], r[:d, d], rcond=None)[0]


def lu(a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P, L, U) of a square matrix with partial pivoting: P A = L U."""
    u = np.array(a, float)
    n = len(u)
    low, p = np.eye(n), np.arange(n)
    for k in range(n):
        i = k + int(np.abs(u[k:, k]).argmax())
        if i != k:
            u[[k, i]], p[[k, i]] = u[[i, k]], p[[i, k]]
            low[[k, i], :k] = low[[i, k], :k]
        if u[k, k]:
            f = u[k + 1 :, k] / u[k, k]
            low[k + 1 :, k] = f
            u[k + 1 :, k:] -= np.outer(f, u[k, k:])
            u[k + 1 :, k] = 0
    return np.eye(n)[p], low, u


def quantize_int8(df: DataFrame, features: str, out: str = "codes", scale: str = "scale") -> DataFrame:
    """Each row's vector as bytes: round(x / scale), scale the largest absolute value over 127 (1 for a zero row)."""
    x = vector(features)
    top = F.array_max(F.transform(x, F.abs))
    s = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return df.withColumn(scale, s).withColumn(out, F.transform(x, lambda v: F.rint(v / F.col(scale)).cast("byte")))


def dequantize_int8(df: DataFrame, codes: str = "codes", scale: str = "scale", out: str = "restored") -> DataFrame:
    return df.withColumn(out, F.transform(codes, lambda v: v.cast("double") * F.col(scale)))
