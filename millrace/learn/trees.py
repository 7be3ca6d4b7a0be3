"""Decision trees, forests and boosting on histograms.

Features are cut at borders (exact or approximate quantiles). A level of all trees of a group grows by one pass over
the rows: every task sums each row's statistics into (tree, node, feature, bin) cells, the driver picks splits from the
totals. A pass costs a task memory in proportion to the cells, which `CELLS` bounds by growing fewer trees at a time,
never to the rows. Rows are never moved; which node a row is in is found by walking the trees so far.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.learn.base import Classifier, Estimator, Regressor, Transformer, classes_of, coded, keyed, mapped, mix64, named_class, rows_of, total, vector
from millrace.learn.graph import checkpoint

#: Cells of all histograms of one pass.
CELLS = 4_000_000


def quantile_borders(df: DataFrame, features, bins: int = 32, accuracy: int = 10_000) -> list[list[float]]:
    """Up to bins - 1 borders per feature between approximate quantiles (relative rank error 1 / accuracy)."""
    x = vector(features)
    d = len(df.select(x.alias("x")).first()["x"])
    grid = [k / bins for k in range(1, bins)]
    held = df.select(x.alias("x")).agg(*[F.percentile_approx(F.col("x")[k], grid, accuracy).alias(f"q{k}") for k in range(d)], *[F.max(F.col("x")[k]).alias(f"m{k}") for k in range(d)]).first()
    return [sorted({float(v) for v in held[f"q{k}"] if v < held[f"m{k}"]}) for k in range(d)]


class Tree:
    """Nodes as arrays: feature (-1 at leaves), cut (left if x <= cut), left, right, value and weight of the rows."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value, self.weight, self.gain = [], [], [], [], [], [], []

    def add(self, value, weight) -> int:
        for a, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value), (self.weight, float(weight)), (self.gain, 0.0)):
            a.append(v)
        return len(self.feature) - 1

    def pack(self) -> dict:
        return {"feature": list(self.feature), "cut": [float(c) for c in self.cut], "left": list(self.left), "right": list(self.right), "value": [np.asarray(v, float).ravel().tolist() for v in self.value], "weight": self.weight, "gain": [float(g) for g in self.gain]}


def walk(t: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    f, c, lo, hi = (np.asarray(t[k]) for k in ("feature", "cut", "left", "right"))
    at, every = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        inner = f[at] >= 0
        if not inner.any():
            return at
        go = x[every, np.maximum(f[at], 0)] <= c[at]
        at = np.where(inner, np.where(go, lo[at], hi[at]), at)


def leaf_values(trees: list[dict]) -> list[np.ndarray]:
    return [np.array(t["value"]) for t in trees]


def forest_sum(trees: list[dict], scale: list[float] | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """x -> sum of the trees' leaf values (rows, outputs)."""
    values = leaf_values(trees)

    def fn(x):
        out = np.zeros((len(x), values[0].shape[1] if values else 1))
        for k, t in enumerate(trees):
            out += values[k][walk(t, x)] * (1.0 if scale is None else scale[k])
        return out

    return fn


def poisson_weights(key: np.ndarray, tree: int, seed: int, rate: float = 1.0) -> np.ndarray:
    """Times a row is in a tree's bootstrap: Poisson(rate) from a hash of key, tree and seed."""
    salt = np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xD1342543DE82EF95 + 1) & (2**64 - 1))
    u = (mix64(key.astype(np.int64).view(np.uint64) ^ salt) >> np.uint64(11)).astype(float) / 2**53
    term = s = math.exp(-rate)
    out = np.zeros(len(key))
    for k in range(1, 40):
        out += u >= s
        term *= rate / k
        s += term
    return out


def grow(rows: DataFrame, borders, n_trees: int, max_depth: int, stats, gain, leaf, *, min_leaf: float = 1, min_gain: float = 0.0, max_features=None, random_cuts: bool = False, weights=None, seed: int = 0, oblivious: bool = False, first_tree: int = 0) -> list[dict]:
    """Trees over rows (x and what `stats` reads), level by level.

    stats(columns, tree) gives (rows, S) numbers to sum, the first being the weight; gain(left, right, parent) scores
    splits of summed statistics along the last axis; leaf(sums) gives a node's value. With `oblivious` all nodes of a
    level share one split.
    """
    d = len(borders)
    width = max((len(b) for b in borders), default=0) + 1
    cuts = [np.asarray(b) for b in borders]
    out: list[dict] = []
    probe: list[int] = []
    group = n_trees
    at = 0
    while at < n_trees:
        own = list(range(at, min(n_trees, at + group)))
        trees = [Tree() for _ in own]
        active = [[0] for _ in own]
        for level in range(max(1, max_depth)):
            if not any(active):
                break
            packed = [t.pack() if level else None for t in trees]
            slots = [{n: k for k, n in enumerate(a)} for a in active]

            def fn(**c):
                x = c["x"]
                bins = [np.searchsorted(cuts[f], x[:, f], "left") for f in range(d)]
                res = {}
                for k, t in enumerate(own):
                    if not active[k]:
                        continue
                    s = stats(c, first_tree + t)
                    if level:
                        node = walk(packed[k], x)
                        table = np.full(len(packed[k]["feature"]), -1)
                        table[active[k]] = np.arange(len(active[k]))
                        slot = table[node]
                        live = (slot >= 0) & (s[:, 0] != 0)
                    else:
                        slot, live = np.zeros(len(x), int), s[:, 0] != 0
                    n = len(active[k])
                    h = np.zeros((n, d, width, s.shape[1]))
                    sl, sv = slot[live], s[live]
                    for f in range(d):
                        cell = sl * width + bins[f][live]
                        for j in range(s.shape[1]):
                            h[:, f, :, j] = np.bincount(cell, sv[:, j], n * width).reshape(n, width)
                    res[f"t{k}"] = h
                return res

            got = total(rows, fn)
            size = max((v.size for v in got.values()), default=1)
            probe.append(size)
            for k, t in enumerate(own):
                if not active[k] or f"t{k}" not in got:
                    active[k] = []
                    continue
                h, tree, new = got[f"t{k}"], trees[k], []
                sums = h[:, 0].sum(1)
                if not level:
                    tree.add(leaf(sums[0]), sums[0, 0])
                low = np.cumsum(h, axis=2)[:, :, :-1]
                top = sums[:, None, None]
                high = top - low
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = gain(low, high, np.broadcast_to(top, low.shape))
                ok = (low[..., 0] >= min_leaf) & (high[..., 0] >= min_leaf) & np.isfinite(g)
                for f in range(d):
                    ok[:, f, len(cuts[f]) :] = False
                g = np.where(ok, g, -np.inf)
                if not max_depth:
                    active[k] = []
                    continue
                if oblivious:
                    all_ = np.where(ok, g, 0).sum(0)
                    f, b = np.unravel_index(int(all_.argmax()), all_.shape) if all_.size else (0, 0)
                    picks = [(f, b) if all_.size and all_[f, b] > min_gain else None] * len(active[k])
                else:
                    picks = []
                    for s, node in enumerate(active[k]):
                        rng = np.random.default_rng([seed, first_tree + t, node])
                        cand = np.arange(d) if max_features is None else np.sort(rng.choice(d, min(d, max_features), replace=False))
                        best, pick = min_gain, None
                        for f in cand:
                            if random_cuts:
                                there = np.nonzero(h[s, f, :, 0])[0]
                                if len(there) < 2:
                                    continue
                                choice = [int(rng.integers(there[0], there[-1]))]
                            else:
                                choice = [int(g[s, f].argmax())] if g.shape[2] else []
                            for b in choice:
                                if g[s, f, b] > best + 1e-12:
                                    best, pick = g[s, f, b], (int(f), b)
                        picks.append(pick)
                for s, (node, pick) in enumerate(zip(active[k], picks)):
                    if pick is None:
                        continue
                    f, b = pick
                    if b >= len(cuts[f]):
                        continue
                    if oblivious and not (low[s, f, b, 0] > 0 and high[s, f, b, 0] > 0):
                        value = tree.value[node]
                        a, c = tree.add(value if low[s, f, b, 0] <= 0 else leaf(low[s, f, b]), low[s, f, b, 0]), tree.add(value if high[s, f, b, 0] <= 0 else leaf(high[s, f, b]), high[s, f, b, 0])
                    else:
                        a, c = tree.add(leaf(low[s, f, b]), low[s, f, b, 0]), tree.add(leaf(high[s, f, b]), high[s, f, b, 0])
                    tree.feature[node], tree.cut[node], tree.left[node], tree.right[node], tree.gain[node] = int(f), float(cuts[f][b]), a, c, float(g[s, f, b]) if np.isfinite(g[s, f, b]) else 0.0
                    new += [a, c]
                active[k] = new
            if sum(map(len, active)) * d * width * (h.shape[3] if got else 1) > CELLS and len(own) > 1:
                # the next level would be too large for all trees of the group: the later ones wait for a group of their own
                keep = max(1, len(own) // 2)
                own, trees, active = own[:keep], trees[:keep], active[:keep]
        _ = slots
        for t in trees:
            if not t.feature:
                t.add(leaf(np.zeros(stats_width(stats))), 0.0)
            out.append(t.pack())
        at += len(own)
        group = max(1, len(own))
    return out


def stats_width(stats) -> int:
    return getattr(stats, "width", 1)


def _gini(low, high, top):
    """Weighted decrease of Gini impurity; statistics are (weight, class weights...)."""
    part = lambda s: (s[..., 1:] ** 2).sum(-1) / np.maximum(s[..., 0], 1e-300)
    return (part(low) + part(high) - part(top)) / np.maximum(top[..., 0], 1e-300)


def _entropy(low, high, top):
    def part(s):
        p = s[..., 1:] / np.maximum(s[..., :1], 1e-300)
        return -(s[..., 1:] * np.log(np.maximum(p, 1e-300))).sum(-1)

    return (part(top) - part(low) - part(high)) / np.maximum(top[..., 0], 1e-300)


def _variance(low, high, top):
    """Decrease of squared error; statistics are (weight, sum)."""
    part = lambda s: s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-300)
    return (part(low) + part(high) - part(top)) / np.maximum(top[..., 0], 1e-300)


_TREE = {"max_depth": 6, "n_bins": 64, "min_samples_leaf": 1, "min_impurity_decrease": 0.0, "max_features": None, "seed": 0}


class _Forest(Estimator):
    bootstrap_default, extra = False, False

    def _features(self, d: int):
        m = self.max_features
        return None if m is None else max(1, int(math.sqrt(d))) if m == "sqrt" else max(1, int(math.log2(d))) if m == "log2" else max(1, int(m * d)) if isinstance(m, float) else int(m)

    def _fit(self, df, features, y: Column, weight, key, stats_of, gain, leaf, n_trees: int):
        self._seen(features)
        boot = self.params.get("bootstrap", False)
        rows = rows_of(df, features, y, weight, key=F.xxhash64(F.lit(self.seed), *([F.col(key)] if key else [vector(features), y]))).persist()
        try:
            borders = quantile_borders(rows, "x", int(self.n_bins))
            seed = int(self.seed)

            def stats(c, tree):
                w = c["w"] if "w" in c else np.ones(len(c["x"]))
                if boot:
                    w = w * poisson_weights(c["key"], tree, seed)
                return stats_of(c, w)

            trees = grow(rows, borders, n_trees, int(self.max_depth), stats, gain, leaf, min_leaf=self.min_samples_leaf, min_gain=self.min_impurity_decrease, max_features=self._features(len(borders)), random_cuts=self.extra, seed=seed)
            self.state |= {"trees": trees, "borders": borders}
            if boot and self.params.get("oob_score"):
                self.state["oob_score"] = self._oob(rows, trees, seed)
        finally:
            rows.unpersist()
        imp = np.zeros(len(borders))
        for t in trees:
            for f, g, w in zip(t["feature"], t["gain"], t["weight"]):
                if f >= 0:
                    imp[f] += g * w / max(t["weight"][0], 1e-300)
        self.state["feature_importances"] = imp / imp.sum() if imp.sum() > 0 else imp
        return self

    def apply_column(self, features) -> Column:
        """The leaf of each tree."""
        trees = self.trees_
        return mapped(lambda x: np.column_stack([walk(t, x) for t in trees]).astype(np.int64), features, "array<long>")


class DecisionTreeClassifier(_Forest, Classifier):
    """One tree by Gini or entropy on histograms."""

    defaults = {**_TREE, "criterion": "gini", "class_weight": None}

    def _n(self):
        return int(self.params.get("n_estimators", 1))

    def fit(self, df: DataFrame, features, label: str, weight: str | None = None, key: str | None = None):
        classes = classes_of(df, label)
        k = len(classes)
        code = coded(label, classes)
        w = F.col(weight).cast("double") if weight else None
        if self.class_weight is not None:
            by = self.class_weight
            if by == "balanced":
                n = {r["y"]: r["n"] for r in df.select(code.alias("y")).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
                by = {c: sum(n.values()) / (k * n[i]) for i, c in enumerate(classes)}
            own = F.lit(1.0)
            for c, v in by.items():
                own = F.when(F.col(label) == F.lit(c), F.lit(float(v))).otherwise(own)
            w = own if w is None else w * own

        def stats(c, w):
            out = np.zeros((len(w), k + 1))
            out[:, 0] = w
            out[np.arange(len(w)), 1 + c["y"].astype(int)] = w
            return out

        def leaf(s):
            return s[1:] / s[0] if s[0] > 0 else np.full(k, 1 / k)

        self.state["classes"] = classes
        return self._fit(df, features, code, w, key, stats, _entropy if self.criterion == "entropy" else _gini, leaf, self._n())

    def _oob(self, rows, trees, seed):
        values = leaf_values(trees)

        def fn(x, y, key, w=None):
            p = np.zeros((len(x), values[0].shape[1]))
            for t in range(len(trees)):
                out = poisson_weights(key, t, seed) == 0
                p[out] += values[t][walk(trees[t], x[out])]
            seen = p.sum(1) > 0
            return {"hit": np.array(float((p.argmax(1) == y)[seen].sum())), "n": np.array(float(seen.sum()))}

        s = total(rows, fn)
        return float(s["hit"] / max(s["n"], 1))

    def proba_column(self, features) -> Column:
        fn, n = forest_sum(self.trees_), len(self.trees_)
        return mapped(lambda x: fn(x) / n, features, "array<double>")

    def predict_column(self, features) -> Column:
        fn = forest_sum(self.trees_)
        return named_class(mapped(lambda x: np.round(fn(x), 12).argmax(1), features, "int"), self.classes_)


class DecisionTreeRegressor(_Forest, Regressor):
    """One tree by squared error on histograms."""

    defaults = dict(_TREE)
    _n = DecisionTreeClassifier._n

    def fit(self, df: DataFrame, features, label: str, weight: str | None = None, key: str | None = None):
        return self._fit(df, features, F.col(label).cast("double"), weight, key, lambda c, w: np.column_stack([w, w * c["y"]]), _variance, lambda s: np.array([s[1] / s[0] if s[0] > 0 else 0.0]), self._n())

    def _oob(self, rows, trees, seed):
        values = leaf_values(trees)

        def fn(x, y, key, w=None):
            p, n = np.zeros(len(x)), np.zeros(len(x))
            for t in range(len(trees)):
                out = poisson_weights(key, t, seed) == 0
                p[out] += values[t][walk(trees[t], x[out]), 0]
                n += out
            own = n > 0
            r, z = y[own] - p[own] / n[own], y[own]
            return {"e": np.array((r * r).sum()), "s": np.array(z.sum()), "q": np.array((z * z).sum()), "n": np.array(float(own.sum()))}

        s = total(rows, fn)
        return float(1 - s["e"] / max(s["q"] - s["s"] ** 2 / max(s["n"], 1), 1e-300))

    def predict_column(self, features) -> Column:
        fn, n = forest_sum(self.trees_), len(self.trees_)
        return mapped(lambda x: fn(x)[:, 0] / n, features)


_MANY = {"n_estimators": 20, "bootstrap": True, "oob_score": False}


class RandomForestClassifier(DecisionTreeClassifier):
    """Trees over Poisson bootstraps keyed by row, each split among a random subset of features."""

    defaults = {**DecisionTreeClassifier.defaults, **_MANY, "max_features": "sqrt"}


class RandomForestRegressor(DecisionTreeRegressor):
    defaults = {**DecisionTreeRegressor.defaults, **_MANY}


class ExtraTreesClassifier(RandomForestClassifier):
    """Random cuts within each node's occupied bins, on all rows."""

    defaults = {**RandomForestClassifier.defaults, "bootstrap": False}
    extra = True


class ExtraTreesRegressor(RandomForestRegressor):
    defaults = {**RandomForestRegressor.defaults, "bootstrap": False}
    extra = True


class RandomTreesEmbedding(ExtraTreesRegressor, Transformer):
    """Indicators of the leaves that a row reaches in random trees on random targets."""

    defaults = {**ExtraTreesRegressor.defaults, "n_estimators": 10, "max_depth": 5, "max_features": 1}

    def fit(self, df, features, label=None, weight=None, key=None):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(self.seed + 7), vector(features)), 11)).cast("double")
        self._fit(df, features, u / F.lit(float(1 << 53)), weight, key, lambda c, w: np.column_stack([w, w * c["y"]]), lambda lo, hi, t: np.ones(lo.shape[:-1]), lambda s: np.array([0.0]), self._n())
        leaves = [[k for k, f in enumerate(t["feature"]) if f < 0] for t in self.trees_]
        self.state["places"] = leaves
        return self

    def transform_column(self, features) -> Column:
        trees, leaves = self.trees_, self.places_
        base = np.cumsum([0] + [len(v) for v in leaves])

        def fn(x):
            out = np.zeros((len(x), int(base[-1])))
            for k, t in enumerate(trees):
                table = np.zeros(len(t["feature"]), int)
                table[leaves[k]] = np.arange(len(leaves[k]))
                out[np.arange(len(x)), base[k] + table[walk(t, x)]] = 1
            return out

        return mapped(fn, features, "array<double>")


# --- boosting -------------------------------------------------------------------------------------------------------


def _sig(f):
    return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def boosting_loss(name: str, param: float, k: int):
    """(gradient and curvature of (y, raw scores) per output) of a loss."""
    if name == "rmse":
        return lambda y, f: (f[:, 0] - y, np.ones(len(y)))
    if name == "logloss":
        return lambda y, f: ((p := _sig(f[:, 0])) - y, np.maximum(p * (1 - p), 1e-9))
    if name == "quantile":
        return lambda y, f: (np.where(y > f[:, 0], -param, 1 - param), np.ones(len(y)))
    if name == "mae":
        return lambda y, f: (np.sign(f[:, 0] - y), np.ones(len(y)))
    if name == "poisson":
        return lambda y, f: ((m := np.exp(np.clip(f[:, 0], -50, 50))) - y, np.maximum(m, 1e-9))
    if name == "tweedie":
        return lambda y, f: ((a := np.exp((2 - param) * f[:, 0])) - (b := y * np.exp((1 - param) * f[:, 0])), np.maximum((2 - param) * a - (1 - param) * b, 1e-9))
    raise ValueError(f"no loss {name}")


class GradientBoosting(Estimator):
    """Trees on gradients: rmse, logloss, multiclass, multi_ova, quantile, mae, poisson, tweedie, multi_rmse and, with
    groups, query_rmse and pair_logit.

    grow_policy is symmetric (one split per level) or depthwise; others are refused by name. Raw scores of rows are
    kept as a column that a checkpoint renews every `renew` trees. `eval` (a DataFrame) and od_wait stop early.
    """

    defaults = {"loss": "rmse", "param": 0.5, "n_estimators": 100, "learning_rate": 0.1, "max_depth": 6, "l2_leaf_reg": 3.0, "n_bins": 64, "grow_policy": "symmetric", "bootstrap": False, "min_samples_leaf": 1, "max_features": None, "od_wait": None, "renew": 10, "seed": 0}

    def fit(self, df: DataFrame, features, label, weight: str | None = None, key: str | None = None, group: str | None = None, eval: DataFrame | None = None):
        if self.grow_policy not in ("symmetric", "depthwise"):
            raise ValueError(f"no grow policy {self.grow_policy}")
        self.state["features"] = features if isinstance(features, str) else list(features)
        loss, many = self.loss, self.loss in ("multiclass", "multi_ova", "multi_rmse")
        classes = classes_of(df, label) if loss in ("logloss", "multiclass", "multi_ova") else []
        if loss == "multi_rmse":
            labels = list(label)
            y = F.array(*[F.col(c).cast("double") for c in labels])
            k = len(labels)
        else:
            y, k = (coded(label, classes) if classes else F.col(label)).cast("double"), len(classes) if many else 1
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        more = {"g": F.xxhash64(F.col(group))} if group else {}
        base_key = F.xxhash64(F.lit(self.seed), *([F.col(key)] if key else [vector(features), F.col(label) if isinstance(label, str) else vector(label)]))
        cols = df.select(vector(features).alias("x"), y.alias("y"), w.alias("w"), base_key.alias("key"), *[v.alias(n) for n, v in more.items()])
        start = self._start(cols, loss, k)
        f0 = F.array(*[F.lit(float(v)) for v in start])
        rows = checkpoint(cols.withColumn("f", f0))
        borders = quantile_borders(rows, "x", int(self.n_bins))
        lr, l2, seed, boot = float(self.learning_rate), float(self.l2_leaf_reg), int(self.seed), self.bootstrap
        held: list[list[dict]] = []
        pending: list[list[dict]] = []
        watch = None
        if eval is not None:
            yy = (coded(label, classes) if classes else F.col(label)).cast("double") if loss != "multi_rmse" else y
            watch = eval.select(vector(features).alias("x"), yy.alias("y")).persist()
        best, scores = (math.inf, 0), []
        one = None if many else boosting_loss(loss, self.param, k) if loss not in ("query_rmse", "pair_logit") else None
        for it in range(int(self.n_estimators)):
            now = rows
            if loss in ("query_rmse", "pair_logit"):
                now = self._grouped(rows, pending, loss)
            late = [forest_sum([t[j] for t in pending]) for j in range(k)] if pending else None
            trees = []
            for j in range(k):
                def stats(c, tree, j=j):
                    f = c["f"]
                    if late:
                        f = f + lr * np.column_stack([fn(c["x"])[:, 0] for fn in late])
                    if loss == "multiclass":
                        z = np.exp(f - f.max(1, keepdims=True))
                        p = (z / z.sum(1, keepdims=True))[:, j]
                        g, h = p - (c["y"] == j), np.maximum(p * (1 - p), 1e-9)
                    elif loss == "multi_ova":
                        p = _sig(f[:, j])
                        g, h = p - (c["y"] == j), np.maximum(p * (1 - p), 1e-9)
                    elif loss == "multi_rmse":
                        g, h = f[:, j] - c["y"][:, j], np.ones(len(f))
                    elif one is None:
                        g, h = c["grad"], c["hess"]
                    else:
                        g, h = one(c["y"], f)
                    ww = c["w"] * (poisson_weights(c["key"], it, seed) if boot else 1.0)
                    return np.column_stack([ww, ww * g, ww * h])

                stats.width = 3
                score = lambda s: s[..., 1] ** 2 / (s[..., 2] + l2)
                trees += grow(now, borders, 1, int(self.max_depth), stats, lambda a, b, t: 0.5 * (score(a) + score(b) - score(t)), lambda s: np.array([-s[1] / (s[2] + l2)]), min_leaf=self.min_samples_leaf, min_gain=1e-12, max_features=None if self.max_features is None else max(1, int(self.max_features * len(borders))), seed=seed, oblivious=self.grow_policy == "symmetric", first_tree=it)
            held.append(trees)
            pending.append(trees)
            if len(pending) >= int(self.renew):
                rows = checkpoint(self._advanced(rows, pending))
                pending = []
            if watch is not None:
                s = self._loss_of(watch, held, start, loss, k)
                scores.append(s)
                if s < best[0] - 1e-12:
                    best = (s, it + 1)
                if self.od_wait and it + 1 - best[1] >= self.od_wait:
                    break
        if watch is not None:
            watch.unpersist()
            if self.od_wait:
                held = held[: best[1]]
        self.state |= {"trees": held, "start": [float(v) for v in start], "classes": classes, "outputs": k, "eval_scores": scores, "best_iteration": best[1] if watch is not None else len(held)}
        return self

    def _start(self, cols, loss, k):
        s = cols.agg(F.sum("w").alias("w"), *([F.sum(F.col("w") * F.col("y")).alias("s"), F.percentile_approx("y", float(self.param) if loss == "quantile" else 0.5, 10_000).alias("q")] if loss != "multi_rmse" else [F.sum(F.col("w") * F.col("y")[j]).alias(f"s{j}") for j in range(k)])).first()
        if not s["w"]:
            raise ValueError("no rows to fit")
        if loss == "multi_rmse":
            return [s[f"s{j}"] / s["w"] for j in range(k)]
        m = s["s"] / s["w"]
        if loss == "logloss":
            return [math.log(max(m, 1e-9) / max(1 - m, 1e-9))]
        if loss in ("poisson", "tweedie"):
            return [math.log(max(m, 1e-9))]
        return [m] if loss == "rmse" else [s["q"]] if loss in ("quantile", "mae") else [0.0] * k

    def _advanced(self, rows, pending):
        k, lr = len(pending[0]), float(self.learning_rate)
        fns = [forest_sum([t[j] for t in pending]) for j in range(k)]
        add = mapped(lambda x: lr * np.column_stack([fn(x)[:, 0] for fn in fns]), "x", "array<double>")
        return rows.withColumn("_add", add).withColumn("f", F.zip_with("f", "_add", lambda a, b: a + b)).drop("_add")

    def _grouped(self, rows, pending, loss):
        now = self._advanced(rows, pending) if pending else rows
        if loss == "query_rmse":
            m = now.groupBy("g").agg((F.sum(F.col("w") * (F.col("y") - F.col("f")[0])) / F.sum("w")).alias("shift"))
            return now.join(m, "g").select("x", "y", "w", "key", "f", (F.col("f")[0] + F.col("shift") - F.col("y")).alias("grad"), F.lit(1.0).alias("hess")).persist()
        # pairs of different labels within a group, by the group's distinct (label, score) lists: groups are queries of
        # bounded length, which is checked
        long = now.groupBy("g").agg(F.collect_list(F.struct("y", F.col("f")[0].alias("s"))).alias("peers"), F.count(F.lit(1)).alias("n"))
        if (top := long.agg(F.max("n")).first()[0]) and top > 10_000:
            raise ValueError("a group has more than 10,000 rows")
        s = F.col("f")[0]
        p = lambda v: F.lit(1.0) / (1 + F.exp(v))
        grad = F.aggregate("peers", F.lit(0.0), lambda a, r: a + F.when(F.col("y") > r["y"], -p(s - r["s"])).when(F.col("y") < r["y"], p(r["s"] - s)).otherwise(0.0))
        hess = F.aggregate("peers", F.lit(1e-9), lambda a, r: a + F.when(F.col("y") != r["y"], p(s - r["s"]) * p(r["s"] - s)).otherwise(0.0))
        return now.join(long, "g").select("x", "y", "w", "key", "f", grad.alias("grad"), hess.alias("hess")).persist()

    def _loss_of(self, watch, held, start, loss, k):
        raw = self._raw_fn(held, start)

        def fn(x, y):
            f = raw(x)
            if loss == "multiclass":
                z = f - f.max(1, keepdims=True)
                v = np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y.astype(int)]
            elif loss == "logloss":
                v = np.logaddexp(0, f[:, 0]) - y * f[:, 0]
            elif loss == "quantile":
                r = y - f[:, 0]
                v = np.maximum(self.param * r, (self.param - 1) * r)
            elif loss == "mae":
                v = np.abs(y - f[:, 0])
            elif loss == "poisson":
                v = np.exp(f[:, 0]) - y * f[:, 0]
            elif loss == "multi_ova":
                v = sum(np.logaddexp(0, f[:, j]) - (y == j) * f[:, j] for j in range(k))
            elif loss == "multi_rmse":
                v = ((f - y) ** 2).sum(1)
            else:
                v = (f[:, 0] - y) ** 2
            return {"v": np.array(v.sum()), "n": np.array(float(len(v)))}

        s = total(watch, fn)
        return float(s["v"] / s["n"])

    def _raw_fn(self, held=None, start=None):
        held, start, lr = self.trees_ if held is None else held, self.start_ if start is None else start, float(self.learning_rate)
        fns = [forest_sum([t[j] for t in held]) for j in range(len(start))] if held else []
        return lambda x: np.asarray(start)[None] + (lr * np.column_stack([fn(x)[:, 0] for fn in fns]) if fns else np.zeros((len(x), 1)))

    def raw_column(self, features) -> Column:
        return mapped(self._raw_fn(), features, "array<double>")

    def proba_column(self, features) -> Column:
        raw = self._raw_fn()
        if self.loss == "logloss":
            return mapped(lambda x: np.column_stack([1 - (p := _sig(raw(x)[:, 0])), p]), features, "array<double>")

        def fn(x):
            z = raw(x)
            z = _sig(z) if self.loss == "multi_ova" else np.exp(z - z.max(1, keepdims=True))
            return z / z.sum(1, keepdims=True)

        return mapped(fn, features, "array<double>")

    def predict_column(self, features) -> Column:
        raw, loss = self._raw_fn(), self.loss
        if loss == "multi_rmse":
            return mapped(raw, features, "array<double>")
        if self.classes_:
            code = (lambda x: (raw(x)[:, 0] > 0).astype(int)) if loss == "logloss" else (lambda x: raw(x).argmax(1))
            return named_class(mapped(code, features, "int"), self.classes_)
        return mapped(lambda x: np.exp(raw(x)[:, 0]) if loss in ("poisson", "tweedie") else raw(x)[:, 0], features)

    def predict(self, df, out: str = "prediction"):
        return df.withColumn(out, self.predict_column(self.features_))

    def score(self, df, label, weight=None):
        return (Classifier if self.classes_ else Regressor).score(self, df, label, weight)


class GradientBoostingClassifier(GradientBoosting):
    defaults = {**GradientBoosting.defaults, "loss": "logloss", "grow_policy": "depthwise", "max_depth": 3, "l2_leaf_reg": 0.0}


class GradientBoostingRegressor(GradientBoosting):
    defaults = {**GradientBoosting.defaults, "grow_policy": "depthwise", "max_depth": 3, "l2_leaf_reg": 0.0}


class OrderedRMSE(GradientBoosting):
    """Boosting on squared error where a row's score moves by its leaf's mean over earlier rows alone.

    The permutation is a hash of the key cut into `segments`; "earlier" are the segments before the row's own, so the
    leaf means are a table of leaves x segments, one pass a tree.
    """

    defaults = {**GradientBoosting.defaults, "segments": 32}

    def fit(self, df, features, label: str, weight=None, key: str | None = None):
        self.state["features"] = features if isinstance(features, str) else list(features)
        k = F.xxhash64(F.lit(self.seed), *([F.col(key)] if key else [vector(features), F.col(label)]))
        n_seg, lr, l2 = int(self.segments), float(self.learning_rate), float(self.l2_leaf_reg)
        rows = df.select(vector(features).alias("x"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.pmod(k, F.lit(n_seg)).cast("int").alias("seg"))
        s = rows.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s")).first()
        start = s["s"] / s["w"]
        rows = checkpoint(rows.withColumn("f", F.lit(start)))
        borders = quantile_borders(rows, "x", int(self.n_bins))
        score = lambda s: s[..., 1] ** 2 / (s[..., 0] + l2)
        held, pending = [], []
        moved = lambda f, x, seg: f + lr * sum((tab[walk(t, x), seg] for t, tab in pending), np.zeros(len(x)))
        for it in range(int(self.n_estimators)):
            late = list(pending)
            f_of = lambda c, late=late: c["f"] + lr * sum((tab[walk(t, c["x"]), c["seg"]] for t, tab in late), np.zeros(len(c["x"])))

            def stats(c, tree):
                return np.column_stack([c["w"], c["w"] * (c["y"] - f_of(c))])

            stats.width = 2
            t = grow(rows, borders, 1, int(self.max_depth), stats, lambda a, b, p: 0.5 * (score(a) + score(b) - score(p)), lambda s: np.array([s[1] / (s[0] + l2)]), min_leaf=self.min_samples_leaf, min_gain=1e-12, oblivious=self.grow_policy == "symmetric", seed=self.seed, first_tree=it)[0]

            def cells(**c):
                node = walk(t, c["x"])
                m = len(t["feature"]) * n_seg
                at = node * n_seg + c["seg"]
                return {"n": np.bincount(at, c["w"], m), "s": np.bincount(at, c["w"] * (c["y"] - f_of(c)), m)}

            got = total(rows, cells)
            n, sm = got["n"].reshape(-1, n_seg), got["s"].reshape(-1, n_seg)
            before = lambda a: np.cumsum(a, 1) - a
            held.append([t])
            pending.append((t, before(sm) / (before(n) + l2 + 1e-12)))
            if len(pending) >= int(self.renew):
                own = list(pending)
                add = F.arrow_udf(_ordered_step(own, lr), "double")(F.col("x"), F.col("seg"))
                rows, pending = checkpoint(rows.withColumn("f", F.col("f") + add)), []
        _ = moved
        self.state |= {"trees": held, "start": [float(start)], "classes": [], "outputs": 1}
        return self


def _ordered_step(own, lr):
    from millrace.learn.base import matrix

    def run(x: pa.Array, seg: pa.Array) -> pa.Array:
        z, s = matrix(x), seg.to_numpy(zero_copy_only=False)
        return pa.array(lr * sum((tab[walk(t, z), s] for t, tab in own), np.zeros(len(s))), pa.float64())

    return run


class AdaBoostClassifier(_Forest, Classifier):
    """SAMME over shallow trees; a row's weight is the product of its past misses, found by walking the past trees."""

    defaults = {**_TREE, "n_estimators": 20, "learning_rate": 1.0, "max_depth": 1}

    def fit(self, df, features, label, weight=None, key=None):
        self._seen(features)
        classes = classes_of(df, label)
        k = len(classes)
        rows = rows_of(df, features, coded(label, classes), weight).persist()
        try:
            borders = quantile_borders(rows, "x", int(self.n_bins))
            trees, alphas = [], []

            def boosted(c):
                w = c["w"] if "w" in c else np.ones(len(c["x"]))
                lw = np.zeros(len(w))
                for t, a in zip(trees, alphas):
                    lw += a * (np.array(t["value"])[walk(t, c["x"])].argmax(1) != c["y"])
                return w * np.exp(np.minimum(lw, 600))

            for it in range(int(self.n_estimators)):
                def stats(c, tree):
                    w = boosted(c)
                    out = np.zeros((len(w), k + 1))
                    out[:, 0] = w
                    out[np.arange(len(w)), 1 + c["y"].astype(int)] = w
                    return out

                stats.width = k + 1
                t = grow(rows, borders, 1, int(self.max_depth), stats, _gini, lambda s: s[1:] / max(s[0], 1e-300), min_leaf=1e-300, seed=self.seed, first_tree=it)[0]

                def miss(**c):
                    w = boosted(c)
                    return {"w": np.array(w.sum()), "e": np.array((w * (np.array(t["value"])[walk(t, c["x"])].argmax(1) != c["y"])).sum())}

                s = total(rows, miss)
                err = float(s["e"] / s["w"])
                if err <= 1e-12:
                    trees.append(t)
                    alphas.append(1.0)
                    break
                if err >= 1 - 1 / k:
                    break
                trees.append(t)
                alphas.append(float(self.learning_rate * (math.log((1 - err) / err) + math.log(k - 1))))
        finally:
            rows.unpersist()
        self.state |= {"classes": classes, "trees": trees, "weights": alphas}
        return self

    def _votes(self):
        trees, alphas, k = self.trees_, self.weights_, len(self.classes_)

        def fn(x):
            out = np.zeros((len(x), k))
            for t, a in zip(trees, alphas):
                out[np.arange(len(x)), np.array(t["value"])[walk(t, x)].argmax(1)] += a
            return out

        return fn

    def predict_column(self, features) -> Column:
        fn = self._votes()
        return named_class(mapped(lambda x: fn(x).argmax(1), features, "int"), self.classes_)


class AdaBoostRegressor(_Forest, Regressor):
    """AdaBoost.R2: weights fall with the loss relative to the largest; the prediction is the weighted median."""

    defaults = {**_TREE, "n_estimators": 20, "learning_rate": 1.0, "max_depth": 3, "loss": "linear"}

    def fit(self, df, features, label, weight=None, key=None):
        self._seen(features)
        rows = rows_of(df, features, label, weight).persist()
        try:
            borders = quantile_borders(rows, "x", int(self.n_bins))
            trees, betas, tops = [], [], []

            def losses(t, top, c):
                r = np.minimum(np.abs(np.array(t["value"])[walk(t, c["x"]), 0] - c["y"]) / top, 1)
                return {"linear": r, "square": r * r, "exponential": 1 - np.exp(-r)}[self.loss]

            def boosted(c):
                w = c["w"] if "w" in c else np.ones(len(c["x"]))
                for t, b, top in zip(trees, betas, tops):
                    w = w * b ** ((1 - losses(t, top, c)) * self.learning_rate)
                return w

            for it in range(int(self.n_estimators)):
                def stats(c, tree):
                    w = boosted(c)
                    return np.column_stack([w, w * c["y"]])

                stats.width = 2
                t = grow(rows, borders, 1, int(self.max_depth), stats, _variance, lambda s: np.array([s[1] / max(s[0], 1e-300)]), min_leaf=1e-300, seed=self.seed, first_tree=it)[0]
                far = mapped(lambda x: np.array(t["value"])[walk(t, x), 0], "x")
                top = rows.select(F.abs(far - F.col("y")).alias("r")).agg(F.max("r")).first()[0]
                if top <= 1e-12:
                    trees, betas, tops = [*trees, t], [*betas, 1e-10], [*tops, 1.0]
                    break
                s = total(rows, lambda **c: {"w": np.array((w := boosted(c)).sum()), "e": np.array((w * losses(t, top, c)).sum())})
                err = float(s["e"] / s["w"])
                if err >= 0.5:
                    if not trees:
                        trees, betas, tops = [t], [0.999], [top]
                    break
                trees, betas, tops = [*trees, t], [*betas, max(err / (1 - err), 1e-10)], [*tops, top]
        finally:
            rows.unpersist()
        self.state |= {"trees": trees, "weights": [self.learning_rate * math.log(1 / b) for b in betas]}
        return self

    def predict_column(self, features) -> Column:
        trees, w = self.trees_, np.array(self.weights_)

        def fn(x):
            p = np.column_stack([np.array(t["value"])[walk(t, x), 0] for t in trees])
            order = np.argsort(p, axis=1, kind="stable")
            c = np.cumsum(w[order], axis=1)
            return np.take_along_axis(p, np.take_along_axis(order, (c >= 0.5 * c[:, -1:]).argmax(1)[:, None], 1), 1)[:, 0]

        return mapped(fn, features)


class DARTRegressor(GradientBoosting):
    """Boosting where each step leaves a random part of the trees out and shares their weight with the new one."""

    defaults = {**GradientBoosting.defaults, "n_estimators": 20, "rate_drop": 0.1, "skip_drop": 0.5, "max_depth": 3, "grow_policy": "depthwise"}

    def fit(self, df, features, label: str, weight=None, key=None):
        self.state["features"] = features if isinstance(features, str) else list(features)
        classes = classes_of(df, label) if self.loss == "logloss" else []
        rows = rows_of(df, features, coded(label, classes) if classes else label, weight).persist()
        try:
            borders = quantile_borders(rows, "x", int(self.n_bins))
            start = self._start(rows.withColumn("w", F.col("w") if weight else F.lit(1.0)), self.loss, 1)
            grad, l2, lr = boosting_loss(self.loss, self.param, 1), float(self.l2_leaf_reg), float(self.learning_rate)
            trees, scale = [], []
            rng = np.random.default_rng(self.seed)
            score = lambda s: s[..., 1] ** 2 / (s[..., 2] + l2 + 1e-12)
            for it in range(int(self.n_estimators)):
                out = set() if rng.uniform() < self.skip_drop else set(np.nonzero(rng.uniform(size=len(trees)) < self.rate_drop)[0].tolist())
                kept = [k for k in range(len(trees)) if k not in out]
                fn = forest_sum([trees[k] for k in kept], [scale[k] for k in kept])

                def stats(c, tree):
                    g, h = grad(c["y"], start[0] + fn(c["x"]))
                    w = c["w"] if "w" in c else np.ones(len(g))
                    return np.column_stack([w, w * g, w * h])

                stats.width = 3
                trees += grow(rows, borders, 1, int(self.max_depth), stats, lambda a, b, t: 0.5 * (score(a) + score(b) - score(t)), lambda s: np.array([-s[1] / (s[2] + l2 + 1e-12)]), min_leaf=self.min_samples_leaf, min_gain=1e-12, oblivious=self.grow_policy == "symmetric", seed=self.seed, first_tree=it)
                n = len(out)
                for k in out:
                    scale[k] *= n / (n + lr)
                scale.append(lr / (n + lr) if n else lr)
        finally:
            rows.unpersist()
        self.state |= {"trees": [[t] for t in trees], "scale": scale, "start": [float(v) for v in start], "classes": classes, "outputs": 1}
        return self

    def _raw_fn(self, held=None, start=None):
        fn, s = forest_sum([t[0] for t in self.trees_], self.scale_), self.start_[0]
        return lambda x: s + fn(x)


class DARTClassifier(DARTRegressor):
    defaults = {**DARTRegressor.defaults, "loss": "logloss"}


# --- categories and borders ------------------------------------------------------------------------------------------


def ordered_statistics(df: DataFrame, category: str, target: str, key: str, prior: float = 0.5, weight: float = 1.0, seed: int = 0, blocks: int = 64, out: str = "ctr") -> DataFrame:
    """(sum of the target over earlier rows of the category + prior * weight) / (their number + weight).

    "Earlier" is by a hash of the key. Rows are ranked within (category, block of the order) only, and a small table
    of block sums carries what came before, so a category with a third of all rows is spread over `blocks` tasks.
    """
    y = F.col(target).cast("double")
    x = df.withColumn("_mr_h", keyed(seed, F.col(key))).withColumn("_mr_b", F.shiftrightunsigned(F.col("_mr_h").bitwiseXOR(F.lit(-(2**63))), 64 - int(math.log2(blocks))).cast("int"))
    sums = x.groupBy(F.col(category).alias("_mr_c"), F.col("_mr_b").alias("_mr_d")).agg(F.sum(y).alias("_mr_s"), F.count(y).alias("_mr_n"))
    before = Window.partitionBy("_mr_c").orderBy("_mr_d").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_mr_c", "_mr_d", F.coalesce(F.sum("_mr_s").over(before), F.lit(0.0)).alias("_mr_s"), F.coalesce(F.sum("_mr_n").over(before), F.lit(0)).alias("_mr_n"))
    inside = Window.partitionBy(category, "_mr_b").orderBy("_mr_h", key).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_mr_u", F.coalesce(F.sum(y).over(inside), F.lit(0.0))).withColumn("_mr_v", F.coalesce(F.count(y).over(inside), F.lit(0)))
    x = x.join(sums, F.col(category).eqNullSafe(F.col("_mr_c")) & (F.col("_mr_b") == F.col("_mr_d")))
    return x.withColumn(out, (F.col("_mr_u") + F.col("_mr_s") + F.lit(prior * weight)) / (F.col("_mr_v") + F.col("_mr_n") + F.lit(weight))).drop(*[f"_mr_{c}" for c in "hbcdsnuv"])


BORDER_TYPES = ("Uniform", "Median", "UniformAndQuantiles", "GreedyLogSum", "MaxLogSum", "MinEntropy")


def borders(df: DataFrame, column: str, count: int, kind: str = "GreedyLogSum", grid: int = 10_000) -> list[float]:
    """Up to `count` borders of a column by one of six rules.

    The rules see the distinct values with their counts; beyond `grid` distinct values, those of as many exact
    quantiles, weighted alike.
    """
    x = F.col(column).cast("double")
    held = df.select(x.alias("v")).where("v is not null and not isnan(v)").groupBy("v").count().limit(grid + 1).toPandas().sort_values("v")
    if len(held) > grid:
        v, n = np.unique(np.array(df.agg(F.percentile(x, [k / (grid - 1) for k in range(grid)])).first()[0]), return_counts=True)
    else:
        v, n = held["v"].to_numpy(), held["count"].to_numpy()
    if len(v) < 2:
        return []
    mid = (v[1:] + v[:-1]) / 2
    if kind == "Uniform":
        return sorted(set(np.linspace(v[0], v[-1], count + 2)[1:-1].tolist()))
    c = np.cumsum(n)

    def median(k):
        at = np.searchsorted(c, c[-1] * np.arange(1, k + 1) / (k + 1))
        return sorted({float(mid[min(i, len(mid) - 1)]) for i in at})

    if kind == "Median":
        return median(count)
    if kind == "UniformAndQuantiles":
        half = count // 2
        return sorted({*median(count - half), *np.linspace(v[0], v[-1], half + 2)[1:-1].tolist()})
    pay = (lambda w: np.log(w + 1e-8)) if kind in ("GreedyLogSum", "MaxLogSum") else (lambda w: -w * np.log(np.maximum(w, 1e-8)))
    if kind == "GreedyLogSum":
        parts, cuts = [(0, len(v))], []
        while len(cuts) < count:
            best = (1e-12, None)
            for a, b in parts:
                if b - a > 1:
                    left = c[a : b - 1] - (c[a - 1] if a else 0)
                    all_ = c[b - 1] - (c[a - 1] if a else 0)
                    g = pay(left.astype(float)) + pay((all_ - left).astype(float)) - pay(float(all_))
                    k = int(g.argmax())
                    if g[k] > best[0]:
                        best = (float(g[k]), (a, a + k + 1, b))
            if best[1] is None:
                break
            a, m, b = best[1]
            parts.remove((a, b))
            parts += [(a, m), (m, b)]
            cuts.append(float(mid[m - 1]))
        return sorted(cuts)
    # dynamic programming over the values, exact
    m = len(v)
    k = min(count + 1, m)
    head = np.append(0, c).astype(float)
    best = pay(head[1:])
    back = np.zeros((k, m), int)
    for part in range(1, k):
        new = np.full(m, -np.inf)
        for i in range(part, m):
            z = best[part - 1 : i] + pay(head[i + 1] - head[part : i + 1])
            j = int(z.argmax())
            new[i], back[part, i] = z[j], part - 1 + j
        best = new
    cuts, i = [], m - 1
    for part in range(k - 1, 0, -1):
        i = back[part, i]
        cuts.append(float(mid[i]))
    return sorted(cuts)


# --- explanations ----------------------------------------------------------------------------------------------------


class TreeExplainer:
    """Exact Shapley values of a fitted tree model, by the path of each tree and the rows' weights in its nodes."""

    def __init__(self, model, output: int = 0):
        self.model, self.output = model, output
        if isinstance(model, GradientBoosting):
            scale = model.state.get("scale") or [model.learning_rate] * len(model.trees_)
            self.parts = [(t[min(output, len(t) - 1)], s, 0) for t, s in zip(model.trees_, scale)]
            self.base = model.start_[min(output, len(model.start_) - 1)]
        else:
            self.parts, self.base = [(t, 1 / len(model.trees_), output) for t in model.trees_], 0.0
        self.expected_value = self.base + sum(s * _expected(t, o) for t, s, o in self.parts)

    def values_column(self, features) -> Column:
        parts = self.parts

        def fn(x):
            out = np.zeros_like(x)
            for t, s, o in parts:
                for i in range(len(x)):
                    _tree_shap(t, x[i], out[i], s, o)
            return out

        return mapped(fn, features, "array<double>")


def _expected(t, o, node=0):
    if t["feature"][node] < 0:
        return t["value"][node][o]
    a, b = t["left"][node], t["right"][node]
    w = t["weight"]
    return (w[a] * _expected(t, o, a) + w[b] * _expected(t, o, b)) / max(w[a] + w[b], 1e-300)


def _tree_shap(t, x, phi, scale, o):
    """Adds one tree's Shapley values, by enumerating for each leaf the features on its path.

    A leaf pays its value to coalitions: features that let the row through when known, and their node shares when not.
    Weights of coalition sizes come from a polynomial in the number of known features, so a leaf costs the square of
    its path's distinct features.
    """
    todo = [(0, {})]
    while todo:
        node, path = todo.pop()
        f = t["feature"][node]
        if f < 0:
            v = t["value"][node][o] * scale
            names = list(path)
            m = len(names)
            if not m or v == 0:
                continue
            ones = np.array([path[k][0] for k in names])
            zeros = np.array([path[k][1] for k in names])
            for i in range(m):
                poly = np.array([1.0])
                for j in range(m):
                    if j != i:
                        poly = np.append(poly * zeros[j], 0) + np.append(0, poly * ones[j])
                w = sum(poly[s] * math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m))
                phi[names[i]] += v * w * (ones[i] - zeros[i])
            continue
        a, b = t["left"][node], t["right"][node]
        w = t["weight"]
        go = a if x[f] <= t["cut"][node] else b
        for k in (a, b):
            share = w[k] / max(w[a] + w[b], 1e-300)
            one, zero = path.get(f, (1.0, 1.0))
            todo.append((k, {**path, f: (one * (k == go), zero * share)}))


class KernelExplainer:
    """Shapley values by weighted least squares over coalitions: all of them up to `features` 10, keyed draws beyond.
    Left-out features take the values of each background row in turn (a checked, small number)."""

    def __init__(self, predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray, draws: int = 2048, seed: int = 0):
        self.predict, self.background, self.draws, self.seed = predict, np.asarray(background, float), draws, seed
        if len(self.background) > 1000:
            raise ValueError("the background has more than 1,000 rows")
        self.expected_value = float(self.predict(self.background).mean())

    def _coalitions(self, d):
        if d <= 10:
            z = np.array([[m >> k & 1 for k in range(d)] for m in range(1, 2**d - 1)], bool).reshape(-1, d)
        else:
            rng = np.random.default_rng(self.seed)
            size = np.arange(1, d)
            p = (d - 1) / (size * (d - size))
            z = np.zeros((self.draws, d), bool)
            for r, n in enumerate(rng.choice(size, self.draws, p=p / p.sum())):
                z[r, rng.choice(d, n, replace=False)] = True
            return z, np.ones(len(z))
        n = z.sum(1)
        return z, np.array([(d - 1) / (math.comb(d, int(k)) * k * (d - k)) for k in n])

    def explain(self, x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        z, w = self._coalitions(d)
        out = np.zeros_like(x)
        for i, row in enumerate(x):
            full = float(self.predict(row[None])[0])
            if d == 1:
                out[i, 0] = full - self.expected_value
                continue
            mixed = np.where(z[:, None, :], row, self.background[None]).reshape(-1, d)
            v = self.predict(mixed).reshape(len(z), -1).mean(1) - self.expected_value
            gap = full - self.expected_value
            a = z[:, :-1].astype(float) - z[:, -1:]
            b = v - z[:, -1] * gap
            s = np.linalg.lstsq((a * w[:, None]).T @ a, (a * w[:, None]).T @ b, rcond=None)[0]
            out[i] = np.append(s, gap - s.sum())
        return out

    def values_column(self, features) -> Column:
        return mapped(self.explain, features, "array<double>")


class PermutationExplainer(KernelExplainer):
    """Shapley values by adding features in keyed orders, forwards and backwards."""

    def __init__(self, predict, background, orders: int = 8, seed: int = 0):
        super().__init__(predict, background, seed=seed)
        self.orders = orders

    def explain(self, x):
        d, rng = x.shape[1], np.random.default_rng(self.seed)
        orders = [rng.permutation(d) for _ in range(self.orders)]
        out = np.zeros_like(x)
        for i, row in enumerate(x):
            for order in orders:
                for o in (order, order[::-1]):
                    known = np.zeros((d + 1, d), bool)
                    for k, f in enumerate(o):
                        known[k + 1 :, f] = True
                    v = self.predict(np.where(known[:, None, :], row, self.background[None]).reshape(-1, d)).reshape(d + 1, -1).mean(1)
                    out[i, o] += np.diff(v)
        return out / (2 * len(orders))
