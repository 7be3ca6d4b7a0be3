"""Dense networks by gradient sums, optimizer steps, learning-rate schedules, graph convolutions and embeddings.

A step is one pass over a keyed share of the rows whose gradients add up on the executors; the optimizer moves the
weights on the driver. Recurrent, attention and state-space training are not offered: their names raise.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.tensor import activation
from millrace.learn.base import Classifier, Regressor, classes_of, coded, keyed, mapped, named_class, rows_of, total

#: Training that this engine refuses by name.
REFUSED = ("Sequential", "Session", "LSTMRegressor", "LSTMClassifier", "GRURegressor", "GRUClassifier", "RNNRegressor", "RNNClassifier", "MoEBlock", "CNNClassifier", "TransformerBlock", "Mamba2Block", "SambaStack", "LanguageModelTrainer", "PooledByteLanguageModelTrainer", "OffloadedByteLanguageModelTrainer", "Worker")


def __getattr__(name: str):
    if name in REFUSED:
        raise NotImplementedError(f"{name}: training of this kind is not offered on Spark")
    raise AttributeError(name)


# --- optimizers ------------------------------------------------------------------------------------------------------


class Optimizer:
    """step(parameters, gradients) changes arrays in place; with maximize the gradients' signs are flipped."""

    def __init__(self, lr: float = 1e-3, weight_decay: float = 0.0, maximize: bool = False, **k):
        self.lr, self.weight_decay, self.maximize, self.t = lr, weight_decay, maximize, 0
        self.k, self.held = k, {}

    def _memory(self, i, p, *names):
        return [self.held.setdefault((i, n), np.zeros_like(p, dtype=float)) for n in names]

    def step(self, params: list[np.ndarray], grads: list[np.ndarray], lr: float | None = None) -> None:
        self.t += 1
        for i, (p, g) in enumerate(zip(params, grads)):
            g = -g if self.maximize else g.copy()
            self.move(i, p, g, self.lr if lr is None else lr)

    def move(self, i, p, g, lr):
        raise NotImplementedError


class SGD(Optimizer):
    """Momentum (dampened, perhaps Nesterov's) on gradients plus weight decay."""

    def move(self, i, p, g, lr):
        g = g + self.weight_decay * p
        m = self.k.get("momentum", 0.0)
        if m:
            v, = self._memory(i, p, "v")
            v[...] = g if self.t == 1 else m * v + (1 - self.k.get("dampening", 0.0)) * g
            g = g + m * v if self.k.get("nesterov") else v
        p -= lr * g


class Adam(Optimizer):
    decoupled = False

    def move(self, i, p, g, lr):
        (b1, b2), eps = self.k.get("betas", (0.9, 0.999)), self.k.get("eps", 1e-8)
        if self.decoupled:
            p *= 1 - lr * self.weight_decay
        else:
            g = g + self.weight_decay * p
        m, v = self._memory(i, p, "m", "v")
        m += (1 - b1) * (g - m)
        v += (1 - b2) * (g * g - v)
        p -= self.update(i, p, g, m, v, b1, b2, eps, lr)

    def update(self, i, p, g, m, v, b1, b2, eps, lr):
        return lr * (m / (1 - b1**self.t)) / (np.sqrt(v / (1 - b2**self.t)) + eps)


class AdamW(Adam):
    decoupled = True


class NAdam(Adam):
    def update(self, i, p, g, m, v, b1, b2, eps, lr):
        decay = self.k.get("momentum_decay", 4e-3)
        mu = lambda t: b1 * (1 - 0.5 * 0.96 ** (t * decay))
        prod = self.held.get((i, "prod"), 1.0) * mu(self.t)
        self.held[i, "prod"] = prod
        hat = mu(self.t + 1) * m / (1 - prod * mu(self.t + 1)) + (1 - mu(self.t)) * g / (1 - prod)
        return lr * hat / (np.sqrt(v / (1 - b2**self.t)) + eps)


class LAMB(Adam):
    decoupled = False

    def move(self, i, p, g, lr):
        (b1, b2), eps = self.k.get("betas", (0.9, 0.999)), self.k.get("eps", 1e-6)
        m, v = self._memory(i, p, "m", "v")
        m += (1 - b1) * (g - m)
        v += (1 - b2) * (g * g - v)
        u = (m / (1 - b1**self.t)) / (np.sqrt(v / (1 - b2**self.t)) + eps) + self.weight_decay * p
        a, b = np.linalg.norm(p), np.linalg.norm(u)
        p -= lr * (a / b if a > 0 and b > 0 else 1.0) * u


class RMSprop(Optimizer):
    def move(self, i, p, g, lr):
        g = g + self.weight_decay * p
        a = self.k.get("alpha", 0.99)
        v, = self._memory(i, p, "v")
        v += (1 - a) * (g * g - v)
        den = v
        if self.k.get("centered"):
            mean, = self._memory(i, p, "mean")
            mean += (1 - a) * (g - mean)
            den = v - mean * mean
        u = g / (np.sqrt(den) + self.k.get("eps", 1e-8))
        if self.k.get("momentum"):
            b, = self._memory(i, p, "b")
            b[...] = self.k["momentum"] * b + u
            u = b
        p -= lr * u


class Adagrad(Optimizer):
    def move(self, i, p, g, lr):
        g = g + self.weight_decay * p
        s, = self._memory(i, p, "s")
        s += g * g
        p -= lr / (1 + (self.t - 1) * self.k.get("lr_decay", 0.0)) * g / (np.sqrt(s) + self.k.get("eps", 1e-10))


class Adamax(Optimizer):
    def move(self, i, p, g, lr):
        g = g + self.weight_decay * p
        b1, b2 = self.k.get("betas", (0.9, 0.999))
        m, u = self._memory(i, p, "m", "u")
        m += (1 - b1) * (g - m)
        u[...] = np.maximum(b2 * u, np.abs(g) + self.k.get("eps", 1e-8))
        p -= lr / (1 - b1**self.t) * m / u


class Lion(Optimizer):
    def move(self, i, p, g, lr):
        b1, b2 = self.k.get("betas", (0.9, 0.99))
        p *= 1 - lr * self.weight_decay
        m, = self._memory(i, p, "m")
        p -= lr * np.sign(b1 * m + (1 - b1) * g)
        m += (1 - b2) * (g - m)


class Adafactor(Optimizer):
    """Second moments of matrices as row and column means."""

    def move(self, i, p, g, lr):
        eps1, eps2 = self.k.get("eps", (1e-30, 1e-3))
        b = 1 - self.t ** self.k.get("decay_rate", -0.8)
        sq = g * g + eps1
        if p.ndim == 2:
            r = self.held.setdefault((i, "r"), np.zeros(p.shape[0]))
            c = self.held.setdefault((i, "c"), np.zeros(p.shape[1]))
            r += (1 - b) * (sq.mean(1) - r)
            c += (1 - b) * (sq.mean(0) - c)
            v = np.outer(r, c) / max(r.mean(), eps1)
        else:
            v, = self._memory(i, p, "v")
            v += (1 - b) * (sq - v)
        u = g / np.sqrt(np.maximum(v, eps1))
        u /= max(1.0, math.sqrt(float((u * u).mean())) / self.k.get("clip_threshold", 1.0))
        p *= 1 - lr * self.weight_decay
        p -= lr * max(eps2, math.sqrt(float((p * p).mean()))) * u


def clip_grad_norm(grads: list[np.ndarray], top: float) -> float:
    """Scales gradients to a joint length of at most `top`; the length before."""
    size = math.sqrt(sum(float((g * g).sum()) for g in grads))
    if size > top:
        for g in grads:
            g *= top / (size + 1e-6)
    return size


OPTIMIZERS = {"sgd": SGD, "adam": Adam, "adamw": AdamW, "rmsprop": RMSprop, "adagrad": Adagrad, "adamax": Adamax, "nadam": NAdam, "lion": Lion, "lamb": LAMB, "adafactor": Adafactor}


# --- schedules: closed forms of the one-based step -----------------------------------------------------------------------


def _checked(step: Column, steps: int | None) -> Column:
    ok = (step >= 1) & (step <= steps) if steps else step >= 1
    return F.when(ok, step).otherwise(F.raise_error(F.lit("the step is outside the schedule")).cast("long"))


def constant_lr(step: Column, lr: float) -> Column:
    return F.when(_checked(step, None).isNotNull(), F.lit(float(lr)))


def warmup_linear_lr(step: Column, lr: float, warmup: int, steps: int) -> Column:
    s = _checked(step, steps)
    return F.when(s <= warmup, lr * s / max(warmup, 1)).otherwise(lr * (steps - s) / max(steps - warmup, 1))


def warmup_cosine_lr(step: Column, lr: float, warmup: int, steps: int, low: float = 0.0) -> Column:
    s = _checked(step, steps)
    return F.when(s <= warmup, lr * s / max(warmup, 1)).otherwise(low + (lr - low) * 0.5 * (1 + F.cos(math.pi * (s - warmup) / max(steps - warmup, 1))))


def step_lr(step: Column, lr: float, size: int, gamma: float = 0.1) -> Column:
    return lr * F.pow(F.lit(gamma), F.floor((_checked(step, None) - 1) / size))


def exponential_lr(step: Column, lr: float, gamma: float) -> Column:
    return lr * F.pow(F.lit(gamma), _checked(step, None) - 1)


def one_cycle_lr(step: Column, top: float, steps: int, warm: float = 0.3, div: float = 25.0, final_div: float = 1e4) -> Column:
    """From top / div up to top over the first share of the steps, then down to top / div / final_div, both as cosines."""
    s = _checked(step, steps) - 1
    up, low = warm * steps - 1, top / div
    curve = lambda a, b, t: b + (a - b) / 2 * (1 + F.cos(math.pi * t))
    return F.when(s <= up, curve(low, top, s / max(up, 1))).otherwise(curve(top, low / final_div, (s - up) / max(steps - 1 - up, 1)))


# --- dense networks --------------------------------------------------------------------------------------------------------


class _Mlp:
    defaults = {"hidden_layer_sizes": (32,), "activation": "relu", "solver": "adam", "alpha": 1e-4, "learning_rate": 1e-2, "max_iter": 30, "batches": 4, "tol": 1e-6, "seed": 0}

    def _forward(self, layers, x):
        act = activation(self.activation)[0]
        outs = [x]
        for k, (w, b) in enumerate(layers):
            z = outs[-1] @ w + b
            outs.append(act(z) if k < len(layers) - 1 else z)
        return outs

    def _train(self, rows: DataFrame, out: int, loss):
        """loss(z, y) gives (summed loss, gradient of z)."""
        rows = rows.persist()
        try:
            scale = total(rows.select("x"), lambda x: {"n": np.array(float(len(x))), "s": x.sum(0), "q": (x * x).sum(0)})
            n, mean = float(scale["n"]), scale["s"] / scale["n"]
            std = np.sqrt(np.maximum(scale["q"] / n - mean**2, 0))
            std[std == 0] = 1.0
            rng = np.random.default_rng(self.seed)
            sizes = [len(mean), *self.hidden_layer_sizes, out]
            layers = [[rng.normal(size=(a, b)) * math.sqrt(2 / (a + b)), np.zeros(b)] for a, b in zip(sizes, sizes[1:])]
            opt = OPTIMIZERS[self.solver](lr=self.learning_rate)
            back, nb, losses = activation(self.activation)[1], int(self.batches), []
            for epoch in range(int(self.max_iter)):
                cost = 0.0
                for part in range(nb):
                    own = rows if nb == 1 else rows.where(F.pmod(keyed(self.seed + epoch, F.col("x")), F.lit(nb)) == part)

                    def fn(x, y, w=None, layers=layers):
                        z = (x - mean) / std
                        outs = self._forward(layers, z)
                        c, g = loss(outs[-1], y)
                        res = {"c": np.array(float(c)), "n": np.array(float(len(x)))}
                        for k in range(len(layers) - 1, -1, -1):
                            res[f"w{k}"], res[f"b{k}"] = outs[k].T @ g, g.sum(0)
                            if k:
                                g = back(outs[k], g @ layers[k][0].T)
                        return res

                    s = total(own, fn)
                    if not s:
                        continue
                    m = float(s["n"])
                    grads = [v for k in range(len(layers)) for v in (s[f"w{k}"] / m + self.alpha * layers[k][0] / n, s[f"b{k}"] / m)]
                    opt.step([v for layer in layers for v in layer], grads)
                    cost += float(s["c"])
                losses.append(cost / n)
                if len(losses) > 5 and abs(losses[-2] - losses[-1]) < self.tol:
                    break
        finally:
            rows.unpersist()
        self.state |= {f"w{k}": w for k, (w, _) in enumerate(layers)} | {f"b{k}": b for k, (_, b) in enumerate(layers)}
        self.state |= {"depth": len(layers), "mean": mean, "std": std, "loss_curve": losses}

    def _net(self):
        layers = [(np.asarray(self.state[f"w{k}"]), np.asarray(self.state[f"b{k}"])) for k in range(self.depth_)]
        mean, std = np.asarray(self.mean_), np.asarray(self.std_)
        return lambda x: self._forward(layers, (x - mean) / std)[-1]


class MLPClassifier(_Mlp, Classifier):
    """A dense network with softmax cross entropy."""

    def fit(self, df: DataFrame, features, label: str):
        self._seen(features)
        classes = classes_of(df, label)

        def loss(z, y):
            z = z - z.max(1, keepdims=True)
            p = np.exp(z)
            s = p.sum(1, keepdims=True)
            at = (np.arange(len(y)), y.astype(int))
            c = (np.log(s[:, 0]) - z[at]).sum()
            p /= s
            p[at] -= 1
            return c, p

        self._train(rows_of(df, features, coded(label, classes)), len(classes), loss)
        self.state["classes"] = classes
        return self

    def proba_column(self, features) -> Column:
        net = self._net()

        def fn(x):
            z = net(x)
            z = np.exp(z - z.max(1, keepdims=True))
            return z / z.sum(1, keepdims=True)

        return mapped(fn, features, "array<double>")

    def predict_column(self, features) -> Column:
        net = self._net()
        return named_class(mapped(lambda x: net(x).argmax(1), features, "int"), self.classes_)


class MLPRegressor(_Mlp, Regressor):
    """A dense network with squared error; the target is scaled while training."""

    def fit(self, df: DataFrame, features, label: str):
        self._seen(features)
        r = df.agg(F.avg(F.col(label).cast("double")).alias("m"), F.stddev_pop(F.col(label).cast("double")).alias("s")).first()
        m, s = r["m"], r["s"] or 1.0

        def loss(z, y):
            d = z[:, 0] - (y - m) / s
            return 0.5 * (d * d).sum(), d[:, None]

        self._train(rows_of(df, features, label), 1, loss)
        self.state |= {"shift": m, "scale": s}
        return self

    def predict_column(self, features) -> Column:
        net, m, s = self._net(), self.shift_, self.scale_
        return mapped(lambda x: net(x)[:, 0] * s + m, features)


class SmallMLPTrainer(MLPClassifier):
    """A fixed 8-16-3 network with ReLU and AdamW."""

    defaults = {**_Mlp.defaults, "hidden_layer_sizes": (16,), "solver": "adamw"}

    def fit(self, df, features, label):
        super().fit(df, features, label)
        if (len(self.mean_), len(self.classes_)) != (8, 3):
            raise ValueError("this network takes 8 features and 3 classes")
        return self


MLPClassifier.defaults = dict(_Mlp.defaults)
MLPRegressor.defaults = dict(_Mlp.defaults)


# --- graphs and lookups -----------------------------------------------------------------------------------------------------


def gcn_conv(nodes: DataFrame, edges: DataFrame, weights: np.ndarray | None = None, bias: np.ndarray | None = None) -> DataFrame:
    """(id, x): sums over neighbours and the node itself, each by 1 / sqrt of both degrees, times the weights."""
    e = edges.select("src", "dst", (F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)).alias("w")).unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w")))
    deg = e.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("d"))
    e = e.join(deg.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    got = e.join(nodes.select(F.col("id").alias("src"), "x"), "src").select("dst", F.posexplode("x").alias("k", "v"), (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("a"))
    return _rebuilt(got.groupBy("dst", "k").agg(F.sum(F.col("a") * F.col("v")).alias("v")), weights, bias)


def _rebuilt(long: DataFrame, weights, bias) -> DataFrame:
    out = long.groupBy(F.col("dst").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda r: r["v"]).alias("x"))
    if weights is not None:
        w, b = np.asarray(weights, float), 0.0 if bias is None else np.asarray(bias, float)
        out = out.withColumn("x", mapped(lambda x: x @ w + b, "x", "array<double>"))
    return out


def sage_conv(nodes: DataFrame, edges: DataFrame, own: np.ndarray | None = None, near: np.ndarray | None = None, aggregate: str = "mean") -> DataFrame:
    """(id, x): the node's vector times `own` plus the mean or maximum of its in-neighbours' times `near`."""
    f = {"mean": F.avg, "max": F.max}[aggregate]
    got = edges.select("src", "dst").distinct().join(nodes.select(F.col("id").alias("src"), "x"), "src").select("dst", F.posexplode("x").alias("k", "v")).groupBy("dst", "k").agg(f("v").alias("v"))
    agg = _rebuilt(got, None, None).withColumnRenamed("x", "near")
    both = nodes.join(agg, "id", "left").withColumn("near", F.coalesce("near", F.transform("x", lambda v: F.lit(0.0))))
    if own is None and near is None:
        return both.select("id", F.concat("x", "near").alias("x"))
    d = len(own)
    w = np.concatenate([np.asarray(own, float), np.asarray(near, float)])
    _ = d
    return both.select("id", mapped(lambda x: x @ w, "both", "array<double>").alias("x")) if "both" in both.columns else both.withColumn("both", F.concat("x", "near")).select("id", mapped(lambda x: x @ w, "both", "array<double>").alias("x"))


def embedding(rows: DataFrame, position: str, table: DataFrame, key: str = "id", vector: str = "x", out: str = "embedded") -> DataFrame:
    """rows with the vector of their id; a join, so the table may be of any size. Unknown ids get null."""
    t = table.select(F.col(key).alias("_mr_k"), F.col(vector).alias(out))
    return rows.join(t, F.col(position) == F.col("_mr_k"), "left").drop("_mr_k")


def embedding_gradient(rows: DataFrame, position: str, gradient: str) -> DataFrame:
    """(id, x): sums of the gradients of equal ids."""
    long = rows.select(F.col(position).alias("dst"), F.posexplode(gradient).alias("k", "v")).groupBy("dst", "k").agg(F.sum("v").alias("v"))
    return _rebuilt(long, None, None)


def layer_norm_column(features: str, scale=None, bias=None, eps: float = 1e-5) -> Column:
    """Each row's vector less its mean over its deviation. By Arrow batches: as nested array functions Spark would work
    the mean and the deviation out anew for every element."""
    w, b = 1.0 if scale is None else np.asarray(scale, float), 0.0 if bias is None else np.asarray(bias, float)
    return mapped(lambda x: (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + eps) * w + b, features, "array<double>")


def rms_norm_column(features: str, eps: float = 1e-5) -> Column:
    return mapped(lambda x: x / np.sqrt((x * x).mean(1, keepdims=True) + eps), features, "array<double>")


def cross_entropy_column(logits: str, target: str) -> Column:
    """log sum exp of the logits less the target's own."""
    z = F.col(logits).cast("array<double>")
    top = F.array_max(z)
    return top + F.ln(F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top))) - F.element_at(z, F.col(target).cast("int") + 1)


_ = SparkSession
