"""Splits, cross-validation, searches, resampling and models made of models.

Orders and draws are hashes of a key column, so they hold for any partitioning. A split is a column: the fold in which
the row is tested, or for repeated and shuffled splits one row per split that tests it. Exact shares and contiguous
folds come from row numbers that range partitions make, never from one task for all rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.learn.base import Classifier, Estimator, Regressor, classes_of, coded, keyed, keyed_uniform, named_class
from millrace.learn.forecast import numbered

# --- splits ----------------------------------------------------------------------------------------------------------


def _contiguous(n: int, k: int, at: Column) -> Column:
    """Fold of row number `at`: the first n % k folds have one row more."""
    big, small = n % k, n // k
    edge = big * (small + 1)
    return F.when(at < edge, F.floor(at / (small + 1))).otherwise(big + F.floor((at - edge) / max(small, 1))).cast("int")


class KFold:
    """Contiguous folds in the key's order, or in a hashed one with shuffle."""

    def __init__(self, n_splits: int = 5, shuffle: bool = False, seed: int = 0):
        self.n_splits, self.shuffle, self.seed = n_splits, shuffle, seed

    def assign(self, df: DataFrame, key: str, out: str = "fold") -> DataFrame:
        order = [keyed(self.seed, F.col(key)), F.col(key)] if self.shuffle else [F.col(key)]
        x = numbered(df, order, "_mr_n")
        n = x.count()
        if n < self.n_splits:
            raise ValueError("fewer rows than folds")
        return x.withColumn(out, _contiguous(n, self.n_splits, F.col("_mr_n"))).drop("_mr_n")

    def split(self, df: DataFrame, *args, **named) -> Iterator[tuple[DataFrame, DataFrame]]:
        x = self.assign(df, *args, **named)
        for k in range(self.n_splits):
            yield x.where(F.col("fold") != k).drop("fold"), x.where(F.col("fold") == k).drop("fold")


def class_positions(df: DataFrame, label: str, order: list[Column], out: str, blocks: int = 64) -> DataFrame:
    """Position of each row among those of its label in the given order, without one task per label.

    The order's range partitions number their own rows of a label; a table of (partition, label) counts offsets them.
    """
    from millrace.learn.graph import checkpoint

    part = df.repartitionByRange(blocks, *order).withColumn("_mr_p", F.spark_partition_id())
    part = checkpoint(part.withColumn(out, F.row_number().over(Window.partitionBy("_mr_p", label).orderBy(*order)) - 1))
    n = part.groupBy(F.col("_mr_p").alias("_mr_q"), F.col(label).alias("_mr_l")).agg(F.count(F.lit(1)).alias("_mr_c"))
    n = n.withColumn("_mr_o", F.coalesce(F.sum("_mr_c").over(Window.partitionBy("_mr_l").orderBy("_mr_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_mr_c")
    return part.join(F.broadcast(n), (F.col("_mr_p") == F.col("_mr_q")) & F.col(label).eqNullSafe(F.col("_mr_l"))).withColumn(out, F.col(out) + F.col("_mr_o")).drop("_mr_p", "_mr_q", "_mr_l", "_mr_o")


class StratifiedKFold(KFold):
    """Folds with each class's share: the sorted labels dealt out in turn say how many rows of a class a fold tests."""

    def assign(self, df, key, label, out="fold"):
        k = self.n_splits
        sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).orderBy("first").collect()
        if max((r["n"] for r in sizes), default=0) < k:
            raise ValueError("every class has fewer rows than folds")
        allocation, at = {}, 0
        order = [keyed(self.seed, F.col(key)), F.col(key)] if self.shuffle else [F.col(key)]
        for r in sizes:
            n = r["n"]
            allocation[r[label]] = [sum(1 for _ in range(f - at % k if f >= at % k else f + k - at % k, n, k)) for f in range(k)]
            at += n
        x = class_positions(df, label, order, "_mr_n")
        fold = F.lit(None).cast("int")
        for c, counts in allocation.items():
            own, edge = F.lit(k - 1), list(np.cumsum(counts))
            for f in range(k - 2, -1, -1):
                own = F.when(F.col("_mr_n") < int(edge[f]), f).otherwise(own)
            fold = F.when(F.col(label).eqNullSafe(F.lit(c)), own).otherwise(fold)
        return x.withColumn(out, fold).drop("_mr_n")


def _grouped(df: DataFrame, group: str, folds: dict, out: str) -> DataFrame:
    kind = df.schema[group].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(g, int(f)) for g, f in folds.items()], f"_mr_g {kind}, {out} int")
    return df.join(F.broadcast(table) if len(folds) <= 100_000 else table, F.col(group).eqNullSafe(F.col("_mr_g"))).drop("_mr_g")


def _group_sizes(df, group, *more, limit=5_000_000):
    rows = df.groupBy(group, *more).agg(F.count(F.lit(1)).alias("n")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} groups")
    return rows


class GroupKFold(KFold):
    """Groups, the largest first, to the fold with the fewest rows; a group is tested in one fold."""

    def assign(self, df, key, group, out="fold"):
        rows = sorted(_group_sizes(df, group), key=lambda r: (-r["n"], str(r[group])))
        if len(rows) < self.n_splits:
            raise ValueError("fewer groups than folds")
        load, folds = [0] * self.n_splits, {}
        for r in rows:
            f = int(np.argmin(load))
            load[f] += r["n"]
            folds[r[group]] = f
        return _grouped(df, group, folds, out)


class StratifiedGroupKFold(KFold):
    """Groups, the most uneven first, to the fold that keeps the classes' shares over folds most even."""

    def assign(self, df, key, label, group, out="fold"):
        ids, counts = _class_counts(df, group, label)
        n, total, every = self.n_splits, counts.sum(0), np.arange(self.n_splits)
        load, folds = np.zeros((n, counts.shape[1])), np.zeros(len(ids), np.int32)
        trial = np.empty((n, *load.shape))
        for g in np.lexsort((_text_ranks(ids), -counts.std(1))):
            trial[:] = load
            trial[every, every] += counts[g]
            uneven = (trial / total).std(1).mean(1)
            best = np.nonzero(uneven == uneven.min())[0]
            best = best[load[best].sum(1).argmin()]
            folds[g] = best
            load[best] += counts[g]
        own = df.sparkSession.createDataFrame(pa.table({"_mr_g": ids, out: pa.array(folds)}))
        return df.join(F.broadcast(own) if len(ids) <= 100_000 else own, F.col(group).eqNullSafe(F.col("_mr_g"))).drop("_mr_g")


def _class_counts(df: DataFrame, group: str, label: str, limit: int = 5_000_000) -> tuple[pa.Array, np.ndarray]:
    """(groups, rows of each by class); as columns, so the driver holds some dozens of bytes a group."""
    held = df.groupBy(F.col(group).alias("g"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")).limit(limit + 1).toArrow()
    if held.num_rows > limit:
        raise ValueError(f"more than {limit} groups")
    g, y = (held[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("g", "y"))
    labels = y.dictionary.to_pylist()
    place = np.empty(len(labels), np.int64)
    place[sorted(range(len(labels)), key=lambda k: str(labels[k]))] = np.arange(len(labels))
    counts = np.zeros((len(g.dictionary), len(labels)))
    counts[g.indices.to_numpy(), place[y.indices.to_numpy()]] = held["n"].to_numpy()
    return g.dictionary, counts


def _text_ranks(ids: pa.Array) -> np.ndarray:
    """Place of each among all in the order of their texts."""
    plain = pa.types.is_integer(ids.type) or pa.types.is_string(ids.type)
    texts = pc.fill_null(ids.cast(pa.string()), "None") if plain else pa.array([str(v) for v in ids.to_pylist()], pa.string())
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(texts).to_numpy()] = np.arange(len(ids))
    return out


class TimeSeriesSplit:
    """Train on what comes before each of n_splits equal test blocks in the key's order."""

    def __init__(self, n_splits: int = 5, max_train_size: int | None = None, test_size: int | None = None, gap: int = 0):
        self.n_splits, self.max_train_size, self.test_size, self.gap = n_splits, max_train_size, test_size, gap

    def bounds(self, n: int) -> list[tuple[int, int, int]]:
        """(first train row, end of train, first test row) of each split."""
        size = self.test_size or n // (self.n_splits + 1)
        if size < 1 or n - size * self.n_splits - self.gap <= 0:
            raise ValueError("too few rows")
        out = []
        for k in range(self.n_splits):
            test = n - size * (self.n_splits - k)
            end = test - self.gap
            out.append((max(0, end - self.max_train_size) if self.max_train_size else 0, end, test))
        return out

    def split(self, df: DataFrame, key: str):
        x = numbered(df, [F.col(key)], "_mr_n")
        n = x.count()
        size = self.test_size or n // (self.n_splits + 1)
        for a, b, t in self.bounds(n):
            yield x.where((F.col("_mr_n") >= a) & (F.col("_mr_n") < b)).drop("_mr_n"), x.where((F.col("_mr_n") >= t) & (F.col("_mr_n") < t + size)).drop("_mr_n")

    def table(self, df: DataFrame, key: str) -> DataFrame:
        """(key, split, part): every row with the splits that use it and how."""
        x = numbered(df.select(key), [F.col(key)], "_mr_n")
        n = x.count()
        size = self.test_size or n // (self.n_splits + 1)
        rows = [(k, a, b, t, t + size) for k, (a, b, t) in enumerate(self.bounds(n))]
        s = F.broadcast(df.sparkSession.createDataFrame(rows, "split int, a long, b long, t long, e long"))
        m = F.col("_mr_n")
        return x.join(s, ((m >= F.col("a")) & (m < F.col("b"))) | ((m >= F.col("t")) & (m < F.col("e")))).select(key, "split", F.when(m >= F.col("t"), "test").otherwise("train").alias("part"))


class LeaveOneOut:
    """A split per row: the test row's number in the key's order."""

    def assign(self, df, key, out="fold"):
        return numbered(df, [F.col(key)], out)


class LeavePOut:
    """A split per set of p rows: (split, key of a test row). The number of splits is checked."""

    def __init__(self, p: int = 2, limit: int = 1_000_000):
        self.p, self.limit = p, limit

    def table(self, df: DataFrame, key: str) -> DataFrame:
        n = df.count()
        if math.comb(n, self.p) > self.limit:
            raise ValueError(f"more than {self.limit} splits")
        x = numbered(df.select(key), [F.col(key)], "_mr_n")
        sets = df.sparkSession.createDataFrame([(k, list(c)) for k, c in enumerate(itertools.combinations(range(n), self.p))], "split long, rows array<long>")
        return sets.select("split", F.explode("rows").alias("_mr_m")).join(x, F.col("_mr_m") == F.col("_mr_n")).select("split", key)


class LeavePGroupsOut:
    """A split per set of p groups: (split, group)."""

    def __init__(self, p: int = 2, limit: int = 1_000_000):
        self.p, self.limit = p, limit

    def table(self, df: DataFrame, group: str) -> DataFrame:
        groups = sorted((r[group] for r in _group_sizes(df, group, limit=100_000)), key=lambda g: (str(type(g)), g))
        if math.comb(len(groups), self.p) > self.limit:
            raise ValueError(f"more than {self.limit} splits")
        kind = df.schema[group].dataType.simpleString()
        return df.sparkSession.createDataFrame([(k, g) for k, c in enumerate(itertools.combinations(groups, self.p)) for g in c], f"split long, {group} {kind}")

    def split(self, df: DataFrame, group: str):
        held = [(r["split"], r[group]) for r in self.table(df, group).orderBy("split").collect()]
        for _, own in itertools.groupby(held, key=lambda r: r[0]):
            test = F.col(group).isin([g for _, g in own])
            yield df.where(~test), df.where(test)


class LeaveOneGroupOut(LeavePGroupsOut):
    def __init__(self, limit: int = 1_000_000):
        super().__init__(1, limit)


def _sizes(n: int, test_size, train_size=None) -> tuple[int, int]:
    test = math.ceil(n * test_size) if isinstance(test_size, float) else int(test_size)
    train = n - test if train_size is None else math.floor(n * train_size) if isinstance(train_size, float) else int(train_size)
    if test < 1 or train < 1 or test + train > n:
        raise ValueError("sizes do not fit the rows")
    return train, test


class ShuffleSplit:
    """n_splits draws: the first test_size rows in a hashed order test, the next train_size train."""

    def __init__(self, n_splits: int = 10, test_size=0.1, train_size=None, seed: int = 0):
        self.n_splits, self.test_size, self.train_size, self.seed = n_splits, test_size, train_size, seed

    def _parts(self, df, key, k, *rest):
        x = numbered(df, [keyed(self.seed + k, F.col(key)), F.col(key)], "_mr_n")
        train, test = _sizes(x.count(), self.test_size, self.train_size)
        return x.withColumn("part", F.when(F.col("_mr_n") < test, "test").when(F.col("_mr_n") < test + train, "train")).drop("_mr_n")

    def split(self, df: DataFrame, key: str, *rest):
        for k in range(self.n_splits):
            x = self._parts(df, key, k, *rest)
            yield x.where("part = 'train'").drop("part"), x.where("part = 'test'").drop("part")

    def table(self, df: DataFrame, key: str, *rest) -> DataFrame:
        out = None
        for k in range(self.n_splits):
            part = self._parts(df, key, k, *rest).where("part is not null").select(F.lit(k).alias("split"), key, "part")
            out = part if out is None else out.unionByName(part)
        return out


class StratifiedShuffleSplit(ShuffleSplit):
    """The same within each class; test rows are dealt to classes by largest remainder, train rows to what is left of each."""

    def _parts(self, df, key, k, label):
        rows = sorted(_group_sizes(df, label, limit=10_000), key=lambda r: str(r[label]))
        n = sum(r["n"] for r in rows)
        train, test = _sizes(n, self.test_size, self.train_size)

        def dealt(m, sizes):
            n = sum(sizes)
            out = [s * m // n for s in sizes]
            for j in sorted(range(len(sizes)), key=lambda j: (-(sizes[j] * m % n), j))[: m - sum(out)]:
                out[j] += 1
            return out

        sizes = [r["n"] for r in rows]
        tests = dealt(test, sizes)
        trains = dealt(train, [s - t for s, t in zip(sizes, tests)])
        x = class_positions(df, label, [keyed(self.seed + k, F.col(key)), F.col(key)], "_mr_n")
        part = F.lit(None).cast("string")
        for r, a, b in zip(rows, tests, trains):
            part = F.when(F.col(label).eqNullSafe(F.lit(r[label])), F.when(F.col("_mr_n") < a, "test").when(F.col("_mr_n") < a + b, "train")).otherwise(part)
        return x.withColumn("part", part).drop("_mr_n")


class GroupShuffleSplit(ShuffleSplit):
    """Groups instead of rows: the sizes are shares of the groups."""

    def _parts(self, df, key, k, group):
        groups = df.select(F.col(group).alias("_mr_g")).distinct()
        own = ShuffleSplit._parts(self, groups, "_mr_g", k)
        return df.join(own, F.col(group).eqNullSafe(F.col("_mr_g"))).drop("_mr_g")


class PredefinedSplit:
    """A given fold column; -1 is never tested."""

    def __init__(self, column: str):
        self.column = column

    def split(self, df: DataFrame):
        for f in sorted(r[0] for r in df.select(self.column).distinct().collect() if r[0] is not None and r[0] != -1):
            yield df.where(F.col(self.column) != f), df.where(F.col(self.column) == f)


class RepeatedKFold:
    """Shuffled folds with another order each time: (repeat, key..., fold)."""

    stratified = False

    def __init__(self, n_splits: int = 5, n_repeats: int = 10, seed: int = 0):
        self.n_splits, self.n_repeats, self.seed = n_splits, n_repeats, seed

    def table(self, df: DataFrame, key: str, *label: str) -> DataFrame:
        out = None
        for r in range(self.n_repeats):
            kind = StratifiedKFold if self.stratified else KFold
            part = kind(self.n_splits, True, self.seed + r).assign(df.select(key, *label), key, *label).select(F.lit(r).alias("repeat"), key, "fold")
            out = part if out is None else out.unionByName(part)
        return out

    def split(self, df: DataFrame, key: str, *label: str):
        kind = StratifiedKFold if self.stratified else KFold
        for r in range(self.n_repeats):
            yield from kind(self.n_splits, True, self.seed + r).split(df, key, *label)


class RepeatedStratifiedKFold(RepeatedKFold):
    stratified = True


def train_test_split(df: DataFrame, key: str, test_size=0.25, train_size=None, seed: int = 0, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One shuffled split of exact sizes."""
    s = StratifiedShuffleSplit(1, test_size, train_size, seed) if stratify else ShuffleSplit(1, test_size, train_size, seed)
    return next(iter(s.split(df, key, *([stratify] if stratify else []))))


# --- scorers ---------------------------------------------------------------------------------------------------------


def _f1(d: DataFrame) -> float:
    t = d.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") == F.col("p")).cast("long")).alias("tp")).collect()
    q = {r["p"]: r["n"] for r in d.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = {r["y"] for r in t} | set(q)
    by = {r["y"]: r for r in t}
    return float(np.mean([2 * by[c]["tp"] / (by[c]["n"] + q.get(c, 0)) if c in by else 0.0 for c in labels]))


def _r2(d: DataFrame) -> float:
    s = d.agg(F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("e"), (F.var_pop("y") * F.count("y")).alias("v")).first()
    return 1 - s["e"] / s["v"] if s["v"] else 0.0


SCORERS: dict[str, Callable[[DataFrame], float]] = {
    "accuracy": lambda d: d.agg(F.avg((F.col("y") == F.col("p")).cast("double"))).first()[0],
    "f1_macro": _f1,
    "balanced_accuracy": lambda d: d.groupBy("y").agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("r")).agg(F.avg("r")).first()[0],
    "r2": _r2,
    "neg_mean_squared_error": lambda d: -d.agg(F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))).first()[0],
    "neg_root_mean_squared_error": lambda d: -math.sqrt(d.agg(F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))).first()[0]),
    "neg_mean_absolute_error": lambda d: -d.agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0],
    "neg_median_absolute_error": lambda d: -d.agg(F.percentile(F.abs(F.col("y") - F.col("p")), 0.5)).first()[0],
    "max_error": lambda d: -d.agg(F.max(F.abs(F.col("y") - F.col("p")))).first()[0],
}


def get_scorer(name: str) -> Callable:
    """(model, df, label) -> number, larger is better."""
    if name not in SCORERS:
        raise ValueError(f"no scorer {name}; known are {', '.join(sorted(SCORERS))}")
    return make_scorer(SCORERS[name])


def make_scorer(metric: Callable[[DataFrame], float], greater_is_better: bool = True) -> Callable:
    """A scorer from a function of a DataFrame (y, p)."""
    sign = 1 if greater_is_better else -1
    return lambda model, df, label: sign * float(metric(df.select(F.col(label).alias("y"), model.predict_column(model.features_).alias("p"))))


def _scorer(s):
    return get_scorer(s) if isinstance(s, str) else s if s is not None else lambda model, df, label: model.score(df, label)


def cross_val_score(model: Estimator, df: DataFrame, features, label: str, key: str, cv=5, scoring=None, fit: dict | None = None) -> list[float]:
    """The score on each fold of the model fitted on the others."""
    score, out = _scorer(scoring), []
    folds = _folded(df, key, label, cv, model).persist()
    try:
        for k in range(cv if isinstance(cv, int) else cv.n_splits):
            m = model.clone().fit(folds.where(F.col("_mr_fold") != k), features, label, **_fit_args(model, key), **(fit or {}))
            out.append(score(m, folds.where(F.col("_mr_fold") == k), label))
    finally:
        folds.unpersist()
    return out


def _folded(df, key, label, cv, model):
    if not isinstance(cv, int):
        return cv.assign(df, key, *([label] if isinstance(cv, StratifiedKFold) else []), out="_mr_fold")
    return (StratifiedKFold(cv) if isinstance(model, Classifier) else KFold(cv)).assign(df, key, *([label] if isinstance(model, Classifier) else []), out="_mr_fold")


def _fit_args(model, key):
    import inspect

    p = inspect.signature(model.fit).parameters
    return {"key": key} if "key" in p and p["key"].default is inspect.Parameter.empty else {}


def cross_val_predict(model: Estimator, df: DataFrame, features, label: str, key: str, cv=5, out: str = "prediction", column: Callable | None = None) -> DataFrame:
    """df with each row's prediction by the model that did not see its fold."""
    folds, got = _folded(df, key, label, cv, model), None
    for k in range(cv if isinstance(cv, int) else cv.n_splits):
        m = model.clone().fit(folds.where(F.col("_mr_fold") != k), features, label, **_fit_args(model, key))
        part = folds.where(F.col("_mr_fold") == k).withColumn(out, (column or (lambda m: m.predict_column(features)))(m)).drop("_mr_fold")
        got = part if got is None else got.unionByName(part)
    return got


class ParameterGrid:
    def __init__(self, grid: dict | list[dict]):
        self.grid = grid if isinstance(grid, list) else [grid]

    def __iter__(self):
        for g in self.grid:
            names = sorted(g)
            for v in itertools.product(*[g[n] for n in names]):
                yield dict(zip(names, v))

    def __len__(self):
        return sum(math.prod(len(v) for v in g.values()) for g in self.grid)


class ParameterSampler:
    """n_iter settings drawn without repetition from lists, or from functions of a random generator."""

    def __init__(self, space: dict, n_iter: int, seed: int = 0):
        self.space, self.n_iter, self.seed = space, n_iter, seed

    def __iter__(self):
        rng = np.random.default_rng(self.seed)
        if all(not callable(v) for v in self.space.values()):
            every = list(ParameterGrid(self.space))
            for k in rng.permutation(len(every))[: self.n_iter]:
                yield every[k]
            return
        for _ in range(self.n_iter):
            yield {n: v(rng) if callable(v) else v[int(rng.integers(len(v)))] for n, v in sorted(self.space.items())}


class GridSearchCV(Estimator):
    """The setting of the best mean fold score (the first of equals), refitted on all rows."""

    defaults = {"estimator": None, "param_grid": None, "cv": 5, "scoring": None}

    def _settings(self):
        return ParameterGrid(self.param_grid)

    def fit(self, df: DataFrame, features, label: str, key: str):
        results = []
        for p in self._settings():
            s = cross_val_score(self.estimator.clone(**p), df, features, label, key, self.cv, self.scoring)
            results.append({"params": p, "scores": s, "mean": float(np.mean(s)), "std": float(np.std(s))})
        best = max(range(len(results)), key=lambda k: (results[k]["mean"], -k))
        self.best_estimator = self.estimator.clone(**results[best]["params"]).fit(df, features, label, **_fit_args(self.estimator, key))
        self.state |= {"results": results, "best_index": best, "best_params": results[best]["params"], "best_score": results[best]["mean"]}
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.best_estimator.predict(df, out)


class RandomizedSearchCV(GridSearchCV):
    defaults = {"estimator": None, "param_distributions": None, "n_iter": 10, "cv": 5, "scoring": None, "seed": 0}

    def _settings(self):
        return ParameterSampler(self.param_distributions, self.n_iter, self.seed)


def learning_curve(model, df, features, label, key, sizes=(0.1, 0.33, 0.55, 0.78, 1.0), cv=3, scoring=None) -> list[dict]:
    """Mean train and test scores by the share of each fold's training rows used (the first in a hashed order)."""
    score, folds, out = _scorer(scoring), _folded(df, key, label, cv, model), []
    folds = folds.withColumn("_mr_u", keyed_uniform(17, F.col(key))).persist()
    try:
        for s in sizes:
            train, test = [], []
            for k in range(cv):
                own = folds.where((F.col("_mr_fold") != k) & (F.col("_mr_u") < s))
                m = model.clone().fit(own, features, label, **_fit_args(model, key))
                train.append(score(m, own, label))
                test.append(score(m, folds.where(F.col("_mr_fold") == k), label))
            out.append({"size": float(s), "train": float(np.mean(train)), "test": float(np.mean(test))})
    finally:
        folds.unpersist()
    return out


def validation_curve(model, df, features, label, key, name: str, values, cv=3, scoring=None) -> list[dict]:
    """Mean train and test scores by the value of a parameter."""
    score, folds, out = _scorer(scoring), _folded(df, key, label, cv, model).persist(), []
    try:
        for v in values:
            train, test = [], []
            for k in range(cv):
                own = folds.where(F.col("_mr_fold") != k)
                m = model.clone(**{name: v}).fit(own, features, label, **_fit_args(model, key))
                train.append(score(m, own, label))
                test.append(score(m, folds.where(F.col("_mr_fold") == k), label))
            out.append({name: v, "train": float(np.mean(train)), "test": float(np.mean(test))})
    finally:
        folds.unpersist()
    return out


def permuted(df: DataFrame, column: str, key: str, seed: int, out: str) -> DataFrame:
    """df with the column's values in a hashed order of the rows: two numberings joined."""
    a = numbered(df, [F.col(key)], "_mr_a")
    b = numbered(df.select(F.col(column).alias(out), F.col(key).alias("_mr_k")), [keyed(seed, F.col("_mr_k")), F.col("_mr_k")], "_mr_b").drop("_mr_k")
    return a.drop(out).join(b, F.col("_mr_a") == F.col("_mr_b")).drop("_mr_a", "_mr_b")


def permutation_test_score(model, df, features, label, key, cv=3, n_permutations: int = 20, scoring=None, seed: int = 0) -> tuple[float, list[float], float]:
    """(score, scores with permuted labels, p)."""
    real = float(np.mean(cross_val_score(model, df, features, label, key, cv, scoring)))
    fake = [float(np.mean(cross_val_score(model, permuted(df, label, key, seed + k, label), features, label, key, cv, scoring))) for k in range(n_permutations)]
    return real, fake, (sum(s >= real for s in fake) + 1) / (n_permutations + 1)


# --- resampling ------------------------------------------------------------------------------------------------------


def _poisson(u: Column, top: int = 20) -> Column:
    """Count of a Poisson(1) variable at a uniform number."""
    steps, term, s = [], math.exp(-1), math.exp(-1)
    for k in range(1, top):
        steps.append(s)
        term /= k
        s += term
    out = F.lit(0)
    for v in steps:
        out = out + (u >= F.lit(v)).cast("int")
    return out


def bootstrap(df: DataFrame, value: str, key: str, statistic: str = "mean", n_resamples: int = 200, confidence_level: float = 0.95, method: str = "percentile", group: str | None = None, seed: int = 0) -> dict:
    """Interval of the mean, std or difference of two groups' means, by weights that a hash of (key, replicate) draws.

    All replicates are one pass: each row adds to every replicate's weighted sums, its weight being Poisson(1). BCa's
    acceleration comes from the jackknife, whose sums have a closed form from moments.
    """
    x = F.col(value).cast("double")
    rows = df.select(x.alias("x"), F.col(key).alias("k"), (F.col(group) if group else F.lit(0)).alias("g")).where("x is not null")
    from millrace.learn.base import mix64, total

    groups = sorted(r[0] for r in rows.select("g").distinct().collect())
    if statistic == "diff_means" and len(groups) != 2:
        raise ValueError("diff_means needs two groups")
    b, salt = int(n_resamples), np.arange(int(n_resamples), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    code = coded("g", groups)
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])

    def fn(x, h, g):
        out = {}
        for k in range(len(groups)):
            own = g == k
            u = (mix64(h[own].astype(np.int64).view(np.uint64)[:, None] ^ salt) >> np.uint64(11)).astype(float) / 2**53
            w = np.searchsorted(cdf, u, "right").astype(float)
            v = x[own, 0]
            out |= {f"n{k}": w.sum(0), f"s{k}": v @ w, f"q{k}": (v * v) @ w, f"m{k}": np.array([len(v), v.sum(), (v**2).sum(), (v**3).sum()])}
        return out

    s = total(rows.select(F.array("x").alias("x"), F.xxhash64(F.lit(seed), "k").alias("h"), code.alias("g")), fn)

    def stat(n, m, q):
        return m / n if statistic != "std" else np.sqrt(np.maximum(q / n - (m / n) ** 2, 0))

    if statistic == "diff_means":
        est = s["m0"][1] / s["m0"][0] - s["m1"][1] / s["m1"][0]
        reps = s["s0"] / s["n0"] - s["s1"] / s["n1"]
    else:
        est = float(stat(*s["m0"][:3]))
        reps = stat(s["n0"], s["s0"], s["q0"])
    a = (1 - confidence_level) / 2
    if method == "basic":
        low, high = 2 * est - np.quantile(reps, 1 - a), 2 * est - np.quantile(reps, a)
    elif method == "bca":
        from millrace.learn.preprocess import normal_quantile

        phi = lambda v: 0.5 * math.erfc(-v / math.sqrt(2))
        z0 = normal_quantile(min(max(((reps < est).sum() + (reps <= est).sum()) / (2 * b), 0.5 / b), 1 - 0.5 / b))
        acc = 0.0
        if statistic != "std":
            num = den = 0.0
            for k in range(len(groups)):
                n, m1, m2, m3 = s[f"m{k}"]
                mean = m1 / n
                sign = -1.0 if k else 1.0
                num += sign * (m3 - 3 * mean * m2 + 2 * n * mean**3) / (n - 1) ** 3
                den += (m2 - n * mean**2) / (n - 1) ** 2
            acc = num / (6 * den**1.5) if den > 0 else 0.0
        at = lambda p: phi(z0 + (z0 + normal_quantile(p)) / (1 - acc * (z0 + normal_quantile(p))))
        low, high = np.quantile(reps, at(a)), np.quantile(reps, at(1 - a))
    else:
        low, high = np.quantile(reps, a), np.quantile(reps, 1 - a)
    return {"estimate": float(est), "low": float(low), "high": float(high), "standard_error": float(np.std(reps, ddof=1)), "replicates": reps}


def permutation_test(df: DataFrame, value: str, group: str, key: str, n_resamples: int = 500, alternative: str = "two-sided", seed: int = 0) -> dict:
    """Difference of two groups' means against relabellings.

    In each replicate rows go to the first group independently with its share of the rows, by a hash of (key,
    replicate); the difference is of means, so sizes that vary about the share do not bias it. One pass.
    """
    from millrace.learn.base import mix64, total

    groups = classes_of(df, group)
    if len(groups) != 2:
        raise ValueError("needs two groups")
    rows = df.select(F.array(F.col(value).cast("double")).alias("x"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"), coded(group, groups).alias("g"))
    n = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    share, salt = n[0] / (n[0] + n[1]), np.arange(int(n_resamples), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def fn(x, h, g):
        v = x[:, 0]
        w = ((mix64(h.astype(np.int64).view(np.uint64)[:, None] ^ salt) >> np.uint64(11)).astype(float) / 2**53 < share).astype(float)
        return {"n": w.sum(0), "s": v @ w, "all": np.array([len(v), v.sum()]), "own": np.array([v[g == 0].sum(), v[g == 1].sum()])}

    s = total(rows, fn)
    real = s["own"][0] / n[0] - s["own"][1] / n[1]
    fake = s["s"] / s["n"] - (s["all"][1] - s["s"]) / (s["all"][0] - s["n"])
    hit = {"greater": fake >= real, "less": fake <= real, "two-sided": np.abs(fake) >= abs(real)}[alternative]
    return {"statistic": float(real), "p": float((hit.sum() + 1) / (len(fake) + 1)), "null": fake}


def monte_carlo_integrate(spark, fn: Callable[..., Column], bounds: list[tuple[float, float]], n: int = 100_000, seed: int = 0) -> tuple[float, float]:
    """(integral, standard error) of a column function over a box, at hashed uniform points."""
    x = spark.range(n).select(*[(F.lit(float(a)) + keyed_uniform(seed * 1000 + k, F.col("id")) * F.lit(float(b - a))).alias(f"x{k}") for k, (a, b) in enumerate(bounds)])
    r = x.select(fn(*[F.col(f"x{k}") for k in range(len(bounds))]).alias("f")).agg(F.avg("f").alias("m"), F.stddev_samp("f").alias("s")).first()
    size = math.prod(b - a for a, b in bounds)
    return r["m"] * size, (r["s"] or 0.0) * size / math.sqrt(n)


def resample_indices(df: DataFrame, key: str, n: int, seed: int = 0, replace: bool = True) -> DataFrame:
    """(draw, row): n drawn row numbers in the key's order, with or without replacement."""
    rows = df.count()
    if not replace and n > rows:
        raise ValueError("more draws than rows")
    spark = df.sparkSession
    if replace:
        return spark.range(n).select(F.col("id").alias("draw"), F.floor(keyed_uniform(seed, F.col("id")) * rows).cast("long").alias("row"))
    x = numbered(spark.range(rows).select(F.col("id").alias("row")), [keyed(seed, F.col("row")), F.col("row")], "draw")
    return x.where(F.col("draw") < n).select("draw", "row")


def resample(df: DataFrame, key: str, n: int, seed: int = 0, replace: bool = True) -> DataFrame:
    """n drawn rows, with their draw number."""
    return resample_indices(df, key, n, seed, replace).join(numbered(df, [F.col(key)], "_mr_n"), F.col("row") == F.col("_mr_n")).drop("row", "_mr_n")


# --- models of models --------------------------------------------------------------------------------------------------


class _Many(Estimator):
    """State holds fitted members."""

    def _fitted(self, model, df, features, label, key=None, weight=None):
        args = _fit_args(model, key)
        if weight:
            args["weight"] = weight
        return model.clone().fit(df, features, label, **args)


class VotingClassifier(_Many, Classifier):
    """The class that most members name, or of the largest mean probability (voting="soft"); ties take the lower."""

    defaults = {"estimators": (), "voting": "hard", "weights": None}

    def fit(self, df: DataFrame, features, label: str, key: str | None = None):
        self._seen(features)
        self.members = [self._fitted(m, df, features, label, key) for m in self.estimators]
        self.state["classes"] = classes_of(df, label)
        return self

    def predict_column(self, features) -> Column:
        w, cs = self.weights or [1.0] * len(self.members), self.classes_
        if self.voting == "soft":
            ps = [m.proba_column(features) for m in self.members]
            score = F.array(*[sum((p[k] * F.lit(float(v)) for p, v in zip(ps[1:], w[1:])), ps[0][k] * F.lit(float(w[0]))) for k in range(len(cs))])
        else:
            ps = [m.predict_column(features) for m in self.members]
            score = F.array(*[sum(((p == F.lit(c)).cast("double") * F.lit(float(v)) for p, v in zip(ps[1:], w[1:])), (ps[0] == F.lit(c)).cast("double") * F.lit(float(w[0]))) for c in cs])
        return named_class(F.array_position(score, F.array_max(score)) - 1, cs)


class VotingRegressor(_Many, Regressor):
    """The (weighted) mean of the members."""

    defaults = {"estimators": (), "weights": None}

    def fit(self, df, features, label, key=None):
        self._seen(features)
        self.members = [self._fitted(m, df, features, label, key) for m in self.estimators]
        return self

    def predict_column(self, features):
        w = self.weights or [1.0] * len(self.members)
        return sum((m.predict_column(features) * F.lit(float(v)) for m, v in zip(self.members[1:], w[1:])), self.members[0].predict_column(features) * F.lit(float(w[0]))) / F.lit(float(sum(w)))


class BaggingClassifier(VotingClassifier):
    """Copies of one estimator on Poisson bootstraps keyed by row; the vote is soft where members have probabilities."""

    defaults = {"estimator": None, "n_estimators": 10, "seed": 0, "weights": None, "voting": "hard"}

    def fit(self, df, features, label, key: str):
        self._seen(features)
        self.members = []
        for t in range(int(self.n_estimators)):
            own = df.withColumn("_mr_w", _poisson(keyed_uniform(self.seed * 1000 + t, F.col(key))).cast("double")).where("_mr_w > 0")
            self.members.append(self._fitted(self.estimator, own, features, label, key, "_mr_w"))
        if isinstance(self, Classifier):
            self.state["classes"] = classes_of(df, label)
        return self


class BaggingRegressor(VotingRegressor):
    defaults = {"estimator": None, "n_estimators": 10, "seed": 0, "weights": None}
    fit = BaggingClassifier.fit


class StackingClassifier(_Many, Classifier):
    """A final model on the members' cross-validated probabilities (or classes)."""

    defaults = {"estimators": (), "final_estimator": None, "cv": 3}

    def _columns(self, members, features):
        out = []
        for m in members:
            if isinstance(self, Regressor):
                out.append(m.predict_column(features))
            elif hasattr(m, "proba_column"):
                p = m.proba_column(features)
                out += [p[k] for k in range(len(m.classes_) if len(m.classes_) > 2 else 1)]
            else:
                out += [(m.predict_column(features) == F.lit(c)).cast("double") for c in m.classes_[1:]]
        return F.array(*out)

    def fit(self, df: DataFrame, features, label: str, key: str):
        self._seen(features)
        from millrace.learn.graph import checkpoint

        kind = self.estimators[0]
        folds, got = checkpoint(_folded(df, key, label, self.cv, kind)), None
        for k in range(self.cv):
            ms = [self._fitted(m, folds.where(F.col("_mr_fold") != k), features, label, key) for m in self.estimators]
            part = folds.where(F.col("_mr_fold") == k).withColumn("_mr_meta", self._columns(ms, features))
            got = part if got is None else got.unionByName(part)
        self.final = self._fitted(self.final_estimator, checkpoint(got), "_mr_meta", label, key)
        self.members = [self._fitted(m, df, features, label, key) for m in self.estimators]
        if not isinstance(self, Regressor):
            self.state["classes"] = list(self.final.classes_)
        return self

    def predict(self, df: DataFrame, out: str = "prediction", features=None) -> DataFrame:
        x = df.withColumn("_mr_meta", self._columns(self.members, features or self.features_))
        return self.final.predict(x, out, "_mr_meta").drop("_mr_meta")

    def predict_column(self, features) -> Column:
        raise ValueError("a stack predicts tables: use predict()")

    def score(self, df, label, weight=None):
        x = self.predict(df, "_mr_p")
        if isinstance(self, Regressor):
            return _r2(x.select(F.col(label).alias("y"), F.col("_mr_p").alias("p")))
        return x.agg(F.avg((F.col("_mr_p") == F.col(label)).cast("double"))).first()[0]


class StackingRegressor(StackingClassifier, Regressor):
    """The same on the members' cross-validated predictions."""


class OneVsRestClassifier(_Many, Classifier):
    """A binary member per class; the largest probability (or decision) wins, ties the lower class."""

    defaults = {"estimator": None}

    def fit(self, df, features, label, key: str | None = None):
        self._seen(features)
        cs = classes_of(df, label)
        self.members = [self._fitted(self.estimator, df.withColumn("_mr_y", (F.col(label) == F.lit(c)).cast("int")), features, "_mr_y", key) for c in cs]
        self.state["classes"] = cs
        return self

    def predict_column(self, features):
        one = lambda m: m.proba_column(features)[1] if hasattr(m, "proba_column") else m.decision_column(features)
        z = F.array(*[one(m) for m in self.members])
        return named_class(F.array_position(z, F.array_max(z)) - 1, self.classes_)


class MultiOutputClassifier(_Many):
    """A member per target column; predict() adds one column for each."""

    defaults = {"estimator": None}

    def fit(self, df, features, labels: list[str], key: str | None = None):
        self.state |= {"features": features if isinstance(features, str) else list(features), "labels": list(labels)}
        self.members = [self._fitted(self.estimator, df, features, c, key) for c in labels]
        return self

    def predict(self, df: DataFrame, suffix: str = "_prediction") -> DataFrame:
        return df.withColumns({c + suffix: m.predict_column(self.features_) for c, m in zip(self.labels_, self.members)})


class MultiOutputRegressor(MultiOutputClassifier):
    pass


class CalibratedClassifierCV(_Many, Classifier):
    """Members of each fold's rest, their scores turned into probabilities on the fold (sigmoid or isotonic), averaged."""

    defaults = {"estimator": None, "method": "sigmoid", "cv": 3}

    def fit(self, df: DataFrame, features, label: str, key: str):
        from millrace.learn.graph import checkpoint
        from millrace.learn.linear import IsotonicRegression, LogisticRegression

        self._seen(features)
        cs = classes_of(df, label)
        if len(cs) != 2:
            raise ValueError("calibration takes two classes; use OneVsRestClassifier for more")
        folds, self.members = checkpoint(StratifiedKFold(self.cv).assign(df, key, label, out="_mr_fold")), []
        for k in range(self.cv):
            m = self._fitted(self.estimator, folds.where(F.col("_mr_fold") != k), features, label, key)
            own = folds.where(F.col("_mr_fold") == k).select(self._raw(m, features).alias("_mr_s"), coded(label, cs).cast("double").alias("_mr_y"))
            if self.method == "isotonic":
                self.members.append((m, IsotonicRegression(y_min=0.0, y_max=1.0, out_of_bounds="clip").fit(own, "_mr_s", "_mr_y")))
            else:
                n = own.agg(F.sum("_mr_y").alias("a"), F.sum(1 - F.col("_mr_y")).alias("b")).first()
                # smoothed targets as weighted rows of both classes
                hi, lo = (n["a"] + 1) / (n["a"] + 2), 1 / (n["b"] + 2)
                both = own.select("_mr_s", F.explode(F.array(F.struct(F.lit(1).alias("y"), F.when(F.col("_mr_y") == 1, hi).otherwise(lo).alias("w")), F.struct(F.lit(0).alias("y"), F.when(F.col("_mr_y") == 1, 1 - hi).otherwise(1 - lo).alias("w")))).alias("r")).select("_mr_s", "r.y", "r.w")
                self.members.append((m, LogisticRegression(penalty=None).fit(both, ["_mr_s"], "y", "w")))
        self.state["classes"] = cs
        return self

    @staticmethod
    def _raw(m, features):
        if hasattr(m, "decision_column"):
            return m.decision_column(features)
        p = m.proba_column(features)[1]
        return F.ln(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))

    def proba_column(self, features) -> Column:
        parts = []
        for m, c in self.members:
            s = self._raw(m, features)
            if self.method == "isotonic":
                xs, ys = np.asarray(c.x_thresholds_), np.asarray(c.y_thresholds_)
                parts.append(F.arrow_udf(_interpolation(xs, ys), "double")(s))
            else:
                parts.append(1 / (1 + F.exp(-(s * F.lit(float(c.coef_[0][0])) + F.lit(float(c.intercept_[0]))))))
        p = sum(parts[1:], parts[0]) / len(parts)
        return F.array(1 - p, p)

    def predict_column(self, features) -> Column:
        return named_class((self.proba_column(features)[1] > 0.5).cast("int"), self.classes_)


def _interpolation(xs, ys):
    def run(s: pa.Array) -> pa.Array:
        return pa.array(np.interp(s.to_numpy(zero_copy_only=False), xs, ys), pa.float64())

    return run

