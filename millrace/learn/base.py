"""What all estimators share: parameters, fitted state, sums over all rows, row functions, storage.

An estimator is made with its parameters, fitted on a DataFrame with named columns, and applied to another. Fitting
works on sums over all rows (`total`), on JVM aggregates, or, for methods that need all rows at once, on a matrix of a
number of rows that is checked (`bounded_matrix`) and refused beyond it. Applying a model is a column expression, so
all other columns pass through whatever their names.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rows that a method which needs all of them at once takes; more are refused, never sampled.
LIMIT = 20_000
#: Partial sums that the driver adds up itself; the tasks' own are added to as many on the executors first.
FAN_IN = 64
#: Bytes of input up to which the tasks' sums go to the driver as they are.
SMALL = 2 << 30


class NotFitted(RuntimeError):
    """The model has no fitted state yet."""


class Estimator:
    """Parameters as attributes; fitted state as attributes with a trailing underscore."""

    defaults: dict = {}

    def __init__(self, **params):
        unknown = params.keys() - self.defaults.keys()
        if unknown:
            raise TypeError(f"{type(self).__name__} has no parameter {', '.join(sorted(unknown))}")
        self.params = {**self.defaults, **params}
        self.state: dict = {}

    def __getattr__(self, name: str):
        if name in ("params", "state") or name.startswith("__"):
            raise AttributeError(name)
        if name in self.params:
            return self.params[name]
        if name.endswith("_"):
            if name[:-1] in self.state:
                return self.state[name[:-1]]
            raise NotFitted(f"{type(self).__name__} has no {name}: fit it first")
        raise AttributeError(f"{type(self).__name__} has no attribute {name}")

    def __getstate__(self) -> dict:
        """What a task needs of a model: parameters and state, no tables."""
        return {"params": self.params, "state": self.state}

    def clone(self, **params) -> "Estimator":
        return type(self)(**{**self.params, **params})

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.params.items() if v != self.defaults[k])})"

    def dump(self) -> bytes:
        """Parameters and state as an uncompressed archive of arrays and one JSON text; equal models give equal bytes."""
        arrays, plain = {}, {}
        for k, v in self.state.items():
            if isinstance(v, np.ndarray) and v.dtype != object:
                arrays[k] = v
            else:
                plain[k] = v.tolist() if isinstance(v, np.ndarray) else v
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            entry = lambda n: zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0))
            z.writestr(entry("model.json"), json.dumps({"kind": type(self).__name__, "format": "millrace 1", "params": self.params, "state": plain}, sort_keys=True, default=_plain))
            for k in sorted(arrays):
                held = io.BytesIO()
                np.lib.format.write_array(held, np.ascontiguousarray(arrays[k]), allow_pickle=False)
                z.writestr(entry(f"{k}.npy"), held.getvalue())
        return out.getvalue()

    @classmethod
    def restore(cls, data: bytes) -> "Estimator":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            held = json.loads(z.read("model.json"))
            if held["format"] != "millrace 1" or held["kind"] != cls.__name__:
                raise ValueError(f"this holds a {held['kind']} in format {held['format']}, not a {cls.__name__}")
            out = cls(**held["params"])
            out.state = dict(held["state"])
            for n in z.namelist():
                if n.endswith(".npy"):
                    out.state[n[:-4]] = np.lib.format.read_array(io.BytesIO(z.read(n)), allow_pickle=False)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as a one-row table, wherever Spark can write."""
        spark.createDataFrame([(type(self).__name__, bytearray(self.dump()))], "kind string, model binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Estimator":
        return cls.restore(bytes(spark.read.parquet(path).first()["model"]))


def _plain(v):
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, np.ndarray):
        return v.tolist()
    raise TypeError(f"{type(v).__name__} cannot be stored")


def vector(features) -> Column:
    """The feature vector: one array column by its name, or several number columns by theirs."""
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def names(features) -> list[str] | None:
    return None if isinstance(features, str) else list(features)


def rows_of(df: DataFrame, features, *others, **named) -> DataFrame:
    """(x, others by position as y, w, ..., named ones): what a pass over the rows needs, nothing else."""
    cols = [vector(features).alias("x")]
    for name, c in zip(("y", "w", "v"), others):
        if c is not None:
            cols.append((F.col(c) if isinstance(c, str) else c).cast("double").alias(name))
    return df.select(*cols, *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in named.items()])


def matrix(column: pa.Array | pa.ChunkedArray, finite: bool = True) -> np.ndarray:
    """A column of equally long vectors as a matrix; null, ragged and (unless `finite` is off) non-finite input is refused."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    if column.null_count:
        raise ValueError("a feature vector is null")
    flat = column.flatten()
    if flat.null_count and finite:
        raise ValueError("a feature is null")
    out = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(out) % len(column):
        raise ValueError("feature vectors differ in length")
    out = out.reshape(len(column), -1)
    if finite and not np.isfinite(out).all():
        raise ValueError("a feature is not finite")
    return out


def column(c: pa.Array) -> np.ndarray:
    if c.null_count:
        raise ValueError("a label or weight is null")
    return c.to_numpy(zero_copy_only=False)


def _batch(b: pa.RecordBatch, finite: bool) -> dict[str, np.ndarray]:
    return {n: matrix(c, finite) if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else column(c) for n, c in zip(b.schema.names, b.columns)}


def total(rows: DataFrame, fn: Callable[..., dict[str, np.ndarray]], finite: bool = True) -> dict[str, np.ndarray]:
    """Sums over all batches of the arrays that fn(**columns) returns; {} for an empty table.

    Every task returns its own sums, one row per name. Beyond SMALL bytes of input, which come in a few tasks, these
    are added up on the executors first, so the driver gets at most FAN_IN rows of the result's size for each name.
    """

    def part(batches: Iterator[pa.RecordBatch]):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for k, v in fn(**_batch(b, finite)).items():
                    v = np.asarray(v, np.float64)
                    sums[k] = sums[k] + v if k in sums else v
        yield _packed(sums)

    def add(batches: Iterator[pa.RecordBatch]):
        yield _packed(_added(batches))

    schema = "name string, shape array<int>, v array<double>"
    out = rows.mapInArrow(part, schema)
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        out = out.repartition(F.spark_partition_id() % FAN_IN).mapInArrow(add, schema)
    return _added(out.toArrow().to_batches())


def _packed(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(sums), pa.string()), pa.array([list(v.shape) for v in sums.values()], pa.list_(pa.int32())), pa.array([v.ravel() for v in sums.values()], pa.list_(pa.float64()))], ["name", "shape", "v"])


def _added(batches) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    for b in batches:
        for name, shape, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            v = v.values.to_numpy(zero_copy_only=False).reshape(shape)
            out[name] = out[name] + v if name in out else v.copy()
    return out


def moments(rows: DataFrame) -> dict[str, np.ndarray]:
    """n, sum of w, means and scatter matrices of (x, y) about the means; rows have x, y and perhaps w.

    One pass sums about the first batch's offset-free products in double precision; the centre is removed on the
    driver, so columns should not have means that dwarf their deviations by more than about 1e6.
    """

    def fn(x, y=None, w=None):
        z = np.column_stack([x, *([y] if y is not None else []), np.ones(len(x))])
        return {"g": (z if w is None else z * w[:, None]).T @ z, "n": np.array(len(x))}

    s = total(rows, fn)
    if not s:
        raise ValueError("no rows to fit")
    g = s["g"]
    mean = g[-1, :-1] / g[-1, -1]
    return {"n": float(s["n"]), "weight": g[-1, -1], "mean": mean, "scatter": g[:-1, :-1] - np.outer(mean, mean) * g[-1, -1], "raw": g[:-1, :-1]}


def bounded_matrix(df: DataFrame, features, *others, limit: int | None = LIMIT, order=None, finite: bool = True) -> tuple[np.ndarray, ...]:
    """All rows as (matrix, other columns), for methods that need them at once; more than `limit` rows, if given, are refused."""
    rows = df.select(vector(features).alias("x"), *[(F.col(c) if isinstance(c, str) else c).alias(f"o{k}") for k, c in enumerate(others)], *([F.col(order).alias("at")] if order else []))
    held = (rows if limit is None else rows.limit(limit + 1)).toArrow()
    if limit is not None and held.num_rows > limit:
        raise ValueError(f"this method needs all rows at once and takes {limit} at most")
    if order:
        held = held.sort_by("at")
    x = matrix(held["x"], finite)
    return (x, *[held[f"o{k}"].to_numpy() for k in range(len(others))])


def mapped(fn: Callable[[np.ndarray], np.ndarray], features, kind: str = "double", finite: bool = True) -> Column:
    """A column of fn(matrix of the rows), Arrow batch by batch; kind is double, long, int or array<double>."""
    arrow = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}[kind]

    def run(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], arrow)
        out = fn(matrix(x, finite))
        if pa.types.is_list(arrow):
            out = np.asarray(out).reshape(len(x), -1)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel(), arrow.value_type))
        return pa.array(np.asarray(out), arrow)

    return F.arrow_udf(run, kind)(vector(features))


def linear(features, weights, intercept: float = 0.0) -> Column:
    """x . weights + intercept, on the JVM."""
    weights = [float(v) for v in np.asarray(weights).ravel()]
    if isinstance(features, str):
        return F.aggregate(F.zip_with(vector(features), F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.lit(float(intercept))
    out = F.lit(0.0)
    for c, v in zip(features, weights):
        out = out + F.col(c).cast("double") * F.lit(v)
    return out + F.lit(float(intercept))


def classes_of(df: DataFrame, label: str, limit: int = 10_000) -> list:
    """The distinct labels in ascending order; null ones are refused, as are more than `limit`."""
    found = df.select(F.col(label).alias("y")).distinct().limit(limit + 1).toPandas()["y"].tolist()
    if any(v is None for v in found):
        raise ValueError("a label is null")
    if len(found) > limit:
        raise ValueError(f"more than {limit} classes")
    return sorted(found)


def coded(label: str, classes: list) -> Column:
    """Position of the label among the classes; null for others."""
    out = F.lit(None).cast("int")
    for k, c in enumerate(classes):
        out = F.when(F.col(label) == F.lit(c), k).otherwise(out)
    return out


def named_class(code: Column, classes: list) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), code.cast("int") + 1)


def mix64(a: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants)."""
    a = a ^ (a >> np.uint64(30))
    a = a * np.uint64(0xBF58476D1CE4E5B9)
    a = a ^ (a >> np.uint64(27))
    a = a * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def keyed(seed: int, *parts: Column) -> Column:
    """A 64-bit key of the seed and the parts: an order that no partitioning changes."""
    return F.xxhash64(F.lit(int(seed)), *parts)


def keyed_uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the key."""
    return (F.shiftrightunsigned(keyed(seed, *parts), 11)).cast("double") / F.lit(float(1 << 53))


class Predictor(Estimator):
    """A model whose prediction is a column."""

    def predict_column(self, features) -> Column:
        raise NotImplementedError

    def predict(self, df: DataFrame, out: str = "prediction", features=None) -> DataFrame:
        return df.withColumn(out, self.predict_column(features if features is not None else self.features_))

    def _seen(self, features) -> None:
        self.state["features"] = features if isinstance(features, str) else list(features)


class Regressor(Predictor):
    def score(self, df: DataFrame, label: str, weight: str | None = None) -> float:
        """Coefficient of determination; 0 where the label does not vary and 1 where it is met without error."""
        p, y, w = self.predict_column(self.features_), F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
        s = df.select(p.alias("p"), y.alias("y"), w.alias("w")).agg(F.sum("w").alias("n"), F.sum(F.expr("w * y")).alias("s"), F.sum(F.expr("w * y * y")).alias("q"), F.sum(F.expr("w * (y - p) * (y - p)")).alias("e")).first()
        spread = s["q"] - s["s"] ** 2 / s["n"]
        return 1 - s["e"] / spread if spread > 0 else float(s["e"] == 0)


class Classifier(Predictor):
    """Models with `classes_`; `decision_column` gives one number (two classes) or one per class."""

    def score(self, df: DataFrame, label: str, weight: str | None = None) -> float:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        hit = (self.predict_column(self.features_) == F.col(label)).cast("double")
        s = df.select(hit.alias("h"), w.alias("w")).agg(F.sum(F.expr("h * w")).alias("h"), F.sum("w").alias("w")).first()
        return (s["h"] or 0.0) / s["w"]


class Transformer(Estimator):
    """A model that turns the feature vector into another one."""

    def transform_column(self, features) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame, out: str = "transformed", features=None) -> DataFrame:
        return df.withColumn(out, self.transform_column(features if features is not None else self.features_))

    _seen = Predictor._seen

    def fit_transform(self, df: DataFrame, features, *others, out: str = "transformed", **named) -> DataFrame:
        return self.fit(df, features, *others, **named).transform(df, out)
