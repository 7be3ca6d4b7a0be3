"""Tensor operators on rows, singly or as a program.

A row's tensor is an array column with a static shape. An operator takes a batch of rows, so every array here has the
rows as its first axis; axes in attributes count without it. Constants of a program have no row axis and broadcast.
A program is a list of steps that one Arrow function evaluates, so a whole graph is one column expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def erf(x: np.ndarray) -> np.ndarray:
    """Error function to about 1e-15: its series near zero, the continued fraction of the complement beyond."""
    x = np.asarray(x, float)
    a = np.abs(x)
    near, term, k = a.copy(), a.copy(), 0
    small = np.minimum(a, 2.5)
    near, term = small.copy(), small.copy()
    for k in range(1, 80):
        term = -term * small * small / k
        near += term / (2 * k + 1)
    far = np.maximum(a, 2.5)
    c = np.zeros_like(far)
    for k in range(60, 0, -1):
        c = k / 2 / (far + c)
    tail = np.exp(-far * far) / (far + c) / math.sqrt(math.pi)
    return np.sign(x) * np.where(a < 2.5, near * 2 / math.sqrt(math.pi), 1 - tail)


def _axes(x, axes, rows):
    """Attribute axes to NumPy axes, behind the row axis if there is one."""
    n = x.ndim - int(rows)
    every = range(n) if axes is None else axes
    return tuple(int(rows) + (int(a) + n if a < 0 else int(a)) for a in every)


def _windows(x, kernel, strides, pads, fill):
    """Sliding windows of the trailing axes: (..., out positions, kernel places)."""
    d = len(kernel)
    x = np.pad(x, [(0, 0)] * (x.ndim - d) + [(pads[k], pads[k + d]) for k in range(d)], constant_values=fill)
    w = np.lib.stride_tricks.sliding_window_view(x, kernel, axis=tuple(range(x.ndim - d, x.ndim)))
    return w[(..., *[slice(None, None, s) for s in strides], *[slice(None)] * d)]


def _pads(shape, kernel, strides, pads, auto):
    d = len(kernel)
    if auto in ("SAME_UPPER", "SAME_LOWER"):
        out = [0] * (2 * d)
        for k in range(d):
            need = max(0, (-(-shape[k] // strides[k]) - 1) * strides[k] + kernel[k] - shape[k])
            a, b = (need // 2, need - need // 2) if auto == "SAME_UPPER" else (need - need // 2, need // 2)
            out[k], out[k + d] = a, b
        return out
    return list(pads) if pads else [0] * (2 * d)


def _conv(x, w, b=None, *, strides=None, pads=None, auto_pad="NOTSET", group=1, **_):
    d = w.ndim - 2
    kernel, strides = w.shape[2:], list(strides or [1] * d)
    win = _windows(x, kernel, strides, _pads(x.shape[-d:], kernel, strides, pads, auto_pad), 0.0)
    n, c = x.shape[0], x.shape[1]
    m = w.shape[0]
    win = win.reshape(n, group, c // group, *win.shape[2:])
    out = np.stack([np.tensordot(win[:, g], w[g * m // group : (g + 1) * m // group], ([1, *range(2 + d, 2 + 2 * d)], list(range(1, 2 + d)))) for g in range(group)], 1)
    out = np.moveaxis(out, -1, 2).reshape(n, m, *out.shape[2:-1])
    return out if b is None else out + b.reshape(1, -1, *[1] * d)


def _pool(kind):
    def fn(x, *, kernel_shape, strides=None, pads=None, auto_pad="NOTSET", count_include_pad=0, **_):
        d = len(kernel_shape)
        strides = list(strides or [1] * d)
        p = _pads(x.shape[-d:], kernel_shape, strides, pads, auto_pad)
        ax = tuple(range(-d, 0))
        if kind == "max":
            return _windows(x, kernel_shape, strides, p, -np.inf).max(ax)
        s = _windows(x, kernel_shape, strides, p, 0.0).sum(ax)
        n = math.prod(kernel_shape) if count_include_pad else _windows(np.ones_like(x), kernel_shape, strides, p, 0.0).sum(ax)
        return s / n

    return fn


def _softmax(x, axis, log=False):
    z = x - x.max(axis, keepdims=True)
    s = np.exp(z).sum(axis, keepdims=True)
    return z - np.log(s) if log else np.exp(z) / s


def _norm(x, axes, eps):
    m = x.mean(axes, keepdims=True)
    return (x - m) / np.sqrt(x.var(axes, keepdims=True) + eps)


def _channel(v, x):
    return np.asarray(v).reshape(1, -1, *[1] * (x.ndim - 2))


def _group_norm(x, scale, bias, num_groups, epsilon=1e-5):
    z = x.reshape(len(x), num_groups, -1)
    z = _norm(z, (2,), epsilon).reshape(x.shape)
    per = lambda v: np.repeat(v, x.shape[1] // len(v)) if len(v) != x.shape[1] else v
    return z * _channel(per(np.asarray(scale)), x) + _channel(per(np.asarray(bias)), x)


def _cumsum(x, axis, exclusive=0, reverse=0):
    x = np.flip(x, axis) if reverse else x
    c = np.cumsum(x, axis)
    c = c - x if exclusive else c
    return np.flip(c, axis) if reverse else c


def _gather_nd(x, idx, rows):
    idx = np.asarray(idx, int)
    flat = idx.reshape(-1, idx.shape[-1])
    if rows:
        return x[(slice(None), *flat.T)].reshape(len(x), *idx.shape[:-1], *x.shape[1 + idx.shape[-1] :])
    return x[tuple(flat.T)].reshape(*idx.shape[:-1], *x.shape[idx.shape[-1] :])


def _gemm(a, b, c=None, *, transA=0, transB=0, alpha=1.0, beta=1.0, **_):
    a = np.swapaxes(a, -1, -2) if transA else a
    b = np.swapaxes(b, -1, -2) if transB else b
    out = alpha * (a @ b)
    return out if c is None else out + beta * c


def _pad(x, pads, value, rows):
    d = len(pads) // 2
    lead = [(0, 0)] * (x.ndim - d)
    _ = rows
    return np.pad(x, lead + [(pads[k], pads[k + d]) for k in range(d)], constant_values=value)


#: Elementwise operators; binary ones broadcast.
ELEMENTWISE: dict[str, Callable] = {
    "Abs": np.abs, "Neg": np.negative, "Ceil": np.ceil, "Floor": np.floor, "Round": np.rint, "Sign": np.sign, "Sqrt": np.sqrt, "Exp": np.exp, "Log": np.log, "Sin": np.sin, "Cos": np.cos, "Tanh": np.tanh,
    "Erf": erf, "Reciprocal": lambda x: 1 / x, "Identity": lambda x: x, "Dropout": lambda x, *_, **k: x, "Relu": lambda x: np.maximum(x, 0), "Sigmoid": lambda x: 1 / (1 + np.exp(-np.clip(x, -700, 700))),
    "Softplus": lambda x: np.logaddexp(0, x), "Not": lambda x: (x == 0).astype(float),
    "Elu": lambda x, alpha=1.0: np.where(x > 0, x, alpha * np.expm1(np.minimum(x, 0))),
    "LeakyRelu": lambda x, alpha=0.01: np.where(x > 0, x, alpha * x),
    "HardSigmoid": lambda x, alpha=0.2, beta=0.5: np.clip(alpha * x + beta, 0, 1),
    "HardSwish": lambda x: x * np.clip(x / 6 + 0.5, 0, 1),
    "Gelu": lambda x, approximate="none": 0.5 * x * (1 + (erf(x / math.sqrt(2)) if approximate == "none" else np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))),
    "Clip": lambda x, lo=None, hi=None: np.clip(x, -np.inf if lo is None else lo, np.inf if hi is None else hi),
    "Add": np.add, "Sub": np.subtract, "Mul": np.multiply, "Div": np.divide, "Pow": np.power, "Max": lambda *v: np.maximum.reduce(np.broadcast_arrays(*v)), "Min": lambda *v: np.minimum.reduce(np.broadcast_arrays(*v)),
    "Equal": lambda a, b: (a == b).astype(float), "Greater": lambda a, b: (a > b).astype(float), "GreaterOrEqual": lambda a, b: (a >= b).astype(float), "Less": lambda a, b: (a < b).astype(float), "LessOrEqual": lambda a, b: (a <= b).astype(float),
    "And": lambda a, b: ((a != 0) & (b != 0)).astype(float), "Or": lambda a, b: ((a != 0) | (b != 0)).astype(float), "Where": lambda c, a, b: np.where(c != 0, a, b),
}

_REDUCE = {"ReduceSum": np.sum, "ReduceMean": np.mean, "ReduceMax": np.max, "ReduceMin": np.min, "ReduceL2": lambda x, axis, keepdims: np.sqrt((x * x).sum(axis=axis, keepdims=keepdims))}


def apply(op: str, args: list, rows: list[bool], **k):
    """One operator: (value, whether it has the row axis)."""
    r = any(rows)
    if op in ELEMENTWISE:
        # an array without rows aligns with the trailing axes by broadcasting; one with rows may need inner axes
        wide = max((np.ndim(a) - int(h) for a, h in zip(args, rows) if a is not None), default=0)
        own = [a if a is None or not h or np.ndim(a) - 1 == wide else a.reshape(a.shape[0], *[1] * (wide - a.ndim + 1), *a.shape[1:]) for a, h in zip(args, rows)]
        return ELEMENTWISE[op](*own, **k), r
    x = args[0]
    if op in _REDUCE:
        axes = k.get("axes") if k.get("axes") is not None else (np.asarray(args[1]).tolist() if len(args) > 1 and args[1] is not None else None)
        return _REDUCE[op](x, axis=_axes(x, axes, r), keepdims=bool(k.get("keepdims", 1))), r
    at = lambda d: _axes(x, [k.get("axis", d)], r)[0]
    if op == "ArgMax":
        ax = at(0)
        v = np.flip(x, ax).argmax(ax) if k.get("select_last_index") else x.argmax(ax)
        v = x.shape[ax] - 1 - v if k.get("select_last_index") else v
        return (np.expand_dims(v, ax) if k.get("keepdims", 1) else v).astype(float), r
    if op in ("Softmax", "LogSoftmax"):
        return _softmax(x, at(-1), op == "LogSoftmax"), r
    if op == "Cast":
        to = k["to"]
        return np.asarray(x, {"float": np.float64, "double": np.float64, "float32": np.float32, "int": np.int64, "bool": bool}[to] if isinstance(to, str) else float).astype(float), r
    if op == "Concat":
        n = max(len(a) for a, h in zip(args, rows) if h) if r else 0
        own = [a if h or not r else np.broadcast_to(a, (n, *np.shape(a))) for a, h in zip(args, rows)]
        x = own[0]
        return np.concatenate(own, _axes(x, [k.get("axis", 0)], r)[0]), r
    if op == "ConstantOfShape":
        return np.full([int(v) for v in np.asarray(x).ravel()], float(k.get("value", 0.0))), False
    if op == "Shape":
        return np.array(x.shape[int(r) :], float), False
    if op == "Size":
        return np.array(float(math.prod(x.shape[int(r) :]))), False
    if op == "Conv":
        return _conv(x if r else x[None], *[None if a is None else np.asarray(a) for a in args[1:]], **k), r
    if op == "MaxPool":
        return _pool("max")(x, **k), r
    if op == "AveragePool":
        return _pool("avg")(x, **k), r
    if op in ("GlobalAveragePool", "GlobalMaxPool"):
        ax = tuple(range(2, x.ndim))
        return (x.mean(ax, keepdims=True) if op == "GlobalAveragePool" else x.max(ax, keepdims=True)), r
    if op == "BatchNormalization":
        s, b, m, v = (_channel(a, x) for a in args[1:5])
        return (x - m) / np.sqrt(v + k.get("epsilon", 1e-5)) * s + b, r
    if op == "InstanceNormalization":
        return _norm(x, tuple(range(2, x.ndim)), k.get("epsilon", 1e-5)) * _channel(args[1], x) + _channel(args[2], x), r
    if op == "GroupNormalization":
        return _group_norm(x, args[1], args[2], int(k["num_groups"]), k.get("epsilon", 1e-5)), r
    if op == "LayerNormalization":
        out = _norm(x, (-1,), k.get("epsilon", 1e-5)) * args[1]
        return (out if len(args) < 3 or args[2] is None else out + args[2]), r
    if op == "RMSNormalization":
        return x / np.sqrt((x * x).mean(-1, keepdims=True) + k.get("epsilon", 1e-5)) * args[1], r
    if op == "CumSum":
        ax = int(np.asarray(args[1]).ravel()[0]) if len(args) > 1 else int(k.get("axis", 0))
        return _cumsum(x, _axes(x, [ax], r)[0], k.get("exclusive", 0), k.get("reverse", 0)), r
    if op == "Expand":
        shape = tuple(int(v) for v in np.asarray(args[1]).ravel())
        if not r:
            return np.broadcast_to(x, np.broadcast_shapes(x.shape, shape)), r
        x = x.reshape(len(x), *[1] * (len(shape) - x.ndim + 1), *x.shape[1:])
        return np.broadcast_to(x, (len(x), *np.broadcast_shapes(x.shape[1:], shape))), r
    if op == "Flatten":
        own = x.shape[int(r) :]
        ax = int(k.get("axis", 1 if not r else 0))
        ax = ax + len(own) if ax < 0 else ax
        return x.reshape(*x.shape[: int(r)], math.prod(own[:ax]), math.prod(own[ax:])), r
    if op == "Reshape":
        shape = [int(v) for v in np.asarray(args[1]).ravel()]
        own = x.shape[int(r) :]
        shape = [own[i] if v == 0 else v for i, v in enumerate(shape)]
        return x.reshape(*x.shape[: int(r)], *shape), r
    if op == "Squeeze":
        axes = k.get("axes") if k.get("axes") is not None else (np.asarray(args[1]).ravel().tolist() if len(args) > 1 else None)
        ax = _axes(x, axes, r) if axes is not None else tuple(i for i in range(int(r), x.ndim) if x.shape[i] == 1)
        return np.squeeze(x, ax), r
    if op == "Unsqueeze":
        axes = [int(a) for a in (k.get("axes") if k.get("axes") is not None else np.asarray(args[1]).ravel())]
        n = x.ndim - int(r) + len(axes)
        return np.expand_dims(x, tuple(int(r) + (a + n if a < 0 else a) for a in axes)), r
    if op == "Transpose":
        own = list(range(x.ndim - int(r)))
        perm = k.get("perm") or own[::-1]
        return np.transpose(x, [0, *[p + 1 for p in perm]] if r else perm), r
    if op == "Slice":
        g = lambda i, n: k.get(n) if k.get(n) is not None else (np.asarray(args[i]).ravel().tolist() if len(args) > i and args[i] is not None else None)
        starts, ends, axes, steps = g(1, "starts"), g(2, "ends"), g(3, "axes"), g(4, "steps")
        ix = [slice(None)] * x.ndim
        for j, ax in enumerate(_axes(x, axes if axes is not None else list(range(len(starts))), r)):
            ix[ax] = slice(int(starts[j]), int(ends[j]), int(steps[j]) if steps else None)
        return x[tuple(ix)], r
    if op == "Split":
        ax = at(0)
        sizes = k.get("split") if k.get("split") is not None else (np.asarray(args[1]).ravel().tolist() if len(args) > 1 else None)
        return np.split(x, k.get("num_outputs", 2) if sizes is None else np.cumsum([int(s) for s in sizes])[:-1], ax), r
    if op == "Pad":
        pads = k.get("pads") if k.get("pads") is not None else np.asarray(args[1]).ravel().tolist()
        value = float(np.asarray(args[2]).ravel()[0]) if len(args) > 2 and args[2] is not None else float(k.get("value", 0.0))
        return _pad(x, [int(p) for p in pads], value, r), r
    if op == "Trilu":
        d = int(np.asarray(args[1]).ravel()[0]) if len(args) > 1 and args[1] is not None else int(k.get("k", 0))
        return (np.triu(x, d) if k.get("upper", 1) else np.tril(x, d)), r
    if op == "Gather":
        idx = np.asarray(args[1])
        ax = _axes(x, [k.get("axis", 0)], rows[0])[0]
        if rows[1] and not rows[0]:
            return np.take(x, idx.astype(int), ax), True
        if rows[1]:
            return np.stack([np.take(x[i], idx[i].astype(int), ax - 1) for i in range(len(x))]), True
        return np.take(x, idx.astype(int), ax), r
    if op == "GatherND":
        return _gather_nd(x, args[1], rows[0]), r
    if op == "MatMul":
        return np.matmul(x, args[1]) if not (rows[0] and x.ndim == 2) else (x @ args[1] if not rows[1] else (x * args[1]).sum(-1)), r
    if op == "Gemm":
        return _gemm(*args, **k), r
    raise ValueError(f"no operator {op}")


class Program:
    """Steps (operator, inputs, outputs, attributes) over named values; constants are given with it."""

    def __init__(self, steps: list[tuple[str, list[str], list[str], dict]], constants: dict[str, np.ndarray], inputs: dict[str, tuple[int, ...]], output: str):
        self.steps, self.constants, self.inputs, self.output = steps, constants, inputs, output
        known = set(ELEMENTWISE) | set(_REDUCE)
        others = {"ArgMax", "Softmax", "LogSoftmax", "Cast", "Concat", "ConstantOfShape", "Shape", "Size", "Conv", "MaxPool", "AveragePool", "GlobalAveragePool", "GlobalMaxPool", "BatchNormalization", "InstanceNormalization", "GroupNormalization", "LayerNormalization", "RMSNormalization", "CumSum", "Expand", "Flatten", "Reshape", "Squeeze", "Unsqueeze", "Transpose", "Slice", "Split", "Pad", "Trilu", "Gather", "GatherND", "MatMul", "Gemm"}
        for op, *_ in steps:
            if op not in known | others:
                raise ValueError(f"no operator {op}")

    def run(self, values: dict[str, np.ndarray]) -> np.ndarray:
        """The output for a batch; inputs have the rows first."""
        held = {k: (np.asarray(v, float), False) for k, v in self.constants.items()} | {k: (np.asarray(v, float), True) for k, v in values.items()}
        for op, ins, outs, attrs in self.steps:
            args = [held[n] if n else (None, False) for n in ins]
            out, r = apply(op, [a for a, _ in args], [h for _, h in args], **attrs)
            for n, v in zip(outs, out if op == "Split" else [out]):
                held[n] = (v, r)
        v, r = held[self.output]
        n = len(next(iter(values.values()))) if values else 1
        return v if r else np.broadcast_to(v, (n, *np.shape(v)))

    def column(self, columns: dict[str, str] | None = None) -> Column:
        """The output, flattened row by row, of array columns named like the inputs (or as given)."""
        columns = columns or {k: k for k in self.inputs}

        def run(*arrays: pa.Array) -> pa.Array:
            n = len(arrays[0])
            if not n:
                return pa.array([], pa.list_(pa.float64()))
            values = {}
            for (name, shape), a in zip(self.inputs.items(), arrays):
                flat = a.flatten().to_numpy(zero_copy_only=False).astype(float)
                if a.null_count or len(flat) != n * math.prod(shape):
                    raise ValueError(f"{name} does not have the shape {shape} in every row")
                values[name] = flat.reshape(n, *shape)
            out = np.ascontiguousarray(self.run(values)).reshape(n, -1)
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * out.shape[1], pa.int32()), pa.array(out.ravel().astype(float)))

        return F.arrow_udf(run, "array<double>")(*[F.col(columns[n]).cast("array<double>") for n in self.inputs])


def column(op: str, *inputs, shapes: list[tuple[int, ...]] | None = None, width: int | None = None, **attrs) -> Column:
    """One operator as a column. Strings name array columns (of the given shapes); anything else is a constant."""
    names, consts, held, args = {}, {}, {}, []
    shapes = list(shapes or [])
    for k, v in enumerate(inputs):
        n = f"v{k}"
        args.append("" if v is None else n)
        if isinstance(v, str):
            names[n] = tuple(shapes.pop(0)) if shapes else (width,)
            held[n] = v
        elif v is not None:
            consts[n] = np.asarray(v, float)
    outs = ["out"] if op != "Split" else [f"out{j}" for j in range(len(attrs.get("split") or range(attrs.get("num_outputs", 2))))]
    return Program([(op, args, outs, {a: b for a, b in attrs.items() if a != "piece"})], consts, names, "out" if op != "Split" else f"out{attrs.get('piece', 0)}").column(held)


def activation(name: str):
    """(forward, backward) of identity, logistic, tanh, relu and softmax on arrays; backward takes (output, gradient)."""
    sig = ELEMENTWISE["Sigmoid"]
    return {
        "identity": (lambda x: x, lambda y, g: g),
        "logistic": (sig, lambda y, g: g * y * (1 - y)),
        "tanh": (np.tanh, lambda y, g: g * (1 - y * y)),
        "relu": (lambda x: np.maximum(x, 0), lambda y, g: g * (y > 0)),
        "softmax": (lambda x: _softmax(x, -1), lambda y, g: y * (g - (g * y).sum(-1, keepdims=True))),
    }[name]
