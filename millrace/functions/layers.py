"""Layers with their gradients, on batches of NumPy arrays: what one task does to its rows in a training pass.

Every layer returns (output, back); back(gradient of the output) returns the gradients of the inputs in order. The
gradients of weights add up over batches, so a pass sums them as any other statistic.
"""

from __future__ import annotations

import numpy as np

from millrace.learn.base import mix64


def _spread(x, kernel, stride, pad, fill=0.0):
    """Windows of (n, c, h, w) as (n, c, oh, ow, kh, kw), and the padded shape."""
    x = np.pad(x, [(0, 0), (0, 0), (pad[0], pad[0]), (pad[1], pad[1])], constant_values=fill)
    w = np.lib.stride_tricks.sliding_window_view(x, kernel, axis=(2, 3))[:, :, :: stride[0], :: stride[1]]
    return w, x.shape


def _gather(g, shape, kernel, stride, pad):
    """Adds window gradients (n, c, oh, ow, kh, kw) up at their places and cuts the padding off."""
    out = np.zeros(shape)
    for i in range(kernel[0]):
        for j in range(kernel[1]):
            out[:, :, i : i + stride[0] * g.shape[2] : stride[0], j : j + stride[1] * g.shape[3] : stride[1]] += g[..., i, j]
    return out[:, :, pad[0] : shape[2] - pad[0], pad[1] : shape[3] - pad[1]]


def _two(v):
    return (v, v) if isinstance(v, int) else tuple(v)


def conv2d(x, w, b=None, stride=1, padding=0):
    """x (n, c, h, w) with filters w (m, c, kh, kw)."""
    s, p, k = _two(stride), _two(padding), w.shape[2:]
    win, shape = _spread(x, k, s, p)
    y = np.einsum("ncijhw,mchw->nmij", win, w, optimize=True)
    if b is not None:
        y = y + b[None, :, None, None]

    def back(dy):
        dw = np.einsum("ncijhw,nmij->mchw", win, dy, optimize=True)
        dx = _gather(np.einsum("nmij,mchw->ncijhw", dy, w, optimize=True), shape, k, s, p)
        return (dx, dw) if b is None else (dx, dw, dy.sum((0, 2, 3)))

    return y, back


def conv1d(x, w, b=None, stride=1, padding=0):
    """x (n, c, l) with filters w (m, c, k)."""
    y, inner = conv2d(x[:, :, None], w[:, :, None], b, (1, stride), (0, padding))

    def back(dy):
        dx, dw, *db = inner(dy[:, :, None])
        return (dx[:, :, 0], dw[:, :, 0], *db)

    return y[:, :, 0], back


def max_pool2d(x, kernel, stride=None, padding=0):
    """The first of equal maxima gets the gradient."""
    k, p = _two(kernel), _two(padding)
    s = _two(stride or kernel)
    win, shape = _spread(x, k, s, p, -np.inf)
    flat = win.reshape(*win.shape[:4], -1)
    at = flat.argmax(-1)

    def back(dy):
        g = np.zeros(flat.shape)
        np.put_along_axis(g, at[..., None], dy[..., None], -1)
        return _gather(g.reshape(win.shape), shape, k, s, p)

    return np.take_along_axis(flat, at[..., None], -1)[..., 0], back


def avg_pool2d(x, kernel, stride=None, padding=0):
    """Means of windows, padding counted."""
    k, p = _two(kernel), _two(padding)
    s = _two(stride or kernel)
    win, shape = _spread(x, k, s, p)

    def back(dy):
        return _gather(np.broadcast_to(dy[..., None, None] / (k[0] * k[1]), win.shape), shape, k, s, p)

    return win.mean((-2, -1)), back


def max_pool1d(x, kernel, stride=None, padding=0):
    y, inner = max_pool2d(x[:, :, None], (1, kernel), (1, stride or kernel), (0, padding))
    return y[:, :, 0], lambda dy: inner(dy[:, :, None])[:, :, 0]


def avg_pool1d(x, kernel, stride=None, padding=0):
    y, inner = avg_pool2d(x[:, :, None], (1, kernel), (1, stride or kernel), (0, padding))
    return y[:, :, 0], lambda dy: inner(dy[:, :, None])[:, :, 0]


def adaptive_avg_pool2d(x):
    """The mean of each channel."""
    n = x.shape[2] * x.shape[3]
    return x.mean((2, 3), keepdims=True), lambda dy: np.broadcast_to(dy / n, x.shape).copy()


def adaptive_max_pool2d(x):
    """The maximum of each channel."""
    return max_pool2d(x, x.shape[2:])


def batch_norm(x, scale, shift, eps=1e-5):
    """Channels (axis 1) less their batch mean over their batch deviation; of 2-D, 3-D and 4-D input."""
    axes = (0, *range(2, x.ndim))
    wide = lambda v: np.asarray(v).reshape(1, -1, *[1] * (x.ndim - 2))
    inv = 1 / np.sqrt(x.var(axes, keepdims=True) + eps)
    z = (x - x.mean(axes, keepdims=True)) * inv

    def back(dy):
        g = dy * wide(scale)
        dx = inv * (g - g.mean(axes, keepdims=True) - z * (g * z).mean(axes, keepdims=True))
        return dx, (dy * z).sum(axes), dy.sum(axes)

    return z * wide(scale) + wide(shift), back


def layer_norm(x, scale, shift, eps=1e-5):
    """Rows less their mean over their deviation."""
    inv = 1 / np.sqrt(x.var(-1, keepdims=True) + eps)
    z = (x - x.mean(-1, keepdims=True)) * inv

    def back(dy):
        g = dy * scale
        lead = tuple(range(x.ndim - 1))
        return inv * (g - g.mean(-1, keepdims=True) - z * (g * z).mean(-1, keepdims=True)), (dy * z).sum(lead), dy.sum(lead)

    return z * scale + shift, back


def rms_norm(x, scale, eps=1e-5):
    inv = 1 / np.sqrt((x * x).mean(-1, keepdims=True) + eps)

    def back(dy):
        g = dy * scale
        return inv * g - x * inv**3 * (g * x).mean(-1, keepdims=True), (dy * x * inv).sum(tuple(range(x.ndim - 1)))

    return x * inv * scale, back


def linear(x, w, b=None):
    def back(dy):
        return (dy @ w.T, x.T @ dy) if b is None else (dy @ w.T, x.T @ dy, dy.sum(0))

    return (x @ w if b is None else x @ w + b), back


def embedding(ids, table):
    """Rows of the table; the gradient adds up over equal ids."""

    def back(dy):
        g = np.zeros(table.shape)
        np.add.at(g, ids, dy)
        return g

    return table[ids], back


def cross_entropy(z, y):
    """Mean loss of logits; back() gives their gradient."""
    z = z - z.max(1, keepdims=True)
    p = np.exp(z)
    s = p.sum(1, keepdims=True)
    at = (np.arange(len(y)), y)

    def back(dy=1.0):
        g = p / s
        g[at] -= 1
        return dy * g / len(y)

    return float((np.log(s[:, 0]) - z[at]).mean()), back


def chunked_cross_entropy(x, w, y, chunk=1024):
    """The same of x @ w, a chunk of rows at a time, so that logits of all rows never exist together."""
    loss, dx, dw = 0.0, np.empty_like(x, dtype=float), np.zeros(w.shape)
    for at in range(0, len(x), chunk):
        own = slice(at, at + chunk)
        v, back = cross_entropy(x[own] @ w, y[own])
        g = back(len(y[own]) / len(y))
        loss += v * len(y[own]) / len(y)
        dx[own], dw = g @ w.T, dw + x[own].T @ g
    return loss, lambda dy=1.0: (dy * dx, dy * dw)


def dropout2d(x, keys, rate=0.5, seed=0):
    """Whole channels are dropped by a hash of seed, the row's key and the channel; others are scaled up."""
    c = np.arange(x.shape[1], dtype=np.uint64)[None]
    salt = np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))
    h = mix64(mix64(np.asarray(keys).astype(np.int64).view(np.uint64)[:, None] ^ salt) + c)
    keep = (((h >> np.uint64(11)).astype(float) / 2**53 >= rate) / (1 - rate)).reshape(*h.shape, *[1] * (x.ndim - 2))
    return x * keep, lambda dy: dy * keep


def basic_block(x, w1, s1, b1, w2, s2, b2, stride=1, shortcut=None):
    """Two normalised 3 x 3 convolutions and a sum with the input (or its 1 x 1 convolution `shortcut`)."""
    a, back_a = conv2d(x, w1, None, stride, 1)
    n, back_n = batch_norm(a, s1, b1)
    r = np.maximum(n, 0)
    c, back_c = conv2d(r, w2, None, 1, 1)
    m, back_m = batch_norm(c, s2, b2)
    side, back_side = conv2d(x, shortcut, None, stride) if shortcut is not None else (x, None)
    z = m + side

    def back(dy):
        g = dy * (z > 0)
        dc, ds2, db2 = back_m(g)
        dr, dw2 = back_c(dc)
        da, ds1, db1 = back_n(dr * (n > 0))
        dx, dw1 = back_a(da)
        if back_side:
            d, dsc = back_side(g)
            return dx + d, dw1, ds1, db1, dw2, ds2, db2, dsc
        return dx + g, dw1, ds1, db1, dw2, ds2, db2

    return np.maximum(z, 0), back
