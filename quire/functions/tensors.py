"""Array kernels as column expressions (array<double>), and numpy kernels for what has a loop in it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def inverse_sigmoid(x: Column, eps: float = 1e-5) -> Column:
    clip = lambda v: F.greatest(F.lit(eps), F.least(F.lit(1.0), v))
    return F.ln(clip(x) / clip(1 - x))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def rms_norm(a: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(total(F.transform(a, lambda x: x * x)) / F.size(a) + eps)
    return F.transform(a, lambda x: x / scale)


def rotate_half(a: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotary embedding with the halves as pairs: element i turns with element i + n / 2."""
    half = F.floor(F.size(a) / 2).cast("int")

    def turned(x: Column, i: Column) -> Column:
        angle = position * F.pow(F.lit(base), -2.0 * (i % half) / F.size(a))
        other = F.when(i < half, -F.get(a, i + half)).otherwise(F.get(a, i - half))
        return x * F.cos(angle) + other * F.sin(angle)

    return F.transform(a, turned)


def rotate_pairs(a: Column, positions: Column, sections: list[int], base: float = 10000.0) -> Column:
    """Rotary embedding with neighbours as pairs; pair k turns by the position of the axis whose section holds k."""
    axis = [i % 3 for i, n in enumerate(sections) for _ in range(n)]
    by_pair = F.array(*[F.get(positions, F.lit(i)) for i in axis])

    def turned(x: Column, i: Column) -> Column:
        pair = F.floor(i / 2).cast("int")
        angle = F.get(by_pair, pair) * F.pow(F.lit(base), -2.0 * pair / F.size(a))
        other = F.when(i % 2 == 0, -F.get(a, i + 1)).otherwise(F.get(a, i - 1))
        return x * F.cos(angle) + other * F.sin(angle)

    return F.transform(a, turned)


def refine(boxes: Column, deltas: Column) -> Column:
    """Normalised boxes moved by a layer's deltas, in the space before the sigmoid."""
    return F.zip_with(boxes, deltas, lambda b, d: sigmoid(inverse_sigmoid(F.greatest(F.lit(0.0), F.least(F.lit(1.0), b))) + d))


def sincos_2d(x: Column, y: Column, width: int = 8, base: float = 10000.0) -> Column:
    """sin and cos of x, then of y, at width / 4 frequencies each."""
    n = width // 4
    parts = [f(v * float(base ** (-i / n))) for v in (x, y) for f in (F.sin, F.cos) for i in range(n)]
    return F.array(*parts)


def summary(a: Column) -> Column:
    return F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi"), (total(a) / F.size(a)).alias("mean"))


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top_positions(a: Column, k: int) -> Column:
    """0-based positions of the k largest, ties by position."""
    pairs = F.transform(a, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def stop_tokens(configured: Column, tokenizer_eos: Column) -> Column:
    return F.array_sort(F.array_union(F.filter(configured, lambda x: x >= 0), F.array(tokenizer_eos)))


# numpy


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, causal: bool = True) -> np.ndarray:
    """(heads, n, d) queries over (kv_heads, m, d) keys and values; query heads share them in groups."""
    group = q.shape[0] // k.shape[0]
    k, v = np.repeat(k, group, 0), np.repeat(v, group, 0)
    s = q @ k.transpose(0, 2, 1) / np.sqrt(q.shape[-1])
    if causal:
        n, m = s.shape[-2:]
        s = np.where(np.arange(m)[None, :] > np.arange(n)[:, None] + m - n, -1e30, s)
    e = np.exp(s - s.max(-1, keepdims=True))
    return (e / e.sum(-1, keepdims=True)) @ v


def gated_mlp(x: np.ndarray, gate: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    g = x @ gate
    return (g / (1 + np.exp(-g)) * (x @ up)) @ down


def grid_sample(image: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Bilinear samples of (h, w, c) at (n, 2) places x, y in -1 .. 1; corners aren't aligned, outside is 0."""
    h, w = image.shape[:2]
    x, y = ((grid[:, 0] + 1) * w - 1) / 2, ((grid[:, 1] + 1) * h - 1) / 2
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((len(grid), image.shape[2]))
    for dx in (0, 1):
        for dy in (0, 1):
            cx, cy = x0 + dx, y0 + dy
            weight = (1 - np.abs(x - cx)) * (1 - np.abs(y - cy))
            ok = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            out[ok] += weight[ok, None] * image[cy[ok], cx[ok]]
    return out


class Cache:
    """Append-only keys and values whose capacity doubles in steps of 256."""

    def __init__(self, heads: int, dim: int):
        self.n, self.k, self.v = 0, np.zeros((heads, 0, dim)), np.zeros((heads, 0, dim))

    @property
    def capacity(self) -> int:
        return self.k.shape[1]

    def append(self, k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        need = self.n + k.shape[1]
        if need > self.capacity:
            size = -(-max(2 * self.capacity, need) // 256) * 256
            pad = ((0, 0), (0, size - self.capacity), (0, 0))
            self.k, self.v = np.pad(self.k, pad), np.pad(self.v, pad)
        self.k[:, self.n : need], self.v[:, self.n : need] = k, v
        self.n = need
        return self.k[:, :need], self.v[:, :need]


def greedy(step, first: int, stop: set[int], most: int) -> list[int]:
    """Tokens that ``step(token)``'s logits pick, up to a stop token or ``most`` of them."""
    out, token = [], first
    while len(out) < most:
        token = int(np.argmax(step(token)))
        if token in stop:
            break
        out.append(token)
    return out


def cubic_weights(n: int, m: int, a: float = -0.5) -> tuple[np.ndarray, np.ndarray]:
    """(4 taps, weights) of each of m places over n samples: Keys' kernel, edges clamped, weights sum to 1."""
    at = (np.arange(m) + 0.5) * n / m - 0.5
    base = np.floor(at).astype(int)
    taps = base[:, None] + np.arange(-1, 3)
    d = np.abs(at[:, None] - taps)
    w = np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, np.where(d < 2, ((d - 5) * d + 8) * d * a - 4 * a, 0))
    return np.clip(taps, 0, n - 1), w / w.sum(1, keepdims=True)


def bicubic(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """(h, w, ..) bytes: rows, then columns; rounded half up and clamped."""
    ty, wy = cubic_weights(image.shape[0], h)
    tx, wx = cubic_weights(image.shape[1], w)
    rows = np.einsum("hk,hk...->h...", wy, image.astype(float)[ty])
    cols = np.einsum("wk,hwk...->hw...", wx, rows[:, tx])
    return np.clip(np.floor(cols + 0.5), 0, 255).astype(np.uint8)
