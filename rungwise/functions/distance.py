"""Vector distances as column expressions, as kernels over blocks, and as SQL for the oracle.

Everything is computed in double precision; a column expression works inside one row, in element order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _folded(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return _sum(F.zip_with(a, b, f))


def l2sq(a: Column, b: Column) -> Column:
    return _folded(a, b, lambda x, y: (x - y) * (x - y))


def dot(a: Column, b: Column) -> Column:
    return _folded(a, b, lambda x, y: x * y)


def norm_l2sq(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x * x))


def normalised(a: Column, tiny: float | None = None) -> Column:
    """a over its norm; ``tiny`` clamps the norm from below, None leaves it as it is."""
    norm = F.sqrt(norm_l2sq(a))
    norm = F.greatest(norm, F.lit(tiny)) if tiny else norm
    return F.transform(a, lambda x: x / norm)


def l2_norm_form(a: Column, b: Column) -> Column:
    """|a|^2 + |b|^2 - 2ab, at least 0: the independent check of :func:`l2sq`."""
    return F.greatest(F.lit(0.0), norm_l2sq(a) + norm_l2sq(b) - 2 * dot(a, b))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(norm_l2sq(a) * norm_l2sq(b))


def l1(a: Column, b: Column) -> Column:
    return _folded(a, b, lambda x, y: F.abs(x - y))


def linf(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x))


def lp3(a: Column, b: Column) -> Column:
    return _folded(a, b, lambda x, y: F.abs(x - y) * F.abs(x - y) * F.abs(x - y))


def canberra(a: Column, b: Column) -> Column:
    return _folded(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0))


def bray_curtis(a: Column, b: Column) -> Column:
    return l1(a, b) / _folded(a, b, lambda x, y: F.abs(x + y))


def jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of the magnitudes; larger is better."""
    low = _folded(a, b, lambda x, y: F.least(F.abs(x), F.abs(y)))
    return low / _folded(a, b, lambda x, y: F.greatest(F.abs(x), F.abs(y)))


def lp(p: float) -> Callable[[Column, Column], Column]:
    """The sum of the differences' p-th powers."""
    return lambda a, b: _folded(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Half the divergences from the mean vector, of the magnitudes; an element of 0 adds nothing."""

    def part(x: Column, y: Column) -> Column:
        m = (F.abs(x) + F.abs(y)) / 2
        side = lambda v: F.when(F.abs(v) > 0, -F.abs(v) * F.ln(m / F.abs(v))).otherwise(0.0)
        return side(x) + side(y)

    return _folded(a, b, part) / 2


def nan_euclidean(a: Column, b: Column) -> Column:
    """Squared L2 over the elements that both have, scaled up to the whole length; NaN if there is none."""
    has = lambda x, y: ~F.isnan(x) & ~F.isnan(y)
    total = _folded(a, b, lambda x, y: F.when(has(x, y), (x - y) * (x - y)).otherwise(0.0))
    present = _folded(a, b, lambda x, y: F.when(has(x, y), 1.0).otherwise(0.0))
    return F.when(present > 0, total * F.size(a) / present).otherwise(F.lit(float("nan")))


def sign_words(a: Column) -> Column:
    """The signs of all components as bits, 32 in each long of an array."""
    bit = lambda i: F.when(F.get(a, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i % 32)).otherwise(F.expr("0L"))
    starts = F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(32))
    word = lambda s: F.aggregate(F.sequence(s, F.least(s + 31, F.size(a) - 1)), F.expr("0L"), lambda x, i: x + bit(i))
    return F.when(F.size(a) > 0, F.transform(starts, word)).otherwise(F.array().cast("array<bigint>"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two such arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x).cast("double")


def added(a: Column, b: Column, factor: float = 1.0) -> Column:
    """a + factor * b."""
    return F.zip_with(a, b, lambda x, y: x + F.lit(float(factor)) * y)


# The same over blocks: arrays whose last axis holds the elements.
def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.divide(x, y, out=np.zeros(np.broadcast_shapes(x.shape, y.shape)), where=y != 0)


def _norm_form(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (q * q).sum(-1) + (b * b).sum(-1) - 2 * (q * b).sum(-1))


def _js(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = np.abs(q), np.abs(b)
    m = (x + y) / 2
    side = lambda v: np.where(v > 0, -v * np.log(_ratio(m, v), out=np.zeros_like(m), where=np.broadcast_to(v > 0, m.shape)), 0.0)
    return (side(np.broadcast_to(x, m.shape)) + side(np.broadcast_to(y, m.shape))).sum(-1) / 2


KERNELS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "l2": lambda q, b: ((q - b) ** 2).sum(-1),
    "ip": lambda q, b: (q * b).sum(-1),
    "cosine": lambda q, b: (q * b).sum(-1) / np.sqrt((q * q).sum(-1) * (b * b).sum(-1)),
    "angular": lambda q, b: 1 - (q * b).sum(-1),
    "l2_norm_form": _norm_form,
    "l1": lambda q, b: np.abs(q - b).sum(-1),
    "linf": lambda q, b: np.abs(q - b).max(-1),
    "lp3": lambda q, b: (np.abs(q - b) ** 3).sum(-1),
    "canberra": lambda q, b: _ratio(np.abs(q - b), np.abs(q) + np.abs(b)).sum(-1),
    "braycurtis": lambda q, b: np.abs(q - b).sum(-1) / np.abs(q + b).sum(-1),
    "jaccard": lambda q, b: np.minimum(np.abs(q), np.abs(b)).sum(-1) / np.maximum(np.abs(q), np.abs(b)).sum(-1),
    "jensen_shannon": _js,
    "hamming": lambda q, b: ((q > 0) != (b > 0)).sum(-1).astype(np.float64),
}
# Where a matrix product gives the scores but for rounding.
_SQUARES = lambda q, b: (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (q @ b.T)
PRODUCTS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "l2": _SQUARES,
    "l2_norm_form": _SQUARES,
    "ip": lambda q, b: q @ b.T,
    "angular": lambda q, b: 1 - q @ b.T,
    "cosine": lambda q, b: (q @ b.T) / np.sqrt((q * q).sum(1)[:, None] * (b * b).sum(1)[None, :]),
}


#: Twice the rounding of single precision, and the magnitudes (but zero) for which bounds in it are made.
_EPS, _LEAST, _MOST = 2.0**-23, 1e-12, 1e9


def lower_bounds(metric: str, q: np.ndarray, b: np.ndarray) -> Callable[[slice, slice], tuple[np.ndarray, np.ndarray | float]] | None:
    """A function of slices of queries and rows that gives their scores in single precision and by how much these
    may exceed the exact ones; scores of which larger is better are negated.  None where magnitudes forbid it."""
    low, high = (min((f(v) for v in (q, b) if v.size), default=0.0) for f in (_least, lambda v: -np.abs(v).max()))
    if not (q.size and b.size and low >= _LEAST and -high <= _MOST):
        return None
    d, f4 = q.shape[1], np.float32
    if metric in PRODUCTS or metric == "hamming":
        if metric == "hamming":
            x, y = (np.where(v > 0, f4(1), f4(-1)) for v in (q, b))
            return lambda i, j: ((d - x[i] @ y[j].T) / f4(2), 0.0)
        qq, bb = (q * q).sum(1), (b * b).sum(1)
        if metric == "cosine":
            x, y = ((v / np.sqrt(n)[:, None]).astype(f4) if n.all() else None for v, n in ((q, qq), (b, bb)))
            return None if x is None or y is None else lambda i, j: (-(x[i] @ y[j].T), (d + 12) * _EPS)
        x, y, most = q.astype(f4), b.astype(f4), bb.max()
        slack = (2 * (d + 12) * _EPS * (1 + qq + most))[:, None]
        if metric == "ip":
            return lambda i, j: (-(x[i] @ y[j].T), slack[i])
        if metric == "angular":
            return lambda i, j: (1 - x[i] @ y[j].T, slack[i])
        return _squares(q, b)
    if metric not in _ELEMENTS:
        return None
    if metric in ("l1", "linf", "jaccard") and d <= 256:
        by_levels = _by_levels(metric, q, b)
        if by_levels:
            return by_levels
    magnitudes = metric in ("jaccard", "jensen_shannon")
    x, y = (np.ascontiguousarray((np.abs(v) if magnitudes else v).T, f4) for v in (q, b))
    xa, ya = np.abs(x), np.abs(y) + f4(1e-30)  # never zero together
    q1, b1 = np.abs(q).sum(1), np.abs(b).sum(1)
    off = ((d + 8) * _EPS * (q1 + b1.max()))[:, None]
    cubes = (2 * (d + 12) * _EPS * (np.cbrt((np.abs(q) ** 3).sum(1)) + np.cbrt((np.abs(b) ** 3).sum(1)).max()) ** 3)[:, None]
    logs = lambda v: np.abs(v) * np.log(np.where(v == 0, 1.0, np.abs(v)))
    hq, hb = logs(q).sum(1), logs(b).sum(1)
    wide = lambda v: (np.abs(logs(v)) + np.abs(v)).sum(1)
    around = (2 * (d + 16) * _EPS * (wide(q) + wide(b).max()))[:, None]

    def by_element(i: slice, j: slice) -> tuple[np.ndarray, np.ndarray | float]:
        rows = [v[:, i] for v in (x, xa)]
        cols = [v[:, j] for v in (y, ya)]
        total = np.zeros((rows[0].shape[1], cols[0].shape[1]), f4)
        t, u = np.empty_like(total), np.empty_like(total)
        second = np.zeros_like(total) if metric == "braycurtis" else None
        for e in range(d):
            _ELEMENTS[metric](rows[0][e][:, None], cols[0][e][None, :], rows[1][e][:, None], cols[1][e][None, :], total, t, u, second)
        if metric == "lp3":
            return total, cubes[i]
        if metric == "canberra":
            return total, d * (d + 8) * _EPS
        if metric == "jensen_shannon":
            return (hq[i, None].astype(f4) + hb[None, j].astype(f4) - total) / f4(2), around[i]
        o = off[i].astype(f4)
        if metric == "jaccard":
            rest = (q1[i, None] + b1[None, j]).astype(f4) - total - 2 * o
            return np.where(rest > 0, -(total + o) / np.maximum(rest, f4(1e-30)) * f4(1 + 8 * _EPS), f4(-np.inf)), 0.0
        if metric == "braycurtis":
            return (total - o) / (second + o + f4(1e-30)) * f4(1 - 8 * _EPS) - f4(1e-12), 0.0
        return total, off[i]

    return by_element


def _squares(q: np.ndarray, b: np.ndarray) -> Callable[[slice, slice], tuple[np.ndarray, np.ndarray]]:
    """Squared distances in single precision by matrix products, and by how much they may exceed the exact ones."""
    f4 = np.float32
    qq, bb = (q * q).sum(1), (b * b).sum(1)
    x2, y, q4, b4 = -2 * q.astype(f4), b.astype(f4), qq.astype(f4), bb.astype(f4)
    slack = (2 * (q.shape[1] + 12) * _EPS * (1 + qq + bb.max()))[:, None]

    def squares(i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
        s = x2[i] @ y[j].T
        s += q4[i, None]
        s += b4[None, j]
        return s, slack[i]

    return squares


def product_bounds(metric: str, q: np.ndarray, b: np.ndarray) -> tuple[Callable[[slice, slice], tuple[np.ndarray, float]], Callable[[np.ndarray, np.ndarray], np.ndarray]] | None:
    """Lower bounds by matrix products, cheaper and looser than those of :func:`lower_bounds`, where that has some, and
    a function of rows of both sides that gives close lower bounds of single pairs; None for other metrics.

    A sum of cubes of d differences is at least the sum of their squares to the power of 1.5 over the root of d.
    What a and b add to the Jensen-Shannon divergence, over the squared difference of their roots, lies between
    half the logarithm of 2, where one of them is 0, and a half, where they are equal.
    """
    if metric not in ("lp3", "jensen_shannon"):
        return None
    f4 = np.float32
    squares = _squares(*(np.sqrt(np.abs(v)) for v in (q, b))) if metric == "jensen_shannon" else _squares(q, b)
    factor = f4((np.log(2) / 2 if metric == "jensen_shannon" else q.shape[1] ** -0.5) * (1 - 16 * _EPS))

    def bounds(i: slice, j: slice) -> tuple[np.ndarray, float]:
        s, slack = squares(i, j)
        s -= slack.astype(f4) * f4(1 + 2 * _EPS)
        np.maximum(s, 0, out=s)
        if metric == "lp3":
            s *= np.sqrt(s)
        s *= factor
        return s, 0.0

    d, x, y = q.shape[1], q.astype(f4), b.astype(f4)
    if metric == "lp3":
        sizes = [np.cbrt((np.abs(v) ** 3).sum(1)) for v in (q, b)]

        def single(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            t = x[r]
            t -= y[c]
            np.abs(t, out=t)
            return np.einsum("ij,ij,ij->i", t, t, t) - 2 * (d + 12) * _EPS * (sizes[0][r] + sizes[1][c]) ** 3

        return bounds, single
    x, y = np.abs(x), np.abs(y) + f4(1e-30)  # never zero together
    own = [np.where(v == 0, 0.0, np.abs(v) * np.log(np.where(v == 0, 1.0, np.abs(v)))) for v in (q, b)]
    sums, wide = [v.sum(1) for v in own], [(np.abs(v) + np.abs(w)).sum(1) for v, w in zip(own, (q, b), strict=True)]

    def single_(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        t = x[r]
        t += y[c]
        u = np.log(t * f4(0.5))
        return (sums[0][r] + sums[1][c] - np.einsum("ij,ij->i", t, u)) / 2 - 2 * (d + 16) * _EPS * (wide[0][r] + wide[1][c])

    return bounds, single_


def _by_levels(metric: str, q: np.ndarray, b: np.ndarray) -> Callable[[slice, slice], tuple[np.ndarray, np.ndarray | float]] | None:
    """:func:`lower_bounds` from whole levels of the elements, whose differences are off by less than a level each.

    Sums of differences are the sums of the levels less twice the sum of the smaller ones. None where most elements
    are within a few levels of zero, as levels would then tell little.
    """
    d, f4 = q.shape[1], np.float32
    kind, levels = (np.uint8, 255) if metric == "linf" else (np.uint16, 65_535 // d)
    if metric == "jaccard":
        q, b = np.abs(q), np.abs(b)
    low = 0.0 if metric == "jaccard" else min(q.min(), b.min())
    step = max(q.max(), b.max()) - low
    step = step / (levels - 1) if step > 0 else 1.0
    if min(np.median(np.abs(v)) for v in (q, b)) < 8 * step:
        return None
    x, y = (np.ascontiguousarray(np.floor((v - low) / step).T.astype(kind)) for v in (q, b))
    off = step * ((1 if metric == "linf" else d) + 0.01)  # the hundredth of a level covers single precision
    q1, b1 = (np.abs(v).sum(1) for v in (q, b))
    xs, ys = (v.sum(axis=0, dtype=np.float32) for v in (x, y))

    def bounds(i: slice, j: slice) -> tuple[np.ndarray, np.ndarray | float]:
        left, right = x[:, i], y[:, j]
        total = np.zeros((left.shape[1], right.shape[1]), kind)
        t, u = np.empty_like(total), np.empty_like(total)
        for e in range(d):
            a, c = left[e][:, None], right[e][None, :]
            np.minimum(a, c, out=t)
            if metric == "linf":
                np.maximum(total, np.subtract(np.maximum(a, c, out=u), t, out=u), out=total)
            else:
                total += t
        found = total.astype(f4)
        if metric == "linf":
            return found * f4(step), off
        if metric == "l1":
            return (xs[i, None] + ys[None, j] - 2 * found) * f4(step), off
        found *= f4(step)
        rest = (q1[i, None] + b1[None, j]).astype(f4) - found - f4(2 * off)
        return np.where(rest > 0, -(found + f4(off)) / np.maximum(rest, f4(1e-30)) * f4(1 + 8 * _EPS), f4(-np.inf)), 0.0

    return bounds


def _least(v: np.ndarray) -> float:
    """The least magnitude but zero; NaN or infinity count as none."""
    a = np.abs(v)
    return float(a.min(where=a > 0, initial=1.0)) if np.isfinite(a).all() else 0.0


def _l1_element(x, y, xa, ya, total, t, u, second) -> None:
    np.abs(np.subtract(x, y, out=t), out=t)
    total += t


def _linf_element(x, y, xa, ya, total, t, u, second) -> None:
    np.maximum(total, np.abs(np.subtract(x, y, out=t), out=t), out=total)


def _lp3_element(x, y, xa, ya, total, t, u, second) -> None:
    np.abs(np.subtract(x, y, out=t), out=t)
    np.multiply(np.multiply(t, t, out=u), t, out=t)
    total += t


def _canberra_element(x, y, xa, ya, total, t, u, second) -> None:
    np.abs(np.subtract(x, y, out=t), out=t)
    total += np.divide(t, np.add(xa, ya, out=u), out=t)


def _braycurtis_element(x, y, xa, ya, total, t, u, second) -> None:
    _l1_element(x, y, xa, ya, total, t, u, second)
    second += np.abs(np.add(x, y, out=t), out=t)


def _jaccard_element(x, y, xa, ya, total, t, u, second) -> None:
    total += np.minimum(x, y, out=t)


def _js_element(x, y, xa, ya, total, t, u, second) -> None:
    np.add(xa, ya, out=t)
    np.log(np.multiply(t, t.dtype.type(0.5), out=u), out=u)
    total += np.multiply(t, u, out=t)


#: What an element adds to the sums of a block of pairs, in place.
_ELEMENTS = {"l1": _l1_element, "linf": _linf_element, "lp3": _lp3_element, "canberra": _canberra_element, "braycurtis": _braycurtis_element, "jaccard": _jaccard_element, "jensen_shannon": _js_element}


# name: (expression, SQL over lists a.e and b.e, larger is better)
def _sql(element: str) -> str:
    return f"list_sum(list_transform(list_zip(a.e, b.e), lambda p: {element}))"


METRICS: dict[str, tuple[Callable[[Column, Column], Column], str, bool]] = {
    "l2": (l2sq, _sql("(p[1] - p[2]) * (p[1] - p[2])"), False),
    "ip": (dot, _sql("p[1] * p[2]"), True),
    "cosine": (cosine, _sql("p[1] * p[2]") + " / sqrt(list_sum(list_transform(a.e, lambda x: x * x)) * list_sum(list_transform(b.e, lambda x: x * x)))", True),
    "angular": (lambda a, b: 1 - dot(a, b), "1 - " + _sql("p[1] * p[2]"), False),
    "l2_norm_form": (l2_norm_form, "greatest(0, list_sum(list_transform(a.e, lambda x: x * x)) + list_sum(list_transform(b.e, lambda x: x * x)) - 2 * " + _sql("p[1] * p[2]") + ")", False),
    "l1": (l1, _sql("abs(p[1] - p[2])"), False),
    "linf": (linf, "list_max(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2])))", False),
    "lp3": (lp3, _sql("abs(p[1] - p[2]) * abs(p[1] - p[2]) * abs(p[1] - p[2])"), False),
    "canberra": (canberra, _sql("CASE WHEN abs(p[1]) + abs(p[2]) > 0 THEN abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) ELSE 0 END"), False),
    "braycurtis": (bray_curtis, _sql("abs(p[1] - p[2])") + " / " + _sql("abs(p[1] + p[2])"), False),
    "jensen_shannon": (jensen_shannon, _sql("CASE WHEN abs(p[1]) > 0 THEN -abs(p[1]) * ln((abs(p[1]) + abs(p[2])) / 2 / abs(p[1])) ELSE 0 END + CASE WHEN abs(p[2]) > 0 THEN -abs(p[2]) * ln((abs(p[1]) + abs(p[2])) / 2 / abs(p[2])) ELSE 0 END") + " / 2", False),
    "hamming": (lambda a, b: hamming(sign_words(a), sign_words(b)), _sql("CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1.0::DOUBLE ELSE 0 END"), False),
    "jaccard": (jaccard, _sql("least(abs(p[1]), abs(p[2]))") + " / " + _sql("greatest(abs(p[1]), abs(p[2]))"), True),
}
