"""Quantisers that add up codes, and rotations that fit a quantiser: residual stages, OPQ and ITQ.

Training reads the TRAINING vectors of least key (a parameter), on the executors: what reaches the driver is
sums by centre, or one cross product of d x d a round, whose singular vectors give the next rotation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.operators import indexes, search
from rungwise.operators.lists import _codes, _matrix, _meant
from rungwise.operators.resample import mixed
from rungwise.operators.storage import written

#: Vectors from which quantisers and rotations are trained.
TRAINING = 1 << 18


def training(base: DataFrame, n: int = TRAINING) -> DataFrame:
    """The n vectors of least key."""
    key = mixed(F.pmod(F.col("vec_id"), F.lit(1 << 40)), 1)
    return written(base.select("vec_id", "e").orderBy(key, "vec_id").limit(n), "training")


# --- residual stages ---------------------------------------------------------------------------------------


def beam(x: np.ndarray, books: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes (n, stages), squared error by stage (n, stages)) of each row's best sequence of codes.

    Every stage extends each of a row's kept sequences by every code and keeps the ``width`` best; the
    sequence that takes the nearest code at every stage is followed besides, so that no beam ends worse.
    """
    n, stages = len(x), len(books)

    def follow(width: int) -> tuple[np.ndarray, np.ndarray]:
        rest, codes, errors = x[:, None, :], np.zeros((n, 1, 0), np.int64), np.zeros((n, 1, 0))
        for book in books:
            kept, size = rest.shape[1], len(book)
            d = search.scores("l2", rest.reshape(n * kept, -1), book).reshape(n, kept * size)
            best = np.argsort(d, axis=1, kind="stable")[:, :width]
            parent, code = best // size, best % size
            rows = np.arange(n)[:, None]
            rest = rest[rows, parent] - book[code]
            codes = np.concatenate([codes[rows, parent], code[:, :, None]], axis=2)
            errors = np.concatenate([errors[rows, parent], np.take_along_axis(d, best, 1)[:, :, None]], axis=2)
        return codes[:, 0], errors[:, 0]

    codes, errors = follow(1)
    if width > 1 and stages > 1:
        wide, off = follow(width)
        better = off[:, -1] < errors[:, -1]
        codes[better], errors[better] = wide[better], off[better]
    return codes, errors


def residual_books(base: DataFrame, stages: int, codes: int, rounds: int, width: int = 1) -> np.ndarray:
    """Codebooks (stages, codes, d): each stage is trained on what the beam of the earlier ones leaves."""
    rest = sample = training(base)
    books = np.zeros((0, codes, 0))
    for _ in range(stages):
        book = indexes.kmeans(rest, indexes.picks(rest, codes), rounds=rounds)[0]
        books = book[None] if not len(books) else np.concatenate([books, book[None]])
        shared = base.sparkSession.sparkContext.broadcast(indexes._held(books))

        def left(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = _matrix(batch["e"])
                found, _ = beam(x, shared.value, width)
                yield batch.assign(e=list(x - sum(shared.value[s][found[:, s]] for s in range(len(shared.value)))))

        rest = written(sample.mapInPandas(left, "vec_id long, e array<double>"), "residuals")
    return books


def residual_codes(base: DataFrame, books: np.ndarray, width: int = 1) -> DataFrame:
    """vec_id, codes, errors: the codes of every vector, and the squared error after each stage."""
    shared = base.sparkSession.sparkContext.broadcast(indexes._held(books))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, errors = beam(_matrix(batch["e"]), shared.value, width)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "codes": list(codes.astype(np.int32)), "errors": list(errors)})

    return base.select("vec_id", "e").mapInPandas(run, "vec_id long, codes array<int>, errors array<double>")


# --- rotations ---------------------------------------------------------------------------------------------


def _cross(base: DataFrame, target, shared) -> tuple[np.ndarray, float]:
    """(sum of x' target(x) over all rows, sum of squared differences of target(x) and the turned x)."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, error = None, 0.0
        for batch in batches:
            x = _matrix(batch["e"])
            turned, y = target(x, shared.value)
            total = x.T @ y if total is None else total + x.T @ y
            error += float(((turned - y) ** 2).sum())
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel(), "error": np.append(error, np.zeros(total.size - 1))})

    rows = base.select("e").mapInPandas(sums, "i int, v double, error double").groupBy("i").agg(F.sum("v").alias("v"), F.sum("error").alias("error")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["v"]
    d = int(round(np.sqrt(len(rows))))
    return out.reshape(d, d), sum(r["error"] for r in rows)


def _turn(cross: np.ndarray) -> np.ndarray:
    """The rotation R that brings x R nearest to the targets, by the singular vectors of the sum of x' y."""
    u, _, v = np.linalg.svd(cross)
    return u @ v


def turned(base: DataFrame, rotation: np.ndarray) -> DataFrame:
    shared = base.sparkSession.sparkContext.broadcast(rotation)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(e=list(_matrix(batch["e"]) @ shared.value))

    return base.select("vec_id", "e").mapInPandas(run, "vec_id long, e array<double>")


def opq(base: DataFrame, parts: int, codes: int, rounds: int, steps: int = 1) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(rotation, books, errors): a rotation fitted to product codes, in turns with the codes, and the error of every turn.

    A turn keeps the books and moves their centres by ``steps`` rounds, codes the vectors, and turns the
    vectors towards what the codes stand for; neither can raise the error.
    """
    sample = training(base)
    rotation = np.eye(len(sample.first()["e"]))
    start, errors = indexes.picks(sample, codes), []
    books = None
    for _ in range(rounds):
        seed = start @ rotation if books is None else np.concatenate(list(books), axis=1)
        books = indexes.kmeans(turned(sample, rotation), seed, parts, steps)
        shared = base.sparkSession.sparkContext.broadcast((rotation, books))

        def meant(x: np.ndarray, fit) -> tuple[np.ndarray, np.ndarray]:
            y = x @ fit[0]
            return y, _meant(_codes(y, fit[1]), fit[1])

        cross, error = _cross(sample, meant, shared)
        errors.append(error)
        rotation = _turn(cross)
    return rotation, books, errors


def itq(base: DataFrame, bits: int, rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(mean, projection (d, bits), errors): principal axes, turned so that the signs lose least.

    The code of a vector is the signs of (x - mean) @ projection.
    """
    sample = training(base)
    rows = sample.select(F.posexplode("e").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()
    mean = np.array([r["m"] for r in rows])
    shared = base.sparkSession.sparkContext.broadcast(mean)
    spread, _ = _cross(sample, lambda x, m: (x - m, x - m), shared)
    values, axes = np.linalg.eigh((spread + spread.T) / 2)  # x' (x - m) summed is the scatter about the mean
    axes = axes[:, np.argsort(-values, kind="stable")[:bits]]
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), range(bits)] < 0, -1.0, 1.0)
    centred = base.sparkSession.sparkContext.broadcast((mean, axes))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, a = centred.value
        for batch in batches:
            yield batch.assign(e=list((_matrix(batch["e"]) - m) @ a))

    projected = written(sample.mapInPandas(project, "vec_id long, e array<double>"), "projected")
    rotation, errors = np.linalg.qr(np.random.default_rng(1).normal(size=(bits, bits)))[0], []
    for _ in range(rounds):
        fit = base.sparkSession.sparkContext.broadcast(rotation)
        cross, error = _cross(projected, lambda x, r: (x @ r, np.where(x @ r >= 0, 1.0, -1.0)), fit)
        errors.append(error)
        rotation = _turn(cross)
    return mean, axes @ rotation, errors


def sign_codes(base: DataFrame, mean: np.ndarray, projection: np.ndarray) -> DataFrame:
    """vec_id, code: the signs of a projection as a string of bits."""
    shared = base.sparkSession.sparkContext.broadcast((mean, projection))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, p = shared.value
        for batch in batches:
            signs = (_matrix(batch["e"]) - m) @ p >= 0
            yield pd.DataFrame({"vec_id": batch["vec_id"], "code": ["".join("01"[int(b)] for b in row) for row in signs]})

    return base.select("vec_id", "e").mapInPandas(run, "vec_id long, code string")
