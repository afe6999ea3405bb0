"""Synthetic vector sets, drawn by the executors: any size, the same rows for the same seed and partitions.

Distributions, not random streams, are the contract: columns are vec_id, part (base or query), vector.
"""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Places and spreads of the bridge set.
CLOUD_AT, CLOUD_SPREAD, BRIDGE_END, BRIDGE_SPREAD, QUERY_NOISE = 3.0, 0.45, 2.6, 0.04, 0.02


def _normals(dim: int, seed: int, scale: Column | float = 1.0) -> list[Column]:
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    return [F.randn(seed * 1009 + i) * scale for i in range(dim)]


def _split(points: DataFrame, n: int) -> DataFrame:
    return points.select(F.col("id").alias("vec_id"), F.when(F.col("id") < n, "base").otherwise("query").alias("part"), F.col("vector").cast("array<float>"))


def narrow_bridge(spark: SparkSession, n: int, dim: int = 16, query_fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """Two clouds at -3 and 3 of the first axis and a bridge of n // 50 points between them; queries are disturbed in every axis."""
    if n < 100 or dim < 2:
        raise ValueError("at least 100 points of 2 dimensions")
    queries = max(20, int(n * query_fraction))
    whole, bridge = n + queries, max(10, n // 50)
    # A place in 0 .. whole - 1 for each id, by a step that has no divisor in common with their number.
    step = next(s for s in range(whole * 5 // 8, 2 * whole) if gcd(s, whole) == 1)
    rows = spark.range(whole).withColumn("place", (F.col("id") * step + seed) % whole)
    on, left = F.col("place") < bridge, F.col("place") < bridge + (whole - bridge) // 2
    drawn = _normals(dim, seed, F.when(on, BRIDGE_SPREAD).otherwise(CLOUD_SPREAD))
    along = F.when(on, F.col("place") / (bridge - 1) * (2 * BRIDGE_END) - BRIDGE_END).otherwise(F.when(left, -CLOUD_AT).otherwise(CLOUD_AT) + drawn[0])
    points = [along, *drawn[1:]]
    noise = [F.when(F.col("id") >= n, F.randn(seed * 1009 + 500 + i) * QUERY_NOISE).otherwise(0.0) for i in range(dim)]
    return _split(rows.withColumn("vector", F.array(*[x + e for x, e in zip(points, noise)])), n)


def gaussian_mixture(spark: SparkSession, n: int, dim: int = 16, seed: int = 0, centres: int = 5) -> DataFrame:
    """Clouds of spread 0.15 to 0.9 about centres of spread 3."""
    import numpy as np

    at = np.random.default_rng(seed).normal(0, 3, (centres, dim))
    rows = spark.range(n + max(20, n // 10)).withColumn("c", F.floor(F.rand(seed * 1009 + 977) * centres).cast("int"))
    scale = F.lit(0.15) + F.col("c") * (0.75 / max(1, centres - 1))
    mean = lambda i: F.get(F.array(*[F.lit(float(x)) for x in at[:, i]]), F.col("c"))
    return _split(rows.withColumn("vector", F.array(*[x + mean(i) for i, x in enumerate(_normals(dim, seed, scale))])), n)


def swiss_roll(spark: SparkSession, n: int, dim: int = 16, seed: int = 0) -> DataFrame:
    """A rolled sheet with noise 0.05, projected at random to dim axes."""
    import numpy as np

    to = np.random.default_rng(seed).normal(size=(3, dim)) / np.sqrt(3)
    rows = spark.range(n + max(20, n // 10)).withColumn("t", (F.rand(seed * 1009 + 977) * 2 + 1) * 4.71238898038469)
    x, y, z = (a + F.randn(seed * 1009 + i) * 0.05 for i, a in enumerate((F.col("t") * F.cos("t"), F.rand(seed * 1009 + 978) * 21, F.col("t") * F.sin("t"))))
    rows = rows.withColumns({"x": x, "y": y, "z": z})
    return _split(rows.withColumn("vector", F.array(*[F.col("x") * float(a) + F.col("y") * float(b) + F.col("z") * float(c) for a, b, c in to.T])), n)


# The names of the sets.
GENERATORS: dict[str, Callable[..., DataFrame]] = {"narrow_bridge": narrow_bridge, "gaussian_mixture": gaussian_mixture, "swiss_roll": swiss_roll}
