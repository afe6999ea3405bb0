"""Scalar quantisation and clustering steps over vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 256


def bounds(base: DataFrame) -> DataFrame:
    """One row: the least and greatest value of each dimension, in order (a row a dimension before)."""
    each = base.select(F.posexplode("e").alias("dim", "v")).groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    listed = each.agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("b"))
    return listed.select(F.transform("b", lambda b: b["lo"]).alias("lo"), F.transform("b", lambda b: b["hi"]).alias("hi"))


def scalar_codes(base: DataFrame, levels: int = LEVELS) -> DataFrame:
    """vec_id, codes (0 to levels - 1 a dimension) and decoded (the middle of each code's interval)."""
    joined = base.join(F.broadcast(bounds(base)))  # one row of two arrays
    width = F.zip_with("lo", "hi", lambda a, b: (b - a) / levels)
    place = lambda x, w: F.when(w > 0, F.least(F.floor(x / w), F.lit(levels - 1))).otherwise(0).cast("int")
    coded = joined.withColumn("w", width).withColumn("codes", F.zip_with(F.zip_with("e", "lo", lambda x, a: x - a), "w", place))
    decoded = F.zip_with(F.zip_with("codes", "w", lambda c, w: (c + 0.5) * w), "lo", lambda x, a: x + a)
    return coded.select("vec_id", "e", "codes", decoded.alias("decoded"))


def lloyd_step(base: DataFrame, assigned: DataFrame) -> DataFrame:
    """list, size and centre: the mean vector of each list; sums are combined before the shuffle."""
    each = base.join(assigned, "vec_id").select("list", F.posexplode("e").alias("dim", "v"))
    means = each.groupBy("list", "dim").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    listed = means.groupBy("list").agg(F.max("n").alias("size"), F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("c"))
    return listed.select("list", "size", F.transform("c", lambda c: c["m"]).alias("centre"))


def centred(base: DataFrame) -> DataFrame:
    """vec_id and e less the mean of its dimension, over its length then; zero vectors stay zero."""
    means = base.select(F.posexplode("e").alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("m"))
    row = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("m"))
    moved = base.join(F.broadcast(row)).select("vec_id", F.zip_with("e", "m", lambda x, m: x - m).alias("e"))  # one row of one array
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return moved.withColumn("norm", norm).withColumn("e", F.transform("e", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)))
