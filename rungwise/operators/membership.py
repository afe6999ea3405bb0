"""Roles, members and their turnover over id tables.  Orders are by whole-number arithmetic on ids, so every run agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.operators.resample import mixed
from rungwise.operators.storage import in_order


def shuffled(ids: DataFrame, seed: int) -> DataFrame:
    """vec_id and place (from 0) in an order that the seed gives.

    The places are dealt out within ranges of the order's key, whose sizes are summed on the way, so that
    no task sorts all ids.
    """
    keyed = ids.select("vec_id").distinct().withColumn("key", mixed(F.pmod(F.col("vec_id"), F.lit(1 << 40)), seed)).withColumn("range", F.shiftright("key", 23))
    sizes = keyed.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # 256 ranges
    inside = F.row_number().over(Window.partitionBy("range").orderBy("key", "vec_id")) - 1
    return keyed.withColumn("at", inside).join(F.broadcast(before), "range").select("vec_id", (F.col("before") + F.col("at")).alias("place"))


def roles(ids: DataFrame, seed: int, counts: dict[str, int]) -> DataFrame:
    """vec_id, role: consecutive slices of the shuffled ids, without replacement; ids beyond them have no row."""
    role, at = F.lit(None).cast("string"), 0
    for name, n in counts.items():
        role = F.when((F.col("place") >= at) & (F.col("place") < at + n), name).otherwise(role)
        at += n
    return shuffled(ids, seed).withColumn("role", role).filter("role IS NOT NULL").select("vec_id", "role")


def turnover(ids: DataFrame, roles_: DataFrame, seed: int, share: float = 0.05) -> DataFrame:
    """vec_id, part: of the ids without a role the first share is in the old state only, the next in the new one only."""
    free = ids.select("vec_id").join(roles_.select("vec_id"), "vec_id", "left_anti")
    placed = shuffled(free, seed)
    cut = F.floor(F.lit(share) * F.col("n") + F.lit(1e-9))
    n = placed.agg(F.count("*").alias("n"))
    part = F.when(F.col("place") < cut, "old_only").when(F.col("place") < 2 * cut, "new_only").otherwise("both")
    return placed.crossJoin(F.broadcast(n)).select("vec_id", part.alias("part"))  # one row


def repaired(parts: DataFrame, disallowed: DataFrame) -> DataFrame:
    """parts without the disallowed ids, and of the longer of old_only and new_only without its smallest ids, so both are equally long."""
    live = parts.join(disallowed.select("vec_id"), "vec_id", "left_anti")
    sizes = live.agg(F.count(F.when(F.col("part") == "old_only", 1)).alias("old"), F.count(F.when(F.col("part") == "new_only", 1)).alias("new"))
    w = Window.partitionBy("part").orderBy("vec_id")
    ranked = live.filter("part <> 'both'").withColumn("r", F.row_number().over(w))
    trim = F.when(F.col("part") == "old_only", F.col("old") - F.col("new")).otherwise(F.col("new") - F.col("old"))
    kept = ranked.crossJoin(F.broadcast(sizes)).filter(F.col("r") > trim).select("vec_id", "part")  # one row
    return kept.unionByName(live.filter("part = 'both'").select("vec_id", "part"))


def insertion_order(vectors: DataFrame, members: DataFrame, norm: Column) -> DataFrame:
    """vec_id, place: all vectors by norm and id, restricted to members in that order."""
    kept = vectors.select("vec_id", norm.alias("norm")).join(members.select("vec_id"), "vec_id", "left_semi")
    return in_order(kept, "norm", "vec_id").select("vec_id", "place")
