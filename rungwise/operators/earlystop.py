"""Searches of inverted lists that stop by a prediction of their recall.

In each round every open query reads the next of its lists, in the order of their centres.  What the round
found gives features; a linear model of them predicts how much of the k nearest the query has, and queries
that are predicted to have enough leave.  Only open queries are packed, met with lists and written again, so
that the work of a round shrinks with its frontier.  The model is fitted to queries of known neighbours by
the sums of its normal equations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.operators import indexes, search
from rungwise.operators.lists import _matrix, search_lists
from rungwise.operators.storage import written

#: Lists that a query reads at most.
ROUNDS = 8
#: Of the model, besides the constant: members read (logarithm), the round's share of the k best, and the
#: k-th score against the distance of the next list's centre.
FEATURES = ("read_log", "fresh", "reach")


def ordered_lists(queries: DataFrame, centres: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, e, lists and ahead: a query's nearest lists in order, and the squared distance of the centre after each."""
    shared = queries.sparkSession.sparkContext.broadcast(indexes._held(centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = search.scores("l2", _matrix(batch["e"]), shared.value)
            order = np.argsort(d, axis=1, kind="stable")
            far = np.take_along_axis(d, order, 1)
            ahead = np.concatenate([far[:, 1:], far[:, -1:]], axis=1)[:, :rounds]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "e": batch["e"], "lists": list(order[:, :rounds].astype(np.int32)), "ahead": list(ahead)})

    return queries.select("vec_id", "e").mapInPandas(run, "vec_id long, e array<double>, lists array<int>, ahead array<double>")


def _round(open_: DataFrame, members: DataFrame, sizes: DataFrame, r: int, k: int) -> DataFrame:
    """The open queries (vec_id, e, lists, ahead, best, read) after their r-th list, with the features of the round."""
    asked = open_.withColumn("list", F.get("lists", F.lit(r - 1))).filter("list IS NOT NULL")
    found = search_lists(members, asked.select("vec_id", "list", "e"), k)
    new = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.collect_list(F.struct("score", "base_id", F.lit(r).alias("round"))).alias("new"))
    joined = asked.join(sizes, "list", "left").join(new, "vec_id", "left")
    both = F.concat("best", F.coalesce("new", F.array().cast("array<struct<score:double,base_id:bigint,round:int>>")))
    best = F.slice(F.array_sort(both), 1, k)
    moved = joined.withColumn("best", best).withColumn("read", F.col("read") + F.coalesce("n", F.lit(0)))
    fresh = F.size(F.filter("best", lambda b: b["round"] == r)) / F.lit(float(k))
    ahead = F.get("ahead", F.lit(r - 1))
    # A query that hasn't k neighbours yet reaches nowhere.
    reach = F.when((F.size("best") == k) & (ahead > 0), F.element_at("best", -1)["score"] / ahead).otherwise(0.0)
    return moved.select("vec_id", "e", "lists", "ahead", "best", "read", F.log1p(F.col("read").cast("double")).alias("read_log"), fresh.alias("fresh"), reach.alias("reach"))


def _opened(queries: DataFrame) -> DataFrame:
    return queries.withColumns({"best": F.array().cast("array<struct<score:double,base_id:bigint,round:int>>"), "read": F.lit(0).cast("long")})


def search_until(members: DataFrame, queries: DataFrame, centres: np.ndarray, model: list[float], target: float, k: int = search.K, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, base_id, score), (query_id, rounds, read, predicted)) of queries that stop at a predicted recall.

    ``model`` is the constant and a coefficient for each of FEATURES.
    """
    members = written(members, "list-members")
    sizes = written(members.groupBy("list").agg(F.count("*").alias("n")), "list-sizes")
    open_ = written(_opened(ordered_lists(queries, centres, rounds)), "open")
    predicted = reduce(lambda s, x: s + F.lit(float(x[1])) * F.col(x[0]), zip(FEATURES, model[1:]), F.lit(float(model[0])))
    done: list[DataFrame] = []
    lists = min(rounds, len(centres))
    for r in range(1, lists + 1):
        after = written(_round(open_, members, sizes, r, k).withColumn("predicted", predicted), "round")
        leaves = F.lit(True) if r == lists else F.col("predicted") >= target
        done.append(after.filter(leaves).select("vec_id", "best", "read", "predicted", F.lit(r).alias("rounds")))
        open_ = after.filter(~leaves).select("vec_id", "e", "lists", "ahead", "best", "read")
        if r < lists and open_.isEmpty():
            break
    ended = reduce(DataFrame.unionByName, done)
    rows = ended.select(F.col("vec_id").alias("query_id"), F.posexplode("best").alias("i", "b"))
    return rows.select("query_id", (F.col("i") + 1).alias("rank"), F.col("b.base_id").alias("base_id"), F.col("b.score").alias("score")), ended.select(F.col("vec_id").alias("query_id"), "rounds", "read", "predicted")


def fitted(members: DataFrame, queries: DataFrame, truth: DataFrame, centres: np.ndarray, k: int = search.K, rounds: int = ROUNDS) -> list[float]:
    """The constant and coefficients that best fit recall over all rounds of queries with known neighbours (query_id, base_id)."""
    members = written(members, "list-members")
    sizes = written(members.groupBy("list").agg(F.count("*").alias("n")), "list-sizes")
    open_ = written(_opened(ordered_lists(queries, centres, rounds)), "open")
    known = truth.groupBy(F.col("query_id").alias("vec_id")).agg(F.collect_set("base_id").alias("known"))
    size = 1 + len(FEATURES)
    total, right = np.zeros((size, size)), np.zeros(size)
    for r in range(1, min(rounds, len(centres)) + 1):
        open_ = written(_round(open_, members, sizes, r, k), "round")
        hit = F.size(F.array_intersect(F.transform("best", lambda b: b["base_id"]), "known")) / F.lit(float(k))
        x = [F.lit(1.0), *[F.col(f) for f in FEATURES]]
        sums = [F.sum(a * b) for a in x for b in x] + [F.sum(a * F.col("y")) for a in x]
        row = open_.join(known, "vec_id").withColumn("y", hit).agg(*[F.coalesce(s, F.lit(0.0)) for s in sums]).first()
        total += np.array(row[: size * size]).reshape(size, size)
        right += np.array(row[size * size :])
        open_ = open_.drop(*FEATURES)
    return np.linalg.lstsq(total, right, rcond=None)[0].tolist()


def recall(found: DataFrame, truth: DataFrame, queries: DataFrame, k: int = search.K) -> DataFrame:
    """query_id, recall of every query, those that found nothing included."""
    hits = found.join(truth.select("query_id", "base_id"), ["query_id", "base_id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    asked = queries.select(F.col("vec_id").alias("query_id"))
    return asked.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / k).alias("recall"))
