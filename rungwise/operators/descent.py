"""Neighbour graphs by descent, and their pruning, as joins over edges.

A neighbour of a neighbour is likely a neighbour.  A round takes, for each node, up to SAMPLE of its new
neighbours, of its old ones, and of the nodes that have it as such; it compares new ones with each other and
with old ones, and keeps each node's best.  An edge is new until a round has taken it, so that no pair is
compared twice through the same node without cause.  A node that many have as a neighbour is taken by no more
than SAMPLE of them, chosen by a hash: what a task holds of a node is bounded.  Rounds end when few edges
change.

Vectors are most of what travels.  The first edges are of nodes that share a near pivot, which costs a vector NEAREST
rows and leaves few rounds; vectors that single precision holds exactly travel in it; a node's vector goes only to
groups with a new member; and a group gives a node only what its list, by its largest score, has room for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rungwise.operators import search
from rungwise.operators.storage import written

#: Neighbours that the descent keeps, and of each kind that a round takes of a node.
KEPT, SAMPLE = 20, 10
#: A round that changes fewer edges than this share is the last.
SETTLED = 0.002
#: Vectors for each pivot of the start, most pivots, pivots that a vector goes to, and members of a group.
PER_PIVOT, PIVOTS, NEAREST, MEMBERS = 64, 4096, 8, 1024


def _narrow(base: DataFrame) -> DataFrame:
    """``base`` with its vectors in single precision if that changes none of them."""
    exact = base.filter(F.exists("e", lambda v: v.cast("float").cast("double") != v)).isEmpty()
    return base.withColumn("e", F.col("e").cast("array<float>")) if exact else base


def _start(base: DataFrame, kept: int) -> DataFrame:
    """id, other, score, new: each vector's best among those that share one of its nearest pivots, which are vectors chosen by a hash."""
    n = base.count()
    chosen = base.orderBy(F.xxhash64("vec_id"), "vec_id").select("e").limit(min(PIVOTS, max(1, n // PER_PIVOT)))
    pivots = np.array([r["e"] for r in chosen.collect()], float)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 1024):
                own = batch[low : low + 1024]
                d = search.scores("l2", np.stack(own["e"].to_numpy()).astype(float), pivots)
                near = np.argpartition(d, NEAREST - 1, axis=1)[:, :NEAREST] if len(pivots) > NEAREST else np.broadcast_to(np.arange(len(pivots)), d.shape)
                yield pd.DataFrame({"vec_id": np.repeat(own["vec_id"].to_numpy(), near.shape[1]), "g": near.ravel()})

    of = written(base.select("vec_id", "e").mapInPandas(nearest, "vec_id long, g long"), "descent-pivots")
    # A group of too many members is dealt to several by a hash.
    parts = of.groupBy("g").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    dealt = of.join(F.broadcast(parts), "g").select("vec_id", "g", F.pmod(F.xxhash64("vec_id", "g"), F.col("parts")).alias("part"))
    members = dealt.join(base.select("vec_id", "e"), "vec_id").groupBy("g", "part").agg(F.collect_list(F.struct("vec_id", "e")).alias("m"))
    always = lambda value: F.transform("m", lambda x: F.lit(value))
    groups = members.select(F.col("m.vec_id").alias("ids"), F.col("m.e").alias("es"), always(True).alias("fresh"), always(float("inf")).alias("worst"))
    return _compared(groups, kept)[0].withColumn("new", F.lit(True))


def _compared(groups: DataFrame, kept: int) -> tuple[DataFrame, DataFrame]:
    """((id, other, score) of what groups (ids, es, fresh, worst) give each member, compared: pairs of each group).

    Pairs of which one at least is fresh are compared; each member keeps its ``kept`` best of the group, up to its worst.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs, parts = 0, [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1))]
            for ids, es, fresh, worst in zip(batch["ids"], batch["es"], batch["fresh"], batch["worst"]):
                ids, fresh = np.asarray(ids), np.asarray(fresh, bool)
                x = np.stack([np.asarray(e, float) for e in es])
                d = search.scores("l2", x, x)
                asked = (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :])
                pairs += int(asked.sum()) // 2
                d = np.where(asked & (d <= np.asarray(worst)[:, None]), d, np.inf)
                near = np.argsort(d, axis=1, kind="stable")[:, :kept]
                row, column = np.repeat(np.arange(len(ids)), near.shape[1]), near.ravel()
                good = np.isfinite(d[row, column])
                row, column = row[good], column[good]
                parts.append((ids[row], ids[column], d[row, column]))
            ids, others, score = (np.concatenate(x) for x in zip(*parts))
            # The first row has no ends and carries the count.
            first = np.arange(len(ids)) == 0
            ends = {name: pd.arrays.IntegerArray(x.astype(np.int64), first) for name, x in (("id", ids), ("other", others))}
            yield pd.DataFrame({**ends, "score": score, "pairs": np.where(first, pairs, 0)})

    found = written(groups.select("ids", "es", "fresh", "worst").mapInPandas(run, "id long, other long, score double, pairs long"), "descent-found")
    return found.filter("id IS NOT NULL").select("id", "other", "score"), found.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def _taken(edges: DataFrame, by: str, round_: int) -> DataFrame:
    """The edges of which each node of ``by`` takes SAMPLE, chosen by a hash of the round."""
    w = Window.partitionBy(by, "new").orderBy(F.xxhash64("id", "other", F.lit(round_)))
    return edges.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= SAMPLE).drop("_at")


def nn_descent(base: DataFrame, kept: int = KEPT, rounds: int = 30) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(id, other, score) of about each vector's ``kept`` nearest, and (pairs compared, edges changed) of each round."""
    n, base = base.count(), _narrow(base)
    edges = written(_best(_start(base, kept).withColumns({"had": F.lit(False), "used": F.lit(False)}), kept).drop("had"), "descent")
    history: list[tuple[int, int]] = []
    for r in range(rounds):
        forward = written(_taken(edges, "id", r), "descent-taken")
        back = _taken(edges, "other", r).select(F.col("other").alias("id"), F.col("id").alias("other"), "new")
        around = forward.select("id", "other", "new").unionByName(back).repartition("id").groupBy("id", "other").agg(F.max("new").alias("new"))
        lists = around.groupBy("id").agg(F.collect_list(F.struct("other", "new")).alias("m")).filter(F.exists("m", lambda x: x["new"]))
        # What a full list has no room for is not sent to it.
        full = edges.groupBy("id").agg(F.max("score").alias("score"), F.count("*").alias("n")).select(F.col("id").alias("vec_id"), F.when(F.col("n") >= kept, F.col("score")).alias("worst"))
        vectors = base.join(full, "vec_id", "left").select(F.col("vec_id").alias("other"), "e", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        members = lists.select("id", F.explode("m").alias("x")).select("id", "x.*").join(vectors, "other")
        groups = members.groupBy("id").agg(F.collect_list(F.struct("other", "e", "new", "worst")).alias("m"))
        found, pairs = _compared(groups.select(F.col("m.other").alias("ids"), F.col("m.e").alias("es"), F.col("m.new").alias("fresh"), F.col("m.worst").alias("worst")), kept)
        flags = lambda df, had, used: df.withColumns({"had": F.lit(had), "used": F.lit(used)})
        used = flags(forward.filter("new").select("id", "other", "score", "new"), True, True)
        every = flags(edges, True, False).unionByName(used).unionByName(flags(found.withColumn("new", F.lit(True)), False, False))
        after = written(_best(every, kept), "descent")
        changed = after.filter("NOT had").count()
        history.append((pairs.first()["pairs"], changed))
        edges = after.drop("had")
        if changed <= SETTLED * n * kept:
            break
    return edges.select("id", "other", "score"), history


def _best(edges: DataFrame, kept: int) -> DataFrame:
    """Each id's ``kept`` best of (id, other, score, new, had, used); an edge stays new until it is used. One shuffle, by id."""
    own = edges.repartition("id").groupBy("id", "other").agg(F.min("score").alias("score"), F.min(F.col("new") & ~F.col("used")).alias("new"), F.max("had").alias("had"))
    w = Window.partitionBy("id").orderBy("score", "other")
    return own.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= kept).select("id", "other", "score", "new", "had")


def pruned(edges: DataFrame) -> DataFrame:
    """The edges (id, other, score) that no shorter way of two edges replaces.

    An edge goes if the graph has id-w and an edge between w and other, in either direction, that are both
    shorter than it; ties leave it.
    """
    # Two steps out of a node are at most the square of what a list holds; steps against an edge are never
    # taken, so that a node which many lists hold costs only its own list each time.
    two = edges.select("id", F.col("other").alias("x"), F.col("score").alias("a")).join(edges.select(F.col("id").alias("x"), F.col("other").alias("y"), F.col("score").alias("b")), "x")
    own = edges.select("id", F.col("other").alias("y"), F.col("score").alias("c"))
    met = two.join(own, ["id", "y"])
    # The edge to y by way of x, and the edge to x by way of y.
    ways = met.select("id", F.col("y").alias("other"), F.greatest("a", "b").alias("way")).unionByName(met.select("id", F.col("x").alias("other"), F.greatest("c", "b").alias("way")))
    detours = ways.groupBy("id", "other").agg(F.min("way").alias("way"))
    return edges.join(detours, ["id", "other"], "left").filter(F.col("way").isNull() | (F.col("way") >= F.col("score"))).select("id", "other", "score")
