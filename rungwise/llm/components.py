"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a minimum by node and a join with it; no neighbourhood is ever gathered in one task and
nothing but a few numbers a round comes to the driver.  Each round is a written table.  Nodes of more than
HOT_DEGREE links are few, as links are counted; their minima are broadcast up to HOT_NODES (counted), so
that no task reads a large star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import materialise, scratch

MAX_ROUNDS = 50
HOT_DEGREE, HOT_NODES = 256, 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u's star, from ``least`` (u, m, n)."""
    cold, hot = least.filter(F.col("n") <= HOT_DEGREE).select("u", "m"), least.filter(F.col("n") > HOT_DEGREE).select("u", F.col("m").alias("hot"))
    if not 0 < hot.limit(HOT_NODES + 1).count() <= HOT_NODES:
        return edges.join(least.select("u", "m"), "u")
    marked = edges.join(F.broadcast(hot), "u", "left")
    return marked.filter("hot IS NOT NULL").select("u", "v", F.col("hot").alias("m")).unionByName(marked.filter("hot IS NULL").select("u", "v").join(cold, "u"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links`` (a long, b long); component is the least id reachable.

    An empty link table has no nodes; links of a node to itself and repeated links change nothing.
    """
    with scratch():
        return materialise(_settled(links), "components", keep=True)


def _settled(links: DataFrame) -> DataFrame:
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "components-least")
        large = _with_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "components-large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "components-low")
        small = _with_least(large, low).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "components")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
