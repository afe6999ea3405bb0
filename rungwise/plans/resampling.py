"""Queries of resampled intervals.  Both sides draw by the same whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.operators import policy, resample
from rungwise.operators.policy import END
from rungwise.operators.resample import REPLICATES, weights_sql
from rungwise.operators.search import K
from rungwise.plans.catalogue import _CUBE, _PAIRS
from rungwise.plans.decisions import _EVAL, _REFRESH, _arm_rows, _arms_sql, _refresh
from rungwise.plans.registry import cube_of, query, stored

#: Replicates of the two-level draw, which draws a set of queries for each build of each replicate.
NESTED = 1000


def _drawn(spark, sf_dir, axis: DataFrame, unit: str, salt: int) -> DataFrame | resample.Draw:
    """Weights of targets, which are few, as a table; of queries in blocks."""
    if unit == "query_id":
        return resample.draw(axis, unit, salt, keep=lambda name, build: stored(spark, sf_dir, "embeddings", f"weights-{name}-{salt}", build))
    return stored(spark, sf_dir, "embeddings", f"weights-{unit}-{salt}", lambda: resample.weights(axis, unit, salt))


def _round(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c, kind in rows.dtypes if kind == "double"})


def _points(columns: dict[str, str]) -> str:
    return ", ".join(f"round(quantile_cont({e}, 0.025), 6) AS low_{c}, round(quantile_cont({e}, 0.975), 6) AS high_{c}" for c, e in columns.items()) + ", count(*) AS replicates"


_BAD, _END_BAD = f"CASE WHEN hits < {K} THEN 1.0 ELSE 0 END", f"CASE WHEN end_hits < {K} THEN 1.0 ELSE 0 END"


def _pairs(spark, sf_dir) -> DataFrame:
    cube = cube_of(spark, sf_dir)
    bad = lambda c: F.when(F.col(c) < K, 1.0).otherwise(0.0)
    return policy.directed_pairs(cube, policy.labels(cube)).select("source", "target", "query_id", bad("hits").alias("absolute"), bad("end_hits").alias("reference")).withColumn("increment", F.col("absolute") - F.col("reference"))


@query("query_bootstrap", f"""WITH {_PAIRS}, m AS (SELECT source, query_id, avg({_BAD}) AS a, avg({_END_BAD}) AS r FROM pairs GROUP BY ALL), {weights_sql('wq', 'pairs', 'query_id', 11)},
d AS (SELECT source, rep, sum(a * w) / sum(w) AS a, sum(r * w) / sum(w) AS r, sum((a - r) * w) / sum(w) AS i FROM m JOIN wq USING (query_id) GROUP BY ALL) SELECT source, {_points({'absolute': 'a', 'reference': 'r', 'increment': 'i'})} FROM d GROUP BY source""")
def query_bootstrap(spark, sf_dir):
    """Intervals of three risks that share the draw of queries."""
    rows = _pairs(spark, sf_dir)
    names = ["absolute", "reference", "increment"]
    means = rows.groupBy("source", "query_id").agg(*[F.avg(c).alias(c) for c in names])
    drawn = _drawn(spark, sf_dir, rows.select("query_id"), "query_id", 11)
    return _round(resample.interval(resample.by_query(means, drawn, ["source"], names), ["source"], names))


def _crossed_sql(rows: str, by: str, sums: dict[str, str], targets: bool = True, queries: bool = True) -> str:
    """rr (by, rep, sums) from the rows' target and query_id."""
    lead = f"{by}, " if by else ""
    wq = f"{weights_sql('wq', rows, 'query_id', 11)}, " if queries else ""
    wt = f"{weights_sql('wt', rows, 'target', 13)}, " if targets else ""
    part = f"rq AS MATERIALIZED (SELECT {lead}target, {'rep, ' if queries else ''}{', '.join(f'sum({e}{' * w' if queries else ''}) AS {c}' for c, e in sums.items())} FROM {rows} {'JOIN wq USING (query_id)' if queries else ''} GROUP BY ALL)"
    how = ("JOIN wt USING (target, rep)" if queries else "JOIN wt USING (target)") if targets else ""
    return f"{wq}{wt}{part}, rr AS (SELECT {lead}rep, {', '.join(f'sum({c}{' * w' if targets else ''}) AS {c}' for c in sums)} FROM rq {how} GROUP BY ALL)"


@query("crossed_bootstrap", f"WITH {_PAIRS}, {_crossed_sql('pairs', 'source', {'z': _BAD, 'n': '1.0'})} SELECT source, {_points({'risk': 'z / n'})} FROM rr GROUP BY source")
def crossed_bootstrap(spark, sf_dir):
    """Targets and queries are both drawn again: the bilinear form of two weight tables."""
    rows = _pairs(spark, sf_dir).withColumn("n", F.lit(1.0))
    sums = resample.crossed(rows, _drawn(spark, sf_dir, rows.select("target"), "target", 13), _drawn(spark, sf_dir, rows.select("query_id"), "query_id", 11), ["source"], ["absolute", "n"])
    return _round(resample.interval(sums.withColumn("risk", F.col("absolute") / F.col("n")), ["source"], ["risk"]))


_ARM_SUMS = {"z": _BAD, "a": "ndc", "b": "end_ndc", "n": "1.0"}


def _arm_sums(spark, sf_dir, rows: DataFrame, by: list[str], targets: bool = True, queries: bool = True) -> DataFrame:
    ready = rows.select(*by, "target", "query_id", F.when(F.col("hits") < K, 1.0).otherwise(0.0).alias("z"), F.col("ndc").alias("a"), F.col("end_ndc").alias("b"), F.lit(1.0).alias("n"))
    cube = cube_of(spark, sf_dir)
    # The axes are the design's, not those of the rows, which lack what was abstained from.
    wt = _drawn(spark, sf_dir, cube.select(F.col("build").alias("target")), "target", 13) if targets else None
    wq = _drawn(spark, sf_dir, cube.filter(policy.role() == "evaluation").select("query_id"), "query_id", 12) if queries else None
    sums = resample.crossed(ready, wt, wq, by, ["z", "a", "b", "n"])
    return sums.select(*by, "rep", (F.col("z") / F.col("n")).alias("risk"), (1 - F.col("a") / F.col("b")).alias("gain"))


def _arm_axes(sql: str) -> str:
    """The same axes in SQL: all builds, and the queries of the evaluation role."""
    sql = sql.replace(weights_sql("wq", "ev", "query_id", 11), "qe AS (SELECT query_id FROM qp WHERE role = 'evaluation'), " + weights_sql("wq", "qe", "query_id", 12))
    return sql.replace(weights_sql("wt", "ev", "target", 13), "te AS (SELECT DISTINCT build AS target FROM cube), " + weights_sql("wt", "te", "target", 13))


@query("arm_bootstrap", f"WITH {_arms_sql(True)}, {_EVAL}, {_arm_axes(_crossed_sql('ev', 'arm', _ARM_SUMS))} SELECT arm, {_points({'risk': 'z / n', 'gain': '1 - a / b'})} FROM rr GROUP BY arm")
def arm_bootstrap(spark, sf_dir):
    """Risk and the ratio of sums of every arm, under one draw of targets and queries."""
    return _round(resample.interval(_arm_sums(spark, sf_dir, _arm_rows(spark, sf_dir), ["arm"]), ["arm"], ["risk", "gain"]))


def _register_modes() -> None:
    for mode, targets, queries in (("target", True, False), ("query", False, True), ("crossed", True, True)):
        sql = f"WITH {_arms_sql(True)}, {_EVAL.replace('ev AS', 'ev_all AS')}, ev AS (SELECT * FROM ev_all WHERE arm = 'B2_SOURCE_ONE_RUNG'), {_arm_axes(_crossed_sql('ev', '', _ARM_SUMS, targets, queries))} SELECT '{mode}' AS resampling, {_points({'risk': 'z / n', 'gain': '1 - a / b'})} FROM rr"

        @query(f"resampling_{mode}", sql)
        def run(spark, sf_dir, mode=mode, targets=targets, queries=queries):
            """One arm's intervals where only targets, only queries, or both are drawn."""
            rows = _arm_rows(spark, sf_dir).filter("arm = 'B2_SOURCE_ONE_RUNG'").withColumn("resampling", F.lit(mode))
            return _round(resample.interval(_arm_sums(spark, sf_dir, rows, ["resampling"], targets, queries), ["resampling"], ["risk", "gain"]))


_register_modes()


@query("hierarchical_bootstrap", f"""WITH {_REFRESH}, ha AS (SELECT build, row_number() OVER (ORDER BY build) - 1 AS pos FROM (SELECT DISTINCT build FROM rr)), hq AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS pos FROM (SELECT DISTINCT query_id FROM rr)),
hn AS (SELECT (SELECT count(*) FROM ha) AS nb, (SELECT count(*) FROM hq) AS nq), hs AS (SELECT i // nb AS rep, i AS slot, {resample.mixed_sql('i', 17)} % nb AS pos FROM (SELECT unnest(range(0, {NESTED} * nb)) AS i, nb FROM hn)),
hw AS (SELECT rep, build, {resample.mixed_sql('id', 18)} % nq AS pos, count(*) AS w FROM (SELECT rep, build, nq, unnest(range(slot * nq, slot * nq + nq)) AS id FROM hs JOIN ha USING (pos), hn) GROUP BY ALL),
hd AS (SELECT method, rep, sum(ndc * w) AS a, sum(end_ndc * w) AS b FROM hw JOIN hq USING (pos) JOIN rr USING (build, query_id) GROUP BY ALL) SELECT method, {_points({'gain': '1 - a / b'})} FROM hd GROUP BY method""")
def hierarchical_bootstrap(spark, sf_dir):
    """Gains where builds are drawn, and queries within each drawn build."""
    rows = _refresh(spark, sf_dir).select("method", "build", "query_id", F.col("ndc").cast("double").alias("a"), F.col("end_ndc").cast("double").alias("b"))
    sums = resample.hierarchical(rows, rows.select("build"), 17, ["method"], ["a", "b"], NESTED)
    return _round(resample.interval(sums.withColumn("gain", 1 - F.col("a") / F.col("b")), ["method"], ["gain"]))


@query("state_pair_bootstrap", f"""WITH {_CUBE}, ends AS (SELECT build, query_id, hits AS eh FROM cube WHERE action_idx = {END}), st AS (SELECT c.build, c.query_id, CASE WHEN c.hits < {K} OR eh < {K} THEN 1.0 ELSE 0 END AS z FROM cube c JOIN ends USING (build, query_id) WHERE action_idx = 2),
ch AS (SELECT a.build AS target, a.query_id, b.z - a.z AS d, a.z AS z0, b.z AS z1 FROM st a JOIN st b ON b.build = a.build % 4 + 1 AND b.query_id = a.query_id), {_crossed_sql('ch', '', {'d': 'd', 'n': '1.0'})}
SELECT round((SELECT avg(z0) FROM ch), 6) AS initial, round((SELECT avg(z1) FROM ch), 6) AS refreshed, {_points({'change': 'd / n'})} FROM rr""")
def state_pair_bootstrap(spark, sf_dir):
    """The change between two states of the same pair for the same query; pairs and queries are drawn together."""
    cube = cube_of(spark, sf_dir)
    end = cube.filter(F.col("action_idx") == END).select("build", "query_id", F.col("hits").alias("eh"))
    state = cube.filter("action_idx = 2").join(end, ["build", "query_id"]).select("build", "query_id", F.when((F.col("hits") < K) | (F.col("eh") < K), 1.0).otherwise(0.0).alias("z"))
    other = state.select(F.col("build").alias("next"), "query_id", F.col("z").alias("z1"))
    change = state.withColumn("next", F.col("build") % 4 + 1).join(other, ["next", "query_id"]).select(F.col("build").alias("target"), "query_id", F.col("z").alias("z0"), "z1", (F.col("z1") - F.col("z")).alias("d"), F.lit(1.0).alias("n"))
    sums = resample.crossed(change, _drawn(spark, sf_dir, change.select("target"), "target", 13), _drawn(spark, sf_dir, change.select("query_id"), "query_id", 11), [], ["d", "n"])
    ends = resample.interval(sums.withColumn("change", F.col("d") / F.col("n")), [], ["change"])
    return _round(change.agg(F.avg("z0").alias("initial"), F.avg("z1").alias("refreshed")).crossJoin(ends))  # single rows


@query("mean_bootstrap", f"""WITH {_CUBE}, {weights_sql('wq', 'cube', 'query_id', 11)}, d AS (SELECT action_idx, rep, sum(ndc * w) / sum(w) AS m FROM cube JOIN wq USING (query_id) WHERE build = 1 GROUP BY ALL) SELECT action_idx, {_points({'mean': 'm'})} FROM d GROUP BY action_idx""")
def mean_bootstrap(spark, sf_dir):
    """Intervals of a build's mean cost at every action."""
    cube = cube_of(spark, sf_dir)
    drawn = _drawn(spark, sf_dir, cube.select("query_id"), "query_id", 11)
    means = resample.by_query(cube.filter("build = 1").select("action_idx", "query_id", F.col("ndc").cast("double").alias("mean")), drawn, ["action_idx"], ["mean"])
    return _round(resample.interval(means, ["action_idx"], ["mean"]))
