"""Queries of partitions, their objectives and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.operators import partitions, policy, search
from rungwise.operators.policy import END, N
from rungwise.operators.search import GRID, K
from rungwise.plans.catalogue import _CUBE, _HM, _INDEX, _LABELS, _OUT, _ROLE, _VEC, ALPHA, limits_sql
from rungwise.plans.registry import cube_of, query, stored, table, vecs

#: The tolerance of queries that report one only.
EPSILON = 0.20


def six(c, name: str):
    return F.round(c, 6).alias(name)


_SUMMARIES = f"""mx AS (SELECT t.build AS target, t.query_id, t.label, max(s.label) AS m FROM lab t JOIN lab s ON s.query_id = t.query_id AND s.build <> t.build GROUP BY ALL),
su AS MATERIALIZED (SELECT t.build AS target, t.query_id, t.label, 'vector' AS summary, string_agg(s.label, ',' ORDER BY s.build) AS key, NULL::INT AS ord FROM lab t JOIN lab s ON s.query_id = t.query_id AND s.build <> t.build GROUP BY ALL
  UNION ALL SELECT target, query_id, label, 'max', CAST(m AS VARCHAR), m FROM mx UNION ALL SELECT target, query_id, label, 'action', CAST(least(m, {END}) AS VARCHAR), least(m, {END}) FROM mx
  UNION ALL SELECT t.build, t.query_id, t.label, 'single:' || s.build, CAST(s.label AS VARCHAR), s.label FROM lab t JOIN lab s ON s.query_id = t.query_id AND s.build <> t.build),
sub AS (SELECT unnest(['all', 'endpoint_solvable']) AS subset), cri AS (SELECT unnest(['actual', 'stable_tail']) AS criterion)"""


def _objective_sql(by: str, rows: str) -> str:
    """jj by the columns ``by`` from ``rows``: every (query, action) of a cell with ok and ndc."""
    return f"""rw AS MATERIALIZED ({rows}),
ca AS MATERIALIZED (SELECT {by}, key, ord, action_idx, bool_and(ok) AS ok, sum(ndc) AS cost, count(*) AS n FROM rw GROUP BY ALL),
cell AS (SELECT {by}, key, min(cost) FILTER (ok) AS best, max(n) AS n FROM ca GROUP BY ALL),
js AS (SELECT {by}, CASE WHEN count(best) = count(*) THEN sum(best) / sum(n) END AS js, CAST(sum(n) AS BIGINT) AS n_query, count(*) - count(best) AS infeasible_cells, CAST(coalesce(sum(n) FILTER (best IS NULL), 0) AS BIGINT) AS bad_queries FROM cell GROUP BY ALL),
ji AS (SELECT {by}, CASE WHEN count(c) = count(*) THEN avg(c) END AS ji, count(*) - count(c) AS alone FROM (SELECT {by}, query_id, min(ndc) FILTER (ok) AS c FROM rw GROUP BY ALL) GROUP BY ALL),
ro AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY ord) AS i, list(CASE WHEN ok THEN CAST(cost AS DOUBLE) ELSE 'Infinity'::DOUBLE END ORDER BY action_idx) AS c FROM ca WHERE ord IS NOT NULL GROUP BY {by}, ord),
fold AS (SELECT {by}, i, c AS best FROM ro WHERE i = 1 UNION ALL
  SELECT {', '.join('r.' + c for c in by.split(', '))}, r.i, list_transform(range(1, {N + 1}), lambda a: r.c[a] + list_min(f.best[1:a])) FROM fold f JOIN ro r ON {' AND '.join(f'r.{c} = f.{c}' for c in by.split(', '))} AND r.i = f.i + 1),
jo AS (SELECT {by}, list_min(best) AS jo FROM fold QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY i DESC) = 1),
jj AS (SELECT *, CASE WHEN infeasible_cells = 0 AND isfinite(jo) THEN jo / n_query END AS jr FROM js JOIN ji USING ({by}) LEFT JOIN jo USING ({by}))"""


_BY = "target, subset, summary, criterion"
_PANEL = f"""{_LABELS}, {_SUMMARIES}, {_objective_sql(_BY, f'''SELECT u.target, subset, summary, criterion, key, ord, u.query_id, c.action_idx, c.ndc, CASE criterion WHEN 'actual' THEN c.hits = {K} ELSE c.action_idx >= u.label END AS ok
  FROM su u JOIN cube c ON c.build = u.target AND c.query_id = u.query_id, sub, cri WHERE subset = 'all' OR u.label < {N}''')}"""


def _panel(spark, sf_dir) -> DataFrame:
    def build() -> DataFrame:
        cube = cube_of(spark, sf_dir)
        labelled = policy.labels(cube)
        own = labelled.select(F.col("build").alias("target"), "query_id", "label")
        keys = partitions.subsets(partitions.summaries(labelled).join(own, ["target", "query_id"]), F.col("label") < N).drop("label")
        return partitions.objectives(keys, partitions.choices(cube, labelled), ("target", "subset", "summary", "criterion"))

    return stored(spark, sf_dir, "embeddings", "objective-panel", build)


@query("objective_panel", f"""WITH RECURSIVE {_PANEL} SELECT {_BY}, n_query, round(ji, 6) AS j_identity, round(js, 6) AS j_summary, round(jr, 6) AS j_order, round(js - ji, 6) AS information_gap, round(jr - js, 6) AS order_gap,
  alone AS individually_infeasible, infeasible_cells, bad_queries AS queries_in_infeasible_cells FROM jj""")
def objective_panel(spark, sf_dir):
    """Every summary, subset and criterion, with what is infeasible."""
    p = _panel(spark, sf_dir)
    return p.select("target", "subset", "summary", "criterion", "n_query", *[six(c, c) for c in ("j_identity", "j_summary", "j_order", "information_gap", "order_gap")], "individually_infeasible", "infeasible_cells", "queries_in_infeasible_cells")


@query("objective_aggregate", f"""WITH RECURSIVE {_PANEL} SELECT subset, summary, criterion, count(*) AS targets, count(js) AS feasible_targets, round(CASE WHEN count(ji) = count(*) THEN avg(ji) END, 6) AS j_identity,
  round(CASE WHEN count(js) = count(*) THEN avg(js) END, 6) AS j_summary, round(CASE WHEN count(jr) = count(*) THEN avg(jr) END, 6) AS j_order FROM jj WHERE summary IN ('vector', 'max', 'action') GROUP BY ALL""")
def objective_aggregate(spark, sf_dir):
    """Means over targets, each of one weight; NULL if a target has none."""
    mean = lambda c: six(F.when(F.count(c) == F.count("*"), F.avg(c)), c)
    rows = _panel(spark, sf_dir).filter("summary IN ('vector', 'max', 'action')")
    return rows.groupBy("subset", "summary", "criterion").agg(F.count("*").alias("targets"), F.count("j_summary").alias("feasible_targets"), mean("j_identity"), mean("j_summary"), mean("j_order"))


@query("objective_dominance", f"""WITH RECURSIVE {_PANEL} SELECT target, criterion, count(*) FILTER (js - ji < -1e-8 OR jr - js < -1e-8) AS negative_gaps, coalesce(bool_and(v.js <= j.js + 1e-8), true) AS vector_is_least
  FROM (SELECT * FROM jj WHERE subset = 'endpoint_solvable') j JOIN (SELECT target, criterion, js FROM jj WHERE subset = 'endpoint_solvable' AND summary = 'vector') v USING (target, criterion) GROUP BY ALL""".replace("js - ji < -1e-8 OR jr - js", "j.js - ji < -1e-8 OR jr - j.js"))
def objective_dominance(spark, sf_dir):
    """What must hold of any panel: no gap below zero, and the finest summary costs least."""
    rows = _panel(spark, sf_dir).filter("subset = 'endpoint_solvable'")
    finest = rows.filter("summary = 'vector'").select("target", "criterion", F.col("j_summary").alias("v"))
    negative = (F.col("information_gap") < -1e-8) | (F.col("order_gap") < -1e-8)
    return rows.join(finest, ["target", "criterion"]).groupBy("target", "criterion").agg(F.count(F.when(negative, 1)).alias("negative_gaps"), F.coalesce(F.bool_and(F.col("v") <= F.col("j_summary") + 1e-8), F.lit(True)).alias("vector_is_least"))


@query("coverage_panel", f"""WITH {_LABELS}, {_SUMMARIES}, c AS (SELECT target, subset, summary, key, count(*) AS n, count(DISTINCT label) AS k, count(DISTINCT label) FILTER (label < {N}) AS f, bool_or(label = {N}) AS e FROM su, sub WHERE subset = 'all' OR label < {N} GROUP BY ALL)
SELECT target, subset, summary, CAST(sum(n) AS BIGINT) AS n_query, count(*) AS n_cell, max(n) AS max_cell_size, CAST(coalesce(sum(n) FILTER (n = 1), 0) AS BIGINT) AS singleton, CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS mixed, count(*) FILTER (k > 1) AS mixed_cells,
  CAST(coalesce(sum(n) FILTER (f > 1), 0) AS BIGINT) AS finite_mixed, CAST(coalesce(sum(n) FILTER (f > 0 AND e), 0) AS BIGINT) AS finite_endless_mixed, CAST(coalesce(sum(n) FILTER (f = 0), 0) AS BIGINT) AS all_endless FROM c GROUP BY ALL""")
def coverage_panel(spark, sf_dir):
    labelled = policy.labels(cube_of(spark, sf_dir))
    own = labelled.select(F.col("build").alias("target"), "query_id", "label")
    keys = partitions.subsets(partitions.summaries(labelled).join(own, ["target", "query_id"]), F.col("label") < N)
    return partitions.coverage(keys, ("target", "subset", "summary"))


_GRID_AT = f"{list(GRID)}[{{0}} + 1]"


@query("budgets", f"""WITH {_LABELS}, {_SUMMARIES}, c AS (SELECT target, summary, key, ord, count(*) AS n, max(label) AS top, sum(label) AS own, sum({_GRID_AT.format('label')}) AS ob FROM su WHERE label < {N} GROUP BY ALL),
r AS (SELECT *, CASE WHEN ord IS NOT NULL THEN max(top) OVER (PARTITION BY target, summary ORDER BY ord) END AS run FROM c)
SELECT target, summary, CAST(sum(n) AS BIGINT) AS n_query, round(sum(ob) / sum(n), 6) AS mean_individual_budget, round(sum(n * {_GRID_AT.format('top')}) / sum(n), 6) AS mean_common_budget, round(sum(n * {_GRID_AT.format('run')}) / sum(n), 6) AS mean_ordered_budget,
  round((sum(n * top) - sum(own)) / sum(n), 6) AS mean_rank_gap, round(sum(n * (run - top)) / sum(n), 6) AS mean_order_rank_gap FROM r GROUP BY ALL""")
def budgets(spark, sf_dir):
    labelled = policy.labels(cube_of(spark, sf_dir))
    own = labelled.select(F.col("build").alias("target"), "query_id", "label").filter(F.col("label") < N)
    b = partitions.budgets(partitions.summaries(labelled).join(own, ["target", "query_id"]))
    return b.select("target", "summary", "n_query", *[six(c, c) for c in b.columns[3:]])


_LOCK = f"""{_OUT}, cc AS (SELECT target, count(*) AS n, count(*) FILTER (hits < {K} OR end_hits < {K}) AS cf, count(*) FILTER (end_hits < {K}) AS ef FROM outc WHERE role = 'certification' GROUP BY target), {limits_sql('cc', {'full': ALPHA}, (EPSILON,))},
locked AS (SELECT target, CASE WHEN ef > most THEN 'UNDEPLOYABLE' WHEN cf <= most THEN 'CANDIDATE' ELSE 'ENDPOINT' END AS decision FROM cc JOIN lim ON lim.n = cc.n)"""


@query("policy_bridge", f"""WITH {_LOCK}, p AS (SELECT h.target, h.query_id, label, decision, unnest(['candidate', 'locked']) AS policy, unnest([least(source_max, {END}), CASE WHEN decision = 'CANDIDATE' THEN least(source_max, {END}) ELSE {END} END]) AS a
  FROM hm h JOIN lab l ON l.build = h.target AND l.query_id = h.query_id JOIN locked k ON k.target = h.target WHERE {_ROLE.replace('query_id', 'h.query_id')} = 'evaluation')
SELECT p.target, policy, decision, count(*) AS n_query, count(*) FILTER (hits < {K}) AS failures, count(*) FILTER (a < label) AS tail_violations, round(avg({_GRID_AT.format('a')}), 6) AS mean_budget, round(avg(ndc), 6) AS mean_ndc, NOT bool_or(hits < {K}) AS zero_failure, NOT bool_or(a < label) AS zero_violation
FROM p JOIN cube c ON c.build = p.target AND c.query_id = p.query_id AND c.action_idx = a GROUP BY ALL""")
def policy_bridge(spark, sf_dir):
    cube = cube_of(spark, sf_dir)
    b = partitions.bridge(cube, policy.labels(cube), policy.certify(cube, ALPHA, (EPSILON,)), policy.role())
    return b.withColumns({c: F.round(c, 6) for c in ("mean_budget", "mean_ndc")})


@query("envelope_zero_cost", f"""WITH {_LABELS}, c AS (SELECT s.build AS source, t.build AS target, s.label AS cell, t.label, count(*) AS n FROM lab s JOIN lab t ON s.query_id = t.query_id AND s.build <> t.build GROUP BY ALL),
e AS (SELECT source, target, cell, count(*) AS k, sum(n) AS n, arg_max(n, label) AS same FROM c GROUP BY ALL)
SELECT source, target, count(*) AS cells, count(*) FILTER (k > 1) AS mixed_cells, CAST(sum(same) AS BIGINT) AS identical, sum(same) = sum(n) AS zero_cost FROM e GROUP BY ALL""")
def envelope_zero_cost(spark, sf_dir):
    return partitions.envelopes(policy.labels(cube_of(spark, sf_dir)))


@query("learned_mapping", f"""WITH {_LABELS}, {_SUMMARIES}, r AS (SELECT u.target, summary, key, u.query_id, {_ROLE.replace('query_id', 'u.query_id')} AS role, c.action_idx, c.hits, c.ndc FROM su u JOIN cube c ON c.build = u.target AND c.query_id = u.query_id WHERE summary IN ('vector', 'max')),
s AS (SELECT target, summary, key, action_idx, avg(ndc) AS cost FROM r WHERE role = 'design' GROUP BY ALL HAVING count(*) >= 5 AND bool_and(hits = {K})),
m AS (SELECT target, summary, key, action_idx AS a FROM s QUALIFY row_number() OVER (PARTITION BY target, summary, key ORDER BY cost, action_idx) = 1)
SELECT r.target, r.summary AS mapping, count(*) AS n, count(a) AS mapped, count(*) FILTER (hits < {K}) AS failures, round(avg(ndc), 6) AS mean_ndc FROM r LEFT JOIN m ON m.target = r.target AND m.summary = r.summary AND m.key = r.key WHERE role = 'evaluation' AND action_idx = coalesce(a, {END}) GROUP BY ALL""")
def learned_mapping(spark, sf_dir):
    cube = cube_of(spark, sf_dir)
    return partitions.learned_mapping(cube, policy.labels(cube), policy.role()).withColumn("mean_ndc", F.round("mean_ndc", 6))


# --- ties: hits by id, or by any vector as near as the last true one ---------------------------------------

_TIES = f"""{_VEC}, z AS (SELECT vec_id, list_transform(e, lambda x: CAST(round(x * 2) AS BIGINT)) AS z FROM vec),
zd AS MATERIALIZED (SELECT a.vec_id AS query_id, b.vec_id AS base_id, CAST(list_sum(list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM z a, z b WHERE a.vec_id <> b.vec_id),
zt AS (SELECT query_id, base_id, d FROM zd QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, base_id) <= {K}),
zb AS (SELECT query_id, max(d) AS boundary FROM zt GROUP BY query_id),
zn AS MATERIALIZED (SELECT query_id, base_id, 1 AS canonical FROM zt UNION ALL SELECT query_id, base_id, 0 FROM zd JOIN zb USING (query_id) WHERE d <= boundary), {_INDEX},
sizes AS (SELECT build, list, count(*) AS size FROM assigned GROUP BY ALL),
grid AS (SELECT unnest(range(0, {N})) AS action_idx, unnest({list(GRID)}) AS nprobe),
cost AS (SELECT o.build, action_idx, o.vec_id AS query_id, CAST({search.LISTS} + coalesce(sum(size), 0) AS BIGINT) AS ndc FROM ord o JOIN grid ON rank <= nprobe LEFT JOIN sizes s ON o.build = s.build AND o.list = s.list GROUP BY ALL),
got AS (SELECT a.build, action_idx, k.query_id, count(*) FILTER (canonical = 1) AS h0, least({K}, count(*) FILTER (canonical = 0)) AS h1 FROM zn k JOIN assigned a ON a.vec_id = k.base_id JOIN ord o ON o.build = a.build AND o.vec_id = k.query_id AND o.list = a.list JOIN grid ON o.rank <= nprobe GROUP BY ALL),
both_hits AS MATERIALIZED (SELECT build, action_idx, query_id, coalesce(h0, 0) AS h0, coalesce(h1, 0) AS h1, ndc FROM cost LEFT JOIN got USING (build, action_idx, query_id)),
modes(mode, hs, ht) AS (VALUES ('canonical', 0, 0), ('target_ties', 0, 1), ('joint_ties', 1, 1)),
tl AS (SELECT v, build, query_id, coalesce(max(action_idx) FILTER (CASE v WHEN 0 THEN h0 ELSE h1 END <> {K}) + 1, 0) AS label FROM both_hits, (SELECT unnest([0, 1]) AS v) GROUP BY ALL),
sv AS (SELECT v, t.build AS target, t.query_id, string_agg(s.label, ',' ORDER BY s.build) AS vec_key, max(s.label) AS m FROM tl t JOIN tl s USING (v, query_id) WHERE s.build <> t.build GROUP BY ALL)"""


@query("tie_mode_objectives", f"""WITH RECURSIVE {_TIES}, kk AS (SELECT mode, target, query_id, ht, unnest(['identity', 'vector', 'max']) AS summary, unnest([CAST(query_id AS VARCHAR), vec_key, CAST(m AS VARCHAR)]) AS key, unnest([NULL, NULL, m]) AS ord FROM modes JOIN sv ON v = hs),
{_objective_sql('mode, target, subset, summary, criterion', f'''SELECT mode, kk.target, subset, summary, criterion, key, ord, kk.query_id, b.action_idx, b.ndc, CASE criterion WHEN 'actual' THEN CASE ht WHEN 0 THEN h0 ELSE h1 END = {K} ELSE b.action_idx >= l.label END AS ok
  FROM kk JOIN both_hits b ON b.build = kk.target AND b.query_id = kk.query_id JOIN tl l ON l.v = ht AND l.build = kk.target AND l.query_id = kk.query_id JOIN tl l0 ON l0.v = 0 AND l0.build = kk.target AND l0.query_id = kk.query_id,
  (SELECT unnest(['all', 'original_endpoint']) AS subset), (SELECT unnest(['actual', 'stable_tail']) AS criterion) WHERE subset = 'all' OR l0.label < {N}''')}
SELECT mode, target, subset, summary, criterion, n_query, infeasible_cells AS empty_cells, round(js, 6) AS mean_cost, round(jr, 6) AS mean_ordered_cost FROM jj""")
def tie_mode_objectives(spark, sf_dir):
    """Objectives with labels and safety by id, by ties on the target's side, or by ties on both."""
    base = vecs(spark, sf_dir)
    z = base.select("vec_id", F.transform("e", lambda x: F.round(x * 2)).alias("e"))  # whole numbers: distances tie exactly
    near = stored(spark, sf_dir, "embeddings", "tie-neighbours", lambda: search.exact_knn(z, z))
    makers = (lambda: search.response_cube(base, near), lambda: search.tied_cube(base, z, near))
    cubes = [stored(spark, sf_dir, "embeddings", f"tie-cube-{i}", make) for i, make in enumerate(makers)]
    solvable = policy.labels(cubes[0]).filter(F.col("label") < N).select(F.col("build").alias("target"), "query_id", F.lit(True).alias("solvable"))
    out = None
    for mode, s, t in (("canonical", 0, 0), ("target_ties", 0, 1), ("joint_ties", 1, 1)):
        keys = partitions.summaries(policy.labels(cubes[s])).filter("summary IN ('vector', 'max')")
        alone = keys.filter("summary = 'max'").select("target", "query_id", F.lit("identity").alias("summary"), F.col("query_id").cast("string").alias("key"), F.lit(None).cast("int").alias("ord"))
        keys = partitions.subsets(keys.unionByName(alone).join(solvable.hint("merge"), ["target", "query_id"], "left"), F.coalesce("solvable", F.lit(False))).drop("solvable")
        keys = keys.withColumn("subset", F.when(F.col("subset") == "all", "all").otherwise("original_endpoint"))
        done = partitions.objectives(keys, partitions.choices(cubes[t], policy.labels(cubes[t])), ("target", "subset", "summary", "criterion")).withColumn("mode", F.lit(mode))
        out = done if out is None else out.unionByName(done)
    return out.select("mode", "target", "subset", "summary", "criterion", "n_query", F.col("infeasible_cells").alias("empty_cells"), six("j_summary", "mean_cost"), six("j_order", "mean_ordered_cost"))
