"""Every registered query of the engine, and the SQL it is checked against.

Each query reads whole tables of a directory; floats are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rungwise.functions import distance as D
from rungwise.operators import graph, ledger, policy, quantize, search, stats
from rungwise.operators.policy import END, N
from rungwise.operators.search import GRID, K, LISTS
from rungwise.plans.registry import ORACLE_SQL, QUERIES, cube_of, knn_of, query, table, vecs
from rungwise.streaming import monitor

__all__ = ["ORACLE_SQL", "QUERIES"]

_VEC = "vec AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"


def _knn_sql(metric: str, where: str = "true", k: int = K) -> str:
    _, f, larger = D.METRICS[metric]
    return f"""{_VEC}, scored AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, {f} AS score FROM vec a, vec b WHERE a.vec_id <> b.vec_id AND {where}),
knn AS MATERIALIZED (SELECT query_id, base_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score {'DESC' if larger else 'ASC'}, base_id) AS rank FROM scored QUALIFY rank <= {k})"""


def _register_knn(metric: str, name: str) -> None:
    @query(name, f"WITH {_knn_sql(metric)} SELECT query_id, CAST(rank AS INT) AS rank, base_id, round(score, 6) AS score FROM knn")
    def run(spark, sf_dir):
        base = vecs(spark, sf_dir)
        return search.exact_knn(base, base, K, metric).withColumn("score", F.round("score", 6))


for _metric, _name in (("l2", "exact_knn_l2"), ("ip", "exact_knn_ip"), ("cosine", "exact_knn_cosine"), ("angular", "exact_knn_angular"), ("l2_norm_form", "knn_l2_norm_form"), ("l1", "knn_l1"), ("linf", "knn_linf"), ("lp3", "knn_lp3"), ("canberra", "knn_canberra"), ("braycurtis", "knn_braycurtis"), ("jaccard", "knn_jaccard"), ("jensen_shannon", "knn_jensen_shannon"), ("hamming", "hamming_knn")):
    _register_knn(_metric, _name)


@query("exact_knn_blocked", f"WITH {_knn_sql('l2')} SELECT query_id, CAST(rank AS INT) AS rank, base_id, round(score, 6) AS score FROM knn")
def exact_knn_blocked(spark, sf_dir):
    """The same with both sides packed into blocks, as for queries that no task can hold whole."""
    base = vecs(spark, sf_dir)
    found = search.paired(base, base, lambda *x: search._nearest("l2", K, *x, False), "query_id long, base_id long, score double", True)
    return search.top_k(found, K).select("query_id", "rank", "base_id", F.round("score", 6).alias("score"))


@query("range_search_l2", f"WITH {_VEC} SELECT a.vec_id AS query_id, b.vec_id AS base_id, round({D.METRICS['l2'][1]}, 6) AS score FROM vec a, vec b WHERE a.vec_id <> b.vec_id AND {D.METRICS['l2'][1]} < 1.2")
def range_search_l2(spark, sf_dir):
    base = vecs(spark, sf_dir)
    return search.range_search(base, base, 1.2).withColumn("score", F.round("score", 6))


@query("filtered_knn", f"WITH {_knn_sql('l2', '(b.label IN (1, 3, 5) AND b.vec_id % 7 <> 0)')} SELECT query_id, CAST(rank AS INT) AS rank, base_id, round(score, 6) AS score FROM knn")
def filtered_knn(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    allowed = search.vectors(rows.filter(F.col("label").isin(1, 3, 5) & (F.col("vec_id") % 7 != 0)))
    return search.exact_knn(allowed, search.vectors(rows)).withColumn("score", F.round("score", 6))


_PREFIX = "list_sum(list_transform(list_zip(a.e[1:16], b.e[1:16]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query("refined_knn", f"""WITH {_VEC}, c AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, {D.METRICS['l2'][1]} AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {_PREFIX}, b.vec_id) AS r FROM vec a, vec b WHERE a.vec_id <> b.vec_id QUALIFY r <= {4 * K})
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, base_id) AS INT) AS rank, base_id, round(score, 6) AS score FROM c QUALIFY rank <= {K}""")
def refined_knn(spark, sf_dir):
    base = vecs(spark, sf_dir)
    return search.refined_knn(base, base).withColumn("score", F.round("score", 6))


# --- the response cube ----------------------------------------------------------------------------------

_L2C = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_INDEX = f"""cents AS (SELECT build, vec_id AS list, e FROM (SELECT build, vec_id, e, row_number() OVER (PARTITION BY build ORDER BY (vec_id % 1000003 * 2654435761 + build * 40503 * (vec_id % 1000003 + 7)) % 1000003, vec_id) AS r
  FROM vec, (SELECT unnest([1, 2, 3, 4]) AS build)) WHERE r <= {LISTS}),
ord AS MATERIALIZED (SELECT build, v.vec_id, list, row_number() OVER (PARTITION BY build, v.vec_id ORDER BY {_L2C}, list) AS rank FROM vec v, cents c),
assigned AS (SELECT build, vec_id, list FROM ord WHERE rank = 1)"""
_CUBE = f"""{_knn_sql('l2')}, {_INDEX},
sizes AS (SELECT build, list, count(*) AS size FROM assigned GROUP BY ALL),
grid AS (SELECT unnest(range(0, {N})) AS action_idx, unnest({list(GRID)}) AS nprobe),
cost AS (SELECT o.build, action_idx, o.vec_id AS query_id, {LISTS} + coalesce(sum(size), 0) AS ndc FROM ord o JOIN grid ON rank <= nprobe LEFT JOIN sizes s ON o.build = s.build AND o.list = s.list GROUP BY ALL),
hit AS (SELECT a.build, action_idx, k.query_id, count(*) AS hits FROM knn k JOIN assigned a ON a.vec_id = k.base_id JOIN ord o ON o.build = a.build AND o.vec_id = k.query_id AND o.list = a.list JOIN grid ON o.rank <= nprobe GROUP BY ALL),
cube AS MATERIALIZED (SELECT build, CAST(action_idx AS INT) AS action_idx, query_id, CAST(coalesce(hits, 0) AS BIGINT) AS hits, CAST(ndc AS BIGINT) AS ndc FROM cost LEFT JOIN hit USING (build, action_idx, query_id))"""
_LABELS = f"{_CUBE}, lab AS MATERIALIZED (SELECT build, query_id, coalesce(max(action_idx) FILTER (hits <> {K}) + 1, 0) AS label, min(action_idx) FILTER (hits = {K}) AS first_pass FROM cube GROUP BY ALL)"
_HM = f"{_LABELS}, hm AS MATERIALIZED (SELECT t.build AS target, t.query_id, max(s.label) AS source_max FROM lab t JOIN lab s ON s.query_id = t.query_id AND s.build <> t.build GROUP BY ALL)"


@query("assign_centroid", f"WITH {_VEC}, {_INDEX} SELECT * FROM assigned")
def assign_centroid(spark, sf_dir):
    base = vecs(spark, sf_dir)
    return search.probe_order(base, search.centroids(base)).filter("rank = 1").select("build", "vec_id", "list")


@query("list_imbalance", f"WITH {_VEC}, {_INDEX}, s AS (SELECT build, list, count(*) AS n FROM assigned GROUP BY ALL) SELECT build, round(count(*) * sum(n * n) / pow(sum(n), 2), 6) AS imbalance FROM s GROUP BY build")
def list_imbalance(spark, sf_dir):
    n = assign_centroid(spark, sf_dir).groupBy("build", "list").agg(F.count("*").alias("n"))
    return n.groupBy("build").agg(F.round(F.count("*") * F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2)), 6).alias("imbalance"))


@query("ivf_probe_sweep", f"WITH {_CUBE} SELECT * FROM cube")
def ivf_probe_sweep(spark, sf_dir):
    return cube_of(spark, sf_dir)


@query("recall_by_action", f"WITH {_CUBE} SELECT build, action_idx, round(avg(hits / {K}.0), 6) AS recall, count(*) FILTER (hits <> {K}) AS failures, round(avg(ndc), 6) AS mean_ndc FROM cube GROUP BY ALL")
def recall_by_action(spark, sf_dir):
    return cube_of(spark, sf_dir).groupBy("build", "action_idx").agg(F.round(F.avg(F.col("hits") / K), 6).alias("recall"), F.count(F.when(~policy.safe(), 1)).alias("failures"), F.round(F.avg("ndc"), 6).alias("mean_ndc"))


@query("hit_threshold_sweep", f"WITH {_CUBE} SELECT build, action_idx, h AS threshold, count(*) FILTER (hits < h) AS failures FROM cube, (SELECT unnest([3, 4, 5]) AS h) GROUP BY ALL")
def hit_threshold_sweep(spark, sf_dir):
    each = cube_of(spark, sf_dir).withColumn("threshold", F.explode(F.array(F.lit(3), F.lit(4), F.lit(5))))
    return each.groupBy("build", "action_idx", "threshold").agg(F.count(F.when(F.col("hits") < F.col("threshold"), 1)).alias("failures"))


@query("pareto_frontier", f"""WITH {_CUBE}, p AS (SELECT build, action_idx, avg(ndc) AS cost, avg(hits) AS perf FROM cube GROUP BY ALL),
r AS (SELECT *, max(perf) OVER (PARTITION BY build ORDER BY cost, action_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p)
SELECT build, action_idx, round(cost, 6) AS cost, round(perf, 6) AS perf FROM r WHERE best IS NULL OR perf > best""")
def pareto_frontier(spark, sf_dir):
    p = cube_of(spark, sf_dir).groupBy("build", "action_idx").agg(F.avg("ndc").alias("cost"), F.avg("hits").alias("perf"))
    w = Window.partitionBy("build").orderBy("cost", "action_idx").rowsBetween(Window.unboundedPreceding, -1)
    r = p.withColumn("best", F.max("perf").over(w)).filter("best IS NULL OR perf > best")
    return r.select("build", "action_idx", F.round("cost", 6).alias("cost"), F.round("perf", 6).alias("perf"))


@query("stable_tail_label", f"WITH {_LABELS} SELECT build, query_id, CAST(label AS INT) AS label, first_pass FROM lab")
def stable_tail_label(spark, sf_dir):
    return policy.labels(cube_of(spark, sf_dir))


@query("history_max_candidate", f"WITH {_HM} SELECT target, query_id, CAST(source_max AS INT) AS source_max FROM hm")
def history_max_candidate(spark, sf_dir):
    return policy.history_max(policy.labels(cube_of(spark, sf_dir)))


_PAIRS = f"""{_LABELS}, pairs AS MATERIALIZED (SELECT s.build AS source, c.build AS target, s.query_id, s.label, c.hits, c.ndc, e.hits AS end_hits
  FROM lab s JOIN cube c ON c.query_id = s.query_id AND c.action_idx = least(s.label, {END}) AND c.build <> s.build JOIN cube e ON e.build = c.build AND e.query_id = c.query_id AND e.action_idx = {END})"""


@query("directed_pair_risk", f"""WITH {_PAIRS} SELECT source, target, count(*) AS n, round(avg(CASE WHEN hits < {K} THEN 1.0 ELSE 0 END), 6) AS absolute_risk, round(avg(CASE WHEN end_hits < {K} THEN 1.0 ELSE 0 END), 6) AS reference_risk,
  round(avg(CASE WHEN hits < {K} AND end_hits >= {K} THEN 1.0 ELSE 0 END), 6) AS incremental_risk FROM pairs GROUP BY ALL""")
def directed_pair_risk(spark, sf_dir):
    cube = cube_of(spark, sf_dir)
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    bad, end_bad = F.col("hits") < K, F.col("end_hits") < K
    return policy.directed_pairs(cube, policy.labels(cube)).groupBy("source", "target").agg(F.count("*").alias("n"), rate(bad).alias("absolute_risk"), rate(end_bad).alias("reference_risk"), rate(bad & ~end_bad).alias("incremental_risk"))


@query("finite_variation", f"WITH {_LABELS} SELECT query_id, max(label) - min(label) AS spread, count(DISTINCT label) FILTER (label < {N}) AS finite_labels, count(*) FILTER (label = {N}) AS unresolved FROM lab GROUP BY ALL")
def finite_variation(spark, sf_dir):
    return policy.labels(cube_of(spark, sf_dir)).groupBy("query_id").agg((F.max("label") - F.min("label")).alias("spread"), F.countDistinct(F.when(F.col("label") < N, F.col("label"))).alias("finite_labels"), F.count(F.when(F.col("label") == N, 1)).alias("unresolved"))


@query("mixed_cell_pairs", f"WITH {_LABELS}, c AS (SELECT s.build AS source, t.build AS target, s.label, count(DISTINCT t.label) AS k, count(*) AS n FROM lab s JOIN lab t ON s.query_id = t.query_id AND s.build <> t.build GROUP BY ALL) SELECT source, target, count(*) AS cells, count(*) FILTER (k > 1) AS mixed_cells, CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS mixed_queries FROM c GROUP BY ALL")
def mixed_cell_pairs(spark, sf_dir):
    lab = policy.labels(cube_of(spark, sf_dir)).select("build", "query_id", "label")
    both = lab.alias("s").join(lab.alias("t"), (F.col("s.query_id") == F.col("t.query_id")) & (F.col("s.build") != F.col("t.build")))
    c = both.groupBy(F.col("s.build").alias("source"), F.col("t.build").alias("target"), F.col("s.label").alias("label")).agg(F.countDistinct("t.label").alias("k"), F.count("*").alias("n"))
    return c.groupBy("source", "target").agg(F.count("*").alias("cells"), F.count(F.when(F.col("k") > 1, 1)).alias("mixed_cells"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("n"))), F.lit(0)).alias("mixed_queries"))


# --- qualification and decisions --------------------------------------------------------------------------

EPSILONS, ALPHA = (0.05, 0.10, 0.20, 0.35), 0.05
_ROLE = "CASE query_id % 5 WHEN 0 THEN 'design' WHEN 1 THEN 'selection' WHEN 2 THEN 'certification' ELSE 'evaluation' END"


def limits_sql(counted: str, alphas: dict[str, float], epsilons=EPSILONS) -> str:
    """lim (n, epsilon, alpha, most) by the binomial sum in SQL, for the sizes n of ``counted``."""
    levels = ", ".join(f"('{name}', {a!r}::DOUBLE)" for name, a in alphas.items())
    return f"""lim_n AS (SELECT DISTINCT n FROM {counted}), lim_a(alpha, level) AS (VALUES {levels}), lim_e AS (SELECT unnest({list(epsilons)}::DOUBLE[]) AS epsilon),
lim_p AS (SELECT n, epsilon, f, exp(lgamma(n + 1) - lgamma(f + 1) - lgamma(n - f + 1) + f * ln(epsilon) + (n - f) * ln(1 - epsilon)) AS p FROM (SELECT n, unnest(range(0, n)) AS f FROM lim_n), lim_e),
lim_c AS (SELECT n, epsilon, f, sum(p) OVER (PARTITION BY n, epsilon ORDER BY f) AS c FROM lim_p),
lim AS MATERIALIZED (SELECT n, epsilon, alpha, coalesce(max(f) FILTER (c <= level), -1) AS most FROM lim_c, lim_a GROUP BY ALL)"""


_OUT = f"""{_HM}, outc AS MATERIALIZED (SELECT h.target, h.query_id, {_ROLE.replace('query_id', 'h.query_id')} AS role, h.source_max = {N} AS bottom, c.hits, c.ndc, e.hits AS end_hits, e.ndc AS end_ndc FROM hm h
  JOIN cube c ON c.build = h.target AND c.query_id = h.query_id AND c.action_idx = least(h.source_max, {END}) JOIN cube e ON e.build = h.target AND e.query_id = h.query_id AND e.action_idx = {END})"""
_CERT = f"""{_OUT}, cc AS (SELECT target, count(*) AS n, count(*) FILTER (hits < {K} OR end_hits < {K}) AS candidate_failures, count(*) FILTER (end_hits < {K}) AS endpoint_failures, count(*) FILTER (bottom) AS abstentions FROM outc WHERE role = 'certification' GROUP BY target),
{limits_sql('cc', {'full': ALPHA})},
locked AS (SELECT epsilon, target, cc.n, candidate_failures, endpoint_failures, abstentions, CASE WHEN endpoint_failures > most THEN 'UNDEPLOYABLE' WHEN candidate_failures <= most THEN 'CANDIDATE' ELSE 'ENDPOINT' END AS decision FROM cc JOIN lim ON cc.n = lim.n AND alpha = 'full')"""


@query("certify_history_max", f"WITH {_CERT} SELECT epsilon, target, n, candidate_failures, endpoint_failures, abstentions, decision FROM locked")
def certify_history_max(spark, sf_dir):
    return policy.certify(cube_of(spark, sf_dir), ALPHA, EPSILONS)


@query("evaluate_locked", f"""WITH {_CERT} SELECT epsilon, o.target, decision, count(*) AS n,
  count(*) FILTER ((decision = 'CANDIDATE' AND hits < {K}) OR (decision = 'ENDPOINT' AND end_hits < {K})) AS failures, round(avg(CASE decision WHEN 'CANDIDATE' THEN ndc WHEN 'ENDPOINT' THEN end_ndc END), 6) AS mean_ndc
  FROM outc o JOIN locked l ON o.target = l.target WHERE role = 'evaluation' GROUP BY ALL""")
def evaluate_locked(spark, sf_dir):
    cube = cube_of(spark, sf_dir)
    return policy.evaluate(cube, policy.certify(cube, ALPHA, EPSILONS))


_BY_ROLE = f"""ends AS (SELECT build, query_id, hits <> {K} AS bad, ndc AS end_ndc FROM cube WHERE action_idx = {END}),
br AS MATERIALIZED (SELECT {_ROLE} AS role, build, action_idx, count(*) AS n, count(*) FILTER (hits <> {K}) AS f, count(*) FILTER (hits <> {K} OR bad) AS fa, avg(ndc) AS cost FROM cube JOIN ends USING (build, query_id) GROUP BY ALL)"""
_JUDGED = f"{_CUBE}, {_BY_ROLE}, {limits_sql('br', {'each': ALPHA / N, 'half': ALPHA / 2})}"


@query("target_global_decision", f"""WITH {_JUDGED},
  ch AS (SELECT epsilon, build, action_idx FROM br JOIN lim ON br.n = lim.n AND alpha = 'each' AND f <= most WHERE role = 'selection' QUALIFY row_number() OVER (PARTITION BY epsilon, build ORDER BY cost, action_idx) = 1),
  ce AS (SELECT epsilon, build, action_idx, f <= most AS ok FROM br JOIN lim ON br.n = lim.n AND alpha = 'half' WHERE role = 'certification')
  SELECT e.epsilon, e.build AS target, ch.action_idx, CASE WHEN NOT e.ok THEN 'UNDEPLOYABLE' WHEN c.ok THEN 'CANDIDATE' ELSE 'ENDPOINT' END AS decision
  FROM ce e LEFT JOIN ch ON ch.epsilon = e.epsilon AND ch.build = e.build LEFT JOIN ce c ON c.epsilon = e.epsilon AND c.build = e.build AND c.action_idx = ch.action_idx WHERE e.action_idx = {END}""")
def target_global_decision(spark, sf_dir):
    return policy.target_global(cube_of(spark, sf_dir), ALPHA, EPSILONS)


@query("one_rung_decision", f"""WITH {_JUDGED},
  so AS (SELECT epsilon, build AS source, coalesce(min(action_idx) FILTER (f <= most), {END}) AS source_action FROM br JOIN lim ON br.n = lim.n AND alpha = 'each' WHERE role = 'design' GROUP BY ALL),
  ce AS (SELECT epsilon, build, action_idx, f <= most AS ok FROM br JOIN lim ON br.n = lim.n AND alpha = 'half' WHERE role = 'certification')
  SELECT s.epsilon, source, c.build AS target, CAST(source_action AS INT) AS source_action, CAST(least(source_action + 1, {END}) AS INT) AS candidate_action,
    CASE WHEN NOT e.ok THEN 'ABSTAIN_ENDPOINT_UNQUALIFIED' WHEN c.ok THEN 'CANDIDATE_ACCEPTED' ELSE 'FIXED_SAFE_FALLBACK' END AS decision
  FROM so s JOIN ce c ON c.epsilon = s.epsilon AND c.build <> source AND c.action_idx = least(source_action + 1, {END}) JOIN ce e ON e.epsilon = s.epsilon AND e.build = c.build AND e.action_idx = {END}""")
def one_rung_decision(spark, sf_dir):
    return policy.one_rung(cube_of(spark, sf_dir), ALPHA, EPSILONS)


_CELLS = f"{_HM}, cells AS MATERIALIZED (SELECT l.build AS target, l.query_id, l.label, h.source_max AS cell FROM lab l JOIN hm h ON h.target = l.build AND h.query_id = l.query_id WHERE l.label < {N})"


@query("cell_coverage", f"""WITH {_CELLS}, p AS (SELECT target, cell, count(*) AS n, count(DISTINCT label) AS k FROM cells GROUP BY ALL)
SELECT target, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_queries, CAST(coalesce(sum(n) FILTER (n = 1), 0) AS BIGINT) AS singleton_queries, CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS mixed_queries, max(n) AS largest_cell FROM p GROUP BY target""")
def cell_coverage(spark, sf_dir):
    return policy.coverage(cube_of(spark, sf_dir))


@query("partition_objectives", f"""WITH RECURSIVE {_CELLS},
ca AS (SELECT c.target, c.cell, u.action_idx, bool_and(u.action_idx >= c.label) AS ok, sum(u.ndc) AS cost, count(*) AS n FROM cells c JOIN cube u ON u.build = c.target AND u.query_id = c.query_id GROUP BY ALL),
ji AS (SELECT target, avg(c) AS v FROM (SELECT c.target, c.query_id, min(u.ndc) AS c FROM cells c JOIN cube u ON u.build = c.target AND u.query_id = c.query_id AND u.action_idx >= c.label GROUP BY ALL) GROUP BY target),
js AS (SELECT target, CASE WHEN count(c) = count(*) THEN sum(c) / sum(n) END AS v, sum(n) AS n FROM (SELECT target, cell, min(cost) FILTER (ok) AS c, max(n) AS n FROM ca GROUP BY ALL) GROUP BY target),
ro AS (SELECT target, row_number() OVER (PARTITION BY target ORDER BY cell) AS i, list(CASE WHEN ok THEN CAST(cost AS DOUBLE) ELSE 'Infinity'::DOUBLE END ORDER BY action_idx) AS c FROM ca GROUP BY target, cell),
fold AS (SELECT target, i, c AS best FROM ro WHERE i = 1 UNION ALL
  SELECT r.target, r.i, list_transform(range(1, {N + 1}), lambda a: r.c[a] + list_min(f.best[1:a])) FROM fold f JOIN ro r ON r.target = f.target AND r.i = f.i + 1),
jo AS (SELECT target, list_min(best) AS v FROM fold QUALIFY row_number() OVER (PARTITION BY target ORDER BY i DESC) = 1),
al AS (SELECT target, ji.v AS a, js.v AS b, CASE WHEN isfinite(jo.v) THEN jo.v / js.n END AS c FROM ji JOIN js USING (target) JOIN jo USING (target))
SELECT target, round(a, 6) AS j_identity, round(b, 6) AS j_summary, round(c, 6) AS j_order, round(b - a, 6) AS information_gap, round(c - b, 6) AS order_gap FROM al""")
def partition_objectives(spark, sf_dir):
    return policy.objectives(cube_of(spark, sf_dir))


# --- scoring of result lists ------------------------------------------------------------------------------

_QUANT = "list_transform({0}.e, lambda x: CAST(round(x * 8) AS BIGINT))"


@query("tie_aware_hits", f"""WITH {_VEC}, z AS (SELECT vec_id, {_QUANT.format('vec')} AS z FROM vec),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, CAST(list_sum(list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d, CAST(list_sum(list_transform(list_zip(a.z[1:32], b.z[1:32]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS h FROM z a, z b WHERE a.vec_id <> b.vec_id),
f AS (SELECT query_id, base_id, d FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY h, base_id) <= {K}),
t AS (SELECT query_id, max(d) AS boundary, list(base_id) AS ids FROM (SELECT query_id, base_id, d FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, base_id) <= {K}) GROUP BY query_id),
s AS (SELECT f.query_id, count(*) FILTER (f.d < boundary) AS strict_hits, count(*) FILTER (f.d = boundary) AS returned_ties, count(*) FILTER (list_contains(ids, base_id)) AS hits FROM f JOIN t USING (query_id) GROUP BY f.query_id)
SELECT query_id, hits, strict_hits, strict_hits + least({K} - strict_hits, returned_ties) AS tie_aware_hits FROM s""")
def tie_aware_hits(spark, sf_dir):
    z = vecs(spark, sf_dir).select("vec_id", F.transform("e", lambda x: F.round(x * 8)).alias("e"))  # whole numbers, so distances are exact
    truth = search.exact_knn(z, z).groupBy("query_id").agg(F.max("score").alias("boundary"), F.collect_list("base_id").alias("ids"))
    coarse = search.exact_knn(search.prefix(z, 32), search.prefix(z, 32))
    found = search.rescored(coarse, z, z, D.l2sq).withColumnRenamed("score", "d").join(truth, "query_id")
    s = found.groupBy("query_id").agg(F.count(F.when(F.col("d") < F.col("boundary"), 1)).alias("strict_hits"), F.count(F.when(F.col("d") == F.col("boundary"), 1)).alias("ties"), F.count(F.when(F.expr("array_contains(ids, base_id)"), 1)).alias("hits"))
    return s.select("query_id", "hits", "strict_hits", (F.col("strict_hits") + F.least(K - F.col("strict_hits"), F.col("ties"))).alias("tie_aware_hits"))


@query("distance_features", f"""WITH {_knn_sql('l2', k=10)}, f AS (SELECT query_id, avg(score) AS m, min(score) AS lo, max(score) AS hi, var_pop(score) AS v, list(score ORDER BY score) AS s, sum(score * score * score) / count(*) AS c3, sum(score * score) AS energy FROM knn GROUP BY query_id)
SELECT query_id, round(m, 6) AS mean, round(lo, 6) AS least, round(hi, 6) AS kth, round(v, 6) AS variance, round(s[1 + CAST(floor(0.25 * (len(s) - 1)) AS INT)], 6) AS p25, round(s[1 + CAST(floor(0.75 * (len(s) - 1)) AS INT)], 6) AS p75, round(c3 - 3 * m * v - m * m * m, 6) AS third_moment,
  round(list_sum(list_transform(s, lambda x: pow(x - m, 4))) / len(s) / pow(v, 2) - 3, 4) AS excess_kurtosis, round(energy, 6) AS energy FROM f""")
def distance_features(spark, sf_dir):
    base = vecs(spark, sf_dir)
    near = search.exact_knn(base, base, 10)
    s = F.col("score")
    f = near.groupBy("query_id").agg(F.avg(s).alias("m"), F.min(s).alias("lo"), F.max(s).alias("hi"), F.var_pop(s).alias("v"), F.array_sort(F.collect_list(s)).alias("s"), (F.sum(s * s * s) / F.count(s)).alias("c3"), F.kurtosis(s).alias("k"), F.sum(s * s).alias("energy"))
    nth = lambda p: F.round(F.get("s", F.floor(p * (F.size("s") - 1)).cast("int")), 6)
    m, v = F.col("m"), F.col("v")
    six = lambda c: F.round(c, 6)
    return f.select("query_id", six(m).alias("mean"), six("lo").alias("least"), six("hi").alias("kth"), six(v).alias("variance"), nth(0.25).alias("p25"), nth(0.75).alias("p75"), six(F.col("c3") - 3 * m * v - m * m * m).alias("third_moment"), F.round("k", 4).alias("excess_kurtosis"), six("energy").alias("energy"))


_COARSE = f"(SELECT a.vec_id AS query_id, b.vec_id AS base_id, {D.METRICS['l2'][1]} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_PREFIX}, b.vec_id) AS r FROM vec a, vec b WHERE a.vec_id <> b.vec_id QUALIFY r <= {K})"


@query("result_quality", f"""WITH {_knn_sql('l2')}, fo AS (SELECT query_id, base_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, base_id) AS rank FROM {_COARSE}),
j AS (SELECT f.query_id, k.score AS gt, f.d AS found, t.rank AS true_rank FROM fo f JOIN knn k ON k.query_id = f.query_id AND k.rank = f.rank LEFT JOIN knn t ON t.query_id = f.query_id AND t.base_id = f.base_id)
SELECT query_id, round(sum(gt) / sum(found), 6) AS tdr, round(avg(found / gt - 1), 6) AS rde, round(CASE WHEN count(true_rank) < count(*) THEN -1 ELSE 1 - (sum(true_rank) - {K}) / ({K * (K + 1) / 2} - {K}) END, 6) AS nrs FROM j GROUP BY query_id""")
def result_quality(spark, sf_dir):
    """Total distance ratio, relative distance error, and the rank sum as the reference states it: a perfect list is 0."""
    base = vecs(spark, sf_dir)
    coarse = search.exact_knn(search.prefix(base, 16), search.prefix(base, 16))
    found = search.rescored(coarse, base, base, D.l2sq).withColumnRenamed("score", "found")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("found", "base_id")))
    truth = knn_of(spark, sf_dir)
    aligned = found.join(truth.select("query_id", "rank", F.col("score").alias("gt")), ["query_id", "rank"]).join(truth.select("query_id", "base_id", F.col("rank").alias("true_rank")), ["query_id", "base_id"], "left")
    nrs = F.when(F.count("true_rank") < F.count("*"), -1.0).otherwise(1 - (F.sum("true_rank") - K) / (K * (K + 1) / 2 - K))
    return aligned.groupBy("query_id").agg(F.round(F.sum("gt") / F.sum("found"), 6).alias("tdr"), F.round(F.avg(F.col("found") / F.col("gt") - 1), 6).alias("rde"), F.round(nrs, 6).alias("nrs"))


@query("column_statistics", f"WITH {_VEC}, x AS (SELECT generate_subscripts(e, 1) - 1 AS dim, unnest(e) AS v FROM vec) SELECT dim, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high FROM x GROUP BY dim")
def column_statistics(spark, sf_dir):
    each = vecs(spark, sf_dir).select(F.posexplode("e").alias("dim", "v")).withColumn("dim", F.col("dim").cast("long"))
    six = lambda c, n: F.round(c, 6).alias(n)
    return each.groupBy("dim").agg(F.count("v").alias("n"), six(F.avg("v"), "mean"), six(F.stddev_pop("v"), "std"), six(F.min("v"), "low"), six(F.max("v"), "high"))


@query("ceil_to_grid", f"SELECT event_id, round(value, 6) AS value, coalesce((SELECT min(g) FROM (SELECT unnest({list(GRID)}) AS g) WHERE g >= value), 512) AS rung FROM events")
def ceil_to_grid(spark, sf_dir):
    rung = F.array_min(F.filter(F.array(*[F.lit(g) for g in GRID]), lambda g: g >= F.col("value")))
    return table(spark, sf_dir, "events").select("event_id", F.round("value", 6).alias("value"), F.coalesce(rung, F.lit(512)).alias("rung"))


# --- statistics ------------------------------------------------------------------------------------------


@query("latency_quantiles", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_quantiles(spark, sf_dir):
    return stats.quantiles(table(spark, sf_dir, "events"), "event_type", "value")


@query("block_cv", "WITH m AS (SELECT event_type, user_id % 7 AS block, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, round(stddev_samp(m) / avg(m), 6) AS cv, stddev_samp(m) / avg(m) <= 0.05 AS tight, stddev_samp(m) / avg(m) <= 0.10 AS loose FROM m GROUP BY event_type")
def block_cv(spark, sf_dir):
    return stats.block_cv(table(spark, sf_dir, "events").withColumn("block", F.col("user_id") % 7), "event_type", "block", "value")


@query("gain_ratio_of_sums", f"WITH {_CUBE} SELECT a.build, round(1 - sum(a.ndc) / sum(e.ndc), 6) AS gain FROM cube a JOIN cube e ON e.build = a.build AND e.query_id = a.query_id AND e.action_idx = {END} WHERE a.action_idx = 2 GROUP BY a.build")
def gain_ratio_of_sums(spark, sf_dir):
    cube = cube_of(spark, sf_dir)
    a = F.max(F.when(F.col("action_idx") == 2, F.col("ndc"))).alias("a")
    b = F.max(F.when(F.col("action_idx") == END, F.col("ndc"))).alias("b")
    return stats.gain_of_sums(cube.groupBy("build", "query_id").agg(a, b), "build", "a", "b")


@query("leave_one_out_means", "WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) SELECT event_type, round((SELECT avg(m) FROM m o WHERE o.event_type <> x.event_type), 6) AS loo_mean FROM m x")
def leave_one_out_means(spark, sf_dir):
    return stats.leave_one_out_means(table(spark, sf_dir, "events"), "event_type", "value")


@query("trimmed_mean", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events) SELECT event_type, count(*) AS n, round(avg(value), 6) AS trimmed_mean FROM r WHERE r > ceil(c * 0.01) GROUP BY event_type")
def trimmed_mean(spark, sf_dir):
    return stats.trimmed_mean(table(spark, sf_dir, "events"), "event_type", "value")


_DEMAND = f"{_LABELS}, d AS (SELECT s.build AS source, s.label AS x, t.label AS y FROM lab s JOIN lab t ON s.query_id = t.query_id AND t.build = s.build % 4 + 1)"


def _demand(spark, sf_dir) -> DataFrame:
    lab = policy.labels(cube_of(spark, sf_dir))
    t = lab.select(F.col("build").alias("other"), "query_id", F.col("label").alias("y"))
    return lab.withColumn("other", F.col("build") % 4 + 1).join(t, ["other", "query_id"]).select(F.col("build").alias("source"), F.col("label").alias("x"), "y")


@query("spearman", f"{'WITH ' + _DEMAND}, r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY x) + (count(*) OVER (PARTITION BY source, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY source ORDER BY y) + (count(*) OVER (PARTITION BY source, y) - 1) / 2.0 AS ry FROM d) SELECT source, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY source")
def spearman(spark, sf_dir):
    return stats.spearman(_demand(spark, sf_dir), "source", "x", "y")


@query("kendall_tau", f"""WITH {_DEMAND}, e AS (SELECT *, row_number() OVER () AS i FROM d),
p AS (SELECT a.source, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) FILTER (a.x <> b.x) AS nx, count(*) FILTER (a.y <> b.y) AS ny FROM e a JOIN e b ON a.source = b.source AND a.i < b.i GROUP BY a.source)
SELECT source, round(s / sqrt(CAST(nx AS DOUBLE) * ny), 6) AS tau, round((1 - s / sqrt(CAST(nx AS DOUBLE) * ny)) / 2, 6) AS inversion FROM p""")
def kendall_tau(spark, sf_dir):
    return stats.kendall(_demand(spark, sf_dir), "source", "x", "y")


# --- ledger, cache, integrity -----------------------------------------------------------------------------


@query("break_even_ledger", """WITH s AS (SELECT l_suppkey AS supplier, CAST(sum(p) AS DECIMAL(28, 9)) - 5000000 AS upfront, CAST(sum(p * d) AS DECIMAL(28, 9)) - 250000 AS saving
  FROM (SELECT l_suppkey, CAST(l_extendedprice AS DECIMAL(18, 2)) AS p, CAST(l_discount AS DECIMAL(6, 2)) AS d FROM lineitem) GROUP BY 1),
u AS (SELECT *, CAST(upfront * 10000 AS HUGEINT) AS b, CAST(saving * 10000 AS HUGEINT) AS d FROM s),
v AS (SELECT *, CASE WHEN d <> 0 THEN b // d - CASE WHEN b % d <> 0 AND (b < 0) <> (d < 0) THEN 1 ELSE 0 END END AS low FROM u)
SELECT supplier, CAST(upfront AS DOUBLE) AS upfront, CAST(saving AS DOUBLE) AS saving, CAST(CASE WHEN d > 0 THEN greatest(1, low + 1) WHEN b < 0 AND d = 0 THEN 1 END AS BIGINT) AS first_round,
  b < 0 AND d < 0 AND b < d AS initial_only, CAST(CASE WHEN b < 0 AND d < 0 AND low + CASE WHEN b % d <> 0 THEN 1 ELSE 0 END >= 2 THEN low + CASE WHEN b % d <> 0 THEN 1 ELSE 0 END - 1 END AS BIGINT) AS last_initial_round FROM v""")
def break_even_ledger(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("p"), F.col("l_discount").cast("decimal(6,2)").alias("d"))
    s = rows.groupBy(F.col("l_suppkey").alias("supplier")).agg((F.sum("p").cast("decimal(28,9)") - 5000000).alias("upfront"), (F.sum(F.col("p") * F.col("d")).cast("decimal(28,9)") - 250000).alias("saving"))
    up, down = F.col("upfront"), F.col("saving")
    return s.select("supplier", up.cast("double").alias("upfront"), down.cast("double").alias("saving"), ledger.first_round(up, down).alias("first_round"), ledger.initial_region(up, down).alias("initial_only"), ledger.last_initial_round(up, down).alias("last_initial_round"))


@query("cost_curves", "WITH l AS (SELECT r_regionkey AS region, 100.0 * (r_regionkey + 1) AS upfront, 7.5 * r_regionkey AS saving FROM region) SELECT region, round, CAST(upfront - round * saving AS DOUBLE) AS remaining FROM l, (SELECT unnest([1, 5, 10, 20, 40]) AS round)")
def cost_curves(spark, sf_dir):
    l = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), (F.lit(100.0) * (F.col("r_regionkey") + 1)).alias("upfront"), (F.lit(7.5) * F.col("r_regionkey")).alias("saving"))
    return ledger.curves(l, [1, 5, 10, 20, 40]).select("region", "round", "remaining")


@query("cache_lookup", "SELECT o_custkey % 10 AS grp, count(*) AS lookups, count(c.c_custkey) AS hits, round(count(c.c_custkey) / count(*), 6) AS hit_rate FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) c ON c.c_custkey = o_custkey GROUP BY 1")
def cache_lookup(spark, sf_dir):
    key = lambda c: F.concat(F.lit("ctx|").cast("binary"), F.col(c).cast("string").cast("binary"))
    cache = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(key("c_custkey").alias("key"), F.lit(1).alias("value"))
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("grp"), key("o_custkey").alias("key"))
    return ledger.cache_lookup(cache, asked).groupBy("grp").agg(F.count("*").alias("lookups"), F.count(F.when(F.col("hit"), 1)).alias("hits"), F.round(F.count(F.when(F.col("hit"), 1)) / F.count("*"), 6).alias("hit_rate"))


@query("content_duplicates", "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def content_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("first_id", "n")


@query("grid_completeness", f"WITH {_CUBE} SELECT b.build, a.action_idx, count(c.query_id) AS present, (SELECT count(*) FROM vec) - count(c.query_id) AS missing FROM (SELECT DISTINCT build FROM cube) b CROSS JOIN (SELECT CAST(unnest(range(0, {N + 1})) AS INT) AS action_idx) a LEFT JOIN cube c ON c.build = b.build AND c.action_idx = a.action_idx GROUP BY ALL")
def grid_completeness(spark, sf_dir):
    cube = cube_of(spark, sf_dir)
    axes = cube.select("build").distinct().crossJoin(spark.createDataFrame([(i,) for i in range(N + 1)], "action_idx int"))
    want = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("want"))
    have = cube.groupBy("build", "action_idx").agg(F.count("*").alias("present"))
    rows = axes.join(have, ["build", "action_idx"], "left").crossJoin(F.broadcast(want)).withColumn("present", F.coalesce("present", F.lit(0)))
    return rows.select("build", "action_idx", "present", (F.col("want") - F.col("present")).alias("missing"))


@query("role_disjointness", "WITH r AS (SELECT vec_id, vec_id % 5 AS role FROM embeddings) SELECT a.role AS role_a, b.role AS role_b, count(*) AS shared FROM r a JOIN r b USING (vec_id) GROUP BY ALL")
def role_disjointness(spark, sf_dir):
    r = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("role"))
    return r.withColumnRenamed("role", "role_a").join(r.withColumnRenamed("role", "role_b"), "vec_id").groupBy("role_a", "role_b").agg(F.count("*").alias("shared"))


# --- graphs -----------------------------------------------------------------------------------------------


@query("knn_graph_edges", f"WITH {_knn_sql('l2', k=3)}, e AS (SELECT least(query_id, base_id) AS src, greatest(query_id, base_id) AS dst FROM knn) SELECT DISTINCT src, dst FROM e")
def knn_graph_edges(spark, sf_dir):
    base = vecs(spark, sf_dir)
    return graph.knn_edges(search.exact_knn(base, base, 3))


@query("adjacency_stats", f"""WITH RECURSIVE {_knn_sql('l2', k=3)}, ln AS (SELECT query_id AS a, base_id AS b FROM knn UNION ALL SELECT base_id, query_id FROM knn), reach AS (SELECT vec_id AS id, vec_id AS r FROM vec UNION SELECT ln.b, reach.r FROM reach JOIN ln ON ln.a = reach.id)
SELECT (SELECT count(*) FROM vec) AS nodes, (SELECT max(c) FROM (SELECT count(*) AS c FROM knn GROUP BY query_id)) AS max_out_degree, (SELECT count(*) FROM knn) AS edges, (SELECT count(*) FROM knn a JOIN knn b ON a.query_id = b.base_id AND a.base_id = b.query_id) AS reciprocal_edges, (SELECT count(DISTINCT m) FROM (SELECT min(r) AS m FROM reach GROUP BY id)) AS components""")
def adjacency_stats(spark, sf_dir):
    base = vecs(spark, sf_dir)
    directed = search.exact_knn(base, base, 3).select(F.col("query_id").alias("src"), F.col("base_id").alias("dst"))
    return graph.adjacency_stats(directed, base.select(F.col("vec_id").alias("id")), 3)


@query("gaussian_edge_weights", f"WITH {_knn_sql('l2', k=3)}, e AS (SELECT DISTINCT least(query_id, base_id) AS src, greatest(query_id, base_id) AS dst, sqrt(score) AS d FROM knn) SELECT src, dst, round(exp(-pow(d / (SELECT quantile_cont(d, 0.5) FROM e), 2)), 6) AS weight FROM e")
def gaussian_edge_weights(spark, sf_dir):
    base = vecs(spark, sf_dir)
    near = search.exact_knn(base, base, 3)
    e = near.groupBy(F.least("query_id", "base_id").alias("src"), F.greatest("query_id", "base_id").alias("dst")).agg(F.sqrt(F.min("score")).alias("d"))
    rho = e.agg(F.median("d").alias("rho"))
    return e.crossJoin(F.broadcast(rho)).select("src", "dst", F.round(F.exp(-F.pow(F.col("d") / F.col("rho"), F.lit(2))), 6).alias("weight"))


@query("mutual_knn_edges", f"WITH {_knn_sql('l2', k=3)} SELECT DISTINCT a.query_id AS src, a.base_id AS dst FROM knn a JOIN knn b ON a.query_id = b.base_id AND a.base_id = b.query_id WHERE a.query_id < a.base_id")
def mutual_knn_edges(spark, sf_dir):
    base = vecs(spark, sf_dir)
    return graph.knn_edges(search.exact_knn(base, base, 3), "intersection")


# --- quantisers, merged and grouped search, membership ---------------------------------------------------

_DIMS = "x AS (SELECT vec_id, generate_subscripts(e, 1) - 1 AS dim, unnest(e) AS v FROM vec)"


@query("scalar_quantizer", f"""WITH {_VEC}, {_DIMS}, b AS (SELECT dim, min(v) AS lo, (max(v) - min(v)) / {quantize.LEVELS} AS w FROM x GROUP BY dim),
c AS (SELECT vec_id, v, lo, w, CASE WHEN w > 0 THEN least(floor((v - lo) / w), {quantize.LEVELS - 1}) ELSE 0 END AS code FROM x JOIN b USING (dim))
SELECT vec_id, CAST(sum(code) AS BIGINT) AS code_sum, round(max(abs((code + 0.5) * w + lo - v)), 6) AS worst FROM c GROUP BY vec_id""")
def scalar_quantizer(spark, sf_dir):
    coded = quantize.scalar_codes(vecs(spark, sf_dir))
    worst = F.array_max(F.zip_with("decoded", "e", lambda a, b: F.abs(a - b)))
    return coded.select("vec_id", F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + c).alias("code_sum"), F.round(worst, 6).alias("worst"))


@query("lloyd_step", f"WITH {_VEC}, {_INDEX}, {_DIMS} SELECT list, CAST(dim AS INT) AS dim, count(*) AS size, round(avg(v), 6) AS mean FROM x JOIN assigned USING (vec_id) WHERE build = 1 GROUP BY list, dim")
def lloyd_step(spark, sf_dir):
    assigned = assign_centroid(spark, sf_dir).filter("build = 1").select("vec_id", "list")
    centres = quantize.lloyd_step(vecs(spark, sf_dir), assigned)
    return centres.select("list", "size", F.posexplode("centre").alias("dim", "m")).select("list", "dim", "size", F.round("m", 6).alias("mean"))


@query("grouped_search", f"""WITH {_knn_sql('l2', 'b.label IS NOT NULL')}, g AS (SELECT query_id, label, min(score) AS s FROM scored JOIN vec ON vec_id = base_id GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, label) AS INT) AS rank, label, round(s, 6) AS score FROM g QUALIFY rank <= 3""")
def grouped_search(spark, sf_dir):
    """The nearest distinct labels: a minimum a label first, so that one label cannot fill the list."""
    base, groups = vecs(spark, sf_dir), table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = search.grouped_knn(base, groups, base, 3)
    return found.select("query_id", "rank", F.col("base_id").alias("label"), F.round("score", 6).alias("score"))


@query("merge_shards", f"WITH {_knn_sql('l2')} SELECT query_id, CAST(rank AS INT) AS rank, base_id, round(score, 6) AS score FROM knn")
def merge_shards(spark, sf_dir):
    """Two shards searched apart; of both lists the best k stay."""
    base = vecs(spark, sf_dir)
    lists = [search.exact_knn(base.filter(F.col("vec_id") % 2 == i), base) for i in (0, 1)]
    merged = search.top_k(lists[0].drop("rank").unionByName(lists[1].drop("rank")), K)
    return merged.select("query_id", "rank", "base_id", F.round("score", 6).alias("score"))


@query("truth_by_membership", f"""WITH {_VEC}, s AS (SELECT unnest([0, 1]) AS state), p AS (SELECT state, a.vec_id AS query_id, b.vec_id AS base_id, {D.METRICS['l2'][1]} AS score FROM s, vec a, vec b WHERE a.vec_id % 5 = 4 AND b.vec_id % 5 <> 4 AND b.vec_id % 20 <> state)
SELECT state, query_id, CAST(row_number() OVER (PARTITION BY state, query_id ORDER BY score, base_id) AS INT) AS rank, base_id, round(score, 6) AS score FROM p QUALIFY rank <= {K}""")
def truth_by_membership(spark, sf_dir):
    """Exact neighbours before and after a twentieth of the members is replaced; queries are no members."""
    every = vecs(spark, sf_dir)
    asked = every.filter("vec_id % 5 = 4")
    members = every.join(asked.select("vec_id"), "vec_id", "left_anti")
    states = [search.exact_knn(members.filter(F.col("vec_id") % 20 != s), asked).withColumn("state", F.lit(s)) for s in (0, 1)]
    return states[0].unionByName(states[1]).select("state", "query_id", "rank", "base_id", F.round("score", 6).alias("score"))


@query("membership_turnover", "WITH o AS (SELECT vec_id FROM embeddings WHERE vec_id % 20 <> 0), n AS (SELECT vec_id FROM embeddings WHERE vec_id % 20 <> 1) SELECT (SELECT count(*) FROM (FROM o INTERSECT FROM n)) AS kept, (SELECT count(*) FROM (FROM o EXCEPT FROM n)) AS removed, (SELECT count(*) FROM (FROM n EXCEPT FROM o)) AS added, (SELECT count(*) FROM (FROM o UNION FROM n)) AS together")
def membership_turnover(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    sides = ids.filter("vec_id % 20 <> 0").withColumn("old", F.lit(True)).unionByName(ids.filter("vec_id % 20 <> 1").withColumn("old", F.lit(False)))
    each = sides.groupBy("vec_id").agg(F.max("old").alias("o"), F.max(~F.col("old")).alias("n"))
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return each.agg(count(F.col("o") & F.col("n"), "kept"), count(F.col("o") & ~F.col("n"), "removed"), count(F.col("n") & ~F.col("o"), "added"), F.count("*").alias("together"))


@query("score_reference", f"""WITH {_knn_sql('l2')}, r AS (SELECT score, list_dot_product(q.e, q.e) + list_dot_product(b.e, b.e) AS scale, list_dot_product(q.e, b.e) AS p FROM knn JOIN vec q ON q.vec_id = query_id JOIN vec b ON b.vec_id = base_id)
SELECT count(*) AS n, count(*) FILTER (abs(score - (scale - 2 * p)) > scale * (128 * pow(2.0, -23)) + 1e-3) AS beyond FROM r""")
def score_reference(spark, sf_dir):
    """Scores recomputed by norms and products; counts those off by more than single precision allows."""
    base = vecs(spark, sf_dir)
    q, b = base.select(F.col("vec_id").alias("query_id"), F.col("e").alias("eq")), base.select(F.col("vec_id").alias("base_id"), F.col("e").alias("eb"))
    both = search.exact_knn(base, base).join(q, "query_id").join(b, "base_id")
    scale = D.norm_l2sq(F.col("eq")) + D.norm_l2sq(F.col("eb"))
    off = F.abs(F.col("score") - D.l2_norm_form(F.col("eq"), F.col("eb"))) > scale * (128 * 2.0**-23) + 1e-3
    return both.agg(F.count("*").alias("n"), F.count(F.when(off, 1)).alias("beyond"))


# --- censored failures, envelopes, profile costs ---------------------------------------------------------


@query("endpoint_censored_failure", f"""WITH {_CUBE}, z AS (SELECT *, hits < {K} AS rec, bool_or(hits < {K} AND action_idx = {N - 1}) OVER (PARTITION BY build, query_id) AS censored FROM cube)
SELECT build, action_idx, count(*) FILTER (rec) AS recall_failures, count(*) FILTER (censored) AS censored, count(*) FILTER (rec OR censored) AS absolute_failures FROM z GROUP BY ALL""")
def endpoint_censored_failure(spark, sf_dir):
    """A query whose last action fails counts as a failure of every action."""
    rec = F.col("hits") < K
    z = cube_of(spark, sf_dir).withColumn("censored", F.max(rec & (F.col("action_idx") == N - 1)).over(Window.partitionBy("build", "query_id")))
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return z.groupBy("build", "action_idx").agg(count(rec, "recall_failures"), count(F.col("censored"), "censored"), count(rec | F.col("censored"), "absolute_failures"))


@query("ordered_envelope", f"""WITH {_HM}, c AS (SELECT target, source_max AS cell, count(*) AS n, max(label) AS top FROM hm JOIN lab ON lab.build = target AND lab.query_id = hm.query_id GROUP BY ALL)
SELECT target, CAST(cell AS INT) AS cell, n, CAST(top AS INT) AS common, CAST(max(top) OVER (PARTITION BY target ORDER BY cell) AS INT) AS ordered FROM c""")
def ordered_envelope(spark, sf_dir):
    """Each cell's largest label and its running maximum along the ordered cells (a row a cell by then)."""
    labelled = policy.labels(cube_of(spark, sf_dir))
    own = labelled.select(F.col("build").alias("target"), "query_id", "label")
    cells = policy.history_max(labelled).select("target", "query_id", F.col("source_max").alias("cell")).join(own, ["target", "query_id"]).groupBy("target", "cell").agg(F.count("*").alias("n"), F.max("label").alias("common"))
    return cells.withColumn("ordered", F.max("common").over(Window.partitionBy("target").orderBy("cell"))).select("target", "cell", "n", "common", "ordered")


@query("sequential_profile_cost", f"WITH {_LABELS} SELECT build, query_id, CAST(sum(ndc) AS BIGINT) AS cost FROM cube JOIN lab USING (build, query_id) WHERE action_idx <= coalesce(first_pass, {N - 1}) GROUP BY ALL")
def sequential_profile_cost(spark, sf_dir):
    """The cost of trying actions in order up to the first that passes, in one pass over the sorted prices."""
    tried = F.array_sort(F.collect_list(F.struct("action_idx", "hits", "ndc")))
    each = cube_of(spark, sf_dir).groupBy("build", "query_id").agg(tried.alias("t"), F.coalesce(F.min(F.when(policy.safe(), F.col("action_idx"))), F.lit(N - 1)).alias("stop"))
    cost = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.when(x["action_idx"] <= F.col("stop"), x["ndc"]).otherwise(0))
    return each.select("build", "query_id", cost.alias("cost"))


@query("vector_cells", f"""WITH {_LABELS}, v AS (SELECT t.build AS target, t.query_id, t.label, string_agg(s.label, ',' ORDER BY s.build) AS cell FROM lab t JOIN lab s ON s.query_id = t.query_id AND s.build <> t.build GROUP BY ALL)
SELECT target, cell, count(*) AS n, count(DISTINCT label) AS n_labels FROM v GROUP BY target, cell""")
def vector_cells(spark, sf_dir):
    """Cells by the whole vector of the other builds' labels: one list a query, cut for each target."""
    labelled = policy.labels(cube_of(spark, sf_dir))
    lists = labelled.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("build", "label"))).alias("v"))
    each = lists.select("query_id", "v", F.explode("v").alias("t"))
    cell = F.array_join(F.transform(F.filter("v", lambda s: s["build"] != F.col("t.build")), lambda s: s["label"].cast("string")), ",")
    return each.select(F.col("t.build").alias("target"), cell.alias("cell"), F.col("t.label").alias("label")).groupBy("target", "cell").agg(F.count("*").alias("n"), F.count_distinct("label").alias("n_labels"))


@query("tail_ratio", "WITH q AS (SELECT event_type, quantile_cont(value, 0.95) AS p FROM events GROUP BY 1) SELECT event_type, round(p / (SELECT quantile_cont(value, 0.95) FROM events), 6) AS ratio FROM q")
def tail_ratio(spark, sf_dir):
    """The 95th percentile of each type over that of all, from one grouping by type and its total."""
    p = table(spark, sf_dir, "events").rollup("event_type").agg(F.percentile("value", F.lit(0.95)).alias("p"), F.grouping("event_type").alias("total"))
    whole = p.filter("total = 1").select(F.col("p").alias("all"))
    return p.filter("total = 0").join(F.broadcast(whole)).select("event_type", F.round(F.col("p") / F.col("all"), 6).alias("ratio"))


@query("event_rates", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS share, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def event_rates(spark, sf_dir):
    return monitor.rates(table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


@query("centred_vectors", f"""WITH {_VEC}, {_DIMS}, m AS (SELECT dim, avg(v) AS m FROM x GROUP BY dim), c AS (SELECT vec_id, dim, v - m AS c FROM x JOIN m USING (dim)), n AS (SELECT vec_id, sqrt(sum(c * c)) AS norm FROM c GROUP BY vec_id)
SELECT vec_id, CAST(dim AS INT) AS dim, round(norm, 6) AS norm, round(CASE WHEN norm > 0 THEN c / norm ELSE 0 END, 6) + 0.0 AS v FROM c JOIN n USING (vec_id)""")
def centred_vectors(spark, sf_dir):
    moved = quantize.centred(vecs(spark, sf_dir))
    return moved.select("vec_id", F.round("norm", 6).alias("norm"), F.posexplode("e").alias("dim", "v")).withColumn("v", F.round("v", 6))


from rungwise.plans import decisions, files, graphs, hashing, indexes, integrity, ledgers, partitions, quantisers, resampling  # noqa: E402, F401  they register their queries
