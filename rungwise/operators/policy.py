"""Budget labels, transfer between builds, qualification, decisions and objectives over a response cube.

A cube row is (build, action_idx, query_id, hits, ndc); safe means hits = K.
"""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.operators.search import GRID, K

N = len(GRID)
END = N - 1


def safe() -> Column:
    return F.col("hits") == K


def labels(cube: DataFrame) -> DataFrame:
    """build, query_id, label (first index of the safe tail, N if none), first_pass (NULL if none)."""
    unsafe = F.max(F.when(~safe(), F.col("action_idx")))
    return cube.groupBy("build", "query_id").agg((F.coalesce(unsafe + 1, F.lit(0))).alias("label"), F.min(F.when(safe(), F.col("action_idx"))).alias("first_pass"))


def history_max(labelled: DataFrame) -> DataFrame:
    """target, query_id, source_max: the largest label among all other builds.

    The two largest labels of a query answer for every target, so no pairs of builds are formed.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("label"), "build")
    ranked = labelled.withColumn("r", F.row_number().over(w))
    top = ranked.groupBy("query_id").agg(F.max(F.when(F.col("r") == 1, F.struct("label", "build"))).alias("one"), F.max(F.when(F.col("r") == 2, F.col("label"))).alias("two"))
    joined = labelled.join(top, "query_id")
    return joined.select(F.col("build").alias("target"), "query_id", F.when(F.col("build") == F.col("one.build"), F.col("two")).otherwise(F.col("one.label")).alias("source_max"))


def directed_pairs(cube: DataFrame, labelled: DataFrame) -> DataFrame:
    """source, target, query_id, action_idx (the source's label, at most END), hits and end_hits of the target."""
    src = labelled.select(F.col("build").alias("source"), "query_id", F.least("label", F.lit(END)).alias("action_idx"), "label")
    tgt = cube.select(F.col("build").alias("target"), "query_id", "action_idx", "hits", "ndc")
    end = cube.filter(F.col("action_idx") == END).select(F.col("build").alias("target"), "query_id", F.col("hits").alias("end_hits"))
    return src.join(tgt, ["query_id", "action_idx"]).filter("source <> target").join(end, ["target", "query_id"])


def role() -> Column:
    """design, selection, certification and evaluation by the id modulo 5."""
    m = F.col("query_id") % 5
    return F.when(m == 0, "design").when(m == 1, "selection").when(m == 2, "certification").otherwise("evaluation")


def binomial_cdf(f: int, n: int, p: float) -> float:
    """P(at most f of n), as the regularised incomplete beta function by its continued fraction."""
    if f >= n or p <= 0:
        return 1.0
    if f < 0 or p >= 1:
        return 0.0
    a, b, x = n - f, f + 1, 1 - p
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def max_failures(n: int, alpha: float, epsilon: float) -> int:
    """The most failures of n whose upper confidence bound at alpha is at most epsilon; -1 if none.

    The bound is at most epsilon exactly if the binomial distribution function at the failures is at
    most alpha, so no quantile of a Beta distribution is needed; it rises with the failures, so halving finds it.
    """
    low, high = -1, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if binomial_cdf(mid, n, epsilon) <= alpha else (low, mid)
    return low


def upper_bound(f: int, n: int, alpha: float) -> float:
    """The one-sided Clopper-Pearson upper bound, by 80 halvings."""
    if f >= n:
        return 1.0
    if f == 0:
        return 1 - alpha ** (1 / n)
    low, high = f / n, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(f, n, mid) > alpha else (low, mid)
    return high


#: Sample sizes up to which thresholds are made on the driver: one a role and build.
MAX_SIZES = 100_000


def limits(counted: DataFrame, alphas: dict[str, float], epsilons) -> DataFrame:
    """n, epsilon and a column of most failures for each name of ``alphas``, for the n that occur (counted)."""
    sizes = [r["n"] for r in counted.select("n").distinct().limit(MAX_SIZES + 1).collect()]
    if len(sizes) > MAX_SIZES:
        raise ValueError(f"more than {MAX_SIZES} sample sizes")
    rows = [(n, float(e), *[max_failures(n, a, e) for a in alphas.values()]) for n in sizes for e in epsilons]
    schema = "n long, epsilon double, " + ", ".join(f"{name} int" for name in alphas)
    return F.broadcast(counted.sparkSession.createDataFrame(rows, schema))


def candidate_outcomes(cube: DataFrame) -> DataFrame:
    """target, query_id, action_idx (history-max, clamped), bottom, hits, ndc, end_hits, end_ndc."""
    hm = history_max(labels(cube)).withColumns({"bottom": F.col("source_max") == N, "action_idx": F.least("source_max", F.lit(END))})
    at = cube.select(F.col("build").alias("target"), "query_id", "action_idx", "hits", "ndc")
    end = cube.filter(F.col("action_idx") == END).select(F.col("build").alias("target"), "query_id", F.col("hits").alias("end_hits"), F.col("ndc").alias("end_ndc"))
    return hm.join(at, ["target", "query_id", "action_idx"]).join(end, ["target", "query_id"])


def certify(cube: DataFrame, alpha: float, epsilons) -> DataFrame:
    """epsilon, target, n, candidate and endpoint failures on the certification role, decision; all tolerances in one pass."""
    rows = candidate_outcomes(cube).filter(role() == "certification")
    union = (F.col("hits") < K) | (F.col("end_hits") < K)
    counted = rows.groupBy("target").agg(F.count("*").alias("n"), F.count(F.when(union, 1)).alias("candidate_failures"), F.count(F.when(F.col("end_hits") < K, 1)).alias("endpoint_failures"), F.count(F.when(F.col("bottom"), 1)).alias("abstentions"))
    judged = counted.join(limits(counted, {"most": alpha}, epsilons), "n")
    decision = F.when(F.col("endpoint_failures") > F.col("most"), "UNDEPLOYABLE").when(F.col("candidate_failures") <= F.col("most"), "CANDIDATE").otherwise("ENDPOINT")
    return judged.withColumn("decision", decision).drop("most")


def evaluate(cube: DataFrame, locked: DataFrame) -> DataFrame:
    """epsilon, target, decision, n, failures, mean_ndc of the locked decisions on the evaluation role."""
    rows = candidate_outcomes(cube).filter(role() == "evaluation").join(F.broadcast(locked.select("epsilon", "target", "decision")), "target")  # a row a tolerance and build
    use = F.col("decision") == "CANDIDATE"
    hits, ndc = F.when(use, F.col("hits")).otherwise(F.col("end_hits")), F.when(use, F.col("ndc")).otherwise(F.col("end_ndc"))
    live = F.col("decision") != "UNDEPLOYABLE"
    return rows.groupBy("epsilon", "target", "decision").agg(F.count("*").alias("n"), F.count(F.when(live & (hits < K), 1)).alias("failures"), F.round(F.avg(F.when(live, ndc)), 6).alias("mean_ndc"))


def by_role(cube: DataFrame) -> DataFrame:
    """role, build, action_idx, n, f (queries that are not safe), fa (or whose endpoint is not), cost (mean)."""
    end = cube.filter(F.col("action_idx") == END).select("build", "query_id", (F.col("hits") != K).alias("end_bad"))
    rows = cube.join(end, ["build", "query_id"]).withColumn("role", role())
    return rows.groupBy("role", "build", "action_idx").agg(F.count("*").alias("n"), F.count(F.when(~safe(), 1)).alias("f"), F.count(F.when(~safe() | F.col("end_bad"), 1)).alias("fa"), F.avg("ndc").alias("cost"))


def three_way(end_ok: Column, ok: Column, names=("UNDEPLOYABLE", "CANDIDATE", "ENDPOINT")) -> Column:
    return F.when(~end_ok, names[0]).when(F.coalesce(ok, F.lit(False)), names[1]).otherwise(names[2])


def target_global(cube: DataFrame, alpha: float, epsilons) -> DataFrame:
    """epsilon, target, action_idx of least mean cost among eligible ones (ties to the lower), decision."""
    counted = by_role(cube).filter(F.col("role").isin("selection", "certification")).withColumnRenamed("build", "target")
    judged = counted.join(limits(counted, {"each": alpha / N, "half": alpha / 2}, epsilons), "n")
    chosen = judged.filter("role = 'selection' AND f <= each").groupBy("epsilon", "target").agg(F.min(F.struct("cost", "action_idx")).alias("m")).select("epsilon", "target", F.col("m.action_idx").alias("action_idx"))
    cert = judged.filter("role = 'certification'").withColumn("ok", F.col("f") <= F.col("half"))
    end = cert.filter(F.col("action_idx") == END).select("epsilon", "target", F.col("ok").alias("end_ok"))
    both = end.join(chosen, ["epsilon", "target"], "left").join(cert.select("epsilon", "target", "action_idx", "ok"), ["epsilon", "target", "action_idx"], "left")
    return both.select("epsilon", "target", F.col("action_idx").cast("int").alias("action_idx"), three_way(F.col("end_ok"), F.col("ok")).alias("decision"))


def one_rung(cube: DataFrame, alpha: float, epsilons) -> DataFrame:
    """epsilon, source, target, source_action, candidate_action, decision: the source's first passing budget, one rung up."""
    counted = by_role(cube)
    judged = counted.join(limits(counted, {"each": alpha / N, "half": alpha / 2}, epsilons), "n")
    passed = judged.filter("role = 'design'").groupBy("epsilon", F.col("build").alias("source")).agg(F.coalesce(F.min(F.when(F.col("f") <= F.col("each"), F.col("action_idx"))), F.lit(END)).alias("source_action"))
    cert = judged.filter("role = 'certification'").select("epsilon", F.col("build").alias("target"), F.col("action_idx").alias("candidate_action"), (F.col("f") <= F.col("half")).alias("ok"))
    rung = passed.withColumn("candidate_action", F.least(F.col("source_action") + 1, F.lit(END)))
    pairs = rung.join(cert, ["epsilon", "candidate_action"]).filter("source <> target")
    end = cert.filter(F.col("candidate_action") == END).select("epsilon", "target", F.col("ok").alias("end_ok"))
    names = ("ABSTAIN_ENDPOINT_UNQUALIFIED", "CANDIDATE_ACCEPTED", "FIXED_SAFE_FALLBACK")
    return pairs.join(end, ["epsilon", "target"]).select("epsilon", "source", "target", "source_action", "candidate_action", three_way(F.col("end_ok"), F.col("ok"), names).alias("decision"))


# --- partitions of queries into cells, and what a common budget in each cell costs ---------------------


def cells(cube: DataFrame) -> DataFrame:
    """target, query_id, cell (the history-max label), label of the target, over endpoint-solvable queries."""
    own = labels(cube).select(F.col("build").alias("target"), "query_id", "label").filter(F.col("label") < N)
    return own.join(history_max(labels(cube)), ["target", "query_id"]).withColumnRenamed("source_max", "cell")


def coverage(cube: DataFrame) -> DataFrame:
    per = cells(cube).groupBy("target", "cell").agg(F.count("*").alias("n"), F.countDistinct("label").alias("k"))
    return per.groupBy("target").agg(
        F.count("*").alias("n_cells"),
        F.sum("n").alias("n_queries"),
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("n"))), F.lit(0)).alias("singleton_queries"),
        F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("n"))), F.lit(0)).alias("mixed_queries"),
        F.max("n").alias("largest_cell"),
    )


def _cell_costs(cube: DataFrame) -> DataFrame:
    """target, cell, action_idx, ok (safe in the stable tail for all of the cell), cost, n."""
    at = cube.select(F.col("build").alias("target"), "query_id", "action_idx", "ndc")
    rows = cells(cube).join(at, ["target", "query_id"])
    return rows.groupBy("target", "cell", "action_idx").agg(F.bool_and(F.col("action_idx") >= F.col("label")).alias("ok"), F.sum("ndc").alias("cost"), F.count("*").alias("n"))


def objectives(cube: DataFrame) -> DataFrame:
    """target, j_identity, j_summary, j_order, information_gap, order_gap: mean costs a query.

    j_order's budgets must not fall along the cells: a fold over the cells, in order, carries for each
    budget the least cost so far of ending there.
    """
    at = cube.select(F.col("build").alias("target"), "query_id", "action_idx", "ndc")
    own = cells(cube).join(at, ["target", "query_id"]).filter("action_idx >= label").groupBy("target", "query_id").agg(F.min("ndc").alias("c"))
    identity = own.groupBy("target").agg(F.avg("c").alias("j_identity"))
    costs = _cell_costs(cube)
    least = costs.groupBy("target", "cell").agg(F.min(F.when(F.col("ok"), F.col("cost"))).alias("c"), F.max("n").alias("n"))
    summary = least.groupBy("target").agg((F.sum("c") / F.sum("n")).alias("s"), F.sum("n").alias("n"), F.count("c").alias("have"), F.count("*").alias("want"))
    rows = costs.groupBy("target", "cell").agg(F.array_sort(F.collect_list(F.struct("action_idx", F.when(F.col("ok"), F.col("cost").cast("double")).otherwise(F.lit(float("inf"))).alias("c")))).alias("row"))
    ordered = rows.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("cell", F.transform("row", lambda r: r["c"]).alias("c")))).alias("cells"))
    start = F.transform(F.sequence(F.lit(0), F.lit(END)), lambda i: F.lit(0.0))
    step = lambda best, cell: F.transform(cell["c"], lambda c, a: c + F.array_min(F.slice(best, F.lit(1), a + 1)))
    folded = ordered.select("target", F.array_min(F.aggregate("cells", start, step)).alias("o"))
    out = identity.join(summary, "target").join(folded, "target")
    j_summary = F.when(F.col("have") == F.col("want"), F.col("s"))
    j_order = F.when(F.col("o") < float("inf"), F.col("o") / F.col("n"))
    six = lambda c, name: F.round(c, 6).alias(name)
    return out.select("target", six(F.col("j_identity"), "j_identity"), six(j_summary, "j_summary"), six(j_order, "j_order"), six(j_summary - F.col("j_identity"), "information_gap"), six(j_order - j_summary, "order_gap"))
