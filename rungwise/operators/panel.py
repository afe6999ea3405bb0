"""Decisions over directed pairs of builds: arms, ladders, refreshes, and what their deployment costs.

A decision row names source, target, arm, the action that is proposed and the one that is executed (NULL
for an abstention).  A cube row is (build, action_idx, query_id, hits, ndc).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.operators import policy
from rungwise.operators.policy import END, N
from rungwise.operators.search import K

ABSTAIN, ACCEPT, FALLBACK = "ABSTAIN_ENDPOINT_UNQUALIFIED", "CANDIDATE_ACCEPTED", "FIXED_SAFE_FALLBACK"
#: The action that a fixed policy takes.
FIXED = N - 2


def positions(queries: DataFrame) -> DataFrame:
    """query_id, role, position (in order of ids within the role), half (whether it is in the first half)."""
    roled = queries.select("query_id").distinct().withColumn("role", policy.role())
    w = Window.partitionBy("role")
    placed = roled.withColumn("position", F.row_number().over(w.orderBy("query_id")) - 1).withColumn("size", F.count("*").over(w))
    return placed.select("query_id", "role", "position", (F.col("position") < F.floor(F.col("size") / 2)).alias("half"))


def _ends(cube: DataFrame) -> DataFrame:
    return cube.filter(F.col("action_idx") == END).select("build", "query_id", F.col("hits").alias("end_hits"), F.col("ndc").alias("end_ndc"))


def counts(cube: DataFrame) -> DataFrame:
    """role, size (full or half), build, action_idx, n, f, fa and cost: failures of the action, or of it or the endpoint."""
    bad, end_bad = F.col("hits") != K, F.col("end_hits") != K
    rows = cube.join(_ends(cube), ["build", "query_id"]).join(positions(cube), "query_id")
    sized = rows.withColumn("size", F.explode(F.when(F.col("half"), F.array(F.lit("full"), F.lit("half"))).otherwise(F.array(F.lit("full")))))
    return sized.groupBy("role", "size", "build", "action_idx").agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("f"), F.count(F.when(bad | end_bad, 1)).alias("fa"), F.avg("ndc").alias("cost"))


def judged(counted: DataFrame, alphas: dict[str, float], epsilon: float) -> DataFrame:
    return counted.join(policy.limits(counted, alphas, (epsilon,)).drop("epsilon"), "n")


def first_action(rows: DataFrame, ok: Column, by: list[str], name: str) -> DataFrame:
    """The first action that passes, the endpoint where none does."""
    return rows.groupBy(*by).agg(F.coalesce(F.min(F.when(ok, F.col("action_idx"))), F.lit(END)).alias(name))


def certificates(rows: DataFrame, level: str = "half_alpha") -> DataFrame:
    """size, target, proposed, ok, end_ok: whether an action and the endpoint pass on the certification role."""
    cert = rows.filter("role = 'certification'").select("size", F.col("build").alias("target"), F.col("action_idx").alias("proposed"), (F.col("f") <= F.col(level)).alias("ok"))
    end = cert.filter(F.col("proposed") == END).select("size", "target", F.col("ok").alias("end_ok"))
    return cert.join(end, ["size", "target"])


def decided(proposals: DataFrame, certified: DataFrame) -> DataFrame:
    """Proposals (with size) and what their certificate makes of them."""
    judged_rows = proposals.join(certified, ["size", "target", "proposed"])
    decision = policy.three_way(F.col("end_ok"), F.col("ok"), (ABSTAIN, ACCEPT, FALLBACK))
    executed = F.when(decision == ACCEPT, F.col("proposed")).when(decision == FALLBACK, F.lit(END))
    return judged_rows.withColumns({"decision": decision, "executed": executed})


def arms(cube: DataFrame, alpha: float, epsilon: float, oracle: bool = True) -> DataFrame:
    """arm, deployable, source, target, source_action, proposed, executed, decision of the nine arms; eight without the oracle.

    Without it no row of the evaluation role is read.
    """
    seen = cube if oracle else cube.filter(policy.role() != "evaluation")
    rows = judged(counts(seen), {"each": alpha / N, "half_alpha": alpha / 2}, epsilon)
    passes = F.col("f") <= F.col("each")
    source = first_action(rows.filter("role = 'design' AND size = 'full'"), passes, ["build"], "source_action").withColumnRenamed("build", "source")
    chosen = first_action(rows.filter("role = 'selection'"), passes, ["build", "size"], "a").groupBy(F.col("build").alias("target")).agg(F.max(F.when(F.col("size") == "half", F.col("a"))).alias("half_action"), F.max(F.when(F.col("size") == "full", F.col("a"))).alias("full_action"))
    pairs = source.join(chosen, F.col("source") != F.col("target"))
    if oracle:
        good = F.col("f") <= F.floor(F.col("n") * F.lit(epsilon) + F.lit(1e-9))
        best = first_action(rows.filter("role = 'evaluation' AND size = 'full'"), good, ["build"], "oracle_action").withColumnRenamed("build", "target")
        pairs = pairs.join(best, "target")
    rung = F.least(F.col("source_action") + 1, F.lit(END))
    arm = lambda name, proposed, size, deployable: F.struct(F.lit(name).alias("arm"), proposed.cast("int").alias("proposed"), F.lit(size).alias("size"), F.lit(deployable).alias("deployable"))
    listed = [
        arm("B0_ENDPOINT", F.lit(END), "full", True),
        arm("B1_FIXED", F.lit(FIXED), "full", True),
        arm("B2_SOURCE_ONE_RUNG", rung, "full", True),
        arm("B3_TARGET_GLOBAL_HALF", F.col("half_action"), "half", True),
        arm("B4_TARGET_GLOBAL", F.col("full_action"), "full", True),
        arm("A1_SOURCE_DIRECT", F.col("source_action"), "full", False),
        arm("A2_SOURCE_ONE_RUNG_UNCERTIFIED", rung, "full", False),
        arm("A3_FIXED_UNCERTIFIED", F.lit(FIXED), "full", False),
    ]
    if oracle:
        listed.append(arm("O1_EVALUATION_ORACLE", F.col("oracle_action"), "full", False))
    proposals = pairs.select("source", "target", "source_action", F.explode(F.array(*listed)).alias("x")).select("source", "target", "source_action", "x.*")
    done = decided(proposals, certificates(rows))
    free = ~F.col("deployable")
    return done.select("arm", "deployable", "source", "target", "source_action", "proposed", F.when(free, F.col("proposed")).otherwise(F.col("executed")).alias("executed"), F.when(free, "DIAGNOSTIC_NO_CERTIFICATE").otherwise(F.col("decision")).alias("decision"))


def with_bounds(decisions: DataFrame, cube: DataFrame, alpha: float) -> DataFrame:
    """``decisions`` (arm, deployable, target, proposed ...) with the upper bounds that they rest on.

    candidate_ucb and endpoint_ucb are Clopper-Pearson bounds at half of alpha over the target's
    certification rows, of the size that the arm pays for; arms without a certificate have NULL.
    """
    rows = counts(cube).filter("role = 'certification'").select("size", F.col("build").alias("target"), "action_idx", "f", "n")

    @F.pandas_udf("double")
    def bound(f: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([policy.upper_bound(int(a), int(b), alpha / 2) for a, b in zip(f, n)], dtype="float64")

    # Counts repeat over actions and builds: each pair of them is bounded once.
    bounded = rows.join(rows.select("f", "n").distinct().withColumn("ucb", bound("f", "n")), ["f", "n"]).select("size", "target", "action_idx", "ucb")
    sized = decisions.withColumn("size", F.when(F.col("arm") == "B3_TARGET_GLOBAL_HALF", "half").otherwise("full"))
    own = bounded.select("size", "target", F.col("action_idx").alias("proposed"), F.col("ucb").alias("candidate_ucb"))
    end = bounded.filter(F.col("action_idx") == END).select("size", "target", F.col("ucb").alias("endpoint_ucb"))
    joined = sized.join(own, ["size", "target", "proposed"], "left").join(end, ["size", "target"], "left")
    held = {c: F.when(F.col("deployable"), F.col(c)) for c in ("candidate_ucb", "endpoint_ucb")}
    return joined.withColumns(held).select(*decisions.columns, "candidate_ucb", "endpoint_ucb")


def evaluated(decisions: DataFrame, cube: DataFrame, columns: tuple[str, ...] = ("hits", "ndc")) -> DataFrame:
    """Decisions that execute an action, with the evaluation rows of that action and of the endpoint."""
    rows = cube.filter(policy.role() == "evaluation")
    own = rows.select(F.col("build").alias("target"), F.col("action_idx").alias("executed"), "query_id", *columns)
    end = rows.filter(F.col("action_idx") == END).select(F.col("build").alias("target"), "query_id", *[F.col(c).alias(f"end_{c}") for c in columns])
    return decisions.filter("executed IS NOT NULL").join(own, ["target", "executed"]).join(end, ["target", "query_id"])


def panel_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """risk, endpoint_risk, gain (1 - the ratio of sums), p95_ratio and p99_ratio of evaluated rows."""
    tail = lambda p: F.percentile("ndc", F.lit(p)) / F.percentile("end_ndc", F.lit(p))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("hits") < K).alias("risk"), share(F.col("end_hits") < K).alias("endpoint_risk"), (1 - F.sum("ndc") / F.sum("end_ndc")).alias("gain"), tail(0.95).alias("p95_ratio"), tail(0.99).alias("p99_ratio"))


def leave_one_out(rows: DataFrame, by: list[str], unit: str) -> DataFrame:
    """by, least_gain: the smallest 1 - ratio of sums when one unit is left out; totals less the part."""
    part = rows.groupBy(*by, unit).agg(F.sum("ndc").alias("a"), F.sum("end_ndc").alias("b"))
    whole = part.groupBy(*by).agg(F.sum("a").alias("wa"), F.sum("b").alias("wb"), F.count("*").alias("units"))
    left = part.join(whole, by) if by else part.crossJoin(whole)  # one row
    gain = 1 - (F.col("wa") - F.col("a")) / (F.col("wb") - F.col("b"))
    return left.filter("units > 1").groupBy(*by).agg(F.min(gain).alias("least_gain"))


def ladder(cube: DataFrame, alpha: float, epsilon: float, shifts: int = 4) -> DataFrame:
    """source, target, source_action, rungs, cheapest and first eligible rungs: the source's action shifted up, a rung counted once.

    Failures are of the action or the endpoint; alpha is divided by the number of shifts.
    """
    rows = judged(counts(cube).filter("size = 'full'"), {"each": alpha / N, "shifted": alpha / shifts}, epsilon)
    source = rows.filter("role = 'design'").groupBy(F.col("build").alias("source")).agg(F.coalesce(F.min(F.when(F.col("fa") <= F.col("each"), F.col("action_idx"))), F.lit(END)).alias("source_action"))
    rung = source.select("source", "source_action", F.explode(F.sequence(F.lit(0), F.lit(shifts - 1))).alias("shift")).withColumn("action_idx", F.least(F.col("source_action") + F.col("shift"), F.lit(END)))
    rung = rung.groupBy("source", "source_action", "action_idx").agg(F.min("shift").alias("shift"))
    target = rows.filter("role = 'selection'").select(F.col("build").alias("target"), "action_idx", "cost", (F.col("fa") <= F.col("shifted")).alias("ok"))
    both = rung.join(target, "action_idx").filter("source <> target")
    best = F.min(F.when(F.col("ok"), F.struct("cost", "shift", "action_idx")))
    first = F.min(F.when(F.col("ok"), F.struct("shift", "action_idx")))
    chosen = both.groupBy("source", "target", "source_action").agg(F.count("*").alias("rungs"), best.alias("b"), first.alias("f"))
    return chosen.select("source", "target", "source_action", "rungs", F.col("b.shift").alias("cheapest_shift"), F.coalesce("b.action_idx", F.lit(END)).alias("cheapest_action"), F.coalesce("f.action_idx", F.lit(END)).alias("first_action"), F.col("b").isNotNull().alias("passed"))


def compared(cube: DataFrame, alpha: float, epsilon: float) -> DataFrame:
    """arm, source (NULL for target-wide arms), target, selected, decision, executed: one fixed and one global decision a target, three a pair."""
    rows = judged(counts(cube).filter("size = 'full'"), {"each": alpha / N, "half_alpha": alpha / 2}, epsilon)
    globals_ = rows.filter("role = 'selection'").groupBy(F.col("build").alias("target")).agg(F.coalesce(F.min(F.when(F.col("fa") <= F.col("each"), F.col("action_idx"))), F.lit(END)).alias("selected"))
    none = F.lit(None).cast("int")
    fixed = globals_.select(F.lit("fixed_endpoint").alias("arm"), none.alias("source"), "target", F.lit(END).alias("selected"))
    wide = globals_.select(F.lit("target_global").alias("arm"), none.alias("source"), "target", "selected")
    named = F.array(*[F.struct(F.lit(a).alias("arm"), c.alias("selected")) for a, c in (("source_reuse", F.col("source_action")), ("one_rung", F.least(F.col("source_action") + 1, F.lit(END))), ("selected_ladder", F.col("cheapest_action")))])
    pairs = ladder(cube, alpha, epsilon).select("source", "target", F.explode(named).alias("x")).select("x.arm", "source", "target", "x.selected")
    proposals = fixed.unionByName(wide).unionByName(pairs)
    cert = rows.filter("role = 'certification'").select(F.col("build").alias("target"), F.col("action_idx").alias("selected"), (F.col("fa") <= F.col("half_alpha")).alias("ok"))
    end = cert.filter(F.col("selected") == END).select("target", F.col("ok").alias("end_ok"))
    done = proposals.join(cert, ["target", "selected"]).join(end, "target")
    decision = policy.three_way(F.col("end_ok"), F.col("ok"), ("ABSTAIN", "ACCEPT", "FALLBACK"))
    return done.select("arm", "source", "target", "selected", decision.alias("decision"), F.when(decision == "ACCEPT", F.col("selected")).when(decision == "FALLBACK", F.lit(END)).alias("executed"))


# --- refreshed indexes -------------------------------------------------------------------------------------

REFRESH = ("FIXED_ENDPOINT", "SOURCE_POOL_REUSE", "AUDITED_WITH_FALLBACK", "SELECTION_RECALIBRATED")


def pools(cube: DataFrame) -> DataFrame:
    """target, query_id, pool: the largest first passing action of all other builds (the endpoint where one has none)."""
    first = policy.labels(cube).select("build", "query_id", F.coalesce("first_pass", F.lit(END)).alias("label"))
    return policy.history_max(first).select("target", "query_id", F.col("source_max").alias("pool"))


def refresh(cube: DataFrame, alpha: float, epsilon: float) -> DataFrame:
    """dataset, build, method, shift, deployable, fallback, query_id, hits, ndc, end_ndc and profile: every evaluation row.

    The pool's action is reused, audited with the endpoint as fallback, or shifted by the least shift that
    passes on the selection role.  Datasets are the even and the odd queries.
    """
    own = cube.withColumnRenamed("build", "target")
    shifts = F.explode(F.sequence(F.lit(0), F.lit(END)))
    moved = pools(cube).select("target", "query_id", "pool", shifts.alias("shift")).withColumn("action_idx", F.least(F.col("pool") + F.col("shift"), F.lit(END)))
    met = moved.join(own, ["target", "query_id", "action_idx"]).withColumn("role", policy.role()).withColumn("dataset", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    by = met.filter("role <> 'evaluation'").groupBy("dataset", "target", "role", "shift").agg(F.count("*").alias("n"), F.count(F.when(F.col("hits") < K, 1)).alias("f"))
    ok = by.join(policy.limits(by, {"most": alpha}, (epsilon,)).drop("epsilon"), "n").withColumn("ok", F.col("f") <= F.col("most"))
    on = ["dataset", "target"]
    shift = ok.filter("role = 'selection'").groupBy(*on).agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("shift"))), F.lit(END)).alias("chosen"))
    cert = ok.filter("role = 'certification'").select(*on, "shift", "ok")
    # Shifted by END every action is the endpoint.
    at = lambda name, s: cert.filter(F.col("shift") == s).select(*on, F.col("ok").alias(name))
    recalibrated = cert.join(shift, on).filter("shift = chosen").select(*on, "chosen", F.col("ok").alias("shifted_ok"))
    state = at("pool_ok", 0).join(at("end_ok", END), on).join(recalibrated, on)
    pool_ok, end_ok, shifted_ok = F.col("pool_ok"), F.col("end_ok"), F.col("shifted_ok")
    row = lambda m, s, d, f: F.struct(F.lit(m).alias("method"), s.cast("int").alias("shift"), d.alias("deployable"), f.alias("fallback"))
    no = F.lit(False)
    methods = F.array(
        row(REFRESH[0], F.lit(END), end_ok, no),
        row(REFRESH[1], F.lit(0), pool_ok, no),
        row(REFRESH[2], F.when(pool_ok, 0).otherwise(END), pool_ok | end_ok, ~pool_ok),
        row(REFRESH[3], F.when(shifted_ok, F.col("chosen")).otherwise(END), shifted_ok | end_ok, ~shifted_ok),
    )
    plan = state.select(*on, "chosen", F.explode(methods).alias("m")).select(*on, "chosen", "m.*")
    first = policy.labels(cube).select("build", "query_id", F.coalesce("first_pass", F.lit(END)).alias("stop"))
    profile = cube.join(first, ["build", "query_id"]).filter(F.col("action_idx") <= F.col("stop")).groupBy("build", "query_id").agg(F.sum("ndc").alias("spent"))
    others = profile.groupBy("query_id").agg(F.sum("spent").alias("all")).join(profile, "query_id").select(F.col("build").alias("target"), "query_id", (F.col("all") - F.col("spent")).alias("profile"))
    rows = met.filter("role = 'evaluation'").join(plan, [*on, "shift"])
    end = own.filter(F.col("action_idx") == END).select("target", "query_id", F.col("ndc").alias("end_ndc"))
    done = rows.join(end, ["target", "query_id"]).join(others, ["target", "query_id"])
    spent = F.when(F.col("method") == REFRESH[0], 0).otherwise(F.col("profile"))
    return done.select("dataset", F.col("target").alias("build"), "method", F.when(F.col("method") == REFRESH[3], F.col("chosen")).otherwise(0).alias("chosen_shift"), "deployable", "fallback", "query_id", "action_idx", "hits", "ndc", "end_ndc", spent.alias("profile"))


def refresh_builds(rows: DataFrame) -> DataFrame:
    """A row for each build and method: failures, risk, cost and its tail, and the repeats after which profiling is repaid."""
    q = lambda p: F.percentile("ndc", F.lit(p))
    saving = F.sum("end_ndc") - F.sum("ndc")
    out = rows.groupBy("dataset", "build", "method", "chosen_shift", "deployable", "fallback").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("hits") < K, 1)).alias("failures"), F.avg("ndc").alias("mean"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.sum("profile").alias("profile"), saving.alias("saving"), F.avg("end_ndc").alias("end_mean")
    )
    return out.withColumns({"risk": F.col("failures") / F.col("n"), "break_even": F.when(F.col("saving") > 0, F.col("profile") / F.col("saving"))})


def refresh_summary(rows: DataFrame) -> DataFrame:
    """A row for each dataset and method; gains when each build, or the one of the largest gain, is left out."""
    by = ["dataset", "method"]
    builds = refresh_builds(rows)
    tails = rows.groupBy(*by).agg(F.avg(F.when(F.col("hits") < K, 1.0).otherwise(0.0)).alias("risk"), F.avg("ndc").alias("mean"), F.percentile("ndc", F.lit(0.95)).alias("p95"), F.percentile("end_ndc", F.lit(0.95)).alias("end_p95"), (1 - F.avg("ndc") / F.avg("end_ndc")).alias("gain"))
    best = builds.groupBy(*by).agg(F.max_by("build", F.struct(1 - F.col("mean") / F.col("end_mean"), -F.col("build"))).alias("best"), F.count(F.when(F.col("deployable"), 1)).alias("certified"), F.count(F.when(F.col("fallback"), 1)).alias("fallbacks"), F.count("*").alias("builds"), F.median("break_even").alias("median_break_even"), F.max("break_even").alias("max_break_even"))
    rest = rows.join(best.select(*by, "best"), by).filter("build <> best").groupBy(*by).agg((1 - F.avg("ndc") / F.avg("end_ndc")).alias("gain_without_best"))
    out = tails.join(best.drop("best"), by).join(leave_one_out(rows, by, "build"), by).join(rest, by)
    return out.withColumn("tail_ok", F.col("p95") <= F.col("end_p95"))


def refresh_gate(summary: DataFrame, epsilon: float, least_gain: float = 0.05) -> DataFrame:
    """One row: whether some adaptive method passes every condition on every dataset."""
    ok = (F.col("certified") == F.col("builds")) & (F.col("risk") <= epsilon) & (F.col("gain") >= least_gain) & F.col("tail_ok") & (F.col("least_gain") > 0) & (F.col("gain_without_best") > 0)
    each = summary.filter(F.col("method").isin(*REFRESH[2:])).groupBy("method").agg(F.bool_and(ok).alias("ok"))
    return each.agg(F.bool_or("ok").alias("passed"), F.count(F.when(F.col("ok"), 1)).alias("methods"))


# --- transfers by a multiplier -----------------------------------------------------------------------------


def multiplier_transfer(cube: DataFrame, labelled: DataFrame, grid, tolerance: float = 0.001) -> DataFrame:
    """source, target, multiplier, regret, recall_delta: the least multiple of the source's budgets that keeps the target's recall.

    Candidates are the ratios of grid budgets to the source's budgets on design queries; a multiplied budget
    is rounded up to the grid, its last value at most.
    """
    top = len(grid) - 1
    value = lambda i: F.element_at(F.array(*[F.lit(g) for g in grid]), i + 1)
    role = F.when(F.col("query_id") % 5 == 0, "design").otherwise("confirm")
    demand = labelled.select("build", "query_id", value(F.least("label", F.lit(top))).cast("double").alias("b"))
    rows = cube.withColumn("role", role)
    fixed = rows.filter("role = 'design'").groupBy("build", "action_idx").agg(F.avg(F.col("hits") / K).alias("r")).groupBy("build").agg(F.coalesce(F.min(F.when(F.col("r") >= 0.9, F.col("action_idx"))), F.lit(top)).alias("fixed"))
    base = rows.filter("role = 'design'").join(fixed, "build").filter("action_idx = fixed").groupBy("build").agg(F.avg(F.col("hits") / K).alias("base"))
    asked = demand.filter(F.col("query_id") % 5 == 0).select("build", "b").distinct()
    ratios = asked.select(F.col("build").alias("source"), F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("g"), "b").select("source", (F.col("g") / F.col("b")).alias("a")).distinct()

    def rung(x: Column) -> Column:
        return F.coalesce(*[F.when(F.lit(float(g)) >= x, F.lit(i)) for i, g in enumerate(grid)], F.lit(top))

    design = demand.filter(F.col("query_id") % 5 == 0).withColumnRenamed("build", "source").join(ratios, "source").withColumn("action_idx", rung(F.col("a") * F.col("b")))
    tried = design.join(cube.select(F.col("build").alias("target"), "query_id", "action_idx", "hits"), ["query_id", "action_idx"]).filter("source <> target").groupBy("source", "target", "a").agg(F.avg(F.col("hits") / K).alias("r"))
    chosen = tried.join(base.withColumnRenamed("build", "target"), "target").groupBy("source", "target").agg(F.coalesce(F.min(F.when(F.col("r") >= F.col("base") - tolerance, F.col("a"))), F.max("a")).alias("multiplier"))
    confirm = demand.filter(F.col("query_id") % 5 != 0).withColumnRenamed("build", "source").join(chosen, "source").withColumn("action_idx", rung(F.col("multiplier") * F.col("b")))
    own = cube.withColumnRenamed("build", "target")
    best = labelled.select(F.col("build").alias("target"), "query_id", F.least("label", F.lit(top)).alias("action_idx")).join(own, ["target", "query_id", "action_idx"]).select("target", "query_id", F.col("ndc").alias("oracle_ndc"))
    at_fixed = own.join(fixed.withColumnRenamed("build", "target"), "target").filter("action_idx = fixed").select("target", "query_id", F.col("ndc").alias("fixed_ndc"), F.col("hits").alias("fixed_hits"))
    met = confirm.join(own, ["target", "query_id", "action_idx"]).join(best, ["target", "query_id"]).join(at_fixed, ["target", "query_id"])
    return met.groupBy("source", "target", "multiplier").agg(F.avg((F.col("ndc") - F.col("oracle_ndc")) / F.col("fixed_ndc")).alias("regret"), F.avg((F.col("hits") - F.col("fixed_hits")) / K).alias("recall_delta"))
