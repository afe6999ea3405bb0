"""Partitions of queries by what other builds say of them, and what a common budget in each cell costs.

``keys`` rows are (target, query_id, summary, key, ord): the cell of a query, and its place where cells are
ordered.  ``choices`` rows are (target, query_id, criterion, action_idx, ok, ndc).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.operators.policy import END, N, history_max
from rungwise.operators.search import GRID, K


def summaries(labelled: DataFrame) -> DataFrame:
    """keys of four kinds: all other builds' labels, their largest, that as an action, and each one's own."""
    lists = labelled.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("build", "label"))).alias("v"))
    each = lists.select("query_id", F.explode("v").alias("t"), "v").select(F.col("t.build").alias("target"), "query_id", F.filter("v", lambda s: s["build"] != F.col("t.build")).alias("v"))
    most = F.array_max(F.transform("v", lambda s: s["label"]))
    text = lambda c: c.cast("string")

    def row(summary: Column, key: Column, place: Column) -> Column:
        return F.struct(summary.alias("summary"), key.alias("key"), place.cast("int").alias("ord"))

    vector = row(F.lit("vector"), F.array_join(F.transform("v", lambda s: text(s["label"])), ","), F.lit(None))
    action = F.least(most, F.lit(END))
    whole = F.array(vector, row(F.lit("max"), text(most), most), row(F.lit("action"), text(action), action))
    single = F.transform("v", lambda s: row(F.concat(F.lit("single:"), text(s["build"])), text(s["label"]), s["label"]))
    return each.select("target", "query_id", F.explode(F.concat(whole, single)).alias("s")).select("target", "query_id", "s.*")


def subsets(rows: DataFrame, solvable: Column) -> DataFrame:
    """``rows`` once as the subset all, and once more, where their endpoint is safe, as endpoint_solvable."""
    named = F.when(solvable, F.array(F.lit("all"), F.lit("endpoint_solvable"))).otherwise(F.array(F.lit("all")))
    return rows.withColumn("subset", F.explode(named))


def choices(cube: DataFrame, labelled: DataFrame) -> DataFrame:
    """choices by both criteria: safe at the action, or in the safe tail."""
    own = labelled.select("build", "query_id", "label")
    both = F.array(F.struct(F.lit("actual").alias("criterion"), (F.col("hits") == K).alias("ok")), F.struct(F.lit("stable_tail").alias("criterion"), (F.col("action_idx") >= F.col("label")).alias("ok")))
    # Merged: a cube's rows pack so well that Spark would take hundreds of thousands of labels for a small table, and broadcast them.
    return cube.join(own.hint("merge"), ["build", "query_id"]).select(F.col("build").alias("target"), "query_id", "label", "action_idx", "ndc", F.explode(both).alias("b")).select("target", "query_id", "label", "action_idx", "ndc", "b.*")


def objectives(keys: DataFrame, options: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """For each group ``by`` (which names summary): costs of the best single, common and ordered actions, and what has none.

    ``keys`` and ``options`` share target, query_id and the rest of ``by``.  An objective is NULL if a query
    or cell has no action; the ordered one's actions must not fall along the cells, which a fold keeps: for
    each action the least cost so far of ending there.
    """
    group = list(by)
    on = ["target", "query_id", *[c for c in by if c in options.columns and c in keys.columns and c != "target"]]
    rows = keys.join(options.hint("merge"), on)
    costs = rows.groupBy(*group, "key", "ord", "action_idx").agg(F.bool_and("ok").alias("ok"), F.sum("ndc").alias("cost"), F.count("*").alias("n"))
    cells = costs.groupBy(*group, "key", "ord").agg(F.min(F.when(F.col("ok"), F.col("cost"))).alias("best"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("action_idx", F.when(F.col("ok"), F.col("cost").cast("double")).otherwise(F.lit(float("inf"))).alias("c")))).alias("row"))
    start = F.transform(F.sequence(F.lit(0), F.lit(END)), lambda i: F.lit(0.0))
    step = lambda best, cell: F.transform(cell["c"], lambda c, a: c + F.array_min(F.slice(best, F.lit(1), a + 1)))
    ordered = F.array_sort(F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("ord", F.transform("row", lambda r: r["c"]).alias("c")))))
    whole = cells.groupBy(*group).agg(
        F.sum("best").alias("best"),
        F.sum("n").alias("n_query"),
        (F.count("*") - F.count("best")).alias("infeasible_cells"),
        F.coalesce(F.sum(F.when(F.col("best").isNull(), F.col("n"))), F.lit(0)).alias("queries_in_infeasible_cells"),
        ordered.alias("cells"),
    )
    folded = F.when(F.size("cells") > 0, F.array_min(F.aggregate("cells", start, step)))
    feasible = F.col("infeasible_cells") == 0
    single = rows.groupBy(*group, "query_id").agg(F.min(F.when(F.col("ok"), F.col("ndc"))).alias("c")).groupBy(*group).agg(F.when(F.count("c") == F.count("*"), F.avg("c")).alias("j_identity"), (F.count("*") - F.count("c")).alias("individually_infeasible"))
    j_summary = F.when(feasible, F.col("best") / F.col("n_query"))
    j_order = F.when(feasible & (folded < float("inf")), folded / F.col("n_query"))
    out = whole.select(*group, "n_query", j_summary.alias("j_summary"), j_order.alias("j_order"), "infeasible_cells", "queries_in_infeasible_cells").join(single, group)
    gaps = {"information_gap": F.col("j_summary") - F.col("j_identity"), "order_gap": F.col("j_order") - F.col("j_summary")}
    return out.withColumns(gaps)


def coverage(keys: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Cells and the queries in single, mixed, finite mixed, finite and endless, and endless cells; ``keys`` hold label."""
    group = list(by)
    finite = F.col("label") < N
    cell = keys.groupBy(*group, "key").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k"), F.count_distinct(F.when(finite, F.col("label"))).alias("f"), F.bool_or(~finite).alias("endless"))
    queries = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return cell.groupBy(*group).agg(
        F.sum("n").alias("n_query"),
        F.count("*").alias("n_cell"),
        F.max("n").alias("max_cell_size"),
        queries(F.col("n") == 1).alias("singleton"),
        queries(F.col("k") > 1).alias("mixed"),
        F.count(F.when(F.col("k") > 1, 1)).alias("mixed_cells"),
        queries(F.col("f") > 1).alias("finite_mixed"),
        queries((F.col("f") > 0) & F.col("endless")).alias("finite_endless_mixed"),
        queries(F.col("f") == 0).alias("all_endless"),
    )


def budget(label: Column) -> Column:
    return F.when(label.isNotNull(), F.element_at(F.array(*[F.lit(g) for g in GRID]), label + 1))


def budgets(keys: DataFrame) -> DataFrame:
    """target, summary: mean budgets of each query's own label, its cell's largest, and the running largest of ordered cells."""
    cell = keys.groupBy("target", "summary", "key", "ord").agg(F.count("*").alias("n"), F.max("label").alias("top"), F.sum("label").alias("own"), F.sum(budget(F.col("label"))).alias("own_budget"))
    running = F.max("top").over(Window.partitionBy("target", "summary").orderBy("ord"))  # a row a cell
    placed = cell.withColumn("run", F.when(F.col("ord").isNotNull(), running))
    total = lambda c: F.sum(c * F.col("n"))
    n = F.sum("n")
    return placed.groupBy("target", "summary").agg(
        n.alias("n_query"),
        (F.sum("own_budget") / n).alias("mean_individual_budget"),
        (total(budget(F.col("top"))) / n).alias("mean_common_budget"),
        (total(budget(F.col("run"))) / n).alias("mean_ordered_budget"),
        ((total(F.col("top")) - F.sum("own")) / n).alias("mean_rank_gap"),
        (total(F.col("run") - F.col("top")) / n).alias("mean_order_rank_gap"),
    )


def learned_mapping(cube: DataFrame, labelled: DataFrame, role: Column, support: int = 5) -> DataFrame:
    """target, mapping, n, mapped, failures, mean_ndc on evaluation queries: actions learned for cells of design queries.

    A cell of ``support`` design queries and more gets the action of least mean cost that was safe for all of
    them, ties to the lower; all others get the endpoint.
    """
    keys = summaries(labelled).filter("summary IN ('vector', 'max')").withColumn("role", role)
    rows = keys.join(cube.select(F.col("build").alias("target"), "query_id", "action_idx", "hits", "ndc"), ["target", "query_id"])
    seen = rows.filter("role = 'design'").groupBy("target", "summary", "key", "action_idx").agg(F.count("*").alias("n"), F.bool_and(F.col("hits") == K).alias("ok"), F.avg("ndc").alias("cost"))
    chosen = seen.filter((F.col("n") >= support) & F.col("ok")).groupBy("target", "summary", "key").agg(F.min(F.struct("cost", "action_idx")).alias("m")).select("target", "summary", "key", F.col("m.action_idx").alias("chosen"))
    asked = rows.filter("role = 'evaluation'").join(chosen, ["target", "summary", "key"], "left").filter(F.col("action_idx") == F.coalesce("chosen", F.lit(END)))
    return asked.groupBy("target", F.col("summary").alias("mapping")).agg(F.count("*").alias("n"), F.count("chosen").alias("mapped"), F.count(F.when(F.col("hits") < K, 1)).alias("failures"), F.avg("ndc").alias("mean_ndc"))


def envelopes(labelled: DataFrame) -> DataFrame:
    """source, target, cells, mixed_cells, identical, zero_cost: each source cell's largest target label against the own ones."""
    s, t = labelled.alias("s"), labelled.alias("t")
    both = s.join(t, (F.col("s.query_id") == F.col("t.query_id")) & (F.col("s.build") != F.col("t.build")))
    cell = both.groupBy(F.col("s.build").alias("source"), F.col("t.build").alias("target"), F.col("s.label").alias("cell"), F.col("t.label").alias("label")).agg(F.count("*").alias("n"))
    top = cell.groupBy("source", "target", "cell").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max_by("n", "label").alias("same"))
    return top.groupBy("source", "target").agg(F.count("*").alias("cells"), F.count(F.when(F.col("k") > 1, 1)).alias("mixed_cells"), F.sum("same").alias("identical"), (F.sum("same") == F.sum("n")).alias("zero_cost"))


def bridge(cube: DataFrame, labelled: DataFrame, locked: DataFrame, role: Column) -> DataFrame:
    """target, policy (candidate or locked): failures, tail violations, mean budget and cost on evaluation queries."""
    own = labelled.select(F.col("build").alias("target"), "query_id", "label")
    hm = history_max(labelled).withColumn("role", role).filter("role = 'evaluation'").drop("role").join(own, ["target", "query_id"]).join(F.broadcast(locked.select("target", "decision")), "target")  # a row a build
    action = F.least("source_max", F.lit(END))
    policies = F.array(F.struct(F.lit("candidate").alias("policy"), action.alias("action_idx")), F.struct(F.lit("locked").alias("policy"), F.when(F.col("decision") == "CANDIDATE", action).otherwise(F.lit(END)).alias("action_idx")))
    rows = hm.select("target", "query_id", "label", "decision", F.explode(policies).alias("p")).select("target", "query_id", "label", "decision", "p.*")
    done = rows.join(cube.withColumnRenamed("build", "target"), ["target", "query_id", "action_idx"])
    fails, violates = F.col("hits") < K, F.col("action_idx") < F.col("label")
    return done.groupBy("target", "policy", "decision").agg(
        F.count("*").alias("n_query"),
        F.count(F.when(fails, 1)).alias("failures"),
        F.count(F.when(violates, 1)).alias("tail_violations"),
        F.avg(budget(F.col("action_idx"))).alias("mean_budget"),
        F.avg("ndc").alias("mean_ndc"),
        (~F.bool_or(fails)).alias("zero_failure"),
        (~F.bool_or(violates)).alias("zero_violation"),
    )
