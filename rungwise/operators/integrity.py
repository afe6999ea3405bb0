"""Checks that say what is wrong instead of stopping, and JSON documents compared by value."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.operators import policy


def json_differs(a, b, tolerance: float = 1e-12) -> bool:
    """Whether two parsed documents differ: keys, lengths, types and whole numbers exactly, other numbers within a tolerance."""
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None or isinstance(a, str) or isinstance(b, str):
        return type(a) is not type(b) or a != b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() != b.keys() or any(json_differs(a[k], b[k], tolerance) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) != len(b) or any(json_differs(x, y, tolerance) for x, y in zip(a, b))
    if isinstance(a, int) and isinstance(b, int):
        return a != b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return not math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
    return True


def documents_differ(a: Column | str, b: Column | str) -> Column:
    """The same for two columns of JSON texts; a missing document differs from any other but a missing one."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([(x is None) != (y is None) or (x is not None and json_differs(json.loads(x), json.loads(y))) for x, y in zip(left, right)], dtype=bool)

    return run(a, b)


def count_if(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


def truth_checks(found: DataFrame, queries: DataFrame, base: DataFrame, k: int, tolerance: float = 1e-4) -> DataFrame:
    """One row of counts: neighbours not in the base, selves, repeats, scores that aren't finite or fall, queries of too few rows."""
    ids = base.select(F.col("vec_id").alias("base_id"), F.lit(True).alias("known"))
    w = F.lead("score").over(Window.partitionBy("query_id").orderBy("rank"))
    rows = found.join(ids, "base_id", "left").withColumn("next", w)
    finite = ~F.isnan("score") & (F.abs("score") < float("inf"))
    main = rows.agg(count_if(F.col("known").isNull(), "unknown"), count_if(F.col("query_id") == F.col("base_id"), "selves"), count_if(~finite, "not_finite"), count_if(F.col("next") - F.col("score") < -tolerance, "falling"))
    per = found.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("base_id").alias("d"))
    asked = queries.select(F.col("vec_id").alias("query_id")).join(per, "query_id", "left")
    sizes = asked.agg(count_if(F.coalesce("n", F.lit(0)) != k, "short"), count_if(F.col("n") != F.col("d"), "repeated"))
    return main.crossJoin(sizes)  # single rows


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of one side only, of both, and keys that a side has twice."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("l")), right.groupBy(*keys).agg(F.count("*").alias("r"))
    rows = a.join(b, keys, "full")
    return rows.agg(count_if(F.col("r").isNull(), "left_only"), count_if(F.col("l").isNull(), "right_only"), count_if(F.col("l").isNotNull() & F.col("r").isNotNull(), "both"), count_if((F.col("l") > 1) | (F.col("r") > 1), "repeated"))


def same_columns(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """What differs between a table's header and the expected one: order, names and types."""
    have = dict(df.dtypes)
    out = [f"{c}: {have.get(c)} for {t}" for c, t in expected.items() if have.get(c) != t]
    out += [f"{c}: not expected" for c in have if c not in expected]
    return out + (["order"] if not out and list(have) != list(expected) else [])


def loaded_role(cube: DataFrame, role: str, builds: list[int], actions: list[int]) -> DataFrame:
    """query_id, build, hits, ndc (arrays by action) and label of one role's queries, its axes checked.

    An error unless the role's rows have exactly the given builds and actions and every (build, action,
    query) cell once. The label is the first action from which on all are safe, or their number.
    """
    rows = cube.filter(policy.role() == role).select("build", "action_idx", "query_id", "hits", "ndc")
    axes = rows.agg(F.sort_array(F.collect_set("build")).alias("b"), F.sort_array(F.collect_set("action_idx")).alias("a")).first()
    if list(axes["b"]) != sorted(builds) or list(axes["a"]) != sorted(actions):
        raise ValueError(f"builds {axes['b']} and actions {axes['a']} where {builds} and {actions} are declared")
    lists = rows.groupBy("query_id", "build").agg(F.array_sort(F.collect_list(F.struct("action_idx", "hits", "ndc"))).alias("x"))
    wrong = lists.filter(F.transform("x", lambda r: r["action_idx"].cast("int")) != F.array(*[F.lit(a) for a in sorted(actions)]))
    uneven = lists.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") != len(builds))
    if not wrong.isEmpty() or not uneven.isEmpty():
        raise ValueError("a cell is missing or occurs twice")
    made = lists.join(policy.labels(rows).select("query_id", "build", "label"), ["query_id", "build"])
    return made.select("query_id", "build", F.col("x.hits").alias("hits"), F.col("x.ndc").alias("ndc"), "label")
