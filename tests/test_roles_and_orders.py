"""A role's slice with its axes checked, and places in an order by ranges."""

import pytest
from pyspark.sql import functions as F

from rungwise.operators import integrity, storage
from rungwise.operators.search import K


@pytest.fixture(scope="module")
def cube(spark):
    rows = [(b, a, q, K if a >= (q + b) % 4 else K - 1, 10 * a + b) for b in (1, 2) for a in range(3) for q in range(12)]
    return spark.createDataFrame(rows, "build int, action_idx int, query_id long, hits long, ndc long")


def test_a_role_with_its_labels(spark, cube):
    got = {(r["query_id"], r["build"]): (list(r["hits"]), list(r["ndc"]), r["label"]) for r in integrity.loaded_role(cube, "certification", [1, 2], [0, 1, 2]).collect()}
    assert set(got) == {(q, b) for q in (2, 7) for b in (1, 2)}
    for (q, b), (hits, ndc, label) in got.items():
        first = (q + b) % 4
        assert hits == [K if a >= first else K - 1 for a in range(3)] and ndc == [b, 10 + b, 20 + b]
        assert label == first


@pytest.mark.parametrize("change", ["builds", "actions", "missing", "twice"])
def test_axes_that_differ_are_errors(spark, cube, change):
    one = (F.col("build") == 2) & (F.col("action_idx") == 1) & (F.col("query_id") == 7)
    given = cube.filter(~one) if change == "missing" else cube.unionByName(cube.filter(one)) if change == "twice" else cube
    with pytest.raises(ValueError, match="declared" if change in ("builds", "actions") else "missing or occurs twice"):
        integrity.loaded_role(given, "certification", [1, 2, 3] if change == "builds" else [1, 2], [0, 1] if change == "actions" else [0, 1, 2])


def test_places_in_an_order(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("vec_id"), (F.col("id") % 3).alias("norm"))
        got = storage.in_order(rows, "norm", F.desc("vec_id")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(((r["norm"], -r["vec_id"]) for r in got))
    assert [(r["norm"], -r["vec_id"]) for r in sorted(got, key=lambda r: r["place"])] == want and {r["place"] for r in got} == set(range(3000))
    assert storage.in_order(spark.range(0), "id").count() == 0
