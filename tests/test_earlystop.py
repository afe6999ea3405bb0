"""Predicted stops against a plain replay of every query, and what a fitted model saves."""

import math

import numpy as np
import pytest

from rungwise.operators import earlystop, indexes, lists, search


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, e array<double>")


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 6))
    base = frame(spark, x)
    centres = indexes.kmeans(base, indexes.picks(base, 16), rounds=5)[0]
    return x, base, centres, lists.with_lists(base, centres)


def replay(x, q, own, centres, model, target, k, rounds):
    """(rounds, read, predicted, neighbours) of one query, list by list."""
    d = ((centres - x[q]) ** 2).sum(axis=1)
    order = np.argsort(d, kind="stable")
    known, read = [], 0
    for r in range(1, rounds + 1):
        here = np.flatnonzero(own == order[r - 1])
        read += len(here)
        known = sorted(known + [(((x[b] - x[q]) ** 2).sum(), int(b), r) for b in here if b != q])[:k]
        ahead = d[order[min(r, len(order) - 1)]]
        fresh = sum(n[2] == r for n in known) / k
        reach = known[-1][0] / ahead if len(known) == k and ahead > 0 else 0.0
        predicted = model[0] + model[1] * math.log1p(read) + model[2] * fresh + model[3] * reach
        if predicted >= target:
            break
    return r, read, predicted, [n[1] for n in known]


@pytest.mark.parametrize("target", [0.5, 0.8, 9.0, -9.0])
def test_stops_against_a_replay(spark, made, target):
    x, base, centres, members = made
    model = [-0.2, 0.25, -0.2, -0.05]
    found, ended = earlystop.search_until(members, base.filter("vec_id % 20 = 0"), centres, model, target, 5, 6)
    own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    got = {r["query_id"]: (r["rounds"], r["read"], r["predicted"]) for r in ended.collect()}
    near = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        near.setdefault(r["query_id"], []).append(r["base_id"])
    for q in range(0, 600, 20):
        rounds, read, predicted, neighbours = replay(x, q, own, centres, model, target, 5, 6)
        assert got[q] == (rounds, read, pytest.approx(predicted)) and near[q] == neighbours
    assert len(got) == 30 and (target not in (0.5, 0.8) or len({v[0] for v in got.values()}) > 1)


def test_a_fitted_model_saves_reads(spark, made):
    x, base, centres, members = made
    truth = search.exact_knn(base, base).select("query_id", "base_id")
    learn, asked = base.filter("vec_id % 4 = 1"), base.filter("vec_id % 4 = 0")
    model = earlystop.fitted(members, learn, truth, centres, rounds=10)
    assert len(model) == 1 + len(earlystop.FEATURES)
    results = {}
    for target in (0.8, 0.95, 99.0):
        found, ended = earlystop.search_until(members, asked, centres, model, target, rounds=10)
        mean = np.mean([r["recall"] for r in earlystop.recall(found, truth, asked).collect()])
        rows = ended.collect()
        results[target] = mean, np.mean([r["read"] for r in rows])
        assert len(rows) == 150
    # Higher targets read more and find more; the predictions hold on queries that the fit hasn't seen.
    assert results[0.8][1] < results[0.95][1] < results[99.0][1] and results[0.8][0] <= results[0.95][0] <= results[99.0][0]
    assert results[0.8][0] > 0.75 and results[0.95][0] > 0.88 and results[0.8][1] < 0.7 * results[99.0][1]


def test_no_queries_and_queries_without_neighbours(spark, made):
    x, base, centres, members = made
    found, ended = earlystop.search_until(members, base.limit(0), centres, [0.0] * 4, 0.5)
    assert found.count() == ended.count() == 0
    lone = members.filter("vec_id = 7")
    found, ended = earlystop.search_until(lone, base.filter("vec_id = 7"), centres, [0.0] * 4, 0.5, rounds=3)
    assert found.count() == 0 and ended.first()["rounds"] == 3
    assert [r["recall"] for r in earlystop.recall(found, lone.selectExpr("vec_id AS query_id", "vec_id AS base_id"), lone).collect()] == [0.0]
