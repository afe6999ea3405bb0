"""Descent against all pairs, and pruning against every way of two edges."""

import numpy as np

from rungwise.operators import descent


def frame(spark, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, e array<double>")


def test_recall_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    # A hub: one vector in the middle of clusters is near to very many.
    x = rng.normal(size=(500, 12)) + 4 * rng.normal(size=(10, 12))[rng.integers(0, 10, 500)]
    x[0], x[1] = x.mean(axis=0), x[2]
    edges, history = descent.nn_descent(frame(spark, x))
    got = {}
    for r in edges.collect():
        got.setdefault(r["id"], {})[r["other"]] = r["score"]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert set(got) == set(range(500)) and all(len(v) <= descent.KEPT and i not in v for i, v in got.items())
    assert all(abs(s - d[i, j]) < 1e-6 for i, v in got.items() for j, s in v.items())
    best = np.argsort(d, axis=1)[:, :10]
    recall = np.mean([j in got[i] for i in range(500) for j in best[i]])
    # Few changes at the end; never more pairs a node and round than its samples give.
    assert recall > 0.95 and history[-1][1] <= history[0][1] / 10
    assert all(pairs <= 500 * (4 * descent.SAMPLE) ** 2 / 2 for pairs, _ in history)


def test_small_and_empty_tables(spark):
    three = frame(spark, [[0.0], [1.0], [5.0]])
    edges, _ = descent.nn_descent(three, 2)
    assert {(r["id"], r["other"]) for r in edges.collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert descent.nn_descent(three.limit(0))[0].count() == 0


def test_pruning_against_all_ways(spark):
    rng = np.random.default_rng(3)
    edges = {}
    for i in range(40):
        for j in rng.choice(40, 6, replace=False).tolist():
            if i != j:
                edges[i, j] = edges.get((j, i), float(rng.integers(1, 9)))
    df = spark.createDataFrame([(i, j, s) for (i, j), s in edges.items()], "id long, other long, score double")
    between = lambda a, b: edges.get((a, b), edges.get((b, a), np.inf))
    want = {(i, j) for (i, j), s in edges.items() if not any(edges[i, w] < s and between(w, j) < s for (k, w) in edges if k == i and w != j)}
    assert {(r["id"], r["other"]) for r in descent.pruned(df).collect()} == want and 0 < len(want) < len(edges)


def test_a_round_sends_only_what_lists_have_room_for(spark, monkeypatch):
    """Few rounds after a start by pivots; a node gets a found edge only if its list has room; recall holds where pivots leave much open."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(600, 6)) + 3 * rng.normal(size=(30, 6))[rng.integers(0, 30, 600)]).astype(np.float32).astype(float)
    monkeypatch.setattr(descent, "PER_PIVOT", 6)
    monkeypatch.setattr(descent, "NEAREST", 2)
    monkeypatch.setattr(descent, "MEMBERS", 20)
    sent = []
    compared = descent._compared
    monkeypatch.setattr(descent, "_compared", lambda *a: sent.append((a[0].schema["es"].dataType.simpleString(), compared(*a))) or sent[-1][1])
    edges, history = descent.nn_descent(frame(spark, x))
    assert {kind for kind, _ in sent} == {"array<array<float>>"}
    rows = [found.count() for _, (found, _) in sent[1:]]
    # Without the bound every group gives each member up to KEPT edges, some ten times as many.
    assert len(rows) == len(history) and rows[-1] < 600 * descent.KEPT / 4
    got = {}
    for r in edges.collect():
        got.setdefault(r["id"], set()).add(r["other"])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert np.mean([j in got[i] for i in range(600) for j in np.argsort(d[i])[:10]]) > 0.95
    # Vectors that single precision would change stay as they are.
    fine = descent._narrow(frame(spark, [[0.1], [1.0]]))
    assert fine.schema["e"].dataType.simpleString() == "array<double>"
