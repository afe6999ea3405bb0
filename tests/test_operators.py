"""Analytic truths, brute force on tiny inputs, and negative controls."""

import time
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from itertools import product
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungwise.functions import distance
from rungwise.operators import graph, graphsearch, indexes, integrity, ledger, membership, partitions, policy, resample, search


def test_clopper_pearson():
    assert policy.upper_bound(0, 500, 0.05) == pytest.approx(1 - 0.05 ** (1 / 500))
    assert policy.upper_bound(7, 7, 0.05) == 1.0
    assert [policy.max_failures(n, 0.05, 0.05) for n in (50, 100, 125, 250, 500)] == [-1, 1, 2, 6, 16]
    for f in range(12):
        assert (policy.upper_bound(f, 125, 0.05) <= 0.1) == (f <= policy.max_failures(125, 0.05, 0.1))


def test_thresholds_against_the_binomial_sum():
    for n, alpha, epsilon in ((40, 0.05, 0.2), (125, 0.025, 0.35), (500, 0.05 / 11, 0.05), (7, 0.05, 0.05)):
        cdf = np.cumsum([comb(n, i) * epsilon**i * (1 - epsilon) ** (n - i) for i in range(n)])
        assert policy.max_failures(n, alpha, epsilon) == sum(c <= alpha for c in cdf) - 1
        assert all(policy.binomial_cdf(i, n, epsilon) == pytest.approx(cdf[i], abs=1e-12) for i in range(n))
    began = time.time()
    assert 45_000 < policy.max_failures(1_000_000, 0.05, 0.05) < 50_000 and time.time() - began < 1


def test_adjacency_errors_and_isolated_nodes(spark):
    directed = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 9)], "id long")
    assert tuple(graph.adjacency_stats(directed, nodes, 2).first()) == (4, 3, 2, 2, 2)
    for bad, limit in ((directed.union(spark.createDataFrame([(3, 3)], "src long, dst long")), None), (directed.union(spark.createDataFrame([(3, 4)], "src long, dst long")), None), (directed, 1)):
        with pytest.raises(ValueError):
            graph.adjacency_stats(bad, nodes, limit)


def test_greedy_avoids_a_direction_it_has():
    candidates = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert graph.greedy_neighbours(np.zeros(2), candidates, np.ones(3), 2) == [0, 2]
    with pytest.raises(ValueError):
        graph.greedy_neighbours(np.zeros(2), np.zeros((1, 2)), np.ones(1), 1)


def test_greedy_against_whole_determinants():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, lever = rng.normal(size=(6, 3)), rng.random(6)
        length = np.linalg.norm(x, axis=1)
        unit, near = x / length[:, None], np.exp(-((length / np.median(length)) ** 2))
        value = lambda rows: np.linalg.slogdet(np.eye(len(rows)) + unit[rows] @ unit[rows].T / 0.25)[1] if rows else 0.0
        chosen = []
        while len(chosen) < 4:
            gain = {i: lever[i] + value([*chosen, i]) - value(chosen) + near[i] for i in range(6) if i not in chosen}
            chosen.append(max(gain, key=lambda i: (gain[i], -i)))
        assert graph.greedy_neighbours(np.zeros(3), x, lever, 4) == chosen


def test_break_even_in_every_region(spark):
    cases = [("20", "10"), ("25", "10"), ("5", "-1"), ("-10", "-4"), ("-1", "2"), ("-1", "-4"), ("0.3", "0.1"), ("-3", "0"), ("3", "0"), ("-8", "-4"), ("-20", "3")]
    rows = spark.createDataFrame([(Decimal(b), Decimal(d)) for b, d in cases], "b decimal(20,6), d decimal(20,6)")
    got = rows.select(ledger.first_round(F.col("b"), F.col("d")), ledger.initial_region(F.col("b"), F.col("d")), ledger.last_initial_round(F.col("b"), F.col("d"))).collect()

    def want(b, d):
        b, d = Decimal(b), Decimal(d)
        first = max(1, int((b / d).to_integral_value(ROUND_FLOOR)) + 1) if d > 0 else 1 if b < 0 and d == 0 else None
        both = b < 0 and d < 0
        last = int((b / d).to_integral_value(ROUND_CEILING)) - 1 if both else 0
        return first, both and b / d > 1, last if last >= 1 else None

    assert [tuple(r) for r in got] == [want(b, d) for b, d in cases]


def test_missing_is_not_zero(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 5.0)], "k long, v double")
    b = spark.createDataFrame([(1, None), (2, 5.0 + 1e-12)], "k long, v double")
    assert [r["k"] for r in ledger.differences(a, b, ["k"]).collect()] == [1]


@pytest.mark.parametrize("metric", sorted(distance.METRICS))
def test_knn_paths_agree(spark, metric):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 70)), 1)
    x[7] = x[3]
    base = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, e array<double>")
    f, _, larger = distance.METRICS[metric]
    q, b = base.select(F.col("vec_id").alias("query_id"), F.col("e").alias("eq")), base.select(F.col("vec_id").alias("base_id"), F.col("e").alias("eb"))
    pairs = q.crossJoin(b).filter("query_id <> base_id").select("query_id", "base_id", F.round(f(F.col("eq"), F.col("eb")), 9).alias("score"))
    want = {}
    for r in sorted(pairs.collect(), key=lambda r: (r["query_id"], -r["score"] if larger else r["score"], r["base_id"])):
        want.setdefault(r["query_id"], []).append((r["base_id"], r["score"]))
    near = search.exact_knn(base, base, 4, metric)
    packed = search.paired(base, base, lambda *a: search._nearest(metric, 4, *a, False), "query_id long, base_id long, score double", 0)
    for rows in (near.collect(), search.top_k(packed, 4, larger).collect()):
        for i, top in want.items():
            got = sorted((r["rank"], r["base_id"], round(r["score"], 9)) for r in rows if r["query_id"] == i)
            assert [s for _, _, s in got] == pytest.approx([s for _, s in top[:4]], abs=1e-9)
            assert sum(g[1] == t[0] for g, t in zip(got, top)) == 4 or len({s for _, s in top[:5]}) < 5


def test_groups_ranges_and_ties_in_blocks(spark):
    x = [[0.0], [1.0], [1.0], [2.0], [5.0]]
    base = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, e array<double>")
    groups = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2), (4, None)], "vec_id long, label int")
    got = search.grouped_knn(base, groups, base, 2).filter("query_id = 3").orderBy("rank").collect()
    assert [(r["base_id"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0)]
    assert search.range_search(base, base, 1.5).filter("query_id = 3").count() == 2
    assert sorted(r["base_id"] for r in search.knn_with_ties(base, base, 1).filter("query_id = 0").collect()) == [1, 2]


def test_ties_are_counted_by_list(spark):
    x = np.random.default_rng(12).normal(size=(300, 5))
    base = spark.createDataFrame([(i * 3, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, e array<double>")
    z = base.select("vec_id", F.transform("e", lambda v: F.round(v / 2)).alias("e"))
    ties = search.knn_with_ties(z, z)
    assert ties.count() > 4 * search.K * 300  # all rows of which the cube of pairs was made
    want = search.response_cube(base, ties).withColumn("hits", F.least("hits", F.lit(search.K).cast("long")))
    got = search.tied_cube(base, z, search.exact_knn(z, z))
    assert sorted(got.collect()) == sorted(want.collect()) and got.columns == want.columns


def test_labels_are_not_broadcast(spark, capsys):
    cube = spark.createDataFrame([(b, a, q, 5, 10) for b in (1, 2) for a in range(3) for q in range(4)], "build int, action_idx int, query_id long, hits long, ndc long")
    labelled = policy.labels(cube)
    options = partitions.choices(cube, labelled)
    partitions.objectives(partitions.summaries(labelled).withColumn("subset", F.lit("all")), options, ("target", "subset", "summary", "criterion")).explain()
    plan = capsys.readouterr().out
    # The last join's sides have a row a group.
    assert plan.count("SortMergeJoin") >= 2 and plan.count("BroadcastHashJoin") <= 1


def test_signs_of_all_components(spark):
    a = [1.0] * 70
    rows = spark.createDataFrame([(a, a[:69] + [-1.0]), (a, [-1.0] * 70), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(distance.hamming(distance.sign_words(F.col("a")), distance.sign_words(F.col("b")))).collect()] == [1.0, 70.0, 0.0]


def test_ids_beyond_the_key_s_range(spark):
    base = spark.createDataFrame([(i * 10**17, [float(i)]) for i in range(80)], "vec_id long, e array<double>")
    assert search.centroids(base).count() == 4 * search.LISTS


def _cube(spark, hits, ndc):
    rows = [(b, a, q, int(hits[b][a][q]), int(ndc[a])) for b, a, q in product(range(len(hits)), range(policy.N), range(len(hits[0][0])))]
    return spark.createDataFrame(rows, "build int, action_idx int, query_id long, hits long, ndc long")


def test_labels_and_order_against_enumeration(spark):
    rng = np.random.default_rng(5)
    hits = rng.choice([4, 5], (3, policy.N, 12), p=[0.3, 0.7])
    hits[:, -1, :6] = 5
    ndc = np.arange(1, policy.N + 1) * 10
    cube = _cube(spark, hits, ndc)
    got = {(r["build"], r["query_id"]): r["label"] for r in policy.labels(cube).collect()}
    label = {}
    for b, q in product(range(3), range(12)):
        bad = [a for a in range(policy.N) if hits[b][a][q] < 5]
        label[b, q] = max(bad) + 1 if bad else 0
    assert got == label
    for row in policy.objectives(cube).collect():
        t = row["target"]
        cells = {}
        for q in range(12):
            if label[t, q] < policy.N:
                cells.setdefault(max(label[s, q] for s in range(3) if s != t), []).append(label[t, q])
        keys, n = sorted(cells), sum(map(len, cells.values()))
        best = min(sum(len(cells[c]) * ndc[a] for c, a in zip(keys, plan)) for plan in product(range(policy.N), repeat=len(keys)) if list(plan) == sorted(plan) and all(a >= max(cells[c]) for c, a in zip(keys, plan))) if len(keys) <= 4 else None
        if best is not None:
            assert row["j_order"] == pytest.approx(best / n, abs=1e-6)
        assert row["j_identity"] <= row["j_summary"] <= row["j_order"] + 1e-9


def test_constant_and_crossed_bootstraps(spark):
    rows = spark.createDataFrame([(t, q, 0.5, 1.0) for t in range(3) for q in range(20)], "target long, query_id long, v double, n double")
    wq, wt = resample.weights(rows.select("query_id"), "query_id", 3, 50), resample.weights(rows.select("target"), "target", 4, 50)
    assert all(r["w"] == 20 for r in wq.groupBy("rep").agg(F.sum("w").alias("w")).collect()) and wq.select("rep").distinct().count() == 50
    sums = resample.crossed(rows, wt, wq, [], ["v", "n"]).withColumn("m", F.col("v") / F.col("n"))
    row = resample.interval(sums, [], ["m"]).first()
    assert (row["low_m"], row["high_m"], row["replicates"]) == (0.5, 0.5, 50)
    drawn = {(r["rep"], r["query_id"]): r["w"] for r in wq.collect()}
    targets = {(r["rep"], r["target"]): r["w"] for r in wt.collect()}
    other = rows.withColumn("v", F.col("target") * 100.0 + F.col("query_id"))
    got = {r["rep"]: r["v"] for r in resample.crossed(other, wt, wq, [], ["v"]).collect()}
    for rep in range(50):
        assert got[rep] == pytest.approx(sum(targets.get((rep, t), 0) * drawn.get((rep, q), 0) * (t * 100 + q) for t in range(3) for q in range(20)))
    spread = resample.weights(spark.range(200).withColumnRenamed("id", "query_id"), "query_id", 9, 400).agg(F.variance("w"), F.max("w")).first()
    assert spread[1] < 12


def test_shuffled_ids_are_a_permutation(spark):
    ids = spark.range(1000).withColumnRenamed("id", "vec_id")
    rows = membership.shuffled(ids, 5).collect()
    assert sorted(r["place"] for r in rows) == list(range(1000))
    assert np.corrcoef([r["vec_id"] for r in rows], [r["place"] for r in rows])[0, 1] < 0.1
    parts = membership.turnover(ids, membership.roles(ids, 5, {"a": 30, "b": 70}), 6)
    assert {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"old_only": 45, "new_only": 45, "both": 810}
    left = membership.repaired(parts, parts.filter("part = 'old_only'").limit(7))
    assert {r["part"]: r["n"] for r in left.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"old_only": 38, "new_only": 38, "both": 810}


def test_documents_are_compared_by_value():
    d = integrity.json_differs
    assert not d({"a": [1, 2.0, {"b": None}]}, {"a": [1, 2.0 + 1e-15, {"b": None}]})
    assert d({"a": 1}, {"a": 2}) and d({"a": 1}, {"b": 1}) and d([1], [1, 2]) and d(True, 1) and d(None, 0) and d("1", 1) and d({}, [])


def test_graphs_find_most_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 12))
    base = spark.createDataFrame([(i * 3, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, e array<double>")
    truth = search.exact_knn(base, base)
    for kind in ("hnsw", "vamana"):
        held = graphsearch.build(base, kind)
        rows = {r["parameter"]: r for r in graphsearch.scored(graphsearch.search(held, base, [("breadth", 8), ("breadth", 64)]), truth).collect()}
        assert rows[64.0]["recall"] > 0.97 >= 0 and rows[8.0]["mean_distances"] < rows[64.0]["mean_distances"] < 600, kind
    learned = graphsearch.train(held, base.filter("vec_id % 2 = 0"), truth)
    asked = base.filter("vec_id % 2 = 1")
    early = {(r["policy"], r["parameter"]): r for r in graphsearch.scored(graphsearch.search(held, asked, [("breadth", 128), ("recall", 0.8), ("recall", 0.99), ("start", 0.9), ("patience", 8), ("gap", 0.1), ("length", 2.0)], learned), truth).collect()}
    whole = early["breadth", 128.0]
    assert all(r["mean_distances"] <= whole["mean_distances"] and r["recall"] > 0.7 for r in early.values())
    assert early["recall", 0.8]["mean_distances"] <= early["recall", 0.99]["mean_distances"]
    gone = base.filter("vec_id % 5 = 0").select("vec_id")
    found = graphsearch.search(graphsearch.marked(held, gone), base, [("breadth", 64)])
    assert found.join(gone.withColumnRenamed("vec_id", "base_id"), "base_id", "left_semi").count() == 0


def _walked_alone(g, q, breadth):
    """(places, nearest first; distances counted) of one walk with heaps."""
    import heapq

    d, at, counted, _ = graphsearch._descend(g, q[None, :])
    away = lambda j: float(((g.x[j] - q) ** 2).sum())
    ahead, seen, n = [(float(d[0, 0]), int(at[0, 0]))], {int(at[0, 0])}, int(counted[0])
    best = [(-v, i) for v, i in ahead if not g.hidden[i]]
    while ahead:
        v, i = heapq.heappop(ahead)
        if len(best) >= breadth and v > -best[0][0]:
            break
        for j in g.layers[0][i]:
            if j < 0 or j in seen:
                continue
            seen.add(int(j))
            n += 1
            if len(best) < breadth or away(j) < -best[0][0]:
                heapq.heappush(ahead, (away(j), int(j)))
                if not g.hidden[j]:
                    heapq.heappush(best, (-away(j), int(j)))
                    if len(best) > breadth:
                        heapq.heappop(best)
    return [i for _, i in sorted((-v, i) for v, i in best)], n


@pytest.mark.parametrize("marks", [False, True])
def test_one_walk_answers_every_breadth(monkeypatch, marks):
    x = np.random.default_rng(9).normal(size=(900, 10))
    walks, walk = [], graphsearch.walk
    for kind in ("hnsw", "vamana"):
        g = graphsearch.Graph.unpacked(graphsearch.BUILDERS[kind](np.arange(900) * 2, x).packed())
        if marks:
            g.hidden[::3] = True
        monkeypatch.setattr(graphsearch, "walk", lambda g, links, *a, **b: (walks.append(links is g.layers[0]), walk(g, links, *a, **b))[1])
        _, at, n, _ = graphsearch.answered(g, x[:70], [("breadth", b) for b in (8, 32, 64)])
        monkeypatch.undo()
        assert sum(walks) == 1, kind
        walks.clear()
        for p, breadth in enumerate((8, 32, 64)):
            for i in range(70):
                places, counted = _walked_alone(g, x[i], breadth)
                assert at[p, i].tolist() == places[:6] and n[p, i] == counted, (kind, breadth, i)


def test_few_and_equal_vectors_in_graphs():
    for n in (1, 2, 3, 40):
        for kind, build in graphsearch.BUILDERS.items():
            g = build(np.arange(n), np.ones((n, 4)))
            d, at, _, _ = graphsearch.answered(g, np.ones((2, 4)), [("breadth", 64), ("patience", 3)])
            assert (d[0, 0] == 0).sum() == min(n, 6) and g.ids[at[0, 0, 0]] in range(n), (kind, n)


def test_shards_are_merged(spark, monkeypatch):
    monkeypatch.setattr(graphsearch, "SHARD_ROWS", 100)
    rng = np.random.default_rng(7)
    base = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(300, 6)))], "vec_id long, e array<double>")
    held = graphsearch.build(base, "hnsw")
    assert held.count() == 3
    rows = graphsearch.scored(graphsearch.search(held, base, [("breadth", 32)]), search.exact_knn(base, base)).first()
    assert rows["recall"] > 0.97 and rows["queries"] == 300


def test_index_strings(spark):
    rng = np.random.default_rng(8)
    base = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(300, 16)))], "vec_id long, e array<double>")
    truth = {(r["query_id"], r["base_id"]) for r in search.exact_knn(base, base).collect()}
    recall = {s: len(truth & {(r["query_id"], r["base_id"]) for r in indexes.build(s, base)(base).collect()}) / len(truth) for s in ("Flat", "HR,Flat", "PCA16,Flat", "SQ8", "IVF4,Flat", "PQ4x16", "PQ4x16,RFlat", "LSH", "IVF4,PQ4x16", "IVF4,PQ4x16R", "IVF4,PQ4x16,RFlat", "OPQ4,PQ4x16")}
    assert recall["Flat"] == recall["HR,Flat"] == recall["PCA16,Flat"] == 1.0 and recall["SQ8"] > 0.95
    assert recall["PQ4x16,RFlat"] > recall["PQ4x16"] > 0.1 and recall["IVF4,Flat"] > 0.3 and recall["LSH"] > 0.1
    assert recall["IVF4,PQ4x16R"] > recall["IVF4,PQ4x16"] > 0.1 and recall["IVF4,PQ4x16,RFlat"] > recall["IVF4,PQ4x16"] and recall["OPQ4,PQ4x16"] > 0.1
    with pytest.raises(ValueError):
        indexes.build("IVF4", base)


def test_lists_are_ordered_in_batches(spark):
    """Every vector's lists against brute force, ties to the smaller id, without a row a vector and centre to sort."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (90, 3)).astype(float)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, e array<double>")
    centres = search.centroids(base)
    order = search.probe_order(base, centres)
    assert "Window" not in order._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in order.collect():
        got.setdefault((r["build"], r["vec_id"]), {})[r["rank"]] = r["list"]
    held = {}
    for r in centres.collect():
        held.setdefault(r["build"], []).append(r["list"])
    assert len(got) == 4 * len(x)
    for (build, v), lists in got.items():
        want = sorted(held[build], key=lambda c: (((x[v] - x[c]) ** 2).sum(), c))
        assert [lists[i + 1] for i in range(len(want))] == want
    assert search.probe_order(base.limit(0), centres.limit(0)).count() == 0


def test_weights_in_blocks_are_those_of_the_table(spark, monkeypatch):
    """Blocks of a few units give the sums of the table of weights; a query without a row, and a replicate that draws none, have none."""
    monkeypatch.setattr(resample, "CHUNK", 7)
    monkeypatch.setattr(resample, "UNITS", 8)
    axis = spark.range(0, 60, 3).withColumnRenamed("id", "query_id")
    rows = spark.createDataFrame([("a", 9, 1.5), ("a", 30, -2.0), ("b", 57, 4.0), ("b", 9, 0.0)], "arm string, query_id long, v double")
    table, blocks = resample.weights(axis, "query_id", 3, 40), resample.draw(axis, "query_id", 3, 40)
    assert blocks.blocks.count() == 6 * 3 and blocks.places.count() == 20
    want = {(r["arm"], r["rep"]): (r["v"], r["w"]) for r in rows.join(table, "query_id").groupBy("arm", "rep").agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.sum("w").alias("w")).collect()}
    got = {(r["arm"], r["rep"]): (r["v"], r["w"]) for r in resample.drawn_sums(rows, blocks, ["arm"], ["v"], 40).collect()}
    assert got == want and 0 < len(want) < 80


def test_adjacency_reads_its_edges_once(spark):
    """The rows of edges, which may be dear, are made once although six counts follow."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (5, 6)], "src long, dst long").mapInPandas(seen, "src long, dst long")
    row = graph.adjacency_stats(edges, spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 9)], "id long"), 3).first()
    assert tuple(row) == (6, 4, 2, 2, 3) and made.value == 4
