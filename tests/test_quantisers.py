"""Inverted lists in blocks, product codes of residuals, residual stages and rotations against plain versions."""

from itertools import product

import numpy as np
import pytest

from rungwise.operators import additive, indexes, lists, search


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, e array<double>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8)) * 3
    # One list holds more than half of all vectors; equal vectors occur.
    at = rng.choice(6, 240, p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05])
    x = centres[at] + rng.normal(size=(240, 8))
    x[100] = x[7]
    return centres, x


def l2(a, b):
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def plain_lists(x, centres, probes, k):
    d = l2(x, centres)
    own, near = d.argmin(axis=1), np.argsort(d, axis=1, kind="stable")[:, :probes]
    score = l2(x, x)
    out = []
    for q in range(len(x)):
        found = sorted((score[q, b], b) for b in range(len(x)) if b != q and own[b] in near[q])[:k]
        out += [(q, r, b, int(own[b]), pytest.approx(s)) for r, (s, b) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("block", [7, 512])
def test_lists_in_blocks(spark, clustered, monkeypatch, block):
    centres, x = clustered
    monkeypatch.setattr(lists, "BLOCK", block)
    base = frame(spark, x)
    members, asked = lists.with_lists(base, centres), lists.with_lists(base, centres, 2)
    blocks = lists.packed(members, "list", ["vec_id", "e"], "b_").collect()
    assert sum(len(r["b_vec_id"]) for r in blocks) == len(x) and (block > 7 or len(blocks) > 30)
    got = sorted(tuple(r) for r in lists.search_lists(members, asked, 4).collect())
    assert got == plain_lists(x, centres, 2, 4)
    near = {(r["query_id"], r["base_id"]) for r in lists.range_lists(members, asked, 6.0).collect()}
    d = l2(x, centres)
    own, probed, score = d.argmin(axis=1), np.argsort(d, axis=1)[:, :2], l2(x, x)
    assert near == {(q, b) for q in range(len(x)) for b in range(len(x)) if q != b and own[b] in probed[q] and score[q, b] < 6.0}


def test_codes_of_residuals(spark, clustered, monkeypatch):
    centres, x = clustered
    monkeypatch.setattr(lists, "BLOCK", 11)
    rng = np.random.default_rng(9)
    books, refining = rng.normal(size=(2, 5, 4)), rng.normal(size=(2, 5, 4)) / 3
    base = frame(spark, x)
    codes = lists.coded(lists.less_centre(lists.with_lists(base, centres), centres), books, refining)
    rows = {r["vec_id"]: r for r in codes.collect()}
    own = l2(x, centres).argmin(axis=1)
    rest = x - centres[own]
    first = np.stack([l2(rest[:, 4 * p : 4 * p + 4], books[p]).argmin(axis=1) for p in range(2)], axis=1)
    meant = np.concatenate([books[p][first[:, p]] for p in range(2)], axis=1)
    second = np.stack([l2((rest - meant)[:, 4 * p : 4 * p + 4], refining[p]).argmin(axis=1) for p in range(2)], axis=1)
    fine = meant + np.concatenate([refining[p][second[:, p]] for p in range(2)], axis=1)
    assert all(rows[i]["list"] == own[i] and list(rows[i]["codes"]) == list(first[i]) and list(rows[i]["finer"]) == list(second[i]) for i in range(len(x)))
    got = {}
    for r in lists.search_codes(codes, lists.with_lists(base, centres, 2), centres, books, refining, 3, 2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["base_id"], r["score"], r["refined"]))
    near = np.argsort(l2(x, centres), axis=1)[:, :2]
    for q in range(len(x)):
        pairs = [(((x[q] - centres[own[b]] - meant[b]) ** 2).sum(), b) for b in range(len(x)) if b != q and own[b] in near[q]]
        kept = sorted(pairs, key=lambda p: (round(p[0], 9), p[1]))[:6]
        best = sorted((round(((x[q] - centres[own[b]] - fine[b]) ** 2).sum(), 9), b, s) for s, b in kept)[:3]
        assert [(b, pytest.approx(s), pytest.approx(f)) for f, b, s in best] == [(b, s, f) for _, b, s, f in sorted(got[q])]


def test_refinement_raises_recall(spark):
    x = np.random.default_rng(3).normal(size=(400, 16))
    base = frame(spark, x)
    centres = indexes.kmeans(base, indexes.picks(base, 4))[0]
    rest = lists.less_centre(lists.with_lists(base, centres), centres)
    books = indexes.kmeans(rest, indexes.picks(rest, 16), 4, 4)
    finer = lists.less_codes(rest, books)
    refining = indexes.kmeans(finer, indexes.picks(finer, 16), 4, 4)
    codes, truth = lists.coded(rest, books, refining), l2(x, x) + np.diag(np.full(len(x), np.inf))
    best = {q: set(np.argsort(truth[q])[:5].tolist()) for q in range(len(x))}

    def recall(factor, probes):
        rows = lists.search_codes(codes, lists.with_lists(base, centres, probes), centres, books, refining, 5, factor).collect()
        return sum(r["base_id"] in best[r["query_id"]] for r in rows) / (5 * len(x))

    plain, refined = recall(1, 4), recall(8, 4)
    assert refined > plain + 0.05 and recall(8, 1) < refined


def test_beams(spark):
    rng = np.random.default_rng(5)
    x, books = rng.normal(size=(120, 6)), rng.normal(size=(3, 4, 6))
    sums = {c: sum(books[s][c[s]] for s in range(3)) for c in product(range(4), repeat=3)}
    error = lambda codes: [((x[i] - sum(books[s][c[s]] for s in range(3))) ** 2).sum() for i, c in enumerate(codes.tolist())]
    last = None
    for width in (1, 2, 5, 64):
        codes, errors = additive.beam(x, books, width)
        assert errors[:, -1] == pytest.approx(error(codes))
        greedy = additive.beam(x, books, 1)[1][:, -1]
        assert (errors[:, -1] <= greedy + 1e-12).all()
        last = errors[:, -1]
    best = np.array([min(((row - s) ** 2).sum() for s in sums.values()) for row in x])
    assert last == pytest.approx(best)
    rows = additive.residual_codes(frame(spark, x), books, 5).collect()
    wide = additive.beam(x, books, 5)
    assert all(list(r["codes"]) == wide[0][r["vec_id"]].tolist() and r["errors"] == pytest.approx(wide[1][r["vec_id"]].tolist()) for r in rows)


def test_stages_leave_less_and_less(spark):
    x = np.random.default_rng(6).normal(size=(300, 8))
    base = frame(spark, x)
    total = []
    for width in (1, 4):
        books = additive.residual_books(base, 3, 8, 4, width)
        errors = additive.beam(x, books, width)[1].sum(axis=0)
        assert (np.diff(np.append((x**2).sum(), errors)) < 0).all()
        total.append(errors[-1])
    assert total[1] <= total[0]


def test_opq_turns(spark):
    rng = np.random.default_rng(7)
    # Variance lies across the slices, so that a rotation helps.
    x = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 8)) + 0.1 * rng.normal(size=(300, 8))
    base = frame(spark, x)
    rotation, books, errors = additive.opq(base, 4, 8, 7)
    assert np.allclose(rotation @ rotation.T, np.eye(8)) and (np.diff(errors) <= 1e-9).all() and errors[-1] < 0.9 * errors[0]
    # The same turns, plainly.
    r, book = np.eye(8), None
    start = indexes.picks(base, 8)
    for want in errors:
        y = x @ r
        book = (start @ r).reshape(8, 4, 2).transpose(1, 0, 2).copy() if book is None else book
        near = [l2(y[:, 2 * p : 2 * p + 2], book[p]).argmin(axis=1) for p in range(4)]
        book = np.stack([np.stack([y[near[p] == c, 2 * p : 2 * p + 2].mean(axis=0) if (near[p] == c).any() else book[p][c] for c in range(8)]) for p in range(4)])
        meant = np.concatenate([book[p][l2(y[:, 2 * p : 2 * p + 2], book[p]).argmin(axis=1)] for p in range(4)], axis=1)
        assert ((y - meant) ** 2).sum() == pytest.approx(want)
        u, _, v = np.linalg.svd(x.T @ meant)
        r = u @ v
    assert np.allclose(r, rotation) and np.allclose(book, books)
    assert np.allclose([row["e"] for row in additive.turned(base, rotation).orderBy("vec_id").collect()], x @ rotation)


def test_itq_turns(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 12)) * np.arange(1, 13) + 5
    mean, projection, errors = additive.itq(frame(spark, x), 4, 12)
    assert mean == pytest.approx(x.mean(axis=0)) and np.allclose(projection.T @ projection, np.eye(4))
    axes = np.linalg.eigh(np.cov(x.T))[1][:, -4:]
    assert np.allclose(axes @ axes.T, projection @ projection.T) and (np.diff(errors) <= 1e-9).all() and errors[-1] < errors[0]
    codes = {r["vec_id"]: r["code"] for r in additive.sign_codes(frame(spark, x), mean, projection).collect()}
    assert codes == {i: "".join("01"[int(v >= 0)] for v in row) for i, row in enumerate((x - mean) @ projection)}


def test_empty_tables(spark):
    none = search.vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    members = lists.with_lists(none, np.zeros((2, 3)))
    assert lists.search_lists(members, members).count() == 0 and lists.range_lists(members, members, 1.0).count() == 0
    assert additive.residual_codes(none, np.zeros((2, 3, 4))).count() == 0 and lists.lists_for(0) == 1


def test_codes_are_summed_once_a_group(spark, monkeypatch):
    rng = np.random.default_rng(31)
    books = rng.normal(size=(4, 16, 3))
    codes = rng.integers(0, 16, (700, 4))
    codes[:200] = codes[0]  # ties, to the smaller id
    ids, q = rng.permutation(700) * 7, rng.normal(size=(700, 12))
    held = spark.createDataFrame([(int(i), [int(c) for c in z]) for i, z in zip(ids, codes)], "vec_id long, codes array<int>")
    asked = spark.createDataFrame([(int(i), [float(v) for v in e]) for i, e in zip(ids, q)], "vec_id long, e array<double>")
    monkeypatch.setattr(search, "BLOCK", 64)
    found = sorted((r["query_id"], r["rank"], r["base_id"], r["score"]) for r in indexes.product_search(held, asked, books, 6).collect())
    score = np.zeros((700, 700))
    for p in range(4):
        score += ((q[:, None, 3 * p : 3 * p + 3] - books[p][None]) ** 2).sum(-1)[:, codes[:, p]]
    want = []
    for i in range(700):
        order = [j for j in np.lexsort((ids, score[i])) if j != i][:6]
        want += [(int(ids[i]), r + 1, int(ids[j]), score[i, j]) for r, j in enumerate(order)]
    assert found == sorted(want)


def test_index_strings_take_exact_neighbours_once(spark, monkeypatch):
    from rungwise.plans import catalogue, registry
    from rungwise.plans import indexes as plans

    monkeypatch.setattr(registry, "_stored", {})
    monkeypatch.setattr(plans, "SPECS", ("SQ8", "SQ4"))
    assert catalogue.QUERIES["index_strings"](spark, "/root/testdata/sf0.001").count() == 2
    assert [key[2] for key in registry._stored] == ["knn"]


def test_index_strings_train_and_search_shared_forms_once(spark, monkeypatch):
    from rungwise.operators import indexes
    from rungwise.plans import catalogue
    from rungwise.plans import indexes as plans

    trained, built = [], []
    kmeans, build = indexes.kmeans, indexes.build
    monkeypatch.setattr(indexes, "kmeans", lambda *a, **k: trained.append(1) or kmeans(*a, **k))
    monkeypatch.setattr(indexes, "build", lambda spec, *a: built.append(spec) or build(spec, *a))
    monkeypatch.setattr(plans, "SPECS", ("Flat", "IDMap,Flat", "PQ8x4", "PQ8x4,RFlat", "IVF4,Flat", "IVF4,PQ8x4"))
    got = {r["index"]: r["recall"] for r in catalogue.QUERIES["index_strings"](spark, "/root/testdata/sf0.001").collect()}
    assert built == ["Flat", "PQ8x4", "IVF4,Flat", "IVF4,PQ8x4"] and len(trained) == 3
    assert got["Flat"] == got["IDMap,Flat"] == 1 and got["PQ8x4,RFlat"] >= got["PQ8x4"] and len(got) == 6
