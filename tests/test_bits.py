"""Multi-index hashing against all pairs, with hot buckets and few codes."""

import numpy as np
import pytest

from rungwise.operators import bits


def frame(spark, signs):
    return spark.createDataFrame([(i, [1.0 if b else -1.0 for b in row]) for i, row in enumerate(signs)], "vec_id long, e array<double>")


@pytest.mark.parametrize("block", [3, 1024])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(bits, "BLOCK", block)
    rng = np.random.default_rng(1)
    # Near copies of a few codes: half of all share the first substring.
    seeds = rng.random((6, 32)) < 0.5
    seeds[:3, :16] = seeds[0, :16]
    signs = seeds[rng.integers(0, 6, 90)] ^ (rng.random((90, 32)) < 0.06)
    codes = bits.codes_of(frame(spark, signs))
    found, went = bits.search_codes(codes, codes.filter("vec_id % 3 = 0"), 4)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["base_id"], r["score"]))
    far = (signs[:, None, :] != signs[None, :, :]).sum(axis=2)
    want = {q: [(i, b, float(d)) for i, (d, b) in enumerate(sorted((far[q, b], b) for b in range(90) if b != q)[:4], 1)] for q in range(0, 90, 3)}
    assert {q: sorted(v) for q, v in got.items()} == want
    parts = np.add.reduceat((signs[:, None, :] != signs[None, :, :]).astype(int), [0, 16], axis=2)
    for r in went.collect():
        q = r["query_id"]
        assert r["radius"] == int(want[q][-1][2]) // 2
        assert r["read"] == sum(parts[q, b, p] <= r["radius"] for b in range(90) if b != q for p in (0, 1))
    assert sum(r["read"] for r in went.collect()) < 30 * 89


def test_fewer_codes_than_wanted(spark, monkeypatch):
    monkeypatch.setattr(bits, "WIDTH", 4)
    codes = bits.codes_of(frame(spark, np.array([[1, 0, 1, 1, 0, 0, 0, 0], [0, 1, 0, 0, 1, 1, 1, 1], [1, 0, 1, 1, 0, 0, 0, 0]], bool)))
    found, _ = bits.search_codes(codes, codes, 5)
    assert sorted(tuple(r)[:1] + (r["base_id"], r["score"]) for r in found.collect()) == [(0, 1, 8.0), (0, 2, 0.0), (1, 0, 8.0), (1, 2, 8.0), (2, 0, 0.0), (2, 1, 8.0)]
    none = codes.limit(0)
    assert bits.search_codes(none, none, 5)[0].count() == 0
    assert spark.range(1).select(bits.flips(4, 2)).first()[0] == [3, 5, 6, 9, 10, 12]


def test_queries_meet_buckets_by_half(spark, monkeypatch):
    """Rows of queries that are sent to buckets: by upper halves of a substring, not by every mask of its flips."""
    rng = np.random.default_rng(2)
    codes = bits.codes_of(frame(spark, rng.random((40, 32)) < 0.5))
    sent = []
    whole = bits._prefixes
    monkeypatch.setattr(bits, "_prefixes", lambda each, masks, prefix: sent.append((prefix, each.select(masks.alias("m")).first()["m"])) or whole(each, masks, prefix))
    found, went = bits.search_codes(codes, codes.filter("vec_id < 3"), 5)
    assert found.count() == 15
    assert max(r["radius"] for r in went.collect()) + 2 == len(sent)
    assert [len(m) for p, m in sent if p == "q_"][:4] == [1, 9, 37, 93]


@pytest.mark.parametrize("many", [1, 1 << 20])
def test_all_codes_ask_in_blocks_or_one_by_one(spark, monkeypatch, many):
    monkeypatch.setattr(bits, "MANY", many)
    monkeypatch.setattr(bits, "WIDTH", 8)
    rng = np.random.default_rng(3)
    signs = rng.random((60, 72)) < 0.5
    codes = bits.codes_of(frame(spark, signs))
    found, went = bits.search_codes(codes, codes, 3, reads=many > 1)
    far = (signs[:, None, :] != signs[None, :, :]).sum(axis=2)
    want = {(q, i, b, float(d)) for q in range(60) for i, (d, b) in enumerate(sorted((far[q, b], b) for b in range(60) if b != q)[:3], 1)}
    assert {tuple(r) for r in found.select("query_id", "rank", "base_id", "score").collect()} == want
    parts = np.add.reduceat((signs[:, None, :] != signs[None, :, :]).astype(int), range(0, 72, 8), axis=2)
    for r in went.collect():
        assert r["read"] == (sum(int((parts[r["query_id"], b] <= r["radius"]).sum()) for b in range(60) if b != r["query_id"]) if many > 1 else 0)


def test_multi_index_hashing_answers_every_vector(spark, duck, same):
    from rungwise.plans import catalogue, hashing

    folder = "/root/testdata/sf0.001"
    got = hashing.multi_index_hashing(spark, folder).toPandas()
    assert got["query_id"].nunique() == spark.read.parquet(f"{folder}/embeddings.parquet").count()
    same(got, duck(catalogue.ORACLE_SQL["multi_index_hashing"], folder))
