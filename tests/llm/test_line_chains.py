"""Chains of near lines, each near the next only, against a walk over all lines in their order."""

import random

import pytest

from rungwise.llm import lines


def plain(texts):
    """The lines that stay, by a walk that compares a line with those before it that stay."""
    stay = []
    for text in texts:
        words = text.split()
        near = [w for w in stay if abs(len(w) - len(words)) <= 4 and lines.distance_within(words, w, lines.bound_of(min(len(words), len(w))))]
        if not near:
            stay.append(words)
    return [" ".join(w) for w in stay]


def sliding(n, words, seed):
    rng = random.Random(seed)
    text = [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(n + words)]
    return [" ".join(text[i : i + words]) for i in range(n)]


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in lines.dedup_lines(docs).orderBy("doc_id").collect() if r["text"]]


@pytest.mark.parametrize("task_links", [lines.TASK_LINKS, 40])
def test_sliding_lines_settle(spark, monkeypatch, task_links):
    """1000 lines in one chain; with a small limit, long components in rounds and short ones by a task each."""
    monkeypatch.setattr(lines, "TASK_LINKS", task_links)
    chains = [sliding(1000, 20, 1)] if task_links > 40 else [sliding(n, 20, n) for n in (60, 20, 9)]
    rng = random.Random(2)
    texts = [t for c in chains for t in c]
    if task_links == 40:
        rng.shuffle(texts)
    got = kept(spark, texts)
    assert got == plain(texts) and len(texts) / 3 <= len(got) < len(texts)


def test_rounds_and_walks_agree(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, tuple(sorted(rng.sample(range(i), min(i, rng.randrange(0, 4)))))) for i in range(1, 60)]
    links = [(i, (i, 0, 0), j, (j, 0, 0)) for i, js in rows for j in js]
    df = spark.createDataFrame(links, "cid long, first struct<doc_id:long,th:long,pos:int>, other long, near struct<doc_id:long,th:long,pos:int>")
    gone = {}
    for i, js in rows:
        near = [j for j in js if j not in gone]
        if near:
            gone[i] = min(near)
    for limit in (lines.TASK_LINKS, 0):
        monkeypatch.setattr(lines, "TASK_LINKS", limit)
        got = {r["cid"]: r["near"]["doc_id"] for r in lines._settled(df).collect()}
        assert set(got) == set(gone) and (limit == 0 or got == gone)
        assert all(j not in gone for j in got.values())
