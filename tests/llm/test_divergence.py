"""The divergence audit against a plain version in Python, over chunk borders and on odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rungwise.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, at int, value string"


def plain(rows, min_docs, top):
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in held[lang].items() if d >= min_docs]

        def shares(n):
            total = sum(n[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 2) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(far(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def made_up(n, seed):
    rng = random.Random(seed)
    words = [c + d for c in "abÉéżAz日本" for d in "cdefüßZ語x𐍈"] + ["pad" * 400]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "fr", None, ""])
        source = rng.choice(["hot"] * 5 + ["s1", "s2", "é", "", None])
        rows.append((rng.choice(" .-_9\n\x00").join(rng.choices(words, k=rng.randrange(0, 60))), lang, source))
    return rows + [(None, "en", "silent"), ("", "xx", "only"), ("lone word", "yy", "a"), ("other", "yy", "b")] + rows[:5]


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i % 7, *r, "clash", 1, 2, "v") for i, r in enumerate(rows)], SCHEMA)
    got = divergence.audit(docs, **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("chunk_rows", [1, 50, divergence.CHUNK_ROWS])
def test_against_a_plain_version(spark, chunk_rows):
    rows = made_up(150, 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = run(spark, rows, min_docs=4, top=3, chunk_rows=chunk_rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows, 4, 3)
    assert ("yy", "a", "pair", "b", 0, 1) in got and not [r for r in got if r[0] == "xx"]


def test_more_sources_than_a_block_holds():
    rng = np.random.default_rng(1)
    sources, width = 40, 30
    at, of = (x.ravel() for x in np.meshgrid(np.arange(width), np.arange(sources)))
    n = rng.integers(0, 50, len(at))
    totals = np.bincount(of, n).astype(np.int64)
    row = {"terms": ["t"] * width, "at": at, "n": n}
    old, divergence.BLOCK_CELLS = divergence.BLOCK_CELLS, 70
    try:
        got = np.zeros((sources, sources), np.int64)
        for i, part in divergence._pair_sums(row, of, totals, width):
            got[i, i + 1 :] += part
    finally:
        divergence.BLOCK_CELLS = old
    p = [[1 + 10**9 * (int(x) + 2) // (int(t) + 2 * width) for x in n.reshape(sources, width)[s]] for s, t in enumerate(totals)]
    want = [[sum((a - b) ** 2 // (a + b) for a, b in zip(p[i], p[j])) if j > i else 0 for j in range(sources)] for i in range(sources)]
    assert got.tolist() == want


def test_shares_of_large_counts_are_exact():
    n, total = np.array([0, 7, 3_000_000_000_000, 8_999_999_999_999_990]), 9_000_000_000_000_000
    assert divergence.probabilities(n, total).tolist() == [1 + 10**9 * (int(x) + 2) // total for x in n]


def test_pairs_that_leave_the_task_unsummed_are_the_same():
    rng = np.random.default_rng(2)
    names, width = [f"s{i}" for i in range(6)], 12
    batches = []
    for chunk in range(3):
        n = rng.integers(1, 9, 40)
        cell = rng.choice(len(names) * width, 40, replace=False)
        batches.append(pa.RecordBatch.from_pylist([{"lang": "l", "terms": [f"{chunk}{i:02d}" for i in range(width)], "sources": names, "at": cell % width, "of": cell // width, "n": n, "kept": 3 * width, "all_sources": names, "totals": [500] * 6}]))
    found = []
    for cells in (divergence.BLOCK_CELLS, 3):
        old, divergence.BLOCK_CELLS = divergence.BLOCK_CELLS, cells
        try:
            sums = Counter()
            for out in divergence._compared(2)(iter(batches)):
                for r in out.to_pylist():
                    sums[r["source"], r["part"], r["item"]] += r["value"]
        finally:
            divergence.BLOCK_CELLS = old
        found.append(sums)
    assert found[0] == found[1] and len([k for k in found[0] if k[1] == "pair"]) == 30


def test_empty_table(spark):
    assert run(spark, []) == []
