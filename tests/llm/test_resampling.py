"""Importance resampling against a plain version in Python, on odd rows, and its ranks over many partitions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rungwise.llm import resampling

LONG = " ".join(f"W{i % 977}é" for i in range(20_000))
DOCS = [(1, None), (2, ""), (3, " .,;\t\n"), (4, "One two THREE four"), (4, "One two THREE four"), (None, "x " * 30), (5, LONG), (6, "Ärger-über ÉTÉ été 12a\x00b\x7fc" + " und so weiter" * 8), (7, "a b c d e f g h i j k l m n o p q r s t")]
TARGET = ["one two three", None, "über été a b c", "weiter und so"]
SCHEMA = "doc_id long, text string, weight string, row int, bucket string, at double, words string, n_words string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1, "b", 0.5, "w", "n") for i, t in DOCS], SCHEMA)


def plain(rows, target, percent, buckets):
    """Every row's (doc_id, n_features, weight, score, rank), one text after the other."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        words, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= 20])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, row in enumerate(drawn[: percent * len(drawn) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("percent", [5, 50, 100])
@pytest.mark.parametrize("buckets", [7, 10_000])
def test_against_a_plain_version(spark, docs, percent, buckets):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.resample(docs, target, percent, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(DOCS, TARGET, percent, buckets)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), none).count() == 0
    got = resampling.resample(docs, none, 100)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(DOCS, [], 100, resampling.BUCKETS)


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("doc_id"), (F.col("id") % 40).alias("score"), (F.col("id") % 3 > 0).alias("eligible"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resampling.ranked(rows, 50).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    best = sorted(((-r["score"], r["doc_id"]) for r in rows.collect() if r["eligible"]))
    assert {r["doc_id"]: r["rank"] for r in got if r["rank"]} == {i: n for n, (_, i) in enumerate(best[: len(best) // 2], 1)}
    assert len(got) == 5000
