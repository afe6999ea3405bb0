"""Importance resampling towards a target text distribution, in hashed n-gram buckets.

Every text becomes its runs of one to three consecutive words; a run's bucket is the CRC-32 of its bytes
modulo BUCKETS.  What the target's texts hold of a bucket against what the documents hold is the bucket's
gain; the gains of a document's runs add up to its weight, and the weight plus a Gumbel variate of the
document's id is its score.  The documents of highest score are drawn, which is a draw without replacement
in proportion to the exponential of the weights.

All of it is DataFrame work: positions of a document's words are exploded, each gives up to three buckets,
counts are summed map-side into BUCKETS rows, the gains (BUCKETS rows, a parameter) are broadcast, and a
document's gains are summed in its own task before the one narrow shuffle.  Scores are range-sorted; a
row's rank is its place in its partition plus the rows of the partitions before.  No key of the data is
shuffled but the bucket and the row's own number, so that a hot source or word lands in no single task.

Defined results: null and empty texts have no features, weight 0, and are never drawn (too few words);
a null id is hashed as an empty one and sorts after all others; equal rows are rows of their own and share
weight and score; an empty target gives gains from its smoothing alone; texts of any length are taken
whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm.common import materialise, scratch, table

BUCKETS = 10_000
LONGEST_RUN = 3
MIN_WORDS = 20
#: Share of the documents with enough words that is drawn, in hundredths.
PERCENT = 5
SEED = 42
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a monotonically increasing id that number the rows of a partition.
_ROW_BITS = 33


def feature_words(text: Column) -> Column:
    """Digits, letters and all beyond ASCII, A to Z in lower case; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, SEPARATORS, -1), "")


def _buckets(texts: DataFrame, buckets: int, *keep: str) -> DataFrame:
    """A row for each position of a word: the kept columns, n_words and the buckets of the runs that begin there.

    A text without words has one row, whose buckets are null.
    """
    words = texts.select(*keep, feature_words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    at = words.withColumn("at", F.explode_outer(F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.col("n_words") - 1))))
    bucket = lambda run: F.pmod(F.crc32(run), F.lit(buckets)).cast("int")
    word = [F.get("words", F.col("at") + k) for k in range(LONGEST_RUN)]
    runs = [F.when(F.col("at") + k < F.col("n_words"), bucket(F.concat_ws(" ", *word[: k + 1]))) for k in range(LONGEST_RUN)]
    return at.select(*keep, "n_words", F.array(*runs).alias("buckets"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features fall into it; buckets without any have no row."""
    spread = _buckets(texts, buckets).select(F.explode_outer("buckets").alias("bucket"))
    return spread.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: one row for each bucket, from smoothed shares of the target and of the documents."""
    sides = bucket_counts(docs, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    sides = sides.unionByName(bucket_counts(target, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = materialise(sides.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    all_s, all_t = counts.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain_table: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of a document's features; a row a document.

    ``docs`` is to be a table's scan: the number that tells its rows apart is their place in the scan.
    """
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    spread = _buckets(numbered, buckets, "row", "doc_id").select("row", "doc_id", "n_words", F.explode_outer("buckets").alias("bucket"))
    gained = spread.join(F.broadcast(gain_table), "bucket", "left")
    return gained.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight")).drop("row")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A thousand times a standard Gumbel variate of the id and the seed, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform)))


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """``scored`` (doc_id, score, eligible and others) with rank: 1, 2, 3 ... for the drawn rows, else null.

    The rows are range-sorted once and written; of each partition only its size returns to the driver.
    """
    ordered = scored.orderBy(F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()), "order")
    part = F.shiftrightunsigned("_at", _ROW_BITS)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("eligible").cast("long")).alias("e")).collect())
    offsets, before, eligible = [], 0, 0
    for at, n, e in sizes:
        offsets.append((at, before))
        before, eligible = before + n, eligible + e
    place = F.broadcast(placed.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    joined = placed.withColumn("_part", part).join(place, "_part")
    return joined.withColumn("rank", F.when(F.col("eligible") & (rank <= percent * eligible // 100), rank)).drop("_at", "_part", "_before", "eligible")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ``rank`` is null for what isn't drawn."""
    with scratch():
        weighed = weights(docs, gains(docs, target, buckets), buckets)
        scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("eligible", F.col("n_words") >= min_words)
        return materialise(ranked(scored, percent).select("doc_id", "n_features", "weight", "score", "rank"), "drawn", keep=True)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


# CRC-32 by half bytes, low half first, with a table of sixteen entries that the polynomial gives.
_STEP = "xor(c >> 1, 3988292384 * (c & 1))"
OP11_SQL = f"""
WITH RECURSIVE z AS (SELECT range AS i, range::BIGINT AS c, 0 AS k FROM range(16) UNION ALL SELECT i, {_STEP}, k + 1 FROM z WHERE k < 4),
half AS (SELECT list(c ORDER BY i) AS t FROM z WHERE k = 4),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, true AS doc FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
w AS MATERIALIZED (SELECT rid, doc_id, doc, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM d),
f AS MATERIALIZED (SELECT rid, doc, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
        list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS feature FROM w),
u AS (SELECT DISTINCT feature FROM f),
h AS (SELECT feature, list_transform(regexp_extract_all(hex(encode(feature)), '.'), lambda x: ('0x' || x)::BIGINT) AS hs FROM u),
c AS MATERIALIZED (SELECT feature, xor(4294967295, list_reduce(flatten(list_transform(range(1, len(hs), 2), lambda i: [hs[i + 1], hs[i]])),
        lambda c, x: xor(c >> 4, t[xor(c & 15, x) + 1]), 4294967295)) % {BUCKETS} AS bucket FROM h, half),
g AS MATERIALIZED (SELECT bucket, count(*) FILTER (doc) AS s, count(*) FILTER (NOT doc) AS t FROM f JOIN c USING (feature) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM f WHERE doc)::DOUBLE AS s_all, (SELECT count(*) FROM f WHERE NOT doc)::DOUBLE AS t_all),
v AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain FROM g, n),
e AS (SELECT rid, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN c USING (feature) JOIN v USING (bucket) WHERE doc GROUP BY rid),
s AS (SELECT doc_id, len(ws) >= {MIN_WORDS} AS eligible, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN e USING (rid) WHERE doc),
r AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place, sum(eligible::INT) OVER () AS n FROM s)
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN eligible AND place <= {PERCENT} * n // 100 THEN place END::BIGINT AS rank FROM r
"""
