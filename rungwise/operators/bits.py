"""Nearest neighbours of binary codes by multi-index hashing.

A code is cut into substrings; each is a table of buckets.  Codes that differ in fewer than m (s + 1) bits
agree in one of their m substrings up to s bits, so that after all buckets within s flips of a query's
substrings have been read, everything nearer than that is known.  Radii grow by one a round, and only the
queries whose k-th neighbour isn't within the bound yet go on; at the last radius every code has been read.

Buckets travel by the upper half of their value: a query is sent to the halves within its radius, where it picks
the buckets that are as many flips away. The codes of a half are dealt to blocks by a
hash, so that one that holds a large share of all codes is many rows of a join, each of which keeps a query's k
best, if they are no farther than what it has found before, until anything is shuffled by query. Many queries are
put together by their own half first, and sent as blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.operators import search
from rungwise.operators.search import K
from rungwise.operators.storage import written

#: Codes of a bucket in a block, and queries that meet a block at once.
BLOCK, QUERIES = 1024, 256
#: Substrings (for each half) from which on they are sent in blocks.
MANY = 64
#: Bits of a substring, a multiple of four.
WIDTH = 16


def codes_of(base: DataFrame) -> DataFrame:
    """vec_id, code (binary): a bit for each element, set where it is positive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signs = np.stack([np.asarray(v) for v in batch["e"]]) > 0
            yield pd.DataFrame({"vec_id": batch["vec_id"], "code": [row.tobytes() for row in np.packbits(signs, axis=1)]})

    return base.select("vec_id", "e").mapInPandas(run, "vec_id long, code binary")


def substrings(codes: DataFrame) -> DataFrame:
    """vec_id, code, part, value: the substrings of each code."""
    return codes.select("*", F.posexplode(F.transform(F.split(F.regexp_replace(F.hex("code"), f"(.{{1,{WIDTH // 4}}})", "$1,"), ","), lambda h: F.conv(F.nullif(h, F.lit("")), 16, 10).cast("int"))).alias("part", "value")).filter("value IS NOT NULL")


def _prefixes(each: DataFrame, masks: Column, prefix: str) -> DataFrame:
    """part, prefix, _block, bytes of codes and arrays of the other columns: rows of about BLOCK substrings whose upper half is the prefix, or differs from it by one of the masks."""
    half = each.withColumn("prefix", F.shiftright("value", WIDTH // 2))
    apart = F.explode(F.transform(masks, lambda m: F.col("prefix").bitwiseXOR(m)))
    many = each.count() >= MANY << (WIDTH // 2)
    dealt = half if many else half.withColumn("prefix", apart)
    sizes = dealt.groupBy("part", "prefix").agg(F.count("*").alias("_n"))
    dealt = dealt.join(F.broadcast(sizes), ["part", "prefix"]).withColumn("_block", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / BLOCK)))
    # A number of partitions that is given, as blocks grow where they are sent.
    dealt = dealt.repartition(8 * each.sparkSession.sparkContext.defaultParallelism, "part", "prefix", "_block")
    lists = [F.collect_list(c).alias(prefix + c) for c in each.columns if c not in ("part", "code")]
    blocks = dealt.groupBy("part", "prefix", "_block").agg(F.unhex(F.array_join(F.collect_list(F.hex("code")), "")).alias(prefix + "code"), *lists)  # a row a block
    return blocks.withColumn("prefix", apart) if many else blocks


def buckets(codes: DataFrame) -> DataFrame:
    """part, prefix and blocks of the codes whose substring has that upper half."""
    each = substrings(codes).withColumnRenamed("vec_id", "id")
    return _prefixes(each, F.array(F.lit(0)), "b_").drop("_block")


def flips(width: int, radius: int) -> Column:
    """All masks of ``width`` bits of which ``radius`` are set."""
    return F.array(*[F.lit(m) for m in range(1 << width) if m.bit_count() == radius])


def _words(code: bytes, rows: int) -> np.ndarray:
    """Codes as 64-bit words, a row a code."""
    each = np.frombuffer(code, np.uint8).reshape(rows, -1)
    return np.pad(each, ((0, 0), (0, -each.shape[1] % 8))).view(np.uint64)


def _best(k: int, radius: int, reads: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, went = [], []
            for r in batch.itertuples(index=False):
                ids, values, q_ids, q_values, q_limit = (np.asarray(v) for v in (r.b_id, r.b_value, r.q_id, r.q_value, r.q_limit))
                codes, queries = _words(r.b_code, len(ids)), _words(r.q_code, len(q_ids))
                values, q_values = values.astype(np.uint32), q_values.astype(np.uint32)
                none = 64 * codes.shape[1] + 1
                for low in range(0, len(q_ids), QUERIES):
                    asked, words = q_ids[low : low + QUERIES], queries[low : low + QUERIES]
                    # The buckets that are exactly so many flips away.
                    met = np.bitwise_count(q_values[low : low + QUERIES, None] ^ values[None, :]) == radius
                    met &= asked[:, None] != ids[None, :]
                    far = np.zeros(met.shape, np.uint8 if none < 256 else np.int32)
                    for w in range(codes.shape[1]):
                        far += np.bitwise_count(words[:, w, None] ^ codes[None, :, w])
                    # Nothing farther than what a query has, or than its k-th of the block, is sorted.
                    close = met & (far <= q_limit[low : low + QUERIES, None])
                    full = np.flatnonzero(close.sum(axis=1) > k)
                    if len(full):
                        near = np.where(close[full], far[full], none)
                        close[full] &= far[full] <= np.partition(near, k - 1, axis=1)[:, k - 1 : k]
                    row, column = np.nonzero(close)
                    score = far[row, column].astype(np.float64)
                    kept = search._kept(k, row, ids[column], score)
                    row, column, score = row[kept], column[kept], score[kept]
                    out.append((asked[row], ids[column], score))
                    if reads:
                        went.append((asked, met.sum(axis=1)))
            if out:
                yield pd.DataFrame(dict(zip(("query_id", "base_id", "score"), map(np.concatenate, zip(*out))))).assign(read=0)
            if went:
                read = pd.DataFrame(dict(zip(("query_id", "read"), map(np.concatenate, zip(*went))))).groupby("query_id", as_index=False)["read"].sum()
                yield read.assign(base_id=pd.array([None] * len(read), "Int64"), score=np.nan)[["query_id", "base_id", "score", "read"]]

    return run


def search_codes(codes: DataFrame, queries: DataFrame, k: int = K, reads: bool = True) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, base_id, score) of the k nearest other codes, and (query_id, radius, read): how far each query went and how many codes it read (unless ``reads`` is False)."""
    store = written(buckets(codes), "buckets")
    first = codes.first()
    bits_ = 8 * len(first["code"]) if first else 0
    parts = -(-bits_ // WIDTH)
    asked = written(queries.select(F.col("vec_id").alias("query_id"), "code", F.lit(bits_).alias("limit")), "asked")
    spark = codes.sparkSession
    empty = spark.createDataFrame([], "query_id long, base_id long, score double, read long")
    known, radius, done = empty, 0, []
    while not asked.isEmpty() and radius <= WIDTH:
        probes = _prefixes(substrings(asked.withColumnRenamed("query_id", "vec_id")).withColumnRenamed("vec_id", "id"), F.flatten(F.array(*[flips(WIDTH - WIDTH // 2, r) for r in range(min(radius, WIDTH - WIDTH // 2) + 1)])), "q_").drop("_block")
        met = store.join(probes, ["part", "prefix"]).drop("part", "prefix")
        found = met.mapInPandas(_best(k, radius, reads), "query_id long, base_id long, score double, read long")
        every = known.unionByName(found).groupBy("query_id", "base_id").agg(F.min("score").alias("score"), F.sum("read").alias("read"))
        each = F.array_sort(F.collect_list(F.when(F.col("base_id").isNotNull(), F.struct("score", "base_id"))))
        best = written(every.groupBy("query_id").agg(F.slice(each, 1, k).alias("best"), F.sum("read").alias("read")), "known")
        # Whatever is nearer than the bound has been read.
        bound = parts * (radius + 1)
        settled = (F.size("best") == k) & (F.element_at("best", -1)["score"] < bound)
        last = radius == WIDTH
        done.append(best.filter(F.lit(True) if last else settled).withColumn("radius", F.lit(radius)))
        open_ = best.filter(~settled)
        known = open_.select("query_id", "read", F.posexplode_outer("best").alias("i", "x")).select("query_id", F.col("x.base_id").alias("base_id"), F.col("x.score").alias("score"), F.when(F.coalesce("i", F.lit(0)) == 0, F.col("read")).otherwise(0).cast("long").alias("read"))
        found_ = best.select("query_id", settled.alias("settled"), F.when(F.size("best") == k, F.element_at("best", -1)["score"].cast("int")).alias("now"))
        asked = written(asked.join(found_, "query_id", "left").filter(~F.coalesce("settled", F.lit(False))).select("query_id", "code", F.coalesce("now", "limit").alias("limit")), "asked")
        radius += 1
    rows = done[0] if done else empty.groupBy("query_id").agg(F.collect_list(F.struct("score", "base_id")).alias("best"), F.sum("read").alias("read")).withColumn("radius", F.lit(0))
    for more in done[1:]:
        rows = rows.unionByName(more)
    ranked = rows.select("query_id", F.posexplode("best").alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.base_id").alias("base_id"), F.col("x.score").alias("score"))
    return ranked, rows.select("query_id", "radius", "read")
