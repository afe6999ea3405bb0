"""Queries of binary codes in buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungwise.operators import bits
from rungwise.plans.catalogue import _knn_sql
from rungwise.plans.registry import query, vecs

_WIDTH = bits.WIDTH
#: Reads are counted for the vectors whose ids are divisible by this.
EVERY = 50
_PARTS = f"""{_knn_sql('hamming')}, piece AS MATERIALIZED (SELECT vec_id, p, list_sum(list_transform(range(1, {_WIDTH + 1}), lambda i: CASE WHEN e[p * {_WIDTH} + i] > 0 THEN 1 << ({_WIDTH} - i) ELSE 0 END))::INT AS value
  FROM vec, (SELECT unnest(range(0, (SELECT max(len(e)) FROM vec) // {_WIDTH}))::INT AS p)),
reach AS (SELECT query_id, CAST(floor(max(score) / (SELECT count(DISTINCT p) FROM piece)) AS INT) AS radius FROM knn WHERE query_id % {EVERY} = 0 GROUP BY query_id)"""


@query("multi_index_hashing", f"WITH {_knn_sql('hamming')} SELECT query_id, CAST(rank AS INT) AS rank, base_id, score FROM knn")
def multi_index_hashing(spark, sf_dir):
    """Exact nearest neighbours of all sign codes from buckets of their substrings."""
    codes = bits.codes_of(vecs(spark, sf_dir))
    return bits.search_codes(codes, codes, reads=False)[0]


@query("hash_reads", f"WITH {_PARTS} SELECT query_id, radius, count(*) AS read FROM reach JOIN piece a ON a.vec_id = query_id JOIN piece b ON b.p = a.p AND b.vec_id <> a.vec_id AND bit_count(xor(a.value, b.value)) <= radius GROUP BY ALL")
def hash_reads(spark, sf_dir):
    """How many bits each query flipped before its neighbours were certain, and how many codes it read for that."""
    codes = bits.codes_of(vecs(spark, sf_dir))
    return bits.search_codes(codes, codes.filter(F.col("vec_id") % EVERY == 0))[1].select("query_id", F.col("radius"), "read")
