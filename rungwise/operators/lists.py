"""Inverted lists searched in blocks: whole vectors, or product codes of residuals with refinement codes.

Vectors and the queries that probe a list are packed into rows of a block of the list, about BLOCK vectors
each; blocks meet by list, a block's scores are one matrix, and only each query's best of the block leave the
task.  No (query, vector) row exists before that.  A list larger than a block has several, so that a hot list
is many rows of its key, which Spark splits where they are skewed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.operators import indexes, search

BLOCK = search.BLOCK
#: Candidates for each wanted neighbour that refinement codes score again.
FACTOR = 4


def lists_for(n: int) -> int:
    """Lists of an index of n vectors: the square root, so that probed pairs grow as n times its root."""
    return max(1, math.isqrt(n))


def packed(rows: DataFrame, by: str, values: list[str], prefix: str) -> DataFrame:
    """Rows of about BLOCK members of one value of ``by``: arrays of the given columns, renamed with the prefix."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n"))
    dealt = rows.join(sizes, by).withColumn("_block", F.pmod(F.xxhash64(values[0]), F.ceil(F.col("_n") / BLOCK)))
    return dealt.groupBy(by, "_block").agg(*[F.collect_list(v).alias(prefix + v) for v in values]).drop("_block")


def _best(q_ids, b_ids, score, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each query's best of a block: least score, then least id; never the query itself."""
    score = np.where(q_ids[:, None] == b_ids[None, :], np.inf, score)
    last = np.partition(score, keep - 1, axis=1)[:, keep - 1 : keep] if keep < score.shape[1] else np.inf
    row, column = np.nonzero((score <= last) & np.isfinite(score))
    kept = search._kept(keep, row, b_ids[column], score[row, column])
    return row[kept], column[kept]


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v) for v in values]).astype(np.float64)


def with_lists(vectors: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """vec_id, list, e: a row for each of the nearest lists of a vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(indexes._held(centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = np.argsort(search.scores("l2", _matrix(batch["e"]), shared.value), axis=1, kind="stable")[:, :probes]
            wide = batch.loc[batch.index.repeat(near.shape[1])].reset_index(drop=True)
            yield wide.assign(list=near.ravel().astype(np.int32))[["vec_id", "list", "e"]]

    return vectors.select("vec_id", "e").mapInPandas(run, "vec_id long, list int, e array<double>")


def search_lists(members: DataFrame, queries: DataFrame, k: int = search.K) -> DataFrame:
    """query_id, rank, base_id, list, score: the k nearest members of each query's probed lists.

    ``members`` and ``queries`` are vec_id, list, e.
    """

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                found = search._nearest("l2", k, np.asarray(r.q_vec_id), _matrix(r.q_e), np.asarray(r.b_vec_id), _matrix(r.b_e), False)
                yield found.assign(list=np.int32(r.list))[["query_id", "base_id", "list", "score"]]

    met = packed(members, "list", ["vec_id", "e"], "b_").join(packed(queries, "list", ["vec_id", "e"], "q_"), "list")
    found = met.select("list", "b_vec_id", "b_e", "q_vec_id", "q_e").mapInPandas(near, "query_id long, base_id long, list int, score double")
    return search.top_k(found, k).select("query_id", "rank", "base_id", "list", "score")


def range_lists(members: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """query_id, base_id, score of all pairs in probed lists that are closer than the radius."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, b_ids = np.asarray(r.q_vec_id), np.asarray(r.b_vec_id)
                score = search.scores("l2", _matrix(r.q_e), _matrix(r.b_e))
                i, j = np.nonzero((score < radius) & (q_ids[:, None] != b_ids[None, :]))
                yield pd.DataFrame({"query_id": q_ids[i], "base_id": b_ids[j], "score": score[i, j]})

    met = packed(members, "list", ["vec_id", "e"], "b_").join(packed(queries, "list", ["vec_id", "e"], "q_"), "list")
    return met.select("b_vec_id", "b_e", "q_vec_id", "q_e").mapInPandas(near, "query_id long, base_id long, score double")


# --- product codes of residuals -----------------------------------------------------------------------------


def less_centre(members: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, list, e: each vector less the centre of its list."""
    shared = members.sparkSession.sparkContext.broadcast(indexes._held(centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(e=list(_matrix(batch["e"]) - shared.value[batch["list"].to_numpy()]))

    return members.select("vec_id", "list", "e").mapInPandas(run, "vec_id long, list int, e array<double>")


def _codes(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    width = books.shape[2]
    return np.stack([search.scores("l2", x[:, p * width : (p + 1) * width], books[p]).argmin(axis=1) for p in range(len(books))], axis=1)


def _meant(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1)


def less_codes(residuals: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, list, e: what product codes of the residuals leave."""
    shared = residuals.sparkSession.sparkContext.broadcast(indexes._held(books))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["e"])
            yield batch.assign(e=list(x - _meant(_codes(x, shared.value), shared.value)))

    return residuals.select("vec_id", "list", "e").mapInPandas(run, "vec_id long, list int, e array<double>")


def coded(residuals: DataFrame, books: np.ndarray, refining: np.ndarray) -> DataFrame:
    """vec_id, list, codes, finer: the codes of each residual, and of what they leave of it."""
    shared = residuals.sparkSession.sparkContext.broadcast((indexes._held(books), indexes._held(refining)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books, refining = shared.value
        for batch in batches:
            x = _matrix(batch["e"])
            codes = _codes(x, books)
            finer = _codes(x - _meant(codes, books), refining)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "list": batch["list"], "codes": list(codes.astype(np.int32)), "finer": list(finer.astype(np.int32))})

    return residuals.select("vec_id", "list", "e").mapInPandas(run, "vec_id long, list int, codes array<int>, finer array<int>")


def search_codes(codes: DataFrame, queries: DataFrame, centres: np.ndarray, books: np.ndarray, refining: np.ndarray, k: int = search.K, factor: int = FACTOR) -> DataFrame:
    """query_id, rank, base_id, score, refined: the k best of the ``factor`` k best by codes, in the order of refinement.

    A query less a list's centre has a table of distances to all centres of the books; a member's score is
    the sum of its entries.  ``codes`` comes from :func:`coded`; ``queries`` is vec_id, list, e of probed lists.
    """
    shared = codes.sparkSession.sparkContext.broadcast((centres, books, refining))
    keep = k * factor

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, books, refining = shared.value
        width = books.shape[2]
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, b_ids = np.asarray(r.q_vec_id), np.asarray(r.b_vec_id)
                q = _matrix(r.q_e) - centres[r.list]
                z, finer = (np.stack([np.asarray(v) for v in c]) for c in (r.b_codes, r.b_finer))
                score = np.zeros((len(q), len(z)))
                for p in range(len(books)):
                    score += search.scores("l2", q[:, p * width : (p + 1) * width], books[p])[:, z[:, p]]
                i, j = _best(q_ids, b_ids, score, keep)
                off = q[i] - _meant(z[j], books) - _meant(finer[j], refining)
                yield pd.DataFrame({"query_id": q_ids[i], "base_id": b_ids[j], "score": score[i, j], "refined": (off * off).sum(axis=1)})

    met = packed(codes, "list", ["vec_id", "codes", "finer"], "b_").join(packed(queries, "list", ["vec_id", "e"], "q_"), "list")
    found = met.select("list", "b_vec_id", "b_codes", "b_finer", "q_vec_id", "q_e").mapInPandas(near, "query_id long, base_id long, score double, refined double")
    first = search.top_k(found, keep).withColumnRenamed("score", "coded").withColumnRenamed("refined", "score").drop("rank")
    return search.top_k(first, k).select("query_id", "rank", "base_id", F.col("coded").alias("score"), F.col("score").alias("refined"))
