"""Trained indexes: k-means lists, product codes, scalar codes, rotations, and an index written as a string.

Training keeps centres on the driver (MAX_CENTRE_BYTES, checked); vectors never leave the executors but as
sums.  Whatever holds the codes or lists of vectors is a table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions import distance as D
from rungwise.operators import search
from rungwise.operators.resample import mixed
from rungwise.operators.storage import written

MAX_CENTRE_BYTES = 64 << 20


def _held(centres: np.ndarray) -> np.ndarray:
    if centres.nbytes > MAX_CENTRE_BYTES:
        raise ValueError(f"centres of {centres.nbytes} bytes; {MAX_CENTRE_BYTES} at most")
    return centres


def picks(base: DataFrame, n: int, seed: int = 1) -> np.ndarray:
    """The n vectors of least key, in its order: where training starts."""
    key = mixed(F.pmod(F.col("vec_id"), F.lit(1 << 40)), seed)
    rows = base.select("vec_id", key.alias("key"), "e").orderBy("key", "vec_id").limit(n).collect()
    return _held(np.array([r["e"] for r in rows], np.float64))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest centre, squared distance) for each row, ties to the smaller place."""
    d = search.scores("l2", x, centres)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def kmeans(base: DataFrame, start: np.ndarray, parts: int = 1, rounds: int = 10) -> np.ndarray:
    """Centres (parts, k, d / parts) after some rounds of Lloyd's steps; a centre without vectors stays where it is.

    With several parts every slice of the vectors has its own centres, trained in the same passes. Ends early
    once nothing moves.
    """
    k, d = start.shape
    if d % parts:
        raise ValueError("the dimension is no multiple of the parts")
    centres = np.ascontiguousarray(start.reshape(k, parts, d // parts).transpose(1, 0, 2))
    spark = base.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            c = shared.value
            total, count = np.zeros_like(c), np.zeros(c.shape[:2], np.int64)
            for batch in batches:
                x = np.stack([np.asarray(v, np.float64) for v in batch["e"]])
                for p in range(len(c)):
                    part = x[:, p * c.shape[2] : (p + 1) * c.shape[2]]
                    at, _ = _nearest(part, c[p])
                    np.add.at(total[p], at, part)
                    count[p] += np.bincount(at, minlength=c.shape[1])
            for p, i in zip(*np.nonzero(count)):
                yield pd.DataFrame({"part": [p], "code": [i], "n": [count[p, i]], "s": [total[p, i]]})

        # A row a task, part and centre; summed by element, so that the driver gets one row a part and centre.
        rows = base.select("e").mapInPandas(sums, "part int, code int, n long, s array<double>")
        s = rows.select("part", "code", "n", F.posexplode("s").alias("i", "v")).groupBy("part", "code", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        s = s.groupBy("part", "code").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("s"))
        moved = centres.copy()
        for r in s.collect():
            moved[r["part"], r["code"]] = np.array(r["s"]) / r["n"]
        still = np.array_equal(moved, centres)
        centres = moved
        if still:
            break
    return centres


def assigned(base: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """vec_id, rank (from 1), list, distance: the nearest lists of each vector."""
    shared = base.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for batch in batches:
            d = search.scores("l2", np.stack([np.asarray(v, np.float64) for v in batch["e"]]), c)
            near = np.argsort(d, axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame({"vec_id": np.repeat(batch["vec_id"].to_numpy(), near.shape[1]), "rank": np.tile(np.arange(1, near.shape[1] + 1), len(batch)), "list": near.ravel(), "distance": np.take_along_axis(d, near, 1).ravel()})

    return base.select("vec_id", "e").mapInPandas(run, "vec_id long, rank int, list int, distance double")


def residuals(base: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, list, e: each vector less the centre of its list."""
    spark = base.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, c array<double>"))  # within MAX_CENTRE_BYTES
    return base.join(assigned(base, centres).select("vec_id", "list"), "vec_id").join(table, "list").select("vec_id", "list", D.added(F.col("e"), F.col("c"), -1.0).alias("e"))


# --- product codes -----------------------------------------------------------------------------------------


def product_codes(base: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, codes: the nearest centre of each slice."""
    shared = base.sparkSession.sparkContext.broadcast(_held(centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        width = c.shape[2]
        for batch in batches:
            x = np.stack([np.asarray(v, np.float64) for v in batch["e"]])
            codes = np.stack([_nearest(x[:, p * width : (p + 1) * width], c[p])[0] for p in range(len(c))], axis=1)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "codes": list(codes)})

    return base.select("vec_id", "e").mapInPandas(run, "vec_id long, codes array<int>")


def decoded(codes: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, e: what product codes stand for."""
    shared = codes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for batch in batches:
            z = np.stack(batch["codes"].to_numpy())
            yield pd.DataFrame({"vec_id": batch["vec_id"], "e": list(np.concatenate([c[p][z[:, p]] for p in range(len(c))], axis=1))})

    return codes.select("vec_id", "codes").mapInPandas(run, "vec_id long, e array<double>")


def product_search(codes: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = search.K) -> DataFrame:
    """query_id, rank, base_id, score: the k least distances between queries and what the codes stand for.

    A query's distances to all centres are a table of its own; a vector's score is the sum of its entries.
    """
    shared, width = codes.sparkSession.sparkContext.broadcast(_held(centres)), centres.shape[2]

    def near(q_ids, q, b_ids, z) -> pd.DataFrame:
        c = shared.value
        parts, many = len(c), c.shape[1]
        place = z.astype(np.int64) + many * np.arange(parts)
        ones = np.zeros((len(place), parts * many), np.float32)
        ones[np.arange(len(place))[:, None], place] = 1
        out = []
        for i in range(0, len(q), search.BLOCK):
            ids = q_ids[i : i + search.BLOCK]
            table = np.concatenate([search.scores("l2", q[i : i + search.BLOCK, p * width : (p + 1) * width], c[p]) for p in range(parts)], axis=1)
            # Sums in single precision are off by no more than this; what they leave in question is added exactly.
            slack = (parts + 8) * 2.0**-23 * table.reshape(len(ids), parts, many).max(axis=2).sum(axis=1)
            rough_table, last = table.astype(np.float32), np.full(len(ids), np.inf)
            row, column, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for j in range(0, len(place), 4 * search.BLOCK):
                rough = (rough_table @ ones[j : j + 4 * search.BLOCK].T).astype(np.float64)
                rough[ids[:, None] == b_ids[None, j : j + 4 * search.BLOCK]] = np.inf
                limit = last
                if k < rough.shape[1] and np.isinf(last).any():
                    limit = np.minimum(last, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
                r, at = np.nonzero((rough <= (limit + slack)[:, None]) & np.isfinite(rough))
                s = np.zeros(len(r))
                for p in range(parts):
                    s += table[r, place[j + at, p]]
                row, column, score = np.append(row, r), np.append(column, j + at), np.append(score, s)
                keep = search._kept(k, row, b_ids[column], score)
                row, column, score = row[keep], column[keep], score[keep]
                ends = np.cumsum(np.bincount(row, minlength=len(ids)))
                full = np.bincount(row, minlength=len(ids)) == k
                last = np.where(full, score[np.maximum(ends - 1, 0)] if len(score) else np.inf, np.inf)
            out.append(pd.DataFrame({"query_id": ids[row], "base_id": b_ids[column], "score": score}))
        return pd.concat(out, ignore_index=True)

    rows = codes.select("vec_id", F.col("codes").cast("array<double>").alias("e"))
    return search.top_k(search.paired(rows, queries, near, "query_id long, base_id long, score double", True), k).select("query_id", "rank", "base_id", "score")


# --- codes of single elements and transforms ---------------------------------------------------------------


def row_codes(base: DataFrame, levels: int = 256) -> DataFrame:
    """vec_id, lo, width, codes: each vector between its own least and largest element."""
    lo, hi = F.array_min("e"), F.array_max("e")
    ranged = base.select("vec_id", "e", lo.alias("lo"), ((hi - lo) / (levels - 1)).alias("width"))
    code = lambda x: F.when(F.col("width") > 0, F.floor((x - F.col("lo")) / F.col("width") + 0.5)).otherwise(0).cast("int")
    return ranged.select("vec_id", "e", "lo", "width", F.transform("e", code).alias("codes"))


def half_precision(base: DataFrame, kind: str = "fp16") -> DataFrame:
    """vec_id, e as 16-bit floats would hold them: fp16 by rounding, bf16 by dropping the lower half of a float's bits."""

    @F.pandas_udf("array<double>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = []
            for v in batch:
                x = np.asarray(v, np.float32)
                rows.append(x.astype(np.float16).astype(np.float64) if kind == "fp16" else (x.view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32).astype(np.float64))
            yield pd.Series(rows)

    return base.select("vec_id", cut("e").alias("e"))


def hadamard_rotated(base: DataFrame, seed: int = 3) -> DataFrame:
    """vec_id, e after signs by position and the Hadamard matrix, over its norm: distances stay; the dimension is a power of two."""

    def rotate(x: np.ndarray) -> np.ndarray:
        n, h = x.shape[1], 1
        if n & (n - 1):
            raise ValueError("the dimension is no power of two")
        x = x * np.where((np.arange(n) * 40503 + seed * 7919) % 1009 % 2, -1.0, 1.0)
        while h < n:
            y = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
            h *= 2
        return x / np.sqrt(n)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(rotate(np.stack([np.asarray(v, np.float64) for v in batch]))))

    return base.select("vec_id", run("e").alias("e"))


def principal(base: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes as rows, variances) of the largest variances, from sums of products made by the executors."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, p = 0, 0.0, 0.0
        for batch in batches:
            x = np.stack([np.asarray(v, np.float64) for v in batch["e"]])
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "p": [p.ravel()]})

    rows = base.select("e").mapInPandas(sums, "n long, s array<double>, p array<double>")
    n = rows.agg(F.sum("n")).first()[0]
    whole = lambda c: np.array([r["v"] for r in rows.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])
    mean = whole("s") / n
    covariance = _held(whole("p").reshape(len(mean), -1)) / n - np.outer(mean, mean)
    value, axis = np.linalg.eigh(covariance)
    order = np.argsort(-value)[:dims]
    axes = axis[:, order].T
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None], value[order]


def projected(base: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """vec_id, e along the axes."""
    shared = base.sparkSession.sparkContext.broadcast((mean, axes))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, a = shared.value
        for batch in batches:
            yield pd.Series(list((np.stack([np.asarray(v, np.float64) for v in batch]) - m) @ a.T))

    return base.select("vec_id", run("e").alias("e"))


def median_signs(base: DataFrame) -> DataFrame:
    """vec_id, e of 1 above a dimension's median and -1 else: bits whose Hamming distance a search compares."""
    medians = base.select(F.posexplode("e").alias("dim", "v")).groupBy("dim").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    row = medians.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("m"))
    sign: Column = F.zip_with("e", "m", lambda x, m: F.when(x > m, 1.0).otherwise(-1.0))
    return base.crossJoin(F.broadcast(row)).select("vec_id", sign.alias("e"))  # one row


# --- tables of vectors that change -------------------------------------------------------------------------


def removed(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("vec_id"), "vec_id", "left_anti")


def added(base: DataFrame, more: DataFrame) -> DataFrame:
    """Vectors under their ids; an id that is there is an error."""
    if not base.select("vec_id").join(more.select("vec_id"), "vec_id", "left_semi").isEmpty():
        raise ValueError("an id is there already")
    return base.unionByName(more)


def updated(base: DataFrame, more: DataFrame) -> DataFrame:
    """Vectors under their ids, in place of those that have them."""
    return removed(base, more).unionByName(more)


# --- an index by name --------------------------------------------------------------------------------------


#: Centres of a slice and turns with which an OPQ transform is fitted.
OPQ_CODES, OPQ_TURNS = 16, 6


def build(spec: str, base: DataFrame, made: dict | None = None):
    """A search (queries, k) -> neighbours for a description: an optional transform, an index, an optional re-ranking.

    ``PCA16,IVF8,Flat``, ``HR,PQ8x16``, ``SQ8``, ``LSH``, ``Flat``, ``PQ8x16,RFlat``: transforms PCAn (axes),
    HR (rotation), OPQm (a rotation fitted to m slices) and L2norm; indexes Flat, IVFn,Flat (a quarter of the
    lists is probed), PQmxk, IVFn,PQmxk (codes of residuals; IVFn,PQmxkR with codes that refine them), SQ4, SQ6,
    SQ8 and LSH; RFlat ranks four times as many again by full distances. Descriptions of the same ``base`` that share
    ``made`` train what they have in common once.
    """
    from rungwise.operators import additive, lists  # they are built on this module

    made = {} if made is None else made

    def once(key: tuple, make):
        if key not in made:
            made[key] = make()
        return made[key]

    parts = [p for p in spec.split(",") if p != "IDMap"]
    head = parts[0]
    transform = lambda rows: rows
    if parts[0].startswith("PCA"):
        mean, axes, _ = principal(base, int(parts.pop(0)[3:]))
        transform = lambda rows: projected(rows, mean, axes)
    elif m := re.fullmatch(r"OPQ(\d+)", parts[0]):
        parts.pop(0)
        rotation = additive.opq(base, int(m[1]), OPQ_CODES, OPQ_TURNS)[0]
        transform = lambda rows: additive.turned(rows, rotation)
    elif parts[0] == "HR":
        parts.pop(0)
        transform = hadamard_rotated
    elif parts[0] == "L2norm":
        parts.pop(0)
        transform = lambda rows: rows.select("vec_id", D.normalised(F.col("e"), 1e-30).alias("e"))
    refine = parts[-1] == "RFlat" and bool(parts.pop())
    head = head if head != parts[0] else ""
    # What is trained on is read many times.
    inner, name = (once(("inner", head), lambda: written(transform(base), "index-vectors")) if head else base), ",".join(parts)
    if name == "Flat":
        find = lambda q, k: search.exact_knn(inner, q, k)
    elif m := re.fullmatch(r"IVF(\d+),Flat", name):
        n = int(m[1])
        centres = once((head, "IVF", n), lambda: kmeans(inner, picks(inner, n))[0])
        members = lists.with_lists(inner, centres)
        find = lambda q, k: lists.search_lists(members, lists.with_lists(q, centres, max(1, n // 4)), k)
    elif m := re.fullmatch(r"IVF(\d+),PQ(\d+)x(\d+)(R?)", name):
        n, slices, size = int(m[1]), int(m[2]), int(m[3])
        centres = once((head, "IVF", n), lambda: kmeans(inner, picks(inner, n))[0])
        rest = once((head, "rest", n), lambda: written(lists.less_centre(lists.with_lists(inner, centres), centres), "index-rest"))
        books = once((head, "IVF", n, slices, size), lambda: kmeans(rest, picks(rest, size), slices))
        finer = written(lists.less_codes(rest, books), "index-finer") if m[4] else None
        refining = kmeans(finer, picks(finer, size), slices) if m[4] else np.zeros_like(books[:, :1])
        codes = lists.coded(rest, books, refining)
        find = lambda q, k: lists.search_codes(codes, lists.with_lists(q, centres, max(1, n // 4)), centres, books, refining, k, lists.FACTOR if m[4] else 1)
    elif m := re.fullmatch(r"PQ(\d+)x(\d+)", name):
        books = once((head, "PQ", m[1], m[2]), lambda: kmeans(inner, picks(inner, int(m[2])), int(m[1])))
        codes = product_codes(inner, books)
        find = lambda q, k: product_search(codes, q, books, k)
    elif m := re.fullmatch(r"SQ(4|6|8)", name):
        from rungwise.operators import quantize

        held = quantize.scalar_codes(inner, 1 << int(m[1])).select("vec_id", F.col("decoded").alias("e"))
        find = lambda q, k: search.exact_knn(held, q, k)
    elif name == "LSH":
        both = median_signs(inner)
        find = lambda q, k: search.exact_knn(both, both.join(q.select("vec_id"), "vec_id", "left_semi"), k, "hamming")
    else:
        raise ValueError(f"no index {name!r}")

    def found(queries: DataFrame, k: int = search.K) -> DataFrame:
        near = find(transform(queries), 4 * k if refine else k).select("query_id", "rank", "base_id", "score")
        return refined(near, base, queries, k) if refine else near

    return found


def refined(near: DataFrame, base: DataFrame, queries: DataFrame, k: int = search.K) -> DataFrame:
    """The k best of what an index found, by full distances."""
    return search.top_k(search.rescored(near, base, queries, D.l2sq), k).select("query_id", "rank", "base_id", "score")
