"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified.

Equal vectors are one class from the start.  A class vector is rotated by sign flips and Hadamard
transforms; the coordinate of largest magnitude, with its sign, is a hash of 2d values, and PARTS of
them make a bucket of one of TABLES tables.  Every class is stored in one bucket a table and looks
into the PROBES likeliest ones.  Rows of the join are narrow: bucket, class and 128 sign bits, and a
pair whose bits differ in more than MAX_BITS places (six deviations beyond what the threshold allows)
ends inside the join.  What is left is compared exactly, in double precision.

Buckets of more than SMALL classes are not joined but dealt out in blocks of BLOCK classes; every two blocks
are a matrix product, which gives back how many each class is linked with and a forest of its links, not
pairs.  A pair that meets in several buckets belongs to one of them, which both vectors' codes tell.

The number of parts follows the number of classes, so that a bucket holds a few classes at any size.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are components of their own; vectors of different length never link; every row is a
vector, also under a repeated or null vec_id; a component's id is its smallest vec_id (null if it has
none); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm.common import materialise, scratch, small_batches, table
from rungwise.llm.components import components

THRESHOLD = 0.95
#: Tables for each part of a hash: longer hashes agree more seldom.
TABLES_PER_PART = 4
PROBES = 6
#: Classes that a bucket holds on average, about.
BUCKET = 8
MAX_BITS = 34
#: Classes of a bucket up to which pairs are joined, and classes of a block beyond it.
SMALL, BLOCK = 96, 512
#: Components under which the bits of a vector depend on each other too much to rule pairs out.
MIN_BITS_LENGTH = 8
SEED = 20240229


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform along the last axis, whose length is a power of two."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """The rotation of that number: three rounds of random signs and a Hadamard transform."""
    signs = np.random.default_rng([SEED, number, x.shape[1]]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def parts_for(n: int, dimension: int) -> int:
    return max(1, min(4, ceil(log(max(n / BUCKET, 1.0)) / log(2 * dimension))))


def hashed(vectors: np.ndarray, parts: int, tables: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each table and probe, the first probe being the stored one; two words of sign bits)."""
    n, d = vectors.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :d] = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    choices = min(3, 2 * size)
    combos = np.array(list(product(range(choices), repeat=parts)))
    probes = min(probes, len(combos))
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        picks, costs = [], []
        for p in range(parts):
            y = rotated(x, t * 8 + p)
            signed = np.concatenate([y, -y], axis=1)
            top = np.argpartition(-signed, choices - 1, axis=1)[:, :choices]
            value = np.take_along_axis(signed, top, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            picks.append(top)
            costs.append((value[:, :1] - value) ** 2)
        cost = sum(costs[p][:, combos[:, p]] for p in range(parts))
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        code = np.full((n, probes), t, np.int64)
        for p in range(parts):
            code = code * (2 * size) + np.take_along_axis(picks[p], combos[best, p], 1)
        out[:, t] = code * 4096 + d % 4096
    bits = np.concatenate([rotated(x, 1000 + i) for i in range(-(-128 // size))], axis=1)[:, :128] > 0
    words = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    return out, words


def _stack(values) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the vectors of each length."""
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        by_length.setdefault(len(v), []).append(i)
    for rows in by_length.values():
        yield np.array(rows), np.stack([np.asarray(values[i], np.float64) for i in rows])


def classes_of(vectors: DataFrame) -> DataFrame:
    """One row for each distinct usable vector: cid, its two keys, copies, least id, the vector."""
    usable = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = usable.filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    grouped = usable.groupBy(*_keys("v")).agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("v").alias("v"))
    return materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")


def _keys(column: str) -> tuple:
    return F.xxhash64(column).alias("k0"), F.xxhash64(F.lit(1), column).alias("k1")


def codes_of(classes: DataFrame) -> DataFrame:
    """cid, codes (the buckets of every table, the stored one first in each) and sign bits."""
    size = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = parts_for(size[0], size[1] or 1)
    tables = TABLES_PER_PART * parts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["cid"].to_numpy()
            for at, matrix in _stack(batch["v"].tolist()):
                for i in range(0, len(at), 2000):
                    codes, words = hashed(matrix[i : i + 2000], parts, tables)
                    # Vectors of few components have fewer probes; the stored one fills up.
                    full = np.concatenate([codes, np.repeat(codes[:, :, :1], PROBES - codes.shape[2], axis=2)], axis=2)
                    yield pd.DataFrame({"cid": ids[at[i : i + 2000]], "codes": list(full.reshape(len(full), -1)), "s0": words[:, 0], "s1": words[:, 1]})

    return materialise(classes.select("cid", "v").mapInPandas(run, "cid long, codes array<long>, s0 long, s1 long"), "vector-codes")


def candidates(rows: DataFrame, most_bits: int) -> DataFrame:
    """Distinct pairs (a, b) of classes, a < b, that share a bucket and most sign bits."""
    x, y = rows.filter("stored").alias("x"), rows.alias("y")
    differ = F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) + F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1")))
    met = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.cid") != F.col("y.cid")) & (differ <= most_bits))
    return met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows with each other, in double precision."""
    x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))  # no overflow in the squares
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def _home(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket that a pair belongs to, from codes (..., tables, probes) of the lesser and the greater class.

    It is in the first table where one is stored in a bucket that the other looks into, the lesser's bucket first.
    """
    in_b = (a[..., :, :1] == b).any(-1)
    in_a = (b[..., :, :1] == a).any(-1)
    table = (in_b | in_a).argmax(-1)[..., None]
    pick = lambda m: np.take_along_axis(m, table, -1)[..., 0]
    stored_a, stored_b = (np.broadcast_to(m[..., 0], in_b.shape) for m in (a, b))
    return np.where(pick(in_b), pick(stored_a), pick(stored_b))


def _verified(pairs: DataFrame, classes: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """a, b, home of the pairs whose cosine, in double precision, is at least the threshold."""
    known = classes.select("cid", "v").join(codes.select("cid", "codes"), "cid")
    left = known.select(F.col("cid").alias("a"), F.col("v").alias("va"), F.col("codes").alias("ca"))
    right = known.select(F.col("cid").alias("b"), F.col("v").alias("vb"), F.col("codes").alias("cb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = batch[batch["va"].map(len) == batch["vb"].map(len)]
            for _, rows in same.groupby(same["va"].map(len)):
                rows = rows[cosines(np.stack(rows["va"].to_numpy()), np.stack(rows["vb"].to_numpy())) >= threshold]
                if len(rows):
                    ca, cb = (np.stack(rows[c].to_numpy()).reshape(len(rows), -1, PROBES) for c in ("ca", "cb"))
                    yield rows[["a", "b"]].assign(home=_home(ca, cb))

    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long, home long")


def _forest(left: np.ndarray, right: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what all of them join: at most one fewer than there are classes."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, row in zip(left.tolist(), links):
        for j in right[row].tolist():
            x, y = find(i), find(j)
            if x != y:
                root[x] = y
                out.append((min(i, j), max(i, j)))
    return out


def _block_links(left, right, same: bool, bucket: int, threshold: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(links of a forest, (class, vectors it is linked with)) of the pairs of two blocks that belong to the bucket."""
    forest, counts = [], []
    lengths = {len(m["v"]) for m in left} & {len(m["v"]) for m in right}
    for d in lengths:
        a, b = ([m for m in side if len(m["v"]) == d] for side in (left, right))
        ia, ib = (np.array([m["cid"] for m in side]) for side in (a, b))
        x, y = (np.stack([np.asarray(m["v"], np.float64) for m in side]) for side in (a, b))
        ux, uy = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))
        ux, uy = (m / np.sqrt((m * m).sum(axis=1, keepdims=True)) for m in (ux, uy))
        rough = ux @ uy.T
        links = rough >= threshold
        near = np.argwhere(np.abs(rough - threshold) < 1e-9)
        if len(near):
            links[near[:, 0], near[:, 1]] = cosines(x[near[:, 0]], y[near[:, 1]]) >= threshold
        links &= (ia[:, None] < ib[None, :]) if same else (ia[:, None] != ib[None, :])
        at = np.argwhere(links)
        ca, cb = (np.stack([np.asarray(m["codes"]) for m in side]).reshape(len(side), -1, PROBES) for side in (a, b))
        for i in range(0, len(at), 65_536):
            p, q = at[i : i + 65_536].T
            less = (ia[p] < ib[q])[:, None, None]
            home = _home(np.where(less, ca[p], cb[q]), np.where(less, cb[q], ca[p]))
            links[p, q] = home == bucket
        ka, kb = (np.array([m["copies"] for m in side]) for side in (a, b))
        counts += [(int(i), int(n)) for i, n in zip(ia, links @ kb) if n] + [(int(i), int(n)) for i, n in zip(ib, links.T @ ka) if n]
        forest += _forest(ia, ib, links)
    return forest, counts


def _dense_links(rows: DataFrame, sizes: DataFrame, classes: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """cid, other, n: links of the large buckets (n NULL), and how many vectors a class is linked with there (other NULL)."""
    blocks = sizes.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("n"))
    dealt = rows.select("bucket", "cid").join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "cid"), "n").cast("int"))
    known = classes.select("cid", "copies", "v").join(codes.select("cid", "codes"), "cid")
    member = F.struct("cid", "copies", "v", "codes")
    every = dealt.join(known, "cid").groupBy("bucket", "n", "block").agg(F.collect_list(member).alias("members"))
    every = materialise(every, "vector-blocks")
    left = every.select("bucket", F.col("block").alias("i"), F.col("members").alias("left"), F.explode(F.sequence("block", F.col("n") - 1)).alias("block"))
    pairs = left.join(every.select("bucket", "block", F.col("members").alias("right")), ["bucket", "block"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, same, x, y in zip(batch["bucket"], batch["same"], batch["left"], batch["right"]):
                forest, counts = _block_links(x, y, same, bucket, threshold)
                made = [(a, b, None) for a, b in forest] + [(c, None, n) for c, n in counts]
                yield pd.DataFrame(made, columns=["cid", "other", "n"], dtype=object)

    ready = pairs.select("bucket", (F.col("i") == F.col("block")).alias("same"), "left", "right")
    return materialise(small_batches(ready).mapInPandas(run, "cid long, other long, n long"), "vector-dense")


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    with scratch():
        done = _linked_classes(vectors, threshold)
    keyed = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).select("vec_id", *_keys("v"))
    out = keyed.join(done, ["k0", "k1"], "left")
    known = F.col("n_links").isNotNull()
    component = F.when(known, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _linked_classes(vectors: DataFrame, threshold: float) -> DataFrame:
    classes = classes_of(vectors)
    codes = codes_of(classes)
    shortest = classes.agg(F.min(F.size("v"))).first()[0]
    most_bits = MAX_BITS if (shortest or 0) >= MIN_BITS_LENGTH else 128
    held = codes.select("cid", "s0", "s1", "codes", F.posexplode("codes").alias("at", "bucket")).withColumn("stored", F.col("at") % PROBES == 0)
    filled = ~F.col("stored") & (F.get("codes", F.col("at") - F.col("at") % PROBES) == F.col("bucket"))
    rows = materialise(held.filter(~filled).select("bucket", "cid", "s0", "s1", "stored"), "vector-buckets")
    sizes = materialise(rows.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > SMALL), "vector-sizes")
    small = rows.join(sizes, "bucket", "left_anti")
    found = _verified(candidates(small, most_bits), classes, codes, threshold)
    links = materialise(found.join(sizes.withColumnRenamed("bucket", "home"), "home", "left_anti").select("a", "b"), "vector-links")
    dense = _dense_links(rows.join(sizes, "bucket", "left_semi"), sizes, classes, codes, threshold)
    copies = classes.select(F.col("cid").alias("other"), "copies")
    ends = links.select(F.col("a").alias("cid"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("cid"), F.col("a").alias("other")))
    counted = ends.join(copies, "other").select("cid", F.col("copies").alias("n")).unionByName(dense.filter("other IS NULL").select("cid", "n"))
    degree = counted.groupBy("cid").agg(F.sum("n").alias("linked"))
    links = links.unionByName(dense.filter("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    grouped = classes.select("cid", "k0", "k1", "copies", "least_id").join(components(links).withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    done = grouped.join(least, "component").join(degree, "cid", "left").select("k0", "k1", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    return materialise(done, "vector-groups", keep=True)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# All pairs in double precision, and what the links reach by recursion.
OP3_SQL = f"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS i, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS MATERIALIZED (SELECT i, vec_id, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) AS e FROM r
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda y: abs(y))) > 0),
n AS MATERIALIZED (SELECT i, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
h AS MATERIALIZED (SELECT a.i AS a, b.i AS b FROM n a JOIN n b ON a.i <> b.i AND len(a.e) = len(b.e) WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= {THRESHOLD}),
reach AS (SELECT i, i AS j FROM r UNION SELECT reach.i, h.b FROM reach JOIN h ON h.a = reach.j),
least AS (SELECT reach.i, min(r.vec_id) AS component_id FROM reach JOIN r ON r.i = reach.j GROUP BY reach.i)
SELECT vec_id, (SELECT count(*) FROM h WHERE h.a = r.i) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM r JOIN least USING (i)
"""
