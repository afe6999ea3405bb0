"""Resampling of design axes: how often each unit is drawn in each replicate, and statistics under those weights.

A draw is a whole number by integer arithmetic alone, so that every engine and every run draws the same:
a replicate draws as many units as the axis has, with replacement.  Axes are those of a design, builds and
queries; their positions are counted (MAX_UNITS, checked).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.operators.storage import in_order, written

REPLICATES = 5000
MAX_UNITS = 10_000_000
#: Units and replicates of a block of weights, and draws that are made at once.
UNITS, CHUNK, DRAWS = 16_384, 50, 1 << 20
_P = 2147483647


def mixed(x: Column, salt: int) -> Column:
    """A number below 2**31 - 1 from one below 2**60: two squarings modulo that prime."""
    a = (x * 48271 + F.lit(salt * 7919 + 1)) % _P
    b = (a * a) % _P
    c = (b + a * 31337 + 12345) % _P
    return (c * c) % _P


def mixed_sql(x: str, salt: int) -> str:
    a = f"((({x}) * 48271 + {salt * 7919 + 1}) % {_P})"
    c = f"(({a} * {a} % {_P} + {a} * 31337 + 12345) % {_P})"
    return f"({c} * {c} % {_P})"


def placed(units: DataFrame, unit: str) -> tuple[DataFrame, int]:
    """(unit and pos, its place from 0 by value; how many there are)."""
    distinct = units.select(unit).distinct()
    n = distinct.count()
    if n > MAX_UNITS:
        raise ValueError(f"an axis of more than {MAX_UNITS} units")
    return distinct.select(unit, (F.row_number().over(Window.orderBy(unit)) - 1).alias("pos")), n


def weights(units: DataFrame, unit: str, salt: int, replicates: int = REPLICATES) -> DataFrame:
    """rep, unit, w: how often each unit is drawn in each replicate; units that aren't drawn have no row."""
    axis, n = placed(units, unit)
    draws = units.sparkSession.range(replicates * n).select(F.floor(F.col("id") / n).alias("rep"), (mixed(F.col("id") % (1 << 40), salt) % n).cast("int").alias("pos"))
    counted = draws.groupBy("rep", "pos").agg(F.count("*").alias("w"))
    return counted.join(F.broadcast(axis) if n <= 100_000 else axis, "pos").select("rep", unit, "w")


class Draw(NamedTuple):
    """Weights of a long axis in blocks: units by place, (chunk, block, w) of CHUNK replicates by UNITS places, and how many units there are."""

    unit: str
    places: DataFrame
    blocks: DataFrame
    n: int


def draw(units: DataFrame, unit: str, salt: int, replicates: int = REPLICATES, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> Draw:
    """The weights of :func:`weights` in blocks; ``keep`` writes the two tables where others find them."""
    keep = keep or (lambda name, build: written(build(), name))
    places = keep("places", lambda: in_order(units.select(unit).distinct(), unit, name="pos"))
    n = places.count()
    if n > MAX_UNITS:
        raise ValueError(f"an axis of more than {MAX_UNITS} units")

    def counted(rep: int) -> np.ndarray:
        total = np.zeros(n, np.int64)
        for low in range(rep * n, rep * n + n, DRAWS):
            x = np.arange(low, min(low + DRAWS, rep * n + n)) % (1 << 40)
            a = (x * 48271 + salt * 7919 + 1) % _P
            c = (a * a % _P + a * 31337 + 12345) % _P
            total += np.bincount(c * c % _P % n, minlength=n)
        return total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk in batch["id"] if n else ():
                w = np.stack([(t := counted(rep)).astype(np.uint8 if t.max() < 256 else np.int32) for rep in range(chunk * CHUNK, min(chunk * CHUNK + CHUNK, replicates))])
                for block, low in enumerate(range(0, n, UNITS)):
                    yield pd.DataFrame({"chunk": [chunk], "block": [block], "w": [w[:, low : low + UNITS].tobytes()]})

    chunks = -(-replicates // CHUNK)
    tasks = min(chunks, 4 * units.sparkSession.sparkContext.defaultParallelism)
    return Draw(unit, places, keep("blocks", lambda: units.sparkSession.range(0, chunks, 1, tasks).mapInPandas(run, "chunk long, block int, w binary")), n)


def drawn_sums(rows: DataFrame, drawn: Draw, by: list[str], sums: list[str], replicates: int = REPLICATES) -> DataFrame:
    """by, rep, the sums of columns under the weights of the units, and w, the rows' weight; what no draw meets has no row.

    A task multiplies some chunks of a block's weights by the rows of the block's units.
    """
    n, blocks = drawn.n, max(1, -(-drawn.n // UNITS))
    parts = max(1, min(8, rows.sparkSession.sparkContext.defaultParallelism // blocks))

    def product(values: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in [*by, "rep", *sums, "w"]})]
        if len(values) and len(weights):
            size = min(UNITS, n - int(weights["block"].iloc[0]) * UNITS)
            key = values.groupby(by, sort=False, dropna=False).ngroup().to_numpy() if by else np.zeros(len(values), np.int64)
            heads = values.iloc[np.unique(key, return_index=True)[1]][by]
            m = np.zeros((size, len(heads), len(sums) + 1))
            np.add.at(m, (values["at"].to_numpy(), key), np.column_stack([np.nan_to_num(values[sums].to_numpy(float)), np.ones(len(values))]))
            for chunk, raw in zip(weights["chunk"], weights["w"], strict=True):
                reps = min(CHUNK, replicates - chunk * CHUNK)
                w = np.frombuffer(raw, np.uint8 if len(raw) == reps * size else np.int32).reshape(reps, size)
                total = (w.astype(float) @ m.reshape(size, -1)).reshape(reps * len(heads), -1)
                made = pd.concat([heads] * reps, ignore_index=True) if by else pd.DataFrame(index=range(reps))
                made["rep"] = np.repeat(np.arange(reps) + chunk * CHUNK, len(heads))
                out.append(made.assign(**dict(zip([*sums, "w"], total.T, strict=True))))
        return pd.concat(out[1:] or out, ignore_index=True)

    # A number of partitions that is given, as the blocks of a short axis are few.
    tasks = blocks * parts
    placed_rows = rows.join(drawn.places, drawn.unit).select(*by, *sums, F.floor(F.col("pos") / UNITS).cast("int").alias("block"), (F.col("pos") % UNITS).cast("int").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = drawn.blocks.withColumn("part", (F.col("chunk") % parts).cast("int"))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in (rows.schema[c] for c in by)] + ["rep long"] + [f"`{c}` double" for c in [*sums, "w"]])
    met = placed_rows.repartition(tasks, "block", "part").groupBy("block", "part").cogroup(dealt.repartition(tasks, "block", "part").groupBy("block", "part")).applyInPandas(product, fields)
    return met.groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in [*sums, "w"]]).filter("w > 0")


def weights_sql(name: str, axis: str, unit: str, salt: int, replicates: int = REPLICATES) -> str:
    """CTEs that end in ``name`` (rep, unit, w) over the distinct units of ``axis``."""
    return f"""{name}_a AS (SELECT {unit}, row_number() OVER (ORDER BY {unit}) - 1 AS pos FROM (SELECT DISTINCT {unit} FROM {axis})), {name}_n AS (SELECT count(*) AS n FROM {name}_a),
{name} AS MATERIALIZED (SELECT rep, {unit}, w FROM (SELECT i // n AS rep, {mixed_sql('i', salt)} % n AS pos, count(*) AS w FROM (SELECT unnest(range(0, {replicates} * n)) AS i, n FROM {name}_n) GROUP BY ALL) JOIN {name}_a USING (pos))"""


def interval(draws: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, and for each column its 2.5 % and 97.5 % points over the replicates, low_ and high_."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    return draws.groupBy(*by).agg(*[x for c in columns for x in (q(c, 0.025).alias(f"low_{c}"), q(c, 0.975).alias(f"high_{c}"))], F.count("*").alias("replicates"))


def by_query(rows: DataFrame, drawn: DataFrame | Draw, by: list[str], columns: list[str]) -> DataFrame:
    """by, rep and the weighted means of columns over queries; all columns share the draw."""
    if isinstance(drawn, Draw):
        return drawn_sums(rows, drawn, by, columns).select(*by, "rep", *[(F.col(c) / F.col("w")).alias(c) for c in columns])
    return rows.join(drawn, "query_id").groupBy(*by, "rep").agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in columns])


def crossed(rows: DataFrame, targets: DataFrame | None, queries: DataFrame | Draw | None, by: list[str], sums: list[str]) -> DataFrame:
    """by, rep and the sums of columns under target weights times query weights; an axis without weights is kept as it is.

    The queries' weights are summed into targets first, so that what the second join meets is a row a replicate and target.
    """
    wide = rows.groupBy(*by, "target", "query_id").agg(*[F.sum(c).alias(c) for c in sums])
    if isinstance(queries, Draw):
        part = drawn_sums(wide, queries, [*by, "target"], sums).drop("w")
    elif queries is not None:
        part = wide.join(queries, "query_id").groupBy(*by, "target", "rep").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in sums])
    else:
        part = wide.groupBy(*by, "target").agg(*[F.sum(c).alias(c) for c in sums])
    if targets is None:
        return part.groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in sums])
    on = ["target"] if queries is None else ["target", "rep"]
    return part.join(targets, on).groupBy(*by, "rep").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in sums])


def hierarchical(rows: DataFrame, builds: DataFrame, salt: int, by: list[str], sums: list[str], replicates: int) -> DataFrame:
    """by, rep and sums where builds are drawn, and queries anew within each drawn build; ``rows`` hold build and query_id."""
    axis, nb = placed(builds, "build")
    queries, nq = placed(rows, "query_id")
    slots = rows.sparkSession.range(replicates * nb).select(F.floor(F.col("id") / nb).alias("rep"), F.col("id").alias("slot"), (mixed(F.col("id"), salt) % nb).cast("int").alias("pos"))
    drawn = slots.join(F.broadcast(axis), "pos").select("rep", "slot", "build")  # a row a build
    each = drawn.select("rep", "build", F.explode(F.sequence(F.col("slot") * nq, F.col("slot") * nq + (nq - 1))).alias("id"))
    counted = each.select("rep", "build", (mixed(F.col("id"), salt + 1) % nq).cast("int").alias("pos")).groupBy("rep", "build", "pos").agg(F.count("*").alias("w"))
    named = counted.join(F.broadcast(queries) if nq <= 100_000 else queries, "pos")
    wide = rows.groupBy(*by, "build", "query_id").agg(*[F.sum(c).alias(c) for c in sums])
    return wide.join(named, ["build", "query_id"]).groupBy(*by, "rep").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in sums], F.sum("w").alias("w"))
