"""A store of inverted lists: files by list, a direct map from ids to lists, and a manifest of versions.

Members lie in folders ``data/gen=G/list=L``.  A change writes a new generation of the lists that it touches
and a manifest that names, for every list, the generation that holds it; a reader that has opened a version
goes on reading it.  Reads name their lists in a filter of partition columns, so that only those folders are
opened.  The direct map lies in folders by a hash of the id, and is changed in the same way.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.operators.storage import file_system

#: Folders of the direct map, and members of a file at most.
BUCKETS, FILE_ROWS = 64, 1 << 20
#: Lists and buckets up to which a version is opened: their manifest is held by the driver.
MAX_LISTS = 1 << 20
MEMBERS = "vec_id bigint, e array<double>"


@dataclass(frozen=True)
class Store:
    """A version of a store: which generation holds each list, how many members it has, and each bucket of the map."""

    spark: SparkSession
    path: str
    version: int
    lists: dict[int, tuple[int, int]]
    buckets: dict[int, int]

    # --- views ---------------------------------------------------------------------------------------------

    def masked(self, kept: Iterable[int]) -> Store:
        """Only these lists."""
        kept = set(kept)
        return replace(self, lists={k: v for k, v in self.lists.items() if k in kept})

    def without_stop_lists(self, most: int) -> Store:
        """Without the lists of more than ``most`` members, which tell little apart."""
        return replace(self, lists={k: v for k, v in self.lists.items() if v[1] <= most})

    def sliced(self, low: int, high: int) -> Store:
        """The lists from ``low`` to under ``high``."""
        return self.masked(k for k in self.lists if low <= k < high)

    # --- reads ---------------------------------------------------------------------------------------------

    def read(self, lists: Iterable[int] | None = None) -> DataFrame:
        """vec_id, list, e of the given lists, or of all; files of other lists and generations are not opened."""
        wanted = self.lists if lists is None else {k: self.lists[k] for k in set(lists) if k in self.lists}
        if not wanted:
            return self.spark.createDataFrame([], "vec_id long, list int, e array<double>")
        whole = self.spark.read.schema(f"{MEMBERS}, gen int, list int").option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        return whole.filter(_either({k: g for k, (g, _) in wanted.items()}, "list")).select("vec_id", "list", "e")

    def probed(self, queries: DataFrame) -> DataFrame:
        """The members of the lists that ``queries`` (vec_id, list, e) probe."""
        return self.read(r["list"] for r in queries.select("list").distinct().collect())

    def lists_of(self, ids: DataFrame) -> DataFrame:
        """vec_id, list of the ids (vec_id) that the store holds, from the buckets of those ids alone."""
        asked = ids.select("vec_id").distinct().withColumn("bucket", _bucket())
        hit = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
        wanted = {b: self.buckets[b] for b in hit if b in self.buckets}
        if not wanted:
            return self.spark.createDataFrame([], "vec_id long, list int")
        known = self.spark.read.schema("vec_id bigint, list int, gen int, bucket int").option("basePath", f"{self.path}/map").parquet(f"{self.path}/map")
        return known.filter(_either(wanted, "bucket")).join(asked, ["vec_id", "bucket"], "left_semi").select("vec_id", "list")

    def reconstructed(self, ids: DataFrame) -> DataFrame:
        """vec_id, list, e of the ids that the store holds; only their lists are read."""
        at = self.lists_of(ids).join(self.spark.createDataFrame([(k,) for k in self.lists], "list int"), "list", "left_semi")
        lists = [r["list"] for r in at.select("list").distinct().collect()]
        return self.read(lists).join(at.select("vec_id"), "vec_id", "left_semi")

    # --- changes -------------------------------------------------------------------------------------------

    def changed(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> Store:
        """The next version: without the ids of ``removed`` (vec_id), then with ``added`` (vec_id, list, e).

        An added id must be new or among the removed ones. Lists that neither touches keep their files.
        """
        out = self.lists_of(removed) if removed is not None else self.spark.createDataFrame([], "vec_id long, list int")
        fresh = added.select("vec_id", "list", "e") if added is not None else self.spark.createDataFrame([], "vec_id long, list int, e array<double>")
        if fresh.count() != fresh.select("vec_id").distinct().count() or not self.lists_of(fresh).join(out, "vec_id", "left_anti").isEmpty():
            raise ValueError("an added id occurs already")
        touched = [r["list"] for r in out.select("list").union(fresh.select("list")).distinct().collect()]
        members = self.read(touched).join(out.select("vec_id"), "vec_id", "left_anti").unionByName(fresh)
        ids = out.select("vec_id").union(fresh.select("vec_id")).distinct().withColumn("bucket", _bucket())
        hit = [r["bucket"] for r in ids.select("bucket").distinct().collect()]
        here = {b: self.buckets[b] for b in hit if b in self.buckets}
        where = fresh.select("vec_id", "list")
        if here:
            known = self.spark.read.schema("vec_id bigint, list int, gen int, bucket int").option("basePath", f"{self.path}/map").parquet(f"{self.path}/map")
            where = where.unionByName(known.filter(_either(here, "bucket")).select("vec_id", "list").join(out.select("vec_id"), "vec_id", "left_anti"))
        return _written(self, members, where, touched, hit)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(BUCKETS)).cast("int")


def _either(generations: dict[int, int], column: str) -> Column:
    """A filter of partition columns: each value in its generation."""
    by: dict[int, list[int]] = {}
    for value, gen in generations.items():
        by.setdefault(gen, []).append(value)
    return reduce(lambda a, b: a | b, [(F.col("gen") == g) & F.col(column).isin(v) for g, v in sorted(by.items())])


def _written(old: Store, members: DataFrame, where: DataFrame, touched: list[int], hit: list[int]) -> Store:
    """Writes the touched lists and buckets as the next generation, and the manifest that names them."""
    gen = old.version + 1
    # A list is dealt to as many tasks as it needs files.
    sizes = members.groupBy("list").agg(F.count("*").alias("n"))
    dealt = members.join(sizes, "list").withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / FILE_ROWS)))
    dealt.repartition("list", "_part").drop("n", "_part").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("list").parquet(f"{old.path}/data/gen={gen}")
    where.withColumn("bucket", _bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{old.path}/map/gen={gen}")
    found = old.spark.read.schema(f"{MEMBERS}, list int").parquet(f"{old.path}/data/gen={gen}").groupBy("list").agg(F.count("*").alias("n")).limit(MAX_LISTS + 1).collect()
    lists = {k: v for k, v in old.lists.items() if k not in set(touched)} | {r["list"]: (gen, r["n"]) for r in found}
    held = {r["bucket"] for r in old.spark.read.schema("vec_id bigint, list int, bucket int").parquet(f"{old.path}/map/gen={gen}").select("bucket").distinct().collect()}
    buckets = {k: v for k, v in old.buckets.items() if k not in set(hit)} | {b: gen for b in held}
    if len(lists) > MAX_LISTS:
        raise ValueError(f"more than {MAX_LISTS} lists")
    rows = [("list", k, g, n) for k, (g, n) in sorted(lists.items())] + [("bucket", k, g, 0) for k, g in sorted(buckets.items())]
    old.spark.createDataFrame(rows, "kind string, key int, gen int, n long").coalesce(1).write.parquet(f"{old.path}/manifest/version={gen}")
    return replace(old, version=gen, lists=lists, buckets=buckets)


def created(members: DataFrame, path: str) -> Store:
    """A new store of members (vec_id, list, e) at a path that must not exist; ids must be unique."""
    spark = members.sparkSession
    fs, target = file_system(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    return Store(spark, path, 0, {}, {}).changed(added=members)


def opened(spark: SparkSession, path: str, version: int | None = None) -> Store:
    """A version of a store, the last one if none is named."""
    if version is None:
        fs, target = file_system(spark, f"{path}/manifest")
        version = max(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(target) if "=" in s.getPath().getName())
    rows = spark.read.parquet(f"{path}/manifest/version={version}").collect()
    lists = {r["key"]: (r["gen"], r["n"]) for r in rows if r["kind"] == "list"}
    return Store(spark, path, version, lists, {r["key"]: r["gen"] for r in rows if r["kind"] == "bucket"})


def beside(stores: list[Store]) -> DataFrame:
    """vec_id, list, e of several stores of the same lists: a list's members are those of all."""
    return reduce(DataFrame.unionByName, [s.read() for s in stores])


def below(stores: list[Store]) -> DataFrame:
    """vec_id, list, e of several stores whose lists are numbered on: each after the last list of those before."""
    out, first = [], 0
    for s in stores:
        out.append(s.read().withColumn("list", F.col("list") + F.lit(first)))
        first += 1 + max(s.lists, default=-1)
    return reduce(DataFrame.unionByName, out)
