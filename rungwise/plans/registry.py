"""Where queries and their SQL are registered, and the tables that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rungwise.operators import search
from rungwise.operators.storage import fingerprint, written

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_stored: dict[tuple, DataFrame] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vectors(table(spark, sf_dir, "embeddings"))


def stored(spark: SparkSession, sf_dir: str, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that many queries read: written once a session, and anew if its source has changed."""
    key = (spark.sparkContext.applicationId, sf_dir, name, fingerprint(spark, f"{sf_dir}/{source}.parquet"))
    if key not in _stored:
        _stored[key] = written(build(), name)
    return _stored[key]


def knn_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact neighbours of all vectors among all others; all pairs are formed once."""

    def build() -> DataFrame:
        base = vecs(spark, sf_dir)
        return search.exact_knn(base, base)

    return stored(spark, sf_dir, "embeddings", "knn", build)


def cube_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response cube of all vectors against all others."""

    def build() -> DataFrame:
        return search.response_cube(vecs(spark, sf_dir), knn_of(spark, sf_dir))

    return stored(spark, sf_dir, "embeddings", "cube", build)
