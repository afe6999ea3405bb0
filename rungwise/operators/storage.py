"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the session's checkpoint folder; on a single machine a temporary one is made and set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    set_already = context._jsc.sc().getCheckpointDir()
    if not named and set_already.isDefined():
        return set_already.get()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="rungwise-")
    if not set_already.isDefined():
        context.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has yet; it goes when the interpreter ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; cuts lineage."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) in an order, by ranges: no task sorts all rows.

    The rows are range-sorted and written; a place is the row's in its partition, after the sizes of the
    partitions before, which are all that the driver sees.
    """
    sorted_ = written(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "order")
    part = F.shiftrightunsigned("_row", 33)
    offsets, before = [], 0
    for at, n in sorted(sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((at, before))
        before += n
    first = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    joined = sorted_.withColumn("_part", part).join(first, "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row", "_part", "_before")


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system, its path object)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def fingerprint(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, time of the last change) of a file or folder."""
    fs, target = file_system(spark, path)
    return fs.getContentSummary(target).getLength(), fs.getFileStatus(target).getModificationTime()


def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                fs, target = file_system(spark, path)
                fs.delete(target, True)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return
