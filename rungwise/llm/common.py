"""Shared helpers of the training-data operators: reading, shared storage, stable hashes.

Nothing here holds rows on the driver.  Intermediate results that would otherwise be recomputed, or
whose lineage would grow with an iteration, are written as Parquet tables to the folder that the
session names in ``spark.checkpoint.dir``; lost executors then cost a re-read, not a re-run.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

_made: list[tuple[SparkSession, str]] = []
_scope: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("scope", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Taken from ``spark.checkpoint.dir`` or the session's checkpoint folder; where neither is set, a
    temporary folder is made and set on a single machine, and anything else is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        java = context._jsc.sc().getCheckpointDir()
        if java.isDefined():
            return java.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="rungwise-")
        context.setCheckpointDir(named)
        return context._jsc.sc().getCheckpointDir().get()
    return named


def shared_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; cuts lineage.

    Inside :func:`scratch` the table goes at the end of the block unless it is to be kept.
    """
    path = shared_path(df.sparkSession, tag)
    inside = _scope.get()
    if inside is not None and not keep:
        inside.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Drops the tables that were materialised inside the block; what outlives it must be kept ones."""
    paths: list[tuple[SparkSession, str]] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for spark, path in paths:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


#: Rows and bytes of an Arrow batch at most, so that long texts and lists of ids stay small in a worker.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches bounded; for operators that send texts to Python."""
    conf = df.sparkSession.conf
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def unit_hash(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) from MD5 of the seed and the columns: the same on every engine and run."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; null has none.

    Split at single blanks, which Java does without a regular expression.
    """
    blank = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(blank, " ", -1), "")


def n_words(text: Column) -> Column:
    """Number of those words."""
    return F.size(words_of(text)).cast("long")


def count_of(text: Column, characters: str) -> Column:
    """How often the characters occur: what their removal, one after the other, takes off the length."""
    bare = text
    for c in characters:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return F.length(text) - F.length(bare)
