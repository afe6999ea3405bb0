"""Vector files, array archives and tables in archives as DataFrames, and sinks that refuse to overwrite.

Files are read by Spark's own readers, a file a task; a set too large for one file is a folder of them.
Vectors leave the worker in blocks, so that memory holds one file and one block.
"""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 8192
#: Fixed value: the mark at the start of a query file.
QUERY_MARK = b"E1AQ0001"
VECTORS = "path string, pos long, id long, vector array<float>"


def _fvecs(blob: bytes) -> tuple[np.ndarray | None, np.ndarray]:
    """Records of a 32-bit dimension and that many floats."""
    if not blob:
        return None, np.empty((0, 0), np.float32)
    d = struct.unpack_from("<i", blob)[0]
    if d <= 0 or len(blob) % (4 + 4 * d):
        raise ValueError("fvecs: truncated or uneven records")
    rows = np.frombuffer(blob, np.dtype([("d", "<i4"), ("v", "<f4", (d,))]))
    if (rows["d"] != d).any():
        raise ValueError("fvecs: records of several dimensions")
    return None, rows["v"]


def _f32bin(blob: bytes) -> tuple[np.ndarray | None, np.ndarray]:
    """64-bit count and dimension, then the floats."""
    n, d = struct.unpack_from("<qq", blob)
    if n < 0 or d < 0 or len(blob) != 16 + 4 * n * d:
        raise ValueError("f32bin: size and header differ")
    return None, np.frombuffer(blob, "<f4", offset=16).reshape(n, d)


def _query_file(blob: bytes) -> tuple[np.ndarray | None, np.ndarray]:
    """The mark, count and dimension, then records of a 64-bit id and the floats; ids are unique."""
    if blob[:8] != QUERY_MARK or len(blob) < 24:
        raise ValueError("query file: no mark")
    n, d = struct.unpack_from("<QQ", blob, 8)
    if len(blob) != 24 + n * (8 + 4 * d):
        raise ValueError("query file: size and header differ")
    rows = np.frombuffer(blob, np.dtype([("id", "<i8"), ("v", "<f4", (d,))]), offset=24)
    if len(np.unique(rows["id"])) != n:
        raise ValueError("query file: an id twice")
    return rows["id"], rows["v"]


def _ivecs(blob: bytes) -> tuple[np.ndarray | None, np.ndarray]:
    """Records of a 32-bit dimension and that many 32-bit whole numbers."""
    _, rows = _fvecs(blob)
    return None, np.ascontiguousarray(rows).view("<i4").astype(np.float32)


def _fbin(blob: bytes) -> tuple[np.ndarray | None, np.ndarray]:
    """32-bit count and dimension, then the floats."""
    n, d = struct.unpack_from("<ii", blob)
    if n < 0 or d < 0 or len(blob) != 8 + 4 * n * d:
        raise ValueError("fbin: size and header differ")
    return None, np.frombuffer(blob, "<f4", offset=8).reshape(n, d)


DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray | None, np.ndarray]]] = {"fvecs": _fvecs, "ivecs": _ivecs, "f32bin": _f32bin, "fbin": _fbin, "query": _query_file}


def _with_dimension(x: np.ndarray) -> bytes:
    return np.concatenate([np.full((len(x), 1), x.shape[1], "<i4").view(x.dtype), x], axis=1).tobytes()


def _npz(ids: np.ndarray, x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids=ids, vectors=x)
    return out.getvalue()


ENCODERS: dict[str, Callable[[np.ndarray, np.ndarray], bytes]] = {
    "fvecs": lambda ids, x: _with_dimension(x.astype("<f4")),
    "ivecs": lambda ids, x: _with_dimension(x.astype("<i4")),
    "f32bin": lambda ids, x: struct.pack("<qq", *x.shape) + x.astype("<f4").tobytes(),
    "fbin": lambda ids, x: struct.pack("<ii", *x.shape) + x.astype("<f4").tobytes(),
    "query": lambda ids, x: QUERY_MARK + struct.pack("<QQ", *x.shape) + np.rec.fromarrays([ids, x.astype("<f4")], np.dtype([("id", "<i8"), ("v", "<f4", (x.shape[1],))])).tobytes(),
    "npz": lambda ids, x: _npz(ids, x.astype("<f4")),
}
#: Vectors of a file at most; a task writes as many files as it needs.
FILE_ROWS = 65_536


def sink_vectors(rows: DataFrame, path: str, form: str) -> int:
    """Writes (vec_id, e) as files of a binary form into a new folder, and returns how many vectors.

    Each task writes its own files, under another name first, so that a task that runs again leaves the same
    files; the folder must lie where all executors can write.
    """
    encode, spark = ENCODERS[form], rows.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileExistsError(path)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(folder)
        part, held, size, number, done = TaskContext.get().partitionId(), [], 0, 0, 0

        def flush(whole: pd.DataFrame) -> None:
            name = f"{folder}/part-{part:05d}-{number:05d}.{form}"
            with store.open_output_stream(name + ".unfinished") as out:
                out.write(encode(whole["vec_id"].to_numpy(np.int64), np.stack(whole["e"].to_numpy())))
            store.move(name + ".unfinished", name)

        for batch in batches:
            for i in range(0, len(batch), FILE_ROWS):
                piece = batch.iloc[i : i + FILE_ROWS]
                if size + len(piece) > FILE_ROWS:
                    flush(pd.concat(held))
                    held, size, number = [], 0, number + 1
                held.append(piece)
                size += len(piece)
                done += len(piece)
        if held:
            flush(pd.concat(held))
        yield pd.DataFrame({"n": [done]})

    return rows.select("vec_id", "e").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def gather_by_id(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """The vectors of the wanted ids (vec_id), each once; an id without a vector is an error."""
    ids = wanted.select("vec_id").distinct()
    missing = ids.join(vectors, "vec_id", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"no vector for {[r['vec_id'] for r in missing]}")
    return vectors.join(ids, "vec_id", "left_semi")


def _blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def scan_vectors(spark: SparkSession, path: str, form: str) -> DataFrame:
    """path, pos (place in the file), id (the file's own, else pos) and vector of every record."""
    decode = DECODERS[form]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, blob in zip(batch["path"], batch["content"]):
                ids, x = decode(bytes(blob))
                for i in range(0, len(x), BLOCK):
                    part = x[i : i + BLOCK]
                    pos = np.arange(i, i + len(part))
                    yield pd.DataFrame({"path": name, "pos": pos, "id": pos if ids is None else ids[i : i + BLOCK], "vector": list(part)})

    return _blobs(spark, path).mapInPandas(run, VECTORS)


def scan_npz(spark: SparkSession, path: str) -> DataFrame:
    """path, name, index (the places along each axis) and value of every element of the arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, blob in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(blob), allow_pickle=False) as arrays:
                    for key in arrays.files:
                        x = arrays[key]
                        flat = x.reshape(-1)
                        for i in range(0, flat.size, BLOCK):
                            part = flat[i : i + BLOCK].astype(np.float64)
                            at = np.stack(np.unravel_index(np.arange(i, i + part.size), x.shape or (1,)), 1)
                            yield pd.DataFrame({"path": name, "name": key, "index": list(at.astype(np.int64)), "value": part})

    return _blobs(spark, path).mapInPandas(run, "path string, name string, index array<long>, value double")


def scan_zip_csv(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".csv", ".csv.gz"), pins: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """path, member, pos and row (a map by header) of the tables in ZIP archives, gzipped ones too; a byte-order mark is skipped.

    With ``pins`` the archive's tables must be those named, each of its bytes and SHA-256, or it is an error.
    """

    def checked(archive: zipfile.ZipFile, members: list[str]) -> None:
        if pins is None:
            return
        if set(members) != set(pins):
            raise ValueError(f"members {sorted(set(members) ^ set(pins))}")
        for m in members:
            raw = archive.read(m)
            if (len(raw), hashlib.sha256(raw).hexdigest()) != tuple(pins[m]):
                raise ValueError(f"{m} is not what was pinned")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, blob in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                    members = sorted(m for m in archive.namelist() if m.endswith(suffixes))
                    checked(archive, members)
                    for member in members:
                        with archive.open(member) as raw, gzip.open(raw) if member.endswith(".gz") else raw as f:
                            rows: list[dict] = []
                            pos = 0
                            for pos, row in enumerate(csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline="")), 1):
                                rows.append(row)
                                if len(rows) == BLOCK:
                                    yield pd.DataFrame({"path": name, "member": member, "pos": range(pos - len(rows), pos), "row": rows})
                                    rows = []
                            if rows:
                                yield pd.DataFrame({"path": name, "member": member, "pos": range(pos - len(rows), pos), "row": rows})

    return _blobs(spark, path).mapInPandas(run, "path string, member string, pos long, row map<string,string>")


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tables with a header (.gz too) by a declared schema; a row that does not fit it is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def scan_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON documents."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(path)


def scan_cube(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """One table a build, with a column of the build's name; every build must have rows."""
    parts = [scan_csv(spark, path, schema).withColumn("build", F.lit(build)) for build, path in sorted(paths.items())]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    missing = set(paths) - {r["build"] for r in whole.select("build").distinct().collect()}  # one row a build
    if missing:
        raise ValueError(f"builds without rows: {sorted(missing)}")
    return whole


def explode_list(df: DataFrame, column: str = "topk", separator: str = ";") -> DataFrame:
    """One row (rank from 1, neighbor_id) for each id of a separated list; empty lists give none."""
    ids = F.transform(F.split(F.col(column), separator, -1), lambda x: x.cast("long"))
    rows = df.filter(F.length(column) > 0).select(*[c for c in df.columns if c != column], F.posexplode(ids).alias("rank", "neighbor_id"))
    return rows.withColumn("rank", F.col("rank") + 1)


FORMATS = ("csv", "json", "parquet")


def sink(df: DataFrame, path: str, form: str = "parquet", partition_by: str | None = None) -> None:
    """Writes a new folder; an existing one, or a DataFrame without rows, is an error."""
    if form not in FORMATS:
        raise ValueError(f"one of {FORMATS}")
    if df.isEmpty():
        raise ValueError("nothing to write")
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    getattr(writer, form)(path, **({"header": True} if form == "csv" else {}))


def save_run(queries: DataFrame, metadata: dict, path: str) -> None:
    """A run's folder: its query rows and one JSON document about it."""
    sink(queries, f"{path}/queries", "csv")
    spark = queries.sparkSession
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/metadata")
