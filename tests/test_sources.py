"""Files written by hand and read back, refusals, generators, and a stream against its batch form."""

import gzip
import hashlib
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungwise.operators import quantize
from rungwise.sources import files, synthetic
from rungwise.streaming import monitor

X = np.arange(12, dtype=np.float32).reshape(3, 4)


def _read(spark, path, form):
    return [(r["pos"], r["id"], list(r["vector"])) for r in files.scan_vectors(spark, str(path), form).orderBy("pos").collect()]


def test_vector_files(spark, tmp_path):
    want = [(i, i, list(X[i])) for i in range(3)]
    (tmp_path / "a.fvecs").write_bytes(b"".join(struct.pack("<i", 4) + x.tobytes() for x in X))
    assert _read(spark, tmp_path / "a.fvecs", "fvecs") == want
    (tmp_path / "a.bin").write_bytes(struct.pack("<qq", 3, 4) + X.tobytes())
    assert _read(spark, tmp_path / "a.bin", "f32bin") == want
    (tmp_path / "a.q").write_bytes(files.QUERY_MARK + struct.pack("<QQ", 3, 4) + b"".join(struct.pack("<q", 70 + i) + X[i].tobytes() for i in range(3)))
    assert _read(spark, tmp_path / "a.q", "query") == [(i, 70 + i, v) for i, _, v in want]
    (tmp_path / "none.fvecs").write_bytes(b"")
    assert _read(spark, tmp_path / "none.fvecs", "fvecs") == []


@pytest.mark.parametrize("form,blob", [("fvecs", struct.pack("<i", 4) + b"123"), ("f32bin", struct.pack("<qq", 9, 4) + b"1234"), ("query", b"no mark"), ("query", files.QUERY_MARK + struct.pack("<QQ", 2, 0) + struct.pack("<qq", 5, 5))])
def test_damaged_vector_files(form, blob):
    with pytest.raises(ValueError):
        files.DECODERS[form](blob)


def test_archives(spark, tmp_path):
    np.savez(tmp_path / "a.npz", m=X, s=np.float64(7))
    got = {(r["name"], tuple(r["index"])): r["value"] for r in files.scan_npz(spark, str(tmp_path / "a.npz")).collect()}
    assert len(got) == 13 and got["m", (2, 1)] == 9.0 and got["s", (0,)] == 7.0
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("t/one.csv", "﻿a,b\n1,x\n2,\n")
        z.writestr("t/two.txt", "no table")
    rows = files.scan_zip_csv(spark, str(tmp_path / "a.zip")).orderBy("pos").collect()
    assert [(r["member"], r["pos"], r["row"]) for r in rows] == [("t/one.csv", 0, {"a": "1", "b": "x"}), ("t/one.csv", 1, {"a": "2", "b": ""})]


def test_tables(spark, tmp_path):
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("query_id,topk\n1,5;6;7\n2,\n")
    cube = files.scan_cube(spark, {"b1": str(tmp_path / "x.csv.gz")}, "query_id long, topk string")
    got = files.explode_list(cube).collect()
    assert [(r["build"], r["query_id"], r["rank"], r["neighbor_id"]) for r in got] == [("b1", 1, 1, 5), ("b1", 1, 2, 6), ("b1", 1, 3, 7)]
    (tmp_path / "empty.csv").write_text("query_id,topk\n")
    with pytest.raises(ValueError, match="b2"):
        files.scan_cube(spark, {"b1": str(tmp_path / "x.csv.gz"), "b2": str(tmp_path / "empty.csv")}, "query_id long, topk string")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    for form in files.FORMATS:
        files.sink(df, str(tmp_path / form), form)
        with pytest.raises(Exception, match="(?i)exist"):
            files.sink(df, str(tmp_path / form), form)
    assert sorted(r["k"] for r in files.scan_csv(spark, str(tmp_path / "csv"), "k long, v string").collect()) == [1, 2]
    with pytest.raises(ValueError):
        files.sink(df.limit(0), str(tmp_path / "nothing"))
    files.save_run(df, {"seed": 1}, str(tmp_path / "run"))
    assert files.scan_json(spark, str(tmp_path / "run" / "metadata")).first()["seed"] == 1


@pytest.mark.parametrize("name", sorted(synthetic.GENERATORS))
def test_generators(spark, name):
    a, b = (synthetic.GENERATORS[name](spark, 1000, 8, seed=3).orderBy("vec_id").collect() for _ in range(2))
    assert a == b and {len(r["vector"]) for r in a} == {8}
    assert sum(r["part"] == "base" for r in a) == 1000 and len(a) == 1100
    assert np.isfinite(np.array([r["vector"] for r in a])).all()
    assert a != synthetic.GENERATORS[name](spark, 1000, 8, seed=4).orderBy("vec_id").collect()


def test_bridge_shape(spark):
    rows = synthetic.narrow_bridge(spark, 4000, 4).collect()
    x = np.array([r["vector"] for r in rows])
    middle = np.abs(x[:, 0]) < 1.0
    assert 0 < middle.sum() < 100 and np.abs(x[middle, 1:]).max() < 0.3
    assert len(rows) == 4400 and abs((x[:, 0] < 0).mean() - 0.5) < 0.01
    assert 27 <= middle.sum() <= 34  # of 80 evenly from -2.6 to 2.6


@pytest.mark.parametrize("form", sorted(files.ENCODERS))
def test_vector_sinks(spark, tmp_path, form):
    rows = spark.createDataFrame([(i * 7, [float(i), -2.0, 0.5 * i]) for i in range(50)], "vec_id long, e array<double>").repartition(3)
    path = str(tmp_path / form)
    assert files.sink_vectors(rows, path, form) == 50
    with pytest.raises(FileExistsError):
        files.sink_vectors(rows, path, form)
    if form == "npz":
        assert files.scan_npz(spark, path).count() == 50 * 4
        return
    got = sorted((r["id"] if form == "query" else 7 * r["vector"][0], list(r["vector"])) for r in files.scan_vectors(spark, path, form).collect())
    assert got == [(i * 7, [float(i), -2.0, float(int(0.5 * i)) if form == "ivecs" else 0.5 * i]) for i in range(50)]


def test_pinned_archives_of_gzipped_tables(spark, tmp_path):
    raw = gzip.compress("a,b\n1,x\n".encode())
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("t.csv.gz", raw)
    pin = (len(raw), hashlib.sha256(raw).hexdigest())
    assert files.scan_zip_csv(spark, str(tmp_path / "a.zip"), pins={"t.csv.gz": pin}).first()["row"] == {"a": "1", "b": "x"}
    for bad in ({"t.csv.gz": (pin[0], "0" * 64)}, {"t.csv.gz": pin, "u.csv": pin}):
        with pytest.raises(Exception, match="pinned|members"):
            files.scan_zip_csv(spark, str(tmp_path / "a.zip"), pins=bad).collect()


def test_missing_vectors_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0])], "vec_id long, e array<double>")
    with pytest.raises(ValueError, match="2"):
        files.gather_by_id(rows, spark.createDataFrame([(1,), (2,)], "vec_id long"))


def test_codes_decode_within_an_interval(spark):
    rows = spark.createDataFrame([(i, [float(i), 5.0, -float(i * i)]) for i in range(50)], "vec_id long, e array<double>")
    for r in quantize.scalar_codes(rows, 16).collect():
        assert max(r["codes"]) <= 15 and r["codes"][1] == 0 and r["decoded"][1] == 5.0
        assert abs(r["decoded"][0] - r["e"][0]) <= 49 / 32 + 1e-9
    assert quantize.scalar_codes(rows.limit(0)).count() == 0


def test_stream_writes_closed_windows(spark, tmp_path):
    folder, out = str(tmp_path / "events"), str(tmp_path / "rates")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(folder)
    stream = monitor.watch(spark, folder, events.schema, out, str(tmp_path / "state"))
    assert stream.awaitTermination(120)
    last = events.agg(F.max("ts").alias("t")).first()["t"]
    closed = monitor.rates(events).filter(F.col("start") + F.expr("INTERVAL 1 HOUR") <= F.lit(last) - F.expr("INTERVAL 10 MINUTES"))
    text = lambda df: sorted(df.select(F.col("start").cast("string"), "n", "bad", "share", "mean").collect())
    assert text(spark.read.parquet(out)) == text(closed)
    late = events.limit(5).withColumn("ts", F.expr("ts - INTERVAL 5 DAYS"))
    late.write.mode("append").parquet(folder)
    assert monitor.watch(spark, folder, events.schema, out, str(tmp_path / "state")).awaitTermination(120)
    assert text(spark.read.parquet(out)) == text(closed)


def test_ivecs_products_stay_in_single_precision(spark, duck, tmp_path):
    """A product that single precision rounds up to a whole number, and double precision leaves below it."""
    import __spark_entry__ as entry

    rows = [(0, [0.013, 0.25, -0.029], 1), (1, [0.057, 0.001, 0.9999], 2)]
    whole = [i / 1000 for i in range(1, 1000)]
    rows += [(2 + i, whole[i : i + 3], 1) for i in range(0, 996, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "parts"))
    (part,) = (tmp_path / "parts").glob("*.parquet")
    import duckdb

    want = duckdb.sql(entry.oracle_sql()["vectors_ivecs"].replace("FROM embeddings", f"FROM '{part}'")).fetchall()
    part.rename(tmp_path / "embeddings.parquet")
    got = entry.queries()["vectors_ivecs"](spark, str(tmp_path)).collect()
    assert sorted((r["dims"], r["total"]) for r in got) == sorted(want)
