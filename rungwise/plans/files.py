"""Queries that write a form and read it back: sources and sinks against the tables they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungwise.operators import search
from rungwise.operators.storage import new_path
from rungwise.plans.catalogue import _knn_sql
from rungwise.plans.registry import knn_of, query, table, vecs
from rungwise.sources import files, synthetic


def _total():
    return F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))


def _register_vectors(form: str) -> None:
    cell = "CAST(trunc(x * 1000) AS DOUBLE)" if form == "ivecs" else "CAST(x AS DOUBLE)"
    names = "vec_id, " if form == "query" else ""

    @query(f"vectors_{form}", f"SELECT {names}len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: {cell})), 5) AS total FROM embeddings")
    def run(spark, sf_dir):
        """Vectors written in a binary form and read back, exact to the bit."""
        e = F.transform("embedding", lambda x: (x * F.lit(1000).cast("float")).cast("int").cast("double")) if form == "ivecs" else F.col("embedding").cast("array<double>")
        path = new_path(spark, form)
        files.sink_vectors(table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e")), path, form)
        rows = files.scan_vectors(spark, path, form)
        return rows.select(*([F.col("id").alias("vec_id")] if form == "query" else []), F.size("vector").cast("long").alias("dims"), F.round(_total(), 5).alias("total"))


for _form in ("fvecs", "ivecs", "f32bin", "fbin", "query"):
    _register_vectors(_form)


@query("vectors_npz", "SELECT count(*) AS vectors, CAST(sum(len(embedding)) AS BIGINT) AS elements, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 3) AS total, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings")
def vectors_npz(spark, sf_dir):
    """Array archives, read element by element."""
    path = new_path(spark, "npz")
    files.sink_vectors(vecs(spark, sf_dir), path, "npz")
    cells = files.scan_npz(spark, path)
    x, ids = F.col("name") == "vectors", F.col("name") == "ids"
    return cells.agg(F.count(F.when(ids, 1)).alias("vectors"), F.count(F.when(x, 1)).alias("elements"), F.round(F.sum(F.when(x, F.col("value"))), 3).alias("total"), F.sum(F.when(ids, F.col("value"))).cast("long").alias("ids"))


@query("table_files", "SELECT form, n_nationkey, n_name, n_regionkey FROM nation, (SELECT unnest(['csv', 'json', 'parquet']) AS form)")
def table_files(spark, sf_dir):
    """A table through each sink and its reader."""
    rows, out = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), None
    schema = "n_nationkey int, n_name string, n_regionkey int"
    for form in files.FORMATS:
        path = new_path(spark, form)
        files.sink(rows, path, form)
        read = files.scan_csv(spark, path, schema) if form == "csv" else getattr(spark.read.schema(schema), form)(path)
        one = read.select(F.lit(form).alias("form"), *rows.columns)
        out = one if out is None else out.unionByName(one)
    return out


@query("cube_files", f"WITH {_knn_sql('l2')} SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS build, query_id, CAST(rank AS INT) AS rank, base_id AS neighbor_id FROM knn")
def cube_files(spark, sf_dir):
    """Answer lists as one CSV a build, read with a declared schema and taken apart again."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "base_id"))), lambda x: x["base_id"].cast("string")), ";")
    lists = knn_of(spark, sf_dir).groupBy("query_id").agg(ids.alias("topk"))
    paths = {}
    for i, build in enumerate(("even", "odd")):
        paths[build] = new_path(spark, build)
        files.sink(lists.filter(F.col("query_id") % 2 == i), paths[build], "csv")
    rows = files.explode_list(files.scan_cube(spark, paths, "query_id long, topk string"))
    return rows.select("build", "query_id", F.col("rank").cast("int").alias("rank"), "neighbor_id")


@query("json_documents", "SELECT r_regionkey AS id, r_name AS name, len(r_name) AS letters FROM region")
def json_documents(spark, sf_dir):
    """Whole-file JSON documents, one a region."""
    path = new_path(spark, "json")
    made = table(spark, sf_dir, "region").select(F.to_json(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.length("r_name").alias("letters"))).alias("value"))
    made.repartition(5, "value").write.option("maxRecordsPerFile", 1).text(path)
    rows = files.scan_json(spark, path, "id int, name string, letters long")
    return rows.select("id", "name", "letters")


@query("gathered_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings WHERE vec_id % 9 = 4")
def gathered_vectors(spark, sf_dir):
    """Vectors of wanted ids; ids without one are an error."""
    base = vecs(spark, sf_dir)
    got = files.gather_by_id(base, base.filter("vec_id % 9 = 4").select("vec_id"))
    return got.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("generated_sets", "SELECT unnest(['gaussian_mixture', 'narrow_bridge', 'swiss_roll']) AS name, count(*) AS base, greatest(20, count(*) // 10) AS queries, CAST(max(len(embedding)) AS BIGINT) AS dims FROM embeddings")
def generated_sets(spark, sf_dir):
    """Every generator of the registry makes a set of the table's size and dimension (shapes are held in the tests)."""
    n, dims = vecs(spark, sf_dir).agg(F.count("*"), F.max(F.size("e"))).first()
    out = None
    for name in sorted(synthetic.GENERATORS):
        rows = synthetic.GENERATORS[name](spark, n, dims)
        one = rows.agg(F.lit(name).alias("name"), F.count(F.when(F.col("part") == "base", 1)).alias("base"), F.count(F.when(F.col("part") != "base", 1)).alias("queries"), F.max(F.size("vector")).cast("long").alias("dims"))
        out = one if out is None else out.unionByName(one)
    return out
