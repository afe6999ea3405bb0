"""Queries of trained indexes, codes, transforms and tables of vectors that change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.functions import distance as D
from rungwise.operators import graphsearch, indexes, quantize, search
from rungwise.operators.resample import mixed_sql
from rungwise.operators.search import K
from rungwise.operators.storage import written
from rungwise.plans.catalogue import _DIMS, _VEC
from rungwise.plans.registry import knn_of, query, stored, table, vecs

LISTS, PROBES, ROUNDS = 8, 2, 10
PARTS, CODES, CODE_ROUNDS = 8, 16, 4
_L2 = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _start(n: int) -> str:
    return f"(SELECT e, row_number() OVER (ORDER BY {mixed_sql('vec_id', 1)}, vec_id) - 1 AS code FROM vec QUALIFY code < {n})"


_KMEANS = f"""{_VEC}, km AS (SELECT 0 AS it, CAST(code AS INT) AS list, e FROM {_start(LISTS)} UNION ALL
  SELECT it + 1, list, list(m ORDER BY dim) FROM (SELECT it, list, dim, avg(v) AS m FROM (SELECT it, list, unnest(ve) AS v, generate_subscripts(ve, 1) AS dim FROM
    (SELECT km.it, km.list, v.e AS ve FROM km, vec v WHERE km.it < {ROUNDS} QUALIFY row_number() OVER (PARTITION BY km.it, v.vec_id ORDER BY {_L2.format('v.e', 'km.e')}, km.list) = 1)) GROUP BY ALL) GROUP BY it, list),
cent AS MATERIALIZED (SELECT list, e FROM km WHERE it = {ROUNDS}),
asg AS MATERIALIZED (SELECT vec_id, list, {_L2.format('v.e', 'c.e')} AS d, row_number() OVER (PARTITION BY vec_id ORDER BY d, list) AS rank FROM vec v, cent c)"""


def _centres(spark, sf_dir):
    base = vecs(spark, sf_dir)
    return base, indexes.kmeans(base, indexes.picks(base, LISTS), rounds=ROUNDS)[0]


@query("kmeans_lists", f"WITH RECURSIVE {_KMEANS} SELECT list, count(*) AS size, round(sum(d), 4) AS inertia FROM asg WHERE rank = 1 GROUP BY list")
def kmeans_lists(spark, sf_dir):
    """Lists after Lloyd's rounds, with their sizes and squared distances."""
    base, centres = _centres(spark, sf_dir)
    return indexes.assigned(base, centres).groupBy("list").agg(F.count("*").alias("size"), F.round(F.sum("distance"), 4).alias("inertia"))


@query("residuals", f"WITH RECURSIVE {_KMEANS} SELECT vec_id, list, round(d, 6) AS length FROM asg WHERE rank = 1")
def residuals(spark, sf_dir):
    """Each vector less its list's centre: the squared length of what is left."""
    base, centres = _centres(spark, sf_dir)
    return indexes.residuals(base, centres).select("vec_id", "list", F.round(D.norm_l2sq(F.col("e")), 6).alias("length"))


_CODED = f"""{_VEC}, sb AS MATERIALIZED (SELECT vec_id, p, e[p * 8 + 1:p * 8 + 8] AS s FROM vec, (SELECT CAST(unnest(range(0, {PARTS})) AS INT) AS p)),
kp AS (SELECT 0 AS it, p, CAST(code AS INT) AS code, e[p * 8 + 1:p * 8 + 8] AS c FROM {_start(CODES)}, (SELECT CAST(unnest(range(0, {PARTS})) AS INT) AS p) UNION ALL
  SELECT it + 1, p, code, coalesce(any_value(nc), any_value(c)) FROM (SELECT k.it, k.p, k.code, k.c, x.nc FROM kp k LEFT JOIN (SELECT it, p, code, list(m ORDER BY dim) AS nc FROM (SELECT it, p, code, dim, avg(v) AS m FROM (SELECT it, p, code, unnest(s) AS v, generate_subscripts(s, 1) AS dim FROM
    (SELECT kp.it, kp.p, kp.code, sb.s FROM kp JOIN sb USING (p) QUALIFY row_number() OVER (PARTITION BY kp.it, kp.p, vec_id ORDER BY {_L2.format('sb.s', 'kp.c')}, kp.code) = 1)) GROUP BY ALL) GROUP BY it, p, code) x ON x.it = k.it AND x.p = k.p AND x.code = k.code WHERE k.it < {CODE_ROUNDS}) GROUP BY it, p, code),
bk AS MATERIALIZED (SELECT p, code, c FROM kp WHERE it = {CODE_ROUNDS}),
pc AS MATERIALIZED (SELECT vec_id, p, code, {_L2.format('s', 'c')} AS d FROM sb JOIN bk USING (p) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, code) = 1)"""


def _books(spark, sf_dir):
    base = vecs(spark, sf_dir)
    books = indexes.kmeans(base, indexes.picks(base, CODES), PARTS, CODE_ROUNDS)
    return base, books, indexes.product_codes(base, books)


@query("product_codes", f"WITH RECURSIVE {_CODED} SELECT vec_id, string_agg(code, ',' ORDER BY p) AS codes, round(sum(d), 6) AS error FROM pc GROUP BY vec_id")
def product_codes(spark, sf_dir):
    """Codes of eight slices, sixteen trained centres each, and the squared distance to what they stand for."""
    base, books, codes = _books(spark, sf_dir)
    back = indexes.decoded(codes, books).withColumnRenamed("e", "r")
    rows = codes.join(back, "vec_id").join(base, "vec_id")
    return rows.select("vec_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"), F.round(D.l2sq(F.col("e"), F.col("r")), 6).alias("error"))


@query("product_search", f"""WITH RECURSIVE {_CODED}, tb AS MATERIALIZED (SELECT vec_id AS query_id, p, code, {_L2.format('s', 'c')} AS t FROM sb JOIN bk USING (p)),
ad AS (SELECT query_id, vec_id AS base_id, list_sum(list(t ORDER BY tb.p)) AS score FROM tb JOIN pc ON pc.p = tb.p AND pc.code = tb.code WHERE query_id <> vec_id GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, base_id) AS INT) AS rank, base_id, round(score, 6) AS score FROM ad QUALIFY rank <= {K}""")
def product_search(spark, sf_dir):
    base, books, codes = _books(spark, sf_dir)
    return indexes.product_search(codes, base, books).withColumn("score", F.round("score", 6))


def _register_bits(bits: int) -> None:
    levels = 1 << bits

    @query(f"scalar_quantizer_{bits}", f"""WITH {_VEC}, {_DIMS}, b AS (SELECT dim, min(v) AS lo, (max(v) - min(v)) / {levels} AS w FROM x GROUP BY dim),
    c AS (SELECT vec_id, v, lo, w, CASE WHEN w > 0 THEN least(floor((v - lo) / w), {levels - 1}) ELSE 0 END AS code FROM x JOIN b USING (dim)) SELECT vec_id, CAST(sum(code) AS BIGINT) AS code_sum, round(max(abs((code + 0.5) * w + lo - v)), 6) AS worst FROM c GROUP BY vec_id""")
    def run(spark, sf_dir):
        coded = quantize.scalar_codes(vecs(spark, sf_dir), levels)
        worst = F.array_max(F.zip_with("decoded", "e", lambda a, b: F.abs(a - b)))
        return coded.select("vec_id", F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + c).alias("code_sum"), F.round(worst, 6).alias("worst"))


for _bits in (4, 6):
    _register_bits(_bits)


@query("row_codes", f"WITH {_VEC}, r AS (SELECT vec_id, e, list_min(e) AS lo, (list_max(e) - list_min(e)) / 255 AS w FROM vec) SELECT vec_id, CAST(list_sum(list_transform(e, lambda x: CASE WHEN w > 0 THEN floor((x - lo) / w + 0.5) ELSE 0 END)) AS BIGINT) AS code_sum, round(w, 9) AS width FROM r")
def row_codes(spark, sf_dir):
    """Each vector in 256 steps between its own least and largest element."""
    return indexes.row_codes(vecs(spark, sf_dir)).select("vec_id", F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + c).alias("code_sum"), F.round("width", 9).alias("width"))


@query("rotated_vectors", f"""WITH {_VEC}, {_DIMS}, s AS (SELECT vec_id, dim, v * CASE WHEN (dim * 40503 + 3 * 7919) % 1009 % 2 = 1 THEN -1.0 ELSE 1.0 END AS v FROM x) SELECT vec_id, CAST(o AS INT) AS dim, round(sum(v * CASE WHEN bit_count(dim & o) % 2 = 1 THEN -1 ELSE 1 END) / 8, 5) + 0.0 AS v FROM s, (SELECT unnest(range(0, 64)) AS o) GROUP BY ALL""")
def rotated_vectors(spark, sf_dir):
    rows = indexes.hadamard_rotated(vecs(spark, sf_dir)).select("vec_id", F.posexplode("e").alias("dim", "v"))
    return rows.withColumn("v", F.round("v", 5) + 0.0)


@query("principal_axes", f"WITH {_VEC}, {_DIMS} SELECT round(sum(v), 5) AS variance, 0::BIGINT AS correlated FROM (SELECT var_pop(v) AS v FROM x GROUP BY dim)")
def principal_axes(spark, sf_dir):
    """Along all principal axes the variance is that of the dimensions, and no two axes correlate."""
    base = vecs(spark, sf_dir)
    d = base.agg(F.max(F.size("e"))).first()[0]
    mean, axes, variances = indexes.principal(base, d)
    moved = indexes.projected(base, mean, axes).select("vec_id", F.posexplode("e").alias("dim", "v"))
    total = moved.groupBy("dim").agg(F.var_pop("v").alias("v")).agg(F.round(F.sum("v"), 5).alias("variance"))
    after = moved.withColumnRenamed("v", "w").withColumn("dim", F.col("dim") - 1)
    pairs = moved.join(after, ["vec_id", "dim"]).groupBy("dim").agg(F.covar_pop("v", "w").alias("c"))
    return total.crossJoin(pairs.agg(F.count(F.when(F.abs("c") > 1e-6, 1)).alias("correlated")))  # single rows


@query("lsh_search", f"""WITH {_VEC}, {_DIMS}, m AS (SELECT dim, quantile_cont(v, 0.5) AS m FROM x GROUP BY dim), s AS MATERIALIZED (SELECT vec_id, list(v > m ORDER BY dim) AS b FROM x JOIN m USING (dim) GROUP BY vec_id)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.b, o.b), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)), o.vec_id) AS INT) AS rank, o.vec_id AS base_id, CAST(list_sum(list_transform(list_zip(q.b, o.b), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS DOUBLE) AS score FROM s q, s o WHERE q.vec_id <> o.vec_id QUALIFY rank <= {K}""")
def lsh_search(spark, sf_dir):
    """Bits above each dimension's median, compared by Hamming distance."""
    signs = indexes.median_signs(vecs(spark, sf_dir))
    return search.exact_knn(signs, signs, K, "hamming")


# A number's last place in a form of so many bits behind the leading one; the half form has a least exponent.
_HALF = "CASE WHEN v = 0 THEN 0.0 ELSE round_even(v / pow(2, greatest(floor(log2(abs(v))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(v))), -14) - 10) END"
_BRAIN = "CASE WHEN v = 0 THEN 0.0 ELSE trunc(v / pow(2, floor(log2(abs(v))) - 7)) * pow(2, floor(log2(abs(v))) - 7) END"


@query("half_precision", f"WITH {_VEC}, {_DIMS}, h AS (SELECT vec_id, v, {_HALF} AS a, {_BRAIN} AS b FROM x) SELECT vec_id, count(*) AS dims, round(sum(a), 8) AS half_sum, round(sum(b), 8) AS brain_sum, round(max(abs(v - a)), 8) AS half_off, round(max(abs(v - b)), 8) AS brain_off FROM h GROUP BY vec_id")
def half_precision(spark, sf_dir):
    """Vectors through both 16-bit forms: what they add up to and how far they are off."""
    base = vecs(spark, sf_dir)
    a, b = indexes.half_precision(base, "fp16").withColumnRenamed("e", "a"), indexes.half_precision(base, "bf16").withColumnRenamed("e", "b")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 8)
    off = lambda c: F.round(F.array_max(F.zip_with("e", c, lambda x, y: F.abs(x - y))), 8)
    rows = base.join(a, "vec_id").join(b, "vec_id")
    return rows.select("vec_id", F.size("e").cast("long").alias("dims"), total("a").alias("half_sum"), total("b").alias("brain_sum"), off("a").alias("half_off"), off("b").alias("brain_off"))


@query("index_mutations", "SELECT count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, count(*) FILTER (vec_id >= 1000000) AS moved, round(sum(CASE WHEN vec_id % 10 = 3 AND vec_id < 1000000 THEN 2 ELSE 1 END * CAST(embedding[1] AS DOUBLE)), 4) AS total FROM (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings WHERE vec_id % 5 = 1)")
def index_mutations(spark, sf_dir):
    """Vectors removed, added under new ids, replaced, and counted."""
    base = vecs(spark, sf_dir)
    held = indexes.removed(base, base.filter("vec_id % 7 = 0"))
    held = indexes.added(held, base.filter("vec_id % 5 = 1").withColumn("vec_id", F.col("vec_id") + 1000000))
    double = held.filter("vec_id % 10 = 3 AND vec_id < 1000000").select("vec_id", F.transform("e", lambda x: x * 2).alias("e"))
    done = indexes.updated(held, double)
    return done.agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"), F.count(F.when(F.col("vec_id") >= 1000000, 1)).alias("moved"), F.round(F.sum(F.get("e", F.lit(0))), 4).alias("total"))


@query("sliding_window", "SELECT step, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings, (SELECT unnest(range(2, 10)) AS step) WHERE label BETWEEN step - 2 AND step GROUP BY step")
def sliding_window(spark, sf_dir):
    """Three batches are searchable at a time: each step adds one and drops the oldest."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    live = rows.select("vec_id", F.explode(F.sequence(F.col("label"), F.col("label") + 2)).alias("step")).filter("step BETWEEN 2 AND 9")
    return live.groupBy(F.col("step").cast("long").alias("step")).agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query("vector_arithmetic", f"WITH {_VEC}, p AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda p: p[1] + p[2])), 5) AS added, round(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))), 5) AS apart, round(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] + 0.5 * p[2]))), 5) AS mixed, round(list_min(a), 6) AS low, round(list_max(a), 6) AS high FROM p")
def vector_arithmetic(spark, sf_dir):
    """Sums, differences and scaled sums of neighbouring vectors, and bounds."""
    base = vecs(spark, sf_dir)
    other = base.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b"))
    p = base.join(other, "vec_id")
    a, b = F.col("e"), F.col("b")
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)), 5)
    plain = F.round(F.aggregate(D.added(a, b), F.lit(0.0), lambda s, x: s + x), 5)
    return p.select("vec_id", plain.alias("added"), total(D.added(a, b, -1.0)).alias("apart"), total(D.added(a, b, 0.5)).alias("mixed"), F.round(F.array_min("e"), 6).alias("low"), F.round(F.array_max("e"), 6).alias("high"))


@query("normalised_vectors", f"WITH {_VEC}, n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM vec) SELECT vec_id, round(n, 6) AS norm, round(list_sum(list_transform(e, lambda x: x / n)), 6) AS total FROM n")
def normalised_vectors(spark, sf_dir):
    base = vecs(spark, sf_dir)
    unit = F.aggregate(D.normalised(F.col("e")), F.lit(0.0), lambda s, x: s + x)
    return base.select("vec_id", F.round(F.sqrt(D.norm_l2sq(F.col("e"))), 6).alias("norm"), F.round(unit, 6).alias("total"))


@query("nan_distances", f"WITH {_VEC}, h AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN x > 0.2 THEN 'NaN'::DOUBLE ELSE x END) AS e FROM vec), p AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM h a JOIN h b ON b.vec_id = a.vec_id + 1), z AS (SELECT vec_id, list_filter(list_zip(a, b), lambda p: NOT isnan(p[1]) AND NOT isnan(p[2])) AS z FROM p) SELECT vec_id, len(z) AS present, round(CASE WHEN len(z) > 0 THEN list_sum(list_transform(z, lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * 64 / len(z) END, 5) AS distance FROM z")
def nan_distances(spark, sf_dir):
    """Distances over the elements that both vectors have, scaled up; NULL where they share none."""
    holed = vecs(spark, sf_dir).select("vec_id", F.transform("e", lambda x: F.when(x > 0.2, float("nan")).otherwise(x)).alias("e"))
    other = holed.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b"))
    p = holed.join(other, "vec_id")
    present = F.size(F.filter(F.arrays_zip("e", "b"), lambda z: ~F.isnan(z["e"]) & ~F.isnan(z["b"])))
    d = D.nan_euclidean(F.col("e"), F.col("b"))
    return p.select("vec_id", present.cast("long").alias("present"), F.round(F.when(~F.isnan(d), d), 5).alias("distance"))


@query("distance_matrix", f"WITH {_VEC} SELECT a.vec_id AS query_id, b.vec_id AS base_id, round({_L2.format('a.e', 'b.e')}, 6) AS score FROM vec a, vec b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id")
def distance_matrix(spark, sf_dir):
    """Every vector against each fiftieth one, in blocks."""
    base = vecs(spark, sf_dir)
    return search.range_search(base, base.filter("vec_id % 50 = 0"), float("inf")).withColumn("score", F.round("score", 6))


@query("lp_distances", f"WITH {_VEC}, p AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1) SELECT vec_id, {', '.join(f'round(list_sum(list_transform(list_zip(a, b), lambda p: pow(abs(p[1] - p[2]), {x}))), 5) AS p{i}' for i, x in enumerate((0.5, 1, 2, 3, 4.5)))} FROM p")
def lp_distances(spark, sf_dir):
    """Sums of powers of differences, for several powers."""
    base = vecs(spark, sf_dir)
    other = base.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b"))
    return base.join(other, "vec_id").select("vec_id", *[F.round(D.lp(x)(F.col("e"), F.col("b")), 5).alias(f"p{i}") for i, x in enumerate((0.5, 1, 2, 3, 4.5))])


SPECS = ("Flat", "IVF8,Flat", "PQ8x16", "PQ8x16,RFlat", "SQ8", "SQ4", "LSH", "PCA32,Flat", "HR,Flat", "L2norm,Flat", "IDMap,Flat", "IVF8,PQ8x16", "IVF8,PQ8x16R", "IVF8,PQ8x16,RFlat", "OPQ8,PQ8x16")


@query("index_strings")
def index_strings(spark, sf_dir):
    """Recall against exact neighbours of every index that a string describes; no SQL: trained codes and axes."""
    base = vecs(spark, sf_dir)
    truth = knn_of(spark, sf_dir).select("query_id", "base_id")
    out: DataFrame | None = None
    made, near = {}, {}
    for spec in SPECS:
        # Forms under ids of their own and forms ranked again have what the plain form finds.
        plain = spec.removeprefix("IDMap,").removesuffix(",RFlat")
        if plain not in near:
            near[plain] = written(indexes.build(plain, base, made)(base, 4 * K if f"{plain},RFlat" in SPECS else K), "index-near")
        found = indexes.refined(near[plain], base, base) if spec.endswith(",RFlat") else near[plain].filter(F.col("rank") <= K)
        met = found.join(truth, ["query_id", "base_id"], "left_semi").agg(F.count("*").alias("hits")).select(F.lit(spec).alias("index"), "hits")
        out = met if out is None else out.unionByName(met)
    n = truth.agg(F.count("*").alias("n"))
    return out.crossJoin(F.broadcast(n)).select("index", F.round(F.col("hits") / F.col("n"), 6).alias("recall"))  # one row


# --- graph indexes -----------------------------------------------------------------------------------------


def _graph(spark, sf_dir, kind: str) -> DataFrame:
    return stored(spark, sf_dir, "embeddings", f"graph-{kind}", lambda: graphsearch.build(vecs(spark, sf_dir), kind))


def _register_graph(kind: str) -> None:
    @query(f"{kind}_sweep")
    def run(spark, sf_dir):
        """Recall and distances counted at every breadth of the search; no SQL: the walk depends on the graph."""
        base = vecs(spark, sf_dir)
        found = graphsearch.search(_graph(spark, sf_dir, kind), base, [("breadth", b) for b in graphsearch.BREADTHS])
        return graphsearch.scored(found, knn_of(spark, sf_dir))


for _kind in ("hnsw", "vamana"):
    _register_graph(_kind)


@query("early_stops")
def early_stops(spark, sf_dir):
    """Searches that end early: by patience, by a distance gap, by a learned number of distances, by learned recall, by the start's quality."""
    base = vecs(spark, sf_dir)
    graph = _graph(spark, sf_dir, "hnsw")
    truth = knn_of(spark, sf_dir)
    learned = graphsearch.train(graph, base.filter("vec_id % 5 = 0"), truth)
    asked = base.filter("vec_id % 5 <> 0")
    found = graphsearch.search(graph, asked, [("breadth", graphsearch.BREADTHS[-1]), ("patience", 12), ("gap", 0.25), ("length", 1.0), ("length", 2.0), ("recall", 0.9), ("recall", 0.98), ("start", 0.95)], learned)
    return graphsearch.scored(found, truth)


@query("graph_mutations")
def graph_mutations(spark, sf_dir):
    """Marked vectors are walked through but not returned; unmarked they are; inserted ones are found."""
    base = vecs(spark, sf_dir)
    graph = _graph(spark, sf_dir, "hnsw")
    gone = base.filter("vec_id % 10 = 0").select("vec_id")
    plan = [("breadth", graphsearch.BREADTHS[-1])]
    out = None
    truth, left = knn_of(spark, sf_dir), search.exact_knn(indexes.removed(base, gone), base)
    for state, held, near in (("whole", graph, truth), ("marked", graphsearch.marked(graph, gone), left), ("restored", graphsearch.marked(graphsearch.marked(graph, gone), gone, False), truth)):
        one = graphsearch.scored(graphsearch.search(held, base, plan), near).withColumn("state", F.lit(state))
        out = one if out is None else out.unionByName(one)
    return out.drop("policy", "parameter")
