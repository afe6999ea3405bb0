"""Queries of inverted lists in blocks, product codes of residuals, residual quantisers and fitted rotations.

The SQL trains everything anew: Lloyd's rounds are a recursive query over (round, part, code).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rungwise.operators import additive, earlystop, indexes, lists
from rungwise.operators.resample import mixed_sql
from rungwise.operators.search import K
from rungwise.operators.storage import new_path
from rungwise.plans.catalogue import _VEC
from rungwise.plans.indexes import _L2
from rungwise.plans.registry import query, stored, vecs
from rungwise.sources import liststore

LIST_ROUNDS, PROBES, RADIUS = 6, 3, 1.2
PARTS, CODES, CODE_ROUNDS = 8, 8, 3
STAGES, STAGE_CODES, STAGE_ROUNDS, BEAM = 3, 8, 4, 3
TURNS, BITS = 6, 16


def lloyd_sql(name: str, rows: str, codes: str, rounds: int, parts: int = 1) -> str:
    """CTEs that end in ``name`` (p, code, c), trained on ``rows`` (vec_id, e), and ``name``_part (vec_id, p, s), their slices."""
    piece = "e" if parts == 1 else f"e[p * (len(e) // {parts}) + 1:(p + 1) * (len(e) // {parts})]"
    return f"""{name}_part AS MATERIALIZED (SELECT vec_id, p, {piece} AS s FROM {rows}, (SELECT CAST(unnest(range({parts})) AS INT) AS p)),
{name}_first AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY {mixed_sql('vec_id', 1)}, vec_id) - 1 AS INT) AS code FROM {rows} QUALIFY code < {codes}),
{name}_turn AS (SELECT 0 AS it, p, code, s AS c FROM {name}_part JOIN {name}_first USING (vec_id) UNION ALL
  SELECT it + 1, p, code, coalesce(any_value(nc), any_value(c)) FROM (SELECT k.it, k.p, k.code, k.c, x.nc FROM {name}_turn k LEFT JOIN (SELECT it, p, code, list(m ORDER BY dim) AS nc FROM (SELECT it, p, code, dim, avg(v) AS m FROM (SELECT it, p, code, unnest(s) AS v, generate_subscripts(s, 1) AS dim FROM
    (SELECT t.it, t.p, t.code, r.s FROM {name}_turn t JOIN {name}_part r USING (p) QUALIFY row_number() OVER (PARTITION BY t.it, t.p, r.vec_id ORDER BY {_L2.format('r.s', 't.c')}, t.code) = 1)) GROUP BY ALL) GROUP BY it, p, code) x ON x.it = k.it AND x.p = k.p AND x.code = k.code WHERE k.it < {rounds}) GROUP BY it, p, code),
{name} AS MATERIALIZED (SELECT p, code, c FROM {name}_turn WHERE it = {rounds})"""


# --- inverted lists ----------------------------------------------------------------------------------------


def _fitted(spark, sf_dir):
    base = vecs(spark, sf_dir)
    n = lists.lists_for(base.count())
    return base, indexes.kmeans(base, indexes.picks(base, n), rounds=LIST_ROUNDS)[0]


_LISTED = f"""{_VEC}, {lloyd_sql('cent', 'vec', '(SELECT CAST(floor(sqrt(count(*))) AS INT) FROM vec)', LIST_ROUNDS)},
asg AS MATERIALIZED (SELECT vec_id, code AS list, {_L2.format('e', 'c')} AS d, row_number() OVER (PARTITION BY vec_id ORDER BY d, code) AS rank FROM vec, cent),
cand AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, q.list FROM asg q JOIN asg b ON b.list = q.list AND b.rank = 1 AND q.rank <= {PROBES} AND q.vec_id <> b.vec_id)"""
_IVF = f"""{_LISTED}, sc AS MATERIALIZED (SELECT query_id, base_id, list, {_L2.format('a.e', 'b.e')} AS score FROM cand JOIN vec a ON a.vec_id = query_id JOIN vec b ON b.vec_id = base_id)"""


@query("ivf_search", f"WITH RECURSIVE {_IVF} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, base_id) AS INT) AS rank, base_id, list, round(score, 6) AS score FROM sc QUALIFY rank <= {K}")
def ivf_search(spark, sf_dir):
    """Nearest in the probed trained lists, with the list each was found in; lists grow as the root of the vectors."""
    base, centres = _fitted(spark, sf_dir)
    found = lists.search_lists(lists.with_lists(base, centres), lists.with_lists(base, centres, PROBES))
    return found.withColumn("score", F.round("score", 6))


@query("ivf_range", f"WITH RECURSIVE {_IVF} SELECT query_id, count(*) AS n, round(min(score), 6) AS nearest FROM sc WHERE score < {RADIUS} GROUP BY query_id")
def ivf_range(spark, sf_dir):
    base, centres = _fitted(spark, sf_dir)
    found = lists.range_lists(lists.with_lists(base, centres), lists.with_lists(base, centres, PROBES), RADIUS)
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("nearest"))


# --- product codes of residuals ----------------------------------------------------------------------------


def _coded_lists(spark, sf_dir):
    base, centres = _fitted(spark, sf_dir)
    rest = lists.less_centre(lists.with_lists(base, centres), centres)
    rest = stored(spark, sf_dir, "embeddings", "list-residuals", lambda: rest)
    books = indexes.kmeans(rest, indexes.picks(rest, CODES), PARTS, CODE_ROUNDS)
    finer = stored(spark, sf_dir, "embeddings", "code-residuals", lambda: lists.less_codes(rest, books))
    refining = indexes.kmeans(finer, indexes.picks(finer, CODES), PARTS, CODE_ROUNDS)
    return base, centres, books, refining, lists.coded(rest, books, refining)


def _sub(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: p[1] - p[2])"


_CODED = f"""{_LISTED}, res AS MATERIALIZED (SELECT vec_id, list, {_sub('e', 'c')} AS e FROM asg JOIN vec USING (vec_id) JOIN cent ON cent.code = list WHERE rank = 1),
{lloyd_sql('book', 'res', str(CODES), CODE_ROUNDS, PARTS)},
pc AS MATERIALIZED (SELECT vec_id, p, code, c, {_sub('s', 'c')} AS left_s FROM book_part JOIN book USING (p) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY {_L2.format('s', 'c')}, code) = 1),
fin AS MATERIALIZED (SELECT vec_id, flatten(list(left_s ORDER BY p)) AS e FROM pc GROUP BY vec_id),
{lloyd_sql('fine', 'fin', str(CODES), CODE_ROUNDS, PARTS)},
fc AS MATERIALIZED (SELECT vec_id, p, code, c FROM fine_part JOIN fine USING (p) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY {_L2.format('s', 'c')}, code) = 1),
meant AS MATERIALIZED (SELECT vec_id, flatten(list(pc.c ORDER BY p)) AS y, flatten(list(list_transform(list_zip(pc.c, fc.c), lambda x: x[1] + x[2]) ORDER BY p)) AS z,
  string_agg(pc.code, ',' ORDER BY p) AS codes, string_agg(fc.code, ',' ORDER BY p) AS finer FROM pc JOIN fc USING (vec_id, p) GROUP BY vec_id)"""
_SEARCHED = f"""{_CODED}, off AS MATERIALIZED (SELECT query_id, base_id, {_sub('e', 'c')} AS r, y, z FROM cand JOIN vec ON vec.vec_id = query_id JOIN cent ON cent.code = list JOIN meant ON meant.vec_id = base_id),
ad AS (SELECT query_id, base_id, {_L2.format('r', 'y')} AS score, {_L2.format('r', 'z')} AS refined FROM off),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, base_id) AS place FROM ad QUALIFY place <= {K * lists.FACTOR}),
hit AS MATERIALIZED (SELECT query_id, base_id, score, refined, CAST(row_number() OVER (PARTITION BY query_id ORDER BY refined, base_id) AS INT) AS rank FROM cut QUALIFY rank <= {K})"""


def _joined(codes):
    return F.array_join(F.transform(codes, lambda c: c.cast("string")), ",").alias(codes)


@query("ivfpq_codes", f"WITH RECURSIVE {_CODED} SELECT vec_id, codes, finer FROM meant")
def ivfpq_codes(spark, sf_dir):
    """The codes of each vector's residual, and of what they leave of it."""
    return _coded_lists(spark, sf_dir)[4].select("vec_id", _joined("codes"), _joined("finer"))


@query("ivfpq_search", f"WITH RECURSIVE {_SEARCHED} SELECT query_id, rank, base_id, round(score, 6) AS score, round(refined, 6) AS refined FROM hit")
def ivfpq_search(spark, sf_dir):
    """Nearest by the codes of the probed lists, the best of them in the order of their refined distances."""
    base, centres, books, refining, codes = _coded_lists(spark, sf_dir)
    found = lists.search_codes(codes, lists.with_lists(base, centres, PROBES), centres, books, refining)
    return found.withColumns({c: F.round(c, 6) for c in ("score", "refined")})


# --- residual stages ---------------------------------------------------------------------------------------


def _stage_books(spark, sf_dir):
    base = vecs(spark, sf_dir)
    return base, additive.residual_books(base, STAGES, STAGE_CODES, STAGE_ROUNDS)


def _stages() -> str:
    parts = [_VEC]
    for s in range(STAGES):
        rows = f"rest{s}" if s else "vec"
        parts.append(lloyd_sql(f"st{s}", rows, str(STAGE_CODES), STAGE_ROUNDS))
        parts.append(f"rest{s + 1} AS MATERIALIZED (SELECT r.vec_id, t.code AS picked, {_sub('r.e', 't.c')} AS e, {_L2.format('r.e', 't.c')} AS d FROM {rows} r, st{s} t QUALIFY row_number() OVER (PARTITION BY r.vec_id ORDER BY {_L2.format('r.e', 't.c')}, t.code) = 1)")
    return ", ".join(parts)


def _beam() -> str:
    parts = ["bm0 AS (SELECT vec_id, 1 AS place, e, '' AS codes, 0.0::DOUBLE AS d FROM vec)"]
    for s in range(STAGES):
        comma = "|| ','" if s else ""
        parts.append(f"bm{s + 1} AS MATERIALIZED (SELECT * FROM (SELECT b.vec_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_L2.format('b.e', 't.c')}, b.place, t.code) AS place, {_sub('b.e', 't.c')} AS e, b.codes {comma} || t.code AS codes, {_L2.format('b.e', 't.c')} AS d FROM bm{s} b, st{s} t) WHERE place <= {BEAM})")
    return ", ".join(parts)


_GREEDY = f"greedy AS (SELECT vec_id, concat_ws(',', {', '.join(f'rest{s + 1}.picked' for s in range(STAGES))}) AS codes, rest{STAGES}.d AS d FROM rest1 {' '.join(f'JOIN rest{s + 1} USING (vec_id)' for s in range(1, STAGES))})"


@query("residual_quantiser", f"WITH RECURSIVE {_stages()} {' UNION ALL '.join(f'SELECT {s + 1} AS stage, count(*) AS n, count(DISTINCT picked) AS used, round(sum(d), 4) AS error FROM rest{s + 1}' for s in range(STAGES))}")
def residual_quantiser(spark, sf_dir):
    """What is left after each stage of codes, and how many codes are in use."""
    base, books = _stage_books(spark, sf_dir)
    rows = additive.residual_codes(base, books).select(F.posexplode(F.arrays_zip("codes", "errors")).alias("i", "x"))
    by_stage = rows.groupBy((F.col("i") + 1).alias("stage"))
    return by_stage.agg(F.count("*").alias("n"), F.count_distinct("x.codes").alias("used"), F.round(F.sum("x.errors"), 4).alias("error"))


@query("residual_beam", f"WITH RECURSIVE {_stages()}, {_beam()}, {_GREEDY} SELECT vec_id, CASE WHEN b.d < g.d THEN b.codes ELSE g.codes END AS codes, round(least(b.d, g.d), 6) AS error FROM bm{STAGES} b JOIN greedy g USING (vec_id) WHERE place = 1")
def residual_beam(spark, sf_dir):
    """The best sequence of codes that a beam finds for each vector."""
    base, books = _stage_books(spark, sf_dir)
    found = additive.residual_codes(base, books, BEAM)
    return found.select("vec_id", _joined("codes"), F.round(F.element_at("errors", -1), 6).alias("error"))


# --- rotations ---------------------------------------------------------------------------------------------


@query("opq_codes")
def opq_codes(spark, sf_dir):
    """Product codes of vectors that a fitted rotation has turned; no SQL: the tests hold its turns against plain ones."""
    base = vecs(spark, sf_dir)
    rotation, books, _ = additive.opq(base, PARTS, CODES, TURNS)
    return indexes.product_codes(additive.turned(base, rotation), books).select("vec_id", _joined("codes"))


@query("itq_codes")
def itq_codes(spark, sf_dir):
    """Signs on principal axes that are turned towards the corners of a cube; no SQL, as above."""
    base = vecs(spark, sf_dir)
    mean, projection, _ = additive.itq(base, BITS, TURNS)
    return additive.sign_codes(base, mean, projection)


# --- a store of lists --------------------------------------------------------------------------------------

#: Lists of over so many times their mean size are not read.
STOP_SIZE = 3


@query("list_store", f"""WITH RECURSIVE {_LISTED}, held AS (SELECT vec_id, list, e FROM asg JOIN vec USING (vec_id) WHERE rank = 1 AND vec_id % 7 <> 0
  UNION ALL SELECT vec_id + 1000000, list, e FROM asg JOIN vec USING (vec_id) WHERE rank = 1 AND vec_id % 5 = 1),
size AS (SELECT list, count(*) AS n FROM held GROUP BY list), kept AS (SELECT held.* FROM held JOIN size USING (list) WHERE n <= {STOP_SIZE} * (SELECT avg(n) FROM size)),
sc AS (SELECT q.vec_id AS query_id, k.vec_id AS base_id, q.list, {_L2.format('k.e', 'v.e')} AS score FROM asg q JOIN vec v ON v.vec_id = q.vec_id JOIN kept k ON k.list = q.list AND k.vec_id <> q.vec_id WHERE q.rank <= {PROBES})
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, base_id) AS INT) AS rank, base_id, list, round(score, 6) AS score FROM sc QUALIFY rank <= {K}""")
def list_store(spark, sf_dir):
    """Lists in files, some members removed and others added, searched without overlong lists."""
    base, centres = _fitted(spark, sf_dir)
    members = lists.with_lists(base, centres)
    store = liststore.created(members, new_path(spark, "list-store"))
    more = members.filter("vec_id % 5 = 1").withColumn("vec_id", F.col("vec_id") + 1000000)
    store = store.changed(more, base.filter("vec_id % 7 = 0"))
    sizes = [n for _, n in store.lists.values()]
    asked = lists.with_lists(base, centres, PROBES)
    found = lists.search_lists(store.without_stop_lists(int(STOP_SIZE * sum(sizes) / max(1, len(sizes)))).probed(asked), asked)
    return found.withColumn("score", F.round("score", 6))


# --- predicted stops ---------------------------------------------------------------------------------------

#: Coefficients of a fitted model, and the predicted recall at which a query stops.
MODEL, TARGET = (-0.15, 0.2, -0.25, -0.1), 0.6
#: Queries are the vectors whose ids are divisible by this.
ASKED = 5


_STOPS = f"""{_LISTED}, ask AS (SELECT vec_id, list, rank, coalesce(lead(d) OVER (PARTITION BY vec_id ORDER BY rank), d) AS ahead FROM asg WHERE vec_id % {ASKED} = 0),
top AS (SELECT * FROM ask WHERE rank <= {earlystop.ROUNDS}), size AS (SELECT list, count(*) AS n FROM asg WHERE rank = 1 GROUP BY list),
got AS (SELECT t.vec_id AS query_id, b.vec_id AS base_id, t.rank AS came, {_L2.format('q.e', 'v.e')} AS score FROM top t JOIN asg b ON b.list = t.list AND b.rank = 1 AND b.vec_id <> t.vec_id JOIN vec q ON q.vec_id = t.vec_id JOIN vec v ON v.vec_id = b.vec_id),
so AS (SELECT r.vec_id AS query_id, r.rank AS round, r.ahead, g.base_id, g.score, g.came, row_number() OVER (PARTITION BY r.vec_id, r.rank ORDER BY g.score, g.base_id) AS place FROM top r LEFT JOIN got g ON g.query_id = r.vec_id AND g.came <= r.rank QUALIFY place <= {K}),
feat AS (SELECT query_id, round, count(*) FILTER (came = round) / {K} AS fresh, CASE WHEN count(base_id) = {K} AND any_value(ahead) > 0 THEN max(score) / any_value(ahead) ELSE 0 END AS reach FROM so GROUP BY ALL),
seen AS (SELECT vec_id AS query_id, rank AS round, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY vec_id ORDER BY rank) AS BIGINT) AS read FROM top LEFT JOIN size USING (list)),
guess AS (SELECT query_id, round, read, {MODEL[0]} + {MODEL[1]} * ln(1 + read) + {MODEL[2]} * fresh + {MODEL[3]} * reach AS predicted FROM feat JOIN seen USING (query_id, round)),
stop AS MATERIALIZED (SELECT * FROM guess QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN predicted >= {TARGET} THEN round ELSE 1000 - round END) = 1)"""


def _stopped(spark, sf_dir):
    base, centres = _fitted(spark, sf_dir)
    return earlystop.search_until(lists.with_lists(base, centres), base.filter(F.col("vec_id") % ASKED == 0), centres, list(MODEL), TARGET)


@query("predicted_stops", f"WITH RECURSIVE {_STOPS} SELECT query_id, CAST(round AS INT) AS rounds, read, round(predicted, 8) AS predicted FROM stop")
def predicted_stops(spark, sf_dir):
    """After how many lists each query was predicted to know enough."""
    return _stopped(spark, sf_dir)[1].withColumn("predicted", F.round("predicted", 8))


@query("predicted_search", f"WITH RECURSIVE {_STOPS} SELECT query_id, CAST(place AS INT) AS rank, base_id, round(score, 6) AS score FROM so JOIN stop USING (query_id, round) WHERE base_id IS NOT NULL")
def predicted_search(spark, sf_dir):
    """What the queries knew when they stopped."""
    return _stopped(spark, sf_dir)[0].withColumn("score", F.round("score", 6))
