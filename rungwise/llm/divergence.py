"""Audit of how the sources of a language differ in their words.

A document's terms are counted by language and source, map-side first.  The counts are dealt by ranges of
(language, term), so that all sources of a term meet in one task and every task holds its terms in UTF-8
order.  A task cuts its stream into chunks of bounded rows: the terms that enough documents hold become the
chunk's sorted dictionary, binary search turns terms into ids, and ids keep the order of the terms.  A
second pass, which knows the totals of every group, turns chunks into dense vectors a source, by counting
ids, and compares sources by vector arithmetic in 64-bit integers; ties of equal values fall to the smaller
id, which is the smaller term.  The dictionary is never sent anywhere as a whole: it grows with the corpus.

A group is a (language, source) pair.  For N occurrences of kept terms in a group and V kept terms, a term
that occurs n times there has p = 1 + floor(10^9 (n + 2) / (N + 2 V)); two values p and q are
floor((p - q)^2 / (p + q)) apart.  The part ``pair`` ranks the other sources of the language by the sum of
that over all kept terms, the part ``term`` the group's terms that are more frequent there than in the whole
language, up to TOP.

Defined results: null text, language and source are empty strings, and the empty string is a language and a
source like any other; documents without terms still make their group occur, with uniform p; a language
without kept terms has pairs of value 0 and no terms; equal rows count as documents of their own; empty
tables give no rows; texts of any length are counted whole; other columns are not read.  Exact for totals
below 9 * 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rungwise.llm.common import materialise, scratch, table

#: A term is kept by a language if so many of its documents hold it.
MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counts that a task holds of its stream before it cuts a chunk; cells of a dense block.
CHUNK_ROWS, BLOCK_CELLS = 1 << 18, 1 << 20

_CHUNK = "lang string, terms array<string>, sources array<string>, source_n array<bigint>, `at` array<int>, of array<int>, n array<bigint>"
_PART = "lang string, source string, part string, item string, value bigint"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents that hold it)."""
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    terms = F.sort_array(F.array_remove(F.split(lower, SEPARATORS, -1), ""))
    each = _groups(docs, terms.alias("terms"))
    # Sorted terms: the first of a run of equal ones counts the document.
    at = each.withColumn("i", F.explode_outer(F.when(F.size("terms") > 0, F.sequence(F.lit(0), F.size("terms") - 1)))).where("i IS NOT NULL")
    term = F.get("terms", F.col("i"))
    first = (F.col("i") == 0) | (term != F.get("terms", F.col("i") - 1))
    found = at.select("lang", "source", term.alias("term"), first.cast("int").alias("first"))
    return found.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("d"))


def _groups(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"), *more)


def _chunk(lang: str, rows: dict[str, np.ndarray], min_docs: int) -> dict | None:
    """The kept terms of a run of counts in the order of their terms, and the counts by id; None without any."""
    terms = rows["term"]
    starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
    kept = terms[starts][np.add.reduceat(rows["d"], starts) >= min_docs]
    if not len(kept):
        return None
    ids = np.minimum(np.searchsorted(kept, terms), len(kept) - 1)
    here = kept[ids] == terms
    sources, of = np.unique(rows["source"][here], return_inverse=True)
    n = rows["n"][here]
    totals = np.zeros(len(sources), np.int64)
    np.add.at(totals, of, n)
    return {"lang": lang, "terms": kept.tolist(), "sources": sources.tolist(), "source_n": totals, "at": ids[here].astype(np.int32), "of": of.astype(np.int32), "n": n}


_CHUNK_ARROW = pa.schema([
    ("lang", pa.string()), ("terms", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("source_n", pa.list_(pa.int64())),
    ("at", pa.list_(pa.int32())), ("of", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())),
])


def chunks(counts: DataFrame, min_docs: int = MIN_DOCS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of the dictionary with the counts of their terms; no term is in two chunks of a language."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def emit(rows, last):
            """Chunks of all rows but those of the last term, which may go on, and what is left."""
            while len(rows["n"]):
                lang = rows["lang"][0]
                end = int(np.searchsorted(rows["lang"] != lang, True))
                whole = end < len(rows["n"]) or last
                if not whole:
                    end = int(np.searchsorted(rows["term"], rows["term"][-1]))
                    if not end:
                        break
                made = _chunk(lang, {k: v[:end] for k, v in rows.items()}, min_docs)
                rows = {k: v[end:] for k, v in rows.items()}
                if made:
                    yield pa.RecordBatch.from_pylist([made], _CHUNK_ARROW)
                if not whole:
                    break
            return rows

        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            held = new if held is None else {k: np.concatenate([held[k], v]) for k, v in new.items()}
            if len(held["n"]) >= chunk_rows:
                held = yield from emit(held, False)
        if held is not None:
            yield from emit(held, True)

    dealt = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(cut, _CHUNK)


def probabilities(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (n + 2) / total), three digits at a time so that no product overflows."""
    p, rest = np.zeros(np.broadcast_shapes(np.shape(n), np.shape(total)), np.int64), n + 2
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        p = p * 1000 + step
    return p + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _top_terms(row: dict, of: np.ndarray, totals: np.ndarray, kept: int, top: int) -> Iterator[tuple]:
    """(lang, source, "term", term, value) of the best terms of each source in a chunk."""
    at, n = np.asarray(row["at"], np.int64), np.asarray(row["n"], np.int64)
    whole = np.zeros(len(row["terms"]), np.int64)
    np.add.at(whole, at, n)
    p = probabilities(n, totals[of] + 2 * kept)
    q = probabilities(whole, int(totals.sum()) + 2 * kept)[at]
    more = np.flatnonzero(p > q)
    value = distance(p, q)
    order = more[np.lexsort((at[more], -value[more], of[more]))]
    owner = of[order]
    place = np.arange(len(order)) - np.searchsorted(owner, owner)
    for i in order[place < top].tolist():
        yield row["lang"], row["all_sources"][of[i]], "term", row["terms"][at[i]], int(value[i])


def _pair_sums(row: dict, of: np.ndarray, totals: np.ndarray, kept: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, sums over the chunk's terms of the distances of source i from the sources after it)."""
    sources, width = len(totals), len(row["terms"])
    at, n = np.asarray(row["at"], np.int64), np.asarray(row["n"], np.int64)
    step = max(1, BLOCK_CELLS // sources)
    order = np.argsort(at, kind="stable")
    at, of, n = at[order], of[order], n[order]
    if not width:  # pairs of a language exist without terms
        yield from ((i, np.zeros(sources - 1 - i, np.int64)) for i in range(sources))
    for low in range(0, width, step):
        high = min(width, low + step)
        part = slice(*np.searchsorted(at, [low, high]))
        cell = of[part] * (high - low) + at[part] - low
        dense = np.zeros(sources * (high - low), np.int64)
        np.add.at(dense, cell, n[part])
        p = probabilities(dense.reshape(sources, high - low), (totals + 2 * kept)[:, None])
        for i in range(sources):
            yield i, distance(p[i], p[i + 1 :]).sum(axis=1)


def _compared(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "part", "item", "value"]
        schema = pa.schema([(c, pa.string()) for c in names[:-1]] + [("value", pa.int64())])
        sums: dict[str, tuple[list[str], np.ndarray]] = {}

        def packed(rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def both_ways(lang: str, sources: list[str], i: int, later: list[int]) -> Iterator[pa.RecordBatch]:
            if later:
                pairs = [x for b, v in zip(sources[i + 1 :], later) for x in ((lang, sources[i], "pair", b, v), (lang, b, "pair", sources[i], v))]
                yield packed(pairs)

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, (sources, matrix) in sums.items():
                for i, row in enumerate(matrix):
                    yield from both_ways(lang, sources, i, row[i + 1 :].tolist())
            sums.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                kept, totals = row["kept"], np.asarray(row["totals"], np.int64)
                to_all = np.searchsorted(np.asarray(row["all_sources"], object), np.asarray(row["sources"], object))
                of = to_all[np.asarray(row["of"], np.int64)]
                if row["terms"] and (found := list(_top_terms(row, of, totals, kept, top))):
                    yield packed(found)
                if len(totals) ** 2 > BLOCK_CELLS:  # too many sources to add up their pairs here
                    for i, part in _pair_sums(row, of, totals, kept):
                        yield from both_ways(row["lang"], row["all_sources"], i, part.tolist())
                    continue
                if row["lang"] not in sums:
                    if sum(len(s) ** 2 for s, _ in sums.values()) + len(totals) ** 2 > BLOCK_CELLS:
                        yield from flushed()
                    sums[row["lang"]] = row["all_sources"], np.zeros((len(totals), len(totals)), np.int64)
                for i, part in _pair_sums(row, of, totals, kept):
                    sums[row["lang"]][1][i, i + 1 :] += part
        yield from flushed()

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value and rank, from 1 for each group and part."""
    with scratch():
        made = materialise(chunks(term_counts(docs), min_docs, chunk_rows), "chunks")
        found = made.select("lang", F.explode(F.arrays_zip("sources", "source_n")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.source_n").alias("n"))
        every = _groups(docs).distinct().join(found, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        kept = made.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
        # A language's sources in one row: the result has a row for each pair of them.
        by_lang = every.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("x")).join(kept, "lang", "left")
        totals = materialise(by_lang.select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.col("x.source").alias("all_sources"), F.col("x.n").alias("totals")), "totals")
        none = [F.array().cast(made.schema[c].dataType).alias(c) for c in made.columns if c != "lang"]
        rows = made.join(totals, "lang").unionByName(totals.select("*", *none))
        parts = materialise(rows.mapInArrow(_compared(top), _PART), "parts")
        pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        terms = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
        return materialise(pairs.withColumn("rank", rank).unionByName(terms), "audit", keep=True)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
x AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM x GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
v AS (SELECT lang, count(term)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM x JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
w AS (SELECT lang, term, sum(n)::HUGEINT AS n, (sum(sum(n)) OVER (PARTITION BY lang))::HUGEINT AS total FROM c GROUP BY lang, term),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS n, (1 + {UNIT} * (coalesce(c.n, 0)::HUGEINT + 2) // (n.total + 2 * v.v)) AS p
      FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
q AS (SELECT lang, term, (1 + {UNIT} * (w.n + 2) // (w.total + 2 * v.v)) AS q FROM w JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= {TOP}
"""
