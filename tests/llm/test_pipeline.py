"""The pipeline's stages on whole small tables, each against a brute-force version of what its operator promises."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rungwise.llm import bagminhash, bpe, lines, mixing, toxicity
from rungwise.llm.common import table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _toxic(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    lexicon = toxicity.learn(docs.select("doc_id", "text"), table(spark, SMALL, "labels").select("doc_id", "toxic"))
    scorer = toxicity.Scorer(lexicon)
    return [r for r in rows if scorer.score(r["text"]) < toxicity.THRESHOLD]


def _lines(spark, rows):
    """Every line against all that stay before it, in the order of ids."""
    kept, equal, by_size, out = [], set(), {}, []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        stay = []
        parts = r["text"].split("\n")
        for line in parts:
            words = lines._words(line)
            if not words:
                stay.append(line)
                continue
            if line in equal:
                continue
            n = len(words)
            equal.add(line)
            bound = lambda m, n=n: lines.bound_of(min(n, m))
            near = n >= lines.NEAR_WORDS and any(lines.distance_within(words, w, bound(m)) for m in range(max(lines.NEAR_WORDS, n - 4), n + 5) for w in by_size.get(m, ()))
            if not near:
                stay.append(line)
                by_size.setdefault(n, []).append(words)
        if len(stay) == len(parts) or any(lines._words(x) for x in stay):
            out.append((r["doc_id"], "\n".join(stay)))
    return out


def _near(rows):
    shingler = bagminhash.Shingler()
    bags = [shingler.shingles(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(bags[i]) and len(bags[j]) and 0.79 * len(bags[i]) <= len(bags[j]) <= len(bags[i]) / 0.79 and bagminhash.overlap(bags[i], bags[j]) >= 0.8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for r, g in zip(rows, group):
        first[g] = min(first.get(g, r["doc_id"]), r["doc_id"])
    return set(first.values())


def _mixed(spark, rows):
    done = mixing.featured(spark.createDataFrame(rows, SCHEMA)).select("doc_id", *["_" + d for d in mixing.DIMS], "_tokens", "_u").toPandas()
    cells = done.groupby(["_" + d for d in mixing.DIMS], as_index=False).agg(tokens=("_tokens", "sum"), docs=("_u", "size"))
    fit = mixing.fitted(cells.rename(columns={"_" + d: d for d in mixing.DIMS})).cells.set_index(list(mixing.DIMS)).p
    return {r["doc_id"] for _, r in done.iterrows() if r["_u"] < fit[tuple(r["_" + d] for d in mixing.DIMS)]}


def test_every_stage_against_brute_force(spark):
    docs = table(spark, SMALL, "documents").select(*corpus_pipeline.COLUMNS)
    held = docs.collect()
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, rows):
        got = stages[name](spark, spark.createDataFrame(rows, SCHEMA), SMALL)
        assert got.columns == docs.columns
        return sorted(got.collect(), key=lambda r: r["doc_id"])

    clean = stage("toxicity", held)
    assert [r["doc_id"] for r in clean] == [r["doc_id"] for r in sorted(_toxic(spark, held), key=lambda r: r["doc_id"])]
    thin = stage("line dedup", clean)
    assert [(r["doc_id"], r["text"]) for r in thin] == _lines(spark, clean) and all(r["n_chars"] == len(r["text"]) for r in thin)
    apart = stage("near-dedup", thin)
    assert {r["doc_id"] for r in apart} == _near(thin)
    alone = stage("near-dedup", clean)
    assert {r["doc_id"] for r in alone} == _near(clean) and len(alone) < len(clean)
    drawn = stage("mixing", apart)
    assert {r["doc_id"] for r in drawn} == _mixed(spark, apart)
    codec = bpe.Codec(bpe.Codec.parse(open(bpe.default_path(), "rb").read()))
    rows = corpus_pipeline.run(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in drawn}
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(r["decoded_ok"] and list(r["ids"]) == codec.encode(texts[r["doc_id"]]) for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(1, "a b c d e f\ng", "en", "s", 13), (1, "a b c d e f\ng", "en", "s", 13), (None, "lone words here", None, None, None), (2, None, "en", None, None), (3, "", "de", "t", 0), (4, " \n\t", None, "t", 3), (5, "w " * 40_000, "en", "s", 80_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "score", "_score", "p", "_p", "_u", "n_dropped", "n_lines", "words", "h0", "stays", "ids")})
    got = stage(spark, docs, SMALL)
    if name == "encoding":
        assert sorted(r["n_tokens"] for r in got.collect())[:2] == [0, 0] and got.count() == len(rows)
    else:
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        kept = got.collect()
        assert 0 < len(kept) <= len(rows) and all(r["row"] == r["n_dropped"] == r["score"] == "x" for r in kept)
        if name == "line dedup":
            assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "1", "None", "2", "3", "4", "5"])
        if name == "near-dedup":
            assert len(kept) == len(rows)
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_short_and_unspaced_lines_are_deduplicated(spark):
    rows = [(1, "Les.\n漢字漢字漢字漢字\none two three four five\n\na b c d"), (2, "Les.\n漢字漢字漢字漢字\none two X four five\n\na b c X")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, SMALL).collect()}
    assert got == {1: rows[0][1], 2: "\na b c X"}


def test_documents_that_line_dedup_empties_go(spark):
    rows = [(1, "one two three"), (2, "one two three\n"), (3, ""), (4, None), (5, "one two three\nown")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, SMALL).collect()}
    assert got == {1: "one two three", 3: "", 4: None, 5: "own"}


def test_the_whole_run_has_no_empty_documents_that_it_made(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    empty = table(spark, SMALL, "documents").filter(~F.coalesce("text", F.lit("")).rlike(r"\S")).count()
    assert rows.filter("n_tokens = 0").count() <= empty
    assert np.mean([r["n_tokens"] for r in rows.select("n_tokens").collect()]) > 20
