"""From documents to token ids: toxicity, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the
last return the columns of ``docs``, whatever further ones it has and however they are named.  ORACLE_SQL is
None: learned scores, growing edit bounds, signatures and BPE merges have no SQL form together, so the tests
hold every stage against a brute-force version.

Defined results: a null text scores like an empty one, has no lines and no shingles, is mixed as an empty
one and has no ids; empty and wordless texts stay but for those that line dedup emptied; rows with equal ids
and texts share one fate but in near-dedup, where one row of a group's first text stays for each time it
occurs; rows with null ids are kept or dropped like others; a stage of no rows returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm import bagminhash, bpe, lines, mixing, toxicity
from rungwise.llm.common import WORD_CLASS, materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _nested(docs: DataFrame) -> DataFrame:
    """The columns that stages work on, and all columns inside one, so that no name can clash."""
    return docs.select(*COLUMNS, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold, by a lexicon learned from the labels of these documents."""
    lexicon = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.with_score(_nested(docs).select("row", "text"), lexicon).filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals; those that lose all their words go."""
    done = lines.dedup_lines(_nested(docs)).filter((F.col("n_dropped") == 0) | F.col("text").rlike(WORD_CLASS))
    own = [F.col(c) if c in ("text", "n_chars") else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*own)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    return bagminhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights meet the targets by source, language and topic."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and decoded_ok: the ids decode to the text's bytes."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_ok")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_documents),
    ("mixing", mix_sources),
    ("encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
