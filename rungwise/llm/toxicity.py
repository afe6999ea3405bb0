"""Toxicity: a lexicon learned from labels, matched with Levenshtein automata, weighed by context.

Learning (a bounded sample of labelled rows): words and word stems whose documents are labelled
toxic far more often than chance become terms; near copies in the sample count once.  The terms form
a trie.  A word of a text is a Levenshtein automaton of bound one; walking trie and automaton
together finds every term within the bound, or every stem within the bound of the word's beginning.
How far a match with an edit can be trusted is learned from the sample as well.

Scoring: every match has a context window of WINDOW words.  A match inside quotation marks or beside
a reporting word counts for less, one beside the second person or another match for more.  How much is
learned from the sample, where documents whose matches are all of one kind say how often it is meant;
QUOTED and ABUSIVE are the factors before any is seen.  Words that stand beside matches of clean
documents far more often than of toxic ones join the reporting words.  The score is the probability that
one match or more is meant: 1 - product(1 - p).

Defined results: null, empty and wordless texts, and all texts if the labels give no terms, score
BASE; a text is scored whole; equal texts get equal scores; the only inputs of a score are the text
and the lexicon; rows with a null doc_id are scored but never learned from; of several labels for
one id, toxic wins.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm.common import materialise, scratch, small_batches, table, unit_hash

#: Expected number of labelled rows that are learned from.
SAMPLE_ROWS = 12_000
#: A term's documents in the sample: this many, and this share of the toxic ones, at least.
MIN_SUPPORT, MIN_SUPPORT_SHARE = 3, 0.01
MIN_PRECISION = 0.75
STEM_LENGTHS = range(4, 8)
MIN_FUZZY_LENGTH = 5
THRESHOLD = 0.7
BASE = 0.02
WINDOW = 6
QUOTED, ABUSIVE = 0.5, 1.15
#: Documents that the factors before any is seen count as, and bounds of a learned factor.
CONTEXT_PRIOR, CONTEXT_BOUNDS = 20, (0.05, 1.3)
#: A learned reporting word: documents with a match beside it, and the toxic ones among them, at most.
REPORTING_SUPPORT, REPORTING_SHARE = 20, 0.1
CACHE_WORDS = 100_000

# Words of reporting and of the second person in the corpus's languages.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes term word dit écrit appelle mot sagte schrieb nannte wort dijo escribió llamó palabra".split())
SECOND_PERSON = frozenset("you your yours tu toi vous votre du dich dein ihr euch tú ti usted vosotros".split())
QUOTES = '"“”„«»'

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Lexicon:
    """Terms with the probability that a match is abuse; a stem's key ends with an asterisk."""

    terms: dict[str, float]
    fuzzy: dict[str, float] = field(default_factory=dict)
    reporting: frozenset[str] = REPORTING
    quoted: float = QUOTED
    abusive: float = ABUSIVE

    def __post_init__(self):
        self.trie: dict = {}
        self.starts: dict[int, set[str]] = {}
        self.ends: dict[int, set[str]] = {}
        self.middles: set[tuple[int, str]] = set()
        for term in self.terms:
            stem, bare = term.endswith("*"), term.rstrip("*")
            node = self.trie
            for c in bare:
                node = node.setdefault(c, {})
            node["*" if stem else "."] = term
            half = len(bare) // 2
            if len(bare) < MIN_FUZZY_LENGTH:
                half = len(bare)
            self.starts.setdefault(half, set()).add(bare[:half])
            if half < len(bare):
                if stem:
                    self.middles |= {(i, bare[half:]) for i in (half - 1, half, half + 1)}
                else:
                    self.ends.setdefault(len(bare) - half, set()).add(bare[half:])
        self._middle_lengths = sorted({(i, len(s)) for i, s in self.middles})

    def _may_match(self, word: str) -> bool:
        """With one edit, one half of a term is intact: at its end of the word, or a place off it."""
        return (
            any(word[:n] in s for n, s in self.starts.items())
            or any(word[-n:] in s for n, s in self.ends.items())
            or any((i, word[i : i + n]) in self.middles for i, n in self._middle_lengths)
        )

    def match(self, word: str) -> tuple[str, int, float] | None:
        """(term, edits, probability) of the best term within one edit of the word, or None."""
        if not self._may_match(word):
            return None
        n, best = len(word), None
        stack = [(self.trie, tuple(range(n + 1)), "")]
        while stack:
            node, row, path = stack.pop()
            for c, below in node.items():
                if c in "*.":
                    edits = min(row) if c == "*" else row[n]
                    if edits <= (1 if len(path) >= MIN_FUZZY_LENGTH else 0):
                        p = self.terms[below] if not edits else self.fuzzy.get(below, prior(below))
                        if best is None or (p, -edits) > (best[2], -best[1]):
                            best = (below, edits, p)
                    continue
                new = [row[0] + 1]
                for i in range(n):  # the automaton's step, as a row of edit distances
                    new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (word[i] != c)))
                if min(new) <= 1:
                    stack.append((below, tuple(new), path + c))
        return best


def prior(term: str) -> float:
    """Trust in a match with one edit before any is seen: long whole words are seldom hit by chance."""
    return 0.8 if len(term) >= 6 and not term.endswith("*") else 0.4


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.cache: dict[str, tuple | None] = {}

    def hits(self, text: str) -> tuple[list[str], dict[str, tuple]]:
        """(words, match of each distinct word that has one)."""
        words = _WORD.findall(text.lower())
        found = {}
        for w in set(words):
            try:
                got = self.cache[w]
            except KeyError:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                got = self.cache[w] = self.lexicon.match(w)
            if got is not None:
                found[w] = got
        return words, found

    def score(self, text: str | None) -> float:
        if not text:
            return BASE
        _, found = self.hits(text)
        if not found:
            return BASE
        miss = 1.0
        factor = {"quoted": self.lexicon.quoted, "abusive": self.lexicon.abusive, "plain": 1.0}
        for p, kind, _ in self.contexts(text.lower(), found):
            miss *= 1.0 - min(0.999, p * factor[kind])
        return max(BASE, 1.0 - miss)

    def contexts(self, text: str, found: dict[str, tuple]) -> Iterator[tuple[float, str, list[str]]]:
        """(probability, kind of context, words of the window) of each match, in order."""
        spots = list(_WORD.finditer(text))
        words = [m.group() for m in spots]
        at = [i for i, w in enumerate(words) if w in found]
        quote, seen = 0, 0  # quotation marks since the start of the line, each counted once
        for i in at:
            begin = spots[i].start()
            newline = text.rfind("\n", seen, begin)
            if newline >= 0:
                quote, seen = 0, newline + 1
            quote += sum(text.count(q, seen, begin) for q in QUOTES)
            seen = begin
            near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            kind = "plain"
            if quote % 2 or not self.lexicon.reporting.isdisjoint(near):
                kind = "quoted"
            elif not SECOND_PERSON.isdisjoint(near) or any(w in found for w in near):
                kind = "abusive"
            yield found[words[i]][2], kind, near


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _shingle_key(words: list[str]) -> int:
    """The least hash of five words: near copies mostly share it."""
    return min((zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))), default=0)


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon of the labelled rows that aren't held out."""
    with scratch():
        return _learned(docs, labels)


def _learned(docs: DataFrame, labels: DataFrame) -> Lexicon:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return Lexicon({})
    sample = known.filter(unit_hash("toxic sample", F.col("doc_id")) < min(1.0, SAMPLE_ROWS / n))
    # About SAMPLE_ROWS narrow rows; what they pick is written once, as it is read four times.
    rows = materialise(small_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"), "toxic-sample")

    def prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = _WORD.findall((text or "").lower())
                made.append((_shingle_key(words), int(toxic), " ".join(sorted(set(words)))))
            yield pd.DataFrame(made, columns=["key", "toxic", "vocabulary"])

    distinct = rows.mapInPandas(prepared, "key long, toxic int, vocabulary string").groupBy("key", "toxic").agg(F.max("vocabulary").alias("vocabulary")).cache()
    try:
        sizes = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not sizes.get(1):
            return Lexicon({})
        support = max(MIN_SUPPORT, MIN_SUPPORT_SHARE * sizes[1])

        def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                counts = (Counter(), Counter())
                for words, toxic in zip(batch["vocabulary"], batch["toxic"]):
                    seen = set()
                    for w in words.split():
                        if len(w) >= 4:
                            seen.add(w)
                            seen.update(w[:k] + "*" for k in STEM_LENGTHS if k < len(w))
                    counts[1 if toxic else 0].update(seen)
                yield pd.DataFrame([(t, counts[1][t], counts[0][t]) for t in counts[0].keys() | counts[1].keys()], columns=["term", "toxic", "clean"])

        found = distinct.select("vocabulary", "toxic").mapInPandas(features, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        good = found.filter((F.col("toxic") >= support) & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean") + 1)))
        terms = _chosen([(r["term"], r["toxic"], r["clean"]) for r in good.collect()])  # no more than the sample's words
        lexicon = Lexicon(terms)
        if terms:
            lexicon.fuzzy = _edits(distinct, lexicon)
            _learn_context(rows, lexicon)
        return lexicon
    finally:
        distinct.unpersist()


def _chosen(rows: list[tuple[str, int, int]]) -> dict[str, float]:
    """Stems that stand for more than one frequent word, then the words that no stem covers."""
    support = {t: n for t, n, _ in rows}
    trust = {t: (n + 1) / (n + c + 1.05) for t, n, c in rows}
    stems: list[str] = []
    for stem in sorted((t for t in support if t.endswith("*")), key=lambda t: (len(t), t)):
        bare = stem[:-1]
        best = max((n for t, n in support.items() if not t.endswith("*") and t.startswith(bare)), default=0)
        if support[stem] < 1.5 * best:
            continue
        above = [s for s in stems if bare.startswith(s[:-1])]
        if any(support[stem] < 0.9 * support[s] for s in above):
            continue
        stems = [s for s in stems if s not in above] + [stem]
    words = [t for t in support if not t.endswith("*") and not any(t.startswith(s[:-1]) for s in stems)]
    return {t: min(0.99, trust[t]) for t in sorted(stems + words, key=lambda t: (-support[t], t))}


def _edits(distinct: DataFrame, lexicon: Lexicon) -> dict[str, float]:
    """For each term the share of toxic among sampled documents that match it only with an edit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lexicon)
        for batch in batches:
            made = []
            for words, toxic in zip(batch["vocabulary"], batch["toxic"]):
                found = scorer.hits(words)[1].values()
                if all(edits for _, edits, _ in found):
                    made += [(t, int(toxic)) for t in {t for t, _, _ in found}]
            yield pd.DataFrame(made, columns=["term", "toxic"])

    counted = distinct.select("vocabulary", "toxic").mapInPandas(run, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()
    return {r["term"]: (r["t"] + 3 * prior(r["term"])) / (r["n"] + 3) for r in counted}


def _learn_context(rows: DataFrame, lexicon: Lexicon) -> None:
    """Sets the lexicon's reporting words, and then its factors, from the sampled texts."""

    def counted(part: str) -> list:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer, counts = Scorer(lexicon), Counter()
            for batch in batches:
                for text, toxic in zip(batch["text"], batch["toxic"]):
                    found = scorer.hits(text or "")[1]
                    seen = list(scorer.contexts(text.lower(), found)) if found else []
                    if part == "words":
                        values = {w for _, _, near in seen for w in near if len(w) > 2 and w not in found}
                    else:
                        kinds = {kind for _, kind, _ in seen}
                        values = kinds if len(kinds) == 1 else ()
                    counts.update((v, int(toxic)) for v in values)
            yield pd.DataFrame([(v, t, n) for (v, t), n in counts.items()], columns=["value", "toxic", "n"])

        made = rows.select("text", "toxic").mapInPandas(run, "value string, toxic int, n long")
        toxic = F.sum(F.when(F.col("toxic") > 0, F.col("n")).otherwise(0))
        return made.groupBy("value").agg(F.sum("n").alias("n"), toxic.alias("t")).filter((F.col("n") >= REPORTING_SUPPORT) | F.lit(part == "kinds")).collect()

    learned = {r["value"] for r in counted("words") if r["t"] <= REPORTING_SHARE * r["n"]}
    lexicon.reporting = REPORTING | learned
    kinds = {r["value"]: (r["t"], r["n"]) for r in counted("kinds")}
    t, n = kinds.get("plain", (0, 0))
    plain = (t + CONTEXT_PRIOR * 0.9) / (n + CONTEXT_PRIOR)
    for kind, before in (("quoted", QUOTED), ("abusive", ABUSIVE)):
        t, n = kinds.get(kind, (0, 0))
        rate = (t + CONTEXT_PRIOR * min(1.0, before * plain)) / (n + CONTEXT_PRIOR)
        setattr(lexicon, kind, min(max(rate / plain, CONTEXT_BOUNDS[0]), CONTEXT_BOUNDS[1]))


def with_score(docs: DataFrame, lexicon: Lexicon, out: str = "score") -> DataFrame:
    """``docs`` with the score of each text; a column of the score's name is replaced."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(lexicon)
        for batch in batches:
            yield pd.Series([scorer.score(t if isinstance(t, str) else None) for t in batch], dtype="float64")

    return small_batches(docs).withColumn(out, run(F.col("text")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = with_score(docs, lexicon)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
