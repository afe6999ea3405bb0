"""URL filters: an allow/block list over hosts and paths, and boosted trees for what it leaves open.

Native: parsing, rules and lexical features are DataFrame expressions; the trees are trained and
applied by Spark's own library on the JVM.  The URLs that a rule decides are the labelled ones; the
trees learn the verdict from lexical features (length, depth, digit ratio, entropy, parameter counts)
and from smoothed block rates of suffixes and first path segments, and judge every other URL.

Only the fit reads a sample: rows whose hash lies under ``SAMPLE_ROWS / labelled rows``, so about
SAMPLE_ROWS at any size.  The block rates are counted on all labelled rows, for every value, and joined;
they are broadcast up to BROADCAST_VALUES values (counted), beyond that the join is by value.  In the fit
a row's rates are those of the other FOLDS - 1 folds of labelled rows, so that no row's own label is in
its features; :func:`held_out_scores` scores labelled rows that neither the fit nor the rates have seen.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is
judged by the trees like any other; if the labelled URLs are none or of one kind only, that kind is
the verdict (allow if there are none); equal rows get equal rows; other columns are not read.  Rules are a
list, of which up to MAX_RULES are written into the plan, or a table of any size; a rule without a slash in a
table fits nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm.common import materialise, table, unit_hash

#: Expected number of labelled rows that the trees are fitted on.
SAMPLE_ROWS = 20_000
#: Values of a suffix or path segment up to which their rates are broadcast.
BROADCAST_VALUES = 100_000
PRIOR_ROWS = 10.0
FOLDS = 5
TREES, DEPTH = 10, 4
#: Rules that are written into the plan; more, or a table of them, are joined.
MAX_RULES = 500
#: Rules of a table up to which they are broadcast (counted).
BROADCAST_RULES = 100_000

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matched(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain, its path a prefix; of equally long ones the greater."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def joined_rules(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """``parsed`` (page_id, url, host, path) with rule and ruled, by the same choice from a table (kind, rule) of any size.

    A host meets the rules of its suffixes; of a suffix's rules only the lengths of paths travel, and the
    path's beginnings of those lengths are joined with the rules. Each rule is one row of its key, so that
    a frequent host repeats rows of pages only, which Spark splits where rules are too many to broadcast.
    """
    at = F.instr("rule", "/")
    split = rules.filter(at > 0).select("kind", "rule", F.substring("rule", F.lit(1), at - 1).alias("suffix"), F.substr("rule", at).alias("start"))
    split = materialise(split.groupBy("suffix", "start").agg(F.max("rule").alias("rule"), F.max("kind").alias("kind")).withColumn("size", F.length("start")), "url-rules")
    small = split.count() <= BROADCAST_RULES
    held = F.broadcast if small else (lambda df: df)
    sizes = split.groupBy("suffix").agg(F.collect_set("size").alias("sizes"))
    numbered = parsed.withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = numbered.filter("host <> ''").select("row", "path", F.explode(suffixes).alias("suffix")).join(held(sizes), "suffix")
    starts = asked.select("row", "path", "suffix", F.explode("sizes").alias("size")).filter(F.col("size") <= F.length("path"))
    fits = starts.withColumn("start", F.substring("path", F.lit(1), F.col("size"))).drop("size").join(held(split), ["suffix", "start"])
    best = fits.groupBy("row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "kind")).alias("best"))
    return numbered.join(best, "row", "left").select(*parsed.columns, F.col("best.rule").alias("rule"), F.col("best.kind").alias("ruled"))


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double") / n)
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def _features(pages: DataFrame) -> DataFrame:
    """Lexical features, and the two values whose block rates become features."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    n = F.length(url)
    count = lambda pattern: F.regexp_count(url, F.lit(pattern)).cast("double")
    lexical = {
        "f_length": n.cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_labels": F.size(F.split(host, r"\.")).cast("double"),
        "f_depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "f_digits": F.when(n > 0, count("[0-9]") / n).otherwise(0.0),
        "f_entropy": _entropy(url),
        "f_params": count("[?&][^=&#]*="),
        "f_hyphens": count("-"),
        "f_secure": url.startswith("https:").cast("double"),
    }
    return pages.withColumns(lexical | {"v_suffix": F.element_at(F.split(host, r"\."), -1), "v_segment": F.split_part(path, F.lit("/"), F.lit(2))})


LEXICAL = ["f_length", "f_host_length", "f_labels", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_secure"]
RATES = {"v_suffix": "f_suffix_rate", "v_segment": "f_segment_rate"}


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("url fold"), "page_id", "url"), F.lit(FOLDS)).cast("int")


def _rate(n: Column, blocked: Column, prior: float) -> Column:
    return (F.coalesce(blocked, F.lit(0.0)) + PRIOR_ROWS * prior) / (F.coalesce(n, F.lit(0)) + PRIOR_ROWS)


def _counts(labelled: DataFrame, value: str) -> DataFrame:
    """Each labelled value with its rows and blocked rows, in all and for each fold."""
    folds = [c for k in range(FOLDS) for c in (F.count(F.when(F.col("fold") == k, 1)).alias(f"n{k}"), F.sum(F.when(F.col("fold") == k, F.col("label")).otherwise(0.0)).alias(f"b{k}"))]
    counted = materialise(labelled.groupBy(value).agg(F.count("*").alias("n"), F.sum("label").alias("blocked"), *folds), "url-rates")
    return F.broadcast(counted) if counted.count() <= BROADCAST_VALUES else counted


def _with_rates(featured: DataFrame, counts: dict[str, DataFrame], prior: float, own_fold: bool) -> DataFrame:
    """The rates of both values, for ``own_fold`` without the rows of the row's fold; the prior for values without a label."""
    for value, found in counts.items():
        n, blocked = F.col("n"), F.col("blocked")
        if own_fold:
            n = n - F.coalesce(*[F.when(F.col("fold") == k, F.col(f"n{k}")) for k in range(FOLDS)])
            blocked = blocked - F.coalesce(*[F.when(F.col("fold") == k, F.col(f"b{k}")) for k in range(FOLDS)])
        kept = [c for c in featured.columns if c != RATES[value]]
        featured = featured.join(found, value, "left").select(*kept, _rate(n, blocked, prior).alias(RATES[value]))
    return featured


def _trained(labelled: DataFrame, kinds: dict[str, int]):
    """(model, counts, prior) from labelled rows with features, label and fold."""
    total = sum(kinds.values())
    prior, share = kinds["block"] / total, min(1.0, SAMPLE_ROWS / total)
    counts = {value: _counts(labelled, value) for value in RATES}
    drawn = labelled.filter(unit_hash("url sample", F.col("url"), F.col("page_id")) < share)
    sample = _gather().transform(_with_rates(drawn, counts, prior, True)).select("features", "label").cache()
    try:
        return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(sample), counts, prior
    finally:
        sample.unpersist()


def _gather() -> VectorAssembler:
    return VectorAssembler(inputCols=[*LEXICAL, *RATES.values()], outputCol="features")


def _ruled(pages: DataFrame, rules) -> tuple[DataFrame, dict[str, int]]:
    """Parsed pages with rule and ruled (its verdict), and how many rows each verdict has."""
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not isinstance(rules, DataFrame) and len(rules) > MAX_RULES:
        rules = pages.sparkSession.createDataFrame(list(rules), "kind string, rule string")
    if isinstance(rules, DataFrame):
        ruled = materialise(joined_rules(parsed, rules), "url-ruled")
    else:
        rule, verdict = matched(F.col("host"), F.col("path"), rules)
        ruled = parsed.withColumn("rule", rule).withColumn("ruled", verdict)
    return ruled, {r["ruled"]: r["n"] for r in ruled.filter(F.col("ruled").isNotNull()).groupBy("ruled").agg(F.count("*").alias("n")).collect()}


def _labelled(ruled: DataFrame) -> DataFrame:
    return _features(ruled.filter(F.col("ruled").isNotNull())).withColumn("label", (F.col("ruled") == "block").cast("double")).withColumn("fold", _fold())


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block)."""
    ruled, kinds = _ruled(pages, rules)
    out = ["page_id", "host", "path", "rule"]
    if len(kinds) < 2:
        only = next(iter(kinds), "allow")
        return ruled.select(*out, F.coalesce("ruled", F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("score"))
    model, counts, prior = _trained(_labelled(ruled), kinds)
    scored = model.transform(_gather().transform(_with_rates(_features(ruled), counts, prior, False)))
    score = vector_to_array("probability")[1]
    return scored.select(*out, F.coalesce("ruled", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def held_out_scores(pages: DataFrame, rules=RULES) -> DataFrame:
    """label and score of the labelled rows of fold 0, by trees and rates that learn from the other folds only."""
    ruled, _ = _ruled(pages, rules)
    labelled = _labelled(ruled)
    known = labelled.filter("fold <> 0")
    kinds = {("block" if r["label"] else "allow"): r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    model, counts, prior = _trained(known, kinds)
    scored = model.transform(_gather().transform(_with_rates(labelled.filter("fold = 0"), counts, prior, False)))
    return scored.select("label", vector_to_array("probability")[1].alias("score"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def brute_force_rule(url: str | None, rules=RULES) -> tuple[str, str, str | None, str | None]:
    """(host, path, rule, verdict) by plain string operations, for tests."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    stop = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = reduce(lambda s, c: s.replace(c, c.lower()), _UPPER, rest[:stop]), rest[stop:]
    path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    fits = [(len(r), r, kind) for kind, r in rules if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]
