"""Mixing sources to target weights: raked token weights, then sampling by calibrated probabilities.

Documents are first summed to cells (source, language, topic).  Iterative proportional fitting scales
the cells' token weights to one margin after the other; a document's probability is its cell's weight
over the cell's tokens, one at most, and the margins are those of the probabilities.  A document is kept
if a hash of its id is below its cell's probability, which any engine and any re-run repeats.

The default targets are the values' token shares to a power, so that rare values are lifted; a value is
never asked for more tokens than it has, and what that leaves is shared among the others.  Of POWERS the
smallest is taken whose fit meets every margin within TOLERANCE; the last, one, always does.  Targets that
a caller gives are met within TOLERANCE or are an error that names the worst margin.

Only the cells are iterated over.  Up to MAX_CELLS of them (checked) the fit runs in NumPy on the
driver; beyond that the same sweeps run as DataFrame aggregations, each written to the shared folder.

Defined results: null sources, languages and topics are the value ``(none)``; null texts and ids are
an empty text and the word null in the hash; cells without tokens have probability 0, as do all cells
of an empty table; rows with equal ids are kept or dropped together if in one cell; targets for values
that don't occur are ignored and the others scaled up, and targets that name no value that occurs are an
error; a value without a target has weight 0; all columns of the input are kept by :func:`sample`,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm.common import count_of, materialise, n_words, scratch, table, unit_hash

DIMS = ("source", "lang", "topic")
#: Share of all tokens that is kept in expectation.
BUDGET = 0.8
#: Powers of the token shares that the default targets try, in this order.
POWERS = (0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)
SWEEPS = 60
#: Largest error of a margin, as a share of its target.
TOLERANCE = 0.01
MAX_CELLS = 100_000
SEED = "mix"
NONE = "(none)"

_SYMBOLS = "#*$%&|<>"


def topic_of(words: Column, bars: Column, symbols: Column, lines: Column) -> Column:
    """A coarse kind of text by shape; any other column can stand in for it."""
    return (
        F.when(words < 50, "short")
        .when(bars * 10 >= words, "table")
        .when(symbols * 10 >= words, "markup")
        .when(lines * 12 >= words, "list")
        .when(words >= 1000, "long")
        .otherwise("prose")
    )


def featured(docs: DataFrame, topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """``docs`` with _source, _lang, _topic, _tokens and _u, the document's place in [0, 1)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    filled = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    counted = docs.withColumns({"_tokens": n_words(text) if tokens is None else tokens.cast("long")})
    if topic is None:
        # Counted once, in a projection of their own.
        shape = {"_words": n_words(text) if tokens is not None else F.col("_tokens"), "_bars": count_of(text, "|"), "_symbols": count_of(text, _SYMBOLS), "_lines": count_of(text, "\n") + 1}
        counted = counted.withColumns(shape)
        topic = topic_of(F.col("_words"), F.col("_bars"), F.col("_symbols"), F.col("_lines"))
    ready = counted.withColumns({"_source": filled(F.col("source")), "_lang": filled(F.col("lang")), "_topic": filled(topic), "_u": unit_hash(SEED, F.col("doc_id"))})
    return ready.drop("_words", "_bars", "_symbols", "_lines")


def cells_of(featured_docs: DataFrame) -> DataFrame:
    return featured_docs.groupBy(*[F.col("_" + d).alias(d) for d in DIMS]).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs"))


@dataclass
class Fit:
    """Cells with their probability p; margins (dim, value, tokens, target, reached); the power and the worst error."""

    cells: pd.DataFrame
    margins: pd.DataFrame
    power: float
    worst: float


def capped(totals: np.ndarray, raw: np.ndarray, amount: float) -> np.ndarray:
    """``amount`` dealt out in proportion to ``raw``, but to none more than its total."""
    goal = np.zeros(len(totals))
    full = np.zeros(len(totals), bool)
    while True:
        open_raw = raw[~full].sum()
        goal[full] = totals[full]
        goal[~full] = raw[~full] * ((amount - totals[full].sum()) / open_raw) if open_raw > 0 else 0.0
        over = ~full & (goal > totals)
        if not over.any():
            return goal
        full |= over


def _goals(totals: pd.Series, dim: str, targets: Mapping[str, Mapping[str, float]] | None, amount: float, power: float) -> pd.Series:
    """Target tokens of the values that occur; they sum to ``amount``."""
    if targets and dim in targets:
        given = pd.Series({v: float(targets[dim].get(v, 0.0)) for v in totals.index}, dtype=float)
        if not given.sum() > 0:
            raise ValueError(f"the targets of {dim} name no value that occurs")
        return given / given.sum() * amount
    t = totals.to_numpy(float)
    return pd.Series(capped(t, (t / t.sum()) ** power, amount), totals.index)


def rake(cells: pd.DataFrame, budget: float = BUDGET, targets=None, sweeps: int = SWEEPS, power: float = 1.0) -> Fit:
    """Probabilities whose expected margins approach their targets, and how near they come."""
    cells = cells.reset_index(drop=True)
    tokens = cells["tokens"].to_numpy(float)
    total = tokens.sum()
    if not total:
        return Fit(cells.assign(p=0.0), pd.DataFrame(columns=["dim", "value", "tokens", "target", "reached"]), power, 0.0)
    live = cells[tokens > 0]
    margins = []
    for dim in DIMS:
        totals = live.groupby(dim)["tokens"].sum().sort_index()
        goal = _goals(totals, dim, targets, budget * total, power)
        codes = goal.index.get_indexer(cells[dim])
        margins.append((dim, totals, np.where(codes < 0, 0, codes), goal.to_numpy()))
    w = tokens * budget
    for _ in range(sweeps):
        for _, _, codes, goal in margins:
            now = np.bincount(codes, np.minimum(tokens, w), len(goal))
            w = w * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[codes]
    w = np.minimum(tokens, w)
    report = pd.concat([pd.DataFrame({"dim": dim, "value": totals.index, "tokens": totals.to_numpy(), "target": goal, "reached": np.bincount(codes, w, len(goal))}) for dim, totals, codes, goal in margins])
    asked = report["target"].to_numpy()
    error = np.abs(report["reached"].to_numpy() - asked)
    worst = float(np.max(np.divide(error, asked, out=np.where(error > 0, np.inf, 0.0), where=asked > 0)))
    return Fit(cells.assign(p=np.divide(w, tokens, out=np.zeros_like(w), where=tokens > 0)), report, power, worst)


def fitted(cells: pd.DataFrame, budget: float = BUDGET, targets=None, sweeps: int = SWEEPS) -> Fit:
    """The fit of the smallest power that meets every margin; an error where given targets can't be met."""
    for power in POWERS:
        fit = rake(cells, budget, targets, sweeps, power)
        if fit.worst <= TOLERANCE:
            return fit
    off = fit.margins.assign(error=(fit.margins["reached"] - fit.margins["target"]).abs() / fit.margins["target"]).sort_values("error").iloc[-1]
    raise ValueError(f"targets can't be met: {off['dim']} {off['value']!r} has {off['reached']:.0f} of {off['target']:.0f} tokens at budget {budget}")


def _rake_distributed(cells: DataFrame, budget: float, targets, sweeps: int) -> DataFrame:
    """The same fit where the cells don't fit the driver: aggregations and joins, a table a sweep."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("p", F.lit(0.0))
    for power in POWERS:
        now, goals = materialise(cells.withColumn("w", F.col("tokens") * F.lit(budget)), "rake"), {}
        for dim in DIMS:
            goals[dim] = _goals_distributed(now, dim, targets, budget * total, power)
        for _ in range(sweeps):
            for dim in DIMS:
                sums = now.groupBy(dim).agg(F.sum(F.least("tokens", "w")).alias("s")).join(goals[dim], dim)
                factor = sums.select(dim, F.when(F.col("s") > 0, F.col("goal") / F.col("s")).otherwise(0.0).alias("f"))
                now = now.join(factor, dim, "left").withColumn("w", F.col("w") * F.coalesce("f", F.lit(0.0))).drop("f")
            now = materialise(now, "rake")
        worst = 0.0
        for dim in DIMS:
            sums = now.groupBy(dim).agg(F.sum(F.least("tokens", "w")).alias("s")).join(goals[dim], dim)
            error = F.abs(F.col("s") - F.col("goal"))
            worst = max(worst, sums.agg(F.max(F.when(F.col("goal") > 0, error / F.col("goal")).otherwise(F.when(error > 0, float("inf")).otherwise(0.0)))).first()[0])
        if worst <= TOLERANCE:
            p = F.least(F.lit(1.0), F.col("w") / F.col("tokens"))
            return now.select(*DIMS, "tokens", "docs", F.when(F.col("tokens") > 0, p).otherwise(0.0).alias("p"))
    raise ValueError(f"targets can't be met: an error of {worst:.3f} at budget {budget}")


def _goals_distributed(now: DataFrame, dim: str, targets, amount: float, power: float) -> DataFrame:
    """:func:`_goals` as a table."""
    sums = now.filter("tokens > 0").groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"))
    if targets and dim in targets:
        rows = now.sparkSession.createDataFrame(list(targets[dim].items()), f"{dim} string, raw double")
        given = sums.join(rows, dim, "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
        whole = given.agg(F.sum("raw")).first()[0]
        if not whole > 0:
            raise ValueError(f"the targets of {dim} name no value that occurs")
        return materialise(given.select(dim, (F.col("raw") / F.lit(whole) * F.lit(amount)).alias("goal")), "goal")
    raw = materialise(sums.withColumn("raw", F.pow(F.col("t") / F.lit(amount), F.lit(power))).withColumn("full", F.lit(False)), "goal")
    while True:
        kept, left = raw.agg(F.sum(F.when(F.col("full"), F.col("t")).otherwise(0.0)), F.sum(F.when(~F.col("full"), F.col("raw")).otherwise(0.0))).first()
        goal = F.when(F.col("full"), F.col("t")).otherwise(F.col("raw") * F.lit((amount - kept) / left if left > 0 else 0.0))
        dealt = raw.withColumn("goal", goal)
        if dealt.filter("NOT full AND goal > t").isEmpty():
            return materialise(dealt.select(dim, "goal"), "goal")
        raw = materialise(dealt.withColumn("full", F.col("full") | (F.col("goal") > F.col("t"))).drop("goal"), "goal")


def calibrated(cells: DataFrame, budget: float = BUDGET, targets=None, max_cells: int = MAX_CELLS, sweeps: int = SWEEPS) -> DataFrame:
    """Cells with their probability p; broadcast only where their number is within the bound."""
    local = cells.limit(max_cells + 1).toPandas()
    if len(local) > max_cells:
        with scratch():
            return materialise(_rake_distributed(materialise(cells, "cells"), budget, targets, sweeps), "raked", keep=True)
    done = fitted(local.sort_values(list(DIMS)), budget, targets, sweeps).cells
    schema = "source string, lang string, topic string, tokens long, docs long, p double"
    return F.broadcast(cells.sparkSession.createDataFrame(done[[*DIMS, "tokens", "docs", "p"]], schema))


def _joined(docs: DataFrame, cells: DataFrame) -> DataFrame:
    on = cells.select(*[F.col(d).alias("_" + d) for d in DIMS], F.col("p").alias("_p"))
    return docs.join(on, ["_" + d for d in DIMS], "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))


def sample(docs: DataFrame, budget: float = BUDGET, targets=None) -> DataFrame:
    """The kept rows of ``docs``, with all of its columns as they were."""
    # The caller's columns travel inside one, so that no name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "lang", "text")
    done = featured(rows)
    return _joined(done, calibrated(cells_of(done), budget, targets)).filter("_u < _p").select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, topic, tokens, p (its probability, six places) and kept, for every document."""
    narrow = featured(table(spark, sf_dir, "documents")).select("doc_id", "_source", "_lang", "_topic", "_tokens", "_u")
    rows = materialise(narrow, "mix")  # the texts are read once
    done = _joined(rows, calibrated(cells_of(rows)))
    return done.select("doc_id", *[F.col("_" + d).alias(d) for d in DIMS], F.col("_tokens").alias("tokens"), F.round("_p", 6).alias("p"), (F.col("_u") < F.col("_p")).alias("kept"))


_GOALS = "\n".join(
    f"""raw_{d} AS (SELECT pw, {d} AS v, sum(tokens) AS t, pow(sum(tokens) / (SELECT n FROM total), pw) AS r FROM c, powers GROUP BY pw, {d}),
lot_{d} AS (SELECT *, ({BUDGET} * (SELECT n FROM total) - (sum(t) OVER w - t)) / (sum(r) OVER (PARTITION BY pw) - (sum(r) OVER w - r)) AS lot, t / r AS most FROM raw_{d} WINDOW w AS (PARTITION BY pw ORDER BY t / r, v ROWS UNBOUNDED PRECEDING)),
rate_{d} AS (SELECT pw, arg_min(lot, most) AS rate FROM lot_{d} WHERE lot <= most GROUP BY pw),
goal_{d} AS (SELECT pw, v, least(t, r * rate) AS goal FROM lot_{d} JOIN rate_{d} USING (pw)),"""
    for d in DIMS
)
_STEP = "{0} * g_{1} / sum(least(tokens, {0})) OVER (PARTITION BY pw, {1})"
_ERROR = "max(abs(s_{0} - g_{0}) / g_{0})"

OP1_SQL = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n,
    CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
d AS (
  SELECT doc_id, source, lang, n AS tokens, u,
    CASE WHEN n < 50 THEN 'short' WHEN (length(text) - length(replace(text, '|', ''))) * 10 >= n THEN 'table'
      WHEN (length(text) - length(translate(text, '{_SYMBOLS}', ''))) * 10 >= n THEN 'markup'
      WHEN (length(text) - length(replace(text, chr(10), '')) + 1) * 12 >= n THEN 'list' WHEN n >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM t),
c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0),
total AS (SELECT sum(tokens) AS n FROM c),
powers AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in POWERS)}]) AS pw),
{_GOALS}
fit AS (
  SELECT 0 AS sweep, a.pw, source, lang, topic, tokens, a.goal AS g_source, b.goal AS g_lang, e.goal AS g_topic, tokens * {BUDGET} AS w
  FROM c JOIN goal_source a ON a.v = source JOIN goal_lang b ON b.v = lang AND b.pw = a.pw JOIN goal_topic e ON e.v = topic AND e.pw = a.pw
  UNION ALL
  SELECT sweep + 1, pw, source, lang, topic, tokens, g_source, g_lang, g_topic, {_STEP.format('w2', 'topic')} AS w FROM (
    SELECT *, {_STEP.format('w1', 'lang')} AS w2 FROM (SELECT *, {_STEP.format('w', 'source')} AS w1 FROM fit WHERE sweep < {SWEEPS}))),
done AS (SELECT *, least(tokens, w) AS got FROM fit WHERE sweep = {SWEEPS}),
near AS (SELECT *, {', '.join(f'sum(got) OVER (PARTITION BY pw, {d}) AS s_{d}' for d in DIMS)} FROM done),
best AS (SELECT min(pw) AS pw FROM (SELECT pw FROM near GROUP BY pw HAVING greatest({', '.join(_ERROR.format(d) for d in DIMS)}) <= {TOLERANCE})),
p AS (SELECT source, lang, topic, got / tokens AS p FROM done WHERE pw = (SELECT pw FROM best))
SELECT doc_id, source, lang, topic, CAST(d.tokens AS BIGINT) AS tokens, round(coalesce(p, 0.0), 6) AS p, u < coalesce(p, 0.0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)
"""
