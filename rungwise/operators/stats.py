"""Aggregates, rank statistics, resampling and leave-one-out over ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and linearly interpolated quantiles of a group."""
    q = lambda p: F.round(F.percentile(value, p), 6)
    return df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


def block_cv(df: DataFrame, by: str, block: str, value: str) -> DataFrame:
    """Coefficient of variation of block means in a group, and whether it passes .05 and .10."""
    means = df.groupBy(by, block).agg(F.avg(value).alias("m"))
    cv = F.stddev_samp("m") / F.avg("m")
    return means.groupBy(by).agg(F.round(cv, 6).alias("cv"), (cv <= 0.05).alias("tight"), (cv <= 0.10).alias("loose"))


def gain_of_sums(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """1 - sum(a) / sum(b): a ratio of sums, not a mean of ratios."""
    return df.groupBy(by).agg(F.round(1 - F.sum(a) / F.sum(b), 6).alias("gain"))


def leave_one_out_means(df: DataFrame, group: str, value: str) -> DataFrame:
    """For each group the mean of the other groups' means; totals less the part, so no pairs."""
    means = df.groupBy(group).agg(F.avg(value).alias("m"))
    whole = means.agg(F.sum("m").alias("all"), F.count("*").alias("groups"))
    return means.crossJoin(F.broadcast(whole)).select(group, F.round((F.col("all") - F.col("m")) / (F.col("groups") - 1), 6).alias("loo_mean"))  # one row


def trimmed_mean(df: DataFrame, by: str, value: str, share: float = 0.01) -> DataFrame:
    """Mean without the ceil(share * n) largest values of a group; rows are summed to distinct values before they are ordered."""
    values = df.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    sizes = values.groupBy(by).agg(F.sum("c").alias("n"))
    above = F.sum("c").over(Window.partitionBy(by).orderBy(F.desc("v"))) - F.col("c")
    cut = F.ceil(F.col("n") * share)
    left = values.withColumn("above", above).join(F.broadcast(sizes), by).withColumn("kept", F.greatest(F.lit(0), F.least(F.col("c"), F.col("above") + F.col("c") - cut)))  # a row a group
    return left.groupBy(by).agg(F.sum("kept").alias("n"), F.round(F.sum(F.col("v") * F.col("kept")) / F.sum("kept"), 6).alias("trimmed_mean"))


def spearman(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Correlation of average ranks; ranks are of distinct values with their counts, and so are the sums."""
    cells = df.groupBy(by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").cast("double").alias("n"))

    def ranks(c: str) -> DataFrame:
        counted = cells.groupBy(by, c).agg(F.sum("n").alias("m"))
        return counted.select(by, c, (F.sum("m").over(Window.partitionBy(by).orderBy(c)) - F.col("m") / 2 + 0.5).alias(f"r{c}"))

    placed = cells.join(ranks("x"), [by, "x"]).join(ranks("y"), [by, "y"])
    a, b, n = F.col("rx"), F.col("ry"), F.col("n")
    sums = placed.groupBy(by).agg(F.sum(n).alias("n"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"), F.sum(n * a * b).alias("ab"))
    part = lambda p, q, r: F.col(p) - F.col(q) * F.col(r) / F.col("n")
    return sums.select(by, F.round(F.try_divide(part("ab", "a", "b"), F.sqrt(part("aa", "a", "a") * part("bb", "b", "b"))), 6).alias("spearman"))


def kendall(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Tau-b, and the inversion rate (1 - tau) / 2, from counts of distinct value pairs.

    Rows are summed to (x, y) counts first, so pairs are formed between distinct values only.
    """
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").cast("double").alias("n"))
    a, b = cells.alias("a"), cells.alias("b")
    sign = F.signum((F.col("a.x") - F.col("b.x")).cast("double")) * F.signum((F.col("a.y") - F.col("b.y")).cast("double"))
    s = a.join(b, by).groupBy(by).agg((F.sum(sign * F.col("a.n") * F.col("b.n")) / 2).alias("s"))
    pairs = cells.groupBy(by).agg(F.sum("n").alias("t"))
    tie = lambda c: cells.groupBy(by, c).agg(F.sum("n").alias("m")).groupBy(by).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias(f"t{c}"))
    all_ = s.join(pairs, by).join(tie("x"), by).join(tie("y"), by)
    n0 = F.col("t") * (F.col("t") - 1) / 2
    tau = F.try_divide(F.col("s"), F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty"))))
    return all_.select(by, F.round(tau, 6).alias("tau"), F.round((1 - tau) / 2, 6).alias("inversion"))
