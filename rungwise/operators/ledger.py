"""Break-even arithmetic, cost curves, exact-answer cache and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Digits of amounts; rounds are counted in decimals, where 0.3 / 0.1 is 3.
MONEY = "decimal(30,9)"


def _whole_quotient(a: Column, b: Column) -> tuple[Column, Column]:
    """(floor, ceiling) of a / b in decimals, b not 0: the remainder, not a rounded quotient, decides."""
    a, b = a.cast(MONEY), b.cast(MONEY)
    toward_zero = F.call_function("div", a, b)
    exact, negative = a % b == 0, (F.signum(a) * F.signum(b)) < 0
    return F.when(exact | ~negative, toward_zero).otherwise(toward_zero - 1), F.when(exact | negative, toward_zero).otherwise(toward_zero + 1)


def first_round(upfront: Column, saving: Column) -> Column:
    """The first round, 1 at least, whose total is strictly below: floor(B / D) + 1; equality isn't repaid yet.

    1 as well if nothing is saved and less than nothing was paid; NULL if it is never repaid, or only for some
    first rounds, which :func:`initial_region` says.
    """
    b, d = upfront.cast(MONEY), saving.cast(MONEY)
    low, _ = _whole_quotient(b, d)
    return F.when(d > 0, F.greatest(F.lit(1), low + 1)).when((b < 0) & (d == 0), F.lit(1)).cast("long")


def initial_region(upfront: Column, saving: Column) -> Column:
    """Whether an early advantage lasts for a finite number of rounds only."""
    b, d = upfront.cast(MONEY), saving.cast(MONEY)
    return (b < 0) & (d < 0) & (b < d)


def last_initial_round(upfront: Column, saving: Column) -> Column:
    """The last round of an early advantage that later losses eat up; NULL where there is none."""
    b, d = upfront.cast(MONEY), saving.cast(MONEY)
    _, high = _whole_quotient(b, d)
    return F.when((b < 0) & (d < 0) & (high >= 2), high - 1).cast("long")


def contrast(upfront: Column, saving: Column, requests: int, overhead: float = 100.0) -> dict[str, Column]:
    """What a policy costs against another: B, D, the first round's balance, rounds, and the overhead a request may have."""
    return {
        "upfront": upfront,
        "saving": saving,
        "first_round_net": upfront - saving,
        "strict_round": first_round(upfront, saving),
        "initial_only": initial_region(upfront, saving),
        "last_initial_round": last_initial_round(upfront, saving),
        "nonpositive_saving": saving <= 0,
        "overhead_per_request": F.when(saving > 0, saving / requests),
        "strict_round_with_overhead": first_round(upfront.cast(MONEY) + F.lit(overhead).cast(MONEY), saving),
    }


def curves(ledger: DataFrame, rounds: list[int]) -> DataFrame:
    """ledger rows x rounds: what is still to be repaid after each."""
    each = ledger.withColumn("round", F.explode(F.array(*[F.lit(r) for r in rounds])))
    return each.withColumn("remaining", F.col("upfront") - F.col("round") * F.col("saving"))


def cache_lookup(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with the cached value: a hit only if the whole key is equal, bit for bit."""
    return requests.join(cache, "key", "left").withColumn("hit", F.col("value").isNotNull())


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_cells(df: DataFrame, axes: list[DataFrame]) -> DataFrame:
    """Cells of the full grid that have no row; the axes are the small tables of a design."""
    grid = axes[0]
    for a in axes[1:]:
        grid = grid.crossJoin(a)
    return grid.join(df, grid.columns, "left_anti")


def differences(expected: DataFrame, actual: DataFrame, keys: list[str], relative: float = 1e-10, absolute: float = 1e-9) -> DataFrame:
    """Rows that differ: absent on a side, unequal, or numbers apart; a missing value is never zero."""
    values = [c for c in expected.columns if c not in keys]
    e = expected.select(*keys, *[F.col(c).alias(f"e_{c}") for c in values], F.lit(True).alias("in_e"))
    a = actual.select(*keys, *[F.col(c).alias(f"a_{c}") for c in values], F.lit(True).alias("in_a"))
    bad = F.col("in_e").isNull() | F.col("in_a").isNull()
    types = dict(expected.dtypes)
    for c in values:
        x, y = F.col(f"e_{c}"), F.col(f"a_{c}")
        if types[c] in ("double", "float"):
            near = F.abs(x - y) <= F.greatest(F.lit(relative) * F.greatest(F.abs(x), F.abs(y)), F.lit(absolute))
            bad = bad | (x.isNull() != y.isNull()) | ~F.coalesce(near, F.lit(True))
        else:
            bad = bad | ~x.eqNullSafe(y)
    return e.join(a, keys, "full").filter(bad)
