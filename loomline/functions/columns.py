"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.plans.params import Params

STATE_RUNNING, STATE_STOPPED = 6, 10


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def within(column: str, p: Params) -> Column:
    """column in the closed range of p; a bare comparison, so that it reaches the scan."""
    return F.col(column).between(ntz(p.t0), ntz(p.t1))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE, NULL where whole is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def rounded(value: Column, digits: int = 1) -> Column:
    """A DOUBLE at so many digits as DuckDB rounds it: scaled first, so that a tie which the division left an ulp low goes up."""
    return F.round(value * 10.0**digits) / 10.0**digits


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return rounded(ratio(part, whole) * 100, digits)


def total(value: Column) -> Column:
    """Sum of a DOUBLE, the same in whatever order rows come: exact if all values have at most 9 decimals, else a plain sum."""
    exact = value.try_cast("decimal(28,9)")
    same = F.count(F.when(exact.cast("double") == value, 1)) == F.count(value)
    return F.when(same, F.sum(exact).cast("double")).otherwise(F.sum(value))


def bucket(column: str, step: str, offset: str | None = None) -> Column:
    """Start of the epoch-aligned bucket; weekly steps need offset '4 days' to start on Mondays."""
    return (F.window(column, step, step, offset) if offset else F.window(column, step))["start"]


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def minutes_open(start: Column, p: Params) -> Column:
    return F.round(seconds_between(start, ntz(p.as_of)) / F.lit(60.0))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1)).cast("long")


def newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order: Spark keeps n rows a task, not a sorted table."""
    return df.orderBy(*order).limit(n)


def last_by(value: str, *order: str) -> Column:
    """The last non-null value in the order given; rows where it is null don't compete."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))


def uncategorised() -> Column:
    return F.col("cd_category").isNull() | (F.col("cd_category") == "")


def not_forced() -> Column:
    return ~F.coalesce(F.col("forced_creation_system"), F.lit(False))
