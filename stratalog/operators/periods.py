"""Comparing consecutive periods, two chosen periods, and a series with the dates it should have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dated_counts(df: DataFrame, keys: Sequence[str], date: str, id_column: str) -> DataFrame:
    """keys, date, n, only: how many rows a key has at a date and the id if there is exactly one. Undated rows are ignored."""
    rows = df.where(F.col(date).isNotNull()).groupBy(*keys, date).agg(F.count(F.lit(1)).alias("n"), F.min(id_column).alias("__id"))
    return rows.select(*keys, date, "n", F.when(F.col("n") == 1, F.col("__id")).alias("only"))


def consecutive_pairs(df: DataFrame, keys: Sequence[str], date: str, id_column: str) -> DataFrame:
    """keys, earlier_date, later_date, earlier_id, later_id of neighbouring dates that both have exactly one row.

    A date with several rows pairs with nothing, and keeps the dates around it from pairing with each other. Rows are counted per key and
    date with a map-side combine before the window, which so sees one row per date of a key.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    following = dated_counts(df, keys, date, id_column).select(*keys, date, "only", F.lead(date).over(w).alias("later_date"), F.lead("only").over(w).alias("later_id"))
    return following.where("only is not null and later_id is not null").select(*keys, F.col(date).alias("earlier_date"), "later_date", F.col("only").alias("earlier_id"), "later_id")


def with_both_sides(pairs: DataFrame, df: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """pairs with the columns of both rows, as e_<column> and l_<column>."""
    for side, prefix in (("earlier_id", "e_"), ("later_id", "l_")):
        rows = df.select(F.col(id_column).alias(side), *[F.col(c).alias(prefix + c) for c in columns])
        pairs = pairs.join(rows, side)
    return pairs


def comparable(earlier: Column, later: Column, earlier_unit: Column | None = None, later_unit: Column | None = None) -> Column:
    """COMPARABLE if both values are known and, where units are given, both units are known and equal; else INSUFFICIENT_DATA."""
    ok = earlier.isNotNull() & later.isNotNull()
    if earlier_unit is not None:
        ok = ok & earlier_unit.isNotNull() & (earlier_unit == later_unit)
    return F.when(F.coalesce(ok, F.lit(False)), "COMPARABLE").otherwise("INSUFFICIENT_DATA")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a DECIMAL with six digits, rounded half up once; null for a zero or unknown divisor."""
    wide = "decimal(38,8)"  # the quotient of two of these has six digits, so nothing is rounded before
    return F.try_divide(a.cast(wide), b.cast(wide))


def percent_change(earlier: Column, later: Column) -> Column:
    """The change in percent of the earlier value, as a DECIMAL with six digits; null if that is zero or unknown. Values have at most 19 digits before the point."""
    a, b = earlier.cast("decimal(27,8)"), later.cast("decimal(27,8)")
    return ratio((b - a) * F.lit(100).cast("decimal(3,0)"), a)


def period_changes(df: DataFrame, keys: Sequence[str], date: str, id_column: str, value: str, earlier, later) -> DataFrame:
    """keys, change, earlier_id, later_id: NEW, NO_LONGER, CHANGED or UNCHANGED between two dates; AMBIGUOUS where a date has several rows.

    Absence is not an exit and presence not an entry: they only say what each date lists. One scan, one aggregation.
    """
    at = lambda day, x: F.when(F.col(date) == F.lit(day), x)
    both = df.where(F.col(date).isin(earlier, later)).groupBy(*keys).agg(
        *[f.alias(f"{n}{i}") for i, day in ((0, earlier), (1, later)) for n, f in (("n", F.count(at(day, F.lit(1)))), ("id", F.min(at(day, F.col(id_column)))), ("v", F.min(at(day, F.col(value)))))]
    )
    change = (
        F.when((F.col("n0") > 1) | (F.col("n1") > 1), "AMBIGUOUS")
        .when(F.col("n0") == 0, "NEW")
        .when(F.col("n1") == 0, "NO_LONGER")
        .when(F.col("v0").eqNullSafe(F.col("v1")), "UNCHANGED")
        .otherwise("CHANGED")
    )
    clear = change != "AMBIGUOUS"
    return both.select(*keys, change.alias("change"), F.when(clear, F.col("id0")).alias("earlier_id"), F.when(clear, F.col("id1")).alias("later_id"))


def first_observed(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """All rows of a key at its earliest date; ties are kept, undated rows never count."""
    first = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(date).alias("__first"))
    same = F.col(date) == F.col("__first")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(first, same, "left_semi")


def month_end(date: Column, months: int | Column = 0) -> Column:
    return F.last_day(F.add_months(date, months))


def quarter_gaps(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """keys, missing: month-ends every three months from the first to the last observed month that no row has (by month)."""
    seen = df.where(F.col(date).isNotNull()).groupBy(*keys).agg(F.array_distinct(F.collect_set(month_end(F.col(date)))).alias("seen"))
    first, last = F.array_min("seen"), F.array_max("seen")
    steps = F.sequence(F.lit(0), F.floor(F.months_between(last, first) / 3).cast("int"))
    expected = F.transform(steps, lambda i: month_end(first, i * 3))
    return seen.select(*keys, F.explode(F.array_except(expected, F.col("seen"))).alias("missing"))


def date_uniqueness(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """keys, n_rows, n_dates, is_unique: whether a series has one row per date."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(date).alias("n_dates"))
    return counted.withColumn("is_unique", F.col("n_rows") == F.col("n_dates"))
