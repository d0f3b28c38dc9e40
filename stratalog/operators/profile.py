"""Profiles of columns and tables: exact, in one pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, least, median, greatest: the exact upper median (the value at place floor(n / 2), counted from 0). Nulls do not count.

    Values are counted per key and value first, and the running count finds the place, so no list of a group's values is made; a group that
    holds most of the table is still reduced to its different values before the window.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(value)
    upto = counted.withColumn("__upto", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    totals = counted.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum("__n").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    place = F.floor(F.col("n") / 2)
    at = upto.join(totals, same).where((F.col("__upto") > place) & (F.col("__upto") - F.col("__n") <= place))
    return at.select(*keys, "n", "least", F.col(value).alias("median"), "greatest")


def class_profile(df: DataFrame, columns: Sequence[str], classify) -> DataFrame:
    """column, class, n: how many cells of each column fall into each class; all columns in one scan."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), classify(F.col(c).cast("string")).alias("class")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column", "class").agg(F.count(F.lit(1)).alias("n"))


def candidate_keys(df: DataFrame, candidates: dict[str, Sequence[str]]) -> DataFrame:
    """candidate, n_rows, n_keys, n_repeated: how well each column set would identify rows (rows with a null part count as rows only)."""
    out = None
    for name, columns in candidates.items():
        groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
        known = F.lit(True)
        for c in columns:
            known = known & F.col(c).isNotNull()
        one = groups.agg(F.sum("n").alias("n_rows"), F.count_if(known).alias("n_keys"), F.count_if(known & (F.col("n") > 1)).alias("n_repeated"))
        one = one.select(F.lit(name).alias("candidate"), F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), "n_keys", "n_repeated")
        out = one if out is None else out.unionByName(one)
    return out


def header_difference(observed: Column, documented: Sequence[str]) -> tuple[Column, Column]:
    """Labels that only the observed header has, and those that only the documentation has, in their order."""
    known = F.array(*[F.lit(x) for x in documented])
    return F.array_except(observed, known), F.array_except(known, observed)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n of keys that several rows share (nulls are equal): a measure, never a merge."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def coverage_percent(expected: DataFrame, received: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """by, n_expected, n_received, percent (2 digits): how many expected keys arrived."""
    got = received.select(F.col(key)).distinct().withColumn("__got", F.lit(1))
    joined = expected.join(got, key, "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n_expected"), F.count("__got").alias("n_received"))
    return joined.withColumn("percent", F.round(F.col("n_received") * 10000.0 / F.col("n_expected")) / 100)


def require_empty(violations: DataFrame, rule: str) -> None:
    """Raise if a check found anything; reads a single row of it."""
    bad = violations.take(1)
    if bad:
        raise ValueError(f"{rule}: {bad[0].asDict()}")
