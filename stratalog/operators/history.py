"""History of changing attributes, built from snapshots (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def attribute_history(
    df: DataFrame,
    keys: list[str],
    values: list[str],
    as_of: str,
    recency: list[str],
    open_end: str = "9999-12-31",
) -> DataFrame:
    """All versions of each key's values with the period each was valid: keys, values, valid_from, valid_to.

    Several rows of one key and as_of: the one with the greatest recency counts (nulls lowest, then the greatest
    values, so exact repeats and full ties change nothing). In order of as_of a row that equals its predecessor
    continues the version, another ends it and starts one; a row whose values are all null ends it and starts none.
    valid_to is the as_of of the ending row, or open_end. Comparison is exact.

    Rows without as_of are ignored; null keys form a key of their own; an empty table gives no rows; other
    columns are ignored, whatever their names.

    Skew: the rows of a key are first reduced to one per as_of with a map-side combine, so for a DATE the window
    over one key sees at most one row per calendar day, however many rows the key has. For finer as_of types the
    runs are first collapsed inside (key, month), which leaves the changes and one row per month.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    v = [f"__v{i}" for i in range(len(values))]
    ranked = F.struct(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(recency)], *[F.col(f"`{c}`").alias(x) for c, x in zip(values, v)])
    latest = (
        df.where(F.col(f"`{as_of}`").isNotNull())
        .groupBy(*[F.col(f"`{c}`").alias(x) for c, x in zip(keys, k)], F.col(f"`{as_of}`").alias("__at"))
        .agg(F.max(ranked).alias("__latest"))
        .select(*k, "__at", *[F.col(f"__latest.{x}").alias(x) for x in v])
        .withColumn("__hash", F.xxhash64(*v))
    )

    def marked(rows: DataFrame, by: list[str]) -> DataFrame:
        """__changed: the row is the first of by, or differs from the row before it; the hash is compared first."""
        w = Window.partitionBy(*by).orderBy("__at")
        same = F.lag("__hash").over(w).eqNullSafe(F.col("__hash"))
        for x in v:
            same = same & F.lag(x).over(w).eqNullSafe(F.col(x))
        return rows.withColumn("__changed", ~same | (F.row_number().over(w) == 1))

    if not isinstance(df.schema[as_of].dataType, T.DateType):
        latest = marked(latest.withColumn("__month", F.date_trunc("month", "__at")), [*k, "__month"]).where("__changed").drop("__month", "__changed")

    w = Window.partitionBy(*k).orderBy("__at")
    islands = (
        marked(latest, k)
        .withColumn("__island", F.sum(F.col("__changed").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*k, "__island")
        .agg(F.min("__at").alias("__from"), *[F.first(x).alias(x) for x in v])
    )
    ends = F.lead("__from").over(Window.partitionBy(*k).orderBy("__from")).cast("string")
    known = F.coalesce(*[F.col(x).cast("string") for x in v]).isNotNull()
    return (
        islands.withColumn("__to", F.coalesce(ends, F.lit(open_end)))
        .where(known)
        .select(
            *[F.col(x).alias(c) for c, x in zip(keys, k)],
            *[F.col(x).alias(c) for c, x in zip(values, v)],
            F.col("__from").cast("string").alias("valid_from"),
            F.col("__to").alias("valid_to"),
        )
    )
