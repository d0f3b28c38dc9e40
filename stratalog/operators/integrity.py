"""Integrity rules as queries: each returns the rows that break it, and a writer appends only when all are empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.cells import cell


def missing_parents(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose known reference has no parent."""
    return df.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias("__p")).distinct(), F.col(column) == F.col("__p"), "left_anti")


def without_children(df: DataFrame, key: str, children: DataFrame, column: str, condition: Column | None = None) -> DataFrame:
    """Rows that need a child and have none."""
    found = children if condition is None else children.where(condition)
    return df.join(found.select(F.col(column).alias("__c")).distinct(), F.col(key) == F.col("__c"), "left_anti")


def repeated_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bad_rows(rows: DataFrame, delimiter: str = "\t") -> DataFrame:
    """Landed rows (line, line_sha256, cells, header, status) whose hash, cells or status do not follow from the line, with the rule."""
    rules = (
        ("HASH", ~F.col("line_sha256").eqNullSafe(F.sha2("line", 256))),
        ("SPLIT", ~F.col("cells").eqNullSafe(F.split("line", delimiter, -1))),
        ("WIDTH", (F.col("status") == "OK") != (F.size("cells") == F.size("header"))),
    )
    return rows.select(*rows.columns, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules]))).alias("rule"))


def not_as_in_source(observations: DataFrame, rows: DataFrame, row_key: str, columns: dict[str, str]) -> DataFrame:
    """Observations of which a column (name: source label) is not the text of its source cell, or whose source row is not there."""
    source = rows.select(F.col(row_key).alias("__r"), "cells", "header")
    joined = observations.join(source, F.col(row_key) == F.col("__r"), "left")
    wrong = F.col("__r").isNull()
    for name, label in columns.items():
        wrong = wrong | ~F.col(name).cast("string").eqNullSafe(cell(F.col("cells"), F.col("header"), label))
    return joined.where(wrong).select(*observations.columns)


def gaps_in_batches(batches: DataFrame, run: str, index: str, first: str, last: str) -> DataFrame:
    """Batches of a run whose index does not follow the one before, or whose range overlaps it. A run has few batches, one row each."""
    from pyspark.sql import Window

    w = Window.partitionBy(run).orderBy(index)
    before, reach = F.lag(index).over(w), F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return batches.withColumn("__b", before).withColumn("__l", reach).where((F.col(index) != F.coalesce(F.col("__b") + 1, F.lit(1))) | (F.col(first) <= F.col("__l")) | (F.col(first) > F.col(last))).drop("__b", "__l")


def cyclic(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Nodes that approved edges lead round and round."""
    from stratalog.operators.matching import canonical

    return canonical(edges, source, target).where("is_cyclic").select("node")


def changed_lineage(artifacts: DataFrame, url: str, sha: str, at: str, previous: str, id_column: str) -> DataFrame:
    """Artifacts whose predecessor has another URL, the same bytes, or a retrieval that is not earlier."""
    before = artifacts.select(F.col(id_column).alias("__id"), F.col(url).alias("__url"), F.col(sha).alias("__sha"), F.col(at).alias("__at"))
    joined = artifacts.where(F.col(previous).isNotNull()).join(before, F.col(previous) == F.col("__id"), "left")
    ok = (F.col(url) == F.col("__url")) & (F.col(sha) != F.col("__sha")) & (F.col(at) > F.col("__at"))
    return joined.where(~F.coalesce(ok, F.lit(False))).select(*artifacts.columns)
