"""Shapes that readers ask for: searches over aliases, pages, signals, bands and nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.session import BROADCAST_ROWS, at_most, once


def alias_search(df: DataFrame, group: Sequence[str], alias: str, needle: str, counts: dict[str, Column]) -> DataFrame:
    """Groups any of whose aliases holds the needle (case-folded, literally), with the aliases, distinct counts and the label if it is the only one."""
    hit = F.bool_or(F.contains(F.lower(F.col(alias)), F.lit(needle.lower())))
    listed = F.array_sort(F.collect_set(alias))
    out = df.groupBy(*group).agg(hit.alias("__hit"), listed.alias("aliases"), *[F.count_distinct(c).alias(n) for n, c in counts.items()])
    return out.where("__hit").drop("__hit").withColumn("label", F.when(F.size("aliases") == 1, F.col("aliases")[0]))


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int = 50) -> DataFrame:
    """One page, counted from 1. Sizes run from 1 to 50; a greater one is refused rather than cut."""
    if not 1 <= size <= 50 or number < 1:
        raise ValueError("a page has 1 to 50 rows and a number from 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def signals(df: DataFrame, keys: Sequence[str], cases: dict[str, tuple[Column, Column]]) -> DataFrame:
    """keys, signal, value: one row per case (name: condition, value) that holds on a row. One pass, no union."""
    made = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("signal"), v.cast("string").alias("value"))) for n, (c, v) in cases.items()]))
    return df.select(*keys, F.inline(made))


def timeline(*parts: tuple[str, DataFrame]) -> DataFrame:
    """The union of typed events: kind and the columns that all parts share."""
    shared = [c for c in parts[0][1].columns if all(c in p.columns for _, p in parts)]
    out = None
    for kind, part in parts:
        typed = part.select(F.lit(kind).alias("kind"), *shared)
        out = typed if out is None else out.unionByName(typed)
    return out


def bands(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """keys, band, value, n: runs of equal values in order. Null equals null. The rows of a key are sorted in one task; give keys that bound them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    starts = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    numbered = df.withColumn("__s", starts).withColumn("band", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "band").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def documents(df: DataFrame, keys: Sequence[str], nested: Sequence[str], order: Sequence[str], name: str = "items", most: int = 100_000) -> DataFrame:
    """keys, part, parts, json: one JSON document per key with its rows as an ordered array.

    A key with more than `most` rows has several documents, so that no task gathers it: its rows are dealt out by their content into parts of
    about half of `most`, each ordered in itself; together the parts hold every row once.
    """
    body = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*nested).alias("row"))
    sizes = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    sizes = once(sizes, "sizes")
    dealt = df.join(F.broadcast(sizes) if at_most(sizes, BROADCAST_ROWS) else sizes, same, "left")
    parts = F.coalesce(F.ceil(F.col("__n") * 2 / most), F.lit(1)).cast("int")
    dealt = dealt.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(*order, *nested), F.col("parts")).cast("int"))
    gathered = dealt.groupBy(*keys, "part", "parts").agg(F.array_sort(F.collect_list(body)).alias("__rows"))
    rows = F.transform("__rows", lambda r: r["row"])
    return gathered.select(*keys, "part", "parts", F.to_json(F.struct(*keys, rows.alias(name)), {"ignoreNullFields": "false"}).alias("json"))
