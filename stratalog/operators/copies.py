"""Differences between two copies of data, found by hierarchical checksums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.joins import guarded_join
from stratalog.session import BROADCAST_ROWS, cut

#: Bits of the key space; a range of depth d is the set of positions with equal first d bits.
_BITS = 60


def latest_rows(df: DataFrame, key: str, fields: list[str], recency: list[str]) -> DataFrame:
    """One row per key: the one with the greatest recency (nulls lowest; then the greatest fields), combined map-side."""
    ranked = F.struct(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(recency)], *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(fields)])
    rows = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__key")).agg(F.max(ranked).alias("__latest"))
    return rows.select("__key", *[F.col(f"__latest.f{i}").alias(f"f{i}") for i in range(len(fields))])


def copy_differences(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: list[str],
    recency_left: list[str],
    recency_right: list[str],
    left_name: str = "left",
    right_name: str = "right",
    bits_per_round: int = 8,
    leaf_rows: int = 4,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Key, field_name and finding of every difference between two copies that have key and fields in common.

    A key on one side only gives one row: field_name `row`, finding `missing_in_<other side>`. Otherwise each field
    whose values are unequal (null-safe) gives one row with finding `differs`.

    Each side keeps the latest row per key. A key's position is its hash, so that ranges hold even shares whatever
    the keys look like. Checksums (count, xor and sum of row hashes) are made in one scan for the smallest ranges, of about
    leaf_rows rows of a side, and rolled up bits_per_round bits at a time into a tree of which the upper levels together have
    1 / 255 of the lowest one's size. Both sides of the tree are compared from the whole key space down: each round bisects the
    ranges that differ and goes on with their parts only; it ends when none differs. Only rows of the differing leaves are read
    whole, joined and compared field by field. Ranges are rows of tables, never collected.

    Rows with a null key are ignored; repeats collapse; empty sides make every row of the other missing; further
    columns are ignored, whatever their names. Nulls are hashed by their place, so no text equals one. Two different rows are taken for equal only if 64-bit hash sums of
    their whole range coincide in all three checksums.
    """
    names = [f"f{i}" for i in range(len(fields))]
    sides = [latest_rows(left, key, fields, recency_left), latest_rows(right, key, fields, recency_right)]
    # xxhash64 passes nulls over; their places are hashed beside the values.
    nulls = F.concat(*[F.when(F.col(n).isNull(), "0").otherwise("1") for n in names]) if names else F.lit("")
    rows = None
    for number, side in enumerate(sides):
        side = side.select("__key", *[F.col(n).cast("string").alias(n) for n in names])
        hashed = side.select(
            F.lit(number).cast("byte").alias("side"),
            F.shiftrightunsigned(F.xxhash64("__key"), 64 - _BITS).alias("pos"),
            F.xxhash64("__key", nulls, *names).alias("chk"),
            "__key",
            *names,
        )
        rows = hashed if rows is None else rows.unionByName(hashed)
    rows = cut(rows, "copies")
    count = rows.count()
    deepest = max(0, min(_BITS, math.ceil(math.log2(max(1, count / (2 * leaf_rows))))))
    depths = [*range(0, deepest, bits_per_round), deepest]

    # The tree, from the leaves up: one scan of three columns, then each level from the one below.
    own = lambda number, value: F.when(F.col("side") == number, value)
    part = F.pmod(F.col("chk"), F.lit(1 << 31))
    levels = {deepest: cut(rows.groupBy(F.shiftright("pos", _BITS - deepest).alias("range")).agg(
        *[f.alias(f"{name}{n}") for n in (0, 1) for name, f in (("n", F.count(own(n, F.lit(1)))), ("x", F.bit_xor(own(n, F.col("chk")))), ("s", F.sum(own(n, part))))]
    ), "level")}
    for below, depth in zip(depths[::-1], depths[-2::-1]):
        summed = levels[below].groupBy(F.shiftright("range", below - depth).alias("range"))
        levels[depth] = cut(summed.agg(*[f(f"{x}{n}").alias(f"{x}{n}") for n in (0, 1) for x, f in (("n", F.sum), ("x", F.bit_xor), ("s", F.sum))]), "level")

    # Then from the whole down: only the parts of ranges that differ are looked at.
    equal = F.col("n0").eqNullSafe(F.col("n1")) & F.col("x0").eqNullSafe(F.col("x1")) & F.col("s0").eqNullSafe(F.col("s1"))
    suspects = cut(levels[depths[0]].where(~equal).select("range"), "ranges")
    for above, depth in zip(depths, depths[1:]):
        if suspects.isEmpty():
            break
        parts = levels[depth].where(~equal).withColumn("above", F.shiftright("range", depth - above))
        parts = guarded_join(parts, suspects.withColumnRenamed("range", "above"), ["above"], "left_semi", broadcast_rows)
        suspects = cut(parts.select("range"), "ranges")
    leaves = guarded_join(rows.withColumn("range", F.shiftright("pos", _BITS - deepest)), suspects, ["range"], "left_semi", broadcast_rows)
    # A side has one row per key, so both rows of a key meet in one aggregation.
    both = leaves.groupBy("__key").agg(*[
        f.alias(f"{prefix}{name}") for number, prefix in ((0, "l_"), (1, "r_")) for name, f in (("in", F.max(own(number, F.lit(True)))), *[(n, F.max(own(number, F.col(n)))) for n in names])
    ])
    present = F.col("l_in").isNotNull() & F.col("r_in").isNotNull()
    findings = F.array(
        F.when(F.col("l_in").isNull(), F.struct(F.lit("row").alias("field_name"), F.lit(f"missing_in_{left_name}").alias("finding"))),
        F.when(F.col("r_in").isNull(), F.struct(F.lit("row").alias("field_name"), F.lit(f"missing_in_{right_name}").alias("finding"))),
        *[F.when(present & ~F.col("l_" + n).eqNullSafe(F.col("r_" + n)), F.struct(F.lit(field).alias("field_name"), F.lit("differs").alias("finding"))) for field, n in zip(fields, names)],
    )
    return both.select(F.col("__key").alias(key), F.inline(F.array_compact(findings)))
