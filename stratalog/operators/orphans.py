"""References to records that do not exist (anti join over validity periods, split by skew)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.operators.joins import guarded_join
from stratalog.session import BROADCAST_ROWS, cut

#: A key with more than this share of all references is heavy; so there are at most 1 / share heavy keys.
HEAVY_SHARE = 0.001
_FOREVER = "9999-12-31 23:59:59"


def quarter(at: Column) -> Column:
    """2023Q4; null for null."""
    return F.concat(F.year(at).cast("string"), F.lit("Q"), F.quarter(at).cast("string"))


def standing_periods(targets: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Disjoint periods [s, e) in which at least one row of the key stands: __key, s, e.

    A null end stands forever; a row whose end is not after its start never stands. Overlaps are merged inside
    (key, month of start) first, so that the second merge over a hot key sees merged periods only.
    """
    at = targets.where(F.col(key).isNotNull() & F.col(start).isNotNull()).select(
        F.col(key).alias("__key"), F.col(start).cast("timestamp").alias("s"), F.coalesce(F.col(end).cast("timestamp"), F.lit(_FOREVER).cast("timestamp")).alias("e")
    )

    def merged(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("s", "e")
        reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
        opens = (reach.isNull() | (F.col("s") > reach)).cast("long")
        grouped = rows.withColumn("opens", opens).withColumn("part", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return grouped.groupBy(*by, "part").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("part")

    months = merged(at.where("e > s").groupBy("__key", "s").agg(F.max("e").alias("e")).withColumn("m", F.date_trunc("month", "s")), ["__key", "m"]).drop("m")
    return merged(months, ["__key"])


def orphan_references(
    references: DataFrame,
    targets: DataFrame,
    key: str,
    at: str,
    target_start: str,
    target_end: str,
    broadcast_rows: int = BROADCAST_ROWS,
    heavy_share: float = HEAVY_SHARE,
) -> DataFrame:
    """The rows of references to whose key no row of targets stood at their time, with `reason`.

    missing: targets never has the key; late: all its rows start after the reference; deleted: otherwise.
    References with a null key refer to nothing and are never orphans. A reference without a time is judged by its
    key alone (missing or no orphan). Empty targets make every reference missing; repeated rows stay repeated.
    Both tables need the same name and type of `key`; further columns of references are kept, those of targets ignored.

    Split by skew: references are pre-aggregated per key and period with a map-side combine, which gives the heavy
    keys (at most 1 / heavy_share of them by construction). Their references meet the broadcast periods of these
    keys after a count of them, or salted copies beyond broadcast_rows, and are never shuffled by key. All others
    meet their key's periods in a shuffled anti join. Both parts give the orphans.
    """
    r = references.withColumn("__key", F.col(key)).withColumn("__at", F.col(at).cast("timestamp")).where("__key is not null")
    totals = r.groupBy("__key", quarter(F.col("__at")).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    per_key = cut(totals.groupBy("__key").agg(F.sum("n").alias("n")), "per_key")
    n_references = per_key.agg(F.sum("n")).first()[0] or 0
    heavy = cut(per_key.where(F.col("n") > F.lit(max(1.0, n_references * heavy_share))).select("__key"), "heavy")

    periods = standing_periods(targets, key, target_start, target_end).withColumnsRenamed({"s": "__s", "e": "__e"})
    known = targets.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(F.col(target_start).cast("timestamp")).alias("__first"))
    stood = (F.col("__at") >= F.col("__s")) & (F.col("__at") < F.col("__e")) | F.col("__at").isNull()

    def reasoned(rows: DataFrame) -> DataFrame:
        return rows.withColumn("reason", F.when(F.col("__known").isNull(), "missing").when(F.col("__first") > F.col("__at"), "late").otherwise("deleted"))

    def judged(rows: DataFrame, hot: bool) -> DataFrame:
        own = known.withColumn("__known", F.lit(True))
        if hot:
            own = own.join(F.broadcast(heavy), "__key", "left_semi")
            spans = periods.join(F.broadcast(heavy), "__key", "left_semi")
            left = guarded_join(rows, spans, ["__key"], "left_anti", broadcast_rows, extra=stood)
            left = left.join(F.broadcast(own), "__key", "left")
        else:
            spans = periods.withColumnRenamed("__key", "__k")
            left = rows.join(spans, (F.col("__key") == F.col("__k")) & stood, "left_anti").join(own, "__key", "left")
        return reasoned(left).where(F.col("__at").isNotNull() | (F.col("reason") == "missing"))

    cold_rows = r.join(F.broadcast(heavy), "__key", "left_anti")
    hot_rows = r.join(F.broadcast(heavy), "__key", "left_semi")
    both = judged(cold_rows, False) if heavy.isEmpty() else judged(hot_rows, True).unionByName(judged(cold_rows, False))
    return both.select(*references.columns, "reason")


def orphan_report(references: DataFrame, orphans: DataFrame, by: list[str]) -> DataFrame:
    """Per group of `by`: references, orphans of each reason. Groups without orphans are listed with zeros."""
    counted = orphans.groupBy(*by).agg(*[F.count(F.when(F.col("reason") == x, 1)).alias(x) for x in ("missing", "late", "deleted")])
    totals = references.groupBy(*by).agg(F.count(F.lit(1)).alias("n_refs"))
    condition = None
    right = counted.select(*[F.col(c).alias(f"__{c}") for c in by], "missing", "late", "deleted")
    for c in by:
        same = totals[c].eqNullSafe(right[f"__{c}"])
        condition = same if condition is None else condition & same
    return totals.join(right, condition, "left").select(*by, "n_refs", *[F.coalesce(F.col(x), F.lit(0)).alias(f"n_{x}") for x in ("missing", "late", "deleted")])


__all__ = ["orphan_references", "orphan_report", "quarter", "standing_periods"]
