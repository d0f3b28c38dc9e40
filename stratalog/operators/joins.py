"""Joins that hold when one key owns a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.session import BROADCAST_ROWS, at_most, cut, once

_SALT = "__salt"
#: A key is hot if more than this share of the rows has it; so there are fewer than 1 / share hot keys.
HOT_SHARE = 0.002


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"__r_{c}" if c in keys else c) for c in df.columns])


def split_join(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", extra=None, hot_share: float = HOT_SHARE) -> DataFrame:
    """Shuffle join of many to few on equal keys in which no key gathers in one task.

    The rows of many are counted per key (map-side combined). Only the hot keys, of which there are fewer than 1 / hot_share whatever the
    data, are salted: each of their rows is numbered into as many parts as the key has shares of hot_share, and the
    rows of few with that key are repeated once per part. All other keys have one part. many is written out before it is numbered, so
    the numbers are the same when a lost task runs again, and equal rows are spread too.
    """
    many = once(many, "many")
    share = max(1, int(many.count() * hot_share))
    per_key = many.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > share).na.drop(subset=on)
    hot = cut(per_key.select(*on, F.ceil(F.col("__n") / share).cast("int").alias("__parts")), "hot")
    if hot.isEmpty():
        keys, right = list(on), few
    else:
        parts = F.coalesce("__parts", F.lit(1))
        many = many.join(F.broadcast(hot), on, "left").withColumn(_SALT, F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("__parts")
        right = few.join(F.broadcast(hot), on, "left").withColumn(_SALT, F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
        keys = [*on, _SALT]
    if extra is None:
        return many.join(right, keys, how).drop(_SALT)
    right, condition = _renamed(right, keys), extra
    for key in keys:
        condition = (many[key] == right[f"__r_{key}"]) & condition
    return many.join(right, condition, how).drop(_SALT, *[f"__r_{key}" for key in keys])


def guarded_join(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", broadcast_rows: int = BROADCAST_ROWS, extra=None) -> DataFrame:
    """Join many to few on equal keys, whichever size few turns out to have.

    few is written out and counted: up to broadcast_rows rows it is broadcast and many is not shuffled; beyond that split_join
    joins by shuffle. extra is a further condition on columns of both sides, which then must not share names besides `on`.
    how: inner, left, left_semi or left_anti (each row of many meets exactly one copy of its matches, so all four are exact).

    Null keys match nothing, as in SQL. An empty few gives no rows (inner, semi) or all (left, anti).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join {how}")
    few = once(few, "few")
    if not at_most(few, broadcast_rows):
        return split_join(many, few, on, how, extra)
    if extra is None:
        return many.join(F.broadcast(few), on, how)
    right, condition = F.broadcast(_renamed(few, on)), extra
    for key in on:
        condition = (many[key] == right[f"__r_{key}"]) & condition
    return many.join(right, condition, how).drop(*[f"__r_{key}" for key in on])
