"""Append-only chains: a correction is a new row that points back at the row it supersedes.

No row is ever changed, so "current" is an anti join and every check is a query that must come back empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.session import cut


def current_heads(df: DataFrame, id_column: str = "id", supersedes: str = "supersedes_id") -> DataFrame:
    """Rows that no row supersedes. Null ids are heads of their own; repeated successors change nothing."""
    gone = df.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("__gone")).distinct()
    return df.join(gone, F.col(id_column) == F.col("__gone"), "left_anti")


def supersession_violations(df: DataFrame, subject: Sequence[str], id_column: str = "id", supersedes: str = "supersedes_id", single_chain: bool = True) -> DataFrame:
    """id and violation of rows that break the chain rules; one row per broken rule.

    SELF: supersedes itself. DANGLING: supersedes no known row. SUBJECT: its predecessor has another subject (null equals
    null). FORK: shares its predecessor with another row. SECOND_ROOT (single_chain only): one of several rows of a subject without predecessor.
    """
    s = [f"__s{i}" for i in range(len(subject))]
    rows = df.select(F.col(id_column).alias("__id"), F.col(supersedes).alias("__sup"), *[F.col(c).alias(x) for c, x in zip(subject, s)])
    before = rows.select(F.col("__id").alias("__before"), *[F.col(x).alias("p" + x) for x in s])
    linked = rows.where("__sup is not null").join(before, F.col("__sup") == F.col("__before"), "left")
    other = ~F.lit(True)
    for x in s:
        other = other | ~F.col(x).eqNullSafe(F.col("p" + x))
    tell = lambda part, name: part.select(F.col("__id").alias("id"), F.lit(name).alias("violation"))
    forks = rows.where("__sup is not null").groupBy("__sup").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__sup")
    found = tell(rows.where("__sup = __id"), "SELF")
    found = found.unionByName(tell(linked.where("__before is null"), "DANGLING"))
    found = found.unionByName(tell(linked.where(F.col("__before").isNotNull() & other), "SUBJECT"))
    found = found.unionByName(tell(rows.join(forks, "__sup", "left_semi"), "FORK"))
    if single_chain:
        roots = rows.where("__sup is null")
        several = roots.groupBy(*s).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(x).alias("q" + x) for x in s])
        same = F.lit(True)
        for x in s:
            same = same & F.col(x).eqNullSafe(F.col("q" + x))
        found = found.unionByName(tell(roots.join(several, same, "left_semi"), "SECOND_ROOT"))
    return found


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest order columns (nulls lowest; ties by the remaining columns, so it is stable).

    An aggregate with map-side combine rather than a window, so one key may hold any share of the rows.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*[c if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns])


def chain_heads(df: DataFrame, id_column: str = "id", supersedes: str = "supersedes_id", depth: int = 1 << 20) -> DataFrame:
    """root, head, length of every chain; a forked chain has several heads. Known steps double each round, so depth costs log2(depth) joins.

    Chains longer than depth raise, as do cycles that a root leads into; rows on a cycle without a root have no chain.
    """
    step = df.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("node"), F.col(id_column).alias("goal")).distinct()
    ends = df.select(F.col(id_column).alias("node")).distinct().join(step.select("node").distinct(), "node", "left_anti")
    roots = df.where(F.col(supersedes).isNull()).select(F.col(id_column).alias("node")).distinct()
    reach = step.select("node", "goal", F.lit(1).cast("long").alias("steps")).unionByName(ends.select("node", F.col("node").alias("goal"), F.lit(0).cast("long").alias("steps")))
    span = 1
    while True:
        reach = cut(reach, "reach")
        open_roots = reach.join(roots, "node", "left_semi").join(step.select(F.col("node").alias("goal")).distinct(), "goal", "left_semi")
        if open_roots.isEmpty():
            return reach.join(roots, "node", "left_semi").select(F.col("node").alias("root"), F.col("goal").alias("head"), (F.col("steps") + 1).alias("length"))
        if span > depth:
            raise ValueError(f"a chain is longer than {depth} rows or leads into a cycle")
        further = reach.select(F.col("node").alias("goal"), F.col("goal").alias("__goal"), F.col("steps").alias("__steps"))
        reach = reach.join(further, "goal").select("node", F.col("__goal").alias("goal"), (F.col("steps") + F.col("__steps")).alias("steps")).distinct()
        span *= 2


def chain_ends(df: DataFrame, id_column: str = "id", supersedes: str = "supersedes_id", depth: int = 1 << 20) -> DataFrame:
    """id, head: the row that ends the chain each row stands in (itself for a head); rows of a forked chain have several.

    Known steps double each round until nothing moves. Rows on a cycle, or in front of a chain of more than depth rows, raise.
    """
    step = df.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(id_column), F.col(id_column).alias("head")).distinct()
    reach = cut(df.select(id_column).distinct().join(step, id_column, "left").select(id_column, F.coalesce("head", id_column).alias("head")), "ends")
    span = 1
    while True:
        if reach.join(step.select(F.col(id_column).alias("head")).distinct(), "head", "left_semi").isEmpty():
            return reach
        if span > depth:
            raise ValueError(f"a chain is longer than {depth} rows or leads into a cycle")
        further = reach.select(F.col(id_column).alias("head"), F.col("head").alias("__head"))
        reach = cut(reach.join(further, "head").select(id_column, F.col("__head").alias("head")).distinct(), "ends")
        span *= 2


def insert_absent(source: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of source to append: the first by order of each key that existing lacks. Null keys are never inserted."""
    known = existing.select(*keys).distinct()
    new = source.na.drop(subset=list(keys)).join(known, list(keys), "left_anti")
    rest = [c for c in new.columns if c not in keys and c not in order]
    return new.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__first")).select(*[c if c in keys else F.col(f"__first.{c}").alias(c) for c in source.columns])


def upsert_stream(source: DataFrame, heads: DataFrame, subject: Sequence[str], values: Sequence[str], id_column: str = "id") -> DataFrame:
    """What to append so that the heads of one stream say what source says: subject, values, supersedes_id, action.

    Per subject: facts both sides have are unchanged and not returned; one new fact against one head that went away
    SUPERSEDES that head; other new facts are ADDED beside the heads. Heads that source lacks are ABSENT: they are told, with their
    id, and stay. Facts are compared null-safe; repeats in source count once.
    """
    k, v = list(subject), list(values)
    new = source.select(*k, *v).distinct()
    same = None
    old = heads.select(*[F.col(c).alias("h_" + c) for c in (*k, *v)], F.col(id_column).alias("h_id"))
    for c in (*k, *v):
        this = F.col(c).eqNullSafe(F.col("h_" + c))
        same = this if same is None else same & this
    fresh = new.join(old, same, "left_anti")
    stale = old.join(new, same, "left_anti").select(*[F.col("h_" + c).alias(c) for c in (*k, *v)], "h_id")
    fresh_n = fresh.groupBy(*k).agg(F.count(F.lit(1)).alias("n_new"))
    stale_n = stale.groupBy(*k).agg(F.count(F.lit(1)).alias("n_old"), F.min("h_id").alias("only_old"))
    by = lambda left, right: _null_safe_left(left, right, k)
    added = by(by(fresh, fresh_n), stale_n)
    one = (F.col("n_new") == 1) & (F.col("n_old") == 1)
    added = added.select(*k, *v, F.when(one, F.col("only_old")).alias("supersedes_id"), F.when(one, "SUPERSEDES").otherwise("ADDED").alias("action"))
    absent = by(by(stale, fresh_n), stale_n).where(~F.coalesce(one, F.lit(False))).select(*k, *v, F.col("h_id").alias("supersedes_id"), F.lit("ABSENT").alias("action"))
    return added.unionByName(absent)


def _null_safe_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in right.columns])
    same = None
    for c in keys:
        this = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        same = this if same is None else same & this
    return left.join(renamed, same, "left").drop(*[f"__k_{c}" for c in keys])


def previous_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], id_column: str, name: str = "supersedes_id") -> DataFrame:
    """df with the id of the row before it in its group; for logs whose rows do not name their predecessor."""
    return df.withColumn(name, F.lag(id_column).over(Window.partitionBy(*group).orderBy(*order)))
