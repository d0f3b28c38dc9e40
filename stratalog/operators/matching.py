"""Matching that never picks a winner: unique matches bind, everything else is told apart by its reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import text as tx
from stratalog.session import cut


def unique_match(left: DataFrame, right: DataFrame, left_id: str, on: Sequence[str], left_value: str, right_value: str, right_id: str) -> DataFrame:
    """left_id, outcome, matched: BOUND to the one right row with equal keys and value; NO_CANDIDATE, NOT_EQUAL or MULTIPLE otherwise.

    A null value equals nothing. The right side is counted per key and value before the join, so a key with many candidates gives one row.
    """
    l = left.select(left_id, *on, F.col(left_value).alias("__v"))  # noqa: E741
    facts = right.groupBy(*on, F.col(right_value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"), F.min(right_id).alias("__only"))
    any_fact = facts.groupBy(*on).agg(F.lit(True).alias("__any"))
    joined = l.join(any_fact, list(on), "left").join(facts, [*on, "__v"], "left")
    outcome = F.when(F.col("__any").isNull(), "NO_CANDIDATE").when(F.col("__n").isNull(), "NOT_EQUAL").when(F.col("__n") > 1, "MULTIPLE").otherwise("BOUND")
    return joined.select(left_id, outcome.alias("outcome"), F.when(F.col("__n") == 1, F.col("__only")).alias("matched"))


def currency_plan(heads: DataFrame, facts: DataFrame, id_column: str, on: Sequence[str], value: str, unit: str, excluded: str) -> DataFrame:
    """id, outcome, unit: what the facts of one scope (`on`) say about the currency of each amount.

    In this order: NO_FACT, EXCLUDED (all facts of the scope have a forbidden axis), NOT_EQUAL (no usable fact of that value), NO_CURRENCY (equal ones, but none in three
    capital letters), MULTIPLE (several different ones), else PROMOTE with that unit. Facts are counted per scope and value before they meet the heads, so a
    scope with many facts makes no pairs.
    """
    f = facts.select(*on, F.col(value).alias("__v"), tx.iso_currency(F.col(unit)).alias("__u"), F.coalesce(F.col(excluded), F.lit(False)).alias("__x"))
    scope = f.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), F.count_if(~F.col("__x")).alias("__usable"))
    equal = f.where(~F.col("__x")).groupBy(*on, "__v").agg(F.min("__u").alias("__low"), F.max("__u").alias("__high"), F.lit(True).alias("__equal"))
    rows = heads.select(id_column, *on, F.col(value).alias("__v")).join(scope, list(on), "left").join(equal, [*on, "__v"], "left")
    outcome = (
        F.when(F.col("__n").isNull(), "NO_FACT").when(F.col("__usable") == 0, "EXCLUDED").when(F.col("__equal").isNull(), "NOT_EQUAL").when(F.col("__low").isNull(), "NO_CURRENCY").when(F.col("__low") != F.col("__high"), "MULTIPLE").otherwise("PROMOTE")
    )
    return rows.select(id_column, outcome.alias("outcome"), F.when(outcome == "PROMOTE", F.col("__low")).alias("unit"))


def reject_shared(binds: DataFrame, target: str) -> DataFrame:
    """binds with target null and shared true where several rows bind the same target: then none of them does."""
    shared = binds.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("__t")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__t", F.lit(True).alias("__s"))
    out = binds.join(shared, F.col(target) == F.col("__t"), "left")
    return out.select(*[F.when(F.col("__s").isNull(), F.col(c)).alias(c) if c == target else F.col(c) for c in binds.columns], F.coalesce("__s", F.lit(False)).alias("shared"))


def near_name_pairs(names: DataFrame, id_column: str, core: Column, suffix: Column, by: Sequence[str] = ()) -> DataFrame:
    """id_a, id_b, core of names with one core but different suffixes, inside one group; pairs of classes, not of copies.

    Names are reduced to one representative (least id) per (group, core, suffix), so copies make no pairs.
    """
    classes = names.select(*by, F.col(id_column).alias("__id"), core.alias("core"), suffix.alias("__suffix")).where("core <> ''")
    classes = classes.groupBy(*by, "core", "__suffix").agg(F.min("__id").alias("__id"))
    b = classes.select(*by, "core", F.col("__suffix").alias("__suffix_b"), F.col("__id").alias("id_b"))
    return classes.join(b, [*by, "core"]).where("__id < id_b and __suffix <> __suffix_b").select(*by, F.col("__id").alias("id_a"), "id_b", "core")


def canonical(edges: DataFrame, source: str, target: str, depth: int = 64) -> DataFrame:
    """node, canonical, is_cyclic: where each node's edges end. Every node has at most one outgoing edge.

    Known steps are doubled each round until nothing moves, so a chain of `depth` edges takes log2(depth) joins; nodes that still move then
    are on or lead into a cycle (or a longer chain) and have no canonical node. Targets without an edge are canonical themselves.
    """
    one = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("node")).agg(F.min(target).alias("next"))
    one = cut(one, "edges")
    open_ends = one.select(F.col("node").alias("next"), F.lit(True).alias("__open"))
    jump, reach = one, 1
    while True:
        ended = jump.join(open_ends, "next", "left")
        if reach >= depth or ended.where("__open").isEmpty():
            break
        further = jump.select(F.col("node").alias("next"), F.col("next").alias("__further"))
        jump = cut(jump.join(further, "next", "left").select("node", F.coalesce("__further", "next").alias("next")), "jump")
        reach *= 2
    terminal = one.select(F.col("next").alias("node")).distinct().join(one.select("node"), "node", "left_anti").select("node", F.col("node").alias("canonical"), F.lit(False).alias("is_cyclic"))
    moved = ended.select("node", F.when(F.col("__open").isNull(), F.col("next")).alias("canonical"), F.col("__open").isNotNull().alias("is_cyclic"))
    return moved.unionByName(terminal)


def approved_target(heads: DataFrame, decisions: DataFrame, subject: str) -> DataFrame:
    """subject, target that holds now: that of a MATCHED head, or of the MATCHED decision that a pending PROBABLE head would replace."""
    prior = decisions.select(F.col("id").alias("__pid"), F.col("state").alias("__pstate"), F.col("target").alias("__ptarget"))
    joined = heads.join(prior, F.col("supersedes_id") == F.col("__pid"), "left")
    pending = (F.col("state") == "PROBABLE") & (F.col("__pstate") == "MATCHED")
    target = F.when(F.col("state") == "MATCHED", F.col("target")).when(pending, F.col("__ptarget"))
    return joined.select(subject, target.alias("target")).where("target is not null")


def plan_entities(observations: DataFrame, aliases: DataFrame, group: str, name: str, alias: str = "alias", entity: str = "entity") -> DataFrame:
    """group, plan, name, entity: NO_NAME, CONFLICTING_NAMES, AMBIGUOUS_ALIAS, EXISTING (with its entity) or NEW (with an id made from the name)."""
    names = observations.groupBy(group).agg(F.count_distinct(name).alias("__n"), F.min(name).alias("name"))
    known = aliases.groupBy(F.col(alias).alias("name")).agg(F.count_distinct(entity).alias("__e"), F.min(entity).cast("string").alias("__only"))
    joined = names.join(known, "name", "left")
    plan = (
        F.when(F.col("__n") == 0, "NO_NAME").when(F.col("__n") > 1, "CONFLICTING_NAMES").when(F.col("__e") > 1, "AMBIGUOUS_ALIAS").when(F.col("__e") == 1, "EXISTING").otherwise("NEW")
    )
    made = F.when(plan == "EXISTING", F.col("__only")).when(plan == "NEW", F.sha2("name", 256))
    return joined.select(group, plan.alias("plan"), F.when(F.col("__n") == 1, F.col("name")).alias("name"), made.alias("entity"))


def fact_groups(rows: DataFrame, keys: Sequence[str], axes: Sequence[str], id_column: str, role: str, measures: str) -> DataFrame:
    """keys, axes, outcome, balance_id, spread_id, pik_id per group of rows that name one fact: GROUPED if they are one BALANCE and one SPREAD row and at most one PIK row without a common measure.

    All keys must be filled; rows with a null or blank key enter no group. On an axis null and blank are one value (given as null).
    Other groups are told with the first thing that blocks them, and no ids: UNKNOWN_ROLE (a row without a role), ROLE_SHAPE, COMMON_MEASURE. Groups of
    one row are no groups. Rows of a group are counted before anything is gathered; only the measures of groups of two or three rows are looked into.
    """
    blank = lambda c: F.nullif(F.btrim(F.col(c).cast("string")), F.lit(""))
    filled = rows
    for k in keys:
        filled = filled.where(blank(k).isNotNull())
    named = [F.coalesce(blank(a), F.lit("")).alias(f"__{a}") for a in axes]
    filled = filled.select(*keys, *named, F.col(id_column).alias("__id"), F.col(role).alias("__role"), F.col(measures).alias("__m"))
    by = [*keys, *[f"__{a}" for a in axes]]
    one = lambda name: F.min(F.when(F.col("__role") == name, F.col("__id")))
    n = lambda name: F.count_if(F.col("__role") == name)
    shape = filled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), n("BALANCE").alias("b"), n("SPREAD").alias("s"), n("PIK").alias("p"), one("BALANCE").alias("balance_id"), one("SPREAD").alias("spread_id"), one("PIK").alias("pik_id"),
        F.sum(F.size("__m")).alias("n_measures"),
    ).where("n > 1")
    shaped = (F.col("b") == 1) & (F.col("s") == 1) & (F.col("p") <= 1) & (F.col("n") == F.col("b") + F.col("s") + F.col("p"))
    looked_into = filled.join(shape.where(shaped).select(*by), by, "left_semi")
    distinct = looked_into.select(*by, F.explode("__m").alias("x")).groupBy(*by).agg(F.count_distinct("x").alias("n_distinct"))
    joined = shape.join(distinct, by, "left")
    outcome = F.when(F.col("b") + F.col("s") + F.col("p") < F.col("n"), "UNKNOWN_ROLE").when(~shaped, "ROLE_SHAPE").when(F.col("n_measures") != F.coalesce("n_distinct", F.lit(0)), "COMMON_MEASURE").otherwise("GROUPED")
    ids = [F.when(outcome == "GROUPED", F.col(c)).alias(c) for c in ("balance_id", "spread_id", "pik_id")]
    return joined.select(*keys, *[F.nullif(F.col(f"__{a}"), F.lit("")).alias(a) for a in axes], outcome.alias("outcome"), *ids)


def bind_by_fields(left: DataFrame, right: DataFrame, left_id: str, right_id: str, scope: Sequence[str]) -> DataFrame:
    """left_id, outcome, matched: BOUND to the one right record of the same scope with which every common field agrees, at least one.

    left and right are long: id, scope, field, value. NO_ROW: no record of the scope agrees; SEVERAL_ROWS: more than one does; SHARED_ROW: the
    record is claimed by several left records, then none of them is bound. Records meet on equal values only, never pairwise within
    a scope; that they disagree nowhere is then read off the counts of common fields. A field repeated in a record counts once if it agrees with itself.
    """
    s = list(scope)
    own = lambda df, id_, name: df.groupBy(*s, F.col(id_).alias(name), "field").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value")).where("n = 1").drop("n")
    l, r = own(left, left_id, "l"), own(right, right_id, "r")  # noqa: E741
    names = lambda df, id_, name: df.groupBy(*s, id_).agg(F.collect_set("field").alias(name))
    equal = l.join(r, [*s, "field", "value"]).groupBy(*s, "l", "r").agg(F.count(F.lit(1)).alias("n"))
    checked = equal.join(names(l, "l", "lf"), [*s, "l"]).join(names(r, "r", "rf"), [*s, "r"]).where(F.col("n") == F.size(F.array_intersect("lf", "rf")))
    per = checked.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r"))
    bound = reject_shared(per.select("l", "n", F.when(F.col("n") == 1, F.col("r")).alias("matched")), "matched")
    outcome = F.when(F.col("n").isNull(), "NO_ROW").when(F.col("n") > 1, "SEVERAL_ROWS").when(F.col("shared"), "SHARED_ROW").otherwise("BOUND")
    everyone = left.select(F.col(left_id).alias("l")).distinct()
    return everyone.join(bound, "l", "left").select(F.col("l").alias(left_id), outcome.alias("outcome"), "matched")
