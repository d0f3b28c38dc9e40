"""Value states: unknown stays unknown, several values are never narrowed to one, totals are given only when they are whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.session import BROADCAST_ROWS, at_most


def three_state(value: Column) -> Column:
    """Aggregate: UNKNOWN without any value, MULTIPLE_VALUES with several different ones, else REPORTED.

    Least and greatest tell one value from several, so many such columns need neither distinct counts nor copies of the rows.
    """
    return F.when(F.min(value).isNull(), "UNKNOWN").when(F.min(value) != F.max(value), "MULTIPLE_VALUES").otherwise("REPORTED")


def four_state(state: Column, value: Column) -> Column:
    """Aggregate over current rows: with exactly one row its own state (REPORTED only with a value), without any UNKNOWN, else MULTIPLE_VALUES."""
    n, only = F.count(state), F.min(state)
    return F.when(n == 0, "UNKNOWN").when(n > 1, "MULTIPLE_VALUES").when((only == "REPORTED") & (F.count(value) == 0), "UNKNOWN").otherwise(only)


def exactly_one(value: Column, rows: Column | None = None) -> Column:
    """Aggregate: the value if there is exactly one row (or exactly one row with `rows` set), else null."""
    n = F.count(F.lit(1)) if rows is None else F.count(rows)
    return F.when(n == 1, F.min(value))


def single_value(value: Column) -> Column:
    """Aggregate: the value if all known ones are equal, else null."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def guarded_total(value: Column, ok: Column, unit: Column) -> tuple[Column, Column, Column]:
    """Aggregates (state, total, unit): a total only if every row is ok and all units are known and equal.

    EMPTY without rows, INCOMPLETE with a row that is not ok or has no value, UNKNOWN_UNIT, MIXED_UNITS, else TOTAL.
    """
    whole = F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False)) & value.isNotNull()), F.lit(False))
    state = (
        F.when(F.count(F.lit(1)) == 0, "EMPTY")
        .when(~whole, "INCOMPLETE")
        .when(F.count(unit) < F.count(F.lit(1)), "UNKNOWN_UNIT")
        .when(F.min(unit) != F.max(unit), "MIXED_UNITS")
        .otherwise("TOTAL")
    )
    good = whole & (F.count(unit) == F.count(F.lit(1))) & (F.min(unit) == F.max(unit))
    return state, F.when(good, F.sum(value)), F.when(good, F.min(unit))


def pivot_states(df: DataFrame, keys: Sequence[str], field: str, value: str, fields: Sequence[str]) -> DataFrame:
    """One row per key with <field>_state and <field>_value for each of fields, in one aggregation without a pivot pass."""
    columns = []
    for name in fields:
        own = F.when(F.col(field) == name, F.col(value))
        columns += [three_state(own).alias(f"{name.lower()}_state"), single_value(own).alias(f"{name.lower()}_value")]
    return df.groupBy(*keys).agg(*columns)


def status_grid(subjects: DataFrame, fields: DataFrame, known: DataFrame, on: Sequence[str], state: str, default: str = "UNKNOWN") -> DataFrame:
    """Every subject with every field and its state, `default` where known has none. A side of at most BROADCAST_ROWS rows is broadcast after a count; the grid itself is what is asked for."""
    few = F.broadcast(fields) if at_most(fields, BROADCAST_ROWS) else fields
    grid = subjects.crossJoin(few)
    return grid.join(known.select(*on, state), list(on), "left").withColumn(state, F.coalesce(F.col(state), F.lit(default)))


def first_match(*cases: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The name of the first case that holds; null conditions do not hold."""
    result = F.lit(otherwise)
    for condition, name in reversed(cases):
        result = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(result)
    return result


def field_coverage(df: DataFrame, keys: Sequence[str], states: Sequence[str], state: str) -> DataFrame:
    """Per key the population and how many rows have each state; rows with none of them are counted as unknown."""
    known = F.col(state).isin(list(states))
    counts = [F.count_if(F.col(state) == x).alias(f"n_{x.lower()}") for x in states]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("population"), *counts, F.count_if(~F.coalesce(known, F.lit(False))).alias("n_other"))


def cell_presence(df: DataFrame, entity: Sequence[str], group: Sequence[str], cells: dict[str, Column]) -> DataFrame:
    """Per group, of how many entities some row has each cell (with_<name>) and of how many none has (without_<name>)."""
    flags = df.groupBy(*group, *entity).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in cells.items()])
    counts = [x for n in cells for x in (F.count_if(F.col(n)).alias(f"with_{n}"), F.count_if(~F.col(n)).alias(f"without_{n}"))]
    return flags.groupBy(*group).agg(*counts)


def pivot_heads(df: DataFrame, keys: Sequence[str], field: str, fields: dict[str, str], state: str, value: str) -> DataFrame:
    """One row per key with <name>_state and <name>_value of each field (code: name), by the exactly-one-head rule, in one aggregation.

    A field without a row is UNKNOWN, with several rows MULTIPLE_VALUES (even if they agree), else it has its row's state; only a REPORTED one has a value.
    """
    columns = []
    for code, name in fields.items():
        own = F.col(field) == code
        s, v = F.when(own, F.col(state)), F.when(own, F.col(value))
        told = four_state(s, v)
        columns += [told.alias(f"{name}_state"), F.when(told == "REPORTED", F.min(v)).alias(f"{name}_value")]
    return df.groupBy(*keys).agg(*columns)
