"""Plans of appends: what a batch would add, keep or refuse, worked out as tables before anything is written.

Text that names things stays in rows; where a reference procedure would raise, the plan has a `problem` and `require_empty` raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that describe a holding and measure nothing, and those that may stand beside a balance.
DIMENSION_FIELDS = ("INDUSTRY", "INSTRUMENT_TYPE", "ISSUER_AFFILIATION", "ISSUER_NAME", "GEOGRAPHY", "SENIORITY", "NON_ACCRUAL", "RESTRICTED", "FAIR_VALUE_LEVEL", "REFERENCE_RATE", "SECURED")
BALANCE_FIELDS = ("PRINCIPAL_AMOUNT", "FAIR_VALUE", "COST", "MATURITY_DATE", "ACQUISITION_DATE", "INTEREST_RATE", "INTEREST_RATE_FLOOR", "PIK_RATE", "CASH_RATE", "PERCENT_OF_NET_ASSETS")


def fact_role(fields: Column) -> Column:
    """BALANCE, SPREAD or PIK of a row from the array of its field codes; null if its measures repeat or fit no role."""
    measures = F.filter(fields, lambda x: ~x.isin(*DIMENSION_FIELDS))
    has = lambda x: F.array_contains(measures, x)
    alone = F.size(measures) == 1
    balance = has("PRINCIPAL_AMOUNT") & has("FAIR_VALUE") & F.forall(measures, lambda x: x.isin(*BALANCE_FIELDS))
    role = F.when(balance, "BALANCE").when(alone & has("SPREAD"), "SPREAD").when(alone & has("PIK_RATE"), "PIK")
    return F.when(F.size(F.array_distinct(measures)) == F.size(measures), role)


def natural_key(*parts: Column) -> Column:
    """A deterministic id of natural parts; null parts are told apart from empty ones, and no two part lists run together."""
    told = [F.when(p.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))) for p in parts]
    return F.sha2(F.concat_ws("|", *told), 256)


def hashed_batches(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """sha256, text, ids (sorted), problem per text: NO_TEXT, REPEATED_ID or HASH_OF_TWO_TEXTS. Meant for bounded work lists, as ids are listed."""
    rows = df.select(F.col(id_column).alias("id"), F.nullif(F.col(text), F.lit("")).alias("text"))
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(True).alias("again"))
    grouped = rows.join(again, "id", "left").groupBy(F.sha2("text", 256).alias("sha256")).agg(
        F.min("text").alias("text"), F.max("text").alias("last"), F.array_sort(F.collect_list("id")).alias("ids"), F.bool_or(F.coalesce("again", F.lit(False))).alias("again")
    )
    problem = F.when(F.col("sha256").isNull(), "NO_TEXT").when(F.col("again"), "REPEATED_ID").when(F.col("text") != F.col("last"), "HASH_OF_TWO_TEXTS")
    return grouped.select("sha256", "text", "ids", problem.alias("problem"))


def name_batches(targets: DataFrame, known: DataFrame, id_column: str, text: str, entity: str) -> DataFrame:
    """text, mode (new or reuse), entity, target_ids, known_ids, problem per exact name: SEVERAL_ENTITIES, NO_ENTITY or NOT_A_TARGET."""
    part = lambda df, is_target, e: df.select(F.col(text).alias("text"), F.col(id_column).alias("id"), F.lit(is_target).alias("t"), e.alias("e"))
    rows = part(targets, True, F.lit(None).cast("string")).unionByName(part(known, False, F.col(entity).cast("string")))
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    grouped = rows.groupBy("text").agg(ids(F.col("t")).alias("target_ids"), ids(~F.col("t")).alias("known_ids"), F.min("e").alias("entity"), F.max("e").alias("last"), F.count_if(~F.col("t") & F.col("e").isNull()).alias("nameless"))
    problem = F.when(F.size("target_ids") == 0, "NOT_A_TARGET").when(F.col("entity") != F.col("last"), "SEVERAL_ENTITIES").when(F.col("nameless") > 0, "NO_ENTITY")
    return grouped.select("text", F.when(F.size("known_ids") == 0, "new").otherwise("reuse").alias("mode"), "entity", "target_ids", "known_ids", problem.alias("problem"))


def pending_series(df: DataFrame, keys: Sequence[str], date: str, id_column: str, decided: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """keys, first_id, n: series with one row per date of which not every row is decided, in order of their least id.

    decided has id_column. A limit is a batch size: what it leaves out comes with the next call, once the first batch is decided.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(date).alias("__d"), F.min(id_column).alias("first_id"))
    series = counted.where(F.col("n") == F.col("__d")).drop("__d")
    if decided is not None:
        open_rows = df.join(decided.select(id_column).distinct(), id_column, "left_anti").select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        series = series.join(open_rows, same, "left_semi")
    ordered = series.orderBy("first_id")
    return ordered if limit is None else ordered.limit(limit)


def head_action(n_heads: Column, same: Column) -> Column:
    """INSERT without a head, KEEP with one that says the same, else CONFLICT."""
    return F.when(n_heads == 0, "INSERT").when((n_heads == 1) & F.coalesce(same, F.lit(False)), "KEEP").otherwise("CONFLICT")


def outcome_plan(outcomes: DataFrame, heads: DataFrame, subject: str, rule: str, columns: Sequence[str]) -> DataFrame:
    """outcomes with action (SKIP if the head has the same rule and outcome, else INSERT) and supersedes_id; so a rule that runs again adds nothing."""
    old = heads.select(F.col(subject).alias("__s"), F.col("id").alias("__id"), F.col(rule).alias("__rule"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = outcomes.join(old, F.col(subject) == F.col("__s"), "left")
    same = F.col("__rule").eqNullSafe(F.col(rule)) & F.col("__id").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return joined.select(*outcomes.columns, F.when(same, "SKIP").otherwise("INSERT").alias("action"), F.when(~same, F.col("__id")).alias("supersedes_id"))


def heading_field(headings: Column) -> Column:
    """The date field that a stack of headings (array of struct<slot,row,text>) stands for; null unless it is one gapless stack of one column.

    `Maturity` over `Date` names the maturity; `Date` alone names nothing.
    """
    ordered = F.array_sort(F.transform(headings, lambda h: F.struct(h["row"].alias("row"), h["slot"].alias("slot"), h["text"].alias("text"))))
    rows, texts = F.transform(ordered, lambda h: h["row"]), F.transform(ordered, lambda h: h["text"])
    one_column = F.size(F.array_distinct(F.transform(ordered, lambda h: h["slot"]))) == 1
    gapless = (F.size(F.array_distinct(rows)) == F.size(rows)) & (F.array_max(rows) - F.array_min(rows) + 1 == F.size(rows))
    whole = one_column & gapless & F.forall(ordered, lambda h: h["row"].isNotNull() & h["slot"].isNotNull() & (h["text"] != ""))
    stack = F.array_join(texts, " / ")
    field = F.when(stack.isin("Maturity", "Maturity Date", "Maturity/Expiration Date", "Maturity / Date"), "MATURITY_DATE").when(stack.isin("Acquisition Date", "Purchase Date"), "ACQUISITION_DATE")
    return F.when(F.coalesce(whole, F.lit(False)), field)


def field_traces(values: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """key, traces: the ordered list of a cell's value rows; a cell has few."""
    return values.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("traces"))
