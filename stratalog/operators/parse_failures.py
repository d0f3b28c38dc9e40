"""Rows that fail to parse, set apart with their reason while the valid rows load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.cells import line_cells
from stratalog.operators.joins import guarded_join
from stratalog.session import cut

_DECIMAL = r"^-?[0-9]+(\.[0-9]+)?\z"


def _day(pattern: str, form: str) -> Callable:
    return lambda v: v.rlike(pattern) & F.try_to_date(v, form).isNotNull()


def _optional(rule):
    return lambda v: (v == "") | rule(v)


_iso_day = _day(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "yyyy-MM-dd")
_decimal = lambda v: v.rlike(_DECIMAL)


def _this_century(v: Column) -> Column:
    day = F.concat(F.lit("20"), F.substring(v, 7, 2), F.lit("-"), F.substring(v, 1, 2), F.lit("-"), F.substring(v, 4, 2))
    return v.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{2}\z") & F.try_to_date(day, "yyyy-MM-dd").isNotNull()


#: Rules that a cell's text may have to meet; each is judged once per distinct text.
RULES = {
    "accession": lambda v: v.rlike(r"^[0-9]{10}-[0-9]{2}-[0-9]{6}\z"),
    "cik": lambda v: v.rlike(r"^[0-9]{1,10}\z"),
    "cik10": lambda v: v.rlike(r"^[0-9]{10}\z"),
    "digits": lambda v: v.rlike(r"^[0-9]+\z"),
    "filled": lambda v: v != "",
    "iso_day": _iso_day,
    "iso_day_or_empty": _optional(_iso_day),
    "compact_day": _day(r"^[0-9]{8}\z", "yyyyMMdd"),
    "us_day": _this_century,
    "decimal_or_empty": _optional(_decimal),
    "byte_length": lambda v: v.rlike(r"^[0-9]+[|][0-9]+\z")
    & F.substring_index(v, "|", 1).try_cast("decimal(38,0)").eqNullSafe(F.substring_index(v, "|", -1).try_cast("decimal(38,0)")),
}

#: Fixed formats of the three tables: column to rule. `a|b` is the pair (text of a, UTF-8 bytes of b).
FORMATS = {
    "SOI": {
        "adsh": "accession", "cik": "cik", "ddate": "iso_day", "filed": "iso_day", "period": "iso_day", "qtrs": "digits", "Investment Maturity Date": "iso_day_or_empty",
        "Investment Owned, Balance, Principal Amount": "decimal_or_empty", "Investment Owned, Cost": "decimal_or_empty", "Investment Owned, Fair Value": "decimal_or_empty",
    },
    "NUM": {"adsh": "accession", "tag": "filled", "version": "filled", "uom": "filled", "ddate": "compact_day", "qtrs": "digits", "value": "decimal_or_empty", "footlen|footnote": "byte_length"},
    "BDC_REPORT": {"CIK": "cik10", "Registrant_Name": "filled", "Filing Date": "us_day"},
}


def _ruled_columns(formats: dict) -> Column:
    """Per load: name, place and second place (from 0, null if the header lacks it) of each column with a rule."""
    at = lambda label: F.nullif(F.array_position(F.col("header"), F.lit(label)), F.lit(0).cast("long")).cast("int") - 1
    ruled = F.array().cast("array<struct<name:string,at:int,second:int>>")
    for code, columns in formats.items():
        places = []
        for name in columns:
            first, _, second = name.partition("|")
            places.append(F.struct(F.lit(name).alias("name"), at(first).alias("at"), (at(second) if second else F.lit(None).cast("int")).alias("second")))
        ruled = F.when(F.col("table_code") == code, F.array(*places)).otherwise(ruled)
    return ruled


def split_lines(lines: DataFrame, loads: DataFrame, load_key: str, line: str, formats: dict | None = None) -> DataFrame:
    """lines with their load's code and header, their cells, and `structure`: null, quoting or field_count.

    A final carriage return is no content. A null line, and a line whose load is unknown or has no header, is a field_count case.
    The places of the columns with rules are found once per load.
    """
    heads = loads.select(
        load_key, F.col("table_code").alias("__code"), F.col("delimiter").alias("__delimiter"), F.col("header").alias("__header"), _ruled_columns(FORMATS if formats is None else formats).alias("__ruled")
    ).dropDuplicates([load_key])
    joined = guarded_join(lines, heads, [load_key], "left")
    text = F.when(F.col(line).endswith("\r"), F.expr(f"substring(`{line}`, 1, length(`{line}`) - 1)")).otherwise(F.col(line))
    cells = joined.withColumn("__cells", line_cells(text, F.coalesce("__delimiter", F.lit("\t"))))
    structure = F.when(F.col(line).isNotNull() & F.col("__cells").isNull(), "quoting").when(
        F.col("__cells").isNull() | F.col("__header").isNull() | (F.size("__cells") != F.size("__header")), "field_count"
    )
    return cells.withColumn("structure", structure)


def _findings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code, column, text: every cell that has a rule of the structurally sound rows, and of the others one row with a null column and what is wrong as text.

    A pair's text is `a|bytes of b`. One pass over the split lines gives both kinds.
    """

    def checked(column: Column) -> Column:
        text = F.coalesce(F.get("__cells", column["at"]), F.lit(""))
        size = F.coalesce(F.octet_length(F.get("__cells", column["second"])), F.lit(0)).cast("string")
        pair = column["name"].contains("|")
        return F.struct(column["name"].alias("column"), F.when(pair, F.concat(text, F.lit("|"), size)).otherwise(text).alias("text"))

    broken = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.col("structure").alias("text")))
    told = F.when(F.col("structure").isNull(), F.transform("__ruled", checked)).otherwise(broken)
    return rows.select(*keys, F.col("__code").alias("code"), F.inline(told))


def invalid_values(cells: DataFrame, formats: dict) -> DataFrame:
    """The dictionary of invalid texts: code, column, text, rule. Each distinct text of a column is cast once."""
    valid, rule_name = F.lit(True), F.lit(None).cast("string")
    for code, columns in formats.items():
        for name, rule in columns.items():
            here = (F.col("code") == code) & (F.col("column") == name)
            valid = F.when(here, RULES[rule](F.col("text"))).otherwise(valid)
            rule_name = F.when(here, F.lit(rule)).otherwise(rule_name)
    return cells.select("code", "column", "text").distinct().withColumn("rule", rule_name).where(~F.coalesce(valid, F.lit(False)))


def parse_failures(lines: DataFrame, loads: DataFrame, load_key: str, keys: list[str], line: str, formats: dict | None = None) -> DataFrame:
    """keys, reason (the first of quoting, field_count, invalid_value) and detail (`column: rule`) of every line that does not load.

    loads has load_key, table_code, delimiter and header (array<string>). Structure is checked on the whole line; values
    are judged once per distinct text and column (map-side combined), and the dictionary of invalid ones is joined
    back: broadcast after a count, else by a join that splits hot texts, so a text that a third of the rows hold stays harmless.
    The lines are read, and split, once: their checked cells and their structural faults come from one pass and are written down.
    Codes without formats are checked for structure only. Empty tables give no rows; further columns are ignored.
    """
    formats = FORMATS if formats is None else formats
    rows = split_lines(lines.select(*dict.fromkeys([load_key, *keys, line])), loads, load_key, line, formats)
    return failures_of(rows, keys, formats)


def failures_of(rows: DataFrame, keys: list[str], formats: dict) -> DataFrame:
    """parse_failures of lines that split_lines has split already."""
    found = cut(_findings(rows, keys), "findings")
    cells = found.where("column is not null")
    bad = guarded_join(cells, cut(invalid_values(cells, formats), "invalid"), ["code", "column", "text"])
    values = bad.groupBy(*keys).agg(F.min(F.concat("column", F.lit(": "), "rule")).alias("detail")).select(*keys, F.lit("invalid_value").alias("reason"), "detail")
    structural = found.where("column is null").select(*keys, F.col("text").alias("reason"), F.lit(None).cast("string").alias("detail"))
    return structural.unionByName(values)


def loaded_rows(lines: DataFrame, loads: DataFrame, load_key: str, keys: list[str], line: str, formats: dict | None = None) -> DataFrame:
    """keys, table_code and record (map of label to cell) of every line that parse_failures does not name. The lines are split once and written down."""
    formats = FORMATS if formats is None else formats
    rows = cut(split_lines(lines.select(*dict.fromkeys([load_key, *keys, line])), loads, load_key, line, formats), "lines")
    failed = failures_of(rows, keys, formats).where("reason = 'invalid_value'").select(*keys)
    good = guarded_join(rows.where("structure is null"), failed, keys, "left_anti")
    return good.select(*keys, F.col("__code").alias("table_code"), F.map_from_arrays("__header", "__cells").alias("record"))
