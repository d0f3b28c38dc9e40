"""Load units: raw lines are scanned, split once, projected into typed rows, and every line that is not projected is set aside with its reason.

A unit gives the rows to append to each table and the checks that must be empty before; `append_unit` writes them once per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import text as tx
from stratalog.functions.cells import cell
from stratalog.operators.joins import guarded_join
from stratalog.operators.parse_failures import FORMATS, failures_of, split_lines
from stratalog.plans.problems import accession18, p6_sql
from stratalog.session import cut, table
from stratalog.sources.sinks import append_once

QUERIES: dict = {}
SQL: dict[str, str] = {}
_KEYS = ["table_load_id", "line_number"]


class Unit:
    """One table's lines, split and judged once; the projections share what was written down."""

    def __init__(self, lines: DataFrame, loads: DataFrame, filings: DataFrame, code: str):
        self.code, self.filings = code, filings.select(accession18(F.col("accession_number")).alias("accession"), "filing_id", "withdrawn_at")
        self.loads = loads.where(F.col("table_code") == code)
        own = guarded_join(lines.select(*_KEYS, "raw_line"), self.loads.select("table_load_id"), ["table_load_id"], "left_semi")
        self.rows = cut(split_lines(own, self.loads, "table_load_id", "raw_line"), "lines")
        self.failed = cut(failures_of(self.rows, _KEYS, {code: FORMATS[code]}), "failed")

    def tabular_rows(self) -> DataFrame:
        """Every line as it was landed, with the hash of its text and its status."""
        status = F.when(F.col("structure") == "quoting", "BROKEN_QUOTING").when(F.col("structure") == "field_count", "FIELD_COUNT_MISMATCH").otherwise("OK")
        return self.rows.select(*_KEYS, F.sha2("raw_line", 256).alias("line_sha256"), status.alias("status"), F.coalesce(F.size("__cells"), F.lit(0)).alias("width"))

    def _sound(self) -> DataFrame:
        good = guarded_join(self.rows.where("structure is null"), self.failed.select(*_KEYS), _KEYS, "left_anti")
        at = lambda label: cell(F.col("__cells"), F.col("__header"), label)
        return good.withColumn("at", F.struct(*[at(n).alias(f"c{i}") for i, n in enumerate(self._labels())]))

    def _labels(self) -> tuple[str, ...]:
        return {
            "SOI": ("adsh", "cik", "ddate", "qtrs", "Investment, Identifier Axis", "Investment Owned, Fair Value"),
            "NUM": ("adsh", "tag", "uom", "ddate", "qtrs", "value"),
            "BDC_REPORT": ("CIK", "Registrant_Name", "Filing Date"),
        }[self.code]

    def _linked(self, rows: DataFrame) -> DataFrame:
        """rows with the one filing of their accession number that was never withdrawn, if there is one (a number may have come back under another filing)."""
        one = self.filings.where("withdrawn_at is null and accession is not null").groupBy("accession").agg(F.min("filing_id").alias("filing_id"))
        return guarded_join(rows.withColumn("accession", accession18(F.col("at.c0"))), one, ["accession"], "left")

    def observations(self) -> DataFrame:
        """The typed rows of the lines that load and refer to a standing filing (BDC_REPORT: that load)."""
        at = lambda i: F.col(f"at.c{i}")
        if self.code == "BDC_REPORT":
            return self._sound().select(*_KEYS, at(0).alias("cik"), at(1).alias("registrant_name"), F.concat(F.lit("20"), F.substring(at(2), 7, 2), F.lit("-"), F.substring(at(2), 1, 2), F.lit("-"), F.substring(at(2), 4, 2)).alias("filed"))
        rows = self._linked(self._sound()).where("filing_id is not null")
        if self.code == "SOI":
            kind = F.when(at(3).cast("decimal(38,0)") == 0, "POINT_IN_TIME").otherwise("DURATION")
            return rows.select(*_KEYS, "filing_id", at(1).cast("long").alias("cik"), at(2).alias("reported_date"), kind.alias("duration_kind"), F.nullif(at(4), F.lit("")).alias("identifier_raw"), F.nullif(at(5), F.lit("")).alias("fair_value_raw"))
        return rows.select(*_KEYS, "filing_id", at(1).alias("tag"), tx.iso_currency(at(2)).alias("currency"), F.concat_ws("-", F.substring(at(3), 1, 4), F.substring(at(3), 5, 2), F.substring(at(3), 7, 2)).alias("fact_date"), at(4).alias("qtrs"), F.nullif(at(5), F.lit("")).alias("value_raw"))

    def exceptions(self) -> DataFrame:
        """Lines that are not projected: BROKEN_QUOTING, FIELD_COUNT_MISMATCH, INVALID_VALUE, or ORPHAN_ADSH for a sound line without standing filing."""
        kind = F.when(F.col("reason") == "quoting", "BROKEN_QUOTING").when(F.col("reason") == "field_count", "FIELD_COUNT_MISMATCH").otherwise("INVALID_VALUE")
        set_aside = self.failed.select(*_KEYS, kind.alias("kind"))
        if self.code == "BDC_REPORT":
            return set_aside
        return set_aside.unionByName(self._linked(self._sound()).where("filing_id is null").select(*_KEYS, F.lit("ORPHAN_ADSH").alias("kind")))

    def coverage(self) -> DataFrame:
        """Per load what was declared, landed, projected and set aside, and its state: SCHEMA_DRIFT, EMPTY, COVERED or NOT_INGESTED (lines, but none projected)."""
        n = lambda df, name: df.groupBy("table_load_id").agg(F.count(F.lit(1)).alias(name))
        out = self.loads.select("table_load_id", "row_count", "parse_status")
        for part in (n(self.rows, "landed"), n(self.observations(), "projected"), n(self.exceptions(), "set_aside")):
            out = out.join(part, "table_load_id", "left")
        out = out.na.fill(0, ["landed", "projected", "set_aside"])
        state = F.when(F.col("parse_status") == "SCHEMA_DRIFT", "SCHEMA_DRIFT").when(F.col("landed") == 0, "EMPTY").when(F.col("projected") > 0, "COVERED").otherwise("NOT_INGESTED")
        return out.withColumn("coverage_state", state)

    def checks(self) -> dict[str, DataFrame]:
        """What must be empty before anything is appended."""
        told = self.coverage()
        return {"every line is projected or set aside, once": told.where("landed <> projected + set_aside"), "a drifted load has no lines": told.where("coverage_state = 'SCHEMA_DRIFT' and landed > 0")}


def append_unit(unit: Unit, folder: str, block: str) -> bool:
    """Append a unit's rows, observations, exceptions and coverage under one block, each once; a run that died goes on where it ended."""
    checks = unit.checks()
    wrote = False
    for name in ("tabular_rows", "observations", "exceptions", "coverage"):
        wrote |= append_once(getattr(unit, name)(), f"{folder}/{unit.code.lower()}_{name}", f"{folder}/ledger/{unit.code.lower()}_{name}", block, checks)
    return wrote


def _unit(spark, sf, code: str) -> Unit:
    return Unit(table(spark, sf, "tsv_line"), table(spark, sf, "table_load"), table(spark, sf, "filing"), code)


def _register() -> None:
    def add(name: str, sql: str, call) -> None:
        QUERIES[name], SQL[name] = call, sql

    at = lambda label: f"coalesce(cells[list_position(header, '{label}')], '')"
    base = p6_sql("header", "raw_line") + """, one AS (SELECT regexp_replace(accession_number, '[^0-9]', '', 'g') AS accession, min(filing_id) AS filing_id FROM filing WHERE withdrawn_at IS NULL GROUP BY 1),
u AS (SELECT r.*, one.filing_id FROM r LEFT JOIN one ON r.why IS NULL AND one.accession = regexp_replace(coalesce(cells[list_position(header, 'adsh')], ''), '[^0-9]', '', 'g') WHERE table_code = '{code}')
"""
    day = lambda x: f"substr({x}, 1, 4) || '-' || substr({x}, 5, 2) || '-' || substr({x}, 7, 2)"
    us = at("Filing Date")
    observed = {
        "SOI": f"SELECT table_load_id, line_number, filing_id, {at('cik')}::BIGINT AS cik, {at('ddate')} AS reported_date, CASE WHEN {at('qtrs')}::HUGEINT = 0 THEN 'POINT_IN_TIME' ELSE 'DURATION' END AS duration_kind, nullif({at('Investment, Identifier Axis')}, '') AS identifier_raw, nullif({at('Investment Owned, Fair Value')}, '') AS fair_value_raw FROM u WHERE why IS NULL AND filing_id IS NOT NULL",
        "NUM": f"SELECT table_load_id, line_number, filing_id, {at('tag')} AS tag, CASE WHEN regexp_full_match({at('uom')}, '[A-Z]{{3}}') THEN {at('uom')} END AS currency, {day(at('ddate'))} AS fact_date, {at('qtrs')} AS qtrs, nullif({at('value')}, '') AS value_raw FROM u WHERE why IS NULL AND filing_id IS NOT NULL",
        "BDC_REPORT": f"SELECT table_load_id, line_number, {at('CIK')} AS cik, {at('Registrant_Name')} AS registrant_name, '20' || substr({us}, 7, 2) || '-' || substr({us}, 1, 2) || '-' || substr({us}, 4, 2) AS filed FROM u WHERE why IS NULL",
    }
    for code, sql in observed.items():
        name, with_ = code.lower(), base.replace("{code}", code)
        kind = "CASE why WHEN 'quoting' THEN 'BROKEN_QUOTING' WHEN 'field_count' THEN 'FIELD_COUNT_MISMATCH' WHEN 'invalid_value' THEN 'INVALID_VALUE' ELSE 'ORPHAN_ADSH' END"
        aside = f"SELECT table_load_id, line_number, {kind} AS kind FROM u WHERE why IS NOT NULL" + ("" if code == "BDC_REPORT" else " OR filing_id IS NULL")
        counts = f"""SELECT l.table_load_id, row_count, parse_status, (SELECT count(*) FROM u WHERE u.table_load_id = l.table_load_id) AS landed, (SELECT count(*) FROM ({sql}) o WHERE o.table_load_id = l.table_load_id) AS projected, (SELECT count(*) FROM ({aside}) o WHERE o.table_load_id = l.table_load_id) AS set_aside FROM table_load l WHERE table_code = '{code}'"""
        state = "CASE WHEN parse_status = 'SCHEMA_DRIFT' THEN 'SCHEMA_DRIFT' WHEN landed = 0 THEN 'EMPTY' WHEN projected > 0 THEN 'COVERED' ELSE 'NOT_INGESTED' END AS coverage_state"
        add(f"load_{name}_observations", with_ + sql, lambda spark, sf, c=code: _unit(spark, sf, c).observations())
        add(f"load_{name}_exceptions", with_ + aside, lambda spark, sf, c=code: _unit(spark, sf, c).exceptions())
        add(f"load_{name}_coverage", with_ + f"SELECT *, {state} FROM ({counts})", lambda spark, sf, c=code: _unit(spark, sf, c).coverage())
        rows = "SELECT table_load_id, line_number, sha256(raw_line) AS line_sha256, CASE WHEN why = 'quoting' THEN 'BROKEN_QUOTING' WHEN why = 'field_count' THEN 'FIELD_COUNT_MISMATCH' ELSE 'OK' END AS status, CASE WHEN why = 'quoting' THEN 0 ELSE len(cells) END::INT AS width FROM u"
        add(f"load_{name}_rows", with_ + rows, lambda spark, sf, c=code: _unit(spark, sf, c).tabular_rows())


_register()
