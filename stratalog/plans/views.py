"""The model's views over its tables, as DataFrames composed of the operators.

`Evidence` takes a function from table name (`schema.table`) to DataFrame; every view is a method that plans lazily, so Catalyst sees
through compositions and prunes what a reader does not ask for. Parameterised views take plain Python values, checked first.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import text as tx
from stratalog.operators import chains, matching, periods, states

#: The fields whose coverage of a date is told, and their names there.
COVERED_CELLS = {"PRINCIPAL_AMOUNT": "principal", "COST": "cost", "FAIR_VALUE": "fair_value", "MATURITY_DATE": "maturity"}
NAME_COLUMN = "Investment, Identifier Axis"
#: Chained tables that are read through their heads under a name of their own.
HEADS = {
    "current_filing_relationship": "registry.filing_relationship_decision",
    "current_soi_row_classification": "obs.soi_row_classification",
    "current_position_field_value": "obs.position_field_value",
    "current_entity_resolution": "resolution.entity_resolution_decision",
    "current_group_membership": "resolution.group_membership_decision",
    "current_instrument_resolution": "resolution.instrument_resolution_decision",
    "current_position_continuity": "resolution.position_continuity_decision",
    "current_legal_entity_consolidation": "resolution.legal_entity_consolidation_decision",
    "current_borrower_name_observation": "obs.borrower_name_observation",
    "current_legal_entity_identifier": "identity.legal_entity_identifier",
    "current_maturity_inspection": "obs.maturity_inspection",
}


def checked_cik(cik: str) -> str:
    if not re.fullmatch("[0-9]{10}", cik):
        raise ValueError("a CIK has ten digits")
    return cik


class Evidence:
    def __init__(self, table: Callable[[str], DataFrame]):
        self.table = table

    def heads(self, name: str) -> DataFrame:
        return chains.current_heads(self.table(HEADS.get(name, name)))

    # Runs, coverage, mappings
    def current_run_status(self) -> DataFrame:
        outcomes = self.table("ops.run_outcome").select("run_id", F.col("status").alias("__s"), "finished_at")
        runs = self.table("ops.run").withColumnRenamed("id", "run_id").join(outcomes, "run_id", "left")
        return runs.select("run_id", "run_kind", "started_at", F.coalesce("__s", F.lit("STARTED")).alias("status"), "finished_at")

    def current_coverage(self) -> DataFrame:
        return self.heads("ops.coverage_assertion").withColumn("is_covered", F.col("coverage_state") == "COVERED")

    def current_soi_coverage(self) -> DataFrame:
        return self.current_coverage().where("coverage_aspect = 'SOI_HOLDINGS'")

    def current_column_mapping(self) -> DataFrame:
        return self.heads("ref.source_column_mapping").withColumn("may_feed_derived_values", F.col("mapping_status").isin("DOCUMENTED", "DOCUMENTED_AND_OBSERVED"))

    def current_evidence_status(self) -> DataFrame:
        status = self.heads("validation.evidence_status_assertion").select(F.col("field_value_id").alias("__v"), "evidence_status", "validation_result_id")
        values = self.heads("current_position_field_value").select(F.col("id").alias("field_value_id"))
        return values.join(status, F.col("field_value_id") == F.col("__v"), "left").select("field_value_id", F.coalesce("evidence_status", F.lit("NOT_CHECKED")).alias("evidence_status"), "validation_result_id")

    def dataset_release_status(self) -> DataFrame:
        count = lambda name, alias: self.table(name).groupBy("dataset_release_id").agg(F.count(F.lit(1)).alias(alias))
        covered = self.current_coverage().where("registrant_id is null and coverage_aspect = 'FILING_METADATA' and source_type_code = 'SEC_BDC_DATASET_ZIP'").select("dataset_release_id", "coverage_state", "is_covered")
        out = self.table("registry.dataset_release").withColumnRenamed("id", "dataset_release_id")
        for part in (count("registry.dataset_release_artifact", "artifact_count"), count("registry.dataset_release_listing", "page_listing_count"), covered):
            out = out.join(part, "dataset_release_id", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
        return out.select("dataset_release_id", "release_label", zero("artifact_count"), zero("page_listing_count"), F.coalesce("coverage_state", F.lit("UNKNOWN")).alias("filing_metadata_coverage"), F.coalesce("is_covered", F.lit(False)).alias("is_covered"))

    def registrant_coverage(self) -> DataFrame:
        coverage = self.current_coverage()
        history = coverage.where("coverage_aspect = 'FILING_HISTORY' and dataset_release_id is null and reporting_period_end is null and source_type_code = 'SEC_SUBMISSIONS_JSON'").select("registrant_id", "coverage_state")
        releases = coverage.where("coverage_aspect = 'FILING_METADATA' and is_covered").groupBy("registrant_id").agg(F.count(F.lit(1)).alias("n"))
        out = self._registrants().join(history, "registrant_id", "left").join(releases, "registrant_id", "left")
        return out.select("registrant_id", "cik", F.coalesce("coverage_state", F.lit("UNKNOWN")).alias("filing_history_coverage"), F.coalesce("n", F.lit(0).cast("long")).alias("covered_release_count"))

    def edition_status(self) -> DataFrame:
        """Each listed edition with the outcome of its latest retrieval; NOT_RETRIEVED without one."""
        done = self.table("ops.artifact_processing").select(F.col("artifact_id").alias("__a"), "outcome", F.col("id").alias("__p"))
        tries = self.table("raw.artifact").join(done, F.col("id") == F.col("__a"), "left").select(F.col("source_url").alias("csv_url"), "retrieved_at", F.col("id").alias("artifact_id"), "__p", "outcome")
        latest = chains.latest_by(tries, ["csv_url"], ["retrieved_at", "artifact_id", "__p"]).select("csv_url", "artifact_id", "outcome")
        return self.table("registry.bdc_report_edition").join(latest, "csv_url", "left").select(F.col("id").alias("edition_id"), "csv_url", "artifact_id", F.coalesce("outcome", F.lit("NOT_RETRIEVED")).alias("edition_state"))

    # Filings and registrants
    def _registrants(self) -> DataFrame:
        return self.table("registry.registrant").select(F.col("id").alias("registrant_id"), "cik")

    def current_filing_registrant(self) -> DataFrame:
        links = self.heads("registry.filing_registrant_link").select("filing_id", "registrant_id", "link_source")
        n = links.groupBy("filing_id").agg(F.count_distinct("registrant_id").alias("__n"))
        filings = self.table("registry.filing").select(F.col("id").alias("filing_id"), "accession_number")
        joined = filings.join(links, "filing_id", "left").join(n, "filing_id", "left").join(self._registrants(), "registrant_id", "left")
        status = F.when(F.col("__n").isNull(), "UNKNOWN").when(F.col("__n") > 1, "MULTIPLE").otherwise("LINKED")
        return joined.select("filing_id", "accession_number", "registrant_id", "cik", "link_source", status.alias("registrant_link_status"))

    def portfolio_filing_registrant(self) -> DataFrame:
        """One row per linked filing; several links that name one CIK are one link."""
        linked = self.current_filing_registrant().where("registrant_link_status = 'LINKED'")
        one = states.single_value(F.col("cik"))
        return linked.groupBy("filing_id").agg(
            states.single_value(F.col("registrant_id")).alias("registrant_id"), tx.padded_cik(one).alias("registrant_cik"), F.when(one.isNotNull(), "LINKED").otherwise("UNRESOLVED").alias("registrant_link_status")
        )

    def _sourced(self, name: str, subject: str, kind: str, *further: str) -> DataFrame:
        """Heads of an attribute table with their source type, stream, evidence level and documentation status."""
        evidence = self.table("evidence.evidence").select(F.col("id").alias("evidence_id"), "evidence_level", F.col("artifact_id").alias("__a"), "locator_type", "column_label", "json_path")
        artifacts = self.table("raw.artifact").select(F.col("id").alias("__a"), "source_type_code", "source_url")
        field = (
            F.when(F.col("locator_type") == "TSV_CELL", F.col("column_label")).when(F.col("locator_type") == "TSV_ROW", "row").when(F.col("locator_type") == "JSON_PATH", tx.source_field(F.col("json_path"))).when(F.col("locator_type") == "HTML_ANCHOR", "link")
        )
        stream = F.when(
            F.col("source_type_code").isin("SEC_SUBMISSIONS_JSON", "SEC_SUBMISSIONS_PAGE_JSON"), F.concat(F.lit("submissions:"), F.nullif(F.regexp_extract("source_url", "/submissions/CIK([0-9]{10})", 1), F.lit("")))
        ).otherwise(F.col("source_url"))
        rows = self.heads(name).join(evidence, "evidence_id").join(artifacts, "__a").withColumn("source_field", field).withColumn("source_stream", stream)
        documented = self.table("ref.registry_field_mapping").where(F.col("target_kind") == kind).select("source_type_code", "source_field", F.col("target_code").alias("attribute_code"), F.col("mapping_status").alias("documentation_status"))
        rows = rows.join(documented, ["source_type_code", "source_field", "attribute_code"], "left")
        return rows.select(F.col("id").alias("observation_id"), subject, "attribute_code", "raw_value", "normalized_value", "source_type_code", "source_stream", "evidence_level", "documentation_status", *further)

    def current_registrant_attribute(self) -> DataFrame:
        return self._sourced("registry.registrant_attribute_observation", "registrant_id", "REGISTRANT_ATTRIBUTE").join(self._registrants(), "registrant_id")

    def current_filing_attribute(self) -> DataFrame:
        filings = self.table("registry.filing").select(F.col("id").alias("filing_id"), "accession_number")
        return self._sourced("registry.filing_attribute_observation", "filing_id", "FILING_ATTRIBUTE", "value_state").join(filings, "filing_id")

    def registrant_attribute_status(self) -> DataFrame:
        current = self.current_registrant_attribute().groupBy("registrant_id", "attribute_code").agg(F.count(F.lit(1)).alias("current_value_count"), states.three_state(F.col("raw_value")).alias("attribute_state"), states.single_value(F.col("raw_value")).alias("value"))
        codes = self.table("ref.registrant_attribute").select(F.col("code").alias("attribute_code"))
        grid = states.status_grid(self._registrants(), codes, current, ["registrant_id", "attribute_code"], "attribute_state")
        return grid.join(current.drop("attribute_state"), ["registrant_id", "attribute_code"], "left").withColumn("current_value_count", F.coalesce("current_value_count", F.lit(0).cast("long")))

    def filing_history(self) -> DataFrame:
        listed = lambda code: F.array_sort(F.collect_set(F.when(F.col("attribute_code") == code, F.col("normalized_value"))))
        attributes = self.current_filing_attribute().groupBy("filing_id").agg(listed("FORM").alias("forms"), listed("FILED_DATE").alias("filed_dates"), F.array_sort(F.collect_set("source_type_code")).alias("source_types"))
        amends = self.heads("current_filing_relationship").where("relationship_type = 'AMENDS'").select("filing_id", F.col("state").alias("amends_decision_state"))
        return self.current_filing_registrant().join(attributes, "filing_id", "left").join(amends, "filing_id", "left")

    def filing_file_number(self) -> DataFrame:
        numbers = self.current_filing_attribute().where("attribute_code = 'FILE_NUMBER'")
        return numbers.select("filing_id", "accession_number", F.col("raw_value").alias("file_number_raw"), F.col("raw_value").rlike("^814-").alias("is_814_file_number"), "source_stream")

    # Portfolios and the market
    def _lines(self) -> DataFrame:
        """Positions of filings that one registrant is linked to."""
        links = self.portfolio_filing_registrant().where("registrant_link_status = 'LINKED'")
        return self.table("obs.position_observation").join(links, "filing_id")

    def portfolio_registrant(self) -> DataFrame:
        told = self.registrant_attribute_status().groupBy("registrant_id").agg(
            *[F.min(F.when(F.col("attribute_code") == c, F.col(x))).alias(f"{c.lower()}_{y}") for c in ("NAME", "TICKER", "FILE_NUMBER") for x, y in (("attribute_state", "state"), ("value", "raw"))]
        )
        dates = self._lines().groupBy("registrant_id", "registrant_cik").agg(F.count_distinct("reported_date").alias("reported_date_count"))
        return dates.join(told, "registrant_id")

    def portfolio_reported_date(self) -> DataFrame:
        counts = [F.count(F.lit(1)).alias("disclosed_line_count"), *[F.count_if(F.coalesce(F.col("duration_kind") == k, F.lit(False))).alias(n) for k, n in (("POINT_IN_TIME", "point_in_time_line_count"), ("DURATION", "duration_line_count"))]]
        return self._lines().where("reported_date is not null").groupBy("registrant_cik", "reported_date").agg(*counts)

    def portfolio_empty_period(self) -> DataFrame:
        empty = self.current_soi_coverage().where("registrant_id is null and source_type_code = 'SEC_BDC_DATASET_ZIP' and coverage_state = 'EMPTY_PERIOD'")
        return empty.join(self.table("registry.dataset_release").withColumnRenamed("id", "dataset_release_id"), "dataset_release_id").select("release_label")

    def market_registrant_coverage(self) -> DataFrame:
        positioned = self._lines().select("registrant_id", F.lit(True).alias("p")).distinct()
        covered = self.current_soi_coverage().where("registrant_id is not null and coverage_state = 'COVERED'").select("registrant_id", F.lit(True).alias("c")).distinct()
        out = self._registrants().join(positioned, "registrant_id", "left").join(covered, "registrant_id", "left")
        return out.select("registrant_id", tx.padded_cik(F.col("cik")).alias("registrant_cik"), states.first_match((F.col("p"), "STORED_LINES"), (F.col("c"), "COVERED_NO_IDENTIFIED_LINE"), otherwise="UNKNOWN").alias("coverage_state"))

    def market_release_coverage(self) -> DataFrame:
        """Per release what was observed in it; an empty release is UNAVAILABLE and has no counts."""
        origins = self.table("obs.soi_row_observation").select(F.col("id").alias("origin_soi_row_observation_id"), "tabular_row_id")
        loads = self.table("raw.tabular_row").select(F.col("id").alias("tabular_row_id"), "table_load_id").join(self.table("raw.table_load").select(F.col("id").alias("table_load_id"), "artifact_id"), "table_load_id")
        releases = self.table("registry.dataset_release_artifact").select("artifact_id", "dataset_release_id")
        rows = self._lines().join(origins, "origin_soi_row_observation_id").join(loads, "tabular_row_id").join(releases, "artifact_id")
        seen = rows.groupBy("dataset_release_id").agg(F.count_distinct("registrant_cik").alias("registrants"), F.count_distinct("reported_date").alias("dates"))
        any_state = lambda s: F.bool_or(F.col("coverage_state") == s)
        told = self.current_soi_coverage().where("registrant_id is null and dataset_release_id is not null").groupBy("dataset_release_id").agg(any_state("EMPTY_PERIOD").alias("empty"), any_state("COVERED").alias("covered"))
        out = self.table("registry.dataset_release").withColumnRenamed("id", "dataset_release_id").join(seen, "dataset_release_id", "left").join(told, "dataset_release_id", "left")
        state = states.first_match((F.col("empty"), "UNAVAILABLE"), (F.col("registrants").isNotNull(), "OBSERVED"), (F.col("covered"), "COVERED_NO_IDENTIFIED_LINE"), otherwise="UNKNOWN")
        return out.select("release_label", state.alias("coverage_state"), *[F.when(state == "OBSERVED", F.col(c)).alias(f"{c}_observed") for c in ("registrants", "dates")])

    def market_reported_date(self) -> DataFrame:
        return self._lines().where("reported_date is not null").groupBy("reported_date").agg(F.count_distinct("registrant_cik").alias("registrants_observed"))

    def market_date_registrant(self, date: dt.date) -> DataFrame:
        """At one date, per registrant how many lines have and lack each of four cells."""
        lines = self._lines().where(F.col("reported_date") == F.lit(date)).select(F.col("id").alias("position_observation_id"), "registrant_cik")
        values = self.heads("current_position_field_value").where("value_state = 'REPORTED'").select("position_observation_id", "field_code")
        return states.cell_presence(lines.join(values, "position_observation_id", "left"), ["position_observation_id"], ["registrant_cik"], {n: F.col("field_code") == c for c, n in COVERED_CELLS.items()})

    # Positions
    def matched_entity_position(self) -> DataFrame:
        """Matched entity of each position that has exactly one extracted identifier name."""
        names = self.heads("current_borrower_name_observation").where((F.col("source_column_label") == NAME_COLUMN) & (F.col("extraction_state") == "EXTRACTED"))
        one = names.groupBy("position_observation_id").agg(states.exactly_one(F.col("id")).alias("borrower_name_observation_id")).where("borrower_name_observation_id is not null")
        matched = self.heads("current_entity_resolution").where("state = 'MATCHED' and legal_entity_id is not null").select("borrower_name_observation_id", "legal_entity_id")
        return matched.join(one, "borrower_name_observation_id").select("legal_entity_id", "position_observation_id")

    def _only_decision(self, name: str, target: str) -> DataFrame:
        """position, target and state where a position has exactly one current decision."""
        d = self.heads(name).groupBy("position_observation_id").agg(states.exactly_one(F.col(target)).alias(target), states.exactly_one(F.col("state")).alias("state"))
        return d.withColumnRenamed("state", f"{target}_state")

    def research_fields(self) -> DataFrame:
        levels = self.table("evidence.evidence").select(F.col("id").alias("evidence_id"), "evidence_level")
        return self.heads("current_position_field_value").where(F.col("field_code").isin("INDUSTRY", "INSTRUMENT_TYPE")).join(levels, "evidence_id").select("position_observation_id", "field_code", "raw_value", "value_state", "evidence_level")

    # Entities
    def canonical_legal_entity(self) -> DataFrame:
        """legal_entity_id, canonical_id, is_cyclic: every entity, itself where nothing leads away from it."""
        decisions = self.table(HEADS["current_legal_entity_consolidation"]).select("id", "supersedes_id", "from_legal_entity_id", "state", F.col("to_legal_entity_id").alias("target"))
        edges = matching.approved_target(chains.current_heads(decisions), decisions, "from_legal_entity_id")
        ends = matching.canonical(edges, "from_legal_entity_id", "target").withColumnRenamed("node", "legal_entity_id")
        out = self.table("identity.legal_entity").select(F.col("id").alias("legal_entity_id")).join(ends, "legal_entity_id", "left")
        cyclic = F.coalesce("is_cyclic", F.lit(False))
        return out.select("legal_entity_id", F.when(~cyclic, F.coalesce("canonical", "legal_entity_id")).alias("canonical_id"), cyclic.alias("is_cyclic"))

    def ambiguous_verified_own_identifier(self) -> DataFrame:
        own = self.heads("current_legal_entity_identifier").where("verification_state = 'VERIFIED' and relationship_role = 'OWN'")
        return own.groupBy("legal_entity_id", "scheme").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def first_observed_events(self) -> DataFrame:
        """All observations at each registrant's earliest date, ties kept; positions of unlinked filings are skipped."""
        return periods.first_observed(self._lines(), ["registrant_id"], "reported_date").select(F.col("id").alias("position_observation_id"), "registrant_id", "reported_date")

    def soi_load_reconciliation(self) -> DataFrame:
        """Per schedule load what was declared, landed, projected and set aside; counts of kinds come from one pass per table."""
        rows = self.table("raw.tabular_row").select(F.col("id").alias("tabular_row_id"), "table_load_id", "parse_status")
        landed = rows.groupBy("table_load_id").agg(F.count_if(F.col("parse_status") == "OK").alias("ok_row_count"))
        seen = self.table("obs.soi_row_observation").join(rows, "tabular_row_id").groupBy("table_load_id").agg(F.count(F.lit(1)).alias("soi_row_observation_count"), F.count("identifier_raw").alias("identifier_row_count"))
        set_aside = self.table("ops.projection_exception").groupBy("table_load_id").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("ORPHAN_ADSH", "orphan_adsh_count"), ("FIELD_COUNT_MISMATCH", "quarantined_mismatch_count"))])
        out = self.table("raw.table_load").where("table_code = 'SOI'").select(F.col("id").alias("table_load_id"), "row_count", "parse_status", F.size("header").alias("header_width"))
        for part in (landed, seen, set_aside):
            out = out.join(part, "table_load_id", "left")
        counts = [c for c in out.columns if c.endswith("_count") and c != "row_count"]
        return out.select(*[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) if c in counts else F.col(c) for c in out.columns])
