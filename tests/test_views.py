"""The model's views over a small made-up evidence set (year 2099)."""

import datetime as dt
from decimal import Decimal

import pytest

from stratalog.plans.positions import WIDE, Positions
from stratalog.plans.views import HEADS

D = dt.date.fromisoformat
CIK = "9999999901"


@pytest.fixture(scope="module")
def evidence(spark):
    frame = spark.createDataFrame
    names = "Investment, Identifier Axis"
    chain = "id long, supersedes_id long, "
    money = lambda i, p, f, v, sup=None, code="USD": (i, sup, p, f, "REPORTED", str(v), Decimal(v), None, "FROM_FILING" if code else "UNKNOWN", code, 1, None, None, None)
    values = [
        money(1, 1, "FAIR_VALUE", 100), money(2, 2, "FAIR_VALUE", 120), money(3, 2, "FAIR_VALUE", 130, sup=2), money(4, 3, "FAIR_VALUE", 50), money(5, 1, "PRINCIPAL_AMOUNT", 10, code=None), money(6, 2, "PRINCIPAL_AMOUNT", 10),
        (7, None, 1, "COST", "UNKNOWN", None, None, None, None, None, 1, None, None, None), (8, None, 2, "MATURITY_DATE", "REPORTED", "3/31/2101", None, D("2101-03-31"), None, None, 1, None, None, None),
        (12, None, 3, "MATURITY_DATE", "REPORTED", "4/2102", None, None, None, None, 1, "MONTH", 2102, 4), money(9, 4, "FAIR_VALUE", 1), money(10, 4, "FAIR_VALUE", 1),
        (11, None, 1, "INDUSTRY", "REPORTED", "Software", None, None, None, None, 1, None, None, None),
    ]
    tables = {
        "ops.run": frame([(1, "LOAD", "a"), (2, "LOAD", "b")], "id long, run_kind string, started_at string"),
        "ops.run_outcome": frame([(1, "SUCCEEDED", "c")], "run_id long, status string, finished_at string"),
        "ops.coverage_assertion": frame(
            [(1, None, None, 1, None, "SEC_BDC_DATASET_ZIP", "SOI_HOLDINGS", "COVERED"), (2, 1, None, 1, None, "SEC_BDC_DATASET_ZIP", "SOI_HOLDINGS", "EMPTY_PERIOD"), (3, None, None, 2, None, "SEC_BDC_DATASET_ZIP", "FILING_METADATA", "COVERED"),
             (4, None, 2, None, None, "SEC_BDC_DATASET_ZIP", "SOI_HOLDINGS", "COVERED"), (5, None, 1, None, None, "SEC_SUBMISSIONS_JSON", "FILING_HISTORY", "COVERED"), (6, None, 1, 2, None, "X", "FILING_METADATA", "COVERED")],
            chain + "registrant_id long, dataset_release_id long, reporting_period_end date, source_type_code string, coverage_aspect string, coverage_state string",
        ),
        "ops.artifact_processing": frame([(1, 1, "LOADED"), (2, 1, "SCHEMA_DRIFT")], "id long, artifact_id long, outcome string"),
        "ops.projection_exception": frame([(1, "ORPHAN_ADSH")], "table_load_id long, kind string"),
        "ref.source_column_mapping": frame([(1, None, "DOCUMENTED"), (2, None, "REJECTED")], chain + "mapping_status string"),
        "ref.registrant_attribute": frame([("NAME",), ("TICKER",), ("FILE_NUMBER",)], "code string"),
        "ref.field_definition": frame([(c, False) for c in ("FAIR_VALUE", "COST")], "field_code string, level2_required boolean"),
        "ref.registry_field_mapping": frame([("SEC_SUBMISSIONS_JSON", "$.\"names\"[*]", "REGISTRANT_ATTRIBUTE", "NAME", "DOCUMENTED")], "source_type_code string, source_field string, target_kind string, target_code string, mapping_status string"),
        "raw.artifact": frame([(1, "SEC_SUBMISSIONS_JSON", f"https://x/submissions/CIK{CIK}.json", 5), (2, "CSV", "https://x/a.csv", 6)], "id long, source_type_code string, source_url string, retrieved_at long"),
        "raw.table_load": frame([(1, 1, "SOI", 3, "OK", ["a", "b"])], "id long, artifact_id long, table_code string, row_count long, parse_status string, header array<string>"),
        "raw.tabular_row": frame([(1, 1, "OK"), (2, 1, "OK"), (3, 1, "FIELD_COUNT_MISMATCH")], "id long, table_load_id long, parse_status string"),
        "evidence.evidence": frame([(1, "L1", 1, "JSON_PATH", None, "$.\"names\"[3]"), (2, "L1", 2, "TSV_CELL", "Form", None)], "id long, evidence_level string, artifact_id long, locator_type string, column_label string, json_path string"),
        "registry.registrant": frame([(1, 9999999901), (2, 9999999902), (3, 9999999903)], "id long, cik long"),
        "registry.filing": frame([(1, "A1"), (2, "A2"), (3, "A3"), (4, "A4")], "id long, accession_number string"),
        "registry.filing_registrant_link": frame([(1, None, 1, 1, "SUB"), (2, None, 1, 1, "JSON"), (3, None, 2, 1, "SUB"), (4, None, 3, 1, "SUB"), (5, None, 3, 2, "JSON")], chain + "filing_id long, registrant_id long, link_source string"),
        "registry.filing_relationship_decision": frame([(1, None, 1, "AMENDS", "UNRESOLVED")], chain + "filing_id long, relationship_type string, state string"),
        "registry.registrant_attribute_observation": frame([(1, None, 1, "NAME", "Old", "Old", 1), (2, 1, 1, "NAME", "Nim", "Nim", 1), (3, None, 1, "TICKER", "N", "N", 1), (4, None, 1, "TICKER", "M", "M", 2)], chain + "registrant_id long, attribute_code string, raw_value string, normalized_value string, evidence_id long"),
        "registry.filing_attribute_observation": frame([(1, None, 1, "FORM", "10-K", "10-K", 1, "REPORTED"), (2, None, 1, "FORM", "10-Q", "10-Q", 2, "REPORTED"), (3, None, 1, "FILE_NUMBER", "814-1", None, 1, "REPORTED")], chain + "filing_id long, attribute_code string, raw_value string, normalized_value string, evidence_id long, value_state string"),
        "registry.filing_document": frame([(1, 1, "https://www.sec.gov/Archives/edgar/data/1.htm", "1.htm", "INDEX")], "id long, filing_id long, document_url string, document_name string, named_by string"),
        "registry.filing_document_artifact": frame([(1, 1)], "filing_document_id long, artifact_id long"),
        "obs.maturity_inspection": frame([(1, None, 1, "FILING_DISPLAYED", "shown", D("2101-03-31"), None, None, 1, None), (2, None, 3, "FILING_MONTH", "other", None, 2102, 5, 1, None)], chain + "position_observation_id long, inspection_state string, raw_value string, normalized_date date, displayed_year int, displayed_month int, evidence_id long, no_bind_reason string"),
        "resolution.group_membership_decision": frame([(1, None, "E", "G", "MATCHED")], chain + "legal_entity_id string, economic_group_id string, state string"),
        "registry.bdc_report_edition": frame([(1, "https://x/a.csv"), (2, f"https://x/submissions/CIK{CIK}.json"), (3, "https://x/none.csv")], "id long, csv_url string"),
        "registry.dataset_release": frame([(1, "2099_01"), (2, "2099_02"), (3, "2099_03")], "id long, release_label string"),
        "registry.dataset_release_artifact": frame([(2, 1)], "dataset_release_id long, artifact_id long"),
        "registry.dataset_release_listing": frame([(2,), (2,)], "dataset_release_id long"),
        "obs.soi_row_observation": frame([(1, 1, "Nim"), (2, 2, None)], "id long, tabular_row_id long, identifier_raw string"),
        "obs.position_observation": frame([(1, 1, D("2099-03-31"), "POINT_IN_TIME", 1, "a", 1), (2, 2, D("2099-06-30"), "POINT_IN_TIME", 2, "b", 1), (3, 2, D("2099-06-30"), "DURATION", 2, "c", 1), (4, 3, D("2099-03-31"), "DURATION", 1, "d", 1), (5, 2, None, None, 1, "e", 1)], "id long, filing_id long, reported_date date, duration_kind string, origin_soi_row_observation_id long, holding_descriptor_raw string, evidence_id long"),
        "obs.position_field_value": frame(values, chain + "position_observation_id long, field_code string, value_state string, raw_value string, normalized_numeric decimal(38,10), normalized_date date, currency_state string, currency_code string, evidence_id long, date_precision string, normalized_year int, normalized_month int").selectExpr("*", "'STATED' as scale_state", "cast(null as long) as column_mapping_id", "field_code as source_column_label"),
        "obs.borrower_name_observation": frame([(1, None, 1, names, "EXTRACTED", "Nim"), (2, None, 2, names, "EXTRACTED", "Nim"), (3, None, 3, names, "EXTRACTED", "x"), (4, None, 3, names, "EXTRACTED", "y")], chain + "position_observation_id long, source_column_label string, extraction_state string, normalized_text string"),
        "validation.evidence_status_assertion": frame([(1, None, 1, "FILING_VERIFIED", 9)], chain + "field_value_id long, evidence_status string, validation_result_id long"),
        "resolution.entity_resolution_decision": frame([(1, None, 1, "MATCHED", "E"), (2, None, 2, "MATCHED", "E"), (3, None, 3, "MATCHED", "E"), (4, None, 4, "UNRESOLVED", None)], chain + "borrower_name_observation_id long, state string, legal_entity_id string"),
        "resolution.instrument_resolution_decision": frame([(i, None, i, "MATCHED", f"I{min(i, 2)}") for i in (1, 2, 3)], chain + "position_observation_id long, state string, instrument_id string"),
        "resolution.position_continuity_decision": frame([(1, None, 1, "MATCHED", "P"), (2, None, 2, "MATCHED", "P"), (3, None, 3, "MATCHED", "Q")], chain + "position_observation_id long, state string, position_id string"),
        "resolution.legal_entity_consolidation_decision": frame([(1, None, "A", "MATCHED", "B"), (2, 1, "A", "PROBABLE", "C"), (3, None, "B", "MATCHED", "C"), (4, None, "X", "MATCHED", "Y"), (5, None, "Y", "MATCHED", "X"), (6, None, "C", "REJECTED", None)], chain + "from_legal_entity_id string, state string, to_legal_entity_id string"),
        "identity.legal_entity": frame([(x,) for x in "ABCXYZ"], "id string"),
        "identity.legal_entity_identifier": frame([(1, None, "A", "LEI", "VERIFIED", "OWN"), (2, None, "A", "LEI", "VERIFIED", "OWN"), (3, 2, "A", "LEI", "VERIFIED", "OWN"), (4, None, "B", "LEI", "VERIFIED", "OWN")], chain + "legal_entity_id string, scheme string, verification_state string, relationship_role string"),
    }
    return Positions(tables.__getitem__)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_runs_and_coverage(evidence):
    assert rows(evidence.current_run_status(), "run_id", "status") == [(1, "SUCCEEDED"), (2, "STARTED")]
    assert rows(evidence.current_soi_coverage(), "id", "is_covered") == [(2, False), (4, True)]
    assert rows(evidence.current_column_mapping(), "id", "may_feed_derived_values") == [(1, True), (2, False)]
    assert rows(evidence.dataset_release_status()) == [(1, "2099_01", 0, 0, "UNKNOWN", False), (2, "2099_02", 1, 2, "COVERED", True), (3, "2099_03", 0, 0, "UNKNOWN", False)]
    assert rows(evidence.registrant_coverage(), "registrant_id", "filing_history_coverage", "covered_release_count") == [(1, "COVERED", 1), (2, "UNKNOWN", 0), (3, "UNKNOWN", 0)]
    assert rows(evidence.edition_status(), "edition_id", "edition_state") == [(1, "NOT_RETRIEVED"), (2, "SCHEMA_DRIFT"), (3, "NOT_RETRIEVED")]
    assert rows(evidence.current_evidence_status(), "field_value_id", "evidence_status")[0] == (1, "FILING_VERIFIED")


def test_filings(evidence):
    assert rows(evidence.current_filing_registrant(), "filing_id", "registrant_link_status") == [(1, "LINKED"), (1, "LINKED"), (2, "LINKED"), (3, "MULTIPLE"), (3, "MULTIPLE"), (4, "UNKNOWN")]
    assert rows(evidence.portfolio_filing_registrant()) == [(1, 1, CIK, "LINKED"), (2, 1, CIK, "LINKED")]
    assert rows(evidence.current_registrant_attribute().where("attribute_code = 'NAME'"), "raw_value", "source_stream", "documentation_status") == [("Nim", f"submissions:{CIK}", "DOCUMENTED")]
    status = {(r[0], r[1]): r[2:] for r in rows(evidence.registrant_attribute_status(), "registrant_id", "attribute_code", "attribute_state", "current_value_count", "value")}
    assert status[1, "NAME"] == ("REPORTED", 1, "Nim") and status[1, "TICKER"] == ("MULTIPLE_VALUES", 2, None) and status[2, "NAME"] == ("UNKNOWN", 0, None) and len(status) == 9
    history = [r for r in rows(evidence.filing_history(), "filing_id", "forms", "source_types", "amends_decision_state") if r[0] == 1]
    assert history[0] == (1, ["10-K", "10-Q"], ["CSV", "SEC_SUBMISSIONS_JSON"], "UNRESOLVED") and len(history) == 2
    assert rows(evidence.filing_file_number(), "file_number_raw", "is_814_file_number") == [("814-1", True)]


def test_portfolio_and_market(evidence):
    assert rows(evidence.portfolio_registrant(), "registrant_cik", "reported_date_count", "name_state", "name_raw", "ticker_state", "ticker_raw", "file_number_state") == [(CIK, 2, "REPORTED", "Nim", "MULTIPLE_VALUES", None, "UNKNOWN")]
    assert rows(evidence.portfolio_reported_date()) == [(CIK, D("2099-03-31"), 1, 1, 0), (CIK, D("2099-06-30"), 2, 1, 1)]
    assert rows(evidence.portfolio_empty_period()) == [("2099_01",)]
    assert rows(evidence.market_registrant_coverage(), "registrant_id", "coverage_state") == [(1, "STORED_LINES"), (2, "COVERED_NO_IDENTIFIED_LINE"), (3, "UNKNOWN")]
    assert rows(evidence.market_release_coverage()) == [("2099_01", "UNAVAILABLE", None, None), ("2099_02", "OBSERVED", 1, 2), ("2099_03", "UNKNOWN", None, None)]
    assert rows(evidence.market_reported_date()) == [(D("2099-03-31"), 1), (D("2099-06-30"), 1)]
    got = evidence.market_date_registrant(D("2099-06-30")).first().asDict()
    assert (got["with_fair_value"], got["without_fair_value"], got["with_principal"], got["without_principal"], got["with_cost"], got["with_maturity"]) == (2, 0, 1, 1, 0, 2)
    assert rows(evidence.first_observed_events(), "position_observation_id") == [(1,)]
    assert evidence.soi_load_reconciliation().first().asDict() == {"table_load_id": 1, "row_count": 3, "parse_status": "OK", "header_width": 2, "ok_row_count": 2, "soi_row_observation_count": 2, "identifier_row_count": 1, "orphan_adsh_count": 1, "quarantined_mismatch_count": 0}


def test_positions(evidence):
    assert rows(evidence.matched_entity_position()) == [("E", 1), ("E", 2)]
    read = {r.position_observation_id: r for r in evidence.position_read().collect()}
    assert set(read) == {1, 2, 3, 4, 5} and read[2].fair_value_numeric == 130 and read[4].fair_value_state == "MULTIPLE_VALUES" and read[4].fair_value_numeric is None
    assert read[1].cost_state == "UNKNOWN" and read[5].principal_state == "UNKNOWN" and read[2].maturity_date == D("2101-03-31") and read[4].registrant_cik is None
    assert all(f"{n}_state" in read[1].asDict() for n in WIDE.values()) and (read[1].economic_group_id, read[1].borrower_name_raw, read[3].name_count, read[3].borrower_name_raw) == ("G", "Nim", 2, None)
    one = evidence.position_period_comparison().first().asDict()
    assert (one["earlier_id"], one["later_id"], one["fair_value_delta"], one["fair_value_changed"]) == (1, 2, 30, True)
    assert one["principal_comparison"] == one["cost_comparison"] == "INSUFFICIENT_DATA" and one["principal_delta"] is None
    assert (one["maturity_comparison"], one["maturity_changed"]) == ("COMPARABLE", False)
    assert evidence.borrower_comparisons("E").count() == 1 and evidence.borrower_comparisons("F").count() == 0
    assert evidence.borrower_position_valuation("E").first()["fair_value_change_percent"] == Decimal("30.000000")
    changes = ("change_type", "position_id", "earlier_id", "later_id")
    assert rows(evidence.portfolio_period_changes(CIK, D("2099-03-31"), D("2099-06-30")), *changes) == [("EXISTING_POSITION_CHANGED", "P", 1, 2), ("NEW_POSITION_OBSERVED", "Q", None, 3)]
    with pytest.raises(ValueError):
        evidence.portfolio_period_changes(CIK, D("2099-06-30"), D("2099-03-31"))
    summary = evidence.portfolio_summary(CIK, D("2099-06-30")).first().asDict()
    assert (summary["observation_count"], summary["principal_aggregation_state"], summary["fair_value_aggregation_state"], summary["fair_value_total"], summary["fair_value_currency_code"]) == (2, "INSUFFICIENT_DATA", "COMPARABLE", 180, "USD")
    assert rows(evidence.portfolio_holdings(CIK, D("2099-06-30")), "position_observation_id") == [(2,), (3,)]
    with pytest.raises(ValueError):
        evidence.portfolio_scope("1", D("2099-06-30"))
    assert rows(evidence.research_fields(), "position_observation_id", "raw_value") == [(1, "Software")]
    grid = {(r[0], r[1]): r[2] for r in rows(evidence.position_field_status(), "position_observation_id", "field_code", "value_state")}
    assert len(grid) == 10 and grid[1, "COST"] == "UNKNOWN" and grid[1, "FAIR_VALUE"] == "REPORTED" and grid[5, "FAIR_VALUE"] == "UNKNOWN" and grid[4, "FAIR_VALUE"] == "REPORTED"


def test_maturity(evidence):
    got = {r.position_observation_id: (r.maturity_source, r.maturity_date, r.maturity_precision, r.filing_verified) for r in evidence.maturity_read().collect()}
    # Shown in the filing only; structured only; a month that the filing shows otherwise; nothing at all.
    assert got[1] == ("FILING_DISPLAYED", D("2101-03-31"), None, False) and got[2] == ("REPORTED_STRUCTURED", D("2101-03-31"), None, False) and got[3] == ("UNRESOLVED", None, None, False) and got[5] == ("UNKNOWN", None, None, False)
    assert rows(evidence.maturity_year()) == [(CIK, D("2099-03-31"), 2101, 1), (CIK, D("2099-06-30"), 2101, 1)]
    with pytest.raises(ValueError):
        evidence.maturity_line_count(CIK, D("2099-06-30"), "year")


def test_changes_need_comparable_neighbours(spark):
    """A value that was unknown, another currency, and a date in between are no change."""
    day = {1: D("2099-03-31"), 2: D("2099-06-30"), 3: D("2099-09-30")}
    read = [
        ("null", 1, 1, None, "USD"), ("null", 2, 2, 5, "USD"), ("currency", 3, 1, 5, "USD"), ("currency", 4, 2, 6, "EUR"), ("between", 5, 1, 5, "USD"), ("between", 6, 2, 5, "USD"), ("between", 7, 3, 9, "USD"),
        ("changed", 8, 1, 5, "USD"), ("changed", 9, 2, 6, "USD"), ("several", 10, 1, 5, "USD"), ("several", 11, 2, 6, "USD"), ("several", 12, 2, 7, "USD"), ("new", 13, 2, 1, "USD"), ("gone", 14, 1, 1, "USD"), ("same", 15, 1, 5, "USD"), ("same", 16, 2, 5, "USD"),
    ]
    df = spark.createDataFrame([(p, i, day[d], None if v is None else Decimal(v), c) for p, i, d, v, c in read], "position_id string, position_observation_id long, reported_date date, v decimal(38,10), c string")
    amounts = [x for n in ("principal", "cost", "fair_value") for x in ((f"'REPORTED' as {n}_state"), f"string(v) as {n}_raw", f"v as {n}_numeric", f"'FROM_FILING' as {n}_currency_state", f"c as {n}_currency_code")]
    rates = [x for n in ("interest_rate", "spread", "interest_rate_floor") for x in (f"'UNKNOWN' as {n}_state", f"string(null) as {n}_raw", f"decimal(null) as {n}_numeric")]
    dates = [x for n in ("maturity", "acquisition") for x in (f"string(null) as {n}_raw", f"date(null) as {n}_date", f"string(null) as {n}_precision", f"int(null) as {n}_year", f"int(null) as {n}_month")]
    wide = df.selectExpr("*", *amounts, *rates, *dates, "'UNKNOWN' as maturity_source", "'UNKNOWN' as acquisition_state", "'A' as accession_number", f"'{CIK}' as registrant_cik", "'E' as legal_entity_id", "'I' as instrument_id", "'MATCHED' as instrument_resolution_state", "'MATCHED' as continuity_state")
    model = Positions({}.__getitem__)
    model.position_read = lambda: wide
    assert rows(model.portfolio_period_changes(CIK, day[1], day[2]), "change_type", "position_id") == [("EXISTING_POSITION_CHANGED", "changed"), ("NEW_POSITION_OBSERVED", "new"), ("POSITION_NO_LONGER_OBSERVED", "gone")]
    assert ("EXISTING_POSITION_CHANGED", "between") not in rows(model.portfolio_period_changes(CIK, day[1], day[3]), "change_type", "position_id")
    summary = model.portfolio_period_summary(CIK, day[1], day[2]).first().asDict()
    assert (summary["both_dates_count"], summary["several_rows_count"], summary["new_count"], summary["changed_count"]) == (6, 1, 1, 1)


def test_entities_and_heads(evidence):
    assert rows(evidence.canonical_legal_entity()) == [("A", "C", False), ("B", "C", False), ("C", "C", False), ("X", None, True), ("Y", None, True), ("Z", "Z", False)]
    assert rows(evidence.ambiguous_verified_own_identifier()) == [("A", "LEI", 2)]
    assert rows(evidence.heads("current_legal_entity_consolidation"), "id") == [(2,), (3,), (4,), (5,), (6,)]
    assert len(HEADS) == 11
