"""Every view of the evidence model as a registered query over the tables that `evidence_tables` makes, with its SQL.

Parameterised views are asked for one registrant, two dates and one entity that the data names itself (the most frequent ones), found by
a query on either side. The SQL is written as views on views in plain DuckDB, with correlated subqueries where that says it best.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from stratalog.plans.evidence_tables import tables, with_sql
from stratalog.plans.positions import AMOUNTS, DOCUMENT_PREFIX, INLINE_PREFIX, LINE_TEXTS, RATES, WIDE
from stratalog.plans.readers import Readers
from stratalog.plans.reference import quotient
from stratalog.plans.views import COVERED_CELLS, HEADS

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
_READ = ["reported_date", *[f"{n}_numeric" for n in (*AMOUNTS, *RATES)], "acquisition_date", "maturity_date"]
_PAIR = ["earlier_date", "later_date"]
_COMPARED = [*_PAIR, *[f"{p}{n}_{x}" for n in (*AMOUNTS, *RATES) for p, x in (("", "delta"), ("e_", "numeric"), ("l_", "numeric"))], *[f"{p}_{n}_date" for p in "el" for n in ("maturity", "acquisition")]]
#: Days and decimals, which both sides give as text.
TEXTS = {
    **dict.fromkeys(["portfolio_reported_date", "market_reported_date", "market_release_date", "portfolio_detail_dates", "maturity_reported_date", "maturity_coverage", "maturity_year", "maturity_years", "borrower_observation_listing", "first_observed_events"], ["reported_date"]),
    **dict.fromkeys(["maturity_provenance", "maturity_read", "maturity_position", "maturity_position_for_cik", "portfolio_line", "maturity_line", "maturity_line_page"], ["reported_date", "maturity_date"]),
    **dict.fromkeys(["position_read", "borrower_position_observations", "portfolio_scope", "portfolio_holdings"], _READ),
    **dict.fromkeys(["position_period_comparison", "borrower_comparisons", "borrower_valuation_period_comparison"], _COMPARED),
    **dict.fromkeys(["borrower_maturity_observations", "borrower_maturity_page"], ["reported_date", "maturity_date", "principal_numeric", "fair_value_numeric"]),
    **dict.fromkeys(["borrower_maturity_years", "portfolio_summary"], ["principal_total", "fair_value_total"]),
    **dict.fromkeys(["current_coverage", "current_soi_coverage"], ["reporting_period_end"]),
    "current_position_field_value": ["normalized_numeric", "normalized_date"],
    "current_maturity_inspection": ["normalized_date"],
    "borrower_position_valuation": [*_PAIR, "fair_value_delta", "fair_value_change_percent", "fair_value_to_principal", "fair_value_to_cost"],
    "borrower_refinancing_outcomes": [*_PAIR, "event_date"],
    "portfolio_period_changes": ["principal_delta", "cost_delta", "fair_value_delta"],
    **dict.fromkeys(["comparison_fields", "amount_review_fields"], _PAIR),
    **dict.fromkeys(["borrower_detail", "position_groups"], ["first_date", "last_date"]),
    "comparison_availability": ["latest_date"],
    "borrowers": ["latest_reported_date", "latest_date"],
    "historical_positions": ["reported_date"],
    "valuation_history": ["later_date"],
    "maturity_wall": ["reported_date"],
}
VIEWS: dict[str, str] = {}
#: Fixed value: the entity that parameterised queries ask for; the made tables give every entity some names.
ENTITY, LABEL = "N07", "2099_20"


def _model(spark, sf) -> Readers:
    return Readers(tables(spark, sf))


def view(name: str, sql: str, call: Callable | None = None, columns: list[str] | None = None) -> None:
    """Register the method `name` as query model_<name>, and sql as view v_<name>. columns: what is compared, in place of all."""

    def run(spark, sf):
        df = call(_model(spark, sf), spark, sf) if call else getattr(_model(spark, sf), name)()
        return df.select(*[F.col(c).cast("string").alias(c) if c in texts else F.col(c) for c in columns or df.columns])

    texts = TEXTS.get(name, [])
    replaced = f" REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in texts)})" if texts else ""
    VIEWS[f"v_{name}"] = sql
    QUERIES[f"model_{name}"] = run
    SQL[f"model_{name}"] = f"SELECT {', '.join(columns) if columns else '*' + replaced} FROM v_{name}"


def _heads(name: str) -> str:
    t = name.replace(".", "_")
    return f"SELECT h.* FROM {t} h WHERE NOT EXISTS (SELECT 1 FROM {t} s WHERE s.supersedes_id = h.id)"


for _name, _table in HEADS.items():
    view(_name, _heads(_table), lambda m, spark, sf, n=_name: m.heads(n))
VIEWS |= {f"h_{n.replace('.', '_')}": _heads(n) for n in ("ops.coverage_assertion", "ref.source_column_mapping", "validation.evidence_status_assertion", "registry.filing_registrant_link", "registry.registrant_attribute_observation", "registry.filing_attribute_observation")}


# The registrant with most lines and the two dates with most of them -------------------------------------------------
def _asked(spark, sf) -> tuple:
    """cik and two dates: those of the SQL view v_asked, found by one small aggregation each."""
    rows = _model(spark, sf).maturity_position().where("reported_date is not null").groupBy("registrant_cik", "reported_date").agg(F.count(F.lit(1)).alias("n"))
    cik = rows.groupBy("registrant_cik").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "registrant_cik").first()["registrant_cik"]
    dates = sorted(r["reported_date"] for r in rows.where(F.col("registrant_cik") == cik).orderBy(F.desc("n"), "reported_date").limit(2).collect())
    return cik, dates[0], dates[-1]


VIEWS["v_asked_rows"] = "SELECT registrant_cik, reported_date, count(*) AS n FROM obs_position_observation p JOIN v_portfolio_filing_registrant l USING (filing_id) WHERE l.registrant_link_status = 'LINKED' AND reported_date IS NOT NULL GROUP BY ALL"
VIEWS["v_asked_cik"] = "SELECT registrant_cik FROM v_asked_rows GROUP BY registrant_cik ORDER BY sum(n) DESC, registrant_cik LIMIT 1"
VIEWS["v_asked"] = "SELECT registrant_cik AS cik, min(reported_date) AS earlier, max(reported_date) AS later FROM (SELECT * FROM v_asked_rows WHERE registrant_cik = (FROM v_asked_cik) ORDER BY n DESC, reported_date LIMIT 2) GROUP BY 1"


def asked(name: str, sql: str, call: Callable, columns: list[str] | None = None) -> None:
    """view for a method that takes the registrant and the dates."""
    view(name, sql, lambda m, spark, sf: call(m, *_asked(spark, sf)), columns)


# Runs, coverage, mappings -------------------------------------------------------------------------------------------
view("current_run_status", "SELECT r.id AS run_id, run_kind, started_at, coalesce(o.status, 'STARTED') AS status, o.finished_at FROM ops_run r LEFT JOIN ops_run_outcome o ON o.run_id = r.id", columns=["run_id", "run_kind", "status"])
view("current_coverage", "SELECT *, coverage_state = 'COVERED' AS is_covered FROM h_ops_coverage_assertion")
view("current_soi_coverage", "SELECT * FROM v_current_coverage WHERE coverage_aspect = 'SOI_HOLDINGS'")
view("current_column_mapping", "SELECT *, mapping_status IN ('DOCUMENTED', 'DOCUMENTED_AND_OBSERVED') AS may_feed_derived_values FROM h_ref_source_column_mapping")
view("current_evidence_status", "SELECT v.id AS field_value_id, coalesce(s.evidence_status, 'NOT_CHECKED') AS evidence_status, s.validation_result_id FROM v_current_position_field_value v LEFT JOIN h_validation_evidence_status_assertion s ON s.field_value_id = v.id")
view(
    "dataset_release_status",
    """SELECT d.id AS dataset_release_id, release_label, (SELECT count(*) FROM registry_dataset_release_artifact a WHERE a.dataset_release_id = d.id) AS artifact_count, (SELECT count(*) FROM registry_dataset_release_listing l WHERE l.dataset_release_id = d.id) AS page_listing_count,
  coalesce(c.coverage_state, 'UNKNOWN') AS filing_metadata_coverage, coalesce(c.is_covered, false) AS is_covered
FROM registry_dataset_release d LEFT JOIN v_current_coverage c ON c.dataset_release_id = d.id AND c.registrant_id IS NULL AND c.coverage_aspect = 'FILING_METADATA' AND c.source_type_code = 'SEC_BDC_DATASET_ZIP'""",
)
view(
    "registrant_coverage",
    """SELECT r.id AS registrant_id, cik, coalesce(c.coverage_state, 'UNKNOWN') AS filing_history_coverage, (SELECT count(*) FROM v_current_coverage m WHERE m.registrant_id = r.id AND m.coverage_aspect = 'FILING_METADATA' AND m.is_covered) AS covered_release_count
FROM registry_registrant r LEFT JOIN v_current_coverage c ON c.registrant_id = r.id AND c.coverage_aspect = 'FILING_HISTORY' AND c.dataset_release_id IS NULL AND c.reporting_period_end IS NULL AND c.source_type_code = 'SEC_SUBMISSIONS_JSON'""",
)
view(
    "edition_status",
    """WITH t AS (SELECT source_url, retrieved_at, a.id AS artifact_id, p.id AS p, outcome FROM raw_artifact a LEFT JOIN ops_artifact_processing p ON p.artifact_id = a.id QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY retrieved_at DESC, a.id DESC, p.id DESC NULLS LAST) = 1)
SELECT e.id AS edition_id, csv_url, artifact_id, coalesce(outcome, 'NOT_RETRIEVED') AS edition_state FROM registry_bdc_report_edition e LEFT JOIN t ON t.source_url = e.csv_url""",
)
# Filings and registrants --------------------------------------------------------------------------------------------
view(
    "current_filing_registrant",
    """SELECT f.id AS filing_id, accession_number, l.registrant_id, r.cik, l.link_source,
  CASE WHEN l.id IS NULL THEN 'UNKNOWN' WHEN (SELECT count(DISTINCT x.registrant_id) FROM h_registry_filing_registrant_link x WHERE x.filing_id = f.id) > 1 THEN 'MULTIPLE' ELSE 'LINKED' END AS registrant_link_status
FROM registry_filing f LEFT JOIN h_registry_filing_registrant_link l ON l.filing_id = f.id LEFT JOIN registry_registrant r ON r.id = l.registrant_id""",
)
view("portfolio_filing_registrant", "SELECT filing_id, CASE WHEN count(DISTINCT registrant_id) = 1 THEN min(registrant_id) END AS registrant_id, CASE WHEN count(DISTINCT cik) = 1 THEN lpad(min(cik)::VARCHAR, 10, '0') END AS registrant_cik, CASE WHEN count(DISTINCT cik) = 1 THEN 'LINKED' ELSE 'UNRESOLVED' END AS registrant_link_status FROM v_current_filing_registrant WHERE registrant_link_status = 'LINKED' GROUP BY filing_id")
_SOURCED = """SELECT o.id AS observation_id, o.{subject}, o.attribute_code, raw_value, normalized_value, x.source_type_code, source_stream, evidence_level, m.mapping_status AS documentation_status{further}
FROM {heads} o JOIN v_sources x ON x.id = o.evidence_id LEFT JOIN ref_registry_field_mapping m ON m.target_kind = '{kind}' AND m.source_type_code = x.source_type_code AND m.source_field = x.source_field AND m.target_code = o.attribute_code"""
VIEWS["v_sources"] = """SELECT e.id, e.evidence_level, a.source_type_code, CASE locator_type WHEN 'TSV_CELL' THEN column_label WHEN 'TSV_ROW' THEN 'row' WHEN 'JSON_PATH' THEN regexp_replace(json_path, '\\[[0-9]+\\]', '[*]', 'g') WHEN 'HTML_ANCHOR' THEN 'link' END AS source_field,
  CASE WHEN a.source_type_code IN ('SEC_SUBMISSIONS_JSON', 'SEC_SUBMISSIONS_PAGE_JSON') THEN 'submissions:' || nullif(regexp_extract(a.source_url, '/submissions/CIK([0-9]{10})', 1), '') ELSE a.source_url END AS source_stream
FROM evidence_evidence e JOIN raw_artifact a ON a.id = e.artifact_id"""
view("current_registrant_attribute", f"SELECT o.*, cik FROM ({_SOURCED.format(subject='registrant_id', heads='h_registry_registrant_attribute_observation', kind='REGISTRANT_ATTRIBUTE', further='')}) o JOIN registry_registrant r ON r.id = o.registrant_id")
view("current_filing_attribute", f"SELECT o.*, accession_number FROM ({_SOURCED.format(subject='filing_id', heads='h_registry_filing_attribute_observation', kind='FILING_ATTRIBUTE', further=', o.value_state')}) o JOIN registry_filing f ON f.id = o.filing_id")
view(
    "registrant_attribute_status",
    """SELECT r.id AS registrant_id, r.cik, a.code AS attribute_code, CASE count(DISTINCT c.raw_value) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'REPORTED' ELSE 'MULTIPLE_VALUES' END AS attribute_state, count(c.observation_id) AS current_value_count, CASE WHEN count(DISTINCT c.raw_value) = 1 THEN min(c.raw_value) END AS value
FROM registry_registrant r CROSS JOIN ref_registrant_attribute a LEFT JOIN v_current_registrant_attribute c ON c.registrant_id = r.id AND c.attribute_code = a.code GROUP BY ALL""",
)
view(
    "filing_history",
    """SELECT r.*, a.forms, a.filed_dates, a.source_types, d.state AS amends_decision_state FROM v_current_filing_registrant r
LEFT JOIN (SELECT filing_id, coalesce(list_sort(list(DISTINCT normalized_value) FILTER (attribute_code = 'FORM' AND normalized_value IS NOT NULL)), []) AS forms, coalesce(list_sort(list(DISTINCT normalized_value) FILTER (attribute_code = 'FILED_DATE' AND normalized_value IS NOT NULL)), []) AS filed_dates,
  list_sort(list(DISTINCT source_type_code)) AS source_types FROM v_current_filing_attribute GROUP BY filing_id) a USING (filing_id)
LEFT JOIN v_current_filing_relationship d ON d.filing_id = r.filing_id AND d.relationship_type = 'AMENDS'""",
)
view("filing_file_number", "SELECT filing_id, accession_number, raw_value AS file_number_raw, raw_value LIKE '814-%' AS is_814_file_number, source_stream FROM v_current_filing_attribute WHERE attribute_code = 'FILE_NUMBER'")
view("admin_filing_registrant", "SELECT f.*, s.attribute_state AS name_state, s.value AS name_raw FROM v_current_filing_registrant f LEFT JOIN v_registrant_attribute_status s ON s.registrant_id = f.registrant_id AND s.attribute_code = 'NAME'")
view("admin_filing_document", "SELECT d.filing_id, accession_number, d.id AS filing_document_id, document_name, document_url, named_by, EXISTS (SELECT 1 FROM registry_filing_document_artifact a WHERE a.filing_document_id = d.id) AS artifact_linked FROM registry_filing_document d JOIN registry_filing f ON f.id = d.filing_id")
view("admin_filing_artifact", "SELECT d.filing_id, d.accession_number, filing_document_id, document_name, document_url, a.id AS artifact_id, source_url, source_type_code, retrieved_at FROM v_admin_filing_document d JOIN registry_filing_document_artifact l USING (filing_document_id) JOIN raw_artifact a ON a.id = l.artifact_id")
view("admin_filing_processing", "SELECT DISTINCT filing_id, accession_number, artifact_id, p.id AS artifact_processing_id, outcome FROM v_admin_filing_artifact JOIN ops_artifact_processing p USING (artifact_id)")
view("located_value", "SELECT id AS evidence_id, artifact_id, CASE locator_type WHEN 'TSV_CELL' THEN row_number IS NOT NULL AND column_label IS NOT NULL WHEN 'JSON_PATH' THEN json_path IS NOT NULL ELSE false END AS checkable, CASE WHEN locator_type = 'TSV_CELL' THEN row_number || ':' || column_label WHEN locator_type = 'JSON_PATH' THEN json_path END AS place FROM evidence_evidence")

# Portfolios and the market ------------------------------------------------------------------------------------------
VIEWS["v_lines"] = "SELECT p.*, registrant_id, registrant_cik FROM obs_position_observation p JOIN v_portfolio_filing_registrant l USING (filing_id) WHERE registrant_link_status = 'LINKED'"
_ATTRIBUTES = ", ".join(f"min(attribute_state) FILTER (attribute_code = '{c}') AS {c.lower()}_state, min(value) FILTER (attribute_code = '{c}') AS {c.lower()}_raw" for c in ("NAME", "TICKER", "FILE_NUMBER"))
view("portfolio_registrant", f"SELECT l.*, s.* EXCLUDE (registrant_id) FROM (SELECT registrant_id, registrant_cik, count(DISTINCT reported_date) AS reported_date_count FROM v_lines GROUP BY ALL) l JOIN (SELECT registrant_id, {_ATTRIBUTES} FROM v_registrant_attribute_status GROUP BY 1) s USING (registrant_id)")
view("portfolio_reported_date", "SELECT registrant_cik, reported_date, count(*) AS disclosed_line_count, count(*) FILTER (duration_kind = 'POINT_IN_TIME') AS point_in_time_line_count, count(*) FILTER (duration_kind = 'DURATION') AS duration_line_count FROM v_lines WHERE reported_date IS NOT NULL GROUP BY ALL")
view("portfolio_empty_period", "SELECT release_label FROM v_current_soi_coverage c JOIN registry_dataset_release d ON d.id = c.dataset_release_id WHERE registrant_id IS NULL AND source_type_code = 'SEC_BDC_DATASET_ZIP' AND coverage_state = 'EMPTY_PERIOD'")
view("market_registrant_coverage", "SELECT id AS registrant_id, lpad(cik::VARCHAR, 10, '0') AS registrant_cik, CASE WHEN EXISTS (SELECT 1 FROM v_lines l WHERE l.registrant_id = r.id) THEN 'STORED_LINES' WHEN EXISTS (SELECT 1 FROM v_current_soi_coverage c WHERE c.registrant_id = r.id AND c.coverage_state = 'COVERED') THEN 'COVERED_NO_IDENTIFIED_LINE' ELSE 'UNKNOWN' END AS coverage_state FROM registry_registrant r")
VIEWS["v_released_lines"] = "SELECT l.*, a.dataset_release_id FROM v_lines l JOIN obs_soi_row_observation o ON o.id = l.origin_soi_row_observation_id JOIN raw_tabular_row t ON t.id = o.tabular_row_id JOIN raw_table_load d ON d.id = t.table_load_id JOIN registry_dataset_release_artifact a ON a.artifact_id = d.artifact_id"
view(
    "market_release_coverage",
    """WITH s AS (SELECT dataset_release_id, count(DISTINCT registrant_cik) AS r, count(DISTINCT reported_date) AS d FROM v_released_lines GROUP BY 1),
c AS (SELECT dataset_release_id, bool_or(coverage_state = 'EMPTY_PERIOD') AS empty, bool_or(coverage_state = 'COVERED') AS covered FROM v_current_soi_coverage WHERE registrant_id IS NULL GROUP BY 1),
j AS (SELECT release_label, s.r, s.d, CASE WHEN empty THEN 'UNAVAILABLE' WHEN s.r IS NOT NULL THEN 'OBSERVED' WHEN covered THEN 'COVERED_NO_IDENTIFIED_LINE' ELSE 'UNKNOWN' END AS coverage_state FROM registry_dataset_release x LEFT JOIN s ON s.dataset_release_id = x.id LEFT JOIN c ON c.dataset_release_id = x.id)
SELECT release_label, coverage_state, CASE WHEN coverage_state = 'OBSERVED' THEN r END AS registrants_observed, CASE WHEN coverage_state = 'OBSERVED' THEN d END AS dates_observed FROM j""",
)
view("market_reported_date", "SELECT reported_date, count(DISTINCT registrant_cik) AS registrants_observed FROM v_lines WHERE reported_date IS NOT NULL GROUP BY 1")
view("market_release_date", f"SELECT registrant_cik, reported_date, count(DISTINCT r.id) AS disclosed_line_count FROM v_released_lines r JOIN registry_dataset_release d ON d.id = r.dataset_release_id WHERE release_label = '{LABEL}' GROUP BY ALL", lambda m, spark, sf: m.market_release_date(LABEL))
_CELLS = ", ".join(f"count(*) FILTER ({n}) AS with_{n}, count(*) FILTER (NOT {n}) AS without_{n}" for n in COVERED_CELLS.values())
_FLAGS = ", ".join(f"EXISTS (SELECT 1 FROM v_current_position_field_value v WHERE v.position_observation_id = l.id AND v.value_state = 'REPORTED' AND v.field_code = '{c}') AS {n}" for c, n in COVERED_CELLS.items())
asked("market_date_registrant", f"SELECT registrant_cik, {_CELLS} FROM (SELECT l.registrant_cik, {_FLAGS} FROM v_lines l WHERE reported_date = (SELECT later FROM v_asked)) GROUP BY 1", lambda m, cik, earlier, later: m.market_date_registrant(later))
view("portfolio_registrant_name", "SELECT r.registrant_cik, a.source_type_code, a.raw_value, a.documentation_status FROM v_portfolio_registrant r JOIN v_current_registrant_attribute a ON a.registrant_id = r.registrant_id AND a.attribute_code = 'NAME'")
asked("portfolio_detail_filing", "SELECT filing_id FROM v_portfolio_filing_registrant WHERE registrant_link_status = 'LINKED' AND registrant_cik = (FROM v_asked_cik)", lambda m, cik, *_: m.portfolio_detail_filing(cik))
asked("portfolio_detail_registrant", "SELECT * EXCLUDE (registrant_id) FROM v_portfolio_registrant WHERE registrant_cik = (FROM v_asked_cik)", lambda m, cik, *_: m.portfolio_detail_registrant(cik))
asked("portfolio_detail_names", "SELECT * EXCLUDE (registrant_cik) FROM v_portfolio_registrant_name WHERE registrant_cik = (FROM v_asked_cik)", lambda m, cik, *_: m.portfolio_detail_names(cik))
asked("portfolio_detail_dates", "SELECT * EXCLUDE (registrant_cik) FROM v_portfolio_reported_date WHERE registrant_cik = (FROM v_asked_cik)", lambda m, cik, *_: m.portfolio_detail_dates(cik))

# Values and their authority -----------------------------------------------------------------------------------------
view(
    "current_mapping_status",
    """WITH RECURSIVE r AS (SELECT id AS mapping_id, id AS at FROM ref_source_column_mapping UNION ALL SELECT mapping_id, n.id FROM r JOIN ref_source_column_mapping n ON n.supersedes_id = r.at)
SELECT mapping_id, mapping_status FROM r JOIN h_ref_source_column_mapping h ON h.id = r.at""",
)
view(
    "field_value_authority",
    """WITH j AS (SELECT f.id AS field_value_id, f.position_observation_id, f.field_code, f.source_column_label, f.value_state, f.currency_state, f.scale_state, e.evidence_level, s.evidence_status, d.level2_required,
  (SELECT mapping_status FROM v_current_mapping_status m WHERE m.mapping_id = f.column_mapping_id) AS mapping_status
  FROM v_current_position_field_value f JOIN ref_field_definition d USING (field_code) JOIN evidence_evidence e ON e.id = f.evidence_id JOIN v_current_evidence_status s ON s.field_value_id = f.id)
SELECT field_value_id, position_observation_id, field_code, source_column_label, value_state, evidence_level, evidence_status, mapping_status, CASE WHEN value_state IN ('UNKNOWN', 'NOT_APPLICABLE') THEN value_state WHEN mapping_status = 'REJECTED' THEN 'UNRESOLVED'
  WHEN level2_required AND evidence_level <> 'L2_ORIGINAL_FILING' AND evidence_status <> 'FILING_VERIFIED' THEN 'UNKNOWN' WHEN evidence_status = 'FILING_MISMATCH' THEN 'UNRESOLVED' WHEN mapping_status IN ('OPEN_QUESTION', 'OBSERVED_UNCONFIRMED') OR currency_state = 'FROM_NUM_UNIQUE_MATCH' THEN 'PROVISIONAL'
  WHEN scale_state = 'UNRESOLVED' THEN 'UNRESOLVED' WHEN evidence_status = 'FILING_VERIFIED' OR evidence_level = 'L2_ORIGINAL_FILING' THEN 'AUTHORITATIVE' ELSE 'REPORTED_STRUCTURED' END AS authority FROM j""",
)
view("position_field_status", "SELECT p.id AS position_observation_id, d.field_code, a.field_value_id, a.source_column_label, coalesce(a.value_state, 'UNKNOWN') AS value_state, coalesce(a.authority, 'UNKNOWN') AS authority FROM obs_position_observation p CROSS JOIN ref_field_definition d LEFT JOIN v_field_value_authority a ON a.position_observation_id = p.id AND a.field_code = d.field_code")
view("research_fields", "SELECT position_observation_id, field_code, raw_value, value_state, evidence_level FROM v_current_position_field_value v JOIN evidence_evidence e ON e.id = v.evidence_id WHERE field_code IN ('INDUSTRY', 'INSTRUMENT_TYPE')")

# Product maturity ---------------------------------------------------------------------------------------------------
view(
    "maturity_provenance",
    """WITH s AS (SELECT position_observation_id, count(*) AS n, count(DISTINCT normalized_date) AS dates, count(*) FILTER (date_precision = 'MONTH' AND normalized_date IS NULL AND normalized_year BETWEEN 1000 AND 9999 AND normalized_month BETWEEN 1 AND 12 AND raw_value IS NOT NULL) AS months,
  min(normalized_date) AS s_date, min(raw_value) AS s_raw, min(normalized_year) FILTER (date_precision = 'MONTH') AS s_year, min(normalized_month) FILTER (date_precision = 'MONTH') AS s_month, CASE WHEN count(*) = 1 THEN min(id) END AS structured_field_value_id
  FROM v_current_position_field_value WHERE field_code = 'MATURITY_DATE' AND value_state = 'REPORTED' GROUP BY 1),
j AS (SELECT p.id AS position_observation_id, p.filing_id, p.reported_date, coalesce(n, 0) AS n, s.* EXCLUDE (position_observation_id, n), i.inspection_state, i.no_bind_reason, i.evidence_id, i.normalized_date AS d_date, i.raw_value AS d_raw, i.displayed_year AS d_year, i.displayed_month AS d_month,
  i.id IS NULL OR i.inspection_state IN ('NOT_BOUND', 'UNAVAILABLE') AS silent FROM obs_position_observation p LEFT JOIN s ON s.position_observation_id = p.id LEFT JOIN v_current_maturity_inspection i ON i.position_observation_id = p.id),
k AS (SELECT *, CASE WHEN n = 1 AND dates = 1 AND (silent OR inspection_state = 'FILING_DISPLAYED' AND d_date = s_date) THEN 'REPORTED_STRUCTURED' WHEN n = 1 AND dates = 0 AND months = 1 AND (silent OR inspection_state = 'FILING_MONTH' AND d_year = s_year AND d_month = s_month) THEN 'REPORTED_MONTH'
  WHEN n = 0 AND silent THEN 'UNKNOWN' WHEN n = 0 AND inspection_state IN ('FILING_DISPLAYED', 'FILING_MONTH') THEN inspection_state ELSE 'UNRESOLVED' END AS src FROM j)
SELECT position_observation_id, filing_id, reported_date, src AS maturity_source, inspection_state, no_bind_reason, evidence_id, structured_field_value_id, CASE src WHEN 'REPORTED_STRUCTURED' THEN s_date WHEN 'FILING_DISPLAYED' THEN d_date END AS maturity_date,
  CASE WHEN src LIKE 'REPORTED%' THEN s_raw WHEN src LIKE 'FILING%' THEN d_raw END AS maturity_raw, CASE WHEN src LIKE '%MONTH' THEN 'MONTH' END AS maturity_precision, CASE src WHEN 'REPORTED_MONTH' THEN s_year WHEN 'FILING_MONTH' THEN d_year END AS maturity_year,
  CASE src WHEN 'REPORTED_MONTH' THEN s_month WHEN 'FILING_MONTH' THEN d_month END AS maturity_month, src LIKE 'REPORTED%' AND coalesce(inspection_state LIKE 'FILING%', false) AS filing_verified FROM k""",
)
view(
    "maturity_read",
    """SELECT m.* EXCLUDE (evidence_id, structured_field_value_id), CASE WHEN maturity_source LIKE 'FILING%' OR filing_verified THEN
  (SELECT CASE WHEN count(DISTINCT d.document_url) = 1 THEN min(d.document_url) END FROM evidence_evidence e JOIN registry_filing_document_artifact a ON a.artifact_id = e.artifact_id JOIN registry_filing_document d ON d.id = a.filing_document_id WHERE e.id = m.evidence_id AND d.filing_id = m.filing_id) END AS maturity_document_url
FROM v_maturity_provenance m""",
)
view("maturity_position", "SELECT m.*, registrant_cik FROM v_maturity_read m JOIN v_portfolio_filing_registrant l ON l.filing_id = m.filing_id AND l.registrant_link_status = 'LINKED'")
asked("maturity_position_for_cik", "SELECT * FROM v_maturity_position WHERE registrant_cik = (FROM v_asked_cik)", lambda m, cik, *_: m.maturity_position_for_cik(cik))
_COUNTS = "count(*) AS disclosed_line_count, count(maturity_date) AS maturity_reported_count, " + ", ".join(f"count(*) FILTER (maturity_source = '{s}') AS maturity_{n}_count" for s, n in (("REPORTED_STRUCTURED", "structured"), ("FILING_DISPLAYED", "filing"), ("UNKNOWN", "unknown"), ("UNRESOLVED", "unresolved")))
view("maturity_reported_date", f"SELECT registrant_cik, reported_date, {_COUNTS} FROM v_maturity_position GROUP BY 1, 2")
asked("maturity_coverage", f"SELECT reported_date, {_COUNTS} FROM v_maturity_position WHERE registrant_cik = (FROM v_asked_cik) GROUP BY 1", lambda m, cik, *_: m.maturity_coverage(cik))
view("maturity_year", "SELECT registrant_cik, reported_date, year(maturity_date) AS maturity_year, count(*) AS disclosed_line_count FROM v_maturity_position WHERE maturity_date IS NOT NULL GROUP BY ALL")
asked("maturity_years", "SELECT reported_date, year(maturity_date) AS maturity_year, count(*) AS disclosed_line_count FROM v_maturity_position WHERE maturity_date IS NOT NULL AND registrant_cik = (FROM v_asked_cik) GROUP BY ALL", lambda m, cik, *_: m.maturity_years(cik))
asked("maturity_line_count", "SELECT count(*) AS line_count FROM v_maturity_position WHERE registrant_cik = (FROM v_asked_cik) AND reported_date = (SELECT later FROM v_asked) AND year(maturity_date) = 2029", lambda m, cik, earlier, later: m.maturity_line_count(cik, later, "year", 2029))
_STATE = "CASE WHEN count(DISTINCT {0}) = 1 THEN 'REPORTED' WHEN count(*) = 0 THEN 'UNKNOWN' ELSE 'MULTIPLE_VALUES' END AS {1}_state, CASE WHEN count(DISTINCT {0}) = 1 THEN min({0}) END AS {1}_raw"


def _texts() -> str:
    """The texts of a line, one lateral aggregate each."""
    return " ".join(f"LEFT JOIN LATERAL (SELECT {_STATE.format('v.raw_value', n)} FROM v_current_position_field_value v WHERE v.position_observation_id = p.id AND v.field_code = '{c}') t_{n} ON true" for c, n in LINE_TEXTS.items())


VIEWS["v_filing_texts"] = (
    "SELECT f.id AS filing_id, form.*, filed.*, u.* FROM registry_filing f "
    + f"LEFT JOIN LATERAL (SELECT {_STATE.format('a.normalized_value', 'form')} FROM v_current_filing_attribute a WHERE a.filing_id = f.id AND a.attribute_code = 'FORM' AND a.value_state = 'REPORTED') form ON true "
    + f"LEFT JOIN LATERAL (SELECT {_STATE.format('a.normalized_value', 'filed_date')} FROM v_current_filing_attribute a WHERE a.filing_id = f.id AND a.attribute_code = 'FILED_DATE' AND a.value_state = 'REPORTED') filed ON true "
    + f"LEFT JOIN LATERAL (SELECT CASE WHEN count(*) = 0 THEN 'UNKNOWN' WHEN count(DISTINCT raw_value) = 1 AND (starts_with(min(raw_value), '{DOCUMENT_PREFIX}') OR starts_with(min(raw_value), '{INLINE_PREFIX}')) THEN 'REPORTED' ELSE 'MULTIPLE_VALUES' END AS inline_url_state, "
    + f"CASE WHEN count(DISTINCT raw_value) = 1 AND (starts_with(min(raw_value), '{DOCUMENT_PREFIX}') OR starts_with(min(raw_value), '{INLINE_PREFIX}')) THEN min(raw_value) END AS inline_url FROM v_current_filing_attribute a WHERE a.filing_id = f.id AND a.attribute_code = 'INLINE_URL' AND a.value_state = 'REPORTED') u ON true"
)
VIEWS["v_filing_shown"] = f"SELECT filing_id, document_name, document_url FROM registry_filing_document WHERE starts_with(document_url, '{DOCUMENT_PREFIX}') QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY named_by <> 'SUBMISSIONS_PRIMARY_DOCUMENT', id) = 1"
view(
    "portfolio_line",
    f"""SELECT p.id AS position_observation_id, l.registrant_cik, p.reported_date, p.duration_kind, o.qtrs, coalesce(c.period_role, 'UNKNOWN') AS period_role, p.holding_descriptor_raw AS disclosed_line_text, f.accession_number, e.evidence_level, {", ".join(f"t_{n}.*" for n in LINE_TEXTS.values())}, 'UNKNOWN' AS principal_currency_state,
  m.maturity_source, m.maturity_raw, m.maturity_date, m.inspection_state AS maturity_inspection_state, m.no_bind_reason AS maturity_no_bind_reason, m.filing_verified AS maturity_filing_verified, m.maturity_document_url, x.* EXCLUDE (filing_id), s.document_name, s.document_url, r.*
FROM obs_position_observation p JOIN obs_soi_row_observation o ON o.id = p.origin_soi_row_observation_id JOIN registry_filing f ON f.id = p.filing_id JOIN evidence_evidence e ON e.id = p.evidence_id JOIN v_portfolio_filing_registrant l ON l.filing_id = p.filing_id AND l.registrant_link_status = 'LINKED'
JOIN v_maturity_read m ON m.position_observation_id = p.id LEFT JOIN v_current_soi_row_classification c ON c.soi_row_observation_id = o.id {_texts()} JOIN v_filing_texts x ON x.filing_id = p.filing_id LEFT JOIN v_filing_shown s ON s.filing_id = p.filing_id
LEFT JOIN LATERAL (SELECT CASE WHEN count(DISTINCT d.release_label) = 1 THEN 'REPORTED' WHEN count(*) = 0 THEN 'UNKNOWN' ELSE 'MULTIPLE_VALUES' END AS release_state, CASE WHEN count(DISTINCT d.release_label) = 1 THEN min(d.release_label) END AS release_label
  FROM raw_tabular_row t JOIN raw_table_load y ON y.id = t.table_load_id JOIN registry_dataset_release_artifact a ON a.artifact_id = y.artifact_id JOIN registry_dataset_release d ON d.id = a.dataset_release_id WHERE t.id = o.tabular_row_id) r ON true""",
)
_LINE = "position_observation_id, registrant_cik, reported_date, maturity_source, maturity_raw, maturity_date, maturity_filing_verified, maturity_document_url, disclosed_line_text, principal_state, principal_raw, principal_currency_state, accession_number, evidence_level, form_state, form_raw, filed_date_state, filed_date_raw, inline_url_state, inline_url, document_name, document_url, release_state, release_label, year(maturity_date) AS maturity_year"
view("maturity_line", f"SELECT {_LINE} FROM v_portfolio_line")
asked("maturity_line_page", "SELECT * FROM v_maturity_line WHERE registrant_cik = (FROM v_asked_cik) AND reported_date = (SELECT later FROM v_asked) ORDER BY position_observation_id LIMIT 5 OFFSET 5", lambda m, cik, earlier, later: m.maturity_line_page(cik, later, "all", None, 2, 5))

# Wide reads and comparisons -----------------------------------------------------------------------------------------
view("matched_entity_position", "SELECT d.legal_entity_id, n.position_observation_id FROM (SELECT position_observation_id, min(id) AS id FROM v_current_borrower_name_observation WHERE source_column_label = 'Investment, Identifier Axis' AND extraction_state = 'EXTRACTED' GROUP BY 1 HAVING count(*) = 1) n JOIN v_current_entity_resolution d ON d.borrower_name_observation_id = n.id AND d.state = 'MATCHED' AND d.legal_entity_id IS NOT NULL")


def _wide_sql() -> str:
    own, out = {}, []
    for code, name in WIDE.items():
        kept = ["raw_value AS raw"] + (["normalized_date AS date", "date_precision AS precision", "normalized_year AS year", "normalized_month AS month"] if name == "acquisition" else ["normalized_numeric AS numeric"])
        units = ["scale_state"] + (["currency_state", "currency_code"] if name in AMOUNTS else [])
        state = "CASE WHEN count(*) = 0 THEN 'UNKNOWN' WHEN count(*) > 1 THEN 'MULTIPLE_VALUES' WHEN min(value_state) = 'REPORTED' AND count(raw_value) = 0 THEN 'UNKNOWN' ELSE min(value_state) END"
        parts = [f"{state} AS {name}_state"]
        parts += [f"CASE WHEN {state} = 'REPORTED' THEN min({k.split(' AS ')[0]}) END AS {name}_{k.split(' AS ')[1]}" for k in kept]
        parts += [f"CASE WHEN count(*) = 1 THEN min({u}) END AS {name}_{u}" for u in units]
        own[name] = f"LEFT JOIN LATERAL (SELECT {', '.join(parts)} FROM v_current_position_field_value v WHERE v.position_observation_id = p.id AND v.field_code = '{code}') w_{name} ON true"
        out.append(f"w_{name}.*")
    only = lambda t, c, name: f"LEFT JOIN LATERAL (SELECT CASE WHEN count(*) = 1 THEN min({c}) END AS {c}, CASE WHEN count(*) = 1 THEN min(state) END AS {name} FROM {t} d WHERE d.position_observation_id = p.id) d_{c} ON true"
    return f"""
SELECT p.id AS position_observation_id, p.filing_id, p.reported_date, p.duration_kind, p.holding_descriptor_raw, e.evidence_level AS observation_evidence_level, f.accession_number, {", ".join(out)}, l.registrant_cik, l.registrant_link_status, n.name_count, n.borrower_name_observation_id, n.borrower_name_raw,
  r.legal_entity_id, r.entity_resolution_state, g.economic_group_id, g.group_state, d_instrument_id.*, d_position_id.*, m.* EXCLUDE (position_observation_id, filing_id, reported_date)
FROM obs_position_observation p LEFT JOIN evidence_evidence e ON e.id = p.evidence_id LEFT JOIN registry_filing f ON f.id = p.filing_id LEFT JOIN v_portfolio_filing_registrant l ON l.filing_id = p.filing_id {" ".join(own.values())}
LEFT JOIN (SELECT position_observation_id, count(*) AS name_count, CASE WHEN count(*) = 1 THEN min(id) END AS borrower_name_observation_id, CASE WHEN count(*) = 1 THEN min(normalized_text) END AS borrower_name_raw FROM v_current_borrower_name_observation
  WHERE source_column_label = 'Investment, Identifier Axis' AND extraction_state = 'EXTRACTED' GROUP BY 1) n ON n.position_observation_id = p.id
LEFT JOIN (SELECT borrower_name_observation_id, CASE WHEN count(*) = 1 THEN min(legal_entity_id) END AS legal_entity_id, CASE WHEN count(*) = 1 THEN min(state) END AS entity_resolution_state FROM v_current_entity_resolution GROUP BY 1) r ON r.borrower_name_observation_id = n.borrower_name_observation_id
LEFT JOIN (SELECT legal_entity_id, CASE WHEN count(*) = 1 THEN min(economic_group_id) END AS economic_group_id, CASE WHEN count(*) = 1 THEN min(state) END AS group_state FROM v_current_group_membership GROUP BY 1) g ON g.legal_entity_id = r.legal_entity_id
{only("v_current_instrument_resolution", "instrument_id", "instrument_resolution_state")} {only("v_current_position_continuity", "position_id", "continuity_state")} LEFT JOIN v_maturity_read m ON m.position_observation_id = p.id"""


view("position_read", _wide_sql())


def _comparison_sql() -> str:
    out = ["l.position_id", "e.position_observation_id AS earlier_id", "l.position_observation_id AS later_id", "e.reported_date AS earlier_date", "l.reported_date AS later_date"]
    out += [f"{s}.{c} AS {s}_{c}" for s in "el" for c in ("accession_number", "registrant_cik", "legal_entity_id", "instrument_id", "instrument_resolution_state")]
    for n in (*AMOUNTS, *RATES):
        ok = f"e.{n}_numeric IS NOT NULL AND l.{n}_numeric IS NOT NULL"
        if n in AMOUNTS:
            ok += f" AND e.{n}_currency_state NOT IN ('UNKNOWN', 'AMBIGUOUS') AND l.{n}_currency_state NOT IN ('UNKNOWN', 'AMBIGUOUS') AND e.{n}_currency_code = l.{n}_currency_code"
        out += [f"CASE WHEN {ok} THEN 'COMPARABLE' ELSE 'INSUFFICIENT_DATA' END AS {n}_comparison", f"CASE WHEN {ok} THEN l.{n}_numeric - e.{n}_numeric END AS {n}_delta", f"CASE WHEN {ok} THEN l.{n}_numeric <> e.{n}_numeric END AS {n}_changed"]
        out += [f"{s}.{n}_{x} AS {s}_{n}_{x}" for s in "el" for x in ("raw", "numeric")] + [f"{s}.{n}_currency_state AS {s}_{n}_currency_state" for s in "el" if n in AMOUNTS]
    for n, day, month in (("maturity", "{0}.maturity_source IN ('REPORTED_STRUCTURED', 'FILING_DISPLAYED')", "{0}.maturity_source IN ('REPORTED_MONTH', 'FILING_MONTH')"), ("acquisition", "{0}.acquisition_state = 'REPORTED'", "{0}.acquisition_state = 'REPORTED'")):
        days = " AND ".join(f"{day.format(s)} AND {s}.{n}_date IS NOT NULL AND {s}.{n}_precision IS NULL" for s in "el")
        months = " AND ".join(f"{month.format(s)} AND {s}.{n}_precision = 'MONTH' AND {s}.{n}_year IS NOT NULL AND {s}.{n}_month IS NOT NULL" for s in "el")
        out += [f"CASE WHEN {days} OR {months} THEN 'COMPARABLE' ELSE 'INSUFFICIENT_DATA' END AS {n}_comparison", f"CASE WHEN {days} THEN e.{n}_date <> l.{n}_date WHEN {months} THEN e.{n}_year <> l.{n}_year OR e.{n}_month <> l.{n}_month END AS {n}_changed"]
        out += [f"{s}.{n}_{x} AS {s}_{n}_{x}" for s in "el" for x in ("raw", "date", "precision", "year", "month")]
    return f"""
WITH c AS (SELECT * FROM v_position_read WHERE continuity_state = 'MATCHED' AND position_id IS NOT NULL AND reported_date IS NOT NULL), d AS (SELECT position_id, reported_date, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT c.* FROM c JOIN d USING (position_id, reported_date) WHERE d.n = 1)
SELECT {", ".join(out)} FROM s e JOIN s l ON l.position_id = e.position_id AND l.reported_date > e.reported_date WHERE NOT EXISTS (SELECT 1 FROM d m WHERE m.position_id = e.position_id AND m.reported_date > e.reported_date AND m.reported_date < l.reported_date)"""


view("position_period_comparison", _comparison_sql())


# Borrowers ----------------------------------------------------------------------------------------------------------
def entity(name: str, sql: str, columns: list[str] | None = None) -> None:
    view(name, sql.replace("{entity}", f"'{ENTITY}'"), lambda m, spark, sf: getattr(m, name)(ENTITY), columns)


entity("borrower_position_observations", "SELECT * FROM v_position_read r WHERE legal_entity_id = {entity} AND entity_resolution_state = 'MATCHED' AND EXISTS (SELECT 1 FROM v_matched_entity_position m WHERE m.legal_entity_id = {entity} AND m.position_observation_id = r.position_observation_id)")
entity("borrower_comparisons", "SELECT * FROM v_position_period_comparison WHERE e_legal_entity_id = {entity} AND l_legal_entity_id = {entity}")
entity("borrower_valuation_period_comparison", "SELECT * FROM v_position_period_comparison c WHERE EXISTS (SELECT 1 FROM v_matched_entity_position m JOIN v_position_read r USING (position_observation_id) WHERE m.legal_entity_id = {entity} AND r.continuity_state = 'MATCHED' AND r.position_id = c.position_id)")
_UNIT = "CASE WHEN r.{0}_currency_state NOT IN ('UNKNOWN', 'AMBIGUOUS') THEN r.{0}_currency_code END"
entity(
    "borrower_position_valuation",
    f"""SELECT c.position_id, earlier_id, later_id, earlier_date, later_date, fair_value_comparison, fair_value_delta, CASE WHEN fair_value_comparison = 'COMPARABLE' THEN {quotient("(l_fair_value_numeric - e_fair_value_numeric) * 100", "e_fair_value_numeric")} END AS fair_value_change_percent,
  {", ".join(f"CASE WHEN {_UNIT.format('fair_value')} = {_UNIT.format(n)} THEN {quotient('r.fair_value_numeric', f'r.{n}_numeric')} END AS fair_value_to_{n}" for n in ("principal", "cost"))}
FROM v_borrower_comparisons c JOIN v_position_read r ON r.position_observation_id = c.later_id""",
)
entity("borrower_refinancing_outcomes", "SELECT position_id, earlier_id, later_id, earlier_date, later_date, e_maturity_raw, l_maturity_raw, NULL::DATE AS event_date, 'UNKNOWN' AS refinancing_outcome_state FROM v_borrower_comparisons WHERE maturity_comparison = 'COMPARABLE' AND maturity_changed AND e_instrument_resolution_state = 'MATCHED' AND l_instrument_resolution_state = 'MATCHED' AND e_instrument_id = l_instrument_id")
_RESOLVED = "instrument_resolution_state IS NOT DISTINCT FROM 'MATCHED' AND continuity_state IS NOT DISTINCT FROM 'MATCHED'"
entity(
    "borrower_maturity_observations",
    f"""WITH r AS (SELECT *, {_RESOLVED} AS resolved, maturity_source IN ('REPORTED_STRUCTURED', 'FILING_DISPLAYED') AND maturity_date IS NOT NULL AS day, maturity_source IN ('REPORTED_MONTH', 'FILING_MONTH') AND maturity_year IS NOT NULL AND maturity_month IS NOT NULL AS month FROM v_borrower_position_observations),
k AS (SELECT *, CASE WHEN resolved AND day THEN 'DAY' WHEN resolved AND month THEN 'MONTH' ELSE 'NONE' END AS kind FROM r)
SELECT position_observation_id, reported_date, instrument_resolution_state, continuity_state, maturity_source, maturity_raw, maturity_date, maturity_year, maturity_month, principal_state, principal_numeric, principal_currency_state, principal_currency_code, fair_value_state, fair_value_numeric, fair_value_currency_state, fair_value_currency_code,
  kind AS maturity_precision_class, CASE kind WHEN 'DAY' THEN year(maturity_date) WHEN 'MONTH' THEN maturity_year END AS maturity_bucket_year,
  CASE WHEN instrument_resolution_state IS DISTINCT FROM 'MATCHED' THEN 'UNRESOLVED_INSTRUMENT' WHEN continuity_state IS DISTINCT FROM 'MATCHED' THEN 'UNRESOLVED_POSITION' WHEN day OR month THEN 'OBSERVED' ELSE 'UNKNOWN' END AS maturity_observation_state FROM k""",
)
entity("borrower_maturity_page", "SELECT * FROM v_borrower_maturity_observations ORDER BY CASE maturity_precision_class WHEN 'DAY' THEN 0 WHEN 'MONTH' THEN 1 ELSE 2 END, maturity_date NULLS LAST, maturity_year NULLS LAST, maturity_month NULLS LAST, reported_date DESC NULLS LAST, position_observation_id LIMIT 50")
entity(
    "borrower_maturity_summary",
    f"""SELECT count(*) FILTER ({_RESOLVED}) AS resolved_observation_count, count(*) FILTER (maturity_observation_state = 'OBSERVED') AS known_maturity_count, count(*) FILTER ({_RESOLVED} AND maturity_observation_state = 'UNKNOWN') AS unknown_maturity_count, count(*) FILTER (maturity_observation_state LIKE 'UNRESOLVED%') AS unresolved_count,
  (SELECT maturity_raw FROM v_borrower_maturity_observations WHERE maturity_precision_class = 'DAY' ORDER BY maturity_date, maturity_raw LIMIT 1) AS earliest_calendar_maturity, (SELECT maturity_raw FROM v_borrower_maturity_observations WHERE maturity_precision_class = 'MONTH' ORDER BY maturity_year, maturity_month, maturity_raw LIMIT 1) AS earliest_month_maturity
FROM v_borrower_maturity_observations""",
)


def _total(n: str) -> str:
    good = f"count(*) > 0 AND bool_and(coalesce({n}_state = 'REPORTED' AND {n}_numeric IS NOT NULL AND {n}_currency_state NOT IN ('UNKNOWN', 'AMBIGUOUS') AND {n}_currency_code IS NOT NULL, false)) AND count(DISTINCT {n}_currency_code) = 1"
    return f"CASE WHEN {good} THEN 'COMPARABLE' ELSE 'INSUFFICIENT_DATA' END AS {n}_aggregation_state, CASE WHEN {good} THEN sum({n}_numeric) END AS {n}_total, CASE WHEN {good} THEN min({n}_currency_code) END AS {n}_currency_code"


entity("borrower_maturity_years", f"SELECT maturity_bucket_year, maturity_precision_class, count(*) AS observation_count, {_total('principal')}, {_total('fair_value')} FROM v_borrower_maturity_observations WHERE maturity_observation_state = 'OBSERVED' GROUP BY 1, 2")
view("borrower_observation_listing", "SELECT n.id AS borrower_name_observation_id, n.position_observation_id, n.normalized_text, d.legal_entity_id, p.filing_id, p.reported_date, p.holding_descriptor_raw, f.accession_number, s.document_name, s.document_url, l.registrant_cik, x.display_name FROM v_current_borrower_name_observation n JOIN v_current_entity_resolution d ON d.borrower_name_observation_id = n.id AND d.state = 'MATCHED' JOIN obs_position_observation p ON p.id = n.position_observation_id JOIN registry_filing f ON f.id = p.filing_id LEFT JOIN v_filing_shown s ON s.filing_id = f.id LEFT JOIN v_portfolio_filing_registrant l ON l.filing_id = f.id LEFT JOIN identity_legal_entity x ON x.id = d.legal_entity_id")

# Portfolios at a date and between two -------------------------------------------------------------------------------
_SCOPE = "SELECT * FROM v_position_read WHERE registrant_cik = (FROM v_asked_cik) AND reported_date = (SELECT {0} FROM v_asked)"
asked("portfolio_scope", _SCOPE.format("later"), lambda m, cik, earlier, later: m.portfolio_scope(cik, later))
asked("portfolio_holdings", "SELECT * FROM v_portfolio_scope ORDER BY borrower_name_raw NULLS LAST, position_observation_id LIMIT 50", lambda m, cik, earlier, later: m.portfolio_holdings(cik, later))
asked(
    "portfolio_summary",
    f"""SELECT count(*) AS observation_count, count(*) FILTER ({_RESOLVED}) AS resolved_position_count, count(*) FILTER (NOT ({_RESOLVED})) AS unresolved_count, count(*) FILTER (principal_state = 'REPORTED') AS known_principal_count, count(*) FILTER (fair_value_state = 'REPORTED') AS known_fair_value_count,
  count(*) FILTER (maturity_source NOT IN ('UNKNOWN', 'UNRESOLVED')) AS known_maturity_count, count(*) FILTER (principal_state = 'REPORTED' AND principal_currency_state IN ('UNKNOWN', 'AMBIGUOUS') OR fair_value_state = 'REPORTED' AND fair_value_currency_state IN ('UNKNOWN', 'AMBIGUOUS')) AS unknown_currency_count, {_total('principal')}, {_total('fair_value')} FROM v_portfolio_scope""",
    lambda m, cik, earlier, later: m.portfolio_summary(cik, later),
)
asked("portfolio_period_identity", "SELECT position_observation_id, position_id, instrument_resolution_state, continuity_state FROM v_portfolio_scope", lambda m, cik, earlier, later: m.portfolio_period_identity(cik, later))
_SIDE = f"SELECT position_id, count(*) AS n, min(position_observation_id) AS id FROM v_position_read WHERE registrant_cik = (FROM v_asked_cik) AND reported_date = (SELECT {{0}} FROM v_asked) AND position_id IS NOT NULL AND {_RESOLVED} GROUP BY 1"
VIEWS |= {"v_side_earlier": _SIDE.format("earlier"), "v_side_later": _SIDE.format("later")}
_KEPT = [f"{n}_{x}" for n in AMOUNTS for x in ("comparison", "delta")] + ["maturity_comparison", "maturity_changed"]
asked(
    "portfolio_period_changes",
    f"""SELECT 'EXISTING_POSITION_CHANGED' AS change_type, e.position_id, e.id AS earlier_id, l.id AS later_id, {", ".join("c." + k for k in _KEPT)} FROM v_side_earlier e JOIN v_side_later l USING (position_id) JOIN v_position_period_comparison c ON c.earlier_id = e.id AND c.later_id = l.id
WHERE e.n = 1 AND l.n = 1 AND c.earlier_date = (SELECT earlier FROM v_asked) AND c.later_date = (SELECT later FROM v_asked) AND (fair_value_changed IS TRUE OR principal_changed IS TRUE OR cost_changed IS TRUE OR maturity_changed IS TRUE)
UNION ALL SELECT 'NEW_POSITION_OBSERVED', position_id, NULL, id, {", ".join("NULL" for _ in _KEPT)} FROM v_side_later l WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM v_side_earlier e WHERE e.position_id = l.position_id)
UNION ALL SELECT 'POSITION_NO_LONGER_OBSERVED', position_id, id, NULL, {", ".join("NULL" for _ in _KEPT)} FROM v_side_earlier e WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM v_side_later l WHERE e.position_id = l.position_id)""",
    lambda m, *a: m.portfolio_period_changes(*a),
)
asked(
    "portfolio_period_summary",
    """SELECT (SELECT count(*) FROM v_side_earlier) AS earlier_position_count, (SELECT count(*) FROM v_side_later) AS later_position_count, (SELECT count(*) FROM v_side_earlier JOIN v_side_later USING (position_id)) AS both_dates_count,
  (SELECT count(*) FROM v_side_earlier e FULL JOIN v_side_later l USING (position_id) WHERE e.n > 1 OR l.n > 1) AS several_rows_count, """
    + ", ".join(f"(SELECT count(*) FROM v_portfolio_period_changes WHERE change_type = '{t}') AS {n}" for t, n in (("NEW_POSITION_OBSERVED", "new_count"), ("POSITION_NO_LONGER_OBSERVED", "no_longer_count"), ("EXISTING_POSITION_CHANGED", "changed_count"))),
    lambda m, *a: m.portfolio_period_summary(*a),
)

# Entities and loads -------------------------------------------------------------------------------------------------
view(
    "canonical_legal_entity",
    """WITH RECURSIVE edge AS (SELECT h.from_legal_entity_id AS a, CASE WHEN h.state = 'MATCHED' THEN h.to_legal_entity_id WHEN h.state = 'PROBABLE' AND p.state = 'MATCHED' THEN p.to_legal_entity_id END AS b FROM v_current_legal_entity_consolidation h LEFT JOIN resolution_legal_entity_consolidation_decision p ON p.id = h.supersedes_id),
walk AS (SELECT id AS legal_entity_id, id AS place, 0 AS steps FROM identity_legal_entity UNION ALL SELECT w.legal_entity_id, e.b, steps + 1 FROM walk w JOIN edge e ON e.a = w.place AND e.b IS NOT NULL WHERE steps < 64),
ends AS (SELECT legal_entity_id, arg_max(place, steps) AS place, max(steps) AS steps FROM walk GROUP BY 1)
SELECT legal_entity_id, CASE WHEN steps < 64 THEN place END AS canonical_id, steps >= 64 AS is_cyclic FROM ends""",
)
view("legal_entities_with_canonical", "SELECT legal_entity_id FROM v_canonical_legal_entity WHERE canonical_id = 'N08'", lambda m, spark, sf: m.legal_entities_with_canonical("N08"))
view("ambiguous_verified_own_identifier", "SELECT legal_entity_id, scheme, count(*) AS n FROM v_current_legal_entity_identifier WHERE verification_state = 'VERIFIED' AND relationship_role = 'OWN' GROUP BY 1, 2 HAVING count(*) > 1")
view("first_observed_events", "SELECT id AS position_observation_id, registrant_id, reported_date FROM v_lines l WHERE reported_date = (SELECT min(reported_date) FROM v_lines x WHERE x.registrant_id = l.registrant_id)")
view(
    "soi_load_reconciliation",
    """SELECT id AS table_load_id, row_count, parse_status, len(header)::INT AS header_width, (SELECT count(*) FROM raw_tabular_row t WHERE t.table_load_id = d.id AND t.parse_status = 'OK') AS ok_row_count,
  (SELECT count(*) FROM obs_soi_row_observation o JOIN raw_tabular_row t ON t.id = o.tabular_row_id WHERE t.table_load_id = d.id) AS soi_row_observation_count, (SELECT count(o.identifier_raw) FROM obs_soi_row_observation o JOIN raw_tabular_row t ON t.id = o.tabular_row_id WHERE t.table_load_id = d.id) AS identifier_row_count,
  (SELECT count(*) FROM ops_projection_exception x WHERE x.table_load_id = d.id AND kind = 'ORPHAN_ADSH') AS orphan_adsh_count, (SELECT count(*) FROM ops_projection_exception x WHERE x.table_load_id = d.id AND kind = 'FIELD_COUNT_MISMATCH') AS quarantined_mismatch_count FROM raw_table_load d WHERE table_code = 'SOI'""",
)


# Integrity rules ----------------------------------------------------------------------------------------------------
def rules(name: str, rows: str, id_column: str, conditions: dict[str, str], distinct: bool = False) -> None:
    """view for an assertion: rows is a FROM clause, conditions say what is wrong."""
    view(name, " UNION ALL ".join(f"SELECT {'DISTINCT ' if distinct else ''}{id_column}::VARCHAR AS id, '{rule}' AS rule FROM {rows} WHERE {condition}" for rule, condition in conditions.items()))


rules(
    "evidence_locators", "evidence_evidence e LEFT JOIN raw_table_load l ON l.artifact_id = e.artifact_id", "e.id",
    {"SHAPE": "locator_type = 'TSV_CELL' AND (column_label IS NULL OR row_number IS NULL OR column_number IS NULL) OR locator_type = 'TSV_ROW' AND row_number IS NULL OR locator_type = 'JSON_PATH' AND json_path IS NULL", "LABEL": "locator_type = 'TSV_CELL' AND header IS NOT NULL AND header[column_number] IS DISTINCT FROM column_label"}, True,
)
rules(
    "position_origins", "obs_position_observation p LEFT JOIN obs_soi_row_observation o ON o.id = p.origin_soi_row_observation_id LEFT JOIN v_current_soi_row_classification c ON c.soi_row_observation_id = p.origin_soi_row_observation_id", "p.id",
    {"ORIGIN": "o.id IS NULL", "FILING": "o.filing_id <> p.filing_id", "DATE": "o.id IS NOT NULL AND o.reported_date IS DISTINCT FROM p.reported_date", "TEXT": "o.id IS NOT NULL AND o.identifier_raw IS DISTINCT FROM p.holding_descriptor_raw", "KIND": "o.id IS NOT NULL AND c.row_kind IS DISTINCT FROM 'IDENTIFIER_ROW'"},
)
view(
    "position_sources",
    """SELECT p.id::VARCHAR AS id, 'FILING' AS rule FROM obs_position_observation_source s JOIN obs_position_observation p ON p.id = s.position_observation_id LEFT JOIN obs_soi_row_observation o ON o.id = s.soi_row_observation_id WHERE o.filing_id IS DISTINCT FROM p.filing_id
UNION ALL SELECT p.id::VARCHAR, 'PRIMARY' FROM obs_position_observation_source s JOIN obs_position_observation p ON p.id = s.position_observation_id WHERE source_role = 'PRIMARY' AND s.soi_row_observation_id <> p.origin_soi_row_observation_id
UNION ALL SELECT p.id::VARCHAR, 'NO_PRIMARY' FROM obs_position_observation p WHERE NOT EXISTS (SELECT 1 FROM obs_position_observation_source s WHERE s.position_observation_id = p.id AND source_role = 'PRIMARY')""",
)
rules(
    "fact_group_members", "obs_soi_fact_group g", "g.id",
    {"FILING": "EXISTS (SELECT 1 FROM obs_soi_fact_group_member m WHERE m.group_id = g.id AND m.filing_id <> g.filing_id)", "EMPTY": "NOT EXISTS (SELECT 1 FROM obs_soi_fact_group_member m WHERE m.group_id = g.id)",
     "SHAPE": "(SELECT count(*) > 0 AND NOT (count(*) FILTER (member_role = 'BALANCE') = 1 AND count(*) FILTER (member_role = 'SPREAD') = 1 AND count(*) FILTER (member_role = 'PIK') <= 1) FROM obs_soi_fact_group_member m WHERE m.group_id = g.id)"},
)
_NUMBERS, _DATES = "('PRINCIPAL_AMOUNT', 'COST', 'FAIR_VALUE', 'INTEREST_RATE', 'SPREAD', 'INTEREST_RATE_FLOOR')", "('MATURITY_DATE', 'ACQUISITION_DATE')"
rules(
    "field_values", "obs_position_field_value v LEFT JOIN evidence_evidence e ON e.id = v.evidence_id", "v.id",
    {"KIND": f"normalized_numeric IS NOT NULL AND field_code NOT IN {_NUMBERS} OR normalized_date IS NOT NULL AND field_code NOT IN {_DATES}", "MONTH": f"date_precision = 'MONTH' AND (field_code NOT IN {_DATES} OR normalized_date IS NOT NULL)",
     "SOURCE": "value_state = 'REPORTED' AND column_mapping_id IS NULL AND evidence_level IS DISTINCT FROM 'L2_ORIGINAL_FILING'", "TEXT": "value_state = 'REPORTED' AND raw_value IS NULL"},
)
rules("corroborations", "obs_field_value_corroboration c JOIN obs_position_field_value v ON v.id = c.field_value_id JOIN obs_position_observation p ON p.id = v.position_observation_id LEFT JOIN obs_num_fact_observation n ON n.id = c.num_fact_observation_id", "c.field_value_id", {"FACT": "n.id IS NULL", "FILING": "n.filing_id <> p.filing_id"})
rules("continuity_registrants", "resolution_position_continuity_decision d JOIN resolution_position x ON x.id = d.position_id JOIN obs_position_observation p ON p.id = d.position_observation_id", "d.id", {"REGISTRANT": "state = 'MATCHED' AND NOT EXISTS (SELECT 1 FROM h_registry_filing_registrant_link l WHERE l.filing_id = p.filing_id AND l.registrant_id = x.registrant_id)"})
rules("evidence_statuses", "validation_evidence_status_assertion a LEFT JOIN validation_validation_result r ON r.id = a.validation_result_id LEFT JOIN evidence_evidence e ON e.id = r.evidence_id", "a.id", {"PASS": "evidence_status = 'FILING_VERIFIED' AND outcome IS DISTINCT FROM 'PASS'", "LEVEL": "evidence_status = 'FILING_VERIFIED' AND evidence_level IS DISTINCT FROM 'L2_ORIGINAL_FILING'"})
view(
    "derived_values",
    """WITH i AS (SELECT derived_value_id AS id, v.*, EXISTS (SELECT 1 FROM obs_position_field_value s WHERE s.supersedes_id = v.id) AS gone, (SELECT mapping_status FROM v_current_mapping_status m WHERE m.mapping_id = v.column_mapping_id) AS mapping_status FROM derived_derived_value_input x JOIN (SELECT * RENAME (id AS vid), id FROM obs_position_field_value) v ON v.id = x.field_value_id)
SELECT id::VARCHAR AS id, 'RULE' AS rule FROM derived_derived_value WHERE rule_kind <> 'DERIVATION' UNION ALL SELECT id::VARCHAR, 'NO_INPUT' FROM derived_derived_value d WHERE NOT EXISTS (SELECT 1 FROM derived_derived_value_input x WHERE x.derived_value_id = d.id)
UNION ALL SELECT DISTINCT id::VARCHAR, 'SUPERSEDED' FROM i WHERE gone UNION ALL SELECT DISTINCT id::VARCHAR, 'MAPPING' FROM i WHERE column_mapping_id IS NOT NULL AND coalesce(mapping_status NOT LIKE 'DOCUMENTED%', true) UNION ALL SELECT DISTINCT id::VARCHAR, 'UNKNOWN' FROM i WHERE value_state = 'UNKNOWN'""",
)
rules("filing_documents", f"registry_filing_document d JOIN registry_filing f ON f.id = d.filing_id JOIN (SELECT filing_id, min(cik) AS cik FROM v_current_filing_registrant WHERE registrant_link_status = 'LINKED' GROUP BY 1) l ON l.filing_id = d.filing_id", "d.id", {"URL": f"document_url <> '{DOCUMENT_PREFIX}' || cik || '/' || replace(accession_number, '-', '') || '/' || document_name"})
_MONTH = "try_strptime(CASE WHEN regexp_full_match(release_label, '[0-9]{4}_[0-9]{2}') THEN release_label END, '%Y_%m')::DATE"
rules("dataset_releases", "registry_dataset_release", "id", {"LABEL": f"{_MONTH} IS NULL", "WINDOW": f"{_MONTH} <> window_start OR last_day({_MONTH}) <> window_end"})
rules("load_headers", "raw_table_load", "id", {"HEADER": "(header IS NULL OR len(header) = 0) AND (row_count > 0 OR table_code <> 'SOI')"})
rules("projection_exceptions", "ops_projection_exception x LEFT JOIN raw_tabular_row t ON t.id = x.tabular_row_id", "x.id", {"LOAD": "t.table_load_id IS DISTINCT FROM x.table_load_id", "STATUS": "(kind = 'FIELD_COUNT_MISMATCH') <> (parse_status = 'FIELD_COUNT_MISMATCH')"})
rules("observation_events", "derived_observation_event v JOIN obs_position_observation p ON p.id = v.position_observation_id", "v.id", {"DATE": "event_date IS DISTINCT FROM reported_date", "EVIDENCE": "v.evidence_id IS DISTINCT FROM p.evidence_id"})
TEXTS["observation_event_listing"] = ["event_date"]
view("observation_event_listing", "SELECT id, position_observation_id, event_type, event_date, evidence_id FROM derived_observation_event")
rules("row_classifications", "obs_soi_row_classification c JOIN obs_soi_row_observation o ON o.id = c.soi_row_observation_id LEFT JOIN evidence_evidence e ON e.id = c.evidence_id", "c.id", {"IDENTIFIER": "row_kind = 'IDENTIFIER_ROW' AND coalesce(trim(identifier_raw), '') = '' OR row_kind = 'TOTAL_ROW' AND coalesce(trim(identifier_raw), '') <> ''", "LEVEL": "row_kind = 'SUBTOTAL_ROW' AND evidence_level IS DISTINCT FROM 'L2_ORIGINAL_FILING'"})
rules(
    "maturity_inspections", "obs_maturity_inspection i LEFT JOIN evidence_evidence e ON e.id = i.evidence_id", "i.id",
    {"DAY": "inspection_state = 'FILING_DISPLAYED' AND (normalized_date IS NULL OR displayed_year IS NOT NULL OR displayed_month IS NOT NULL)", "MONTH": "inspection_state = 'FILING_MONTH' AND (normalized_date IS NOT NULL OR displayed_year IS NULL OR coalesce(displayed_month, 0) NOT BETWEEN 1 AND 12)",
     "NOTHING": "inspection_state NOT LIKE 'FILING%' AND (normalized_date IS NOT NULL OR displayed_year IS NOT NULL OR raw_value IS NOT NULL)", "LEVEL": "inspection_state LIKE 'FILING%' AND evidence_level IS DISTINCT FROM 'L2_ORIGINAL_FILING'",
     "CANDIDATE": "inspection_state <> 'UNRESOLVED' AND EXISTS (SELECT 1 FROM obs_maturity_inspection_candidate c WHERE c.maturity_inspection_id = i.id)"},
)
rules(
    "name_observations", "obs_borrower_name_observation n LEFT JOIN obs_borrower_name_observation b ON b.id = n.supersedes_id", "n.id",
    {"TEXT": "(n.extraction_state = 'EXTRACTED') <> (n.normalized_text IS NOT NULL)", "SUCCESSOR": "b.id IS NOT NULL AND (n.position_observation_id, n.source_column_label, n.extraction_state, n.normalized_text) IS NOT DISTINCT FROM (b.position_observation_id, b.source_column_label, b.extraction_state, b.normalized_text)"},
)
rules(
    "name_chains", "obs_borrower_name_observation n LEFT JOIN obs_borrower_name_observation b ON b.id = n.supersedes_id", "n.id",
    {"SELF": "n.supersedes_id = n.id", "DANGLING": "n.supersedes_id IS NOT NULL AND b.id IS NULL", "SUBJECT": "b.id IS NOT NULL AND (n.position_observation_id IS DISTINCT FROM b.position_observation_id OR n.source_column_label IS DISTINCT FROM b.source_column_label)", "FORK": "EXISTS (SELECT 1 FROM obs_borrower_name_observation s WHERE s.supersedes_id = n.supersedes_id AND s.id <> n.id)"},
)

# What readers make of it --------------------------------------------------------------------------------------------
_FIELDS_LONG = " UNION ALL ".join(f"SELECT position_id, earlier_id, later_id, earlier_date, later_date, '{n}' AS field, {n}_comparison AS state, {n}_changed AS changed, e_{n}_raw AS earlier_raw, l_{n}_raw AS later_raw FROM v_borrower_comparisons" for n in (*AMOUNTS, *RATES, "maturity", "acquisition"))
entity("comparison_fields", _FIELDS_LONG)
entity("amount_review_fields", "SELECT * FROM v_comparison_fields WHERE field IN ('principal', 'cost', 'fair_value')")
entity("stored_differences", "SELECT earlier_id, later_id, field, concat_ws(' -> ', earlier_raw, later_raw) AS difference FROM v_comparison_fields WHERE state = 'COMPARABLE' AND changed")
entity("maturity_change_lines", "SELECT earlier_id, later_id, difference FROM v_stored_differences WHERE field = 'maturity'")
entity("what_changed", " UNION ALL ".join(f"SELECT position_id, earlier_id, later_id, '{n}' AS field, " + (f"CASE WHEN {n}_delta > 0 THEN 'UP' WHEN {n}_delta < 0 THEN 'DOWN' END" if n in (*AMOUNTS, *RATES) else "'OTHER'") + f" AS direction FROM v_borrower_comparisons WHERE {n}_changed" for n in (*AMOUNTS, *RATES, "maturity", "acquisition")))
view("comparison_availability", "SELECT e.canonical_id, count(c.later_id) AS comparison_count, max(c.later_date) AS latest_date FROM (SELECT DISTINCT canonical_id FROM v_canonical_legal_entity WHERE canonical_id IS NOT NULL) e LEFT JOIN v_canonical_legal_entity l ON l.canonical_id = e.canonical_id LEFT JOIN v_position_period_comparison c ON c.l_legal_entity_id = l.legal_entity_id AND c.e_legal_entity_id = l.legal_entity_id GROUP BY 1")
view("borrowers", "SELECT b.*, a.comparison_count, a.latest_date FROM (SELECT legal_entity_id, display_name, count(*) AS name_count, count(DISTINCT registrant_cik) AS registrant_count, max(reported_date) AS latest_reported_date FROM v_borrower_observation_listing GROUP BY 1, 2) b LEFT JOIN v_comparison_availability a ON a.canonical_id = b.legal_entity_id")
entity("borrower_detail", "SELECT registrant_cik, count(*) AS line_count, min(reported_date) AS first_date, max(reported_date) AS last_date, CASE count(DISTINCT normalized_text) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'REPORTED' ELSE 'MULTIPLE_VALUES' END AS name_state, CASE WHEN count(DISTINCT normalized_text) = 1 THEN min(normalized_text) END AS name FROM v_borrower_observation_listing WHERE legal_entity_id = {entity} GROUP BY 1")
_FOUR = "CASE WHEN count(*) = 0 THEN 'UNKNOWN' WHEN count(*) > 1 THEN 'MULTIPLE_VALUES' WHEN min(value_state) = 'REPORTED' AND count(raw_value) = 0 THEN 'UNKNOWN' ELSE min(value_state) END"
entity(
    "historical_positions",
    "SELECT r.filing_id, r.position_observation_id, registrant_cik, reported_date, holding_descriptor_raw, principal_raw, fair_value_raw, i.*, t.*, document_name, document_url FROM v_borrower_position_observations r "
    + " ".join(f"LEFT JOIN LATERAL (SELECT {_FOUR} AS {n}_state, CASE WHEN {_FOUR} = 'REPORTED' THEN min(raw_value) END AS {n}_raw FROM v_research_fields f WHERE f.position_observation_id = r.position_observation_id AND field_code = '{c}') {a} ON true" for a, c, n in (("i", "INDUSTRY", "industry"), ("t", "INSTRUMENT_TYPE", "instrument_type")))
    + " LEFT JOIN v_filing_shown s ON s.filing_id = r.filing_id",
)
entity("position_groups", "SELECT registrant_cik, count(*) AS line_count, count(DISTINCT reported_date) AS date_count, min(reported_date) AS first_date, max(reported_date) AS last_date FROM v_historical_positions GROUP BY 1")
_METRICS = ("fair_value_delta", "fair_value_change_percent", "fair_value_to_principal", "fair_value_to_cost")
entity("valuation_history", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT position_id, later_id, later_date, {' OR '.join(f'{x} IS NULL' for x in _METRICS)} AS has_unknown, '{m}' AS metric, {m}::VARCHAR AS text FROM v_borrower_position_valuation" for m in _METRICS) + ") WHERE text IS NOT NULL")
entity("maturity_wall", "SELECT position_observation_id, reported_date, maturity_raw, maturity_precision_class, maturity_bucket_year, (SELECT count(*) FROM v_borrower_maturity_observations WHERE maturity_observation_state LIKE 'UNRESOLVED%') AS unresolved_count FROM v_borrower_maturity_observations WHERE maturity_observation_state = 'OBSERVED'")
entity(
    "comparison_traces",
    "SELECT c.earlier_id, c.later_id, f.field_code, "
    + ", ".join(f"(SELECT list(id ORDER BY id) FROM v_current_position_field_value v WHERE v.position_observation_id = c.{s}_id AND v.field_code = f.field_code) AS {s}_ids" for s in ("earlier", "later"))
    + " FROM v_borrower_comparisons c CROSS JOIN (VALUES ('PRINCIPAL_AMOUNT'), ('COST'), ('FAIR_VALUE')) AS f(field_code)",
)
view("list_portfolios", "SELECT * FROM v_portfolio_registrant WHERE contains(lower(concat_ws(' ', registrant_cik, CASE WHEN name_state = 'REPORTED' THEN name_raw END)), '7')", lambda m, spark, sf: m.list_portfolios("7"))
view("list_registrant_coverage", "SELECT c.*, s.value AS name_raw FROM v_market_registrant_coverage c LEFT JOIN v_registrant_attribute_status s ON s.registrant_id = c.registrant_id AND s.attribute_code = 'NAME' WHERE contains(lower(concat_ws(' ', registrant_cik, s.value)), 'a')", lambda m, spark, sf: m.list_registrant_coverage("A"))
_JSON = "to_json({{{0}}})::VARCHAR AS json"


def _document(*columns: str) -> str:
    return _JSON.format(", ".join(f"'{c}': {c}::VARCHAR" for c in sorted(columns)))


view(
    "market_directory",
    f"""SELECT 'registrant' AS kind, registrant_cik AS key, {_document('registrant_id', 'registrant_cik', 'coverage_state')} FROM v_market_registrant_coverage
UNION ALL SELECT 'release', release_label, {_document('release_label', 'coverage_state', 'registrants_observed', 'dates_observed')} FROM v_market_release_coverage UNION ALL SELECT 'date', reported_date::VARCHAR, {_document('reported_date', 'registrants_observed')} FROM v_market_reported_date""",
)
view(
    "series_coverage",
    """WITH s AS (SELECT position_id, count(DISTINCT reported_date) AS dates, count(*) AS lines FROM v_position_read WHERE continuity_state = 'MATCHED' AND position_id IS NOT NULL AND reported_date IS NOT NULL GROUP BY 1)
SELECT CASE WHEN dates = 1 THEN 'ONE_DATE' WHEN EXISTS (SELECT 1 FROM v_position_period_comparison c WHERE c.position_id = s.position_id) THEN 'COMPARED' ELSE 'NOT_COMPARED' END AS series_kind, count(*) AS series_count, sum(lines)::BIGINT AS line_count FROM s GROUP BY 1""",
)
view(
    "currency_plan",
    """WITH f AS (SELECT *, regexp_matches(segments, '(^|;)(Range|InvestmentCompanyNonconsolidatedSubsidiary)=') AS x FROM obs_num_fact_observation),
h AS (SELECT v.id, p.filing_id, v.normalized_numeric AS value FROM v_current_position_field_value v JOIN obs_position_observation p ON p.id = v.position_observation_id WHERE field_code = 'FAIR_VALUE' AND value_state = 'REPORTED' AND currency_state = 'UNKNOWN'),
j AS (SELECT h.id, (SELECT count(*) FROM f WHERE f.filing_id = h.filing_id) AS n, (SELECT count(*) FROM f WHERE f.filing_id = h.filing_id AND NOT x) AS usable, (SELECT count(*) FROM f WHERE f.filing_id = h.filing_id AND NOT x AND f.value = h.value) AS equal,
  (SELECT count(DISTINCT unit) FROM f WHERE f.filing_id = h.filing_id AND NOT x AND f.value = h.value AND regexp_full_match(unit, '[A-Z]{3}')) AS units, (SELECT min(unit) FROM f WHERE f.filing_id = h.filing_id AND NOT x AND f.value = h.value AND regexp_full_match(unit, '[A-Z]{3}')) AS one FROM h)
SELECT id, CASE WHEN n = 0 THEN 'NO_FACT' WHEN usable = 0 THEN 'EXCLUDED' WHEN equal = 0 THEN 'NOT_EQUAL' WHEN units = 0 THEN 'NO_CURRENCY' WHEN units > 1 THEN 'MULTIPLE' ELSE 'PROMOTE' END AS outcome, CASE WHEN units = 1 THEN one END AS unit FROM j""",
)
view("matchable_instruments", f"SELECT p.id AS position_observation_id, t.type_state, trim(holding_descriptor_raw) <> '' AND t.type_state = 'REPORTED' AS can_match FROM obs_position_observation p LEFT JOIN LATERAL (SELECT {_FOUR} AS type_state FROM v_research_fields f WHERE f.position_observation_id = p.id AND field_code = 'INSTRUMENT_TYPE') t ON true")
asked("lines_at", "SELECT count(DISTINCT id) AS observation_count FROM v_lines WHERE reported_date = (SELECT later FROM v_asked)", lambda m, cik, earlier, later: m.lines_at(later))

SQL = {name: with_sql(sql, VIEWS) for name, sql in SQL.items()}
