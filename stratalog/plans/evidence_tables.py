"""The evidence model's tables made from the test tables, by SELECTs that Spark and DuckDB both read.

The test tables hold filings, attribute observations, schedule rows, names and loads; what the model keeps beside them (links,
field values, decisions, coverage) is derived from their ids, so that every state and every chain shape occurs. `tables` gives the
model's tables as DataFrames, `with_sql` the same as common table expressions for the comparison.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog.session import table

#: Field codes with their number here, kind, and whether only the original filing proves them.
FIELD_ROWS = (
    ("PRINCIPAL_AMOUNT", 1, "amount", False), ("COST", 2, "amount", False), ("FAIR_VALUE", 3, "amount", False), ("INTEREST_RATE", 4, "number", False), ("SPREAD", 5, "number", False),
    ("INTEREST_RATE_FLOOR", 6, "number", False), ("MATURITY_DATE", 7, "date", False), ("ACQUISITION_DATE", 8, "date", False), ("INSTRUMENT_TYPE", 9, "text", False), ("INDUSTRY", 10, "text", False),
    ("ISSUER_AFFILIATION", 11, "text", False), ("GEOGRAPHY", 12, "text", True), ("RESTRICTED", 13, "text", True), ("REFERENCE_RATE", 14, "text", True),
)
_FIELDS = "(VALUES " + ", ".join(f"('{c}', {n}, '{k}', {str(l).upper()})" for c, n, k, l in FIELD_ROWS) + ") AS f(field_code, n, kind, level2_required)"
_SPAN = "{soi_row_observation}"
_ENTITY = "'N' || lpad(CAST({0} AS STRING), 2, '0')"

#: Every name: those that were read, and of all other rows the identifier itself.
_NAMES = f"""
SELECT bno_id AS id, soi_row_id, source_column_label, extraction_state, normalized_text FROM {{p6_names}}
UNION ALL SELECT 10000000 + s.soi_row_id, s.soi_row_id, 'Investment, Identifier Axis', 'EXTRACTED', s.identifier_raw FROM {_SPAN} s WHERE s.identifier_raw IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{p6_names}} n WHERE n.soi_row_id = s.soi_row_id)"""

#: The values of one field of one position before chains are made of them.
_VALUES = f"""
SELECT s.soi_row_id AS s, f.n AS n, f.field_code, f.kind, s.filing_id,
  CASE WHEN (s.soi_row_id * 3 + f.n) % 11 = 0 THEN 'UNKNOWN' WHEN (s.soi_row_id * 3 + f.n) % 11 = 1 THEN 'NOT_APPLICABLE' ELSE 'REPORTED' END AS value_state,
  CASE WHEN s.soi_row_id % 4 = 0 THEN (s.soi_row_id * 7 + f.n * 13) % 1000 + 1 ELSE length(s.identifier_raw) * 10 + f.n END AS v
FROM {_SPAN} s CROSS JOIN {_FIELDS} WHERE s.identifier_raw IS NOT NULL AND (s.soi_row_id + f.n) % 6 <> 0"""

#: Chain shapes: the row itself, a second head beside it, a successor that replaces it.
_HEADS = "(VALUES (0, 1, 1), (1, 29, 0), (2, 10, 0)) AS k(step, every, first)"

ADAPTERS: dict[str, str] = {
    "raw.artifact": """
SELECT artifact_id AS id, CASE artifact_id % 3 WHEN 0 THEN 'SEC_SUBMISSIONS_JSON' WHEN 1 THEN 'SEC_BDC_DATASET_ZIP' ELSE 'SEC_BDC_REPORT_CSV' END AS source_type_code,
  CASE WHEN artifact_id % 3 = 0 THEN 'https://example.org/submissions/CIK' || lpad(CAST(artifact_id % 50 AS STRING), 10, '0') || '.json' ELSE 'https://example.org/files/' || CAST(artifact_id % 40 AS STRING) || '.csv' END AS source_url,
  artifact_id AS retrieved_at
FROM (SELECT artifact_id FROM {rfact} UNION SELECT artifact_id FROM {table_load}) a WHERE artifact_id IS NOT NULL
UNION ALL SELECT id, code, url, id FROM (VALUES (-1, 'SEC_SUBMISSIONS_JSON', 'https://example.org/submissions/CIK0000000001.json'), (-2, 'SEC_BDC_DATASET_ZIP', 'https://example.org/files/a.zip'), (-3, 'SEC_FILING_DOCUMENT', 'https://example.org/doc.htm')) AS x(id, code, url)""",
    "evidence.evidence": """
SELECT a.artifact_id * 4 + k.k AS id, CASE (a.artifact_id + k.k) % 3 WHEN 0 THEN 'L2_ORIGINAL_FILING' ELSE 'L1_STRUCTURED' END AS evidence_level, a.artifact_id, k.locator_type, k.column_label, k.json_path, k.row_number, k.column_number
FROM (SELECT artifact_id FROM {rfact} UNION SELECT artifact_id FROM {table_load}) a
CROSS JOIN (VALUES (0, 'JSON_PATH', CAST(NULL AS STRING), '$."names"[3]', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)), (1, 'TSV_CELL', 'Form', NULL, 4, 2), (2, 'TSV_ROW', NULL, NULL, 4, NULL), (3, 'HTML_ANCHOR', NULL, NULL, NULL, NULL)) AS k(k, locator_type, column_label, json_path, row_number, column_number)
WHERE a.artifact_id IS NOT NULL
UNION ALL SELECT 1000001 + n, CASE WHEN n % 3 = 0 THEN 'L2_ORIGINAL_FILING' ELSE 'L1_STRUCTURED' END, CASE WHEN n % 2 = 0 THEN -3 ELSE -1 END, CASE WHEN n % 2 = 0 THEN 'HTML_ANCHOR' ELSE 'JSON_PATH' END, NULL, CASE WHEN n % 2 = 1 THEN '$."filings"[' || CAST(n AS STRING) || ']' END, NULL, NULL
FROM (VALUES (0), (1), (2), (3), (4), (5), (6)) AS x(n)""",
    "raw.table_load": "SELECT table_load_id AS id, artifact_id, table_code, row_count, parse_status, header FROM {table_load}",
    "raw.tabular_row": "SELECT soi_row_id AS id, table_load_id, CASE WHEN soi_row_id % 41 = 0 THEN 'FIELD_COUNT_MISMATCH' ELSE 'OK' END AS parse_status FROM {soi_row_observation}",
    "ops.projection_exception": "SELECT soi_row_id AS id, CASE WHEN soi_row_id % 5 = 0 THEN table_load_id + 1 ELSE table_load_id END AS table_load_id, soi_row_id AS tabular_row_id, CASE line_number % 3 WHEN 0 THEN 'ORPHAN_ADSH' WHEN 1 THEN 'FIELD_COUNT_MISMATCH' ELSE 'OTHER' END AS kind FROM {soi_row_observation} WHERE soi_row_id % 37 = 0",
    "ops.run": "SELECT table_load_id AS id, CASE WHEN table_load_id % 2 = 0 THEN 'LOAD' ELSE 'BIND' END AS run_kind, recorded_at AS started_at FROM {table_load}",
    "ops.run_outcome": "SELECT table_load_id AS run_id, CASE WHEN table_load_id % 4 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, recorded_at AS finished_at FROM {table_load} WHERE table_load_id % 3 <> 0",
    "ops.artifact_processing": "SELECT table_load_id * 2 + k AS id, artifact_id, CASE (table_load_id + k) % 3 WHEN 0 THEN 'SCHEMA_DRIFT' ELSE 'LOADED' END AS outcome FROM {table_load} CROSS JOIN (VALUES (0), (1)) AS x(k) WHERE table_load_id % 4 <> 0 UNION ALL SELECT -1, -3, 'LOADED'",
    "ops.coverage_assertion": """
SELECT t.table_load_id * 100 + k.k AS id, CASE WHEN k.k = 3 THEN t.table_load_id * 100 END AS supersedes_id, CAST(NULL AS BIGINT) AS registrant_id, t.table_load_id AS dataset_release_id, CAST(NULL AS DATE) AS reporting_period_end,
  'SEC_BDC_DATASET_ZIP' AS source_type_code, k.aspect AS coverage_aspect, CASE (t.table_load_id + k.k) % 3 WHEN 0 THEN 'COVERED' WHEN 1 THEN 'EMPTY_PERIOD' ELSE 'NOT_INGESTED' END AS coverage_state
FROM {table_load} t CROSS JOIN (VALUES (0, 'SOI_HOLDINGS'), (1, 'FILING_METADATA'), (3, 'SOI_HOLDINGS')) AS k(k, aspect) WHERE k.k <> 3 OR t.table_load_id % 2 = 0
UNION ALL
SELECT 10000000 + r.registrant_id * 10 + k.k, NULL, r.registrant_id, CASE WHEN k.k = 1 THEN r.registrant_id END, NULL, k.code, k.aspect, CASE (r.registrant_id + k.k) % 3 WHEN 0 THEN 'COVERED' ELSE 'NOT_INGESTED' END
FROM (SELECT DISTINCT registrant_id FROM {filing}) r CROSS JOIN (VALUES (0, 'SEC_SUBMISSIONS_JSON', 'FILING_HISTORY'), (1, 'SEC_BDC_DATASET_ZIP', 'FILING_METADATA'), (2, 'SEC_BDC_DATASET_ZIP', 'SOI_HOLDINGS')) AS k(k, code, aspect)""",
    "ref.source_column_mapping": """
SELECT n AS id, before AS supersedes_id, status AS mapping_status FROM (VALUES (1, CAST(NULL AS BIGINT), 'DOCUMENTED'), (2, NULL, 'OBSERVED_UNCONFIRMED'), (3, NULL, 'REJECTED'), (4, NULL, 'DOCUMENTED_AND_OBSERVED'), (5, NULL, 'OPEN_QUESTION'),
  (6, NULL, 'DOCUMENTED'), (7, NULL, 'DOCUMENTED'), (20, 6, 'OPEN_QUESTION'), (21, 20, 'REJECTED'), (22, 2, 'DOCUMENTED')) AS x(n, before, status)""",
    "ref.registrant_attribute": "SELECT DISTINCT attribute_code AS code FROM {rfact} UNION SELECT 'FILE_NUMBER'",
    "ref.field_definition": f"SELECT field_code, level2_required FROM {_FIELDS}",
    "ref.registry_field_mapping": """
SELECT source_type_code, source_field, target_kind, target_code, mapping_status FROM (VALUES ('SEC_SUBMISSIONS_JSON', '$."names"[*]', 'REGISTRANT_ATTRIBUTE', 'NAME', 'DOCUMENTED'), ('SEC_BDC_DATASET_ZIP', 'Form', 'REGISTRANT_ATTRIBUTE', 'CITY', 'OBSERVED'),
  ('SEC_SUBMISSIONS_JSON', '$."filings"[*]', 'FILING_ATTRIBUTE', 'FORM', 'DOCUMENTED'), ('SEC_FILING_DOCUMENT', 'link', 'FILING_ATTRIBUTE', 'FILED_DATE', 'DOCUMENTED')) AS x(source_type_code, source_field, target_kind, target_code, mapping_status)""",
    "registry.registrant": "SELECT registrant_id AS id, registrant_id * 11 AS cik FROM (SELECT registrant_id FROM {filing} UNION SELECT registrant_id FROM {rfact} UNION SELECT registrant_id + 1 FROM {filing}) r WHERE registrant_id IS NOT NULL",
    "registry.filing": "SELECT filing_id AS id, accession_number FROM {filing}",
    "registry.filing_registrant_link": """
SELECT f.filing_id * 10 + k.k AS id, CASE WHEN k.k = 4 THEN f.filing_id * 10 + 1 END AS supersedes_id, f.filing_id, f.registrant_id + k.other AS registrant_id, k.source AS link_source
FROM {filing} f CROSS JOIN (VALUES (1, 1, 0, 'SUB_TSV'), (2, 7, 0, 'SUBMISSIONS_JSON'), (3, 11, 1, 'SUBMISSIONS_JSON'), (4, 5, 0, 'SUB_TSV')) AS k(k, every, other, source) WHERE f.filing_id % k.every = 0 AND f.filing_id % 13 <> 0""",
    "registry.filing_relationship_decision": """
SELECT filing_id * 2 + k AS id, CASE WHEN k = 1 THEN filing_id * 2 END AS supersedes_id, filing_id, CASE WHEN filing_id % 20 = 0 THEN 'CORRECTS' ELSE 'AMENDS' END AS relationship_type, CASE (filing_id + k) % 3 WHEN 0 THEN 'MATCHED' WHEN 1 THEN 'UNRESOLVED' ELSE 'REJECTED' END AS state
FROM {filing} CROSS JOIN (VALUES (0), (1)) AS x(k) WHERE filing_id % 4 = 0 AND (k = 0 OR filing_id % 8 = 0)""",
    "registry.registrant_attribute_observation": "SELECT rfact_id AS id, CASE WHEN rfact_id % 5 = 0 THEN rfact_id - 1 END AS supersedes_id, registrant_id, attribute_code, raw_value, normalized_value, artifact_id * 4 + rfact_id % 4 AS evidence_id FROM {rfact}",
    "registry.filing_attribute_observation": """
SELECT f.filing_id * 10 + k.k AS id, CAST(NULL AS BIGINT) AS supersedes_id, f.filing_id, k.code AS attribute_code,
  CASE k.k WHEN 1 THEN CASE f.filing_id % 3 WHEN 0 THEN '10-K' ELSE '10-Q' END WHEN 2 THEN '10-Q/A' WHEN 4 THEN CASE WHEN f.filing_id % 2 = 0 THEN '814-00' ELSE '333-00' END || CAST(f.registrant_id AS STRING)
    WHEN 5 THEN CASE WHEN f.filing_id % 7 = 0 THEN 'https://example.org/x' ELSE 'https://www.sec.gov/Archives/edgar/data/' || CAST(f.filing_id AS STRING) END ELSE CAST(CAST(f.recorded_at AS DATE) AS STRING) END AS raw_value,
  CASE k.k WHEN 1 THEN CASE f.filing_id % 3 WHEN 0 THEN '10-K' ELSE '10-Q' END WHEN 2 THEN '10-Q/A' WHEN 3 THEN CAST(CAST(f.recorded_at AS DATE) AS STRING) END AS normalized_value,
  CASE WHEN f.filing_id % 31 = 0 THEN 'UNKNOWN' ELSE 'REPORTED' END AS value_state, 1000001 + f.filing_id % 7 AS evidence_id
FROM {filing} f CROSS JOIN (VALUES (1, 1, 'FORM'), (2, 9, 'FORM'), (3, 1, 'FILED_DATE'), (4, 3, 'FILE_NUMBER'), (5, 2, 'INLINE_URL')) AS k(k, every, code) WHERE f.filing_id % k.every = 0""",
    "registry.filing_document": """
SELECT f.filing_id * 2 + k.k AS id, f.filing_id, CASE WHEN f.filing_id % 6 = 0 THEN 'https://example.org/' ELSE 'https://www.sec.gov/Archives/edgar/data/' END || CAST(CASE WHEN f.filing_id % 11 = 0 THEN 0 ELSE f.registrant_id * 11 END AS STRING) || '/' || replace(f.accession_number, '-', '') || '/' || CAST(k.k AS STRING) || '.htm' AS document_url,
  CAST(k.k AS STRING) || '.htm' AS document_name, k.named_by FROM {filing} f CROSS JOIN (VALUES (0, 'FILING_INDEX'), (1, 'SUBMISSIONS_PRIMARY_DOCUMENT')) AS k(k, named_by) WHERE k.k = 1 OR f.filing_id % 3 = 0""",
    "registry.filing_document_artifact": "SELECT filing_id * 2 + 1 AS filing_document_id, CAST(-3 AS BIGINT) AS artifact_id FROM {filing} WHERE filing_id % 5 <> 0",
    "registry.bdc_report_edition": "SELECT n AS id, 'https://example.org/files/' || CAST(n AS STRING) || '.csv' AS csv_url FROM (SELECT DISTINCT table_load_id % 40 AS n FROM {table_load}) x",
    "registry.dataset_release": "SELECT table_load_id AS id, '2099_' || lpad(CAST(table_load_id AS STRING), 2, '0') AS release_label, make_date(2099, CAST(1 + (table_load_id - 1) % 12 AS INT), 1) AS window_start, last_day(make_date(2099, CAST(1 + (table_load_id - CASE WHEN table_load_id % 5 = 0 THEN 2 ELSE 1 END) % 12 AS INT), 1)) AS window_end FROM {table_load}",
    "registry.dataset_release_artifact": "SELECT table_load_id AS dataset_release_id, artifact_id FROM {table_load} UNION ALL SELECT table_load_id - 1, artifact_id FROM {table_load} WHERE table_load_id % 7 = 0",
    "registry.dataset_release_listing": "SELECT table_load_id AS dataset_release_id FROM {table_load} CROSS JOIN (VALUES (0), (1)) AS x(k) WHERE table_load_id % 3 <> 1",
    "obs.soi_row_observation": "SELECT soi_row_id AS id, soi_row_id AS tabular_row_id, identifier_raw, qtrs, filing_id, reported_date FROM {soi_row_observation}",
    "obs.soi_row_classification": "SELECT soi_row_id * 2 + k AS id, CASE WHEN k = 1 THEN soi_row_id * 2 END AS supersedes_id, soi_row_id AS soi_row_observation_id, CASE (soi_row_id + k) % 3 WHEN 0 THEN 'CURRENT' ELSE 'COMPARATIVE' END AS period_role, CASE WHEN soi_row_id % 13 = 0 THEN 'SUBTOTAL_ROW' WHEN soi_row_id % 17 = 0 THEN 'TOTAL_ROW' ELSE 'IDENTIFIER_ROW' END AS row_kind, 1000001 + soi_row_id % 7 AS evidence_id FROM {soi_row_observation} CROSS JOIN (VALUES (0), (1)) AS x(k) WHERE soi_row_id % 3 <> 0 AND (k = 0 OR soi_row_id % 10 = 1)",
    "obs.position_observation": "SELECT soi_row_id AS id, filing_id, reported_date, duration_kind, soi_row_id AS origin_soi_row_observation_id, identifier_raw AS holding_descriptor_raw, 1000001 + soi_row_id % 7 AS evidence_id FROM {soi_row_observation} WHERE identifier_raw IS NOT NULL",
    "obs.position_field_value": f"""
SELECT (b.s * 20 + b.n) * 4 + k.step AS id, CASE WHEN k.step = 2 THEN (b.s * 20 + b.n) * 4 END AS supersedes_id, b.s AS position_observation_id, b.field_code, b.value_state, CASE WHEN b.n % 2 = 0 THEN 'Label ' || CAST(b.n AS STRING) ELSE b.field_code END AS source_column_label,
  CASE WHEN b.value_state = 'REPORTED' THEN CASE b.kind WHEN 'date' THEN CASE WHEN b.s % 3 <> 0 THEN CAST(make_date(CAST(2026 + b.s % 6 AS INT), CAST(1 + b.v % 12 AS INT), CAST(1 + b.s % 28 AS INT)) AS STRING) ELSE CAST(1 + b.v % 12 AS STRING) || '/' || CAST(2026 + b.s % 6 AS STRING) END
    WHEN 'text' THEN 'T' || CAST((b.v + k.step) % 5 AS STRING) ELSE CAST(b.v + k.step AS STRING) END END AS raw_value,
  CASE WHEN b.value_state = 'REPORTED' AND b.kind IN ('amount', 'number') AND b.s % 23 <> 0 THEN CAST(b.v + k.step AS DECIMAL(38, 10)) END AS normalized_numeric,
  CASE WHEN b.value_state = 'REPORTED' AND b.kind = 'date' AND b.s % 3 <> 0 THEN make_date(CAST(2026 + b.s % 6 AS INT), CAST(1 + b.v % 12 AS INT), CAST(1 + b.s % 28 AS INT)) END AS normalized_date,
  CASE WHEN b.value_state = 'REPORTED' AND b.kind = 'date' AND b.s % 3 = 0 THEN 'MONTH' END AS date_precision,
  CASE WHEN b.value_state = 'REPORTED' AND b.kind = 'date' AND b.s % 3 = 0 THEN CAST(2026 + b.s % 6 AS INT) END AS normalized_year, CASE WHEN b.value_state = 'REPORTED' AND b.kind = 'date' AND b.s % 3 = 0 THEN CAST(1 + b.v % 12 AS INT) END AS normalized_month,
  CASE WHEN b.kind = 'amount' THEN CASE b.s % 9 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'FROM_NUM_UNIQUE_MATCH' ELSE 'FROM_FILING' END END AS currency_state,
  CASE WHEN b.kind = 'amount' AND b.s % 9 > 1 THEN CASE WHEN b.filing_id % 4 = 0 THEN 'EUR' ELSE 'USD' END END AS currency_code,
  CASE WHEN b.s % 17 = 0 THEN 'UNRESOLVED' ELSE 'STATED' END AS scale_state, CASE WHEN b.n <= 7 THEN b.n END AS column_mapping_id, 1000001 + b.s % 7 AS evidence_id
FROM ({_VALUES}) b CROSS JOIN {_HEADS} WHERE (b.s * b.n) % k.every = 0 OR k.first = 1""",
    "obs.maturity_inspection": """
SELECT soi_row_id * 2 + k AS id, CASE WHEN k = 1 THEN soi_row_id * 2 END AS supersedes_id, soi_row_id AS position_observation_id, CASE (soi_row_id + k) % 4 WHEN 0 THEN 'NOT_BOUND' WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN 'FILING_DISPLAYED' ELSE 'FILING_MONTH' END AS inspection_state,
  CASE WHEN (soi_row_id + k) % 4 > 1 THEN 'shown ' || CAST(soi_row_id % 6 AS STRING) END AS raw_value, CASE WHEN (soi_row_id + k) % 4 = 2 THEN make_date(CAST(2026 + soi_row_id % 6 AS INT), CAST(1 + (length(identifier_raw) * 10 + 7) % 12 AS INT), CAST(1 + soi_row_id % 28 AS INT)) END AS normalized_date,
  CASE WHEN (soi_row_id + k) % 4 = 3 THEN CAST(2026 + soi_row_id % 6 AS INT) END AS displayed_year, CASE WHEN (soi_row_id + k) % 4 = 3 THEN CAST(1 + (length(identifier_raw) * 10 + 7) % 12 AS INT) END AS displayed_month,
  CASE WHEN (soi_row_id + k) % 4 = 0 THEN 'NO_ROW' END AS no_bind_reason, 1000001 + (soi_row_id + k) % 7 AS evidence_id
FROM {soi_row_observation} CROSS JOIN (VALUES (0), (1)) AS x(k) WHERE identifier_raw IS NOT NULL AND soi_row_id % 5 <> 4 AND (k = 0 OR soi_row_id % 10 = 2)""",
    "obs.borrower_name_observation": f"SELECT id, CASE WHEN id % 19 = 0 THEN id - 1 END AS supersedes_id, soi_row_id AS position_observation_id, source_column_label, extraction_state, CASE WHEN id % 23 <> 0 THEN normalized_text END AS normalized_text FROM ({_NAMES}) n",
    "validation.evidence_status_assertion": f"""
SELECT (b.s * 20 + b.n) * 2 + k AS id, CASE WHEN k = 1 THEN (b.s * 20 + b.n) * 2 END AS supersedes_id, (b.s * 20 + b.n) * 4 + CASE WHEN (b.s * b.n) % 10 = 0 THEN 2 ELSE 0 END AS field_value_id, CASE (b.s + b.n + k) % 3 WHEN 0 THEN 'FILING_VERIFIED' WHEN 1 THEN 'FILING_MISMATCH' ELSE 'CHECK_FAILED' END AS evidence_status, b.s AS validation_result_id
FROM ({_VALUES}) b CROSS JOIN (VALUES (0), (1)) AS x(k) WHERE (b.s + b.n) % 4 = 0 AND (k = 0 OR b.s % 3 = 0)""",
    "resolution.entity_resolution_decision": f"SELECT id, CAST(NULL AS BIGINT) AS supersedes_id, id AS borrower_name_observation_id, CASE WHEN id % 6 = 0 THEN 'UNRESOLVED' ELSE 'MATCHED' END AS state, CASE WHEN id % 6 <> 0 THEN {_ENTITY.format('length(normalized_text) % 25')} END AS legal_entity_id FROM ({_NAMES}) n WHERE normalized_text IS NOT NULL",
    "resolution.group_membership_decision": f"SELECT n_nationkey * 2 + k AS id, CASE WHEN k = 1 AND n_nationkey % 4 = 0 THEN n_nationkey * 2 END AS supersedes_id, {_ENTITY.format('n_nationkey')} AS legal_entity_id, CASE WHEN (n_nationkey + k) % 5 = 0 THEN 'UNRESOLVED' ELSE 'MATCHED' END AS state, 'G' || CAST(n_regionkey + k AS STRING) AS economic_group_id FROM {{nation}} CROSS JOIN (VALUES (0), (1)) AS x(k) WHERE k = 0 OR n_nationkey % 2 = 0",
    "resolution.instrument_resolution_decision": "SELECT soi_row_id * 2 + k AS id, CAST(NULL AS BIGINT) AS supersedes_id, soi_row_id AS position_observation_id, CASE WHEN soi_row_id % 14 = 0 THEN 'UNRESOLVED' ELSE 'MATCHED' END AS state, CASE WHEN soi_row_id % 14 <> 0 THEN 'I' || identifier_raw END AS instrument_id FROM {soi_row_observation} CROSS JOIN (VALUES (0), (1)) AS x(k) WHERE identifier_raw IS NOT NULL AND (k = 0 OR soi_row_id % 47 = 0)",
    "resolution.position_continuity_decision": "SELECT soi_row_id * 2 + k AS id, CASE WHEN k = 1 THEN soi_row_id * 2 END AS supersedes_id, soi_row_id AS position_observation_id, CASE WHEN (soi_row_id + k) % 16 = 0 THEN 'UNRESOLVED' ELSE 'MATCHED' END AS state, CASE WHEN (soi_row_id + k) % 16 <> 0 THEN 'P' || identifier_raw END AS position_id FROM {soi_row_observation} CROSS JOIN (VALUES (0), (1)) AS x(k) WHERE identifier_raw IS NOT NULL AND (k = 0 OR soi_row_id % 32 = 0)",
    "resolution.legal_entity_consolidation_decision": f"""
SELECT n_nationkey * 2 + k AS id, CASE WHEN k = 1 THEN n_nationkey * 2 END AS supersedes_id, {_ENTITY.format('n_nationkey')} AS from_legal_entity_id, CASE WHEN k = 1 AND n_nationkey % 4 = 0 THEN 'PROBABLE' WHEN k = 1 THEN 'REJECTED' ELSE 'MATCHED' END AS state,
  CASE WHEN k = 0 OR n_nationkey % 4 = 0 THEN {_ENTITY.format('CASE WHEN n_nationkey IN (21, 22) THEN 43 - n_nationkey ELSE n_nationkey + 2 + k END')} END AS to_legal_entity_id
FROM {{nation}} CROSS JOIN (VALUES (0), (1)) AS x(k) WHERE n_nationkey % 5 <> 3 AND n_nationkey < 23 AND (k = 0 OR n_nationkey % 2 = 0 AND n_nationkey < 20)""",
    "obs.position_observation_source": """
SELECT soi_row_id AS position_observation_id, soi_row_id + k.step AS soi_row_observation_id, k.source_role FROM {soi_row_observation} CROSS JOIN (VALUES (0, 1, 'PRIMARY'), (1, 9, 'SECONDARY')) AS k(step, every, source_role)
WHERE identifier_raw IS NOT NULL AND soi_row_id % k.every = 0 AND (soi_row_id % 29 <> 0 OR k.step = 1)""",
    "obs.soi_fact_group": "SELECT soi_row_id AS id, filing_id FROM {soi_row_observation} WHERE soi_row_id % 10 = 0",
    "obs.soi_fact_group_member": "SELECT s.soi_row_id - k.step AS group_id, s.soi_row_id AS soi_row_observation_id, s.filing_id, CASE WHEN s.soi_row_id % 70 = 1 THEN 'PIK' ELSE k.role END AS member_role FROM {soi_row_observation} s CROSS JOIN (VALUES (0, 'BALANCE'), (1, 'SPREAD'), (2, 'PIK')) AS k(step, role) WHERE (s.soi_row_id - k.step) % 10 = 0 AND s.soi_row_id % 40 <> 0",
    "obs.num_fact_observation": """
SELECT tabular_row_id AS id, 1 + tabular_row_id % 97 AS filing_id, CAST(CASE WHEN tabular_row_id % 2 = 0 THEN 303 + tabular_row_id % 3 * 10 ELSE 100 + tabular_row_id % 90 * 10 END AS DECIMAL(38, 10)) AS value, CASE tabular_row_id % 5 WHEN 0 THEN 'pure' WHEN 1 THEN 'EUR' ELSE 'USD' END AS unit,
  CASE tabular_row_id % 7 WHEN 0 THEN 'InvestmentIdentifier=a;Range=Minimum' WHEN 1 THEN 'InvestmentIdentifier=Range=x' ELSE 'InvestmentIdentifier=a' END AS segments FROM {ok_row}""",
    "obs.field_value_corroboration": f"SELECT (b.s * 20 + b.n) * 4 AS field_value_id, 1 + b.s % 300 AS num_fact_observation_id FROM ({_VALUES}) b WHERE b.n = 3",
    "resolution.position": "SELECT 'P' || s.identifier_raw AS id, min(f.registrant_id) AS registrant_id FROM {soi_row_observation} s JOIN {filing} f ON f.filing_id = s.filing_id WHERE s.identifier_raw IS NOT NULL GROUP BY s.identifier_raw",
    "validation.validation_result": "SELECT soi_row_id AS id, CASE WHEN soi_row_id % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS outcome, 1000001 + soi_row_id % 7 AS evidence_id FROM {soi_row_observation}",
    "derived.derived_value": "SELECT soi_row_id AS id, CASE WHEN soi_row_id % 12 = 0 THEN 'NORMALISATION' ELSE 'DERIVATION' END AS rule_kind FROM {soi_row_observation} WHERE soi_row_id % 4 = 0",
    "derived.derived_value_input": f"SELECT b.s AS derived_value_id, (b.s * 20 + b.n) * 4 AS field_value_id FROM ({_VALUES}) b WHERE b.s % 4 = 0 AND b.s % 16 <> 0 AND b.n <= 3",
    "derived.observation_event": "SELECT soi_row_id AS id, soi_row_id AS position_observation_id, CASE WHEN soi_row_id % 21 = 0 THEN NULL ELSE reported_date END AS event_date, 1000001 + CASE WHEN soi_row_id % 25 = 0 THEN 0 ELSE soi_row_id % 7 END AS evidence_id, 'FIRST_OBSERVED' AS event_type FROM {soi_row_observation} WHERE soi_row_id % 3 = 0",
    "obs.maturity_inspection_candidate": "SELECT soi_row_id * 2 AS maturity_inspection_id, soi_row_id AS num FROM {soi_row_observation} WHERE soi_row_id % 6 = 0",
    "identity.legal_entity": f"SELECT {_ENTITY.format('n_nationkey')} AS id, n_name AS display_name FROM {{nation}}",
    "identity.legal_entity_identifier": f"SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey - 1 END AS supersedes_id, {_ENTITY.format('s_nationkey')} AS legal_entity_id, CASE WHEN s_suppkey % 2 = 0 THEN 'LEI' ELSE 'CIK' END AS scheme, CASE WHEN s_suppkey % 3 = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verification_state, CASE WHEN s_suppkey % 4 = 0 THEN 'PARENT' ELSE 'OWN' END AS relationship_role FROM {{supplier}}",
}


def _bases(sql: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", sql))


def tables(spark: SparkSession, directory: str) -> Callable[[str], DataFrame]:
    """A function from a model table's name to its DataFrame over the test tables of a directory."""
    made: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in made:
            sql = ADAPTERS[name]
            made[name] = spark.sql(sql, **{base: table(spark, directory, base) for base in _bases(sql)})
        return made[name]

    return get


def with_sql(query: str, views: dict[str, str]) -> str:
    """query with everything it reads before it: views by their names, model tables as schema_table, as common table expressions."""
    known = {name.replace(".", "_"): re.sub(r"\{(\w+)\}", r"\1", sql) for name, sql in ADAPTERS.items()} | views
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\b[a-z]\w*\b", sql):
            if name in known and name not in order:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(query)
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + query if order else query
