"""The queries of the general data problems over the test tables (p1, p3, p4, p6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators.copies import copy_differences
from stratalog.operators.history import attribute_history
from stratalog.operators.orphans import orphan_references, orphan_report, quarter
from stratalog.operators.parse_failures import loaded_rows, parse_failures
from stratalog.session import table

_BLANKS = " \t\r\n"


def accession18(text: Column) -> Column:
    """The 18 digits of an accession number however it is written; null if there are not 18."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) == 18, digits)


def accession_text(digits: Column) -> Column:
    return F.concat_ws("-", F.substring(digits, 1, 10), F.substring(digits, 11, 2), F.substring(digits, 13, 6))


def _known(text: Column) -> Column:
    """Without outer blanks; null for blank."""
    return F.nullif(F.btrim(text, F.lit(_BLANKS)), F.lit(""))


def _day_text(text: Column, form: str) -> Column:
    """The day as yyyy-MM-dd; a text that is no day stays as it is."""
    known = _known(text)
    return F.coalesce(F.try_to_date(known, form).cast("string"), known)


def _number_text(text: Column) -> Column:
    known = _known(text.cast("string"))
    return F.coalesce(known.try_cast("decimal(38,0)").cast("string"), known)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "rfact")
    history = attribute_history(rows, ["registrant_id", "attribute_code"], ["normalized_value"], "source_as_of", ["recorded_at", "rfact_id"])
    return history.select("registrant_id", "attribute_code", "valid_from", "valid_to")


def _filing_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sub = table(spark, sf, "sub_filing").select(
        accession18(F.col("adsh")).alias("accession"),
        F.upper(_known(F.col("sub_form"))).alias("form"),
        _day_text(F.col("sub_filed"), "yyyyMMdd").alias("filed"),
        _day_text(F.col("period_end"), "yyyyMMdd").alias("period"),
        _number_text(F.col("cik")).alias("cik"),
        "recorded_at",
        F.col("sub_row_id").alias("row_id"),
    )
    sj = table(spark, sf, "sj_filing").select(
        accession18(F.col("accession_number")).alias("accession"),
        F.upper(_known(F.col("sj_form"))).alias("form"),
        _day_text(F.col("sj_filed"), "yyyy-MM-dd").alias("filed"),
        _day_text(F.col("report_date"), "yyyy-MM-dd").alias("period"),
        _number_text(F.col("cik")).alias("cik"),
        "recorded_at",
        F.col("sj_row_id").alias("row_id"),
    )
    return sub, sj


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    sub, sj = _filing_sides(spark, sf)
    found = copy_differences(sub, sj, "accession", ["form", "filed", "period", "cik"], ["recorded_at", "row_id"], ["recorded_at", "row_id"], "sub", "sj")
    return found.select(accession_text(F.col("accession")).alias("accession_number"), "field_name", "finding")


def _references(spark: SparkSession, sf: str) -> DataFrame:
    parts = (
        ("ok_row", "tabular_row_id", F.get("cells", F.lit(0))),
        ("sub_filing", "sub_row_id", F.col("adsh")),
        ("sj_filing", "sj_row_id", F.col("accession_number")),
    )
    rows = None
    for name, row_id, number in parts:
        part = table(spark, sf, name).select(F.lit(name).alias("table_name"), F.col(row_id).alias("row_id"), accession18(number).alias("accession"), F.col("recorded_at").alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("accession is not null").withColumn("period", quarter(F.col("at")))


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    filings = table(spark, sf, "filing").select(accession18(F.col("accession_number")).alias("accession"), "recorded_at", "withdrawn_at")
    return orphan_references(_references(spark, sf), filings, "accession", "at", "recorded_at", "withdrawn_at")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("table_name", "row_id", "period", "reason")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(_references(spark, sf), _orphans(spark, sf), ["table_name", "period"])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    failed = parse_failures(table(spark, sf, "tsv_line"), table(spark, sf, "table_load"), "table_load_id", ["table_load_id", "line_number"], "raw_line")
    return failed.select("table_load_id", "line_number", "reason")


def p6_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return loaded_rows(table(spark, sf, "tsv_line"), table(spark, sf, "table_load"), "table_load_id", ["table_load_id", "line_number"], "raw_line").select(
        "table_load_id", "line_number", "table_code", F.map_values("record").alias("cells")
    )


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p4_found, p4_report, p6_found, p6_loaded)}

_P4_CASES = """
WITH f AS (SELECT regexp_replace(accession_number, '[^0-9]', '', 'g') AS k, recorded_at AS s, withdrawn_at AS e FROM filing),
r AS (
  SELECT * FROM (
    SELECT 'ok_row' AS table_name, tabular_row_id AS row_id, regexp_replace(cells[1], '[^0-9]', '', 'g') AS k, recorded_at AS t FROM ok_row
    UNION ALL SELECT 'sub_filing', sub_row_id, regexp_replace(adsh, '[^0-9]', '', 'g'), recorded_at FROM sub_filing
    UNION ALL SELECT 'sj_filing', sj_row_id, regexp_replace(accession_number, '[^0-9]', '', 'g'), recorded_at FROM sj_filing)
  WHERE length(k) = 18),
c AS (
  SELECT table_name, row_id, year(t) || 'Q' || quarter(t) AS period,
    CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.k = r.k AND f.s <= r.t AND (f.e IS NULL OR f.e > r.t)) THEN NULL
         WHEN NOT EXISTS (SELECT 1 FROM f WHERE f.k = r.k) THEN 'missing'
         WHEN NOT EXISTS (SELECT 1 FROM f WHERE f.k = r.k AND f.s <= r.t) THEN 'late' ELSE 'deleted' END AS reason
  FROM r)
"""



def p6_sql(*further: str) -> str:
    """The lines with their cells and reason `why` (null: sound), by regular expressions over whole lines."""
    cell_of = lambda d: rf'"(?:[^"]|"")*"|[^"{d}][^{d}]*|'
    whole = lambda d: rf"regexp_full_match(s, '(?:{cell_of(d)})(?:{d}(?:{cell_of(d)}))*')"
    cells = lambda d: rf"regexp_extract_all('{d}' || s, '{d}({cell_of(d)})', 1)"
    g = lambda x: f"coalesce(cells[list_position(header, '{x}')], '')"
    like = lambda x, pattern: f"regexp_full_match({g(x)}, '{pattern}')"
    day = lambda x: like(x, "[0-9]{4}-[0-9]{2}-[0-9]{2}") + f" AND try_cast({g(x)} AS DATE) IS NOT NULL"
    number = lambda x: like(x, r"(-?[0-9]+(\.[0-9]+)?)?")
    adsh, qtrs = like("adsh", "[0-9]{10}-[0-9]{2}-[0-9]{6}"), like("qtrs", "[0-9]+")
    maturity, f = "Investment Maturity Date", g("Filing Date")
    soi = [adsh, like("cik", "[0-9]{1,10}"), day("ddate"), day("filed"), day("period"), qtrs, f"({g(maturity)} = '' OR {day(maturity)})"]
    soi += [number(x) for x in ("Investment Owned, Balance, Principal Amount", "Investment Owned, Cost", "Investment Owned, Fair Value")]
    num = [adsh, *[f"{g(x)} <> ''" for x in ("tag", "version", "uom")], like("ddate", "[0-9]{8}"), f"try_strptime({g('ddate')}, '%Y%m%d') IS NOT NULL", qtrs, number("value")]
    num += [like("footlen", "[0-9]+"), f"try_cast({g('footlen')} AS HUGEINT) = octet_length(encode({g('footnote')}))"]
    bdc = [like("CIK", "[0-9]{10}"), f"{g('Registrant_Name')} <> ''", like("Filing Date", "[0-9]{2}/[0-9]{2}/[0-9]{2}"), f"try_cast('20' || substr({f}, 7, 2) || '-' || substr({f}, 1, 2) || '-' || substr({f}, 4, 2) AS DATE) IS NOT NULL"]
    tab = "\\t"
    return f"""
WITH l AS (
  SELECT t.table_load_id, line_number, table_code, header, delimiter AS d, raw_line, CASE WHEN raw_line LIKE '%' || chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS s
  FROM tsv_line t LEFT JOIN table_load USING (table_load_id)),
q AS (SELECT *, CASE WHEN d = ',' THEN {whole(',')} ELSE {whole(tab)} END AS whole, CASE WHEN d = ',' THEN {cells(',')} ELSE {cells(tab).replace(f"'{tab}' || s", "chr(9) || s")} END AS quoted FROM l),
c AS (SELECT *, list_transform(quoted, lambda x: CASE WHEN x[1] = '"' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS cells FROM q),
r AS (
  SELECT table_load_id, line_number, table_code, cells{''.join(', ' + x for x in further)}, CASE WHEN raw_line IS NOT NULL AND NOT whole THEN 'quoting' WHEN raw_line IS NULL OR header IS NULL OR len(cells) <> len(header) THEN 'field_count'
    WHEN table_code = 'SOI' AND NOT ({" AND ".join(soi)}) OR table_code = 'NUM' AND NOT ({" AND ".join(num)}) OR table_code = 'BDC_REPORT' AND NOT ({" AND ".join(bdc)}) THEN 'invalid_value' END AS why
  FROM c)
"""


SQL = {
    "p6_found": p6_sql() + "SELECT table_load_id, line_number, why AS reason FROM r WHERE why IS NOT NULL",
    "p6_loaded": p6_sql() + "SELECT table_load_id, line_number, table_code, cells FROM r WHERE why IS NULL",
    "p1_found": """
WITH d AS (
  SELECT registrant_id, attribute_code, source_as_of, normalized_value,
    row_number() OVER (PARTITION BY registrant_id, attribute_code, source_as_of ORDER BY recorded_at DESC, rfact_id DESC) AS rn
  FROM rfact WHERE source_as_of IS NOT NULL),
m AS (
  SELECT *, CASE WHEN lag(source_as_of) OVER w IS NULL OR lag(normalized_value) OVER w IS DISTINCT FROM normalized_value THEN 1 ELSE 0 END AS new
  FROM d WHERE rn = 1 WINDOW w AS (PARTITION BY registrant_id, attribute_code ORDER BY source_as_of)),
s AS (SELECT *, lead(source_as_of) OVER (PARTITION BY registrant_id, attribute_code ORDER BY source_as_of) AS ended FROM m WHERE new = 1)
SELECT registrant_id, attribute_code, strftime(source_as_of, '%Y-%m-%d') AS valid_from, coalesce(strftime(ended, '%Y-%m-%d'), '9999-12-31') AS valid_to
FROM s WHERE normalized_value IS NOT NULL
""",
    "p3_found": """
WITH a AS (
  SELECT * FROM (
    SELECT regexp_replace(adsh, '[^0-9]', '', 'g') AS k, nullif(upper(trim(sub_form)), '') AS form, try_strptime(nullif(trim(sub_filed), ''), '%Y%m%d')::DATE AS filed,
      try_strptime(nullif(trim(period_end), ''), '%Y%m%d')::DATE AS period, try_cast(nullif(trim(cik), '') AS BIGINT) AS cik, recorded_at, sub_row_id AS id FROM sub_filing)
  WHERE length(k) = 18 QUALIFY row_number() OVER (PARTITION BY k ORDER BY recorded_at DESC, id DESC) = 1),
b AS (
  SELECT * FROM (
    SELECT regexp_replace(accession_number, '[^0-9]', '', 'g') AS k, nullif(upper(trim(sj_form)), '') AS form, try_strptime(nullif(trim(sj_filed), ''), '%Y-%m-%d')::DATE AS filed,
      try_strptime(nullif(trim(report_date), ''), '%Y-%m-%d')::DATE AS period, cik, recorded_at, sj_row_id AS id FROM sj_filing)
  WHERE length(k) = 18 QUALIFY row_number() OVER (PARTITION BY k ORDER BY recorded_at DESC, id DESC) = 1),
j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS no_a, b.k IS NULL AS no_b, a.form AS f1, b.form AS f2, a.filed AS d1, b.filed AS d2, a.period AS p1, b.period AS p2, a.cik AS c1, b.cik AS c2
      FROM a FULL JOIN b ON a.k = b.k),
u AS (
  SELECT k, 'row' AS field_name, CASE WHEN no_a THEN 'missing_in_sub' ELSE 'missing_in_sj' END AS finding FROM j WHERE no_a OR no_b
  UNION ALL SELECT k, 'form', 'differs' FROM j WHERE NOT no_a AND NOT no_b AND f1 IS DISTINCT FROM f2
  UNION ALL SELECT k, 'filed', 'differs' FROM j WHERE NOT no_a AND NOT no_b AND d1 IS DISTINCT FROM d2
  UNION ALL SELECT k, 'period', 'differs' FROM j WHERE NOT no_a AND NOT no_b AND p1 IS DISTINCT FROM p2
  UNION ALL SELECT k, 'cik', 'differs' FROM j WHERE NOT no_a AND NOT no_b AND c1 IS DISTINCT FROM c2)
SELECT substr(k, 1, 10) || '-' || substr(k, 11, 2) || '-' || substr(k, 13, 6) AS accession_number, field_name, finding FROM u
""",
    "p4_found": _P4_CASES + "SELECT table_name, row_id, period, reason FROM c WHERE reason IS NOT NULL",
    "p4_report": _P4_CASES
    + """SELECT table_name, period, count(*) AS n_refs, count(*) FILTER (WHERE reason = 'missing') AS n_missing,
  count(*) FILTER (WHERE reason = 'late') AS n_late, count(*) FILTER (WHERE reason = 'deleted') AS n_deleted FROM c GROUP BY ALL""",
}
