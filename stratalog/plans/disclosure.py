"""Queries over the disclosure tables themselves: loads, filings, schedule lines, facts and registrants."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import text as tx
from stratalog.functions import values as vx
from stratalog.model.vocabulary import SOI_HEADER
from stratalog.operators import cells, chains, periods, profile, states
from stratalog.operators.joins import guarded_join
from stratalog.plans.problems import accession18
from stratalog.plans.reference import quotient
from stratalog.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT filing_id, identifier_raw, strftime(reported_date, '%Y-%m-%d') AS reported_date, qtrs, count(*) AS n FROM soi_row_observation GROUP BY ALL HAVING count(*) > 1")
def soi_duplicate_key_groups(spark, sf):
    rows = table(spark, sf, "soi_row_observation").withColumn("reported_date", F.col("reported_date").cast("string"))
    return profile.repeated_keys(rows, ["filing_id", "identifier_raw", "reported_date", "qtrs"])


@query(
    """SELECT filing_id, strftime(reported_date, '%Y-%m-%d') AS reported_date, count(*) AS n_lines, count(identifier_raw) AS n_identified, count(*) FILTER (WHERE duration_kind = 'INSTANT') AS n_instant,
count(*) FILTER (WHERE duration_kind IS DISTINCT FROM 'INSTANT') AS n_other FROM soi_row_observation WHERE reported_date IS NOT NULL GROUP BY 1, 2"""
)
def soi_reported_dates(spark, sf):
    rows = table(spark, sf, "soi_row_observation").where("reported_date is not null")
    instant = F.coalesce(F.col("duration_kind") == "INSTANT", F.lit(False))
    return rows.groupBy("filing_id", F.col("reported_date").cast("string").alias("reported_date")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count("identifier_raw").alias("n_identified"), F.count_if(instant).alias("n_instant"), F.count_if(~instant).alias("n_other")
    )


@query(
    """SELECT l.table_load_id, l.row_count, CASE WHEN l.parse_status = 'SCHEMA_DRIFT' THEN 'UNAVAILABLE' ELSE 'LOADED' END AS status,
CASE WHEN l.parse_status <> 'SCHEMA_DRIFT' THEN coalesce(t.n, 0) END AS n_raw, CASE WHEN l.parse_status <> 'SCHEMA_DRIFT' THEN coalesce(o.n, 0) END AS n_split, CASE WHEN l.parse_status <> 'SCHEMA_DRIFT' THEN coalesce(s.n, 0) END AS n_observed,
CASE WHEN l.parse_status <> 'SCHEMA_DRIFT' THEN coalesce(t.n, 0) + coalesce(o.n, 0) + coalesce(s.n, 0) - l.row_count END AS surplus
FROM table_load l LEFT JOIN (SELECT table_load_id, count(*) AS n FROM tsv_line GROUP BY 1) t USING (table_load_id)
LEFT JOIN (SELECT table_load_id, count(*) AS n FROM ok_row GROUP BY 1) o USING (table_load_id) LEFT JOIN (SELECT table_load_id, count(*) AS n FROM soi_row_observation GROUP BY 1) s USING (table_load_id)"""
)
def load_reconciliation(spark, sf):
    """Rows each load declares against the rows of each kind that stand; an unavailable load has no counts, never zero."""
    loads = table(spark, sf, "table_load").select("table_load_id", "row_count", "parse_status")
    for name, column in (("tsv_line", "n_raw"), ("ok_row", "n_split"), ("soi_row_observation", "n_observed")):
        counts = table(spark, sf, name).groupBy("table_load_id").agg(F.count(F.lit(1)).alias(column))
        loads = loads.join(counts, "table_load_id", "left")
    there = F.col("parse_status") != "SCHEMA_DRIFT"
    n = {c: F.when(there, F.coalesce(F.col(c), F.lit(0).cast("long"))) for c in ("n_raw", "n_split", "n_observed")}
    return loads.select("table_load_id", "row_count", F.when(there, "LOADED").otherwise("UNAVAILABLE").alias("status"), *[v.alias(c) for c, v in n.items()], (sum(n.values()) - F.col("row_count")).alias("surplus"))


@query(
    """WITH h AS (SELECT registrant_id, attribute_code, artifact_id, normalized_value FROM rfact QUALIFY row_number() OVER (PARTITION BY registrant_id, attribute_code, artifact_id ORDER BY recorded_at DESC, rfact_id DESC) = 1),
k AS (SELECT registrant_id, attribute_code, CASE count(DISTINCT normalized_value) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'REPORTED' ELSE 'MULTIPLE_VALUES' END AS state FROM h GROUP BY ALL)
SELECT r.registrant_id, a.attribute_code, coalesce(k.state, 'UNKNOWN') AS state FROM (SELECT DISTINCT registrant_id FROM rfact) r CROSS JOIN (SELECT DISTINCT attribute_code FROM rfact) a
LEFT JOIN k ON k.registrant_id = r.registrant_id AND k.attribute_code = a.attribute_code"""
)
def registrant_attribute_status(spark, sf):
    facts = table(spark, sf, "rfact").select("registrant_id", "attribute_code", "artifact_id", "recorded_at", "rfact_id", "normalized_value")
    heads = chains.latest_by(facts, ["registrant_id", "attribute_code", "artifact_id"], ["recorded_at", "rfact_id"])
    known = heads.groupBy("registrant_id", "attribute_code").agg(states.three_state(F.col("normalized_value")).alias("state"))
    return states.status_grid(facts.select("registrant_id").distinct(), facts.select("attribute_code").distinct(), known, ["registrant_id", "attribute_code"], "state")


@query(
    """WITH u AS (SELECT regexp_replace(adsh, '[^0-9]', '', 'g') AS accession, upper(trim(sub_form)) AS form, trim(sub_filed) AS filed, 'sub' AS source FROM sub_filing
UNION ALL SELECT regexp_replace(accession_number, '[^0-9]', '', 'g'), upper(trim(sj_form)), replace(trim(sj_filed), '-', ''), 'sj' FROM sj_filing)
SELECT accession, coalesce(string_agg(DISTINCT form, '|' ORDER BY form), '') AS forms, coalesce(string_agg(DISTINCT filed, '|' ORDER BY filed), '') AS filed_dates, string_agg(DISTINCT source, '|' ORDER BY source) AS sources,
bool_or(coalesce(form LIKE '%/A', false)) AS amends FROM u WHERE length(accession) = 18 GROUP BY accession"""
)
def filing_history(spark, sf):
    """Every form, filed date and source of a filing side by side; no source wins."""
    part = lambda name, number, form, filed, source: table(spark, sf, name).select(
        accession18(F.col(number)).alias("accession"), F.upper(F.btrim(form)).alias("form"), F.replace(F.btrim(filed), F.lit("-"), F.lit("")).alias("filed"), F.lit(source).alias("source")
    )
    rows = part("sub_filing", "adsh", "sub_form", "sub_filed", "sub").unionByName(part("sj_filing", "accession_number", "sj_form", "sj_filed", "sj")).where("accession is not null")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return rows.groupBy("accession").agg(listed("form").alias("forms"), listed("filed").alias("filed_dates"), listed("source").alias("sources"), F.bool_or(F.coalesce(tx.is_amendment(F.col("form")), F.lit(False))).alias("amends"))


def _ok_rows(spark, sf):
    loads = table(spark, sf, "table_load").select("table_load_id", "table_code", "header")
    return guarded_join(table(spark, sf, "ok_row"), loads, ["table_load_id"])


@query(
    """SELECT tabular_row_id, l.header[i] AS label, r.cells[i] AS value FROM (SELECT *, unnest(generate_series(1, len(cells))) AS i FROM ok_row) r JOIN table_load l USING (table_load_id)
WHERE len(r.cells) = len(l.header) AND r.cells[i] <> ''"""
)
def cell_unpivot(spark, sf):
    return cells.unpivot_cells(_ok_rows(spark, sf), ["tabular_row_id"], "header", "cells")


@query(
    """SELECT label, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT l.header[i] AS label, r.cells[i] AS value FROM (SELECT *, unnest(generate_series(1, len(cells))) AS i FROM ok_row) r JOIN table_load l USING (table_load_id)
WHERE len(r.cells) = len(l.header) AND r.cells[i] <> '') GROUP BY label"""
)
def label_profile(spark, sf):
    return cells.unpivot_cells(_ok_rows(spark, sf), [], "header", "cells").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


@query(
    """SELECT tabular_row_id, coalesce(nullif(trim(regexp_extract(cells[7], '(?:^|;)\\s*InvestmentIdentifier\\([^)]*\\)=([^;]*)', 1)), ''), nullif(trim(regexp_extract(cells[7], '(?:^|;)\\s*InvestmentIdentifier=([^;]*)', 1)), '')) AS member,
CASE WHEN regexp_full_match(cells[6], '[A-Z]{3}') THEN cells[6] END AS currency, coalesce(cells[11] SIMILAR TO '[0-9]+' AND octet_length(encode(cells[10])) = try_cast(cells[11] AS BIGINT), false) AS length_ok
FROM ok_row JOIN table_load USING (table_load_id) WHERE table_code = 'NUM'"""
)
def num_fact_reading(spark, sf):
    """Identifier member, currency and footnote length check of every fact."""
    rows = _ok_rows(spark, sf).where("table_code = 'NUM'")
    from stratalog.functions.cells import cell

    at = lambda label: cell(F.col("cells"), F.col("header"), label)
    return rows.select(
        "tabular_row_id", tx.segment_member(at("segments")).alias("member"), tx.iso_currency(at("uom")).alias("currency"), F.coalesce(vx.length_matches(at("footnote"), at("footlen")), F.lit(False)).alias("length_ok")
    )


@query(
    "SELECT table_load_id, array_to_string(list_filter(header, lambda x: NOT list_contains(["
    + ", ".join("'" + x + "'" for x in SOI_HEADER)
    + "], x)), '|') AS undocumented, array_to_string(list_filter(["
    + ", ".join("'" + x + "'" for x in SOI_HEADER)
    + "], lambda x: NOT list_contains(header, x)), '|') AS missing FROM table_load WHERE table_code = 'SOI'"
)
def header_difference(spark, sf):
    extra, missing = profile.header_difference(F.col("header"), SOI_HEADER)
    return table(spark, sf, "table_load").where("table_code = 'SOI'").select("table_load_id", F.array_join(extra, "|").alias("undocumented"), F.array_join(missing, "|").alias("missing"))


@query(
    """WITH f AS (SELECT registrant_id, filing_id FROM filing), s AS (SELECT filing_id, count(*) AS n, count(identifier_raw) AS k FROM soi_row_observation GROUP BY 1),
r AS (SELECT registrant_id FROM rfact UNION SELECT registrant_id FROM filing)
SELECT r.registrant_id, CASE WHEN sum(s.k) > 0 THEN 'STORED_LINES' WHEN sum(s.n) > 0 THEN 'COVERED_NO_IDENTIFIED_LINE' ELSE 'UNKNOWN' END AS coverage, count(DISTINCT f.filing_id) AS n_filings FROM r LEFT JOIN f USING (registrant_id) LEFT JOIN s USING (filing_id) GROUP BY r.registrant_id"""
)
def registrant_coverage(spark, sf):
    """Every registrant: stored lines, covered without an identified line, or unknown; missing coverage is never zero."""
    filings = table(spark, sf, "filing").select("registrant_id", "filing_id")
    lines = table(spark, sf, "soi_row_observation").groupBy("filing_id").agg(F.count(F.lit(1)).alias("n"), F.count("identifier_raw").alias("k"))
    everyone = table(spark, sf, "rfact").select("registrant_id").union(filings.select("registrant_id")).distinct()
    per = everyone.join(filings, "registrant_id", "left").join(lines, "filing_id", "left").groupBy("registrant_id").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count_distinct("filing_id").alias("n_filings"))
    return per.select("registrant_id", states.first_match((F.col("k") > 0, "STORED_LINES"), (F.col("n") > 0, "COVERED_NO_IDENTIFIED_LINE"), otherwise="UNKNOWN").alias("coverage"), "n_filings")


@query(
    """WITH o AS (SELECT regexp_replace(cells[1], '[^0-9]', '', 'g') AS k, count(*) AS n FROM ok_row GROUP BY 1), s AS (SELECT filing_id, count(*) AS n, count(DISTINCT reported_date) AS d, string_agg(DISTINCT duration_kind, '|' ORDER BY duration_kind) AS kinds FROM soi_row_observation GROUP BY 1)
SELECT f.filing_id, f.withdrawn_at IS NULL AS stands, coalesce(s.n, 0) AS n_lines, s.d AS n_dates, s.kinds, coalesce(o.n, 0) AS n_cells_rows FROM filing f LEFT JOIN s USING (filing_id) LEFT JOIN o ON o.k = regexp_replace(f.accession_number, '[^0-9]', '', 'g')"""
)
def filing_inventory(spark, sf):
    lines = table(spark, sf, "soi_row_observation").groupBy("filing_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("reported_date").alias("n_dates"), F.array_join(F.array_sort(F.collect_set("duration_kind")), "|").alias("kinds"))
    lines = lines.withColumn("kinds", F.nullif("kinds", F.lit("")))
    split = table(spark, sf, "ok_row").groupBy(accession18(F.get("cells", F.lit(0))).alias("k")).agg(F.count(F.lit(1)).alias("m"))
    filings = table(spark, sf, "filing").withColumn("k", accession18(F.col("accession_number"))).join(lines, "filing_id", "left").join(split, "k", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return filings.select("filing_id", F.col("withdrawn_at").isNull().alias("stands"), zero("n").alias("n_lines"), "n_dates", "kinds", zero("m").alias("n_cells_rows"))


@query(
    """SELECT CASE WHEN m IS NULL THEN 'NONE' ELSE 'MONTH' END AS precision, y AS year, count(*) AS n FROM (SELECT CASE WHEN try_cast(regexp_extract(identifier_raw, 'due ([0-9]{1,2})/([0-9]{4})$', 1) AS INTEGER) BETWEEN 1 AND 12 THEN 1 END AS m,
CASE WHEN try_cast(regexp_extract(identifier_raw, 'due ([0-9]{1,2})/([0-9]{4})$', 1) AS INTEGER) BETWEEN 1 AND 12 THEN try_cast(regexp_extract(identifier_raw, 'due ([0-9]{1,2})/([0-9]{4})$', 2) AS INTEGER) END AS y FROM soi_row_observation WHERE identifier_raw IS NOT NULL) GROUP BY 1, 2"""
)
def maturity_years(spark, sf):
    """Disclosed maturities by precision and year; a month is never made a day."""
    date = vx.disclosed_date(F.regexp_extract("identifier_raw", r"due ([0-9]{1,2}/[0-9]{4})\z", 1))
    rows = table(spark, sf, "soi_row_observation").where("identifier_raw is not null").select(date.alias("date"))
    return rows.groupBy(F.coalesce("date.precision", F.lit("NONE")).alias("precision"), F.col("date.year").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH o AS (SELECT f.registrant_id, s.identifier_raw, s.reported_date AS day, count(*) AS n, min(s.soi_row_id) AS id FROM soi_row_observation s JOIN filing f USING (filing_id) WHERE s.identifier_raw IS NOT NULL AND s.reported_date IS NOT NULL GROUP BY ALL),
p AS (SELECT registrant_id, identifier_raw, day, n, id, lead(day) OVER w AS day2, lead(n) OVER w AS n2, lead(id) OVER w AS id2 FROM o WINDOW w AS (PARTITION BY registrant_id, identifier_raw ORDER BY day))
SELECT registrant_id, id AS earlier_id, id2 AS later_id, strftime(day, '%Y-%m-%d') AS earlier_date, strftime(day2, '%Y-%m-%d') AS later_date FROM p WHERE n = 1 AND n2 = 1"""
)
def position_periods(spark, sf):
    """Consecutive observations of a registrant's holding; dates with several rows block."""
    filings = table(spark, sf, "filing").select("filing_id", "registrant_id").distinct()
    rows = table(spark, sf, "soi_row_observation").where("identifier_raw is not null").select("filing_id", "identifier_raw", "reported_date", "soi_row_id")
    pairs = periods.consecutive_pairs(guarded_join(rows, filings, ["filing_id"]), ["registrant_id", "identifier_raw"], "reported_date", "soi_row_id")
    return pairs.select("registrant_id", "earlier_id", "later_id", F.col("earlier_date").cast("string"), F.col("later_date").cast("string"))


@query("SELECT soi_row_id, CASE WHEN count(*) = 1 THEN min(normalized_text) END AS name, count(*) AS n FROM p6_names WHERE extraction_state = 'EXTRACTED' GROUP BY soi_row_id")
def position_name(spark, sf):
    names = table(spark, sf, "p6_names").where("extraction_state = 'EXTRACTED'")
    return names.groupBy("soi_row_id").agg(states.exactly_one(F.col("normalized_text")).alias("name"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'sub' AS source, sub_row_id AS id, regexp_full_match(adsh, '[0-9]{10}-[0-9]{2}-[0-9]{6}') AS ok FROM sub_filing UNION ALL SELECT 'sj', sj_row_id, regexp_full_match(accession_number, '[0-9]{10}-[0-9]{2}-[0-9]{6}') FROM sj_filing")
def accession_regex(spark, sf):
    sub = table(spark, sf, "sub_filing").select(F.lit("sub").alias("source"), F.col("sub_row_id").alias("id"), tx.is_accession(F.col("adsh")).alias("ok"))
    return sub.unionByName(table(spark, sf, "sj_filing").select(F.lit("sj").alias("source"), F.col("sj_row_id").alias("id"), tx.is_accession(F.col("accession_number")).alias("ok")))


_FACTS = """WITH b AS (SELECT registrant_id, attribute_code, normalized_value AS v, rfact_id AS id, recorded_at FROM rfact WHERE normalized_value IS NOT NULL),
h AS (SELECT * FROM b WHERE recorded_at < '2023-01-01' QUALIFY row_number() OVER (PARTITION BY registrant_id, attribute_code ORDER BY recorded_at DESC, id DESC) = 1),
s AS (SELECT DISTINCT registrant_id, attribute_code, v FROM b WHERE recorded_at >= '2023-01-01' QUALIFY row_number() OVER (PARTITION BY registrant_id, attribute_code ORDER BY recorded_at DESC, id DESC) = 1)
"""


@query(
    _FACTS
    + """SELECT s.registrant_id, s.attribute_code, s.v AS value, h.id AS supersedes_id, CASE WHEN h.id IS NOT NULL THEN 'SUPERSEDES' ELSE 'ADDED' END AS action FROM s LEFT JOIN h USING (registrant_id, attribute_code) WHERE h.id IS NULL OR h.v <> s.v
UNION ALL SELECT h.registrant_id, h.attribute_code, h.v, h.id, 'ABSENT' FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.registrant_id = h.registrant_id AND s.attribute_code = h.attribute_code)"""
)
def fact_upsert_plan(spark, sf):
    """What the facts of 2023 and later would append to the heads that stood before."""
    facts = table(spark, sf, "rfact").where("normalized_value is not null").select("registrant_id", "attribute_code", F.col("normalized_value").alias("value"), F.col("rfact_id").alias("id"), "recorded_at")
    last = lambda part: chains.latest_by(part, ["registrant_id", "attribute_code"], ["recorded_at", "id"])
    return chains.upsert_stream(last(facts.where("recorded_at >= '2023-01-01'")), last(facts.where("recorded_at < '2023-01-01'")), ["registrant_id", "attribute_code"], ["value"])


@query(
    """SELECT k AS accession, min(sub_row_id) AS sub_row_id FROM (SELECT regexp_replace(adsh, '[^0-9]', '', 'g') AS k, sub_row_id FROM sub_filing) WHERE length(k) = 18 AND k NOT IN (SELECT regexp_replace(accession_number, '[^0-9]', '', 'g') FROM filing) GROUP BY k"""
)
def filings_to_insert(spark, sf):
    source = table(spark, sf, "sub_filing").select(accession18(F.col("adsh")).alias("accession"), "sub_row_id")
    existing = table(spark, sf, "filing").select(accession18(F.col("accession_number")).alias("accession"))
    return chains.insert_absent(source, existing, ["accession"], ["sub_row_id"])


@query(
    """WITH RECURSIVE c AS (SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS sup FROM events),
w AS (SELECT id AS root, id AS goal, 1 AS n FROM c WHERE sup IS NULL UNION ALL SELECT w.root, c.id, w.n + 1 FROM w JOIN c ON c.sup = w.goal)
SELECT root, goal AS head, n::BIGINT AS length FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.sup = w.goal)"""
)
def event_chain_heads(spark, sf):
    log = chains.previous_in_group(table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")
    return chains.chain_heads(log, "event_id")


# Schedule rows as positions -----------------------------------------------------------------------------------------

_NUMBER = "CASE WHEN regexp_full_match({0}, '-?[0-9]+(\\.[0-9]+)?') THEN {0}::DECIMAL(38,10)::DOUBLE END"
_POSITIONS = (
    "WITH p AS (SELECT tabular_row_id, CASE WHEN length(regexp_replace(cells[1], '[^0-9]', '', 'g')) = 18 THEN regexp_replace(cells[1], '[^0-9]', '', 'g') END AS accession, cells[4] AS reported_date, nullif(cells[12], '') AS identifier, "
    + ", ".join(f"CASE WHEN cells[{i}] = '' THEN 'UNKNOWN' ELSE 'REPORTED' END AS {n}_state, {_NUMBER.format(f'cells[{i}]')} AS {n}_value" for i, n in ((18, "principal"), (19, "cost"), (20, "fair_value")))
    + " FROM ok_row JOIN table_load USING (table_load_id) WHERE table_code = 'SOI' AND len(cells) = len(header))\n"
)
_FIELDS = {"Investment Owned, Balance, Principal Amount": "principal", "Investment Owned, Cost": "cost", "Investment Owned, Fair Value": "fair_value"}


def _positions(spark, sf):
    """One row per schedule line: identity and, per amount, the state and value of its one current field row."""
    rows = _ok_rows(spark, sf).where("table_code = 'SOI' and size(cells) = size(header)")
    from stratalog.functions.cells import cell

    at = lambda label: cell(F.col("cells"), F.col("header"), label)
    long = rows.select(
        "tabular_row_id", accession18(at("adsh")).alias("accession"), at("ddate").alias("reported_date"), F.nullif(at("Investment, Identifier Axis"), F.lit("")).alias("identifier"),
        F.explode(F.array(*[F.struct(F.lit(label).alias("field"), at(label).alias("raw")) for label in _FIELDS])).alias("f"),
    )
    long = long.select("tabular_row_id", "accession", "reported_date", "identifier", "f.field", F.when(F.col("f.raw") == "", "UNKNOWN").otherwise("REPORTED").alias("state"), F.col("f.raw").try_cast("decimal(38,10)").alias("value"))
    return states.pivot_heads(long, ["tabular_row_id", "accession", "reported_date", "identifier"], "field", _FIELDS, "state", "value")


@query(_POSITIONS + "SELECT tabular_row_id, accession, reported_date, identifier, principal_state, principal_value, cost_state, cost_value, fair_value_state, fair_value_value FROM p")
def position_read(spark, sf):
    p = _positions(spark, sf)
    return p.select(*[F.col(c).cast("double").alias(c) if c.endswith("_value") else F.col(c) for c in p.columns])


@query(
    _POSITIONS
    + """SELECT accession, reported_date, count(*) AS n_lines, count(identifier) AS n_identified, count(fair_value_value) AS n_fair_value,
CASE WHEN count(fair_value_value) < count(*) THEN 'INCOMPLETE' ELSE 'TOTAL' END AS fair_value_state, CASE WHEN count(fair_value_value) = count(*) THEN sum(fair_value_value::DECIMAL(38,10))::DOUBLE END AS fair_value_total
FROM p GROUP BY accession, reported_date"""
)
def portfolio_summary(spark, sf):
    state, total, _ = states.guarded_total(F.col("fair_value_value"), F.col("fair_value_state") == "REPORTED", F.lit("USD"))
    return _positions(spark, sf).groupBy("accession", "reported_date").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count("identifier").alias("n_identified"), F.count("fair_value_value").alias("n_fair_value"), state.alias("fair_value_state"), total.cast("double").alias("fair_value_total")
    )


@query(_POSITIONS + f"SELECT tabular_row_id, {quotient('CAST(fair_value_value AS DECIMAL(22, 8))', 'CAST(cost_value AS DECIMAL(22, 8))')}::VARCHAR AS value_to_cost, {quotient('CAST(fair_value_value AS DECIMAL(22, 8))', 'CAST(principal_value AS DECIMAL(22, 8))')}::VARCHAR AS value_to_principal FROM p")
def position_valuation(spark, sf):
    value, cost, principal = (F.col(f"{n}_value") for n in ("fair_value", "cost", "principal"))
    return _positions(spark, sf).select("tabular_row_id", periods.ratio(value, cost).cast("string").alias("value_to_cost"), periods.ratio(value, principal).cast("string").alias("value_to_principal"))


@query(
    _POSITIONS
    + """SELECT tabular_row_id, 'NO_VALUE' AS signal, identifier AS value FROM p WHERE fair_value_value IS NULL UNION ALL SELECT tabular_row_id, 'BELOW_COST', identifier FROM p WHERE fair_value_value < cost_value
UNION ALL SELECT tabular_row_id, 'NO_IDENTIFIER', NULL FROM p WHERE identifier IS NULL"""
)
def position_signals(spark, sf):
    from stratalog.operators.reading import signals

    name = F.col("identifier")
    cases = {"NO_VALUE": (F.col("fair_value_value").isNull(), name), "BELOW_COST": (F.col("fair_value_value") < F.col("cost_value"), name), "NO_IDENTIFIER": (name.isNull(), F.lit(None).cast("string"))}
    return signals(_positions(spark, sf), ["tabular_row_id"], cases)


@query(
    """SELECT registrant_id, string_agg(DISTINCT normalized_value, '|' ORDER BY normalized_value) AS aliases, count(DISTINCT artifact_id) AS n_artifacts, CASE WHEN count(DISTINCT normalized_value) = 1 THEN min(normalized_value) END AS label
FROM rfact WHERE attribute_code = 'STATE' GROUP BY registrant_id HAVING bool_or(contains(lower(normalized_value), 'n'))"""
)
def alias_search(spark, sf):
    from stratalog.operators.reading import alias_search as search

    rows = table(spark, sf, "rfact").where("attribute_code = 'STATE'")
    found = search(rows, ["registrant_id"], "normalized_value", "N", {"n_artifacts": F.col("artifact_id")})
    return found.select("registrant_id", F.array_join("aliases", "|").alias("aliases"), "n_artifacts", "label")


@query(
    """WITH r AS (SELECT registrant_id, attribute_code, source_as_of, normalized_value FROM rfact WHERE source_as_of IS NOT NULL QUALIFY row_number() OVER (PARTITION BY registrant_id, attribute_code, source_as_of ORDER BY recorded_at DESC, rfact_id DESC) = 1),
m AS (SELECT *, sum(n) OVER (PARTITION BY registrant_id, attribute_code ORDER BY source_as_of) AS band FROM (SELECT *, CASE WHEN lag(source_as_of) OVER w IS NULL OR lag(normalized_value) OVER w IS DISTINCT FROM normalized_value THEN 1 ELSE 0 END AS n FROM r WINDOW w AS (PARTITION BY registrant_id, attribute_code ORDER BY source_as_of)))
SELECT registrant_id, attribute_code, band::BIGINT AS band, min(normalized_value) AS normalized_value, count(*) AS n FROM m GROUP BY registrant_id, attribute_code, band"""
)
def value_bands(spark, sf):
    from stratalog.operators.reading import bands

    facts = table(spark, sf, "rfact").where("source_as_of is not null").select("registrant_id", "attribute_code", "source_as_of", "recorded_at", "rfact_id", "normalized_value")
    latest = chains.latest_by(facts, ["registrant_id", "attribute_code", "source_as_of"], ["recorded_at", "rfact_id"])
    return bands(latest, ["registrant_id", "attribute_code"], ["source_as_of"], "normalized_value")


@query("SELECT registrant_id, count(*) AS n_filings, string_agg(accession_number || ':' || (withdrawn_at IS NULL)::VARCHAR, ',' ORDER BY filing_id) AS filings FROM filing GROUP BY registrant_id")
def registrant_documents(spark, sf):
    """Read back from the nested documents, so that their JSON is what is compared."""
    from stratalog.operators.reading import documents

    rows = table(spark, sf, "filing").select("registrant_id", "filing_id", "accession_number", F.col("withdrawn_at").isNull().alias("stands"))
    made = documents(rows, ["registrant_id"], ["accession_number", "stands"], ["filing_id"])
    items = F.from_json("json", "items array<struct<accession_number:string,stands:boolean>>")["items"]
    return made.select("registrant_id", F.size(items).cast("long").alias("n_filings"), F.array_join(F.transform(items, lambda x: F.concat(x["accession_number"], F.lit(":"), x["stands"].cast("string"))), ",").alias("filings"))


@query("SELECT sub_row_id FROM sub_filing WHERE length(regexp_replace(adsh, '[^0-9]', '', 'g')) = 18 AND regexp_replace(adsh, '[^0-9]', '', 'g') NOT IN (SELECT regexp_replace(accession_number, '[^0-9]', '', 'g') FROM filing)")
def missing_parents(spark, sf):
    from stratalog.operators.integrity import missing_parents as check

    rows = table(spark, sf, "sub_filing").select("sub_row_id", accession18(F.col("adsh")).alias("accession"))
    return check(rows, "accession", table(spark, sf, "filing").select(accession18(F.col("accession_number")).alias("k")), "k").select("sub_row_id")
