"""Views over positions: wide reads, product maturity, consecutive periods, portfolios and borrowers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators import chains, periods, reading, states
from stratalog.operators.joins import guarded_join
from stratalog.plans.views import NAME_COLUMN, Evidence, checked_cik
from stratalog.session import cut

#: Fields of the wide read and their names there; the first three are amounts with a currency.
WIDE = {"PRINCIPAL_AMOUNT": "principal", "COST": "cost", "FAIR_VALUE": "fair_value", "INTEREST_RATE": "interest_rate", "SPREAD": "spread", "INTEREST_RATE_FLOOR": "interest_rate_floor", "ACQUISITION_DATE": "acquisition"}
AMOUNTS, RATES = ("principal", "cost", "fair_value"), ("interest_rate", "spread", "interest_rate_floor")
#: Fields of a disclosed line that are given as text, and their names there.
LINE_TEXTS = {"PRINCIPAL_AMOUNT": "principal", "INSTRUMENT_TYPE": "instrument_type", "INDUSTRY": "industry", "ISSUER_AFFILIATION": "affiliation", "GEOGRAPHY": "geography", "ACQUISITION_DATE": "acquisition_date", "RESTRICTED": "restricted", "REFERENCE_RATE": "reference_uri"}
#: Sources of a product maturity that is a day, and of one that is a month.
DAY_SOURCES, MONTH_SOURCES = ("REPORTED_STRUCTURED", "FILING_DISPLAYED"), ("REPORTED_MONTH", "FILING_MONTH")
#: Fixed value: where a filing document must lie to be shown.
DOCUMENT_PREFIX = "https://www.sec.gov/Archives/edgar/data/"
INLINE_PREFIX = "https://www.sec.gov/ix?doc=/Archives/edgar/data/"
UNKNOWN_UNITS = ("UNKNOWN", "AMBIGUOUS")


def _text_state(value: Column, own: Column | None = None) -> tuple[Column, Column]:
    """Aggregates (state, value) of a text: REPORTED with one different value, UNKNOWN without any row, else MULTIPLE_VALUES."""
    own = F.lit(True) if own is None else own
    n, low, high = F.count(F.when(own, F.lit(1))), F.min(F.when(own, value)), F.max(F.when(own, value))
    one = low.isNotNull() & (low == high)
    return F.when(one, "REPORTED").when(n == 0, "UNKNOWN").otherwise("MULTIPLE_VALUES"), F.when(one, low)


class Positions(Evidence):
    # Values and their authority
    def current_mapping_status(self) -> DataFrame:
        """mapping_id, mapping_status: the status at the end of each mapping's chain, whichever row of it is named. Mappings are a dimension."""
        rows = self.table("ref.source_column_mapping").select("id", "supersedes_id", "mapping_status")
        current = chains.current_heads(rows).select(F.col("id").alias("head"), "mapping_status")
        ends = chains.chain_ends(rows)
        return ends.join(current, "head").select(F.col("id").alias("mapping_id"), "mapping_status")

    def field_value_authority(self) -> DataFrame:
        """How far each current field value may be relied on: the first rule that holds, and UNKNOWN is never more than unknown."""
        values = self.heads("current_position_field_value").select(F.col("id").alias("field_value_id"), "position_observation_id", "field_code", "source_column_label", "value_state", "currency_state", "scale_state", "evidence_id", F.col("column_mapping_id").alias("mapping_id"))
        fields = self.table("ref.field_definition").select("field_code", "level2_required")
        levels = self.table("evidence.evidence").select(F.col("id").alias("evidence_id"), "evidence_level")
        checks = self.heads("validation.evidence_status_assertion").select(F.col("field_value_id").alias("__v"), "evidence_status")
        rows = values.join(fields, "field_code").join(levels, "evidence_id").join(self.current_mapping_status(), "mapping_id", "left")
        rows = rows.join(checks, F.col("field_value_id") == F.col("__v"), "left").withColumn("evidence_status", F.coalesce("evidence_status", F.lit("NOT_CHECKED")))
        original, verified = F.col("evidence_level") == "L2_ORIGINAL_FILING", F.col("evidence_status") == "FILING_VERIFIED"
        authority = states.first_match(
            (F.col("value_state") == "UNKNOWN", "UNKNOWN"),
            (F.col("value_state") == "NOT_APPLICABLE", "NOT_APPLICABLE"),
            (F.col("mapping_status") == "REJECTED", "UNRESOLVED"),
            (F.col("level2_required") & ~original & ~verified, "UNKNOWN"),
            (F.col("evidence_status") == "FILING_MISMATCH", "UNRESOLVED"),
            (F.col("mapping_status").isin("OPEN_QUESTION", "OBSERVED_UNCONFIRMED"), "PROVISIONAL"),
            (F.col("currency_state") == "FROM_NUM_UNIQUE_MATCH", "PROVISIONAL"),
            (F.col("scale_state") == "UNRESOLVED", "UNRESOLVED"),
            (verified | original, "AUTHORITATIVE"),
            otherwise="REPORTED_STRUCTURED",
        )
        return rows.select("field_value_id", "position_observation_id", "field_code", "source_column_label", "value_state", "evidence_level", "evidence_status", "mapping_status", authority.alias("authority"))

    def position_field_status(self) -> DataFrame:
        """Every field of every position with each of its current values and its authority; a field without a row is UNKNOWN, never zero."""
        known = self.field_value_authority().select("position_observation_id", "field_code", "field_value_id", "source_column_label", F.struct("value_state", "authority").alias("told"))
        positions = self.table("obs.position_observation").select(F.col("id").alias("position_observation_id"))
        grid = positions.crossJoin(F.broadcast(self.table("ref.field_definition").select("field_code"))).join(known, ["position_observation_id", "field_code"], "left")
        return grid.select("position_observation_id", "field_code", "field_value_id", "source_column_label", *[F.coalesce(F.col(f"told.{c}"), F.lit("UNKNOWN")).alias(c) for c in ("value_state", "authority")])

    # Product maturity
    def maturity_provenance(self) -> DataFrame:
        """One product maturity per position and where it comes from. A month is never made a day, and what disagrees is UNRESOLVED.

        The structured side is aggregated once per position and met with the inspection's head, of which a position has at most one.
        """
        month = (F.col("date_precision") == "MONTH") & F.col("normalized_date").isNull() & F.col("normalized_year").between(1000, 9999) & F.col("normalized_month").between(1, 12) & F.col("raw_value").isNotNull()
        values = self.heads("current_position_field_value").where("field_code = 'MATURITY_DATE' and value_state = 'REPORTED'")
        of_month = lambda c: F.min(F.when(F.col("date_precision") == "MONTH", F.col(c)))
        structured = values.groupBy("position_observation_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("normalized_date").alias("dates"), F.count_if(F.coalesce(month, F.lit(False))).alias("months"), F.min("normalized_date").alias("s_date"), F.min("raw_value").alias("s_raw"),
            of_month("normalized_year").alias("s_year"), of_month("normalized_month").alias("s_month"), states.exactly_one(F.col("id")).alias("structured_field_value_id"),
        )
        seen = self.heads("current_maturity_inspection").select(
            "position_observation_id", F.col("id").alias("inspection_id"), "inspection_state", F.col("raw_value").alias("d_raw"), F.col("normalized_date").alias("d_date"), F.col("displayed_year").alias("d_year"), F.col("displayed_month").alias("d_month"), "evidence_id", "no_bind_reason"
        )
        rows = self.table("obs.position_observation").select(F.col("id").alias("position_observation_id"), "filing_id", "reported_date").join(structured, "position_observation_id", "left").join(seen, "position_observation_id", "left")
        silent = F.col("inspection_id").isNull() | F.col("inspection_state").isin("NOT_BOUND", "UNAVAILABLE")
        shown = lambda s: F.col("inspection_state") == s
        n = F.coalesce("n", F.lit(0))
        same_month = shown("FILING_MONTH") & (F.col("d_year") == F.col("s_year")) & (F.col("d_month") == F.col("s_month"))
        source = states.first_match(
            ((n == 1) & (F.col("dates") == 1) & (silent | shown("FILING_DISPLAYED") & (F.col("d_date") == F.col("s_date"))), "REPORTED_STRUCTURED"),
            ((n == 1) & (F.col("dates") == 0) & (F.col("months") == 1) & (silent | same_month), "REPORTED_MONTH"),
            ((n == 0) & silent, "UNKNOWN"),
            ((n == 0) & shown("FILING_DISPLAYED"), "FILING_DISPLAYED"),
            ((n == 0) & shown("FILING_MONTH"), "FILING_MONTH"),
            otherwise="UNRESOLVED",
        )
        rows = rows.withColumn("maturity_source", source)
        of = lambda *cases: F.coalesce(*[F.when(F.col("maturity_source") == s, F.col(c)) for s, c in cases])
        verified = F.col("maturity_source").isin("REPORTED_STRUCTURED", "REPORTED_MONTH") & F.coalesce(shown("FILING_DISPLAYED") | shown("FILING_MONTH"), F.lit(False))
        return rows.select(
            "position_observation_id", "filing_id", "reported_date", "maturity_source", "inspection_state", "no_bind_reason", "evidence_id", "structured_field_value_id",
            of(("REPORTED_STRUCTURED", "s_date"), ("FILING_DISPLAYED", "d_date")).alias("maturity_date"),
            of(("REPORTED_STRUCTURED", "s_raw"), ("REPORTED_MONTH", "s_raw"), ("FILING_DISPLAYED", "d_raw"), ("FILING_MONTH", "d_raw")).alias("maturity_raw"),
            F.when(F.col("maturity_source").isin(*MONTH_SOURCES), "MONTH").alias("maturity_precision"),
            of(("REPORTED_MONTH", "s_year"), ("FILING_MONTH", "d_year")).alias("maturity_year"), of(("REPORTED_MONTH", "s_month"), ("FILING_MONTH", "d_month")).alias("maturity_month"), verified.alias("filing_verified"),
        )

    def maturity_read(self) -> DataFrame:
        """maturity_provenance with the one document in which the filing shows it, if it does."""
        documents = self.table("registry.filing_document").select(F.col("id").alias("filing_document_id"), F.col("filing_id").alias("__f"), "document_url")
        linked = self.table("registry.filing_document_artifact").join(documents, "filing_document_id").select("artifact_id", "__f", "document_url")
        evidence = self.table("evidence.evidence").select(F.col("id").alias("evidence_id"), "artifact_id")
        one = linked.groupBy("artifact_id", "__f").agg(states.single_value(F.col("document_url")).alias("maturity_document_url"))
        shown = F.col("maturity_source").isin("FILING_DISPLAYED", "FILING_MONTH") | F.col("filing_verified")
        rows = self.maturity_provenance().join(evidence, "evidence_id", "left").join(one.withColumnRenamed("__f", "filing_id"), ["artifact_id", "filing_id"], "left")
        return rows.withColumn("maturity_document_url", F.when(shown, F.col("maturity_document_url"))).drop("artifact_id", "evidence_id", "structured_field_value_id")

    def maturity_position(self) -> DataFrame:
        links = self.portfolio_filing_registrant().where("registrant_link_status = 'LINKED'").select("filing_id", "registrant_cik")
        return self.maturity_read().join(links, "filing_id")

    def maturity_position_for_cik(self, cik: str) -> DataFrame:
        return self.maturity_position().where(F.col("registrant_cik") == checked_cik(cik))

    @staticmethod
    def _maturity_counts(rows: DataFrame, by: list[str]) -> DataFrame:
        of = lambda s: F.count_if(F.col("maturity_source") == s)
        return rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("disclosed_line_count"), F.count("maturity_date").alias("maturity_reported_count"), of("REPORTED_STRUCTURED").alias("maturity_structured_count"), of("FILING_DISPLAYED").alias("maturity_filing_count"),
            of("UNKNOWN").alias("maturity_unknown_count"), of("UNRESOLVED").alias("maturity_unresolved_count"),
        )

    def maturity_reported_date(self) -> DataFrame:
        return self._maturity_counts(self.maturity_position(), ["registrant_cik", "reported_date"])

    def maturity_coverage(self, cik: str) -> DataFrame:
        return self._maturity_counts(self.maturity_position_for_cik(cik), ["reported_date"])

    def maturity_year(self) -> DataFrame:
        """Lines per registrant, date and year of a known maturity day; lines without a day belong to no year."""
        rows = self.maturity_position().where("maturity_date is not null")
        return rows.groupBy("registrant_cik", "reported_date", F.year("maturity_date").alias("maturity_year")).agg(F.count(F.lit(1)).alias("disclosed_line_count"))

    def maturity_years(self, cik: str) -> DataFrame:
        return self.maturity_year().where(F.col("registrant_cik") == checked_cik(cik)).drop("registrant_cik")

    def _maturity_of(self, rows: DataFrame, date: dt.date, kind: str, year: int | None) -> DataFrame:
        if kind not in ("all", "unknown", "unresolved", "year"):
            raise ValueError("kind is all, unknown, unresolved or year")
        if kind == "year" and not (year is not None and 0 <= year <= 9999):
            raise ValueError("a year from 0 to 9999 is needed")
        at = rows.where(F.col("reported_date") == F.lit(date))
        rule = {"all": F.lit(True), "unknown": F.col("maturity_source") == "UNKNOWN", "unresolved": F.col("maturity_source") == "UNRESOLVED", "year": F.year("maturity_date") == F.lit(year)}[kind]
        return at.where(rule)

    def maturity_line_count(self, cik: str, date: dt.date, kind: str, year: int | None = None) -> DataFrame:
        return self._maturity_of(self.maturity_position_for_cik(cik), date, kind, year).agg(F.count(F.lit(1)).alias("line_count"))

    def maturity_line(self) -> DataFrame:
        """Disclosed lines with product maturity, principal and the filing's attributes; the currency of the principal stays UNKNOWN here."""
        columns = ["disclosed_line_text", "principal_state", "principal_raw", "principal_currency_state", "accession_number", "evidence_level", "form_state", "form_raw", "filed_date_state", "filed_date_raw", "inline_url_state", "inline_url", "document_name", "document_url", "release_state", "release_label"]
        own = ["position_observation_id", "registrant_cik", "reported_date", "maturity_source", "maturity_raw", "maturity_date", "maturity_filing_verified", "maturity_document_url"]
        return self.portfolio_line().select(*own, *columns, F.year("maturity_date").alias("maturity_year"))

    def maturity_line_page(self, cik: str, date: dt.date, kind: str, year: int | None = None, number: int = 1, size: int = 50) -> DataFrame:
        """One page by id; the lines are made for the ids of the page only."""
        ids = reading.page(self._maturity_of(self.maturity_position_for_cik(cik), date, kind, year).select("position_observation_id"), ["position_observation_id"], number, size)
        return self.maturity_line().join(F.broadcast(ids), "position_observation_id", "left_semi")

    # Disclosed lines
    def _filing_texts(self) -> DataFrame:
        """Per filing form, filed date and inline address with their states, in one aggregation."""
        rows = self.current_filing_attribute().where("value_state = 'REPORTED'")
        columns = []
        for code, name, value in (("FORM", "form", "normalized_value"), ("FILED_DATE", "filed_date", "normalized_value"), ("INLINE_URL", "inline_url", "raw_value")):
            state, one = _text_state(F.col(value), F.col("attribute_code") == code)
            columns += [state.alias(f"{name}_state"), one.alias(f"{name}_raw")]
        told = rows.groupBy("filing_id").agg(*columns)
        good = F.coalesce(F.col("inline_url_raw").startswith(DOCUMENT_PREFIX) | F.col("inline_url_raw").startswith(INLINE_PREFIX), F.lit(False))
        told = told.withColumn("inline_url_state", F.when((F.col("inline_url_state") == "REPORTED") & ~good, "MULTIPLE_VALUES").otherwise(F.col("inline_url_state")))
        return told.select("filing_id", "form_state", "form_raw", "filed_date_state", "filed_date_raw", "inline_url_state", F.when(good, F.col("inline_url_raw")).alias("inline_url"))

    def _filing_document(self) -> DataFrame:
        """Per filing its first document that may be shown, the primary one before all others."""
        rows = self.table("registry.filing_document").where(F.col("document_url").startswith(DOCUMENT_PREFIX)).withColumn("later", F.col("named_by") != "SUBMISSIONS_PRIMARY_DOCUMENT")
        return rows.groupBy("filing_id").agg(F.min_by(F.struct("document_name", "document_url"), F.struct("later", "id")).alias("d")).select("filing_id", "d.document_name", "d.document_url")

    def _row_releases(self) -> DataFrame:
        """Per load the release it came with."""
        links = self.table("registry.dataset_release_artifact").join(self.table("registry.dataset_release").select(F.col("id").alias("dataset_release_id"), "release_label"), "dataset_release_id")
        state, label = _text_state(F.col("release_label"))
        loads = self.table("raw.table_load").select(F.col("id").alias("table_load_id"), "artifact_id").join(links, "artifact_id")
        return loads.groupBy("table_load_id").agg(state.alias("release_state"), label.alias("release_label"))

    def portfolio_line(self) -> DataFrame:
        """One disclosed line of a linked registrant: texts with their states, product maturity, and the filing's form, date, document and release."""
        columns = []
        for code, name in LINE_TEXTS.items():
            state, one = _text_state(F.col("raw_value"), F.col("field_code") == code)
            columns += [state.alias(f"{name}_state"), one.alias(f"{name}_raw")]
        texts = self.heads("current_position_field_value").where(F.col("field_code").isin(*LINE_TEXTS)).groupBy("position_observation_id").agg(*columns)
        origins = self.table("obs.soi_row_observation").select(F.col("id").alias("origin_soi_row_observation_id"), "qtrs", "tabular_row_id")
        loads = self.table("raw.tabular_row").select(F.col("id").alias("tabular_row_id"), "table_load_id")
        roles = self.heads("current_soi_row_classification").select(F.col("soi_row_observation_id").alias("origin_soi_row_observation_id"), "period_role")
        levels = self.table("evidence.evidence").select(F.col("id").alias("evidence_id"), "evidence_level")
        filings = self.table("registry.filing").select(F.col("id").alias("filing_id"), "accession_number")
        links = self.portfolio_filing_registrant().where("registrant_link_status = 'LINKED'").select("filing_id", "registrant_cik")
        filings = filings.join(links, "filing_id").join(self._filing_texts(), "filing_id", "left").join(self._filing_document(), "filing_id", "left")
        maturity = self.maturity_read().select("position_observation_id", "maturity_source", "maturity_raw", "maturity_date", F.col("inspection_state").alias("maturity_inspection_state"), F.col("no_bind_reason").alias("maturity_no_bind_reason"), F.col("filing_verified").alias("maturity_filing_verified"), "maturity_document_url")
        rows = self.table("obs.position_observation").select(F.col("id").alias("position_observation_id"), "filing_id", "reported_date", "duration_kind", "origin_soi_row_observation_id", F.col("holding_descriptor_raw").alias("disclosed_line_text"), "evidence_id")
        rows = rows.join(origins, "origin_soi_row_observation_id").join(levels, "evidence_id").join(filings, "filing_id").join(maturity, "position_observation_id").join(roles, "origin_soi_row_observation_id", "left")
        rows = rows.join(texts, "position_observation_id", "left").join(loads, "tabular_row_id", "left").join(self._row_releases(), "table_load_id", "left")
        unknown = {f"{n}_state" for n in (*LINE_TEXTS.values(), "form", "filed_date", "inline_url", "release")} | {"period_role"}
        rows = rows.withColumn("principal_currency_state", F.lit("UNKNOWN")).drop("origin_soi_row_observation_id", "evidence_id", "tabular_row_id", "table_load_id", "filing_id")
        return rows.select(*[F.coalesce(c, F.lit("UNKNOWN")).alias(c) if c in unknown else F.col(c) for c in rows.columns])

    def portfolio_registrant_name(self) -> DataFrame:
        """Each current source of a registrant's name, unmerged."""
        names = self.current_registrant_attribute().where("attribute_code = 'NAME'").select("registrant_id", "source_type_code", "raw_value", "documentation_status")
        return self.portfolio_registrant().select("registrant_id", "registrant_cik").join(names, "registrant_id").drop("registrant_id")

    def portfolio_detail_filing(self, cik: str) -> DataFrame:
        """Filings whose every current link names the one registrant of this CIK."""
        linked = self.portfolio_filing_registrant().where("registrant_link_status = 'LINKED'")
        return linked.where(F.col("registrant_cik") == checked_cik(cik)).select("filing_id")

    def portfolio_detail_registrant(self, cik: str) -> DataFrame:
        return self.portfolio_registrant().where(F.col("registrant_cik") == checked_cik(cik)).drop("registrant_id")

    def portfolio_detail_names(self, cik: str) -> DataFrame:
        return self.portfolio_registrant_name().where(F.col("registrant_cik") == checked_cik(cik)).drop("registrant_cik")

    def portfolio_detail_dates(self, cik: str) -> DataFrame:
        return self.portfolio_reported_date().where(F.col("registrant_cik") == checked_cik(cik)).drop("registrant_cik")

    def market_release_date(self, label: str) -> DataFrame:
        """Lines of one release by registrant and reported date."""
        loads = self.table("registry.dataset_release").where(F.col("release_label") == label).select(F.col("id").alias("dataset_release_id"))
        loads = loads.join(self.table("registry.dataset_release_artifact"), "dataset_release_id").join(self.table("raw.table_load").select(F.col("id").alias("table_load_id"), "artifact_id"), "artifact_id").select("table_load_id").distinct()
        origins = self.table("obs.soi_row_observation").select(F.col("id").alias("origin_soi_row_observation_id"), "tabular_row_id").join(self.table("raw.tabular_row").select(F.col("id").alias("tabular_row_id"), "table_load_id"), "tabular_row_id")
        rows = self._lines().join(origins, "origin_soi_row_observation_id").join(loads, "table_load_id", "left_semi")
        return rows.groupBy("registrant_cik", "reported_date").agg(F.count(F.lit(1)).alias("disclosed_line_count"))

    # Wide reads
    def _names(self) -> DataFrame:
        """Per position the one extracted name of its identifier column, and what it was matched to."""
        names = self.heads("current_borrower_name_observation").where((F.col("source_column_label") == NAME_COLUMN) & (F.col("extraction_state") == "EXTRACTED"))
        one = names.groupBy("position_observation_id").agg(F.count(F.lit(1)).alias("name_count"), states.exactly_one(F.col("id")).alias("borrower_name_observation_id"), states.exactly_one(F.col("normalized_text")).alias("borrower_name_raw"))
        matched = self.heads("current_entity_resolution").groupBy("borrower_name_observation_id").agg(states.exactly_one(F.col("legal_entity_id")).alias("legal_entity_id"), states.exactly_one(F.col("state")).alias("entity_resolution_state"))
        return one.join(matched, "borrower_name_observation_id", "left")

    def position_read(self) -> DataFrame:
        """One wide row per position: filing and registrant, name and decisions, product maturity, and of each field state, raw text, number, date, currency and scale of its only head."""
        heads, columns = self.heads("current_position_field_value"), []
        parts = (("raw_value", "raw"), ("normalized_numeric", "numeric"), ("normalized_date", "date"), ("date_precision", "precision"), ("normalized_year", "year"), ("normalized_month", "month"))
        units = (("currency_state", "currency_state"), ("currency_code", "currency_code"), ("scale_state", "scale_state"))
        for code, name in WIDE.items():
            own = F.col("field_code") == code
            state, only = states.four_state(F.when(own, F.col("value_state")), F.when(own, F.col("raw_value"))), F.count_if(own) == 1
            columns.append(state.alias(f"{name}_state"))
            kept = [p for p in parts if (p[1] in ("date", "precision", "year", "month")) == (name == "acquisition") or p[1] == "raw"]
            columns += [F.when(state == "REPORTED", F.min(F.when(own, F.col(c)))).alias(f"{name}_{short}") for c, short in kept]
            columns += [F.when(only, F.min(F.when(own, F.col(c)))).alias(f"{name}_{short}") for c, short in units if name in AMOUNTS or short == "scale_state"]
        wide = heads.where(F.col("field_code").isin(*WIDE)).groupBy("position_observation_id").agg(*columns)
        levels = self.table("evidence.evidence").select(F.col("id").alias("evidence_id"), F.col("evidence_level").alias("observation_evidence_level"))
        filings = self.table("registry.filing").select(F.col("id").alias("filing_id"), "accession_number")
        out = self.table("obs.position_observation").select(F.col("id").alias("position_observation_id"), "filing_id", "reported_date", "duration_kind", "holding_descriptor_raw", "evidence_id")
        out = out.join(levels, "evidence_id", "left").drop("evidence_id").join(filings, "filing_id", "left").join(wide, "position_observation_id", "left")
        out = out.join(self.portfolio_filing_registrant().drop("registrant_id"), "filing_id", "left").join(self._names(), "position_observation_id", "left")
        groups = self.heads("current_group_membership").groupBy("legal_entity_id").agg(states.exactly_one(F.col("economic_group_id")).alias("economic_group_id"), states.exactly_one(F.col("state")).alias("group_state"))
        out = out.join(groups, "legal_entity_id", "left")
        for decision, target, name in (("current_instrument_resolution", "instrument_id", "instrument_resolution_state"), ("current_position_continuity", "position_id", "continuity_state")):
            out = out.join(self._only_decision(decision, target).withColumnRenamed(f"{target}_state", name), "position_observation_id", "left")
        maturity = self.maturity_read().drop("filing_id", "reported_date")
        out = out.join(maturity, "position_observation_id", "left")
        return out.select(*[F.coalesce(c, F.lit("UNKNOWN")).alias(c) if c in {f"{n}_state" for n in WIDE.values()} else F.col(c) for c in out.columns])

    def position_period_comparison(self) -> DataFrame:
        """Consecutive observations of continuing positions and, per value, whether they compare, by how much they differ and whether they changed.

        Amounts compare only in one known currency, days with days and months with months. A date with several rows of a position pairs with nothing and
        keeps its neighbours apart.
        """
        # Read three times below, so written once.
        read = cut(self.position_read().where("continuity_state = 'MATCHED' and position_id is not null and reported_date is not null"), "confirmed")
        pairs = periods.consecutive_pairs(read, ["position_id"], "reported_date", "position_observation_id")
        cells = [f"{n}_{x}" for n in AMOUNTS for x in ("state", "raw", "numeric", "currency_state", "currency_code")] + [f"{n}_{x}" for n in RATES for x in ("state", "raw", "numeric")]
        cells += [f"maturity_{x}" for x in ("source", "raw", "date", "precision", "year", "month")] + [f"acquisition_{x}" for x in ("state", "raw", "date", "precision", "year", "month")]
        cells += ["accession_number", "registrant_cik", "legal_entity_id", "instrument_id", "instrument_resolution_state"]
        both = periods.with_both_sides(pairs, read, "position_observation_id", cells)
        out: list = ["position_id", "earlier_id", "later_id", "earlier_date", "later_date", *[F.col(f"{s}_{c}") for s in "el" for c in ("accession_number", "registrant_cik", "legal_entity_id", "instrument_id", "instrument_resolution_state")]]
        for name in (*AMOUNTS, *RATES):
            unit = lambda side: F.when(~F.col(f"{side}_{name}_currency_state").isin(*UNKNOWN_UNITS), F.col(f"{side}_{name}_currency_code")) if name in AMOUNTS else None  # noqa: B023, E731
            a, b = F.col(f"e_{name}_numeric"), F.col(f"l_{name}_numeric")
            state = periods.comparable(a, b, unit("e"), unit("l"))
            ok = state == "COMPARABLE"
            out += [state.alias(f"{name}_comparison"), F.when(ok, b.cast("decimal(37,10)") - a.cast("decimal(37,10)")).alias(f"{name}_delta"), F.when(ok, a != b).alias(f"{name}_changed"), *[F.col(f"{s}_{name}_{x}") for s in "el" for x in ("raw", "numeric")]]
            out += [F.col(f"{s}_{name}_currency_state") for s in "el" if name in AMOUNTS]
        for name in ("maturity", "acquisition"):
            at = lambda side, x: F.col(f"{side}_{name}_{x}")  # noqa: B023, E731
            known = lambda side, sources: at(side, "source").isin(*sources) if name == "maturity" else at(side, "state") == "REPORTED"  # noqa: B023, E731
            day = lambda side: known(side, DAY_SOURCES) & at(side, "date").isNotNull() & at(side, "precision").isNull()  # noqa: B023, E731
            month = lambda side: known(side, MONTH_SOURCES) & (at(side, "precision") == "MONTH") & at(side, "year").isNotNull() & at(side, "month").isNotNull()  # noqa: B023, E731
            days, months = F.coalesce(day("e") & day("l"), F.lit(False)), F.coalesce(month("e") & month("l"), F.lit(False))
            changed = F.when(days, at("e", "date") != at("l", "date")).when(months, (at("e", "year") != at("l", "year")) | (at("e", "month") != at("l", "month")))
            out += [F.when(days | months, "COMPARABLE").otherwise("INSUFFICIENT_DATA").alias(f"{name}_comparison"), changed.alias(f"{name}_changed")]
            out += [F.col(f"{s}_{name}_{x}") for s in "el" for x in ("raw", "date", "precision", "year", "month")]
        return both.select(*out)

    # Borrowers
    def _of_entity(self, legal_entity_id: str) -> DataFrame:
        ids = self.matched_entity_position().where(F.col("legal_entity_id") == legal_entity_id).select("position_observation_id").distinct()
        return self.position_read().where((F.col("legal_entity_id") == legal_entity_id) & (F.col("entity_resolution_state") == "MATCHED")).join(ids, "position_observation_id", "left_semi")

    def borrower_position_observations(self, legal_entity_id: str) -> DataFrame:
        return self._of_entity(legal_entity_id)

    def borrower_comparisons(self, legal_entity_id: str) -> DataFrame:
        """Comparisons of which both sides are this entity's."""
        return self.position_period_comparison().where((F.col("e_legal_entity_id") == legal_entity_id) & (F.col("l_legal_entity_id") == legal_entity_id))

    def borrower_valuation_period_comparison(self, legal_entity_id: str) -> DataFrame:
        """Comparisons of the positions that this entity has a line of, whoever the other side is."""
        seeds = self.matched_entity_position().where(F.col("legal_entity_id") == legal_entity_id).select("position_observation_id")
        positions = self._only_decision("current_position_continuity", "position_id").join(seeds, "position_observation_id", "left_semi").where("position_id is not null and position_id_state = 'MATCHED'").select("position_id").distinct()
        return guarded_join(self.position_period_comparison(), positions, ["position_id"], "left_semi")

    def borrower_position_valuation(self, legal_entity_id: str) -> DataFrame:
        """Per comparison the change of the fair value in percent, and the later fair value over principal and over cost where all is known in one currency; DECIMAL to six digits."""
        later = self.position_read().select(F.col("position_observation_id").alias("later_id"), *[F.col(f"{n}_{x}") for n in AMOUNTS for x in ("numeric", "currency_state", "currency_code")])
        rows = self.borrower_comparisons(legal_entity_id).join(later, "later_id")
        unit = lambda n: F.when(~F.col(f"{n}_currency_state").isin(*UNKNOWN_UNITS), F.col(f"{n}_currency_code"))
        over = lambda n: F.when(unit("fair_value") == unit(n), periods.ratio(F.col("fair_value_numeric"), F.col(f"{n}_numeric")))
        change = F.when(F.col("fair_value_comparison") == "COMPARABLE", periods.percent_change(F.col("e_fair_value_numeric"), F.col("l_fair_value_numeric")))
        return rows.select("position_id", "earlier_id", "later_id", "earlier_date", "later_date", "fair_value_comparison", "fair_value_delta", change.alias("fair_value_change_percent"), over("principal").alias("fair_value_to_principal"), over("cost").alias("fair_value_to_cost"))

    def borrower_refinancing_outcomes(self, legal_entity_id: str) -> DataFrame:
        """Comparisons in which a comparable maturity changed on one matched instrument. When it happened, and what it meant, is not disclosed."""
        rows = self.borrower_comparisons(legal_entity_id).where("maturity_comparison = 'COMPARABLE' and maturity_changed and e_instrument_resolution_state = 'MATCHED' and l_instrument_resolution_state = 'MATCHED' and e_instrument_id = l_instrument_id")
        return rows.select("position_id", "earlier_id", "later_id", "earlier_date", "later_date", "e_maturity_raw", "l_maturity_raw", F.lit(None).cast("date").alias("event_date"), F.lit("UNKNOWN").alias("refinancing_outcome_state"))

    def borrower_maturity_observations(self, legal_entity_id: str) -> DataFrame:
        """Each line of an entity with its maturity as DAY, MONTH or NONE, the year it falls in, and why it may not count."""
        rows = self._of_entity(legal_entity_id)
        resolved = F.coalesce((F.col("instrument_resolution_state") == "MATCHED") & (F.col("continuity_state") == "MATCHED"), F.lit(False))
        day = F.col("maturity_source").isin(*DAY_SOURCES) & F.col("maturity_date").isNotNull() & F.col("maturity_precision").isNull()
        month = F.col("maturity_source").isin(*MONTH_SOURCES) & (F.col("maturity_precision") == "MONTH") & F.col("maturity_year").isNotNull() & F.col("maturity_month").isNotNull()
        kind = states.first_match((resolved & day, "DAY"), (resolved & month, "MONTH"), otherwise="NONE")
        year = F.when(kind == "DAY", F.year("maturity_date")).when(kind == "MONTH", F.col("maturity_year"))
        state = states.first_match(
            (~F.col("instrument_resolution_state").eqNullSafe(F.lit("MATCHED")), "UNRESOLVED_INSTRUMENT"), (~F.col("continuity_state").eqNullSafe(F.lit("MATCHED")), "UNRESOLVED_POSITION"), (day | month, "OBSERVED"), otherwise="UNKNOWN"
        )
        kept = ["position_observation_id", "reported_date", "instrument_resolution_state", "continuity_state", "maturity_source", "maturity_raw", "maturity_date", "maturity_year", "maturity_month"]
        kept += [f"{n}_{x}" for n in ("principal", "fair_value") for x in ("state", "numeric", "currency_state", "currency_code")]
        return rows.select(*kept, kind.alias("maturity_precision_class"), year.alias("maturity_bucket_year"), state.alias("maturity_observation_state"))

    def borrower_maturity_page(self, legal_entity_id: str, number: int = 1, size: int = 50) -> DataFrame:
        """Days first, then months, then the rest; each by maturity, the latest report first."""
        rank = F.when(F.col("maturity_precision_class") == "DAY", 0).when(F.col("maturity_precision_class") == "MONTH", 1).otherwise(2)
        order = [rank, F.asc_nulls_last("maturity_date"), F.asc_nulls_last("maturity_year"), F.asc_nulls_last("maturity_month"), F.desc_nulls_last("reported_date"), "position_observation_id"]
        return reading.page(self.borrower_maturity_observations(legal_entity_id), order, number, size)

    def borrower_maturity_summary(self, legal_entity_id: str) -> DataFrame:
        rows = self.borrower_maturity_observations(legal_entity_id)
        resolved = (F.col("instrument_resolution_state") == "MATCHED") & (F.col("continuity_state") == "MATCHED")
        own = lambda kind, key: F.min(F.when(F.col("maturity_precision_class") == kind, F.struct(*key, "maturity_raw")))["maturity_raw"]
        return rows.agg(
            F.count_if(resolved).alias("resolved_observation_count"), F.count_if(F.col("maturity_observation_state") == "OBSERVED").alias("known_maturity_count"), F.count_if(resolved & (F.col("maturity_observation_state") == "UNKNOWN")).alias("unknown_maturity_count"),
            F.count_if(F.col("maturity_observation_state").isin("UNRESOLVED_INSTRUMENT", "UNRESOLVED_POSITION")).alias("unresolved_count"),
            own("DAY", ["maturity_date"]).alias("earliest_calendar_maturity"), own("MONTH", ["maturity_year", "maturity_month"]).alias("earliest_month_maturity"),
        )

    @staticmethod
    def _total(name: str) -> list[Column]:
        known = F.when(~F.col(f"{name}_currency_state").isin(*UNKNOWN_UNITS), F.col(f"{name}_currency_code"))
        state, total, unit = states.guarded_total(F.col(f"{name}_numeric"), (F.col(f"{name}_state") == "REPORTED") & known.isNotNull(), known)
        return [F.when(state == "TOTAL", "COMPARABLE").otherwise("INSUFFICIENT_DATA").alias(f"{name}_aggregation_state"), total.alias(f"{name}_total"), unit.alias(f"{name}_currency_code")]

    def borrower_maturity_years(self, legal_entity_id: str) -> DataFrame:
        """Observed lines by year and precision; amounts are summed only if every line has one in one known currency."""
        rows = self.borrower_maturity_observations(legal_entity_id).where("maturity_observation_state = 'OBSERVED'")
        return rows.groupBy("maturity_bucket_year", "maturity_precision_class").agg(F.count(F.lit(1)).alias("observation_count"), *self._total("principal"), *self._total("fair_value"))

    # Portfolios at a date and between two
    def portfolio_scope(self, cik: str, date: dt.date) -> DataFrame:
        return self.position_read().where((F.col("registrant_cik") == checked_cik(cik)) & (F.col("reported_date") == F.lit(date)))

    def portfolio_holdings(self, cik: str, date: dt.date, number: int = 1, size: int = 50) -> DataFrame:
        return reading.page(self.portfolio_scope(cik, date), [F.asc_nulls_last("borrower_name_raw"), "position_observation_id"], number, size)

    def portfolio_summary(self, cik: str, date: dt.date) -> DataFrame:
        """Counts, and totals of principal and fair value that are given only when every line has one in one known currency."""
        rows = self.portfolio_scope(cik, date)
        resolved = F.coalesce((F.col("instrument_resolution_state") == "MATCHED") & (F.col("continuity_state") == "MATCHED"), F.lit(False))
        unsure = lambda n: (F.col(f"{n}_state") == "REPORTED") & F.col(f"{n}_currency_state").isin(*UNKNOWN_UNITS)
        return rows.agg(
            F.count(F.lit(1)).alias("observation_count"), F.count_if(resolved).alias("resolved_position_count"), F.count_if(~resolved).alias("unresolved_count"), F.count_if(F.col("principal_state") == "REPORTED").alias("known_principal_count"),
            F.count_if(F.col("fair_value_state") == "REPORTED").alias("known_fair_value_count"), F.count_if(F.col("maturity_source").isin(*DAY_SOURCES, *MONTH_SOURCES)).alias("known_maturity_count"),
            F.count_if(unsure("principal") | unsure("fair_value")).alias("unknown_currency_count"), *self._total("principal"), *self._total("fair_value"),
        )

    def portfolio_period_identity(self, cik: str, date: dt.date) -> DataFrame:
        return self.portfolio_scope(cik, date).select("position_observation_id", "position_id", "instrument_resolution_state", "continuity_state")

    def _period_sides(self, cik: str, earlier: dt.date, later: dt.date) -> DataFrame:
        """Per resolved position its rows at both dates (e_n, e_id, l_n, l_id), in one aggregation."""
        if earlier >= later:
            raise ValueError("the earlier date must lie before the later one")
        rows = self.position_read().where((F.col("registrant_cik") == checked_cik(cik)) & F.col("reported_date").isin(earlier, later) & F.expr("position_id is not null and continuity_state = 'MATCHED' and instrument_resolution_state = 'MATCHED'"))
        at = lambda day, x: F.when(F.col("reported_date") == F.lit(day), x)
        return rows.groupBy("position_id").agg(*[f.alias(f"{s}_{n}") for s, day in (("e", earlier), ("l", later)) for n, f in (("n", F.count(at(day, F.lit(1)))), ("id", F.min(at(day, F.col("position_observation_id")))))])

    def portfolio_period_changes(self, cik: str, earlier: dt.date, later: dt.date) -> DataFrame:
        """Positions that are new, no longer there, or changed between two dates of a registrant.

        A position has changed if the two dates are neighbours in its series and position_period_comparison finds an amount or the maturity changed, which needs
        both values known and comparable. Positions with several rows at a date are left out; absence is no exit and presence no entry.
        """
        sides = self._period_sides(cik, earlier, later)
        changed = F.coalesce(F.greatest(*[F.col(f"{n}_changed").cast("int") for n in (*AMOUNTS, "maturity")]) == 1, F.lit(False))
        kept = [f"{n}_{x}" for n in AMOUNTS for x in ("comparison", "delta")] + ["maturity_comparison", "maturity_changed"]
        compared = self.position_period_comparison().where((F.col("earlier_date") == F.lit(earlier)) & (F.col("later_date") == F.lit(later)) & changed)
        compared = compared.select(F.col("earlier_id").alias("e_id"), F.col("later_id").alias("l_id"), F.lit(True).alias("__changed"), *kept)
        rows = sides.join(compared, ["e_id", "l_id"], "left")
        change = F.when((F.col("e_n") == 1) & (F.col("l_n") == 1) & F.col("__changed"), "EXISTING_POSITION_CHANGED").when((F.col("e_n") == 0) & (F.col("l_n") == 1), "NEW_POSITION_OBSERVED").when((F.col("e_n") == 1) & (F.col("l_n") == 0), "POSITION_NO_LONGER_OBSERVED")
        return rows.select(change.alias("change_type"), "position_id", F.col("e_id").alias("earlier_id"), F.col("l_id").alias("later_id"), *kept).where("change_type is not null")

    def portfolio_period_summary(self, cik: str, earlier: dt.date, later: dt.date) -> DataFrame:
        """Counts over the same sets: positions at either date, at both, with several rows, and each kind of change."""
        sides = self._period_sides(cik, earlier, later).agg(
            F.count_if(F.col("e_n") > 0).alias("earlier_position_count"), F.count_if(F.col("l_n") > 0).alias("later_position_count"), F.count_if((F.col("e_n") > 0) & (F.col("l_n") > 0)).alias("both_dates_count"), F.count_if((F.col("e_n") > 1) | (F.col("l_n") > 1)).alias("several_rows_count")
        )
        kinds = self.portfolio_period_changes(cik, earlier, later).agg(*[F.count_if(F.col("change_type") == t).alias(n) for t, n in (("NEW_POSITION_OBSERVED", "new_count"), ("POSITION_NO_LONGER_OBSERVED", "no_longer_count"), ("EXISTING_POSITION_CHANGED", "changed_count"))])
        return sides.crossJoin(kinds)  # one row each

    def borrower_observation_listing(self) -> DataFrame:
        """One row per matched name: entity, line, filing, its shown document and its registrant if it is the only one."""
        names = self.heads("current_borrower_name_observation").select(F.col("id").alias("borrower_name_observation_id"), "position_observation_id", "normalized_text")
        matched = self.heads("current_entity_resolution").where("state = 'MATCHED'").select("borrower_name_observation_id", "legal_entity_id")
        positions = self.table("obs.position_observation").select(F.col("id").alias("position_observation_id"), "filing_id", "reported_date", "holding_descriptor_raw")
        filings = self.table("registry.filing").select(F.col("id").alias("filing_id"), "accession_number").join(self._filing_document(), "filing_id", "left").join(self.portfolio_filing_registrant().select("filing_id", "registrant_cik"), "filing_id", "left")
        names_of = self.table("identity.legal_entity").select(F.col("id").alias("legal_entity_id"), "display_name")
        return names.join(matched, "borrower_name_observation_id").join(positions, "position_observation_id").join(filings, "filing_id").join(names_of, "legal_entity_id", "left")

    def legal_entities_with_canonical(self, canonical_id: str) -> DataFrame:
        return self.canonical_legal_entity().where(F.col("canonical_id") == canonical_id).select("legal_entity_id")

    # Filings as an administrator reads them
    def admin_filing_registrant(self) -> DataFrame:
        names = self.registrant_attribute_status().where("attribute_code = 'NAME'").select("registrant_id", F.col("attribute_state").alias("name_state"), F.col("value").alias("name_raw"))
        return self.current_filing_registrant().join(names, "registrant_id", "left")

    def admin_filing_document(self) -> DataFrame:
        linked = self.table("registry.filing_document_artifact").select(F.col("filing_document_id").alias("id")).distinct().withColumn("__linked", F.lit(True))
        filings = self.table("registry.filing").select(F.col("id").alias("filing_id"), "accession_number")
        rows = self.table("registry.filing_document").join(linked, "id", "left").join(filings, "filing_id")
        return rows.select("filing_id", "accession_number", F.col("id").alias("filing_document_id"), "document_name", "document_url", "named_by", F.coalesce("__linked", F.lit(False)).alias("artifact_linked"))

    def admin_filing_artifact(self) -> DataFrame:
        artifacts = self.table("raw.artifact").select(F.col("id").alias("artifact_id"), "source_url", "source_type_code", "retrieved_at")
        return self.admin_filing_document().drop("artifact_linked", "named_by").join(self.table("registry.filing_document_artifact"), "filing_document_id").join(artifacts, "artifact_id")

    def admin_filing_processing(self) -> DataFrame:
        links = self.admin_filing_artifact().select("filing_id", "accession_number", "artifact_id").distinct()
        done = self.table("ops.artifact_processing").select(F.col("id").alias("artifact_processing_id"), "artifact_id", "outcome")
        return links.join(done, "artifact_id")

    def located_value(self) -> DataFrame:
        """evidence_id, checkable, place: whether a locator points at one value, and where that is: row and column of a table, or the path of a document."""
        cell = (F.col("locator_type") == "TSV_CELL") & F.col("row_number").isNotNull() & F.col("column_label").isNotNull()
        path = (F.col("locator_type") == "JSON_PATH") & F.col("json_path").isNotNull()
        place = F.when(cell, F.concat(F.col("row_number").cast("string"), F.lit(":"), "column_label")).when(path, F.col("json_path"))
        return self.table("evidence.evidence").select(F.col("id").alias("evidence_id"), "artifact_id", F.coalesce(cell | path, F.lit(False)).alias("checkable"), place.alias("place"))
