"""The integrity rules of the model as assertions: each method gives the rows that break one, with the rule; a writer appends only if all are empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.values import release_window
from stratalog.operators import chains, integrity
from stratalog.plans.positions import DOCUMENT_PREFIX, Positions

#: Which columns a field of each kind may fill.
_KIND_OF = {"PRINCIPAL_AMOUNT": "number", "COST": "number", "FAIR_VALUE": "number", "INTEREST_RATE": "number", "SPREAD": "number", "INTEREST_RATE_FLOOR": "number", "MATURITY_DATE": "date", "ACQUISITION_DATE": "date"}


def broken(rows: DataFrame, id_column: str, rules: dict[str, Column]) -> DataFrame:
    """id, rule for every rule whose condition (what is wrong) holds on a row; null conditions do not hold. One pass, whatever the number of rules."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(F.col(id_column).cast("string").alias("id"), F.explode(found).alias("rule"))


class Assertions(Positions):
    def _named(self, name: str, id_as: str, *columns: str) -> DataFrame:
        """Columns of a table with its id under another name, for joins."""
        return self.table(name).select(F.col("id").alias(id_as), *columns)

    def evidence_locators(self) -> DataFrame:
        """SHAPE: a locator lacks what its type needs. LABEL: a cell's label is not at its place in the header of the artifact's load (each artifact has few loads)."""
        loads = self.table("raw.table_load").select("artifact_id", F.col("header").alias("__h"))
        rows = self.table("evidence.evidence").join(loads, "artifact_id", "left")
        cell, row, path = (F.col("locator_type") == t for t in ("TSV_CELL", "TSV_ROW", "JSON_PATH"))
        shape = (cell & (F.col("column_label").isNull() | F.col("row_number").isNull() | F.col("column_number").isNull())) | (row & F.col("row_number").isNull()) | (path & F.col("json_path").isNull())
        label = cell & F.col("__h").isNotNull() & ~F.get("__h", F.col("column_number").cast("int") - 1).eqNullSafe(F.col("column_label"))
        return broken(rows, "id", {"SHAPE": shape, "LABEL": label}).distinct()

    def position_origins(self) -> DataFrame:
        """ORIGIN: no origin row. FILING, DATE, TEXT: differs from it. KIND: the origin is not currently an identifier row."""
        origins = self.table("obs.soi_row_observation").select(F.col("id").alias("origin_soi_row_observation_id"), F.col("filing_id").alias("f"), F.col("reported_date").alias("d"), F.col("identifier_raw").alias("t"))
        kinds = self.heads("current_soi_row_classification").select(F.col("soi_row_observation_id").alias("origin_soi_row_observation_id"), "row_kind")
        rows = self.table("obs.position_observation").join(origins, "origin_soi_row_observation_id", "left").join(kinds, "origin_soi_row_observation_id", "left")
        there = F.col("f").isNotNull()
        return broken(rows, "id", {
            "ORIGIN": ~there, "FILING": there & (F.col("f") != F.col("filing_id")), "DATE": there & ~F.col("d").eqNullSafe(F.col("reported_date")), "TEXT": there & ~F.col("t").eqNullSafe(F.col("holding_descriptor_raw")),
            "KIND": there & ~F.col("row_kind").eqNullSafe(F.lit("IDENTIFIER_ROW")),
        })

    def position_sources(self) -> DataFrame:
        """FILING: a source of another filing. PRIMARY: a primary source that is not the origin. NO_PRIMARY: a position without one."""
        positions = self.table("obs.position_observation").select(F.col("id").alias("position_observation_id"), "filing_id", "origin_soi_row_observation_id")
        rows = self.table("obs.position_observation_source").join(positions, "position_observation_id").join(self.table("obs.soi_row_observation").select(F.col("id").alias("soi_row_observation_id"), F.col("filing_id").alias("f")), "soi_row_observation_id", "left")
        primary = F.col("source_role") == "PRIMARY"
        wrong = broken(rows, "position_observation_id", {"FILING": ~F.col("f").eqNullSafe(F.col("filing_id")), "PRIMARY": primary & (F.col("soi_row_observation_id") != F.col("origin_soi_row_observation_id"))})
        missing = integrity.without_children(positions, "position_observation_id", self.table("obs.position_observation_source"), "position_observation_id", primary)
        return wrong.unionByName(missing.select(F.col("position_observation_id").cast("string").alias("id"), F.lit("NO_PRIMARY").alias("rule")))

    def fact_group_members(self) -> DataFrame:
        """Groups with a member of another FILING, without members (EMPTY), or of another SHAPE than one balance, one spread and at most one PIK."""
        n = lambda role: F.count_if(F.col("member_role") == role)
        groups = self._named("obs.soi_fact_group", "group_id", F.col("filing_id").alias("g_filing"))
        rows = groups.join(self.table("obs.soi_fact_group_member"), "group_id", "left").groupBy("group_id").agg(
            F.count("soi_row_observation_id").alias("n"), F.bool_or(F.coalesce(F.col("filing_id") != F.col("g_filing"), F.lit(False))).alias("other"), n("BALANCE").alias("b"), n("SPREAD").alias("s"), n("PIK").alias("p")
        )
        shape = (F.col("n") > 0) & ~((F.col("b") == 1) & (F.col("s") == 1) & (F.col("p") <= 1))
        return broken(rows, "group_id", {"FILING": F.col("other"), "EMPTY": F.col("n") == 0, "SHAPE": shape})

    def field_values(self) -> DataFrame:
        """KIND: a value in a column that is not the field's. MONTH: a month where there is a day or no date field. SOURCE: reported without a mapping or the original filing. TEXT: reported without text."""
        levels = self._named("evidence.evidence", "evidence_id", "evidence_level")
        rows = self.table("obs.position_field_value").join(levels, "evidence_id", "left")
        kind = F.element_at(F.create_map(*[F.lit(x) for kv in _KIND_OF.items() for x in kv]), F.col("field_code"))
        reported = F.col("value_state") == "REPORTED"
        return broken(rows, "id", {
            "KIND": (F.col("normalized_numeric").isNotNull() & ~kind.eqNullSafe(F.lit("number"))) | (F.col("normalized_date").isNotNull() & ~kind.eqNullSafe(F.lit("date"))),
            "MONTH": (F.col("date_precision") == "MONTH") & (~kind.eqNullSafe(F.lit("date")) | F.col("normalized_date").isNotNull()),
            "SOURCE": reported & F.col("column_mapping_id").isNull() & ~F.col("evidence_level").eqNullSafe(F.lit("L2_ORIGINAL_FILING")),
            "TEXT": reported & F.col("raw_value").isNull(),
        })

    def corroborations(self) -> DataFrame:
        """FILING: a fact of another filing than the value's position. FACT: no such fact."""
        values = self._named("obs.position_field_value", "field_value_id", "position_observation_id").join(self._named("obs.position_observation", "position_observation_id", "filing_id"), "position_observation_id")
        rows = self.table("obs.field_value_corroboration").join(values, "field_value_id").join(self._named("obs.num_fact_observation", "num_fact_observation_id", F.col("filing_id").alias("f")), "num_fact_observation_id", "left")
        return broken(rows, "field_value_id", {"FACT": F.col("f").isNull(), "FILING": F.col("f") != F.col("filing_id")})

    def continuity_registrants(self) -> DataFrame:
        """REGISTRANT: a matched continuity whose line's filing is not linked to the position's registrant."""
        links = self.heads("registry.filing_registrant_link").select("filing_id", "registrant_id").distinct().withColumn("linked", F.lit(True))
        positions = self._named("resolution.position", "position_id", "registrant_id")
        rows = self.table("resolution.position_continuity_decision").where("state = 'MATCHED'").join(positions, "position_id").join(self._named("obs.position_observation", "position_observation_id", "filing_id"), "position_observation_id")
        return broken(rows.join(links, ["filing_id", "registrant_id"], "left"), "id", {"REGISTRANT": F.col("linked").isNull()})

    def evidence_statuses(self) -> DataFrame:
        """PASS: verified by a check that did not pass. LEVEL: verified by other evidence than the original filing."""
        results = self._named("validation.validation_result", "validation_result_id", "outcome", "evidence_id").join(self._named("evidence.evidence", "evidence_id", "evidence_level"), "evidence_id", "left")
        rows = self.table("validation.evidence_status_assertion").where("evidence_status = 'FILING_VERIFIED'").join(results, "validation_result_id", "left")
        return broken(rows, "id", {"PASS": ~F.col("outcome").eqNullSafe(F.lit("PASS")), "LEVEL": ~F.col("evidence_level").eqNullSafe(F.lit("L2_ORIGINAL_FILING"))})

    def derived_values(self) -> DataFrame:
        """RULE: made by a rule that derives nothing. NO_INPUT: without inputs. SUPERSEDED, MAPPING, UNKNOWN: an input that may feed no derived value."""
        wrong = broken(self.table("derived.derived_value"), "id", {"RULE": F.col("rule_kind") != "DERIVATION"})
        bare = integrity.without_children(self.table("derived.derived_value"), "id", self.table("derived.derived_value_input"), "derived_value_id").select(F.col("id").cast("string").alias("id"), F.lit("NO_INPUT").alias("rule"))
        gone = self.table("obs.position_field_value").where("supersedes_id is not null").select(F.col("supersedes_id").alias("field_value_id")).distinct().withColumn("gone", F.lit(True))
        fit = self.current_mapping_status().withColumnRenamed("mapping_id", "column_mapping_id")
        inputs = self.table("derived.derived_value_input").join(self._named("obs.position_field_value", "field_value_id", "value_state", "column_mapping_id"), "field_value_id").join(gone, "field_value_id", "left").join(fit, "column_mapping_id", "left")
        documented = F.col("mapping_status").isin("DOCUMENTED", "DOCUMENTED_AND_OBSERVED")
        gate = broken(inputs, "derived_value_id", {"SUPERSEDED": F.col("gone"), "MAPPING": F.col("column_mapping_id").isNotNull() & ~F.coalesce(documented, F.lit(False)), "UNKNOWN": F.col("value_state") == "UNKNOWN"})
        return wrong.unionByName(bare).unionByName(gate.distinct())

    def filing_documents(self) -> DataFrame:
        """URL: a document whose address is not made of its filer's number, the accession number and its name."""
        filings = self._named("registry.filing", "filing_id", "accession_number")
        links = self.current_filing_registrant().where("registrant_link_status = 'LINKED'").groupBy("filing_id").agg(F.min("cik").alias("cik"))
        rows = self.table("registry.filing_document").join(filings, "filing_id").join(links, "filing_id")
        url = F.concat(F.lit(DOCUMENT_PREFIX), F.col("cik").cast("string"), F.lit("/"), F.replace("accession_number", F.lit("-"), F.lit("")), F.lit("/"), "document_name")
        return broken(rows, "id", {"URL": F.col("document_url") != url})

    def dataset_releases(self) -> DataFrame:
        """LABEL: no release label. WINDOW: not the days that the label stands for."""
        window = release_window(F.col("release_label"))
        rows = self.table("registry.dataset_release").withColumn("w", window)
        return broken(rows, "id", {"LABEL": F.col("w").isNull(), "WINDOW": (F.col("w.starts") != F.col("window_start")) | (F.col("w.ends") != F.col("window_end"))})

    def load_headers(self) -> DataFrame:
        """HEADER: a load without header that has rows, or is no schedule table."""
        empty = F.col("header").isNull() | (F.size("header") == 0)
        return broken(self.table("raw.table_load"), "id", {"HEADER": empty & ((F.col("row_count") > 0) | (F.col("table_code") != "SOI"))})

    def projection_exceptions(self) -> DataFrame:
        """LOAD: a row of another load. STATUS: a width exception of a row of the right width, or another exception of one that is not."""
        rows = self.table("ops.projection_exception").join(self._named("raw.tabular_row", "tabular_row_id", F.col("table_load_id").alias("l"), "parse_status"), "tabular_row_id", "left")
        width = F.col("kind") == "FIELD_COUNT_MISMATCH"
        return broken(rows, "id", {"LOAD": ~F.col("l").eqNullSafe(F.col("table_load_id")), "STATUS": width != (F.col("parse_status") == "FIELD_COUNT_MISMATCH")})

    def observation_events(self) -> DataFrame:
        """DATE, EVIDENCE: an event that does not repeat those of its position."""
        rows = self.table("derived.observation_event").join(self._named("obs.position_observation", "position_observation_id", "reported_date", F.col("evidence_id").alias("e")), "position_observation_id")
        return broken(rows, "id", {"DATE": ~F.col("event_date").eqNullSafe(F.col("reported_date")), "EVIDENCE": ~F.col("evidence_id").eqNullSafe(F.col("e"))})

    def observation_event_listing(self) -> DataFrame:
        return self.table("derived.observation_event").select("id", "position_observation_id", "event_type", "event_date", "evidence_id")

    def row_classifications(self) -> DataFrame:
        """IDENTIFIER: an identifier row without identifier, or a total with one. LEVEL: a subtotal not proved by the original filing."""
        levels = self._named("evidence.evidence", "evidence_id", "evidence_level")
        rows = self.table("obs.soi_row_classification").join(self._named("obs.soi_row_observation", "soi_row_observation_id", "identifier_raw"), "soi_row_observation_id").join(levels, "evidence_id", "left")
        blank = F.coalesce(F.btrim("identifier_raw") == "", F.lit(True))
        return broken(rows, "id", {"IDENTIFIER": ((F.col("row_kind") == "IDENTIFIER_ROW") & blank) | ((F.col("row_kind") == "TOTAL_ROW") & ~blank), "LEVEL": (F.col("row_kind") == "SUBTOTAL_ROW") & ~F.col("evidence_level").eqNullSafe(F.lit("L2_ORIGINAL_FILING"))})

    def maturity_inspections(self) -> DataFrame:
        """DAY, MONTH, NOTHING: not the columns its state needs. LEVEL: shown, but not by the original filing. CANDIDATE: candidates beside a state that has none."""
        levels = self._named("evidence.evidence", "evidence_id", "evidence_level")
        with_candidates = self.table("obs.maturity_inspection_candidate").select(F.col("maturity_inspection_id").alias("id")).distinct().withColumn("candidates", F.lit(True))
        rows = self.table("obs.maturity_inspection").join(levels, "evidence_id", "left").join(with_candidates, "id", "left")
        state, day, year, month = (F.col(c) for c in ("inspection_state", "normalized_date", "displayed_year", "displayed_month"))
        shown = state.isin("FILING_DISPLAYED", "FILING_MONTH")
        return broken(rows, "id", {
            "DAY": (state == "FILING_DISPLAYED") & (day.isNull() | year.isNotNull() | month.isNotNull()), "MONTH": (state == "FILING_MONTH") & (day.isNotNull() | year.isNull() | ~F.coalesce(month.between(1, 12), F.lit(False))),
            "NOTHING": ~shown & (day.isNotNull() | year.isNotNull() | F.col("raw_value").isNotNull()), "LEVEL": shown & ~F.col("evidence_level").eqNullSafe(F.lit("L2_ORIGINAL_FILING")), "CANDIDATE": F.col("candidates") & (state != "UNRESOLVED"),
        })

    def name_observations(self) -> DataFrame:
        """TEXT: an extracted name without text, or text without extraction. SUCCESSOR: a successor that changes nothing."""
        names = self.table("obs.borrower_name_observation")
        before = names.select(F.col("id").alias("supersedes_id"), *[F.col(c).alias(f"b_{c}") for c in ("position_observation_id", "source_column_label", "extraction_state", "normalized_text")], F.lit(True).alias("there"))
        rows = names.join(before, "supersedes_id", "left")
        same = F.col("there")
        for c in ("position_observation_id", "source_column_label", "extraction_state", "normalized_text"):
            same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
        return broken(rows, "id", {"TEXT": (F.col("extraction_state") == "EXTRACTED") != F.col("normalized_text").isNotNull(), "SUCCESSOR": same})

    def name_chains(self) -> DataFrame:
        """What breaks the chain of name observations: see chains.supersession_violations."""
        found = chains.supersession_violations(self.table("obs.borrower_name_observation"), ["position_observation_id", "source_column_label"], single_chain=False)
        return found.select(F.col("id").cast("string").alias("id"), F.col("violation").alias("rule"))
