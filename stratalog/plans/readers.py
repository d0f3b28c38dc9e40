"""What readers of the model make of its views: long comparisons, groups, walls, directories and searches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import text as tx
from stratalog.operators import matching, states
from stratalog.plans.assertions import Assertions
from stratalog.plans.positions import AMOUNTS, RATES

#: Axes of facts that are not about one holding.
FORBIDDEN_AXES = ("Range", "InvestmentCompanyNonconsolidatedSubsidiary")


class Readers(Assertions):
    # Comparisons
    def comparison_fields(self, legal_entity_id: str) -> DataFrame:
        """One row per compared field of a borrower's comparisons: field, state, changed, earlier and later text. One pass, no union."""
        told = []
        for name in (*AMOUNTS, *RATES, "maturity", "acquisition"):
            told.append(F.struct(F.lit(name).alias("field"), F.col(f"{name}_comparison").alias("state"), F.col(f"{name}_changed").alias("changed"), F.col(f"e_{name}_raw").alias("earlier_raw"), F.col(f"l_{name}_raw").alias("later_raw")))
        return self.borrower_comparisons(legal_entity_id).select("position_id", "earlier_id", "later_id", "earlier_date", "later_date", F.inline(F.array(*told)))

    def amount_review_fields(self, legal_entity_id: str) -> DataFrame:
        return self.comparison_fields(legal_entity_id).where(F.col("field").isin(*AMOUNTS))

    def stored_differences(self, legal_entity_id: str) -> DataFrame:
        """Comparable fields that changed, each with its amount of change in words of its own field."""
        rows = self.comparison_fields(legal_entity_id).where("state = 'COMPARABLE' and changed")
        return rows.select("earlier_id", "later_id", "field", F.concat_ws(" -> ", "earlier_raw", "later_raw").alias("difference"))

    def maturity_change_lines(self, legal_entity_id: str) -> DataFrame:
        return self.stored_differences(legal_entity_id).where("field = 'maturity'").drop("field")

    def what_changed(self, legal_entity_id: str) -> DataFrame:
        """Typed signals: a field with a sign of its change (UP, DOWN, OTHER), per pair."""
        signs = [F.when(F.col(f"{n}_changed"), F.struct(F.lit(n).alias("field"), F.when(F.col(f"{n}_delta") > 0, "UP").when(F.col(f"{n}_delta") < 0, "DOWN").alias("direction"))) for n in (*AMOUNTS, *RATES)]
        signs += [F.when(F.col(f"{n}_changed"), F.struct(F.lit(n).alias("field"), F.lit("OTHER").alias("direction"))) for n in ("maturity", "acquisition")]
        return self.borrower_comparisons(legal_entity_id).select("position_id", "earlier_id", "later_id", F.inline(F.array_compact(F.array(*signs))))

    def comparison_availability(self) -> DataFrame:
        """Per canonical entity how many comparisons its own lines have and the latest date of one; entities without one have none, not zero dates."""
        rows = self.position_period_comparison().where("e_legal_entity_id = l_legal_entity_id").select(F.col("l_legal_entity_id").alias("legal_entity_id"), "later_date")
        per = rows.join(self.canonical_legal_entity().where("canonical_id is not null"), "legal_entity_id").groupBy("canonical_id").agg(F.count(F.lit(1)).alias("comparison_count"), F.max("later_date").alias("latest_date"))
        entities = self.canonical_legal_entity().select("canonical_id").where("canonical_id is not null").distinct()
        return entities.join(per, "canonical_id", "left").withColumn("comparison_count", F.coalesce("comparison_count", F.lit(0).cast("long")))

    def borrowers(self, has_comparisons: bool | None = None) -> DataFrame:
        """Entities with their names' counts and comparisons; has_comparisons keeps those with or without."""
        listed = self.borrower_observation_listing().groupBy("legal_entity_id", "display_name").agg(F.count(F.lit(1)).alias("name_count"), F.count_distinct("registrant_cik").alias("registrant_count"), F.max("reported_date").alias("latest_reported_date"))
        out = listed.join(self.comparison_availability().withColumnRenamed("canonical_id", "legal_entity_id"), "legal_entity_id", "left")
        return out if has_comparisons is None else out.where((F.coalesce("comparison_count", F.lit(0)) > 0) == has_comparisons)

    def borrower_detail(self, legal_entity_id: str) -> DataFrame:
        """Per registrant of a borrower: lines, first and last date, and the name if all lines agree."""
        rows = self.borrower_observation_listing().where(F.col("legal_entity_id") == legal_entity_id)
        return rows.groupBy("registrant_cik").agg(F.count(F.lit(1)).alias("line_count"), F.min("reported_date").alias("first_date"), F.max("reported_date").alias("last_date"), states.three_state(F.col("normalized_text")).alias("name_state"), states.single_value(F.col("normalized_text")).alias("name"))

    def historical_positions(self, legal_entity_id: str) -> DataFrame:
        """A borrower's lines with the state and text of industry and instrument type (several rows are MULTIPLE_VALUES) and the filing's shown document."""
        columns = []
        for code, name in (("INDUSTRY", "industry"), ("INSTRUMENT_TYPE", "instrument_type")):
            own = F.col("field_code") == code
            state = states.four_state(F.when(own, F.col("value_state")), F.when(own, F.col("raw_value")))
            columns += [state.alias(f"{name}_state"), F.when(state == "REPORTED", F.min(F.when(own, F.col("raw_value")))).alias(f"{name}_raw")]
        research = self.research_fields().groupBy("position_observation_id").agg(*columns)
        rows = self.borrower_position_observations(legal_entity_id).select("position_observation_id", "filing_id", "registrant_cik", "reported_date", "holding_descriptor_raw", "principal_raw", "fair_value_raw")
        rows = rows.join(research, "position_observation_id", "left").join(self._filing_document(), "filing_id", "left")
        return rows.select(*[F.coalesce(c, F.lit("UNKNOWN")).alias(c) if c in ("industry_state", "instrument_type_state") else F.col(c) for c in rows.columns])

    def position_groups(self, legal_entity_id: str) -> DataFrame:
        rows = self.historical_positions(legal_entity_id)
        return rows.groupBy("registrant_cik").agg(F.count(F.lit(1)).alias("line_count"), F.count_distinct("reported_date").alias("date_count"), F.min("reported_date").alias("first_date"), F.max("reported_date").alias("last_date"))

    def valuation_history(self, legal_entity_id: str) -> DataFrame:
        """Long timeline of a borrower's valuation texts; metrics that are unknown are left out, and told by the flag that something is."""
        told = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("string").alias("text")) for n in ("fair_value_delta", "fair_value_change_percent", "fair_value_to_principal", "fair_value_to_cost")]
        rows = self.borrower_position_valuation(legal_entity_id).select("position_id", "later_id", "later_date", F.array(*told).alias("m"))
        kept = F.filter("m", lambda x: x["text"].isNotNull())
        return rows.select("position_id", "later_id", "later_date", (F.size(kept) < len(told)).alias("has_unknown"), F.inline(kept))

    def maturity_wall(self, legal_entity_id: str) -> DataFrame:
        """Resolved lines with a maturity, by year and precision, and how many unresolved lines of the borrower are not among them."""
        rows = self.borrower_maturity_observations(legal_entity_id)
        dropped = rows.agg(F.count_if(F.col("maturity_observation_state").startswith("UNRESOLVED")).alias("unresolved_count"))
        points = rows.where("maturity_observation_state = 'OBSERVED'").select("position_observation_id", "reported_date", "maturity_raw", "maturity_precision_class", "maturity_bucket_year")
        return points.crossJoin(F.broadcast(dropped))  # one row

    def comparison_traces(self, legal_entity_id: str) -> DataFrame:
        """Per comparison and amount the value rows of both sides, in order of their ids."""
        traces = self.heads("current_position_field_value").where(F.col("field_code").isin("PRINCIPAL_AMOUNT", "COST", "FAIR_VALUE")).groupBy("position_observation_id", "field_code").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # a line has few rows of a field
        pairs = self.borrower_comparisons(legal_entity_id).select("earlier_id", "later_id", F.explode(F.array(*[F.lit(c) for c in ("PRINCIPAL_AMOUNT", "COST", "FAIR_VALUE")])).alias("field_code"))
        for side in ("earlier", "later"):
            pairs = pairs.join(traces.withColumnsRenamed({"position_observation_id": f"{side}_id", "ids": f"{side}_ids"}), [f"{side}_id", "field_code"], "left")
        return pairs

    # Directories
    def list_portfolios(self, needle: str) -> DataFrame:
        """Registrants with lines whose number or only name holds the text, whatever its case, literally."""
        known = F.when(F.col("name_state") == "REPORTED", F.col("name_raw"))
        return self.portfolio_registrant().where(F.lower(F.concat_ws(" ", "registrant_cik", known)).contains(F.lit(needle.lower())))

    def list_registrant_coverage(self, needle: str) -> DataFrame:
        names = self.registrant_attribute_status().where("attribute_code = 'NAME'").select("registrant_id", F.col("value").alias("name_raw"))
        rows = self.market_registrant_coverage().join(names, "registrant_id", "left")
        return rows.where(F.lower(F.concat_ws(" ", "registrant_cik", "name_raw")).contains(F.lit(needle.lower())))

    def market_directory(self) -> DataFrame:
        """The three lists of the market as one list of documents: kind, key, json."""
        parts = (("registrant", self.market_registrant_coverage(), "registrant_cik"), ("release", self.market_release_coverage(), "release_label"), ("date", self.market_reported_date(), "reported_date"))
        out = None
        for kind, df, key in parts:
            told = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("json"))
            out = told if out is None else out.unionByName(told)
        return out

    def series_coverage(self) -> DataFrame:
        """Of the series of positions: how many have one date, several with neighbours that compare, and several of which none do."""
        read = self.position_read().where("continuity_state = 'MATCHED' and position_id is not null and reported_date is not null")
        series = read.groupBy("position_id").agg(F.count_distinct("reported_date").alias("dates"), F.count(F.lit(1)).alias("lines"))
        pairs = self.position_period_comparison().groupBy("position_id").agg(F.count(F.lit(1)).alias("pairs"))
        kind = states.first_match((F.col("dates") == 1, "ONE_DATE"), (F.col("pairs") > 0, "COMPARED"), otherwise="NOT_COMPARED")
        return series.join(pairs, "position_id", "left").groupBy(kind.alias("series_kind")).agg(F.count(F.lit(1)).alias("series_count"), F.sum("lines").alias("line_count"))

    # Decisions on values
    def currency_plan(self) -> DataFrame:
        """What the facts of a filing say about the currency of each of its fair values that has none."""
        positions = self.table("obs.position_observation").select(F.col("id").alias("position_observation_id"), "filing_id")
        heads = self.heads("current_position_field_value").where("field_code = 'FAIR_VALUE' and value_state = 'REPORTED' and currency_state = 'UNKNOWN'").join(positions, "position_observation_id").select("id", "filing_id", F.col("normalized_numeric").alias("value"))
        facts = self.table("obs.num_fact_observation").withColumn("excluded", tx.names_axis(F.col("segments"), FORBIDDEN_AXES))
        return matching.currency_plan(heads, facts, "id", ["filing_id"], "value", "unit", "excluded")

    def matchable_instruments(self) -> DataFrame:
        """Positions of which an instrument can be told: a name and a reported type."""
        types = self.research_fields().where("field_code = 'INSTRUMENT_TYPE'").groupBy("position_observation_id").agg(states.four_state(F.col("value_state"), F.col("raw_value")).alias("type_state"), states.exactly_one(F.col("raw_value")).alias("type_raw"))
        rows = self.table("obs.position_observation").select(F.col("id").alias("position_observation_id"), "holding_descriptor_raw").join(types, "position_observation_id", "left")
        good = (F.btrim("holding_descriptor_raw") != "") & (F.col("type_state") == "REPORTED")
        return rows.select("position_observation_id", F.coalesce("type_state", F.lit("UNKNOWN")).alias("type_state"), F.coalesce(good, F.lit(False)).alias("can_match"))

    def lines_at(self, date: dt.date) -> DataFrame:
        """Distinct observations at a date."""
        return self._lines().where(F.col("reported_date") == F.lit(date)).agg(F.count_distinct("id").alias("observation_count"))
