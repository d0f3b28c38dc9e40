"""Closed vocabularies of the model, and the headers of its source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUE_STATE = ("REPORTED", "DERIVED", "UNKNOWN", "NOT_APPLICABLE")
READ_STATE = ("REPORTED", "UNKNOWN", "NOT_APPLICABLE", "MULTIPLE_VALUES")
CURRENCY_STATE = ("FROM_FILING", "FROM_NUM_UNIQUE_MATCH", "AMBIGUOUS", "UNKNOWN")
SCALE_STATE = ("KNOWN", "UNRESOLVED", "NOT_APPLICABLE")
RESOLUTION_STATE = ("MATCHED", "PROBABLE", "UNRESOLVED", "REJECTED")
COVERAGE_STATE = ("COVERED", "EMPTY_PERIOD", "NOT_INGESTED", "NOT_IN_SCOPE", "UNKNOWN")
COMPARISON_STATE = ("COMPARABLE", "INSUFFICIENT_DATA")

SOI_HEADER = (
    "adsh", "cik", "name", "ddate", "qtrs", "form", "filed", "period", "inlineurl", "cstm", "Industry Sector Axis", "Investment, Identifier Axis", "Investment, Issuer Affiliation Axis", "Investment Type Axis",
    "Investment Interest Rate", "Investment, Basis Spread, Variable Rate", "Investment Maturity Date", "Investment Owned, Balance, Principal Amount", "Investment Owned, Cost", "Investment Owned, Fair Value", "Investment Owned, Net Assets, Percentage",
)
SUB_HEADER = (
    "adsh cik name countryba stprba cityba zipba bas1 bas2 baph countryma stprma cityma zipma mas1 mas2 countryinc stprinc ein former changed afs wksi fye form period fy fp filed fileNumber accepted prevrpt detail instance pubfloatusd floatdate inlineurl"
).split()
NUM_HEADER = "adsh tag version ddate qtrs uom segments dimn value footnote footlen".split()
REGISTRY_HEADER = ("File_No", "CIK", "Registrant_Name", "Address_1", "Address_2", "City", "State", "Zip_Code", "Filing Date", "Filing Type")
#: code: (fixed header, whether further columns may follow, delimiter)
SOURCE_TABLES = {"SOI": (SOI_HEADER, True, "\t"), "SUB": (tuple(SUB_HEADER), False, "\t"), "NUM": (tuple(NUM_HEADER), False, "\t"), "REGISTRY": (REGISTRY_HEADER, False, ",")}
FILING_ARRAYS = "accessionNumber filingDate reportDate acceptanceDateTime act form fileNumber filmNumber items core_type size isXBRL isInlineXBRL isXBRLNumeric primaryDocument primaryDocDescription".split()


def outside_vocabulary(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose known value is none of the vocabulary."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def value_shape_violations(df: DataFrame) -> DataFrame:
    """Rows of field values (state, raw_text, number, date, text, scale_state, precision, reason, currency_state, currency_code) that break a shape rule, with the rule.

    REPORTED needs raw text and exactly one normalised value unless its scale is unresolved or it is a month; UNKNOWN needs a
    reason and no value; a normalised zero needs disclosed zero text; a currency code stands exactly when its state knows one.
    """
    from stratalog.functions.text import is_zero_text

    values = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("number", "date", "text"))
    month = F.coalesce(F.col("precision") == "MONTH", F.lit(False))
    loose = F.coalesce(F.col("scale_state") == "UNRESOLVED", F.lit(False)) | month
    coded = ~F.col("currency_state").isin("UNKNOWN", "AMBIGUOUS")
    rules = (
        ("REPORTED_WITHOUT_TEXT", (F.col("state") == "REPORTED") & F.col("raw_text").isNull()),
        ("REPORTED_NOT_ONE_VALUE", (F.col("state") == "REPORTED") & ~loose & (values != 1)),
        ("UNKNOWN_WITH_VALUE", (F.col("state") == "UNKNOWN") & (values > 0)),
        ("UNKNOWN_WITHOUT_REASON", (F.col("state") == "UNKNOWN") & F.col("reason").isNull()),
        ("ZERO_NOT_DISCLOSED", (F.col("number") == 0) & ~F.coalesce(is_zero_text(F.col("raw_text")), F.lit(False))),
        ("CURRENCY_STATE", F.col("currency_state").isNotNull() & (coded != F.col("currency_code").isNotNull())),
    )
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))
    return df.select(*df.columns, F.explode(broken).alias("rule"))
