"""Column functions on text: lexical classes, names, identifiers and hashes. All stay in the JVM but for normalisation forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a company name that say its legal form only.
CORPORATE_SUFFIXES = ("LLC", "INC", "CORP", "CORPORATION", "LTD", "LIMITED", "LP", "LLP", "CO", "COMPANY", "PLC", "HOLDINGS")


def is_zero_text(text: Column) -> Column:
    """Whether a text discloses a zero, however it is written: blanks, a sign, zeros with at most one point among or beside them, an exponent."""
    bare = F.regexp_replace(text, r"\A\s*[-+]?|\s*\z", "")
    mantissa = F.regexp_replace(bare, r"(?<=[0.])[Ee][-+]?[0-9]+\z", "")
    return mantissa.rlike(r"\A[0.]+\z") & mantissa.contains("0") & (F.length(F.replace(mantissa, F.lit("0"), F.lit(""))) <= 1)


def is_accession(text: Column) -> Column:
    return text.rlike(r"^[0-9]{10}-[0-9]{2}-[0-9]{6}\z")


def is_amendment(form: Column) -> Column:
    return form.rlike(r"/A\z")


def iso_currency(unit: Column) -> Column:
    """The unit if it is three capital letters, else null."""
    return F.when(unit.rlike(r"^[A-Z]{3}\z"), unit)


def name_tokens(text: Column) -> Column:
    """Upper-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " "), " "), lambda x: x != "")


def core_tokens(text: Column) -> Column:
    """Name tokens without corporate suffixes; order and repeats are kept."""
    return F.filter(name_tokens(text), lambda x: ~x.isin(*CORPORATE_SUFFIXES))


def suffix_tokens(text: Column) -> Column:
    return F.filter(name_tokens(text), lambda x: x.isin(*CORPORATE_SUFFIXES))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).strip(" "))


def nfc_trimmed(text: Column) -> Column:
    """NFC without outer ASCII spaces (no other blank is trimmed). Only texts that are not plain ASCII go to Python."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.btrim(text, F.lit(" "))).otherwise(_nfc(F.when(~plain, text)))


def lexical_class(text: Column) -> Column:
    """The narrowest class of a cell's text."""
    cases = (
        ("EMPTY", text == ""), ("INTEGER", text.rlike(r"^-?[0-9]+\z")), ("DECIMAL", text.rlike(r"^-?[0-9]+\.[0-9]+\z")), ("PERCENT", text.rlike(r"^-?[0-9]+(\.[0-9]+)?%\z")),
        ("ISO_DATE", text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z")), ("US_DATE", text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\z")), ("ACCESSION", is_accession(text)),
        ("URL", text.rlike("^https?://")), ("BOOLEAN", F.lower(text).isin("true", "false")),
    )
    result = F.when(text.isNull(), None).otherwise(F.lit("TEXT"))
    for name, condition in reversed(cases):
        result = F.when(condition, name).otherwise(result)
    return result


def magnitude_band(value: Column) -> Column:
    """Zero, or the decade of the absolute value between 1 and a billion."""
    size = F.abs(value)
    result = F.lit("1E9+")
    for power in range(8, -1, -1):
        result = F.when(size < 10 ** (power + 1), f"1E{power}").otherwise(result)
    return F.when(value.isNull(), None).when(size == 0, "ZERO").when(size < 1, "BELOW_1").otherwise(result)


def segment_member(segments: Column, axis: str = "InvestmentIdentifier") -> Column:
    """The member of an axis in `Axis=member;Axis(version)=text();` lists, the typed form first; null if there is none or it is empty."""
    typed = F.regexp_extract(segments, rf"(?:^|;)\s*{axis}\([^)]*\)=([^;]*)", 1)
    plain = F.regexp_extract(segments, rf"(?:^|;)\s*{axis}=([^;]*)", 1)
    return F.coalesce(F.nullif(F.btrim(typed), F.lit("")), F.nullif(F.btrim(plain), F.lit("")))


def names_axis(segments: Column, axes: tuple[str, ...]) -> Column:
    """Whether a segment list has a pair of one of these axes; the name must begin a pair. False for null."""
    pairs = F.transform(F.split(segments, ";"), lambda p: F.regexp_extract(F.btrim(p), r"\A([A-Za-z]+)(?:\([^)]*\))?=", 1))
    return F.coalesce(F.arrays_overlap(pairs, F.array(*[F.lit(a) for a in axes])), F.lit(False))


def disclosed_text(text: Column) -> tuple[Column, Column]:
    """(state, text) of a disclosed member: UNKNOWN for null and empty, else as it stands."""
    known = F.nullif(text, F.lit(""))
    return F.when(known.isNull(), "UNKNOWN").otherwise("REPORTED"), known


def source_field(path: Column) -> Column:
    """A JSON path with its indexes made general."""
    return F.regexp_replace(path, r"\[[0-9]+\]", "[*]")


def padded_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def trailing_markers(text: Column) -> tuple[Column, Column]:
    """The text without its trailing run of footnote markers such as (1)(2), and that run ('' if none)."""
    run = F.regexp_extract(text, r"((?:\s*\([0-9]{1,3}\))+)\s*\z", 1)
    return F.rtrim(F.regexp_replace(text, r"(?:\s*\([0-9]{1,3}\))+\s*\z", "")), F.btrim(run)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def contains_needle(html: Column, needle: Column) -> Column:
    """Whether a document holds a text as it is, with its basic entities decoded, or with its tags removed."""
    decoded = html
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return html.contains(needle) | decoded.contains(needle) | strip_tags(decoded).contains(needle)
