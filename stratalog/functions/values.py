"""Column functions on disclosed dates and numbers: strict, and never more precise than the disclosure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_day(text: Column, pattern: str, form: str) -> Column:
    """The day, or null unless the text has exactly this form and is a real day."""
    return F.when(text.rlike(pattern), F.try_to_date(text, form))


def disclosed_date(text: Column) -> Column:
    """struct(precision, day, year, month) of M/YYYY (MONTH, no day) and M/D/YYYY (DAY); null for anything else. A month is never made a day."""
    trimmed = F.btrim(text)
    month = F.regexp_extract(trimmed, r"^([0-9]{1,2})/([0-9]{4})\z", 1)
    year = F.regexp_extract(trimmed, r"^([0-9]{1,2})/([0-9]{4})\z", 2)
    full = [F.regexp_extract(trimmed, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\z", i) for i in (1, 2, 3)]
    day = F.try_to_date(F.concat_ws("-", full[2], F.lpad(full[0], 2, "0"), F.lpad(full[1], 2, "0")), "yyyy-MM-dd")
    real_month = month.try_cast("int").between(1, 12)
    return F.when(real_month, F.struct(F.lit("MONTH").alias("precision"), F.lit(None).cast("date").alias("day"), year.try_cast("int").alias("year"), month.try_cast("int").alias("month"))).when(
        day.isNotNull(), F.struct(F.lit("DAY").alias("precision"), day.alias("day"), F.year(day).alias("year"), F.month(day).alias("month"))
    )


def release_window(label: Column) -> Column:
    """struct(cadence, starts, ends) of the labels YYYYqN and YYYY_MM; null for anything else."""
    year, quarter = (F.regexp_extract(label, r"^([0-9]{4})q([1-4])\z", i).try_cast("int") for i in (1, 2))
    year2, month = (F.regexp_extract(label, r"^([0-9]{4})_([0-9]{2})\z", i).try_cast("int") for i in (1, 2))
    q_start = F.when(year.isNotNull(), F.make_date(year, quarter * 3 - 2, F.lit(1)))
    m_start = F.when(month.between(1, 12), F.make_date(year2, month, F.lit(1)))
    return F.when(q_start.isNotNull(), F.struct(F.lit("QUARTER").alias("cadence"), q_start.alias("starts"), F.last_day(F.add_months(q_start, 2)).alias("ends"))).when(
        m_start.isNotNull(), F.struct(F.lit("MONTH").alias("cadence"), m_start.alias("starts"), F.last_day(m_start).alias("ends"))
    )


def displayed_decimal(text: Column, scale: Column | int = 0, negative: Column | bool = False) -> Column:
    """The DECIMAL(38,10) of a displayed number: commas, a currency sign, brackets for negative, an em dash for zero, times 10 ** scale."""
    bare = F.regexp_replace(F.btrim(text), r"[,$\s]", "")
    bracketed = bare.rlike(r"^\([0-9]+(\.[0-9]+)?\)\z")
    digits = F.when(bare.isin("—", "–", "-"), "0").when(bracketed, F.substring(bare, 2, 1000)).otherwise(bare)
    digits = F.regexp_replace(digits, r"\)\z", "")
    value = F.when(digits.rlike(r"^-?[0-9]+(\.[0-9]+)?\z"), digits.try_cast("decimal(38,10)"))
    power = F.element_at(F.array(*[F.lit(f"{10.0**k:.10f}").cast("decimal(28,10)") for k in range(-10, 13)]), F.lit(scale) + 11 if isinstance(scale, int) else scale + 11)
    flip = bracketed != (F.lit(negative) if isinstance(negative, bool) else negative)
    scaled = (value * power).cast("decimal(38,10)")
    return F.when(flip, -scaled).otherwise(scaled)


def decimal_sign(text: Column) -> Column:
    """-1, 0 or 1 of a decimal text (-0.00 is 0); null if it is none."""
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?\z"), F.signum(text.try_cast("decimal(38,10)"))).cast("int")


def length_matches(text: Column, length: Column) -> Column:
    """Whether a disclosed length is the number of UTF-8 bytes of a text."""
    return length.rlike(r"^[0-9]+\z") & (F.octet_length(text) == length.try_cast("long"))
