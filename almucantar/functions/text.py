"""Strings and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fix_text(s: Column) -> Column:
    """Undoes UTF-8 that was read as Latin-1; other strings stay as they are."""
    narrow = s.rlike(r"^[\x{00}-\x{ff}]*$")
    raw = F.encode(F.when(narrow, s).otherwise(""), "ISO-8859-1").cast("string")
    return F.when(narrow, F.coalesce(F.try_validate_utf8(raw), s)).otherwise(s)


def title_case(s: Column) -> Column:
    """All-capital names in title case, others as they are."""
    return F.when((s == F.upper(s)) & (s != F.lower(s)), F.initcap(F.lower(s))).otherwise(s)


def first_filled(*values: Column) -> Column:
    """The first string that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(""))


def decimal_year(day: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as a year with a fraction; null for anything else."""
    y, m = F.substring(day, 1, 4).try_cast("double"), F.substring(day, 6, 2).try_cast("double")
    full = F.try_to_date(day, "yyyy-MM-dd")
    return (
        F.when(F.length(day) == 4, y + 0.5)
        .when((F.length(day) == 7) & m.between(1, 12), y + (m - 0.5) / 12.0)
        .when(F.length(day) == 10, y + (F.dayofyear(full) - 1) / 365.25)
    )


def cycle_time(cycle_id: Column) -> Column:
    """YYYYMMDDHH as a timestamp; null if it is none."""
    return F.try_to_timestamp(cycle_id, F.lit("yyyyMMddHH"))
