"""Identifiers and dates of assignments, as Column functions. What depends on time takes it as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_id(name: Column, at: Column, prefix: str = "AG", length: int = 8) -> Column:
    """Prefix, first digits of the md5 of name and time, time of day."""
    stamp = F.date_format(at, "yyyyMMdd_HHmmss")
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.md5(F.concat(name, F.lit("_"), stamp)), 1, length), F.lit("_"), F.date_format(at, "HHmmss"))


def dated_id(prefix: Column, at: Column, unique: Column | None = None) -> Column:
    """Prefix, date and eight characters in upper case, of a random UUID unless given."""
    return F.concat(prefix, F.lit("-"), F.date_format(at, "yyyyMMdd"), F.lit("-"), F.upper(F.substring(unique if unique is not None else F.uuid(), 1, 8)))


def subject_prefix(subject: Column) -> Column:
    """The first three letters of the subject in upper case; ASN without one."""
    return F.substring(F.upper(F.coalesce(subject, F.lit("ASN"))), 1, 3)


def points(custom: Column, template: Column, default: int = 100) -> Column:
    """The custom points unless null or 0, else the template's, else the default."""
    return F.coalesce(F.nullif(custom, F.lit(0)), F.nullif(template, F.lit(0)), F.lit(default))


def academic_year(at: Column) -> Column:
    """The school year that begins in August."""
    first = F.year(at) - F.when(F.month(at) >= 8, 0).otherwise(1)
    return F.concat(first.cast("string"), F.lit("-"), (first + 1).cast("string"))


def is_due_date(text: Column) -> Column:
    """Whether a text is a date of the form year-month-day; leading zeros may be missing."""
    return F.coalesce(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text), F.lit("yyyy-M-d")).isNotNull(), F.lit(False))
