"""Labels, identifiers and time texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment_id(start: Column, end: Column) -> Column:
    """The name of one kilometre from 0 on; null for nulls. Negative starts and other spans fail."""
    wrong = F.raise_error(F.concat(F.lit("not one kilometre from 0 on: "), start.cast("string"), F.lit(" to "), end.cast("string"))).cast("string")
    named = F.format_string("seg_%03d_%03d", start.cast("int"), end.cast("int"))
    return F.when(start.isNotNull() & end.isNotNull(), F.when((start >= 0) & (end == start + 1), named).otherwise(wrong))


def km_label(start: Column, end: Column) -> Column:
    """Null for nulls."""
    return F.when(start.isNotNull() & end.isNotNull(), F.format_string("km %d–%d", start.cast("int"), end.cast("int")))


def title(slug: Column) -> Column:
    """``muy_alta`` as ``Muy Alta``."""
    return F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))


def dimension(flag: Column) -> Column:
    """``campo_climatico`` as ``climatico``."""
    return F.replace(flag, F.lit("campo_"), F.lit(""))


def clean_code(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def fixed(value: Column, places: int) -> Column:
    """Null for null; the sign of a negative zero stays."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value))


def rounded(value: Column, places: int) -> Column:
    """A double scaled, rounded half away from zero and scaled back. Unlike Spark's round this takes the double as it is, not its decimal text, and keeps the sign of what becomes zero."""
    near = F.round(F.abs(value * 10.0**places)) / 10.0**places
    return F.when(value.cast("string").startswith("-"), -near).otherwise(near)


def joined_set(value: Column, mark: str = "|") -> Column:
    """Aggregate: the sorted unlike values in one text, '' if there is none."""
    return F.coalesce(F.array_join(F.array_sort(F.collect_set(value)), mark), F.lit(""))


def utc(value: Column) -> Column:
    """An ISO text that must end in Z as a timestamp; null otherwise."""
    return F.when(value.endswith("Z"), F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
