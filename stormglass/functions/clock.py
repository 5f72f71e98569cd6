"""Instants in ISO 8601 texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms that are rewritten to the one with hyphens, a T, colons and a point: days and times without them, weeks, another separator, a comma before fractions.
_PLAIN_DAY, _WEEK = r"^(\d{4})(\d{2})(\d{2})(?=$|[^\d-])", r"^(\d{4})(-?)W(\d{2})(?:\2([1-7]))?(?=$|[^\d-])"
_PLAIN_TIME, _PLAIN_MINUTE, _COMMA = r"^(.{11}\d{2})(\d{2})(\d{2})(?!\d)", r"^(.{11}\d{2})(\d{2})(?=$|[+Z-])", r"^(.{11}\d{2}:\d{2}:\d{2}),(?=\d)"
_SEPARATOR = r"^(\d{4}-\d{2}-\d{2})[^T](?=\d{2})"
_OFFSET = r"[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?"
#: The commonest form, which needs no rewriting.
_WHOLE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:\d{2}|Z)$"
_ISO = rf"^\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}(:\d{{2}}(:\d{{2}}(\.\d+)?)?)?({_OFFSET}|Z)?)?$"


def _week_day(x: Column) -> Column:
    """The day of a text that starts with a year, a week and perhaps a day of it; null for a week that the year lacks."""
    part = lambda i: F.regexp_extract(x, _WEEK, i)
    fourth = F.make_date(part(1).try_cast("int"), F.lit(1), F.lit(4))
    week, day = part(3).try_cast("int"), F.coalesce(part(4).try_cast("int"), F.lit(1))
    found = F.date_add(F.date_sub(fourth, F.weekday(fourth)), ((week - 1) * 7 + day - 1).cast("int"))
    return F.when(F.weekofyear(found) == week, F.date_format(found, "yyyy-MM-dd"))


def _extended(x: Column) -> Column:
    weekly = F.when(F.regexp_like(x, F.lit(_WEEK)), F.concat(_week_day(x), F.regexp_replace(x, _WEEK, ""))).otherwise(x)
    out = F.regexp_replace(F.regexp_replace(weekly, _PLAIN_DAY, "$1-$2-$3"), _SEPARATOR, "$1T")
    out = F.regexp_replace(F.regexp_replace(out, _PLAIN_TIME, "$1:$2:$3"), _PLAIN_MINUTE, "$1:$2")
    return F.regexp_replace(out, _COMMA, "$1.")


def instant(x: Column) -> Column:
    """The instant of an ISO text, UTC where it names no zone; null for anything else."""
    # Rarer forms are bound as array elements: their expressions name them many times, and run only where the first gives null.
    rare = F.transform(F.transform(F.filter(F.array(x), lambda v: v.isNotNull()), _extended), _usual)
    whole = F.when(F.regexp_like(x, F.lit(_WHOLE)), F.try_to_timestamp(x))
    return F.coalesce(whole, _usual(x), F.get(rare, F.lit(0)))


def _usual(x: Column) -> Column:
    timed = F.when(F.length(x) == 10, F.concat(x, F.lit("T00:00:00"))).when(F.regexp_like(x, F.lit(r"^.{10}.\d{2}([+Z-].*)?$")), F.regexp_replace(x, r"^(.{10}.\d{2})", "$1:00:00")).when(F.regexp_like(x, F.lit(r"^.{10}.\d{2}:\d{2}([+Z-].*)?$")), F.regexp_replace(x, r"^(.{10}.\d{2}:\d{2})", "$1:00")).otherwise(x)
    zoned = F.when(F.regexp_like(timed, F.lit(f"({_OFFSET}|Z)$")) & (F.length(timed) > 10), F.regexp_replace(F.regexp_replace(F.regexp_replace(timed, "Z$", "+00:00"), r"([+-]\d{2})(\d{2})(\d{2})$", "$1:$2:$3"), r"([+-]\d{2})(\d{2})$", "$1:$2")).otherwise(F.concat(timed, F.lit("+00:00")))
    return F.when(F.regexp_like(x, F.lit(_ISO)), F.try_to_timestamp(zoned))
