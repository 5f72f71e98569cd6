"""Text columns: trimming, limits, codes and the parts of warning documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims


def text_of(x: Column) -> Column:
    """A missing text is an empty one."""
    return F.coalesce(x, F.lit(""))


def strip(x: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def language_prefix(x: Column) -> Column:
    """What stands before the first hyphen, in lower case."""
    return F.lower(F.substring_index(text_of(x), "-", 1))


def vtec_field(vtec: Column, field: str) -> Column:
    """A field of a VTEC string, empty if it does not start with one."""
    return F.regexp_extract(text_of(vtec), dims.VTEC, dims.VTEC_FIELDS.index(field) + 1)


def zone_codes(uris: Column) -> Column:
    """Last path segments of zone URIs in upper case, without empty ones."""
    return F.filter(F.transform(uris, lambda u: F.upper(F.substring_index(u, "/", -1))), lambda c: c != "")


def category_value(terms: Column, key: str) -> Column:
    """The value of the last ``key=value`` term, split at its first equals sign; empty if there is none."""
    pairs = F.transform(F.filter(terms, lambda t: F.contains(t, F.lit("="))), lambda t: F.struct(strip(F.substring_index(t, "=", 1)).alias("k"), strip(F.regexp_replace(t, r"^[^=]*=", "")).alias("v")))
    return text_of(F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"])


def flatten_parameters(parameters: Column) -> Column:
    """Map of name to a one-element list from structs (valueName, value).

    Values of a repeated name are joined by "; ", but an empty value so far is
    replaced; nameless ones are left out; null if there is none.
    """
    named = F.filter(F.coalesce(parameters, F.array()), lambda p: text_of(p["valueName"]) != "")
    names = F.array_distinct(F.transform(named, lambda p: p["valueName"]))
    fold = lambda name: F.aggregate(F.filter(named, lambda p: p["valueName"] == name), F.lit(""), lambda a, p: F.when(a == "", text_of(p["value"])).otherwise(F.concat(a, F.lit("; "), text_of(p["value"]))))
    entries = F.transform(names, lambda name: F.struct(name.alias("key"), F.array(fold(name)).alias("value")))
    return F.when(F.size(names) > 0, F.map_from_entries(entries))


def join_areas(areas: Column) -> Column:
    """Distinct non-empty areaDesc texts in their first order, joined by a comma."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.coalesce(areas, F.array()), lambda a: text_of(a["areaDesc"])), lambda d: d != "")), ", ")


def emma_codes(areas: Column) -> Column:
    """Distinct non-empty EMMA_ID values of all areas in their first order."""
    codes = F.flatten(F.transform(F.coalesce(areas, F.array()), lambda a: F.transform(F.filter(F.coalesce(a["geocode"], F.array()), lambda g: g["valueName"] == "EMMA_ID"), lambda g: text_of(g["value"]))))
    return F.array_distinct(F.filter(codes, lambda c: c != ""))


def first_of(x: Column) -> Column:
    """A field that is text or a JSON list of texts: the text, or the list's first."""
    return F.when(F.startswith(x, F.lit("[")), text_of(F.get(F.from_json(x, "array<string>"), F.lit(0)))).otherwise(text_of(x))


def list_of(x: Column) -> Column:
    """A field that is text or a JSON list of texts, as a list; empty if it is missing."""
    return F.when(F.startswith(x, F.lit("[")), F.from_json(x, "array<string>")).when(x.isNotNull(), F.array(x)).otherwise(F.array().cast("array<string>"))


def byte_cap(x: Column, limit: int = dims.TEXT_LIMIT_BYTES) -> Column:
    """Texts of more than ``limit`` UTF-8 bytes are cut at a character and end in an ellipsis, within the limit."""
    raw = x.cast("binary")
    # A character has four bytes at most, so one of four cuts lies between characters.
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(limit - 3, limit - 7, -1)]
    return F.when(F.octet_length(x) > limit, F.concat(F.coalesce(*cuts), F.lit("…"))).otherwise(x)


def character_cap(x: Column, limit: int = dims.STATE_LIMIT_CHARS) -> Column:
    """Texts of more than ``limit`` characters end in an ellipsis within it."""
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - 1), F.lit("…"))).otherwise(x)


def slug(x: Column) -> Column:
    """Lower-case letters and digits with underscores between."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
