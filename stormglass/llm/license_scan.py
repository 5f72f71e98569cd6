"""Operator 7: licence scan by canonical digests.

A text is normalised (case, punctuation, copyright lines, equivalent spellings,
white space) and its SHA-256 is joined with the digests of known licences that
are normalised alike.  Letters and digits of every script count.  Entire texts match,
however their lines are broken; so do entire lines, since documents carry short notices.
Everything is built-in functions, and each text is read and normalised once, line by line.
The known licences are the rows of licenses.jsonl: whole texts and customary notices.

A copyright line starts with "copyright" and a sign, a year or "by", with a sign and a year,
or is "all rights reserved" alone; it has to be a line of its own to be left out.

Cases: null, empty and merely copyright texts have no digest and match nothing;
repeated rows give repeated results; several licences with one digest are all
reported, in order; a null id is kept; other columns are ignored.
"""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents

#: The table of known licences: a line with its version, then lines of license (SPDX identifier), kind, source and text.
TABLE = "licenses.jsonl"


def _table() -> tuple[str, tuple[tuple[str, str], ...]]:
    first, *rows = map(json.loads, resources.files(__package__).joinpath(TABLE).read_text(encoding="utf-8").rstrip("\n").split("\n"))
    return first["version"], tuple((r["license"], r["text"]) for r in rows)


#: Whole standard texts and customary notices, by SPDX identifier.
VERSION, KNOWN = _table()
# Equivalent spellings, as words after folding case and punctuation.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("merchantability", "merchantibility"),
    ("acknowledgement", "acknowledgment"),
    ("noncommercial", "non commercial"),
    ("v", "version"),
)
# What separates words, and lines that name a holder only (both engines' regular expressions, on lower-case text).
SEPARATORS = r"[^\p{L}\p{M}\p{N}]+"
COPYRIGHT_LINE = r"^[ \t]*((copyright[ \t]+(\(c\)|©|[0-9]{4}|by )|(\(c\)|©)[ \t]*[0-9]{4}).*|all rights reserved[. \t\r]*)$"
#: The licence table is broadcast only up to this many rows; a larger one is shuffled.
BROADCAST_ROWS = 20_000


def _replace(x: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(x, F.lit(pattern), F.lit(to))


def line_forms(text: Column) -> Column:
    """The canonical forms of a text's lines: lower-case words with one space between; empty for copyright lines."""

    def form(line: Column) -> Column:
        x = _replace(line, COPYRIGHT_LINE, "")
        # Two spaces between words, so that neighbours do not share one.
        x = F.concat(F.lit("  "), _replace(x, SEPARATORS, "  "), F.lit("  "))
        for a, b in SPELLINGS:
            x = F.replace(x, F.lit(f" {a} "), F.lit(f" {b} "))
        return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))

    return F.transform(F.split(F.lower(text), "\n"), form)


def text_form(forms: Column) -> Column:
    """The canonical form of a text, from those of its lines."""
    return F.array_join(F.filter(forms, lambda x: x != ""), " ")


def digest(form: Column) -> Column:
    """SHA-256 of a canonical form; null if it is empty."""
    return F.when(form != "", F.sha2(form, 256))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "license string, text string")


def scan(df: DataFrame, licenses: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each row of ``df``: doc_id, text_digest, text_license, line_licenses and n_license_lines.

    ``licenses`` has a row (license, text) for each known text.  text_license and
    line_licenses are sorted distinct identifiers joined by commas, or null.
    """
    named = licenses.select("license", digest(text_form(line_forms(F.col("text")))).alias("digest")).filter("digest is not null").groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("license"))
    if licenses.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    # Digests are taken once, and stand for the texts from here on; lines go on as digests too.
    docs = df.select(F.col(id_col).alias("doc_id"), line_forms(F.col(text_col)).alias("forms"))
    docs = docs.select("doc_id", digest(text_form(F.col("forms"))).alias("text_digest"), F.transform(F.filter("forms", lambda x: x != ""), lambda x: F.sha2(x, 256)).alias("lines"))
    docs = cut(docs.withColumn("row_key", F.monotonically_increasing_id()))
    lines = docs.select("row_key", F.posexplode("lines").alias("line_no", "digest"))
    hits = (
        lines.join(named, "digest")
        .groupBy("row_key")
        .agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"), F.count_distinct("line_no").alias("n_license_lines"))
    )
    found = docs.drop("lines").join(named.withColumnsRenamed({"digest": "text_digest", "license": "text_license"}), "text_digest", "left").join(hits, "row_key", "left")
    return found.select("doc_id", "text_digest", "text_license", "line_licenses", F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), known_licenses(spark))


def _line_sql(x: str) -> str:
    form = f"('  ' || regexp_replace(regexp_replace({x}, '{COPYRIGHT_LINE}', ''), '{SEPARATORS}', '  ', 'g') || '  ')"
    for a, b in SPELLINGS:
        form = f"replace({form}, ' {a} ', ' {b} ')"
    return f"trim(replace({form}, '  ', ' '))"


def _text_sql(x: str) -> str:
    return f"nullif(array_to_string(list_filter(list_transform(string_split(lower({x}), chr(10)), lambda l: {_line_sql('l')}), lambda l: l <> ''), ' '), '')"


def _oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
    WITH known AS (SELECT sha256({_text_sql("t")}) AS digest, string_agg(DISTINCT license, ',' ORDER BY license) AS license FROM (VALUES {rows}) AS k(license, t) GROUP BY 1),
    docs AS (SELECT doc_id, text, sha256({_text_sql("text")}) AS text_digest FROM documents),
    lines AS (SELECT doc_id, sha256(nullif({_line_sql("line")}, '')) AS digest FROM (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line FROM documents)),
    hits AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n FROM lines JOIN known USING (digest) GROUP BY doc_id)
    SELECT d.doc_id, d.text_digest, k.license AS text_license, h.line_licenses, CAST(coalesce(h.n, 0) AS BIGINT) AS n_license_lines
    FROM docs d LEFT JOIN known k ON k.digest = d.text_digest LEFT JOIN hits h ON h.doc_id = d.doc_id
    """


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLE_SQL = {"op7_license_scan": _oracle()}
