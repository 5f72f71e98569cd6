"""A corpus, from documents to packed sequences, by five of the operators.

Every stage but the last takes and returns the columns of documents, whatever they
are called; doc_id, text and (for language ID) lang are needed, the others go along.
An empty table gives an empty table.  What each stage does with nulls, empty texts,
ties and repeated rows its docstring says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.llm import jaccard_join, language_id, packing, quality_rules, substring_dedup
from stormglass.llm.common import WORD_GAP, cut, drop, n_words

#: Language predictions that are less certain are rejected.
LEAST_CERTAIN = 0.5
#: Certified thresholds and a packing heuristic have no SQL form; tests/llm compares with plain Python.
ORACLE_SQL = None


def whole_row(docs: DataFrame) -> Column:
    """All columns in one named ``row``, so that no name of theirs can clash."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: not ``und``, and certain enough.

    Null and empty texts, and those without a letter, go; nulls in other columns do not
    matter; repeated rows stay or go together, and are kept as often as they are there.
    """
    predict = language_id.predictor(spark, language_id.fit(docs))
    found = docs.select(whole_row(docs), predict("text").alias("lang"))
    return found.filter((F.col("lang.lang_pred") != language_id.UND) & (F.col("lang.score") >= LEAST_CERTAIN)).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep.

    Null and empty texts have too few words and go; a ratio of just its cutoff stays; a
    null id has no label; repeated rows stay or go together, and teach as one.  Texts are
    counted once, and written with their counts.
    """
    counted = docs.select(whole_row(docs), F.xxhash64("text").alias("text_key"), quality_rules.count_columns("text").alias("n"))
    counted = cut(counted.select("row", "text_key", F.col("row.doc_id").cast("long").alias("doc_id"), "n.*"))
    cutoffs = quality_rules.learn_cutoffs(counted, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.verdicts(counted, cutoffs).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies.

    It is the one with the smallest id, a null id being the largest; of equal ids the text with the
    smaller hash; of repeated rows any one.  Texts are told apart by their content, not by their
    id.  Null and blank texts are like nothing and all stay.
    """
    found = cut(jaccard_join.similarity_classes(docs).select("doc_id", "text_key", "n_shingles", "component"))
    first = found.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("x"))
    keep = first.select(F.col("x.doc_id").alias("id"), F.col("x.text_key").alias("key"), F.lit(True).alias("single"))
    keep = keep.unionByName(found.filter("n_shingles = 0").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.lit(False).alias("single")).distinct())
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_key"))
    kept = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_key").eqNullSafe(F.col("key")))
    return kept.filter("single").dropDuplicates(["id", "key"]).select("row.*").unionByName(kept.filter("not single").select("row.*"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those with nothing left go.

    Rows with one id are no earlier than one another, null ids the last; null, empty and
    short texts stay as they are, and so do the columns but for text and n_chars.
    """
    changed = substring_dedup.dedup(docs).filter("n_removed > 0").select("doc_id", "words_sha256", "kept_text").dropDuplicates(["doc_id", "words_sha256"])
    words = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), WORD_GAP), lambda w: w != ""), " ")
    rows = docs.select(whole_row(docs), F.sha2(words, 256).alias("sha"))
    joined = rows.join(changed, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("words_sha256")), "left").filter("kept_text is null or kept_text <> ''")
    new = {"text": F.coalesce("kept_text", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, in bins of permitted lengths; a word counts as a token here.

    Null and empty texts give a row without a bin; repeated rows and rows without an id are packed like all others.
    """
    return packing.pack(docs.select("doc_id", n_words(F.col("text")).alias("n_tokens")))


STAGES = [
    ("language ID", languages),
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the whole result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir))
        drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
