"""Operator 9: quality rules whose cutoffs are certified on labelled holdouts.

Every rule rejects a document whose ratio exceeds a cutoff.  Cutoffs come from a
fixed grid.  On the labelled documents, and apart for each stratum (a band of
text lengths), cutoffs are tested from lenient to strict: one is certified if an
exact (Clopper-Pearson) upper bound of the share of good documents that it
rejects is within the rule's part of ``max_false_rejection``; the first that fails
ends the rule's sequence, so the sequence needs no correction of its own.  The
error level is divided by the number of rules and strata (Bonferroni), and the
tolerated share by the number of rules.  So, with confidence ``1 - error``, in no
stratum do the rules together reject more than ``max_false_rejection`` of the good
documents.  Of a rule's certified cutoffs the one is used that rejects the most bad
documents, a good one counting as ``GOOD_WEIGHT`` bad ones; a stratum in which
that is none has the rule switched off.

The bound needs independent trials, so equal texts are one trial, whatever their ids,
good only if all their labels say so, and an id with several texts is none.

Cases: a null or blank text has no words and fails the base rules; a label that is
null or has no document is ignored; a document with several labels counts as good
only if all say so; repeated rows give repeated results and change no cutoff; without
labels only the base rules act; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import batch_of, cut, documents, slices, words

SYMBOLS = re.compile(r"[#*$%&|<>]")
GAPS = re.compile(r"[\x20\x09-\x0D]")
#: Base rules: fewest words, and the share of words in repeated windows that is too much.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Upper ends of the bands of n_words that are the strata.
BANDS = (100, 300, 1000)
#: Candidate cutoffs, the same for all rules.
GRID = tuple(round(0.01 * i, 2) for i in range(1, 100))
MAX_FALSE_REJECTION, ERROR, GOOD_WEIGHT = 0.05, 0.05, 20

COUNTS = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words")])


def counts_of(text: str | None) -> tuple[int, ...]:
    """The columns of COUNTS after doc_id, for one text."""
    tokens = words(text)
    n = len(tokens)
    if not n:
        return (0, 0, len(SYMBOLS.findall(text or "")), 0, 0, 0, 0)
    lines = [x for x in text.split("\n") if GAPS.sub("", x)] if "\n" in text else [text]
    windows = list(zip(tokens, tokens[1:], tokens[2:], strict=False))
    repeated = 0
    if len(seen := set(windows)) < len(windows):
        often = {w for w, k in Counter(windows).items() if k > 1}
        covered = -1  # the last word that is counted
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    del seen
    return (n, len(text) - len(GAPS.findall(text)), len(SYMBOLS.findall(text)), len(lines), len(lines) - len(set(lines)), repeated, len(set(tokens)))


def text_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of COUNTS for each row of ``df``, from the whole text, and text_key, its xxhash64."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = COUNTS.append(pa.field("text_key", pa.int64()))
        for ids, texts, keys in slices(batches):
            yield batch_of(schema, [ids, *zip(*map(counts_of, texts), strict=True), keys])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col))
    return docs.mapInArrow(count, ", ".join(f"{c} long" for c in (*COUNTS.names, "text_key")))


@F.pandas_udf(StructType([StructField(c, LongType()) for c in COUNTS.names[1:]]))
def count_columns(texts: pd.Series) -> pd.DataFrame:
    """The columns of COUNTS after doc_id, as a struct, for filters that keep whole rows."""
    return pd.DataFrame([counts_of(t) for t in texts], columns=COUNTS.names[1:])


def ratios() -> dict[str, Column]:
    """The rules: name and the ratio that must not exceed its cutoff."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "few_words": F.lit(1.0) - share("n_distinct_words", "n_words"),
    }


def stratum() -> Column:
    return sum((F.when(F.col("n_words") > b, 1).otherwise(0) for b in BANDS), F.lit(0))


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the largest p for which k or fewer of n would have a chance of at least ``error``."""
    if n == 0 or k >= n:
        return 1.0
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    i = np.arange(k + 1)
    choose = logs[n] - logs[i] - logs[n - i]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = choose + i * np.log(p) + (n - i) * np.log1p(-p)
        tail = np.exp(terms - terms.max()).sum() * np.exp(terms.max())
        low, high = (p, high) if tail >= error else (low, p)
    return high


def certified(good: dict[tuple[int, str], list[int]], bad: dict[tuple[int, str], list[int]], max_false_rejection: float = MAX_FALSE_REJECTION, error: float = ERROR) -> dict[tuple[int, str], float]:
    """The cutoff to use of each (stratum, rule), if one is certified.

    ``good`` and ``bad`` have, for each of them, how many documents of that label have
    a ratio that just the first j cutoffs of GRID reject, for j from 0.
    """
    names = list(ratios())
    level = error / (len(names) * (len(BANDS) + 1))
    out = {}
    for (band, rule), tally in good.items():
        worse = bad.get((band, rule), [0] * len(tally))
        best = 0
        for j in range(len(GRID) - 1, -1, -1):
            k = sum(tally[j + 1 :])
            if upper_bound(k, sum(tally), level) > max_false_rejection / len(names):
                break
            if (gain := sum(worse[j + 1 :]) - GOOD_WEIGHT * k) > best:
                best, out[band, rule] = gain, GRID[j]
    return out


def learn_cutoffs(counts: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, error: float = ERROR) -> dict[tuple[int, str], float]:
    """Certify cutoffs on the documents of ``counts`` (with text_key) that ``labels`` (doc_id, quality) has.

    Only documents that pass the base rules count, and equal texts count once.  The driver gets one number for each
    stratum, rule, cutoff and label, however many documents there are.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    held = counts.filter(~base_failed()).select("doc_id", F.struct("text_key", stratum().alias("band"), *(F.ceil(x * 100).alias(name) for name, x in ratios().items())).alias("trial")).join(marks, "doc_id")
    one = held.groupBy("doc_id").agg(F.min("trial").alias("trial"), F.max("trial.text_key").alias("last"), F.min("good").alias("good")).filter("trial.text_key = last")
    held = one.groupBy("trial").agg(F.min("good").alias("good")).select("trial.*", "good")
    # The cutoffs below a ratio, which reject it, are a prefix of the grid.
    below = lambda x: F.least(F.greatest(x - 1, F.lit(0)), F.lit(len(GRID))).cast("int")
    cells = held.select("band", "good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), below(F.col(r)).alias("j")) for r in ratios()))).alias("x"))
    tallies: dict[bool, dict[tuple[int, str], list[int]]] = {True: {}, False: {}}
    for band, is_good, rule, j, k in cells.groupBy("band", "good", "x.rule", "x.j").count().collect():
        tallies[is_good].setdefault((band, rule), [0] * (len(GRID) + 1))[j] += k
    return certified(tallies[True], tallies[False], max_false_rejection, error)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def verdicts(counts: DataFrame, cutoffs: dict[tuple[int, str], float]) -> DataFrame:
    """``counts`` with base_failed and kept."""
    rejected = F.lit(False)
    for (band, rule), cutoff in sorted(cutoffs.items()):
        # In hundredths, as in learn_cutoffs: a ratio of just the cutoff is kept.
        rejected = rejected | ((stratum() == band) & (F.ceil(ratios()[rule] * 100) > round(cutoff * 100)))
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejected)


def judge(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts, base_failed and kept for each row of ``df``."""
    counts = cut(text_counts(df, text_col, id_col))
    return verdicts(counts, learn_cutoffs(counts, labels))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op9_quality_rules": op9_quality_rules}
