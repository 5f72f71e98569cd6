"""Operator 1: toxicity by maximum-scoring segments.

Tokens are the words of the lower-cased text and their beginnings.  On a bounded
sample of labelled documents each token gets the log-odds of toxic against other
documents, under an informative Dirichlet prior (its share of both, plus one), and
its z-score; clearly toxic tokens make the lexicon.  A word scores as its most toxic
token, any other word costs ``GAP``.  One linear scan of a text finds all maximal
segments (Ruzzo and Tompa).  Under the scores' distribution in documents that are
not toxic, the best segment of n words exceeds S with an expected number of times
E = K * n * exp(-lambda * S) (Karlin and Altschul); each segment's normalised score
is lambda * S - ln(K * n), those above zero add up, and the extreme-value law turns
the sum x into the score exp(-ln 2 * exp(level - x)), one half at the level.  The level
is what tells the sample's toxic and other documents apart best (least sum of both error
rates), from the significance level SIGNIFICANCE upwards.

Cases: null and empty texts, and texts without a lexicon word, score 0; without
labels of both kinds the lexicon is empty; a label that is null or has no document
teaches nothing; a document with several labels is toxic if one says so; repeated
rows give repeated results; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, cut, documents, drop, id_remainder, slices

WORD = re.compile(r"[^\W_]+")
#: Labelled documents that the lexicon is learned from, of each label.
MAX_TOXIC, MAX_OTHER = 10_000, 80_000
#: Lengths of the beginnings of words that are tokens.
BEGINNINGS = (3, 4, 5)
#: A lexicon token occurs in so many toxic documents and has this z-score and log-odds at least.
LEAST_DOCS, LEAST_Z, LEAST_ODDS = 3, 3.5, 2.0
#: Weight of a token's share in its prior, and what a word outside the lexicon costs.
PRIOR, GAP = 100.0, 0.25
#: Evidence of a text without a segment, and the highest that is told apart when the level is chosen.
NONE, MOST = -99.0, 100.0
#: A text scores above one half only if so few texts have such passages by chance.
SIGNIFICANCE = 0.005


def tokens_of(words: set[str]) -> set[str]:
    """Words, and their beginnings marked by a caret."""
    out = set(words)
    for w in words:
        out.update(f"^{w[:n]}" for n in BEGINNINGS if len(w) > n)
    return out


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of tokens under the Dirichlet prior, and their z-scores."""
    prior = 1 + PRIOR * (toxic + other) / max(1.0, n_toxic + n_other)
    a, b = toxic + prior, other + prior
    delta = np.log(a / np.maximum(n_toxic + PRIOR - a, 1)) - np.log(b / np.maximum(n_other + PRIOR - b, 1))
    return delta, delta / np.sqrt(1 / a + 1 / b)


def segments(hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a text, in linear time.

    ``hits`` are the positions and scores of the words that score above zero, in order;
    every word between them costs GAP.
    """
    done: list[list[float]] = []  # first, last, score before, score after, nearest earlier one that starts lower
    total, end = 0.0, -1
    for at, score in hits:
        total -= GAP * (at - end - 1)
        before, total, end = total, total + score, at
        first, j = at, len(done) - 1
        # A link is followed once at most: what it passes over lies behind the link of the segment that is added.
        while j >= 0 and done[j][2] >= before:
            j = done[j][4]
        while j >= 0 and done[j][3] < total:
            first, _, before, _, link = done[j]
            del done[j:]
            j = link
        # Segments that start no lower than this one may yet join a later one.
        done.append([first, at, before, total, j])
    return [(int(a), int(b), after - before) for a, b, before, after, _ in done]


@dataclass
class Model:
    lexicon: dict[str, float]
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    level: float = -math.log(SIGNIFICANCE)
    seen: dict[str, float] = field(default_factory=dict)

    def word_score(self, word: str) -> float:
        """Above zero for a word of the lexicon, else zero."""
        score = self.seen.get(word)
        if score is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            found = self.lexicon.get
            score = max(found(word, 0.0), *(found(f"^{word[:n]}", 0.0) for n in BEGINNINGS if len(word) > n), 0.0)
            self.seen[word] = score
        return score

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments with their normalised scores, and the number of words."""
        words = words_of(text)
        score = self.word_score
        hits = [(i, s) for i, w in enumerate(words) if (s := score(w))]
        offset = math.log(self.scale * max(1, len(words)))
        return [(a, b, self.rate * s - offset) for a, b, s in segments(hits)], len(words)

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The score of a text and its significant passages, as word positions."""
        found, _ = self.passages(text)
        return (math.exp(-math.log(2) * math.exp(min(50.0, self.level - evidence(found)))) if found else 0.0), [x for x in found if x[2] > 0]


def evidence(found: list[tuple[int, int, float]]) -> float:
    """What a text's segments come to: the sum of those above zero, else the best; NONE without any."""
    strong = [s for *_, s in found if s > 0]
    return sum(strong) if strong else max((s for *_, s in found), default=NONE)


def best_level(tally: dict[tuple[int, float], int]) -> float:
    """The level, of the evidence seen (toxic, evidence: number of texts), with the least sum of error rates; of equals the lowest."""
    totals = [max(1, sum(n for (t, _), n in tally.items() if t == label)) for label in (0, 1)]
    least = -math.log(SIGNIFICANCE)
    levels = sorted({least, *(x for _, x in tally if x > least)})
    wrong = lambda level: sum(n / totals[t] for (t, x), n in tally.items() if (x >= level) != t)
    return min(levels, key=lambda level: (round(wrong(level), 12), level))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts (text, toxic) of a bounded sample of the labels; the sample is small enough to broadcast."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.withColumn("h", F.xxhash64("doc_id"))
    picked = marks.filter("toxic = 1").orderBy("h", "doc_id").limit(MAX_TOXIC).unionByName(marks.filter("toxic = 0").orderBy("h", "doc_id").limit(MAX_OTHER))
    return docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id").select("text", "toxic")


def count_tokens(rows: DataFrame, among: set[str] | None = None) -> DataFrame:
    """In how many of the rows (text) each token occurs; ``among`` limits the tokens. The token '' counts all."""
    sent = rows.sparkSession.sparkContext.broadcast(among) if among is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[str] = Counter()
        for (texts,) in slices(batches):
            for text in texts:
                found = tokens_of(set(words_of(text)))
                tally[""] += len(found)
                tally.update(found & sent.value if sent else found)
            if len(tally) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(tally)), pa.array(list(tally.values()), pa.int64())], names=["token", "n"])
                tally.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["token", "n"])

    return rows.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def karlin_altschul(scores: dict[float, int], n_words: int) -> float:
    """Lambda of word scores of the background: the positive root of sum p * exp(lambda * s) = 1."""
    values = np.array([-GAP, *scores], float)
    # One more sighting of the highest score keeps a background without any hit finite.
    counts = np.array([max(1, n_words - sum(scores.values())), *scores.values()], float)
    counts[int(values.argmax())] += 1
    p = counts / counts.sum()
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (low, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    rows = cut(labelled(docs, labels))
    try:
        return fit_sample(rows)
    finally:
        drop(rows)


def fit_sample(rows: DataFrame) -> Model:
    """Learn from a sample (text, toxic) that is written, as it is read four times."""
    toxic_rows, other_rows = rows.filter("toxic = 1"), rows.filter("toxic = 0")
    # Tokens of few toxic documents cannot be significant; what is left is bounded by the sample.
    toxic = {r["token"]: r["n"] for r in count_tokens(toxic_rows).filter(f"n >= {LEAST_DOCS}").collect()}
    other = {r["token"]: r["n"] for r in count_tokens(other_rows, set(toxic)).collect()}
    n_toxic, n_other = toxic.pop("", 0), other.pop("", 0)
    if not toxic or not n_other:
        return Model({})
    names = sorted(toxic)
    delta, z = log_odds(np.array([toxic[t] for t in names], float), np.array([other.get(t, 0) for t in names], float), n_toxic, n_other)
    model = Model({t: float(d) for t, d, s in zip(names, delta, z, strict=True) if s >= LEAST_Z and d >= LEAST_ODDS})
    if not model.lexicon:
        return model
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each score occurs among the words, to one decimal; -1 counts words, -2 segments."""
        tally: Counter[float] = Counter()
        for (texts,) in slices(batches):
            for text in texts:
                found = [s for w in words_of(text) if (s := sent.value.word_score(w))]
                tally.update(round(s, 1) for s in found)
                tally[-1.0] += len(words_of(text))
                tally[-2.0] += bool(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.float64()), pa.array(list(tally.values()), pa.int64())], names=["score", "n"])

    found = {r["score"]: r["n"] for r in other_rows.select("text").mapInArrow(background, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()}
    n_words, with_hit = found.pop(-1.0, 0), found.pop(-2.0, 0)
    top = max(model.lexicon.values())
    model.rate = karlin_altschul({top: 0} | found, n_words)
    # K from the documents with a segment: expected K * words * exp(-lambda * least score), plus one sighting.
    model.scale = min(1.0, (with_hit + 1) / max(1.0, n_words * math.exp(-model.rate * min([top, *found]))))
    fitted = rows.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many texts of each label have each evidence, to one decimal."""
        tally: Counter[tuple[int, float]] = Counter()
        for texts, labels_of in slices(batches):
            tally.update((t, round(min(MOST, evidence(fitted.value.passages(text)[0])), 1)) for text, t in zip(texts, labels_of, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in tally], pa.int32()), pa.array([x for _, x in tally], pa.float64()), pa.array(list(tally.values()), pa.int64())], names=["toxic", "evidence", "n"])

    tally = rows.select("text", "toxic").mapInArrow(weigh, "toxic int, evidence double, n long").groupBy("toxic", "evidence").agg(F.sum("n").alias("n"))
    model.level = best_level({(r["toxic"], r["evidence"]): r["n"] for r in tally.collect()})
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, score and passages (first and last word, normalised score) for each row of ``df``."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("weight", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", passage)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            found = [sent.value.judge(t) for t in texts]
            yield batch_of(schema, [ids, [s for s, _ in found], [[{"first": a, "last": b, "weight": w} for a, b, w in p] for _, p in found]])

    ddl = "doc_id long, score double, passages array<struct<first: long, last: long, weight: double>>"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(apply, ddl)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 5) == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.filter(~held_out(F.col("doc_id"))), labels.filter(~held_out(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES = {"op1_toxicity": op1_toxicity}
