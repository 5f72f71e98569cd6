"""Operator 2: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams of the lower-cased text.
Document frequencies cover all training rows.  Weights are fitted with
follow-the-regularised-leader (per coordinate, L1 and L2 penalties, so most stay
zero) on a bounded, language-balanced sample of ``MAX_TRAIN`` training rows, and
probabilities are calibrated with one temperature, fitted on a part of the sample
that the weights have not seen.

Cases: null texts and texts without a letter are ``und`` with score 0; without any
training row all are; rows with a null label or text teach nothing; repeated rows
give repeated results; null ids are kept (and never held out); other columns are
ignored; equal probabilities go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, documents, id_remainder, slices

#: Bits of the n-gram hash, longest n-gram, rows that the weights are fitted on, and fewest of a language.
BITS, LONGEST, MAX_TRAIN, LEAST_ROWS = 16, 3, 4_000, 5
BUCKETS = 2**BITS
#: Languages that weights of all bits are learned for; twice as many take one bit less, so that the model stays of one size.
FULL_LANGS = 200
#: More labels than this are an error in the labels, and raise one.
MAX_LANGS = 5_000
#: Learning rate and smoothing of FTRL, penalties, passes over the sample, share that fits the temperature.
ALPHA, BETA, L1, L2, EPOCHS, CALIBRATION = 0.5, 1.0, 0.02, 0.01, 2, 0.2
UND = "und"

_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def bits_for(n_langs: int) -> int:
    return max(8, BITS - max(0, -(-n_langs // FULL_LANGS) - 1).bit_length())


def ngram_counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur, and how often, for the n-grams of a whole text."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(code), np.uint32)
    total = np.zeros(2**bits, np.int64)
    for n in range(1, LONGEST + 1):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * _ODD[n - 1]
        h ^= h >> np.uint32(15)
        total += np.bincount((h * _ODD[0] >> np.uint32(32 - bits)).astype(np.int64), minlength=2**bits)
    at = np.flatnonzero(total)
    return at, total[at]


def weighted(at: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length."""
    x = (1 + np.log(times)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for a softmax over ``k`` classes; one extra coordinate is the bias."""

    def __init__(self, k: int, buckets: int = BUCKETS) -> None:
        self.z, self.n = np.zeros((2, buckets + 1, k), np.float32 if k > 64 else np.float64)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = np.outer(x, p)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    bits: int = BITS

    def logits(self, text: str) -> np.ndarray:
        at, times = ngram_counts(text, self.bits)
        x = weighted(at, times, self.idf)
        return x @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UND, 0.0
        p = softmax(self.logits(text).astype(np.float64) / self.temperature)
        i = int(p.argmax())
        return self.langs[i], float(p[i])


def document_frequencies(texts: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many of the rows (text) each bucket occurs; the driver gets a number for each bucket at most."""
    buckets = 2**bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(buckets, np.int64), 0
        for (part,) in slices(batches):
            for text in part:
                total[ngram_counts(text, bits)[0]] += 1
                rows += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, buckets)), pa.array(np.append(total[at], rows))], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(buckets + 1, np.int64)
    df[found["bucket"]] = found["n"]
    return df[:buckets], int(df[buckets])


def fit(rows: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learn all labels of ``rows`` (doc_id, text, lang).

    ``max_train`` bounds the rows of the sample, but for LEAST_ROWS of each language.
    """
    rows = rows.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} labels: these are no languages")
    langs = sorted(sizes)
    bits = bits_for(len(langs))
    if not langs:
        return Model([], np.zeros(2**bits), np.zeros((2**bits + 1, 0)), 1.0)
    df, n = document_frequencies(rows, bits)
    idf = np.log((1 + n) / (1 + df)) + 1
    # Every language gives about as many rows, chosen by a hash of the id.
    max_train = max(max_train, LEAST_ROWS * len(langs))
    each = max_train / len(langs)
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, 1.5 * each / sizes[lang])) for lang in langs], "lang string, chance double")
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("train")), F.lit(2**20)) / 2**20
    sample = rows.join(F.broadcast(shares), "lang").withColumn("draw", draw / F.col("chance")).filter("draw < 1").orderBy("draw").limit(max_train)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
        for names, texts in slices(batches):
            found = [ngram_counts(t, bits) for t in texts]
            yield batch_of(schema, [names, [a.astype(np.int32) for a, _ in found], [t.astype(np.int32) for _, t in found]])

    data = sample.select("lang", "text").repartition(8).mapInArrow(featurise, "lang string, at array<int>, times array<int>").toPandas()
    examples = [((at := np.asarray(a, np.int32)), weighted(at, np.asarray(t, np.int32), idf).astype(np.float32), langs.index(lang)) for lang, a, t in zip(data["lang"], data["at"], data["times"], strict=True)]
    del data
    order = np.random.default_rng(0).permutation(len(examples))
    held, seen = np.split(order, [int(CALIBRATION * len(order))])
    model = Ftrl(len(langs), 2**bits)
    for _ in range(EPOCHS):
        for i in seen:
            model.learn(*examples[i])
    w = model.weights(slice(None))
    logits = np.array([x @ w[at] + w[-1] for at, x, _ in (examples[i] for i in held)]).reshape(-1, len(langs))
    answers = np.array([examples[i][2] for i in held], int)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 120))
    loss = [-np.log(softmax(logits / t)[np.arange(len(answers)), answers] + 1e-12).mean() if len(answers) else abs(np.log(t)) for t in grid]
    return Model(langs, idf, w.astype(np.float32), float(grid[int(np.argmin(loss))]), bits)


def predict(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score for each row of ``df``.

    The model is broadcast; it has some BUCKETS * FULL_LANGS weights at most, whatever the corpus.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            yield batch_of(schema, [ids, *zip(*map(sent.value.predict, texts), strict=True)])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(apply, "doc_id long, lang_pred string, score double")


def predictor(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function of a text column: struct(lang_pred, score), for filters that keep whole rows."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def apply(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return apply


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 4) == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, fit(docs.filter(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
