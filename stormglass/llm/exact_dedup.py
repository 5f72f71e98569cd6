"""Operator 13: exact dedup by composable polynomial fingerprints.

A text is a polynomial over its bytes, taken modulo four primes below 2**31: 124 bits.  Chunks of
CHUNK bytes are hashed each for itself; the fingerprint of ``a`` before ``b`` is that of ``a`` times
base**len(b) plus that of ``b``, so chunks need not be seen in order, nor by one task.  Texts of at
most SEGMENT bytes are combined where they are read.  Longer ones are cut into segments, which
are dealt to all tasks; each is shifted by the length of what follows it, and a sum by text adds them up.

Texts of equal fingerprint and length are then compared byte by byte, a chunk at a time: chunks
of one place stream through a minimum and a maximum, which tasks reduce before anything is
shuffled, so a group of copies costs one task no more than two chunks a place.  The texts of a group
are equal if both agree everywhere.  If they do not, fingerprints have collided, and the rows of
that fingerprint are grouped by whole texts instead.  Which texts have a fingerprint that
is there more than once a sketch of bounded size tells (it may say so of others too: these are compared in vain).

Cases: a null text is an empty one, and all of them are equal; a null id is the smallest, and keep_id is null
where a group has no other; of repeated rows with the id that stays, one is kept; an empty
table gives an empty one; very long texts are cut as told; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, cut, documents
from .sketch import Cells, count_keys

#: Moduli and bases of the four polynomials.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1000003579, 1300000411, 1700000009, 2000000089)
#: Bytes hashed by one product of matrices: 2**14 bytes of 8 bits times powers of 31 bits stay below 2**53, so doubles are exact.
CHUNK = 2**14
#: Bytes of a segment of a long text.
SEGMENT = 2**20
#: Chunks that a task sends on together; numbers of repeated rows that are written out together.
HELD_CHUNKS, RUN = 256, 2**16
#: Cells a row of the sketch of repeated fingerprints, and its rows.
LOG2_CELLS, DEPTH = 25, 2
PRINT = ["n_bytes", "hi", "lo"]


class Polynomial:
    """Fingerprints of byte arrays: four residues each."""

    def __init__(self, primes: tuple[int, ...] = PRIMES) -> None:
        self.primes = primes
        powers = np.ones((CHUNK, len(primes)), np.float64)
        for j, (p, b) in enumerate(zip(primes, BASES, strict=True)):
            x = 1
            for i in range(CHUNK - 1, -1, -1):
                powers[i, j] = x
                x = x * b % p
        self.powers = powers
        self.whole = self.shift(CHUNK)

    def shift(self, n: int) -> list[int]:
        """What residues are multiplied by if ``n`` bytes follow."""
        return [pow(b, n, p) for p, b in zip(self.primes, BASES, strict=True)]

    def joined(self, a: list[int], b: list[int], shift: list[int]) -> list[int]:
        """The residues of two neighbours, the second of which is as long as ``shift`` says."""
        return [(x * s + y) % p for x, y, s, p in zip(a, b, shift, self.primes, strict=True)]

    def chunk(self, data: np.ndarray) -> list[int]:
        return [int(x) % p for x, p in zip(data.astype(np.float64) @ self.powers[CHUNK - len(data) :], self.primes, strict=True)]

    def of(self, data: np.ndarray) -> list[int]:
        out = self.chunk(data[:CHUNK])
        for at in range(CHUNK, len(data), CHUNK):
            part = data[at : at + CHUNK]
            out = self.joined(out, self.chunk(part), self.whole if len(part) == CHUNK else self.shift(len(part)))
        return out


def _bytes_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The values of a binary column as they lie in its buffer."""
    if not len(column):
        return
    sizes = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        yield data[a:b]


def _packed(residues: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    r = np.array(residues, np.int64).reshape(-1, 4)
    return r[:, 0] << 31 | r[:, 1], r[:, 2] << 31 | r[:, 3]


def _texts(df: DataFrame, text_col: str, id_col: str, normalise: Callable[[Column], Column] | None) -> DataFrame:
    text = F.col(f"`{text_col}`")
    body = F.coalesce(normalise(text) if normalise else text, F.lit("")).cast("binary")
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), body.alias("body")).withColumn("n_bytes", F.octet_length("body").cast("long"))


def _segments(long: DataFrame) -> DataFrame:
    """address, n_bytes, at and segment of texts longer than a segment; equal texts have one address."""
    numbers = F.sequence(F.lit(0), F.floor((F.col("n_bytes") - 1) / SEGMENT).cast("int"))
    cuts = F.transform(numbers, lambda i: F.struct(i.alias("at"), F.substring("body", i * SEGMENT + 1, F.lit(SEGMENT)).alias("segment")))
    return long.select(F.xxhash64("body").alias("address"), "n_bytes", F.explode(cuts).alias("s")).select("address", "n_bytes", "s.at", "s.segment")


def _long_prints(segments: DataFrame, primes: tuple[int, ...]) -> DataFrame:
    """address, n_bytes, hi and lo: segments are hashed by all tasks, shifted by what follows each, and added up."""

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(primes)
        schema = pa.schema([("address", pa.int64()), ("n_bytes", pa.int64()), ("at", pa.int32()), *((f"r{j}", pa.int64()) for j in range(4))])
        for batch in batches:
            address, n_bytes, at = (batch.column(i).to_pylist() for i in range(3))
            terms = [poly.joined(poly.of(data), [0] * 4, poly.shift(n - k * SEGMENT - len(data))) for n, k, data in zip(n_bytes, at, _bytes_of(batch.column(3)), strict=True)]
            yield batch_of(schema, [address, n_bytes, at, *zip(*terms, strict=True)]) if terms else batch_of(schema, [[]] * 7)

    hashed = segments.hint("rebalance").mapInArrow(shifted, "address long, n_bytes long, at int, r0 long, r1 long, r2 long, r3 long")
    # Copies bring the same term again: one of each place is added.
    once = hashed.groupBy("address", "n_bytes", "at").agg(*(F.min(f"r{j}").alias(f"r{j}") for j in range(4)))
    total = [F.sum(f"r{j}") % p for j, p in enumerate(primes)]
    hi, lo = (F.shiftleft(total[j].cast("long"), 31).bitwiseOR(total[j + 1].cast("long")) for j in (0, 2))
    return once.groupBy("address", "n_bytes").agg(hi.alias("hi"), lo.alias("lo"))


def fingerprints(texts: DataFrame, primes: tuple[int, ...] = PRIMES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_bytes, hi, lo, sha) of each row, and (address, n_bytes, hi, lo) of the long texts."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(primes)
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sha", pa.string())])
        for batch in batches:
            residues, shas = [], []
            for data in _bytes_of(batch.column(2)):
                residues.append(poly.of(data))
                shas.append(hashlib.sha256(data).hexdigest())
            yield batch_of(schema, [batch.column(0), batch.column(1), *_packed(residues), shas])

    columns = "doc_id long, n_bytes long, hi long, lo long, sha string"
    own = texts.filter(F.col("n_bytes") <= SEGMENT).select("doc_id", "n_bytes", "body").mapInArrow(short, columns)
    long = texts.filter(F.col("n_bytes") > SEGMENT)
    prints = cut(_long_prints(_segments(long), primes))
    named = long.select("doc_id", "n_bytes", F.xxhash64("body").alias("address"), F.sha2("body", 256).alias("sha"))
    return cut(own.unionByName(named.join(prints, ["address", "n_bytes"]).select("doc_id", *PRINT, "sha"))), prints


def collisions(texts: DataFrame, prints: DataFrame, repeated: Cells, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """n_bytes, hi and lo of the fingerprints whose texts are not all equal, by comparing chunk by chunk."""
    seen = texts.sparkSession.sparkContext.broadcast(repeated)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(primes)
        schema = pa.schema([("n_bytes", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("at", pa.int32()), ("chunk", pa.binary())])
        for batch in batches:
            bodies = list(_bytes_of(batch.column(1)))
            hi, lo = _packed([poly.of(data) for data in bodies])
            held = []
            for i in np.flatnonzero(seen.value.maybe(lo.view(np.uint64))):
                held += [(len(bodies[i]), hi[i], lo[i], at // CHUNK, bodies[i][at : at + CHUNK].tobytes()) for at in range(0, len(bodies[i]), CHUNK)]
                if len(held) >= HELD_CHUNKS:
                    yield batch_of(schema, list(zip(*held, strict=True)))
                    held = []
            if held:
                yield batch_of(schema, list(zip(*held, strict=True)))

    own = texts.filter(F.col("n_bytes") <= SEGMENT).select("n_bytes", "body").mapInArrow(chunks, "n_bytes long, hi long, lo long, at int, chunk binary")
    ends = [F.min("chunk").alias("least"), F.max("chunk").alias("most")]
    own = own.groupBy(*PRINT, "at").agg(*ends)
    long = _segments(texts.filter(F.col("n_bytes") > SEGMENT)).withColumnRenamed("segment", "chunk").groupBy("address", "n_bytes", "at").agg(*ends)
    long = long.join(prints, ["address", "n_bytes"]).groupBy(*PRINT, "at").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return own.unionByName(long).filter("least <> most").select(*PRINT).distinct()


def _by_whole_text(texts: DataFrame, prints: DataFrame, bad: DataFrame, primes: tuple[int, ...]) -> DataFrame:
    """doc_id, sha and the group (n_rows, keep_id) of each row whose fingerprint has collided."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(primes)
        for batch in batches:
            hi, lo = _packed([poly.of(data) for data in _bytes_of(batch.column(2))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hi), pa.array(lo)], names=["doc_id", "n_bytes", "body", "hi", "lo"])

    own = texts.filter(F.col("n_bytes") <= SEGMENT).select("doc_id", "n_bytes", "body").mapInArrow(named, "doc_id long, n_bytes long, body binary, hi long, lo long")
    long = texts.filter(F.col("n_bytes") > SEGMENT).withColumn("address", F.xxhash64("body")).join(prints, ["address", "n_bytes"]).select(*own.columns)
    # Rows of one id and text are counted first, so a large group of copies is a few rows.
    counted = own.unionByName(long).join(bad, PRINT, "left_semi").groupBy("body", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    counted = cut(counted)
    groups = counted.groupBy("body").agg(F.sum("n").alias("n_rows"), F.max("doc_id").alias("keep_id"))
    return counted.join(groups, "body").select("doc_id", "n", F.sha2("body", 256).alias("sha"), "n_rows", "keep_id")


def dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", normalise: Callable[[Column], Column] | None = None, log2_cells: int = LOG2_CELLS, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of ``df``; of equal texts, after ``normalise``, the largest id stays."""
    texts = _texts(df, text_col, id_col, normalise)
    rows, prints = fingerprints(texts, primes)
    counted = rows.groupBy(*PRINT, "doc_id", "sha").agg(F.count(F.lit(1)).alias("n"))
    groups = cut(rows.groupBy(*PRINT).agg(F.count(F.lit(1)).alias("n_rows"), F.max("doc_id").alias("keep_id")).filter("n_rows > 1"))
    repeated = count_keys(groups.select("lo"), lambda: lambda x: np.array([x], np.int64).view(np.uint64), log2_cells, DEPTH, least=1)
    bad = cut(collisions(texts, prints, repeated, primes))
    fine = counted.join(groups, PRINT, "left").select("doc_id", "n", "sha", F.coalesce("n_rows", F.lit(1)).alias("n_rows"), F.when(F.col("n_rows").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), *PRINT)
    if not bad.isEmpty():
        fine = fine.join(bad, PRINT, "left_anti").drop(*PRINT).unionByName(_by_whole_text(texts, prints, bad, primes))
    # Rows of one id and text come out as often as they came in, by runs, so that no array of them grows.
    runs = fine.select("doc_id", "keep_id", "n", F.col("n_rows").cast("long").alias("group_size"), F.col("sha").alias("text_sha256"), F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"), F.lit(RUN).cast("long"))).alias("begin"))
    each = runs.select("*", F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + RUN, F.col("n")) - 1)).alias("nth"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


#: Equal texts are grouped as such; of rows with the id that stays, one is kept.
ORACLE_SQL = {
    "op13_exact_dedup": """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
        (doc_id IS NOT DISTINCT FROM max(doc_id) OVER w) AND row_number() OVER (PARTITION BY body, doc_id) = 1 AS kept, sha256(body) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY body)
    """
}
QUERIES = {"op13_exact_dedup": op13_exact_dedup}
