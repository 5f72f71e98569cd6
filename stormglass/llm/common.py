"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the five control characters from tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows that Python helpers look at together; bounds what a worker holds beside its Arrow batch.
SLICE_ROWS = 128
#: Row groups of intermediate tables; bounds what a writer holds.
ROW_GROUP_BYTES = 16 * 2**20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and read it from there.

    That cuts lineage as checkpoint() does, in compressed columns, of which later steps read
    what they need.  ``drop`` removes a table that nothing needs any more; the rest of the
    folder is the cluster's to clear.  It is the cluster's ``spark.checkpoint.dir``; where
    that is unset, a temporary folder serves a local master only.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stormglass-"))
    path = f"{sc.getCheckpointDir().rstrip('/')}/cut-{uuid.uuid4()}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` has written, once all that is computed from them is written too; others are left alone."""
    for table in tables:
        if "cut_path" not in vars(table):
            continue
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % mod


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null and blank texts."""
    return F.coalesce(F.size(F.filter(F.split(text, WORD_GAP), lambda w: w != "")), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8.  ``bytes.split`` parts at exactly the characters of WORD_GAP."""
    return text.encode("utf-8").split() if text else []


def lower_ascii(text: str | None) -> list[bytes]:
    """As ``words``, with A-Z lower-cased and nothing else (``bytes.lower`` does just that)."""
    return text.encode("utf-8").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately."""

    def __init__(self, seed: int = 0, limit: int = 200_000) -> None:
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly (the finaliser of splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of all runs of k consecutive words, in time linear in the text."""

    def __init__(self, base: int = 0xD6E8FEB86659FD93) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(0, np.uint64)

    def powers(self, n: int) -> None:
        if n > len(self.up):
            n = max(2 * n, 4096)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def of(self, hashes: np.ndarray, k: int) -> np.ndarray:
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.uint64)
        self.powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.up[:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * self.down[: n - k + 1], k)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of a few rows at a time as Python lists, so that memory stays bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield [c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns]


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
