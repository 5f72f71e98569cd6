"""Operator 5: byte-level BPE encoding and decoding, by overlapping chunks.

A text longer than a chunk is cut into overlapping chunks, which executors
pre-tokenise apart from each other.  Chunk 0 starts at a true boundary, so all
its boundaries are true; a later chunk starts anywhere, but once one of its
boundaries meets a true one, all that follow are true, because the pattern only
looks ahead.  Chunks are stitched at the first boundary that both neighbours have
in their overlap, and the pieces between the stitches are encoded.  Chunks are written
once; only boundaries are brought together by text, so that one very long text stays
the work of many tasks until its ids are put in a row.  A text with a
seam that never resynchronises (a run of one character class that is longer than
the overlap) is encoded in one piece.

Cases: a null or empty text has no ids and decodes to no bytes; repeated rows give
repeated results; a null id is kept; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, cut, documents, slices

#: Characters of a chunk, and characters that neighbours have in common.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 2_048
#: A boundary this near to a chunk's end may depend on characters that the chunk lacks.
LOOKAHEAD = 4
#: Texts that a worker holds in encoded form at a time.
CODE_ROWS = 64

CHUNKS = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.string()), ("n", pa.int64()), ("chunk", pa.int64()), ("text", pa.string())])
BOUNDS = pa.schema([("doc_key", pa.string()), ("chunk", pa.int64()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])


@cache
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks_of(text: str, chunk_chars: int, overlap_chars: int) -> list[str]:
    """Pieces that start every ``chunk_chars`` characters and reach ``overlap_chars`` into the next one."""
    n = max(1, -(-max(0, len(text) - overlap_chars) // chunk_chars))
    return [text[i * chunk_chars : (i + 1) * chunk_chars + overlap_chars] for i in range(n)]


def seam_bounds(text: str, chunk: int, last: bool, pattern: regex.Pattern, chunk_chars: int, overlap_chars: int) -> tuple[list[int], list[int]]:
    """Pre-token boundaries of a chunk in the two overlaps, as offsets in the document."""
    ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
    if not last:
        ends = ends[ends <= len(text) - LOOKAHEAD]
    head = ends[ends < overlap_chars] if chunk else ends[:0]
    tail = ends[ends >= chunk_chars] if not last else ends[:0]
    return (head + chunk * chunk_chars).tolist(), (tail + chunk * chunk_chars).tolist()


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row (doc_id, ids) for each row of ``df``; ids are those of tiktoken's encode_ordinary.

    ``ranks_path`` and ``pattern`` name the vocabulary; every executor reads it from that path.
    """
    return round_trip(df, ranks_path, pattern, text_col, id_col, chunk_chars, overlap_chars).drop("decoded")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """As ``encode``, with a column decoded: the bytes that the ids stand for, by the same Python worker."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk_chars + overlap_chars

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last column's texts become ids and decoded bytes; columns before it stay."""
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, CODE_ROWS):
                part = batch.slice(at, CODE_ROWS)
                ids = [enc.encode_to_numpy(t, disallowed_special=()).astype(np.int32) for t in part.columns[-1].to_pylist()]
                raw = [enc.decode_bytes(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array(raw, pa.binary())], names=[*part.schema.names[:-1], "ids", "decoded"])

    coded = ", ids array<int>, decoded binary"
    short = docs.filter(~is_long).mapInArrow(code, f"doc_id long{coded}")

    def to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            for doc_id, text, key, n in zip(*rows, strict=True):
                parts = chunks_of(text, chunk_chars, overlap_chars)
                m = len(parts)
                yield batch_of(CHUNKS, [[doc_id] * m, [key] * m, [n] * m, list(range(m)), parts])

    def to_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pat = regex.compile(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                found = [seam_bounds(t, i, last, pat, chunk_chars, overlap_chars) for t, i, last in zip(part["text"].to_pylist(), part["chunk"].to_pylist(), part["last"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_key"], part["chunk"], pa.array([h for h, _ in found], BOUNDS.field("head").type), pa.array([t for _, t in found], BOUNDS.field("tail").type)], schema=BOUNDS)

    # Equal rows become one with a count, which also deals the long texts out.
    once = docs.filter(is_long).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    doc_key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), "text"), 256)
    cut_up = once.select("doc_id", "text", doc_key.alias("doc_key"), "n").mapInArrow(to_chunks, "doc_id long, doc_key string, n long, chunk long, text string")
    # Chunks are dealt out alone, so that one very long text is the work of many tasks.
    chunks = cut(cut_up.withColumn("last", F.length("text") < chunk_chars + overlap_chars).repartition("doc_key", "chunk"))
    bounds = chunks.select("doc_key", "chunk", "last", "text").mapInArrow(to_bounds, "doc_key string, chunk long, head array<long>, tail array<long>")
    by_doc = Window.partitionBy("doc_key")
    in_order = by_doc.orderBy("chunk")
    seam = F.array_min(F.array_intersect("head", F.lag("tail").over(in_order)))
    stitches = (
        bounds.withColumn("start", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(seam))
        .select("doc_key", "chunk", "start", F.lead("start").over(in_order).alias("stop"), F.lead("chunk").over(in_order).isNull().alias("final"))
        .withColumn("broken", F.max(F.col("start").isNull()).over(by_doc))
    )
    offset = F.col("chunk") * chunk_chars
    length = F.coalesce(F.col("stop") - F.col("start"), F.length("text"))
    piece = F.when(
        F.col("broken"),
        # The stride of each chunk, joined below before it is encoded.
        F.when(F.col("final"), F.col("text")).otherwise(F.substring("text", 1, chunk_chars)),
    ).otherwise(F.substring(F.col("text"), (F.col("start") - offset + 1).cast("int"), length.cast("int")))
    pieces = chunks.join(stitches, ["doc_key", "chunk"]).select("doc_id", "doc_key", "n", "chunk", "broken", piece.alias("piece"))
    sound = pieces.filter(~F.col("broken")).drop("broken")
    whole = (
        pieces.filter("broken")
        .groupBy("doc_id", "doc_key", "n")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x["piece"]), "").alias("piece"))
        .select("doc_id", "doc_key", "n", F.lit(0).cast("long").alias("chunk"), "piece")
    )
    parts = F.array_sort(F.collect_list(F.struct("chunk", "ids", "decoded")))
    long = (
        sound.unionByName(whole)
        .mapInArrow(code, f"doc_id long, doc_key string, n long, chunk long{coded}")
        .groupBy("doc_id", "doc_key", "n")
        .agg(parts.alias("parts"))
        .select(
            "doc_id",
            F.flatten(F.col("parts.ids")).alias("ids"),
            F.aggregate(F.col("parts.decoded"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("decoded"),
            F.explode(F.sequence(F.lit(1).cast("long"), "n")),
        )
        .select("doc_id", "ids", "decoded")
    )
    return short.unionByName(long)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with a column ``decoded``: the raw bytes of all ids, one after the other (null ids: null)."""

    @F.pandas_udf("binary")
    def join_bytes(ids: pd.Series) -> pd.Series:
        enc = encoding(ranks_path, pattern)
        return pd.Series([None if x is None else enc.decode_bytes(x.tolist()) for x in ids], dtype=object)

    return df.withColumn("decoded", join_bytes(ids_col))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = round_trip(documents(spark, sf_dir), path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
