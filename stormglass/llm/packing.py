"""Operator 8: variable-capacity best-fit packing.

Documents are cut into pieces of at most the largest permitted length, and pieces
are packed into sequences, longest first.  A piece goes to the open bin with the
least room that still holds it, whatever the bin's capacity.  If none does, a bin is
opened, and its capacity is the permitted one with the least cost for each token
that it can come to hold.  At the end each bin shrinks to the smallest permitted
length that holds its contents.

A bin never spans two shards.  Shards are dealt by a hash of (doc_id, piece), hold
about ``shard_pieces`` pieces, and are packed apart from each other, so memory is
bounded whatever the corpus; each shard's loss is below one bin for each length.

Cases: null, empty and blank texts give one row without a bin; null ids are packed
like others; rows that are equal in id and length are packed one by one; other
columns are ignored; no row of the input is lost.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, n_words

#: Permitted sequence lengths in tokens.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence of c tokens: FIXED + c + c * c / ATTENTION.
FIXED, ATTENTION = 64.0, 65_536.0
SHARD_PIECES = 20_000
SCHEMA = "doc_id long, piece int, n_tokens long, bin_id string, bin_capacity int, bin_offset long"


def cost(capacity: int) -> float:
    return FIXED + capacity + capacity * capacity / ATTENTION


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and each bin's capacity.  ``lengths`` fall, and none exceeds the largest capacity."""
    left = sum(lengths)
    rooms: list[int] = []  # distinct rooms of open bins, rising
    bins_of: dict[int, list[int]] = {}  # room: heap of bins
    capacity: list[int] = []
    used: list[int] = []
    bins, offsets = [], []
    for x in lengths:
        at = bisect_left(rooms, x)
        if at < len(rooms):
            room = rooms[at]
            b = heapq.heappop(bins_of[room])
            if not bins_of[room]:
                del bins_of[room], rooms[at]
        else:
            # What is left bounds what a bin can come to hold.
            room = min((c for c in capacities if c >= x), key=lambda c: (cost(c) / min(c, left), c))
            b = len(capacity)
            capacity.append(room)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += x
        left -= x
        if rest := room - x:
            if rest not in bins_of:
                bins_of[rest] = []
                insort(rooms, rest)
            heapq.heappush(bins_of[rest], b)
    return bins, offsets, [min(c for c in capacities if c >= u) for u in used]


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Rows of SCHEMA for ``lengths`` (doc_id, n_tokens): one for each piece, bins named shard-number."""
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]
    docs = lengths.select(F.col("doc_id").cast("long"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("total"))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("total") / largest).cast("int"))
    pieces = docs.select("doc_id", "total", F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(largest).cast("long"), F.col("total") - F.col("piece").cast("long") * largest).alias("n_tokens"))
    pieces = cut(pieces)  # so that texts are read and lengths are taken once
    shards = max(1, -(-pieces.count() // shard_pieces))

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)
        some = rows["n_tokens"] > 0
        bins, offsets, sizes = best_fit(rows.loc[some, "n_tokens"].tolist(), capacities)
        shard = rows["shard"].iloc[0]
        rows.loc[some, "bin_id"] = [f"{shard}-{b}" for b in bins]
        rows.loc[some, "bin_capacity"] = [sizes[b] for b in bins]
        rows.loc[some, "bin_offset"] = offsets
        out = rows.reindex(columns=["doc_id", "piece", "n_tokens", "bin_id", "bin_capacity", "bin_offset"])
        out["bin_id"] = out["bin_id"].astype(object).where(some, None)
        return out.astype({"doc_id": "Int64", "bin_capacity": "Int32", "bin_offset": "Int64"})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(pack_shard, SCHEMA)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pack(docs.select("doc_id", n_words(F.col("text")).alias("n_tokens")))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
