"""Operator 10: removal of passages that an earlier document has, with a count-min prefilter.

A window is WINDOW consecutive words of a document.  Each word is removed that lies in a
window whose words also start in a document with a smaller id; windows are judged on
the input.

1.  Every window has an anchor, the least hash of the ANCHOR_WORDS-word runs in it, so
    equal windows have equal anchors.  Partitions count the anchors of their documents
    in count-min sketches, which are merged.  An anchor's estimate is at least the
    number of documents with any of its windows: it overestimates windows.
2.  Only documents with a window estimated as repeated go on with their text, compressed.
    Equal documents become one class, of which the smallest id stays; copies lose all.
    The windows that are left, of these classes, are counted in sketches of their own.
3.  The windows estimated as repeated are grouped exactly, by 96 hash bits of their words.
    Tasks first settle the windows that they hold several times: all but the smallest
    id's are removed there, as runs, and one of each goes on.  So a passage that many
    documents share sends one row a task and window, and one shuffle finds the smallest
    id of each.

No window that is repeated is lost: estimates are never too low, and nothing is capped.

Cases: null, empty and blank texts have no words; texts shorter than a window lose
nothing; rows with one id are no earlier or later than one another, repeated rows
give repeated results; null ids count as larger than all others; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, Windows, batch_of, cut, documents, slices, words
from .sketch import count_keys

WINDOW, ANCHOR_WORDS = 50, 25
#: Size of a sketch: 4 rows of 2**25 counters, of which 16 MB are broadcast.  Over a corpus with many more
#: anchors than cells every window is estimated as repeated, and step 3 does the work alone.
LOG2_CELLS, DEPTH = 25, 4
NO_ID = 2**63 - 1

#: Windows that a task holds to settle among themselves.
HELD_WINDOWS = 1_000_000

FIRST_PASS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("packed", pa.binary())])
#: A document is named by its id and part of its digest.  run: so many windows from start are removed for sure; 0: the one at start takes part in the exact grouping.
FOUND = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("start", pa.int32()), ("run", pa.int32()), ("h1", pa.int64()), ("h2", pa.int32())])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


class Hasher:
    def __init__(self, window: int) -> None:
        self.window, self.anchor = window, min(ANCHOR_WORDS, window)
        self.hashes, self.again = WordHashes(), WordHashes(1)
        self.runs = Windows()

    def anchors(self, tokens: list[bytes]) -> np.ndarray:
        """The anchor of each window, in order of their starts."""
        if len(tokens) < self.window:
            return np.zeros(0, np.uint64)
        return sliding_min(self.runs.of(self.hashes.of(tokens), self.anchor), self.window - self.anchor + 1)

    def windows(self, tokens: list[bytes], second: bool = False) -> np.ndarray:
        """A hash of each window; the second is independent of the first."""
        return self.runs.of((self.again if second else self.hashes).of(tokens), self.window)


def text_anchors(window: int) -> Callable[[str | None], np.ndarray]:
    hasher = Hasher(window)
    return lambda text: np.unique(hasher.anchors(words(text)))


def sha_of(tokens: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(tokens)).hexdigest()


def unpacked(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split()


def covered(n: int, starts: np.ndarray, runs: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in one of the windows that start in the ``runs`` places from ``starts`` on."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts.astype(np.int64) + runs + window - 1, n), -1)
    return np.cumsum(steps[:n]) > 0


def part_of(sha: str) -> int:
    return int(sha[:15], 16)


def settle(held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND for some documents (doc_id, part, starts and both hashes of their windows).

    Of each window the one with the smallest id goes on; larger ids' are gone, one row a run.
    """
    sizes = np.array([len(h[2]) for h in held], np.int64)
    if not sizes.sum():
        return
    doc = np.repeat(np.arange(len(held)), sizes)
    ids, parts = (np.repeat(np.array([h[i] for h in held], np.int64), sizes) for i in (0, 1))
    start, h1, h2 = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
    order = np.lexsort((ids, h2, h1))
    new = np.r_[True, (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)]
    least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]  # the smallest id with the window, in this order
    gone = np.zeros(len(ids), bool)
    gone[order] = ids[order] > least
    # Starts rise within a document, so runs of windows that are gone are runs of rows.
    edge = np.r_[True, (np.diff(doc) != 0) | (np.diff(start) != 1) | (gone[1:] != gone[:-1])]
    first = np.flatnonzero(edge & gone)
    ends = np.append(np.flatnonzero(edge), len(ids))
    at = np.concatenate([first, np.flatnonzero(~gone)])
    run = np.zeros(len(at), np.int64)
    run[: len(first)] = ends[np.searchsorted(ends, first, side="right")] - first
    # What is settled needs no partner, so its rows are spread by keys of their own.
    h1[first], h2[first] = ids[first], start[first]
    columns = (ids[at], parts[at], start[at], run, h1[at], h2[at])
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def find_repeats(df: DataFrame, text_col: str, id_col: str, window: int, log2_cells: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, n_words, sha) and the classes that may have something to remove (sha, rep, packed, starts, runs)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeats = count_keys(docs.select("text"), lambda: text_anchors(window), log2_cells, DEPTH, least=2)
    sent = df.sparkSession.sparkContext.broadcast(repeats)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's word sequence as a digest; its words only if it may have a repeated window."""
        hasher, packer = Hasher(window), zstandard.ZstdCompressor(3)
        for ids, texts in slices(batches):
            out = []
            for text in texts:
                tokens = words(text)
                anchors = hasher.anchors(tokens)
                anchors = anchors[np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])] if len(anchors) else anchors
                joined = b" ".join(tokens)
                out.append((len(tokens), hashlib.sha256(joined).hexdigest(), packer.compress(joined) if sent.value.maybe(anchors).any() else None))
            yield batch_of(FIRST_PASS, [ids, *zip(*out, strict=True)])

    rows = cut(docs.mapInArrow(first_pass, "doc_id long, n_words long, sha string, packed binary"))
    known = F.coalesce("doc_id", F.lit(NO_ID))
    reps = cut(rows.groupBy("sha").agg(F.min(known).alias("rep"), F.first("packed", ignorenulls=True).alias("packed")).filter("packed is not null"))

    def windows_left() -> Callable[[bytes], np.ndarray]:
        hasher = Hasher(window)

        def keys(packed: bytes) -> np.ndarray:
            tokens = unpacked(packed)
            return np.unique(hasher.windows(tokens)[np.flatnonzero(sent.value.maybe(hasher.anchors(tokens)))])

        return keys

    exact = df.sparkSession.sparkContext.broadcast(count_keys(reps.select("packed"), windows_left, log2_cells, DEPTH, least=2))

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(window), [], 0
        for some in slices(batches):
            for sha, rep, packed in zip(*some, strict=True):
                tokens = unpacked(packed)
                h = hasher.windows(tokens)
                at = np.flatnonzero(exact.value.maybe(h))
                if len(at):
                    again = hasher.windows(tokens, second=True)[at] >> np.uint64(32)
                    held.append((rep, part_of(sha), at, h[at].view(np.int64), again.astype(np.uint32).view(np.int32)))
                    size += len(at)
                if size > HELD_WINDOWS:
                    yield from settle(held)
                    held, size = [], 0
        yield from settle(held)

    found = reps.select("sha", "rep", "packed").mapInArrow(windows_of, "doc_id long, part long, start int, run int, h1 long, h2 int")
    same = Window.partitionBy("h1", "h2")
    judged = found.withColumn("first", F.min("doc_id").over(same)).filter((F.col("run") > 0) | (F.col("doc_id") > F.col("first")))
    removed = judged.groupBy(F.col("doc_id").alias("rep"), "part").agg(F.collect_list("start").alias("starts"), F.collect_list(F.greatest("run", F.lit(1))).alias("runs"))
    part = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")
    return rows.select("doc_id", "n_words", "sha"), reps.withColumn("part", part).join(removed, ["rep", "part"], "left")


def dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, log2_cells: int = LOG2_CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text for each row of ``df``.

    kept_text has the kept words with one space between, and is null where nothing is
    removed.
    """
    rows, classes = find_repeats(df, text_col, id_col, window, log2_cells)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sha", pa.string()), ("rep", pa.int64()), ("gone", pa.int64()), ("kept_sha", pa.string()), ("kept", pa.string())])
        for batch in batches:
            for i, (sha, rep, packed) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                tokens = unpacked(packed)
                starts, runs = (np.zeros(0, np.int32) if c[i].values is None else c[i].values.to_numpy() for c in batch.columns[3:])
                gone = covered(len(tokens), starts, runs, window)
                kept = [t for t, g in zip(tokens, gone, strict=True) if not g]
                yield batch_of(schema, [[sha], [rep], [int(gone.sum())], [sha_of(kept)], [b" ".join(kept).decode() if gone.any() else None]])

    judged = classes.select("sha", "rep", "packed", "starts", "runs").mapInArrow(apply, "sha string, rep long, gone long, kept_sha string, kept string")
    joined = rows.join(judged, "sha", "left")
    copy = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("rep")) & (F.col("n_words") >= window)
    return joined.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept_text"),
        F.col("sha").alias("words_sha256"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Words as lists; windows as joined strings, of which the smallest id is taken.
ORACLE_SQL = {
    "op10_substring_dedup": f"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w)),
    firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
    cov AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS at FROM win JOIN firsts USING (s) WHERE doc_id > f),
    kept AS (
        SELECT x.doc_id, count(*) AS n_kept, string_agg(x.word, ' ' ORDER BY x.at) AS body
        FROM (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS at FROM w) x ANTI JOIN cov c ON c.doc_id = x.doc_id AND c.at = x.at GROUP BY x.doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """
}
QUERIES = {"op10_substring_dedup": op10_substring_dedup}
