"""The first of many needles that a text contains: a substring theta-join by an inverted index of grams.

Each needle is filed under one of its grams of GRAM characters (of all its characters if it has fewer): the one that fewest
texts have.  The grams of a text equi-join that index, and a text is only searched for the needles filed under a gram that it
has; of those it contains, the one with the least place wins.  A needle one of whose grams no text has is left out at once.  Grams that
many texts share, such as parts of common words, are nobody's rarest, so no key of the join is hot unless a needle
consists of nothing else.

Cases: null and empty needles are no needles, null texts contain none; needles with the same text count once, with the least
place; rows that share an id count as one text; case and every character matter, beyond the basic plane too; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

GRAM = 6
#: Grams, or rows of the index, that are sent to all tasks; more of them are shuffled.
BROADCAST_ROWS = 100_000
#: Characters of a text that are cut into grams at once.
WINDOW = 2**18


def grams(text: str, sizes: list[int]) -> set[str]:
    return {text[i : i + k] for k in sizes for i in range(len(text) - k + 1)}


def _small(table: DataFrame) -> DataFrame:
    """``table``, to be sent to all tasks if its rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _text_grams(texts: DataFrame, sizes: list[int], wanted: DataFrame) -> DataFrame:
    """(text_id, gram): the distinct grams of each text that are in ``wanted`` (gram, each once)."""
    few = wanted.count() <= BROADCAST_ROWS
    known = texts.sparkSession.sparkContext.broadcast(frozenset(r["gram"] for r in wanted.collect())) if few else None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                found: set[str] = set()
                for begin in range(0, len(text or ""), WINDOW):
                    part = text[begin : begin + WINDOW + GRAM - 1]
                    here = grams(part, sizes)
                    found |= here & known.value if known else here
                if found:
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(found)), pa.array(list(found), pa.string())], names=["text_id", "gram"])

    kind = texts.schema["text_id"].dataType.simpleString()
    out = texts.select("text_id", "text").mapInArrow(find, f"text_id {kind}, gram string")
    return out if few else out.join(wanted, "gram", "left_semi")


def index(texts: DataFrame, needles: DataFrame) -> tuple[DataFrame, list[int]]:
    """Each needle (needle, place) of which some text has every gram, with its rarest ``gram``; and the sizes of the grams.

    ``texts`` has text_id and text.
    """
    one = needles.filter("needle <> ''").groupBy("needle").agg(F.min("place").cast("long").alias("place"))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, p, g) for n, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for g in grams(n, [min(len(n), GRAM)])]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pydict(dict(zip(("needle", "place", "gram"), zip(*rows[at : at + 10_000], strict=True), strict=True)), pa.schema([("needle", pa.string()), ("place", pa.int64()), ("gram", pa.string())]))

    filed = written(one.mapInArrow(file, "needle string, place long, gram string"))
    sizes = sorted(r[0] for r in filed.select(F.char_length("gram")).distinct().collect())  # GRAM at most
    if not sizes:
        return one.withColumn("gram", F.lit("")).limit(0), []
    counts = _text_grams(texts, sizes, written(filed.select("gram").distinct())).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rated = filed.join(counts, "gram", "left")
    rarest = rated.groupBy("needle", "place").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("n").alias("n_found"), F.count(F.lit(1)).alias("n_grams"))
    return written(rarest.filter("n_found = n_grams").select("needle", "place", "gram")), sizes


def first_needles(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text_id, needle, place) of the needle of least place in each text that contains one."""
    filed, sizes = index(texts, needles)
    if not sizes:
        return texts.select("text_id").join(filed.select("needle", "place"), F.lit(False))
    near = _text_grams(texts, sizes, filed.select("gram").distinct()).join(_small(filed), "gram").select("text_id", "needle", "place")
    hits = texts.join(written(near), "text_id").filter(F.contains("text", "needle"))
    best = hits.groupBy("text_id").agg(F.min_by("needle", "place").alias("needle"), F.min("place").alias("place"))
    return best
