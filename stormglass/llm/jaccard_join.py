"""Operator 3: n-gram Jaccard join with a token-group matrix.

Documents are sets of word shingles, and two link if their Jaccard similarity is at
least THRESHOLD percent.  The join is exact:

1.  A set's prefix are its shingles with the smallest hashes, EXTRA more than a partner
    must leave over: partners share at least ``least_shared`` shingles of both prefixes.
    Prefix shingles are counted exactly; sets with too few that another set has end here.
2.  Equal sets of the rest become one class.  Counts are repeated among the classes, and
    classes with too few contested shingles are set aside (twice over).  The shingles that a
    class has alone bound its overlap with any partner.  Only classes that are left have
    their whole sets made.
3.  Classes are partitioned into groups of similar ones, by the most frequent shingle of
    their prefix.  A group of more than CAP_TOKENS shingles is split by size and by a salt.
    Within a group all pairs are compared that are not connected already.
4.  The token-group matrix holds each group's union of prefix shingles, with the sizes and
    overlap bounds of the sets behind it.  It bounds each set's overlap with each group;
    groups that qualify are opened and compared exactly.  As sets that share a frequent
    shingle are in few groups, a shingle meets few groups, however many sets have it.

Links never come from hashing alone: similarities are computed on the whole sets (of
64-bit shingle hashes).  Filters of contested shingles and of texts are broadcast, as bits
sized by counts up to a bound; beyond it they let more through, which plain joins then drop.

Cases: null, empty and blank texts are empty sets and link with nothing, not even
with each other; with fewer words than a shingle the whole sequence is the one
shingle; equal sets link; rows with one id and different texts are judged row by row;
null ids take no part in a component's smallest id, and are null where all ids
are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, Windows, batch_of, cut, documents, drop, lower_ascii, slices
from .components import components
from .sketch import Cells, count_keys

SHINGLE_WORDS, THRESHOLD = 5, 80
#: Most cells of the filters of shingles and of texts, in two rows (2 * 64 MB), and cells a key below that.
LOG2_FILTER, CELLS_OF_KEY = 29, 8
#: Shingles of a group, queries that visit a group in one task.
CAP_TOKENS, BLOCK_QUERIES = 2**19, 256
#: Prefixes are longer than needed by a shingle in so many, so that more must be shared.
EXTRA = 16
#: Rounds in which classes without enough contested shingles are set aside.
ROUNDS = 2
#: Digests that a task remembers, so as to send equal sets on once.
HELD_DIGESTS = 500_000

ROWS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("prefix", pa.list_(pa.int64()))])
SETS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def required(n: int) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-THRESHOLD * n // 100)


def prefix_size(n: int) -> int:
    return n - required(n) + 1 + n // EXTRA if n else 0


def least_shared(n: int) -> int:
    """Shingles that the prefixes of a set of n and of any partner, of ``required(n)`` or more, have in common."""
    return 1 + required(n) // EXTRA


def ceil_share(n: str) -> str:
    """SQL for ``required``."""
    return f"({THRESHOLD} * {n} + 99) div 100"


def shingler(k: int) -> Callable[[str | None], np.ndarray]:
    """The function that gives a text's distinct shingles as sorted 64-bit hashes."""
    hashes, runs = WordHashes(2), Windows()

    def shingles(text: str | None) -> np.ndarray:
        tokens = lower_ascii(text)
        return np.unique(runs.of(hashes.of(tokens), min(k, len(tokens)))) if tokens else np.zeros(0, np.uint64)

    return shingles


def linked(overlap: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    return 100 * overlap >= THRESHOLD * (n + sizes - overlap)


class Sets:
    """Some sets, ready for counting overlaps with one at a time."""

    def __init__(self, tokens: list[np.ndarray]) -> None:
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.ends = np.append(0, np.cumsum(self.sizes))
        self.known, self.dense = np.unique(np.concatenate(tokens), return_inverse=True)
        self.owner = np.repeat(np.arange(len(tokens)), self.sizes)
        self.mask = np.zeros(len(self.known), bool)

    def overlaps(self, at: np.ndarray) -> np.ndarray:
        """Overlap of each set with the known tokens at ``at``."""
        self.mask[at] = True
        out = np.bincount(self.owner[self.mask[self.dense]], minlength=len(self.sizes))
        self.mask[at] = False
        return out

    def of(self, i: int) -> np.ndarray:
        return self.dense[self.ends[i] : self.ends[i + 1]]

    def find(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, tokens), len(self.known) - 1)
        return at[self.known[at] == tokens]


def cluster(tokens: list[np.ndarray]) -> np.ndarray:
    """The component of each set, as the index of a member; every pair is compared unless it is connected already."""
    labels = np.arange(len(tokens))
    sets = Sets(tokens)
    for i in range(len(tokens)):
        apart = labels != labels[i]
        if not apart.any():
            continue
        near = apart & linked(sets.overlaps(sets.of(i)), int(sets.sizes[i]), sets.sizes)
        if near.any():
            labels[np.isin(labels, labels[near])] = labels[i]
    return labels


def star_edges(rows: pd.DataFrame) -> pd.DataFrame:
    """An edge from each member of a group to one member of its component."""
    ids = rows["id"].to_numpy()
    labels = cluster(rows["tokens"].to_list())
    at = np.flatnonzero(labels != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[at], "b": ids[labels[at]]})


def visit(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Edges from each query to the members it links to, one for each that are not connected by earlier queries."""
    out: list[pd.DataFrame] = [pd.DataFrame({"a": [], "b": []}, dtype=np.int64)]
    if len(queries) and len(members):
        sets, ids = Sets(members["tokens"].to_list()), members["id"].to_numpy()
        labels = np.arange(len(ids))
        for query, tokens in zip(queries["id"], queries["tokens"], strict=True):
            near = np.flatnonzero(linked(sets.overlaps(sets.find(tokens)), len(tokens), sets.sizes))
            apart, at = np.unique(labels[near], return_index=True)
            out.append(pd.DataFrame({"a": query, "b": ids[near[at]]}))
            if len(apart) > 1:
                labels[np.isin(labels, apart)] = apart[0]
    return pd.concat(out)


def to_rows(docs: DataFrame, k: int) -> DataFrame:
    """ROWS of ``docs`` (doc_id, text, text_key): each set's size and digest, and its prefix.

    Of equal sets in a task only the first has its prefix.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, met = shingler(k), set()
        for ids, texts, keys in slices(batches):
            out = []
            for text in texts:
                s = shingles(text)
                if not len(s):
                    out.append((0, None, None, None))
                    continue
                digest = digest_of(s)
                prefix = None if digest in met else s[: prefix_size(len(s))].view(np.int64)
                remember(met, digest)
                out.append((len(s), *digest, prefix))
            yield batch_of(ROWS, [ids, keys, *zip(*out, strict=True)])

    return docs.mapInArrow(apply, "doc_id long, text_key long, n long, hi long, lo long, prefix array<long>")


def key_filter(keys: DataFrame) -> Cells:
    """Which keys may be among those of a one-column DataFrame of longs; all that are pass."""
    cells = min(LOG2_FILTER, max(16, (CELLS_OF_KEY * keys.count()).bit_length()))
    return count_keys(keys, lambda: lambda key: np.array([key], np.int64).view(np.uint64), cells, 2, least=1)


def hopeful(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Of ``rows`` (text_key, n, hi, lo, prefix) those with enough prefix shingles that may be among ``tokens``, which stay."""
    sent = rows.sparkSession.sparkContext.broadcast(key_filter(tokens))
    schema = pa.schema([f for f in ROWS if f.name != "doc_id"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, his, los, prefixes in slices(batches):
            out = []
            for key, n, hi, lo, prefix in zip(keys, sizes, his, los, prefixes, strict=True):
                p = np.array(prefix, np.int64)
                p = p[sent.value.maybe(p.view(np.uint64))]
                if len(p) >= least_shared(n):
                    out.append((key, n, hi, lo, p))
            if out:
                yield batch_of(schema, [*zip(*out, strict=True)])

    return rows.select(schema.names).mapInArrow(apply, "text_key long, n long, hi long, lo long, prefix array<long>")


def digest_of(s: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit digest, as two signed numbers."""
    hi, lo = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
    return hi, lo


def remember(met: set, digest: tuple[int, int]) -> None:
    if len(met) >= HELD_DIGESTS:
        met.clear()
    met.add(digest)


def to_sets(docs: DataFrame, k: int, wanted: Cells) -> DataFrame:
    """SETS of those ``docs`` (text, text_key) whose key may be wanted."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, met = shingler(k), set()
        for texts, keys in slices(batches):
            out = []
            for at in np.flatnonzero(sent.value.maybe(np.array(keys, np.int64).view(np.uint64))):
                s = shingles(texts[at])
                if len(s) and (digest := digest_of(s)) not in met:
                    remember(met, digest)
                    out.append((*digest, s.view(np.int64)))
            if out:
                yield batch_of(SETS, [*zip(*out, strict=True)])

    return docs.select("text", "text_key").mapInArrow(apply, "hi long, lo long, tokens array<long>")


def contested(held: DataFrame, of: str = "id") -> DataFrame:
    """(token, often): tokens of more than one set."""
    return held.groupBy("token").agg(F.min(of).alias("first"), F.max(of).alias("last"), F.count(F.lit(1)).alias("often")).filter("first < last").select("token", "often")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of the prefixes of ``classes`` (id, n, prefix) when uncontested tokens and hopeless classes are gone.

    Gives (token, id) and, for each class, (id, n, most, key): the most that it can share with another class,
    and the most frequent token of its prefix.
    """
    held = classes.select("id", "n", F.explode("prefix").alias("token"))
    for _ in range(ROUNDS):
        tokens = cut(contested(held))
        left = cut(held.join(tokens, "token"))
        drop(held, tokens)
        able = left.groupBy("id").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("shared"), F.max(F.struct("often", "token")).alias("top"))
        able = able.filter(f"shared >= 1 + {ceil_share('n')} div {EXTRA}")
        alone = f"(n - {ceil_share('n')} + 1 + n div {EXTRA} - shared)"
        able = cut(able.select("id", "n", F.expr(f"n - {alone}").alias("most"), F.col("top.token").alias("key")))
        held = cut(left.join(able.select("id"), "id", "left_semi").select("token", "id", "n"))
        drop(left)
    return held.select("token", "id"), able


def grouped(able: DataFrame) -> DataFrame:
    """``able`` with its group (g, part, salt) and how many classes that has.

    The groups of a key with more than CAP_TOKENS shingles are apart by bands of sizes, and those split by a salt.
    """
    banded = able.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / THRESHOLD))).cast("int"))
    sizes = cut(banded.groupBy("key", "band").agg(F.sum("n").alias("size")))
    large = sizes.groupBy("key").agg(F.sum("size").alias("total")).filter(f"total > {CAP_TOKENS}").select("key")
    large = sizes.join(large, "key").select("key", "band", F.ceil(F.col("size") / CAP_TOKENS).alias("salts"))
    split = banded.join(large, ["key", "band"], "left")
    out = split.select(
        "id", "n", "most", F.col("key").alias("g"),
        F.when(F.col("salts").isNull(), -1).otherwise(F.col("band")).alias("part"),
        F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int").alias("salt"),
    )
    out = cut(out)
    drop(sizes)
    crowds = out.groupBy("g", "part", "salt").agg(F.count(F.lit(1)).alias("crowd"))
    return out.join(crowds, ["g", "part", "salt"])


def ranked(prefix: str = "") -> Column:
    """Groups in the order of their sizes."""
    return F.struct(*(F.col(prefix + c) for c in ("crowd", "g", "part", "salt")))


def visits_of(held: DataFrame, members: DataFrame) -> DataFrame:
    """(id, h_g, h_part, h_salt): the groups that each class has to be compared with, by the token-group matrix.

    Of two groups the classes of the smaller visit the larger.
    """
    rows = cut(held.join(members, "id"))
    matrix = rows.groupBy("token", *(F.col(c).alias(f"h_{c}") for c in ("crowd", "g", "part", "salt"))).agg(F.min("n").alias("h_least"), F.max("n").alias("h_largest"), F.max("most").alias("h_most"))
    # A partner has THRESHOLD percent of the larger set's size, and both overlaps are bounded by what each can share.
    sized = (100 * F.col("h_largest") >= THRESHOLD * F.col("n")) & (100 * F.col("n") >= THRESHOLD * F.col("h_least"))
    enough = (100 + THRESHOLD) * F.least("most", "h_most") >= THRESHOLD * (F.col("n") + F.greatest(F.col("h_least"), F.expr(ceil_share("n"))))
    found = rows.join(matrix, "token").filter((ranked() < ranked("h_")) & sized & enough)
    found = found.groupBy("id", "n", "h_g", "h_part", "h_salt").agg(F.count(F.lit(1)).alias("shared")).filter(f"shared >= 1 + {ceil_share('n')} div {EXTRA}")
    out = cut(found.select("id", "h_g", "h_part", "h_salt"))
    drop(rows)
    return out


def open_groups(visits: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between visiting classes and ``members`` (id, tokens, g, part, salt) of the groups they visit."""
    # Groups with many visitors are sent to several tasks, each with a block of them.
    blocks = cut(visits.groupBy("h_g", "h_part", "h_salt").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks")))
    queries = visits.join(blocks, ["h_g", "h_part", "h_salt"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks").join(members.select("id", "tokens"), "id")
    same = (F.col("g") == F.col("h_g")) & (F.col("part") == F.col("h_part")) & (F.col("salt") == F.col("h_salt"))
    inside = members.join(blocks, same).select("id", "tokens", "g", "part", "salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("of_block"))
    # New names tell the columns of the two sides apart.
    inside = inside.toDF("id", "tokens", "of_g", "of_part", "of_salt", "of_block")
    return queries.groupBy("h_g", "h_part", "h_salt", "block").cogroup(inside.groupBy("of_g", "of_part", "of_salt", "of_block")).applyInPandas(visit, "a long, b long")


def similarity_classes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) for each row of ``df``.

    Also text_key, the xxhash64 of the text, and component, a name of the component that also tells
    those apart in which all ids are null; both are null for empty sets' components and null texts' keys.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = docs.withColumn("text_key", F.when(F.col("text").isNotNull(), F.xxhash64("text")))

    every = cut(to_rows(keyed, k))
    able = every.filter("prefix is not null")
    # Half a digest will do here: it only has to differ where sets do.
    tokens = cut(contested(able.select("hi", F.explode("prefix").alias("token")), "hi").select("token"))
    able = cut(hopeful(able, tokens))
    rows = cut(every.drop("prefix"))
    drop(every, tokens)
    classes = able.groupBy("hi", "lo").agg(F.first("n").alias("n"), F.first("text_key").alias("text_key"), F.first("prefix").alias("prefix"))
    # Row numbers are stable once they are written.
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    drop(able)
    held, able = candidates(classes.select("id", "n", "prefix"))
    members = cut(grouped(able))
    names = cut(classes.join(members.select("id"), "id", "left_semi").select("id", "hi", "lo", "text_key"))
    drop(classes)
    sets = to_sets(keyed.filter("text is not null"), k, key_filter(names.select("text_key"))).groupBy("hi", "lo").agg(F.first("tokens").alias("tokens"))
    full = cut(sets.join(names.drop("text_key"), ["hi", "lo"]).join(members.select("id", "g", "part", "salt", "crowd"), "id").drop("hi", "lo"))
    inside = full.filter("crowd > 1").select("g", "part", "salt", "id", "tokens").groupBy("g", "part", "salt").applyInPandas(star_edges, "a long, b long")
    visits = visits_of(held, members)
    edges = cut(inside.unionByName(open_groups(visits, full.drop("crowd"))))
    drop(full, visits, members)
    joined = components(edges)
    labels = cut(joined.withColumnRenamed("node", "id").join(names, "id").select("hi", "lo", "label"))
    drop(edges, names)
    reps = rows.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")).join(labels, ["hi", "lo"], "left")
    smallest = reps.filter("label is not null").groupBy("label").agg(F.min("rep").alias("least"))
    component = F.coalesce(F.col("label").cast("string"), F.concat_ws("/", "hi", "lo")).alias("component")
    named = reps.join(smallest, "label", "left").select("hi", "lo", F.coalesce("least", "rep").alias("component_id"), component)
    found = rows.select("doc_id", F.col("n").alias("n_shingles"), "text_key", "hi", "lo").join(named, ["hi", "lo"], "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_key", "component")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


#: All pairs with a shingle in common, then all that each document reaches.
ORACLE_SQL = {
    "op3_jaccard_join": rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (
        SELECT DISTINCT doc_id, CASE WHEN len(ws) < {SHINGLE_WORDS} THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + {SHINGLE_WORDS - 1}], ' ') END AS shingle
        FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - {SHINGLE_WORDS - 1}))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= {THRESHOLD} * (x.n + y.n - m)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN ways e ON e.a = r.other)
    SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
    FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
    """
}
QUERIES = {"op3_jaccard_join": op3_jaccard_join}
