"""Operator 6: approximate nearest neighbours by a forest of random-projection trees.

Each tree halves the space at hyperplanes between two random sample points, at the
median, ``DEPTH`` times.  Hyperplanes are fitted on a bounded sample; every row is
indexed under its leaf in every tree.  A query walks all trees through one priority
queue, ordered by the squared distance to the hyperplanes crossed so far, until it
has opened ``OPEN_SHARE`` of all leaves (``LEAST_OPEN`` at least), and candidates in the opened leaves are ranked
by their exact cosine in double precision.

Rows and queries meet in buckets: leaves of one tree that hold ``BUCKET_BYTES`` of
vectors together, by the counted size of each leaf.  A larger leaf (many nearly equal
vectors) is dealt over several buckets by a hash, and its queries go to all of them.
In each partition a bucket's rows come before its queries, so a task holds one
bucket and lets the queries pass, however many they are.  Equal vectors are one entry
with their k + 1 smallest ids, which is all that a query for k can need, and a bucket
gives k + 1 entries a query, so many equal or scaled copies make no large result.

On vectors without any structure (such as random directions) the recall of 0.9
takes several hundredths of all leaf entries; on clustered ones a much smaller
OPEN_SHARE does.

Cases: vectors that are null, empty or zero, hold null or non-finite components, or
have another dimension than most take no part, neither do null ids; repeated ids
with equal vectors are one row, with other vectors the nearest counts; scores that are
equal to 12 places go to the smaller id; with fewer candidates than k all are returned; other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut, mix

#: Trees, deepest level, rows that hyperplanes are fitted on, sample rows in a leaf, share of leaves that a query opens.
TREES, DEPTH, SAMPLE_ROWS, LEAF_ROWS, OPEN_SHARE = 12, 11, 20_000, 8, 0.06
#: Leaves that a query opens at least: in small tables a share of the few leaves there are finds too little.
LEAST_OPEN = 300
#: Bytes of vectors in a bucket of leaves, partitions that buckets are dealt to at most.
BUCKET_BYTES, MAX_PARTITIONS = 8_000_000, 20_000


@dataclass
class Forest:
    """Trees as complete binary trees: node i has children 2i + 1 and 2i + 2."""

    normals: np.ndarray  # tree, node, dimension
    cuts: np.ndarray  # tree, node
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, from 0."""
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t, (normal, cut) in enumerate(zip(self.normals, self.cuts, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                above = np.einsum("ij,ij->i", x, normal[node]) > cut[node]
                node = 2 * node + 1 + above
            out[:, t] = node - (2**self.depth - 1)
        return out

    def nearest_leaves(self, q: np.ndarray, n: int) -> list[tuple[int, int]]:
        """The n leaves (tree, leaf) that one priority queue over all trees reaches first."""
        margins = self.normals @ q - self.cuts
        inner = 2**self.depth - 1
        queue = [(0.0, t, 0) for t in range(len(self.normals))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < n:
            crossed, t, node = heapq.heappop(queue)
            if node >= inner:
                found.append((t, node - inner))
                continue
            d = margins[t, node]
            near = 2 * node + 1 + (d > 0)
            heapq.heappush(queue, (crossed, t, near))
            heapq.heappush(queue, (crossed + d * d, t, 4 * node + 3 - near))
        return found


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def plant(sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, max_depth: int = DEPTH) -> Forest:
    """Fit a forest to unit vectors."""
    depth = int(np.clip(np.log2(max(1, len(sample)) / leaf_rows), 0, max_depth))
    rng = np.random.default_rng(7)
    normals = np.zeros((trees, 2**depth - 1, sample.shape[1]))
    cuts = np.zeros((trees, 2**depth - 1))
    for t in range(trees):
        rows = {0: np.arange(len(sample))}
        for node in range(2**depth - 1):
            at = rows.pop(node)
            if len(at) > 1:
                a, b = sample[rng.choice(at, 2, replace=False)]
                normal = a - b
                if (size := np.linalg.norm(normal)) > 0:
                    normals[t, node] = normal / size
                    cuts[t, node] = np.median(sample[at] @ normals[t, node])
            above = sample[at] @ normals[t, node] > cuts[t, node]
            rows[2 * node + 1], rows[2 * node + 2] = at[~above], at[above]
    return Forest(normals, cuts, depth)


def usable(vector: Column) -> Column:
    """No nulls, infinities or NaN, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def assign_buckets(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For leaves (tree, leaf) of given sizes: first bucket and number of buckets, of at most 2 * ``rows`` entries of one tree each."""
    shares = np.maximum(1, -(-sizes // rows))
    small = np.where(shares > 1, 0, sizes)
    at = (np.cumsum(small, axis=1) - small) // rows
    first = at + np.arange(len(sizes))[:, None] * (at.max(initial=0) + 1)
    large = shares > 1
    ends = np.cumsum(shares[large])
    first[large] = first.max(initial=-1) + 1 + ends - shares[large]
    return first, shares


def vectors(column: pa.Array) -> np.ndarray:
    """Arrow lists of one length as unit vectors in double precision."""
    return unit(column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1))


class Bucket:
    """The entries of one bucket, which come in the order of their leaves."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        self.x = np.concatenate([vectors(p["v"]) for p in parts])
        self.ids = pa.concat_arrays([p["ids"] for p in parts])
        self.first_id = pa.concat_arrays([p["ids"].flatten().take(pa.array(p["ids"].offsets.to_numpy()[:-1] - p["ids"].offsets[0].as_py())) for p in parts]).to_numpy()
        self.leaf = np.concatenate([p["leaf"].to_numpy() for p in parts])

    def nearest(self, asked: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Position of each query, its n best entries in the leaves that it opens, and their scores."""
        for i, (q, leaves) in enumerate(zip(vectors(asked["v"]), asked["leaves"].to_pylist(), strict=True)):
            begin, end = np.searchsorted(self.leaf, leaves), np.searchsorted(self.leaf, leaves, "right")
            at = np.concatenate([np.arange(lo, hi) for lo, hi in zip(begin, end, strict=True)])
            if len(at):
                score = self.x[at] @ q
                if len(at) > n:
                    # Scores that are equal to 12 places are ties, of which the smaller ids stay.
                    fair = np.flatnonzero(score >= np.partition(score, -n)[-n] - 2e-12)
                    best = fair[np.lexsort((self.first_id[at[fair]], -np.round(score[fair], 12)))[:n]]
                    at, score = at[best], score[best]
                yield i, at, score


def search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", open_share: float = OPEN_SHARE) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found in ``df`` for each row of ``queries``, its own id left out."""
    spark = df.sparkSession
    single = all(x.schema[vector_col].dataType == ArrayType(FloatType(), x.schema[vector_col].dataType.containsNull) for x in (df, queries))
    kind = "array<float>" if single else "array<double>"
    named = lambda x: x.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = named(df)
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 1
    rows = rows.filter(F.size("v") == dim)
    # Equal vectors are one entry; the limit on row_number() is applied before the shuffle too.
    first = Window.partitionBy("v").orderBy("vec_id")
    entries = cut(rows.distinct().withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = named(queries).filter(F.size("v") == dim).distinct()
    n_asked = asked.count()
    sample = entries.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    forest = plant(unit(np.stack(list(sample)).astype(np.float64)) if len(sample) else np.zeros((0, dim)))
    sent = spark.sparkContext.broadcast(forest)
    n_leaves = 2**forest.depth
    n_open = max(LEAST_OPEN, int(np.ceil(open_share * TREES * n_leaves)))
    key = pa.int32()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An entry's leaf in each tree; leaves are numbered through all trees."""
        for batch in batches:
            if batch.num_rows:
                leaf = sent.value.leaves(vectors(batch["v"])) + np.arange(TREES) * n_leaves
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(leaf), pa.list_(key))], names=["v", "ids", "leaves"])

    placed = entries.mapInArrow(place, f"v {kind}, ids array<long>, leaves array<int>")
    placed = cut(placed)
    found = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().toPandas()
    size = np.zeros(TREES * n_leaves, np.int64)
    size[found["leaf"]] = found["count"]
    n = int(size[:n_leaves].sum())
    first_bucket, shares = (x.ravel() for x in assign_buckets(size.reshape(TREES, n_leaves), max(1, min(BUCKET_BYTES // (8 * dim), -(-n // 2)))))
    where = spark.sparkContext.broadcast((first_bucket, shares))
    n_buckets = int((first_bucket + shares).max())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each entry and tree, with its bucket; entries of a large leaf are dealt by their smallest id."""
        begin, share = where.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                leaf = part["leaves"].flatten().to_numpy()
                src = np.repeat(np.arange(part.num_rows), TREES)
                salt = mix(np.array([ids[0] for ids in part["ids"].to_pylist()], np.int64).view(np.uint64))[src] % share[leaf].astype(np.uint64)
                bucket = begin[leaf] + salt.astype(np.int64)
                src = pa.array(src)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, key), pa.array(leaf, key), part["v"].take(src), part["ids"].take(src)], names=["bucket", "leaf", "v", "ids"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and bucket, with the leaves that it opens there."""
        begin, share = where.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, src, to, opened = [], [], [], []
                for i, (vec_id, q) in enumerate(zip(part["vec_id"].to_pylist(), vectors(part["v"]), strict=True)):
                    there: dict[int, list[int]] = {}
                    for t, leaf in sent.value.nearest_leaves(q, n_open):
                        leaf += t * n_leaves
                        for b in range(begin[leaf], begin[leaf] + share[leaf]):
                            there.setdefault(b, []).append(leaf)
                    ids += [vec_id] * len(there)
                    src += [i] * len(there)
                    to += there.keys()
                    opened += there.values()
                yield pa.RecordBatch.from_arrays([pa.array(to, key), pa.array(ids, pa.int64()), part["v"].take(pa.array(src, pa.int64())), pa.array(opened, pa.list_(key))], names=["bucket", "query_id", "v", "leaves"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best entries of each bucket for each query that opens leaves there."""
        number, parts, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, asks = batch["bucket"].to_numpy(), batch["query_id"].is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((bucket[1:] != bucket[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(bucket)], strict=True):
                if bucket[lo] != number:
                    number, parts, held = bucket[lo], [], None
                if not asks[lo]:
                    parts.append(batch.slice(lo, hi - lo))
                elif parts:
                    held = held or Bucket(parts)
                    for at in range(lo, hi, 256):
                        part = batch.slice(at, min(256, hi - at))
                        best = list(held.nearest(part, k + 1))
                        if best:
                            src, which, score = np.concatenate([np.full(len(x), i) for i, x, _ in best]), np.concatenate([x for _, x, _ in best]), np.concatenate([x for _, _, x in best])
                            yield pa.RecordBatch.from_arrays([part["query_id"].take(pa.array(src)), held.ids.take(pa.array(which)), pa.array(score)], names=["query_id", "ids", "score"])

    index = placed.mapInArrow(deal, f"bucket int, leaf int, v {kind}, ids array<long>")
    walks = asked.repartition(max(1, min(MAX_PARTITIONS, n_asked // 64 + 1))).mapInArrow(walk, f"bucket int, query_id long, v {kind}, leaves array<int>")
    meet = index.unionByName(walks, allowMissingColumns=True).repartitionById(min(MAX_PARTITIONS, n_buckets), F.col("bucket") % MAX_PARTITIONS)
    # Null query ids come first: the rows of a bucket, by leaf.
    found = meet.sortWithinPartitions("bucket", "query_id", "leaf").mapInArrow(rank, "query_id long, ids array<long>, score double")
    pairs = found.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # Cosines of scaled copies of one vector differ in their last bits only, and are ties.
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.filter("vec_id % 50 = 0"))


QUERIES = {"op6_ann_forest": op6_ann_forest}
