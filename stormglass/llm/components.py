"""Connected components of an edge list, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b); label is the smallest node of the component.

    In each round every node hooks to its smallest neighbour below it, labels follow the
    hooks, and edges are rewritten to labels, until none joins two labels.  Minima are
    taken before the shuffle; a node with many edges meets one hook only.  Loops and
    repeated edges do no harm; an empty list has no components.
    """
    pairs = lambda x: x.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    left = cut(pairs(edges))
    labels = left.select(F.col("hi").alias("node")).union(left.select("lo")).distinct().withColumn("label", F.col("node"))
    while not left.isEmpty():
        hook = left.groupBy("hi").agg(F.min("lo").alias("to"))
        for _ in range(2):  # follow hooks of hooks
            on = hook.select(F.col("hi").alias("next"), F.col("to").alias("further"))
            hook = hook.join(on, F.col("to") == F.col("next"), "left").select("hi", F.coalesce("further", "to").alias("to"))
        hook = cut(hook)
        follow = lambda x, c: x.join(hook, F.col(c) == F.col("hi"), "left").withColumn(c, F.coalesce("to", c)).drop("hi", "to")  # noqa: E731,B023
        named = cut(follow(labels, "label"))
        joined = cut(pairs(follow(follow(left.select(F.col("hi").alias("a"), F.col("lo").alias("b")), "a"), "b")))
        drop(hook, left, labels)
        left, labels = joined, named
    return labels
