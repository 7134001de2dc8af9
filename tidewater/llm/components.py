"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import store


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges of a partition, one edge from each node to the least node that they connect it with."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, dtype=np.int64)), pa.array(np.array([root(x) for x in nodes], dtype=np.int64))], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges (a, b): the least node that it is connected with.

    Each partition first keeps a spanning star of its own edges.  Then stars alternate: every node's larger neighbours, and then its
    smaller ones, are joined to its least neighbour, until nothing changes, in a number of rounds that grows with the logarithm of the
    longest path.  Every round is a grouped minimum (combined before its shuffle) and a join, written to the shared folder.
    """
    now = store(edges.select("a", "b").filter(F.col("a") != F.col("b")).mapInArrow(_forest, "a long, b long"))
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lower = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = down.join(lower, F.col("a") == F.col("u"))
        now = store(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct())
        was, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == was:
            break
    found = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return store(found.unionByName(tops.join(found.select("node"), "node", "left_anti")))
