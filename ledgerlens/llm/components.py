"""Connected components of an edge table, without collecting links anywhere.

Each partition first folds its own edges with union-find into a forest (bounded by the partition). Up to ``FEW`` edges of
what is left are folded by one task in the same way, as they fit it; of more, rounds of large and small stars shrink every
component to a star. Rounds are written to the shared folder and compared by count and hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, saved


#: Edges that one task folds at once.
FEW = 300_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(x), root(y)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, label: str = "cc", few: int = FEW) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns): component is the smallest node reachable.

    Rows with a null end and self-links add nothing. An empty table gives an empty table.
    """
    x, y = edges.columns[:2]
    pairs = edges.select(F.col(x).cast("long").alias("a"), F.col(y).cast("long").alias("b")).where("a <> b")
    links = saved(pairs.mapInArrow(_forest, "a long, b long"), label)
    if at_once := links.limit(few + 1).count() <= few:
        links = saved(links.coalesce(1).mapInArrow(_forest, "a long, b long"), label)
    seen = None
    while not at_once:
        # large star: the neighbours above a node are hung on its smallest neighbour
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(hung, label)
        # small star: the neighbours below a node, and the node, are hung on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = saved(small, label)
        mark = new.agg(F.count("*"), *(F.sum(F.xxhash64("a", "b", F.lit(i)).cast("decimal(38,0)")) for i in (1, 2))).first()
        dropped(large, links)
        links = new
        if mark == seen:
            break
        seen = mark
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
