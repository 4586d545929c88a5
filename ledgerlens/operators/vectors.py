"""Exact scoped vector search that skips shards by the triangle inequality.

Unit vectors are dealt to the nearest of some pivots of their scope. On the sphere, distance grows as cosine falls, and a
vector x of a shard with pivot p is at least |d(q, p) - d(p, x)| away from a query q; with the least and largest d(p, x)
of a shard that bounds all its vectors at once. A query first searches the nearest shards, as many as hold k vectors; its
k-th best there is the distance that every other shard must be able to reach, or it is skipped. What is left is searched
too, so the result is that of comparing everything. Shards and queries are dealt in blocks, so that no task holds more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..checkpoints import checkpointed
from .retrieval import top_k

#: Pivots of all scopes together (they are broadcast), vectors or queries of a block, and what rounding may change in a score.
PIVOTS, BLOCK, SLACK = 4096, 2048, 1e-6
#: Vectors for each pivot of a scope, at least.
LEAST_SHARD = 64
#: Vectors of a block where all cosines are returned.
PAIRS = 1024


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a direction, and their unit vectors."""
    found = [(i, np.asarray(v, float)) for i, v in enumerate(column.to_pylist()) if v and None not in v]
    found = [(i, v, float(np.sqrt(v @ v))) for i, v in found]
    found = [(i, v / size) for i, v, size in found if 0 < size < np.inf]
    return np.array([i for i, _ in found], int), np.array([v for _, v in found]).reshape(len(found), -1)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length without nulls, as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def has_direction(vec: Column) -> Column:
    """Whether a vector has finite components, and one that is not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return F.coalesce(finite, F.lit(False))


def all_cosines(queries: DataFrame, vectors: DataFrame, block: int = PAIRS) -> DataFrame:
    """query, id, cosine (six decimals) of every pair of a query (scope, query, vec) and another vector (scope, id, vec) of its scope.

    All vectors have a direction and one length. Both sides are dealt in blocks of a scope by their ids' hashes, and pairs
    of blocks are multiplied: no task holds more than two blocks and their product, and a vector travels once for each block.
    """
    many = lambda df, name: df.groupBy("scope").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = checkpointed(many(queries, "turns").join(many(vectors, "pieces"), "scope"))
    dealt = lambda own, n: F.pmod(F.xxhash64(own), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = ["scope", "turn", "piece"]
    left = queries.join(sizes, "scope").withColumn("turn", dealt("query", "turns")).withColumn("piece", all_of("pieces")).select(*group, "query", F.col("vec").cast("array<double>").alias("vec"))
    right = vectors.join(sizes, "scope").withColumn("piece", dealt("id", "pieces")).withColumn("turn", all_of("turns")).select(*(F.col(c).alias(c) for c in group), "id", F.col("vec").cast("array<double>").alias("vec"))
    shape = T.StructType([left.schema["query"], right.schema["id"], T.StructField("cosine", T.DoubleType())])
    arrow = to_arrow_schema(shape)

    def multiplied(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return arrow.empty_table()
        x, y = (_rows(t.column("vec")) for t in (a, b))
        cosine = x @ y.T / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1)))
        i, j = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
        out = pa.Table.from_arrays([a.column("query").combine_chunks().take(pa.array(i)), b.column("id").combine_chunks().take(pa.array(j)), pa.array(np.round(cosine, 6).ravel())], schema=arrow)
        return out.filter(pc.not_equal(out.column(0), out.column(1)))

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(multiplied, shape)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def _choose(vectors: DataFrame, pivots: int) -> dict:
    """Some vectors of each scope, by the order of their ids' hashes; none where there are too many scopes."""
    sizes = vectors.groupBy("scope").agg(F.count("*").alias("n"))
    scopes = sizes.count()
    if not scopes or pivots // scopes < 2:
        return {}
    ranked = top_k(vectors, ["scope"], [F.xxhash64("id"), F.col("id")], pivots // scopes)
    few = ranked.join(sizes, "scope").where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / LEAST_SHARD)))
    made: dict = {}
    for r in few.orderBy("scope", "rank").collect():
        v = np.asarray(r.vec, float)
        made.setdefault(r.scope, []).append(v / np.sqrt(v @ v))
    return {s: np.array(v) for s, v in made.items()}


def _by_scope(batch: pa.RecordBatch, rows: np.ndarray) -> Iterator[tuple]:
    scopes = batch.column("scope").to_pylist()
    of: dict = {}
    for place, i in enumerate(rows):
        of.setdefault(scopes[i], []).append(place)
    return ((s, np.array(p)) for s, p in of.items())


class PivotSearch:
    """The vectors (scope, id, vec) of a table, dealt to shards once, and searches in them.

    Vectors that are null, empty, zero, or hold null or non-finite components find nothing and are not found.
    """

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, block: int = BLOCK) -> None:
        spark, self.block = vectors.sparkSession, block
        known = vectors.select("scope", "id", F.col("vec").cast("array<double>").alias("vec")).where(has_direction(F.col("vec")))
        self.known, self.pivots = known, _choose(known, pivots)
        sent = spark.sparkContext.broadcast(self.pivots)
        shape = T.StructType([*known.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("reach", T.DoubleType())])
        arrow = to_arrow_schema(shape)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, unit = _matrix(b.column("vec"))
                shard, reach = np.zeros(len(rows), np.int32), np.full(len(rows), 2.0)
                for scope, at in _by_scope(b, rows):
                    if (p := sent.value.get(scope)) is not None:
                        cosine = unit[at] @ p.T
                        shard[at] = cosine.argmax(1)
                        reach[at] = _distance(cosine.max(1))
                kept = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(list(unit), arrow.field("vec").type), pa.array(shard), pa.array(reach)], schema=arrow)

        self.dealt = checkpointed(known.mapInArrow(deal, shape))
        self.shards = checkpointed(self.dealt.groupBy("scope", "shard").agg(F.count("*").alias("held"), F.min("reach").alias("near"), F.max("reach").alias("far")))
        # rows of scopes with pivots only: at most as many as there are pivots
        self.bounds = {(r.scope, r.shard): (r.held, r.near, r.far) for r in (self.shards.collect() if self.pivots else [])}

    def _asked(self, queries: DataFrame, k: int) -> DataFrame:
        """query, scope, vec, shard, first and bound (the least distance of the shard) for all shards of the query's scope."""
        sent = self.dealt.sparkSession.sparkContext.broadcast((self.pivots, self.bounds))
        q = queries.select("scope", "query", F.col("vec").cast("array<double>").alias("vec"))
        shape = T.StructType([*q.schema.fields, T.StructField("shards", T.ArrayType(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("bound", T.DoubleType())])))])
        arrow = to_arrow_schema(shape)

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, held = sent.value
            for b in batches:
                rows, unit = _matrix(b.column("vec"))
                shards: list = [[{"shard": 0, "first": True, "bound": 0.0}]] * len(rows)
                for scope, at in _by_scope(b, rows):
                    if scope not in pivots:
                        continue
                    own = [(s, *held[scope, s]) for s in range(len(pivots[scope])) if (scope, s) in held]
                    number, count, near, far = (np.array(c) for c in zip(*own, strict=True))
                    for i, away in zip(at, _distance(unit[at] @ pivots[scope][number].T), strict=True):
                        order = np.argsort(away, kind="stable")
                        # one more than k, since a query may meet itself
                        first = np.cumsum(count[order]) - count[order] <= k
                        bound = np.maximum(0, np.maximum(away - far, near - away))
                        shards[i] = [{"shard": int(number[s]), "first": bool(f), "bound": float(bound[s])} for s, f in zip(order, first, strict=True)]
                kept = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(list(unit), arrow.field("vec").type), pa.array(shards, arrow.field("shards").type)], schema=arrow)

        return q.mapInArrow(bounds, shape).select("scope", "query", "vec", F.explode("shards").alias("s")).select("scope", "query", "vec", "s.*")

    def _compare(self, asked: DataFrame, k: int) -> DataFrame:
        """query, id, score: the k best of each block for the queries that are sent there. Equal ids are not compared."""
        pieces = self.shards.withColumn("pieces", F.ceil(F.col("held") / self.block).cast("int")).select("scope", "shard", "pieces")
        own = self.dealt.join(F.broadcast(pieces) if self.pivots else pieces, ["scope", "shard"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
        met = asked.join(pieces, ["scope", "shard"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        # queries are dealt in blocks too: a block of them takes a copy of the piece
        busy = checkpointed(met.groupBy("scope", "shard", "piece").agg(F.ceil(F.count("*") / self.block).cast("int").alias("turns")))
        names = ["scope", "shard", "piece"]
        left = met.join(busy, names).withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int")).select(*names, "turn", "query", "vec")
        right = own.join(busy, names).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select(*names, "turn", "id", "vec")
        shape = T.StructType([T.StructField("query", left.schema["query"].dataType), T.StructField("id", right.schema["id"].dataType), T.StructField("score", T.DoubleType())])
        arrow = to_arrow_schema(shape)

        def best(a: pa.Table, b: pa.Table) -> pa.Table:
            qs, ids = a.column("query").to_pylist(), b.column("id").to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            if qs and ids:
                x, y = (_rows(t.column("vec")) for t in (a, b))
                order = np.argsort(np.array(ids, dtype=object), kind="stable")
                ids, y = [ids[i] for i in order], y[order]
                scores = np.round(x @ y.T, 6)
                # of each row the k + 1 best and all that equal the last of them
                least = np.partition(scores, -k - 1, axis=1)[:, -k - 1] if len(ids) > k + 1 else np.full(len(qs), -np.inf)
                for q, row, low in zip(qs, scores, least, strict=True):
                    near = np.flatnonzero(row >= low)
                    top = [i for i in near[np.argsort(-row[near], kind="stable")][: k + 1] if ids[i] != q][:k]
                    for c, v in zip(out, ([q] * len(top), [ids[i] for i in top], row[top].tolist()), strict=True):
                        c.extend(v)
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

        group = [*names, "turn"]
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(best, shape)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query, id, score (cosine, six decimals), rank of the k best of the query's scope; equal scores by id.

        queries: scope, query (unique), vec. A vector whose id is the query's is left out.
        """
        asked = self._asked(queries, k)
        near = checkpointed(top_k(self._compare(asked.where("first"), k), ["query"], [F.col("score").desc(), F.col("id")], k))
        worst = near.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
        rest = asked.where("not first").join(worst, "query", "left").where(self._reachable())
        far = self._compare(rest.select("scope", "query", "vec", "shard"), k)
        return top_k(near.drop("rank").unionByName(far), ["query"], [F.col("score").desc(), F.col("id")], k)

    @staticmethod
    def _reachable():
        """Whether some vector of the shard can be as good as the k-th best so far."""
        return F.col("worst").isNull() | (F.col("bound") <= F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("worst") - SLACK))) + SLACK)

    def skipped(self, queries: DataFrame, k: int) -> DataFrame:
        """One row: pairs of a query and a vector of its scope, pairs that were compared, and the share that was skipped."""
        asked = self._asked(queries, k).join(self.shards.select("scope", "shard", "held"), ["scope", "shard"])
        near = top_k(self._compare(asked.where("first").select("scope", "query", "vec", "shard"), k), ["query"], [F.col("score").desc(), F.col("id")], k)
        worst = near.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
        looked = F.sum(F.when(F.col("first") | self._reachable(), F.col("held")).otherwise(0))
        sums = asked.join(worst, "query", "left").agg(F.sum("held").alias("pairs"), looked.alias("compared"))
        return sums.withColumn("skipped", 1 - F.col("compared") / F.col("pairs"))
