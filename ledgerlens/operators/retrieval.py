"""Hybrid recall: BM25, vectors, recency, fusion, diversity, selection and budget packing.

Queries are rows, so many are answered in one job. Candidate lists are cut to their k inside the query's group after a
partial aggregation, and the only broadcast side is the one row of corpus statistics; whether query sets are broadcast is up to the optimizer.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.scoring import SELECT_AT, SELECT_LIMIT, rrf_term

#: The usual BM25 constants.
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """term, key, tf, length: an inverted index. only: the terms (column term) that are asked for; others are not counted."""
    words = docs.select(key, terms(F.col(text)).alias("w")).withColumn("length", F.size("w")).select(key, "length", F.explode("w").alias("term"))
    if only is not None:
        words = words.join(only.select("term").distinct(), "term", "left_semi")
    return words.groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, text: str) -> DataFrame:
    """One row: the number of documents with words and their mean length, from one pass without a shuffle of words."""
    n = F.size(terms(F.col(text)))
    return docs.select(n.alias("n")).where("n > 0").agg(F.count("*").alias("n_docs"), F.avg("n").alias("mean_length"))


def asked(docs: DataFrame, key: str, text: str, only: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``postings`` of the terms that are asked for and ``lengths``, both from one pass over the documents that is kept.

    Each document brings its length along under the empty term, which no document has and no query asks for.
    """
    words = docs.select(key, terms(F.col(text)).alias("w")).select(key, F.size("w").alias("length"), F.explode(F.array_append("w", F.lit(""))).alias("term"))
    wanted = only.select("term").where("term <> ''").union(only.sparkSession.range(1).select(F.lit(""))).distinct()
    index = checkpointed(words.join(wanted, "term", "left_semi").groupBy("term", key, "length").agg(F.count("*").alias("tf")))
    sizes = index.where("term = '' and length > 0")
    return index.where("term <> ''"), sizes.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_docs"), (F.sum(F.col("tf") * F.col("length")) / F.sum("tf")).alias("mean_length"))


def bm25(index: DataFrame, queries: DataFrame, key: str, query: str, k: int, stats: DataFrame | None = None) -> DataFrame:
    """query, key, score, rank: the k best documents of each query by BM25.

    queries: query, term (distinct). stats: ``lengths`` of the documents, else taken from the index. idf is
    log((N - n + 0.5) / (n + 0.5)), not below 1e-6.
    """
    if stats is None:
        stats = index.groupBy(key, "length").agg(F.lit(1).alias("one")).agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    wanted = index.join(queries.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    hits = wanted.join(df, "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = queries.join(hits.select("term", key, weight.alias("w")), "term").groupBy(query, key).agg(F.round(F.sum("w"), 6).alias("score"))
    return top_k(scored, [query], [F.col("score").desc(), F.col(key)], k)


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)


def fuse(lists: DataFrame, query: str, key: str, k: int = 30) -> DataFrame:
    """Weighted reciprocal rank fusion of (query, key, generator, rank)."""
    fused = lists.groupBy(query, key).agg(F.round(F.sum(rrf_term(F.col("generator"), F.col("rank"))), 9).alias("score"), F.array_sort(F.collect_set("generator")).alias("generators"))
    return top_k(fused, [query], [F.col("score").desc(), F.col(key)], k)


def select(scored: DataFrame, query: str, key: str, least: float = SELECT_AT, limit: int = SELECT_LIMIT) -> DataFrame:
    """The best items above the threshold, with the query's abstention: true if none is above it or the top two conflict.

    scored: query, key, score, conflict. A query that abstains for want of items has one row with a null key.
    """
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), key)
    ranked = scored.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("conflicted", F.coalesce(F.max(F.when((F.col("rank") <= 2) & F.col("conflict"), True)).over(Window.partitionBy(query)), F.lit(False)))
    chosen = ranked.where((F.col("score") >= least) & (F.col("rank") <= limit)).select(query, key, "score", "rank", F.col("conflicted").alias("abstain"))
    empty = scored.select(query).distinct().join(chosen.select(query).distinct(), query, "left_anti")
    return chosen.unionByName(empty.select(query, F.lit(True).alias("abstain")), allowMissingColumns=True)


def packed(items: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """Adds ``taken``: items in order while they fit; one that does not fit is skipped and the next is tried.

    Rows are dealt to blocks by ranges of (group, order), so a group may cover many blocks. In a round each group takes
    the rows that fit the remainder up to the first that does not fit any more, found from sums by block; the next round
    goes on behind it with what is left. A round takes at least one row of a size above 0, so their number is bounded by
    the limit. A null size is never taken; rows that share an order are tried by size, one by one.
    """
    rows = items.select(F.col(group).alias("g"), F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("s"))
    dealt = rows.repartitionByRange("g", "o", "s").withColumns({"block": F.spark_partition_id(), "k": F.struct("o", "s", F.monotonically_increasing_id().alias("i"))})
    rows = checkpointed(dealt)
    state = rows.select(F.col("g").alias("of")).distinct().select("of", F.lit(limit).cast("long").alias("left"), F.lit(None).cast(rows.schema["k"].dataType).alias("after"))
    same = F.col("g").eqNullSafe(F.col("of"))
    rounds = []
    while True:
        live = rows.join(state, same).where((F.col("after").isNull() | (F.col("k") > F.col("after"))) & (F.col("s") <= F.col("left"))).drop("of")
        earlier = Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = live.groupBy("g", "left", "block").agg(F.sum("s").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(earlier), F.lit(0)))
        full = sums.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("t") > F.col("left"))).select(F.col("g").alias("of"), F.col("block").alias("at"), "before")
        used = F.col("before") + F.sum("s").over(Window.partitionBy("g").orderBy("k"))
        ends = live.join(full, same & (F.col("block") == F.col("at"))).withColumn("used", used)
        fits = F.col("used") <= F.col("left")
        ends = checkpointed(ends.groupBy("g", "left", "before").agg(F.min(F.when(~fits, F.col("k"))).alias("upto"), F.max(F.when(fits, F.col("used"))).alias("used")))
        rounds.append(state.join(ends.select("g", "upto"), same, "left").select("of", "left", "after", "upto"))
        if ends.isEmpty():
            break
        state = ends.select(F.col("g").alias("of"), (F.col("left") - F.coalesce("used", "before")).alias("left"), F.col("upto").alias("after"))
    spans = functools.reduce(DataFrame.unionByName, rounds).groupBy("of").agg(F.collect_list(F.struct("left", "after", "upto")).alias("spans"))
    inside = lambda x: (x["after"].isNull() | (F.col("k") > x["after"])) & (x["upto"].isNull() | (F.col("k") < x["upto"])) & (F.col("s") <= x["left"])
    taken = F.coalesce(F.exists("spans", inside), F.lit(False))
    return rows.join(spans, same).select(F.col("g").alias(group), F.col("o").alias(order), F.col("s").alias(size), taken.alias("taken"))


def reranked(best: DataFrame, order: Callable[[DataFrame], DataFrame], key: str, score: str) -> DataFrame:
    """key, rank, reranked of a short list of candidates (one ranked list) after a reranker's ``key`` (column key, ascending).

    A reranker that names what was not given to it, or leaves something out, is refused.
    """
    first = Window.orderBy(F.col(score).desc(), key)
    ranked = checkpointed(best.select(key, F.row_number().over(first).cast("long").alias("rank")))
    own = order(best)
    odd = own.join(ranked.select(key), key, "left_anti").limit(1).count() + ranked.join(own.select(key), key, "left_anti").limit(1).count()
    if odd:
        raise ValueError("the reranker may only order what it was given")
    again = Window.orderBy("key", "rank")
    return ranked.join(own, key).select(key, "rank", F.row_number().over(again).cast("long").alias("reranked"))
