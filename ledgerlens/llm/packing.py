"""Packing documents into fixed-length sequences by cutting-stock column generation.

Every document is tokenised once. Its full 1024-token pieces are sequences of their own; only the remainder is packed.
The histogram of remainder lengths (classes of ``GRAIN`` tokens, so at most 1024 / GRAIN numbers, whatever the corpus)
goes to the driver, which solves the linear program over patterns: a knapsack dynamic program prices columns until the
bound says that no pattern can save more than GAP. Patterns are rounded down. Documents are ranked inside their class
in Spark and a rank picks pattern, sequence and place. The few documents beyond the rounded patterns (fewer than
classes times pieces of a pattern) are laid end to end and cut at sequence ends, so they cause no padding.

Ids: tiktoken with the ranks of byte_bpe_50k gives the ids of ``tokenizers`` with byte_bpe_50k.json several times
faster. Texts that hold the string of an added token of the json file, and those that tiktoken refuses, go to
``tokenizers`` itself, with its defaults.

Edge cases: a null or empty text is the end id alone; repeated rows are packed one by one; a null doc_id is carried
along; an empty table gives no pieces. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import saved, table

LENGTH, GRAIN, GAP, BUCKETS = 1024, 4, 1e-3, 256


@lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k"):
    """Text to the ids of ``tokenizers`` with add_special_tokens=False."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", [])]

    @lru_cache(maxsize=1)
    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        if not any(t in text for t in added):
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:
                if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
        return slow().encode(text, add_special_tokens=False).ids

    return encode


def _tokenise(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in batches:
            size, crcs, tails = [], [], []
            for text in b.column(1):
                ids = np.array([*encode(text.as_py()), 0], "<u4")
                raw = ids.tobytes()
                size.append(len(ids))
                crcs.append([zlib.crc32(raw[i : i + 4 * length]) for i in range(0, len(raw), 4 * length)])
                tails.append(raw[len(ids) // length * length * 4 :])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())], names=["doc_id", "n", "crcs", "tail"])

    return run


def best_pattern(value: np.ndarray, widths: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable multiset of widths within room."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(widths, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            cand = best[c - widths[:k]] + value[:k]
            if cand[i := int(cand.argmax())] > best[c] + 1e-12:
                best[c], took[c] = cand[i], i
    pattern, c = np.zeros(len(widths), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(widths[took[c]])
    return float(best[room]), pattern


def inverted(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots. Element-wise numpy only: multi-threaded BLAS can hang in a process that has forked."""
    n = len(a)
    work = np.concatenate([a.astype(float), np.eye(n)], axis=1)
    for c in range(n):
        pivot = c + int(np.abs(work[c:, c]).argmax())
        work[[c, pivot]] = work[[pivot, c]]
        work[c] /= work[c, c]
        others = work[:, c].copy()
        others[c] = 0
        work -= np.outer(others, work[c])
    return work[:, n:]


def first_basis(widths: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """First-fit decreasing with fractions: every pattern is used until it exhausts a class, so the columns are triangular."""
    m = len(widths)
    left, basis, x = demand.astype(float), np.zeros((m, m)), np.zeros(m)
    open_ = np.ones(m, bool)
    while open_.any():
        pattern, space = np.zeros(m), room
        for i in np.flatnonzero(open_)[::-1]:
            if n := min(space // int(widths[i]), int(np.ceil(left[i]))):
                pattern[i], space = n, space - n * int(widths[i])
        on = np.flatnonzero(pattern)
        out = on[(left[on] / pattern[on]).argmin()]
        x[out], basis[:, out] = left[out] / pattern[out], pattern
        left = np.maximum(left - x[out] * pattern, 0)
        open_[out] = False
        for i in np.flatnonzero(open_ & (left <= 1e-9)):
            basis[i, i], open_[i] = room // int(widths[i]), False
    return basis, x


def cutting_stock(widths: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often the linear program uses each, by the revised simplex with priced columns."""
    m = len(widths)
    if not m:
        return np.zeros((0, 0), np.int64), np.zeros(0)
    basis, x = first_basis(widths, demand, room)
    inverse = inverted(basis)
    for step in range(rounds):
        price = inverse.sum(axis=0)
        value, column = best_pattern(price, widths, room)
        if value <= 1 + gap:
            break
        d = (inverse * column).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        out = int(ratio.argmin())
        move = ratio[out]
        x = np.maximum(x - move * d, 0)
        x[out] = move
        basis[:, out] = column
        if step % 100 == 99:
            inverse = inverted(basis)
            x = np.maximum((inverse * demand).sum(axis=1), 0)
        else:
            row = inverse[out] / d[out]
            inverse -= np.outer(d, row)
            inverse[out] = row
    return np.rint(basis).astype(np.int64), x


def pack(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = saved(docs.mapInArrow(_tokenise(length), "doc_id long, n long, crcs array<long>, tail binary").withColumn("row", F.monotonically_increasing_id()), "tokenised")
    sized = made.select("doc_id", "row", "n", (F.col("n") % length).alias("r"), F.floor(F.col("n") / length).alias("full"), "crcs").withColumn("kind", F.ceil(F.col("r") / grain)).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(BUCKETS)))

    # ranks inside a class, without a class in one task: ranks inside (class, bucket) after the buckets before it
    counts = saved(sized.groupBy("kind", "bucket").agg(F.count("*").alias("docs"), F.sum("full").alias("fulls")), "pack-counts")
    before = Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("kind", "bucket", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("fulls_before"))
    totals = sorted((r.kind, r.docs, r.fulls) for r in counts.groupBy("kind").agg(F.sum("docs").alias("docs"), F.sum("fulls").alias("fulls")).collect())
    inside = Window.partitionBy("kind", "bucket").orderBy("doc_id", "row")
    ranked = sized.join(starts, ["kind", "bucket"]).withColumn("rank", F.row_number().over(inside) - 1 + F.col("docs_before"))
    ranked = ranked.withColumn("fulls_before", F.col("fulls_before") + F.coalesce(F.sum("full").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = saved(ranked.select("doc_id", "row", "n", "r", "full", "crcs", "kind", "rank", "fulls_before"), "ranked")

    classes = [(k, d) for k, d, _ in totals if k]
    widths, demand = np.array([k for k, _ in classes], np.int64), np.array([d for _, d in classes], np.int64)
    patterns, used = cutting_stock(widths, demand, length // grain)
    times = np.floor(used + 1e-9).astype(np.int64)
    plan, sequences, served = [], 0, np.zeros(len(widths), np.int64)
    for j in np.flatnonzero(times):
        column, place, n = patterns[:, j], 0, int(times[j])
        for i in np.flatnonzero(column):
            n = min(n, int((demand[i] - served[i]) // column[i]))
        if n < 1:
            continue
        for i in np.flatnonzero(column):
            each = int(column[i])
            plan.append((int(widths[i]), int(served[i]), int(served[i]) + each * n, each, sequences, place))
            served[i] += each * n
            place += each
        sequences += n
    # at most (length / grain)^2 rows, whatever the corpus
    places = spark.createDataFrame(plan or [(0, 0, 0, 1, 0, 0)], "kind long, low long, high long, each long, first long, place long")
    hit = (F.col("k") == F.col("kind")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    within = F.col("rank") - F.col("low")
    tails = ranked.where("r > 0").withColumnRenamed("kind", "k").join(F.broadcast(places), hit).select("doc_id", (F.col("full") * length).alias("start"), F.col("r").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("first") + F.expr("(rank - low) div each")).alias("sequence_id"), (F.col("place") + within % F.col("each")).alias("place"))
    line = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("offset", F.coalesce(F.sum("length").over(line), F.lit(0))).drop("place")

    # what the rounded patterns leave: bounded by patterns and classes, laid end to end by decreasing length
    done = spark.createDataFrame([(int(w), int(s)) for w, s in zip(widths, served, strict=True)] or [(0, 0)], "kind long, served long")
    left = ranked.where("r > 0").join(F.broadcast(done), "kind").where("rank >= served").select("row", "r").collect()
    cuts, at = [], 0
    for r in sorted(left, key=lambda r: (-r.r, r.row)):
        start = 0
        while start < r.r:
            size = min(r.r - start, length - at % length)
            cuts.append((r.row, start, size, sequences + at // length, at % length))
            start, at = start + size, at + size
    sequences += -(-at // length)

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [zlib.crc32(t.as_py()[4 * s : 4 * (s + z)]) for t, s, z in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            n = b.column(1)
            start = [x // length * length + s for x, s in zip(n.to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(start, pa.int64()), b.column(4), pa.array(crc, pa.int64()), n, b.column(5), b.column(6)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    small = spark.createDataFrame(cuts or [(-1, 0, 0, 0, 0)], "row long, cut_start long, cut_size long, sequence_id long, offset long")
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rest = made.join(F.broadcast(small), "row").select("doc_id", "n", "tail", "cut_start", "cut_size", "sequence_id", "offset").mapInArrow(checksums, shape)

    bases, at = [], sequences
    for k, _, fulls in totals:
        bases.append((k, at))
        at += fulls
    base = spark.createDataFrame(bases or [(0, 0)], "kind long, base long")
    wholes = ranked.where("full > 0").join(F.broadcast(base), "kind").select("doc_id", "n", (F.col("base") + F.col("fulls_before")).alias("first"), F.posexplode(F.expr("slice(crcs, 1, int(full))")).alias("i", "crc"))
    wholes = wholes.select("doc_id", (F.col("i").cast("long") * length).alias("start"), F.lit(length).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return wholes.unionByName(tails).unionByName(rest)


def op2_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
