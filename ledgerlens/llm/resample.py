"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Both models count the hashed words and word pairs of whole texts in BUCKETS buckets: the raw model over all documents,
the target model over documents labelled good (at most ``ROWS`` labels are used, drawn by hash). A document's log weight
is its mean log ratio of target to raw times ``tokens``: every text counts as that many n-grams. The plain sum over
hundreds of neighbouring n-grams takes them for independent; its spread (tens of thousands) then leaves nothing to the
noise, and clean long texts lose by sheer length. At TOKENS = 30 the log weights of clean and junk texts that lie near
each other differ by a few units, which the noise (standard deviation 1.28) reorders. Adding Gumbel noise (fixed by
doc_id, text and seed) and keeping the k largest keys samples k documents without replacement in proportion to their
weights. k is given, or it is estimated: the number of documents above the ratio that best separates the sampled labels.
Which documents these k are is up to the sampling. The k-th key is found by counting keys in ever narrower ranges, so
nothing is sorted as a whole and no row is collected.

Edge cases: null and empty texts have a log ratio of 0 and no n-grams, and are sampled as such; null labels are ignored;
without text labelled good all ratios are 0, and if either class is missing the cut is 0 (as likely as raw); rows with
equal keys (repeated rows) at the k-th place are all kept; rows that repeat a doc_id with another text are sampled apart;
a null doc_id has the noise of id null and its text; an empty table gives an empty table. ``carry`` names columns of docs
to hand through; a carried column that has the name of a result column is refused.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .hashing import U, hash_all, mix
from .store import saved, table

BUCKETS, ROWS, TOKENS, SMOOTH, SEED = 1 << 16, 50_000, 30.0, 1.0, 42
TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^\sA-Za-z0-9_\x80-\xff]+")
PARTS = 64


def grams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the text's words and punctuation runs and of neighbouring pairs of them."""
    if not text:
        return np.zeros(0, np.int64)
    h = hash_all(TOKEN.findall(text.encode("utf-8", "surrogatepass")))
    both = np.concatenate([mix(h), mix(h[:-1] * U(0xD6E8FEB86659FD93) + h[1:])])
    return (both % U(buckets)).astype(np.int64)


def _sums(target_ids: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            ids = b.column(0).to_pylist()
            at = np.searchsorted(target_ids, np.array([-1 if i is None else i for i in ids]))
            for i, text, p in zip(ids, b.column(1), at, strict=True):
                if len(g := grams(text.as_py(), buckets)):
                    c = np.bincount(g, minlength=buckets) if len(g) > buckets // 8 else None
                    for counts, on in ((raw, True), (good, i is not None and p < len(target_ids) and target_ids[p] == i)):
                        if on and c is not None:
                            counts += c
                        elif on:
                            np.add.at(counts, g, 1)
        step = buckets // PARTS
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), *(pa.array([x[i * step : (i + 1) * step].tobytes() for i in range(PARTS)], pa.binary()) for x in (raw, good))], names=["part", "raw", "good"])

    return run


def _total(key: tuple, group: pa.Table) -> pa.Table:
    add = lambda c: np.sum([np.frombuffer(x.as_buffer(), np.int64) for x in group.column(c)], axis=0).tobytes()
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "raw": pa.array([add("raw")], pa.binary()), "good": pa.array([add("good")], pa.binary())})


def log_ratios(docs: DataFrame, target_ids: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of every bucket; target_ids: sorted doc_ids of the target sample."""
    rows = docs.select("doc_id", "text").mapInArrow(_sums(target_ids, buckets), "part int, raw binary, good binary").groupBy("part").applyInArrow(_total, "part int, raw binary, good binary").collect()
    if not rows:
        return np.zeros(buckets)
    rows.sort(key=lambda r: r.part)
    raw, good = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]).astype(float) for c in ("raw", "good"))
    if not good.sum():
        return np.zeros(buckets)
    return np.log((good + SMOOTH) / (good.sum() + SMOOTH * buckets)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * buckets))


def kth_largest(df: DataFrame, value: str, k: int, fits: int = 2000) -> float:
    """The k-th largest value of a column, by counting inside narrowing ranges; -inf if there are no more than k rows."""
    n, lo, hi = df.agg(F.count(value), F.min(value), F.max(value)).first()
    if k >= n:
        return -math.inf
    if k <= 0:
        return math.inf
    while True:
        inside = df.where(F.col(value).between(lo, hi))
        width = (hi - lo) / 1024
        if width <= 0 or lo + width == lo:
            return hi
        bins = {r.bin: r for r in inside.groupBy(F.least(F.floor((F.col(value) - lo) / width), F.lit(1023)).alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if k <= bins[b].n:
                break
            k -= bins[b].n
        lo, hi = bins[b].lo, bins[b].hi
        if bins[b].n <= fits:
            return sorted((r[0] for r in df.where(F.col(value).between(lo, hi)).select(value).collect()), reverse=True)[k - 1]


def best_cut(values: list[tuple[float, int]]) -> float:
    """The ratio that best separates good (1) from bad (0) labels by balanced accuracy."""
    good, bad = sum(y for _, y in values), sum(1 - y for _, y in values)
    if not good or not bad:
        return 0.0
    values = sorted(values)
    best, cut, low_bad, low_good = -1.0, 0.0, 0, 0
    for i, (v, y) in enumerate(values[:-1]):
        low_bad, low_good = low_bad + 1 - y, low_good + y
        if (gain := low_bad / bad - low_good / good) > best and values[i + 1][0] > v:
            best, cut = gain, (v + values[i + 1][0]) / 2
    return cut


def noise(seed: int = SEED) -> Column:
    """Gumbel noise fixed by doc_id and text."""
    u = (F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, max_labels: int = ROWS, tokens: float = TOKENS, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """doc_id, log_ratio, n_grams, key and kept of every row of docs, after the carried columns. labels: doc_id, quality (1 good)."""
    carry = list(carry or [])
    made = ["log_ratio", "n_grams", "text_hash", "key", "kept"]
    if clash := set(carry) & set(made):
        raise ValueError(f"columns {sorted(clash)} cannot be carried: the result has its own")
    id_, text_ = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    text = docs.select(id_, text_)
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    share = min(1.0, 0.95 * max_labels / max(1, marked.count()))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) < share * 1_000_003).limit(max_labels).collect()
    ratios = log_ratios(text, np.array(sorted(r.doc_id for r in drawn if r.quality), np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            means, n = [], []
            for t in b.column(1):
                g = grams(t.as_py(), len(shared.value))
                n.append(len(g))
                means.append(float(shared.value[g].mean()) if len(g) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *b.columns[3:], pa.array(means, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "text_hash", *b.schema.names[3:], "log_ratio", "n_grams"])

    wide = docs.select(id_, text_, F.xxhash64(text_).alias("text_hash"), *(F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carry)))
    shape = StructType([f for f in wide.schema if f.name != "text"]).add("log_ratio", "double").add("n_grams", "long")
    scored = saved(wide.mapInArrow(weigh, shape), "ratios").withColumn("key", F.col("log_ratio") * tokens + noise(seed))
    if k is None:
        # at most max_labels labels with their documents' ratios
        known = docs.sparkSession.createDataFrame([(r.doc_id, r.quality) for r in drawn] or [(None, 0)], "doc_id long, quality int")
        cut = best_cut([(r.log_ratio, r.quality) for r in scored.join(F.broadcast(known), "doc_id").select("log_ratio", "quality").limit(max_labels).collect()])
        k = scored.where(F.col("log_ratio") >= cut).count()
    out = scored.withColumn("kept", F.col("key") >= kth_largest(scored, "key", k))
    handed = [F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(*handed, *(["doc_id"] if "doc_id" not in carry else []), "log_ratio", "n_grams", "key", "kept")


def op3_gumbel_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
