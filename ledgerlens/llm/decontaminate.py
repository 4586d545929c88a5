"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Words (lower-cased runs of letters, digits and non-ASCII characters) are the symbols. An item of L words leaks into a
document if some stretch of the document is within floor(L / 4) word edits of it. The CGK random walk copies a window
word by word and moves on by a random bit of (step, word), so edits become few Hamming differences; keys of a few
sampled steps are compared with the items' keys, over as many walks as the target recall needs (measured on mutated
items, without a cap; a size that not even ``MOST`` walks would serve is compared without the LSH, each window with each
item of that size). Windows have an item's size and start at every word, but a window is embedded only if it holds as
many word pairs of items of that size as any true match must (L - 1 - 2 * edits), which loses nothing. Every collision is
verified by bit-parallel edit distance on the whole neighbourhood.

The items are the query set: they are taken in blocks of at most about ``BLOCK``. One block's index is on the driver at a
time; its hits are written before the next block is read, so the driver's memory does not grow with the items.

Edge cases: null and empty texts hold no passage; items of fewer than two words or without text never match; equal
items are reported each; repeated rows give one row for each (doc_id, item_id); rows with a null doc_id are reported
under null; empty tables give no rows. Only doc_id, text, item_id and text are read; ``leaking`` carries all columns of
docs, whatever their names but that of its own last column.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .hashing import U, hash_all, mix, salt
from .store import dropped, saved, table

EDITS, SAMPLED, RECALL, BLOCK = 0.25, 3, 0.99, 20_000
#: Walks to which the target recall is sought by LSH, and (walk, window) cells that are embedded at once.
MOST, CELLS = 2048, 400_000
#: Bytes that are no letters, digits or non-ASCII, as blanks.
BLANKS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PAD = mix(np.array([salt(55)]))[0]


def words(text: str | None) -> np.ndarray:
    return hash_all(text.lower().encode("utf-8", "surrogatepass").translate(BLANKS).split()) if text else np.zeros(0, U)


def pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * U(0xD6E8FEB86659FD93) + h[1:])


def walk_keys(windows: np.ndarray, steps: np.ndarray, seed: int) -> np.ndarray:
    """(walks, windows) LSH keys. steps: a row of sampled step numbers for each walk."""
    walks, (n, size) = len(steps), windows.shape
    padded = np.concatenate([windows, np.full((n, 1), PAD)], axis=1)
    at = np.zeros((walks, n), np.int64)
    key = np.broadcast_to(np.array([salt(seed + w) for w in range(walks)])[:, None], (walks, n)).copy()
    row = np.arange(n)[None, :]
    for j in range(int(steps.max()) + 1 if walks else 0):
        symbol = padded[row, at]
        if (taken := (steps == j).any(axis=1)).any():
            key[taken] = mix(key[taken] * U(0xD6E8FEB86659FD93) + symbol[taken])
        # the top bit of a product with a random odd number of this walk and step
        turn = np.array([salt((seed + w) * 2**32 + j) | U(1) for w in range(walks)])[:, None]
        at = np.minimum(at + (symbol * turn >> U(63)).astype(np.int64), size)
    return key


def edit_match(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the pattern to any stretch of the text, and the first end of such a stretch (Myers)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text.tolist()):
        eq = masks.get(w, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(zero | up) & full, up & zero
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(zero | plus) & full, plus & zero
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """The LSH of a block of items, by word count."""

    def __init__(self, items: list[tuple[int, str | None]], edits: float = EDITS, sampled: int = SAMPLED, recall: float = RECALL, seed: int = 1):
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, text in items:
            if len(h := words(text)) >= 2:
                by.setdefault(len(h), []).append((i, h))
        self.seed, self.groups = seed, []
        for size, members in sorted(by.items()):
            k = int(edits * size)
            matrix = np.stack([h for _, h in members])
            rng = random.Random(size)
            reach = size + size // 4 + 1
            draws = lambda n: np.array([sorted(rng.sample(range(reach), min(sampled, reach))) for _ in range(n)])
            draw = draws(128)
            walks = self._walks(matrix, draw, k, recall, rng)
            draw = (np.concatenate([draw, draws(walks - 128)]) if walks > 128 else draw)[: walks if walks <= MOST else 0]
            keys = walk_keys(matrix, draw, seed)
            order = np.argsort(keys, axis=1)
            grams = np.unique(np.concatenate([pairs(h) for _, h in members]))
            self.groups.append((size, k, max(1, size - 1 - 2 * k), [i for i, _ in members], matrix, draw, np.take_along_axis(keys, order, 1), order, grams))
        # distinct pairs of words, and the groups that hold each (those of pair i are at edge[i]..edge[i + 1] of member)
        every = np.concatenate([g[-1] for g in self.groups]) if self.groups else np.zeros(0, U)
        group = np.repeat(np.arange(len(self.groups)), [len(g[-1]) for g in self.groups])
        order = np.argsort(every, kind="stable")
        self.grams, counts = np.unique(every, return_counts=True)
        self.member, self.edge = group[order], np.concatenate([[0], np.cumsum(counts)])
        self.needs = np.array([g[2] for g in self.groups], np.int64)
        self.bits = max(16, int(math.log2(len(self.grams) + 1)) + 8)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.grams)] = True

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> U(64 - self.bits)).astype(np.int64)

    def _walks(self, matrix: np.ndarray, draw: np.ndarray, k: int, recall: float, rng: random.Random) -> int:
        """Walks that find an item with k random edits with the wanted probability, as measured on edited items.

        Edits differ in how far they throw the walks off, so misses are averaged over edited items and not over walks.
        """
        if not k:
            return 2
        size = matrix.shape[1]
        sample = matrix[[rng.randrange(len(matrix)) for _ in range(120)]]
        changed = sample.copy()
        for r in changed:
            h = r.tolist()
            for _ in range(k):
                p, what = rng.randrange(len(h)), rng.random()
                if what < 0.4:
                    h[p] = rng.getrandbits(64)
                elif what < 0.7 and len(h) > 1:
                    del h[p]
                else:
                    h.insert(p, rng.getrandbits(64))
            r[:] = np.array((h + [int(PAD)] * size)[:size], U)
        same = (walk_keys(sample, draw, self.seed) == walk_keys(changed, draw, self.seed)).sum(axis=0)
        hit = (same + 0.25) / (len(draw) + 0.5)
        walks = 4
        while walks <= MOST and ((1 - hit) ** walks).mean() > 1 - recall:
            walks = math.ceil(walks * 1.1)
        return walks

    def leaks(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(document's position, item_id, edits, item's words, first word) for a batch of hashed documents."""
        spots: list[list[tuple[int, np.ndarray]]] = [[] for _ in self.groups]
        for d, h in enumerate(docs):
            if len(h) < 2 or not len(self.grams):
                continue
            g = pairs(h)
            at = np.flatnonzero(self.seen[self._slot(g)])
            if not len(at):
                continue
            which = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
            exact = self.grams[which] == g[at]
            at, which = at[exact], which[exact]
            many = self.edge[which + 1] - self.edge[which]
            own = np.repeat(at, many)
            group = self.member[np.repeat(self.edge[which], many) + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)]
            for i in np.flatnonzero(np.bincount(group, minlength=len(self.groups)) >= self.needs):
                spots[i].append((d, own[group == i]))
        for (size, k, need, ids, matrix, steps, keys, order, _), held in zip(self.groups, spots, strict=True):
            where, windows = [], []
            for d, own in held:
                # starts whose next size + k words hold the needed pairs, no more than the edits before a hit
                span = size + k - 1
                enough = own[: len(own) - need + 1]
                enough = enough[own[need - 1 :] - enough < span]
                if not len(enough):
                    continue
                near = np.unique((enough[:, None] - np.arange(2 * k + 2)[None, :]).ravel())
                near = near[near >= 0]
                count = np.searchsorted(own, near + span) - np.searchsorted(own, near)
                h = docs[d]
                for s in near[count >= need]:
                    w = h[s : s + size]
                    windows.append(w if len(w) == size else np.concatenate([w, np.full(size - len(w), PAD)]))
                    where.append((d, int(s)))
            if not windows:
                continue
            found: set[tuple[int, int]] = set()
            if not len(steps):
                found.update((w, x) for w in range(len(windows)) for x in range(len(ids)))
            at_once = max(1, CELLS // max(1, len(steps)))
            for lo in range(0, len(windows) if len(steps) else 0, at_once):
                got = walk_keys(np.stack(windows[lo : lo + at_once]), steps, self.seed)
                for r in range(len(steps)):
                    a, b = np.searchsorted(keys[r], got[r], "left"), np.searchsorted(keys[r], got[r], "right")
                    for w in np.flatnonzero(b > a):
                        found.update((lo + int(w), int(order[r, x])) for x in range(a[w], b[w]))
            best: dict[tuple[int, int], tuple[int, int]] = {}
            tried: dict[tuple[int, int], int] = {}
            for w, x in sorted(found):
                d, s = where[w]
                if s <= tried.get((d, x), -1):
                    continue
                tried[d, x] = s + k  # the stretch tried below covers matches that start up to here
                lo, hi = max(0, s - k), s + size + 2 * k
                dist, end = edit_match(matrix[x], docs[d][lo:hi])
                if dist <= k and dist < best.get((d, x), (size, 0))[0]:
                    _, back = edit_match(matrix[x][::-1], docs[d][lo : lo + end][::-1])
                    best[d, x] = dist, lo + end - back
            for (d, x), (dist, first) in best.items():
                yield d, ids[x], dist, size, first


def leaking(docs: DataFrame, items: DataFrame, edits: float = EDITS, recall: float = RECALL, block: int = BLOCK, column: str = "leaks") -> DataFrame:
    """docs with an array column of the items that leak into each row: item_id, edits, item_words, first_word of their best place."""
    if column in docs.columns:
        raise ValueError(f"docs has a column {column}: pass another name as column=")
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = max(1, math.ceil(items.count() / block))
    wide = docs.select(F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    kind = StructType([StructField("item_id", LongType()), *(StructField(c, IntegerType()) for c in ("edits", "item_words", "first_word"))])
    hits = ArrayType(kind)
    shape = StructType([*wide.schema, StructField("found", hits)])
    out, held = wide.withColumn("found", F.lit(None).cast(hits)), []
    for part in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == part).collect()
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in own], edits, recall=recall))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 500):
                    b = whole.slice(lo, 500)
                    found: list[list[dict]] = [list(x or ()) for x in b.column(2).to_pylist()]
                    for d, i, dist, size, first in index.value.leaks([words(t.as_py()) for t in b.column(0)]):
                        found[d].append({"item_id": i, "edits": dist, "item_words": size, "first_word": first})
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, b.schema.field(2).type)], names=["text", "whole", "found"])

        out = out.mapInArrow(run, shape)
        if blocks > 1:
            out = saved(out, "leaking")
            dropped(*held)
            held = [out]
            index.destroy()
    return out.select("whole.*", F.col("found").alias(column))


def leaks(docs: DataFrame, items: DataFrame, edits: float = EDITS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, edits, item_words, first_word: the best place of every item that leaks into a document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = leaking(own, items, edits, recall, block).select("doc_id", F.explode("leaks").alias("hit")).select("doc_id", "hit.*")
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "first_word", "item_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.edits", "m.item_words", "m.first_word")


def op7_cgk_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
