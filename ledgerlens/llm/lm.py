"""Interpolated modified Kneser-Ney trigram model, counted in Spark and scored from memory-mapped sorted arrays.

Words are counted first: each task folds its documents into sorted (hash, count) arrays and sends every shard one blob,
so a frequent word travels once per task, and a shard writes its words as arrays sorted by 64-bit hash. A word's place in
these arrays is its id, so ids are dense, exact and 32 bits wide (more than 4.29e9 distinct words are refused). Trigrams
are then counted in the same way as (two ids, id) keys. A shard of trigrams writes its counts and the sums of its
contexts, and sends on for each pair (v, w) how many words come before it; shards of pairs do the same for single words.
Pairs at the beginning of a text, which nothing comes before, keep their plain counts. Shards are as many as the
number of training tokens asks for (``SHARD`` each), so a task's memory does not grow with the corpus. Contexts are dealt
by the hash of their first word, or of both if the first holds much of the corpus; those of two words (or one) that each
hold much of it are dealt by the whole n-gram, and their sums are merged apart, so that no context is one task's alone.

Arrays take few bytes for each n-gram: pairs are trees of distinct first ids, offsets and second ids (4 bytes a pair),
trigrams are offsets and last ids below the pairs, and counts are a byte each with the few large ones apart. Shuffle files
of a stage go before the next one writes.

The arrays that a task makes of its shard are one file in the shared folder (written under another name and then renamed,
so a task that runs twice is harmless). Scoring: workers map the files and look up batches of sorted keys; a worker holds
a limited number of maps at once, however many shards there are. Nothing of the model is on the driver but its discounts
and the words that are dealt apart (fewer than twice the shards).

Edge cases: a null or empty text is one end token; rows without doc_id are scored as held out and never learned from;
an empty training set gives base and model the uniform distribution over end and unknown; repeated rows count as often
as they occur; an empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import mmap
import os
import resource
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import U, hash_all, mix, salt, words_of
from .store import dropped, released, saved, shared_dir, table

END = mix(np.array([salt(101)]))[0]
#: Tokens that are counted or scored at once, and training tokens of a shard.
STEP, SHARD = 2_000_000, 1_500_000
#: The count from which counts stand apart from their byte, and the places that share one whole offset.
LARGE, NEAR = 255, 16
#: Files that a worker maps at once, at most (a map holds a file descriptor), and the bytes that arrays begin at multiples of.
MAPS, ALIGN = 4096, 64
#: Ids of the place before a text and of words that were not learned.
NONE, UNKNOWN = 2**32 - 1, 2**32 - 2


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the text's words and of the end."""
    return np.append(hash_all(words_of(text)), END)


def _range_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def _among(ids: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which of the ids are in the sorted array."""
    if not len(hot):
        return np.zeros(len(ids), bool)
    return hot[np.minimum(np.searchsorted(hot, ids), len(hot) - 1)] == ids


def _shard(context: np.ndarray, word: np.ndarray, apart: np.ndarray, shards: int) -> np.ndarray:
    """By context, or by the whole n-gram where apart."""
    own = mix(context + salt(3))
    return (np.where(apart, mix(own + word.astype(U)), own) % U(shards)).astype(np.int64)


def _home(context: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What a context of two words is dealt by: its first word, or both where the first is one of the hot ones."""
    return np.where(_among(context >> U(32), hot), context, context & ~U(0xFFFFFFFF))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _blobs(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order]
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(shard)) if len(cut) else cut
    wide = counts.astype(np.uint64) if len(counts) and counts.max() >= 2**32 else counts.astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[cut] if len(cut) else cut, pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([wide[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
        names=["shard", "keys", "counts"],
    )


def _read(group: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for k, c in zip(group.column("keys"), group.column("counts"), strict=True):
        keys = np.frombuffer(k.as_buffer(), np.uint64)
        size = len(c.as_buffer()) // max(1, len(keys))
        out.append((keys, np.frombuffer(c.as_buffer(), np.uint64 if size == 8 else np.uint32).astype(np.int64)))
    return out


class Bundle:
    """A file of named arrays: one after the other, then their places as JSON, then its length."""

    def __init__(self, folder: str, name: str) -> None:
        self.path = f"{folder}/{name}.arrays"
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.file, self.index = open(self.part, "wb"), {}

    def __enter__(self) -> Bundle:
        return self

    def write(self, name: str, array: np.ndarray) -> None:
        self.file.write(bytes(-self.file.tell() % ALIGN))
        self.index[name] = array.dtype.str, self.file.tell(), len(array)
        self.file.write(memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")

    def __exit__(self, kind, *_) -> None:
        index = json.dumps(self.index).encode()
        self.file.write(index + len(index).to_bytes(8, "little"))
        self.file.close()
        if kind is None:
            os.replace(self.part, self.path)


def _opened(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file that a Bundle wrote, mapped; none if there is no such file."""
    if not os.path.exists(path):
        return {}
    with open(path, "rb") as f:
        whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(whole[-8:], "little")
    return {name: np.frombuffer(whole, kind, n, at) for name, (kind, at, n) in json.loads(whole[-8 - size : -8]).items()}


def _counter(keys_of, shard_of):
    """mapInArrow function: the partition's (key, count) arrays, a blob for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list = []
        fresh: list = []
        held = 0

        def fold() -> None:
            if fresh:
                keys, counts = np.unique(np.concatenate(fresh), return_counts=True)
                done.append((keys, counts))
                fresh.clear()
            if len(done) > 1 and len(done[-1][0]) * 2 > len(done[0][0]):
                done[:] = [_merge(done)]

        for b in batches:
            for text in b.column(0):
                fresh.append(keys_of(tokens(text.as_py())))
                held += len(fresh[-1])
                if held > STEP:
                    fold()
                    held = 0
            if done and sum(len(k) for k, _ in done) > 3 * STEP:
                keys, counts = _merge(done)
                done.clear()
                yield _blobs(shard_of(keys), keys, counts)
        fold()
        if done:
            keys, counts = _merge(done)
            yield _blobs(shard_of(keys), keys, counts)

    return run


def _trigrams(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each token as one key, and the token. starts: where texts begin."""
    one, two = np.roll(ids, 1), np.roll(ids, 2)
    one[starts] = two[starts] = NONE
    second = starts[starts + 1 < len(ids)] + 1
    two[second] = NONE
    return two << U(32) | one, ids


def _counted(context: np.ndarray, word: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) in order, with their counts added up."""
    firsts, of = np.unique(context, return_inverse=True)
    keys = of.astype(U) << U(32) | word.astype(U)
    if times is None:
        keys, times = np.unique(keys, return_counts=True)
    else:
        keys, times = _merge([(keys, times)])
    return firsts[(keys >> U(32)).astype(np.int64)], (keys & U(0xFFFFFFFF)).astype(np.uint32), times


def _narrow(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max(initial=0))
    return counts.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist() if len(x) else []
    return list(zip(first, [*first[1:], len(x)], strict=False))


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def unpacked(x: pa.BinaryScalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x.as_buffer())


def _gram_blobs(shard: np.ndarray, context: np.ndarray, word: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(shard, kind="stable")
    parts = [order[x:y] for x, y in _runs(shard[order])]
    # contexts come in order, so their differences are small numbers
    steps = lambda p: np.diff(context[p].astype(U), prepend=U(0))
    cells = [[shard[p[0]] for p in parts], *([packed(x(p)) for p in parts] for x in (steps, lambda p: word[p], lambda p: _narrow(times[p])))]
    return pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cells[1:])], names=["shard", "context", "word", "times"])


def _gram_read(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for c, w, t in zip(group.column("context"), group.column("word"), group.column("times"), strict=True):
        context, word, own = np.cumsum(np.frombuffer(unpacked(c), np.uint64), dtype=np.uint64), np.frombuffer(unpacked(w), np.uint32), unpacked(t)
        kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(own) // max(1, len(word))]
        parts.append((context, word, np.frombuffer(own, kind).astype(np.int64)))
    return _counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))


GRAMS = "shard long, context binary, word binary, times binary"
BLOBS = "shard long, keys binary, counts binary"
STATS = "types long, tokens long, n1 long, n2 long, n3 long, n4 long"


def _stats(counts: np.ndarray) -> list[int]:
    return [len(counts), int(counts.sum())] + [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def _sums(rows: DataFrame) -> list[int]:
    names = [x.split()[0] for x in STATS.split(", ")]
    return [int(v) for v in rows.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in names)).first()]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; 0.5, 1, 1.5 where the counts of counts are too thin for them."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(x if 0 < x < i + 1 else 0.5 * (i + 1) for i, x in enumerate(d))


class Arrays:
    """Sorted arrays of shards in a folder, mapped when they are read; those read last stay mapped."""

    #: Which file an array is in, by the first part of its name.
    FILES = {"word": "words", "count": "words", "context": "contexts", "gram": "contexts", "times": "contexts", "pair": "pairs", "head": "pairs", "next": "singles", "befores": "singles", "apart": "apart"}

    def __init__(self, folder: str):
        self.folder, self.maps, self.most = folder, OrderedDict(), 0

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "maps": OrderedDict(), "most": 0}

    def map(self, name: str, shard: int) -> np.ndarray | None:
        key = f"{self.FILES[name.partition('-')[0]]}-{shard}"
        if key in self.maps:
            self.maps.move_to_end(key)
        else:
            self.most = self.most or max(16, min(MAPS, resource.getrlimit(resource.RLIMIT_NOFILE)[0] // 2))
            while len(self.maps) >= self.most:
                self.maps.popitem(last=False)
            self.maps[key] = _opened(f"{self.folder}/{key}.arrays")
        return self.maps[key].get(name)

    def each(self, shard: np.ndarray):
        """(shard, places) of the shards that occur."""
        order = np.argsort(shard, kind="stable")
        for x, y in _runs(shard[order]):
            yield int(shard[order[x]]), order[x:y]

    def find(self, keys: np.ndarray, shard: np.ndarray, index: str, *columns: str) -> list[np.ndarray]:
        """Values of keys in the arrays of their shards; 0 where absent. Without columns: places, -1 where absent."""
        out = [np.zeros(len(keys)) for _ in columns] or [np.full(len(keys), -1)]
        for s, own in self.each(shard):
            there = self.map(index, s)
            if there is None or not len(there):
                continue
            want = keys[own].astype(there.dtype)
            at = np.minimum(np.searchsorted(there, want), len(there) - 1)
            hit = there[at] == want
            if not columns:
                out[0][own[hit]] = at[hit]
            for o, c in zip(out, columns, strict=False):
                o[own[hit]] = self.map(c, s)[at[hit]]
        return out


    def places(self, first: np.ndarray, second: np.ndarray, shard: np.ndarray, name: str) -> np.ndarray:
        """Places of the pairs in the trees of their shards (see ``_tree``); -1 where absent."""
        out = np.full(len(first), -1)
        for s, own in self.each(shard):
            head = self.map(f"{name}-head", s)
            if head is None or not len(head):
                continue
            want = first[own].astype(head.dtype)
            at = np.minimum(np.searchsorted(head, want), len(head) - 1)
            hit = head[at] == want
            out[own[hit]] = _within(self.map(f"{name}-tail", s), *self.stretch(name, s, at[hit]), second[own[hit]])
        return out

    def stretch(self, name: str, shard: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where what stands below each place starts and ends."""
        start, base = self.map(f"{name}-from", shard), self.map(f"{name}-base", shard)
        at = lambda i: start[i].astype(np.int64) + (0 if base is None else base[i // NEAR])
        return at(place), at(place + 1)

    def values(self, name: str, shard: int, place: np.ndarray) -> np.ndarray:
        """Counts at places; those that a byte cannot hold stand apart."""
        out = self.map(name, shard)[place].astype(np.int64)
        large = np.flatnonzero(out == LARGE)
        if len(large):
            out[large] = self.map(f"{name}-large", shard)[np.searchsorted(self.map(f"{name}-at", shard), place[large])]
        return out

    def below(self, place: np.ndarray, word: np.ndarray, shard: np.ndarray, name: str) -> np.ndarray:
        """Places of the words among those of the places of another array; -1 where absent or where the place is."""
        out = np.full(len(place), -1)
        for s, own in self.each(shard):
            own = own[place[own] >= 0]
            if len(own):
                out[own] = _within(self.map(f"{name}-tail", s), *self.stretch(name, s, place[own]), word[own])
        return out

    def at(self, place: np.ndarray, shard: np.ndarray, *columns: str) -> list[np.ndarray]:
        """Counts at places; 0 where the place is -1."""
        out = [np.zeros(len(place)) for _ in columns]
        for s, own in self.each(shard):
            own = own[place[own] >= 0]
            for o, c in zip(out, columns if len(own) else (), strict=False):
                o[own] = self.values(c, s, place[own])
        return out

    def sums(self, place: np.ndarray, shard: np.ndarray, name: str, below: str) -> list[np.ndarray]:
        """total, ones, twos and more of contexts; more are those that are neither, so they need no array."""
        total, ones, twos = self.at(place, shard, *(f"{name}-{x}" for x in ("total", "ones", "twos")))
        count = np.zeros(len(place))
        for s, own in self.each(shard):
            own = own[place[own] >= 0]
            if len(own):
                start, end = self.stretch(below, s, place[own])
                count[own] = end - start
        return [total, ones, twos, count - ones - twos]


def _within(sorted_: np.ndarray, start: np.ndarray, end: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The place of each wanted value in its own stretch of a sorted array; -1 where it is not."""
    low, high, stop = start.astype(np.int64), end.astype(np.int64), end.astype(np.int64)
    want = want.astype(sorted_.dtype)
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) >> 1
        less = sorted_[mid] < want[live]
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]
        live = live[low[live] < high[live]]
    found = np.flatnonzero(low < stop)
    out = np.full(len(want), -1)
    found = found[sorted_[low[found]] == want[found]]
    out[found] = low[found]
    return out


def _tree(out: Bundle, name: str, keys: np.ndarray) -> None:
    """Sorted pairs (two ids in one key) as distinct first ids, where the stretch of each begins, and second ids: 4 bytes a pair."""
    head = keys >> U(32)
    first = np.flatnonzero(np.append(True, head[1:] != head[:-1])) if len(keys) else np.zeros(0, np.int64)
    out.write(f"{name}-head", head[first].astype(np.uint32))
    _write_offsets(out, name, np.append(first, len(keys)))
    out.write(f"{name}-tail", (keys & U(0xFFFFFFFF)).astype(np.uint32))


def _write_offsets(out: Bundle, name: str, places: np.ndarray) -> None:
    """Increasing places as 2 bytes each beyond every NEAR-th one, or as 4 or 8 where stretches are too long for that."""
    base = places[::NEAR]
    beyond = places - base[np.arange(len(places)) // NEAR]
    wide = np.int32 if places[-1] < 2**31 else np.int64
    if beyond.max(initial=0) < 2**16:
        out.write(f"{name}-base", base.astype(wide))
        out.write(f"{name}-from", beyond.astype(np.uint16))
    else:
        out.write(f"{name}-from", places.astype(wide))


def _write_counts(out: Bundle, name: str, counts: np.ndarray) -> None:
    """Counts as a byte each; the few that need more stand apart with their places."""
    large = np.flatnonzero(counts >= LARGE)
    if len(large):
        out.write(f"{name}-at", large.astype(np.int64))
        out.write(f"{name}-large", _narrow(counts[large]))
    out.write(name, np.minimum(counts, LARGE).astype(np.uint8))


@dataclass
class Words:
    """Ids and counts of the words: an id is a word's place in the arrays of all shards."""

    arrays: Arrays
    shards: int
    offsets: np.ndarray
    types: int
    tokens: int

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        shard = _range_shard(hashes, self.shards)
        at = self.arrays.find(hashes, shard, "word")[0]
        return np.where(at >= 0, at + self.offsets[shard], UNKNOWN).astype(U)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        return self.arrays.find(hashes, _range_shard(hashes, self.shards), "word", "count")[0]


def _cut(n: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.select([n == 0, n == 1, n == 2], [0, discounts[0], discounts[1]], discounts[2])


@dataclass
class Model:
    words: Words
    shards: int
    hot: np.ndarray  # ids of words that are dealt apart, sorted
    hot_sums: np.ndarray  # of the pairs that begin with each of them: total, ones, twos, more
    discounts: list[tuple[float, float, float]]  # of single words, pairs and trigrams
    floor: float
    total: int

    @property
    def tokens(self) -> int:
        return self.words.tokens

    @property
    def types(self) -> int:
        return self.words.types

    def p_word(self, ids: np.ndarray) -> np.ndarray:
        n = self.words.arrays.find(ids, (mix(ids) % U(self.shards)).astype(np.int64), "next", "befores")[0]
        return (n - _cut(n, self.discounts[0])) / max(1, self.total) + self.floor

    def _back(self, total: np.ndarray, kinds: list[np.ndarray], discounts: tuple[float, float, float]) -> np.ndarray:
        return np.where(total > 0, sum(d * x for d, x in zip(discounts, kinds, strict=True)) / np.maximum(total, 1), 1.0)

    def p_pair(self, one: np.ndarray, word: np.ndarray, low: np.ndarray) -> np.ndarray:
        """P of word after one. low: P of word by itself."""
        heads, of = np.unique(one, return_inverse=True)
        apart = _among(heads, self.hot)
        arrays, home = self.words.arrays, _shard(heads, heads, apart & False, self.shards)
        total, *kinds = arrays.sums(arrays.find(heads, home, "pair-head")[0], home, "head", "pair")
        for col, x in enumerate((total, *kinds)):
            x[apart] = self.hot_sums[np.searchsorted(self.hot, heads[apart]), col]
        shard = _shard(one, word, apart[of], self.shards)
        n = arrays.at(arrays.places(one, word, shard, "pair"), shard, "pair-befores")[0]
        return (n - _cut(n, self.discounts[1])) / np.maximum(total, 1)[of] + self._back(total, kinds, self.discounts[1])[of] * low

    def p_trigram(self, context: np.ndarray, word: np.ndarray, low: np.ndarray) -> np.ndarray:
        """P of word after the two words of context. low: P of word after the last of them."""
        arrays = self.words.arrays
        two, of = np.unique(context, return_inverse=True)
        apart = _among(two >> U(32), self.hot) & _among(two & U(0xFFFFFFFF), self.hot)
        place = _shard(_home(two, self.hot), two, apart & False, self.shards)
        sums = arrays.sums(arrays.places(two >> U(32), two & U(0xFFFFFFFF), place, "context"), place, "context", "gram")
        rest = arrays.find(two[apart], _shard(two[apart], two[apart], apart[apart] & False, self.shards), "apart", "apart-total", "apart-ones", "apart-twos", "apart-more")
        for x, y in zip(sums, rest, strict=True):
            x[apart] = y
        shard = _shard(_home(context, self.hot), word, apart[of], self.shards)
        at = arrays.places(context >> U(32), context & U(0xFFFFFFFF), shard, "context")
        n = arrays.at(arrays.below(at, word, shard, "gram"), shard, "times")[0]
        total, *kinds = sums
        return (n - _cut(n, self.discounts[2])) / np.maximum(total, 1)[of] + self._back(total, kinds, self.discounts[2])[of] * low

    def log10(self, t: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of each token given the two before (starts: where texts begin), and each token's training count."""
        hashes, where = np.unique(t, return_inverse=True)
        ids = self.words.ids(hashes)
        context, word = _trigrams(ids[where], starts)
        pairs, of_pair = np.unique(context, return_inverse=True)
        keys, of = np.unique(of_pair.astype(U) << U(32) | word, return_inverse=True)
        context, word = pairs[(keys >> U(32)).astype(np.int64)], keys & U(0xFFFFFFFF)
        one = context & U(0xFFFFFFFF)
        two_words, of_two = np.unique(one << U(32) | word, return_inverse=True)
        heads, last = two_words >> U(32), two_words & U(0xFFFFFFFF)
        lasts, of_last = np.unique(last, return_inverse=True)
        low = self.p_pair(heads, last, self.p_word(lasts)[of_last])
        return np.log10(self.p_trigram(context, word, low[of_two]))[of], self.words.counts(hashes)[where]


def _sums_of(context: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts of a sorted array, the place of each row's context, and total, ones, twos and more of each."""
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
    sums = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (times, times == 1, times == 2, times > 2)], axis=1) if len(first) else np.zeros((0, 4), np.int64)
    place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
    return context[first], place, sums


NAMES = [x.split()[0] for x in STATS.split(", ")]
FOLDED = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("context", "word", "times")), *((c, pa.int64()) for c in NAMES), ("hot", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])
FOLD = f"{GRAMS}, {STATS}, hot array<long>, sums array<long>"


def _folded(blobs: list[pa.RecordBatch], times: np.ndarray, hot: np.ndarray, sums: np.ndarray) -> pa.Table:
    """Blobs for the next order, and a row of statistics and sums of contexts that are dealt apart."""
    stat = pa.Table.from_pylist([dict(zip(NAMES, _stats(times), strict=True)) | {"hot": hot.astype(U).view(np.int64).tolist(), "sums": sums.ravel().tolist()}])
    empty = lambda x: x.append_column("none", pa.nulls(len(x)))
    whole = pa.concat_tables([empty(pa.Table.from_batches(blobs)) if blobs else empty(stat).slice(0, 0), empty(stat)], promote_options="default")
    return pa.table([whole.column(f.name).cast(f.type) if f.name in whole.column_names else pa.nulls(len(whole), f.type) for f in FOLDED], schema=FOLDED)


def _hot_rows(folded: DataFrame) -> DataFrame:
    """context, s0..s3: the sums of contexts that are dealt apart, over all shards."""
    pieces = folded.where("size(hot) > 0").select(F.posexplode("hot").alias("i", "context"), "sums").select("context", *(F.element_at("sums", F.col("i") * 4 + j + 1).alias(f"s{j}") for j in range(4)))
    return pieces.groupBy("context").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(4)))


def train(docs: DataFrame, folder: str | None = None, shards: int | None = None) -> Model:
    """A model of all texts of docs (doc_id, text). folder: a path that all machines mount (default: in spark.checkpoint.dir)."""
    spark = docs.sparkSession
    place = folder or f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    place = place.removeprefix("file://").removeprefix("file:")
    if "://" in place:
        raise ValueError("memory mapping needs a folder that the machines mount: pass folder=")
    os.makedirs(place, exist_ok=True)
    text = docs.select(F.col("text").cast("string"))
    first = shards or max(8, 2 * text.rdd.getNumPartitions())

    def words(key: tuple, group: pa.Table) -> pa.Table:
        keys, counts = _merge(_read(group))
        with Bundle(place, f"words-{key[0].as_py()}") as out:
            out.write("count", _narrow(counts))
            out.write("word", keys)
        top = np.argsort(-counts)[:64]
        return pa.Table.from_pylist([{"shard": key[0].as_py()} | dict(zip(NAMES, _stats(counts), strict=True)) | {"heavy": top.tolist(), "times": counts[top].tolist()}])

    spark.sparkContext.setJobDescription("count words")
    counted = text.mapInArrow(_counter(lambda t: t, lambda k: _range_shard(k, first)), BLOBS).groupBy("shard").applyInArrow(words, f"shard long, {STATS}, heavy array<long>, times array<long>").collect()
    spark.sparkContext.setJobDescription(None)
    released(spark)
    sizes = np.zeros(first, np.int64)
    for r in counted:
        sizes[r.shard] = r.types
    offsets = np.cumsum(sizes) - sizes
    total, types = sum(r.tokens for r in counted), int(sizes.sum())
    if types > UNKNOWN:
        raise ValueError("more distinct words than 32-bit ids")
    n = shards or max(8, -(-total // SHARD))
    known = Words(Arrays(place), first, offsets, types, total)
    # at most 2 n words hold a share of 1 / 2 n each
    hot = np.array(sorted({NONE, *(int(offsets[r.shard] + i) for r in counted for i, c in zip(r.heavy, r.times, strict=True) if c * 2 * n >= total)}), U)

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counts() -> pa.RecordBatch:
            size = np.array([len(x) for x in held], np.int64)
            hashes, of = np.unique(np.concatenate(held), return_inverse=True)
            context, word, times = _counted(*_trigrams(known.ids(hashes)[of], np.cumsum(size) - size))
            held.clear()
            apart = _among(context >> U(32), hot) & _among(context & U(0xFFFFFFFF), hot)
            return _gram_blobs(_shard(_home(context, hot), word, apart, n), context, word, times)

        for b in batches:
            for t in b.column(0):
                held.append(tokens(t.as_py()))
                if sum(map(len, held[-1:])) > STEP or len(held) % 256 == 0 and sum(map(len, held)) > STEP:
                    yield counts()
        if held:
            yield counts()

    def contexts(key: tuple, group: pa.Table) -> pa.Table:
        context, word, times = _gram_read(group)
        firsts, at, sums = _sums_of(context, times)
        with Bundle(place, f"contexts-{key[0].as_py()}") as out:
            _tree(out, "context", firsts)
            _write_offsets(out, "gram", np.append(0, np.cumsum(np.bincount(at, minlength=len(firsts)))))
            out.write("gram-tail", word.astype(np.uint32))
            _write_counts(out, "times", times)
            for name, x in zip(("total", "ones", "twos"), sums.T, strict=False):
                _write_counts(out, f"context-{name}", x)
        apart = _among(firsts >> U(32), hot) & _among(firsts & U(0xFFFFFFFF), hot)
        one = context & U(0xFFFFFFFF)
        heads, lasts, befores = _counted(one, word, np.where(one == U(NONE), times, 1))
        return _folded([_gram_blobs(_shard(heads, lasts, _among(heads, hot), n), heads, lasts, befores)], times, firsts[apart], sums[apart])

    def pairs(key: tuple, group: pa.Table) -> pa.Table:
        head, word, befores = _gram_read(group)
        firsts, _, sums = _sums_of(head, befores)
        apart = _among(firsts, hot)
        with Bundle(place, f"pairs-{key[0].as_py()}") as out:
            _tree(out, "pair", head << U(32) | word.astype(U))
            _write_counts(out, "pair-befores", befores)
            for name, x in zip(("total", "ones", "twos"), sums.T, strict=False):
                _write_counts(out, f"head-{name}", x)
        ids, n_before = np.unique(word.astype(U), return_counts=True)
        none = np.zeros(len(ids), U)
        return _folded([_gram_blobs((mix(ids) % U(n)).astype(np.int64), none, ids.astype(np.uint32), n_before)], befores, firsts[apart], sums[apart])

    def singles(key: tuple, group: pa.Table) -> pa.Table:
        _, word, befores = _gram_read(group)
        with Bundle(place, f"singles-{key[0].as_py()}") as out:
            out.write("next", word)
            out.write("befores", _narrow(befores))
        return pa.Table.from_pylist([dict(zip(NAMES, _stats(befores), strict=True))])

    def apart_sums(key: tuple, group: pa.Table) -> pa.Table:
        context = group.column("context").to_numpy().view(np.uint64)
        order = np.argsort(context)
        with Bundle(place, f"apart-{key[0].as_py()}") as out:
            out.write("apart", context[order])
            for j, name in enumerate(("total", "ones", "twos", "more")):
                out.write(f"apart-{name}", _narrow(group.column(f"s{j}").to_numpy()[order]))
        return pa.table({"n": pa.array([len(context)], pa.int64())})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            context = b.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_shard(context, context, np.zeros(len(context), bool), n)), *b.columns], names=["shard", *b.schema.names])

    cells = lambda df: df.where("context is not null").select("shard", "context", "word", "times").groupBy("shard")
    three = saved(text.mapInArrow(trigrams, GRAMS).groupBy("shard").applyInArrow(contexts, FOLD), "lm-trigrams")
    released(spark)
    rows = _hot_rows(three).mapInArrow(numbered, "shard long, context long, s0 long, s1 long, s2 long, s3 long")
    rows.groupBy("shard").applyInArrow(apart_sums, "n long").agg(F.sum("n")).collect()
    stats = [_sums(three)]
    two = saved(cells(three).applyInArrow(pairs, FOLD), "lm-pairs")
    dropped(three)
    heads = {r.context: [r.s0, r.s1, r.s2, r.s3] for r in _hot_rows(two).collect()}
    below = _sums(cells(two).applyInArrow(singles, STATS))
    stats = [below, _sums(two), *stats]
    dropped(two)
    discounts = [_discounts(x[2:]) for x in stats]
    mass = sum(d * x for d, x in zip(discounts[0], (below[2], below[3], below[0] - below[2] - below[3]), strict=True)) / below[1] if below[1] else 1.0
    hot_sums = np.array([heads.get(int(h), [0, 0, 0, 0]) for h in hot.view(np.int64)], np.float64).reshape(len(hot), 4)
    return Model(known, n, hot, hot_sums, discounts, mass / (types + 1), below[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = model.tokens + 0.1 * (model.types + 1)
        for b in batches:
            at = 0
            while at < b.num_rows:
                texts, held, first = [], 0, at
                while at < b.num_rows and (held < STEP // 2 or first == at):
                    texts.append(tokens(b.column(1)[at].as_py()))
                    held += len(texts[-1])
                    at += 1
                size = np.array([len(x) for x in texts], np.int64)
                starts = np.cumsum(size) - size
                lp, c = model.log10(np.concatenate(texts), starts)
                base = np.add.reduceat(np.log10((c + 0.1) / floor), starts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(size), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array(base), pa.array(np.add.reduceat(lp, starts))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~is_held_out()))
    out = score(docs, model).withColumns({"held_out": is_held_out(), "train_tokens": F.lit(model.tokens).cast("long")})
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
