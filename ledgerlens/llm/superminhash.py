"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and union-find.

SuperMinHash gives every element a random permutation of the signature's slots; the element's j-th draw lies in
[j, j+1), so its ranks over the slots are correlated and the estimate varies less than with plain MinHash. Once no
slot of a document is above j, later draws cannot win and the document stops.

All work is keyed by row: rows that repeat a doc_id are documents of their own, linked or not by what they say.

Edge cases: null or blank texts have no shingles and link with nothing; texts of fewer than k words have their whole
word sequence as the only shingle; repeated rows and equal texts share one class by a digest of their set; rows without
a doc_id link like others, and a component is named by its smallest doc_id, null if none of its rows has one; an empty
table gives an empty table. Only doc_id, text and the key are read, so other columns can have any name.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .hashing import U, mix, salt, shingle_set
from .store import dropped, saved, table

SHINGLE, SHARE, BANDS, ROWS = 5, 75, 40, 5
#: Hub rounds at most, pairs for each bucket row from which another round is worth it, and bucket rows that a task pairs with.
HUBS, FEW, CHUNK = 2, 1, 4096
#: Standard deviations by which a full signature may fall below the similarity before a pair is taken for different.
DOUBT = 3.3
#: Elements that one vectorised signature step holds at once (about 1 kB each), and shingles that are dealt to parts at once.
STEP, DEAL = 40_000, 400_000


def signatures(elements: np.ndarray, owner: np.ndarray, n: int, slots: int) -> np.ndarray:
    """The (n, slots) signature matrix of n sets; element i belongs to set owner[i]. Values are rank << 32 | draw."""
    sig = np.full(n * slots, np.iinfo(np.uint64).max, U)
    perm = None
    for j in range(slots):
        if not len(elements):
            break
        draw = mix(elements + salt(j + 1))
        pick = j + ((draw >> U(32)) % U(slots - j)).astype(np.int64)
        value = (U(j) << U(32)) | (draw & U(0xFFFFFFFF))
        rows = np.arange(len(elements))
        slot = pick if perm is None else perm[rows, pick].astype(np.int64)
        np.minimum.at(sig, owner * slots + slot, value)
        live = sig.reshape(n, slots).max(axis=1) >= (U(j + 1) << U(32))
        go = live[owner]
        if not go.any():
            break
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint16), (int(go.sum()), 1))
            rows, pick = np.arange(len(perm)), pick[go]
            perm[rows, pick] = 0
        else:
            perm[rows, pick] = perm[rows, j]
            perm = perm[go]
        elements, owner = elements[go], owner[go]
    return sig.reshape(n, slots)


def variance_factor(slots: int, union: int) -> float:
    """SuperMinHash's variance over MinHash's for sets whose union has that size (from the algorithm's paper)."""
    if union < 2 or slots < 2:
        return 1.0
    grow = np.arange(1, slots) / slots
    step = lambda d: (np.maximum(np.arange(1, slots) + d, 0) / slots) ** union
    # l^u / (m-1)^(u-1) is taken relative to m^u to stay in range
    lift = (slots / (slots - 1)) ** (union - 1) * slots
    return float(1 - (grow**union * (step(1) + step(-1) - 2 * grow**union)).sum() * lift / (union - 1))


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    key = mix(np.broadcast_to(np.array([salt(i) for i in range(bands)]), parts.shape[:2]) + U(1))
    for r in range(rows):
        key = mix(key * U(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)
            at = 0
            while at < len(texts):
                sets, total, first = [], 0, at
                while at < len(texts) and (total < STEP or first == at):
                    sets.append(shingle_set(texts[at].as_py(), k))
                    total += len(sets[-1])
                    at += 1
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                keys: list = [None] * len(sets)
                short: list = [None] * len(sets)
                if len(full):
                    owner = np.repeat(np.arange(len(full)), size[full])
                    sig = signatures(np.concatenate([sets[i] for i in full]), owner, len(full), bands * rows)
                    for i, row, values in zip(full, band_keys(sig, bands, rows).view(np.int64), mix(sig).astype(np.uint16).view(np.int16), strict=True):
                        keys[i], short[i] = row, values
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                own = [c.slice(first, len(sets)) for c in b.columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.list_(pa.int16()))], names=[*b.schema.names, "n_shingles", "digest", "bands", "slots"])

    return run


def _similar(k: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(i: int, text: str) -> np.ndarray:
            if i not in kept:
                kept[i] = shingle_set(text, k)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[i]

        for b in batches:
            a, c, x, y = (b.column(i) for i in range(4))
            ok = []
            for i in range(len(a)):
                s, t = of(a[i].as_py(), x[i].as_py()), of(c[i].as_py(), y[i].as_py())
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= share * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([a, c], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _owned(k: int, parts: int):
    """Every shingle of the texts with its document, as a pair of arrays for each part of the hash space that occurs among DEAL shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        nodes: list[int] = []

        def dealt() -> pa.RecordBatch:
            keys = np.concatenate(sets)
            owners = np.repeat(np.array(nodes, np.int64), [len(s) for s in sets])
            sets.clear()
            nodes.clear()
            part = (keys % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, owners, part = keys[order], owners[order], part[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            own = list(zip(first, [*first[1:], len(part)], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int64()), pa.array([keys[x:y].tobytes() for x, y in own], pa.binary()), pa.array([owners[x:y].tobytes() for x, y in own], pa.binary())], names=["part", "keys", "owners"])

        held = 0
        for b in batches:
            for node, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sets.append(shingle_set(text.as_py(), k))
                nodes.append(node)
                held += len(sets[-1])
                if held >= DEAL:
                    yield dealt()
                    held = 0
        if held:
            yield dealt()

    return run


def _private(group: pa.Table) -> pa.Table:
    """How many shingles of this part each document has alone."""
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("keys")])
    owners = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in group.column("owners")])
    _, first, count = np.unique(keys, return_index=True, return_counts=True)
    ids, n = np.unique(owners[first[count == 1]], return_counts=True)
    return pa.table({"node": ids, "private": n.astype(np.int64)})


def verified(pairs: DataFrame, texts: DataFrame, k: int, share: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(_similar(k, share), "a long, b long")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components of what was found before and of new links."""
    return components(found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, share: int = SHARE, bands: int = BANDS, rows: int = ROWS, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) and first for every row of docs.

    first marks one row of each component: the one with the smallest doc_id and, of rows that repeat it, the smallest row.
    key: a column of different numbers without nulls that tells rows apart and is returned too; by default rows are
    numbered here. Equal sets collapse to one node. Buckets with several nodes are linked in two steps. Hub rounds
    compare the members of a bucket with one member of its largest component (at first the one with most bucket
    company, as an original among its edited copies has), while that leaves more than a few pairs to try. Then members
    that are still in different components and share two bands are compared pairwise, so a pair is left out only if
    its ends are linked already: those outside a bucket's largest component meet all its members, dealt into pieces of
    CHUNK rows. At a similarity of 0.75 two of 40 bands of 5 rows are shared with probability 0.9997.
    """
    row = F.col(f"`{key}`").cast("long") if key else F.monotonically_increasing_id()
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"))
    sketch = saved(docs.mapInArrow(_sketch(k, bands, rows), "text string, doc_id long, row long, n_shingles long, digest binary, bands array<long>, slots array<short>"), "sketch")
    # a node is a set of equal documents, named by its smallest row; ids are looked up at the end
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = saved(sketch.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.min(order).alias("least")).select("digest", "node", F.col("least.doc_id").alias("least_id"), F.col("least.row").alias("least_row")), "nodes")
    classes = saved(sketch.select("row", "doc_id", "n_shingles", "digest").join(nodes.select("digest", "node"), "digest", "left").select("row", "doc_id", "n_shingles", "node"), "classes")
    only = sketch.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    own = only.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")).distinct()
    shared = own.groupBy("bucket").agg(F.count("*").alias("company")).where("company > 1")
    buckets = saved(own.join(shared, "bucket"), "buckets")
    company = buckets.groupBy("node").agg(F.sum("company").alias("mass"))
    texts = saved(only.select("node", "text").join(company.select("node"), "node", "left_semi"), "texts")

    apart = lambda x, y: 100 * F.least(x, y) >= share * F.greatest(x, y)  # noqa: E731  sizes that the similarity allows
    found = saved(texts.limit(0).select("node", F.col("node").alias("component")), "found")
    placed = saved(buckets.join(company, "node").withColumn("component", F.col("node")), "placed")
    for turn in range(HUBS + 1):
        parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("own"))
        mixed = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("own").alias("all"), F.sum(F.col("own") * F.col("own")).alias("same"), F.max(F.struct("own", "component")).alias("top")).where("parts > 1")
        mixed = saved(mixed.select("bucket", "all", F.col("top.component").alias("lead"), ((F.col("all") * F.col("all") - F.col("same")) / 2).alias("pairs")), "mixed")
        open_ = saved(placed.join(mixed.select("bucket", "all", "lead"), "bucket"), "open")
        pairs, rows_open = mixed.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0], open_.count()
        dropped(mixed)
        if turn == HUBS or pairs <= FEW * rows_open:
            break
        rank = F.col("mass") if turn == 0 else F.xxhash64("node", F.lit(turn))
        hubs = open_.where("component = lead").groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), (-F.col("node")).alias("minus"), "n")).alias("hub")).select("bucket", (-F.col("hub.minus")).alias("a"), F.col("hub.n").alias("n_a"))
        stars = open_.where("component <> lead" if turn else "true").join(hubs, "bucket").where((F.col("a") != F.col("node")) & apart(F.col("n"), F.col("n_a"))).select("a", F.col("node").alias("b")).distinct()
        old, found = found, _joined(found, verified(stars, texts, k, share))
        again = saved(placed.drop("component").join(found.withColumnRenamed("component", "to"), "node", "left").withColumn("component", F.coalesce("to", "node")).drop("to"), "placed")
        dropped(placed, open_, old)
        placed = again

    last = saved(open_.select("node", "n").distinct(), "last")
    parts = int(last.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // 1_000_000 + 8
    owned = texts.join(last.select("node"), "node", "left_semi").select("node", "text").mapInArrow(_owned(k, parts), "part long, keys binary, owners binary")
    private = owned.groupBy("part").applyInArrow(_private, "node long, private long").groupBy("node").agg(F.sum("private").alias("private"))
    # shingles that no other open document has cannot be in an intersection
    common = last.join(private, "node", "left").select("node", (F.col("n") - F.coalesce("private", F.lit(0))).alias("common")).where(F.col("common") * 100 >= share * F.col("n")).join(only.select("node", "bands", "slots"), "node")
    rest = saved(open_.select("bucket", "all", "lead", "node", "n", "component").join(common, "node"), "rest")
    # pairs inside a bucket's largest component are no pairs to try: its other members meet all, which are dealt into pieces
    pieces = F.ceil(F.col("all") / CHUNK).cast("int")
    side = lambda frame, c, *more: frame.select("bucket", *more, *(F.col(x).alias(f"{x}_{c}") for x in ("node", "n", "component", "common", "bands", "slots")))
    left = side(rest.where("component <> lead").withColumn("meet", F.explode(F.sequence(F.lit(0), pieces - 1))), "a", "meet")
    right = side(rest.withColumn("piece", F.pmod(F.xxhash64("node"), pieces).cast("int")).withColumn("is_lead", F.col("component") == F.col("lead")), "b", "piece", "is_lead")
    bands_both = F.array_intersect("bands_a", "bands_b")
    # a pair at the similarity has a union of (n_a + n_b) / (1 + J); 64 of the sum are 32 of half the sum and no more of that
    slots, j = bands * rows, share / 100
    least = [slots * (j - DOUBT * (j * (1 - j) / slots * min(1.0, variance_factor(slots, int(64 * (i + 1) / (1 + j)) + 1))) ** 0.5) for i in range(48)]
    alike = F.aggregate(F.zip_with("slots_a", "slots_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    met = (left.bucket == right.bucket) & (left.meet == right.piece)
    new = (F.col("component_a") != F.col("component_b")) & (F.col("is_lead") | (F.col("component_a") < F.col("component_b")))
    close = new & ((100 + share) * F.least("common_a", "common_b") >= share * (F.col("n_a") + F.col("n_b"))) & (F.size(bands_both) > 1) & (F.array_min(bands_both) == left.bucket) & (alike >= F.element_at(F.array(*map(F.lit, least)), F.least(F.floor((F.col("n_a") + F.col("n_b")) / 64) + 1, F.lit(len(least))).cast("int")))
    cross = left.join(right, met & close).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    final = _joined(found, verified(cross, texts, k, share))
    named = saved(nodes.join(final, "node", "left").select("node", "least_id", "least_row", F.coalesce("component", "node").alias("component")), "named")
    heads = named.groupBy("component").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "least_row")).alias("head"))
    to = saved(named.join(heads, "component").select("node", F.col("head.least_id").alias("component_id"), F.col("head.least_row").alias("head")), "heads")
    out = classes.join(to, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    dropped(sketch, nodes, placed, open_, last, rest, texts, buckets, found, named)
    keys = [F.col("row").alias(key)] if key else []
    return out.select(*keys, "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), F.coalesce(F.col("row") == F.col("head"), F.lit(True)).alias("first"))


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
