"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors that are byte-equal collapse to one node first. A label with many nodes gets centroids, fitted on a sample of at
most SAMPLE vectors (the only bounded thing here; every vector is indexed), and each node lives in the shard of its
nearest centroid; a shard beyond BLOCK nodes is dealt into blocks. Each block builds a robust-pruned graph over its
nodes (at most BLOCK, whose pairs are cheaper to look at than an insertion search is). Then every vector searches the
shards that a link of it can lie in: those no farther from it than the other end of a link may be, beyond the bisector
of two centroids. The ends of a link are ``chord`` apart at most; how much of that points across a bisector depends on
how many directions the vectors of a shard spread over (the participation ratio of their residuals, measured on the
sample), so the margin is SIGMAS standard deviations of that share, and the whole chord where they spread over few.
The margin looks at the geometry alone, so it holds however many shards a group of near copies covers. The search in a
block is greedy from the block's medoids to the vector's neighbourhood, then a range expansion along the graph for as
long as it meets vectors within SLACK of the threshold; where more than DENSE of a block's pairs are links, all cosines
are computed instead. They are in double precision, so every link is verified. ``audit`` compares the links with a
brute-force scan of query vectors against all vectors in blocks.

A pair is found twice, once from each end. Blocks return link counts and a spanning forest of the links, so a group of n
copies costs n rows for each of its blocks and not n^2.

Edge cases: vectors that are null, of norm 0, or with null or non-finite components, and those with a null label or
vec_id, link with nothing; vectors of other dimensions never meet; equal vectors of one label are linked whatever else
is found; rows that repeat a vec_id are compared as separate vectors; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import dropped, saved, table

COSINE, BLOCK, SAMPLE = 0.93, 1500, 20_000
DEGREE, POOL, ALPHA, BEAM, SLACK, FAR, DENSE, SIGMAS = 32, 96, 1.2, 16, 0.1, 4, 0.1, 4.0
#: Pairs whose vectors are gathered at once.
ROWS = 512


def robust_prune(sims: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> np.ndarray:
    """(n, degree) neighbour lists, -1 where empty: nearest first, and none that a chosen neighbour is alpha times nearer to."""
    n = len(sims)
    width = min(pool, n - 1)
    if width < 1:
        return np.full((n, 1), -1)
    masked = sims.copy()
    np.fill_diagonal(masked, -2)
    cand = np.argpartition(-masked, width - 1, axis=1)[:, :width]
    rows = np.arange(n)[:, None]
    cand = np.take_along_axis(cand, np.argsort(-masked[rows, cand], axis=1), 1)
    gap = np.maximum(1 - masked[rows, cand], 0)
    alive = np.ones_like(cand, bool)
    out = np.full((n, min(degree, width)), -1)
    for d in range(out.shape[1]):
        first = alive.argmax(axis=1)
        some = alive[np.arange(n), first]
        pick = np.where(some, cand[np.arange(n), first], -1)
        out[:, d] = pick
        if not some.any():
            break
        alive[np.arange(n), first] = False
        alive &= alpha * np.maximum(1 - sims[np.maximum(pick, 0)[:, None], cand], 0) > gap
    return out


def medoids(nodes: np.ndarray, count: int) -> list[int]:
    """The node nearest to the mean, then again and again the node that is farthest from those chosen."""
    out = [int((nodes * nodes.mean(axis=0)).sum(axis=1).argmax())]
    nearest = (nodes * nodes[out[0]]).sum(axis=1)
    while len(out) < min(count, len(nodes)):
        out.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, (nodes * nodes[out[-1]]).sum(axis=1))
    return out


def range_search(queries: np.ndarray, nodes: np.ndarray, edges: list[np.ndarray], least: float, beam: int = BEAM, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, cosine) of the nodes found with at least that cosine: greedy from the medoid, then along the range."""
    n, m = len(queries), len(nodes)
    degree = np.array([len(e) for e in edges], np.int64)
    flat_edges, edge = np.concatenate([*edges, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum(degree)])

    def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Cosines of (query, node) pairs, so few at a time that the rows stay in the processor's cache."""
        out = np.empty(len(q))
        for i in range(0, len(q), ROWS):
            np.einsum("ij,ij->i", queries[q[i : i + ROWS]], nodes[v[i : i + ROWS]], out=out[i : i + ROWS])
        return out

    seeds = medoids(nodes, beam)
    seen = np.zeros((n, m), bool)
    seen[:, seeds] = True
    flat_seen = seen.reshape(-1)
    everyone = np.arange(n)
    top, top_cos = np.full((n, beam), -1), np.full((n, beam), -3.0)
    for j, s in enumerate(seeds):
        top[:, j], top_cos[:, j] = s, cosine(everyone, np.full(n, s))
    expanded = np.zeros((n, beam), bool)
    hits = [(np.repeat(everyone, len(seeds)), top[:, : len(seeds)].ravel(), top_cos[:, : len(seeds)].ravel())]

    def step(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unseen graph neighbours of (query, node) pairs with their cosines."""
        out = []
        for lo in range(0, len(q), 100_000):
            vs = v[lo : lo + 100_000]
            many = degree[vs]
            qq = np.repeat(q[lo : lo + 100_000], many)
            vv = flat_edges[np.repeat(edge[vs], many) + np.arange(len(qq)) - np.repeat(np.cumsum(many) - many, many)]
            flat = qq * m + vv
            flat = flat[~flat_seen[flat]]
            if len(flat) * 50 < n * m:
                flat = np.unique(flat)
            else:  # many: sorting them takes longer than a look at all pairs
                new = np.zeros(n * m, bool)
                new[flat] = True
                flat = np.flatnonzero(new)
            flat_seen[flat] = True
            qq, vv = np.divmod(flat, m)
            out.append((qq, vv, cosine(qq, vv)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (q[:0], q[:0], np.zeros(0))

    while True:
        open_cos = np.where(expanded | (top < 0), -4.0, top_cos)
        best = open_cos.argmax(axis=1)
        go = np.flatnonzero(open_cos[everyone, best] > -4)
        if not len(go):
            break
        expanded[go, best[go]] = True
        q, v, c = step(go, top[go, best[go]])
        if not len(q):
            continue
        hits.append((q, v, c))
        starts = np.searchsorted(q, np.arange(n + 1))
        width = int(np.diff(starts).max())
        place = np.arange(len(q)) - starts[q]
        more, more_cos = np.full((n, width), -1), np.full((n, width), -3.0)
        more[q, place], more_cos[q, place] = v, c
        all_, all_cos = np.concatenate([top, more], 1), np.concatenate([top_cos, more_cos], 1)
        all_done = np.concatenate([expanded, np.zeros_like(more, bool)], 1)
        keep = np.argsort(-all_cos, axis=1, kind="stable")[:, :beam]
        top, top_cos, expanded = (np.take_along_axis(x, keep, 1) for x in (all_, all_cos, all_done))
    q, v, c = (np.concatenate(x) for x in zip(*hits, strict=True))
    done = [(q[c >= least], v[c >= least], c[c >= least])]
    near = c >= least - slack
    q, v = q[near], v[near]
    while len(q):
        q, v, c = step(q, v)
        done.append((q[c >= least], v[c >= least], c[c >= least]))
        near = c >= least - slack
        q, v = q[near], v[near]
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for x, label, i in zip(b.column(2), b.column(1), b.column(0), strict=True):
            v = np.array(x.as_py(), np.float64) if x.is_valid and label.is_valid and i.is_valid else np.zeros(0)
            norm = np.sqrt((v * v).sum()) if np.isfinite(v).all() and len(v) else 0.0
            out.append((v / norm).tobytes() if norm > 0 and np.isfinite(norm) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "unit"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _centroids(vectors: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    rng = np.random.default_rng(0)
    c = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.einsum("ij,kj->ik", vectors[i : i + 1000], c).argmax(axis=1) for i in range(0, len(vectors), 1000)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, vectors)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], c)
    return c


def spread(vectors: np.ndarray, centroids: np.ndarray) -> float:
    """The number of directions over which the vectors spread around the means of their shards (participation ratio).

    Not around the centroids: these have norm 1 and a mean of spread vectors is shorter, so all residuals would share its direction.
    """
    own = np.concatenate([np.einsum("ij,kj->ik", vectors[i : i + 1000], centroids).argmax(axis=1) for i in range(0, len(vectors), 1000)])
    sums = np.zeros_like(centroids)
    np.add.at(sums, own, vectors)
    rest = vectors - (sums / np.maximum(np.bincount(own, minlength=len(centroids)), 1)[:, None])[own]
    second = np.einsum("ni,nj->ij", rest, rest)
    return float(np.trace(second) ** 2 / max((second * second).sum(), 1e-300))


def link_vectors(vectors: DataFrame, least: float = COSINE, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, label, embedding)."""
    raw = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    unit = saved(raw.mapInArrow(_unit, "vec_id long, label long, unit binary"), "unit")
    nodes = saved(unit.where("unit is not null").groupBy("label", "unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("dim", F.octet_length("unit")).withColumn("uid", F.xxhash64("label", "unit")), "nodes")

    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > block)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    chord = float(np.sqrt(max(2 - 2 * least, 0.0)))  # the longest distance of two linked unit vectors
    centres: dict[tuple[int, int], tuple[np.ndarray, float]] = {}
    if total:
        share = min(1.0, 0.9 * sample / total)
        drawn = nodes.join(sizes, ["label", "dim"]).where(F.pmod(F.col("uid"), F.lit(1_000_003)) < share * 1_000_003).select("label", "dim", "n", "unit").limit(sample).toArrow().to_pandas()
        for (label, dim), g in drawn.groupby(["label", "dim"]):
            k = int(min(np.ceil(g["n"].iloc[0] / (block / 2)), max(1, len(g) // 8)))
            own = np.stack([np.frombuffer(x, np.float64) for x in g["unit"]])
            centres[label, dim] = (c := _centroids(own, k)), chord * min(1.0, SIGMAS / max(spread(own, c), 1e-9) ** 0.5)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            homes: list[int] = []
            shards: list[list[int]] = []
            for label, dim, u in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(1), strict=True):
                if (label, dim) not in centres:
                    homes.append(0)
                    shards.append([0])
                    continue
                c, margin = centres[label, dim]
                near = (c * np.frombuffer(u.as_buffer(), np.float64)).sum(axis=1)
                home = int(near.argmax())
                # a node of shard s is on its side of the bisector of s and home, so a link from here must reach that side
                homes.append(home)
                shards.append(np.flatnonzero(near[home] - near <= margin * np.linalg.norm(c[home] - c, axis=1) + 1e-9).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(homes, pa.int32()), pa.array(shards, pa.list_(pa.int32()))], names=[*b.schema.names, "shard", "asks"])

    dealt = saved(nodes.select("label", "unit", "node", "dim", "copies", "uid").mapInArrow(deal, "label long, unit binary, node long, dim int, copies long, uid long, shard int, asks array<int>"), "dealt")
    queries = dealt.select("label", "dim", F.explode("asks").alias("shard"), "unit", "node", "copies", "uid")
    blocks = dealt.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    parts = queries.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("parts"))
    cells = saved(blocks.join(parts, ["label", "dim", "shard"]), "cells")
    member = saved(dealt.drop("asks").join(cells, ["label", "dim", "shard"]).withColumn("block", F.pmod(F.col("uid"), F.col("blocks")).cast("int")), "member")
    place = ["label", "dim", "shard", "block"]

    def build(key: tuple, group: pa.Table) -> pa.Table:
        v, ids = _matrix(group.column("unit")), group.column("uid").to_numpy()
        sims = np.einsum("ij,kj->ik", v, v)
        lists = robust_prune(sims)
        # a tight group's nearest are all inside it: a few far links keep it in reach
        far = np.random.default_rng(len(ids)).integers(0, len(ids), (len(ids), FAR))
        return pa.table({"uid": pa.array(ids, pa.int64()), "near": pa.array([np.concatenate([ids[r[r >= 0]], ids[f]]) for r, f in zip(lists, far, strict=True)], pa.list_(pa.int64()))})

    lists = saved(member.select(*place, "uid", "unit").groupBy(*place).applyInArrow(build, "uid long, near array<long>"), "lists")

    # the nodes of a block meet the vectors that search its shard, so many at a time
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = member.join(lists, "uid").withColumn("part", upto("parts")).select(*place, "part", "uid", "node", "copies", "unit", "near")
    asked = queries.join(cells, ["label", "dim", "shard"]).withColumn("part", F.pmod(F.hash("uid"), F.col("parts"))).withColumn("block", upto("blocks"))
    met = there.unionByName(asked.select(*place, "part", "uid", "node", "copies", "unit", F.lit(None).cast("array<long>").alias("near")))

    def search(key: tuple, group: pa.Table) -> pa.Table:
        v, ids, copies = _matrix(group.column("unit")), group.column("node").to_numpy(), group.column("copies").to_numpy()
        uids, near = group.column("uid").to_numpy(), group.column("near")
        asks = near.is_null().to_numpy()
        inside, outside = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(inside) or not len(outside):
            return pa.table({"node": pa.array([], pa.int64()), "found": pa.array([], pa.int64()), "a": pa.array([], pa.int64())})
        if (np.einsum("ij,kj->ik", v[inside], v[inside]) >= least).mean() > DENSE:
            q, x = np.nonzero(np.einsum("ij,kj->ik", v[outside], v[inside]) >= least)
        else:
            at = {int(u): i for i, u in enumerate(uids[inside])}
            edges: list[set[int]] = [set() for _ in inside]
            for i, r in enumerate(inside):
                for u in near[int(r)].as_py():
                    j = at[u]
                    edges[i].add(j)
                    edges[j].add(i)
            q, x, _ = range_search(v[outside], v[inside], [np.array(sorted(e), np.int64) for e in edges], least)
        q, x = outside[q], inside[x]
        ok = uids[q] != uids[x]
        q, x = q[ok], x[ok]
        found = np.bincount(q, weights=copies[x], minlength=len(ids)).astype(np.int64)
        parent = np.arange(len(ids))
        while True:  # min-label rounds with pointer jumping give each linked row its block's root
            old = parent.copy()
            np.minimum.at(parent, q, parent[x])
            np.minimum.at(parent, x, parent[q])
            parent = parent[parent]
            if (parent == old).all():
                break
        use = np.flatnonzero((found > 0) | (parent != np.arange(len(ids))))
        return pa.table({"node": pa.array(ids[use], pa.int64()), "found": pa.array(found[use], pa.int64()), "a": pa.array(ids[parent[use]], pa.int64())})

    hits = saved(met.groupBy(*place, "part").applyInArrow(search, "node long, found long, a long"), "hits")
    groups = components(hits.select("node", "a"))
    counts = hits.groupBy("node").agg(F.sum("found").alias("found"))
    summary = nodes.select("label", "unit", "node", "copies").join(counts, "node", "left").join(groups, "node", "left").select("label", "unit", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    good = unit.where("unit is not null").join(summary, ["label", "unit"]).select("vec_id", "n_links", "component_id")
    bad = unit.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    dropped(dealt, cells, member, lists)
    return good.unionByName(bad).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def audit(vectors: DataFrame, links: DataFrame, queries: int = 200, least: float = COSINE) -> float:
    """Recall: of the links that a brute-force scan of at most ``queries`` query vectors finds, the share in ``links``."""
    raw = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    unit = raw.mapInArrow(_unit, "vec_id long, label long, unit binary").where("unit is not null")
    asked = unit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).collect()
    if not asked:
        return 1.0
    by: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for key in {(r.label, len(r.unit)) for r in asked}:
        own = [r for r in asked if (r.label, len(r.unit)) == key]
        by[key] = np.array([r.vec_id for r in own]), np.stack([np.frombuffer(r.unit, np.float64) for r in own])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = [], []
            labels, units = b.column(1).to_pylist(), b.column(2)
            for key, (q, m) in by.items():
                rows = [i for i, (x, u) in enumerate(zip(labels, units, strict=True)) if (x, len(u.as_buffer())) == key]
                if rows:
                    v = np.stack([np.frombuffer(units[i].as_buffer(), np.float64) for i in rows])
                    ids += q.tolist()
                    n += (np.einsum("ij,kj->ik", m, v) >= least).sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["vec_id", "n"])

    true = unit.mapInArrow(scan, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    row = true.join(links, "vec_id").agg(F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("hit")).first()
    return row.hit / row.n if row.n else 1.0


def op4_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
