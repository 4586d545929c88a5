"""Conversation trees: active paths, roots, branches and validation, level by level.

Paths and cycles are found by pointer doubling (jump tables squared), so a tree of depth d takes log2(d) joins and
nothing recursive; self-loops and cycles end by the bound on rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


def validate(nodes: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """conv, node, issue: missing_parent, self_parent, message_cycle and, with leaves (conv, leaf), missing_active_leaf.

    nodes: conv, node, parent. A cycle is reported at its nodes; those that merely hang below one are not.
    """
    known = nodes.select("conv", F.col("node").alias("parent")).distinct()
    out = nodes.where("parent is not null").join(known, ["conv", "parent"], "left_anti").select("conv", "node", F.lit("missing_parent").alias("issue"))
    out = out.unionByName(nodes.where("node = parent").select("conv", "node", F.lit("self_parent").alias("issue")))
    out = out.unionByName(cycles(nodes).select("conv", "node", F.lit("message_cycle").alias("issue")))
    if leaves is not None:
        gone = leaves.where("leaf is not null").join(nodes.select("conv", F.col("node").alias("leaf")), ["conv", "leaf"], "left_anti")
        out = out.unionByName(gone.select("conv", F.col("leaf").alias("node"), F.lit("missing_active_leaf").alias("issue")))
    return out


def cycles(nodes: DataFrame) -> DataFrame:
    """conv, node of the nodes that are their own ancestors by two steps or more.

    After as many doublings as the largest conversation asks for, every jump that has not left the tree ends on a cycle,
    and each node of a cycle is the end of one.
    """
    jump = nodes.where("parent is not null and parent <> node").select("conv", "node", F.col("parent").alias("up"))
    most = nodes.groupBy("conv").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    reach = 1
    while reach < most:
        far = jump.select("conv", F.col("node").alias("up"), F.col("up").alias("end"))
        jump = checkpointed(jump.join(far, ["conv", "up"]).select("conv", "node", F.col("end").alias("up")))
        reach *= 2
    alive = nodes.where("parent is not null and parent <> node").select("conv", F.col("node").alias("up"))
    return jump.select("conv", "up").distinct().join(alive.distinct(), ["conv", "up"], "left_semi").select("conv", F.col("up").alias("node"))


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent is null").select("conv", "node")


def branch_points(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent is not null").groupBy("conv", F.col("parent").alias("node")).agg(F.count("*").alias("children")).where("children > 1")


def depths(nodes: DataFrame, max_depth: int = 1 << 16) -> DataFrame:
    """conv, node, depth, root for nodes that reach a root; nodes on or under a cycle, or without a parent row, are absent."""
    jump = nodes.select("conv", "node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    jump = jump.withColumn("root", F.when(F.col("up").isNull(), F.col("node")))
    reach = 1
    while reach < max_depth and jump.where("up is not null").limit(1).count():
        far = jump.select("conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("root").alias("root2"))
        joined = jump.join(far, ["conv", "up"], "left")
        jump = checkpointed(joined.select("conv", "node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("root", "root2").alias("root")))
        reach *= 2
    return jump.where("root is not null and up is null").select("conv", "node", "depth", "root")


def active_path(nodes: DataFrame, leaves: DataFrame, max_depth: int = 1 << 16) -> DataFrame:
    """conv, node, position from the root (0) to the active leaf. leaves: conv, leaf.

    Ancestors are marked by doubling: in round r every marked node marks its ancestor 2^r levels up.
    """
    level = depths(nodes, max_depth).select("conv", "node", F.col("depth").alias("position"))
    marked = leaves.select("conv", F.col("leaf").alias("node")).join(level, ["conv", "node"], "left_semi")
    jump = nodes.where("parent is not null").select("conv", "node", "parent")
    reach = 1
    while reach < max_depth:
        up = marked.join(jump, ["conv", "node"]).select("conv", F.col("parent").alias("node"))
        more = up.join(marked, ["conv", "node"], "left_anti").distinct()
        if not more.limit(1).count():
            break
        marked = checkpointed(marked.unionByName(more))
        far = jump.select("conv", F.col("node").alias("parent"), F.col("parent").alias("up"))
        jump = checkpointed(jump.join(far, ["conv", "parent"]).select("conv", "node", F.col("up").alias("parent")))
        reach *= 2
    return marked.join(level, ["conv", "node"])


def walked(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """conv, node, steps of what a walk from the leaf (0 steps) along parents meets, to a root, a missing parent or a node that it met before.

    nodes: conv, node, parent (one parent each). leaves: conv, leaf. Round r goes on by 2^r steps from all that is met so
    far; a node on a cycle counts once, for the first time it is met.
    """
    met = checkpointed(leaves.select("conv", F.col("leaf").alias("node")).distinct().join(nodes.select("conv", "node"), ["conv", "node"], "left_semi").withColumn("steps", F.lit(0).cast("long")))
    known = nodes.select("conv", F.col("node").alias("parent"))
    jump = nodes.where("parent is not null").select("conv", "node", "parent").join(known, ["conv", "parent"], "left_semi")
    reach = 1
    while True:
        ahead = met.join(jump, ["conv", "node"]).select("conv", F.col("parent").alias("node"), (F.col("steps") + reach).alias("steps"))
        new = checkpointed(ahead.join(met, ["conv", "node"], "left_anti").groupBy("conv", "node").agg(F.min("steps").alias("steps")))
        if new.isEmpty():
            return met
        met = checkpointed(met.unionByName(new))
        far = jump.select("conv", F.col("node").alias("parent"), F.col("parent").alias("up"))
        jump = checkpointed(jump.join(far, ["conv", "parent"]).select("conv", "node", F.col("up").alias("parent")))
        reach *= 2
