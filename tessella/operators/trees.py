"""Message trees: each message with the ids of its ancestors, a graph stored as paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled


def from_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role): each with its ancestors (null for the first) and its child (null for the last)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = F.collect_list("turn").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return turns.select("conv_id", "turn", "role", F.when(F.size(before) > 0, before).alias("ancestors"), F.lead("turn").over(order).alias("child"))


def paths(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role): (conv_id, turn, path), the messages from the first one to the turn."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    step = F.concat(F.col("turn").cast("string"), F.lit(":"), "role")
    return turns.select("conv_id", "turn", F.array_join(F.collect_list(step).over(order), "/").alias("path"))


def child_ancestors(parent_ancestors: Column, parent: Column) -> Column:
    """Ancestors of a new child."""
    return F.concat(F.coalesce(parent_ancestors, F.array().cast("array<string>")), F.array(parent))


def add_child(tree: DataFrame, parent: Column, new_id: str, content: str) -> DataFrame:
    """tree (id, ancestors, content) with one more message below the parent."""
    row = tree.where(F.col("id") == parent).select(F.lit(new_id).alias("id"), child_ancestors(F.col("ancestors"), F.col("id")).alias("ancestors"), F.lit(content).alias("content"))
    return tree.select("id", "ancestors", "content").unionByName(row)


def add_sibling(tree: DataFrame, of: Column, new_id: str, content: str) -> DataFrame:
    """tree with one more message beside another one, which must have a parent."""
    row = tree.where((F.col("id") == of) & (F.size("ancestors") > 0)).select(F.lit(new_id).alias("id"), "ancestors", F.lit(content).alias("content"))
    return tree.select("id", "ancestors", "content").unionByName(row)


def subtree(tree: DataFrame, root: str) -> DataFrame:
    """The messages below a root, with it."""
    return tree.where((F.col("id") == root) | F.array_contains("ancestors", root))


def root_paths(nodes: DataFrame, keys: list[str], label: str) -> DataFrame:
    """nodes (keys, id, parent, label), trees that branch: (keys, id, depth, path), the labels from the root down to each node.

    By pointer doubling: after r rounds a node knows its last 2 ** r labels and the ancestor above these, so the number of
    rounds is the logarithm of the greatest depth, and a round is an equi-join on the keys and the ancestor. ids are unique
    within the keys. A node whose parent is not there is a root; nodes of a circle have no root, and are left out.
    """
    known = nodes.select(*keys, F.col("id").alias("parent"), F.lit(True).alias("known"))
    first = nodes.join(known, [*keys, "parent"], "left").select(*keys, "id", F.when(F.col("known"), F.col("parent")).alias("above"), F.lit(1).cast("long").alias("depth"), F.col(label).cast("string").alias("path"))
    reached = settled(first)
    n, rounds = reached.count(), 0
    while reached.where("above IS NOT NULL").limit(1).count() and 2**rounds <= n:  # beyond n labels there are only circles
        upper = reached.select(*keys, F.col("id").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"), F.col("path").alias("front"))
        joined = reached.join(upper, [*keys, "above"], "left")
        path = F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("front", F.lit("/"), "path"))
        reached = settled(joined.select(*keys, "id", F.col("next").alias("above"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), path.alias("path")))
        rounds += 1
    return reached.where("above IS NULL").drop("above")
