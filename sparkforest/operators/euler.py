"""Euler-tour intervals of rooted forests, in closed form.

With preorder number pre (children ascending), subtree size sz and depth d inside a tree, the tour enters a vertex at
first = 2 pre - d and leaves it at last = 2 (pre + sz - 1) - d; a tree of one vertex has the interval (0, 1). One row per
vertex stands for the two arcs per edge of an explicit tour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.operators.edges import symmetrise
from sparkforest.operators.trees import jump, list_ranks, subtree_fold
from sparkforest.plans.context import cut
from sparkforest.plans.prefix import grouped_prefix, ranked
from sparkforest.plans.scale import hot_join, is_small


def child_numbers(forest: DataFrame, small: bool = False) -> DataFrame:
    """(parent, id, k, children): each child's place among its siblings, ascending, and how many there are."""
    child = forest.where("id <> parent").select("parent", "id")
    count = child.groupBy("parent").agg(F.count("*").alias("children"))
    return ranked(child, ["parent"], ["id"], "k", small).join(count, "parent")


def preorder(forest: DataFrame, small: bool | None = None) -> DataFrame:
    """(id, parent, root, pre, size, depth): pre and depth count from 0 inside each tree."""
    small = is_small(forest) if small is None else small
    one = forest.select("id", "parent", F.lit(1).alias("w"))
    sized = cut(forest.select("id", "parent").join(subtree_fold(one, "w", "sum", small).withColumnRenamed("value", "size"), "id"))
    # A child's number lies one and the subtrees of its earlier siblings behind its parent's.
    earlier = grouped_prefix(sized.where("id <> parent"), ["parent"], ["id"], "size", "earlier", small)
    steps = sized.where("id = parent").select("id", "parent", F.lit(0).cast("bigint").alias("step")).unionByName(earlier.select("id", "parent", (F.col("earlier") + 1).alias("step")))
    steps = cut(steps.withColumn("one", F.lit(1)))
    at = jump(steps, "step", small, "one").select("id", "root", F.col("total").alias("pre"), F.col("second").alias("depth"))
    return sized.join(at, "id").select("id", "parent", "root", "pre", "size", "depth")


def intervals(forest: DataFrame, small: bool | None = None) -> DataFrame:
    """(id, root, first, last)"""
    p = preorder(forest, small)
    alone = (F.col("id") == F.col("root")) & (F.col("size") == 1)
    last = 2 * (F.col("pre") + F.col("size") - 1) - F.col("depth")
    return p.select("id", "root", (2 * F.col("pre") - F.col("depth")).alias("first"), F.when(alone, 1).otherwise(last).cast("bigint").alias("last"))


def tour_arcs(forest: DataFrame, small: bool | None = None) -> DataFrame:
    """(root, rank, src, dst): the arcs of every tree's tour in order, rank from 0: down into a vertex at first - 1, up out of it at last."""
    t = intervals(forest, small).join(forest.select("id", "parent"), "id").where("id <> root")
    arcs = F.array(F.struct((F.col("first") - 1).alias("rank"), F.col("parent").alias("src"), F.col("id").alias("dst")), F.struct(F.col("last").alias("rank"), F.col("id").alias("src"), F.col("parent").alias("dst")))
    return t.select("root", F.explode(arcs).alias("a")).select("root", "a.rank", "a.src", "a.dst")


def tour_successors(tree: DataFrame, small: bool = False) -> DataFrame:
    """(arc, src, dst, next): the two arcs of every edge of a forest that need not be rooted, numbered in the order of (src, dst), each
    with the arc that follows it in its tree's tour: the one after the reversed arc among the arcs out of dst, in a circle.

    Neighbours are numbered by range partitions, so a hub's arcs spread over many tasks.
    """
    arcs = cut(ranked(symmetrise(tree).withColumn("_all", F.lit(0)), ["_all"], ["src", "dst"], "arc", small).select("arc", "src", "dst"))
    out = cut(arcs.groupBy("src").agg(F.min("arc").alias("first"), F.count("*").alias("n")))
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("arc").alias("back"))
    met = arcs.join(back, ["src", "dst"])
    there = hot_join(cut(met), out.withColumnRenamed("src", "dst"), "dst", "inner", small)
    after = F.when(F.col("back") + 1 < F.col("first") + F.col("n"), F.col("back") + 1).otherwise(F.col("first"))
    return there.select("arc", "src", "dst", after.alias("next"))


def orient(tree: DataFrame, vertices: DataFrame, roots: DataFrame, small: bool | None = None) -> DataFrame:
    """(id, parent): the forest with the edges ``tree(u, v)``, rooted at ``roots(id)``, one in each tree that has edges; of
    ``vertices(id)`` those without edges are their own parents.

    The tour is cut before the root's first arc and ranked as a list that is shortened round by round; of an edge's two arcs the
    one that comes first goes down. The rounds grow with the logarithm of the vertices, whatever the depth.
    """
    finish, small = small is None, is_small(tree) if small is None else small
    next_of = cut(tour_successors(tree, small))
    starts = next_of.join(roots.select(F.col("id").alias("src")), "src", "left_semi").groupBy("src").agg(F.min("arc").alias("next"))
    ends = starts.select("next", F.lit(True).alias("last"))
    linked = next_of.join(ends, "next", "left").select("arc", "src", "dst", F.when(F.col("last").isNull(), F.col("next")).alias("next"))
    listed = cut(linked)
    left = list_ranks(listed.select(F.col("arc").alias("id"), "next"), small, finish).withColumnRenamed("id", "arc")
    at = cut(listed.join(left, "arc").select("src", "dst", "left"))
    # The arc with more of the list after it comes first.
    both = at.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max_by(F.struct("src", "dst"), "left").alias("down"))
    below = cut(both.select(F.col("down.dst").alias("id"), F.col("down.src").alias("parent")))
    tops = vertices.select("id").join(below.select("id"), "id", "left_anti")
    return below.unionByName(tops.select("id", F.col("id").alias("parent")))


def modified_tour(forest: DataFrame, small: bool | None = None) -> DataFrame:
    """(root, position, id, level): the vertices in the order in which every tree's tour stands on them, from the root at 0,
    with their depths. A vertex stands there once more than it has children; its first and last position enclose its subtree."""
    p = cut(preorder(forest, small))
    down = F.struct((2 * F.col("pre") - F.col("depth")).alias("position"), "id", F.col("depth").alias("level"))
    up = F.struct((2 * (F.col("pre") + F.col("size") - 1) - F.col("depth") + 1).alias("position"), F.col("parent").alias("id"), (F.col("depth") - 1).alias("level"))
    return p.select("root", F.explode(F.when(F.col("id") == F.col("root"), F.array(down)).otherwise(F.array(down, up))).alias("e")).select("root", "e.*")
