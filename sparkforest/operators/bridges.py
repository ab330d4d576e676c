"""Bridges, cut vertices and biconnected components out of any rooted spanning forest (Tarjan and Vishkin's conditions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.operators.components import connected_components
from sparkforest.operators.edges import absent, tree_edges
from sparkforest.operators.euler import preorder
from sparkforest.operators.traverse import bfs_forest
from sparkforest.operators.trees import subtree_fold
from sparkforest.plans.context import cut
from sparkforest.plans.scale import hot_join, is_small


def _reach(edges: DataFrame, forest: DataFrame | None, small: bool) -> tuple[DataFrame, DataFrame]:
    """(vertices with parent, root, pre, size, low, high; non-tree edges with the numbers of their ends)."""
    f = cut(bfs_forest(edges, small=small).select("id", "parent") if forest is None else forest.select("id", "parent"))
    p = cut(preorder(f, small))
    other = absent(edges.select("u", "v"), tree_edges(f))
    number = p.select("id", "pre", "size")
    side = lambda c, x: number.select(F.col("id").alias(c), F.col("pre").alias(f"{x}_pre"), F.col("size").alias(f"{x}_size"))
    spans = cut(hot_join(hot_join(other, side("u", "u"), "u", "inner", small), side("v", "v"), "v", "inner", small))
    ends = spans.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v_pre").alias("to")), F.struct(F.col("v").alias("id"), F.col("u_pre").alias("to")))).alias("e")).select("e.*")
    own = ends.groupBy("id").agg(F.min("to").alias("a"), F.max("to").alias("b"))
    near = cut(p.join(own, "id", "left").select("id", "parent", F.least("pre", "a").alias("a"), F.greatest("pre", "b").alias("b")))
    low = subtree_fold(near, "a", "min", small).withColumnRenamed("value", "low")
    high = subtree_fold(near, "b", "max", small).withColumnRenamed("value", "high")
    return cut(p.join(low, "id").join(high, "id")), spans


def bridges(edges: DataFrame, forest: DataFrame | None = None, small: bool | None = None) -> DataFrame:
    """(u, v): edges of all components whose removal splits one: tree edges that no other edge spans."""
    small = is_small(edges) if small is None else small
    p, _ = _reach(edges, forest, small)
    lone = (F.col("low") >= F.col("pre")) & (F.col("high") < F.col("pre") + F.col("size"))
    return p.where("id <> parent").where(lone).select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"))


def biconnected_components(edges: DataFrame, forest: DataFrame | None = None, small: bool | None = None) -> DataFrame:
    """(u, v, block): every edge with its block, named after the smallest child vertex of the block's tree edges.

    A tree edge is named by its child. Two tree edges are in one block if a non-tree edge joins their unrelated children, or
    if the lower one's subtree reaches out of the upper one's; the blocks are the components of that relation.
    """
    small = is_small(edges) if small is None else small
    p, spans = _reach(edges, forest, small)
    apart = (F.col("u_pre") + F.col("u_size") <= F.col("v_pre")) | (F.col("v_pre") + F.col("v_size") <= F.col("u_pre"))
    across = spans.where(apart).select("u", "v")
    up = p.select(F.col("id").alias("parent"), F.col("parent").alias("grand"), F.col("pre").alias("p_pre"), F.col("size").alias("p_size"))
    out = (F.col("low") < F.col("p_pre")) | (F.col("high") >= F.col("p_pre") + F.col("p_size"))
    climbing = hot_join(p.where("id <> parent"), up, "parent", "inner", small).where("parent <> grand").where(out).select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"))
    block = cut(connected_components(across.unionByName(climbing).distinct(), p.where("id <> parent").select("id"), small))
    named = block.select("id", F.col("rep").alias("block"))
    tree = p.where("id <> parent").select("id", F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v")).join(named, "id").select("u", "v", "block")
    # A non-tree edge lies in the block of the end that comes later in preorder.
    rest = spans.select("u", "v", F.when(F.col("u_pre") > F.col("v_pre"), F.col("u")).otherwise(F.col("v")).alias("id"))
    return tree.unionByName(hot_join(rest, named, "id", "inner", small).select("u", "v", "block"))


def cut_vertices(edges: DataFrame, forest: DataFrame | None = None, small: bool | None = None) -> DataFrame:
    """(id): vertices that stand in more than one block; removing one splits its component."""
    blocks = biconnected_components(edges, forest, small)
    return blocks.select(F.explode(F.array("u", "v")).alias("id"), "block").distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
