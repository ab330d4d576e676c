"""Contraction of a cut forest to the graph of its fragments, and the replacement edges found there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.operators.components import by_contraction, connected_components, hooked_forest
from sparkforest.operators.edges import vertices_of
from sparkforest.operators.euler import orient
from sparkforest.operators.traverse import bfs_from, seeds, spanning_forest
from sparkforest.operators.trees import cross_edges, jump
from sparkforest.plans.context import cut
from sparkforest.plans.scale import is_small


def fragments(cut_forest: DataFrame, small: bool | None = None) -> DataFrame:
    """(id, rep): every vertex with the root of its fragment."""
    return jump(cut_forest, small=small).select("id", F.col("root").alias("rep"))


def super_edges(candidates: DataFrame, frag: DataFrame, small: bool = False) -> DataFrame:
    """(a, b, wa, wb): one row per pair of fragments a < b that a candidate joins, with the smallest such edge, wa in a and wb in b.

    The smallest is an aggregate with partial results on the map side, so two fragments joined by a third of all edges meet as a few rows.
    """
    x = cross_edges(candidates, frag, small)
    first = F.col("ru") < F.col("rv")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    o = x.select(pick("ru", "rv").alias("a"), pick("rv", "ru").alias("b"), F.struct(pick("u", "v").alias("wa"), pick("v", "u").alias("wb")).alias("w"))
    return o.groupBy("a", "b").agg(F.min("w").alias("w")).select("a", "b", "w.wa", "w.wb")


def super_forest(supers: DataFrame, method: str = "sg", small: bool | None = None) -> DataFrame:
    """(id, parent): the rooted spanning forest of the fragments' graph, each tree rooted at its smallest fragment.

    method ``sg`` finds its components in one task where the graph fits, ``hs`` by rounds of hooking and shortcutting; the
    forest is then oriented breadth-first from the same roots, so both give the same rows. ``graft`` grows the forest by
    grafting trees and reversing paths, ``hook`` takes the edges along which components hook and orients them by a tour;
    neither has a round per level, for graphs of fragments of any depth.
    """
    pairs = supers.select(F.col("a").alias("u"), F.col("b").alias("v"))
    small = is_small(pairs) if small is None else small
    if method == "graft":
        return spanning_forest(pairs, None, small)
    if method == "hook":
        ids, tree = cut(vertices_of(pairs)), cut(hooked_forest(pairs, small))
        return orient(tree, ids, cut(connected_components(tree, ids, small)).where("id = rep").select("id"), small)
    if method == "hs":
        labels = by_contraction(pairs, vertices_of(pairs))
    elif method == "sg":
        labels = connected_components(pairs, None, small)
    else:
        raise ValueError(f"unknown method {method!r}: sg, hs, graft or hook")
    labels = cut(labels)
    return bfs_from(pairs, labels.select("id"), seeds(labels), small).select("id", "parent")


def replacements(forest_of_fragments: DataFrame, supers: DataFrame) -> DataFrame:
    """(frag, u, v): for each fragment below another one the edge that attaches it, u in the fragment and v in the one above."""
    sp = forest_of_fragments.where("id <> parent").select("id", F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    own = F.col("id") == F.col("a")
    return sp.join(supers, ["a", "b"]).select(F.col("id").alias("frag"), F.when(own, F.col("wa")).otherwise(F.col("wb")).alias("u"), F.when(own, F.col("wb")).otherwise(F.col("wa")).alias("v"))
