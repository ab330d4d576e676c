"""Batches of edges to delete or insert, drawn by a seeded hash so that a run can be repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.operators.bridges import bridges
from sparkforest.operators.edges import absent, degrees, tree_edges
from sparkforest.operators.traverse import bfs_forest

#: Batch sizes, the numbers of tree edges tried in each, and the sets drawn of each combination.
MIXED_SIZES = {100: (5, 10, 50, 100), 1000: (10, 100, 500, 1000), 10_000: (10, 100, 500, 1000, 5000, 10_000), 100_000: (10, 100, 500, 1000, 5000, 10_000, 20_000, 50_000, 100_000)}
SETS = 5
BRIDGE_SHARE = 0.6


def drawn(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k edges (all, if there are fewer) in the order of a seeded hash; never padded. The limit is the sample's size."""
    return edges.select("u", "v").orderBy(F.xxhash64(F.lit(seed), "u", "v"), "u", "v").limit(k)


def busy_tree_edges(edges: DataFrame, forest: DataFrame) -> DataFrame:
    """(u, v): tree edges whose child has more neighbours than the average vertex."""
    d = degrees(edges, forest.select("id"))
    mean = d.agg(F.avg("degree")).first()[0] or 0.0
    return tree_edges(forest).join(d.where(F.col("degree") > mean), "id").select("u", "v")


def tree_edge_batch(edges: DataFrame, forest: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """k tree edges at busy children; k is a fifth of the vertices if not given."""
    return drawn(busy_tree_edges(edges, forest), forest.count() // 5 if k is None else k, seed)


def non_tree_edges(edges: DataFrame, forest: DataFrame) -> DataFrame:
    return absent(edges.select("u", "v"), tree_edges(forest))


def mixed_batch(edges: DataFrame, forest: DataFrame, total: int, from_tree: int, seed: int = 0) -> DataFrame:
    """from_tree tree edges and total - from_tree others."""
    return drawn(tree_edges(forest), min(from_tree, total), seed).unionByName(drawn(non_tree_edges(edges, forest), total - min(from_tree, total), seed + 1))


def batch_sets(edges: DataFrame, forest: DataFrame, sizes: dict[int, tuple[int, ...]] | None = None, sets: int = SETS, seed: int = 0) -> DataFrame:
    """(total, from_tree, set, u, v): mixed batches of every size with every number of tree edges, ``sets`` of each, as one table."""
    out: list[DataFrame] = []
    for total, counts in (MIXED_SIZES if sizes is None else sizes).items():
        for from_tree in counts:
            for k in range(sets):
                b = mixed_batch(edges, forest, total, from_tree, seed + 2 * len(out))
                out.append(b.select(F.lit(total).alias("total"), F.lit(from_tree).alias("from_tree"), F.lit(k).alias("set"), "u", "v"))
    return reduce(DataFrame.unionByName, out)


def non_tree_batch(edges: DataFrame, total: int, root: int | None = None, seed: int = 0) -> DataFrame:
    """Edges outside a breadth-first forest, so that deleting them keeps every component whole."""
    return drawn(non_tree_edges(edges, bfs_forest(edges, root=root)), total, seed)


def bridge_batch(edges: DataFrame, total: int, share: float = BRIDGE_SHARE, seed: int = 0) -> DataFrame:
    """Up to ``share`` of the batch are bridges, as many as there are; the rest is drawn from the edges outside a breadth-first forest."""
    from sparkforest.plans.context import cut

    forest = cut(bfs_forest(edges).select("id", "parent"))
    some = cut(drawn(bridges(edges, forest), int(total * share), seed))
    return some.unionByName(drawn(non_tree_edges(edges, forest), total - some.count(), seed + 1))
