"""Edge lists: canonical form, membership, deletion, degrees and adjacency.

``edges`` has bigint columns u < v, unique; ``sym`` has src and dst, both directions; ``forest`` has id and parent, a root
being its own parent. Other columns of an input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.plans.prefix import grouped_prefix, ranked

PACK_BITS = 32


def canonical(pairs: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(u, v) with u < v, each once: loops, repeated and reversed rows, and rows with a null endpoint fall away."""
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    return pairs.where(x != y).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct()


def pack(edges: DataFrame) -> DataFrame:
    """(key): u in the upper, v in the lower 32 bits; ascending keys are the order by u, v. Ids must be below 2**32."""
    return edges.select(F.shiftleft(F.col("u"), PACK_BITS).bitwiseOR(F.col("v")).alias("key"))


def unpack(keys: DataFrame) -> DataFrame:
    return keys.select(F.shiftrightunsigned("key", PACK_BITS).alias("u"), F.col("key").bitwiseAND(F.lit((1 << PACK_BITS) - 1)).alias("v"))


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("u", "v")


def symmetrise(edges: DataFrame) -> DataFrame:
    """(src, dst): every edge in both directions, by one pass over the edges."""
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return edges.select(F.explode(both).alias("e")).select("e.src", "e.dst")


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def present(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """The batch edges that stand in the edge list. (u, v) is unique on both sides, so no key is hot."""
    return batch.join(edges.select("u", "v"), ["u", "v"], "left_semi")


def absent(batch: DataFrame, edges: DataFrame) -> DataFrame:
    return batch.join(edges.select("u", "v"), ["u", "v"], "left_anti")


def has_edge(edges: DataFrame, a: int, b: int) -> DataFrame:
    """(found): one row, whether the edge stands in the list in either direction."""
    hit = (F.col("u") == min(a, b)) & (F.col("v") == max(a, b))
    return edges.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("found"))


def delete_edges(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """The edges that are not in the batch; batch edges that are absent change nothing."""
    return absent(edges.select("u", "v"), batch)


def insert_edges(edges: DataFrame, batch: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(absent(batch.select("u", "v"), edges))


def tree_edges(forest: DataFrame) -> DataFrame:
    """(u, v, id): the forest's edges in canonical form, with the child."""
    return forest.where("id <> parent").select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"), "id")


def classify(batch: DataFrame, forest: DataFrame) -> DataFrame:
    """(u, v, is_tree): whether a batch edge is an edge of the forest."""
    tree = tree_edges(forest).select("u", "v", F.lit(True).alias("t"))
    return batch.select("u", "v").join(tree, ["u", "v"], "left").select("u", "v", F.coalesce("t", F.lit(False)).alias("is_tree"))


def cut_forest(forest: DataFrame, batch: DataFrame) -> DataFrame:
    """The forest after the batch: a vertex whose edge to its parent is in the batch becomes a root."""
    f = forest.select("id", "parent", F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"))
    hit = batch.select("u", "v", F.lit(True).alias("dead"))
    return f.join(hit, ["u", "v"], "left").select("id", F.when(F.col("dead"), F.col("id")).otherwise(F.col("parent")).alias("parent"))


def candidates(edges: DataFrame, batch: DataFrame, cut: DataFrame) -> DataFrame:
    """Edges that may replace a deleted tree edge: neither deleted nor in the forest that is left."""
    return absent(delete_edges(edges, batch), tree_edges(cut))


def select_flagged(rows: DataFrame, flag: str) -> DataFrame:
    """The rows whose flag is true; a null flag is not."""
    return rows.where(F.col(flag)).drop(flag)


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, degree). Vertices without edges have degree 0 and come out only if ``vertices`` names them."""
    d = symmetrise(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return d if vertices is None else vertices.select("id").join(d, "id", "left").na.fill(0, ["degree"])


def csr_offsets(edges: DataFrame, vertices: DataFrame | None = None, small: bool = False) -> DataFrame:
    """(id, degree, first): where each vertex' neighbours begin in the adjacency ordered by src, dst."""
    d = degrees(edges, vertices).withColumn("_all", F.lit(0))
    return grouped_prefix(d, ["_all"], ["id"], "degree", "first", small).select("id", "degree", "first")


def adjacency(edges: DataFrame, chunk: int = 4096, small: bool = False) -> DataFrame:
    """(src, chunk, neighbours): ascending neighbours in arrays of at most ``chunk``, so that a hub is no single row."""
    at = ranked(symmetrise(edges), ["src"], ["dst"], "k", small)
    return at.groupBy("src", F.floor(F.col("k") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def csr_to_edges(adjacent: DataFrame) -> DataFrame:
    """(u, v) out of adjacency arrays: each undirected edge once."""
    return adjacent.select(F.col("src").alias("u"), F.explode("neighbours").alias("v")).where("u < v")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(equal, only_left, only_right): whether two tables of the same columns hold the same rows, as often, by one aggregation."""
    cols = a.columns
    n = a.withColumn("_n", F.lit(1)).unionByName(b.select(*cols).withColumn("_n", F.lit(-1))).groupBy(*cols).agg(F.sum("_n").alias("_n"))
    left, right = F.coalesce(F.sum(F.when(F.col("_n") > 0, F.col("_n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_n") < 0, -F.col("_n"))), F.lit(0))
    return n.agg((left + right == 0).alias("equal"), left.alias("only_left"), right.alias("only_right"))
