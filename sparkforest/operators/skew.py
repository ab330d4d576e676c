"""Per-key results when a few keys hold most rows.

Heavy keys are detected with a mergeable frequent-items sketch, counted exactly, and processed by a broadcast join with
the short list of heavy keys; the other keys take the ordinary shuffle; the two parts are united.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class HeavyKeys:
    """``rows``: the keys that reach the share, with their exact row counts; never more than ``limit`` of them."""

    rows: DataFrame
    limit: int
    total_rows: int


def endpoints(edges: DataFrame, graph: str = "graph_name", a: str = "node1", b: str = "node2") -> DataFrame:
    """One row per vertex and row of ``edges`` it stands in: (graph_name, node_id, other).

    A loop gives one row with itself as ``other``. A null endpoint gives no row of its own; the vertex at the other end
    keeps its row, with a null ``other``. A null graph is a graph of its own. Columns beyond the three named are not read.
    """
    pair = lambda x, y: F.struct(F.col(x).alias("node_id"), F.col(y).alias("other"))
    both = F.when(F.col(a).eqNullSafe(F.col(b)), F.array(pair(a, b))).otherwise(F.array(pair(a, b), pair(b, a)))
    return edges.select(F.col(graph).alias("graph_name"), F.explode(both).alias("e")).select("graph_name", "e.node_id", "e.other").where(F.col("node_id").isNotNull())


def _key() -> F.Column:
    return F.xxhash64("graph_name", "node_id")


def heavy_vertices(edges: DataFrame, share: float = 0.01) -> HeavyKeys:
    """Vertices that stand in at least ``share`` of all rows, exactly.

    Pass 1 runs a frequent-items sketch over all endpoints. With M tracked items its error is at most 3.5/M of the
    endpoints, and there are at most two endpoints a row; M is chosen so that the error stays under an eighth of the
    threshold. At most 2/share vertices can reach the threshold and fewer than ``limit`` = 4/share can seem to, so the
    candidates, which are all that reaches the driver, are complete and bounded. Pass 2 counts them exactly.
    An empty table has no heavy vertices. Ties at the threshold are in.
    """
    limit = math.ceil(4 / share)
    tracked = 1 << max(10, math.ceil(math.log2(8 * 2 * 3.5 / share)))
    spark = edges.sparkSession
    ends = endpoints(edges)
    total = edges.count()
    found = ends.select(_key().alias("k")).agg(F.expr(f"approx_top_k(k, {limit}, {tracked})").alias("top")).first()
    least = share * total
    keys = [r["item"] for r in (found["top"] or []) if r["count"] >= least] if total else []
    listed = spark.createDataFrame([(k,) for k in keys], "k bigint")
    counted = (
        ends.select("graph_name", "node_id")
        .withColumn("k", _key())
        .join(F.broadcast(listed), "k", "left_semi")
        .groupBy("graph_name", "node_id")
        .agg(F.count("*").alias("n_rows"))
        .where(F.col("n_rows") >= F.lit(least))
    )
    return HeavyKeys(counted, limit, total)


def pair_rows(edges: DataFrame, graph: str = "graph_name", a: str = "node1", b: str = "node2") -> DataFrame:
    """(graph_name, low, high, n): the rows of every pair of endpoints in either order, by one aggregation with partial sums.

    The rows of a vertex spread over its pairs, and those of a pair meet as one partial sum a task, so neither a hub nor a
    pair that holds a third of all rows makes a task longer. With one null endpoint ``high`` is null; rows of two are left out.
    """
    x, y = F.col(a), F.col(b)
    own = edges.where(x.isNotNull() | y.isNotNull()).select(F.col(graph).alias("graph_name"), F.least(x, y).alias("low"), F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y)).alias("high"))
    return own.groupBy("graph_name", "low", "high").agg(F.count("*").alias("n"))


def vertex_degrees(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """(graph_name, node_id, degree, n_rows, heavy): every vertex's distinct neighbours other than itself and its rows.

    All rows are first summed up by pair of endpoints, each once for both its ends. Heavy vertices are picked by a broadcast
    join with their short list, light ones take the ordinary shuffle, and the two parts are united; what is shuffled are
    partial sums by vertex, so the share names the heavy vertices but no vertex of any size is a long task. A vertex whose
    only rows are loops or have a null at the other end has degree 0.
    """
    spark = edges.sparkSession
    heavy = heavy_vertices(edges, share)
    # At most heavy.limit rows: counted once, so that the choice of path does not repeat the two passes.
    named = [tuple(r) for r in heavy.rows.select("graph_name", "node_id").limit(heavy.limit).collect()]
    types = {f.name: f.dataType.simpleString() for f in heavy.rows.schema.fields}
    listed = F.broadcast(spark.createDataFrame(named, f"graph_name {types['graph_name']}, node_id {types['node_id']}"))
    end = lambda c, d: F.struct(F.col(c).alias("node_id"), F.lit(d).alias("d"))
    one = F.when(F.col("high").isNull() | (F.col("low") == F.col("high")), F.array(end("low", 0))).otherwise(F.array(end("low", 1), end("high", 1)))
    ends = pair_rows(edges).select("graph_name", "n", F.explode(one).alias("e")).select("graph_name", "n", "e.node_id", "e.d")
    same = (ends["graph_name"].eqNullSafe(listed["graph_name"])) & (ends["node_id"] == listed["node_id"])
    counted = lambda rows: rows.groupBy("graph_name", "node_id").agg(F.sum("d").alias("degree"), F.sum("n").alias("n_rows"))
    light, hot = counted(ends.join(listed, same, "left_anti")), counted(ends.join(listed, same, "left_semi"))
    return light.withColumn("heavy", F.lit(False)).unionByName(hot.withColumn("heavy", F.lit(True)))
