"""Breadth-first and depth-first forests, and spanning forests in few rounds."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.operators.components import connected_components
from sparkforest.operators.edges import symmetrise
from sparkforest.plans import kernels
from sparkforest.plans.context import cut, cut_counted, forget
from sparkforest.plans.scale import CALM_ROWS, hot_join, hot_keys, in_one_task, is_small

MERGED = 16


def seeds(labels: DataFrame, root: int | None = None) -> DataFrame:
    """(id): the root of each component, its smallest vertex, or ``root`` in the component that holds it."""
    own = labels.where("id = rep").select("id", "rep")
    if root is None:
        return own.select("id")
    chosen = labels.where(F.col("id") == root).select(F.col("id").alias("chosen"), "rep")  # one row at most
    return own.join(F.broadcast(chosen), "rep", "left").select(F.coalesce("chosen", "id").alias("id"))


def bfs_forest(edges: DataFrame, vertices: DataFrame | None = None, root: int | None = None, small: bool | None = None) -> DataFrame:
    """(id, parent, level): all components' breadth-first trees at once; parent is the smallest neighbour one level up.

    A root is its own parent at level 0; a vertex without edges is a root. One round per level beyond SMALL_ROWS: for graphs
    of great depth take spanning_forest, whose rounds grow with the logarithm.
    """
    given, small = small, is_small(edges) if small is None else small
    labels = cut(connected_components(edges, vertices, small or given))  # a large graph's rest is joined up in one task, unless told otherwise
    return bfs_from(edges, labels.select("id"), seeds(labels, root), small)


def bfs_levels(edges: DataFrame, vertices: DataFrame | None, source: int, small: bool | None = None) -> DataFrame:
    """(id, parent, level) from one source; vertices out of its reach have level -1 and are their own parents."""
    small = is_small(edges) if small is None else small
    from sparkforest.operators.edges import vertices_of

    ids = vertices_of(edges) if vertices is None else vertices.select("id").unionByName(vertices_of(edges)).distinct()
    return bfs_from(edges, ids, ids.where(F.col("id") == source), small)


def bfs_from(edges: DataFrame, ids: DataFrame, roots: DataFrame, small: bool) -> DataFrame:
    if small:

        def kernel(given: dict) -> list:
            (own,), (u, v), (top,) = given["ids"], given["edges"], given["roots"]
            names, (_, a, b, r) = kernels.dense(own, u, v, top)
            parent, level = kernels.breadth_first(len(names), a, b, r)
            return [names, names[parent], level]

        return in_one_task({"ids": ids.select("id"), "edges": edges.select("u", "v"), "roots": roots.select("id")}, kernel, "id bigint, parent bigint, level bigint")
    return _bfs_rounds(edges, ids, roots)


def _bfs_rounds(edges: DataFrame, ids: DataFrame, roots: DataFrame) -> DataFrame:
    """A round, which is one job, per level. A round reads the edges and the last two levels; levels are appended, and every
    MERGED tables of a kind become one, so a row is rewritten as often as the depth has digits to that base."""
    sym, m = cut_counted(symmetrise(edges))
    hot = hot_keys(sym, "src", m["rows"]) if m["rows"] > CALM_ROWS else []
    front, n = cut_counted(roots.select("id", F.col("id").alias("parent"), F.lit(0).cast("bigint").alias("level")))
    tiers: list[list[DataFrame]] = [[front]]
    before, level = None, 0
    while n["rows"]:
        level += 1
        reached = hot_join(sym, front.select(F.col("id").alias("src")), "src", "left_semi", rows=m["rows"], right_rows=n["rows"], hot=hot)
        above = reached.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        # In an undirected graph the neighbours of a level lie in it, in the one above or in the next.
        seen = front.select("id") if before is None else front.select("id").unionByName(before.select("id"))
        before, (front, n) = front, cut_counted(above.join(seen, "id", "left_anti").select("id", "parent", F.lit(level).cast("bigint").alias("level")))
        tiers[0].append(front)
        for k in range(len(tiers)):
            # The two last levels stay as they are, for the rounds still read them.
            own = tiers[k][:-2] if k == 0 else tiers[k]
            if len(own) >= MERGED:
                one = cut(reduce(DataFrame.unionByName, own))
                forget(*own)
                tiers[k] = tiers[k][-2:] if k == 0 else []
                if k + 1 == len(tiers):
                    tiers.append([])
                tiers[k + 1].append(one)
    done = reduce(DataFrame.unionByName, [t for tier in tiers for t in tier])
    forget(sym)
    rest = ids.select("id").join(done.select("id"), "id", "left_anti")
    return done.unionByName(rest.select("id", F.col("id").alias("parent"), F.lit(-1).cast("bigint").alias("level")))


def dfs_forest(edges: DataFrame, vertices: DataFrame | None = None, small: bool | None = None) -> DataFrame:
    """(id, parent, preorder): depth-first trees rooted at each component's smallest vertex, neighbours pushed in ascending order.

    Depth-first order is sequential, so one task finds it, whatever the size. Beyond SMALL_ROWS Spark sorts both directions of
    the edges, on disk where need be, and the task streams them into files of its local folder, on which it searches.
    """
    from sparkforest.operators.edges import vertices_of

    ids = vertices_of(edges) if vertices is None else vertices.select("id").unionByName(vertices_of(edges)).distinct()
    schema = "id bigint, parent bigint, preorder bigint"
    if is_small(edges, ids) if small is None else small:

        def kernel(given: dict) -> list:
            (own,), (u, v) = given["ids"], given["edges"]
            names, (_, a, b) = kernels.dense(own, u, v)
            parent, number = kernels.depth_first(len(names), a, b)
            return [names, names[parent], number]

        return in_one_task({"ids": ids, "edges": edges.select("u", "v")}, kernel, schema)
    rows = ids.select(F.lit(0).alias("part"), F.col("id").alias("src"), F.lit(0).cast("bigint").alias("dst")).unionByName(symmetrise(edges).select(F.lit(1).alias("part"), "src", "dst"))
    # coalesce would sort in one task too; the exchange lets the tables before it keep their tasks.
    return rows.repartition(1).sortWithinPartitions("part", "src", "dst").mapInArrow(_dfs_on_disk, schema)


def _dfs_on_disk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dfs_forest of rows (part, src, dst), sorted: first the vertices, then both directions of the edges. Every array of the
    search is a mapped file, so what stays in memory is the system's to decide."""
    local = next((x for x in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(x)), None)
    with tempfile.TemporaryDirectory(dir=local) as folder:

        def mapped(name: str, rows: int) -> np.ndarray:
            """A file of so many bigints; one that is not there is made, filled with 0."""
            at = os.path.join(folder, name)
            if not rows:
                return np.empty(0, np.int64)
            return np.asarray(np.memmap(at, np.int64, "r+" if os.path.exists(at) else "w+", shape=(rows,)))

        n = m = 0
        names = first = None
        with open(os.path.join(folder, "names"), "wb") as ids, open(os.path.join(folder, "dst"), "wb") as arcs:
            for b in batches:
                part, src, dst = (b.column(i).to_numpy() for i in range(3))
                own = src[part == 0]
                ids.write(own.tobytes())
                n += len(own)
                src, dst = src[part == 1], dst[part == 1]
                if not len(src):
                    continue
                if names is None:
                    ids.flush()
                    names, first = mapped("names", n), mapped("first", n + 1)
                at, size = np.unique(np.searchsorted(names, src), return_counts=True)
                first[at + 1] += size
                arcs.write(np.searchsorted(names, dst).astype(np.int64).tobytes())
                m += len(dst)
        names, first, dst = mapped("names", n), mapped("first", n + 1), mapped("dst", m)
        left, parent, number = (mapped(x, n) for x in ("left", "parent", "number"))
        np.cumsum(first, out=first)
        left[:] = first[1:]
        number[:] = -1
        kernels.descend(first, dst, left, parent, number)
        for k in range(0, n, 100_000):
            part = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array(names[parent[part]]), pa.array(number[part])], names=["id", "parent", "preorder"])


def spanning_forest(edges: DataFrame, vertices: DataFrame | None = None, small: bool | None = None) -> DataFrame:
    """(id, parent): a rooted spanning forest by grafting and path reversal, in rounds that grow with the logarithm of the vertices.

    Every round, each tree whose root is not its smallest choice grafts onto a neighbouring tree with a smaller root, through
    its smallest such edge: the tree is re-rooted at that edge's end by reversing one path, and attached.
    """
    from sparkforest.operators.edges import vertices_of
    from sparkforest.operators.reroot import reroot
    from sparkforest.operators.trees import jump

    small = is_small(edges) if small is None else small
    ids = vertices_of(edges) if vertices is None else vertices.select("id").unionByName(vertices_of(edges)).distinct()
    forest = cut(ids.select("id", F.col("id").alias("parent")))
    left = cut(symmetrise(edges))
    while True:
        top = cut(jump(forest, small=small).select("id", "root"))
        a = hot_join(left, top.select(F.col("id").alias("src"), F.col("root").alias("rs")), "src", "inner", small)
        b = hot_join(a, top.select(F.col("id").alias("dst"), F.col("root").alias("rd")), "dst", "inner", small)
        cross = cut(b.where("rs <> rd"))
        if cross.isEmpty():
            return forest
        best = cross.where("rd < rs").groupBy(F.col("rs").alias("frag")).agg(F.min(F.struct("rd", "src", "dst")).alias("b"))
        forest = cut(reroot(forest, best.select("frag", F.col("b.src").alias("u"), F.col("b.dst").alias("v")), small=small))
        left = cross.select("src", "dst")
