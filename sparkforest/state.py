"""A rooted spanning forest kept valid while batches of edges are deleted and inserted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparkforest.operators import edges as E
from sparkforest.operators.contract import fragments, replacements, super_edges, super_forest
from sparkforest.operators.reroot import reroot
from sparkforest.operators.traverse import bfs_forest, spanning_forest
from sparkforest.plans import kernels
from sparkforest.plans.context import cut
from sparkforest.plans.scale import fits_task, in_one_task, is_small


#: Every so many versions one is written whole.
COMPACT = 20


@dataclass(frozen=True)
class Repair:
    """What one repair saw: the cut forest, its fragments, the fragments' graph and forest, the edges taken."""

    cut: DataFrame
    frag: DataFrame
    supers: DataFrame
    above: DataFrame
    repl: DataFrame


@dataclass(frozen=True)
class ForestState:
    """Edges and forest of one version. Every change gives a new state; the old one stays as it was.

    strategy: ``sg``, ``hs``, ``graft`` or ``hook``, how the fragments' graph is searched. method: ``interval`` or ``lifting``, how paths turn.
    in_task: whether a graph that fits one task may be repaired there, with the same answer; else it takes the operators.
    """

    edges: DataFrame
    forest: DataFrame
    version: int = 0
    strategy: str = "sg"
    method: str = "interval"
    in_task: bool = True
    #: No more than so many edges and vertices; None if they were not counted.
    rows: int | None = None
    #: Gives what the last repair saw; worked out when asked for, if the repair ran in one task.
    last: Callable[[], Repair] | None = None

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, root: int | None = None, how: str = "bfs", strategy: str = "sg", method: str = "interval", in_task: bool = True) -> ForestState:
        """how: ``bfs`` (shallow trees, a round per level beyond one task) or ``graft`` (any depth in logarithmic rounds)."""
        own = cut(edges.select("u", "v"))
        small = is_small(own)
        forest = cut(bfs_forest(own, vertices, root, small).select("id", "parent") if how == "bfs" else spanning_forest(own, vertices, small))
        return cls(own, forest, 0, strategy, method, in_task, own.count() + forest.count())

    def delete(self, batch: DataFrame) -> ForestState:
        """The state without the batch's edges. Absent and repeated edges and loops in the batch change nothing."""
        b = cut(E.canonical(batch))
        left = cut(E.delete_edges(self.edges, b))
        return self._repaired(left, self.forest, b, None, self.rows)

    def insert(self, batch: DataFrame) -> ForestState:
        """The state with the batch's edges; new vertices join the forest. Only the batch is searched for edges that join two trees."""
        b = cut(E.absent(E.canonical(batch), self.edges))
        fresh = E.vertices_of(b).join(self.forest.select("id"), "id", "left_anti")
        forest = cut(self.forest.select("id", "parent").unionByName(fresh.select("id", F.col("id").alias("parent"))))
        rows = None if self.rows is None else self.rows + 3 * b.count()
        return self._repaired(cut(self.edges.unionByName(b)), forest, b.limit(0), b, rows)

    def _repaired(self, edges: DataFrame, forest: DataFrame, dead: DataFrame, fresh: DataFrame | None, rows: int | None) -> ForestState:
        """dead: the edges taken away. fresh: the only edges that may join two trees, by default all that are left."""
        small = fits_task(rows) if rows is not None else is_small(edges, forest)
        candidates = fresh if fresh is not None else edges

        def details() -> Repair:
            cutted = cut(E.cut_forest(forest, dead))
            frag = cut(fragments(cutted, small))
            supers = cut(super_edges(candidates if fresh is not None else E.absent(edges, E.tree_edges(cutted)), frag, small))
            if supers.isEmpty():
                return Repair(cutted, frag, supers, frag.limit(0).select("id", F.col("rep").alias("parent")), supers.select(F.col("a").alias("frag"), F.col("wa").alias("u"), F.col("wb").alias("v")))
            above = cut(super_forest(supers, self.strategy))
            return Repair(cutted, frag, supers, above, cut(replacements(above, supers)))

        if small and self.in_task and self.strategy in ("sg", "hs"):
            new, last = cut(_in_task(forest, candidates, dead)), details
        else:
            seen = details()
            # Where no edge joins two fragments the cut forest is the answer.
            new = seen.cut if seen.supers.isEmpty() else cut(reroot(seen.cut, seen.repl, self.method, small))
            last = lambda: seen
        return replace(self, edges=edges, forest=new, version=self.version + 1, rows=rows, last=last)

    def components(self) -> DataFrame:
        """(n_trees)"""
        return self.forest.agg(F.count_if(F.col("id") == F.col("parent")).alias("n_trees"))

    def save(self, path: str, before: ForestState | None = None) -> None:
        """Writes this version below path; a version written before is written over with the same rows.

        With ``before``, the version this one was made from, only what differs is written, save for every COMPACT-th version.
        """
        at = f"{path}/version={self.version:010d}"
        if before is None or self.version % COMPACT == 0:
            self.edges.write.mode("overwrite").parquet(f"{at}/edges")
            self.forest.write.mode("overwrite").parquet(f"{at}/forest")
            return
        gone, fresh = E.absent(before.edges, self.edges), E.absent(self.edges, before.edges)
        gone.withColumn("live", F.lit(False)).unionByName(fresh.withColumn("live", F.lit(True))).write.mode("overwrite").parquet(f"{at}/edge_changes")
        old = before.forest.select("id", F.col("parent").alias("was"))
        self.forest.join(old, "id", "left").where("was is null or was <> parent").select("id", "parent").write.mode("overwrite").parquet(f"{at}/forest_changes")

    @classmethod
    def load(cls, spark, path: str, version: int, **how) -> ForestState:
        """A version out of the last whole one and the changes since; the few changes are joined, the whole is only read."""
        at = lambda v, what: spark.read.parquet(f"{path}/version={v:010d}/{what}")
        base = version
        while True:
            try:
                edges, forest = at(base, "edges"), at(base, "forest")
                break
            except AnalysisException:
                if base == 0:
                    raise
                base -= 1
        changed = range(base + 1, version + 1)
        if changed:
            of = lambda what: reduce(DataFrame.unionByName, [at(v, what).withColumn("_v", F.lit(v)) for v in changed])
            e = cut(of("edge_changes").groupBy("u", "v").agg(F.max_by("live", "_v").alias("live")))
            f = cut(of("forest_changes").groupBy("id").agg(F.max_by("parent", "_v").alias("parent")))
            edges = E.absent(edges, e).unionByName(e.where("live").select("u", "v"))
            forest = forest.select("id", "parent").join(f.select("id"), "id", "left_anti").unionByName(f)
        return cls(edges, forest, version, **how)


def _in_task(forest: DataFrame, edges: DataFrame, dead: DataFrame) -> DataFrame:
    def kernel(given: dict) -> list:
        (ids, parents), (u, v), (x, y) = given["forest"], given["edges"], given["dead"]
        names, (a, b, u, v, x, y) = kernels.dense(ids, parents, u, v, x, y)
        parent = np.arange(len(names))
        parent[a] = b
        return [names[a], names[kernels.repair(len(names), parent, u, v, x, y)[a]]]

    return in_one_task({"forest": forest.select("id", "parent"), "edges": edges.select("u", "v"), "dead": dead.select("u", "v")}, kernel, "id bigint, parent bigint")


def repair_report(before: ForestState, after: ForestState, batch: DataFrame) -> DataFrame:
    """One row: batch edges, tree edges among them, fragments, pairs of fragments, replacement edges, trees before and after."""
    from sparkforest.operators.trees import side_by_side

    b = E.classify(E.canonical(batch), before.forest).agg(F.count("*").alias("batch_edges"), F.count_if("is_tree").alias("tree_edges"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    r = after.last()
    return side_by_side(b, one(r.cut.where("id = parent"), "fragments"), one(r.supers, "fragment_pairs"), one(r.repl, "replacements"), before.components().withColumnRenamed("n_trees", "trees_before"), after.components().withColumnRenamed("n_trees", "trees_after"))


def repair_details(before: ForestState, after: ForestState, batch: DataFrame) -> DataFrame:
    """One row: edges that might replace a deleted one, those of them between two fragments, and the fewest, most, mean and
    median vertices on the paths that turned round (null if none did)."""
    from sparkforest.operators.reroot import path_lengths
    from sparkforest.operators.trees import cross_edges, side_by_side

    r = after.last()
    left = cut(E.candidates(before.edges, E.canonical(batch), r.cut))
    between = cross_edges(left, r.frag).agg(F.count("*").alias("cross_edges"))
    n = path_lengths(r.cut, r.repl).agg(F.min("length").alias("min_path"), F.max("length").alias("max_path"), F.avg("length").alias("mean_path"), F.percentile("length", 0.5).alias("median_path"))
    return side_by_side(left.agg(F.count("*").alias("candidates")), between, n)
