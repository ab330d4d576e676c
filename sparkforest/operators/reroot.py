"""Path reversal: fragments re-rooted at the end of their replacement edge and attached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.operators.euler import preorder
from sparkforest.plans.context import cut
from sparkforest.plans.scale import hot_join, is_small


def path_by_intervals(forest: DataFrame, repl: DataFrame, small: bool) -> DataFrame:
    """(id, parent) of the vertices from each u up to its fragment's root: those whose preorder range holds u's number.

    An equality join on the fragment with one row per fragment, then the range test; no range join.
    """
    p = cut(preorder(forest, small))
    y = hot_join(repl.select(F.col("u").alias("id"), "frag"), p.select("id", F.col("pre").alias("y")), "id", "inner", small).select(F.col("frag").alias("root"), "y")
    on = hot_join(p, y, "root", "inner", small)
    return on.where("pre <= y and y < pre + size").select("id", "parent")


def path_lengths(forest: DataFrame, repl: DataFrame, small: bool | None = None) -> DataFrame:
    """(frag, length): how many vertices lie on the path that turns round, from each u up to its fragment's root, both counted."""
    from sparkforest.operators.trees import depths

    deep = depths(forest, small).select(F.col("id").alias("u"), "depth")
    return hot_join(cut(repl.select("frag", "u")), deep, "u", "inner", bool(small)).select("frag", (F.col("depth") + 1).alias("length"))


def _jump_tables(forest: DataFrame, small: bool) -> list[DataFrame]:
    """Tables (id, up) of the ancestors at distances 1, 2, 4 ... as far as there are any."""
    jumps = [cut(forest.where("id <> parent").select("id", F.col("parent").alias("up")))]
    while True:
        far = jumps[-1].select(F.col("id").alias("up"), F.col("up").alias("far"))
        nxt = cut(hot_join(jumps[-1], far, "up", "inner", small).select("id", F.col("far").alias("up")))
        if nxt.isEmpty():
            return jumps
        jumps.append(nxt)


def recorded_jumps(forest: DataFrame, small: bool | None = None) -> DataFrame:
    """(id, ancestor, distance): every vertex' ancestors at the distances that are powers of two."""
    small = is_small(forest) if small is None else small
    out: DataFrame | None = None
    for j, t in enumerate(_jump_tables(forest, small)):
        own = t.select("id", F.col("up").alias("ancestor"), F.lit(1 << j).cast("bigint").alias("distance"))
        out = own if out is None else out.unionByName(own)
    return out


def path_by_lifting(forest: DataFrame, repl: DataFrame, small: bool) -> DataFrame:
    """The same vertices by recorded jumps: ancestors at distances 1, 2, 4 ... are tabled, then from the longest jump down every marked vertex marks its ancestor."""
    f = forest.select("id", "parent")
    jumps = _jump_tables(f, small)
    marked = repl.select(F.col("u").alias("id")).distinct()
    for j in reversed(jumps):
        marked = cut(marked.unionByName(j.join(marked, "id", "left_semi").select(F.col("up").alias("id"))).distinct())
    return f.join(marked, "id", "left_semi")


def reroot(forest: DataFrame, repl: DataFrame, method: str = "interval", small: bool | None = None) -> DataFrame:
    """(id, parent): each fragment of ``repl(frag, u, v)``, at most one row per fragment, re-rooted at u and attached below v.

    The parents on the path from u to the fragment's root turn round, u gets the parent v, all others keep theirs.
    method: ``interval`` or ``lifting``; the answer is the same.
    """
    small = is_small(forest) if small is None else small
    path = {"interval": path_by_intervals, "lifting": path_by_lifting}[method](forest, repl, small)
    turned = path.where("id <> parent").select(F.col("parent").alias("id"), F.col("id").alias("new"), F.lit(1).alias("rank"))
    attached = repl.select(F.col("u").alias("id"), F.col("v").alias("new"), F.lit(2).alias("rank"))
    update = turned.unionByName(attached).groupBy("id").agg(F.max_by("new", "rank").alias("new"))
    return forest.select("id", "parent").join(update, "id", "left").select("id", F.coalesce("new", "parent").alias("parent"))
