"""Rooted forests: roots, depths, subtree folds, statistics and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.operators.edges import degrees, tree_edges
from sparkforest.plans import kernels
from sparkforest.plans.context import cut, cut_counted, forget
from sparkforest.plans.scale import fits_task, hot_join, in_one_task, is_small


def jump(forest: DataFrame, weight: str | None = None, small: bool | None = None, second: str | None = None) -> DataFrame:
    """(id, root, total[, second]): the root of every vertex and the sum of ``weight`` (1 without) from the vertex up to, not
    with, the root; likewise of a second column if one is named.

    Pointer doubling: a chain of length n takes log2 n rounds, each one join of the table with itself.
    """
    sums = {"total": F.lit(1) if weight is None else F.col(weight)} | ({} if second is None else {"second": F.col(second)})
    own = forest.select("id", "parent", *[c.cast("bigint").alias(n) for n, c in sums.items()])
    if is_small(forest) if small is None else small:

        def kernel(given: dict) -> list:
            import numpy as np

            ids, parents, *weights = given["forest"]
            names, (a, b) = kernels.dense(ids, parents)
            parent, totals = np.arange(len(names)), []
            parent[a] = b
            root = parent
            for w in weights:
                full = np.zeros(len(names), dtype=np.int64)
                full[a] = w
                root, total = kernels.jump(parent, full)
                totals.append(total[a])
            return [names[a], names[root[a]], *totals]

        return in_one_task({"forest": own}, kernel, ", ".join(f"{c} bigint" for c in ("id", "root", *sums)))
    return _jump_rounds(own, list(sums))


def _jump_rounds(own: DataFrame, sums: list[str]) -> DataFrame:
    """jump by joins. A vertex that has reached its root is settled: later rounds look it up, but move and write the others only."""
    is_root = F.col("id") == F.col("parent")
    start, n = cut_counted(own.select("id", F.col("parent").alias("root"), *[F.when(is_root, 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in sums], is_root.alias("at_root")), left=~F.col("at_root"))
    parts, moving, left = [start], start.where("not at_root").drop("at_root"), n["left"]
    while left:
        settled = [p.where("at_root").drop("at_root") for p in parts]
        ups = [p.select(F.col("id").alias("root"), F.col("root").alias("up"), *[F.col(c).alias(f"{c}_up") for c in sums], F.lit(i < len(settled)).alias("at_root")) for i, p in enumerate([*settled, moving])]
        met = hot_join(moving, reduce(DataFrame.unionByName, ups), "root", rows=left, right_rows=n["rows"])
        new, seen = cut_counted(met.select("id", F.col("up").alias("root"), *[(F.col(c) + F.col(f"{c}_up")).alias(c) for c in sums], "at_root"), left=~F.col("at_root"))
        if seen["left"] == left:
            # Of the vertices on a path to a root the next always arrives.
            raise ValueError("the parents have a cycle")
        parts.append(new)
        moving, left = new.where("not at_root").drop("at_root"), seen["left"]
    return reduce(DataFrame.unionByName, [p.where("at_root").drop("at_root") for p in parts])


def list_ranks(lists: DataFrame, small: bool | None = None, finish: bool = False) -> DataFrame:
    """(id, left): how many elements come after each in its list; ``next`` is null at a list's end and no element is next of two.

    Rounds that shorten the lists: coins are thrown by hashing, and an element with heads takes in the one after it if that shows
    tails, which is known without a join. A quarter of a long list goes each round, so all rounds together read a few
    times the first, where pointer doubling moves the whole list in each. Then the elements taken in get their ranks, the
    last ones first. With ``finish`` the rest is ranked in one task as soon as it fits.
    """
    own = lists.select("id", "next", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("bigint").alias("w"))
    if is_small(lists) if small is None else small:
        return _ranks_in_one_task(own)
    rest, n = cut_counted(own, more=F.col("next").isNotNull())
    taken: list[DataFrame] = []
    while n["more"] and not (finish and fits_task(n["rows"])):
        heads = lambda c: F.pmod(F.xxhash64(F.lit(len(taken)), F.col(c)), F.lit(2)) == 1  # noqa: E731, B023
        takes = heads("id") & F.col("next").isNotNull() & ~heads("next")
        by = rest.where(takes).select(F.col("next").alias("id"), F.col("id").alias("by"), F.col("w").alias("w_by"))
        met = cut(rest.where(~heads("id")).join(by, "id", "left"))
        gone = met.where("by is not null")
        stay = rest.where(heads("id") & ~takes).unionByName(met.where("by is null").select("id", "next", "w"))
        before, (rest, n) = rest, cut_counted(stay.unionByName(gone.select(F.col("by").alias("id"), "next", (F.col("w_by") + F.col("w")).alias("w"))), more=F.col("next").isNotNull())
        forget(before)
        taken.append(gone.select("id", "by", "w_by"))
    out = cut(_ranks_in_one_task(rest)) if n["more"] else rest.select("id", F.col("w").alias("left"))
    for gone in reversed(taken):
        # What an element leaves behind is what its taker has after it, less the way to it.
        found = gone.join(out.withColumnRenamed("id", "by"), "by").select("id", (F.col("left") - F.col("w_by")).alias("left"))
        out = cut(out.unionByName(found))
    return out


def _ranks_in_one_task(own: DataFrame) -> DataFrame:
    def kernel(given: dict) -> list:
        import numpy as np

        ids, onto, w = given["lists"]
        names, (a, b) = kernels.dense(ids, onto)
        parent, weight = np.arange(len(names)), np.zeros(len(names), dtype=np.int64)
        parent[a], weight[a] = b, w
        root, total = kernels.jump(parent, weight)
        return [names[a], total[a] + weight[root[a]]]

    return in_one_task({"lists": own.select("id", F.coalesce("next", "id").alias("next"), "w")}, kernel, "id bigint, left bigint")


_FOLDS = {"sum": (F.sum, "add"), "min": (F.min, "minimum"), "max": (F.max, "maximum")}


def subtree_fold(forest: DataFrame, value: str, fold: str = "sum", small: bool | None = None) -> DataFrame:
    """(id, value): sum, min or max of ``value`` over each vertex' subtree, itself included, by doubling."""
    own = forest.select("id", "parent", F.col(value).cast("bigint").alias("value"))
    agg, ufunc = _FOLDS[fold]
    if is_small(forest) if small is None else small:

        def kernel(given: dict) -> list:
            import numpy as np

            (ids, parents, values) = given["forest"]
            names, (a, b) = kernels.dense(ids, parents)
            parent, val = np.arange(len(names)), np.zeros(len(names), dtype=np.int64)
            parent[a], val[a] = b, values
            return [names[a], kernels.subtree(parent, val, getattr(np, ufunc))[a]]

        return in_one_task({"forest": own}, kernel, "id bigint, value bigint")
    # Round t takes the vertices with an ancestor at distance 2^t, and hands it what they hold; only they move on.
    active, n = cut_counted(own.where("id <> parent").select("id", F.col("parent").alias("up"), "value"))
    given, left = [own.select("id", "value")], n["rows"]
    while left:
        moved = active.groupBy(F.col("up").alias("id")).agg(agg("value").alias("more"))
        given.append(moved.select("id", F.col("more").alias("value")))
        far = hot_join(active, active.select(F.col("id").alias("up"), F.col("up").alias("far")), "up", rows=left, right_rows=left)
        both = {"sum": F.col("value") + F.coalesce("more", F.lit(0)), "min": F.least("value", "more"), "max": F.greatest("value", "more")}[fold]
        active, n = cut_counted(far.join(moved, "id", "left").select("id", F.col("far").alias("up"), both.alias("value")))
        left = n["rows"]
    return reduce(DataFrame.unionByName, given).groupBy("id").agg(agg("value").alias("value"))


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """The columns of tables of one row each as one row."""
    whole = one_row[0]
    for df in one_row[1:]:
        whole = whole.unionByName(df, allowMissingColumns=True)
    return whole.agg(*[F.max(c).alias(c) for c in whole.columns])


def find_roots(forest: DataFrame) -> DataFrame:
    return forest.where("id = parent").select("id")


def tree_or_forest(forest: DataFrame) -> DataFrame:
    """(n_roots, is_tree, root): root is that of the single tree, null for a forest or an empty table."""
    return forest.where("id = parent").agg(F.count("*").alias("n_roots"), F.min("id").alias("r")).select("n_roots", (F.col("n_roots") == 1).alias("is_tree"), F.when(F.col("n_roots") == 1, F.col("r")).alias("root"))


def renumber(labels: DataFrame, small: bool | None = None) -> DataFrame:
    """(rep, k): the representatives numbered from 0 in ascending order."""
    from sparkforest.plans.prefix import ranked

    reps = labels.select("rep").distinct().withColumn("_all", F.lit(0))
    return ranked(reps, ["_all"], ["rep"], "k", is_small(reps) if small is None else small).select("rep", "k")


def label_counts(forest: DataFrame, labels: DataFrame) -> DataFrame:
    """(n_vertices, n_components, n_roots)"""
    a = labels.agg(F.count("*").alias("n_vertices"), F.countDistinct("rep").alias("n_components"))
    b = forest.agg(F.count_if(F.col("id") == F.col("parent")).alias("n_roots"))
    return side_by_side(a, b)


def depths(forest: DataFrame, small: bool | None = None) -> DataFrame:
    """(id, root, depth), a root at depth 0."""
    return jump(forest, small=small).select("id", "root", F.col("total").alias("depth"))


def path_statistics(tree_depths: DataFrame) -> DataFrame:
    """(min_depth, max_depth, mean_depth, mean_of_distinct_depths, median_depth), means and median cut to whole numbers where the name says whole_."""
    d = tree_depths.groupBy("depth").agg(F.count("*").alias("n"))  # one row per depth
    return d.agg(
        F.min("depth").alias("min_depth"),
        F.max("depth").alias("max_depth"),
        (F.sum(F.col("depth") * F.col("n")) / F.sum("n")).alias("mean_depth"),
        F.floor(F.avg("depth")).alias("whole_mean_of_distinct_depths"),
        F.floor(F.percentile("depth", 0.5, F.col("n"))).alias("whole_median_depth"),
    )


def cross_edges(edges: DataFrame, labels: DataFrame, small: bool = False) -> DataFrame:
    """(u, v, ru, rv): edges whose ends have different representatives."""
    a = hot_join(edges.select("u", "v"), labels.select(F.col("id").alias("u"), F.col("rep").alias("ru")), "u", "inner", small)
    b = hot_join(a, labels.select(F.col("id").alias("v"), F.col("rep").alias("rv")), "v", "inner", small)
    return b.where("ru <> rv").select("u", "v", "ru", "rv")


def graph_statistics(edges: DataFrame, vertices: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """One row: n_vertices, n_edges, density, min, mean, median, max degree, sample variance of the degree.

    density is directed edges over possible pairs. With ``compat`` the variance is taken around the mean cut to a whole number.
    """
    d = degrees(edges, vertices)
    mean = F.floor(F.avg("degree")) if compat else F.avg("degree")
    base = d.agg(F.count("*").alias("n_vertices"), F.sum("degree").alias("two_e"), mean.cast("double").alias("around"), F.min("degree").alias("min_degree"), F.avg("degree").alias("mean_degree"), F.percentile("degree", 0.5).alias("median_degree"), F.max("degree").alias("max_degree"), F.sum(F.col("degree") * F.col("degree")).alias("sq"))
    n, e2 = F.col("n_vertices"), F.col("two_e")
    spread = (F.col("sq") - 2 * F.col("around") * e2 + n * F.col("around") * F.col("around")) / F.nullif(n - 1, F.lit(0))
    return base.select("n_vertices", (e2 / 2).cast("bigint").alias("n_edges"), (e2 / F.nullif(n * (n - 1) / 2, F.lit(0.0))).alias("density"), "min_degree", "mean_degree", "median_degree", "max_degree", spread.alias("degree_variance"))


def busiest_vertex(edges: DataFrame) -> DataFrame:
    """(id, degree): the smallest of the vertices with the most neighbours; no row for an empty graph."""
    best = degrees(edges).agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("b"))
    return best.where("b is not null").select((-F.col("b.minus")).alias("id"), F.col("b.degree").alias("degree"))


def validate_forest(forest: DataFrame, edges: DataFrame, small: bool | None = None) -> DataFrame:
    """One row: n_vertices, n_trees, foreign_edges (tree edges that are no edges), split_edges (edges between two trees), valid.

    A forest is valid if its edges are the graph's, no edge joins two trees, and the parents have no cycle (which raises).
    """
    top = cut(jump(forest, small=small).select("id", F.col("root").alias("rep")))  # by rounds only if the vertices fit no task; the edges don't count here
    small = is_small(edges, forest) if small is None else small
    foreign = tree_edges(forest).join(edges.select("u", "v"), ["u", "v"], "left_anti").agg(F.count("*").alias("foreign_edges"))
    split = cross_edges(edges, top, small).agg(F.count("*").alias("split_edges"))
    n = forest.agg(F.count("*").alias("n_vertices"), F.count_if(F.col("id") == F.col("parent")).alias("n_trees"))
    return side_by_side(n, foreign, split).withColumn("valid", (F.col("foreign_edges") == 0) & (F.col("split_edges") == 0))
