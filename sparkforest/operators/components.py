"""Connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.operators.edges import symmetrise, vertices_of
from sparkforest.plans import kernels
from sparkforest.plans.context import cut, cut_counted, forget
from sparkforest.plans.joins import BROADCAST_ROWS
from sparkforest.plans.scale import CALM_ROWS, fits_task, hot_join, in_one_task, is_small


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, small: bool | None = None) -> DataFrame:
    """(id, rep): every vertex with the smallest vertex of its component.

    ``vertices`` adds those without edges. Small graphs run in one task. Larger ones are contracted until they fit one; with
    small=False they are contracted to the end.
    """
    ids = vertices_of(edges) if vertices is None else vertices.select("id").unionByName(vertices_of(edges)).distinct()
    if is_small(edges, ids) if small is None else small:

        def kernel(given: dict) -> list:
            (own,), (u, v) = given["ids"], given["edges"]
            names, (_, a, b) = kernels.dense(own, u, v)
            return [names, names[kernels.components(len(names), a, b)]]

        return in_one_task({"ids": ids.select("id"), "edges": edges.select("u", "v")}, kernel, "id bigint, rep bigint")
    return by_contraction(edges, ids, finish=small is None)


def by_contraction(edges: DataFrame, ids: DataFrame, finish: bool = False) -> DataFrame:
    """(id, rep) by rounds that contract the graph.

    Each round every vertex takes the first of its edges in an order drawn anew by hashing, so that no numbering makes long
    chains, and hooks onto what lies up to four such edges away; the edges are rewritten to the vertices hooked onto, and
    those inside one fall away. At least half of the vertices with edges hook, all but one around a hub. At the end the
    rounds are followed backwards, the smallest first. With ``finish`` the rest is done in one task as soon as it fits.
    """
    left, n = cut_counted(edges.select("u", "v"))
    hooks: list[tuple[DataFrame, int]] = []
    while n["rows"]:
        if finish and fits_task(n["rows"]):
            hooks.append((cut(connected_components(left, small=True).where("id <> rep")), n["rows"]))
            break
        hook, m = _hooked(left, len(hooks), n["rows"])
        a = hot_join(left, hook.select(F.col("id").alias("u"), F.col("rep").alias("ru")), "u", "left", rows=n["rows"], right_rows=m["rows"])
        if m["rows"] > BROADCAST_ROWS:
            a = cut(a)  # the second join reads its left side more than once
        b = hot_join(a, hook.select(F.col("id").alias("v"), F.col("rep").alias("rv")), "v", "left", rows=n["rows"], right_rows=m["rows"])
        x, y = F.coalesce("ru", "u"), F.coalesce("rv", "v")
        before, (left, n) = left, cut_counted(b.where(x != y).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct())
        forget(before, *([a] if m["rows"] > BROADCAST_ROWS else []))
        hooks.append((hook, m["rows"]))
    if not hooks:
        return ids.select("id", F.col("id").alias("rep"))
    end: DataFrame | None = None
    total = 0
    for hook, m in reversed(hooks[1:]):
        if end is None:
            end, total = hook, m
            continue
        onward = hot_join(hook, end.select(F.col("id").alias("rep"), F.col("rep").alias("top")), "rep", "left", rows=m, right_rows=total).select("id", F.coalesce("top", "rep").alias("rep"))
        end, k = cut_counted(onward.unionByName(end.join(hook.select("id"), "id", "left_anti")))
        total = k["rows"]
    tops = ids.select("id").join(hooks[0][0], "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    if end is not None:
        tops, k = cut_counted(tops) if total > BROADCAST_ROWS else (tops, {"rows": None})
        tops = hot_join(tops, end.select(F.col("id").alias("rep"), F.col("rep").alias("top")), "rep", "left", rows=k["rows"], right_rows=total).select("id", F.coalesce("top", "rep").alias("rep"))
    named, n = cut_counted(tops.select("id", F.col("rep").alias("top")))
    least, k = cut_counted(named.groupBy("top").agg(F.min("id").alias("rep")))
    forget(*[h for h, _ in hooks])
    return hot_join(named, least, "top", rows=n["rows"], right_rows=k["rows"]).select("id", "rep")


def _hooked(edges: DataFrame, draw: int, rows: int) -> tuple[DataFrame, dict[str, int]]:
    """(id, rep) of the vertices that hook. The edge that is first for both its ends is kept by the smaller of them."""
    calm = rows <= CALM_ROWS
    first = symmetrise(edges).groupBy(F.col("src").alias("id")).agg(F.min(F.struct(F.xxhash64(F.lit(draw), F.least("src", "dst"), F.greatest("src", "dst")), "dst")).alias("first"))
    one = first.select("id", F.col("first.dst").alias("to"))
    one, n = (one, {"rows": rows}) if calm else cut_counted(one)
    two = hot_join(one, one.select(F.col("id").alias("to"), F.col("to").alias("on")), "to", "inner", calm, n["rows"], n["rows"])
    # Two of a pair: the smaller one stays, the larger one hooks onto it.
    own = F.col("on") == F.col("id")
    two = two.where(~(own & (F.col("id") < F.col("to")))).select("id", F.when(own, F.col("to")).otherwise(F.col("on")).alias("rep"))
    two, n = (two, {"rows": rows}) if calm else cut_counted(two)
    four = hot_join(two, two.select(F.col("id").alias("rep"), F.col("rep").alias("on")), "rep", "left", calm, n["rows"], n["rows"])
    return cut_counted(four.select("id", F.coalesce("on", "rep").alias("rep")))


def hooked_forest(edges: DataFrame, small: bool | None = None) -> DataFrame:
    """(u, v): the connecting edges recorded when components are found by hooking, a spanning forest of the graph.

    Every round each component hooks along its first outgoing edge in the order of (u, v), pointer jumping closes the trees,
    and of the edges between two components only the first goes on. The order makes the forest unique, and a round at
    least halves the components that have edges.
    """
    own = edges.select("u", "v")
    if is_small(own) if small is None else small:

        def kernel(given: dict) -> list:
            import numpy as np

            (u, v) = given["edges"]
            order = np.lexsort((v, u))
            u, v = u[order], v[order]
            names, (a, b) = kernels.dense(u, v)
            at = kernels.least_forest(len(names), a, b)
            return [u[at], v[at]]

        return in_one_task({"edges": own}, kernel, "u bigint, v bigint")
    left, n = cut_counted(own.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("u", "v").alias("edge")))
    taken: list[DataFrame] = []
    while n["rows"]:
        ends = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))
        first = left.select("edge", F.explode(ends).alias("e")).groupBy("e.id").agg(F.min(F.struct("edge", "e.to")).alias("f"))
        hook, m = cut_counted(first.select("id", "f.to", "f.edge"))
        taken.append(hook.select("edge.*").distinct())
        # Two components may choose the same edge; the smaller one stays.
        twin = hook.select(F.col("id").alias("to"), F.col("to").alias("back"))
        up = hot_join(hook, twin, "to", rows=m["rows"], right_rows=m["rows"])
        forest = cut(up.select("id", F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("to")), F.col("id")).otherwise(F.col("to")).alias("parent")))
        top, k = cut_counted(roots_of(forest))
        x = cut(hot_join(left, top.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", rows=n["rows"], right_rows=k["rows"]))
        y = hot_join(x, top.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", rows=n["rows"], right_rows=k["rows"]).where("ra <> rb")
        low, high = F.least("ra", "rb"), F.greatest("ra", "rb")
        before, (left, n) = left, cut_counted(y.groupBy(low.alias("a"), high.alias("b")).agg(F.min("edge").alias("edge")))
        forget(before, x, forest)
    return reduce(DataFrame.unionByName, taken) if taken else own.limit(0)


def roots_of(forest: DataFrame) -> DataFrame:
    """(id, root) by pointer jumping, every round one join of the moving vertices with the table."""
    from sparkforest.operators.trees import jump

    return jump(forest, small=False).select("id", "root")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("rep").agg(F.count("*").alias("size"))


def connect_components(edges: DataFrame, vertices: DataFrame | None = None, small: bool | None = None) -> DataFrame:
    """The edges plus one between the first vertices of each two successive components, which makes the graph connected."""
    from sparkforest.plans.prefix import ranked

    reps = connected_components(edges, vertices, small).where("id = rep").select("rep").withColumn("_all", F.lit(0))
    at = cut(ranked(reps, ["_all"], ["rep"], "k", bool(small) or is_small(reps)))
    links = at.select("k", F.col("rep").alias("u")).join(at.select((F.col("k") - 1).alias("k"), F.col("rep").alias("v")), "k")
    return edges.select("u", "v").unionByName(links.select("u", "v"))
