"""Forests by hooking and tours, changes between versions, and the pieces around them, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sparkforest.operators import components as C
from sparkforest.operators import contract as K
from sparkforest.operators import drift
from sparkforest.operators import edges as E
from sparkforest.operators import euler as U
from sparkforest.operators import generate as G
from sparkforest.operators import trees as R
from sparkforest.plans import joins, scale
from sparkforest.plans.context import cut, cut_counted, forget
from sparkforest.state import ForestState, repair_details
from sparkforest.streaming.batches import ForestStore
from tests.test_graph import BOTH, graph, parts, random_graph


def kruskal(pairs):
    out = []
    for e in sorted(pairs):
        top = parts(out, {x for p in pairs for x in p})
        if top[e[0]] != top[e[1]]:
            out.append(e)
    return out


@BOTH
@pytest.mark.parametrize("seed", [1, 2])
def test_hooking_edges_are_the_smallest_forest(spark, table_rows, small, seed):
    pairs = random_graph(seed, 40, 70)
    assert table_rows(C.hooked_forest(graph(spark, pairs), small)) == sorted(kruskal(pairs), key=repr)
    assert C.hooked_forest(graph(spark, pairs).limit(0), small).count() == 0


@BOTH
def test_a_forest_is_rooted_by_its_tour(spark, table_rows, small):
    r = random.Random(3)
    # A long path, a star and a lone vertex; the roots lie anywhere.
    tree = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(120, 200)]
    name = list(range(300))
    r.shuffle(name)
    tree = [tuple(sorted((name[a], name[b]))) for a, b in tree]
    ids = sorted({x for e in tree for x in e} | {name[299]})
    roots = [name[30], name[120]]
    got = dict(table_rows(U.orient(graph(spark, tree), spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame([(i,) for i in roots], "id bigint"), small)))
    assert sorted(got) == ids and {tuple(sorted(x)) for x in got.items() if x[0] != x[1]} == set(tree)
    assert {i for i, p in got.items() if i == p} == {*roots, name[299]}
    assert all(step != got[step] or step in (*roots, name[299]) for step in got)


@pytest.mark.parametrize("method", ["graft", "hook"])
def test_fragments_joined_without_levels(spark, table_rows, method):
    pairs = [p for p in random_graph(5, 60, 70)]
    e = cut(graph(spark, pairs))
    state = ForestState.from_edges(e, strategy=method)
    dead = graph(spark, random.Random(1).sample(pairs, 25))
    after = state.delete(dead)
    assert R.validate_forest(after.forest, after.edges).first()["valid"]
    back = after.insert(dead)
    assert R.validate_forest(back.forest, back.edges).first()["valid"] and table_rows(back.edges) == table_rows(e)
    with pytest.raises(ValueError):
        K.super_forest(e.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("u").alias("wa"), F.col("v").alias("wb")), "other")


def test_everything_by_rounds_gives_the_same_rows(spark, table_rows):
    e, dead = cut(graph(spark, random_graph(9))), graph(spark, random_graph(9)[::3])
    one = ForestState.from_edges(e).delete(dead)
    with scale.rounds_only():
        assert not scale.is_small(e.limit(0))
        many = ForestState.from_edges(e, how="bfs").delete(dead)
    assert scale.is_small(e) and table_rows(one.forest) == table_rows(many.forest)


def test_repair_details(spark):
    # A path 0..9 with a chord; the middle edge is cut, the far half turns round from 9.
    e = graph(spark, [(i, i + 1) for i in range(9)] + [(0, 9)])
    before = ForestState.from_edges(e)
    dead = graph(spark, [(0, 1)])
    row = repair_details(before, before.delete(dead), dead).first()
    assert (row["candidates"], row["cross_edges"]) == (1, 1) and row["min_path"] == row["max_path"] == row["median_path"] == 5
    none = repair_details(before, before.delete(dead.limit(0)), dead.limit(0)).first()
    assert none["cross_edges"] == 0 and none["max_path"] is None


def test_batch_sets_and_the_busiest_vertex(spark):
    e = cut(graph(spark, random_graph(4, 80, 160)))
    f = cut(ForestState.from_edges(e).forest)
    tree = {tuple(r) for r in E.tree_edges(f).select("u", "v").collect()}
    got = {}
    for r in G.batch_sets(e, f, {20: (5, 10)}, 3).collect():
        got.setdefault((r["total"], r["from_tree"], r["set"]), set()).add((r["u"], r["v"]))
    assert sorted(got) == [(20, t, k) for t in (5, 10) for k in range(3)]
    assert all(len(b) == 20 and len(b & tree) == t for (_, t, _), b in got.items()) and len({frozenset(b) for b in got.values()}) == 6
    assert {n: len(c) for n, c in G.MIXED_SIZES.items()} == {100: 4, 1000: 4, 10_000: 6, 100_000: 9}
    assert tuple(R.busiest_vertex(graph(spark, [(5, 1), (5, 2), (3, 1), (3, 4)])).first()) == (1, 2)
    assert R.busiest_vertex(e.limit(0)).count() == 0


def test_a_tour_stands_on_a_vertex_once_more_than_it_has_children(spark):
    f = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (9, 9)], "id bigint, parent bigint")
    at = {}
    for r in U.modified_tour(f).collect():
        at.setdefault(r["root"], {})[r["position"]] = (r["id"], r["level"])
    assert [at[0][k] for k in sorted(at[0])] == [(0, 0), (1, 1), (3, 2), (1, 1), (4, 2), (1, 1), (0, 0), (2, 1), (0, 0)] and at[9] == {0: (9, 0)}


def test_versions_are_kept_as_changes(spark, table_rows, tmp_path, monkeypatch):
    monkeypatch.setattr("sparkforest.state.COMPACT", 3)
    pairs = random_graph(6)
    store = ForestStore(spark, str(tmp_path / "s"))
    state = ForestState.from_edges(graph(spark, pairs))
    store.start(state)
    r = random.Random(2)
    for k in range(1, 6):
        some = graph(spark, r.sample(pairs, 9))
        new = state.delete(some) if k % 2 else state.insert(some)
        new.save(store.path, state)
        state = new
        back = ForestState.load(spark, store.path, k)
        assert table_rows(back.edges) == table_rows(new.edges) and table_rows(back.forest) == table_rows(new.forest)
    assert sorted(p.name for p in (tmp_path / "s" / "version=0000000003").iterdir()) == ["edges", "forest"]
    assert sorted(p.name for p in (tmp_path / "s" / "version=0000000005").iterdir()) == ["edge_changes", "forest_changes"]


def test_written_tables_are_counted_and_forgotten(spark):
    df, n = cut_counted(spark.range(10), even=F.col("id") % 2 == 0)
    assert n == {"rows": 10, "even": 5} and df.count() == 10
    empty, n = cut_counted(df.where("id < 0"), even=F.col("id") % 2 == 0)
    assert n == {"rows": 0, "even": 0} and empty.count() == 0 and empty.schema == df.schema
    forget(df, spark.range(1))
    with pytest.raises(Exception):
        df.count()


def test_broadcasts_look_at_bytes_too(spark, monkeypatch):
    wide = spark.createDataFrame([(1, "x" * 2000)], "id bigint, t string")
    assert joins.fits_broadcast(wide)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1000)
    assert not joins.fits_broadcast(wide) and joins.fits_broadcast(wide.select("id")) and joins.fits_broadcast(wide.limit(0))


FILES, LINES = "file_id bigint, series_name string, file_seq int", "line_id bigint, file_id bigint, line_no int, raw_line string"


def test_cells_of_any_length_repeated_names_and_broken_lines_are_kept(spark):
    long = "a,b" * 50_000
    texts = ["n,n,n,t", f'1,2,3,"{long}"', '4,"5,6,7', "8,9,,", '"1" ,2,3,4', "1,2,3,x,5,6", None]
    t = drift.consistent_table(spark.createDataFrame([(0, "s", 1)], FILES), spark.createDataFrame([(i, 0, i + 1, x) for i, x in enumerate(texts)], LINES))
    got = {r["line_id"]: r.asDict() for r in t.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert (got[1]["n"], got[1]["t"], got[1]["failed_casts"]) == (1, long, {"n#2": "2", "n#3": "3"})
    assert got[2]["n"] is None and got[2]["failed_casts"] == {"#line": '4,"5,6,7'} and got[4]["failed_casts"] == {"#line": '"1" ,2,3,4'}
    assert (got[3]["n"], got[3]["failed_casts"]) == (8, {"n#2": "9"}) and got[5]["failed_casts"] == {"n#2": "2", "n#3": "3", "#5": "5", "#6": "6"}
    assert got[6]["n"] is None and got[6]["failed_casts"] == {}
    assert drift.path_values('1,"x"', "a,a") == {("a", 1): ("1", "int"), ("a", 2): ("x", "text")} and drift.path_values("1", None) == {("", -1): ("1", "int")}


def test_a_link_between_names_side_by_side_is_refused(spark):
    files = spark.createDataFrame([(0, "s", 1), (1, "s", 2), (2, "r", 1)], FILES)
    lines = [(0, ["x,k", "1,7", "2,8"]), (1, ["y,k", "1,7", "2,8", "3,9"]), (2, ["x,y", "1,2"])]
    table = spark.createDataFrame([(10 * f + i, f, i + 1, t) for f, ts in lines for i, t in enumerate(ts)], LINES)
    assert {"x", "y"} <= set(drift.consistent_table(files, table).columns)
    assert {"x", "y"} & set(drift.consistent_table(files.where("file_id < 2"), table.where("file_id < 2")).columns) == {"x"}
