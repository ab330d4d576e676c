"""Graph operators against plain Python, in one task and by rounds of joins."""

import random

import pytest

from sparkforest.operators import bridges as B
from sparkforest.operators import components as C
from sparkforest.operators import contract as K
from sparkforest.operators import edges as E
from sparkforest.operators import euler as U
from sparkforest.operators import generate as G
from sparkforest.operators import reroot as RR
from sparkforest.operators import traverse as T
from sparkforest.operators import trees as R
from sparkforest.plans import joins, scale
from sparkforest.state import ForestState, repair_report

BOTH = pytest.mark.parametrize("small", [True, False])


def graph(spark, pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "u bigint, v bigint")


def random_graph(seed, n=60, m=70):
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)})


def parts(pairs, ids=()):
    top = {x: x for p in pairs for x in p} | {x: x for x in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


def bfs(pairs):
    near = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    rep, out = parts(pairs), {}
    for r in sorted(set(rep.values())):
        out[r] = (r, 0)
        front, level = [r], 0
        while front:
            level += 1
            nxt = sorted({y for x in front for y in near[x] if y not in out})
            for y in nxt:
                out[y] = (min(x for x in near[y] if x in set(front)), level)
            front = nxt
    return sorted((x, p, k) for x, (p, k) in out.items())


def is_forest(forest, pairs):
    rep = parts(pairs, [x for x, _ in forest])
    up = dict(forest)
    for x, p in forest:
        assert x == p or tuple(sorted((x, p))) in set(pairs)
        seen = set()
        while up[x] != x:
            assert x not in seen
            seen.add(x)
            x = up[x]
    assert sum(x == p for x, p in forest) == len(set(rep.values()))


@BOTH
def test_components_and_bfs(spark, table_rows, small):
    pairs = random_graph(1)
    e = graph(spark, pairs)
    assert dict(C.connected_components(e, small=small).collect()) == parts(pairs)
    assert table_rows(T.bfs_forest(e, small=small).select("id", "parent", "level")) == sorted(bfs(pairs), key=repr)


@BOTH
def test_isolated_vertices_loops_and_empty_graph(spark, table_rows, small):
    v = spark.createDataFrame([(7,), (2**40,)], "id bigint")
    none = graph(spark, [])
    assert table_rows(C.connected_components(none, v, small)) == [(2**40, 2**40), (7, 7)]
    assert C.connected_components(none, small=small).count() == 0
    assert T.bfs_forest(none, v, small=small).count() == 2
    assert T.bfs_forest(none, small=small).count() == 0
    state = ForestState.from_edges(none)
    assert state.delete(graph(spark, [(1, 2)])).forest.count() == 0
    grown = state.insert(graph(spark, [(1, 2), (2, 1), (3, 3)]))
    assert table_rows(grown.forest) == [(1, 2), (2, 2)] or table_rows(grown.forest) == [(1, 1), (2, 1)]


def test_canonical_drops_loops_nulls_repeats_and_ignores_other_columns(spark, table_rows):
    df = spark.createDataFrame([(2, 1, "x"), (1, 2, "y"), (3, 3, "z"), (None, 1, "n"), (4, None, "n")], "u bigint, v bigint, id string")
    assert table_rows(E.canonical(df)) == [(1, 2)]


@BOTH
def test_path_of_many_vertices_takes_few_rounds(spark, small):
    n = 70 if not small else 1 << 14
    f = spark.range(n).selectExpr("id", "greatest(id - 1, 0) parent")
    assert R.jump(f, small=small).agg({"total": "max"}).first()[0] == n - 1
    p = U.preorder(f, small).where(f"id = {n - 1}").first()
    assert (p["pre"], p["size"], p["depth"], p["root"]) == (n - 1, 1, n - 1, 0)


def test_cycle_of_parents_raises(spark):
    f = spark.createDataFrame([(1, 2), (2, 1)], "id bigint, parent bigint")
    with pytest.raises(Exception, match="cycle"):
        R.jump(f, small=True).collect()


def random_forest(seed, n=80):
    r = random.Random(seed)
    names = r.sample(range(1000), n)
    return [(names[i], names[i] if i == 0 or r.random() < 0.1 else names[r.randrange(i)]) for i in range(n)]


@BOTH
@pytest.mark.parametrize("seed", [3, 4])
def test_intervals_are_those_of_an_explicit_tour(spark, small, seed):
    forest = random_forest(seed)
    below = {}
    for x, p in forest:
        if x != p:
            below.setdefault(p, []).append(x)
    want = {}

    def walk(x, k):
        kids = sorted(below.get(x, []))
        first = k
        for c in kids:
            k = walk(c, k + 1)
        want[x] = (first, k)
        return k + 1

    for x, p in forest:
        if x == p:
            walk(x, 0)
            if x not in below:
                want[x] = (0, 1)
    got = {r["id"]: (r["first"], r["last"]) for r in U.intervals(spark.createDataFrame(forest, "id bigint, parent bigint"), small).collect()}
    assert got == want


@BOTH
def test_subtree_folds(spark, small):
    forest = random_forest(9)
    up = dict(forest)
    value = {x: (x * 37) % 101 for x, _ in forest}
    df = spark.createDataFrame([(x, p, value[x]) for x, p in forest], "id bigint, parent bigint, w bigint")
    held = {x: [] for x, _ in forest}
    for x, _ in forest:
        y = x
        while True:
            held[y].append(value[x])
            if up[y] == y:
                break
            y = up[y]
    for name, f in (("sum", sum), ("min", min), ("max", max)):
        assert dict(R.subtree_fold(df, "w", name, small).collect()) == {x: f(v) for x, v in held.items()}


@pytest.mark.parametrize("seed", range(3))
def test_repair_is_the_same_by_every_way_and_survives_random_batches(spark, table_rows, seed):
    r = random.Random(seed)
    pairs = random_graph(seed + 20)
    e = graph(spark, pairs)
    gone = r.sample(pairs, 25) + [(998, 999)]
    batch = graph(spark, [(v, u) for u, v in gone] + [gone[0]])
    states = [ForestState.from_edges(e, strategy=s, method=m, in_task=t) for s, m, t in (("sg", "interval", True), ("sg", "interval", False), ("hs", "lifting", False))]
    after = [s.delete(batch) for s in states]
    left = sorted(set(pairs) - set(gone))
    forests = [table_rows(s.forest) for s in after]
    assert forests[0] == forests[1] == forests[2]
    is_forest(forests[0], left)
    # What was no tree edge on a cut path keeps its parent.
    back = [s.insert(graph(spark, gone)) for s in after[:2]]
    forests = [table_rows(s.forest) for s in back]
    assert forests[0] == forests[1]
    is_forest(forests[0], sorted(set(pairs) | set(gone)))
    report = repair_report(states[0], after[0], batch).first()
    assert report["batch_edges"] == 26 and report["trees_after"] == len(set(parts(left, {x for p in pairs for x in p}).values()))


def test_delete_everything(spark, table_rows):
    e = graph(spark, random_graph(5))
    state = ForestState.from_edges(e).delete(e)
    assert state.edges.count() == 0 and state.forest.where("id <> parent").count() == 0


def test_grafted_and_depth_first_forests_are_valid(spark, table_rows):
    pairs = random_graph(8)
    e = graph(spark, pairs)
    is_forest(table_rows(T.spanning_forest(e, small=True)), pairs)
    is_forest(table_rows(T.dfs_forest(e).select("id", "parent")), pairs)
    assert R.validate_forest(T.spanning_forest(e, small=True), e).first()["valid"]
    wrong = spark.createDataFrame([(x, x) for p in pairs for x in p], "id bigint, parent bigint").distinct()
    assert not R.validate_forest(wrong, e).first()["valid"]


@BOTH
def test_reroot_methods_agree(spark, table_rows, small):
    forest = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 2), (9, 9), (8, 9)], "id bigint, parent bigint")
    repl = spark.createDataFrame([(9, 8, 4)], "frag bigint, u bigint, v bigint")
    want = sorted([(1, 1), (2, 1), (3, 2), (4, 3), (5, 2), (8, 4), (9, 8)], key=repr)
    for m in ("interval", "lifting"):
        assert table_rows(RR.reroot(forest, repl, m, small)) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_bridges_cut_vertices_and_blocks(spark, table_rows, seed):
    pairs = random_graph(seed, 30, 34)
    e = graph(spark, pairs)
    ids = {x for p in pairs for x in p}
    whole = len(set(parts(pairs).values()))
    want = [p for p in pairs if len(set(parts([q for q in pairs if q != p], ids).values())) > whole]
    assert table_rows(B.bridges(e)) == sorted(want, key=repr)
    cuts = [x for x in ids if len(set(parts([q for q in pairs if x not in q], ids - {x}).values())) > whole]
    assert [r[0] for r in table_rows(B.cut_vertices(e))] == sorted(cuts, key=lambda x: repr((x,)))
    blocks = {}
    for u, v, b in B.biconnected_components(e).collect():
        blocks.setdefault(b, []).append((u, v))
    assert sum(map(len, blocks.values())) == len(pairs)
    # Two edges are in one block if no single vertex parts them.
    for own in blocks.values():
        for x in {y for p in own for y in p}:
            assert len(set(parts([p for p in own if x not in p], {y for p in own for y in p} - {x}).values())) <= 1
    assert {p for own in blocks.values() if len(own) == 1 for p in own} == set(want)


def test_contraction_takes_the_smallest_witness(spark, table_rows):
    frag = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "id bigint, rep bigint")
    assert table_rows(K.super_edges(graph(spark, [(2, 5), (1, 6), (1, 2)]), frag)) == [(1, 5, 1, 6)]


def test_batches(spark):
    pairs = random_graph(6, 40, 90)
    e = graph(spark, pairs)
    f = T.bfs_forest(e).select("id", "parent")
    b = G.mixed_batch(e, f, 20, 8)
    assert E.classify(b, f).where("is_tree").count() == 8 and b.count() == 20
    assert G.tree_edge_batch(e, f, 1000).count() <= f.count() // 1
    assert G.bridge_batch(e, 10).count() <= 10
    assert G.drawn(e, 7, 1).collect() == G.drawn(e, 7, 1).collect()


def test_hot_keys_take_the_broadcast_path(spark, table_rows, monkeypatch):
    monkeypatch.setattr(scale, "CALM_ROWS", 5)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(scale, "HOT_PARTS", 3)
    left = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 99), (3, 98)], "k bigint, x bigint")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k bigint, y string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert table_rows(scale.hot_join(left, right, "k", how)) == table_rows(left.join(right, "k", how))
    assert table_rows(joins.lookup_join(left, right, "k", "left", rows=1)) == table_rows(left.join(right, "k", "left"))


def test_prefix_sums_of_a_hot_group(spark, table_rows):
    from sparkforest.plans.prefix import ranked

    df = spark.range(1000).selectExpr("id", "if(id % 10 = 0, id % 3, 7) g")
    assert table_rows(ranked(df, ["g"], ["id"], "k", False)) == table_rows(ranked(df, ["g"], ["id"], "k", True))


def test_adjacency_is_cut_into_chunks(spark, table_rows):
    star = graph(spark, [(0, i) for i in range(1, 11)])
    a = E.adjacency(star, 4)
    assert a.where("src = 0").count() == 3 and a.selectExpr("max(size(neighbours))").first()[0] == 4
    assert table_rows(E.csr_to_edges(a)) == table_rows(star)


def test_bridge_queries_run_over_all_of_graph_edges(spark, table_rows, tmp_path):
    from sparkforest.queries_graph import GRAPH_BITS, QUERIES

    pairs = random_graph(3, n=25, m=28)
    spark.createDataFrame([("b",), ("a",)], "graph_name string").write.parquet(str(tmp_path / "graphs.parquet"))
    rows = [(g, u, v) for g in "ab" for u, v in pairs]
    spark.createDataFrame(rows, "graph_name string, node1 bigint, node2 bigint").selectExpr("*", "timestamp'2024-01-01' as dumped_at", "timestamp'2024-01-01' as loaded_at").write.parquet(str(tmp_path / "graph_edges.parquet"))
    real = [(u + (g << GRAPH_BITS), v + (g << GRAPH_BITS)) for g in (1, 2) for u, v in pairs]
    vertices = {x for e in real for x in e}
    count = lambda es, ids: len(set(parts(es, ids).values()))
    whole = count(real, vertices)
    bridges = sorted((e for e in real if count([x for x in real if x != e], vertices) > whole), key=repr)
    assert bridges and table_rows(QUERIES["h6_bridges_net"](spark, str(tmp_path))) == bridges
    cuts = {c for c in vertices if count([e for e in real if c not in e], vertices - {c}) > whole}
    assert {r[0] for r in QUERIES["h6_cut_vertices"](spark, str(tmp_path)).collect()} == cuts
    blocks = {(r[0], r[1]): r[2] for r in QUERIES["h6_biconnected_components"](spark, str(tmp_path)).collect()}
    assert set(blocks) == set(real) and sum(list(blocks.values()).count(blocks[e]) == 1 for e in real) == len(bridges)
