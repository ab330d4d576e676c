"""Registered queries of the graph operators and the SQL that checks them.

Four graphs come out of the test tables: ``chain`` joins the customers of successive orders of a day, ``urgent`` those of
successive urgent orders (sparse, with many components and bridges), ``net`` is graph_edges with every vertex told apart
by its graph, ``bip`` joins parts and suppliers of lineitem. The batch deleted from chain holds the pairs in which the
first order is urgent, that from urgent those in which it is finished, that from net the edges with a row loaded late.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkforest.operators import bridges as bridge_ops
from sparkforest.operators import components, contract, euler, generate, logs, traverse, trees
from sparkforest.operators import edges as E
from sparkforest.operators import reroot as reroot_ops
from sparkforest.plans.context import cut, ensure_checkpoint_dir, table
from sparkforest.plans.scale import is_small, rounds_only
from sparkforest.sources import declared_size, read_batch, read_graph, write_batch, write_egr, write_graph, write_records
from sparkforest.state import ForestState, repair_details, repair_report
from sparkforest.streaming.batches import OPERATIONS, ForestStore, run_stream

GRAPH_BITS = 40


def _chain_pairs(spark: SparkSession, d: str) -> DataFrame:
    day = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("u"), F.lead("o_custkey").over(day).alias("v"), F.col("o_orderpriority").startswith("1").alias("urgent"))


def chain(spark: SparkSession, d: str) -> DataFrame:
    return cut(E.canonical(_chain_pairs(spark, d)))


def chain_batch(spark: SparkSession, d: str) -> DataFrame:
    return cut(E.canonical(_chain_pairs(spark, d).where("urgent")))


def _urgent_pairs(spark: SparkSession, d: str) -> DataFrame:
    day = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    return table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("u"), F.lead("o_custkey").over(day).alias("v"), (F.col("o_orderstatus") == "F").alias("finished"))


def urgent(spark: SparkSession, d: str) -> DataFrame:
    return cut(E.canonical(_urgent_pairs(spark, d)))


def urgent_batch(spark: SparkSession, d: str) -> DataFrame:
    return cut(E.canonical(_urgent_pairs(spark, d).where("finished")))


def _net_pairs(spark: SparkSession, d: str) -> DataFrame:
    code = table(spark, d, "graphs").select("graph_name", F.row_number().over(Window.orderBy("graph_name")).cast("bigint").alias("g"))
    rows = table(spark, d, "graph_edges").join(F.broadcast(code), "graph_name")  # 14 graphs, fixed
    at = lambda c: F.shiftleft("g", GRAPH_BITS) + F.col(c)
    return rows.select(at("node1").alias("u"), at("node2").alias("v"), (F.col("loaded_at") > F.col("dumped_at") + F.expr("interval 1 day")).alias("late"))


def net(spark: SparkSession, d: str) -> DataFrame:
    return cut(E.canonical(_net_pairs(spark, d)))


def net_batch(spark: SparkSession, d: str) -> DataFrame:
    return cut(E.canonical(_net_pairs(spark, d).where("late")))


def bip(spark: SparkSession, d: str) -> DataFrame:
    return cut(E.canonical(table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v"))))


def _forest(edges: DataFrame) -> DataFrame:
    return cut(traverse.bfs_forest(edges).select("id", "parent"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sparkforest-{name}-{uuid.uuid4().hex}"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


_CHAIN = "pairs as (select o_custkey a, lead(o_custkey) over (partition by o_orderdate order by o_orderkey) b, o_orderpriority p from orders), edges as materialized (select distinct least(a, b) u, greatest(a, b) v from pairs where a <> b), batch as materialized (select distinct least(a, b) u, greatest(a, b) v from pairs where a <> b and p like '1%')"
_URGENT = "pairs as (select o_custkey a, lead(o_custkey) over (partition by o_orderdate order by o_orderkey) b, o_orderstatus s from orders where o_orderpriority like '1%'), edges as materialized (select distinct least(a, b) u, greatest(a, b) v from pairs where a <> b), batch as materialized (select distinct least(a, b) u, greatest(a, b) v from pairs where a <> b and s = 'F')"
_NET = "code as (select graph_name, row_number() over (order by graph_name) g from graphs), pairs as (select g * 1099511627776 + node1 a, g * 1099511627776 + node2 b, loaded_at > dumped_at + interval 1 day late from graph_edges join code using (graph_name)), edges as materialized (select distinct least(a, b) u, greatest(a, b) v from pairs where a <> b), batch as materialized (select distinct least(a, b) u, greatest(a, b) v from pairs where a <> b and late)"
_BIP = "edges as materialized (select distinct least(l_partkey * 2, l_suppkey * 2 + 1) u, greatest(l_partkey * 2, l_suppkey * 2 + 1) v from lineitem)"
_SYM = "sym as materialized (select u, v from edges union all select v, u from edges), vert as (select distinct u id from sym)"
_CC = "cc(id, rep) using key (id) as (select id, id from vert union (select s.v, min(r.rep) from cc r join sym s on s.u = r.id join recurring.cc q on q.id = s.v where r.rep < q.rep group by s.v))"
_BFS = """bf(id, d) using key (id) as (select distinct rep, 0 from cc union (select s.v, min(b.d) + 1 from bf b join sym s on s.u = b.id where not exists (select 1 from recurring.bf q where q.id = s.v) group by s.v)),
  par as materialized (select x.id, coalesce(min(s.u) filter (where y.d = x.d - 1), x.id) p from bf x join sym s on s.v = x.id join bf y on y.id = s.u group by x.id)"""
_CUT = """cut as materialized (select p.id, case when b.u is null then p.p else p.id end p from par p left join batch b on b.u = least(p.id, p.p) and b.v = greatest(p.id, p.p)),
  up(id, anc) as (select id, p from cut union select f.id, c.p from up f join cut c on c.id = f.anc),
  frag as materialized (select f.id, f.anc rep from up f join cut c on c.id = f.anc and c.p = c.id),
  cand as (select e.* from edges e anti join batch b on e.u = b.u and e.v = b.v anti join (select least(id, p) u, greatest(id, p) v from cut where id <> p) t on e.u = t.u and e.v = t.v)"""
_SUPER = """o as (select case when a.rep < b.rep then a.rep else b.rep end a, case when a.rep < b.rep then b.rep else a.rep end b, case when a.rep < b.rep then u else v end wa, case when a.rep < b.rep then v else u end wb from cand e join frag a on a.id = e.u join frag b on b.id = e.v where a.rep <> b.rep),
  se as materialized (select a, b, wa, wb from (select *, row_number() over (partition by a, b order by wa, wb) k from o) where k = 1),
  ssym as materialized (select a u, b v from se union all select b, a from se),
  sc(id, rep) using key (id) as (select distinct u, u from ssym union (select s.v, min(r.rep) from sc r join ssym s on s.u = r.id join recurring.sc q on q.id = s.v where r.rep < q.rep group by s.v)),
  sb(id, d) using key (id) as (select distinct rep, 0 from sc union (select s.v, min(b.d) + 1 from sb b join ssym s on s.u = b.id where not exists (select 1 from recurring.sb q where q.id = s.v) group by s.v)),
  sp as (select x.id, coalesce(min(s.u) filter (where y.d = x.d - 1), x.id) p from sb x join ssym s on s.v = x.id join sb y on y.id = s.u group by x.id),
  repl as materialized (select sp.id frag, case when sp.id < sp.p then wa else wb end u, case when sp.id < sp.p then wb else wa end v from sp join se on se.a = least(sp.id, sp.p) and se.b = greatest(sp.id, sp.p) where sp.id <> sp.p),
  path(frag, x) as (select frag, u from repl union select p.frag, c.p from path p join cut c on c.id = p.x),
  upd as (select c.p id, c.id np, 1 pr from path p join cut c on c.id = p.x where c.p <> c.id union all select u, v, 2 from repl),
  fin as (select id, np from (select *, row_number() over (partition by id order by pr desc) k from upd) where k = 1),
  repaired as (select c.id, coalesce(f.np, c.p) parent from cut c left join fin f on f.id = c.id)"""
_BELOW = "anc(id, a, k) as (select id, id, 0 from par union all select x.id, p.p, x.k + 1 from anc x join par p on p.id = x.a where p.p <> p.id), below as materialized (select a, id, k from anc)"
_DEPTH = "depth as (select id, max(k) depth, max_by(a, k) root from anc group by id), size as (select a id, count(*) size from below group by a)"
_PRE = """sib as (select p.id, p.p, coalesce(sum(s.size) over (partition by p.p order by p.id rows between unbounded preceding and 1 preceding), 0) + 1 step from par p join size s on s.id = p.id where p.id <> p.p),
  pre as (select a.id, coalesce(sum(s.step), 0)::bigint pre from anc a left join sib s on s.id = a.a group by a.id),
  pos as materialized (select p.id, q.p parent, d.root, p.pre, s.size, d.depth from pre p join par q on q.id = p.id join depth d on d.id = p.id join size s on s.id = p.id)"""


def _sql(tail: str, *parts: str) -> str:
    return "with recursive " + ", ".join(parts) + " " + tail


# A. sources and sinks


@_query(_sql("select u, v from edges", _CHAIN))
def a1_text_graph(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "graph") + ".txt"
    write_graph(chain(spark, d), at)
    return read_graph(spark, at)


@_query(_sql("select u, v from edges", _CHAIN))
def a2_binary_graph(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "graph") + ".egr"
    write_egr(chain(spark, d), at)
    return read_graph(spark, at)


@_query(_sql("select u, v from edges", _NET))
def a3_csr_to_edges(spark: SparkSession, d: str) -> DataFrame:
    return E.csr_to_edges(E.adjacency(net(spark, d)))


@_query(_sql("select id, count(*) degree, coalesce(sum(count(*)) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint first from (select u id from sym) group by id", _NET, _SYM))
def a4_csr_offsets(spark: SparkSession, d: str) -> DataFrame:
    return E.csr_offsets(net(spark, d))


@_query(_sql("select b.u, b.v, t.u is not null is_tree from batch b left join (select least(id, p) u, greatest(id, p) v from par where id <> p) t on t.u = b.u and t.v = b.v", _NET, _SYM, _CC, _BFS))
def a6_classify_batch(spark: SparkSession, d: str) -> DataFrame:
    return E.classify(net_batch(spark, d), _forest(net(spark, d)))


@_query(_sql("select u, v, (select count(*) from batch) declared from batch", _CHAIN))
def a10_batch_file(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "batch")
    write_batch(chain_batch(spark, d), at)
    return read_batch(spark, at).withColumn("declared", F.lit(declared_size(spark, at)[0]))


_AVG = "select filename, batch_size, min(num_vertices) numVertices, min(num_edges) numEdges, round(avg(tree_edges_count), 2) tree_edges_count, round(avg(total_time) filter (not isnan(total_time)), 2) total_time from output_data group by all"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "output_data").select("row_id", "filename", F.col("num_vertices").alias("numVertices"), F.col("num_edges").alias("numEdges"), F.col("batch_size").cast("bigint").alias("batch_size"), "tree_edges_count", "total_time")


@_query("select filename, batch_size::bigint batch_size, tree_edges_count, count(*) n from output_data group by all")
def a13_csv_records(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "csv")
    write_records(_records(spark, d), at)
    back = logs.merge_csv(spark, at, "row_id bigint, filename string, numVertices bigint, numEdges bigint, batch_size bigint, tree_edges_count bigint, total_time double")
    return back.groupBy("filename", "batch_size", "tree_edges_count").agg(F.count("*").alias("n"))


# B. edge lists


@_query(_sql("select u * 4294967296 + v as key, u, v from edges", _CHAIN))
def b1_pack_unpack(spark: SparkSession, d: str) -> DataFrame:
    keys = E.pack(chain(spark, d))
    return E.unpack(keys).join(keys, F.shiftleft("u", E.PACK_BITS).bitwiseOR(F.col("v")) == F.col("key")).select("key", "u", "v")


@_query(_sql("select u, v from edges", _BIP))
def b2_sorted_edges(spark: SparkSession, d: str) -> DataFrame:
    return E.sorted_edges(bip(spark, d))


@_query(_sql("select b.u, b.v from batch b semi join edges e on b.u = e.u and b.v = e.v", _NET))
def b3_present(spark: SparkSession, d: str) -> DataFrame:
    return E.present(net_batch(spark, d), net(spark, d))


@_query(_sql("select id, p parent from cut", _NET, _SYM, _CC, _BFS, _CUT))
def b4_cut_forest(spark: SparkSession, d: str) -> DataFrame:
    return E.cut_forest(_forest(net(spark, d)), net_batch(spark, d))


@_query(_sql("select u, v from cand", _CHAIN, _SYM, _CC, _BFS, _CUT))
def b7_candidates(spark: SparkSession, d: str) -> DataFrame:
    e, b = chain(spark, d), chain_batch(spark, d)
    return E.candidates(e, b, E.cut_forest(_forest(e), b))


@_query("select edge_id, graph_name from graph_edges where node1 < node2")
def b6_select_flagged(spark: SparkSession, d: str) -> DataFrame:
    return E.select_flagged(table(spark, d, "graph_edges").select("edge_id", "graph_name", (F.col("node1") < F.col("node2")).alias("keep")), "keep")


@_query(_sql("select e.u, e.v from edges e anti join batch b on e.u = b.u and e.v = b.v", _NET))
def b8_delete_edges(spark: SparkSession, d: str) -> DataFrame:
    return E.delete_edges(net(spark, d), net_batch(spark, d))


@_query(_sql("select u, v from edges", _NET))
def b9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return E.canonical(_net_pairs(spark, d))


@_query(_sql("select u src, v dst from sym", _BIP, _SYM))
def b10_symmetrise(spark: SparkSession, d: str) -> DataFrame:
    return E.symmetrise(bip(spark, d))


@_query(_sql("select (select count(*) from edges where u = (select min(u) from edges) and v = (select min(v) from edges where u = (select min(u) from edges))) > 0 found", _CHAIN))
def b13_has_edge(spark: SparkSession, d: str) -> DataFrame:
    e = chain(spark, d)
    first = e.agg(F.min(F.struct("u", "v")).alias("e")).first()["e"]
    return E.has_edge(e, first["v"], first["u"])


@_query(_sql("select u src, v dst from sym", _NET, _SYM))
def b11_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours in arrays, taken apart again."""
    return E.adjacency(net(spark, d)).select("src", F.explode("neighbours").alias("dst"))


@_query(_sql("select u, v from edges", _CHAIN))
def b12_split_packed(spark: SparkSession, d: str) -> DataFrame:
    return E.unpack(E.pack(chain(spark, d)))


# C. traversal


@_query(_sql("select b.id, p.p parent, b.d::bigint level from bf b join par p on p.id = b.id", _NET, _SYM, _CC, _BFS))
def c1_bfs_forest(spark: SparkSession, d: str) -> DataFrame:
    return traverse.bfs_forest(net(spark, d))


@_query(_sql("select count(*) n_vertices, count(distinct rep) n_trees, 0::bigint foreign_edges, 0::bigint split_edges, true valid from cc", _CHAIN, _SYM, _CC))
def c2_dfs_valid(spark: SparkSession, d: str) -> DataFrame:
    e = chain(spark, d)
    return trees.validate_forest(cut(traverse.dfs_forest(e)), e)


_LEVELS = "src as (select min(id) s from vert), lv(id, d) using key (id) as (select s, 0 from src union (select s.v, min(b.d) + 1 from lv b join sym s on s.u = b.id where not exists (select 1 from recurring.lv q where q.id = s.v) group by s.v)), lp as (select x.id, coalesce(min(s.u) filter (where y.d = x.d - 1), x.id) p, any_value(x.d) d from lv x join sym s on s.v = x.id join lv y on y.id = s.u group by x.id)"


@_query(_sql("select v.id, coalesce(l.p, v.id) parent, coalesce(l.d, -1)::bigint level from vert v left join lp l on l.id = v.id", _NET, _SYM, _LEVELS))
def c4_bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    e = net(spark, d)
    return traverse.bfs_levels(e, None, e.agg(F.min("u")).first()[0])


@_query(_sql("select id, rep from cc", _NET, _SYM, _CC))
def c6_components(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_components(net(spark, d))


@_query(_sql("select rep, count(*) size from cc group by rep", _BIP, _SYM, _CC))
def c6_component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return components.component_sizes(components.connected_components(bip(spark, d)))


@_query(_sql("select count(*) n_vertices, count(distinct rep) n_trees, 0::bigint foreign_edges, 0::bigint split_edges, true valid from cc", _URGENT, _SYM, _CC))
def c7_grafted_forest_valid(spark: SparkSession, d: str) -> DataFrame:
    e = urgent(spark, d)
    return trees.validate_forest(traverse.spanning_forest(e), e)


@_query(_sql("select id, a ancestor, k::bigint distance from anc where k in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096)", _URGENT, _SYM, _CC, _BFS, _BELOW))
def c10_recorded_jumps(spark: SparkSession, d: str) -> DataFrame:
    return reroot_ops.recorded_jumps(_forest(urgent(spark, d)))


@_query(_sql("select distinct x id from path", _URGENT, _SYM, _CC, _BFS, _CUT, _SUPER))
def c11_marked_paths(spark: SparkSession, d: str) -> DataFrame:
    """The vertices from every replacement's end up to its fragment's root, marked by recorded jumps."""
    r = ForestState.from_edges(urgent(spark, d)).delete(urgent_batch(spark, d)).last()
    return reroot_ops.path_by_lifting(r.cut, r.repl, is_small(r.cut)).select("id")


# D. trees


@_query(_sql("select distinct rep id from cc", _NET, _SYM, _CC))
def d3_roots(spark: SparkSession, d: str) -> DataFrame:
    return trees.find_roots(_forest(net(spark, d)))


@_query(_sql("select count(distinct rep) n_roots, count(distinct rep) = 1 is_tree, case when count(distinct rep) = 1 then min(rep) end root from cc", _CHAIN, _SYM, _CC))
def d4_tree_or_forest(spark: SparkSession, d: str) -> DataFrame:
    return trees.tree_or_forest(_forest(chain(spark, d)))


@_query(_sql("select rep, row_number() over (order by rep) - 1 as k from (select distinct rep from cc)", _NET, _SYM, _CC))
def d5_renumber(spark: SparkSession, d: str) -> DataFrame:
    return trees.renumber(cut(components.connected_components(net(spark, d))))


@_query(_sql("select count(*) n_vertices, count(distinct rep) n_components, count(distinct rep) n_roots from cc", _NET, _SYM, _CC))
def d7_label_counts(spark: SparkSession, d: str) -> DataFrame:
    e = net(spark, d)
    return trees.label_counts(_forest(e), components.connected_components(e))


@_query(_sql("select id, root, depth::bigint depth from depth", _NET, _SYM, _CC, _BFS, _BELOW, _DEPTH))
def d8_depths(spark: SparkSession, d: str) -> DataFrame:
    return trees.depths(_forest(net(spark, d)))


@_query(_sql("select count(*) n_vertices, count(distinct rep) n_trees, 0::bigint foreign_edges, 0::bigint split_edges, true valid from cc", _NET, _SYM, _CC))
def d9_validate(spark: SparkSession, d: str) -> DataFrame:
    e = net(spark, d)
    return trees.validate_forest(_forest(e), e)


@_query(_sql("select id, max(k)::bigint rank from anc group by id", _CHAIN, _SYM, _CC, _BFS, _BELOW))
def d10_list_ranking(spark: SparkSession, d: str) -> DataFrame:
    return trees.jump(_forest(chain(spark, d))).select("id", F.col("total").alias("rank"))


@_query(_sql("select min(depth)::bigint min_depth, max(depth)::bigint max_depth, avg(depth) mean_depth, floor((select avg(depth) from (select distinct depth from depth)))::bigint whole_mean_of_distinct_depths, floor(quantile_cont(depth, 0.5))::bigint whole_median_depth from depth", _NET, _SYM, _CC, _BFS, _BELOW, _DEPTH))
def d11_path_statistics(spark: SparkSession, d: str) -> DataFrame:
    return trees.path_statistics(trees.depths(_forest(net(spark, d))))


@_query(_sql("select u, v, a.rep ru, b.rep rv from cand e join frag a on a.id = e.u join frag b on b.id = e.v where a.rep <> b.rep", _URGENT, _SYM, _CC, _BFS, _CUT))
def d12_cross_edges(spark: SparkSession, d: str) -> DataFrame:
    e, b = urgent(spark, d), urgent_batch(spark, d)
    f = cut(E.cut_forest(_forest(e), b))
    return trees.cross_edges(E.candidates(e, b, f), cut(contract.fragments(f)))


@_query(_sql("select (select count(*) from batch) batch_edges, (select count(*) from par p join batch b on b.u = least(p.id, p.p) and b.v = greatest(p.id, p.p)) tree_edges, (select count(*) from cut where id = p) fragments, (select count(*) from se) fragment_pairs, (select count(*) from repl) replacements, (select count(*) from par where id = p) trees_before, (select count(*) from repaired where id = parent) trees_after", _CHAIN, _SYM, _CC, _BFS, _CUT, _SUPER))
def d13_repair_report(spark: SparkSession, d: str) -> DataFrame:
    before, b = ForestState.from_edges(chain(spark, d)), chain_batch(spark, d)
    return repair_report(before, before.delete(b), b)


@_query(_sql("select count(*) n_vertices, (sum(k) / 2)::bigint n_edges, sum(k) / (count(*) * (count(*) - 1) / 2) density, min(k) min_degree, avg(k) mean_degree, quantile_cont(k, 0.5) median_degree, max(k) max_degree, var_samp(k) degree_variance from (select u, count(*) k from sym group by u)", _NET, _SYM))
def d14_graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    return trees.graph_statistics(net(spark, d))


@_query(_sql("select (select count(*) from edges e anti join batch b using (u, v)) = 0 equal, (select count(*) from edges e anti join batch b using (u, v)) only_left, (select count(*) from batch b anti join edges e using (u, v)) only_right", _CHAIN))
def d15_same_rows(spark: SparkSession, d: str) -> DataFrame:
    return E.same_rows(chain(spark, d), chain_batch(spark, d))


# E. repair


def _supers(spark: SparkSession, d: str) -> DataFrame:
    e, b = urgent(spark, d), urgent_batch(spark, d)
    f = cut(E.cut_forest(_forest(e), b))
    return cut(contract.super_edges(E.candidates(e, b, f), cut(contract.fragments(f))))


@_query(_sql("select a, b, wa, wb from se", _URGENT, _SYM, _CC, _BFS, _CUT, _SUPER))
def e3_super_edges(spark: SparkSession, d: str) -> DataFrame:
    return _supers(spark, d)


@_query(_sql("select id, p parent from sp", _URGENT, _SYM, _CC, _BFS, _CUT, _SUPER))
def e2_super_forest(spark: SparkSession, d: str) -> DataFrame:
    return contract.super_forest(_supers(spark, d), "sg")


@_query(_sql("select id, p parent from sp", _URGENT, _SYM, _CC, _BFS, _CUT, _SUPER))
def e7_super_forest_by_hooking(spark: SparkSession, d: str) -> DataFrame:
    return contract.super_forest(_supers(spark, d), "hs")


@_query(_sql("select frag, u, v from repl", _URGENT, _SYM, _CC, _BFS, _CUT, _SUPER))
def e5_replacements(spark: SparkSession, d: str) -> DataFrame:
    s = _supers(spark, d)
    return contract.replacements(contract.super_forest(s), s)


_REPAIRED = _sql("select id, parent from repaired", _CHAIN, _SYM, _CC, _BFS, _CUT, _SUPER)


@_query(_REPAIRED)
def e1_delete_repair(spark: SparkSession, d: str) -> DataFrame:
    return ForestState.from_edges(chain(spark, d)).delete(chain_batch(spark, d)).forest


@_query(_REPAIRED)
def g5_delete_repair_by_lifting(spark: SparkSession, d: str) -> DataFrame:
    return ForestState.from_edges(chain(spark, d), strategy="hs", method="lifting", in_task=False).delete(chain_batch(spark, d)).forest


@_query(_sql("select id, parent from repaired", _URGENT, _SYM, _CC, _BFS, _CUT, _SUPER))
def e1_delete_repair_urgent(spark: SparkSession, d: str) -> DataFrame:
    return ForestState.from_edges(urgent(spark, d), in_task=False).delete(urgent_batch(spark, d)).forest


@_query(_sql("select id, parent from repaired", _NET, _SYM, _CC, _BFS, _CUT, _SUPER))
def e1_delete_repair_net(spark: SparkSession, d: str) -> DataFrame:
    return ForestState.from_edges(net(spark, d)).delete(net_batch(spark, d)).forest


@_query(_sql("select (select count(*) from cut where id = p) - (select count(*) from repl) trees_deleted, (select count(distinct rep) from cc) trees_inserted, (select count(*) from edges) n_edges, true valid", _URGENT, _SYM, _CC, _BFS, _CUT, _SUPER))
def e1_delete_then_insert(spark: SparkSession, d: str) -> DataFrame:
    b = urgent_batch(spark, d)
    gone = ForestState.from_edges(urgent(spark, d)).delete(b)
    back = gone.insert(b)
    valid = trees.validate_forest(back.forest, back.edges).select("valid", F.col("n_trees").alias("trees_inserted"))
    return trees.side_by_side(gone.components().withColumnRenamed("n_trees", "trees_deleted"), valid, back.edges.agg(F.count("*").alias("n_edges")))


@_query(_sql("select a.rep a, b.rep b from cand e join frag a on a.id = e.u join frag b on b.id = e.v where a.rep < b.rep union select b.rep, a.rep from cand e join frag a on a.id = e.u join frag b on b.id = e.v where a.rep > b.rep", _URGENT, _SYM, _CC, _BFS, _CUT))
def e12_fragment_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _supers(spark, d).select("a", "b")


@_query(_sql("select count(*) n_components from (select distinct rep from sc)", _URGENT, _SYM, _CC, _BFS, _CUT, _SUPER))
def e15_hooking_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the fragments' graph by rounds of hooking and shortcutting."""
    pairs = _supers(spark, d).select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = components.connected_components(pairs, small=False)
    return labels.select("rep").distinct().agg(F.count("*").alias("n_components"))


_VALID_SUPERS = _sql("select (select count(distinct u) from ssym) n_vertices, (select count(distinct rep) from sc) n_trees, 0::bigint foreign_edges, 0::bigint split_edges, true valid", _URGENT, _SYM, _CC, _BFS, _CUT, _SUPER)


def _valid_supers(spark: SparkSession, d: str, method: str) -> DataFrame:
    s = _supers(spark, d)
    return trees.validate_forest(cut(contract.super_forest(s, method)), s.select(F.col("a").alias("u"), F.col("b").alias("v")))


@_query(_VALID_SUPERS)
def e2_grafted_super_forest(spark: SparkSession, d: str) -> DataFrame:
    """The fragments' forest grown by grafting and path reversal."""
    return _valid_supers(spark, d, "graft")


@_query(_VALID_SUPERS)
def e14_hooked_super_forest(spark: SparkSession, d: str) -> DataFrame:
    """The fragments' forest out of the edges along which components hook, oriented by a tour."""
    return _valid_supers(spark, d, "hook")


@_query(_sql("select u, v from o2 where not exists (select 1 from reach r where r.eu = o2.u and r.ev = o2.v and r.x = o2.v)", _URGENT, _SYM, _CC, _BFS, _CUT, _SUPER, "o2 as materialized (select a u, b v from se), reach(eu, ev, x) as (select u, v, u from o2 union select r.eu, r.ev, s.v from reach r join ssym s on s.u = r.x where (least(s.u, s.v), greatest(s.u, s.v)) < (r.eu, r.ev))"))
def e9_hooking_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges along which the components of the fragments' graph hook: those whose ends no earlier edges join."""
    return components.hooked_forest(_supers(spark, d).select(F.col("a").alias("u"), F.col("b").alias("v")))


@_query(_sql("select id, p parent from par", _NET, _SYM, _CC, _BFS))
def e16_orient_by_tour(spark: SparkSession, d: str) -> DataFrame:
    """A forest's edges, their directions forgotten, rooted again where they were."""
    f = _forest(net(spark, d))
    return euler.orient(E.tree_edges(f).select("u", "v"), f.select("id"), trees.find_roots(f))


# F. Euler tours


@_query(_sql("select p.id src, q.v dst, coalesce(min(s.v) filter (where s.v > p.id), min(s.v)) next_dst from tree q join (select distinct u id from tree) p on p.id = q.u join tree s on s.u = q.v group by p.id, q.v", _CHAIN, _SYM, _CC, _BFS, "tree as materialized (select id u, p v from par where id <> p union all select p, id from par where id <> p)"))
def f8_successors(spark: SparkSession, d: str) -> DataFrame:
    """Every arc of the tours beside the vertex to which the arc after it leads."""
    t = cut(euler.tour_successors(E.tree_edges(_forest(chain(spark, d))).select("u", "v")))
    return t.join(t.select(F.col("arc").alias("next"), F.col("dst").alias("next_dst")), "next").select("src", "dst", "next_dst")


@_query(_sql('select root, 2 * pre - depth as "position", id, depth::bigint "level" from pos union all select root, 2 * (pre + size - 1) - depth + 1, parent, depth::bigint - 1 from pos where id <> root', _CHAIN, _SYM, _CC, _BFS, _BELOW, _DEPTH, _PRE))
def f14_modified_tour(spark: SparkSession, d: str) -> DataFrame:
    return euler.modified_tour(_forest(chain(spark, d)))


@_query(_sql("select p parent, id, row_number() over (partition by p order by id) - 1 as k, count(*) over (partition by p) children from par where id <> p", _NET, _SYM, _CC, _BFS))
def f4_child_numbers(spark: SparkSession, d: str) -> DataFrame:
    return euler.child_numbers(_forest(net(spark, d)))


@_query(_sql("select id, parent, root, pre, size, depth::bigint depth from pos", _URGENT, _SYM, _CC, _BFS, _BELOW, _DEPTH, _PRE))
def f12_preorder(spark: SparkSession, d: str) -> DataFrame:
    return euler.preorder(_forest(urgent(spark, d)))


@_query(_sql('select id, root, 2 * pre - depth as "first", case when id = root and size = 1 then 1 else 2 * (pre + size - 1) - depth end as "last" from pos', _NET, _SYM, _CC, _BFS, _BELOW, _DEPTH, _PRE))
def f12_intervals(spark: SparkSession, d: str) -> DataFrame:
    return euler.intervals(_forest(net(spark, d)))


@_query(_sql('select root, 2 * pre - depth - 1 as "rank", parent src, id dst from pos where id <> root union all select root, 2 * (pre + size - 1) - depth, id, parent from pos where id <> root', _CHAIN, _SYM, _CC, _BFS, _BELOW, _DEPTH, _PRE))
def f_tour_arcs(spark: SparkSession, d: str) -> DataFrame:
    return euler.tour_arcs(_forest(chain(spark, d)))


@_query(_sql("select distinct x id from path", _URGENT, _SYM, _CC, _BFS, _CUT, _SUPER))
def g2_paths_by_intervals(spark: SparkSession, d: str) -> DataFrame:
    r = ForestState.from_edges(urgent(spark, d)).delete(urgent_batch(spark, d)).last()
    return reroot_ops.path_by_intervals(r.cut, r.repl, is_small(r.cut)).select("id")


@_query(_sql("select u id, v parent from repl", _URGENT, _SYM, _CC, _BFS, _CUT, _SUPER))
def g3_attached_ends(spark: SparkSession, d: str) -> DataFrame:
    """Where fragments were attached: each replacement's end under its new parent, read off the repaired forest."""
    after = ForestState.from_edges(urgent(spark, d)).delete(urgent_batch(spark, d))
    return after.forest.join(after.last().repl.select(F.col("u").alias("id")), "id", "left_semi").select("id", "parent")


# H. generators and tools


@_query(_sql("select least(p.id, p.p) u, greatest(p.id, p.p) v from par p join (select u id, count(*) k from sym group by u) g on g.id = p.id where p.id <> p.p and k > (select count(*) / (select count(*) from vert) from sym)", _CHAIN, _SYM, _CC, _BFS))
def h1_busy_tree_edges(spark: SparkSession, d: str) -> DataFrame:
    e = chain(spark, d)
    return generate.busy_tree_edges(e, _forest(e))


@_query(_sql("select e.u, e.v from edges e anti join (select least(id, p) u, greatest(id, p) v from par where id <> p) t on e.u = t.u and e.v = t.v", _URGENT, _SYM, _CC, _BFS))
def h2_non_tree_edges(spark: SparkSession, d: str) -> DataFrame:
    e = urgent(spark, d)
    return generate.non_tree_edges(e, _forest(e))


@_query(_sql("select u id, count(*) degree from sym group by u order by degree desc, id limit 1", _NET, _SYM))
def a9_busiest_vertex(spark: SparkSession, d: str) -> DataFrame:
    return trees.busiest_vertex(net(spark, d))


@_query(_sql("select (select count(*) from cand) candidates, (select count(*) from cand e join frag a on a.id = e.u join frag b on b.id = e.v where a.rep <> b.rep) cross_edges, min(n)::bigint min_path, max(n)::bigint max_path, avg(n) mean_path, quantile_cont(n, 0.5) median_path from (select frag, count(*) n from path group by frag)", _CHAIN, _SYM, _CC, _BFS, _CUT, _SUPER))
def d13_repair_details(spark: SparkSession, d: str) -> DataFrame:
    before, b = ForestState.from_edges(chain(spark, d)), chain_batch(spark, d)
    return repair_details(before, before.delete(b), b)


@_query(_sql("select total, from_tree, k as \"set\", least(from_tree, (select count(*) from par where id <> p))::bigint n_tree, least(total - from_tree, (select count(*) from edges) - (select count(*) from par where id <> p))::bigint n_other from (values (100, 5), (100, 10), (100, 50), (100, 100), (1000, 10), (1000, 100), (1000, 500), (1000, 1000)) g(total, from_tree), range(0, 2) r(k)", _CHAIN, _SYM, _CC, _BFS))
def h3_batch_sets(spark: SparkSession, d: str) -> DataFrame:
    """Two sets of the batches of up to a thousand edges: how many of each are of the forest, by looking them up there."""
    e = chain(spark, d)
    f = _forest(e)
    sizes = {n: generate.MIXED_SIZES[n] for n in (100, 1000)}
    b = cut(generate.batch_sets(e, f, sizes, 2))
    tree = E.tree_edges(f).select("u", "v", F.lit(True).alias("t"))
    kinds = E.present(b, e).join(tree, ["u", "v"], "left").groupBy("total", "from_tree", "set")
    return kinds.agg(F.count_if("t").alias("n_tree"), F.count_if(F.col("t").isNull()).alias("n_other"))


@_query(_sql("select 100::bigint n, 50::bigint from_tree, 100::bigint in_graph", _CHAIN))
def h3_mixed_batch(spark: SparkSession, d: str) -> DataFrame:
    e = chain(spark, d)
    f = _forest(e)
    b = cut(generate.mixed_batch(e, f, 100, 50))
    kinds = E.classify(b, f).agg(F.count("*").alias("n"), F.count_if("is_tree").alias("from_tree"))
    return trees.side_by_side(kinds, E.present(b, e).agg(F.count("*").alias("in_graph")))


@_query(_sql("select (select count(distinct rep) from cc) trees_after", _CHAIN, _SYM, _CC))
def h4_non_tree_batch_keeps_components(spark: SparkSession, d: str) -> DataFrame:
    e = chain(spark, d)
    after = ForestState.from_edges(e).delete(generate.non_tree_batch(e, 1000))
    return after.components().withColumnRenamed("n_trees", "trees_after")


@_query()
def h5_bridge_batch(spark: SparkSession, d: str) -> DataFrame:
    return generate.bridge_batch(net(spark, d), 1000)


_BRIDGES = "spans as (select e.u, e.v from edges e anti join (select least(id, p) u, greatest(id, p) v from par where id <> p) t on e.u = t.u and e.v = t.v), covered as (select a, count(*) n from (select x.a, s.u, s.v from spans s join below x on x.id = s.u union all select x.a, s.u, s.v from spans s join below x on x.id = s.v) group by a, u, v having count(*) = 1)"


@_query(_sql("select least(id, p) u, greatest(id, p) v from par where id <> p and id not in (select a from covered)", _URGENT, _SYM, _CC, _BFS, _BELOW, _BRIDGES))
def h6_bridges(spark: SparkSession, d: str) -> DataFrame:
    return bridge_ops.bridges(urgent(spark, d))


_LONE = "lone as (select least(id, p) u, greatest(id, p) v from par where id <> p and id not in (select a from covered))"


@_query(_sql("select least(60, (select count(*) from lone)) n_bridges, least(100 - least(60, (select count(*) from lone)), (select count(*) from spans)) n_other", _URGENT, _SYM, _CC, _BFS, _BELOW, _BRIDGES, _LONE))
def h5_bridges_in_batch(spark: SparkSession, d: str) -> DataFrame:
    """Of a batch of 100 edges how many are bridges and how many are not."""
    e = urgent(spark, d)
    b = cut(generate.bridge_batch(e, 100))
    lone = cut(bridge_ops.bridges(e))
    return trees.side_by_side(E.present(b, lone).agg(F.count("*").alias("n_bridges")), E.absent(b, lone).agg(F.count("*").alias("n_other")))


@_query(_sql("select distinct s.u id from sym s where not exists (select 1 from walk w where w.x = s.u and w.y = s.v)", _URGENT, _SYM, "walk(x, y) as (select u, min(v) from sym group by u union select w.x, s.v from walk w join sym s on s.u = w.y where s.v <> w.x)"))
def h6_cut_vertices_urgent(spark: SparkSession, d: str) -> DataFrame:
    return bridge_ops.cut_vertices(urgent(spark, d))


_ROOTED = "top as (select case when c.rep = t.rep then t.id else c.rep end r from (select distinct rep from cc) c, (select id, rep from cc where id = (select max(id) from vert)) t), rf(id, d) using key (id) as (select r, 0 from top union (select s.v, min(b.d) + 1 from rf b join sym s on s.u = b.id where not exists (select 1 from recurring.rf q where q.id = s.v) group by s.v)), rp as (select x.id, coalesce(min(s.u) filter (where y.d = x.d - 1), x.id) p, any_value(x.d) d from rf x join sym s on s.v = x.id join rf y on y.id = s.u group by x.id)"


@_query(_sql("select id, p parent, d::bigint level from rp", _URGENT, _SYM, _CC, _ROOTED))
def h7_bfs_from_given_root(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first trees, that of the largest vertex' component rooted at this vertex."""
    e = urgent(spark, d)
    return traverse.bfs_forest(e, root=e.agg(F.max("v")).first()[0])


@_query()
def h6_biconnected_components(spark: SparkSession, d: str) -> DataFrame:
    return bridge_ops.biconnected_components(net(spark, d))


@_query()
def h6_cut_vertices(spark: SparkSession, d: str) -> DataFrame:
    return bridge_ops.cut_vertices(net(spark, d))


@_query()
def h6_bridges_net(spark: SparkSession, d: str) -> DataFrame:
    return bridge_ops.bridges(net(spark, d))


@_query(_sql("select u, v from edges union all select lag(rep) over (order by rep), rep from (select distinct rep from cc) qualify lag(rep) over (order by rep) is not null", _NET, _SYM, _CC))
def h8_connect_components(spark: SparkSession, d: str) -> DataFrame:
    return components.connect_components(net(spark, d))


# I. logs


def _log(spark: SparkSession, d: str) -> DataFrame:
    """output_data written as run logs: a block of five lines per row, in one file per variant."""
    r = table(spark, d, "output_data").where("total_time is null or not isnan(total_time)")
    lines = F.array(
        F.concat(F.lit("filename: "), "filename"),
        F.concat(F.lit("Number of deleted tree edges: "), F.col("tree_edges_count").cast("string")),
        F.concat(F.lit("numVert: "), F.col("num_vertices").cast("string"), F.lit(", num_edges: "), F.col("num_edges").cast("string"), F.lit(" and delete batch size: "), F.col("batch_size").cast("string")),
        F.concat(F.lit("Time of PR-RST module : "), F.format_string("%.4f", "total_time"), F.lit(" ms")),
        F.concat(F.lit("Total execution time for Deletion: "), F.format_string("%.4f", "total_time"), F.lit(" ms")),
    )
    timed = F.when(F.col("total_time").isNull(), F.slice(lines, 1, 3)).otherwise(lines)
    return r.select(F.col("variant").alias("file"), "row_id", F.posexplode(timed).alias("k", "line")).select("file", F.struct("row_id", "k").alias("pos"), "line").where("line is not null")


@_query("select filename, tree_edges_count, case when batch_size is not null then num_vertices end \"numVertices\", case when batch_size is not null then num_edges end \"numEdges\", batch_size::bigint batch_size, round(total_time, 4) total_time from output_data where total_time is null or not isnan(total_time)")
def i1_parse_runs(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_runs(_log(spark, d)).drop("file", "block")


@_query('select filename, round(total_time, 4) as "PR-RST module" from output_data where total_time is null or not isnan(total_time)')
def i2_parse_phases(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_phases(_log(spark, d)).select("filename", "PR-RST module")


@_query("select regexp_replace(filename, '[.][^.]*$', '') filename, max(coalesce(num_edges, 0)) max_regular, min(num_vertices)::double min_my from output_data where filename is not null group by row_id, filename")
def i3_parse_tours(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "output_data").where("filename is not null")
    lines = F.array(
        F.concat(F.lit("filename: data/"), "filename"),
        F.concat(F.lit("Regular eulerian Tour finished in: "), F.col("num_edges").cast("string"), F.lit(" us")),
        F.concat(F.lit("My eulerian Tour finished in: "), F.col("num_vertices").cast("string"), F.lit(" us")),
    )
    log = r.select(F.col("variant").alias("file"), "row_id", F.posexplode(lines).alias("k", "line")).select("file", F.struct("row_id", "k").alias("pos"), "line").where("line is not null")
    return logs.parse_tours(log).drop("file", "block")


@_query("select filename, min(num_vertices) \"numVertices\", null::double \"numEdges\", batch_size::bigint batch_size, null::double tree_edges_count, max(total_time) filter (not isnan(total_time)) total_time from output_data group by filename, batch_size")
def i4_complete_columns(spark: SparkSession, d: str) -> DataFrame:
    good = F.when(~F.isnan("total_time"), F.col("total_time"))
    return logs.complete(_records(spark, d).groupBy("filename", "batch_size").agg(F.min("numVertices").alias("numVertices"), F.max(good).alias("total_time")))


@_query(_AVG)
def i5_averages(spark: SparkSession, d: str) -> DataFrame:
    return logs.averages(_records(spark, d).withColumn("batch_size", F.col("batch_size").cast("int")))


@_query("select row_id, num_vertices + num_edges as size_total from output_data")
def i6_derived_totals(spark: SparkSession, d: str) -> DataFrame:
    return logs.derived_totals(_records(spark, d), {"size_total": ("numVertices", "numEdges")}).select("row_id", "size_total")


# K. streaming


@_query(_sql("select (select count(*) from edges) n_edges, (select count(distinct rep) from cc) n_trees, 2 as n_batches", _CHAIN, _SYM, _CC))
def k_streamed_batches(spark: SparkSession, d: str) -> DataFrame:
    """The urgent pairs deleted, then inserted again, as a stream of two batches."""
    at = _folder(spark, "stream")
    store = ForestStore(spark, f"{at}/state")
    store.start(ForestState.from_edges(chain(spark, d)))
    b = chain_batch(spark, d)
    ops = b.select(F.lit(1).cast("bigint").alias("batch_id"), F.lit("delete").alias("op"), "u", "v").unionByName(E.present(b, chain(spark, d)).select(F.lit(2).cast("bigint").alias("batch_id"), F.lit("insert").alias("op"), "u", "v"))
    ops.write.parquet(f"{at}/ops")
    run_stream(spark.readStream.schema(OPERATIONS).parquet(f"{at}/ops"), store, f"{at}/progress").awaitTermination()
    end = store.latest()
    return trees.side_by_side(end.edges.agg(F.count("*").alias("n_edges")), end.components(), store.applied().agg(F.count("*").cast("int").alias("n_batches")))


# The same questions answered by the joins meant for graphs that fit no task.


def _in_rounds(query):
    def run(spark: SparkSession, d: str) -> DataFrame:
        with rounds_only():
            return query(spark, d)

    return run


IN_ROUNDS = ("c1_bfs_forest", "c4_bfs_levels", "c6_components", "c6_component_sizes", "d8_depths", "d10_list_ranking", "e1_delete_repair_net", "f12_intervals", "g5_delete_repair_by_lifting", "h6_bridges")
for _name in IN_ROUNDS:
    QUERIES[f"{_name}_rounds"] = _in_rounds(QUERIES[_name])
    ORACLE[f"{_name}_rounds"] = ORACLE[_name]
