"""Registered queries of the general data problems (P1, P3, P5) and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkforest.operators import drift, rejects, skew
from sparkforest.plans.context import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.layout_changes(table(spark, d, "run_files"), table(spark, d, "run_lines"))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "run_files"), table(spark, d, "run_lines"))


def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    return drift.long_form(table(spark, d, "run_lines"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_degrees(spark, d).where("heavy").select("graph_name", "node_id")


def p3_degrees(spark: SparkSession, d: str) -> DataFrame:
    return skew.vertex_degrees(table(spark, d, "graph_edges"), 0.01)


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_lines(table(spark, d, "raw_lines"), table(spark, d, "raw_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("reason is not null").select("line_id", "reason")


def p5_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    good = _parsed(spark, d).where("reason is null and target_table = 'graph_edges'")
    return good.select("line_id", "file_id", "node1", "node2", F.get("rest", F.lit(0)).alias("label"), F.get("rest", F.lit(1)).alias("stamp"))


def p5_edges_to_delete(spark: SparkSession, d: str) -> DataFrame:
    good = _parsed(spark, d).where("reason is null and target_table = 'edges_to_delete'")
    return good.select("line_id", "file_id", "node1", "node2", F.get("rest", F.lit(0)).alias("note"))


QUERIES = {f.__name__: f for f in (p1_found, p1_table, p1_cells, p3_found, p3_degrees, p5_found, p5_graph_edges, p5_edges_to_delete)}

_ENDS = """ends as (select graph_name, node1 node_id, node2 other from graph_edges where node1 is not null
  union all select graph_name, node2, node1 from graph_edges where node2 is not null and node1 is distinct from node2)"""
_LINES = r"""lined as (select l.line_id, l.file_id, f.target_table, f.delimiter, f.n_fields, f.num_vertices, regexp_replace(coalesce(l.raw_line, ''), '\r$', '') t
    from raw_lines l join raw_files f using (file_id)),
  shaped as (select *, case when delimiter = 'comma' then not regexp_full_match(t, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') else false end bad_quote,
    case when delimiter = 'comma' then regexp_extract_all(',' || t, ',("(?:[^"]|"")*"|[^",]*)', 1) when trim(t, e' \t') = '' then []::varchar[] else regexp_split_to_array(trim(t, e' \t'), '[ \t]+') end raw_fields from lined),
  fielded as (select *, list_transform(raw_fields, lambda x: case when x like '"%"' and len(x) > 1 then replace(x[2:-2], '""', '"') else x end) fields from shaped),
  judged as (select *, trim(fields[1], e' \t') a, trim(fields[2], e' \t') b from fielded),
  reasoned as (select *, case when bad_quote then 'quoting' when len(fields) <> n_fields then 'column_count'
    when not regexp_full_match(a, '[0-9]+') or not regexp_full_match(b, '[0-9]+') then 'invalid_value'
    when try_cast(a as hugeint) is null or try_cast(b as hugeint) is null or try_cast(a as hugeint) >= num_vertices or try_cast(b as hugeint) >= num_vertices then 'invalid_value' end reason from judged)"""

_RUNS = r"""lined as (select file_id, line_no, list_transform(regexp_extract_all(',' || regexp_replace(raw_line, '[\r\n]+$', ''), ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x: case when x like '"%"' and len(x) > 1 then replace(x[2:-2], '""', '"') else x end) f from run_lines),
  cells as materialized (select file_id, line_no, unnest(f) v, unnest(range(1, len(f) + 1)) pos from lined),
  valued as (select *, regexp_extract(v, '^\s*(?:[A-Za-z]*\s*[=:~#<>≈$€£+-])?\s*(-?[0-9][0-9,'' ]*(?:[.][0-9]+)?)\s*[A-Za-z%µ]*\s*$', 1) num from cells where line_no > 1),
  normal as (select file_id, line_no, pos, case when trim(v) = '' then '' when num <> '' then cast(cast(regexp_replace(num, '[,'' ]', '', 'g') as decimal(30, 8)) as varchar) else trim(v) end x from valued),
  stat as (select file_id, pos, count(*) filter (trim(v) <> '') filled, count(*) filter (regexp_full_match(v, '[0-9]+')) digits, count(*) filter (regexp_full_match(v, '[0-9]+([.][0-9]+)?')) plain from cells where line_no > 1 group by all),
  field as materialized (select n.file_id, n.pos, n.v as name, case when coalesce(digits, 0) = coalesce(filled, 0) then 'int' when plain = filled then 'decimal' else 'text' end kind from cells n left join stat s using (file_id, pos) where n.line_no = 1),
  ends as (select file_id, max(line_no) m from run_lines where line_no > 1 group by 1),
  head as (select file_id, pos, list(x order by line_no) xs from normal where line_no <= 3 group by all),
  tail as (select file_id, pos, list(x order by line_no) xs from normal join ends using (file_id) where line_no >= m - 1 group by all),
  pair as (select file_id, old_id from (select file_id, lag(file_id) over (partition by series_name order by file_seq, file_id) old_id from run_files) where old_id is not null),
  gone as (select p.file_id, p.old_id, o.name, o.kind, t.xs from pair p join field o on o.file_id = p.old_id left join tail t on t.file_id = o.file_id and t.pos = o.pos where not exists (select 1 from field n where n.file_id = p.file_id and n.name = o.name)),
  fresh as (select p.file_id, n.name, n.kind, h.xs from pair p join field n on n.file_id = p.file_id left join head h on h.file_id = n.file_id and h.pos = n.pos where not exists (select 1 from field o where o.file_id = p.old_id and o.name = n.name)),
  renamed as (select g.file_id, g.name old_field, f.name new_field, g.kind old_kind, f.kind new_kind from gone g join fresh f on f.file_id = g.file_id and f.xs = g.xs where list_aggregate(g.xs, 'string_agg', '') <> ''),
  kept as (select p.file_id, o.name old_field, n.name new_field, o.kind old_kind, n.kind new_kind from pair p join field o on o.file_id = p.old_id join field n on n.file_id = p.file_id and n.name = o.name union all select * from renamed)"""

ORACLE = {
    "p1_found": f"with {_RUNS} select file_id, 'renamed' as change, old_field, new_field from renamed union all select file_id, 'removed', name, '' from gone g where not exists (select 1 from renamed r where r.file_id = g.file_id and r.old_field = g.name) union all select file_id, 'added', '', name from fresh f where not exists (select 1 from renamed r where r.file_id = f.file_id and r.new_field = f.name) union all select file_id, 'type_changed', old_field, new_field from kept where old_kind <> new_kind",
    "p1_cells": r"""with lined as (select line_id, file_id, line_no, list_transform(regexp_extract_all(',' || regexp_replace(raw_line, '[\r\n]+$', ''), ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x: case when x like '"%"' and len(x) > 1 then replace(x[2:-2], '""', '"') else x end) f from run_lines),
  cells as materialized (select line_id, file_id, line_no, unnest(f) v, unnest(range(1, len(f) + 1)) pos from lined)
  select c.line_id, h.v field, case when regexp_full_match(c.v, '[0-9]+') then 'int' when regexp_full_match(c.v, '[0-9]+[.][0-9]+') then 'decimal' else 'text' end raw_type, c.v as "value" from cells c join cells h on h.file_id = c.file_id and h.pos = c.pos and h.line_no = 1 where c.line_no > 1 and trim(c.v) <> ''""",
    "p3_found": f"with {_ENDS} select graph_name, node_id from ends group by all having count(*) >= 0.01 * (select count(*) from graph_edges)",
    "p3_degrees": f"with {_ENDS} select graph_name, node_id, count(distinct other) filter (other <> node_id) degree, count(*) n_rows, count(*) >= 0.01 * (select count(*) from graph_edges) heavy from ends group by 1, 2",
    "p5_found": f"with {_LINES} select line_id, reason from reasoned where reason is not null",
    "p5_graph_edges": f"with {_LINES} select line_id, file_id, a::bigint node1, b::bigint node2, fields[3] as \"label\", fields[4] stamp from reasoned where reason is null and target_table = 'graph_edges'",
    "p5_edges_to_delete": f"with {_LINES} select line_id, file_id, a::bigint node1, b::bigint node2, fields[3] note from reasoned where reason is null and target_table = 'edges_to_delete'",
}
