"""Layout drift, heavy keys and rejected rows on small tables, against plain Python and by case."""

import csv
import random

import pytest

from sparkforest.operators import drift, rejects, skew

EDGE = "edge_id bigint, graph_name string, node1 bigint, node2 bigint, node_id string"


def edge_table(spark, rows):
    return spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], EDGE)


def test_degrees_and_heavy_vertices_against_python(spark, table_rows):
    r = random.Random(1)
    rows = [("g", 1, r.randrange(40)) for _ in range(300)] + [(r.choice("gh"), r.choice([None, *range(60)]), r.choice([None, *range(60)])) for _ in range(500)]
    stand, near = {}, {}
    for g, a, b in rows:
        for x in {a, b} - {None}:
            stand[g, x] = stand.get((g, x), 0) + 1
            near.setdefault((g, x), set()).update({a, b} - {None, x})
    want = sorted(((g, x, len(near[g, x]), n, n >= 0.05 * len(rows)) for (g, x), n in stand.items()), key=repr)
    e = edge_table(spark, rows)
    assert table_rows(skew.vertex_degrees(e, 0.05)) == want
    assert table_rows(skew.heavy_vertices(e, 0.05).rows.select("graph_name", "node_id")) == sorted(((g, x) for g, x, _, _, h in want if h), key=repr)


def test_heavy_vertices_of_empty_tied_and_null_tables(spark, table_rows):
    assert skew.vertex_degrees(edge_table(spark, []).where("edge_id < 0")).count() == 0
    assert skew.heavy_vertices(edge_table(spark, []).where("edge_id < 0")).rows.count() == 0
    assert skew.vertex_degrees(edge_table(spark, [("g", None, None)])).count() == 0
    same = edge_table(spark, [("g", 1, 1)] * 3 + [(None, 1, 2)])
    assert table_rows(skew.vertex_degrees(same, 0.25)) == [("g", 1, 0, 3, True), (None, 1, 1, 1, True), (None, 2, 1, 1, True)]


LINES = "line_id bigint, file_id bigint, line_no int, raw_line string, target_table string"
FILES = "file_id bigint, target_table string, file_name string, delimiter string, n_fields int, num_vertices bigint, received_at timestamp"
CASES = [
    (1, "1,2,x,y", None), (1, '"1","2","a ""b"", c",y', None), (1, '1,2,"x,y', "quoting"), (1, '1,2,x"y,z', "quoting"), (1, '1,"2" ,x,y', "quoting"),
    (1, '1,2,"",""""', None), (1, "1,2,x", "column_count"), (1, "", "column_count"), (1, None, "column_count"), (1, "1,2,x,y,z", "column_count"),
    (1, " 007 ,\t2,x,y\r", None), (1, "1,100,x,y", "invalid_value"), (1, "-1,2,x,y", "invalid_value"), (1, "1,,x,y", "invalid_value"), (1, "1,٣,x,y", "invalid_value"),
    (1, "1,2,a\rb,c\x00d", None), (1, "1,2," + "z" * 300_000 + ",y", None), (1, "9" * 500 + ",2,x,y", "invalid_value"), (1, "0" * 500 + "5,2,x,y", None), (1, '"1,2,x"",y', "quoting"),
    (2, "  1 \t 2 ", None), (2, "1\xa02", "column_count"), (2, "1 2 3", "column_count"), (2, "1 2\r", None), (2, '"1" 2', "invalid_value"), (2, "1,2", "column_count"), (2, "\r", "column_count"),
    (3, "1 2", "unknown_file"), (None, "1 2", "unknown_file"),
]


def test_every_reason(spark):
    lines = spark.createDataFrame([(i, f, 2, t, "clash") for i, (f, t, _) in enumerate(CASES)], LINES)
    files = spark.createDataFrame([(1, "graph_edges", "a.csv", "comma", 4, 100, None), (2, "edges_to_delete", "b.txt", "space", 2, 100, None)], FILES)
    got = {r["line_id"]: r for r in rejects.parse_lines(lines, files).collect()}
    assert [got[i]["reason"] for i in range(len(CASES))] == [c[2] for c in CASES]
    assert (got[1]["node1"], got[1]["node2"], got[1]["rest"]) == (1, 2, ['a "b", c', "y"])
    assert got[10]["node1"] == 7 and got[15]["rest"] == ["a\rb", "c\x00d"] and len(got[16]["rest"][0]) == 300_000 and got[18]["node1"] == 5
    assert rejects.parse_lines(lines.limit(0), files).count() == 0


def test_well_formed_lines_are_read_like_the_csv_module(spark):
    r = random.Random(2)
    for _ in range(300):
        fields = ["".join(r.choice('ab", ') for _ in range(r.randrange(6))) for _ in range(4)]
        line = ",".join('"' + f.replace('"', '""') + '"' if r.random() < 0.5 or '"' in f or "," in f else f for f in fields)
        assert rejects.split_comma(line) == fields == next(csv.reader([line]))


RUN_FILES = "file_id bigint, series_name string, file_seq int, file_name string, loaded_at timestamp, line_id string"
RUN_LINES = "line_id bigint, file_id bigint, line_no int, raw_line string"


def run_tables(spark, series):
    files, lines = [], []
    for name, contents in series:
        for seq, text in enumerate(contents, 1):
            f = len(files)
            files.append((f, name, seq, "x.csv", None, "clash"))
            lines += [(len(lines) + k, f, k + 1, t) for k, t in enumerate(text.split("\n"))]
    return spark.createDataFrame(files, RUN_FILES), spark.createDataFrame(lines, RUN_LINES)


def test_layout_changes_by_case(spark, table_rows):
    files, lines = run_tables(
        spark,
        [
            ("a", ["file,n,t\ng,1,1.5\ng,2,2.5\ng,3,3.5", "t,file,count,new\n2.5ms,g,2 items,\n3.5ms,g,3 items,\n9ms,g,5 items,8", "file,t\n\"g\",9\n,\n"]),
            ("b", ["x,y\n,1\n,2", "z,y\n,1\n,2"]),
            ("c", ['v\n"1,000"\n2.0', "w\n1000.0\n2"]),
            (None, ["p\n1"]),
        ],
    )
    assert table_rows(drift.layout_changes(files, lines)) == sorted(
        [
            (1, "renamed", "n", "count"), (1, "added", "", "new"), (1, "type_changed", "t", "t"), (1, "type_changed", "n", "count"),
            (2, "removed", "count", ""), (2, "removed", "new", ""), (2, "type_changed", "t", "t"),
            (4, "removed", "x", ""), (4, "added", "", "z"),
            (6, "renamed", "v", "w"), (6, "type_changed", "v", "w"),
        ],
        key=repr,
    )


def test_consistent_table(spark):
    files, lines = run_tables(spark, [("a", ["file,n,t\ng,1,1.5\ng,2,2.5", "t,file,count\n1.5ms,g,1 items\n2.5ms,g,2 items\n9ms,g,oops,extra"])])
    t = drift.consistent_table(files, lines).orderBy("line_id")
    got = [r.asDict() for r in t.collect()]
    assert t.columns == ["line_id", "file_id", "line_no", "is_repeat", "count", "file", "t", "failed_casts"]
    assert [(r["count"], r["t"], r["file"], r["is_repeat"]) for r in got] == [(1, 1.5, "g", False), (2, 2.5, "g", False), (1, 1.5, "g", True), (2, 2.5, "g", True), (None, 9.0, "g", False)]
    assert got[4]["failed_casts"] == {"count": "oops", "#4": "extra"}


def test_drift_of_empty_and_null_tables(spark):
    files, lines = run_tables(spark, [("a", ["x\n1"])])
    assert drift.layout_changes(files.limit(0), lines.limit(0)).count() == 0
    assert drift.layout_changes(files, lines.limit(0)).count() == 0
    assert drift.consistent_table(files, lines.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, 1, "x"), (2, 0, None, "y"), (3, 0, 2, None)], RUN_LINES)
    assert drift.layout_changes(files, odd).count() == 0
    assert drift.consistent_table(files, odd).count() == 2


@pytest.mark.parametrize("cell, value", [("1,234", 1234), ("~5.50", 5.5), ("n=7", 7), ("#8", 8), ("3 total", 3), ("2.5ms", 2.5), ("uk-2002.egr", None), ("", None), ("1 2 x 3", None)])
def test_numbers_whatever_unit_stands_with_them(cell, value):
    got = drift.number(cell)
    assert (got is None and value is None) or float(got) == value
