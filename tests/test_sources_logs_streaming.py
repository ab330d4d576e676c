"""Files, logs, command line and stream."""

import struct

import pytest

from sparkforest.__main__ import main
from sparkforest.operators import logs
from sparkforest.sources import declared_size, read_batch, read_egr, read_graph, write_batch, write_egr, write_graph
from sparkforest.sources.graph_files import format_of
from sparkforest.state import ForestState
from sparkforest.streaming.batches import OPERATIONS, ForestStore, run_stream

PAIRS = [(0, 1), (0, 2), (1, 2), (3, 4)]


def test_text_graph_in_any_direction_with_odd_lines(spark, table_rows, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("5 8\n0 1\n1\t0\n2   0\n1 2\n\n3 3\nx y\n4 3\r\n")
    assert declared_size(spark, str(p)) == (5, 8)
    assert table_rows(read_graph(spark, str(p))) == PAIRS
    (tmp_path / "h.txt").write_text("2 2\n7 8\n")
    assert (7, 8) in table_rows(read_graph(spark, str(tmp_path), "text"))
    with pytest.raises(ValueError, match="unknown"):
        format_of("g.bin")


def test_binary_graph_by_small_ranges(spark, table_rows, tmp_path):
    p = str(tmp_path / "g.egr")
    near = {0: [1, 2], 1: [0, 2], 2: [0, 1], 3: [4], 4: [3]}
    offsets, flat = [0], []
    for i in range(5):
        flat += near[i]
        offsets.append(len(flat))
    with open(p, "wb") as f:
        f.write(struct.pack("<QQ", 6, len(flat)) + struct.pack("<6q", *offsets) + struct.pack(f"<{len(flat)}i", *flat))
    for split in (1, 3, 100):
        assert table_rows(read_egr(spark, p, split)) == sorted(((i, j) for i, js in near.items() for j in js), key=repr)
    q = str(tmp_path / "h.egr")
    write_egr(read_graph(spark, p), q)
    assert open(p, "rb").read() == open(q, "rb").read()


def test_round_trips(spark, table_rows, tmp_path):
    e = spark.createDataFrame(PAIRS, "u bigint, v bigint")
    write_graph(e, str(tmp_path / "a.txt"))
    assert table_rows(read_graph(spark, str(tmp_path / "a.txt"))) == PAIRS and declared_size(spark, str(tmp_path / "a.txt")) == (5, 8)
    write_batch(e, str(tmp_path / "b"))
    assert table_rows(read_batch(spark, str(tmp_path / "b"))) == PAIRS and declared_size(spark, str(tmp_path / "b")) == (4,)


def test_a_large_text_graph_is_several_files(spark, table_rows, tmp_path):
    edges = spark.createDataFrame([(i, i + 1 + i % 3) for i in range(200)], "u bigint, v bigint")
    write_graph(edges, str(tmp_path / "g.txt"), part_rows=70)
    assert len(list((tmp_path / "g.txt").glob("part-*"))) > 3
    assert table_rows(read_graph(spark, str(tmp_path / "g.txt"))) == table_rows(edges) and declared_size(spark, str(tmp_path / "g.txt")) == (202, 400)
    write_batch(edges, str(tmp_path / "b"), part_rows=70)
    assert table_rows(read_batch(spark, str(tmp_path / "b"))) == table_rows(edges) and declared_size(spark, str(tmp_path / "b")) == (200,)


@pytest.mark.parametrize("ending", ["edges", "eg2", "csr", "parquet"])
def test_graphs_of_every_ending(spark, table_rows, tmp_path, ending):
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 4)], "u bigint, v bigint")
    at = str(tmp_path / f"g.{ending}")
    {"csr": write_egr, "parquet": lambda e, p: e.write.parquet(p)}.get(ending, write_graph)(edges, at)
    assert table_rows(read_graph(spark, at)) == table_rows(edges)


def test_logs(spark, table_rows, tmp_path):
    (tmp_path / "run.log").write_text("noise\nfilename: data/a.egr\nNumber of deleted tree edges: 7\n\nnumVert: 5, num_edges: 8 and delete batch size: 3\nTime of PJ : 1.5 ms\nTotal execution time for Deletion: 2.25 ms\nfilename: b.txt\nDepth of graph: 4\n")
    log = logs.read_log(spark, str(tmp_path / "run.log"))
    assert [tuple(r) for r in logs.parse_runs(log).drop("file").orderBy("block").collect()] == [(1, "data/a.egr", 7, 5, 8, 3, 2.25), (2, "b.txt", None, None, None, None, None)]
    wide = logs.parse_phases(log).orderBy("block")
    assert [r["PJ"] for r in wide.collect()] == [1.5, None] and wide.collect()[1]["depth_of_graph"] == 4
    (tmp_path / "tour.log").write_text("filename: x/g.egr\nRegular eulerian Tour finished in: 30 us\nRegular eulerian Tour finished in: 50 us\nMy eulerian Tour finished in: 9 us\nMy eulerian Tour finished in: 4 us\nfilename: h.egr\n")
    got = [tuple(r) for r in logs.parse_tours(logs.read_log(spark, str(tmp_path / "tour.log"))).select("filename", "max_regular", "min_my").orderBy("filename").collect()]
    assert got == [("g", 50, 4.0), ("h", 0, float("inf"))]
    assert logs.parse_runs(log.limit(0)).count() == 0


def test_stream_applies_each_batch_once(spark, table_rows, tmp_path):
    at = str(tmp_path)
    store = ForestStore(spark, f"{at}/state")
    store.start(ForestState.from_edges(spark.createDataFrame(PAIRS, "u bigint, v bigint")))
    spark.createDataFrame([(1, "delete", 4, 3), (2, "insert", 2, 3), (2, "insert", None, 3)], OPERATIONS).write.parquet(f"{at}/ops")
    run_stream(spark.readStream.schema(OPERATIONS).parquet(f"{at}/ops"), store, f"{at}/progress").awaitTermination()
    end = store.latest()
    assert end.version == 2 and table_rows(end.edges) == [(0, 1), (0, 2), (1, 2), (2, 3)]
    store.apply(spark.read.parquet(f"{at}/ops"))
    assert store.latest().version == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text("5 8\n" + "".join(f"{u} {v}\n{v} {u}\n" for u, v in PAIRS))
    (tmp_path / "b.txt").write_text("1\n4 3\n")
    assert main(["-i", str(tmp_path / "g.txt"), "-b", str(tmp_path / "b.txt"), "-c"]) == 0
    out = capsys.readouterr().out
    assert "delete: 3 trees" in out and "insert: 2 trees" in out and "valid" in out


def test_runner_pairs_batches_with_graphs(tmp_path, monkeypatch):
    from sparkforest import runner

    for n in ("g.txt", "g_big.txt"):
        (tmp_path / "graphs").mkdir(exist_ok=True)
        (tmp_path / "graphs" / n).write_text("0 0\n")
    (tmp_path / "batches").mkdir()
    for n in ("g_100.txt", "g_big_100.txt", "other.txt"):
        (tmp_path / "batches" / n).write_text("0\n")
    assert [(g.name, b.name) for g, b in runner.pairs(tmp_path / "graphs", tmp_path / "batches")] == [("g.txt", "g_100.txt"), ("g_big.txt", "g_big_100.txt")]
    monkeypatch.setattr(runner, "run_pair", lambda g, b, t, e: {"filename": g.name, "batch": b.name, "state": "ok", "seconds": 1.0, "delete_trees": "1", "insert_trees": "1"})
    out = tmp_path / "out.csv"
    assert runner.main([str(tmp_path / "graphs"), str(tmp_path / "batches"), str(out)]) == 0 and len(out.read_text().splitlines()) == 3


def test_binary_graph_beyond_one_task(spark, table_rows, tmp_path, monkeypatch):
    from sparkforest.plans import scale
    from sparkforest.sources import graph_files

    monkeypatch.setattr(scale.is_small, "__kwdefaults__", {"rows": 10})
    monkeypatch.setattr(graph_files, "FILL", 3, raising=False)
    pairs = [(i, i + 7) for i in range(5, 60, 5)] + [(5, 100)]
    p = str(tmp_path / "g.egr")
    write_egr(spark.createDataFrame(pairs, "u bigint, v bigint"), p)
    assert table_rows(read_graph(spark, p)) == sorted(pairs, key=repr)
    near = {v: sorted([b for a, b in pairs if a == v] + [a for a, b in pairs if b == v]) for v in range(101)}
    offsets = [sum(len(near[w]) for w in range(v)) for v in range(102)]
    flat = [w for v in range(101) for w in near[v]]
    assert open(p, "rb").read() == struct.pack("<QQ", 102, len(flat)) + struct.pack("<102q", *offsets) + struct.pack(f"<{len(flat)}i", *flat)
    write_egr(spark.createDataFrame([], "u bigint, v bigint"), p)
    assert open(p, "rb").read() == struct.pack("<QQq", 1, 0, 0)
    with pytest.raises(ValueError, match="ids"):
        write_egr(spark.createDataFrame([(1, 1 << 31)], "u bigint, v bigint"), p)
