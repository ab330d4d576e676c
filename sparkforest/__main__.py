"""python -m sparkforest -i graph [-b batch] [-r SG|HS|GRAFT|HOOK] [-p ET|PR] [-x root] [-f bfs|graft] [-s] [-v] [-c] [--master M]

Builds the forest, deletes the batch (a generated one without -b), inserts it again and prints the counts.
-s prints statistics of graph and repair, -v the phases' times, -c checks the forest after every step.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sparkforest.operators.generate import tree_edge_batch
from sparkforest.operators.trees import depths, graph_statistics, path_statistics, validate_forest
from sparkforest.plans.context import cut
from sparkforest.sources import read_batch, read_graph
from sparkforest.state import ForestState, repair_details, repair_report
from sparkforest.timing import PhaseTimer


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkforest", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-i", required=True, dest="graph")
    p.add_argument("-b", dest="batch")
    p.add_argument("-r", choices=("SG", "HS", "GRAFT", "HOOK"), default="SG")
    p.add_argument("-p", choices=("ET", "PR"), default="ET")
    p.add_argument("-x", type=int, dest="root")
    p.add_argument("-f", choices=("bfs", "graft"), default="bfs", dest="how", help="graft: for graphs of great depth")
    p.add_argument("-s", action="store_true", dest="stats")
    p.add_argument("-v", action="store_true", dest="verbose")
    p.add_argument("-c", action="store_true", dest="check")
    p.add_argument("--master")
    a = p.parse_args(argv)
    builder = SparkSession.builder.appName("sparkforest")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    timer = PhaseTimer()
    with timer.phase("read"):
        edges = cut(read_graph(spark, a.graph))
    with timer.phase("forest"):
        state = ForestState.from_edges(edges, root=a.root, how=a.how, strategy=a.r.lower(), method={"ET": "interval", "PR": "lifting"}[a.p])
    with timer.phase("batch"):
        batch = cut(read_batch(spark, a.batch) if a.batch else tree_edge_batch(edges, state.forest))
    if a.stats:
        graph_statistics(edges).show(truncate=False)
        path_statistics(depths(state.forest)).show(truncate=False)
    good = True
    for name in ("delete", "insert"):
        with timer.phase(name):
            new = getattr(state, name)(batch)
        if a.stats:
            repair_report(state, new, batch).show(truncate=False)
            if name == "delete":
                repair_details(state, new, batch).show(truncate=False)
        if a.check:
            good &= validate_forest(new.forest, new.edges).first()["valid"]
        state = new
        print(f"{name}: {state.components().first()[0]} trees")
    if a.check:
        print("valid" if good else "NOT VALID")
    if a.verbose:
        timer.table(spark).show(truncate=False)
    return 0 if good else 1


if __name__ == "__main__":
    raise SystemExit(main())
