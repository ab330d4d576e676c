"""python -m sparkforest.runner GRAPHS BATCHES OUT [--timeout S] [--master M]: every graph with every batch of its name.

GRAPHS and BATCHES are folders; a batch belongs to the graph whose file name, without ending, its own name starts with.
Each pair runs deletion and insertion in a process of its own with a time limit, and appends a CSV record to OUT.
"""

from __future__ import annotations

import argparse
import csv
import subprocess
import sys
import time
from pathlib import Path

FIELDS = ("filename", "batch", "state", "seconds", "delete_trees", "insert_trees")


def pairs(graphs: Path, batches: Path) -> list[tuple[Path, Path]]:
    """Sorted pairs; where several graphs' names fit a batch the longest wins."""
    own = sorted(graphs.iterdir(), key=lambda p: (-len(p.stem), p.name))
    found = [(next((g for g in own if b.name.startswith(g.stem)), None), b) for b in sorted(batches.iterdir())]
    return sorted((g, b) for g, b in found if g is not None)


def run_pair(graph: Path, batch: Path, timeout: float, extra: list[str]) -> dict:
    began = time.perf_counter()
    try:
        done = subprocess.run([sys.executable, "-m", "sparkforest", "-i", str(graph), "-b", str(batch), *extra], capture_output=True, text=True, timeout=timeout)
        said = dict(x.split(": ", 1) for x in done.stdout.splitlines() if x.startswith(("delete: ", "insert: ")))
        state = "ok" if done.returncode == 0 else "failed"
    except subprocess.TimeoutExpired:
        said, state = {}, "timeout"
    count = lambda k: said.get(k, "").split(" ")[0]
    return {"filename": graph.name, "batch": batch.name, "state": state, "seconds": round(time.perf_counter() - began, 3), "delete_trees": count("delete"), "insert_trees": count("insert")}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkforest.runner", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("graphs", type=Path)
    p.add_argument("batches", type=Path)
    p.add_argument("out", type=Path)
    p.add_argument("--timeout", type=float, default=300)
    p.add_argument("--master")
    a = p.parse_args(argv)
    fresh = not a.out.exists()
    good = True
    with a.out.open("a", newline="") as f:
        w = csv.DictWriter(f, FIELDS)
        if fresh:
            w.writeheader()
        for graph, batch in pairs(a.graphs, a.batches):
            row = run_pair(graph, batch, a.timeout, ["--master", a.master] if a.master else [])
            good &= row["state"] == "ok"
            w.writerow(row)
            f.flush()
    return 0 if good else 1


if __name__ == "__main__":
    raise SystemExit(main())
