"""Size decisions: when a graph is small enough for one task, and joins that survive one hot key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.plans.joins import BROADCAST_ROWS, fits_broadcast

#: Rows of a graph up to which an iteration runs in one task: 2 million edges are 32 MB there.
SMALL_ROWS = 2_000_000
#: A join whose larger side has at most so many rows needs no care for hot keys.
CALM_ROWS = 1_000_000
WIDTH = 4
HOT_PARTS = 1_000


_ROUNDS_ONLY: ContextVar[bool] = ContextVar("rounds_only", default=False)


@contextmanager
def rounds_only() -> Iterator[None]:
    """Inside, no graph counts as small: everything takes the joins meant for large ones, whatever its size."""
    token = _ROUNDS_ONLY.set(True)
    try:
        yield
    finally:
        _ROUNDS_ONLY.reset(token)


def fits_task(rows: int) -> bool:
    return rows <= SMALL_ROWS and not _ROUNDS_ONLY.get()


def is_small(*dfs: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether the tables have at most ``rows`` rows together; none is read further than that."""
    if _ROUNDS_ONLY.get():
        return False
    left = rows
    for df in dfs:
        n = df.limit(left + 1).count()
        if n > left:
            return False
        left -= n
    return True


def in_one_task(inputs: dict[str, DataFrame], kernel: Callable[[dict[str, list[np.ndarray]]], list[np.ndarray]], schema: str) -> DataFrame:
    """Runs a numpy kernel over tables of up to WIDTH bigint columns whose size was checked with is_small.

    The tables are tagged, brought into one partition and handed over as arrays, in the order of their columns.
    """
    names = list(inputs)
    whole: DataFrame | None = None
    widths = {}
    for i, name in enumerate(names):
        df = inputs[name]
        widths[name] = len(df.columns)
        if len(df.columns) > WIDTH:
            raise ValueError(f"at most {WIDTH} columns")
        cols = [F.col(f"`{c}`").cast("bigint").alias(f"c{k}") for k, c in enumerate(df.columns)]
        cols += [F.lit(0).cast("bigint").alias(f"c{k}") for k in range(len(cols), WIDTH)]
        part = df.select(F.lit(i).alias("tag"), *cols)
        whole = part if whole is None else whole.unionByName(part)
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            tag = table.column("tag").to_numpy()
            cols = [table.column(f"c{k}").to_numpy() for k in range(WIDTH)]
        else:
            tag, cols = np.empty(0, np.int32), [np.empty(0, np.int64)] * WIDTH
        given = {}
        for i, name in enumerate(names):
            at = tag == i
            given[name] = [c[at] for c in cols[: widths[name]]]
        out = kernel(given)
        for k in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in out], names=columns)

    return whole.repartition(1).mapInArrow(run, schema)


def hot_keys(rows: DataFrame, key: str, n: int) -> list:
    """The keys that hold at least one in HOT_PARTS of the ``n`` rows: at most HOT_PARTS of them, counted with partial sums."""
    return [r[0] for r in rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= n / HOT_PARTS).select(key).collect()]


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", small: bool = False, rows: int | None = None, right_rows: int | None = None, hot: list | None = None) -> DataFrame:
    """Joins ``left``, in which a key may hold a third of all rows, to ``right`` with at most one row per key.

    Small tables are left to the planner. Of the others, a side of up to BROADCAST_ROWS rows is broadcast, the left one in inner
    joins only. Otherwise the hot keys take their rows of ``right`` by broadcast and the other keys an ordinary shuffle.
    ``rows`` and ``right_rows`` spare counting, ``hot`` the search for the hot keys; the inputs are read more than once, so
    they should be checkpoints or scans. how: inner, left, left_semi or left_anti.
    """
    if small:
        return left.join(right, key, how)
    if how == "inner" and rows is not None and rows <= BROADCAST_ROWS and (right_rows is None or right_rows > rows):
        return F.broadcast(left).join(right, key)
    if right_rows <= BROADCAST_ROWS if right_rows is not None else fits_broadcast(right, BROADCAST_ROWS):
        return left.join(F.broadcast(right), key, how)
    n = left.count() if rows is None else rows
    if n <= CALM_ROWS:
        return left.join(right, key, how)
    keys = hot_keys(left, key, n) if hot is None else hot
    if not keys:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    few = F.broadcast(right.where(is_hot))
    return left.where(is_hot).join(few, key, how).unionByName(left.where(~is_hot).join(right, key, how))
