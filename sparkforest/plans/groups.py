"""Streams of groups out of sorted partitions, without the cost of one Python call and one Arrow batch per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OUT_ROWS = 5_000


def batched(rows: Iterator[dict], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Packs dictionaries into record batches of bounded size."""
    hold: list[dict] = []
    for row in rows:
        hold.append(row)
        if len(hold) >= size:
            yield pa.RecordBatch.from_pylist(hold, schema=schema)
            hold = []
    if hold:
        yield pa.RecordBatch.from_pylist(hold, schema=schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over dictionaries: fn sees the rows of one partition as a stream."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(fn(row for b in batches for row in b.to_pylist()), arrow)

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[tuple, Iterator[dict]], Iterator[dict]], schema: str, sort: list[str] | None = None) -> DataFrame:
    """Shuffles on keys, sorts within the partitions and streams each group through fn.

    The caller makes sure by pre-aggregation that no group is unbounded.
    """
    from itertools import groupby

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for key, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            yield from fn(key, group)

    return map_rows(df.repartition(*keys).sortWithinPartitions(*keys, *(sort or [])), run, schema)
