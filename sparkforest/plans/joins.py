"""Joins that look at a side's size before they choose broadcast, and salt otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20
SALTS = 16


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most ``rows`` rows, of at most BROADCAST_BYTES together where they hold texts or arrays; reads no
    further than that many rows."""
    few = df.limit(rows + 1)
    if all(isinstance(f.dataType, (NumericType, DatetimeType, BooleanType)) for f in df.schema.fields):
        return few.count() <= rows
    n, size = few.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return n <= rows and (size or 0) <= BROADCAST_BYTES


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Joins a table with one row per key in ``small`` to a table in which one key may hold a third of all rows.

    Up to ``rows`` rows, ``small`` is broadcast. Beyond, both sides are shuffled on (key, salt): every row of ``small`` is
    repeated ``salts`` times, so the rows of a hot key spread over that many tasks. A null key matches nothing.
    """
    if fits_broadcast(small, rows):
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    return spread.join(salted, [key, "_salt"], how).drop("_salt")
