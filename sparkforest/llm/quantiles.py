"""Percentiles with bounded error out of mergeable relative-rank compactors (the relative-error quantile sketch, Cormode et al. 2021).

Every level keeps its largest values and compacts the smaller ones: it sorts them, keeps every second one and hands it to
the next level with twice the weight. The rank error is therefore a share of the distance to the *upper* end, which is
where the 90th, 95th and 99th percentile of run times lie.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sparkforest.plans.groups import map_groups, map_rows

SECTION = 50
PERCENTILES = (0.5, 0.9, 0.95, 0.99)
BUFFER_ROWS = 1_000_000
SIGMAS = 3.0
_FIRST_SECTIONS, _LEAST_SECTION = 3, 4


class Compactor:
    """One level: values of equal weight, the largest of which are protected."""

    __slots__ = ("values", "section", "sections", "count")

    def __init__(self, section: float, sections: int = _FIRST_SECTIONS, count: int = 0, values: np.ndarray | None = None) -> None:
        self.section, self.sections, self.count = section, sections, count
        self.values = np.empty(0) if values is None else values

    @property
    def width(self) -> int:
        return max(_LEAST_SECTION, 2 * round(self.section / 2))

    @property
    def capacity(self) -> int:
        return 2 * self.width * self.sections

    def compact(self, coin: int) -> np.ndarray:
        """Takes the smallest values out, returns every second of them. How many sections stay is set by the count of
        compactions so far, as in a binary counter: the sections next to the protected half are touched rarely."""
        self.values.sort()
        trailing = (~self.count & (self.count + 1)).bit_length() - 1
        open_ = min(trailing + 1, self.sections)
        stay = self.width * (2 * self.sections - open_)
        take = (len(self.values) - stay) // 2 * 2
        low, self.values = self.values[:take], self.values[take:].copy()
        self.count += 1
        if self.count >= 1 << (self.sections - 1) and self.section / math.sqrt(2) >= _LEAST_SECTION:
            self.section, self.sections = self.section / math.sqrt(2), self.sections * 2
        return low[coin::2]


class RankSketch:
    """A mergeable sketch of numbers; see the module. ``update`` takes arrays without NaN."""

    def __init__(self, section: int = SECTION, seed: int = 0) -> None:
        self.section, self.seed, self.n = section, seed, 0
        self.low, self.high = math.inf, -math.inf
        self.levels = [Compactor(section)]
        self.flips = 0

    def _coin(self) -> int:
        """A seeded coin: the same input gives the same sketch when a task is run again."""
        self.flips += 1
        x = (self.flips * 0x9E3779B97F4A7C15 + self.seed * 0xBF58476D1CE4E5B9 + self.n) & (2**64 - 1)
        x ^= x >> 31
        return (x * 0x94D049BB133111EB & (2**64 - 1)) >> 63

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            while len(level.values) > level.capacity:
                if h + 1 == len(self.levels):
                    self.levels.append(Compactor(self.section))
                up = self.levels[h + 1]
                up.values = np.concatenate((up.values, level.compact(self._coin())))
            h += 1

    def update(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
        base = self.levels[0]
        base.values = np.concatenate((base.values, values.astype(float)))
        self._compress()

    def merge(self, other: RankSketch) -> None:
        if other.section != self.section:
            raise ValueError("sketches of different section sizes cannot be merged")
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        for h, theirs in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(Compactor(self.section))
            own = self.levels[h]
            if theirs.sections > own.sections:
                own.section, own.sections = theirs.section, theirs.sections
            own.count |= theirs.count
            own.values = np.concatenate((own.values, theirs.values))
        self._compress()

    @property
    def exact(self) -> bool:
        return len(self.levels) == 1

    def error(self, rank: float) -> float:
        """SIGMAS standard deviations of the normalised rank near ``rank``; 0 while nothing was compacted."""
        return 0.0 if self.exact else SIGMAS * math.sqrt(0.0512 / _FIRST_SECTIONS) / self.section * (1.0 - rank)

    def quantiles(self, ranks: list[float]) -> list[float]:
        """The smallest kept value below or at which at least a share ``rank`` of the values lies."""
        values = np.concatenate([x.values for x in self.levels])
        weights = np.concatenate([np.full(len(x.values), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, reach = values[order], np.cumsum(weights[order])
        out = []
        for r in ranks:
            if r <= 0:
                out.append(self.low)
            elif r >= 1:
                out.append(self.high)
            else:
                out.append(float(values[min(len(values) - 1, int(np.searchsorted(reach, math.ceil(r * self.n - 1e-9))))]))
        return out

    def dump(self) -> bytes:
        parts = [struct.pack("<iqqqddi", self.section, self.seed, self.n, self.flips, self.low, self.high, len(self.levels))]
        for x in self.levels:
            parts += [struct.pack("<diqi", x.section, x.sections, x.count, len(x.values)), x.values.astype("<f8").tobytes()]
        return b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> RankSketch:
        own = cls()
        own.section, own.seed, own.n, own.flips, own.low, own.high, levels = struct.unpack_from("<iqqqddi", data)
        at, own.levels = struct.calcsize("<iqqqddi"), []
        for _ in range(levels):
            section, sections, count, size = struct.unpack_from("<diqi", data, at)
            at += struct.calcsize("<diqi")
            own.levels.append(Compactor(section, sections, count, np.frombuffer(data, "<f8", size, at).copy()))
            at += 8 * size
        return own


_SKETCHED = "sketch binary"


def sketch_groups(df: DataFrame, keys: list[str], value: str, section: int = SECTION, seed: int = 0) -> DataFrame:
    """(*keys, sketch): one sketch per group of the rows whose value is neither null nor NaN; other groups give no row.

    Every partition reduces its rows to sketches first, so a group with a third of all rows sends one sketch per partition.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema = f"{ddl}, {_SKETCHED}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        values = whole.column(value).to_numpy()
        group = np.zeros(len(values), dtype=np.int64)
        for k in keys:
            codes = whole.column(k).combine_chunks()
            codes = (codes if isinstance(codes, pa.Array) else codes.chunk(0)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            _, group = np.unique(group * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
        order = np.argsort(group, kind="stable")
        firsts = np.flatnonzero(np.diff(group[order], prepend=-1))
        sketches = []
        for a, b in zip(firsts, [*firsts[1:], len(order)]):
            s = RankSketch(section, seed)
            s.update(values[order[a:b]])
            sketches.append(s.dump())
        heads = whole.select(keys).take(pa.array(order[firsts])).combine_chunks()
        columns = [heads.column(k).combine_chunks() if heads.num_rows else heads.column(k) for k in keys]
        table = pa.Table.from_arrays([*columns, pa.array(sketches, pa.binary())], names=[*keys, "sketch"])
        for b in table.cast(arrow).to_batches(max_chunksize=2_000):
            yield b

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= BUFFER_ROWS:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    good = df.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    return merge_sketches(good.mapInArrow(partial, schema), keys)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, sketch): sketches of the same group, from partitions or days, made one."""
    types = {f.name: f.dataType.simpleString() for f in sketches.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {_SKETCHED}"

    def merged(key: tuple, rows: Iterator[dict]) -> Iterator[dict]:
        whole: RankSketch | None = None
        for r in rows:
            one = RankSketch.load(r["sketch"])
            if whole is None:
                whole = one
            else:
                whole.merge(one)
        yield {**dict(zip(keys, key)), "sketch": whole.dump()}

    return map_groups(sketches.select(*keys, "sketch"), keys, merged, schema)


def read_percentiles(sketches: DataFrame, keys: list[str], ranks: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """(*keys, n_values, then per percentile pX, pX_low, pX_high, and rank_error_pX).

    pX_low and pX_high are the values at rank X less and plus rank_error_pX, a share of n_values (three standard
    deviations). A group that was never compacted is exact: the error is 0 and the three agree.
    """
    types = {f.name: f.dataType.simpleString() for f in sketches.schema.fields}
    name = lambda r: f"p{r * 100:g}".replace(".", "_")
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_values bigint" + "".join(f", {name(r)} double, {name(r)}_low double, {name(r)}_high double, rank_error_{name(r)} double" for r in ranks)

    def read(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            s = RankSketch.load(row["sketch"])
            out = {k: row[k] for k in keys} | {"n_values": s.n}
            for r in ranks:
                e = s.error(r)
                low, mid, high = s.quantiles([r - e, r, r + e] if e else [r, r, r])
                out |= {name(r): mid, f"{name(r)}_low": low, f"{name(r)}_high": high, f"rank_error_{name(r)}": e}
            yield out

    return map_rows(sketches.select(*keys, "sketch"), read, schema)


def run_times(runs: DataFrame) -> DataFrame:
    """(filename, batch_size, day, total_time): each run once, as it was exported last.

    run_id recurs when a run was exported again, which must not count twice; a row without run_id is a run of its own.
    A time of 0.0 marks a run cut off, which has no time: it becomes null, as NaN does. ``day`` is the date of run_at.
    """
    own = F.when(F.col("run_id").isNull(), F.col("row_id"))
    last = F.max_by(F.struct("filename", "batch_size", "run_at", "total_time"), F.struct("loaded_at", "row_id"))
    one = runs.groupBy("run_id", own.alias("own")).agg(last.alias("r")).select("r.*")
    t = F.col("total_time")
    return one.select("filename", "batch_size", F.to_date("run_at").alias("day"), F.when(~F.isnan(t) & (t != 0), t).alias("total_time"))


def day_sketches(runs: DataFrame, section: int = SECTION) -> DataFrame:
    """(filename, batch_size, day, sketch): the form in which days are kept and combined later. Null keys are groups of their own."""
    return sketch_groups(run_times(runs), ["filename", "batch_size", "day"], "total_time", section)


def run_percentiles(runs: DataFrame, section: int = SECTION) -> DataFrame:
    """Median, 90th, 95th and 99th percentile of the run time per filename and batch_size, combined from the sketches of the days."""
    keys = ["filename", "batch_size"]
    return read_percentiles(merge_sketches(day_sketches(runs, section), keys), keys)


def bounds_hold(runs: DataFrame, section: int = SECTION) -> DataFrame:
    """(filename, batch_size, n_values, holds): whether every percentile's true rank, counted over all runs, is within its stated error.

    The counting is exact and runs on the map side first; the percentiles, one row per group, meet the runs by lookup_join.
    """
    from sparkforest.plans.joins import lookup_join

    key = F.to_json(F.struct("filename", "batch_size")).alias("group")
    found = run_percentiles(runs, section).withColumn("group", key)
    values = run_times(runs).where("total_time is not null").select(key, "total_time")
    name = lambda r: f"p{r * 100:g}"
    met = lookup_join(values, found, "group", "inner")
    counts = [F.count_if(F.col("total_time") < F.col(name(r))).alias(f"b{i}") for i, r in enumerate(PERCENTILES)] + [F.count_if(F.col("total_time") <= F.col(name(r))).alias(f"t{i}") for i, r in enumerate(PERCENTILES)]
    errors = [F.max(f"rank_error_{name(r)}").alias(f"e{i}") for i, r in enumerate(PERCENTILES)]
    n = F.col("n_values")
    good = F.lit(True)
    for i, r in enumerate(PERCENTILES):
        slack = F.col(f"e{i}") * n + 1
        good = good & (F.col(f"b{i}") <= F.lit(r) * n + slack) & (F.col(f"t{i}") >= F.lit(r) * n - slack)
    return met.groupBy("filename", "batch_size").agg(F.max("n_values").alias("n_values"), *counts, *errors).select("filename", "batch_size", "n_values", good.alias("holds"))
