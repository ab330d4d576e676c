"""Graph files: text edge lists with a header line, binary adjacency (CSR), batches, and CSV records."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkforest.operators.edges import canonical, symmetrise, vertices_of
from sparkforest.plans.context import cut

#: File name endings and what they hold.
FORMATS = {"txt": "text", "edges": "text", "eg2": "text", "egr": "binary", "csr": "binary", "parquet": "parquet"}
SPLIT_NEIGHBOURS = 4_000_000
FILL = 1_000_000
#: Lines of a text file; a graph of more is written as several.
PART_ROWS = 20_000_000
_EDGE = "u bigint, v bigint"
_NONE = "\x01"  # no line holds it: every line is one field


def format_of(path: str) -> str:
    ending = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if ending not in FORMATS:
        raise ValueError(f"unknown graph format {ending!r}; known: {', '.join(FORMATS)}")
    return FORMATS[ending]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): the lines of text files without each file's first, which the reader drops at the file's first block only."""
    return spark.read.option("header", True).option("enforceSchema", True).option("sep", _NONE).option("quote", "").option("escape", "").option("comment", "").schema("line string").csv(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) as the lines have them, header left out. Lines that do not hold two whole numbers are left out; rejects.parse_lines reports them."""
    part = F.split(F.trim(F.regexp_replace("line", r"[ \t\r]+", " ")), " ")
    return _lines(spark, path).select(F.get(part, F.lit(0)).try_cast("bigint").alias("u"), F.get(part, F.lit(1)).try_cast("bigint").alias("v")).where("u is not null and v is not null")


def declared_size(spark: SparkSession, path: str) -> tuple[int, ...]:
    """The numbers in a text file's header line."""
    first = spark.read.text(path).where("_metadata.file_block_start = 0").first()
    return tuple(int(x) for x in first[0].split()) if first else ()


def _place(path: str):
    """(file system, path in it); Hadoop writes local URIs with one slash."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _open(path: str):
    system, at = _place(path)
    return system.open_input_file(at)


def _sizes(path: str) -> tuple[int, int]:
    with _open(path) as f:
        return struct.unpack("<QQ", f.read(16))


def read_egr(spark: SparkSession, path: str, split: int = SPLIT_NEIGHBOURS) -> DataFrame:
    """(src, dst) out of a binary adjacency file: two unsigned 64-bit sizes, 64-bit offsets, 32-bit neighbours, little endian.

    The file is read by ranges of neighbours, so a hub spreads over several tasks; every task finds the first vertex of its
    range by bisection in the offsets and reads its range only.
    """
    n_offsets, n_neighbours = _sizes(path)
    starts = list(range(0, n_neighbours, split))
    base = 16 + 8 * n_offsets

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in b.column(0).to_pylist():
                end = min(n_neighbours, start + split)
                with _open(path) as f:

                    class Offsets:
                        def __len__(self) -> int:
                            return n_offsets

                        def __getitem__(self, i: int, f=f) -> int:
                            f.seek(16 + 8 * i)
                            return struct.unpack("<q", f.read(8))[0]

                    first = bisect_right(Offsets(), start) - 1
                    last = bisect_right(Offsets(), end - 1)
                    f.seek(16 + 8 * first)
                    offsets = np.frombuffer(f.read(8 * (last - first + 1)), "<i8")
                    f.seek(base + 4 * start)
                    dst = np.frombuffer(f.read(4 * (end - start)), "<i4").astype(np.int64)
                src = first + np.searchsorted(offsets, np.arange(start, end), side="right") - 1
                for k in range(0, len(dst), 500_000):
                    yield pa.RecordBatch.from_arrays([pa.array(src[k : k + 500_000]), pa.array(dst[k : k + 500_000])], names=["src", "dst"])

    if not starts:
        return spark.createDataFrame([], "src bigint, dst bigint")
    return spark.createDataFrame([(s,) for s in starts], "start bigint").repartition(len(starts), "start").mapInArrow(read, "src bigint, dst bigint")


def read_graph(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """(u, v) with u < v, each edge once, whichever directions the file lists. fmt: text, binary or parquet; by the file's ending if not given."""
    fmt = fmt or format_of(path)
    if fmt == "text":
        return canonical(read_pairs(spark, path))
    if fmt == "binary":
        return canonical(read_egr(spark, path), "src", "dst")
    if fmt == "parquet":
        return canonical(spark.read.parquet(path))
    raise ValueError(f"unknown graph format {fmt!r}")


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """(u, v), canonical: a count line, then one edge per line in either order."""
    return canonical(read_pairs(spark, path))


def _write_lines(pairs: DataFrame, header: str, path: str, rows: int, part_rows: int) -> None:
    """Up to part_rows lines make one file with the header first, as the format wants. Larger graphs make a folder of files, sorted
    one after the other, each with the header; the reader passes over the first line of each."""
    spark = pairs.sparkSession
    a, b = pairs.columns
    line = F.concat_ws(" ", a, b).alias("value")
    if rows > part_rows:
        parts = -(-rows // part_rows)
        ranged = pairs.repartitionByRange(parts, a, b).sortWithinPartitions(a, b).select(line.alias(header))
        ranged.write.mode("overwrite").option("header", True).option("sep", _NONE).option("quote", "").option("escape", "").csv(path)
        return
    text = pairs.select(F.lit(1).alias("k"), F.col(a).alias("x"), F.col(b).alias("y"), line)
    top = spark.createDataFrame([(0, None, None, header)], "k int, x bigint, y bigint, value string")
    top.unionByName(text).repartition(1).sortWithinPartitions("k", "x", "y").select("value").write.mode("overwrite").text(path)


def write_batch(batch: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    n = batch.count()
    _write_lines(batch.select("u", "v"), str(n), path, n, part_rows)


def write_graph(edges: DataFrame, path: str, vertices: DataFrame | None = None, part_rows: int = PART_ROWS) -> None:
    """Header ``vertices directed-edges``, then both directions of every edge."""
    n, m = (vertices_of(edges) if vertices is None else vertices).count(), 2 * edges.count()
    _write_lines(symmetrise(edges), f"{n} {m}", path, m, part_rows)


def write_records(records: DataFrame, path: str) -> None:
    """Records as CSV with a header; nulls are empty."""
    records.write.mode("overwrite").option("header", True).csv(path)


def write_egr(edges: DataFrame, path: str) -> None:
    """A binary adjacency file of a graph of any size; ids must be from 0 to 2**31 - 1.

    The format is one file, so one task writes it, streaming: first the offsets out of the vertices' degrees in order of id, then
    the neighbours sorted by both ends. Spark sorts, on disk where need be; the task holds one batch of rows at a time.
    """
    sym = cut(symmetrise(edges))
    size = sym.agg(F.count("*").alias("n"), F.coalesce(F.max("src"), F.lit(-1)).alias("top"), F.coalesce(F.min("src"), F.lit(0)).alias("low")).first()
    n, n_offsets = size["n"], size["top"] + 2
    if size["low"] < 0 or size["top"] >= 1 << 31:
        raise ValueError("the binary format holds ids from 0 to 2**31 - 1")
    degree = sym.groupBy("src").agg(F.count("*").alias("x")).select(F.lit(0).alias("part"), "src", F.col("x"))
    first = sym.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("src"), F.lit(0).cast("bigint").alias("x"))  # an empty graph has a file too
    rows = first.unionByName(degree).unionByName(sym.select(F.lit(1).alias("part"), "src", F.col("dst").alias("x")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _place(path)
        with system.open_output_stream(at) as f:
            f.write(struct.pack("<QQ", n_offsets, n))
            filled, total = 0, 0  # offsets written, and the neighbours of the vertices before

            def fill(until: int) -> None:
                nonlocal filled
                while filled < until:  # vertices without edges, in bounded steps
                    k = min(until - filled, FILL)
                    f.write(np.full(k, total, "<i8").tobytes())
                    filled += k

            done = 0
            for b in batches:
                part, src, x = (b.column(i).to_numpy() for i in range(3))
                at_degrees = part == 0
                for v, d in zip(src[at_degrees].tolist(), x[at_degrees].tolist()):
                    fill(v + 1)
                    total += d
                dst = x[part == 1]
                if len(dst):
                    fill(n_offsets)
                    f.write(dst.astype("<i4").tobytes())
                    done += len(dst)
            fill(n_offsets)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    # coalesce would sort in one task too; the exchange lets the tables before it keep their tasks.
    rows.repartition(1).sortWithinPartitions("part", "src", "x").mapInArrow(write, "n bigint").collect()
