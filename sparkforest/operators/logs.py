"""Run logs: text to records, records to averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkforest.plans.context import cut
from sparkforest.plans.prefix import grouped_prefix

MAX_PHASES = 2_000
#: The columns of the averaged records, in order.
AVERAGE_COLUMNS = ("filename", "numVertices", "numEdges", "batch_size", "tree_edges_count", "total_time")
_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) with pos ascending through each file: the block's place in the file, then the line's in the block."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_at"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("line"))
    return text.select("file", F.struct("block_at", "k").alias("pos"), "line")


def log_blocks(lines: DataFrame, small: bool = False) -> DataFrame:
    """lines(file, pos, line) with ``block``: how many lines starting ``filename:`` stand at or before the line in its file.

    Blank lines fall away, white space around a line does not count, and lines before the first block belong to block 0.
    """
    own = lines.select("file", "pos", F.trim(F.regexp_replace("line", r"[\s]+", " ")).alias("line")).where("line <> ''")
    start = own.withColumn("starts", F.col("line").startswith("filename:").cast("bigint"))
    return grouped_prefix(start, ["file"], ["pos"], "starts", "before", small).select("file", "pos", "line", (F.col("before") + F.col("starts")).alias("block"))


def _field(pattern: str, kind: str, group: int = 1) -> F.Column:
    found = F.regexp_extract("line", pattern, group)
    return F.max(F.when(found != "", found.try_cast(kind)))


def parse_runs(lines: DataFrame, small: bool = False) -> DataFrame:
    """One row per block: filename, tree_edges_count, numVertices, numEdges, batch_size, total_time (ms); what a block lacks is null."""
    sizes = r"numVert: (\d+), num_edges: (\d+) and delete batch size: (\d+)"
    return (
        log_blocks(lines, small)
        .where("block > 0")
        .groupBy("file", "block")
        .agg(
            _field(r"^filename: ?(.*)$", "string").alias("filename"),
            _field(r"Number of deleted tree edges: (\d+)", "bigint").alias("tree_edges_count"),
            _field(sizes, "bigint", 1).alias("numVertices"),
            _field(sizes, "bigint", 2).alias("numEdges"),
            _field(sizes, "bigint", 3).alias("batch_size"),
            _field(rf"Total execution time for Deletion: {_NUMBER} ms", "double").alias("total_time"),
        )
    )


def parse_phases(lines: DataFrame, small: bool = False) -> DataFrame:
    """One row per block: filename, delete_batch_size, depth_of_graph and a column per phase of ``Time of phase : n ms``.

    The phases become columns and therefore reach the driver: more than MAX_PHASES of them raise.
    """
    blocks = cut(log_blocks(lines, small).where("block > 0"))
    timed = blocks.select("file", "block", F.trim(F.regexp_extract("line", r"^Time of(.*?):", 1)).alias("phase"), F.regexp_extract("line", rf":\s*{_NUMBER}", 1).try_cast("double").alias("ms")).where("phase <> ''")
    phases = [r[0] for r in timed.select("phase").distinct().orderBy("phase").limit(MAX_PHASES + 1).collect()]
    if len(phases) > MAX_PHASES:
        raise ValueError(f"more than {MAX_PHASES} phases")
    head = blocks.groupBy("file", "block").agg(_field(r"^filename: ?(.*)$", "string").alias("filename"), _field(r"Delete batch Size: ?(\d+)", "bigint").alias("delete_batch_size"), _field(r"Depth of graph: ?(\d+)", "bigint").alias("depth_of_graph"))
    wide = timed.groupBy("file", "block").pivot("phase", phases).agg(F.max("ms"))
    return head.join(wide, ["file", "block"], "left")


def parse_tours(lines: DataFrame, small: bool = False) -> DataFrame:
    """One row per block: filename without folder and ending, max_regular and min_my in microseconds (0 and infinity without such a line)."""
    us = F.regexp_extract("line", r"finished in: (\d+) us", 1).try_cast("bigint")
    regular, mine = F.col("line").contains("Regular eulerian Tour"), F.col("line").contains("My eulerian Tour")
    blocks = log_blocks(lines, small).where("block > 0").groupBy("file", "block")
    full = _field(r"^filename: ?(\S+)", "string")
    out = blocks.agg(full.alias("path"), F.coalesce(F.max(F.when(regular, us)), F.lit(0)).alias("max_regular"), F.coalesce(F.min(F.when(mine, us)).cast("double"), F.lit(float("inf"))).alias("min_my"))
    return out.select("file", "block", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(.)\.[^.]*$", "$1").alias("filename"), "max_regular", "min_my")


def complete(records: DataFrame, columns: tuple[str, ...] = AVERAGE_COLUMNS) -> DataFrame:
    """The records with exactly these columns in this order; missing ones are null."""
    return records.select(*[F.col(f"`{c}`") if c in records.columns else F.lit(None).cast("double").alias(c) for c in columns])


def averages(records: DataFrame, by: tuple[str, ...] = ("filename", "batch_size")) -> DataFrame:
    """Mean of tree_edges_count and total_time per group, rounded to two places; numVertices and numEdges, constant in a group, as they are.

    NaN counts as missing. A null key is a group of its own.
    """
    clean = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
    return records.groupBy(*by).agg(F.min("numVertices").alias("numVertices"), F.min("numEdges").alias("numEdges"), F.round(F.avg(clean("tree_edges_count")), 2).alias("tree_edges_count"), F.round(F.avg(clean("total_time")), 2).alias("total_time"))


def derived_totals(records: DataFrame, sums: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds a column for each entry: the sum of its columns, null where one is."""
    return records.withColumns({name: reduce(lambda a, b: a + b, (F.col(f"`{c}`") for c in cols)) for name, cols in sums.items()})


def merge_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All CSV files below path in one table with ``source_file``; columns are matched by header, so their order may differ."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    return spark.read.option("header", True).schema(schema).option("enforceSchema", False).csv(path).withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)).select(*names, "source_file")
