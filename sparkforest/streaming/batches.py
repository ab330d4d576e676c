"""A stream of edge operations applied to a versioned forest, each batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from sparkforest.plans.context import cut
from sparkforest.state import ForestState

OPERATIONS = "batch_id bigint, op string, u bigint, v bigint"
MAX_BATCHES = 10_000


class ForestStore:
    """Versions of a forest below a path. ``applied`` records which batch made which version; it is written last, so a
    version that a lost driver left half done is written over."""

    def __init__(self, spark: SparkSession, path: str, **how) -> None:
        self.spark, self.path, self.how = spark, path, how

    def applied(self) -> DataFrame:
        try:
            return self.spark.read.schema("batch_id bigint, op string, version int").parquet(f"{self.path}/applied")
        except AnalysisException:
            return self.spark.createDataFrame([], "batch_id bigint, op string, version int")

    def start(self, state: ForestState) -> None:
        state.save(self.path)

    def latest(self) -> ForestState:
        version = self.applied().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        return ForestState.load(self.spark, self.path, version, **self.how)

    def apply(self, rows: DataFrame, _epoch: int = 0) -> None:
        """Applies the batches of ``rows`` (OPERATIONS) in ascending order, deletions of a batch before its insertions.

        A batch applied before is passed over, so a micro-batch may be delivered twice. Rows with a null are left out.
        """
        good = cut(rows.where("batch_id is not null and u is not null and v is not null and op in ('delete', 'insert')").select("batch_id", "op", "u", "v"))  # read once a micro-batch
        todo = good.select("batch_id", "op").distinct().join(F.broadcast(self.applied().select("batch_id", "op")), ["batch_id", "op"], "left_anti")
        steps = [tuple(r) for r in todo.orderBy("batch_id", "op").limit(MAX_BATCHES + 1).collect()]  # names of batches, no edges
        if len(steps) > MAX_BATCHES:
            raise ValueError(f"more than {MAX_BATCHES} batches at once: limit the source's files per trigger")
        for batch_id, op in steps:
            state = self.latest()
            edges = good.where((F.col("batch_id") == batch_id) & (F.col("op") == op)).select("u", "v")
            new = state.delete(edges) if op == "delete" else state.insert(edges)
            new.save(self.path, state)
            self.spark.createDataFrame([(batch_id, op, new.version)], "batch_id bigint, op string, version int").coalesce(1).write.mode("append").parquet(f"{self.path}/applied")


def run_stream(stream: DataFrame, store: ForestStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the query that keeps the store up to date. With available_now it ends when the source is drained."""
    writer = stream.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
