"""What the operators need from the session: a reliable checkpoint folder and the package on the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoint(). The session's ``spark.checkpoint.dir`` wins; a temporary folder is made
    only in local mode, where driver and executor share one machine. On a cluster without the setting this raises."""
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sparkforest-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per application; in local mode the workers are told where it lies."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if sc.master.startswith("local[") or sc.master == "local":
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, sc.environment.get("PYTHONPATH")) if x)
        _SHIPPED.add(sc.applicationId)
        return
    folder = tempfile.mkdtemp(prefix="sparkforest-zip-")
    bare = os.path.join(folder, "stage")
    shutil.copytree(os.path.join(root, "sparkforest"), os.path.join(bare, "sparkforest"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "sparkforest_pkg"), "zip", bare))
    _SHIPPED.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written as a table into the shared folder and read from there, so that a lost executor
    costs no recomputation of earlier rounds.

    With checkpoint() the rounds of a loop were seen to take ever longer on ever fewer rows, probably since it hands the estimated
    sizes and constraints of its plan on to the next. A table's size is that of its files.
    """
    return cut_counted(df)[0]


def cut_counted(df: DataFrame, **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut, and in the same job the number of rows, as ``rows``, and of the rows that meet each condition."""
    at = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    seen = Observation()
    marks = [F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in conditions.items()]]
    df.observe(seen, *marks).write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out, {name: int(n or 0) for name, n in seen.get.items()}


def forget(*dfs: DataFrame) -> None:
    """Deletes the files of tables made by cut or cut_counted; no table still in use may have been derived from them."""
    for df in dfs:
        at = getattr(df, "_written_at", None)
        if at is not None:
            _delete(df.sparkSession, at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_FOLDERS: dict[str, str] = {}


def _tables(spark: SparkSession) -> str:
    """The application's own folder of written tables; it is deleted when the interpreter ends, if Spark is still running."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        at = _FOLDERS[app] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables"

        def drop() -> None:
            # The JVM may be gone by then, and its folder with it.
            with suppress(Exception):
                if spark.sparkContext._jsc is not None:
                    _delete(spark, at)

        atexit.register(drop)
    return _FOLDERS[app]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
