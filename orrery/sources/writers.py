"""Writers that can be resumed: what is already there is found by an anti-join on its keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def missing(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys `done` doesn't have."""
    return rows.join(done.select(*keys), keys, "left_anti")


def append_missing(spark: SparkSession, rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends to a Parquet log the rows whose keys it doesn't have; rows logged with an error count as done."""
    try:
        rows = missing(rows, spark.read.parquet(path), keys)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.write.mode("append").parquet(path)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table: read if it was written whole before, else made and written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    # Without the marker of a whole write nothing can be read, so a stage that was cut short is made again.
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _shared(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session that names none gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """`df` checkpointed, for tables that several steps read."""
    _shared(df.sparkSession)
    return df.checkpoint()


def results(rows: DataFrame, path: str, by: str = "dataset") -> None:
    """A tall table of results, a folder for each dataset."""
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def documents_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nested columns as nested objects."""
    rows.write.mode("overwrite").json(path)


def write_checked(rows: DataFrame, path: str, checks: dict[str, Column]) -> None:
    """Writes `rows` as Parquet to `path`, which must not be there yet, if all checks hold; else raises ValueError and leaves nothing.

    checks: name and aggregate that must be true. They are observed while the rows are written, so rows are made once; the table gets
    its name only then. Of no rows most aggregates are null, which counts as a failed check.
    """
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    staged, goal = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path.rstrip('/')}-{uuid.uuid4().hex}", path))
    system = goal.getFileSystem(conf)
    if system.exists(goal):
        raise ValueError(f"{path} is there already")
    seen = Observation(f"checks-{uuid.uuid4().hex}")
    try:
        rows.observe(seen, *[check.alias(f"c{i}") for i, check in enumerate(checks.values())]).write.parquet(staged.toString())
        failed = [name for i, name in enumerate(checks) if seen.get[f"c{i}"] is not True]
        if failed:
            raise ValueError(f"{path} isn't written, checks failed: {', '.join(failed)}")
        if not system.rename(staged, goal):
            raise OSError(f"{path} can't be named")
    finally:
        system.delete(staged, True)
