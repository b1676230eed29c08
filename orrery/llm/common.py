"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read where Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key: str | Column, modulus: int) -> Column:
    """crc32 of the key's text, modulo `modulus`: the fold rule that every learner here uses (null for a null key)."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string").cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the cluster names it.

    A local session that names none (tests) gets a temporary one, and then keeps it; on a cluster that is an error, since no
    executor could read what another wrote.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: cuts the lineage and survives a lost executor.

    The table stands in for what was shuffled to make it, so those files go when it is written, not when the driver happens to
    collect garbage. arrow_rows: how many rows go to Python at a time, where they are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before, wanted = {SHUFFLE_CLEANUP: spark.conf.get(SHUFFLE_CLEANUP, "false")}, {SHUFFLE_CLEANUP: "true"}
    if arrow_rows:
        before[ARROW_ROWS], wanted[ARROW_ROWS] = spark.conf.get(ARROW_ROWS), str(arrow_rows)
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that `written` made and nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def partitions_for(df_rows: int, rows_each: int, least: int = 1) -> int:
    """How many partitions hold `df_rows` rows at about `rows_each` rows a partition."""
    return max(least, -(-df_rows // rows_each))
