"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where it is unset and Spark runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ripplemill-")
        spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return str(folder).rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table of the shared folder: computed once, and the plan behind it ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows, and bytes of a shuffle, that one task is dealt in ``finely_dealt``.
TASK_ROWS, TASK_BYTES = 50_000, 4 << 20


@contextmanager
def finely_dealt(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside deals its shuffles of about so many rows to a number of tasks that grows with them, so that no task's memory does."""
    wanted = {"spark.sql.shuffle.partitions": max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{TASK_BYTES}b"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
