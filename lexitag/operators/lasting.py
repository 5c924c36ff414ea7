"""Keep a reused intermediate result so that it is computed once and survives lost executors."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


_kept: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="lexitag-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once below the checkpoint folder and go on from the written table.

    Unlike a plain checkpoint the table is columnar and compressed: its readers take only the
    columns they need, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/kept-{uuid4().hex}"
    df.write.parquet(path)
    _kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete the tables kept so far. Results that are not written or collected yet are lost."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while _kept:
        path = hadoop(_kept.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
