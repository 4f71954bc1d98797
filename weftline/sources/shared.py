"""Cutting lineage in iterations: reliable checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark drops the shuffle files of a query when that ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset in local
    mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="weftline-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def laid(df: DataFrame, name: str = "laid") -> DataFrame:
    """``df`` written to the shared folder and reread.

    For long iterations: a checkpoint hands on what the planner has inferred of its columns, which then grows from round to
    round; a table that is read knows nothing but its files. They are compressed, and the shuffles that made them go at once.
    Joins with them are by sorting: broadcasts of small tables would go through the driver anew in every round.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path).hint("merge")
