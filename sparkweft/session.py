"""Session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local default only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file:///tmp/checkpoints"
    return found.rstrip("/")


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: merged, never sent to every task because its files or shuffled blocks look small."""
    return df.hint("merge")


def dealt(df: DataFrame, rows: int, *keys, each: int = 200_000) -> DataFrame:
    """Dealt out by key to as many tasks as keep about so many of the ``rows`` in each, where that is more than one."""
    return df.repartition(-(-rows // each), *keys) if rows > each else df


def kept(df: DataFrame) -> DataFrame:
    """A large table that is read more than once, in columns and compressed, in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder named by spark.checkpoint.dir."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
