"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or else the checkpoint directory already set; in neither case (tests) a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        held = context._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
            held = context._jsc.sc().getCheckpointDir()
        folder = held.get()
    return str(folder).rstrip("/")


def store(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: it is computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewater-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that store() returned; what was made from it must be written by then."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
