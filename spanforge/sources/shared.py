"""Tables that are written once in the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one if Spark runs in this process alone, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.spanforge.shared", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.spanforge.shared", folder)
    return folder


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what several steps read is worked out once, and a lost executor costs its own tasks alone."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
