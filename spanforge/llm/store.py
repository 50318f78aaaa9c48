"""Tables written between the steps of an operator, in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one if Spark runs in this process alone, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.spanforge.scratch", None)
    if not folder and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.spanforge.scratch", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in a folder for each value of the columns ``by``, and read it back.

    This cuts the lineage: a lost executor costs the tasks that it ran, not the
    steps before, and every later reader sees the same rows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`save` that no plan reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        conf = table.sparkSession._jsc.hadoopConfiguration()
        for parent in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of finished steps, which it does when it collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()
