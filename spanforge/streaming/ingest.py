"""Ingest of judge responses as a stream, effectively once per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Parts of the table by a hash of the key, of which a batch reads those that its own keys fall in.
PARTS = 64


def ingest_responses(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, keys: tuple[str, ...] = ("candidate_id", "version"),
                     time_col: str = "ingest_ts") -> StreamingQuery:
    """Read appended JSON lines once each and append the responses with new keys to the Parquet table.

    The table itself is the state: of a batch's rows of one key the earliest is taken, if an anti-join with the table's parts that
    the batch's keys fall in doesn't find the key. So a new key is kept however late it comes, and nothing is lost to a watermark. Batch ids make a
    repeated batch write its folder anew, without regard to what that held. The query handles all that is there and stops.
    """
    rows = spark.readStream.schema(schema).json(source)
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")
    # the table is there before the first batch, without rows
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{table}/batch=-1/part=0")

    def append(batch: DataFrame, number: int) -> None:
        first = F.min(F.struct(time_col, *(c for c in batch.columns if c != time_col))).alias("r")
        own = batch.groupBy(*keys).agg(first).select("r.*").select(*batch.columns).withColumn("part", part)
        parts = [r.part for r in own.select("part").distinct().collect()]
        known = batch.sparkSession.read.parquet(table).where((F.col("batch") != number) & F.col("part").isin(parts)).select(*keys).distinct()
        same = [own[k].eqNullSafe(known[k]) for k in keys]
        own.join(known, same, "left_anti").write.mode("overwrite").partitionBy("part").parquet(f"{table}/batch={number}")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
