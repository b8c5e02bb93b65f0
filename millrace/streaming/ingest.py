"""Incremental ingest by Structured Streaming: an extension, as a corpus that grows needs one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "text") -> None:
    """Append to `target` each new Parquet file's rows whose key is new, and stop when all files there now are read.

    Of a batch's rows of one key the smallest doc_id stays; rows whose key's hash is in `target` already go, by an anti
    join on hashes. A batch is written under its number, so one that runs again after a failure replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        own = batch.withColumn("key_hash", F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256))
        own = own.groupBy("key_hash").agg(F.min_by(F.struct(*batch.columns), "doc_id").alias("r")).select("r.*", "key_hash")
        if number:
            seen = spark.read.schema("key_hash string, batch long").parquet(target).filter(F.col("batch") < number).select("key_hash")
            own = own.join(seen, "key_hash", "left_anti")
        own.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
