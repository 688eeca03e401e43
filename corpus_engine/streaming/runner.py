"""Run streams to the end of the available data, with durable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.runtime import scratch_path


def read_stream(spark: SparkSession, directory: str, name: str, bytes_per_batch: int = 1 << 30) -> DataFrame:
    """A table as a file stream, with the schema of its present files.

    The batch limit also bounds what one key can bring to a stateful operator at
    a time.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{directory.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", bytes_per_batch)
    # a pattern, because the file source takes a plain path for a folder
    path = f"{path[:-1]}[t]"
    df = reader.parquet(path)
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Append results to a file sink (exactly once) and read them back."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, f"{name}-checkpoint"))
        .option("path", out)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_update(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Write each batch of updates under its number; the last one per key counts.

    A batch that is repeated after a failure overwrites its own folder.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    query = (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", scratch_path(spark, f"{name}-checkpoint"))
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    return (
        spark.read.parquet(out)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
        .select(*keys, "_r.*")
    )
