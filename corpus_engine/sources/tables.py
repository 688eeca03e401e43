"""Parquet table scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.runtime import configure

SPREAD_BYTES = 128 << 20


def load_table(
    spark: SparkSession,
    directory: str,
    name: str,
    columns: list[str] | None = None,
    where: Column | None = None,
    spread: bool = False,
) -> DataFrame:
    """Scan one table; the row filter and the column list reach the Parquet reader.

    Zone-less timestamps are read as UTC instants. ``spread`` is for work that
    costs far more than the scan: see :func:`spread_small`.
    """
    configure(spark)
    df = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    if where is not None:
        df = df.filter(where)
    if columns is not None:
        df = df.select(*columns)
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return spread_small(df) if spread else df


def spread_small(df: DataFrame) -> DataFrame:
    """Deal a table of at most ``SPREAD_BYTES`` out to every core.

    A small file may be a single row group, which one task would read and work on
    alone. The bound is on bytes, not on cores: what is moved never exceeds it, and
    larger tables come back as they are on a cluster of any size.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def union_versions(*versions: DataFrame) -> DataFrame:
    """Stack table versions whose later ones have gained columns."""
    out = versions[0]
    for df in versions[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
