"""Session-level helpers: durable checkpoints, scratch locations, salting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def configure(spark: SparkSession) -> None:
    """Settings that the operators rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Without one, a
    session that runs in a single process gets a private folder; on a cluster a
    machine-local folder would lose parts, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="corpus-engine-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The copy survives the loss of any executor, unlike cached blocks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Hand texts to Python in batches of about this size, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def many_files(spark: SparkSession, tasks: int) -> Iterator[None]:
    """A folder of many small files that is listed and read herein costs the driver little.

    Spark counts a small file as 4 MB, so they would become almost as many tasks, of each
    of which the driver keeps a record; a scan has about ``tasks`` at most. And it would
    keep the list of every folder, up to some hundred MB, in case it is read again.
    """
    wanted = {"spark.sql.files.maxPartitionNum": str(tasks), "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def top_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    rank_name: str = "rn",
) -> DataFrame:
    """First ``n`` rows per key group, with their 1-based rank.

    Each map task cuts its part of a group to ``n`` rows (WindowGroupLimit), so a
    group of any size is safe. Spark makes that cut only below a configured ``n``,
    which is raised here so that every ``n`` has the same plan.
    """
    conf, name = df.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    if n >= int(conf.get(name)):
        conf.set(name, str(n + 1))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(window)).filter(F.col(rank_name) <= n)
