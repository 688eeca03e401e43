"""Tables kept in buckets of a key, of which a batch reads and rewrites only its own.

``<sink>/<table>/batch=N/bucket=B`` holds what batch N wrote for bucket B. A state
table's bucket is written whole, so its present rows lie in one folder, named by the
snapshot of the last finished batch under ``<sink>/versions``. The snapshot is written
last: a batch that fails leaves no trace, and one that is repeated starts from the
snapshot before it and overwrites its own folders. What a batch reads thus depends on
the present rows of its buckets, not on the number of batches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new sink; the number is kept in its snapshots.
BUCKETS = 64
#: Snapshots that stay readable.
KEEP = 2

_SNAPSHOT = "name string, bucket int, version bigint"


def _folder(spark: SparkSession, path: str):
    """A folder and its file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _children(spark: SparkSession, path: str) -> dict[int, str]:
    """Numbered sub-folders such as ``batch=3``."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return {}
    names = (status.getPath().getName() for status in fs.listStatus(folder))
    return {int(name.split("=")[1]): f"{path}/{name}" for name in names if "=" in name}


class Sink:
    """A folder of bucketed tables as of the snapshot before a batch."""

    def __init__(self, spark: SparkSession, path: str, before: int | None = None, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        done = [n for n in _children(spark, f"{path}/versions") if before is None or n < before]
        self.versions: dict[str, dict[int, int]] = {}
        self.buckets = buckets
        if done:
            rows = spark.read.schema(_SNAPSHOT).parquet(f"{path}/versions/batch={max(done)}").collect()  # a row per bucket
            for name, bucket, version in rows:
                if name == "":
                    self.buckets = bucket
                else:
                    self.versions.setdefault(name, {})[bucket] = version

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame, key: str) -> list[int]:
        """The buckets of a frame's keys, at most as many as the sink has."""
        return sorted(r.b for r in df.select(self.bucket(F.col(key)).alias("b")).distinct().collect())

    def read(self, name: str, schema: str, only: list[int] | None = None) -> DataFrame:
        """The present rows of a state table, in some buckets or all."""
        held = self.versions.get(name, {})
        folders = [f"{v}/{b}" for b, v in held.items() if only is None or b in set(only)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.all_batches(name, schema)
        return rows.filter(F.concat_ws("/", "batch", "bucket").isin(folders)).drop("batch", "bucket")

    def all_batches(self, name: str, schema: str) -> DataFrame:
        """Every row that any batch wrote to a table, with ``batch`` and ``bucket``."""
        return self.spark.read.schema(f"{schema}, batch bigint, bucket int").parquet(f"{self.path}/{name}")

    def write(self, df: DataFrame, name: str, batch: int, key: str) -> None:
        """Write a batch's rows of a table; large buckets are split over several files."""
        rows = df.withColumn("bucket", self.bucket(F.col(key))).hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={batch}")

    def commit(self, batch: int, states: list[str], touched: list[int]) -> None:
        """Make the batch's version of the touched buckets the present one."""
        for name in states:
            self.versions.setdefault(name, {}).update(dict.fromkeys(touched, batch))
        rows = [("", self.buckets, batch)]
        rows += [(name, b, v) for name, held in self.versions.items() for b, v in held.items()]
        frame = self.spark.createDataFrame(rows, _SNAPSHOT).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/versions/batch={batch}")

    def expire(self, states: list[str], keep: int = KEEP) -> int:
        """Delete snapshots but the last ``keep``, and state folders that none of them names."""
        snapshots = _children(self.spark, f"{self.path}/versions")
        named = {name: set() for name in states}
        for n in sorted(snapshots)[-keep:]:
            for name, bucket, version in self.spark.read.schema(_SNAPSHOT).parquet(snapshots[n]).collect():
                if name in named:
                    named[name].add((version, bucket))
        doomed = [snapshots[n] for n in sorted(snapshots)[:-keep]]
        for name in states:
            for version, path in _children(self.spark, f"{self.path}/{name}").items():
                inside = _children(self.spark, path)
                old = [p for b, p in inside.items() if (version, b) not in named[name]]
                doomed += [path] if len(old) == len(inside) and version < max(snapshots, default=0) else old
        return sum(self._delete(path) for path in doomed)

    def drop_before(self, name: str, batch: int) -> int:
        """Delete what earlier batches wrote to a table."""
        held = _children(self.spark, f"{self.path}/{name}")
        return sum(self._delete(path) for n, path in held.items() if n < batch)

    def _delete(self, path: str) -> bool:
        fs, folder = _folder(self.spark, path)
        return bool(fs.delete(folder, True))
