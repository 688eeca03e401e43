"""Tables stored by site hash, of which only the touched parts are rewritten."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.operators.incremental import full_refresh, upsert_pages
from corpus_engine.runtime import durable

BUCKETS = 64


@dataclass(frozen=True)
class SiteTable:
    """A Parquet table in folders ``bucket=B`` of the hash of its site column."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    site: str = "agent_id"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.site), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """Write the whole table; a site's rows may fill several files of its folder."""
        self._write(rows.withColumn("bucket", self._bucket()))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or the folders of some buckets only."""
        rows = self.spark.read.parquet(self.path)
        return (rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))).drop("bucket")

    def touched(self, sites: DataFrame) -> list[int]:
        """The buckets of some sites; at most as many numbers as there are buckets."""
        return sorted(r.b for r in sites.select(self._bucket().alias("b")).distinct().collect())

    def rewrite(self, sites: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the folders of these sites by what ``change`` makes of their rows.

        The new rows are finished in the shared folder before any old file goes, so a
        failure before that changes nothing, and the overwrite after it only copies.
        """
        buckets = self.touched(sites)
        if not buckets:
            return []
        new = durable(change(self.read(buckets)).withColumn("bucket", self._bucket()))
        left = {r.bucket for r in new.select("bucket").distinct().collect()}
        if not left <= set(buckets):
            raise ValueError("a change must not move rows to other sites")
        self._write(new)
        for bucket in set(buckets) - left:  # dynamic overwrite leaves folders without new rows alone
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return buckets

    def upsert(self, changes: DataFrame) -> list[int]:
        """Apply crawled, failed and skipped pages; see :func:`upsert_pages`."""
        return self.rewrite(changes, lambda rows: upsert_pages(rows, changes))

    def drop_sites(self, sites: DataFrame) -> list[int]:
        """Remove all rows of some sites."""
        return self.rewrite(sites, lambda rows: full_refresh(rows, sites))

    def _write(self, rows: DataFrame) -> None:
        (
            rows.hint("rebalance", "bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket")
            .parquet(self.path)
        )
