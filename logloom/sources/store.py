"""A table of latest rows by key that is merged when it is read: writes add files, nothing is rewritten but by compact()."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LatestTable:
    """Rows by key in Parquet files below path, in folders by version, merged or not, `by` and bucket of the key.

    `by` names columns of dates or numbers that a row's key determines (the event day, where ids are made of the line),
    for filters to prune folders; a key that changes them becomes two rows. Rows of equal keys: those of the later version
    win, within a version those of the highest `order` (ties: any one of them, the same at every reading). Null keys are
    one key. The columns version, merged and bucket are the table's own. The number of buckets must stay the same for a
    path.
    """

    path: str
    key: str = "id"
    order: str = "seq"
    by: tuple[str, ...] = ()
    buckets: int = 256

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str, mode: str) -> None:
        # rebalancing gives a bucket's rows to few files, and splits buckets that are large
        rows.hint("rebalance", *self.by, "bucket").write.mode(mode).partitionBy(*self.by, "bucket").parquet(f"{self.path}/{folder}")

    def _newest(self, rows: DataFrame, rank: Column, columns: list[str]) -> DataFrame:
        groups = [*self.by, "bucket", self.key]
        rest = [c for c in columns if c not in groups]
        best = rows.groupBy(*groups).agg(F.max_by(F.struct(*rest), rank).alias("row"))
        return best.select(*[c if c in groups else F.col("row")[c].alias(c) for c in columns], *(["bucket"] if "bucket" not in columns else []))

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.path).option("mergeSchema", True).parquet(self.path)

    def upsert(self, rows: DataFrame, version: int) -> None:
        """Adds a version; versions grow. Writing the newest one again replaces it, as a stream does with a batch after a failure."""
        columns = rows.columns
        self._write(self._newest(rows.withColumn("bucket", self._bucket()), F.col(self.order), columns), f"version={version}/merged=0", "overwrite")

    def read(self, spark: SparkSession) -> DataFrame:
        """The latest row of each key. Filters on `by` and on the key's bucket reach the folders, those on the key the files."""
        return self._latest(self._stored(spark))

    def _latest(self, stored: DataFrame) -> DataFrame:
        columns = [c for c in stored.columns if c not in ("version", "merged", "bucket")]
        return self._newest(stored, F.struct("version", "merged", self.order), columns).drop("bucket")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The latest rows of some keys; reads their buckets alone, of which there are no more than self.buckets."""
        asked = keys.select(self.key).distinct()
        touched = [r[0] for r in asked.select(self._bucket()).distinct().collect()]
        stored = self._stored(keys.sparkSession).where(F.col("bucket").isin(touched))
        # folders first, then keys: equal nulls meet as well
        other = asked.withColumnRenamed(self.key, "asked_key")
        return self._latest(stored.join(other, F.col(self.key).eqNullSafe(F.col("asked_key")), "left_semi"))

    def compact(self, spark: SparkSession, most: int = 8) -> int:
        """Merges buckets (of a `by`) that stand in more than `most` folders and removes what was merged; returns the number
        of files that went.

        Merged rows are added under the newest version, so what is added meanwhile wins over them. A failure
        between the steps leaves rows twice, which reading merges. Readers that are under way lose their files: run it
        when none are. Only names of buckets and files pass the driver.
        """
        stored = self._stored(spark)
        groups = [*self.by, "bucket"]
        full = stored.groupBy(*groups).agg(F.count_distinct("version", "merged").alias("n"), F.max("version").alias("newest")).where(F.col("n") > most)
        found = full.agg(F.collect_set("bucket"), F.max("newest")).first()
        if not found[0]:
            return 0
        small = full.select(*[F.col(c).alias(f"full_{c}") for c in groups])
        same = F.lit(True)
        for c in groups:
            same &= F.col(c).eqNullSafe(F.col(f"full_{c}"))
        rows = stored.where(F.col("bucket").isin(found[0])).join(small, same, "left_semi")
        old = [r[0] for r in rows.select("_metadata.file_path").distinct().collect()]
        columns = [c for c in stored.columns if c not in ("version", "merged", "bucket")]
        merged = self._newest(rows, F.struct("version", "merged", self.order), columns)
        self._write(merged, f"version={found[1]}/merged=1", "append")
        for name in old:
            file = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
            file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False)
        return len(old)
