"""The folded memories as a table bucketed by scope, kept up to date by bucket (A2, A3).

A row's partition is its scope's bucket, and the files are bucketed by the same hash, so each partition holds one bucket: readers that join
or rank by scope read it without an exchange, and a refresh reads and overwrites the partitions that new log rows touch and no others.

Log rows come in the order of ``seq``: a row of a refresh is newer than all that was folded into its key before (a tombstone needs no
place in the table then). What a refresh folds is written aside first and then moved over its partitions, each as a whole, so a refresh that
fails can be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import l2norm
from ..session import materialize, scratch_path
from .log import fold_log

BUCKETS = 64


def bucket_of(scope, buckets: int):
    """Spark's own bucket number of a scope."""
    return F.pmod(F.hash(scope), F.lit(buckets)).cast("int")


class MemoryStore:
    """``scope_id, seq, <payload>, norm, bucket`` under a table name of the session."""

    def __init__(self, spark: SparkSession, name: str, buckets: int):
        self.spark, self.name, self.buckets = spark, name, buckets

    @classmethod
    def create(cls, memories: DataFrame, name: str, buckets: int = BUCKETS, path: str | None = None) -> "MemoryStore":
        """Store folded memories (``fold_log``'s rows) as a new table at ``path`` (a folder of its own under the shared one if not given)."""
        spark = memories.sparkSession
        store = cls(spark, name, buckets)
        (store._shaped(memories).repartition(buckets, "scope_id").write.partitionBy("bucket").bucketBy(buckets, "scope_id").sortBy("scope_id")
         .option("path", path or scratch_path(spark, name)).format("parquet").mode("errorifexists").saveAsTable(name))
        return store

    def _shaped(self, rows: DataFrame) -> DataFrame:
        rows = rows.drop("norm", "bucket", "op")
        if "embedding" in rows.columns:
            rows = rows.withColumn("norm", l2norm("embedding"))
        return rows.withColumn("bucket", bucket_of("scope_id", self.buckets))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def refresh(self, log_rows: DataFrame) -> list[int]:
        """Fold new log rows (``scope_id, id, seq, op, payload``) into the table; returns the buckets that were rewritten."""
        spark = self.spark
        new = materialize(log_rows.withColumn("bucket", bucket_of("scope_id", self.buckets)), "log-rows")
        touched = [r[0] for r in new.select("bucket").distinct().orderBy("bucket").collect()]       # at most ``buckets`` numbers
        if not touched:
            return []
        old = self.read().where(F.col("bucket").isin(touched)).drop("norm", "bucket").withColumn("op", F.lit("upsert"))
        folded = self._shaped(fold_log(old.unionByName(new.drop("bucket"), allowMissingColumns=True).select(*old.columns)))
        columns = self.read().columns
        folded = materialize(folded.select(*columns), "folded")
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")         # the table's own partitions stay, but for those that are written
        try:
            folded.repartition(self.buckets, "scope_id").write.insertInto(self.name, overwrite=True)
        finally:
            spark.conf.set(mode, before)
        kept = {r[0] for r in folded.select("bucket").distinct().collect()}
        for b in touched:                       # a bucket whose last memory went away gives no file to overwrite it with
            if b not in kept:
                spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (bucket = {b})")
                _delete(spark, f"{self.location()}/bucket={b}")
        spark.catalog.refreshTable(self.name)
        return touched

    def location(self) -> str:
        rows = self.spark.sql(f"DESCRIBE FORMATTED {self.name}").where("col_name = 'Location'").collect()
        return rows[0]["data_type"]

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
