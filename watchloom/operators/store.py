"""Snapshots, upserts, audit rows, content signatures."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by ``order`` (nulls first).  A hash aggregate, so hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order and _orderable(df, c)])).alias("_last"))
    return last.select(*key, *[F.col("_last").getField(c).alias(c) for c in rest])


def _orderable(df: DataFrame, c: str) -> bool:
    return "map" not in df.schema[c].dataType.simpleString() and "variant" not in df.schema[c].dataType.simpleString()


def content_signature(df: DataFrame, by: list[str], id_col: str = "id") -> DataFrame:
    """SHA-256 of the sorted distinct ids of each group, joined by ``|``.  A group is one feed, bounded by its publisher."""
    return df.filter(F.col(id_col).isNotNull()).groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(id_col)), "|"), 256).alias("signature"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, file_hash (SHA-256 of the content) of every file below a folder; a file is read by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("file_hash"))


def quality_flag(n: Column, least: Column) -> Column:
    return F.when(n < least, F.lit("low")).otherwise(F.lit("ok"))


class SnapshotStore:
    """Versioned Parquet snapshots behind a pointer file that is flipped by an atomic rename."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):  # noqa: ANN202
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def publish(self, df: DataFrame, partition_by: str | None = "source") -> str | None:
        """Write a new version and make it current; an empty table keeps the old one and returns None."""
        version = uuid.uuid4().hex
        path = f"{self.root}/v-{version}"
        w = df.write
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        if self.spark.read.schema(df.schema).parquet(path).isEmpty():
            return None
        fs, tmp = self._fs(f"{self.root}/CURRENT.{version}")
        out = fs.create(tmp)
        out.write(bytearray(version.encode()))
        out.close()
        _, cur = self._fs(f"{self.root}/CURRENT")
        ctx = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(cur.toUri(), self.spark._jsc.hadoopConfiguration())
        opts = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        opts[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        ctx.rename(tmp, cur, opts)
        return version

    def current(self) -> DataFrame:
        rows = self.spark.read.text(f"{self.root}/CURRENT").head(1)
        return self.spark.read.parquet(f"{self.root}/v-{rows[0][0]}")


def append_audit(df: DataFrame, path: str) -> None:
    """Append screenings to the audit table, partitioned by day."""
    df.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def upsert_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest row of every source of both tables."""
    return last_wins(old.unionByName(new), ["source"], ["last_fetched"])
