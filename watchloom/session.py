"""Session helpers: table loading, intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "watchloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; keywords override (``_`` stands for ``.``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, one of our own, on a local master only."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = getattr(spark.sparkContext, "_watchloom_dir", None)
        if not d:
            d = "file://" + tempfile.mkdtemp(prefix="watchloom-")
            spark.sparkContext._watchloom_dir = d  # type: ignore[attr-defined]
    return d.rstrip("/")


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors, keeps the data
    compressed, and gives the planner true sizes.  The table is removed when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/watchloom/{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_watchloom_shipped", False):
        return
    import os
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="watchloom-code-"), "watchloom_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for d, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.join("watchloom", os.path.relpath(p, root)))
    sc.addPyFile(target)
    sc._watchloom_shipped = True  # type: ignore[attr-defined]
