"""Readers of tables, and scratch tables in a shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over the cores where its files make so few splits that most cores would idle.

    A file with one row group is one task, however many cores there are. Tables with as many splits as
    half the cores or more, as all large ones have, are left as they are: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under the shared checkpoint folder of the session; it goes when the driver ends.

    The cluster names that folder in spark.checkpoint.dir. Only where it is unset
    (tests on one machine) a folder under the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    top = f"{base.rstrip('/')}/cairn-{uuid.uuid4().hex}"
    fs, path = _file_system(spark, top)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return top


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for p in paths:
        fs, path = _file_system(spark, p)
        fs.delete(path, True)


#: Makes Spark delete a write's shuffle files when it is done, for nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet in a shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
