"""A store of row batches with versions: a bulk append is one transaction.

A store is a folder with ``data`` (a folder of Parquet files for each batch) and ``manifests`` (a small file for each
version, which names the batches that it is made of). An append writes its batches first, where no
reader looks; the version begins when its manifest is renamed into place, which
fails where another writer was first. So readers see whole versions only, a batch that fails leaves the version before, and old
versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import _file_system, discard

#: Attempts of a writer that others are faster than.
TRIES = 20


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that there are, ascending."""
    return sorted(int(n[1:-5]) for n in _names(spark, f"{root}/manifests") if n.startswith("v") and n.endswith(".json"))


def manifest(spark: SparkSession, root: str, version: int) -> list[str]:
    """The batches of a version."""
    fs, path = _file_system(spark, f"{root}/manifests/v{version}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, version: int, batches: list[str]) -> bool:
    """Put a version's manifest in place; false where the version is there already."""
    fs, temporary = _file_system(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    _, final = _file_system(spark, f"{root}/manifests/v{version}.json")
    out = fs.create(temporary)
    out.write(bytearray(json.dumps(batches).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    try:
        context.rename(temporary.makeQualified(fs.getUri(), fs.getWorkingDirectory()), final.makeQualified(fs.getUri(), fs.getWorkingDirectory()), spark.sparkContext._gateway.new_array(option, 0))
        return True
    except Exception:
        fs.delete(temporary, False)
        if fs.exists(final):
            return False
        raise


def bulk_append(spark: SparkSession, root: str, batches: list[DataFrame]) -> int:
    """Append all batches of rows or none; the new version. Rows get one ``appended`` time for the whole append, metadata and tags are null."""
    now, made = datetime.now(UTC).replace(tzinfo=None), []
    try:
        for df in batches:
            made.append(f"b{uuid.uuid4().hex}")
            rows = df.withColumn("appended", F.lit(now).cast("timestamp")).withColumn("metadata", F.lit(None).cast("string")).withColumn("tags", F.lit(None).cast("string"))
            rows.write.parquet(f"{root}/data/{made[-1]}")
        for _ in range(TRIES):
            last = max(versions(spark, root), default=0)
            if _commit(spark, root, last + 1, (manifest(spark, root, last) if last else []) + made):
                return last + 1
        raise RuntimeError(f"{root}: other writers were first {TRIES} times")
    except BaseException:
        discard(spark, *[f"{root}/data/{b}" for b in made])
        raise


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version (the newest one if none is named); None where the store has no rows."""
    known = versions(spark, root)
    batches = manifest(spark, root, known[-1] if version is None else version) if known else []
    return spark.read.parquet(*[f"{root}/data/{b}" for b in batches]) if batches else None
