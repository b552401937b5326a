import pytest
from pyspark.sql import functions as F

from cairn.sources import versions


def rows(spark, a, b):
    return spark.range(a, b).select(F.col("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(3)


def test_all_or_nothing(spark, tmp_path):
    """A batch that fails in the middle leaves the version before it, and no files."""
    root = f"file://{tmp_path}/store"
    assert versions.versions(spark, root) == [] and versions.read(spark, root) is None
    assert versions.bulk_append(spark, root, [rows(spark, 0, 10), rows(spark, 10, 15)]) == 1
    first = versions.read(spark, root)
    assert first.count() == 15 and first.select("appended").distinct().count() == 1 and first.where("metadata is null and tags is null").count() == 15
    bad = rows(spark, 20, 30).withColumn("text", F.when(F.col("id") == 27, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    before = sorted(p.name for p in (tmp_path / "store/data").iterdir())
    with pytest.raises(Exception, match="no"):
        versions.bulk_append(spark, root, [rows(spark, 15, 20), bad])
    assert versions.versions(spark, root) == [1] and versions.read(spark, root).count() == 15
    assert sorted(p.name for p in (tmp_path / "store/data").iterdir()) == before
    assert versions.bulk_append(spark, root, [rows(spark, 15, 20)]) == 2
    assert versions.read(spark, root).count() == 20 and versions.read(spark, root, 1).count() == 15


def test_another_writer_first(spark, tmp_path, monkeypatch):
    """The slower of two writers goes on from what the faster one committed."""
    root = f"file://{tmp_path}/store"
    versions.bulk_append(spark, root, [rows(spark, 0, 3)])
    commit, other = versions._commit, []

    def late(*args):
        if not other:
            other.append(True)
            versions.bulk_append(spark, root, [rows(spark, 100, 104)])
        return commit(*args)

    monkeypatch.setattr(versions, "_commit", late)
    assert versions.bulk_append(spark, root, [rows(spark, 3, 5)]) == 3
    assert versions.versions(spark, root) == [1, 2, 3] and versions.read(spark, root).count() == 9 and versions.read(spark, root, 2).count() == 7
    assert not [p for p in (tmp_path / "store/manifests").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
