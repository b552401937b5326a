"""The memory table: filters by source, appends, deletes, first occurrences, statistics.

A memory row has id, text, source ("kind:name", null as empty) and further columns. All
functions take and return DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch_dir, stored

# fixed values: sources that knowledge comes from, and those of echoes of the conversation
CORPUS = ("wikipedia:", "user_taught", "wisdom:", "legacy:", "url:", "code:")
ECHOES = ("user_msg", "agent_response", "conversation_turn", "image:", "video:")


def _starts(source: Column, prefixes) -> Column:
    source = F.coalesce(source, F.lit(""))
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(source, F.lit(p))
    return out


def corpus(rows: DataFrame) -> DataFrame:
    return rows.where(_starts(F.col("source"), CORPUS))


def without_echoes(rows: DataFrame) -> DataFrame:
    return rows.where(~_starts(F.col("source"), ECHOES))


def kind(source: Column) -> Column:
    return F.substring_index(source, ":", 1)


def by_kind(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a kind, with the rest of the source as path."""
    return rows.where(F.startswith("source", F.lit(f"{name}:"))).withColumn("path", F.split("source", ":", 2)[1])


def prefix_search(rows: DataFrame, col: str, prefix: str, n: int) -> DataFrame:
    return rows.where(F.startswith(col, F.lit(prefix))).select(col).distinct().orderBy(col).limit(n)


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows of a key meet by a hash, and only one goes on from each part."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_r"))
    return first.select("_r.*")


def not_stored(rows: DataFrame, stored: DataFrame, col: str) -> DataFrame:
    """Rows with a text that the stored rows don't have."""
    return rows.where(F.col(col).isNotNull()).join(stored.select(col).where(F.col(col).isNotNull()), col, "left_anti")


def delete_ids(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows left, and those deleted (for a cascade to what they point at)."""
    return rows.join(ids, "id", "left_anti"), rows.join(ids, "id", "left_semi")


def with_new_ids(rows: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """new with ids that go on after the largest of rows, in the given order.

    Rows are range-partitioned by the order, numbered inside their partition, and shifted by
    the partitions before, so no single task sees all of them. They are written before the partitions
    are counted: made a second time, the ranges would be drawn and joined up anew, with other sizes.
    """
    spark = new.sparkSession
    last = rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    placed = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed, f"{scratch_dir(spark)}/placed")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("part")).count().collect()}  # one row for each partition
    before, shift = 0, []
    for k in sorted(sizes):
        shift += [F.lit(k), F.lit(before)]
        before += sizes[k]
    offset = F.create_map(*shift)[part] if shift else F.lit(0)
    return placed.withColumn("id", (F.lit(last) + offset + place + 1).cast("long")).drop("_at")


def supersede(rows: DataFrame, slot: list[str], order: list[str]) -> DataFrame:
    """rows with superseded: true for all but the latest of a slot; history is kept."""
    latest = Window.partitionBy(*slot).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("superseded", F.row_number().over(latest) > 1)


def stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("text").alias("texts"),
        F.count_distinct("source").alias("sources"),
        F.sum(F.col("text").isNull().cast("long")).alias("nulls"),
        F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("bytes"),
    )
