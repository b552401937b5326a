"""Two-pass external shuffle into shards.

Pass one scatters records over buckets by a seeded hash of id, CRC and size, so each bucket is a uniform
random subset: of about ``bucket_rows`` records, or fewer where these would have more than
``bucket_bytes`` bytes of text on average, so a bucket fits in memory. Pass two applies a Fisher-Yates
permutation to each bucket. Buckets laid end to end give each record a global
position; position modulo the shard count is its shard, so shard counts differ by one
at most (law ``rows``), whatever the texts are. ``write_shards`` writes the records in that order.

All of it is DataFrame code. The permutation is an ``aggregate`` over the swaps of
Fisher-Yates on an array of ranks, made once per bucket, not per record; a swap copies the array, which is
``chunk_rows`` ranks at most, so the work per record is bounded. A
bucket that rows equal in id and text overfill is cut into chunks of ``chunk_rows`` ranks, each
permuted by itself.

Edge cases: a null or empty text has size 1 and CRC 0; repeated rows each get a slot
of their own; a null id is an ordinary value, and ids repeated with other texts are dealt by
their texts; very long texts make for more and smaller buckets; an empty table
gives no rows; further columns of the input are carried along, those named like an output column are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Records and bytes of text in a bucket, on average, and ranks in one permuted array at most.
BUCKET_ROWS, BUCKET_BYTES, CHUNK_ROWS = 1024, 64 << 20, 2048
#: Buckets whose counts are summed together before the sums are added up.
SPAN = 1024


def fisher_yates(n: Column, *seed: Column) -> Column:
    """A permutation of 0..n-1: for i = n-1 down to 1 swap items i and hash(seed, i) mod (i + 1)."""

    def swap(a: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seed, i), i.cast("long") + 1).cast("int")
        one = F.lit(1)
        return F.when(i == j, a).otherwise(
            F.concat(
                F.slice(a, one, j),
                F.array(F.get(a, i)),
                F.slice(a, j + 2, i - j - 1),
                F.array(F.get(a, j)),
                F.slice(a, i + 2, F.size(a) - i - 1),
            )
        )

    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    start = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, swap)


def bucket_table(bucketed: DataFrame, seed: int, chunk_rows: int) -> DataFrame:
    """bucket, offset (rows in lower buckets) and perms (a permutation for each chunk)."""
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_span", F.floor(F.col("_bucket") / SPAN))
    spans = counts.groupBy("_span").agg(F.sum("_n").alias("_m"))
    before = F.sum("_m").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("_span", F.coalesce(before, F.lit(0)).alias("_base"))
    inner = F.sum("_n").over(Window.partitionBy("_span").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    chunks = F.sequence(F.lit(0), ((F.col("_n") - 1) / chunk_rows).cast("int"))
    size = lambda c: F.least(F.lit(chunk_rows), (F.col("_n") - c.cast("long") * chunk_rows)).cast("int")
    return (
        counts.withColumn("_inner", F.coalesce(inner, F.lit(0)))
        .join(spans, "_span")
        .select(
            "_bucket",
            (F.col("_base") + F.col("_inner")).alias("_offset"),
            F.transform(chunks, lambda c: fisher_yates(size(c), F.lit(seed), F.col("_bucket"), c)).alias("_perms"),
        )
    )


def shuffle_shards(
    df: DataFrame,
    n_shards: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    bucket_rows: int = BUCKET_ROWS,
    bucket_bytes: int = BUCKET_BYTES,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """df with size, text_crc32, shard (0 to n_shards - 1) and slot (gapless from 0 in each shard)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = F.octet_length(text).cast("long"), F.crc32(text)
    total = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    n_buckets = max(1, -(-total.n // bucket_rows), -(-total.bytes // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), crc, size), F.lit(n_buckets))
    # the row goes along as one value, so its names meet none of those used here
    rows = df.select(F.struct(*df.columns).alias("_row"), size.alias("_size"), crc.alias("_crc"), bucket.alias("_bucket"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col("_row")[id_col], "_crc", "_size")) - 1
    ranked = rows.withColumn("_rank", rank)
    buckets = bucket_table(df.select(bucket.alias("_bucket")), seed, chunk_rows)
    chunk = F.floor(F.col("_rank") / chunk_rows).cast("int")
    at = F.col("_offset") + chunk * chunk_rows + F.get(F.get("_perms", chunk), F.col("_rank") % chunk_rows)
    keep = [c for c in df.columns if c not in ("shard", "slot", "size", "text_crc32")]
    placed = ranked.join(buckets, "_bucket").select("_row", "_size", "_crc", at.alias("_at"))
    return placed.select(
        *[F.col("_row")[c].alias(c) for c in keep], (F.col("_size") + 1).alias("size"), F.col("_crc").alias("text_crc32"),
        (F.col("_at") % n_shards).cast("int").alias("shard"), F.floor(F.col("_at") / n_shards).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, n_shards: int, path: str, *, parts_per_shard: int = 16, **options) -> None:
    """Write df's records as Parquet under path/shard=K, in slot order within and across the files of a shard."""
    placed = shuffle_shards(df, n_shards, **options)
    placed.repartitionByRange(n_shards * parts_per_shard, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shuffle_shards(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
