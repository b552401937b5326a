import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm.sharding import fisher_yates, shuffle_shards, write_shards

from .cases import COLUMNS, HARD, edge_docs, edge_rows, empty_docs, hard_rows


def test_laws(spark):
    for options in ({}, {"bucket_rows": 4, "chunk_rows": 3}):
        got = shuffle_shards(edge_docs(spark), 8, **options).collect()
        assert len(got) == len(edge_rows())
        by = {}
        for r in got:
            t = (r.text or "").encode()
            assert r["size"] == len(t) + 1 and r.text_crc32 == zlib.crc32(t)
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        counts = [len(by.get(k, [])) for k in range(8)]
        assert max(counts) - min(counts) <= 1


def test_fisher_yates_is_a_permutation(spark):
    rows = spark.range(0, 40).select("id", fisher_yates(F.col("id").cast("int"), F.lit(7)).alias("p")).collect()
    assert all(sorted(r.p) == list(range(r.id)) for r in rows)
    assert sum(r.p == sorted(r.p) for r in rows) < 8


def test_fisher_yates_is_even(spark):
    p = spark.range(0, 6000).select(fisher_yates(F.lit(3), F.col("id")).alias("p")).groupBy("p").count().collect()
    assert len(p) == 6 and all(850 < r["count"] < 1150 for r in p)


def _hash(seed, *values):
    """The hash of longs and ints (pairs of value and width), each seeded with the one before."""
    for v, width in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.to_bytes(width, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


@pytest.mark.parametrize("make,schema", [(edge_rows, COLUMNS), (hard_rows, HARD)])
@pytest.mark.parametrize("bucket_rows,chunk_rows", [(1024, 2048), (4, 3)])
def test_replay(spark, make, schema, bucket_rows, chunk_rows):
    """Scatter and permutation done again in plain Python give the same slots."""
    rows = make()
    n_buckets = -(-len(rows) // bucket_rows)
    buckets = [[] for _ in range(n_buckets)]
    for i, t, *_ in rows:
        raw = (t or "").encode()
        crc = zlib.crc32(raw)
        h = _hash(42, (7, 4), (i, 8), (crc, 8), (len(raw), 8))
        buckets[h % n_buckets].append(((i is not None, i), crc, len(raw), i, t))
    want, at = [], 0
    for b, own in enumerate(buckets):
        own.sort(key=lambda r: (r[0][0], r[0][1] or 0, r[1], r[2]))
        for c in range(0, len(own), chunk_rows):
            part = own[c : c + chunk_rows]
            place = list(range(len(part)))
            for k in range(len(part) - 1, 0, -1):
                j = _hash(42, (7, 4), (b, 8), (c // chunk_rows, 4), (k, 4)) % (k + 1)
                place[k], place[j] = place[j], place[k]
            want += [(i, t, (at + c + p) % 8, (at + c + p) // 8) for (*_, i, t), p in zip(part, place, strict=True)]
        at += len(own)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = shuffle_shards(docs, 8, bucket_rows=bucket_rows, chunk_rows=chunk_rows).collect()
    assert sorted([(r.doc_id, r.text, r.shard, r.slot) for r in got], key=str) == sorted(want, key=str)


def test_buckets_by_bytes(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text"))
    few, many = (shuffle_shards(docs, 4, bucket_bytes=b) for b in (1 << 26, 4000))
    assert sorted(r.slot for r in many.collect()) == sorted(r.slot for r in few.collect())
    assert [(r.shard, r.slot) for r in many.orderBy("doc_id").collect()] != [(r.shard, r.slot) for r in few.orderBy("doc_id").collect()]


def test_written_shards(spark, tmp_path):
    """Shards on disk hold all records, in slot order within each file and across a shard's files."""
    docs = spark.createDataFrame(hard_rows(), HARD).repartition(3)
    write_shards(docs, 3, str(tmp_path / "out"), parts_per_shard=2, bucket_rows=5)
    want = {(r.shard, r.slot): (r.doc_id, r.text) for r in shuffle_shards(docs, 3, bucket_rows=5).collect()}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.shard, r.slot): (r.doc_id, r.text) for r in back.collect()} == want
    for shard in range(3):
        slots = [r.slot for f in sorted((tmp_path / "out" / f"shard={shard}").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
        assert slots == sorted(slots) and slots


def test_empty_table(spark):
    assert shuffle_shards(empty_docs(spark), 8).count() == 0
