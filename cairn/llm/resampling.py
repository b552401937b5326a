"""Importance resampling towards a target distribution of hashed n-grams.

1. In each partition DuckDB cuts the texts of a batch into words (SQL unnest), joins runs of 1 to
   n words by window functions, hashes each run by a registered CRC-32 function of zlib and
   counts buckets per document. Buckets and counts are spilled to a Parquet table in the shared folder.
2. Spark adds these up: buckets of the raw corpus and of the target texts give each
   bucket's gain (the log of its ratio of frequencies, 1/1000ths, floored), and a document's weight is the sum of gains over its runs.
3. A Gumbel value from a hash of seed and id is added, so that the highest scores are a draw without
   putting back, with chances by weight. Ranks are numbered over ranges of scores.

DuckDB runs on one thread, in memory, on one Arrow batch at a time (2 MB, or one text). The gains are one constant of ``buckets`` values.

Edge cases: null and empty texts have no runs, weight 0 and a score of their own; under
min_words words a document is never drawn; texts of any length are cut whole; each row counts
and is drawn by itself, so equal rows have equal scores and ranks next to each other; a null id is hashed as an
empty one and comes last among equals; empty tables give no rows (an empty target: all gains compare with nothing); other columns are left out.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, scratch_dir, small_batches, stored

#: ASCII letters and all that is not ASCII, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counting_sql(longest: int, buckets: int) -> str:
    """The buckets of a batch: row, words, features, and a list each of buckets and of counts."""
    runs = " UNION ALL ".join(["SELECT row, word AS run FROM words"] + [f"SELECT row, {' || chr(32) || '.join(['word'] + [f'w{i}' for i in range(1, j)])} FROM ahead WHERE w{j - 1} IS NOT NULL" for j in range(2, longest + 1)])
    ahead = ", ".join(["row", "word"] + [f"lead(word, {i}) OVER (PARTITION BY row ORDER BY place) AS w{i}" for i in range(1, longest)])
    return f"""
WITH cut AS (SELECT row, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM batch),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM cut),
ahead AS (SELECT {ahead} FROM words),
runs AS (SELECT row, run, count(*) AS n FROM ({runs}) GROUP BY row, run),
hashed AS (SELECT run, crc(run) % {buckets} AS bucket FROM (SELECT DISTINCT run FROM runs)),
counts AS (SELECT row, bucket, sum(n)::BIGINT AS n FROM runs JOIN hashed USING (run) GROUP BY row, bucket),
lists AS (SELECT row, sum(n)::BIGINT AS features, list(bucket::INTEGER ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM counts GROUP BY row)
SELECT row, len(w)::BIGINT AS words, coalesce(features, 0) AS features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
FROM cut LEFT JOIN lists USING (row) ORDER BY row
"""


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """id, words, features, buckets, counts for each row of docs (id, text)."""
    sql, kind = counting_sql(longest, buckets), pa.schema([("id", pa.int64()), ("words", pa.int64()), ("features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False})
        crc = lambda x: pa.array([zlib.crc32(t.encode()) for t in x.to_pylist()], pa.int64())
        con.create_function("crc", crc, ["VARCHAR"], "BIGINT", type="arrow")
        for batch in batches:
            if batch.num_rows:
                text = pc.fill_null(batch.column("text").cast(pa.string()), "")
                con.register("batch", pa.table({"row": np.arange(batch.num_rows), "text": text}))
                out = con.sql(sql).to_arrow_table().combine_chunks()
                con.unregister("batch")
                made = pa.table([batch.column("id").cast(pa.int64()), *(out.column(c).cast(kind.field(c).type) for c in kind.names[1:])], names=kind.names)
                yield from made.to_batches()

    return docs.mapInArrow(run, "id long, words long, features long, buckets array<int>, counts array<long>")


def totals(counted: DataFrame, name: str) -> DataFrame:
    """bucket and its count in the whole table."""
    one = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return one.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains_of(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Each bucket's gain: floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))."""
    spark = raw.sparkSession
    both = spark.range(buckets).select(F.col("id").alias("bucket")).join(totals(raw, "s"), "bucket", "left").join(totals(target, "t"), "bucket", "left").na.fill(0)
    both = both.withColumn("all_s", F.sum("s").over(Window.partitionBy())).withColumn("all_t", F.sum("t").over(Window.partitionBy()))  # over `buckets` rows
    real = lambda x: F.col(x).cast("double")
    ratio = (real("t") + 1) * (real("all_s") + buckets) / ((real("s") + 1) * (real("all_t") + buckets))
    return [r[0] for r in both.orderBy("bucket").select(F.floor(1000 * F.log(ratio)).cast("long")).collect()]


def numbered(rows: DataFrame, order: list, path: str) -> DataFrame:
    """rows with rank: 1, 2, 3, ... in the order given, by ranges, so that no task sees all of them."""
    part = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), path)
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.withColumn("_own", own).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("rank", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, longest: int = 2, buckets: int = 10_000, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    top = scratch_dir(spark)
    raw = stored(bucket_counts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), longest, buckets), f"{top}/raw")
    wanted = stored(bucket_counts(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text_col).alias("text")), longest, buckets), f"{top}/target")
    gains = F.from_json(F.lit(json.dumps(gains_of(raw, wanted, buckets))), "array<bigint>")  # a constant
    each = F.arrays_zip("buckets", "counts")
    weight = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x["counts"] * F.get(gains, x["buckets"]))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0))).cast("long")
    scored = raw.select("id", "words", F.col("features").alias("n_features"), weight.alias("weight"), F.monotonically_increasing_id().alias("row"))
    scored = stored(scored.withColumn("score", F.col("weight") + gumbel), f"{top}/scored")
    discard(spark, f"{top}/raw", f"{top}/target")
    fit = scored.where(F.col("words") >= min_words)
    drawn = percent * fit.count() // 100
    # a row's own number spreads equal rows over ranges
    ranked = numbered(fit, [F.desc("score"), F.asc_nulls_last("id"), F.col("row")], f"{top}/ranked").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"), longest=1)


ORACLE = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
hex_ AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM d UNION SELECT w FROM b)),
crc AS (SELECT w, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
    lambda c, y: list_reduce(list_prepend(xor(c, y), range(8)), lambda z, i: xor(z >> 1, 3988292384::BIGINT * (z & 1))))) % 10000 AS bucket FROM hex_),
dc AS (SELECT doc_id, bucket, count(*) AS n FROM d JOIN crc USING (w) GROUP BY ALL),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dc GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
doc AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight FROM dc JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN doc USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * (SELECT count(*) FROM ranked) // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
