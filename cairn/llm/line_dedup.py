"""Line deduplication across documents that returns keep bitmaps, not text.

Lines become (hash, document, position) rows. They are range-partitioned by hash and sorted
by hash, document descending and position; each partition streams its sorted rows, where
the first document of a hash is the one that keeps its lines, and a hash that goes on to
``min_docs`` documents loses the lines of all others. A hash that more than one in
``4 x partitions`` of all lines has would make a partition too large: such hashes (as
their share implies, less than four for each partition) are left out of the stream, counted by hash and
document in partial sums, and decided by a join with those totals, which are broadcast. Both give the same result.
What comes back is, for each document, the run-length-compressed bitmap of kept line
positions (array of start and length).

Edge cases: a null or empty text is one empty line; keys shorter than ``min_chars``
code points never drop; rows that repeat a doc_id count as one document and, with
equal texts, get equal bitmaps; a null doc_id is a document of its own that is below
all others; texts and lines of any length are read whole; an empty table gives no rows; extra columns are carried, ``keep_bitmaps``
replaces those named n_lines, n_dropped and keep, ``apply_bitmaps`` none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_dir, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """_h, _g (128 bits of the key), _doc, _text (64-bit hash of the text), _pos for each line long enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).cast("long").alias("_doc"), F.xxhash64(text).alias("_text"), F.posexplode(lines_of(text)).alias("_pos", "_line"))
    keyed = lines.where(F.char_length("_line") >= min_chars).withColumn("_key", line_key(F.col("_line"))).where(F.char_length("_key") >= min_chars)
    return keyed.select(F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(1), "_key").alias("_g"), "_doc", "_text", "_pos")


def drop_runs(pos: Column) -> Column:
    """Sorted positions as runs (s, e), e exclusive."""
    first = F.filter(pos, lambda x, i: (i == 0) | (F.get(pos, i - 1) < x - 1))
    last = F.filter(pos, lambda x, i: (i == F.size(pos) - 1) | (F.get(pos, i + 1) > x + 1))
    return F.zip_with(first, last, lambda s, e: F.struct(s.alias("s"), (e + 1).alias("e")))


def keep_runs(runs: Column, n_lines: Column) -> Column:
    """The complement of the dropped runs in 0..n_lines-1: the keep bitmap as (start, length)."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["e"]))
    ends = F.concat(F.transform(runs, lambda r: r["s"]), F.array(n_lines))
    both = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("length")))
    return F.filter(both, lambda r: r["length"] > 0)


def heavy_hashes(rows: DataFrame, parts: int) -> DataFrame:
    """_h, _g of the hashes with more than one in 4 * parts of all lines: less than 4 * parts rows."""
    most = rows.count() // (4 * parts) + 1
    return rows.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_h", "_g")


def lost_in_stream(rows: DataFrame, parts: int, min_docs: int) -> DataFrame:
    """The rows that drop, decided inside partitions of a range of hashes, in sorted order."""
    ranged = rows.repartitionByRange(parts, "_h", "_g").sortWithinPartitions("_h", "_g", F.desc("_doc"), "_pos")
    one = Window.partitionBy("_h", "_g")
    ranked = ranged.withColumn("_rank", F.dense_rank().over(one.orderBy(F.desc("_doc"))))
    whole = one.orderBy(F.desc("_doc")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ranked.withColumn("_docs", F.max("_rank").over(whole)).where((F.col("_rank") > 1) & (F.col("_docs") >= min_docs))


def lost_by_totals(rows: DataFrame, min_docs: int) -> DataFrame:
    """The same for a few hashes, by counts that meet as partial sums."""
    totals = rows.groupBy("_h", "_g", "_doc").agg(F.lit(1).alias("_one")).groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_docs"), F.max("_doc").alias("_keeper"))
    return rows.join(F.broadcast(totals.where(F.col("_docs") >= min_docs)), ["_h", "_g"]).where(~F.col("_doc").eqNullSafe(F.col("_keeper")))


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """_doc, _text and _runs (dropped runs) for each document that loses lines."""
    spark = docs.sparkSession
    top, parts = scratch_dir(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(line_rows(docs, id_col, text_col, min_chars), f"{top}/rows")  # read for the counts, the range bounds and both ways
    heavy = F.broadcast(stored(heavy_hashes(rows, parts), f"{top}/heavy"))
    names = ["_doc", "_text", "_pos"]
    light = lost_in_stream(rows.join(heavy, ["_h", "_g"], "left_anti"), parts, min_docs).select(*names)
    lost = light.unionAll(lost_by_totals(rows.join(heavy, ["_h", "_g"], "left_semi"), min_docs).select(*names))
    return lost.groupBy("_doc", "_text").agg(F.array_sort(F.collect_set("_pos")).alias("_pos")).select("_doc", "_text", drop_runs(F.col("_pos")).alias("_runs"))


def _marked(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """_row (a row of docs as one value, so its names meet none of those used here), _n_lines, _n_dropped and _keep."""
    lost = dropped_lines(docs, id_col=id_col, text_col=text_col, **options)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_i"), F.xxhash64(text).alias("_h"))
    joined = own.join(lost, F.col("_i").eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_text")), "left")
    n_lines = F.size(lines_of(F.col("_row")[text_col]))
    runs = F.coalesce(F.col("_runs"), F.array().cast("array<struct<s:int,e:int>>"))
    n_dropped = F.aggregate(runs, F.lit(0), lambda a, r: a + r["e"] - r["s"])
    return joined.select("_row", n_lines.cast("long").alias("_n_lines"), n_dropped.cast("long").alias("_n_dropped"), keep_runs(runs, n_lines).alias("_keep"))


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with n_lines, n_dropped and keep: array of (start, length) runs of kept line positions."""
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "keep")]
    return _marked(docs, id_col, text_col, **options).select(*own, F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.col("_keep").alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The kept lines, joined by \\n: one slice for each run."""
    lines = lines_of(text)
    return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")


def apply_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, **options) -> DataFrame:
    """docs, all its columns, with the dropped lines gone from the text; a null text stays null. chars_col, if it is there, follows the text."""
    text = F.col("_row")[text_col]
    cut = F.when(text.isNull() | (F.col("_n_dropped") == 0), text).otherwise(kept_text(text, F.col("_keep")))
    marked = _marked(docs, id_col, text_col, **options).select("_row", "_n_dropped", cut.alias("_cut"))
    changed = {text_col: F.col("_cut")}
    if chars_col in docs.columns:
        changed[chars_col] = F.when(F.col("_n_dropped") > 0, F.char_length("_cut").cast(docs.schema[chars_col].dataType)).otherwise(F.col("_row")[chars_col])
    return marked.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.when(F.col("n_dropped") == 0, F.coalesce("text", F.lit(""))).otherwise(kept_text(F.col("text"), F.col("keep")))
    return keep_bitmaps(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


ORACLE = r"""
WITH base AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
rows_ AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM base),
keyed AS (SELECT doc_id, line, pos,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM rows_),
hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT r.doc_id, r.line, r.pos, (h.k IS NOT NULL AND r.doc_id <> h.keeper) AS gone FROM keyed r LEFT JOIN hot h ON r.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
