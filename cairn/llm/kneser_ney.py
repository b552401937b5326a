"""Quality classifier: interpolated modified Kneser-Ney perplexity, thresholded per language.

The model is of byte n-grams (A-Z lowered, digits as one, other ASCII but letters as a space;
each text begins with as many start symbols as the order needs). An n-gram of up to seven bytes is one
long, so its context and its suffix are shifts and masks, and all of the model is joins
and aggregations of count tables sharded by n-gram:

- every part of the corpus sends its distinct n-grams of the highest order once, with
  their counts in trusted texts;
- lower orders count distinct continuations; each order has discounts D1, D2, D3+ from its
  counts of counts;
- p(w | c) = max(a(cw) - D, 0) / sum a(c.) + gamma(c) p(w | shorter c) is joined up from
  order 1, for every n-gram that any text holds, seen in trusted texts or not.

Texts are then scored with the table of log-probabilities: broadcast while it has at most
``broadcast_rows`` n-grams, beyond that joined with each text's n-gram counts by a
shuffle; both give the same perplexities. A document is kept if its perplexity is at most
the ``quantile`` of its language's trusted documents that the model was not trained on (one in five of them,
by a hash of the id). Languages without any use those of all languages.

Edge cases: a text that is null or empty has no n-grams, a null perplexity and is not
kept; no trusted text at all: perplexities come from the uniform base alone and nothing
is above the threshold; a null language is a language of its own; repeated rows get equal rows, and rows that
repeat an id with other texts the least of their results; a null id has no perplexity; an empty
table gives no rows; texts of any length are read whole; extra columns are ignored. There may be any number of languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, longs, scratch_dir, small_batches, stored, string_buffers

#: Bytes of an n-gram, n-grams whose log-probabilities may be broadcast (12 bytes each), and n-grams held before they are summed up.
ORDER, BROADCAST_ROWS, HELD = 5, 1 << 23, 6_000_000
#: Ids of trusted documents that may be broadcast (8 bytes each).
BROADCAST_IDS = 1 << 22
#: The share of trusted documents of a language that its threshold keeps, by the design.
QUANTILE = 0.99
START = 1

_CLASS = LOWER.copy()
_CLASS[:128][[not chr(c).isalnum() for c in range(128)]] = 32
_CLASS[48:58] = 48


def grams(data: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """For each byte, the n-gram that ends with it, as a number with the last byte lowest."""
    rows = len(off) - 1
    full = np.full(len(data) + rows * (order - 1), START, np.uint64)
    shift = np.repeat(np.arange(1, rows + 1) * (order - 1), np.diff(off))
    place = np.arange(len(data)) + shift
    full[place] = _CLASS[data]
    out = np.zeros(len(data), np.uint64)
    for k in range(order):
        out |= full[place - k] << np.uint64(8 * k)
    return out


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(keys)
    keys, counts = keys[o], counts[o]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """gram, n (occurrences in texts whose ``trusted`` is true) for all distinct n-grams, each once for a part of the corpus."""

    def run(batches):
        table, fresh, size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

        def fold(table):
            # the trust of an n-gram is its lowest bit, so one fast sort counts both kinds
            keys = np.sort(np.concatenate(fresh)) if fresh else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(keys))) * (keys[first] & np.uint64(1)).astype(np.int64)
            return _sum(np.concatenate((table[0], keys[first] >> np.uint64(1))), np.concatenate((table[1], count)))

        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            trusted = np.repeat(batch.column("trusted").to_numpy(zero_copy_only=False).astype(np.uint64), np.diff(off))
            fresh.append(grams(data, off, order) << np.uint64(1) | trusted)
            size += len(fresh[-1])
            if size > HELD:
                table, fresh, size = fold(table), [], 0
        keys, counts = fold(table)
        yield pa.RecordBatch.from_arrays([longs(keys), longs(counts)], names=["gram", "n"])

    rows = docs.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    return rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ from the counts of counts 1 to 4."""
    found = {r[0]: r[1] for r in counts.where("a between 1 and 4").groupBy("a").count().collect()}
    n1, n2, n3, n4 = (found.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


def log_probabilities(grams: DataFrame, order: int) -> DataFrame:
    """gram, lp: the log-probability of the last byte of each n-gram of gram_counts' rows given the others."""
    top = scratch_dir(grams.sparkSession)
    tables = {order: grams.select("gram", F.col("n").alias("a"))}
    for k in range(order - 1, 0, -1):  # distinct continuations to the left
        cut = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        tables[k] = stored(tables[k + 1].groupBy(cut.alias("gram")).agg(F.sum((F.col("a") > 0).cast("long")).alias("a")), f"{top}/{k}")
    p = None
    for k in range(1, order + 1):
        t = tables[k]
        d1, d2, d3 = discounts(t)
        context = F.shiftrightunsigned("gram", 8)
        some = lambda cond: F.sum(F.when(F.expr(cond), 1).otherwise(0))
        of = t.where("a > 0").groupBy(context.alias("c")).agg(F.sum("a").alias("total"), (d1 * some("a = 1") + d2 * some("a = 2") + d3 * some("a > 2")).alias("mass"))
        a = F.col("a")
        own = a - F.when(a == 0, 0.0).when(a == 1, d1).when(a == 2, d2).otherwise(d3)
        rows = t.withColumn("c", context).join(of, "c", "left")
        rest = F.lit(1 / 256)
        if p is not None:
            shorter = p.select(F.col("gram").alias("s"), F.col("p").alias("q"))
            rows = rows.join(shorter, F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)) == F.col("s"))
            rest = F.col("q")
        value = F.when(F.col("total").isNull(), rest).otherwise(F.greatest(own, F.lit(0.0)) / F.col("total") + F.col("mass") / F.col("total") * rest)
        p = stored(rows.select("gram", value.alias("p")), f"{top}/p{k}")
    return p.select("gram", F.ln("p").alias("lp"))


def scores(docs: DataFrame, lp: DataFrame, order: int, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, n, total (sum of log-probabilities) for each row of docs."""
    if lp.count() > broadcast_rows:
        return _joined_scores(docs, lp, order)
    table = lp.toPandas().sort_values("gram")
    shared = docs.sparkSession.sparkContext.broadcast((table.gram.to_numpy(np.int64), table.lp.to_numpy(np.float32)))

    def run(batches):
        keys, values = shared.value
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            total = np.zeros(len(data) + 1)
            for a in range(0, len(off) - 1, 256):
                b = min(a + 256, len(off) - 1)
                g = grams(data[off[a] : off[b]], off[a : b + 1] - off[a], order).view(np.int64)
                total[off[a] + 1 : off[b] + 1] = values[np.searchsorted(keys, g)]
            np.cumsum(total, out=total)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(off)), pa.array(total[off[1:]] - total[off[:-1]])], names=["id", "n", "total"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, total double")


def _joined_scores(docs: DataFrame, lp: DataFrame, order: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            for i in range(batch.num_rows):
                keys, counts = np.unique(grams(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), order), return_counts=True)
                yield pa.RecordBatch.from_arrays([longs(np.full(len(keys), batch.column("row")[i].as_py())), longs(keys), longs(counts)], names=["row", "gram", "k"])

    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "id", "text"), f"{scratch_dir(docs.sparkSession)}/rows")
    summed = rows.mapInArrow(run, "row long, gram long, k long").join(lp, "gram").groupBy("row").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("lp")).alias("total"))
    return rows.join(summed, "row", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def classify(docs: DataFrame, labels: DataFrame, *, order: int = ORDER, quantile: float = QUANTILE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, keep; docs: doc_id, text, lang; labels: doc_id, quality, toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    id_ = F.col("doc_id").cast("long").alias("id")
    trusted = F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0))
    good = labels.groupBy(F.col("doc_id").cast("long").alias("g")).agg(trusted.alias("good")).where("good = 1 and g is not null").select("g")
    tested = F.coalesce(F.pmod(F.xxhash64(F.lit("test"), F.col("id")), F.lit(5)) == 0, F.lit(False))
    learned = good.where(~F.pmod(F.xxhash64(F.lit("test"), F.col("g")), F.lit(5)).eqNullSafe(0))
    if learned.count() <= BROADCAST_IDS:  # then the texts needn't move
        learned = F.broadcast(learned)
    marked = docs.select(id_, "text").join(learned, F.col("id") == F.col("g"), "left").select("text", F.col("g").isNotNull().alias("trusted"))
    counts = stored(gram_counts(marked, order), f"{scratch_dir(spark)}/grams")  # the texts are read for them once
    lp = log_probabilities(counts, order)
    scored = scores(docs.select(id_, "text"), lp, order, broadcast_rows=broadcast_rows)
    scored = stored(scored.groupBy("id").agg(F.min(F.struct("n", "total")).alias("x")).select("id", "x.n", "x.total"), f"{scratch_dir(spark)}/scores")
    per = F.when(F.col("n") > 0, F.exp(-F.col("total") / F.col("n")))
    full = docs.select(id_, "lang").join(scored.select("id", "n", per.alias("perplexity")), "id", "left")
    held = full.where(tested & F.col("perplexity").isNotNull()).join(good, F.col("id") == F.col("g"))
    edges = held.rollup("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("t"), F.grouping("lang").alias("all"))
    edges = stored(edges.withColumnRenamed("lang", "l"), f"{scratch_dir(spark)}/edges")
    default = edges.where("all = 1 and t is not null").first()
    own = full.join(edges.where("all = 0").select("l", "t"), F.col("lang").eqNullSafe(F.col("l")), "left")
    threshold = F.coalesce("t", F.lit(default.t if default else float("inf")))
    return own.select(F.col("id").alias("doc_id"), "lang", F.coalesce("n", F.lit(0)).alias("n_bytes"), "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
