"""Ranked lexical search by sort-based accumulation: every item of a query table against all documents.

1. Items become (item, term, count) rows; the hashes of their terms make a bitmap of a fixed size.
2. One pass over the texts keeps, of each document, its number of terms and the counts of the
   terms that pass the bitmap: its part of the inverted lists. Document frequencies, the number
   of documents and the total of terms are sums over that table.
3. The table is dealt in ranges of documents, so that all that an item and a document have in
   common is in one task. Per group of documents the task looks up each term's items, joins the
   item-document-impact arrays to one, sorts it by a packed key (item, document) in radix
   passes of 16 bits and adds equal keys up (reduceat). A heap of k for each item keeps
   the best of the range.
4. The k best of each range meet by item.

Items go to the tasks in blocks of ``BLOCK`` (item, term) rows, a pass over the stored lists (not
over the texts) for each; a block's size doesn't depend on the tables. Terms are compared by
64-bit hashes.

Edge cases: a null or empty text, or one without terms, is no document of the statistics and is
never found; an item without terms finds nothing; texts may be of any length (a text is cut
into terms as one array); each row of documents or items counts by itself, so equal rows
are found as often as they stand there, and an item id with several texts is ranked once
for each; equal scores go by ascending id, null ids last; a null item id keeps its hits; empty tables give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hash_bitmap, longs, row_groups, scratch_dir, small_batches, stored, string_buffers, word_hashes

#: Bytes that are in no term: ASCII but letters and digits.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: (item, term) rows of a pass, entries that are sorted at a time, bits of the filter of terms.
BLOCK, ENTRIES, FILTER_BITS = 1 << 20, 1 << 20, 1 << 24


def radix_order(key: np.ndarray, most: int) -> np.ndarray:
    """The stable ascending order of keys from 0 to most, by passes over 16 bits."""
    order, shift = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable"), 16
    while most >> shift:
        order = order[np.argsort(((key[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def firsts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def term_counts(data: np.ndarray, off: np.ndarray, bits: np.ndarray | None = None):
    """Terms of each row, and row offsets, hashes and counts of its distinct terms (of those in the bitmap)."""
    h, at = word_hashes(data, off, OUTSIDE)
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))
    if bits is not None:
        slot = (h & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
        known = bits[slot >> 3] >> (slot & 7) & 1 > 0
        h, row = h[known], row[known]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))) if len(h) else np.zeros(0, np.int64)
    return np.diff(at), np.searchsorted(row[first], np.arange(len(off))), h[first], np.diff(np.append(first, len(h)))


def item_terms(items: DataFrame) -> DataFrame:
    """item, h, c: how often each term stands in the item's text; items (item, text)."""

    def run(batches):
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            own = batch.column("item").to_numpy()
            for a, b in row_groups(off):
                _, at, h, c = term_counts(data[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([longs(np.repeat(own[a:b], np.diff(at))), longs(h), longs(c)], names=["item", "h", "c"])

    return items.mapInArrow(run, "item long, h long, c long")


def document_lists(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """id, n, h, tf of each document that has terms: their number, and hashes and counts of those in the bitmap; docs (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bits = shared.value
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            for a, b in row_groups(off):
                n, at, h, tf = term_counts(data[off[a] : off[b]], off[a : b + 1] - off[a], bits)
                at = pa.array(at, pa.int32())
                lists = [pa.ListArray.from_arrays(at, longs(h)), pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), longs(n), *lists], names=["id", "n", "h", "tf"]).filter(pa.array(n > 0))

    return docs.mapInArrow(run, "id long, n long, h array<long>, tf array<int>")


class Best:
    """The k best documents of each item: a heap of (score, -id) each."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = np.flatnonzero(score >= self.least[item])
        item, score, ids, null = item[good], score[good], ids[good], null[good]
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        first = firsts(item)
        top = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item)))) < self.k
        for i, j in zip(item[top].tolist(), order[top].tolist(), strict=True):
            heap, own = self.heaps[i], (int(score[j]), -(1 << 63) if null[j] else -int(ids[j]))
            if len(heap) < self.k:
                heapq.heappush(heap, own)
            else:
                heapq.heappushpop(heap, own)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def range_bests(lists: DataFrame, weights: tuple[np.ndarray, np.ndarray, np.ndarray], documents: int, terms: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each range of documents; weights (h sorted, item, weight times count)."""
    h, item, weight = weights
    names, local = np.unique(item, return_inverse=True)
    first = firsts(h)
    shared = lists.sparkSession.sparkContext.broadcast((h[first], np.append(first, len(h)), names, local, weight))

    def run(batches):
        known, start, names, local, weight = shared.value
        best = Best(len(names), k)
        for batch in batches:
            ids = batch.column("id")
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            n, lists = batch.column("n").to_numpy(), batch.column("h")
            off = lists.offsets.to_numpy().astype(np.int64)
            h, tf = lists.values.to_numpy().view(np.uint64), batch.column("tf").values.to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            fan = np.where(known[at] == h, start[at + 1] - start[at], 0)
            sums = np.append(0, np.cumsum(fan))
            a, rows = 0, len(ids)
            while a < rows:  # so many rows that at most ENTRIES are sorted at a time, one at least
                b = max(a + 1, int(np.searchsorted(sums[off], sums[off[a]] + ENTRIES, "right")) - 1)
                part = slice(off[a], off[b])
                f = fan[part]
                row = np.repeat(np.arange(b - a), np.diff(off[a : b + 1]))
                m = 75 + 25 * n[a:b] * documents // terms
                impact = 1_000_000_000 * tf[part] // (1000 * tf[part] + 12 * m[row])
                total = int(f.sum())
                entry = np.repeat(start[at[part]] - (np.cumsum(f) - f), f) + np.arange(total)
                key = local[entry] * (b - a) + np.repeat(row, f)
                value = weight[entry] * np.repeat(impact, f)
                order = radix_order(key, len(names) * (b - a) - 1)
                key = key[order]
                cut = firsts(key)
                if total:
                    found, where = np.divmod(key[cut], b - a)
                    best.add(found, np.add.reduceat(value[order], cut), ids[a:b][where], null[a:b][where])
                a = b
        rows = [(int(names[i]), None if d == -(1 << 63) else -d, s) for i, heap in enumerate(best.heaps) for s, d in heap]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return lists.mapInArrow(run, "item long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each row of items, those with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    top = scratch_dir(spark)
    items = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), f"{top}/items")
    terms = stored(item_terms(items.select("item", "text")), f"{top}/terms")
    bits = hash_bitmap(terms.select("h"), FILTER_BITS)
    lists = stored(document_lists(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), bits), f"{top}/lists")
    total = lists.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    frequency = lists.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(total.n) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = stored(terms.join(frequency, "h").select("item", "h", (weight * F.col("c")).alias("w")), f"{top}/weights")
    blocks = -(-weights.count() // BLOCK)
    found = None
    for i in range(blocks):  # BLOCK rows come to the driver at a time
        block = weights.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).toPandas()
        h = block.h.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h, kind="stable")
        if len(order):
            best = range_bests(lists, (h[order], block.item.to_numpy(np.int64)[order], block.w.to_numpy(np.int64)[order]), total.n, total.terms, k)
            best = stored(best, f"{top}/best{i}")
            found = best if found is None else found.union(best)
    if found is None:
        found = spark.createDataFrame([], "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    out = ranked.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    discard(spark, f"{top}/lists", f"{top}/terms", f"{top}/weights")
    return out


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, docs),
c AS (SELECT item_id, t, count(*) AS c FROM i GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(c.c * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM c JOIN w USING (t) JOIN tf USING (t) JOIN n USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
