"""Retrieval: dense nearest neighbours, votes, candidates by words, reranking.

Searches take a stated query set against all rows: one pass over the rows with all queries, or one for each block
of ``query_bytes`` bytes; each part of the rows sends its k best per query, and only those meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hv
from ..functions.hv import top_k


def cosine_knn(rows: DataFrame, queries: DataFrame, k: int, *, query_bytes: int = hv.QUERY_BYTES, keep_self: bool = False) -> DataFrame:
    """qid, id, sim (cosine, 9 decimals), rank; rows (id, v), queries (qid, v); ties to the lower id."""

    def distance(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return -np.round(unit(q) @ unit(v).T, 9)

    out = hv.nearest(rows.select("id", "v"), queries.select("qid", "v"), k, distance, np.float64, "d double", query_bytes, keep_self)
    return top_k(out.select("qid", "id", (-F.col("d")).alias("sim")), ["qid"], [F.desc("sim"), F.col("id")], k)


def set_neighbours(rows: DataFrame, queries: DataFrame, least: float, *, query_bytes: int = hv.QUERY_BYTES) -> DataFrame:
    """qid, id, both, either: rows (id, h: distinct 64-bit hashes) whose Jaccard similarity with a query (qid, h) is ``least`` or more.

    A block of queries goes along with a pass over the rows as an inverted index (hash to queries). A row
    counts the queries of each of its hashes, so the work is that of the shared words, not of the pairs.
    """
    spark, found = rows.sparkSession, None
    for block in hv.query_blocks(queries.select("qid", "h"), query_bytes):
        size = np.array([len(r[1]) for r in block], np.int64)
        flat = np.concatenate([np.array(r[1], np.int64) for r in block])
        owner = np.repeat(np.arange(len(block)), size)
        order = np.argsort(flat, kind="stable")
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), size, flat[order], owner[order]))
        part = rows.select("id", "h").mapInArrow(_counted(shared, least), "qid long, id long, both long, either long")
        found = part if found is None else found.unionAll(part)
    return spark.createDataFrame([], "qid long, id long, both long, either long") if found is None else found


def _counted(shared, least: float):
    def run(batches):
        qids, size, flat, owner = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                lists, ids = part.column("h"), part.column("id").to_numpy().astype(np.int64)
                n = lists.value_lengths().fill_null(0).to_numpy()
                h, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
                lo, hi = np.searchsorted(flat, h), np.searchsorted(flat, h, "right")
                times = hi - lo
                at = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
                key, both = np.unique(np.repeat(row, times) * len(qids) + owner[at], return_counts=True)
                r, q = key // len(qids), key % len(qids)
                either = n[r] + size[q] - both
                ok = (both >= least * either) & (ids[r] != qids[q])
                cols = (qids[q[ok]], ids[r[ok]], both[ok].astype(np.int64), either[ok].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["qid", "id", "both", "either"])

    return run


def label_vote(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """qid, label, share, margin: votes of weight 1 / (1 + distance) per label (id, label), the winner's share and its lead."""
    votes = hits.join(labels, "id").groupBy("qid", "label").agg(F.sum(1 / (2 - F.col("sim"))).alias("w"))
    total = Window.partitionBy("qid")
    order = total.orderBy(F.desc(F.round("w", 9)), "label")
    ranked = votes.select("qid", "label", (F.col("w") / F.sum("w").over(total)).alias("share"), F.row_number().over(order).alias("rn"), F.lead("w").over(order).alias("next"), "w")
    return ranked.where("rn = 1").select("qid", "label", "share", ((F.col("w") - F.coalesce("next", F.lit(0.0))) / F.col("w") * F.col("share")).alias("margin"))


def regression(hits: DataFrame, values: DataFrame) -> DataFrame:
    """qid, mean (weighted), std, agreement = 1 / (1 + std / max(1, |mean|)) of the neighbours' values (id, value)."""
    w = 1 / (2 - F.col("sim"))
    g = hits.join(values, "id").groupBy("qid").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("mean"), F.stddev_pop("value").alias("std"))
    return g.withColumn("agreement", 1 / (1 + F.col("std") / F.greatest(F.lit(1.0), F.abs("mean"))))


def postings(rows: DataFrame, id_col: str, words: Column) -> DataFrame:
    """token, id: an inverted index, each row's words once."""
    return rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(words)).alias("token"))


def first_holders(index: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """The first n rows (by id) that hold each of the words (a column token)."""
    return top_k(index.join(words, "token"), ["token"], [F.col("id")], n)


def rerank(shared: DataFrame, n: int) -> DataFrame:
    """qid, id, score, rank from rows (qid, id, weight) of evidence: the n best sums, ties to the lower id."""
    return top_k(shared.groupBy("qid", "id").agg(F.round(F.sum("weight"), 6).alias("score")), ["qid"], [F.desc("score"), F.col("id")], n)


def deletions(word: Column, most: int) -> Column:
    """A word and all that is left of it without up to ``most`` of its letters."""
    one = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    out = step = F.array(word)
    for _ in range(most):
        step = F.flatten(F.transform(step, one))
        out = F.concat(out, step)
    return F.array_distinct(out)


def unique_nearest_name(words: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """word, name, distance: the one name at the least edit distance of at most ``most``; none where two tie.

    Two words that far apart have a form in common that is either without ``most`` letters at most, so they
    meet there, and the edit distance is taken of such pairs only.
    """
    w = words.select("word").distinct().select("word", F.explode(deletions(F.col("word"), most)).alias("form"))
    n = names.select("name").distinct().select("name", F.explode(deletions(F.col("name"), most)).alias("form"))
    d = w.join(n, "form").select("word", "name").distinct().withColumn("d", F.levenshtein("word", "name", most)).where("d >= 0")
    best = d.groupBy("word").agg(F.min(F.struct("d", "name")).alias("b")).select("word", "b.name", F.col("b.d").alias("distance"))
    ties = d.join(best.select("word", F.col("distance").alias("d")), ["word", "d"]).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return best.join(ties, "word").select("word", "name", "distance")
