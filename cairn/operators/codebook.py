"""Codebooks: k-means over vectors by partial sums, and vectors as bound bundles of code words.

Vectors become whole numbers (``SCALE`` steps to one), so sums don't depend on the order of partitions and centroids come out
the same on any cluster. A row carries its centroid, an upper bound of its distance to it and a lower bound of its
distance to all others; after a round the bounds move by how far the centroids moved, and
only rows whose bounds meet are measured again. Centroids (k times the dimensions, a fixed size) go to the tasks; rows never leave theirs but as sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hv
from ..sources.tables import discard, scratch_dir, stored

SCALE = 1 << 16
STATE = "id long, x array<long>, code int, upper double, lower double, measured long"


def first_rows(rows: DataFrame, k: int) -> np.ndarray:
    """The k different vectors of rows (id, x) whose ids have the least hashes, as a matrix."""
    one = rows.groupBy("x").agg(F.min(F.struct(F.md5(F.col("id").cast("string")).alias("h"), F.col("id"))).alias("o"))
    return np.array([r.x for r in one.orderBy("o").limit(k).collect()], np.float64)


def _measured(rows: DataFrame, centres: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The rows with their nearest centre (the first of equals); rows whose bounds settle it aren't measured."""
    gap = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    np.fill_diagonal(gap, np.inf)
    shared = rows.sparkSession.sparkContext.broadcast((centres, gap.min(1) / 2 if len(centres) > 1 else np.full(1, np.inf), moved))

    def run(batches):
        centres, half, moved = shared.value
        for batch in batches:
            x = hv.matrix(batch.column("x"), np.float64)
            if not len(x):
                continue
            code, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("code", "upper", "lower"))
            if moved is None:
                look = np.arange(len(x))
            else:
                upper += moved[code]
                lower -= moved.max()
                look = np.flatnonzero(upper * (1 + 1e-9) >= np.maximum(lower, half[code]))
            for a in range(0, len(look), 4096):
                at = look[a : a + 4096]
                d = np.sqrt(((x[at][:, None] - centres[None]) ** 2).sum(2))
                code[at] = d.argmin(1)
                upper[at] = d.min(1)
                d[np.arange(len(at)), code[at]] = np.inf
                lower[at] = d.min(1)
            n = np.zeros(len(x), np.int64)
            n[look] = 1
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(code.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(n)], names=["id", "x", "code", "upper", "lower", "measured"])

    return rows.mapInArrow(run, STATE)


def train(vectors: DataFrame, k: int, rounds: int) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(id, code; the k centroids; rows measured in each round) of vectors (id, v), after so many rounds of k-means."""
    top = scratch_dir(vectors.sparkSession)
    x = F.transform("v", lambda y: F.round(y.cast("double") * SCALE).cast("long"))
    rows = stored(vectors.select(F.col("id").cast("long").alias("id"), x.alias("x"), F.lit(0).alias("code"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("measured")), f"{top}/0")
    centres, moved, seen = first_rows(rows, k), None, []
    if not len(centres):
        return rows.select("id", "code"), centres / SCALE, seen
    for r in range(1, rounds + 1):
        rows = stored(_measured(rows, centres, moved), f"{top}/{r}")
        discard(rows.sparkSession, f"{top}/{r - 1}")
        sums = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("measured").alias("m"), F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(centres.shape[1])]).alias("s")).collect()  # k rows
        seen.append(sum(s.m for s in sums))
        before, centres = centres, centres.copy()
        for s in sums:
            centres[s.code] = np.array(s.s, np.float64) / s.n
        moved = np.linalg.norm(centres - before, axis=1)
    return rows.select("id", "code"), centres / SCALE, seen


def encode(vectors: DataFrame, codes: np.ndarray, lanes: int) -> DataFrame:
    """id, words (the code word of each piece of the vector), hv: the bundle of positions bound to code words; vectors (id, v), codes (words, dimensions of a piece)."""
    shared = vectors.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        codes = shared.value
        for batch in batches:
            v = hv.matrix(batch.column("v"), np.float64)
            if not len(v):
                continue
            p = v.reshape(len(v), -1, codes.shape[1])
            words = ((p[:, :, None] - codes[None, None]) ** 2).sum(3).argmin(2)
            m = p.shape[1]
            atoms = hv.wide_atoms([f"{kind}{i}" for kind, n in (("position", m), ("word", len(codes))) for i in range(n)], lanes)
            bound = atoms[:m][None] ^ atoms[m:][words]
            made = hv.majority(bound.reshape(-1, lanes), np.arange(len(v) * m), np.arange(len(v) + 1) * m)
            at = np.arange(len(v) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(at * m, pa.array(words.ravel().astype(np.int32))), pa.ListArray.from_arrays(at * lanes, pa.array(made.ravel()))], names=["id", "words", "hv"])

    return vectors.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "id long, words array<int>, hv array<long>")


def decode(bundles: DataFrame, positions: int, words: int, lanes: int) -> DataFrame:
    """id, decoded: for each position the code word nearest to the bundle after its position is unbound (the first of equals); bundles (id, hv)."""

    def run(batches):
        atoms = hv.wide_atoms([f"{kind}{i}" for kind, n in (("position", positions), ("word", words)) for i in range(n)], lanes)
        for batch in batches:
            x = hv.matrix(batch.column("hv"), np.int64)
            if not len(x):
                continue
            out = np.stack([np.stack([np.bitwise_count(x ^ p ^ w).sum(1, dtype=np.int64) for w in atoms[positions:]]).argmin(0) for p in atoms[:positions]], 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * positions, pa.array(out.ravel().astype(np.int32)))], names=["id", "decoded"])

    return bundles.select("id", "hv").mapInArrow(run, "id long, decoded array<int>")
