"""Packed binary hypervectors: an array of 60-bit lanes in longs.

Atoms come from md5(label # lane), so any engine can make them again. Binding is
exclusive or, distance is the number of differing bits, and a bundle is the strict
majority of each bit (a tie is 0). Two scales of similarity keep their names apart:
``sim01`` is 1 - d / D (random pairs 0.5), ``sim_pm1`` is 1 - 2 d / D (random pairs 0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch_dir, stored

LANE_BITS = 60
#: Lanes of the engine's vectors (10,020 bits) and of small ones that SQL checks.
LANES, SMALL = 167, 2


def atom(label: Column, lanes: int = SMALL) -> Column:
    one = lambda i: F.conv(F.substring(F.md5(F.concat(label, F.lit(f"#{i}")).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.array(*[one(i) for i in range(lanes)])


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def sim01(distance: Column, lanes: int) -> Column:
    return 1 - distance / (lanes * LANE_BITS)


def sim_pm1(distance: Column, lanes: int) -> Column:
    return 1 - 2 * distance / (lanes * LANE_BITS)


def counterfactual(hv: Column, old: Column, new: Column) -> Column:
    return bind(bind(hv, old), new)


def analogy(a: Column, b: Column, c: Column) -> Column:
    """a is to b as c is to what."""
    return bind(bind(c, a), b)


def permuted(hv: Column, steps: Column | int, lanes: int = SMALL) -> Column:
    """The vector rolled by so many bits: bit k goes to k + steps, the last bits come round to the front."""
    k = F.pmod(F.lit(steps) if isinstance(steps, int) else steps, F.lit(lanes * LANE_BITS))
    whole, part = F.floor(k / LANE_BITS).cast("int"), (k % LANE_BITS).cast("int")
    at = lambda i: F.get(hv, F.pmod(i - whole, F.lit(lanes)))
    rolled = lambda i: F.call_function("shiftleft", at(i), part).bitwiseAND(F.lit((1 << LANE_BITS) - 1)).bitwiseOR(F.call_function("shiftright", at(i - 1), F.lit(LANE_BITS) - part))
    return F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), rolled)


def packed(on: Column, lanes: int = SMALL) -> Column:
    """The vector whose bits stand in an array of numbers."""
    word = lambda i: F.aggregate(F.filter(on, lambda k: F.floor(k / LANE_BITS) == i), F.lit(0).cast("long"), lambda s, k: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (k % LANE_BITS).cast("int"))))
    return F.array(*[word(F.lit(i)) for i in range(lanes)])


def balanced_atom(label: Column, lanes: int = SMALL) -> Column:
    """A vector with exactly half its bits on: those whose md5(label # bit) come first; zeros for an empty label."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(lanes * LANE_BITS - 1)), lambda k: F.struct(F.md5(F.concat(label, F.lit("#"), k.cast("string")).cast("binary")).alias("h"), k.alias("k"))))
    on = F.transform(F.slice(order, 1, lanes * LANE_BITS // 2), lambda x: x["k"])
    return F.when(label == "", F.array(*[F.lit(0).cast("long")] * lanes)).otherwise(packed(on, lanes))


def bit_sums(rows: DataFrame, keys: list[str], hv: str = "hv", weight: Column | None = None) -> DataFrame:
    """keys, lane, bit, on (sum of the weights of rows with the bit on), all (of all rows); partial sums meet, so a group may be any size."""
    w = F.lit(1) if weight is None else weight
    lane = rows.select(*keys, w.alias("_w"), F.posexplode(hv).alias("_lane", "_word"))
    sums = [F.sum(F.when(F.shiftright("_word", i).bitwiseAND(F.lit(1)) == 1, F.col("_w")).otherwise(0)).alias(f"_{i}") for i in range(LANE_BITS)]
    summed = lane.groupBy(*keys, "_lane").agg(F.sum("_w").alias("all"), *sums)
    return summed.select(*keys, F.col("_lane").alias("lane"), "all", F.posexplode(F.array(*[F.col(f"_{i}") for i in range(LANE_BITS)])).alias("bit", "on"))


def from_bits(bits: DataFrame, keys: list[str], on: Column, lanes: int = SMALL) -> DataFrame:
    """keys, hv: the vector of the bits (lane, bit) for which a condition holds."""
    word = lambda i: F.sum(F.when(on & (F.col("lane") == i), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).otherwise(F.lit(0).cast("long")))
    return bits.groupBy(*keys).agg(F.array(*[word(i) for i in range(lanes)]).alias("hv"))


def weighted_bundle(rows: DataFrame, keys: list[str], weight: Column, hv: str = "hv", lanes: int = SMALL) -> DataFrame:
    """keys, hv: each bit that rows of more than half the weight have (sums to 9 decimals)."""
    return from_bits(bit_sums(rows, keys, hv, weight), keys, F.round(2 * F.col("on") - F.col("all"), 9) > 0, lanes)


def balanced_bundle(rows: DataFrame, keys: list[str], hv: str = "hv", lanes: int = SMALL) -> DataFrame:
    """keys, hv: the half of the bits that most rows have, ties by md5 of the bit's number."""
    from pyspark.sql import Window

    k = F.col("lane") * LANE_BITS + F.col("bit")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("on"), F.md5(k.cast("string").cast("binary"))))
    ranked = bit_sums(rows, keys, hv).withColumn("place", place)
    return from_bits(ranked, keys, F.col("place") <= lanes * LANE_BITS // 2, lanes)


def bind_all(pairs: Column, role, value) -> Column:
    """Array of role ^ value of an array's entries."""
    return F.transform(pairs, lambda x: bind(atom(role(x)), atom(value(x))))


#: Atoms of a codebook that is gathered in one row and broadcast.
BOOK = 4096


def snap(rows: DataFrame, book: DataFrame, label: str, hv: str = "hv", lanes: int = SMALL) -> DataFrame:
    """rows with nearest (a label of the book: label, hv) and distance, ties to the lower label.

    A book of up to ``BOOK`` atoms goes along with the rows as one row; a larger one becomes an index of sub-codes, with the same result.
    """
    if book.limit(BOOK + 1).count() > BOOK:
        return _snap_by_index(rows, book, label, hv, lanes)
    whole = book.groupBy().agg(F.collect_list(F.struct(F.col(label).alias("label"), F.col(hv).alias("hv"))).alias("_book"))
    near = F.array_min(F.transform("_book", lambda b: F.struct(hamming(F.col(hv), b["hv"]).alias("d"), b["label"].alias("label"))))
    found = rows.join(F.broadcast(whole), F.lit(True)).withColumn("_near", near)
    return found.select(*rows.columns, F.col("_near.label").alias("nearest"), F.col("_near.d").cast("long").alias("distance"))


def _snap_by_index(rows: DataFrame, book: DataFrame, label: str, hv: str, lanes: int) -> DataFrame:
    from ..operators import store, subcodes

    top = scratch_dir(rows.sparkSession)
    none = rows.sparkSession.createDataFrame([], "id long")
    numbered = stored(store.with_new_ids(none, book.select(F.col(label).alias("_label"), F.col(hv).alias("hv")), ["_label"]), f"{top}/book")
    asked = stored(rows.withColumn("_qid", F.monotonically_increasing_id()), f"{top}/rows")
    best = subcodes.nearest(subcodes.index(numbered.select("id", "hv"), 1, lanes), asked.select(F.col("_qid").alias("qid"), F.col(hv).alias("hv")), 1, lanes)
    named = best.join(numbered.select("id", "_label"), "id").select(F.col("qid").alias("_qid"), F.col("_label").alias("nearest"), "distance")
    return asked.join(named, "_qid").select(*rows.columns, "nearest", "distance")


def majority3(a: Column, b: Column, c: Column) -> Column:
    """The bundle of three vectors: each bit that two of them have."""
    two = F.zip_with(a, b, lambda x, y: F.struct(x.bitwiseAND(y).alias("both"), x.bitwiseOR(y).alias("one")))
    return F.zip_with(two, c, lambda p, z: p["both"].bitwiseOR(p["one"].bitwiseAND(z)))


def bundle(rows: DataFrame, keys: list[str], hv: str = "hv", lanes: int = SMALL) -> DataFrame:
    """keys, hv, n: the bit majority per group. Partial sums meet, so a group may be any size.

    Each lane's bits are summed as 60 counters of a lane row, all in built-in expressions.
    """
    lane = rows.select(*keys, F.posexplode(hv).alias("_lane", "_word"))
    bits = [F.sum(F.shiftright("_word", i).bitwiseAND(F.lit(1))).alias(f"_{i}") for i in range(LANE_BITS)]
    summed = lane.groupBy(*keys, "_lane").agg(F.count(F.lit(1)).alias("n"), *bits)
    word = sum((F.shiftleft((F.col(f"_{i}") * 2 > F.col("n")).cast("long"), i) for i in range(LANE_BITS)), F.lit(0).cast("long"))
    packed = summed.select(*keys, "n", F.struct("_lane", word.alias("w")).alias("_lw"))
    return packed.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list("_lw")), lambda x: x["w"]).alias("hv"))


def md5_atoms(words: list[str], lanes: int) -> np.ndarray:
    """The atoms of ``atom``: words x lanes."""
    return np.array([[int(hashlib.md5(f"{w}#{i}".encode()).hexdigest()[:15], 16) for i in range(lanes)] for w in words], np.int64).reshape(-1, lanes)


def wide_atoms(words: list[str], lanes: int) -> np.ndarray:
    """Atoms of many lanes: a 64-bit seed from one md5, the lanes from it by a counter and a mixing function."""
    seed = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:8] for w in words), "<u8")
    x = seed[:, None] + np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - LANE_BITS)).view(np.int64)


#: Words of a row that are added up at once, and such pieces of rows that are held at once.
PIECE, PIECES = 256, 512


def _add(planes: np.ndarray, more: np.ndarray) -> None:
    """Add numbers to counters, both held as bit planes: plane j has bit j of each, and the last ones take the carry."""
    carry = np.zeros_like(more[0])
    for j, plane in enumerate(planes):
        own = more[j] if j < len(more) else 0
        both = plane & own | carry & (plane ^ own)
        plane ^= own ^ carry
        carry = both


def majority(atoms: np.ndarray, word: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each row (words off[i] to off[i + 1], as numbers of atoms) the strict majority of each bit of its words' atoms.

    Rows are cut into pieces. The k-th words of all pieces are added at once to counters held as bit planes, so
    an addition is a few exclusive ors and ands of whole lanes; then the k-th pieces of all rows are.
    """
    n, lanes = len(off) - 1, atoms.shape[1]
    count = np.diff(off)
    pieces = -(-count // PIECE)
    row = np.repeat(np.arange(n), pieces)
    nth = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
    begin = off[row] + nth * PIECE
    size = np.minimum(off[row + 1] - begin, PIECE)
    order = np.argsort(-size, kind="stable")  # the long ones first, so those with a k-th word are a prefix
    row, nth, begin, size = row[order], nth[order], begin[order], size[order]
    planes = np.zeros((int(size.max(initial=0)).bit_length(), len(row), lanes), np.int64)
    for k in range(int(size.max(initial=0))):
        m = int(np.searchsorted(-size, -k))  # pieces of more than k words
        carry = atoms[word[begin[:m] + k]]
        for plane in planes[: (k + 1).bit_length()]:
            own = plane[:m]
            own ^= carry
            carry &= ~own
    total = np.zeros((int(count.max(initial=0)).bit_length(), n, lanes), np.int64)
    for k in range(int(pieces.max(initial=0))):
        at = np.flatnonzero(nth == k)
        part = total[:, row[at]]
        _add(part, planes[:, at])
        total[:, row[at]] = part
    over, same = np.zeros((n, lanes), np.int64), np.full((n, lanes), -1, np.int64)
    for j in range(len(total) - 1, -1, -1):  # which counters are over half the count, from the highest bit down
        half = -(count // 2 >> j & 1)[:, None]
        over |= same & total[j] & ~half
        same &= ~(total[j] ^ half)
    return over & ((1 << LANE_BITS) - 1)


def text_vectors(rows: DataFrame, *, lanes: int = LANES, atoms=wide_atoms) -> DataFrame:
    """id, hv of rows (id, words): the bundle of the atoms of a row's words, zeros without words."""

    def run(batches):
        for batch in batches:
            off = np.append(0, np.cumsum(batch.column("words").value_lengths().fill_null(0).to_numpy()))
            group = np.cumsum(np.diff(off) // PIECE + 1) // PIECES
            for a in np.searchsorted(group, np.unique(group)).tolist():
                part = batch.slice(a, int(np.searchsorted(group, group[a], "right")) - a)
                lists = part.column("words")
                flat = lists.flatten().dictionary_encode()
                own = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))
                hv = majority(atoms(flat.dictionary.to_pylist(), lanes), flat.indices.to_numpy(), own)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(np.arange(len(hv) + 1, dtype=np.int32) * lanes, hv.ravel())], names=["id", "hv"])

    return rows.select(F.col("id").cast("long").alias("id"), "words").mapInArrow(run, "id long, hv array<long>")


#: Bytes of queries that a pass over the rows takes along.
QUERY_BYTES = 1 << 26


def knn(rows: DataFrame, queries: DataFrame, k: int, *, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """qid, id, distance, rank of each query's k nearest rows (id, hv), ties to the lower id, all exact.

    The stated query set goes along with one pass over the rows while it has at most ``query_bytes`` bytes
    (50,000 queries of the full width); beyond, each such block has a pass of its own. Each part of the rows sends its k best
    per query only, so neither side is ever multiplied out. Rows and queries have the columns (id, hv) and (qid, hv).
    """

    def distance(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.stack([np.bitwise_count(v ^ x).sum(1, dtype=np.int64) for x in q])

    out = nearest(rows.select("id", F.col("hv").alias("v")), queries.select("qid", F.col("hv").alias("v")), k, distance, np.int64, "distance long", query_bytes)
    return top_k(out, ["qid"], [F.col("distance"), F.col("id")], k)


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def query_blocks(queries: DataFrame, query_bytes: int) -> Iterator[list]:
    """The queries in lists of so many bytes."""
    held, size = [], 0
    for r in queries.toLocalIterator(prefetchPartitions=True):
        held.append(r)
        size += 16 + 8 * len(r[1])
        if size >= query_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def nearest(rows: DataFrame, queries: DataFrame, k: int, distance, dtype, out: str, query_bytes: int, keep_self: bool = True) -> DataFrame:
    """qid, id, distance: for each part of rows (id, v) its k rows of least distance for each query (qid, v).

    distance(queries, rows) gives a matrix; a query's own row is left out unless keep_self. Where one pass
    isn't enough the rows are written once, so that what made them isn't done again for each pass.
    """
    spark, found = rows.sparkSession, None
    for k_th, block in enumerate(query_blocks(queries, query_bytes)):
        if k_th == 1:
            rows = stored(rows, f"{scratch_dir(spark)}/rows")
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], dtype)))
        part = rows.mapInArrow(_best(shared, k, distance, dtype, keep_self, out.split()[0]), f"qid long, id long, {out}")
        found = part if found is None else found.unionAll(part)
    return spark.createDataFrame([], f"qid long, id long, {out}") if found is None else found


def _best(shared, k: int, distance, dtype, keep_self: bool, name: str):
    def run(batches):
        qids, q = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = []  # of each chunk of queries: distances and ids, k at most for each
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column("id").to_numpy().astype(np.int64), matrix(batch.column("v"), dtype)
            for i, a in enumerate(range(0, len(qids), 64)):
                d = distance(q[a : a + 64], v)
                own = np.broadcast_to(ids, d.shape)
                if not keep_self:
                    d = np.where(own == qids[a : a + 64, None], np.inf, d)
                if i < len(best):
                    d, own = np.concatenate((best[i][0], d), 1), np.concatenate((best[i][1], own), 1)
                if d.shape[1] > k:  # only what is as near as the k-th can be among the best
                    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                    picks = []
                    for x, y, e in zip(d, own, edge[:, 0], strict=True):
                        near = np.flatnonzero(x <= e)
                        picks.append(near[np.lexsort((y[near], x[near]))[:k]])
                    pick = np.stack(picks)
                    d, own = np.take_along_axis(d, pick, 1), np.take_along_axis(own, pick, 1)
                if i < len(best):
                    best[i] = (d, own)
                else:
                    best.append((d, own))
        for i, (d, own) in enumerate(best):
            n = d.shape[1]
            t = pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[i * 64 : i * 64 + 64], n)), pa.array(own.ravel()), pa.array(d.ravel())], names=["qid", "id", name])
            yield t if keep_self else t.filter(pa.array(np.isfinite(d.ravel())))

    return run


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
