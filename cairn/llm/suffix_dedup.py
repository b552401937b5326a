"""Exact substring deduplication with two-stage suffix sorting.

A byte of a document goes if a string of ``length`` (50) bytes that covers it also starts in a
document with a smaller id. Whole suffix arrays don't shard, so suffixes meet by anchors:

1. In each document every window of 50 bytes picks its 20-byte grams of least hash as
   anchors (winnowing, about one per 16 bytes), so equal windows pick equal anchors at
   equal places. An anchor's context is the 80 bytes that all windows around it cover.
   Each batch sends a row for an anchor and context of its smallest document only; the
   others of the batch are covered whole already.
2. Rows meet by anchor, sorted by anchor, context and document, and stream by. Of equal contexts, all documents but the smallest are covered
   whole. What then is left of an anchor with several contexts and documents goes on.
3. The text of those contexts is cut out of the documents and meets again by anchor
   (by anchor and 15 bytes on either side where an anchor has many contexts: any window
   holds one of the two). Each part is suffix-sorted in two stages: only the suffixes that
   are smaller than their successors are sorted directly, all others are induced by one
   scan over the buckets of first bytes. Common prefixes of neighbours then give the runs
   of equal windows, and the smallest document of each run.
4. The covered spans of a document are joined to its text, merged and cut out.

Anchors and contexts are compared by 64-bit hashes each (two contexts that differ pass for equal with a
chance of 2^-64 among those of one anchor); the texts of what is left are compared as bytes.

Edge cases: a null or empty text, or one under 50 bytes, loses nothing; rows that repeat a
doc_id, with equal or other texts, take nothing from each other, as neither id is smaller, and each gets its own result; a
null doc_id takes no part and loses nothing; equal rows are cut alike and compared once; texts of any length are read whole, as
one array of bytes; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, discard, longs, mix, scratch_dir, small_batches, stored, string_buffers

GRAM = 20
#: Bytes of text for each part of a shuffle, contexts of an anchor from which it is split, bytes of contexts sorted at once.
PART_BYTES, MANY, SORTED = 1 << 23, 4096, 1 << 21


# --- two-stage suffix sorting -------------------------------------------------


def words_at(text: np.ndarray, room: int = 64) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number (zeros beyond the end)."""
    padded = np.zeros(len(text) + room + 8, np.uint8)
    padded[: len(text)] = text
    return np.ndarray((len(text) + room,), ">u8", padded.tobytes(), 0, (1,)).astype(np.uint64)


def _direct(w: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at ``at`` sorted by their first ``depth`` bytes, eight at a time; only ties are looked at again."""
    order = np.argsort(w[at], kind="stable")
    at = at[order]
    key = w[at]
    group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))) if len(at) else np.zeros(0, np.int64)
    for d in range(8, depth, 8):
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = group[1:] == group[:-1]
        tied = np.flatnonzero(same[1:] | same[:-1])
        if not len(tied):
            break
        key, g = w[at[tied] + d], group[tied]
        o = np.lexsort((key, g))
        at[tied], key, g = at[tied][o], key[o], g[o]
        step = np.zeros(len(at), np.int64)
        step[tied[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(step)
    return at


def suffix_array(text: np.ndarray, depth: int = 50) -> np.ndarray:
    """All suffixes, sorted by their first ``depth`` bytes at least."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.sign(np.diff(text.astype(np.int16)))
    ahead = np.where(step != 0, np.arange(n - 1), n - 1)
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]
    small = np.append(np.append(step, -1)[ahead] > 0, False)  # smaller than its successor; the last one isn't
    direct = _direct(words_at(text), np.flatnonzero(small), depth)
    cut = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))

    def scan(part: np.ndarray) -> None:
        before = part[part > 0] - 1
        before = before[~small[before]]
        if len(before):
            first = text[before]
            before = before[np.argsort(first, kind="stable")]
            ends = np.cumsum(np.bincount(first, minlength=256))
            for c in np.unique(first).tolist():
                induced[c].append(before[ends[c - 1] if c else 0 : ends[c]])

    out = []
    for c in range(256):
        k = 0
        while k < len(induced[c]):  # grows while runs of c induce each other
            scan(induced[c][k])
            out.append(induced[c][k])
            k += 1
        own = direct[cut[c] : cut[c + 1]]
        scan(own)
        out.append(own)
    return np.concatenate(out)


def common_prefixes(w: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that neighbours in order share, up to ``most``; w from words_at."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for d in range(0, most, 8):
        x = w[a[live] + d] ^ w[b[live] + d]
        out[live] += sum((x < np.uint64(1 << k)).astype(np.int64) for k in range(8, 64, 8)) + (x == 0)
        live = live[x == 0]
    return np.minimum(out, most)


# --- anchors ------------------------------------------------------------------


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w neighbours."""
    done = 1
    while done * 2 <= w:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[: len(x) - (w - done)], x[w - done :]) if done < w else x


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place (in data) of the anchors, and the hash of each one's context with its bounds."""
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n, w = len(data), length - GRAM + 1
    if n < length:
        return empty
    rolling = Rolling(data)
    h = rolling.all(GRAM)
    far = np.iinfo(np.uint64).max
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    bad = row[: len(h)] != row[GRAM - 1 :]
    h = np.minimum(h, far - np.uint64(1))
    h[bad] = far
    least = _slide(h, w, np.minimum)
    least[row[: len(least)] != row[length - 1 :]] = 0
    padded = np.zeros(len(h) + w - 1, np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    at = np.flatnonzero((_slide(padded, w, np.maximum) == h) & ~bad)
    r = row[at]
    lo, hi = context(at, off[r], off[r + 1], length)
    c = mix(rolling(lo, hi) + (at - lo).astype(np.uint64))
    return h[at], r, at, c


def context(at: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(at - (length - GRAM), begin), np.minimum(at + length, end)


def _covered(h, c, doc):
    """Order by anchor, context, document; true where a smaller document has the same two."""
    o = np.lexsort((doc, c, h))
    h, c, doc = h[o], c[o], doc[o]
    first = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))) if len(o) else np.zeros(0, bool)
    least = doc[np.flatnonzero(first)][np.cumsum(first) - 1] if len(o) else doc
    return o, doc > least


def merge(doc: np.ndarray, u: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each text (doc, u), sorted, those that touch or overlap joined."""
    if not len(s):
        return doc, u, s, e
    o = np.lexsort((s, u, doc))
    doc, u, s, e = doc[o], u[o], s[o], e[o]
    number = np.cumsum(np.concatenate(([False], (doc[1:] != doc[:-1]) | (u[1:] != u[:-1]))))
    shift = number * (int(e.max()) + 2)
    reach = np.maximum.accumulate(e + shift)
    first = np.concatenate(([True], (s + shift)[1:] > reach[:-1]))
    at = np.flatnonzero(first)
    return doc[at], u[at], s[at], (reach - shift)[np.append(at[1:] - 1, len(s) - 1)]


FIELDS = "h long, c long, doc long, u long, at int, stop int, many boolean"
NAMES = ["h", "c", "doc", "u", "at", "stop", "many"]


def _rows(h, c, doc, u, at, stop, many=None):
    n = len(doc)
    ints = [pa.array(x, pa.int32()) for x in (at, stop)]
    return pa.RecordBatch.from_arrays([longs(h), pa.nulls(n, pa.int64()) if c is None else longs(c), longs(doc), longs(u), *ints, pa.array(np.zeros(n, bool) if many is None else many)], names=NAMES)


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """Rows of anchors (h, c, doc, u, at; stop: where the text ends for contexts near it) and of spans covered within a batch (h: a hash of the row, c null)."""

    def run(batches):
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            ids, key = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("doc", "u"))
            h, r, at, c = anchors(data, off, length)
            o, gone = _covered(h, c, ids[r])
            h, r, at, c = h[o], r[o], at[o], c[o]
            s, e = context(at[gone], off[r[gone]], off[r[gone] + 1], length)
            d, u, s, e = merge(ids[r[gone]], key[r[gone]], s - off[r[gone]], e - off[r[gone]])
            yield _rows(mix((u ^ s).view(np.uint64)), None, d, u, s, e)
            go = ~gone
            # the context's end, unless the text goes on beyond it
            end = np.minimum(off[r[go] + 1] - at[go], length)
            yield _rows(h[go], c[go], ids[r[go]], key[r[go]], at[go] - off[r[go]], end)

    return docs.mapInArrow(run, FIELDS)


def _decided(x: list[np.ndarray], known: int | None):
    """The rows of whole anchors that go on: those with several documents, or of the anchor that is known to; many: with many contexts."""
    h, c, doc, u, at, stop, sent = x
    if not len(h):
        return
    first = np.concatenate(([True], h[1:] != h[:-1]))
    group = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    several = np.maximum.reduceat(doc, begin) != np.minimum.reduceat(doc, begin)
    many = np.diff(np.append(begin, len(h))) > MANY
    if known is not None and h[0] == known:
        several[0] = many[0] = True
    keep = several[group] & ~sent
    yield _rows(h[keep], c[keep], doc[keep], u[keep], at[keep], stop[keep], many[group[keep]])


def meet(rows: DataFrame, length: int) -> DataFrame:
    """Spans (c null) and the anchors still to be compared (c not null; many: of an anchor with many contexts), from rows sorted by h, c, doc.

    Only the rows of the anchor that a batch ends in are held, and no longer than until it has over MANY of them
    in several documents; the row that may cover those to come goes before the next batch.
    """

    def run(batches):
        held, n, docs, known, last = [], 0, set(), None, None
        for batch in batches:
            is_span = batch.column("c").is_null().to_numpy(zero_copy_only=False)
            if is_span.any():
                yield batch.filter(pa.array(is_span))
                batch = batch.filter(pa.array(~is_span))
            if not batch.num_rows:
                continue
            x = [batch.column(k).to_numpy().astype(np.int64) for k in NAMES[:-1]] + [np.zeros(batch.num_rows, bool)]
            if last is not None:
                x = _joined([last, x])
            h, c, doc, u, at, stop, _ = x
            first = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
            gone = doc > doc[np.flatnonzero(first)][np.cumsum(first) - 1]  # the first of a run is the smallest
            yield _spans(doc[gone], u[gone], at[gone], stop[gone], length)
            x = [y[~gone] for y in x]
            begin = int(np.argmax(x[0] == x[0][-1]))  # of the anchor that the batch ends in
            if begin:
                yield from _decided(_joined([*held, [y[:begin] for y in x]]), known)
                held, n, docs, known = [], 0, set(), None
            part = [y[begin:] for y in x]
            held.append(part)
            n += len(part[0])
            docs |= {int(part[2].min()), int(part[2].max())} if len(docs) < 2 else set()
            if known is not None or (n > MANY and len(docs) > 1):
                known = int(part[0][0])
                yield from _decided(_joined(held), known)
                held = []
            run_ = np.flatnonzero(part[1] == part[1][-1])[:1]
            last = [*(y[run_] for y in part[:-1]), np.ones(1, bool)]
        if held:
            yield from _decided(_joined(held), known)

    return rows.mapInArrow(run, FIELDS)


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(p) for p in zip(*parts, strict=True)]


def _spans(doc, u, at, stop, length):
    d, u, s, e = merge(doc, u, np.maximum(at - (length - GRAM), 0), at + stop)
    return _rows(np.zeros(len(d), np.int64), None, d, u, s, e)


# --- contexts -----------------------------------------------------------------


def cut_contexts(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """key, doc, u, start (of the context in the text) and piece (its bytes) for each place."""
    listed = places.groupBy("doc", "u").agg(F.collect_list(F.struct("h", "at", "many")).alias("p"))

    def run(batches):
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            p = batch.column("p")
            count = np.diff(p.offsets.to_numpy())
            flat = p.flatten()
            h, at, many = flat.field("h").to_numpy(), flat.field("at").to_numpy().astype(np.int64), flat.field("many").to_numpy(zero_copy_only=False)
            r = np.repeat(np.arange(batch.num_rows), count)
            begin, end = off[r], off[r + 1]
            at = at + begin
            lo, hi = context(at, begin, end, length)
            rolling, half = Rolling(data), (length - GRAM) // 2
            key = np.where(many, mix(h.view(np.uint64) ^ rolling(np.maximum(at - half, lo), at)), h.view(np.uint64))
            again = np.flatnonzero(many)
            other = mix(h[again].view(np.uint64) ^ mix(rolling(at[again] + GRAM, np.minimum(at[again] + GRAM + half, hi[again]))))
            pick = np.concatenate((np.arange(len(h)), again))
            lo, hi, r = lo[pick], hi[pick], r[pick]
            size = hi - lo
            offsets = np.append(0, np.cumsum(size))
            byte = np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], size)
            pieces = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[byte] if len(byte) else b"")])
            ids = [batch.column(x).take(pa.array(r)) for x in ("doc", "u")]
            yield pa.RecordBatch.from_arrays([longs(np.concatenate((key, other))), *ids, pa.array(lo - off[r], pa.int32()), pieces], names=["key", "doc", "u", "start", "piece"])

    return docs.join(listed, ["doc", "u"]).select("doc", "u", "text", "p").mapInArrow(run, "key long, doc long, u long, start int, piece binary")


def compare(pieces: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The merged spans (doc, u, start, end) of the windows of the pieces that a smaller document's piece holds too."""
    data, off = string_buffers(pieces.column("piece"))
    doc, u, start = (pieces.column(x).to_numpy().astype(np.int64) for x in ("doc", "u", "start"))
    r = np.repeat(np.arange(len(doc)), np.diff(off))
    order = suffix_array(data, length)
    order = order[order + length <= off[r[order] + 1]]
    if not len(order):
        return doc[:0], u[:0], start[:0], start[:0]
    shared = common_prefixes(words_at(data), order, length) >= length
    first = np.flatnonzero(np.concatenate(([True], ~shared)))
    own = doc[r[order]]
    run = np.cumsum(np.concatenate(([0], ~shared)))
    gone = own > np.minimum.reduceat(own, first)[run]
    at = order[gone]
    s = at - off[r[at]] + start[r[at]]
    return merge(own[gone], u[r[at]], s, s + length)


def compared(contexts: DataFrame, length: int) -> DataFrame:
    """doc, u, at, stop: spans, from contexts that come sorted by key."""

    def out(rows):
        d, u, s, e = compare(pa.Table.from_batches(rows), length)
        return pa.RecordBatch.from_arrays([longs(d), longs(u), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["doc", "u", "at", "stop"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size > SORTED:  # cut at the first change of the key
                key = batch.column("key").to_numpy()
                change = np.flatnonzero(key != held[-1].column("key")[-1].as_py())
                if len(change):
                    yield out([*held, batch.slice(0, change[0])])
                    batch, held, size = batch.slice(change[0]), [], 0
            held.append(batch)
            size += batch.column("piece").nbytes
        if held:
            yield out(held)

    return contexts.mapInArrow(run, "doc long, u long, at int, stop int")


# --- the operator -------------------------------------------------------------


def each_once(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc, u, text) with rows that are repeated taken once; only the texts of such rows move."""
    again = stored(docs.groupBy("doc", "u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", "u"), path)
    if again.isEmpty():
        return docs
    once = docs.join(again, ["doc", "u"], "left_semi").groupBy("doc", "u").agg(F.first("text").alias("text"))
    return docs.join(again, ["doc", "u"], "left_anti").unionByName(once)


def covered_spans(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """doc, u and spans (array of start and stop, not yet merged) of the texts (doc, u: a hash that tells the texts of a doc apart, text) that lose bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    top = scratch_dir(spark)
    docs = each_once(docs, f"{top}/again")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(size) // PART_BYTES)
    sorted_ = anchor_rows(docs, length).repartition(parts, "h").sortWithinPartitions("h", "c", "doc")
    found = stored(meet(sorted_, length), f"{top}/found")
    contexts = cut_contexts(docs, found.where("c is not null").select("h", "doc", "u", "at", "many"), length)
    contexts = contexts.repartition(parts, "key").sortWithinPartitions("key")
    more = stored(compared(contexts, length), f"{top}/more")
    spans = found.where("c is null").select("doc", "u", "at", "stop").union(more)
    spans = stored(spans.groupBy("doc", "u").agg(F.collect_list(F.struct("at", "stop")).alias("spans")), f"{top}/spans")
    discard(spark, f"{top}/found", f"{top}/more")
    return spans


def cut_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for each row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).withColumn("u", F.xxhash64("doc", "text"))
    spans = covered_spans(own.where("doc is not null and octet_length(text) >= " + str(length)), length=length)

    def run(batches):
        for batch in batches:
            texts, p = batch.column("text"), batch.column("spans")
            sizes, removed, count, kept = [], [], [], []
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode()
                own = p[i].values
                s, e = (own.field(x).to_numpy().astype(np.int64) for x in ("at", "stop")) if own is not None else (np.zeros(0, np.int64),) * 2
                same = np.zeros(len(s), np.int64)
                _, _, s, e = merge(same, same, s, e)
                ends = [0, *e.tolist()]
                sizes.append(len(raw))
                removed.append(int((e - s).sum()))
                count.append(len(s))
                kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*s.tolist(), len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return own.join(spans, ["doc", "u"], "left").select("doc", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_documents(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
