"""Size-partitioned MinHash containment search of short items in long documents, verified exactly.

An item is contained in a document if the document holds at least num/den of the item's
distinct word shingles. Items are partitioned by size (1, 2-3, 4-7, ... shingles). An item of n
shingles may miss m = n - ceil(n num / den) of them, so a document that contains it holds one at least
of the item's m + 1 smallest hashes: these are its MinHash signature. A document's sketch
for a partition is all its hashes up to the largest that a signature of the partition has
(a MinHash of fixed threshold, so it grows with the document and serves a passage of
30 shingles in 20,000 words as well as one in 40). Signatures that meet a sketch, of documents with as many
shingles as the item needs, are candidates; no item is missed, whatever its place. Candidates are verified with all of
the item's shingles, compared as words.

Banded signatures of a fixed length can't do the middle step: that passage has a Jaccard
similarity of 0.0015 with its document.

The items' signatures and texts are broadcast while they have at most ``broadcast_rows``
rows and BROADCAST_BYTES bytes; beyond that, the documents' sketches are joined with them
by a shuffle. Both give the same rows.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered, so changes of
case, punctuation and white space don't hide an item.

Edge cases: a null or empty text, or one without words, contains nothing; an item with
fewer words than a shingle is one shingle of all its words; items without words match
nothing; repeated rows give repeated pairs of a document row and an item once each; a null
doc_id or item_id is a value like others; an empty table gives no rows; an item table with repeated ids counts each row's text, and
of the texts of one id that a document row contains the one that shares most gives the
row (the shorter of two that share as much). ``drop_contaminated`` decides by row, not by id, and
carries all columns, whatever their names; ``contained`` returns ids only. Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, longs, row_groups, scratch_dir, shingles, small_batches, stored, string_buffers, word_bounds, word_hashes

#: Signature rows (32 bytes each) and bytes of item texts that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 20, 1 << 26
#: True at the bytes that part words: ASCII but letters and digits.
PARTING = np.ones(256, bool)
PARTING[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _shingles(column: pa.Array, k: int, a: int, b: int):
    data, off = string_buffers(column.slice(a, b - a))
    return shingles(*word_hashes(data, off, PARTING), k)


def numbered(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """number, item, text: each text of an item once, with a number of its own; stored, so that the numbers stay."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    return stored(rows.select(F.monotonically_increasing_id().alias("number"), "item", "text"), f"{scratch_dir(items.sparkSession)}/items")


def signatures(items: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """number, width (words of a shingle), part (of the item's size), hash, n (distinct shingles of the item): a row for each hash of a signature."""

    def run(batches):
        for batch in batches:
            ids = batch.column("number")
            data, off = string_buffers(batch.column("text"))
            words, woff = word_hashes(data, off, PARTING)
            h, soff = shingles(words, woff, k)
            width = np.minimum(np.diff(woff), k)
            for i in range(batch.num_rows):
                own = np.unique(h[soff[i] : soff[i + 1]])
                n = len(own)
                own = own[: n + 1 - -(-n * num // den)]
                m = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i].as_py()] * m, pa.int64()), longs(np.full(m, width[i])), longs(np.full(m, n.bit_length())), longs(own), longs(np.full(m, n))], names=["number", "width", "part", "hash", "n"])

    return items.select("number", "text").mapInArrow(lean(run), "number long, width long, part long, hash long, n long")


def _words(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return []
    low = data.tobytes().lower()
    return [low[s:e] for s, e in zip(*(x.tolist() for x in word_bounds(~PARTING[data], np.array([0, len(data)]))), strict=True)]


def _exact(text: str, width: int, k: int) -> set[tuple[bytes, ...]]:
    """A text's shingles as words: of width words, where a text of fewer words than k is one shingle."""
    w = _words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def contained(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, num: int = 80, den: int = 100, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_shared: one row for each document row and item that it contains."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    search = Search(items, item_id, item_text, k, num, den, broadcast_rows)
    if search.shared is None:
        return search.shuffled(rows).select("doc_id", "item_id", "n_shingles", "n_shared")

    def run(batches):
        for batch in batches:
            ids, out = batch.column("doc"), []
            for r, hits in search.local(batch.column("text")):
                doc = ids[r].as_py()
                out += [(doc, *hit) for hit in hits]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_shingles", "n_shared"])

    return rows.mapInArrow(lean(run), "doc_id long, item_id long, n_shingles long, n_shared long")


class Search:
    """A search for items; shared holds their signatures and texts where those may be broadcast."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, broadcast_rows: int = BROADCAST_ROWS):
        spark = items.sparkSession
        small_batches(spark)
        given = numbered(items, id_col, text_col)
        signature = stored(signatures(given, k, num, den), f"{scratch_dir(spark)}/signatures")
        # the sketches' thresholds, unsigned, by size partition and width: a few rows
        limit = F.max(F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))).alias("most")
        self.sketches = [(r.part, r.width, r.most ^ -(1 << 63), r.least) for r in signature.groupBy("part", "width").agg(limit, F.min("n").alias("least")).collect()]
        self.k, self.num, self.den, self.shared = k, num, den, None
        size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        if signature.count() <= broadcast_rows and size <= BROADCAST_BYTES:
            sig = signature.toPandas()
            wanted = given.toArrow()
            number, item, text = (wanted[c].to_pylist() for c in ("number", "item", "text"))
            by = {}
            for part, width, *_ in self.sketches:
                own = sig[(sig.part == part) & (sig.width == width)]
                h = own.hash.to_numpy(np.int64).view(np.uint64)
                o = np.argsort(h, kind="stable")
                by[part, width] = (h[o], own.number.to_numpy()[o], own.n.to_numpy()[o])
            self.shared = spark.sparkContext.broadcast((by, dict(zip(number, zip(item, text, strict=True), strict=True))))
        else:
            self.given, self.signature = given, signature

    def __getstate__(self):
        return {x: y for x, y in self.__dict__.items() if x not in ("given", "signature")}

    def sketched(self, words: np.ndarray, woff: np.ndarray):
        """(part, width, hashes, their rows) of the rows' sketches, for rows with as many shingles and words as the partition's smallest item needs."""
        made = {x: shingles(words, woff, x) for x in {width for _, width, *_ in self.sketches}}
        for part, width, most, least in self.sketches:
            h, soff = made[width]
            enough = (np.diff(soff) >= -(-least * self.num // self.den)) & (np.diff(woff) >= width)
            row = np.repeat(np.arange(len(woff) - 1), np.diff(soff))
            at = np.flatnonzero((h <= np.uint64(most & (1 << 64) - 1)) & enough[row])
            yield part, width, h[at], row[at]

    def local(self, texts: pa.Array):
        """(row, hits) of the rows that contain items; hits: (item, n, shared)."""
        by, wanted = self.shared.value
        data, off = string_buffers(texts)
        for a, b in row_groups(off):
            words, woff = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a], PARTING)
            found: dict[int, set] = {}
            for part, width, own, row in self.sketched(words, woff):
                sh, si, sn = by[part, width]
                lo, hi = np.searchsorted(sh, own), np.searchsorted(sh, own, "right")
                for at in np.flatnonzero(hi > lo).tolist():
                    found.setdefault(int(row[at]), set()).update((i, width) for i in si[lo[at] : hi[at]].tolist())
            for r in sorted(found):
                hits = list(_verify(texts[a + r].as_py(), sorted(found[r]), wanted, self.k, self.num, self.den))
                if hits:
                    yield a + r, hits

    def shuffled(self, rows: DataFrame) -> DataFrame:
        """doc_id, _t, _u (with doc_id the key of a row: rows equal in it are copies), item_id, n_shingles, n_shared, by joins."""
        sketched, k, num, den = self.sketched, self.k, self.num, self.den
        keyed = rows.select("doc", "text", F.xxhash64("text").alias("_t"), F.xxhash64(F.lit(1), "text").alias("_u"))

        def hashes(batches):
            for batch in batches:
                data, off = string_buffers(batch.column("text"))
                words, woff = word_hashes(data, off, PARTING)
                for part, width, h, row in sketched(words, woff):
                    key = np.unique(np.stack([row, h.view(np.int64)]), axis=1)
                    n, take = key.shape[1], pa.array(key[0])
                    own = [batch.column(c).take(take) for c in ("doc", "_t", "_u")]
                    yield pa.RecordBatch.from_arrays([*own, longs(np.full(n, part)), longs(np.full(n, width)), longs(key[1])], names=["d", "t", "u", "part", "width", "hash"])

        def check(batches):
            for batch in batches:
                out = []
                for row, doc, t, u, text, number, item, width, wanted in zip(*(batch.column(c).to_pylist() for c in ("row", "doc", "_t", "_u", "text", "number", "item", "width", "wanted")), strict=True):
                    out += [(row, doc, t, u, *hit) for hit in _verify(text or "", [(number, width)], {number: (item, wanted)}, k, num, den)]
                cols = list(zip(*out, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "doc_id", "_t", "_u", "item_id", "n_shingles", "n_shared"])

        found = keyed.mapInArrow(lean(hashes), "d long, t long, u long, part long, width long, hash long").join(self.signature, ["part", "width", "hash"]).select("d", "t", "u", "number", "width").distinct()
        each = keyed.withColumn("row", F.monotonically_increasing_id())
        same = F.col("d").eqNullSafe(F.col("doc")) & (F.col("t") == F.col("_t")) & (F.col("u") == F.col("_u"))
        full = found.join(each, same).join(self.given.withColumnRenamed("text", "wanted"), "number")
        hits = full.mapInArrow(lean(check), "row long, doc_id long, _t long, _u long, item_id long, n_shingles long, n_shared long")
        best = hits.groupBy("row", "doc_id", "_t", "_u", "item_id").agg(F.max(F.struct("n_shared", (-F.col("n_shingles")).alias("less"))).alias("best"))
        return best.select("doc_id", "_t", "_u", "item_id", (-F.col("best.less")).alias("n_shingles"), F.col("best.n_shared").alias("n_shared"))


def _verify(text: str, found, wanted: dict, k: int, num: int, den: int):
    """(item, n, shared) of the candidate (number, width) pairs that hold, once for each item: of its texts the one that shares most, then the shorter."""
    own: dict[int, set] = {}
    best: dict = {}
    for number, width in found:
        if width not in own:
            own[width] = _exact(text, width, k)
        item, item_text = wanted[number]
        shingle = _exact(item_text, width, k)
        both = len(shingle & own[width])
        if shingle and den * both >= num * len(shingle):
            best[item] = max(best.get(item, (0, 0)), (both, -len(shingle)))
    for item, (both, less) in best.items():
        yield item, -less, both


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, num: int = 80, den: int = 100, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that contain no item."""
    search = Search(items, item_id, item_text, k, num, den, broadcast_rows)
    if search.shared is None:
        lost = search.shuffled(docs.select(F.lit(None).cast("long").alias("doc"), F.col(text_col).alias("text"))).select("_t", "_u").distinct()
        text = F.coalesce(docs[text_col], F.lit(""))  # a row without text contains nothing, nor does an empty one
        return docs.join(lost, (F.xxhash64(text) == lost["_t"]) & (F.xxhash64(F.lit(1), text) == lost["_u"]), "left_anti")
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[r for r, _ in search.local(batch.column(at))]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(lean(run), docs.schema)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return contained(docs, items)


ORACLE = r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
sh AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n FROM sh WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n) AS n_shingles, count(*) AS n_shared
FROM sh b JOIN sh d ON d.kind = 0 AND b.kind = 1 AND b.s = d.s JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING 100 * count(*) >= 80 * any_value(n.n)
"""
