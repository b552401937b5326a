"""Byte-level BPE encoding and decoding with numpy matrices.

A text is cut into pieces by a pattern. Pieces of similar length, as byte-token ids,
form the rows of one padded matrix. Each round finds in every row the leftmost pair
of minimum rank, by lookups in an open-addressed hash table of pairs, puts the merged
id in its place and closes the gap (compaction); rows with nothing left to merge leave
the matrix. Pieces already seen are taken from a bounded cache, so a batch merges
distinct new pieces only.

A merge can only give pairs of a larger rank, if no pair with the merged id has a smaller
one; then all pairs of the minimum rank in a row, from the left and without overlap, are
merged in one round, with the same result. In long pieces that is most merges, so a piece of
any length takes about as many rounds as it has different merges.

Edge cases: a null or empty text has no ids; special tokens' strings are ordinary
text; repeated rows get equal results; an empty table gives no rows; very long texts and pieces are
matrix rows like others, a few at a time; columns of the input named like an output column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, texts_of

#: Bytes of pieces from which a row merges all pairs of its minimum rank in a round, and pieces kept in a worker's cache.
LONG, CACHED = 64, 100_000
NONE = np.int32(2**31 - 1)


#: Letters, numbers and white space among the code points below U+0250.
LETTERS, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
BEYOND = re.compile("[\u0250-\U0010ffff]")


def latin_pattern(pattern: str) -> str:
    """The pattern with \\p{L}, \\p{N}, \\s and \\S spelt out for texts below U+0250."""

    def spelt(m: re.Match) -> str:
        inner = m[0][1:-1] if m[0][0] == "[" else m[0]
        for name, chars in ((r"\p{L}", LETTERS), (r"\p{N}", NUMBERS), (r"\s", SPACES)):
            inner = inner.replace(name, chars)
        return f"[^{SPACES}]" if inner == r"\S" else f"[{inner}]"

    return re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", spelt, pattern)


class PairTable:
    """(left id, right id) -> merged id, in an open-addressed table with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 2.5))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], merged[won]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NONE where a pair doesn't merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.latin = re.compile(latin_pattern(pattern)) if set(re.findall(r"\\.", pattern)) <= {r"\s", r"\S", r"\p"} else None
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[p[:k]], ranks[p[k:]], i) for p, i in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks]
        pairs = np.array(pairs, np.int64).reshape(-1, 3)
        self.pairs = PairTable(*pairs.T)
        least = np.full(len(self.pieces), np.iinfo(np.int64).max)  # of the merges that an id takes part in
        np.minimum.at(least, pairs[:, 0], pairs[:, 2])
        np.minimum.at(least, pairs[:, 1], pairs[:, 2])
        self.together = least > np.arange(len(least))
        self.cache: dict[str, bytes] = {}

    @classmethod
    def read(cls, path: str, pattern: str) -> ByteBPE:
        """Ranks from a file of lines "base64 rank"."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def merge_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces (as little-endian 32-bit integers) of similar length."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        width = int(length.max())
        inside = np.arange(width) < length[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((n, width), NONE, np.int32)  # of the pair that begins here
        if width > 1:
            both = inside[:, 1:]
            rank[:, :-1][both] = self.pairs(ids[:, :-1][both], ids[:, 1:][both])
        row, done = np.arange(n), [b""] * n
        while len(row):
            at = rank.argmin(axis=1)
            lane = np.arange(len(row))
            best = rank[lane, at]
            over = best == NONE
            if over.any():
                ends = np.flatnonzero(over)
                for r, x, k in zip(row[ends].tolist(), ids[ends], length[ends].tolist(), strict=True):
                    done[r] = x[:k].astype("<u4").tobytes()
                go = ~over
                row, ids, rank, at, best, length = row[go], ids[go], rank[go], at[go], best[go], length[go]
                lane = np.arange(len(row))
                if not len(row):
                    break
            ids[lane, at] = best
            shift = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(shift, rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = -1, NONE
            length -= 1
            width = int(length.max())
            ids, rank = ids[:, :width], rank[:, :width]
            has = at < length - 1
            rank[lane, at] = NONE
            x = lane[has]
            rank[x, at[has]] = self.pairs(ids[x, at[has]], ids[x, at[has] + 1])
            x = lane[at > 0]
            rank[x, at[x] - 1] = self.pairs(ids[x, at[x] - 1], ids[x, at[x]])
        return done

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one row, a long piece: all pairs of the minimum rank at once, where that is the same."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        rank = self.pairs(ids[:-1], ids[1:])
        while len(rank):
            best = int(rank.min())
            if best == NONE:
                break
            at = np.flatnonzero(rank == best) if self.together[best] else np.array([int(rank.argmin())])
            if len(at) > 1:  # of pairs that overlap every other one, from the left
                begins = np.concatenate(([True], np.diff(at) > 1))
                first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            place = at - np.arange(len(at))  # of the merged ids
            rank = np.append(rank, NONE)[keep][:-1]
            for x in (place, place - 1):
                x = x[(x >= 0) & (x < len(rank))]
                rank[x] = self.pairs(ids[x], ids[x + 1])
        return ids.astype("<u4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, bucketed by length (1, 2, 3-4, 5-8 ... bytes); rows over LONG bytes have a matrix of their own."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > LONG:
                out[i] = self.merge_long(p)
            else:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            most = max(64, 400_000 >> width)
            for k in range(0, len(rows), most):
                for i, x in zip(rows[k : k + most], self.merge_matrix([pieces[i] for i in rows[k : k + most]]), strict=True):
                    out[i] = x
        return out

    def split(self, text: str) -> list[str]:
        """The pattern's matches; texts in Latin letters only take the standard library's faster engine."""
        return (self.pattern if self.latin is None or BEYOND.search(text) else self.latin).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0

        def flush():
            known = self.cache
            fresh = list({p for pieces in group for p in pieces} - known.keys())
            known.update(zip(fresh, self.merge([p.encode() for p in fresh]), strict=True))
            get = known.__getitem__
            out.extend(b"".join(map(get, pieces)) for pieces in group)
            group.clear()
            if len(known) > CACHED:
                for p in fresh:
                    del known[p]

        for text in texts:
            group.append(self.split(text))
            size += len(text)
            if size > 1 << 20:
                flush()
                size = 0
        flush()
        return out

    def decode(self, ids: bytes) -> bytes:
        get = self.pieces.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str) -> ByteBPE:
    return ByteBPE.read(path, pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, *, text_col: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """keep's columns (all but the text, if None) and n_tokens, ids (array of long).

    With digests, ids_sha256 and decoded_sha256 stand in place of the ids: the digests
    of the ids' bytes and of the bytes that decoding these ids gives.
    """
    small_batches(df.sparkSession)
    made = {"n_tokens": "long"} | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {"ids": "array<long>"})
    keep = [c for c in (df.columns if keep is None else keep) if c not in made and (keep is not None or c != text_col)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"{k} {v}" for k, v in made.items()])

    def run(batches):
        bpe = _tokenizer(path, pattern)
        for batch in batches:
            ids = bpe.encode(texts_of(batch, len(keep)))
            cols = [batch.column(i) for i in range(len(keep))] + [pa.array([len(x) // 4 for x in ids], pa.int64())]
            if digests:
                cols += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids])]
            else:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *made])

    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(lean(run), schema)


def decode_documents(df: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """df with the text that ids_col decodes to (bytes that aren't UTF-8 as U+FFFD)."""
    keep = [c for c in df.columns if c != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"`{text_col}` string"])

    def run(batches):
        bpe = _tokenizer(path, pattern)
        for batch in batches:
            ids = batch.column(ids_col).to_pylist()
            text = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*keep, text_col])

    return df.select(*keep).mapInArrow(lean(run), schema)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
