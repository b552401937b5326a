"""Language identification with error-correcting output codes.

Each language has a codeword. One binary classifier per bit predicts that bit from byte
n-grams (a linear log-odds model over n-gram counts of the languages on either side of
the bit). Decoding sums over the bits the logistic loss of the predicted margin against
the codeword's bit, weighted by how well that bit's classifier does on its training
texts; the nearest codeword wins. A text whose two nearest codewords are too close is
flagged ambiguous.

Up to ``EXHAUSTIVE`` languages get the exhaustive code of 2^(K-1) - 1 bits, more get seeded
random codewords. Training reads at most ``per_lang`` texts of a language (a hash of the
id picks them), so its cost is bounded; predictions read every whole text.

N-grams: single bytes, pairs, and hashed triples of the UTF-8 text with A-Z lowered and
every other ASCII byte a space.

Edge cases: a text that is null or has no letter is ``und`` with score 0 and not ambiguous;
repeated rows get equal rows; texts labelled ``und`` are not learned from; no labelled text at all makes every text ``und``; a single
learned language is predicted with score 1; of languages whose codewords lose equally the first by name is
predicted, and the text is ambiguous; texts of any length are read whole; an empty table gives no rows; further
columns are carried, those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, lean, row_groups, schema_of, small_batches, string_buffers

#: Labelled texts of a language that are learned from, at most (on average), and hash bits of triples.
PER_LANG, TRIPLE_BITS = 2000, 16
EXHAUSTIVE = 6
#: Languages that a model can have: a worker holds a few longs for each feature and language (1 MB), and the code has a bit for each few.
LANGUAGES = 1000
#: A text is ambiguous if the second nearest codeword has more than this share of the nearest one's weight.
AMBIGUOUS = 0.8

_CLASS = LOWER.copy()
_CLASS[:128][[not chr(c).isalpha() for c in range(128)]] = 32
PAIRS, TRIPLES = 256, 256 + 65536
FEATURES = TRIPLES + (1 << TRIPLE_BITS)


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """An n x bits matrix of -1 and 1, no column constant."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        cols = [[1, *(1 if c >> i & 1 else -1 for i in range(n - 1))] for c in range(2 ** (n - 1) - 1)]
        return np.array(cols, np.int8).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    code = np.where(rng.random((n, bits)) < 0.5, 1, -1).astype(np.int8)
    code[0, np.abs(code.sum(0)) == n] *= -1
    return code


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of the bytes, pairs and triples from each place on; those that cross a row or a run of spaces are 32 (a space)."""
    c = _CLASS[data].astype(np.int32)
    n = len(c)
    two, three = np.full(n, 32, np.int32), np.full(n, 32, np.int32)
    cut = np.zeros(n + 3, bool)
    cut[off] = True
    idle = np.zeros(n, bool)
    idle[:-1] = (c[:-1] == 32) & (c[1:] == 32)
    if n > 1:
        ok = ~cut[1:n] & ~idle[:-1]
        two[:-1][ok] = (PAIRS + (c[:-1] << 8 | c[1:]))[ok]
    if n > 2:
        ok = ~cut[1 : n - 1] & ~cut[2:n] & ~idle[:-2]
        code = (c[:-2].astype(np.uint32) << np.uint32(16) | c[1:-1].astype(np.uint32) << np.uint32(8) | c[2:].astype(np.uint32)) * np.uint32(2654435761)
        three[:-2][ok] = (TRIPLES + (code >> np.uint32(32 - TRIPLE_BITS)).astype(np.int32))[ok]
    return c, two, three


def _per_row(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros((len(off) - 1, *x.shape[1:]))
    some = off[1:] > off[:-1]
    if some.any():
        out[some] = np.add.reduceat(x, off[:-1][some], axis=0, dtype=np.float64)
    return out


class Model:
    """langs, their codewords, the weights of each bit's classifier, and each bit's scale and weight in decoding."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        bits = self.code.shape[1]
        self.weights = np.zeros((counts.shape[1], bits), np.float32)
        for b in range(bits if len(langs) > 1 else 0):
            up, down = share[self.code[:, b] > 0].mean(0), share[self.code[:, b] < 0].mean(0)
            self.weights[:, b] = np.clip(np.log(up / down), -6, 6)
        self.weights[32] = 0
        self.scale, self.trust = np.ones(bits), np.ones(bits)

    def margins(self, data: np.ndarray, off: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
        """Mean log-odds of each bit, by row; pieces of ``chunk`` bytes bound the memory for long texts."""
        total, seen = np.zeros((len(off) - 1, self.code.shape[1])), np.zeros(len(off) - 1)
        for r, s in row_groups(off):
            own = off[r : s + 1] - off[r]
            for features in grams(data[off[r] : off[s]], own):
                for a in range(0, len(features), chunk):
                    part = features[a : a + chunk]
                    inside = np.clip(own - a, 0, len(part))
                    total[r:s] += _per_row(self.weights[part], inside)
                    seen[r:s] += _per_row((part != 32).astype(np.float32), inside)
        return total / np.maximum(seen, 1)[:, None]

    def calibrate(self, sums: np.ndarray, squares: np.ndarray, wrong: np.ndarray, n: int) -> None:
        """From the training margins times the true bits: scale margins to unit spread, trust bits by their error."""
        self.scale = 3.0 / np.maximum(sums / max(n, 1), 1e-6)
        error = np.clip((wrong + 1) / (n + 2), 1e-4, 0.5)
        self.trust = np.log((1 - error) / error)
        self.trust = self.trust / self.trust.sum() if self.trust.sum() > 0 else np.ones(len(error)) / len(error)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest language's number, its score (share of exp(-loss) of all codewords), and whether it is ambiguous."""
        m = margins * self.scale
        loss = np.stack([(np.logaddexp(0, -m * word) * self.trust).sum(1) for word in self.code], 1)
        near = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        score = near.max(1) / near.sum(1)
        second = np.sort(near, 1)[:, -2] if near.shape[1] > 1 else np.zeros(len(near))
        return loss.argmin(1), score, second > AMBIGUOUS


def train(labelled: DataFrame, *, per_lang: int = PER_LANG) -> Model:
    """A model from rows of (id, text, lang), of which about per_lang of each language are used."""
    spark = labelled.sparkSession
    small_batches(spark)
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(LANGUAGES + 1).collect()}  # as many rows as languages
    langs = sorted(counts)
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages; the labels may not be languages")
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / counts[k]))]) if langs else None
    if not langs:
        return Model([], np.zeros((0, FEATURES)))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1_000_000)) / 1_000_000
    sample = labelled.where(draw < share[F.col("lang")])

    def count(batches):
        number = {x: i for i, x in enumerate(langs)}
        total: dict[int, np.ndarray] = {}  # of the languages that the part has
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            lang = np.repeat(own, np.diff(off))
            for features in grams(data, off):
                for k in np.unique(own).tolist():
                    total[k] = total.get(k, 0) + np.bincount(features[lang == k], minlength=FEATURES)
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "feature", "n"])

    found = sample.select("text", "lang").mapInArrow(lean(count), "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()  # languages x FEATURES at most
    table = np.zeros((len(langs), FEATURES))
    table[found.lang.to_numpy(), found.feature.to_numpy()] = found.n.to_numpy()
    model = Model(langs, table)
    shared = spark.sparkContext.broadcast(model)

    def test(batches):
        model = shared.value
        for batch in batches:
            truth = model.code[[langs.index(x) for x in batch.column("lang").to_pylist()]]
            m = model.margins(*string_buffers(batch.column("text"))) * truth
            bits = np.arange(m.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bits, m.sum(0), (m * m).sum(0), (m <= 0).sum(0).astype(np.float64), np.full(len(bits), float(len(m))))], names=["bit", "s", "q", "e", "n"])

    stats = sample.select("text", "lang").mapInArrow(lean(test), "bit long, s double, q double, e double, n double").groupBy("bit").agg(*[F.sum(c).alias(c) for c in "sqen"]).orderBy("bit").toPandas()
    if len(stats):
        model.calibrate(stats.s.to_numpy(), stats.q.to_numpy(), stats.e.to_numpy(), int(stats.n.iloc[0]))
    return model


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs without the text, with lang_pred, score and ambiguous."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}
    keep = [c for c in docs.columns if c not in made and c != text_col]

    def run(batches):
        model = shared.value
        for batch in batches:
            data, off = string_buffers(batch.column(len(keep) + 1))
            known = batch.column(len(keep)).to_numpy(zero_copy_only=False)
            if model.langs:
                best, score, ambiguous = model.decode(model.margins(data, off))
                lang = np.where(known, np.array(model.langs, object)[best], "und")
            else:
                lang, score, ambiguous = np.full(len(known), "und", object), np.zeros(len(known)), np.zeros(len(known), bool)
            cols = [pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(ambiguous & known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=[*keep, *made])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    schema = ", ".join([*([schema_of(docs, keep)] if keep else []), *(f"{k} {v}" for k, v in made.items())])
    return docs.select(*keep, letters.alias("_letters"), F.col(text_col).alias("_text")).mapInArrow(lean(run), schema)


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.col(lang_col) != "und") & F.col(text_col).isNotNull())
    return train(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), **options)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model)
