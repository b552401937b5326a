import random

import numpy as np
import pytest

from cairn.llm import suffix_dedup
from cairn.llm.suffix_dedup import common_prefixes, cut_documents, suffix_array, words_at

from .cases import COLUMNS, HARD, edge_rows, empty_docs, hard_rows, words


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(100):
        text = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(0, 300)).astype(np.uint8)
        order, raw = suffix_array(text, 50), text.tobytes()
        assert sorted(order.tolist()) == list(range(len(text)))
        assert all(raw[a : a + 50] <= raw[b : b + 50] for a, b in zip(order[:-1], order[1:], strict=True))
        for a, b, n in zip(order[:-1], order[1:], common_prefixes(words_at(text), order, 50), strict=True):
            inside = min(n, len(raw) - max(a, b))
            assert raw[a : a + inside] == raw[b : b + inside]


def brute(rows):
    """(n_bytes, n_removed, n_spans, bytes left) of each row, in order; a null id takes no part."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in sorted((x for x in raw if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def check(docs, rows):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut_documents(docs).collect()), key=str)
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, brute(rows), strict=True)), key=str)
    return sum(r[2] for r in got)


@pytest.mark.parametrize("many,part", [(4096, 1 << 23), (2, 2000)])
def test_matches_brute_force(spark, monkeypatch, many, part):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part)
    monkeypatch.setattr(suffix_dedup, "SORTED", 3000)
    rng = random.Random(many)
    passages = [words(rng, rng.randint(8, 60)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [words(rng, rng.randint(0, 30)) + (" " + rng.choice(passages)[rng.randint(0, 5) :] if rng.random() < 0.7 else "") for _ in range(rng.randint(1, 4))]
        rows.append((i, " ".join(parts) + ("ab" * rng.randint(0, 60) if rng.random() < 0.2 else "")))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (-5, rows[3][1][10:])]
    rows += [(7, rows[3][1] + " other"), (7, passages[0]), (0, passages[1]), (0, passages[1] + passages[2]), (None, passages[0] * 2)]
    rows += [(300 + i, f"{i:03} " + passages[3][:28] + f" {i * 7:04} {words(rng, 9)}") for i in range(30)] + [(400, "z" * 9000), (401, "y" + "z" * 400)]
    assert check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows) > 1000


@pytest.mark.parametrize("batch,many", [(1, 4096), (7, 3), (40, 20)])
def test_anchors_over_many_batches(spark, monkeypatch, batch, many):
    """Anchors that go on over batches, in one document and in many, with equal and with other contexts."""
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rng = random.Random(batch)
    phrase = words(rng, 6)[:28]
    rows = [(i, f"{words(rng, 3)} {phrase} {words(rng, 3) if i % 3 else phrase + phrase}") for i in range(40)]
    rows += [(50, "z" * 700), (51, "y" + "z" * 130), (52, "z" * 60), (53, rows[3][1] * 3), (53, rows[4][1])]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert check(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), rows) > 300
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("make,schema", [(edge_rows, COLUMNS), (hard_rows, HARD)])
def test_edges(spark, make, schema):
    rows = make()
    assert check(spark.createDataFrame(rows, schema).repartition(3), [r[:2] for r in rows]) > 0
    assert cut_documents(empty_docs(spark)).count() == 0


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    """Contexts don't grow with the copies of a row under one id, and each copy gets the same result."""
    rng = random.Random(6)
    base = words(rng, 60)
    near = base[:150] + "#" + base[151:]
    made = []
    cut = suffix_dedup.cut_contexts

    def counted(*args):
        made.append(cut(*args).count())
        return cut(*args)

    monkeypatch.setattr(suffix_dedup, "cut_contexts", counted)
    for copies in (2, 60):
        rows = [(1, base)] + [(2, near)] * copies + [(3, words(rng, 40))]
        got = cut_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert len(got) == copies + 2 and len({tuple(r) for r in got if r.doc_id == 2}) == 1
        assert [(r.n_removed, bytes(r.kept).decode()) for r in got if r.doc_id == 1] == [(0, base)] and all(r.n_removed > 100 for r in got if r.doc_id == 2)
    assert made[0] == made[1]
