import re
from collections import defaultdict

import pytest

from cairn.llm import line_dedup
from cairn.llm.line_dedup import apply_bitmaps, keep_bitmaps

from .cases import COLUMNS, HARD, edge_rows, empty_docs, hard_rows


def brute(rows):
    """(n_lines, n_dropped, text left) of each row (id, text, ...), in order; a null id is below all others."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    low = lambda i: float("-inf") if i is None else i
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(low(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == low(i)]
        out.append((len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return out


@pytest.mark.parametrize("make", [edge_rows, hard_rows])
def test_matches_brute_force(spark, make):
    rows = make()
    docs = spark.createDataFrame(rows, HARD if make is hard_rows else COLUMNS).repartition(3)
    want = brute(rows)
    got = keep_bitmaps(docs).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == sorted(((r[0], r[1], n, d) for r, (n, d, _) in zip(rows, want, strict=True)), key=str)
    assert all(sum(x.length for x in r.keep) == r.n_lines - r.n_dropped for r in got)
    cut = apply_bitmaps(docs)
    assert cut.columns == docs.columns
    assert sorted(map(tuple, cut.collect()), key=str) == sorted(((r[0], t, *r[2:]) for r, (*_, t) in zip(rows, want, strict=True)), key=str)
    assert sum(d for _, d, _ in want) > 0


def test_heavy_hashes(spark):
    """A line that most documents hold is left out of the stream and decided by totals."""
    line = "A line that stands in each of the documents."
    rows = [(i, f"{line}\n{i} is a number of its own here\n{line}\nAnother line of many, {i % 7}") for i in range(300)] + [(None, line), (3, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made = line_dedup.line_rows(docs, "doc_id", "text", 20)
    assert 0 < line_dedup.heavy_hashes(made, 16).count() < 64
    got = apply_bitmaps(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, t) for (i, _), (*_, t) in zip(rows, brute(rows), strict=True)), key=str)


def test_empty_table(spark):
    assert keep_bitmaps(empty_docs(spark)).count() == 0
    assert apply_bitmaps(empty_docs(spark)).columns == empty_docs(spark).columns
