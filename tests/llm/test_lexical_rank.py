import math
import random
import re
from collections import Counter

import numpy as np

from cairn.llm import lexical_rank
from cairn.llm.lexical_rank import radix_order, rank_documents

from .cases import edge_docs, edge_rows, empty_docs, hard_docs, hard_rows, words


def terms(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """(item, rank, doc, score) of every item row, by reading every document for it."""
    sets = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    sets = [s for s in sets if s[2]]
    n, total, df = len(sets), sum(s[2] for s in sets), Counter(t for s in sets for t in s[1])
    out = []
    for item, text in items:
        found = []
        for i, tf, own in sets:
            m = 100 - 25 + 25 * own * n // total
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t, c in Counter(terms(text)).items() if tf[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def check(spark, docs, items, k=20, parts=3):
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id long, text string").repartition(2), k=k)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items, k), key=key)


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, words(rng, rng.choice([0, 1, 5, 40, 300]), "abc")) for i in range(300)]
    items = [(i, words(rng, 12, "abc")) for i in range(40)]
    check(spark, docs, items)
    monkeypatch.setattr(lexical_rank, "BLOCK", 64)  # several passes
    check(spark, docs, items[:20], k=3)


def test_small_groups_and_a_full_filter(spark, monkeypatch):
    """Few entries at a time, and so many terms that the filter lets all pass."""
    rng = random.Random(5)
    docs = [(i, words(rng, 30)) for i in range(60)]
    ranked = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(docs[:20], "item_id long, text string"), k=4)
    assert {(r.item_id, r["rank"]): r.doc_id for r in ranked.collect() if r["rank"] == 1} == {(i, 1): i for i in range(20)}
    monkeypatch.setattr(lexical_rank, "ENTRIES", 50)
    monkeypatch.setattr(lexical_rank, "FILTER_BITS", 32_768)
    check(spark, docs, docs[:20], k=4)


def test_copies_ties_and_a_hot_term(spark):
    docs = [(i, "the same text") for i in range(300)] + [(i, f"the own{i} word") for i in range(300, 600)] + [(9, "the other text"), (None, "the other text")]
    check(spark, docs, [(1, "same the the"), (2, "own400 OWN400 the"), (3, "nothing here"), (4, None), (1, "other"), (None, "other")], k=7)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    check(spark, rows, [(0, rows[7][1]), (1, ""), (2, "é ü 漢字 12"), (3, rows[15][1])])
    hard = [(r[0], r[1]) for r in hard_rows()]
    items = spark.createDataFrame([(5, hard[7][1], 3)], "item_id long, text string, score int")
    assert sorted(map(tuple, rank_documents(hard_docs(spark), items).collect())) == sorted(brute(hard, [(5, hard[7][1])], 20))
    empty = spark.createDataFrame([], "item_id long, text string")
    assert rank_documents(empty_docs(spark), items).count() == 0
    assert rank_documents(edge_docs(spark), empty).count() == 0


def test_radix_order():
    x = np.random.default_rng(1).integers(0, 1 << 40, 5000)
    assert (np.sort(x) == x[radix_order(x, 1 << 40)]).all()
    assert (np.argsort(x & 7, kind="stable") == radix_order(x & 7, 7)).all()
