"""Queries against brute force, on small tables."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.plans import QUERIES, memory


def test_occurrences(spark):
    """Items in lower case, with digits or quotes, without inner words or repeated are found wherever a text contains them."""
    items = [(1, "the quick brown fox jumps"), (2, "42 is it"), (3, '"quoted" Words'), (4, "fox"), (5, ""), (6, None), (7, "ick brown fo"), (8, "not there at all"), (9, "fox"), (10, ", "), (11, "Äpfel, größer als Birnen")]
    texts = [(1, "Then the quick brown fox jumps Over"), (2, 'x"quoted" Wordsy 142 is items'), (3, None), (4, ""), (5, "A fox, a Fox"), (5, "the quick brown fox jumps"), (6, "xÄpfel, größer als Birnenkuchen")]
    want = sorted((j, i) for j, x in items for i, t in texts if x is not None and t is not None and x in t)
    got = memory.occurrences(spark.createDataFrame(items, "item_id long, wanted string"), spark.createDataFrame(texts, "id long, text string").withColumn("source", F.lit("s")))
    assert sorted((r.item_id, r.id) for r in got.collect()) == want


TEXTS = [
    "Maria Rossi wrote the Silver Song in Milan in 1900s and Maria Rossi wrote the Red Song in Milan",
    "the river of gold and the river of tin and the river of lead",
    "Carl Braun built Bern near Basel. Carl Braun left Bern near Basel. Then Carl Braun built Bern",
    "the house, the river, the the",
    None,
    "",
    "one",
]


def _documents(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def _tokens(t):
    return re.findall(r"[\w-]+", t or "")


def _grams(w, least, most):
    return [w[i : i + n] for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def _tags(w):
    return ["NUMBER" if re.fullmatch(r"\d+s?", x) else "ENTITY" if x[0].isupper() and (i or x.lower() not in tx.TYPED_FUNCTION_WORDS) else x.lower() for i, x in enumerate(w)]


def test_mining_of_documents(spark, tmp_path):
    """The mining queries over documents, against loops over all windows."""
    sf = _documents(spark, tmp_path, list(enumerate(TEXTS)), "doc_id long, text string")
    run = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, sf).collect())
    co, words, after = Counter(), Counter(), Counter()
    patterns, typed, triples = defaultdict(list), Counter(), Counter()
    for t in TEXTS:
        w = _tokens(t)
        low = [x.lower() for x in w]
        words.update(low)
        after.update(y for x, y in zip(low, low[1:]) if x == "the")
        for i, x in enumerate(low):
            for y in low[i + 1 : i + 5]:
                if x != y:
                    co[x, y] += 1
                    co[y, x] += 1
        for g in _grams(w, 4, 6):
            own = [x for x in g if x.lower() not in tx.FUNCTION_WORDS]
            if 2 <= len(own) < len(g):
                patterns[" ".join("<C>" if x.lower() not in tx.FUNCTION_WORDS else x.lower() for x in g)].append((own[0], own[-1]))
        typed.update(" ".join(g) for g in _grams(_tags(w), 4, 7) if g.count("ENTITY") >= 2)
        for g in _grams(list(zip(w, _tags(w), strict=True)), 4, 5):
            e = [x for x, t in g if t == "ENTITY"]
            lit = [t.upper() for _, t in g if t not in ("ENTITY", "NUMBER") and t not in tx.TYPED_FUNCTION_WORDS]
            if len(e) >= 2 and lit:
                triples[e[0], "REL_" + "_".join(lit[:3]), e[-1]] += 1
    labels = defaultdict(set)
    for s, label, o in triples:
        labels[min(s, o), max(s, o)].add(label)
    assert run("cooccurrence_window_documents") == sorted((*k, n) for k, n in co.items())
    assert run("phrase_patterns_documents") == sorted((k, len(v), *min(v)) for k, v in patterns.items() if len(v) >= 3)
    assert run("typed_windows_documents") == sorted((k, n) for k, n in typed.items() if n >= 2)
    assert run("typed_triples_documents") == sorted((*k, n) for k, n in triples.items())
    assert run("cross_validated_pairs_documents") == sorted((*k, len(v)) for k, v in labels.items() if len(v) >= 2)
    blend = {x: round(0.5 * after[x] / after.total() + 0.5 * n / words.total(), 6) for x, n in words.items()}
    assert dict(run("outer_join_blend_documents")) == pytest.approx(blend, abs=2e-6)
    assert any(len(v) >= 3 for v in patterns.values()) and triples and max(typed.values()) >= 2


def test_slots_up_to_the_shortest_text(spark, tmp_path):
    """Slots after the sixth word count, and places beyond a group's shortest text don't."""
    rows = [("en", "a", "we saw the old house near Bern Alpha and Rome"), ("en", "a", "we saw the old house near Basel Beta and Oslo today"), ("en", "b", "red fox runs far"), ("en", "b", "blue cat"), (None, "b", "red one"), (None, "b", "blue two"), ("de", "c", None), ("de", "c", "allein hier")]
    sf = _documents(spark, tmp_path, rows, "lang string, source string, text string")
    want = []
    for g in {r[:2] for r in rows}:
        texts = [_tokens(t) for *k, t in rows if tuple(k) == g]
        for pos in range(min(map(len, texts))):
            at = [t[pos] for t in texts]
            if len(set(at)) > 1 and not any(x.lower() in tx.FUNCTION_WORDS for x in at):
                want.append((*g, pos, len(set(at))))
    got = [tuple(r) for r in QUERIES["slot_detection"](spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {("en", "a", 6, 2), ("en", "a", 7, 2), ("en", "a", 9, 2)} <= set(got) and not any(r[1] == "b" and r[2] > 1 for r in got)
