import random

import pytest

from cairn.llm.decontaminate import _exact, _words, contained, drop_contaminated

from .cases import edge_docs, empty_docs, words


def brute(docs, items, k=5, num=80, den=100):
    out = []
    for i, t in docs:
        for j, x in items:
            width = min(k, len(_words(x or "")))
            want = _exact(x or "", width, k) if width else set()
            both = len(want & _exact(t or "", width, k)) if want else 0
            if want and den * both >= num * len(want):
                out.append((i, j, len(want), both))
    return sorted(out)


@pytest.mark.parametrize("rows", [1 << 20, 0])
def test_matches_brute_force(spark, rows):
    rng = random.Random(3)
    items = [(j, words(rng, rng.choice([1, 3, 5, 12, 40]), "abcdefghijklmnopqrs")) for j in range(25)] + [(90, None), (91, ""), (92, "!!")]
    docs = []
    for i in range(60):
        w = words(rng, rng.randint(0, 300), "abcdefghijklmnopqrs").split()
        if rng.random() < 0.6:
            own = (items[rng.randrange(25)][1]).split()
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "zz"
            at = rng.randint(0, len(w))
            w[at:at] = own
        docs.append((i, ", ".join(w).upper() if i % 3 else " ".join(w)))
    docs += [(70, None), (71, ""), docs[5]]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    t = spark.createDataFrame(items, "item_id long, text string")
    got = contained(d, t, broadcast_rows=rows).collect()
    assert sorted(tuple(r) for r in got) == brute(docs, items)
    assert len(got) > 5


def test_edges(spark):
    docs = edge_docs(spark)
    items = spark.createDataFrame([(1, "nothing of this is in any text at all")], "item_id long, text string")
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert drop_contaminated(empty_docs(spark), items).count() == 0
    assert contained(docs, items.where("false")).count() == 0


@pytest.mark.parametrize("rows", [1 << 20, 0])
def test_repeated_item_ids(spark, rows):
    """Each text of a repeated item_id counts, and a document row has an item once, whichever path is taken."""
    rng = random.Random(5)
    one, two, three, four = (words(rng, n) for n in (12, 20, 9, 3))
    items = [(7, one), (7, two), (7, two), (8, three), (8, four), (9, one), (None, three)]
    docs = [(1, f"x {one} y"), (2, f"x {two} y"), (3, f"{one} {two} {three}"), (3, f"{one} {two} {three}"), (4, f"{four} z"), (5, "none of them"), (None, f"a {two}")]
    best = {}
    for at, doc in enumerate(docs):
        for item in items:
            for i, j, n, both in brute([doc], [item]):
                best[at, i, j] = max(best.get((at, i, j), (0, 0)), (both, -n))
    want = sorted(((i, j, -less, both) for (_, i, j), (both, less) in best.items()), key=str)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    t = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = contained(d, t, broadcast_rows=rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {(1, 7), (2, 7), (4, 8)} <= {(r.doc_id, r.item_id) for r in got}
