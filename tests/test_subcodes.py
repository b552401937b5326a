import random

from cairn.functions import hv
from cairn.operators import subcodes


def test_same_as_all_distances(spark):
    """Near, far and equal codes, and a code that most rows have."""
    rng = random.Random(1)
    base = [[rng.getrandbits(60), rng.getrandbits(60)] for _ in range(6)]
    flip = lambda c, n: [c[0] ^ sum(1 << b for b in rng.sample(range(60), min(n, 60))), c[1]]
    rows = [(i, flip(rng.choice(base), rng.choice([0, 0, 1, 3, 9, 20, 30]))) for i in range(300)] + [(1000 + i, base[0]) for i in range(200)]
    queries = [(i, c) for i, c in rows[:20]] + [(5000, [0, 0]), (5001, base[0])]
    index = subcodes.index(spark.createDataFrame(rows, "id long, hv array<long>").repartition(3), 4, 2)
    got = sorted((r.qid, r["rank"], r.id, r.distance) for r in subcodes.nearest(index, spark.createDataFrame(queries, "qid long, hv array<long>"), 4, 2).collect())
    want = []
    for q, c in queries:
        d = sorted(((c[0] ^ v[0]).bit_count() + (c[1] ^ v[1]).bit_count(), i) for i, v in rows)
        want += [(q, n + 1, i, x) for n, (x, i) in enumerate(d[:4])]
    assert got == sorted(want)
    assert index.count() == 12 * len({tuple(v) for _, v in rows})  # each distinct code once


def test_fewer_rows_than_asked(spark):
    index = subcodes.index(spark.createDataFrame([(1, [5, 5])], "id long, hv array<long>"), 3, 2)
    got = subcodes.nearest(index, spark.createDataFrame([(7, [5, 4]), (8, [0, 0])], "qid long, hv array<long>"), 3, 2).collect()
    assert sorted((r.qid, r.id, r.distance, r["rank"]) for r in got) == [(7, 1, 1, 1), (8, 1, 4, 1)]


def test_a_large_codebook_gives_the_same(spark, monkeypatch):
    rng = random.Random(3)
    code = lambda: [rng.getrandbits(60), rng.getrandbits(60)]
    book = [(f"w{i}", code()) for i in range(12)]
    book.append(("v", book[4][1]))  # a tie: the lower label
    rows = [(i, [book[i % 13][1][0] ^ (1 << i), book[i % 13][1][1]]) for i in range(20)] + [(30, book[4][1]), (31, code())]
    b, r = spark.createDataFrame(book, "label string, hv array<long>"), spark.createDataFrame(rows, "key long, hv array<long>")
    want = sorted(map(str, hv.snap(r, b, "label").collect()))
    monkeypatch.setattr(hv, "BOOK", 5)
    assert sorted(map(str, hv.snap(r, b, "label").collect())) == want and "nearest='v'" in "".join(want)
