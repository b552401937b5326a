import hashlib

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import codebook


def naive(rows, k, rounds):
    x = {i: np.round(np.array(v) * codebook.SCALE) for i, v in rows}
    seen, centres = set(), []
    for i in sorted(x, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
        if tuple(x[i]) not in seen and len(centres) < k:
            seen.add(tuple(x[i]))
            centres.append(x[i].copy())
    for _ in range(rounds):
        code = {i: int(np.argmin([np.sqrt(((v - c) ** 2).sum()) for c in centres])) for i, v in x.items()}
        for j in range(len(centres)):
            own = [x[i] for i in x if code[i] == j]
            if own:
                centres[j] = sum(own) / len(own)
    return code, np.array(centres) / codebook.SCALE


def test_same_as_naive_with_fewer_distances(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(6, 5)) * 3
    rows = [(i, (middle[i % 6] + rng.normal(size=5) * 0.3).round(4).tolist()) for i in range(400)] + [(400 + i, [1.0] * 5) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    codes, centres, measured = codebook.train(df, 6, 7)
    want, own = naive(rows, 6, 7)
    assert {r.id: r.code for r in codes.collect()} == want and np.allclose(centres, own)
    assert measured[0] == 450 and sum(measured[1:]) < 6 * 450 / 2
    assert codebook.train(df.limit(0), 3, 2)[0].count() == 0
    few = codebook.train(df.where("id >= 399"), 9, 2)  # two different vectors only
    assert len(few[1]) == 2 and few[0].groupBy("code").count().count() == 2


def test_roundtrip(spark):
    """Words of few positions come back; the share falls as positions share one bundle."""
    rng = np.random.default_rng(4)
    words = rng.normal(size=(16, 2))
    for positions, least in ((4, 0.99), (8, 0.97)):
        picks = rng.integers(0, 16, (200, positions))
        df = spark.createDataFrame([(i, words[p].ravel().tolist()) for i, p in enumerate(picks)], "id long, v array<double>")
        made = codebook.encode(df, words, 20)
        assert {r.id: list(r.words) for r in made.collect()} == {i: p.tolist() for i, p in enumerate(picks)}
        got = made.join(codebook.decode(made, positions, 16, 20), "id").select(F.explode(F.zip_with("words", "decoded", lambda a, b: (a == b).cast("int"))).alias("ok"))
        assert got.agg(F.avg("ok")).first()[0] > least
