import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cairn.llm.kneser_ney import classify, gram_counts, log_probabilities, scores

from .cases import edge_docs, edge_rows, empty_docs

ORDER = 3


def brute(trusted, texts):
    """Interpolated modified Kneser-Ney over bytes, straight from the definition."""
    grams = lambda t: [tuple([1] * (ORDER - 1) + list(t.encode()))[i : i + ORDER] for i in range(len(t.encode()))]
    counts = {ORDER: Counter(g for t in trusted for g in grams(t))}
    every = {g for t in [*trusted, *texts] for g in grams(t)}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {}
    for k, c in counts.items():
        n = Counter(v for v in c.values() if v <= 4)
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
            d[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)]
        else:
            d[k] = [0.5] * 3
    by = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            by[k][g[:-1]].append(v)

    def p(g):
        k = len(g)
        rest = p(g[1:]) if k > 1 else 1 / 256
        own = by[k].get(g[:-1])
        if not own:
            return rest
        cut = lambda v: d[k][min(v, 3) - 1] if v else 0
        v = counts[k][g]
        return max(v - cut(v), 0) / sum(own) + sum(map(cut, own)) / sum(own) * rest

    return {g: p(g) for g in every}, [sum(math.log(p(g)) for g in grams(t)) for t in texts]


def test_probabilities_and_both_ways_of_scoring(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("aab bc cd") for _ in range(n))
    rows = [(i, text(rng.randint(0, 80)), i % 3 == 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "id long, text string, trusted boolean").repartition(3)
    table, want = brute([t for _, t, good in rows if good], [t for _, t, _ in rows])
    lp = log_probabilities(gram_counts(docs, ORDER), ORDER)
    got = {r.gram: r.lp for r in lp.collect()}
    assert len(got) == len(table)
    for g, p in table.items():
        assert abs(got[sum(c << 8 * (ORDER - 1 - i) for i, c in enumerate(g))] - math.log(p)) < 1e-9
    for most in (10**6, 0):
        found = {r.id: r.total for r in scores(docs, lp, ORDER, broadcast_rows=most).collect()}
        assert all(abs(found[i] - w) < 1e-3 for i, w in enumerate(want))


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(0, "abab ab", True), (1, "b", False)], "id long, text string, trusted boolean")
    every = [bytes([1, c]) for c in range(256)]
    t = spark.createDataFrame([(int.from_bytes(g, "big"), 0) for g in every], "gram long, n long")
    lp = log_probabilities(gram_counts(docs, 2).union(t).groupBy("gram").agg(F.sum("n").alias("n")), 2)
    first = [r.lp for r in lp.collect() if r.gram >> 8 == 1]
    assert len(first) == 256 and abs(sum(map(math.exp, first)) - 1) < 1e-9


def test_junk_goes_and_edges(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "and", "letion", "ering", "of"]) for _ in range(40))
    rows = [(i, good() if i % 10 else "".join(chr(rng.randint(97, 122)) for _ in range(150)), "en") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(0, 200, 1) if i % 2 or i % 10 == 0], "doc_id long, quality int, toxic int")
    got = classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    assert sum(r.keep for r in got if r.doc_id % 10 == 0) == 0
    assert sum(r.keep for r in got if r.doc_id % 10) > 0.9 * 180
    edge = classify(edge_docs(spark), labels)
    assert edge.count() == len(edge_rows())
    assert all(not r.keep and r.perplexity is None for r in edge.collect() if r.n_bytes == 0)
    assert classify(empty_docs(spark), labels).count() == 0


def test_thresholds(spark):
    """A language's threshold is the quantile of its trusted documents that the model was not trained on; a language without any has that of all."""
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["the", "and", "letion", "ering", "of", "xq"]) for _ in range(rng.randint(3, 40)))
    rows = [(i, text(), [None, "en", "fr", "en"][i % 4]) for i in range(240)] + [(500, text(), "zz"), (501, "", "en")]
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(240)] + [(4, 0, 0), (999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tested = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit("test"), F.col("doc_id")), F.lit(5)) == 0).collect()}
    bad = {i for i, q, t in labels if q == 0 or t == 1}
    for q in (0.5, 0.99):
        got = classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), quantile=q).collect()
        held = [r for r in got if r.doc_id in tested and r.doc_id < 240 and r.doc_id not in bad]
        edge = lambda rs: sorted(r.perplexity for r in rs)[math.ceil(q * len(rs)) - 1]  # noqa: B023, E731
        for r in got:
            own = [h for h in held if h.lang == r.lang] or held
            assert abs(r.threshold - edge(own)) < 1e-9 and r.keep == (r.perplexity is not None and r.perplexity <= r.threshold)
        assert len({r.threshold for r in got}) > 2


def test_many_languages(spark):
    """5,000 languages and a null one: thresholds are a joined table."""
    rows = [(i, f"text {i % 7} of some kind {i}", None if i % 50 == 0 else f"l{i % 5001}") for i in range(15_003)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15_003)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tested = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit("test"), F.col("doc_id")), F.lit(5)) == 0).collect()}
    got = classify(docs, labels).collect()
    most = {}
    for r in got:
        if r.doc_id in tested:
            most[r.lang] = max(most.get(r.lang, 0), r.perplexity)
    assert len(got) == len(rows) and None in most and len(most) > 2000
    assert all(abs(r.threshold - most[r.lang]) < 1e-9 for r in got if r.lang in most)
    assert len({r.threshold for r in got if r.lang not in most}) == 1
