import numpy as np
from pyspark.sql import functions as F

from cairn.functions import hv
from cairn.functions import numeric as num
from cairn.functions import text as tx
from cairn.operators import retrieve


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_quality_score(spark):
    score = lambda t: one(spark, F.round(tx.quality_score(F.lit(t)), 3))
    assert score("Rome is the capital of Italy.") == 1.0
    assert score("") == 0.0
    assert score("- here are things?") == 0.1
    assert score("what is it") == 0.8
    assert score("Is it? Or not? Yes.") == 0.5


def test_questions_and_answers(spark):
    kind = lambda t: one(spark, tx.question_type(F.lit(t)))
    assert [kind(t) for t in ("When was it?", "who is she", "what is the speed of light", "what is light", "how does it work", "hm")] == ["date", "person", "quantity", "definition", "mechanism", "general"]
    assert one(spark, tx.matches_type(F.lit("In 1932 it was"), F.lit("date"))) is True
    assert one(spark, tx.matches_type(F.lit("no idea"), F.lit("date"))) is False
    assert one(spark, tx.mentions_subject(F.lit("the Mona Lisa hangs there"), F.lit("who painted the mona lisa?"))) is True


def test_similarity_scales(spark):
    d = F.lit(30)
    assert one(spark, hv.sim01(d, 2)) == 0.75 and one(spark, hv.sim_pm1(d, 2)) == 0.5


def test_algebra(spark):
    a, b, c = (hv.atom(F.lit(x)) for x in "abc")
    assert one(spark, hv.bind(hv.bind(a, b), b) == a)
    assert one(spark, hv.hamming(a, a)) == 0 and 30 < one(spark, hv.hamming(a, b)) < 90
    rows = spark.createDataFrame([(1, x) for x in "abc"] + [(2, "a"), (2, "b")], "k int, l string").select("k", hv.atom(F.col("l")).alias("hv"))
    got = {r.k: r.hv for r in hv.bundle(rows, ["k"]).collect()}
    assert got[1] == one(spark, hv.majority3(a, b, c))
    assert got[2] == one(spark, F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))  # a tie is 0, so two vectors bundle to AND


def test_knn_is_exact(spark):
    rows = spark.range(200).select("id", hv.atom((F.col("id") % 90).cast("string")).alias("hv")).repartition(5)
    got = hv.knn(rows, rows.where("id % 50 = 0").withColumnRenamed("id", "qid"), 3, query_bytes=60).collect()
    local = {r.id: r.hv for r in rows.collect()}
    for q in (0, 50, 100, 150):
        want = sorted((sum((x ^ y).bit_count() for x, y in zip(local[q], v, strict=True)), i) for i, v in local.items())[:3]
        assert [(r.distance, r.id) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == q] == want


def test_capacity_of_a_bundle(spark):
    n = 9
    rows = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("string").alias("l")).select("k", "l", hv.atom(F.col("l"), 8).alias("hv"))
    whole = hv.bundle(rows, ["k"]).first().hv
    far = spark.range(1000, 1060).select(hv.hamming(hv.atom(F.col("id").cast("string"), 8), F.lit(whole)).alias("d")).agg(F.min("d")).first()[0]
    near = rows.select(hv.hamming(F.col("hv"), F.lit(whole)).alias("d")).agg(F.max("d")).first()[0]
    assert near < far


def test_numbers(spark):
    assert [tuple(x) for x in one(spark, num.dates(F.lit("born 15 February 1564, died March 4, 1616 or 40 May 1700")))] == [(1564, 2, 15), (1616, 3, 4)]
    date = lambda y, m, d: F.struct(F.lit(y).alias("y"), F.lit(m).alias("m"), F.lit(d).alias("d"))
    assert one(spark, num.age(date(1900, 5, 2), date(1950, 5, 1))) == 49
    assert one(spark, num.lookup(F.lit("km"), num.LENGTH)) == 1000.0


def test_text_vectors(spark):
    """Bundles of words against counting bits, for rows of no, one, tied, repeated and many words."""
    rng = np.random.default_rng(3)
    words = [[], ["a"], ["a", "b"], ["a", "a", "b"], None, [f"w{i}" for i in rng.integers(0, 40, 257)], [f"w{i}" for i in rng.integers(0, 90, 3000)], [f"w{i}" for i in rng.integers(0, 9, 256)]]
    for lanes, atoms in ((2, hv.md5_atoms), (5, hv.wide_atoms)):
        got = {r.id: r.hv for r in hv.text_vectors(spark.createDataFrame(list(enumerate(words)), "id long, words array<string>").repartition(2), lanes=lanes, atoms=atoms).collect()}
        for i, own in enumerate(words):
            want = [0] * lanes
            for lane in range(lanes if own else 0):
                column = [int(x) for x in atoms(own, lanes)[:, lane]]
                want[lane] = sum(1 << j for j in range(60) if 2 * sum(x >> j & 1 for x in column) > len(own))
            assert got[i] == want
    assert hv.md5_atoms(["a"], 2).tolist() == [one(spark, hv.atom(F.lit("a"), 2))]


def test_set_neighbours(spark):
    rng = np.random.default_rng(4)
    sets = [sorted(set(rng.integers(0, 30, n).tolist())) for n in (0, 3, 9, 20, 20, 40, 40, 40)] + [[1, 2, 3], [1, 2, 3, 4]]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, h array<long>").repartition(3)
    got = retrieve.set_neighbours(rows, rows.where("id % 2 = 0").withColumnRenamed("id", "qid"), 0.5, query_bytes=100).collect()
    want = {(q, i, len(set(a) & set(b)), len(set(a) | set(b))) for q, a in enumerate(sets) for i, b in enumerate(sets) if q % 2 == 0 and q != i and set(a) & set(b) and len(set(a) & set(b)) >= 0.5 * len(set(a) | set(b))}
    assert {tuple(r) for r in got} == want and want
