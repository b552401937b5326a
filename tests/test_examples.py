"""Queries over written sentences and facts against their SQL, and the staged cascade."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.operators.replies import staged
from cairn.plans import ORACLE_SQL, QUERIES
from cairn.plans.registry import EXAMPLES


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_example(spark, name):
    run, sql = EXAMPLES[name]
    got = run(spark, None)
    names = sorted(got.columns)
    want = duckdb.connect().execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*names).collect())


def test_no_query_has_rows_of_its_own():
    """What is registered reads the tables: its SQL names one of them."""
    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    assert not [n for n, sql in ORACLE_SQL.items() if not any(t in sql for t in tables)]
    assert not set(EXAMPLES) & set(QUERIES)


def test_staged(spark):
    """A route sees only the turns that no route before it answered; each turn comes out once."""
    turns = spark.createDataFrame([(i, f"turn {i}") for i in range(10)], "qid long, question string")
    seen = {}

    def route(name, keep):
        def run(t):
            seen[name] = sorted(r.qid for r in t.collect())
            return t.where(keep).select("qid", F.concat(F.lit(name), "question").alias("answer"))

        return name, run

    twice = ("twice", lambda t: t.where("qid = 9").select("qid", F.explode(F.array(F.lit("b"), F.lit("a"), F.lit(None))).alias("answer")))
    got = {r.qid: (r.route, r.answer) for r in staged(turns, [route("even", "qid % 2 = 0"), route("small", "qid < 5"), twice], "none").collect()}
    assert seen == {"even": list(range(10)), "small": [1, 3, 5, 7, 9]}
    assert got == {i: ("even", f"eventurn {i}") if i % 2 == 0 else ("small", f"smallturn {i}") if i < 5 else ("twice", "a") if i == 9 else ("fallback", "none") for i in range(10)}
