"""Where Spark and SQL read the same text or table differently."""

from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import replies, route, store
from cairn.plans import QUERIES


def test_pools_are_whole(spark):
    """a kind may have more than 2,000 words."""
    words = [chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26) + "xx" for i in range(3000)]
    related = spark.createDataFrame([(w, "hypernym", "animal") for w in words], "word string, relation string, target string")
    assert {r.word for r in replies.pools(related, ["animal"]).collect()} == set(words)


def test_procedures_have_all_steps(spark):
    """the body has every step, those of one number by id."""
    memory = spark.createDataFrame([(i, f"How to bake bread, step {n}: do {i}. then rest", "wikihow:bread") for i, n in enumerate([3, 1, 2, 2, 7, 6, 5])], "id long, text string, source string")
    got = route.procedures(spark.createDataFrame([(1, "How to bake bread?")], "qid long, question string"), memory).collect()
    assert [tuple(r) for r in got] == [(1, "bake bread", 7, "1. do 1. 2. do 2. 2. do 3. 3. do 0. 5. do 6. 6. do 5. 7. do 4.", 2)]


def test_ids_go_on_without_gaps(spark):
    """the parts that are counted are those that are numbered, whatever else is read of the rows."""
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        new = spark.range(20000).repartition(5).select(F.col("id").alias("k"), F.repeat(F.md5(F.col("id").cast("string").cast("binary")), 8).alias("text"))
        got = store.with_new_ids(spark.createDataFrame([(100,)], "id long"), new, ["k"]).select("id", "k", "text").collect()
        assert len(got) == 20000 and all(r.id == r.k + 101 for r in got)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sums_just_below_zero(spark, tmp_path):
    """a total that rounds to nothing from below keeps its sign, as in SQL."""
    rows = [(1, 1, [0.5, -0.50001]), (2, 1, [0.25, 0.0]), (3, 0, [1.0]), (4, 1, [0.00001])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: str(r.total) for r in QUERIES["appended_vectors"](spark, str(tmp_path)).collect()}
    assert got == {5: "-0.0", 6: "0.25", 7: "0.0"}


def test_patterns_are_read_as_sql_reads_them(spark, tmp_path):
    """word edges beyond ASCII, white space and ends of lines."""
    texts = ["is\u00e9 un", "who are\u0085you", "so?\n", "so?\x0b", "so? \n", "so?\u2028", "\x0bis it", "\u017fhould it", "what\u00efs", "hello", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "turn int, text string").withColumn("conv_id", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    asked = {r.turn for r in QUERIES["question_turns"](spark, str(tmp_path)).collect()}
    assert asked == {0, 1, 2, 4, 7, 8}  # as DuckDB 2.0 has them
    kinds = {r.turn: r.qtype for r in QUERIES["question_type"](spark, str(tmp_path)).collect()}
    assert kinds == {0: "yesno", 1: "person", 7: "yesno"} | {i: "general" for i in (2, 3, 4, 5, 6, 8, 9, 10, 11)}


def test_upper_case_by_letter(spark, tmp_path):
    """a sharp s in a label is one letter in upper case too, as in SQL."""
    df = spark.createDataFrame([("stra\u00dfe \u0149a \u1fb3 caf\u00e9",)], "w string")
    assert df.select(tx.simple_upper(F.col("w"))).first()[0] == "STRA\u1e9eE \u0149A \u1fbc CAF\u00c9"
    spark.createDataFrame([(1, "Anna ma\u00df Bern heute")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in QUERIES["typed_triples"](spark, str(tmp_path)).collect()] == [("Anna", "REL_MA\u1e9e_HEUTE", "Bern", 1)]
