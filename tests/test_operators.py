import json

from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import claims, mine, retrieve, store
from cairn.sources import corpus, dictionary
from cairn.streaming import memory


def test_store(spark):
    rows = spark.createDataFrame([(1, "a", "wikipedia:x"), (2, "b", None), (3, "a", "image:/p"), (4, "c", "user_msg")], "id long, text string, source string")
    assert [r.id for r in store.corpus(rows).collect()] == [1]
    assert {r.id for r in store.without_echoes(rows).collect()} == {1, 2}
    assert store.by_kind(rows, "image").first().path == "/p"
    assert sorted(r.id for r in store.first_per_key(rows, "text", "id").collect()) == [1, 2, 4]
    left, gone = store.delete_ids(rows, spark.createDataFrame([(3,)], "id long"))
    assert left.count() == 3 and gone.first().source == "image:/p"
    new = store.with_new_ids(rows, spark.createDataFrame([("z", 2), ("y", 1), ("x", 3)], "text string, o int").repartition(3), ["o"])
    assert [r.text for r in new.orderBy("id").collect()] == ["y", "z", "x"] and sorted(r.id for r in new.collect()) == [5, 6, 7]
    slots = spark.createDataFrame([("u", "city", 1), ("u", "city", 2), ("v", "city", 1)], "u string, slot string, t int")
    assert [(r.u, r.t) for r in store.supersede(slots, ["u", "slot"], ["t"]).where("superseded").collect()] == [("u", 1)]


def test_mining(spark):
    rows = spark.createDataFrame([("The cat sat on the mat",), ("The dog sat on the rug",), ("A cow sat on the hay",)], "text string")
    best = mine.best_next(mine.transitions(rows, tx.lower_tokens(F.col("text")), 2))
    assert {r.context: r.next for r in best.collect()}["sat on"] == "the"
    p = {r.pattern: r.n for r in mine.phrase_patterns(rows, tx.tokens(F.col("text")), count=3).collect()}
    assert p["<C> on the <C>"] == 3
    co = {(r.a, r.b): r.n for r in mine.cooccurrence(rows, tx.lower_tokens(F.col("text")), 2).collect()}
    assert co["sat", "on"] == co["on", "sat"] == 3 and ("cat", "mat") not in co
    typed = mine.typed(spark.createDataFrame([("The Alps rose in 1900s near Bern",)], "text string"), tx.tokens(F.col("text"))).first().t
    assert typed == ["the", "ENTITY", "rose", "in", "NUMBER", "near", "ENTITY"]


def test_claims(spark):
    rows = spark.createDataFrame([(1, "Ana Silva wrote Blue River."), (2, "Ana Silva never wrote Red House."), (3, "Blue River was written by Ana Silva.")], "id int, s string")
    got = claims.extract(rows, F.col("s"), ["id"]).collect()
    assert {(r.id, r.subj, r.verb, r.obj) for r in got} == {(1, "Ana Silva", "wrote", "Blue River"), (3, "Ana Silva", "wrote", "Blue River")}


def test_threshold_after_k(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, v array<double>")
    hits = retrieve.cosine_knn(rows, rows.where("id = 1").withColumnRenamed("id", "qid"), 2)
    assert [r.id for r in hits.orderBy("rank").collect()] == [2, 3]
    votes = retrieve.label_vote(hits, spark.createDataFrame([(2, 7), (3, 8)], "id long, label int")).first()
    assert votes.label == 7 and votes.share > 0.5


def test_dictionary(spark, tmp_path):
    lines = [
        {"word": "Dog", "pos": "noun", "senses": [{"glosses": ["an animal", "x"], "synonyms": [{"word": "hound"}]}], "synonyms": [{"word": "(odd)"}, {"word": "cur"}], "sounds": [{"ipa": "/a/"}]},
        {"word": "dog", "pos": "verb", "senses": [{"glosses": ["to follow"]}], "sounds": [{"ipa": "/b/"}], "etymology_text": "old"},
    ]
    (tmp_path / "d.jsonl").write_text("\n".join([json.dumps(lines[0]), "", "{broken", json.dumps(lines[1])]))
    dump = dictionary.read(spark, str(tmp_path / "d.jsonl"))
    assert [r.gloss for r in dictionary.entries(dump).orderBy("id", "idx").collect()] == ["an animal", "to follow"]
    assert {(r.relation, r.target) for r in dictionary.related(dump).collect()} == {("synonyms", "hound"), ("synonyms", "cur")}
    full = dictionary.look_up(dump, spark.createDataFrame([("DOG",)], "word string")).first()
    assert full.ipa == "/b/" and full.etymology == "old" and sorted(full.related["synonyms"]) == ["cur", "hound"]


def test_corpus_sources(spark, tmp_path):
    text = "Rome is the capital of Italy and a very old city on the river. It has many old buildings that people from all over visit. Short one."
    s = corpus.article_sentences(spark.createDataFrame([(1, text), (2, text)], "id long, text string")).collect()
    assert len(s) == 2 and any(r.text.startswith("Rome: It has") for r in s)
    chunks = spark.createDataFrame([("v", float(i), "word " * 10) for i in range(9)], "video string, start double, text string")
    p = corpus.passages(chunks).orderBy("start").collect()
    assert [r.start for r in p] == [0.0, 4.0, 8.0]
    (tmp_path / "m.py").write_text('"""Doc."""\nimport os\n\nclass A:\n    def f(self): pass\n\ndef g(): pass\n')
    (tmp_path / "bad.py").write_text("def (")
    got = {tuple(r) for r in corpus.code_claims(corpus.code_records(spark, str(tmp_path))).collect()}
    assert got == {("m", "imports", "os"), ("A", "defined_in", "m"), ("g", "defined_in", "m"), ("A", "has_method", "f")}


def test_streams(spark, tmp_path):
    rows = [(1, 0, "I met Ana Silva"), (1, 1, "she likes Rome"), (2, 0, "hello"), (1, 0, "I met Ana Silva")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("conv_id long, turn long, text string").parquet(f"{tmp_path}/in")
    memory.append(stream, f"{tmp_path}/out", f"{tmp_path}/c1", ["conv_id", "turn"]).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    q = memory.running_df(stream, tx.lower_tokens(F.col("text"))).writeStream.format("memory").queryName("dfs").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.token: r.df for r in spark.table("dfs").collect()}["ana"] == 2
    q = memory.recent_entities(stream).writeStream.format("memory").queryName("recent").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r.recent) for r in spark.table("recent").where("conv_id = 1 and turn = 1").collect()} == {("Rome", "Ana Silva")}
