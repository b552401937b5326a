import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairn.functions import encoders
from cairn.sources import corpus, trades
from cairn.streaming import memory


def test_articles(spark, tmp_path):
    rows = [{"topic": "Po_river", "title": "Po", "extract": "The Po is a long river. Short. It flows to the sea!"}, {"topic": "x", "title": "x", "error": "missing"}, {"topic": "y", "title": "y", "extract": None}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    got = corpus.article_rows(corpus.read_articles(spark, str(tmp_path / "a.json"))).orderBy("pos").collect()
    assert [(r.source, r.text) for r in got] == [("wikipedia:Po_river", "The Po is a long river."), ("wikipedia:Po_river", "It flows to the sea!")]


def test_trades(spark, tmp_path):
    make = lambda i, **x: {"ts": f"2024-01-{i:02}", "ticker": "A", "outcome": {"side_taken": "buy", "realized_pnl": 1.5}, **x}
    rows = [make(i) for i in range(1, 8)] + [make(8, is_expansion=True), make(9, outcome={"side_taken": "hold", "realized_pnl": 1}), make(10, outcome={"side_taken": "sell", "realized_pnl": 0.0}), make(11, outcome=None)]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n\n")
    real = trades.read(spark, str(tmp_path / "t.jsonl"))
    old, new = trades.held_out(real, 3)
    assert sorted(r.ts for r in old.collect()) == [f"2024-01-0{i}" for i in range(1, 5)]
    assert sorted(r.ts for r in new.collect()) == ["2024-01-05", "2024-01-06", "2024-01-07"]


def chunks(seed):
    rng = random.Random(seed)
    return [(f"v{k}", float(i), " ".join("word" for _ in range(rng.randint(1, 30)))) for k in range(4) for i in range(rng.randint(0, 60))]


def gathered(rows, cap):
    out = []
    for v in sorted({r[0] for r in rows}):
        held, n = [], 0
        own = sorted(r[1:] for r in rows if r[0] == v)
        for i, (t, text) in enumerate(own):
            held.append((t, text))
            if sum(len(x) for _, x in held) > 180 or i == len(own) - 1:
                text = " ".join(x for _, x in held)
                if 30 < len(text) < 320 and n < cap:
                    out.append((v, held[0][0], text))
                    n += 1
                held = []
    return sorted(out)


def test_passages(spark):
    rows = chunks(3)
    df = spark.createDataFrame(rows, "video string, start double, text string").repartition(3)
    for cap in (80, 2):
        assert sorted(map(tuple, corpus.passages(df, cap=cap).collect())) == gathered(rows, cap)


def test_passages_of_a_stream(spark, tmp_path):
    """What comes in several batches is gathered as if it came at once, but for what isn't full yet."""
    rows = chunks(4)
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([r for r in rows if int(r[1]) // 20 == k], "video string, start double, text string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("video string, start double, text string").option("maxFilesPerTrigger", 1).parquet(source)
    q = memory.passages(stream).writeStream.format("memory").queryName("gathered").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("gathered").collect())
    assert got and set(got) <= set(gathered(rows, 80)) and len(gathered(rows, 80)) - len(got) <= 4


def test_keyframes(spark):
    rows = [("a", 0.0, 0.0, 50.0, "x"), ("a", 1.0, 30.0, 50.0, "y"), ("a", 2.0, 30.0, 50.0, "y"), ("a", 3.0, 30.0, 5.0, "z"), ("a", 4.0, 30.0, 50.0, "y"), ("a", 9.0, 1.0, 50.0, "w"), ("a", 14.5, 1.0, 50.0, "w"), ("b", 5.0, 0.0, 50.0, "x")]
    got = corpus.keyframes(spark.createDataFrame(rows, "video string, t double, difference double, light double, caption string").repartition(2)).collect()
    assert sorted((r.video, r.t, r.caption) for r in got) == [("a", 0.0, "x"), ("a", 2.0, "y"), ("a", 14.5, "w"), ("b", 5.0, "x")]
    many = [("c", float(i), 30.0, 50.0, str(i)) for i in range(0, 200, 2)]
    assert corpus.keyframes(spark.createDataFrame(many, "video string, t double, difference double, light double, caption string")).count() == 40


def test_windows_once_and_versions(spark, tmp_path):
    start = datetime(2024, 1, 1)
    events = [(start + timedelta(minutes=m), k, i) for i, (m, k) in enumerate([(1, "a"), (2, "a"), (50, "b"), (61, "a"), (70, "a"), (200, "b")])]
    spark.createDataFrame(events, "ts timestamp, kind string, id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, kind string, id long").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.table(name).collect()

    got = {(r.window.start, r.kind): r.n for r in run(memory.windowed_counts(stream(), "ts", "kind"), "windowed", "complete")}
    assert got == {(start, "a"): 2, (start, "b"): 1, (start + timedelta(hours=1), "a"): 2, (start + timedelta(hours=3), "b"): 1}
    assert sorted(r.kind for r in run(memory.once(stream(), "ts", ["kind"]), "once_only", "append")) == ["a", "b"]
    table = str(tmp_path / "table")
    memory.append(stream(), table, str(tmp_path / "append"), ["id"]).awaitTermination()
    before = memory.version(spark, table)
    assert before == (6, 0) and memory.version(spark, table) == before
    spark.createDataFrame([(start, "c", 99)], "ts timestamp, kind string, id long").write.mode("append").parquet(str(tmp_path / "in"))
    memory.append(stream(), table, str(tmp_path / "append"), ["id"]).awaitTermination()
    assert memory.version(spark, table) == (7, 1)


def test_encoders(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "d"]), (3, ["x", "y", "z"])], "id long, words array<string>")
    for name in ("wide", "small"):
        near = {r.id: r["rank"] for r in encoders.search(rows, rows.where("id = 1"), 3, name).collect()}
        assert near[1] == 1
    with pytest.raises(ValueError):
        encoders.register("wide", None)
    encoders.register("first", lambda r: r.select("id", F.array(F.length(r["words"][0]).cast("long")).alias("hv")))
    assert encoders.search(rows, rows, 1, "first").count() == 3
