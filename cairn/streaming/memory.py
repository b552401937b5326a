"""Streams into the memory: live appends, running document frequencies, recent entities per conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.corpus import Gatherer


def append(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Append a stream to a Parquet table, partitioned by batch: a batch that runs again replaces its own files, so rows are there once."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version(spark: SparkSession, path: str) -> tuple[int, int]:
    """How many rows the table at a path has and its newest batch: what a reader compares to see whether to read again."""
    r = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("batch"), F.lit(-1)).alias("batch")).first()
    return r["n"], r["batch"]


def passages(stream: DataFrame, *, size: int = 180, least: int = 30, most: int = 320, cap: int = 80) -> DataFrame:
    """video, start, text: chunks (video, start, text) gathered as in sources.corpus.passages; what is not full yet waits in the state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, start, n = state.get if state.exists else ([], 0.0, 0)
        g = Gatherer(size, least, most, cap, (list(held), start, n))
        rows = pd.concat(list(frames)).sort_values(["start", "text"])
        out = [(key[0], *x) for t, text in zip(rows["start"], rows["text"], strict=True) for x in g.add(t, text)]
        state.update((g.held, g.start, g.n))
        yield pd.DataFrame(out, columns=["video", "start", "text"])

    rows = stream.select(F.col("video").cast("string").alias("video"), F.col("start").cast("double").alias("start"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("video").applyInPandasWithState(step, "video string, start double, text string", "held array<string>, start double, n int", "append", GroupStateTimeout.NoTimeout)


def running_df(stream: DataFrame, words: Column) -> DataFrame:
    """token, df of all rows so far, for output mode update or complete."""
    return stream.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def windowed_counts(stream: DataFrame, time: str, key: str, *, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and key; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"))


def once(stream: DataFrame, time: str, keys: list[str], *, late: str = "1 hour") -> DataFrame:
    """The first row of each key inside the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def recent_entities(stream: DataFrame, *, depth: int = 5) -> DataFrame:
    """conv_id, turn, recent: for each turn the entities (capitalised runs) last named in its conversation, newest first, ``depth`` at most.

    The state of a conversation is those few names. Turns come as conv_id, turn, text.
    """
    pattern = r"\b[A-Z][\w'-]+(?: [A-Z][\w'-]+){0,3}"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("turn")
        out = []
        for turn, text in zip(rows["turn"], rows["text"], strict=True):
            for name in pd.Series([text or ""]).str.findall(pattern)[0]:
                recent = [name, *[x for x in recent if x != name]][:depth]
            out.append((key[0], turn, list(recent)))
        state.update((recent,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "recent"])

    turns = stream.select("conv_id", "turn", "text")
    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, recent array<string>", "recent array<string>", "append", GroupStateTimeout.NoTimeout)
