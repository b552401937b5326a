"""Trade examples as nested JSON lines: those that were taken and had a result, and the newest held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
ts string, ticker string, is_expansion boolean, is_synthetic_skip boolean, regime_bars struct<state:string>, volume_ofi double, leading_signal string,
patterns_detected array<string>, outcome struct<side_taken:string,realized_pnl:double,ground_truth_dir:string>
"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """Real trades: no expansions or skipped ones, a side of buy or sell, a result other than 0. Lines that don't parse are left out."""
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    made = F.coalesce("is_expansion", F.lit(False)) | F.coalesce("is_synthetic_skip", F.lit(False))
    return rows.where(~made & F.col("outcome.side_taken").isin("buy", "sell") & (F.coalesce("outcome.realized_pnl", F.lit(0.0)) != 0))


def held_out(trades: DataFrame, n: int = 30) -> tuple[DataFrame, DataFrame]:
    """The trades up to, and the newest n (by ts, then ticker; n is small, so they are found by a bounded sort)."""
    last = trades.select("ts", "ticker").orderBy(F.desc("ts"), F.desc("ticker")).limit(n).withColumn("late", F.lit(True))
    marked = trades.join(F.broadcast(last.distinct()), ["ts", "ticker"], "left")  # n rows
    return marked.where("late is null").drop("late"), marked.where("late").drop("late")
