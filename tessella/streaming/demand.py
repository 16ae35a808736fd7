"""An extension: streaming demand. Units get finer as questions come in, so spans are counted as they are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def demand(asked: DataFrame, k: int, watermark: str = "1 hour") -> DataFrame:
    """asked (ts, pid, s, e, qid), a stream: spans that at least k distinct questions asked for.

    A question counts once within the watermark, after which its state goes.
    """
    once = asked.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["pid", "s", "e", "qid"])
    return once.groupBy("pid", "s", "e").agg(F.count("*").alias("n")).where(F.col("n") >= k)
