"""Token counts of a stream, by time window; the column expressions are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as tx


def windowed_counts(stream: DataFrame, time: str, text: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """``(start, token, n)``; rows later than ``late`` behind the newest are dropped by the watermark."""
    words = stream.withWatermark(time, late).select(time, F.explode(tx.tokens(F.coalesce(F.col(text), F.lit("")))).alias("token"))
    return words.groupBy(F.window(time, window).alias("w"), "token").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "token", "n")
