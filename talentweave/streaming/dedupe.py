"""Streams of postings: each posting once, in bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.functions.text import dedup_key


def first_seen(stream: DataFrame, time_col: str, delay: str = "2 days", title: str = "jobname", company: str = "companyname") -> DataFrame:
    """The first of repeated postings that arrive within ``delay`` of one another; the state older
    than the watermark is dropped."""
    keyed = stream.withColumn("_key", dedup_key(F.col(title), F.col(company)))
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(stream: DataFrame, time_col: str, key: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """(start, key, n) of tumbling windows, late rows within the watermark included."""
    rows = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), key, "n")
