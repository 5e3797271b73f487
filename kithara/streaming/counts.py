"""Cluster counts over a stream of labelled points.

Points carry cluster_id, source and an event time. Late points count until the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kithara.operators.enrichment import NOISE


def windowed_counts(points: DataFrame, time: str = "ts", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(window_start, cluster_id, sample, background, cluster_size), for a stream or a batch."""
    own = points.filter(F.col("cluster_id") != NOISE).withWatermark(time, delay)
    count = lambda s: F.count_if(F.col("source") == s).alias(s)
    df = own.groupBy(F.window(time, window), "cluster_id").agg(count("sample"), count("background"))
    return df.select(F.col("window.start").alias("window_start"), "cluster_id", "sample", "background", (F.col("sample") + F.col("background")).alias("cluster_size"))


def start(points: DataFrame, path: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Append closed windows to a parquet table."""
    writer = windowed_counts(points, **options).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
