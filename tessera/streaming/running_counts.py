"""Running counts over Structured Streaming: the stream form of the incremental n-gram counts, and windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.text import bigrams


def bigram_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """bigram, n of a stream of texts; state is one row a bigram. Use output mode update or complete."""
    return bigrams(texts, [], F.col(text)).groupBy("bigram").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """keys, start, n per tumbling window; rows later than `late` are dropped and closed windows leave the state."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a zoned timestamp
    counts = timed.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return counts.select(*keys, F.col("window.start").alias("start"), "n")


def start(counts: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet; a restart continues from the checkpoint."""
    return counts.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
