"""The stateless functions run unchanged on a stream; this module holds what needs state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.sequence import gc_content


def with_gc(stream: DataFrame, sequence: str = "sequence") -> DataFrame:
    """A stream of sequences with their GC content."""
    return stream.withColumn("gc", gc_content(F.col(sequence)))


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per key and event-time window; rows later than `late` are left out and their windows' state is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
