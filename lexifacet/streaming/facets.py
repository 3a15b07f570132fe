"""Term counts kept up to date over a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, term: Column, at: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, term, cnt) in tumbling windows, state dropped once events are too late to count."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), term.alias("term")).agg(F.count(F.lit(1)).alias("cnt")).select("window.start", "term", "cnt")
