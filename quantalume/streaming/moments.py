"""Moment-based statistics over streams: partial aggregates merge, so windows stay bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import clean


def windowed_moments(stream: DataFrame, time: str, x: str, window: str, slide: str | None = None, watermark: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, variance, skewness, kurtosis of ``x`` in event-time windows; late rows beyond the watermark drop."""
    v = clean(x)
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)
    s = s.groupBy(F.window(time, window, slide).alias("window"), *by)
    s = s.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))
    return s.select("window.start", "window.end", *by, "n", "mean", "variance", "skewness", "kurtosis")
