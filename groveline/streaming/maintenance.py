"""Extension: group statistics kept up to date over a stream of property readings.

The reference works on whole tables only; this is an addition for streams and claims no parity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_groups(readings: DataFrame, group: str, value: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """group, start, readings, mean, least and greatest value of each group and window; works on streams and on tables.

    Readings that come more than ``late`` behind the newest are dropped on a stream, so its state stays bounded.
    """
    readings = readings.withColumn(time, F.col(time).cast("timestamp"))
    if readings.isStreaming:
        readings = readings.withWatermark(time, late)
    out = readings.groupBy(F.window(time, window).alias("_w"), group).agg(F.count(F.lit(1)).alias("readings"), F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return out.select(group, F.col("_w.start").alias("start"), "readings", "mean_value", "min_value", "max_value")
