"""Station history over a stream of readings (an extension: the batch rules with a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.functions.numbers import exact, rounded


def windowed_history(readings: DataFrame, metric: str, width: str = "1 day", late: str = "1 hour", additive: bool = False) -> DataFrame:
    """(station, window, v, samples) of a streaming readings frame; readings later than ``late`` are dropped."""
    rows = readings.where(F.col("metric") == metric).where("value IS NOT NULL").withWatermark("ts", late)
    value = F.sum(exact("value")) if additive else F.avg(exact("value"))
    return rows.groupBy("station", F.window("ts", width)).agg(rounded(value, 3).alias("v"), F.count(F.lit(1)).alias("samples"))


def new_versions(records: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each record version once, within the watermark."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
