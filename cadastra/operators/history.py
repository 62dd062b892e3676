"""Station history: readings of one metric in a trailing window, by calendar bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.functions.numbers import exact, rounded
from cadastra.functions.times import bucket


def trailing(readings: DataFrame, days: int, by: list[str], ts: str = "ts") -> DataFrame:
    """The readings of at most ``days`` days before the latest of their group, the edge included."""
    last = readings.groupBy(*by).agg(F.max(ts).alias("_last"))
    return readings.join(last, by).where(F.col(ts) >= F.col("_last") - F.make_dt_interval(F.lit(days))).drop("_last")


def station_history(readings: DataFrame, metric: str, grain: str, days: int = 30, additive: bool = False) -> DataFrame:
    """(station, bucket, v, samples) of readings (station, metric, ts, value).

    A level is averaged. An additive metric (rain) takes the day's largest value, or the sum of a week or month. Null
    values are no samples. Values have 3 decimals; days must be 30 to 365.
    """
    if not 30 <= days <= 365:
        raise ValueError("days must be from 30 to 365")
    rows = trailing(readings.where(F.col("metric") == metric).where("value IS NOT NULL AND ts IS NOT NULL"), days, ["station"])
    value = F.avg(exact("value")) if not additive else F.max(exact("value")) if grain == "daily" else F.sum(exact("value"))
    return rows.groupBy("station", bucket("ts", grain).alias("bucket")).agg(value.alias("v"), F.count(F.lit(1)).alias("samples")).withColumn("v", rounded("v", 3))
