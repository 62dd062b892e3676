"""Latest, last, first and top rows of groups. Every order ends with a unique key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(df: DataFrame, by: Sequence[str], *order: Column | str, k: int | None = None, name: str = "rank") -> DataFrame:
    """Row numbers within groups, cut to k; Spark cuts within partitions before it shuffles."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def latest(df: DataFrame, by: Sequence[str], time: str, key: str) -> DataFrame:
    """The latest row of each group; of equal times the one with the largest key."""
    return ranked(df, by, F.desc(time), F.desc(key), k=1).drop("rank")


def last_points(df: DataFrame, by: Sequence[str], time: str, key: str, value: str, k: int = 12) -> DataFrame:
    """Per group: its number of points, the latest value, the last k points in order, and whether it is a series."""
    rows = df.where(F.col(value).isNotNull() & F.col(time).isNotNull())
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("points"))
    last = ranked(rows, by, F.desc(time), F.desc(key), k=k)
    series = last.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(key).alias("k"), F.col(value).alias("v")))).alias("_p"))
    shaped = series.select(*by, F.transform("_p", lambda p: F.struct(p["t"].alias("t"), p["v"].alias("v"))).alias("last"), F.element_at("_p", -1)["v"].alias("latest"))
    return counts.join(shaped, list(by)).withColumn("is_series", F.col("points") >= 2)


def first_seen(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    return ranked(df, [key], *order, k=1).drop("rank")


def page(df: DataFrame, size: int, number: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).offset(size * number).limit(size)


def preview(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first rows, from 1 to 10 of them."""
    return df.orderBy(*order).limit(max(1, min(10, limit)))
