"""Queries over station readings; events stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators.history import station_history
from cadastra.session import load


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("station"), F.col("event_type").alias("metric"), "ts", "value")


def _sql(metric: str, grain: str, additive: bool) -> str:
    bucket = {"daily": "strftime(ts, '%Y-%m-%d')", "weekly": "strftime(ts, '%G-W%V')", "monthly": "strftime(ts, '%Y-%m')"}[grain]
    value = "avg" if not additive else "max" if grain == "daily" else "sum"
    total = "sum(CAST(value AS DECIMAL(28,10)))"
    v = f"{total} / count(*)" if value == "avg" else f"{value}(CAST(value AS DECIMAL(28,10)))"
    return f"""
WITH r AS (SELECT user_id AS station, ts, value, max(ts) OVER (PARTITION BY user_id) AS last
           FROM events WHERE event_type = '{metric}' AND value IS NOT NULL AND ts IS NOT NULL)
SELECT station, {bucket} AS bucket, CAST(round(CAST({v} AS DECIMAL(28,10)), 3) AS DOUBLE) AS v, count(*) AS samples
FROM r WHERE ts >= last - INTERVAL 30 DAY GROUP BY 1, 2"""


QUERIES, ORACLE_SQL = {}, {}
for _metric, _additive in (("view", False), ("click", True)):
    for _grain in ("daily", "weekly", "monthly"):
        _name = f"history_{'rain' if _additive else 'water'}_{_grain}"
        QUERIES[_name] = lambda spark, sf_dir, m=_metric, g=_grain, a=_additive: station_history(readings(spark, sf_dir), m, g, 30, a)
        ORACLE_SQL[_name] = _sql(_metric, _grain, _additive)
