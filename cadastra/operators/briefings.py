"""What a briefing says of each area: sections, dimensions, observations, decision stages and sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions.numbers import lenient_double

AVAILABLE, NO_RECORD = "available", "source_has_no_record_for_area"


def latest_by_number(rows: DataFrame, by: str, year: str, value: str, out: str) -> DataFrame:
    """(by, out): the value of the largest year, which is text; a year that is no number comes before all others."""
    return rows.groupBy(by).agg(F.max_by(value, F.struct(F.coalesce(lenient_double(F.col(year)), F.lit(-1.0)), F.col(year))).alias(out))


def indicators(wide: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, indicator, value) of the columns that have a value; one that is computed from several has none if one lacks."""
    return wide.select(by, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(by, list(columns), "indicator", "value").where("value IS NOT NULL")


def section_totals(areas: DataFrame, sections: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, section, ordinal, records, status) of every area and section, 0 included: one count a section, then a join."""
    counted = [s.groupBy(key).agg(F.count(F.lit(1)).alias("records")).select(key, F.lit(name).alias("section"), "records") for name, s in sections.items()]
    every = areas.select(key).distinct().select(key, F.posexplode(F.array(*map(F.lit, sections))).alias("ordinal", "section"))
    joined = every.join(reduce(DataFrame.unionByName, counted), [key, "section"], "left")
    records = F.coalesce("records", F.lit(0))
    return joined.select(key, "section", "ordinal", records.alias("records"), F.when(records > 0, AVAILABLE).otherwise(NO_RECORD).alias("status"))


def coverage(totals: DataFrame, key: str) -> DataFrame:
    """Per area: records of all sections, the available ones in order, and how many have none."""
    names = F.sort_array(F.collect_list(F.when(F.col("status") == AVAILABLE, F.struct("ordinal", "section"))))  # a row a section
    return totals.groupBy(key).agg(F.sum("records").alias("records"), F.array_join(F.transform(names, lambda x: x["section"]), ",").alias("available"), F.count_if(F.col("status") != AVAILABLE).alias("without"))


def dimension_summaries(compared: DataFrame, dimension: Column, area: str = "area") -> DataFrame:
    """(area, dimension, metrics, attention, strongest) from compared values: the strongest is the one that needs attention most."""
    order = F.struct(F.col("attention_strength"), F.col("metric"))
    grouped = compared.withColumn("dimension", dimension).groupBy(area, "dimension")
    return grouped.agg(F.count(F.lit(1)).alias("metrics"), F.count_if("attention").alias("attention"), F.max_by(F.when(F.col("attention"), F.col("metric")), F.when(F.col("attention"), order)).alias("strongest"))


def observations(compared: DataFrame, dimensions: DataFrame, area: str = "area", most: int = 3, else_most: int = 2) -> DataFrame:
    """(area, rank, kind, label): the metrics that need attention most; for an area without any, its first dimensions."""
    first = Window.partitionBy(area).orderBy(F.desc("attention_strength"), "metric")
    urgent = compared.where("attention").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    urgent = urgent.select(area, "rank", F.lit("comparison").alias("kind"), F.col("metric").alias("label"))
    calm = dimensions.join(urgent.select(area).distinct(), area, "left_anti")
    calm = calm.withColumn("rank", F.row_number().over(Window.partitionBy(area).orderBy("dimension"))).where(F.col("rank") <= else_most)
    return urgent.unionByName(calm.select(area, "rank", F.lit("coverage").alias("kind"), F.col("dimension").alias("label")))


def decision_chain(wide: DataFrame, area: str, stages: dict[str, str]) -> DataFrame:
    """(area, ordinal, stage, value, status): a stage without a value, or with 0, has no evidence."""
    cell = lambda name, column: F.struct(F.lit(name).alias("stage"), F.col(column).cast("double").alias("value"))
    rows = wide.select(area, F.posexplode(F.array(*(cell(n, c) for n, c in stages.items()))).alias("ordinal", "s"))
    return rows.select(area, "ordinal", "s.stage", "s.value", F.when(F.coalesce(F.col("s.value"), F.lit(0.0)) > 0, "evidence").otherwise("no_evidence").alias("status"))


def geography_decisions(sources: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """sources (decision, expected, linked, projected, ...) with grain, linkability and linked_areas.

    rules: (decision, grain, linkability). A source without such a decision goes by its projection, then by whether a
    geography is expected of it at all.
    """
    pick = lambda i, otherwise: reduce(lambda out, r: F.when(F.col("decision") == r[0], r[i]).otherwise(out), reversed(rules), otherwise)
    ruled = F.coalesce(F.col("decision").isin([r[0] for r in rules]), F.lit(False))
    projected = F.col("projected") > 0
    grain = pick(1, F.when(projected, "projection_candidate").otherwise("unverified"))
    link = pick(2, F.when(projected, "candidate_unreviewed").when(F.col("expected"), "unverified").otherwise("not_expected"))
    linked = F.when(ruled, F.when(link == "not_area_scoped", F.lit(0)).otherwise(F.col("linked"))).when(projected, F.col("projected"))
    return sources.select("*", grain.alias("grain"), link.alias("linkability"), linked.cast("long").alias("linked_areas"))


def lossless(items: DataFrame, lookup: DataFrame, name: str, key: str) -> DataFrame:
    """items with key and match: every item stays, also where lookup (name, key) knows no such name or there is none."""
    from cadastra.operators.joins import small

    joined = items.join(small(lookup.groupBy(name).agg(F.max(key).alias(key))), name, "left")
    return joined.withColumn("match", F.when(F.col(key).isNotNull(), "matched").when(F.col(name).isNull(), "no_name").otherwise("unmatched"))
