"""Aggregates: benchmarks, distributions, rollups, groupings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions.ids import group_id
from cadastra.functions.numbers import exact, rounded, share
from cadastra.functions.text import collapse, present_collapsed
from cadastra.scratch import stored


#: A group of so many values at most is looked through by one task; ranges of larger ones are narrowed down first.
IN_TASK = 1_000_000
RANGES = 1024


def medians(values: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): the true median of each group's values, NaN being the greatest; null groups are a group.

    Different values are counted first. Of groups with more than IN_TASK of them, RANGES equal parts of the range are counted, and only the
    part that holds the middle rank stays (of an even number of values, each of two ranks its own), until few enough are left: so no task
    holds a whole group. Each round makes the range a thousand times narrower.
    """
    counts = stored(values.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), "values")
    ranks = counts.groupBy(F.col("g").alias("_g")).agg(F.sum("n").alias("all"))
    ranks = ranks.select("_g", F.expr("(all - 1) div 2").alias("low"), F.expr("all div 2").alias("high"), F.lit("both").alias("side"), F.lit(0).cast("long").alias("under"))
    left = counts.join(ranks, F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
    same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("side") == F.col("_side"))
    upto = lambda by: F.sum("n").over(Window.partitionBy("g", "side").orderBy(by)) + F.col("under")
    holds = (F.col("upto") > F.col("low")) & (F.col("upto") - F.col("n") <= F.col("high"))
    while True:
        left = stored(left, "middle")
        finite = F.when(F.abs("v") < float("inf"), F.col("v"))
        spans = left.groupBy(F.col("g").alias("_g"), F.col("side").alias("_side")).agg(F.count(F.lit(1)).alias("different"), F.min(finite).alias("least"), F.max(finite).alias("most")).where(F.col("different") > IN_TASK)
        if not spans.limit(1).count():
            break
        span, half = F.col("most") - F.col("least"), lambda c: F.col(c) / 2
        place = F.when(span < float("inf"), F.try_divide(F.col("v") - F.col("least"), span)).otherwise((half("v") - half("least")) / (half("most") - half("least")))
        part = F.when(F.isnan("v"), RANGES + 1).when(F.col("v") == float("inf"), RANGES).when(F.col("v") == float("-inf"), -1).otherwise(F.coalesce(F.floor(place * (RANGES - 1)), F.lit(0)))
        parted = left.join(spans, same, "left").withColumn("part", F.when(F.col("different").isNotNull(), part).otherwise(0)).select("g", "side", "v", "n", "low", "high", "under", "part")
        sums = parted.groupBy("g", "side", "part", "low", "high", "under").agg(F.sum("n").alias("n"))
        chosen = sums.withColumn("upto", upto("part")).where(holds)  # of at most RANGES and three rows a group
        chosen = chosen.withColumn("before", F.col("upto") - F.col("n")).groupBy(F.col("g").alias("_g"), F.col("side").alias("_side")).agg(F.min("part").alias("from"), F.max("part").alias("to"), F.min("before").alias("before_from"), F.max("before").alias("before_to"))
        stays = parted.drop("under").join(chosen, same).where(F.col("part").isin(F.col("from"), F.col("to")))
        one, lower = F.col("from") == F.col("to"), F.col("part") == F.col("from")
        side = F.when(one, F.col("side")).when(lower, "low").otherwise("high")
        left = stays.select("g", side.alias("side"), "v", "n", F.when(one | lower, F.col("low")).otherwise(F.col("high")).alias("low"), F.when(one | ~lower, F.col("high")).otherwise(F.col("low")).alias("high"), F.when(lower, F.col("before_from")).otherwise(F.col("before_to")).alias("under"))
    middle = left.withColumn("upto", upto("v")).where(holds).groupBy("g").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return middle.select(F.col("g").alias(by), F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.col("a") + F.col("b")) / 2).alias("median"))


def benchmark(values: DataFrame, by: str = "metric", value: str = "value") -> DataFrame:
    """(by, minimum, median, maximum, areas) over the areas that have a value; the median is the true one.

    Where no group has over IN_TASK values, Spark's own median holds them; else medians() finds it without a group in one task.
    """
    there = values.where(F.col(value).isNotNull())
    ends = [F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.count(F.lit(1)).alias("areas")]
    if not there.groupBy(by).count().where(F.col("count") > IN_TASK).limit(1).count():
        return there.groupBy(by).agg(ends[0], F.median(value).alias("median"), *ends[1:])
    rest = there.groupBy(by).agg(*ends).withColumnRenamed(by, "_by")
    return medians(there, by, value).join(rest, F.col(by).eqNullSafe(F.col("_by"))).select(by, "minimum", "median", "maximum", "areas")


def extremes(values: DataFrame, by: str, name: str, value: str, k: int = 2) -> DataFrame:
    """The k lowest and k highest of each group: (by, side, rank, name, value). Ties stand by name, also from above."""
    rows = values.where(F.col(value).isNotNull())
    out = []
    for side, order in (("lowest", [F.col(value), F.col(name)]), ("highest", [F.desc(value), F.desc(name)])):
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)
        out.append(ranked.select(by, F.lit(side).alias("side"), "rank", name, value))
    return out[0].unionByName(out[1])


def against_median(values: DataFrame, middles: DataFrame, by: str = "metric", value: str = "value", concern: Column | None = None) -> DataFrame:
    """Each value with relation (near, above, below), position_pct in its range, attention and attention_strength.

    The gap is relative to the median, or absolute where that is 0; up to a tenth is near. The position is 50 in a range
    of one value. concern (high or low) says which side needs attention.
    """
    joined = values.where(F.col(value).isNotNull()).join(middles, by)
    v, m, low, high = (F.col(c).cast("double") for c in (value, "median", "minimum", "maximum"))
    gap = F.when(m == 0, F.abs(v - m)).otherwise(F.try_divide(F.abs(v - m), F.abs(m)))
    relation = F.when(gap <= 0.10, "near").when(v > m, "above").otherwise("below")
    position = F.when(high == low, 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(v - low, high - low) * 100)))
    wanted = F.lit(None).cast("string") if concern is None else concern
    attention = F.coalesce(((wanted == "high") & (relation == "above")) | ((wanted == "low") & (relation == "below")), F.lit(False))
    return joined.withColumn("relation", relation).withColumn("position_pct", rounded(position, 1)).withColumn("attention", attention).withColumn("attention_strength", F.when(attention, rounded(gap, 4)).otherwise(0.0))


def concern_signals(values: DataFrame, middles: DataFrame, directions: dict[str, str], by: str = "metric", value: str = "value", name: str = "area", k: int = 24) -> DataFrame:
    """The k strongest concerns: values over a tenth beyond their median on the side that matters; median 0 or null is skipped."""
    direction = F.create_map(*(F.lit(x) for kv in directions.items() for x in kv))[F.col(by)]
    joined = values.where(F.col(value).isNotNull()).join(middles.where("median IS NOT NULL AND median <> 0"), by)
    gap = F.try_divide(F.col(value) - F.col("median"), F.abs("median"))
    marked = joined.where(((direction == "high") & (gap > 0.10)) | ((direction == "low") & (gap < -0.10)))
    out = marked.select(name, by, value, "median", F.when(gap > 0, "above").otherwise("below").alias("comparison"), rounded(F.abs(gap), 4).alias("gap_strength"))
    return out.orderBy(F.desc("gap_strength"), name, by).limit(k)


def to_index(values: DataFrame, columns: Sequence[str], places: int = 6) -> DataFrame:
    """Each column over its largest value; null counts as 0 for display, and a largest of null or 0 as 1."""
    top = values.agg(*(F.max(c).alias(f"_{c}") for c in columns))
    out = values.join(F.broadcast(top))  # one row
    for c in columns:
        whole = F.when(F.coalesce(F.col(f"_{c}"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col(f"_{c}"))
        out = out.withColumn(f"{c}_index", rounded(F.coalesce(F.col(c), F.lit(0)).cast("double") / whole, places))
    return out.drop(*(f"_{c}" for c in columns))


def distribution(items: DataFrame, label: str, ordinal: str, k: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """The k commonest labels (by, label, value, share_pct, rank); ties by first appearance.

    The share has one decimal and is of all labelled items, not of the k shown.
    """
    counts = items.where(present_collapsed(label).isNotNull()).groupBy(*by, present_collapsed(label).alias("label")).agg(F.count(F.lit(1)).alias("value"), F.min(ordinal).alias("_first"))
    share = lambda whole: rounded(F.col("value") * 100.0 / whole, 1).alias("share_pct")
    if not by:  # no window over all labels: the k first are found in every part, the total is one row
        top = counts.orderBy(F.desc("value"), "_first").limit(k)
        whole = counts.agg(F.sum("value").alias("_whole"))
        ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("value"), "_first")))
        return ranked.join(F.broadcast(whole)).select("label", "value", "rank", share(F.col("_whole")))
    own, all_of = Window.partitionBy(*by).orderBy(F.desc("value"), "_first"), Window.partitionBy(*by)
    ranked = counts.withColumn("rank", F.row_number().over(own)).withColumn("share_pct", share(F.sum("value").over(all_of)))
    return ranked.where(F.col("rank") <= k).drop("_first")


def commonest(items: DataFrame, label: str, k: int = 6) -> DataFrame:
    """The k commonest non-empty labels; ties by label."""
    counts = items.where(F.col(label).isNotNull() & (F.col(label) != "")).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("value"))
    return counts.orderBy(F.desc("value"), "label").limit(k)


def tally(items: DataFrame, label: str, missing: str) -> DataFrame:
    return items.groupBy(F.coalesce(F.when(F.col(label) != "", F.col(label)), F.lit(missing)).alias("label")).agg(F.count(F.lit(1)).alias("value"))


def region_rollup(areas: DataFrame, region: str, name: str, value: str, lon: str, lat: str) -> DataFrame:
    """Per region: areas, how many have a value, the least value and its area, mean centre and bounding box."""
    has = F.col(value).isNotNull()
    order = F.when(has, F.struct(F.col(value), F.col(name)))
    return areas.groupBy(region).agg(
        F.count(F.lit(1)).alias("areas"), F.count_if(has).alias("with_value"), F.min(value).alias("least"), F.min_by(F.when(has, F.col(name)), order).alias("least_area"),
        rounded(F.avg(exact(lon)), 6).alias("center_lon"), rounded(F.avg(exact(lat)), 6).alias("center_lat"),
        F.min(lon).alias("min_lon"), F.min(lat).alias("min_lat"), F.max(lon).alias("max_lon"), F.max(lat).alias("max_lat"),
    )


def provisional_groups(items: DataFrame, keys: Sequence[str], missing: str, record: str, business: str, district: str, subdistrict: str, updated: str) -> DataFrame:
    """Groups without an official id: one row per combination of keys, a missing one counting as ``missing``.

    The id hashes the keys. districts nests each district's sorted subdistricts.
    """
    named = items.select("*", *(F.when(collapse(k) != "", collapse(k)).otherwise(missing).alias(f"_{k}") for k in keys))
    by = [f"_{k}" for k in keys]
    inner = named.groupBy(*by, F.col(district).alias("district")).agg(F.sort_array(F.collect_set(subdistrict)).alias("subdistricts"), F.count(F.lit(1)).alias("_n"), F.max(updated).alias("_u"))
    out = inner.groupBy(*by).agg(F.sum("_n").alias("participants"), F.max("_u").alias("latest_update"), F.sort_array(F.collect_list(F.struct("district", "subdistricts"))).alias("districts"))
    # businesses are counted apart: the default group's may be very many, and are never held as a set
    each = named.where(F.col(business).isNotNull()).select(*by, business).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("businesses"))
    out = out.join(each, by, "left").withColumn("businesses", F.coalesce("businesses", F.lit(0)))
    return out.select(group_id(*by).alias("group_id"), *(F.col(f"_{k}").alias(k) for k in keys), "participants", "businesses", "latest_update", "districts")


def two_level_rollup(items: DataFrame, outer: str, inner: str, project: str, k: int = 12, j: int = 6) -> DataFrame:
    """Distinct projects of the k largest outer groups, and in each of its j largest inner ones; ties by name."""
    top = items.where(F.col(outer).isNotNull()).groupBy(outer).agg(F.countDistinct(project).alias("outer_projects")).orderBy(F.desc("outer_projects"), outer).limit(k)
    own = items.join(F.broadcast(top), outer).groupBy(outer, "outer_projects", inner).agg(F.countDistinct(project).alias("inner_projects")).where(F.col(inner).isNotNull())
    rank = Window.partitionBy(outer).orderBy(F.desc("inner_projects"), inner)
    return own.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= j)


def shares(items: DataFrame, label: str, amount: str) -> DataFrame:
    """Sum and share of the total per label, with 2 and 6 decimals; all shares are 0 if the total is."""
    sums = items.groupBy(label).agg(F.sum(exact(amount)).alias("_sum"))
    whole = F.sum("_sum").over(Window.partitionBy(F.lit(0)))
    return sums.select(label, rounded("_sum", 2).alias("amount"), rounded(share(F.col("_sum"), whole), 6).alias("share"))


def conditional_counts(items: DataFrame, by: Sequence[str], **conditions: Column) -> DataFrame:
    """count and, per name, how many rows its condition holds for."""
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def single_as_of(records: DataFrame, by: Sequence[str], as_of: str = "as_of") -> DataFrame:
    """The run's as_of if its records have exactly one, else null."""
    return records.groupBy(*by).agg(F.when(F.countDistinct(as_of) == 1, F.max(as_of)).alias(as_of), F.count(F.lit(1)).alias("records"))


def funding(items: DataFrame, funders: str, keyword: str, record: str) -> DataFrame:
    """Entries of an array of (funder, amount) whose funder holds the keyword: records, entries, known amounts, their sum."""
    entries = items.select(record, F.explode(funders).alias("e")).where(F.contains(F.col("e.funder"), F.lit(keyword)))
    return entries.agg(F.countDistinct(record).alias("records"), F.count(F.lit(1)).alias("entries"), F.count("e.amount").alias("known"), rounded(F.sum(exact(F.col("e.amount"))), 2).alias("amount"))


def item_count(payload: Column) -> Column:
    """Items of a JSON document: the first of these arrays that it has, else 1."""
    found = [F.json_array_length(F.get_json_object(payload, f"$.{k}")) for k in ("features", "provinces", "sources", "items")]
    return F.coalesce(*found, F.lit(1))
