"""Two releases compared record by record: shapes, meanings, times, identities and counts under each artifact's contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.functions.times import iso_time
from cadastra.operators import nodes as nd
from cadastra.scratch import stored

KEY = ["artifact", "record"]


def record_digests(release: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a release (artifact, record, payload as JSON): a row a record, and a row for each time in a record.

    Records: artifact, record, copies, shape and meaning (hashes; of copies that differ the least shape and all meanings
    together), unreadable. Times: artifact, record, path, time: the least of copies; texts that are no ISO time are left out. A
    null payload is not JSON, a null artifact the empty name.
    """
    rows = release.select(F.coalesce("artifact", F.lit("")).alias("artifact"), F.col("record").cast("string").alias("record"), F.coalesce("payload", F.lit("")).alias("payload"))
    tree = nd.tree(rows, "payload", KEY)
    shapes = nd.shapes(tree).groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.min("shape").alias("shape"), F.max(F.col("problem").isNotNull()).alias("unreadable"))
    said = nd.meanings(tree).where("record IS NOT NULL").groupBy(*KEY).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.to_json(F.array("path", "context", "value")))), "\n"), 256).alias("meaning"))
    times = nd.times(tree).withColumn("time", iso_time("value")).where("time IS NOT NULL").groupBy(*KEY, "path").agg(F.min("time").alias("time"))
    return stored(shapes.join(said.hint("merge"), KEY, "left"), "digests"), times


def release_problems(base: DataFrame, head: DataFrame, contracts: DataFrame) -> DataFrame:
    """(artifact, problem): what keeps head from following base without a review.

    contracts: artifact, fall, rise and churn, the largest ratios of counts (null: 0, 1) and of identities in only one release
    (null: 0). New and vanished artifacts and those without a contract have that problem alone. Otherwise: a record's shape or
    meaning differs between the releases, or a new record has a shape that no record of base has; counts fall or rise by more
    than they may; identities churn by more; a time that a record had is gone or earlier in the same record; and in head,
    records are repeated, have no identity, or are no JSON (or too deep).

    Tables of records are joined by sorting: their files are so much smaller than their rows that Spark would take them for fit to broadcast.
    """
    (old, old_times), (new, new_times) = record_digests(base), record_digests(head)
    side = lambda df, p: df.where("record IS NOT NULL").select(*KEY, *(F.col(c).alias(f"{p}{c}") for c in ("copies", "shape", "meaning", "unreadable")))
    both = stored(side(old, "b_").join(side(new, "h_"), KEY, "full"), "compared")
    shared = F.col("b_copies").isNotNull() & F.col("h_copies").isNotNull()
    differs = lambda c: F.max(shared & ~F.col(f"b_{c}").eqNullSafe(F.col(f"h_{c}")))
    compared = both.groupBy("artifact").agg(
        F.count_if(shared).alias("shared"), F.count(F.lit(1)).alias("either"), differs("shape").alias("reshaped"), differs("meaning").alias("reworded"),
    )
    counted = lambda df, p: df.groupBy("artifact").agg(F.sum("copies").alias(f"{p}rows"), F.max(F.col("record").isNotNull() & (F.col("copies") > 1)).alias(f"{p}repeated"), F.max(F.col("record").isNull()).alias(f"{p}nameless"), F.max("unreadable").alias(f"{p}unreadable"))
    added = both.where("b_copies IS NULL").select("artifact", F.col("h_shape").alias("shape")).distinct()
    unseen = added.join(old.where("record IS NOT NULL").select("artifact", "shape").distinct(), ["artifact", "shape"], "left_anti").groupBy("artifact").agg(F.lit(True).alias("unseen"))
    kept_times = old_times.join(new.where("record IS NOT NULL").select(*KEY).hint("merge"), KEY, "left_semi").join(new_times.withColumnRenamed("time", "_now").hint("merge"), [*KEY, "path"], "left")
    back = kept_times.where("_now IS NULL OR _now < time").groupBy("artifact").agg(F.lit(True).alias("back"))

    per = counted(old, "b_").join(counted(new, "h_"), "artifact", "full")
    limits = contracts.select("artifact", F.lit(True).alias("contract"), F.coalesce("fall", F.lit(0.0)).alias("fall"), F.coalesce("rise", F.lit(1.0)).alias("rise"), F.coalesce("churn", F.lit(0.0)).alias("most"))
    for more in (compared, unseen, back, limits):
        per = per.join(more, "artifact", "left")
    b, h = F.col("b_rows"), F.col("h_rows")
    alone = F.when(b.isNull(), "artifact is new").when(h.isNull(), "artifact is gone").when(F.col("contract").isNull(), "no contract")
    found = F.array(
        F.when(F.col("reshaped") | F.coalesce("unseen", F.lit(False)), "shape changed"),
        F.when(F.col("reworded"), "meaning changed"),
        F.when((h < b) & ((b - h) / b > F.col("fall")), "rows fell"),
        F.when((h > b) & ((h - b) / b > F.col("rise")), "rows rose"),
        F.when(F.try_divide(F.col("either") - F.col("shared"), F.col("either")) > F.col("most"), "identities churned"),
        F.when(F.col("back"), "a record's time went back"),
        F.when(F.col("h_repeated"), "records repeat"),
        F.when(F.col("h_nameless"), "records without an identity"),
        F.when(F.col("h_unreadable"), "records that cannot be read"),
    )
    problems = F.when(alone.isNotNull(), F.array(alone)).otherwise(F.filter(found, lambda p: p.isNotNull()))
    return per.select("artifact", F.explode(problems).alias("problem"))
