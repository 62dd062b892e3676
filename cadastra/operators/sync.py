"""Idempotent writes: versions, upserts and swaps, each staged and then put in place."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cadastra.operators.gates import GateError, enforce
from cadastra.scratch import stored as stored_once


def unseen(batch: DataFrame, known: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The batch's rows with keys that are not known yet; of rows with equal keys the first by order, then by the other columns.

    Known rows go before the others are compared, and equal keys are reduced in each part before they are shuffled.
    """
    new = batch.join(known.select(*keys), list(keys), "left_anti")
    others = [c for c in batch.columns if c not in keys]
    return new.groupBy(*keys).agg(F.min(F.struct(order, *(c for c in others if c != order))).alias("_first")).select(*(F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in batch.columns))


def load_counts(batch: DataFrame, known: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row: loaded and skipped."""
    new = unseen(batch, known, keys, order).agg(F.count(F.lit(1)).alias("loaded"))
    return batch.agg(F.count(F.lit(1)).alias("_all")).join(F.broadcast(new)).select("loaded", (F.col("_all") - F.col("loaded")).alias("skipped"))


def classify(stored: DataFrame, wanted: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """(key, action): inserted, updated, unchanged or deleted."""
    old = stored.select(key, F.struct(*compared).alias("_old"))
    new = wanted.select(key, F.struct(*compared).alias("_new"))
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return old.join(new, key, "full").select(key, action.alias("action"))


def merged(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted's rows, and stored's whose key wanted lacks."""
    return wanted.unionByName(stored.join(wanted.select(key), key, "left_anti"))


def append_versions(batch: DataFrame, path: str, keys: Sequence[str], order: str, by: Sequence[str] = ("source_id",)) -> int:
    """Appends unseen versions to a Parquet table partitioned by source; returns how many. Running it again appends none."""
    spark = batch.sparkSession
    new = unseen(batch, spark.read.parquet(path), keys, order) if exists(spark, path) else unseen(batch, batch.limit(0), keys, order)
    staged = f"{path.rstrip('/')}_staged_{uuid.uuid4().hex}"
    new.write.parquet(staged)
    rows = spark.read.parquet(staged)
    n = rows.count()
    if n:
        rows.write.mode("append").partitionBy(*by).parquet(path)
    delete(spark, staged)
    return n


class Measured:
    """What is counted of rows while they are written, and what it must come to.

    measures are aggregates by name without distinct ones (those need a shuffle of their own: take a gate). accept is given
    their values and returns what is wrong with them, or None. values has them once the rows are written.
    """

    def __init__(self, accept: Callable[[dict], str | None] | None = None, **measures: Column) -> None:
        self.accept, self.measures, self.values = accept, measures, {}


Gates = dict[str, DataFrame | Callable[[DataFrame], DataFrame]]


def staged(rows: DataFrame, path: str, gates: Gates | None = None, measured: Measured | None = None, by: str | None = None) -> str:
    """Writes rows beside path and returns where; if a measure or a gate finds something, they are deleted and it is raised.

    Measures are taken in the pass that writes. A gate is violations, or a function of the written rows that gives them: what
    is gated is what will be published, not a second computation of it.
    """
    spark, target = rows.sparkSession, f"{path.rstrip('/')}_staged_{uuid.uuid4().hex}"
    seen = Observation(f"measured {uuid.uuid4().hex}") if measured and measured.measures else None
    if seen:
        rows = rows.observe(seen, *(c.alias(n) for n, c in measured.measures.items()))
    try:
        (rows.write.partitionBy(by) if by else rows.write).parquet(target)
        if measured:
            measured.values = seen.get if seen else {}
            if measured.accept and (problem := measured.accept(measured.values)):
                raise GateError(problem)
        written = spark.read.schema(rows.schema).parquet(target)
        for name, gate in (gates or {}).items():
            enforce(name, gate(written) if callable(gate) else gate)
    except Exception:
        delete(spark, target)
        raise
    return target


def swap_partitions(rows: DataFrame, path: str, by: str, gates: Gates | None = None, measured: Measured | None = None) -> None:
    """Replaces the partitions that rows have, and no other, once the staged rows have passed.

    The staged rows are deleted even if the swap fails; the partitions are then as they were or to be swapped again.
    """
    spark = rows.sparkSession
    aside = staged(rows, path, gates, measured)
    try:
        written = spark.read.schema(rows.schema).parquet(aside)
        written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    finally:
        delete(spark, aside)


def publish(rows: DataFrame, path: str, gates: Gates | None = None, measured: Measured | None = None, by: str | None = None) -> None:
    """Replaces a whole table: written aside, measured and gated, then renamed into place.

    The old table is set aside, not deleted, until the new one has its name: a crash between leaves both.
    """
    spark = rows.sparkSession
    new = staged(rows, path, gates, measured, by)
    _, files, hadoop = _hadoop(spark, path)
    aside = f"{path.rstrip('/')}_replaced_{uuid.uuid4().hex}"
    had = files.exists(hadoop(path))
    if had and not files.rename(hadoop(path), hadoop(aside)):
        raise OSError(f"cannot set aside {path}")
    if not files.rename(hadoop(new), hadoop(path)):
        if had:
            files.rename(hadoop(aside), hadoop(path))
        raise OSError(f"cannot put {path} in place")
    delete(spark, aside)


def sync_layers(stored: DataFrame | None, wanted: DataFrame, rows: DataFrame, path: str, layer: str, key: str) -> DataFrame:
    """Replaces the layers that changed, all or none, and returns the run's log: (layer, action, expected, loaded).

    stored (or None) and wanted are snapshots, a row a layer: layer, content_hash, feature_count. A layer is unchanged if hash and
    count are those stored and path has as many rows of it. Of the others all of rows are taken: each layer's rows and different keys must be as
    many as its snapshot says (one at least), and no row may be of a layer that wanted lacks. The counts are those of the rows as staged.
    """
    spark = rows.sparkSession
    have = spark.read.parquet(path).groupBy(layer).agg(F.count(F.lit(1)).alias("_have")) if exists(spark, path) else spark.createDataFrame([], f"{layer} string, _have long")
    snapshot = lambda df, n: df.select(layer, F.col("content_hash").alias(f"_h{n}"), F.col("feature_count").cast("long").alias(f"_c{n}"))
    old = snapshot(stored if stored is not None else wanted.limit(0), 0)
    plan = snapshot(wanted, 1).join(old, layer, "left").join(have, layer, "left")
    same = (F.col("_h0") == F.col("_h1")) & (F.col("_c0") == F.col("_c1")) & (F.col("_have") == F.col("_c1"))
    plan = stored_once(plan.select(layer, F.when(F.coalesce(same, F.lit(False)), "unchanged").when(F.col("_h0").isNull() & F.col("_have").isNull(), "inserted").otherwise("replaced").alias("action"), F.col("_c1").alias("expected")), "plan")
    changed = plan.where("action <> 'unchanged'")
    unplanned = rows.join(plan.select(layer), layer, "left_anti").limit(1)

    def counted(written: DataFrame) -> DataFrame:
        per_key = written.groupBy(layer, key).agg(F.count(F.lit(1)).alias("_n"))
        counts = per_key.groupBy(layer).agg(F.sum("_n").alias("_rows"), F.count(key).alias("_keys"))
        both = changed.join(counts, layer, "full")
        return both.where(~(F.col("expected").eqNullSafe(F.coalesce("_rows", F.lit(0))) & F.col("expected").eqNullSafe(F.coalesce("_keys", F.lit(0)))))

    if changed.limit(1).count():
        taken = rows.join(changed.select(layer), layer, "left_semi")
        swap_partitions(taken, path, layer, {"a snapshot without rows": changed.where("expected IS NULL OR expected < 1"), "rows of a layer without a snapshot": unplanned, "a layer's rows are not as many as its snapshot says": counted})
    return plan.select(layer, "action", "expected", F.when(F.col("action") == "unchanged", F.lit(0)).otherwise(F.col("expected")).alias("loaded"))


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return jvm, make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def exists(spark: SparkSession, path: str) -> bool:
    _, files, hadoop = _hadoop(spark, path)
    return files.exists(hadoop(path))


def delete(spark: SparkSession, path: str) -> None:
    _, files, hadoop = _hadoop(spark, path)
    files.delete(hadoop(path), True)


def run_log(runs: DataFrame, run: str, source: str, status: str, records: int, error: str | None, clock) -> DataFrame:
    """runs with one row more; an error is cut to 4000 characters."""
    row = runs.sparkSession.createDataFrame([(run, source, status, records, None if error is None else error[:4000], clock)], runs.schema)
    return runs.unionByName(row)
