"""Gates: queries that must return no rows. Each says what is wrong, never the value itself."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.ids import identity_problem
from cadastra.functions.text import holds_contact
from cadastra.operators import nodes as nd
from cadastra.operators.joins import churn, small


class GateError(ValueError):
    """A gate found rows."""


def enforce(name: str, violations: DataFrame) -> None:
    """Raises if there is a violation; looks at one row only."""
    if violations.limit(1).count():
        raise GateError(name)


def complete(rows: DataFrame, key: str, reported: int | None = None) -> DataFrame:
    """Rows, distinct ids and the reported total must agree: one row if they don't."""
    counted = rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("ids")).withColumn("reported", F.lit(reported).cast("long") if reported is not None else F.col("rows"))
    return counted.where("rows <> ids OR rows <> reported")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def missing_pairs(rows: DataFrame, left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """The pairs of two small dimensions that rows lack. Both are dimensions: their product is what must be there."""
    wanted = left.select(left_key).distinct().join(small(right.select(right_key).distinct()))
    return wanted.join(rows.select(left_key, right_key).distinct(), [left_key, right_key], "left_anti")


def unknown_references(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct().join(dimension.select(key), key, "left_anti")


def unreconciled(rows: DataFrame, by: str, published: DataFrame, total: str) -> DataFrame:
    """Published totals that differ from the number of rows with that label."""
    counts = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    joined = counts.join(published.select(by, F.col(total).alias("published")), by, "full")
    return joined.where(~F.coalesce("rows", F.lit(0)).eqNullSafe(F.coalesce("published", F.lit(0)).cast("long")))


def not_partitioned(total: DataFrame, *parts: DataFrame) -> DataFrame:
    """One row if the parts' rows don't add up to the total's."""
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    sums = reduce(DataFrame.unionByName, [count(p, "n") for p in parts]).agg(F.sum("n").alias("parts"))
    return count(total, "total").join(F.broadcast(sums)).where("total <> parts")


def wrong_counts(actual: DataFrame, expected: DataFrame, key: str, count: str) -> DataFrame:
    """Keys whose count is not the expected one, or that only one side has."""
    joined = actual.select(key, F.col(count).alias("actual")).join(expected.select(key, F.col(count).alias("expected")), key, "full")
    return joined.where(~F.col("actual").cast("long").eqNullSafe(F.col("expected").cast("long")))


def unsafe_cells(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, problem, cells): cells that a spreadsheet would take for a formula, and missing ones.

    White space and byte-order marks before a cell's text do not count; a number with a sign is no formula.
    """
    text = lambda c: F.regexp_replace(F.col(c).cast("string"), r"^[\x{FEFF} \t\r\n\x0B\f]+", "")
    odd = lambda c: F.coalesce(text(c).rlike("^[=@]") | (text(c).rlike(r"^[+\-]") & ~text(c).rlike(r"^[+-](\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")), F.lit(False))
    counts = rows.agg(*(x for c in columns for x in (F.count_if(odd(c)).alias(f"formula {c}"), F.count_if(F.col(c).isNull()).alias(f"missing {c}"))))
    names = [f"{kind} {c}" for c in columns for kind in ("formula", "missing")]
    long = counts.unpivot([], [F.col(f"`{n}`") for n in names], "_what", "cells").where("cells > 0")
    return long.select(F.regexp_extract("_what", "^[a-z]+ (.*)$", 1).alias("column"), F.regexp_extract("_what", "^([a-z]+) ", 1).alias("problem"), "cells")


def wrong_headers(files: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(path, problem) of files (path, header, an array) whose header repeats a name or is not the expected one."""
    problem = F.when(F.size(F.array_distinct("header")) < F.size("header"), "repeated name").when(~F.coalesce(F.col("header") == F.array(*map(F.lit, expected)), F.lit(False)), "other names")
    return files.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def ragged_rows(rows: DataFrame, key: str, cells: str, width: int) -> DataFrame:
    """(key, problem) of rows whose array of cells has more or fewer than width."""
    problem = F.when(F.size(cells) > width, "extra cells").when(F.coalesce(F.size(cells), F.lit(0)) < width, "missing cells")
    return rows.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def ragged_files(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(path, _dataset, _ordinal, keep, problem) of rows with more or fewer cells than the header of their own file."""
    problem = F.when(F.size("cells") > F.size("header"), "extra cells").when(F.size("cells") < F.size("header"), "missing cells")
    return rows.select("path", "_dataset", "_ordinal", *keep, problem.alias("problem")).where("problem IS NOT NULL")


def wrong_content(records: DataFrame, dataset: str, record_id: str, expected: dict[str, int]) -> DataFrame:
    """(dataset, problem, n): datasets without their fixed number of records, unexpected ones, and ids that lack or repeat."""
    counts = records.groupBy(F.col(dataset).alias("dataset")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(record_id).isNull() | (F.col(record_id).cast("string") == "")).alias("no_id"), F.countDistinct(record_id).alias("ids"), F.count(record_id).alias("with_id"))
    wanted = records.sparkSession.createDataFrame(list(expected.items()), "dataset string, wanted long")
    both = counts.join(F.broadcast(wanted), "dataset", "full")  # a row a dataset
    found = F.array(
        F.struct(F.when(~F.col("n").eqNullSafe(F.col("wanted")), "another number of records").alias("problem"), F.coalesce("n", F.lit(0)).alias("n")),
        F.struct(F.when(F.col("no_id") > 0, "records without an id").alias("problem"), F.col("no_id").alias("n")),
        F.struct(F.when(F.col("ids") < F.col("with_id"), "repeated ids").alias("problem"), (F.col("with_id") - F.col("ids")).alias("n")),
    )
    return both.select("dataset", F.inline(F.filter(found, lambda f: f["problem"].isNotNull())))


def contact_values(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    found = [rows.where(holds_contact(c)).select(key, F.lit(c).alias("column")) for c in columns]
    return reduce(DataFrame.unionByName, found)


def drift(base: DataFrame, head: DataFrame, key: str, as_of: str, fall: float = 0.0, rise: float = 1.0, kept: Sequence[str] = (), new_needs_review: bool = False) -> DataFrame:
    """(dataset, problem): counts that fall or rise by more than these ratios, vanished datasets, and as_of going back.

    base and head have rows per dataset: key, rows and as_of, an ISO date as text. kept: hashes of theirs that may not
    change, such as of shape, meaning and provenance.
    """
    own = lambda df, p: df.select(key, *(F.col(c).alias(f"{p}{c}") for c in ("rows", as_of, *kept)))
    joined = own(base, "b_").join(own(head, "h_"), key, "full")
    both = F.col("b_rows").isNotNull() & F.col("h_rows").isNotNull()
    problems = F.filter(
        F.array(
            F.when(F.col("h_rows").isNull(), "dataset is gone"),
            F.when(F.col("b_rows").isNull() & F.lit(new_needs_review), "dataset is new"),
            F.when(F.col("h_rows") < F.col("b_rows") * (1 - fall), "rows fell"),
            F.when((F.col("b_rows") > 0) & (F.col("h_rows") > F.col("b_rows") * (1 + rise)), "rows rose"),
            F.when(F.col(f"h_{as_of}") < F.col(f"b_{as_of}"), "as_of went back"),
            *(F.when(both & ~F.col(f"b_{c}").eqNullSafe(F.col(f"h_{c}")), f"{c} changed") for c in kept),
        ),
        lambda p: p.isNotNull(),
    )
    return joined.select(key, F.explode(problems).alias("problem"))


def identity_churn(base: DataFrame, head: DataFrame, key: str, most: float) -> DataFrame:
    """One row (shared, either, churn) if more than ``most`` of the ids of both releases are in only one."""
    return churn(base, head, key).where(F.col("churn") > most)


def invalid_boxes(features: DataFrame, key: str, lon: Sequence[str], lat: Sequence[str]) -> DataFrame:
    """Features whose coordinates are missing, not finite, out of range, or in the wrong order."""
    bad: Column = F.lit(False)
    for columns, limit in ((lon, 180.0), (lat, 90.0)):
        for c in columns:
            bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) > limit)
        bad = bad | (F.col(columns[0]) > F.col(columns[-1]))
    return features.where(F.coalesce(bad, F.lit(True))).select(key)


def capped(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """rows, or an error if there are more than ``most``: a source that reaches its cap may have been cut."""
    if rows.limit(most + 1).count() > most:
        raise GateError(f"more than {most} rows")
    return rows


def not_ready(sources: DataFrame) -> DataFrame:
    """(source_id, problem) of sources (policy, approved, pending) that production may not load."""
    problem = F.when(F.col("policy") == "restricted", "restricted").when(F.col("pending"), "pending").when(~F.coalesce("approved", F.lit(False)), "not approved")
    return sources.select("source_id", problem.alias("problem")).where("problem IS NOT NULL")


def invalid_geometries(features: DataFrame, key: str, geometry: str) -> DataFrame:
    """(key, problem) of the features whose GeoJSON geometry, as text, is not valid: closed rings, enough positions, in range."""
    return nd.wrong_geometries(features, geometry, [key])


def wrong_declared_counts(documents: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, path, problem) of JSON objects at any depth whose declared counts are not those of their lists."""
    return nd.miscounted(nd.tree(documents, payload, [key], context=False, scalars=False))


def unreadable_documents(documents: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, problem) of the documents that are no JSON, or too deep."""
    return nd.shapes(nd.tree(documents, payload, [key], context=False)).where("problem IS NOT NULL").select(key, "problem")


def unidentified(records: DataFrame, key: str, payload: str, options: Sequence[Sequence[str]], fallback: Column) -> DataFrame:
    """(key, problem) of the records to which a contract's options give no id, or one that is too long."""
    return records.select(key, identity_problem(payload, options, fallback).alias("problem")).where("problem IS NOT NULL")
