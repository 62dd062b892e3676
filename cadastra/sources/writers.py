"""Writers: JSON and CSV artifacts, manifests and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a line; nulls stay in the documents."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str], bom: bool = True) -> None:
    """Given columns in their order with a header; the first name is marked for spreadsheets."""
    first, *rest = columns
    head = F.col(first).alias(f"﻿{first}" if bom else first)
    df.select(head, *rest).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"', encoding="UTF-8")  # a published table of a row an area


def manifest(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) with files' digest: SHA-256 over the sorted entries, the same on every row."""
    return files.join(F.broadcast(release_digest(files)))


def release_digest(files: DataFrame) -> DataFrame:
    """One row: files, bytes and digest. A release has a few hundred files."""
    entry = F.concat_ws(" ", "path", F.col("bytes").cast("string"), "sha256")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("total_bytes"), F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "\n"), 256).alias("digest"))


def check_receipt(files: DataFrame, receipt: DataFrame) -> DataFrame:
    """(path, problem) where a release and its receipt differ."""
    joined = files.select("path", F.col("sha256").alias("_f")).join(receipt.select("path", F.col("sha256").alias("_r")), "path", "full")
    problem = F.when(F.col("_f").isNull(), "missing").when(F.col("_r").isNull(), "not in the receipt").when(F.col("_f") != F.col("_r"), "changed")
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def document(*columns: Column | str, sort: bool = True) -> Column:
    """Columns as one JSON document with sorted keys."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.to_json(F.parse_json(text)) if sort else text
