"""Readers: delimited and JSON files as evidence rows, HTML pages, connector envelopes, release files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators.gates import GateError
from cadastra.operators import nodes as nd

SNAPSHOT_FILES = "{*.csv,*.json,*.jsonl,*.csv.gz,*.jsonl.gz}"
BOM = "﻿"


def dataset_name(path: Column) -> Column:
    """A file's name without its suffixes."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.csv|\.jsonl|\.json)?(\.gz)?$", "")


def list_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of a snapshot's data files at any depth, without its manifest, in the order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", SNAPSHOT_FILES).load(folder)
    return files.select("path", "length").where(~F.col("path").endswith("/manifest.json")).orderBy("path")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text, plain or gzip, a byte-order mark taken off the first name; adds _dataset."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    df = df.withColumnsRenamed({c: c.removeprefix(BOM) for c in df.columns})
    return df.withColumn("_dataset", dataset_name(F.col("_metadata.file_path")))


def read_json_lines(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """(dataset, payload) per line that holds an object. Blank lines are skipped.

    Other lines are dropped, or are an error if strict.
    """
    lines = spark.read.text(path).select(dataset_name(F.col("_metadata.file_path")).alias("dataset"), F.col("value").alias("payload")).where("trim(payload) <> ''")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False))
    if strict and lines.where(~is_object).limit(1).count():
        raise GateError("a line is no JSON object")
    return lines.where(is_object)


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(dataset, path, record) of the nearest object lists of whole JSON files."""
    files = spark.read.text(path, wholetext=True).select(dataset_name(F.col("_metadata.file_path")).alias("dataset"), "value")
    return nd.records(nd.tree(files, "value", ["dataset"], context=False))


def read_release(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file of a release; text files count with line feeds only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    text = F.lower("path").rlike(r"\.(json|csv|md|txt|geojson|ndjson|html|js|css)$")
    content = F.when(text, F.encode(F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n"), "UTF-8")).otherwise(F.col("content"))
    return files.select("path", F.length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def header_array(df: DataFrame, rows: str) -> DataFrame:
    """(source_row_number, label, value) of an array of rows whose first is the header."""
    return df.select(F.posexplode(rows).alias("source_row_number", "_r")).where("source_row_number > 0").select("source_row_number", F.try_element_at("_r", F.lit(1)).alias("label"), F.try_element_at("_r", F.lit(2)).alias("value"))


def links(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """(keep, pos, href, link_text) of the anchors of HTML, in their order; the text is cut to 200 characters."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']?[^\"'\s>]+[\"']?[^>]*>.*?</a>"), F.lit(0))
    rows = pages.select(*keep, F.posexplode(found).alias("pos", "_a"))
    href = F.regexp_extract("_a", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col("_a"), "(?s)<[^>]*>", " "), r"(?U)\s+", " "))
    return rows.select(*keep, "pos", href.alias("href"), F.substring(text, 1, 200).alias("link_text"))


def station_links(pages: DataFrame, pattern: str, html: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Links to stations, the first of each address; names of 80 characters or more are no names."""
    from cadastra.operators.ranking import first_seen

    own = links(pages, html, keep).where(F.col("href").rlike(pattern) & (F.length("link_text") < 80))
    return first_seen(own, "href", *keep, "pos")


def missing_pages(pages: DataFrame, number: str, last: str) -> DataFrame:
    """The page numbers from 1 to the advertised last one that were not fetched."""
    wanted = pages.agg(F.max(last).alias("n")).select(F.explode(F.sequence(F.lit(1), F.coalesce(F.col("n"), F.lit(1)).cast("int"))).alias(number))
    return wanted.join(pages.select(F.col(number).cast("int").alias(number)), number, "left_anti")


def envelope(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(fixture_version, source_id, dataset_key, payload) of connector envelopes; the payload is JSON text."""
    files = spark.read.text(path, wholetext=True)
    version, source = F.get_json_object("value", "$.fixture_version"), F.get_json_object("value", "$.source_id")
    records = F.from_json(F.get_json_object("value", "$.records"), "array<struct<dataset_key string, payload string>>")
    return files.select(version.alias("fixture_version"), source.alias("source_id"), F.explode(records).alias("r")).select("fixture_version", "source_id", "r.dataset_key", "r.payload")


def with_children(df: DataFrame, parent: Sequence[str], children: str) -> DataFrame:
    """Each child of an array of structs with its parent's columns beside it."""
    return df.select(*parent, F.explode(children).alias("_c")).select(*parent, "_c.*")


def rows_and_totals(payload: DataFrame, rows: str, totals: str) -> tuple[DataFrame, DataFrame]:
    """The rows of an array of structs, and published totals of a map: (label, total)."""
    return payload.select(F.explode(rows).alias("r")).select("r.*"), payload.select(F.explode(totals).alias("label", "total"))


def month_envelope(df: DataFrame, month: str) -> DataFrame:
    """Rows whose month is yyyy-MM; another is an error, as are several months at once."""
    bad = df.where(~F.coalesce(F.col(month).rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.lit(False)))
    if bad.limit(1).count() or df.select(month).distinct().limit(2).count() > 1:
        raise GateError("months differ or are no months")
    return df


def same_categories(left: DataFrame, right: DataFrame, category: str) -> DataFrame:
    """Categories that only one of two payloads has: none if they agree."""
    a, b = left.select(category).distinct().withColumn("_l", F.lit(1)), right.select(category).distinct().withColumn("_r", F.lit(1))
    return a.join(b, category, "full").where("_l IS NULL OR _r IS NULL").select(category)


def flat_readings(df: DataFrame, **fields: Sequence[str]) -> DataFrame:
    """Nested readings as flat columns: each takes the first of its fields that is neither null, empty, 0 nor false."""
    out = []
    for name, candidates in fields.items():
        values = [F.col(c).cast("string") for c in candidates]
        out.append(F.coalesce(*(F.when(~v.isin("", "0", "0.0", "false"), v) for v in values)).alias(name))
    return df.select(*out)


def projected(frames: Sequence[tuple[str, DataFrame]], columns: Sequence[str]) -> DataFrame:
    """Frames of several record types in one shape, with record_type."""
    from functools import reduce

    shaped = [df.select(F.lit(kind).alias("record_type"), *((F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns)) for kind, df in frames]
    return reduce(DataFrame.unionByName, shaped)


def newest_run(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """The run of the largest id, as ids begin with their time."""
    return runs.agg(F.max(run).alias(run))


def manifest_datasets(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_key, expected, folder) out of a run's manifest: datasets of {key, count, folder}."""
    text = spark.read.text(path, wholetext=True)
    rows = F.from_json(F.get_json_object("value", "$.datasets"), "array<struct<key string, count bigint, folder string>>")
    out = text.select(F.explode(rows).alias("d")).select(F.col("d.key").alias("dataset_key"), F.col("d.count").alias("expected"), "d.folder")
    if out.where(~F.startswith("dataset_key", "folder")).limit(1).count():
        raise GateError("a dataset key does not begin with its folder")
    return out


def table_or_files(table: DataFrame | None, files: DataFrame, key: str) -> DataFrame:
    """Rows of the table, and those of the files whose key the table lacks."""
    return files if table is None else table.unionByName(files.join(table.select(key), key, "left_anti"))
