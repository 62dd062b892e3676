"""Delimited files that each have a header of their own, read in splits: rows by name, cells, and the order of rows in their file.

A quoted cell may hold line breaks, so whether a line begins a record hangs on all lines before it. Each line maps the state it
finds (outside or inside a quoted cell) to the one it leaves; these maps are composed within a split, then over the splits of a
file (a row a split), and only then is it known where records begin. Lines meet what is known of their split by (path, start),
never by the file, so a file of any size is spread over its splits; only records of several lines are brought together.

Lines end in LF or CR LF; cells are parted by commas and quoted by double quotes, doubled within. An empty cell is an empty
text, a missing one null. Blank lines are no records. A file that ends inside a quoted cell is an error of the job that reads it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastra.operators.gates import GateError
from cadastra.sources.readers import dataset_name

#: The most names that the headers of one read may have together, as they become columns.
MOST_NAMES = 10_000

#: Possessive throughout, so that no long cell makes the matcher recurse or go back.
_BODY = r'[^"]*+(?:""[^"]*+)*+'
_CELL = rf'(?:"{_BODY}"[^,]*+|(?!")[^,]*+)'
_OPEN = rf'(?:{_CELL},)*+"{_BODY}\z'

_SPLIT = ["path", "start"]


def split_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, start, _at, line): a line with its split's first byte; _at orders the lines of a split and means nothing else."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))


def text_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, _ordinal, line): each line with its place in its file, from 0, the same on every run and for any size of splits."""
    lines = split_lines(spark, path)
    splits = lines.groupBy(*_SPLIT).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select(*_SPLIT, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"))
    return lines.join(bases, _SPLIT).select("path", (F.col("_at") + F.col("_base")).alias("_ordinal"), "line")


def _after(df: DataFrame, out: Sequence[str], after: Sequence[str], keys: Sequence[str], order: str) -> DataFrame:
    """Adds the state after each row, for groups that begin outside and inside: out composed from the group's first row on.

    A row either sets the state, or swaps it, or leaves it. Of what was set last, only the swaps since then matter.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    outside, inside = map(F.col, out)
    df = df.withColumn("_swaps", F.sum(F.when((outside == 1) & (inside == 0), 1).otherwise(0)).over(w))
    df = df.withColumn("_set", F.last(F.when(outside == inside, outside + F.col("_swaps")), ignorenulls=True).over(w))
    return df.withColumns({name: F.pmod(F.coalesce("_set", F.lit(e)) + F.col("_swaps"), F.lit(2)) for e, name in enumerate(after)}).drop("_swaps", "_set")


def _lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines with the states before and after them for both states of their split, and splits with the one that holds."""
    lines = split_lines(spark, path)
    quoted = F.contains("line", F.lit('"'))
    state = {"_out0": quoted & F.rlike("line", F.lit(f"^{_OPEN}")), "_out1": ~quoted | F.rlike("line", F.lit(rf'^{_BODY}(?:\z|"[^,]*+,{_OPEN})'))}
    lines = _after(lines.withColumns({n: c.cast("int") for n, c in state.items()}), list(state), ["_a0", "_a1"], _SPLIT, "_at")
    order = Window.partitionBy(*_SPLIT).orderBy("_at")
    blank = F.col("line").isin("", "\r")
    lines = lines.withColumns({f"_b{e}": F.lag(f"_a{e}", 1, e).over(order) for e in (0, 1)})
    lines = lines.withColumns({f"_c{e}": F.sum(((F.col(f"_b{e}") == 0) & ~blank).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) for e in (0, 1)})

    splits = lines.groupBy(*_SPLIT).agg(F.max_by(F.struct("_a0", "_a1", "_c0", "_c1"), "_at").alias("_s")).select(*_SPLIT, "_s.*")
    splits = _after(splits, ["_a0", "_a1"], ["_end", "_unused"], ["path"], "start")
    along = Window.partitionBy("path").orderBy("start")
    whole = Window.partitionBy("path")
    splits = splits.withColumn("_from", F.lag("_end", 1, 0).over(along))
    splits = splits.withColumn("_n", F.when(F.col("_from") == 0, F.col("_c0")).otherwise(F.col("_c1")))
    splits = splits.select(
        *_SPLIT, "_from",
        F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.when(F.max_by("_end", "start").over(whole) == 1, F.sum("_n").over(whole)).alias("_broken"),
    )

    return lines, splits


def _records(lines: DataFrame, splits: DataFrame, which: str) -> DataFrame:
    """Records (path, start, _ordinal, text and splits' _given, if any) of which; the header is the record 0 of its file.

    Lines lie by splits already, so records are put together where they are; only those that cross splits are shuffled.
    """
    chosen = lambda a: F.when(F.col("_from") == 0, F.col(f"{a}0")).otherwise(F.col(f"{a}1"))
    rows = lines.join(splits, _SPLIT).withColumns({"_before": chosen("_b"), "_then": chosen("_a"), "_ordinal": F.col("_base") + chosen("_c") - 1}).where(which)
    rows = rows.where((F.col("_before") == 1) | ~F.col("line").isin("", "\r"))
    unclosed = F.raise_error(F.concat(F.lit("a quoted cell is not closed in "), "path"))
    rows = rows.withColumn("line", F.when(F.col("_ordinal") + 1 == F.col("_broken"), unclosed.cast("string")).otherwise(F.col("line")))
    given = [F.first(c).alias(c) for c in splits.columns if c == "_given"]
    joined = lambda order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("line")
    pieces = rows.groupBy(*_SPLIT, "_ordinal").agg(joined("_at"), (F.min_by("_before", "_at") + F.max_by("_then", "_at")).alias("_open"), *given)
    columns = ["path", "start", "_ordinal", "line", *(c for c in splits.columns if c == "_given")]
    crossing = pieces.where("_open > 0").groupBy("path", "_ordinal").agg(joined("start"), F.min("start").alias("start"), *given)
    records = pieces.where("_open = 0").select(*columns).unionByName(crossing.select(*columns))
    return records.withColumn("text", F.regexp_replace("line", r"\r\z", "")).drop("line")


def cells(text: Column | str) -> Column:
    """The cells of a record, an array; what follows a closing quote belongs to its cell."""
    record = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_CELL})"), F.lit(1))
    body = lambda c, group: F.regexp_extract(c, rf'^"({_BODY})"([^,]*+)', group)
    return F.transform(found, lambda c: F.when(c.startswith('"'), F.concat(F.replace(body(c, 1), F.lit('""'), F.lit('"')), body(c, 2))).otherwise(c))


def read_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, _dataset, _ordinal, header, cells) of every row of CSV files; rows are numbered from 1 in each file."""
    lines, splits = _lines(spark, path)
    return _rows(lines, splits, F.col("header")).select("path", "_dataset", "_ordinal", F.col("_given").alias("header"), cells("text").alias("cells"))


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, header): the names in each file's first record, which for files without any is missing."""
    return _headers(*_lines(spark, path))


def read_by_name(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of CSV files by the names in their own headers: path, _dataset, _ordinal, then columns as text.

    A name that a file lacks is null in its rows, and so is a cell that a row lacks; of repeated names the last counts, and
    cells beyond the header are left out (gates find them). Without columns, all names of all headers are taken, in the order
    of the files and of their headers; more than MOST_NAMES are an error.
    """
    lines, splits = _lines(spark, path)
    if columns is None:
        found = _headers(lines, splits).select("path", F.posexplode("header").alias("_pos", "name")).groupBy("name").agg(F.min(F.struct("path", "_pos")).alias("_first"))
        columns = [r["name"] for r in found.orderBy("_first").limit(MOST_NAMES + 1).collect()]
        if len(columns) > MOST_NAMES:
            raise GateError(f"headers have more than {MOST_NAMES} names")
    place = lambda name: F.when(F.array_contains("header", name), F.size("header") - F.array_position(F.reverse("header"), name)).cast("int")
    places = F.array(*map(place, columns)) if columns else F.array().cast("array<int>")
    rows = _rows(lines, splits, places).withColumn("_cells", cells("text"))
    return rows.select("path", "_dataset", "_ordinal", *(F.get("_cells", F.get("_given", F.lit(i))).alias(c) for i, c in enumerate(columns)))


def _headers(lines: DataFrame, splits: DataFrame) -> DataFrame:
    return _records(lines, splits, "_ordinal = 0").select("path", cells("text").alias("header"))


def _rows(lines: DataFrame, splits: DataFrame, value: Column) -> DataFrame:
    """Rows with what their file's header gives: it goes to the file's splits first, so that a large file is no hot key."""
    given = splits.join(_headers(lines, splits).select("path", value.alias("_given")), "path")
    return _records(lines, given, "_ordinal > 0").withColumn("_dataset", dataset_name(F.col("path")))
