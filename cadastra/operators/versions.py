"""Tables in versions: folders of rows that never change, and a manifest for each version that names its folders.

A version is there once its manifest has its number for a name, and that name can be given only once: of two writers that began
from one version, the second is refused, and update() has it begin again from what the first one made. Rows are written and gated
before; a writer that dies at any step leaves a folder or a temporary file that no manifest names, and the table as it was.
Older versions stay readable, as nothing is deleted. Names are given once on file systems whose rename refuses a name that is
taken (as that of Hadoop does) and on local ones; object stores without that need a single writer.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadastra.operators.sync import Gates, Measured, _hadoop, delete, staged

#: Where a name is given by a hard link, as renaming there replaces what had it.
LINKED = ("file",)


class Conflict(Exception):
    """Another writer has made the version."""


def _name(table: str, version: int) -> str:
    return f"{table.rstrip('/')}/_versions/{version:020d}"


def latest(spark: SparkSession, table: str) -> int:
    """The number of the newest version, 0 where there is none."""
    _, files, hadoop = _hadoop(spark, table)
    folder = hadoop(f"{table.rstrip('/')}/_versions")
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return max((int(n) for n in names if n.isdecimal()), default=0)


def folders(spark: SparkSession, table: str, version: int) -> list[str]:
    """The folders of a version; version 0 has none."""
    if version == 0:
        return []
    jvm, files, hadoop = _hadoop(spark, table)
    stream = files.open(hadoop(_name(table, version)))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read(spark: SparkSession, table: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    """The rows of a version, of the newest unless said; none of a table without versions."""
    found = folders(spark, table, latest(spark, table) if version is None else version)
    return spark.read.schema(schema).parquet(*(f"{table.rstrip('/')}/{f}" for f in found)) if found else spark.createDataFrame([], schema)


def commit(spark: SparkSession, table: str, version: int, made_of: list[str]) -> None:
    """Makes a version of folders of the table, or raises Conflict where there is one of that number."""
    jvm, files, hadoop = _hadoop(spark, table)
    made, target = hadoop(f"{table.rstrip('/')}/_versions/.{uuid.uuid4().hex}"), hadoop(_name(table, version))
    out = files.create(made, False)
    out.write(bytearray(json.dumps(made_of).encode()))
    out.close()
    try:
        if files.getUri().getScheme() in LINKED:
            os.link(made.toUri().getPath(), target.toUri().getPath())
        else:
            refusing = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(made, target, refusing)
    except FileExistsError as e:
        raise Conflict(f"version {version} of {table}") from e
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"version {version} of {table}") from e
        raise
    finally:
        files.delete(made, False)


def update(spark: SparkSession, table: str, schema: StructType | str, change: Callable[[DataFrame], DataFrame], keep: bool = False, gates: Gates | None = None, attempts: int = 5) -> tuple[int, int]:
    """Writes change(rows of the newest version) as the next version and returns (version, rows written).

    With keep, these rows are added to those of the version before, and no row makes no version; without, they take their place. Gates
    see the rows as written. After a Conflict, change is asked again, of the version that the other writer made; the last attempt's is raised.
    """
    for attempt in range(1, attempts + 1):
        base = latest(spark, table)
        seen = Measured(rows=F.count(F.lit(1)))
        made = staged(change(read(spark, table, schema, base)), f"{table.rstrip('/')}/rows", gates, seen)
        if keep and not seen.values["rows"]:
            delete(spark, made)
            return base, 0
        try:
            commit(spark, table, base + 1, [*(folders(spark, table, base) if keep else []), made.rpartition("/")[2]])
        except Conflict:
            delete(spark, made)
            if attempt == attempts:
                raise
        else:
            return base + 1, seen.values["rows"]
    raise ValueError("at least one attempt is needed")
