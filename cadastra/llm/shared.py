"""What the corpus operators share: reading tables, the shared folder, and joins that stand hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: Over how many parts spread_join() deals the rows of one key, before adaptive execution splits further.
SALTS = 8


#: Rows of long texts that go to a Python worker at once, where the session has Spark's default of 10,000.
BATCH_ROWS = 2000


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, as --py-files would; bounds their batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; any other session is refused, as its executors
    could not see one another's files.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    context = spark.sparkContext
    if (made := context._jsc.sc().getCheckpointDir()).isDefined():
        return made.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cadastra-"))
    return context._jsc.sc().getCheckpointDir().get()


#: The folders made so far that are still there.
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession, since: int = 0) -> None:
    """Deletes the folders that new_folder() has named; no frame that reads them can be used from then on."""
    while len(_made) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, the folders named within it: for work whose results are written elsewhere by then."""
    since = len(_made)
    try:
        yield
    finally:
        clear(spark, since)


def arrow_type(spark_type: str):
    """The Arrow type of a Spark type in DDL."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    return to_arrow_type(DataType.fromDDL(spark_type))


def held(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage: checkpoint() keeps it in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder. It forgets how df was partitioned, so a join deals both sides."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on keys where a key may hold a third of left's rows and right has few rows a key.

    left's rows of a key go to SALTS parts by the columns ``by``; right is copied to each. Both sides are then dealt
    anew by key and part, which also lets adaptive execution split a part that is still too large.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def held_out(doc_id: str | Column) -> Column:
    """Whether crc32 of the id as text, mod 5, is 0. A null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 5 == 0


def handing_back(function):
    """Wraps a function over Arrow batches so that its worker, which lives on, gives free memory back when a task ends."""

    @wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            hand_back()

    return run


def hand_back() -> None:
    """Gives this process's free memory back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def open_fs(uri: str):
    """(file system, path) by pyarrow; a bare path is local, and Spark's names for S3 are pyarrow's one."""
    from pyarrow import fs

    for scheme in ("s3a://", "s3n://"):
        if uri.startswith(scheme):
            uri = "s3://" + uri.removeprefix(scheme)
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put_file(uri: str, parts, attempt: int) -> int:
    """Writes parts to uri so that only a whole file ever has that name; a second attempt replaces the first."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    size = 0
    with system.open_output_stream(temporary := f"{path}.{attempt}.tmp", compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(temporary, path)
    return size
