"""Tables that operators write on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without one gets a temporary folder; any other is refused."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    context = spark.sparkContext
    if (known := context._jsc.sc().getCheckpointDir()).isDefined():
        return known.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cadastra-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: computed once, without lineage; in files of at most ``file_rows`` rows, if given."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
