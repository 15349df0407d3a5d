"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from lakeloom.session import shared_folder

_PATHS: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted by ``remove_scratch`` or when the program ends."""
    if not _PATHS:
        atexit.register(remove_scratch)
    path = f"{shared_folder(spark)}/lakeloom/{name}-{uuid.uuid4().hex}"
    _PATHS.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage is cut, and a lost executor costs no recomputing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_scratch() -> None:
    """Delete what ``scratch_path`` has named in this program."""
    while _PATHS:
        spark, path = _PATHS.pop()
        with contextlib.suppress(Exception):  # the session may have ended; its folder is left then
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
