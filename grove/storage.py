"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders by application, for sessions that name none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, or a temporary folder where that is unset and all tasks run on this machine, as in tests."""
    found, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if found:
        return f"{found.rstrip('/')}/grove-{app}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.get(app) or _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='grove-')}")


def remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def remove_intermediates(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that haven't been written yet can't be read afterwards."""
    remove(spark, shared_folder(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet and returns the table; this cuts the lineage of loops and survives lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
