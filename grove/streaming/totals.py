"""Running totals over objects and references that arrive as files.

An extension: batch results don't depend on it. The aggregations are the
batch ones, run by Structured Streaming with its own state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from grove.functions.counters import count32, sum64
from grove.operators.refgroups import Groups


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """The Parquet files of a folder as a stream; each file counts once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def object_totals(objects: DataFrame) -> DataFrame:
    """By type: number, total size, largest size of objects (type, size)."""
    return objects.groupBy("type").agg(count32().alias("n"), sum64(F.col("size")).alias("total"), F.max("size").alias("largest"))


def reference_totals(refs: DataFrame, groups: Groups) -> DataFrame:
    """By group symbol: number of references (refname)."""
    return groups.categorized(refs).select(F.explode("groups").alias("symbol")).groupBy("symbol").agg(count32().alias("n"))


#: Versions that stay: the one that readers may just have opened, and the newest.
KEPT = 2


def versions(spark: SparkSession, target: str) -> list[int]:
    """The numbers of the whole versions below target, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS")))


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest whole version of what kept_current keeps at target."""
    if not (found := versions(spark, target)):
        raise FileNotFoundError(f"no totals at {target!r} yet")
    return spark.read.parquet(f"{target}/{found[-1]}")


def kept_current(totals: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Works off what has arrived and leaves the totals below target; the checkpoint makes the next run go on from there.

    Each batch writes a version of its own, which counts once it is whole, so
    readers (see current) never find the totals missing or half written, and a
    batch that fails leaves those before it. The two newest versions stay.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{number}")
        spark = batch.sparkSession
        for old in versions(spark, target)[:-KEPT]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
