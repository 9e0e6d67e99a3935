"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from grove.storage import shared_folder

#: Words of the white-space contracts, as Java and Python regular expressions.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACE_WORD_RE = re.compile(SPACE_WORD)

#: Byte tables on UTF-8: A-Z to a-z; the same with every ASCII byte that is no letter or digit made a blank.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Writes df once as a Parquet table in the shared folder and returns the table, so that lost executors cost one task each."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo modulus; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def map_rows(
    docs: DataFrame,
    cols: Sequence[str],
    keep: Sequence[str],
    schema: str,
    setup: Callable[[], Callable[..., tuple]],
) -> DataFrame:
    """One output row per row: the columns in keep as they are, then what a row function makes of the columns in cols.

    setup runs once in each task and returns the row function. Columns in
    keep whose name the schema has too are replaced by the new ones. A task
    holds one Arrow batch at a time.
    """
    made = StructType.fromDDL(schema)
    keep = [c for c in keep if c not in made.names]
    source = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    out = StructType([*[docs.schema[c] for c in keep], *made])
    names, kept = out.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [f.type for f in to_arrow_schema(made)]
        row = setup()
        for b in batches:
            rows = [row(*v) for v in zip(*(b.column(i).to_pylist() for i in range(kept, b.num_columns)), strict=True)]
            new = [pa.array([r[j] for r in rows], type=t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(kept)), *new], names=names)

    return source.mapInArrow(run, out)


def numbered(rows: DataFrame, order: Sequence[Column], group: str, name: str) -> DataFrame:
    """rows with `number`, the place of each from 0 on among the rows of the same group (a column without nulls) in the given order.

    rows is a stored table. Ranges of (group, order) are sorted task by task,
    so one group may take many tasks; where it goes on from one range to the
    next, its rows in the ranges before are added. No range has more than one
    such group, so what is broadcast has fewer rows than there are ranges.
    """
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [F.col(group), *order, F.col("_row")]
    at = rows.columns.index(group)
    out = StructType(rows.schema.fields).add("number", "long").add("_range", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(at).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([True], own[1:] != own[:-1]))
            places = np.arange(len(own)) - np.maximum.accumulate(np.where(starts, np.arange(len(own)), 0))
            if last is not None and own[0] == last:
                run_end = int(np.argmin(own == own[0])) if (own != own[0]).any() else len(own)
                places[:run_end] += count
            last, count = own[-1], int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64()), pa.array(np.full(len(own), part, np.int32))], names=out.names)

    ranges = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, out), name)
    counts = ranges.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).where("_before > 0")
    found = ranges.join(F.broadcast(before.select(group, "_range", "_before")), [group, "_range"], "left")
    return found.withColumn("number", F.col("number") + F.coalesce("_before", F.lit(0))).drop("_row", "_range", "_before")
