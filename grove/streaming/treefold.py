"""Tree sizes while objects arrive, in whatever order.

Every object has a state: what it adds up to so far, how many of its entries
are still out, and the trees that wait for it. Once all entries are in, the
object settles and tells those trees, by messages that the stream reads with
its next batch. Results equal the batch fold's.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from grove.functions.counters import CAP32, CAP64
from grove.operators.treefold import SIZES

SIZE_SCHEMA = "max_path_depth long, max_path_length long, trees long, blobs long, blob_bytes decimal(20,0), links long, submodules long"

#: What goes to an object: `tree` and `blob`, that it has arrived, with its number of entries or its size; `hold`, that a tree holds it; `part`, what one of its entries adds. What comes from it: such parts, and `settled`.
MESSAGE = f"oid string, kind string, holder string, name_length long, n long, {SIZE_SCHEMA}"

COLUMNS = [c.split()[0] for c in MESSAGE.split(", ")]

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def combined(one: tuple, other: tuple) -> tuple:
    """Sizes of two parts together, at their caps where they would be over; plain numbers, as the state takes no others."""
    sums = [int(a) + int(b) for a, b in zip(one[2:], other[2:], strict=True)]
    return (int(max(one[0], other[0])), int(max(one[1], other[1])), *(min(x, CAP64 if c == "blob_bytes" else CAP32) for c, x in zip(SIZES[2:], sums, strict=True)))


def part_of(sizes: tuple, is_tree: bool, name_length: int) -> tuple:
    """What a settled object adds to a tree that holds it by a name of this length."""
    depth, length, *sums = sizes
    if not is_tree:
        return (1, name_length, *sums)
    return (min(depth + 1, CAP32), min(name_length + 1 + length, CAP32) if length else name_length, *sums)


class FoldWhenComplete(StatefulProcessor):
    """Keeps an object's sums and pending entries, and settles it when all have arrived."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # n is the number of entries, null until the object itself has arrived; what it is stands in kind.
        self.sums = handle.getValueState("sums", f"kind string, n long, arrived long, settled boolean, {SIZE_SCHEMA}")
        self.holders = handle.getListState("holders", "holder string, name_length long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.sums.get() if self.sums.exists() else None
        kind, n, arrived, settled, *sizes = known if known else (None, None, 0, False, *[0] * len(SIZES))
        sizes, waiting, size_at = tuple(sizes), [], COLUMNS.index(SIZES[0])
        for pdf in rows:
            for row in pdf[COLUMNS].itertuples(index=False):
                match row.kind:
                    case "hold":
                        waiting.append((row.holder, int(row.name_length)))
                    case "part":
                        arrived += 1
                        sizes = combined(sizes, tuple(row[size_at:]))
                    case _ if kind is not None:
                        raise ValueError(f"object {key[0]} arrived twice")
                    case "tree":
                        kind, n, sizes = "tree", int(row.n), combined(sizes, (0, 0, 1, 0, 0, 0, 0))
                    case "blob":
                        kind, n, sizes = "blob", 0, (0, 0, 0, 1, int(row.blob_bytes), 0, 0)
        complete = kind is not None and arrived == n
        if complete and not settled and known:
            waiting += [(h, int(x)) for h, x in self.holders.get()]
            self.holders.clear()
        made = [(key[0], "settled", None, None, arrived, *sizes)] if complete and not settled and kind == "tree" else []
        if complete:
            made += [(holder, "part", None, None, None, *part_of(sizes, kind == "tree", length)) for holder, length in waiting]
        elif waiting:
            self.holders.appendList(waiting)
        self.sums.update((kind, n, arrived, complete, *sizes[:4], Decimal(sizes[4]), *sizes[5:]))
        for start in range(0, len(made), 10_000):
            found = pd.DataFrame(made[start : start + 10_000], columns=COLUMNS)
            yield found.astype({c: "Int64" for c in COLUMNS if c not in ("oid", "kind", "holder", "blob_bytes")}).assign(blob_bytes=[Decimal(int(x)) for x in found["blob_bytes"]])

    def close(self) -> None:
        pass


def message(df: DataFrame, **columns: object) -> DataFrame:
    """df's rows as messages; columns that aren't given are null."""
    types = dict(c.split() for c in MESSAGE.split(", "))
    return df.select(*[F.lit(columns.get(c)).cast(t).alias(c) if not hasattr(columns.get(c), "cast") else columns[c].cast(t).alias(c) for c, t in types.items()])


def arrivals(trees: DataFrame, entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Messages of streams of trees (oid, entries: how many it has), entries (tree, name_length, child, kind) and blobs (oid, size)."""
    col = F.col
    flat = {"max_path_depth": F.lit(1), "max_path_length": col("name_length"), "trees": 0, "blobs": 0, "blob_bytes": 0}
    flat |= {c + "s": F.when(col("kind") == c, 1).otherwise(0) for c in ("link", "submodule")}
    held = col("kind").isin("tree", "blob")
    return (
        message(trees, oid=col("oid"), kind="tree", n=col("entries"))
        .unionByName(message(blobs, oid=col("oid"), kind="blob", blob_bytes=col("size")))
        .unionByName(message(entries.where(held), oid=col("child"), kind="hold", holder=col("tree"), name_length=col("name_length")))
        .unionByName(message(entries.where(~held), oid=col("tree"), kind="part", **flat))
    )


def folding(messages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Works off the messages that are there, and leaves what settles in target/settled and messages for the next batches in target/parts.

    A batch that runs again writes the same folders again, so each message
    counts once. State is kept in RocksDB, which this setting is for.
    """
    spark = messages.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, kind in (("settled", "settled"), ("parts", "part")):
            batch.where(F.col("kind") == kind).write.mode("overwrite").parquet(f"{target}/{name}/{number}")
        batch.unpersist()

    try:
        made = messages.groupBy("oid").transformWithStateInPandas(FoldWhenComplete(), MESSAGE, "append", "none")
        return made.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    finally:
        spark.conf.set(STATE_STORE, before)


def written(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MESSAGE).option("recursiveFileLookup", True).parquet(folder)


def fold_arrived(spark: SparkSession, messages: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """(oid, SIZES, entries) of all trees that have settled once what has arrived is worked off; later calls go on from there.

    messages is a stream, see arrivals. One pass over the stream follows
    another until no object has anything to tell: one for each level of
    trees. A tree whose objects haven't all come yet isn't listed; one that
    arrives twice is an error, as is an entry more than it has.
    """
    for name in ("settled", "parts"):
        spark.createDataFrame([], MESSAGE).write.mode("append").parquet(f"{target}/{name}/none")
    parts = spark.readStream.schema(MESSAGE).option("recursiveFileLookup", True).parquet(f"{target}/parts")
    stream, told = messages.unionByName(parts), -1
    while (now := written(spark, f"{target}/parts").count()) != told:
        told = now
        folding(stream, target, checkpoint).awaitTermination()
    return written(spark, f"{target}/settled").select("oid", *SIZES, F.col("n").alias("entries"))
