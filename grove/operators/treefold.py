"""Sizes of trees, folded bottom-up over the graph of shared subtrees.

Each tree is folded once, however many parents share it, so paths are never
enumerated. A round joins the subtree entries to the trees settled in the
round before; every entry is joined once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.functions.counters import WIDE, add32, clamp32, clamp64, sum32, sum64
from grove.storage import stored

SIZES = ("max_path_depth", "max_path_length", "trees", "blobs", "blob_bytes", "links", "submodules")
SUMS = ("trees", "blobs", "links", "submodules")


def joined_length(name_length: Column, below: Column) -> Column:
    """The path length through an entry; nothing is added for a subtree without paths."""
    return clamp32(F.when(below > 0, name_length + 1 + below).otherwise(name_length))


def leaf_sizes(trees: DataFrame, entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """What each tree's blobs, links and submodules add up to; with its entries, and its number of subtrees as `due`.

    trees (oid, ...), entries (tree, name_length, child, kind), blobs (oid,
    size). A blob entry whose blob is unknown is an error; a tree without
    entries has sizes 0.
    """
    kind = F.col("kind")
    rows = entries.join(blobs.select(F.col("oid").alias("_blob"), "size"), (F.col("child") == F.col("_blob")) & (kind == "blob"), "left")
    known = F.coalesce(F.col("size"), F.raise_error(F.lit("tree entry of an unknown blob")).cast("bigint"))
    rows = rows.select("tree", "name_length", "kind", F.when(kind == "blob", known).otherwise(0).alias("size"))
    flat = kind != "tree"
    own = rows.groupBy("tree").agg(
        F.max(F.when(flat, 1).otherwise(0)).cast("bigint").alias("max_path_depth"),
        F.max(F.when(flat, F.col("name_length")).otherwise(0)).cast("bigint").alias("max_path_length"),
        sum32(F.when(kind == "blob", 1).otherwise(0)).alias("blobs"),
        sum64(F.col("size"), narrow=True).alias("blob_bytes"),
        sum32(F.when(kind == "link", 1).otherwise(0)).alias("links"),
        sum32(F.when(kind == "submodule", 1).otherwise(0)).alias("submodules"),
        F.count("*").alias("entries"),
        F.count(F.when(~flat, 1)).alias("due"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast(own.schema[c].dataType)).alias(c)
    return trees.join(own.withColumnRenamed("tree", "oid"), "oid", "left").select(*trees.columns, *[zero(c) for c in own.columns if c != "tree"], F.lit(1).cast("bigint").alias("trees"))


def subtree_parts(edges: DataFrame, settled: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """What settled subtrees add to the trees that hold them: edges (tree, name_length, child) joined by child, summed up by tree."""
    below = edges.join(settled.select(F.col("oid").alias("child"), *SIZES, *extra), "child")
    return below.groupBy("tree").agg(
        F.max(clamp32(F.col("max_path_depth") + 1)).alias("max_path_depth"),
        F.max(joined_length(F.col("name_length"), F.col("max_path_length"))).alias("max_path_length"),
        *[sum32(F.col(c)).alias(c) for c in SUMS],
        sum64(F.col("blob_bytes")).alias("blob_bytes"),
        F.count("*").alias("settled"),
        *[F.max(c).alias(c) for c in extra],
    )


def merged(parts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Parts of the same trees as one part each."""
    return parts.groupBy("tree").agg(
        *[F.max(c).alias(c) for c in ("max_path_depth", "max_path_length", *extra)], *[sum32(F.col(c)).alias(c) for c in SUMS], sum64(F.col("blob_bytes")).alias("blob_bytes"), F.sum("settled").alias("settled")
    )


def with_parts(own: DataFrame, parts: DataFrame, how: str = "inner") -> DataFrame:
    """Own sizes with the subtrees' parts added."""
    added = parts.select(F.col("tree").alias("oid"), *[F.col(c).alias(f"_{c}") for c in parts.columns if c != "tree"])
    rows = own.join(added, "oid", how)
    part = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0))
    new = {c: F.greatest(F.col(c), part(c)).cast("bigint") for c in ("max_path_depth", "max_path_length")}
    new |= {c: add32(F.col(c), part(c)) for c in SUMS}
    new["blob_bytes"] = clamp64(F.col("blob_bytes") + part("blob_bytes"))
    return rows.withColumns(new)


def fold_level(trees: DataFrame, edges: DataFrame, settled: DataFrame) -> DataFrame:
    """One level of trees (oid) that hold nothing but settled subtrees: their sizes, and entries."""
    zero = F.lit(0).cast("bigint")
    own = trees.select("oid", zero.alias("max_path_depth"), zero.alias("max_path_length"), F.lit(1).cast("bigint").alias("trees"), *[zero.alias(c) for c in ("blobs", "links", "submodules")], F.lit(0).cast(WIDE).alias("blob_bytes"))
    return with_parts(own, subtree_parts(edges, settled), "left").select("oid", *SIZES, F.coalesce("_settled", zero).alias("entries"))


def fold_trees(trees: DataFrame, entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """The sizes of all trees (oid, ord): SIZES, entries, and the key (finished, height, ord) of the order in which they settle.

    finished is the last place at which a tree or anything below it was read.
    Subtrees that are missing, or that hold themselves, leave trees unsettled
    and raise an error.
    """
    own = stored(leaf_sizes(trees.select("oid", "ord"), entries, blobs), "trees-own")
    edges = stored(entries.where(F.col("kind") == "tree").select("tree", "name_length", "child"), "trees-edges")
    order = ("finished", "height")
    settled = stored(own.where("due = 0").withColumn("finished", F.col("ord")).withColumn("height", F.lit(0)).select("oid", "ord", *SIZES, "entries", *order), "trees-settled")
    levels, waiting = [settled], None
    while True:
        parts = subtree_parts(edges, settled, order)
        waiting = stored(merged(parts if waiting is None else waiting.unionByName(parts), order), "trees-waiting")
        ready = with_parts(own.where("due > 0"), waiting).where("_settled = due")
        ready = ready.withColumn("finished", F.greatest("ord", "_finished")).withColumn("height", F.col("_height") + 1).select("oid", "ord", *SIZES, "entries", *order)
        settled = stored(ready, "trees-settled")
        if settled.limit(1).count() == 0:
            break
        levels.append(settled)
        waiting = waiting.join(settled.select(F.col("oid").alias("tree")), "tree", "left_anti")
    found = reduce(DataFrame.unionByName, levels)
    if found.count() != own.count():
        raise ValueError("trees are missing or hold themselves")
    return found
