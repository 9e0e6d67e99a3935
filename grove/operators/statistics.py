"""The one-row result: counters over all objects, maxima and their witnesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.functions.counters import WIDE, clamp32, clamp64, count32, first_max, last_max, sum64

#: Stands for every reference beside the groups' symbols; no symbol holds a line feed.
EVERY = "\n"

#: Counters of trees: column of the tree sizes, name of the maximum, name of its witness.
TREE_MAXIMA = (
    ("entries", "max_tree_entries", "max_tree_entries_tree"),
    ("max_path_depth", "max_path_depth", "max_path_depth_tree"),
    ("max_path_length", "max_path_length", "max_path_length_tree"),
    ("trees", "max_expanded_tree_count", "max_expanded_tree_count_tree"),
    ("blobs", "max_expanded_blob_count", "max_expanded_blob_count_tree"),
    ("blob_bytes", "max_expanded_blob_size", "max_expanded_blob_size_tree"),
    ("links", "max_expanded_link_count", "max_expanded_link_count_tree"),
    ("submodules", "max_expanded_submodule_count", "max_expanded_submodule_count_tree"),
)


def highest(x: Column, wide: bool = False) -> Column:
    return clamp64(F.coalesce(F.max(x), F.lit(0))) if wide else clamp32(F.coalesce(F.max(x), F.lit(0)))


def blob_statistics(blobs: DataFrame) -> DataFrame:
    """One row over blobs (oid, ord, size)."""
    size = F.col("size")
    return blobs.agg(count32().alias("unique_blob_count"), sum64(size, narrow=True).alias("unique_blob_size"), highest(size).alias("max_blob_size"), first_max(F.col("oid"), size, F.col("ord")).alias("max_blob_size_blob"))


def witness(metric: Column, order: tuple[str, ...]) -> Column:
    """The tree of the strict maximum that settled first."""
    return F.when(F.max(metric) > 0, F.max_by("oid", F.struct(metric, *[-F.col(c) for c in order])))


def tree_statistics(sizes: DataFrame, order: tuple[str, ...] = ("finished", "height", "ord")) -> DataFrame:
    """One row over folded trees (oid, object_size, entries, SIZES) in one aggregation."""
    made = [count32().alias("unique_tree_count"), sum64(F.col("object_size"), narrow=True).alias("unique_tree_size"), sum64(F.col("entries"), narrow=True).alias("unique_tree_entries")]
    for column, name, by in TREE_MAXIMA:
        made += [highest(F.col(column), column == "blob_bytes").alias(name), witness(F.col(column), order).alias(by)]
    return sizes.agg(*made)


def commit_statistics(commits: DataFrame) -> DataFrame:
    """One row over commits (oid, ord, size, n_parents, depth); the newest of equal ones is the witness."""
    oid, order = F.col("oid"), F.col("ord")
    return commits.agg(
        count32().alias("unique_commit_count"), sum64(F.col("size"), narrow=True).alias("unique_commit_size"), highest(F.col("size")).alias("max_commit_size"), last_max(oid, F.col("size"), order).alias("max_commit"),
        highest(F.col("depth")).alias("max_history_depth"), highest(F.col("n_parents")).alias("max_parent_count"), last_max(oid, F.col("n_parents"), order).alias("max_parent_count_commit"),
    )


def tag_statistics(tags: DataFrame) -> DataFrame:
    """One row over tags (oid, ord, depth, finished); their sizes don't count."""
    return tags.agg(count32().alias("unique_tag_count"), highest(F.col("depth")).alias("max_tag_depth"), F.when(F.max("depth") > 0, F.max_by("oid", F.struct("depth", -F.col("finished"), -F.col("depth"), -F.col("ord")))).alias("max_tag_depth_tag"))


def reference_statistics(categorized: DataFrame) -> DataFrame:
    """One row over categorised references: all of them count, walked or not, and once in each group."""
    counts = categorized.select(F.explode(F.concat("groups", F.array(F.lit(EVERY)))).alias("symbol")).groupBy("symbol").agg(count32().alias("n"))
    row = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "n")))).alias("n"))
    return row.select(F.coalesce(F.col("n")[EVERY], F.lit(0)).alias("reference_count"), F.map_filter("n", lambda k, v: k != EVERY).alias("reference_groups"))


def metric_rows(statistics: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(symbol, value) rows of a one-row table's columns, fields naming the column of each symbol."""
    return statistics.select(F.inline(F.array(*[F.struct(F.lit(s).alias("symbol"), F.col(c).cast(WIDE).alias("value")) for s, c in fields.items()])))


def dangling(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (oid) that aren't among the objects (oid)."""
    return wanted.select("oid").distinct().join(objects.select("oid"), "oid", "left_anti")


def repeated(objects: DataFrame) -> DataFrame:
    """(oid, n) of objects that are listed more than once."""
    return objects.groupBy("oid").agg(F.count("*").alias("n")).where("n > 1")
