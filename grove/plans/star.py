"""The tables of a sales schema seen as an object graph.

Parts are blobs; an order is a tree of its lines, a customer a tree of its
orders, and so on up to one root. Conversations are chains of commits, parts
also chains of tags, and documents have reference names.
"""

from __future__ import annotations

from collections.abc import Mapping
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.functions.parsing import entry_kind, octal
from grove.operators.treefold import SIZES, fold_level, leaf_sizes


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: What each value of the return flag stands for as a file mode: a file, a symbolic link, a submodule.
MODES = {"N": "100644", "R": "120000", "A": "160000"}


def mode_of(flag: Column) -> Column:
    mode = F.lit(None).cast("string")
    for value, text in MODES.items():
        mode = F.when(flag == value, text).otherwise(mode)
    return mode


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("oid"), F.col("p_size").cast("bigint").alias("size"))


def line_entries(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("l"), F.col("l_linenumber").cast("string"))
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("tree"), F.octet_length(name).cast("bigint").alias("name_length"), F.col("l_partkey").alias("child"), entry_kind(octal(mode_of(F.col("l_returnflag")))).alias("kind"))


#: Each level above the orders: table, its key, the table below, that one's key, the key above in it, and how an entry is named.
LEVELS = {
    "customer": ("customer", "c_custkey", "orders", "o_orderkey", "o_custkey", ("o", "o_orderkey")),
    "nation": ("nation", "n_nationkey", "customer", "c_custkey", "c_nationkey", ("c", "c_custkey")),
    "region": ("region", "r_regionkey", "nation", "n_nationkey", "n_regionkey", ("", "n_name")),
    "root": (None, None, "region", "r_regionkey", None, ("", "r_name")),
}


def level_trees(spark: SparkSession, folder: str, level: str) -> DataFrame:
    name, key, *_ = LEVELS[level]
    return table(spark, folder, name).select(F.col(key).cast("bigint").alias("oid")) if name else spark.range(1).select(F.col("id").alias("oid"))


def level_entries(spark: SparkSession, folder: str, level: str) -> DataFrame:
    _, _, below, key, above, (letter, name) = LEVELS[level]
    tree = F.col(above).cast("bigint") if above else F.lit(0).cast("bigint")
    return table(spark, folder, below).select(tree.alias("tree"), F.octet_length(F.concat(F.lit(letter), F.col(name).cast("string"))).cast("bigint").alias("name_length"), F.col(key).cast("bigint").alias("child"), F.lit("tree").alias("kind"))


def order_sizes(spark: SparkSession, folder: str) -> DataFrame:
    trees = table(spark, folder, "orders").select(F.col("o_orderkey").alias("oid"))
    return leaf_sizes(trees, line_entries(spark, folder), blobs(spark, folder))


def tree_sizes(spark: SparkSession, folder: str, level: str, known: Mapping[str, DataFrame] = MappingProxyType({})) -> DataFrame:
    """The folded sizes of all trees of a level, in straight-line joins as the number of levels is known; levels in `known` are taken from there."""
    if level in known:
        return known[level]
    if level == "order":
        return order_sizes(spark, folder)
    below = {"customer": "order", "nation": "customer", "region": "nation", "root": "region"}[level]
    return fold_level(level_trees(spark, folder, level), level_entries(spark, folder, level), tree_sizes(spark, folder, below, known))


def plain_sizes(sizes: DataFrame) -> DataFrame:
    return sizes.select("oid", *[F.col(c).cast("bigint").alias(c) for c in (*SIZES, "entries")])


def refs(spark: SparkSession, folder: str) -> DataFrame:
    """(ord, refname, size) of documents; the kind of name goes by the id."""
    docs = table(spark, folder, "documents")
    doc = F.col("doc_id").cast("string")
    rest = F.concat_ws("/", "source", "lang", doc)
    heads = ["heads", "tags", "remotes", "pull", "notes"]
    name = F.concat(F.lit("refs/odd/"), rest)
    for i, head in enumerate(heads):
        name = F.when(F.pmod("doc_id", F.lit(8)) == i, F.concat(F.lit(f"refs/{head}/"), rest)).otherwise(name)
    changes = F.concat(F.lit("refs/changes/"), F.lpad(F.pmod("doc_id", F.lit(100)).cast("string"), 2, "0"), F.lit("/"), doc, F.lit("/1"))
    name = F.when(F.pmod("doc_id", F.lit(8)) == 5, changes).when(F.pmod("doc_id", F.lit(8)) == 6, F.when(F.col("doc_id") == 6, "refs/stash").otherwise(F.concat(F.lit("refs/stash"), doc))).otherwise(name)
    return docs.select(F.col("doc_id").alias("ord"), name.alias("refname"), F.col("n_chars").alias("size"))


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(oid, ord, size, parent) of conversations: a turn is a commit on top of the one before it."""
    return table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("oid"), (-(F.col("conv_id") * 1000 + F.col("turn"))).alias("ord"), F.octet_length("text").cast("bigint").alias("size"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent")
    )


def order_history(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as commits (oid, ord) and their parents (oid, parent, nr): an order is on top of the same customer's order before it, and every third one also merges the order before it of the same day."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    before = lambda key: F.lag("o_orderkey").over(Window.partitionBy(key).orderBy("day", "o_orderkey"))
    own = orders.withColumns({"first": before("o_custkey"), "second": before("day")})
    second = F.when((F.col("o_orderkey") % 3 == 0) & ~F.col("second").eqNullSafe(F.col("first")), F.col("second"))
    listed = F.array_compact(F.array("first", second))
    commits = own.select(F.col("o_orderkey").alias("oid"), (F.unix_date("day").cast("bigint") * (1 << 40) + F.col("o_orderkey")).alias("ord"))
    parents = own.select(F.col("o_orderkey").alias("oid"), F.posexplode(listed).alias("nr", "parent")).select("oid", "parent", "nr")
    return commits, parents


def tags(spark: SparkSession, folder: str) -> DataFrame:
    """(oid, ord, referent, referent_type): an even part key is a tag of its half, an odd one the tag of a commit."""
    key = F.col("p_partkey")
    even = key % 2 == 0
    return table(spark, folder, "part").where(key > 0).select(key.alias("oid"), key.alias("ord"), F.when(even, (key / 2).cast("bigint")).otherwise(key).alias("referent"), F.when(even, "tag").otherwise("commit").alias("referent_type"))
