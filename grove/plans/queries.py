"""Queries over the sales tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.functions.counters import CAP32, CAP64, clamp32, clamp64, count32, first_max, formatted, last_max, level, overflowed, stars, sum32, sum64
from grove.functions.parsing import batch_header, entry_kind, octal, oid_text, parsed_commits, parsed_tags, parsed_trees, reference_line
from grove.functions.references import config_rest, folded, pattern, prefix
from grove.operators.history import reachable_commits
from grove.operators.refgroups import Groups, group_counts, shown
from grove.operators.revisions import resolved
from grove.operators.statistics import TREE_MAXIMA, blob_statistics, commit_statistics, dangling, metric_rows, reference_statistics, repeated, tag_statistics, tree_statistics
from grove.operators.traversal import commit_depths, reachable, tag_depths
from grove.operators.treefold import SIZES, fold_trees
from grove.operators.witness import find_links, named_objects, path
from grove.plans.report import CATALOGUE, Report, catalogue
from grove.plans.star import blobs, commits, line_entries, mode_of, order_history, order_sizes, plain_sizes, refs, table, tags, tree_sizes
from grove.storage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Trees

ORDERS_SQL = """
orders_t AS (
  SELECT o_orderkey AS oid, CASE WHEN count(l_orderkey) > 0 THEN 1 ELSE 0 END AS max_path_depth, coalesce(max(strlen('l' || l_linenumber)), 0) AS max_path_length, 1 AS trees,
         count(l_orderkey) FILTER (WHERE l_returnflag = 'N') AS blobs, coalesce(sum(p_size) FILTER (WHERE l_returnflag = 'N'), 0) AS blob_bytes,
         count(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS links, count(l_orderkey) FILTER (WHERE l_returnflag = 'A') AS submodules, count(l_orderkey) AS entries
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey
)"""


def level_sql(name: str, parents: str, key: str, edges: str, above: str, child: str, called: str, below: str) -> str:
    return f"""{name} AS (
  SELECT p.oid, coalesce(max(c.max_path_depth + 1), 0) AS max_path_depth,
         coalesce(max(CASE WHEN c.max_path_length > 0 THEN strlen({called}) + 1 + c.max_path_length ELSE strlen({called}) END), 0) AS max_path_length,
         1 + coalesce(sum(c.trees), 0) AS trees, coalesce(sum(c.blobs), 0) AS blobs, coalesce(sum(c.blob_bytes), 0) AS blob_bytes,
         coalesce(sum(c.links), 0) AS links, coalesce(sum(c.submodules), 0) AS submodules, count(c.oid) AS entries
  FROM (SELECT {key} AS oid FROM {parents}) p LEFT JOIN {edges} e ON {above} = p.oid LEFT JOIN {below} c ON c.oid = {child} GROUP BY p.oid
)"""


LEVEL_SQL = {
    "order": ORDERS_SQL,
    "customer": level_sql("customer_t", "customer", "c_custkey", "orders", "o_custkey", "o_orderkey", "'o' || o_orderkey", "orders_t"),
    "nation": level_sql("nation_t", "nation", "n_nationkey", "customer", "c_nationkey", "c_custkey", "'c' || c_custkey", "customer_t"),
    "region": level_sql("region_t", "region", "r_regionkey", "nation", "n_regionkey", "n_nationkey", "n_name", "nation_t"),
    "root": level_sql("root_t", "(SELECT 0 AS zero)", "zero", "region", "0", "r_regionkey", "r_name", "region_t"),
}
ORDER_OF_LEVELS = list(LEVEL_SQL)
SIZE_COLUMNS = (*SIZES, "entries")


def with_levels(last: str, select: str) -> str:
    return "WITH " + ",\n".join(LEVEL_SQL[x] for x in ORDER_OF_LEVELS[: ORDER_OF_LEVELS.index(last) + 1]) + "\n" + select


def plain_sql(name: str) -> str:
    return f"SELECT CAST(oid AS BIGINT) AS oid, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in SIZE_COLUMNS)} FROM {name}"


def size_query(name: str) -> None:
    def f(spark: SparkSession, folder: str) -> DataFrame:
        return plain_sizes(tree_sizes(spark, folder, name))

    f.__name__ = f"{name}_tree_size"
    query(with_levels(name, plain_sql("orders_t" if name == "order" else f"{name}_t")))(f)


for _name in ORDER_OF_LEVELS:
    size_query(_name)


@query(with_levels("customer", f"SELECT CAST(oid AS BIGINT) AS oid, tree_kind, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in SIZE_COLUMNS)} FROM (SELECT oid, 'order' AS tree_kind, {', '.join(SIZE_COLUMNS)} FROM orders_t UNION ALL SELECT oid, 'customer', {', '.join(SIZE_COLUMNS)} FROM customer_t)"))
def general_tree_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and customers as one graph of unknown height, folded round by round."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    far = F.lit(1 << 40)
    lines = line_entries(spark, folder).select("tree", "name_length", "child", "kind")
    held = orders.select((F.col("o_custkey") + far).alias("tree"), F.octet_length(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).cast("bigint").alias("name_length"), F.col("o_orderkey").alias("child"), F.lit("tree").alias("kind"))
    trees = orders.select(F.col("o_orderkey").alias("oid")).union(customer.select(F.col("c_custkey") + far)).withColumn("ord", -F.col("oid"))
    found = fold_trees(trees, lines.unionByName(held), blobs(spark, folder))
    kind = F.when(F.col("oid") >= far, "customer").otherwise("order")
    return found.select(F.when(F.col("oid") >= far, F.col("oid") - far).otherwise(F.col("oid")).alias("oid"), kind.alias("tree_kind"), *[F.col(c).cast("bigint").alias(c) for c in SIZE_COLUMNS])


@query("""SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE l_returnflag WHEN 'N' THEN 'blob' WHEN 'R' THEN 'link' ELSE 'submodule' END AS kind FROM lineitem UNION ALL SELECT 'tree' FROM orders) GROUP BY kind""")
def entry_kind_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Modes as octal text, classified by their type bits."""
    modes = table(spark, folder, "lineitem").select(mode_of(F.col("l_returnflag")).alias("mode")).union(table(spark, folder, "orders").select(F.lit("40000")))
    return modes.groupBy(entry_kind(octal(F.col("mode"))).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS total, CAST(max(p_size) AS BIGINT) AS largest, (SELECT min(p_partkey) FROM part WHERE p_size = (SELECT max(p_size) FROM part)) AS witness FROM part""")
def unique_blob_stats(spark: SparkSession, folder: str) -> DataFrame:
    found = blob_statistics(blobs(spark, folder).withColumn("ord", F.col("oid")))
    return found.select(F.col("unique_blob_count").alias("n"), F.col("unique_blob_size").cast("bigint").alias("total"), F.col("max_blob_size").alias("largest"), F.col("max_blob_size_blob").alias("witness"))


@query(with_levels("order", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(entries) AS BIGINT) AS entries, CAST(max(entries) AS BIGINT) AS most, CAST(arg_min(oid, -entries * 1000000000000 + oid) AS BIGINT) AS witness FROM orders_t"))
def unique_tree_stats(spark: SparkSession, folder: str) -> DataFrame:
    sizes = order_sizes(spark, folder).withColumn("object_size", F.col("entries") * 30).withColumns({"finished": F.col("oid"), "height": F.lit(0), "ord": F.col("oid")})
    return tree_statistics(sizes).select(F.col("unique_tree_count").alias("n"), F.col("unique_tree_entries").cast("bigint").alias("entries"), F.col("max_tree_entries").alias("most"), F.col("max_tree_entries_tree").alias("witness"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS witness, n FROM (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey ORDER BY n DESC, l_orderkey LIMIT 1)")
def tree_max_entries(spark: SparkSession, folder: str) -> DataFrame:
    """A strict maximum keeps the first of equals."""
    n = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("oid")).agg(F.count("*").alias("n"))
    return n.agg(first_max(F.col("oid"), F.col("n"), F.col("oid")).alias("witness"), F.max("n").alias("n"))


@query(
    with_levels(
        "customer",
        "\nUNION ALL ".join(f"SELECT '{name}' AS metric, CAST(max({c}) AS BIGINT) AS value, CASE WHEN max({c}) > 0 THEN CAST((SELECT min(oid) FROM customer_t WHERE {c} = (SELECT max({c}) FROM customer_t)) AS BIGINT) END AS witness FROM customer_t" for c, name, _ in TREE_MAXIMA),
    )
)
def max_checkout_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All maxima and witnesses in one aggregation, as rows."""
    sizes = tree_sizes(spark, folder, "customer").withColumns({"object_size": F.lit(0), "finished": F.col("oid"), "height": F.lit(0), "ord": F.col("oid")})
    row = tree_statistics(sizes)
    made = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).cast("bigint").alias("value"), F.col(by).alias("witness")) for _, name, by in TREE_MAXIMA])
    return row.select(F.inline(made))


@query(
    with_levels(
        "nation",
        "SELECT n_name, CAST(t.blobs AS BIGINT) AS expanded, CAST(coalesce(u.n, 0) AS BIGINT) AS distinct_blobs FROM nation_t t JOIN nation ON n_nationkey = oid LEFT JOIN (SELECT c_nationkey, count(DISTINCT l_partkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' GROUP BY c_nationkey) u ON c_nationkey = oid",
    )
)
def expanded_vs_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a checkout counted with repeats, and as distinct blobs."""
    lines = line_entries(spark, folder).where("kind = 'blob'")
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    unique = lines.join(orders.select(F.col("o_orderkey").alias("tree"), "o_custkey"), "tree").join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    unique = unique.select(F.col("c_nationkey").cast("bigint").alias("oid"), "child").distinct().groupBy("oid").agg(F.count("*").alias("distinct_blobs"))
    names = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("oid"), "n_name")
    return tree_sizes(spark, folder, "nation").join(names, "oid").join(unique, "oid", "left").select("n_name", F.col("blobs").alias("expanded"), F.coalesce("distinct_blobs", F.lit(0)).cast("bigint").alias("distinct_blobs"))


@query(with_levels("nation", plain_sql("nation_t") + " WHERE oid IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"))
def partial_root_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics from explicit tree roots: the nations of one region."""
    roots = table(spark, folder, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").cast("bigint").alias("oid"))
    return plain_sizes(tree_sizes(spark, folder, "nation")).join(roots, "oid", "left_semi")


# Counters and formatting


@query("SELECT l_returnflag, CAST(least(sum(CAST(l_quantity AS BIGINT) * l_orderkey), 4294967295) AS BIGINT) AS total, sum(CAST(l_quantity AS BIGINT) * l_orderkey) >= 4294967295 AS overflow FROM lineitem GROUP BY l_returnflag")
def saturating_sum32(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("l_quantity").cast("bigint") * F.col("l_orderkey")
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(sum32(x).alias("total")).withColumn("overflow", overflowed(F.col("total"), CAP32))


@query("SELECT o_orderpriority, CAST(least(sum(CAST(o_orderkey AS DECIMAL(38,0)) * 500000000000), 18446744073709551615) AS VARCHAR) AS total, sum(CAST(o_orderkey AS DECIMAL(38,0)) * 500000000000) >= 18446744073709551615 AS overflow FROM orders GROUP BY o_orderpriority")
def saturating_sum64(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("o_orderkey").cast("decimal(20,0)") * F.lit(Decimal(500000000000))
    return table(spark, folder, "orders").groupBy("o_orderpriority").agg(sum64(x).alias("total")).select("o_orderpriority", F.col("total").cast("string").alias("total"), overflowed(F.col("total"), CAP64).alias("overflow"))


@query("SELECT p_partkey, CAST(least(CAST(p_size AS BIGINT) * 100000000 + p_partkey, 4294967295) AS BIGINT) AS narrow, CAST(least(CAST(p_size AS DECIMAL(38,0)) * 400000000000000000, 18446744073709551615) AS VARCHAR) AS wide FROM part")
def saturating_add(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, folder, "part").select("p_partkey", clamp32(size.cast("bigint") * 100000000 + F.col("p_partkey")).alias("narrow"), clamp64(size.cast("decimal(20,0)") * F.lit(Decimal(400000000000000000))).cast("string").alias("wide"))


def human_sql(key: str, x: str, source: str, step: int, prefixes: tuple[str, ...], unit: str) -> str:
    cases = "".join(f"WHEN n >= {step**i} THEN " + f"CASE WHEN n // {step**i} >= 100 THEN format('{{:.0f}}', n / {step**i}) WHEN n // {step**i} >= 10 THEN format('{{:.1f}}', n / {step**i}) ELSE format('{{:.2f}}', n / {step**i}) END || ' {p}{unit}' " for i, p in reversed(list(enumerate(prefixes))) if i)
    return f"SELECT {key}, CASE {cases} ELSE rtrim(n || ' {unit}') END AS shown FROM (SELECT {key}, CAST({x} AS BIGINT) AS n FROM {source})"


@query(human_sql("o_orderkey", "floor(o_totalprice) * o_orderkey", "orders", 1000, ("", "k", "M", "G", "T", "P"), ""))
def human_metric(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", formatted(F.floor("o_totalprice") * F.col("o_orderkey"), "metric").alias("shown"))


@query(human_sql("doc_id", "n_chars * doc_id", "documents", 1024, ("", "Ki", "Mi", "Gi", "Ti", "Pi"), "B"))
def human_binary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", formatted(F.col("n_chars") * F.col("doc_id"), "binary", "B").alias("shown"))


# History and tags

CHAIN_SQL = "WITH RECURSIVE c AS (SELECT conv_id * 1000 + turn AS oid, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, CAST(strlen(text) AS BIGINT) AS size FROM conversations), d AS (SELECT oid, CAST(1 AS BIGINT) AS depth FROM c WHERE parent IS NULL UNION ALL SELECT c.oid, d.depth + 1 FROM c JOIN d ON c.parent = d.oid)"


@query(f"{CHAIN_SQL} SELECT oid, depth FROM d")
def commit_depth(spark: SparkSession, folder: str) -> DataFrame:
    found = commits(spark, folder)
    return commit_depths(found.select("oid", "ord"), found.where("parent is not null").select("oid", "parent")).select("oid", "depth")


@query(f"{CHAIN_SQL} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS total, max(size) AS largest, max(CASE WHEN size = (SELECT max(size) FROM c) THEN c.oid END) AS largest_witness, max(depth) AS depth, CAST(1 AS BIGINT) AS parents, max(CASE WHEN parent IS NOT NULL THEN c.oid END) AS parents_witness FROM c JOIN d ON c.oid = d.oid")
def commit_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Lax maxima: of equals, the newest is the witness."""
    found = commits(spark, folder)
    depths = commit_depths(found.select("oid", "ord"), found.where("parent is not null").select("oid", "parent"))
    row = commit_statistics(found.withColumn("n_parents", F.when(F.col("parent").isNull(), 0).otherwise(1)).join(depths, "oid"))
    return row.select(F.col("unique_commit_count").alias("n"), F.col("unique_commit_size").cast("bigint").alias("total"), F.col("max_commit_size").alias("largest"), F.col("max_commit").alias("largest_witness"), F.col("max_history_depth").alias("depth"), F.col("max_parent_count").alias("parents"), F.col("max_parent_count_commit").alias("parents_witness"))


@query("SELECT o_orderstatus, CAST(max(n) AS BIGINT) AS parents, CAST(arg_max(o_orderkey, n * 1000000000000 - o_orderkey) AS BIGINT) AS witness FROM (SELECT o_orderstatus, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus, o_orderkey) GROUP BY o_orderstatus")
def max_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as commits whose parents are their lines."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, folder, "orders").join(lines, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy("o_orderstatus").agg(F.max("n").cast("bigint").alias("parents"), last_max(F.col("o_orderkey"), F.col("n"), F.col("o_orderkey")).alias("witness"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS depth, max(event_id) FILTER (WHERE rn = n) AS tip FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY user_id")
def event_history_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Linear histories need no recursion: depth is the place in the order."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, folder, "events").withColumn("depth", place.cast("bigint")).groupBy("user_id").agg(F.max("depth").alias("depth"), F.max_by("event_id", "depth").alias("tip"))


MERGES_SQL = """WITH RECURSIVE o AS (SELECT o_orderkey AS oid, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS first,
    CASE WHEN o_orderkey % 3 = 0 THEN lag(o_orderkey) OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) END AS second FROM orders),
  p AS (SELECT oid, first AS parent FROM o WHERE first IS NOT NULL UNION SELECT oid, second FROM o WHERE second IS NOT NULL)"""


@query(f"{MERGES_SQL}, d AS (SELECT oid, CAST(1 AS BIGINT) AS depth FROM o WHERE first IS NULL AND second IS NULL UNION SELECT p.oid, depth + 1 FROM d JOIN p ON p.parent = d.oid) SELECT oid, max(depth) AS depth FROM d GROUP BY oid")
def merge_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Depths of a history with merges, all blocks at once."""
    found, parents = order_history(spark, folder)
    return commit_depths(found, parents.select("oid", "parent"), block=4096)


@query(f"{MERGES_SQL}, r AS (SELECT oid FROM o WHERE oid % 1000 = 7 UNION SELECT p.parent FROM r JOIN p ON p.oid = r.oid) SELECT oid FROM r")
def reachable_history(spark: SparkSession, folder: str) -> DataFrame:
    """All that every thousandth order is built on, in the order of the history."""
    found, parents = order_history(spark, folder)
    return reachable_commits(found.where("oid % 1000 = 7"), found, parents)


TAG_SQL = "WITH RECURSIVE d AS (SELECT p_partkey AS oid, CAST(1 AS BIGINT) AS depth FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p.p_partkey, d.depth + 1 FROM part p JOIN d ON p.p_partkey = 2 * d.oid)"


@query(f"{TAG_SQL} SELECT oid, depth FROM d")
def tag_depth(spark: SparkSession, folder: str) -> DataFrame:
    return tag_depths(tags(spark, folder)).select("oid", "depth")


@query(f"{TAG_SQL} SELECT CAST(count(*) AS BIGINT) AS n, max(depth) AS depth, min(CASE WHEN depth = (SELECT max(depth) FROM d) THEN oid END) AS witness FROM d")
def tag_stats(spark: SparkSession, folder: str) -> DataFrame:
    row = tag_statistics(tag_depths(tags(spark, folder)))
    return row.select(F.col("unique_tag_count").alias("n"), F.col("max_tag_depth").alias("depth"), F.col("max_tag_depth_tag").alias("witness"))


# References

REFS_SQL = """refs AS (SELECT doc_id AS ord, n_chars AS size, CASE doc_id % 8 WHEN 0 THEN 'refs/heads/' || rest WHEN 1 THEN 'refs/tags/' || rest WHEN 2 THEN 'refs/remotes/' || rest WHEN 3 THEN 'refs/pull/' || rest WHEN 4 THEN 'refs/notes/' || rest
  WHEN 5 THEN 'refs/changes/' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '/' || doc_id || '/1' WHEN 6 THEN CASE WHEN doc_id = 6 THEN 'refs/stash' ELSE 'refs/stash' || doc_id END ELSE 'refs/odd/' || rest END AS refname
  FROM (SELECT *, source || '/' || lang || '/' || doc_id AS rest FROM documents))"""


def on_refs(condition: str) -> str:
    return f"WITH {REFS_SQL} SELECT refname, {condition} AS included FROM refs"


def selected(spark: SparkSession, folder: str, *rules: tuple[str, str]) -> DataFrame:
    groups = Groups().finish(list(rules))
    return refs(spark, folder).select("refname", groups.top.own(F.col("refname")).alias("included"))


@query(on_refs("refname = 'refs/heads/src8' OR starts_with(refname, 'refs/heads/src8/')"))
def ref_prefix_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A prefix ends at a boundary: src8 isn't src80."""
    return refs(spark, folder).select("refname", prefix("refs/heads/src8")(F.col("refname")).alias("included"))


@query(on_refs(r"regexp_matches(refname, '^refs/changes/\d{2}/\d+/\d+$')"))
def ref_regexp_filter(spark: SparkSession, folder: str) -> DataFrame:
    return refs(spark, folder).select("refname", pattern(r"refs/changes/\d{2}/\d+/\d+")(F.col("refname")).alias("included"))


@query(on_refs("((starts_with(refname, 'refs/heads/') AND NOT regexp_matches(refname, '^refs/heads/.*/fr/.*$')) OR starts_with(refname, 'refs/remotes/')) AND NOT starts_with(refname, 'refs/remotes/src1/')"))
def ref_include_exclude(spark: SparkSession, folder: str) -> DataFrame:
    return selected(spark, folder, ("include", "refs/heads"), ("exclude", "/refs/heads/.*/fr/.*/"), ("include", "refs/remotes"), ("exclude", "refs/remotes/src1"))


@query(on_refs("NOT starts_with(refname, 'refs/tags/') OR starts_with(refname, 'refs/tags/src1/')"))
def ref_last_rule_wins(spark: SparkSession, folder: str) -> DataFrame:
    """A first exclusion starts from everything; a later rule takes some back."""
    return selected(spark, folder, ("no-tags", "true"), ("include", "refs/tags/src1"))


@query(on_refs("(starts_with(refname, 'refs/heads/') OR refname = 'refs/stash') AND NOT starts_with(refname, 'refs/heads/src2/')"))
def ref_flags(spark: SparkSession, folder: str) -> DataFrame:
    return selected(spark, folder, ("branches", "true"), ("stash", "true"), ("exclude", "refs/heads/src2/"))


@query(on_refs("starts_with(refname, 'refs/pull/') OR regexp_matches(refname, '^refs/tags/.*/en/.*$')"))
def ref_group_filter(spark: SparkSession, folder: str) -> DataFrame:
    groups = Groups([("tags.english.includeRegexp", ".*/en/.*")])
    rule = folded([("include", "@pulls"), ("refgroup", "tags.english")], groups.filter_of)
    return refs(spark, folder).select("refname", rule(F.col("refname")).alias("included"))


#: Patterns in RE2's syntax, which DuckDB reads as it is.
DIALECT = (
    r"refs/(?P<kind>[[:alpha:]]+)/src\d+/[a-z]{2}/[^/]+", r"refs/[a-z&&t]+/.*[02468]", r"refs/\pL+/\p{Latin}+[[:^alpha:]]/.*", r"\Qrefs/heads/\E.*|refs/(?i:TAGS)/.*", r"refs/[]p[u-]+ll?/.*\b(?:1|3)\d*", r"refs/notes{1}/.{1,12}|.*{x}",
)


@query(f"WITH {REFS_SQL} SELECT refname, " + ", ".join(f"regexp_matches(refname, '^{p}$') AS p{i}" for i, p in enumerate(DIALECT)) + " FROM refs")
def ref_regexp_dialect(spark: SparkSession, folder: str) -> DataFrame:
    """Named groups, classes by name, brackets and ampersands within classes, properties, quoted text, flags, borders, and braces that count nothing."""
    return refs(spark, folder).select("refname", *[pattern(p)(F.col("refname")).alias(f"p{i}") for i, p in enumerate(DIALECT)])


GROUP_SQL = """CASE WHEN starts_with(refname, 'refs/heads/') THEN 'branches' WHEN starts_with(refname, 'refs/tags/') THEN 'tags' WHEN starts_with(refname, 'refs/remotes/') THEN 'remotes' WHEN starts_with(refname, 'refs/pull/') THEN 'pulls'
  WHEN regexp_matches(refname, '^refs/changes/\\d{2}/\\d+/\\d+$') THEN 'changes' WHEN starts_with(refname, 'refs/notes/') THEN 'notes' WHEN refname = 'refs/stash' THEN 'stash' ELSE 'other' END"""


@query(f"WITH {REFS_SQL} SELECT symbol, CAST(count(*) AS BIGINT) AS n FROM (SELECT {GROUP_SQL} AS symbol FROM refs UNION ALL SELECT '' FROM refs) GROUP BY symbol")
def ref_group_count(spark: SparkSession, folder: str) -> DataFrame:
    return group_counts(Groups().finish().categorized(refs(spark, folder)))


NESTED = [("tags.releases.name", "Releases"), ("tags.releases.includeRegexp", "refs/tags/src1.*"), ("misc.french.includeRegexp", ".*/fr/.*"), ("misc.french.odd.includeRegexp", "refs/odd/.*")]


@query(
    f"WITH {REFS_SQL}, g AS (SELECT refname, {GROUP_SQL} AS top, refname LIKE '%/fr/%' AS french FROM refs) SELECT symbol, CAST(count(*) AS BIGINT) AS n FROM (SELECT '' AS symbol FROM g UNION ALL SELECT top FROM g WHERE top <> 'other' UNION ALL SELECT 'other' FROM g WHERE top = 'other' AND NOT french "
    "UNION ALL SELECT CASE WHEN refname LIKE 'refs/tags/src1%' THEN 'tags.releases' ELSE 'tags.other' END FROM g WHERE top = 'tags' UNION ALL SELECT unnest(['misc', 'misc.french', CASE WHEN starts_with(refname, 'refs/odd/') THEN 'misc.french.odd' ELSE 'misc.french.other' END]) FROM g WHERE french) GROUP BY symbol"
)
def ref_group_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Groups below groups, one of them without a filter of its own; a name counts in all that take it."""
    return group_counts(Groups(NESTED).finish().categorized(refs(spark, folder)))


@query(f"WITH {REFS_SQL} SELECT refname FROM refs WHERE {GROUP_SQL} = 'other'")
def ref_group_other(spark: SparkSession, folder: str) -> DataFrame:
    found = Groups().finish().categorized(refs(spark, folder))
    return found.where(F.array_contains("groups", "other")).select("refname")


@query(f"WITH {REFS_SQL} SELECT symbol, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN starts_with(refname, 'refs/heads/') THEN 'branches' ELSE 'ignored' END AS symbol FROM refs UNION ALL SELECT '' FROM refs WHERE starts_with(refname, 'refs/heads/')) GROUP BY symbol")
def ref_ignored(spark: SparkSession, folder: str) -> DataFrame:
    """References that aren't walked still count, as ignored."""
    return group_counts(Groups().finish([("include", "@branches")]).categorized(refs(spark, folder)))


@query(f"WITH {REFS_SQL} SELECT CASE WHEN starts_with(refname, 'refs/remotes/') THEN '  ' ELSE '+ ' END || refname AS line FROM refs")
def show_refs(spark: SparkSession, folder: str) -> DataFrame:
    return shown(Groups().finish([("no-remotes", "true")]).categorized(refs(spark, folder)))


@query(f"WITH {REFS_SQL}, g AS (SELECT {GROUP_SQL} AS top FROM refs) SELECT CAST(count(*) AS BIGINT) AS reference_count, CAST(count(DISTINCT CASE WHEN top <> 'stash' THEN top END) + count(DISTINCT top <> 'stash' OR NULL) AS BIGINT) AS n_groups FROM g")
def reference_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The groups that have walked references, and the one of all of them."""
    found = Groups().finish([("exclude", "@stash")]).categorized(refs(spark, folder))
    return reference_statistics(found).select("reference_count", F.size(F.map_filter("reference_groups", lambda k, v: k != "ignored")).cast("bigint").alias("n_groups"))


@query("SELECT DISTINCT 'refgroup.' || event_type || '.name' AS key, event_type || '.name' AS rest, CAST(NULL AS VARCHAR) AS inside FROM events UNION ALL SELECT DISTINCT 'refgroups.' || event_type, NULL, NULL FROM events")
def config_key_match(spark: SparkSession, folder: str) -> DataFrame:
    """Keys match a section at a dot only."""
    kinds = table(spark, folder, "events").select("event_type").distinct()
    keys = kinds.select(F.concat(F.lit("refgroup."), "event_type", F.lit(".name")).alias("key")).union(kinds.select(F.concat(F.lit("refgroups."), "event_type")))
    return keys.select("key", config_rest(F.col("key"), "refgroup").alias("rest"), config_rest(F.col("key"), "refgroup.cl").alias("inside"))


# Traversal and integrity


@query("""SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT DISTINCT 'nation' AS kind, CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_regionkey = 3
  UNION SELECT 'customer', c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3
  UNION SELECT 'order', o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3
  UNION SELECT 'part', l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3 AND l_returnflag <> 'A'
  UNION SELECT 'region', 3) GROUP BY kind""")
def reachable_from_region(spark: SparkSession, folder: str) -> DataFrame:
    """Everything below one region; submodules aren't followed."""
    at = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    edges = table(spark, folder, "nation").select(at("region", "n_regionkey").alias("src"), at("nation", "n_nationkey").alias("dst"))
    edges = edges.union(table(spark, folder, "customer").select(at("nation", "c_nationkey"), at("customer", "c_custkey"))).union(table(spark, folder, "orders").select(at("customer", "o_custkey"), at("order", "o_orderkey")))
    edges = edges.union(table(spark, folder, "lineitem").where("l_returnflag <> 'A'").select(at("order", "l_orderkey"), at("part", "l_partkey")))
    roots = spark.range(1).select(F.lit("region:3").alias("oid"))
    return reachable(roots, edges).groupBy(F.substring_index("oid", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT what, n FROM (SELECT 'orders without lines' AS what, CAST(count(*) AS BIGINT) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT 'lines without part', CAST(count(DISTINCT l_partkey) AS BIGINT) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'repeated lines', CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))")
def integrity_dangling(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders, part = (table(spark, folder, t) for t in ("lineitem", "orders", "part"))
    counted = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    empty = dangling(lines.select(F.col("l_orderkey").alias("oid")), orders.select(F.col("o_orderkey").alias("oid")))
    lost = dangling(part.select(F.col("p_partkey").alias("oid")), lines.select(F.col("l_partkey").alias("oid")))
    twice = repeated(lines.select(F.struct("l_orderkey", "l_linenumber").alias("oid")))
    return counted("orders without lines", empty).union(counted("lines without part", lost)).union(counted("repeated lines", twice))


@query("SELECT type, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS total FROM (SELECT 'blob' AS type, p_size AS size FROM part UNION ALL SELECT 'tree', NULL FROM orders UNION ALL SELECT 'tree', NULL FROM customer UNION ALL SELECT 'commit', strlen(text) FROM conversations UNION ALL SELECT 'tag', strlen(p_name) FROM part WHERE p_partkey > 0) GROUP BY type")
def object_census(spark: SparkSession, folder: str) -> DataFrame:
    part, none = table(spark, folder, "part"), F.lit(None).cast("bigint")
    every = part.select(F.lit("blob").alias("type"), F.col("p_size").cast("bigint").alias("size")).union(table(spark, folder, "orders").select(F.lit("tree"), none)).union(table(spark, folder, "customer").select(F.lit("tree"), none))
    every = every.union(commits(spark, folder).select(F.lit("commit"), "size")).union(part.where("p_partkey > 0").select(F.lit("tag"), F.octet_length("p_name").cast("bigint")))
    return every.groupBy("type").agg(count32().alias("n"), sum64(F.coalesce("size", F.lit(0))).cast("bigint").alias("total"))


# Report

#: The report's row over the sales graph, and the same in SQL.
REPORT_SQL = with_levels(
    "root",
    """, r AS (SELECT symbol, section, value, scale, value / scale AS level FROM (
  SELECT 'uniqueBlobCount' AS symbol, 'Overall repository size / Blobs' AS section, (SELECT count(*) FROM part) AS value, 1.5e6 AS scale
  UNION ALL SELECT 'uniqueBlobSize', 'Overall repository size / Blobs', (SELECT sum(p_size) FROM part), 10e9
  UNION ALL SELECT 'maxBlobSize', 'Biggest objects / Blobs', (SELECT max(p_size) FROM part), 10e6
  UNION ALL SELECT 'maxTreeEntries', 'Biggest objects / Trees', (SELECT max(entries) FROM customer_t), 1000
  UNION ALL SELECT 'maxCheckoutTreeCount', 'Biggest checkouts', (SELECT trees FROM root_t), 2000
  UNION ALL SELECT 'maxCheckoutPathDepth', 'Biggest checkouts', (SELECT max_path_depth FROM root_t), 10
  UNION ALL SELECT 'maxCheckoutPathLength', 'Biggest checkouts', (SELECT max_path_length FROM root_t), 100
  UNION ALL SELECT 'maxCheckoutBlobCount', 'Biggest checkouts', (SELECT blobs FROM root_t), 50e3
  UNION ALL SELECT 'maxCheckoutBlobSize', 'Biggest checkouts', (SELECT blob_bytes FROM root_t), 1e9
  UNION ALL SELECT 'maxCheckoutLinkCount', 'Biggest checkouts', (SELECT links FROM root_t), 25e3
  UNION ALL SELECT 'maxCheckoutSubmoduleCount', 'Biggest checkouts', (SELECT submodules FROM root_t), 100))
""",
).rstrip()


def report_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue's metrics that the sales graph has, with values, levels and stars."""
    blob_fields = {"uniqueBlobCount": "unique_blob_count", "uniqueBlobSize": "unique_blob_size", "maxBlobSize": "max_blob_size"}
    root_fields = {
        "maxCheckoutTreeCount": "trees", "maxCheckoutPathDepth": "max_path_depth", "maxCheckoutPathLength": "max_path_length", "maxCheckoutBlobCount": "blobs", "maxCheckoutBlobSize": "blob_bytes",
        "maxCheckoutLinkCount": "links", "maxCheckoutSubmoduleCount": "submodules",
    }
    customers = stored(tree_sizes(spark, folder, "customer"), "customer-sizes")
    values = metric_rows(blob_statistics(blobs(spark, folder).withColumn("ord", F.col("oid"))), blob_fields)
    values = values.union(metric_rows(tree_sizes(spark, folder, "root", {"customer": customers}), root_fields)).union(metric_rows(customers.agg(F.max("entries").alias("most")), {"maxTreeEntries": "most"}))
    rows = catalogue(spark).join(values, "symbol")
    over = F.col("value") >= F.col("cap")
    return rows.withColumn("level", level(F.col("value"), F.col("scale"))).withColumn("stars", stars(F.col("value"), F.col("scale"), over)).withColumn("overflow", over)


def stars_sql() -> str:
    return "CASE WHEN level > 30 THEN repeat('!', 30) ELSE repeat('*', CAST(floor(level) AS INTEGER)) END"


def report_columns(df: DataFrame) -> DataFrame:
    return df.select("symbol", "section", F.col("value").cast("bigint").alias("value"), F.col("level").cast("double").alias("level"), "stars")


REPORT_SELECT = f" SELECT symbol, section, CAST(value AS BIGINT) AS value, CAST(level AS DOUBLE) AS level, {stars_sql()} AS stars FROM r"


@query(REPORT_SQL + REPORT_SELECT)
def level_of_concern(spark: SparkSession, folder: str) -> DataFrame:
    return report_columns(report_rows(spark, folder))


def reported(df: DataFrame, threshold: float) -> DataFrame:
    """Overflow is reported whatever the threshold."""
    return df.where(F.col("overflow") | (F.col("level") >= threshold))


@query(REPORT_SQL + REPORT_SELECT + " WHERE level >= 1")
def threshold_report(spark: SparkSession, folder: str) -> DataFrame:
    return report_columns(reported(report_rows(spark, folder), 1.0))


@query(REPORT_SQL + REPORT_SELECT + " WHERE level >= 30")
def critical_report(spark: SparkSession, folder: str) -> DataFrame:
    return report_columns(reported(report_rows(spark, folder), 30.0))


@query(REPORT_SQL + " SELECT symbol, CAST(value AS BIGINT) AS value, CAST(scale AS DOUBLE) AS reference_value, CAST(level AS DOUBLE) AS level, CASE WHEN symbol LIKE '%Size' OR symbol LIKE '%Length' THEN 'B' ELSE '' END AS unit, CASE WHEN symbol LIKE '%Size' OR symbol LIKE '%Length' THEN 'binary' ELSE 'metric' END AS prefixes FROM r")
def json_v2_rows(spark: SparkSession, folder: str) -> DataFrame:
    return report_rows(spark, folder).select("symbol", F.col("value").cast("bigint").alias("value"), F.col("scale").alias("reference_value"), F.col("level").alias("level"), "unit", F.col("system").alias("prefixes"))


@query("WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders), f AS (SELECT c_nationkey, min(o_orderkey) AS ord FROM o JOIN customer ON c_custkey = o_custkey WHERE rn = 1 GROUP BY c_nationkey) SELECT o_orderkey, n_name AS note, CAST(dense_rank() OVER (ORDER BY f.ord) AS BIGINT) AS citation FROM o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN f ON f.c_nationkey = n_nationkey WHERE rn = 1")
def footnotes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes are numbered by first use, and equal texts share a number."""
    best = table(spark, folder, "orders").withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("rn = 1")
    used = best.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.col("n_name").alias("note"))
    first = used.groupBy("note").agg(F.min("o_orderkey").alias("first"))
    numbered = first.withColumn("citation", F.dense_rank().over(Window.orderBy("first")).cast("bigint"))
    return used.join(numbered, "note").select("o_orderkey", "note", "citation")


def code(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string")).cast("binary")


def name_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sales graph as entries, order, commits and roots of a name search: regions down to parts below the one commit of a reference."""
    steps = [("region", None, "r_regionkey", "r", "", "r_name", None), ("nation", "n_regionkey", "n_nationkey", "n", "", "n_name", "r"), ("customer", "c_nationkey", "c_custkey", "c", "c", "c_custkey", "n"), ("orders", "o_custkey", "o_orderkey", "o", "o", "o_orderkey", "c")]
    held, order = [], [spark.createDataFrame([(bytearray(b"root"), 0)], "oid binary, ord long")]
    for i, (name, above, key, letter, head, called, parent) in enumerate(steps):
        rows = table(spark, folder, name)
        tree = code(parent, above) if above else F.lit("root").cast("binary")
        held.append(rows.select(tree.alias("tree"), F.col(key).cast("long").alias("pos"), code(head, called).alias("name"), code(letter, key).alias("child"), F.lit("tree").alias("kind")))
        order.append(rows.select(code(letter, key).alias("oid"), (F.lit(i + 1) * F.lit(1 << 40) + F.col(key)).alias("ord")))
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'N'")
    held.append(lines.select(code("o", "l_orderkey").alias("tree"), F.col("l_linenumber").cast("long").alias("pos"), code("l", "l_linenumber").alias("name"), code("p", "l_partkey").alias("child"), F.lit("blob").alias("kind")))
    order.append(table(spark, folder, "part").select(code("p", "p_partkey").alias("oid"), (F.lit(9 << 40) + F.col("p_partkey")).alias("ord")))
    head = bytearray(b"commit")
    commits = spark.createDataFrame([(head, 1, bytearray(b"root"))], "oid binary, ord long, tree binary")
    return reduce(DataFrame.union, held), reduce(DataFrame.union, order), commits, spark.createDataFrame([(1, "refs/heads/main", head, True)], "ord long, name string, oid binary, walk boolean")


@query("SELECT o_orderkey, 'refs/heads/main:' || r_name || '/' || n_name || '/c' || c_custkey || '/o' || o_orderkey AS path FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def witness_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The names of all orders, by paths that double along first referrers."""
    orders = table(spark, folder, "orders").select(code("o", "o_orderkey").alias("oid"), F.lit("tree").alias("type"))
    named = named_objects(orders, *name_tables(spark, folder))
    return named.select(F.substring(F.col("oid").cast("string"), 2, 20).cast("bigint").alias("o_orderkey"), "path")


@query("WITH used AS (SELECT p_partkey, min(l_orderkey) AS first_order FROM part JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'N' GROUP BY p_partkey) SELECT p_partkey, 'refs/heads/main:' || r_name || '/' || n_name || '/c' || c_custkey || '/o' || o_orderkey || '/l' || (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = first_order AND l_partkey = p_partkey AND l_returnflag = 'N') AS path FROM part LEFT JOIN used USING (p_partkey) LEFT JOIN orders ON o_orderkey = first_order LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def witness_blob_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The names of all parts, null for those that no order holds as a blob; of many orders the first counts."""
    parts = table(spark, folder, "part").select(code("p", "p_partkey").alias("oid"), F.lit("blob").alias("type"))
    named = named_objects(parts, *name_tables(spark, folder))
    return named.select(F.substring(F.col("oid").cast("string"), 2, 20).cast("bigint").alias("p_partkey"), "path")


LOOKUP_SQL = "SELECT 'main:' || r_name || '/' || n_name || '/c' || c_custkey || CASE WHEN o_orderkey % 7 = 0 THEN '/none' WHEN o_orderkey % 7 = 1 THEN '' ELSE '/o' || o_orderkey END AS name, CASE WHEN o_orderkey % 7 = 1 THEN 'c' || c_custkey WHEN o_orderkey % 7 > 1 THEN 'o' || o_orderkey END AS found FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


@query(f"SELECT name, found, CASE WHEN found IS NOT NULL THEN 'tree' END AS type FROM ({LOOKUP_SQL})")
def revision_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Objects by names of the form rev:path, all names together, one join for each component; some names have no object."""
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nr, order = F.col("o_orderkey") % 7, F.concat(F.lit("/o"), F.col("o_orderkey").cast("string"))
    name = F.concat(F.lit("main:"), F.concat_ws("/", "r_name", "n_name", F.concat(F.lit("c"), F.col("c_custkey").cast("string"))), F.when(nr == 0, "/none").when(nr == 1, "").otherwise(order))
    entries, places, commits, roots = name_tables(spark, folder)
    refs = roots.select(F.col("name").alias("refname"), "oid", F.lit("commit").alias("type"))
    objects, tags = places.select("oid", F.lit("tree").alias("type")), refs.limit(0).select("oid", F.col("oid").alias("referent"), F.col("type").alias("referent_type"))
    found = resolved(orders.select(name.alias("name")), refs, objects, tags, commits, entries)
    return found.select("name", F.col("oid").cast("string").alias("found"), "type")


def sales_report(spark: SparkSession, folder: str, names: str = "none") -> Report:
    """The report of the sales graph; its own witnesses are the largest part, the customer with most orders, and the root."""
    key = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    values: dict = dict.fromkeys((m.field for m in CATALOGUE), 0) | dict.fromkeys((m.witness for m in CATALOGUE if m.witness))
    values |= blob_statistics(blobs(spark, folder).select(key(F.col("oid")).alias("oid"), F.col("oid").alias("ord"), "size")).first().asDict()
    sizes = stored(tree_sizes(spark, folder, "customer"), "customer-sizes")
    customers = sizes.select(key(F.col("oid")).alias("max_tree_entries_tree"), F.col("entries").alias("max_tree_entries"))
    values |= customers.orderBy(F.desc("max_tree_entries"), "max_tree_entries_tree").first().asDict()
    row = tree_sizes(spark, folder, "root", {"customer": sizes}).first().asDict()
    for column, field, by in TREE_MAXIMA:
        if column != "entries":
            values |= {field: row[column], by: (0).to_bytes(8, "big")}
    return Report(values, {}, [], names)


OF_SALES = ("uniqueBlobCount", "uniqueBlobSize", "maxBlobSize", "maxTreeEntries", "maxCheckoutTreeCount", "maxCheckoutPathDepth", "maxCheckoutPathLength", "maxCheckoutBlobCount", "maxCheckoutBlobSize", "maxCheckoutLinkCount", "maxCheckoutSubmoduleCount")


@query(SQL["json_v2_rows"])
def json_v2_report(spark: SparkSession, folder: str) -> DataFrame:
    """The second JSON format as the report writes it, read back."""
    written = json.loads(sales_report(spark, folder).json_metrics())
    rows = [(s, written[s]["value"], float(written[s]["referenceValue"]), float(written[s]["levelOfConcern"]), written[s]["unit"], written[s]["prefixes"]) for s in OF_SALES]
    return spark.createDataFrame(rows, "symbol string, value long, reference_value double, level double, unit string, prefixes string")


@query("WITH most AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 1), part_of AS (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 1), w AS (SELECT 'Maximum entries' AS name, o_custkey AS id FROM most UNION ALL SELECT 'Maximum size', p_partkey FROM part_of UNION ALL SELECT unnest(['Number of directories', 'Maximum path depth', 'Maximum path length', 'Number of files', 'Total size of files', 'Number of symlinks', 'Number of submodules']), 0), n AS (SELECT name, lower(lpad(to_hex(id), 16, '0')) AS note, CASE name WHEN 'Maximum entries' THEN 0 WHEN 'Maximum size' THEN 1 ELSE 2 END AS place FROM w) SELECT name, note, CAST(dense_rank() OVER (ORDER BY first) AS BIGINT) AS citation FROM (SELECT name, note, min(place) OVER (PARTITION BY note) AS first FROM n)")
def report_footnotes(spark: SparkSession, folder: str) -> DataFrame:
    """The report's table, read back: lines with a citation, and the notes below. Equal notes share a number."""
    text = sales_report(spark, folder, "hash").table(threshold=0)
    notes = dict(re.findall(r"^\[(\d+)\] +(\S+)$", text, re.MULTILINE))
    cited = re.findall(r"^\| [ *]*(\S[^|]*?) *\[(\d+)\] \|", text, re.MULTILINE)
    return spark.createDataFrame([(name, notes[n], int(n)) for name, n in cited], "name string, note string, citation long")


@query("WITH named AS (SELECT o_orderkey, 'refs/heads/main:' || r_name || '/' || n_name || '/c' || c_custkey || '/o' || o_orderkey AS path, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey), tops AS (SELECT 'o' || o_orderkey AS object, path FROM named ORDER BY o_totalprice DESC, o_orderkey LIMIT 20), used AS (SELECT p_partkey, min(p_size) AS size, min(l_orderkey) AS first_order FROM part JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'N' GROUP BY p_partkey ORDER BY size DESC, p_partkey LIMIT 20), parts AS (SELECT 'p' || p_partkey AS object, path || '/l' || (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = first_order AND l_partkey = p_partkey AND l_returnflag = 'N') AS path FROM used JOIN named ON o_orderkey = first_order) SELECT object, path FROM tops UNION ALL SELECT object, path FROM parts")
def witness_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the dearest orders and of the largest parts in use, by hops to the first tree that holds each, up to the commit of a reference."""
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'N'")
    dearest = table(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.hex(code("o", "o_orderkey")).alias("oid"), F.lit("tree").alias("kind"))
    used = table(spark, folder, "part").join(lines, F.col("l_partkey") == F.col("p_partkey"), "left_semi").orderBy(F.desc("p_size"), "p_partkey").limit(20)
    wanted = {r["oid"].lower(): r["kind"] for r in dearest.union(used.select(F.hex(code("p", "p_partkey")), F.lit("blob"))).collect()}
    links = find_links(wanted, *name_tables(spark, folder))
    return spark.createDataFrame([(bytes.fromhex(o).decode(), path(o, kind, links)) for o, kind in wanted.items()], "object string, path string")


# Parsers


def fake_oid(x: Column) -> Column:
    """40 hexadecimal digits from a number."""
    return F.concat(F.md5(x.cast("string").cast("binary")), F.lit("00000000"))


@query(f"WITH {REFS_SQL} SELECT md5(CAST(ord AS VARCHAR)) || '00000000' AS oid, 'commit' AS type, CAST(size AS BIGINT) AS size, refname FROM refs")
def parse_reference_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat_ws(" ", fake_oid(F.col("ord")), F.lit("commit"), F.col("size").cast("string"), "refname")
    return refs(spark, folder).select(reference_line(line).alias("r")).select(oid_text(F.col("r.oid")).alias("oid"), "r.type", "r.size", "r.refname")


@query("SELECT md5(CAST(p_partkey AS VARCHAR)) || '00000000' AS oid, 'blob' AS type, CAST(least(CAST(p_size AS HUGEINT) * 100000000, 4294967295) AS BIGINT) AS size FROM part")
def parse_batch_headers(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat_ws(" ", fake_oid(F.col("p_partkey")), F.lit("blob"), (F.col("p_size").cast("bigint") * 100000000).cast("string"))
    return table(spark, folder, "part").select(batch_header(line).alias("h")).select(oid_text(F.col("h.oid")).alias("oid"), "h.type", "h.size")


@query("SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS id, md5(CAST(conv_id AS VARCHAR)) || '00000000' AS tree, CAST(least(turn, 1) * 2 AS BIGINT) AS n_parents, CASE WHEN turn > 0 THEN md5(CAST(turn - 1 AS VARCHAR)) || '00000000' END AS first_parent FROM conversations")
def parse_header_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Commits as text with a folded header line, parsed back."""
    parent = lambda x: F.concat(F.lit("parent "), fake_oid(x), F.lit("\n"))
    parents = F.when(F.col("turn") > 0, F.concat(parent(F.col("turn") - 1), parent(F.col("turn")))).otherwise("")
    text = F.concat(F.lit("tree "), fake_oid(F.col("conv_id")), F.lit("\n"), parents, F.lit("author someone\ngpgsig first\n tree second\n\n"), "text")
    raw = table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.encode(text, "UTF-8").alias("data"))
    found = parsed_commits(raw)
    return found.select("id", oid_text(F.col("tree")).alias("tree"), F.size("parents").cast("bigint").alias("n_parents"), oid_text(F.get("parents", F.lit(0))).alias("first_parent"))


@query("SELECT p_partkey AS id, md5(CAST(p_partkey AS VARCHAR)) || '00000000' AS referent, CASE WHEN p_partkey % 2 = 0 THEN 'tag' ELSE 'commit' END AS referent_type FROM part")
def parse_tag_headers(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 2 == 0, "tag").otherwise("commit")
    text = F.concat(F.lit("object "), fake_oid(F.col("p_partkey")), F.lit("\ntype "), kind, F.lit("\ntag "), "p_name", F.lit("\n\nobject none\n"))
    found = parsed_tags(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.encode(text, "UTF-8").alias("data")))
    return found.select("id", oid_text(F.col("referent")).alias("referent"), "referent_type")


@query("SELECT p_partkey AS id, pos, CASE pos WHEN 0 THEN 33188 ELSE 16384 END AS mode, CASE pos WHEN 0 THEN p_name ELSE p_brand END AS name, md5(CAST(p_partkey + pos AS VARCHAR)) || '00000000' AS child, CASE pos WHEN 0 THEN 'blob' ELSE 'tree' END AS kind FROM part, (SELECT CAST(0 AS INTEGER) AS pos UNION ALL SELECT CAST(1 AS INTEGER))")
def parse_tree_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Trees of two entries as bytes, parsed back."""
    entry = lambda mode, name, x: (F.encode(F.concat(F.lit(f"{mode} "), name), "UTF-8"), F.lit(bytearray(1)), F.unhex(fake_oid(x)))
    data = F.concat(*entry("100644", F.col("p_name"), F.col("p_partkey")), *entry("40000", F.col("p_brand"), F.col("p_partkey") + 1))
    found = parsed_trees(table(spark, folder, "part").select(F.encode(F.col("p_partkey").cast("string"), "UTF-8").alias("oid"), data.alias("data")))
    return found.select(F.decode("tree", "UTF-8").cast("bigint").alias("id"), "pos", F.col("mode").cast("int").alias("mode"), F.decode("name", "UTF-8").alias("name"), oid_text(F.col("child")).alias("child"), "kind")
