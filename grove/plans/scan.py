"""A whole scan: references and objects in, one row of statistics and a report out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.functions.counters import clamp32
from grove.functions.parsing import parsed_commits, parsed_tags, parsed_trees
from grove.operators.refgroups import Groups
from grove.operators.statistics import blob_statistics, commit_statistics, dangling, reference_statistics, repeated, tag_statistics, tree_statistics
from grove.operators.traversal import commit_depths, tag_depths
from grove.operators.treefold import fold_trees
from grove.operators.witness import find_links
from grove.plans.progress import Meter
from grove.plans.report import CATALOGUE, Report
from grove.sources.git import Repository, read, read_contents, read_objects
from grove.storage import stored

KINDS = ("blob", "tree", "commit", "tag")


#: The phases of a scan as progress names them: fixed.
PHASES = ("Processing blobs: {}", "Processing trees: {}", "Processing commits: {}", "Matching commits to trees: {}", "Processing annotated tags: {}", "Processing references: {}")

#: The phases that read contents, by type; what comes after the count is left open.
LIVE = {kind: phase.removesuffix(": {}") for kind, phase in zip(("tree", "commit", "tag"), (PHASES[1], PHASES[2], PHASES[4]))}

#: Objects of a task while progress is shown.
DEALT = 20_000


def scan_objects(objects: DataFrame, contents: Callable[[str], DataFrame], roots: DataFrame, groups: Sequence[tuple[str, str]], names: str = "full", tell: Callable[[str], None] = lambda text: None) -> Report:
    """The report over stored objects (ord, oid, type, size), the contents (oid, data) of a type, and roots (ord, name, oid, walk, is_ref, groups).

    Objects of another type, listed twice, or referred to but missing, are
    errors. tell hears of each phase with its count once it is done.
    """
    if objects.where(~F.col("type").isin(*KINDS)).limit(1).count():
        raise ValueError("an object has an unknown type")
    if repeated(objects).limit(1).count():
        raise ValueError("an object is listed twice")
    sized = objects.withColumn("size", clamp32(F.col("size")))
    of = lambda kind: contents(kind).join(sized.where(F.col("type") == kind).select("oid", "ord"), "oid")
    blobs, trees = (sized.where(F.col("type") == k).select("oid", "ord", "size") for k in ("blob", "tree"))
    entries = stored(parsed_trees(of("tree").select("oid", "data")).withColumn("name_length", F.octet_length("name").cast("bigint")), "entries")
    sizes = stored(fold_trees(trees, entries, blobs).join(trees.select("oid", F.col("size").alias("object_size")), "oid"), "tree-sizes")

    commits = stored(parsed_commits(of("commit")).select("oid", "ord", "size", "tree", "parents"), "commits")
    if dangling(trees, commits.select(F.col("tree").alias("oid"))).limit(1).count():
        raise ValueError("a commit's tree is missing")
    depths = commit_depths(commits.select("oid", "ord"), commits.select("oid", F.explode("parents").alias("parent")))
    history = commits.withColumn("n_parents", F.size("parents").cast("bigint")).join(depths, "oid")
    tags = tag_depths(parsed_tags(of("tag")).select("oid", "ord", "referent", "referent_type"))

    row: dict = {}
    steps = ((blob_statistics(blobs), ("unique_blob_count",)), (tree_statistics(sizes), ("unique_tree_count",)), (commit_statistics(history), ("unique_commit_count",) * 2), (tag_statistics(tags), ("unique_tag_count",)), (reference_statistics(roots.where("is_ref")), ("reference_count",)))
    phases = iter(PHASES)
    for one, counted in steps:
        row |= one.first().asDict()
        for field in counted:
            tell(next(phases).format(row[field]))
    wanted = {bytes(row[m.witness]).hex(): m.kind for m in CATALOGUE if m.witness and row[m.witness] is not None}
    links = find_links(wanted, entries, objects.select("oid", "ord"), commits.select("oid", "ord", "tree"), roots) if names == "full" else {}
    return Report(row, links, list(groups), names)


def scan_repository(spark: SparkSession, path: str, options: Sequence[tuple[str, str]] = (), roots: Sequence[str] = (), names: str = "full", partitions: int = 4, tell: Callable[[str], None] = lambda text: None, meter: Meter | None = None) -> tuple[Report, DataFrame]:
    """The report of a repository, and its categorised references in order.

    meter gets the objects of each type as tasks read them, some DEALT a task,
    under the names of the phases.

    options are the selection rules in order; roots are names of objects to
    walk too. With roots and no rules, no reference is walked, though all
    still count.
    """
    repository = Repository.at(path)
    groups = Groups(repository.config("refgroup")).finish(list(options), default_all=not roots)
    refs = groups.categorized(stored(read(spark, path, "refs"), "refs"))
    walked = refs.select("ord", F.col("refname").alias("name"), "oid", "walk", F.lit(True).alias("is_ref"), "groups")
    explicit = [(1 << 40 | i, name, bytearray.fromhex(repository.resolve(name))) for i, name in enumerate(roots)]
    if explicit:
        added = spark.createDataFrame(explicit, "ord long, name string, oid binary")
        walked = walked.unionByName(added.withColumns({"walk": F.lit(True), "is_ref": F.lit(False), "groups": F.array().cast("array<string>")}))
    walked = stored(walked, "roots")
    objects = stored(read_objects(walked.where("walk").select("ord", "oid"), path), "objects")
    if meter:
        partitions = max(partitions, -(-objects.where("type <> 'blob'").count() // DEALT))
    of = lambda kind: meter.count(LIVE[kind]) if meter else None
    contents = lambda kind: read_contents(objects.where(F.col("type") == kind), path, partitions, of(kind))
    with meter.running() if meter else nullcontext():
        return scan_objects(objects, contents, walked, groups.order, names, tell), refs
