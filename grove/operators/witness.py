"""Names of objects.

What refers to an object is a tree, else the newest commit whose root it is,
else the first walked root; a tag isn't followed. find_links names the dozen
objects that hold a report's maxima, after these are known, hop by hop.
named_objects names any number: first referrers make a forest, along which
paths grow by doubling.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.operators.joins import join_one
from grove.storage import stored

#: Objects that find_links names, one driver round for each hop; a report has fewer maxima.
MOST = 64


@dataclass
class Link:
    """How an object is referred to: by a parent's name for it, or by a root's name."""

    kind: str
    parent: str | None = None
    name: str = ""


def find_links(wanted: dict[str, str], entries: DataFrame, order: DataFrame, commits: DataFrame, roots: DataFrame) -> dict[str, Link]:
    """The link of each wanted object (hex id to type) and of all objects on the way to its root.

    entries (tree, pos, name, child, kind), order (oid, ord) of all objects,
    commits (oid, ord, tree), roots (ord, name, oid, walk). A tree counts as
    referrer of a subtree only if it was read first.
    """
    if len(wanted) > MOST:
        raise ValueError("too many objects to name one by one; use named_objects")
    spark, found, todo = entries.sparkSession, {}, dict(wanted)
    while todo:
        sought = F.broadcast(spark.createDataFrame([(bytearray.fromhex(o), t) for o, t in todo.items()], "oid binary, type string"))
        links: dict[str, Link] = {}
        inner = sought.where("type in ('blob', 'tree')")
        held = entries.where("kind <> 'submodule'").join(inner.withColumnRenamed("oid", "child"), "child").join(order.select(F.col("oid").alias("tree"), F.col("ord").alias("tree_ord")), "tree")
        held = held.join(order.select(F.col("oid").alias("child"), F.col("ord").alias("child_ord")), "child").where("type = 'blob' or tree_ord < child_ord")
        for r in held.groupBy("child").agg(F.min_by(F.struct("tree", "name"), F.struct("tree_ord", "pos")).alias("x")).collect():
            links[bytes(r["child"]).hex()] = Link("entry", bytes(r["x"]["tree"]).hex(), bytes(r["x"]["name"]).decode("utf-8", "replace"))
        for r in commits.join(inner.where("type = 'tree'").select(F.col("oid").alias("tree")), "tree").groupBy("tree").agg(F.min_by("oid", "ord").alias("x")).collect():
            links.setdefault(bytes(r["tree"]).hex(), Link("root", bytes(r["x"]).hex()))
        for r in roots.where("walk").join(sought, "oid").groupBy("oid").agg(F.min_by("name", "ord").alias("x")).collect():
            links.setdefault(bytes(r["oid"]).hex(), Link("name", None, r["x"]))
        found |= {o: links.get(o, Link("none")) for o in todo}
        todo = {link.parent: "commit" if link.kind == "root" else "tree" for link in links.values() if link.parent and link.parent not in found}
    return found


def first_holders(entries: DataFrame, order: DataFrame) -> DataFrame:
    """(oid, tree, name): the tree that was read first of those that hold a blob, link or subtree, and its first name for it there; a tree holds a subtree only if it was read before it."""
    place = lambda name: order.select(F.col("oid").alias(name), F.col("ord").alias(f"{name}_ord"))
    sizes = entries.groupBy("tree").agg(F.count("*").alias("n"))
    total = entries.count()
    held = join_one(entries.where("kind <> 'submodule'").select("tree", "pos", "name", "child", "kind"), stored(sizes.join(place("tree"), "tree"), "witness-trees"), ["tree"], "n", total, ["pos", "child"])
    subtrees = held.where("kind = 'tree'").groupBy("child").agg(F.min_by(F.struct("tree", "name"), F.struct("tree_ord", "pos")).alias("x"), F.min("tree_ord").alias("tree_ord"))
    subtrees = subtrees.join(place("child"), "child").where("tree_ord < child_ord").drop("tree_ord", "child_ord")
    others = held.where("kind <> 'tree'").groupBy("child").agg(F.min_by(F.struct("tree", "name"), F.struct("tree_ord", "pos")).alias("x"))
    return subtrees.unionByName(others).select(F.col("child").alias("oid"), "x.tree", "x.name")


def doubled_paths(holders: DataFrame) -> DataFrame:
    """(oid, top, path): the highest tree over each object of holders (oid, tree, name), and the names on the way down from it.

    Paths grow for trees that hold something; what holds nothing gets its
    tree's path in the end. Each round joins the paths so far to those of the
    trees that they begin at, so a depth of n takes log2 n rounds. Trees that
    hold themselves are an error.
    """
    used = stored(holders.groupBy("tree").agg(F.count("*").alias("n")), "paths-used")
    trees = used.select(F.col("tree").alias("oid"))
    above = tree_paths(stored(holders.join(trees, "oid", "left_semi").select("oid", F.col("tree").alias("top"), F.col("name").alias("path")), "paths"))
    upper = stored(above.select(F.col("oid").alias("tree"), F.col("top").alias("next"), F.col("path").alias("before")).join(used, "tree"), "paths-upper")
    below = join_one(holders.join(trees, "oid", "left_anti").select("oid", "tree", "name"), upper, ["tree"], "n", holders.count(), ["oid"])
    path = F.when(F.col("next").isNull(), F.col("name")).otherwise(F.concat("before", F.lit(b"/"), "name"))
    return above.unionByName(below.select("oid", F.coalesce("next", "tree").alias("top"), path.alias("path")))


def tree_paths(open_: DataFrame) -> DataFrame:
    """(oid, top, path) as doubled_paths gives them, from (oid, top, path) of what holds each directly."""
    done = []
    for _ in range(64):
        used = open_.groupBy("top").agg(F.count("*").alias("n"))
        upper = open_.select(F.col("oid").alias("top"), F.col("top").alias("next"), F.col("path").alias("before"))
        if done:
            upper = upper.unionByName(done[-1].select(F.col("oid").alias("top"), F.col("top").alias("next"), F.col("path").alias("before")))
        longer = stored(join_one(open_, stored(upper.join(used, "top"), "paths-upper"), ["top"], "n", open_.count(), ["oid"]), "paths-longer")
        settled = longer.where("next is null").select("oid", "top", "path")
        done.append(settled if not done else stored(done[-1].unionByName(settled), "paths-done"))
        open_ = longer.where("next is not null").select("oid", F.col("next").alias("top"), F.concat("before", F.lit(b"/"), "path").alias("path"))
        if open_.isEmpty():
            return done[-1]
    raise ValueError("trees hold themselves")


def hexed(oid: str) -> Column:
    return F.lower(F.hex(oid)).cast("binary")


def named_objects(objects: DataFrame, entries: DataFrame, order: DataFrame, commits: DataFrame, roots: DataFrame) -> DataFrame:
    """(oid, type, path, shown) of objects (oid, type): the name, null if there is none, and what a report shows, the id with the name in brackets.

    The other tables are those of find_links, and names are the same. Bytes
    that aren't UTF-8 become replacement characters. An object that is listed
    twice is named twice. Of entries that are no trees only those of the blobs
    asked for are followed, as no path leads through others.
    """
    blobs = stored(objects.where("type = 'blob'").select(F.col("oid").alias("child")).distinct(), "witness-blobs")
    entries = stored(entries.where("kind = 'tree'").unionByName(entries.where("kind <> 'tree'").join(blobs, "child", "left_semi").select(entries.columns)), "witness-entries")
    holders = stored(first_holders(entries, order), "witness-holders")
    paths = stored(doubled_paths(holders), "witness-paths")
    newest = commits.groupBy(F.col("tree").alias("oid")).agg(F.min_by("oid", "ord").alias("commit"))
    walked = roots.where("walk").groupBy("oid").agg(F.min_by("name", "ord").cast("binary").alias("root"))
    of_commit = walked.select(F.col("oid").alias("commit"), F.col("root").alias("commit_root"))
    tops = stored(newest.join(of_commit, "commit", "left").join(walked, "oid", "full"), "witness-tops")
    said = F.coalesce("commit_root", hexed("commit"))
    before = tops.select(F.col("oid").alias("top"), F.when(F.col("commit").isNotNull(), F.concat(said, F.lit(b":"))).otherwise(F.concat("root", F.lit(b"/"))).alias("before"))
    rows = objects.select("oid", "type").withColumn("_row", F.monotonically_increasing_id())
    held = join_one(paths, stored(paths.groupBy("top").agg(F.count("*").alias("n")).join(before, "top"), "witness-before"), ["top"], "n", paths.count(), ["oid"])
    held = held.select("oid", F.concat(F.coalesce("before", F.lit(b"???")), "path").alias("inner"))
    rows = rows.join(held, "oid", "left").join(tops, "oid", "left")
    root_of = F.when(F.col("type").isin("tree", "blob") & F.col("commit").isNotNull(), F.concat(said, F.lit(b"^{"), F.col("type").cast("binary"), F.lit(b"}")))
    inner = F.when(F.col("type").isin("tree", "blob"), F.col("inner"))
    path = F.make_valid_utf8(F.coalesce(inner, root_of, "root").cast("string"))
    rows = rows.select("oid", "type", path.alias("path"))
    shown = F.concat(hexed("oid").cast("string"), F.when(F.col("path").isNotNull(), F.concat(F.lit(" ("), "path", F.lit(")"))).otherwise(""))
    return rows.select("oid", "type", "path", shown.alias("shown"))


def best(oid: str, kind: str, links: dict[str, Link]) -> str:
    return path(oid, kind, links) or oid


def path(oid: str, kind: str, links: dict[str, Link]) -> str:
    """The object's name, empty if it has none."""
    link = links.get(oid, Link("none"))
    match link.kind:
        case "entry":
            return before(link.parent, links) + link.name
        case "root":
            return f"{best(link.parent, 'commit', links)}^{{{kind}}}"
        case _:
            return link.name


def before(tree: str, links: dict[str, Link]) -> str:
    """What stands before the names of a tree's entries."""
    link = links.get(tree, Link("none"))
    match link.kind:
        case "entry":
            return f"{before(link.parent, links)}{link.name}/"
        case "root":
            return f"{links[link.parent].name or link.parent}:"
        case "name":
            return f"{link.name}/"
        case _:
            return "???"


def described(oid: str, kind: str, links: dict[str, Link]) -> str:
    """The id, and the name in brackets if there is one."""
    name = path(oid, kind, links)
    return f"{oid} ({name})" if name else oid
