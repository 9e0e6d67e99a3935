"""Names of objects as `rev` or `rev:path`, resolved for a whole table at once.

Different revisions are looked up once each; paths go down one component for
each join, all names together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.operators.joins import join_one
from grove.storage import stored

#: Where a short name of a reference is looked for, in this order: fixed.
PLACES = ("{}", "refs/{}", "refs/tags/{}", "refs/heads/{}", "refs/remotes/{}", "refs/remotes/{}/HEAD")

#: What may stand behind a revision: the type that tags, and commits for a tree, are followed to.
SUFFIX = r"\^\{(tree|commit|)\}$"


def peeled(found: DataFrame, tags: DataFrame) -> DataFrame:
    """found (rev, oid, type) with tags followed to what they stand for in the end, one join for each step."""
    done, open_ = [found.where("type <> 'tag'")], stored(found.where("type = 'tag'"), "revs-tags")
    for _ in range(tags.count() + 1):
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        on = open_.select("rev", "oid").join(tags.select("oid", "referent", "referent_type"), "oid").select("rev", F.col("referent").alias("oid"), F.col("referent_type").alias("type"))
        on = stored(on, "revs-tags")
        done.append(on.where("type <> 'tag'"))
        open_ = on.where("type = 'tag'")
    raise ValueError("tags form a cycle")


def resolved(names: DataFrame, refs: DataFrame, objects: DataFrame, tags: DataFrame, commits: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, oid, type) of names (name), oid null where there is no such object; a null name has none.

    refs (refname, oid, type), objects (oid, type), tags (oid, referent,
    referent_type), commits (oid, tree), entries (tree, name, child, kind). A
    revision is a reference by its full or a short name, or an id of 40
    digits, and may end in ^{tree}, ^{commit} or ^{}. The path behind a colon
    starts at its tree; a trailing slash asks for a tree. Names that repeat
    are resolved once each time.
    """
    name = F.col("name")
    colon = F.instr(name, ":")
    rev, way = F.when(colon > 0, F.substring(name, F.lit(1), colon - 1)).otherwise(name), F.when(colon > 0, F.substring(name, colon + 1, F.length(name)))
    rows = names.select("name").withColumn("_row", F.monotonically_increasing_id()).withColumns({"rev": rev, "way": way})
    rows = stored(rows, "names")
    revs = rows.where("rev <> ''").groupBy("rev").agg(F.count("*").alias("n"))
    revs = stored(revs.withColumns({"follow": F.regexp_extract("rev", SUFFIX, 1), "plain": F.regexp_replace("rev", SUFFIX, ""), "marked": F.col("rev").rlike(SUFFIX)}), "revs")
    places = F.array(*[F.struct(F.lit(i).alias("place"), F.concat(F.lit(p.split("{}")[0]), "plain", F.lit(p.split("{}")[1])).alias("refname")) for i, p in enumerate(PLACES)])
    looked = revs.select("rev", F.explode(places).alias("x")).select("rev", "x.place", "x.refname").join(refs.select("refname", "oid", "type"), "refname")
    by_id = revs.where(F.col("plain").rlike("^[0-9a-f]{40}$")).select("rev", F.lit(-1).alias("place"), F.unhex("plain").alias("oid")).join(objects.select("oid", "type"), "oid")
    at = looked.drop("refname").unionByName(by_id).groupBy("rev").agg(F.min_by(F.struct("oid", "type"), "place").alias("x")).select("rev", "x.oid", "x.type")
    at = stored(at, "revs-found")
    end = peeled(at, tags).withColumnsRenamed({"oid": "end", "type": "end_type"}).join(commits.select(F.col("oid").alias("end"), "tree"), "end", "left")
    tree = F.when(F.col("end_type") == "tree", F.col("end")).otherwise(F.col("tree"))
    at = revs.join(at, "rev").join(end, "rev", "left").withColumn("root", tree)
    follow = F.col("follow")
    pair = lambda oid, kind: F.struct(oid.alias("oid"), kind.alias("type"))
    own = F.when(~F.col("marked"), pair(F.col("oid"), F.col("type"))).when((follow == "tree") & F.col("root").isNotNull(), pair(F.col("root"), F.lit("tree")))
    own = own.when((follow == "commit") & (F.col("end_type") == "commit") | (follow == ""), pair(F.col("end"), F.col("end_type")))
    at = stored(at.select("rev", "n", own.alias("own"), "root"), "revs-roots")
    rows = stored(join_one(rows, at, ["rev"], "n", rows.count(), ["_row"]), "names-revs")
    whole = rows.where("way is null").select("_row", "name", F.col("own.oid").alias("oid"), F.col("own.type").alias("type"))
    last = F.when(F.col("way").endswith("/"), "tree")
    steps = F.split(F.regexp_replace("way", "/$", ""), "/")
    paths = rows.where("way is not null").select("_row", "name", F.col("root").alias("oid"), F.when(F.col("root").isNotNull(), "tree").alias("type"), F.when(F.col("way") == "", F.array().cast("array<string>")).otherwise(steps).alias("steps"), last.alias("must"))
    kinds = F.when(F.col("kind") == "tree", "tree").when(F.col("kind") == "submodule", "commit").otherwise("blob")
    held = entries.select(F.col("tree").alias("oid"), F.col("name").cast("binary").alias("step"), F.col("child").alias("next"), kinds.alias("next_type"))
    done, todo = [whole], paths
    while True:
        ended = (F.size("steps") == 0) | F.col("oid").isNull() | (F.col("type") != "tree")
        here = F.size("steps") == 0
        fits = here & (F.col("must").isNull() | (F.col("type") == "tree"))
        done.append(todo.where(ended).select("_row", "name", F.when(fits, F.col("oid")).alias("oid"), F.when(fits, F.col("type")).alias("type")))
        todo = todo.where(~ended).withColumn("step", F.get("steps", F.lit(0)).cast("binary"))
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done).select("name", "oid", "type")
        asked = todo.groupBy("oid", "step").agg(F.count("*").alias("n"))
        on = stored(held.join(asked, ["oid", "step"]), "paths-entries")
        todo = join_one(todo, on, ["oid", "step"], "n", todo.count(), ["_row"])
        todo = stored(todo.select("_row", "name", F.col("next").alias("oid"), F.col("next_type").alias("type"), F.slice("steps", F.lit(2), F.greatest(F.size("steps") - 1, F.lit(0))).alias("steps"), "must"), "paths")
