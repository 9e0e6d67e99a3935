"""A table of names against what git makes of each."""

import random
import subprocess

from pyspark.sql import functions as F

from grove.functions.parsing import parsed_commits, parsed_tags, parsed_trees
from grove.operators.revisions import resolved
from grove.sources.git import read, read_contents, read_objects


def rev_parse(repo, names):
    """git's own answers, all from one process; None where it has none."""
    asked = "".join(f"{n}\n" for n in names).encode()
    out = subprocess.run(["git", "-C", repo.path, "cat-file", "--batch-check=%(objectname) %(objecttype)"], input=asked, capture_output=True, check=True).stdout.decode().splitlines()
    return [None if line.endswith(("missing", "ambiguous")) or line.startswith("dangling") else line.split() for line in out]


def test_a_thousand_names(spark, git_repo):
    r, draw = git_repo, random.Random(4)
    blobs = [r.put("blob", b"%d" % i) for i in range(5)]
    trees, below = [], []
    for i in range(12):
        own = {draw.choice("abcdé") + draw.choice(["", ".txt", " x"]) for _ in range(4)}
        held = [("100644", n, draw.choice(blobs)) for n in sorted(own)] + [("40000", f"k{j}", t) for j, t in enumerate(draw.sample(trees, min(3, len(trees))))]
        trees.append(r.tree(*sorted(held, key=lambda e: (e[1] + "/" * (e[0] == "40000")).encode())))
    commits = [r.commit(t, at=i) for i, t in enumerate(trees)]
    for i, name in enumerate(("refs/heads/main", "refs/heads/v1", "refs/tags/v1", "refs/remotes/origin/HEAD", "refs/remotes/origin/dev", "refs/odd/x", "refs/heads/a/b")):
        r.ref(name, commits[-1 - i])
    for i, commit in enumerate(commits):
        r.ref(f"refs/all/{i}", commit)
    tag = r.tag("t", commits[-1], "commit")
    r.ref("refs/tags/t", tag)
    r.ref("refs/tags/tt", r.tag("tt", tag, "tag"))
    r.ref("refs/tags/tree", r.tag("tree", trees[-1], "tree"))
    r.ref("refs/tags/file", blobs[0])
    revs = ["main", "heads/v1", "v1", "origin", "origin/dev", "refs/odd/x", "odd/x", "a/b", "t", "tt", "tree", "file", commits[0], trees[3], blobs[1], "nothing", "0" * 40]
    parts = ["a", "b.txt", "c x", "é", "k0", "k1", "k2", "none"]
    names = revs + [f"{x}^{{{k}}}" for x in revs for k in ("tree", "commit", "")] + ["main:k0/", "main:a/", "main:"]
    while len(names) < 1000:
        names.append(f"{draw.choice(revs)}:{'/'.join(draw.choice(parts[-4:] + parts) for _ in range(draw.randint(1, 4)))}")
    refs = read(spark, r.path, "refs")
    objects = read_objects(refs.select("ord", "oid"), r.path).persist()
    of = lambda kind: read_contents(objects.where(F.col("type") == kind), r.path, 2).join(objects.where(F.col("type") == kind).select("oid", "ord"), "oid")
    tables = refs, objects, parsed_tags(of("tag").select("oid", "ord", "data")), parsed_commits(of("commit")), parsed_trees(of("tree").select("oid", "data"))
    found = resolved(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), *tables).collect()
    got = {(x["name"], None if x["oid"] is None else bytes(x["oid"]).hex(), x["type"]) for x in found}
    wanted = {(n, *(a or (None, None))) for n, a in zip(names, rev_parse(r, names), strict=True)} | {(None, None, None)}
    assert len(found) == len(names) + 1
    assert not got - wanted and not wanted - got, (sorted(got - wanted, key=str)[:4], sorted(wanted - got, key=str)[:4])


def test_paths_are_written_once_for_each_component(spark, monkeypatch):
    """A longer path costs two tables for each component: the entries found, and the rows behind them."""
    from grove.operators import revisions

    written, own = [], revisions.stored
    monkeypatch.setattr(revisions, "stored", lambda df, name: written.append(name) or own(df, name))
    entries = spark.createDataFrame([(b"0", b"a", b"1", "tree"), (b"1", b"a", b"2", "tree"), (b"2", b"a", b"3", "blob")], "tree binary, name binary, child binary, kind string")
    refs = spark.createDataFrame([("refs/heads/m", b"c", "commit")], "refname string, oid binary, type string")
    tags = spark.createDataFrame([], "oid binary, referent binary, referent_type string")
    commits = spark.createDataFrame([(b"c", b"0")], "oid binary, tree binary")
    names = spark.createDataFrame([("m:a/a/a",), ("m:a",), ("m:b/a",)], "name string")
    found = resolved(names, refs, refs.select("oid", "type"), tags, commits, entries).collect()
    assert {(r["name"], r["oid"] and bytes(r["oid"]), r["type"]) for r in found} == {("m:a/a/a", b"3", "blob"), ("m:a", b"1", "tree"), ("m:b/a", None, None)}
    assert sum(name.startswith("paths") for name in written) == 2 * 3
