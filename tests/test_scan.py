import json

import pytest

from grove.cli import main, parser, spelled_out
from grove.operators.witness import path
from grove.plans.scan import scan_repository
from grove.sources.git import Repository, read


def bomb(repo, depth=10, breadth=10):
    oid = repo.put("blob", b"boom!\n")
    mode, letter = "100644", "f"
    for _ in range(depth):
        oid = repo.tree(*((mode, f"{letter}{i}", oid) for i in range(breadth)))
        mode, letter = "40000", "d"
    repo.ref("refs/heads/master", repo.commit(oid))


def named(report, field, kind):
    return path(bytes(report.values[field]).hex(), kind, report.links)


def test_bomb_whole(spark, git_repo):
    bomb(git_repo)
    report, _ = scan_repository(spark, git_repo.path)
    v = report.values
    assert (v["unique_commit_count"], v["unique_commit_size"], v["max_commit_size"], v["max_history_depth"], v["max_parent_count"]) == (1, 172, 172, 1, 0)
    assert named(report, "max_commit", "commit") == named(report, "max_parent_count_commit", "commit") == "refs/heads/master"
    assert (v["unique_tree_count"], v["unique_tree_size"], v["unique_tree_entries"], v["max_tree_entries"]) == (10, 2910, 100, 10)
    assert named(report, "max_tree_entries_tree", "tree") == "refs/heads/master:d0/d0/d0/d0/d0/d0/d0/d0/d0"
    assert (v["unique_blob_count"], v["unique_blob_size"], v["max_blob_size"]) == (1, 6, 6)
    assert named(report, "max_blob_size_blob", "blob") == "refs/heads/master:d0/d0/d0/d0/d0/d0/d0/d0/d0/f0"
    assert (v["unique_tag_count"], v["max_tag_depth"], v["reference_count"]) == (0, 0, 1)
    assert (v["max_path_depth"], v["max_path_length"], v["max_expanded_tree_count"]) == (10, 29, 1_111_111_111)
    assert (v["max_expanded_blob_count"], v["max_expanded_blob_size"]) == (2**32 - 1, 60_000_000_000)
    for field in ("max_path_depth", "max_path_length", "max_expanded_tree_count", "max_expanded_blob_count", "max_expanded_blob_size"):
        assert named(report, f"{field}_tree", "tree") == "refs/heads/master^{tree}"
    assert v["max_expanded_link_count"] == v["max_expanded_submodule_count"] == 0
    assert v["max_expanded_link_count_tree"] is None
    table = report.table(1)
    assert "| * Number of files        [1] |     ∞     | !!!!!!!!!!!!!!!!!!!!!!!!!!!!!! |" in table
    assert "| * Number of directories  [1] |  1.11 G   | !!!!!!!!!!!!!!!!!!!!!!!!!!!!!! |" in table
    assert table.startswith("| Name                         | Value     | Level of concern               |\n| ---")
    first = json.loads(report.json_fields())
    assert list(first)[:4] == ["unique_commit_count", "unique_commit_size", "max_commit_size", "max_commit"]
    assert first["max_commit"].endswith(" (refs/heads/master)")
    second = json.loads(report.json_metrics())
    assert second["maxCheckoutBlobSize"]["levelOfConcern"] == 60 and second["maxCheckoutBlobSize"]["prefixes"] == "binary"
    assert list(second) == sorted(second)


def test_bomb_from_a_tree(spark, git_repo):
    bomb(git_repo)
    report, _ = scan_repository(spark, git_repo.path, roots=["master:d0/d0"])
    v = report.values
    assert (v["unique_commit_count"], v["max_commit_size"], v["max_history_depth"]) == (0, 0, 0)
    assert v["max_commit"] is None
    assert (v["unique_tree_count"], v["unique_tree_size"], v["unique_tree_entries"]) == (8, 2330, 80)
    assert named(report, "max_tree_entries_tree", "tree") == "master:d0/d0/d0/d0/d0/d0/d0/d0/d0"
    assert named(report, "max_blob_size_blob", "blob") == "master:d0/d0/d0/d0/d0/d0/d0/d0/d0/f0"
    assert (v["max_path_depth"], v["max_path_length"], v["max_expanded_tree_count"], v["max_expanded_blob_count"], v["max_expanded_blob_size"]) == (8, 23, 11_111_111, 100_000_000, 600_000_000)
    assert named(report, "max_path_depth_tree", "tree") == "master:d0/d0"
    assert v["reference_groups"] == {"ignored": 1}


def test_tags_merges_links_and_submodules(spark, git_repo):
    r = git_repo
    blob, big = r.put("blob", b"x\n"), r.put("blob", b"y" * 5000)
    empty = r.tree()
    sub = r.tree(("100644", "inner.txt", blob))
    tree = r.tree(("100644", "a.txt", blob), ("100644", "big <&>.txt", big), ("40000", "dir", sub), ("40000", "empty", empty), ("120000", "link", blob), ("160000", "mod", "1" * 40))
    first = r.commit(tree, at=1)
    left, right = r.commit(tree, first, at=2), r.commit(sub, first, at=3)
    merge = r.commit(tree, left, right, first, at=4)
    r.ref("refs/heads/main", merge)
    tag = r.tag("tag", merge, "commit")
    bag = r.tag("bag", tag, "tag")
    wag = r.tag("wag", bag, "tag")
    for name, oid in (("tag", tag), ("bag", bag), ("wag", wag)):
        r.ref(f"refs/tags/{name}", oid)
    report, _ = scan_repository(spark, r.path)
    v = report.values
    assert (v["unique_commit_count"], v["max_history_depth"], v["max_parent_count"]) == (4, 3, 3)
    assert (v["unique_tag_count"], v["max_tag_depth"]) == (3, 3)
    assert named(report, "max_tag_depth_tag", "tag") == "refs/tags/wag"
    assert (v["unique_blob_count"], v["max_expanded_blob_count"], v["max_expanded_link_count"], v["max_expanded_submodule_count"]) == (2, 3, 1, 1)
    assert (v["max_path_depth"], v["max_path_length"], v["max_expanded_tree_count"]) == (2, len("dir/inner.txt"), 3)
    assert v["reference_count"] == 4 and v["reference_groups"]["tags"] == 3
    assert "\\u003c\\u0026\\u003e" in report.json_fields()
    bare, _ = scan_repository(spark, r.path, names="hash")
    assert json.loads(bare.json_fields())["max_blob_size_blob"] == big
    assert "[1]" in bare.table(0)
    none, _ = scan_repository(spark, r.path, names="none")
    assert "[1]" not in none.table(0) and "max_commit" not in json.loads(none.json_fields())


def test_command_line(spark, git_repo, capsys):
    r = git_repo
    tree = r.tree(("100644", "a.txt", r.put("blob", b"refs\n")))
    for i, name in enumerate(("refs/heads/main", "refs/heads/foo", "refs/tags/release-1", "refs/pull/1/head", "refs/changes/20/884120/1", "refs/stash", "refs/odd")):
        r.ref(name, r.commit(tree, at=i))
    r.git("config", "refgroup.tags.releases.includeRegexp", "refs/tags/release-.*")
    assert main(["-C", r.path, "--no-progress"], spark) == 0
    assert "No problems above the current threshold were found" in capsys.readouterr().out
    assert main(["-C", r.path, "-v", "--show-refs", "--branches", "--exclude", "/.*foo/"], spark) == 0
    out = capsys.readouterr()
    assert "+ refs/heads/main" in out.err and "  refs/heads/foo" in out.err and "  refs/stash" in out.err
    assert "|   * Count                    |     7     |" in out.out
    assert "|     * Branches               |     1     |" in out.out and "|     * Ignored                |     6     |" in out.out
    assert main(["-C", r.path, "--json", "--json-version", "2"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["uniqueCommitCount"]["value"] == 7 and found["refgroup.tags.releases"]["value"] == 1 and found["refgroup.other"]["value"] == 1
    assert main(["-C", r.path, "--json-version", "3"], spark) == 1
    assert main(["-C", r.path, "--progress"], spark) == 0
    assert capsys.readouterr().err.splitlines()[-6:] == ["Processing blobs: 1", "Processing trees: 1", "Processing commits: 7", "Matching commits to trees: 7", "Processing annotated tags: 0", "Processing references: 7"]


def test_refused_repositories(git_repo, tmp_path):
    with pytest.raises(ValueError):
        Repository.at(str(tmp_path))
    git_repo.ref("refs/heads/main", git_repo.commit(git_repo.tree()))
    Repository.at(git_repo.path)
    with open(f"{git_repo.path}/.git/shallow", "w") as f:
        f.write("")
    with pytest.raises(ValueError, match="shallow"):
        Repository.at(git_repo.path)


def test_options_leave_roots_alone():
    args = parser().parse_intermixed_args(spelled_out(["--branches", "main", "-v", "other", "--no-tags=false", "--include", "refs/x", "--names=sha1"]))
    assert args.roots == ["main", "other"] and args.threshold == 0 and args.names == "hash"
    assert args.rules == [("branches", "true"), ("no-tags", "false"), ("include", "refs/x")]
    assert parser().parse_intermixed_args(spelled_out(["--critical"])).threshold == 30
    assert parser().parse_intermixed_args(spelled_out(["--verbose=false"])).threshold == 1


@pytest.fixture
def pushdown(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_names_pushed_to_git(spark, git_repo, pushdown):
    """ord counts the lines that git lists, so it tells what was read."""
    one = git_repo.commit(git_repo.tree())
    names = ["refs/heads/main", "refs/heads/ma", "refs/heads/mb/x/y", "refs/heads/mb1", "refs/heads/other", "refs/tags/v1", "refs/tags/v2", "refs/tags/w"]
    for name in names:
        git_repo.ref(name, one)
    refs = read(spark, git_repo.path, "refs")
    cases = [
        (refs.refname.startswith("refs/tags/"), ["refs/tags/v1", "refs/tags/v2", "refs/tags/w"]), (refs.refname.startswith("refs/heads/mb"), ["refs/heads/mb/x/y", "refs/heads/mb1"]),
        (refs.refname == "refs/heads/ma", ["refs/heads/ma"]), (refs.refname.isin("refs/tags/w", "refs/heads/main", "refs/none"), ["refs/heads/main", "refs/tags/w"]),
        (refs.refname.startswith("refs/heads/m") & (refs.type == "commit"), [n for n in names if n.startswith("refs/heads/m")]), (refs.refname.startswith("refs/h*"), []),
    ]
    for condition, wanted in cases:
        found = refs.where(condition).orderBy("ord").collect()
        assert [r["refname"] for r in found] == sorted(wanted)
        assert [r["ord"] for r in found] == list(range(len(wanted)))
    assert [r["ord"] for r in refs.where(refs.refname.endswith("2")).collect()] == [names.index("refs/tags/v2")]


def test_names_that_are_not_text(spark, git_repo):
    one = git_repo.commit(git_repo.tree())
    for name in (b"refs/heads/\xff", b"refs/heads/\xfe", "refs/heads/é".encode()):
        with open(git_repo.path.encode() + b"/.git/packed-refs", "ab") as f:
            f.write(one.encode() + b" " + name + b"\n")
    assert {r["refname"] for r in read(spark, git_repo.path, "refs").collect()} == {"refs/heads/\\xff", "refs/heads/\\xfe", "refs/heads/é"}


def test_sub_directory(spark, git_repo):
    file = git_repo.put("blob", b"content\n")
    git_repo.ref("refs/heads/master", git_repo.commit(git_repo.tree(("40000", "subdir", git_repo.tree(("100644", "file.txt", file))))))
    report, _ = scan_repository(spark, git_repo.path)
    assert report.values["max_path_depth"] == 2


def test_submodule(spark, git_repo, tmp_path):
    """A submodule counts where it hangs, and its own repository by itself."""
    inner = type(git_repo)(tmp_path / "inner")
    same = inner.put("blob", b"same\n")
    tip = inner.commit(inner.tree(("100644", "a.txt", same), ("100644", "b.txt", same), ("100644", "c.txt", inner.put("blob", b"other\n"))))
    inner.ref("refs/heads/master", tip)
    tree = git_repo.tree(("100644", ".gitmodules", git_repo.put("blob", b"[submodule]\n")), ("100644", "mainfile.txt", git_repo.put("blob", b"main\n")), ("160000", "sub", tip))
    git_repo.ref("refs/heads/master", git_repo.commit(tree))
    values = [scan_repository(spark, r.path)[0].values for r in (git_repo, inner)]
    assert [(v["unique_blob_count"], v["max_expanded_blob_count"], v["max_expanded_submodule_count"]) for v in values] == [(2, 2, 1), (2, 3, 0)]
