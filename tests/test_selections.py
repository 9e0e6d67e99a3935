"""Selections of references and their groups."""

import re

import pytest

from grove.functions.references import folded
from grove.operators.refgroups import Groups, group_counts

# Names of references, options, and how many references each selection takes or each group counts.
SELECTED = (
    "refs/barfoo refs/foo refs/foobar refs/heads/foo refs/heads/master refs/notes/discussion refs/remotes/origin/master refs/remotes/upstream/foo refs/remotes/upstream/master refs/stash "
    "refs/tags/foolish refs/tags/other refs/tags/release-1 refs/tags/release-2"
).split()
COMBINED = [("include", "refs/heads"), ("tags", ""), ("exclude", "refs/heads/foo"), ("include", "/.*foo.*/"), ("exclude", "refs/foo"), ("exclude", "/refs/tags/release-.*/")]
CASES = [
    ([], 14), ([("branches", "")], 2), ([("no-branches", "")], 12), ([("tags", "")], 4), ([("no-tags", "")], 10), ([("remotes", "")], 3), ([("no-remotes", "")], 11), ([("notes", "")], 1), ([("no-notes", "")], 13),
    ([("stash", "")], 1), ([("no-stash", "")], 13), ([("branches", ""), ("tags", "")], 6), ([("include", "/.*foo.*/")], 6), ([("include", "refs/foo")], 1), ([("include", "/refs/foo/")], 1),
    ([("include", "/refs/tags/release-.*/")], 2), (COMBINED, 7),
]
GROUPED = (
    "refs/changes/20/884120/1 refs/changes/45/12345/42 refs/fo refs/foo refs/heads/foo refs/heads/main refs/notes/discussion refs/notes/tests/build refs/notes/tests/default refs/pull/1/head refs/pull/1/merge "
    "refs/pull/123/head refs/pull/1234/head refs/remotes/origin/master refs/remotes/upstream/foo refs/remotes/upstream/master refs/stash refs/tags/foolish refs/tags/other refs/tags/release-1 refs/tags/release-2"
).split()
RELEASES = [("tags.releases.name", "Releases"), ("tags.releases.includeRegexp", "refs/tags/release-.*")]
CONFIGURED = [
    ([], [], {"": 21, "branches": 2, "tags": 4, "remotes": 3, "pulls": 4, "changes": 2, "notes": 3, "stash": 1, "other": 2}),
    (
        [("misc.foo.includeRegexp", ".*foo.*"), ("misc.foo.oatend.includeRegexp", ".*o"), ("misc.foo.bogus.include", "bogus"), *RELEASES],
        [],
        {"": 21, "branches": 2, "tags": 4, "tags.releases": 2, "tags.other": 2, "remotes": 3, "pulls": 4, "changes": 2, "notes": 3, "stash": 1, "misc": 4, "misc.foo": 4, "misc.foo.oatend": 3, "misc.foo.other": 1, "other": 1},
    ),
    (
        [("oatend.includeRegexp", ".*o"), *RELEASES],
        [("include", "@branches"), ("include", "@tags.releases"), ("include", "@oatend")],
        {"": 7, "branches": 2, "tags": 2, "tags.releases": 2, "remotes": 1, "oatend": 4, "ignored": 14},
    ),
    ([], [("exclude", "@stash"), ("exclude", "@notes")], {"": 17, "branches": 2, "tags": 4, "remotes": 3, "pulls": 4, "changes": 2, "other": 2, "ignored": 4}),
]
FLAG_PREFIX = {"branches": "refs/heads/", "tags": "refs/tags/", "remotes": "refs/remotes/", "notes": "refs/notes/"}


def brute(rules, name):
    """The last rule that matches decides; without one, the opposite of the first rule."""
    taken = bool(not rules or rules[0][0].startswith(("no-", "exclude")))
    for option, value in rules:
        flag = option.removeprefix("no-")
        if value.startswith("/"):
            hit = re.fullmatch(value[1:-1], name)
        elif flag == "stash":
            hit = name == "refs/stash"
        else:
            wanted = FLAG_PREFIX.get(flag, value)
            hit = name == wanted or name.startswith(wanted.rstrip("/") + "/")
        if hit:
            taken = not option.startswith(("no-", "exclude"))
    return taken


def refs(spark, names):
    return spark.createDataFrame([(n,) for n in names], "refname string")


def test_selections(spark):
    found = refs(spark, SELECTED)
    for i, (rules, n) in enumerate(CASES):
        taken = {r["refname"] for r in Groups().finish(rules).categorized(found).where("walk").collect()}
        assert taken == {x for x in SELECTED if brute(rules, x)} and len(taken) == n, i


@pytest.mark.parametrize(
    ("config", "n"),
    [
        ([("mygroup.include", "refs/heads")], 2),
        ([("mygroup.include", "refs/heads"), ("mygroup.include", "refs/tags"), ("mygroup.exclude", "refs/heads/foo"), ("mygroup.includeRegexp", ".*foo.*"), ("mygroup.exclude", "refs/foo"), ("mygroup.excludeRegexp", "refs/tags/release-.*")], 7),
    ],
)
def test_selection_by_a_group_of_ones_own(spark, config, n):
    taken = {r["refname"] for r in Groups(config).finish([("include", "@mygroup")]).categorized(refs(spark, SELECTED)).where("walk").collect()}
    same = COMBINED if n == 7 else [("include", "refs/heads")]
    assert taken == {x for x in SELECTED if brute(same, x)} and len(taken) == n


@pytest.mark.parametrize(("config", "options", "counts"), CONFIGURED)
def test_groups_count(spark, config, options, counts):
    categorized = Groups(config).finish(options).categorized(refs(spark, GROUPED))
    assert {r["symbol"]: r["n"] for r in group_counts(categorized).collect()} == counts
    assert folded(options, Groups(config).filter_of) is None or categorized.where("walk").count() == counts[""]


def test_expression_grows_with_groups_not_with_nesting(spark):
    """Eight levels deep, and still compiled."""
    sizes = []
    for depth in (2, 4, 8):
        config = [(f"{'.'.join('abcdefgh'[:i])}.includeRegexp", f".*{'abcdefgh'[i - 1]}.*") for i in range(1, depth + 1)]
        found = Groups(config).finish().categorized(refs(spark, ["refs/abcdefgh", "refs/ab", "refs/x"]))
        sizes.append(len(found._jdf.queryExecution().analyzed().toString()))
        below = {r["refname"]: r["groups"] for r in found.collect()}
        assert below["refs/abcdefgh"] == ["", *(".".join("abcdefgh"[:i]) for i in range(1, depth + 1))]
        assert below["refs/ab"] == (["", "a", "a.b"] if depth == 2 else ["", "a", "a.b", "a.b.other"]) and below["refs/x"] == ["", "other"]
    assert sizes[2] < 4 * sizes[0]
