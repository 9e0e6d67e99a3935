from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grove.functions.counters import BINARY, CAP32, CAP64, METRIC, format_counter, format_number, formatted, stars, sum32, sum64
from grove.functions.parsing import batch_header, entries_of, entry_batches, entry_kind, octal, parsed_commits, parsed_tags, parsed_trees, reference_line
from grove.functions.references import config_rest, folded, pattern, prefix
from grove.operators.refgroups import Groups, group_counts


@pytest.mark.parametrize(("n", "shown"), [(0, "0 cd"), (999, "999 cd"), (1000, "1.00 kcd"), (1094, "1.09 kcd"), (1096, "1.10 kcd"), (9999, "10.00 kcd"), (10060, "10.1 kcd"), (99999, "100.0 kcd"), (999999, "1000 kcd"), (10**15, "1.00 Pcd"), (10**18, "1000 Pcd"), (CAP64, "18447 Pcd")])
def test_metric(n, shown):
    assert " ".join(format_number(n, METRIC, "cd")) == shown


@pytest.mark.parametrize(("n", "shown"), [(1023, "1023 B"), (1024, "1.00 KiB"), (1234, "1.21 KiB"), (1048575, "1024 KiB"), (1048576, "1.00 MiB"), (2**60, "1024 PiB"), (CAP64, "16384 PiB")])
def test_binary(n, shown):
    assert " ".join(format_number(n, BINARY, "B")) == shown


def test_counters(spark):
    assert format_counter(CAP32, CAP32, METRIC, "cd") == ("∞", "cd")
    rows = spark.createDataFrame([(1, Decimal(0xF0000000)), (1, Decimal(0xF0000000)), (2, Decimal(0xF0000000)), (3, None)], "k int, x decimal(20,0)")
    found = {r["k"]: (r["narrow"], int(r["wide"])) for r in rows.groupBy("k").agg(sum32(F.col("x")).alias("narrow"), sum64(F.col("x") * 2**32).alias("wide")).collect()}
    assert found == {1: (CAP32, CAP64), 2: (0xF0000000, 0xF0000000 << 32), 3: (0, 0)}
    values = spark.createDataFrame([(30.0, False), (30.5, False), (2.9, False), (0.1, True)], "v double, o boolean")
    assert [r[0] for r in values.select(stars(F.col("v"), F.lit(1.0), F.col("o"))).collect()] == ["*" * 30, "!" * 30, "**", "!" * 30]
    shown = spark.createDataFrame([(1125,), (None,)], "n long").select(formatted(F.col("n"), "metric", "B").alias("s")).collect()
    assert [r["s"] for r in shown] == ["1.12 kB", None]


# Selections and what they take.
PREFIXES = [
    ("refs/heads", "refs/heads/master", True), ("refs/heads", "refs/he", False), ("refs/heads", "refs/headstrong", False), ("refs/heads", "refs/tags/refs/heads", False), ("refs/foo", "refs/foo", True),
    ("refs/foo/", "refs/foo/bar", True), ("refs/foo/", "refs/foo", False), ("refs/foo/", "refs/foobar", False), ("refs/stash", "refs/stash", True), ("", "anything", True),
]
PATTERNS = [
    ("refs/heads/.*", "refs/heads/master", True), (".*/heads/", "refs/heads/master", False), ("heads/.*", "refs/heads/master", False),
    (r"refs/tags/release-\d+\.\d+\.\d+", "refs/tags/release-1.22.333", True), (r"refs/tags/release-\d+\.\d+\.\d+", "refs/tags/release-1.2.3rc1", False), ("refs/a|b", "refs/axx", True), ("refs/a|b", "xxb", True),
]


def test_filters(spark):
    for make, cases in ((prefix, PREFIXES), (pattern, PATTERNS)):
        for what, name, wanted in cases:
            assert spark.range(1).select(F.lit(name).alias("n")).select(make(what)(F.col("n"))).first()[0] is wanted, (what, name)
    for bad in ("a(?=b)", r"(a)\1", "a++", "("):
        with pytest.raises(ValueError):
            pattern(bad)


def test_rules_in_order(spark):
    names = ["refs/heads/foo", "refs/heads/master", "refs/remotes/foo/x", "refs/remotes/bar/x", "refs/tags/v1", "refs/stash", "refs/stashed"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")

    def chosen(*rules):
        rule = folded(rules, Groups().filter_of)
        return {r["n"] for r in frame.where(rule(F.col("n"))).collect()}

    assert chosen(("include", "refs/heads"), ("exclude", "/refs/heads/.*foo.*/"), ("include", "refs/remotes"), ("exclude", "refs/remotes/foo")) == {"refs/heads/master", "refs/remotes/bar/x"}
    assert chosen(("no-branches", "true")) == set(names) - {"refs/heads/foo", "refs/heads/master"}
    assert chosen(("branches", "false")) == chosen(("no-branches", "true"))
    assert chosen(("stash", "true")) == {"refs/stash"}
    assert chosen(("include", "@tags"), ("include-regexp", ".*/x")) == {"refs/tags/v1", "refs/remotes/foo/x", "refs/remotes/bar/x"}
    with pytest.raises(ValueError):
        chosen(("include", "@nowhere"))


CONFIG = [("foo.bar", "", "foo.bar"), ("foo.bar", "foo", "bar"), ("foo.bar", "foo.", "bar"), ("foo.bar", "foo.bar", ""), ("foo.bar", "foo.bar.", None), ("foo.bar", "foo.bar.baz", None), ("foo.bar.baz", "foo.bar", "baz"), ("foo.barbaz", "foo.bar", None), ("foo.bar", "bar", None)]


def test_config_keys(spark):
    for key, section, rest in CONFIG:
        assert spark.range(1).select(F.lit(key).alias("k")).select(config_rest(F.col("k"), section)).first()[0] == rest, (key, section)


REFS = """refs/changes/20/884120/1 refs/changes/45/12345/42 refs/fo refs/foo refs/heads/foo refs/heads/main refs/notes/discussion refs/notes/tests/build refs/notes/tests/default refs/pull/1/head refs/pull/1/merge
refs/pull/123/head refs/pull/1234/head refs/remotes/origin/master refs/remotes/upstream/foo refs/remotes/upstream/master refs/stash refs/tags/foolish refs/tags/other refs/tags/release-1 refs/tags/release-2""".split()
NESTED = [("misc.foo.includeRegexp", ".*foo.*"), ("misc.foo.oatend.includeRegexp", ".*o"), ("misc.foo.bogus.include", "bogus"), ("tags.releases.name", "Releases"), ("tags.releases.includeRegexp", "refs/tags/release-.*")]


def counted(spark, config=(), rules=()):
    groups = Groups(list(config)).finish(list(rules))
    frame = groups.categorized(spark.createDataFrame([(r,) for r in REFS], "refname string"))
    return {r["symbol"]: r["n"] for r in group_counts(frame).collect()}


def test_groups(spark):
    assert counted(spark) == {"": 21, "branches": 2, "tags": 4, "remotes": 3, "pulls": 4, "changes": 2, "notes": 3, "stash": 1, "other": 2}
    found = counted(spark, NESTED)
    assert {k: found.get(k) for k in ("tags", "tags.releases", "tags.other", "misc", "misc.foo", "misc.foo.oatend", "misc.foo.other", "misc.foo.bogus", "other")} == {
        "tags": 4, "tags.releases": 2, "tags.other": 2, "misc": 4, "misc.foo": 4, "misc.foo.oatend": 3, "misc.foo.other": 1, "misc.foo.bogus": None, "other": 1,
    }
    config = [*NESTED, ("oatend.includeRegexp", ".*o")]
    found = counted(spark, config, [("include", "@branches"), ("include", "@tags.releases"), ("include", "@oatend")])
    assert (found["branches"], found["tags"], found["tags.releases"], found["remotes"], found["oatend"], found["ignored"]) == (2, 2, 2, 1, 4, 14)
    found = counted(spark, (), [("exclude", "@stash"), ("exclude", "@notes")])
    assert (found["branches"], found["tags"], found["remotes"], found["pulls"], found["changes"], found["other"], found["ignored"]) == (2, 4, 3, 4, 2, 2, 4)
    order = [s for s, _ in Groups(NESTED).finish().order]
    assert order.index("tags.releases") == order.index("tags") + 1 and order.index("tags.other") == order.index("tags") + 2 and order[-2:] == ["other", "ignored"]
    with pytest.raises(ValueError):
        Groups([("lonely.name", "x")]).finish()


def failing(frame):
    with pytest.raises(Exception):  # noqa: B017, PT011
        frame.collect()


def test_parsers_fail_closed(spark):
    line = lambda text: spark.createDataFrame([(text,)], "s string")
    oid = "ab" * 20
    assert line(f"{oid} commit 12 refs/heads/x").select(reference_line(F.col("s")).alias("r")).select("r.*").first()["size"] == 12
    for bad in (f"{oid} commit 12", f"{oid} commit 4294967296 refs/x", "ab commit 12 refs/x", f"{oid} commit 12 refs/x y"):
        failing(line(bad).select(reference_line(F.col("s"))))
    assert line(f"{oid} blob 99999999999").select(batch_header(F.col("s")).alias("h")).select("h.size").first()[0] == CAP32
    for bad in (f"{oid} missing", f"{oid} blob"):
        failing(line(bad).select(batch_header(F.col("s"))))
    data = lambda text: spark.createDataFrame([(bytearray(text.encode()),)], "data binary")
    good = parsed_commits(data(f"tree {oid}\nparent {oid}\nparent {'cd' * 20}\ngpgsig a\n tree b\n\ntree x\n")).first()
    assert [bytes(p).hex() for p in good["parents"]] == [oid, "cd" * 20]
    for bad in ("", "tree", f"tree {oid}\ntree {oid}\n\n", "author x\n\n", "tree abc\n\n", f"tree {oid}\nnonsense\n\n"):
        failing(parsed_commits(data(bad)).select("tree", "parents"))
    for bad in (f"object {oid}\n\n", "type tag\n\n", f"object {oid}\nobject {oid}\ntype tag\n\n"):
        failing(parsed_tags(data(bad)).select("referent", "referent_type"))
    for bad in (b"100644", b"100644 a", b"100644 a\0short", b" a\0" + b"x" * 20, b"9 a\0" + b"x" * 20):
        with pytest.raises(ValueError):
            list(entries_of(bad))
    raw = b"100644 \xff\0" + b"x" * 20 + b"160000 m\0" + b"y" * 20
    rows = parsed_trees(spark.createDataFrame([(bytearray(b"t"), bytearray(raw)), (bytearray(b"e"), bytearray())], "oid binary, data binary")).collect()
    assert [(bytes(r["name"]), r["kind"]) for r in rows] == [(b"\xff", "blob"), (b"m", "submodule")]
    kinds = spark.createDataFrame([("40000",), ("100755",), ("120000",), ("160000",)], "m string").select(entry_kind(octal(F.col("m")))).collect()
    assert [r[0] for r in kinds] == ["tree", "blob", "link", "submodule"]


def test_entries_in_batches():
    """Small trees share a batch, a large one is cut."""
    entry = b"100644 a\0" + b"x" * 20
    made = pa.RecordBatch.from_arrays([pa.array([b"%d" % i for i in range(5001)]), pa.array([entry * 2] * 5000 + [entry * 10_000])], names=["oid", "data"])
    found = list(entry_batches(iter([made.slice(0, 2500), made.slice(2500)])))
    assert [b.num_rows for b in found] == [8192, 8192, 3616]
    rows = pa.Table.from_batches(found).to_pylist()
    assert [(int(r["tree"]), r["pos"]) for r in rows] == [(i, k) for i in range(5001) for k in range(2 if i < 5000 else 10_000)]
    assert {(r["mode"], r["name"], r["child"]) for r in rows} == {(0o100644, b"a", b"x" * 20)}
