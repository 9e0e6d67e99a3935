"""Names of any number of objects, against those found hop by hop."""

import random

import pytest

from grove.operators import witness
from grove.operators.witness import described, doubled_paths, find_links, named_objects, path


def oid(letter, i):
    return f"{letter}{i}".encode()


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    draw = random.Random(seed)
    entries, order = [], []
    for t in range(30):
        for pos in range(draw.randint(0, 4)):
            kind = draw.choice(["tree", "blob", "link", "submodule"])
            child = oid("t", draw.randrange(t + 1, 31)) if kind == "tree" else oid("b", draw.randrange(12)) if kind != "submodule" else b"sub"
            entries.append((bytearray(oid("t", t)), pos, bytearray(draw.choice([b"name", b"x%d" % pos, b"\xff\xfe", "é".encode()])), bytearray(child), kind))
    places = [*range(31)]
    draw.shuffle(places[20:])
    order = [(bytearray(oid("t", t)), places[t] if draw.random() < 0.9 else 100 - t) for t in range(31)] + [(bytearray(oid("b", i)), 200 + i) for i in range(12)]
    commits = [(bytearray(oid("c", i)), i, bytearray(oid("t", draw.randrange(31)))) for i in range(4)]
    roots = [(0, "refs/heads/a", bytearray(oid("c", 0)), True), (1, "refs/heads/b", bytearray(oid("c", 1)), False), (2, "v1:x", bytearray(oid("t", 2)), True), (3, "refs/tags/t", bytearray(oid("b", 3)), True), (4, "refs/again", bytearray(oid("c", 0)), True)]
    tables = (
        spark.createDataFrame(entries, "tree binary, pos long, name binary, child binary, kind string"), spark.createDataFrame(order, "oid binary, ord long"),
        spark.createDataFrame(commits, "oid binary, ord long, tree binary"), spark.createDataFrame(roots, "ord long, name string, oid binary, walk boolean"),
    )
    objects = [(oid("t", t), "tree") for t in range(31)] + [(oid("b", i), "blob") for i in range(12)] + [(oid("c", i), "commit") for i in range(4)]
    links = find_links({o.hex(): k for o, k in objects}, *tables)
    wanted = {(o, k, path(o.hex(), k, links) or None, described(o.hex(), k, links)) for o, k in objects}
    found = named_objects(spark.createDataFrame([(bytearray(o), k) for o, k in objects], "oid binary, type string"), *tables)
    assert {(bytes(r["oid"]), r["type"], r["path"], r["shown"]) for r in found.collect()} == wanted


def test_deep_paths(spark):
    """A chain of 1000 trees, and many objects below one."""
    chain = [(bytearray(oid("t", i + 1)), bytearray(oid("t", i)), bytearray(b"d%d" % i)) for i in range(1000)] + [(bytearray(oid("b", i)), bytearray(oid("t", 5)), bytearray(b"f%d" % i)) for i in range(3000)]
    found = {bytes(r["oid"]): (bytes(r["top"]), bytes(r["path"]).decode()) for r in doubled_paths(spark.createDataFrame(chain, "oid binary, tree binary, name binary")).collect()}
    assert found[b"t1000"] == (b"t0", "/".join(f"d{i}" for i in range(1000))) and found[b"b2999"] == (b"t0", "d0/d1/d2/d3/d4/f2999") and len(found) == 4000


def test_names_follow_only_what_is_asked(spark, monkeypatch):
    """Blobs that nobody asked for are in none of the tables that naming stores, and what holds nothing in no round of paths."""
    kept, put = {}, witness.stored
    monkeypatch.setattr(witness, "stored", lambda df, name: kept.setdefault(f"{name}-{len(kept)}", put(df, name)))
    entries = [(b"r", 0, b"d", b"d", "tree"), *[(b"d", i, b"f%d" % i, b"b%d" % i, "blob") for i in range(50)], (b"d", 50, b"e", b"e", "tree")]
    entries = spark.createDataFrame([(bytearray(t), pos, bytearray(n), bytearray(c), kind) for t, pos, n, c, kind in entries], "tree binary, pos long, name binary, child binary, kind string")
    order = spark.createDataFrame([(bytearray(o), i) for i, o in enumerate([b"r", b"d", b"e", *[b"b%d" % i for i in range(50)]])], "oid binary, ord long")
    commits = spark.createDataFrame([(bytearray(b"c"), 1, bytearray(b"r"))], "oid binary, ord long, tree binary")
    roots = spark.createDataFrame([(1, "main", bytearray(b"c"), True)], "ord long, name string, oid binary, walk boolean")
    asked = spark.createDataFrame([(bytearray(b"e"), "tree"), (bytearray(b"b7"), "blob")], "oid binary, type string")
    found = {bytes(r["oid"]): r["path"] for r in named_objects(asked, entries, order, commits, roots).collect()}
    assert found == {b"e": "main:d/e", b"b7": "main:d/f7"}
    assert max(t.count() for t in kept.values()) <= 3
    assert all(t.count() <= 1 for name, t in kept.items() if name.startswith("paths-longer"))
