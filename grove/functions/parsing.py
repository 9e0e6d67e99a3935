"""Parsers of reference lines, object headers and object contents; all fail closed.

Headers and lines are parsed by column expressions. Only the binary list of a
tree's entries needs Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counters import CAP32, WIDE, clamp32

#: File-mode bits: fixed values of the tree format.
TYPE_MASK, TREE_MODE, LINK_MODE, SUBMODULE_MODE = 0o170000, 0o040000, 0o120000, 0o160000

#: Entries of trees, small or large, that are handed on together.
BATCH = 1 << 13


def checked(ok: Column, value: Column, message: Column | str) -> Column:
    """value where ok holds, else an error when it is read."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message) if isinstance(message, str) else message).cast("string"))


def oid_bytes(text: Column) -> Column:
    """20 bytes from 40 hexadecimal digits."""
    return F.unhex(checked(F.coalesce(text.rlike("^[0-9a-fA-F]{40}$"), F.lit(False)), text, F.concat(F.lit("bad object id: "), F.coalesce(text, F.lit("null")))))


def oid_text(oid: Column) -> Column:
    return F.lower(F.hex(oid))


def reference_line(line: Column) -> Column:
    """struct(oid, type, size, refname) of "oid type size name": exactly four words, and a size of 32 bits."""
    words = F.split(line, " ", -1)
    four = checked(F.size(words) == 4, line, F.concat(F.lit("line improperly formatted: "), line))
    words = F.split(four, " ", -1)
    size = checked(words[2].rlike("^[0-9]{1,10}$"), words[2], F.concat(F.lit("bad object size: "), words[2])).cast("bigint")
    size = checked(size <= CAP32, size.cast("string"), F.concat(F.lit("object size over 32 bits: "), size.cast("string"))).cast("bigint")
    return F.struct(oid_bytes(words[0]).alias("oid"), words[1].alias("type"), size.alias("size"), words[3].alias("refname"))


def batch_header(line: Column) -> Column:
    """struct(oid, type, size) of "oid type size"; a missing object is an error, and the size is capped."""
    words = F.split(line, " ", -1)
    there = checked(F.element_at(words, -1) != "missing", line, F.concat(F.lit("missing object: "), line))
    words = F.split(checked(F.size(F.split(there, " ", -1)) == 3, there, F.concat(F.lit("invalid header: "), line)), " ", -1)
    return F.struct(oid_bytes(words[0]).alias("oid"), words[1].alias("type"), clamp32(words[2].cast(WIDE)).alias("size"))


def header_lines(data: Column) -> Column:
    """array(struct(key, value)) of an object's header block, which ends at the first empty line; lines that go on have an empty key."""
    text = F.decode(data, "ISO-8859-1")
    block = F.substring_index(text, "\n\n", 1)
    whole = checked((F.length(text) > 0) & (text.contains("\n\n") | text.endswith("\n")), F.regexp_replace(block, "\n$", ""), "header has no end")
    return F.transform(
        F.split(whole, "\n", -1),
        lambda line: F.struct(
            F.substring_index(checked(line.contains(" "), line, F.concat(F.lit("malformed header line: "), line)), " ", 1).alias("key"),
            F.substring(line, F.instr(line, " ") + 1, F.length(line)).alias("value"),
        ),
    )


def values_of(headers: Column, key: str) -> Column:
    return F.transform(F.filter(headers, lambda h: h["key"] == key), lambda h: h["value"])


def only(values: Column, what: str) -> Column:
    return checked(F.size(values) == 1, F.element_at(values, 1), F.concat(F.lit(f"expected exactly one {what}, found "), F.size(values).cast("string")))


def parsed_commits(raw: DataFrame) -> DataFrame:
    """oid, size, tree, parents in order, and what else raw has but its data: any number of parents, exactly one tree."""
    headers = raw.withColumn("_h", header_lines(F.col("data")))
    parents = F.transform(values_of(F.col("_h"), "parent"), oid_bytes)
    return headers.withColumn("size", F.octet_length("data").cast("bigint")).withColumn("tree", oid_bytes(only(values_of(F.col("_h"), "tree"), "tree"))).withColumn("parents", parents).drop("_h", "data")


def parsed_tags(raw: DataFrame) -> DataFrame:
    """oid, size, referent, referent_type: exactly one object and one type."""
    headers = raw.withColumn("_h", header_lines(F.col("data")))
    return headers.withColumn("size", F.octet_length("data").cast("bigint")).withColumn("referent", oid_bytes(only(values_of(F.col("_h"), "object"), "object"))).withColumn("referent_type", only(values_of(F.col("_h"), "type"), "type")).drop("_h", "data")


def entries_of(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(mode, name, child) of "<octal mode> <name>\\0<20 bytes>", repeated."""
    at = 0
    while at < len(data):
        blank = data.find(b" ", at)
        end = data.find(b"\0", blank + 1) if blank >= 0 else -1
        if blank <= at or end < 0:
            raise ValueError("malformed tree: entry without mode or name")
        if end + 21 > len(data):
            raise ValueError("malformed tree: object id cut short")
        yield int(data[at:blank], 8), data[blank + 1 : end], data[end + 1 : end + 21]
        at = end + 21


def entry_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, pos, mode, name, child) of every entry of the trees (oid, data), in batches of BATCH whatever a tree's size."""
    types = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    trees, places, modes, names, children = columns = [], [], [], [], []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, types)], names=["tree", "pos", "mode", "name", "child"])
        for x in columns:
            x.clear()
        return made

    for b in batches:
        for oid, data in zip(b.column(0).to_pylist(), b.column(1)):
            for i, (mode, name, child) in enumerate(entries_of(data.as_py())):
                trees.append(oid)
                places.append(i)
                modes.append(mode)
                names.append(name)
                children.append(child)
                if len(trees) == BATCH:
                    yield batch()
    if trees:
        yield batch()


def parsed_trees(raw: DataFrame) -> DataFrame:
    """(tree, pos, mode, name, child, kind) of every entry of the trees (oid, data)."""
    entries = raw.select("oid", "data").mapInArrow(entry_batches, "tree binary, pos int, mode long, name binary, child binary")
    return entries.withColumn("kind", entry_kind(F.col("mode")))


def octal(mode: Column) -> Column:
    return F.conv(mode, 8, 10).cast("bigint")


def entry_kind(mode: Column) -> Column:
    """tree, submodule, link, or else blob."""
    kind = mode.cast("bigint").bitwiseAND(F.lit(TYPE_MASK).cast("bigint"))
    return F.when(kind == TREE_MODE, "tree").when(kind == SUBMODULE_MODE, "submodule").when(kind == LINK_MODE, "link").otherwise("blob")
