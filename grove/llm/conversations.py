"""A trie of the prefixes that conversations share, by radix partitioning from the first turn on.

Turns become numbers of a dictionary. A bucket is a node and the
conversations that go on below it. A round skips what all of a bucket's
conversations have in common, then deals them by their next turn; buckets
with few turns left are sorted by multikey quicksort in one task each, and
what only one conversation has is written out from its length. Sums over
subtrees go up through the rounds in reverse. A node is known by its depth
and its smallest conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.operators.joins import join_one

from .common import SPACE_WORD, numbered, stored

#: Turns of a row of the table that rounds read.
CHUNK = 64

#: Most turns below a bucket's node for one task to finish the bucket.
LOCAL_TURNS = 2048

#: Places of a conversation that are dealt to tasks together.
BLOCK = 1024

#: Ids that are joined to one text before their hash is taken.
JOINED = 4096

NOTHING = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, tokens): every turn's place in its conversation, its number in the dictionary of (role, text) and its words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    words = F.regexp_count(text, F.lit(SPACE_WORD)).cast("long")
    turns = stored(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), words.alias("tokens")), "trie-turns")
    dictionary = stored(turns.groupBy("key").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    placed = numbered(turns, [F.asc_nulls_first("turn"), F.asc("key")], "conv_id", "trie-ranges").select("conv_id", F.col("number").alias("pos"), "key", "tokens")
    return stored(join_one(placed, dictionary, ["key"], "n", turns.count(), ["conv_id", "pos"]).select("conv_id", "pos", "id", "tokens"), "trie-encoded")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, pos, id, tokens) once the first turns are those of the first conversation of each twenty.

    The first h (0 to 3, by the id's CRC) turns of conversation c come from
    c - c % 20, the others are its own, moved up where that has fewer than h.
    """
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % 4
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = own.select("conv_id", "n", head(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    own = own.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    own = own.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = stored(own.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-lengths")
    moved = own.where("taken < h and n > h").select("conv_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK))).alias("block"), (F.col("h") - F.col("taken")).alias("up"))
    kept = turns.where(F.col("pos") >= head(F.col("conv_id"))).withColumn("block", F.floor(F.col("pos") / BLOCK))
    kept = kept.join(moved, ["conv_id", "block"], "left").select("conv_id", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("pos"), "id", "tokens")
    first = turns.where("pos < 3 and conv_id % 20 = 0").withColumnRenamed("conv_id", "base")
    first = own.where("taken > 0").join(first, "base").where("pos < taken").select("conv_id", "pos", "id", "tokens")
    return own.select("conv_id", "length"), kept.unionByName(first)


def common(low: str, high: str) -> Column:
    """How many first elements two arrays share."""
    differ = F.array_position(F.zip_with(low, high, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ == 0, F.size(low)).otherwise(differ - 1).cast("long")


def open_buckets(pending: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A round's rows and buckets.

    pending (conv_id, length, bucket, depth): conversations below a bucket's
    node, which all go on after depth. Buckets get `skip`, the turns that all
    their conversations have next, as far as one chunk goes, `conv` and n, the
    smallest conversation and the number of those that go on, and `end`, the
    depth after what is skipped, whose node is `conv` or still the bucket's.
    """
    at = chunks.select("conv_id", "chunk", "ids", "tokens")
    rows = pending.withColumn("chunk", F.floor(F.col("depth") / CHUNK)).join(at, ["conv_id", "chunk"])
    rest = lambda c: F.slice(c, (F.col("depth") % CHUNK + 1).cast("int"), CHUNK).alias(c)
    rows = stored(rows.select("conv_id", "length", "bucket", "depth", rest("ids"), rest("tokens")), "trie-rows")
    buckets = rows.groupBy("bucket", "depth").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.min(F.struct("ids", "tokens")).alias("low"), F.max("ids").alias("high"))
    buckets = buckets.withColumn("skip", common("low.ids", "high"))
    buckets = buckets.withColumn("end", F.col("depth") + F.col("skip")).withColumn("tokens", F.slice("low.tokens", 1, F.col("skip").cast("int")))
    buckets = buckets.withColumn("node", F.when(F.col("skip") > 0, F.col("conv")).otherwise(F.col("bucket")))
    return rows, stored(buckets.select("bucket", "depth", "n", "conv", "skip", "end", "tokens", "node"), "trie-buckets")


def deal(rows: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Children (bucket, turn, tokens, conv, parent, depth, n, length, rest) of a round's buckets, the rows (conv_id, length, bucket, depth) below them, and the ends (conv, depth, conv_id).

    Rows below a child that is one conversation's alone aren't listed. A
    bucket whose conversations share a whole chunk goes on as a bucket itself.
    """
    total = buckets.agg(F.sum("n")).first()[0]
    rows = join_one(rows, buckets.select("bucket", "n", "skip", "end", "node"), ["bucket"], "n", total, ["conv_id"])
    turn, tokens = (F.get(c, F.col("skip").cast("int")) for c in ("ids", "tokens"))
    rows = stored(rows.select("conv_id", "length", "bucket", "end", "skip", "node", turn.alias("turn"), tokens.alias("tokens")), "trie-dealt")
    ends = rows.where("length = end and skip > 0").select(F.col("node").alias("conv"), F.col("end").alias("depth"), "conv_id")
    through = rows.where("length > end and turn is null").select("conv_id", "length", F.col("node").alias("bucket"), F.col("end").alias("depth"))
    dealt = rows.where("turn is not null")
    children = dealt.groupBy("bucket", "turn").agg(
        F.first("tokens").alias("tokens"), F.min("conv_id").alias("conv"), F.first("node").alias("parent"), F.first(F.col("end") + 1).alias("depth"), F.count("*").alias("n"), F.max("length").alias("length"), F.sum(F.col("length") - F.col("end") - 1).alias("rest")
    )
    children = stored(children, "trie-children")
    shared = children.where("n > 1").select("bucket", "turn", "n", "conv", "depth", "rest")
    below = stored(join_one(dealt.select("conv_id", "length", "bucket", "turn"), shared, ["bucket", "turn"], "n", total, ["conv_id"]).where("conv is not null"), "trie-below")
    ends = ends.unionByName(below.where("length = depth").select("conv", "depth", "conv_id"))
    below = below.where("length > depth").select("conv_id", "length", F.col("conv").alias("bucket"), "depth", "rest")
    return children, below.unionByName(through.withColumn("rest", F.lit(None).cast("long"))), ends


class Sorted:
    """The nodes below one bucket, found by multikey quicksort of its conversations."""

    def __init__(self, depth: int, convs: list[tuple[int, list[int], list[int]]]) -> None:
        self.nodes: list[list] = []  # [parent's place, depth, conv, n, own saved tokens, ends]
        todo = [(convs, 0, -1)]
        while todo:
            group, at, parent = todo.pop()
            pivot = group[len(group) // 2][1][at]
            less, same, more = [], [], []
            for conv in group:
                turn = conv[1][at]
                (same if turn == pivot else less if turn < pivot else more).append(conv)
            todo += [(part, at, parent) for part in (less, more) if part]
            place, on = len(self.nodes), [c for c in same if len(c[1]) > at + 1]
            self.nodes.append([parent, depth + at + 1, min(c[0] for c in same), len(same), (len(same) - 1) * same[0][2][at], sorted(c[0] for c in same if len(c[1]) == at + 1)])
            if on:
                todo.append((on, at + 1, place))

    def rows(self, bucket: int, depth: int) -> Iterator[tuple]:
        """A NODE row for each node; last the bucket's own children, leaves and saved tokens, with n_convs null."""
        sums = [[0, 0, own] for *_, own, _ in self.nodes]
        top = [0, 0, 0]
        for place in range(len(self.nodes) - 1, -1, -1):
            parent, (children, leaves, saved) = self.nodes[place][0], sums[place]
            sums[place][1] = leaves = leaves or 1
            above = top if parent < 0 else sums[parent]
            above[0] += 1
            above[1] += leaves
            above[2] += saved
        for (parent, at, conv, n, _, ends), (children, leaves, saved) in zip(self.nodes, sums, strict=True):
            yield conv, at, bucket if parent < 0 else self.nodes[parent][2], n, children, leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        yield bucket, depth, None, None, *top, None


def sort_buckets(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """NODE rows below the buckets of members (conv_id, length, bucket, depth), and for each bucket one of its sums, with n_convs null."""
    rows = members.join(chunks, "conv_id").where(F.col("chunk") >= F.floor(F.col("depth") / CHUNK)).select("bucket", "depth", "conv_id", "chunk", "ids", "tokens")

    def sort(table: pa.Table) -> pa.Table:
        bucket, depth = table["bucket"][0].as_py(), table["depth"][0].as_py()
        convs: dict[int, list] = {}
        for conv, chunk, ids, tokens in sorted(zip(*(table[c].to_pylist() for c in ("conv_id", "chunk", "ids", "tokens")), strict=True)):
            skip = max(0, depth - chunk * CHUNK)
            own = convs.setdefault(conv, (conv, [], []))
            own[1].extend(ids[skip:])
            own[2].extend(tokens[skip:])
        made = list(zip(*Sorted(depth, list(convs.values())).rows(bucket, depth), strict=True))
        return pa.table([pa.array(c, pa.string() if i == len(made) - 1 else pa.int64()) for i, c in enumerate(made)], names=[c.split()[0] for c in NODE.split(", ")])

    return rows.groupBy("bucket").applyInArrow(sort, NODE)


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) from ends (conv, depth, conv_id).

    Ids are sorted in ranges and joined to texts of some thousands, so that a
    node where very many end costs the task that hashes them a few rows.
    """
    keys = ["conv", "depth"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, made = None, [], []

        def full() -> list:
            return [(*node, ids[0], ",".join(map(str, ids)))] if ids else []

        for b in batches:
            for conv, depth, conv_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node != (conv, depth) or len(ids) >= JOINED:
                    made += full()
                    node, ids = (conv, depth), []
                ids.append(conv_id)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=[*keys, "first", "ids"])
                made = []
        if last := full():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*last, strict=True)], names=[*keys, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, made = None, None, []
        for b in batches:
            for conv, depth, _, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node != (conv, depth):
                    made += [(*node, state.hexdigest())] if node else []
                    node, state = (conv, depth), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=[*keys, "ends_sha256"])
                made = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], names=[*keys, "ends_sha256"])

    order = [*keys, "conv_id"]
    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "conv long, depth long, first long, ids string")
    return texts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, "conv long, depth long, ends_sha256 string")


def lone_nodes(children: DataFrame) -> DataFrame:
    """NODE rows of the children that are one conversation's alone, and of all below them."""
    blocks = children.where("n = 1").select("conv", "parent", "depth", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - F.col("depth")) / BLOCK))).alias("block"))
    first = F.col("depth") + F.col("block") * BLOCK
    at = blocks.repartition("conv", "block").withColumn("at", F.explode(F.sequence(first, F.least(first + BLOCK - 1, "length"))))
    one, last = F.lit(1).cast("long"), F.col("at") == F.col("length")
    return at.select(
        F.col("conv").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )


def summed(buckets: DataFrame, children: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that a round made and that several conversations share, and the sums (conv, depth, n_children, n_leaves, saved_tokens) of its buckets' nodes, from the sums of the buckets that came out of it."""
    own = children.join(below, ["conv", "depth"], "left")
    own = own.withColumn("n_leaves", F.coalesce("n_leaves", F.lit(1))).withColumn("saved_tokens", F.coalesce("saved_tokens", F.lit(0)) + (F.col("n") - 1) * F.col("tokens"))
    own = own.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    sums = own.groupBy("bucket").agg(F.count("*").alias("dealt"), F.sum("n_leaves").alias("dealt_leaves"), F.sum("saved_tokens").alias("dealt_saved"))
    # A bucket that shares a whole chunk has no children but goes on from its last node.
    on = below.select(F.col("conv").alias("node"), F.col("depth").alias("end"), F.col("n_children").alias("on"), F.col("n_leaves").alias("on_leaves"), F.col("saved_tokens").alias("on_saved"))
    ends = buckets.join(sums, "bucket", "left").join(on, ["node", "end"], "left")
    ends = ends.select(
        *buckets.columns, F.coalesce("dealt", F.col("on"), F.lit(0)).alias("end_children"), F.coalesce("dealt_leaves", F.col("on_leaves"), F.lit(1)).alias("leaves"), F.coalesce("dealt_saved", F.col("on_saved"), F.lit(0)).alias("end_saved")
    )
    at = F.col("step")
    steps = ends.where("skip > 0").withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.col("skip"))))
    left = F.aggregate(F.slice("tokens", at.cast("int"), CHUNK), F.lit(0).cast("long"), lambda a, x: a + x)
    chain = steps.select(
        "conv", (F.col("depth") + at).alias("depth"), F.when(at == 1, F.col("bucket")).otherwise(F.col("conv")).alias("parent"), "n", F.when(at < F.col("skip"), 1).otherwise(F.col("end_children")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("end_saved") + (F.col("n") - 1) * left).alias("saved_tokens"),
    )
    whole = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    top = ends.select(
        F.col("bucket").alias("conv"), "depth", F.when(F.col("skip") > 0, 1).otherwise(F.col("end_children")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("end_saved") + (F.col("n") - 1) * whole).alias("saved_tokens")
    )
    cols = ["conv", "depth", "parent", "n", "n_children", "n_leaves", "saved_tokens"]
    return stored(own.where("n > 1").select(*cols).unionByName(chain.select(*cols)), "trie-nodes"), stored(top, "trie-sums")


def prefix_trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """A NODE row for each distinct sequence of first turns of the rebuilt conversations (conv_id, turn, role, text).

    Turns go by turn, null first, and equal ones by a hash of role and text;
    a null role or text is empty. Rows without a conv_id belong to no
    conversation and are left out, as are other columns. Repeated rows are
    turns of their own. No conversations give no nodes. conv_id is a whole
    number. A bucket goes to one task once local_turns or fewer turns are left
    below it.
    """
    turns = encoded(conversations)
    lengths, all_turns = rebuilt(turns)
    chunks = all_turns.groupBy("conv_id", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "tokens"))).alias("x"))
    chunks = stored(chunks.select("conv_id", "chunk", F.col("x.id").alias("ids"), F.col("x.tokens").alias("tokens")), "trie-chunks")
    count, root = lengths.agg(F.count("*"), F.min("conv_id")).first()
    none = lengths.where("length = 0").select(F.lit(root).cast("long").alias("conv"), F.lit(0).cast("long").alias("depth"), "conv_id")
    pending = stored(lengths.where("length > 0").select("conv_id", "length", F.lit(root).cast("long").alias("bucket"), F.lit(0).cast("long").alias("depth")), "trie-pending")
    rounds, local, ends = [], [], [none]
    while not pending.isEmpty():
        rows, buckets = open_buckets(pending, chunks)
        children, below, ended = deal(rows, buckets)
        rounds.append((buckets, children))
        ends.append(ended)
        cols = ["conv_id", "length", "bucket", "depth"]
        local.append(below.where(F.col("rest") <= local_turns).select(*cols))
        pending = stored(below.where(F.col("rest").isNull() | (F.col("rest") > local_turns)).select(*cols), "trie-pending")
    spark = conversations.sparkSession
    no_sums = spark.createDataFrame([], "conv long, depth long, n_children long, n_leaves long, saved_tokens long")
    made = stored(sort_buckets(reduce(DataFrame.unionByName, local), chunks), "trie-sorted") if local else spark.createDataFrame([], NODE)
    inner = made.where("n_convs is null").select(F.col("conv_id").alias("conv"), *no_sums.columns[1:])
    nodes, sums = [], no_sums
    for buckets, children in reversed(rounds):
        shared, sums = summed(buckets, children, inner.unionByName(sums))
        nodes.append(shared)
    top = spark.createDataFrame([(root, 0, None, count)] if count else [], "conv long, depth long, parent long, n long").join(sums, ["conv", "depth"], "left")
    top = top.fillna(0, ["n_children", "saved_tokens"]).fillna(1, ["n_leaves"])
    digests = hashed_ends(stored(reduce(DataFrame.unionByName, ends), "trie-ends"))
    shared = reduce(DataFrame.unionByName, [top, *nodes]).join(digests, ["conv", "depth"], "left")
    shared = shared.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    lone = [lone_nodes(children) for _, children in rounds]
    return reduce(DataFrame.unionByName, [shared, *lone, made.where("n_convs is not null")])


#: A member's prefixes as lists; h is the CRC-32 of the id's digits, bit by bit (3988292384 is the reflected polynomial).
ORACLE = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, list(x ORDER BY pos) AS xs FROM t GROUP BY conv_id),
     h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h FROM c),
     r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.xs, 1, h.h), []), list_slice(h.xs, h.h + 1, len(h.xs))) AS seq FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
     p AS (SELECT conv_id, len(seq) AS length, unnest(range(0, len(seq) + 1)) AS depth, seq FROM r),
     n AS (SELECT list_slice(seq, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256 FROM p GROUP BY ALL),
     m AS (SELECT *, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(node[depth].text, '[^\x20\x09-\x0D]+')) END AS own FROM n),
     k AS (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
     w AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN k USING (node)),
     u AS (SELECT list_slice(node, 1, a) AS node, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT node, own, n_children, unnest(range(0, depth + 1)) AS a FROM w) GROUP BY ALL)
SELECT w.conv_id, w.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN u USING (node) LEFT JOIN n q ON q.depth = w.depth - 1 AND q.node = list_slice(w.node, 1, w.depth - 1)
"""
