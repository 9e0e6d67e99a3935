"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made in one pass. Distinct fingerprints are then sent, once
for every choice of `blocks - distance` of their bit blocks, to the task that
owns those blocks' values: two fingerprints that differ in at most `distance`
bits agree on at least one choice. Where very many fingerprints share one
choice's values, they are dealt once more by pieces of their other bits, one
more than the distance, of which near ones share one. Each task sorts what it has by Gray rank,
which keeps equal leading bits together; the shared masked patterns form the
upper nodes of a hierarchy, and pairs of nodes are followed downwards with
their accumulated differences. A pair is dropped as a whole once these exceed
the distance, and linked as a whole once the rest of their bits can't.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_rows, stored

BITS, SEED, CHUNK, PAIRS = 64, 42, 1 << 16, 1 << 21
#: Fingerprints that may share a choice's values before they are dealt by more bits.
CROWD = 1 << 20


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit SimHash of the text's lower-cased word shingles; 0 without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp of every row."""
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["text"], ["doc_id"], "fp long", lambda: lambda text: (fingerprint(text),))


def block_widths(blocks: int) -> list[int]:
    return [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]


def masks(blocks: int, distance: int) -> list[tuple[int, ...]]:
    """The choices of blocks, as bit masks' block numbers, counted from the top."""
    return list(combinations(range(blocks), blocks - distance))


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def moved_bits(fps: np.ndarray, order: list[int], back: bool = False) -> np.ndarray:
    """The fingerprints with their bits, counted from the top, in another order, or back again; runs of bits move together."""
    out, at = np.zeros_like(fps), 0
    while at < BITS:
        width = 1
        while at + width < BITS and order[at + width] == order[at] + width:
            width += 1
        source, to = BITS - order[at] - width, BITS - at - width
        source, to = (to, source) if back else (source, to)
        out |= ((fps >> np.uint64(source)) & np.uint64((1 << width) - 1)) << np.uint64(to)
        at += width
    return out


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The position of each value in the binary-reflected Gray order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The hierarchy over distinct fingerprints, whose levels end after `ends` leading bits."""

    def __init__(self, values: np.ndarray, ends: list[int], distance: int):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        self.distance, n = distance, len(values)
        self.starts, self.spread, self.rest = [], [], []
        for end in ends:
            top = self.values >> np.uint64(BITS - end) if end < BITS else self.values
            starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
            first = np.repeat(self.values[starts], np.diff(np.r_[starts, n]))
            self.starts.append(np.r_[starts, n])
            self.spread.append(np.bitwise_or.reduceat(self.values ^ first, starts))
            self.rest.append(np.uint64((1 << (BITS - end)) - 1))
        self.children = [np.searchsorted(b, a) for a, b in zip(self.starts, self.starts[1:])]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions within the distance that connect all that such pairs connect."""
        size = np.diff(self.starts[0])
        nodes = np.flatnonzero(size > 1)
        yield from self._follow(0, nodes, nodes, np.zeros(len(nodes), np.int64))

    def _follow(self, level: int, a: np.ndarray, b: np.ndarray, differ: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(a):
            return
        starts, spread, first = self.starts[level], self.spread[level], self.values[self.starts[level][:-1]]
        open_bits = (spread[a] | spread[b] | (first[a] ^ first[b])) & self.rest[level]
        whole = differ + np.bitwise_count(open_bits) <= self.distance
        for x, y in ((a[whole], b[whole]), (b[whole], a[whole])):
            length = starts[x + 1] - starts[x]
            at = np.repeat(starts[x] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
            yield np.repeat(starts[y], length), at
        a, b, differ = a[~whole], b[~whole], differ[~whole]
        if not len(a):
            return
        child, below = self.children[level], self.values[self.starts[level + 1][:-1]]
        of_a, of_b = child[a + 1] - child[a], child[b + 1] - child[b]
        due = np.cumsum(of_a * of_b)
        cut = 0
        while cut < len(a):
            end = max(cut + 1, int(np.searchsorted(due, (due[cut - 1] if cut else 0) + PAIRS, "right")))
            p, q, wide = a[cut:end], b[cut:end], of_b[cut:end]
            count = of_a[cut:end] * wide
            pair = np.repeat(np.arange(len(p)), count)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i, j = child[p][pair] + nth // wide[pair], child[q][pair] + nth % wide[pair]
            seen = self.rest[level] & ~self.rest[level + 1]
            now = differ[cut:end][pair] + np.bitwise_count((below[i] ^ below[j]) & seen)
            near = (now <= self.distance) & ((p != q)[pair] | (i <= j))
            yield from self._follow(level + 1, i[near], j[near], now[near])
            cut = end


def roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each position is connected to; links are worked off part by part."""
    root = np.arange(n)
    for u, v in links:
        while True:
            low = np.minimum(root[u], root[v])
            if (root[u] == low).all() and (root[v] == low).all():
                break
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            while not (root[root] == root).all():
                root = root[root]
    return root


class Way:
    """A way to deal fingerprints: the bits that must agree come first, in levels that end after `ends` bits."""

    def __init__(self, parts: list[list[int]], agree: int):
        self.order = [bit for part in parts for bit in part]
        ends = [int(e) for e in np.cumsum([len(p) for p in parts])]
        self.ends, self.mask = ends[agree - 1 :], sum(1 << (BITS - 1 - bit) for part in parts[:agree] for bit in part)


def ways_of(distance: int, blocks: int) -> list[Way]:
    """One way for each choice of blocks, then for each choice one for every piece of its other bits."""
    widths = block_widths(blocks)
    starts = np.cumsum([0, *widths]).tolist()
    bits = [list(range(a, a + w)) for a, w in zip(starts, widths)]
    plain, split = [], []
    for chosen in masks(blocks, distance):
        rest = [i for i in range(blocks) if i not in chosen]
        plain.append(Way([*(bits[i] for i in chosen), *(bits[i] for i in rest)], len(chosen)))
        other = [bit for i in rest for bit in bits[i]]
        pieces = [other[k * len(other) // (distance + 1) : (k + 1) * len(other) // (distance + 1)] for k in range(distance + 1)]
        split += [Way([*(bits[i] for i in chosen), pieces[k], *(p for n, p in enumerate(pieces) if n != k)], len(chosen) + 1) for k in range(distance + 1)]
    return plain + split


def local_links(fps: DataFrame, distance: int, blocks: int, crowd: int = CROWD) -> DataFrame:
    """(a, b) fingerprint pairs whose components are those of all pairs within the distance; at most one pair for each fingerprint and way."""
    ways, n = ways_of(distance, blocks), len(masks(blocks, distance))
    key = lambda m: F.col("fp").bitwiseAND(F.element_at(F.lit([signed(w.mask) for w in ways]), m + 1))
    dealt = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("m")).select("fp", "m", key(F.col("m")).alias("key"))
    if (total := fps.count()) > crowd:
        crowds = stored(dealt.groupBy("m", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("m", "key", F.lit(True).alias("many")), "simhash-crowds")
        if not crowds.isEmpty():
            marked = dealt.join(crowds, ["m", "key"], "left")
            again = marked.where("many").select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda k: n + F.col("m") * (distance + 1) + k)).alias("m"))
            dealt = marked.where("many is null").select("fp", "m", "key").union(again.select("fp", "m", key(F.col("m")).alias("key")))
    # Tasks come from the count, so that none holds much more than 2^20 values; small tables get the session's number at most.
    tasks = max(-(-total * n // CROWD), min(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + total * n // (CROWD >> 5)))
    sent = dealt.repartition(tasks, "m", "key").select("m", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not got:
            return
        m, values = (np.concatenate(x) for x in zip(*got))
        values = values.view(np.uint64)
        for i in np.flatnonzero(np.bincount(m, minlength=len(ways)) > 1):
            index = GrayIndex(moved_bits(values[m == i], ways[i].order), ways[i].ends, distance)
            root = roots(len(index.values), index.links())
            moved = np.flatnonzero(root != np.arange(len(root)))
            plain = moved_bits(index.values, ways[i].order, back=True).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(plain[moved]), pa.array(plain[root[moved]])], names=["a", "b"])

    return sent.mapInArrow(run, "a long, b long")


def connected(links: DataFrame, name: str = "simhash") -> DataFrame:
    """(node, label) of every node that has a link, label being the smallest node that it is connected to.

    Each round takes the smallest label among a node's neighbours and then
    that label's own label, so that long chains shorten by half; a round ends
    as a table in the shared folder.
    """
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = stored(links.select("a", "b").union(links.select("b", "a")), f"{name}-links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), f"{name}-lower")
        if lower.where("label <> old").limit(1).count() == 0:
            return lower.select("node", "label")
        jumped = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stored(lower.select("node", "label").join(jumped, "label").select("node", F.least("label", "next").alias("label")), f"{name}-labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, blocks: int = 6, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest id that links of at most `distance` bits reach.

    One row per row. A text of fewer words than a shingle is one shingle; a
    null or empty text has fingerprint zero, linked like any other; rows that
    repeat an id are rows of their own in the same component; an empty table
    gives no rows; further columns are ignored.
    """
    made = stored(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    fps = stored(made.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    labels = connected(local_links(fps.select("fp"), distance, blocks, crowd))
    labelled = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = labelled.join(lowest, "label").select("fp", "component_id")
    return made.join(classes, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
