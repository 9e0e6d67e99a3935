"""LM scoring: interpolated modified Kneser-Ney over word bigrams, counted in Spark.

Texts are read in blocks. A block's distinct bigrams go, as arrays of word
hashes, to the shards that own them. A shard merges what all blocks sent into
the model: the sorted hashes of its bigrams with their counts. It stores
these arrays in the model's table, maps them into memory from a local file,
and looks up every block's bigrams in them. Words, whose counts, continuations
and contexts follow from the bigrams, are stored, mapped and looked up the
same way. No array is ever whole at the driver or in one task: shards are cut
from the bytes of text, and contexts found frequent in a sample are dealt by
both their words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.storage import shared_folder

from .common import LOWER, remainder, stored

LOWER_TABLE = np.frombuffer(LOWER, np.uint8)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of the symbols before the first word and after the last one.
START, END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
#: Bytes of text that are hashed at once, that make up a block, and for which there is one shard.
CHUNK, BLOCK, SHARD = 1 << 22, 12 << 20, 12 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: unsigned ascending ones as differences, all by byte planes, compressed."""
    head, parts = [len(arrays)], []
    for a in arrays:
        rising = a.dtype.kind == "u" and (len(a) < 2 or bool((a[1:] >= a[:-1]).all()))
        flat = np.diff(a, prepend=a.dtype.type(0)) if rising else a
        data = zstandard.compress(np.ascontiguousarray(flat).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes(), 1) if len(a) else b""
        head += [{"u": 0, "i": 1, "f": 2}[a.dtype.kind] * 16 + a.dtype.itemsize, int(rising), len(a), len(data)]
        parts.append(data)
    return b"".join([np.array(head, np.int64).tobytes(), *parts])


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 4 * n, 8).reshape(n, 4), 8 + 32 * n, []
    for kind, rising, length, size in head.tolist():
        dtype = np.dtype(f"{'uif'[kind // 16]}{kind % 16}")
        if length:
            planes = np.frombuffer(zstandard.decompress(data[at : at + size], max_output_size=length * dtype.itemsize), np.uint8)
            a = np.ascontiguousarray(planes.reshape(dtype.itemsize, length).T).view(dtype).ravel()
            a = np.cumsum(a, dtype=dtype) if rising else a
        else:
            a = np.zeros(0, dtype)
        out.append(a)
        at += size
    return out


def mapped(array: np.ndarray) -> np.ndarray:
    """The array as a memory map of a local file, which goes once the map does."""
    if not len(array):
        return array
    with tempfile.TemporaryFile() as f:
        array.tofile(f)
        f.flush()
        return np.memmap(f, dtype=array.dtype, mode="r", shape=array.shape)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(n: int, seed: int) -> np.ndarray:
    """n odd numbers, each its own, however many there are."""
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(seed)) * GOLDEN) | np.uint64(1)


BYTE_HASH = drawn(256, 1 << 40)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v ^ (w * GOLDEN))


def hashed_words(texts: pa.Array, table: np.ndarray = LOWER_TABLE, spans: list | None = None, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all white-space words, lower-cased by the table, and the number of words of each text; every byte of a word counts with a factor of its place. Starts and lengths of the words are added to spans."""
    texts = pc.fill_null(texts, "")
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    hashes, counts = [], np.zeros(len(texts), np.int64)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + chunk, "right")) - 1)
        data, cut = table[raw[edges[first] : edges[last]]], edges[first : last + 1] - edges[first]
        word = (data != 32) & ((data < 9) | (data > 13))
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = cut[:-1][cut[:-1] < len(data)]
        begins[inner] = word[inner]
        starts = np.flatnonzero(begins)
        if len(starts):
            place = np.arange(len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)])) if starts[0] == 0 else np.r_[np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))]
            place[~word] = 0
            value = BYTE_HASH[data] * drawn(int(place.max()) + 1, 1 << 41)[place]
            value[~word] = 0
            hashes.append(mix(np.add.reduceat(value, starts)))
            if spans is not None:
                spans.append((edges[first] + starts, np.add.reduceat(word, starts, dtype=np.int64)))
            counts[first:last] = np.bincount(np.searchsorted(cut, starts, "right") - 1, minlength=last - first)[: last - first]
        first = last
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


class Block:
    """A block's tokens: its distinct words' hashes, ascending, each token's word, and each text's number of tokens."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray):
        self.vocabulary, self.tokens, self.lengths = vocabulary, tokens, lengths
        self.before = np.r_[np.int64(0), tokens[:-1]]
        self.before[np.cumsum(lengths) - lengths] = np.searchsorted(vocabulary, START)

    @classmethod
    def read(cls, texts: pa.Array) -> Block:
        words, counts = hashed_words(texts)
        words = np.insert(words, np.cumsum(counts), END)
        order = np.argsort(words, kind="stable")
        ranked = words[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        vocabulary = ranked[new]
        tokens = np.empty(len(words), np.int64)
        tokens[order] = np.cumsum(new) - 1
        at = int(np.searchsorted(vocabulary, START))
        tokens[tokens >= at] += 1
        return cls(np.insert(vocabulary, at, START), tokens, counts + 1)

    def pairs(self, owners: Owners) -> tuple[np.ndarray, np.ndarray]:
        """The distinct bigrams and their owners, in the order in which they are sent."""
        codes = np.sort(self.codes())
        codes = codes[np.r_[True, codes[1:] != codes[:-1]]]
        owner = owners.of(*self.words_of(codes))
        order = np.argsort(owner, kind="stable")
        return codes[order], owner[order]

    def codes(self) -> np.ndarray:
        return self.before << 32 | self.tokens

    def words_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.vocabulary[codes >> 32], self.vocabulary[codes & 0xFFFFFFFF]


class Owners:
    """Which shard owns a bigram or a word; contexts in `frequent` are dealt by both words."""

    def __init__(self, shards: int, frequent: np.ndarray):
        self.shards, self.frequent = shards, np.sort(frequent)

    def word(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(20)) % np.uint64(self.shards)).astype(np.int32)

    def of(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return self.word(v)
        at = np.minimum(np.searchsorted(self.frequent, v), len(self.frequent) - 1)
        return self.word(np.where(self.frequent[at] == v, pair_hash(v, w), v))

    @staticmethod
    def slices(owner: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Each owner that there is and its part of the ascending array."""
        cuts = np.r_[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner)] if len(owner) else np.zeros(1, np.int64)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(owner[a]), slice(a, z)


ROW = "shard int, kind string, block string, data binary"
ROW_NAMES = ["shard", "kind", "block", "data"]


def rows(made: list[tuple[int, str, str, bytes]]) -> pa.RecordBatch:
    types = (pa.int32(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*made), types)], names=ROW_NAMES)


def scanned(docs: DataFrame) -> DataFrame:
    """The texts with the number of their partition, which with a batch's place and a checksum of ids and words names a block."""
    return docs.withColumn("part", F.spark_partition_id())


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch, Block]]:
    i = 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < b.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, "right")))
            part = b.slice(first, last - first)
            block = Block.read(part.column(2))
            ids = pc.fill_null(part.column(0), 0).to_numpy(zero_copy_only=False)
            same = xxhash.xxh64(np.r_[block.vocabulary, block.tokens.view(np.uint64), block.lengths.view(np.uint64), ids.view(np.uint64)].tobytes()).hexdigest()
            yield f"{b.column(3)[0]}-{i}-{same}", part, block
            first, i = last, i + 1


def by_key(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """The rows of a sorted partition, one group at a time."""
    group: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if group and group[0][column] != row[column]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def send_pairs(docs: DataFrame, owners: Owners) -> DataFrame:
    """Each block's distinct bigrams with their numbers in training texts, for each shard one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, b, block in blocks(batches):
            codes, owner = block.pairs(owners)
            train = np.repeat(~b.column(1).to_numpy(zero_copy_only=False), block.lengths)
            seen = np.sort(block.codes()[train])
            n = (np.searchsorted(seen, codes, "right") - np.searchsorted(seen, codes)).astype(np.uint64)
            v, w = block.words_of(codes)
            for p, part in owners.slices(owner):
                yield rows([(p, "pairs", name, pack(v[part], w[part], n[part]))])

    return scanned(docs).mapInArrow(run, ROW)


class Mapped:
    """Sorted hashes with what is known of each, in local files that are mapped into memory."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.keys, self.values = mapped(keys), [mapped(v) for v in values]

    def look_up(self, want: np.ndarray) -> list[np.ndarray]:
        """The values of each hash; 0 for those that aren't there."""
        if not len(self.keys):
            return [np.zeros(len(want), v.dtype) for v in self.values]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        there = self.keys[at] == want
        return [np.where(there, v[at], 0) for v in self.values]


def merge_pairs(sent: DataFrame, owners: Owners) -> DataFrame:
    """For each shard its sorted bigram hashes with counts (kind model), each block's answers from them, and what its words add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, 0):
            shard = group[0][0]
            v, w, n = (np.concatenate(x) for x in zip(*(unpack(g[3]) for g in group)))
            v, w, n = v[n > 0], w[n > 0], n[n > 0]
            keys = pair_hash(v, w)
            order = np.argsort(keys)
            keys = keys[order]
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            keys, total = keys[new], np.add.reduceat(n[order], new) if len(new) else np.zeros(0, np.uint64)
            v, w = v[order][new], w[order][new]
            yield rows([(shard, "model", "", pack(keys, total))])
            yield rows([(shard, "classes", "", pack(np.bincount(np.minimum(total, 5).astype(np.int64), minlength=6)[1:5].astype(np.int64)))])
            words = word_sums(v, w, total)
            del v, w, n, order
            model = Mapped(keys, total)
            del keys, total
            for g in group:
                yield rows([(shard, "answer", g[2], pack(*model.look_up(pair_hash(*unpack(g[3])[:2]))))])
            to = owners.word(words[0])
            order = np.argsort(to, kind="stable")
            for q, part in owners.slices(to[order]):
                yield rows([(q, "words", "", pack(*(x[order[part]] for x in words)))])

    return sent.repartitionById(owners.shards, "shard").sortWithinPartitions("shard").mapInArrow(run, ROW)


def word_sums(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """For each word of the bigrams: hash, tokens, continuations, tokens after it, and its followers seen once, twice, more often."""
    after = [(v, n), (v, (n == 1).astype(np.int64)), (v, (n == 2).astype(np.int64)), (v, (n > 2).astype(np.int64))]
    one = np.ones(len(w), np.int64)
    return summed([w, v], [[n, None], [one, None], [None, after[0][1]], [None, after[1][1]], [None, after[2][1]], [None, after[3][1]]])


def summed(keys: list[np.ndarray], values: list[list[np.ndarray | None]]) -> list[np.ndarray]:
    """The distinct keys, ascending, with the sum of each value over the keys' places; None adds nothing."""
    whole = np.concatenate(keys)
    order = np.argsort(whole, kind="stable")
    ranked = whole[order]
    new = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
    out = [ranked[new]]
    for parts in values:
        flat = np.concatenate([np.zeros(len(k), np.int64) if p is None else p.astype(np.int64) for k, p in zip(keys, parts)])
        out.append((np.add.reduceat(flat[order], new) if len(new) else np.zeros(0, np.int64)).astype(np.uint64))
    return out


def merge_words(sums: DataFrame, owners: Owners) -> DataFrame:
    """For each shard its sorted words with all sums (kind words), and its totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, 0):
            parts = [unpack(g[3]) for g in group]
            words = summed([p[0] for p in parts], [[p[i] for p in parts] for i in range(1, 7)])
            known, more = words[1] > 0, words[2]
            classes = np.bincount(np.minimum(more, 5).astype(np.int64), minlength=6)
            yield rows([(group[0][0], "words", "", pack(*words)), (group[0][0], "totals", "", pack(np.array([words[1].sum(), known.sum(), more.sum(), *classes[1:5], (more > 2).sum()], dtype=np.int64)))])

    return sums.repartitionById(owners.shards, "shard").sortWithinPartitions("shard").mapInArrow(run, ROW)


def discounts(n: np.ndarray) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and more, from how many counts are 1, 2, 3 and 4."""
    if (n <= 0).any():
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))])


class Totals:
    """The few numbers that hold for the whole model."""

    def __init__(self, pair_classes: np.ndarray, totals: np.ndarray):
        self.tokens, self.words, self.continuations = (int(x) for x in totals[:3])
        self.pair, self.word = discounts(pair_classes.astype(float)), discounts(totals[3:7].astype(float))
        taken = self.word[1] * totals[3] + self.word[2] * totals[4] + self.word[3] * totals[7]
        self.rest = taken / self.continuations if self.continuations else 1.0

    def single(self, continuations: np.ndarray) -> np.ndarray:
        """The lower-order probability of a word; what the discounts leave is shared among all words and the unknown one."""
        kept = continuations - self.word[np.minimum(continuations, 3).astype(np.int64)]
        return kept / max(1, self.continuations) + self.rest / (self.words + 1)


def send_words(docs: DataFrame, owners: Owners) -> DataFrame:
    """Each block's distinct words, for each shard one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, block in blocks(batches):
            owner = owners.word(block.vocabulary)
            order = np.argsort(owner, kind="stable")
            for q, part in owners.slices(owner[order]):
                yield rows([(q, "~ask", name, pack(block.vocabulary[order[part]]))])

    return scanned(docs).mapInArrow(run, ROW)


def answer_words(words: DataFrame, asked: DataFrame, owners: Owners, totals: Totals) -> DataFrame:
    """For each block and shard: the words' tokens, lower-order probability, tokens after them, and the weight these leave to the lower order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, 0):
            own = [g for g in group if g[1] == "words"]
            model = Mapped(*(unpack(own[0][3]) if own else [np.zeros(0, np.uint64)] * 7))
            for g in group:
                if g[1] == "words":
                    continue
                n, more, after, *classes = (x.astype(np.float64) for x in model.look_up(unpack(g[3])[0]))
                left = sum(d * c for d, c in zip(totals.pair[1:], classes))
                weight = np.where(after > 0, left / np.maximum(after, 1), 1.0)
                yield rows([(g[0], "words", g[2], pack(n.astype(np.uint64), totals.single(more), after.astype(np.uint64), weight))])

    return words.unionByName(asked).repartitionById(owners.shards, "shard").sortWithinPartitions("shard", F.col("kind") == "~ask").mapInArrow(run, ROW)


def send_tokens(docs: DataFrame) -> DataFrame:
    """Each block whole: ids, held-out flags, lengths, words by frequency, and the tokens as places in that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, b, block in blocks(batches):
            by_frequency = np.argsort(-np.bincount(block.tokens, minlength=len(block.vocabulary)), kind="stable")
            place = np.empty(len(by_frequency), np.uint32)
            place[by_frequency] = np.arange(len(by_frequency), dtype=np.uint32)
            ids = b.column(0)
            yield rows([(-1, "tokens", name, pack(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8), block.lengths, block.vocabulary, by_frequency.astype(np.uint32), place[block.tokens]))])

    return scanned(docs).mapInArrow(run, ROW)


CHANGED = "a block of a later reading differs from the first: store the table before scoring it"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score_blocks(tokens: DataFrame, answers: DataFrame, owners: Owners, totals: Totals) -> DataFrame:
    """Puts each block's answers to its tokens and sums them up by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, 2):
            whole = [g for g in group if g[1] == "tokens"]
            if len(whole) != 1:
                raise RuntimeError(CHANGED)
            ids, valid, held, lengths, vocabulary, by_frequency, places = unpack(whole[0][3])
            block = Block(vocabulary, by_frequency[places].astype(np.int64), lengths)
            pair_answers, word_answers = (sorted((g for g in group if g[1] == kind), key=lambda g: g[0]) for kind in ("answer", "words"))
            codes, _ = block.pairs(owners)
            if not pair_answers or not word_answers:
                raise RuntimeError(CHANGED)
            found = np.concatenate([unpack(g[3])[0] for g in pair_answers]).astype(np.float64)
            order = np.argsort(owners.word(vocabulary), kind="stable")
            columns = [np.concatenate(c) for c in zip(*(unpack(g[3]) for g in word_answers))]
            if len(found) != len(codes) or len(columns[0]) != len(vocabulary):
                raise RuntimeError(CHANGED)
            n, single, after, weight = (np.empty(len(vocabulary)) for _ in range(4))
            for to, c in zip((n, single, after, weight), columns):
                to[order] = c
            v, w = codes >> 32, codes & 0xFFFFFFFF
            p = np.maximum(found - totals.pair[np.minimum(found, 3).astype(np.int64)], 0) / np.maximum(after[v], 1) + weight[v] * single[w]
            by_code = np.argsort(codes)
            at = by_code[np.searchsorted(codes[by_code], block.codes())]
            ends = np.cumsum(lengths)
            by_text = lambda x: np.add.reduceat(x, ends - lengths)
            score = by_text(np.log10(p)[at])
            base = np.log10((n + 1) / (totals.tokens + totals.words + 1))
            out = [pa.array(ids, mask=valid == 0), pa.array(held.astype(bool)), pa.array(lengths), pa.array(by_text((n > 0).astype(np.int64)[block.tokens])), pa.array(np.full(len(ids), totals.tokens)), pa.array(by_text(base[block.tokens])), pa.array(score), pa.array(10 ** (-score / lengths))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return tokens.unionByName(answers).repartition(4 * owners.shards, "block").sortWithinPartitions("block").mapInArrow(run, SCORES)


def frequent_words(docs: DataFrame, shards: int, fraction: float, seed: int = 5) -> np.ndarray:
    """Words that hold more than a quarter of a shard's share in a sample; at most 4 * shards of them. They only settle which shard owns a bigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                words, n = np.unique(hashed_words(b.column(2))[0], return_counts=True)
                own = n * shards * 8 > n.sum()
                yield pa.RecordBatch.from_arrays([pa.array(words[own].view(np.int64)), pa.array(n[own]), pa.array(np.full(own.sum(), n.sum()))], names=["h", "n", "total"])

    counted = docs.sample(fraction, seed).mapInArrow(run, "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found = counted.where(F.col("n") * shards * 4 > F.col("total")).orderBy(F.desc("n"), "h").limit(4 * shards).collect()
    return np.array([START, *(np.uint64(r["h"] % 2**64) for r in found)], dtype=np.uint64)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2, sample: float = 0.02, rescannable: bool = False, shard_bytes: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (for each token).

    The model learns from the texts whose crc32 remainder isn't held_out and
    scores all of them. The table is read three times and must give the same
    blocks each time, as plain files do and as a checksum confirms; without
    rescannable, ids and texts are stored first. There is a shard for each
    shard_bytes of text, so that a task's memory stays as it is. One row per row; a null or empty text is its end
    token alone; rows that repeat an id are texts of their own; an empty table
    gives no rows; without training texts every word is unknown.
    """
    held = remainder(id_col, modulus) == held_out
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    docs = docs if rescannable else stored(docs, "lm-texts")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    owners = Owners(shards, frequent_words(docs, shards, sample))
    merged = stored_kinds(merge_pairs(send_pairs(docs, owners), owners), "lm-pairs")
    kind = lambda df, k: df.where(F.col("kind") == k).select(*ROW_NAMES)
    words = stored_kinds(merge_words(kind(merged, "words"), owners), "lm-words")
    add = lambda df, k, n: reduce(np.add, (unpack(bytes(r["data"]))[0] for r in kind(df, k).toLocalIterator()), np.zeros(n, np.int64))
    totals = Totals(add(merged, "classes", 4), add(words, "totals", 8))
    word_answers = answer_words(kind(words, "words"), send_words(docs, owners), owners, totals)
    return score_blocks(send_tokens(docs), kind(merged, "answer").unionByName(word_answers), owners, totals)


def stored_kinds(df: DataFrame, name: str = "", path: str | None = None) -> DataFrame:
    """The table written with a folder for each kind of row, so that reading one kind leaves the others."""
    path = path or f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
