"""Benchmark decontamination through a distributed positional inverted index.

The index is partitioned by document: each shard holds, for some million
words of documents, every term with the sorted list of its positions. Shards
are made where the documents are read, without a shuffle, and stored as a
table. A search goes over the shards: within each, a phrase's lists are moved
by the terms' offsets and intersected, starting with the rarest term. Test
items are taken apart in Spark too, and go to the shards in blocks of bounded
size, one after the other; each block's hits are stored before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StringType, StructField, StructType

from .common import ALNUM, map_rows, stored

#: Words of a shard; words, and bytes of words, of test items that a search takes to the shards at once.
SHARD_WORDS, BLOCK_WORDS, BLOCK_BYTES = 1 << 20, 1 << 18, 1 << 23
ABSENT = np.iinfo(np.int32).max


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and characters beyond ASCII, as UTF-8."""
    return (text or "").encode().translate(ALNUM).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, path: str | None = None) -> DataFrame:
    """The stored index of all words of all documents; one row per shard.

    ids lists the shard's documents and lengths their numbers of words; terms are sorted; positions holds the places of each term's words,
    ascending, as differences, and ends where its list ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0

        def shard(ids: list, lengths: list[int], words: list[bytes]) -> pa.RecordBatch:
            codes, terms = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), np.zeros(0, object))
            order = np.argsort(terms, kind="stable")
            rank = np.empty(len(terms), np.int32)
            rank[order] = np.arange(len(terms), dtype=np.int32)
            places = np.argsort(rank[codes], kind="stable").astype(np.int32)
            ends = np.cumsum(np.bincount(codes, minlength=len(terms))[order]).astype(np.int32)
            row = {"shard": [f"{task}-{made}"], "ids": [ids], "lengths": [lengths], "terms": [b" ".join(terms[order])], "ends": [ends.tobytes()], "positions": [np.diff(places, prepend=np.int32(0)).tobytes()]}
            types = {"shard": pa.string(), "ids": id_type, "lengths": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays([pa.array(v, type=types.get(k, pa.binary())) for k, v in row.items()], names=list(row))

        ids, lengths, words = [], [], []
        id_type = to_arrow_schema(schema)[1].type
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = words_of(text.as_py())
                if words and len(words) + len(own) > shard_words:
                    yield shard(ids, lengths, words)
                    ids, lengths, words, made = [], [], [], made + 1
                ids.append(doc)
                lengths.append(len(own))
                words += own
        if ids:
            yield shard(ids, lengths, words)

    schema = StructType([StructField("shard", StringType()), StructField("ids", ArrayType(docs.schema[id_col].dataType)), StructField("lengths", ArrayType(IntegerType())), *(StructField(n, BinaryType()) for n in ("terms", "ends", "positions"))])
    built = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return stored(built, "positional-index", path)


class Shard:
    """One shard of the index, with lists read as they are asked for."""

    def __init__(self, lengths: np.ndarray, terms: bytes, ends: bytes, positions: bytes):
        self.starts = np.r_[0, np.cumsum(lengths)].astype(np.int32)
        self.slot = {t: i for i, t in enumerate(terms.split(b" "))} if terms else {}
        self.ends = np.frombuffer(ends, np.int32)
        self.positions = np.cumsum(np.frombuffer(positions, np.int32), dtype=np.int32)

    def list_of(self, slot: int) -> np.ndarray:
        return self.positions[self.ends[slot - 1] if slot else 0 : self.ends[slot]]


class Phrases:
    """Test phrases: all windows of `window` consecutive words of each item, or the whole item if it has fewer. Windows are cut from the items' codes as they are needed."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        vocabulary: dict[bytes, int] = {}
        self.codes = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for _, words in items for w in words), np.int32)
        self.terms, self.items, self.window = b" ".join(vocabulary), [item for item, _ in items], window
        sizes = np.array([len(words) for _, words in items], np.int64)
        first = np.cumsum(sizes) - sizes
        counts = np.where(sizes, np.maximum(sizes - window + 1, 1), 0)
        self.nth = np.repeat(np.arange(len(items), dtype=np.int32), counts)
        self.start = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)).astype(np.int32)
        self.length = np.repeat(np.minimum(sizes, window), counts).astype(np.int32)

    def rarest(self, size: np.ndarray) -> np.ndarray:
        """The smallest of the sizes of each phrase's words."""
        low = np.full(len(self.start), ABSENT, np.int32)
        for i in range(self.window):
            inside = self.length > i
            low[inside] = np.minimum(low[inside], size[self.start[inside] + i])
        return low

    def in_shard(self, shard: Shard, slop: int | None) -> Iterator[tuple[int, np.ndarray, int]]:
        """(phrase, places, words covered from each place) of the phrases that occur in the shard.

        With slop, a phrase occurs where each of its terms stands within slop
        words of one place of its rarest term, in any order; the words from
        slop before that place to slop after it are covered.
        """
        slots = np.fromiter((shard.slot.get(t, -1) for t in self.terms.split(b" ")), np.int32)
        lengths = np.diff(shard.ends, prepend=np.int32(0)) if len(shard.ends) else np.zeros(1, np.int32)
        size = np.where(slots >= 0, lengths[slots], 0)[self.codes]
        for p in np.flatnonzero(self.rarest(size) > 0):
            words = slice(self.start[p], self.start[p] + self.length[p])
            found = None
            for offset in np.argsort(size[words], kind="stable"):
                places = shard.list_of(slots[self.codes[words][offset]])
                if slop is None:
                    places = places - offset
                if found is None:
                    found = places
                    continue
                at = np.searchsorted(places, found if slop is None else found - slop)
                inside = at < len(places)
                found, near = found[inside], places[at[inside]]
                found = found[near == found] if slop is None else found[near <= found + slop]
                if not len(found):
                    break
            if len(found):
                yield (p, found, int(self.length[p])) if slop is None else (p, found - slop, 2 * slop + 1)


def search(index: DataFrame, phrases: Broadcast, item_type: DataType, slop: int | None = None) -> DataFrame:
    """For every document of the index that is hit, the spans of its words that are hit ([start, end, start, ...], disjoint) and the items that hit it."""
    schema = StructType([StructField("shard", StringType()), StructField("nth", IntegerType()), StructField("hits", ArrayType(IntegerType())), StructField("items", ArrayType(item_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [f.type for f in to_arrow_schema(schema)]
        for b in batches:
            for name, lengths, *columns in zip(*(b.column(i) for i in range(5))):
                shard = Shard(lengths.values.to_numpy(), *(c.as_py() for c in columns))
                starts = shard.starts
                hit = np.zeros(int(starts[-1]) + 1, np.int32)
                who: dict[int, set[int]] = {}
                for p, places, span in phrases.value.in_shard(shard, slop):
                    doc = np.searchsorted(starts, places if slop is None else places + slop, "right") - 1
                    first, last = np.maximum(places, starts[doc]), np.minimum(places + span, starts[doc + 1])
                    whole = (last - first == span) if slop is None else np.ones(len(doc), bool)
                    np.add.at(hit, first[whole], 1)
                    np.add.at(hit, last[whole], -1)
                    for d in set(doc[whole].tolist()):
                        who.setdefault(d, set()).add(int(phrases.value.nth[p]))
                covered = np.cumsum(hit)[:-1] > 0
                spans = [np.flatnonzero(np.diff(np.r_[False, covered[starts[d] : starts[d + 1]], False])).tolist() for d in who]
                named = [[x for x in dict.fromkeys(phrases.value.items[i] for i in sorted(w)) if x is not None] for w in who.values()]
                out = [[name.as_py()] * len(who), list(who), spans, named]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out, types)], names=schema.names)

    return index.drop("ids").mapInArrow(run, schema)


def item_pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int, words: int, size: int) -> DataFrame:
    """(id, piece) of the items that have words: their words joined by blanks, cut where they are more than `words` or `size` bytes, with window - 1 words in common so that no window is lost."""
    schema = StructType([StructField("id", benchmark.schema[id_col].dataType), StructField("piece", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pieces = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1)):
                own, first = words_of(text.as_py()), 0
                ends = np.cumsum([len(w) + 1 for w in own])
                while own:
                    last = min(first + words, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right")))
                    last = min(len(own), max(last, first + 2 * window))
                    ids.append(item)
                    pieces.append(b" ".join(own[first:last]))
                    if last == len(own):
                        break
                    first = last - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=b.column(0).type), pa.array(pieces, type=pa.binary())], names=["id", "piece"])

    return benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def blocks_of(pieces: DataFrame, window: int, words: int, size: int) -> Iterator[Phrases]:
    """The items' pieces in blocks of about `words` words and `size` bytes at most, one of them at the driver at a time."""
    block, n, held = [], 0, 0
    for item, piece in pieces.toLocalIterator():
        own = bytes(piece).split(b" ")
        if block and (n + len(own) > words or held + len(piece) > size):
            yield Phrases(block, window)
            block, n, held = [], 0, 0
        block.append((item, own))
        n, held = n + len(own), held + len(piece)
    if block:
        yield Phrases(block, window)


def union_spans(hits: list[int]) -> tuple[list[int]]:
    out: list[int] = []
    for a, b in sorted(zip(hits[::2], hits[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return (out,)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    slop: int | None = None,
    block_words: int = BLOCK_WORDS,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the items and hit spans themselves.

    One row per row of docs. A document is contaminated if at least a
    twentieth of its words, and at least one, are hit. Ids may be of any type.
    Null and empty texts have no words; items without words hit nothing;
    items that repeat an id count once, those without an id hit words but
    aren't named; an empty table of items leaves every document clean. The
    benchmark goes to the shards in blocks of block_words words and
    block_bytes bytes, long items in pieces, so its size is no bound.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col)
    item_type = benchmark.schema[item_id_col].dataType
    pieces = stored(item_pieces(benchmark, item_id_col, item_text_col, window, block_words, block_bytes), "positional-items")
    whole = index.select("shard", F.posexplode(F.arrays_zip("ids", "lengths")).alias("nth", "doc")).select("shard", "nth", F.col("doc.ids").alias("doc_id"), F.col("doc.lengths").cast("long").alias("n_words"))
    passes = []
    for block in blocks_of(pieces, window, block_words, block_bytes):
        phrases = spark.sparkContext.broadcast(block)
        passes.append(stored(search(index, phrases, item_type, slop), "positional-hits"))
        phrases.destroy()
    if not passes:
        found = whole.withColumn("hits", F.array().cast("array<int>")).withColumn("items", F.array().cast(ArrayType(item_type)))
    else:
        found = passes[0]
        if len(passes) > 1:
            for more in passes[1:]:
                found = found.union(more)
            found = found.groupBy("shard", "nth").agg(F.flatten(F.collect_list("hits")).alias("all"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
            found = map_rows(found, ["all"], ["shard", "nth", "items"], "hits array<int>", lambda: union_spans)
        found = whole.join(found, ["shard", "nth"], "left").withColumn("hits", F.coalesce("hits", F.array())).withColumn("items", F.coalesce("items", F.array()))
    n_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    found = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(named.cast("binary"), 256))
    found = found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hits")


def matches_as_text(found: DataFrame) -> DataFrame:
    """items and hits as sorted item_ids and start:end of spans, comma-joined."""
    spans = F.filter(F.transform("hits", lambda x, i: F.when(i % 2 == 0, F.concat_ws(":", x, F.element_at("hits", i + 2)))), lambda x: x.isNotNull())
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.withColumn("items", named).withColumn("hits", F.array_join(spans, ","))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, n, i, item_id FROM grams JOIN win USING (n, phrase)
), places AS (
  SELECT DISTINCT doc_id, unnest(range(i - 1, i - 1 + n)) AS p FROM hit
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 1 AS z FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM places) GROUP BY doc_id, island
), words AS (
  SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_hit, string_agg(a || ':' || z, ',' ORDER BY a) AS hits FROM spans GROUP BY doc_id
), who AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(listed, '') AS items, coalesce(hits, '') AS hits
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN who ON d.doc_id = who.doc_id
"""
