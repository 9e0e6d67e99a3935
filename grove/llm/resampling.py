"""Target-distribution importance resampling over hashed runs of words.

Each task counts its texts' runs in a trie of words. A node stands for a run
of words and holds its count and the CRC state after its last byte, so that
a longer run goes on from there; a full trie is added to the task's bucket
totals and begun anew. Totals are merged in Spark into one gain for each
bucket. Scoring walks texts through such a trie again, with gains at the
nodes. The draw by perturbed scores is a ranking over sorted ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_rows, numbered, stored

#: Words of the contract in UTF-8 once letters are lower-cased.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Nodes of a trie, some 200 bytes each, before it is added up and begun anew.
MOST_NODES = 1 << 18

COUNT, STATE, NEXT = 0, 1, 2


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(LOWER))


class CountTrie:
    """Counts of runs of 1 to `longest` words, by bucket."""

    def __init__(self, longest: int, buckets: int, most_nodes: int = MOST_NODES) -> None:
        self.longest, self.buckets, self.most = longest, buckets, most_nodes
        self.totals, self.root, self.size = np.zeros(buckets, np.int64), {}, 0

    def add(self, words: list[bytes]) -> None:
        """Counts every run of a text."""
        longest = self.longest
        for i, word in enumerate(words):
            node = self.root.get(word)
            if node is None:
                if self.size >= self.most:
                    self.flush()
                node = self.root[word] = [0, crc32(word), None]
                self.size += 1
            node[COUNT] += 1
            for word in words[i + 1 : i + longest]:
                if node[NEXT] is None:
                    node[NEXT] = {}
                below = node[NEXT].get(word)
                if below is None:
                    below = node[NEXT][word] = [0, crc32(word, crc32(b" ", node[STATE])), None]
                    self.size += 1
                node = below
                node[COUNT] += 1

    def flush(self) -> None:
        """Adds all counts to the bucket totals and empties the trie."""
        level = [self.root]
        while level:
            nodes = [node for below in level for node in below.values()]
            states = np.fromiter((n[STATE] for n in nodes), np.uint32, len(nodes))
            np.add.at(self.totals, states % self.buckets, np.fromiter((n[COUNT] for n in nodes), np.int64, len(nodes)))
            level = [n[NEXT] for n in nodes if n[NEXT]]
        self.root, self.size = {}, 0


class GainTrie:
    """Sums of the gains of a text's runs; a node's gain is looked up when the node is made."""

    def __init__(self, gains: list[int], longest: int, most_nodes: int = MOST_NODES) -> None:
        self.gains, self.longest, self.most = gains, longest, most_nodes
        self.root, self.size = {}, 0

    def weigh(self, words: list[bytes]) -> int:
        gains, longest, total = self.gains, self.longest, 0
        for i, word in enumerate(words):
            node = self.root.get(word)
            if node is None:
                if self.size >= self.most:
                    self.root, self.size = {}, 0
                state = crc32(word)
                node = self.root[word] = [gains[state % len(gains)], state, None]
                self.size += 1
            total += node[COUNT]
            for word in words[i + 1 : i + longest]:
                if node[NEXT] is None:
                    node[NEXT] = {}
                below = node[NEXT].get(word)
                if below is None:
                    state = crc32(word, crc32(b" ", node[STATE]))
                    below = node[NEXT][word] = [gains[state % len(gains)], state, None]
                    self.size += 1
                node = below
                total += node[COUNT]
        return total


def bucket_totals(docs: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): how many runs of all texts fall in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = CountTrie(longest, buckets)
        for b in batches:
            for text in b.column(0).to_pylist():
                trie.add(words_of(text))
        trie.flush()
        own = np.nonzero(trie.totals)[0]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(trie.totals[own])], names=["bucket", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, text_col: str, longest: int, buckets: int) -> list[int]:
    """Each bucket's gain, floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))); one row per bucket comes to the driver."""
    counts = raw.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for name, table in (("s", raw), ("t", target)):
        counts = counts.join(bucket_totals(table, text_col, longest, buckets).withColumnRenamed("n", name), "bucket", "left").fillna(0, [name])
    counts = stored(counts, "resampling-totals")
    all_s, all_t = counts.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1).cast("double") * (all_s + buckets) / ((F.col("s") + 1).cast("double") * (all_t + buckets))
    return [r[0] for r in counts.orderBy("bucket").select(F.floor(1000 * F.ln(ratio))).collect()]


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024",
    id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every document's n_features, weight, score and rank among those that are drawn to look like target's texts.

    Of the documents with least_words or more, the stated percentage with the
    highest scores are drawn; rank counts them from 1, the others have null.
    Equal scores go by id, one without an id last; rows equal in both each have
    a rank of their own. A null text has no words, a null id counts as an
    empty text in the perturbation. The columns in keep are handed on; all
    others of docs, and of target but its texts, are left out. No documents
    give no rows; without a target, every bucket's t is 0.
    """
    gains = bucket_gains(docs, target, text_col, longest, buckets)

    def setup():
        trie = GainTrie(gains, longest)

        def row(text):
            words = words_of(text)
            n = len(words)
            return n, sum(max(0, n - i) for i in range(longest)), trie.weigh(words)

        return row

    ids = docs.withColumn("_id", F.col(id_col)).select("_id", *[c for c in keep if c != "_id"], F.col(text_col).cast("string").alias("_text"))
    scored = map_rows(ids, ["_text"], ["_id", *keep], "_words long, n_features long, weight long", setup)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = stored(scored.withColumn("score", F.col("weight") + noise).withColumn("_all", (F.col("_words") < least_words).cast("int")), "resampling-scores")
    draws = scored.where("_all = 0").count() * percent // 100
    placed = numbered(scored, [F.desc("score"), F.asc_nulls_last("_id")], "_all", "resampling-ranges")
    rank = F.when((F.col("_all") == 0) & (F.col("number") < draws), F.col("number") + 1)
    return placed.select(F.col("_id").alias(id_col), *[c for c in keep if c not in (id_col, "n_features", "weight", "score", "rank")], "n_features", "weight", "score", rank.alias("rank"))


#: CRC-32 of a word's bytes, bit by bit; 3988292384 is the reflected polynomial.
ORACLE = r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
           UNION ALL SELECT 'b', item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
     f AS (SELECT side, row, unnest(words) AS word FROM w),
     n AS (SELECT side, row, word, count(*) AS n FROM f GROUP BY ALL),
     hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM n)),
     crc AS (SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, len(h) // 2), lambda i: ((strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT),
                 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 10000 AS bucket FROM hexed),
     k AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM n JOIN crc USING (word) GROUP BY bucket),
     g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM k) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM k) + 10000)::DOUBLE)))::BIGINT AS gain FROM k),
     v AS (SELECT row, sum(n * gain) AS weight FROM n JOIN crc USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY row),
     x AS (SELECT id AS doc_id, len(words) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                  list_reduce([0::BIGINT] || list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', sha256('2024:' || coalesce(id::VARCHAR, ''))[i]) - 1)::BIGINT), lambda a, b: a * 16 + b) AS h
           FROM w LEFT JOIN v USING (row) WHERE side = 'd'),
     y AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM x),
     z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM y)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM z WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM z
"""
