"""Perplexity by words: for each language, interpolated modified Kneser-Ney over word bigrams, above a model of how its words are spelt.

Every text belongs to one of two folds and is scored by what the other fold's
texts counted, so that no text vouches for itself; words that the other fold
lacks are left to their spelling. Blocks, shards and their sorted, mapped
arrays are those of `lm`: a shard gets a block's distinct bigrams with their
numbers, merges them, and answers each block. A block's texts are of one fold,
so that it is told only what the other counted. A word's hash
holds its language, so that languages share shards but no counts. Texts are
read once and stored as tokens; bigrams go to their shards, and answers back to
their blocks, in rounds, whose shuffle files Spark deletes after each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.storage import remove, shared_folder

from .common import stored
from .lm import END, ROW, ROW_NAMES, SHARD, START, Block, Mapped, Owners, by_key, discounts, hashed_words, pack, pair_hash, rows, stored_kinds, unpack

#: Bits of a word's hash below its language's number; no letter changes; steps of log10 in which the spelling is sent; bigrams scored at once.
BITS, AS_IT_IS, STEPS, SLICE = 44, np.arange(256, dtype=np.uint8), 1 << 8, 1 << 17
LOW = np.uint64((1 << BITS) - 1)
#: Bytes of text that make up a block, and that are hashed at once, so that its arrays stay in a core's cache.
BLOCK, CHUNK = 16 << 20, 1 << 18
#: Numbers of a language and fold: continuations, words with 1, 2, 3, 4 and over 2 of them, bigrams seen 1, 2, 3 and 4 times.
NUMBERS = 10

Spelling = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def keyed(hashes: np.ndarray, languages: np.ndarray) -> np.ndarray:
    return hashes & LOW | languages.astype(np.uint64) << np.uint64(BITS)


def language_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(BITS)).astype(np.int64)


def narrow(a: np.ndarray) -> np.ndarray:
    """The numbers, none negative, in as few bytes as the largest needs."""
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)


def by_owner(owner: np.ndarray, shards: int) -> np.ndarray:
    return np.argsort(owner.astype(np.uint16) if shards <= 1 << 16 else owner, kind="stable")


class LanguageBlock(Block):
    """A block whose words belong to languages; `of_texts` are those of each text."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, of_texts: np.ndarray):
        self.vocabulary, self.tokens, self.lengths, self.of_texts = vocabulary, tokens, lengths, of_texts
        self.before = np.r_[np.int64(0), tokens[:-1]]
        self.before[np.cumsum(lengths) - lengths] = np.searchsorted(vocabulary, keyed(START, of_texts))

    @classmethod
    def of(cls, texts: pa.Array, of_texts: np.ndarray) -> LanguageBlock:
        spans: list = []
        texts = pc.fill_null(texts, "")
        words, counts = hashed_words(texts, AS_IT_IS, spans, CHUNK)
        ends = np.cumsum(counts)
        words = np.r_[keyed(np.insert(words, ends, END), np.repeat(of_texts, counts + 1)), keyed(START, np.unique(of_texts))]
        order = np.argsort(words)
        ranked = words[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        tokens = np.empty(len(words), np.int64)
        tokens[order] = np.cumsum(new) - 1
        block = cls(ranked[new], tokens[: len(words) - len(np.unique(of_texts))], counts + 1, of_texts)
        starts, lengths = (np.concatenate(x) for x in zip(*spans)) if spans else (np.zeros(0, np.int64),) * 2
        at = np.minimum(order[new], len(block.tokens) - 1)
        block.starts, block.sizes = np.insert(starts, ends, 0)[at], np.insert(lengths, ends, 0)[at]
        block.sizes[order[new] >= len(block.tokens)] = 0
        block.raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        return block

    def owners_of(self, owners: Owners, codes: np.ndarray) -> np.ndarray:
        """As Owners.of, by the places of words in the vocabulary."""
        v = codes >> 32
        owner, often = owners.word(self.vocabulary)[v], np.isin(self.vocabulary, owners.frequent)[v]
        owner[often] = owners.word(pair_hash(*self.words_of(codes[often])))
        return owner

    def dealt(self, owners: Owners, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The owners of bigrams, ascending, and the places of these in that order."""
        owner = self.owners_of(owners, codes)
        order = by_owner(owner, owners.shards)
        return owner[order], order

    def counted(self, owners: Owners, rounds: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """This round's distinct bigrams, in the order of their owners, with these and their numbers."""
        codes = self.codes()
        codes = np.sort(codes[self.owners_of(owners, codes) % rounds == turn])
        new = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        n, codes = np.diff(np.r_[new, len(codes)]), codes[new]
        owner, order = self.dealt(owners, codes)
        return codes[order], owner, n[order]

    def spelt(self, spelling: Spelling) -> np.ndarray:
        """log10 of the probability of each word's letters, in steps."""
        found, languages = np.zeros(len(self.vocabulary)), language_of(self.vocabulary)
        for language in np.unique(languages).tolist():
            own = languages == language
            found[own] = spelling(language, self.raw, self.starts[own], self.sizes[own])
        return np.rint(found * STEPS).astype(np.int32)


def parts_of(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """First and last places of even parts of the texts, of `most` bytes or some less, or one text more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    size = int(ends[-1]) if len(ends) else 0
    parts = max(1, -(-size // most))
    cuts = np.unique(np.r_[0, np.searchsorted(ends, size * np.arange(1, parts) // parts, "right"), len(ends)]).tolist()
    return zip(cuts, cuts[1:])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, pa.RecordBatch, LanguageBlock]]:
    """Batches of (row, fold, text, language, part) in blocks of one fold, each with a tag, twice its part and its fold, and a name."""
    i = 0
    for b in batches:
        folds = b.column(1).to_numpy()
        for fold in (0, 1):
            own = b.filter(pa.array(folds == fold))
            for first, last in parts_of(own.column(2)):
                part, tag = own.slice(first, last - first), 2 * own.column(4)[0].as_py() + fold
                yield tag, f"{tag}-{i}", part, LanguageBlock.of(part.column(2), part.column(3).to_numpy())
                i += 1


def tag_of(block: str) -> int:
    return int(block.split("-")[0])


def send_tokens(docs: DataFrame, setup: Callable[[], Spelling]) -> DataFrame:
    """Each block whole, with its tag in place of a shard: rows, languages, lengths, words by frequency with their spelling, and the tokens as places in that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = setup()
        for tag, name, b, block in blocks(batches):
            by_frequency = np.argsort(-np.bincount(block.tokens, minlength=len(block.vocabulary)), kind="stable")
            place = np.empty(len(by_frequency), np.uint32)
            place[by_frequency] = np.arange(len(by_frequency), dtype=np.uint32)
            yield rows([(tag, "tokens", name, pack(b.column(0).to_numpy(), block.of_texts, block.lengths, block.vocabulary, block.spelt(spelling), by_frequency.astype(np.uint32), place[block.tokens]))])

    return scanned(docs).mapInArrow(run, ROW)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, LanguageBlock]:
    """A sent block's rows, its words' spelling, and itself."""
    ids, of_texts, lengths, vocabulary, spelt, by_frequency, places = unpack(data)
    return ids, spelt, LanguageBlock(vocabulary, by_frequency[places].astype(np.int64), lengths, of_texts)


def sent_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, LanguageBlock]]:
    for b in batches:
        for name, data in zip(b.column(2), b.column(3)):
            yield name.as_py(), unpacked(data.as_py())[2]


def scanned(docs: DataFrame) -> DataFrame:
    return docs.select("row", "fold", "text", "language", F.spark_partition_id().alias("part"))


def frequent_words(docs: DataFrame, shards: int, languages: int, fraction: float, seed: int = 5) -> np.ndarray:
    """Every language's start, and words that hold more than a quarter of a shard's share in a sample; they only settle which shard owns a bigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, block in blocks(batches):
            n = np.bincount(block.tokens, minlength=len(block.vocabulary))
            own = n * shards * 8 > n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(block.vocabulary[own].view(np.int64)), pa.array(n[own]), pa.array(np.full(own.sum(), n.sum()))], names=["h", "n", "total"])

    counted = scanned(docs.sample(fraction, seed)).mapInArrow(run, "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found = counted.where(F.col("n") * shards * 4 > F.col("total")).orderBy(F.desc("n"), "h").limit(4 * shards).collect()
    return np.r_[keyed(START, np.arange(languages)), np.array([r["h"] for r in found], dtype=np.int64).view(np.uint64)]


def send_pairs(tokens: DataFrame, owners: Owners, rounds: int, turn: int) -> DataFrame:
    """Each block's distinct bigrams with their numbers, for each shard of this round one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in sent_blocks(batches):
            codes, owner, n = block.counted(owners, rounds, turn)
            v, w = block.words_of(codes)
            for p, part in owners.slices(owner):
                yield rows([(p, "pairs", name, pack(v[part], w[part], narrow(n[part])))])

    return tokens.mapInArrow(run, ROW)


def by_language(languages: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """The languages that there are, and the sum of each value over them."""
    found, at = np.unique(languages, return_inverse=True)
    return [found, *(np.bincount(at, v, len(found)).astype(np.int64) for v in values)]


def starts_of(ranked: np.ndarray) -> np.ndarray:
    """Where the sorted array's different values begin."""
    return np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)


def sums_of(keys: np.ndarray, values: list[np.ndarray], made: list[Callable[[np.ndarray], np.ndarray]]) -> list[np.ndarray]:
    """The distinct keys, ascending, and for each value the sums over them of what is made of it."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = starts_of(ranked)
    return [ranked[new], *(np.add.reduceat(f(x), new, dtype=np.int64) for x in (v[order] for v in values) for f in made)]


def merge_pairs(sent: DataFrame, owners: Owners, rounds: int) -> DataFrame:
    """Each block's answers from a shard's sorted bigram hashes, what its words add up to (kind words and their shard's round; block w: contexts in both folds; block v: for each fold tokens after it, and its followers seen once, twice, more often), and the numbers of its languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, 0):
            shard, names = group[0][0], [g[2] for g in group]
            v, w, n = zip(*(unpack(g[3]) for g in group))
            group.clear()
            ends = np.cumsum([len(x) for x in v])
            second = np.repeat([tag_of(x) % 2 == 1 for x in names], np.diff(np.r_[0, ends]))
            v, w, n = np.concatenate(v), np.concatenate(w), np.concatenate(n).astype(np.int64)
            keys = pair_hash(v, w)
            order = np.argsort(keys)
            keys, n, second = keys[order], n[order], second[order]
            new = starts_of(keys)
            v, w = v[order[new]], w[order[new]]
            n = [np.add.reduceat(np.where(second == f, n, 0), new) for f in (False, True)]
            model = Mapped(keys[new], *map(narrow, n))
            first, other = model.look_up(keys)
            answer = np.empty(len(order), np.result_type(first, other))
            answer[order] = np.where(second, first, other)
            del keys, order, second, new, model, first, other
            for name, a, z in zip(names, [0, *ends.tolist()], ends.tolist()):
                yield rows([(shard, "answer", name, pack(narrow(answer[a:z])))])
            del answer
            follows = sums_of(w, n, [lambda x: x > 0])
            leads = sums_of(v, n, [lambda x: x, lambda x: x == 1, lambda x: x == 2, lambda x: x > 2, lambda x: x == 3, lambda x: x == 4])
            del v, w, n
            yield rows([(shard, "numbers", "", pack(*by_language(language_of(leads[0]), [leads[6 * f + k] for f in (0, 1) for k in (2, 3, 5, 6)])))])
            for kind, words in (("w", follows), ("v", [*leads[:5], *leads[7:11]])):
                to = owners.word(words[0])
                order = by_owner(to, owners.shards)
                for q, part in owners.slices(to[order]):
                    yield rows([(q, f"words{q % rounds}", kind, pack(words[0][order[part]], *(narrow(x[order[part]]) for x in words[1:])))])

    # A round's shards are those of one remainder.
    at = F.floor(F.col("shard") / rounds).cast("int")
    return sent.repartitionById(-(-owners.shards // rounds), at).sortWithinPartitions("shard").mapInArrow(run, ROW)


def merge_words(sums: DataFrame, owners: Owners, rounds: int) -> DataFrame:
    """For each shard its sorted words with the sums of each fold (kind words, block the fold): contexts that it follows, tokens after it, its followers seen once, twice, more often. And the numbers of its languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, 0):
            shard, kinds = group[0][0], {k: [[np.zeros(0, np.uint64), *[np.zeros(0, np.uint8)] * n]] for k, n in (("w", 2), ("v", 8))}
            for g in group:
                kinds[g[2]].append(unpack(g[3]))
            group.clear()
            (follows, *contexts), (leads, *after) = ([np.concatenate(x) for x in zip(*kinds[k])] for k in ("w", "v"))
            keys = np.concatenate([follows, leads])
            order = np.argsort(keys)
            ranked = keys[order]
            new = starts_of(ranked)
            at = np.empty(len(keys), np.int64)
            at[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(keys)]))
            keys, cut = ranked[new], len(follows)
            del ranked, order
            told = []
            for f in (0, 1):
                more = np.bincount(at[:cut], contexts[f], len(keys)).astype(np.int64)
                told += [more, more == 1, more == 2, more == 3, more == 4, more > 2]
                words = [more, *(np.bincount(at[cut:], x, len(keys)).astype(np.int64) for x in after[4 * f : 4 * f + 4])]
                there = (more > 0) | (words[1] > 0)
                yield rows([(shard, "words", str(f), pack(keys[there], *(narrow(x[there]) for x in words)))])
            yield rows([(shard, "numbers", "", pack(*by_language(language_of(keys), told)))])

    at = F.floor(F.col("shard") / rounds).cast("int")
    return sums.repartitionById(-(-owners.shards // rounds), at).sortWithinPartitions("shard").mapInArrow(run, ROW)


class Totals:
    """What holds for a whole language in each fold: discounts, continuations, and the weight left to spelling."""

    def __init__(self, numbers: np.ndarray):
        """numbers: by fold, language and NUMBERS."""
        self.pair = np.array([[discounts(x[6:10].astype(float)) for x in fold] for fold in numbers]).reshape(2, -1, 4)
        self.word = np.array([[discounts(x[1:5].astype(float)) for x in fold] for fold in numbers]).reshape(2, -1, 4)
        self.continuations = np.maximum(numbers[..., 0], 1)
        taken = (self.word[..., 1:] * numbers[..., [1, 2, 5]]).sum(-1)
        self.rest = np.where(numbers[..., 0] > 0, taken / self.continuations, 1.0)

    @classmethod
    def read(cls, pairs: DataFrame, words: DataFrame, languages: int) -> Totals:
        """Sums what shards tell of each language; the driver gets some numbers for each."""

        def told(first: int, each: int) -> Callable:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for data in b.column(0).to_pylist():
                        found, *values = unpack(data)
                        for i, x in enumerate(values):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i // each)), pa.array(found), pa.array(np.full(len(found), first + i % each)), pa.array(x)], names=["fold", "language", "number", "n"])

            return run

        schema = "fold long, language long, number long, n long"
        each = words.select("data").mapInArrow(told(0, 6), schema).unionByName(pairs.select("data").mapInArrow(told(6, 4), schema))
        numbers = np.zeros((2, languages, NUMBERS), np.int64)
        for r in each.groupBy("fold", "language", "number").agg(F.sum("n").alias("n")).toLocalIterator():
            numbers[r["fold"], r["language"], r["number"]] = r["n"]
        return cls(numbers)

    def words(self, fold: int, language: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of words, by their sums in the fold: tokens after them, the weight left to what follows whatever is before, log10 of that left to spelling, and discounted contexts."""
        more, after, *followers = sums
        left = (self.pair[fold][language][:, 1:] * np.array(followers).T).sum(1)
        weight = np.where(after > 0, left / np.maximum(after, 1), 1.0)
        return np.maximum(after, 1), weight, np.log10(weight * self.rest[fold][language]), more - self.word[fold][language, np.minimum(more, 3)]

    def logs(self, fold: int, language: np.ndarray, found: np.ndarray, before: tuple[np.ndarray, np.ndarray, np.ndarray], kept: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """log10 of the probability of bigrams: their number in the fold, what is known of the first word, and the discounted contexts and the spelling of the second."""
        after, weight, spared = before
        own = (found - self.pair[fold][language, np.minimum(found, 3)]) / after + weight * kept / self.continuations[fold][language]
        letters = spared + spelt
        return np.where(own > 0, np.log10(np.maximum(own, 1e-300) + 10 ** np.maximum(letters, -300)), letters)


def send_words(tokens: DataFrame, owners: Owners) -> DataFrame:
    """Each block's distinct words, for each shard one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in sent_blocks(batches):
            owner = owners.word(block.vocabulary)
            order = by_owner(owner, owners.shards)
            for q, part in owners.slices(owner[order]):
                yield rows([(q, "~ask", name, pack(block.vocabulary[order[part]]))])

    return tokens.mapInArrow(run, ROW)


def answer_words(words: DataFrame, asked: DataFrame, owners: Owners) -> DataFrame:
    """For each block and shard the sums of its words in the fold that `words` are of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, 0):
            own = [g for g in group if g[1] == "words"]
            model = Mapped(*(unpack(own[0][3]) if own else [np.zeros(0, np.uint64)] * 6))
            for g in group:
                if g[1] != "words":
                    yield rows([(g[0], "words", g[2], pack(*map(narrow, model.look_up(unpack(g[3])[0]))))])

    return words.unionByName(asked).repartitionById(owners.shards, "shard").sortWithinPartitions("shard", F.col("kind") == "~ask").mapInArrow(run, ROW)


def score_blocks(tokens: DataFrame, answers: DataFrame, owners: Owners, totals: Totals, rounds: int) -> DataFrame:
    """Puts each block's answers to its tokens and sums them up by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, 2):
            other = 1 - tag_of(group[0][2]) % 2
            ids, spelt, block = unpacked(next(g[3] for g in group if g[1] == "tokens"))
            lengths, languages = block.lengths, language_of(block.vocabulary)
            pair_answers, word_answers = (sorted((g for g in group if g[1] == kind), key=lambda g: g[0]) for kind in ("answer", "words"))
            codes = block.codes()
            order = np.argsort(codes)
            ranked = codes[order]
            new = starts_of(ranked)
            at = np.empty(len(codes), np.int64)
            at[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(codes)]))
            codes = ranked[new]
            del order, ranked, new
            found = np.empty(len(codes), np.int64)
            found[block.dealt(owners, codes)[1]] = np.concatenate([unpack(g[3])[0] for g in pair_answers])
            order = by_owner(owners.word(block.vocabulary), owners.shards)
            sums = np.empty((5, len(order)), np.int64)
            for to, c in zip(sums, zip(*(unpack(g[3]) for g in word_answers))):
                to[order] = np.concatenate(c)
            group.clear()
            *before, kept = totals.words(other, languages, sums)
            del sums, order, pair_answers, word_answers
            each = np.empty(len(codes))
            for i in range(0, len(codes), SLICE):
                own = slice(i, i + SLICE)
                v, w = codes[own] >> 32, codes[own] & 0xFFFFFFFF
                each[own] = totals.logs(other, languages[w], found[own], [x[v] for x in before], kept[w], spelt[w] / STEPS)
            score = np.add.reduceat(each[at], np.cumsum(lengths) - lengths)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lengths), pa.array(-score / lengths)], names=["row", "n_tokens", "log_ppl"])

    return tokens.unionByName(answers).repartition(max(1, 4 * owners.shards // rounds), "block").sortWithinPartitions("block").mapInArrow(run, "row long, n_tokens long, log_ppl double")


def word_perplexity(docs: DataFrame, languages: list[str], setup: Callable[[], Spelling], sample: float = 0.02, shard_bytes: int = SHARD, rounds: int = 6) -> DataFrame:
    """(row, n_tokens, log_ppl) of docs (row, fold, text, language): log10 of the perplexity for each word and the end.

    fold is 0 or 1; language is a place in `languages`, of which there may be
    2^20. setup makes a task's spelling model. rounds is even, so that those of
    blocks are of one fold each and read only the other's words.
    """
    if len(languages) > 1 << (64 - BITS):
        raise ValueError(f"over {1 << (64 - BITS)} languages")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    owners = Owners(shards, frequent_words(docs, shards, len(languages), sample))
    tokens = stored(send_tokens(docs, setup), "rules-tokens")
    paths = [f"{shared_folder(spark).rstrip('/')}/rules-pairs-{uuid.uuid4().hex}" for _ in range(rounds)]
    merged = [stored_kinds(merge_pairs(send_pairs(tokens, owners, rounds, i), owners, rounds), path=p) for i, p in enumerate(paths)]
    kind = lambda df, k: df.where(F.col("kind") == k).select(*ROW_NAMES)
    of_pairs = lambda k: reduce(DataFrame.unionByName, [kind(m, k) for m in merged])
    summed = []
    for i in range(rounds):
        summed.append(stored_kinds(merge_words(of_pairs(f"words{i}"), owners, rounds), "rules-words"))
        for p in paths:
            remove(spark, f"{p}/kind=words{i}")
    words = reduce(DataFrame.unionByName, summed)
    totals = Totals.read(of_pairs("numbers"), kind(words, "numbers"), len(languages))
    done = []
    for i in range(rounds):
        own, tag = tokens.where(F.col("shard") % rounds == i), F.substring_index("block", "-", 1).cast("int")
        known = kind(words, "words").where(F.col("block") == str(1 - i % 2))
        answers = answer_words(known, send_words(own, owners), owners).unionByName(of_pairs("answer").where(tag % rounds == i))
        done.append(stored(score_blocks(own, answers, owners, totals, rounds), "rules-scores"))
    return reduce(DataFrame.unionByName, done)
