"""Quality rules: repetition counts, and bands of n-gram perplexity.

The models are modified Kneser-Ney over word bigrams, one for each language,
in `words`. Below them, words are judged by their spelling: modified
Kneser-Ney trigram models over UTF-8 bytes, counted in Spark, one over each
language and one over the whole corpus. Every language
has a model of its own, interpolated with the whole corpus's by the bytes that
it was counted from, so that little text leans on the whole. Keys are three
bytes, which fit in 24 bits, so that a model has at most 2^24 entries however
large its text; it is made in one task and stored as sorted arrays. A file of
all arrays goes to each executor's disk once, and workers map it into memory.
Perplexity bands are set for each language from the quartiles of its own
documents.
"""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grove.storage import shared_folder

from .common import SPACE_WORD_RE, remainder, stored
from .lm import GOLDEN, drawn, hashed_words, mix
from .words import AS_IT_IS, CHUNK, Spelling, parts_of, word_perplexity

REPEAT, SYMBOLS, PIECE = 5, "#*$%&|<>", 1 << 20
#: Bytes of text at which a language's own counts weigh as much as the whole corpus's model; bytes of stored arrays in a row; steps of log perplexity in a unit.
EVEN, ROW_BYTES, STEPS = 1 << 14, 1 << 22, 10_000
PAD, END, SPACE = 2, 3, 32
#: Bytes that begin a code point of a word; of SYMBOLS; newlines.
COUNTED, SYMBOL, NEWLINE = (np.array([f(c) for c in range(256)], np.uint8) for f in (lambda c: c != 32 and not 9 <= c <= 13 and c & 0xC0 != 0x80, lambda c: chr(c) in SYMBOLS, lambda c: c == 10))


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier one."""
    lines, seen = 0, set()
    for line in text.split("\n"):
        if SPACE_WORD_RE.search(line):
            lines += line in seen
            seen.add(line)
    return lines


def repeated_words(words: list[str], starts: Iterable[int]) -> int:
    """Words in windows found twice or more among those at the ascending starts."""
    grams = [(i, tuple(words[i : i + REPEAT])) for i in starts]
    times, repeated, reach = Counter(gram for _, gram in grams), 0, 0
    for i, gram in grams:
        if times[gram] > 1:
            repeated += i + REPEAT - max(i, reach)
            reach = i + REPEAT
    return repeated


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = SPACE_WORD_RE.findall(text)
    n = len(words)
    repeated, windows = 0, n - REPEAT + 1
    if windows > 1 and len(set(zip(*(words[i:] for i in range(REPEAT))))) < windows:
        repeated = repeated_words(words, range(windows))
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated


def rule_columns(texts: pa.Array) -> list[np.ndarray]:
    """rule_counts of each text. Words and their windows are hashed; only windows whose hashes are equal are compared."""
    texts = pc.fill_null(texts, "")
    words, n = hashed_words(texts, AS_IT_IS, chunk=CHUNK)
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    some, made = np.flatnonzero(np.diff(edges)), np.zeros((5, len(texts)), np.int64)
    made[0] = n
    for to, of in zip(made[1:], (COUNTED, SYMBOL, NEWLINE)):
        if len(some):
            to[some] = np.add.reduceat(of[raw], edges[some] - edges[0], dtype=np.int64)
    lined = np.flatnonzero(made[3]).tolist()
    made[3] = 0
    for i in lined:
        made[3, i] = repeated_lines(texts[i].as_py())
    of_words, last = np.repeat(np.arange(len(n)), n), max(0, len(words) - REPEAT + 1)
    inside = np.flatnonzero(of_words[:last] == of_words[REPEAT - 1 :])
    windows = sum((words[i : i + last] * x for i, x in enumerate(drawn(REPEAT, 1 << 42))), np.zeros(last, np.uint64))[inside]
    windows = mix(windows + of_words[inside].astype(np.uint64) * GOLDEN)
    order = np.argsort(windows)
    same, equal = np.zeros(len(order), bool), np.diff(windows[order]) == 0
    same[order[1:][equal]] = same[order[:-1][equal]] = True
    starts = inside[same]
    at = of_words[starts]
    starts -= (np.cumsum(n) - n)[at]
    cuts = [*np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist(), len(at)] if len(at) else []
    for a, z in zip(cuts, cuts[1:]):
        made[4, at[a]] = repeated_words(SPACE_WORD_RE.findall(texts[int(at[a])].as_py()), starts[a:z].tolist())
    return list(made)


def byte_trigrams(text: str | None) -> Iterator[np.ndarray]:
    """The keys of all byte trigrams of the text between two pads and an end, in pieces of bounded length."""
    data = np.frombuffer(bytes([PAD, PAD]) + (text or "").encode() + bytes([END]), np.uint8)
    for at in range(0, len(data) - 2, PIECE):
        part = data[at : at + PIECE + 2].astype(np.int32)
        yield part[:-2] << 16 | part[1:-1] << 8 | part[2:]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def count_trigrams(docs: DataFrame, text_col: str, language_col: str) -> DataFrame:
    """(language, key, n) of all byte trigrams of all texts; each task sums up its own first, and hands on what it has once that is PIECE entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: Counter[str] = Counter()
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def count(language: str) -> None:
            keys, n = np.unique(np.concatenate(held.pop(language)), return_counts=True)
            size[language] = 0
            sums[language] = merged([sums[language], (keys, n)]) if language in sums else (keys, n)

        def handed() -> Iterator[pa.RecordBatch]:
            for language, (keys, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(keys), pa.string()), pa.array(keys.astype(np.int32)), pa.array(n.astype(np.int64))], names=["language", "key", "n"])
            sums.clear()

        for b in batches:
            for text, language in zip(b.column(0), b.column(1).to_pylist()):
                for keys in byte_trigrams(text.as_py()):
                    held.setdefault(language, []).append(keys)
                    size[language] += len(keys)
                    if size[language] > PIECE:
                        count(language)
            for language in list(held):
                count(language)
            if sum(len(k) for k, _ in sums.values()) > PIECE:
                yield from handed()
        yield from handed()

    made = docs.select(text_col, language_col).mapInArrow(run, "language string, key int, n long")
    return made.groupBy("language", "key").agg(F.sum("n").alias("n"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """The discounts for counts 0, 1, 2 and 3 or more, from the counts of counts."""
    n = [float((counts == k).sum()) for k in (1, 2, 3, 4)]
    if min(n) <= 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))])


class ByteModel:
    """Interpolated modified Kneser-Ney over byte trigrams: sorted keys with log probabilities, and what unseen ones back off to."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, counts = keys[order].astype(np.int32), counts[order].astype(np.float64)
        bigrams = np.bincount(self.keys & 0xFFFF, minlength=1 << 16).astype(np.float64)
        unigrams = np.bincount(np.flatnonzero(bigrams) & 0xFF, minlength=1 << 8).astype(np.float64)
        low, rest = self._smoothed(unigrams, np.zeros(1 << 8, np.int64), 1)
        single = low + rest[0] / 256 if len(self.keys) else np.full(256, 1 / 256)
        two, rest = self._smoothed(bigrams, np.arange(1 << 16) >> 8, 1 << 8)
        self.two = two + np.repeat(rest, 256) * np.tile(single, 256)
        three, self.rest = self._smoothed(counts, self.keys >> 8, 1 << 16)
        self.logs = np.log10(three + self.rest[self.keys >> 8] * self.two[self.keys & 0xFFFF]).astype(np.float32)
        self.two, self.rest = self.two.astype(np.float32), self.rest.astype(np.float32)

    @staticmethod
    def _smoothed(counts: np.ndarray, context: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
        """The discounted probability of each entry and the weight that each context leaves to the lower order."""
        d = discounts(counts)[np.minimum(counts, 3).astype(np.int64)]
        total = np.bincount(context, counts, contexts)
        safe = np.maximum(total, 1)
        left = np.where(total > 0, np.bincount(context, d, contexts) / safe, 1.0)
        return (counts - d) / safe[context], left

    def unseen(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of trigrams that aren't among the keys."""
        return np.log10(self.rest[keys >> 8] * self.two[keys & 0xFFFF])

    def logs_of(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the trigrams' probabilities."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if known.all():
            return self.logs[at]
        found = np.empty(len(keys))
        found[known] = self.logs[at[known]]
        found[~known] = self.unseen(keys[~known])
        return found

    def log_probability(self, text: str | None) -> tuple[float, int]:
        """log10 of the text's probability, and the number of bytes with the end."""
        total, n = 0.0, 0
        for keys in byte_trigrams(text):
            total += float(self.logs_of(keys).sum(dtype=np.float64))
            n += len(keys)
        return total, n

    def after_space(self, data: np.ndarray) -> np.ndarray:
        """The probabilities of bytes behind a space, whatever is before that."""
        return self.two[SPACE << 8 | data.astype(np.int32)]

    def spelt(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of words (places in raw) between two spaces; one without bytes is the end."""
        some = sizes > 0
        found = np.log10(self.after_space(np.where(some, raw[np.minimum(starts, len(raw) - 1)] if len(raw) else END, END)))
        starts, sizes = starts[some], sizes[some]
        if len(sizes):
            ends = np.cumsum(sizes)
            place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            at = np.repeat(starts, sizes) + place
            before = np.where(place == 0, SPACE, raw[at - 1]).astype(np.int32)
            after = np.where(place == np.repeat(sizes, sizes) - 1, SPACE, raw[np.minimum(at + 1, len(raw) - 1)]).astype(np.int32)
            found[some] += np.add.reduceat(self.logs_of(before << 16 | raw[at].astype(np.int32) << 8 | after).astype(np.float64), ends - sizes)
        return found

    @functools.cached_property
    def arrays(self) -> list[np.ndarray]:
        return [self.keys, self.logs, self.two, self.rest]


class MixedModel(ByteModel):
    """A language's model and, with the rest of the share, the whole corpus's: logs of its keys hold both, other trigrams ask both."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, two: np.ndarray, rest: np.ndarray, share: float, whole: ByteModel | None):
        self.keys, self.logs, self.two, self.rest, self.share, self.whole = keys, logs, two, rest, share, whole

    @classmethod
    def of(cls, own: ByteModel, size: int, whole: ByteModel) -> MixedModel:
        """own was counted from `size` bytes."""
        share = size / (size + EVEN)
        logs = np.log10(share * 10.0**own.logs + (1 - share) * 10.0 ** whole.logs_of(own.keys)).astype(np.float32)
        return cls(own.keys, logs, own.two, own.rest, share, whole)

    def unseen(self, keys: np.ndarray) -> np.ndarray:
        if self.whole is None:
            return super().unseen(keys)
        return np.log10(self.share * self.rest[keys >> 8] * self.two[keys & 0xFFFF] + (1 - self.share) * 10.0 ** self.whole.logs_of(keys))

    def after_space(self, data: np.ndarray) -> np.ndarray:
        own = super().after_space(data)
        return own if self.whole is None else self.share * own + (1 - self.share) * self.whole.after_space(data)


@functools.cache
def mapped_file(name: str) -> np.ndarray:
    return np.asarray(np.memmap(SparkFiles.get(name), np.uint8, "r"))


class Models:
    """Models by language in a file that Spark brings to each executor; `whole` holds what they are interpolated with."""

    def __init__(self, name: str, places: dict[str, tuple[int, int, float]], whole: Models | None):
        self.name, self.places, self.whole = name, places, whole

    def of(self, language: str) -> ByteModel:
        at, entries, share = self.places[language]
        data, cuts = mapped_file(self.name), np.cumsum([at, 4 * entries, 4 * entries, 4 << 16, 4 << 16]).tolist()
        arrays = [data[a:z].view(t) for a, z, t in zip(cuts, cuts[1:], (np.int32, np.float32, np.float32, np.float32))]
        return MixedModel(*arrays, share, self.whole.of("") if self.whole else None)


def model_rows(counts: DataFrame, whole: Models | None) -> DataFrame:
    """(language, entries, share, piece, data) from (language, key, n): each language's model, made in one task from its at most 2^24 trigrams, in pieces."""

    def made(language: str, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, n = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        model, share = ByteModel(keys, n), 1.0
        if whole is not None:
            model = MixedModel.of(model, int(n.sum()), whole.of(""))
            share = model.share
        entries, data = len(keys), memoryview(b"".join(a.tobytes() for a in model.arrays))
        for i in range(0, len(data), ROW_BYTES):
            values = [[language], [entries], [share], [i // ROW_BYTES], [bytes(data[i : i + ROW_BYTES])]]
            types = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["language", "entries", "share", "piece", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for b in batches:
            names = b.column(0).dictionary_encode()
            places = names.indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), b.num_rows]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                language = names.dictionary[int(places[first])].as_py()
                if parts and language != current:
                    yield from made(current, parts)
                current = language
                parts.append((b.column(1).to_numpy(zero_copy_only=False)[first:last].copy(), b.column(2).to_numpy(zero_copy_only=False)[first:last].copy()))
        if parts:
            yield from made(current, parts)

    sent = counts.select("language", "key", "n").repartition("language").sortWithinPartitions("language", "key")
    return sent.mapInArrow(run, "language string, entries int, share double, piece int, data binary")


def model_file(spark: SparkSession, rows: DataFrame, whole: Models | None) -> Models:
    """The models of a stored table as one file in the shared folder, from where executors fetch it; the driver holds some pieces of ROW_BYTES at a time."""
    name, places, at = f"rules-models-{uuid.uuid4().hex}", {}, 0
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        for r in rows.orderBy("language", "piece").toLocalIterator():
            if r["piece"] == 0:
                places[r["language"]] = (at, r["entries"], r["share"])
            out.write(bytearray(r["data"]))
            at += len(r["data"])
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return Models(name, places, whole)


def train_bytes(docs: DataFrame, text_col: str, language_col: str) -> Models:
    """A model for each language, interpolated with one of all texts. On an executor's disk they take 8 bytes for each different trigram of a language and 512 KB for each language."""
    spark = docs.sparkSession
    counts = stored(count_trigrams(docs, text_col, language_col), "rules-counts")
    everything = counts.groupBy("key").agg(F.sum("n").alias("n")).select(F.lit("").alias("language"), "key", "n")
    whole = model_file(spark, stored(model_rows(everything, None), "rules-whole"), None)
    return model_file(spark, stored(model_rows(counts, whole), "rules-languages"), whole)


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
CHANGED = "a later reading of the table differs from the first: store it before judging it"
#: Spark deletes a query's shuffle files once it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def counted_rules(docs: DataFrame) -> DataFrame:
    """row, doc_id, language and the rule counts of docs (row, doc_id, language, text)."""
    made = StructType.fromDDL(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last in parts_of(b.column(3), PIECE):
                part = b.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, rule_columns(part.column(3)))], names=["row", "doc_id", "language", *made.names])

    keep = docs.select("row", "doc_id", "language", "text")
    return keep.mapInArrow(run, StructType([*keep.schema.fields[:3], *made]))


def perplexities(rows: DataFrame) -> DataFrame:
    """(row, n_tokens, log_ppl) of rows (row, doc_id, language, text): halves by doc_id, each scored with the other's words."""
    models = train_bytes(rows, "text", "language")
    languages = sorted(models.places)
    places = rows.sparkSession.createDataFrame(pa.table({"language": pa.array(languages, pa.string()), "place": pa.array(range(len(languages)), pa.int32())}))
    docs = rows.withColumn("fold", remainder("doc_id", 2).cast("int")).join(F.broadcast(places), "language").select("row", "fold", "text", F.col("place").alias("language"))

    def setup() -> Spelling:
        of = functools.cache(models.of)
        return lambda language, *words: of(languages[language]).spelt(*words)

    return word_perplexity(docs, languages, setup)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = 3.0, above: float = 1.5, rescannable: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, log_ppl (log10 of the perplexity for each word and the end), its band, and kept.

    A document is kept if the base rules pass and its perplexity lies in its
    language's band: from `below` times the distance of the quartiles under
    the lower one to `above` times it over the upper one. The quartiles are
    those of the different perplexities of all that language's documents
    that pass the base rules, in steps of 1/10000, so that copies count once.
    One row per row; a
    null or empty text has no words and fails; a null language is a language
    of its own; rows that repeat an id are judged one by one; an empty table
    gives no rows. The table is read several times and must give the same
    partitions each time, as plain files do; without rescannable, ids,
    languages and texts are stored first.
    """
    language = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), language.alias("language"), F.col(text_col).alias("text"))
    named = (named if rescannable else stored(named, "rules-texts")).withColumn("row", F.monotonically_increasing_id())
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = counted_rules(named)
    with shuffles_deleted(docs.sparkSession):
        scored = F.when(F.col("n_tokens") == F.col("n_words") + 1, F.col("log_ppl")).otherwise(F.raise_error(F.lit(CHANGED)).cast("double"))
        judged = counts.join(perplexities(named), "row", "left").withColumns({"log_ppl": scored, "base_failed": failed}).drop("row", "n_tokens")
        judged = stored(judged, "rules")
    different = judged.where(~F.col("base_failed")).select("language", "log_ppl").distinct()
    steps = different.groupBy("language", F.floor(F.col("log_ppl") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("language")
    ranked = steps.select("language", "step", (F.sum("n").over(own.orderBy("step")) / F.sum("n").over(own)).alias("upto"))
    quarters = ranked.groupBy("language").agg(*[(F.min(F.when(F.col("upto") >= q, F.col("step"))) / STEPS).alias(name) for q, name in ((0.25, "low"), (0.75, "high"))])
    distance = F.col("high") - F.col("low")
    bands = stored(quarters.select("language", (F.col("low") - below * distance).alias("lower"), (F.col("high") + above * distance).alias("upper")), "rules-bands")
    kept = ~F.col("base_failed") & F.col("log_ppl").between(F.col("lower"), F.col("upper"))
    return judged.join(bands, "language", "left").withColumn("kept", F.coalesce(kept, F.lit(False))).drop("language")
