"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded labelled sample: one on
ordinary text, one on toxic text. Each window of a text is compressed with
either, and the difference of the lengths, summed up and at its most, goes
through a calibrated logistic threshold.

Most of a toxic document is like an ordinary one; dictionaries of whole texts
then differ by chance more than by class (see README for figures). So toxic
text enters its dictionary in two parts: what it shares with ordinary text is
the same bytes as in the ordinary dictionary, where it cancels, and the
segments that toxic documents have far more often stand in front of it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, remainder
from .quality import labelled_sample

WINDOW, LEVEL, ORDINARY_BYTES, TOXIC_BYTES = 100, 6, 32_768, 16_384
STEP, DEEPEST, CLEAR, TOXIC_WEIGHT = 41, 15, (1, 2, 4), 0.3
SHORTEST, LONGEST, LIFT, EVIDENCE, LEAST, SHINGLE, MINIMA, SAMPLE_PIECE = 4, 12, 8.0, 20.0, 4, 5, 4, 800
EDGES = "\"'()[]{}.,;:!?#*$%&|<>"


def words_of(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


def starts_of(words: Iterable[str]) -> set[str]:
    """The words' beginnings of SHORTEST to LONGEST letters."""
    return {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def one_of_each(texts: list[str]) -> list[str]:
    """The texts without near copies of earlier ones, told by any of the smallest hashes of their word shingles; copies would make their rare words look typical."""
    seen, kept = set(), []
    for text in texts:
        words = words_of(text)
        hashes = {zlib.crc32(" ".join(words[i : i + SHINGLE]).encode()) for i in range(max(1, len(words) - SHINGLE + 1))}
        minima = {(k, min((h * m) & 0xFFFFFFFF for h in hashes)) for k, m in enumerate((1, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[:MINIMA])}
        if not minima & seen:
            kept.append(text)
        seen |= minima
    return kept


def evidence(n: int, of: int, m: int, among: int) -> float:
    """The likelihood-ratio statistic that n of `of` and m of `among` documents differ in their share."""
    share, total = (n + m) / (of + among), 0.0
    for k, size in ((n, of), (m, among)):
        total += k * math.log(k / size / share) if k else 0.0
        total += (size - k) * math.log((1 - k / size) / (1 - share)) if k < size else 0.0
    return 2 * total


def marked_starts(toxic: list[str], ordinary: list[str]) -> dict[str, int]:
    """Word beginnings that a toxic document has at least LIFT times as often as an ordinary one, beyond chance, and how many toxic ones have them; no share is asked for, so that a language with few toxic documents isn't drowned."""
    seen = [Counter(), Counter()]
    for counter, texts in zip(seen, (toxic, ordinary)):
        for text in texts:
            counter.update(starts_of(set(words_of(text))))
    of, among = len(toxic), len(ordinary)
    return {s: n for s, n in seen[0].items() if n >= LEAST and n / of >= LIFT * (seen[1][s] + 1) / among and evidence(n, of, seen[1][s], among) >= EVIDENCE}


def segment_of(word: str, marks: dict[str, int]) -> str:
    """The marked beginning that tells the word: the longest that is at least half as common as the most common one; empty if none is marked."""
    found = [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1) if word[:k] in marks]
    most = max((marks[s] for s in found), default=0)
    return max((s for s in found if 2 * marks[s] >= most), key=len, default="")


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; too few or too short ones are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def aligned(text: str) -> np.ndarray:
    """The lower-cased bytes, each moved by its place within its word, so that matches only align with word beginnings."""
    data = np.frombuffer(b" " + text.lower().encode(), np.uint8)
    at = np.arange(len(data), dtype=np.int32)
    start = np.maximum.accumulate(np.where((data <= 32), at, 0))
    return data + (np.minimum(at - start, DEEPEST) * STEP).astype(np.uint8)


class CompressionDistance:
    """The two dictionaries and the calibration of what windows save."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float] | None = None):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights or [0.0] * (len(CLEAR) + 4)

    def compressors(self) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
        made = []
        size = len(self.toxic) + len(self.ordinary)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=size, min_match=5, write_content_size=False, write_dict_id=False)
        for data in (b"\0" * len(self.toxic) + self.ordinary, self.toxic + self.ordinary):
            raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(compression_params=params, dict_data=raw).compress)
        return made[0], made[1]

    def features(self, text: str | None, plain: Callable[[bytes], bytes], both: Callable[[bytes], bytes]) -> tuple[float, ...]:
        """Logs of the number of windows that save CLEAR bytes or more, of the bytes these save and of all windows' number, and the most saved in one window."""
        data = aligned(text or "")
        spaces = np.flatnonzero(data == 32)
        saved, at = [], 0
        while at < len(data):
            cut = int(np.searchsorted(spaces, at + WINDOW))
            end = len(data) if at + WINDOW >= len(data) else int(spaces[cut - 1]) if spaces[cut - 1] > at else at + WINDOW
            piece = data[at:end].tobytes()
            saved.append(len(plain(piece)) - len(both(piece)))
            at = end
        clear = [sum(s >= least for s in saved) for least in CLEAR]
        return *map(math.log1p, (*clear, sum(s for s in saved if s >= CLEAR[0]), len(saved))), max(saved) / 10

    def score(self, features: tuple[float, ...]) -> float:
        x = sum(w * f for w, f in zip(self.weights, (*features, 1.0)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> list[float]:
    """Weights and bias by Newton steps; all toxic rows together weigh TOXIC_WEIGHT."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, TOXIC_WEIGHT / max(1, (y == 1).sum()), (1 - TOXIC_WEIGHT) / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hessian, x.T @ (weight * (y - p)) - penalty * w), -5, 5)
    return w.tolist()


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> CompressionDistance | None:
    """The dictionaries from two thirds of at most per_class labelled documents and SAMPLE_BYTES a label, the calibration from the rest; None without both labels."""
    rows = labelled_sample(docs, labels, label, per_class, id_col, text_col).orderBy("_id").collect()
    texts = [[r["text"] or "" for r in rows if r["y"] == y] for y in (0, 1)]
    if not texts[0] or not texts[1]:
        return None
    own = [[t for i, t in enumerate(x) if i % 3 or len(x) < 9] for x in texts]
    rest = [[t for i, t in enumerate(x) if not i % 3 or len(x) < 9] for x in texts]
    marks = marked_starts(one_of_each(own[1]), one_of_each(own[0]))
    segments = [f" {s}" for t in own[1] for w in words_of(t) if (s := segment_of(w, marks))]
    toxic = trained([aligned("".join(segments[i : i + 24]).strip()).tobytes() for i in range(0, len(segments), 24)] or [b" "], TOXIC_BYTES)
    ordinary = trained([aligned(t[i : i + SAMPLE_PIECE]).tobytes() for t in own[0] for i in range(0, len(t), SAMPLE_PIECE)], ORDINARY_BYTES)
    model = CompressionDistance(toxic, ordinary)
    plain, both = model.compressors()
    x = np.array([model.features(t, plain, both) for y in (0, 1) for t in rest[y]])
    model.weights = fit_logistic(x, np.repeat([0, 1], [len(rest[0]), len(rest[1])]))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, threshold: float = 0.5) -> DataFrame:
    """The columns in keep (the id by default), held_out, score and predicted.

    One row per row of docs, in one pass without a shuffle, over all windows
    of the text. A null or empty text has no windows and saves nothing; rows
    that repeat an id are scored one by one; without labels of both kinds
    every score is 0; an empty table gives no rows.
    """
    model = train_toxicity(docs, labels, id_col=id_col, text_col=text_col)

    def setup() -> Callable[[str | None], tuple]:
        if model is None:
            return lambda text: (0.0,)
        plain, both = model.compressors()
        return lambda text: (model.score(model.features(text, plain, both)),)

    scored = map_rows(docs.withColumn("held_out", remainder(id_col, 5) == 0), [text_col], [*(keep or (id_col,)), "held_out"], "score double", setup)
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
