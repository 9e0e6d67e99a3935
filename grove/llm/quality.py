"""Quality classifier: a linear-chain conditional random field labels every line of a document good or bad.

Lines are described by their own and their neighbours' features. The field is
fitted on a bounded sample of labelled documents, whose lines take the
document's label; a document's score is the mean marginal of "good" over its
lines, weighted by their length.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, remainder

SYMBOLS = "#*$%&<>"
CLASSES = bytes(
    ord("U") if 65 <= c <= 90 else ord("l") if 97 <= c <= 122 or c >= 128 else ord("d") if 48 <= c <= 57 else ord("s") if chr(c) in SYMBOLS else ord("|") if c == 124 else ord("!") if c == 33 else ord(" ") if c in (32, *range(9, 14)) else ord("p")
    for c in range(256)
)
OWN, LONGEST_CHAIN = 17, 256


def line_features(text: str | None) -> tuple[np.ndarray, list[int]]:
    """A row of OWN features for each line, and the lines' lengths; an empty text is one empty line."""
    lines, seen, rows = (text or "").split("\n"), set(), []
    for line in lines:
        words = line.split()
        n, kinds = len(words), line.encode().translate(CLASSES)
        size = len(kinds)
        if not n:
            rows.append((1.0, *[0.0] * (OWN - 1)))
            continue
        letters = max(1, size - kinds.count(b" "))
        pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
        key = hash(line)
        rows.append((
            0.0, math.log1p(n), math.log1p(size), letters / n / 10,
            kinds.count(b"U") / letters, kinds.count(b"d") / letters, kinds.count(b"s") / letters, kinds.count(b"|") / n, kinds.count(b"!") / n, kinds.count(b"p") / n,
            len(set(words)) / n, pairs, sum(map(eq, words, words[1:])) / n, sum(map(str.isupper, words)) / n, float(key in seen), float(line[-1:] in ".!?"), float(n < 4),
        ))
        seen.add(key)
    return np.array(rows), [len(x) for x in lines]


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Each line's features, the previous line's, the next line's, a bias and whether it is first or last."""
    none = np.zeros((1, own.shape[1]))
    edge = np.zeros((len(own), 3))
    edge[:, 0], edge[0, 1], edge[-1, 2] = 1, 1, 1
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), edge])


class LineField:
    """A two-state chain: emission weights for "good" against "bad", and a transition score for each pair of states."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.transition, self.mean, self.scale = weights, transition, mean, scale

    def scaled(self, own: np.ndarray) -> np.ndarray:
        return np.clip((own - self.mean) / self.scale, -4, 4)

    def marginals(self, own: np.ndarray) -> list[float]:
        """Forward-backward: for each line the probability that it is good."""
        odds = np.clip(with_neighbours(self.scaled(own)) @ self.weights, -30, 30).tolist()
        (bb, bg), (gb, gg) = np.exp(self.transition).tolist()
        ahead, good, bad = [], 0.5, 0.5
        for i, x in enumerate(odds):
            if i:
                good, bad = good * gg + bad * bg, good * gb + bad * bb
            good *= math.exp(x)
            total = good + bad
            good, bad = good / total, bad / total
            ahead.append((good, bad))
        out, good, bad = [0.0] * len(odds), 1.0, 1.0
        for i in range(len(odds) - 1, -1, -1):
            g, b = ahead[i][0] * good, ahead[i][1] * bad
            out[i] = g / (g + b)
            g, b = good * math.exp(odds[i]), bad
            good, bad = gg * g + gb * b, bg * g + bb * b
            total = good + bad
            good, bad = good / total, bad / total
        return out

    def score(self, text: str | None) -> float:
        own, lengths = line_features(text)
        p = self.marginals(own)
        total = sum(lengths)
        return sum(x * n for x, n in zip(p, lengths)) / total if total else sum(p) / len(p)


def fit_field(samples: list[np.ndarray], labels: np.ndarray, rounds: int = 250, rate: float = 0.08, penalty: float = 2e-3) -> LineField:
    """Maximises the penalised likelihood of the line labels with Adam; all documents step through their lines together."""
    n, longest = len(samples), max(map(len, samples))
    rows = np.vstack(samples)
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    field = LineField(np.zeros(3 * OWN + 3), np.zeros((2, 2)), mean, scale)
    order = np.argsort([-len(s) for s in samples], kind="stable")
    x = [with_neighbours(field.scaled(samples[i])) for i in order]
    y = np.asarray(labels, dtype=np.int64)[order]
    alive = [int((np.array([len(s) for s in x]) > t).sum()) for t in range(longest)]
    steps = [np.array([x[d][t] for d in range(alive[t])]) for t in range(longest)]
    n_lines = sum(alive)
    theta, m, v = np.zeros(3 * OWN + 7), 0.0, 0.0
    for step in range(1, rounds + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        power = np.exp(trans - trans.max())
        emit = [np.stack([np.ones(a), np.exp(np.clip(s @ w, -30, 30))], 1) for s, a in zip(steps, alive)]
        forward = []
        for t, a in enumerate(alive):
            f = emit[t] * (forward[-1][:a] @ power if t else 0.5)
            forward.append(f / f.sum(1, keepdims=True))
        grad_w, grad_t, back = np.zeros(len(w)), np.zeros((2, 2)), np.ones((n, 2))
        for t in range(longest - 1, -1, -1):
            a = alive[t]
            post = forward[t] * back[:a]
            post /= post.sum(1, keepdims=True)
            grad_w += steps[t].T @ (y[:a] - post[:, 1])
            if t:
                onward = emit[t] * back[:a]
                joint = forward[t - 1][:a, :, None] * power[None] * onward[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                grad_t -= joint.sum(0)
                np.add.at(grad_t, (y[:a], y[:a]), 1)
                new = onward @ power.T
                back[:a] = new / new.sum(1, keepdims=True)
        grad = np.r_[grad_w, grad_t.ravel()] / n_lines - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field.weights, field.transition = theta[:-4], theta[-4:].reshape(2, 2)
    return field


#: Bytes of a label's sample, and the largest part of them that one document may be.
SAMPLE_BYTES, LARGEST_PART, LINE_BYTES = 16 << 20, 32, 64


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str, text_col: str, modulus: int = 5, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(_id, text, y) of labelled documents whose crc32 remainder isn't 0, drawn by a hash of the id: at most per_class for each label, and at most sample_bytes of text (a line counts LINE_BYTES besides).

    Of an id that documents or labels repeat, one text and one label count.
    Documents of more than a LARGEST_PART-th of the bytes aren't drawn. Only
    per_class ids are broadcast, whatever the size of the tables.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (remainder(id_col, modulus) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    draw = F.xxhash64("_id", F.lit(7))
    drawn = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(draw, "_id").limit(per_class)
        drawn = part if drawn is None else drawn.union(part)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.octet_length("text") + LINE_BYTES * F.regexp_count("text", F.lit("\n"))
    found = texts.join(F.broadcast(drawn), "_id").withColumn("size", size.cast("long")).where(F.col("size") * LARGEST_PART <= sample_bytes)
    found = found.groupBy("_id", "y").agg(F.min("text").alias("text"), F.min("size").alias("size"))
    so_far = F.sum("size").over(Window.partitionBy("y").orderBy(draw, "_id"))
    return found.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes).select("_id", "text", "y")


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> LineField | None:
    """The field fitted on the sample; None if it lacks one of the labels. Tasks make the features, so that texts don't go to the driver; long documents are fitted as several chains."""

    def row(text, y):
        return line_features(text)[0].astype(np.float32).tobytes(), y

    made = map_rows(labelled_sample(docs, labels, label, per_class, id_col, text_col), ["text", "y"], ["_id"], "rows binary, y int", lambda: row).orderBy("_id").collect()
    if len({r["y"] for r in made}) < 2:
        return None
    chains = [(whole[i : i + LONGEST_CHAIN], r["y"]) for r in made for whole in [np.frombuffer(r["rows"], np.float32).reshape(-1, OWN).astype(float)] for i in range(0, len(whole), LONGEST_CHAIN)]
    return fit_field([c for c, _ in chains], np.array([y for _, y in chains]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, threshold: float = 0.3, train_docs: DataFrame | None = None) -> DataFrame:
    """The columns in keep (the id by default), held_out, score and predicted.

    One row per row of docs, scored in one pass without a shuffle. A null or
    empty text is one empty line; rows that repeat an id are scored one by
    one; without labels of both kinds every score is 0.5; an empty table
    gives no rows.
    """
    field = train_quality(docs if train_docs is None else train_docs, labels, id_col=id_col, text_col=text_col)

    def setup() -> Callable[[str | None], tuple]:
        return lambda text: (float(field.score(text)) if field else 0.5,)

    scored = map_rows(docs.withColumn("held_out", remainder(id_col, 5) == 0), [text_col], [*(keep or (id_col,)), "held_out"], "score double", setup)
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
