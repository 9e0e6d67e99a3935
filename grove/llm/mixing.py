"""Mixing sources to target weights: subset-sum budget fitting.

Documents are counted by exact token length within each source. A source's
budget is met by whole passes over it, then a proportional share of every
length, from long to short, each making good what the longer ones missed,
then bounded-knapsack dynamic programs that take some of it back and choose
anew: a little at first, everything where that fits.
The plan names only how many documents of each length to add; which ones is
settled by a seeded hash, ranked in buckets so that no length, however
common, has to be ranked in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, stored


#: Bits of all bit sets of a dynamic program over a whole source, and words taken back for a small one.
WHOLE_BITS, LITTLE = 1 << 30, 1 << 12


def knapsack(lengths: list[int], counts: list[int], budget: int, above: bool = False) -> list[int]:
    """How many of each length to take so that the total is as near below budget as it can be; with `above`, as near as it can be, below on ties.

    Bounded-knapsack reachability on bit sets: bit b is set once some choice
    sums to b; counts enter by binary splitting, and the bit set before each
    piece is kept for walking back.
    """
    most = 2 * budget if above else budget
    mask, reach, steps = (1 << (most + 1)) - 1, 1, []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        count, piece = min(count, most // length if length else 0), 1
        while count > 0:
            piece = min(piece, count)
            steps.append((i, piece, reach))
            reach |= (reach << (piece * length)) & mask
            count, piece = count - piece, piece * 2
        if reach >> budget & 1:
            break
    at, took = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1, [0] * len(lengths)
    if over := reach >> budget:
        up = (over & -over).bit_length() - 1
        at = budget + up if up < budget - at else at
    for i, piece, before in reversed(steps):
        if not before >> at & 1:
            took[i] += piece
            at -= piece * lengths[i]
    return took


def proportional(lengths: list[int], counts: list[int], rest: int) -> list[int]:
    """About the same share of every length, rest words at most: from long to short, each evens out what the longer ones missed, and leaves no more than the shorter ones hold if it can."""
    total = sum(a * b for a, b in zip(lengths, counts))
    took, seen, left = [0] * len(lengths), 0, rest
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length, count = lengths[i], counts[i]
        if length:
            seen += length * count
            wanted = round((rest * seen / total - (rest - left)) / length)
            needed = -((total - seen - left) // length)
            took[i] = max(0, min(max(wanted, needed), left // length, count))
            left -= took[i] * length
    return took


def fit_budget(lengths: np.ndarray, counts: np.ndarray, target: float, max_repeat: int, dp_budget: int) -> tuple[int, np.ndarray]:
    """Whole passes over a source, and the number of documents of each length to add to them.

    Their words come as near to the target as they can, above it too, in
    sources whose dynamic program fits WHOLE_BITS. In all others no exchange of
    one document for another, and none that is added or left out, comes
    nearer: with n different lengths in the plan and beside it that is about
    the longest one's length over n squared.
    """
    total = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), dtype=np.int64)
    if not total or target <= 0:
        return 0, extra
    goal = round(min(target, max_repeat * total))
    passes = goal // total
    rest = goal - passes * total
    if passes >= max_repeat or not rest:
        return passes, extra
    sizes, have = lengths.tolist(), counts.tolist()

    def missed(took: list[int]) -> int:
        return rest - sum(a * b for a, b in zip(sizes, took))

    def filled(took: list[int]) -> list[int]:
        """took with documents added, the longest that fit first; then one that goes beyond, where that comes nearer."""
        took = list(took)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            if sizes[i]:
                took[i] += max(0, min(have[i] - took[i], missed(took) // sizes[i]))
        lacks, spare = missed(took), [i for i in range(len(sizes)) if sizes[i] and took[i] < have[i]]
        if spare and 0 < sizes[i := min(spare, key=sizes.__getitem__)] < 2 * lacks:
            took[i] += 1
        return took

    def again(took: list[int], most: int, of_each: int | None) -> list[int]:
        """took with up to of_each of each length taken back, shortest first and within most words, and chosen anew."""
        left, room = list(took), most - missed(took)
        for i in sorted(range(len(sizes)), key=sizes.__getitem__):
            if sizes[i] and room > 0:
                back = min(took[i] if of_each is None else min(took[i], of_each), room // sizes[i])
                left[i] -= back
                room -= back * sizes[i]
        if missed(left) <= 0:
            return left
        added = knapsack(sizes, [a - b for a, b in zip(have, left)], missed(left), above=True)
        return [a + b for a, b in zip(left, added)]

    def swapped(took: list[int]) -> list[int]:
        """took with documents exchanged one for one (or added, or left out) as long as that comes nearer; each exchange is the best of all."""
        took, own = list(took), np.array(sizes, dtype=np.int64)
        while lacks := missed(took):
            now = np.array(took)
            out, into = np.unique(np.append(own[now > 0], 0)), np.unique(np.append(own[(now < counts) & (own > 0)], 0))
            wanted = into - lacks
            at = np.searchsorted(out, wanted).clip(1, len(out) - 1) if len(out) > 1 else np.zeros(len(into), np.int64)
            nearest = np.where(np.abs(out[at] - wanted) < np.abs(out[at - 1] - wanted), out[at], out[at - 1])
            k = int(np.abs(wanted - nearest).argmin())
            if abs(int(wanted[k] - nearest[k])) >= abs(lacks):
                break
            for length, change in ((int(into[k]), 1), (int(nearest[k]), -1)):
                if length:
                    took[sizes.index(length)] += change
        return took

    best = filled(proportional(sizes, have, rest))
    steps = sum(c.bit_length() for c in have)
    whole = 2 * rest * steps <= WHOLE_BITS
    for most, of_each in ((LITTLE, 1), (dp_budget, 1), (rest if whole else dp_budget, None)):
        if missed(best) and (whole or abs(missed(best)) <= most):
            best = min(best, again(best, max(most, missed(best)), of_each), key=lambda took: abs(missed(took)))
    best = swapped(best)
    return passes, np.array(best, dtype=np.int64)


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """Adds weight and target to one row per source (source, source_size).

    Sources take the weights in code-point order, null last. Shares stop at
    max_repeat times a source's size; the excess is shared by weight again,
    which only moves one number, the budget per unit of weight, until no
    further source stops. Positions come from a range partitioning, so the
    list of sources is never in one task.
    """
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "mix-sources")
    starts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    starts = starts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    spot = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("start")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("spot"), F.lit(len(weights))) + 1).cast("int"))
    weighed = stored(ranged.join(starts, "part").withColumn("spot", spot).withColumn("weight", weight).drop("part", "start"), "mix-weights")
    limit, per_weight = F.col("source_size") * float(max_repeat), 0.0
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    while total:
        stopped = limit <= F.col("weight") * per_weight
        fixed, free = weighed.agg(F.sum(F.when(stopped, limit).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))).first()
        if not free or (new := (total - fixed) / free) <= per_weight * (1 + 1e-12):
            break
        per_weight = new
    return weighed.withColumn("target", F.least(limit, F.col("weight") * F.lit(per_weight)))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeat: int = 3,
    seed: int = 20240229,
    dp_budget: int = 1 << 15,
    buckets: int = 1024,
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, copies, and the row's key where row_col names one.

    size counts the white-space words of the text. A null or empty text has
    size 0 and takes nothing; a null source is a source of its own; rows that
    repeat an id are separate documents; an empty table gives no rows; further
    columns of docs are ignored. Ties in the hash fall to the id, then to the
    row's key, so reruns agree. Each source's taken words are the nearest
    reachable sum where the whole dynamic program fits WHOLE_BITS, and the
    nearest that exchanges come to elsewhere (see fit_budget).
    A source's plan is made in one task from its different lengths and their
    counts, not from its documents.
    """
    row = [F.col(row_col).alias("_row")] if row_col else []
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE_WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)).alias("draw"),
        *row,
    )
    sized = sized.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    sized = stored(sized, "mix-sizes")
    sources = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = stored(source_targets(sources, weights, max_repeat), "mix-targets")

    histogram = sized.groupBy("key", "size", "bucket").agg(F.count("*").alias("n"))
    lengths = histogram.groupBy("key", "size").agg(F.sum("n").alias("n")).join(targets.select("key", "target"), "key")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        passes, extra = fit_budget(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), float(pdf["target"].iloc[0]), max_repeat, dp_budget)
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "passes": passes, "extra": extra})

    planned = lengths.groupBy("key").applyInPandas(plan, "key string, size long, passes long, extra long")
    before = F.sum("n").over(Window.partitionBy("key", "size").orderBy("bucket")) - F.col("n")
    dealt = histogram.join(planned, ["key", "size"]).withColumn("add", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - before)))
    place = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("draw", "doc_id", *(["_row"] if row else [])))
    chosen = sized.join(dealt.select("key", "size", "bucket", "passes", "add"), ["key", "size", "bucket"])
    chosen = chosen.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + F.when(place <= F.col("add"), 1).otherwise(0)).otherwise(0))
    return chosen.join(targets.select("key", "source_size", "target"), "key").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("long").alias("copies"), *([F.col("_row").alias(row_col)] if row else []))
