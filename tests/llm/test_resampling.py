import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from grove.llm.common import numbered
from grove.llm.common import stored as put
from grove.llm.resampling import CountTrie, GainTrie, resample, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def brute(docs, target, longest, buckets, least, percent):
    bucket = lambda f: crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in runs(t, longest)[0])
    t = Counter(bucket(f) for x in target for f in runs(x, longest)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, x in docs:
        own, n = runs(x, longest)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = drawn[: len(drawn) * percent // 100]
    ranks = Counter()
    for place, r in enumerate(drawn, 1):
        ranks[r[:4]] = [*(ranks[r[:4]] or []), place]
    for r in rows:
        place = ranks[r[:4]].pop(0) if ranks[r[:4]] else None
        yield (*r[:4], place)


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 60)])
def test_resample(spark, docs, rows, texts, longest, buckets, percent):
    target = [texts[3], texts[7], None, "", "The of AND gamma", texts[3]]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, score long")
    found = resample(docs, bench, longest=longest, buckets=buckets, percent=percent, keep=("lang", "key"))
    assert found.columns == ["doc_id", "lang", "key", "n_features", "weight", "score", "rank"]
    got = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute([(r[0], r[1]) for r in rows], target, longest, buckets, 20, percent)))


def test_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame([(1, "of the")], "item_id long, text string")
    assert resample(empty, bench).count() == 0
    assert resample(docs, bench.limit(0)).count() == docs.count()
    named = spark.createDataFrame([("a", "x y"), ("b", None), (None, "z " * 30)], "doc_id string, text string")
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in resample(named, bench, percent=100).collect()} == {("a", 2, None), ("b", 0, None), (None, 30, 1)}


def test_tries_begin_anew():
    """Tries of a few nodes count and weigh what large ones do."""
    draw = random.Random(4)
    texts = [[draw.choice([b"a", b"b", b"c", b"d%d" % draw.randrange(40)]) for _ in range(draw.randrange(60))] for _ in range(30)]
    large, small = CountTrie(3, 50), CountTrie(3, 50, most_nodes=10)
    for t in texts:
        large.add(t)
        small.add(t)
        assert small.size < 10 + 3 * len(t)
    large.flush()
    small.flush()
    assert (large.totals == small.totals).all() and large.totals.sum() == sum(max(0, len(t) - i) for t in texts for i in range(3))
    gains = [draw.randrange(-9, 9) for _ in range(50)]
    one, other = GainTrie(gains, 3), GainTrie(gains, 3, most_nodes=10)
    assert [one.weigh(t) for t in texts] == [other.weigh(t) for t in texts] == [sum(gains[crc32(b" ".join(t[i : i + n])) % 50] for n in (1, 2, 3) for i in range(len(t) - n + 1)) for t in texts]
    assert words_of("Ab-c d1 É") == [b"ab", b"c", b"d1", "É".encode()]


def test_numbers_over_ranges(spark):
    """One group with most rows, and equal rows, are numbered over several ranges."""
    draw = random.Random(8)
    rows = [(7 if draw.random() < 0.8 else draw.randrange(20), draw.choice([None, 1, 2, draw.randrange(100)])) for _ in range(5000)]
    table = put(spark.createDataFrame(rows, "g long, x long").repartition(6), "numbered-test")
    found = numbered(table, [table.x.asc_nulls_first()], "g", "numbered-ranges").collect()
    place = lambda x: -1 if x is None else x
    for g in {r[0] for r in rows}:
        own = sorted((r["number"], place(r["x"])) for r in found if r["g"] == g)
        assert own == list(enumerate(sorted(place(x) for h, x in rows if h == g)))
