import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grove.llm.html import Layouts, decode, describe, extract, extract_pages, parse
from grove.llm.lm import Block, Mapped, Owners, hashed_words, pack, score_texts, unpack
from grove.llm.quality import LineField, labelled_sample, line_features, score_quality
from grove.llm.rules import EVEN, ByteModel, apply_rules, byte_trigrams, rule_counts
from grove.llm.toxicity import score_toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def discounts(counts):
    n = [sum(1 for x in counts.values() if x == k) for k in (1, 2, 3, 4)]
    if min(n) <= 0:
        return [0, 0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


def brute_scores(rows):
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    docs = [[*SPACE_WORD.findall((r[1] or "").translate(LOWER)), None] for r in rows]
    pairs, words = collections.Counter(), collections.Counter()
    for d, h in zip(docs, held):
        if not h:
            words.update(d)
            pairs.update(zip(["\n", *d[:-1]], d))
    total, kinds = sum(words.values()), len(words)
    more, after, classes = collections.Counter(w for _, w in pairs), collections.Counter(), collections.defaultdict(lambda: [0] * 4)
    for (v, _), n in pairs.items():
        after[v] += n
        classes[v][min(n, 3)] += 1
    d2, d1, s = discounts(pairs), discounts(more), sum(more.values())
    rest = sum(d1[min(x, 3)] for x in more.values()) / s if s else 1
    single = lambda w: max(more[w] - d1[min(more[w], 3)], 0) / max(1, s) + rest / (kinds + 1)

    def double(v, w):
        if not after[v]:
            return single(w)
        n = pairs.get((v, w), 0)
        return max(n - d2[min(n, 3)], 0) / after[v] + sum(d2[k] * classes[v][k] for k in (1, 2, 3)) / after[v] * single(w)

    return [(r[0], h, len(d), sum(w in words for w in d), total, sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in d), sum(math.log10(double(v, w)) for v, w in zip(["\n", *d[:-1]], d))) for r, d, h in zip(rows, docs, held)]


@pytest.mark.parametrize("shard_bytes", [1 << 30, 40_000])
def test_scores_equal_brute_force(docs, rows, empty, shard_bytes):
    found = score_texts(docs, sample=0.5, shard_bytes=shard_bytes).collect()
    assert score_texts(empty).count() == 0
    key = lambda r: (repr(r[0]), r[2])
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(brute_scores(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:7] == pytest.approx(b[5:], rel=1e-9) and a[7] == pytest.approx(10 ** (-b[6] / b[2]), rel=1e-9)


def test_changed_readings_are_noticed(docs):
    changing = docs.select("doc_id", F.concat_ws(" ", "text", F.current_timestamp().cast("string")).alias("text"))
    with pytest.raises(Exception, match="differs from the first"):
        score_texts(changing, rescannable=True).collect()


def test_packed_arrays():
    draw = np.random.default_rng(1)
    arrays = [np.sort(draw.integers(0, 2**63, 1000).astype(np.uint64)), draw.integers(-5, 5, 7), draw.random(3), np.zeros(0, np.uint32), np.array([5, 3], np.uint32)]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_hashed_words():
    texts = [None, "", "A b\ta", " \n", "é" * 100 + " x", "b", "a b"]
    hashes, counts = hashed_words(pa.array(texts))
    assert counts.tolist() == [0, 0, 3, 0, 2, 1, 2]
    words = [w for t in texts for w in SPACE_WORD.findall((t or "").translate(LOWER))]
    assert {(a == b) == (x == y) for a, x in zip(words, hashes) for b, y in zip(words, hashes)} == {True}
    block = Block.read(pa.array(texts))
    codes, owner = block.pairs(Owners(3, block.vocabulary[:2]))
    parts = list(Owners.slices(owner))
    assert len(codes) == len(set(block.codes().tolist())) and (np.diff(owner) >= 0).all() and [p for p, _ in parts] == sorted(set(owner.tolist()))
    assert all((owner[part] == p).all() for p, part in parts) and sum(part.stop - part.start for _, part in parts) == len(codes)
    draw = np.random.default_rng(4)
    long = ["".join(draw.choice(list("ab"), 64 * 5)) for _ in range(200)] + ["".join(c * 64 for c in x) for x in ("abba", "baab", "aabb", "bbaa", "abab")]
    assert len(set(hashed_words(pa.array(long))[0].tolist())) == len(set(long))


def test_mapped_arrays():
    draw = np.random.default_rng(3)
    keys = np.unique(draw.integers(0, 2**63, 5000).astype(np.uint64))
    model = Mapped(keys[::2].copy(), np.arange(len(keys[::2]), dtype=np.uint64) + np.uint64(1))
    assert isinstance(model.keys, np.memmap)
    found = model.look_up(keys)[0]
    assert (found[::2] == np.arange(len(keys[::2])) + 1).all() and (found[1::2] == 0).all()
    assert Mapped(keys[:0], keys[:0]).look_up(keys[:3])[0].tolist() == [0, 0, 0]


def brute_rules(text):
    words = SPACE_WORD.findall(text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if SPACE_WORD.search(line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), twice, len(covered)


def test_rules(docs, rows, empty, texts):
    for text in [*texts, "a b c d e f a b c d e", "a a a a a a a", "x\nx\n\n\nx", "1 2 3 4 5 1 2 3 4 5 9 1 2 3 4 5"]:
        assert rule_counts(text) == brute_rules(text)
    found = apply_rules(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] is failed and not (failed and r["kept"])
    assert apply_rules(empty).count() == 0


def test_rule_columns(texts):
    """A batch's counts are those of its texts one by one, of slices too."""
    from grove.llm.rules import rule_columns

    told = [*texts, None, "", " \n ", "a b c d e f a b c d e", "a a a a a a a", "x\nx\n\n\nx", "1 2 3 4 5 1 2 3 4 5 9 1 2 3 4 5", "é #ü\x0b& ü\x85x $", "a b c d", "e a b c d e"]
    for first in (0, 3):
        found = rule_columns(pa.array(told, pa.string()).slice(first))
        assert list(zip(*(c.tolist() for c in found))) == [brute_rules(t) for t in told[first:]]
    assert [len(c) for c in rule_columns(pa.array([], pa.string()))] == [0] * 5


def test_blocks_are_of_one_fold(spark):
    """A block asks for one fold's numbers only; the numbers of shards, most of which own few words or none that leads, change no score."""
    from grove.llm.words import blocks, word_perplexity

    rows = [(i, i % 3 % 2, None if i == 7 else " ".join("abcdefg"[(i * j) % 7] for j in range(i % 11)), i % 2) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.int32()))] + [pa.array([4] * 60, pa.int32())], names=["row", "fold", "text", "language", "part"])
    found = list(blocks(iter([batch])))
    assert [tag for tag, *_ in found] == [8, 9] and sum(part.num_rows for _, _, part, _ in found) == 60
    assert all(set(part.column(1).to_pylist()) == {tag % 2} for tag, _, part, _ in found)

    docs = spark.createDataFrame(rows, "row long, fold int, text string, language int").repartition(2)
    setup = lambda: lambda language, raw, starts, sizes: -1.0 - sizes
    one, many = ({r["row"]: tuple(r) for r in word_perplexity(docs, ["x", "y"], setup, shard_bytes=n, rounds=2).collect()} for n in (1 << 20, 60))
    assert set(one) == {r[0] for r in rows} and one == many


def test_bands_reject_in_each_language(spark):
    """Above the band: texts of odd words among their language's own, though another language is made of those words; below: a text whose copies are much of its language."""
    import random

    draw, rows = random.Random(4), []
    parts = {"aa": ["ka", "to", "ri", "mes", "lun"], "bb": ["xo", "qu", "zy", "pfi", "wug"], None: ["ell", "ost", "and", "ire", "ung"]}
    mixed = [p for x in parts.values() for p in x]
    for i in range(1200):
        lang = ["aa", "bb", None][i % 3]
        odd = i % 20 == 0
        rows.append((i, " ".join("".join(draw.choices(mixed if odd else parts[lang], k=draw.randint(1, 3))) for _ in range(60)), lang, odd))
    rows += [(2000 + i, rows[1][1], "bb", False) for i in range(900)]
    found = {r["doc_id"]: r for r in apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, odd boolean")).collect()}
    assert len(found) == len(rows) and not any(r["base_failed"] for r in found.values())
    assert not any(found[r[0]]["kept"] for r in rows if r[3])
    plain = [r[0] for r in rows if not r[3] and r[0] < 2000]
    assert sum(found[i]["kept"] for i in plain) > 0.95 * len(plain)
    usual = sorted(found[i]["log_ppl"] for i in plain if i % 3 == 1)
    assert all(found[r[0]]["log_ppl"] > usual[-1] for r in rows if r[3] and r[0] % 3 == 1)
    assert not any(found[r[0]]["kept"] for r in rows[1200:]) and found[2000]["log_ppl"] < usual[len(usual) // 4]


def test_trigram_counts_by_language(spark, docs, rows):
    from grove.llm.rules import count_trigrams, train_bytes

    named = docs.selectExpr("text", "coalesce(lang, '') as language")
    wanted = collections.Counter((r[2] or "", int(k)) for r in rows for keys in byte_trigrams(r[1]) for k in keys)
    assert {(r["language"], r["key"]): r["n"] for r in count_trigrams(named, "text", "language").collect()} == wanted
    models = train_bytes(named, "text", "language")
    assert set(models.places) == {"en", "de", ""}
    everything = collections.Counter()
    for (_, k), n in wanted.items():
        everything[k] += n
    whole = ByteModel(np.array(list(everything)), np.array(list(everything.values())))
    for language in models.places:
        own = {k: n for (x, k), n in wanted.items() if x == language}
        model, share = ByteModel(np.array(list(own)), np.array(list(own.values()))), sum(own.values()) / (sum(own.values()) + EVEN)
        asked = np.array([*own, *everything, 0x7A7A7A, 0x010203])
        expected = np.log10(share * 10.0 ** model.logs_of(asked) + (1 - share) * 10.0 ** whole.logs_of(asked))
        assert models.of(language).logs_of(asked) == pytest.approx(expected, abs=1e-5)


def test_languages_with_little_text(spark):
    """A language of one short document is judged by the whole corpus's model and its own few counts, in one way at every size; runs agree."""
    import random

    draw, words = random.Random(6), ["ka", "to", "ri", "mes", "lun", "dor"]
    made = lambda n: " ".join("".join(draw.choices(words, k=draw.randint(1, 3))) for _ in range(n))
    rows = [(i, made(60), "big") for i in range(400)] + [(1000 + i, made(15), f"small{i}") for i in range(40)] + [(2000, "qx" * 40, "odd")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in apply_rules(table).collect()}
    usual = sorted(found[i]["log_ppl"] for i in range(400))
    assert all(found[1000 + i]["log_ppl"] < 2 * usual[-1] for i in range(40))
    again = {r["doc_id"]: r for r in apply_rules(table.repartition(7)).collect()}
    assert again == found


def test_byte_model_equals_brute_force():
    """Interpolated modified Kneser-Ney written out with dictionaries."""
    import random

    draw = random.Random(21)
    texts = ["".join(draw.choice("abcde é") for _ in range(draw.randint(0, 60))) for _ in range(200)]
    padded = [bytes([2, 2]) + t.encode() + bytes([3]) for t in texts]
    three = collections.Counter(b[i : i + 3] for b in padded for i in range(len(b) - 2))
    two = collections.Counter(k[1:] for k in three)
    one = collections.Counter(k[1:] for k in two)

    def weights(counts):
        d, total, kinds = discounts(counts), collections.Counter(), collections.defaultdict(float)
        for k, n in counts.items():
            total[k[:-1]] += n
            kinds[k[:-1]] += d[min(n, 3)]
        return d, total, kinds

    levels = [(two_or_more, *weights(two_or_more)) for two_or_more in (one, two, three)]

    def p(k):
        counts, d, total, kinds = levels[len(k) - 1]
        below = p(k[1:]) if len(k) > 1 else 1 / 256
        if not total[k[:-1]]:
            return below
        n = counts.get(k, 0)
        return (max(n - d[min(n, 3)], 0) + kinds[k[:-1]] * below) / total[k[:-1]]

    keys, n = np.unique(np.concatenate([k for t in texts for k in byte_trigrams(t)]), return_counts=True)
    model = ByteModel(keys, n)
    for t in [*texts[:40], "zzz", "abcxyz", "ééé", ""]:
        b = bytes([2, 2]) + t.encode() + bytes([3])
        total, size = model.log_probability(t)
        assert size == len(b) - 2 and total == pytest.approx(sum(math.log10(p(b[i : i + 3])) for i in range(len(b) - 2)), rel=1e-4)


def test_byte_model_sums_to_one():
    keys, n = np.unique(np.concatenate([k for t in ("hello there", "the other one", "abc") for k in byte_trigrams(t)]), return_counts=True)
    model = ByteModel(keys, n)
    for context in (0x6865, 0x7468, 0x0101):
        total = 0.0
        for c in range(256):
            at = np.searchsorted(model.keys, context << 8 | c)
            known = at < len(model.keys) and model.keys[at] == context << 8 | c
            total += 10 ** float(model.logs[at]) if known else float(model.rest[context] * model.two[(context << 8 | c) & 0xFFFF])
        assert total == pytest.approx(1, abs=1e-4)


@pytest.fixture(scope="module")
def labelled(spark):
    """Good documents of sentences, bad ones that repeat or shout, toxic ones with words of their own."""
    import random

    draw, rows, labels = random.Random(8), [], []
    syllables = ["ka", "to", "ri", "mes", "lun", "dor", "vi", "an", "el", "ost"]
    word = lambda: "".join(draw.choices(syllables, k=draw.randint(1, 3)))
    for i in range(700):
        lines = [" ".join(word() for _ in range(draw.randint(5, 15))).capitalize() + "." for _ in range(draw.randint(2, 6))]
        bad, toxic = i % 5 == 0, i % 4 == 0
        if bad:
            lines = [" ".join(w.upper() + "!!" for w in x.split()) if draw.random() < 0.5 else " ".join([word()] * 12) for x in lines]
        if toxic:
            lines = [" ".join(x for w in line.split() for x in ([w, draw.choice(["grumblor", "snarkfest", "vilewort"])] if draw.random() < 0.3 else [w])) for line in lines]
            lines[0] += " Grumblor vilewort"
        rows.append((i, "\n".join(lines)))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "label"), [(score_quality, "quality"), (score_toxicity, "toxic")])
def test_classifiers_on_held_out_rows(labelled, docs, rows, empty, score, label):
    texts, labels = labelled
    found = score(texts, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 80 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert sum(r["predicted"] == r[label] for r in found) / len(found) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)
    assert score(docs, labels.limit(0)).count() == len(rows) and score(empty, labels).count() == 0
    unlabelled = score(texts.limit(3).union(texts.limit(3)).selectExpr("doc_id", "if(doc_id % 2 = 0, null, '') as text"), labels).collect()
    assert len(unlabelled) == 6


def test_labelled_sample_is_bounded(spark):
    """One text and label of a repeated id, no null ids, rows and bytes within the bounds, the same rows each time."""
    texts = [(i, "word " * (i % 7 + 1)) for i in range(200)] + [(7, "aaa"), (7, None), (8, "x" * 5000), (None, "no id")] * 3
    labels = [(i, i % 2) for i in range(200)] + [(9, 0), (9, 1), (None, 1), (11, None), (12, 5)] * 2
    docs, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = [sorted(map(tuple, labelled_sample(d, k, "toxic", 40, "doc_id", "text", sample_bytes=n).collect())) for d, k, n in ((docs, known, 1 << 20), (docs.repartition(5), known.repartition(3), 1 << 20), (docs, known, 1500))]
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == len(found[0]) and all(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 for r in found[0])
    assert collections.Counter(r[2] for r in found[0]) == {0: 40, 1: 40} and dict((r[0], r[1]) for r in found[0]).get(7, "") == ""
    assert all(0 < sum(len(r[1]) + 64 * r[1].count("\n") for r in found[2] if r[2] == y) <= 1500 for y in (0, 1))


def test_scores_do_not_see_held_out_labels(labelled):
    texts, labels = labelled
    wrong = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "score").collect()))
    assert key(score_quality(texts, labels)) == key(score_quality(texts, wrong))


def test_chain_marginals():
    draw = np.random.default_rng(2)
    own, lengths = line_features("a b c\nD E\n\nx | y | z\nx | y | z")
    assert len(own) == len(lengths) == 5
    field = LineField(draw.normal(0, 0.3, 3 * own.shape[1] + 3), draw.normal(0, 1, (2, 2)), np.zeros(own.shape[1]), np.ones(own.shape[1]))
    from itertools import product

    from grove.llm.quality import with_neighbours

    odds, weight = with_neighbours(field.scaled(own)) @ field.weights, collections.Counter()
    for states in product((0, 1), repeat=5):
        w = math.exp(sum(o for o, s in zip(odds, states) if s) + sum(field.transition[a, b] for a, b in zip(states, states[1:])))
        weight["all"] += w
        for i, s in enumerate(states):
            weight[i] += w * s
    assert field.marginals(own) == pytest.approx([weight[i] / weight["all"] for i in range(5)], rel=1e-9)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy it now, cheap.</div>
<article><h1>Head &amp; line</h1><p><b>First  words
of it.<br><p>Second block, with <a href="x">a link</a> and &eacute;&#33;</p><ul><li>one<li>two</ul><form><p>sign up</p></form><table><tr><td>cell<td>other</table></article>
<aside class="sidebar"><h3>More</h3><p>Some other text here.</p></aside><section id="comments"><p>I like it.</p></section><footer>&copy; site &middot; all</footer></body></html>"""


def test_main_text(trees):
    assert extract(PAGE, trees) == "Head & line\nFirst words of it.\nSecond block, with a link and é!\none\ntwo\ncell\nother"
    assert extract(None, trees) == extract("", trees) == ""
    assert extract(PAGE[:700], trees).startswith("Head & line\nFirst words of it.")
    assert extract("<div" * 2000, trees) == ""
    extract("<div><p>deep " * 5000, trees)


@pytest.mark.parametrize(("bare", "least"), [(0.0, 0.98), (1.0, 0.9)])
def test_held_out_layouts(trees, bare, least):
    """Also on layouts without any class or id."""
    rows, labels = zip(*Layouts(99, bare).rows(60))
    assert ((trees.odds(np.array(rows)) > 0) == np.array(labels)).mean() > least


def test_decoding_is_consistent_and_best():
    import random
    from itertools import product

    draw = random.Random(6)
    for _ in range(30):
        root = parse("<div><p>a</p><ul><li>b</li><li>c</li></ul></div><p>d</p>")
        nodes, _rows = describe(root)
        odds = [draw.uniform(-2, 2) for _ in nodes]
        decode(root, nodes, odds)

        def allowed(keep):
            state = {id(n): k for n, k in zip(nodes, keep)}
            return all(not k or n.parent.tag == "#root" or state[id(n.parent)] for n, k in zip(nodes, keep))

        value = lambda keep: sum(o if k else -o for o, k in zip(odds, keep))
        best = max((k for k in product((True, False), repeat=len(nodes)) if allowed(k)), key=value)
        assert value([n.keep for n in nodes]) == pytest.approx(value(best)) and allowed([n.keep for n in nodes])


def test_pages(spark, trees):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (3, "v", "", "z"), (4, "w", "plain words", "z")], "page_id long, url string, html string, text string")
    found = sorted(map(tuple, extract_pages(pages, trees=trees).collect()), key=repr)
    assert len(found) == 5 and found[0] == found[1] and found[0][3] == len(found[0][2])
    assert [f[2] for f in found[2:]] == ["", "", "plain words"]
    assert extract_pages(pages.limit(0), trees=trees).count() == 0


def test_perplexity_counts_words(spark):
    """op8's perplexity against word bigrams written out with dictionaries, for two languages and halves; the same words in another order, which byte trigrams hardly tell apart, are less likely."""
    import random

    from grove.llm.common import remainder
    from grove.llm.rules import train_bytes

    draw, rows = random.Random(9), []
    ring = {"x": "da ko mi su re la".split(), "y": "da um ko or mi ti el".split()}
    for i in range(300):
        words, at = ring["xy"[i % 2]], draw.randrange(6)
        told = [words[(at + j + (draw.random() < 0.1)) % len(words)] for j in range(40)]
        if i % 30 > 27:
            draw.shuffle(told)
        rows.append((i, " ".join(told) if i else " ".join([*told, "é", "neu"]), "xy"[i % 2]))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["log_ppl"] for r in apply_rules(table).collect()}
    assert min(found[i] for i in found if i % 30 > 27) > max(found[i] for i in found if i and i % 30 <= 27)

    folds = {r["doc_id"]: r["f"] for r in table.select("doc_id", remainder("doc_id", 2).alias("f")).collect()}
    models = train_bytes(table.selectExpr("text", "concat('=', lang) AS language"), "text", "language")
    pairs = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        words = [None, *text.split(), ""]
        pairs[lang, folds[i]].update(zip(words, words[1:]))
    for i, text, lang in rows[:60]:
        counts, model = pairs[lang, 1 - folds[i]], models.of("=" + lang)
        more, after = collections.Counter(w for _, w in counts), collections.Counter()
        two, one = (discounts(c) for c in (counts, more))
        left, rest = collections.Counter(), sum(one[min(n, 3)] for n in more.values()) / len(counts)
        for (v, _), n in counts.items():
            after[v] += n
            left[v] += two[min(n, 3)]
        words, score = [None, *text.split(), ""], 0.0
        for v, w in zip(words, words[1:]):
            raw = np.frombuffer(w.encode(), np.uint8)
            spelt = 10.0 ** model.spelt(raw, np.array([0]), np.array([len(raw)]))[0]
            lower = (more[w] - one[min(more[w], 3)]) / len(counts) + rest * spelt
            own = (counts[v, w] - two[min(counts[v, w], 3)]) / after[v] if after[v] else 0.0
            score += np.log10(own + (left[v] / after[v] if after[v] else 1.0) * lower)
        assert found[i] == pytest.approx(-score / (len(words) - 1), abs=2e-3)
