import collections
import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from grove.llm.decontamination import find_contamination
from grove.llm.mixing import fit_budget, knapsack, mix_sources
from grove.llm.pii import find_spans, redact
from grove.llm.quality import score_quality
from grove.llm.simhash import near_duplicates

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, most=3):
    """Shares in proportion to weights, stopped at `most` times the size, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        free = sum(w for s, w in weight.items() if s not in stopped)
        share = {s: most * sizes[s] if s in stopped else rest * weight[s] / free for s in names}
        new = {s for s in names if s not in stopped and share[s] > most * sizes[s]}
        if not new:
            return share
        stopped |= new


def test_knapsack():
    draw = random.Random(1)
    for _ in range(200):
        lengths = draw.sample(range(1, 30), 4)
        counts, budget = [draw.randint(0, 3) for _ in lengths], draw.randint(0, 90)
        took = knapsack(lengths, counts, budget)
        best = max(s for k in itertools.product(*(range(c + 1) for c in counts)) if (s := sum(a * b for a, b in zip(k, lengths))) <= budget)
        assert all(0 <= t <= c for t, c in zip(took, counts)) and sum(a * b for a, b in zip(took, lengths)) == best


def test_budgets():
    draw = np.random.default_rng(1)
    for _ in range(100):
        lengths = np.unique(draw.integers(0, 400, 60))
        counts = draw.integers(1, 30, len(lengths))
        total = int((lengths * counts).sum())
        target = float(draw.uniform(0, 3) * total)
        passes, extra = fit_budget(lengths, counts, target, 3, 1 << 15)
        assert 0 <= passes <= 3 and (extra >= 0).all() and (extra <= counts).all()
        assert abs(passes * total + int((extra * lengths).sum()) - target) <= 8


def test_budgets_with_long_documents():
    """The nearest reachable sum, without slack, where long documents hold much of a source."""
    passes, extra = fit_budget(np.array([1, 30_000]), np.array([10_000, 1]), 35_000.0, 3, 1 << 15)
    assert (passes, extra.tolist()) == (0, [5000, 1])
    assert fit_budget(np.array([82_000, 84_000, 85_000]), np.array([2, 3, 3]), 248_000.0, 3, 1 << 15)[1].tolist() == [2, 1, 0]
    draw = random.Random(5)
    for _ in range(300):
        lengths = sorted(draw.sample(range(1, 40), 3) + draw.sample(range(40, 90_000), draw.randint(1, 4)))
        counts = [draw.randint(1, 4) if n < 40 else 1 for n in lengths]
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        total, target = max(sums), draw.randint(1, 2 * max(sums))
        passes, extra = fit_budget(np.array(lengths), np.array(counts), float(target), 3, 1 << 15)
        assert (extra >= 0).all() and (extra <= counts).all() and passes == target // total
        assert abs(int((extra * lengths).sum()) - target % total) == min(abs(s - target % total) for s in sums)


def test_budgets_of_large_sources(monkeypatch):
    """Where the whole dynamic program is too large: off by half a short document at most, if the short ones hold more than the longest does."""
    monkeypatch.setattr("grove.llm.mixing.WHOLE_BITS", 1 << 10)
    draw = random.Random(6)
    for _ in range(300):
        lengths = sorted({draw.randint(1, 50) for _ in range(3)} | {draw.randint(60, 5000) for _ in range(8)})
        counts = [draw.randint(1, 40) if n > 50 else 6000 // n for n in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        target = draw.randint(1, 3 * total)
        passes, extra = fit_budget(np.array(lengths), np.array(counts), float(target), 3, 1 << 8)
        off = abs(passes * total + int((extra * lengths).sum()) - target)
        assert (extra >= 0).all() and (extra <= counts).all()
        assert 2 * off <= max(n for n in lengths if n <= 50)


def test_long_documents_get_their_share():
    """Long lengths that occur once are taken as often as short ones."""
    lengths = np.array([*range(1, 400), *range(5000, 20_000, 50)])
    counts = np.array([50] * 399 + [1] * 300)
    total = int((lengths * counts).sum())
    passes, extra = fit_budget(lengths, counts, total / 2, 3, 1 << 15)
    assert passes == 0 and abs(int((extra * lengths).sum()) - round(total / 2)) == 0
    assert 0.45 < extra[399:].sum() / 300 < 0.55 and 0.45 < extra[:399].sum() / counts[:399].sum() < 0.55


def test_mix(docs, rows, empty):
    found = mix_sources(docs).collect()
    assert len(found) == len(rows)
    size = {i: len(SPACE_WORD.findall(r[1] or "")) for i, r in enumerate(rows)}
    sizes = collections.Counter()
    for i, r in enumerate(rows):
        sizes[r[3]] += size[i]
    target = brute_targets(sizes)
    taken = collections.Counter()
    assert collections.Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 3)) for r in found) == collections.Counter((r[0], size[i], sizes[r[3]], round(target[r[3]], 3)) for i, r in enumerate(rows))
    for r in found:
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source_size"]] += r["taken"]
    for s, t in target.items():
        reachable = {0}
        for i, r in enumerate(rows):
            if r[3] == s:
                reachable |= {x + size[i] for x in reachable}
        passes = round(t) // sizes[s]
        nearest = min((abs(passes * sizes[s] + x - round(t)) for x in reachable)) if passes < 3 else 0
        assert abs(taken[sizes[s]] - round(t)) == nearest
    assert sorted(map(repr, mix_sources(docs.repartition(5)).collect())) == sorted(map(repr, found))
    assert mix_sources(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_is_exact_with_many_lengths(spark, seed):
    draw = random.Random(seed)
    rows = [(i, "w " * draw.randint(0, 60), draw.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix_sources(docs, buckets=8).collect()
    sums = collections.Counter()
    for r in found:
        sums[(r["source_size"], r["target"])] += r["taken"]
    assert all(abs(n - t) <= 1 for (_, t), n in sums.items())


def test_mix_takes_one_length_by_hash(spark):
    """All documents are of one length and one source: ranks come from buckets."""
    docs = spark.createDataFrame([(i, "a b", "s" if i % 9 else "t") for i in range(900)], "doc_id long, text string, source string")
    found = mix_sources(docs, buckets=4).collect()
    by = collections.Counter()
    for r in found:
        by[r["target"]] += r["taken"]
    assert all(abs(n - t) <= 1 for t, n in by.items())


@pytest.fixture
def folder(spark, tmp_path):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice(["ka", "to", "ri", "mes", "lun", "dor", "vi"]) for _ in range(draw.randint(1, 3)))
    texts, quality = [], []
    for i in range(260):
        lines = [" ".join(word() for _ in range(draw.randint(6, 14))).capitalize() + "." for _ in range(4)]
        if i % 6 == 0:
            lines = [" ".join(word().upper() + "!!" for _ in range(12)) for _ in lines]
        quality.append(int(i % 6 > 0))
        texts.append("\n".join(lines))
    bench = " ".join(word() for _ in range(30))
    texts += [texts[1], texts[1], f"{texts[7]} {bench}", f"mail me@home.org or call, {texts[8]}"]
    quality += [1, 1, 1, 1]
    docs = [(i, t, "en", f"s{i % 4}", len(t), i) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline(spark, folder):
    """Each stage against what its operator says of the stage's own input."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, labels, bench = docs.columns, spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in score_quality(docs, labels).collect() if r["predicted"] == 1}
    kept = docs.where(docs.doc_id.isin(*good))
    first = {r["doc_id"] for r in near_duplicates(kept).collect() if r["doc_id"] == r["component_id"]}
    kept = kept.where(kept.doc_id.isin(*first))
    clean = {r["doc_id"] for r in find_contamination(kept, bench).collect() if not r["contaminated"]}
    assert {260, 261} & first == set() and 262 in first - clean
    cleaned = spark.createDataFrame([(i, (t := redact(rows[i]["text"], find_spans(rows[i]["text"]))), rows[i]["lang"], rows[i]["source"], len(t), rows[i]["score"]) for i in sorted(clean)], docs.schema)
    mixed = {r["doc_id"]: r["copies"] for r in mix_sources(cleaned).collect() if r["copies"]}
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["copies"] for r in found} == mixed
    texts = {r["doc_id"]: tuple(r[c] for c in columns) for r in cleaned.collect()}
    assert all(tuple(r[c] for c in columns) == texts[r["doc_id"]] for r in found)
    assert "[EMAIL]" in texts[263][1]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), folder).count() == 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert stage(spark, docs, folder).columns == columns


def test_pipeline_decides_by_row(spark, folder):
    """Rows without an id and rows that repeat one with other texts, in every stage and through run()."""
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    some = {r["doc_id"]: r["text"] for r in docs.where("doc_id in (1, 2, 3, 4, 5, 7, 8, 9, 10, 11)").collect()}
    extra = [(None, some[1]), (None, some[1]), (None, some[2]), (None, bench), (5, some[5]), (5, some[7]), (5, some[8]), (5, f"{bench} {bench}"), (9, some[9]), (9, some[9]), (10, None), (None, None), (11, "")]
    rows = spark.createDataFrame([(i, t, "en", "s0", None, k) for k, (i, t) in enumerate(extra)], docs.schema)
    key = lambda df: sorted((repr(r["doc_id"]), r["text"] or "") for r in df.collect())
    plain = lambda left: sorted((repr(i), t or "") for i, t in left)
    first = [(None, some[1]), (None, some[2]), (None, bench), (5, some[5]), (5, some[7]), (5, some[8]), (9, some[9]), (10, None)]
    deduped = key(corpus_pipeline.near_dedup(spark, rows, folder))
    assert [x for x in deduped if bench not in x[1]] == plain([x for x in first if x[1] != bench])
    assert key(corpus_pipeline.decontamination(spark, rows, folder)) == plain([x for x in extra if bench not in (x[1] or "")])
    assert corpus_pipeline.personal_data(spark, rows, folder).count() == len(rows.collect())
    mixed = corpus_pipeline.mixing(spark, rows, folder).collect()
    held = [x for x in extra if x[1]]
    assert sum(r["size"] * r["copies"] for r in mixed) == sum(len(t.split()) for _, t in held) and len(mixed) == len(held)
    whole = spark.createDataFrame([*docs.collect(), *rows.collect()], docs.schema)
    whole.write.parquet(f"{folder}/more/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{folder}/more/{name}.parquet")
    found = corpus_pipeline.run(spark, f"{folder}/more").collect()
    assert not any(bench in (r["text"] or "") for r in found) and all(r["copies"] > 0 for r in found)
    assert sum(r["doc_id"] is None for r in found) <= 3


def test_long_documents_only():
    """400 documents of 200,000 to 900,000 words, each length once: no dynamic program reaches them, exchanges do."""
    for seed in range(3):
        draw = np.random.default_rng(seed)
        lengths = np.sort(draw.choice(np.arange(200_000, 900_000), 400, replace=False))
        counts = np.ones(400, np.int64)
        for target in (68_543_560.0, 1_234_567.0, 3.3 * int(lengths.sum()) / 2):
            passes, extra = fit_budget(lengths, counts, target, 3, 1 << 15)
            assert (extra >= 0).all() and (extra <= counts).all()
            assert abs(int((lengths * (passes + extra)).sum()) - target) < 100


def test_exchanges_at_the_edges():
    for lengths, counts, target in (([7], [3], 10.0), ([10**9], [1], 4e8), ([10**9, 10**9 + 7], [5, 5], 3e9 + 13), ([5, 10**10], [1, 1], 1e10)):
        passes, extra = fit_budget(np.array(lengths), np.array(counts), target, 3, 1 << 15)
        reached = sum(n * e for n, e in zip(lengths, extra)) + passes * sum(a * b for a, b in zip(lengths, counts))
        assert abs(reached - target) <= max(lengths) / 2
