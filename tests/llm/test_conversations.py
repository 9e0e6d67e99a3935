import hashlib
import random
import re
from zlib import crc32

import pytest

from grove.llm.conversations import NODE, Sorted, hashed_ends, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, n long, depth long, bucket string"


def brute(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    seqs = {}
    for c, turns in own.items():
        h, base = crc32(str(c).encode()) % 4, c - int(c / 20) * 0 - (abs(c) % 20) * (1 if c >= 0 else -1)
        seqs[c] = own.get(base, [])[:h] + turns[h:]
    members, ends, nodes = {}, {}, []
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        children, leaves, saved = below.get(node, (0, 0, 0))
        leaves = leaves or 1
        saved += (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        up = node[:-1]
        if node:
            a, b, c = below.get(up, (0, 0, 0))
            below[up] = (a + 1, b + leaves, c + saved)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        nodes.append((min(members[node]), len(node), min(members[up]) if node else None, len(members[node]), children, leaves, saved, digest))
    return sorted(nodes, key=repr)


def made_up():
    """Copies, a conversation with most turns, shared starts longer than a chunk, turns that repeat, null and negative ids, null roles and texts."""
    draw, rest = random.Random(11), (1, 9, "b")
    words = ["Hi there", "ok", "", None, "tell me  more\n", "x y z"]
    say = lambda: (draw.choice(["user", "assistant", None]), draw.choice(words))
    hot, long = [say() for _ in range(150)], [say() for _ in range(700)]
    seqs = {}
    for c in range(-25, 90):
        seqs[c] = hot[: draw.choice([70, 128, 150, 3])] + [say() for _ in range(draw.randrange(3))] if c % 3 == 0 else [say() for _ in range(draw.choice([0, 1, 2, 5]))]
    seqs |= {200 + i: hot for i in range(60)} | {400: long, 411: long[:300]} | {c: hot[:65] for c in range(500, 505)}
    rows = [(c, i if i or c % 2 else None, *t, *rest) for c, s in seqs.items() for i, t in enumerate(s)]
    return [*rows, rows[0], (None, 1, "user", "no id", *rest)]


@pytest.mark.parametrize("local_turns", [10, 600])
def test_trie(spark, local_turns):
    """Every node of rounds and of sorted buckets, with buckets of few and of more turns."""
    rows = made_up()
    found = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), local_turns=local_turns)
    assert found.columns == [c.split()[0] for c in NODE.split(", ")]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_small_tables(spark):
    df = spark.createDataFrame([(7, 1, "user", "a b", 1, 1, "x")], SCHEMA)
    assert prefix_trie(df.limit(0)).count() == 0
    for rows in ([(7, None, None, None), (None, 1, "u", "t")], [(c, 1, "user", "one turn") for c in range(23, 33)]):
        assert sorted(map(tuple, prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr) == brute(rows)


def test_ends_of_one_node(spark):
    """Ids of a node with most ends, over several ranges and joined texts."""
    draw = random.Random(2)
    ends = [(1, 3, i) for i in range(20_000)] + [(2, 3, i) for i in range(-5, 5)] + [(1, 4, 9)]
    draw.shuffle(ends)
    found = {(r["conv"], r["depth"]): r["ends_sha256"] for r in hashed_ends(spark.createDataFrame(ends, "conv long, depth long, conv_id long").repartition(3)).collect()}
    wanted = {node: hashlib.sha256(",".join(str(i) for *n, i in sorted(ends) if tuple(n) == node).encode()).hexdigest() for node in {(1, 3), (2, 3), (1, 4)}}
    assert found == wanted


def test_sorted_bucket():
    made = Sorted(2, [(5, [1, 2], [3, 4]), (4, [1], [3]), (9, [7, 7, 7], [1, 1, 1])])
    rows = {(r[0], r[1]): r[2:7] for r in made.rows(3, 2)}
    assert rows == {(4, 3): (3, 2, 1, 1, 3), (5, 4): (4, 1, 0, 1, 0), (9, 3): (3, 1, 1, 1, 0), (9, 4): (9, 1, 1, 1, 0), (9, 5): (9, 1, 0, 1, 0), (3, 2): (None, None, 2, 2, 3)}
