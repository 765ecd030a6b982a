import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from critiq.llm import prefix_trie as T
from critiq.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs int"


def rem(a, b):
    return a - b * int(a / b)


def brute(rows):
    """The nodes by a dictionary of all prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[:2], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))
    members, ends = defaultdict(set), defaultdict(list)
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 9
        s = [t[2:] for t in own.get(conv - rem(conv, 5), [])[:h] + own[conv][h:]]
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(conv)
        ends[tuple(s)].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, convs in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        above = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), above, len(convs), children[node], leaves[node], saved[node], digest))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", *T.COUNTS, "ends_sha256")


def run(spark, rows, ranges=None):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    convs = T.conversations(table)
    conv = F.col("conv_id")
    shared = (F.crc32(conv.cast("string").cast("binary")) % 9).cast("int")
    found = T.prefix_trie(T.rebuilt(convs, conv - conv % 5, shared, 8), ranges)
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)


def made(seed, count, words=4):
    chance = random.Random(seed)
    return [
        (c, t, chance.choice(["user", "assistant", None]), chance.choice(["hi", "yes é", "", None, "well"][:words]))
        for c in range(count) for t in range(chance.randint(0, 12)) if chance.random() < 0.9
    ]


@pytest.mark.parametrize("ranges", [1, 2, 7, None])
def test_equals_a_dictionary_of_prefixes(spark, ranges):
    rows = made(1, 150)
    assert run(spark, rows, ranges) == brute(rows)


def test_a_common_conversation_and_a_common_first_turn(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(120) for t in range(6)]
    rows += [(c, t, "user", "turn 0" if t == 0 else f"{c} {t}") for c in range(200, 320) for t in range(9)]
    assert run(spark, rows, 5) == brute(rows)


def test_edge_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (5, None, "user", "first"), (5, 0, "user", "then"), (5, 0, "user", "then"), (5, 0, "assistant", "tie"),
        (6, 0, "user", "only"), (7, 3, None, None), (-7, 1, "user", "below zero"), (-5, 1, "user", "base"), (11, 0, "us", "erx"), (13, 0, "user", "x"),
        (40, 0, "user", "long " * 20_000), (44, 0, "user", "é" * 7),
    ]
    rows += [(30, t, "user", f"step {t % 17}") for t in range(300)]
    assert run(spark, rows, 3) == brute(rows)


def test_no_conversation(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


def test_only_turnless_conversations(spark):
    # the base of 6 is absent, and 6 has fewer turns than it shares
    rows = [(c, 0, "user", "x") for c in range(6, 10)]
    assert run(spark, rows) == brute(rows)


def test_layouts_grow():
    tree = T.Tree()
    keys = [bytes([a, 9, 9, 9] + [0] * 11 + [b]) + tail for a in range(256) for b in (0, a) for tail in (b"", b"x" * 16)]
    random.Random(2).shuffle(keys)
    kinds = set()
    for i, key in enumerate(keys):
        tree.insert(key, (1, i, "", bytes(8)))
        kinds.add(tree.root[2])
    assert kinds == {4, 16, 48, 256}

    def walk(node, way):
        way += node[0]
        if node[1] is not None:
            yield way
        for child in T.Tree.sorted_branches(node):
            yield from walk(child, way)

    assert list(walk(tree.root, b"")) == sorted(set(keys))


def test_query(spark, tmp_path):
    rows = made(3, 60)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op12_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=str) == brute(rows)
