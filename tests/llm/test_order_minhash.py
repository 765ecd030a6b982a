import math
import random

import numpy as np

from critiq.llm import order_minhash as O
from critiq.llm.components import components
from critiq.llm.hashing import hash_words


def distance(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return len(a) + len(b) - 2 * int(table[-1, -1])


def test_alignment_equals_the_full_table():
    chance = random.Random(1)
    for _ in range(600):
        a = [chance.randrange(3) for _ in range(chance.randint(0, 25))]
        b = list(a)
        for _ in range(chance.randint(0, 6)):
            if b and chance.random() < 0.4:
                b.pop(chance.randrange(len(b)))
            else:
                b.insert(chance.randint(0, len(b)), chance.randrange(3))
        most = chance.randint(0, 10)
        assert O.within(np.array(a, np.uint64), np.array(b, np.uint64), most) == (distance(a, b) <= most)


def test_similarity_is_exact_at_the_limit():
    a = np.arange(90, dtype=np.uint64)
    assert O.are_similar(a, np.r_[a[:80], np.arange(200, 210, dtype=np.uint64)])  # 80 of 100
    assert not O.are_similar(a, np.r_[a[:79], np.arange(200, 211, dtype=np.uint64)])
    assert not O.are_similar(a, np.roll(a, 45))  # the same shingles in another order


def test_order_counts_in_the_sketch():
    a = np.arange(60, dtype=np.uint64)
    same = (O.sketch(a) == O.sketch(a.copy())).all()
    assert same and (O.sketch(a) == O.sketch(a[::-1].copy())).sum() <= 1


def test_agreement_follows_similarity():
    chance = np.random.default_rng(3)
    found = []
    for _ in range(200):
        a = chance.integers(0, 2**63, 500).astype(np.uint64)
        b = a.copy()
        b[chance.choice(500, 55, replace=False)] = chance.integers(0, 2**63, 55).astype(np.uint64)  # about 0.8
        found.append(int((O.sketch(a) == O.sketch(b)).sum()))
    assert min(found) >= 2 and 7 < np.mean(found) < 14


def brute(rows):
    texts = {}
    for i, text in rows:
        if i is not None:
            texts.setdefault(i, O.shingles(hash_words((text or "").encode().split())))
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and len(texts[i]) and len(texts[j]) and O.are_similar(texts[i], texts[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


def classes(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    return O.with_classes(docs.repartition(3))


def test_classes_equal_brute_force(spark, prose):
    chance, rows = random.Random(2), []
    for group in range(12):
        words = prose(group, chance.choice([8, 60, 200]))
        for _ in range(5):
            copy = list(words)
            for _ in range(chance.choice([0, 0, 1, 2, 6])):
                copy[chance.randrange(len(copy))] = f"new{chance.randrange(999)}"
            rows.append((len(rows), " ".join(copy)))
    passage = prose(77, 60)
    rows += [(len(rows) + k, " ".join(passage + prose(300 + k, 20))) for k in range(8)]  # much in common, not enough
    rows += [(200, "a b"), (201, "a  b"), (202, "a c"), (203, ""), (204, None), (205, " ")]
    found = {r["doc_id"]: r["class_id"] for r in classes(spark, rows).collect()}
    assert found == brute(rows)
    assert found[203] == 203 and found[204] == 204 and found[205] == 205 and found[201] == 200


def test_edge_cases(spark, prose):
    text = " ".join(prose(1, 40))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None)]
    found = classes(spark, rows)
    assert sorted(((r["doc_id"], r["class_id"]) for r in found.collect()), key=str) == [
        (1, 1), (1, 1), (2, 1), (3, 3), (None, None), (None, None),
    ]
    docs = found.drop("class_id")
    kept = O.one_per_class(docs)
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["1", "3", "None", "None"]
    assert O.with_classes(docs.limit(0)).count() == 0 and O.one_per_class(docs.limit(0)).count() == 0


def test_members_unlike_the_first_of_their_bucket(spark, prose):
    """Two pairs that share single entries must both be found, whatever the smallest id is."""
    base = prose(5, 300)
    half = base[:150]
    a = half + prose(6, 150)
    b = half + prose(7, 150)
    rows = [(0, " ".join(base)), (1, " ".join(a)), (2, " ".join(a[:-1] + ["end"])), (3, " ".join(b)), (4, " ".join(b[:-1] + ["end"]))]
    found = {r["doc_id"]: r["class_id"] for r in classes(spark, rows).collect()}
    assert found == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3}


def test_short_pairs_behind_a_smaller_id(spark, prose):
    """Texts that just reach the similarity, in buckets whose smallest id is like neither."""
    rows, pairs = [], []
    for kind, (words, more) in enumerate([((8, 0), 1), ((9, 0), 1), ((13, 1), 1), ((22, 2), 2)]):
        for k in range(40):
            length, dropped = words
            text = [f"{w}{kind}x{k}" for w in prose(1000 * kind + k, length)]
            text = [f"{w}n{i}" for i, w in enumerate(text)]
            other = text[: length - dropped] + [f"new{kind}x{k}n{i}" for i in range(more)]
            third = text[: length // 2 + 3] + [f"far{kind}x{k}n{i}" for i in range(length)]
            at = len(rows)
            rows += [(at, " ".join(third)), (at + 1, " ".join(text)), (at + 2, " ".join(other))]
            pairs.append(at)
    found = {r["doc_id"]: r["class_id"] for r in classes(spark, rows).collect()}
    assert found == {at + k: at + min(k, 1) for at in pairs for k in range(3)} == brute(rows)


def test_probability_of_a_common_entry_at_every_length():
    """Of longer texts at the similarity; texts of EXACT shingles and less are found by rarest shingles."""
    worst = 1.0
    for n in range(O.EXACT + 1, 400):
        for m in range(n, int(n / O.SIMILARITY) + 1):
            shared = -(-4 * (n + m) // 9)  # the smallest L with L / (n + m - L) >= 0.8
            if shared <= n:
                agrees = math.comb(shared, O.PICKS) / math.comb(n + m - shared, O.PICKS)
                worst = min(worst, 1 - (1 - agrees) ** O.ENTRIES)
    assert worst > 0.99999


def test_components(spark):
    chance = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 5), (7, 3), (3, 7)]
    edges += [(chance.randrange(1000, 1060), chance.randrange(1000, 1060)) for _ in range(40)]
    parent = {n: n for e in edges for n in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in edges:
        a, b = sorted((root(x), root(y)))
        parent[b] = a
    found = components(spark.createDataFrame(edges, "a long, b long"))
    linked = {n for x, y in edges if x != y for n in (x, y)}
    assert {r["id"]: r["component"] for r in found.collect()} == {n: root(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_two_texts_under_one_id(spark, prose):
    a, b = prose(1, 80), prose(2, 80)
    join = " ".join
    rows = [(1, join(a)), (1, join(b)), (2, join(b + ["end"])), (3, join(["first"] + b)), (4, join(a[:-1])), (1, join(a)), (5, None), (5, join(a))]
    found = classes(spark, rows)
    named = sorted((r["doc_id"], r["class_id"]) for r in found.collect())
    assert named == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (5, 5)]
    kept = O.one_per_class(found.drop("class_id")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["text"]) == sorted([(1, join(a)), (1, join(b))])
    assert [r["doc_id"] for r in kept if not r["text"]] == [5]


def chain(prose, seed, count, length):
    """Near copies of one text, most of them like some others but not like the first."""
    chance, base, rows = random.Random(seed), prose(seed, length), []
    for _ in range(count):
        copy = list(base)
        for _ in range(chance.randint(0, length // 30)):
            copy[chance.randrange(length)] = f"new{chance.randrange(99)}"
        rows.append(" ".join(copy))
    return rows


def test_a_large_group_in_tiles(spark, prose, monkeypatch):
    rows = list(enumerate(chain(prose, 3, 60, 120) + chain(prose, 4, 60, 50)))
    expected = brute(rows)
    assert len(set(expected.values())) > 4
    for members, few in ((1024, 12), (10, 12), (10, 2)):
        monkeypatch.setattr(O, "TILE_MEMBERS", members)
        monkeypatch.setattr(O, "FEW_MEMBERS", few)
        monkeypatch.setattr(O, "BROADCAST_ROWS", 1_000_000 if few > 2 else 0)
        assert {r["doc_id"]: r["class_id"] for r in classes(spark, rows).collect()} == expected


def test_shared_counts():
    chance = np.random.default_rng(5)
    sets = [np.unique(chance.integers(0, 60, chance.integers(1, 40))).astype(np.uint64) for _ in range(30)]
    counts = O.shared_counts(sets)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert i == j or counts[i, j] == len(np.intersect1d(x, y))
