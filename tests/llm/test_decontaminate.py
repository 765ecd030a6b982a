import re

import pytest

from critiq.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(D.UPPER, D.LOWER)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if not w:
            continue
        n = min(len(w), 13)
        for i in range(len(w) - n + 1):
            windows.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [str(item)])
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(found), sorted(hit), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_hits(frame, bench, **options)
    names = ("doc_id", "n_words", "n_hit", "items", "hit_words", "contaminated")
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=str)


@pytest.fixture
def case(prose):
    passage, other = prose(1, 30), prose(2, 16)
    items = [
        (1, " ".join(passage)),
        (2, " ".join(passage[:20])),
        (10, " ".join(other)),
        (3, "Ünïque Word"),
        (4, "alone"),
        (5, ""),
        (6, None),
        (None, " ".join(prose(9, 20))),
        (7, "one two three four"),
    ]
    docs = [
        (1, " ".join(prose(3, 50) + passage + prose(4, 20))),
        (2, " ".join(prose(5, 900) + passage[3:17] + prose(6, 20))),
        (3, "a, b; " + ", ".join(w.upper() for w in other)),
        (4, "ünïque-word ALONE one two. three? FOUR five"),
        (5, " ".join(passage[:12])),
        (6, " ".join(passage + passage)),
        (7, ""),
        (8, None),
        (None, " ".join(passage)),
        (9, " ".join(passage)),
        (9, " ".join(passage)),
        (10, "..."),
        (11, " ".join(prose(9, 20))),
    ]
    return docs, items


def test_hits_equal_brute_force(spark, case):
    docs, items = case
    assert run(spark, docs, items) == brute(docs, items)


def test_other_paths_give_the_same(spark, case):
    docs, items = case
    assert run(spark, docs, items, broadcast_windows=0, bitmap_bits=64) == brute(docs, items)


def test_empty_tables(spark, case):
    docs, items = case
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


def test_removal(spark, case):
    docs, items = case
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_hit string")
    found = D.find_hits(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(D.remove_hits(found).select("doc_id").toPandas()["doc_id"].tolist()) == [2, 5, 7, 8, 10]  # 11 is an item without id
    cut = {r["doc_id"]: r["text"] for r in D.remove_hits(found, whole=False).collect()}
    assert cut[4] == "ünïque-word five" and cut[5] == dict(docs)[5] and cut[8] is None and cut[10] == "..."
    assert cut[3] == "a, b"


def test_items_without_an_id_hit_but_are_not_listed(spark, prose):
    passage, other = " ".join(prose(1, 20)), " ".join(prose(2, 20))
    docs = [(1, passage), (2, " ".join(prose(3, 300)) + " " + other), (3, " ".join(prose(4, 40))), (4, passage + " " + "word " * 100_000)]
    items = [(None, passage), (None, None), (7, other), (None, other)]
    found = run(spark, docs, items)
    assert found == brute(docs, items)
    assert found[0][2:4] == (20, []) and found[0][5] and found[1][3] == ["7"]
