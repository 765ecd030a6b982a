import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from critiq.llm import queries
from critiq.llm import ranked_search as R

DOCS = "doc_id long, text string, item_id string, score int"
ITEMS = "item_id long, text string, doc_id int, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    """(item, rank, doc, score) by scoring every document for every item."""
    counted = [(number, Counter(split(text))) for number, text in docs]
    n_docs = sum(bool(c) for _, c in counted)
    n_terms = sum(sum(c.values()) for _, c in counted)
    out = []
    for item, text in set(items):
        asked = Counter(split(text))
        scores = []
        for number, found in counted:
            n, score = sum(found.values()), 0
            for term, times in asked.items():
                if tf := found[term]:
                    df = sum(term in c for _, c in counted)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    m = 75 + (25 * n * n_docs) // n_terms
                    score += times * w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, number is not None, number or 0))
        for rank, (score, real, number) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, number if real else None, -score))
    return sorted(out, key=str)


def run(spark, docs, items, parts=3, **options):
    given = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(parts)
    asked = spark.createDataFrame([(i, t, 1, 1) for i, t in items], ITEMS)
    found = R.rank_documents(given, asked, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def texts(prose, seed, count, longest=60):
    chance = random.Random(seed)
    return [(i, " ".join(prose(seed * 1000 + i, chance.randint(1, longest)))) for i in range(count)]


def test_equals_scoring_all(spark, prose):
    docs, items = texts(prose, 1, 300), texts(prose, 2, 8, 12)
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_many_shards_and_blocks_of_items(spark, prose, monkeypatch):
    docs, items = texts(prose, 3, 200), texts(prose, 4, 9, 12)
    expected = brute(docs, items)
    monkeypatch.setattr(R, "ITEM_BYTES", 200)
    assert run(spark, docs, items) == expected


def test_shards_cut_by_documents_and_points(prose):
    docs, (_, item) = texts(prose, 5, 150), texts(prose, 6, 1, 30)[0]
    wanted = Counter(R.terms(item.encode()))
    rows = {t: i for i, t in enumerate(sorted(wanted))}

    class Value:
        value = rows

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in docs]), pa.array([t.encode() for _, t in docs])], names=["id", "text"]
    )
    postings = list(R._count_terms(Value)([batch]))
    whole = next(R._shards(iter(postings)))
    for size in ("SHARD_DOCS", "SHARD_POINTS"):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(R, size, 7)
            cut = list(R._shards(iter(postings)))
        assert len(cut) > 10
        assert sorted(np.concatenate([c[0] for c in cut])) == sorted(whole[0])
        assert sum(len(c[4]) for c in cut) == len(whole[4])


def test_ties_and_a_third_of_equal_documents(spark, prose):
    same = "river stone window"
    docs = [(i, same if i % 3 else " ".join(prose(i, 9))) for i in range(240)]
    docs += [(1, same), (None, same), (None, same)]
    items = [(1, same), (1, same), (1, "stone stone garden"), (2, "nothingofthekind"), (None, "Window")]
    assert run(spark, docs, items) == brute(docs, items)


def test_edge_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " .,-"), (4, "Été ÉTÉ a_b A-B x1Y2"), (5, "word " * 50_000 + "rare"), (6, "rare"), (7, "é\u0000b straße"),
        (-3, "rare word"), (8, "日本語 text"),
    ]
    items = [(1, "rare word"), (2, None), (3, ""), (4, "!!"), (5, "Été b straße"), (6, "日本語"), (7, "a b x1y2 É"), (8, "word " * 3000 + "rare")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "word")]) == []
    assert run(spark, [(1, "word")], []) == []
    assert run(spark, [], []) == []


def test_a_term_in_all_documents(spark):
    docs, items = [(i, "word " * (i + 1)) for i in range(5)], [(1, "word")]
    assert run(spark, docs, items) == brute(docs, items)


def test_treap_holds_the_points():
    chance = np.random.default_rng(1)
    codes = chance.choice(32 * 32, 200, replace=False)
    rows, columns, values = codes // 32, codes % 32, chance.integers(1, 1000, 200)
    treap = R.K2Treap(rows, columns, values, 5)
    grid = np.zeros((32, 32), np.int64)
    grid[rows, columns] = values
    every = np.arange(32)
    cells, width = np.zeros((1, 32), np.int64), 32
    for level in range(5):
        bits = (every >> (4 - level)) & 1
        cells = np.stack([treap.children(level, cells, bits[None], b) for b in (0, 1)], 1).reshape(-1, 32)
        width //= 2
        blocks = grid.reshape(32 // width, width, 32 // width, width).max(axis=(1, 3))
        assert (treap.maxima[level + 1][cells] == blocks[every // width].T).all()


def test_query(spark, prose, tmp_path):
    docs, items = texts(prose, 7, 60), texts(prose, 8, 4, 10)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.op11_ranked_search(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(docs, items)
