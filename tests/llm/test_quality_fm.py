import itertools
import zlib

import numpy as np
import pytest

from critiq.llm import quality_fm as Q
from critiq.llm import queries


def documents(prose, count, start=0):
    rows = []
    for i in range(start, start + count):
        words = prose(i, 40 + i % 30)
        rows.append((i, " ".join(words if i % 3 else [w.upper() + "!!" for w in words]), int(i % 3 > 0)))
    return rows


@pytest.fixture
def tables(spark, prose):
    rows = documents(prose, 240)
    docs = spark.createDataFrame([(i, t, "old") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 160], "doc_id long, quality int")
    return docs, labels


def test_held_out_accuracy(tables):
    docs, labels = tables
    found = Q.score_quality(docs, labels).collect()
    held_out = [r for r in found if r["doc_id"] >= 160]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in held_out) / len(held_out) > 0.95


def test_same_scores_again(tables):
    docs, labels = tables
    first = {r["doc_id"]: r["score"] for r in Q.score_quality(docs, labels).collect()}
    again = {r["doc_id"]: r["score"] for r in Q.score_quality(docs.repartition(7), labels.repartition(3)).collect()}
    assert first == again


def test_sample_is_bounded(tables):
    docs, labels = tables
    machine = Q.learn_quality(docs, labels, most_rows=10)
    assert np.count_nonzero(machine.weights) < 10 * 80


def test_pairs_equal_the_loop_over_pairs():
    chance = np.random.default_rng(2)
    size = Q.HASHED + len(Q.STRUCTURE)
    machine = Q.Machine(0.3, chance.normal(size=size), chance.normal(size=(size, Q.FACTORS)))
    rows = [Q.features("some words here and some more\nwords!"), Q.features(""), Q.features(None)]
    starts = np.cumsum([0, *(len(p) for p, _ in rows[:-1])])
    found = machine.score(np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows]), starts)
    for score, (places, values) in zip(found, rows):
        pairs = sum(
            machine.vectors[places[a]] @ machine.vectors[places[b]] * values[a] * values[b]
            for a, b in itertools.combinations(range(len(places)), 2)
        )
        assert score == pytest.approx(machine.constant + machine.weights[places] @ values + pairs)


def test_edge_cases(spark, tables):
    docs, labels = tables
    rows = [(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "word " * 50_000, "c")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    found = Q.score_quality(odd, labels).collect()
    assert len(found) == 4 and all(0 <= r["score"] <= 1 for r in found)
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")
    assert {r["score"] for r in Q.score_quality(odd, none).collect()} == {0.5}
    one_kind = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert all(r["score"] > 0.5 for r in Q.score_quality(docs, one_kind).collect())
    assert Q.score_quality(odd.limit(0), labels).count() == 0


def test_query_equals_brute_force(spark, prose, tmp_path):
    """The registered query against a fit in one process and a loop over all pairs of features."""
    texts = [(i, " ".join(prose(i, 30) if i % 2 else ["buy", "now"] * (i % 7 + 1) + prose(i, 4))) for i in range(60)]
    texts += [(7, "another text of the same id"), (7, None), (61, None), (62, ""), (None, "no id")]
    labels = [(i, i % 2, 0) for i in range(0, 60, 2)] + [(i, 1, 0) for i in range(1, 60, 2)] + [(61, 0, 0), (7, 1, 0)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held_out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in texts if i is not None}
    known = sorted({i: y for i, y, _ in labels if not held_out[i]}.items())
    first = {}
    for i, text in texts:
        first[i] = min((t for t in (first.get(i), text) if t is not None), default=None)
    machine = Q.fit([tuple(a.astype(b) for a, b in zip(Q.features(first[i]), (np.int32, np.float32))) for i, _ in known], np.array([y for _, y in known], float))
    found = queries.op3_quality_machine(spark, str(tmp_path)).collect()
    expected = []
    for i, text in texts:
        places, values = Q.features(text)
        pairs = sum(
            machine.vectors[places[a]] @ machine.vectors[places[b]] * values[a] * values[b]
            for a, b in itertools.combinations(range(len(places)), 2)
        )
        score = 1 / (1 + np.exp(-(machine.constant + machine.weights[places] @ values + pairs)))
        expected.append((str(i), bool(held_out.get(i, False)), round(float(score), 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], round(r["score"], 6)) for r in found) == sorted(expected)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found)
