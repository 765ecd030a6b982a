import numpy as np
import pytest
from pyspark.sql import functions as F

from critiq.llm import block_neighbours as B

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, k=5):
    """(query, rank, id, score) by comparing all pairs."""
    kept = {}
    for number, vector in rows:
        good = number is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector)
        if good:
            kept[number, tuple(float(np.float32(x)) for x in vector)] = True
    out = []
    for number, vector in kept:
        if number % 50:
            continue
        a = np.array(vector)
        scores = []
        for other, them in kept:
            if len(them) == len(vector) and (other, them) != (number, vector):
                b = np.array(them)
                scores.append((float(a @ b / np.sqrt((a @ a) * (b @ b))), other))
        scores.sort(key=lambda x: (-round(x[0], 12), x[1]))
        out += [(number, rank, other, round(score, 9)) for rank, (score, other) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, parts=3, k=5):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(parts)
    found = B.nearest(table, F.col("vec_id") % 50 == 0, k).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found)


def vectors(seed, count, length=12):
    return np.random.default_rng(seed).normal(size=(count, length)).astype(np.float32).tolist()


def test_equals_all_pairs(spark):
    rows = list(enumerate(vectors(1, 400)))
    assert run(spark, rows) == brute(rows)


def test_one_vector_of_a_third_of_the_rows(spark):
    common = vectors(2, 1)[0]
    rows = [(i, common if i % 3 == 0 else v) for i, v in enumerate(vectors(3, 500))]
    found = run(spark, rows)
    assert found == brute(rows)
    assert [r[2] for r in found if r[0] == 0] == [3, 6, 9, 12, 15]


def test_edge_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, -1.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0]), (50, [1.0, 2.0]), (3, [0.0, 0.0]),
        (100, [0.0, 0.0]), (150, None), (200, [1.0, None]), (250, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
        (300, []), (350, [1.0, 1.0, 1.0]), (400, [1e-30, 3e-30]), (450, [3e38, 3e38]), (5, [-0.0, 1.0]), (6, [0.0, 1.0]),
    ]
    found = run(spark, rows)
    assert found == brute(rows)
    assert not {100, 150, 200, 250, 300, 350} & {r[0] for r in found}


def test_long_vectors_and_few_candidates(spark):
    rows = list(enumerate(vectors(4, 60, 2500)))
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:3]) == brute(rows[:3])
    assert run(spark, rows[:1]) == []


def test_empty_table(spark):
    assert run(spark, []) == []


def test_several_slices_give_the_same(spark, monkeypatch):
    rows = list(enumerate(vectors(5, 300)))
    monkeypatch.setattr(B, "SLICE_BYTES", 2000)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("length", [1, 3, 64, 1500])
def test_bounds_hold(length):
    a, b = (B.Slice(np.arange(30), np.arange(30), np.array(vectors(s, 30, length), np.float64)) for s in (6, 7))
    near = B.products(a.int8, b.int8) * a.step[:, None] * b.step[None]
    error = a.error[:, None] + a.size[:, None] * b.error[None]
    i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
    true = B.cosines(a, i, b, j).reshape(len(a), len(b))
    assert (np.abs(true - near) <= error).all()
