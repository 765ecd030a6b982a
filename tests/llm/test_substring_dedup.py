import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import numpy as np

from critiq.llm import substring_dedup as S


def brute(rows, window=20):
    """(doc_id, kept words) by looking at every window in order."""
    order = sorted(rows, key=lambda r: S.NO_ID if r[0] is None else r[0])
    seen, out = {}, []
    for i, text in order:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            if seen.setdefault(run, (i, k)) != (i, k):
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_removed long")
    found = S.remove_repeats(docs.repartition(parts)).collect()
    kept = [(r["doc_id"], r["n_words"], r["n_removed"], " ".join(w.decode() for w in (r["text"] or "").encode().split())) for r in found]
    return sorted(kept, key=str)


def test_cover_has_every_difference():
    cover = set(S.COVER)
    for i in range(S.PERIOD):
        for j in range(S.PERIOD):
            assert any((i + d) % S.PERIOD in cover and (j + d) % S.PERIOD in cover for d in range(S.PERIOD))
    assert S.ANCHOR + S.PERIOD - 1 == S.WINDOW


def test_equals_brute_force(spark, prose):
    passage, long = prose(1, 57), prose(2, 400)
    rows = [
        (5, " ".join(prose(3, 40) + passage + prose(4, 13))),
        (2, " ".join(prose(5, 11) + passage[:33] + prose(6, 80))),
        (9, "\n".join(passage[20:41])),
        (10, " ".join(passage[20:39])),
        (11, " ".join(long)),
        (12, " ".join(long)),
        (13, " ".join(long[:100] + ["changed"] + long[101:])),
        (14, "again " * 90),
        (15, " ".join(prose(7, 25) * 3)),
        (16, "short text"),
        (17, "short text"),
        (18, ""),
        (19, None),
        (20, " \n "),
        (None, " ".join(passage)),
        (21, "a b c\x85d " * 15),
    ]
    assert run(spark, rows) == brute(rows)


def test_random_corpora(spark):
    chance = random.Random(4)
    for _ in range(2):
        pool = [[chance.choice("abc") for _ in range(60)] for _ in range(4)]
        rows = []
        for i in range(40):
            words = []
            for _ in range(chance.randint(0, 5)):
                source = chance.choice(pool)
                start = chance.randint(0, 40)
                words += source[start : start + chance.randint(1, 40)] + [chance.choice("abcxyz")]
            rows.append((i, " ".join(words)))
        assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_empty_table(spark, prose):
    text = " ".join(prose(1, 50))
    assert run(spark, [(1, text), (1, text)]) == [(1, 50, 0, text)] * 2
    assert run(spark, [(1, text), (1, text), (2, text), (2, text)])[2:] == [(2, 50, 50, "")] * 2
    assert run(spark, []) == []


def test_different_texts_without_id_or_with_one_id(spark, prose):
    passage, own, other = prose(1, 30), prose(2, 40), prose(3, 45)
    rows = [
        (None, " ".join(prose(4, 35))),
        (None, " ".join(passage + prose(5, 10) + passage)),
        (1, " ".join(own)),
        (5, " ".join(own)),  # a copy
        (5, " ".join(other)),  # clean, under the same id
        (6, " ".join(other + ["end"])),
    ]
    removed = {text: n for (_, text), n in zip(rows, [0, 30, 0, 40, 0, 45])}
    removed[rows[3][1]] = None  # the text of 1 and 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = S.remove_repeats(docs.withColumn("was", docs["text"])).collect()
    assert {r["was"]: r["n_removed"] for r in found if r["was"] != rows[2][1]} == {t: n for t, n in removed.items() if n is not None}
    assert sorted((r["doc_id"], r["n_removed"]) for r in found if r["was"] == rows[2][1]) == [(1, 0), (5, 40)]


def test_blanks_between_kept_words_stay(spark, prose):
    passage = " ".join(prose(1, 30))
    docs = spark.createDataFrame([(1, passage), (2, f"a  b\n{passage}\n c\td ")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in S.remove_repeats(docs).collect()}[2] == "a  b\n c\td "


def test_changed_texts(spark, prose):
    passage, text = " ".join(prose(1, 30)), " ".join(prose(2, 30))
    rows = [(1, passage), (2, "x " + passage), (3, passage), (4, text)]
    found = S.changed_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["id"], r["copy"], r["n_removed"], r["text"]) for r in found.collect()) == [
        (2, False, 30, "x"),
        (3, True, None, None),
    ]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.sampled_from([(0, 8), (3, 8), (4, 8)]))
def test_planes_round_trip(numbers, part):
    from critiq.llm.hashing import from_planes, planes

    given_numbers = np.array(numbers, np.uint64)
    mask = sum(0xFF << (8 * k) for k in range(*part))
    again = from_planes(planes(given_numbers, *part), *part, kind=np.uint64)
    assert again.tolist() == [n & mask for n in numbers]
