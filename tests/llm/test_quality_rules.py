from pyspark.sql import functions as F

from critiq.llm import quality_rules as Q

COLUMNS = "doc_id long, text string, kept string, words_ string"


def judge(spark, rows, trusted=()):
    docs = spark.createDataFrame([(i, t, "old", "other") for i, t in rows], COLUMNS)
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    return {(r["doc_id"], r["text"]): r for r in Q.score_quality(docs, ids).collect()}


def counts_by_hand(text):
    words = text.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_counts_equal_brute_force(spark, prose):
    texts = [
        " ".join(prose(1, 60)),
        "a b c d e\na b c d e\nx #*$ | <y>\n\na b c d e",
        "one two three\x85four \x1c five\tsix\x0bseven\x0ceight\rnine",
        "é ß 日本 é ß 日本 é ß 日本 é ß",
        "",
        " \n\t ",
        "w " * 3000,
    ]
    found = judge(spark, list(enumerate(texts)))
    for i, text in enumerate(texts):
        row = found[i, text]
        assert tuple(row[c] for c in Q.COUNTS) == counts_by_hand(text)
        n, _, _, _, repeated = counts_by_hand(text)
        assert row["base_failed"] == (n < 10 or 100 * repeated > 20 * n)


def test_ratio_equals_brute_force(spark, prose):
    import math
    import zlib

    texts = {i: " ".join(prose(i % 7, 30 + i)) for i in range(20)}
    trusted = [1, 3, 5, 5]
    found = judge(spark, list(texts.items()), trusted)
    words = {i: [zlib.crc32(w) % Q.BUCKETS for w in t.encode().split()] for i, t in texts.items()}
    pairs = {i: [(31 * a + b) % Q.BUCKETS for a, b in zip(n, n[1:])] for i, n in words.items()}
    sums, counts, means = ({i: 0 for i in texts} for _ in range(3))
    for grams in (words, pairs):
        raw, target = {}, {}
        for i, numbers in grams.items():
            for b in numbers:
                raw[b] = raw.get(b, 0) + 1
                if i in trusted:
                    target[b] = target.get(b, 0) + 1
        share = sum(target.values()) / sum(raw.values())
        weight = {b: round(1e4 * math.log((target.get(b, 0) + 4.0) / (n * share + 4.0))) for b, n in raw.items()}
        for i, numbers in grams.items():
            units = sum(weight[b] for b in numbers)
            sums[i], counts[i], means[i] = sums[i] + units, counts[i] + len(numbers), means[i] + units / len(numbers)
    for i, text in texts.items():
        row = found[i, text]
        assert (row["n_grams"], row["ratio_units"]) == (counts[i], sums[i])
        assert row["mean_units"] == math.floor(means[i])
        assert row["kept"] == (not row["base_failed"] and row["mean_units"] >= Q.THRESHOLD)


def test_trusted_words_in_another_order_score_lower(spark, prose):
    import random

    texts = [" ".join(prose(i % 5, 60)) for i in range(30)]  # five trusted texts, six times each
    shuffled = []
    for i in range(5):
        words = texts[i].split()
        random.Random(i).shuffle(words)
        shuffled.append(" ".join(words))
    found = judge(spark, list(enumerate(texts + shuffled)), range(30))
    for i in range(5):
        assert found[30 + i, shuffled[i]]["mean_units"] < found[i, texts[i]]["mean_units"] - 1000
    words_only = Q.score_quality(
        spark.createDataFrame(list(enumerate(texts + shuffled)), "doc_id long, text string"),
        spark.createDataFrame([(i,) for i in range(30)], "doc_id long"),
        orders=(1,),
    )
    scores = {r["doc_id"]: r["mean_units"] for r in words_only.collect()}
    assert all(scores[30 + i] == scores[i] for i in range(5))


def test_texts_too_short_for_an_order(spark):
    found = judge(spark, [(1, "one"), (2, ""), (3, "one two")], [3])
    assert [found[k]["n_grams"] for k in ((1, "one"), (2, ""), (3, "one two"))] == [1, 0, 3]
    assert found[2, ""]["mean_units"] == 0 and not any(r["kept"] for r in found.values())


def test_a_filter_on_the_fixed_rules(spark, prose):
    docs = spark.createDataFrame([(1, " ".join(prose(1, 40))), (2, "few")], "doc_id long, text string")
    assert Q.score_quality(docs, docs.select("doc_id")).where("not base_failed").count() == 1


def test_longer_grams_are_counted_too(spark, prose):
    docs = spark.createDataFrame([(1, " ".join(prose(1, 12)))], "doc_id long, text string")
    row = Q.score_quality(docs, docs.select("doc_id"), orders=(1, 2, 3)).first()
    assert row["n_grams"] == 12 + 11 + 10


def test_junk_goes_and_clean_stays(spark, prose):
    clean = [(i, " ".join(prose(i, 80))) for i in range(40)]
    junk = [(100 + i, " ".join(f"{w}%%%" for w in prose(200 + i, 80))) for i in range(40)]
    found = judge(spark, clean + junk, range(20))
    kept = {i for (i, _), r in found.items() if r["kept"]}
    assert {i for i, _ in clean} == kept


def test_edge_cases(spark, prose):
    text = " ".join(prose(1, 30))
    rows = [(None, None), (1, None), (2, ""), (None, text), (3, text), (3, text)]
    docs = spark.createDataFrame([(i, t, "old", "other") for i, t in rows], COLUMNS)
    none = spark.createDataFrame([], "doc_id long")
    found = Q.score_quality(docs, none)
    assert found.columns.count("kept") == 1 and found.select("words_").distinct().first()[0] == "other"
    assert found.where("kept").count() == 3 and found.where("base_failed").count() == 3
    with_null = spark.createDataFrame([(None,), (3,), (3,)], "doc_id long")
    assert Q.score_quality(docs, with_null).where("kept").count() == 3
    assert Q.score_quality(docs.limit(0), none).count() == 0
    assert Q.score_quality(docs, none).where(F.col("kept") & (F.col("n_words") > 3)).count() == 3
