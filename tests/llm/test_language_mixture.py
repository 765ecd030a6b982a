import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from critiq.llm import language_mixture as L

SYLLABLES = {"aa": ["the", "ing", "wh", "ou", "er"], "bb": ["sch", "ung", "ich", "ei", "ver"], "cc": ["ción", "que", "lla", "os", "ar"]}


def text(lang, seed, length=60):
    chance = random.Random(f"{lang}{seed}")
    return " ".join("".join(chance.choice(SYLLABLES[lang]) for _ in range(chance.randint(1, 3))) for _ in range(length))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(lang, i), lang, "old") for i, lang in enumerate(list(SYLLABLES) * 12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def judge(docs, extra, spark):
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, score string")
    judged = L.identify_languages(docs.unionByName(more), learn_from=F.col("doc_id") < 100)
    return {r["doc_id"]: r for r in judged.collect()}


def test_held_out_and_mixed_texts(spark, docs):
    extra = [(100 + i, text(lang, 500 + i, 25), None, "") for i, lang in enumerate(list(SYLLABLES) * 5)]
    mixed = text("aa", 900, 60) + " " + text("bb", 901, 30)
    extra += [(200, mixed, None, ""), (201, None, None, ""), (202, "", "aa", ""), (203, "12 ... ²³ _", "aa", "")]
    extra += [(204, "the", None, ""), (205, "THE\nWH", None, ""), (206, text("cc", 7, 30_000), None, "")]
    found = judge(docs, extra, spark)
    for i, lang in enumerate(list(SYLLABLES) * 5):
        assert found[100 + i]["lang_pred"] == lang and found[100 + i]["score"] > 0.9
        assert len(found[100 + i]["languages"]) == 1
    shares = {x["lang"]: x["share"] for x in found[200]["languages"]}
    assert set(shares) == {"aa", "bb"} and abs(shares["aa"] - 2 / 3) < 0.1 and found[200]["lang_pred"] == "aa"
    for i in (201, 202, 203):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["languages"]) == ("und", 0.0, [])
    assert found[204]["lang_pred"] == found[205]["lang_pred"] == "aa" and found[206]["lang_pred"] == "cc"


def test_nothing_to_learn_from(spark, docs):
    found = L.identify_languages(docs, learn_from=F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}
    assert L.identify_languages(docs.limit(0), learn_from=F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        L.learn_languages(docs, most_languages=2)


def buckets(word):
    """One trigram after the other."""
    letters = " ".join("".join(c if c.isalpha() or (c.isalnum() and not c.isdecimal()) else " " for c in word.lower()).split())
    if not any(map(str.isalpha, letters)):
        return []
    points = [ord(c) for c in f" {letters} "]
    packed = [a << 42 | b << 21 | c for a, b, c in zip(points, points[1:], points[2:])]
    return [int(L.mix(np.array([x], np.uint64))[0]) % L.BUCKETS for x in packed]


def test_trigrams_of_many_words_equal_one_by_one():
    words = ["a", "The", "don't", "12", "--", "x1y", "été!", "²", "a²", "日本", "ﬁn", "İx", "ΣΑΣ", "_a_", "((q))", "\u0301", "a\u0301b", "z" * 500, "🙂k🙂"]
    for given in (words, words[::-1], ["--"], ["--", "7"], []):
        found, owner = L.trigrams([w.encode() for w in given])
        for i, word in enumerate(given):
            assert found[owner == i].tolist() == buckets(word), word


def brute(texts, languages, table):
    """The most likely language set's largest one, by trying every set of languages."""
    from itertools import combinations

    out = []
    for words in texts:
        logs = np.array([table[buckets(w)].sum(0) for w in words if buckets(w)])
        if not len(logs):
            out.append(L.UNDECIDED)
            continue
        best = []
        for size in range(1, len(languages) + 1):
            for chosen in combinations(range(len(languages)), size):
                likelihoods = np.exp(logs - logs.max(1, keepdims=True))[:, chosen] + 1e-300
                share, fit = L.proportions(likelihoods, np.ones(len(logs)))
                best.append((fit - 0.5 * np.log(max(len(logs), 2)) * size, languages[chosen[int(np.argmax(share))]]))
        out.append(max(best)[1])
    return out


def test_predictions_equal_a_search_of_all_sets(spark, docs):
    languages, table = L.learn_languages(docs)
    texts = [text(lang, 40 + i, n) for i, (lang, n) in enumerate([("aa", 9), ("bb", 30), ("cc", 5), ("aa", 3), ("bb", 12)])]
    texts += [text("aa", 70, 40) + " " + text("cc", 71, 25), "12 --", text("cc", 72, 20) + " " + text("bb", 73, 50), "the the the sch"]
    found = judge(docs, [(100 + i, t, None, "") for i, t in enumerate(texts)], spark)
    expected = brute([t.split() for t in texts], languages, table)
    assert [found[100 + i]["lang_pred"] for i in range(len(texts))] == expected


def test_a_full_memory_of_words_changes_nothing(docs):
    languages, table = L.learn_languages(docs)
    texts = [Counter(text(lang, 90 + i, 30).encode().split()) for i, lang in enumerate(languages * 3)]
    large, small = L.WordLogs(table), L.WordLogs(table, most=10)
    for one in texts:
        large.learn([one])
        small.learn([one])
        assert all((a == b).all() for a, b in zip(large.of(one), small.of(one)))
    assert len(small.place) < len(large.place)


def test_counts_equal_brute_force(docs):
    languages, table = L.learn_languages(docs)
    assert languages == sorted(SYLLABLES)
    for column, lang in enumerate(languages):
        counts = Counter()
        for row in docs.where(F.col("lang") == lang).collect():
            for word in row["text"].encode().split():
                counts.update(buckets(word.decode()))
        total = sum(counts.values()) + L.SMOOTHING * L.BUCKETS
        expected = np.log((np.array([counts[b] for b in range(L.BUCKETS)]) + L.SMOOTHING) / total)
        assert np.allclose(table[:, column], expected)


def test_proportions_reach_the_best_likelihood():
    chance = np.random.default_rng(1)
    likelihoods, times = chance.random((50, 2)), chance.integers(1, 4, 50).astype(float)
    _, fit = L.proportions(likelihoods, times)
    grid = [times @ np.log(likelihoods @ np.array([p, 1 - p])) for p in np.linspace(0.001, 0.999, 999)]
    assert fit >= max(grid) - 0.05
