import random

from critiq import fixed_values as fixed
from critiq.operators import content as C
from critiq.sources import word_lists as L

SCHEMA = C.WORD_LIST_SCHEMA


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_default_lists(spark):
    words = C.default_word_lists(spark)
    sizes = {r["list_name"]: r["count"] for r in words.groupBy("list_name").count().collect()}
    assert sizes == {"inappropriate_words": 20, "quality_indicators": 15, "spam_indicators": 50}
    assert C.words_by_list(words, "nothing").count() == 0
    assert {r["severity"] for r in C.words_by_severity(words, 2, 3).collect()} == {2, 3}


def test_matches_once_inside_words_and_in_any_case(spark):
    found = C.content_matches(docs(spark, "FREE freedom, Hatefully free", "none"), C.default_word_lists(spark), ["id"])
    rows = sorted((r["id"], r["list_name"], r["word"], r["severity"]) for r in found.collect())
    assert rows == [(0, "inappropriate_words", "hate", 4), (0, "spam_indicators", "free", 3)]


def test_checks_and_verdict(spark):
    words = C.default_word_lists(spark)
    texts = docs(spark, "excellent, free discount", "discount", "", None)
    rows = {r["id"]: r for r in C.with_content_checks(texts, words, ["id"]).collect()}
    assert rows[0]["severity_summary"] == {"quality_indicators": 5, "spam_indicators": 5}
    assert [m["word"] for m in rows[0]["matches"]["spam_indicators"]] == ["free", "discount"]
    assert [rows[i]["is_appropriate"] for i in range(4)] == [False, True, True, True]
    spam = C.content_appropriate(texts, words, ["id"], max_severity=5, lists=["spam_indicators"])
    assert all(r["is_appropriate"] for r in spam.collect())
    joined = C.with_content_checks(texts, words, ["id"], literal_entries=0)
    plain = lambda r: (r["is_appropriate"], r["severity_summary"], r["matches"])
    assert {r["id"]: plain(r) for r in joined.collect()} == {i: plain(r) for i, r in rows.items()}


def test_join_equals_literal_words_on_random_texts(spark):
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abÉé ß") for _ in range(n))
    words = [("l%d" % (i % 3), make(rng.randint(1, 5)), "c", i % 5 + 1, i) for i in range(60)]
    table = spark.createDataFrame(words, SCHEMA)
    texts = docs(spark, *[make(rng.randint(0, 80)) for _ in range(60)], "ab " * 400)
    brute = {
        (r["id"], w[0], w[1], w[3], w[4])
        for r in texts.collect()
        for w in words
        if w[1].lower() in r["text"].lower()
    }
    for entries in (1000, 0):
        found = C.content_matches(texts, table, ["id"], literal_entries=entries).collect()
        rows = [(r["id"], r["list_name"], r["word"], r["severity"], r["position"]) for r in found]
        assert len(rows) == len(set(rows)) and set(rows) == brute


def test_read_word_lists(spark, tmp_path):
    (tmp_path / "spam.txt").write_text(
        "# a comment\n\nfree|promo|3\nbuy now | promo | 4\ndon't wait|urgency|3\nbad line\na,b,1\nx|y|4.5\n"
    )
    (tmp_path / "speech.txt").write_text(fixed.SPEECH_PATTERNS + "only, two\n")
    (tmp_path / "empty.txt").write_text("nothing good\n")
    (tmp_path / "other.csv").write_text("x|y|1\n")
    scan = L.read_word_lists(spark, str(tmp_path))
    spam = C.words_by_list(scan.rows, "spam").orderBy("position").collect()
    assert [(r["word"], r["category"], r["severity"]) for r in spam] == [
        ("free", "promo", 3), ("buy now", "promo", 4), ("don't wait", "urgency", 3),
    ]
    speech = C.words_by_list(scan.rows, "speech")
    assert speech.count() == 100
    assert speech.filter("word = 'absolutely'").count() == 2  # two categories
    assert {r["line"] for r in scan.rejects.collect()} == {
        "bad line", "a,b,1", "x|y|4.5", "only, two", "nothing good",
    }
    names = {r["list_name"] for r in L.list_names(spark, str(tmp_path)).collect()}
    assert names == {"spam", "speech", "empty"}


def test_built_in_lists_take_one_pass_over_a_text(spark, capsys):
    docs = spark.sql("SELECT * FROM VALUES (1, 'Free MONEY, no risk'), (2, 'plain'), (3, NULL), (4, 'grass') AS d(doc_id, text)")
    words = C.default_word_lists(spark)
    found = C.content_matches(docs, words, ["doc_id"])
    found.explain()
    assert "ArrowEvalPython" in capsys.readouterr().out
    scanned = C.content_matches(docs, words, ["doc_id"], literal_entries=1000)
    assert found.collect() == scanned.collect() and {r["word"] for r in found.collect()} >= {"free", "free money", "no risk", "ass"}
