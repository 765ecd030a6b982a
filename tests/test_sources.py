import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from critiq.operators import tables
from critiq.sources import artifacts, csv_reviews, jsonl, limits, profile, word_lists


def write_lines(path, lines):
    with gzip.open(path, "wt", encoding="utf-8") as out:
        out.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


BOOKS = [
    {"parent_asin": "A", "title": "T", "author": {"name": "N"}, "description": ["x", "y"],
     "categories": ["c", "d"], "price": "12.5", "images": [{"large": "u"}, 2], "average_rating": 4,
     "rating_number": 4.7, "details": {"k": 1, "l": [1]}, "features": ["f"]},
    {},
    {"parent_asin": "B", "author": None, "images": [], "title": None, "description": "abc"},
    "{broken",
    "",
    {"price": None},
    {"price": "-"},
    {"description": None},
    {"description": [1]},
    {"author": "plain"},
    {"rating_number": "4.0"},
    "[1]",
    {"parent_asin": "C", "author": {}, "price": 3, "rating_number": "7", "images": ["p"]},
]


def test_books(spark, tmp_path):
    path = write_lines(tmp_path / "books.jsonl.gz", BOOKS)
    scan = jsonl.read_books(spark, path)
    rows = {r["asin"]: r for r in scan.rows.collect()}
    assert set(rows) == {"A", "", "B", "C"} and len(scan.rows.columns) == 15
    a = rows["A"]
    assert (a["author"], a["description"], a["price"], a["rating_count"]) == ("N", "x y", 12.5, 4)
    assert json.loads(a["image_url"]) == {"large": "u"} and a["details"] == {"k": "1", "l": "[1]"}
    empty = rows[""]
    assert (empty["title"], empty["price"], empty["rating_count"]) == ("", 0.0, 0)
    assert empty["categories"] == [] and empty["details"] == {} and empty["image_url"] is None
    b = rows["B"]
    assert b["title"] is None and b["author"] == "" and b["description"] == "a b c"
    assert rows["C"]["rating_count"] == 7 and rows["C"]["image_url"] == "p"
    reasons = [r["reason"] for r in scan.rejects.collect()]
    assert sorted(reasons) == sorted(
        ["not a JSON object"] * 3 + ["price"] * 2 + ["description"] * 2 + ["author", "rating_number"]
    )
    assert jsonl.read_books(spark, path, limit=4).rows.count() == 3  # bad lines count
    assert jsonl.read_books(spark, path, limit=0).rows.count() == 4


REVIEWS = [
    {"asin": "A", "reviewText": "one two", "overall": 5, "reviewTime": "09 13, 2009", "vote": "3",
     "helpful": [1, 2], "style": {"Format:": "Paper"}, "verified": True, "unixReviewTime": 7},
    {"reviewText": "", "reviewTime": "10 1, 2010"},
    {"asin": "Z", "reviewText": None},
    "{broken",
]


def test_reviews_and_their_books(spark, tmp_path):
    path = write_lines(tmp_path / "reviews.jsonl.gz", REVIEWS)
    scan = jsonl.read_reviews(spark, path)
    assert scan.rows.count() == 3 and scan.rejects.first()["reason"] == "not JSON"
    prepared = {r["asin"]: r for r in tables.prepare_for_analysis(scan.rows).collect()}
    a = prepared["A"]
    assert (a["rating"], a["review_length"], a["word_count"]) == (5.0, 7, 2)
    assert str(a["review_time"]) == "2009-09-13 00:00:00" and a["style"] == {"Format:": "Paper"}
    blank = prepared[""]
    assert (blank["word_count"], blank["helpful"], blank["vote"]) == (0, [0, 0], "")
    assert str(blank["review_time"]) == "2010-10-01 00:00:00"
    assert prepared["Z"]["review_text"] is None and prepared["Z"]["word_count"] is None
    books = spark.createDataFrame(
        [("A", "t1", "m"), ("A", "t2", "m"), ("", "blank", "m"), (None, "null", "m")],
        "asin string, title string, main_category string",
    )
    merged = tables.merge_books_and_reviews(books, scan.rows)
    titles = sorted((r["asin"], r["title"]) for r in merged.select("asin", F.coalesce("title", F.lit("-")).alias("title")).collect())
    assert titles == [("", "blank"), ("A", "t1"), ("A", "t2"), ("Z", "-")]
    salted = tables.merge_books_and_reviews(books, scan.rows, salts=5)
    assert sorted(map(str, salted.collect())) == sorted(map(str, merged.collect()))
    nulls = spark.createDataFrame([(None,)], "asin string")
    again = tables.merge_books_and_reviews(books, nulls, match_null_keys=True, salts=3)
    assert again.columns == ["asin", "title", "main_category"] and again.first()["title"] == "null"
    assert tables.merge_books_and_reviews(books, nulls).first()["title"] is None
    assert tables.merge_books_and_reviews(books, nulls, match_null_keys=True).first()["title"] == "null"


def test_copies_of_a_salted_join_are_not_broadcast(spark, capsys):
    # tables whose size Spark knows to be small
    books = spark.sql("SELECT * FROM VALUES ('A', 't', 'm'), (NULL, 'n', 'm') AS b(asin, title, main_category)")
    reviews = spark.sql("SELECT * FROM VALUES ('A', 1), ('A', 2), ('B', 3), (NULL, 4) AS r(asin, n)")
    for match_null_keys, of_null in ((False, None), (True, "n")):
        salted = tables.merge_books_and_reviews(books, reviews, match_null_keys, salts=3)
        salted.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert sorted((r["n"], r["title"]) for r in salted.collect()) == [(1, "t"), (2, "t"), (3, None), (4, of_null)]


@pytest.mark.parametrize("bad", [{"overall": None}, {"overall": "x"}, {"unixReviewTime": "x"}, "[1]"])
def test_bad_review_numbers(spark, tmp_path, bad):
    path = write_lines(tmp_path / "reviews.jsonl.gz", [*REVIEWS, bad])
    dropped = jsonl.read_reviews(spark, path, on_bad="drop")
    assert dropped.rows.count() == 3 and dropped.rejects.count() == 2
    with pytest.raises(Exception, match="unusable review"):
        jsonl.read_reviews(spark, path).rows.collect()


def test_csv(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text('Title,description,ratingsCount\na,"line one\nline ""two""",4\n,,\nNaN,null,2.5\n')
    rows = csv_reviews.load_reviews(spark, str(path)).collect()
    assert [(r["title"], r["text"], r["rating"]) for r in rows] == [
        ("a", 'line one\nline "two"', 4.0), ("", "", 0.0), ("", "", 2.5),
    ]
    assert [r["asin"] for r in rows] == ["book_0", "book_1", "book_2"]
    assert rows[1]["user_id"] == "user_1" and rows[0]["verified_purchase"] is False
    assert csv_reviews.load_reviews(spark, str(path), limit=2).count() == 2
    everything = csv_reviews.load_reviews(spark, str(path), limit=None)
    assert sorted(r["asin"] for r in everything.collect()) == ["book_0", "book_1", "book_2"]
    assert csv_reviews.read_csv(spark, str(path)).filter("Title IS NULL").count() == 2
    found = csv_reviews.resolve_csv(spark, str(tmp_path / "absent.csv"), str(tmp_path))
    assert found.endswith("reviews.csv")
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        csv_reviews.resolve_csv(spark, str(tmp_path / "absent.csv"), str(empty))


def test_csv_bad_rating_and_absent_columns(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("ratingsCount,x\nabc,1\n")
    with pytest.raises(Exception, match="rating is no number"):
        csv_reviews.load_reviews(spark, str(path)).collect()
    row = csv_reviews.load_reviews(spark, str(path), on_bad="zero").first()
    assert (row["rating"], row["title"], row["text"]) == (0.0, "", "")


def test_file_positions_over_several_files(spark, tmp_path):
    for name, start in (("a", 0), ("b", 100), ("c", 200)):
        (tmp_path / f"{name}.csv").write_text("v\n" + "".join(f"{start + i}\n" for i in range(50)))
    rows = spark.read.csv(str(tmp_path), header=True)
    placed = {int(r["v"]): r["position"] for r in limits.file_positions(rows).collect()}
    assert placed == {start + i: k * 50 + i for k, start in enumerate((0, 100, 200)) for i in range(50)}


def test_training_text(spark):
    df = spark.createDataFrame([("t", None, 0), ("u", "x", 2)], "title string, text string, helpful_votes int")
    rows = tables.training_text(df).collect()
    assert [(r["text"], r["is_helpful"]) for r in rows] == [
        ("Title: t Review: ", 0), ("Title: u Review: x", 1),
    ]


def test_histories_results_and_latest(spark, tmp_path):
    for name, loss in (("run1", [0.5, 0.25]), ("run2", [])):
        folder = tmp_path / name
        folder.mkdir()
        history = {"train_loss": loss, "train_acc": [0.5, 0.75], "val_loss": [], "val_acc": []}
        (folder / "training_history.json").write_text(json.dumps(history, indent=4))
        result = {"accuracy": 0.5, "confusion_matrix": [[1, 2], [3, 4]], "labels": [0, 1]}
        (folder / "evaluation_results.json").write_text(json.dumps(result, indent=4))
    last = artifacts.history_compare(artifacts.read_histories(spark, str(tmp_path)))
    assert sorted(map(tuple, last.collect())) == [("run1", 0.25, 0.75), ("run2", None, 0.75)]
    results = artifacts.read_evaluations(spark, str(tmp_path))
    assert results.filter("checkpoint = 'run1'").first()["confusion_matrix"] == [[1, 2], [3, 4]]
    os.utime(tmp_path / "run1" / "training_history.json", (2_000_000_000, 2_000_000_000))
    newest = artifacts.latest_artifact(spark, str(tmp_path), "*.json").first()
    assert newest["path"].endswith("run1/training_history.json") and newest["folder"].endswith("run1")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5)], "label int, text string, x double")
    artifacts.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["x"] == 0.5
    artifacts.write_held_out(df, str(tmp_path / "held"))
    assert spark.read.parquet(str(tmp_path / "held")).columns == ["text", "label"]


def test_profile(spark, tmp_path):
    long = "x" * 120
    items = [{"a": [1, 2], "b": {"k": 1}, "c": long, "d": None, "e": 1.5}, "{bad", {"a": "s", "f": True}]
    path = write_lines(tmp_path / "meta.jsonl.gz", items)
    lines = profile.read_lines(spark, path)
    kinds = {(r["field"], r["value_kind"], r["n"]) for r in profile.json_profile(lines).collect()}
    assert kinds == {
        ("a", "list", 1), ("a", "string", 1), ("b", "dict", 1), ("c", "string", 1),
        ("d", "null", 1), ("e", "number", 1), ("f", "boolean", 1),
    }
    short = {(r["field"], r["summary"]) for r in profile.json_value_summary(lines).collect()}
    assert short == {
        ("a", "List with 2 items"), ("b", "Dict with 1 keys"), ("c", "x" * 100 + "..."),
        ("d", "null"), ("e", "1.5"), ("a", "s"), ("f", "true"),
    }
    assert profile.json_profile(profile.read_lines(spark, path, 2)).count() == 5


def numbered_files(folder, sizes, name="part-%03d.txt"):
    """Text files of running numbers; the last one cannot be read."""
    n = 0
    for i, size in enumerate(sizes):
        (folder / (name % i)).write_text("".join(f"{n + k}\n" for k in range(size)))
        n += size
    (folder / "zz-broken.txt.gz").write_bytes(b"no gzip at all")
    return n


def test_a_limit_leaves_later_files_alone(spark, tmp_path):
    total = numbered_files(tmp_path, [3, 0, 40, 1, 1, 1, 1, 90, 5, 7, 200] + [1] * 20)
    for limit in (1, 3, 4, 43, 44, 46, 47, 48, 137, 138, 340):
        found = sorted(int(r["value"]) for r in limits.first_lines(spark, str(tmp_path), limit).collect())
        assert found == list(range(limit))
    with pytest.raises(Exception):
        limits.first_lines(spark, str(tmp_path), total + 1).collect()


def test_files_counted_for_a_limit(spark):
    sizes = {f"f{i:02d}": s for i, s in enumerate([2, 2, 2, 50, 2, 2] + [9] * 30)}
    asked = []

    def read(paths):
        asked.append(list(paths))
        return spark.range(sum(sizes[p] for p in paths))

    whole, last, left = limits.leading_files(sorted(sizes), read, 57)
    assert (whole, last, left) == ([f"f{i:02d}" for i in range(4)], "f04", 1)
    assert max(p for paths in asked for p in paths) <= "f06"
    assert limits.leading_files(sorted(sizes), read, 10_000) == (sorted(sizes), None, 0)
    assert limits.leading_files([], read, 3) == ([], None, 0)


def test_a_limit_inside_a_file_of_many_splits(spark, tmp_path):
    numbered_files(tmp_path, [500, 3])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        found = sorted(int(r["value"]) for r in limits.first_lines(spark, str(tmp_path), 321).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == list(range(321))


def test_a_csv_limit_leaves_later_files_alone(spark, tmp_path):
    for i in range(12):
        rows = "".join(f'"t{3 * i + k}","line\nbreak"\n' for k in range(3))
        (tmp_path / f"p{i:02d}.csv").write_text("Title,description\n" + rows)
    (tmp_path / "zz.csv.gz").write_bytes(b"no gzip at all")
    for limit in (1, 3, 5, 12):
        assert sorted(r["Title"] for r in csv_reviews.read_csv(spark, str(tmp_path), limit).collect()) == sorted(f"t{i}" for i in range(limit))
        found = csv_reviews.load_reviews(spark, str(tmp_path), limit).collect()
        assert sorted((r["asin"], r["title"]) for r in found) == sorted((f"book_{i}", f"t{i}") for i in range(limit))


def cut_short(path, lines):
    """A file whose last third cannot be read."""
    whole = gzip.compress("".join(lines).encode())
    path.write_bytes(whole[: len(whole) * 2 // 3])


def test_a_csv_limit_leaves_the_rest_of_a_file_alone(spark, tmp_path):
    rows = [f'"t{i}","line\nbreak {os.urandom(1000).hex()}",{i}\n' for i in range(2_000)]
    (tmp_path / "a.csv").write_text("Title,description,ratingsCount\n" + "".join(rows[:3]))
    cut_short(tmp_path / "b.csv.gz", ["Title,description,ratingsCount\n", *rows[3:]])
    for limit in (2, 3, 4, 30):
        found = csv_reviews.load_reviews(spark, str(tmp_path), limit).collect()
        assert sorted((r["rating"], r["asin"], r["title"]) for r in found) == [(i, f"book_{i}", f"t{i}") for i in range(limit)]
        assert csv_reviews.load_reviews(spark, str(tmp_path / "b.csv.gz"), limit).count() == limit


def test_rejects_name_their_file_and_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"price": 1}\n{broken\n{"price": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"price": "-"}\n')
    (tmp_path / "c.jsonl").write_text('{"price": 3}\n\n[1]\n')
    scan = jsonl.read_books(spark, str(tmp_path))
    places = sorted((r["file"].rsplit("/", 1)[1], r["line_number"], r["reason"]) for r in scan.rejects.collect())
    assert places == [("a.jsonl", 2, "not a JSON object"), ("b.jsonl", 1, "price"), ("c.jsonl", 2, "not a JSON object"), ("c.jsonl", 3, "not a JSON object")]
    jsonl.write_rejects(scan, f"{tmp_path}/kept")
    assert {r["reason"] for r in spark.read.json(f"{tmp_path}/kept").collect()} == {"price", "not a JSON object"}
    first = jsonl.read_books(spark, str(tmp_path / "*.jsonl"), limit=4)
    assert first.rejects.count() == 2 and first.rows.count() == 2


def test_rejected_lines_of_word_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# note\na|b|1\nbad\n\nx|y|many\n")
    found = word_lists.read_word_lists(spark, str(tmp_path)).rejects.collect()
    assert sorted((r["line_number"], r["line"], r["reason"]) for r in found) == [(3, "bad", "not three parts"), (5, "x|y|many", "severity")]


def test_repeated_keys_count_alike_before_and_after_a_reader(spark):
    lines = spark.createDataFrame([('{"a": 1, "a": "x"}',)], "value string")
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    assert [(r["field"], r["value_kind"]) for r in profile.json_profile(lines).collect()] == [("a", "string")]
