import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from test_decontaminate import brute as contaminated
from test_order_minhash import brute as near
from test_substring_dedup import brute as repeats

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, prose, tmp_path):
    item = prose(1, 30)
    passage = prose(2, 60)
    rows = [(i, " ".join(prose(100 + i, 90))) for i in range(20)]
    rows += [(20, rows[3][1]), (21, rows[4][1] + " end"), (22, " ".join(prose(50, 40) + item))]
    rows += [(23, " ".join(prose(51, 30) + passage)), (24, " ".join(prose(52, 50) + passage + prose(53, 9)))]
    rows += [(25, None), (26, ""), (27, "too short"), (None, " ".join(prose(54, 40))), (28, "again and " * 40)]
    rows += [(30 + i, " ".join(w + "%%%" for w in prose(200 + i, 80))) for i in range(20)]
    rows += [rows[5]]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    labels = [(i, 1, 0) for i in range(10)] + [(30, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows, item


def test_run_equals_brute_force(spark, folder):
    path, rows, item = folder
    clean = {i for i, t in rows if i is None or i < 25}
    docs = [(i, t) for i, t in rows if i in clean]
    classes = near(docs)
    one = {i: t for i, t in docs if i is None or classes[i] == i}
    cut = {i: kept for i, _, _, kept in repeats(list(one.items()))}
    rest = {i for i, *_, bad in contaminated(list(cut.items()), [(1, " ".join(item))]) if not bad}
    found = {r["doc_id"]: r for r in C.run(spark, path).collect()}
    assert set(found) == rest
    assert {20, 21, 22}.isdisjoint(found) and {0, 3, 23, 24, None} <= set(found)
    for i, row in found.items():
        assert " ".join(row["text"].split()) == cut[i] and row["n_chars"] == len(row["text"])
        assert row["n_tokens"] == len(row["ids"]) and row["ids"][-1] == 2


def test_stages_keep_the_columns(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0
    assert C.STAGES[-1][1](spark, docs, path).count() == len(rows)


def test_entry_lists_every_operator():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert {"op2_url_templates", "op5_benchmark_decontamination", "op10_substring_dedup"} <= set(entry.oracle_sql())
    assert duckdb.__version__
