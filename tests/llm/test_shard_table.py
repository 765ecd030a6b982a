import hashlib
from collections import Counter

import pytest

from critiq.llm import shard_table as S


def by_hand(shards, size):
    """The same table from whole preference lists."""
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    wishes = {
        n: iter([(number(f"start:{n}") % size + k * (number(f"step:{n}") % (size - 1) + 1)) % size for k in range(size)])
        for n in sorted(shards)
    }
    table = {}
    while len(table) < size:
        for name in sorted(shards):
            if len(table) < size:
                table[next(slot for slot in wishes[name] if slot not in table)] = name
    return [table[i] for i in range(size)]


def test_table_equals_brute_force_and_is_even():
    for count, size in ((1, 3), (3, 101), (7, 1009)):
        shards = [f"s{i}" for i in range(count)]
        table = S.lookup_table(shards, size)
        assert table == by_hand(shards, size) == S.lookup_table(shards[::-1], size)
        sizes = Counter(table).values()
        assert max(sizes) - min(sizes) <= 1


def test_few_slots_move_when_a_shard_leaves():
    shards = [f"s{i}" for i in range(20)]
    before, after = S.lookup_table(shards), S.lookup_table(shards[:-1])
    moved = sum(a != b for a, b in zip(before, after) if a != "s19")
    assert moved < 0.02 * S.SIZE


def test_wrong_tables():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c", "d"], 3)):
        with pytest.raises(ValueError):
            S.lookup_table(shards, size)


def test_rows_equal_brute_force(spark, tmp_path):
    rows = [(i, f"t{i}", "old") for i in range(300)] + [(5, "t5", "old"), (None, "x", "a"), (None, "y", "a"), (None, "x", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    shards = [f"s{i}" for i in range(5)]
    placed = S.place(docs, shards, size=1009)
    table = by_hand(shards, 1009)
    found = placed.collect()
    assert len(found) == len(rows)
    for row in found:
        if row["doc_id"] is not None:
            assert row["slot"] == int(hashlib.md5(str(row["doc_id"]).encode()).hexdigest()[:15], 16) % 1009
        assert row["shard"] == table[row["slot"]]
    missing = [(r["text"], r["slot"]) for r in found if r["doc_id"] is None]
    assert len(set(missing)) == 2
    sizes = S.shard_sizes(placed).agg({"n_rows": "sum"}).first()[0]
    assert sizes == len(rows) and S.place(docs.limit(0), shards).count() == 0
    S.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
