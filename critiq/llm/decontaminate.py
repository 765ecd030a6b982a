"""Benchmark decontamination by the n-grams of test items.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. Every
13 consecutive words of a test item are a window; an item of fewer words is one window. The
windows form a set of normalised n-grams. Each document is scanned once, position by position:
a bitmap of the hashed first words of all windows (a constant of the plan, of fixed size) leaves
few positions, whose full word runs are then compared with the set itself. So every hit is
verified word by word, and neither all positions nor any text is shuffled.

The set is broadcast while it has at most `broadcast_windows` entries, and joined by a shuffle
beyond that; the result is the same.

Edge cases: a null or wordless text or item has no words and no windows. Rows with the same id
and text get the same result; rows are never merged. A null id is an id like any other. The windows of
an item with a null id hit like all others; the item is neither listed nor counted. A very long text is
one row and is scanned in it. Columns of the input stay as they are; one with the name of a result is
replaced. An empty benchmark hits nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.rows import give_back, hold
from critiq.session import spread_rows, written

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Words of a window that the bitmap looks at.
LEAD = 3
BITMAP_BITS = 1 << 20
BROADCAST_WINDOWS = 1_000_000
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ["n_words", "n_hit", "n_items", "items", "hit_words", "contaminated"]


def normal_words(text: Column) -> Column:
    """The normalised words of a text; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, NOT_A_WORD), "")


def _run(words: Column, start: Column, length: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, start + k) for k in range(length)])


def _lead_bit(words: Column, start: Column, length: int, bits: int) -> Column:
    """The bit of the first words of a run of `length` words."""
    return F.xxhash64(F.lit(length), *[F.get(words, start + k) for k in range(min(length, LEAD))]).bitwiseAND(bits - 1)


def benchmark_windows(
    benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """The set of windows: run (string), length, lead words, and the ids of the items that have it."""
    items = benchmark.select(F.col(id_col).alias("item"), normal_words(F.col(text_col)).alias("words"))
    size = F.size("words")
    length = F.least(size, F.lit(window))
    starts = F.when(size > 0, F.sequence(F.lit(0), size - length))
    windows = items.select("item", "words", length.alias("length"), F.explode_outer(starts).alias("start"))
    windows = windows.where(F.col("start").isNotNull())
    return (
        windows.select(
            "item", "length", F.slice("words", F.col("start") + 1, F.col("length")).alias("gram")
        )
        .groupBy("gram", "length")
        .agg(F.collect_set("item").alias("of_items"))
        .select(F.concat_ws(" ", "gram").alias("run"), "length", "gram", "of_items")
    )


def _bitmap(windows: DataFrame, lengths: list[int], bits: int) -> Column:
    """One bit per hash of leading words, as a constant array of 64-bit numbers."""
    gram, zero = F.col("gram"), F.lit(0)
    leads = F.coalesce(*[F.when(F.col("length") == n, _lead_bit(gram, zero, min(n, LEAD), bits)) for n in lengths])
    word = F.shiftright(F.col("bit"), 6).cast("int").alias("word")
    mask = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    rows = windows.select(leads.alias("bit")).groupBy(word).agg(F.bit_or(mask).alias("mask")).collect()
    words = [0] * (bits // 64)
    for row in rows:
        words[row["word"]] = row["mask"]
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>")


def _candidates(texts: DataFrame, windows: DataFrame, lengths: list[int], bits: int) -> DataFrame:
    """(id, digest, start, length, run) of every position that may start a window."""
    bitmap, words = _bitmap(windows, lengths, bits), F.col("words")
    last = F.size(words) - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last))

    def may_start(lead: int) -> Callable[[Column], Column]:
        def test(i: Column) -> Column:
            bit = _lead_bit(words, i, lead, bits)
            mask = F.get(bitmap, F.shiftright(bit, 6).cast("int"))
            return (F.size(words) - i >= lead) & (F.getbit(mask, bit.bitwiseAND(63).cast("int")) == 1)

        return test

    def windows_at(length: int) -> Column:
        fitting = F.filter(f"starts_{min(length, LEAD)}", lambda i: F.size(words) - i >= length)
        return F.transform(
            fitting,
            lambda i: F.struct(i.alias("start"), F.lit(length).alias("length"), _run(words, i, length).alias("run")),
        )

    leads = sorted({min(n, LEAD) for n in lengths})
    texts = texts.withColumns({f"starts_{n}": F.filter(starts, may_start(n)) for n in leads})
    starting = F.flatten(F.array(*[windows_at(n) for n in lengths]))
    rows = texts.select("id", "digest", F.explode_outer(starting).alias("at"))
    return rows.where(F.col("at").isNotNull()).select("id", "digest", "at.*")


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    bitmap_bits: int = BITMAP_BITS,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """All rows and columns of `docs` with n_words, n_hit, n_items, items, hit_words, contaminated.

    `items` are the ids of test items with a window in the document, sorted as strings;
    `hit_words` are the positions of the words inside such windows, in order.
    """
    windows = written(benchmark_windows(benchmark, window=window), "benchmark-windows")
    sizes = {r["length"]: r["count"] for r in windows.groupBy("length").count().collect()}
    held = hold(spread_rows(docs), id=F.col(id_col), text=F.col(text_col))
    held = held.withColumns({"digest": F.xxhash64("text"), "words": normal_words(F.col("text"))})
    held = held.withColumn("n_words", F.size("words").cast("long"))
    nothing = {"hit_words": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    if sizes:
        known = windows.select("run", "length", "of_items")
        if sum(sizes.values()) <= broadcast_windows:
            known = F.broadcast(known)
        candidates = _candidates(held, windows, sorted(sizes), bitmap_bits)
        hits = candidates.join(known, ["run", "length"])
        inside = F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)
        by_text = hits.groupBy("id", "digest").agg(
            F.array_distinct(F.flatten(F.collect_set(inside))).alias("hit_words"),
            F.array_distinct(F.flatten(F.collect_set("of_items"))).alias("items"),
        )
        by_text = by_text.select(
            F.col("id").alias("hit_id"),
            F.col("digest").alias("hit_digest"),
            F.sort_array("hit_words").alias("hit_words"),
            F.sort_array(F.col("items").cast("array<string>")).alias("items"),
        )
        same = F.col("id").eqNullSafe(F.col("hit_id")) & F.col("digest").eqNullSafe(F.col("hit_digest"))
        held = held.drop("words").join(by_text, same, "left")
        held = held.withColumns({n: F.coalesce(n, empty) for n, empty in nothing.items()})
    else:
        held = held.drop("words").withColumns(nothing)
    held = held.withColumns(
        {"n_hit": F.size("hit_words").cast("long"), "n_items": F.size("items").cast("long")}
    )
    share = (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))
    return give_back(held.withColumn("contaminated", share), docs, RESULTS)


def remove_hits(found: DataFrame, text_col: str = "text", whole: bool = True) -> DataFrame:
    """Clean texts from the result of `find_hits`, without its result columns.

    With `whole`, contaminated documents go and all others stay as they are. Without it all
    documents stay, and every hit word goes from its text, with the separator before it.
    """
    if whole:
        return found.where(~F.col("contaminated")).drop(*RESULTS)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = hold(found, text=text, hit_words=F.col("hit_words"))
    held = held.withColumns(
        {
            "raw": F.regexp_extract_all("text", F.lit(word), F.lit(0)),
            "between": F.split("text", word),
        }
    )
    last = F.size("raw") - 1
    places = F.array_except(F.when(last >= 0, F.sequence(F.lit(0), last)), F.col("hit_words"))
    stay = F.transform(places, lambda i: F.concat(F.get("between", i), F.get("raw", i)))
    cut = F.concat(F.array_join(stay, ""), F.element_at("between", -1))
    named = hold(found).columns
    old = F.col(named[found.columns.index(text_col)])
    held = held.withColumn(text_col, F.when(F.size("hit_words") > 0, cut).otherwise(old))
    names = [c for c in found.columns if c not in RESULTS]
    return give_back(held, found, [text_col]).select(*names)
