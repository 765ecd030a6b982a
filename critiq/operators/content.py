"""Severity-weighted word lists matched against texts.

A word matches wherever it occurs, inside longer words too. Word lists of up
to SCANNED_ENTRIES rows are written into the plan, and each text is scanned once
for every row; longer ones are broadcast in blocks, each searched for by one
automaton in one pass. Either way every operator is a map
over the texts without a shuffle. Without word lists nothing matches. An entry
without a word or a list is left out; a missing severity weighs nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from critiq import fixed_values as fixed
from critiq.operators import lookup
from critiq.operators.bounds import rows_if_small

# Each entry written into the plan costs one more pass over every text, so that
# an automaton is cheaper beyond a few.
SCANNED_ENTRIES = 16

WORD_LIST_SCHEMA = "list_name string, word string, category string, severity int, position long"
_MATCH = "array<struct<list_name: string, word: string, severity: int, position: bigint, needle: string>>"


def default_word_lists(spark: SparkSession) -> DataFrame:
    """The built-in word lists."""
    rows = []
    for name, lines in fixed.DEFAULT_WORD_LISTS.items():
        for position, line in enumerate(lines.strip().splitlines()):
            word, category, severity = line.split("|")
            rows.append((name, word, category, int(severity), position))
    return spark.createDataFrame(rows, WORD_LIST_SCHEMA)


def words_by_list(words: DataFrame, list_name: str) -> DataFrame:
    """Entries of one list; none if there is no such list."""
    return words.filter(F.col("list_name") == list_name)


def words_by_severity(words: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    """Entries of all lists with severity from low to high, both included."""
    return words.filter(F.col("severity").between(low, high))


def _entries(words: DataFrame) -> DataFrame:
    """The entries with what is looked for; those without a word or a list are left out."""
    listed = words.where(F.col("word").isNotNull() & F.col("list_name").isNotNull())
    return listed.select(
        "list_name", "word", F.col("severity").cast("int").alias("severity"), F.col("position").cast("long").alias("position"),
        F.lower("word").alias("needle"),
    )


def _matches_in_row(text: Column, rows: Sequence) -> Column:
    entries = F.from_json(F.lit(json.dumps([row.asDict() for row in rows])), _MATCH)
    # The one-element array binds the lower-case text once for all words.
    return F.transform(
        F.array(F.lower(text)),
        lambda lowered: F.filter(entries, lambda entry: F.contains(lowered, entry["needle"])),
    )[0]


def _matches(text: str, words: DataFrame, literal_entries: int) -> Column:
    """The entries found in a text as an array, in the order of list and position; empty for a missing text."""
    entries = _entries(words)
    rows = rows_if_small(entries, literal_entries)
    none = F.array().cast(_MATCH)
    if rows == []:
        return none
    if rows is not None:
        in_order = sorted(rows, key=lambda row: (row["list_name"], row["position"] is not None, row["position"] or 0, row["word"]))
        return F.coalesce(_matches_in_row(F.col(text), in_order), none)
    ordered = entries.orderBy("list_name", "position", "word")
    found = [lookup.matcher(F.lower(text), block, _MATCH) for block in lookup.blocks(ordered)]
    return found[0] if len(found) == 1 else F.concat(*found)


def content_matches(
    docs: DataFrame,
    words: DataFrame,
    key: Sequence[str],
    text: str = "text",
    literal_entries: int = SCANNED_ENTRIES,
) -> DataFrame:
    """One row per text and word-list entry found in it, however often it occurs."""
    return docs.select(*key, F.inline(_matches(text, words, literal_entries))).drop("needle")


def _totals(matches: Column) -> Column:
    """Per list with a match: number of matches and their total severity; a missing severity adds nothing."""

    def total(name: Column) -> Column:
        own = F.filter(matches, lambda match: match["list_name"] == name)
        weight = F.aggregate(
            own, F.lit(0).cast("long"), lambda acc, match: acc + F.coalesce(match["severity"], F.lit(0))
        )
        return F.struct(
            name.alias("list_name"), F.size(own).cast("long").alias("n_matches"), weight.alias("total_severity")
        )

    names = F.array_distinct(F.transform(matches, lambda match: match["list_name"]))
    return F.transform(names, total)


def content_check(
    docs: DataFrame,
    words: DataFrame,
    key: Sequence[str],
    text: str = "text",
    literal_entries: int = SCANNED_ENTRIES,
) -> DataFrame:
    """Per text and list with a match: number of matches and total severity."""
    found = docs.select(*key, _matches(text, words, literal_entries).alias("_matches"))
    return found.select(*key, F.inline(_totals(F.col("_matches"))))


def severity_summary(
    docs: DataFrame,
    words: DataFrame,
    key: Sequence[str],
    text: str = "text",
    literal_entries: int = SCANNED_ENTRIES,
) -> DataFrame:
    """Per text and list with a match: total severity."""
    return content_check(docs, words, key, text, literal_entries).drop("n_matches")


def with_content_checks(
    docs: DataFrame,
    words: DataFrame,
    key: Sequence[str],
    text: str = "text",
    max_severity: int = fixed.MAX_SEVERITY,
    lists: Sequence[str] | None = None,
    literal_entries: int = SCANNED_ENTRIES,
) -> DataFrame:
    """Add matches and severity_summary as maps by list, and is_appropriate.

    A text is appropriate unless the total severity of some list exceeds
    max_severity. All lists count unless `lists` names the ones that do.
    """
    if lists is not None:
        words = words.filter(F.col("list_name").isin(list(lists)))
    checked = (
        docs.withColumn("_matches", _matches(text, words, literal_entries))
        .withColumn("_totals", _totals(F.col("_matches")))
        .withColumns(
            {
                "matches": F.map_from_entries(
                    F.transform(
                        "_totals",
                        lambda t: F.struct(
                            t["list_name"],
                            F.transform(
                                F.filter("_matches", lambda m: m["list_name"] == t["list_name"]),
                                lambda m: F.struct(m["word"].alias("word"), m["severity"].alias("severity")),
                            ),
                        ),
                    )
                ),
                "severity_summary": F.map_from_entries(
                    F.transform("_totals", lambda t: F.struct(t["list_name"], t["total_severity"]))
                ),
            }
        )
        .drop("_matches", "_totals")
    )
    within = F.forall(F.map_values("severity_summary"), lambda total: total <= max_severity)
    return checked.withColumn("is_appropriate", within)


def content_appropriate(
    docs: DataFrame,
    words: DataFrame,
    key: Sequence[str],
    text: str = "text",
    max_severity: int = fixed.MAX_SEVERITY,
    lists: Sequence[str] | None = None,
    literal_entries: int = SCANNED_ENTRIES,
) -> DataFrame:
    """Whether no word list weighs more than max_severity in the text."""
    checked = with_content_checks(docs, words, key, text, max_severity, lists, literal_entries)
    return checked.select(*key, "is_appropriate")
