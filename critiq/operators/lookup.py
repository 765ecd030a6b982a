"""Vocabularies too long for the plan, looked up inside the row.

A vocabulary is broadcast in blocks whose size in bytes is checked; a longer one is several blocks, and
texts pass all of them in one stage. No text and no word of a text is shuffled, so neither a frequent word
nor a frequent text gathers in one task. A dictionary of more than one block is first reduced to
the words that occur at all.

The functions for the workers are defined inside others, so that they travel by value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from critiq.session import written

#: Bytes of a vocabulary that a task holds as one block, about.
BLOCK_BYTES = 32 << 20
#: What an entry needs besides its characters.
ENTRY_BYTES = 64


def _entry_size(rows: DataFrame) -> Column:
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in rows.schema if f.dataType.simpleString() == "string"]
    size = F.lit(ENTRY_BYTES)
    for length in texts:
        size = size + length
    return size


def blocks(rows: DataFrame) -> list[Broadcast]:
    """The rows in their order as broadcast lists of tuples; the driver holds one block at a time."""
    context = rows.sparkSession.sparkContext

    def cut() -> Iterator[list[tuple]]:
        block, held = [], 0
        for row in rows.select("*", _entry_size(rows).alias("_size")).toLocalIterator():
            if block and held + row["_size"] > BLOCK_BYTES:
                yield block
                block, held = [], 0
            block.append(tuple(row)[:-1])
            held += row["_size"]
        if block:
            yield block

    return [context.broadcast({"rows": block}) for block in cut()]


def dictionary_blocks(dictionary: DataFrame, word: str, texts: DataFrame, words: Column) -> list[Broadcast]:
    """A dictionary with one row per word, in blocks; `words` is the array of words of each of the texts."""
    size = dictionary.agg(F.sum(_entry_size(dictionary))).first()[0] or 0
    if size > BLOCK_BYTES:
        occurring = texts.select(F.explode(words).alias(word)).distinct()
        dictionary = written(dictionary.join(occurring, word, "left_semi"), "dictionary")
    return blocks(dictionary)


def _by_distinct_words(block: Broadcast, answer: Callable) -> Callable:
    """A function of lists of words: `answer` gets what is known of every word, and where each list begins."""

    def look_up(lists):
        import numpy as np
        import pyarrow.compute as pc

        known = block.value
        if "by_word" not in known:  # once per worker process
            known["by_word"] = {row[0]: row[1] for row in known["rows"]}
        coded = lists.flatten().dictionary_encode()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        found = [known["by_word"].get(word) for word in coded.dictionary.to_pylist()]
        return answer(found, coded.indices, starts, lists)

    return look_up


def replacements(words: Column, block: Broadcast) -> Column:
    """For each word what the block (word, other word) has for it, else null."""

    def answer(found, places, starts, lists):
        import pyarrow as pa

        values = pa.array(found, pa.string()).take(places)
        offsets = pa.array(starts.astype("int32"))
        return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null() if lists.null_count else None)

    return F.arrow_udf(_by_distinct_words(block, answer), "array<string>")(words)


def tallies(words: Column, block: Broadcast, kind: str) -> Column:
    """Struct of the sum of the numbers that the block (word, number) has, and of how many, positive and negative ones."""

    def answer(found, places, starts, lists):
        import numpy as np
        import pyarrow as pa

        units = np.array([x or 0 for x in found], np.int64)
        hits = np.array([x is not None for x in found], np.int64)
        at = places.to_numpy(zero_copy_only=False)
        sums = []
        for values in (units, hits, (units > 0).astype(np.int64), (units < 0).astype(np.int64)):
            total = np.concatenate([[0], np.cumsum(values[at])]) if len(at) else np.zeros(1, np.int64)
            sums.append(pa.array(total[starts[1:]] - total[starts[:-1]], pa.int64()))
        return pa.StructArray.from_arrays(sums, names=["units", "hits", "positive", "negative"])

    return F.arrow_udf(_by_distinct_words(block, answer), kind)(words)


def matcher(text: Column, block: Broadcast, kind: str) -> Column:
    """The entries of a block whose last field occurs in the text, in their order, found by one automaton."""

    def match(texts):
        import ahocorasick
        import pyarrow as pa

        known = block.value
        if "automaton" not in known:  # once per worker process
            automaton, by_needle = ahocorasick.Automaton(), {}
            for place, row in enumerate(known["rows"]):
                by_needle.setdefault(row[-1], []).append(place)
            known["always"] = by_needle.pop("", [])
            for needle, places in by_needle.items():
                automaton.add_word(needle, places)
            automaton.make_automaton()
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
            columns = [pa.array(column, kind) for column, kind in zip(zip(*known["rows"]), kinds)]
            known["entries"] = pa.StructArray.from_arrays(columns, names=["list_name", "word", "severity", "position", "needle"])
            known["automaton"] = automaton if by_needle else None
        ends, places = [0], []
        for one in texts.to_pylist():
            found = set(known["always"]) if one is not None else set()
            if one and known["automaton"] is not None:
                for _, own in known["automaton"].iter(one):
                    found.update(own)
            places.extend(sorted(found))
            ends.append(len(places))
        chosen = known["entries"].take(pa.array(places, pa.int64()))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chosen)

    return F.arrow_udf(match, kind)(text)
