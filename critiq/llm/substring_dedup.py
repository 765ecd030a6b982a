"""Removal of word runs that stand earlier in the corpus, by difference-cover anchors.

A window of 20 consecutive words is repeated if the same words also start earlier: in a
document with a smaller id, or at an earlier word of the same document. Of different texts with
one id, the one with the smaller xxhash64 comes first. Every word inside a repeated window goes.

Hashing every window would move a row for every word. Instead, anchors of 8 words are hashed
only at positions whose remainder by 13 is in {0, 1, 3, 9}. These remainders are a difference
cover: for any two positions there is a shift below 13 that takes both onto the cover. Two equal
windows of 20 words therefore share an anchor of 8 words at the same place, 4 of 13 positions
are enough, and nothing is missed. Then the anchors found twice are extended: the windows of 20
words that hold one are hashed with 96 bits, and the first of equal windows stays.

The steps, each a Spark shuffle by hash:

1. anchors -> buckets of hashes; a bucket tells which anchors stand twice;
2. these places go to their documents (one shuffle of the text), whose windows go to buckets again;
3. a bucket tells which windows are not the first; these places go to their documents.

Each task deals its anchors and windows out as packed numbers and sends one of equal hashes
only, so a passage of a third of all documents costs a bucket one entry per task, not one
per document. Later copies of a whole text are known by its digest beforehand; they lose all
words without being searched. The number of buckets follows the number of bytes.

Edge cases: null and blank texts have no words; texts of fewer than 20 words lose none. A
document is an id with the xxhash64 of its text (`key`): rows equal in both are one, at equal places
neither is earlier; rows with one id, or none, and different texts are different documents. A null id
comes before all others. Removed words take the blanks before them along. All columns stay; one that has the
name of a result is replaced. Two different windows pass for equal with a chance of 2^-96.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.hashing import from_planes, hash_windows, hash_words, mix, planes, slices
from critiq.llm.rows import NO_ID, give_back, hold
from critiq.session import written

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text whose anchors one bucket holds, about; words are taken to have 6 bytes.
BUCKET_BYTES = 16 << 20
#: Bytes of text that a task looks at together.
CHUNK_BYTES = 8 << 20
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of a hash that are sent: a bucket holds about a million anchors however large the corpus
#: is, and two of those that agree by chance only cost a look; windows are told apart by 96 bits.
ANCHOR_HIGH, WINDOW_HIGH, WINDOW_LOW = (3, 8), (0, 8), (4, 8)
RESULTS = ["n_words", "n_removed"]

#: A document is sent once for its run of entries.
PACKED = "bucket int, known boolean, high binary, low binary, id binary, key binary, run binary, place binary"
FOUND = "bucket int, id binary, key binary, run binary, place binary"
PLACES = "id bigint, key bigint, places array<int>"


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # bytes split at blanks and U+0009 to U+000D only


def _new(*columns: np.ndarray) -> np.ndarray:
    """Which entries differ from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _places_table(ids: np.ndarray, keys: np.ndarray, places: np.ndarray) -> pa.Table:
    """Rows (id, key, places), one per document."""
    order = np.lexsort((places, keys, ids))
    ids, keys, places = ids[order], keys[order], places[order]
    new = np.flatnonzero(_new(ids, keys))
    offsets = pa.array(np.r_[new, len(ids)].astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.array(places.astype(np.int32)))
    return pa.table({"id": pa.array(ids[new], pa.int64()), "key": pa.array(keys[new], pa.int64()), "places": lists})


def _documents(ids: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ids, keys and numbers of entries of the documents that follow each other."""
    new = np.flatnonzero(_new(ids, keys))
    return planes(ids[new]), planes(keys[new]), planes(np.diff(np.r_[new, len(ids)]).astype(np.int64), 0, 4)


def _bucket_of(ids: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    return mix(ids.view(np.uint64) ^ keys.view(np.uint64)) % np.uint64(buckets)


def _deal(
    high: np.ndarray,
    low: np.ndarray,
    ids: np.ndarray,
    keys: np.ndarray,
    places: np.ndarray,
    buckets: int,
    first_stays: bool,
) -> Iterator[pa.RecordBatch]:
    """Pack entries by bucket; of equal hashes one is sent to its bucket.

    The others stand twice for certain. They go, marked as known, to buckets by document.
    With `first_stays` the earliest is sent, and only the others are known to be repeated.
    """
    order = np.lexsort((places, keys, ids, low, high))
    high, low, ids, keys, places = (x[order] for x in (high, low, ids, keys, places))
    same = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
    head = np.r_[True, ~same]
    if first_stays:
        first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        # repeated rows are no earlier place
        own = (ids == ids[first]) & (keys == keys[first]) & (places == places[first])
        high, low, ids, keys, places, head = (x[head | ~own] for x in (high, low, ids, keys, places, head))
        known = ~head
    else:
        twice = np.r_[same, False] | ~head  # its hash stands twice in this chunk
        known = twice & ~head
    target = np.where(known, _bucket_of(ids, keys, buckets), high % np.uint64(buckets))
    flagged = known if first_stays else twice
    by = np.lexsort((places, keys, ids, flagged, target))
    high, low, ids, keys, places, target, known, flagged = (
        x[by] for x in (high, low, ids, keys, places, target, known, flagged)
    )
    cuts = np.flatnonzero(np.r_[True, (target[1:] != target[:-1]) | (flagged[1:] != flagged[:-1]), True])
    rows: dict[str, list] = {n: [] for n in ("bucket", "known", "high", "low", "id", "key", "run", "place")}
    for a, b in zip(cuts[:-1], cuts[1:]):
        rows["bucket"].append(int(target[a]))
        rows["known"].append(bool(flagged[a]))
        sent = ~known[a:b]  # the hash of a known entry is of no use
        rows["high"].append(planes(np.where(sent, high[a:b], 0), *(WINDOW_HIGH if first_stays else ANCHOR_HIGH)))
        rows["low"].append(planes(np.where(sent, low[a:b], 0), *WINDOW_LOW) if first_stays else b"")
        for name, part in zip(("id", "key", "run"), _documents(ids[a:b], keys[a:b])):
            rows[name].append(part)
        rows["place"].append(planes((places[a:b] << 1 | known[a:b]).astype(np.int64)))
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 6]
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))


def _chunk(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Hashes of all words; for each its document's id and key, its place, and the words from it to the end."""
    lists = [_words(text) for text in batch.column("text").to_pylist()]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    hashes = hash_words([word for words in lists for word in words])
    ids, keys = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts) for c in ("id", "key"))
    ends = np.cumsum(counts)
    places = np.arange(len(hashes)) - np.repeat(ends - counts, counts)
    return hashes, ids, keys, places, np.repeat(counts, counts) - places


def anchor_packer(buckets: int, window: int, period: int, cover: tuple[int, ...]) -> Callable:
    length = window - period + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covered = np.isin(np.arange(period), cover)
        for batch in slices(batches, "text", CHUNK_BYTES):
            hashes, ids, keys, places, left = _chunk(batch)
            starts = np.flatnonzero(covered[places % period] & (left >= length) & (left + places >= window))
            if len(starts):
                high = hash_windows(hashes, starts, length, FACTORS[0])
                yield from _deal(high, np.zeros_like(high), ids[starts], keys[starts], places[starts], buckets, False)

    return pack


def window_packer(buckets: int, window: int, period: int) -> Callable:
    """For rows (id, key, text, places of anchors found twice): the windows that hold one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            hashes, ids, keys, places, left = _chunk(batch)
            lists = batch.column("places")
            counts = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            words = np.fromiter((len(_words(t)) for t in batch.column("text").to_pylist()), np.int64, len(counts))
            base = np.repeat(np.cumsum(words) - words, counts)
            at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            inside = at + (window - period + 1) <= np.repeat(words, counts)
            base, at = base[inside], at[inside]
            reach = np.minimum(at, period - 1)
            marks = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(marks, base + at - reach, 1)
            np.add.at(marks, base + at + 1, -1)
            starts = np.flatnonzero((np.cumsum(marks[:-1]) > 0) & (left >= window))
            if len(starts):
                high, low = (hash_windows(hashes, starts, window, f) for f in FACTORS)
                yield from _deal(high, low, ids[starts], keys[starts], places[starts], buckets, True)

    return pack


def _column(table: pa.Table, name: str, *parts: int) -> np.ndarray:
    return np.concatenate([from_planes(x, *parts) for x in table.column(name).to_pylist()])


def _documents_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Id and key of every entry."""
    runs = _column(table, "run", 0, 4)
    return np.repeat(_column(table, "id"), runs), np.repeat(_column(table, "key"), runs)


def _unpack(table: pa.Table, high: tuple[int, int], low: tuple[int, int] | None) -> tuple[np.ndarray, ...]:
    (ids, keys), packed = _documents_of(table), _column(table, "place")
    sizes = [len(x) // 8 for x in table.column("place").to_pylist()]
    flagged = np.repeat(np.array(table.column("known").to_pylist(), bool), sizes)
    second = _column(table, "low", *low) if low else np.zeros_like(ids)
    return _column(table, "high", *high), second, ids, keys, packed >> 1, (packed & 1).astype(bool), flagged


def _by_document(ids: np.ndarray, keys: np.ndarray, places: np.ndarray, buckets: int) -> pa.Table:
    """Places packed by buckets of documents."""
    target = _bucket_of(ids, keys, buckets)
    order = np.lexsort((places, keys, ids, target))
    ids, keys, places, target = ids[order], keys[order], places[order].astype(np.int64), target[order]
    cuts = np.r_[np.flatnonzero(_new(target)), len(ids)]
    parts = list(zip(cuts[:-1], cuts[1:]))
    documents = [_documents(ids[a:b], keys[a:b]) for a, b in parts]
    return pa.table(
        {
            "bucket": pa.array([int(target[a]) for a, _ in parts], pa.int32()),
            **{n: pa.array([d[k] for d in documents], pa.binary()) for k, n in enumerate(("id", "key", "run"))},
            "place": pa.array([planes(places[a:b]) for a, b in parts], pa.binary()),
        }
    )


def places_of_documents(table: pa.Table) -> pa.Table:
    """Of one bucket of documents: a row for each with its places."""
    return _places_table(*_documents_of(table), _column(table, "place"))


def anchors_found_twice(table: pa.Table, buckets: int) -> pa.Table:
    """Of one bucket: the places of anchors whose hash stands twice."""
    high, _, ids, keys, places, known, flagged = _unpack(table, ANCHOR_HIGH, None)
    twice = known.copy()
    asked = np.flatnonzero(~known)
    order = asked[np.argsort(high[asked], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = high[order][1:] != high[order][:-1]
    group = np.cumsum(new) - 1
    entries = np.bincount(group)
    inside = np.bincount(group, weights=flagged[order])
    twice[order] = (entries[group] > 1) | (inside[group] > 0)
    return _by_document(ids[twice], keys[twice], places[twice], buckets)


def windows_not_first(table: pa.Table, buckets: int) -> pa.Table:
    """Of one bucket: the places of windows that also start earlier."""
    high, low, ids, keys, places, known, _ = _unpack(table, WINDOW_HIGH, WINDOW_LOW)
    later = known.copy()
    asked = np.flatnonzero(~known)
    order = asked[np.lexsort((places[asked], keys[asked], ids[asked], low[asked], high[asked]))]
    h, w, i, k, p = high[order], low[order], ids[order], keys[order], places[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later[order] = (i != i[first]) | (k != k[first]) | (p != p[first])
    return _by_document(ids[later], keys[later], places[later], buckets)


def _judged(packed: DataFrame, judge: Callable[[pa.Table, int], pa.Table], buckets: int) -> DataFrame:
    """(id, key, places) of what a judge of buckets finds; both ways are packed, so rows do not multiply."""

    def found(table: pa.Table) -> pa.Table:
        return judge(table, buckets)

    return packed.groupBy("bucket").applyInArrow(found, FOUND).groupBy("bucket").applyInArrow(places_of_documents, PLACES)


def later_copies(docs: DataFrame) -> DataFrame:
    """(id, key) of rows whose whole text also stands under a smaller id."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    texts = docs.where(F.col("text").isNotNull()).select("id", "key", digest.alias("digest"))
    first = texts.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    several = first.where(F.col("first") < F.col("last")).select("digest", "first")
    return texts.join(several, "digest").where(F.col("id") > F.col("first")).select("id", "key").distinct()


@dataclass
class Repeats:
    """Where the words of a corpus stand earlier, by id and key of a text.

    places: (id, key, copy, places) of every document with repeated windows: their starts, in order.
    A later copy of a whole text is told by `copy` and has no places.
    texts: (id, key, text) of documents that may have such places; of copies it has none.
    """

    places: DataFrame
    texts: DataFrame


def find_repeats(docs: DataFrame, window: int = WINDOW) -> Repeats:
    """The repeats of `docs`, which has the columns id (not null), key and text."""
    if window < WINDOW:
        raise ValueError(f"windows of fewer than {WINDOW} words need a difference cover of a shorter period")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    anchors = docs.mapInArrow(anchor_packer(buckets, window, PERIOD, COVER), PACKED)
    twice = _judged(anchors, anchors_found_twice, buckets)
    copies = written(later_copies(docs), "copies")
    marks = twice.select("id", "key", "places", F.lit(False).alias("copy")).unionByName(
        copies.select("id", "key", F.array().cast("array<int>").alias("places"), F.lit(True).alias("copy"))
    )
    marks = marks.groupBy("id", "key").agg(
        F.flatten(F.collect_list("places")).alias("places"), F.max("copy").alias("copy")
    )
    marks = marks.where(~F.col("copy")).hint("merge")  # one way at every size
    searched = written(docs.join(marks, ["id", "key"]).select("id", "key", "text", "places"), "searched")
    windows = searched.mapInArrow(window_packer(buckets, window, PERIOD), PACKED)
    places = _judged(windows, windows_not_first, buckets)
    places = places.select("id", "key", F.lit(False).alias("copy"), "places").unionByName(
        copies.select("id", "key", F.lit(True).alias("copy"), F.array().cast("array<int>").alias("places"))
    )
    return Repeats(written(places, "places"), searched.select("id", "key", "text"))


def _kept(window: int) -> Callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "copy", "places")))
            for text, copy, places in rows:
                words = _words(text)
                stay = np.ones(len(words), bool)
                if copy and len(words) >= window:
                    stay[:] = False
                elif places:
                    starts = np.array(places)
                    starts = starts[starts + window <= len(words)]
                    marks = np.zeros(len(words) + 1, np.int64)
                    np.add.at(marks, starts, 1)
                    np.add.at(marks, starts + window, -1)
                    stay = np.cumsum(marks[:-1]) == 0
                gone = len(words) - int(stay.sum())
                n_words.append(len(words))
                n_removed.append(gone)
                texts.append(_cut(text, words, stay) if gone else text)
            rest = [n for n in batch.schema.names if n not in ("text", "copy", "places")]
            new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), *new], names=[*rest, *RESULTS, "text"])

    return keep


def _cut(text: str, words: list[bytes], stay: np.ndarray) -> str:
    """The text without the words that go and the blanks before them."""
    data, out, at = text.encode(), [], 0
    for word, stays in zip(words, stay.tolist()):
        end = data.index(word, at) + len(word)
        if stays:
            out.append(data[at:end])
        at = end
    return b"".join([*out, data[at:]]).decode()


def _cut_all(rows: DataFrame, window: int) -> DataFrame:
    """Rows with text, copy and places: the text without repeated words, n_words and n_removed instead."""
    fields = [f for f in rows.schema.fields if f.name not in ("text", "copy", "places")]
    schema = [*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "n_words bigint, n_removed bigint, text string"]
    return rows.mapInArrow(_kept(window), ", ".join(schema))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(ids.alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


def changed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, digest, copy, n_removed, text) of the documents that lose words, by id and xxhash64 of their text.

    Only texts that may hold repeats are moved. A later copy of a whole text has a null number and text:
    it loses all words if it has `window` of them.
    """
    found = find_repeats(_keyed(docs, id_col, text_col), window)
    partly = found.texts.dropDuplicates(["id", "key"])
    partly = _cut_all(partly.join(found.places.where(~F.col("copy")).hint("merge"), ["id", "key"]), window)
    partly = partly.where(F.col("n_removed") > 0)
    whole = found.places.where("copy").withColumns(
        {"n_removed": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}
    )
    columns = ["id", F.col("key").alias("digest"), "copy", "n_removed", "text"]
    return partly.withColumn("copy", F.lit(False)).select(*columns).unionByName(whole.select(*columns))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """All rows and columns of `docs`, the text without repeated words, with n_words and n_removed.

    Words that stay keep the blanks before them.
    """
    places = find_repeats(_keyed(docs, id_col, text_col), window).places
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    held = hold(docs, id=ids, key=F.xxhash64(text_col), text=F.col(text_col))
    kept = _cut_all(held.join(places, ["id", "key"], "left").drop("id", "key"), window)
    return give_back(kept.withColumnRenamed("text", text_col), docs, [text_col, *RESULTS])
