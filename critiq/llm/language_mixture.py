"""Language identification by a mixture of languages per document.

Learning counts letter trigrams (with word borders, hashed) per language over all rows that have
a language; each language is a smoothed multinomial over the buckets. A word's likelihood under a
language is the product over its trigrams.

A document is a mixture: each word comes from one of the languages, with unknown proportions.
Expectation-maximisation finds the proportions that make its words most likely. The set of
languages is selected by penalised likelihood: languages are taken out from the smallest
proportion on as long as the log-likelihood falls by less than half the logarithm of the number
of words, the price of a free proportion. The language with the largest proportion is the
prediction, its proportion the score.

Counting moves one row per language, bucket and task. The model has one number per language and
bucket; more than `MOST_LANGUAGES` languages are an error, so its size is bounded.

Edge cases: texts that are null or have no letter are `und` with score 0 and an empty set; so is
everything if there is nothing to learn from. Of equal proportions the language that comes first
in the alphabet wins. Null languages are not learned from. Rows are judged one by one; input
columns stay, one that has the name of a result is replaced.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.hashing import mix, slices
from critiq.llm.rows import give_back, hold
from critiq.session import spread_rows

BUCKETS = 1 << 14
SMOOTHING = 0.5
MOST_LANGUAGES = 200
ROUNDS = 40
CHUNK_BYTES = 2 << 20
UNDECIDED = "und"
RESULTS = ["lang_pred", "score", "languages"]
#: What stands between letters within a word, and what is left of it at the ends.
NOT_LETTERS = re.compile(r"(?:[^\w\n]|[\d_])+")
ENDS = re.compile(" ?\n ?")


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the letter trigrams of words without line ends, and the place of the word each is from.

    Words are lower-cased; a run of other characters is one blank, as is each end. A word
    without letters has none.
    """
    lines = NOT_LETTERS.sub(" ", b"\n".join(words).decode(errors="ignore").lower()).strip(" ")
    points = np.frombuffer(f" {ENDS.sub(' \n ', lines)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    cut = points == 10
    word = np.cumsum(cut)
    lettered = np.bincount(word, weights=_is_letter()[points], minlength=len(words)) > 0
    first, second, third = points[:-2], points[1:-1], points[2:]
    whole = ~(cut[:-2] | cut[1:-1] | cut[2:]) & lettered[word[:-2]]
    packed = (first << 42 | second << 21 | third)[whole].astype(np.uint64)
    return (mix(packed) % np.uint64(BUCKETS)).astype(np.int64), word[:-2][whole]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a partition."""
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text", CHUNK_BYTES):
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            words.setdefault(lang, Counter()).update(text.encode().split())
        for lang, counted in words.items():
            total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            if counted:
                buckets, owner = trigrams(list(counted))
                times = np.fromiter(counted.values(), np.int64, len(counted))
                total += np.bincount(buckets, weights=times[owner], minlength=BUCKETS).astype(np.int64)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        columns = [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])


def learn_languages(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_languages: int = MOST_LANGUAGES
) -> tuple[list[str], np.ndarray]:
    """The languages in order, and per bucket and language the logarithm of its probability."""
    given = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL"
    )
    counts = given.mapInArrow(_count, "lang string, bucket int, n bigint")
    summed = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per_language = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    rows = per_language.limit(most_languages + 1).collect()
    if len(rows) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    rows.sort(key=lambda r: r["lang"])
    table = np.zeros((BUCKETS, len(rows)))
    for column, row in enumerate(rows):
        for bucket, n in row["counts"]:
            table[bucket, column] = n
    return [r["lang"] for r in rows], np.log((table + SMOOTHING) / (table.sum(0) + SMOOTHING * BUCKETS))


def proportions(likelihoods: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """The mixture of the columns that makes the rows most likely, and their log-likelihood."""
    share = np.full(likelihoods.shape[1], 1 / likelihoods.shape[1])
    total = times.sum()
    for _ in range(ROUNDS):
        mixed = likelihoods @ share
        new = share * ((times / mixed) @ likelihoods) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-4:
            break
    return share, float(times @ np.log(likelihoods @ share))


def mixture(logs: np.ndarray, times: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The selected languages and their proportions, from log-likelihoods per word and language."""
    likelihoods = np.maximum(np.exp(logs - logs.max(1, keepdims=True)), 1e-300)
    chosen = list(range(logs.shape[1]))
    share, fit = proportions(likelihoods, times)
    price = 0.5 * np.log(max(times.sum(), 2))
    # languages that no word needs go at once, the others one by one
    needed = [i for i in chosen if share[i] * times.sum() >= 0.5]
    if needed and len(needed) < len(chosen):
        fewer, fit_of_fewer = proportions(likelihoods[:, needed], times)
        if fit - fit_of_fewer < price * (len(chosen) - len(needed)):
            chosen, share, fit = needed, fewer, fit_of_fewer
    while len(chosen) > 1:
        out = int(np.argmin(share))
        rest = chosen[:out] + chosen[out + 1 :]
        fewer, fit_of_fewer = proportions(likelihoods[:, rest], times)
        if fit - fit_of_fewer >= price:
            break
        chosen, share, fit = rest, fewer, fit_of_fewer
    return chosen, share


class WordLogs:
    """Log-likelihoods of words under every language; the words of many texts are worked out at once.

    What is known is kept for the next texts as long as it is at most `most` words.
    """

    def __init__(self, table: np.ndarray, most: int = 200_000):
        self.table, self.most = table, most
        self.rows = np.zeros((0, table.shape[1]))
        self.place: dict[bytes, int] = {}

    def learn(self, texts: list[Counter]) -> None:
        """Know the words of the texts; those of earlier ones may be forgotten."""
        new = list(set().union(*texts).difference(self.place))
        if len(self.place) + len(new) > self.most:
            self.place, self.rows = {}, self.rows[:0]
            new = list(set().union(*texts))
        if not new:
            return
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        buckets, owner = trigrams(new)
        logs = np.full((len(new), self.table.shape[1]), np.nan)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
        if len(starts):
            logs[owner[starts]] = np.add.reduceat(self.table[buckets], starts)
        self.rows = np.concatenate([self.rows, logs])

    def of(self, counted: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Rows and counts of the words of a learned text that have letters."""
        places = np.fromiter(map(self.place.__getitem__, counted), np.int64, len(counted))
        times = np.fromiter(counted.values(), float, len(counted))
        logs = self.rows[places]
        lettered = ~np.isnan(logs[:, 0])
        return logs[lettered], times[lettered]


def _judge(languages: list[str], table: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordLogs(table) if languages else None
        for batch in slices(batches, "text", CHUNK_BYTES):
            best, score, sets = [], [], []
            texts = [Counter((text or "").encode().split()) for text in batch.column("text").to_pylist()]
            if known:
                known.learn(texts)
            for counted in texts:
                logs, times = known.of(counted) if counted and known else ((), ())
                if not len(times):
                    best.append(UNDECIDED), score.append(0.0), sets.append([])
                    continue
                chosen, share = mixture(logs, times)
                top = int(np.argmax(share))
                best.append(languages[chosen[top]])
                score.append(float(min(1.0, share[top])))
                sets.append([{"lang": languages[i], "share": float(s)} for i, s in zip(chosen, share)])
            rest = [n for n in batch.schema.names if n != "text"]
            kinds = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            new = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kinds)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), *new], names=[*rest, *RESULTS])

    return run


def identify_languages(
    docs: DataFrame,
    learn_from: Column,
    lang_col: str = "lang",
    text_col: str = "text",
    most_languages: int = MOST_LANGUAGES,
) -> DataFrame:
    """All rows and columns of `docs` with lang_pred, score and languages (lang, share).

    Only rows where the condition `learn_from` holds are learned from.
    """
    languages, table = learn_languages(docs.where(learn_from), lang_col, text_col, most_languages)
    held = hold(spread_rows(docs), text=F.col(text_col))
    fields = [f for f in held.schema.fields if f.name != "text"]
    schema = ", ".join(
        [
            *(f"{f.name} {f.dataType.simpleString()}" for f in fields),
            "lang_pred string, score double, languages array<struct<lang: string, share: double>>",
        ]
    )
    return give_back(held.mapInArrow(_judge(languages, table), schema), docs, RESULTS)
