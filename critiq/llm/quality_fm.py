"""A quality classifier: a factorisation machine over hashed words, structure and metadata.

A text is a sparse vector x of hashed words (weighted by the logarithm of their count), of
statistics of its structure, and of its length. The machine scores

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

with a short vector v_i per feature. The pairs need no loop over pairs: for each factor their sum
is half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2. The logistic function of the score is the
probability of the label 1.

It is fitted on at most `most_rows` labelled rows, those with the smallest hash of their id, by
adaptive gradient steps in a fixed order: the bounded sample is small enough for one process.
Scoring is one pass over all whole texts.

Edge cases: a null text is an empty one and is scored too. Null labels and labels of null ids are
left out; of an id with several labels or several texts the smallest counts. Without labelled rows every score is 0.5. If all
labels are equal the scores go towards that label. Rows are scored one by one; input columns
stay, one that has the name of a result is replaced. A very long text is one row, whose words are
counted at once. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.hashing import slices
from critiq.llm.rows import give_back, hold
from critiq.session import spread_rows

HASHED = 1 << 12
FACTORS = 8
MOST_ROWS = 12_000
EPOCHS = 8
RATE = 0.05
SHRINK = 1e-5
BATCH = 64
CHUNK_BYTES = 8 << 20
THRESHOLD = 0.3
RESULTS = ["score", "predicted"]

STRUCTURE = (
    "length", "upper", "digits", "symbols", "marks", "blanks", "beyond_ascii", "word_length", "line_length",
    "repeated_lines", "distinct_words", "longest_word", "upper_words", "sentence_ends", "short_words", "few_words",
)
SYMBOL_BYTES = b"#*$%&|<>{}[]\\^~=+_@/"
MARK_BYTES = b"!?"
DIGIT_BYTES = b"0123456789"
UPPER_BYTES = bytes(range(65, 91))
BLANK_BYTES = b" \t\n\x0b\x0c\r"


class _Places(dict):
    """The hash bucket of a word."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh32_intdigest(word) % HASHED
        if len(word) <= 48:
            if len(self) >= 300_000:
                self.clear()
            self[word] = value
        return value


_PLACES = _Places()


def structure(data: bytes, words: list[bytes]) -> list[float]:
    """The statistics named in STRUCTURE, each about between 0 and 1."""
    size, n = max(1, len(data)), max(1, len(words))
    share = lambda kinds: (len(data) - len(data.translate(None, kinds))) / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    beyond = len(data) - len(data.translate(None, bytes(range(128, 256))))
    return [
        np.log1p(len(data)) / 12,
        share(UPPER_BYTES),
        share(DIGIT_BYTES),
        min(1.0, 10 * share(SYMBOL_BYTES)),
        min(1.0, 10 * share(MARK_BYTES)),
        share(BLANK_BYTES),
        beyond / size,
        min(1.0, sum(map(len, words)) / n / 16),
        np.log1p(size / max(1, len(lines))) / 12,
        1 - len(set(lines)) / max(1, len(lines)),
        len(set(words)) / n,
        min(1.0, max(map(len, words), default=0) / 100),
        sum(w.isupper() for w in words) / n,
        min(1.0, 5 * data.count(b".") / n),
        sum(len(w) < 3 for w in words) / n,
        1 / n,
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The indices and values of a text's vector; structure comes after the hashed words."""
    data = (text or "").encode()
    words = data.split()
    counted = Counter(map(_PLACES.__getitem__, words))
    places = np.fromiter(counted, np.int64, len(counted))
    values = np.log1p(np.fromiter(counted.values(), np.float64, len(counted)))
    norm = np.sqrt((values**2).sum()) or 1.0
    return (
        np.r_[places, np.arange(HASHED, HASHED + len(STRUCTURE))],
        np.r_[values / norm, structure(data, words)],
    )


@dataclass
class Machine:
    """The parameters: a constant, a weight and a short vector per feature."""

    constant: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The scores of vectors that stand one after the other from `starts` on."""
        linear = np.add.reduceat(self.weights[places] * values, starts)
        scaled = self.vectors[places] * values[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat(scaled**2, starts, axis=0)
        return self.constant + linear + 0.5 * (sums**2 - squares).sum(1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Adaptive gradient descent on the logistic loss, in an order that depends on nothing else."""
    size = HASHED + len(STRUCTURE)
    chance = np.random.default_rng(20)
    machine = Machine(0.0, np.zeros(size), chance.normal(0, 0.02, (size, FACTORS)))
    if not len(labels):
        return Machine(0.0, np.zeros(size), np.zeros((size, FACTORS)))
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    machine.constant = float(np.log(rate / (1 - rate)))
    seen_w, seen_v, seen_c = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = chance.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            places = np.concatenate([vectors[i][0] for i in chosen])
            values = np.concatenate([vectors[i][1] for i in chosen])
            counts = [len(vectors[i][0]) for i in chosen]
            starts = np.cumsum([0, *counts[:-1]])
            rows = np.repeat(np.arange(len(chosen)), counts)
            error = (_logistic(machine.score(places, values, starts)) - labels[chosen]) / len(chosen)
            scaled = machine.vectors[places] * values[:, None]
            sums = np.add.reduceat(scaled, starts, axis=0)
            slope = error[rows] * values
            own, inverse = np.unique(places, return_inverse=True)
            grad_w = np.bincount(inverse, weights=slope, minlength=len(own)) + SHRINK * machine.weights[own]
            by_pair = slope[:, None] * (sums[rows] - scaled)
            grad_v = np.zeros((len(own), FACTORS))
            for k in range(FACTORS):
                grad_v[:, k] = np.bincount(inverse, weights=by_pair[:, k], minlength=len(own))
            grad_v += SHRINK * machine.vectors[own]
            seen_w[own] += grad_w**2
            seen_v[own] += grad_v**2
            machine.weights[own] -= RATE * grad_w / np.sqrt(seen_w[own])
            machine.vectors[own] -= RATE * grad_v / np.sqrt(seen_v[own])
            seen_c += error.sum() ** 2
            machine.constant -= RATE * error.sum() / np.sqrt(seen_c)
    return machine


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", CHUNK_BYTES):
        found = [features(t) for t in batch.column("text").to_pylist()]
        columns = [
            batch.column("id"),
            batch.column("label"),
            pa.array([p.astype(np.int32).tobytes() for p, _ in found], pa.binary()),
            pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "places", "amounts"])


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_rows: int = MOST_ROWS,
) -> Machine:
    """The machine fitted on at most `most_rows` labelled documents."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        "id IS NOT NULL AND label IS NOT NULL"
    )
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most `most_rows` ids and labels are broadcast
    chosen = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    kinds = f"id {dict(chosen.dtypes)['id']}, label int, places binary, amounts binary"
    rows = chosen.mapInArrow(_vectors, kinds).toPandas()
    rows = rows.sort_values("id")
    vectors = [
        (np.frombuffer(p, np.int32), np.frombuffer(a, np.float32).astype(float))
        for p, a in zip(rows.pop("places"), rows.pop("amounts"))
    ]
    return fit(vectors, rows["label"].to_numpy(float))


def _scorer(machine: Machine, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            found = [features(t) for t in batch.column("text").to_pylist()]
            starts = np.cumsum([0, *(len(p) for p, _ in found[:-1])])
            places, values = np.concatenate([p for p, _ in found]), np.concatenate([v for _, v in found])
            scores = _logistic(machine.score(places, values, starts))
            rest = [n for n in batch.schema.names if n != "text"]
            new = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), *new], names=[*rest, *RESULTS])

    return run


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """All rows and columns of `docs` with score and predicted; `labels` are the rows to learn from."""
    machine = learn_quality(docs, labels, id_col, text_col, label_col, most_rows)
    held = hold(spread_rows(docs), text=F.col(text_col))
    fields = [f for f in held.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "score double, predicted int"])
    return give_back(held.mapInArrow(_scorer(machine, threshold), schema), docs, RESULTS)
