"""SentencePiece encoding and decoding of byte-pair models by a table of last tokens.

A byte-pair encoding has one valid form, and every prefix of a text has one too. So it is
enough to store, for each prefix, its last token: the token that ends there, follows the last
token of the prefix before it, and is compatible with it, which means that the pair is encoded
as these two tokens. Candidates are the vocabulary matches that end at a character, found by an
automaton; a pair is tested once and remembered. The ids are read off the table backwards.

No token reaches from another character into a blank, and characters outside the vocabulary
are tokens of their own. So texts are cut before every run of blanks and around line ends, and each
distinct piece is encoded once per worker as far as memory allows. The number of remembered
pieces and pairs is bounded; what does not fit is encoded again.

Whether a pair is compatible follows from the merges that made its tokens: undone from the last
to the first, none of the pairs that then meet at the border may merge earlier.

The vocabulary file is read where it lies on each executor (its path is a parameter). Models
must be byte-pair models with byte fallback, identity normalisation and a leading blank.

Edge cases: null texts are empty: an end id only. Characters outside the vocabulary become
byte tokens. A text that holds U+2581 decodes with blanks in its place, as in the library.
Rows are encoded one by one; all columns stay, one that has the name of a result is replaced.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.hashing import slices
from critiq.llm.rows import give_back, hold
from critiq.session import spread_rows

BLANK = "▁"
#: Words, and pairs of tokens, that a worker remembers twice over.
WORD_MEMORY, PAIR_MEMORY = 150_000, 300_000
CHUNK_BYTES = 8 << 20
#: A run of blanks and what follows it up to the next blank.
PIECES = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
RESULTS = ["ids", "decoded"]


class _Memory(dict):
    """Values made on demand. When full, what it holds becomes the older half; frequent values come back from there."""

    def __init__(self, make: Callable, longest: int, most: int):
        super().__init__()
        self.make, self.longest, self.most = make, longest, most
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("critiq-each-byte", _each_byte)


class Codec:
    """One vocabulary, ready to encode and decode."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.end = model.eos_id()
        size = range(model.get_piece_size())
        names = {model.id_to_piece(i): i for i in size if model.is_byte(i)}
        self.byte_ids = [names[f"<0x{b:02X}>"] for b in range(256)]
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
        pieces = {i: model.id_to_piece(i) for i in size if not special(i) and not model.is_unused(i)}
        self.scores = {p: model.get_score(i) for i, p in pieces.items()}
        self.ids = {p: i for i, p in pieces.items()}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError("the vocabulary has pieces that reach into a blank")
        if any("\n" in p for p in self.ids):
            raise ValueError("the vocabulary has pieces with line ends")
        # a byte from 0x80 on stands as a lone surrogate until all tokens are joined
        self.values = set(self.byte_ids)
        self.text_of = {i: "" for i in size}
        self.text_of |= {i: p.replace(BLANK, " ") for i, p in pieces.items()}
        self.text_of |= {i: chr(b) if b < 0x80 else chr(0xDC00 + b) for b, i in enumerate(self.byte_ids)}
        self.splits: dict[str, tuple[str, str]] = {}
        self.uneven: set[str] = set()
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1 and self._learn(piece):  # others never come out of merging
                # with the tokens that were tested before it
                self.automaton.add_word(piece, (piece, len(piece), {}))
        self.automaton.make_automaton()
        self.tested = 0
        self.tokens = _Memory(self._code_token, 1, WORD_MEMORY)
        self.tokens |= {token: self._coded([i]) for token, i in self.ids.items()}
        self.pieces = _Memory(self.code_piece, 40, WORD_MEMORY // 3)
        self.words = _Memory(self._code_word, 40, WORD_MEMORY)
        self.line_end = self._coded([self.byte_ids[10]])

    def _merges(self, text: str) -> Iterator[tuple[str, str, list[str]]]:
        """Merge the best pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            joined = [a + b for a, b in zip(parts, parts[1:])]
            best = max(range(len(joined)), key=lambda i: (self.scores.get(joined[i], float("-inf")), -i))
            if joined[best] not in self.scores:
                return
            pair = parts[best], parts[best + 1]
            parts[best : best + 2] = [joined[best]]
            yield *pair, parts

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text, step by step."""
        parts = list(text)
        for _, _, parts in self._merges(text):
            pass
        return parts

    def _learn(self, piece: str) -> bool:
        """Note the last merge of a piece, and whether its merges come in the order of their scores."""
        scores, last, parts = [], None, []
        for left, right, parts in self._merges(piece):
            scores.append(self.scores[left + right])
            last = left, right
        if parts != [piece]:
            return False
        self.splits[piece] = last
        if any(a <= b for a, b in zip(scores, scores[1:])):
            self.uneven.add(piece)
        return True

    def _is_compatible(self, pair: tuple[str, str]) -> bool:
        left, right = pair
        if left in self.uneven or right in self.uneven:
            return self.merged(left + right) == [left, right]
        scores, splits = self.scores, self.splits
        limit, equal_counts = float("-inf"), False
        while True:
            met = scores.get(left + right)
            if met is not None and (met > limit or (equal_counts and met == limit)):
                return False
            made_left = scores[left] if left in splits else float("inf")
            made_right = scores[right] if right in splits else float("inf")
            if made_left == made_right == float("inf"):
                return True
            if made_left < made_right:  # made later: undo it; of equal merges the left one comes first
                limit, equal_counts, left = made_left, False, splits[left][1]
            else:
                limit, equal_counts, right = made_right, True, splits[right][0]

    def _forget_pairs(self) -> None:
        for _, _, tested in self.automaton.values():
            tested.clear()
        self.tested = 0

    def code_piece(self, piece: str) -> tuple[bytes, str]:
        """Ids, packed, and their text, of a text between two cuts."""
        last: list[str] = []  # the last token of every prefix
        reached = 0
        for end, (token, length, tested) in self.automaton.iter(piece):
            if end < reached:
                continue  # a longer token was taken here
            while reached < end:  # no match went well with what is before it
                last.append(piece[reached])
                reached += 1
            before = end - length
            if before >= 0:
                left = last[before]
                goes = tested.get(left)
                if goes is None:
                    goes = tested[left] = self._is_compatible((left, token))
                    self.tested += 1
                if not goes:
                    continue
            last.append(token)
            reached += 1
        last.extend(piece[reached:])
        if self.tested > PAIR_MEMORY:
            self._forget_pairs()
        parts = []
        at = len(piece) - 1
        while at >= 0:
            token = last[at]
            parts.append(self.tokens[token])
            at -= len(token)
        parts.reverse()
        return _joined(parts)

    def _code_token(self, token: str) -> tuple[bytes, str]:
        """A character outside the vocabulary: its bytes."""
        return self._coded([self.byte_ids[b] for b in token.encode()])

    def _coded(self, ids: list[int]) -> tuple[bytes, str]:
        """Ids in packed form, and their text."""
        return array("i", ids).tobytes(), "".join(map(self.text_of.__getitem__, ids))

    def _code_word(self, word: str) -> tuple[bytes, str]:
        """A blank and the word after it, which may hold line ends."""
        if "\n" not in word:
            return self.code_piece(BLANK + word)
        first, *lines = word.split("\n")
        parts = [self.words[first]]
        for line in lines:
            parts.append(self.line_end)
            if line:
                parts.append(self.pieces[line])
        return _joined(parts)

    def code(self, text: str | None) -> tuple[bytes, str]:
        """The packed ids of a text without the end id, and the text of these ids."""
        if not text:
            return b"", ""
        if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
            parts = list(map(self.pieces.__getitem__, PIECES.findall(BLANK + text.replace(" ", BLANK))))
        else:
            parts = list(map(self.words.__getitem__, text.split(" ")))
        ids, joined = _joined(parts)
        return ids, self._finished(joined, memoryview(ids).cast("i"))

    def encode(self, text: str | None) -> list[int]:
        return [*memoryview(self.code(text)[0]).cast("i"), self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte tokens as UTF-8, control ids as nothing, the leading blank off."""
        return self._finished("".join(map(self.text_of.__getitem__, ids)), ids)

    def _finished(self, text: str, ids: Sequence[int]) -> str:
        if not text.isascii():
            text = text.encode(errors="surrogateescape").decode(errors="critiq-each-byte")
        if not text.startswith(" "):
            return text
        first = next((i for i in ids if self.text_of[i]), None)
        return text if first in self.values else text[1:]


def _joined(parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
    return b"".join([p[0] for p in parts]), "".join([p[1] for p in parts])


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def _coder(model_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in slices(batches, "text", CHUNK_BYTES):
            texts = batch.column("text").to_pylist()
            rest = [n for n in batch.schema.names if n != "text"]
            end = array("i", [own.end]).tobytes()
            coded = [own.code(text) for text in texts]
            ends = np.cumsum([0, *(len(ids) // 4 + 1 for ids, _ in coded)], dtype=np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join([ids + end for ids, _ in coded]))])
            new = [pa.ListArray.from_arrays(pa.array(ends), values), pa.array([text for _, text in coded], pa.string())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), *new], names=[*rest, *RESULTS])

    return run


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs` with `ids` (with an end id) and `decoded`, the text of these ids."""
    held = hold(spread_rows(docs), text=F.col(text_col))
    fields = [f for f in held.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "ids array<int>, decoded string"])
    return give_back(held.mapInArrow(_coder(model_path), schema), docs, RESULTS)
