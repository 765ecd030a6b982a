import random

import pytest
import sentencepiece

from critiq.llm import sentencepiece_codec as S
from critiq.llm.queries import piece_model

SPECIAL = [
    "", " ", "  a  b ", "a\nb\t c", "Ａｂ ﬁ", "x\x00y", "\ufffd", "▁a ▁", "e\u0301 é 日本 🙂 \u200b", "a\x85b\xa0c",
    "<s> </s> <unk> <0x41>", "\n", "\n \n", " \t ", "a" * 25, "    " * 10, "a" + " " * 37 + "b", "🙂" * 9, "\ud7ff",
    "नमस्ते दुनिया", "العربية", "1234567890 12,345.67", "def f(x):\n        return x\n", "\n\n a", "a \n",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def own():
    return S.codec(piece_model())


def test_same_ids_and_texts_as_the_library(library, own, prose):
    chance = random.Random(1)
    letters = "abcdefghiABC  \n.,!?0123éßñ日本語🙂▁\x00\u0301"
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    texts = SPECIAL + [" ".join(prose(i, 200)) for i in range(5)]
    texts += ["".join(chance.choice(letters) for _ in range(chance.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chance.choice(pieces) for _ in range(chance.randint(0, 8))) for _ in range(4000)]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids), text


def test_any_ids_are_decoded_as_by_the_library(library, own):
    chance = random.Random(2)
    for _ in range(2000):
        ids = [chance.choice([chance.randrange(3, 259), chance.randrange(1, 32000)]) for _ in range(chance.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_pairs_are_tested_as_by_merging(own):
    chance = random.Random(3)
    pieces = list(own.splits)
    for _ in range(4000):
        pair = chance.choice(pieces), chance.choice(pieces)
        if " " not in pair[1] and not pair[1].startswith("▁"):
            assert own._is_compatible(pair) == (own.merged("".join(pair)) == list(pair)), pair


def test_rows(spark, library):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a  b\nc", "z"), (2, "word " * 30_000, "w")]
    rows += [(3, "same", "s")] * 2
    docs = spark.createDataFrame(rows, "id long, text string, ids string")
    found = S.encode_texts(docs, piece_model()).collect()
    assert sorted(str(r["id"]) for r in found) == ["1", "1", "2", "3", "3", "None"]
    for row in found:
        expected = library.encode(row["text"] or "", add_eos=True)
        assert row["ids"] == expected and row["decoded"] == library.decode(expected)
    assert S.encode_texts(docs.limit(0), piece_model()).count() == 0
