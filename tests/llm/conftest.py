import random

import pytest

from critiq.llm.queries import share_code

WORDS = "the of and to in river stone market window letter garden winter simple answer moving ocean quiet paper".split()


@pytest.fixture(scope="session")
def spark(spark):
    share_code(spark)
    return spark


@pytest.fixture
def prose():
    """A function from a seed and a length to words that look like no other seed's."""

    def make(seed: int, length: int) -> list[str]:
        chance = random.Random(seed)
        return [chance.choice(WORDS) + (chance.choice("abcdefghij") * chance.randint(0, 2)) for _ in range(length)]

    return make
