"""What Python workers remember between texts."""

from __future__ import annotations

from grantmill.llm import quality, toxicity
from grantmill.llm.common import Remembered


def test_only_the_operator_at_work_remembers():
    found = quality.hashed("some words to remember")
    assert quality._slots
    toxicity.windows("some words to remember")
    assert toxicity._codes and not quality._slots
    assert quality.hashed("some words to remember") == found
    assert quality._slots and not toxicity._codes


def test_memories_of_one_operator_stay_together():
    words, blocks = Remembered(10, "one"), Remembered(10, "one")
    words.turn()["a"], blocks.turn()["b"] = 1, 2
    assert words.turn() == {"a": 1} and blocks.turn() == {"b": 2}
    quality.hashed("other words")
    assert not words.now and not blocks.now
