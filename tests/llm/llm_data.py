"""Small tables with the cases every operator must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, score double, fp long, ids string, kept boolean, row long, id string"

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(6000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (None, "No id here, but text."),
    (5, "The quick brown fox jumps over the lazy dog."),
    (5, "The quick brown fox jumps over the lazy dog."),
    (6, "É" * 50 + " naïve café İstanbul ΑΣ 中文 \x1c \x00 <|endoftext|> ａｂｃ"),
    (7, "x" * 5000),
    (8, LONG),
    (9, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
    (None, None),
]


def documents(spark, rows=ODD):
    """Rows with columns beside id and text whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, 0.5, 1, "x", None, 3, "y") for i, t in rows], SCHEMA)


def prose(n: int, seed: int = 0) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))) + "." for _ in range(n)]
