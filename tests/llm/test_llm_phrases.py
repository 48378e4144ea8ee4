from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_data import LONG, ODD

from grantmill.llm import phrases


def slow_collocations(rows, least, longest=5, top=2000, covered=100):
    """From dictionaries of all phrases; rows (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        kept = []
        for p, a in frequent.items():
            if len(p) < 2:
                continue
            inside = any(
                100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in frequent.items()
                if len(q) > len(p)
            )
            if not inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def sayings(n, seed=0):
    rng = random.Random(seed)
    words = ["the", "a", "New", "York", "naïve", "中文", "x\x1cy", "of", "in", "city", "-", "Été"]
    fixed = ["New York city of the", "a naïve city", "of of of", "in the\tcity of"]
    return [
        (rng.choice(["en", "fr", None]), rng.choice(". ,;\n").join(rng.choice([*words, *fixed]) for _ in range(rng.randint(1, 40))))
        for _ in range(n)
    ]


def frame(spark, rows):
    made = spark.createDataFrame([(i, t, g, 1.5, "x") for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, n double, words string")
    return made.repartition(3) if rows else made


@pytest.mark.parametrize("covered", [100, 60])
def test_against_dictionaries(spark, covered):
    rows = sayings(150) + [("en", t) for _, t in ODD] + [("und", "New York"), ("en", None), ("en", "a. b")]
    want = slow_collocations(rows, 5, top=40, covered=covered)
    assert {len(r[2].split()) for r in want} == {2, 3, 4, 5}
    assert found(phrases.collocations(frame(spark, rows), least=5, top=40, covered=covered)) == want


def test_small_chunks_tiles_and_lists(spark, monkeypatch):
    """Chunks of a few words, sparse tiles in several parts, lists merged in two rounds."""
    for name, value in {"CHUNK_WORDS": 40, "TEXT_BYTES": 16, "TILE_IDS": 2, "DENSE_CELLS": 8, "LISTS_MERGED": 3, "WORDS_OF_A_PART": 500}.items():
        monkeypatch.setattr(phrases, name, value)
    monkeypatch.setattr(phrases, "CLASSES", 2 << np.arange(21, dtype=np.int64))
    rows = sayings(100, seed=4)
    assert found(phrases.collocations(frame(spark, rows), least=3)) == slow_collocations(rows, 3)


def test_tiles_count_as_sorted_lists_do():
    rng = np.random.default_rng(1)
    left, right = (np.minimum(rng.zipf(1.3, 20000), 200_000).astype(np.int64) for _ in range(2))
    tiles = phrases.tiles_of(left, right, 7)
    assert len(np.unique(tiles)) > 20
    total = Counter()
    for tile in np.unique(tiles):
        which = tiles == tile
        a, b, n = phrases.count_pairs(int(tile), left[which], right[which])
        twice = phrases.count_pairs(int(tile), np.tile(a, 2), np.tile(b, 2), np.tile(n, 2))
        assert (twice[2] == 2 * n).all() and (twice[0] == a).all() and (twice[1] == b).all()
        total.update(dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)))
    assert total == Counter(zip(left.tolist(), right.tolist(), strict=True))


def test_scores_beyond_64_bits(spark):
    row = [(["x", "y"], 10**15, 4 * 10**16, [2 * 10**15, 10**15], [3 * 10**15, 10**15])]
    df = spark.createDataFrame(row, "words array<string>, a long, n long, firsts array<long>, lasts array<long>")
    best = df.select(phrases.F.expr(phrases.CUTS).alias("best")).first().best
    assert (best.score, best.cut, best.l, best.r) == (1000 * 10**15 * 4 * 10**16 // (6 * 10**30), 1, 2 * 10**15, 3 * 10**15)


def test_nothing_frequent_and_nothing_at_all(spark):
    assert found(phrases.collocations(frame(spark, []))) == []
    assert found(phrases.collocations(frame(spark, [("en", LONG[:300])]), least=1000)) == []
    assert found(phrases.collocations(frame(spark, [("en", "a b. a c")]), least=2)) == []


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for numbers in ([], [0], [255, 256, 0], rng.integers(0, 1 << 62, 1000), rng.integers(0, 200, 1000)):
        given = np.array(numbers, np.int64)
        assert (phrases.unpacked(phrases.packed(given)) == given).all()
        given.sort()
        assert (phrases.unpacked(phrases.packed(given, rising=True), rising=True) == given).all()


def rows_made(plan):
    """Output rows of all steps of an executed plan."""
    if "AdaptiveSparkPlanExec" in plan.getClass().getName():
        return rows_made(plan.executedPlan())
    if "QueryStageExec" in plan.getClass().getName():
        return rows_made(plan.plan())
    children = plan.children()
    metric = plan.metrics().get("numOutputRows")
    return (metric.get().value() if metric.isDefined() else 0) + sum(rows_made(children.apply(i)) for i in range(children.size()))


def test_ids_of_words_are_told_in_lists(spark, monkeypatch):
    """Twelve times the texts have more words that are frequent, each in more chunks; no step has a row for every such word of a chunk."""
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 2000)
    made, look_up = [], phrases.word_units

    def watched(*args):
        made.append(look_up(*args))
        return made[-1]

    monkeypatch.setattr(phrases, "word_units", watched)
    rows = [("en", " ".join(f"w{(i * k) % 499}" for i in range(1000))) for k in range(1, 9)]
    for times in (1, 12):
        phrases.frequent_phrases(frame(spark, rows * times), least=10, longest=2)
        assert {len(r.ids) > 0 for r in made[-1].collect()} == {True}
    few, many = (rows_made(df._jdf.queryExecution().executedPlan()) for df in made)
    told = 12 * 8 * 1000 // 2000 * 499
    assert many < told / 2
    assert many <= 12 * few


@pytest.mark.parametrize(("asked", "per_id"), [(4, 1), (4, 1000), (64, 1)])
def test_words_in_parts_and_groups(spark, monkeypatch, asked, per_id):
    """Ids of several parts of the words meet several groups of chunks; words of other scripts are in the same part on both sides."""
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 40)
    monkeypatch.setattr(phrases, "ASKED_WORDS", asked)
    monkeypatch.setattr(phrases, "ASKED_PER_ID", per_id)
    rows = [*sayings(60, seed=7), ("en", None), ("fr", " . "), ("de", "only here")]
    assert found(phrases.collocations(frame(spark, rows), least=3)) == slow_collocations(rows, 3)
