from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from llm_data import LONG, ODD, documents

from grantmill.llm import queries, spelling

LETTERS = "A-Za-zÀ-ÿ"


def slow_words(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall(f"[{LETTERS}]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def is_near(a, b):
    """One insertion, deletion or replacement, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(counts, ratio=10):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= ratio * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), counts[form[w]] if w in form else 0) for w, n in counts.items())


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def made_words(rng, n):
    """Words with many edits of each other, of few letters, so that prefixes and suffixes overlap."""
    words = set()
    while len(words) < n:
        base = "".join(rng.choice("abé") for _ in range(rng.randint(6, 12)))
        words |= {base, base + "a", base[1:], base[:4] + "b" + base[4:]}
    return sorted(w for w in words if len(w) >= 7)


def test_counts_of_odd_texts(spark):
    rows = [*ODD, (30, "Straße ×÷ÀÉÀÉÀ CAFÉSTRASSE cafÉstrasse CafÉstrasse")]
    rows += [(i, "Abcdefgh abcdefgh") for i in range(200)]
    df = spelling.count_words(documents(spark, rows), LETTERS, 7)
    assert {r.word: r.n for r in df.collect()} == slow_words(rows)


def test_pairs_as_by_trying_all_edits(spark):
    rng = random.Random(3)
    counts = {w: rng.choice((2, 3, 25, 30, 300, 4000)) for w in made_words(rng, 400)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.variants(words, 7)) == slow_variants(counts)
    assert any(r[1] and r[1] != r[2] for r in slow_variants(counts)), "no chain of forms to follow"


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_ROWS", 8)
    rng = random.Random(5)
    counts = {w: rng.choice((2, 30, 300)) for w in made_words(rng, 250)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert rows_of(spelling.variants(words, 7)) == slow_variants(counts)


def test_ties_take_the_smallest_word(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 50, "baaaaaa": 50, "zzzzzzzzz": 2, "aaaaaaaa": 2, "ÿaaaaaa": 50}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r[0]: r for r in rows_of(spelling.variants(words, 7))}
    assert found["aaaaaaa"] == ("aaaaaaa", "aaaaaab", "aaaaaab", 2, 4, 50)
    assert found["zzzzzzzzz"] == ("zzzzzzzzz", "", "zzzzzzzzz", 2, 0, 0)


def test_other_alphabets_and_short_words(spark):
    counts = {"中文": 2, "中文字": 40, "中": 2, "a": 2, "b": 90, "\U0001f600\U0001f600": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.variants(words, 1)) == slow_variants(counts)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = made_words(rng, 120)
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice((5, 400))]) for _ in range(60))) for i in range(120)]
    rows += [*ODD, (9, LONG)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = rows_of(queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path)))
    assert found == slow_variants(slow_words(rows))


def test_empty_table(spark):
    counted = spelling.count_words(documents(spark, []), LETTERS, 7)
    assert spelling.variants(counted, 7).collect() == []
