"""Operators that learn: held-out accuracy, brute force where there is one, odd rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import numpy as np
import pytest
import zstandard
from llm_data import ODD, documents, prose
from pyspark.sql import functions as F

from grantmill.llm import lm, quality, toxicity

LARGER = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")


def auc(mark, score):
    mark, score = np.array(mark), np.array(score)
    good, bad = score[mark == 1], score[mark == 0]
    return ((good[:, None] > bad).sum() + 0.5 * (good[:, None] == bad).sum()) / (len(good) * len(bad))


# --- quality ---


def test_label_model_finds_accuracies_and_classes():
    rng = np.random.default_rng(0)
    right = np.linspace(0.75, 0.97, len(quality.LABELLERS))
    good = rng.random(4000) < 0.8
    votes = np.where(rng.random((4000, len(right))) < right, np.where(good, 1, 2)[:, None], np.where(good, 2, 1)[:, None])
    votes[rng.random(votes.shape) < 0.3] = quality.NOTHING
    codes = votes @ 3 ** np.arange(len(right))[::-1]
    assert (quality.votes_of(codes) == votes).all()
    pattern, count = np.unique(codes, return_counts=True)
    model = quality.expectation_maximisation(pattern, count.astype(float))
    assert abs(model.good - 0.8) < 0.03
    assert np.abs(np.array(list(model.accuracies().values())) - right[:, None]).max() < 0.08
    assert ((model.posterior(codes) > 0.5) == good).mean() > 0.98


def test_quality_on_labelled_rows(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    scored = quality.score(docs, quality.fit(docs))
    known = scored.join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").collect()
    assert auc([r.quality for r in known], [r.score for r in known]) > 0.98
    good = [r.score >= 0.5 for r in known if r.quality == 1]
    assert sum(good) / len(good) > 0.98


def test_quality_of_odd_rows(spark):
    df = documents(spark)
    scorer = quality.fit(df)
    rows = quality.score(df, scorer).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)
    by_id = {r.doc_id: (r.posterior, r.score) for r in rows}
    assert by_id[2] == by_id[3] == by_id[4]
    kept = quality.keep_good(df, scorer, threshold=0.0)
    assert kept.columns == df.columns and kept.count() == len(ODD)
    empty = documents(spark, [])
    assert quality.score(empty, quality.fit(empty)).collect() == []


def test_no_labeller_votes_against_languages_it_does_not_know():
    good = {
        "ru": "Совет собрался в понедельник утром и обсудил новую дорогу вдоль реки. Жители долго спорили о цене работ, "
        "но в конце концов решили начать строительство весной, когда земля оттает и лёд сойдёт с воды полностью без остатка.",
        "pl": "Rada zebrała się wczoraj rano, żeby omówić nową drogę wzdłuż rzeki. Mieszkańcy długo spierali się o koszty robót, ale "
        "ostatecznie postanowili rozpocząć budowę wiosną, gdy ziemia odmarznie i lód całkiem zniknie z wody przy starym moście.",
        "tr": "Meclis pazartesi sabahı toplandı ve nehir boyunca yapılacak yeni yolu görüştü. Köylüler işin bedelini uzun süre tartıştı, "
        "sonunda toprak çözülünce inşaata ilkbaharda başlamaya karar verdiler; eski köprü ise bu yıl olduğu gibi kalacak, dediler.",
    }
    for text in good.values():
        votes = dict(zip(quality.LABELLERS, quality.votes_of(np.array([quality.pattern(text)]))[0].tolist(), strict=True))
        assert quality.BAD not in votes.values(), votes
    junk = " ".join(["qwpo zxmv bnty"] * 12)
    assert quality.LABELLERS["common_words"](quality.measure(junk)) == quality.BAD


# --- toxicity ---

INSULTS = ["blarghface", "zonkhead", "grumblewit", "snotbagger"]


def toxic_corpus(n=240, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i, text in enumerate(prose(n, seed)):
        words = text.split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 12)):
                words.insert(int(rng.integers(len(words))), INSULTS[int(rng.integers(4))])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_rows_it_did_not_learn_from(spark):
    rows = toxic_corpus()
    df = documents(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels, learn=F.col("doc_id") % 3 != 0)
    score = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(t, score[i]) for i, _, t in rows if i % 3 == 0]
    assert auc([t for t, _ in held], [s for _, s in held]) > 0.99
    kept = {r.doc_id for r in toxicity.keep_clean(df, model, 0.5).collect()}
    wrong = [i for i, _, t in rows if (i in kept) == bool(t)]
    assert len(wrong) <= 4


def test_savings_are_lengths_of_whole_texts():
    model = toxicity.Model(b"o" * 64, b"o" * 64 + toxicity._coded("zonkhead"), (0.0, 0.0, 0.0, 0.0))
    scorer = toxicity.Scorer(model)
    assert scorer.savings("") == (0, 0, 0)
    clean = "plain words " * 300
    assert scorer.savings(clean)[0] == 0 and scorer.savings(clean)[2] == math.ceil(600 / toxicity.WINDOW_WORDS)
    assert scorer.savings(clean + "zonkhead")[0] > 0


def test_scores_are_lengths_under_two_trained_dictionaries(spark):
    rows = toxic_corpus()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels, learn=F.col("doc_id") % 3 != 0)
    # A trained dictionary begins with the trainer's mark; neither holds the other.
    assert model.toxic[:4] == model.ordinary[:4] or b"\x37\xa4\x30\xec" in (model.toxic[:4], model.ordinary[:4])
    assert model.ordinary not in model.toxic and model.toxic not in model.ordinary
    scores = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}

    def length(window, content):
        content = zstandard.ZstdCompressionDict(content.ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=content, **plain).compress(window))

    for i, text, _ in rows[:40]:
        saved = [length(w, model.ordinary) - length(w, model.toxic) for w in toxicity.windows(text)]
        total, best = sum(x for x in saved if x > 0), max([0, *saved])
        x = model.weights[0] + model.weights[1] * math.log1p(total) + model.weights[2] * math.log1p(best)
        x += model.weights[3] * total / max(len(saved), 1) / toxicity.CODE_BYTES
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-x)))


@pytest.mark.parametrize("marks", [[], [(1, 1, 0)], [(1, 1, 1), (5, 1, 0), (None, 1, 1), (7, 1, None), (999, 0, 1), (1, 1, 0)]])
def test_toxicity_of_odd_rows(spark, marks):
    df = documents(spark)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[2] == by_id[3] == by_id[4]
    empty = documents(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, labels)).collect() == []
    assert toxicity.keep_clean(df, model, 1.1).count() == len(ODD)


def test_scores_do_not_depend_on_the_cap(spark):
    # Labels that texts say nothing about: a score is the share of toxic ones, a tenth.
    df = documents(spark, list(enumerate(prose(1200, seed=5))))
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(1200)], "doc_id long, quality int, toxic int")

    def mean(limit):
        model = toxicity.fit(df, labels, limits=toxicity.Limits(rows_of_a_label=limit, least_rows=10**6))
        scores = [r.score for r in toxicity.score(df, model).collect()]
        return sum(scores) / len(scores)

    assert abs(mean(4000) - 0.1) < 0.05 and abs(mean(120) - 0.1) < 0.05


# --- language models ---


def slow_losses(target, background, texts):
    """The same estimates from plain dictionaries."""

    def counts(given):
        words, firsts, pairs = Counter(), Counter(), Counter()
        for t in given:
            found = [lm.word_entry(w) for w in lm.TOKEN.findall((t or "").lower())]
            for before, word in zip([lm.START, *found], found, strict=False):
                words[word] += 1
                firsts[before] += 1
                pairs[before, word] += 1
        return words, firsts, pairs

    out = []
    both = counts(target), counts(background)
    vocabulary = len({*both[0][0], *both[1][0]}) + 1
    for t in texts:
        found = [lm.word_entry(w) for w in lm.TOKEN.findall((t or "").lower())]
        losses = []
        for words, firsts, pairs in both:
            total = 0.0
            for before, word in zip([lm.START, *found], found, strict=False):
                single = (words[word] + lm.PRIOR) / (sum(words.values()) + lm.PRIOR * vocabulary)
                double = pairs[before, word] / max(firsts[before], 1)
                share = lm.BIGRAM_SHARE if firsts[before] else 0
                total -= math.log(share * double + (1 - share) * single)
            losses.append(total / len(found) if found else None)
        out.append((len(found), *losses))
    return out


def test_losses_as_from_dictionaries(spark):
    rows = ODD[:5] + [(20 + i, t) for i, t in enumerate(prose(12))]
    df = documents(spark, rows)
    target = df.where("doc_id >= 25")
    got = {r.doc_id: r for r in lm.score(df, lm.fit(target, df)).collect() if r.doc_id is not None}
    want = slow_losses([t for i, t in rows if i and i >= 25], [t for _, t in rows], [t for _, t in rows])
    for (i, _), (n, a, b) in zip(rows, want, strict=True):
        if i is None:
            continue
        r = got[i]
        assert r.n_tokens == n
        if n == 0:
            assert r.target_loss is None and r.difference is None
        else:
            assert r.target_loss == pytest.approx(a, rel=1e-4) and r.background_loss == pytest.approx(b, rel=1e-4)
            assert r.difference == pytest.approx(r.target_loss - r.background_loss)


def test_difference_tells_target_texts_apart(spark):
    ours, others = prose(80, seed=1), prose(80, seed=2)
    df = documents(spark, list(enumerate(ours + others)))
    models = lm.fit(df.where("doc_id < 40"), df)
    held = [(r.doc_id < 80, -r.difference) for r in lm.score(df, models).collect() if r.doc_id >= 40]
    assert auc([int(m) for m, _ in held], [d for _, d in held]) > 0.99


def test_no_texts_for_the_models(spark):
    empty = documents(spark, [])
    models = lm.fit(empty, empty)
    assert lm.score(empty, models).collect() == []
    rows = {r.doc_id: r.difference for r in lm.score(documents(spark), models).collect()}
    assert rows[1] == 0 and rows[2] is None


def test_what_follows_a_word_has_probability_one(spark):
    texts = ["a b a c", "b b a", "c d e"]
    models = lm.fit(documents(spark, [(1, texts[0]), (2, texts[1])]), documents(spark, list(enumerate(texts))))
    vocabulary = ["a", "b", "c", "d", "e", "unheard"]
    # Seen before a word, seen only last in the target, not seen at all in the target, and nowhere.
    for before in ("a", "c", "d", "nowhere"):
        asked = [(i, t) for i, word in enumerate(vocabulary) for t in (f"{before} {word}",)] + [(99, before)]
        found = {r.doc_id: r for r in lm.score(documents(spark, asked), models).collect()}
        for loss in ("target_loss", "background_loss"):
            total = sum(math.exp(found[99][loss] - 2 * found[i][loss]) for i in range(len(vocabulary)))
            assert total == pytest.approx(1)


def exact_losses(target, background, texts, vocabulary):
    """The estimates from plain dictionaries of the words themselves."""

    def counts(given):
        words, firsts, pairs = Counter(), Counter(), Counter()
        for found in given:
            words.update(found)
            firsts.update([None, *found[:-1]] if found else [])
            pairs.update(zip([None, *found], found, strict=False))
        return words, firsts, pairs, sum(words.values())

    target, background, texts = ([lm.TOKEN.findall(t.lower()) for t in given] for given in (target, background, texts))
    both = counts(target), counts(background)
    for found in texts:
        yield [
            -sum(
                math.log(
                    (lm.BIGRAM_SHARE if firsts[before] else 0) * pairs[before, word] / max(firsts[before], 1)
                    + (1 - (lm.BIGRAM_SHARE if firsts[before] else 0)) * (words[word] + lm.PRIOR) / (total + lm.PRIOR * vocabulary)
                )
                for before, word in zip([None, *found], found, strict=False)
            )
            / len(found)
            for words, firsts, pairs, total in both
        ]


def test_more_words_and_pairs_than_a_fixed_table(spark):
    rng = np.random.default_rng(3)
    # 300,000 different words and about 2.4 million different pairs, as a table of 2**21 has no room for.
    rows = [(i, " ".join(f"w{n}" for n in rng.integers(300_000, size=24_000))) for i in range(100)]
    texts = [t for _, t in rows]
    df = documents(spark, rows)
    target = df.where("doc_id < 50")
    pairs = {p for t in texts for p in zip(t.split(), t.split()[1:], strict=False)}
    words = len({w for t in texts for w in t.split()})
    assert len(pairs) > 1 << 21 and words > 1 << 18
    seen = "w1 w2 " + texts[60][:2000]
    asked = documents(spark, [(1, seen), (2, "w5 unheard w7")])
    got = {r.doc_id: (r.target_loss, r.background_loss) for r in lm.score(asked, lm.fit(target, df)).collect()}
    want = exact_losses(texts[:50], texts, [seen, "w5 unheard w7"], words + 1)
    assert got == {i: pytest.approx(tuple(w), rel=1e-9) for i, w in enumerate(want, 1)}


def test_rows_that_are_the_background_too(spark, monkeypatch):
    rows = [*ODD, *((20 + i, t) for i, t in enumerate(prose(30)))]
    df = documents(spark, rows)
    ids = spark.createDataFrame([(i,) for i in [5, 5, 8, None, 999, *range(30, 40)]], "doc_id long")
    once = lm.score_background(df, ids)
    apart = lm.score(df, lm.fit(df.join(ids, "doc_id", "left_semi"), df))
    columns = once.columns

    def rounded(found):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found.collect()), key=repr)

    assert columns == ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"]
    assert rounded(once) == rounded(apart) and once.count() == len(rows)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 100)
    assert rounded(lm.score_background(df, ids)) == rounded(apart)


def test_entries_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(lm, "_mixed", lambda first, second: np.zeros_like(first))
    first, second = np.array([7, 3, 7, 3, 7], np.uint64), np.array([1, 1, 2, 1, 1], np.uint64)
    number = lm.same_entries(first, second)
    assert number[0] == number[4] and number[1] == number[3] and len(set(number.tolist())) == 3
