from __future__ import annotations

import math
import re

import pytest
from llm_data import ODD, documents, prose

from grantmill.llm import licenses
from grantmill.llm.licenses import Template

EXTRA = [
    (20, "Released under the MIT License." + " filler" * 100 + " UNDER the\nMIT-license; cc by... nc apache license version 2"),
    (21, " ".join(["a"] * 31) + " cc by nc " + " ".join(["b"] * 40) + " cc by nc"),
    (22, "license mit the under released, in another order"),
    (23, "under the mit licenseé under the mit licens under thé mit license"),
    (24, "cc by nc " * 70),
    (25, "Apache License Version 2 K\u212ak \u212a under the MIT License\u212a under the mit license \u0130\u0049"),
]


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def slow_scan(rows, templates, threshold):
    """Every block against every template."""
    out = []
    for i, text in rows:
        words = split(text)
        hits = []
        for start in range(0, max(len(words), 1), licenses.STRIDE):
            block = words[start : start + 2 * licenses.STRIDE]
            for number, t in enumerate(templates):
                own = t.text.split()
                share = len(set(own) & set(block)) / len(set(own))
                if len(set(own) & set(block)) >= max(1, math.ceil(threshold * len(set(own)) - 1e-9)):
                    places = [
                        start + k
                        for k in range(min(licenses.STRIDE, len(block) - len(own) + 1))
                        if t.phrase and block[k : k + len(own)] == own
                    ]
                    hits.append((number, t.label, start, share, places))
        out.append((i, len(words), sorted(hits)))
    return sorted(out, key=repr)


def fast_scan(df, *args):
    rows = licenses.scan(df, *args).collect()
    return sorted(((r[0], r.n_words, sorted((*h[:4], list(h.places)) for h in r.hits)) for r in rows), key=repr)


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_as_by_comparing_every_block(spark, threshold):
    rows = ODD + EXTRA + [(50 + i, t) for i, t in enumerate(prose(5))]
    templates = licenses.PHRASES + licenses.LINES
    assert fast_scan(documents(spark, rows), templates, threshold) == slow_scan(rows, templates, threshold)


def test_every_place_once_whatever_the_block(spark):
    phrase = (Template("x", "cc by nc", phrase=True),)
    for i, n_words, hits in fast_scan(documents(spark, EXTRA), phrase, 0.85):
        words = split(dict(EXTRA)[i])
        want = [k for k in range(len(words)) if words[k : k + 3] == ["cc", "by", "nc"]]
        assert sorted(p for h in hits for p in h[4]) == want
        assert n_words == len(words)


def test_limits_and_empty_tables(spark):
    assert licenses.scan(documents(spark, [])).collect() == []
    assert [tuple(r) for r in licenses.scan(documents(spark, [(1, "a b")]), ()).collect()] == [(1, 2, [])]
    with pytest.raises(ValueError, match="words"):
        licenses.scan(documents(spark), (Template("x", "w " * 40),))
