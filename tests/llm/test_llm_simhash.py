from __future__ import annotations

import random
import re

import pytest
import xxhash
from llm_data import ODD, documents, prose

from grantmill.llm import simhash
from grantmill.llm.graph import components


def slow_fingerprint(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def groups(prints, radius):
    """Smallest reachable index of each fingerprint, by comparing all."""
    root = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius:
                    root[i] = min(root[i], root[j])
    return root


def test_fingerprints(spark):
    texts = [t or "" for _, t in ODD] + prose(5)
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    got = {r.doc_id: r.fp for r in simhash.fingerprints(documents(spark)).collect() if r.doc_id in (2, 3, 4, 7)}
    assert got == {2: 0, 3: 0, 4: 0, 7: signed(slow_fingerprint("x" * 5000))}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("step_values", [1 << 22, 1 << 10])
def test_links_as_by_comparing_all(spark, monkeypatch, radius, step_values):
    monkeypatch.setattr(simhash, "STEP_VALUES", step_values)
    rng = random.Random(radius)
    prints = [rng.getrandbits(64) for _ in range(12)]
    for _ in range(40):  # chains of copies at one to six bits
        old = rng.choice(prints)
        prints.append(old ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    prints = sorted(set(prints))
    import numpy as np

    every = np.array(prints, np.uint64)
    a, b = simhash.bucket_links(every, np.zeros(len(every), np.int32), 64, radius)
    link = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert [prints.index(link.get(p, p)) for p in prints] == groups(prints, radius)
    if step_values < 1 << 22 or radius not in (3, 4):
        return
    monkeypatch.setattr(simhash, "BUCKET_VALUES", 1 << 8)  # many buckets
    df = spark.createDataFrame([(signed(p),) for p in prints] * 2 + [(None,)], "fp long")
    found = {r.fp: r.root for r in simhash.link_fingerprints(df, radius).collect()}
    want = groups(prints, radius)
    for i, p in enumerate(prints):
        for j, q in enumerate(prints):
            same = found.get(signed(p), signed(p)) == found.get(signed(q), signed(q))
            assert same == (want[i] == want[j])


def test_documents_and_one_of_each_group(spark):
    base = prose(6, seed=1)
    rows = ODD + [(100 + i, t) for i, t in enumerate(base)] + [(200 + i, t + " more") for i, t in enumerate(base)]
    df = documents(spark, rows)
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    prints = [slow_fingerprint(t or "") for _, t in rows]
    root = groups(prints, 4)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (least.get(r), i) != (None, None) else None
    want = sorted(((i, signed(p), least[r]) for (i, _), p, r in zip(rows, prints, root, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in found), key=repr) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    smallest = {i for i, _, c in want if i is not None and i == c}
    assert sorted(i for i in ids if i is not None) == sorted(smallest)
    # The text without an id that no other is near; the null text goes with the empty ones.
    assert ids.count(None) == 1


def test_one_of_each_group_by_rows_and_not_by_ids(spark):
    one, two, three = prose(3, seed=8)
    df = documents(spark, [(1, one), (1, two), (None, three), (None, three), (4, two), (0, None), (1, one)])
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=repr)
    assert kept == sorted([(1, one), (1, two), (None, three), (0, None)], key=repr)


def test_empty_table(spark):
    empty = documents(spark, [])
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in components(df, "a", "b").collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}
    assert components(df.limit(0), "a", "b").collect() == []
