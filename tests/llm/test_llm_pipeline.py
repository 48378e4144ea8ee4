from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from llm_data import ODD, documents, prose

from grantmill.llm import queries


def test_stages_and_registration():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "toxicity", "simhash_near_duplicates", "best_fit_packing",
    ]
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= entry.queries().keys()
    assert queries.ORACLES.keys() <= entry.oracle_sql().keys()


@pytest.fixture
def folder(spark, tmp_path):
    """Good, junk, toxic and copied documents, with labels of some."""
    good = prose(60)
    junk = ["!!! ### $$$ %%% " * 20 + f"{i}" for i in range(12)]
    toxic = [" ".join(["snotbagger zonkhead", t, "blarghface zonkhead snotbagger"]) for t in prose(30, seed=4)]
    copies = [good[0], good[0] + "", good[1]]
    texts = good + junk + toxic + copies
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(72 <= i < 102)) for i in range(102) if i % 3 and not 60 <= i < 72]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_each_stage_takes_effect_and_keeps_the_rest(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs.write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    good, junk, toxic, copies = set(range(60)), set(range(60, 72)), set(range(72, 102)), {102, 103, 104}
    assert not kept["quality_classifier"] & junk and good <= kept["quality_classifier"]
    assert not kept["toxicity"] & toxic and good <= kept["toxicity"]
    assert not kept["simhash_near_duplicates"] & copies and good <= kept["simhash_near_duplicates"]
    packed = corpus_pipeline.packed(spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == kept["simhash_near_duplicates"]
    assert sum(r.length for r in packed if r.offset == 0) > 0
    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in whole.collect()} == kept["simhash_near_duplicates"]


def test_odd_and_empty_tables_pass_through(spark, tmp_path):
    for name, rows in (("odd", ODD), ("empty", [])):
        folder = tmp_path / name
        documents(spark, rows).select("doc_id", "text", "lang").write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(out.columns)
        assert (out.count() == 0) == (not rows)
