"""The pipeline against a brute-force version on the smallest tables."""

import collections
import re

import pandas as pd
import pytest

import corpus_pipeline
from quarry.llm import queries
from tests.llm.test_operators import LOW, brute_components, docs, none, rows, shingle_set  # noqa: F401

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_follow_each_other(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    left = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, DIR)
        assert out.columns == docs.columns
        seen.append((name, out.toPandas()))
        left = spark.createDataFrame(seen[-1][1], docs.schema)
    kept = dict(seen)
    q = kept["quality_rules"]
    comp = brute_components({r.doc_id: shingle_set(r.text) for r in q.itertuples()})
    assert sorted(kept["near_duplicates"].doc_id) == sorted({*comp.values()})
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = set()
    for t in pd.read_parquet(f"{DIR}/benchmark.parquet").text:
        w = re.findall(rx, t.translate(LOW))
        wins |= {" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    clean = [r.doc_id for r in kept["near_duplicates"].itertuples() if not any(f" {w} " in f" {' '.join(re.findall(rx, r.text.translate(LOW)))} " for w in wins)]
    assert sorted(kept["decontamination"].doc_id) == sorted(clean)
    assert 0 < len(kept["mixture"]) <= len(clean) and set(kept["mixture"].doc_id) <= set(clean)
    got = corpus_pipeline.run(spark, DIR).toPandas()
    assert sorted(got.doc_id) == sorted(kept["mixture"].doc_id) and set(got["shard"]) <= set(range(8))


def test_near_duplicates_tell_texts_apart_under_one_doc_id(spark):
    t = [" ".join(f"{x}{i}" for i in range(60)) for x in "abcdefg"]
    rows = [(3, t[1]), (5, t[0]), (5, t[1]), (5, t[1]), (None, t[2]), (None, t[3]), (None, t[4]), (None, t[4]), (None, t[0]), (9, t[5]), (None, t[5] + " tail"), (7, None), (7, ""), (7, ""), (None, ""), (8, t[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, DIR)
    want = [(3, t[1]), (5, t[0]), (None, t[2]), (None, t[3]), (None, t[4]), (9, t[5]), (7, None), (7, ""), (None, ""), (8, t[6])]
    assert got.columns == docs.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_near_duplicates_of_rows_that_differ_elsewhere(spark):
    """Which of the rows with one doc_id and text stays doesn't depend on their order."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, lang, f"src{i}", i) for i, lang in enumerate(["en", "de", None, "en", "fr"])] + [(2, "other text", "en", "s", 1)] * 2
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    got = [corpus_pipeline.near_duplicates(spark, spark.createDataFrame(r, kind).repartition(n), DIR).collect() for r, n in ((rows, 1), (rows[::-1], 3))]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1])) and len(got[0]) == 2


@pytest.mark.parametrize("stage", [k for k, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_rows(spark, docs, rows, none, stage):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table, columns with the operators' names."""
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, docs, DIR)
    assert got.columns == docs.columns
    have = collections.Counter(map(str, map(tuple, docs.collect())))
    kept = collections.Counter(map(str, map(tuple, got.collect())))
    assert kept and not kept - have
    if stage == "near_duplicates":
        assert max(kept.values()) == 1 and sum(kept.values()) == len(set(map(str, rows))) - 3
    if stage == "decontamination":
        assert kept == have
    assert run(spark, none, DIR).count() == 0


def test_shards_on_odd_rows(spark, docs, rows, none):
    got = corpus_pipeline.shards(spark, docs, DIR).collect()
    assert len(got) == len(rows) and corpus_pipeline.shards(spark, none, DIR).count() == 0


def test_queries_have_no_gaps():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
