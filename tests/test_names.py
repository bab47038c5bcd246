"""The trigram index against brute force, and names as the benchmark has them."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import clean_name, percent_decoded
from quarry.operators import lookup, names


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abÄ %") for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["Mixed CASE name", "x" * 3000, "aaa", "aaa"]


def test_containing_equals_brute_force(spark, words):
    terms = sorted({w[i : i + n] for w in words[:60] for i in (0, 2) for n in (0, 1, 2, 3, 4, 7)} | {"mixed case", "CASE", "zzz", "aaaa", "x" * 2999})
    n = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(-1, None)], "node_id int, name string")
    asks = spark.createDataFrame([(t, t) for t in terms] + [(None, None)], "query_id string, anchor string")
    want = sorted((t, i) for t in terms for i, w in enumerate(words) if t.lower() in w.lower())
    assert sorted((r.query_id, r.node_id) for r in names.containing(asks, n).collect()) == want
    index = names.NameIndex(n)
    assert sorted((r.query_id, r.node_id) for r in names.containing(asks, n, index=index).collect()) == want
    assert names.containing(asks.limit(0), n, index=index).count() == 0


def test_long_terms_take_no_nested_loop(spark, words, capsys):
    n = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "node_id int, name string")
    index = names.NameIndex(n)
    asks = spark.createDataFrame([("mixed case",)], "term string")
    got = index.holding(asks)
    got.explain()
    plan = capsys.readouterr().out
    # one, for terms without a trigram, over the written names
    assert plan.count("NestedLoop") + plan.count("CartesianProduct") == 1 and "SortMergeJoin" in plan and got.count() == 1


def test_names_without_a_chosen_trigram_are_left_out_where_they_are_read(spark, monkeypatch):
    sizes = {}
    monkeypatch.setattr(names, "write_table", lambda df, name: sizes.setdefault(name, []).append(df.count()) or df)
    n = spark.createDataFrame([(f"Item#{i:05d}",) for i in range(40)] + [(f"m.{i:05d}_{i:05d}",) for i in range(400)], "name string")
    terms = spark.createDataFrame([(f"em#{i:05d}",) for i in range(40)], "term string")
    got = names.NameIndex(n).holding(terms)
    # digits are in all names: just the 40 that hold what all terms share go on, and each term meets one
    assert got.count() == 40 and sizes["names"] == [40] and "postings" not in sizes


def test_resolution_with_a_given_index(spark):
    n = spark.createDataFrame([("1", "Alpha Beta", None, ["T"]), ("2", "alpha beta gamma", "x", ["_Entity", "U"])], "node_id string, name string, name_en string, labels array<string>")
    a = spark.createDataFrame([("q1", "ALPHA beta"), ("q2", "beta gam"), ("q3", "et"), ("q4", "none")], "query_id string, anchor string")
    index = names.NameIndex(n)
    assert sorted((r.query_id, r.node_id, r.tier) for r in lookup.resolve_fuzzy(a, n, index).collect()) == [("q1", "1", 1), ("q2", "2", 2), ("q3", "1", 2)]
    assert sorted((r.query_id, r.type, r.tier) for r in lookup.resolve_three_tier(a, n, index).collect()) == [("q1", "T", 2), ("q2", "U", 3), ("q3", "T", 3)]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("CD4+ T cell", "CD4+ T cell"),
        ("[IL-2 [human] x]", "IL-2 [human] x"),
        ("50%20off", "50%20off"),
        ("<https://x.org/vocab/a%20b%2Bc+d>", "a b+c+d"),
        ("[<https://x.org/y/%zz%C3%A9%>]", "%zzé%"),
        ("<plain>", "plain"),
        ("https://x.org", "https://x.org"),
        ("", ""),
    ],
)
def test_clean_names(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "n string").select(clean_name(F.col("n"))).first()[0] == want


def test_percent_decoding_of_odd_text(spark):
    got = spark.createDataFrame([("a+b%2B%",), (None,), ("%E7%99%8C",)], "n string").select(percent_decoded(F.col("n"))).collect()
    assert [r[0] for r in got] == ["a+b+%", None, "癌"]
