"""Hand-made files and small graphs for readers, candidates, exploration and matching."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import algebra, explore, store, vectors
from quarry.plans import candidates, schema_paths
from quarry.sources import graph, qa
from tests.test_graph import EDGE, NODE


def test_kb_json_document(spark, tmp_path):
    kb = {
        "concepts": {"c1": {"name": "big   city", "instanceOf": ["c2"]}, "c2": {"name": "place", "instanceOf": ["c1"]}},
        "entities": {
            "e1": {
                "name": " Paris  town ",
                "instanceOf": ["c1"],
                "attributes": [{"key": "pop", "value": {"type": "quantity", "value": 2.5, "unit": "1"}, "qualifiers": {"at": [{"type": "year", "value": 1999}, {"type": "date", "value": "2001/2/3"}]}}, {"key": "code", "value": {"type": "string", "value": "75"}}],
                "relations": [{"predicate": "in", "object": "e2", "direction": "forward", "qualifiers": {}}],
            },
            "e2": {"name": "France", "instanceOf": [], "attributes": [], "relations": []},
        },
    }
    (tmp_path / "kb.json").write_text(json.dumps(kb))
    got = graph.read_kb_json(spark, str(tmp_path / "kb.json"))
    assert {r.entity_id: r.name for r in got.entities.collect()} == {"e1": "Paris town", "e2": "France"}
    assert {r.name for r in got.concepts.collect()} == {"big city", "place"}
    assert sorted((r.key, r.v.num, r.v.s) for r in got.attrs.collect()) == [("code", None, "75"), ("pop", 2.5, None)]
    assert sorted((r.q_no, r.v.y, str(r.v.d)) for r in got.attr_quals.collect()) == [(0, 1999, "None"), (1, None, "2001-02-03")]
    assert [(r.predicate, r.object) for r in got.rels.collect()] == [("in", "e2")]
    # a cycle of concepts ends
    assert {(r.child, r.parent) for r in algebra.concept_closure(got).collect()} == {(a, b) for a in ("e1", "c1", "c2") for b in ("c1", "c2")}
    ask = spark.createDataFrame([(1, "paris TOWN", "P-O_P"), (2, "France", "pop"), (3, "nobody", "pop")], "query_id int, name string, key string")
    assert {r.query_id: r.answer for r in store.answer_attr(ask, got).collect()} == {1: "2.5", 2: "", 3: ""}


def test_long_concept_chains(spark):
    from quarry.kb import KB

    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(120)], "child string, parent string")
    assert algebra.concept_closure(KB(None, None, links, None, None, None, None)).count() == 120 * 121 // 2
    chain = spark.createDataFrame([(f"t{i:03}", "r", f"t{i + 1:03}", 1) for i in range(12)], "src_type string, rel string, tgt_type string, freq long")
    assert schema_paths.type_distances(chain).agg(F.max("dist"), F.max(F.when(F.col("a") == F.col("b"), F.col("dist")))).first()[:] == (12, 0)


def test_entity_csv_default_labels(spark, tmp_path):
    (tmp_path / "e.csv").write_text("1,Drug,name,aspirin,name_en,Aspirin,description,old,class_type,x,nmpa_approved,YES,fda_approved,NO\n2,Genesymbol,name,TP53,oncogene,no\n3,Unknown,name,z\n")
    got = {r.node_id: r for r in graph.read_entity_csv(spark, str(tmp_path / "e.csv")).collect()}
    assert set(got) == {"1", "2"} and got["1"].props["nmpa_approved"] == "YES" and got["1"].name_en == "Aspirin" and got["2"].props == {"oncogene": "no"}


def test_examples_list_and_object(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question": "q1", "operations": []}]))
    (tmp_path / "b.json").write_text(json.dumps({"examples": [{"question": "q2", "operations": [], "hop_count": 2}]}, indent=1))
    assert sorted((r.question, r.hop_count, r.final_operation) for r in qa.read_examples(spark, str(tmp_path)).collect()) == [("q1", 1, "relate"), ("q2", 2, "relate")]


@pytest.mark.parametrize("hops, labels, want, swaps", [([("B", "A"), ("C", "B")], ["A"], ["A>B", "B>C"], 2), ([("X", "Y"), ("B", "A")], ["A"], ["X>Y", "B>A"], 0), ([("A", "B"), ("C", "D"), ("B", "A")], ["A"], ["A>B", "C>D", "B>A"], 0)])
def test_reorient(spark, hops, labels, want, swaps):
    d = spark.createDataFrame([(1, hops, labels)], "query_id int, hops array<struct<src:string,tgt:string>>, labels array<string>")
    r = candidates.reorient_plan(d).first()
    assert [f"{h.src}>{h.tgt}" for h in r.hops] == want and r.swaps == swaps


def test_plan_score_counts_only_schema_types(spark):
    s = spark.createDataFrame([("A", "r", "B", 1)], "src_type string, rel string, tgt_type string, freq long")
    d = spark.createDataFrame([(1, [("A", "B")], "entity"), (2, [("A", "B")], "A"), (3, [("A", "B"), ("", "B")], "Moon"), (4, [("", "")], "A")], "plan_id int, hops array<struct<src:string,tgt:string>>, answer_type string")
    got = {r.plan_id: round(r.score, 6) for r in schema_paths.plan_score(d, s).collect()}
    assert got == {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.0}


@pytest.fixture(scope="module")
def small(spark):
    n = [("a", "Ann", None, ["P"], None), ("b", "Bob", None, ["P"], None), ("c", "Cid", None, ["Q"], None), ("d", "Dan", None, ["Q"], None), ("e", "Eve", None, None, None)]
    e = [("1", "a", "r", "b"), ("2", "b", "r", "c"), ("3", "b", "s", "d"), ("4", "a", "s", "e"), ("5", "e", "r", "d")]
    return spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE)


def test_subgraph_match_is_exact_and_beam_prunes(spark, small):
    rows = lambda x, kind: spark.createDataFrame(x, kind)
    starts = rows([(1, "a", "Ann", 0.0)], "query_id int, var string, name string, dist double")
    q = rows([(1, 0, "a", "b"), (1, 1, "b", "c")], "query_id int, edge_no int, src_var string, tgt_var string")
    r = rows([(1, 0, "r", 0.1), (1, 0, "s", 0.5), (1, 1, "r", 0.9), (1, 1, "s", 0.2)], "query_id int, edge_no int, rel string, dist double")
    t = rows([(1, 0, "P", 0.0, True), (1, 0, "Q", 0.3, False), (1, 1, "Q", 0.1, True)], "query_id int, edge_no int, label string, dist double, similar boolean")
    got = [("|".join(e.dst for e in x.edges), round(x.distance, 6)) for x in vectors.ranked_subgraph_match(starts, q, r, t, *small).orderBy("rank").collect()]
    assert got == [("Bob|Dan", 0.4), ("Bob|Cid", 1.1)]
    assert vectors.ranked_subgraph_match(starts, q, r, t, *small, beam=1).count() == 1


def test_beam_stops_when_it_is_enough(spark, small):
    a = spark.createDataFrame([("q", "Ann")], "query_id string, anchor string")
    steps = explore.beam_explore(a, *small, enough=a.select("query_id", F.lit(1).alias("depth"))).collect()
    assert {s.depth for s in steps} == {1} and {s.dst for s in steps} == {"Bob", "Eve"}
