"""Hand-made graphs: self-loops, parallel edges, shared and missing names; and a property test against enumeration."""

import itertools
import random

import pytest

from quarry.operators import evaluate, hops, lookup, setops, traverse

NODE = "node_id string, name string, name_en string, labels array<string>, props map<string,string>"
EDGE = "edge_id string, src_id string, rel string, dst_id string"
PATH = "plan string, path_id string, types array<string>, rels array<string>, dirs array<string>"
ANCHOR = "query_id string, anchor string, plan string"


@pytest.fixture(scope="module")
def graph(spark):
    n = [("a", "Ann", None, ["P"], None), ("b", "Bob", None, ["P"], None), ("b2", "Bob", None, ["P", "Q"], None), ("m", "m.1", None, ["CVT"], None), ("x", None, None, ["P"], None), ("e", "", None, ["P"], None), ("c", "City", "Ville", ["C"], {"size": "9"})]
    e = [("1", "a", "knows", "b"), ("2", "a", "knows", "b"), ("3", "a", "knows", "a"), ("4", "b", "lives", "c"), ("5", "a", "has", "m"), ("6", "m", "of", "c"), ("7", "a", "knows", "x"), ("8", "a", "knows", "e"), ("9", "b2", "lives", "c")]
    return spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE)


def paths(spark, *rows):
    return spark.createDataFrame([("all", *r) for r in rows], PATH)


def anchors(spark, *names):
    return spark.createDataFrame([(n, n, "all") for n in names], ANCHOR)


def test_self_loop_once_and_parallel_edges(graph):
    bi = hops.edges_bi(graph[1]).collect()
    assert sum(r.edge_id == "3" for r in bi) == 1 and len(bi) == 17


def test_names_that_are_missing_are_dropped(spark, graph):
    got = traverse.typed_paths(anchors(spark, "ANN"), paths(spark, ("k", ["P", "P"], ["knows"], ["out"])), *graph).collect()
    assert [(r.query_id, r.name) for r in got] == [("ANN", "Bob")]


def test_edge_uniqueness_allows_the_parallel_edge(spark, graph):
    p = paths(spark, ("kk", ["P", "P", "P"], ["knows", "knows"], ["out", "in"]))
    assert traverse.unchecked_paths(anchors(spark, "Ann"), p, *graph).filter("name = 'Ann'").count() == 1
    assert traverse.typed_paths(anchors(spark, "Ann"), p, *graph).count() == 0


def test_too_long_paths_and_unknown_anchors_give_nothing(spark, graph):
    p = paths(spark, ("long", ["P"] * 5, ["knows"] * 4, ["out"] * 4))
    assert traverse.typed_paths(anchors(spark, "Ann"), p, *graph).count() == 0
    assert traverse.typed_paths(anchors(spark, "Zed"), paths(spark, ("k", ["P", "P"], ["knows"], ["out"])), *graph).count() == 0


def test_via_hub(spark, graph):
    got = traverse.paths_via_hub(anchors(spark, "Ann"), paths(spark, ("h", ["P", "C"], ["has..of"], ["out"])), *graph).collect()
    assert [r.name for r in got] == ["City"]


def test_hub_answers_resolve(spark, graph):
    got = traverse.resolve_hubs(spark.createDataFrame([("q", "m.1")], "query_id string, name string"), *graph).collect()
    assert sorted(r.name for r in got) == ["Ann", "City"]


def test_resolution_tiers(spark, graph):
    got = {r.query_id: (r.node_id, r.tier) for r in lookup.resolve_three_tier(anchors(spark, "Bob", "bob", "cit", "none"), graph[0]).collect()}
    assert got == {"Bob": ("b", 1), "bob": ("b", 2), "cit": ("c", 3)}


def test_set_operations(spark):
    a = spark.createDataFrame([("q", 1, "p", "x"), ("q", 1, "p", "y"), ("q", 2, "p", "y"), ("r", 1, "p", "z")], "query_id string, anchor_no int, path_id string, name string")
    n = spark.createDataFrame([("q", 1), ("q", 2), ("r", 1), ("r", 2)], "query_id string, anchor_no int")
    rows = lambda d: sorted((r.query_id, r.name) for r in d.collect())
    assert rows(setops.combine_intersection(a, n)) == [("q", "y")]
    assert rows(setops.lenient_intersection(a)) == [("q", "y"), ("r", "z")]
    assert rows(setops.combine_exclude(a)) == [("q", "x"), ("r", "z")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_typed_paths_equal_enumeration(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{i}" for i in range(8)]
    label = {i: rnd.choice("AB") for i in ids}
    es = [(str(k), rnd.choice(ids), rnd.choice(["r", "s"]), rnd.choice(ids)) for k in range(20)]
    types, rels = [rnd.choice("AB") for _ in range(4)], [rnd.choice("rs") for _ in range(3)]
    both = [(e, s, r, d) for e, s, r, d in es] + [(e, d, r, s) for e, s, r, d in es if s != d]
    want = set()
    for walk in itertools.product(both, repeat=3):
        at = [walk[0][1], *[w[3] for w in walk]]
        if all(walk[i][3] == walk[i + 1][1] for i in range(2)) and [w[2] for w in walk] == rels and [label[x] for x in at] == types and len({w[0] for w in walk}) == 3:
            if at[0] != at[1] and at[1] != at[2] and at[2] != at[3] and at[0] != at[3]:
                want.add((at[0], at[3]))
    nodes = spark.createDataFrame([(i, i, None, [label[i]], None) for i in ids], NODE)
    got = traverse.typed_paths(anchors(spark, *ids), paths(spark, ("p", types, rels, ["out"] * 3)), nodes, spark.createDataFrame(es, EDGE)).collect()
    assert {(r.query_id, r.name) for r in got} == want


def test_metrics_bounds(spark):
    kind = "gold_answers array<string>, predicted_entities array<string>, error string"
    d = spark.createDataFrame([(["a", "B"], ["A"], None), ([], ["A"], None), (["a"], [], None), (["a"], ["A", "a"], None), (["a"], ["a"], "boom")], kind)
    got = [(r.accuracy, r.recall, r.precision, round(r.f1, 3)) for r in evaluate.set_metrics(d).collect()]
    assert got == [(False, 0.5, 1.0, 0.667), (False, 0.0, 0.0, 0.0), (False, 0.0, 0.0, 0.0), (True, 1.0, 1.0, 1.0), (False, 0.0, 0.0, 0.0)]


def test_edge_ids_are_read_for_paths_that_repeat_a_relation_only(spark, graph, tmp_path):
    n, e = graph
    e.write.parquet(str(tmp_path / "edges"))
    e = spark.read.parquet(str(tmp_path / "edges"))
    a = anchors(spark, "Ann")
    one, two = paths(spark, ("p", ["P", "P", "C"], ["knows", "lives"], ["out", "out"])), paths(spark, ("p", ["P", "P", "P"], ["knows", "knows"], ["out", "out"]))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    got = traverse.typed_paths(a, one, n, e)
    assert "_e#" not in plan(got) and [r.name for r in got.collect()] == ["City"]
    # parallel edges lead there and back, though no edge twice; the ends must differ
    assert "_e#" in plan(traverse.typed_paths(a, two, n, e))
    assert traverse.follow(a, two, n, e, inequalities=None).filter("eids[0] = eids[1]").count() == 0


def test_few_anchors_of_a_local_schema_shuffle_no_edges(spark, graph, monkeypatch):
    n, e = graph
    plans, write = [], lookup.write_table
    monkeypatch.setattr(lookup, "write_table", lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or write(df, name))
    got = {(r.src, r.rel, r.tgt, r.is_1hop): r.freq for r in lookup.local_schema_edges(anchors(spark, "City"), n, e).collect()}
    assert got[("P", "lives", "C", True)] == 2 and got[("CVT", "of", "C", True)] == 1 and got[("P", "has", "CVT", False)] == 1
    assert "BroadcastHashJoin" in dict(plans)["first_hop"]
