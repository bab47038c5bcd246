"""Typed values, comparison rules and the algebra on a hand-made knowledge base."""

import pytest
from pyspark.sql import functions as F

from quarry.kb import KB, load
from quarry.model import VALUE, compare, parse_value, text_of
from quarry.operators import algebra as A


@pytest.mark.parametrize(
    ("v", "vt", "t", "tt", "op", "want"),
    [
        ("2001-01-02", "date", "2001", "year", "=", True),
        ("2001", "year", "2001-01-02", "date", "=", False),
        ("2001", "year", "2001-01-02", "date", "!=", True),
        ("2000", "year", "2001-01-02", "date", "<", True),
        ("2001/05/02", "date", "2001/05/01", "date", ">", True),
        ("5 cm", "quantity", "5 m", "quantity", "=", False),
        ("5 cm", "quantity", "5 m", "quantity", "!=", False),
        ("5 cm", "quantity", "6 cm", "quantity", "<", True),
        ("a", "string", "b", "string", "!=", True),
        ("a", "string", "b", "string", "<", False),
        ("a", "string", "5", "quantity", "=", False),
        ("-44", "year", "-44", "year", "=", True),
    ],
)
def test_compare(spark, v, vt, t, tt, op, want):
    d = spark.range(1).select(compare(parse_value(F.lit(v), vt), parse_value(F.lit(t), tt), op).alias("x"))
    assert d.first().x is want


def test_text(spark):
    d = spark.range(1).select(*[text_of(parse_value(F.lit(t), k)).alias(c) for c, t, k in (("a", "5", "quantity"), ("b", "5.5 cm", "quantity"), ("c", "1999", "year"), ("d", "1999-1-2", "date"))])
    assert tuple(d.first()) == ("5", "5.5 cm", "1999", "1999-01-02")


@pytest.fixture(scope="module")
def kb(spark):
    v = lambda t, k: (k, t if k == "string" else None, float(t.split()[0]) if k == "quantity" else None, (t.split() + ["1"])[1] if k == "quantity" else None, None, None)
    make = spark.createDataFrame
    return KB(
        make([("e1", "Ann"), ("e2", "Bob"), ("e3", "Ann")], "entity_id string, name string"),
        make([("c1", "person"), ("c2", "being"), ("c3", "loop")], "concept_id string, name string"),
        make([("e1", "c1"), ("e2", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c2")], "child string, parent string"),
        make([("e1", "1", "height", v("5 m", "quantity")), ("e1", "2", "height", v("7 m", "quantity")), ("e2", "1", "height", v("7 m", "quantity")), ("e2", "2", "city", v("Rome", "string"))], f"entity_id string, fact_no string, key string, v {VALUE}"),
        make([("e1", "2", "source", 1, v("X", "string"))], f"entity_id string, fact_no string, qkey string, q_no int, v {VALUE}"),
        make([("e1", "1", "knows", "forward", "e2"), ("e2", "1", "knows", "backward", "e1")], "entity_id string, fact_no string, predicate string, direction string, object string"),
        make([], f"entity_id string, fact_no string, qkey string, q_no int, v {VALUE}"),
    )


def run(spark, kb, *steps):
    rows = [("p", i, fn, list(x)) for i, (fn, *x) in enumerate(steps)]
    r = A.run_programs(A.infer_deps(spark.createDataFrame(rows, "program_id string, step_no int, fn string, inputs array<string>")), kb).first()
    return r.status, r.answer


def test_programs(spark, kb):
    assert run(spark, kb, ("FindAll",), ("FilterNum", "height", "0 m", ">"), ("Count",)) == ("ok", "3")
    assert run(spark, kb, ("FindAll",), ("FilterConcept", "loop"), ("Count",)) == ("ok", "2")
    assert run(spark, kb, ("Find", "Ann"), ("Relate", "knows", "forward"), ("What",)) == ("ok", "Bob")
    assert run(spark, kb, ("Find", "Ann"), ("QueryAttr", "height")) == ("ok", "7 m")
    assert run(spark, kb, ("Find", "Ann"), ("QueryAttrUnderCondition", "height", "source", "X"), ("VerifyNum", "7 m", "=")) == ("ok", "yes")
    assert run(spark, kb, ("Find", "Ann"), ("Find", "Bob"), ("SelectBetween", "height", "greater")) == ("ok", "Bob")
    assert run(spark, kb, ("Find", "Ann"), ("Find", "Bob"), ("Or",), ("SelectAmong", "height", "smallest")) == ("ok", "Ann")
    assert run(spark, kb, ("FindAll",), ("FilterNum", "height", "0 m", ">"), ("QFilterStr", "source", "X"), ("Count",)) == ("ok", "1")
    assert run(spark, kb, ("Find", "Ann"), ("Find", "Bob"), ("QueryRelation",)) == ("ok", "knows")
    assert run(spark, kb, ("Find", "Nobody"), ("What",)) == ("empty", None)


def test_sets_of_all_entities(spark, kb):
    assert run(spark, kb, ("FindAll",), ("Count",)) == ("ok", "3")
    assert run(spark, kb, ("FindAll",)) == ("ok", "Ann|Bob")
    assert run(spark, kb, ("FindAll",), ("What",)) == ("ok", "Ann")
    assert run(spark, kb, ("FindAll",), ("QueryAttr", "height")) == ("ok", "7 m")
    assert run(spark, kb, ("FindAll",), ("SelectAmong", "height", "largest")) == ("ok", "Bob")
    assert run(spark, kb, ("FindAll",), ("Relate", "knows", "forward"), ("What",)) == ("ok", "Bob")
    assert run(spark, kb, ("FindAll",), ("QFilterStr", "source", "X"), ("Count",)) == ("ok", "0")
    # a concept is no entity: Or keeps it beside all, And leaves it out
    assert run(spark, kb, ("FindAll",), ("Find", "person"), ("Or",), ("Count",)) == ("ok", "4")
    assert run(spark, kb, ("FindAll",), ("Find", "person"), ("And",), ("Count",)) == ("ok", "0")
    assert run(spark, kb, ("FindAll",), ("Find", "Ann"), ("Or",), ("Count",)) == ("ok", "3")
    assert run(spark, kb, ("FindAll",), ("FindAll",), ("And",), ("FilterConcept", "person"), ("Count",)) == ("ok", "2")
    every = A.find_all(spark.createDataFrame([("p",), ("q",)], "program_id string"))
    assert every.count() == 2 and A.expanded(every, kb).count() == 6


def test_equal_steps_run_once(spark, kb):
    """Three programs, of which two share all but the last step; a dependency on a later step is none."""
    steps = [("a", 0, "FindAll", [], []), ("a", 1, "FilterNum", ["height", "0 m", ">"], [0]), ("a", 2, "Count", [], [1]), ("b", 0, "Find", ["Ann"], []), ("b", 5, "FindAll", [], []), ("b", 6, "FilterNum", ["height", "0 m", ">"], [5]), ("b", 7, "What", [], [6]), ("c", 0, "Count", [], [3])]
    p = spark.createDataFrame(steps, "program_id string, step_no int, fn string, inputs array<string>, deps array<int>")
    shared = {(r.program_id, r.step_no): r.h for r in A.shared_steps(p).collect()}
    assert shared["a", 0] == shared["b", 5] and shared["a", 1] == shared["b", 6] and len(set(shared.values())) == 6
    assert {r.program_id: (r.status, r.answer) for r in A.run_programs(p, kb).collect()} == {"a": ("ok", "3"), "b": ("ok", "Ann"), "c": ("bad_dependency", None)}


def test_filters_make_no_product(spark, kb, capsys):
    every = A.find_all(spark.createDataFrame([("p",)], "program_id string"))
    args = spark.createDataFrame([("p", "height", "0 m", ">")], "program_id string, a1 string, a2 string, a3 string")
    A.filter_attr(every, args, kb, "quantity").explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_infer_deps(spark):
    """The branch rule by hand: two branches, joined, filtered, joined with a third."""
    fns = ["Find", "Relate", "Find", "FilterConcept", "And", "FindAll", "Or", "Count"]
    p = spark.createDataFrame([("p", i, f, []) for i, f in enumerate(fns)] + [("q", 0, "FindAll", []), ("q", 1, "What", [])], "program_id string, step_no int, fn string, inputs array<string>")
    got = {(r.program_id, r.step_no): list(r.deps) for r in A.infer_deps(p).collect()}
    assert got == {("p", 0): [], ("p", 1): [0], ("p", 2): [], ("p", 3): [2], ("p", 4): [1, 3], ("p", 5): [], ("p", 6): [4, 5], ("p", 7): [6], ("q", 0): [], ("q", 1): [0]}


def test_key_type_is_that_of_the_last_fact(spark):
    v = lambda k: (k, "x", None, None, None, None)
    make = spark.createDataFrame
    attrs = make([("e1", "1", "k", v("string")), ("e2", "1", "k", v("year")), ("e2", "2", "m", v("date")), ("e3", "1", "m", v("quantity"))], f"entity_id string, fact_no string, key string, v {VALUE}")
    quals = make([("e1", "1", "k", 1, v("quantity")), ("e3", "1", "m", 1, v("string"))], f"entity_id string, fact_no string, qkey string, q_no int, v {VALUE}")
    kb = KB(None, None, None, attrs, quals, None, quals.limit(0))
    assert {r.key: r.vtype for r in A.key_types(kb).collect()} == {"k": "date", "m": "string"}


def test_closure_ends_on_cycles(kb):
    got = {(r.child, r.parent) for r in A.concept_closure(kb).collect()}
    assert ("e1", "c3") in got and ("c2", "c2") in got and len(got) == 12


def test_find_first_reads_one_entity_of_each_name(spark):
    """A name of many entities gives one row where only the first is read, and the same first entity."""
    kb = load(spark, "/root/testdata/sf0.001")
    a = kb.entities.filter("entity_id like 'P%'").select(F.col("name").alias("program_id"), F.col("name").alias("a1")).distinct()
    one, every = A.find(a, kb, first=True), A.find(a, kb)
    assert one.count() == a.count() < every.count()
    assert sorted(map(tuple, A.first_of(one, kb).collect())) == sorted(map(tuple, A.first_of(every, kb).collect()))
