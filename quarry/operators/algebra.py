"""The query algebra over a knowledge base, a batch of programs at a time.

A set is a frame (program_id, entity_id, fact_kind, fact_no): the fact, if any, is the
one that brought the entity in, so sets are bags. A row of kind `all` without an entity
stands for all entities, each once; functions answer it from the facts themselves, so the
product of programs and entities is never made. args is a frame (program_id, a1, a2,
a3) with each program's inputs. Where the reference takes the first of a list, ours
takes the first by entity_id and fact_no. Values are frames (program_id, v).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kb import KB
from ..model import VALUE, compare, comparable, order_of, parse_value, text_of
from ..session import write_table

SET = ["program_id", "entity_id", "fact_kind", "fact_no"]
ALL = "all"


def _plain(df: DataFrame) -> DataFrame:
    return df.select("program_id", "entity_id", F.lit(None).cast("string").alias("fact_kind"), F.lit(None).cast("string").alias("fact_no"))


def of_all(sets: DataFrame) -> DataFrame:
    """program_id of the sets that hold all entities."""
    return sets.filter(F.col("fact_kind") == ALL).select("program_id").distinct()


def explicit(sets: DataFrame) -> DataFrame:
    return sets.filter("entity_id is not null")


def expanded(sets: DataFrame, kb: KB) -> DataFrame:
    """Sets with all entities written out: a row for each program and entity."""
    return explicit(sets).select(*SET).unionByName(_plain(kb.entities.select("entity_id").crossJoin(of_all(sets))))


def first_entity(kb: KB) -> DataFrame:
    """least: the first of all entities, one row."""
    return kb.first_entity if kb.first_entity is not None else kb.entities.agg(F.min("entity_id").alias("least"))


def first_of(sets: DataFrame, kb: KB) -> DataFrame:
    """program_id, entity_id: the first entity of each set."""
    g = sets.groupBy("program_id").agg(F.min("entity_id").alias("entity_id"), F.max(F.col("fact_kind") == ALL).alias("all"))
    d = g.join(F.broadcast(first_entity(kb)), F.col("all"), "left")
    return d.select("program_id", F.least("entity_id", "least").alias("entity_id")).filter("entity_id is not null")


def find_all(args: DataFrame) -> DataFrame:
    """All entities, as one row for each program."""
    return args.select("program_id", F.lit(None).cast("string").alias("entity_id"), F.lit(ALL).alias("fact_kind"), F.lit(None).cast("string").alias("fact_no"))


def find(args: DataFrame, kb: KB, first: bool = False) -> DataFrame:
    """first: only the first entity of each name, for functions that read no other; a name may have as many as the graph."""
    named = kb.entities.unionByName(kb.concepts.select(F.col("concept_id").alias("entity_id"), "name"))
    if first:
        named = named.groupBy("name").agg(F.min("entity_id").alias("entity_id"))
    return _plain(args.join(named.hint("merge"), F.col("a1") == F.col("name")))


def concept_closure(kb: KB) -> DataFrame:
    """child, parent: every ancestor of everything; ends on cycles, as only new pairs go on.

    Concepts are few next to what is an instance of them: their closure is made first, by
    joining paths with paths (each round doubles their length), and met once by the rest.
    """
    links = kb.instance_of.select("child", "parent").distinct()
    inner = links.join(links.select(F.col("parent").alias("child")).distinct().hint("merge"), "child", "left_semi")
    known = write_table(inner, "ancestors")
    n = known.count()
    while True:
        longer = known.join(known.select(F.col("child").alias("parent"), F.col("parent").alias("up")).hint("merge"), "parent").select("child", F.col("up").alias("parent"))
        known = write_table(known.unionByName(longer).distinct(), "ancestors")
        was, n = n, known.count()
        if n == was:
            break
    above = links.join(known.select(F.col("child").alias("parent"), F.col("parent").alias("up")).hint("merge"), "parent").select("child", F.col("up").alias("parent"))
    return links.unionByName(above).distinct()


def filter_concept(sets: DataFrame, args: DataFrame, kb: KB, closure: DataFrame | None = None) -> DataFrame:
    """Distinct entities under the concept of the name or one below it."""
    up = closure if closure is not None else concept_closure(kb)
    under = args.join(kb.concepts, F.col("a1") == F.col("name")).join(up, F.col("concept_id") == F.col("parent")).select("program_id", F.col("child").alias("entity_id"))
    under = under.distinct()
    got = explicit(sets).select("program_id", "entity_id").distinct().join(under.hint("merge"), ["program_id", "entity_id"], "left_semi")
    rest = under.join(of_all(sets).hint("merge"), "program_id", "left_semi").join(kb.entities.select("entity_id").hint("merge"), "entity_id", "left_semi")
    return _plain(got.unionByName(rest.select("program_id", "entity_id")).distinct())


def filter_attr(sets: DataFrame, args: DataFrame, kb: KB, vtype: str) -> DataFrame:
    """a1 key, a2 value, a3 op (= if null): one row per fact that matches."""
    t = args.select("program_id", F.col("a1").alias("key"), parse_value(F.col("a2"), vtype).alias("t"), F.coalesce("a3", F.lit("=")).alias("op"))
    met = explicit(sets).select("program_id", "entity_id").join(t, "program_id").join(kb.attrs, ["entity_id", "key"]).select("program_id", "entity_id", "fact_no", "v", "t", "op")
    rest = t.join(of_all(sets).hint("merge"), "program_id", "left_semi").join(kb.attrs, "key").select("program_id", "entity_id", "fact_no", "v", "t", "op")
    met = met.unionByName(rest).filter(compare(F.col("v"), F.col("t"), F.col("op")))
    return met.select("program_id", "entity_id", F.lit("attr").alias("fact_kind"), "fact_no")


def quals(kb: KB) -> DataFrame:
    """Qualifiers of attribute and relation facts together."""
    return kb.attr_quals.withColumn("fact_kind", F.lit("attr")).unionByName(kb.rel_quals.withColumn("fact_kind", F.lit("rel")))


def filter_qualifier(sets: DataFrame, args: DataFrame, kb: KB, vtype: str) -> DataFrame:
    """a1 key, a2 value, a3 op: facts with such a qualifier, one row per value. Relation facts belong to the source, whose id qualifies them; both ends carry them."""
    t = args.select("program_id", F.col("a1").alias("qkey"), parse_value(F.col("a2"), vtype).alias("t"), F.coalesce("a3", F.lit("=")).alias("op"))
    met = sets.join(t, "program_id").join(quals(kb).hint("merge"), ["entity_id", "fact_kind", "fact_no", "qkey"])
    return met.filter(compare(F.col("v"), F.col("t"), F.col("op"))).select(*SET)


def relate(sets: DataFrame, args: DataFrame, kb: KB, all_sources: bool = False) -> DataFrame:
    """a1 predicate, a2 direction: objects of the first entity (or of all), with the fact."""
    src = explicit(sets).select("program_id", "entity_id").distinct() if all_sources else first_of(sets, kb)
    a = args.select("program_id", F.col("a1").alias("predicate"), F.col("a2").alias("direction"))
    met = src.join(a, "program_id").join(kb.rels, ["entity_id", "predicate", "direction"]).select("program_id", "object", "fact_no")
    if all_sources:
        met = met.unionByName(a.join(of_all(sets).hint("merge"), "program_id", "left_semi").join(kb.rels, ["predicate", "direction"]).select("program_id", "object", "fact_no"))
    return met.select("program_id", F.col("object").alias("entity_id"), F.lit("rel").alias("fact_kind"), "fact_no")


def both(left: DataFrame, right: DataFrame, kb: KB | None = None) -> DataFrame:
    """Distinct entities of both. kb: needed where a set may hold all entities."""
    rows = lambda s: explicit(s).select("program_id", "entity_id")
    met = rows(left).intersect(rows(right))
    if kb is None:
        return _plain(met)
    every = of_all(left).intersect(of_all(right))
    known = kb.entities.select("entity_id").distinct()
    for x, y in ((left, right), (right, left)):
        one = rows(x).join(of_all(y).hint("merge"), "program_id", "left_semi").join(known.hint("merge"), "entity_id", "left_semi")
        met = met.unionByName(one.select("program_id", "entity_id"))
    return _beside_all(met, every, known)


def either(left: DataFrame, right: DataFrame, kb: KB | None = None) -> DataFrame:
    """Distinct entities of either. kb: needed where a set may hold all entities."""
    rows = lambda s: explicit(s).select("program_id", "entity_id")
    met = rows(left).unionByName(rows(right))
    if kb is None:
        return _plain(met.distinct())
    return _beside_all(met, of_all(left).union(of_all(right)).distinct(), kb.entities.select("entity_id").distinct())


def _beside_all(met: DataFrame, every: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct rows of met, and the programs of every that hold all entities; what these hold already is left out."""
    in_all = met.join(every.hint("merge"), "program_id", "left_semi").join(known.hint("merge"), "entity_id", "left_anti")
    rest = met.join(every.hint("merge"), "program_id", "left_anti")
    return _plain(in_all.select("program_id", "entity_id").unionByName(rest.select("program_id", "entity_id")).distinct()).unionByName(find_all(every))


def what(sets: DataFrame, kb: KB) -> DataFrame:
    """program_id, answer: name of the first entity."""
    return first_of(sets, kb).join(kb.entities, "entity_id").select("program_id", F.col("name").alias("answer"))


def count(sets: DataFrame, args: DataFrame, kb: KB | None = None) -> DataFrame:
    """program_id, n: size of the bag; 0 for programs without rows. kb: needed where a set may hold all entities."""
    n = sets.groupBy("program_id").agg(F.count("entity_id").alias("n"), F.max(F.col("fact_kind") == ALL).alias("all"))
    if kb is not None:
        n = n.crossJoin(F.broadcast(kb.entities.agg(F.count("*").alias("entities")))).withColumn("n", F.col("n") + F.when(F.col("all"), F.col("entities")).otherwise(0))
    return args.select("program_id").distinct().join(n, "program_id", "left").select("program_id", F.coalesce("n", F.lit(0)).alias("n"))


def last_value(keyed: DataFrame, kb: KB) -> DataFrame:
    """keyed: program_id, entity_id, key. Adds v, the last value of the key; entities without it go."""
    met = keyed.join(kb.attrs, ["entity_id", "key"])
    return met.groupBy(*keyed.columns).agg(F.max_by("v", "fact_no").alias("v"))


def _keyed(sets: DataFrame, args: DataFrame) -> DataFrame:
    return sets.join(args.select("program_id", F.col("a1").alias("key")), "program_id").select("program_id", "entity_id", "key")


def _with_key(sets: DataFrame, args: DataFrame, kb: KB) -> DataFrame:
    """program_id, entity_id, key of entities that may have the key: of all entities, those with a fact of it."""
    keys = args.select("program_id", F.col("a1").alias("key"))
    rest = keys.join(of_all(sets).hint("merge"), "program_id", "left_semi").join(kb.attrs.select("key", "entity_id").distinct().hint("merge"), "key")
    return _keyed(explicit(sets), args).unionByName(rest.select("program_id", "entity_id", "key")).distinct()


def select_between(left: DataFrame, right: DataFrame, args: DataFrame, kb: KB) -> DataFrame:
    """a1 key, a2 greater or less: name of the one of two; on a tie the second."""
    x = last_value(_keyed(first_of(left, kb), args), kb).select("program_id", F.col("entity_id").alias("e1"), order_of(F.col("v")).alias("v1"))
    y = last_value(_keyed(first_of(right, kb), args), kb).select("program_id", F.col("entity_id").alias("e2"), order_of(F.col("v")).alias("v2"))
    d = x.join(y, "program_id").join(args.select("program_id", "a2"), "program_id")
    first = F.when(F.col("a2").isin("greater", "largest"), F.col("v1") > F.col("v2")).otherwise(F.col("v1") < F.col("v2"))
    return d.select("program_id", F.when(first, F.col("e1")).otherwise(F.col("e2")).alias("entity_id")).join(kb.entities, "entity_id").select("program_id", F.col("name").alias("answer"))


def select_among(sets: DataFrame, args: DataFrame, kb: KB) -> DataFrame:
    """a1 key, a2 largest or smallest: name of the extreme entity; among equals smallest takes the first, largest the last. Entities without the key are skipped."""
    d = last_value(_with_key(sets, args, kb), kb).join(args.select("program_id", "a2"), "program_id")
    key = F.struct(order_of(F.col("v")).alias("o"), "entity_id")
    g = d.groupBy("program_id").agg(F.first("a2").alias("a2"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    return g.select("program_id", F.when(F.col("a2") == "smallest", F.col("lo.entity_id")).otherwise(F.col("hi.entity_id")).alias("entity_id")).join(kb.entities, "entity_id").select("program_id", F.col("name").alias("answer"))


def query_attr(sets: DataFrame, args: DataFrame, kb: KB) -> DataFrame:
    """a1 key: last value of the first entity."""
    return last_value(_keyed(first_of(sets, kb), args), kb).select("program_id", "v")


def key_types(kb: KB) -> DataFrame:
    """key, vtype: value type of each attribute and qualifier key, of the one seen last; years count as dates.

    Facts are seen by entity, attributes before relations, then by number, each before its qualifiers.
    """
    seen = lambda d, key, kind, after: d.select(F.col(key).alias("key"), "v.vtype", F.struct("entity_id", kind.alias("kind"), "fact_no", after.alias("q_no")).alias("at"))
    keys = seen(kb.attrs, "key", F.lit("attr"), F.lit(0)).unionByName(seen(quals(kb), "qkey", F.col("fact_kind"), F.col("q_no") + 1))
    return keys.groupBy("key").agg(F.max_by(F.when(F.col("vtype") == "year", "date").otherwise(F.col("vtype")), F.struct("at", "vtype")).alias("vtype"))


def query_attr_under(sets: DataFrame, args: DataFrame, kb: KB) -> DataFrame:
    """a1 key, a2 qualifier key, a3 qualifier value: first value of the first entity under that condition."""
    a = args.join(key_types(kb).withColumnRenamed("key", "a2"), "a2").select("program_id", F.col("a1").alias("key"), F.col("a2").alias("qkey"), parse_value(F.col("a3"), F.col("vtype")).alias("t"))
    q = kb.attr_quals.select("entity_id", "fact_no", "qkey", F.col("v").alias("qv"))
    met = first_of(sets, kb).join(a, "program_id").join(kb.attrs, ["entity_id", "key"]).join(q, ["entity_id", "fact_no", "qkey"]).filter(compare(F.col("qv"), F.col("t"), "="))
    return met.groupBy("program_id").agg(F.min_by("v", "fact_no").alias("v"))


def verify(values: DataFrame, args: DataFrame, vtype: str) -> DataFrame:
    """a1 value, a2 op: yes or no."""
    a = args.select("program_id", parse_value(F.col("a1"), vtype).alias("t"), F.coalesce("a2", F.lit("=")).alias("op"))
    ok = comparable(F.col("v"), F.col("t")) & compare(F.col("v"), F.col("t"), F.col("op"))
    return values.join(a, "program_id").select("program_id", F.when(ok, "yes").otherwise("no").alias("answer"))


def _pairs(left: DataFrame, right: DataFrame, kb: KB) -> DataFrame:
    return first_of(left, kb).join(first_of(right, kb).withColumnRenamed("entity_id", "object"), "program_id")


def query_relation(left: DataFrame, right: DataFrame, kb: KB) -> DataFrame:
    """Last forward predicate between the first entities."""
    met = _pairs(left, right, kb).join(kb.rels.filter("direction = 'forward'"), ["entity_id", "object"])
    return met.groupBy("program_id").agg(F.max_by("predicate", "fact_no").alias("answer"))


def query_attr_qualifier(sets: DataFrame, args: DataFrame, kb: KB) -> DataFrame:
    """a1 key, a2 value, a3 qualifier key: first such qualifier of the first matching fact that has one."""
    a = args.join(key_types(kb).withColumnRenamed("key", "a1"), "a1").select("program_id", F.col("a1").alias("key"), parse_value(F.col("a2"), F.col("vtype")).alias("t"), F.col("a3").alias("qkey"))
    met = first_of(sets, kb).join(a, "program_id").join(kb.attrs, ["entity_id", "key"]).filter(compare(F.col("v"), F.col("t"), "=")).drop("v")
    met = met.join(kb.attr_quals, ["entity_id", "fact_no", "qkey"])
    return met.groupBy("program_id").agg(F.min_by("v", F.struct("fact_no", "q_no")).alias("v"))


def query_relation_qualifier(left: DataFrame, right: DataFrame, args: DataFrame, kb: KB) -> DataFrame:
    """a1 predicate, a2 qualifier key: first such qualifier of the first forward fact."""
    a = args.select("program_id", F.col("a1").alias("predicate"), F.col("a2").alias("qkey"))
    met = _pairs(left, right, kb).join(a, "program_id").join(kb.rels.filter("direction = 'forward'"), ["entity_id", "object", "predicate"]).join(kb.rel_quals.hint("merge"), ["entity_id", "fact_no", "qkey"])
    return met.groupBy("program_id").agg(F.min_by("v", F.struct("fact_no", "q_no")).alias("v"))


TYPE_OF = {"Str": "string", "Num": "quantity", "Year": "year", "Date": "date"}
#: fixed values: the functions of the algebra
FUNCTIONS = [
    "FindAll", "Find", "FilterConcept", "FilterStr", "FilterNum", "FilterYear", "FilterDate",
    "QFilterStr", "QFilterNum", "QFilterYear", "QFilterDate", "Relate", "And", "Or", "What", "Count",
    "SelectBetween", "SelectAmong", "QueryAttr", "QueryAttrUnderCondition", "VerifyStr", "VerifyNum",
    "VerifyYear", "VerifyDate", "QueryRelation", "QueryAttrQualifier", "QueryRelationQualifier",
]
#: fixed values: inputs of the functions that are keys of facts or qualifiers
KEYS_AT = {
    **{f"{f}{t}": ("a1",) for f in ("Filter", "QFilter") for t in TYPE_OF},
    **{f: ("a1",) for f in ("SelectBetween", "SelectAmong", "QueryAttr")},
    "QueryAttrUnderCondition": ("a1", "a2"),
    "QueryAttrQualifier": ("a1", "a3"),
    "QueryRelationQualifier": ("a2",),
}
#: fixed values: functions whose first input is a predicate
PREDICATED = ("Relate", "QueryRelationQualifier")
TWO_SETS = ("And", "Or", "SelectBetween", "QueryRelation", "QueryRelationQualifier")


def infer_deps(programs: DataFrame) -> DataFrame:
    """programs: program_id, step_no, fn, inputs. Adds deps by the branch rule: Find and FindAll open a branch, functions of two sets close one."""
    steps = programs.groupBy("program_id").agg(F.array_sort(F.collect_list(F.struct("step_no", "fn"))).alias("steps"))
    two = ", ".join(f"'{f}'" for f in TWO_SETS)
    folded = F.expr(
        f"""aggregate(steps, named_struct('stack', cast(array() as array<int>), 'deps', cast(array() as array<array<int>>)), (a, x) ->
          named_struct(
            'stack', case when x.fn in ('Find', 'FindAll') then array_append(a.stack, x.step_no)
                          when x.fn in ({two}) then array_append(slice(a.stack, 1, greatest(size(a.stack) - 2, 0)), x.step_no)
                          else array_append(slice(a.stack, 1, greatest(size(a.stack) - 1, 0)), x.step_no) end,
            'deps', array_append(a.deps, case when x.fn in ('Find', 'FindAll') then cast(array() as array<int>)
                          when x.fn in ({two}) then slice(a.stack, greatest(size(a.stack) - 1, 1), 2)
                          else slice(a.stack, greatest(size(a.stack), 1), 1) end)), a -> a.deps)"""
    )
    d = steps.select("program_id", F.explode(F.arrays_zip("steps", folded.alias("deps"))).alias("z")).select("program_id", F.col("z.steps.step_no").alias("step_no"), F.col("z.deps").alias("deps"))
    return programs.drop("deps").join(d.hint("merge"), ["program_id", "step_no"])


def shared_steps(programs: DataFrame) -> DataFrame:
    """programs: program_id, step_no, fn, inputs, deps. program_id, step_no, fn, a1, a2, a3, h, dep_h.

    h names what a step computes: its function, inputs and the names of its dependencies, in 16
    bytes. Equal steps of any programs have one name. A dependency on no earlier step has the name '?'.
    """
    rows = programs.groupBy("program_id").agg(F.array_sort(F.collect_list(F.struct("step_no", "fn", "inputs", "deps"))).alias("steps"))
    done = "array<struct<step_no:int,fn:string,inputs:array<string>,h:binary,dep_h:array<binary>>>"
    named = F.expr(
        f"""aggregate(steps, cast(array() as {done}), (acc, x) -> array_append(acc, transform(array(transform(coalesce(x.deps, array()), d -> coalesce(get(filter(acc, s -> s.step_no = d), 0).h, cast('?' as binary)))), dh ->
              named_struct('step_no', x.step_no, 'fn', x.fn, 'inputs', x.inputs, 'h', unhex(md5(to_json(named_struct('fn', x.fn, 'inputs', x.inputs, 'deps', dh)))), 'dep_h', dh))[0]))"""
    )
    d = rows.select("program_id", F.explode(named).alias("x"))
    at = lambda i: F.get(F.col("x.inputs"), F.lit(i)).alias(f"a{i + 1}")
    return d.select("program_id", "x.step_no", "x.fn", at(0), at(1), at(2), "x.h", "x.dep_h")


def words_of(steps: DataFrame, most: int = 10_000) -> dict[str, dict[str, list[str]]] | None:
    """steps: fn, a1, a2, a3. By function the keys (key), predicates (pred) and directions (way) that its steps name; None, if they are many."""
    at = lambda c, kind: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("word"))
    named = F.lit(None)
    for fn in sorted({*KEYS_AT, *PREDICATED}):
        named = F.when(F.col("fn") == fn, F.array(*[at(c, "key") for c in KEYS_AT.get(fn, ())], *([at("a1", "pred")] if fn in PREDICATED else []), *([at("a2", "way")] if fn == "Relate" else []))).otherwise(named)
    got = steps.select("fn", F.explode(named).alias("x")).select("fn", "x.*").filter("word is not null").distinct().limit(most + 1).collect()
    if len(got) > most:
        return None
    out: dict[str, dict[str, list[str]]] = {}
    for r in got:
        out.setdefault(r["fn"], {}).setdefault(r["kind"], []).append(r["word"])
    return out


def narrowed(kb: KB, fn: str, words: dict[str, dict[str, list[str]]] | None) -> KB:
    """The facts and qualifiers of the keys and predicates that a function's steps name; whole tables are left out by them."""
    if words is None:
        return kb
    got = words.get(fn, {})
    if fn in KEYS_AT:
        of = lambda d, key: d.filter(F.col(key).isin(got.get("key", [])))
        kb = replace(kb, attrs=of(kb.attrs, "key"), attr_quals=of(kb.attr_quals, "qkey"), rel_quals=of(kb.rel_quals, "qkey"))
    if fn in PREDICATED:
        rels = kb.rels.filter(F.col("predicate").isin(got.get("pred", [])))
        kb = replace(kb, rels=rels.filter(F.col("direction").isin(got.get("way", []))) if fn == "Relate" else rels)
    return kb


def run_programs(programs: DataFrame, kb: KB) -> DataFrame:
    """programs: program_id, step_no, fn, inputs, deps (deps point to earlier steps).

    Equal steps of the batch are run once (shared_steps), step number by step number, each
    function once per number; a step reads only the results of the numbers it depends on.
    Returns program_id, status, answer (text; a set's names joined by |). status is
    `unknown_function`, `bad_value` (a number or time that isn't one) or `bad_dependency` (on
    no earlier step) of the first step that can't be run, else `empty` where the last step
    gives nothing, else `ok`.
    """
    p = write_table(shared_steps(programs), "programs")
    u = write_table(p.groupBy("h").agg(F.min("step_no").alias("no"), *[F.first(c).alias(c) for c in ("fn", "a1", "a2", "a3", "dep_h")]).withColumnRenamed("h", "program_id"), "steps")
    plan = u.select("no", "fn").distinct().collect()  # at most steps x functions
    on = u.select("no", "fn", F.posexplode("dep_h").alias("i", "of")).join(u.select(F.col("program_id").alias("of"), F.col("no").alias("from")).hint("merge"), "of")
    reads: dict[tuple, set[int]] = {}
    for r in on.select("no", "fn", "i", "from").distinct().collect():  # at most functions x steps x steps
        reads.setdefault((r["no"], r["fn"], r["i"]), set()).add(r["from"])
    fns = {r["fn"] for r in plan}
    words = words_of(u)
    closure = write_table(concept_closure(kb), "closure") if "FilterConcept" in fns else None
    kb = replace(kb, first_entity=write_table(first_entity(kb), "first_entity"))
    # And and Or keep sets of all entities as such
    every = kb if "FindAll" in fns else None
    results: dict[str, dict[int, DataFrame]] = {"set": {}, "value": {}, "answer": {}}
    shapes = {"set": "program_id binary, entity_id string, fact_kind string, fact_no string", "value": f"program_id binary, v {VALUE}"}

    def dep(kind: str, no: int, fn: str, steps: DataFrame, i: int) -> DataFrame:
        want = steps.select(F.get("dep_h", F.lit(i)).alias("of"), F.col("program_id").alias("by"))
        frames = [results[kind][n] for n in sorted(reads.get((no, fn, i), ())) if n in results[kind]]
        if not frames:
            return kb.entities.sparkSession.createDataFrame([], shapes[kind])
        got = reduce(DataFrame.unionByName, frames)
        return got.join(want.hint("merge"), F.col("program_id") == F.col("of")).drop("program_id", "of").withColumnRenamed("by", "program_id")

    for no in sorted({r["no"] for r in plan}):
        new: dict[str, list[DataFrame]] = {"set": [], "value": [], "answer": []}
        for fn in sorted(r["fn"] for r in plan if r["no"] == no and r["fn"] in FUNCTIONS):
            a = u.filter((F.col("no") == no) & (F.col("fn") == fn))
            kind, out = _step(fn, a, narrowed(kb, fn, words), closure, every, lambda i, of="set", fn=fn, a=a, no=no: dep(of, no, fn, a, i))
            new[kind].append(out)
        for kind, frames in new.items():
            if frames:
                results[kind][no] = write_table(reduce(DataFrame.unionByName, frames), kind)
    last = p.groupBy("program_id").agg(F.max_by("h", "step_no").alias("h"))
    ends = last.select("h").distinct()
    named = kb.entities.unionByName(kb.concepts.select(F.col("concept_id").alias("entity_id"), "name"))
    parts = [f.select("program_id", "answer") for f in results["answer"].values()] + [f.select("program_id", text_of(F.col("v")).alias("answer")) for f in results["value"].values()]
    if results["set"]:
        of_last = reduce(DataFrame.unionByName, results["set"].values()).join(ends.withColumnRenamed("h", "program_id").hint("merge"), "program_id", "left_semi")
        listed = expanded(of_last, kb) if every is not None else of_last
        parts.append(listed.join(named, "entity_id").groupBy("program_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("answer")))
    out = last
    if parts:
        out = last.join(reduce(DataFrame.unionByName, parts).withColumnRenamed("program_id", "h").hint("merge"), "h", "left")
    else:
        out = out.withColumn("answer", F.lit(None).cast("string"))
    out = out.join(program_errors(p).hint("merge"), "program_id", "left")
    status = F.coalesce("error", F.when(F.col("answer").isNull(), "empty").otherwise("ok"))
    return out.select("program_id", status.alias("status"), F.when(F.col("error").isNull(), F.col("answer")).alias("answer"))


def _step(fn: str, a: DataFrame, kb: KB, closure: DataFrame | None, every: KB | None, of: Callable) -> tuple[str, DataFrame]:
    """Kind and frame of what a function gives; of(i) is its i-th set, of(i, "value") its i-th value."""
    kind = next((t for k, t in TYPE_OF.items() if fn.endswith(k)), None)
    if fn.startswith("Verify"):
        return "answer", verify(of(0, "value"), a, kind)
    if fn.startswith("QFilter"):
        return "set", filter_qualifier(of(0), a, kb, kind)
    if fn.startswith("Filter") and kind:
        return "set", filter_attr(of(0), a, kb, kind)
    sets = {
        "FindAll": lambda: find_all(a),
        "Find": lambda: find(a, kb),
        "FilterConcept": lambda: filter_concept(of(0), a, kb, closure),
        "Relate": lambda: relate(of(0), a, kb),
        "And": lambda: both(of(0), of(1), every),
        "Or": lambda: either(of(0), of(1), every),
    }
    values = {
        "QueryAttr": lambda: query_attr(of(0), a, kb),
        "QueryAttrUnderCondition": lambda: query_attr_under(of(0), a, kb),
        "QueryAttrQualifier": lambda: query_attr_qualifier(of(0), a, kb),
        "QueryRelationQualifier": lambda: query_relation_qualifier(of(0), of(1), a, kb),
    }
    answers = {
        "What": lambda: what(of(0), kb),
        "Count": lambda: count(of(0), a, every).select("program_id", F.col("n").cast("string").alias("answer")),
        "SelectBetween": lambda: select_between(of(0), of(1), a, kb),
        "SelectAmong": lambda: select_among(of(0), a, kb),
        "QueryRelation": lambda: query_relation(of(0), of(1), kb),
    }
    if fn in sets:
        return "set", sets[fn]().select(*SET)
    if fn in values:
        return "value", values[fn]().select("program_id", "v")
    return "answer", answers[fn]().select("program_id", "answer")


def program_errors(steps: DataFrame) -> DataFrame:
    """steps: program_id, step_no, fn, a1, a2, dep_h. program_id, error: of the first step that can't be run."""
    typed = F.col("fn").rlike("^(Filter|QFilter|Verify)(Num|Year|Date)$")
    text = F.when(F.col("fn").startswith("Verify"), F.col("a1")).otherwise(F.col("a2"))
    kind = F.when(F.col("fn").endswith("Num"), "quantity").when(F.col("fn").endswith("Year"), "year").otherwise("date")
    v = parse_value(text, kind)
    bad = typed & F.coalesce(v["num"], v["y"].cast("double"), F.year(v["d"]).cast("double")).isNull()
    e = F.when(~F.col("fn").isin(FUNCTIONS), "unknown_function").when(F.array_contains("dep_h", F.lit("?").cast("binary")), "bad_dependency").when(bad, "bad_value")
    return steps.withColumn("error", e).filter("error is not null").groupBy("program_id").agg(F.min_by("error", "step_no").alias("error"))
