"""Ranked matching, shortest ways, first ways and anchors of paths against full enumeration on random graphs."""

import json
import random

import pytest

from quarry.operators import explore, traverse, vectors
from quarry.plans import candidates, schema_paths


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(2)
    name = [f"N{i}" for i in range(12)]
    label = {n: rng.sample("PQR", rng.randint(1, 2)) for n in name}
    rows = [(f"e{i}", rng.choice(name), rng.choice("rst"), rng.choice(name)) for i in range(34)]
    n = spark.createDataFrame([(f"id{x}", x, None, label[x], {"a": x}) for x in name], "node_id string, name string, name_en string, labels array<string>, props map<string,string>")
    e = spark.createDataFrame([(i, f"id{s}", r, f"id{t}") for i, s, r, t in rows], "edge_id string, src_id string, rel string, dst_id string")
    return name, label, {(s, r, t) for _, s, r, t in rows} | {(t, r, s) for _, s, r, t in rows}, n, e


def every_match(start, edges, rel, types, links, label):
    """(distance, edges as JSON) of all whole matches; edges: (src_var, tgt_var)."""
    part = [({"a": start}, [], 0.0)]
    for no, (x, y) in enumerate(edges):
        more = []
        for var, done, dist in part:
            for s, r, t in links:
                if var.get(x) != s or (no, r) not in rel or (var[y] != t if y in var else t in var.values()):
                    continue
                met = [types[no, k] for k in label[t] if (no, k) in types]
                if any(n == no for n, _ in types) and not any(ok for _, ok in met):
                    continue
                more.append(({**var, y: t}, [*done, {"src": s, "rel": r, "dst": t}], dist + rel[no, r] + min((d for d, _ in met), default=0.0)))
        part = more
    return sorted({(round(d, 9), json.dumps(e, separators=(",", ":"))) for _, e, d in part})


@pytest.mark.parametrize("seed", range(3))
def test_matching_equals_enumeration(spark, graph, seed, monkeypatch):
    name, label, links, n, e = graph
    rng = random.Random(seed)
    edges = [[("a", "b"), ("b", "c"), ("c", "d")], [("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("a", "c")]][seed]
    rel = {(i, r): rng.choice([0.0, 0.1, 0.2, 0.3]) for i in range(len(edges)) for r in rng.sample("rst", 2)}
    types = {(i, k): (rng.choice([0.0, 0.1, 0.5]), rng.random() < 0.7) for i in range(1, len(edges)) for k in "PQR"}
    make = lambda rows, kind: spark.createDataFrame([(q, *r) for q in name[:6] for r in rows], f"query_id string, {kind}")
    starts = spark.createDataFrame([(q, "a", q, 0.0) for q in name[:6]], "query_id string, var string, name string, dist double")
    tables = [starts, make([(i, x, y) for i, (x, y) in enumerate(edges)], "edge_no int, src_var string, tgt_var string"), make([(i, r, d) for (i, r), d in rel.items()], "edge_no int, rel string, dist double"), make([(i, k, *v) for (i, k), v in types.items()], "edge_no int, label string, dist double, similar boolean")]
    want = {q: every_match(q, edges, rel, types, links, label) for q in name[:6]}
    written = []
    write = vectors.write_table
    monkeypatch.setattr(vectors, "write_table", lambda df, what: (written.append(df.count()) if what == "partial_matches" else None, write(df, what))[1])
    ks = (1, 3) if seed == 0 else (2,)
    for k in ks:
        got = vectors.ranked_subgraph_match(*tables, n, e, k).collect()
        have = {q: [(round(r.distance, 9), json.dumps([x.asDict() for x in r.edges], separators=(",", ":"))) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in name[:6]}
        assert have == {q: w[:k] for q, w in want.items()}
    if seed == 0:
        # with one match asked for, the bounded pass writes fewer whole matches than there are
        every = sum(len(w) for w in want.values())
        assert every > 30 and written[2 * len(edges) - 1] < every


def test_ways_of_any_length(spark):
    """A chain of eight types with a side arm, a loop, and a part of its own."""
    steps = [(f"T{i}", "r", f"T{i + 1}") for i in range(8)] + [("T3", "s", "T4"), ("T9", "x", "T4"), ("T2", "self", "T2"), ("U", "y", "V")]
    schema = spark.createDataFrame([(*x, 1) for x in steps], "src_type string, rel string, tgt_type string, freq long")
    got = [(r.src, r.dst, "|".join(r.types), "|".join(r.rels)) for r in schema_paths.shortest_type_paths(schema).collect()]
    both = {(a, r, b) for a, r, b in steps} | {(b, r, a) for a, r, b in steps}
    types = sorted({x for a, _, b in steps for x in (a, b)})
    want = [(a, a, f"{a}|{a}", r) for a, r, b in steps if a == b]
    for src in types:
        level, seen = {src: [((src,), ())]}, {src}
        while level:
            nxt = {}
            for at, ways in level.items():
                for a, r, b in both:
                    if a == at and b not in seen:
                        nxt.setdefault(b, []).extend(((*t, b), (*rs, r)) for t, rs in ways)
            want += [(src, b, "|".join(t), "|".join(rs)) for b, ways in nxt.items() for t, rs in ways]
            seen |= set(nxt)
            level = nxt
    assert sorted(got) == sorted(want)
    assert ("T0", "T8", "|".join(f"T{i}" for i in range(9))) in {x[:3] for x in got}
    some = spark.createDataFrame([("T0", "T8"), ("T0", "U"), ("T2", "T2")], "src string, dst string")
    assert sorted((r.src, r.dst, r.hops) for r in schema_paths.shortest_type_paths(schema, some).collect()) == [("T0", "T8", 8), ("T0", "T8", 8), ("T2", "T2", 1)]
    paths = spark.createDataFrame([(1, ["T0", "T8"], ["h"]), (2, ["T5", "T5"], ["h"]), (3, ["T0", "U"], ["h"])], "query_id int, types array<string>, hints array<string>")
    out = {r.query_id: ("|".join(r.types), list(r.hints)) for r in candidates.expand_type_path(paths, schema).collect()}
    assert out == {1: ("|".join(f"T{i}" for i in range(9)), [None] * 7 + ["h"]), 2: ("T5|T4|T5", [None, "h"]), 3: ("T0|U", ["h"])}


def test_first_paths_of_many_sequences(spark, graph):
    """More than a thousand distinct sequences, some empty: each query gets what its own reaches."""
    name, _, links, n, e = graph
    rng = random.Random(9)
    seqs = {f"q{i}": [rng.choice("rstuvwxyz") for _ in range(rng.choice([0, 1, 2, 3, 4, 4, 4, 4]))] for i in range(2000)}
    assert len({tuple(s) for s in seqs.values()}) > 1000
    anchor = {q: name[i % 12] for i, q in enumerate(seqs)}
    a = spark.createDataFrame(list(anchor.items()), "query_id string, anchor string")
    ranked = spark.createDataFrame([(q, "p", s, 1) for q, s in seqs.items()] + [(q, "z", ["r"], 2) for q in seqs], "query_id string, path_id string, rels array<string>, rank int")
    want = set()
    for q, s in seqs.items():
        at = {anchor[q]}
        for r in s:
            at = {t for x, y, t in links if x in at and y == r and t != anchor[q]}
        want |= {(q, x) for x in at}
    got = [(r.query_id, r.name) for r in explore.best_path_answers(a, ranked, n, e).collect()]
    assert set(got) == want and len(got) == len(want)


def test_anchors_as_lists_and_parts(spark, graph):
    _, label, _, n, e = graph
    rows = [(r.edge_id, r.src_id[2:], r.rel, r.dst_id[2:]) for r in e.collect()]
    a = spark.createDataFrame([("one", ["N1", "N2", "N1", "none"], "all"), ("two", [], "all")], "query_id string, anchor array<string>, plan string")
    p = spark.createDataFrame([("all", "x", ["P", "Q"], ["r"], ["out"])], "plan string, path_id string, types array<string>, rels array<string>, dirs array<string>")
    want = {t for _, s, r, t in rows if s in ("N1", "N2") and r == "r" and "P" in label[s] and "Q" in label[t]}
    assert {r.name for r in traverse.directed_paths(a, p, n, e).collect()} == want
    b = spark.createDataFrame([("part", "n1", "all")], "query_id string, anchor string, plan string")
    want = {t for _, s, r, t in rows if "n1" in s.lower() and r == "r" and "P" in label[s] and "Q" in label[t]}
    assert {r.name for r in traverse.directed_paths(b, p, n, e, match="contains").collect()} == want
