"""ROUGE-L, samples, prompts, vectors and sequences against brute force."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from quarry import fixtures
from quarry.functions.text import rouge_l
from quarry.operators import benchmark, traverse, vectors
from quarry.queries import graph, search
from quarry.sources import qa


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        was = 0
        for j, y in enumerate(b, 1):
            was, row[j] = row[j], was + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_rouge_l_equals_plain_python(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("a b C c d".split()) for _ in range(n))
    rows = [(i, text(rng.randint(0, 40)), text(rng.randint(0, 40))) for i in range(200)]
    rows += [(900, None, "a"), (901, "a", None), (902, "", " \n"), (903, text(900), text(700)), (904, "A  b\tC", "a b c"), (905, "a", "é")]
    got = {r.id: (r.r, r.p, r.f) for r in rouge_l(spark.createDataFrame(rows, "id long, gold string, pred string")).collect()}
    for i, g, p in rows:
        a, b = (g or "").lower().split(), (p or "").lower().split()
        n = lcs(a, b)
        r, q = n / max(1, len(a)), n / max(1, len(b))
        assert got[i] == pytest.approx((r, q, 2 * r * q / (r + q) if n else 0.0)), i
    assert rouge_l(spark.createDataFrame([], "id long, gold string, pred string")).count() == 0


def test_samples_are_seeded_and_whole(spark):
    d = spark.range(500).withColumnRenamed("id", "k").withColumn("x", F.col("k") * 2)
    one = [tuple(r) for r in qa.sample_dataset(d, "k", 40).collect()]
    two = [tuple(r) for r in qa.sample_dataset(d.repartition(7), "k", 40).collect()]
    assert sorted(one) == sorted(two) and len(set(one)) == 40 and all(x == 2 * k for k, x in one)
    assert qa.sample_dataset(d, "k", 1000).count() == 500
    assert max(k for k, _ in one) > 250 > min(k for k, _ in one)


def test_prompt_rows(spark):
    ex = spark.createDataFrame([("a", "Qa?", [("x", "r")], "n1"), ("b", "Qb?", [("y", "s"), ("z", "t")], "n1"), ("c", "Qc?", [], "")], "name string, question string, operations array<struct<src:string,rel:string>>, notes string")
    chosen = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (2, 1, "c")], "query_id int, rank int, name string")
    got = {r.query_id: (r.text, r.notes) for r in benchmark.prompt_rows(chosen, ex).collect()}
    part = lambda n, q, ops: f"Example {n}: {q}\n" + json.dumps(ops, separators=(",", ":"))
    assert got[1] == (part(1, "Qb?", [{"src": "y", "rel": "s"}, {"src": "z", "rel": "t"}]) + "\n\n" + part(2, "Qa?", [{"src": "x", "rel": "r"}]), "n1")
    assert got[2] == (part(1, "Qc?", []), "")


@pytest.fixture(scope="module")
def cloud(spark):
    """Vectors in clusters, with copies and a zero vector; queries among them."""
    rng = random.Random(8)
    centre = [[rng.gauss(0, 5) for _ in range(12)] for _ in range(6)]
    rows = [(f"v{i:04}", [x + rng.gauss(0, 0.5) for x in centre[i % 6]]) for i in range(900)]
    rows += [("twin", rows[5][1]), ("also", rows[5][1]), ("zero", [0.0] * 12)]
    v = spark.createDataFrame(rows, "name string, vec array<float>").repartition(3)
    q = v.filter("name < 'v0012' or name = 'zero'").select(F.col("name").alias("query_id"), F.col("vec").alias("qvec"))
    return {n: [float(x) for x in r] for n, r in [(r["name"], r["vec"]) for r in v.collect()]}, v, q


@pytest.mark.parametrize("block", [20_000, 5])
def test_nearest_is_exact_and_compares_less(spark, cloud, block):
    vec, v, q = cloud
    count = spark.sparkContext.accumulator(0)
    got = vectors.nearest_l2(q, v, 5, pivots=8, block=block, compared=count)
    have = sorted((r.query_id, r.rank, r.name) for r in got.collect())
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5
    want = [(r.query_id, k, n) for r in q.collect() for k, n in enumerate(sorted(vec, key=lambda n, i=r.query_id: (dist(vec[i], vec[n]), n))[:5], 1)]
    assert have == sorted(want)
    assert count.value < len(vec) * q.count() / 2
    assert vectors.nearest_l2(q.limit(0), v, 5).count() == 0 == vectors.nearest_l2(q, v.limit(0), 5).count()


def test_mmr_equals_plain_python(cloud):
    vec, v, q = cloud
    norm = lambda a: sum(x * x for x in a) ** 0.5
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b) + 1e-12)
    want = []
    for r in q.collect():
        chosen = []
        for no in range(1, 5):
            gain = {n: round(0.3 * cos(vec[r.query_id], x) - (0.7 * max(cos(x, vec[c]) for c in chosen) if chosen else 0), 9) for n, x in vec.items() if n not in chosen}
            best = min(gain, key=lambda n: (-gain[n], n))
            want.append((r.query_id, no, round(gain[best], 5)))
            chosen.append(best)
    got = vectors.mmr_select(q, v, 4, block=7).collect()
    assert sorted((r.query_id, r.rank, round(r.score, 5)) for r in got) == sorted(want)
    assert len({(r.query_id, r.name) for r in got}) == len(got)


@pytest.mark.parametrize("block", [20_000, 5])
def test_hints_and_cosines_equal_the_join_of_all_pairs(spark, cloud, block):
    """Ties, a name that is the hint, vectors missing, empty or of another length."""
    _, v, q = cloud
    v = v.unionByName(spark.createDataFrame([("none", None), ("empty", []), ("short", [1.0])], v.schema))
    q = q.withColumn("hint", F.when(F.col("query_id") < "v0004", F.upper("query_id")).otherwise("x")).unionByName(spark.createDataFrame([("blind", None, "x")], "query_id string, qvec array<float>, hint string"))
    options = q.crossJoin(v).select("query_id", F.col("name").alias("rel"), "hint", F.col("vec").alias("rvec"), F.col("qvec").alias("hvec"))
    seen = lambda d: sorted((r.query_id, r.rel, r.score is None or round(r.score, 9)) for r in d.collect())
    assert seen(vectors.prune_by_hints(q, v, 5, block)) == seen(vectors.prune_by_hint(options, 5))
    every = {(r.query_id, r.name): r.cos for r in vectors.every_cosine(q, v, block).collect()}
    assert len(every) == q.count() * v.count()
    for r in options.select("query_id", "rel", vectors.cosine(F.col("rvec"), F.col("hvec")).alias("c")).collect():
        have = every[r.query_id, r.rel]
        assert (have is None) == (r.c is None) and (have is None or abs(have - r.c) < 1e-9)


def test_similar_text_pairs_takes_every_query_vector_with_all(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    q = spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id % 20 = 0").count()
    assert search.similar_text_pairs(spark, d).count() == q * n + n


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_sequences_equal_all_simple_paths(spark, hops):
    """Few paths stand for all: on dense random graphs with hubs and few nodes, where avoiding a node matters."""
    rng = random.Random(hops)
    rows = [(f"e{i}", f"n{rng.randrange(4 + hops)}", rng.choice("rst"), f"n{rng.randrange(4 + hops)}") for i in range(14)] + [(f"h{i}", "n0", "r", f"x{i}") for i in range(9)]
    nodes = sorted({x for r in rows for x in (r[1], r[3])})
    label = {n: ["A", "B"] if n < "n3" else ["B"] for n in nodes}
    n = spark.createDataFrame([(x, f"name {x}", None, label[x]) for x in nodes], "node_id string, name string, name_en string, labels array<string>")
    e = spark.createDataFrame(rows, "edge_id string, src_id string, rel string, dst_id string")
    a = spark.createDataFrame([(x, f"name {x}") for x in nodes], "query_id string, anchor string")
    links = {(s, r, t) for _, s, r, t in rows} | {(t, r, s) for _, s, r, t in rows}

    def walk(at, ids, rels, types):
        if len(rels) == hops:
            yield ids[0], rels
            return
        for s, r, t in links:
            if s == at and t not in ids and (types is None or types[len(rels)] in label[t]):
                yield from walk(t, (*ids, t), (*rels, r), types)

    for types in (None, ["B", "A", "B", "A"][:hops]):
        want = {x for s in nodes for x in walk(s, (s,), (), types)}
        got = [(r.query_id, tuple(r.rels)) for r in traverse.relation_sequences(a, hops, n, e, types).collect()]
        assert set(got) == want and len(got) == len(want)
    assert list(itertools.islice(want, 1))


def test_sequences_are_the_same_where_kinds_of_ends_are_known(spark):
    """Three hops from all customers and nations of the derived graph, in which most relations can't follow each other."""
    d = "/root/testdata/sf0.001"
    a = graph.anchors(spark.read.parquet(f"{d}/customer.parquet"), "c_name").unionByName(graph.anchors(spark.read.parquet(f"{d}/nation.parquet"), "n_name"))
    n, e = fixtures.nodes(spark, d, kind=True), fixtures.edges(spark, d)
    seen = lambda **how: sorted((r.query_id, tuple(r.rels)) for r in traverse.relation_sequences(a, 3, n, e, **how).collect())
    got = seen(ends=fixtures.ENDS)
    assert got and got == seen()
    assert traverse.steps_of({"Region"}, 2, fixtures.ENDS)[1] == ({"Nation"}, ["IN_REGION"], ["BASED_IN", "LIVES_IN"])


def test_few_paths_avoid_what_any_path_avoids(spark):
    """A hub that all paths but one pass is avoided by the one kept for it."""
    rows = [("g", ["hub", f"x{i}"]) for i in range(50)] + [("g", ["z", "y"])]
    got = {tuple(r.ids) for r in traverse.few_that_avoid(spark.createDataFrame(rows, "g string, ids array<string>"), ["g"], 1).collect()}
    assert ("z", "y") in got and len(got) <= 3
