"""What is read, made and dealt out of the derived graph does not grow faster than the tables."""

import re

from pyspark.sql import functions as F

from quarry import kb as kbs
from quarry.fixtures import edges, nodes
from quarry.operators import algebra, build, explore, hops, lookup, traverse, vectors
from quarry.queries import candidates, graph, search
from quarry.queries import explore as explore_queries
from quarry.queries import ranking as ranking_queries
from quarry.queries import sources as source_queries
from quarry.session import write_table
from quarry.sources import graph as graph_files
from quarry.streaming.ingest import TripleStore
from tests.test_graph import EDGE, NODE

DIR = "/root/testdata/sf0.001"


def sources(df):
    return {f.rsplit("/", 1)[1].removesuffix(".parquet") for f in df.inputFiles()}


def test_graph_is_read_from_the_tables_that_are_asked_for(spark):
    assert sources(edges(spark, DIR).filter("rel = 'LIVES_IN'")) == {"customer"}
    assert sources(nodes(spark, DIR).filter("array_contains(labels, 'Party')")) == {"customer", "supplier"}


def test_schema_is_counted_once(spark):
    first, again = search.schema(spark, DIR), search.schema(spark, DIR)
    assert first.inputFiles() == again.inputFiles() and all("/schema/" in f for f in first.inputFiles())


def test_queries_are_dealt_out_before_they_become_many_rows(spark):
    assert candidates.local_edges(spark, DIR).rdd.getNumPartitions() >= 4


def test_links_are_left_out_by_the_kinds_of_their_ends(spark):
    both = hops.edges_bi(edges(spark, DIR, kind=True))
    assert sources(hops.between(both, ["Order"], ["Customer"])) == {"orders"}
    assert sources(hops.leaving(both, nodes(spark, DIR, kind=True).filter("name = 'ASIA'"))) == {"nation"}


def test_steps_read_the_relations_of_their_place(spark):
    a = graph.anchors(spark.createDataFrame([("ASIA",)], "x string"), "x")
    got = traverse.follow(a, graph.paths(spark, "customers_of_region"), nodes(spark, DIR, kind=True), edges(spark, DIR))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LIVES_IN AS rel") <= 2


def test_collapsed_schema_takes_parallel_edges_for_two(spark):
    n = spark.createDataFrame([("p", "p", None, ["Part"], None), ("m", "m.1", None, ["CVT"], None), ("o", "o", None, ["Order"], None)], NODE)
    e = spark.createDataFrame([("e1", "m", "L", "p"), ("e2", "m", "L", "p"), ("e3", "o", "H", "m")], EDGE)
    got = lookup.local_schema_edges_collapsed(spark.createDataFrame([("q", "p")], "query_id string, anchor string"), n, e)
    assert sorted(tuple(r) for r in got.select("src", "rel", "tgt", "freq").collect()) == [("Order", "H..L", "Part", 2), ("Part", "L..L", "Part", 2)]


def test_best_paths_read_the_relations_of_the_first_paths_alone(spark):
    n = spark.createDataFrame([("C1", "c", None, ["Customer"], None), ("N1", "n", None, ["Nation"], None)], NODE)
    a = spark.createDataFrame([("q", "c")], "query_id string, anchor string")
    ranked = spark.createDataFrame([("q", "x", ["LIVES_IN"], 1), ("q", "y", ["CONTAINS"], 2)], "query_id string, path_id string, rels array<string>, rank int")
    read = sources(explore.best_path_answers(a, ranked, n, edges(spark, DIR)))
    assert "customer" in read and not read & {"lineitem", "orders"}


def test_patterns_that_are_not_asked_for_are_not_read(spark):
    n = spark.createDataFrame([("C1", "c", None, ["Customer"], None), ("N1", "n", None, ["Nation"], None)], NODE)
    asks = spark.createDataFrame([("q", "nation_of_customer", "C")], "query_id string, pattern string, seed string")
    assert sources(explore.pattern_queries(asks, explore_queries.own_patterns(spark), n, edges(spark, DIR))) == {"customer"}


def test_graph_files_are_compressed(spark):
    assert all(f.endswith(".csv.gz") for f in source_queries._graph_csv(spark, DIR)[1].inputFiles())


def shuffled(spark, run) -> int:
    """Records that run() shuffles."""
    store, seen = spark._jsc.sc().statusStore(), lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in stages()}
    doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        it = store.stageList(None, False, False, doubles, None).iterator()
        while it.hasNext():
            yield it.next()

    before = seen()
    run()
    return sum(n for k, n in seen().items() if k not in before)


def test_relationship_csv_makes_rows_behind_the_last_shuffle(spark, tmp_path):
    """A name of 200 nodes on 300 equal lines: 60000 rows, of which none is shuffled."""
    spark.createDataFrame([("part", "MADE_AS", "brand")] * 300, "a string, b string, c string").write.csv(str(tmp_path / "rels"))
    n = spark.createDataFrame([(f"P{i}", "part") for i in range(200)] + [("B", "brand")], "node_id string, name string")
    got = []
    moved = shuffled(spark, lambda: got.append(graph_files.read_relationship_csv(spark, str(tmp_path / "rels"), n).groupBy().count().first()[0]))
    assert got == [60_000] and moved < 5_000


def test_matcher_takes_links_of_a_hub_by_relation(spark):
    """Links meet partial matches by name and relation, so a hub's other links don't meet them at all."""
    n = spark.createDataFrame([("a", "a", ["X"]), ("h", "h", ["X"])], "node_id string, name string, labels array<string>")
    e = spark.createDataFrame([("1", "a", "r", "h")], "edge_id string, src_id string, rel string, dst_id string")
    m = vectors._Matcher(spark.createDataFrame([("q", "x", "a", 0.0)], "query_id string, var string, name string, dist double"), spark.createDataFrame([("q", 0, "x", "?")], "query_id string, edge_no int, src_var string, tgt_var string"), spark.createDataFrame([("q", 0, "r", 0.1)], "query_id string, edge_no int, rel string, dist double"), spark.createDataFrame([("q", 0, "X", 0.0, True)], "query_id string, edge_no int, label string, dist double, similar boolean"), n, e)
    got = m._grown(m.starts, 0)
    assert got.count() == 1 and re.search(r"SortMergeJoin \[src#\d+, rel#\d+\]", got._jdf.queryExecution().executedPlan().toString())


def test_beam_looks_an_entity_up_once_for_all_queries(spark, monkeypatch):
    """120 queries at one hub with 120 leaves: no table has a row for each query and leaf."""
    n = spark.createDataFrame([("h", "hub")] + [(f"l{i}", f"leaf {i:03}") for i in range(120)], "node_id string, name string")
    e = spark.createDataFrame([(f"e{i}", f"l{i}", "r", "h") for i in range(120)], "edge_id string, src_id string, rel string, dst_id string")
    a = spark.createDataFrame([(f"leaf {i:03}", f"leaf {i:03}") for i in range(120)], "query_id string, anchor string")
    sizes = []

    def written(df, name):
        out = write_table(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(explore, "write_table", written)
    got = explore.beam_explore(a, n, e, depth=2).filter("depth = 2").collect()
    assert len(got) == 360 and {r.dst for r in got} == {"leaf 000", "leaf 001", "leaf 002"} and max(sizes) <= 360


def test_programs_read_the_qualifiers_they_name(spark):
    """Of 6000 facts with three qualifiers at both ends, those of one qualifier meet the program's set."""
    kb, steps = kbs.load(spark, DIR), [("Find", ["Supplier#000000001"]), ("Relate", ["supplies", "forward"]), ("QFilterNum", ["quantity", "30", ">"]), ("Count", [])]
    p = spark.createDataFrame([("p", i, fn, x, [i - 1] if i else []) for i, (fn, x) in enumerate(steps)], "program_id string, step_no int, fn string, inputs array<string>, deps array<int>")
    got = []
    moved = shuffled(spark, lambda: got.extend(algebra.run_programs(p, kb).collect()))
    lines = kb.rels.filter("entity_id = 'S1' and predicate = 'supplies'").join(kb.rel_quals.filter("qkey = 'quantity' and v.num > 30").select(F.col("entity_id").alias("object"), "fact_no"), ["object", "fact_no"])
    assert [(r.status, r.answer) for r in got] == [("ok", str(lines.count()))] and moved < 30_000


def test_triples_meet_by_the_tables_keys(spark):
    plan = search.triples(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(src_id|dst_id|node_id)#\d+", plan) and re.search(r"l_orderkey#\d+L?\]", plan)


def test_triples_of_equal_lines_and_of_missing_ends(spark, tmp_path):
    """As edges and nodes joined by ids: a row for each pair of equal lines, none where an end is missing."""
    for t in ("region", "nation", "customer", "supplier", "part", "orders"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{DIR}/{t}.parquet")
    line = spark.read.parquet(f"{DIR}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(40).localCheckpoint()
    gone = line.limit(4)
    line.unionByName(line.limit(5)).unionByName(line.limit(2)).unionByName(gone.withColumn("l_orderkey", F.lit(-1).cast("long"))).unionByName(gone.withColumn("l_partkey", F.lit(-1).cast("long"))).write.parquet(str(tmp_path / "lineitem.parquet"))
    d = str(tmp_path)
    n = nodes(spark, d)
    end = lambda i, name, kind: n.select(F.col("node_id").alias(i), F.col("name").alias(name), F.col("labels").alias(kind))
    want = edges(spark, d).join(end("src_id", "source", "source_type"), "src_id").join(end("dst_id", "target", "target_type"), "dst_id").select("edge_id", "source", "source_type", F.col("rel").alias("relation"), "target", "target_type")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(search.triples(spark, d)) == rows(want) and len(rows(want)) > 200


def test_upsert_takes_stored_rows_as_they_are(spark):
    """Rows that are stored twice are one relation; a task sends on one row of each."""
    stored = spark.createDataFrame([("a", ["Old"], "r", "b", ["T"])] * 3, build.TRIPLE)
    batch = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("c").alias("source"), F.array(F.concat(F.lit("N"), "id")).alias("source_type"), F.lit("r").alias("relation"), F.lit("b").alias("target"), F.array(F.lit("T")).alias("target_type"), (-F.col("id")).alias("ord"))
    got = []
    moved = shuffled(spark, lambda: got.extend(build.upsert_relations(stored, batch).collect()))
    assert sorted((r.source, r.source_type) for r in got) == [("a", ["Old"]), ("c", ["N3999"])] and moved < 50


def test_lines_of_triples_are_parsed_once(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"source":"a","source_type":["X","Y"],"relation":"r","target":"b","target_type":"Z"}\n\n{broken\n{"source":"c"}\n')
    got = graph_files.read_triples_jsonl(spark, str(tmp_path))
    assert [(r.source, r.source_type, r.target_type) for r in got.collect()] == [("a", ["X", "Y"], ["Z"])]
    assert len(re.findall(r"from_json\(StructField\(source,", got._jdf.queryExecution().optimizedPlan().toString())) == 1


def shared_paths(spark):
    """Queries and paths of two plans: ties, relations without a vector, vectors that are missing or of another length, hints that are missing."""
    vec = lambda i: [float((i * 7) % 5 - 2), float(i % 3), 0.5]
    v = spark.createDataFrame([(f"r{i}", vec(i)) for i in range(12)] + [("short", [1.0]), ("none", None)], "name string, vec array<double>")
    rels = lambda i: [f"r{i % 12}", ["lost", "short", "none", "r3", "r4"][i % 5], f"r{(i * 5) % 12}"]
    p = spark.createDataFrame([("xy"[i % 2], f"p{i:03}", rels(i), None if i == 9 else [1.0] if i == 10 else vec(i)) for i in range(40)] + [("x", "q", [], vec(1))], "plan string, path_id string, rels array<string>, vec array<double>")
    q = spark.createDataFrame([(i, "xyz"[i % 3], None if i == 4 else vec(i + 1), [[vec(i), vec(i + 2)], [None, vec(i), vec(1)], []][i % 3]) for i in range(9)], "query_id long, plan string, qvec array<double>, hints array<array<double>>")
    return q, p, v


def test_shared_paths_rank_as_paths_of_queries(spark):
    q, p, v = shared_paths(spark)
    own = q.select("query_id", "plan").join(p, "plan").repartition(3)
    hints = q.select("query_id", F.posexplode("hints").alias("pos", "hvec")).filter("hvec is not null")
    rows = lambda df: sorted((r.query_id, r.rank, r.path_id, None if r.score is None else round(r.score, 12)) for r in df.collect())
    want = rows(vectors.rank_paths(own.select("query_id", "path_id", "rels"), q.select("query_id", "qvec"), own.select("query_id", "path_id", "vec"), hints, v, 6))
    moved = shuffled(spark, lambda: rows(vectors.rank_shared_paths(q, p, v, 6)))
    assert rows(vectors.rank_shared_paths(q, p, v, 6, block=2)) == rows(vectors.rank_shared_paths(q, p.repartition(4), v, 6)) == want and any(r[3] is None for r in want)
    filled = q.withColumn("hints", F.filter("hints", lambda x: x.isNotNull()))
    want = rows(vectors.score_paths(own.select("query_id", "path_id", "rels"), filled.select("query_id", "hints"), v, 6))
    assert rows(vectors.score_shared_paths(filled, p, v, 6, block=2)) == rows(vectors.score_shared_paths(filled, p.repartition(4), v, 6)) == want
    # vectors of 41 paths of up to three relations are shuffled, and six rows of each query and task
    assert moved < 900


def test_shared_texts_rank_as_texts_of_queries(spark):
    q, p, _ = shared_paths(spark)
    texts = p.select("plan", F.concat(F.lit("A -["), "path_id", F.lit("]-> B")).alias("text"), "vec")
    paths = q.select("query_id", "plan").join(p, "plan").select("query_id", F.array(F.lit("A"), F.lit("B")).alias("types"), F.array("path_id").alias("rels"), F.array(F.lit("out")).alias("dirs"))
    rows = lambda df: sorted((r.query_id, r.rank, r.text, None if r.score is None else round(r.score, 12)) for r in df.collect())
    want = rows(vectors.rank_path_texts(paths, q.select("query_id", "qvec"), texts.select("text", "vec")))
    assert rows(vectors.rank_shared_texts(q.select("query_id", "plan", "qvec"), texts)) == rows(vectors.rank_shared_texts(q.select("query_id", "plan", "qvec"), texts, most=25)) == want and len(want) == 123


def test_path_queries_shuffle_no_row_of_a_query_and_a_path(spark):
    """500 vectors: 25 queries with about 50 paths each."""
    for name, most in (("rank_path_texts", 1300), ("apply_selection", 900)):
        assert shuffled(spark, lambda name=name: ranking_queries.QUERIES[name](spark, DIR).collect()) < most


def test_a_chosen_path_may_be_any_of_the_plan(spark):
    q, p, v = shared_paths(spark)
    chosen = spark.createDataFrame([(0, 15), (3, 10_000), (1, None)], "query_id long, idx int")
    assert vectors.needed_ranks(chosen, p, 4) == 21 and vectors.needed_ranks(chosen.filter("idx is null"), p, 4) == 4
    full = vectors.rank_shared_paths(q, p, v, 100)
    few = vectors.rank_shared_paths(q, p, v, vectors.needed_ranks(chosen, p, 4))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(vectors.apply_selection(few, chosen, 4)) == rows(vectors.apply_selection(full, chosen, 4))


def test_hub_paths_read_the_relations_of_their_steps(spark):
    got = graph.QUERIES["typed_path_via_cvt"](spark, DIR)
    assert sources(got) == {"orders", "lineitem", "part"}


def test_hub_paths_that_repeat_a_relation_use_no_edge_twice(spark):
    n = spark.createDataFrame([("p", "p", None, ["Part"], None), ("m", "m.1", None, ["CVT"], None), ("q", "q", None, ["Part"], None)], NODE)
    e = spark.createDataFrame([("e1", "m", "L", "p"), ("e2", "m", "L", "q")], EDGE)
    plan = spark.createDataFrame([("all", "mates", ["Part", "Part"], ["L..L"]), ("all", "back", ["Part", "CVT", "Part"], ["L", "L"])], "plan string, path_id string, types array<string>, rels array<string>")
    got = traverse.paths_via_hub(spark.createDataFrame([("x", "P", "all")], "query_id string, anchor string, plan string"), plan, n, e)
    assert sorted(map(tuple, got.collect())) == [("x", "back", "q"), ("x", "mates", "q")]


def test_relationship_csv_deals_out_the_rows_of_one_name(spark, tmp_path):
    """A name of 200 nodes on 300 equal lines: no task makes more than a small part of the rows."""
    spark.createDataFrame([("part", "MADE_AS", "brand")] * 300, "a string, b string, c string").write.csv(str(tmp_path / "rels"))
    n = spark.createDataFrame([(f"P{i}", "part") for i in range(200)] + [("B", "brand")], "node_id string, name string")
    got = graph_files.read_relationship_csv(spark, str(tmp_path / "rels"), n).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in got) == 60_000 and max(r["count"] for r in got) < 15_000


def test_a_batch_is_shuffled_once_for_its_runs(spark, tmp_path):
    """3000 relations of 3001 entities are grouped by key and written from there."""
    batch = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("source"), F.array(F.lit("A")).alias("source_type"), F.lit("r").alias("relation"), F.lit("t").alias("target"), F.array(F.lit("B")).alias("target_type"), F.col("id").alias("ord"))
    store = TripleStore(spark, str(tmp_path / "store"), 4)
    moved = shuffled(spark, lambda: store.add(batch, 0))
    assert moved < 8_000 and store.relations().count() == 3000 and store.entities().count() == 3001


def test_matcher_takes_links_that_an_edge_can_have(spark):
    """Of a hub's links those of the edge's relation to a similar label, and all of the relation where a query takes any label."""
    n = spark.createDataFrame([("a", "a", ["X"]), ("h", "h", ["H"]), ("b", "b", ["Y"]), ("c", "c", [])], "node_id string, name string, labels array<string>")
    e = spark.createDataFrame([("1", "a", "r", "h"), ("2", "b", "r", "h"), ("3", "c", "r", "h"), ("4", "h", "s", "b")], "edge_id string, src_id string, rel string, dst_id string")
    starts = spark.createDataFrame([("q", "x", "h", 0.0)], "query_id string, var string, name string, dist double")
    asked = spark.createDataFrame([("q", 0, "x", "?"), ("q", 1, "?", "z")], "query_id string, edge_no int, src_var string, tgt_var string")
    near = spark.createDataFrame([("q", 0, "r", 0.1), ("q", 1, "s", 0.1)], "query_id string, edge_no int, rel string, dist double")
    types = spark.createDataFrame([("q", 0, "X", 0.0, True), ("q", 0, "Y", 0.9, False)], "query_id string, edge_no int, label string, dist double, similar boolean")
    m = vectors._Matcher(starts, asked, near, types, n, e)
    links = lambda i: sorted((r.src, r.rel, r.dst) for r in m._links(i).collect())
    assert links(0) == [("h", "r", "a"), ("h", "r", "c")] and links(1) == [("b", "s", "h"), ("h", "s", "b")] and m.links.count() == 4
