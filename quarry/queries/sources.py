"""Queries of readers and writers: tables derived from the test tables are written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import kb as kbs
from ..fixtures import derive_edges, derive_nodes, table
from ..kb import KB_SQL
from ..session import scratch_path
from ..sources import graph as G
from ..sources import outputs as O
from ..sources import qa as Q
from . import registry
from .evaluation import OUT_SQL, evals, outputs
from .graph import GRAPH_SQL, join_list
from .search import TRIPLES, triples, vectors

QUERIES, ORACLES, query = registry()


@query(TRIPLES + "SELECT source, array_to_string(source_type, '|') AS source_type, relation, target, array_to_string(target_type, '|') AS target_type FROM t")
def read_triples_jsonl(spark, d):
    """Types as a string where there is one, else as an array."""
    at = scratch_path(spark, "triples")
    names = lambda c: F.get(c, F.lit(0)).alias(c)
    forms = [F.to_json(F.struct("source", s, "relation", "target", t)) for s in (names("source_type"), F.col("source_type")) for t in (names("target_type"), F.col("target_type"))]
    one, two = F.size("source_type") == 1, F.size("target_type") == 1
    line = F.when(one & two, forms[0]).when(one, forms[1]).when(two, forms[2]).otherwise(forms[3])
    # a blank line and a broken one here and there
    triples(spark, d).select(F.explode(F.when(F.col("relation") == "LIVES_IN", F.array(line, F.lit(""), F.lit("{broken"))).otherwise(F.array(line))).alias("value")).write.option("compression", "gzip").text(at)
    return G.read_triples_jsonl(spark, at).withColumns({c: F.array_join(c, "|") for c in ("source_type", "target_type")})


def _graph_csv(spark, d):
    at = scratch_path(spark, "graph")
    n, e = derive_nodes(spark, d), derive_edges(spark, d)
    n.select(F.col("node_id").alias(":ID"), F.array_join("labels", ";").alias(":LABEL"), "name", "name_en", F.col("props")["segment"].alias("segment"), F.col("props")["brand"].alias("brand")).write.option("compression", "gzip").option("header", True).csv(f"{at}/nodes")
    e.select(F.col("src_id").alias(":START_ID"), F.col("dst_id").alias(":END_ID"), F.col("rel").alias(":TYPE")).write.option("compression", "gzip").option("header", True).csv(f"{at}/rels")
    return G.read_graph_csv(spark, f"{at}/nodes", f"{at}/rels")


@query(GRAPH_SQL + "SELECT node_id, name, name_en, array_to_string(list_sort(labels), '|') AS labels, segment, brand FROM nodes")
def read_graph_csv_nodes(spark, d):
    return _graph_csv(spark, d)[0].select("node_id", "name", "name_en", join_list("labels").alias("labels"), F.col("props")["segment"].alias("segment"), F.col("props")["brand"].alias("brand"))


@query(GRAPH_SQL + "SELECT concat_ws(':', rel, src_id, dst_id, row_number() OVER (PARTITION BY rel, src_id, dst_id)) AS edge_id, src_id, rel, dst_id FROM edges")
def read_graph_csv_relations(spark, d):
    return _graph_csv(spark, d)[1].drop("props")


@query("SELECT 'C' || c_custkey AS node_id, c_name AS name, NULL::VARCHAR AS name_en, 'Customer' AS label, c_mktsegment AS extra FROM customer UNION ALL SELECT 'P' || p_partkey, p_name, p_brand, 'Part', p_type FROM part")
def read_entity_csv(spark, d):
    at = scratch_path(spark, "entities")
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey"), F.lit("Customer"), F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment", F.lit(None).cast("string"), F.lit(None).cast("string"))
    p = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey"), F.lit("Part"), F.lit("name"), "p_name", F.lit("name_en"), "p_brand", F.lit("type"), "p_type")
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey"), F.lit("Other"), F.lit("name"), "s_name", *[F.lit(None).cast("string")] * 4)
    c.union(p).union(s).write.csv(at)
    got = G.read_entity_csv(spark, at, {"Customer": {"name": 3, "segment": 5}, "Part": {"name": 3, "name_en": 5, "type": 7}})
    return got.select("node_id", "name", "name_en", F.get("labels", F.lit(0)).alias("label"), F.coalesce(F.col("props")["segment"], F.col("props")["type"]).alias("extra"))


@query("SELECT 'P' || a.p_partkey AS src_id, 'MADE_AS' AS rel, 'B' || b.p_brand AS dst_id FROM part p JOIN part a ON a.p_name = p.p_name JOIN (SELECT DISTINCT p_brand FROM part) b ON b.p_brand = p.p_brand UNION ALL SELECT 'C' || c_custkey, 'LIVES_IN', 'N' || c_nationkey FROM customer")
def read_relationship_csv(spark, d):
    """Part names repeat, so that a line stands for all parts of the name."""
    at = scratch_path(spark, "relations")
    p, c, n = table(spark, d, "part"), table(spark, d, "customer"), table(spark, d, "nation")
    p.select("p_name", F.lit("MADE_AS"), "p_brand").union(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_name", F.lit("LIVES_IN"), "n_name")).write.csv(at)
    node = lambda df, x, k, name: df.select(F.concat(F.lit(x), F.col(k).cast("string")).alias("node_id"), F.col(name).alias("name")).distinct()
    nodes = node(p, "P", "p_partkey", "p_name").unionByName(node(p, "B", "p_brand", "p_brand")).unionByName(node(c, "C", "c_custkey", "c_name")).unionByName(node(n, "N", "n_nationkey", "n_name"))
    return G.read_relationship_csv(spark, at, nodes)


def _kb_lines(spark, d):
    at = scratch_path(spark, "kb")
    kb = kbs.load(spark, d)
    v = F.col("v")
    raw = F.struct(v["vtype"].alias("type"), F.coalesce(v["s"], v["num"].cast("string"), v["y"].cast("string"), F.date_format(v["d"], "yyyy/M/d")).alias("value"), v["unit"].alias("unit"))
    q = kb.attr_quals.select("entity_id", "fact_no", "qkey", F.array(raw).alias("vs")).groupBy("entity_id", "fact_no").agg(F.map_from_entries(F.collect_list(F.struct("qkey", "vs"))).alias("qualifiers"))
    a = kb.attrs.select("entity_id", "fact_no", "key", raw.alias("value")).join(q.hint("merge"), ["entity_id", "fact_no"], "left").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("fact_no", "key", F.to_json("value").alias("value"), F.to_json("qualifiers").alias("qualifiers")))).alias("attributes"))
    fact = lambda f: F.concat(F.lit('{"key":"'), f["key"], F.lit('","value":'), f["value"], F.lit(',"qualifiers":'), F.coalesce(f["qualifiers"], F.lit("{}")), F.lit("}"))
    e = kb.entities.select("entity_id", F.regexp_replace("name", " ", "  ").alias("name")).join(a.hint("merge"), "entity_id", "left")
    e.select(F.concat(F.lit('{"id":"'), "entity_id", F.lit('","kind":"entity","name":"'), "name", F.lit('","attributes":['), F.coalesce(F.array_join(F.transform("attributes", fact), ","), F.lit("")), F.lit("]}")).alias("value")).write.text(at)
    return G.read_kb_json(spark, at, lines=True)


@query(KB_SQL + "SELECT a.entity_id, e.name, key, vtype, s, round(num, 4) AS num, unit, y, CAST(d AS VARCHAR) AS d FROM attrs a JOIN entities e ON e.entity_id = a.entity_id")
def read_kb_json(spark, d):
    kb = _kb_lines(spark, d)
    return kb.attrs.join(kb.entities.hint("merge"), "entity_id").select("entity_id", "name", "key", "v.vtype", "v.s", F.round("v.num", 4).alias("num"), "v.unit", "v.y", F.col("v.d").cast("string").alias("d"))


@query(KB_SQL + "SELECT entity_id, qkey, vtype, s, CAST(d AS VARCHAR) AS d FROM attr_quals")
def read_kb_json_qualifiers(spark, d):
    return _kb_lines(spark, d).attr_quals.select("entity_id", "qkey", "v.vtype", "v.s", F.col("v.d").cast("string").alias("d"))


QA_SQL = "SELECT o_orderkey AS idx, 'Who placed ' || o_orderkey || '?' AS question, 'Order#' || o_orderkey AS entity, CASE WHEN o_orderkey % 3 = 0 THEN 'PLACED_BY' ELSE 'PLACED_BY|LIVES_IN' END AS relations, c_name || '|' || n_name AS answers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _qa(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select(F.col("o_orderkey").alias("idx"), F.concat(F.lit("Who placed "), "o_orderkey", F.lit("?")).alias("question"), F.concat(F.lit("Order#"), "o_orderkey").alias("entity"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("LIVES_IN").alias("r2"), "c_name", "n_name")


@query(f"SELECT question, entity, relations AS gold_relations, answers AS gold_answers FROM ({QA_SQL})")
def read_qa(spark, d):
    """Answers as names in odd records, as {{name}} objects in even ones."""
    at = scratch_path(spark, "qa")
    names = F.struct("question", "entity", F.lit("PLACED_BY").alias("relation1"), F.col("r2").alias("relation2"), F.array("c_name", "n_name").alias("answers"))
    objects = F.struct("question", "entity", F.lit("PLACED_BY").alias("relation1"), F.col("r2").alias("relation2"), F.array(F.struct(F.col("c_name").alias("name")), F.struct(F.col("n_name").alias("name"))).alias("answers"))
    _qa(spark, d).select(F.when(F.col("idx") % 2 == 1, F.to_json(names)).otherwise(F.to_json(objects)).alias("value")).write.text(at)
    got = Q.read_qa(spark, at, "entity", ["relation1", "relation2"], "answers")
    return got.select("question", "entity", F.array_join("gold_relations", "|").alias("gold_relations"), F.array_join("gold_answers", "|").alias("gold_answers"))


@query(f"SELECT idx, CASE idx % 5 WHEN 0 THEN 'one_hop' WHEN 1 THEN 'three_intersection' WHEN 2 THEN 'two_intersection' WHEN 3 THEN 'two_hop' ELSE 'one_hop' END AS query_type, CASE idx % 5 WHEN 0 THEN 'entity' WHEN 1 THEN 'anchor_a_name' WHEN 2 THEN 'anchor_a_name' ELSE 'anchor_name' END AS entity_key, CASE idx % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'A|B|C' WHEN 2 THEN 'A|B' WHEN 3 THEN 'A' ELSE 'A' END AS relations, answers FROM ({QA_SQL})")
def detect_sample_format(spark, d):
    q = _qa(spark, d)
    kind = F.col("idx") % 5
    nodes = F.array(F.struct(F.col("c_name").alias("name")), F.struct(F.col("n_name").alias("name")))
    forms = [
        F.struct(F.lit("A").alias("relation"), nodes.alias("answers")),
        F.struct(F.lit("A").alias("anchor_a_rel"), F.lit("B").alias("anchor_b_rel"), F.lit("C").alias("anchor_c_rel"), F.lit("x").alias("anchor_b_name"), F.lit("y").alias("anchor_c_name"), nodes.alias("answer_nodes")),
        F.struct(F.lit("A").alias("anchor_a_rel"), F.lit("B").alias("anchor_b_rel"), F.lit("x").alias("anchor_b_name"), nodes.alias("answer_nodes")),
        F.struct(F.lit("A").alias("rel1"), F.lit("").alias("rel2"), nodes.alias("answer_nodes")),
        F.struct(F.lit("A").alias("relation"), nodes.alias("answer_nodes")),
    ]
    line = F.coalesce(*[F.when(kind == i, F.to_json(f)) for i, f in enumerate(forms)])
    got = Q.detect_sample_format(q.select("idx", line.alias("value")))
    return got.select("idx", "query_type", "entity_key", F.array_join("relations", "|").alias("relations"), F.array_join("answers", "|").alias("answers"))


@query(OUT_SQL + "SELECT idx, pipeline, dataset, array_to_string(pred, '|') AS predicted, error, latency_ms FROM outputs")
def write_outputs(spark, d):
    at = scratch_path(spark, "outputs")
    o = outputs(spark, d)
    O.write_outputs(o, at)
    got = O.read_outputs(spark, at, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in o.schema))
    return got.select("idx", "pipeline", "dataset", F.array_join("predicted_entities", "|").alias("predicted"), "error", "latency_ms")


@query(OUT_SQL + "SELECT pipeline, dataset, count(*) AS total, round(avg(accuracy::INT) * 100, 4) AS accuracy, round(avg(f1) * 100, 4) AS f1 FROM evals GROUP BY ALL")
def write_metrics_summary(spark, d):
    from ..operators.evaluate import aggregate_metrics

    at = scratch_path(spark, "summary")
    O.write_metrics_summary(aggregate_metrics(evals(spark, d), ["pipeline", "dataset"]).select("pipeline", "dataset", "total", "accuracy", "f1"), at)
    got = O.read_metrics_summary(spark, at, "total:bigint,accuracy:double,f1:double")
    return got.select("pipeline", "dataset", "total", F.round("accuracy", 4).alias("accuracy"), F.round("f1", 4).alias("f1"))


@query(OUT_SQL + "SELECT idx, category, round(recall, 6) AS recall FROM cats WHERE category <> 'success'")
def write_failure_analysis(spark, d):
    at = scratch_path(spark, "failures")
    O.write_failure_analysis(evals(spark, d), at)
    return spark.read.schema("idx long, recall double, category string").json(at).select("idx", "category", F.round("recall", 6).alias("recall"))


@query("SELECT item_id, 'Q' || item_id AS question, 'relate' AS final_operation, CASE WHEN item_id % 2 = 0 THEN 3 ELSE 1 END AS hop_count, len(text) AS n FROM benchmark")
def read_examples(spark, d):
    """A pool for each benchmark item, as a list or as {{examples}}."""
    at = scratch_path(spark, "pools")
    b = table(spark, d, "benchmark")
    e = F.struct(F.concat(F.lit("Q"), "item_id").alias("question"), F.array(F.struct(F.lit("A").alias("src_type"))).alias("operations"), F.when(F.col("item_id") % 2 == 0, 3).alias("hop_count"), F.col("text").alias("notes"))
    b.select(F.when(F.col("item_id") % 3 == 0, F.to_json(F.array(e))).otherwise(F.to_json(F.struct(F.array(e).alias("examples")))).alias("value")).write.text(at)
    got = Q.read_examples(spark, at, lines=True)
    return got.select(F.substring("question", 2, 20).cast("long").alias("item_id"), "question", "final_operation", "hop_count", F.char_length("notes").cast("long").alias("n"))


@query("SELECT 'v' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS name, len(embedding) AS n, round(embedding[1]::DOUBLE, 5) AS x FROM embeddings")
def vector_store(spark, d):
    at = scratch_path(spark, "vectors")
    O.save_vectors(vectors(spark, d), at)
    return O.load_vectors(spark, at).select("name", F.size("vec").cast("long").alias("n"), F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("x"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 25")
def slice_dataset(spark, d):
    return Q.slice_dataset(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 25, 500)


@query()
def sample_dataset(spark, d):
    return Q.sample_dataset(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 200)


@query("SELECT conv_id || '-' || turn AS question, regexp_replace(text, '^Output: ', '') AS answer FROM conversations")
def read_pcqa_text(spark, d):
    at = scratch_path(spark, "texts")
    c = table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Output: "), "text")).otherwise(F.col("text")).alias("answer"))
    c.select(F.to_json(F.array(F.struct("question", "answer"))).alias("value")).write.text(at)
    return Q.read_pcqa_text(spark, at)


@query("SELECT o_orderkey AS idx, coalesce(c_name, '') AS answer FROM orders LEFT JOIN customer ON c_custkey = o_orderkey")
def join_gold_by_original_index(spark, d):
    gold = table(spark, d, "customer").select((F.col("c_custkey") - 1).alias("pos"), F.col("c_name").alias("answer"))
    return Q.join_gold_by_original_index(table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderkey").alias("original_index")), gold).select("idx", "answer")


@query("SELECT -o_orderkey AS request_no, c_custkey AS pos, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def load_by_index(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), "c_name")
    return Q.load_by_index(rows, table(spark, d, "orders").select((-F.col("o_orderkey")).alias("request_no"), F.col("o_custkey").alias("pos")))
