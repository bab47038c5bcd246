"""Queries of candidate paths and plan repair over the derived schema graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import edges, nodes, table
from ..plans import candidates as C
from ..plans import schema_paths as H
from ..session import shuffle_partitions
from . import registry
from .graph import SCHEMA_SQL
from .search import DIRECTED, TWO_WAY, WALKS, joined, schema

QUERIES, ORACLES, query = registry()

TYPES_SQL = ", ty AS MATERIALIZED (SELECT DISTINCT src_type AS x FROM sch UNION SELECT DISTINCT tgt_type FROM sch)"
PAIR_SQL = TWO_WAY + TYPES_SQL + ", pr AS MATERIALIZED (SELECT s.x AS s, t.x AS t FROM ty s, ty t), w1 AS MATERIALIZED (SELECT DISTINCT a, b FROM bw)\n"


def type_pairs(spark, d):
    """All pairs of the schema's types, which are few."""
    s = schema(spark, d)
    t = s.select(F.col("src_type").alias("x")).unionByName(s.select(F.col("tgt_type").alias("x"))).distinct()
    return t.select(F.col("x").alias("src")).crossJoin(t.select(F.col("x").alias("dst")))


@query(DIRECTED + "SELECT src AS start, types, rels FROM hall WHERE src <> dst AND (src <> 'Order' OR dst = 'Nation')")
def enumerate_type_paths(spark, d):
    t = type_pairs(spark, d).select(F.col("src").alias("start")).distinct().withColumn("target", F.when(F.col("start") == "Order", "Nation"))
    return C.enumerate_type_paths(t, schema(spark, d)).select("start", joined("types"), joined("rels"))


@query(PAIR_SQL + ", o AS (SELECT p.s, p.t, coalesce(w.rel, 'hint') AS rel FROM pr p LEFT JOIN bw w ON w.a = p.s AND w.b = p.t) SELECT x.s || '>' || x.t AS query_id, x.rel || '|' || y.rel AS rels FROM o x JOIN o y ON y.s = x.t AND y.t = 'Nation'")
def chain_candidates(spark, d):
    """Two steps: any type to any type, and on to Nation."""
    p = type_pairs(spark, d)
    q = F.concat_ws(">", "src", "dst").alias("query_id")
    t = p.select(q, F.lit(0).alias("step"), "src", F.col("dst").alias("tgt")).unionByName(p.select(q, F.lit(1).alias("step"), F.col("dst").alias("src"), F.lit("Nation").alias("tgt")))
    return C.chain_candidates(t.withColumn("hint", F.lit("hint")), schema(spark, d))


@query(PAIR_SQL + ", o AS (SELECT p.s, p.t, coalesce(w.rel, 'hint') AS rel FROM pr p LEFT JOIN bw w ON w.a = p.s AND w.b = p.t) SELECT x.s || '>' || x.t AS query_id, concat_ws('|', x.rel, y.rel, z.rel) AS rels FROM o x JOIN o y ON y.s = x.t AND y.t = 'Part' JOIN o z ON z.s = 'Supplier' AND z.t = 'Part'")
def intersection_candidates(spark, d):
    """Two branches that end at Part: of two steps, and of one."""
    p = type_pairs(spark, d)
    q = F.concat_ws(">", "src", "dst").alias("query_id")
    row = lambda b, i, s, t: p.select(q, F.lit(b).alias("branch"), F.lit(i).alias("step"), s.alias("src"), t.alias("tgt"))
    t = row(0, 0, F.col("src"), F.col("dst")).unionByName(row(0, 1, F.col("dst"), F.lit("Part"))).unionByName(row(1, 0, F.lit("Supplier"), F.lit("Part")))
    return C.intersection_candidates(t.withColumn("hint", F.lit("hint")), schema(spark, d))


EXPAND_SQL = PAIR_SQL.replace(", w1 AS", ", direct AS").replace(" w1 ", " direct ").rstrip() + ", " + WALKS + """,
way AS MATERIALIZED (SELECT s, t, arg_min(types, (n, types)) AS types FROM (
  SELECT src AS s, dst AS t, types, n FROM walks WHERE src <> dst UNION ALL SELECT x.a, x.a, concat_ws('|', x.a, x.b, x.a), 2 FROM direct x WHERE x.a <> x.b) GROUP BY s, t),
ex AS MATERIALIZED (SELECT p.s, p.t, CASE WHEN w.a IS NOT NULL THEN p.s || '|' || p.t ELSE coalesce(y.types, p.s || '|' || p.t) END AS types FROM pr p LEFT JOIN direct w ON w.a = p.s AND w.b = p.t LEFT JOIN way y ON y.s = p.s AND y.t = p.t)
"""


def pair_paths(spark, d):
    return type_pairs(spark, d).select(F.concat_ws(">", "src", "dst").alias("query_id"), F.array("src", "dst", F.lit("Nation")).alias("types"), F.array(F.lit("h0"), F.lit("h1")).alias("hints"))


@query(EXPAND_SQL + "SELECT x.s || '>' || x.t AS query_id, x.types || substr(y.types, length(x.t) + 1) AS types, repeat('-|', len(string_split(x.types, '|')) - 2) || 'h0|' || repeat('-|', len(string_split(y.types, '|')) - 2) || 'h1' AS hints FROM ex x JOIN ex y ON y.s = x.t AND y.t = 'Nation'")
def expand_type_path(spark, d):
    got = C.expand_type_path(pair_paths(spark, d), schema(spark, d))
    return got.select("query_id", joined("types"), F.array_join(F.transform("hints", lambda h: F.coalesce(h, F.lit("-"))), "|").alias("hints"))


@query(PAIR_SQL + ", f AS (SELECT a, b, min(rel) AS rel FROM bw GROUP BY a, b) SELECT p.s AS src, p.t AS dst, p.s || '|' || p.t AS types, w.rel AS rels FROM pr p JOIN bw w ON w.a = p.s AND w.b = p.t UNION ALL SELECT p.s, p.t, concat_ws('|', p.s, x.b, p.t), x.rel || '|' || y.rel FROM pr p JOIN f x ON x.a = p.s JOIN f y ON y.a = x.b AND y.b = p.t WHERE NOT EXISTS (SELECT 1 FROM w1 WHERE a = p.s AND b = p.t)")
def kg_type_paths(spark, d):
    return C.kg_type_paths(type_pairs(spark, d), schema(spark, d)).select("src", "dst", joined("types"), joined("rels"))


@query(EXPAND_SQL + ", e AS (SELECT x.s || '>' || x.t AS query_id, string_split(x.types || substr(y.types, length(x.t) + 1), '|') AS t FROM ex x JOIN ex y ON y.s = x.t AND y.t = 'Nation'), s AS (SELECT query_id, t, i, t[i] AS a, t[i + 1] AS b FROM (SELECT query_id, t, unnest(range(1, len(t))) AS i FROM e)), c AS (SELECT s.query_id, any_value(t) AS t, s.i, count(DISTINCT rel) AS n FROM s LEFT JOIN bw ON bw.a = s.a AND bw.b = s.b GROUP BY ALL) SELECT query_id, array_to_string(any_value(t), '|') AS types, CAST(product(n) AS BIGINT) AS n FROM c GROUP BY query_id HAVING product(n) > 0")
def stepwise_candidates(spark, d):
    got = C.stepwise_candidates(pair_paths(spark, d), schema(spark, d))
    return got.groupBy("query_id", "types").agg(F.count("*").alias("n")).select("query_id", joined("types"), "n")


@query(PAIR_SQL + "SELECT s || '>' || t AS query_id, CASE WHEN s = 'Part' THEN s || '>' || t WHEN t = 'Part' THEN t || '>' || s ELSE s || '>' || t END || ',' || CASE WHEN s <> 'Part' AND t <> 'Part' THEN 'Nation>' || t WHEN CASE WHEN s = 'Part' THEN t ELSE s END = 'Nation' THEN 'Nation>' || t WHEN CASE WHEN s = 'Part' THEN t ELSE s END = t THEN t || '>Nation' ELSE 'Nation>' || t END AS hops, (s <> 'Part' AND t = 'Part')::INT + CASE WHEN s <> 'Part' AND t <> 'Part' THEN 0 WHEN CASE WHEN s = 'Part' THEN t ELSE s END = 'Nation' THEN 0 WHEN CASE WHEN s = 'Part' THEN t ELSE s END = t THEN 1 ELSE 0 END AS swaps FROM pr")
def reorient_plan(spark, d):
    """Anchors are parts; hop 1 is any pair of types, hop 2 leads from Nation to the second of them."""
    hop = lambda a, b: F.struct(a.alias("src"), b.alias("tgt"))
    p = type_pairs(spark, d).select(F.concat_ws(">", "src", "dst").alias("query_id"), F.array(hop(F.col("src"), F.col("dst")), hop(F.lit("Nation"), F.col("dst"))).alias("hops"), F.array(F.lit("Part")).alias("labels"))
    return C.reorient_plan(p).select("query_id", F.array_join(F.transform("hops", lambda h: F.concat_ws(">", h["src"], h["tgt"])), ",").alias("hops"), "swaps")


@query(PAIR_SQL + ", n AS (SELECT a, string_agg(b, ', ' ORDER BY b) AS near FROM (SELECT DISTINCT a, b FROM bw QUALIFY dense_rank() OVER (PARTITION BY a ORDER BY b) <= 5) GROUP BY a), dirs AS (SELECT DISTINCT src_type AS a, rel, tgt_type AS b, 'f' AS w FROM sch UNION SELECT DISTINCT tgt_type, rel, src_type, 'r' FROM sch WHERE src_type <> tgt_type), c AS (SELECT a, b, count(*) AS k FROM dirs GROUP BY a, b), q AS (SELECT s, t FROM pr UNION ALL SELECT s, 'Moon' FROM pr WHERE t = 'Part') SELECT s || '>' || t AS id, '(' || s || ')->(' || t || '): ' || CASE WHEN c.k > 0 THEN 'OK (' || c.k || ' relations)' ELSE 'NO EDGES [' || s || ' connects to: ' || x.near || '] [' || t || CASE WHEN y.near IS NULL THEN ' not in schema]' ELSE ' reached from: ' || y.near || ']' END END AS text FROM q LEFT JOIN c ON c.a = s AND c.b = t LEFT JOIN n x ON x.a = s LEFT JOIN n y ON y.a = t")
def diagnose_plan(spark, d):
    p = type_pairs(spark, d)
    p = p.unionByName(p.filter("dst = 'Part'").select("src", F.lit("Moon").alias("dst")))
    return C.diagnose_plan(p.select(F.concat_ws(">", "src", "dst").alias("id"), "src", F.col("dst").alias("tgt")), schema(spark, d))


@query(SCHEMA_SQL + "SELECT node_id AS id, CASE CAST(len(node_id) AS INT) % 5 WHEN 0 THEN labels[1] WHEN 1 THEN labels[1] WHEN 2 THEN CASE WHEN labels[1] = 'Customer' THEN 'Party' END WHEN 3 THEN CASE WHEN labels[1] = 'Party' THEN 'Customer' END END AS type FROM nodes WHERE node_id NOT LIKE 'L%'")
def normalise_types(spark, d):
    """Exact with a rest of JSON, in capitals, by alias, by reversed alias, unknown."""
    n = nodes(spark, d).filter(~F.col("node_id").startswith("L"))
    k, lab = F.char_length("node_id") % 5, F.get("labels", F.lit(0))
    name = F.when(k == 0, F.concat(F.lit(" "), lab, F.lit("},"))).when(k == 1, F.upper(lab)).when(k == 2, F.when(lab == "Customer", "buyer").otherwise("nobody")).when(k == 3, "nothing").otherwise("unknown")
    aliases = spark.createDataFrame([("buyer", "party"), ("customer", "client")], "alias string, meant string")
    types = n.select(F.explode("labels").alias("type")).distinct()
    return C.normalise_types(n.select(F.col("node_id").alias("id"), name.alias("name")), types, aliases)


@query(SCHEMA_SQL + ", o AS (SELECT DISTINCT src_type || '/' || w AS query_id, src_type, rel, w FROM sch, (SELECT unnest(['NATION', 'part', 'Moon']) AS w) t), k AS (SELECT o.*, EXISTS (SELECT 1 FROM sch s WHERE s.src_type = o.src_type AND s.rel = o.rel AND lower(s.tgt_type) = lower(o.w)) AS ok FROM o) SELECT query_id, src_type, rel FROM k WHERE ok OR NOT EXISTS (SELECT 1 FROM k j WHERE j.query_id = k.query_id AND j.ok)")
def filter_by_type_schema(spark, d):
    s = schema(spark, d)
    o = s.select("src_type", "rel").distinct().select("src_type", "rel", F.explode(F.array(F.lit("NATION"), F.lit("part"), F.lit("Moon"))).alias("type")).withColumn("query_id", F.concat_ws("/", "src_type", "type"))
    return C.filter_by_type_schema(o.select("query_id", "src_type", "rel"), o.select("query_id", "type").distinct(), H.transitions_of(s))


LOCAL_SQL = SCHEMA_SQL + ", l AS MATERIALIZED (SELECT c_name AS query_id, src_type AS src, rel, tgt_type AS tgt, src_type = 'Customer' AS near, freq FROM customer, sch UNION ALL SELECT c_name, src_type, rel, tgt_type, false, freq + 1 FROM customer, sch WHERE src_type = 'Part'), k AS (SELECT query_id, src, rel, tgt, max(near::INT) AS near, max(freq) FILTER (near) AS f1, max(freq) AS freq FROM l GROUP BY ALL), p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, coalesce(f1, freq) DESC, src, rel, tgt) AS pos FROM k)\n"


def spread(queries):
    """queries over all tasks by query_id, before each becomes many rows: a small file is read by one task."""
    return queries.repartition(shuffle_partitions(queries.sparkSession), "query_id")


def local_edges(spark, d):
    """Schema edges as each customer's local schema (a stated list for every query), some twice."""
    c, s = spread(table(spark, d, "customer").select(F.col("c_name").alias("query_id"))), schema(spark, d)
    l = c.crossJoin(F.broadcast(s.select(F.col("src_type").alias("src"), "rel", F.col("tgt_type").alias("tgt"), (F.col("src_type") == "Customer").alias("is_1hop"), "freq")))
    return l.unionByName(l.filter("src = 'Part'").withColumns({"is_1hop": F.lit(False), "freq": F.col("freq") + 1}))


@query(LOCAL_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(rel) DESC, pos) AS rest FROM p WHERE pos > 3) SELECT query_id, src, rel, tgt, freq, pos FROM p WHERE pos <= 3 UNION ALL SELECT query_id, src, rel, tgt, freq, 3 + rest FROM r WHERE rest <= 4")
def local_schema_budget(spark, d):
    """Seven edges of each: three by frequency, four by a score of the relation."""
    l = local_edges(spark, d)
    return C.local_schema_budget(l, l.select("query_id", "rel", F.char_length("rel").cast("double").alias("score")).distinct(), 7)


@query(LOCAL_SQL + "SELECT query_id, src, rel, tgt, freq, pos FROM p WHERE pos <= 7")
def local_schema_by_frequency(spark, d):
    return C.local_schema_budget(local_edges(spark, d), None, 7)


@query(SCHEMA_SQL + "SELECT c_name AS query_id, row_number() OVER (PARTITION BY c_name ORDER BY (length(rel) + c_custkey) % 7 DESC, src_type, rel, tgt_type) AS rank, '(' || src_type || ')-[' || rel || ' (' || replace(rel, '_', ' ') || ')]->(' || tgt_type || ') x' || freq AS line FROM customer, sch QUALIFY rank <= 4")
def schema_relevance_list(spark, d):
    s = schema(spark, d)
    rels = s.select("rel").distinct()
    c = spread(table(spark, d, "customer").select(F.col("c_name").alias("query_id"), "c_custkey"))
    sc = c.crossJoin(F.broadcast(rels)).select("query_id", "rel", ((F.char_length("rel") + F.col("c_custkey")) % 7).cast("double").alias("score"))
    return C.schema_relevance_list(s, sc, rels.withColumn("noun", F.translate("rel", "_", " ")), 4)


DIST_SQL = ", d0 AS (SELECT DISTINCT a, a AS b, 0 AS n FROM bw), dd AS MATERIALIZED (SELECT a, b, min(n) AS n FROM (SELECT * FROM d0 UNION ALL SELECT DISTINCT a, b, 1 FROM bw) GROUP BY a, b)"


@query(TWO_WAY + DIST_SQL + ", c AS MATERIALIZED (SELECT p_partkey AS q, e AS no, src_type, rel, tgt_type, ((length(rel) * 7 + length(src_type) + p_partkey * (e + 1)) % 11) / 10 AS dist FROM part, (SELECT unnest([0, 1]) AS e) t, (SELECT DISTINCT src_type, rel, tgt_type FROM sch) s), k AS MATERIALIZED (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY q, no ORDER BY dist, src_type, rel, tgt_type) <= 3) SELECT x.q AS query_id, concat_ws(' ', x.src_type, x.rel, x.tgt_type, y.src_type, y.rel, y.tgt_type) AS edges, round(x.dist + y.dist, 6) AS distance FROM k x JOIN k y ON y.q = x.q AND x.no = 0 AND y.no = 1 JOIN dd ON dd.a = x.tgt_type AND dd.b = y.src_type AND dd.n <= 1 QUALIFY row_number() OVER (PARTITION BY x.q ORDER BY round(x.dist + y.dist, 6), edges) <= 100")
def match_schema_edges(spark, d):
    """Two pseudo edges for every part, each with its three nearest schema edges; all matches."""
    from ..operators.hops import top_k

    s = schema(spark, d).select("src_type", "rel", "tgt_type").distinct()
    p = spread(table(spark, d, "part").select(F.col("p_partkey").alias("query_id")))
    c = p.select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("edge_no")).crossJoin(F.broadcast(s))
    c = c.withColumn("dist", ((F.char_length("rel") * 7 + F.char_length("src_type") + F.col("query_id") * (F.col("edge_no") + 1)) % 11) / 10)
    near = top_k(c, ["query_id", "edge_no"], ["dist", "src_type", "rel", "tgt_type"], 3)
    got = C.match_schema_edges(near, H.type_distances(schema(spark, d)), 1, 100)
    return got.select("query_id", F.array_join(F.transform("edges", lambda e: F.concat_ws(" ", e["src_type"], e["rel"], e["tgt_type"])), " ").alias("edges"), F.round("distance", 6).alias("distance"))
