"""Queries of path validation, exploration and patterns on the derived property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import ENDS, GRAPH_SQL, edges, nodes, table
from ..operators import explore as X
from . import registry
from .graph import anchors

QUERIES, ORACLES, query = registry()


def sequences(spark, d):
    """Two relation sequences for every customer: to its region, and one that leads nowhere."""
    c = table(spark, d, "customer").select(F.col("c_name").alias("query_id"))
    paths = F.array(F.struct(F.lit("home").alias("path_id"), F.array(F.lit("LIVES_IN"), F.lit("IN_REGION")).alias("rels")), F.struct(F.lit("none").alias("path_id"), F.array(F.lit("LIVES_IN"), F.lit("SUPPLIES")).alias("rels")), F.struct(F.lit("orders").alias("path_id"), F.array(F.lit("PLACED_BY")).alias("rels")))
    return c.select("query_id", F.explode(paths).alias("p")).select("query_id", "p.*")


@query("SELECT c_name AS query_id, 'home' AS path_id, true AS is_valid, r_name AS names FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_name, 'none', false, '' FROM customer UNION ALL SELECT c_name, 'orders', count(n) > 0, coalesce(string_agg(n, '|' ORDER BY n), '') FROM customer LEFT JOIN (SELECT o_custkey, 'Order#' || o_orderkey AS n FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY 'Order#' || o_orderkey) <= 10) ON o_custkey = c_custkey GROUP BY c_name")
def validate_path_undirected(spark, d):
    a = anchors(table(spark, d, "customer"), "c_name").drop("plan")
    got = X.validate_undirected(a, sequences(spark, d), nodes(spark, d), edges(spark, d))
    return got.select("query_id", "path_id", "is_valid", F.array_join("names", "|").alias("names"))


@query("SELECT c_name AS query_id, 'home' AS path_id FROM customer")
def validate_path_directed(spark, d):
    return X.validate_directed(anchors(table(spark, d, "customer"), "c_name").drop("plan"), sequences(spark, d), nodes(spark, d), edges(spark, d))


def own_patterns(spark):
    """The named patterns, and some in the words of the derived graph."""
    own = [
        ("nation_of_customer", "Customer", "ci", ["LIVES_IN"], ["out"], ["Nation"], None),
        ("part_mates", "Part", "ci", ["CONTAINS", "CONTAINS"], ["in", "out"], ["Order", None], None),
        ("open_orders", "Customer", "ci", ["PLACED_BY"], ["in"], [None], "open"),
        ("nations_within", "Region", "contains", ["IN_REGION"], ["in"], ["Nation"], None),
    ]
    return spark.createDataFrame(X.PATTERNS + own, X.PATTERN_TYPE)


@query(GRAPH_SQL + """SELECT c_name AS query_id, 'nation_of_customer' AS pattern, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT c_name, 'open_orders', 'Order#' || o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O'
UNION ALL SELECT DISTINCT substr(r.r_name, 2, 2), 'nations_within', n_name FROM region r JOIN nation n ON true JOIN region k ON k.r_regionkey = n_regionkey AND contains(lower(k.r_name), lower(substr(r.r_name, 2, 2)))
UNION ALL SELECT DISTINCT p.name, 'part_mates', q.name FROM nodes p JOIN edges e ON e.dst_id = p.node_id AND e.rel = 'CONTAINS' JOIN edges f ON f.src_id = e.src_id AND f.rel = 'CONTAINS' AND f.edge_id <> e.edge_id JOIN nodes q ON q.node_id = f.dst_id""")
def pattern_queries(spark, d):
    """Four patterns of the derived graph: one hop, a V over a hub, a property of the answer, a seed within a name."""
    n = nodes(spark, d).withColumn("props", F.when(F.element_at("props", "status") == "O", F.create_map(F.lit("open"), F.lit("YES"))).otherwise(F.col("props")))
    ask = lambda t, c, p, name: table(spark, d, t).select(name.alias("query_id"), F.lit(p).alias("pattern"), name.alias("seed")).distinct()
    c = F.col("c_name")
    a = ask("customer", "c_name", "nation_of_customer", c).unionByName(ask("customer", "c_name", "open_orders", c)).unionByName(ask("part", "p_name", "part_mates", F.col("p_name"))).unionByName(ask("region", "r_name", "nations_within", F.substring("r_name", 2, 2)))
    return X.pattern_queries(a, own_patterns(spark), n, edges(spark, d))


@query("SELECT DISTINCT p_brand AS query_id, lower(p_name) AS name FROM part WHERE p_partkey % 3 <> 0")
def pattern_answers(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("癌"))).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return X.pattern_answers(p)


def _beam_sql(depth: int) -> str:
    parts, out = ["e0 AS (SELECT DISTINCT c_name AS q, c_name AS src FROM customer)"], []
    for i in range(1, depth + 1):
        parts += [
            f"n{i} AS MATERIALIZED (SELECT DISTINCT q, src, bi.rel, y.name AS dst FROM e{i - 1} JOIN nodes x ON x.name = src JOIN bi ON bi.a_id = x.node_id JOIN nodes y ON y.node_id = bi.b_id)",
            f"r{i} AS (SELECT q, src, rel, CASE WHEN rel = 'LIVES_IN' THEN 0.9 ELSE 1 / n END AS rs FROM (SELECT *, count(*) OVER (PARTITION BY q, src) AS n FROM (SELECT DISTINCT q, src, rel FROM n{i})) QUALIFY row_number() OVER (PARTITION BY q, src ORDER BY CASE WHEN rel = 'LIVES_IN' THEN 0.9 ELSE 1 / n END DESC, rel) <= 3)",
            f"m{i} AS (SELECT n.*, rs, count(*) OVER (PARTITION BY n.q, n.src, n.rel) AS m, row_number() OVER (PARTITION BY n.q, n.src, n.rel ORDER BY dst) AS k FROM n{i} n JOIN r{i} r ON r.q = n.q AND r.src = n.src AND r.rel = n.rel)",
            f"f{i} AS (SELECT *, CASE WHEN m <= 3 THEN 1 / m ELSE 0 END AS es FROM m{i} WHERE k <= 30 QUALIFY row_number() OVER (PARTITION BY q, src, rel ORDER BY CASE WHEN m <= 3 THEN 1 / m ELSE 0 END DESC, dst) <= 3)",
            f"b{i} AS MATERIALIZED (SELECT q, src, rel, dst, rs * 0.5 + es * 0.5 AS score, row_number() OVER (PARTITION BY q ORDER BY rs * 0.5 + es * 0.5 DESC, src, rel, dst) AS rank FROM f{i} QUALIFY rank <= 3)",
            f"e{i} AS (SELECT DISTINCT q, dst AS src FROM b{i} WHERE {i} < 2 OR q NOT LIKE '%1')",
        ]
        out.append(f"SELECT q AS query_id, {i} AS depth, rank, src, rel, dst, round(score, 6) AS score FROM b{i}")
    return GRAPH_SQL + ", " + ", ".join(parts) + " " + " UNION ALL ".join(out)


@query(_beam_sql(3))
def beam_explore(spark, d):
    """Three steps from every customer; LIVES_IN scores 0.9, and a tenth of the queries have enough after two."""
    a = anchors(table(spark, d, "customer"), "c_name")
    scores = a.select("query_id", F.lit("LIVES_IN").alias("rel"), F.lit(0.9).alias("score"))
    enough = a.filter(F.col("query_id").endswith("1")).select("query_id", F.lit(2).alias("depth"))
    return X.beam_explore(a, nodes(spark, d, kind=True), edges(spark, d), scores, None, enough, ends=ENDS).withColumn("score", F.round("score", 6))


@query("SELECT p_brand AS query_id, 'P' || arg_max(p_partkey, (p_size, -p_partkey)) AS path_id FROM part WHERE p_brand LIKE '%1' GROUP BY p_brand, p_type UNION ALL SELECT p_brand, 'P' || p_partkey FROM part WHERE p_brand NOT LIKE '%1' QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 3")
def path_per_source_type(spark, d):
    """Brands as queries, their parts as paths by size; brands that end in 1 need one of each type."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("path_id"), F.array("p_type").alias("types"), F.col("p_size").cast("double").alias("score"))
    need = p.filter(F.col("query_id").endswith("1")).select("query_id", F.get("types", F.lit(0)).alias("src_type"))
    got = X.path_per_source_type(p, need)
    return got.select("query_id", F.concat(F.lit("P"), F.substring("path_id", 2, 20).cast("long").cast("string")).alias("path_id"))


@query("SELECT c_name AS query_id, 'LIVES_IN|IN_REGION' AS rels, 1 AS tier FROM customer UNION ALL SELECT s_name, 'BASED_IN|IN_REGION', 3 FROM supplier UNION ALL SELECT DISTINCT s_name, 'BASED_IN|LIVES_IN', 3 FROM supplier JOIN customer ON c_nationkey = s_nationkey UNION ALL SELECT DISTINCT a.s_name, 'BASED_IN|BASED_IN', 3 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey UNION ALL SELECT DISTINCT s_name, 'SUPPLIES|SAME_BRAND', 3 FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part p ON p_partkey = l_partkey JOIN part q ON p.p_brand = q.p_brand AND q.p_partkey <> p.p_partkey AND (q.p_partkey = (SELECT min(p_partkey) FROM part k WHERE k.p_brand = p.p_brand) OR p.p_partkey = (SELECT min(p_partkey) FROM part k WHERE k.p_brand = p.p_brand)) UNION ALL SELECT DISTINCT a.l, 'SUPPLIES|SUPPLIES', 3 FROM (SELECT DISTINCT s_name AS l, l_partkey AS p, l_suppkey AS s FROM supplier JOIN lineitem ON l_suppkey = s_suppkey) a JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) b ON b.p = a.p AND b.s <> a.s UNION ALL SELECT DISTINCT s_name, 'SUPPLIES|CONTAINS', 3 FROM supplier JOIN lineitem ON l_suppkey = s_suppkey UNION ALL SELECT DISTINCT s_name, 'SUPPLIES|LINE_PART', 3 FROM supplier JOIN lineitem ON l_suppkey = s_suppkey")
def relation_sequences_relaxed(spark, d):
    """Customers have sequences along Nation and Region; suppliers none along these but for any types."""
    a = anchors(table(spark, d, "customer"), "c_name").unionByName(anchors(table(spark, d, "supplier"), "s_name"))
    n = nodes(spark, d, kind=True).withColumn("labels", F.when(F.array_contains("labels", "Region"), F.array(F.lit("Region"))).otherwise(F.col("labels")))
    e = edges(spark, d)
    own = a.filter(F.col("query_id").startswith("Customer"))
    rest = a.join(own.select("query_id"), "query_id", "left_anti")
    got = X.relaxed_sequences(own, ["Nation", "Region"], "Moon", n, e, ENDS).unionByName(X.relaxed_sequences(rest, ["Moon", "Region"], "Star", n, e, ENDS))
    return got.select("query_id", F.array_join("rels", "|").alias("rels"), "tier")


@query("SELECT DISTINCT c_name AS query_id, CASE WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN r_name ELSE n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def best_path_answers(spark, d):
    """The first of two ranked sequences for every customer; an empty one for a fifth of them."""
    c = table(spark, d, "customer")
    none = F.col("c_custkey") % 5 == 0
    rels = lambda *r: F.when(none, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, r))).alias("rels")
    two = F.array(F.struct(F.lit("a").alias("path_id"), rels("LIVES_IN", "IN_REGION"), (F.col("c_custkey") % 2).alias("rank")), F.struct(F.lit("b").alias("path_id"), rels("LIVES_IN"), (1 - F.col("c_custkey") % 2).alias("rank")))
    ranked = c.select(F.col("c_name").alias("query_id"), F.explode(two).alias("p")).select("query_id", "p.*")
    return X.best_path_answers(anchors(c, "c_name").drop("plan"), ranked, nodes(spark, d), edges(spark, d))


@query("SELECT DISTINCT c_name AS query_id, n_name AS name, 'Nation' AS type FROM customer JOIN nation ON c_nationkey = n_nationkey")
def compound_resolution(spark, d):
    """A customer's nation by both names, through LIVES_IN; by the nation's name alone in odd queries."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    a = c.select(F.col("c_name").alias("query_id"), F.when(F.col("c_custkey") % 2 == 0, F.array("n_name", "c_name")).otherwise(F.array("n_name")).alias("terms"))
    # the longer name is the hub's: customers link to nations, so names of nations are made longer on both sides
    pad = lambda x: F.concat(x, F.lit(" of the world and all its seas"))
    n = nodes(spark, d).withColumn("name", F.when(F.array_contains("labels", "Nation"), pad(F.col("name"))).otherwise(F.col("name")))
    a = a.withColumn("terms", F.transform("terms", lambda t: F.when(t.startswith("Customer"), t).otherwise(pad(t))))
    got = X.compound_resolution(a, "LIVES_IN", "Nation", n, edges(spark, d))
    return got.select("query_id", F.regexp_replace("name", " of the world and all its seas$", "").alias("name"), "type")
