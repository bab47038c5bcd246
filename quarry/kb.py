"""The knowledge base with qualified facts derived from the star-schema tables, and its SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import _id, line_key, table, union
from .model import value


@dataclass
class KB:
    """entities(entity_id, name), concepts(concept_id, name), instance_of(child, parent),
    attrs(entity_id, fact_no, key, v), attr_quals(entity_id, fact_no, qkey, q_no, v),
    rels(entity_id, fact_no, predicate, direction, object), rel_quals like attr_quals.
    Facts of an entity are ordered by fact_no (text). first_entity: least, one row, where it is
    known already."""

    entities: DataFrame
    concepts: DataFrame
    instance_of: DataFrame
    attrs: DataFrame
    attr_quals: DataFrame
    rels: DataFrame
    rel_quals: DataFrame
    first_entity: DataFrame | None = None


def load(spark: SparkSession, d: str) -> KB:
    t = lambda n: table(spark, d, n)
    part, cust, supp, orders, nation = t("part"), t("customer"), t("supplier"), t("orders"), t("nation")
    line = t("lineitem").withColumn("k", line_key())
    ent = lambda df, p, k, n: df.select(_id(p, k).alias("entity_id"), n.alias("name"))
    entities = union([ent(part, "P", "p_partkey", F.col("p_name")), ent(cust, "C", "c_custkey", F.col("c_name")), ent(supp, "S", "s_suppkey", F.col("s_name")), ent(orders, "O", "o_orderkey", _id("Order#", "o_orderkey")), ent(nation, "N", "n_nationkey", F.col("n_name"))])
    con = lambda df, p, c: df.select(F.concat(F.lit(p), c).alias("concept_id"), F.col(c).alias("name")).distinct()
    fixed = spark.createDataFrame([(f"K:{x}", x) for x in ("Product", "Brand", "Party", "Supplier")], "concept_id string, name string")
    concepts = union([con(part, "T:", "p_type"), con(part, "B:", "p_brand"), con(cust, "M:", "c_mktsegment"), fixed])
    link = lambda df, a, b: df.select(a.alias("child"), b.alias("parent")).distinct()
    ids = lambda p, c: F.concat(F.lit(p), c)
    instance_of = union(
        [
            link(part, _id("P", "p_partkey"), ids("T:", "p_type")),
            link(part, ids("T:", "p_type"), F.lit("K:Product")),
            link(part, _id("P", "p_partkey"), ids("B:", "p_brand")),
            link(part, ids("B:", "p_brand"), F.lit("K:Brand")),
            link(cust, _id("C", "c_custkey"), ids("M:", "c_mktsegment")),
            link(cust, ids("M:", "c_mktsegment"), F.lit("K:Party")),
            link(supp, _id("S", "s_suppkey"), F.lit("K:Supplier")),
            spark.createDataFrame([("K:Brand", "K:Product"), ("K:Supplier", "K:Party")], "child string, parent string"),
        ]
    )
    fact = lambda df, e, no, key, v: df.select(e.alias("entity_id"), (F.lit(no) if isinstance(no, str) else no).alias("fact_no"), F.lit(key).alias("key"), v.alias("v"))
    p, o, c = _id("P", "p_partkey"), _id("O", "o_orderkey"), _id("C", "o_custkey")
    by_order = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    attrs = union(
        [
            fact(part, p, "1", "size", value("quantity", num=F.col("p_size"), unit="cm")),
            fact(part, p, "2", "retail price", value("quantity", num=F.col("p_retailprice"), unit="usd")),
            fact(part, p, "3", "brand", value("string", s=F.col("p_brand"))),
            fact(orders, o, "1", "order date", value("date", d=F.to_date("o_orderdate"))),
            fact(orders, o, "2", "order year", value("year", y=F.year("o_orderdate"))),
            fact(orders, o, "3", "priority", value("string", s=F.col("o_orderpriority"))),
            fact(orders, o, "4", "total", value("quantity", num=F.col("o_totalprice"), unit="usd")),
            fact(orders, c, by_order, "order total", value("quantity", num=F.col("o_totalprice"), unit="usd")),
        ]
    )
    qual = lambda df, e, no, key, v: df.select(e.alias("entity_id"), no.alias("fact_no"), F.lit(key).alias("qkey"), F.lit(1).alias("q_no"), v.alias("v"))
    attr_quals = union([qual(orders, c, by_order, "point in time", value("date", d=F.to_date("o_orderdate"))), qual(orders, c, by_order, "status", value("string", s=F.col("o_orderstatus")))])
    rel = lambda df, e, no, pred, way, to: df.select(e.alias("entity_id"), no.alias("fact_no"), F.lit(pred).alias("predicate"), F.lit(way).alias("direction"), to.alias("object"))
    s, lp, k = _id("S", "l_suppkey"), _id("P", "l_partkey"), F.col("k")
    cc, n = _id("C", "c_custkey"), _id("N", "c_nationkey")
    rels = union([rel(line, s, k, "supplies", "forward", lp), rel(line, lp, k, "supplies", "backward", s), rel(cust, cc, cc, "country", "forward", n), rel(cust, n, cc, "country", "backward", cc)])
    both = line.select("*", F.explode(F.array(s, lp)).alias("e"))
    e = F.col("e")
    rel_quals = union([qual(both, e, k, "quantity", value("quantity", num=F.col("l_quantity"), unit="1")), qual(both, e, k, "ship date", value("date", d=F.to_date("l_shipdate"))), qual(both, e, k, "return flag", value("string", s=F.col("l_returnflag")))])
    return KB(entities, concepts, instance_of, attrs, attr_quals, rels, rel_quals)


KB_SQL = """
WITH RECURSIVE line AS MATERIALIZED (
  SELECT *, concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_shipdate AS DATE)) AS k FROM lineitem),
entities AS MATERIALIZED (
  SELECT 'P' || p_partkey AS entity_id, p_name AS name FROM part UNION ALL SELECT 'C' || c_custkey, c_name FROM customer
  UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'O' || o_orderkey, 'Order#' || o_orderkey FROM orders UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation),
concepts AS MATERIALIZED (
  SELECT DISTINCT 'T:' || p_type AS concept_id, p_type AS name FROM part UNION ALL SELECT DISTINCT 'B:' || p_brand, p_brand FROM part
  UNION ALL SELECT DISTINCT 'M:' || c_mktsegment, c_mktsegment FROM customer UNION ALL SELECT 'K:' || x, x FROM (VALUES ('Product'), ('Brand'), ('Party'), ('Supplier')) t(x)),
instance_of AS MATERIALIZED (
  SELECT 'P' || p_partkey AS child, 'T:' || p_type AS parent FROM part UNION SELECT 'T:' || p_type, 'K:Product' FROM part UNION SELECT 'P' || p_partkey, 'B:' || p_brand FROM part
  UNION SELECT 'B:' || p_brand, 'K:Brand' FROM part UNION SELECT 'C' || c_custkey, 'M:' || c_mktsegment FROM customer UNION SELECT 'M:' || c_mktsegment, 'K:Party' FROM customer
  UNION SELECT 'S' || s_suppkey, 'K:Supplier' FROM supplier UNION SELECT 'K:Brand', 'K:Product' UNION SELECT 'K:Supplier', 'K:Party'),
attrs AS MATERIALIZED (
  SELECT 'P' || p_partkey AS entity_id, '1' AS fact_no, 'size' AS key, 'quantity' AS vtype, NULL::VARCHAR AS s, p_size::DOUBLE AS num, 'cm' AS unit, NULL::INT AS y, NULL::DATE AS d FROM part
  UNION ALL SELECT 'P' || p_partkey, '2', 'retail price', 'quantity', NULL, p_retailprice, 'usd', NULL, NULL FROM part
  UNION ALL SELECT 'P' || p_partkey, '3', 'brand', 'string', p_brand, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'O' || o_orderkey, '1', 'order date', 'date', NULL, NULL, NULL, NULL, o_orderdate::DATE FROM orders
  UNION ALL SELECT 'O' || o_orderkey, '2', 'order year', 'year', NULL, NULL, NULL, year(o_orderdate)::INT, NULL FROM orders
  UNION ALL SELECT 'O' || o_orderkey, '3', 'priority', 'string', o_orderpriority, NULL, NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'O' || o_orderkey, '4', 'total', 'quantity', NULL, o_totalprice, 'usd', NULL, NULL FROM orders
  UNION ALL SELECT 'C' || o_custkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), 'order total', 'quantity', NULL, o_totalprice, 'usd', NULL, NULL FROM orders),
attr_quals AS MATERIALIZED (
  SELECT 'C' || o_custkey AS entity_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS fact_no, 'point in time' AS qkey, 'date' AS vtype, NULL::VARCHAR AS s, NULL::DOUBLE AS num, NULL::VARCHAR AS unit, o_orderdate::DATE AS d FROM orders
  UNION ALL SELECT 'C' || o_custkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), 'status', 'string', o_orderstatus, NULL, NULL, NULL FROM orders),
rels AS MATERIALIZED (
  SELECT 'S' || l_suppkey AS entity_id, k AS fact_no, 'supplies' AS predicate, 'forward' AS direction, 'P' || l_partkey AS object FROM line
  UNION ALL SELECT 'P' || l_partkey, k, 'supplies', 'backward', 'S' || l_suppkey FROM line
  UNION ALL SELECT 'C' || c_custkey, 'C' || c_custkey, 'country', 'forward', 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'country', 'backward', 'C' || c_custkey FROM customer),
rel_quals AS MATERIALIZED (
  SELECT e AS entity_id, k AS fact_no, q AS qkey, vtype, CASE q WHEN 'return flag' THEN l_returnflag END AS s, CASE q WHEN 'quantity' THEN l_quantity END AS num, CASE q WHEN 'quantity' THEN '1' END AS unit, CASE q WHEN 'ship date' THEN l_shipdate::DATE END AS d
  FROM (SELECT *, unnest(['S' || l_suppkey, 'P' || l_partkey]) AS e FROM line), (VALUES ('quantity', 'quantity'), ('ship date', 'date'), ('return flag', 'string')) t(q, vtype)),
anc AS (SELECT child, parent FROM instance_of UNION SELECT a.child, i.parent FROM anc a JOIN instance_of i ON i.child = a.parent)
"""
