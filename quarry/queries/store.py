"""Queries of the property store over the derived knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import kb as kbs
from ..functions import text as T
from ..kb import KB_SQL
from ..model import text_of
from ..operators import build
from ..operators import store as S
from . import registry
from .graph import edges, nodes

QUERIES, ORACLES, query = registry()

#: quantities as text, alike in both engines
TEXT_SQL = "CASE vtype WHEN 'string' THEN s WHEN 'year' THEN CAST(y AS VARCHAR) WHEN 'date' THEN CAST(d AS VARCHAR) ELSE CASE WHEN num = floor(num) THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE CAST(num AS VARCHAR) END || CASE WHEN unit = '1' THEN '' ELSE ' ' || unit END END"
FACT_SQL = KB_SQL + f", facts AS MATERIALIZED (SELECT a.*, e.name, {TEXT_SQL} AS t FROM attrs a JOIN entities e ON e.entity_id = a.entity_id)\n"


def names(kb, prefix: str):
    return kb.entities.filter(F.col("entity_id").startswith(prefix)).select("name").distinct()


def asks(df, **columns):
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(F.col("name").alias("query_id"), *[lit(v).alias(c) for c, v in {"name": F.col("name"), **columns}.items()])


@query(FACT_SQL + "SELECT name AS query_id, arg_min(t, (entity_id, fact_no)) AS answer FROM facts WHERE key = 'size' GROUP BY name")
def prop_query_attr(spark, d):
    """First value of a roughly written key (`Si-ze`) for each name."""
    kb = kbs.load(spark, d)
    return S.query_attr(asks(names(kb, "P"), key="Si-ze"), kb).select("query_id", text_of(F.col("v")).alias("answer"))


@query(FACT_SQL + "SELECT DISTINCT name FROM facts WHERE key = 'order year' AND y < 1997 AND name LIKE 'Order%'")
def prop_filter_by_attr(spark, d):
    kb = kbs.load(spark, d)
    a = asks(names(kb, "O"), key="ORDER_year", op="<", value="1997")
    return S.filter_by_attr(a, kb).select("name")


@query(FACT_SQL + "SELECT f.name AS query_id, arg_min(CAST(q.d AS VARCHAR), (f.entity_id, f.fact_no)) AS answer FROM facts f JOIN (SELECT name, min(t) AS t FROM facts WHERE key = 'order total' GROUP BY name) m ON m.name = f.name AND m.t = f.t JOIN attr_quals q ON q.entity_id = f.entity_id AND q.fact_no = f.fact_no AND q.qkey = 'point in time' WHERE f.key = 'order total' GROUP BY f.name")
def prop_attr_qualifier(spark, d):
    """When was the order of a total that is given as text, in capitals?"""
    kb = kbs.load(spark, d)
    t = kb.attrs.filter("key = 'order total'").join(kb.entities, "entity_id").groupBy("name").agg(F.min(text_of(F.col("v"))).alias("t"))
    a = asks(t, key="Order-Total", value=F.upper("t"), qkey="point_in_time")
    return S.attr_qualifier(a, kb).select("query_id", text_of(F.col("v")).alias("answer"))


@query(KB_SQL + "SELECT s.name || '/' || p.name AS query_id, arg_min(CAST(q.d AS VARCHAR), (r.entity_id, r.fact_no)) AS answer FROM rels r JOIN entities s ON s.entity_id = r.entity_id JOIN entities p ON p.entity_id = r.object JOIN rel_quals q ON q.entity_id = r.entity_id AND q.fact_no = r.fact_no AND q.qkey = 'ship date' WHERE r.predicate = 'supplies' AND r.direction = 'forward' GROUP BY 1")
def prop_relation_qualifier(spark, d):
    """First ship date of every pair of supplier and part; part and supplier change places in half of the asks."""
    kb = kbs.load(spark, d)
    kb.rels = kb.rels.filter("direction = 'forward'")
    n = kb.entities.select("entity_id", "name")
    p = kb.rels.filter("predicate = 'supplies'").join(n.withColumnRenamed("name", "x"), "entity_id").join(n.select(F.col("entity_id").alias("object"), F.col("name").alias("y")), "object").select("x", "y").distinct()
    turn = F.pmod(F.crc32(F.concat("x", "y").cast("binary")), F.lit(2)) == 1
    a = p.select(F.concat_ws("/", "x", "y").alias("query_id"), F.when(turn, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(turn, F.col("x")).otherwise(F.col("y")).alias("b"), F.lit("Supplies").alias("predicate"), F.lit("ship-date").alias("qkey"))
    return S.relation_qualifier(a, kb).select("query_id", text_of(F.col("v")).alias("answer"))


@query(FACT_SQL + "SELECT entity_id, key, CASE WHEN length(t) > 50 THEN substr(t, 1, 47) || '...' ELSE t END AS preview, vtype FROM (SELECT entity_id, key, arg_min(t, fact_no) AS t, arg_min(vtype, fact_no) AS vtype FROM facts GROUP BY entity_id, key)")
def kb_available_properties(spark, d):
    """First value of each key of every entity as a short preview."""
    return S.available_properties(kbs.load(spark, d))


@query(KB_SQL + "SELECT lower(name) AS name, min(entity_id) AS first_id, count(*) AS n FROM entities GROUP BY 1 UNION ALL SELECT lower(name), min(concept_id), count(*) FROM concepts WHERE lower(name) NOT IN (SELECT lower(name) FROM entities) GROUP BY 1")
def name_index(spark, d):
    return S.name_index(kbs.load(spark, d)).groupBy("name").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


@query(KB_SQL + "SELECT DISTINCT e.entity_id || '/' || a.key AS query_id, CASE CAST(substr(e.entity_id, 2) AS BIGINT) % 3 WHEN 2 THEN 'x' || a.key ELSE a.key END AS key FROM attrs a JOIN entities e ON e.entity_id = a.entity_id")
def resolve_key(spark, d):
    """Keys as they are, with _ and capitals, and unknown ones."""
    kb = kbs.load(spark, d)
    a = kb.attrs.select("entity_id", "key").distinct()
    how = F.substring("entity_id", 2, 20).cast("long") % 3
    a = a.select(F.concat_ws("/", "entity_id", "key").alias("query_id"), F.when(how == 0, F.col("key")).when(how == 1, F.upper(F.translate("key", " ", "_"))).otherwise(F.concat(F.lit("x"), "key")).alias("key"))
    return S.resolve_key(a, S.known_keys(kb)).select("query_id", "key")


@query("SELECT o_orderkey AS query_id, CASE o_orderkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'date' WHEN 2 THEN 'string' ELSE 'quantity' END AS vtype, CASE o_orderkey % 4 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN 2 THEN 'about ' || year(o_orderdate) ELSE CAST(o_custkey AS VARCHAR) END AS answer FROM orders")
def parse_target_value(spark, d):
    from ..fixtures import table

    o = table(spark, d, "orders")
    k, y = F.col("o_orderkey") % 4, F.year("o_orderdate").cast("string")
    text = F.when(k == 0, F.concat(F.lit(" "), y)).when(k == 1, F.date_format("o_orderdate", "yyyy-M-d")).when(k == 2, F.concat(F.lit("about "), y)).otherwise(F.col("o_custkey").cast("string"))
    v = S.parse_target(text, F.when(k == 3, "quantity").otherwise("date"))
    return o.select(F.col("o_orderkey").alias("query_id"), v["vtype"].alias("vtype"), text_of(v).alias("answer"))


@query(FACT_SQL + "SELECT n.name AS query_id, coalesce(arg_min(t, (f.entity_id, f.fact_no)), '') AS answer FROM (SELECT DISTINCT name FROM entities) n LEFT JOIN facts f ON f.name = n.name AND f.key = 'order date' GROUP BY n.name")
def answer_attr(spark, d):
    kb = kbs.load(spark, d)
    return S.answer_attr(asks(kb.entities.select("name").distinct(), key="order date"), kb)


@query(FACT_SQL + "SELECT name AS query_id, CASE CAST(substr(name, 7) AS BIGINT) % 3 WHEN 0 THEN CASE WHEN max(year(d)) FILTER (key = 'order date') = 1996 THEN 'yes' ELSE 'no' END WHEN 1 THEN CASE WHEN lower(max(s) FILTER (key = 'priority')) = '1-urgent' THEN 'yes' ELSE 'no' END ELSE 'no' END AS answer FROM facts WHERE name LIKE 'Order#%' GROUP BY name")
def answer_verify(spark, d):
    """Was an order in 1996; is its priority `1-URGENT`; a key that it hasn't."""
    kb = kbs.load(spark, d)
    k = F.substring("name", 7, 20).cast("long") % 3
    a = asks(names(kb, "O"), key=F.when(k == 0, "order date").when(k == 1, "priority").otherwise("weight"), op="=", value=F.when(k == 0, "1996").otherwise("1-URGENT"))
    return S.answer_verify(a, kb)


@query(FACT_SQL + ", v AS (SELECT name, max(num) AS num FROM facts WHERE key = 'total' GROUP BY name), p AS (SELECT 'Order#' || min(o_orderkey) AS a, 'Order#' || max(o_orderkey) AS b, o_custkey FROM orders GROUP BY o_custkey) SELECT o_custkey AS query_id, CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN x.num >= y.num THEN a ELSE b END ELSE CASE WHEN x.num <= y.num THEN a ELSE b END END AS answer FROM p JOIN v x ON x.name = a JOIN v y ON y.name = b")
def answer_select_between(spark, d):
    """The larger (or smaller) of each customer's first and last order."""
    from ..fixtures import table

    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("x"), F.max("o_orderkey").alias("y"))
    a = o.select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("Order#"), "x").alias("a"), F.concat(F.lit("Order#"), "y").alias("b"), F.lit("total").alias("key"), F.when(F.col("o_custkey") % 2 == 0, "Larger").otherwise("smaller").alias("mode"))
    return S.select_between(a, kbs.load(spark, d))


@query("SELECT o_custkey AS query_id, 'Order#' || CASE o_custkey % 4 WHEN 0 THEN arg_max(o_orderkey, (o_totalprice, -o_orderkey)) WHEN 2 THEN min(o_orderkey) WHEN 1 THEN arg_min(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) ELSE arg_max(o_orderkey, (CAST(o_orderdate AS DATE), -o_orderkey)) END AS answer FROM orders GROUP BY o_custkey")
def answer_select_among(spark, d):
    """Each customer's order of the greatest total, the earliest, or without a mode the latest; a mode that no list has takes the first."""
    from ..fixtures import table

    k = F.col("o_custkey") % 4
    even = k % 2 == 0
    mode = F.when(k == 0, "Greater").when(k == 2, "largest").when(k == 1, "earliest")
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("Order#"), "o_orderkey").alias("name"), F.when(even, "total").otherwise("order date").alias("key"), mode.alias("mode"))
    return S.select_among(a, kbs.load(spark, d))


QUALIFIER_SQL = FACT_SQL + ", q1 AS (SELECT f.name AS query_id, arg_min(q.s, (f.entity_id, f.fact_no)) AS answer FROM facts f JOIN (SELECT name, min(t) AS t FROM facts WHERE key = 'order total' GROUP BY name) m ON m.name = f.name AND m.t = f.t JOIN attr_quals q ON q.entity_id = f.entity_id AND q.fact_no = f.fact_no AND q.qkey = 'status' WHERE f.key = 'order total' GROUP BY f.name), m AS (SELECT name, min(t) AS t FROM facts WHERE key = 'order total' GROUP BY name)\n"


@query(QUALIFIER_SQL + "SELECT m.name AS query_id, CASE WHEN CAST(regexp_extract(m.name, '[0-9]+$') AS BIGINT) % 4 = 3 THEN '' ELSE coalesce(q1.answer, '') END AS answer FROM m LEFT JOIN q1 ON q1.query_id = m.name")
def answer_qualifiers(spark, d):
    """The status of the order of a given total; a fourth of the asks lack the value."""
    kb = kbs.load(spark, d)
    t = kb.attrs.filter("key = 'order total'").join(kb.entities, "entity_id").groupBy("name").agg(F.min(text_of(F.col("v"))).alias("t"))
    a = asks(t, answer_type="attr_qualifier", key="order total", value=F.when(F.regexp_extract("name", "([0-9]+)$", 1).cast("long") % 4 != 3, F.col("t")), b=F.lit(None).cast("string"), qkey="status")
    return S.answer_qualifiers(a, kb)


@query(KB_SQL + "SELECT e.name AS query_id, CAST(count(r.object) AS VARCHAR) AS answer FROM entities e LEFT JOIN (SELECT DISTINCT entity_id, object FROM rels WHERE direction = 'forward') r ON r.entity_id = e.entity_id WHERE e.entity_id LIKE 'S%' OR e.entity_id LIKE 'C%' GROUP BY e.name")
def answer_count(spark, d):
    kb = kbs.load(spark, d)
    who = kb.entities.filter(F.substring("entity_id", 1, 1).isin("S", "C"))
    got = who.join(kb.rels.filter("direction = 'forward'").select("entity_id", "object").distinct(), "entity_id").select(F.col("name").alias("query_id"), F.col("object").alias("name"))
    return S.answer_count(who.select(F.col("name").alias("query_id")), got)


@query("SELECT c_name AS query_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'LIVES IN' END AS answer FROM customer")
def answer_relation(spark, d):
    """The relation of each customer to its nation; a third of the asks name another node."""
    from ..fixtures import table

    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    a = c.select(F.col("c_name").alias("query_id"), F.col("c_name").alias("a"), F.when(F.col("c_custkey") % 3 == 0, "nowhere").otherwise(F.col("n_name")).alias("b"))
    return S.answer_relation(a, nodes(spark, d), edges(spark, d))


@query(FACT_SQL + ", c AS (SELECT c_custkey AS k, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey), o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT c_name AS query_id, CASE k % 4 WHEN 0 THEN n_name WHEN 1 THEN '1' WHEN 2 THEN coalesce((SELECT arg_min(t, (entity_id, fact_no)) FROM facts f WHERE f.name = c_name AND f.key = 'order total'), '') ELSE n_name END AS names FROM c")
def answer_dispatch(spark, d):
    """Entities, counts, attributes, and a type that isn't supported."""
    from ..fixtures import table

    kb = kbs.load(spark, d)
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 4
    none = F.lit(None).cast("string")
    a = c.select(F.col("c_name").alias("query_id"), F.when(k == 0, "entity").when(k == 1, "count").when(k == 2, "attr").otherwise("verify").alias("answer_type"), F.col("c_name").alias("name"), F.lit("order total").alias("key"), none.alias("op"), none.alias("value"), none.alias("b"), none.alias("qkey"), none.alias("mode"))
    found = c.filter(k != 2).select(F.col("c_name").alias("query_id"), F.col("n_name").alias("name"))
    return S.answer_dispatch(a, found, kb, ["count", "attr"]).select("query_id", F.array_join("names", "|").alias("names"))


@query(KB_SQL + "SELECT c.concept_id AS entity_id, 'listed as' AS predicate, 'backward' AS direction, 'P' || p_partkey AS object FROM part JOIN concepts c ON c.concept_id = 'B:' || p_brand")
def concept_reverse_relations(spark, d):
    """Parts are `listed as` their brand, a concept; other relations end at entities."""
    from ..fixtures import table

    kb = kbs.load(spark, d)
    p = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("entity_id"), F.lit("1").alias("fact_no"), F.lit("listed as").alias("predicate"), F.lit("forward").alias("direction"), F.concat(F.lit("B:"), "p_brand").alias("object"))
    return build.concept_reverse_relations(kb.rels.unionByName(p), kb.concepts).select("entity_id", "predicate", "direction", "object")


NAME_SQL = r"""
WITH p AS (SELECT page_id, url, page_id % 4 AS k, 'CD4+ [T] cell ' || page_id || '%' AS plain, regexp_replace(regexp_replace(url, '^https?://[^ ]*/', ''), '[\\[\\]<>]+$', '') AS tail FROM pages WHERE url IS NOT NULL)
SELECT page_id, lower(regexp_replace(url, '[ _-]', '', 'g')) AS key, page_id % 2 = 0 AS cjk,
       CASE k WHEN 0 THEN plain WHEN 1 THEN CASE WHEN regexp_matches(url, '^https?://[^ ]*/') THEN tail ELSE url END
              WHEN 2 THEN 'IL-2 (α)+%zz [x] ' || page_id ELSE 'a+b c' || page_id END AS n
FROM p
"""


@query(NAME_SQL)
def name_functions(spark, d):
    """normalise_key, clean_name and has_cjk over all page URLs; names with plus signs, percent codes and inner brackets made from them."""
    from ..fixtures import table

    p, k, i = table(spark, d, "pages").filter("url is not null"), F.col("page_id") % 4, F.col("page_id").cast("string")
    marked = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("癌"))).otherwise(F.col("url"))
    raw = (
        F.when(k == 0, F.concat(F.lit("[CD4+ [T] cell "), i, F.lit("%]")))
        .when(k == 1, F.concat(F.lit("["), F.regexp_replace("url", "%", "%25"), F.lit("]")))
        .when(k == 2, F.concat(F.lit("<https://x.org/vocab/IL-2%20(%CE%B1)%2B%zz%20[x]%20"), i, F.lit(">")))
        .otherwise(F.concat(F.lit("[http://x.org/y/a+b%20c"), i, F.lit("]")))
    )
    return p.select("page_id", T.normalise_key(F.col("url")).alias("key"), T.clean_name(raw).alias("n"), T.has_cjk(marked).alias("cjk"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Order#' || o_orderkey ELSE o_orderpriority END AS entity, CAST(sign(o_totalprice - 20000) AS INT) AS by_number, CAST(CASE WHEN CAST(o_orderdate AS DATE) < DATE '1996-03-01' THEN -1 WHEN CAST(o_orderdate AS DATE) > DATE '1996-03-01' THEN 1 ELSE 0 END AS INT) AS by_date, CASE WHEN o_orderpriority < '3' THEN -1 WHEN o_orderpriority > '3' THEN 1 ELSE 0 END AS by_text FROM orders")
def compare_functions(spark, d):
    """bracket_entity, and compare_text by number, date and text."""
    from ..fixtures import table

    o = table(spark, d, "orders")
    q = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("who has [Order#"), "o_orderkey", F.lit("] and [x]?"))).otherwise("who?")
    return o.select(F.col("o_orderkey").alias("id"), T.bracket_entity(q, F.col("o_orderpriority")).alias("entity"), T.compare_text(F.col("o_totalprice").cast("string"), F.lit("20000")).alias("by_number"), T.compare_text(F.to_date("o_orderdate").cast("string"), F.lit("1996-03-01")).alias("by_date"), T.compare_text(F.col("o_orderpriority"), F.lit("3")).alias("by_text"))
