"""Queries of the algebra functions and the property-store forms on the derived knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kb as kbs
from ..kb import KB_SQL
from ..model import compare, parse_value, text_of
from ..operators import algebra as A
from . import registry

QUERIES, ORACLES, query = registry()

ARGS = "program_id string, a1 string, a2 string, a3 string"


def programs(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], ARGS)


def per_name(names: DataFrame, *more: str | None) -> DataFrame:
    """One program for each name: program_id and a1 are the name."""
    rest = [F.lit(m).cast("string") for m in (*more, None, None)][:2]
    return names.select(F.col("name").alias("program_id"), F.col("name").alias("a1"), rest[0].alias("a2"), rest[1].alias("a3")).distinct()


def reprogram(args: DataFrame, *values: str | None) -> DataFrame:
    """The same programs with other inputs."""
    v = [F.lit(x).cast("string") for x in (*values, None, None, None)][:3]
    return args.select("program_id", *[x.alias(f"a{i + 1}") for i, x in enumerate(v)])


def suppliers(kb) -> DataFrame:
    return per_name(kb.entities.filter(F.col("entity_id").startswith("S")))


def customers(kb) -> DataFrame:
    return per_name(kb.entities.filter(F.col("entity_id").startswith("C")))


def part_names(kb) -> DataFrame:
    return per_name(kb.entities.filter(F.col("entity_id").startswith("P")))


def valued(values: DataFrame) -> DataFrame:
    """Values as columns that compare alike in both engines."""
    v = F.col("v")
    return values.select("program_id", v["vtype"].alias("vtype"), v["s"].alias("s"), F.round(v["num"], 6).alias("num"), v["unit"].alias("unit"), v["y"].alias("y"), v["d"].cast("string").alias("d"))


def listed(sets: DataFrame) -> DataFrame:
    return sets.select("program_id", "entity_id", F.coalesce("fact_no", F.lit("")).alias("fact_no"))


@query(KB_SQL + "SELECT entity_id, name FROM entities")
def kb_entities(spark, d):
    return kbs.load(spark, d).entities


@query(KB_SQL + "SELECT entity_id, fact_no, key, vtype, s, num, unit, y, CAST(d AS VARCHAR) AS d FROM attrs")
def kb_attrs(spark, d):
    v = F.col("v")
    return kbs.load(spark, d).attrs.select("entity_id", "fact_no", "key", v["vtype"].alias("vtype"), v["s"].alias("s"), v["num"].alias("num"), v["unit"].alias("unit"), v["y"].alias("y"), v["d"].cast("string").alias("d"))


@query(KB_SQL + "SELECT child, parent FROM anc")
def concept_closure(spark, d):
    return A.concept_closure(kbs.load(spark, d))


@query(KB_SQL + "SELECT key, CASE arg_max(vtype, (entity_id, kind, fact_no, q)) WHEN 'year' THEN 'date' ELSE arg_max(vtype, (entity_id, kind, fact_no, q)) END AS vtype FROM (SELECT key, vtype, entity_id, 'attr' AS kind, fact_no, 0 AS q FROM attrs UNION ALL SELECT qkey, vtype, entity_id, 'attr', fact_no, 2 FROM attr_quals UNION ALL SELECT qkey, vtype, entity_id, 'rel', fact_no, 2 FROM rel_quals) GROUP BY key")
def kb_key_types(spark, d):
    return A.key_types(kbs.load(spark, d))


@query(KB_SQL + "SELECT 'all' AS program_id, entity_id FROM entities")
def alg_find_all(spark, d):
    return A.expanded(A.find_all(programs(spark, [("all",)])), kbs.load(spark, d)).select("program_id", "entity_id")


@query(KB_SQL + "SELECT name AS program_id, entity_id FROM entities WHERE entity_id LIKE 'P%' UNION ALL SELECT name, concept_id FROM concepts")
def alg_find(spark, d):
    kb = kbs.load(spark, d)
    return A.find(part_names(kb).unionByName(per_name(kb.concepts)).distinct(), kb).select("program_id", "entity_id")


@query(KB_SQL + "SELECT DISTINCT c.name AS program_id, e.entity_id FROM concepts c JOIN anc ON anc.parent = c.concept_id JOIN entities e ON e.entity_id = anc.child")
def alg_filter_concept(spark, d):
    kb = kbs.load(spark, d)
    a = per_name(kb.concepts)
    return A.filter_concept(A.find_all(a), a, kb).select("program_id", "entity_id")


@query(KB_SQL + "SELECT s AS program_id, entity_id, fact_no FROM attrs WHERE key = 'brand'")
def alg_filter_str(spark, d):
    kb = kbs.load(spark, d)
    names = per_name(kb.concepts.filter(F.col("concept_id").startswith("B:")))
    return listed(A.filter_attr(A.find_all(names), names.select("program_id", F.lit("brand").alias("a1"), F.col("a1").alias("a2"), "a3"), kb, "string"))


OPS = ("=", "!=", "<", ">")


@query(KB_SQL + "SELECT op AS program_id, entity_id, fact_no FROM attrs, (VALUES ('='), ('!='), ('<'), ('>')) t(op) WHERE key = 'size' AND CASE op WHEN '=' THEN num = 30 WHEN '!=' THEN num <> 30 WHEN '<' THEN num < 30 ELSE num > 30 END")
def alg_filter_num(spark, d):
    kb, a = kbs.load(spark, d), programs(spark, [(op, "size", "30 cm", op) for op in OPS])
    return listed(A.filter_attr(A.find_all(a), a, kb, "quantity"))


@query(KB_SQL + "SELECT key || op AS program_id, entity_id, fact_no FROM attrs, (VALUES ('='), ('!='), ('<'), ('>')) t(op) WHERE key IN ('order date', 'order year') AND CASE op WHEN '=' THEN coalesce(y, year(d)) = 1996 WHEN '!=' THEN coalesce(y, year(d)) <> 1996 WHEN '<' THEN coalesce(y, year(d)) < 1996 ELSE coalesce(y, year(d)) > 1996 END")
def alg_filter_year(spark, d):
    kb, a = kbs.load(spark, d), programs(spark, [(k + op, k, "1996", op) for op in OPS for k in ("order date", "order year")])
    return listed(A.filter_attr(A.find_all(a), a, kb, "year"))


@query(KB_SQL + "SELECT key || op AS program_id, entity_id, fact_no FROM attrs, (VALUES ('='), ('!='), ('<'), ('>')) t(op) WHERE key IN ('order date', 'order year') AND CASE op WHEN '=' THEN coalesce(d = DATE '1996-07-01', false) WHEN '!=' THEN coalesce(d <> DATE '1996-07-01', true) WHEN '<' THEN coalesce(d < DATE '1996-07-01', y < 1996) ELSE coalesce(d > DATE '1996-07-01', y > 1996) END")
def alg_filter_date(spark, d):
    kb, a = kbs.load(spark, d), programs(spark, [(k + op, k, "1996-07-01", op) for op in OPS for k in ("order date", "order year")])
    return listed(A.filter_attr(A.find_all(a), a, kb, "date"))


def big_totals(spark, kb) -> DataFrame:
    """Customers with the facts of their order totals over 1000 usd."""
    a = programs(spark, [("big", "order total", "1000 usd", ">")])
    return A.filter_attr(A.find_all(a), a, kb, "quantity")


BIG = "SELECT 'big' AS program_id, a.entity_id, a.fact_no FROM attrs a JOIN attr_quals q ON q.entity_id = a.entity_id AND q.fact_no = a.fact_no WHERE a.key = 'order total' AND a.num > 1000 AND "


@query(KB_SQL + BIG + "q.qkey = 'status' AND q.s = 'F'")
def alg_qfilter_str(spark, d):
    kb = kbs.load(spark, d)
    return listed(A.filter_qualifier(big_totals(spark, kb), programs(spark, [("big", "status", "F")]), kb, "string"))


@query(KB_SQL + BIG + "q.qkey = 'point in time' AND year(q.d) = 1996")
def alg_qfilter_year(spark, d):
    kb = kbs.load(spark, d)
    return listed(A.filter_qualifier(big_totals(spark, kb), programs(spark, [("big", "point in time", "1996", "=")]), kb, "year"))


@query(KB_SQL + BIG + "q.qkey = 'point in time' AND q.d < DATE '1996-07-01'")
def alg_qfilter_date(spark, d):
    kb = kbs.load(spark, d)
    return listed(A.filter_qualifier(big_totals(spark, kb), programs(spark, [("big", "point in time", "1996-07-01", "<")]), kb, "date"))


@query(KB_SQL + "SELECT e.name AS program_id, r.object AS entity_id, r.fact_no FROM entities e JOIN rels r ON r.entity_id = e.entity_id AND r.predicate = 'supplies' AND r.direction = 'forward' JOIN rel_quals q ON q.entity_id = r.entity_id AND q.fact_no = r.fact_no AND q.qkey = 'quantity' AND q.num > 30")
def alg_qfilter_num(spark, d):
    kb = kbs.load(spark, d)
    a = suppliers(kb)
    return listed(A.filter_qualifier(A.relate(A.find(a, kb), reprogram(a, "supplies", "forward"), kb), reprogram(a, "quantity", "30", ">"), kb, "quantity"))


@query(KB_SQL + "SELECT e.name AS program_id, r.object AS entity_id, r.fact_no FROM entities e JOIN rels r ON r.entity_id = e.entity_id AND r.predicate = 'supplies' AND r.direction = 'forward'")
def alg_relate(spark, d):
    kb = kbs.load(spark, d)
    a = suppliers(kb)
    return listed(A.relate(A.find(a, kb), reprogram(a, "supplies", "forward"), kb))


def brand_and_size(spark, kb) -> tuple[DataFrame, DataFrame]:
    names = per_name(kb.concepts.filter(F.col("concept_id").startswith("B:")))
    every = A.find_all(names)
    return A.filter_attr(every, names.select("program_id", F.lit("brand").alias("a1"), F.col("a1").alias("a2"), "a3"), kb, "string"), A.filter_attr(every, reprogram(names, "size", "20 cm", "<"), kb, "quantity")


BRAND_SIZE = ", b AS (SELECT s AS program_id, entity_id FROM attrs WHERE key = 'brand'), z AS (SELECT DISTINCT c.name AS program_id, a.entity_id FROM concepts c, attrs a WHERE c.concept_id LIKE 'B:%' AND a.key = 'size' AND a.num < 20) "


@query(KB_SQL + BRAND_SIZE + "SELECT * FROM b INTERSECT SELECT * FROM z")
def alg_and(spark, d):
    kb = kbs.load(spark, d)
    return A.both(*brand_and_size(spark, kb)).select("program_id", "entity_id")


@query(KB_SQL + BRAND_SIZE + "SELECT * FROM b UNION SELECT * FROM z")
def alg_or(spark, d):
    kb = kbs.load(spark, d)
    return A.either(*brand_and_size(spark, kb)).select("program_id", "entity_id")


@query(KB_SQL + "SELECT c.name AS program_id, n.name AS answer FROM entities c JOIN rels r ON r.entity_id = c.entity_id AND r.predicate = 'country' AND r.direction = 'forward' JOIN entities n ON n.entity_id = r.object")
def alg_what(spark, d):
    kb = kbs.load(spark, d)
    a = customers(kb)
    return A.what(A.relate(A.find(a, kb), reprogram(a, "country", "forward"), kb), kb)


@query(KB_SQL + "SELECT c.name AS program_id, count(a.key) AS n FROM entities c LEFT JOIN attrs a ON a.entity_id = c.entity_id AND a.key = 'order total' AND a.num > 1000 WHERE c.entity_id LIKE 'C%' GROUP BY c.name")
def alg_count(spark, d):
    kb = kbs.load(spark, d)
    a = customers(kb)
    return A.count(A.filter_attr(A.find(a, kb), reprogram(a, "order total", "1000 usd", ">"), kb, "quantity"), a)


@query(KB_SQL + ", p AS (SELECT name, min(entity_id) AS id FROM entities WHERE entity_id LIKE 'P%' GROUP BY name), z AS (SELECT name, id, num FROM p JOIN attrs ON entity_id = id AND key = 'size') SELECT x.name || '/' || y.name AS program_id, CASE WHEN x.num > y.num THEN x.name ELSE y.name END AS answer FROM z x JOIN z y ON x.name < y.name")
def alg_select_between(spark, d):
    kb = kbs.load(spark, d)
    p = part_names(kb).select(F.col("a1").alias("x")).distinct()
    a = p.join(p.withColumnRenamed("x", "y"), F.col("x") < F.col("y")).select(F.concat_ws("/", "x", "y").alias("program_id"), "x", "y")
    left, right = (A.find(a.select("program_id", F.col(c).alias("a1")), kb) for c in "xy")
    return A.select_between(left, right, a.select("program_id", F.lit("size").alias("a1"), F.lit("greater").alias("a2")), kb)


@query(KB_SQL + "SELECT t.m || ' ' || p.name AS program_id, p.name AS answer FROM (SELECT DISTINCT name FROM entities WHERE entity_id LIKE 'P%') p, (VALUES ('largest'), ('smallest')) t(m)")
def alg_select_among_names(spark, d):
    """Among the parts of one name: the answer is that name."""
    kb = kbs.load(spark, d)
    a = part_names(kb).select(F.explode(F.array(F.lit("largest"), F.lit("smallest"))).alias("a2"), "a1").select(F.concat_ws(" ", "a2", "a1").alias("program_id"), "a1", "a2")
    return A.select_among(A.find(a, kb), a.select("program_id", F.lit("size").alias("a1"), "a2"), kb)


@query(KB_SQL + ", z AS (SELECT b.s AS brand, e.name, e.entity_id, a.num FROM attrs b JOIN attrs a ON a.entity_id = b.entity_id AND a.key = 'retail price' JOIN entities e ON e.entity_id = b.entity_id WHERE b.key = 'brand') SELECT brand AS program_id, arg_max(name, (num, entity_id)) AS answer FROM z GROUP BY brand")
def alg_select_among(spark, d):
    kb = kbs.load(spark, d)
    brands, _ = brand_and_size(spark, kb)
    a = per_name(kb.concepts.filter(F.col("concept_id").startswith("B:")))
    return A.select_among(brands, reprogram(a, "retail price", "largest"), kb)


NULLS = "NULL::VARCHAR AS s, NULL::INT AS y, NULL::VARCHAR AS d"


@query(KB_SQL + f"SELECT e.name AS program_id, 'quantity' AS vtype, round(arg_max(num, fact_no), 6) AS num, 'usd' AS unit, {NULLS} FROM entities e JOIN attrs a ON a.entity_id = e.entity_id AND a.key = 'order total' GROUP BY e.name")
def alg_query_attr(spark, d):
    kb = kbs.load(spark, d)
    a = customers(kb)
    return valued(A.query_attr(A.find(a, kb), reprogram(a, "order total"), kb))


@query(KB_SQL + f"SELECT e.name AS program_id, 'quantity' AS vtype, round(arg_min(a.num, a.fact_no), 6) AS num, 'usd' AS unit, {NULLS} FROM entities e JOIN attrs a ON a.entity_id = e.entity_id AND a.key = 'order total' JOIN attr_quals q ON q.entity_id = a.entity_id AND q.fact_no = a.fact_no AND q.qkey = 'status' AND q.s = 'O' GROUP BY e.name")
def alg_query_attr_under_condition(spark, d):
    kb = kbs.load(spark, d)
    a = customers(kb)
    return valued(A.query_attr_under(A.find(a, kb), reprogram(a, "order total", "status", "O"), kb))


def first_orders(spark, kb, key: str) -> tuple[DataFrame, DataFrame]:
    a = per_name(kb.entities.filter(F.col("entity_id").startswith("O")))
    return a, A.query_attr(A.find(a, kb), reprogram(a, key), kb)


@query(KB_SQL + "SELECT e.name AS program_id, CASE WHEN a.s = '1-URGENT' THEN 'yes' ELSE 'no' END AS answer FROM entities e JOIN attrs a ON a.entity_id = e.entity_id AND a.key = 'priority'")
def alg_verify_str(spark, d):
    kb = kbs.load(spark, d)
    a, v = first_orders(spark, kb, "priority")
    return A.verify(v, reprogram(a, "1-URGENT"), "string")


@query(KB_SQL + "SELECT e.name AS program_id, CASE WHEN a.num > 1000 THEN 'yes' ELSE 'no' END AS answer FROM entities e JOIN attrs a ON a.entity_id = e.entity_id AND a.key = 'total'")
def alg_verify_num(spark, d):
    kb = kbs.load(spark, d)
    a, v = first_orders(spark, kb, "total")
    return A.verify(v, reprogram(a, "1000 usd", ">"), "quantity")


@query(KB_SQL + "SELECT e.name AS program_id, CASE WHEN year(a.d) = 1996 THEN 'yes' ELSE 'no' END AS answer FROM entities e JOIN attrs a ON a.entity_id = e.entity_id AND a.key = 'order date'")
def alg_verify_year(spark, d):
    kb = kbs.load(spark, d)
    a, v = first_orders(spark, kb, "order date")
    return A.verify(v, reprogram(a, "1996", "="), "year")


@query(KB_SQL + "SELECT e.name AS program_id, CASE WHEN a.y < 1996 THEN 'yes' ELSE 'no' END AS answer FROM entities e JOIN attrs a ON a.entity_id = e.entity_id AND a.key = 'order year'")
def alg_verify_date(spark, d):
    kb = kbs.load(spark, d)
    a, v = first_orders(spark, kb, "order year")
    return A.verify(v, reprogram(a, "1996-07-01", "<"), "date")


def country_pairs(kb) -> DataFrame:
    r = kb.rels.filter("predicate = 'country' and direction = 'forward'")
    x = r.join(kb.entities, "entity_id").select(F.col("name").alias("x"), "object").join(kb.entities.withColumnRenamed("entity_id", "object"), "object")
    return x.select(F.concat_ws("/", "x", "name").alias("program_id"), "x", F.col("name").alias("y"))


@query(KB_SQL + "SELECT c.name || '/' || n.name AS program_id, 'country' AS answer FROM rels r JOIN entities c ON c.entity_id = r.entity_id JOIN entities n ON n.entity_id = r.object WHERE r.predicate = 'country' AND r.direction = 'forward'")
def alg_query_relation(spark, d):
    kb = kbs.load(spark, d)
    p = country_pairs(kb)
    left, right = (A.find(p.select("program_id", F.col(c).alias("a1")), kb) for c in "xy")
    return A.query_relation(left, right, kb)


@query(KB_SQL + f"SELECT e.name AS program_id, 'date' AS vtype, NULL::DOUBLE AS num, NULL::VARCHAR AS unit, NULL::VARCHAR AS s, NULL::INT AS y, CAST(arg_min(q.d, a.fact_no) AS VARCHAR) AS d FROM entities e JOIN attrs a ON a.entity_id = e.entity_id AND a.key = 'order total' AND a.num > 0 JOIN attr_quals q ON q.entity_id = a.entity_id AND q.fact_no = a.fact_no AND q.qkey = 'point in time' WHERE a.num = (SELECT max(num) FROM attrs z WHERE z.entity_id = a.entity_id AND z.key = 'order total') GROUP BY e.name")
def alg_query_attr_qualifier(spark, d):
    """When was each customer's largest order?"""
    kb = kbs.load(spark, d)
    largest = kb.attrs.filter("key = 'order total'").groupBy("entity_id").agg(F.max("v.num").alias("m")).join(kb.entities, "entity_id")
    a = largest.select(F.col("name").alias("program_id"), F.lit("order total").alias("a1"), F.concat_ws(" ", F.col("m").cast("string"), F.lit("usd")).alias("a2"), F.lit("point in time").alias("a3"))
    return valued(A.query_attr_qualifier(A.find(customers(kb), kb), a, kb))


@query(KB_SQL + f", p AS (SELECT name, min(entity_id) AS id FROM entities WHERE entity_id LIKE 'P%' OR entity_id LIKE 'S%' GROUP BY name) SELECT s.name || '/' || p.name AS program_id, 'quantity' AS vtype, arg_min(q.num, r.fact_no) AS num, '1' AS unit, {NULLS} FROM rels r JOIN p s ON s.id = r.entity_id JOIN p ON p.id = r.object JOIN rel_quals q ON q.entity_id = r.entity_id AND q.fact_no = r.fact_no AND q.qkey = 'quantity' WHERE r.direction = 'forward' AND r.predicate = 'supplies' GROUP BY 1")
def alg_query_relation_qualifier(spark, d):
    kb = kbs.load(spark, d)
    s, p = suppliers(kb).select(F.col("a1").alias("x")), part_names(kb).select(F.col("a1").alias("y"))
    met = kb.rels.filter("predicate = 'supplies' and direction = 'forward'").select("entity_id", "object").distinct()
    pairs = met.join(kb.entities.withColumnRenamed("name", "x"), "entity_id").join(kb.entities.select(F.col("entity_id").alias("object"), F.col("name").alias("y")), "object").select("x", "y").distinct().join(s, "x", "left_semi").join(p, "y", "left_semi")
    a = pairs.select(F.concat_ws("/", "x", "y").alias("program_id"), "x", "y")
    left, right = (A.find(a.select("program_id", F.col(c).alias("a1")), kb, first=True) for c in "xy")
    return valued(A.query_relation_qualifier(left, right, a.select("program_id", F.lit("supplies").alias("a1"), F.lit("quantity").alias("a2")), kb))


def batch(kb) -> DataFrame:
    """Six programs for every customer: their country, how many large orders, whether the last was large, how many are open; one with a number that is none and one with a function that is none."""
    n = kb.entities.filter(F.col("entity_id").startswith("C")).select("name")
    lit = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x]).cast("array<string>")
    step = lambda no, fn, *x: F.struct(F.lit(no).alias("step_no"), F.lit(fn).alias("fn"), lit(*x).alias("inputs"))
    progs = {
        "country": [step(0, "Find", F.col("name")), step(1, "Relate", "country", "forward"), step(2, "What")],
        "large": [step(0, "Find", F.col("name")), step(1, "FilterNum", "order total", "1000 usd", ">"), step(2, "Count")],
        "last": [step(0, "Find", F.col("name")), step(1, "QueryAttr", "order total"), step(2, "VerifyNum", "1000 usd", ">")],
        "wrong": [step(0, "Find", F.col("name")), step(1, "FilterNum", "order total", "many", ">"), step(2, "Count")],
        "other": [step(0, "Find", F.col("name")), step(1, "Guess", "x")],
        "open": [step(0, "Find", F.col("name")), step(1, "FilterNum", "order total", "0 usd", ">"), step(2, "QFilterStr", "status", "O"), step(3, "Count")],
    }
    parts = F.array(*[F.struct(F.lit(k).alias("k"), x.alias("x")) for k, s in progs.items() for x in s])
    return n.select("name", F.explode(parts).alias("p")).select(F.concat_ws(":", "p.k", "name").alias("program_id"), "p.x.*")


@query(KB_SQL + """, c AS (SELECT * FROM entities WHERE entity_id LIKE 'C%'), t AS (SELECT * FROM attrs WHERE key = 'order total')
SELECT 'country:' || c.name AS program_id, 'ok' AS status, n.name AS answer FROM c JOIN rels r ON r.entity_id = c.entity_id AND r.direction = 'forward' JOIN entities n ON n.entity_id = r.object
UNION ALL SELECT 'wrong:' || name, 'bad_value', NULL FROM c UNION ALL SELECT 'other:' || name, 'unknown_function', NULL FROM c
UNION ALL SELECT 'large:' || c.name, 'ok', CAST(count(t.key) AS VARCHAR) FROM c LEFT JOIN t ON t.entity_id = c.entity_id AND t.num > 1000 GROUP BY c.name
UNION ALL SELECT 'last:' || c.name, CASE WHEN count(t.key) = 0 THEN 'empty' ELSE 'ok' END, CASE WHEN count(t.key) = 0 THEN NULL WHEN arg_max(t.num, t.fact_no) > 1000 THEN 'yes' ELSE 'no' END FROM c LEFT JOIN t ON t.entity_id = c.entity_id GROUP BY c.name
UNION ALL SELECT 'open:' || c.name, 'ok', CAST(count(q.qkey) AS VARCHAR) FROM c LEFT JOIN t ON t.entity_id = c.entity_id AND t.num > 0 LEFT JOIN attr_quals q ON q.entity_id = t.entity_id AND q.fact_no = t.fact_no AND q.qkey = 'status' AND q.s = 'O' GROUP BY c.name""")
def run_programs(spark, d):
    kb = kbs.load(spark, d)
    return A.run_programs(A.infer_deps(batch(kb)), kb)


@query()
def infer_deps(spark, d):
    return A.infer_deps(batch(kbs.load(spark, d))).select("program_id", "step_no", "fn", F.array_join(F.transform("deps", lambda x: x.cast("string")), ",").alias("deps"))


#: fixed inputs of the programs that use every function
KINDS_SQL = KB_SQL + """, t AS (SELECT * FROM attrs WHERE key = 'order total'), fq AS (SELECT f.entity_id, f.fact_no, f.num, q.qkey, q.s, q.d FROM t f JOIN attr_quals q ON q.entity_id = f.entity_id AND q.fact_no = f.fact_no),
brands AS (SELECT name AS b FROM concepts WHERE concept_id LIKE 'B:%'), pb AS (SELECT s AS b, entity_id FROM attrs WHERE key = 'brand'),
size AS (SELECT entity_id, num FROM attrs WHERE key = 'size'), price AS (SELECT entity_id, num FROM attrs WHERE key = 'retail price'),
seg AS (SELECT c.name AS m, a.child AS entity_id FROM concepts c JOIN anc a ON a.parent = c.concept_id WHERE c.concept_id LIKE 'M:%'),
ord AS (SELECT e.entity_id, e.name, p.s AS prio, y.y, d.d FROM entities e JOIN attrs p ON p.entity_id = e.entity_id AND p.key = 'priority' JOIN attrs y ON y.entity_id = e.entity_id AND y.key = 'order year' JOIN attrs d ON d.entity_id = e.entity_id AND d.key = 'order date'),
cust AS (SELECT entity_id, name FROM entities WHERE entity_id LIKE 'C%'), home AS (SELECT r.entity_id, n.name FROM rels r JOIN entities n ON n.entity_id = r.object WHERE r.predicate = 'country' AND r.direction = 'forward'),
sup AS (SELECT e.name AS a, p.name AS b, r.* FROM rels r JOIN entities e ON e.entity_id = r.entity_id JOIN entities p ON p.entity_id = r.object WHERE r.predicate = 'supplies' AND r.direction = 'forward'),
firsts AS (SELECT name, min(entity_id) AS entity_id FROM entities WHERE entity_id LIKE 'P%' GROUP BY name), sold AS (SELECT s.a, s.b, min(s.fact_no) AS fact_no FROM sup s JOIN firsts f ON f.entity_id = s.object GROUP BY 1, 2),
small AS (SELECT b.b, count(*) AS n FROM pb b JOIN size z USING (entity_id) WHERE z.num < 20 GROUP BY 1)
SELECT 'brand:' || b AS program_id, 'ok' AS status, CAST(count(entity_id) AS VARCHAR) AS answer FROM brands LEFT JOIN pb USING (b) GROUP BY b
UNION ALL SELECT 'small:' || b, 'ok', CAST(coalesce(n, 0) AS VARCHAR) FROM brands LEFT JOIN small USING (b)
UNION ALL SELECT 'under:' || b, 'ok', CAST(count(entity_id) AS VARCHAR) FROM brands LEFT JOIN (SELECT DISTINCT b, entity_id FROM pb) USING (b) GROUP BY b
UNION ALL SELECT 'either:' || b, 'ok', CAST((SELECT count(*) FROM entities) + 1 AS VARCHAR) FROM brands
UNION ALL SELECT 'priciest:' || b, 'ok', arg_max(name, (num, entity_id)) FROM pb JOIN price USING (entity_id) JOIN entities USING (entity_id) GROUP BY b
UNION ALL SELECT 'size:' || b, CASE WHEN x.num IS NULL THEN 'empty' ELSE 'ok' END, CASE WHEN x.num IS NULL THEN NULL ELSE CAST(CAST(x.num AS BIGINT) AS VARCHAR) || ' cm' END FROM (SELECT b, min(entity_id) AS entity_id FROM pb GROUP BY b) JOIN size x USING (entity_id)
UNION ALL SELECT 'segment:' || m, 'ok', CAST(count(f.fact_no) AS VARCHAR) FROM seg LEFT JOIN fq f ON f.entity_id = seg.entity_id AND f.num > 1000 AND f.qkey = 'point in time' AND year(f.d) = 1996 GROUP BY m
UNION ALL SELECT 'early:' || m, 'ok', CAST(count(f.fact_no) AS VARCHAR) FROM seg LEFT JOIN fq f ON f.entity_id = seg.entity_id AND f.num > 1000 AND f.qkey = 'point in time' AND f.d < DATE '1996-07-01' GROUP BY m
UNION ALL SELECT 'year:' || name, 'ok', CASE WHEN y = 1996 THEN 'yes' ELSE 'no' END FROM ord
UNION ALL SELECT 'date:' || name, 'ok', CASE WHEN d < DATE '1996-07-01' THEN 'yes' ELSE 'no' END FROM ord
UNION ALL SELECT 'prio:' || name, 'ok', CASE WHEN prio = '1-URGENT' THEN 'yes' ELSE 'no' END FROM ord
UNION ALL SELECT 'orders:1996', 'ok', CAST(count(*) AS VARCHAR) FROM ord WHERE y = 1996
UNION ALL SELECT 'orders:late', 'ok', CAST(count(*) AS VARCHAR) FROM ord WHERE d > DATE '1996-07-01'
UNION ALL SELECT 'rel:' || c.name, 'ok', 'country' FROM cust c JOIN home USING (entity_id)
UNION ALL SELECT 'open:' || c.name, CASE WHEN count(f.num) = 0 THEN 'empty' ELSE 'ok' END, CASE WHEN count(f.num) > 0 THEN CASE WHEN arg_min(f.num, f.fact_no) > 1000 THEN 'yes' ELSE 'no' END END FROM cust c LEFT JOIN fq f ON f.entity_id = c.entity_id AND f.qkey = 'status' AND f.s = 'O' GROUP BY c.name
UNION ALL SELECT 'sold:' || a || '/' || b, 'ok', CASE WHEN q.num = floor(q.num) THEN CAST(CAST(q.num AS BIGINT) AS VARCHAR) ELSE CAST(q.num AS VARCHAR) END FROM sold JOIN sup USING (a, b, fact_no) JOIN rel_quals q ON q.entity_id = sup.entity_id AND q.fact_no = sup.fact_no AND q.qkey = 'quantity'
UNION ALL SELECT 'bigger:' || b, 'ok', CASE WHEN x.num > y.num THEN x.name ELSE y.name END FROM (SELECT b, f.entity_id, e.name, num FROM (SELECT b, min(entity_id) AS entity_id FROM pb GROUP BY b) f JOIN entities e USING (entity_id) JOIN price USING (entity_id)) x, (SELECT e.name, num FROM entities e JOIN price USING (entity_id) WHERE e.entity_id = (SELECT min(entity_id) FROM pb)) y
UNION ALL SELECT 'many:' || e.name, 'ok', CAST(count(q.num) AS VARCHAR) FROM entities e LEFT JOIN sup s ON s.entity_id = e.entity_id LEFT JOIN rel_quals q ON q.entity_id = s.object AND q.fact_no = s.fact_no AND q.qkey = 'quantity' AND q.num > 30 WHERE e.entity_id LIKE 'S%' GROUP BY e.name
UNION ALL SELECT 'flag:' || e.name, 'ok', CAST(count(q.s) AS VARCHAR) FROM entities e LEFT JOIN sup s ON s.entity_id = e.entity_id LEFT JOIN rel_quals q ON q.entity_id = s.object AND q.fact_no = s.fact_no AND q.qkey = 'return flag' AND q.s = 'R' WHERE e.entity_id LIKE 'S%' GROUP BY e.name
UNION ALL SELECT 'when:' || c.name, 'ok', CAST(arg_min(f.d, f.fact_no) AS VARCHAR) FROM cust c JOIN fq f ON f.entity_id = c.entity_id AND f.qkey = 'point in time' AND f.num = (SELECT max(num) FROM t WHERE t.entity_id = c.entity_id) GROUP BY c.name
UNION ALL SELECT 'first:all', 'ok', (SELECT name FROM entities WHERE entity_id = (SELECT min(entity_id) FROM entities))
UNION ALL SELECT 'bad:dep', 'bad_dependency', NULL
"""


def every_function(kb) -> DataFrame:
    """Programs of all functions: for every brand, segment, order, customer and sale, and a few over all entities."""
    name = lambda prefix: kb.entities.filter(F.col("entity_id").startswith(prefix)).select("name").distinct()
    brands, segments = (kb.concepts.filter(F.col("concept_id").startswith(x)).select("name") for x in ("B:", "M:"))
    step = lambda no, fn, deps, *x: F.struct(F.lit(no).alias("step_no"), F.lit(fn).alias("fn"), F.array(*[F.lit(v) if isinstance(v, str) else v for v in x]).cast("array<string>").alias("inputs"), F.array(*map(F.lit, deps)).cast("array<int>").alias("deps"))
    own = F.col("name")
    of_brand = [step(0, "FindAll", []), step(1, "FilterStr", [0], "brand", own)]
    big = [step(0, "FindAll", []), step(1, "FilterConcept", [0], own), step(2, "FilterNum", [1], "order total", "1000 usd", ">")]
    first_brand = kb.attrs.filter("key = 'brand'").agg(F.min_by("v.s", "entity_id").alias("first"))

    def made(rows: DataFrame, kinds: dict[str, list]) -> DataFrame:
        parts = F.array(*[F.struct(F.lit(k).alias("k"), x.alias("x")) for k, s in kinds.items() for x in s])
        return rows.select("*", F.explode(parts).alias("p")).select(F.concat_ws(":", "p.k", "name").alias("program_id"), "p.x.*")

    spark = kb.entities.sparkSession
    home = kb.rels.filter("predicate = 'country' and direction = 'forward'").join(kb.entities, "entity_id").join(kb.entities.select(F.col("entity_id").alias("object"), F.col("name").alias("to")), "object").select("name", "to")
    sales = kb.rels.filter("predicate = 'supplies' and direction = 'forward'").join(kb.entities.withColumnRenamed("name", "a"), "entity_id").join(kb.entities.select(F.col("entity_id").alias("object"), F.col("name").alias("b")), "object")
    firsts = kb.entities.filter("entity_id like 'P%'").groupBy("name").agg(F.min("entity_id").alias("object"))
    sales = sales.join(firsts.select("object").hint("merge"), "object", "left_semi").select("a", "b", F.concat_ws("/", "a", "b").alias("name")).distinct()
    largest = kb.attrs.filter("key = 'order total'").groupBy("entity_id").agg(F.concat_ws(" ", F.max("v.num").cast("string"), F.lit("usd")).alias("most")).join(kb.entities, "entity_id").select("name", "most")
    one = spark.createDataFrame([("1996",), ("late",), ("all",), ("dep",)], "name string")
    union = [
        made(brands, {"brand": [*of_brand, step(2, "Count", [1])], "small": [*of_brand, step(2, "FilterNum", [0], "size", "20 cm", "<"), step(3, "And", [1, 2]), step(4, "Count", [3])], "under": [step(0, "FindAll", []), step(1, "FilterConcept", [0], own), step(2, "And", [0, 1]), step(3, "Count", [2])], "either": [step(0, "FindAll", []), step(1, "Find", [], own), step(2, "Or", [0, 1]), step(3, "Count", [2])], "priciest": [*of_brand, step(2, "SelectAmong", [1], "retail price", "largest")], "size": [*of_brand, step(2, "QueryAttr", [1], "size")]}),
        made(brands.crossJoin(F.broadcast(first_brand)), {"bigger": [*of_brand, step(2, "FindAll", []), step(3, "FilterStr", [2], "brand", F.col("first")), step(4, "SelectBetween", [1, 3], "retail price", "greater")]}).join(kb.attrs.filter("key = 'brand'").select(F.concat(F.lit("bigger:"), "v.s").alias("program_id")).distinct(), "program_id", "left_semi"),
        made(segments, {"segment": [*big, step(3, "QFilterYear", [2], "point in time", "1996", "="), step(4, "Count", [3])], "early": [*big, step(3, "QFilterDate", [2], "point in time", "1996-07-01", "<"), step(4, "Count", [3])]}),
        made(name("O"), {"year": [step(0, "Find", [], own), step(1, "QueryAttr", [0], "order year"), step(2, "VerifyYear", [1], "1996", "=")], "date": [step(0, "Find", [], own), step(1, "QueryAttr", [0], "order date"), step(2, "VerifyDate", [1], "1996-07-01", "<")], "prio": [step(0, "Find", [], own), step(1, "QueryAttr", [0], "priority"), step(2, "VerifyStr", [1], "1-URGENT", "=")]}),
        made(name("C"), {"open": [step(0, "Find", [], own), step(1, "QueryAttrUnderCondition", [0], "order total", "status", "O"), step(2, "VerifyNum", [1], "1000 usd", ">")]}),
        made(name("S"), {"many": [step(0, "Find", [], own), step(1, "Relate", [0], "supplies", "forward"), step(2, "QFilterNum", [1], "quantity", "30", ">"), step(3, "Count", [2])], "flag": [step(0, "Find", [], own), step(1, "Relate", [0], "supplies", "forward"), step(2, "QFilterStr", [1], "return flag", "R", "="), step(3, "Count", [2])]}),
        made(largest, {"when": [step(0, "Find", [], own), step(1, "QueryAttrQualifier", [0], "order total", F.col("most"), "point in time")]}),
        made(home, {"rel": [step(0, "Find", [], own), step(1, "Find", [], F.col("to")), step(2, "QueryRelation", [0, 1])]}),
        made(sales, {"sold": [step(0, "Find", [], F.col("a")), step(1, "Find", [], F.col("b")), step(2, "QueryRelationQualifier", [0, 1], "supplies", "quantity")]}),
        made(one.filter("name = '1996'"), {"orders": [step(0, "FindAll", []), step(1, "FilterYear", [0], "order year", "1996", "="), step(2, "Count", [1])]}),
        made(one.filter("name = 'late'"), {"orders": [step(0, "FindAll", []), step(1, "FilterDate", [0], "order date", "1996-07-01", ">"), step(2, "Count", [1])]}),
        made(one.filter("name = 'all'"), {"first": [step(0, "FindAll", []), step(1, "What", [0])]}),
        made(one.filter("name = 'dep'"), {"bad": [step(0, "FindAll", []), step(1, "What", [7])]}),
    ]
    out = union[0]
    for x in union[1:]:
        out = out.unionByName(x)
    return out


@query(KINDS_SQL)
def run_programs_of_all_functions(spark, d):
    kb = kbs.load(spark, d)
    return A.run_programs(every_function(kb), kb)
