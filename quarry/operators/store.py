"""The property store: facts asked for by entity name and roughly written key, a table of asks at a time.

Where a name has several entities, all count, in the order of their ids; where a fact
comes more than once, the first is taken. Entities win over concepts of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_key
from ..kb import KB
from ..model import comparable, compare, order_of, text_of, value
from .hops import first_tier, top_k
from .traverse import relation_between

#: fixed values: words for the greater and the lesser of a selection
GREATER = ["greater", "larger", "more", "later", "latest", "longest", "higher"]
LESS = ["less", "smaller", "fewer", "earlier", "earliest", "shortest", "smallest", "lower"]


def name_index(kb: KB) -> DataFrame:
    """name (case-folded), id: of entities, and of concepts whose name no entity has."""
    e = kb.entities.select(F.lower("name").alias("name"), F.col("entity_id").alias("id"))
    c = kb.concepts.select(F.lower("name").alias("name"), F.col("concept_id").alias("id"))
    return e.unionByName(c.join(e.select("name").distinct().hint("merge"), "name", "left_anti"))


def known_keys(kb: KB) -> DataFrame:
    """key, vtype: attribute and qualifier keys with their value type (year counts as date), and predicates (no type)."""
    typed = [d.select(F.col(k).alias("key"), F.col("v.vtype").alias("vtype")) for d, k in ((kb.attrs, "key"), (kb.attr_quals, "qkey"), (kb.rel_quals, "qkey"))]
    d = typed[0].unionByName(typed[1]).unionByName(typed[2]).unionByName(kb.rels.select(F.col("predicate").alias("key"), F.lit(None).cast("string").alias("vtype")))
    return d.groupBy("key").agg(F.max(F.when(F.col("vtype") == "year", "date").otherwise(F.col("vtype"))).alias("vtype"))


def resolve_key(asks: DataFrame, keys: DataFrame, column: str = "key") -> DataFrame:
    """asks with `column` replaced by the known key it means: itself, else one that is equal without case, blanks, _ and -; unknown keys stay. Adds vtype."""
    wanted = asks.select(F.col(column).alias("asked")).distinct()
    exact = wanted.join(keys.select(F.col("key").alias("asked"), F.col("key").alias("known"), "vtype"), "asked")
    rough = wanted.join(keys.select(normalise_key(F.col("key")).alias("rough"), F.col("key").alias("known"), "vtype"), normalise_key(F.col("asked")) == F.col("rough")).drop("rough")
    best = top_k(first_tier([exact, rough], ["asked"]), ["asked"], ["known"], 1).drop("tier")
    d = asks.drop("vtype").join(best.hint("merge"), asks[column] == best["asked"], "left").drop("asked")
    return d.withColumn(column, F.coalesce("known", column)).drop("known")


def _facts(asks: DataFrame, kb: KB) -> DataFrame:
    """asks (query_id, name, key and others) with entity_id, fact_no, v of all facts of the name and key."""
    d = resolve_key(asks, known_keys(kb)).join(name_index(kb).select(F.col("name").alias("_low"), F.col("id").alias("entity_id")).hint("merge"), F.lower("name") == F.col("_low")).drop("_low")
    return d.join(kb.attrs.select("entity_id", "fact_no", "key", "v").hint("merge"), ["entity_id", "key"])


def _first() -> Column:
    return F.struct("entity_id", "fact_no")


def query_attr(asks: DataFrame, kb: KB) -> DataFrame:
    """asks: query_id, name, key. query_id, v: the first value."""
    return _facts(asks.select("query_id", "name", "key"), kb).groupBy("query_id").agg(F.min_by("v", _first()).alias("v"))


def parse_target(text: Column, vtype: Column) -> Column:
    """Target text by the key's type: four digits are a year, y-m-d a date, a number a quantity of unit 1; all else a string."""
    raw = F.trim(text)
    parts = F.split(raw, "-")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    day = F.try_make_timestamp(part(0), part(1), part(2), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return (
        F.when((vtype == "date") & raw.rlike("^[0-9]{4}$"), value("year", y=raw.try_cast("int")))
        .when((vtype == "date") & raw.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$") & day.isNotNull(), value("date", d=day))
        .when(vtype == "date", value("string", s=raw))
        .when((vtype == "quantity") & text.try_cast("double").isNotNull(), value("quantity", num=text.try_cast("double"), unit="1"))
        .otherwise(value("string", s=text))
    )


def filter_by_attr(asks: DataFrame, kb: KB) -> DataFrame:
    """asks: query_id, name, key, op, value. query_id, name of names of which any entity has a value that satisfies op; once each."""
    d = _facts(asks, kb).withColumn("target", parse_target(F.col("value"), F.col("vtype")))
    return d.filter(compare(F.col("v"), F.col("target"), F.col("op"))).select("query_id", "name").distinct()


def attr_qualifier(asks: DataFrame, kb: KB) -> DataFrame:
    """asks: query_id, name, key, value, qkey. query_id, v: first qualifier of the first fact whose value is the given one, or reads the same without case."""
    d = _facts(resolve_key(asks, known_keys(kb), "qkey").drop("vtype"), kb).withColumn("target", parse_target(F.col("value"), F.col("vtype")))
    d = d.filter(compare(F.col("v"), F.col("target"), "=") | (F.lower(text_of(F.col("v"))) == F.lower("value")))
    q = kb.attr_quals.select("entity_id", "fact_no", "qkey", "q_no", F.col("v").alias("qv"))
    return d.join(q.hint("merge"), ["entity_id", "fact_no", "qkey"]).groupBy("query_id").agg(F.min_by("qv", F.struct("entity_id", "fact_no", "q_no")).alias("v"))


def relation_qualifier(asks: DataFrame, kb: KB) -> DataFrame:
    """asks: query_id, a, b, predicate, qkey. query_id, v: first qualifier of a relation from a to b, else from b to a."""
    keys = known_keys(kb)
    d = resolve_key(resolve_key(asks, keys, "qkey"), keys, "predicate").drop("vtype")
    n = name_index(kb)
    r = kb.rels.select("entity_id", "fact_no", "predicate", "object")
    # names meet the facts, not the asks: the pairs of all entities of two names may be many more than the facts between them
    for x, end in (("from", "entity_id"), ("to", "object")):
        r = r.join(n.select(F.col("name").alias(x), F.col("id").alias(end)).hint("merge"), end)
    q = kb.rel_quals.select("entity_id", "fact_no", "qkey", "q_no", F.col("v").alias("qv"))

    def way(x: str, y: str) -> DataFrame:
        e = d.select("query_id", "predicate", "qkey", F.lower(x).alias("from"), F.lower(y).alias("to")).join(r.hint("merge"), ["from", "to", "predicate"])
        return e.join(q.hint("merge"), ["entity_id", "fact_no", "qkey"]).select("query_id", "entity_id", "fact_no", "q_no", "qv")

    got = first_tier([way("a", "b"), way("b", "a")], ["query_id"])
    return got.groupBy("query_id").agg(F.min_by("qv", F.struct("entity_id", "fact_no", "q_no")).alias("v"))


def available_properties(kb: KB, most: int = 30) -> DataFrame:
    """entity_id, key, preview, vtype: first value of each key, cut at 47 characters if longer than 50; at most `most` keys of an entity, by name."""
    g = kb.attrs.groupBy("entity_id", "key").agg(F.min_by("v", "fact_no").alias("v"))
    t = text_of(F.col("v"))
    d = g.select("entity_id", "key", F.when(F.char_length(t) > 50, F.concat(F.substring(t, 1, 47), F.lit("..."))).otherwise(t).alias("preview"), F.col("v.vtype").alias("vtype"))
    return top_k(d, ["entity_id"], ["key"], most)


def _answered(asks: DataFrame, got: DataFrame, missing: str = "") -> DataFrame:
    """query_id, answer of every ask."""
    return asks.select("query_id").distinct().join(got.select("query_id", "answer").hint("merge"), "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit(missing)))


def answer_attr(asks: DataFrame, kb: KB) -> DataFrame:
    """asks: query_id, name, key. The value as text; '' if there is none."""
    return _answered(asks, query_attr(asks, kb).select("query_id", text_of(F.col("v")).alias("answer")))


def answer_verify(asks: DataFrame, kb: KB) -> DataFrame:
    """asks: query_id, name, key, op, value. yes or no; values of another kind are compared as text, a missing one is no."""
    a = resolve_key(asks, known_keys(kb)).withColumn("target", parse_target(F.coalesce("value", F.lit("")), F.col("vtype")))
    d = a.join(query_attr(asks, kb).hint("merge"), "query_id")
    v, t = F.col("v"), F.col("target")
    same = F.lower(text_of(v)) == F.lower(F.coalesce("value", F.lit("")))
    ok = F.when(F.coalesce(comparable(v, t), F.lit(False)), compare(v, t, F.coalesce("op", F.lit("=")))).otherwise(same)
    return _answered(asks, d.select("query_id", F.when(ok, "yes").otherwise("no").alias("answer")), "no")


def _mode() -> Column:
    """The mode in lower case; without one, greater."""
    return F.lower(F.when(F.col("mode") != "", F.col("mode")).otherwise("greater"))


def select_between(asks: DataFrame, kb: KB) -> DataFrame:
    """asks: query_id, a, b, key, mode. The greater of two for a mode of GREATER, the lesser for any other; a tie goes to the first. '' without comparable values."""
    d = asks
    for x in "ab":
        d = d.join(query_attr(asks.select("query_id", F.col(x).alias("name"), "key"), kb).select("query_id", F.col("v").alias(f"v{x}")).hint("merge"), "query_id")
    va, vb = F.col("va"), F.col("vb")
    x, y = order_of(va), order_of(vb)
    first = F.when(_mode().isin(GREATER), x >= y).otherwise(x <= y)
    return _answered(asks, d.filter(comparable(va, vb)).select("query_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("answer")))


def select_among(asks: DataFrame, kb: KB) -> DataFrame:
    """asks: query_id, pos, name, key, mode. The best of a set, the first of ties; those not comparable with the first that has the key don't count. A mode of neither list takes the first."""
    one = asks.select(F.struct("query_id", "pos").alias("query_id"), "name", "key")
    d = asks.select("query_id", "pos", "name", "mode").join(query_attr(one, kb).select("query_id.query_id", "query_id.pos", "v").hint("merge"), ["query_id", "pos"])
    lead = d.groupBy("query_id").agg(F.min_by("v", "pos").alias("first"))
    d = d.join(lead.hint("merge"), "query_id").filter(comparable(F.col("v"), F.col("first")))
    low = _mode()
    by = F.when(low.isin(GREATER), -order_of(F.col("v"))).when(low.isin(LESS), order_of(F.col("v"))).otherwise(F.lit(0.0))
    return _answered(asks, d.groupBy("query_id").agg(F.min_by("name", F.struct(by.alias("by"), "pos")).alias("answer")))


def answer_qualifiers(asks: DataFrame, kb: KB) -> DataFrame:
    """asks: query_id, answer_type (attr_qualifier or relation_qualifier), name, key, value, b, qkey. '' where a needed field is missing or nothing is found."""
    full = lambda *c: F.least(*[F.coalesce(F.char_length(x) > 0, F.lit(False)) for x in c])
    a = asks.filter((F.col("answer_type") == "attr_qualifier") & full("name", "key", "value", "qkey"))
    r = asks.filter((F.col("answer_type") == "relation_qualifier") & full("name", "key", "b", "qkey")).select("query_id", F.col("name").alias("a"), "b", F.col("key").alias("predicate"), "qkey")
    got = attr_qualifier(a.select("query_id", "name", "key", "value", "qkey"), kb).unionByName(relation_qualifier(r, kb))
    return _answered(asks, got.select("query_id", text_of(F.col("v")).alias("answer")))


def answer_count(asks: DataFrame, answers: DataFrame) -> DataFrame:
    """Size of each ask's answer set (query_id, name)."""
    return _answered(asks, answers.groupBy("query_id").agg(F.count("*").cast("string").alias("answer")), "0")


def answer_relation(asks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """asks: query_id, a, b. The first relation between two names, readable; '' if none."""
    got = relation_between(asks.select("query_id", "a", "b"), nodes, edges)
    return _answered(asks, got.groupBy("query_id").agg(F.min_by("phrase", "rel").alias("answer")))


def answer_dispatch(asks: DataFrame, answers: DataFrame, kb: KB, supported: list[str]) -> DataFrame:
    """asks: query_id, answer_type, name, key, op, value, b, qkey, mode; answers: query_id, name (the entities found).

    query_id, names: the entities, or, where the answer type is another one that the graph
    supports, that answer alone. Attribute, verify and qualifier asks are put to the first
    entity found, else to the given name.
    """
    found = answers.groupBy("query_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    d = asks.join(found.hint("merge"), "query_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    d = d.withColumn("name", F.coalesce(F.get("names", F.lit(0)), "name"))
    of = lambda *kinds: d.filter(F.col("answer_type").isin([k for k in kinds if k in supported]))
    parts = [
        answer_attr(of("attr").select("query_id", "name", "key"), kb),
        answer_verify(of("verify").select("query_id", "name", "key", "op", "value"), kb),
        select_among(of("select").select("query_id", F.posexplode("names").alias("pos", "name"), "key", "mode"), kb),
        answer_qualifiers(of("attr_qualifier", "relation_qualifier"), kb),
        answer_count(of("count"), answers),
    ]
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    out = d.join(got.hint("merge"), "query_id", "left")
    return out.select("query_id", F.when(F.col("answer").isNotNull(), F.array("answer")).otherwise(F.col("names")).alias("names"))
