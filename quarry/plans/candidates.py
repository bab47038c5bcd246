"""Candidate paths for plans: expansion, assembly and repair of type paths against the schema, and budgeted views of it.

All take tables of plans and the schema edges (src_type, rel, tgt_type, freq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import union
from ..operators.hops import first_tier, top_k
from ..session import write_table
from .schema_paths import both_ways, first_ways, type_paths

STRINGS = "array<string>"


def enumerate_type_paths(starts: DataFrame, schema: DataFrame, most_hops: int = 3) -> DataFrame:
    """starts: start, target (null: any). start, types, rels of all paths along edge direction that meet no type twice."""
    p = type_paths(schema, most_hops).filter("src <> dst")
    return p.join(starts, p["src"] == starts["start"]).filter("target is null or target = dst").select("start", "types", "rels")


def _assembled(steps: DataFrame, keys: list[str]) -> DataFrame:
    """steps: keys, step (from 0), rel. keys, rels: every choice of a relation for each step; nothing where a step has none."""
    steps = write_table(steps, "steps")
    longest = steps.select(F.max("step")).first()[0]
    n = steps.groupBy(*keys).agg(F.max("step").alias("_last"), F.countDistinct("step").alias("_n")).filter("_n = _last + 1")
    d = steps.filter("step = 0").select(*keys, F.array("rel").alias("rels")).join(n, keys).drop("_n")
    done = [d.filter("_last = 0")]
    for i in range(1, (longest or 0) + 1):
        d = d.filter(F.col("_last") >= i).join(steps.filter(F.col("step") == i).select(*keys, "rel").hint("merge"), keys).withColumn("rels", F.array_append("rels", F.col("rel"))).drop("rel")
        done.append(d.filter(F.col("_last") == i))
    return union(done).drop("_last")


def chain_candidates(transitions: DataFrame, schema: DataFrame, most: int = 100) -> DataFrame:
    """transitions: query_id, step (from 0), src, tgt, hint. query_id, rels: all choices; a step without a relation in the schema takes the hint. First `most` by name."""
    opts = transitions.join(both_ways(schema).select(F.col("a").alias("src"), F.col("b").alias("tgt"), "rel").distinct().hint("merge"), ["src", "tgt"], "left")
    got = _assembled(opts.select("query_id", "step", F.coalesce("rel", "hint").alias("rel")).distinct(), ["query_id"])
    return top_k(got.select("query_id", F.array_join("rels", "|").alias("rels")), ["query_id"], ["rels"], most)


def intersection_candidates(transitions: DataFrame, schema: DataFrame, most: int = 100) -> DataFrame:
    """transitions also: branch (from 0). Choices of each branch, and of all branches together: query_id, rels (of all, in the order of branches)."""
    opts = transitions.join(both_ways(schema).select(F.col("a").alias("src"), F.col("b").alias("tgt"), "rel").distinct().hint("merge"), ["src", "tgt"], "left")
    one = _assembled(opts.select("query_id", "branch", "step", F.coalesce("rel", "hint").alias("rel")).distinct(), ["query_id", "branch"])
    got = _assembled(one.select("query_id", F.col("branch").alias("step"), F.array_join("rels", "|").alias("rel")), ["query_id"])
    return top_k(got.select("query_id", F.array_join("rels", "|").alias("rels")), ["query_id"], ["rels"], most)


def detours(schema: DataFrame) -> DataFrame:
    """src, dst, types: the first shortest way between two types, of any length, by name; of a type to itself a way over another one."""
    step = both_ways(schema).filter("a <> b").select("a", "b").distinct()
    back = step.groupBy(F.col("a").alias("src")).agg(F.min("b").alias("mid")).select("src", F.col("src").alias("dst"), F.array("src", "mid", "src").alias("types"))
    return first_ways(schema).unionByName(back)


def expand_type_path(paths: DataFrame, schema: DataFrame) -> DataFrame:
    """paths: query_id, types, hints. Neighbours without a relation are joined up by the first shortest way; the hint goes to its last step."""
    direct = both_ways(schema).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct().withColumn("direct", F.lit(True))
    pairs = paths.select("query_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("types") - 2), lambda i: F.struct(F.get("types", i).alias("src"), F.get("types", i + 1).alias("dst"), F.get("hints", i).alias("hint")))).alias("pos", "p")).select("query_id", "pos", "p.*")
    d = pairs.join(direct.hint("merge"), ["src", "dst"], "left").join(detours(schema).hint("merge"), ["src", "dst"], "left")
    more = F.when(F.col("direct").isNull() & F.col("types").isNotNull(), F.slice("types", 2, F.size("types"))).otherwise(F.array("dst"))
    d = d.select("query_id", "pos", "src", more.alias("more"), "hint")
    hints = F.concat(F.array_repeat(F.lit(None).cast("string"), F.size("more") - 1), F.array("hint"))
    g = d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "src", "more", hints.alias("hints")))).alias("s"))
    return g.select("query_id", F.concat(F.array(F.get("s", F.lit(0))["src"]), F.flatten(F.transform("s", lambda x: x["more"]))).alias("types"), F.flatten(F.transform("s", lambda x: x["hints"])).alias("hints"))


def kg_type_paths(pairs: DataFrame, schema: DataFrame) -> DataFrame:
    """pairs: src, dst. src, dst, types, rels: every direct relation, else a way over each middle type with the first relation of either side."""
    step = both_ways(schema).select("a", "rel", "b").distinct()
    direct = pairs.join(step.select(F.col("a").alias("src"), F.col("b").alias("dst"), "rel").hint("merge"), ["src", "dst"]).select("src", "dst", F.array("src", "dst").alias("types"), F.array("rel").alias("rels"))
    first = step.groupBy("a", "b").agg(F.min("rel").alias("rel"))
    rest = pairs.join(direct.select("src", "dst").distinct().hint("merge"), ["src", "dst"], "left_anti")
    via = rest.join(first.select(F.col("a").alias("src"), F.col("b").alias("mid"), F.col("rel").alias("r1")).hint("merge"), "src").join(first.select(F.col("a").alias("mid"), F.col("b").alias("dst"), F.col("rel").alias("r2")).hint("merge"), ["mid", "dst"])
    via = via.filter("not (mid = src and mid = dst)")
    return direct.unionByName(via.select("src", "dst", F.array("src", "mid", "dst").alias("types"), F.array("r1", "r2").alias("rels")))


def stepwise_candidates(paths: DataFrame, schema: DataFrame, scores: DataFrame | None = None, prune_above: int = 15, k: int = 5) -> DataFrame:
    """paths: query_id, types, hints. query_id, types, rels: expanded, then every choice of relations; none if a step has none, no duplicates.

    scores: hint, rel, score. A step with a hint and more than prune_above relations keeps
    the k best for the hint, or the relation equal to it alone.
    """
    x = write_table(expand_type_path(paths, schema), "expanded")
    steps = x.select("query_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("types") - 2), lambda i: F.struct(F.get("types", i).alias("a"), F.get("types", i + 1).alias("b"), F.get("hints", i).alias("hint")))).alias("step", "p")).select("query_id", "step", "p.*")
    opts = steps.join(both_ways(schema).select("a", "b", "rel").distinct().hint("merge"), ["a", "b"]).select("query_id", "step", "hint", "rel")
    if scores is not None:
        w = Window.partitionBy("query_id", "step")
        d = opts.withColumn("_n", F.count("*").over(w)).join(scores.hint("merge"), ["hint", "rel"], "left")
        same = F.lower("rel") == F.lower("hint")
        d = d.withColumns({"_same": F.coalesce(F.max(same).over(w), F.lit(False)), "_rank": F.row_number().over(w.orderBy(F.desc_nulls_last("score"), "rel"))})
        keep = (F.col("_n") <= prune_above) | F.col("hint").isNull() | F.when(F.col("_same"), same).otherwise(F.col("_rank") <= k)
        opts = d.filter(keep).select("query_id", "step", "hint", "rel")
    whole = x.select("query_id", "types").join(opts.groupBy("query_id").agg(F.countDistinct("step").alias("_n")), "query_id").filter("_n = size(types) - 1").drop("_n")
    return _assembled(opts.select("query_id", "step", "rel"), ["query_id"]).join(whole.hint("merge"), "query_id").select("query_id", "types", "rels").distinct()


def reorient_plan(plans: DataFrame) -> DataFrame:
    """plans: query_id, hops (array of struct src, tgt), labels (of the anchor). Adds swaps; hops are turned so that the first starts at a label and each goes on where the one before ends, up to the first break."""
    hop = "struct<src:string,tgt:string>"
    folded = F.expr(
        f"""aggregate(hops, named_struct('prev', cast(null as string), 'done', false, 'swaps', 0, 'out', cast(array() as array<{hop}>)), (a, x) ->
          case when a.done then named_struct('prev', a.prev, 'done', true, 'swaps', a.swaps, 'out', array_append(a.out, named_struct('src', x.src, 'tgt', x.tgt)))
               when if(size(a.out) = 0, array_contains(labels, x.src), x.src = a.prev) then named_struct('prev', x.tgt, 'done', false, 'swaps', a.swaps, 'out', array_append(a.out, named_struct('src', x.src, 'tgt', x.tgt)))
               when if(size(a.out) = 0, array_contains(labels, x.tgt), x.tgt = a.prev) then named_struct('prev', x.src, 'done', false, 'swaps', a.swaps + 1, 'out', array_append(a.out, named_struct('src', x.tgt, 'tgt', x.src)))
               else named_struct('prev', a.prev, 'done', true, 'swaps', a.swaps, 'out', array_append(a.out, named_struct('src', x.src, 'tgt', x.tgt))) end)"""
    )
    return plans.withColumn("_f", folded).withColumns({"hops": F.col("_f.out"), "swaps": F.col("_f.swaps")}).drop("_f")


def diagnose_plan(pairs: DataFrame, schema: DataFrame) -> DataFrame:
    """pairs: id, src, tgt. id, text: OK with the number of relations, or NO EDGES with up to five neighbour types of either side."""
    both = both_ways(schema)
    n = both.groupBy(F.col("a").alias("src"), F.col("b").alias("tgt")).agg(F.countDistinct("rel", "dir").alias("n"))
    near = both.groupBy("a").agg(F.array_join(F.slice(F.array_sort(F.collect_set("b")), 1, 5), ", ").alias("near"))
    d = pairs.join(n.hint("merge"), ["src", "tgt"], "left")
    for x, word in (("src", "connects to"), ("tgt", "reached from")):
        d = d.join(near.select(F.col("a").alias(x), F.col("near").alias("_near")).hint("merge"), x, "left")
        d = d.withColumn(f"_{x}", F.concat(F.lit(" ["), x, F.when(F.col("_near").isNull(), " not in schema").otherwise(F.concat(F.lit(f" {word}: "), "_near")), F.lit("]"))).drop("_near")
    head = F.concat(F.lit("("), "src", F.lit(")->("), "tgt", F.lit("): "))
    return d.select("id", F.when(F.col("n") > 0, F.concat(head, F.lit("OK ("), F.col("n").cast("string"), F.lit(" relations)"))).otherwise(F.concat(head, F.lit("NO EDGES"), "_src", "_tgt")).alias("text"))


def normalise_types(names: DataFrame, types: DataFrame, aliases: DataFrame) -> DataFrame:
    """names: id, name; types: type; aliases: alias, meant (lower case). id, type: the type of that name, case-folded, by its alias, or by what has it as an alias; null if none."""
    n = names.select("id", F.regexp_replace(F.trim("name"), r"[}\],]+$", "").alias("n"))
    low = types.select(F.lower("type").alias("low"), "type").groupBy("low").agg(F.max("type").alias("type"))
    exact = n.join(types, n["n"] == types["type"]).select("id", "type")
    folded = n.join(low, F.lower("n") == F.col("low")).select("id", "type")
    by = n.join(aliases, F.lower("n") == F.col("alias")).join(low, F.col("meant") == F.col("low")).select("id", "type")
    back = n.join(aliases, F.lower("n") == F.col("meant")).join(low, F.col("alias") == F.col("low")).groupBy("id").agg(F.min_by("type", "alias").alias("type"))
    got = first_tier([x.withColumnRenamed("id", "query_id") for x in (exact, folded, by, back)], ["query_id"]).select(F.col("query_id").alias("id"), "type").distinct()
    return names.select("id").join(got.hint("merge"), "id", "left")


def filter_by_type_schema(options: DataFrame, wanted: DataFrame, transitions: DataFrame) -> DataFrame:
    """options: query_id, src_type, rel; wanted: query_id, type; transitions: rel, src_type, targets. Relations that lead to a wanted type, case-folded; all of a query, if none does."""
    t = transitions.select("rel", "src_type", F.explode("targets").alias("type"))
    ok = options.join(t.hint("merge"), ["rel", "src_type"]).withColumn("low", F.lower("type")).join(wanted.select("query_id", F.lower("type").alias("low")).distinct().hint("merge"), ["query_id", "low"])
    return first_tier([ok.select(*options.columns).distinct(), options], ["query_id"]).drop("tier")


def local_schema_budget(local: DataFrame, scores: DataFrame | None = None, most: int = 100) -> DataFrame:
    """local: query_id, src, rel, tgt, is_1hop, freq; scores: query_id, rel, score (to the question). query_id, src, rel, tgt, freq, pos.

    Edges once each, one-hop ones first, by falling frequency. Beyond `most`, the first half
    stays by frequency and the rest goes to the most similar of the others; without scores
    the first `most` stay.
    """
    key = ["query_id", "src", "rel", "tgt"]
    d = local.groupBy(*key).agg(F.max(F.col("is_1hop").cast("int")).alias("near"), F.max(F.when(F.col("is_1hop"), F.col("freq"))).alias("f1"), F.max("freq").alias("freq"))
    w = Window.partitionBy("query_id")
    order = [F.desc("near"), F.desc(F.coalesce("f1", "freq")), "src", "rel", "tgt"]
    d = d.withColumns({"pos": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    if scores is None:
        return d.filter(F.col("pos") <= most).select(*key, "freq", "pos")
    d = d.join(scores.hint("merge"), ["query_id", "rel"], "left")
    rest = F.row_number().over(Window.partitionBy("query_id", F.col("pos") > most // 2).orderBy(F.desc_nulls_last("score"), "pos"))
    d = d.withColumn("_rest", rest)
    keep = (F.col("_n") <= most) | (F.col("pos") <= most // 2) | (F.col("_rest") <= most - most // 2)
    place = F.when((F.col("_n") <= most) | (F.col("pos") <= most // 2), F.col("pos")).otherwise(most // 2 + F.col("_rest"))
    return d.filter(keep).select(*key, "freq", place.cast("int").alias("pos"))


def schema_relevance_list(schema: DataFrame, scores: DataFrame, phrases: DataFrame, most: int = 50) -> DataFrame:
    """schema: forward edges with freq; scores: query_id, rel, score; phrases: rel, noun. query_id, rank, line: the most relevant edges, readable."""
    d = schema.join(scores.hint("merge"), "rel").join(phrases.select("rel", "noun").hint("merge"), "rel")
    d = top_k(d, ["query_id"], [F.desc("score"), "src_type", "rel", "tgt_type"], most, "rank")
    return d.select("query_id", "rank", F.concat(F.lit("("), "src_type", F.lit(")-["), "rel", F.lit(" ("), "noun", F.lit(")]->("), "tgt_type", F.lit(") x"), F.col("freq").cast("string")).alias("line"))


def match_schema_edges(near: DataFrame, schema_dist: DataFrame, delta: int = 1, best: int = 5) -> DataFrame:
    """near: query_id, edge_no (from 0), src_type, rel, tgt_type, dist: the nearest schema edges of each pseudo edge; schema_dist: a, b, dist between types (-1: none).

    query_id, edges (array of struct src_type, rel, tgt_type), distance, rank: one edge for each,
    in order, where each starts at most delta from where the one before ends; the best.
    """
    edge = F.struct("src_type", "rel", "tgt_type")
    last = near.select(F.max("edge_no")).first()[0] or 0
    n = near.groupBy("query_id").agg(F.max("edge_no").alias("last"))
    d = near.filter("edge_no = 0").join(n, "query_id").select("query_id", "last", F.col("tgt_type").alias("at"), F.array(edge).alias("edges"), F.col("dist").alias("distance"))
    done = [d.filter("last = 0")]
    close = schema_dist.filter((F.col("dist") >= 0) & (F.col("dist") <= delta)).select(F.col("a").alias("at"), F.col("b").alias("src_type"))
    for i in range(1, last + 1):
        nxt = near.filter(F.col("edge_no") == i).select("query_id", "src_type", "rel", "tgt_type", "dist")
        d = d.filter(F.col("last") >= i).join(close.hint("merge"), "at").join(nxt.hint("merge"), ["query_id", "src_type"])
        d = d.select("query_id", "last", F.col("tgt_type").alias("at"), F.array_append("edges", edge).alias("edges"), (F.col("distance") + F.col("dist")).alias("distance"))
        done.append(d.filter(F.col("last") == i))
    return top_k(union(done).select("query_id", "edges", "distance"), ["query_id"], ["distance", F.to_json("edges")], best, "rank")
