"""Search over the schema graph: distances, shortest and enumerated type paths, relation assembly, plan scores."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hops import top_k
from ..session import write_table


def both_ways(schema: DataFrame) -> DataFrame:
    """a, rel, b, dir of each schema edge from both ends."""
    out = schema.select(F.col("src_type").alias("a"), "rel", F.col("tgt_type").alias("b"), F.lit("forward").alias("dir"))
    back = schema.filter("src_type <> tgt_type").select(F.col("tgt_type").alias("a"), "rel", F.col("src_type").alias("b"), F.lit("reverse").alias("dir"))
    return out.unionByName(back).distinct()


def type_distances(schema: DataFrame) -> DataFrame:
    """a, b, dist over the undirected type graph; -1 where b can't be reached."""
    step = write_table(both_ways(schema).select("a", "b").distinct(), "type_steps")
    types = step.select(F.col("a").alias("t")).unionByName(step.select(F.col("b").alias("t"))).distinct()
    seen = front = write_table(types.select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(0).alias("dist")), "type_dist")
    for n in itertools.count(1):
        more = front.select("a", F.col("b").alias("via")).join(step.select(F.col("a").alias("via"), "b"), "via").select("a", "b").distinct().join(seen, ["a", "b"], "left_anti")
        front = write_table(more.withColumn("dist", F.lit(n)), "type_dist")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    every = types.select(F.col("t").alias("a")).crossJoin(types.select(F.col("t").alias("b")))
    return every.join(seen, ["a", "b"], "left").select("a", "b", F.coalesce("dist", F.lit(-1)).alias("dist"))


def type_paths(schema: DataFrame, most_hops: int, directed: bool = True, shortest: bool = False) -> DataFrame:
    """src, dst, types, rels, hops: paths between types of up to most_hops hops; no inner type twice, the end may be the start. shortest: of each pair the shortest only."""
    step = schema.select(F.col("src_type").alias("a"), "rel", F.col("tgt_type").alias("b")).distinct() if directed else both_ways(schema).select("a", "rel", "b").distinct()
    front = step.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.array("a", "b").alias("types"), F.array("rel").alias("rels"))
    out = front
    for _ in range(most_hops - 1):
        go = front.filter("src <> dst").withColumnRenamed("dst", "a").join(step, "a").filter(~F.array_contains(F.slice("types", 2, 100), F.col("b")))
        front = go.select("src", F.col("b").alias("dst"), F.array_append("types", F.col("b")).alias("types"), F.array_append("rels", F.col("rel")).alias("rels"))
        out = out.unionByName(front)
    out = out.withColumn("hops", F.size("rels"))
    if shortest:
        least = out.groupBy("src", "dst").agg(F.min("hops").alias("hops"))
        out = out.join(least, ["src", "dst", "hops"])
    return out.select("src", "dst", "types", "rels", "hops")


def shortest_type_paths(schema: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """src, dst, types, rels, hops: all shortest ways between two types, of any length, against edge direction too; of a type to itself its relations to itself. pairs: src, dst (else all).

    Types are layered by their distance to the end; only steps into the next layer are taken,
    so nothing longer than a result is made.
    """
    step = write_table(both_ways(schema).select("a", "rel", "b").distinct(), "type_steps")
    dist = write_table(type_distances(schema).filter("dist >= 0"), "type_distances")
    loop = step.filter("a = b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct().withColumn("togo", F.lit(1))
    ends = dist.filter("dist > 0").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("dist").alias("togo")).unionByName(loop)
    if pairs is not None:
        ends = ends.join(pairs.select("src", "dst").distinct().hint("merge"), ["src", "dst"], "left_semi")
    none = F.array().cast("array<string>")
    front = write_table(ends.select("src", "dst", "togo", F.array("src").alias("types"), none.alias("rels"), F.col("src").alias("a")), "type_front")
    done = []
    while not front.isEmpty():
        go = front.join(step.hint("merge"), "a").join(dist.select(F.col("a").alias("b"), F.col("b").alias("dst"), "dist").hint("merge"), ["b", "dst"]).filter("dist = togo - 1")
        front = write_table(go.select("src", "dst", F.col("dist").alias("togo"), F.array_append("types", F.col("b")).alias("types"), F.array_append("rels", F.col("rel")).alias("rels"), F.col("b").alias("a")), "type_front")
        done.append(front.filter("togo = 0"))
        front = front.filter("togo > 0")
    out = done[0] if done else front
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("src", "dst", "types", "rels", F.size("rels").alias("hops"))


def first_ways(schema: DataFrame) -> DataFrame:
    """src, dst, types: of each two types the first shortest way by name, of any length. A way is a step and the first way from there, so one way a pair is kept."""
    step = write_table(both_ways(schema).filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("via")).distinct(), "type_steps")
    ways = front = write_table(step.select("src", F.col("via").alias("dst"), F.array("src", "via").alias("types")), "type_ways")
    while True:
        on = front.withColumnRenamed("src", "via")
        more = step.join(on.hint("merge"), "via").filter("src <> dst").select("src", "dst", F.concat(F.array("src"), "types").alias("types")).join(ways.select("src", "dst").hint("merge"), ["src", "dst"], "left_anti")
        front = write_table(more.groupBy("src", "dst").agg(F.min_by("types", F.array_join("types", "|")).alias("types")), "type_ways")
        if front.isEmpty():
            return ways
        ways = ways.unionByName(front)


def relation_paths(sequences: DataFrame, schema: DataFrame, most: int = 100) -> DataFrame:
    """sequences: seq_id, types. All choices of a relation for each neighbouring pair of types, first `most` by name; none if a pair has none."""
    step = both_ways(schema).select("a", "b", "rel").distinct()
    d = sequences.select("seq_id", "types", F.array().cast("array<string>").alias("rels"))
    longest = sequences.select(F.max(F.size("types"))).first()[0] or 0
    done = None
    for i in range(longest - 1):
        d = d.filter(F.size("types") > i + 1).join(step, (F.get("types", F.lit(i)) == F.col("a")) & (F.get("types", F.lit(i + 1)) == F.col("b"))).select("seq_id", "types", F.array_append("rels", F.col("rel")).alias("rels"))
        end = d.filter(F.size("types") == i + 2)
        done = end if done is None else done.unionByName(end)
    return top_k(done.select("seq_id", F.array_join("rels", "|").alias("rels")), ["seq_id"], ["rels"], most)


def verify_swap(pairs: DataFrame, schema: DataFrame) -> DataFrame:
    """pairs: id, src, tgt. Swapped where only the other direction has a relation."""
    s = schema.select(F.col("src_type").alias("x"), F.col("tgt_type").alias("y")).distinct()
    fwd = s.select(F.col("x").alias("src"), F.col("y").alias("tgt"), F.lit(True).alias("f"))
    rev = s.select(F.col("y").alias("src"), F.col("x").alias("tgt"), F.lit(True).alias("r"))
    d = pairs.join(fwd, ["src", "tgt"], "left").join(rev, ["src", "tgt"], "left")
    swap = F.col("f").isNull() & F.col("r").isNotNull()
    return d.select("id", F.when(swap, F.col("tgt")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("tgt")).alias("tgt"), swap.alias("swapped"))


def plan_score(plans: DataFrame, schema: DataFrame, plain: bool = False) -> DataFrame:
    """plans: plan_id, hops (array of struct src, tgt), answer_type. 0.5 x share of valid type pairs + 0.3 x share of threaded hops + 0.2 x (0.5 if the last type isn't the answer's, else 1); 0 without a pair.

    Hops without both types are no pairs. The answer's type counts if it is one of the
    schema's and not `entity`. plain: the share of valid pairs alone.
    """
    known = schema.select(F.col("src_type").alias("answer_type")).unionByName(schema.select(F.col("tgt_type").alias("answer_type"))).distinct().filter("answer_type <> 'entity'").withColumn("in_schema", F.lit(True))
    ok = both_ways(schema).select(F.col("a").alias("src"), F.col("b").alias("tgt")).distinct().withColumn("valid", F.lit(1))
    h = plans.select("plan_id", "answer_type", F.posexplode("hops").alias("pos", "h"), "hops").select("plan_id", "answer_type", "pos", F.col("h.src").alias("src"), F.col("h.tgt").alias("tgt"), F.when(F.col("pos") > 0, F.coalesce(F.get(F.col("hops"), F.col("pos") - 1)["tgt"] == F.col("h.src"), F.lit(False)).cast("int")).alias("threaded"))
    pair = F.when((F.col("src") != "") & (F.col("tgt") != ""), F.coalesce("valid", F.lit(0)))
    h = h.join(ok.hint("merge"), ["src", "tgt"], "left").join(known.hint("merge"), "answer_type", "left")
    g = h.groupBy("plan_id").agg(F.avg(pair).alias("valid"), F.coalesce(F.avg("threaded"), F.lit(1.0)).alias("threaded"), F.max_by(F.struct("tgt"), "pos").alias("last"), F.max("answer_type").alias("answer_type"), F.max("in_schema").alias("in_schema"))
    off = F.col("in_schema") & (F.col("last.tgt") != "") & (F.col("last.tgt") != F.col("answer_type"))
    score = F.col("valid") if plain else 0.5 * F.col("valid") + 0.3 * F.col("threaded") + 0.2 * F.when(off, 0.5).otherwise(1.0)
    return plans.select("plan_id").join(g.select("plan_id", score.alias("score")).hint("merge"), "plan_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def transition_map(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """rel, src_type, targets: which types a relation leads to."""
    from ..operators.lookup import schema_edges

    return transitions_of(schema_edges(edges, nodes))


def transitions_of(schema: DataFrame) -> DataFrame:
    """transition_map of schema edges."""
    return schema.groupBy("rel", "src_type").agg(F.array_sort(F.collect_set("tgt_type")).alias("targets"))


def pair_relations(transitions: DataFrame) -> DataFrame:
    """src_type, tgt_type, rels: the relations from one type to another, of a transition map."""
    return transitions.select("src_type", F.explode("targets").alias("tgt_type"), "rel").groupBy("src_type", "tgt_type").agg(F.array_sort(F.collect_set("rel")).alias("rels"))


def outgoing_edges(transitions: DataFrame) -> DataFrame:
    """src_type, edges (array of struct rel, tgt_type): what leaves a type, of a transition map."""
    edge = F.transform("targets", lambda t: F.struct(F.col("rel").alias("rel"), t.alias("tgt_type")))
    return transitions.groupBy("src_type").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(edge)))).alias("edges"))
