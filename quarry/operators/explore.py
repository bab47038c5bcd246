"""Path validation, beam exploration, named graph patterns and relaxed searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import union
from ..functions.text import has_cjk
from ..session import write_table
from .hops import edges_bi, first_tier, hop, named, start, top_k
from .lookup import find_compound, find_compound_via_hub
from .names import containing
from .traverse import anchor_nodes, beginning_alike, follow, limited, links_of, plan_rows, relation_sequences, steps_of, words_at

#: fixed values: pattern, first labels, seed match, then relations and directions from the seed to the answer, last labels, and a property of the answer
PATTERNS = [
    ("drug_treats_cancer", None, "ci", ["TREATMENT"], ["out"], [None], None),
    ("gene_drives_cancer", "Genesymbol", "ci", ["DRIVING_TO"], ["out"], [None], None),
    ("mutation_drives_cancer", None, "ci", ["HAS_VAR", "ORIGINATED_FROM"], ["in", "out"], ["CancerCell", None], None),
    ("drug_activates_gene", None, "ci", ["ACTIVATION_TO"], ["out"], ["Genesymbol"], None),
    ("drug_inhibits_gene", None, "ci", ["INHIBITION_TO"], ["out"], ["Genesymbol"], None),
    ("gene_inhibited_by_drug", "Genesymbol", "ci", ["INHIBITION_TO"], ["in"], [None], None),
    ("gene_inhibited_by_drug_nmpa", "Genesymbol", "ci", ["INHIBITION_TO"], ["in"], [None], "nmpa_approved"),
    ("gene_inhibited_by_drug_fda", "Genesymbol", "ci", ["INHIBITION_TO"], ["in"], [None], "fda_approved"),
    ("cancer_has_mutations", None, "ci", ["ORIGINATED_FROM", "HAS_VAR"], ["in", "out"], ["CancerCell", None], None),
    ("cancer_has_fusions", None, "ci", ["ORIGINATED_FROM", "HAS_VAR"], ["in", "out"], ["CancerCell", "Fusion"], None),
    ("cancercell_resistance_drug", "CancerCell", "contains", ["RESISTANCE_TO"], ["out"], [None], None),
    ("cancercell_sensitivity_drug", "CancerCell", "contains", ["SENSITIVITY_TO"], ["out"], [None], None),
    ("gene_causes_disease", "Genesymbol", "ci", ["CAUSE_TO"], ["out"], ["GeneticDisease"], None),
    ("disease_develops_cancer", "GeneticDisease", "ci", ["DEVELOP_TO"], ["out"], [None], None),
    ("gene_alias", "Genesymbol", "ci", ["IS_A"], ["out"], ["Genesymbol"], None),
    ("treatment_for_cancercell", "CancerCell", "contains", ["SENSITIVITY_TO"], ["out"], [None], None),
    ("disease_induce_cancer", "GeneticDisease", "ci", ["DEVELOP_TO"], ["out"], [None], None),
]
PATTERN_TYPE = "pattern string, seed_label string, match string, rels array<string>, dirs array<string>, labels array<string>, yes_prop string"


def validate_undirected(anchors: DataFrame, candidates: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """anchors: query_id, anchor; candidates: query_id, path_id, rels. query_id, path_id, is_valid, names: what each relation sequence reaches, without labels; edges may repeat."""
    got = named(follow(anchors, candidates, nodes, edges, match="exact", labels=False, unique_edges=False, most_hops=_longest(candidates)), nodes)
    few = limited(got.select("query_id", "path_id", "name").distinct(), most).groupBy("query_id", "path_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    d = candidates.select("query_id", "path_id").distinct().join(few.hint("merge"), ["query_id", "path_id"], "left")
    return d.select("query_id", "path_id", F.col("names").isNotNull().alias("is_valid"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def validate_directed(anchors: DataFrame, candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, path_id of the candidates that, followed along edge direction, reach something."""
    c = candidates.withColumn("dirs", F.transform("rels", lambda r: F.lit("out")))
    got = follow(anchors, c, nodes, edges, match="exact", labels=False, directed=True, unique_edges=False, most_hops=_longest(candidates))
    return got.select("query_id", "path_id").distinct()


def _longest(candidates: DataFrame) -> int:
    return candidates.select(F.max(F.size("rels"))).first()[0] or 1


def pattern_queries(asks: DataFrame, patterns: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """asks: query_id, pattern, seed; patterns: PATTERN_TYPE. query_id, pattern, name: names at the end of each pattern from nodes of the seed (case-folded, or containing it).

    A null label fits all nodes; yes_prop: a property of the answer that must be YES.
    """
    # patterns are few: what none of those that are asked for has is neither looked up nor read
    asked = patterns.join(asks.select("pattern").distinct().hint("merge"), "pattern", "left_semi").select("match", "rels").collect()
    p = asks.select("query_id", "pattern", F.lower(F.trim("seed")).alias("seed")).join(patterns.withColumnRenamed("labels", "stops").hint("merge"), "pattern")
    n = nodes.select("node_id", "labels", F.lower("name").alias("low_name"))
    fits = lambda label: F.coalesce(F.array_contains("labels", label), F.lit(True))
    equal = p.filter("match = 'ci'").join(n, F.col("seed") == F.col("low_name"))
    if any(r["match"] != "ci" for r in asked):
        equal = equal.unionByName(containing(p.filter("match <> 'ci'"), n, "seed", "low_name").select(*equal.columns))
    f = start(equal.filter(fits(F.col("seed_label"))).drop("labels", "low_name"))
    done = []
    for i in range(max([len(r["rels"]) for r in asked], default=1)):
        links = edges_bi(edges.filter(F.col("rel").isin(sorted({r["rels"][i] for r in asked if len(r["rels"]) > i}))))
        f = hop(f, links, F.get("rels", F.lit(i)), F.get("dirs", F.lit(i))).join(nodes.select(F.col("node_id").alias("at"), "labels", "props"), "at")
        f = f.filter(fits(F.get("stops", F.lit(i))))
        done.append(f.filter((F.size("rels") == i + 1) & (F.col("yes_prop").isNull() | F.coalesce(F.element_at("props", F.col("yes_prop")) == "YES", F.lit(False)))).drop("labels", "props"))
        f = f.filter(F.size("rels") > i + 1).drop("labels", "props")
    return named(union(done), nodes).select("query_id", "pattern", "name").distinct()


def pattern_answers(answers: DataFrame) -> DataFrame:
    """query_id, name: case-folded, without names in CJK characters, once each."""
    return answers.filter((F.col("name") != "") & ~has_cjk(F.col("name"))).select("query_id", F.lower("name").alias("name")).distinct()


def beam_explore(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, rel_scores: DataFrame | None = None, entity_scores: DataFrame | None = None, enough: DataFrame | None = None, depth: int = 3, width: int = 3, rels: int = 3, wide: int = 30, ends: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """query_id, depth, rank, src, rel, dst, score: the best `width` steps of each depth.

    From each of the entities so far: its `rels` best relations, of each the `width` best of
    its first `wide` neighbours, scored half by relation and half by entity. rel_scores
    (query_id, rel, score) and entity_scores (query_id, rel, name, score) default to 1 over
    the number of relations, and 1 over that of neighbours (0 if there are more than `width`).
    enough: query_id, depth: stop after it. ends (with nodes that have a kind) as in
    relation_sequences.

    What can be taken from an entity is the same for all queries: it is looked up once an
    entity, and of each relation its first neighbours alone go to the queries.
    """
    known = ends is not None and "kind" in nodes.columns
    name = nodes.select("node_id", "name", *(["kind"] if known else [])).filter("name <> ''")
    beam = anchors.select("query_id", F.col("anchor").alias("src")).distinct()
    steps = None
    # without scores of entities all neighbours by a relation are equal, and the first by name are the best
    most = wide if entity_scores is not None else min(width, wide)
    for no in range(1, depth + 1):
        own = beam.select(F.col("src").alias("anchor")).distinct()
        at = own.withColumnRenamed("anchor", "src").join(beginning_alike(own, name).withColumnsRenamed({"name": "src", "node_id": "a_id"}), "src")
        links, there = edges_bi(edges), name
        if known:
            at = write_table(at, "beam_nodes")
            here, after = steps_of({r["kind"] for r in at.select("kind").distinct().collect()}, 2, ends)
            links, there, at = links_of(edges, here, ends), name.filter(F.col("kind").isin(sorted(after[0]))).drop("kind"), at.drop("kind")
        near = at.join(links.select("a_id", "rel", "b_id"), "a_id").join(there.withColumnsRenamed({"node_id": "b_id", "name": "dst"}), "b_id").select("src", "rel", "dst").distinct()
        near = top_k(near.withColumn("m", F.count("*").over(Window.partitionBy("src", "rel"))), ["src", "rel"], ["dst"], most)
        near = write_table(near.groupBy("src", "rel").agg(F.max("m").alias("m"), F.collect_list("dst").alias("dsts")).withColumn("n", F.count("*").over(Window.partitionBy("src"))), "near")
        r = beam.join(near.hint("merge"), "src")
        r = r.withColumn("rs", 1 / F.col("n")) if rel_scores is None else r.join(rel_scores.select("query_id", "rel", "score").hint("merge"), ["query_id", "rel"], "left").withColumn("rs", F.coalesce("score", 1 / F.col("n"))).drop("score")
        few = top_k(r, ["query_id", "src"], [F.desc("rs"), "rel"], rels).select("query_id", "src", "rel", "rs", "m", F.explode("dsts").alias("dst"))
        plain = F.when(F.col("m") <= width, 1 / F.col("m")).otherwise(F.lit(0.0))
        few = few.withColumn("es", plain) if entity_scores is None else few.join(entity_scores.select("query_id", "rel", F.col("name").alias("dst"), "score").hint("merge"), ["query_id", "rel", "dst"], "left").withColumn("es", F.coalesce("score", plain)).drop("score")
        few = top_k(few, ["query_id", "src", "rel"], [F.desc("es"), "dst"], width)
        best = top_k(few.withColumn("score", F.col("rs") * 0.5 + F.col("es") * 0.5), ["query_id"], [F.desc("score"), "src", "rel", "dst"], width, "rank")
        best = write_table(best.select("query_id", F.lit(no).alias("depth"), "rank", "src", "rel", "dst", "score"), "beam")
        steps = best if steps is None else steps.unionByName(best)
        beam = best.select("query_id", F.col("dst").alias("src")).distinct()
        if enough is not None:
            beam = beam.join(enough.filter(F.col("depth") <= no).select("query_id").distinct().hint("merge"), "query_id", "left_anti")
    return steps


def path_per_source_type(paths: DataFrame, needed: DataFrame, few: int = 3) -> DataFrame:
    """paths: query_id, path_id, types, score; needed: query_id, src_type, for intersections only. The best path of each needed first type; of other queries the first few."""
    p = paths.withColumn("src_type", F.get("types", F.lit(0)))
    order = [F.desc("score"), "path_id"]
    by_type = top_k(p.join(needed.distinct().hint("merge"), ["query_id", "src_type"], "left_semi"), ["query_id", "src_type"], order, 1)
    plain = top_k(p.join(needed.select("query_id").distinct().hint("merge"), "query_id", "left_anti"), ["query_id"], order, few)
    return by_type.unionByName(plain).select("query_id", "path_id")


def relaxed_sequences(anchors: DataFrame, types: list[str], generic: str, nodes: DataFrame, edges: DataFrame, ends: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """query_id, rels, tier: relation sequences along the types; without any, along one generic type; without any, along any. ends as in relation_sequences."""
    parts, left = [], anchors
    for no, t in enumerate((types, [generic] * len(types), None), 1):
        got = write_table(relation_sequences(left, len(types), nodes, edges, t, ends), "sequences")
        parts.append(got.withColumn("tier", F.lit(no)))
        # the next tier is for queries that are still empty
        left = write_table(left.join(got.select("query_id").distinct().hint("merge"), "query_id", "left_anti"), "left_over")
        if left.isEmpty():
            break
    return union(parts)


def best_path_answers(anchors: DataFrame, ranked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """anchors: query_id, anchor; ranked: query_id, path_id, rels, rank. query_id, name: what the first path reaches, one clause a hop; of an empty one the anchor itself."""
    first = write_table(top_k(ranked, ["query_id"], ["rank", "path_id"], 1).select("query_id", "rels"), "first_paths")
    a = anchors.join(first.hint("merge"), "query_id")
    done = [a.filter(F.size("rels") == 0).select("query_id", F.col("anchor").alias("name"))]
    longest = _longest(first)
    if longest > 0:
        got = plan_rows(first)
        name = nodes.select(F.col("node_id").alias("b_id"), "name").filter("name <> ''")
        f = anchor_nodes(a.filter(F.size("rels") > 0), nodes, "exact").select("query_id", "anchor", "rels", F.col("node_id").alias("at")).distinct()
        for i in range(longest):
            # relations are few, and known before edges are read: none are dealt out by relation
            rels = words_at(got, "rels", i)
            step = edges_bi(edges.filter(F.col("rel").isin(rels)) if rels else edges).select("a_id", F.col("rel").alias("step_rel"), "b_id")
            # how a node was reached doesn't matter: paths count as nodes
            f = f.join(step.hint("merge"), (F.col("at") == F.col("a_id")) & (F.get("rels", F.lit(i)) == F.col("step_rel"))).select("query_id", "anchor", "rels", "b_id").distinct()
            f = f.join(name.hint("merge"), "b_id").filter("name <> anchor")
            done.append(f.filter(F.size("rels") == i + 1).select("query_id", "name"))
            f = f.filter(F.size("rels") > i + 1).select("query_id", "anchor", "rels", F.col("b_id").alias("at"))
    return union(done).distinct()


def compound_resolution(asks: DataFrame, rel: str, label: str, nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """asks: query_id, terms (array). query_id, name, type: the shorter term names what links by `rel` to a hub, the longer the hub; else hubs that contain all terms, of the label first, then any node."""
    t = asks.select("query_id", F.array_sort("terms", lambda a, b: F.char_length(a) - F.char_length(b)).alias("terms"))
    lab = nodes.select("name", F.filter("labels", lambda x: ~x.isin("_Entity", "Entity")).alias("labels"))
    pairs = t.filter(F.size("terms") >= 2).select("query_id", F.get("terms", F.lit(0)).alias("first"), F.element_at("terms", -1).alias("second"))
    hubs = nodes.filter(F.array_contains("labels", label))
    via = find_compound_via_hub(pairs, rel, nodes, edges).join(hubs.select("name").distinct(), "name", "left_semi").select("query_id", "name")
    words = t.select("query_id", F.explode("terms").alias("term"))
    direct = find_compound(words, nodes, label, most).select("query_id", "name")
    loose = find_compound(words, nodes, None, most).select("query_id", "name")
    got = first_tier([via.distinct(), direct.distinct(), loose.distinct()], ["query_id"])
    kinds = lab.groupBy("name").agg(F.max(F.array_contains("labels", label)).alias("hub"), F.min(F.get("labels", F.lit(0))).alias("one"))
    return got.join(kinds.hint("merge"), "name").select("query_id", "name", F.when(F.col("hub"), label).otherwise(F.coalesce("one", F.lit("Unknown"))).alias("type"))
