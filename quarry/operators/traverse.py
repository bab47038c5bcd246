"""Multi-hop traversal over typed paths, many anchors and paths at once.

anchors: query_id, anchor (a name). paths: path_id, types, rels and, for directed forms,
dirs. Operators keep the reference templates' node inequalities, which depend on the
number of hops, and the rule that one MATCH uses no edge twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..fixtures import union
from ..session import write_table
from .hops import apart, between, edges_bi, first_tier, hop, labelled, leaving, named, start, top_k, turned
from .names import containing

#: fixed values: positions that must differ, by number of hops
TEMPLATE_APART = {1: [(0, 1)], 2: [(0, 1), (1, 2), (0, 2)], 3: [(0, 1), (1, 2), (2, 3), (0, 3)]}
BOUND_APART = {1: [(0, 1)], 2: [(0, 1), (1, 2), (0, 2)], 3: [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)]}

#: shared paths that are broadcast
MOST_SHARED = 10_000


def anchor_nodes(anchors: DataFrame, nodes: DataFrame, match: str = "ci") -> DataFrame:
    """anchors with node_id of every node of that name. match: exact, ci (case-folded), contains (case-folded substring)."""
    n = nodes.select("node_id", F.col("name").alias("_name"))
    if match == "exact":
        return anchors.join(n, F.col("anchor") == F.col("_name")).drop("_name")
    if match == "ci":
        return anchors.join(n, F.lower("anchor") == F.lower("_name")).drop("_name")
    return containing(anchors, n, "anchor", "_name").drop("_name")


def listed_anchors(anchors: DataFrame) -> DataFrame:
    """anchors with an array of names instead of one (compound names): a row for each name, for matches on any of them."""
    return anchors.withColumn("anchor", F.explode(F.array_distinct("anchor")))


def planned(anchors: DataFrame, paths: DataFrame) -> DataFrame:
    """Anchors with their paths: by query_id, by plan (many queries sharing a set of paths), or both."""
    by = [c for c in ("query_id", "plan") if c in paths.columns and c in anchors.columns]
    # a set of paths that queries share goes to all tasks while it is small; paths of queries meet them by key
    few = "query_id" not in by and paths.limit(MOST_SHARED + 1).count() <= MOST_SHARED
    return anchors.join(F.broadcast(paths) if few else paths.hint("merge"), by)


def plan_rows(paths: DataFrame, most: int = 1000) -> list | None:
    """The distinct rels and types of a plan table, if they are few; they let Spark leave out whole edge and node sources, and hops that no path has."""
    got = paths.select("rels", "types" if "types" in paths.columns else F.lit(None).alias("types")).distinct().limit(most + 1).collect()
    return got if len(got) <= most else None


def words_at(got: list | None, column: str, i: int | None) -> list[str] | None:
    """Words that the paths have at a place (None: the type at the path's end); None, if that isn't known."""
    if got is None:
        return None
    at = lambda r: len(r["rels"]) if i is None else i
    return sorted({r[column][at(r)] for r in got if r[column] and len(r[column]) > at(r)}) or None


def path_ends(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the types that the paths end at."""
    return of_types(nodes, words_at(plan_rows(paths), "types", None))


def repeats_relation(paths: DataFrame, most_hops: int) -> bool:
    """Whether a path of up to most_hops hops has a relation twice."""
    rels = F.slice("rels", 1, most_hops)
    return not paths.filter(F.size(F.array_distinct(rels)) < F.size(rels)).isEmpty()


def of_types(nodes: DataFrame, types: list[str] | None) -> DataFrame:
    """Nodes that bear one of the types; by kind, where nodes are stored by it."""
    if not types:
        return nodes
    wanted = F.array(*map(F.lit, types))
    if "kind" in nodes.columns:
        return nodes.filter(F.arrays_overlap(F.split("kind", r"\+"), wanted)).drop("kind")
    return nodes.filter(F.arrays_overlap("labels", wanted))


def follow(
    anchors: DataFrame,
    paths: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    match: str = "ci",
    most_hops: int = 3,
    labels: bool = True,
    inequalities: dict[int, list[tuple[int, int]]] | None = None,
    directed: bool = False,
    unique_edges: bool = True,
    check: Callable | None = None,
) -> DataFrame:
    """Frontier rows at the ends of all paths of up to most_hops hops; longer paths give nothing."""
    got = plan_rows(paths)
    lengths = [n for n in (sorted({len(r["rels"]) for r in got}) if got is not None else range(1, most_hops + 1)) if 0 < n <= most_hops]
    # an edge has one relation: it can only be met again by paths that repeat one, and edge ids are read for these alone
    unique_edges = unique_edges and repeats_relation(paths, most_hops)
    # each step reads the relations and types alone that paths have there
    of_step = lambda i: of_types(nodes, words_at(got, "types", i) if labels else None)
    f = start(planned(anchor_nodes(anchors, of_step(0), match), paths))
    f = f.filter(F.size("rels") <= most_hops)
    if labels:
        f = labelled(f, of_step(0), F.get("types", F.lit(0)))
    done = []
    for i in range(max(lengths, default=1)):
        rels = words_at(got, "rels", i)
        links = edges_bi(edges.filter(F.col("rel").isin(rels)) if rels else edges)
        f = hop(f, links, F.get("rels", F.lit(i)), F.get("dirs", F.lit(i)) if directed else None, unique_edges)
        if labels:
            f = labelled(f, of_step(i + 1), F.get("types", F.lit(i + 1)))
        if check is not None:
            f = check(f, i)
        if i + 1 in lengths or not lengths:
            here = f.filter(F.size("rels") == i + 1)
            done.append(here.filter(apart(inequalities[i + 1])) if inequalities else here)
            f = f.filter(F.size("rels") > i + 1)
    return union(done)


def typed_paths(anchors: DataFrame, paths: DataFrame, nodes: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """query_id, path_id, name: distinct names that the typed paths reach, in either edge direction."""
    how.setdefault("inequalities", TEMPLATE_APART)
    ends = path_ends(paths, nodes) if how.get("labels", True) else nodes
    return named(follow(anchors, paths, nodes, edges, **how), ends).select("query_id", "path_id", "name").distinct()


def limited(answers: DataFrame, n: int, by: tuple[str, ...] = ("query_id", "path_id")) -> DataFrame:
    """First n names of each group, in name order."""
    return top_k(answers, list(by), ["name"], n)


def relaxed_paths(anchors: DataFrame, paths: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """Paths of one or two hops by relation only."""
    return limited(typed_paths(anchors, paths, nodes, edges, labels=False, most_hops=2), most)


def bound_paths(anchors: DataFrame, paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One to three hops from an exactly named anchor."""
    return typed_paths(anchors, paths, nodes, edges, match="exact", inequalities=BOUND_APART)


def directed_paths(anchors: DataFrame, paths: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 50, match: str = "exact") -> DataFrame:
    """Paths whose steps have directions; no node inequalities. The anchor is a name, an array of names (any of them), or with match contains what names must contain."""
    if isinstance(anchors.schema["anchor"].dataType, ArrayType):
        anchors = listed_anchors(anchors)
    got = follow(anchors, paths, nodes, edges, match=match, directed=True, unique_edges=False)
    return limited(named(got, path_ends(paths, nodes)).select("query_id", "path_id", "name").distinct(), most)


def unchecked_paths(anchors: DataFrame, paths: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """Undirected typed paths without node inequalities."""
    return limited(named(follow(anchors, paths, nodes, edges, match="exact"), path_ends(paths, nodes)).select("query_id", "path_id", "name").distinct(), most)


def reachable(anchors: DataFrame, rels: list[str], nodes: DataFrame, edges: DataFrame, distinct: bool = True) -> DataFrame:
    """query_id, name: ends of a relation sequence, one clause per hop (edges may repeat); no hop node bears the start's name."""
    if not rels:
        return anchors.select("query_id", F.col("anchor").alias("name"))
    links = edges_bi(edges)
    f = start(anchor_nodes(anchors, nodes, "exact"))
    for r in rels:
        f = named(hop(f, links, r, unique_edges=False), nodes).filter("name <> anchor")
        if distinct:
            # how a node was reached doesn't matter: paths count as nodes
            f = f.select("query_id", "anchor", "at", "name").distinct().withColumns({"ids": F.array("at"), "eids": F.array().cast("array<string>")})
        last, f = f, f.drop("name")
    out = last.select("query_id", "name")
    return out.distinct() if distinct else out


def beginning_alike(anchors: DataFrame, nodes: DataFrame, most: int = 1000) -> DataFrame:
    """Nodes but for those whose names begin as no anchor does; all, if anchors begin in many ways."""
    got = [r[0] for r in anchors.filter("anchor is not null").select(F.substring("anchor", 1, 2)).distinct().limit(most + 1).collect()]
    return nodes.filter(F.substring("name", 1, 2).isin(got)) if len(got) <= most else nodes


def steps_of(kinds: set[str], hops: int, ends: dict[str, tuple[str, str]], types: list[str] | None = None) -> list[tuple[set[str], list[str], list[str]]]:
    """For each hop the kinds of nodes it may start at, and the relations that may be followed out and in. ends: the kinds that a relation leads from and to."""
    steps = []
    for i in range(hops):
        fits = lambda k, i=i: types is None or types[i] in k.split("+")
        out, back = sorted(r for r, (s, t) in ends.items() if s in kinds and fits(t)), sorted(r for r, (s, t) in ends.items() if t in kinds and fits(s))
        steps.append((kinds, out, back))
        kinds = {ends[r][1] for r in out} | {ends[r][0] for r in back}
    return steps


def links_of(edges: DataFrame, step: tuple[set[str], list[str], list[str]], ends: dict[str, tuple[str, str]]) -> DataFrame:
    """Links (with the kind of b) of a step of steps_of."""
    kind = lambda end: F.element_at(F.create_map(*[F.lit(x) for r, k in ends.items() for x in (r, k[end])]), F.col("rel"))
    return union([turned(edges.filter(F.col("rel").isin(r)), way).withColumn("kind", kind(end)) for r, way, end in zip(step[1:], ("out", "in"), (1, 0))])


def few_that_avoid(paths: DataFrame, by: list[str], n: int) -> DataFrame:
    """Few paths of each group: one of them has none of any n given nodes in ids, if any path of the group does.

    The first path is kept; for each of its nodes, of the paths without it few that avoid n - 1
    others. Their number depends on n and the length alone.
    """
    d = paths.withColumns({"_kept": F.lit(False), "_without": F.array().cast(paths.schema["ids"].dataType)})
    for level in range(n + 1):
        w = Window.partitionBy(*by, "_kept", "_without").orderBy("ids")
        d = d.withColumns({"_first": F.first("ids").over(w), "_no": F.row_number().over(w)})
        keep = F.col("_kept") | (F.col("_no") == 1)
        if level == n:
            return d.filter(keep).drop("_kept", "_without", "_first", "_no")
        next_ones = F.transform(F.array_except("_first", "ids"), lambda x: F.struct(F.lit(False).alias("kept"), F.array_append("_without", x).alias("without")))
        same = F.array(F.struct(F.lit(True).alias("kept"), F.col("_without").alias("without")))
        d = d.withColumn("_to", F.explode(F.when(keep, same).otherwise(next_ones))).withColumns({"_kept": F.col("_to.kept"), "_without": F.col("_to.without")}).drop("_to", "_first", "_no")


def relation_sequences(anchors: DataFrame, hops: int, nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, ends: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """query_id, rels: distinct relation sequences of all simple paths of exactly `hops` hops.

    Only whether a sequence has a path counts, so few paths stand for all. They are made from
    the last hop on: a node gets, for each sequence that leads on from it, few ways of which one
    avoids any nodes that a path may have had before it (few_that_avoid). So each hop takes as
    many rows as there are links. ends (with nodes that have a kind) leaves out relations that
    no path can have at a hop, and nodes of a kind that no node before can be of: these need no
    avoiding.
    """
    known = ends is not None and "kind" in nodes.columns
    at = beginning_alike(anchors, nodes).select("node_id", F.col("name").alias("anchor"), *(["kind"] if known else []))
    starts = anchors.select("query_id", "anchor").join(at, "anchor").drop("anchor").distinct()
    steps = None
    if known:
        starts = write_table(starts, "sequence_starts")
        steps = steps_of({r["kind"] for r in starts.select("kind").distinct().collect()}, hops, ends, types)

    def links(i: int) -> DataFrame:
        """a_id, rel, b_id, kind (of b) that hop i may take; some more than once."""
        if steps is None:
            both = edges_bi(edges).withColumn("kind", F.lit(None).cast("string"))
        else:
            both = links_of(edges, steps[i], ends)
        d = both.filter("a_id <> b_id").select("a_id", "rel", "b_id", "kind")
        return labelled(d.withColumn("at", F.col("b_id")), of_types(nodes, [types[i]]), types[i]).drop("at") if types else d

    def to_avoid(ids: Column, i: int) -> Column:
        """Of the ids those that may be a node before place i."""
        before = sorted(set().union(*[k for k, _, _ in steps[:i]])) if steps is not None else None
        return ids if before is None else F.filter(ids, lambda x: x["kind"].isin(before))

    free = ~F.exists("ids", lambda x: x["id"] == F.col("a_id"))
    own = F.struct(F.col("b_id").alias("id"), "kind")
    tails = None
    for i in range(hops - 1, 0, -1):
        if tails is None:
            # of a node's neighbours by a relation i + 1 are enough: one avoids the i nodes before, whichever they are
            d = links(i).select("a_id", F.array("rel").alias("rels"), to_avoid(F.array(own), i).alias("ids")).distinct()
            d = top_k(d, ["a_id", "rels"], ["ids"], i + 1)
        else:
            d = links(i).join(tails.hint("merge"), "b_id").filter(free)
            d = d.select("a_id", F.array_prepend("rels", F.col("rel")).alias("rels"), to_avoid(F.array_prepend("ids", own), i).alias("ids")).distinct()
            d = few_that_avoid(d, ["a_id", "rels"], i)
        tails = d.withColumnRenamed("a_id", "b_id")
    f = starts.withColumnRenamed("node_id", "a_id").drop("kind").join(links(0).drop("kind"), "a_id")
    if tails is None:
        return f.select("query_id", F.array("rel").alias("rels")).distinct()
    return f.join(tails.hint("merge"), "b_id").filter(free).select("query_id", F.array_prepend("rels", F.col("rel")).alias("rels")).distinct()


def paths_via_hub(anchors: DataFrame, paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, path_id, name: steps written r1..r2 pass through a CVT node; only the ends must differ.

    Each step reads the relations alone that paths have there, between kinds of nodes that
    paths have there; rows carry edge ids only for paths that repeat a relation.
    """
    p = paths.withColumn("steps", F.flatten(F.transform("rels", lambda r: F.split(r, r"\.\."))))
    p = p.withColumn("stops", F.flatten(F.zip_with(F.slice("types", 2, F.size("types")), "rels", lambda t, r: F.when(r.contains(".."), F.array(F.lit("CVT"), t)).otherwise(F.array(t)))))
    most = how_long(paths)
    plan = p.select(F.col("steps").alias("rels"), F.concat(F.slice("types", 1, 1), "stops").alias("types"))
    got, again = plan_rows(plan), repeats_relation(plan, most)
    types = lambda i: words_at(got, "types", i)
    carried = ["query_id", "path_id", "steps", "stops"]
    f = labelled(start(planned(anchor_nodes(anchors, of_types(nodes, types(0))), p)), of_types(nodes, types(0)), F.get("types", F.lit(0)))
    f = f.select(*carried, "at", F.array("at").alias("ids"), "eids")
    done = []
    for i in range(most):
        f = f.filter(F.size("steps") > i)
        rels = words_at(got, "rels", i)
        links = between(edges_bi(edges.filter(F.col("rel").isin(rels)) if rels else edges), types(i), types(i + 1))
        f = hop(f, links, F.get("steps", F.lit(i)), unique_edges=again)
        # of the nodes only the first is compared, and edges only where they may be met again
        f = f.select(*carried, "at", F.slice("ids", 1, 1).alias("ids"), "eids" if again else F.array().cast("array<string>").alias("eids"))
        f = labelled(f, of_types(nodes, types(i + 1)), F.get("stops", F.lit(i)))
        done.append(f.filter((F.size("steps") == i + 1) & (F.get("ids", F.lit(0)) != F.col("at"))).select("query_id", "path_id", "at"))
    return named(union(done), of_types(nodes, words_at(got, "types", None))).select("query_id", "path_id", "name").distinct()


def how_long(paths: DataFrame) -> int:
    """Steps of the longest path, hubs counted; paths are a small plan table."""
    return paths.select(F.max(F.size(F.flatten(F.transform("rels", lambda r: F.split(r, r"\.\.")))))).first()[0] or 1


def path_chains(anchors: DataFrame, paths: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """query_id, path_id, chain: whole chains as text `a -[r]-> b -[r]-> c`, at most `most` per query."""
    def keep_name(f: DataFrame, i: int) -> DataFrame:
        before = F.col("stops") if i else F.array("anchor")
        return named(f, nodes, "stop").withColumn("stops", F.array_append(before, F.col("stop"))).drop("stop")

    got = follow(anchors, paths, nodes, edges, match="exact", directed=True, unique_edges=False, check=keep_name)
    text = F.concat(F.get("stops", F.lit(0)), F.array_join(F.zip_with("rels", F.slice("stops", 2, F.size("stops")), lambda r, s: F.concat(F.lit(" -["), r, F.lit("]-> "), s)), ""))
    return top_k(got.select("query_id", "path_id", text.alias("chain")), ["query_id"], ["path_id", "chain"], most)


def intersect_anchors(answers: DataFrame, anchors: DataFrame) -> DataFrame:
    """answers: query_id, anchor_no, name. Names that every anchor of the query reaches."""
    n = anchors.groupBy("query_id").agg(F.countDistinct("anchor_no").alias("n"))
    got = answers.groupBy("query_id", "name").agg(F.countDistinct("anchor_no").alias("m"))
    return got.join(n, "query_id").filter("m = n").select("query_id", "name")


def bound_subgraphs(anchors: DataFrame, paths: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """query_id, path_id, ids, eids: label-free matches with their nodes and edges."""
    got = follow(anchors, paths, nodes, edges, match="exact", labels=False, inequalities=BOUND_APART)
    return top_k(got.select("query_id", "path_id", "ids", "eids"), ["query_id", "path_id"], [F.array_join("eids", "|")], most)


def resolve_hubs(answers: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """answers: query_id, name. Names that start with m. give way to the named neighbours of their nodes, if any answer of the query then has a name."""
    hubs = answers.filter(F.col("name").startswith("m."))
    of_hubs = nodes.filter(F.col("name").startswith("m."))
    links = leaving(edges_bi(edges), of_hubs).select("a_id", "b_id")
    # one step uses no edge twice, so edge ids don't matter
    at = hubs.join(of_hubs.select("node_id", "name"), "name").select("query_id", F.col("node_id").alias("a_id"))
    near = named(at.join(links, "a_id").select("query_id", F.col("b_id").alias("at")), nodes.filter(~F.col("name").startswith("m.")))
    plain = answers.filter(~F.col("name").startswith("m.")).select("query_id", "name").unionByName(near.select("query_id", "name"))
    return first_tier([plain.distinct(), hubs.select("query_id", "name").distinct()], ["query_id"]).drop("tier")


def trial(answers: DataFrame, candidates: DataFrame, n: int = 5, keep_empty: bool = False) -> DataFrame:
    """answers: query_id, path_id, name. One row per candidate path with its first n names; empty ones dropped or kept."""
    got = limited(answers, n).groupBy("query_id", "path_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    out = candidates.select("query_id", "path_id").distinct().join(got, ["query_id", "path_id"], "left")
    return out.withColumn("names", F.coalesce("names", F.array().cast("array<string>"))) if keep_empty else out.filter("names is not null")


def relation_between(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """pairs: query_id, a, b (names). rel and its readable form, either direction, at most `most` per query."""
    links = leaving(edges_bi(edges), pairs.select(F.col("a").alias("name")).distinct().join(nodes, "name")).select("a_id", "rel", "b_id")
    n = nodes.select("node_id", "name")
    p = pairs.join(n.select(F.col("node_id").alias("a_id"), F.col("name").alias("a")), "a").join(n.select(F.col("node_id").alias("b_id"), F.col("name").alias("b")), "b")
    got = p.join(links, ["a_id", "b_id"]).select("query_id", "rel").distinct()
    return top_k(got, ["query_id"], ["rel"], most).withColumn("phrase", F.translate("rel", "_", " "))


def entities_via(anchors: DataFrame, rel: str, nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """Outgoing neighbours over one relation."""
    got = named(hop(start(anchor_nodes(anchors, nodes, "exact")), edges_bi(edges), rel, "out"), nodes).select("query_id", "name").distinct()
    return limited(got, most, ("query_id",))


def first_nonempty(answers: DataFrame, ranks: DataFrame, spare: int = 3) -> DataFrame:
    """answers: query_id, path_id, name; ranks: query_id, path_id, chosen (boolean), rank. The chosen paths' answers, or those of the first `spare` others."""
    r = top_k(ranks.filter(~F.col("chosen")), ["query_id"], ["rank"], spare).unionByName(ranks.filter("chosen"))
    got = answers.join(r.select("query_id", "path_id", "chosen"), ["query_id", "path_id"])
    return first_tier([got.filter("chosen").drop("chosen"), got.filter(~F.col("chosen")).drop("chosen")], ["query_id"])


def triples_around(anchors: DataFrame, rels: list[str], nodes: DataFrame, edges: DataFrame, most: int = 50, wide: int = 10) -> DataFrame:
    """query_id, src, rel, dst: triples of the chosen relations within two hops; hop two starts from the first `wide` nodes of hop one."""
    links = edges_bi(edges.filter(F.col("rel").isin(rels)))
    s = anchor_nodes(anchors, nodes, "exact")
    one = s.join(links, F.col("node_id") == F.col("a_id")).select("query_id", "a_id", "rel", "b_id", "dir")
    nxt = top_k(one.select("query_id", F.col("b_id").alias("node_id")).distinct(), ["query_id"], ["node_id"], wide)
    two = nxt.join(links, F.col("node_id") == F.col("a_id")).select("query_id", "a_id", "rel", "b_id", "dir")
    both = one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))
    out = F.col("dir") == "out"
    t = both.select("query_id", "hop", F.when(out, F.col("a_id")).otherwise(F.col("b_id")).alias("src"), "rel", F.when(out, F.col("b_id")).otherwise(F.col("a_id")).alias("dst"))
    t = t.groupBy("query_id", "src", "rel", "dst").agg(F.min("hop").alias("hop"))
    return top_k(t, ["query_id"], ["hop", "src", "rel", "dst"], most)


def hubs_of(anchors: DataFrame, hub: str, nodes: DataFrame, edges: DataFrame, via: tuple[str, str] | None = None) -> DataFrame:
    """query_id, node_id of nodes labelled hub: those whose name contains the anchor, or with via (relation, label) those that the relation leads from to a node of the label with the anchor's name, case-folded."""
    of_hub = nodes.filter(F.array_contains("labels", hub))
    if via is None:
        return anchor_nodes(anchors, of_hub, "contains").select("query_id", "node_id").distinct()
    rel, label = via
    variants = anchor_nodes(anchors, nodes.filter(F.array_contains("labels", label)), "ci").select("query_id", F.col("node_id").alias("dst_id"))
    met = variants.join(edges.filter(F.col("rel") == rel).select("src_id", "dst_id").hint("merge"), "dst_id")
    return met.join(of_hub.select(F.col("node_id").alias("src_id")).hint("merge"), "src_id").select("query_id", F.col("src_id").alias("node_id")).distinct()


def hub_fallback(anchors: DataFrame, labels: list[str], nodes: DataFrame, edges: DataFrame, most: int = 30, hub: str | None = None, via: tuple[str, str] | None = None) -> DataFrame:
    """query_id, label, name: neighbours, over any relation, that bear one of the labels; at most `most` per label. Of the nodes of the anchor's name, or with hub of hubs_of."""
    s = anchor_nodes(anchors, nodes, "ci").select("query_id", "node_id") if hub is None else hubs_of(anchors, hub, nodes, edges, via)
    links = between(edges_bi(edges), [hub] if hub else None, labels)
    f = s.join(links.filter("a_id <> b_id").select(F.col("a_id").alias("node_id"), F.col("b_id").alias("at")).hint("merge"), "node_id").select("query_id", "at").distinct()
    got = f.join(nodes.filter("name is not null").select(F.col("node_id").alias("at"), "name", F.explode("labels").alias("label")).hint("merge"), "at").filter(F.col("label").isin(labels))
    return top_k(got.select("query_id", "label", "name").distinct(), ["query_id", "label"], ["name"], most)


#: fixed values: types whose names are values, and collide with names of other things
VALUE_TYPES = ["Date", "Number", "Text", "Language"]


def terminal_type_check(answers: DataFrame, expected: DataFrame, nodes: DataFrame, sample: int = 10) -> DataFrame:
    """answers: query_id, name; expected: query_id, label. query_id, mismatch: none of the first `sample` answers bears the expected label, though they have labels. Value types are not checked."""
    checked = expected.filter(~F.col("label").isin(VALUE_TYPES))
    few = top_k(answers.select("query_id", "name").distinct(), ["query_id"], ["name"], sample)
    got = few.join(nodes.select("name", "labels").hint("merge"), "name").filter("size(labels) > 0").join(checked.hint("merge"), "query_id")
    return got.groupBy("query_id").agg((~F.bool_or(F.array_contains("labels", F.col("label")))).alias("mismatch"))


def type_checked(answers: DataFrame, expected: DataFrame, nodes: DataFrame, sample: int = 10) -> DataFrame:
    """answers without those of queries whose type doesn't match."""
    wrong = terminal_type_check(answers, expected, nodes, sample).filter("mismatch").select("query_id")
    return answers.join(wrong.hint("merge"), "query_id", "left_anti")


def folded_types(plans: DataFrame) -> DataFrame:
    """plans: query_id, path_id, anchor_type, schema_edges (array of struct src_type, rel, tgt_type). query_id, path_id, types, rels: from the anchor's type each edge leads to its other end; to its source, if it doesn't start at the type at hand."""
    step = "if(lower(element_at(a, -1)) = lower(e.src_type), e.tgt_type, e.src_type)"
    types = F.expr(f"aggregate(schema_edges, array(anchor_type), (a, e) -> array_append(a, {step}))")
    return plans.select("query_id", "path_id", types.alias("types"), F.transform("schema_edges", lambda e: e["rel"]).alias("rels"))


def orient(paths: DataFrame, anchor_labels: DataFrame) -> DataFrame:
    """Reverse paths of which only the last type is a label of the anchor. anchor_labels: query_id, labels."""
    p = paths.join(anchor_labels, "query_id")
    turn = ~F.array_contains("labels", F.get("types", F.lit(0))) & F.array_contains("labels", F.element_at("types", -1))
    flip = F.transform(F.reverse("dirs"), lambda d: F.when(d == "out", "in").otherwise("out"))
    return p.withColumns({"types": F.when(turn, F.reverse("types")).otherwise(F.col("types")), "rels": F.when(turn, F.reverse("rels")).otherwise(F.col("rels")), "dirs": F.when(turn, flip).otherwise(F.col("dirs")), "turned": turn}).drop("labels")
